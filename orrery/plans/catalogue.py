"""Queries over the driver's tables, with the SQL that states the same result.

The tables hold no meshes, so operators run on stand-ins: order lines are votes (face = part,
panorama = supplier, instance = order, class = line number, weight = quantity) and ray hits, the
first components of embeddings are points, nations and customers are rooms and objects, parts in
rows of 50 are a raster, and parts that meet in an order form a graph.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import geometry as g
from orrery.functions import vocabulary
from orrery.operators import aggregate, graph, hull, joins, raster, relations, vote
from orrery.plans import fusion
from orrery.sources import export, readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("face"), F.col("l_suppkey").alias("pano"), F.col("l_orderkey").alias("inst"),
        F.col("l_linenumber").cast("bigint").alias("class"), F.col("l_quantity").alias("w"),
    )


V = """v AS (SELECT l_partkey AS face, l_suppkey AS pano, l_orderkey AS inst, CAST(l_linenumber AS BIGINT) AS class, l_quantity AS w FROM lineitem)"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k: F.col("embedding")[k].cast("double")
    return _read(spark, sf_dir, "embeddings").select("vec_id", "label", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


P = """p AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"""


def _round(value, digits: int = 6):
    """Rounded and free of negative zero."""
    return F.round(value, digits) + F.lit(0.0)


# --- votes -------------------------------------------------------------------------------------


@query(f"""WITH {V}, n AS (SELECT face, class, count(*) AS n FROM v GROUP BY ALL)
SELECT face, class FROM n QUALIFY row_number() OVER (PARTITION BY face ORDER BY n DESC, class) = 1""")
def vote_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote.majority(_votes(spark, sf_dir), ["face"], "class")


@query(f"""WITH {V}, n AS (SELECT face, class, sum(w) AS s FROM v GROUP BY ALL)
SELECT face, class FROM n QUALIFY row_number() OVER (PARTITION BY face ORDER BY s DESC, class) = 1""")
def vote_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote.weighted(_votes(spark, sf_dir), ["face"], "class", F.col("w"))


@query(f"""WITH {V} SELECT face, class, sum(w) AS score FROM v GROUP BY ALL""")
def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote.scores(_votes(spark, sf_dir), ["face"], "class", F.col("w"))


@query(f"""WITH {V}, u AS (SELECT face, class, CAST(sum(w) OVER (PARTITION BY face) / w * 1000000 AS DECIMAL(38, 0)) AS q FROM v),
n AS (SELECT face, class, sum(q) AS s FROM u GROUP BY ALL)
SELECT face, class FROM n QUALIFY row_number() OVER (PARTITION BY face ORDER BY s DESC, class) = 1""")
def vote_invdist(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The weights are summed as decimals, which is exact in any order.
    votes = _votes(spark, sf_dir).withColumn("q", (vote.inverse_distance(_votes(spark, sf_dir), ["face"], "w") * 1000000).cast("decimal(28,0)"))
    return vote.weighted(votes, ["face"], "class", F.col("q"))


WON = """n AS (SELECT face, class, sum(w) AS s FROM v GROUP BY ALL),
won AS (SELECT face, class AS won FROM n QUALIFY row_number() OVER (PARTITION BY face ORDER BY s DESC, class) = 1)"""


def _members(votes: DataFrame) -> DataFrame:
    return votes.groupBy("inst", "face").agg(F.min("class").alias("class"))


def _survival(spark: SparkSession, sf_dir: str, share: float) -> DataFrame:
    votes = _votes(spark, sf_dir)
    winners = vote.weighted(votes, ["face"], "class", F.col("w"))
    return vote.survivors(_members(votes), winners, ["face"], ["inst"], "class", share)


SURVIVE = f"""WITH {V}, {WON}, m AS (SELECT inst, face, min(class) AS class FROM v GROUP BY ALL)
SELECT inst, avg(CASE WHEN won = class THEN 1.0 ELSE 0.0 END) AS agreement FROM m JOIN won USING (face) GROUP BY inst HAVING agreement >= """


@query(SURVIVE + "0.5")
def instance_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survival(spark, sf_dir, 0.5)


@query(SURVIVE + "0.65")
def instance_survival_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survival(spark, sf_dir, 0.65)


@query(f"""WITH {V}, v0 AS (SELECT face, class - 1 AS class, CASE WHEN class = 1 THEN 0 ELSE inst END AS i, w FROM v),
s1 AS (SELECT face, class, sum(w) AS s FROM v0 GROUP BY ALL),
r1 AS (SELECT face, class AS won FROM s1 QUALIFY row_number() OVER (PARTITION BY face ORDER BY s DESC, class) = 1),
lab AS (SELECT i, class AS lab FROM v0 QUALIFY row_number() OVER (PARTITION BY i ORDER BY face, class) = 1),
m AS (SELECT DISTINCT i, face, lab FROM v0 JOIN lab USING (i)),
kept AS (SELECT i FROM m JOIN r1 USING (face) GROUP BY i HAVING avg(CASE WHEN won = lab THEN 1.0 ELSE 0.0 END) >= 0.65),
s3 AS (SELECT face, class, sum(w) AS s FROM v0 WHERE i IN (SELECT i FROM kept) GROUP BY ALL)
SELECT face, class FROM s3 QUALIFY row_number() OVER (PARTITION BY face ORDER BY s DESC, class) = 1""")
def three_round_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = _votes(spark, sf_dir).withColumn("class", F.col("class") - 1)
    return vote.three_rounds(votes, "face", "inst", "class", "w", 0.65)


@query(f"""WITH {V}, {WON}, f AS (SELECT face, inst, count(*) AS k FROM v JOIN won USING (face) WHERE class = won AND inst <> 0 GROUP BY ALL)
SELECT face, inst FROM f QUALIFY row_number() OVER (PARTITION BY face ORDER BY k DESC, inst) = 1""")
def face_instance_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = _votes(spark, sf_dir)
    return vote.face_instance(votes, vote.weighted(votes, ["face"], "class", F.col("w")), ["face"], "inst", "class")


@query("""WITH det AS (SELECT DISTINCT l_suppkey AS pano, l_orderkey % 50 AS frame, l_orderkey AS det FROM lineitem),
n AS (SELECT pano, frame, count(*) AS n FROM det GROUP BY ALL),
cover AS (SELECT DISTINCT l_suppkey AS pano, l_orderkey % 50 AS frame, l_partkey % 40 AS r, l_linenumber AS c FROM lineitem),
hit AS (SELECT l_suppkey AS pano, l_orderkey % 50 AS frame, l_partkey % 40 AS r, l_linenumber AS c, count(DISTINCT l_orderkey) AS hits FROM lineitem WHERE l_quantity > 25 GROUP BY ALL)
SELECT pano, r, c, round(sum((n - coalesce(hits, 0)) * 0.65 / n), 6) + 0.0 AS score
FROM cover JOIN n USING (pano, frame) LEFT JOIN hit USING (pano, frame, r, c) GROUP BY ALL""")
def background_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("pano"), (F.col("l_orderkey") % 50).alias("frame"), F.col("l_orderkey").alias("det"), (F.col("l_partkey") % 40).alias("r"), F.col("l_linenumber").alias("c"), "l_quantity",
    )
    cover, hits = rows.select("pano", "frame", "r", "c").distinct(), rows.where("l_quantity > 25").select("pano", "frame", "r", "c", "det").distinct()
    scores = vote.background_scores(cover, hits, rows.select("pano", "frame", "det").distinct())
    return scores.withColumn("score", _round(F.col("score")))


# --- joins -------------------------------------------------------------------------------------


def _overlap(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    objects = _read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("object_id"), F.col("l_orderkey").alias("face_id"))
    orders, customers = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "customer")
    rooms = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("room_id"), F.col("o_orderkey").alias("face_id"))
    return objects, rooms


OVERLAP = """o AS (SELECT DISTINCT l_suppkey AS object_id, l_orderkey AS face_id FROM lineitem),
r AS (SELECT DISTINCT c_nationkey AS room_id, o_orderkey AS face_id FROM orders JOIN customer ON o_custkey = c_custkey),
n AS (SELECT object_id, room_id, count(*) AS overlap FROM o JOIN r USING (face_id) GROUP BY ALL),
best AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY overlap DESC, room_id) = 1),
parents AS (SELECT object_id, room_id, overlap FROM (SELECT DISTINCT object_id FROM o) LEFT JOIN best USING (object_id))"""


@query(f"WITH {OVERLAP} SELECT * FROM parents")
def overlap_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.object_room(*_overlap(spark, sf_dir))


@query(f"WITH {OVERLAP} SELECT room_id, count(*) AS num_objects FROM parents GROUP BY room_id")
def room_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.children(relations.object_room(*_overlap(spark, sf_dir)), "room_id", "num_objects")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return room_objects(spark, sf_dir)


CENTROIDS = f"{P}, cams AS (SELECT label AS camera_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p GROUP BY label)"


def _cameras(points: DataFrame) -> DataFrame:
    return points.groupBy(F.col("label").alias("camera_id")).agg(*[F.avg(a).alias(a) for a in "xyz"])


@query(f"""WITH {CENTROIDS}, d AS (SELECT camera_id, vec_id % 7 AS room_id, min(sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) + (p.z - c.z) * (p.z - c.z))) AS d FROM p, cams c GROUP BY ALL)
SELECT camera_id, room_id FROM d QUALIFY row_number() OVER (PARTITION BY camera_id ORDER BY d, room_id DESC) = 1""")
def nearest_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    voxels = points.select((F.col("vec_id") % 7).alias("room_id"), *[F.col(a).alias(f"c{a}") for a in "xyz"])
    return relations.camera_room(_cameras(points), voxels).select("camera_id", "room_id")


@query(f"""WITH {CENTROIDS} SELECT vec_id, camera_id, round(sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) + (p.z - c.z) * (p.z - c.z)), 6) AS distance FROM p, cams c""")
def face_camera_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    cams = _cameras(points).select("camera_id", *[F.col(a).alias(f"c{a}") for a in "xyz"])
    d = g.norm(g.minus(g.vector("x", "y", "z"), g.vector("cx", "cy", "cz")))
    return joins.all_distances(points, cams, _round(d), ["vec_id", "camera_id"])


@query(f"""WITH {P}, d AS (SELECT a.vec_id, b.vec_id AS neighbour, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM p a, p b)
SELECT vec_id, neighbour, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour) AS rank FROM d QUALIFY rank <= 5""")
def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    near = joins.knn(points, points.withColumnRenamed("vec_id", "neighbour"), "vec_id", "neighbour", ("x", "y", "z"), 5)
    return near.select("vec_id", "neighbour", F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {P} SELECT a.vec_id AS a, b.vec_id AS b, a.label FROM p a JOIN p b ON a.label = b.label AND a.vec_id < b.vec_id
WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.05 * 0.05""")
def radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.radius_join(_points(spark, sf_dir), "vec_id", ("x", "y", "z"), 0.05, on=("label",)).select("a", "b", "label")


@query(f"""WITH {P}, k AS (SELECT vec_id, CAST(trunc(x * 10) AS BIGINT) AS kx, CAST(trunc(y * 10) AS BIGINT) AS ky, CAST(trunc(z * 10) AS BIGINT) AS kz FROM p)
SELECT a.vec_id AS vec_id, b.vec_id AS other FROM k a JOIN k b USING (kx, ky, kz)""")
def trunc_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir).drop("label")
    return joins.truncated_join(points, points.withColumnRenamed("vec_id", "other"), scale=10).select("vec_id", "other")


@query(f"""WITH {P}, m AS (SELECT max(vec_id) AS m FROM p), f AS (SELECT vec_id AS face_id, unnest([vec_id, vec_id + 1, vec_id + 2]) AS v FROM p, m WHERE vec_id + 2 <= m)
SELECT face_id FROM f JOIN p ON v = p.vec_id AND p.x > 0 GROUP BY face_id HAVING count(DISTINCT v) = 3""")
def three_of_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return joins.complete_faces(_strip(points), points.where("x > 0").select(F.col("vec_id").alias("vertex_id")))


def _strip(points: DataFrame) -> DataFrame:
    """Faces (n, n + 1, n + 2) over consecutive points."""
    last = points.agg(F.max("vec_id").alias("m"))
    return points.join(F.broadcast(last), F.col("vec_id") + 2 <= F.col("m")).select(F.col("vec_id").alias("face_id"), *[(F.col("vec_id") + k).alias(f"v{k}") for k in range(3)])


@query("""SELECT a.l_partkey AS a, b.l_partkey AS b, count(DISTINCT a.l_orderkey) AS shared FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL""")
def cooccurrence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.cooccurrence(_meeting(spark, sf_dir), "part", ["face"])


def _meeting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("face"))


@query("""SELECT p_partkey, p_size FROM part WHERE p_size IN (SELECT 1 UNION SELECT unnest(range(40, 51)))""")
def class_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(1,), *((k,) for k in range(40, 51))], "p_size int")
    return _read(spark, sf_dir, "part").select("p_partkey", "p_size").join(F.broadcast(known), "p_size", "left_semi").select("p_partkey", "p_size")


@query("""SELECT p_partkey, CAST(p_size AS INTEGER) AS class FROM part WHERE p_size NOT IN (1, 5, 6, 7, 8, 10, 11, 12, 13, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 0)""")
def indoor_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.indoor(_read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("class"))).select("p_partkey", "class")


@query("""SELECT l_orderkey, l_linenumber, coalesce(new, l_suppkey) AS l_suppkey FROM lineitem LEFT JOIN (SELECT s_suppkey AS old, s_suppkey + 100000 AS new FROM supplier WHERE s_suppkey % 3 = 0) ON l_suppkey = old""")
def id_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = _read(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("old"), (F.col("s_suppkey") + 100000).alias("new"))
    return aggregate.remap(_read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), mapping, "l_suppkey")


# --- graph -------------------------------------------------------------------------------------


# Labels fall along edges, a row for each part: a recursion over pairs would reach every pair of the one large component.
@query("""WITH RECURSIVE n AS (SELECT DISTINCT l_partkey AS part, l_orderkey AS face FROM lineitem), low AS (SELECT face, min(part) AS m FROM n GROUP BY face),
e AS (SELECT part AS a, m AS b FROM n JOIN low USING (face) UNION SELECT m, part FROM n JOIN low USING (face)),
cc(part, component) USING KEY (part) AS (SELECT DISTINCT part, part AS component FROM n UNION
  (SELECT e.b AS part, min(c.component) AS component FROM cc c JOIN e ON e.a = c.part JOIN recurring.cc r ON r.part = e.b WHERE c.component < r.component GROUP BY e.b))
SELECT part, component FROM cc""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.instance_clusters(_meeting(spark, sf_dir), "part", ["face"])


@query(f"""WITH RECURSIVE {P}, e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.05 * 0.05),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
SELECT a AS node, min(b) AS component FROM reach GROUP BY a""")
def dbscan2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.density_clusters(_points(spark, sf_dir), "vec_id", ("x", "y", "z"), 0.05, on=("label",))


# --- extents and voxels ------------------------------------------------------------------------


@query(f"""WITH {P} SELECT label, min(x) AS min_x, max(x) AS max_x, round(min(x) + (max(x) - min(x)) / 2, 6) + 0.0 AS location_x, round(max(x) - min(x), 6) AS size_x,
round(min(y) + (max(y) - min(y)) / 2, 6) + 0.0 AS location_y, round(max(y) - min(y), 6) AS size_y, round(min(z) + (max(z) - min(z)) / 2, 6) + 0.0 AS location_z, round(max(z) - min(z), 6) AS size_z FROM p GROUP BY label""")
def bbox_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = aggregate.bounding_box(_points(spark, sf_dir), ["label"])
    return box.select("label", "min_x", "max_x", *[_round(F.col(f"{n}_{a}")).alias(f"{n}_{a}") for a in "xyz" for n in ("location", "size")])


GRID = f"""{P}, b AS (SELECT label, min(x) AS ax, max(x) - min(x) AS sx, min(y) AS ay, max(y) - min(y) AS sy, min(z) AS az, max(z) - min(z) AS sz FROM p GROUP BY label),
grid AS (SELECT label, CAST(ceil(sx / 0.1) AS BIGINT) AS rx, CAST(ceil(sy / 0.1) AS BIGINT) AS ry, CAST(ceil(sz / 0.1) AS BIGINT) AS rz,
  ax + sx / 2 - ceil(sx / 0.1) * 0.1 / 2 AS gx, ay + sy / 2 - ceil(sy / 0.1) * 0.1 / 2 AS gy, az + sz / 2 - ceil(sz / 0.1) * 0.1 / 2 AS gz FROM b)"""


@query(f"""WITH {GRID}, i AS (SELECT *, unnest(range(rx)) AS i FROM grid), j AS (SELECT *, unnest(range(ry)) AS j FROM i), k AS (SELECT *, unnest(range(rz)) AS k FROM j)
SELECT label, (i * ry + j) * rz + k AS idx, round(gx + (i + 0.5) * 0.1, 6) + 0.0 AS cx, round(gy + (j + 0.5) * 0.1, 6) + 0.0 AS cy, round(gz + (k + 0.5) * 0.1, 6) + 0.0 AS cz FROM k""")
def voxel_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres = aggregate.voxel_centres(aggregate.voxel_grid(_points(spark, sf_dir), ["label"], 0.1), 0.1)
    return centres.select("label", "idx", *[_round(F.col(f"c{a}")).alias(f"c{a}") for a in "xyz"])


@query(f"""WITH {GRID}, c AS (SELECT p.label, floor((x - gx) / 0.1) AS i, floor((y - gy) / 0.1) AS j, floor((z - gz) / 0.1) AS k, rx, ry, rz FROM p JOIN grid USING (label))
SELECT DISTINCT label, CAST((i * ry + j) * rz + k AS BIGINT) AS idx FROM c WHERE i >= 0 AND j >= 0 AND k >= 0 AND i < rx AND j < ry AND k < rz""")
def voxel_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return aggregate.voxel_occupancy(points, aggregate.voxel_grid(points, ["label"], 0.1), ["label"], ["label"], 0.1)


def _cornered(points: DataFrame) -> DataFrame:
    faces = _strip(points)
    for k, n in enumerate("abc"):
        faces = faces.join(points.select(F.col("vec_id").alias(f"v{k}"), *[F.col(a).alias(f"{n}{a}") for a in "xyz"]), f"v{k}")
    return faces


CORNERS = f"""{P}, f AS (SELECT a.vec_id AS face_id, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz
FROM p a JOIN p b ON b.vec_id = a.vec_id + 1 JOIN p c ON c.vec_id = a.vec_id + 2)"""


@query(f"""WITH {CORNERS}, n AS (SELECT face_id, (by_ - ay) * (cz - az) - (bz - az) * (cy - ay) AS nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ny, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS nz FROM f)
SELECT face_id % 10 AS part, round(sum(sqrt(nx * nx + ny * ny + nz * nz) / 2), 6) AS surface_coverage FROM n GROUP BY ALL""")
def surface_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = _cornered(_points(spark, sf_dir)).withColumn("part", F.col("face_id") % 10)
    out = aggregate.surface(faces, ["part"], tuple(tuple(F.col(f"{n}{a}") for a in "xyz") for n in "abc"))
    return out.withColumn("surface_coverage", _round(F.col("surface_coverage")))


@query(f"""WITH {CORNERS} SELECT face_id, round((least(ax, bx, cx) + greatest(ax, bx, cx)) / 2, 6) + 0.0 AS mx, round((least(ay, by_, cy) + greatest(ay, by_, cy)) / 2, 6) + 0.0 AS my, round((least(az, bz, cz) + greatest(az, bz, cz)) / 2, 6) + 0.0 AS mz FROM f""")
def face_midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    middle = g.midpoint(*(tuple(F.col(f"{n}{a}") for a in "xyz") for n in "abc"))
    return _cornered(_points(spark, sf_dir)).select("face_id", *[_round(c).alias(f"m{a}") for c, a in zip(middle, "xyz", strict=True)])


@query(f"""WITH {P}, pair AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM p a JOIN p b ON a.label = b.label AND a.vec_id <> b.vec_id),
edge AS (SELECT label, i, j, any_value(x1) AS x1, any_value(y1) AS y1, any_value(x2) AS x2, any_value(y2) AS y2 FROM pair JOIN p c USING (label)
  WHERE c.vec_id <> i AND c.vec_id <> j GROUP BY label, i, j HAVING min((x2 - x1) * (c.y - y1) - (y2 - y1) * (c.x - x1)) >= 0)
SELECT label, round(sum(x1 * y2 - x2 * y1) / 2, 6) AS floor_area, round(sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))), 6) AS floor_perimeter FROM edge GROUP BY label""")
def hull2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hull.hulls(_points(spark, sf_dir), "label")
    return out.select("label", _round(F.col("floor_area")).alias("floor_area"), _round(F.col("floor_perimeter")).alias("floor_perimeter"))


@query("""SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > CASE l_returnflag WHEN 'A' THEN 50 WHEN 'N' THEN 100 ELSE 0 END""")
def class_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = spark.createDataFrame([("A", 50), ("N", 100)], "class string, min_faces int")
    return aggregate.large_enough(_read(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_returnflag", limits).select("l_suppkey", "l_returnflag", "n")


# --- layers ------------------------------------------------------------------------------------


@query("""SELECT r_regionkey, count(DISTINCT n_nationkey) AS num_rooms, count(DISTINCT c_custkey) AS num_objects FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_regionkey""")
def parent_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rooms, objects = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "customer")
    held = aggregate.children(objects, "c_nationkey", "n")
    per = rooms.join(held, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_regionkey").agg(F.count("*").alias("num_rooms"), F.coalesce(F.sum("n"), F.lit(0)).alias("num_objects"))
    out = _read(spark, sf_dir, "region").join(per, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("r_regionkey", F.coalesce("num_rooms", F.lit(0)).alias("num_rooms"), F.coalesce("num_objects", F.lit(0)).alias("num_objects"))


@query("""SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def elements_in_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    rooms = _read(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return relations.in_room(_read(spark, sf_dir, "customer"), rooms, "c_nationkey").select("c_custkey", "c_nationkey")


@query("""SELECT a.s_suppkey AS a, b.s_suppkey AS b, nullif(a.s_nationkey, 0) IS NOT DISTINCT FROM nullif(b.s_nationkey, 0) AS same_space FROM supplier a JOIN supplier b ON a.s_nationkey % 5 = b.s_nationkey % 5 AND a.s_suppkey <> b.s_suppkey""")
def same_space_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") % 5).alias("building"), F.nullif("s_nationkey", F.lit(0)).alias("parent"))
    pairs = joins.ordered_pairs(rows, "s_suppkey", ["building"], ["parent"])
    return relations.same_space(pairs, "a_parent", "b_parent").select(F.col("a_s_suppkey").alias("a"), F.col("b_s_suppkey").alias("b"), "same_space")


@query(f"""WITH {P}, s AS (SELECT label, max(x) - min(x) AS size_x, max(y) - min(y) AS size_y, CASE WHEN label = 3 THEN 0.0 ELSE max(z) - min(z) END AS size_z FROM p GROUP BY label)
SELECT a.label AS a, b.label AS b, round(a.size_x / nullif(b.size_x, 0), 6) AS ratio_size_x, round(a.size_y / nullif(b.size_y, 0), 6) AS ratio_size_y, round(a.size_z / nullif(b.size_z, 0), 6) AS ratio_size_z FROM s a JOIN s b ON a.label <> b.label""")
def relative_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = aggregate.bounding_box(_points(spark, sf_dir), ["label"]).withColumn("size_z", F.when(F.col("label") == 3, 0.0).otherwise(F.col("size_z")))
    measures = ["size_x", "size_y", "size_z"]
    pairs = relations.relative_magnitude(joins.ordered_pairs(box, "label", [], measures), measures)
    return pairs.select(F.col("a_label").alias("a"), F.col("b_label").alias("b"), *[_round(F.col(f"ratio_{m}")).alias(f"ratio_{m}") for m in measures])


CAMERA = (0.9, -0.7, 0.3)  # a camera without rotation: its plane is y = const in its own frame


@query(f"""WITH {P}, near AS (SELECT label, x, y, z, abs(y + 0.0 - 0.7) AS d FROM p QUALIFY row_number() OVER (PARTITION BY label ORDER BY abs(y + 0.0 - 0.7), x, y, z) = 1),
o AS (SELECT label, min(z) AS low, min(x) + (max(x) - min(x)) / 2 AS lx, min(y) + (max(y) - min(y)) / 2 AS ly FROM p GROUP BY label),
t AS (SELECT o.label, low, lx, ly, x, y, z, d FROM o JOIN near USING (label)),
pr AS (SELECT a.label AS a, b.label AS b, abs(a.x - b.x) < 0.1 OR abs(a.y - b.y) < 0.1 OR abs(a.z - b.z) < 0.1 AS close, a.d AS d1, b.d AS d2, a.low AS low1, b.low AS low2,
  (a.lx - 0.9) * (b.ly + 0.7) - (a.ly + 0.7) * (b.lx - 0.9) AS turn FROM t a JOIN t b ON a.label <> b.label)
SELECT a, b, CASE WHEN NOT close THEN CASE WHEN d1 < d2 THEN 'behind' ELSE 'in front' END END AS depth, CASE WHEN NOT close THEN CASE WHEN low2 < low1 THEN 'bottom' ELSE 'top' END END AS vertical,
  CASE WHEN NOT close THEN CASE WHEN turn > 0 THEN 'left' ELSE 'right' END END AS lateral FROM pr""")
def spatial_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir).withColumnRenamed("label", "object_id")
    objects = aggregate.bounding_box(points, ["object_id"])
    cameras = spark.createDataFrame([(1, *CAMERA, 0.0, 0.0, 0.0)], "camera_id int, x double, y double, z double, rx double, ry double, rz double")
    return relations.spatial_order(points, objects, cameras).select("a", "b", "depth", "vertical", "lateral")


HITS = """h AS (SELECT l_orderkey AS ray, l_suppkey AS obj, (l_linenumber * 10000000 + l_partkey) * 100000 + l_suppkey AS at_ FROM lineitem)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("l_linenumber").cast("bigint") * 10000000 + F.col("l_partkey")) * 100000 + F.col("l_suppkey")
    return _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ray"), F.col("l_suppkey").alias("obj"), at.alias("at"))


@query(f"""WITH {HITS.replace('l_linenumber *', 'CAST(l_linenumber AS BIGINT) *')}, f AS (SELECT ray, obj, min(at_) AS t FROM h GROUP BY ALL),
v AS (SELECT a.obj AS a, b.obj AS b, a.t < b.t AS first FROM f a JOIN f b ON a.ray = b.ray AND a.obj <> b.obj)
SELECT a, b, CASE WHEN 2 * sum(CASE WHEN first THEN 1 ELSE 0 END) > count(*) THEN 'occluding' ELSE 'occluded' END AS relation FROM v GROUP BY a, b""")
def occlusion_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.occlusion(_hits(spark, sf_dir), "ray", "obj", F.col("at"))


# --- raster ------------------------------------------------------------------------------------


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raster(spark, sf_dir).where("size >= 10").select("r", "c")


def _raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 50).alias("r"), (F.col("p_partkey") % 50).alias("c"), F.col("p_size").alias("size"))


R = "m AS (SELECT p_partkey // 50 AS r, p_partkey % 50 AS c FROM part WHERE p_size >= 10), s AS (SELECT unnest([-1, 0, 1]) AS d)"
ERODED = "e AS (SELECT m.r - a.d AS r, m.c - b.d AS c FROM m, s a, s b GROUP BY ALL HAVING count(*) = 9)"


@query(f"WITH {R}, {ERODED} SELECT r, c FROM e")
def erode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.erode(_mask(spark, sf_dir), [], 3)


@query(f"WITH {R} SELECT DISTINCT m.r + a.d AS r, m.c + b.d AS c FROM m, s a, s b")
def dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.dilate(_mask(spark, sf_dir), [], 3)


@query(f"WITH {R}, {ERODED} SELECT DISTINCT e.r + a.d AS r, e.c + b.d AS c FROM e, s a, s b")
def opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.opened(_mask(spark, sf_dir), [], 3)


@query("""WITH m AS (SELECT p_partkey // 50 AS r, p_partkey % 50 AS c, p_size AS size FROM part), s AS (SELECT unnest(range(4)) AS d) SELECT m.r * 4 + a.d AS r, m.c * 4 + b.d AS c, size FROM m, s a, s b""")
def resize_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.enlarge(_raster(spark, sf_dir), 4).select("r", "c", "size")


@query("""SELECT p_partkey // 50 AS r, 49 - p_partkey % 50 AS c FROM part WHERE p_size >= 10""")
def mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.mirror(_mask(spark, sf_dir), 50).select("r", "c")


@query("""WITH m AS (SELECT p_partkey // 50 AS r, p_partkey % 50 AS c, CASE WHEN p_size >= 10 THEN p_size END AS size FROM part)
SELECT r, c, size FROM m WHERE size IS NOT NULL UNION ALL
SELECT a.r, a.c, first(b.size ORDER BY (a.r - b.r) ** 2 + (a.c - b.c) ** 2, b.r, b.c) FROM m a, m b WHERE a.size IS NULL AND b.size IS NOT NULL AND abs(a.r - b.r) < 12 AND abs(a.c - b.c) < 12 GROUP BY a.r, a.c""")
def nearest_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = _raster(spark, sf_dir).withColumn("size", F.when(F.col("size") >= 10, F.col("size")))
    return joins.nearest_fill(pixels, "size", []).select("r", "c", "size")


# --- geometry ----------------------------------------------------------------------------------


@query(f"""WITH {P}, u AS (SELECT vec_id, x / sqrt(x * x + y * y + z * z) AS a, z / sqrt(x * x + y * y + z * z) AS b, y / sqrt(x * x + y * y + z * z) AS c FROM p),
t AS (SELECT vec_id, a, b, c, -asin(b) AS down FROM u), w AS (SELECT *, acos(greatest(-1.0, least(1.0, c / cos(down)))) AS around FROM t),
q AS (SELECT vec_id, down, CASE WHEN sin(around) * cos(down) * a < 0 THEN -around ELSE around END AS around FROM w)
SELECT vec_id, CAST(trunc(down * (1024 / pi())) + 512 AS INTEGER) AS r, CAST(trunc(around * (2048 / (2 * pi()))) + 1024 AS INTEGER) AS c FROM q""")
def project_equirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, c = g.equirect_pixel(g.vector("x", "y", "z"), 1024, 2048)
    return _points(spark, sf_dir).select("vec_id", r.alias("r"), c.alias("c"))


@query(f"""WITH {P}, q AS (SELECT vec_id, trunc(x * 256.0 / tan(0.5) / (z - 1) + 256.0) AS px, trunc(y * 256.0 / tan(0.5) / (z - 1) + 256.0) AS py, z - 1 < 0 AS ahead FROM p)
SELECT vec_id, CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py, px >= 0 AND px < 512 AND py >= 0 AND py < 512 AND ahead AS inside FROM q""")
def project_pinhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, inside = g.pinhole_pixel((F.col("x"), F.col("y"), F.col("z") - 1), F.lit(1.0), 512, 512)
    return _points(spark, sf_dir).select("vec_id", x.alias("px"), y.alias("py"), inside.alias("inside"))


QUATERNION = f"""{P}, q AS (SELECT vec_id, x + 1 AS w, x, y, z, (x + 1) * (x + 1) + x * x + y * y + z * z AS n FROM p)"""


@query(f"""WITH {QUATERNION} SELECT vec_id, round(1 - 2 * (y * y + z * z) / n, 6) + 0.0 AS m00, round(2 * (x * y - z * w) / n, 6) + 0.0 AS m01, round(2 * (x * z + y * w) / n, 6) + 0.0 AS m02, round(2 * (y * z + x * w) / n, 6) + 0.0 AS m21 FROM q""")
def quat_to_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = g.quaternion_matrix(F.col("x") + 1, F.col("x"), F.col("y"), F.col("z"))
    return _points(spark, sf_dir).select("vec_id", *[_round(m[i][j]).alias(f"m{i}{j}") for i, j in ((0, 0), (0, 1), (0, 2), (2, 1))])


@query(f"""WITH {QUATERNION} SELECT vec_id, round(atan2(2 * (y * z + x * w) / n, 1 - 2 * (x * x + y * y) / n), 6) + 0.0 AS ax,
round(atan2(-2 * (x * z - y * w) / n, sqrt((1 - 2 * (y * y + z * z) / n) ** 2 + (2 * (x * y + z * w) / n) ** 2)), 6) + 0.0 AS ay, round(atan2(2 * (x * y + z * w) / n, 1 - 2 * (y * y + z * z) / n), 6) + 0.0 AS az FROM q""")
def euler_sxyz(spark: SparkSession, sf_dir: str) -> DataFrame:
    angles = g.euler_angles(g.quaternion_matrix(F.col("x") + 1, F.col("x"), F.col("y"), F.col("z")))
    return _points(spark, sf_dir).select("vec_id", *[_round(a).alias(n) for a, n in zip(angles, ("ax", "ay", "az"), strict=True)])


@query(f"""WITH {P} SELECT a.vec_id, round(-degrees(asin((a.x * b.y - a.y * b.x) / (sqrt(a.x * a.x + a.y * a.y) * sqrt(b.x * b.x + b.y * b.y)))), 6) + 0.0 AS angle FROM p a JOIN p b ON b.vec_id = a.vec_id + 1""")
def clockwise_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = _cornered_pairs(_points(spark, sf_dir))
    return faces.select("vec_id", _round(g.clockwise_angle((F.col("x"), F.col("y")), (F.col("bx"), F.col("by")))).alias("angle"))


def _cornered_pairs(points: DataFrame) -> DataFrame:
    return points.join(points.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("bx"), F.col("y").alias("by")), "vec_id")


@query("""SELECT p_partkey, p_size * 1000 * (128.0 / 65536) AS depth FROM part""")
def mist_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select("p_partkey", g.depth(F.col("p_size") * 1000).alias("depth"))


@query("""SELECT CAST(fov AS INTEGER) AS fov, CAST(theta AS INTEGER) AS theta, CAST(phi AS INTEGER) AS phi, 800 AS size FROM (SELECT unnest([75, 90, 105]) AS fov), (SELECT unnest(range(-180, 181, 15)) AS theta), (SELECT unnest([-15, 0, 15]) AS phi)""")
def view_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.view_parameters(spark)


@query("""WITH f AS (SELECT CAST(fr AS INTEGER) AS fr, CAST(fc AS INTEGER) AS fc, radians(theta) AS t, radians(-phi) AS p, theta, phi, 1.0 AS x, (fc / 7.0 * 2 - 1) * tan(radians(90.0 / 2)) AS y, -(fr / 7.0 * 2 - 1) * tan(radians(90.0 / 2)) AS z
  FROM (SELECT unnest(range(8)) AS fr), (SELECT unnest(range(8)) AS fc), (SELECT unnest([-45, 0, 45, 90]) AS theta), (SELECT unnest([-15, 0, 15]) AS phi)),
a AS (SELECT *, cos(t) * x - sin(t) * y AS x1, sin(t) * x + cos(t) * y AS y1 FROM f),
b AS (SELECT *, -sin(t) AS ux, cos(t) AS uy FROM a),
d AS (SELECT *, ux * x1 + uy * y1 AS k, uy * z AS cx, -ux * z AS cy, ux * y1 - uy * x1 AS cz FROM b),
r AS (SELECT fr, fc, theta, phi, x1 * cos(p) + cx * sin(p) + ux * k * (1 - cos(p)) AS x2, y1 * cos(p) + cy * sin(p) + uy * k * (1 - cos(p)) AS y2, z * cos(p) + cz * sin(p) AS z2 FROM d)
SELECT CAST(theta AS INTEGER) AS theta, CAST(phi AS INTEGER) AS phi, fr, fc, CAST(round(degrees(atan2(y2, x2)), 4) AS DOUBLE) + 0.0 AS longitude, round(degrees(asin(z2 / sqrt(x2 * x2 + y2 * y2 + z2 * z2))), 4) + 0.0 AS latitude FROM r""")
def rectilinear_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = spark.createDataFrame([(90, t, p, 8) for t in (-45, 0, 45, 90) for p in (-15, 0, 15)], "fov int, theta int, phi int, size int")
    rays = g.frame_rays(views)
    return rays.select("theta", "phi", "fr", "fc", _round(F.col("longitude"), 4).alias("longitude"), _round(F.col("latitude"), 4).alias("latitude"))


# --- identifiers, attributes, export -----------------------------------------------------------


@query("""SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) * 10 AS id, p_brand || '_' || row_number() OVER (PARTITION BY p_size, p_brand ORDER BY p_partkey) AS name FROM part""")
def instance_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = aggregate.numbered(_read(spark, sf_dir, "part"), ["p_size"], ["p_partkey"], "id", first=10, step=10)
    return aggregate.instance_names(ids, ["p_size"], "p_brand", ["p_partkey"]).select("p_partkey", "p_brand", "id", "name")


@query("""WITH n AS (SELECT CAST(max(l_partkey) + 1 AS BIGINT) AS n FROM lineitem), last AS (SELECT l_partkey AS position, max(l_suppkey) AS id FROM lineitem GROUP BY ALL)
SELECT position, coalesce(id, 0) AS id FROM (SELECT unnest(range(n)) AS position FROM n) LEFT JOIN last USING (position)""")
def densify_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem")
    length = lines.agg((F.max("l_partkey") + 1).alias("n"))
    return aggregate.densify(lines.select(F.col("l_partkey").alias("position"), F.col("l_suppkey").alias("id")), length, [], "position", "id", F.col("id"))


@query("""SELECT l_suppkey, array_to_string(list_sort(list(l_partkey)), ',') AS faces FROM lineitem GROUP BY l_suppkey""")
def group_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = aggregate.listed(_read(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_partkey")
    return lists.select("l_suppkey", F.array_join(F.transform("l_partkey", lambda p: p.cast("string")), ",").alias("faces"))


@query("""SELECT model, CAST(p_partkey AS INTEGER) AS instance, class, tactile, CAST(NULL AS VARCHAR) AS visual, material FROM (
SELECT 'm1' AS model, p_partkey, p_brand AS class, p_type AS tactile, p_brand || '/' || p_size AS material FROM part UNION ALL
SELECT 'm2', p_partkey + 1, p_type, p_brand, CAST(p_size AS VARCHAR) FROM part)""")
def unpivot_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(
        *[F.col(c).cast("string") for c in ("p_partkey", "p_brand", "p_type")], F.lit(""), F.col("p_brand"), F.col("p_size").cast("string"),
        (F.col("p_partkey") + 1).cast("string"), F.col("p_type"), F.col("p_brand"), F.lit(""), F.lit(""), F.col("p_size").cast("string"),
    )
    rows = _read(spark, sf_dir, "part").select((F.col("p_partkey") + 2).cast("int").alias("line"), F.array_join(cells, ",").alias("text"))
    heads = spark.createDataFrame([(0, "m1,,,,,,m2,,,,,"), (1, ",".join(["instance,class,tactile,visual,m1,m2"] * 2))], "line int, text string")
    out = readers.object_attributes(heads.unionByName(rows.withColumn("line", F.col("line") + 1)))
    return out.select("model", "instance", "class", F.col("tactile_texture").alias("tactile"), F.col("visual_texture").alias("visual"), F.array_join("material", "/").alias("material"))


@query("""SELECT p_brand AS class, string_agg(p_type, '|' ORDER BY p_type) AS actions FROM (SELECT DISTINCT p_brand, p_type FROM part) GROUP BY p_brand""")
def affordance_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "part").select(F.concat(F.col("p_brand"), F.lit(", "), F.col("p_type"), F.lit(",,")).alias("text")).distinct()
    out = readers.affordances(lines)
    return out.select("class", F.array_join(F.array_sort("actions"), "|").alias("actions"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_name END AS scene_category, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE CAST(n_regionkey AS VARCHAR) END AS floor_number FROM nation""")
def filename_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.col("n_name"), F.when(F.col("n_nationkey") % 4 == 0, "-").otherwise("__"), F.col("n_regionkey"), F.lit("_"), F.col("n_nationkey"), F.lit(".obj"))
    return readers.room_attributes(_read(spark, sf_dir, "nation").withColumn("file_name", name)).select("n_nationkey", "scene_category", "floor_number")


@query("""WITH m AS (SELECT n_name AS name, (n_nationkey * 10) % 256 AS r, (n_nationkey * 20) % 256 AS g, (n_nationkey * 30) % 256 AS b, row_number() OVER (ORDER BY n_name) - 1 AS k FROM nation)
SELECT k * 8 + i AS line_no, CASE i WHEN 0 THEN 'newmtl ' || name WHEN 1 THEN printf('Ka %.8f %.8f %.8f', r / 255.0, g / 255.0, b / 255.0) WHEN 2 THEN printf('Kd %.8f %.8f %.8f', r / 255.0, g / 255.0, b / 255.0)
WHEN 3 THEN 'Ks 0.00000000 0.00000000 0.00000000' WHEN 4 THEN 'd 0.75000000' WHEN 5 THEN 'Ns 200.00000000' WHEN 6 THEN 'illum 2' ELSE '' END AS text FROM m, (SELECT unnest(range(8)) AS i)""")
def mtl_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    colours = {c: (F.col("n_nationkey") * k) % 256 for c, k in (("r", 10), ("g", 20), ("b", 30))}
    return export.mtl_lines(_read(spark, sf_dir, "nation").withColumnRenamed("n_name", "name").withColumns(colours))


@query(f"""WITH {P}, m AS (SELECT max(vec_id) AS m FROM p), f AS (SELECT vec_id AS id FROM p, m WHERE vec_id + 2 <= m),
n AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'background' ELSE 'room_' || (id % 4) END AS mat FROM f)
SELECT printf('v %.8f %.8f %.8f', x, y, z) AS text, count(*) AS n FROM p GROUP BY 1 UNION ALL SELECT 'usemtl ' || mat, 1 FROM (SELECT mat FROM n UNION SELECT 'background') UNION ALL SELECT 'f ' || (id + 1) || ' ' || (id + 2) || ' ' || (id + 3), 1 FROM n
UNION ALL SELECT unnest(['mtllib mesh.mtl', 'g Mesh']), 1""")
def obj_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a whole coloured mesh file, written and read back."""
    from orrery.staging import Stages

    points = _points(spark, sf_dir)
    faces = _strip(points)
    labels = faces.where("face_id % 3 <> 0").select("face_id", F.concat(F.lit("room_"), F.col("face_id") % 4).alias("material"))
    path = f"{Stages(spark, 'obj').root}/mesh.obj"
    export.write_obj(export.obj_lines(points.withColumnRenamed("vec_id", "vertex_id"), faces, labels, library="mesh.mtl"), path)
    return spark.read.text(path).groupBy(F.col("value").alias("text")).agg(F.count("*").alias("n"))


# --- arbitration and filling -------------------------------------------------------------------


@query(f"""WITH {P}, d AS (SELECT a.vec_id, b.vec_id AS o, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), b.vec_id) AS k FROM p a, p b WHERE a.vec_id % 7 = 0),
n AS (SELECT vec_id, label, count(*) AS n FROM d WHERE k <= 10 AND o % 7 <> 0 GROUP BY ALL)
SELECT vec_id, label + 1 AS inst FROM p WHERE vec_id % 7 <> 0 UNION ALL
SELECT vec_id, label + 1 FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) = 1)""")
def fill_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir).withColumn("building", F.lit(1))
    hidden = F.col("vec_id") % 7 == 0
    inst = F.when(hidden, -1).otherwise(F.col("label") + 1)
    faces = points.select("building", "vec_id", F.when(hidden, -1).otherwise(1).alias("class"), inst.alias("inst"))
    filled = fusion.fill(faces, points.select("building", "vec_id", "x", "y", "z"), 10, face="vec_id")
    return filled.where("inst <> -1").select("vec_id", "inst")


@query("""SELECT c_nationkey AS room_id, c_custkey AS object_id, c_mktsegment AS class FROM customer WHERE c_custkey % 2 = 0""")
def graph_export_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.staging import Stages

    objects = _read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("room_id"), F.col("c_custkey").alias("object_id"), F.col("c_mktsegment").alias("class"))
    objects = objects.withColumn("face_ids", F.when(F.col("object_id") % 2 == 0, F.array("object_id")).otherwise(F.array().cast("array<bigint>")))
    root = Stages(spark, "graph").root
    export.write_graph({"object": objects}, root)
    return export.read_graph(spark, root, views=False)["object"].drop("face_ids")
