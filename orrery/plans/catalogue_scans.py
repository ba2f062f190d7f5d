"""Queries over files that tasks write and read back, dense arrays, and whole plans."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import geometry as g
from orrery.functions import vocabulary
from orrery.operators import aggregate, raster
from orrery.plans import fusion, layers, pano
from orrery.plans.catalogue import P, _points, _raster, _read, _round, _strip, query
from orrery.plans.catalogue_more import DETECTED, _detections, _folder
from orrery.sources import dense, export, image_sink, mesh, png, readers

# --- files -------------------------------------------------------------------------------------

COLOURED = "m AS (SELECT p_size % 4 AS pano, p_partkey // 50 AS r, p_partkey % 50 AS c, p_size % 7 AS label FROM part), h AS (SELECT CAST(max(r) + 1 AS BIGINT) AS h FROM m)"


@query(f"""WITH {COLOURED}, px AS (SELECT pano, unnest(range(h)) AS r FROM (SELECT DISTINCT pano FROM m), h), grid AS (SELECT pano, r, unnest(range(50)) AS c FROM px)
SELECT 'p' || grid.pano AS image, CAST(grid.r AS INTEGER) AS r, CAST(grid.c AS INTEGER) AS c, CAST(coalesce(label * 30, 0) AS INTEGER) AS red, CAST(coalesce(200 - label, 0) AS INTEGER) AS green, CAST(coalesce(label, 0) AS INTEGER) AS blue FROM grid LEFT JOIN m USING (pano, r, c)""")
def image_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled pixels coloured by a palette, written as an image for each panorama by the tasks, and read back."""
    pixels = _raster(spark, sf_dir).select(F.concat(F.lit("p"), F.col("size") % 4).alias("pano"), "r", "c", (F.col("size") % 7).alias("label"))
    palette = spark.range(7).select(F.col("id").alias("idx"), (F.col("id") * 30).alias("r"), (200 - F.col("id")).alias("g"), F.col("id").alias("b"))
    height = pixels.agg(F.max("r")).first()[0] + 1
    path = f"{_folder(spark, 'images')}/png"
    png.write_images(png.images(png.coloured(pixels, palette, "label"), "pano", height, 50), path, "pano")
    value = F.col("value")
    return png.read_images(spark, f"{path}/*.png").select("image", "r", "c", *[value[k].alias(n) for k, n in enumerate(("red", "green", "blue"))])


@query("""WITH m AS (SELECT DISTINCT p_size % 5 AS object_id, CASE WHEN p_partkey % 3 = 0 THEN 'occ' ELSE 'viz' END AS mask, p_partkey // 50 AS r, p_partkey % 50 AS c FROM part WHERE p_partkey // 50 < 40)
SELECT object_id || '_mask_' || mask AS image, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c FROM m WHERE object_id IN (SELECT object_id FROM m GROUP BY object_id HAVING count(DISTINCT mask) = 2)""")
def mask_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amodal masks written as images and read back; white pixels are the mask."""
    masks = _raster(spark, sf_dir).select((F.col("size") % 5).alias("object_id"), F.when((F.col("r") * 50 + F.col("c")) % 3 == 0, "occ").otherwise("viz").alias("mask"), "r", "c").where("r < 40")
    path = f"{_folder(spark, 'masks')}/png"
    png.write_images(png.mask_images(masks, "object_id", 40, 50), path, "name")
    return png.read_images(spark, f"{path}/*.png").where("value[0] = 255").select("image", "r", "c")


@query("SELECT 's' || s_suppkey AS camera, s_acctbal / 1000.0 AS fov, CAST(s_nationkey AS DOUBLE) AS x, 0.5 AS y, s_acctbal AS z, 1.0 AS rx, CAST(s_suppkey AS DOUBLE) AS ry, 0.25 AS rz FROM supplier")
def frame_pose_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON file for each frame, written by the tasks and read back."""
    text = F.to_json(F.struct(
        (F.col("s_acctbal") / 1000.0).alias("field_of_view_rads"), F.array(F.col("s_nationkey").cast("double"), F.lit(0.5), F.col("s_acctbal")).alias("camera_location"),
        F.array(F.lit(1.0), F.col("s_suppkey").cast("double"), F.lit(0.25)).alias("camera_rotation_final"),
    ))
    path = f"{_folder(spark, 'frames')}/json"
    rows = _read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey"), F.lit("_domain_rgb.json")).alias("name"), F.encode(text, "UTF-8").alias("content"))
    image_sink.save(rows, path)
    return readers.read_frame_poses(spark, f"{path}/*.json")


@query(f"WITH {P}, a AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS position, vec_id, x FROM p) SELECT 'l' || label AS stem, 'ids' AS name, position, CAST(vec_id AS DOUBLE) AS value FROM a UNION ALL SELECT 'l' || label, 'xs', position, round(x, 6) + 0.0 FROM a")
def npz_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive of two arrays for each label, written by the tasks and read back."""
    lists = _points(spark, sf_dir).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", "x"))).alias("v"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        import numpy as np

        for batch in batches:
            for label, ids, xs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = io.BytesIO()
                np.savez(out, ids=np.array(ids), xs=np.array(xs))
                yield pa.RecordBatch.from_pydict({"name": [f"l{label}.npz"], "content": [out.getvalue()]})

    path = f"{_folder(spark, 'archives')}/npz"
    image_sink.save(lists.select("label", "v.vec_id", "v.x").mapInArrow(archive, "name string, content binary"), path)
    stem = F.regexp_extract("file", r"([^/]*)\.npz$", 1).alias("stem")
    return mesh.read_npz(spark, f"{path}/*.npz", ["ids", "xs"]).select(stem, "name", "position", _round(F.col("value")).alias("value"))


@query(f"""WITH {P}, m AS (SELECT max(vec_id) AS m FROM p), f AS (SELECT vec_id AS id FROM p, m WHERE vec_id + 2 <= m),
n AS (SELECT id, 'chair_' || (id % 5) AS mat FROM f WHERE id % 4 <> 0 UNION ALL SELECT id, 'table_' || (id % 7) FROM f WHERE id % 8 = 1 UNION ALL SELECT id, 'background' FROM f WHERE id % 4 = 0)
SELECT 'v' AS kind, printf('v %.8f %.8f %.8f', x, y, z) AS text, count(*) AS n FROM p GROUP BY ALL UNION ALL SELECT 'u', 'usemtl ' || mat, 1 FROM n GROUP BY mat
UNION ALL SELECT 'f', 'f ' || (id + 1) || ' ' || (id + 2) || ' ' || (id + 3), count(*) FROM n GROUP BY id""")
def instance_obj(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mesh coloured by instances, some of which share faces, written as a mesh file and read back."""
    points = _points(spark, sf_dir)
    faces = _strip(points)
    one = faces.where("face_id % 4 <> 0").select("face_id", F.concat(F.lit("chair_"), F.col("face_id") % 5).alias("material"))
    other = faces.where("face_id % 8 = 1").select("face_id", F.concat(F.lit("table_"), F.col("face_id") % 7).alias("material"))
    path = f"{_folder(spark, 'instances')}/obj"
    export.write_obj(export.obj_lines(points.withColumnRenamed("vec_id", "vertex_id"), faces, one.unionByName(other)), path)
    return spark.read.text(path).groupBy(F.substring("value", 1, 1).alias("kind"), F.col("value").alias("text")).agg(F.count("*").alias("n"))


# --- dense arrays ------------------------------------------------------------------------------


ARRAYED = """w AS (SELECT CAST(l_suppkey % 3 AS BIGINT) AS building, l_partkey AS face_id, l_linenumber AS id, l_orderkey AS o FROM lineitem),
n AS (SELECT building, CAST(max(face_id) + 100 AS BIGINT) AS n FROM w GROUP BY building), last AS (SELECT building, face_id, arg_max(id, o * 10 + id) AS id FROM w WHERE id < 7 GROUP BY ALL),
whole AS (SELECT building, unnest(range(n)) AS face_id FROM n)"""


def _arrays(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The graph's object layer and the array of its faces, written and read back."""
    rows = _read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 3).alias("building"), F.col("l_partkey").alias("face_id"), F.col("l_linenumber").cast("bigint").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    length = rows.groupBy("building").agg((F.max("face_id") + 100).alias("n"))
    faces = dense.chunked(rows.where("id < 7"), length, ["building"], "face_id", "id", F.col("o"), chunk=512)
    objects = rows.select("building", "id").distinct()
    root = _folder(spark, "graph")
    export.write_graph({"object": objects}, root, {"object_faces": faces})
    found = export.read_graph(spark, root, views=False)
    return found["object"], found["object_faces"]


@query(f"WITH {ARRAYED} SELECT building, face_id, coalesce(id, 0) AS id FROM whole LEFT JOIN last USING (building, face_id) WHERE face_id >= 40")
def dense_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each face's object as the array has it, from face 40 on."""
    return dense.expanded(_arrays(spark, sf_dir)[1], "face_id", "id", low=40)


@query(f"WITH {ARRAYED}, a AS (SELECT l_orderkey, l_linenumber, CAST(l_suppkey % 3 AS BIGINT) AS building, l_partkey * 2 AS face_id FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN a.face_id < n.n THEN coalesce(id, 0) END AS id FROM a JOIN n USING (building) LEFT JOIN last USING (building, face_id)")
def dense_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object at every order line's face, half of which lie beyond the array."""
    wanted = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 3).alias("building"), (F.col("l_partkey") * 2).alias("face_id"))
    return dense.looked_up(_arrays(spark, sf_dir)[1], wanted, "face_id", "id").select("l_orderkey", "l_linenumber", "id")


@query(f"WITH {ARRAYED} SELECT DISTINCT building, id FROM last")
def dense_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects that have a face in the array; the layer has more."""
    return _arrays(spark, sf_dir)[0]


@query(f"""WITH {P}, v AS (SELECT CAST(floor((x + 2) * 8) AS BIGINT) * 1024 + CAST(floor((y + 2) * 8) AS BIGINT) * 32 + CAST(floor((z + 2) * 8) AS BIGINT) AS idx, label, vec_id FROM p),
last AS (SELECT idx, arg_max(label + 1, vec_id) AS id FROM v GROUP BY idx) SELECT idx, coalesce(id, 0) AS id FROM (SELECT unnest(range(32768)) AS idx) LEFT JOIN last USING (idx)""")
def dense_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The room of every voxel of a grid of 32 x 32 x 32, written and read back."""
    cell = [F.floor((F.col(a) + 2) * 8).cast("bigint") for a in "xyz"]
    points = _points(spark, sf_dir).select((cell[0] * 1024 + cell[1] * 32 + cell[2]).alias("idx"), (F.col("label") + 1).cast("bigint").alias("id"), "vec_id")
    length = points.agg(F.lit(32 * 32 * 32).cast("bigint").alias("n"))
    root = _folder(spark, "grid")
    export.write_graph({}, root, {"room_voxels": dense.chunked(points, length, [], "idx", "id", F.col("vec_id"), chunk=4096)})
    return dense.expanded(export.read_graph(spark, root, views=False)["room_voxels"], "idx", "id")


# --- plans -------------------------------------------------------------------------------------


@query(f"""WITH {DETECTED.replace("l_quantity / 50.0", "l_quantity")},
bg AS (SELECT pano, r, c, 0 AS class, sum((n - coalesce(k, 0)) * 0.65 / n) AS score FROM cover JOIN n USING (pano, frame) LEFT JOIN hn USING (pano, frame, r, c) GROUP BY pano, r, c),
sc AS (SELECT pano, r, c, class, sum(score) AS score FROM hits GROUP BY ALL UNION ALL SELECT pano, r, c, class, score FROM bg),
won AS (SELECT pano, r, c, class AS won FROM sc QUALIFY row_number() OVER (PARTITION BY pano, r, c ORDER BY score DESC, class) = 1),
kept AS (SELECT pano, instance_id FROM hits LEFT JOIN won USING (pano, r, c) GROUP BY pano, instance_id HAVING avg(CASE WHEN won = class THEN 1.0 ELSE 0.0 END) >= 0.5),
best AS (SELECT pano, r, c, arg_max(class, instance_id) AS class FROM hits SEMI JOIN kept USING (pano, instance_id) GROUP BY ALL),
px AS (SELECT won.pano, won.r, won.c, coalesce(best.class, 0) AS class FROM won LEFT JOIN best USING (pano, r, c))
SELECT px.pano, px.r, px.c, CAST(px.class AS INTEGER) AS class, round(coalesce(sc.score, 0.0), 9) + 0.0 AS score FROM px LEFT JOIN sc ON sc.pano = px.pano AND sc.r = px.r AND sc.c = px.c AND sc.class = px.class""")
def pano_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of every panorama voted into labelled pixels; scores are whole numbers, so that ties are ties."""
    found, frames = _detections(spark, sf_dir)
    pixels = pano.aggregate(found.withColumn("score", F.round(F.col("score") * 50)), frames)
    return pixels.select("pano", "r", "c", F.col("class").cast("int").alias("class"), _round(F.col("score"), 9).alias("score"))


@query(None)
def superpixel_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of images of 40 x 50 parts each."""
    parts = _read(spark, sf_dir, "part")
    pixels = parts.select(
        F.expr("p_partkey div 2000").alias("pano"), F.expr("cast(p_partkey % 2000 div 50 as int)").alias("r"), (F.col("p_partkey") % 50).cast("int").alias("c"),
        (F.expr("p_partkey div 50 div 8") * 40 % 256).alias("red"), (F.expr("p_partkey % 50 div 10") * 50).alias("green"), (F.col("p_size") % 3).alias("blue"),
    )
    return raster.superpixels(pixels, "pano", min_size=20)


LIMITS = ", ".join(f"({k}, '{n}', {m})" for k, n, _, m in vocabulary.limits() if k)
#: Two classes whose objects need more than 50 faces, and one whose need more.
LOW, LOW_TOO, HIGH = (next(k for k, *_, m in vocabulary.limits() if k > least and m == limit) for least, limit in ((0, 50), (70, 50), (0, 400)))


@query(f"""WITH RECURSIVE k AS (SELECT p_partkey // 2 AS face_id, p_partkey % 2 AS pano FROM part),
v AS (SELECT face_id // 60 % 5 AS building, face_id, pano, 1 + (face_id + 6 * pano) // 12 AS inst, [{LOW}, {LOW_TOO}, {HIGH}][1 + face_id // 60 % 3] AS class FROM k WHERE pano = 0 OR face_id % 60 < 50),
node AS (SELECT DISTINCT building, pano, inst, building || '/' || pano || '/' || inst AS node FROM v), w AS (SELECT v.*, node FROM v JOIN node USING (building, pano, inst)),
e AS (SELECT DISTINCT a.node AS a, b.node AS b FROM w a JOIN w b USING (building, face_id, class)),
reach AS (SELECT DISTINCT node AS a, node AS b FROM w UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b), comp AS (SELECT a AS node, min(b) AS comp FROM reach GROUP BY a),
ext AS (SELECT building, class, comp, node, face_id FROM w JOIN comp USING (node)), n AS (SELECT building, class, comp, count(DISTINCT face_id) AS n, count(DISTINCT node) AS nodes FROM ext GROUP BY ALL),
lim AS (SELECT * FROM (VALUES {LIMITS}) l(class, name, least)),
kept AS (SELECT n.building, n.class, comp FROM n JOIN (SELECT building, class, sum(nodes) AS total FROM n GROUP BY ALL) t USING (building, class) LEFT JOIN lim USING (class) WHERE n > coalesce(least, 0) OR total = 1)
SELECT building, face_id, class, min(face_id) OVER (PARTITION BY building, class, comp) AS first FROM (SELECT DISTINCT building, class, comp, face_id FROM ext) JOIN kept USING (building, class, comp)""")
def discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances of two views of each face that meet become objects; an object is named by its first face."""
    k = _read(spark, sf_dir, "part").select(F.expr("p_partkey div 2").alias("face_id"), (F.col("p_partkey") % 2).alias("pano")).where("pano = 0 or face_id % 60 < 50")
    kinds = F.array(*[F.lit(c) for c in (LOW, LOW_TOO, HIGH)])
    votes = k.select(F.expr("face_id div 60 % 5").alias("building"), "face_id", "pano", (F.expr("(face_id + 6 * pano) div 12") + 1).alias("inst"), F.get(kinds, F.expr("face_id div 60 % 3")).alias("class"))
    classes = votes.select("building", "face_id", "class").distinct()
    middles = classes.select("building", "face_id", *[F.col("face_id").cast("double").alias(a) for a in "xyz"])
    found = fusion.discover(votes, votes, classes, middles)
    return found.select("building", "face_id", "class", F.min("face_id").over(Window.partitionBy("building", "inst")).alias("first"))


@query(f"""SELECT s_nationkey AS building, s_suppkey AS face_id, {HIGH} AS class, CAST(1 AS BIGINT) AS inst FROM supplier WHERE s_nationkey % 2 = 0""")
def single_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A building's only instance of a class stays, however few its faces; one of two does not."""
    votes = _read(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("building"), F.col("s_suppkey").alias("face_id"), F.lit(1).alias("pano"), F.lit(HIGH).alias("class"),
        F.when(F.col("s_nationkey") % 2 == 0, 1).otherwise(F.col("s_suppkey") + 1).alias("inst"),
    )
    pairs = votes.where("building % 2 = 1").groupBy("building").agg(F.count("*").alias("n")).where("n > 1").select("building")
    votes = votes.where("building % 2 = 0").unionByName(votes.join(pairs, "building", "left_semi").select(votes.columns))
    classes = votes.select("building", "face_id", "class").distinct()
    middles = classes.select("building", "face_id", *[F.col("face_id").cast("double").alias(a) for a in "xyz"])
    return fusion.discover(votes, votes, classes, middles).select("building", "face_id", "class", "inst")


@query("""WITH RECURSIVE k AS (SELECT p_partkey % 3 AS kind, p_partkey // 3 AS px, p_partkey % 11 = 0 AS other FROM part),
h AS (SELECT px // 100 % 4 AS pano, px // 50 AS r, px % 50 AS c, kind * 100000 + (px + 6 * kind) // 18 AS instance_id, 57 + (px // 90 + CASE WHEN other THEN 1 ELSE 0 END) % 2 AS class FROM k WHERE kind = 0 OR px % 90 < 80),
grid AS (SELECT DISTINCT px // 100 % 4 AS pano, px // 50 AS r, px % 50 AS c, 57 + px // 90 % 2 AS class FROM k), own AS (SELECT DISTINCT pano, class, instance_id, r, c FROM h SEMI JOIN grid USING (pano, class, r, c)),
node AS (SELECT *, pano || '/' || instance_id AS node FROM own), e AS (SELECT DISTINCT a.node AS a, b.node AS b FROM node a JOIN node b USING (pano, class, r, c)),
reach AS (SELECT DISTINCT node AS a, node AS b FROM node UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b), comp AS (SELECT a AS node, min(b) AS comp FROM reach GROUP BY a)
SELECT DISTINCT pano, r, c, class, min(r * 50 + c) OVER (PARTITION BY pano, class, comp) AS first FROM node JOIN comp USING (node)""")
def pano_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances of each panorama that share pixels of their class become objects, named by their first pixel; hits of a class
    that the pixel does not have take no part."""
    k = _read(spark, sf_dir, "part").select((F.col("p_partkey") % 3).alias("kind"), F.expr("p_partkey div 3").alias("px"), (F.col("p_partkey") % 11 == 0).cast("int").alias("other"))
    place = [F.expr("px div 100 % 4").alias("pano"), F.expr("px div 50").alias("r"), (F.col("px") % 50).alias("c")]
    hits = k.where("kind = 0 or px % 90 < 80").select(*place, F.expr("kind * 100000 + (px + 6 * kind) div 18").alias("instance_id"), F.expr("57 + (px div 90 + other) % 2").alias("class"))
    pixels = k.select(*place, F.expr("57 + px div 90 % 2").alias("class")).distinct()
    found = pano.cluster(hits, pixels, pano.PanoOptions(width=50, stride=1, erosion=False))
    return found.select("pano", "r", "c", "class", F.min(F.col("r") * 50 + F.col("c")).over(Window.partitionBy("pano", "inst")).alias("first"))


LAYERED = f"""{P}, q AS (SELECT CAST(label % 2 AS BIGINT) AS building, vec_id AS face_id, CAST(label // 2 AS BIGINT) AS room, x, y, z FROM p),
b AS (SELECT building, min(x) AS ax, max(x) - min(x) AS sx, min(y) AS ay, max(y) - min(y) AS sy, min(z) AS az, max(z) - min(z) AS sz FROM q GROUP BY building),
grid AS (SELECT building, CAST(ceil(sx / 0.1) AS BIGINT) AS rx, CAST(ceil(sy / 0.1) AS BIGINT) AS ry, CAST(ceil(sz / 0.1) AS BIGINT) AS rz,
  ax + sx / 2 - ceil(sx / 0.1) * 0.1 / 2 AS gx, ay + sy / 2 - ceil(sy / 0.1) * 0.1 / 2 AS gy, az + sz / 2 - ceil(sz / 0.1) * 0.1 / 2 AS gz FROM b),
c AS (SELECT q.*, floor((x - gx) / 0.1) AS i, floor((y - gy) / 0.1) AS j, floor((z - gz) / 0.1) AS k, rx, ry, rz FROM q JOIN grid USING (building))"""


def _faces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A point for each face of two buildings, with the room it lies in; and the buildings' voxel grids."""
    points = _points(spark, sf_dir).select((F.col("label") % 2).cast("bigint").alias("building"), F.col("vec_id").alias("face_id"), F.expr("cast(label div 2 as bigint)").alias("room"), "x", "y", "z")
    return points, aggregate.voxel_grid(points, ["building"], 0.1)


@query(f"""WITH {LAYERED}, v AS (SELECT building, room, count(DISTINCT (i * ry + j) * rz + k) AS n_voxels FROM c WHERE i >= 0 AND j >= 0 AND k >= 0 AND i < rx AND j < ry AND k < rz GROUP BY ALL)
SELECT building, room, row_number() OVER (PARTITION BY building ORDER BY room) AS id, building AS parent_building, round(min(x) + (max(x) - min(x)) / 2, 6) + 0.0 AS location_x, round(max(z) - min(z), 6) AS size_z,
  count(*) AS n_faces, any_value(n_voxels) AS n_voxels, CASE WHEN room % 2 = 0 THEN 'kitchen' END AS scene_category FROM q JOIN v USING (building, room) GROUP BY building, room""")
def room_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms of two buildings: extents, voxels, faces and the category of those that have a name."""
    points, grids = _faces(spark, sf_dir)
    names = points.where("room % 2 = 0").select("building", "room", F.lit("kitchen").alias("scene_category"), F.lit("0").alias("floor_number")).distinct()
    out = layers.room_layer(points.select("building", "room", "face_id"), names, points.drop("room"), grids)
    return out.select("building", "room", "id", "parent_building", _round(F.col("location")[0]).alias("location_x"), _round(F.col("size")[2]).alias("size_z"), F.size("face_ids").cast("bigint").alias("n_faces"), F.size("voxel_occupancy").cast("bigint").alias("n_voxels"), "scene_category")


@query(f"""WITH {LAYERED}, known AS (SELECT * FROM (VALUES {LIMITS}) l(class, name, least)),
t AS (SELECT a.building, a.face_id, 1 + a.face_id % 9 AS instance, 57 + a.face_id % 9 % 3 AS class, a.face_id % 4 AS room_id, a.x AS ax, a.y AS ay, a.z AS az, a.x + 0.1 AS bx, a.y AS by_, a.z + 0.2 AS bz, a.x AS cx, a.y + 0.3 AS cy, a.z AS cz FROM q a),
n AS (SELECT building, instance, any_value(class) AS class, count(*) AS n_faces FROM t GROUP BY ALL),
s AS (SELECT building, instance, sum(sqrt(power((by_ - ay) * (cz - az) - (bz - az) * (cy - ay), 2) + power((bz - az) * (cx - ax) - (bx - ax) * (cz - az), 2) + power((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax), 2)) / 2) AS area FROM t GROUP BY ALL),
rm AS (SELECT building, instance, room_id FROM (SELECT building, instance, room_id, count(*) AS k FROM t GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY building, instance ORDER BY k DESC, room_id) = 1),
v AS (SELECT c.building, 1 + c.face_id % 9 AS instance, count(DISTINCT (i * ry + j) * rz + k) AS n_voxels FROM c WHERE i >= 0 AND j >= 0 AND k >= 0 AND i < rx AND j < ry AND k < rz GROUP BY ALL)
SELECT building, instance, row_number() OVER (PARTITION BY building ORDER BY class, instance) AS id, name AS class_, round(area, 6) AS surface_coverage, room_id AS parent_room, n_faces, n_voxels,
  CASE WHEN instance % 2 = 0 THEN 'soft' END AS tactile_texture, CASE WHEN class = 57 THEN 'sit' END AS action FROM n JOIN s USING (building, instance) JOIN rm USING (building, instance) JOIN v USING (building, instance) JOIN known USING (class)""")
def object_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of two buildings with all that is joined to them: class name, area, room, attributes, actions."""
    points, grids = _faces(spark, sf_dir)
    inst = (F.col("face_id") % 9 + 1).alias("inst")
    faces = points.select("building", "face_id", inst, (F.col("face_id") % 9 % 3 + 57).alias("class"))
    corner = {"ax": 0.0, "ay": 0.0, "az": 0.0, "bx": 0.1, "by": 0.0, "bz": 0.2, "cx": 0.0, "cy": 0.3, "cz": 0.0}
    cornered = points.select("building", "face_id", *[(F.col(n[1]) + d).alias(n) if d else F.col(n[1]).alias(n) for n, d in corner.items()])
    rooms = points.select("building", "face_id", (F.col("face_id") % 4).alias("room_id"))
    extra = faces.select("building", F.col("inst").alias("instance")).distinct().where("instance % 2 = 0").withColumn("class", F.lit("x")).withColumn("tactile_texture", F.lit("soft"))
    names = vocabulary.classes(spark)
    actions = names.where("class = 57").select(F.col("name").alias("class"), F.array(F.lit("sit")).alias("actions"))
    out, _ = layers.object_layer(faces, points.drop("room"), cornered, grids, rooms, extra, actions, names)
    return out.select("building", "instance", "id", "class_", _round(F.col("surface_coverage")).alias("surface_coverage"), "parent_room", F.size("face_ids").cast("bigint").alias("n_faces"), F.size("voxel_occupancy").cast("bigint").alias("n_voxels"), "tactile_texture", F.col("action_affordance")[0].alias("action"))


# --- frames ------------------------------------------------------------------------------------


@query("""WITH v AS (SELECT s_suppkey, s_nationkey * 15 - 180 AS theta, (s_suppkey % 3 - 1) * 15 AS phi, 60 + s_suppkey % 4 * 15 AS fov FROM supplier),
f AS (SELECT s_suppkey, fr, fc, radians(theta) AS t, radians(-phi) AS p, 1.0 AS x, (fc / 5.0 * 2 - 1) * tan(radians(fov / 2.0)) AS y, -(fr / 5.0 * 2 - 1) * tan(radians(fov / 2.0)) AS z FROM v, (SELECT unnest(range(6)) AS fr), (SELECT unnest(range(6)) AS fc)),
a AS (SELECT *, cos(t) * x - sin(t) * y AS x1, sin(t) * x + cos(t) * y AS y1 FROM f), d AS (SELECT *, -sin(t) * x1 + cos(t) * y1 AS k, cos(t) * z AS cx, sin(t) * z AS cy, -sin(t) * y1 - cos(t) * x1 AS cz FROM a),
r AS (SELECT s_suppkey, fr, fc, x1 * cos(p) + cx * sin(p) - sin(t) * k * (1 - cos(p)) AS x2, y1 * cos(p) + cy * sin(p) + cos(t) * k * (1 - cos(p)) AS y2, z * cos(p) + cz * sin(p) AS z2 FROM d)
SELECT s_suppkey, CAST(fr AS INTEGER) AS fr, CAST(fc AS INTEGER) AS fc, round(cos(atan2(y2, x2)), 6) + 0.0 AS east, round(degrees(asin(z2 / sqrt(x2 * x2 + y2 * y2 + z2 * z2))), 4) + 0.0 AS latitude FROM r""")
def view_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rays of a view of its own for each supplier."""
    views = _read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") * 15 - 180).alias("theta"), ((F.col("s_suppkey") % 3 - 1) * 15).alias("phi"), (F.col("s_suppkey") % 4 * 15 + 60).alias("fov"), F.lit(6).alias("size"))
    rays = g.frame_rays(views)
    return rays.select("s_suppkey", "fr", "fc", _round(F.cos(F.radians("longitude"))).alias("east"), _round(F.col("latitude"), 4).alias("latitude"))


@query("""SELECT s_suppkey AS pano, CAST(fov AS INTEGER) AS fov, CAST(theta AS INTEGER) AS theta, CAST(phi AS INTEGER) AS phi FROM (SELECT s_suppkey, s_nationkey FROM supplier), (SELECT unnest([75, 90, 105]) AS fov), (SELECT unnest(range(-180, 181, 15)) AS theta), (SELECT unnest([-15, 0, 15]) AS phi) WHERE abs(theta) <= 15 * s_nationkey""")
def pano_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The views that each panorama is cut into, as far round as it reaches."""
    panos = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pano"), (F.col("s_nationkey") * 15).alias("reach"))
    return panos.join(F.broadcast(g.view_parameters(spark)), F.abs("theta") <= F.col("reach")).select("pano", "fov", "theta", "phi")


@query("""WITH l AS (SELECT p_size % 4 AS pano, p_partkey // 50 AS r, p_partkey % 50 AS c, p_size % 7 AS label FROM part)
SELECT pano, r, c, CAST(floor((label * 30 + CASE WHEN c % 2 = 0 THEN 100 + label ELSE 0 END) / 2) AS INTEGER) AS red, CAST(floor((200 - label + CASE WHEN c % 2 = 0 THEN r % 256 ELSE 0 END) / 2) AS INTEGER) AS green FROM l""")
def blended_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in their palette's colours over a picture that covers every other column."""
    pixels = _raster(spark, sf_dir).select((F.col("size") % 4).alias("pano"), "r", "c", (F.col("size") % 7).alias("label"))
    palette = spark.range(7).select(F.col("id").alias("idx"), (F.col("id") * 30).alias("r"), (200 - F.col("id")).alias("g"), F.col("id").alias("b"))
    under = pixels.where("c % 2 = 0").select("pano", "r", "c", (F.col("label") + 100).alias("red"), (F.col("r") % 256).alias("green"), F.lit(0).alias("blue"))
    return png.coloured(pixels, palette, "label", under).select("pano", "r", "c", "red", "green")


@query(None)
def frame_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of panoramas of parts, painted by bicubic samples, written by the tasks and read back."""
    pixels = _raster(spark, sf_dir).select(F.concat(F.lit("p"), F.floor(F.col("r") / 25)).alias("pano"), (F.col("r") % 25).alias("r"), "c", *[(F.col("size") * k).cast("int").alias(n) for k, n in ((5, "red"), (3, "green"), (1, "blue"))])
    panoramas = png.images(pixels, "pano", 25, 50)
    views = g.view_parameters(spark, fovs=(90,), yaw_step=90, pitches=(0,), sizes=(8,), dedupe_yaw=True)
    path = f"{_folder(spark, 'frames')}/png"
    png.write_images(pano.frame_images(panoramas, views).withColumn("name", F.concat_ws("_", "pano", "frame")), path, "name")
    return png.read_images(spark, f"{path}/*.png")
