"""More queries over the driver's tables: functions, scans, exports, rays and plans that the first catalogue leaves out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import geometry as g
from orrery.functions import vocabulary
from orrery.operators import aggregate, graph, joins, raster, rays, relations
from orrery.plans import fusion, layers, pano
from orrery.plans.catalogue import ORACLE_SQL, QUERIES, CORNERS, _cornered, _points, _raster, _read, _round, _strip, _votes, P, V, query
from orrery.sources import export, mesh, readers
from orrery.staging import Stages

__all__ = ["ORACLE_SQL", "QUERIES"]  # of both catalogues
XYZ = ("x", "y", "z")


def _cells(m: g.Matrix | g.Vector, names: str) -> list:
    return [_round(c).alias(n) for c, n in zip(m, names.split(), strict=True)]


# --- functions ---------------------------------------------------------------------------------


@query("""SELECT p_partkey, r >= 0 AND r < 30 AND c >= 0 AND c < 40 AS inside, r % 4 = 0 AND c % 4 = 0 AS strided FROM (SELECT p_partkey, p_partkey // 50 - 2 AS r, p_partkey % 50 - 3 AS c FROM part)""")
def frame_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = _raster(spark, sf_dir).withColumn("p_partkey", F.col("r") * 50 + F.col("c"))
    r, c = F.col("r") - 2, F.col("c") - 3
    return pixels.select("p_partkey", g.in_frame(r, c, 30, 40).alias("inside"), g.on_stride(r, c).alias("strided"))


@query("""SELECT p_partkey, abs(d - s) <= 0.01 AND s <= 6.0 AS agrees, abs(d - s) <= 0.01 AS near FROM (SELECT p_partkey, p_size * 0.21 AS d, p_size * 0.21 + p_partkey % 5 * 0.004 AS s FROM part)""")
def depth_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("p_size") * 0.21
    seen = d + F.col("p_partkey") % 5 * 0.004
    return _read(spark, sf_dir, "part").select("p_partkey", g.depth_agrees(d, seen).alias("agrees"), g.depth_agrees(d, seen, reach=None).alias("near"))


@query(f"""WITH {P}, a AS (SELECT *, radians(vec_id % 360) AS t FROM p)
SELECT vec_id, round(cos(t) * y - sin(t) * z, 6) + 0.0 AS xy, round(sin(t) * y + cos(t) * z, 6) + 0.0 AS xz, round(cos(t) * x + sin(t) * z, 6) + 0.0 AS yx, round(-sin(t) * x + cos(t) * z, 6) + 0.0 AS yz,
  round(cos(t) * x - sin(t) * y, 6) + 0.0 AS zx, round(sin(t) * x + cos(t) * y, 6) + 0.0 AS zy FROM a""")
def axis_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = (g.times(g.rotation(a, F.col("vec_id") % 360), g.vector(*XYZ)) for a in "xyz")
    return _points(spark, sf_dir).select("vec_id", *_cells((x[1], x[2], y[0], y[2], z[0], z[1]), "xy xz yx yz zx zy"))


@query(f"""WITH {P}, u AS (SELECT *, 1 / sqrt(14.0) AS a, 2 / sqrt(14.0) AS b, 3 / sqrt(14.0) AS c, x + 1 AS t FROM p), d AS (SELECT *, a * x + b * y + c * z AS k FROM u)
SELECT vec_id, round(x * cos(t) + (b * z - c * y) * sin(t) + a * k * (1 - cos(t)), 6) + 0.0 AS rx, round(y * cos(t) + (c * x - a * z) * sin(t) + b * k * (1 - cos(t)), 6) + 0.0 AS ry,
  round(z * cos(t) + (a * y - b * x) * sin(t) + c * k * (1 - cos(t)), 6) + 0.0 AS rz FROM d""")
def axis_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = g.times(g.axis_angle((F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.col("x") + 1), g.vector(*XYZ))
    return _points(spark, sf_dir).select("vec_id", *_cells(turned, "rx ry rz"))


@query("""SELECT p_partkey, round(sin(a) * cos(d) * p_size, 6) + 0.0 AS x, round(cos(a) * cos(d) * p_size, 6) + 0.0 AS y, round(-sin(d) * p_size, 6) + 0.0 AS z
FROM (SELECT p_partkey, p_size, (p_partkey // 50 - 20) * (pi() / 40) AS d, (p_partkey % 50 - 25) * (2 * pi() / 50) AS a FROM part)""")
def equirect_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = g.equirect_point(F.col("r"), F.col("c"), 40, 50, F.col("size"))
    return _raster(spark, sf_dir).select((F.col("r") * 50 + F.col("c")).alias("p_partkey"), *_cells(point, "x y z"))


EULER = ("sxyz", "sxzy", "syxz", "syzx", "szxy", "szyx", "sxyx", "sxzx", "syxy", "syzy", "szxz", "szyz")


def _order_sql(axes: str) -> str:
    """A rotation matrix of three turns, as SQL over angles p, q, s, cell by cell from the definition."""
    turn = {
        "x": lambda t: (("1.0", "0.0", "0.0"), ("0.0", f"cos({t})", f"(-sin({t}))"), ("0.0", f"sin({t})", f"cos({t})")),
        "y": lambda t: ((f"cos({t})", "0.0", f"sin({t})"), ("0.0", "1.0", "0.0"), (f"(-sin({t}))", "0.0", f"cos({t})")),
        "z": lambda t: ((f"cos({t})", f"(-sin({t}))", "0.0"), (f"sin({t})", f"cos({t})", "0.0"), ("0.0", "0.0", "1.0")),
    }
    product = lambda a, b: tuple(tuple("(" + " + ".join(f"{a[i][k]} * {b[k][j]}" for k in range(3)) + ")" for j in range(3)) for i in range(3))
    parts = [turn[a](t) for a, t in zip(axes[1:], "pqs", strict=True)]
    m = product(parts[2], product(parts[1], parts[0])) if axes[0] == "s" else product(parts[0], product(parts[1], parts[2]))
    return f"SELECT vec_id, '{axes}' AS axes, " + ", ".join(f"round({m[i][j]}, 6) + 0.0 AS m{i}{j}" for i in range(3) for j in range(3)) + " FROM a"


@query(f"WITH {P}, a AS (SELECT vec_id, x * 4 AS p, y * 3 + 0.7 AS q, z * 4 AS s FROM p) " + " UNION ALL ".join(_order_sql(f + a[1:]) for a in EULER for f in "sr"))
def euler_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrix to angles and back, for all 24 orders: the matrix of the angles found is the first one."""
    points = _points(spark, sf_dir)
    out = None
    for axes in (f + a[1:] for a in EULER for f in "sr"):
        def matrix(angles: tuple, axes: str = axes) -> g.Matrix:
            parts = [g.rotation(a, F.degrees(t)) for a, t in zip(axes[1:], angles, strict=True)]
            first, second, third = parts if axes[0] == "r" else parts[::-1]
            return g.matmul(first, g.matmul(second, third))

        cells = [matrix((F.col("x") * 4, F.col("y") * 3 + 0.7, F.col("z") * 4))[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(3)]
        angles = points.select("vec_id", *cells).select("vec_id", *[a.alias(f"t{k}") for k, a in enumerate(g.euler_angles(tuple(tuple(F.col(f"m{i}{j}") for j in range(3)) for i in range(3)), axes))])
        back = matrix(tuple(F.col(f"t{k}") for k in range(3)))
        rows = angles.select("vec_id", F.lit(axes).alias("axes"), *[_round(back[i][j]).alias(f"m{i}{j}") for i in range(3) for j in range(3)])
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""WITH {CORNERS} SELECT face_id, CAST(5 AS BIGINT) AS n, CAST(5 AS BIGINT) AS inside, CAST(5 AS BIGINT) AS own FROM f""")
def face_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points drawn on faces lie on them: the three triangles with a corner replaced add up to the face; point ids name the face."""
    corners = mesh.corner_vectors()
    faces = _cornered(_points(spark, sf_dir))
    points = mesh.sample_points(faces, 5, ()).join(faces, "face_id")
    spot = g.vector(*XYZ)
    parts = sum((g.triangle_area(*(spot if k == n else c for n, c in enumerate(corners))) for k in range(3)), F.lit(0.0))
    flat = F.abs(parts - g.triangle_area(*corners)) < 1e-9
    return points.groupBy("face_id").agg(F.count("*").alias("n"), F.sum(flat.cast("bigint")).alias("inside"), F.count_distinct(F.when(F.expr("point_id div 5") == F.col("face_id"), F.col("point_id"))).alias("own"))


@query(f"""WITH {P} SELECT label, round(min(x) + (max(x) - min(x)) / 2 - 1, 6) + 0.0 AS location_x, round(min(y) + (max(y) - min(y)) / 2 - 2, 6) + 0.0 AS location_y, round(min(z) + (max(z) - min(z)) / 2 + 3, 6) + 0.0 AS location_z FROM p GROUP BY label""")
def reference_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = aggregate.bounding_box(_points(spark, sf_dir), ["label"], origin=(1.0, 2.0, -3.0))
    return box.select("label", *[_round(F.col(f"location_{a}")).alias(f"location_{a}") for a in "xyz"])


@query("SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN CASE WHEN p_size > 25 OR p_retailprice > 1500 THEN 0.01 ELSE 0.3 END WHEN 'Brand#2' THEN 0.005 ELSE 0.01 END AS eps FROM part")
def cluster_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_brand") == "Brand#1", "chair").when(F.col("p_brand") == "Brand#2", "book").otherwise(F.col("p_brand"))
    return _read(spark, sf_dir, "part").select("p_partkey", vocabulary.cluster_radius(name, F.col("p_size") / 10, F.col("p_retailprice") / 600).alias("eps"))


# --- meshes and rays ---------------------------------------------------------------------------


@query(f"WITH {CORNERS} SELECT face_id, ax, by_, cz FROM f")
def face_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return mesh.with_corners(_strip(points), points.withColumnRenamed("vec_id", "vertex_id"), ()).select("face_id", "ax", F.col("by").alias("by_"), "cz")


#: Moeller-Trumbore over rays r (ray, ox .. dz) and faces f, as SQL.
HIT = """m AS (SELECT ray, face_id, ox - ax AS sx, oy - ay AS sy, oz - az AS sz, bx - ax AS ex, by_ - ay AS ey, bz - az AS ez, cx - ax AS gx, cy - ay AS gy, cz - az AS gz, dx, dy, dz FROM r, f),
h AS (SELECT *, dy * gz - dz * gy AS hx, dz * gx - dx * gz AS hy, dx * gy - dy * gx AS hz, sy * ez - sz * ey AS qx, sz * ex - sx * ez AS qy, sx * ey - sy * ex AS qz FROM m),
k AS (SELECT ray, face_id, ex * hx + ey * hy + ez * hz AS det, sx * hx + sy * hy + sz * hz AS u, dx * qx + dy * qy + dz * qz AS v, gx * qx + gy * qy + gz * qz AS w FROM h),
hits AS (SELECT ray, face_id, w / det AS t FROM k WHERE abs(det) >= 1e-12 AND u / det >= -1e-9 AND v / det >= -1e-9 AND (u + v) / det <= 1 + 1e-9 AND w / det > 1e-9)"""
BEAMS = "r AS (SELECT vec_id AS ray, x AS ox, y AS oy, z AS oz, y + 0.1 AS dx, z - 0.2 AS dy, x + 0.05 AS dz FROM p)"


def _beams(points: DataFrame) -> DataFrame:
    return points.select(
        F.lit(1).alias("building"), F.col("vec_id").alias("ray_id"), *[F.col(a).alias(f"o{a}") for a in "xyz"],
        (F.col("y") + 0.1).alias("dx"), (F.col("z") - 0.2).alias("dy"), (F.col("x") + 0.05).alias("dz"),
    )


def _scene(points: DataFrame) -> DataFrame:
    return _cornered(points).withColumn("building", F.lit(1))


@query(f"WITH {CORNERS}, {BEAMS}, {HIT} SELECT ray, face_id, round(t, 5) AS t FROM hits")
def ray_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    hits = rays.cast_rays(_beams(points), _scene(points))
    return hits.select(F.col("ray_id").alias("ray"), "face_id", _round(F.col("t"), 5).alias("t"))


@query(f"WITH {CORNERS}, {BEAMS}, {HIT}, first AS (SELECT ray, face_id FROM hits QUALIFY row_number() OVER (PARTITION BY ray ORDER BY t, face_id) = 1) SELECT ray, face_id FROM first WHERE face_id % 3 = ray % 3")
def visible_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays whose first hit is a face that owns their point; here a point is owned by the faces of its remainder,
    of which those that are hit matter."""
    points = _points(spark, sf_dir)
    first = rays.cast_rays(_beams(points), _scene(points), first_only=True)
    owners = first.where("face_id % 3 = ray_id % 3").select("building", "ray_id", "face_id")
    return rays.visible(first, owners).select(F.col("ray_id").alias("ray"), "face_id")


SEEN = """cam AS (SELECT unnest([1, 2]) AS camera_id, unnest([0.9, -0.4]) AS lx, unnest([-0.7, 0.1]) AS ly, unnest([1.3, 1.1]) AS lz),
g AS (SELECT face_id AS own, camera_id, lx, ly, lz, (ax + bx + cx) / 3 - lx AS wx, (ay + by_ + cy) / 3 - ly AS wy, (az + bz + cz) / 3 - lz AS wz FROM f, cam),
pix AS (SELECT *, CAST(trunc(wx * 60.0 / tan(0.6) / wz + 60.0) AS INTEGER) AS px, CAST(trunc(wy * 60.0 / tan(0.6) / wz + 60.0) AS INTEGER) AS py FROM g WHERE wz < 0),
ins AS (SELECT * FROM pix WHERE px >= 0 AND px < 120 AND py >= 0 AND py < 120),
r AS (SELECT own * 10 + camera_id AS ray, lx AS ox, ly AS oy, lz AS oz, wx AS dx, wy AS dy, wz AS dz FROM ins)"""


@query(f"""WITH {CORNERS}, {SEEN}, {HIT}, first AS (SELECT ray, face_id FROM hits QUALIFY row_number() OVER (PARTITION BY ray ORDER BY t, face_id) = 1)
SELECT CAST(camera_id AS INTEGER) AS camera_id, own AS face_id, px, py, coalesce(face_id = own, false) AS visible FROM ins LEFT JOIN first ON ray = own * 10 + camera_id""")
def visible_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The centre of every face, seen by two cameras."""
    faces = _scene(_points(spark, sf_dir))
    centre = [((F.col(f"a{a}") + F.col(f"b{a}") + F.col(f"c{a}")) / 3).alias(a) for a in "xyz"]
    points = faces.select("building", F.col("face_id").alias("point_id"), "face_id", *centre)
    cameras = spark.createDataFrame([(1, 1, 0.9, -0.7, 1.3, 0.0, 0.0, 0.0, 1.2), (1, 2, -0.4, 0.1, 1.1, 0.0, 0.0, 0.0, 1.2)], "building int, camera_id int, x double, y double, z double, rx double, ry double, rz double, fov double")
    return relations.visible_points(points, cameras, faces, 120, 120).select("camera_id", "face_id", "px", "py", "visible")


@query(f"""WITH {P}, tri AS (SELECT a.label, a.x AS ax, a.y AS ay, a.z AS az, (b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y) AS nx, (b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z) AS ny, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS nz,
  a.vec_id AS i, b.vec_id AS j, c.vec_id AS k FROM p a JOIN p b ON a.label = b.label AND a.vec_id < b.vec_id JOIN p c ON c.label = a.label AND b.vec_id < c.vec_id),
sides AS (SELECT tri.label, i, j, k, any_value(ax) AS ax, any_value(ay) AS ay, any_value(az) AS az, any_value(nx) AS nx, any_value(ny) AS ny, any_value(nz) AS nz, min(nx * (x - ax) + ny * (y - ay) + nz * (z - az)) AS low, max(nx * (x - ax) + ny * (y - ay) + nz * (z - az)) AS high
  FROM tri JOIN p ON p.label = tri.label AND vec_id <> i AND vec_id <> j AND vec_id <> k GROUP BY tri.label, i, j, k),
o AS (SELECT label, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p GROUP BY label)
SELECT label, round(sum(abs(nx * (x - ax) + ny * (y - ay) + nz * (z - az))) / 6, 6) AS volume FROM sides JOIN o USING (label) WHERE low > 0 OR high < 0 GROUP BY label""")
def hull3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.operators import hull

    return hull.hulls(_points(spark, sf_dir), "label").select("label", _round(F.col("volume")).alias("volume"))


FACED = "fc AS (SELECT vec_id // 3 AS face_id, vec_id AS v FROM p WHERE vec_id // 3 * 3 + 2 <= (SELECT max(vec_id) FROM p))"


@query(f"""WITH RECURSIVE {P}, {FACED}, e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON a.vec_id <> b.vec_id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 0.03 * 0.03
  UNION SELECT m.v, n.v FROM fc m JOIN fc n USING (face_id)),
reach AS (SELECT DISTINCT v AS a, v AS b FROM fc UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
SELECT face_id, min(b) AS component FROM fc JOIN reach ON reach.a = v GROUP BY face_id""")
def face_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    faces = _strip(points).where("face_id % 3 = 0").withColumn("face_id", F.expr("face_id div 3"))  # three points a face, each in one
    return graph.face_clusters(faces, points.withColumnRenamed("vec_id", "vertex_id"), XYZ, 0.03)


@query("""WITH RECURSIVE m AS (SELECT s_suppkey AS inst, 'n' || s_nationkey AS el FROM supplier UNION ALL SELECT s_suppkey, 'b' || CAST(floor(s_acctbal / 100) AS BIGINT) FROM supplier),
e AS (SELECT DISTINCT a.inst AS a, b.inst AS b FROM m a JOIN m b USING (el)),
reach AS (SELECT DISTINCT inst AS a, inst AS b FROM m UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
SELECT a AS inst, min(b) AS component FROM reach GROUP BY a""")
def instance_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "supplier")
    nation, balance = F.concat(F.lit("n"), F.col("s_nationkey")), F.concat(F.lit("b"), F.floor(F.col("s_acctbal") / 100).cast("bigint"))
    members = rows.select(F.col("s_suppkey").alias("inst"), F.explode(F.array(nation, balance)).alias("el"))
    return graph.instance_clusters(members, "inst", ["el"])


# --- rasters -----------------------------------------------------------------------------------

SIZED = "m AS (SELECT p_partkey // 50 AS r, p_partkey % 50 AS c, p_size % 3 AS grp, 1 + p_size % 3 AS s FROM part WHERE p_size >= 3)"


@query(f"""WITH {SIZED}, big AS (SELECT r, c, g.grp, g.grp + 1 AS s FROM (SELECT DISTINCT r, c FROM m), (SELECT unnest([0, 1, 2]) AS grp) g),
votes AS (SELECT big.grp, big.s, big.r - a.d AS r, big.c - b.d AS c FROM big, (SELECT unnest([-1, 0, 1]) AS d) a, (SELECT unnest([-1, 0, 1]) AS d) b
  WHERE a.d >= -(s // 2) AND a.d <= s - s // 2 - 1 AND b.d >= -(s // 2) AND b.d <= s - s // 2 - 1)
SELECT grp, r, c FROM votes GROUP BY grp, r, c HAVING count(*) = any_value(s) * any_value(s)""")
def erode_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mask eroded by three sizes, which a column gives."""
    mask = _raster(spark, sf_dir).where("size >= 3").select("r", "c").distinct()
    sized = mask.withColumn("grp", F.explode(F.array(*[F.lit(k) for k in range(3)]))).withColumn("s", F.col("grp") + 1)
    return raster.erode(sized, ["grp"], F.col("s")).select("grp", "r", "c")


LABELLED = "m AS (SELECT p_partkey // 50 AS r, p_partkey % 50 AS c, CASE WHEN p_size < 3 THEN 9 ELSE (p_partkey // 50 // 7 + p_partkey % 50 // 9) % 3 END AS lab FROM part), s AS (SELECT unnest([-1, 0, 1]) AS d)"


@query(f"""WITH {LABELLED}, e AS (SELECT lab, m.r - a.d AS r, m.c - b.d AS c FROM m, s a, s b GROUP BY ALL HAVING count(*) = 9),
o AS (SELECT DISTINCT lab, e.r + a.d AS r, e.c + b.d AS c FROM e, s a, s b), kept AS (SELECT lab, r, c FROM m SEMI JOIN o USING (lab, r, c)),
lost AS (SELECT r, c FROM m ANTI JOIN kept USING (r, c))
SELECT r, c, lab FROM kept UNION ALL SELECT lost.r, lost.c, first(lab ORDER BY (lost.r - kept.r) ** 2 + (lost.c - kept.c) ** 2, kept.r, kept.c) FROM lost, kept GROUP BY lost.r, lost.c""")
def opening_refill(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = F.when(F.col("size") < 3, 9).otherwise((F.floor(F.col("r") / 7) + F.floor(F.col("c") / 9)) % 3).cast("int")
    return raster.open_and_refill(_raster(spark, sf_dir).select("r", "c", lab.alias("lab")), [], "lab", 3).select("r", "c", "lab")


@query("""WITH m AS (SELECT p_partkey // 50 AS r, p_partkey % 50 AS c, p_size AS size FROM part), top AS (SELECT max(r) AS h FROM m), d AS (SELECT unnest(range(4)) AS d),
fine AS (SELECT m.r * 4 + a.d AS r, m.c * 4 + b.d AS c, (m.r * 4 + a.d + 0.5) / 4 - 0.5 AS y, (m.c * 4 + b.d + 0.5) / 4 - 0.5 AS x FROM m, d a, d b),
w AS (SELECT *, CAST(floor(y) AS BIGINT) AS fr, CAST(floor(x) AS BIGINT) AS fc, y - floor(y) AS v, x - floor(x) AS u FROM fine),
k AS (SELECT r, c, greatest(0, least(h, fr)) AS r0, greatest(0, least(h, fr + 1)) AS r1, greatest(0, least(49, fc)) AS c0, greatest(0, least(49, fc + 1)) AS c1, u, v FROM w, top)
SELECT k.r, k.c, round(coalesce((1 - v) * (1 - u) * n.size, 0) + coalesce((1 - v) * u * o.size, 0) + coalesce(v * (1 - u) * p.size, 0) + coalesce(v * u * q.size, 0), 6) + 0.0 AS size
FROM k JOIN m n ON n.r = r0 AND n.c = c0 JOIN m o ON o.r = r0 AND o.c = c1 JOIN m p ON p.r = r1 AND p.c = c0 JOIN m q ON q.r = r1 AND q.c = c1""")
def resize_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = _raster(spark, sf_dir)
    height = pixels.agg(F.max("r")).first()[0] + 1
    return raster.enlarge_smooth(pixels, [], "size", 4, height, 50).select("r", "c", _round(F.col("size")).alias("size"))


@query("""WITH o AS (SELECT p_partkey // 50 AS r, p_partkey % 50 AS c, p_size % 2 = 0 AS visible FROM part WHERE p_size <= 8), rest AS (SELECT p_partkey // 50 AS r, p_partkey % 50 AS c FROM part WHERE p_size >= 30),
painted AS (SELECT r, 49 - c AS c, max(v) AS v FROM (SELECT r, c, 255 AS v FROM o WHERE visible UNION ALL SELECT r, c, 50 FROM rest) GROUP BY ALL),
frame AS (SELECT a.r, b.c FROM (SELECT unnest(range(40)) AS r) a, (SELECT unnest(range(50)) AS c) b),
hole AS (SELECT frame.r, frame.c FROM frame ANTI JOIN painted USING (r, c)),
filled AS (SELECT r, c, v FROM painted WHERE r < 40 UNION ALL SELECT hole.r, hole.c, first(v ORDER BY (hole.r - painted.r) ** 2 + (hole.c - painted.c) ** 2, painted.r, painted.c) FROM hole, painted WHERE painted.r < 40 GROUP BY hole.r, hole.c)
SELECT r, c, 'viz' AS mask FROM filled WHERE v = 255 UNION ALL SELECT DISTINCT r, 49 - c, 'occ' FROM o WHERE NOT visible""")
def amodal_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = _raster(spark, sf_dir).withColumn("k", F.lit(1))
    own = pixels.where("size <= 8").select("k", "r", "c", (F.col("size") % 2 == 0).alias("visible"))
    return relations.amodal_mask(own, pixels.where("size >= 30").select("k", "r", "c"), ["k"], 40, 50).select("r", "c", "mask")


# --- panoramas ---------------------------------------------------------------------------------


@query("SELECT l_suppkey AS pano, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS classes FROM lineitem GROUP BY l_suppkey")
def pano_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = readers.pano_bundle(_votes(spark, sf_dir))
    return found.select("pano", F.array_join(F.array_sort(F.transform("classes", lambda c: c.cast("string"))), ",").alias("classes"))


@query(f"""WITH {V} SELECT pano, class - 1 AS class, inst, count(*) AS n_pixels, string_agg(face || ':' || CAST(w AS BIGINT), ',' ORDER BY face, w) AS pixels FROM v WHERE class > 1 AND inst <> 0 GROUP BY ALL""")
def pano_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = _votes(spark, sf_dir).select("pano", (F.col("class") - 1).alias("class"), "inst", F.col("face").alias("r"), F.col("w").cast("bigint").alias("c"))
    text = F.array_join(F.transform("pixels", lambda p: F.concat_ws(":", p["r"], p["c"])), ",")
    return readers.pano_objects(pixels).select("pano", "class", "inst", "n_pixels", text.alias("pixels"))


INDOOR = ", ".join(f"({k}, '{n}')" for k, n in enumerate(vocabulary.COCO) if k and n not in vocabulary.NOT_INDOOR)


@query(f"""WITH known AS (SELECT * FROM (VALUES {INDOOR}) k(class, name)),
d AS (SELECT l_suppkey AS pano, l_orderkey AS frame, l_partkey * 10 + l_linenumber AS det_no, l_partkey % 81 AS class FROM lineitem GROUP BY l_suppkey, l_orderkey, l_partkey, l_linenumber HAVING max(l_quantity) >= 2)
SELECT pano, frame, det_no, row_number() OVER (PARTITION BY pano ORDER BY frame, det_no) + 1 AS instance_id, name || '_' || row_number() OVER (PARTITION BY pano, class ORDER BY frame, det_no) AS name FROM d JOIN known USING (class)""")
def globalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = F.struct(F.lit(1).alias("r"), F.lit(2).alias("start"), F.lit(3).alias("len"))
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    rows = lines.select(
        F.col("l_suppkey").alias("pano"), F.col("l_orderkey").alias("frame"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("det_no"), (F.col("l_partkey") % 81).cast("int").alias("class"), F.lit(0.5).alias("score"),
        F.when(F.col("l_quantity") >= 2, F.array(run)).otherwise(F.array().cast("array<struct<r:int,start:int,len:int>>")).alias("mask"),
    )
    return pano.globalise(rows).select("pano", "frame", "det_no", "instance_id", "name")


DETECTED = f"""known AS (SELECT * FROM (VALUES {INDOOR}) k(class, name)),
det0 AS (SELECT l_suppkey AS pano, l_orderkey % 20 AS frame, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS det_no, 57 + l_partkey % 4 AS class, l_quantity / 50.0 AS score, l_partkey % 12 AS fr, l_linenumber AS start, 1 + l_suppkey % 4 AS len FROM lineitem),
inst AS (SELECT *, row_number() OVER (PARTITION BY pano ORDER BY frame, det_no) + 1 AS instance_id FROM det0 JOIN known USING (class)),
frames AS (SELECT CAST(f AS BIGINT) AS frame, r AS fr, c AS fc, (r + f) % 14 AS pr, (c * 2 + f) % 16 AS pc FROM (SELECT unnest(range(20)) AS f), (SELECT unnest(range(12)) AS r), (SELECT unnest(range(12)) AS c)),
last AS (SELECT frame, pr AS r, pc AS c, fr, fc FROM frames QUALIFY row_number() OVER (PARTITION BY frame, pr, pc ORDER BY fr * 1000000 + fc DESC) = 1),
cells AS (SELECT pano, frame, instance_id, class, score, fr, start + unnest(range(len)) AS fc FROM inst),
hits AS (SELECT pano, frame, r, c, instance_id, class, score FROM cells JOIN last USING (frame, fr, fc)),
cover AS (SELECT pano, frame, r, c FROM (SELECT DISTINCT pano, frame FROM det0) JOIN last USING (frame)),
n AS (SELECT pano, frame, count(DISTINCT det_no) AS n FROM det0 GROUP BY ALL),
hn AS (SELECT pano, frame, r, c, count(DISTINCT instance_id) AS k FROM hits GROUP BY ALL)"""


def _detections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    line = _read(spark, sf_dir, "lineitem")
    run = F.struct((F.col("l_partkey") % 12).cast("int").alias("r"), F.col("l_linenumber").cast("int").alias("start"), (F.col("l_suppkey") % 4 + 1).cast("int").alias("len"))
    found = line.select(
        F.col("l_suppkey").alias("pano"), (F.col("l_orderkey") % 20).alias("frame"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")).alias("det_no"), (F.lit(57) + F.col("l_partkey") % 4).cast("int").alias("class"),
        (F.col("l_quantity") / 50.0).alias("score"), F.array(run).alias("mask"),
    )
    few = lambda name, k: spark.range(k).withColumnRenamed("id", name)
    frames = few("frame", 20).crossJoin(F.broadcast(few("fr", 12))).crossJoin(F.broadcast(few("fc", 12)))
    return found, frames.select("frame", F.col("fr").cast("int").alias("fr"), F.col("fc").cast("int").alias("fc"), ((F.col("fr") + F.col("frame")) % 14).alias("pr"), ((F.col("fc") * 2 + F.col("frame")) % 16).alias("pc"))


@query(f"WITH {DETECTED} SELECT pano, frame, r, c, instance_id, class FROM hits")
def label_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, frames = _detections(spark, sf_dir)
    return pano.transfer(pano.globalise(found), frames, found.select("pano", "frame"))[1].select("pano", "frame", "r", "c", "instance_id", "class")


# --- scans and exports -------------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    """A folder that lasts as long as the session."""
    stages = Stages(spark, name)
    stages.save(spark.range(1), "made")
    return stages.root


@query("SELECT 'c' || s_suppkey AS camera, s_acctbal AS tx, CAST(s_nationkey AS DOUBLE) AS ty, 1.5 AS tz, 0.0 AS qx, 0.0 AS qy, 0.5 AS qz, 1.0 AS qw FROM supplier")
def pose_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pose lines written and read; each camera's line is followed by a later one that counts."""
    text = lambda x: F.concat_ws(",", F.concat(F.lit("c"), F.col("s_suppkey")), x, F.col("s_nationkey"), F.lit("1.5, 0.0,0.0 ,0.5,1.0"))
    rows = _read(spark, sf_dir, "supplier").select(F.explode(F.array(F.struct(F.lit(0).alias("k"), text(F.lit("-1")).alias("t")), F.struct(F.lit(1).alias("k"), text(F.col("s_acctbal")).alias("t")))).alias("e"))
    path = f"{_folder(spark, 'poses')}/poses"
    rows.select("e.*").coalesce(1).sortWithinPartitions("k").select("t").write.text(path)
    return readers.read_poses(spark, f"{path}/*.txt")


@query("SELECT n_name AS model, CASE n_nationkey % 2 WHEN 0 THEN 'tiny' ELSE 'medium' END AS split, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE CAST(n_regionkey AS INTEGER) END AS floors, CASE WHEN n_nationkey % 3 <> 0 THEN 'home' END AS bldg_function FROM nation")
def building_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "nation").select(
        "n_name", F.lit("u-1").alias("model_uuid"), F.when(F.col("n_nationkey") % 2 == 0, "tiny").otherwise("medium").alias("any_split"),
        F.when(F.col("n_nationkey") % 5 == 0, "unknown").otherwise(F.col("n_regionkey").cast("string")).alias("floors"), F.when(F.col("n_nationkey") % 3 != 0, "home").alias("bldg_function"),
    )
    path = f"{_folder(spark, 'buildings')}/csv"
    rows.write.option("header", True).csv(path)
    return readers.read_buildings(spark, path)


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS idx, CAST(n_nationkey * 10 % 256 AS INTEGER) AS r, CAST(n_nationkey * 7 % 256 AS INTEGER) AS g, CAST(n_regionkey AS INTEGER) AS b FROM nation")
def palette_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark, 'palette')}/text"
    line = F.concat_ws(",", F.col("n_nationkey") * 10 % 256, F.col("n_nationkey") * 7 % 256, "n_regionkey")
    _read(spark, sf_dir, "nation").select("n_nationkey", line.alias("t")).coalesce(1).sortWithinPartitions("n_nationkey").select("t").write.text(path)
    return vocabulary.read_palette(spark, f"{path}/*.txt")


def _mesh_lines(points: DataFrame) -> DataFrame:
    labels = _strip(points).where("face_id % 3 <> 0").select("face_id", F.concat(F.lit("room_"), F.col("face_id") % 4).alias("material"))
    return export.obj_lines(points.withColumnRenamed("vec_id", "vertex_id"), _strip(points), labels)


MESH_LINES = f"""{P}, top AS (SELECT max(vec_id) AS m FROM p), n AS (SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 'background' ELSE 'room_' || (vec_id % 4) END AS mat FROM p, top WHERE vec_id + 2 <= m),
lines AS (SELECT 0 AS section, printf('%020d', vec_id) AS k1, 0 AS k2, '' AS k3, printf('v %.8f %.8f %.8f', x, y, z) AS text FROM p UNION ALL SELECT DISTINCT 1, mat, 0, '', 'usemtl ' || mat FROM n
  UNION ALL SELECT 1, mat, 1, printf('%020d', id), 'f ' || (id + 1) || ' ' || (id + 2) || ' ' || (id + 3) FROM n)"""


@query(f"WITH {MESH_LINES} SELECT row_number() OVER (ORDER BY section, k1, k2, k3) - 1 AS line_no, text FROM lines")
def obj_lines_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coloured mesh file written, and its lines read back in the order of the file."""
    path = f"{_folder(spark, 'mesh')}/obj"
    export.write_obj(_mesh_lines(_points(spark, sf_dir)), path)
    return export.read_lines(spark, path)


@query(f"""WITH {P}, o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS vertex_id, CAST(printf('%.8f', x) AS DOUBLE) AS x, CAST(printf('%.8f', y) AS DOUBLE) AS y, CAST(printf('%.8f', z) AS DOUBLE) AS z FROM p), n AS (SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 'background' ELSE 'room_' || (vec_id % 4) END AS mat FROM p, (SELECT max(vec_id) AS m FROM p) WHERE vec_id + 2 <= m)
SELECT 'v' AS kind, vertex_id AS id, round(x, 6) + 0.0 AS a, round(-z, 6) + 0.0 AS b, round(y, 6) + 0.0 AS c FROM o
UNION ALL SELECT 'f', row_number() OVER (ORDER BY mat, id) - 1, id, id + 1, id + 2 FROM n""")
def obj_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark, 'scan')}/obj"
    _mesh_lines(_points(spark, sf_dir)).coalesce(1).sortWithinPartitions("section", "key").select("text").write.text(path)
    vertices, faces = mesh.read_obj(spark, f"{path}/*.txt")
    corners = faces.select(F.lit("f").alias("kind"), F.col("face_id").alias("id"), *[F.col(v).cast("double").alias(n) for v, n in zip(("v0", "v1", "v2"), "abc", strict=True)])
    return vertices.select(F.lit("v").alias("kind"), F.col("vertex_id").alias("id"), *[_round(F.col(x)).alias(n) for x, n in zip("xyz", "abc", strict=True)]).unionByName(corners)


@query(f"WITH {V} SELECT inst, first(class ORDER BY face, class) AS class, count(*) AS n_faces FROM (SELECT DISTINCT face, inst, min(class) OVER (PARTITION BY face, inst) AS class FROM v WHERE class > 1) GROUP BY inst")
def labelled_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = _votes(spark, sf_dir)
    faces = votes.where("class > 1").groupBy("face", "inst").agg(F.min("class").alias("class"))
    empty = votes.where("class = 1").select("face", F.lit(-1).cast("bigint").alias("inst"), F.lit(-1).cast("bigint").alias("class")).distinct()
    return mesh.labelled_instances(faces.unionByName(empty).withColumnRenamed("face", "face_id"))


@query(f"WITH {P} SELECT vec_id || ' ' || label AS line FROM p")
def point_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark, 'points')}/text"
    export.write_points(_points(spark, sf_dir).select("vec_id", "label"), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("SELECT n_nationkey, n_name FROM nation")
def staged_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finished stage is not built again: the second call's table would be empty."""
    path, rows = f"{_folder(spark, 'stage')}/t", _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    export.stage(spark, path, lambda: rows)
    return export.stage(spark, path, lambda: rows.limit(0))


@query("SELECT n_nationkey, n_regionkey + 100 AS n_regionkey FROM nation")
def attribute_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.get_attribute(export.set_attribute(_read(spark, sf_dir, "nation"), "n_regionkey", F.col("n_regionkey") + 100), "n_regionkey")


@query("SELECT p_partkey, l.s AS low FROM part LEFT JOIN (SELECT p_brand, min(p_size) AS s FROM part WHERE p_size > 20 AND p_brand <> 'Brand#2' GROUP BY p_brand) l USING (p_brand)")
def attribute_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _read(spark, sf_dir, "part")
    known = parts.where("p_size > 20 and p_brand <> 'Brand#2'").groupBy("p_brand").agg(F.min("p_size").alias("low"))
    return joins.with_defaults(parts.select("p_partkey", "p_brand"), known, ["p_brand"]).select("p_partkey", "low")


# --- buildings: labels are objects, even and odd ones two buildings ----------------------------

BUILT = f"{P}, q AS (SELECT label % 2 AS building, label // 2 AS object_id, x, y, z, vec_id FROM p)"
EYES = "eyes AS (SELECT unnest([0, 0, 1, 1]) AS building, unnest([1, 2, 1, 2]) AS camera_id, unnest([0.9, -0.2, 0.4, -0.9]) AS ex, unnest([-0.7, 0.3, -0.1, 0.8]) AS ey, unnest([0.3, 0.1, -0.3, 0.2]) AS ez)"


def _built(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points, objects and cameras of two buildings; ids restart in each."""
    points = _points(spark, sf_dir).select((F.col("label") % 2).alias("building"), F.expr("label div 2").alias("object_id"), "vec_id", *XYZ)
    box = aggregate.bounding_box(points, ["building", "object_id"])
    vec = lambda n: F.array(*[F.col(f"{n}_{a}") for a in "xyz"]).alias(n)
    objects = box.select("building", F.col("object_id").alias("id"), vec("location"), vec("size"), (F.col("size_x") * F.col("size_y") * F.col("size_z")).alias("volume"), (F.col("size_x") * F.col("size_y")).alias("floor_area"))
    spots = [(0, 1, 0.9, -0.7, 0.3), (0, 2, -0.2, 0.3, 0.1), (1, 1, 0.4, -0.1, -0.3), (1, 2, -0.9, 0.8, 0.2)]
    cameras = spark.createDataFrame([(b, c, [x, y, z], [0.0, 0.0, 0.0]) for b, c, x, y, z in spots], "building int, id int, location array<double>, rotation array<double>")
    return points, objects, cameras


@query(f"""WITH {BUILT}, s AS (SELECT building, object_id, max(x) - min(x) AS sx, max(y) - min(y) AS sy, max(z) - min(z) AS sz FROM q GROUP BY ALL)
SELECT a.building, a.object_id AS a, b.object_id AS b, round(a.sx * a.sy * a.sz / (b.sx * b.sy * b.sz), 6) AS ratio_volume, round(a.sx * a.sy / (b.sx * b.sy), 6) AS ratio_floor_area, round(a.sz / b.sz, 6) AS ratio_size_z
FROM s a JOIN s b ON a.building = b.building AND a.object_id <> b.object_id""")
def building_magnitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layers.relationships(*_built(spark, sf_dir))["rel_magnitude"]
    return found.select("building", F.col("a_object_id").alias("a"), F.col("b_object_id").alias("b"), *[_round(F.col(f"ratio_{m}")).alias(f"ratio_{m}") for m in ("volume", "floor_area", "size_z")])


@query(f"""WITH {BUILT}, {EYES}, d AS (SELECT q.*, camera_id, ex, ey, abs(y + 0.0 + ey) AS d FROM q JOIN eyes USING (building)),
near AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY building, camera_id, object_id ORDER BY d, x, y, z) = 1),
o AS (SELECT building, object_id, min(z) AS low, min(x) + (max(x) - min(x)) / 2 AS lx, min(y) + (max(y) - min(y)) / 2 AS ly FROM q GROUP BY ALL),
t AS (SELECT building, camera_id, object_id, low, lx, ly, x, y, z, d, ex, ey FROM o JOIN near USING (building, object_id)),
pr AS (SELECT a.building, a.camera_id, a.object_id AS a, b.object_id AS b, abs(a.x - b.x) < 0.1 OR abs(a.y - b.y) < 0.1 OR abs(a.z - b.z) < 0.1 AS close, a.d AS d1, b.d AS d2, a.low AS low1, b.low AS low2,
  (a.lx - a.ex) * (b.ly - a.ey) - (a.ly - a.ey) * (b.lx - a.ex) AS turn FROM t a JOIN t b ON a.building = b.building AND a.camera_id = b.camera_id AND a.object_id <> b.object_id)
SELECT building, CAST(camera_id AS INTEGER) AS camera_id, a, b, CASE WHEN NOT close THEN CASE WHEN d1 < d2 THEN 'behind' ELSE 'in front' END END AS depth, CASE WHEN NOT close THEN CASE WHEN low2 < low1 THEN 'bottom' ELSE 'top' END END AS vertical,
  CASE WHEN NOT close THEN CASE WHEN turn > 0 THEN 'left' ELSE 'right' END END AS lateral FROM pr""")
def building_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.relationships(*_built(spark, sf_dir))["rel_spatial"].select("building", "camera_id", "a", "b", "depth", "vertical", "lateral")


@query("""WITH h AS (SELECT l_suppkey % 2 AS building, l_linenumber % 2 AS camera_id, l_orderkey AS ray, l_suppkey // 2 % 7 AS obj, l_quantity AS t, l_partkey AS face FROM lineitem),
f AS (SELECT building, camera_id, ray, obj, min((t, face)) AS at_ FROM h GROUP BY ALL),
v AS (SELECT building, camera_id, a.obj AS a, b.obj AS b, a.at_ < b.at_ AS first FROM f a JOIN f b USING (building, camera_id, ray) WHERE a.obj <> b.obj)
SELECT building, CAST(camera_id AS INTEGER) AS camera_id, a, b, CASE WHEN 2 * sum(CASE WHEN first THEN 1 ELSE 0 END) > count(*) THEN 'occluding' ELSE 'occluded' END AS relation FROM v GROUP BY ALL""")
def building_occlusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _read(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 2).alias("building"), (F.col("l_linenumber") % 2).cast("int").alias("camera_id"), F.col("l_orderkey").alias("ray_id"), (F.expr("l_suppkey div 2") % 7).alias("object_id"),
        F.col("l_quantity").alias("t"), F.col("l_partkey").alias("face_id"),
    )
    return layers.relationships(*_built(spark, sf_dir), hits)["rel_occlusion"]


@query(f"""WITH {BUILT}, {EYES}, d AS (SELECT building, camera_id, object_id AS room_id, min(sqrt((x - ex) * (x - ex) + (y - ey) * (y - ey) + (z - ez) * (z - ez))) AS d FROM q JOIN eyes USING (building) GROUP BY ALL)
SELECT building, CAST(camera_id AS INTEGER) AS camera_id, room_id FROM d QUALIFY row_number() OVER (PARTITION BY building, camera_id ORDER BY d, room_id DESC) = 1""")
def building_camera_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, _, cameras = _built(spark, sf_dir)
    voxels = points.select("building", F.col("object_id").alias("room_id"), *[F.col(a).alias(f"c{a}") for a in "xyz"])
    cams = cameras.select("building", F.col("id").alias("camera_id"), *[F.col("location")[k].alias(a) for k, a in enumerate("xyz")])
    return relations.camera_room(cams, voxels, ("building",)).select("building", "camera_id", "room_id")


@query(f"""WITH {BUILT}, {EYES} SELECT building, vec_id AS face_id, CAST(camera_id AS INTEGER) AS pano, round(sqrt((x - ex) * (x - ex) + (y - ey) * (y - ey) + (z - ez) * (z - ez)), 6) AS distance FROM q JOIN eyes USING (building)""")
def building_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, _, cameras = _built(spark, sf_dir)
    poses = cameras.select("building", F.col("id").alias("camera"), *[F.col("location")[k].alias(f"t{a}") for k, a in enumerate("xyz")])
    found = fusion.face_distances(points.select("building", F.col("vec_id").alias("face_id"), *XYZ), poses)
    return found.withColumn("distance", _round(F.col("distance")))


@query(f"""WITH {BUILT}, {EYES}, d AS (SELECT building, camera_id, object_id, min(sqrt((x - ex) * (x - ex) + (y - ey) * (y - ey) + (z - ez) * (z - ez))) AS d FROM q JOIN eyes USING (building) GROUP BY ALL),
r AS (SELECT building, camera_id, object_id AS parent_room FROM d QUALIFY row_number() OVER (PARTITION BY building, camera_id ORDER BY d, object_id DESC) = 1)
SELECT building, row_number() OVER (PARTITION BY building ORDER BY camera_id DESC) AS id, 'c' || (9 - camera_id) AS name, round(ex, 6) AS x, 0.0 AS rx, 'RGB' AS modality, parent_room FROM r JOIN eyes USING (building, camera_id)""")
def camera_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, _, cameras = _built(spark, sf_dir)
    voxels = points.select("building", F.col("object_id").alias("room_id"), *[F.col(a).alias(f"c{a}") for a in "xyz"])
    named = cameras.select("building", F.concat(F.lit("c"), 9 - F.col("id")).alias("camera"), *[F.col("location")[k].alias(a) for k, a in enumerate("xyz")], F.lit(1.5).alias("fov"), *[F.lit(q).alias(n) for n, q in zip(("qw", "qx", "qy", "qz"), (1.0, 0.0, 0.0, 0.0), strict=True)])
    out = layers.camera_layer(named, voxels)
    return out.select("building", "id", "name", F.col("location")[0].alias("x"), _round(F.col("rotation")[0]).alias("rx"), "modality", "parent_room")


@query(f"""WITH {BUILT}, n AS (SELECT building, count(DISTINCT object_id) AS k FROM q GROUP BY building)
SELECT building, row_number() OVER (ORDER BY building) AS id, k AS num_rooms, CAST(2 AS BIGINT) AS num_cameras, k AS num_objects FROM n""")
def layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, objects, cameras = _built(spark, sf_dir)
    return layers.assemble(objects.select("building").distinct(), objects, cameras, objects)["building"].select("building", "id", "num_rooms", "num_cameras", "num_objects")


@query(f"""WITH {P}, b AS (SELECT label % 2 AS building, min(x) AS ax, max(x) - min(x) AS sx, min(y) AS ay, max(y) - min(y) AS sy, min(z) AS az, max(z) - min(z) AS sz FROM p GROUP BY ALL)
SELECT building, round(ax + sx / 2, 6) + 0.0 AS location_x, round(sz, 6) AS size_z, CAST(ceil(sx / 0.1) AS BIGINT) AS res_x, CAST(ceil(sz / 0.1) AS BIGINT) AS res_z, CASE building WHEN 0 THEN 'tiny' END AS split, CASE building WHEN 0 THEN 3 END AS num_floors FROM b""")
def building_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _built(spark, sf_dir)[0]
    names = spark.createDataFrame([(0, "tiny", "home", 3)], "model int, split string, bldg_function string, floors int")
    out = layers.building_layer(points, names)
    return out.select("building", _round(F.col("location")[0]).alias("location_x"), _round(F.col("size")[2]).alias("size_z"), F.col("voxel.resolution")[0].alias("res_x"), F.col("voxel.resolution")[2].alias("res_z"), "split", "num_floors")


@query(f"""WITH {P}, cam AS (SELECT unnest([1, 2]) AS camera, unnest([0.9, -0.4]) AS tx, unnest([-0.7, 0.1]) AS ty, unnest([0.3, -0.2]) AS tz),
u AS (SELECT vec_id, camera, x - tx AS x, y - ty AS y, z - tz AS z FROM p, cam), w AS (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM u), t AS (SELECT *, -asin(z / n) AS down FROM w),
s AS (SELECT *, acos(greatest(-1.0, least(1.0, y / n / cos(down)))) AS turn FROM t), q AS (SELECT *, CASE WHEN sin(turn) * cos(down) * x < 0 THEN -turn ELSE turn END AS around FROM s),
pix AS (SELECT vec_id, camera, n, CAST(trunc(down * (64 / pi())) + 32 AS INTEGER) AS r, CAST(trunc(around * (128 / (2 * pi()))) + 64 AS INTEGER) AS c FROM q),
seen AS (SELECT vec_id // 4 AS face_id, camera AS pano, (r + c) % 5 AS class, (r * 3 + c) % 7 AS inst FROM pix WHERE r >= 0 AND r < 64 AND c >= 0 AND c < 128 AND abs(n - 1.0) <= 0.35),
n1 AS (SELECT face_id, pano, class, count(*) AS k FROM seen GROUP BY ALL), won AS (SELECT face_id, pano, class FROM n1 QUALIFY row_number() OVER (PARTITION BY face_id, pano ORDER BY k DESC, class) = 1),
n2 AS (SELECT face_id, pano, inst, count(*) AS k FROM seen JOIN won USING (face_id, pano, class) WHERE inst <> 0 GROUP BY ALL), own AS (SELECT face_id, pano, inst FROM n2 QUALIFY row_number() OVER (PARTITION BY face_id, pano ORDER BY k DESC, inst) = 1)
SELECT face_id, CAST(pano AS INTEGER) AS pano, class, coalesce(inst, 0) AS inst FROM won LEFT JOIN own USING (face_id, pano)""")
def mesh_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points vote for the faces that four of them make up, where the depth image has one depth for all."""
    points = _points(spark, sf_dir).select(F.lit(1).alias("building"), F.expr("vec_id div 4").alias("face_id"), *XYZ)
    poses = spark.createDataFrame([(1, 1, 0.9, -0.7, 0.3, 1.0, 0.0, 0.0, 0.0), (1, 2, -0.4, 0.1, -0.2, 1.0, 0.0, 0.0, 0.0)], "building int, camera int, tx double, ty double, tz double, qw double, qx double, qy double, qz double")
    image = spark.range(2).select(F.lit(1).alias("building"), (F.col("id") + 1).cast("int").alias("pano"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("r")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(127))))
    pixels = image.select("*", ((F.col("r") + F.col("c")) % 5).alias("class"), ((F.col("r") * 3 + F.col("c")) % 7).alias("inst"))
    found = fusion.register(points, poses, pixels, image.withColumn("value", F.lit(512)), 64, 128, tolerance=0.35)
    return found.select("face_id", "pano", "class", "inst")


@query("""WITH f AS (SELECT l_partkey AS face_id, l_linenumber - 1 AS class, l_orderkey % 9 AS inst, l_suppkey % 4 AS pano, l_quantity AS d FROM lineitem),
one AS (SELECT face_id, pano, min(class) AS class, min(inst) AS inst FROM f GROUP BY ALL), far AS (SELECT face_id, pano, min(d) AS d FROM f GROUP BY ALL), w AS (SELECT face_id, pano, sum(d) OVER (PARTITION BY face_id) / d AS w FROM far),
v AS (SELECT face_id, class, w, CASE WHEN class = 0 THEN -1 ELSE pano * 100 + inst END AS i FROM one JOIN w USING (face_id, pano)),
s1 AS (SELECT face_id, class, sum(w) AS s FROM v GROUP BY ALL), r1 AS (SELECT face_id, class AS won FROM s1 QUALIFY row_number() OVER (PARTITION BY face_id ORDER BY s DESC, class) = 1),
lab AS (SELECT i, class AS lab FROM v QUALIFY row_number() OVER (PARTITION BY i ORDER BY face_id, class) = 1), m AS (SELECT DISTINCT i, face_id, lab FROM v JOIN lab USING (i)),
kept AS (SELECT i FROM m JOIN r1 USING (face_id) GROUP BY i HAVING avg(CASE WHEN won = lab THEN 1.0 ELSE 0.0 END) >= 0.3),
s3 AS (SELECT face_id, class, sum(w) AS s FROM v WHERE i IN (SELECT i FROM kept) GROUP BY ALL)
SELECT face_id, class FROM s3 QUALIFY row_number() OVER (PARTITION BY face_id ORDER BY s DESC, class) = 1""")
def mesh_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select(F.lit(1).alias("building"), F.col("l_partkey").alias("face_id"), (F.col("l_linenumber").cast("bigint") - 1).alias("class"), (F.col("l_orderkey") % 9).alias("inst"), (F.col("l_suppkey") % 4).alias("pano"), "l_quantity")
    keys = ["building", "face_id", "pano"]
    votes = rows.groupBy(*keys).agg(F.min("class").alias("class"), F.min("inst").alias("inst"))
    far = rows.groupBy(*keys).agg(F.min("l_quantity").cast("double").alias("distance"))
    return fusion.face_classes(votes, far, 0.3).select("face_id", "class")


@query(f"""WITH {P}, cam AS (SELECT unnest([1, 2]) AS camera, unnest([0.9, -0.4]) AS tx, unnest([-0.7, 0.1]) AS ty, unnest([0.3, -0.2]) AS tz),
u AS (SELECT vec_id, camera, x - tx AS x, y - ty AS y, z - tz AS z FROM p, cam), w AS (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM u), t AS (SELECT *, -asin(z / n) AS down FROM w),
s AS (SELECT *, acos(greatest(-1.0, least(1.0, y / n / cos(down)))) AS turn FROM t), q AS (SELECT *, CASE WHEN sin(turn) * cos(down) * x < 0 THEN -turn ELSE turn END AS around FROM s),
pix AS (SELECT vec_id, camera AS pano, CAST(trunc(down * (16 / pi())) + 8 AS INTEGER) AS r, CAST(trunc(around * (32 / (2 * pi()))) + 16 AS INTEGER) AS c FROM q),
face AS (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN -1 WHEN vec_id % 10 = 1 THEN 0 ELSE 1 + vec_id // 50 % 3 END AS class, vec_id // 50 % 6 AS inst FROM p),
paint AS (SELECT pano, r, c, CASE class WHEN 0 THEN 0 ELSE inst END AS inst FROM pix JOIN face USING (vec_id) WHERE class <> -1 AND r BETWEEN 0 AND 15 AND c BETWEEN 0 AND 31 QUALIFY row_number() OVER (PARTITION BY pano, r, c ORDER BY vec_id DESC) = 1),
hole AS (SELECT pano, a.r, b.c FROM (SELECT DISTINCT pano FROM paint), (SELECT unnest(range(16)) AS r) a, (SELECT unnest(range(32)) AS c) b EXCEPT SELECT pano, r, c FROM paint),
whole AS (SELECT * FROM paint UNION ALL SELECT hole.pano, hole.r, hole.c, first(inst ORDER BY (hole.r - paint.r) ** 2 + (hole.c - paint.c) ** 2, paint.r, paint.c) FROM hole JOIN paint ON hole.pano = paint.pano GROUP BY ALL),
n AS (SELECT inst, class, count(*) AS k FROM face WHERE class > 0 GROUP BY ALL), lab AS (SELECT inst, class FROM n QUALIFY row_number() OVER (PARTITION BY inst ORDER BY k DESC, class) = 1)
SELECT CAST(pano AS INTEGER) AS pano, r, c, inst, coalesce(class, 0) AS class FROM whole LEFT JOIN lab USING (inst)""")
def back_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir).select(F.lit(1).alias("building"), F.col("vec_id").alias("point_id"), F.col("vec_id").alias("face_id"), *XYZ)
    poses = spark.createDataFrame([(1, 1, 0.9, -0.7, 0.3, 1.0, 0.0, 0.0, 0.0), (1, 2, -0.4, 0.1, -0.2, 1.0, 0.0, 0.0, 0.0)], "building int, camera int, tx double, ty double, tz double, qw double, qx double, qy double, qz double")
    group = F.expr("face_id div 50")
    faces = points.select("building", "face_id", F.when(F.col("face_id") % 10 == 0, -1).when(F.col("face_id") % 10 == 1, 0).otherwise(1 + group % 3).alias("class"), (group % 6).alias("inst"))
    return fusion.back_project(points, poses, faces, 16, 32, opening=1).select("pano", "r", "c", "inst", "class")


NEAR = f"""d AS (SELECT a.vec_id, b.vec_id AS o, row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), b.vec_id) AS k FROM p a, p b WHERE a.vec_id % 5 = 0),
cl AS (SELECT vec_id, label AS cluster FROM p UNION ALL SELECT vec_id, (label + 1) % 10 FROM p WHERE vec_id % 5 = 0)"""


@query(f"""WITH {P}, {NEAR}, reg AS (SELECT vec_id, label AS lo, (label + 1) % 10 AS hi, least(label, (label + 1) % 10) AS a, greatest(label, (label + 1) % 10) AS b FROM p WHERE vec_id % 5 = 0),
around AS (SELECT DISTINCT a, b, o FROM reg JOIN d USING (vec_id) WHERE k <= 20 AND o % 5 <> 0),
sup AS (SELECT a, b, label AS cluster, count(*) AS n FROM around JOIN p ON p.vec_id = o WHERE label IN (a, b) GROUP BY ALL),
pick AS (SELECT a, b, cluster FROM (SELECT DISTINCT a, b, unnest([a, b]) AS cluster FROM reg) LEFT JOIN sup USING (a, b, cluster) QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY coalesce(n, 0) DESC, cluster) = 1)
SELECT vec_id, label AS cluster FROM p WHERE vec_id % 5 <> 0 UNION ALL SELECT vec_id, cluster FROM reg JOIN pick USING (a, b)""")
def overlap_arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth point is claimed by two clusters."""
    points = _points(spark, sf_dir)
    claims = points.select("vec_id", F.col("label").alias("cluster")).unionByName(points.where("vec_id % 5 = 0").select("vec_id", ((F.col("label") + 1) % 10).alias("cluster")))
    near = joins.knn(points.where("vec_id % 5 = 0"), points.withColumnRenamed("vec_id", "neighbour"), "vec_id", "neighbour", XYZ, 20)
    return relations.arbitrate(claims, near.select("vec_id", "neighbour"), [], "vec_id", "cluster")
