"""Multi-view fusion on the mesh: registration, voting, instances, fill, back-projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import geometry as g
from orrery.functions import vocabulary
from orrery.operators import aggregate, graph, joins, raster, relations, vote

POINTS_PER_FACE = 5


def poses_with_matrix(poses: DataFrame) -> DataFrame:
    """Poses with the cells m00 .. m22 of their rotation matrix."""
    m = g.quaternion_matrix(*[F.col(c) for c in ("qw", "qx", "qy", "qz")])
    return poses.select("*", *[m[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(3)])


def project(points: DataFrame, poses: DataFrame, height: int, width: int) -> DataFrame:
    """Each point in each panorama of its building: point columns, pano, r, c, distance. A building's
    panoramas are few and are broadcast behind a check of their number."""
    cams = poses_with_matrix(poses)
    cams = F.broadcast(cams) if cams.count() <= joins.BROADCAST_ROWS else cams
    rows = points.join(cams, "building")
    matrix = tuple(tuple(F.col(f"m{i}{j}") for j in range(3)) for i in range(3))
    local = g.row_times(g.minus(g.vector("x", "y", "z"), g.vector("tx", "ty", "tz")), matrix)
    r, c = g.equirect_pixel(local, height, width)
    seen = rows.select(*points.columns, F.col("camera").alias("pano"), r.alias("r"), c.alias("c"), g.norm(local).alias("distance"))
    return seen.where(g.in_frame(F.col("r"), F.col("c"), height, width))


def register(points: DataFrame, poses: DataFrame, pixels: DataFrame, mist: DataFrame, height: int, width: int, tolerance: float = 0.01, reach: float = 6.0) -> DataFrame:
    """Building, face_id, pano, class, inst: what each panorama says of each face.

    ``pixels`` (building, pano, r, c, class, inst) are at full size, ``mist`` (building, pano, r, c,
    value) is the depth image. Points vote for their face's class; the instance is the most
    frequent one of that class.
    """
    seen = project(points, poses, height, width)
    seen = seen.join(mist.select("building", "pano", "r", "c", g.depth(F.col("value")).alias("depth")), ["building", "pano", "r", "c"])
    seen = seen.where(g.depth_agrees(F.col("distance"), F.col("depth"), tolerance, reach))
    labelled = seen.join(pixels, ["building", "pano", "r", "c"]).select("building", "face_id", "pano", "class", "inst")
    keys = ["building", "face_id", "pano"]
    winners = vote.majority(labelled, keys, "class")
    picked = vote.face_instance(labelled, winners, keys, "inst", "class")
    return winners.join(picked, keys, "left").withColumn("inst", F.coalesce("inst", F.lit(0)))


def face_classes(face_votes: DataFrame, distances: DataFrame, share: float = 0.65) -> DataFrame:
    """Building, face_id, class by the three-round vote with inverse-distance weights.

    Weights are fractions whose sums depend on the order of addition, and equal ones decide: they are added in one order.
    """
    keys = ["building", "face_id"]
    weighed = distances.withColumn("w", vote.inverse_distance(distances, keys, "distance"))
    faces = aggregate.identified(face_votes, keys, "face")
    instances = aggregate.identified(face_votes, ["building", "pano", "inst"], "i")
    rows = face_votes.join(weighed, [*keys, "pano"]).join(faces, keys).join(instances, ["building", "pano", "inst"])
    final = vote.three_rounds(rows.select("face", "i", "class", "w"), "face", "i", "class", "w", share, vote.ordered_sum)
    return faces.join(final, "face").select(*keys, "class")


def face_distances(faces: DataFrame, poses: DataFrame) -> DataFrame:
    """The distance of each face's midpoint (building, face_id, x, y, z) to each panorama."""
    cams = poses.select("building", F.col("camera").alias("pano"), "tx", "ty", "tz")
    cams = F.broadcast(cams) if cams.count() <= joins.BROADCAST_ROWS else cams
    d = g.norm(g.minus(g.vector("x", "y", "z"), g.vector("tx", "ty", "tz")))
    return faces.join(cams, "building").select("building", "face_id", "pano", d.alias("distance"))


def discover(face_votes: DataFrame, eroded_votes: DataFrame, classes: DataFrame, midpoints: DataFrame, neighbours: int = 200) -> DataFrame:
    """Building, face_id, class, inst. Instances of different panoramas that meet on a face, by their
    eroded labels, are one object; its extent is by the full labels. Objects need more faces than
    their class's least number, unless no other instance takes part. Contested faces are arbitrated.
    """
    seen = ["building", "pano", "inst"]
    names = aggregate.identified(face_votes.select(*seen).unionByName(eroded_votes.select(*seen)), seen, "node")
    of = lambda votes: votes.where("inst <> 0 and class > 0").join(names, seen).select("building", "face_id", "class", "node")
    final = classes.where("class > 0")
    joined = lambda votes: of(votes).join(final, ["building", "face_id", "class"])
    nodes = graph.instance_clusters(joined(eroded_votes), "node", ["building", "class", "face_id"])
    extent = joined(face_votes).join(nodes, "node").select("building", "face_id", "class", "component", "node")
    limits = vocabulary.classes(face_votes.sparkSession).select("class", "min_faces")
    sizes = extent.groupBy("building", "class", "component").agg(F.count_distinct("face_id").alias("n"), F.count_distinct("node").alias("nodes"))
    single = sizes.groupBy("building", "class").agg(F.sum("nodes").alias("all"))
    kept = sizes.join(single, ["building", "class"]).join(F.broadcast(limits), "class", "left")
    kept = kept.where((F.col("n") > F.coalesce("min_faces", F.lit(0))) | (F.col("all") == 1))
    order = Window.partitionBy("building").orderBy("class", "component")
    kept = kept.select("building", "class", "component", ((F.row_number().over(order) - 1) * 10 + 1).cast("bigint").alias("inst"))
    claims = extent.join(kept, ["building", "class", "component"]).select("building", "face_id", "class", "inst").distinct()
    contested = claims.groupBy("building", "face_id").count().where("count > 1").select("building", "face_id")
    near = joins.knn(
        contested.join(midpoints, ["building", "face_id"]), claims.select("building", F.col("face_id").alias("neighbour")).distinct().join(midpoints.withColumnRenamed("face_id", "neighbour"), ["building", "neighbour"]),
        "face_id", "neighbour", ("x", "y", "z"), neighbours, on=("building",),
    )
    settled = relations.arbitrate(claims, near.select("building", "face_id", "neighbour"), ["building"], "face_id", "inst")
    return settled.join(claims, ["building", "face_id", "inst"])


def refine(instances: DataFrame, faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Each instance cut into its dense parts (G4, G5); parts above the class's least size get fresh
    ids, and faces that drop out get class -1."""
    corners = instances.join(faces, ["building", "face_id"]).withColumn("vertex_id", F.explode(F.array("v0", "v1", "v2")))
    points = corners.join(vertices, ["building", "vertex_id"]).select("building", "inst", "class", "vertex_id", "face_id", "x", "y", "z")
    names = vocabulary.classes(instances.sparkSession).select("class", "name", "min_faces")
    box = aggregate.bounding_box(points, ["building", "inst"]).select("building", "inst", "size_x", "size_y")
    radius = box.join(instances.select("building", "inst", "class").distinct(), ["building", "inst"]).join(F.broadcast(names), "class")
    radius = radius.select("building", "inst", vocabulary.cluster_radius(F.col("name"), F.col("size_x"), F.col("size_y")).alias("eps"))
    node = ["building", "inst", "vertex_id"]
    spots = points.join(aggregate.identified(points, node, "node"), node).select("building", "inst", "node", "face_id", "x", "y", "z").join(radius, ["building", "inst"])
    near = joins.radius_join(spots.dropDuplicates(["node"]), "node", ("x", "y", "z"), F.col("eps"), on=("building", "inst"))
    own = spots.groupBy("building", "inst", "face_id").agg(F.min("node").alias("head"))
    ties = spots.join(own, ["building", "inst", "face_id"]).select(F.col("head").alias("a"), F.col("node").alias("b"))
    part = graph.components(near.select("a", "b").unionByName(ties), "a", "b")
    placed = own.join(part.withColumnRenamed("node", "head"), "head").join(instances, ["building", "inst", "face_id"]).join(F.broadcast(names), "class", "left")
    sizes = Window.partitionBy("building", "inst", "component")
    placed = placed.withColumn("ok", F.count("*").over(sizes) > F.coalesce("min_faces", F.lit(0)))
    order = placed.where("ok").select("building", "class", "inst", "component").distinct()
    order = order.withColumn("new", ((F.row_number().over(Window.partitionBy("building").orderBy("class", "inst", "component")) - 1) * 10 + 1).cast("bigint"))
    out = placed.join(order, ["building", "class", "inst", "component"], "left")
    return out.select("building", "face_id", F.when(F.col("new").isNull(), F.lit(-1)).otherwise(F.col("class")).alias("class"), F.coalesce("new", F.lit(-1)).alias("inst"))


def fill(faces: DataFrame, midpoints: DataFrame, neighbours: int = 100, scope: tuple[str, ...] = ("building",), face: str = "face_id", axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Faces of class -1 take the most frequent instance among their nearest faces (itself among
    them), with its class; else background, if that is the most frequent class. Neighbours are read
    as they were before."""
    keys = [*scope, face]
    open_ = faces.where("class = -1").select(*keys).join(midpoints, keys)
    near = joins.knn(open_, midpoints.withColumnRenamed(face, "near_face"), face, "near_face", axes, neighbours, on=scope)
    seen = near.join(faces.withColumnRenamed(face, "near_face"), [*scope, "near_face"])
    best = vote.majority(seen.where("inst <> -1"), keys, "inst")
    label = faces.where("inst <> -1").groupBy(*scope, "inst").agg(F.min_by("class", face).alias("new_class"))
    best = best.join(label, [*scope, "inst"]).select(*keys, F.col("inst").alias("new_inst"), "new_class")
    common = vote.majority(seen, keys, "class").select(*keys, F.col("class").alias("common"))
    out = faces.join(best, keys, "left").join(common, keys, "left")
    empty = F.col("class") == -1
    return out.select(
        *keys, F.when(empty, F.coalesce("new_class", F.when(F.col("common") == 0, 0), F.lit(-1))).otherwise(F.col("class")).cast("int").alias("class"),
        F.when(empty, F.coalesce("new_inst", F.lit(-1))).otherwise(F.col("inst")).alias("inst"),
    )


def back_project(points: DataFrame, poses: DataFrame, faces: DataFrame, height: int, width: int, segments: DataFrame | None = None, opening: int = 10) -> DataFrame:
    """P10: building, pano, r, c, inst, class: the fused labels in each panorama.

    Points paint their face's instance (0 for background), the last one of a pixel stays; holes
    take the nearest value; superpixels (building, pano, r, c, segment) take their most frequent
    one; small intrusions are opened away. An instance's class is the most frequent of its faces'.
    """
    seen = project(points, poses, height, width).join(faces, ["building", "face_id"]).where("class <> -1")
    value = F.when(F.col("class") == 0, F.lit(0)).otherwise(F.col("inst"))
    scope = ["building", "pano"]
    painted = seen.groupBy(*scope, "r", "c").agg(F.max_by(value, "point_id").alias("inst"))
    rows = F.explode(F.sequence(F.lit(0), F.lit(height - 1)))
    frame = painted.select(*scope).distinct().withColumn("r", rows).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    pixels = joins.nearest_fill(frame.join(painted, [*scope, "r", "c"], "left"), "inst", scope)
    if segments is not None:
        cut = pixels.join(segments, [*scope, "r", "c"])
        pixels = cut.drop("inst").join(vote.majority(cut, [*scope, "segment"], "inst"), [*scope, "segment"]).select(*scope, "r", "c", "inst")
    if opening > 1:
        pixels = raster.open_and_refill(pixels, scope, "inst", opening)
    label = vote.majority(faces.where("class > 0"), ["building", "inst"], "class")
    return pixels.join(label, ["building", "inst"], "left").withColumn("class", F.coalesce("class", F.lit(0)))


def weight(distance: Column) -> Column:
    """The part of the inverse-distance weight that decides: the sum over a face's panoramas is a constant."""
    return 1 / distance
