"""Relationship queries over the layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import geometry as g
from orrery.operators import aggregate, joins


def object_room(object_faces: DataFrame, room_faces: DataFrame) -> DataFrame:
    """The room that shares most faces with an object; null without overlap."""
    return joins.overlap_argmax(object_faces, room_faces, "object_id", "room_id", "face_id")


def camera_room(cameras: DataFrame, room_voxels: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """R2: the room, of the camera's scope ``on``, with the closest occupied voxel centre (cx, cy, cz) to a camera (x, y, z)."""
    return joins.nearest_group_in_cells(cameras, room_voxels, "camera_id", "room_id", ("x", "y", "z"), ("cx", "cy", "cz"), on)


def same_space(pairs: DataFrame, a: str, b: str, name: str = "same_space") -> DataFrame:
    """Whether two parents are equal; two missing parents are."""
    return pairs.withColumn(name, F.col(a).eqNullSafe(F.col(b)))


def in_room(elements: DataFrame, rooms: DataFrame, parent: str = "room_id") -> DataFrame:
    """The elements whose parent is among ``rooms``."""
    return elements.join(rooms.select(parent).distinct(), parent, "left_semi")


def relative_magnitude(pairs: DataFrame, measures: list[str], a: str = "a_", b: str = "b_") -> DataFrame:
    """Ratios of measures; null where the divisor is 0."""
    return pairs.withColumns({f"ratio_{m}": F.col(a + m) / F.when(F.col(b + m) != 0, F.col(b + m)) for m in measures})


def camera_plane(location: g.Vector, rotation: g.Vector) -> tuple[Column, Column, Column, Column]:
    """The plane A, B, C, D through a camera's x and z axes, in the camera-transformed frame."""
    r = g.euler_matrix(*rotation)
    corners = []
    for x, z in ((1.0, 0.0), (-1.0, 0.0), (1.0, 1.0)):
        corners.append(g.row_times(g.minus((F.lit(x), F.lit(0.0), F.lit(z)), location), r))
    n = g.cross(g.minus(corners[1], corners[0]), g.minus(corners[2], corners[0]))
    return *n, -g.dot(n, corners[0])


def plane_distance(plane: tuple[Column, ...], point: g.Vector) -> Column:
    return F.abs(g.dot(plane[:3], point) + plane[3]) / g.norm(plane[:3])


def spatial_order(points: DataFrame, objects: DataFrame, cameras: DataFrame, gap: float = 0.1, mode: str = "plane", on: tuple[str, ...] = ()) -> DataFrame:
    """For each camera and ordered pair of objects, where the second is relative to the first.

    ``points`` (object_id, x, y, z) are an object's sample, ``objects`` have location_x.., ``cameras``
    camera_id, x.. and rx... The order is null where the points nearest to the camera's plane are
    closer than ``gap`` on any axis. ``mode='camera_depth'`` measures depth along the camera's axis
    instead of the distance to the plane. ``on`` names the scope, such as the building, in which ids
    are unique; all three tables have it. Returns on..., camera_id, a, b, numeric differences, depth,
    vertical, lateral.
    """
    cams = cameras.select(*on, "camera_id", *[F.col(c).alias(f"cam_{c}") for c in ("x", "y", "z", "rx", "ry", "rz")])
    loc, rot = g.vector("cam_x", "cam_y", "cam_z"), g.vector("cam_rx", "cam_ry", "cam_rz")
    world = g.vector("x", "y", "z")
    if mode == "camera_depth":
        distance = F.abs(g.row_times(g.minus(world, loc), g.euler_matrix(*rot))[1])
    else:
        distance = plane_distance(camera_plane(loc, rot), world)
    seen = joins._paired(points, cams, on).select(*on, "camera_id", "object_id", "x", "y", "z", distance.alias("d"))
    near = seen.groupBy(*on, "camera_id", "object_id").agg(F.min_by(F.struct("d", "x", "y", "z"), F.struct("d", "x", "y", "z")).alias("near"), F.min("z").alias("low"))
    whole = near.join(objects.select(*on, "object_id", "location_x", "location_y", "location_z"), [*on, "object_id"])
    pairs = joins.ordered_pairs(whole, "object_id", [*on, "camera_id"], ["near", "low", "location_x", "location_y", "location_z"]).join(cams, [*on, "camera_id"])
    close = F.lit(False)
    for axis in "xyz":
        close = close | (F.abs(F.col(f"a_near.{axis}") - F.col(f"b_near.{axis}")) < gap)
    angle = g.clockwise_angle(
        (F.col("a_location_x") - F.col("cam_x"), F.col("a_location_y") - F.col("cam_y")),
        (F.col("b_location_x") - F.col("cam_x"), F.col("b_location_y") - F.col("cam_y")),
    )
    told = lambda c: F.when(~close, c)
    return pairs.select(
        *on, "camera_id", F.col("a_object_id").alias("a"), F.col("b_object_id").alias("b"),
        *[told(F.col(f"a_location_{x}") - F.col(f"b_location_{x}")).alias(f"diff_{x}") for x in "xyz"],
        told(F.when(F.col("a_near.d") < F.col("b_near.d"), "behind").otherwise("in front")).alias("depth"),
        told(F.when(F.col("b_low") < F.col("a_low"), "bottom").otherwise("top")).alias("vertical"),
        told(F.when(angle < 0, "left").otherwise("right")).alias("lateral"),
    )


def occlusion(hits: DataFrame, ray: str, item: str, order: Column, scope: list[str] | None = None) -> DataFrame:
    """Scope..., a, b, relation: ``occluding`` if a is hit before b on more common rays than after, else
    ``occluded``; pairs without a common ray have no row. ``scope`` names the building and the
    camera whose rays are asked about, such as ``["building", "camera_id"]``."""
    votes = joins.common_rays(hits, ray, item, order, scope)
    first = F.sum(F.col("a_first").cast("int"))
    return votes.groupBy(*(scope or []), "a", "b").agg(first.alias("n_first"), F.count("*").alias("n_rays")).select(
        *(scope or []), "a", "b", F.when(F.col("n_first") * 2 > F.col("n_rays"), "occluding").otherwise("occluded").alias("relation")
    )


def amodal_mask(object_pixels: DataFrame, scene_pixels: DataFrame, scope: list[str], height: int, width: int) -> DataFrame:
    """Scope..., r, c, mask, value.

    ``object_pixels`` (scope, r, c, visible) are the in-frame pixels of an object's points and
    ``scene_pixels`` those of all visible points. The visible mask (``viz``) is the nearest-filled
    image of 255 (object) and 50 (other) where it is 255; the occluded mask (``occ``) holds the
    object's pixels that are not visible. Both are mirrored.
    """
    from orrery.operators.raster import mirror

    shown = object_pixels.where("visible").select(*scope, "r", "c", F.lit(255).alias("value"))
    rest = scene_pixels.select(*scope, "r", "c", F.lit(50).alias("value"))
    painted = mirror(shown.unionByName(rest).groupBy(*scope, "r", "c").agg(F.max("value").alias("value")), width)
    frame = object_pixels.select(*scope).distinct().withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    filled = joins.nearest_fill(frame.join(painted, [*scope, "r", "c"], "left"), "value", scope)
    occluded = mirror(object_pixels.where("not visible").select(*scope, "r", "c").distinct(), width)
    viz = filled.where("value = 255").select(*scope, "r", "c", F.lit("viz").alias("mask"))
    return viz.unionByName(occluded.select(*scope, "r", "c", F.lit("occ").alias("mask")))


def arbitrate(members: DataFrame, neighbours: DataFrame, scope: list[str], element: str, cluster: str) -> DataFrame:
    """One cluster for each element that several claim.

    A contested element goes to the claimant with most members, outside the contested region, among
    the neighbours (scope..., element, neighbour) of that region; ties go to the earlier cluster.
    All contests are decided at once from the same state. Where at most two clusters overlap that
    equals deciding pair by pair; with more the result does not depend on an order of pairs.
    """
    claims = members.select(*scope, element, cluster).distinct()
    contested = claims.groupBy(*scope, element).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(cluster)).alias("region")).where("n > 1")
    regions = contested.select(*scope, element, "region")
    around = regions.join(neighbours, [*scope, element]).select(*scope, "region", F.col("neighbour").alias(element)).distinct()
    around = around.join(contested.select(*scope, element), [*scope, element], "left_anti")
    support = around.join(claims, [*scope, element]).where(F.array_contains("region", F.col(cluster))).groupBy(*scope, "region", cluster).agg(F.count("*").alias("support"))
    claimants = regions.select(*scope, "region").distinct().withColumn(cluster, F.explode("region")).join(support, [*scope, "region", cluster], "left")
    rank = F.struct(F.coalesce("support", F.lit(0)), -F.col(cluster))
    winner = claimants.groupBy(*scope, "region").agg(F.max_by(cluster, rank).alias(cluster))
    settled = regions.join(winner, [*scope, "region"]).select(*scope, element, cluster)
    return claims.join(contested.select(*scope, element), [*scope, element], "left_anti").unionByName(settled)


def visible_points(points: DataFrame, cameras: DataFrame, triangles: DataFrame, height: int, width: int) -> DataFrame:
    """Building, camera_id, point_id, face_id, px, py, visible: the points in each camera's frame, and
    whether the first face that the ray towards a point hits is the point's own.

    ``points`` (building, point_id, face_id, x, y, z), ``cameras`` (building, camera_id, x, y, z, rx, ry,
    rz, fov), ``triangles`` (building, face_id, ax .. cz). Cameras without a pinhole image see nothing.
    """
    from orrery.operators.rays import cast_rays

    cams = cameras.select("building", "camera_id", "fov", *[F.col(c).alias(f"cam_{c}") for c in ("x", "y", "z", "rx", "ry", "rz")])
    cams = F.broadcast(cams) if cams.count() <= joins.BROADCAST_ROWS else cams
    rows = points.join(cams, "building")
    away = g.minus(g.vector("x", "y", "z"), g.vector("cam_x", "cam_y", "cam_z"))
    local = g.row_times(away, g.euler_matrix(*g.vector("cam_rx", "cam_ry", "cam_rz")))
    px, py, inside = g.pinhole_pixel(local, F.col("fov"), height, width)
    seen = rows.select("*", px.alias("px"), py.alias("py"), inside.alias("inside")).where("inside")
    names = aggregate.identified(seen, ["building", "camera_id", "point_id"], "ray_id")
    seen = seen.join(names, ["building", "camera_id", "point_id"])
    away = g.minus(g.vector("x", "y", "z"), g.vector("cam_x", "cam_y", "cam_z"))
    beams = seen.select("building", "ray_id", *[F.col(f"cam_{a}").alias(f"o{a}") for a in "xyz"], *[d.alias(f"d{a}") for d, a in zip(away, "xyz", strict=True)])
    first = cast_rays(beams, triangles, first_only=True).select("building", "ray_id", F.col("face_id").alias("hit"))
    out = seen.select("building", "camera_id", "point_id", "face_id", "px", "py", "ray_id").join(first, ["building", "ray_id"], "left")
    return out.select("building", "camera_id", "point_id", "face_id", "px", "py", F.coalesce(F.col("hit") == F.col("face_id"), F.lit(False)).alias("visible"))
