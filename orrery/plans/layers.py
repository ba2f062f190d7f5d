"""The four layers: building, rooms, cameras, objects, and their assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import geometry as g
from orrery.operators import aggregate, hull, joins, relations
from orrery.sources import mesh


def _vectors(table: DataFrame) -> DataFrame:
    """location and size as arrays of three."""
    for name in ("location", "size"):
        parts = [f"{name}_{a}" for a in "xyz"]
        table = table.withColumn(name, F.array(*parts)).drop(*parts)
    return table.drop(*[f"{n}_{a}" for n in ("min", "max") for a in "xyz"])


def _swap(table: DataFrame, compat: bool) -> DataFrame:
    """With ``compat`` the floor area is the hull's perimeter, as some published graphs have it."""
    if compat:
        return table.withColumn("floor_area", F.col("floor_perimeter"))
    return table


def building_layer(points: DataFrame, attributes: DataFrame, voxel_size: float = 0.1, compat: bool = False) -> DataFrame:
    """One row per building: extents, hull, voxel grid and the attributes of S3."""
    box = aggregate.bounding_box(points, ["building"])
    grid = aggregate.voxel_grid(points, ["building"], voxel_size)
    extent = hull.hulls(points, "building")
    res = F.array(*[f"res_{a}" for a in "xyz"])
    out = _vectors(box).join(grid, "building").join(_swap(extent, compat), "building")
    out = out.withColumn("voxel", F.struct(F.lit(voxel_size).alias("size"), res.alias("resolution"), F.array(*[f"grid_{a}" for a in "xyz"]).alias("low")))
    out = out.drop(*[f"{n}_{a}" for n in ("res", "grid") for a in "xyz"])
    named = attributes.select(F.col("model").alias("building"), "split", F.col("bldg_function").alias("function"), F.col("floors").alias("num_floors"))
    return out.join(named, "building", "left").withColumn("reference_point", F.array(*[F.lit(0.0)] * 3))


def room_faces(rooms: DataFrame, vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Building, room, face_id: faces all of whose corners coincide, truncated to mm, with vertices
    (building, room, x, y, z) of the room's own mesh."""
    met = joins.truncated_join(vertices, rooms, on=("building",))
    keyed = met.select(F.concat_ws("\u0000", "building", "room").alias("scope"), "building", "room", "vertex_id")
    slots = faces.select("building", "face_id", F.posexplode(F.array("v0", "v1", "v2")).alias("slot", "vertex_id"))
    found = slots.join(keyed.distinct(), ["building", "vertex_id"]).groupBy("building", "room", "face_id").agg(F.count_distinct("slot").alias("n"))
    return found.where("n = 3").drop("n")


def _spatial(members: DataFrame, points: DataFrame, grids: DataFrame, key: str, voxel_size: float, compat: bool) -> DataFrame:
    """Extents, hull and voxels of groups of faces (building, key, face_id)."""
    own = points.join(members, ["building", "face_id"])
    scope = F.concat_ws("\u0000", F.col("building"), F.col(key).cast("string"))
    own = own.withColumn("__scope", scope)
    box = aggregate.bounding_box(own, ["building", key, "__scope"])
    extent = _swap(hull.hulls(own, "__scope"), compat)
    filled = aggregate.voxel_occupancy(own, grids, ["building"], ["__scope"], voxel_size)
    voxels = aggregate.listed(filled, ["__scope"], "idx").withColumnRenamed("idx", "voxel_occupancy")
    ids = aggregate.listed(members.withColumn("__scope", scope), ["__scope"], "face_id").withColumnRenamed("face_id", "face_ids")
    return _vectors(box).join(extent, "__scope", "left").join(voxels, "__scope", "left").join(ids, "__scope").drop("__scope")


def room_layer(members: DataFrame, names: DataFrame, points: DataFrame, grids: DataFrame, voxel_size: float = 0.1, compat: bool = False) -> DataFrame:
    """Rooms, numbered by file name, with the category and floor of their names (building, room,
    scene_category, floor_number)."""
    spatial = _spatial(members, points, grids, "room", voxel_size, compat).join(names, ["building", "room"], "left")
    return aggregate.numbered(spatial, ["building"], ["room"], "id").withColumn("parent_building", F.col("building"))


def camera_layer(cameras: DataFrame, room_voxels: DataFrame, modality: str = "RGB", compat: bool = False) -> DataFrame:
    """Cameras (building, camera, x, y, z, fov, quaternion or angles) with ids in order of name and
    their room. With ``compat`` each camera's room is sought from the origin."""
    out = cameras
    if "qw" in cameras.columns:
        m = g.quaternion_matrix(*[F.col(c) for c in ("qw", "qx", "qy", "qz")])
        angles = g.euler_angles(m)
        out = out.withColumns({c: a for c, a in zip(("rx", "ry", "rz"), angles, strict=True)})
    out = aggregate.numbered(out, ["building"], ["camera"], "id")
    spots = out.select("building", "id", *[(F.lit(0.0) if compat else F.col(a)).alias(a) for a in "xyz"])
    room = joins.nearest_group_in_cells(spots, room_voxels, "id", "room_id", ("x", "y", "z"), ("cx", "cy", "cz"), ("building",))
    room = room.select("building", "id", F.col("room_id").alias("parent_room"))
    out = out.join(room, ["building", "id"], "left")
    return out.select("building", "id", F.col("camera").alias("name"), F.array("x", "y", "z").alias("location"), F.array("rx", "ry", "rz").alias("rotation"), "fov", F.lit(modality).alias("modality"), "parent_room")


def object_layer(
    faces: DataFrame, points: DataFrame, cornered: DataFrame, grids: DataFrame, rooms: DataFrame, attributes: DataFrame, actions: DataFrame, names: DataFrame,
    voxel_size: float = 0.1, compat: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(objects, mapping): objects with dense ids in the order of class and mesh id, and the mapping
    (building, old, new) of ids. Attributes (building, instance, ...) and actions (class, actions) may be
    missing for some."""
    members = faces.where("inst > 0 and class > 0").select("building", F.col("inst").alias("instance"), "class", "face_id")
    kinds = members.groupBy("building", "instance").agg(F.min_by("class", "face_id").alias("class"))
    ids = aggregate.numbered(kinds, ["building"], ["class", "instance"], "id")
    spatial = _spatial(members.select("building", "instance", "face_id"), points, grids, "instance", voxel_size, compat)
    area = aggregate.surface(cornered.join(members, ["building", "face_id"]), ["building", "instance"], mesh.corner_vectors())
    # The room with most common faces, per building.
    shared = members.join(rooms.select("building", "face_id", "room_id"), ["building", "face_id"]).groupBy("building", "instance", "room_id").agg(F.count_distinct("face_id").alias("n"))
    room = shared.groupBy("building", "instance").agg(F.max_by("room_id", F.struct(F.col("n"), -F.col("room_id"))).alias("parent_room"))
    named = ids.join(names.select("class", F.col("name").alias("class_")), "class", "left")
    acts = actions.select(F.col("class").alias("class_"), F.col("actions").alias("action_affordance"))
    extra = attributes.drop("class")
    out = named.join(spatial, ["building", "instance"]).join(area, ["building", "instance"], "left").join(room, ["building", "instance"], "left")
    out = out.join(extra, ["building", "instance"], "left").join(acts, "class_", "left")
    return out, ids.select("building", F.col("instance").alias("old"), F.col("id").alias("new"))


def assemble(buildings: DataFrame, rooms: DataFrame, cameras: DataFrame, objects: DataFrame) -> dict[str, DataFrame]:
    """The layers, with the building's counts (A14) and dense building ids."""
    out = aggregate.numbered(buildings.withColumn("__all", F.lit(1)), ["__all"], ["building"], "id").drop("__all")
    for table, name in ((rooms, "num_rooms"), (cameras, "num_cameras"), (objects, "num_objects")):
        out = out.join(aggregate.children(table, "building", name), "building", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return {"building": out, "room": rooms, "camera": cameras, "object": objects}


def edges(layers: dict[str, DataFrame]) -> DataFrame:
    """The graph's edges by name: building, src, dst, kind."""
    room = layers["room"].select("building", F.concat(F.lit("room/"), F.col("id")).alias("src"), F.col("building").alias("dst"), F.lit("room-building").alias("kind"))
    parts = [room]
    for layer in ("object", "camera"):
        rows = layers[layer].where("parent_room is not null")
        parts.append(rows.select("building", F.concat(F.lit(f"{layer}/"), F.col("id")).alias("src"), F.concat(F.lit("room/"), F.col("parent_room")).alias("dst"), F.lit(f"{layer}-room").alias("kind")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def relationships(points: DataFrame, objects: DataFrame, cameras: DataFrame, hits: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables rel_spatial, rel_magnitude and, where ray hits (building, camera_id, ray_id, object_id,
    t, face_id) are given, rel_occlusion, all within a building. ``points`` are (building, object_id, x, y, z)."""
    flat = objects.select("building", F.col("id").alias("object_id"), *[F.col("location")[k].alias(f"location_{a}") for k, a in enumerate("xyz")], *[F.col("size")[k].alias(f"size_{a}") for k, a in enumerate("xyz")], "volume", "floor_area")
    cams = cameras.select("building", F.col("id").alias("camera_id"), *[F.col("location")[k].alias(a) for k, a in enumerate("xyz")], *[F.col("rotation")[k].alias(f"r{a}") for k, a in enumerate("xyz")])
    measures = ["volume", "floor_area", "size_x", "size_y", "size_z"]
    out = {
        "rel_spatial": relations.spatial_order(points, flat, cams, on=("building",)),
        "rel_magnitude": relations.relative_magnitude(joins.ordered_pairs(flat, "object_id", ["building"], measures), measures),
    }
    if hits is not None:
        out["rel_occlusion"] = relations.occlusion(hits, "ray_id", "object_id", F.struct("t", "face_id"), ["building", "camera_id"])
    return out
