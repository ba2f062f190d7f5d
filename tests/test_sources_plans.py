import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.plans import fusion, layers, pano
from orrery.sources import dense, export, image_sink, mesh, png, readers
from orrery.staging import Stages


def kept(df):
    """Written and read again, as between the stages of a job."""
    return Stages(df.sparkSession, "test").save(df, "table")


CUBE_OBJ = """# a cube, y up
v 0 0 0
v 1 0 0
v 1 1 0
v 0 1 0
v 0 0 1
v 1 0 1
v 1 1 1
v 0 1 1
f 1 2 3 4
f 5//1 6//2 7//3 8//4
f 1 2 6 5
f 2 3 7 6
f 3/1/1 4/2/2 8/3/3 7/4/4
f -5 -8 -4 -1
"""


def test_poses(spark, tmp_path):
    (tmp_path / "poses.csv").write_text("a, 1,2,3,0,0,0,1\nb,4,5,6,0,0,0,1\na,7,8,9,0,0,0,1\n")
    got = {r["camera"]: (r["tx"], r["qw"]) for r in readers.read_poses(spark, str(tmp_path / "poses.csv")).collect()}
    assert got == {"a": (7.0, 1.0), "b": (4.0, 1.0)}
    folder = tmp_path / "json"
    folder.mkdir()
    (folder / "cam_1_domain_rgb.json").write_text('{"field_of_view_rads": 1.5, "camera_rotation_final": [0, 1, 2],\n "camera_location": [3, 4, 5], "other": 1}')
    row = readers.read_frame_poses(spark, str(folder)).first()
    assert (row["camera"], row["fov"], row["rz"], row["x"]) == ("cam_1", 1.5, 2.0, 3.0)


def test_attribute_sheets(spark, tmp_path):
    (tmp_path / "b.csv").write_text(",data_split,bldg_function,floors,my_uuid\nnorth,small,residential,2,u\nsouth,medium,residential,,u\n")
    rows = {r["model"]: r["floors"] for r in readers.read_buildings(spark, str(tmp_path / "b.csv")).collect()}
    assert rows == {"north": 2, "south": None}
    assert readers.read_buildings(spark, str(tmp_path / "b.csv"), "north").count() == 1
    (tmp_path / "o.csv").write_text("north,,,,,,south,,,,,\ni,c,t,v,m1,m2,i,c,t,v,m1,m2\n1,chair,soft,,wood,,11,bed,,lined,,\n21,cup,,,glass,metal,,,,,,\n")
    got = {(r["model"], r["instance"]): (r["class"], r["tactile_texture"], r["visual_texture"], r["material"]) for r in readers.read_object_attributes(spark, str(tmp_path / "o.csv")).collect()}
    assert got == {("north", 1): ("chair", "soft", None, ["wood"]), ("north", 21): ("cup", None, None, ["glass", "metal"]), ("south", 11): ("bed", None, "lined", [])}
    (tmp_path / "a.csv").write_text("class,actions\nchair,sit on,move,\nbed,lie on\n")
    assert {r["class"]: r["actions"] for r in readers.read_affordances(spark, str(tmp_path / "a.csv")).collect()} == {"chair": ["sit on", "move"], "bed": ["lie on"]}
    (tmp_path / "p.txt").write_text("154,154,154\n1,2,3\n")
    from orrery.functions.vocabulary import read_palette

    assert [(r["idx"], r["b"]) for r in read_palette(spark, str(tmp_path / "p.txt")).orderBy("idx").collect()] == [(0, 154), (1, 3)]


def test_obj_scan_and_sampling(spark, tmp_path):
    (tmp_path / "cube.obj").write_text(CUBE_OBJ)
    vertices, faces = mesh.read_obj(spark, str(tmp_path / "cube.obj"), turn_up=False)
    assert vertices.count() == 8 and faces.count() == 12
    cornered = mesh.with_corners(faces, vertices)
    from orrery.operators import aggregate

    assert aggregate.surface(cornered, ["building"], mesh.corner_vectors()).first()["surface_coverage"] == pytest.approx(6.0)
    points = mesh.sample_points(cornered)
    assert points.count() == 60 and points.where("point_id div 5 <> face_id").count() == 0
    assert sorted(map(tuple, points.collect())) == sorted(map(tuple, mesh.sample_points(cornered.repartition(3)).collect()))
    up, _ = mesh.read_obj(spark, str(tmp_path / "cube.obj"))
    assert {r["z"] for r in up.collect()} == {0.0, 1.0} and {r["y"] for r in up.collect()} == {0.0, -1.0}


def test_npz(spark, tmp_path):
    np.savez(tmp_path / "a.npz", x=np.arange(4).reshape(2, 2), y=np.array([1.5]))
    rows = mesh.read_npz(spark, str(tmp_path / "a.npz"), ["x", "z"]).orderBy("position").collect()
    assert [r["value"] for r in rows] == [0, 1, 2, 3]


@pytest.mark.parametrize("shape,kind", [((5, 7), np.uint8), ((5, 7, 3), np.uint8), ((4, 3, 4), np.uint8), ((6, 2), np.uint16)])
def test_png_round_trip(shape, kind):
    image = np.random.default_rng(0).integers(0, np.iinfo(kind).max, shape).astype(kind)
    assert (png.decode(png.encode(image)).reshape(shape) == image).all()
    with pytest.raises(ValueError):
        png.decode(b"no image")


def test_images(spark, tmp_path):
    labels = spark.createDataFrame([("p", 0, 0, 1), ("p", 1, 2, 0)], "pano string, r int, c int, idx int")
    palette = spark.createDataFrame([(0, 154, 154, 154), (1, 10, 20, 30)], "idx int, r int, g int, b int")
    blend = spark.createDataFrame([("p", 0, 0, 20, 20, 20)], "pano string, r int, c int, red int, green int, blue int")
    mixed = {(r["r"], r["c"]): r["red"] for r in png.coloured(labels, palette, "idx", blend).collect()}
    assert mixed == {(0, 0): 15, (1, 2): 77}
    png.write_images(png.images(png.coloured(labels, palette, "idx"), "pano", 2, 3), str(tmp_path), "pano")
    back = {(r["r"], r["c"]): list(r["value"]) for r in png.read_images(spark, str(tmp_path / "p.png")).collect()}
    assert len(back) == 6 and back[0, 0] == [10, 20, 30] and back[0, 1] == [0, 0, 0]


def test_large_images_are_painted_and_read_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(png, "BLOCK", 12)  # four rows of three pixels
    rng = np.random.default_rng(5)
    image = np.zeros((30, 3, 3), np.uint8)
    at = [(int(r), int(c)) for r, c in zip(rng.integers(0, 30, 40), rng.integers(0, 3, 40), strict=True) if not 8 <= r < 16]
    rows = {(r, c): [int(v) for v in rng.integers(0, 256, 3)] for r, c in at}
    for (r, c), colour in rows.items():
        image[r, c] = colour
    pixels = spark.createDataFrame([(p, r, c, *v) for (r, c), v in rows.items() for p in ("p", "q") if p == "p" or r < 3], "pano string, r long, c int, red int, green int, blue int")
    found = {r["pano"]: bytes(r["content"]) for r in png.images(pixels, "pano", 30, 3).collect()}
    assert sorted(found) == ["p", "q"] and found["p"].count(b"IDAT") == 2 + 8
    assert (png.decode(found["p"]) == image).all()
    image[3:] = 0
    assert (png.decode(found["q"]) == image).all()
    with pytest.raises(Exception, match="IndexError"):
        png.images(pixels.withColumn("r", F.col("r") + 30), "pano", 30, 3).collect()
    parts = list(png.unpacked([pa.RecordBatch.from_pydict({"image": list(found), "content": list(found.values())})]))
    assert max(p.num_rows for p in parts) == 12
    whole = pa.Table.from_batches(parts).to_pylist()
    assert len(whole) == 180 and all(w["value"] == (rows.get((w["r"], w["c"]), [0, 0, 0]) if w["image"] == "p" or w["r"] < 3 else [0, 0, 0]) for w in whole)


def test_png_that_is_cut_off_or_too_long():
    image = np.random.default_rng(1).integers(0, 256, (9, 5, 3)).astype(np.uint8)
    content = png.encode(image)
    body = zlib.compress(np.hstack([np.full((9, 1), 2, np.uint8), np.diff(image, axis=0, prepend=np.zeros_like(image[:1])).reshape(9, -1)]).tobytes())
    up = content[:33] + png._chunk(b"IDAT", body[:7]) + png._chunk(b"IDAT", body[7:])  # each row less the row above
    assert (np.concatenate(list(png.blocks(up, 10))) == image).all() and [len(b) for b in png.blocks(up, 10)] == [2, 2, 2, 2, 1]
    for wrong in (zlib.compress(b"\0" * 16 * 8), zlib.compress(b"\0" * 16 * 10), body[:-3], body[:20]):
        with pytest.raises((ValueError, zlib.error)):
            png.decode(content[:33] + png._chunk(b"IDAT", wrong))


def test_exports(spark, tmp_path):
    table = spark.createDataFrame([("b", 1, [4, 5]), ("b", 2, [])], "building string, id int, face_ids array<int>")
    export.write_graph({"object": table, "room": table}, str(tmp_path / "g"))
    assert export.read_graph(spark, str(tmp_path / "g"))["object"].count() == 1
    assert spark.sql("select count(*) from room").first()[0] == 1
    with pytest.raises(ValueError):
        export.write_graph({"other": table}, str(tmp_path / "g"))
    with pytest.raises(KeyError):
        export.get_attribute(table, "colour")
    assert export.set_attribute(export.get_attribute(table, "id"), "id", F.lit(3)).first()["id"] == 3
    calls = []
    build = lambda: calls.append(1) or table
    for override in (False, False, True):
        export.stage(spark, str(tmp_path / "stage"), build, override)
    assert len(calls) == 2
    export.write_points(table.select("id"), str(tmp_path / "cloud"))


def world(spark, tmp_path):
    """A cube building with one room (its floor) and one object on it, seen by two cameras."""
    (tmp_path / "cube.obj").write_text(CUBE_OBJ)
    vertices, faces = mesh.read_obj(spark, str(tmp_path / "cube.obj"), turn_up=False)
    vertices, faces = kept(vertices), kept(faces)
    cornered = kept(mesh.with_corners(faces, vertices))
    return vertices, faces, cornered, kept(mesh.sample_points(cornered))


def test_layers_end_to_end(spark, tmp_path):
    vertices, faces, cornered, points = world(spark, tmp_path)
    attributes = spark.createDataFrame([("cube", "tiny", "residential", 1)], "model string, split string, bldg_function string, floors int")
    buildings = kept(layers.building_layer(points, attributes, 0.25))
    from orrery.operators import aggregate

    grid = kept(aggregate.voxel_grid(points, ["building"], 0.25))
    room_vertices = vertices.where("z = 0").select("building", F.lit("kitchen__A_1.obj").alias("room"), "x", "y", "z")
    members = kept(layers.room_faces(room_vertices, vertices, faces))
    assert {r["face_id"] for r in members.collect()} == {0, 1}
    names = readers.room_attributes(members.select("building", "room").distinct(), "room")
    rooms = kept(layers.room_layer(members, names, points, grid, 0.25))
    room = rooms.first()
    assert (room["id"], room["scene_category"], room["floor_number"]) == (1, "kitchen", "A") and len(room["voxel_occupancy"]) > 0
    labelled = faces.select("building", "face_id", F.when(F.col("face_id") < 3, 57).otherwise(0).alias("class"), F.when(F.col("face_id") < 3, 11).otherwise(0).cast("long").alias("inst"))
    from orrery.functions import vocabulary

    acts = spark.createDataFrame([("chair", ["sit on"])], "class string, actions array<string>")
    extra = spark.createDataFrame([("cube", 11, "chair", "soft", None, ["wood"])], "building string, instance long, class string, tactile_texture string, visual_texture string, material array<string>")
    room_ids = members.join(rooms.select("building", "room", F.col("id").alias("room_id")), ["building", "room"])
    objects, mapping = layers.object_layer(labelled, points, cornered, grid, room_ids, extra, acts, vocabulary.classes(spark), 0.25)
    objects = kept(objects)
    thing = objects.first()
    assert (thing["id"], thing["class_"], thing["parent_room"], thing["action_affordance"], thing["material"]) == (1, "chair", 1, ["sit on"], ["wood"])
    assert thing["surface_coverage"] == pytest.approx(1.5) and mapping.first()["old"] == 11
    cams = spark.createDataFrame([("cube", "c1", 0.5, 0.5, 0.5, 6.28, 1.0, 0.0, 0.0, 0.0)], "building string, camera string, x double, y double, z double, fov double, qw double, qx double, qy double, qz double")
    voxels = spark.createDataFrame([("cube", 1, 0.4, 0.4, 0.1)], "building string, room_id long, cx double, cy double, cz double")
    cameras = kept(layers.camera_layer(cams, voxels))
    assert cameras.first()["parent_room"] == 1 and cameras.first()["rotation"] == [0, 0, 0]
    graph = layers.assemble(buildings, rooms, cameras, objects)
    top = graph["building"].first()
    assert (top["num_rooms"], top["num_objects"], top["num_cameras"], top["num_floors"]) == (1, 1, 1, 1)
    assert {r["kind"] for r in layers.edges(graph).collect()} == {"room-building", "object-room", "camera-room"}
    own = points.where("face_id < 3").select("building", F.lit(1).cast("long").alias("object_id"), "x", "y", "z")
    found = layers.relationships(own, objects, cameras)
    assert found["rel_spatial"].count() == 0 and found["rel_magnitude"].count() == 0
    nested = export.nested_graph(
        graph["building"].withColumnRenamed("id", "building_id").select("building_id"), rooms.select(F.col("id").alias("room_id"), F.lit(1).cast("long").alias("parent_building"), "scene_category"),
        objects.select("id", "parent_room"), cameras.select("id", "parent_room"),
    ).first()
    assert nested["rooms"][0]["objects"][0]["id"] == 1


def test_fusion_end_to_end(spark, tmp_path):
    vertices, faces, cornered, points = world(spark, tmp_path)
    poses = spark.createDataFrame([("cube", p, 0.5, 0.5, 0.4 + 0.1 * k, 1.0, 0.0, 0.0, 0.0) for k, p in enumerate("ab")], "building string, camera string, tx double, ty double, tz double, qw double, qx double, qy double, qz double")
    seen = kept(fusion.project(points, poses, 64, 128))
    assert seen.count() > 60
    mist = seen.groupBy("building", "pano", "r", "c").agg((F.min("distance") * 512).cast("int").alias("value"))
    # Panoramas label the floor (faces 0, 1) as chair 10.
    painted = seen.groupBy("building", "pano", "r", "c").agg(F.min_by("face_id", "distance").alias("f"))
    pixels = painted.select("building", "pano", "r", "c", F.when(F.col("f") < 2, 57).otherwise(0).alias("class"), F.when(F.col("f") < 2, 10).otherwise(0).alias("inst"))
    votes = kept(fusion.register(points, poses, kept(pixels), kept(mist), 64, 128, tolerance=0.05))
    assert {(r["face_id"], r["class"]) for r in votes.collect() if r["face_id"] < 2} == {(0, 57), (1, 57)}
    from orrery.functions import geometry as g

    middle = g.midpoint(*mesh.corner_vectors())
    mids = cornered.select("building", "face_id", *[c.alias(a) for c, a in zip(middle, "xyz", strict=True)])
    mids = kept(mids)
    classes = kept(fusion.face_classes(votes, kept(fusion.face_distances(mids, poses))))
    got = {r["face_id"]: r["class"] for r in classes.collect()}
    assert got[0] == 57 and got[1] == 57 and set(got.values()) <= {0, 57}
    assert fusion.discover(votes, votes, classes, mids).count() == 0  # two views of fewer faces than a chair needs
    single = kept(votes.where("pano = 'a'"))
    objects = kept(fusion.discover(single, single, classes, mids))
    assert {(r["face_id"], r["inst"]) for r in objects.collect()} == {(0, 1), (1, 1)}
    labelled = faces.select("building", "face_id").join(objects.select("building", "face_id", "class", "inst"), ["building", "face_id"], "left").select("building", "face_id", F.coalesce("class", F.lit(-1)).alias("class"), F.coalesce("inst", F.lit(-1)).alias("inst"))
    filled = kept(fusion.fill(kept(labelled), mids, 4))
    assert filled.count() == 12 and filled.where("face_id < 2 and class <> 57").count() == 0
    back = fusion.back_project(points, poses, filled, 16, 32, opening=1)
    back = kept(back)
    assert back.count() == 2 * 16 * 32 and {r["class"] for r in back.select("class").distinct().collect()} == {57}
    assert fusion.refine(objects, faces, vertices).count() == objects.count()


def test_panorama_end_to_end(spark):
    options = pano.PanoOptions(height=8, width=16, stride=1)
    frames = spark.createDataFrame([("f", r, c, r, c) for r in range(8) for c in range(8)], "frame string, fr int, fc int, pr int, pc int")
    run = lambda r0, r1, c, n: [(r, c, n) for r in range(r0, r1)]
    rows = [
        ("p", "f", 1, 57, 0.9, run(1, 5, 1, 4)), ("p", "f", 2, 57, 0.8, run(2, 6, 2, 4)), ("p", "f", 3, 66, 0.05, run(0, 2, 6, 2)), ("p", "f", 4, 1, 0.9, run(0, 8, 0, 8)), ("p", "f", 5, 57, 0.9, []),
    ]
    found = spark.createDataFrame(rows, "pano string, frame string, det_no int, class int, score double, mask array<struct<r:int,start:int,len:int>>")
    instances = kept(pano.globalise(found))
    assert {(r["instance_id"], r["name"]) for r in instances.collect()} == {(2, "chair_1"), (3, "chair_2"), (4, "remote_1")}
    pixels = kept(pano.aggregate(found, frames, options))
    got = {(r["r"], r["c"]): r["class"] for r in pixels.collect()}
    assert len(got) == 64 and got[3, 3] == 57 and got[7, 7] == 0
    _, hits = pano.transfer(instances, frames, found.select("pano").distinct())
    objects = pano.cluster(kept(hits), pixels, pano.PanoOptions(height=8, width=16, stride=1, erosion=False), neighbours=5)
    objects = kept(objects)
    chairs = {r["inst"] for r in objects.where("class = 57").collect()}
    assert len(chairs) == 1 and pano.upsample(objects, pano.PanoOptions(stride=4)).count() == 16 * objects.count()
    assert pano.frame_map(spark, pano.PanoOptions(height=64, width=128), sizes=(20,), fovs=(90,), yaw_step=90).count() > 0


def test_panorama_votes_transfer_labels_once(spark):
    frames = spark.createDataFrame([(f, r, c, r, c + (f == "g")) for f in "fg" for r in range(2) for c in range(2)], "frame string, fr int, fc int, pr int, pc int")
    rows = [("p", "f", 1, 57, 4.0, [(0, 0, 2)]), ("p", "f", 2, 58, 3.0, [(0, 0, 1), (1, 0, 1)]), ("p", "g", 1, 57, 2.0, [(0, 0, 1)]), ("q", "g", 1, 58, 1.0, [(1, 1, 1)])]
    found = spark.createDataFrame(rows, "pano string, frame string, det_no int, class int, score double, mask array<struct<r:int,start:int,len:int>>")
    pixels = pano.aggregate(found, frames, pano.PanoOptions(height=2, width=3, stride=1))
    got = {(r["pano"], r["r"], r["c"]): (r["class"], round(r["score"], 9)) for r in pixels.collect()}
    # (0, 0) goes to 57; instance 3 (58) wins one of its two pixels and so stays, and has the greater id
    assert got == {
        ("p", 0, 0): (58, 3.0), ("p", 0, 1): (57, 6.0), ("p", 0, 2): (0, 0.65), ("p", 1, 0): (58, 3.0), ("p", 1, 1): (0, 1.3), ("p", 1, 2): (0, 0.65),
        ("q", 0, 1): (0, 0.65), ("q", 0, 2): (0, 0.65), ("q", 1, 1): (0, 0.65), ("q", 1, 2): (58, 1.0),
    }
    assert "Window" not in pixels._jdf.queryExecution().executedPlan().toString()  # numbering and transfer are not repeated for each use


def test_frames_of_a_panorama(spark):
    image = np.zeros((32, 64, 3), dtype=np.uint8)
    image[:, 32:] = 200
    panos = spark.createDataFrame([("p", png.encode(image))], "pano string, content binary")
    views = spark.createDataFrame([(90, 0, 0, 9), (90, 90, 0, 9)], "fov int, theta int, phi int, size int")
    frames = {r["frame"]: png.decode(r["content"]) for r in pano.frame_images(panos, views).collect()}
    assert frames["90_0_0"].shape == (9, 9, 3) and frames["90_0_0"][4, 0, 0] == 0 and frames["90_0_0"][4, 8, 0] == 200
    assert (frames["90_90_0"][2:7, 2:7] == 200).all()
    assert (pano.bicubic(image, np.array([3.0]), np.array([40.0])) == 200).all()


def test_visible_points_and_masks(spark):
    from orrery.operators import relations

    quad = lambda k, z: (("b", k, -1.0, -1.0, z, 1.0, -1.0, z, 0.0, 1.0, z))
    triangles = spark.createDataFrame([quad(1, -2.0), quad(2, -4.0)], "building string, face_id long, " + ", ".join(f"{p}{x} double" for p in "abc" for x in "xyz"))
    points = spark.createDataFrame([("b", 10, 1, 0.0, 0.0, -2.0), ("b", 20, 2, 0.0, 0.0, -4.0), ("b", 30, 2, 0.9, -0.9, -4.0), ("b", 40, 1, 0.0, 0.0, 2.0)], "building string, point_id long, face_id long, x double, y double, z double")
    cameras = spark.createDataFrame([("b", 1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.5), ("b", 2, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 6.3)], "building string, camera_id long, x double, y double, z double, rx double, ry double, rz double, fov double")
    seen = relations.visible_points(points, cameras, triangles, 100, 100).collect()
    assert {(r["camera_id"], r["point_id"]): r["visible"] for r in seen} == {(1, 10): True, (1, 20): False, (1, 30): False}
    masks = spark.createDataFrame([("k", "viz", 0, 0), ("k", "occ", 1, 1), ("m", "viz", 0, 0)], "obj string, mask string, r int, c int")
    assert {r["name"] for r in png.mask_images(masks, "obj", 4, 4).collect()} == {"k_mask_viz", "k_mask_occ"}


def test_obj_in_splits_gives_the_rows_of_the_whole_file(spark, tmp_path):
    rng = np.random.default_rng(1)
    lines, n = [], 0
    for k in range(3000):
        if n < 4 or rng.random() < 0.6:
            lines.append("v " + " ".join(f"{x:.3f}" for x in rng.uniform(-9, 9, 3)))
            n += 1
        elif rng.random() < 0.1:
            lines.append(f"# a comment {k}")
        else:
            corners = rng.integers(1, n + 1, rng.integers(2, 6))
            names = [f"{c}/{c}/1" if k % 3 else str(c - n - 1) if k % 2 else str(c) for c in corners]
            lines.append("f " + "  ".join(names) + ("\r" if k % 7 == 0 else ""))
    for name in ("one", "two"):
        (tmp_path / f"{name}.obj").write_text("\n".join(lines))
    rows = []
    for size in ("134217728", str(len("\n".join(lines)) // 8)):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0" if size != "134217728" else "4194304")
        try:
            vertices, faces = mesh.read_obj(spark, str(tmp_path / "*.obj"))
            splits = spark.read.text(str(tmp_path / "*.obj")).select("_metadata.file_path", "_metadata.file_block_start").distinct().count()
            rows.append((splits, sorted(map(tuple, vertices.collect())), sorted(map(tuple, faces.collect()))))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert rows[0][0] == 2 and rows[1][0] >= 16
    assert rows[0][1:] == rows[1][1:]
    vertices, count = [], 0
    faces = []
    for line in lines:
        kind, *arg = line.split()
        if kind == "v":
            vertices.append((count, float(arg[0]), -float(arg[2]), float(arg[1])))
            count += 1
        elif kind == "f":
            c = [int(a.split("/")[0]) for a in arg]
            c = [i - 1 if i > 0 else count + i for i in c]
            faces += [(len(faces) + k, c[0], c[k + 1], c[k + 2]) for k in range(len(c) - 2)]
    assert [r[1:] for r in rows[0][1] if r[0] == "one"] == vertices
    assert [r[1:] for r in rows[0][2] if r[0] == "two"] == faces


def _files(path):
    return {p.name: p.read_bytes() for p in path.iterdir() if p.is_file() and not p.name.startswith(".")}


def test_image_sink_writes_from_tasks_in_two_steps(spark, tmp_path):
    out = tmp_path / "images"
    rows = spark.createDataFrame([(f"i{k}.png", bytes([k] * k)) for k in range(20)], "name string, content binary").repartition(5)
    image_sink.save(rows, str(out))
    assert _files(out) == {f"i{k}.png": bytes([k] * k) for k in range(20)} and not [p for p in out.iterdir() if p.is_dir()]
    image_sink.save(spark.createDataFrame([("i3.png", b"new"), ("empty.png", None)], "name string, content binary"), f"file://{out}")
    assert len(_files(out)) == 21 and _files(out)["i3.png"] == b"new" and _files(out)["empty.png"] == b""
    image_sink.save(rows.limit(2), str(out), mode="overwrite")
    assert len(_files(out)) == 2
    image_sink.save(rows.limit(0), str(out))
    assert len(_files(out)) == 2


def test_a_failed_task_leaves_no_image(spark, tmp_path):
    out = tmp_path / "images"
    rows = spark.createDataFrame([(k, b"x" * 1000) for k in range(40)], "k long, content binary").repartition(4)
    name = F.when(F.col("k") == 33, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.concat("k", F.lit(".png")))
    with pytest.raises(Exception, match="lost"):
        image_sink.save(rows.select(name.alias("name"), "content"), str(out))
    assert not out.exists() or _files(out) == {} and not [p for p in out.iterdir() if p.is_dir()]
    with pytest.raises(Exception, match="not a file name"):
        image_sink.save(rows.select(F.lit("../x.png").alias("name"), "content"), str(out))


def test_an_attempt_that_does_not_count_is_not_seen(tmp_path):
    writer = image_sink.ImageWriter(str(tmp_path / "o"), False)
    store, root = image_sink.opened(writer.staged)
    for attempt in ("0-1", "0-2"):
        store.create_dir(f"{root}/{attempt}", recursive=True)
        with store.open_output_stream(f"{root}/{attempt}/a.png") as f:
            f.write(attempt.encode())
    writer.commit([image_sink.Written(f"{root}/0-2"), None])
    assert _files(tmp_path / "o") == {"a.png": b"0-2"} and [p.name for p in (tmp_path / "o").iterdir()] == ["a.png"]


def test_label_transfer_on_runs_against_every_pixel(spark):
    rng = random.Random(2)
    frames = [(f, r, c, (r * 3 + c + f) % 7, (c * 2 + r) % 9) for f in range(3) for r in range(8) for c in range(12)]
    found = [(p, f, k, 57 + k % 2, 0.5, [(rng.randrange(9), rng.randrange(12), rng.randrange(0, 9)) for _ in range(3)]) for p in range(2) for f in range(3) for k in range(4)]
    detections = spark.createDataFrame([(p, f, p * 100 + f * 10 + k, c, s, m) for p, f, k, c, s, m in found], "pano long, frame long, instance_id long, class int, score double, mask array<struct<r:int,start:int,len:int>>")
    table = spark.createDataFrame(frames, "frame long, fr int, fc int, pr int, pc int")
    cover, hits = pano.transfer(detections, table, detections.select("pano", "frame"))
    last = {}
    for f, r, c, y, x in frames:
        last[f, y, x] = max(last.get((f, y, x), (-1, -1)), (r, c))
    want = [(p, f, y, x, p * 100 + f * 10 + k) for p, f, k, _, _, runs in found for r, start, n in runs for c in range(start, start + n) for (g, y, x), at in last.items() if g == f and at == (r, c)]
    assert sorted(tuple(r) for r in hits.select("pano", "frame", "r", "c", "instance_id").collect()) == sorted(want)
    assert cover.count() == 2 * len(last)


def test_dense_arrays(spark, tmp_path):
    members = spark.createDataFrame([("a", 0, 5, 1), ("a", 0, 6, 2), ("a", 7, 1, 1), ("a", 9, 2, 1), ("a", -1, 9, 1), ("a", 99, 9, 1), ("b", 3, 8, 1), ("c", 0, 4, 1), ("b", None, 4, 1)], "building string, at long, id long, o int")
    length = spark.createDataFrame([("a", 10), ("b", 4), ("c", 0), ("d", 3), ("e", None)], "building string, n long")
    want = {"a": [6, 0, 0, 0, 0, 0, 0, 1, 0, 2], "b": [0, 0, 0, 8], "d": [0, 0, 0]}
    for step in (1, 3, 4, 100):
        chunks = dense.chunked(members, length, ["building"], "at", "id", F.col("o"), chunk=step)
        layer = spark.createDataFrame([("a", 6), ("a", 7), ("b", 8), ("b", 1)], "building string, id long")
        root = f"{tmp_path}/g{step}"
        export.write_graph({"object": layer}, root, {"object_faces": chunks})
        found = export.read_graph(spark, root, views=False)
        assert sorted(map(tuple, found["object"].collect())) == [("a", 6), ("b", 8)]
        array = found["object_faces"]
        rows = sorted(map(tuple, dense.expanded(array, "at", "id").collect()))
        assert rows == [(b, k, v) for b, vs in sorted(want.items()) for k, v in enumerate(vs)]
        part = sorted(map(tuple, dense.expanded(array, "at", "id", 2, 8).collect()))
        assert part == [r for r in rows if 2 <= r[1] < 8]
        asked = spark.createDataFrame([("a", 9), ("a", 10), ("b", 3), ("z", 0), ("a", -1)], "building string, at long")
        assert sorted(map(tuple, dense.looked_up(array, asked, "at", "id").collect()), key=str) == sorted([("a", 9, 2), ("a", 10, None), ("b", 3, 8), ("z", 0, None), ("a", -1, None)], key=str)
    with pytest.raises(ValueError):
        export.write_graph({}, str(tmp_path), {"other": length})


def test_numbers_are_printed_as_by_c(spark, tmp_path):
    from orrery.plans import catalogue, catalogue_more, catalogue_scans

    numbers = [1 / 512, 3 / 512, -1 / 512, 0.173828125, 0.1, -0.0, 5e-9, 2.5]
    rows = [(k, k % 3, [x, -x, x + 1]) for k, x in enumerate(numbers)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = ["v {:.8f} {:.8f} {:.8f}".format(*row[2]) for row in rows]
    assert want[0] == "v 0.00195312 -0.00195312 1.00195312"
    lines = [r["text"] for r in sorted(catalogue_more.obj_lines_in_order(spark, str(tmp_path)).collect(), key=lambda r: r["line_no"])]
    assert lines[: len(rows)] == want
    for rows_of in (catalogue.obj_export, catalogue_scans.instance_obj):
        assert {r["text"] for r in rows_of(spark, str(tmp_path)).collect() if r["text"].startswith("v")} == set(want)
    assert export.printed("%.1f", F.lit(None)) is not None and spark.range(1).select(export.printed("%.1f", F.lit(None))).first()[0] is None


def test_lines_of_many_parts_are_numbered_through(spark, tmp_path):
    lines = [(0, f"{k:05d}", f"line {k}") for k in range(1000)]
    spark.createDataFrame(lines, "section int, key string, text string").repartitionByRange(7, "key").sortWithinPartitions("key").select("text").write.text(str(tmp_path / "parts"))
    assert sorted((r["line_no"], r["text"]) for r in export.read_lines(spark, str(tmp_path / "parts")).collect()) == sorted((k, t) for k, (_, _, t) in enumerate(lines))


def test_votes_of_a_face_are_added_in_one_order(spark):
    import itertools
    import random

    def sums(weights):
        return {(weights[i] + weights[j]) + weights[k] for i, j, k in itertools.permutations(range(3))}

    views = []  # three panoramas against one of the same weight in all, where the order of addition decides
    for lone in range(1, 13):
        for a, b, c in itertools.product(range(lone + 1, 51), repeat=3):
            total = lone + a + b + c
            if lone * (a * b + b * c + a * c) == a * b * c and len({s > total / lone for s in sums([total / x for x in (a, b, c)])}) > 1:
                views.append((a, b, c, lone))
    random.Random(6).shuffle(views)
    assert len(views) >= 20
    rows, want = [], {}
    for face, view in enumerate(views):
        total, few = sum(view), face % 2  # the class of the lone panorama is the greater one or the lesser one
        rows += [("b", face, p, 1 + (1 - few if p < 3 else few), p + 1, float(d)) for p, d in enumerate(view)]
        a, b, c = sorted((total / d for d in view[:3]), reverse=True)
        score = {2 - few: 0.0 + a + b + c, 1 + few: total / view[3]}
        want[face] = min(score, key=lambda k: (-score[k], k))
    votes = spark.createDataFrame(rows, "building string, face_id long, pano long, class long, inst long, distance double")
    for partitions in (1, 7):
        dealt = votes.repartition(partitions).cache()
        got = fusion.face_classes(dealt.drop("distance"), dealt.select("building", "face_id", "pano", "distance"), 0.0)
        assert {r["face_id"]: r["class"] for r in got.collect()} == want
        dealt.unpersist()


def test_mesh_file_has_its_library_and_group(spark, tmp_path):
    vertices = spark.createDataFrame([(k, float(k), 0.0, 1.0) for k in range(4)], "vertex_id long, x double, y double, z double")
    faces = spark.createDataFrame([(0, 0, 1, 2), (1, 1, 2, 3)], "face_id long, v0 long, v1 long, v2 long")
    labels = spark.createDataFrame([(0, "chair_1"), (1, "chair_1")], "face_id long, material string")
    export.write_obj(export.obj_lines(vertices, faces, labels, library="house.mtl"), str(tmp_path / "house.obj"))
    text = [r["text"] for r in sorted(export.read_lines(spark, str(tmp_path / "house.obj")).collect(), key=lambda r: r["line_no"])]
    assert text[0] == "mtllib house.mtl" and [t[0] for t in text[1:5]] == ["v"] * 4
    assert text[5:] == ["g Mesh", "usemtl background", "usemtl chair_1", "f 1 2 3", "f 2 3 4"]
    back = mesh.read_obj(spark, str(tmp_path / "house.obj" / "*.txt"))
    assert [df.count() for df in back] == [4, 2]
    from orrery.plans import catalogue

    spark.createDataFrame([(k, k % 3, [0.5, 0.25, 1.0 * k]) for k in range(5)], "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = {r["text"]: r["n"] for r in catalogue.obj_export(spark, str(tmp_path)).collect()}
    assert rows["mtllib mesh.mtl"] == rows["g Mesh"] == rows["usemtl background"] == 1
