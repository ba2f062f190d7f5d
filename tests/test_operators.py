import itertools
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import geometry as g
from orrery.functions import vocabulary
from orrery.operators import aggregate, graph, hull, joins, raster, rays, relations, vote

CUBE = [(x, y, z) for x in (0.0, 1.0) for y in (0.0, 1.0) for z in (0.0, 1.0)]


def points(spark, rows, key="inst"):
    return spark.createDataFrame([(k, *map(float, p)) for k, p in rows], f"{key} long, x double, y double, z double")


def test_votes(spark):
    votes = spark.createDataFrame([(1, 2), (1, 1), (2, 2), (2, 2), (2, 1), (3, None)], "face long, class long")
    assert {r["face"]: r["class"] for r in vote.majority(votes, ["face"], "class").collect()} == {1: 1, 2: 2}


def test_survival_share_is_inclusive(spark):
    members = spark.createDataFrame([(7, k, 1) for k in range(10)], "inst long, face long, class long")
    winners = spark.createDataFrame([(k, 1 if k < 5 else 2) for k in range(10)], "face long, class long")
    kept = lambda share: vote.survivors(members, winners, ["face"], ["inst"], "class", share).count()
    assert kept(0.5) == 1 and kept(0.65) == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 5), (9, 9), (None, 4)], "src long, dst long")
    assert {r["node"]: r["component"] for r in graph.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 9: 9}
    chain = spark.createDataFrame([(k, k + 1) for k in range(200)], "src long, dst long").repartition(3)
    assert graph.components(chain).select("component").distinct().collect()[0][0] == 0
    assert graph.components(edges.limit(0)).count() == 0


def test_density_clusters(spark):
    rows = points(spark, [(1, (0, 0, 0)), (2, (0.01, 0, 0)), (3, (0.02, 0, 0)), (4, (0.5, 0, 0))], "id")
    found = {r["node"]: r["component"] for r in graph.density_clusters(rows, "id", ("x", "y", "z"), 0.0101).collect()}
    assert found == {1: 1, 2: 1, 3: 1}


def test_face_clusters(spark):
    vertices = points(spark, [(k, (k * 0.01 if k < 6 else 5 + k, 0, 0)) for k in range(9)], "vertex_id")
    faces = spark.createDataFrame([(0, 0, 1, 2), (1, 3, 4, 5), (2, 6, 7, 8)], "face_id long, v0 long, v1 long, v2 long")
    found = {r["face_id"]: r["component"] for r in graph.face_clusters(faces, vertices, ("x", "y", "z"), 0.011).collect()}
    assert found == {0: 0, 1: 0, 2: 6}


def test_cube_extents(spark):
    cube = points(spark, [(1, p) for p in CUBE] + [(1, (0.5, 0.5, 0.5))] + [(2, (k, 0, 0)) for k in range(3)])
    got = {r["inst"]: r for r in hull.hulls(cube, "inst").collect()}
    assert (got[1]["floor_area"], got[1]["floor_perimeter"], got[1]["volume"]) == pytest.approx((1, 4, 1))
    assert got[2]["volume"] == 0 and got[2]["floor_area"] == 0
    box = aggregate.bounding_box(cube, ["inst"]).where("inst = 1").first()
    assert box["location_x"] == 0.5 and box["size_z"] == 1.0


def test_hull_of_hulls(spark):
    pick = np.random.default_rng(2)
    cloud = pick.normal(size=(300, 3))
    whole = hull.hull_3d(cloud)[1]
    corners = np.concatenate([cloud[i : i + 100][hull.hull_3d(cloud[i : i + 100])[0]] for i in (0, 100, 200)])
    assert hull.hull_3d(corners)[1] == pytest.approx(whole)
    inside = (pick.uniform(-4, 4, size=(200_000, 3))).astype(float)
    del inside
    area, _ = hull.area_perimeter(hull.hull_2d(cloud[:, :2]))
    assert 0 < area < 40 and 0 < whole < 200


def test_voxels(spark):
    cube = points(spark, [(1, p) for p in CUBE])
    grid = aggregate.voxel_grid(cube, ["inst"], 0.25)
    assert aggregate.voxel_centres(grid, 0.25).count() == 64
    occupied = {r["idx"] for r in aggregate.voxel_occupancy(cube, grid, ["inst"], ["inst"], 0.25).collect()}
    assert occupied == {0}  # the other corners lie on open upper bounds


def test_overlap_rooms(spark):
    objects = spark.createDataFrame([(1, k) for k in range(5)] + [(2, 0), (2, 1), (2, 10), (2, 11), (3, 99)], "object_id long, face_id long")
    rooms = spark.createDataFrame([(1, k) for k in (0, 1, 2)] + [(2, k) for k in (3, 4, 10, 11)], "room_id long, face_id long")
    assert {r["object_id"]: r["room_id"] for r in relations.object_room(objects, rooms).collect()} == {1: 1, 2: 1, 3: None}


def test_camera_between_rooms(spark):
    cams = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "camera_id long, x double, y double, z double")
    voxels = spark.createDataFrame([(4, 1.0, 0.0, 0.0), (9, -1.0, 0.0, 0.0)], "room_id long, cx double, cy double, cz double")
    assert relations.camera_room(cams, voxels).first()["room_id"] == 9


def test_knn_and_radius_against_brute_force(spark):
    pick = random.Random(5)
    rows = [(k, (pick.random(), pick.random(), pick.choice([0, 0.5]))) for k in range(150)]
    table = points(spark, rows, "id").withColumn("g", F.col("id") % 2)
    near = joins.knn(table, table.withColumnRenamed("id", "t"), "id", "t", ("x", "y", "z"), 7, on=("g",), block=16)
    got = {(r["id"], r["rank"]): r["t"] for r in near.collect()}
    for k, p in rows:
        best = sorted((math.dist(p, q), j) for j, q in rows if j % 2 == k % 2)[:7]
        assert [got[k, n + 1] for n in range(7)] == [j for _, j in best]
    pairs = {(r["a"], r["b"]) for r in joins.radius_join(table, "id", ("x", "y", "z"), 0.1).collect()}
    assert pairs == {(a, b) for a, p in rows for b, q in rows if a < b and math.dist(p, q) <= 0.1}


def test_nearest_fill_against_brute_force(spark):
    pick = random.Random(6)
    known = {(pick.randrange(40), pick.randrange(40)): k for k in range(12)}
    cells = [(r, c, known.get((r, c))) for r in range(40) for c in range(40)]
    filled = joins.nearest_fill(spark.createDataFrame(cells, "r int, c int, v int"), "v", []).collect()
    assert len(filled) == 1600
    for row in filled:
        best = min(known, key=lambda p: ((p[0] - row["r"]) ** 2 + (p[1] - row["c"]) ** 2, p))
        assert row["v"] == known[best]


def mask(spark, cells):
    return spark.createDataFrame([tuple(c) for c in cells], "r long, c long")


def cells(df):
    return {(r["r"], r["c"]) for r in df.select("r", "c").collect()}


def test_morphology(spark):
    full = mask(spark, [(r, c) for r in range(5) for c in range(5)])
    assert cells(raster.erode(full, [], 3)) == {(r, c) for r in range(1, 4) for c in range(1, 4)}
    assert cells(raster.erode(full, [], 0)) == cells(full)
    pick = random.Random(7)
    some = mask(spark, {(pick.randrange(9), pick.randrange(9)) for _ in range(60)})
    once = raster.opened(some, [], 2)
    assert cells(once) <= cells(some) and cells(raster.opened(once, [], 2)) == cells(once)


def test_open_and_refill(spark):
    image = [(r, c, 1 if c < 6 else 2) for r in range(12) for c in range(12)]
    image = [(r, c, 3) if (r, c) == (5, 3) else (r, c, v) for r, c, v in image]
    out = {(r["r"], r["c"]): r["v"] for r in raster.open_and_refill(spark.createDataFrame(image, "r long, c long, v int"), [], "v", 3).collect()}
    assert len(out) == 144 and out[5, 3] == 1 and out[0, 11] == 2


def test_resize(spark):
    small = spark.createDataFrame([(0, 0, 0.0), (0, 1, 4.0)], "r int, c int, v double")
    assert raster.enlarge(small, 2).count() == 8
    smooth = {(r["r"], r["c"]): r["v"] for r in raster.enlarge_smooth(small, [], "v", 2, 1, 2).collect()}
    assert [smooth[0, c] for c in range(4)] == pytest.approx([0, 1, 3, 4])


def test_superpixels_separate_colours(spark):
    image = np.zeros((20, 20, 3))
    image[:, 10:] = 1.0
    labels = raster.felzenszwalb(image, 0.3, 0.5, 20)
    assert labels[0, 0] != labels[0, 19] and len(np.unique(labels)) < 12
    rows = [("p", r, c, int(255 * image[r, c, 0]), 0, 0) for r in range(20) for c in range(20)]
    out = raster.superpixels(spark.createDataFrame(rows, "pano string, r int, c int, red int, green int, blue int"), "pano", 0.3, 0.5, 20)
    assert out.count() == 400


def test_rays(spark):
    tri = spark.createDataFrame([("b", 1, *(0.0, 0.0, 5.0), *(4.0, 0.0, 5.0), *(0.0, 4.0, 5.0)), ("b", 2, *(0.0, 0.0, 2.0), *(4.0, 0.0, 2.0), *(0.0, 4.0, 2.0))], "building string, face_id long, " + ", ".join(f"{p}{x} double" for p in "abc" for x in "xyz"))
    beams = spark.createDataFrame([("b", 1, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0), ("b", 2, 9.0, 9.0, 0.0, 0.0, 0.0, 1.0)], "building string, ray_id long, " + ", ".join(f"{p}{x} double" for p in "od" for x in "xyz"))
    hits = [(r["ray_id"], r["face_id"], r["t"]) for r in rays.cast_rays(beams, tri).orderBy("t").collect()]
    assert hits == [(1, 2, pytest.approx(2.0)), (1, 1, pytest.approx(5.0))]
    first = rays.cast_rays(beams, tri, first_only=True)
    assert [(r["face_id"]) for r in first.collect()] == [2]
    owners = spark.createDataFrame([("b", 1, 1)], "building string, ray_id long, face_id long")
    assert rays.visible(first, owners).count() == 0


def test_occlusion(spark):
    rows = [(1, "A", 1), (1, "B", 2), (2, "A", 1), (2, "B", 2), (3, "B", 1), (3, "A", 2), (4, "C", 1)]
    hits = spark.createDataFrame(rows, "ray int, item string, at int")
    got = {(r["a"], r["b"]): r["relation"] for r in relations.occlusion(hits, "ray", "item", F.col("at")).collect()}
    assert got == {("A", "B"): "occluding", ("B", "A"): "occluded"}


def test_magnitude_and_same_space(spark):
    pairs = spark.createDataFrame([(2.0, 1.0, None, None), (4.0, 0.0, 1, None)], "a_v double, b_v double, p int, q int")
    assert [r["ratio_v"] for r in relations.relative_magnitude(pairs, ["v"]).collect()] == [2.0, None]
    assert [r["same_space"] for r in relations.same_space(pairs, "p", "q").collect()] == [True, False]


def test_amodal_mask(spark):
    own = spark.createDataFrame([("k", 1, 1, True), ("k", 2, 2, False)], "obj string, r int, c int, visible boolean")
    scene = spark.createDataFrame([("k", 0, 3)], "obj string, r int, c int")
    out = {(r["mask"], r["r"], r["c"]) for r in relations.amodal_mask(own, scene, ["obj"], 4, 4).collect()}
    assert ("occ", 2, 1) in out and ("viz", 1, 2) in out and ("viz", 0, 0) not in out


def test_arbitration(spark):
    claims = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (3, 20), (4, 20), (5, 20), (6, 20)], "e long, k long")
    near = spark.createDataFrame([(3, 2), (3, 4), (3, 5), (3, 3)], "e long, neighbour long")
    assert {r["e"]: r["k"] for r in relations.arbitrate(claims, near, [], "e", "k").collect()} == {1: 10, 2: 10, 3: 20, 4: 20, 5: 20, 6: 20}
    tied = spark.createDataFrame([(3, 2), (3, 4)], "e long, neighbour long")
    assert {r["e"]: r["k"] for r in relations.arbitrate(claims, tied, [], "e", "k").collect()}[3] == 10


def numbers(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()
    return [row[f"c{k}"] for k in range(len(columns))]


def lit(*values):
    return tuple(F.lit(float(v)) for v in values)


def test_rotations(spark):
    identity = [cell for row in g.quaternion_matrix(*lit(1, 0, 0, 0)) for cell in row]
    assert numbers(spark, *identity) == [1, 0, 0, 0, 1, 0, 0, 0, 1]
    assert numbers(spark, *g.euler_angles(g.quaternion_matrix(*lit(0, 0, 0, 0)))) == [0, 0, 0]
    assert numbers(spark, *g.times(g.rotation("z", F.lit(90.0)), lit(1, 0, 0))) == pytest.approx([0, 1, 0])
    assert numbers(spark, *g.times(g.axis_angle(lit(0, 0, 2), F.lit(math.pi / 2)), lit(1, 0, 0))) == pytest.approx([0, 1, 0])
    back = g.euler_angles(g.euler_matrix(*lit(0.3, -0.2, 1.1)))
    assert numbers(spark, *back) == pytest.approx([0.3, -0.2, 1.1])


AXES = [f + s for f in "sr" for s in ("xyz", "xyx", "xzy", "xzx", "yzx", "yzy", "yxz", "yxy", "zxy", "zxz", "zyx", "zyz")]


@pytest.mark.parametrize("axes", AXES)
def test_angles_of_any_axis_order(spark, axes):
    angles = (0.4, 0.7, -0.5)
    m = _turned(axes, angles)
    found = numbers(spark, *g.euler_angles(tuple(lit(*row) for row in m), axes))
    assert np.allclose(_turned(axes, found), m)  # several triplets may describe one rotation


def _turned(axes, angles):
    m = np.eye(3)
    for a, t in zip(axes[1:], angles, strict=True):
        m = _turn(a, t) @ m if axes[0] == "s" else m @ _turn(a, t)
    return m


def _turn(axis, t):
    c, s = math.cos(t), math.sin(t)
    return np.array({"x": [[1, 0, 0], [0, c, -s], [0, s, c]], "y": [[c, 0, s], [0, 1, 0], [-s, 0, c]], "z": [[c, -s, 0], [s, c, 0], [0, 0, 1]]}[axis])


def test_projections_are_inverse(spark):
    point = g.equirect_point(F.lit(300), F.lit(1500), 1024, 2048, 3.0)
    assert numbers(spark, g.norm(point)) == pytest.approx([3.0])
    row, column = numbers(spark, *g.equirect_pixel(point, 1024, 2048))
    assert abs(row - 300) <= 1 and abs(column - 1500) <= 1
    assert numbers(spark, g.depth(F.lit(32768))) == [64.0]
    assert numbers(spark, *g.pinhole_pixel(lit(0, 0, -2), F.lit(1.0), 100, 100)) == [50, 50, True]
    assert numbers(spark, *g.pinhole_pixel(lit(0, 0, -2), F.lit(2 * math.pi), 100, 100)) == [None, None, None]


def test_views_and_sampling(spark):
    assert g.view_parameters(spark).count() == 225
    assert g.view_parameters(spark, dedupe_yaw=True).count() == 216
    straight = g.frame_pixels(spark.createDataFrame([(90, 0, 0, 9)], "fov int, theta int, phi int, size int"), 1024, 2048).where("fr = 4 and fc = 4").first()
    assert abs(straight["pr"] - 511) <= 1 and abs(straight["pc"] - 1023) <= 1
    a, b, c = lit(0, 0, 0), lit(1, 0, 0), lit(0, 1, 0)
    for k in range(20):
        x, y, z = numbers(spark, *g.sample_face(a, b, c, (F.lit("m"), F.lit(k))))
        assert x >= 0 and y >= 0 and x + y <= 1 + 1e-12 and z == 0
    assert numbers(spark, g.triangle_area(a, b, c), *g.midpoint(a, b, c)) == pytest.approx([0.5, 0.5, 0.5, 0])


def test_vocabulary(spark):
    table = vocabulary.classes(spark)
    assert table.count() == 62
    sizes = {r["name"]: (r["erode"], r["min_faces"]) for r in table.collect()}
    assert sizes["bed"] == (6, 500) and sizes["chair"] == (4, 400) and sizes["laptop"] == (2, 100) and sizes["cup"] == (1, 50)
    assert numbers(spark, vocabulary.cluster_radius(F.lit("chair"), F.lit(3.0), F.lit(1.0)), vocabulary.cluster_radius(F.lit("chair"), F.lit(1.0), F.lit(1.0)), vocabulary.cluster_radius(F.lit("book"), F.lit(1.0), F.lit(1.0))) == [0.01, 0.3, 0.005]
    assert numbers(spark, vocabulary.colour_index(F.lit(1), 181), vocabulary.colour_index(F.lit(181), 181)) == [1, 1]


def test_densify(spark):
    members = spark.createDataFrame([("b", 1, 5, 0), ("b", 1, 3, 1), ("b", 3, 9, 0)], "s string, at long, v int, o int")
    length = spark.createDataFrame([("b", 5)], "s string, n long")
    out = [r["v"] for r in aggregate.densify(members, length, ["s"], "at", "v", F.col("o")).orderBy("at").collect()]
    assert out == [0, 3, 0, 9, 0]


@pytest.mark.parametrize("few", [10**6, 0])
def test_components_in_one_task_and_in_rounds(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW_EDGES", few)
    monkeypatch.setattr(graph, "CHUNK_EDGES", 7)
    pick = random.Random(few)
    edges = [(pick.randrange(60), pick.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(900, 900)]
    above = {}

    def top(k):
        while above.setdefault(k, k) != k:
            k = above[k]
        return k

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        above[b] = a
    rows = spark.createDataFrame([*edges, (1000, None), (None, 1001)], "src long, dst long").repartition(3)
    assert {r["node"]: r["component"] for r in graph.components(rows).collect()} == {k: top(k) for k in list(above)}
    assert graph.components(rows.limit(0)).count() == 0


def test_nearest_fill_far_apart(spark):
    rows = spark.createDataFrame([(0, 0, None), (0, 9_000, 1), (9_500, 0, 2), (9_500, 9_000, None)], "r int, c int, v int")
    got = {(r["r"], r["c"]): r["v"] for r in joins.nearest_fill(rows, "v", []).collect()}
    assert got == {(0, 0): 1, (0, 9_000): 1, (9_500, 0): 2, (9_500, 9_000): 2}


@pytest.mark.parametrize("few", [4096, 0])
def test_rays_against_all_triangles(spark, monkeypatch, few):
    """Meshes of small and large triangles of two buildings, in cells and whole, against every pair."""
    monkeypatch.setattr(rays, "FEW_TRIANGLES", few)
    pick = np.random.default_rng(7)
    tri, beams = [], []
    for building in ("a", "b"):
        centre, size = pick.uniform(-5, 5, (400, 1, 3)), pick.choice([0.05, 0.4, 6.0], (400, 1, 1), p=[0.6, 0.35, 0.05])
        tri += [(building, k, *map(float, c.ravel())) for k, c in enumerate(centre + size * pick.normal(size=(400, 3, 3)))]
        origin, way = pick.uniform(-9, 9, (150, 3)), pick.normal(size=(150, 3))
        way[:20] = np.eye(3)[pick.integers(0, 3, 20)] * pick.choice([-2.0, 1.0], 20)[:, None]  # along an axis
        beams += [(building, k, *map(float, r)) for k, r in enumerate(np.hstack([origin, way]))]
    beams.append(("none", 1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0))
    corners, ends = [f"{p}{x}" for p in "abc" for x in "xyz"], [f"{p}{x}" for p in "od" for x in "xyz"]
    mesh_rows = spark.createDataFrame(tri, "building string, face_id long, " + ", ".join(f"{c} double" for c in corners))
    beam_rows = spark.createDataFrame(beams, "building string, ray_id long, " + ", ".join(f"{c} double" for c in ends))
    want = {}
    for name, key, *r in beams:
        o, d = np.array(r[:3]), np.array(r[3:])
        for other, face, *t in tri:
            a, b, c = np.array(t).reshape(3, 3)
            m = np.stack([b - a, c - a, -d], axis=1)
            if other == name and abs(np.linalg.det(m)) > 1e-12:
                u, v, far = np.linalg.solve(m, o - a)
                if u >= 0 and v >= 0 and u + v <= 1 and far > 1e-9:
                    want[name, key, face] = round(far, 6)
    got = {(r["building"], r["ray_id"], r["face_id"]): round(r["t"], 6) for r in rays.cast_rays(beam_rows, mesh_rows).collect()}
    assert len(want) > 100 and got == want
    first = rays.cast_rays(beam_rows, mesh_rows, first_only=True).collect()
    assert {(r["building"], r["ray_id"]): r["face_id"] for r in first} == {k[:2]: min((t, f) for (*n, f), t in want.items() if tuple(n) == k[:2])[1] for k in want}


@pytest.mark.parametrize("shape", ["spread", "clusters", "line", "far"])
def test_neighbours_in_cells(spark, shape):
    """Cells, with few targets in each, against all distances; ties, copies and queries outside the targets' box."""
    pick = np.random.default_rng(3)
    spots = pick.uniform(0, 1, (300, 3))
    if shape == "clusters":
        spots[:250] = 0.5 + pick.normal(scale=1e-4, size=(250, 3))
        spots[250:260] = spots[0]
    elif shape == "line":
        spots[:, 1:] = 0.0
    ask = spots[::3] if shape != "far" else spots[:40] * 50 - 25
    scopes = lambda n: ["a" if k % 4 else "b" for k in range(n)]
    t = spark.createDataFrame([(s, k, *map(float, p)) for k, (s, p) in enumerate(zip(scopes(300), spots))], "s string, t long, x double, y double, z double")
    q = spark.createDataFrame([(s, k, *map(float, p)) for k, (s, p) in enumerate(zip(scopes(len(ask)), ask))], "s string, q long, x double, y double, z double")
    got = sorted(tuple(r) for r in joins.knn(q, t, "q", "t", ("x", "y", "z"), 4, on=("s",), block=16).select("s", "q", "rank", "t").collect())
    want = []
    for k, (s, p) in enumerate(zip(scopes(len(ask)), ask)):
        near = sorted((float(np.sqrt(((p - spots[j]) ** 2).sum())), j) for j, other in enumerate(scopes(300)) if other == s)[:4]
        want += [(s, k, n + 1, j) for n, (_, j) in enumerate(near)]
    assert got == sorted(want)


def structure(size):
    return range(-(size // 2), size - size // 2)


@pytest.mark.parametrize("size", [1, 2, 3, 4, 10])
def test_morphology_by_runs_against_whole_structures(spark, size):
    rng = random.Random(size)
    mask = {(s, r, c) for s in (0, 1) for r in range(24) for c in range(31) if rng.random() < 0.9}
    frame = spark.createDataFrame([*mask, *list(mask)[:50]], "pano int, r int, c int")
    want = {(s, r, c) for s, r, c in mask if all((s, r + y, c + x) in mask for y in structure(size) for x in structure(size))}
    assert set(map(tuple, raster.erode(frame, ["pano"], size).collect())) == want
    grown = {(s, r + y, c + x) for s, r, c in want for y in structure(size) for x in structure(size)}
    rows = raster.opened(frame, ["pano"], size).collect()
    assert len(rows) == len(set(rows)) and set(map(tuple, rows)) == grown <= mask
    few = spark.createDataFrame(sorted(mask)[::37], "pano int, r int, c int")
    spread = {(s, r + y, c + x) for s, r, c in sorted(mask)[::37] for y in structure(size) for x in structure(size)}
    assert set(map(tuple, raster.dilate(few, ["pano"], size).collect())) == spread
    assert set(map(tuple, raster.dilate(few, ["pano"], size, 24, 31).collect())) == {p for p in spread if 0 <= p[1] < 24 and 0 <= p[2] < 31}


def test_morphology_exchanges_do_not_grow_with_the_structure(spark):
    frame = spark.range(400).select((F.col("id") / 20).cast("int").alias("r"), (F.col("id") % 20).cast("int").alias("c"))
    plan = raster.opened(frame, [], 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4 and plan.count("Generate explode") == 2


def test_nearest_fill_on_ties_and_wide_rows(spark):
    rng = random.Random(7)
    pixels = [(s, r, c, rng.randrange(9) if rng.random() < (0.04, 0.5, 0.0)[s] else None) for s in range(3) for r in range(14) for c in range(40)]
    got = {tuple(r)[:3]: r[3] for r in joins.nearest_fill(spark.createDataFrame(pixels, "pano int, r int, c int, v int"), "v", ["pano"]).collect()}
    for s, r, c, v in pixels:
        known = [(y, x, k) for t, y, x, k in pixels if t == s and k is not None]
        want = v if v is not None or not known else min(known, key=lambda k: ((k[0] - r) ** 2 + (k[1] - c) ** 2, k[0], k[1]))[2]
        assert got[s, r, c] == want
    began = time.perf_counter()
    places = np.arange(65_536)
    joins.envelope(places, np.random.default_rng(0).integers(0, 400, 65_536) ** 2, places, places)
    assert time.perf_counter() - began < 5


def test_hull_3d_against_all_planes():
    rng = np.random.default_rng(2)
    for n in (4, 5, 9, 25):
        for pts in (rng.normal(size=(n, 3)), rng.normal(size=(n, 3)) * [1, 100, 0.01]):
            corners, volume = hull.hull_3d(pts)
            outer, tetrahedra = set(), 0.0
            centre = pts.mean(axis=0)
            for i, j, k in itertools.combinations(range(n), 3):
                normal = np.cross(pts[j] - pts[i], pts[k] - pts[i])
                side = (pts - pts[i]) @ normal
                if (side <= 1e-12).all() or (side >= -1e-12).all():
                    outer |= {i, j, k}
                    tetrahedra += abs(normal @ (centre - pts[i])) / 6
            assert set(corners.tolist()) == outer and abs(volume - tetrahedra) < 1e-9 * max(1, tetrahedra)


def test_hull_3d_of_lattices_and_a_ball():
    cube = np.array(list(itertools.product(range(6), repeat=3)), dtype=float)
    corners, volume = hull.hull_3d(cube)
    assert volume == pytest.approx(125) and {0, 5, 210, 215} <= set(corners.tolist())
    rng = np.random.default_rng(3)
    ball = rng.normal(size=(20_000, 3))
    ball *= (rng.random(20_000) ** (1 / 3) / np.linalg.norm(ball, axis=1))[:, None]
    began = time.perf_counter()
    corners, volume = hull.hull_3d(ball)
    assert time.perf_counter() - began < 10 and 3.9 < volume < 4.19 and len(corners) < 2000
    assert hull.hull_3d(cube[cube[:, 2] == 0])[1] == 0.0


def plain_segments(image, scale, sigma, min_size):
    """Every edge in turn over the whole image."""
    h, w = image.shape[:2]
    smooth = image.astype(float)
    radius = max(1, int(4 * sigma + 0.5))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    for axis in (0, 1):
        padded = np.pad(smooth, [(radius, radius) if a == axis else (0, 0) for a in range(3)], mode="edge")
        smooth = sum(k * np.take(padded, range(i, i + smooth.shape[axis]), axis=axis) for i, k in enumerate(kernel))
    edges = []
    for step, (dr, dc) in enumerate(((0, 1), (1, 0), (1, 1), (1, -1))):
        for r in range(h - dr):
            for c in range(w):
                if 0 <= c + dc < w:
                    edges.append((math.sqrt(((smooth[r, c] - smooth[r + dr, c + dc]) ** 2).sum()), step, r * w + c, (r + dr) * w + c + dc))
    edges.sort()
    group, size, inner = list(range(h * w)), [1] * (h * w), [0.0] * (h * w)
    for last in (False, True):
        for cost, _, a, b in edges:
            a, b = sorted((group[a], group[b]))
            fits = min(size[a], size[b]) < min_size if last else cost <= min(inner[a] + scale / size[a], inner[b] + scale / size[b])
            if a != b and fits:
                group = [a if g == b else g for g in group]
                size[a], inner[a] = size[a] + size[b], cost
    return np.unique(group, return_inverse=True)[1].reshape(h, w)


def test_superpixels_against_every_edge_in_turn(monkeypatch):
    monkeypatch.setattr(raster, "_growing", lambda n: zip(range(0, n, 37), [*range(37, n, 37), n]))
    rng = np.random.default_rng(5)
    for k in range(6):
        h, w = rng.integers(4, 14, 2)
        image = [rng.random((h, w, 3)), np.round(rng.random((h, w, 3)) * 2) / 2, np.kron(rng.random((h // 3 + 1, w // 3 + 1, 3)), np.ones((3, 3, 1)))[:h, :w]][k % 3]
        for scale, least in ((0.3, 12), (1.0, 3)):
            assert (raster.felzenszwalb(image, scale, 0.8, least) == plain_segments(image, scale, 0.8, least)).all()


def test_growing_parts_cover_everything():
    for n in (0, 1, 5, 1024, 100_000):
        parts = list(raster._growing(n))
        assert [p[0] for p in parts] == [0, *[p[1] for p in parts]][: len(parts)] and (not parts or parts[-1][1] == n)


def test_one_panorama_of_superpixels_is_quick():
    rng = np.random.default_rng(6)
    image = np.kron(rng.random((32, 64, 3)), np.ones((32, 32, 1))) + rng.normal(0, 0.02, (1024, 2048, 3))
    began = time.perf_counter()
    labels = raster.felzenszwalb(image)
    assert time.perf_counter() - began < 60 and 1000 < labels.max() < 100_000


def test_nearest_group_in_cells_against_all_pairs(spark):
    rng = np.random.default_rng(9)
    rooms = [(b, g, *map(float, (rng.integers(0, 5, 3) if b else rng.uniform(0, 1, 3)) + [g % 3 * 4, g // 3 * 4, 0])) for b in (0, 1) for g in range(6) for _ in range(400)]
    cams = [(b, k, *map(float, p)) for b in (0, 1) for k, p in enumerate([*rng.uniform(-2, 14, (20, 3)), *rng.integers(0, 9, (20, 3))])] + [(2, 0, 0.0, 0.0, 0.0), (0, 99, None, 0.0, 0.0)]
    items = spark.createDataFrame(cams, "building int, cam long, x double, y double, z double")
    targets = spark.createDataFrame([*rooms, (0, 3, None, 0.0, 0.0)], "building int, room long, cx double, cy double, cz double")
    for last in (True, False):
        got = {(r["building"], r["cam"]): (r["room"], round(r["distance"], 9)) for r in joins.nearest_group_in_cells(items, targets, "cam", "room", ("x", "y", "z"), ("cx", "cy", "cz"), ("building",), last).collect()}
        want = {}
        for b, k, *p in cams:
            far = [(math.dist(p, q), -g if last else g, g) for c, g, *q in rooms if c == b and None not in p]
            if far:
                want[b, k] = (min(far)[2], round(min(far)[0], 9))
        assert got == want
    one = joins.nearest_group_in_cells(items.where("building = 1"), targets.where("building = 1"), "cam", "room", ("x", "y", "z"), ("cx", "cy", "cz"))
    assert one.count() == 40


def test_nearest_group_compares_few_pairs(spark):
    """Boxes and the targets of the boxes that are left are under a tenth of all pairs."""
    side = F.expr("id % 40 / 10.0"), F.expr("id div 40 % 40 / 10.0"), F.expr("id div 1600 / 10.0")
    voxels = spark.range(40**3).select(F.expr("cast(id % 1 as int)").alias("b"), *[c.alias(f"c{a}") for c, a in zip(side, "xyz")], F.expr("cast(id % 40 div 10 as bigint)").alias("room"))
    rng = np.random.default_rng(1)
    cams = spark.createDataFrame([(0, k, *map(float, p)) for k, p in enumerate(rng.uniform(0, 4, (30, 3)))], "b int, cam long, x double, y double, z double")
    axes, spots = ("x", "y", "z"), ("cx", "cy", "cz")
    placed, boxes, kept = joins._possible_boxes(cams, voxels, "cam", "room", axes, spots, ("b",))
    compared = 30 * boxes.count() + placed.join(kept, ["b", "__c0", "__c1", "__c2", "room"]).count()
    assert compared < 0.1 * 30 * 40**3
    found = joins.nearest_group_in_cells(cams, voxels, "cam", "room", axes, spots, ("b",))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 30 and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_rays_stop_behind_a_wall(spark, monkeypatch):
    monkeypatch.setattr(rays, "FEW_TRIANGLES", 0)
    rng = np.random.default_rng(4)
    behind = rng.uniform([1, -1, -1], [9, 1, 1], (3000, 3))
    tri = [("a", k, *map(float, np.concatenate([p, p + [0, 0.1, 0], p + [0, 0, 0.1]]))) for k, p in enumerate(behind)]
    tri += [("a", 5000, 0.5, -9.0, -9.0, 0.5, 9.0, -9.0, 0.5, 0.0, 9.0)]
    beams = [("a", k, 0.0, *map(float, o), 1.0, 0.0, 0.0) for k, o in enumerate(rng.uniform(-0.9, 0.9, (200, 2)))]
    corners, ends = [f"{p}{x}" for p in "abc" for x in "xyz"], [f"{p}{x}" for p in "od" for x in "xyz"]
    mesh_rows = spark.createDataFrame(tri, "building string, face_id long, " + ", ".join(f"{c} double" for c in corners))
    beam_rows = spark.createDataFrame(beams, "building string, ray_id long, " + ", ".join(f"{c} double" for c in ends))
    walked = []
    kept = rays._Cells.met
    monkeypatch.setattr(rays._Cells, "met", lambda self, r, part=(0.0, 1.0): walked.append((part, kept(self, r, part))) or walked[-1][1])
    first = rays.cast_rays(beam_rows, mesh_rows, first_only=True).collect()
    assert len(first) == 200 and {r["face_id"] for r in first} == {5000}
    met = sum(frame.count() for _, frame in walked)
    walked.clear()
    rays.cast_rays(beam_rows, mesh_rows).count()
    assert met < 0.4 * sum(frame.count() for _, frame in walked)


@pytest.mark.parametrize("few, coarse, broadcast", [(0, 3, 10**6), (0, 3, 0), (0, -1, 10**6), (0, 1, 10**6), (64, 3, 10**6)])
def test_rays_in_blocks_and_cells(spark, monkeypatch, few, coarse, broadcast):
    """Whatever goes in blocks and what in cells, hits are those of every pair; also at a long distance and with numbers that are not finite."""
    whole = {}
    pick = np.random.default_rng(11)
    tri, beams = [], []
    for building, shift in (("a", 0.0), ("b", 1e6)):
        centre, size = pick.uniform(-5, 5, (700, 1, 3)), pick.choice([0.02, 0.4, 6.0], (700, 1, 1))
        tri += [(building, k, *map(float, c.ravel() + shift)) for k, c in enumerate(centre + size * pick.normal(size=(700, 3, 3)))]
        tri += [(building, 1000 + k, *row[2:]) for k, row in enumerate(tri[-700:][:5])]  # equal distances
        beams += [(building, k, *map(float, r)) for k, r in enumerate(np.hstack([pick.uniform(-9, 9, (300, 3)) + shift, pick.normal(size=(300, 3)) * 10.0 ** pick.integers(-3, 4, (300, 1))]))]
    tri.append(("a", 2000, float("nan"), *[0.0] * 8))
    beams += [("none", 1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), ("a", 999, float("nan"), 0.0, 0.0, 1.0, 0.0, 0.0)]
    mesh_rows = spark.createDataFrame(tri, "building string, face_id long, " + ", ".join(f"{p}{x} double" for p in "abc" for x in "xyz"))
    beam_rows = spark.createDataFrame(beams, "building string, ray_id long, " + ", ".join(f"{p}{x} double" for p in "od" for x in "xyz"))
    for name in "ab":
        t, r = (np.array([row[1:] for row in rows if row[0] == name]) for rows in (tri, beams))
        at = rays._crossing(*(r[:, 1 + 3 * k : 4 + 3 * k].T[:, :, None] for k in range(2)), *(t[:, 1 + 3 * k : 4 + 3 * k].T[:, None] for k in range(3)))
        whole |= {(name, int(r[i, 0]), int(t[j, 0])): at[i, j] for i, j in zip(*np.nonzero(np.isfinite(at)), strict=True)}
    monkeypatch.setattr(rays, "FEW_TRIANGLES", few)
    monkeypatch.setattr(rays, "COARSE", coarse)
    monkeypatch.setattr(rays, "BROADCAST_TRIANGLES", broadcast)
    assert len(whole) > 3000 and {tuple(r)[:3]: r["t"] for r in rays.cast_rays(beam_rows, mesh_rows).collect()} == whole
    first = {}
    for (name, ray, face), t in whole.items():
        first[name, ray] = min(first.get((name, ray), (np.inf, 0)), (t, face))
    assert {tuple(r)[:2]: (r["t"], r["face_id"]) for r in rays.cast_rays(beam_rows, mesh_rows, first_only=True).collect()} == first


def test_rays_do_not_walk_cells_for_large_triangles(spark, monkeypatch):
    """Triangles as wide as the scope are met in blocks; in cells every ray met them as a row."""
    monkeypatch.setattr(rays, "FEW_TRIANGLES", 0)
    monkeypatch.setattr(rays, "_Cells", None)
    pick = np.random.default_rng(3)
    mesh_rows = spark.createDataFrame([("a", k, *map(float, row)) for k, row in enumerate(pick.normal(size=(300, 9)))], "building string, face_id long, " + ", ".join(f"{p}{x} double" for p in "abc" for x in "xyz"))
    beam_rows = spark.createDataFrame([("a", k, *map(float, row)) for k, row in enumerate(pick.normal(size=(50, 6)))], "building string, ray_id long, " + ", ".join(f"{p}{x} double" for p in "od" for x in "xyz"))
    assert rays.cast_rays(beam_rows, mesh_rows).count() > 0


def test_pairs_of_one_key_are_dealt_to_tasks(spark, monkeypatch):
    """One building or one cell of truncated coordinates is not one task's."""
    monkeypatch.setattr(joins, "PAIR_BLOCK", 30, raising=False)
    items = spark.range(300).select(F.lit(1).alias("b"), F.col("id").alias("k"), (F.col("id") / 1e6).alias("x"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for pairs, n in ((joins.ordered_pairs(items, "k", ["b"], []), 300 * 299), (joins.truncated_join(items.select("k", "x"), items.select(F.col("k").alias("o"), "x"), axes=("x",)), 300 * 300)):
            by_task = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(by_task) == n and pairs.distinct().count() == n and max(by_task) < 0.8 * n
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_smooth_enlarging_moves_pixels_and_not_their_copies(spark):
    """Holes and nulls against every new pixel in turn; nothing is grouped or exchanged after pixels have been multiplied."""
    pick = np.random.default_rng(2)
    values = {(r, c): None if pick.random() < 0.2 else float(pick.integers(0, 99)) for r in range(7) for c in range(6) if pick.random() < 0.8}
    rows = spark.createDataFrame([("a", r, c, v) for (r, c), v in values.items()], "k string, r int, c int, v double")
    found = raster.enlarge_smooth(rows, ["k"], "v", 4, 7, 6)
    got = {(r["r"], r["c"]): r["v"] for r in found.collect()}
    want = {}
    for y, x in ((r * 4 + i, c * 4 + j) for r, c in values for i in range(4) for j in range(4)):
        at, left = ((y + 0.5) / 4 - 0.5, (x + 0.5) / 4 - 0.5), []
        base = [int(np.floor(a)) for a in at]
        for dr, dc in ((0, 0), (0, 1), (1, 0), (1, 1)):
            w = abs(1 - dr - (at[0] - base[0])) * abs(1 - dc - (at[1] - base[1]))
            spot = min(max(base[0] + dr, 0), 6), min(max(base[1] + dc, 0), 5)
            if spot in values:
                left.append((w, values[spot]))
        held = [w * v for w, v in left if v is not None]
        want[y, x] = sum(held) / sum(w for w, _ in left) if held else None
    assert got.keys() == want.keys() and all((got[k] is None) == (w is None) and (w is None or abs(got[k] - w) < 1e-9) for k, w in want.items())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")


def test_nearest_fill_groups_many_rows(spark):
    """Rows of a raster are filled in blocks, with words as values, as each pixel alone would be."""
    pick = np.random.default_rng(6)
    pixels = [(r, c, f"w{pick.integers(9)}" if pick.random() < 0.15 else None) for r in range(-70, 70) for c in range(5)]
    known = [p for p in pixels if p[2]]
    filled = joins.nearest_fill(spark.createDataFrame(pixels, "r int, c int, v string"), "v", [])
    assert "FLOOR" in filled._jdf.queryExecution().optimizedPlan().toString().upper()
    got = {(r["r"], r["c"]): r["v"] for r in filled.collect()}
    assert got == {(r, c): v or min(((r - y) ** 2 + (c - x) ** 2, y, x, w) for y, x, w in known)[3] for r, c, v in pixels}


def test_background_of_three_rounds_is_no_key_of_a_shuffle(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(6), rng.randrange(9), rng.randrange(4), float(rng.randrange(1, 9))) for _ in range(150)]
    votes = spark.createDataFrame(rows, "face long, inst long, class long, w double")

    def winners(rows):
        sums = {}
        for face, _, c, w in rows:
            sums[face, c] = sums.get((face, c), 0.0) + w
        return {f: min((-s, c) for (g, c), s in sums.items() if g == f)[1] for f in {f for f, _ in sums}}

    for share in (0.0, 0.2, 0.3, 0.9):
        named = [(f, 0 if c == 0 else i, c, w) for f, i, c, w in rows]
        first, kept = winners(named), set()
        for i in {r[1] for r in named}:
            own = [(f, c) for f, j, c, _ in named if j == i]
            faces, label = {f for f, _ in own}, min(own)[1]
            kept |= {i} if sum(first[f] == label for f in faces) / len(faces) >= share else set()
        found = vote.three_rounds(votes, "face", "inst", "class", "w", share)
        assert dict(map(tuple, found.collect())) == winners([r for r in named if r[1] in kept])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = vote.three_rounds(votes, "face", "inst", "class", "w", 0.3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("BroadcastHashJoin") == 2  # only those of the background's class and verdict


def test_cooccurrence_deals_its_pairs_by_their_number(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.randrange(40), rng.randrange(30)) for _ in range(400)] + [(None, 1), (None, 2), (3, None)] + [(99, i) for i in range(30)]
    members = spark.createDataFrame(rows, "element long, inst long")
    held = {}
    for e, i in {r for r in rows if None not in r}:
        held.setdefault(e, set()).add(i)
    wanted = {}
    for found in held.values():
        for a in found:
            for b in found:
                if a < b:
                    wanted[a, b] = wanted.get((a, b), 0) + 1
    monkeypatch.setattr(joins, "TASK_ROWS", 50)
    for block in (1024, 4):  # with no hot element, and with hot ones
        monkeypatch.setattr(joins, "PAIR_BLOCK", block)
        edges = joins.cooccurrence(members, "inst", ["element"])
        assert {(r["a"], r["b"]): r["shared"] for r in edges.collect()} == wanted
    parts = [int(n) for n in re.findall(r"hashpartitioning\(element#\d+L?, (\d+)\)", joins.cooccurrence(members, "inst", ["element"])._jdf.queryExecution().executedPlan().toString())]
    assert max(parts) >= sum(wanted.values()) // 50
    assert joins.cooccurrence(members.limit(0), "inst", ["element"]).count() == 0


def test_nearest_fill_runs_through_a_tall_column_once(spark):
    known = {k: k % 7 for k in (3, 900, 901, 4000, 19_990)}
    rows = [(r, 0, known.get(r)) for r in range(20_000)] + [(50, 0, 9), (4000, 1, None)]  # one place twice, and a column without a value
    filled = joins.nearest_fill(spark.createDataFrame(rows, "r int, c int, v int"), "v", [])
    # A frame up to the end of its partition is gone through for each row: quadratic in a column's length.
    assert "unboundedfollowing" not in filled._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {(r["r"], r["c"]): r["v"] for r in filled.where("r % 1000 = 0 or r between 40 and 60 or r between 2449 and 2453").collect() if r["r"] != 50}
    places = sorted([*known.items(), (50, 9)])
    want = {(r, c): min((abs(r - k), k, v) for k, v in places)[2] for r, c, _ in rows if r != 50 and (r % 1000 == 0 or 40 <= r <= 60 or 2449 <= r <= 2453)}
    assert got == want
    assert {r["v"] for r in filled.where("r = 50").collect()} == {9}


def test_first_hits_leave_out_triangles_behind_others(spark, monkeypatch):
    """Rays that know a hit meet the triangles before it alone, block by block; none of these is lost."""
    pick = np.random.default_rng(17)
    corners = pick.uniform(-1, 1, (3, 3, 900))  # corner, axis, triangle
    corners[:, :, 890:] = corners[:, :, :10]  # equal distances
    origin = np.where(np.arange(400) < 250, np.array([[3.0], [2.0], [-2.5]]), pick.uniform(-1, 1, (3, 400)))  # a camera's rays, and others
    d = np.where(np.arange(400) < 250, pick.uniform(-0.6, 0.6, (3, 400)) - origin, pick.normal(size=(3, 400))) * 10.0 ** pick.integers(-2, 3, 400)
    at = rays._crossing(*(x[:, :, None] for x in (origin, d)), *(c[:, None] for c in corners))
    first = {(1, k): (at[k].min(), int(at[k].argmin())) for k in range(400) if np.isfinite(at[k]).any()}
    assert len(first) > 300
    # A narrow bundle of rays up to a little behind their first hits.
    by_way = np.argsort(np.abs(d[:, :250] / np.abs(d[:, :250]).max(axis=0) - (d[:, :1] / np.abs(d[:, :1]).max())).sum(axis=0))[:16]
    near = at[by_way].min(axis=1)
    by_way, near = by_way[np.isfinite(near)], near[np.isfinite(near)]
    centre, sides = rays._sides(*corners)
    left = set(rays._touched(origin[:, by_way], d[:, by_way], near, centre, sides).tolist())
    assert len(left) < 450 and {j for k, t in zip(by_way, near, strict=True) for j in np.flatnonzero(at[k] <= t).tolist()} <= left
    monkeypatch.setattr(rays, "FEW_TRIANGLES", 0)
    for name, value in (("MANY_TRIANGLES", 0), ("TRIANGLE_BLOCK", 128), ("RAY_BLOCK", 32)):
        monkeypatch.setattr(rays, name, value)
    mesh_rows = spark.createDataFrame([(1, k, *map(float, corners[:, :, k].ravel())) for k in range(900)], "building int, face_id long, " + ", ".join(f"{p}{x} double" for p in "abc" for x in "xyz"))
    beam_rows = spark.createDataFrame([(1, k, *map(float, np.concatenate([origin[:, k], d[:, k]]))) for k in range(400)], "building int, ray_id long, " + ", ".join(f"{p}{x} double" for p in "od" for x in "xyz"))
    for broadcast in (10**6, 0):
        monkeypatch.setattr(rays, "BROADCAST_TRIANGLES", broadcast)
        assert {tuple(r)[:2]: (r["t"], r["face_id"]) for r in rays.cast_rays(beam_rows, mesh_rows, first_only=True).collect()} == first
    # In many buildings, some of which have no triangle in the first blocks, and with rays and triangles that are not finite.
    monkeypatch.setattr(rays, "TRIANGLE_BLOCK", 8)
    test_rays_in_blocks_and_cells(spark, monkeypatch, 0, 3, 10**6)
