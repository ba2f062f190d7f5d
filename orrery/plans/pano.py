"""Panorama stages: frames, label transfer, voting and instance clustering."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import geometry as g
from orrery.functions import vocabulary
from orrery.operators import aggregate as table
from orrery.operators import graph, joins, raster, vote
from orrery.staging import Stages


@dataclass(frozen=True)
class PanoOptions:
    ratio: float = 0.65
    share: float = 0.5
    erosion: bool = True
    stride: int = 4
    height: int = 1024
    width: int = 2048


def frame_map(spark: SparkSession, options: PanoOptions = PanoOptions(), **views) -> DataFrame:
    """Frame, fr, fc, pr, pc for all frames of a panorama; on the stride and inside the image only."""
    mapped = g.frame_pixels(g.view_parameters(spark, **views), options.height, options.width)
    inside = g.in_frame(F.col("pr"), F.col("pc"), options.height, options.width) & g.on_stride(F.col("pr"), F.col("pc"), options.stride)
    name = F.concat_ws("_", *[F.col(c).cast("string") for c in ("fov", "theta", "phi")])
    return mapped.where(inside).select(name.alias("frame"), "fr", "fc", "pr", "pc")


def globalise(detections: DataFrame) -> DataFrame:
    """Usable detections (pano, frame, det_no, class, score, mask) with an instance id from 2 up and a
    name class_k. Ids run in the order of frames and detections of a panorama."""
    usable = vocabulary.indoor(detections).where(F.size("mask") > 0)
    order = Window.partitionBy("pano").orderBy("frame", "det_no")
    named = usable.join(F.broadcast(vocabulary.classes(detections.sparkSession).select("class", "name")), "class")
    rank = F.row_number().over(Window.partitionBy("pano", "class").orderBy("frame", "det_no"))
    return named.withColumn("instance_id", F.row_number().over(order).cast("bigint") + 1).withColumn("name", F.concat_ws("_", "name", rank.cast("string")))


def shown(frames: DataFrame) -> DataFrame:
    """frame, r, c, p: the panorama pixels that a frame shows, and the frame pixel (fr, fc) that is the last on each."""
    number = F.col("fr") * 1_000_000 + F.col("fc")
    return frames.groupBy("frame", F.col("pr").alias("r"), F.col("pc").alias("c")).agg(F.max_by(F.struct("fr", "fc"), number).alias("p"))


def transfer(detections: DataFrame, frames: DataFrame, used: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cover, hits): the panorama pixels that each used frame (pano, frame) shows, and those each
    instance hits. Of several frame pixels on one panorama pixel the last counts. Where ``used``
    names panoramas only, all frames, whose names are few, are used of each.

    Masks stay runs: a run (r, start, len) meets its frame row's mapped pixels, sorted in one array as long as a frame is
    wide at most, and only those that lie in it become rows.
    """
    if "frame" not in used.columns:
        used = used.distinct().crossJoin(F.broadcast(frames.select("frame").distinct()))
    last = shown(frames)
    cover = used.select("pano", "frame").distinct().join(last.select("frame", "r", "c"), "frame")
    lines = last.groupBy("frame", F.col("p.fr").alias("fr")).agg(F.array_sort(F.collect_list(F.struct(F.col("p.fc").alias("fc"), "r", "c"))).alias("line"))
    runs = detections.select("pano", "frame", "instance_id", "class", "score", F.explode("mask").alias("run")).where("run.len > 0")
    runs = runs.select("*", F.col("run.r").alias("fr"), F.col("run.start").alias("start"), (F.col("run.start") + F.col("run.len")).alias("stop")).drop("run")
    inside = F.filter("line", lambda p: (p["fc"] >= F.col("start")) & (p["fc"] < F.col("stop")))
    hits = runs.join(lines, ["frame", "fr"]).withColumn("p", F.explode(inside))
    return cover, hits.select("pano", "frame", F.col("p.r").alias("r"), F.col("p.c").alias("c"), "instance_id", "class", "score")


def aggregate(detections: DataFrame, frames: DataFrame, options: PanoOptions = PanoOptions()) -> DataFrame:
    """Pano, r, c, class, score of voted pixels (on the stride).

    Scores are sums of detection scores and of the background prior; instances whose pixels agree
    with the winners often enough survive; a pixel has the class of the surviving instance of the
    greatest id, or background. The hits are written once, and so are the pixels with the scores of
    their classes, whose number the vocabulary bounds.
    """
    keys, stages = ["pano", "r", "c"], Stages(detections.sparkSession, "panos")
    used = detections.groupBy("pano", "frame").agg(F.count("*").alias("n"))
    hits = stages.save(transfer(globalise(detections), frames, used)[1], "hits")
    # Covered pixels, which alone have an n, and hits meet in one grouping; both sides lie by pixel from then on.
    cover = used.where("pano is not null").join(shown(frames), "frame").select(*keys, "frame", "n")
    seen = cover.unionByName(hits.select(*keys, "frame", F.lit(None).cast("bigint").alias("n"))).repartition(*keys)
    seen = seen.groupBy(*keys, "frame").agg(F.max("n").alias("n"), F.count(F.when(F.col("n").isNull(), 1)).alias("hits"))
    background = seen.groupBy(*keys).agg(F.sum((F.col("n") - F.col("hits")) * options.ratio / F.col("n")).alias("score"))
    scores = vote.scores(hits.repartition(*keys), keys, "class", F.col("score"))
    scores = scores.unionByName(background.select(*keys, F.lit(0).alias("class"), "score"))
    known = F.map_from_entries(F.collect_list(F.struct("class", "score"))).alias("scores")
    winners = stages.save(scores.groupBy(*keys).agg(F.max_by("class", F.struct(F.col("score"), -F.col("class"))).alias("class"), known), "pixels")
    kept = vote.survivors(hits, winners, keys, ["pano", "instance_id"], "class", options.share)
    top = hits.join(kept, ["pano", "instance_id"], "left_semi").groupBy(*keys).agg(F.max_by("class", "instance_id").alias("class"))
    pixels = winners.select(*keys, "scores").join(top, keys, "left").withColumn("class", F.coalesce("class", F.lit(0)))
    return pixels.select(*keys, "class", F.coalesce(F.try_element_at("scores", F.col("class")), F.lit(0.0)).alias("score"))


def cluster(hits: DataFrame, pixels: DataFrame, options: PanoOptions = PanoOptions(), neighbours: int = 200) -> DataFrame:
    """P5: pano, r, c, class, inst: instances of a class that overlap, once eroded, are one object.

    All instances of a class take part where the panorama has that class. Ids are 10, 20, ... in the
    order of classes and first members. Pixels that several objects claim are arbitrated by their
    nearest labelled pixels. Coordinates are on the stride.
    """
    step = options.stride
    grid = pixels.where("class <> 0").select("pano", "class", (F.col("r") / step).cast("int").alias("r"), (F.col("c") / step).cast("int").alias("c"))
    own = hits.select("pano", "class", "instance_id", (F.col("r") / step).cast("int").alias("r"), (F.col("c") / step).cast("int").alias("c")).distinct()
    own = own.join(grid, ["pano", "class", "r", "c"], "left_semi")
    known = vocabulary.classes(hits.sparkSession).select("class", "erode")
    mask = own.join(F.broadcast(known), "class")
    scope = ["pano", "class", "instance_id"]
    eroded = raster.erode(mask, [*scope, "erode"], F.coalesce("erode", F.lit(1))).select(*scope, "r", "c") if options.erosion else own
    # Instance ids are unique in a panorama; one number names them over all panoramas.
    names = table.identified(own, ["pano", "instance_id"], "node")
    nodes = graph.instance_clusters(eroded.join(names, ["pano", "instance_id"]).select("node", "pano", "class", "r", "c"), "node", ["pano", "class", "r", "c"])
    members = own.join(names, ["pano", "instance_id"]).join(nodes, "node")
    objects = members.groupBy("pano", "class", "component").agg(F.min("instance_id").alias("first"))
    objects = objects.withColumn("inst", F.row_number().over(Window.partitionBy("pano").orderBy("class", "first")).cast("bigint") * 10)
    claims = members.join(objects, ["pano", "class", "component"]).select("pano", "class", "r", "c", "inst").distinct()
    width = options.width // step
    claims = claims.withColumn("element", (F.col("r") * width + F.col("c")).cast("bigint"))
    contested = claims.groupBy("pano", "class", "element", "r", "c").count().where("count > 1")
    points = lambda df: df.select("pano", "class", "element", F.col("r").cast("double").alias("y"), F.col("c").cast("double").alias("x"))
    labelled = grid.withColumn("element", (F.col("r") * width + F.col("c")).cast("bigint"))
    near = joins.knn(points(contested), points(labelled).withColumnRenamed("element", "neighbour"), "element", "neighbour", ("x", "y"), neighbours, on=("pano", "class"))
    settled = graph_arbitrate(claims, near)
    return settled.select("pano", ((F.col("element") / width).cast("int") * step).alias("r"), (F.col("element") % width * step).cast("int").alias("c"), "class", "inst")


def graph_arbitrate(claims: DataFrame, near: DataFrame) -> DataFrame:
    from orrery.operators.relations import arbitrate

    return arbitrate(claims, near.select("pano", "class", "element", "neighbour"), ["pano", "class"], "element", "inst")


def upsample(pixels: DataFrame, options: PanoOptions = PanoOptions()) -> DataFrame:
    """J10 for a regular stride: each voted pixel fills its stride x stride block, without a join."""
    step = options.stride
    coarse = pixels.withColumn("r", (F.col("r") / step).cast("int")).withColumn("c", (F.col("c") / step).cast("int"))
    return raster.enlarge(coarse, step)


def bicubic(image, rows, columns):
    """Samples of an (h, w, channels) image at real places; columns wrap around, rows stop at the edge."""
    import numpy as np

    h, w = image.shape[:2]
    top, left = np.floor(rows).astype(int), np.floor(columns).astype(int)

    def weights(t):
        a = -0.75
        near, far = lambda x: (a + 2) * x**3 - (a + 3) * x**2 + 1, lambda x: a * x**3 - 5 * a * x**2 + 8 * a * x - 4 * a
        return [far(t + 1), near(t), near(1 - t), far(2 - t)]

    down, across = weights(rows - top), weights(columns - left)
    total = np.zeros((*rows.shape, image.shape[2]))
    for i in range(4):
        r = np.clip(top + i - 1, 0, h - 1)
        for j in range(4):
            total += (down[i] * across[j])[..., None] * image[r, (left + j - 1) % w]
    return np.clip(np.rint(total), 0, 255).astype(np.uint8)


def frame_images(panoramas: DataFrame, views: DataFrame) -> DataFrame:
    """Pano, frame, content: the PNG of each view (fov, theta, phi, size) of each panorama
    (pano, content). A task holds one panorama and paints one frame at a time; the views are few."""
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    from orrery.sources import png

    kind = panoramas.schema["pano"].dataType.simpleString()
    jobs = panoramas.select("pano", "content").crossJoin(F.broadcast(views.select("fov", "theta", "phi", "size")))

    def paint(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                image = png.decode(row.content)[..., :3]
                h, w = image.shape[:2]
                half, span = np.tan(np.radians(row.fov) / 2), max(row.size - 1, 1)
                side = (np.arange(row.size) / span * 2 - 1) * half
                y, z = np.meshgrid(side, -side)
                x = np.ones_like(y)
                t, p = np.radians(row.theta), np.radians(-row.phi)
                x, y = np.cos(t) * x - np.sin(t) * y, np.sin(t) * x + np.cos(t) * y
                ux, uy = -np.sin(t), np.cos(t)
                along = (ux * x + uy * y) * (1 - np.cos(p))
                x, y, z = (
                    x * np.cos(p) + uy * z * np.sin(p) + ux * along, y * np.cos(p) - ux * z * np.sin(p) + uy * along,
                    z * np.cos(p) + (ux * y - uy * x) * np.sin(p),
                )
                longitude, latitude = np.arctan2(y, x), np.arcsin(z / np.sqrt(x * x + y * y + z * z))
                columns = longitude / np.pi * (w - 1) / 2 + (w - 1) / 2
                lines = -latitude / (np.pi / 2) * (h - 1) / 2 + (h - 1) / 2
                frame = f"{row.fov}_{row.theta}_{row.phi}"
                yield pd.DataFrame({"pano": [row.pano], "frame": [frame], "content": [png.encode(bicubic(image, lines, columns))]})

    return jobs.mapInPandas(paint, f"pano {kind}, frame string, content binary")
