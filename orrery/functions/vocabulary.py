"""Class vocabulary, size groups and label palettes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The public COCO class names, whose position is the class id.
COCO = [
    '__background__', 'person', 'bicycle', 'car', 'motorcycle', 'airplane', 'bus', 'train', 'truck', 'boat', 'traffic light', 'fire hydrant',
    'stop sign', 'parking meter', 'bench', 'bird', 'cat', 'dog', 'horse', 'sheep', 'cow', 'elephant', 'bear', 'zebra', 'giraffe', 'backpack',
    'umbrella', 'handbag', 'tie', 'suitcase', 'frisbee', 'skis', 'snowboard', 'sports ball', 'kite', 'baseball bat', 'baseball glove',
    'skateboard', 'surfboard', 'tennis racket', 'bottle', 'wine glass', 'cup', 'fork', 'knife', 'spoon', 'bowl', 'banana', 'apple', 'sandwich',
    'orange', 'broccoli', 'carrot', 'hot dog', 'pizza', 'donut', 'cake', 'chair', 'couch', 'potted plant', 'bed', 'dining table', 'toilet', 'tv',
    'laptop', 'mouse', 'remote', 'keyboard', 'cell phone', 'microwave', 'oven', 'toaster', 'sink', 'refrigerator', 'book', 'clock', 'vase',
    'scissors', 'teddy bear', 'hair drier', 'toothbrush',
]
# Classes that do not occur indoors.
NOT_INDOOR = [
    'person', 'airplane', 'street sign', 'bus', 'train', 'truck', 'traffic light', 'fire hydrant', 'stop sign', 'parking meter', 'bird', 'cat',
    'dog', 'horse', 'sheep', 'cow', 'elephant', 'bear', 'zebra', 'giraffe',
]
# Classes by physical size; every other indoor class is very small.
LARGE = ['car', 'motorcycle', 'boat', 'bed', 'couch', 'dining table', 'refrigerator']
MEDIUM = ['bicycle', 'bench', 'toilet', 'tv', 'microwave', 'oven', 'sink', 'chair']
SMALL = [
    'backpack', 'umbrella', 'handbag', 'suitcase', 'skis', 'snowboard', 'baseball bat', 'skateboard', 'surfboard', 'tennis racket', 'potted plant',
    'laptop', 'keyboard', 'toaster', 'teddy bear', 'hair drier',
]
# Erosion in pixels and least number of faces by size group.
SIZE_GROUPS = {"large": (6, 500), "medium": (4, 400), "small": (2, 100), "very small": (1, 50)}


def size_group(name: str) -> str:
    for group, members in (("large", LARGE), ("medium", MEDIUM), ("small", SMALL)):
        if name in members:
            return group
    return "very small"


def limits() -> list[tuple[int, str, int | None, int | None]]:
    """class, name, erode, min_faces of the usable classes, background (0) included without limits."""
    known = [(k, n) for k, n in enumerate(COCO) if n not in NOT_INDOOR]
    return [(k, n, *(SIZE_GROUPS[size_group(n)] if k else (None, None))) for k, n in known]


def classes(spark: SparkSession) -> DataFrame:
    """:func:`limits` as a table."""
    return spark.createDataFrame(limits(), "class int, name string, erode int, min_faces int")


def indoor(rows: DataFrame, column: str = "class") -> DataFrame:
    """The rows whose class is in the vocabulary."""
    known = classes(rows.sparkSession).where("class > 0").select(F.col("class").alias(column))
    return rows.join(F.broadcast(known), column, "left_semi")


def cluster_radius(name: Column, size_x: Column, size_y: Column) -> Column:
    """Radius of density clustering by class: wide for chairs unless their box is huge, narrow for books."""
    return F.when(name == "chair", F.when((size_x > 2.5) | (size_y > 2.5), 0.01).otherwise(0.3)).when(name == "book", 0.005).otherwise(0.01)


def read_palette(spark: SparkSession, path: str) -> DataFrame:
    """idx, r, g, b from lines ``r,g,b``; the index is the line's number."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("idx", "line")).where("trim(line) <> ''")
    part = F.split("line", ",")
    return lines.select("idx", *(F.try_element_at(part, F.lit(k + 1)).try_cast("int").alias(c) for k, c in enumerate("rgb")))


def colour_index(number: Column, colours: int) -> Column:
    """A palette row for any number; colour 0 is kept for the background and numbers wrap around."""
    return F.pmod(number - 1, F.lit(colours - 1)) + 1
