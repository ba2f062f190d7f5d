"""Readers for poses, attributes and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSE_CSV = "camera string, tx double, ty double, tz double, qx double, qy double, qz double, qw double"
POSE_JSON = "field_of_view_rads double, camera_rotation_final array<double>, camera_location array<double>"


def _stem(column: str = "_metadata.file_name"):
    return F.regexp_extract(F.col(column), r"^(.*?)(\.[^.]*)?$", 1)


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """Headerless pose lines; of several lines of a camera the last one of the file stays.

    The file offset of a line orders it: rows of a text file are read with their row index only
    inside a split, so a whole file is one row here. Pose files hold one line per camera.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "text")).where("trim(text) <> ''")
    part = F.transform(F.split("text", ","), lambda p: F.trim(p))
    names = [c.split()[0] for c in POSE_CSV.split(", ")]
    rows = lines.select("line", *[(part[k] if k == 0 else part[k].cast("double")).alias(n) for k, n in enumerate(names)])
    last = rows.groupBy("camera").agg(F.max_by(F.struct(*names[1:]), "line").alias("p"))
    return last.select("camera", "p.*")


def read_frame_poses(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per file; the camera is the file name before ``_domain``."""
    rows = spark.read.schema(POSE_JSON).option("multiLine", True).json(path)
    name = F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), r"_domain.*$|\.json$", "")
    at = lambda c, k: F.col(c)[k]
    return rows.select(
        name.alias("camera"), F.col("field_of_view_rads").alias("fov"),
        *[at("camera_location", k).alias(a) for k, a in enumerate(("x", "y", "z"))],
        *[at("camera_rotation_final", k).alias(a) for k, a in enumerate(("rx", "ry", "rz"))],
    ).orderBy("camera")


def read_buildings(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """S3: building attributes; uuid columns are dropped, empty fields are null, and the column that names
    the data set's split is called ``split`` whatever its prefix."""
    rows = spark.read.option("header", True).csv(path)
    named = lambda k, c: "model" if k == 0 else "split" if c.endswith("_split") else c
    rows = rows.select([F.col(f"`{c}`").alias(named(k, c)) for k, c in enumerate(rows.columns) if "uuid" not in c.lower()])
    if "floors" in rows.columns:
        rows = rows.withColumn("floors", F.expr("try_cast(floors as int)"))
    return rows if model is None else rows.where(F.col("model") == model)


def object_attributes(lines: DataFrame, line: str = "line", text: str = "text") -> DataFrame:
    """A wide sheet as rows. ``lines`` are numbered from 0: models, sub-headers, then values.

    Every model owns a block of six columns: instance, class, tactile, visual and two materials. A
    model's name stands over the first column of its block. Empty cells are null; materials are a
    list of those given.
    """
    cells = lines.select(line, F.split(text, ",", -1).alias("cell"))
    heads = cells.where(F.col(line) == 0).select(F.posexplode("cell").alias("at", "model")).where("trim(model) <> ''")
    values = cells.where(F.col(line) >= 2)
    cut = F.transform(F.slice("cell", F.col("at") + 1, 6), lambda c: F.nullif(F.trim(c), F.lit("")))
    rows = values.join(F.broadcast(heads), F.size("cell") > F.col("at")).select(F.trim("model").alias("model"), cut.alias("b"))
    get = lambda k: F.try_element_at("b", F.lit(k))
    return rows.select(
        "model", get(1).cast("int").alias("instance"), get(2).alias("class"), get(3).alias("tactile_texture"), get(4).alias("visual_texture"),
        F.array_compact(F.array(get(5), get(6))).alias("material"),
    ).where("instance is not null")


def read_object_attributes(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    return object_attributes(lines)


def affordances(lines: DataFrame, text: str = "text") -> DataFrame:
    """Class and the list of its actions from ragged lines; a class on several lines has them all."""
    cells = lines.select(F.split(text, ",").alias("cell"))
    name = F.trim(F.col("cell")[0])
    actions = F.filter(F.transform(F.slice("cell", 2, 1_000_000), lambda c: F.trim(c)), lambda c: c != "")
    rows = cells.select(name.alias("class"), actions.alias("actions")).where("class <> ''")
    return rows.groupBy("class").agg(F.flatten(F.collect_list("actions")).alias("actions"))


def read_affordances(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    return affordances(lines.where("line > 0"))


def room_attributes(names: DataFrame, name: str = "file_name") -> DataFrame:
    """Scene category and floor from ``<function>__<floor>_*.obj``; other names have none."""
    pattern = r"^(.+?)__([^_]+)_.*\.obj$"
    part = lambda k: F.nullif(F.regexp_extract(name, pattern, k), F.lit(""))
    return names.withColumns({"scene_category": part(1), "floor_number": part(2)})


def pano_bundle(pixels: DataFrame) -> DataFrame:
    """Per panorama the classes present; panoramas without labelled pixels are absent."""
    return pixels.where("class <> 0").groupBy("pano").agg(F.array_sort(F.collect_set("class")).alias("classes"))


def pano_objects(pixels: DataFrame) -> DataFrame:
    """Pano, class, inst, n_pixels and the sorted pixels (r, c) of each labelled instance (pano, r, c,
    class, inst). Panoramas without clusters, and background pixels, are absent."""
    rows = pixels.where("class <> 0 and inst <> 0").groupBy("pano", "class", "inst")
    return rows.agg(F.count("*").alias("n_pixels"), F.array_sort(F.collect_list(F.struct("r", "c"))).alias("pixels"))
