"""Triangle meshes: OBJ scan, point sampling, labelled aggregates."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import geometry as g


def read_obj(spark: SparkSession, path: str, turn_up: bool = True) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of OBJ files, ids in file order, vertices never merged.

    A file's stem names its building. Polygons become fans of triangles; negative indices count from
    the latest vertex. ``turn_up`` turns y-up into z-up (+90 degrees about x). Files are read as lines, in as many
    splits as Spark makes of them: a line's place is its split's first byte and its place in the split, and what lies
    before a split is a prefix sum over one row of counts for each.
    """
    source = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")]
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.[^.]*$", 1).alias("building")
    word = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    lines = spark.read.text(path).select(*source, stem, F.monotonically_increasing_id().alias("line"), word.alias("word"))
    rows = lines.select("file", "split", "building", "line", F.col("word")[0].alias("kind"), F.slice("word", 2, 1_000_000).alias("arg")).where("kind in ('v', 'f')")
    rows = rows.withColumn("nv", (F.col("kind") == "v").cast("bigint"))
    rows = rows.withColumn("nt", F.when(F.col("kind") == "f", F.greatest(F.size("arg") - 2, F.lit(0))).otherwise(0).cast("bigint"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("file", "split").agg(F.sum("nv").alias("nv"), F.sum("nt").alias("nt"))
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    bases = sizes.select("file", "split", before("nv").alias("v_before"), before("nt").alias("t_before"))
    upto = Window.partitionBy("file", "split").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.join(bases, ["file", "split"]).withColumn("n", F.col("v_before") + F.sum("nv").over(upto)).withColumn("t", F.col("t_before") + F.sum("nt").over(upto) - F.col("nt"))
    number = lambda k: F.col("arg")[k].cast("double")
    x, y, z = number(0), number(1), number(2)
    if turn_up:
        y, z = -z, y
    vertices = counted.where("kind = 'v'").select("building", (F.col("n") - 1).alias("vertex_id"), x.alias("x"), y.alias("y"), z.alias("z"))
    corner = F.transform("arg", lambda a: F.split(a, "/")[0].cast("bigint"))
    polygons = counted.where("nt > 0").select("building", "t", F.transform(corner, lambda i: F.when(i < 0, F.col("n") + i).otherwise(i - 1)).alias("c"))
    fans = polygons.select("building", "t", "c", F.explode(F.sequence(F.lit(1), F.size("c") - 2)).alias("k"))
    faces = fans.select("building", (F.col("t") + F.col("k") - 1).alias("face_id"), F.col("c")[0].alias("v0"), F.col("c")[F.col("k")].alias("v1"), F.col("c")[F.col("k") + 1].alias("v2"))
    return vertices, faces


def with_corners(faces: DataFrame, vertices: DataFrame, keys: tuple[str, ...] = ("building",)) -> DataFrame:
    """Faces with the coordinates of their corners ax .. cz."""
    for slot, name in (("v0", "a"), ("v1", "b"), ("v2", "c")):
        v = vertices.select(*keys, F.col("vertex_id").alias(slot), *[F.col(x).alias(f"{name}{x}") for x in "xyz"])
        faces = faces.join(v, [*keys, slot])
    return faces


def corner_vectors() -> tuple[g.Vector, g.Vector, g.Vector]:
    return tuple(tuple(F.col(f"{n}{x}") for x in "xyz") for n in "abc")


def sample_points(cornered: DataFrame, count: int = 5, keys: tuple[str, ...] = ("building",)) -> DataFrame:
    """``count`` points of each face; point_id = face_id * count + sample_no (J3 is its inverse)."""
    rows = cornered.withColumn("sample_no", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    p = g.sample_face(*corner_vectors(), key=(*[F.col(k) for k in keys], F.col("face_id"), F.col("sample_no")))
    ids = (F.col("face_id") * count + F.col("sample_no")).cast("bigint").alias("point_id")
    return rows.select(*keys, ids, "face_id", "sample_no", *[c.alias(x) for c, x in zip(p, "xyz", strict=True)])


def labelled_instances(faces: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Instances of a labelled mesh; an instance's class is that of its first face; -1 is unlabelled."""
    rows = faces.where("inst <> -1").groupBy(*keys, "inst")
    return rows.agg(F.min_by("class", "face_id").alias("class"), F.count("*").alias("n_faces"))


def read_npz(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Numeric arrays of NPZ files, flattened: file, name, position, value. Pickled content is refused."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as data:
                    for name in names:
                        if name in data.files:
                            flat = data[name].ravel().astype(float)
                            yield pd.DataFrame({"file": file, "name": name, "position": np.arange(len(flat)), "value": flat})

    return files.mapInPandas(unpack, "file string, name string, position bigint, value double")
