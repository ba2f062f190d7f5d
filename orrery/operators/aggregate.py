"""Extents, counts, identifiers and dense arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import geometry as g
from orrery.staging import Stages


def bounding_box(points: DataFrame, keys: list[str], axes: tuple[str, ...] = ("x", "y", "z"), origin: tuple[float, ...] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Location (centre, relative to ``origin``), size, and the corners, per key."""
    box = points.groupBy(*keys).agg(*[f(a).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))])
    for a, o in zip(axes, origin, strict=True):
        low, high = F.col(f"min_{a}"), F.col(f"max_{a}")
        box = box.withColumn(f"location_{a}", low + (high - low) / 2 - o).withColumn(f"size_{a}", F.abs(high - low))
    return box


def surface(faces: DataFrame, keys: list[str], corners: tuple[g.Vector, g.Vector, g.Vector]) -> DataFrame:
    """The sum of triangle areas per key."""
    return faces.groupBy(*keys).agg(F.sum(g.triangle_area(*corners)).alias("surface_coverage"))


def voxel_grid(points: DataFrame, keys: list[str], size: float, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Per key the grid's minimum and number of voxels on each axis, centred on the box."""
    box = bounding_box(points, keys, axes)
    for a in axes:
        res = F.ceil(F.col(f"size_{a}") / size).cast("bigint")
        box = box.withColumn(f"res_{a}", res).withColumn(f"grid_{a}", F.col(f"min_{a}") + F.col(f"size_{a}") / 2 - F.col(f"res_{a}") * size / 2)
    return box.select(*keys, *[f"grid_{a}" for a in axes], *[f"res_{a}" for a in axes])


def voxel_centres(grid: DataFrame, size: float, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """All voxels of a grid: i, j, k, the flat index and the centre."""
    for n, a in zip("ijk", axes, strict=True):
        grid = grid.where(F.col(f"res_{a}") > 0).withColumn(n, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"res_{a}") - 1)))
        grid = grid.withColumn(f"c{a}", F.col(f"grid_{a}") + (F.col(n) + 0.5) * size)
    return grid.withColumn("idx", (F.col("i") * F.col(f"res_{axes[1]}") + F.col("j")) * F.col(f"res_{axes[2]}") + F.col("k"))


def voxel_index(point: g.Vector, low: g.Vector, res: g.Vector, size: float) -> tuple[Column, Column]:
    """J11 as arithmetic: the flat voxel index of a point and whether it lies in the half-open grid."""
    cell = [F.floor((p - o) / size) for p, o in zip(point, low, strict=True)]
    inside = (cell[0] >= 0) & (cell[1] >= 0) & (cell[2] >= 0) & (cell[0] < res[0]) & (cell[1] < res[1]) & (cell[2] < res[2])
    return (cell[0] * res[1] + cell[1]) * res[2] + cell[2], inside


def voxel_occupancy(points: DataFrame, grid: DataFrame, grid_keys: list[str], keys: list[str], size: float, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """The distinct voxels (keys..., idx) that hold a point. ``grid_keys`` name the grid of a point."""
    rows = points.join(grid, grid_keys) if grid_keys else points.crossJoin(F.broadcast(grid))  # one grid without keys
    idx, inside = voxel_index(g.vector(*axes), tuple(F.col(f"grid_{a}") for a in axes), tuple(F.col(f"res_{a}") for a in axes), size)
    return rows.where(inside).select(*keys, idx.alias("idx")).distinct()


def numbered(rows: DataFrame, scope: list[str], order: list[str], name: str = "id", first: int = 1, step: int = 1) -> DataFrame:
    """Dense ids in a defined order within a scope (a building, a panorama)."""
    rank = F.row_number().over(Window.partitionBy(*scope).orderBy(*order)).cast("bigint")
    return rows.withColumn(name, (rank - 1) * step + first)


def identified(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys..., name: a number for each distinct key, from 1 up in the order of the keys, with gaps.

    Two keys never share one, as they could with a hash. The table is written once, so a number
    is the same wherever it is read.
    """
    ordered = rows.select(*keys).distinct().repartitionByRange(*keys).sortWithinPartitions(*keys)
    return Stages(rows.sparkSession, "ids").save(ordered.withColumn(name, F.monotonically_increasing_id() + 1), "ids")


def instance_names(rows: DataFrame, scope: list[str], class_name: str, order: list[str]) -> DataFrame:
    """The names class_1, class_2, ... of a scope's instances."""
    rank = F.row_number().over(Window.partitionBy(*scope, class_name).orderBy(*order))
    return rows.withColumn("name", F.concat_ws("_", F.col(class_name), rank.cast("string")))


def remap(rows: DataFrame, mapping: DataFrame, column: str, old: str = "old", new: str = "new") -> DataFrame:
    """Old ids replaced by new ones; ids without a new one stay."""
    pairs = mapping.select(F.col(old).alias(column), F.col(new).alias("__new"))
    return rows.join(pairs, column, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def densify(members: DataFrame, length: DataFrame, scope: list[str], position: str, value: str, order: Column, fill: int = 0) -> DataFrame:
    """K1: one row for each position 0 .. n - 1 of a scope; of several writers the last in ``order`` stays.

    ``length`` has scope... and n; a scope's positions are dealt out in chunks before they expand.
    """
    last = members.groupBy(*scope, position).agg(F.max_by(value, order).alias(value))
    chunks = length.where("n > 0").withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / 65536))))
    chunks = chunks.repartition(*scope, "__chunk")
    upto = F.least((F.col("__chunk") + 1) * 65536, F.col("n")) - 1
    grid = chunks.select(*scope, F.explode(F.sequence(F.col("__chunk") * 65536, upto)).alias(position))
    return grid.join(last, [*scope, position], "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def large_enough(rows: DataFrame, keys: list[str], class_column: str, limits: DataFrame) -> DataFrame:
    """Groups with more rows than the least number of their class (0 where it has none)."""
    counts = rows.groupBy(*keys, class_column).agg(F.count("*").alias("n"))
    least = limits.select(F.col("class").alias(class_column), "min_faces")
    return counts.join(least, class_column, "left").where(F.col("n") > F.coalesce("min_faces", F.lit(0))).drop("min_faces")


def children(rows: DataFrame, parent: str, name: str) -> DataFrame:
    """Number of children per parent."""
    return rows.groupBy(parent).agg(F.count("*").alias(name))


def listed(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The sorted values of each key. For export; a key's list is as long as the key is frequent."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(value))
