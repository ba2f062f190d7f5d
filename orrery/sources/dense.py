"""Dense arrays as tables of chunks: scope, chunk, step, values.

An array of n values per scope (a building's faces or voxels) is kept as rows of up to ``step`` values. Only
members are exchanged; the gaps between them are filled inside a chunk. A range or a position is
found by its chunk's number, which Parquet can skip by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 65_536


def chunked(members: DataFrame, length: DataFrame, scope: list[str], position: str, value: str, order: Column, fill: int = 0, chunk: int = CHUNK) -> DataFrame:
    """scope..., chunk, step, values: positions 0 .. n - 1 of each scope, ``fill`` where no member is; of several writers of
    a position the last in ``order`` stays.

    ``length`` has scope... and n. Members outside 0 .. n - 1 or with a null position are left out; a
    scope with n null or below 1 has no chunks.
    """
    at = F.col(position).cast("bigint")
    rows = members.select(*scope, F.floor(at / chunk).cast("bigint").alias("chunk"), F.pmod(at, F.lit(chunk)).cast("int").alias("__at"), F.col(value).alias("__v"), order.alias("__o")).where("chunk >= 0")
    last = rows.groupBy(*scope, "chunk", "__at").agg(F.max_by("__v", "__o").alias("__v"))
    held = last.groupBy(*scope, "chunk").agg(F.array_sort(F.collect_list(F.struct("__at", "__v"))).alias("__m"))
    every = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / chunk).cast("bigint"))
    grid = length.where("n > 0").select(*scope, "n", F.explode(every).alias("chunk")).withColumn("__size", F.least(F.lit(chunk), F.col("n") - F.col("chunk") * chunk).cast("int"))
    whole = grid.join(held, [*scope, "chunk"], "left")
    whole = whole.withColumn("__m", F.filter(F.coalesce("__m", F.array().cast(held.schema["__m"].dataType)), lambda m: m["__at"] < F.col("__size")))
    m = F.col("__m")
    kind = members.schema[value].dataType
    filler = F.lit(fill).cast(kind)
    # Each member behind the gap before it, then the gap behind the last one.
    before = lambda i: F.coalesce(F.get(m, i - 1)["__at"], F.lit(-1))
    parts = F.flatten(F.transform(m, lambda x, i: F.concat(F.array_repeat(filler, x["__at"] - before(i) - 1), F.array(x["__v"]))))
    tail = F.array_repeat(filler, F.col("__size") - 1 - F.coalesce(F.get(m, F.size(m) - 1)["__at"], F.lit(-1)))
    return whole.select(*scope, "chunk", F.lit(chunk).alias("step"), F.concat(parts, tail).alias("values"))


def expanded(chunks: DataFrame, position: str, value: str, low: int = 0, high: int | None = None) -> DataFrame:
    """scope..., position, value of positions from ``low`` up to, but without, ``high``; only their chunks are read."""
    size = _chunk_size(chunks)
    rows = chunks.where(F.col("chunk") >= low // size)
    if high is not None:
        rows = rows.where(F.col("chunk") <= (high - 1) // size)
    scope = scope_of(chunks)
    rows = rows.select(*scope, "chunk", F.posexplode("values").alias("__k", value))
    rows = rows.withColumn(position, F.col("chunk") * size + F.col("__k")).where(F.col(position) >= low)
    return (rows if high is None else rows.where(F.col(position) < high)).select(*scope, position, value)


def looked_up(chunks: DataFrame, wanted: DataFrame, position: str, value: str) -> DataFrame:
    """``wanted`` with the value at its position, or null outside of the array: one row of a chunk for each."""
    size = _chunk_size(chunks)
    scope = scope_of(chunks)
    at = wanted.withColumn("chunk", F.floor(F.col(position) / size).cast("bigint"))
    met = at.join(chunks.select(*scope, "chunk", F.col("values").alias("__values")), [*scope, "chunk"], "left")
    return met.select(*wanted.columns, F.get("__values", F.pmod(F.col(position), F.lit(size)).cast("int")).alias(value))


def scope_of(chunks: DataFrame) -> list[str]:
    return [c for c in chunks.columns if c not in ("chunk", "step", "values")]


def _chunk_size(chunks: DataFrame) -> int:
    """The step of the table, which is one number and all that is read."""
    return chunks.agg(F.max("step")).first()[0] or CHUNK
