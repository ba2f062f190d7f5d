"""Hard negatives by bit-sliced integer products (operator 13).

Vectors become whole numbers and are packed into blocks; every block of anchors meets every block of
rows. A row's components are taken apart into bit planes. Planes are multiplied with the anchors most
significant first; after each one a score is known up to what the planes below can add or take, which
the anchor's positive and negative components bound. A row is dropped once its interval lies outside
what is asked: below the k-th greatest lower bound for positives, outside all windows of the anchor's
positives for negatives. Few rows are left after the upper planes, and only these are carried on.

What a task keeps is the best rows of a bounded number of anchors; the best of all tasks
are taken by a window with a limit on each side of the exchange.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.rows import ROW, trimmed, with_row_key
from orrery.staging import Stages

#: Rows and anchors of one block, and anchors compared at a time.
BLOCK_ROWS, BLOCK_ANCHORS, CHUNK = 4096, 512, 128
#: From this share of pairs left on, pairs are carried one by one.
SPARSE = 1 / 32
#: Blocks of anchors whose best rows a task keeps at a time.
HELD_BLOCKS = 64
#: Places of an anchor that are not in use.
NO_SCORE = -(2**63)

BLOCKS = pa.schema([
    ("block", pa.int64()), ("dims", pa.int32()), ("row", pa.binary()), ("label", pa.binary()), ("vector", pa.binary()), ("narrow", pa.bool_()),
    ("positives", pa.binary()), ("places", pa.int32()),
])
BLOCKS_DDL = "block long, dims int, row binary, label binary, vector binary, narrow boolean, positives binary, places int"
FOUND_DDL = "anchor long, place int, row long, score long"


@dataclass
class Block:
    """Rows of whole-number vectors: ``values`` (n, d), row keys, labels, and scores of positives (n, places)."""

    values: np.ndarray
    row: np.ndarray
    label: np.ndarray
    positives: np.ndarray

    @cached_property
    def largest(self) -> int:
        return int(np.abs(self.values).max(initial=0))

    @cached_property
    def planes(self) -> list[np.ndarray]:
        """Bit planes of the values plus half their range, least significant first."""
        bits = self.largest.bit_length() + 1
        kind = np.int64 if bits < 62 else object
        shifted = _whole(self.values, kind) + (1 << (bits - 1))
        return [((shifted >> k) & 1).astype(np.float32 if kind is np.int64 else object) for k in range(bits)]

    def part(self, at: np.ndarray | slice) -> Block:
        return Block(self.values[at], self.row[at], self.label[at], self.positives[at])


def _whole(values: np.ndarray, kind: type) -> np.ndarray:
    if kind is object:
        return np.array([int(v) for v in values.ravel()], dtype=object).reshape(values.shape)
    return values.astype(kind)


def _unpacked(batch: pa.RecordBatch, prefix: str, k: int) -> Block:
    get = lambda name: batch.column(prefix + name)[k].as_py()
    row = np.frombuffer(get("row"), dtype="<i8")
    values = np.frombuffer(get("vector"), dtype="<i2" if get("narrow") else "<f8").astype(np.float64).reshape(len(row), get("dims"))
    positives = np.frombuffer(get("positives"), dtype="<i8").reshape(len(row), get("places"))
    return Block(values, row, np.frombuffer(get("label"), dtype="<i8"), positives)


def _packed(rows: DataFrame, size: int, places: int, scale: int) -> DataFrame:
    """Blocks of at most ``size`` of a partition's rows ``(row, label, vector, positives)``; shorter vectors end in zeros."""

    def block(part: pa.RecordBatch, number: int) -> pa.RecordBatch:
        lists, n = part.column("vector"), part.num_rows
        length = np.array(lists.value_lengths(), dtype=np.int64)
        dims = int(length.max(initial=0))
        values = np.zeros((n, dims))
        values[np.arange(dims) < length[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        values = np.floor(scale * values)
        narrow = bool(np.abs(values).max(initial=0) < 2**15)
        scores = np.full((n, places), NO_SCORE, dtype="<i8")
        for k, found in enumerate(part.column("positives").to_pylist()):
            scores[k, : len(found)] = found
        cells = [number, dims, part.column("row").to_numpy().astype("<i8").tobytes(), part.column("label").to_numpy().astype("<i8").tobytes(), values.astype("<i2" if narrow else "<f8").tobytes(), narrow, scores.tobytes(), places]
        return pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip(cells, BLOCKS, strict=True)], schema=BLOCKS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for k in range(0, batch.num_rows, size):
                held.append(batch.slice(k, size))
                if sum(b.num_rows for b in held) >= size:
                    whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    yield block(whole.slice(0, size), number)
                    held, number = [whole.slice(size)], number + 1
        rest = pa.Table.from_batches(held).combine_chunks().to_batches() if held else []
        if rest and rest[0].num_rows:
            yield block(rest[0], number)

    return rows.select("row", "label", "vector", "positives").mapInArrow(trimmed(work), BLOCKS_DDL)


def _order(*keys: np.ndarray) -> np.ndarray:
    """Places in ascending order, the last key first; whole numbers of any size are keys too."""
    return np.lexsort([np.unique(k, return_inverse=True)[1] if k.dtype == object else k for k in keys])


def _kth(group: np.ndarray, value: np.ndarray, groups: int, k: int) -> np.ndarray:
    """For each group the k-th greatest of its values, or minus infinity if it has fewer."""
    order = _order(-value, group)
    count = np.bincount(group, minlength=groups)
    at = np.cumsum(count) - count + k - 1
    found = np.full(groups, -np.inf, dtype=value.dtype)
    found[count >= k] = value[order][at[count >= k]]
    return found


class Greatest:
    """Asks for the ``k`` greatest scores of each anchor; ``floor`` is a score that ``k`` rows are known to reach."""

    def __init__(self, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor

    def dense(self, low: np.ndarray, high: np.ndarray, alive: np.ndarray) -> np.ndarray:
        least, n = self.floor, low.shape[1]
        if n >= self.k:
            known = np.where(alive, low, -np.inf)
            least = np.maximum(least, np.partition(known, n - self.k, axis=1)[:, n - self.k])
        return high >= least[:, None]

    def sparse(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return high >= np.maximum(self.floor, _kth(anchor, low, len(self.floor), self.k))[anchor]

    def places(self, anchor: np.ndarray, score: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        yield 0, np.ones(len(score), dtype=bool)


class Windows:
    """Asks for the ``k`` greatest scores in each window ``[least, most]`` (anchors, places) of each anchor."""

    def __init__(self, k: int, floor: np.ndarray, least: np.ndarray, most: np.ndarray):
        self.k, self.floor, self.least, self.most = k, floor, least, most

    def dense(self, low: np.ndarray, high: np.ndarray, alive: np.ndarray) -> np.ndarray:
        return (high >= self.least.min(axis=1)[:, None]) & (low <= self.most.max(axis=1)[:, None])

    def sparse(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        wanted = np.zeros(len(anchor), dtype=bool)
        for p in range(self.least.shape[1]):
            least, most = self.least[anchor, p], self.most[anchor, p]
            sure = (low >= least) & (high <= most)
            floor = np.maximum(self.floor[:, p], _kth(anchor[sure], low[sure], len(self.floor), self.k))
            wanted |= (high >= least) & (low <= most) & (high >= floor[anchor])
        return wanted

    def places(self, anchor: np.ndarray, score: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for p in range(self.least.shape[1]):
            yield p, (score >= self.least[anchor, p]) & (score <= self.most[anchor, p])


def narrowed(anchors: np.ndarray, planes: list[np.ndarray], eligible: np.ndarray, asked: Greatest | Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (anchor, row) that may be asked for, with their scores, exact.

    ``eligible`` (anchors, rows) says which pairs take part. Arithmetic is in floats where these hold all
    sums exactly, else in Python's whole numbers, where a score beyond a long counts as the nearest long.
    """
    top = len(planes)
    reach = int(np.abs(anchors).sum(axis=1).max(initial=0))
    exact = planes[0].dtype == object or reach << top >= 2**53
    a = _whole(anchors, object) if exact else anchors
    kind = object if exact else np.float32 if reach < 2**24 else np.float64
    factor = a.astype(kind)
    plane = planes.__getitem__ if planes[0].dtype == kind else lambda k: planes[k].astype(np.int64).astype(kind)
    below, above = np.minimum(a, 0).sum(axis=1), np.maximum(a, 0).sum(axis=1)
    score = np.repeat((a.sum(axis=1) * -(1 << (top - 1)))[:, None], eligible.shape[1], axis=1)
    bound = (lambda x: np.minimum(np.maximum(x, -(2**63)), 2**63 - 1)) if exact else lambda x: x
    alive, ai, ci, s = eligible, None, None, None
    for k in reversed(range(top)):
        rest = (1 << k) - 1  # what the planes below amount to at most
        if ai is None:
            score += (factor @ plane(k).T).astype(score.dtype) * (1 << k)
            alive = alive & asked.dense(bound(score + (rest * below)[:, None]), bound(score + (rest * above)[:, None]), alive)
            if k and alive.sum() > SPARSE * alive.size:
                continue
            ai, ci = np.nonzero(alive)
            s = score[ai, ci]
        else:
            s = s + (factor[ai] * plane(k)[ci]).sum(axis=1).astype(s.dtype) * (1 << k)
        keep = asked.sparse(ai, bound(s + rest * below[ai]), bound(s + rest * above[ai]))
        ai, ci, s = ai[keep], ci[keep], s[keep]
    return ai, ci, bound(s)


class Best:
    """The best rows found so far for the anchors of one block, ``k`` for each place."""

    def __init__(self, anchors: Block, k: int, negatives: bool, percent: int):
        self.anchors, self.k, self.negatives = anchors, k, negatives
        self.places = anchors.positives.shape[1] if negatives else 1
        self.slot, self.row, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        used = anchors.positives != NO_SCORE
        whole = anchors.positives.astype(object)
        self.least = np.where(used, -((-percent * whole) // 100), np.inf)
        self.most = np.where(used, whole, -np.inf)
        if not (used.any() and np.abs(whole[used]).max() >= 2**53):
            self.least, self.most = self.least.astype(np.float64), self.most.astype(np.float64)

    def meet(self, rows: Block) -> None:
        for at in range(0, len(self.anchors.row), CHUNK):
            chunk = np.arange(at, min(at + CHUNK, len(self.anchors.row)))
            if self.negatives:
                self._compare(chunk, rows, np.arange(len(rows.row)))
                continue
            for label in np.unique(self.anchors.label[chunk]):
                members = np.flatnonzero(rows.label == label)
                if len(members):
                    self._compare(chunk[self.anchors.label[chunk] == label], rows, members)

    def _compare(self, at: np.ndarray, rows: Block, members: np.ndarray) -> None:
        part = self.anchors.part(at)
        floor = self._floor().reshape(-1, self.places)[at]
        if self.negatives:
            eligible = part.label[:, None] != rows.label[members]
            asked = Windows(self.k, floor, self.least[at], self.most[at])
        else:
            eligible = part.row[:, None] != rows.row[members]
            asked = Greatest(self.k, floor[:, 0])
        d = max(part.values.shape[1], rows.values.shape[1])  # a shorter vector ends in zeros, which add nothing
        common = min(part.values.shape[1], rows.values.shape[1])
        planes = [p[members][:, :common] for p in rows.planes] if common < d or len(members) < len(rows.row) else rows.planes
        ai, ci, s = narrowed(part.values[:, :common], planes, eligible, asked)
        slots, found, scores = [self.slot], [self.row], [self.score]
        for place, fits in asked.places(ai, s):
            slots.append(at[ai[fits]] * self.places + place)
            found.append(rows.row[members[ci[fits]]])
            scores.append(s[fits])
        slot, row, score = np.concatenate(slots), np.concatenate(found), np.concatenate(scores)
        order = _order(row, -score, slot)
        slot, row, score = slot[order], row[order], score[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        self.slot, self.row, self.score = slot[rank < self.k], row[rank < self.k], score[rank < self.k]

    def _floor(self) -> np.ndarray:
        return _kth(self.slot, self.score, len(self.anchors.row) * self.places, self.k)

    def given(self) -> pa.RecordBatch:
        score = np.array([int(x) for x in self.score], dtype=np.int64)
        cells = [pa.array(self.anchors.row[self.slot // self.places]), pa.array((self.slot % self.places).astype(np.int32)), pa.array(self.row), pa.array(score)]
        return pa.RecordBatch.from_arrays(cells, names=["anchor", "place", "row", "score"])


def _found(rows: DataFrame, anchors: DataFrame, k: int, negatives: bool, percent: int) -> DataFrame:
    """The ``k`` best rows for each anchor and place that each task finds, then the best of these."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, Best] = OrderedDict()
        last, block = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                key, name = batch.column("a_block")[i].as_py(), batch.column("block")[i].as_py()
                if name != last:
                    last, block = name, _unpacked(batch, "", i)
                if key not in held:
                    held[key] = Best(_unpacked(batch, "a_", i), k, negatives, percent)
                held.move_to_end(key)
                held[key].meet(block)
                if len(held) > HELD_BLOCKS:
                    yield held.popitem(last=False)[1].given()
        while held:
            yield held.popitem()[1].given()

    # The stated anchors against all rows, block by block.
    pairs = rows.crossJoin(anchors.select(*(F.col(c).alias(f"a_{c}") for c in anchors.columns)))
    found = pairs.mapInArrow(trimmed(work), FOUND_DDL)
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, anchors: Column, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding",
    positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256,
) -> DataFrame:
    """Hard negatives of the rows for which the condition ``anchors`` holds: ``anchor_id``, ``positive_id``, ``rank``,
    ``negative_id``, ``positive_score``, ``negative_score``.

    A component x counts as ``floor(scale * x)``; a score is the inner product of whole numbers. An
    anchor's positives are its ``positives`` best other rows of the same label; for each, the first
    ``negatives`` rows of other labels score at least ``percent`` percent of it and no more than it.
    Higher scores come first, ties by smaller id, rows without one last. Rows with a null label or vector or with a
    null or non-finite component take no part. Where lengths differ, a shorter vector ends in zeros. Rows that
    repeat an id are rows of their own, each an anchor and another row to its like. A score beyond a long counts as
    the nearest long. Empty tables and anchors without positives give no rows;
    other columns are ignored.
    """
    spark = vectors.sparkSession
    stages = Stages(spark, "negatives")
    slim = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    keyed, unique = with_row_key(slim.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & finite), "vec_id", stages)
    rows = keyed.withColumnRenamed(ROW, "row").withColumn("positives", F.array().cast("array<long>"))
    blocks = stages.save(_packed(rows, BLOCK_ROWS, 0, scale), "rows")
    asking, n = stages.save_counted(rows.where("anchor").drop("positives"), "anchors")
    parts = max(1, -(-n // BLOCK_ANCHORS))

    asked = _packed(asking.withColumn("positives", F.array().cast("array<long>")).repartition(parts), BLOCK_ANCHORS, 0, scale)
    near = _found(blocks, stages.save(asked, "asked"), positives, False, percent)
    near = stages.save(near.select("anchor", (F.col("rank") - 1).alias("place"), F.col("row").alias("positive"), F.col("score").alias("positive_score")), "positives")
    scores = near.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("s"))  # a few each
    windows = asking.join(scores.select("row", F.col("s.positive_score").alias("positives")), "row")
    windows = stages.save(_packed(windows.repartition(parts), BLOCK_ANCHORS, positives, scale), "windows")
    found = _found(blocks, windows, negatives, True, percent).withColumnRenamed("row", "negative").join(near, ["anchor", "place"])
    if not unique:
        names = keyed.select(F.col(ROW).alias("key"), F.col("vec_id").alias("id"))
        for side in ("anchor", "positive", "negative"):
            found = found.withColumnRenamed(side, "key").join(names, "key").drop("key").withColumnRenamed("id", side)
    return found.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("negative").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def shifted_labels(vectors: DataFrame) -> DataFrame:
    """``vectors`` in which rows whose id is divisible by 7 have the next label of ten."""
    label = F.col("label").cast("long")
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


def mine_vectors(vectors: DataFrame) -> DataFrame:
    """Production parameters: anchors are the rows whose id is divisible by 100; 5 positives, 5 negatives each, 80 percent."""
    return mine(shifted_labels(vectors), F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r AS other, b.vec_id AS other_id, a.label = b.label AS same,
         coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda x: x[1] * x[2])), 0)::BIGINT AS score
  FROM kept a, kept b WHERE a.vec_id % 100 = 0 AND a.r <> b.r),
positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5),
ranked AS (
  SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other) AS rank
  FROM positives p JOIN scored n ON p.anchor = n.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""
