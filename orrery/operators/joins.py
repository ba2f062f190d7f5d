"""Joins that are not plain equi-joins: overlap, nearest, k-NN, radius, co-occurrence."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import geometry as g
from orrery.staging import Stages


#: Rows of a key that meet in one task with all rows of the key on the other side.
PAIR_BLOCK = 1024
#: Rows, or pairs that they make, of the elements of one task in :func:`cooccurrence`.
TASK_ROWS = 1 << 20


def _dealt_pairs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """``a.join(b, keys)`` for keys that may be hot. A key with n rows of ``b`` is dealt into n / ``PAIR_BLOCK`` parts of ``a``, each of
    which gets all of the key's ``b``, so that no key is one task's; other keys are not copied."""
    hot = b.groupBy(*keys).agg(F.ceil(F.count("*") / PAIR_BLOCK).cast("int").alias("__parts")).where("__parts > 1")
    hot = hot.na.drop(subset=keys)  # null keys meet nothing
    if hot.isEmpty():
        return a.join(b, keys)
    # Hot keys are at most a row for PAIR_BLOCK rows. A number of partitions that is named is not coalesced by their few bytes.
    parts, n = F.coalesce("__parts", F.lit(1)), int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = F.pmod(F.xxhash64(*a.columns), parts).cast("int")
    left = a.join(_near(hot), keys, "left").withColumn("__deal", own).drop("__parts")
    right = b.join(_near(hot), keys, "left").withColumn("__deal", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return left.repartition(n, *keys, "__deal").join(right.repartition(n, *keys, "__deal"), [*keys, "__deal"]).drop("__deal")


def truncated_join(left: DataFrame, right: DataFrame, axes: tuple[str, ...] = ("x", "y", "z"), scale: int = 1000, on: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose coordinates agree after truncation; all duplicates match."""
    keys = [f"__{a}" for a in axes]
    a = left.withColumns({k: g.truncated(F.col(c), scale) for k, c in zip(keys, axes, strict=True)})
    b = right.withColumns({k: g.truncated(F.col(c), scale) for k, c in zip(keys, axes, strict=True)}).drop(*axes)
    return _dealt_pairs(a, b, [*on, *keys]).drop(*keys)


def complete_faces(faces: DataFrame, vertices: DataFrame, face: str = "face_id", corners: tuple[str, ...] = ("v0", "v1", "v2"), vertex: str = "vertex_id", keys: tuple[str, ...] = ()) -> DataFrame:
    """Faces all of whose corners are among ``vertices``, per key of ``vertices``."""
    slots = faces.select(face, F.posexplode(F.array(*corners)).alias("__slot", vertex))
    found = slots.join(vertices.select(*keys, vertex).distinct(), vertex)
    return found.groupBy(*keys, face).agg(F.count_distinct("__slot").alias("__n")).where(F.col("__n") == len(corners)).drop("__n")


def overlap_argmax(left: DataFrame, right: DataFrame, item: str, group: str, element: str) -> DataFrame:
    """For each item the group that shares most distinct elements; ties go to the smallest group.

    Items that overlap no group stay, with a null group.
    """
    shared = left.select(item, element).distinct().join(right.select(group, element).distinct(), element)
    counts = shared.groupBy(item, group).agg(F.count("*").alias("overlap"))
    best = counts.groupBy(item).agg(F.max_by(F.struct(group, "overlap"), F.struct(F.col("overlap"), -F.col(group))).alias("best"))
    return left.select(item).distinct().join(best, item, "left").select(item, F.col(f"best.{group}").alias(group), F.col("best.overlap").alias("overlap"))


#: Targets of a cell that :func:`nearest_group_in_cells` aims at.
CELL_TARGETS = 64


def nearest_group_in_cells(
    items: DataFrame, targets: DataFrame, item: str, group: str, axes: tuple[str, ...], target_axes: tuple[str, ...], on: tuple[str, ...] = (), last_wins: bool = True
) -> DataFrame:
    """J5 for the straight distance, by branch and bound: on..., item, group, distance.

    Targets lie in cells, and of each group in a cell only the box is known at first. An item's nearest target is
    no farther than the least of its boxes' greatest distances; boxes whose least distance exceeds that are
    dropped, and only targets of the others are compared. Ties go to the greatest group, as in a scan with <=, or to the
    least. Items or targets with a null coordinate have no distance and are left out.
    """
    placed, boxes, kept = _possible_boxes(items, targets, item, group, axes, target_axes, on)
    distance = F.sqrt(_square([F.col(f"__t{k}") - F.col(f"__q{k}") for k in range(len(axes))]))
    met = placed.join(kept, [*on, *[f"__c{k}" for k in range(len(axes))], group]).select(*on, item, group, distance.alias("__d"))
    nearest = met.groupBy(*on, item, group).agg(F.min("__d").alias("__d"))
    tie = -F.col(group) if last_wins else F.col(group)
    best = nearest.groupBy(*on, item).agg(F.min_by(F.struct(group, "__d"), F.struct(F.col("__d"), tie)).alias("__best"))
    return best.select(*on, item, F.col(f"__best.{group}").alias(group), F.col("__best.__d").alias("distance"))


def _square(terms: list[Column]) -> Column:
    return functools.reduce(lambda x, y: x + y, [d * d for d in terms])


def _possible_boxes(
    items: DataFrame, targets: DataFrame, item: str, group: str, axes: tuple[str, ...], target_axes: tuple[str, ...], on: tuple[str, ...]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Targets with their cells; the box of each group in a cell; and the boxes that may hold an item's nearest target."""
    spot, at, dims = [f"__t{k}" for k in range(len(axes))], [f"__q{k}" for k in range(len(axes))], range(len(axes))
    t = targets.select(*on, group, *[F.col(a).cast("double").alias(n) for n, a in zip(spot, target_axes, strict=True)]).na.drop(subset=spot)
    q = items.select(*on, item, *[F.col(a).cast("double").alias(n) for n, a in zip(at, axes, strict=True)]).na.drop(subset=at)
    spans = [f(f"__t{k}").alias(f"__{n}{k}") for k in dims for n, f in (("min", F.min), ("max", F.max))]
    frame = t.groupBy(*on).agg(F.count("*").alias("__n"), *spans)
    extent = functools.reduce(F.greatest, [F.col(f"__max{k}") - F.col(f"__min{k}") for k in dims])
    width = extent / F.greatest(F.lit(1.0), F.pow(F.col("__n") / CELL_TARGETS, F.lit(1.0 / len(axes))))
    frame = frame.select(*on, F.when(width > 0, width).otherwise(1.0).alias("__w"), *[f"__min{k}" for k in dims])
    framed = t.join(frame, list(on)) if on else t.crossJoin(F.broadcast(frame))  # one row without a scope
    cells = [F.floor((F.col(f"__t{k}") - F.col(f"__min{k}")) / F.col("__w")).alias(f"__c{k}") for k in dims]
    placed = framed.select(*on, group, *cells, *spot)
    box = [*on, *[f"__c{k}" for k in dims], group]
    boxes = placed.groupBy(*box).agg(*spans)
    ends = [(F.col(f"__q{k}"), F.col(f"__min{k}"), F.col(f"__max{k}")) for k in dims]
    least = F.sqrt(_square([F.greatest(low - c, c - high, F.lit(0.0)) for c, low, high in ends]))
    most = F.sqrt(_square([F.greatest(F.abs(c - low), F.abs(high - c)) for c, low, high in ends]))
    pairs = _paired(boxes, q, on).select(*box, item, *at, least.alias("__least"), most.alias("__most"))
    bound = pairs.groupBy(*on, item).agg((F.min("__most") * (1 + 1e-9)).alias("__bound"))
    kept = pairs.join(bound, [*on, item]).where(F.col("__least") <= F.col("__bound")).select(*box, item, *at)
    return placed, boxes, kept


#: A side of a nested join is broadcast up to this many rows; a larger one is dealt by key blocks.
BROADCAST_ROWS = 200_000


def _near(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def _paired(rows: DataFrame, items: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """Each row with each item of its scope. Without a scope the items must be few."""
    if on:
        return rows.join(_near(items), list(on))
    if items.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} items need a scope, such as their building")
    return rows.join(F.broadcast(items), F.lit(True))


def all_distances(items: DataFrame, cameras: DataFrame, distance: Column, keep: list[str], on: tuple[str, ...] = ()) -> DataFrame:
    """The distance of every item to every camera of its scope ``on``; cameras of a building are few."""
    return _paired(items, cameras, on).select(*keep, distance.alias("distance"))


def radius_join(points: DataFrame, key: str, axes: tuple[str, ...], radius: float | Column, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs a < b of points at a distance <= radius, within equal ``on``.

    Space is cut into cells as wide as the radius; a point meets the points of its own and the
    neighbouring cells by an equi-join, and the exact distance is tested on what meets.
    """
    radius = radius if isinstance(radius, Column) else F.lit(float(radius))
    cells = [F.floor(F.col(a) / radius).cast("bigint") for a in axes]
    base = points.select(*on, key, *axes, radius.alias("__r"), *[c.alias(f"__c{i}") for i, c in enumerate(cells)])
    shifts = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    near = base.select(*on, F.col(key).alias("a"), *[F.col(a).alias(f"__p{i}") for i, a in enumerate(axes)], *[f"__c{i}" for i in range(len(axes))])
    for i in range(len(axes)):
        near = near.withColumn("__s", F.explode(shifts)).withColumn(f"__c{i}", F.col(f"__c{i}") + F.col("__s")).drop("__s")
    met = near.join(base.withColumnRenamed(key, "b"), [*on, *[f"__c{i}" for i in range(len(axes))]])
    square = sum(((F.col(f"__p{i}") - F.col(a)) * (F.col(f"__p{i}") - F.col(a)) for i, a in enumerate(axes)), F.lit(0.0))
    return met.where((F.col("a") < F.col("b")) & (square <= F.col("__r") * F.col("__r"))).select(*on, "a", "b", F.sqrt(square).alias("distance"))


def knn(queries: DataFrame, targets: DataFrame, query: str, target: str, axes: tuple[str, ...], k: int, on: tuple[str, ...] = (), block: int = 4096) -> DataFrame:
    """The k nearest targets of every query by (distance, target id), within equal ``on``.

    Exact. Where no scope has more than ``block`` targets, each query meets those of its scope.
    Else space is cut into cells, so fine that none holds many more; a query meets the targets of its cell
    and the cells around, and is done if its k nearest are nearer than any place outside those.
    Queries that are not go on with cells twice as wide, and those that no width settles meet
    all blocks of their scope. Returns on..., query, target, distance, rank.
    """
    scope = list(on)
    t = targets.select(*scope, F.col(target).cast("bigint").alias("__t"), *[F.col(a).cast("double").alias(a) for a in axes])
    q = queries.select(*scope, F.col(query).cast("bigint").alias("__q"), *[F.col(a).cast("double").alias(a) for a in axes])
    largest = t.groupBy(*scope).count().agg(F.max("count")).first()[0] or 0
    if largest <= block:
        found = _met_in_blocks(q, t, scope, axes, k, block)
    else:
        found = _met_in_cells(q, t, scope, axes, k, block)
    return found.select(*scope, F.col("__q").alias(query), F.col("__t").alias(target), F.col("__d").alias("distance"), "rank")


def _best(local: DataFrame, scope: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*scope, "__q").orderBy("__d", "__t"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k)


def _met_in_cells(q: DataFrame, t: DataFrame, scope: list[str], axes: tuple[str, ...], k: int, block: int) -> DataFrame:
    stages = Stages(q.sparkSession, "knn")
    ends = [f(a).alias(f"__{n}_{a}") for a in axes for n, f in (("low", F.min), ("high", F.max))]
    box = t.groupBy(*scope).agg(F.count("*").alias("__n"), *ends)
    extent = F.greatest(*[F.col(f"__high_{a}") - F.col(f"__low_{a}") for a in axes], F.lit(1e-300))
    box = stages.save(box.select(*scope, "__n", extent.alias("__extent"), *[f"__low_{a}" for a in axes]), "boxes")
    cells = [f"__c{n}" for n in range(len(axes))]
    with_box = lambda df: (df.join(box, scope) if scope else df.crossJoin(F.broadcast(box))).drop("__n")

    def celled(df: DataFrame, level: int) -> DataFrame:
        width = F.col("__extent") / float(1 << level)
        return df.withColumns({c: F.floor((F.col(a) - F.col(f"__low_{a}")) / width) for c, a in zip(cells, axes, strict=True)}).withColumn("__w", width)

    placed = stages.save(with_box(t), "targets")
    most = box.agg(F.max("__n")).first()[0]
    level = max(0, int(math.log2(max(1.0, most / max(k, 8))) / len(axes)))
    while level < 40 and (celled(placed, level).groupBy(*scope, *cells).count().agg(F.max("count")).first()[0] or 0) > block:
        level += 1
    open_, done = stages.save(with_box(q), "queries"), []
    for step in range(level, -1, -1):
        near = celled(placed, step)
        for c in cells:
            near = near.withColumn(c, F.explode(F.array(*[F.col(c) + d for d in (-1, 0, 1)])))
        near, own = near.select(*scope, *cells, "__t", *axes), celled(open_, step)
        # Many queries of a cell are dealt into parts, which each get the cell's targets.
        parts = own.groupBy(*scope, *cells).agg(F.ceil(F.count("*") / block).cast("bigint").alias("__parts"))
        own = own.join(parts, [*scope, *cells]).withColumn("__part", F.pmod(F.xxhash64("__q"), F.col("__parts")))
        near = near.join(parts, [*scope, *cells]).withColumn("__part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__parts") - 1))).drop("__parts")
        found = stages.save(_nearest_of(own.select(*scope, *cells, "__part", "__q", *axes), near, scope, [*scope, *cells, "__part"], axes, k), "found")
        sides = [F.least(F.col(a) - F.col(f"__low_{a}") - (F.col(c) - 1) * F.col("__w"), (F.col(c) + 2) * F.col("__w") - F.col(a) + F.col(f"__low_{a}")) for c, a in zip(cells, axes, strict=True)]
        bound = own.select(*scope, "__q", (F.least(*sides) if len(sides) > 1 else sides[0]).alias("__bound"))
        reach = found.groupBy(*scope, "__q").agg(F.count("*").alias("__n"), F.max("__d").alias("__far"))
        settled = reach.where(F.col("__n") >= k).join(bound, [*scope, "__q"]).where(F.col("__far") < F.col("__bound") * (1 - 1e-9)).select(*scope, "__q")
        settled = stages.save(settled, "settled")
        done.append(found.join(settled, [*scope, "__q"], "left_semi"))
        open_, left = stages.save_counted(open_.join(settled, [*scope, "__q"], "left_anti"), "queries")
        if not left:
            break
    else:
        done.append(_met_in_blocks(open_.select(*scope, "__q", *axes), t, scope, axes, k, block).drop("rank"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return _best(out, scope, k)


def _nearest_of(q: DataFrame, t: DataFrame, scope: list[str], keys: list[str], axes: tuple[str, ...], k: int) -> DataFrame:
    """scope..., __q, __t, __d: for each query its k nearest among the targets of its group."""
    kinds = {f.name: f.dataType.simpleString() for f in q.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in scope), "__q bigint", "__t bigint", "__d double"])

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({c: pd.Series(dtype=left.dtypes.get(c, "float64")) for c in [*scope, "__q", "__t", "__d"]})
        a, b = left[list(axes)].to_numpy(float), right[list(axes)].to_numpy(float)
        ids = right["__t"].to_numpy()
        order = np.argsort(ids, kind="stable")
        b, ids = b[order], ids[order]
        found = []
        rows = max(1, (1 << 20) // len(b))
        for at in range(0, len(a), rows):
            d = np.sqrt(((a[at : at + rows, None, :] - b[None, :, :]) ** 2).sum(axis=2))
            # A stable sort of distances keeps ties in the order of ids.
            best = np.argsort(d, axis=1, kind="stable")[:, :k]
            part = left["__q"].to_numpy()[at : at + rows]
            found.append(pd.DataFrame({"__q": np.repeat(part, best.shape[1]), "__t": ids[best].ravel(), "__d": np.take_along_axis(d, best, axis=1).ravel()}))
        found = pd.concat(found, ignore_index=True)
        for c in scope:
            found[c] = left[c].iloc[0]
        return found[[*scope, "__q", "__t", "__d"]]

    q, t = q.toDF(*q.columns), t.toDF(*t.columns)  # both sides may stem from one table
    return q.groupBy(*keys).cogroup(t.groupBy(*keys)).applyInPandas(nearest, schema)


def _met_in_blocks(q: DataFrame, t: DataFrame, scope: list[str], axes: tuple[str, ...], k: int, block: int) -> DataFrame:
    """Each block of queries meets each block of targets of its scope; the k nearest of all blocks stay."""
    counted = lambda df, name: df.groupBy(*scope).agg(F.ceil(F.count("*") / block).cast("bigint").alias(name))
    meet = lambda df, sizes: df.join(sizes, scope) if scope else df.crossJoin(F.broadcast(sizes))
    sizes = counted(t, "__blocks").join(counted(q, "__parts"), scope) if scope else counted(t, "__blocks").crossJoin(counted(q, "__parts"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col(n), F.lit(1)) - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.greatest(F.col(n), F.lit(1)))
    t = meet(t, sizes).withColumn("__block", own("__t", "__blocks")).withColumn("__part", numbers("__parts")).drop("__blocks", "__parts")
    q = meet(q, sizes).withColumn("__part", own("__q", "__parts")).withColumn("__block", numbers("__blocks")).drop("__blocks", "__parts")
    return _best(_nearest_of(q, t, scope, [*scope, "__block", "__part"], axes, k), scope, k)


def envelope(places: np.ndarray, heights: np.ndarray, keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """For each whole number x asked, the index of the parabola ``(x - place)^2 + height`` that is least there; ties go to
    the least key.

    Places ascend without repeats. Two parabolas change order once at most, so the lower envelope is a stack of
    candidates with the first x at which each is least: linear in their number.
    """
    places_, heights_, keys_ = places.tolist(), heights.tolist(), keys.tolist()
    stack: list[int] = []
    begins: list[float] = []
    for j, (q, h) in enumerate(zip(places_, heights_, strict=True)):
        begin = float("-inf")
        while stack:
            i = stack[-1]
            p = places_[i]
            # i is ahead of j up to the whole number `upto`: x <= bound / (2 (q - p)), a tie by key
            bound, width = q * q + h - p * p - heights_[i], 2 * (q - p)
            upto = bound // width if keys_[i] < keys_[j] else -(-bound // width) - 1
            if upto >= begins[-1]:
                begin = upto + 1
                break
            stack.pop()
            begins.pop()
        stack.append(j)
        begins.append(begin)
    return np.array(stack, dtype=np.int64)[np.searchsorted(np.array(begins), asked, side="right") - 1]


#: Rows of a raster that are one group of the second pass of :func:`nearest_fill`: a group costs more than a short row.
ROW_BLOCK = 64


def nearest_fill(pixels: DataFrame, value: str, scope: list[str], row: str = "r", column: str = "c") -> DataFrame:
    """Every pixel without a value takes that of the nearest pixel with one; ties go to the
    least (row, column). A raster without any value keeps its nulls.

    Exact in two passes, as in separable distance transforms: windows along each column find the
    nearest value above or below, then the lower envelope of a row's parabolas, one for each column,
    gives the nearest of these candidates. Groups are a column or a row of one raster, whose size is fixed.
    """
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(row).alias("row"), F.col(value).alias("value")))
    line = Window.partitionBy(*scope, column)
    # Both run from the start of a line: a frame that reaches to its end is gone through again for every row.
    above, below = (F.last(known, ignorenulls=True).over(line.orderBy(way).rangeBetween(Window.unboundedPreceding, Window.currentRow)) for way in (F.asc(row), F.desc(row)))
    found = pixels.select(*scope, row, column, value, above.alias("__a"), below.alias("__b"))
    nearer_below = F.col("__a").isNull() | (F.col("__b.row") - F.col(row) < F.col(row) - F.col("__a.row"))
    best = F.when(F.col("__b").isNotNull() & nearer_below, F.col("__b")).otherwise(F.col("__a"))
    found = found.withColumn("__n", best).select(*scope, row, column, value, F.col("__n.row").cast("bigint").alias("__row"), F.col("__n.value").alias("__value"))

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([row, column], kind="stable")
        at, columns, values, nearest = (rows[c].to_numpy() for c in (row, column, value, "__value"))
        values, known, open_ = values.copy(), rows["__row"].notna().to_numpy(), rows[value].isna().to_numpy()
        from_row = rows["__row"].fillna(0).to_numpy(np.int64)
        ends = np.flatnonzero(np.diff(at)) + 1
        for begin, end in zip([0, *ends], [*ends, len(at)], strict=True):
            have, gaps = begin + np.flatnonzero(known[begin:end]), begin + np.flatnonzero(open_[begin:end])
            if len(have) and len(gaps):
                have = have[np.unique(columns[have], return_index=True)[1]]
                at_row, at_column = from_row[have], columns[have].astype(np.int64)
                key = np.empty(len(have), dtype=np.int64)
                key[np.lexsort((at_column, at_row))] = np.arange(len(have))
                values[gaps] = nearest[have[envelope(at_column, (at_row - int(at[begin])) ** 2, key, columns[gaps].astype(np.int64))]]
        return rows.assign(**{value: values})[[*scope, row, column, value]]

    kinds = {f.name: f.dataType.simpleString() for f in found.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*scope, row, column, value])
    return found.groupBy(*scope, F.floor(F.col(row) / ROW_BLOCK)).applyInPandas(take, schema)


def cooccurrence(members: DataFrame, instance: str, element: list[str]) -> DataFrame:
    """Pairs a < b of instances that share an element, and on how many they meet.

    Elements are dealt to as many tasks as their rows and pairs need, which are counted before: the pairs that a task adds up are
    mostly different ones.
    """
    spark = members.sparkSession
    members = members.select(*element, instance).na.drop()  # nulls meet nothing
    dealt = lambda n: members.repartition(max(spark.sparkContext.defaultParallelism, -(-n // TASK_ROWS)), *element).distinct()
    n = members.count()
    size = F.col("n")
    met, most = dealt(n).groupBy(*element).agg(F.count("*").alias("n")).agg(F.sum(size * (size - 1) / 2), F.max(size)).first()
    rows = dealt(max(n, int(met or 0)))
    a, b = rows.withColumnRenamed(instance, "a"), rows.withColumnRenamed(instance, "b")
    pairs = (_dealt_pairs(a, b, element) if (most or 0) > PAIR_BLOCK else a.join(b, element)).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))


def common_rays(hits: DataFrame, ray: str, item: str, order: Column, scope: list[str] | None = None) -> DataFrame:
    """For rays that hit two items, which was hit first: scope..., ray, a, b, a_first (both directions)."""
    keys = [*(scope or []), ray]
    first = hits.groupBy(*keys, item).agg(F.min(order).alias("at"))
    other = first.select(*keys, F.col(item).alias("b"), F.col("at").alias("b_at"))
    pairs = first.withColumnRenamed(item, "a").join(other, keys).where("a <> b")
    return pairs.select(*keys, "a", "b", (F.col("at") < F.col("b_at")).alias("a_first"))


def ordered_pairs(items: DataFrame, item: str, scope: list[str], keep: list[str]) -> DataFrame:
    """All ordered pairs of different items of a scope (such as a building), which the pair queries ask for."""
    if not scope:
        items, scope = items.withColumn("__all", F.lit(0)), ["__all"]
    a = items.select(*scope, *[F.col(c).alias(f"a_{c}") for c in [item, *keep]])
    b = items.select(*scope, *[F.col(c).alias(f"b_{c}") for c in [item, *keep]])
    return _dealt_pairs(a, b, scope).where(F.col(f"a_{item}") != F.col(f"b_{item}")).drop("__all")


def with_defaults(rows: DataFrame, attributes: DataFrame, on: list[str]) -> DataFrame:
    """Attributes by key; rows without any keep nulls."""
    return rows.join(attributes, on, "left")
