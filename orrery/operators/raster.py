"""Morphology and resampling on sparse pixel tables (M1-M5), and superpixels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.joins import nearest_fill


def _island(keys: list[str], at: str) -> Column:
    """The same number for neighbours without a gap in the line of ``keys``; places are distinct."""
    return F.col(at) - F.row_number().over(Window.partitionBy(*keys).orderBy(at))


def _kept(mask: DataFrame, keys: list[str], at: str, before: Column, after: Column) -> DataFrame:
    """Pixels with ``before`` pixels of their run ahead of them and ``after`` behind them."""
    runs = mask.withColumn("__run", _island(keys, at))
    run = Window.partitionBy(*keys, "__run")  # dealt out by its keys already
    ends = runs.withColumn("__first", F.min(at).over(run)).withColumn("__last", F.max(at).over(run))
    return ends.where((F.col(at) - before >= F.col("__first")) & (F.col(at) + after <= F.col("__last"))).drop("__run", "__first", "__last")


def _grown(mask: DataFrame, keys: list[str], at: str, before: Column, after: Column) -> DataFrame:
    """Runs, each longer by ``before`` and ``after``, pixel by pixel; where two meet, the later one begins."""
    runs = mask.withColumn("__run", _island(keys, at)).groupBy(*keys, "__run").agg(F.min(at).alias("__first"), F.max(at).alias("__last"))
    following = F.lead("__first").over(Window.partitionBy(*keys).orderBy("__first"))
    runs = runs.withColumn("__next", following)
    upto = F.least(F.col("__last") + after, F.coalesce(F.col("__next") - before - 1, F.col("__last") + after))
    return runs.withColumn(at, F.explode(F.sequence(F.col("__first") - before, upto))).drop("__run", "__first", "__last", "__next")


def _sized(mask: DataFrame, scope: list[str], size: Column | int) -> tuple[DataFrame, list[str], Column, Column]:
    """Distinct pixels by row, the keys of a mask, and how far a structure reaches before its origin s // 2 and after it."""
    keys = scope if isinstance(size, int) else [*scope, "__s"]
    width = F.lit(max(size, 1)) if isinstance(size, int) else F.col("__s")
    rows = mask.select(*scope, "r", "c") if isinstance(size, int) else mask.select(*scope, "r", "c", F.greatest(size, F.lit(1)).cast("int").alias("__s"))
    before = F.floor(width / 2).cast("int")
    # Dealt out by row once: equal pixels and runs lie together.
    return rows.repartition(*keys, "r").distinct(), keys, before, width - before - 1


def erode(mask: DataFrame, scope: list[str], size: Column | int) -> DataFrame:
    """M1/M2: pixels whose whole s x s structure is set; outside the image counts as unset.

    ``size`` may be a column of the mask (by object size); null, 0 or 1 passes the mask through, and pixels of
    different sizes are masks of their own. A pixel survives if its row's run reaches far enough on both
    sides, and then its column's run of such pixels does: two exchanges of a row for each pixel, whatever the size.
    """
    pixels, keys, before, after = _sized(mask, scope, size)
    level = _kept(pixels, [*keys, "r"], "c", before, after)
    return _kept(level, [*keys, "c"], "r", before, after).select(*scope, "r", "c")


def dilate(mask: DataFrame, scope: list[str], size: Column | int, height: int | None = None, width: int | None = None) -> DataFrame:
    """Pixels that the structure reaches from a set pixel, inside the image where its size is given.

    Runs of rows grow, then runs of columns: a pixel is exchanged once before and once after its row has grown.
    """
    pixels, keys, before, after = _sized(mask, scope, size)
    level = _grown(pixels, [*keys, "r"], "c", before, after)
    if width is not None:
        level = level.where((F.col("c") >= 0) & (F.col("c") < width))
    grown = _grown(level, [*keys, "c"], "r", before, after)
    if height is not None:
        grown = grown.where((F.col("r") >= 0) & (F.col("r") < height))
    grown = grown.select(*scope, "r", "c")
    return grown if isinstance(size, int) else grown.distinct()


def opened(mask: DataFrame, scope: list[str], size: int, height: int | None = None, width: int | None = None) -> DataFrame:
    """Erosion, then dilation."""
    return dilate(erode(mask, scope, size), scope, size, height, width)


def open_and_refill(labels: DataFrame, scope: list[str], value: str, size: int = 10) -> DataFrame:
    """M3: each label's mask is opened; pixels that lose their label take the nearest one that is left."""
    kept = opened(labels.select(*scope, value, "r", "c"), [*scope, value], size).join(labels, [*scope, value, "r", "c"], "left_semi")
    kept = kept.withColumn("__keep", F.col(value))
    both = labels.select(*scope, value, "r", "c").join(kept, [*scope, value, "r", "c"], "left").select(*scope, "r", "c", F.col("__keep").alias(value))
    return nearest_fill(both, value, scope)


def enlarge(pixels: DataFrame, factor: int = 4) -> DataFrame:
    """M4, nearest: each pixel becomes factor x factor pixels."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    rows = pixels.withColumn("__dr", F.explode(steps)).withColumn("__dc", F.explode(steps))
    return rows.withColumn("r", F.col("r") * factor + F.col("__dr")).withColumn("c", F.col("c") * factor + F.col("__dc")).drop("__dr", "__dc")


def enlarge_smooth(pixels: DataFrame, scope: list[str], value: str, factor: int, height: int, width: int) -> DataFrame:
    """M4, bilinear: the four known neighbours of each new pixel, weighted; the edge is repeated."""
    step = lambda: F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)]))
    spread = pixels.select(*scope, "r", "c", F.col(value).alias("__v")).withColumn("__dr", step()).withColumn("__dc", step())
    spread = spread.select(*scope, (F.col("r") + F.col("__dr")).alias("__r"), (F.col("c") + F.col("__dc")).alias("__c"), (4 - F.col("__dr") * 3 - F.col("__dc")).alias("__at"), "__v")
    # The nine values around each pixel, by place, and which of them there are: nine narrow rows for a pixel, whatever the factor.
    around = [f(F.when(F.col("__at") == k, x)).alias(f"__{n}{k}") for n, f, x in (("v", F.max, F.col("__v")), ("n", F.count, F.lit(1))) for k in range(9)]
    near = spread.groupBy(*scope, "__r", "__c").agg(*around)
    inside = lambda c, size: F.greatest(F.lit(0), F.least(F.lit(size - 1), c))
    rows = pixels.select(*scope, "r", "c").distinct().withColumns({"__r": inside(F.col("r"), height), "__c": inside(F.col("c"), width)}).join(near, [*scope, "__r", "__c"])
    rows = rows.withColumn("__vs", F.array(*[f"__v{k}" for k in range(9)])).withColumn("__ns", F.array(*[F.col(f"__n{k}") > 0 for k in range(9)]))
    fine = enlarge(rows.select(*scope, "r", "c", "__r", "__c", "__vs", "__ns"), factor)
    at = lambda c: (F.col(c) + 0.5) / factor - 0.5
    fine = fine.withColumn("__fr", F.floor(at("r")).cast("int")).withColumn("__fc", F.floor(at("c")).cast("int"))
    fine = fine.withColumn("__wr", at("r") - F.col("__fr")).withColumn("__wc", at("c") - F.col("__fc"))
    total, weight, some = F.lit(0.0), F.lit(0.0), F.lit(False)
    for dr, dc in ((0, 0), (0, 1), (1, 0), (1, 1)):
        place = ((inside(F.col("__fr") + dr, height) - F.col("__r") + 1) * 3 + inside(F.col("__fc") + dc, width) - F.col("__c") + 1).cast("int")
        w = (F.col("__wr") if dr else 1 - F.col("__wr")) * (F.col("__wc") if dc else 1 - F.col("__wc"))
        total = total + F.coalesce(w * F.get("__vs", place), F.lit(0.0))
        weight = weight + F.when(F.get("__ns", place), w).otherwise(0.0)
        some = some | F.get("__vs", place).isNotNull()
    return fine.select(*scope, "r", "c", F.when(some, F.try_divide(total, weight)).alias(value))


def mirror(pixels: DataFrame, width: int) -> DataFrame:
    """M5."""
    return pixels.withColumn("c", F.lit(width - 1) - F.col("c"))


def felzenszwalb(image: np.ndarray, scale: float = 0.3, sigma: float = 0.8, min_size: int = 50) -> np.ndarray:
    """Graph-based segmentation of an (h, w, channels) image: labels 0, 1, ... in scan order.

    Pixels are joined along edges of ascending colour difference while the difference does not
    exceed either side's internal difference plus scale / size; small segments are then joined.
    """
    h, w = image.shape[:2]
    smooth = image.astype(float)
    radius = max(1, int(4 * sigma + 0.5))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    for axis in (0, 1):
        pad = [(radius, radius) if a == axis else (0, 0) for a in range(3)]
        padded = np.pad(smooth, pad, mode="edge")
        smooth = sum(k * np.take(padded, range(i, i + smooth.shape[axis]), axis=axis) for i, k in enumerate(kernel))
    index = np.arange(h * w).reshape(h, w)
    ends, costs = [], []
    for dr, dc in ((0, 1), (1, 0), (1, 1), (1, -1)):
        a = (slice(0, h - dr), slice(max(0, -dc), w - max(0, dc)))
        b = (slice(dr, h), slice(max(0, dc), w - max(0, -dc)))
        costs.append(np.sqrt(((smooth[a] - smooth[b]) ** 2).sum(axis=2)).ravel())
        ends.append(np.stack([index[a].ravel(), index[b].ravel()], axis=1))
    ends, costs = np.concatenate(ends), np.concatenate(costs)
    order = np.argsort(costs, kind="stable")
    ends, costs = ends[order], costs[order]
    sets = _Sets(h * w)
    for at, stop in _growing(len(costs)):
        sets.join(ends[at:stop], costs[at:stop], lambda c, inner_a, size_a, inner_b, size_b: c <= inner_a + scale / size_a and c <= inner_b + scale / size_b)
    for at, stop in _growing(len(costs)):
        sets.join(ends[at:stop], costs[at:stop], lambda c, inner_a, size_a, inner_b, size_b: size_a < min_size or size_b < min_size, min_size)
    return np.unique(sets.roots(), return_inverse=True)[1].reshape(h, w)


def _growing(n: int) -> Iterator[tuple[int, int]]:
    """Parts of 0 .. n, each an eighth of what is left or a 64th of the whole."""
    at = 0
    while at < n:
        stop = min(n, at + max(1024, n // 64, (n - at) // 8))
        yield at, stop
        at = stop


class _Sets:
    """Disjoint sets of pixels in arrays, named by their least member, with size and internal difference."""

    def __init__(self, n: int):
        self.parent, self.size, self.inner = np.arange(n), np.ones(n, dtype=np.int64), np.zeros(n)

    def roots(self) -> np.ndarray:
        while True:
            above = self.parent[self.parent]
            if (above == self.parent).all():
                return self.parent
            self.parent = above

    def join(self, ends: np.ndarray, costs: np.ndarray, fits: Callable[..., bool], small: int | None = None) -> None:
        """Take edges in turn, joining the sets of their ends where ``fits`` says so.

        Edges inside one set are dropped in bulk beforehand, and with ``small`` those between two sets of that size: sets
        only grow, so these never join anything. Steps are left for the others alone, over the few sets that they touch.
        """
        root = self.roots()
        a, b = root[ends[:, 0]], root[ends[:, 1]]
        open_ = a != b
        if small is not None:
            open_ &= (self.size[a] < small) | (self.size[b] < small)
        a, b, costs = a[open_], b[open_], costs[open_]
        touched, local = np.unique(np.concatenate([a, b]), return_inverse=True)
        parent, size, inner = list(range(len(touched))), self.size[touched].tolist(), self.inner[touched].tolist()
        for x, y, c in zip(local[: len(a)].tolist(), local[len(a) :].tolist(), costs.tolist(), strict=True):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            while parent[y] != y:
                parent[y] = y = parent[parent[y]]
            if x != y and fits(c, inner[x], size[x], inner[y], size[y]):
                x, y = (x, y) if x < y else (y, x)
                parent[y], inner[x] = x, c
                size[x] += size[y]
        self.parent[touched] = touched[parent]
        self.size[touched], self.inner[touched] = size, inner


def superpixels(pixels: DataFrame, scope: str, scale: float = 0.3, sigma: float = 0.8, min_size: int = 50) -> DataFrame:
    """(scope, r, c, segment) of complete panoramas given as (scope, r, c, red, green, blue); one
    panorama, whose size is fixed, is one group."""
    kind = pixels.schema[scope].dataType.simpleString()

    def segment(rows: pd.DataFrame) -> pd.DataFrame:
        h, w = int(rows["r"].max()) + 1, int(rows["c"].max()) + 1
        image = np.zeros((h, w, 3))
        image[rows["r"], rows["c"]] = rows[["red", "green", "blue"]].to_numpy(float) / 255
        labels = felzenszwalb(image, scale, sigma, min_size)
        return pd.DataFrame({scope: rows[scope], "r": rows["r"], "c": rows["c"], "segment": labels[rows["r"], rows["c"]]})

    return pixels.groupBy(scope).applyInPandas(segment, f"`{scope}` {kind}, r int, c int, segment bigint")


