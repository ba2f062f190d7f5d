"""Near-duplicate detection by circulant MinHash (operator 8).

One permutation (sigma) breaks up the structure of the shingle hashes; a second one (pi),
shifted circularly by k, gives coordinate k of the signature, so two permutations make all
coordinates. Bands of coordinates name buckets, and what meets in a bucket is confirmed on the
full shingle sets.

Only components are asked for, so a large bucket never expands into its pairs:

1. Documents with equal sets are one class at once. Each bucket has a centre, and each document is
   compared with the centres it meets most often. Most buckets are then inside one component and
   are done.
2. Of buckets of up to ``SMALL`` members that still hold several components, the pairs across
   components are compared, a number for each member that ``SMALL`` bounds.
3. Larger ones are joined up into families. A family's members are dealt into blocks of a bounded
   number of shingles, and blocks are compared by counting common shingles, giving only links
   that connect something new.

A pair that meets in a bucket is thus compared unless its ends are linked already. Before texts are
sent for a comparison, two bits of each coordinate tell pairs that are far from the threshold. Links found in
steps 2 and 3 join up the components of step 1, not the documents anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.rows import ROW, trimmed, with_row_key
from orrery.llm.shingles import WORDS, mix64, shingle_sets
from orrery.operators.graph import components
from orrery.staging import Stages

#: Up to this many rows (some MB) a table of ids is broadcast; beyond it is joined by shuffle.
NEAR_ROWS = 100_000
#: Members that one task compares with a centre before the group is split further.
GROUP = 256
#: Centres that a member is compared with in the first round.
CENTRES = 2
#: Buckets up to this size are resolved pair by pair, larger ones by blocks.
SMALL = 32
#: Shingles and documents of a block at most, on average.
BLOCK, BLOCK_DOCS = 1 << 20, 1 << 13
#: Cells of a matrix of a block comparison.
CELLS = 1 << 20
_U32 = np.uint32
_CELLS = 1 << 16


@dataclass(frozen=True)
class Banding:
    """50 bands of 5 coordinates: a pair at similarity 0.75 shares no band once in 10^6 times."""

    bands: int = 50
    rows: int = 5

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows

    @property
    def words(self) -> int:
        """Of 64 bits, for a bit of each coordinate."""
        return -(-self.coordinates // 64)

    def most_unlike(self, percent: int) -> float:
        """Coordinates that differ in their last two bits: six standard deviations above what a pair at
        the threshold has on average, which it exceeds once in 10^9 times."""
        p = (1 - percent / 100) * 0.75
        return self.coordinates * p + 6 * (self.coordinates * p * (1 - p)) ** 0.5


def _sigma(x: np.ndarray) -> np.ndarray:
    """The first permutation, of 32-bit integers."""
    x = x ^ (x >> _U32(16))
    x *= _U32(0x85EBCA6B)
    x ^= x >> _U32(13)
    x *= _U32(0xC2B2AE35)
    x ^= x >> _U32(16)
    return x


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least pi(sigma(s) + k mod 2^32)."""
    base = _sigma((shingles >> np.uint64(32)).astype(np.uint32))
    shift = np.arange(1, coordinates + 1, dtype=np.uint32)[:, None]
    least = np.full(coordinates, 0xFFFFFFFF, dtype=np.uint32)
    width = max(1, _CELLS // coordinates)
    spare = np.empty((coordinates, min(width, len(base))), dtype=np.uint32)
    for at in range(0, len(base), width):
        y = base[None, at : at + width] + shift
        t = spare[:, : y.shape[1]]
        np.right_shift(y, _U32(16), out=t)
        np.bitwise_xor(y, t, out=y)
        np.multiply(y, _U32(0x7FEB352D), out=y)
        np.right_shift(y, _U32(15), out=t)
        np.bitwise_xor(y, t, out=y)
        np.multiply(y, _U32(0x846CA68B), out=y)
        np.minimum(least, y.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray, banding: Banding) -> np.ndarray:
    """A 64-bit bucket name for each band."""
    grid = least.reshape(banding.bands, banding.rows).astype(np.uint64)
    key = np.arange(1, banding.bands + 1, dtype=np.uint64)
    for k in range(banding.rows):
        key = mix64(key * np.uint64(0x9FB21C651E98DF25) + grid[:, k])
    return key.view(np.int64)


def sketch(least: np.ndarray) -> list[int]:
    """The last two bits of every coordinate: words of last bits, then words of the bits before them."""
    planes = []
    for bit in (0, 1):
        bits = np.zeros(-(-len(least) // 64) * 64, dtype=np.uint8)
        bits[: len(least)] = (least >> _U32(bit)) & _U32(1)
        planes += np.packbits(bits).view(np.int64).tolist()
    return planes


def signatures(docs: DataFrame, key: str, text: str, banding: Banding) -> DataFrame:
    """key, n_shingles, digest of the set, bands (empty for an empty set), and the words of the sketch."""
    names = [f"s{k}" for k in range(2 * banding.words)]
    schema = pa.schema([("key", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), *((s, pa.int64()) for s in names)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                sizes, digests, bands, sketches = [], [], [], []
                for shingles in shingle_sets(part.column(1)):
                    sizes.append(len(shingles))
                    digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                    least = signature(shingles, banding.coordinates)
                    bands.append(band_keys(least, banding) if len(shingles) else np.zeros(0, np.int64))
                    sketches.append(sketch(least))
                ends = np.cumsum([0, *map(len, bands)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bands)))
                words = [pa.array(w, pa.int64()) for w in zip(*sketches, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists, *words], schema=schema)

    ddl = "key long, n_shingles long, digest binary, bands array<long>, " + ", ".join(f"{s} long" for s in names)
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(trimmed(work), ddl)


def _plausible(pairs: DataFrame, n_pairs: int, marks: DataFrame, percent: int, banding: Banding) -> DataFrame:
    """Those (a, b) whose sketches are not too unlike for the threshold; only their texts are sent."""
    words = [f"s{k}" for k in range(2 * banding.words)]
    near = F.broadcast if n_pairs <= NEAR_ROWS else (lambda df: df)
    half = marks.select(F.col("key").alias("a"), *words).join(near(pairs), "a").select("a", "b", *[F.col(w).alias(f"a_{w}") for w in words])
    both = marks.select(F.col("key").alias("b"), *words).join(near(half), "b")
    unlike = [F.col(w).bitwiseXOR(F.col(f"a_{w}")) for w in words]
    differ = sum((F.bit_count(unlike[k].bitwiseOR(unlike[k + banding.words])) for k in range(banding.words)), F.lit(0))
    return both.where(differ <= banding.most_unlike(percent)).select("a", "b")


def _confirmed(docs: DataFrame, pairs: DataFrame, n_pairs: int, key: str, text: str, percent: int) -> DataFrame:
    """Those (a, b) of the ``n_pairs`` ``pairs`` whose full sets have 100 * intersection >= percent * union.

    Every text travels once for each centre ``a`` it is compared with, and a hot centre's
    members are split over groups that each get a copy of the centre.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    members = pairs.join(sizes, "a").select(F.col("b").alias("key"), "a", (F.abs(F.hash("b")) % F.col("parts")).alias("part"), F.lit(True).alias("member"))
    centres = sizes.select(F.col("a").alias("key"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("member"))
    wanted = members.unionByName(centres)  # a row for each pair, and no more than that for the centres
    near = F.broadcast(wanted) if n_pairs <= NEAR_ROWS else wanted
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(near, "key")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "member", "key").select("a", "key", "member", "text")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, np.uint64)
        for batch in batches:
            found: list[tuple[int, int]] = []
            sets = shingle_sets(batch.column(3))
            for a, b, member, shingles in zip(*(batch.column(i).to_pylist() for i in range(3)), sets, strict=True):
                if not member:
                    centre = shingles
                    continue
                small, large = (shingles, centre) if len(shingles) < len(centre) else (centre, shingles)
                if 100 * len(small) < percent * len(large) or not len(small):
                    continue
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                common = int((large[at] == small).sum())
                if 100 * common >= percent * (len(small) + len(large) - common):
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=schema)

    return rows.mapInArrow(trimmed(work), "a long, b long")


def _promising(owner: np.ndarray, column: np.ndarray, size: np.ndarray, side: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The entries of documents that may have a link: those of whose shingles enough occur in another
    document (of the other side). What this leaves out may have made others promising, so it is repeated."""
    while len(owner):
        width = int(column.max()) + 1
        if side is None:
            common = np.bincount(column, minlength=width)[column] > 1
        else:
            here = side[owner]
            common = np.where(here, np.bincount(column[~here], minlength=width)[column], np.bincount(column[here], minlength=width)[column]) > 0
        able = 100 * np.bincount(owner[common], minlength=len(size)) >= percent * size
        keep = able[owner] & common
        if keep.all():
            break
        owner, column = owner[keep], column[keep]
    return owner, column


def _block_links(ids: list[int], parts: list[int], sides: list[bool], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join different parts, among all documents or, with two sides, between them.

    Documents that cannot have a link are left out by the counts of their shingles. Common
    shingles of the others are counted for some rows at a time: frequent ones by products of 0/1
    matrices, the rest by their pairs of places. Of the links of those rows, each part that has
    one gives one until all are inside a part, so links and steps grow with the documents and
    not with their pairs. No array has more than ``CELLS`` cells or some entries for each shingle.
    """
    size = np.array([len(s) for s in sets])
    side = np.array(sides)
    side = side if side.any() and not side.all() else None
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    owner, column = _promising(np.repeat(np.arange(len(sets), dtype=np.int32), size), column.astype(np.int32), size, side, percent)
    found: list[tuple[int, int]] = []
    if not len(owner):
        return found
    docs, owner = np.unique(owner, return_inverse=True)  # those left, renumbered from here on
    _, label = np.unique(np.array(parts)[docs], return_inverse=True)
    left, right = (np.flatnonzero(~side[docs]), np.flatnonzero(side[docs])) if side is not None else (np.arange(len(docs)),) * 2
    left_at, right_at = np.full(len(docs), -1), np.full(len(docs), -1)
    left_at[left], right_at[right] = np.arange(len(left)), np.arange(len(right))
    size = size[docs].astype(np.float32)

    _, column, count = np.unique(column, return_inverse=True, return_counts=True)
    frequent = count >= max(8, len(docs) // 64)
    place = np.cumsum(frequent) - 1
    dense = frequent[column]
    order = np.argsort(place[column[dense]], kind="stable")
    dense_owner, dense_column = owner[dense][order], place[column[dense]][order].astype(np.int32)
    order = np.argsort(column[~dense], kind="stable")
    rare_owner, rare_column = owner[~dense][order], column[~dense][order]
    starts, ends = np.searchsorted(rare_column, rare_column), np.searchsorted(rare_column, rare_column, side="right")
    of_row = np.argsort(left_at[rare_owner], kind="stable")  # places of rare shingles, by row
    rows_sorted = left_at[rare_owner][of_row]

    height = max(1, CELLS // len(right))
    width = max(64, 4 * CELLS // len(docs))
    for start in range(0, len(left), height):
        rows = left[start : start + height]
        if not (label[rows][:, None] != (label[right].min(), label[right].max())).any():
            continue  # all of one part
        common = np.zeros((len(rows), len(right)), dtype=np.float32)
        for low in range(0, int(frequent.sum()), width):
            cut = slice(*np.searchsorted(dense_column, [low, low + width]))
            one = np.zeros((len(docs), width), dtype=np.float32)
            one[dense_owner[cut], dense_column[cut] - low] = 1
            common += one[rows] @ (one if len(right) == len(docs) else one[right]).T
        places = of_row[slice(*np.searchsorted(rows_sorted, [start, start + len(rows)]))]
        for at in range(0, len(places), 1 << 12):
            some = places[at : at + (1 << 12)]
            many = ends[some] - starts[some]
            other = right_at[rare_owner[np.repeat(starts[some] - np.cumsum(many) + many, many) + np.arange(many.sum())]]
            cell = (np.repeat(left_at[rare_owner[some]] - start, many) * len(right) + other)[other >= 0]
            common += np.bincount(cell, minlength=common.size).reshape(common.shape)
        # 100 * common >= percent * (size + size - common); whole numbers that are exact in 32-bit floats
        linked = common * np.float32(100 + percent) >= np.float32(percent) * (size[rows][:, None] + size[right][None, :])
        linked &= common > 0
        while True:
            open_ = linked & (label[rows][:, None] != label[right][None, :])
            i, j = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
            if not len(i):
                break
            a = np.concatenate([rows[i], rows[open_[:, j].argmax(axis=0)]])
            b = np.concatenate([right[open_[i].argmax(axis=1)], right[j]])
            label, used = _joined(label, a, b)
            found += [(ids[x], ids[y]) for x, y in zip(docs[a[used]].tolist(), docs[b[used]].tolist(), strict=True)]
    return found


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The labels once the links (a[i], b[i]) are drawn, and which of the links it took."""
    parent = np.arange(int(label.max()) + 1).tolist()

    def root(p: int) -> int:
        while parent[p] != p:
            parent[p] = p = parent[parent[p]]
        return p

    used = np.zeros(len(a), dtype=bool)
    for k, (x, y) in enumerate(zip(label[a].tolist(), label[b].tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[y] = x
            used[k] = True
    return np.array([root(p) for p in range(len(parent))])[label], used


def _family_links(docs: DataFrame, state: DataFrame, key: str, text: str, percent: int, stages: Stages) -> DataFrame:
    """Links between components inside the families that ``state`` (bucket, b, size, part) forms."""
    # A table of its own: broadcast, or joined by a shuffle whose skewed side Spark can split.
    heads, n = stages.save_counted(state.groupBy("bucket").agg(F.min("b").alias("head")), "heads")
    ties = state.join(F.broadcast(heads) if n <= NEAR_ROWS else heads, "bucket").select("head", "b").distinct()
    family = components(ties, "head", "b").select(F.col("node").alias("b"), F.col("component").alias("family"))
    members = stages.save(state.select("b", "size", "part").distinct().join(family, "b"), "members")
    need = F.greatest(F.sum("size") / BLOCK, F.count("*") / BLOCK_DOCS)
    blocks = members.groupBy("family").agg(F.ceil(need).cast("int").alias("blocks"))
    members = members.join(blocks, "family").withColumn("block", F.abs(F.hash("b")) % F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = members.select(F.col("b").alias("key"), "family", "part", "block", other)
    low, high = F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    dealt, n = stages.save_counted(dealt.select("key", "family", "part", low, high, (F.col("block") > F.col("other")).alias("side")), "dealt")
    near = F.broadcast(dealt) if n <= NEAR_ROWS else dealt
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(near, "key")
    order = ["family", "low", "high", "key"]
    rows = rows.repartition(*order[:3]).sortWithinPartitions(*order).select(*order, "part", "side", "text")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, ([], [], [], [])

        def links() -> Iterator[pa.RecordBatch]:
            found = _block_links(*held, percent) if len(held[0]) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=schema)

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for *group, key_, part, side, shingles in zip(*columns, shingle_sets(batch.column(6)), strict=True):
                if group != name:
                    yield from links()
                    name, held = group, ([], [], [], [])
                for column, value in zip(held, (key_, part, side, shingles), strict=True):
                    column.append(value)
        yield from links()

    return rows.mapInArrow(trimmed(work), "a long, b long")


def _torn(shared: DataFrame, label: DataFrame, stages: Stages) -> DataFrame:
    """The members (bucket, b, size, crowd, part) of the buckets that hold several components."""
    state = shared.join(label.withColumnRenamed("node", "b"), "b", "left").withColumn("part", F.coalesce("component", "b"))
    torn = state.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("bucket")
    torn, n = stages.save_counted(torn, "torn")
    return state.join(F.broadcast(torn) if n <= NEAR_ROWS else torn, "bucket", "left_semi").select("bucket", "b", "size", "crowd", "part")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75, banding: Banding = Banding()
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``, and row keys.

    Documents are linked when 100 * |intersection| >= percent * |union| of their distinct
    5-word shingles; ``component_id`` is the smallest id reachable. A null or empty text, or one
    of white space, has an empty set and is linked with nothing. Rows that repeat an id are
    documents of their own and share what the id decides; a null id orders last and gives a null
    ``kept``. An empty table gives no rows; other columns are ignored.
    """
    stages = Stages(docs.sparkSession, "minhash")
    keyed, unique = with_row_key(docs, doc_id, stages)
    return _near_duplicates(keyed, unique, doc_id, text, percent, banding, stages)


def _near_duplicates(keyed: DataFrame, unique: bool, doc_id: str, text: str, percent: int, banding: Banding, stages: Stages) -> DataFrame:
    marks = stages.save(signatures(keyed, ROW, text, banding), "signatures")

    classes = stages.save(marks.where("n_shingles > 0").groupBy("digest").agg(F.min("key").alias("class")), "classes")
    heads = marks.join(classes.select(F.col("class").alias("key")), "key", "left_semi")
    met = heads.select(F.col("key").alias("b"), F.col("n_shingles").alias("size"), F.explode("bands").alias("bucket"))
    # Dealt once: the buckets' counts and the join back both read this exchange, as both need all its
    # columns. A bucket holds a row per member, of one band, so none is a large part of all rows.
    met = met.repartition("bucket")
    crowds = met.groupBy("bucket").agg(F.min("b").alias("first"), F.count("*").alias("crowd"), F.max("size").alias("longest"))
    shared = stages.save(met.join(crowds.where("crowd > 1"), "bucket"), "shared")

    sized = "100 * least(size, a_size) >= {0} * greatest(size, a_size)".format(percent)
    firsts = shared.where("b = first").select("bucket", F.col("b").alias("a"), F.col("size").alias("a_size"))
    meetings = shared.where("b <> first").join(firsts, "bucket").where(sized).groupBy("a", "b").agg(F.count("*").alias("n"))
    # Of the centres that a member meets, at most one a band, those it meets most often.
    rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("n"), "a"))
    pairs, n = stages.save_counted(meetings.withColumn("rank", rank).where(F.col("rank") <= CENTRES).select("a", "b"), "pairs")
    likely, n = stages.save_counted(_plausible(pairs, n, marks, percent, banding), "likely")
    links = stages.save(_confirmed(keyed, likely, n, ROW, text, percent), "links")  # one Python stage in a task at a time
    label = stages.save(components(links, "a", "b"), "labels")

    torn = stages.save(_torn(shared, label, stages), "members")
    state = torn.where(F.col("crowd") <= SMALL)
    other = state.select("bucket", F.col("b").alias("a"), F.col("size").alias("a_size"), F.col("part").alias("a_part"))
    across = state.join(other, "bucket").where("a < b and part <> a_part").where(sized).select("a", "b").distinct()
    tested = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    across, n = stages.save_counted(across.join(tested, ["a", "b"], "left_anti"), "across")
    across, n = stages.save_counted(_plausible(across, n, marks, percent, banding), "likely") if n else (across, 0)
    more, n_more = stages.save_counted(_confirmed(keyed, across, n, ROW, text, percent), "links") if n else (None, 0)
    state = torn.where(F.col("crowd") > SMALL)
    if not state.isEmpty():
        wide, n_wide = stages.save_counted(_family_links(keyed, state, ROW, text, percent, stages), "links")
        more, n_more = (more.unionByName(wide) if more else wide), n_more + n_wide

    rows = marks.select("key", "n_shingles", "digest").join(classes, "digest", "left")
    rows = rows.join(label.withColumnRenamed("node", "class"), "class", "left")
    rows = rows.select("key", "n_shingles", F.coalesce("component", "class", "key").alias("low"))
    if n_more:
        # The links between components join those up; a document's component then has one too.
        ends = more.select(F.col("a").alias("node"), F.col("b").alias("other")).join(label, "node", "left").select(F.coalesce("component", "node").alias("src"), F.col("other").alias("node"))
        ends = ends.join(label, "node", "left").select("src", F.coalesce("component", "node").alias("dst"))
        above = stages.save(components(ends).select(F.col("node").alias("low"), "component"), "labels")
        rows = rows.join(above, "low", "left").select("key", "n_shingles", F.coalesce("component", "low").alias("low"))
    if unique:
        return rows.select(F.col("key").alias("doc_id"), "n_shingles", F.col("low").alias("component_id"), (F.col("key") == F.col("low")).alias("kept"), F.col("key").alias(ROW), "low")
    names = keyed.select(F.col(ROW).alias("key"), F.col(doc_id).cast("long").alias("doc_id"))
    named = rows.join(names, "key").join(names.select(F.col("key").alias("low"), F.col("doc_id").alias("component_id")), "low")
    return named.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), F.col("key").alias(ROW), "low")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each component."""
    stages = Stages(docs.sparkSession, "minhash")
    keyed, unique = with_row_key(docs, doc_id, stages)
    found = _near_duplicates(keyed, unique, doc_id, text, 75, Banding(), stages)
    dropped, n = stages.save_counted(found.where(F.col(ROW) != F.col("low")).select(F.col(ROW).alias("__gone")), "dropped")
    near = F.broadcast(dropped) if n <= NEAR_ROWS else dropped
    return keyed.join(near, F.col(ROW) == F.col("__gone"), "left_anti").select(*docs.columns)


def as_contract(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_shingles", "component_id", "kept")


ORACLE_SQL = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
                      WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
                      ELSE list_distinct([array_to_string(w[i:i + {WORDS - 1}], ' ') FOR i IN range(1, len(w) - {WORDS - 2})]) END AS s
  FROM worded),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM shingled),
flat AS (SELECT doc_id, unnest(s) AS g FROM shingled),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least_ids AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN least_ids USING (doc_id)
"""
