"""Document fingerprints from prefix polynomial hashes (operator 7).

The prefix array of a text holds, modulo a prime, sum(c_k * B^k) over its first code points. Two
of them give the hash of any span, so span equality is one comparison and the longest common
extension of two positions a binary search. Two primes-and-bases are compared together.

A fingerprint is the text's length, its whole-span hashes, and the least hashes among all its
16-code-point spans, which are a uniform sample of the text and so measure likeness.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.rows import ROW, trimmed, with_row_key
from orrery.staging import Stages

PRIME = (1 << 31) - 1
BASES = (911382323, 972663749)
SPAN = 16
SKETCH = 64
#: Documents that one task reads in a row; and the most ranges of documents.
RANGE_DOCS, RANGES = 10_000, 10_000
_P = np.uint64(PRIME)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """B^k and B^-k modulo the prime for k < size, kept and grown by doubling."""
    if base not in _tables or len(_tables[base][0]) < size:
        tables = []
        for b in (base, pow(base, -1, PRIME)):
            powers = np.ones(1, dtype=np.uint64)
            while len(powers) < max(size, 1024):
                powers = np.concatenate([powers, powers * np.uint64(pow(b, len(powers), PRIME)) % _P])
            tables.append(powers)
        _tables[base] = tuple(tables)
    return _tables[base]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


class PrefixHash:
    """Prefix arrays of one text. Positions count code points."""

    def __init__(self, text: str | np.ndarray):
        self.points = code_points(text) if isinstance(text, str) else text
        self._prefix: dict[int, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.points)

    def prefix(self, base: int) -> np.ndarray:
        """Hashes of the first 0, 1, 2, ... code points."""
        if base not in self._prefix:
            powers, _ = _powers(base, len(self) + 1)
            terms = (self.points.astype(np.uint64) + np.uint64(1)) * powers[: len(self)] % _P
            self._prefix[base] = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms) % _P])
        return self._prefix[base]

    def span(self, start: int, end: int) -> tuple[int, ...]:
        """The hashes of [start, end), which depend on its content alone."""
        found = []
        for base in BASES:
            prefix, (_, inverse) = self.prefix(base), _powers(base, len(self) + 1)
            found.append((int(prefix[end]) - int(prefix[start])) * int(inverse[start]) % PRIME)
        return tuple(found)

    def spans(self, width: int) -> np.ndarray:
        """The first base's hashes of all spans of a width."""
        prefix, (_, inverse) = self.prefix(BASES[0]), _powers(BASES[0], len(self) + 1)
        return (prefix[width:] + _P - prefix[:-width]) % _P * inverse[: len(self) - width + 1] % _P

    def equal(self, start: int, other: PrefixHash, at: int, length: int) -> bool:
        return self.span(start, start + length) == other.span(at, at + length)

    def common_extension(self, start: int, other: PrefixHash, at: int) -> int:
        """The length of the longest common prefix of self[start:] and other[at:]."""
        low, high = 0, min(len(self) - start, len(other) - at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(start, other, at, middle):
                low = middle
            else:
                high = middle - 1
        return low


def sketch(hashed: PrefixHash) -> np.ndarray:
    """The least distinct scrambled span hashes, ascending; at most ``SKETCH``."""
    if not len(hashed):
        return np.zeros(0, np.uint32)
    spans = hashed.spans(min(SPAN, len(hashed)))
    mixed = ((spans * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    few = 4 * SKETCH
    if len(mixed) > few:
        least = np.unique(np.partition(mixed, few)[:few])
        if len(least) >= SKETCH:
            return least[:SKETCH]
    return np.unique(mixed)[:SKETCH]


def fingerprint(hashed: PrefixHash, least: np.ndarray) -> str:
    whole = "".join(f"{h:08x}" for h in hashed.span(0, len(hashed)))
    return f"{len(hashed):x}-{whole}-{least.astype('>u4').tobytes().hex()}"


def parse(text: str) -> tuple[str, np.ndarray]:
    """A fingerprint's identity (length and whole-span hashes) and its sketch."""
    identity, _, least = text.rpartition("-")
    return identity, np.frombuffer(bytes.fromhex(least), dtype=">u4").astype(np.uint32)


def likeness(a: str, b: str) -> float:
    """The share of text in common, 0 to 1, that two fingerprints show; equal ones give 1.

    The least hashes of both together estimate the Jaccard likeness J of their spans; 2J / (1 + J)
    is the share of the spans of both that are common.
    """
    (one, x), (two, y) = parse(a), parse(b)
    if one == two:
        return 1.0
    if not len(x) or not len(y):
        return 0.0
    both = np.union1d(x, y)[: max(min(SKETCH, len(x) + len(y)), 1)]
    j = np.isin(both, np.intersect1d(x, y)).sum() / len(both)
    return float(2 * j / (1 + j))


def edited_text(text: str, following: str) -> str:
    """The last half, rounded down, replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _ranges(keyed: DataFrame, stages: Stages) -> list[int]:
    """The first row key of each range of documents, ascending: at most ``RANGES`` numbers."""
    ordered = keyed.select(ROW).repartitionByRange(ROW).sortWithinPartitions(ROW)
    ordered = stages.save(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33)
    counts = sorted((r["part"], r["n"]) for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in counts)
    if not total:
        return []
    ways = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(RANGES, max(ways, -(-total // RANGE_DOCS)))
    step, start, offsets = -(-total // ranges), 0, []
    for p, n in counts:
        offsets.append((p, start))
        start += n
    table = keyed.sparkSession.createDataFrame(offsets, "part long, start long")
    placed = ordered.withColumn("part", part.cast("long")).join(F.broadcast(table), "part")
    firsts = placed.where((F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)) % step == 0)
    return sorted(r[ROW] for r in firsts.select(ROW).collect())


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``, ``kept_prefix``.

    The edited text is the document with its last half replaced by the beginning of the next
    document, by ascending id, the first following the last; ``kept_prefix`` is the longest
    common extension of both from their starts. Rows that repeat an id follow one another; null
    ids come last; a null text counts as empty; an only document follows itself; an empty table
    gives no rows; other columns are ignored.

    Texts are shuffled once, into ranges of ids that a task reads in order. The first document of
    each range goes to the range before as well. A task holds two texts at a time.
    """
    stages = Stages(docs.sparkSession, "fingerprints")
    keyed, _ = with_row_key(docs, doc_id, stages)
    firsts = np.array(_ranges(keyed, stages), dtype=np.int64)
    ranges = max(1, len(firsts))
    dealt = pa.schema([("range", pa.int32()), ("ahead", pa.bool_()), ("row", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0).to_numpy()
            at = np.searchsorted(firsts, row, side="right") - 1
            leads = np.flatnonzero(firsts[at] == row)
            for take, where, ahead in ((np.arange(len(row)), at, False), (leads, (at[leads] - 1) % ranges, True)):
                if len(take):
                    columns = [pa.array(where, pa.int32()), pa.array(np.full(len(take), ahead)), *(c.take(pa.array(take)) for c in batch.columns)]
                    yield pa.RecordBatch.from_arrays(columns, schema=dealt)

    out = pa.schema([
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()), ("near_next", pa.float64()), ("kept_prefix", pa.int64()),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            found = []
            for where, ahead, key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                body = body.as_py()
                hashed = PrefixHash(body)
                mark = fingerprint(hashed, sketch(hashed))
                if before is not None and before[0] == where:
                    _, old_key, old_body, old_hashed, old_mark = before
                    edited = edited_text(old_body, body)
                    changed = PrefixHash(edited)
                    new_mark = fingerprint(changed, sketch(changed))
                    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    same = old_hashed.common_extension(0, changed, 0)
                    found.append((old_key, len(old_body), sha, old_mark, new_mark, likeness(old_mark, new_mark), likeness(old_mark, mark), same))
                before = None if ahead else (where, key, body, hashed, mark)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found, strict=True), out, strict=True)], schema=out)

    rows = keyed.select(F.col(ROW).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.mapInArrow(trimmed(deal), "range int, ahead boolean, row long, doc_id long, text string")
    rows = rows.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "ahead", "row")
    ddl = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, kept_prefix long"
    return rows.mapInArrow(trimmed(work), ddl)
