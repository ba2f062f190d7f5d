"""Packing examples into fixed-length training sequences (operator 1).

Examples are vectors (tokens, segments, loss-bearing tokens). A sequence is filled one
example at a time with the dot-product heuristic of vector bin packing: among the examples
that still fit under *all* limits, the one whose demand vector has the largest dot product
with the sequence's remaining room is placed. The work needs no shuffle: every partition
packs its own rows through a bounded pool of open pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.rows import trimmed

EOS_ID = 0
#: Beyond Latin letters the two tokenizer libraries may hold different Unicode versions; the
#: rank encoder's pattern matcher may also run out of stack on huge runs of white space.
_FOR_EXACT = re.compile(r"[^\x00-\u024f]|\s{5000}")

PIECES = pa.schema([
    ("item", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("loss", pa.int64()), ("ids", pa.binary()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("oversize", pa.bool_()),
])
PIECES_DDL = (
    "item long, start long, length long, loss long, ids binary, doc_tokens long, sequence_id long, offset long, oversize boolean"
)


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold at most."""

    tokens: int = 1024
    segments: int = 512
    loss: int = 1024

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss], dtype=np.float64)


@lru_cache(maxsize=2)
def load_tokenizer(path: str, plain: bool = False):
    """Encoder for texts: ``encode(text) -> uint32 array``, equal to the ``tokenizers`` ids of ``path``.
    With ``plain`` the strings of special tokens are ordinary text.

    The file's vocabulary is also published as ranks beside it (same stem, ``.tiktoken``).
    Where that file exists, Latin texts go through the rank encoder, which gives the same ids
    several times faster; all other texts, and everything without ranks, go through
    ``tokenizers`` itself.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.no_truncation()
    slow.no_padding()
    slow.encode_special_tokens = plain

    def exact(text: str) -> np.ndarray:
        return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    ranks = Path(path).with_suffix(".tiktoken")
    if not ranks.exists():
        return exact
    import base64

    import public_tokenizers
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.read_bytes().splitlines())}
    special = {t.content: i for i, t in slow.get_added_tokens_decoder().items() if t.special}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        if _FOR_EXACT.search(text):
            return exact(text)
        if plain:
            return fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)
        return fast.encode_to_numpy(text, allowed_special="all").astype(np.uint32, copy=False)

    return encode


class Packer:
    """Streams pieces in, gives whole sequences out, and holds at most ``pool`` pieces.

    A piece is ``(item, start, ids, loss_from, total)``; tokens at or after ``loss_from`` (an
    index in the item) bear loss. With ``cut`` an example may be split: examples longer than a
    sequence are cut to its size first, and where nothing fits a gap any more, the piece with
    the largest dot product is cut to fill it. Without ``cut`` examples stay whole, and one
    that exceeds a limit by itself gets a sequence of its own, flagged ``oversize``.
    """

    def __init__(self, limits: Limits, cut: bool, pool: int = 512):
        self.limits, self.cut, self.pool = limits, cut, pool
        self.room = limits.vector()
        self.demand = np.zeros((pool + limits.tokens + 2, 3))
        self.pieces: list[tuple] = []

    @staticmethod
    def _need(piece: tuple) -> tuple[int, int, int]:
        _, start, ids, loss_from, _ = piece
        end = start + len(ids)
        return len(ids), 1, max(0, end - max(start, loss_from))

    def _push(self, piece: tuple) -> None:
        self.demand[len(self.pieces)] = self._need(piece)
        self.demand[len(self.pieces)] /= self.room
        self.pieces.append(piece)

    def _pop(self, k: int) -> tuple:
        piece, last = self.pieces[k], self.pieces.pop()
        if k < len(self.pieces):
            self.pieces[k] = last
            self.demand[k] = self.demand[len(self.pieces)]
        return piece

    def add(self, item: int, ids: np.ndarray, loss_from: int) -> Iterator[tuple[list[tuple], bool]]:
        """Yield the sequences, as (pieces, oversize), that are ready once the example is in."""
        total = len(ids)
        step = min(self.limits.tokens, self.limits.loss)
        start = 0
        if self.cut:
            while total - start >= step:
                piece = (item, start, ids[start : start + step], loss_from, total)
                if step == self.limits.tokens:
                    yield [piece], False
                else:
                    self._push(piece)
                start += step
                if len(self.pieces) >= self.pool:
                    yield self._fill(), False
        elif any(need > most for need, most in zip(self._need((item, 0, ids, loss_from, total)), self.room, strict=True)):
            yield [(item, 0, ids, loss_from, total)], True
            return
        if start < total:
            self._push((item, start, ids[start:], loss_from, total))
        while len(self.pieces) >= self.pool:
            yield self._fill(), False

    def _fill(self) -> list[tuple]:
        """One sequence from the pool by the dot-product heuristic."""
        left, taken = np.ones(3), []
        while self.pieces:
            demand = self.demand[: len(self.pieces)]
            score = demand[:, 0] * left[0] + demand[:, 1] * left[1] + demand[:, 2] * left[2]  # by row, so that equal demands tie
            fits = (demand <= left + 1e-9).all(axis=1)
            if fits.any():
                k = int(np.where(fits, score, -1.0).argmax())
                left = left - self.demand[k]
                taken.append(self._pop(k))
                continue
            gap = int(round(left[0] * self.room[0]))
            if not self.cut or gap < 1 or left[1] * self.room[1] < 1 - 1e-6:
                break
            k = int(score.argmax())
            item, start, ids, loss_from, total = self.pieces[k]
            spare = int(round(left[2] * self.room[2])) + max(0, loss_from - start)
            size = min(gap, spare, len(ids))
            if size < 1:
                break
            self._pop(k)
            taken.append((item, start, ids[:size], loss_from, total))
            left = left - np.array(self._need(taken[-1])) / self.room
            if size < len(ids):
                self._push((item, start + size, ids[size:], loss_from, total))
        return taken

    def rest(self) -> Iterator[tuple[list[tuple], bool]]:
        """The remaining sequences. With ``cut`` the last, unfilled one is split at powers of two,
        the lengths that need no padding."""
        while self.pieces:
            sequence = self._fill()
            length = sum(len(p[2]) for p in sequence)
            if not self.cut or self.pieces or length == self.limits.tokens:
                yield sequence, False
                continue
            while length:
                size = 1 << (length.bit_length() - 1)
                part, filled = [], 0
                while filled < size:
                    item, start, ids, loss_from, total = sequence.pop(0)
                    take = min(size - filled, len(ids))
                    part.append((item, start, ids[:take], loss_from, total))
                    if take < len(ids):
                        sequence.insert(0, (item, start + take, ids[take:], loss_from, total))
                    filled += take
                yield part, False
                length -= size


def _batches(sequences: Iterable[tuple[list[tuple], bool]], first_id: int, flush_tokens: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    columns: list[list] = [[] for _ in PIECES]
    held = 0
    for number, (sequence, oversize) in enumerate(sequences):
        offset = 0
        for item, start, ids, loss_from, total in sequence:
            n = len(ids)
            loss = max(0, start + n - max(start, loss_from))
            row = (item, start, n, loss, ids.astype("<u4", copy=False).tobytes(), total, first_id + number, offset, oversize)
            for column, value in zip(columns, row, strict=True):
                column.append(value)
            offset += n
        held += offset
        if held >= flush_tokens:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, PIECES, strict=True)], schema=PIECES)
            columns, held = [[] for _ in PIECES], 0
    if columns[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, PIECES, strict=True)], schema=PIECES)


def pack_texts(
    docs: DataFrame, tokenizer: str, limits: Limits = Limits(), cut: bool = True, item: str = "doc_id", text: str = "text",
    loss_from: str | None = None, pool: int = 512,
) -> DataFrame:
    """Tokenize every text, end it with id 0, and pack all ids into sequences.

    One row per piece: ``item`` (the id column's value), ``start`` (ids of the example before
    it), ``length``, ``loss`` (its loss-bearing ids), ``ids`` (little-endian unsigned 32-bit),
    ``doc_tokens``, ``sequence_id``, ``offset`` (gapless from 0 in the sequence), ``oversize``.
    ``loss_from`` names a column with the index of the first id that bears loss; by default that
    is 1: all ids but an example's first one are predicted.

    A null text counts as empty and still yields its closing id; a null id stays null; repeated
    rows are packed one by one; an empty table gives no rows; other columns are ignored. Memory
    is bounded by the pool and the longest text. A sequence id is the partition's number and a
    count in it, so a task that runs again gives the same rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = load_tokenizer(tokenizer), Packer(limits, cut, pool)
        end = np.array([EOS_ID], dtype=np.uint32)

        def sequences():
            for batch in batches:
                for key, body, first in zip(*(batch.column(i) for i in range(3)), strict=True):
                    ids = np.concatenate([encode(body.as_py()), end])
                    yield from packer.add(key.as_py(), ids, first.as_py())
            yield from packer.rest()

        yield from _batches(sequences(), TaskContext.get().partitionId() << 36)

    rows = docs.select(
        F.col(item).cast("long").alias("item"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        (F.coalesce(F.col(loss_from).cast("long"), F.lit(0)) if loss_from else F.lit(1).cast("long")).alias("loss_from"),
    )
    return rows.mapInArrow(trimmed(work), PIECES_DDL)


def pack_documents(docs: DataFrame) -> DataFrame:
    """Production parameters for plain documents: 1024 ids, 512 segments, all ids may bear loss."""
    import public_tokenizers

    return pack_texts(docs, public_tokenizers.path("byte_bpe_50k.json"), Limits(1024, 512, 1024), cut=True)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a CRC in place of the ids themselves."""
    return pieces.select(
        F.col("item").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss"
    )
