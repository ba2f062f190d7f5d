"""Alignment of two tokenizers over the same bytes (operator 11).

A whole slice of an Arrow batch is concatenated with each document's byte offset. The ends of all A and
of all B tokens are counted by place, once each; where both are found the text is cut. Prefix sums over
the places, read at the documents' bounds, give what belongs to each document.

Every token has at least one byte, so at a cut one A and one B token end: they are a link. The shorter of
the two is a tail of the longer one, so there are no more different links than the tokens of both
vocabularies have tails (some 500,000 for the two of the query): that bounds the table of link counts,
which tasks count up first and which is broadcast to a second pass over the links.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.packing import load_tokenizer
from orrery.llm.rows import trimmed
from orrery.staging import Stages

#: Bytes of text that one slice holds, beside a longer single text.
SLICE_BYTES = 1 << 20
#: Words that are encoded together.
GROUP = 1000
#: What makes a word no simple one: other than Latin letters, white space at an end or beside white space.
_ODD = re.compile(r"[^\x00-\u024f]|^\s|\s$|\s\s")
#: Different links that a task holds before it gives their counts out.
HELD_LINKS = 1 << 20

ALIGNED = pa.schema([
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()), ("base", pa.int64()), ("links", pa.binary()),
])
ALIGNED_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, base long, links binary"
FIGURES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")


@dataclass(frozen=True, eq=False)
class Tokenizer:
    """``encode`` maps texts to id arrays; ``entries[i]`` are the bytes of id i. With ``by_words`` nothing before a single
    space is joined with what follows it, so that a text's ids are those of its words, each with the space before it."""

    encode: Callable[[list[str]], list[np.ndarray]]
    entries: list[bytes]
    by_words: bool = False

    @cached_property
    def lengths(self) -> np.ndarray:
        return np.array([len(e) for e in self.entries], dtype=np.int64)

    def gives_back(self, text: str, ids: np.ndarray) -> bool:
        """Whether the ids are those of a space and the text, byte for byte."""
        return b"".join(map(self.entries.__getitem__, ids.tolist())) == b" " + text.encode()


class ByWords:
    """Two tokenizers that encode texts by their words, each of which a worker encodes once.

    Texts with white space beside white space, with words over ``LONGEST`` letters or with other than Latin letters are
    encoded whole. At most ``HELD`` words are kept, beside those of one slice of texts.
    """

    LONGEST, HELD = 64, 1 << 18

    def __init__(self, *tokenizers: Tokenizer):
        self.tokenizers = tokenizers
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = [np.zeros(0, np.int32) for _ in self.tokenizers]
        self.first = [np.zeros(1, np.int64) for _ in self.tokenizers]

    def _simple(self, word: str) -> bool:
        return 0 < len(word) <= self.LONGEST and (word.isascii() and word.isprintable() or not _ODD.search(word))

    def _learn(self, words: set[str]) -> None:
        """Encode words, many at a time with single spaces between them, and cut the ids where the words end."""
        self.place.update(dict.fromkeys(words, -1))  # what is not learnt sends its text to be encoded whole
        simple = sorted(w for w in words if self._simple(w)) if all(t.by_words for t in self.tokenizers) else []
        groups = [simple[k : k + GROUP] for k in range(0, len(simple), GROUP)]
        encoded = [t.encode([" ".join(g) for g in groups]) for t in self.tokenizers]
        ids, sizes = [[k] for k in self.ids], [[] for _ in self.tokenizers]
        for group, *found in zip(groups, *encoded, strict=True):
            bounds = np.cumsum([1 + len(w.encode()) for w in group])
            ends = [np.cumsum(t.lengths[x]) for t, x in zip(self.tokenizers, found, strict=True)]
            last = [np.searchsorted(e, bounds) for e in ends]
            cut = all(k[-1] < len(e) and (e[k] == bounds).all() for e, k in zip(ends, last, strict=True))
            if not cut or not all(t.gives_back(" ".join(group), x) for t, x in zip(self.tokenizers, found, strict=True)):
                continue
            known = len(self.first[0]) - 1 + sum(map(len, sizes[0]))
            self.place.update(zip(group, range(known, known + len(group)), strict=True))
            for n, (x, k) in enumerate(zip(found, last, strict=True)):
                ids[n].append(x)
                sizes[n].append(np.diff(k, prepend=-1))
        self.ids = [np.concatenate(x).astype(np.int32) for x in ids]
        self.first = [np.concatenate([f, f[-1] + np.cumsum(np.concatenate([f[:0], *n]))]) for f, n in zip(self.first, sizes, strict=True)]

    def encode(self, texts: list[str]) -> list[list[np.ndarray]]:
        """For each tokenizer the ids of each text; none where the text is empty or one of them does not give it back."""
        split = [t.split(" ") for t in texts]
        every = set().union(*split)
        new = every.difference(self.place)
        if len(self.place) + len(new) > self.HELD:
            self._forget()
            new = every
        if new:
            self._learn(new)
        out: list[list[np.ndarray]] = [[] for _ in self.tokenizers]
        for text, words in zip(texts, split, strict=True):
            at = np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))
            if not text:
                found = [np.zeros(0, np.int32) for _ in self.tokenizers]
            elif at.min() < 0:
                found = [t.encode([text])[0] for t in self.tokenizers]
                if not all(t.gives_back(text, ids) for t, ids in zip(self.tokenizers, found, strict=True)):
                    found = [np.zeros(0, np.int32) for _ in self.tokenizers]
            else:
                found = []
                for known, starts in zip(self.ids, self.first, strict=True):
                    first, size = starts[at], starts[at + 1] - starts[at]
                    begin = np.cumsum(size) - size
                    found.append(known[np.arange(begin[-1] + size[-1]) + np.repeat(first - begin, size)])
            for ids, one in zip(out, found, strict=True):
                ids.append(one)
        return out


def _byte_of_letter() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def byte_level(path: str) -> Tokenizer:
    """A byte-level BPE of ``tokenizers``, applied to a space and the text; special tokens' strings are plain text."""
    from tokenizers import Tokenizer as Loaded

    encode = load_tokenizer(path, plain=True)
    vocabulary = Loaded.from_file(path).get_vocab(with_added_tokens=False)
    letters = _byte_of_letter()
    entries = [b""] * (max(vocabulary.values()) + 1)
    for token, number in vocabulary.items():
        if all(c in letters for c in token):
            entries[number] = bytes(letters[c] for c in token)
    return Tokenizer(lambda texts: [encode(" " + t) for t in texts], entries, by_words=True)  # it splits texts at spaces beforehand


@lru_cache(maxsize=2)
def pieces(path: str) -> Tokenizer:
    """A sentencepiece model, applied to the text; it sets the space before it by itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    entries = []
    for number in range(model.get_piece_size()):
        piece = model.id_to_piece(number)
        entries.append(bytes([int(piece[3:5], 16)]) if model.is_byte(number) else piece.replace("▁", " ").encode())
    encode = lambda texts: [np.array(ids, dtype=np.int32) for ids in model.encode(texts, num_threads=1)]
    across = any("▁" in model.id_to_piece(k).lstrip("▁") for k in range(model.get_piece_size()))
    return Tokenizer(encode, entries, by_words=not across)


@lru_cache(maxsize=2)
def _written(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids in decimal, left-aligned in rows of bytes with room for a sign behind, and their lengths."""
    texts = [str(i) for i in range(count)]
    width = len(texts[-1]) + 1
    return np.frombuffer("".join(t.ljust(width) for t in texts).encode(), dtype=np.uint8).reshape(count, width), np.array([len(t) for t in texts])


def align(texts: list[str], pair: ByWords) -> tuple[dict[str, np.ndarray], list[bytes], np.ndarray, np.ndarray]:
    """Counts of each text, its groups as text, and the links of all texts as A and B ids.

    Counts are ``n_a``, ``n_b`` and ``n_groups``; the links of text k are those before ``cumsum(n_groups)[k]``.
    A text that is empty, or that a tokenizer does not give back byte for byte behind a space, has no tokens.
    """
    (a, b), (ids_a, ids_b), empty = pair.tokenizers, pair.encode(texts), np.zeros(0, np.int64)
    size = [1 + len(t.encode()) if len(x) else 0 for t, x in zip(texts, ids_a, strict=True)]
    first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)  # document byte offsets in the slice
    flat_a, flat_b = np.concatenate([empty, *ids_a]).astype(np.int64), np.concatenate([empty, *ids_b]).astype(np.int64)
    # Texts lie without gaps, so one running sum gives the ends of all tokens of the slice.
    at_a = np.bincount(np.cumsum(a.lengths[flat_a]), minlength=first[-1] + 1).astype(bool)
    at_b = np.bincount(np.cumsum(b.lengths[flat_b]), minlength=first[-1] + 1).astype(bool)
    cuts = np.flatnonzero(at_a & at_b)
    upto_a, upto_b, upto = (np.cumsum(x, dtype=np.int32) for x in (at_a, at_b, at_a & at_b))  # prefix sums over the places
    last_a, last_b = upto_a[cuts] - 1, upto_b[cuts] - 1  # the tokens that end at a cut
    counts = {"n_a": np.diff(upto_a[first]), "n_b": np.diff(upto_b[first]), "n_groups": np.diff(upto[first])}

    # Written out, group g's A tokens stand behind all B tokens of earlier groups, its B tokens behind its A tokens.
    place_a = np.arange(len(flat_a)) + np.repeat(last_b + 1 - np.diff(last_b, prepend=-1), np.diff(last_a, prepend=-1))
    place_b = np.arange(len(flat_b)) + np.repeat(last_a + 1, np.diff(last_b, prepend=-1))
    ids, sign = np.empty(len(flat_a) + len(flat_b), dtype=np.int64), np.full(len(flat_a) + len(flat_b), ord(","), dtype=np.uint8)
    ids[place_a], ids[place_b] = flat_a, flat_b
    sign[place_a[last_a]], sign[place_b[last_b]] = ord("|"), ord(";")
    digits, lengths = _written(max(len(a.entries), len(b.entries)))
    rows, length = digits[ids], lengths[ids]
    rows[np.arange(len(ids)), length] = sign
    written = rows[np.arange(rows.shape[1]) <= length[:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(length + 1)])[np.concatenate([[0], np.cumsum(counts["n_a"] + counts["n_b"])])].tolist()
    groups = [written[i : max(i, j - 1)] for i, j in zip(ends, ends[1:], strict=False)]
    return counts, groups, flat_a[last_a], flat_b[last_b]


@lru_cache(maxsize=1)
def _pair(a: Tokenizer, b: Tokenizer) -> ByWords:
    """The words of a worker's earlier tasks serve later ones."""
    return ByWords(a, b)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of some ``SLICE_BYTES`` of text; a longer text is one of its own."""
    size = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(size, before + SLICE_BYTES, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def aligned(docs: DataFrame, a: Callable[[], Tokenizer], b: Callable[[], Tokenizer], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the counts, ``groups_sha256`` and ``links``, each A id times ``base``, the size of
    B's vocabulary, plus the B id, as little-endian unsigned numbers of 32 bits, or 64 where both vocabularies'
    product asks for it. ``a`` and ``b`` load the tokenizers in the tasks.

    A null text has no tokens, as an empty one; without tokens the counts are 0 and the digest is
    ''. Ids are passed on, null or repeated; other columns are ignored; an empty table gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(a(), b())
        base = len(pair.tokenizers[1].entries)
        kind = "<u4" if len(pair.tokenizers[0].entries) * base <= 2**32 else "<u8"
        for batch in batches:
            for part in _slices(batch):
                counts, groups, link_a, link_b = align(["" if t is None else t for t in part.column(1).to_pylist()], pair)
                links = (link_a * base + link_b).astype(kind)
                ends = np.cumsum(counts["n_groups"]).tolist()
                rows = [links[i:j].tobytes() for i, j in zip([0, *ends], ends, strict=False)]
                digests = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
                n_a, n_b, n = (pa.array(counts[c], pa.int64()) for c in ("n_a", "n_b", "n_groups"))
                yield pa.RecordBatch.from_arrays([part.column(0), n_a, n_b, n, n, pa.array(digests, pa.string()), pa.array([base] * len(rows), pa.int64()), pa.array(rows, pa.binary())], schema=ALIGNED)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(trimmed(work), ALIGNED_DDL)


def _numbers(part: pa.RecordBatch) -> np.ndarray:
    """All links of a batch of (n_links, links)."""
    raw = b"".join(part.column("links").to_pylist())
    n = int(pc.sum(part.column("n_links")).as_py() or 0)
    return np.frombuffer(raw, dtype="<u8" if len(raw) == 8 * n else "<u4").astype(np.int64)


def link_counts(rows: DataFrame) -> DataFrame:
    """``(link, n, best)`` of each different link: how often it is found, and whether no link of its B id is more frequent.

    Tasks count their own links first, so that what is exchanged is a row for each task and different link.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, base = np.zeros(0, np.int64), np.zeros(0, np.int64), 1

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held), pa.array(held % base), pa.array(counts)], names=["link", "b", "n"])

        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                base = part.column("base")[0].as_py()
                new, n = np.unique(_numbers(part), return_counts=True)
                held, place = np.unique(np.concatenate([held, new]), return_inverse=True)
                counts = np.bincount(place, weights=np.concatenate([counts, n]), minlength=len(held)).astype(np.int64)
                if len(held) > HELD_LINKS:
                    yield given()
                    held, counts = held[:0], counts[:0]
        if len(held):
            yield given()

    total = rows.select("base", "n_links", "links").mapInArrow(trimmed(work), "link long, b long, n long").groupBy("link", "b").agg(F.sum("n").alias("n"))
    most = total.groupBy("b").agg(F.max("n").alias("most"))
    return total.join(most, "b").select("link", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` with ``n_best``, how many of its links are best, and ``count_sum``, the sum of its links' counts.

    ``counts`` is read by the driver and broadcast; the vocabularies bound it (see above).
    """
    table = counts.select("link", "n", "best").toArrow()
    order = np.argsort(table["link"].to_numpy())
    shared = rows.sparkSession.sparkContext.broadcast(
        (table["link"].to_numpy()[order], table["n"].to_numpy()[order], table["best"].to_numpy()[order])
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                found = np.searchsorted(known, _numbers(part))
                bounds = np.concatenate([[0], np.cumsum(part.column("n_links").to_numpy())])
                sums = [np.concatenate([[0], np.cumsum(x[found].astype(np.int64))]) for x in (best, n)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in FIGURES), *(pa.array(np.diff(s[bounds]), pa.int64()) for s in sums)], names=[*FIGURES, "n_best", "count_sum"])

    ddl = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return rows.mapInArrow(trimmed(work), ddl)


def align_documents(docs: DataFrame, a: Callable[[], Tokenizer], b: Callable[[], Tokenizer], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Alignment figures of every document, its links weighed by their counts over all documents.

    Texts are tokenized once: the second pass reads their links from a stage table.
    """
    stages = Stages(docs.sparkSession, "alignment")
    rows = stages.save(aligned(docs, a, b, doc_id, text), "links")
    return with_counts(rows, stages.save(link_counts(rows), "counts"))
