"""Sets of hashed word shingles, computed for whole Arrow batches of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
_CHUNK_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_LANES = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93], dtype=np.uint64)
_SHORT = np.arange(64, dtype=np.uint64) * _U(0xA0761D6478BD642F)  # tells short sequences of different lengths apart
_powers = np.ones(1, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers; works on a copy."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power_table(size: int) -> np.ndarray:
    global _powers
    if len(_powers) < size:
        table = np.full(max(size, 2 * len(_powers)), _BASE, dtype=np.uint64)
        table[0] = 1
        _powers = np.multiply.accumulate(table)
    return _powers


def _text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; a null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of adjoining texts, and the number of the first word at each bound."""
    text = raw.copy()
    upper = (text >= 65) & (text <= 90)
    text[upper] += 32
    solid = ~((text == 32) | ((text >= 9) & (text <= 13)))
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(text))]
    begins[inner] = solid[inner]
    starts = np.flatnonzero(begins)
    first_word = np.searchsorted(starts, bounds)
    if not len(starts):
        return np.zeros(0, np.uint64), first_word
    # A byte's place in its word; those of white space are blanked out by a zero factor.
    length = np.diff(np.append(starts, len(text)))
    place = np.arange(starts[0], len(text)) - np.repeat(starts, length)
    term = (text[starts[0] :].astype(np.uint64) + _U(1)) * _power_table(int(length.max()))[place]
    term[~solid[starts[0] :]] = 0
    return mix64(np.add.reduceat(term, starts - starts[0])), first_word


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct 64-bit hashes of its shingles.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text with fewer words than a
    shingle has its whole sequence as the only one; a text without words, or a null, has none.
    """
    data, offsets = _text_buffers(column)
    lanes = np.resize(_LANES, words) + np.arange(words, dtype=np.uint64) * _U(2)
    at, rows = 0, len(column)
    while at < rows:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _CHUNK_BYTES, side="right")) - 1)
        bounds = offsets[at : upto + 1] - offsets[at]
        hashes, first = _word_hashes(data[offsets[at] : offsets[upto]], bounds)
        whole = np.zeros(max(0, len(hashes) - words + 1), dtype=np.uint64)
        for k in range(words):
            whole += hashes[k : k + len(whole)] * lanes[k]
        whole = mix64(whole)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(whole[a : b - words + 1])
            elif b > a:
                yield mix64((hashes[a:b] * lanes[: b - a]).sum(keepdims=True) + _SHORT[b - a])
            else:
                yield whole[:0]
        at = upto
