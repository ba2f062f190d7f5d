import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from orrery.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    plain = Tokenizer.from_file(PATH)
    return lambda text: plain.encode(text, add_special_tokens=False).ids


LATIN = st.text(st.characters(max_codepoint=0x24F), max_size=60)


@settings(max_examples=300, deadline=None)
@given(LATIN | st.text(max_size=30) | st.lists(st.sampled_from(["<|endoftext|>", "a", " ", "\n", "\r\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "'s", "'LL", "12", "é", "²"])).map("".join))
def test_ids_equal_the_tokenizers_ids(text):
    plain = Tokenizer.from_file(PATH) if not hasattr(test_ids_equal_the_tokenizers_ids, "plain") else test_ids_equal_the_tokenizers_ids.plain
    test_ids_equal_the_tokenizers_ids.plain = plain
    assert packing.load_tokenizer(PATH)(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def check(rows, texts, reference, limits):
    """Every id in exactly one piece, sequences gapless and within the limits."""
    ids = [np.array(reference(t or "") + [0], dtype="<u4") for _, t in texts]
    by_id = {}
    for (key, _), a in zip(texts, ids, strict=True):
        by_id.setdefault(key, []).append(a)
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["item"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(pieces) == set(by_id)
    for key, found in pieces.items():
        got = sorted((r["start"], bytes(r["ids"])) for r in found)
        want = sorted((k, bytes(a[k : k + n].tobytes())) for a in by_id[key] for k, n in _spans(got, a))
        assert got == want or len(by_id[key]) > 1
        assert sum(r["length"] for r in found) == sum(map(len, by_id[key]))
    for found in sequences.values():
        found.sort(key=lambda r: r["offset"])
        at = 0
        for r in found:
            assert r["offset"] == at
            at += r["length"]
        if not found[0]["oversize"]:
            assert at <= limits.tokens and len(found) <= limits.segments and sum(r["loss"] for r in found) <= limits.loss


def _spans(got, a):
    return [(start, len(ids) // 4) for start, ids in got if a[start : start + len(ids) // 4].tobytes() == ids]


def test_pieces_cover_documents(spark, reference):
    texts = [(1, "hello world " * 40), (2, None), (3, ""), (4, "x"), (5, "long text. " * 3000), (6, "same"), (6, "same"), (None, "no id"), *((k, f"doc {k} " * (k % 37)) for k in range(10, 200))]
    docs = spark.createDataFrame([(k, t, "clash", 7) for k, t in texts], "doc_id long, text string, item string, start int")
    rows = packing.pack_documents(docs).collect()
    check(rows, texts, reference, packing.Limits())
    lengths = {}
    for r in rows:
        lengths[r["sequence_id"]] = lengths.get(r["sequence_id"], 0) + r["length"]
    assert all(n == 1024 or n & (n - 1) == 0 for n in lengths.values())
    contract = packing.digest(packing.pack_documents(docs)).where("doc_id = 4").first()
    assert contract["ids_crc32"] == zlib.crc32(np.array(reference("x") + [0], dtype="<u4").tobytes())


def test_every_limit_binds(spark, reference):
    texts = [(k, "word " * (k % 9 + 1)) for k in range(120)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for limits in (packing.Limits(64, 3, 64), packing.Limits(64, 60, 10), packing.Limits(16, 2, 9)):
        for cut in (True, False):
            check(packing.pack_texts(docs, PATH, limits, cut=cut).collect(), texts, reference, limits)


def test_examples_stay_whole_without_cut(spark):
    docs = spark.createDataFrame([(1, "a " * 30, 5), (2, "b " * 200, 0), (3, "c", None)], "doc_id long, text string, reply int")
    rows = {r["item"]: r for r in packing.pack_texts(docs, PATH, packing.Limits(64, 4, 64), cut=False, loss_from="reply").collect()}
    assert len(rows) == 3 and rows[2]["oversize"] and not rows[1]["oversize"]
    assert rows[1]["loss"] == rows[1]["length"] - 5 and rows[3]["loss"] == rows[3]["length"]


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_packer(items, limits, pool):
    """The heuristic in lists: of the pieces that fit under all limits the one with the largest dot product of
    demand and room; where none fits, the one with the largest dot product is cut to what there is room for."""
    room, waiting, out = (limits.tokens, limits.segments, limits.loss), [], []
    need = lambda p: (p[2], 1, max(0, p[1] + p[2] - max(p[1], p[3])))

    def fill():
        left, taken = [1.0, 1.0, 1.0], []
        while waiting:
            demand = [[a / b for a, b in zip(need(p), room)] for p in waiting]
            score = [d[0] * left[0] + d[1] * left[1] + d[2] * left[2] for d in demand]
            fits = [all(a <= b + 1e-9 for a, b in zip(d, left)) for d in demand]
            if any(fits):
                k = max(range(len(waiting)), key=lambda i: (fits[i], score[i], -i))
                left = [a - b for a, b in zip(left, demand[k])]
                taken.append(pop(k))
                continue
            gap = round(left[0] * room[0])
            if gap < 1 or left[1] * room[1] < 1 - 1e-6:
                break
            k = max(range(len(waiting)), key=lambda i: (score[i], -i))
            item, start, length, loss_from = waiting[k]
            size = min(gap, round(left[2] * room[2]) + max(0, loss_from - start), length)
            if size < 1:
                break
            pop(k)
            taken.append((item, start, size, loss_from))
            left = [a - b / c for a, b, c in zip(left, need(taken[-1]), room)]
            if size < length:
                waiting.append((item, start + size, length - size, loss_from))
        return taken

    def pop(k):
        piece, last = waiting[k], waiting.pop()
        if k < len(waiting):
            waiting[k] = last
        return piece

    for item, total, loss_from in items:
        start, step = 0, min(limits.tokens, limits.loss)
        while total - start >= step:
            if step == limits.tokens:
                out.append([(item, start, step, loss_from)])
            else:
                waiting.append((item, start, step, loss_from))
            start += step
            if len(waiting) >= pool:
                out.append(fill())
        if start < total:
            waiting.append((item, start, total - start, loss_from))
        while len(waiting) >= pool:
            out.append(fill())
    return out


def test_placement_against_a_plain_packer():
    pick, bound = random.Random(5), set()
    for limits in (packing.Limits(64, 4, 40), packing.Limits(64, 3, 64), packing.Limits(100, 4, 60)):
        for _ in range(20):
            items = [(k, n := pick.choice([1, 2, 5, 17, 30, 63, 64, 150]), pick.randint(0, n)) for k in range(120)]
            packer, got = packing.Packer(limits, cut=True, pool=12), []
            for item, total, loss_from in items:
                got += [[(i, start, len(ids), first) for i, start, ids, first, _ in sequence] for sequence, _ in packer.add(item, np.arange(total, dtype=np.uint32), loss_from)]
            assert got == plain_packer(items, limits, 12)
            for sequence in got:
                sums = (sum(p[2] for p in sequence), len(sequence), sum(max(0, p[1] + p[2] - max(p[1], p[3])) for p in sequence))
                assert all(a <= b for a, b in zip(sums, (limits.tokens, limits.segments, limits.loss)))
                bound |= {k for k, (a, b) in enumerate(zip(sums, (limits.tokens, limits.segments, limits.loss))) if a == b}
    assert bound == {0, 1, 2}  # each limit binds somewhere
