import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm import fingerprints as fp

TEXT = st.text(st.sampled_from("ab\U0001f600é"), max_size=40)


@settings(max_examples=200, deadline=None)
@given(TEXT, TEXT, st.data())
def test_spans_and_extensions_against_brute_force(a, b, data):
    x, y = fp.PrefixHash(a), fp.PrefixHash(b)
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    n = data.draw(st.integers(0, min(len(a) - i, len(b) - j)))
    assert x.equal(i, y, j, n) == (a[i : i + n] == b[j : j + n])
    longest = 0
    while i + longest < len(a) and j + longest < len(b) and a[i + longest] == b[j + longest]:
        longest += 1
    assert x.common_extension(i, y, j) == longest


def test_all_spans_of_a_width_agree_with_single_ones():
    x = fp.PrefixHash("the quick brown fox")
    assert x.spans(4).tolist() == [x.span(k, k + 4)[0] for k in range(len(x) - 3)]


def rows_of(seed):
    pick = random.Random(seed)
    rows = [(k * 7 - 50, "".join(pick.choice("abcde \U0001f600ñ") for _ in range(pick.choice([0, 1, 15, 16, 17, 300, 3000])))) for k in range(120)]
    rows += [(9000, None), (9001, ""), (9002, "same text here, long enough to sample"), (9003, "same text here, long enough to sample"), (9004, "z" * 50_000)]
    return rows


@pytest.mark.parametrize("ranges", [1, 4, 40])
def test_query_against_brute_force(spark, monkeypatch, ranges):
    monkeypatch.setattr(fp, "RANGES", ranges)
    monkeypatch.setattr(fp, "RANGE_DOCS", 3)
    rows = rows_of(ranges)
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, range int, row string").repartition(5)
    got = {r["doc_id"]: r for r in fp.fingerprints(docs).collect()}
    rows = sorted((k, t or "") for k, t in rows)
    assert len(got) == len(rows)
    for at, (key, text) in enumerate(rows):
        following = rows[(at + 1) % len(rows)]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[1][:half]
        r = got[key]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for t, mark in ((text, r["fingerprint"]), (edited, r["edited_fingerprint"])):
            hashed = fp.PrefixHash(t)
            assert mark == fp.fingerprint(hashed, fp.sketch(hashed))
        assert r["near_next"] == fp.likeness(r["fingerprint"], got[following[0]]["fingerprint"])
        assert r["near_edited"] == fp.likeness(r["fingerprint"], r["edited_fingerprint"])
        assert 0 <= r["near_edited"] <= 1
    assert got[9002]["near_next"] == 1.0 and got[9002]["fingerprint"] == got[9003]["fingerprint"]


def test_repeated_null_and_single_ids(spark):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(1, "aa"), (1, "aa"), (None, "bb"), (2, "cc")], schema)
    got = sorted((r["doc_id"] or 99, r["n_chars"]) for r in fp.fingerprints(docs).collect())
    assert got == [(1, 2), (1, 2), (2, 2), (99, 2)]
    single = fp.fingerprints(spark.createDataFrame([(5, "abcd")], schema)).first()
    assert single["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and single["near_next"] == 1.0
    assert fp.fingerprints(docs.limit(0)).count() == 0


def test_likeness_measures_the_common_share():
    pick = random.Random(3)
    text = "".join(pick.choice("abcdefghij ") for _ in range(20_000))
    other = "".join(pick.choice("abcdefghij ") for _ in range(20_000))
    mark = lambda t: fp.fingerprint(h := fp.PrefixHash(t), fp.sketch(h))
    assert fp.likeness(mark(text), mark(other)) < 0.1
    assert abs(fp.likeness(mark(text), mark(text[:10_000] + other[:10_000])) - 0.5) < 0.2
    assert fp.likeness(mark(text), mark(text)) == 1.0 and fp.likeness(mark(""), mark("x")) == 0.0
