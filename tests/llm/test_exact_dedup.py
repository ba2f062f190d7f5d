import hashlib
import re

from pyspark.sql import functions as F

from orrery.llm import exact_dedup

TEXTS = [
    (1, "a b"), (2, "a  b "), (3, "ab"), (4, None), (5, ""), (6, " \t\n"), (7, " "), (8, "c" * 5000), (9, "c" * 5000 + "\x0b"), (10, "a\x0cb\r"), (11, "d"), (12, "d"), (13, "\x1c"),
]


def brute(rows):
    groups = {}
    for key, text in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", text or ""), []).append((-len(text or ""), key))
    out = []
    for key, text in rows:
        norm = re.sub("[\x20\x09-\x0d]", "", text or "")
        keep = min(groups[norm])[1]
        out.append((key, keep, len(groups[norm]), key == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out)


def docs_of(spark, rows):
    return spark.createDataFrame([(k, t, "x", b"y") for k, t in rows], "doc_id long, text string, content string, digest binary").repartition(3)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HEAVY_ROWS", 2)
    rows = TEXTS + [(100 + k, "hot text") for k in range(400)]
    got = exact_dedup.as_contract(exact_dedup.decide(docs_of(spark, rows))).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_weak_digests_compare_contents(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HEAVY_ROWS", 2)
    weak = lambda content: F.unhex(F.lpad(F.hex(F.length(content) % 2), 2, "0"))
    got = exact_dedup.decide(docs_of(spark, TEXTS), digest=weak).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(tuple, got)) == [r[:4] for r in brute(TEXTS)]


def test_keep_one_keeps_one_row_of_each_text(spark):
    docs = docs_of(spark, TEXTS)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r[1] for r in brute(TEXTS)})
    twice = docs_of(spark, [(1, "a"), (1, "a"), (1, "b"), (None, "z"), (None, "z"), (2, "b "), (3, "q")])
    got = sorted((r["doc_id"] or -1, r["text"]) for r in exact_dedup.keep_one(twice).collect())
    assert got == [(-1, "z"), (1, "a"), (2, "b "), (3, "q")]


def test_keep_one_with_one_null_id(spark):
    kept = lambda rows: sorted((r["doc_id"] or -1, r["text"]) for r in exact_dedup.keep_one(docs_of(spark, rows)).collect())
    rows = [(1, "a"), (2, "b"), (3, "b  ")]
    assert kept([*rows, (None, "z")]) == [(-1, "z"), (1, "a"), (3, "b  ")]
    assert kept([*rows, (None, "b   ")]) == [(-1, "b   "), (1, "a")]
    assert kept([*rows, (None, "b  ")]) == [(1, "a"), (3, "b  ")]
    assert kept([*rows, (None, "b   "), (None, "z")]) == [(-1, "b   "), (-1, "z"), (1, "a")]
    assert kept([(-(2**63), "a"), (None, "a"), (5, "a")]) == [(-(2**63), "a")]


def test_empty_table(spark):
    empty = docs_of(spark, [(1, "a")]).limit(0)
    assert exact_dedup.decide(empty).count() == 0
    assert exact_dedup.keep_one(empty).count() == 0


def test_null_and_repeated_ids_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HEAVY_ROWS", 2)
    for rows in ([(None, "z"), (1, "a"), (2, "a ")], [(None, "a  "), (1, "a"), (None, "a"), (2, "b")], [(1, "a"), (1, "a"), (1, "b "), (2, "b"), (None, None), (None, "")], [(None, "hot")] * 5 + [(3, "hot")]):
        groups = {}
        for at, (key, text) in enumerate(rows):
            groups.setdefault(re.sub("[\x20\x09-\x0d]", "", text or ""), []).append((-len(text or ""), key is None, key or 0, at))
        want = []
        for at, (key, text) in enumerate(rows):
            group = groups[re.sub("[\x20\x09-\x0d]", "", text or "")]
            best = min(group)
            want.append((key, None if best[1] else best[2], len(group)))
        decided = exact_dedup.decide(docs_of(spark, rows))
        got = decided.select("doc_id", "keep_id", "group_size", "kept").collect()
        assert sorted(map(str, (tuple(r)[:3] for r in got))) == sorted(map(str, want))
        assert all(r["kept"] is not None for r in got) and sum(r["kept"] for r in got) == len(groups)
        assert exact_dedup.keep_one(docs_of(spark, rows)).count() == len(groups)
