import random
import re

import numpy as np
import pyarrow as pa
import pytest

from orrery.llm import minhash
from orrery.llm.shingles import shingle_sets


def sets_of(rows):
    out = []
    for _, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = [x for x in re.split("[\x20\x09-\x0d]+", lowered) if x]
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def brute(rows):
    """(id, set size, component, kept) by comparing all pairs."""
    sets = sets_of(rows)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), key), key)
    return sorted((key, len(s), least[root(i)], key == least[root(i)]) for i, ((key, _), s) in enumerate(zip(rows, sets, strict=True)))


def family(pick, first, count, words, edits, vocabulary):
    base = [pick.choice(vocabulary) for _ in range(words)]
    rows = [(first, " ".join(base))]
    for k in range(1, count):
        copy = list(base)
        for _ in range(pick.randint(0, edits)):
            copy[pick.randrange(words)] = pick.choice(vocabulary) + str(pick.randint(0, 9999))
        rows.append((first + k, " ".join(copy)))
    return rows


def corpus(seed):
    pick = random.Random(seed)
    vocabulary = ["".join(pick.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows = []
    for f in range(12):
        rows += family(pick, 1000 * (f + 1), pick.choice([2, 3, 8, 30, 90]), pick.choice([12, 60, 150]), pick.choice([1, 3, 6]), vocabulary)
    passage = " ".join(pick.choice(vocabulary) for _ in range(60))
    rows += [(50_000 + k, passage + " " + " ".join(pick.choice(vocabulary) for _ in range(15 + k % 40))) for k in range(80)]
    rows += [(1, None), (2, ""), (3, " \t"), (4, "two words"), (5, "TWO Words"), (6, "two  words"), (7, "a b c d e"), (8, "A B C D E"), (9, "É b c d e"), (10, "é b c d e"), (11, "x " * 20000), (12, "x " * 9)]
    pick.shuffle(rows)
    return rows


def as_docs(spark, rows):
    return spark.createDataFrame([(k, t, 1, "x", [1]) for k, t in rows], "doc_id long, text string, key int, class string, bands array<int>").repartition(3)


@pytest.mark.parametrize("small", [32, 3])
def test_against_all_pairs(spark, monkeypatch, small):
    """Also with a low limit for small buckets and small blocks, so that families are resolved by blocks."""
    monkeypatch.setattr(minhash, "SMALL", small)
    if small == 3:
        monkeypatch.setattr(minhash, "BLOCK", 2000)
        monkeypatch.setattr(minhash, "GROUP", 4)
    rows = corpus(small)
    got = minhash.as_contract(minhash.near_duplicates(as_docs(spark, rows))).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(minhash, "NEAR_ROWS", 0)
    rows = corpus(5)
    got = minhash.as_contract(minhash.near_duplicates(as_docs(spark, rows))).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_keep_one(spark):
    rows = corpus(7)
    docs = as_docs(spark, rows)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [r[0] for r in brute(rows) if r[3]]
    twice = as_docs(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (1, "q r s t u v"), (None, "A b c d e f"), (2, None), (2, None)])
    assert sorted((r["text"] or "").lower() for r in minhash.keep_one(twice).collect()) == ["", "", "a b c d e f", "q r s t u v"]


def test_empty_table(spark):
    empty = as_docs(spark, [(1, "a")]).limit(0)
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.keep_one(empty).count() == 0


def test_signature_is_a_circular_shift_of_one_permutation():
    shingles = next(iter(shingle_sets(pa.array([" ".join(f"w{k}" for k in range(700))]))))
    got = minhash.signature(shingles, 40)
    base = [int(v) for v in minhash._sigma((shingles >> np.uint64(32)).astype(np.uint32))]

    def pi(y):
        y ^= y >> 16
        y = y * 0x7FEB352D % 2**32
        y ^= y >> 15
        return y * 0x846CA68B % 2**32

    assert got.tolist() == [min(pi((b + k) % 2**32) for b in base) for k in range(1, 41)]


def test_signature_estimates_similarity():
    words = [f"w{k}" for k in range(2000)]
    a, b = shingle_sets(pa.array([" ".join(words[:1500]), " ".join(words[300:1800])]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    same = (minhash.signature(a, 2000) == minhash.signature(b, 2000)).mean()
    assert abs(same - true) < 0.05


def test_shingle_sets_match_words():
    rows = corpus(3)
    for column in (pa.array([t for _, t in rows]), pa.array([t for _, t in rows], pa.large_string()).slice(3)):
        expected = [len(s) for s in sets_of(rows)][-len(column) :]
        assert [len(s) for s in shingle_sets(column)] == expected


def test_one_family_of_thousands_at_real_sizes():
    import time

    pick = np.random.default_rng(2)
    core = pick.integers(0, 1 << 62, 200).astype(np.uint64)
    linked, apart = [], []
    for _ in range(8000):
        for found, changed in ((linked, 10), (apart, 60)):
            row = core.copy()
            row[pick.choice(200, changed, replace=False)] = pick.integers(0, 1 << 62, changed)
            found.append(np.unique(row))
    began = time.process_time()
    ids = list(range(8000))
    assert len(minhash._block_links(ids, ids, [False] * 8000, linked, 75)) == 7999
    assert minhash._block_links(ids, ids, [False] * 8000, apart, 75) == []
    assert time.process_time() - began < 30


def test_block_links_against_all_pairs(monkeypatch):
    pick = np.random.default_rng(1)
    for turn in range(60):
        monkeypatch.setattr(minhash, "CELLS", (1 << 20, 64, 300)[turn % 3])
        n = int(pick.integers(2, 40))
        cores = [np.sort(pick.choice(200, pick.integers(3, 40), replace=False)) for _ in range(3)]
        sets = []
        for _ in range(n):
            core = cores[pick.integers(3)]
            kept = np.delete(core, pick.choice(len(core), pick.integers(0, 1 + len(core) // 3), replace=False))
            sets.append(np.unique(np.concatenate([kept, pick.choice(200, pick.integers(0, 4)), [201]])).astype(np.uint64))
        ids, parts = list(range(100, 100 + n)), [int(x) for x in pick.integers(0, n, n)]
        sides = [bool(x) for x in (pick.integers(0, 2, n) if turn % 2 else np.zeros(n))]

        def joined(links):
            above = {p: p for p in parts}

            def top(p):
                while above[p] != p:
                    p = above[p]
                return p

            for a, b in links:
                x, y = top(parts[a]), top(parts[b])
                above[max(x, y)] = min(x, y)
            return [top(p) for p in parts]

        as_sets = [set(s.tolist()) for s in sets]
        pairs = [(a, b) for a in range(n) for b in range(a) if not (any(sides) and not all(sides)) or sides[a] != sides[b]]
        want = joined([(a, b) for a, b in pairs if 100 * len(as_sets[a] & as_sets[b]) >= 75 * len(as_sets[a] | as_sets[b])])
        got = minhash._block_links(ids, parts, sides, sets, 75)
        assert joined([(a - 100, b - 100) for a, b in got]) == want
        assert len(got) == len(set(parts)) - len(set(want))  # no link but those that join something


def pairs_at(pick, count, common, own):
    """Pairs of sets of common + own shingles, ``common`` of them in both."""
    for _ in range(count):
        x = pick.integers(0, 1 << 63, common + 2 * own).astype(np.uint64) * np.uint64(2)
        yield np.unique(x[: common + own]), np.unique(np.concatenate([x[:common], x[common + own :]]))


def test_recall_at_the_threshold():
    """Pairs at a similarity of exactly 0.75 share a band and are not told apart by their sketches."""
    banding, pick, met, alike = minhash.Banding(), np.random.default_rng(5), 0, 0
    for a, b in pairs_at(pick, 3000, 150, 25):
        one, two = minhash.signature(a, banding.coordinates), minhash.signature(b, banding.coordinates)
        met += bool((minhash.band_keys(one, banding) == minhash.band_keys(two, banding)).any())
        x, y = (np.array(minhash.sketch(s)).view(np.uint64) for s in (one, two))
        differ = sum(int(v).bit_count() for v in (x ^ y)[: banding.words] | (x ^ y)[banding.words :])
        alike += differ <= banding.most_unlike(75)
        assert differ == int(((one ^ two) & 3 > 0).sum())
    assert met == alike == 3000
