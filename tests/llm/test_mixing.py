import random
import re

import pytest
from pyspark.sql import functions as F

from orrery.llm import mixing


def test_permutation_is_a_bijection(spark):
    for size in (1, 2, 3, 10, 97, 1000):
        rows = spark.range(size).withColumn("size", F.lit(size).cast("long")).withColumn("key", F.lit(12345).cast("long"))
        got = [r["x"] for r in mixing.with_permuted(rows, "x", "id", "size", "key").collect()]
        assert sorted(got) == list(range(size))
        if size > 90:
            assert got != sorted(got)


def water_fill(sizes):
    """Targets by repeated resharing, as the rule is put."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    left, open_, target = float(sum(sizes.values())), set(names), {}
    while True:
        share = left / max(1, sum(weight[s] for s in open_))
        full = [s for s in open_ if weight[s] * share > 3 * sizes[s]]
        if not full:
            return target | {s: weight[s] * share for s in open_}
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            open_.discard(s)


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_repeated_resharing(spark, seed):
    pick = random.Random(seed)
    sizes = {f"s{k}": int(pick.paretovariate(0.5)) * pick.choice([0, 1, 1]) for k in range(pick.randint(1, 30))} | {None: pick.randint(0, 50)}
    rows = mixing.targets(spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, words long, docs long")).collect()
    want = water_fill(sizes)
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]], abs=1e-6)


def corpus(spark):
    pick = random.Random(1)
    rows = [(k, " ".join(f"w{pick.randint(0, 99)}" for _ in range(pick.choice([0, 1, 5, 80, 700]))), pick.choice(["a", "a", "a", "b", "c", None]), 1) for k in range(300)]
    rows += [(1000, None, "a", 1), (1001, " \n ", "b", 1), (1002, "x " * 30000, "c", 1), (1003, "only", "d", 1), (7, "again again", "a", 1), (None, "no id here", "b", 1), (None, "no id here", "b", 1)]
    return rows, spark.createDataFrame([(*r, "z", 5) for r in rows], "doc_id long, text string, source string, n_chars int, row string, rank int")


def test_mix_meets_targets_and_bounds(spark):
    rows, docs = corpus(spark)
    got = mixing.mix_documents(docs).collect()
    assert len(got) == len(rows)
    words = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted((k or -1, words(t)) for k, t, *_ in rows)
    by_source, target = {}, {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        key = (r["source_size"], r["target"])
        by_source[key] = by_source.get(key, 0) + r["taken"]
    for (size, goal), taken in by_source.items():
        assert abs(taken - goal) <= 2 * mixing.BLOCK_WORDS
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_documents(docs.repartition(5)).collect()))
    del target


def test_mixed_texts_hold_the_taken_words(spark):
    _, docs = corpus(spark)
    mixed = mixing.mixed_texts(docs)
    assert mixed.columns == docs.columns
    words = mixed.select(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0]
    assert words == mixing.mix_documents(docs).agg(F.sum("taken")).first()[0]
    assert mixed.where("n_chars <> length(text)").count() == 0
    # The long document's parts are its own words in order.
    assert mixed.where("doc_id = 1002 and text not like 'x x%' and text <> 'x'").count() == 0


def test_shards_follow_the_draw(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 64)
    _, docs = corpus(spark)
    mix = mixing.Mix(docs)
    counts = {(r["rank"], r["shard"]): r["n"] for r in mix.shard_counts().collect()}
    slots = {(r["rank"], r["shard"]): r["count"] for r in mix.slots().groupBy("rank", "shard").count().collect()}
    assert counts == slots and len({s for _, s in counts}) > 3
    assert mix.slots().groupBy("rank", "lap", "block").count().where("count > 1").count() == 0


def drawn_by_hand(slots, size, seed):
    """Counts by (rank, shard): whole parts, and the rest slot by slot."""
    total, counts = sum(slots), {}
    for shard in range(-(-total // size)):
        n = min(size, total - shard * size)
        rest = [n * s % total for s in slots]
        for rank, s in enumerate(slots):
            counts[rank, shard] = n * s // total
        span = sum(rest)
        for j in range(span // total):
            g = shard * (span // total) + j
            h = [((x := (g % mixing.P31 * 48271 + key) % mixing.P31) * (x + 69621)) % mixing.P31 for key in (seed * 2 + 101, seed * 3 + 65537)]
            u = (h[0] * mixing.P31 + h[1]) % span
            rank = next(k for k in range(len(slots)) if sum(rest[: k + 1]) > u)
            counts[rank, shard] += 1
    return {k: n for k, n in counts.items() if n}


def test_counts_are_the_multinomial_draw_and_decide_what_is_taken(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 16)
    monkeypatch.setattr(mixing, "SHARDS", 4)
    _, docs = corpus(spark)
    found, totals = [], []
    for seed in (17, 18):
        mix = mixing.Mix(docs, seed=seed)
        sources = sorted(mix.sources.collect(), key=lambda r: r["rank"])
        counts = {(r["rank"], r["shard"]): r["n"] for r in mix.shard_counts().collect()}
        want = drawn_by_hand([r["slots"] for r in sources], 16, seed)
        open_ = {r["rank"] for r in sources if r["slots"] < 3 * r["blocks"]}
        assert {k: n for k, n in counts.items() if k[0] in open_} == {k: n for k, n in want.items() if k[0] in open_}
        shards = len({s for _, s in counts})
        for r in sources:
            total = sum(n for (rank, _), n in counts.items() if rank == r["rank"])
            assert total <= 3 * r["blocks"] and abs(total - r["slots"]) <= 4 * shards**0.5
        # Each shard's sources come in the proportions of the targets.
        full = {s: [counts.get((r["rank"], s), 0) for r in sources] for _, s in counts}
        for s in range(shards - 1):
            for r, n in zip(sources, full[s], strict=True):
                assert abs(n - 16 * r["slots"] / sum(x["slots"] for x in sources)) <= len(sources)
        found.append(counts)
        totals.append(sorted(map(str, mix.taken().collect())))
    assert found[0] != found[1] and totals[0] != totals[1]
    # The draws alone decide: with the same permutations, other counts take other words.
    same = mixing.Mix(docs, seed=17)
    same.seed = 18
    assert sorted(map(str, same.taken().collect())) != totals[0]


def test_empty_table(spark):
    empty = corpus(spark)[1].limit(0)
    assert mixing.mix_documents(empty).count() == 0
    assert mixing.mixed_texts(empty).count() == 0
    nothing = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix_documents(nothing).collect()] == [0, 0]


def test_slots_are_not_broadcast(spark):
    """Many slots are made of a few counts, whose small file says nothing of them; a plan is many times as large as its own."""
    docs = spark.createDataFrame([(k, "word " * (k % 40), f"s{k % 3}") for k in range(200)], "doc_id long, text string, source string")
    mix = mixing.Mix(docs)
    for df in (mix.taken(), mix.plan()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert re.findall(r"(\w+Join) \[rank#\d+L?, block#\d+L?\]", plan) == ["SortMergeJoin"]
    plan = mixing.mixed_texts(docs)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"(\w+Join) \[\w+#\d+L?\], \[__mix_row#\d+L?\]", plan) == ["SortMergeJoin"]
