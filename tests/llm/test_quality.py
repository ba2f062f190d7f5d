import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orrery.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def figures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return words, len(covered), lines


def brute(key, text):
    words, repeated, lines = figures(text)
    n, chars, text = len(words), sum(map(len, words)), text or ""
    symbols, again = sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines))
    failed = n < 50 or 100 * repeated > 50 * n
    upper, lettered = sum(c.isupper() for c in text), sum(any(c.isalpha() for c in w) for w in words)
    bad = 100 * symbols > 10 * n or 100 * again > 50 * len(lines) or not 3 * n <= chars <= 10 * n or 100 * upper > 50 * chars or 100 * lettered < 70 * n
    return key, n, chars, symbols, again, repeated, failed, not failed and not bad


def awkward():
    rng = random.Random(5)
    prose = lambda n, vocab=3000: " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))
    letters = lambda n: " ".join("".join(rng.choices("abcdeé", k=rng.randint(3, 7))) for _ in range(n))
    texts = [
        None, "", " ", "\n\n", "a", "a b", "a b c", "a b c a b c", " lead and trail \x0b\x0c", "x\x1cy z", "a a a a a a", "\n".join(["one line here"] * 30),
        letters(60), letters(49), letters(50), letters(200).upper(), " | ".join(letters(90).split()), letters(70) + " #" * 8, letters(100) + "\n" + "\n".join([letters(3)] * 9),
        prose(400, 12), prose(300, 40), prose(3000, 500), "z" * 200_000, ("y" * 12 + " ") * 60, "ab " * 60, "tail tail " + letters(55) + " tail tail tail", letters(30_000),
        "É" * 5 + " " + letters(80), "1 2 3 4 5 " * 12 + letters(20),
    ]
    return [(k, t) for k, t in enumerate(texts)] + [(None, letters(52)), (3, letters(51)), (3, letters(51))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "x", [1], "n") for k, t in awkward()]
    return spark.createDataFrame(rows, "doc_id long, text string, __words string, __lines array<int>, n_words string").repartition(3)


def test_against_brute_force(docs):
    got = quality.judge_documents(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted((brute(*r) for r in awkward()), key=str)


def test_equal_hashes_alone_count_for_nothing(spark, monkeypatch):
    monkeypatch.setattr(F, "xxhash64", lambda *c: (F.length(c[0]) % 2).cast("long"))
    rows = [(k, t) for k, t in awkward() if t and len(t) < 5000]
    words = quality.prepared(spark.createDataFrame(rows, "doc_id long, text string"), "text")
    got = quality.with_repeated_words(words, quality.WORDS, "n").select("text", "n").collect()
    assert sorted(map(tuple, got)) == sorted((t, figures(t)[1]) for _, t in rows)


def test_order_of_rules_changes_the_name_and_not_the_verdict(docs):
    seen = []
    for rules in (quality.RULES, quality.RULES[::-1]):
        out = quality.prepared(docs, "text").withColumn("by", quality.first_rejecting(rules))
        seen.append(sorted(((r["text"] or ""), r["by"] is None) for r in out.select("text", "by").collect()))
    assert seen[0] == seen[1]


def test_later_rules_are_not_evaluated(docs):
    fatal = quality.Rule("fatal", lambda: F.raise_error(F.lit("evaluated")).cast("boolean"))
    every = quality.Rule("every", lambda: F.size(quality.WORDS) >= 0)
    out = quality.prepared(docs, "text").select(quality.first_rejecting([every, fatal]).alias("by"))
    assert {r["by"] for r in out.collect()} == {"every"}


def test_rules_stand_by_rejection_per_cost():
    rule = lambda name: quality.Rule(name, lambda: F.lit(False))
    given = [quality.Measured(rule("dear"), 2.0, 0.5), quality.Measured(rule("cheap"), 0.01, 0.1), quality.Measured(rule("idle"), 0.001, 0.0), quality.Measured(rule("even"), 1.0, 0.25)]
    assert [r.name for r in quality.ordered(given)] == ["cheap", "even", "dear", "idle"]


def test_measured_on_a_sample(spark):
    rows = [(k, ("# " if k % 4 == 0 else "") * 40 + f"word{k} " * 60) for k in range(400)]
    found = quality.measure(spark.createDataFrame(rows, "doc_id long, text string"), quality.RULES, rows=200)
    shares = {m.rule.name: m.rejected for m in found}
    assert 0.1 < shares["symbols"] < 0.4 and shares["upper case"] == 0 and all(m.cost > 0 for m in found)


def test_cascade_keeps_all_rows_and_columns(docs):
    out = quality.cascade(docs.drop("__words", "__lines"))
    assert out.columns == ["doc_id", "text", "n_words", "rejected_by"]
    assert out.count() == docs.count()


def test_empty_table(docs):
    assert quality.judge_documents(docs.limit(0)).count() == 0
    assert quality.cascade(docs.limit(0)).count() == 0
