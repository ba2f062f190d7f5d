"""Quality rules as a short-circuit cascade (operator 12), in DataFrame functions only.

A rule rejects documents by a condition on the text. What a rule costs and what share of documents
it rejects are estimated on a bounded sample; the rules then stand in one CASE expression by
rejection per cost, so that a document stops at the first rule that rejects it and dear rules see
few documents. The order changes what the work costs and which rule is named, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.staging import Stages

#: Documents of the sample on which rules are measured, about.
SAMPLE_ROWS = 2000
#: Seconds under which a measured cost cannot be told from none.
LEAST_COST = 1e-3

TEXT, WORDS, LINES = "__text", "__words", "__lines"


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")  # white space at either end leaves an empty part


def lines_of(text: Column) -> Column:
    """The ``\\n``-split lines of a text that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def word_chars(words: Column) -> Column:
    """Code points in words."""
    return F.length(F.array_join(words, "")).cast("long")


def symbols(text: Column) -> Column:
    """Characters of ``[#*$%&|<>]``."""
    return (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long")


def repeated_lines(lines: Column) -> Column:
    """Lines equal to an earlier one."""
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def with_repeated_words(docs: DataFrame, words: str, out: str) -> DataFrame:
    """``docs`` with the number of words in 3-word windows that the text has twice or more, the first included.

    Windows whose hashes all differ all differ: many texts end there. For the others hashes are sorted
    with their places; places with an equal neighbour are sorted by the windows themselves, so that
    equal hashes alone count for nothing. A place that is left covers as many words as lie before the next
    one, three at most. Every step is a column of its own, since a lambda would compute what it
    refers to for each element again.
    """
    w = F.col(words)
    hashes = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    docs = docs.withColumn("__windows", F.slice(hashes, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))))
    again = F.size(F.array_distinct("__windows")) < F.size("__windows")
    docs = docs.withColumn("__sorted", F.when(again, F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("w"), i.alias("at")))))).drop("__windows")
    window = lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    exact = F.transform(_repeated("__sorted"), lambda x: F.struct(window(x["at"]).alias("w"), x["at"].alias("at")))
    docs = docs.withColumn("__exact", F.sort_array(exact)).drop("__sorted")
    docs = docs.withColumn("__places", F.sort_array(F.transform(_repeated("__exact"), lambda x: x["at"]))).drop("__exact")
    p = F.col("__places")
    docs = docs.withColumn("__cover", F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))).drop("__places")
    total = F.aggregate("__cover", F.lit(0).cast("long"), lambda a, x: a + x)
    return docs.withColumn(out, F.coalesce(total, F.lit(0).cast("long"))).drop("__cover")


def _repeated(column: str) -> Column:
    """Elements of a sorted array of (w, at) that have the ``w`` of a neighbour."""
    s = F.col(column)
    return F.filter(s, lambda x, i: (x["w"] == F.get(s, i + 1)["w"]) | (x["w"] == F.get(s, i - 1)["w"]))


@dataclass(frozen=True)
class Rule:
    """``rejects`` gives the condition from the columns ``TEXT``, ``WORDS`` and ``LINES``; a document goes where it is true."""

    name: str
    rejects: Callable[[], Column]


def _share(part: Column, percent: int, whole: Column) -> Column:
    return 100 * part.cast("long") > percent * whole.cast("long")


#: What the rules ask beyond the base, in percent or code points.
MAX_SYMBOLS, MAX_REPEATED_LINES, MAX_UPPER, MIN_LETTERED = 10, 50, 50, 70
MIN_WORD, MAX_WORD = 3, 10

RULES = (
    Rule("symbols", lambda: _share(symbols(F.col(TEXT)), MAX_SYMBOLS, F.size(WORDS))),
    Rule("repeated lines", lambda: _share(repeated_lines(F.col(LINES)), MAX_REPEATED_LINES, F.size(LINES))),
    Rule("short words", lambda: word_chars(F.col(WORDS)) < MIN_WORD * F.size(WORDS)),
    Rule("long words", lambda: word_chars(F.col(WORDS)) > MAX_WORD * F.size(WORDS)),
    Rule("upper case", lambda: _share(F.length(F.regexp_replace(F.col(TEXT), r"[^\p{Lu}]+", "")), MAX_UPPER, word_chars(F.col(WORDS)))),
    Rule("words without letters", lambda: 100 * F.size(F.filter(WORDS, lambda w: w.rlike(r"\p{L}"))) < MIN_LETTERED * F.size(WORDS)),
)


@dataclass(frozen=True)
class Measured:
    """A rule with the seconds it takes on the sample and the share of the sample that it rejects."""

    rule: Rule
    cost: float
    rejected: float


def prepared(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the columns that rules read; a null text is empty."""
    docs = docs.withColumn(TEXT, F.coalesce(F.col(text), F.lit("")))
    return docs.withColumn(WORDS, words_of(F.col(TEXT))).withColumn(LINES, lines_of(F.col(TEXT)))


def sample_of(docs: DataFrame, text: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` rows, those whose texts hash lowest: the same in every scan, however rows are dealt out.

    Copies of one text come together, so a family of copies may be all or none of the sample.
    """
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    share = min(1.0, rows / max(1, docs.count()))
    return texts.where(F.pmod(F.xxhash64("text", F.lit(17)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).limit(2 * rows)


def measure(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", rows: int = SAMPLE_ROWS) -> list[Measured]:
    """Cost and selectivity of each rule on a sample of about ``rows`` documents.

    A cost is what a job over the sample takes with the rule beyond what it takes without any.
    An empty table leaves every rule at the least cost and rejecting nothing.
    """
    stages = Stages(docs.sparkSession, "quality")
    sample = stages.save(prepared(sample_of(docs, text, rows), "text"), "sample")  # words and lines are no rule's cost

    def seconds(condition: Column) -> tuple[float, float]:
        took = []
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            share = sample.agg(F.avg(F.when(condition, 1.0).otherwise(0.0)), F.sum(F.size(WORDS) + F.size(LINES) + F.length(TEXT))).first()[0]
            took.append(time.perf_counter() - began)
        return min(took), share or 0.0

    base, _ = seconds(F.lit(False))
    found = []
    for rule in rules:
        cost, share = seconds(F.coalesce(rule.rejects(), F.lit(False)))
        found.append(Measured(rule, max(LEAST_COST, cost - base), share))
    stages.drop_all()
    return found


def ordered(measured: Sequence[Measured]) -> list[Rule]:
    """Rules by rejection per cost, the greatest first; equal ones by cost, then by name."""
    return [m.rule for m in sorted(measured, key=lambda m: (-m.rejected / m.cost, m.cost, m.rule.name))]


def first_rejecting(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects, or null; rules after it are not evaluated."""
    found = F.lit(None).cast("string")
    for rule in reversed(rules):
        found = F.when(rule.rejects(), F.lit(rule.name)).otherwise(found)
    return found


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``rejected_by``, the first rule of the measured order that rejects the row, or null.

    Every row stays and is judged by its whole text. A null text is empty; whether an empty text
    passes is the rules' matter (none of ``RULES`` rejects it). Null and repeated ids make no
    difference, an empty table gives no rows, and a column named ``rejected_by`` is replaced.
    """
    chosen = ordered(measure(docs, rules, text, rows))
    return prepared(docs, text).withColumn("rejected_by", first_rejecting(chosen)).drop(TEXT, WORDS, LINES)


#: The base of the registered query.
MIN_WORDS, MAX_REPEATED_WORDS = 50, 50


def judge_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The base figures of every document and whether it is kept.

    A document fails the base under 50 words, or if more than half of them lie in repeated 3-word
    windows; the cascade judges the others. A null text has no words and fails. Ids are passed on
    as they are, null or repeated; other columns are ignored; an empty table gives no rows.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    chosen = ordered(measure(slim))
    rows = with_repeated_words(prepared(slim, "text"), WORDS, "n_repeat_words")
    failed = (F.size(WORDS) < MIN_WORDS) | _share(F.col("n_repeat_words"), MAX_REPEATED_WORDS, F.size(WORDS))
    return rows.select(
        "doc_id",
        F.size(WORDS).cast("long").alias("n_words"),
        word_chars(F.col(WORDS)).alias("word_chars"),
        symbols(F.col(TEXT)).alias("n_symbols"),
        repeated_lines(F.col(LINES)).alias("n_dup_lines"),
        "n_repeat_words",
        failed.alias("base_failed"),
        F.when(failed, F.lit(False)).otherwise(first_rejecting(chosen).isNull()).alias("kept"),
    )


ORACLE_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents),
parts AS (
  SELECT r, doc_id, body, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM texts),
places AS (
  SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM parts WHERE len(words) >= 3),
windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS n FROM places),
covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM windows, range(3) AS s(k) WHERE windows.n >= 2 GROUP BY r),
figures AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
         length(regexp_replace(body, '[^\p{Lu}]', '', 'g')) AS n_upper,
         len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) AS n_lettered
  FROM parts LEFT JOIN covered c USING (r)),
based AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM figures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 50 * n_lines OR word_chars < 3 * n_words
            OR word_chars > 10 * n_words OR 100 * n_upper > 50 * word_chars OR 100 * n_lettered < 70 * n_words) AS kept
FROM based
"""
