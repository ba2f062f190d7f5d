"""Toxicity by cumulative-link ordinal regression (operator 10).

Severity grades 0 < 1 < 2 share one weight vector over sparse text features; grade j or above
has probability sigmoid(score - threshold_j), with ordered thresholds. The expected severity is
the sum of those probabilities.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.rows import trimmed
from orrery.staging import Stages

#: At most this many labelled documents train the model, those whose ids hash lowest.
SAMPLE_DOCS = 12_000
#: At most this many features carry a weight.
MAX_FEATURES = 4096
MIN_DOCS, MIN_Z = 3, 4.0
PREFIXES = (3, 4, 5, 6, 7)
GRADES = 3
_LETTERS = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    """A word's features: itself, and its beginnings, which inflected and unseen forms share."""
    return [word, *("^" + word[:n] for n in PREFIXES if len(word) > n)]


def feature_counts(text: str) -> tuple[Counter, int]:
    """How often each feature occurs in a text, and the number of its words."""
    words = Counter(_LETTERS.findall(text.lower()))
    counts: Counter = Counter()
    for word, n in words.items():
        for feature in word_features(word):
            counts[feature] += n
    return counts, sum(words.values())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


@dataclass
class OrdinalModel:
    """Weights by feature, the weight of log length, and ascending thresholds."""

    features: dict[str, float] = field(default_factory=dict)
    length: float = 0.0
    thresholds: tuple[float, ...] = (math.inf,) * (GRADES - 1)

    def severity(self, counts: dict[str, int], words: int) -> list[float]:
        """P(grade >= 1), P(grade >= 2), ..."""
        score = self.length * math.log1p(words) + sum(self.features[f] * math.log1p(n) for f, n in counts.items())
        return [float(_sigmoid(np.float64(score - t))) for t in self.thresholds]


class Scorer:
    """Scores texts with a model; remembers which words carry features, within a bound."""

    def __init__(self, model: OrdinalModel, most_words: int = 50_000):
        self.model, self.most, self.known = model, most_words, {}

    def __call__(self, text: str | None) -> list[float]:
        words = _LETTERS.findall((text or "").lower())
        counts: dict[str, int] = {}
        for word, n in Counter(words).items():
            hit = self.known.get(word)
            if hit is None:
                hit = self.known[word] = [f for f in word_features(word) if f in self.model.features]
            for f in hit:
                counts[f] = counts.get(f, 0) + n
        if len(self.known) > self.most:
            self.known.clear()
        return self.model.severity(counts, len(words))


def fit_ordinal(
    cells: tuple[np.ndarray, np.ndarray, np.ndarray], width: int, grades: np.ndarray, l2: float = 1e-5, steps: int = 1500, rate: float = 0.05
) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood weights and thresholds of the cumulative-link model (Adam, full batches).

    ``cells`` are the rows, columns and values of a sparse matrix with ``width`` columns.
    Thresholds are a first one plus positive gaps, so they stay ordered.
    """
    at, feature, value = cells
    n, d, k = len(grades), width, GRADES - 1
    theta = np.zeros(d + k)
    theta[d] = 1.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    eye = np.arange(k)
    for step in range(1, steps + 1):
        gaps = np.exp(theta[d + 1 :])
        cuts = theta[d] + np.concatenate([[0.0], np.cumsum(gaps)])
        scores = np.bincount(at, weights=value * theta[feature], minlength=n)
        above = _sigmoid(scores[:, None] - cuts)  # P(grade >= j + 1)
        padded = np.hstack([np.ones((n, 1)), above, np.zeros((n, 1))])
        p = np.clip(padded[np.arange(n), grades] - padded[np.arange(n), grades + 1], 1e-9, None)
        slope = above * (1 - above) / p[:, None]
        # The gradient of -log p by (score - cut_j) for the two cuts beside the grade.
        part = np.where(eye == grades[:, None], slope, 0.0) - np.where(eye == grades[:, None] - 1, slope, 0.0)
        by_score = part.sum(axis=1)
        by_cut = -part.mean(axis=0)
        by_gap = np.array([by_cut[j:].sum() for j in range(1, k)]) * gaps
        by_weight = np.bincount(feature, weights=value * by_score[at], minlength=d) / n + l2 * theta[:d]
        gradient = np.concatenate([by_weight, [by_cut.sum()], by_gap])
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:d], theta[d] + np.concatenate([[0.0], np.cumsum(np.exp(theta[d + 1 :]))])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE_DOCS) -> OrdinalModel:
    """Train on at most ``sample`` labelled documents.

    ``labels`` holds 0 or 1. Grades come from it and from the text: clean documents have grade 0;
    a toxic one has grade 2 where it holds more marking features than the median toxic one,
    else 1. A label without a document, or that is null, does not
    count; repeated labels of a document count once, as toxic if one says so. Without documents
    of both kinds the model finds nothing toxic.
    """
    stages = Stages(docs.sparkSession, "toxicity")
    chosen = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(toxic).cast("int").alias("toxic")).na.drop()
    chosen = chosen.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    rows = stages.save(rows, "sample")
    dealt = rows.repartition(docs.sparkSession.sparkContext.defaultParallelism, "id")  # small files would be read by few tasks
    counted = pa.schema([("feature", pa.string()), ("docs", pa.int64()), ("toxic", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many documents, and toxic ones, have each feature; a table of bounded size is given up at a time."""
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for body, bad in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for feature in feature_counts(body.as_py())[0]:
                    cell = seen.setdefault(feature, [0, 0])
                    cell[0] += 1
                    cell[1] += bad
                if len(seen) >= 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(seen), *(pa.array([c[k] for c in seen.values()], pa.int64()) for k in (0, 1))], schema=counted)
                    seen = {}
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(seen), *(pa.array([c[k] for c in seen.values()], pa.int64()) for k in (0, 1))], schema=counted)

    total, bad = rows.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not 0 < (bad or 0) < total:
        stages.drop(rows)
        return OrdinalModel()
    share = bad / total
    marks = dealt.select("text", "toxic").mapInArrow(trimmed(count), "feature string, docs long, toxic long").groupBy("feature").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
    z = (F.col("toxic") - F.col("docs") * share) / F.sqrt(F.col("docs") * share * (1 - share))
    marks = marks.select("feature", "docs", z.alias("z")).where((F.col("docs") >= MIN_DOCS) & (F.col("z") >= MIN_Z))
    names = [r["feature"] for r in marks.orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).collect()]
    place = {name: k for k, name in enumerate(names)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, with its counts of the features that carry a weight."""
        for batch in batches:
            found, words = [], []
            for body in batch.column(2):
                counts, n = feature_counts(body.as_py())
                found.append([(place[f], k) for f, k in counts.items() if f in place])
                words.append(n)
            cells = [pa.array([[c[k] for c in row] for row in found], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.int64()), *cells], names=["id", "toxic", "words", "feature", "n"])

    taken = dealt.select("id", "toxic", "text").mapInArrow(trimmed(cut), "id long, toxic int, words long, feature array<long>, n array<long>").collect()
    stages.drop(rows)
    heads: dict[int, list] = {}  # repeated rows of an id count once, with the most of each
    for r in sorted(taken):
        head = heads.setdefault(r["id"], [r["toxic"], 0, {}])
        head[1] = max(head[1], r["words"])
        for k, n in zip(r["feature"], r["n"], strict=True):
            head[2][k] = max(head[2].get(k, 0), n)
    cells = [(key, k, n) for key in sorted(heads) for k, n in sorted(heads[key][2].items(), key=lambda c: names[c[0]])]

    ids = {key: k for k, key in enumerate(sorted(heads))}
    at = np.array([ids[c[0]] for c in cells] + list(ids.values()), dtype=np.int64)
    feature = np.array([c[1] for c in cells] + [len(names)] * len(ids), dtype=np.int64)
    counts = np.array([c[2] for c in cells], dtype=float)
    words = np.array([heads[key][1] for key in ids], dtype=float)
    value = np.log1p(np.concatenate([counts, words]))
    marked = np.bincount(at[: len(cells)], weights=counts, minlength=len(ids))
    is_toxic = np.array([heads[key][0] for key in ids], dtype=int)
    grades = is_toxic * (1 + (marked > np.median(marked[is_toxic == 1])))
    weights, cuts = fit_ordinal((at, feature, value), len(names) + 1, grades)
    return OrdinalModel(dict(zip(names, weights[:-1].tolist(), strict=True)), float(weights[-1]), tuple(cuts.tolist()))


def score(docs: DataFrame, model: OrdinalModel, doc_id: str = "doc_id", text: str = "text", reject: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``severity`` (expected, 0 to 2), ``grade`` (most likely),
    ``p_toxic`` (probability of grade 1 or above), ``toxic`` (``p_toxic`` >= ``reject``), ``kept``.

    A null text counts as empty, a null id stays, repeated rows are scored one by one, an empty
    table gives no rows and other columns are ignored.
    """
    out = pa.schema([("doc_id", pa.int64()), ("severity", pa.float64()), ("grade", pa.int32()), ("p_toxic", pa.float64()), ("toxic", pa.bool_()), ("kept", pa.bool_())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            severity, grade, p_toxic = [], [], []
            for body in batch.column(1):
                p = scorer(body.as_py())
                steps = [1.0, *p, 0.0]
                severity.append(sum(p))
                grade.append(max(range(GRADES), key=lambda j, s=steps: s[j] - s[j + 1]))
                p_toxic.append(p[0])
            toxic = [p >= reject for p in p_toxic]
            columns = [severity, grade, p_toxic, toxic, [not t for t in toxic]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t.type) for c, t in zip(columns, list(out)[1:], strict=True))], schema=out)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(trimmed(work), "doc_id long, severity double, grade int, p_toxic double, toxic boolean, kept boolean")


def keep_clean(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", reject: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text the model fitted here does not reject."""
    model = fit(docs, labels, doc_id, text)
    schema, at = docs.schema, docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            keep = [scorer(body.as_py())[0] < reject for body in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(trimmed(work), schema)
