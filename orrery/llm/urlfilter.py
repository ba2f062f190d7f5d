"""URL filtering by logistic regression on hashed character n-grams (operator 9).

A small labelled table trains the model on the driver; its weights, whose number is fixed,
travel with the task. Explicit rules, where one fits, decide before the model.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.rows import trimmed

BUCKETS = 1 << 14
GRAMS = (3, 4, 5)
_CUT = re.compile(r"[^A-Za-z0-9\u0080-\U0010ffff]+")

#: The labelled table: ``label`` (1 for URLs to block) and ``url``, of invented sites.
TABLE = Path(__file__).with_name("labelled_urls.tsv")
#: Of held-out allowed URLs, at most this share may be blocked when the threshold is set.
FALSE_BLOCKS = 0.01
FOLDS = 5


def labelled_urls(path: Path = TABLE) -> list[tuple[str, int]]:
    """The small labelled table that comes with the package, as (url, label)."""
    lines = path.read_text(encoding="utf-8").splitlines()[1:]
    return [(url, int(label)) for label, _, url in (line.partition("\t") for line in lines)]


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host, its subdomains, and paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parse_rules(lines: Sequence[str]) -> list[Rule]:
    """Rules written like ``block example.org/private/``."""
    rules = []
    for line in lines:
        verdict, target = line.split()
        host, slash, path = target.partition("/")
        rules.append(Rule(host.lower(), slash + path, verdict))
    return rules


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From after the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path as :func:`host_of` and :func:`path_of` give them."""
    _, mark, rest = (url or "").partition("://")
    end = min([len(rest), *(k for c in "/?#" if (k := rest.find(c)) >= 0)])
    stop = min([len(rest), *(k for c in "?#" if (k := rest.find(c, end)) >= 0)])
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return rest[:end].translate(table), rest[end:stop]


def rule_for(rules: Sequence[Rule]) -> Column:
    """The name and verdict of the longest rule that fits columns ``host`` and ``path``, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = (F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)
        found = F.when(fits & F.col("path").startswith(rule.path), F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def gram_buckets(host: str, path: str, buckets: int = BUCKETS) -> np.ndarray:
    """The distinct hashed character n-grams of the words of host and path; the two parts do not mix.

    A word is what lies between dots, hyphens, slashes and the like, with marks at its ends.
    """
    found = set()
    for mark, part in (("h", host), ("p", path)):
        for word in _CUT.split(part):
            word = f"^{word}$"
            for n in GRAMS:
                found.update(zlib.crc32((mark + word[k : k + n]).encode()) % buckets for k in range(len(word) - n + 1))
    return np.fromiter(sorted(found), dtype=np.int64, count=len(found))


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def score(self, host: str, path: str) -> float:
        at = gram_buckets(host, path, len(self.weights))
        return self.bias + float(self.weights[at].sum())

    def probability(self, host: str, path: str) -> float:
        """P(block); 0.5 is the threshold that held-out hosts set."""
        return float(1 / (1 + np.exp(-self.score(host, path))))


def _fit(rows: list[np.ndarray], y: np.ndarray, buckets: int, l2: float, steps: int, rate: float) -> UrlModel:
    """Logistic regression, both kinds weighing the same in sum, by Adam on the whole table."""
    flat, owner = np.concatenate([*rows, np.zeros(0, np.int64)]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    used, column = np.unique(flat, return_inverse=True)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    theta, m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        score = np.bincount(owner, weights=theta[column], minlength=len(rows)) + theta[-1]
        error = (1 / (1 + np.exp(-np.clip(score, -50, 50))) - y) * share
        gradient = np.append(np.bincount(column, weights=error[owner], minlength=len(used)) + l2 * theta[:-1], error.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(buckets)
    weights[used] = theta[:-1]
    return UrlModel(weights, float(theta[-1]))


def site(host: str) -> str:
    """What tells sites apart in a table: the host without its usual first label and its last."""
    labels = [part for part in host.split(".") if part not in ("www", "m", "blog", "news", "shop", "en", "example")]
    return labels[0] if labels else ""


def held_out_scores(table: Sequence[tuple[str | None, int]], buckets: int = BUCKETS, l2: float = 2e-4, steps: int = 300, rate: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """The score of every row by a model that saw no row of its site, and the labels."""
    parts = [split_url(url) for url, _ in table]
    rows = [gram_buckets(*part, buckets) for part in parts]
    y = np.array([label for _, label in table], dtype=float)
    fold = np.array([zlib.crc32(site(host).encode()) % FOLDS for host, _ in parts])
    scores = np.zeros(len(table))
    for k in range(FOLDS):
        model = _fit([r for r, f in zip(rows, fold, strict=True) if f != k], y[fold != k], buckets, l2, steps, rate)
        for i in np.flatnonzero(fold == k):
            scores[i] = model.score(*parts[i])
    return scores, y


def train(table: Sequence[tuple[str | None, int]], buckets: int = BUCKETS, l2: float = 2e-4, steps: int = 300, rate: float = 0.02) -> UrlModel:
    """A model of the whole (small) table. Null URLs count as empty; a table of one kind, or an empty
    one, gives a model that leans to that kind or to allow.

    The threshold is the least score, 0 or above, at which models that did not see a row's site
    block no more than ``FALSE_BLOCKS`` of the allowed rows; the bias is shifted by it.
    """
    if not table:
        return UrlModel(np.zeros(buckets), -1.0)
    rows = [gram_buckets(*split_url(url), buckets) for url, _ in table]
    y = np.array([label for _, label in table], dtype=float)
    model = _fit(rows, y, buckets, l2, steps, rate)
    if 0 < y.sum() < len(y):
        scores, _ = held_out_scores(table, buckets, l2, steps, rate)
        allowed = np.sort(scores[y == 0])
        model.bias -= max(0.0, float(allowed[int(np.ceil(len(allowed) * (1 - FALSE_BLOCKS))) - 1]) + 1e-9)
    return model


def judge(pages: DataFrame, model: UrlModel, rules: Sequence[Rule] = (), page_id: str = "page_id", url: str = "url", threshold: float = 0.5) -> DataFrame:
    """One row per row of ``pages``: id, ``host``, ``path``, ``rule`` (null where none fits), ``verdict``, ``p_block``.

    A null URL, or one without ``://``, has an empty host and path and is judged by the model on
    those. Null ids stay, repeated rows are judged one by one, an empty table gives no rows and
    other columns are ignored.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    out = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("p_block", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [model.probability(h, q) for h, q in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], schema=out)

    judged = rows.mapInArrow(trimmed(work), "page_id long, host string, path string, p_block double").withColumn("found", rule_for(rules))
    verdict = F.coalesce("found.verdict", F.when(F.col("p_block") >= threshold, "block").otherwise("allow"))
    return judged.select(F.col("page_id").alias(page_id), "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "p_block")
