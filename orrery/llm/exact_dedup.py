"""Exact deduplication by skew-safe combining (operator 2), in DataFrame functions only.

1. *Local*: the partial side of the aggregate merges equal contents inside each map task.
2. *Salted*: what is left is grouped by (digest, salt, content). Only heavy digests, of which
   there can be few, are salted, so a hot content is merged by many tasks and every other
   content is final after this one exchange.
3. *Global*: the winners of the salts, a handful of rows for each heavy content, are grouped by
   (digest, content).

Contents are grouping keys at each stage, so equal digests alone never merge two texts. The
decision is then joined back to the rows by digest where a digest has one content, and by
the content itself where it has several.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.rows import ROW, with_row_key
from orrery.staging import Stages

#: Code points that a comparison ignores.
SPACE = r"[\x20\x09-\x0D]+"
#: A digest is heavy from this share of all rows; at most 1 / HEAVY_SHARE digests can be.
HEAVY_SHARE = 1e-3
HEAVY_ROWS = 256
SALTS = 64


def sha256(content: Column) -> Column:
    """SHA-256 of the content in UTF-8, 32 bytes."""
    return F.unhex(F.sha2(content, 256))


def _best(size: Column, key: Column) -> Column:
    """One number per row that orders by size, then by smallest key. A decimal is a fixed-width
    aggregation buffer, which keeps the grouping by text a hash aggregate."""
    key_rank = F.lit(2**63 - 1).cast("decimal(20,0)") - key.cast("decimal(20,0)")
    return (size.cast("decimal(11,0)") * F.lit("100000000000000000000").cast("decimal(21,0)") + key_rank).cast("decimal(38,0)")


def _key_of(best: Column) -> Column:
    return (F.lit(2**63 - 1).cast("decimal(20,0)") - (best % F.lit("100000000000000000000").cast("decimal(21,0)"))).cast("long")


def _combine(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max("best").alias("best"), F.sum("n").alias("n"))


def decide(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``digest``, ``size``, row key.

    Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``; of equal texts the row with
    the most code points, then the smallest id stays, and no other: of rows that repeat an id, or
    have none, one stays. A null text equals an empty one. A null id orders last, is never a
    reason to drop a row, and ``keep_id`` is null where such a row stays. Empty tables give no
    rows; other columns are ignored. ``digest`` may be any function of the content: a weak one
    only makes more rows compare by content.
    """
    stages = Stages(docs.sparkSession, "dedup")
    keyed, unique = with_row_key(docs, doc_id, stages)
    return _decide(keyed, unique, doc_id, text, digest, stages)


def _decide(docs: DataFrame, unique: bool, doc_id: str, text: str, digest: Callable[[Column], Column], stages: Stages) -> DataFrame:
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(ROW).alias("row"), F.regexp_replace(raw, SPACE, "").alias("content"), F.length(raw).alias("size"))
    rows = rows.withColumn("digest", digest(F.col("content")))
    slim, total = stages.save_counted(rows.select("row", "digest", "size"), "rows")

    heavy = slim.groupBy("digest").count().where(F.col("count") >= max(HEAVY_ROWS, int(total * HEAVY_SHARE))).select("digest")
    heavy = stages.save(heavy, "heavy")  # at most min(1 / HEAVY_SHARE, total / HEAVY_ROWS) rows

    best = _best(F.col("size"), F.col("row")).alias("best")
    counted = rows.select("digest", "content", best, F.lit(1).cast("long").alias("n"))
    counted = counted.join(F.broadcast(heavy.withColumn("hot", F.lit(True))), "digest", "left").withColumn(
        "salt", F.when(F.col("hot"), F.spark_partition_id() % SALTS).otherwise(F.lit(-1))
    )
    salted = _combine(counted, "digest", "salt", "content").withColumn("content", F.when(F.col("salt") >= 0, F.col("content")))
    salted = stages.save(salted, "salted")

    hot = _combine(salted.where("salt >= 0"), "digest", "content").select("digest", "best", "n")
    winners = salted.where("salt < 0").select("digest", "best", "n").unionByName(hot)
    winners = stages.save(winners, "winners")
    stages.drop(salted)
    mixed = winners.groupBy("digest").count().where("count > 1").select("digest")
    # A heavy digest's rows stay where they are and meet its winner, one row, by broadcast.
    few = winners.join(F.broadcast(heavy), "digest", "left_semi")
    if mixed.isEmpty():
        merged = slim.join(F.broadcast(few), "digest").unionByName(slim.join(F.broadcast(heavy), "digest", "left_anti").join(winners, "digest"))
    else:
        mixed = stages.save(mixed, "mixed")
        plain = slim.join(mixed, "digest", "left_anti").join(winners, "digest")
        shared = rows.join(mixed, "digest", "left_semi")
        by_content = _combine(shared.select("content", best, F.lit(1).alias("n")), "content")
        merged = plain.unionByName(shared.join(by_content, "content").select(plain.columns))
    merged = merged.select("row", _key_of(F.col("best")).alias("winner"), F.col("n").alias("group_size"), "digest", "size")
    kept = (F.col("row") == F.col("winner")).alias("kept")
    if unique:
        return merged.select(F.col("row").alias("doc_id"), F.col("winner").alias("keep_id"), "group_size", kept, "digest", "size", F.col("row").alias(ROW))
    names = docs.select(F.col(ROW).alias("row"), F.col(doc_id).cast("long").alias("doc_id"))
    named = merged.join(names, "row").join(names.select(F.col("row").alias("winner"), F.col("doc_id").alias("keep_id")), "winner")
    return named.select("doc_id", "keep_id", "group_size", kept, "digest", "size", F.col("row").alias(ROW))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`decide` keeps: one row of each group, whatever its id."""
    stages = Stages(docs.sparkSession, "dedup")
    keyed, unique = with_row_key(docs, doc_id, stages)
    gone = _decide(keyed, unique, doc_id, text, sha256, stages).where("not kept").select(F.col(ROW).alias("__gone"))
    return keyed.join(gone, F.col(ROW) == F.col("__gone"), "left_anti").select(*docs.columns)


def as_contract(decided: DataFrame) -> DataFrame:
    return decided.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY content) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(content) AS text_sha256
FROM texts
WINDOW w AS (PARTITION BY content ORDER BY length(body) DESC, doc_id)
"""
