"""Resolving not-modified revisit records of web captures (operator 3).

A revisit (status 304) says that a resource is unchanged. It is resolved by an as-of join on the
canonical URL to the latest full response that is strictly earlier, if the validators agree, and
the headers that a 304 may update are merged into those of the response.

One URL may hold a third of all records, so its timeline is cut into slices. A window runs
inside each (URL, slice), and the last response before a slice is carried in by a second window
over one row per slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.staging import Stages

#: Header fields that a 304 response updates (HTTP semantics).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not name a resource.
TRACKING = r"^(utm_[a-z]+|fbclid|gclid|sessionid|phpsessid)(=|$)"
SLICES = 4096


def canonical_url(url: Column) -> Column:
    """Scheme and fragment off, host in lower case without ``www.`` and default port, tracking
    parameters dropped and the others sorted, no trailing slash. A null URL stays null."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    place = F.regexp_extract(bare, r"^([^?]*)", 1)
    host = F.regexp_replace(F.lower(F.regexp_extract(place, r"^([^/]*)", 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(place, r"^[^/]*(.*)$", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _lowered(headers: Column) -> Column:
    """Header names in lower case; of names that then clash the last one stays; null is empty."""
    entries = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: e["key"] == n), -1)["value"]))


def _verdict(own: Column, full: Column) -> Column:
    """Entity tags decide by weak comparison; without one in the revisit, the modification date does."""
    tag, theirs = F.element_at(own, "etag"), F.element_at(full["headers"], "etag")
    bare = lambda c: F.regexp_replace(c, "^W/", "")
    date, their_date = F.element_at(own, "last-modified"), F.element_at(full["headers"], "last-modified")
    agree = lambda a, b: F.when(a.eqNullSafe(b), "resolved").otherwise("validator_mismatch")
    return (
        F.when(full.isNull(), "no_earlier_response")
        .when(tag.isNotNull(), agree(bare(tag), bare(theirs)))
        .when(date.isNotNull(), agree(date, their_date))
        .otherwise("no_validator")
    )


def resolve(records: DataFrame, record_id: str = "record_id", url: str = "url", date: str = "date", status: str = "status", headers: str = "headers") -> DataFrame:
    """One row per record: ``record_id``, ``canonical``, ``date``, ``status``, ``verdict``, ``refers_to``,
    ``headers``.

    ``verdict`` is ``response`` (status 200), ``resolved``, ``validator_mismatch``, ``no_validator``,
    ``no_earlier_response``, or ``other`` (any other status). ``refers_to`` is the id of the latest
    strictly earlier response; of several at one date the greatest id. ``headers`` are lower-cased,
    and for a resolved revisit those of the response updated by the permitted ones of the revisit.
    ``date`` is a number. A record without URL or date is never joined; repeated records are each
    resolved; an empty table gives no rows; other columns are ignored.
    """
    stages = Stages(records.sparkSession, "revisits")
    rows = records.select(
        F.col(record_id).cast("long").alias("record_id"), canonical_url(F.col(url)).alias("canonical"), F.col(date).cast("long").alias("date"),
        F.col(status).cast("int").alias("status"), _lowered(F.col(headers)).alias("headers"),
    )
    rows = stages.save(rows, "records")
    low, high = rows.agg(F.min("date"), F.max("date")).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // SLICES))
    joinable = F.col("canonical").isNotNull() & F.col("date").isNotNull()
    live = rows.where(joinable).withColumn("slice", F.floor((F.col("date") - F.lit(low or 0)) / width).cast("long"))
    full = F.when(F.col("status") == 200, F.struct("record_id", "headers"))
    live = live.withColumn("full", full)

    touched = live.groupBy("canonical", "slice").agg(F.max_by("full", F.when(F.col("full").isNotNull(), F.struct("date", "record_id"))).alias("last"))
    ahead = Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = touched.select("canonical", "slice", F.last("last", ignorenulls=True).over(ahead).alias("carry"))

    # A revisit sorts before the responses of its date, which are not earlier than it.
    order = Window.partitionBy("canonical", "slice").orderBy("date", F.col("full").isNotNull(), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    live = live.withColumn("near", F.last("full", ignorenulls=True).over(order)).join(carried, ["canonical", "slice"], "left")
    source = F.coalesce("near", "carry")
    verdict = F.when(F.col("status") == 200, "response").when(F.col("status") == 304, _verdict(F.col("headers"), source)).otherwise("other")
    live = live.withColumn("source", source).withColumn("verdict", verdict)
    permitted = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    untouched = F.map_filter(F.col("source.headers"), lambda k, _: ~F.map_contains_key(permitted, k))
    merged = F.when(F.col("verdict") == "resolved", F.map_concat(untouched, permitted)).otherwise(F.col("headers"))
    refers = F.when(F.col("status") == 304, F.col("source.record_id"))
    live = live.select("record_id", "canonical", "date", "status", "verdict", refers.alias("refers_to"), merged.alias("headers"))
    loose = F.when(F.col("status") == 200, "response").when(F.col("status") == 304, "no_earlier_response").otherwise("other")
    rest = rows.where(~joinable).select("record_id", "canonical", "date", "status", loose.alias("verdict"), F.lit(None).cast("long").alias("refers_to"), "headers")
    return live.unionByName(rest)


def records_of(pages: DataFrame) -> DataFrame:
    """Capture records of a table of pages: each page's response and a later revisit of it.

    Some revisits carry a stale tag, some only a date, some no validator, and some pages have no
    response of their own, so that every verdict occurs.
    """
    day = 86_400_000_000
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    seen, modified = F.col("page_id") * 60_000_000, F.concat(F.lit("day "), (F.col("page_id") % 365).cast("string"))
    response = F.struct(
        (F.col("page_id") * 2).alias("record_id"), F.col("url"), seen.alias("date"), F.lit(200).alias("status"),
        F.map_filter(F.create_map(
            F.lit("ETag"), F.when(F.col("page_id") % 7 != 0, tag), F.lit("Last-Modified"), modified, F.lit("Content-Type"), F.lit("text/html"),
            F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Date"), seen.cast("string")), lambda _, v: v.isNotNull()).alias("headers"),
    )
    later = seen + 30 * day
    revisit = F.struct(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.concat(F.col("url"), F.lit("#again")).alias("url"), later.alias("date"), F.lit(304).alias("status"),
        F.map_filter(F.create_map(
            F.lit("etag"), F.when(F.col("page_id") % 10 == 3, F.lit('"stale"')).when((F.col("page_id") % 7 != 0) & (F.col("page_id") % 11 != 0), F.concat(F.lit("W/"), tag)),
            F.lit("last-modified"), F.when(F.col("page_id") % 11 != 0, modified), F.lit("set-cookie"), F.lit("a=1"),
            F.lit("cache-control"), F.lit("max-age=600"), F.lit("date"), later.cast("string")), lambda _, v: v.isNotNull()).alias("headers"),
    )
    both = F.when(F.col("page_id") % 13 == 0, F.array(revisit)).otherwise(F.array(response, revisit))
    return pages.select(F.explode(both).alias("r")).select("r.*")


def as_rows(resolved: DataFrame) -> DataFrame:
    """A form that any engine can compare: headers as sorted ``name: value`` lines, and -1 for no response."""
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return resolved.withColumn("headers", lines).withColumn("refers_to", F.coalesce("refers_to", F.lit(-1).cast("long")))


ORACLE_SQL = r"""
WITH rec AS (
  SELECT page_id * 2 AS record_id, url, page_id * 60000000 AS date, 200 AS status,
         CASE WHEN page_id % 7 <> 0 THEN '"' || md5(coalesce(html, '')) || '"' END AS etag,
         'day ' || (page_id % 365) AS modified
  FROM pages WHERE page_id % 13 <> 0
  UNION ALL
  SELECT page_id * 2 + 1, url || '#again', page_id * 60000000 + 2592000000000, 304,
         CASE WHEN page_id % 10 = 3 THEN '"stale"' WHEN page_id % 7 <> 0 AND page_id % 11 <> 0 THEN 'W/"' || md5(coalesce(html, '')) || '"' END,
         CASE WHEN page_id % 11 <> 0 THEN 'day ' || (page_id % 365) END
  FROM pages),
bare AS (
  SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b FROM rec),
parts AS (
  SELECT *, regexp_replace(lower(regexp_extract(regexp_extract(b, '^([^?]*)', 1), '^([^/]*)', 1)), '^www\.|:(80|443)$', '', 'g') AS host,
         regexp_replace(regexp_extract(regexp_extract(b, '^([^?]*)', 1), '^[^/]*(.*)$', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(b, '^[^?]*\?(.*)$', 1), '&'),
           lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[a-z]+|fbclid|gclid|sessionid|phpsessid)(=|$)'))) AS kept
  FROM bare),
named AS (
  SELECT record_id, date, status, etag, modified,
         host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical FROM parts),
joined AS (
  SELECT *, last_value(CASE WHEN status = 200 THEN {'id': record_id, 'etag': etag, 'modified': modified} END IGNORE NULLS)
         OVER (PARTITION BY canonical ORDER BY date, status = 200, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f
  FROM named),
judged AS (
  SELECT *, CASE WHEN status = 200 THEN 'response' WHEN f IS NULL OR canonical IS NULL OR date IS NULL THEN 'no_earlier_response'
                 WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') IS NOT DISTINCT FROM f.etag THEN 'resolved' ELSE 'validator_mismatch' END
                 WHEN modified IS NOT NULL THEN CASE WHEN modified IS NOT DISTINCT FROM f.modified THEN 'resolved' ELSE 'validator_mismatch' END
                 ELSE 'no_validator' END AS verdict
  FROM joined)
SELECT record_id, canonical, date, status, verdict, coalesce(CASE WHEN status = 304 AND canonical IS NOT NULL AND date IS NOT NULL THEN f.id END, -1) AS refers_to,
       concat_ws(chr(10),
         CASE WHEN status = 200 THEN 'cache-control: max-age=60' ELSE 'cache-control: max-age=600' END,
         CASE WHEN status = 200 OR verdict = 'resolved' THEN 'content-type: text/html' END,
         'date: ' || date,
         'etag: ' || CASE WHEN verdict = 'resolved' THEN coalesce(etag, f.etag) ELSE etag END,
         'last-modified: ' || CASE WHEN verdict = 'resolved' THEN coalesce(modified, f.modified) ELSE modified END,
         CASE WHEN status = 304 AND verdict <> 'resolved' THEN 'set-cookie: a=1' END) AS headers
FROM judged
"""
