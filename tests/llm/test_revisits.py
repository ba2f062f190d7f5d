import random

import pytest
from pyspark.sql import functions as F

from orrery.llm import revisits

SCHEMA = "record_id long, url string, date long, status int, headers map<string,string>, canonical string, slice int"


def records(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def resolved(spark, rows):
    return {r["record_id"]: r for r in revisits.resolve(records(spark, rows)).collect()}


def test_merging_and_validators(spark):
    rows = [
        (1, "http://www.A.com/x/?b=2&a=1&utm_source=q#f", 10, 200, {"ETag": '"v1"', "Content-Type": "text/html", "Cache-Control": "old"}),
        (2, "https://a.com/x?a=1&b=2", 20, 304, {"etag": 'W/"v1"', "cache-control": "new", "Content-Type": "lie", "set-cookie": "z"}),
        (3, "http://a.com:80/x?a=1&b=2", 20, 200, {"ETag": '"v2"', "Last-Modified": "mon"}),
        (4, "http://a.com/x?a=1&b=2", 21, 304, {"etag": '"v1"'}),
        (5, "http://a.com/x?a=1&b=2", 22, 304, {"last-modified": "mon"}),
        (6, "http://a.com/x?a=1&b=2", 23, 304, {"date": "d"}),
        (7, "http://a.com/other", 30, 304, {"etag": '"v1"'}),
        (8, "http://a.com/x?a=1&b=2", 9, 304, {"etag": '"v1"'}),
        (9, "http://a.com/x", 40, 404, None),
        (10, None, 41, 304, {"etag": "x"}),
        (11, "http://a.com/x?a=1&b=2", None, 304, {"etag": "x"}),
        (12, "http://a.com/x?a=1&b=2", None, 200, {}),
    ]
    got = resolved(spark, rows)
    verdicts = {k: r["verdict"] for k, r in got.items()}
    assert verdicts == {
        1: "response", 2: "resolved", 3: "response", 4: "validator_mismatch", 5: "resolved", 6: "no_validator", 7: "no_earlier_response",
        8: "no_earlier_response", 9: "other", 10: "no_earlier_response", 11: "no_earlier_response", 12: "response",
    }
    assert got[2]["refers_to"] == 1 and got[5]["refers_to"] == 3 and got[4]["refers_to"] == 3
    assert got[2]["headers"] == {"etag": 'W/"v1"', "content-type": "text/html", "cache-control": "new"}
    assert got[5]["headers"] == {"etag": '"v2"', "last-modified": "mon"}
    assert got[2]["canonical"] == got[1]["canonical"] == "a.com/x?a=1&b=2"


@pytest.mark.parametrize("slices", [1, 3, 1000])
def test_hot_url_against_brute_force(spark, monkeypatch, slices):
    monkeypatch.setattr(revisits, "SLICES", slices)
    pick = random.Random(slices)
    rows = [(k, pick.choice(["http://hot/", "http://hot/", "http://cold/"]), pick.randint(0, 60), pick.choice([200, 304, 304]), {"etag": pick.choice("ab")}) for k in range(300)]
    got = resolved(spark, rows)
    for key, url, date, status, headers in rows:
        if status != 304:
            continue
        earlier = [(d, k, h) for k, u, d, s, h in rows if u == url and s == 200 and d < date]
        best = max(earlier, key=lambda e: e[:2], default=None)
        assert got[key]["refers_to"] == (best and best[1])
        expected = "no_earlier_response" if best is None else "resolved" if best[2] == headers else "validator_mismatch"
        assert got[key]["verdict"] == expected


def test_empty_and_repeated(spark):
    assert revisits.resolve(records(spark, []).limit(0)).count() == 0
    row = (1, "http://a/", 5, 304, {"etag": "x"})
    assert revisits.resolve(records(spark, [row, row])).count() == 2


def test_every_verdict_occurs(spark):
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), (F.col("id") % 250).cast("string")).alias("url"), F.lit("x").alias("html"))
    found = {r["verdict"] for r in revisits.resolve(revisits.records_of(pages)).select("verdict").distinct().collect()}
    assert found == {"response", "resolved", "validator_mismatch", "no_validator", "no_earlier_response"}
