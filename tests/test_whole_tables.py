"""The queries over all order lines, whatever their quantity, against brute force."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from orrery.plans import catalogue


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    pick = random.Random(4)
    # One order with many parts, a long chain of orders and some lines alone: one large component and small ones.
    lines = [(0, pick.randrange(40), pick.randrange(5)) for _ in range(60)] + [(1 + k, 40 + k + d, k % 5) for k in range(50) for d in (0, 1)]
    lines += [(100 + k, 200 + k // 2, 7) for k in range(20)] + [(300, 39, 6), (300, 40, 6)]
    path = str(tmp_path_factory.mktemp("lines"))
    rows = [(o, p, s, float(pick.randrange(1, 51))) for o, p, s in lines]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{path}/lineitem.parquet")
    return path, lines


def found(spark, tables, name):
    return sorted(map(tuple, catalogue.QUERIES[name](spark, tables[0]).collect()))


def test_components(spark, tables):
    above = {}

    def top(k):
        while above.setdefault(k, k) != k:
            k = above[k]
        return k

    orders = defaultdict(list)
    for o, p, _ in tables[1]:
        orders[o].append(p)
        a, b = sorted((top(p), top(orders[o][0])))
        above[b] = a
    want = sorted((p, top(p)) for p in list(above))
    assert Counter(c for _, c in want).most_common(1)[0][1] > 60
    assert found(spark, tables, "components") == want


def test_edges_lists_and_positions(spark, tables):
    orders, lists, last = defaultdict(set), defaultdict(list), {}
    for o, p, s in tables[1]:
        orders[o].add(p)
        lists[s].append(p)
        last[p] = max(s, last.get(p, s))
    edges = Counter(pair for parts in orders.values() for pair in combinations(sorted(parts), 2))
    assert found(spark, tables, "cooccurrence_edges") == sorted((*pair, n) for pair, n in edges.items())
    assert found(spark, tables, "group_lists") == sorted((s, ",".join(map(str, sorted(parts)))) for s, parts in lists.items())
    assert found(spark, tables, "densify_faces") == [(p, last.get(p, 0)) for p in range(max(last) + 1)]
