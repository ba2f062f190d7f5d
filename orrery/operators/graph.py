"""Graph operators on edge tables (G1-G5): connected components and what rests on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.staging import Stages

#: Up to this many edges (16 bytes each) one task joins them up; more are joined up by rounds over all tasks.
FEW_EDGES = 200_000
#: Edges that a task holds when it joins up its own.
CHUNK_EDGES = 1 << 20


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a[i], b[i]), ascending, and each one's smallest reachable node.

    Every node's label falls to the least among its neighbours' until nothing changes; labels of
    labels are followed in between, so long chains need few turns.
    """
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label, left, right = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while True:
        low = np.minimum(label[left], label[right])
        fresh = label.copy()
        for ends in (left, right, label[left], label[right]):
            np.minimum.at(fresh, ends, low)
        while not np.array_equal(fresh, fresh[fresh]):
            fresh = fresh[fresh]
        if np.array_equal(fresh, label):
            return nodes, nodes[label]
        label = fresh


def _joined_up(edges: DataFrame, at_once: int) -> DataFrame:
    """Every node of some edges (a, b), and its least reachable one, for ``at_once`` edges of a task at a time.
    Taken as edges again, the rows have the same components and are no more than nodes in each task."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= at_once:
                yield joined(held)
                held, n = [], 0
        if n:
            yield joined(held)

    def joined(held: list) -> pa.RecordBatch:
        found = least_reachable(*(np.concatenate(side) for side in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in found], schema=schema)

    return edges.mapInArrow(work, "a long, b long")


def components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge table.

    Returns one row per node that occurs in an edge: ``node``, ``component`` (its smallest
    reachable node). Rows with a null end are ignored, a self-loop is a component of its own,
    repeated edges count once, and an empty table gives an empty result. Other columns are
    ignored. Tasks join up their own edges first. If at most ``FEW_EDGES`` are left, one task joins
    those up. More alternate large-star and small-star steps, whose number is logarithmic in practice; every step's minima
    and every round are cut into stage tables, so a lost executor costs one round at most, and a
    hub's edges meet its minimum in a join whose skewed side Spark can split.
    """
    spark = edges.sparkSession
    stages = Stages(spark, "components")
    pairs = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).na.drop()
    pairs, left = stages.save_counted(_joined_up(pairs, CHUNK_EDGES), "pairs")
    if left <= FEW_EDGES:
        return _joined_up(pairs.coalesce(1), FEW_EDGES + 1).toDF("node", "component")
    links = stages.save(pairs.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        # Large star: the greater neighbours of a node link to the least of the node and its neighbours.
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stages.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = stages.save(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # Small star: a node and its smaller neighbours link to the least of those.
        least_small = stages.save(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least_small, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        )
        small = small.select("e.u", "e.v").where("u <> v").distinct()
        before, links = links, stages.save(small, "links")
        stages.drop(before, least, large, least_small)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    # Every node but a component's least one is now linked to that one alone.
    loops = pairs.where("a = b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    rows = links.union(loops).union(links.select(F.col("v").alias("u"), "v"))
    return rows.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")


def instance_clusters(members: DataFrame, instance: str, element: list[str]) -> DataFrame:
    """Components of instances that share an element; instances alone are their own.

    ``members`` may be eroded: it decides on the edges. Returns instance, component.
    """
    # Consecutive holders of an element link all of them, in place of every pair.
    low = members.groupBy(*element).agg(F.min(instance).alias("low"))
    edges = members.join(low, element).select(F.col(instance).alias("src"), F.col("low").alias("dst")).distinct()
    return components(edges).withColumnRenamed("node", instance)


def density_clusters(points: DataFrame, key: str, axes: tuple[str, ...], radius, on: tuple[str, ...] = ()) -> DataFrame:
    """Density clustering with two points as the least: components of the radius graph.

    Points without a neighbour are isolated and have no row. Returns node, component.
    """
    from orrery.operators.joins import radius_join

    return components(radius_join(points, key, axes, radius, on), "a", "b")


def face_clusters(faces: DataFrame, vertices: DataFrame, axes: tuple[str, ...], radius, on: tuple[str, ...] = ()) -> DataFrame:
    """Faces (face_id, v0, v1, v2) linked when any of their vertices share a cluster.

    Returns face_id, component, named by the smallest vertex. A face's own vertices link too.
    """
    corners = faces.select("face_id", F.explode(F.array("v0", "v1", "v2")).alias("vertex_id"))
    near = density_clusters(vertices, "vertex_id", axes, radius, on).select(F.col("node").alias("src"), F.col("component").alias("dst"))
    own = faces.select(F.explode(F.array(F.struct(F.col("v0").alias("src"), F.col("v1").alias("dst")), F.struct(F.col("v0").alias("src"), F.col("v2").alias("dst")))).alias("e"))
    linked = components(near.unionByName(own.select("e.src", "e.dst"))).withColumnRenamed("node", "vertex_id")
    return corners.join(linked, "vertex_id").groupBy("face_id").agg(F.min("component").alias("component"))
