"""Voting: majority, weighted and multi-round arg-max over long vote tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def winner(scores: DataFrame, keys: list[str], value: str, score: str) -> DataFrame:
    """Per key, the value of the greatest score; ties go to the smallest value."""
    return scores.groupBy(*keys).agg(F.max_by(value, F.struct(F.col(score), -F.col(value))).alias(value))


def majority(votes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A1: the most frequent value per key. Two combinable aggregates, so a hot key costs little."""
    counts = votes.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    return winner(counts, keys, value, "__n")


def scores(votes: DataFrame, keys: list[str], value: str, weight: Column, add: Callable[[Column], Column] = F.sum) -> DataFrame:
    """A2: keys, value, score: the sum of weights."""
    return votes.groupBy(*keys, value).agg(add(weight).alias("score"))


def weighted(votes: DataFrame, keys: list[str], value: str, weight: Column, add: Callable[[Column], Column] = F.sum) -> DataFrame:
    """A2: the value of the greatest weight per key."""
    return winner(scores(votes, keys, value, weight, add), keys, value, "score")


def ordered_sum(weight: Column) -> Column:
    """The sum of weights from the greatest down, so that it does not depend on the order of rows as that of fractions does.

    It gathers the weights of a group, which must be few, as those of a face are: one for each panorama at most.
    """
    held = F.sort_array(F.collect_list(weight), asc=False)
    return F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda total, w: total + w))


def background_scores(cover: DataFrame, hits: DataFrame, detections: DataFrame, ratio: float = 0.65) -> DataFrame:
    """A3: (pano, r, c, score) of the background: each of a frame's n detections that does not hit a
    pixel the frame covers adds ratio / n. n counts every detection of the frame."""
    n = detections.groupBy("pano", "frame").agg(F.count("*").alias("n"))
    hit = hits.groupBy("pano", "frame", "r", "c").agg(F.count("*").alias("hits"))
    seen = cover.join(n, ["pano", "frame"]).join(hit, ["pano", "frame", "r", "c"], "left")
    share = (F.col("n") - F.coalesce("hits", F.lit(0))) * ratio / F.col("n")
    return seen.groupBy("pano", "r", "c").agg(F.sum(share).alias("score"))


def inverse_distance(votes: DataFrame, keys: list[str], distance: str) -> Column:
    """The weight sum(distance) / distance over all votes of a key."""
    return F.sum(distance).over(Window.partitionBy(*keys)) / F.col(distance)


def survivors(members: DataFrame, winners: DataFrame, keys: list[str], instance: list[str], value: str, share: float) -> DataFrame:
    """A4/A5: instances whose elements agree with the element's winner often enough.

    ``members`` has (instance..., keys..., value); an element without a winner does not agree.
    Returns instance..., agreement.
    """
    won = winners.select(*keys, F.col(value).alias("__won"))
    agree = F.coalesce((F.col("__won") == F.col(value)).cast("int"), F.lit(0))
    rates = members.join(won, keys, "left").groupBy(*instance).agg(F.avg(agree).alias("agreement"))
    return rates.where(F.col("agreement") >= share)


def three_rounds(votes: DataFrame, face: str, instance: str, value: str, weight: Column | str, share: float = 0.65, add: Callable[[Column], Column] = F.sum) -> DataFrame:
    """Winners of all votes; instances that agree with them; winners of those instances' votes.

    ``value`` 0 is background and belongs to instance 0 of its face table; background votes count
    in the last round only if the background as a whole survives. A face without votes has no row.
    """
    weight = F.col(weight) if isinstance(weight, str) else weight
    weighed = votes.withColumn("__w", weight).withColumn("__i", F.when(F.col(value) == 0, F.lit(0)).otherwise(F.col(instance)))
    first = weighted(weighed, [face], value, F.col("__w"), add)
    # The background is one instance with votes for any number of faces: its class and verdict are a row that goes to all
    # tasks, so that its votes stay where they are.
    last = _third_round(weighed.where("__i <> 0"), first, face, value, share, lambda rows: rows)
    last = last.unionByName(_third_round(weighed.where("__i = 0"), first, face, value, share, F.broadcast))
    return weighted(last, [face], value, F.col("__w"), add)


def _third_round(votes: DataFrame, first: DataFrame, face: str, value: str, share: float, sent: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The votes of instances that agree with the winners of the first round."""
    # An instance's class is the vote of its first face.
    label = votes.groupBy("__i").agg(F.min_by(value, F.struct(F.col(face), F.col(value))).alias(value))
    members = votes.select("__i", face).distinct().join(sent(label), "__i")
    kept = survivors(members, first, [face], ["__i"], value, share).select("__i")
    return votes.join(sent(kept), "__i", "left_semi")


def face_instance(votes: DataFrame, winners: DataFrame, keys: list[str], instance: str, value: str) -> DataFrame:
    """Per key, the most frequent instance among the votes of the key's winning class; 0 does not count."""
    fitting = votes.where(F.col(instance) != 0).join(winners.select(*keys, F.col(value).alias("__won")), keys)
    return majority(fitting.where(F.col(value) == F.col("__won")), keys, instance)
