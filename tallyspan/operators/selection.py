"""Choosing evidence under a budget: ordering, round-robin interleaving and greedy fill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspan.session import cut


def interleave(items: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """The first k items taken in passes: one of each group per pass, groups by name; place counts from 1."""
    in_group = F.row_number().over(W.partitionBy(group).orderBy(*order))
    best = items.withColumn("pass", in_group).where(F.col("pass") <= k).orderBy("pass", group).limit(k)
    return best.withColumn("place", F.row_number().over(W.orderBy("pass", group)))  # k rows


def greedy_fill(items: DataFrame, budget: float, cost: str, place: str) -> DataFrame:
    """Items in order of ``place`` (distinct numbers), each taken if it still fits the budget and skipped if not.

    Done in rounds: of the rows after the last overflow that are not costlier than what is left, all up to the first one
    that overflows are taken. Running costs are summed inside ranges of places with one figure per range before. A round
    takes at least one row, so there are no more rounds than rows taken; the driver holds three numbers of each.
    """
    rows = cut(items)
    slim = rows.select(F.col(place).alias("__place"), F.col(cost).cast("double").alias("__cost")).where(F.col("__cost") <= budget)
    slim = cut(slim.repartitionByRange("__place").sortWithinPartitions("__place").withColumn("__range", F.spark_partition_id()))
    left, after, rounds = float(budget), None, []
    while True:
        fit = slim.where(F.col("__cost") <= left)
        fit = fit if after is None else fit.where(F.col("__place") > after)
        sums = fit.groupBy("__range").agg(F.sum("__cost").alias("__sum"))
        ahead = F.sum("__sum").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1))  # a row per range
        sums = sums.select("__range", F.coalesce(ahead, F.lit(0.0)).alias("__ahead"))
        running = F.sum("__cost").over(W.partitionBy("__range").orderBy("__place").rowsBetween(W.unboundedPreceding, 0))
        summed = fit.withColumn("__in", running).join(F.broadcast(sums), "__range").withColumn("__used", F.col("__ahead") + F.col("__in"))
        over = F.col("__used") > left
        first, used = summed.agg(F.min(F.when(over, F.col("__place"))), F.max(F.when(~over, F.col("__used")))).first()
        if used is None:
            break
        rounds.append((after, first, left))
        if first is None:
            break
        left, after = left - used, first
    kind = rows.schema[place].dataType.simpleString()
    taken = rows.sparkSession.createDataFrame(rounds, f"__after {kind}, __stop {kind}, __most double")
    at = F.col(place)
    inside = (F.col("__after").isNull() | (at > F.col("__after"))) & (F.col("__stop").isNull() | (at < F.col("__stop")))
    return rows.join(F.broadcast(taken), inside & (F.col(cost).cast("double") <= F.col("__most")), "left_semi")
