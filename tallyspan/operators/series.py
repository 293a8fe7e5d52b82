"""Figures of ordered value series: returns, volatility, drawdown, change, and scalar finance formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspan.operators.blocks import BLOCK, before, by_time, with_figures


def last_written(points: DataFrame, keys: list[str], position: str, *ties: str) -> DataFrame:
    """One row per key: the one written last; ``ties`` order rows of the same position, the highest wins."""
    rest = [c for c in points.columns if c not in keys]
    return points.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(position, *ties)).alias("__x")).select(*keys, "__x.*")


def _carried(points: DataFrame, series: str, at: str, value: str, characters: int) -> DataFrame:
    """The usable points with their block and, from the blocks before, ``__last`` value and ``__peak``."""
    held = points.where((F.col(value) > 0) & ~F.isnan(value) & (F.col(value) < float("inf"))).withColumn(BLOCK, by_time(at, characters))
    figures = held.groupBy(series, BLOCK).agg(F.max_by(value, at).alias("__end"), F.max(value).alias("__top"))
    earlier = before([series])
    figures = figures.select(series, BLOCK, F.last("__end").over(earlier).alias("__last"), F.max("__top").over(earlier).alias("__peak"))
    return with_figures(held, figures, [series])


def _change(series: str, at: str, value: str) -> Column:
    w = W.partitionBy(series, BLOCK).orderBy(at)
    return F.try_divide(F.col(value), F.coalesce(F.lag(value).over(w), "__last")) - 1


def returns(points: DataFrame, series: str, at: str, value: str, characters: int = 7) -> DataFrame:
    """Every point with the simple return since the one before; values that aren't positive numbers drop out.

    ``at`` is a date, a timestamp or ISO text; its first ``characters`` name the block of a point (see ``blocks``).
    """
    held = _carried(points, series, at, value, characters)
    return held.withColumn("change", _change(series, at, value)).drop(BLOCK, "__last", "__peak")


def risk_pack(points: DataFrame, series: str, at: str, value: str, periods: int, risk_free: float = 0.02, characters: int = 7) -> DataFrame:
    """Per series: points, total and annualised return, volatility, Sharpe ratio and maximum drawdown; error_code says why
    figures are missing. The peak so far is one window over the same blocks as the returns."""
    w = W.partitionBy(series, BLOCK).orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    marked = (
        _carried(points, series, at, value, characters)
        .withColumn("change", _change(series, at, value))
        .withColumn("__drop", F.col(value) / F.greatest("__peak", F.max(value).over(w)) - 1)
    )
    figures = marked.groupBy(series).agg(
        F.count("*").alias("points"),
        F.min_by(value, at).alias("__first"),
        F.max_by(value, at).alias("__last"),
        F.count("change").alias("__n"),
        F.product(1 + F.col("change")).alias("__growth"),
        F.stddev_samp("change").alias("__sd"),
        F.least(F.lit(0.0), F.min("__drop")).alias("max_drawdown"),
    )
    enough = F.col("points") >= 3
    annual = F.pow("__growth", periods / F.col("__n")) - 1
    volatility = F.col("__sd") * periods**0.5
    return figures.select(
        series,
        "points",
        F.when(enough, F.col("__last") / F.col("__first") - 1).alias("total_return"),
        F.when(enough, annual).alias("annualized_return"),
        F.when(enough, volatility).alias("annualized_volatility"),
        F.when(enough, F.try_divide(annual - risk_free, volatility)).alias("sharpe"),
        F.when(enough, F.col("max_drawdown")).alias("max_drawdown"),
        F.when(~enough, "market_history_unavailable").when(F.col("__sd") == 0, "division_by_zero").alias("error_code"),
    )


def latest_change(points: DataFrame, series: str, at: str, value: str) -> DataFrame:
    """Latest and previous value and their difference per series."""
    w = W.partitionBy(series).orderBy(F.desc(at))
    recent = points.where(F.col(value).isNotNull()).withColumn("__r", F.row_number().over(w)).where("__r <= 2")
    return recent.groupBy(series).agg(
        F.max(F.when(F.col("__r") == 1, F.col(value))).alias("latest"),
        F.max(F.when(F.col("__r") == 2, F.col(value))).alias("previous"),
    ).withColumn("difference", F.col("latest") - F.col("previous"))


def cagr(begin: Column, end: Column, years: Column) -> Column:
    return F.when((begin > 0) & (end >= 0) & (years > 0) & (years <= 1e6), F.pow(end / begin, 1 / years) - 1)


def future_value(present: Column, rate: Column, periods: Column) -> Column:
    return F.when((rate > -1) & periods.between(0, 1e6), present * F.pow(1 + rate, periods))


def present_value(future: Column, rate: Column, periods: Column) -> Column:
    return F.when((rate > -1) & periods.between(0, 1e6), future / F.pow(1 + rate, periods))


def loan_payment(principal: Column, rate: Column, periods: Column) -> Column:
    growth = F.pow(1 + rate, periods)
    return F.when(rate == 0, principal / periods).otherwise(principal * rate * growth / (growth - 1))
