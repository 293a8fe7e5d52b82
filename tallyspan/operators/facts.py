"""Facts (entity, period, field, value, unit): ratios, conflicts, uniqueness and the latest of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Ratio, numerator, denominator.
RATIOS = [
    ("net_margin", "net_income", "revenue"),
    ("gross_margin", "gross_profit", "revenue"),
    ("operating_margin", "operating_income", "revenue"),
    ("liabilities_to_assets", "total_liabilities", "total_assets"),
    ("debt_to_equity", "total_liabilities", "stockholders_equity"),
    ("equity_to_assets", "stockholders_equity", "total_assets"),
    ("cash_to_assets", "cash_and_cash_equivalents", "total_assets"),
    ("current_ratio", "current_assets", "current_liabilities"),
]
KEYS = ["entity", "period"]


def unique_facts(facts: DataFrame) -> DataFrame:
    """Facts whose rows all hold one value and unit."""
    return (
        facts.groupBy(*KEYS, "field")
        .agg(F.min(F.struct("value", "unit")).alias("__a"), F.max(F.struct("value", "unit")).alias("__b"))
        .where(F.col("__a") == F.col("__b"))
        .select(*KEYS, "field", "__a.value", "__a.unit")
    )


def derive_ratios(facts: DataFrame, ratios: list[tuple[str, str, str]] = RATIOS) -> DataFrame:
    """Ratios of unique facts of one entity, period and unit, with error_code where one can't be formed.

    All fields of an entity and period are gathered into one row by conditional aggregation: a single shuffle instead of
    a self-join per ratio.
    """
    fields = sorted({f for _, n, d in ratios for f in (n, d)})
    wide = unique_facts(facts).groupBy(*KEYS).agg(
        *[F.max(F.when(F.col("field") == f, F.struct("value", "unit"))).alias(f) for f in fields]
    )
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("ratio"), F.col(n).alias("n"), F.col(d).alias("d"))
                for name, n, d in ratios
            ]
        )
    )
    error = F.when(~F.col("r.n.unit").eqNullSafe(F.col("r.d.unit")), "unit_mismatch").when(F.col("r.d.value") == 0, "division_by_zero")
    return (
        wide.select(*KEYS, rows.alias("r"))
        .where(F.col("r.n").isNotNull() & F.col("r.d").isNotNull())
        .select(
            *KEYS,
            "r.ratio",
            F.when(error.isNull(), F.try_divide("r.n.value", "r.d.value")).alias("value"),
            error.alias("error_code"),
        )
    )


def conflicts(facts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with more than one distinct value; null values don't count."""
    return (
        facts.where(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(F.count_distinct(value).alias("values"), F.count("*").alias("rows"))
        .where("values > 1")
    )


def latest(facts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the highest order per key, as one aggregation."""
    rest = [c for c in facts.columns if c not in keys]
    return facts.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__x")).select(*keys, "__x.*")
