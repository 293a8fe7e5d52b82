"""A batch of metric requests: every request gives a figure or an error code."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspan.functions.clean import rounded

# Operations with their inputs and the unit of their result.
OPERATIONS = {
    "ratio": (("numerator", "denominator"), "ratio"),
    "percentage_change": (("begin", "end"), "ratio"),
    "cagr": (("begin", "end", "years"), "ratio_per_year"),
    "future_value": (("present_value", "rate", "periods"), "currency"),
    "present_value": (("future_value", "rate", "periods"), "currency"),
    "loan_payment": (("principal", "rate", "periods"), "currency_per_period"),
    "annualized_return": (("periods_per_year",), "ratio_per_year"),
    "annualized_volatility": (("periods_per_year",), "ratio_per_year"),
    "sharpe": (("periods_per_year", "risk_free_rate"), "ratio"),
    "max_drawdown": ((), "ratio"),
}
MOST_POINTS, LARGEST, MOST_PERIODS = 10_000, 1e100, 1e6
DIGITS = 10


def _known(operation: Column) -> tuple[Column, Column]:
    inputs = F.create_map(*[x for o, (names, _) in OPERATIONS.items() for x in (F.lit(o), F.array(*[F.lit(n) for n in names]).cast("array<string>"))])
    units = F.create_map(*[x for o, (_, unit) in OPERATIONS.items() for x in (F.lit(o), F.lit(unit))])
    return F.try_element_at(inputs, operation), F.try_element_at(units, operation)


def unit_fits(unit: Column, expected: Column) -> Column:
    """Whether a unit asked for is the operation's; money may be any three-letter currency, per period for loans."""
    return (
        unit.isNull()
        | (unit == expected)
        | ((expected == "currency") & unit.rlike("^[A-Z]{3}$"))
        | ((expected == "currency_per_period") & unit.rlike("^[A-Z]{3}_per_period$"))
    )


def metric_batch(requests: DataFrame) -> DataFrame:
    """request_id, operation, value (10 digits), unit and error_code of every request.

    ``requests``: request_id, operation, inputs (map<string,double>), series (array<double>), unit. A request that can't be
    computed is a row with a code (unknown_operation, invalid_input, invalid_unit, division_by_zero, invalid_rate,
    invalid_series, invalid_return, numeric_overflow) and no failure.
    """
    names, expected = _known(F.col("operation"))
    x = lambda n: F.try_element_at("inputs", F.lit(n))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > LARGEST)
    op = F.col("operation")
    needed = F.transform(names, lambda n: F.try_element_at("inputs", n))
    series = F.coalesce("series", F.array().cast("array<double>"))
    on_series, returns = op.isin("annualized_return", "annualized_volatility", "sharpe", "max_drawdown"), op.isin("annualized_return", "annualized_volatility", "sharpe")
    n = F.size(series).cast("double")
    rate, periods, zero = x("rate"), x("periods"), F.lit(0.0)
    mean = F.try_divide(F.aggregate(series, zero, lambda a, v: a + v), n)
    sd = F.sqrt(F.try_divide(F.aggregate(series, zero, lambda a, v: a + (v - mean) * (v - mean)), n - 1))
    year = x("periods_per_year")
    annual = F.pow(F.aggregate(series, F.lit(1.0), lambda a, v: a * (1 + v)), F.try_divide(year, n)) - 1
    fall = F.aggregate(
        series,
        F.struct(zero.alias("top"), zero.alias("least")),
        lambda a, v: F.struct(F.greatest(a["top"], v).alias("top"), F.least(a["least"], F.try_divide(v, F.greatest(a["top"], v)) - 1).alias("least")),
    )["least"]
    growth = F.pow(1 + rate, periods)
    value = (
        F.when(op == "ratio", F.try_divide(x("numerator"), x("denominator")))
        .when(op == "percentage_change", F.try_divide(x("end"), x("begin")) - 1)
        .when(op == "cagr", F.pow(F.try_divide(x("end"), x("begin")), F.try_divide(F.lit(1.0), x("years"))) - 1)
        .when(op == "future_value", x("present_value") * growth)
        .when(op == "present_value", F.try_divide(x("future_value"), growth))
        .when((op == "loan_payment") & (rate == 0), F.try_divide(x("principal"), periods))
        .when(op == "loan_payment", F.try_divide(x("principal") * rate * growth, growth - 1))
        .when(op == "annualized_return", annual)
        .when(op == "annualized_volatility", sd * F.sqrt(year))
        .when(op == "sharpe", F.try_divide(annual - x("risk_free_rate"), sd * F.sqrt(year)))
        .when(op == "max_drawdown", fall)
    )
    timed = op.isin("future_value", "present_value", "loan_payment")
    error = (
        F.when(names.isNull(), "unknown_operation")
        .when(~unit_fits(F.col("unit"), expected), "invalid_unit")
        .when(F.exists(needed, bad), "invalid_input")
        .when(on_series & ((n < 2) | (n > MOST_POINTS) | F.exists(series, bad)), "invalid_series")
        .when(returns & F.exists(series, lambda v: v <= -1), "invalid_return")
        .when((op == "max_drawdown") & F.exists(series, lambda v: v <= 0), "invalid_series")
        .when(returns & (year <= 0), "invalid_input")
        .when((op == "ratio") & (x("denominator") == 0) | (op == "percentage_change") & (x("begin") == 0) | (op == "sharpe") & (sd == 0), "division_by_zero")
        .when((op == "cagr") & ((x("begin") <= 0) | (x("end") < 0) | (x("years") <= 0) | (x("years") > MOST_PERIODS)), "invalid_input")
        .when(timed & (rate <= -1), "invalid_rate")
        .when(timed & ~periods.between(0, MOST_PERIODS) | (op == "loan_payment") & (periods <= 0), "invalid_input")
    )
    made = requests.select("request_id", "operation", F.coalesce("unit", expected).alias("unit"), error.alias("error_code"), value.alias("value"))
    off = F.col("error_code").isNull() & (F.col("value").isNull() | F.isnan("value") | (F.abs("value") > LARGEST))
    checked = made.withColumn("error_code", F.when(off, "numeric_overflow").otherwise(F.col("error_code")))
    return checked.select("request_id", "operation", "unit", "error_code", F.when(F.col("error_code").isNull(), rounded(F.col("value"), DIGITS)).alias("value"))


def point_ratio(numerators: DataFrame, denominators: DataFrame, digits: int = 6) -> DataFrame:
    """pair_id, value and error_code for pairs of facts (pair_id, entity, period, unit, value): the first of entity_mismatch,
    period_mismatch, unit_mismatch, division_by_zero, non_finite_result that holds."""
    side = lambda df, p: df.select("pair_id", *[F.col(c).alias(f"{p}_{c}") for c in ("entity", "period", "unit", "value")])
    both = side(numerators, "n").join(side(denominators, "d"), "pair_id")
    differs = lambda c: ~F.col(f"n_{c}").eqNullSafe(F.col(f"d_{c}"))
    value = F.try_divide("n_value", "d_value")
    error = (
        F.when(differs("entity"), "entity_mismatch")
        .when(differs("period"), "period_mismatch")
        .when(differs("unit"), "unit_mismatch")
        .when(F.col("d_value") == 0, "division_by_zero")
        .when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), "non_finite_result")
    )
    return both.select("pair_id", F.when(error.isNull(), rounded(value, digits)).alias("value"), error.alias("error_code"))


