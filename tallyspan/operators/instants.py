"""Normalising the time fields of source records (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspan.functions.timestamps import CANONICAL, utc_text, with_instant, zone_or_null

TIME_FIELDS = ("retrieved_at", "as_of", "published_at")


def normalise_instants(sources: DataFrame, providers: DataFrame, fields: tuple[str, ...] = TIME_FIELDS) -> DataFrame:
    """One row per record and time field: pos, field_name, raw, utc_micros, already_canonical.

    The place of a value without zone is metadata['timezone'] if that is a known zone, else the provider's. Records of
    unknown providers keep only values that name their zone. Null fields come out with a null instant. The provider
    table is a small dimension; Spark broadcasts it by its measured size, so no hint is given.
    """
    dimension = providers.select(
        F.col("provider").alias("__provider"), zone_or_null(F.col("tz_name")).alias("__tz"), F.col("date_order").alias("__order")
    ).dropDuplicates(["__provider"])
    narrow = sources.select("pos", "provider", "metadata", *fields)
    long = narrow.select(
        "pos",
        "provider",
        F.try_element_at("metadata", F.lit("timezone")).alias("__own"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("raw")) for f in fields])).alias("x"),
    ).select("pos", "provider", "__own", "x.field_name", "x.raw")
    joined = long.join(dimension, long["provider"].eqNullSafe(dimension["__provider"]), "left").withColumn(
        "__zone", F.coalesce(zone_or_null(F.col("__own")), F.col("__tz"))
    )
    return with_instant(joined, "raw", "__zone", "__order", known_zones=True).select(
        "pos", "field_name", "raw", "utc_micros", F.coalesce(F.col("raw").rlike(CANONICAL), F.lit(False)).alias("already_canonical")
    )


def changed_instants(sources: DataFrame, providers: DataFrame) -> DataFrame:
    """The values that denote an instant and are not yet in canonical form, with their UTC text; distinct rows."""
    return (
        normalise_instants(sources, providers)
        .where(F.col("utc_micros").isNotNull() & ~F.col("already_canonical"))
        .select("pos", "field_name", utc_text(F.col("utc_micros")).alias("utc"))
        .distinct()
    )
