"""State that is kept as events: current views, idempotent appends, runs, scans and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspan.operators.blocks import BLOCK, before, by_time, with_figures


def current_view(events: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """Latest row per key, with the time its key was first written."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(at, tie)).alias("__x"), F.min(at).alias("created_at_first")
    ).select(*keys, "__x.*", "created_at_first")


def appended_once(events: DataFrame, key: str, body: list[str]) -> DataFrame:
    """One row per event id with its body; ``conflict`` marks ids that came with different bodies."""
    one = F.struct(*body)
    return events.groupBy(key).agg(
        F.min(one).alias("__b"), (F.min(one) != F.max(one)).alias("conflict"), F.count("*").alias("deliveries")
    ).select(key, "__b.*", "conflict", "deliveries")


def run_states(events: DataFrame) -> DataFrame:
    """Per run: first and last time, last sequence, events, messages of both sides and tool events."""
    kind = F.regexp_replace(F.lower("event_kind"), r"[^a-z]", "")
    return (
        events.where(F.col("run_id").isNotNull())
        .withColumn("__k", kind)
        .groupBy(F.lower(F.trim(F.regexp_replace("run_id", r"[\n\t\r]", ""))).alias("run"))
        .agg(
            F.min("occurred_at").alias("first_at"),
            F.max("occurred_at").alias("last_at"),
            F.max("sequence").alias("last_sequence"),
            F.count("*").alias("events"),
            F.count_if(F.col("__k").isin("usermessage", "user", "human")).alias("user_messages"),
            F.count_if(F.col("__k").isin("assistantmessage", "assistant", "ai")).alias("assistant_messages"),
            F.count_if(F.col("__k") == "toolevent").alias("tool_events"),
        )
    )


def kept_after(events: DataFrame, at: str, cutoff) -> DataFrame:
    """Retention: the rows from the cutoff on."""
    return events.where(F.col(at) >= F.lit(cutoff))


def dense_sequence(events: DataFrame, thread: str, order: list[str], characters: int = 10) -> DataFrame:
    """Number the rows of a thread from 1 in the given order, which begins with a time; days are its blocks."""
    held = events.withColumn(BLOCK, by_time(order[0], characters))
    counts = held.groupBy(thread, BLOCK).agg(F.count("*").alias("__n"))
    counts = counts.select(thread, BLOCK, F.coalesce(F.sum("__n").over(before([thread])), F.lit(0)).alias("__n"))
    place = F.row_number().over(W.partitionBy(thread, BLOCK).orderBy(*order))
    return with_figures(held, counts, [thread]).withColumn("dense", (F.col("__n") + place).cast("bigint")).drop(BLOCK, "__n")


def scan_after(events: DataFrame, thread: dict[str, str], after: int, limit: int, kinds: list[str] | None = None) -> DataFrame:
    """A page of a thread's events: those after a sequence number, of the given kinds, in ascending order."""
    held = events.where(F.col("sequence") > after)
    for column, value in thread.items():
        held = held.where(F.col(column) == F.lit(value))
    held = held if kinds is None else held.where(F.col("event_kind").isin(kinds))
    return held.orderBy("sequence", "event_id").limit(limit)


def newest_first(rows: DataFrame, scope: list[str], at: str, tie: str, most: int) -> DataFrame:
    """The ``most`` newest rows of every scope with their place; each scope is cut to them inside tasks before the shuffle."""
    place = F.row_number().over(W.partitionBy(*scope).orderBy(F.desc(at), F.desc(tie)))
    return rows.withColumn("place", place).where(F.col("place") <= most)


def appended(ledger: DataFrame, new: DataFrame, thread: str, key: str, order: list[str]) -> DataFrame:
    """Rows of ``new`` whose key the ledger doesn't hold, once each, numbered after the last sequence of their thread."""
    fresh = new.dropDuplicates([key]).join(ledger.select(key), key, "left_anti")
    last = ledger.groupBy(thread).agg(F.max("sequence").alias("__last"))
    return dense_sequence(fresh, thread, order).join(last, thread, "left").withColumn("sequence", F.coalesce("__last", F.lit(0)) + F.col("dense")).drop("__last", "dense")


def first_and_last(rows: DataFrame, keys: list[str], at: str, first: list[str], last: list[str]) -> DataFrame:
    """Upsert as a view: ``first`` columns from a key's earliest row, ``last`` columns from its latest."""
    early, late = F.struct(at, *first), F.struct(at, *last)
    return rows.groupBy(*keys).agg(F.min(early).alias("__a"), F.max(late).alias("__z")).select(
        *keys, *[F.col(f"__a.{c}").alias(c) for c in first], *[F.col(f"__z.{c}").alias(c) for c in last], F.col(f"__a.{at}").alias("created_at"), F.col(f"__z.{at}").alias("updated_at")
    )
