"""Rebuilding ordered conversations from message rows (problem 4).

Every message points to the message before it in its run. The pointers are resolved by pointer jumping: in each round a
message takes over the pointer and the distance of the message it points to, so that chains of any length are resolved
in logarithmically many joins. The distance from the root is the place in the conversation. Keys are (run, sequence), so
a run that holds a third of all rows spreads over all tasks; the previous message is found inside blocks of
``BLOCK`` sequence numbers and, for the first of a block, from a table of block ends.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspan.functions.text import has_visible, strip_outer
from tallyspan.session import cut

BLOCK = 1024
# Spellings of the speakers once letters alone are kept.
SPEAKERS = {
    "usermessage": "user",
    "user": "user",
    "human": "user",
    "assistantmessage": "assistant",
    "assistant": "assistant",
    "ai": "assistant",
}


def run_key(run_id: Column) -> Column:
    """Run ids without outer white space, in lower case; blank ids are null."""
    return F.nullif(F.lower(strip_outer(run_id)), F.lit(""))


def kind_key(event_kind: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(event_kind), r"[^\p{L}\p{N}]", ""), F.lit(""))


def speaker_of(kind: Column) -> Column:
    pairs = [F.lit(x) for pair in SPEAKERS.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), kind)


def resolve_pointers(nodes: DataFrame, keys: list[str], parent: str, max_depth: int | None = None) -> DataFrame:
    """Root, depth and state of every node of a forest given by parent pointers.

    ``nodes`` has the unique ``keys``; ``parent`` holds the last key's value of the parent, which shares the other keys,
    or null at a root. Result: keys, root, depth, state ('ok', 'orphan' where a pointer leads to no node, 'cycle').
    A node below an orphan is an orphan; the depth of nodes that aren't 'ok' has no meaning.
    """
    last = keys[-1]
    start = nodes.select(*keys, F.coalesce(parent, last).alias("root"), F.col(parent).isNull().alias("settled"))
    depth = F.when(F.col("settled"), 0).otherwise(1).cast("bigint")
    state = cut(start.select(*keys, "root", depth.alias("depth"), F.when(F.col("settled"), "ok").otherwise("open").alias("state")))
    # Settled rows are written once and stay where they are; a round writes the rows that were open before it.
    settled, open_ = [state.where("state <> 'open'")], state.where("state = 'open'")
    limit = max(1, max_depth or state.count()).bit_length() + 1
    rounds = 0
    while rounds <= limit and not open_.isEmpty():
        target = reduce(DataFrame.unionByName, [*settled, open_]).select(
            *[F.col(k).alias(f"__{k}") for k in keys],
            F.col("root").alias("__root"),
            F.col("depth").alias("__depth"),
            F.col("state").alias("__state"),
        )
        on = [open_[k] == target[f"__{k}"] for k in keys[:-1]] + [open_["root"] == target[f"__{last}"]]
        moved = cut(
            open_.join(target, on, "left").select(
                *keys,
                F.coalesce("__root", "root").alias("root"),
                (F.col("depth") + F.coalesce("__depth", F.lit(0))).alias("depth"),
                F.coalesce("__state", F.lit("orphan")).alias("state"),
            )
        )
        settled.append(moved.where("state <> 'open'"))
        open_ = moved.where("state = 'open'")
        rounds += 1
    return reduce(DataFrame.unionByName, [*settled, open_.withColumn("state", F.lit("cycle"))])


def message_events(events: DataFrame) -> DataFrame:
    """One row per event of a run: run_id, block, sequence, event_id, speaker, visible, broken.

    ``broken`` marks copies that differ in kind or content and events that share their sequence with another. Rows
    without run or sequence belong to no run. Only hashes of the content travel.
    """
    rows = events.select(
        run_key(F.col("run_id")).alias("run_id"),
        "sequence",
        "event_id",
        F.coalesce(kind_key(F.col("event_kind")), F.lit("")).alias("kind"),
        has_visible(F.col("content")).alias("visible"),
        F.when(F.col("content").isNotNull(), F.xxhash64("content", F.length("content"))).alias("hash"),
    ).where(F.col("run_id").isNotNull() & F.col("sequence").isNotNull())
    once = rows.groupBy("run_id", "event_id").agg(  # copies of an event are few, so no key is hot
        F.min("sequence").alias("sequence"),
        F.min("kind").alias("kind"),
        F.bool_and("visible").alias("visible"),
        (
            (F.min("kind") != F.max("kind"))
            | (F.coalesce(F.min("hash") != F.max("hash"), F.lit(False)))
            | ((F.count("hash") > 0) & (F.count("hash") < F.count("*")))
        ).alias("differs"),
    ).withColumn("block", F.floor(F.col("sequence") / BLOCK))
    place = W.partitionBy("run_id", "block").orderBy("sequence", "event_id")
    before, after = F.lag("sequence").over(place), F.lead("sequence").over(place)
    return once.select(
        "run_id",
        "block",
        "sequence",
        "event_id",
        speaker_of(F.col("kind")).alias("speaker"),
        "visible",
        (
            F.col("differs")
            | F.coalesce(before == F.col("sequence"), F.lit(False))
            | F.coalesce(after == F.col("sequence"), F.lit(False))
        ).alias("broken"),
    )


def conversations(events: DataFrame) -> DataFrame:
    """The messages of all whole runs: run_id, turn (from 1), speaker, event_id.

    A run is dropped if copies of an event differ in kind or content, if two events share a sequence, if a message has
    no visible character, or if its messages don't strictly alternate from a user to a final assistant. Runs without
    messages have no rows. Gaps in the sequence drop nothing.
    """
    rows = cut(message_events(events))
    broken = rows.where(F.col("broken") | (F.col("speaker").isNotNull() & ~F.col("visible"))).select("run_id").distinct()
    messages = rows.where(F.col("speaker").isNotNull()).join(broken, "run_id", "left_anti")
    ends = messages.groupBy("run_id", "block").agg(F.max("sequence").alias("__end"))
    ends = ends.select(
        "run_id", "block", F.lag("__end").over(W.partitionBy("run_id").orderBy("block")).alias("__before")
    ).where(F.col("__before").isNotNull())  # blocks that continue a run; few beside the messages
    inside = F.lag("sequence").over(W.partitionBy("run_id", "block").orderBy("sequence"))
    linked = cut(
        messages.withColumn("__inside", inside)
        .join(ends, ["run_id", "block"], "left")
        .select("run_id", "sequence", "event_id", "speaker", F.coalesce("__inside", "__before").alias("parent"))
    )
    resolved = resolve_pointers(linked.select("run_id", "sequence", "parent"), ["run_id", "sequence"], "parent")
    placed = linked.join(resolved, ["run_id", "sequence"])
    fits = (F.col("state") == "ok") & (
        F.col("speaker") == F.when(F.col("depth") % 2 == 0, "user").otherwise("assistant")
    )
    whole = (
        placed.groupBy("run_id")
        .agg(F.bool_and(fits).alias("fits"), F.max("depth").alias("deepest"))
        .where(F.col("fits") & (F.col("deepest") % 2 == 1))
        .select("run_id")
    )
    return placed.join(whole, "run_id", "left_semi").select(
        "run_id", (F.col("depth") + 1).alias("turn"), "speaker", "event_id"
    )
