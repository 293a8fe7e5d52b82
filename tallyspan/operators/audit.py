"""Audit rows of tool calls: merging, usage, success counts, catalogue ranking, provenance and leaks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspan.functions.checks import discovery_tokens


def merged_calls(rows: DataFrame, call: str, place: str) -> DataFrame:
    """One row per call, the last one, with the number in its id as ``number`` (0 without one), by which calls are ordered."""
    rest = [c for c in rows.columns if c != call]
    number = F.coalesce(F.substring_index(F.col(call), ":", -1).try_cast("bigint"), F.lit(0))
    return rows.groupBy(call).agg(F.max_by(F.struct(*rest), place).alias("__x")).select(call, *[F.col(f"__x.{c}").alias(c) for c in rest], number.alias("number"))


def usage(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: tool, model and network calls and the sums of tokens. ``calls``: keys, capability, consumed, network_attempts,
    input_tokens, output_tokens."""
    n = lambda c: F.coalesce(F.sum(F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))), F.lit(0)).cast("bigint")
    model = F.col("capability") == "model"
    return calls.groupBy(*keys).agg(
        F.count_if(F.col("consumed") & ~model).alias("tool_calls"), F.count_if(F.col("consumed") & model).alias("model_calls"), n("network_attempts").alias("network_attempts"), n("input_tokens").alias("input_tokens"), n("output_tokens").alias("output_tokens")
    )


def successes(calls: DataFrame, keys: list[str], run: str, status: str, at: str) -> DataFrame:
    """Per key: calls that succeeded, the distinct runs they belong to and the last time."""
    done = calls.where(F.col(status) == "succeeded")
    return done.groupBy(*keys).agg(F.count("*").alias("calls"), F.count_distinct(run).alias("runs"), F.max(at).alias("last_at"))


def eligible(observed: DataFrame, least: int = 2) -> DataFrame:
    """What may be learned from: runs that succeeded and have ``least`` successful observations or more."""
    return observed.where((F.col("status") == "succeeded") & (F.col("observations") >= least))


def catalogue_ranks(catalogue: DataFrame, question: str, name: str, text: str, most: int) -> DataFrame:
    """Entries that share tokens with a question: a point per token, three more if the name stands in the question or holds
    it; ranked by points, then name."""
    asked = F.lit(question.lower())
    points = F.size(F.array_intersect(discovery_tokens(F.concat_ws(" ", name, text)), discovery_tokens(asked)))
    named = F.when(asked.contains(F.lower(name)) | F.lower(F.col(name)).contains(asked), 3).otherwise(0)
    best = catalogue.withColumn("points", points + named).where("points > 0").orderBy(F.desc("points"), name).limit(most)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("points"), name)).cast("bigint"))  # at most ``most`` rows


def without_provenance(mentions: DataFrame, events: DataFrame) -> DataFrame:
    """Mentions (event_id, entity) whose event is unknown or doesn't list the entity."""
    listed = events.select("event_id", F.explode("entities").alias("entity")).distinct()
    return mentions.join(listed, ["event_id", "entity"], "left_anti")


def leaks(texts: DataFrame, names: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """key and name of texts that hold a name (without case, between word borders).

    Names of w words can only be among the runs of w words of a text: these are made and joined, so no text meets every name.
    """
    held = names.select(F.lower(F.trim(name)).alias("name")).where("name <> ''").distinct()
    words = F.split("name", r"[^\p{L}\p{N}]+")
    sized = held.select("name", F.array_join(F.filter(words, lambda w: w != ""), " ").alias("run")).withColumn("w", F.size(F.split("run", " ")))
    lengths = sorted(r["w"] for r in sized.select("w").distinct().collect())  # how many words names have: a few numbers
    made = texts.select(key, F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("t")).where(F.size("t") > 0)
    runs = [_runs(made, key, w) for w in lengths]
    if not runs:
        return made.limit(0).select(key, F.lit("").alias("name"))
    return reduce(DataFrame.unionByName, runs).join(sized, "run").select(key, "name").distinct()


def _runs(made: DataFrame, key: str, w: int) -> DataFrame:
    places = F.sequence(F.lit(1), F.size("t") - F.lit(w - 1))
    return made.where(F.size("t") >= w).select(key, F.explode(F.array_distinct(F.transform(places, lambda i: F.array_join(F.slice("t", i, F.lit(w)), " ")))).alias("run"))
