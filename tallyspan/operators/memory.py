"""Conversation memory: windows of recent events under a budget, runs, slots of long-term memory and their promotion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspan.functions.tokens import token_set
from tallyspan.operators.blocks import BLOCK, before, with_figures

#: Events in a block of a thread.
WIDTH = 1024
SIMILAR = 0.6
# Words that make a preference temporary, and those that make it last.
TEMPORARY, DURABLE = "本轮|本次|这次|今天|当前(?:任务|报告|对话)", "从今以后|今后|以后都|长期|固定|永久"


def suffix_within(events: DataFrame, keys: list[str], order: str, cost: str, budget: float) -> DataFrame:
    """The longest run of last events of every key whose costs fit the budget: it ends before the first event, counted from
    the end, that would overflow.

    Costs are summed from the end inside blocks of ``WIDTH`` places with one figure per block after, so that a thread with a
    large part of all rows spreads over tasks. ``order`` is a number that is unique in a key.
    """
    held = events.withColumn(BLOCK, -F.floor(F.col(order) / WIDTH))
    sums = held.groupBy(*keys, BLOCK).agg(F.sum(cost).alias("__sum"))
    later = sums.select(*keys, BLOCK, F.coalesce(F.sum("__sum").over(before(keys)), F.lit(0)).alias("__later"))
    w = W.partitionBy(*keys, BLOCK).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    used = with_figures(held, later, keys).withColumn("used", F.col("__later") + F.sum(cost).over(w))
    return used.where(F.col("used") <= budget).drop(BLOCK, "__later")


def run_groups(events: DataFrame, keys: list[str], order: str, run: str = "run_id") -> DataFrame:
    """Events with the number of their consecutive run (from 1): it changes where the run id does, so a run that is
    interrupted has several. Null ids are equal to each other."""
    block = events.withColumn(BLOCK, F.floor(F.col(order) / WIDTH))
    ends = block.groupBy(*keys, BLOCK).agg(F.max_by(F.struct(F.col(run).alias("r")), order).alias("__end"))
    ends = ends.select(*keys, BLOCK, F.lag("__end").over(W.partitionBy(*keys).orderBy(BLOCK)).alias("__before"))
    w = W.partitionBy(*keys, BLOCK).orderBy(order)
    one = F.struct(F.col(run).alias("r"))
    flagged = with_figures(block, ends, keys).withColumn("__prior", F.coalesce(F.lag(one).over(w), "__before"))
    flagged = flagged.withColumn("__new", (F.col("__prior").isNull() | ~F.col("__prior.r").eqNullSafe(F.col(run))).cast("int"))
    begun = flagged.groupBy(*keys, BLOCK).agg(F.sum("__new").alias("__n"))
    begun = begun.select(*keys, BLOCK, F.coalesce(F.sum("__n").over(before(keys)), F.lit(0)).alias("__begun"))
    numbered = with_figures(flagged, begun, keys).withColumn("run_number", F.col("__begun") + F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.drop(BLOCK, "__before", "__prior", "__new", "__begun")


def recent_runs(events: DataFrame, keys: list[str], order: str, cost: str, budget: float) -> DataFrame:
    """The events of the most recent whole runs: the newest always, those before it while their costs fit the budget."""
    numbered = run_groups(events, keys, order)
    runs = numbered.groupBy(*keys, "run_number").agg(F.sum(cost).alias("__cost"))
    at = W.partitionBy(*keys).orderBy(F.desc("run_number"))
    used = runs.withColumn("__used", F.sum("__cost").over(at.rowsBetween(W.unboundedPreceding, 0))).withColumn("__newest", F.row_number().over(at) == 1)  # a row per run
    kept = used.where(F.col("__newest") | (F.col("__used") <= budget)).select(*keys, "run_number")
    return numbered.join(kept, [*keys, "run_number"], "left_semi")


def window_projection(events: DataFrame, keys: list[str], most: float, facts: float, recent: float, trigger: float = 0.85) -> DataFrame:
    """Per thread: tokens and events that are pending, facts kept, whether it is to be compacted (at ``trigger`` of ``most``), the
    sequence up to which older runs go into a summary, and the events left. ``events``: keys, sequence (unique in a thread),
    run_id, kind, tokens."""
    fact = F.col("kind") == "atomic_fact"
    pending = events.where(~fact)
    kept_facts = suffix_within(events.where(fact), keys, "sequence", "tokens", facts).groupBy(*keys).agg(F.count("*").alias("facts"), F.sum("tokens").alias("fact_tokens"))
    size = pending.groupBy(*keys).agg(F.count("*").alias("events"), F.sum("tokens").alias("tokens"), F.max("sequence").alias("__last"))
    newest = recent_runs(pending, keys, "sequence", "tokens", recent).groupBy(*keys).agg(F.count("*").alias("__recent"), F.min("sequence").alias("__from"))
    joined = size.join(kept_facts, keys, "left").join(newest, keys)
    full = (F.col("tokens") + F.coalesce("fact_tokens", F.lit(0)) >= trigger * most) & (F.col("__recent") < F.col("events"))
    return joined.select(
        *keys,
        "events",
        "tokens",
        F.coalesce("facts", F.lit(0)).alias("facts"),
        full.alias("compact"),
        F.when(full, F.col("__from") - 1).alias("covered_through"),
        F.when(full, F.col("__recent")).otherwise(F.col("events")).alias("left"),
    )


def last_runs(runs: DataFrame, keys: list[str], at: str, tie: str, most: int = 20) -> DataFrame:
    """The last runs of every thread, cut to ``most`` inside tasks first, with their place in ascending order."""
    newest = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(at), F.desc(tie)))
    held = runs.withColumn("__n", newest).where(F.col("__n") <= most)
    return held.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("__n")))).drop("__n")


def jaccard(a, b):
    """Size of the intersection over that of the union of two sets; 0 for two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def memory_slots(candidates: DataFrame, memories: DataFrame, scope: list[str]) -> DataFrame:
    """candidate_id and the memory it belongs to: of the same scope and kind, with the same title (without case), else the most
    alike by Jaccard of ``SIMILAR`` or more, the newest of equals. No row for candidates that have none.

    Both tables: scope, an id, kind, title, content; memories also updated_at. Alike texts share a term, so pairs come from a
    join on terms of which the rarest third plus one are enough (two sets this alike share one of them); scopes are users and small.
    """
    terms = token_set(F.concat_ws(" ", F.col("title"), F.col("content")))
    keys = [*scope, "kind"]
    c = candidates.select(*keys, F.col("candidate_id").alias("cid"), F.lower(F.trim("title")).alias("c_title"), terms.alias("c_terms"))
    m = memories.select(*[F.col(k).alias(f"m_{k}") for k in keys], F.col("memory_id").alias("mid"), "updated_at", F.lower(F.trim("title")).alias("m_title"), terms.alias("m_terms"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"m_{k}")) for k in keys])
    titled = c.join(m, (F.col("c_title") == F.col("m_title")) & same).select("cid", "mid", "updated_at", F.lit(2.0).alias("similarity"))
    count = c.select(F.explode("c_terms").alias("term")).unionByName(m.select(F.explode("m_terms").alias("term"))).groupBy("term").agg(F.count("*").alias("n"))

    def signed(df: DataFrame, held: str, columns: list[str], name: str) -> DataFrame:
        rows = df.select(*columns, F.size(held).alias("size"), F.explode(held).alias("term")).join(count, "term")
        place = F.row_number().over(W.partitionBy(*columns).orderBy("n", "term"))  # the words of one memory
        enough = F.col("size") - F.ceil(F.col("size") * SIMILAR) + 1
        return rows.withColumn("p", place).where(F.col("p") <= enough).select(*columns, F.col("term").alias(name))

    a = signed(c, "c_terms", [*keys, "cid"], "c_term")
    b = signed(m, "m_terms", [*[f"m_{k}" for k in keys], "mid"], "m_term")
    pairs = a.join(b, (F.col("c_term") == F.col("m_term")) & same).select("cid", "mid").distinct()
    alike = (
        pairs.join(c.select("cid", "c_terms"), "cid")
        .join(m.select("mid", "updated_at", "m_terms"), "mid")
        .withColumn("similarity", jaccard(F.col("c_terms"), F.col("m_terms")))
        .where(F.col("similarity") >= SIMILAR)
    )
    both = titled.unionByName(alike.select("cid", "mid", "updated_at", "similarity"))
    best = F.struct("similarity", F.coalesce("updated_at", F.lit("1970-01-01").cast("timestamp")), "mid")
    return both.groupBy(F.col("cid").alias("candidate_id")).agg(F.max_by("mid", best).alias("memory_id"), F.least(F.max("similarity"), F.lit(1.0)).alias("similarity"))


def usable_candidates(candidates: DataFrame, least: float = 0.75) -> DataFrame:
    """Candidates that may enter memory: confident, not to be ignored, and not temporary unless said to last."""
    text = F.concat_ws(" ", "scope", "title", "content")
    temporary = text.rlike(TEMPORARY) & ~text.rlike(DURABLE)
    return candidates.where((F.col("confidence") >= least) & (F.col("operation") != "ignore") & ~temporary)


def promoted(candidates: DataFrame, keys: list[str], run: str = "run_id", least: int = 2) -> DataFrame:
    """Per slot (keys): runs, whether any was explicit, and whether it is promoted: explicit or seen in ``least`` runs."""
    explicit = F.coalesce(F.bool_or(F.col("explicitness") == "explicit"), F.lit(False))
    return candidates.groupBy(*keys).agg(F.count_distinct(run).alias("runs"), explicit.alias("explicit")).withColumn("promoted", F.col("explicit") | (F.col("runs") >= least))
