"""Evidence rows: ranking and budgeted selection for a question, coverage of requirements, conflicts, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspan.functions.tokens import token_set
from tallyspan.operators.blocks import BLOCK, before, with_figures
from tallyspan.operators.retrieval import ranked
from tallyspan.operators.selection import greedy_fill

# How sources rank by type and by quality; without a rank of its own a row comes last.
SOURCE_PRIORITY = {"regulatory_filing": 5, "calculation": 4, "market_data": 3, "macro_data": 3, "document": 2, "web": 1, "user_input": 1}
QUALITY_PRIORITY = {"public_authority": 3, "publisher_primary": 2, "open_web": 1}
NO_RANK = -100_000
#: Ranks in a block.
RANKS = 4096


def _looked_up(column: Column, table: dict[str, int]) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), column), F.lit(0))


def scored(evidence: DataFrame, question: str) -> DataFrame:
    """Evidence with its score keys, most important first: overlap (terms of the question in the text), source, quality,
    structured, confidence, rank.

    ``evidence``: evidence_id, content, entity, title, field_name, value, source_type, quality_tier, confidence, rank.
    """
    row = evidence.sparkSession.range(1).select(token_set(F.lit(question)).alias("t")).first()
    terms = sorted(row["t"])  # the words of one question
    text = F.lower(F.concat_ws(" ", "content", "entity", "field_name", "title"))
    overlap = sum((text.contains(t).cast("int") for t in terms), F.lit(0))
    return evidence.select(
        "*",
        overlap.alias("overlap"),
        _looked_up(F.col("source_type"), SOURCE_PRIORITY).alias("source_priority"),
        _looked_up(F.col("quality_tier"), QUALITY_PRIORITY).alias("quality_priority"),
        (F.col("value").isNotNull() & F.col("field_name").isNotNull()).cast("int").alias("structured"),
        F.coalesce(-F.col("rank"), F.lit(NO_RANK)).alias("rank_priority"),
    )


def group_key(entity: Column, source_type: Column, origin: Column) -> Column:
    """entity::source_type::origin, 'global' for no entity."""
    return F.concat_ws("::", F.coalesce(F.nullif(entity, F.lit("")), F.lit("global")), source_type, origin)


ORDER = ("overlap", "source_priority", "quality_priority", "structured", "confidence", "rank_priority", "evidence_id")


def selected(evidence: DataFrame, budget: float, group: str = "group", cost: str = "cost") -> DataFrame:
    """What a budget admits of scored evidence, with ``place``: one row of each group per pass, groups by name, each row
    taken if it still fits and skipped if not.

    All rows are ranked by their score in ranges; the pass of a row, its rank inside its group, is counted inside blocks of
    ranks with one figure per block and group before, so that a large group spreads over tasks.
    """
    held = ranked(evidence.drop("rank").withColumn("score", F.struct(*ORDER)), "evidence_id").drop("score")
    blocks = held.withColumn(BLOCK, F.floor(F.col("rank") / RANKS))
    counts = blocks.groupBy(group, BLOCK).agg(F.count("*").alias("__n"))
    counts = counts.select(group, BLOCK, F.coalesce(F.sum("__n").over(before([group])), F.lit(0)).alias("__n"))
    inside = F.row_number().over(W.partitionBy(group, BLOCK).orderBy("rank"))
    turns = with_figures(blocks, counts, [group]).withColumn("score", -(F.col("__n") + inside)).drop(BLOCK, "__n", "rank")
    placed = ranked(turns, group).drop("score").withColumnRenamed("rank", "place")
    return greedy_fill(placed, budget, cost, "place")


def type_counts(chosen: DataFrame) -> DataFrame:
    """source_type and rows, also of types that have none."""
    types = chosen.sparkSession.createDataFrame([(t,) for t in SOURCE_PRIORITY], "source_type string")  # the fixed types
    return types.join(chosen.groupBy("source_type").agg(F.count("*").alias("rows")), "source_type", "left").select("source_type", F.coalesce("rows", F.lit(0)).alias("rows"))


def fits_category(category: Column, request: Column, fields: Column) -> Column:
    """Whether an evidence row counts for a requirement's category (fixed rules; 'web' is settled over all its rows)."""
    kind, dated = F.col("source_type"), F.coalesce(F.col("as_of") != "", F.lit(False))
    tagged = lambda t: F.coalesce(F.array_contains("tags", t), F.lit(False))
    return (
        F.when(category == "document", kind == "document")
        .when(category == "market", (kind == "market_data") & ~tagged("market_history") & dated)
        .when(category == "market_history", tagged("market_history") & dated)
        .when(category == "regulatory", (kind == "regulatory_filing") & dated)
        .when(category == "filings", tagged("filing_metadata") & F.coalesce(F.col("published_at") != "", F.lit(False)))
        .when(category == "macro", (kind == "macro_data") & dated)
        .when(category == "calculation", (kind == "calculation") & (request.isNull() | tagged(request)))
        .when(category == "derived_metric", (kind == "calculation") & F.array_contains(fields, F.col("field_name")))
        .when(category == "web", kind == "web")
        .otherwise(False)
    )


def coverage_by_category(requirements: DataFrame, evidence: DataFrame) -> DataFrame:
    """key, category, candidates, documents, missing_fields and covered of every requirement.

    ``requirements``: key, category, entity, fields, minimum_documents, request_id. ``evidence``: entity, source_type,
    field_name, as_of, published_at, tags, document, domain, quality_tier, operation. Entities and fields are compared without
    case. 'knowledge' is always covered, anything unknown never. Evidence is first cut down to one row per combination of what
    the rules look at, so that the join with the requirements is narrow however many rows a source has.
    """
    what = ["source_type", "field_name", "as_of", "published_at", "tags", "document", "domain", "quality_tier", "operation"]
    present = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", "x").otherwise("").alias(c)
    slim = evidence.select(F.lower(F.coalesce("entity", F.lit(""))).alias("__entity"), *[present(c) if c in ("as_of", "published_at") else F.col(c) for c in what])
    slim = slim.groupBy("__entity", *what).agg(F.count("*").alias("__n"))
    asked = requirements.select("*", F.lower(F.coalesce("entity", F.lit(""))).alias("__asked"))
    # A requirement without entity meets all rows, one with an entity only those of it: two equi-joins instead of one theta join.
    kinds = {"document": ["document"], "market": ["market_data"], "market_history": None, "regulatory": ["regulatory_filing"], "filings": None, "macro": ["macro_data"], "calculation": ["calculation"], "derived_metric": ["calculation"], "web": ["web"]}
    of_kind = F.create_map(*[x for c, k in kinds.items() for x in (F.lit(c), F.array(*[F.lit(t) for t in (k or list(SOURCE_PRIORITY))]))])
    exploded = asked.select("*", F.explode(F.coalesce(F.try_element_at(of_kind, F.col("category")), F.array().cast("array<string>"))).alias("__kind"))
    named = exploded.where("__asked <> ''").join(slim.withColumnRenamed("__entity", "__asked").withColumn("__kind", F.col("source_type")), ["__asked", "__kind"])
    whole = exploded.where("__asked = ''").join(slim.drop("__entity").groupBy(*what).agg(F.sum("__n").alias("__n")).withColumn("__kind", F.col("source_type")), "__kind")
    columns = ["key", "category", "fields", "request_id", *what, "__n"]
    met = named.select(*columns).unionByName(whole.select(*columns)).where(fits_category(F.col("category"), F.col("request_id"), F.col("fields")))
    found = met.groupBy("key").agg(
        F.sum("__n").alias("rows"),
        F.count_distinct("document").alias("documents"),
        F.collect_set(F.lower("field_name")).alias("__fields"),
        F.collect_set(F.lower("operation")).alias("__operations"),
        F.bool_or(F.coalesce(F.col("quality_tier") == "public_authority", F.lit(False))).alias("__authority"),
        F.count_distinct(F.nullif("domain", F.lit(""))).alias("__domains"),
    )
    enough_web = F.col("__authority") | (F.col("__domains") >= 2)
    candidates = F.when((F.col("category") == "web") & ~F.coalesce(enough_web, F.lit(False)), 0).otherwise(F.coalesce("rows", F.lit(0)))
    none = F.array().cast("array<string>")
    held = F.concat(F.coalesce("__fields", none), F.when(F.col("category") == "calculation", F.coalesce("__operations", none)).otherwise(none))
    asked_fields = F.transform(F.coalesce("fields", none), lambda f: F.lower(f))
    missing = F.when(candidates > 0, F.array_except(asked_fields, held)).otherwise(F.array_distinct(asked_fields))
    few = (F.col("category") == "document") & (F.coalesce("documents", F.lit(0)) < F.coalesce("minimum_documents", F.lit(1)))
    return (
        requirements.join(found, "key", "left")
        .select("key", "category", candidates.cast("bigint").alias("candidates"), F.coalesce("documents", F.lit(0)).alias("documents"), missing.alias("missing_fields"), few.alias("__few"))
        .select("key", "category", "candidates", "documents", "missing_fields", ((F.col("category") == "knowledge") | ((F.col("candidates") > 0) & (F.size("missing_fields") == 0) & ~F.col("__few"))).alias("covered"))
    )


def recovered_gaps(gaps: DataFrame, coverage: DataFrame) -> DataFrame:
    """Gaps with ``resolved``: those that can be resolved are once their requirement is covered, or all are for gaps that
    name none. ``gaps``: gap_id, code, requirement, resolvable."""
    all_covered = coverage.agg(F.coalesce(F.bool_and("covered"), F.lit(True)).alias("__all"))  # one row
    state = coverage.select(F.col("key").alias("requirement"), F.col("covered").alias("__covered"))
    done = F.when(F.col("requirement").isNull(), F.col("__all")).otherwise(F.coalesce("__covered", F.lit(False)))
    return gaps.join(state, "requirement", "left").crossJoin(F.broadcast(all_covered)).withColumn("resolved", F.col("resolvable") & done).drop("__covered", "__all")


def first_gaps(gaps: DataFrame, place: str) -> DataFrame:
    """One gap per code, entity, requirement and tool: the first."""
    return gaps.groupBy("code", "entity", "requirement", "tool").agg(F.min_by("message", place).alias("message"), F.min(place).alias(place))


def conflicting_evidence(evidence: DataFrame) -> DataFrame:
    """entity, field_name, period, unit, request_id, values and ids of facts that come with more than one value; rows without
    value or field don't count, absent keys meet each other."""
    keys = ["entity", "field_name", "period", "unit", "request_id"]
    return (
        evidence.where(F.col("value").isNotNull() & F.col("field_name").isNotNull())
        .groupBy(*keys)
        .agg(F.count_distinct("value").alias("values"), F.array_sort(F.collect_set("evidence_id")).alias("ids"))
        .where("values > 1")
    )


def merged_sources(sources: DataFrame, key: str, identity: list[str], place: str) -> DataFrame:
    """One row per id, the first, with ``conflict`` where rows of an id differ in identity (nulls count as a value)."""
    rest = [c for c in sources.columns if c not in (key, place)]
    hashes = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in identity])
    return (
        sources.groupBy(key)
        .agg(F.min_by(F.struct(*rest), place).alias("__x"), (F.min(hashes) != F.max(hashes)).alias("conflict"), F.count("*").alias("rows"))
        .select(key, *[F.col(f"__x.{c}").alias(c) for c in rest], "conflict", "rows")
    )
