"""Checks of claims and reports against an evidence ledger; every issue is a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_QUOTE, MOST_CLAIMS = 8, 20
# A report's sections and the notice that it must hold.
SECTIONS = ("## Answer", "## Evidence", "## Data gaps")
NOTICE = "does not constitute investment advice"
ISSUE = ("report_id", "code", "claim_id", "evidence_id")


def valid_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """report_id, claim_id, text, status and evidence_ids of the claims that stand.

    ``claims``: report_id, claim_id, place, text, quote, evidence_ids. ``evidence``: evidence_id, content, source_type,
    content_basis, tags. Only the first ``MOST_CLAIMS`` of a report count. A claim without quote and ids is inferred. Others need a
    quote of ``LEAST_QUOTE`` characters and keep the ids, in their order, of evidence that holds it; without any they drop out. They are
    supported, or inferred where all their evidence is search snippets or any is a declared formula.
    """
    text, quote = F.trim(F.coalesce("text", F.lit(""))), F.trim(F.coalesce("quote", F.lit("")))
    ids = F.array_distinct(F.filter(F.coalesce("evidence_ids", F.array().cast("array<string>")), lambda x: F.trim(x) != ""))
    held = claims.where(F.col("place") <= MOST_CLAIMS).select("report_id", "claim_id", text.alias("text"), quote.alias("quote"), ids.alias("ids")).where("text <> ''")
    alone = held.where((F.col("quote") == "") & (F.size("ids") == 0))
    asked = held.where(F.length("quote") >= LEAST_QUOTE).select("report_id", "claim_id", "text", "quote", F.posexplode("ids").alias("at", "evidence_id"))
    backed = asked.join(evidence, "evidence_id").where(F.col("content").contains(F.col("quote")))
    snippet = (F.col("source_type") == "web") & F.coalesce(F.col("content_basis") == "search_result_snippet", F.lit(False))
    formula = F.coalesce(F.array_contains("tags", "declarative_formula"), F.lit(False))
    settled = backed.groupBy("report_id", "claim_id", "text").agg(
        F.when(F.bool_and(snippet) | F.bool_or(formula), "inferred").otherwise("supported").alias("status"),
        F.transform(F.array_sort(F.collect_list(F.struct("at", "evidence_id"))), lambda x: x["evidence_id"]).alias("evidence_ids"),
    )
    return settled.unionByName(alone.select("report_id", "claim_id", "text", F.lit("inferred").alias("status"), F.array().cast("array<string>").alias("evidence_ids")))


def _issue(rows: DataFrame, code: str, claim: Column | None = None, evidence: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select("report_id", F.lit(code).alias("code"), (none if claim is None else claim).alias("claim_id"), (none if evidence is None else evidence).alias("evidence_id"))


def report_issues(reports: DataFrame, claims: DataFrame, evidence: DataFrame, gaps: DataFrame) -> DataFrame:
    """report_id, code, claim_id and evidence_id of everything that is wrong with reports.

    ``reports``: report_id, body. ``claims``: report_id, claim_id, status, evidence_ids. ``evidence``: report_id, evidence_id,
    source_type, input_ids. ``gaps``: report_id, code. The texts stay in one scan: what later checks need of them (citations,
    footnotes, named gaps, notice) are small rows.
    """
    cited = reports.select("report_id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\[\^([^\]\s]+)\]"), F.lit(1)))).alias("evidence_id"))
    notes = reports.select("report_id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\[\^([^\]\s]+)\]:"), F.lit(1)))).alias("evidence_id"))
    named = reports.where(F.col("body").contains("## Data gaps")).select("report_id", F.regexp_extract_all("body", F.lit(r"\[([a-z_0-9]+)\]"), F.lit(1)).alias("named"))
    known = evidence.select("report_id", "evidence_id").distinct()
    on = ["report_id", "evidence_id"]
    pairs = claims.select("report_id", "claim_id", "status", F.explode_outer("evidence_ids").alias("evidence_id"))
    held = pairs.join(known.withColumn("__known", F.lit(True)), on, "left")
    backed = held.groupBy("report_id", "claim_id", "status").agg(F.bool_or(F.coalesce("__known", F.lit(False))).alias("backed"))
    bare = backed.where((F.col("status") == "supported") & ~F.col("backed"))
    rest = pairs.where("evidence_id is not null").join(bare.select("report_id", "claim_id"), ["report_id", "claim_id"], "left_anti")
    sections = F.filter(F.array(*[F.lit(s) for s in SECTIONS]), lambda s: ~F.col("body").contains(s))
    calculations = evidence.where("source_type = 'calculation'")
    no_inputs = calculations.where(F.coalesce(F.size("input_ids"), F.lit(0)) <= 0)
    inputs = calculations.select("report_id", "evidence_id", F.explode("input_ids").alias("input"))
    unknown_inputs = inputs.join(known.withColumnRenamed("evidence_id", "input"), ["report_id", "input"], "left_anti")
    unnamed = gaps.select("report_id", F.col("code").alias("gap")).distinct().join(named, "report_id").where(~F.array_contains("named", F.col("gap")))
    found = [
        _issue(reports.select("report_id", F.explode(sections).alias("s")), "report_section_missing", None, F.col("s")),
        _issue(cited.join(known, on, "left_anti"), "unknown_report_citation", None, F.col("evidence_id")),
        _issue(bare, "supported_claim_without_evidence", F.col("claim_id")),
        _issue(rest.join(cited, on, "left_anti"), "claim_citation_missing", F.col("claim_id"), F.col("evidence_id")),
        _issue(rest.join(notes, on, "left_anti"), "source_footnote_missing", F.col("claim_id"), F.col("evidence_id")),
        _issue(no_inputs, "calculation_inputs_missing", None, F.col("evidence_id")),
        _issue(unknown_inputs, "calculation_input_unknown", None, F.col("evidence_id")),
        _issue(unnamed, "data_gap_not_rendered", None, F.col("gap")),
        _issue(reports.where(~F.lower("body").contains(NOTICE)), "risk_notice_missing"),
        _issue(reports.join(known, "report_id", "left_anti"), "no_evidence"),
    ]
    return reduce(DataFrame.unionByName, found)


def without_conflicts(claims: DataFrame, conflicting_ids: DataFrame) -> DataFrame:
    """Claims none of whose evidence is in conflict. ``conflicting_ids``: evidence_id."""
    touched = claims.select("claim_id", F.explode("evidence_ids").alias("evidence_id")).join(conflicting_ids.distinct(), "evidence_id", "left_semi").select("claim_id").distinct()
    return claims.join(touched, "claim_id", "left_anti")
