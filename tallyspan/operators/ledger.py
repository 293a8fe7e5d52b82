"""Evidence ledger checks: references, coverage of requirements, joins of the document library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DOC_KEYS = ["tenant_id", "user_id", "document_id"]


def broken_references(claims: DataFrame, claim: str, ids: str, evidence: DataFrame, evidence_id: str) -> DataFrame:
    """Claims' references that lead to no evidence row."""
    listed = claims.select(claim, F.explode(ids).alias(evidence_id))
    return listed.join(evidence.select(evidence_id).distinct(), evidence_id, "left_anti").select(claim, evidence_id)


def coverage(requirements: DataFrame, evidence: DataFrame, keys: list[str], document: str) -> DataFrame:
    """Per requirement (keys, minimum) the distinct documents found and whether they are enough."""
    counted = evidence.groupBy(*keys).agg(F.count_distinct(document).alias("documents"))
    return requirements.join(counted, keys, "left").select(
        *keys,
        "minimum",
        F.coalesce("documents", F.lit(0)).alias("documents"),
        (F.coalesce("documents", F.lit(0)) >= F.col("minimum")).alias("covered"),
    )


def without_manifest(documents: DataFrame, manifests: DataFrame) -> DataFrame:
    return documents.join(manifests, DOC_KEYS, "left_anti")


def library(documents: DataFrame, pages: DataFrame, manifests: DataFrame) -> DataFrame:
    """Documents with their pages and characters, and the newest manifest's status; small rows are joined, not texts."""
    sizes = (
        pages.select(*DOC_KEYS, "page_number", F.length("text").alias("n"))
        .groupBy(*DOC_KEYS, "page_number")
        .agg(F.max("n").alias("n"))
        .groupBy(*DOC_KEYS)
        .agg(F.count("*").alias("pages"), F.sum("n").alias("characters"))
    )
    newest = manifests.groupBy(*DOC_KEYS).agg(F.max_by("index_status", F.struct("indexed_at", "index_status")).alias("index_status"))
    return (
        documents.select(*DOC_KEYS, "page_count")
        .distinct()
        .join(sizes, DOC_KEYS, "left")
        .join(newest, DOC_KEYS, "left")
        .select(*DOC_KEYS, "page_count", "pages", "characters", F.coalesce("index_status", F.lit("missing")).alias("index_status"))
    )


def citations(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key and cited id of every footnote mark [^id] in a text; distinct."""
    marks = F.regexp_extract_all(text, F.lit(r"\[\^([^\]\s]+)\]"), F.lit(1))
    return texts.where(F.col(text).isNotNull()).select(key, F.explode(marks).alias("cited")).distinct()
