"""Evidence from landed results of web searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspan.functions.tokens import canonical_url, content_key, host_of, quality_tier
from tallyspan.session import cut

# Confidence of a search result, snippets used, and characters kept of a result.
CONFIDENCE, SNIPPETS, CHARACTERS = 0.55, 5, 8_000


def in_domains(host: Column, domains: list[str]) -> Column:
    """Whether a host is one of the domains or below one; any host if there are none."""
    fits = F.lit(not domains)
    for d in domains:
        fits = fits | (host == d.lower()) | host.endswith("." + d.lower())
    return fits


def web_evidence(results: DataFrame, search: list[str], domains: list[str] | None = None) -> DataFrame:
    """Search results as evidence: ``search`` keys, rank, title, url, domain, quality_tier, content, published_at, confidence.

    ``results``: search keys, rank (the provider's), title, url, description, extra_snippets, published_at. A result drops out
    if its address can't be made canonical or lies outside the domains, if it has no text, or if an earlier result of its
    search has the same address or the same content (apart from blanks and case). Ranks keep their gaps.

    A result counts as earlier only if it is kept itself. A result that loses by its address alone must not take a later one's
    content with it, so results are settled in rounds: each keeps those that are first in both respects and drops what equals
    them, until none is open. A round is two aggregations by (search, address) and (search, content); no group is gathered.
    """
    url, parts = canonical_url(F.col("url")), F.concat(F.array(F.trim(F.coalesce("description", F.lit("")))), F.slice(F.transform(F.coalesce("extra_snippets", F.array().cast("array<string>")), lambda x: F.trim(x)), 1, SNIPPETS))
    content = F.substring(F.array_join(F.array_distinct(F.filter(parts, lambda x: x != "")), "\n"), 1, CHARACTERS)
    held = results.select(*search, "rank", F.trim("title").alias("title"), url.alias("url"), content.alias("content"), "published_at").where("url is not null and content <> ''")
    held = held.withColumn("domain", host_of(F.col("url"))).where(in_domains(F.col("domain"), domains or [])).withColumn("__key", F.sha2(content_key(F.col("content")), 256))
    kept = _first_of_both(held.select(*search, "rank", "url", "__key"), search)
    return (
        held.join(kept, [*search, "rank"], "left_semi")
        .select(*search, "rank", "title", "url", "domain", quality_tier(F.col("domain")).alias("quality_tier"), "content", "published_at", F.lit(CONFIDENCE).alias("confidence"))
    )


def _first_of_both(rows: DataFrame, search: list[str]) -> DataFrame:
    """search and rank of the rows that a pass in order of rank keeps: neither url nor __key seen among those kept before."""
    open_, kept = cut(rows), []
    while not open_.isEmpty():
        by_url = open_.groupBy(*search, "url").agg(F.min("rank").alias("__u"))
        by_key = open_.groupBy(*search, "__key").agg(F.min("rank").alias("__k"))
        marked = open_.join(by_url, [*search, "url"]).join(by_key, [*search, "__key"])
        first = cut(marked.where((F.col("rank") == F.col("__u")) & (F.col("rank") == F.col("__k"))).drop("__u", "__k"))
        kept.append(first)
        rest = open_.join(first.select(*search, "url"), [*search, "url"], "left_anti").join(first.select(*search, "__key"), [*search, "__key"], "left_anti")
        open_ = cut(rest)
    out = rows.limit(0).select(*search, "rank")
    for first in kept:
        out = out.unionByName(first.select(*search, "rank"))
    return out
