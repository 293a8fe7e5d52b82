"""Words and bigrams of a text, token estimates and stable ids, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RUNS = "[A-Za-z0-9_]+|[一-鿿]+"


def tokens(text: Column) -> Column:
    """Lower-case Latin words of two or more characters, and overlapping bigrams of Han runs (a lone character stays)."""
    runs = F.regexp_extract_all(text, F.lit(RUNS), F.lit(0))
    han = lambda r: r.rlike("^[一-鿿]")
    latin = lambda r: F.when(F.length(r) > 1, F.array(F.lower(r))).otherwise(F.array().cast("array<string>"))
    pairs = lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))
    )
    return F.flatten(F.transform(runs, lambda r: F.when(han(r), pairs(r)).otherwise(latin(r))))


def count_tokens(text: Column) -> Column:
    """The number of ``tokens`` without building them: Latin words of two or more, and Han characters less runs."""
    latin = F.regexp_count(text, F.lit("[A-Za-z0-9_]{2,}"))
    han = F.length(F.regexp_replace(text, "[^一-鿿]+", "")) - F.regexp_count(text, F.lit("[一-鿿]{2,}"))
    return latin + F.when(text.rlike("[一-鿿]"), han).otherwise(0)  # most texts need one pass only


def term_hits(text: Column, terms: list[str]) -> Column:
    """Every use of one of the Latin terms among the ``tokens`` of a text, found in one search."""
    latin = [t for t in terms if not "一" <= t[0] <= "鿿"]
    if not latin:
        return F.array().cast("array<string>")
    return F.regexp_extract_all(F.lower(text), F.lit(f"(?<![a-z0-9_])(?:{'|'.join(latin)})(?![a-z0-9_])"), F.lit(0))


def times_in(hits: Column, term: str, text: Column) -> Column:
    """How often a term is among the hits; Han terms are counted in the text."""
    if "一" <= term[0] <= "鿿":
        return count_term(text, term)
    return F.size(F.filter(hits, lambda x: x == F.lit(term)))


def count_term(text: Column, term: str) -> Column:
    """How often one term is among the ``tokens`` of a text; bigrams overlap, so they are counted by looking ahead."""
    if "一" <= term[0] <= "鿿":
        pattern = f"(?={term})" if len(term) > 1 else f"(?<![一-鿿]){term}(?![一-鿿])"
        return F.regexp_count(text, F.lit(pattern))
    # A pattern that begins with a literal is searched for by skipping; what stands before is looked at afterwards.
    return F.regexp_count(F.lower(text), F.lit(f"{term}(?![a-z0-9_])(?<![a-z0-9_]{term})"))


def estimate_by_script(text: Column) -> Column:
    """ceil((0.7 Han + 0.35 other + 0.65 marks) * 1.1), in whole hundredths so that no sum of fractions is rounded."""
    han = F.length(F.regexp_replace(text, "[^㐀-鿿]", ""))
    marks = F.length(F.regexp_replace(text, r"[\w\s㐀-鿿]", ""))
    other = F.length(text) - han - marks
    return F.ceil((70 * han + 35 * other + 65 * marks) * 11 / 1000).cast("bigint")


def estimate_by_bytes(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((F.octet_length(text) + 2) / 3)).cast("bigint")


def content_id(*parts: Column) -> Column:
    """SHA-256 over the parts, set apart by a zero character."""
    return F.sha2(F.concat_ws("\u0000", *parts), 256)


def canonical_url(url: Column) -> Column:
    """http(s) only and without credentials; lower-case scheme, host and port, no fragment, no tracking parameters, the others
    decoded and encoded again in their order, path at least '/'. Null for anything else."""
    part = lambda name: F.try_parse_url(url, F.lit(name))
    host, authority = F.lower(part("HOST")), F.lower(part("AUTHORITY"))
    pair = lambda q: F.struct(
        F.try_url_decode(F.regexp_extract(q, "^([^=]*)", 1)).alias("name"), F.try_url_decode(F.regexp_extract(q, "^[^=]*=(.*)$", 1)).alias("value")
    )
    pairs = F.transform(F.filter(F.split(F.coalesce(part("QUERY"), F.lit("")), "&"), lambda q: q != ""), pair)
    kept = F.filter(pairs, lambda p: p["name"].isNotNull() & ~p["name"].rlike("(?i)^(?:utm_.*|gclid|fbclid)$"))
    query = F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(F.coalesce(p["value"], F.lit(""))))), "&")
    path = F.coalesce(F.nullif(part("PATH"), F.lit("")), F.lit("/"))
    scheme = F.lower(part("PROTOCOL"))
    fits = scheme.isin("http", "https") & host.rlike(r"^(?:[a-z0-9-]+\.)+[a-z]{2,63}$") & part("USERINFO").isNull()
    return F.when(fits, F.concat(scheme, F.lit("://"), authority, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def quality_tier(host: Column) -> Column:
    """public_authority for hosts of governments and their bodies (fixed values), else open_web."""
    return F.when(host.rlike(r"\.(gov|gov\.cn|gov\.uk|europa\.eu)$") | host.isin("sec.gov", "federalreserve.gov"), "public_authority").otherwise("open_web")


def content_key(text: Column) -> Column:
    """White space collapsed, lower case: texts that differ in nothing else are one."""
    return F.lower(F.regexp_replace(text, r"\s+", " "))


def token_set(text: Column) -> Column:
    """Distinct Latin words of two characters or more and bigrams of Han runs; a lone Han character gives none."""
    return F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) > 1))
