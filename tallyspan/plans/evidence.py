"""Queries of search, chunks, evidence, reports, memory, payloads and metrics over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspan.functions import clean
from tallyspan.functions import tokens as tk
from tallyspan.operators import chunks, evidence, memory, metrics, search, series, state, validation, web
from tallyspan.session import cut, table
from tallyspan.sources import payloads

QUESTION = "refinancing costs of covered bonds and interest coverage"
THREAD = ["tenant_id", "user_id", "thread_id"]
DOCUMENT = ["tenant_id", "user_id", "document_id"]


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# ---- derived tables ----


def windows(s: SparkSession, d: str) -> DataFrame:
    """Overlapping windows of 800 characters, 600 apart, of all texts."""
    docs = table(s, d, "documents").where("text is not null")
    many = F.greatest(F.lit(0), F.ceil((F.length("text") - 800) / 600)).cast("int")
    held = docs.select("doc_id", "source", "text", F.explode(F.sequence(F.lit(0), many)).alias("i"))
    return held.select(
        F.concat_ws("-", F.col("doc_id").cast("string"), F.col("i").cast("string")).alias("chunk_id"), F.col("doc_id").alias("record_id"), "source",
        (F.col("i") * 600).alias("start"), F.least(F.col("i") * 600 + 800, F.length("text")).alias("stop"), F.substring("text", F.col("i") * 600 + 1, F.lit(800)).alias("content"),
    )


def _vector(s: SparkSession, d: str) -> list[float]:
    return [float(x) for x in table(s, d, "embeddings").orderBy("vec_id").select("embedding").first()["embedding"]]  # one vector: the question


def _evidence(s: SparkSession, d: str) -> DataFrame:
    """Documents as evidence for a question."""
    kind = F.when(F.col("source") == "filing", "regulatory_filing").when(F.col("source") == "web_article", "web").otherwise("document")
    return table(s, d, "documents").where("text is not null").select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("evidence_id"), F.col("text").alias("content"), F.col("company").alias("entity"), "title", F.lit(None).cast("string").alias("field_name"),
        F.lit(None).cast("double").alias("value"), kind.alias("source_type"), F.when(kind == "web", "open_web").alias("quality_tier"), F.when(F.col("lang") == "en", 0.9).otherwise(0.5).alias("confidence"),
        F.when(F.col("publish_date").isNotNull(), F.dayofmonth(F.to_date("publish_date"))).alias("rank"), F.col("n_chars").alias("cost"), evidence.group_key(F.col("company"), kind, F.col("kb_name")).alias("group"),
    )


def _source_evidence(s: SparkSession, d: str) -> DataFrame:
    """Sources as evidence of the company in their locator."""
    field = F.split_part("locator", F.lit(":"), F.lit(1))
    tags = F.when(field == "close", F.array(F.lit("market_history"))).when(field == "filing", F.array(F.lit("filing_metadata"))).otherwise(F.array().cast("array<string>"))
    return table(s, d, "sources").select(
        F.split_part("locator", F.lit(":"), F.lit(2)).alias("entity"), "source_type", field.alias("field_name"), "as_of", "published_at", tags.alias("tags"), F.col("source_id").alias("document"),
        F.col("provider").alias("domain"), F.try_element_at("metadata", F.lit("quality_tier")).alias("quality_tier"), F.lit(None).cast("string").alias("operation"),
    )


def _requirements(s: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("document", "market", "market_history", "regulatory", "filings", "macro", "calculation", "web", "knowledge", "unsupported")])
    named = table(s, d, "documents").where("company is not null").select(F.lower("company").alias("entity")).distinct().unionByName(s.createDataFrame([(None,)], "entity string"))
    asked = named.select("entity", F.explode(kinds).alias("category"))
    return asked.select(
        F.concat_ws("/", F.coalesce("entity", F.lit("any")), "category").alias("key"), "category", "entity", F.when(F.col("category") == "market", F.array(F.lit("Quotes"))).alias("fields"),
        F.lit(3).alias("minimum_documents"), F.lit(None).cast("string").alias("request_id"),
    )


def _reports(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A report per company that cites its documents: reports, claims, evidence and gaps. Only texts of public research are in
    the ledger, those without source aren't cited, those without date have no footnote, calculations are research notes."""
    docs = table(s, d, "documents").where("text is not null and company is not null").withColumn("id", F.col("doc_id").cast("string"))
    cite, note = F.when(F.col("source").isNotNull(), F.concat(F.lit("[^"), "id", F.lit("]"))), F.when(F.col("publish_date").isNotNull(), F.concat(F.lit("[^"), "id", F.lit("]: "), "file_name"))
    body = F.concat_ws("\n", F.lit("## Answer"), F.array_join(F.collect_list(cite), " "), F.lit("## Evidence"), F.array_join(F.collect_list(note), "\n"))
    parts = docs.groupBy(F.col("company").alias("report_id")).agg(body.alias("body"), F.count_if(F.col("lang") == "zh").alias("zh"), F.count_if(F.col("lang") == "de").alias("de"))
    reports = parts.select(
        "report_id", F.concat("body", F.when(F.col("zh") > F.col("de"), "\n## Data gaps\n[market_fields_missing]").otherwise(""), F.when(F.col("de") > F.col("zh"), "\nThis does not constitute investment advice.").otherwise("")).alias("body")
    )
    claims = docs.select(
        F.col("company").alias("report_id"), F.concat(F.lit("c"), "id").alias("claim_id"), F.col("title").alias("text"), F.when(F.col("lang") == "en", F.substring("text", 11, 20)).when(F.col("lang") == "de", "kurz").when(F.col("lang") == "fr", "").otherwise("no such words").alias("quote"),
        F.when(F.col("lang") == "fr", F.array().cast("array<string>")).otherwise(F.array("id")).alias("evidence_ids"), F.when(F.col("lang") == "fr", "inferred").otherwise("supported").alias("status"),
    )
    claims = claims.withColumn("place", F.lit(1))  # one claim a document; a report isn't cut here
    ledger = docs.where("kb_name = 'public_research'").select(
        F.col("company").alias("report_id"), F.col("id").alias("evidence_id"), F.col("text").alias("content"), F.when(F.col("source") == "research_note", "calculation").when(F.col("source") == "web_article", "web").otherwise("document").alias("source_type"),
        F.when(F.col("source") == "web_article", "search_result_snippet").alias("content_basis"), F.array().cast("array<string>").alias("tags"), F.when(F.col("title").isNotNull(), F.array("id", "file_name")).alias("input_ids"),
    )
    gaps = docs.where("lang = 'zh'").select(F.col("company").alias("report_id"), F.when(F.col("source").isNull(), "market_fields_missing").otherwise("source_unreadable").alias("code")).distinct()
    return reports, claims, ledger, gaps


def _thread_events(s: SparkSession, d: str) -> DataFrame:
    """One row per place of a thread: event, kind, run and an estimate of tokens."""
    e = table(s, d, "conversation_events").where("thread_id is not null and sequence is not null")
    kind = F.regexp_replace(F.lower("event_kind"), "[^a-z]", "")
    tokens = F.coalesce(tk.estimate_by_bytes(F.col("content")), F.lit(1))
    return e.groupBy(*THREAD, "sequence").agg(
        F.min("event_id").alias("event_id"), F.when(F.min(kind) == "atomicfact", "atomic_fact").otherwise(F.min(kind)).alias("kind"), F.min(F.lower(F.trim("run_id"))).alias("run_id"), F.max(tokens).alias("tokens")
    )


def _candidates(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The latest row of every memory, as candidates beside themselves: each candidate is a memory of the same user."""
    m = table(s, d, "personal_memories").where("memory_id is not null")
    one = series.last_written(m.select(*THREAD[:2], "memory_id", "kind", "title", "content", F.coalesce("updated_at", "created_at").alias("updated_at")), ["memory_id"], "updated_at", "title", "content")
    return one.select(*THREAD[:2], F.col("memory_id").alias("candidate_id"), "kind", F.concat(F.lit("Note: "), "title").alias("title"), "content"), one


def _monthly(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("symbol"), F.date_trunc("month", F.col("o_orderdate")).cast("timestamp").alias("at")).agg(F.round(F.avg("o_totalprice"), 2).alias("close"))


def _charts(s: SparkSession, d: str) -> DataFrame:
    """The monthly prices as landed chart payloads, one JSON text per symbol; urgent ones without adjusted closes."""
    rows = _monthly(s, d).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(F.unix_seconds("at").alias("t"), "close"))).alias("x"))  # months: a bounded list
    times, closes = F.transform("x", lambda v: v["t"]), F.transform("x", lambda v: v["close"])
    adjusted = F.when(~F.col("symbol").startswith("1"), F.array(F.struct(closes.alias("adjclose"))))
    result = F.struct(times.alias("timestamp"), F.struct(F.array(F.struct(closes.alias("close"))).alias("quote"), adjusted.alias("adjclose")).alias("indicators"))
    return rows.select(F.to_json(F.struct("symbol", F.struct(F.array(result).alias("result")).alias("chart"))).alias("payload"))


def _daily(s: SparkSession, d: str) -> DataFrame:
    text = F.when(F.month("at") == 5, "None").otherwise(F.col("close").cast("string"))
    rows = _monthly(s, d).groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct(F.date_format("at", "yyyy-MM-dd"), F.struct(text.alias("close"))))).alias("daily"))
    return rows.select(F.to_json(F.struct("symbol", "daily")).alias("payload"))


def _bars(s: SparkSession, d: str) -> DataFrame:
    """The prices of parts as landed bars under the keys of two providers."""
    p = table(s, d, "part")
    price = F.col("p_retailprice").cast("string")
    bar = F.when(F.col("p_size") > 25, F.create_map(F.lit("t"), F.lit("2024-02-01 00:00"), F.lit("c"), price, F.lit("o"), F.lit("0"))).otherwise(F.create_map(F.lit("time"), F.lit("1706745600"), F.lit("spj"), price, F.lit("zgj"), (F.col("p_retailprice") + 1).cast("string")))
    return p.select(F.to_json(F.struct(F.col("p_partkey").cast("string").alias("symbol"), F.array(bar).alias("bars"))).alias("payload"))


def _quotes(s: SparkSession, d: str) -> DataFrame:
    """Customers as landed quotes: the balance as price, no price for automobiles, no date for households."""
    segment = F.col("c_mktsegment")
    held = table(s, d, "customer").select(
        F.col("c_custkey").cast("string").alias("symbol"), F.col("c_name").alias("company"), F.lit("USD").alias("currency"), F.when(segment != "HOUSEHOLD", "2024-01-31").alias("as_of"),
        F.when(segment == "AUTOMOBILE", "None").otherwise(F.col("c_acctbal").cast("string")).alias("current_price"), F.when(segment == "BUILDING", F.col("c_nationkey").cast("string")).alias("trailing_pe"),
    )
    return held.select(F.to_json(F.struct(*held.columns)).alias("payload"))


def _web_results(s: SparkSession, d: str) -> DataFrame:
    src = table(s, d, "sources").where("source_type = 'web' and title is not null")
    host = F.concat(F.regexp_replace("provider", "_", "-"), F.when(F.col("provider").startswith("open"), ".example.gov:8443").otherwise(".example.com"))
    url = F.concat(F.lit("HTTPS://"), host, F.lit("/"), F.url_encode("title"), F.lit("?UTM_Source=feed&q="), F.split_part("locator", F.lit(":"), F.lit(1)), F.lit("&GCLID=x#top"))
    return src.select(F.col("provider").alias("search"), F.col("pos").alias("rank"), "title", url.alias("url"), F.col("title").alias("description"), F.array(F.concat(F.lit("  "), F.upper("title"))).alias("extra_snippets"), "published_at")


def _requests(s: SparkSession, d: str) -> DataFrame:
    """A request per customer, its operation by market segment, with the customer's figures."""
    c, segment = table(s, d, "customer"), F.col("c_mktsegment")
    op = F.when(segment == "AUTOMOBILE", "ratio").when(segment == "BUILDING", "cagr").when(segment == "FURNITURE", "loan_payment").when(segment == "HOUSEHOLD", "sharpe").when(segment == "MACHINERY", "max_drawdown").otherwise("quotient")
    bal, nation = F.col("c_acctbal"), F.col("c_nationkey").cast("double")
    inputs = F.create_map(
        F.lit("numerator"), bal, F.lit("denominator"), nation, F.lit("begin"), bal, F.lit("end"), nation + 1, F.lit("years"), nation, F.lit("principal"), bal, F.lit("rate"), nation / 1000,
        F.lit("periods"), F.lit(12.0), F.lit("periods_per_year"), F.lit(12.0), F.lit("risk_free_rate"), F.lit(0.02),
    )
    points = F.when(segment == "HOUSEHOLD", F.array(bal / 100000, nation / 100, F.lit(0.01))).when(segment == "MACHINERY", F.array(nation + 1, bal, F.lit(7.0)))
    unit = F.when(nation == 3, "EUR")
    return c.select(F.col("c_custkey").alias("request_id"), op.alias("operation"), inputs.alias("inputs"), points.alias("series"), unit.alias("unit"))


def _gaps(s: SparkSession, d: str) -> DataFrame:
    held = table(s, d, "sources").where("as_of is null")
    key = F.concat_ws("/", F.lower(F.split_part("locator", F.lit(":"), F.lit(2))), F.when(F.col("source_type") == "web", "web").when(F.col("source_type") == "market_data", "market").otherwise("regulatory"))
    return held.select(F.col("pos").alias("gap_id"), F.lit("as_of_missing").alias("code"), F.when(F.col("source_type") != "calculation", key).alias("requirement"), F.col("published_at").isNotNull().alias("resolvable"))


def queries() -> dict:
    t = table
    docs = lambda s, d: t(s, d, "documents").where("text is not null").select("doc_id", "source", "lang", "text")
    vectors = lambda s, d, key: t(s, d, "embeddings").select(F.col("vec_id").alias(key), "embedding")
    readable = lambda s, d: search.readable(
        t(s, d, "personal_documents").select(*DOCUMENT, "created_at").distinct(),
        t(s, d, "personal_documents").select(*DOCUMENT[::2], F.col("user_id").alias("principal_id"), F.when(F.col("text_characters").isNull(), "write").otherwise("read").alias("permission")), DOCUMENT[::2], "u_desk_shared",
    )
    q = {
        # search
        "search_lexical": lambda s, d: search.search(windows(s, d), QUESTION, "lexical", 20).select("rank", "record_id", "chunk_id", _r("score").alias("score"), "start", "stop", F.md5("content").alias("content")),
        "search_vector": lambda s, d: search.search(t(s, d, "embeddings").select("vec_id"), QUESTION, "vector", 10, vectors=vectors(s, d, "vec_id"), query_vector=_vector(s, d), key="vec_id", record=None).select("vec_id", "rank", _r("score").alias("score")),
        "search_hybrid": lambda s, d: search.search(
            docs(s, d), QUESTION, "hybrid", 20, vectors=vectors(s, d, "doc_id"), query_vector=_vector(s, d), diversify_by="source", key="doc_id", text="text", record=None, least=0.2
        ).select("doc_id", "rank", _r("score", 8).alias("score")),
        "search_acl": lambda s, d: search.search(docs(s, d), QUESTION, "lexical", 20, {"source": "press_release", "lang": None}, {"source": "filing"}, key="doc_id", text="text", record=None).select("doc_id", "rank", _r("score").alias("score")),
        "search_trace": lambda s, d: search.trace(docs(s, d).select("doc_id", "text", F.col("doc_id").alias("record_id"), F.lit(0).alias("start"), F.length("text").alias("stop")), QUESTION, "hybrid", 20, vectors(s, d, "doc_id"), _vector(s, d), "doc_id", "text", "record_id", 0.2),
        "readable_pages": lambda s, d: readable(s, d).join(t(s, d, "personal_document_pages").select(*DOCUMENT, "page_number").distinct(), DOCUMENT).groupBy(*DOCUMENT).agg(F.count("*").alias("pages"), F.max("created_at").alias("created_at")),
        # chunks
        "chunk_windows": lambda s, d: chunks.chunk_windows(t(s, d, "documents"), 120, 30).select("doc_id", "chunk", "chunk_id", "start", "stop", "first", "last"),
        "block_titles": lambda s, d: chunks.layout_blocks(t(s, d, "personal_document_pages"), DOCUMENT).select(*DOCUMENT, "page", "number", "label", "title"),
        "block_groups": lambda s, d: chunks.block_groups(chunks.layout_blocks(t(s, d, "personal_document_pages"), DOCUMENT), DOCUMENT).select(*DOCUMENT, F.col("part").cast("bigint").alias("part"), "label", "title", "page", F.md5("content").alias("content")),
        "table_parts": lambda s, d: chunks.split_tables(chunks.block_groups(chunks.layout_blocks(t(s, d, "personal_document_pages"), DOCUMENT), DOCUMENT), 80).select(*DOCUMENT, "part", "label", "piece", F.length("content").alias("characters")),
        # evidence
        "evidence_selection": lambda s, d: evidence.selected(evidence.scored(_evidence(s, d), QUESTION).drop("content"), 60_000).select("evidence_id", "group", "cost", F.col("place").cast("bigint").alias("place")),
        "evidence_types": lambda s, d: evidence.type_counts(t(s, d, "sources")),
        "coverage_by_category": lambda s, d: evidence.coverage_by_category(_requirements(s, d), _source_evidence(s, d)).select("key", "candidates", F.col("documents").cast("bigint").alias("documents"), F.array_join("missing_fields", ",").alias("missing_fields"), "covered"),
        "recovered_gaps": lambda s, d: evidence.recovered_gaps(_gaps(s, d), cut(evidence.coverage_by_category(_requirements(s, d), _source_evidence(s, d)))).select("gap_id", "resolved"),
        "conflicting_evidence": lambda s, d: evidence.conflicting_evidence(
            t(s, d, "orders").select(F.col("o_orderkey").alias("evidence_id"), F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("field_name"), F.year("o_orderdate").alias("period"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("request_id"), F.col("o_orderstatus").alias("value"))
        ).select("entity", "field_name", "period", "values", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids")),
        "merged_sources": lambda s, d: evidence.merged_sources(t(s, d, "sources").select("source_id", "pos", "source_type", "title", "provider", "retrieved_at"), "source_id", ["source_type", "title", "provider", "retrieved_at"], "pos").select("source_id", "title", "conflict", "rows"),
        # reports
        "valid_claims": lambda s, d: (lambda r: validation.valid_claims(r[1], r[2].drop("report_id")))(_reports(s, d)).select("report_id", "claim_id", "status", F.array_join("evidence_ids", ",").alias("evidence_ids")),
        "report_issues": lambda s, d: validation.report_issues(*_reports(s, d)).select("report_id", "code", "claim_id", "evidence_id"),
        # memory and ledger
        "fact_suffix": lambda s, d: memory.suffix_within(_thread_events(s, d).where("kind = 'atomic_fact'"), THREAD, "sequence", "tokens", 150).select(*THREAD, "sequence", "used"),
        "run_groups": lambda s, d: memory.run_groups(_thread_events(s, d), THREAD, "sequence").select(*THREAD, "sequence", F.col("run_number").cast("bigint").alias("run_number")),
        "thread_windows": lambda s, d: memory.window_projection(_thread_events(s, d), THREAD, 800, 150, 300).withColumn("covered_through", F.coalesce("covered_through", F.lit(0))),
        "last_runs": lambda s, d: memory.last_runs(_thread_events(s, d).where("run_id is not null").groupBy(*THREAD, "run_id").agg(F.max("sequence").alias("last_sequence")), THREAD, "last_sequence", "run_id", 3).select(*THREAD, "run_id", F.col("place").cast("bigint").alias("place")),
        "memory_slots": lambda s, d: memory.memory_slots(*_candidates(s, d), THREAD[:2]).select("candidate_id", "memory_id", _r("similarity").alias("similarity")),
        "promoted_memories": lambda s, d: memory.promoted(t(s, d, "conversation_events").where("entities is not null and run_id is not null").select("user_id", F.explode("entities").alias("entity"), F.lower(F.trim("run_id")).alias("run_id"), F.when(F.lower("event_kind").contains("fact"), "explicit").alias("explicitness")), ["user_id", "entity"]),
        "newest_memories": lambda s, d: state.newest_first(t(s, d, "personal_memories").select(*THREAD[:2], "memory_id", F.coalesce("updated_at", "created_at").alias("at")).distinct(), THREAD[:2], "at", "memory_id", 2).select(*THREAD[:2], "memory_id", "at", F.col("place").cast("bigint").alias("place")),
        "message_pages": lambda s, d: state.newest_first(_thread_events(s, d).where(F.col("kind").isin("usermessage", "assistantmessage") & (F.col("sequence") > 2)).withColumn("at", -F.col("sequence")), THREAD, "at", "event_id", 5).select(*THREAD, "sequence", "event_id"),
        "run_ids": lambda s, d: t(s, d, "conversation_events").where("run_id is not null").select(*THREAD, F.lower(F.trim("run_id")).alias("run")).distinct(),
        "appended_ledger": lambda s, d: (lambda e: state.appended(e.where("received_at <= '2025-12-31'").groupBy("event_id").agg(F.min("thread_id").alias("thread_id"), F.min("sequence").alias("sequence")), e.where("received_at > '2025-12-31'").groupBy("event_id").agg(F.min("thread_id").alias("thread_id"), F.min("occurred_at").alias("at")).where("at is not null"), "thread_id", "event_id", ["at", "event_id"]).select("thread_id", "event_id", F.col("sequence").cast("bigint").alias("sequence")))(t(s, d, "conversation_events").where("thread_id is not null and received_at is not null")),
        "thread_views": lambda s, d: state.first_and_last(t(s, d, "conversation_events").where("occurred_at is not null").select(*THREAD, "occurred_at", F.coalesce("event_id", F.lit("")).alias("event_id")).withColumn("last_event", F.col("event_id")), THREAD, "occurred_at", ["event_id"], ["last_event"]),
        # payloads
        "landed_charts": lambda s, d: payloads.chart_history(payloads.parsed(_charts(s, d), "payload", "history")).select("symbol", F.col("date").cast("string").alias("date"), "close", "price_basis"),
        "landed_daily": lambda s, d: payloads.tail(payloads.daily_history(payloads.parsed(_daily(s, d), "payload", "daily")), "symbol", "date", payloads.DAILY_TAILS["1mo"]).select("symbol", F.col("date").cast("string").alias("date"), "close"),
        "landed_bars": lambda s, d: payloads.bar_history(payloads.parsed(_bars(s, d), "payload", "bars")).select("symbol", F.col("date").cast("string").alias("date"), "open", "high", "low", "close", "volume"),
        "quote_facts": lambda s, d: payloads.quote_facts(payloads.parsed(_quotes(s, d), "payload", "quote")).select("symbol", "field_name", "value", "unit"),
        "quote_gaps": lambda s, d: payloads.quote_gaps(payloads.parsed(_quotes(s, d), "payload", "quote"), ["current_price", "trailing_pe"]).select("symbol", "code", F.array_join("missing", ",").alias("missing")),
        "web_evidence": lambda s, d: web.web_evidence(_web_results(s, d), ["search"], ["example.gov", "example.com"]).select("search", "rank", "url", "domain", "quality_tier"),
        # metrics and cleaning
        "metric_batch": lambda s, d: metrics.metric_batch(_requests(s, d)).select("request_id", "operation", "error_code", _r("value").alias("value")),
        "point_ratios": lambda s, d: (lambda o: metrics.point_ratio(
            o.select(F.col("o_custkey").alias("pair_id"), F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("period"), F.col("o_orderstatus").alias("unit"), F.col("o_totalprice").alias("value")),
            t(s, d, "customer").select(F.col("c_custkey").alias("pair_id"), F.col("c_custkey").alias("entity"), F.lit(1995).alias("period"), F.lit("F").alias("unit"), F.greatest("c_acctbal", F.lit(0.0)).alias("value")),
        ))(series.last_written(t(s, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey")),
        "stable_ids": lambda s, d: t(s, d, "sources").select("pos", clean.stable_id("source", provider=F.col("provider"), published_at=F.col("published_at"), title=F.col("title")).alias("id")),
        "field_names": lambda s, d: t(s, d, "documents").where("title is not null").select("doc_id", clean.field_name(F.col("title")).alias("name")),
        "normal_texts": lambda s, d: t(s, d, "documents").where("text is not null").select("doc_id", clean.normal_text(F.col("text")).alias("text")),
        "redacted_props": lambda s, d: t(s, d, "events").select("event_id", clean.redact_json(F.concat(F.lit('{"token": "t", "nested": [{"Password": 1, "content": "c", "props": '), F.coalesce("props", F.lit("null")), F.lit("}]}"))).alias("props")),
        "term_similarity": lambda s, d: t(s, d, "documents").where("text is not null and title is not null").select("doc_id", _r(memory.jaccard(tk.token_set(F.col("title")), tk.token_set(F.col("text")))).alias("similarity")),
        "quality_tiers": lambda s, d: _web_results(s, d).select("rank", tk.quality_tier(tk.host_of(F.col("url"))).alias("tier"), tk.content_key(F.col("title")).alias("key")),
        "script_estimates": lambda s, d: t(s, d, "documents").where("text is not null").select("doc_id", tk.estimate_by_script(F.col("text")).alias("tokens")),
        "index_readiness": lambda s, d: t(s, d, "personal_documents").select(*DOCUMENT).distinct().join(series.last_written(t(s, d, "personal_index_manifests").select(*DOCUMENT, "indexed_at", "index_status", "embedding_dimension"), DOCUMENT, "indexed_at", "index_status"), DOCUMENT, "left").groupBy("tenant_id", "user_id").agg(
            F.count("*").alias("documents"), F.coalesce(F.bool_and(F.coalesce(F.col("index_status") == "vector_ready", F.lit(False))), F.lit(False)).alias("ready"), F.count_distinct("embedding_dimension").alias("dimensions")
        ),
    }
    return q


_EVENTS = r"""ev AS (SELECT tenant_id, user_id, thread_id, sequence, min(event_id) AS event_id, CASE WHEN min(k) = 'atomicfact' THEN 'atomic_fact' ELSE min(k) END AS kind,
  min(lower(trim(run_id))) AS run_id, max(coalesce(greatest(1, (strlen(content) + 2) // 3), 1)) AS tokens
  FROM (SELECT *, regexp_replace(lower(event_kind), '[^a-z]', '', 'g') AS k FROM conversation_events WHERE thread_id IS NOT NULL AND sequence IS NOT NULL) GROUP BY tenant_id, user_id, thread_id, sequence)"""

_MONTHS = "m AS (SELECT o_orderpriority AS symbol, CAST(date_trunc('month', o_orderdate) AS DATE) AS day, round(avg(o_totalprice), 2) AS close FROM orders GROUP BY ALL)"

_COVERAGE = """req AS (SELECT concat(coalesce(entity, 'any'), '/', category) AS key, entity, category FROM (SELECT DISTINCT lower(company) AS entity FROM documents WHERE company IS NOT NULL UNION ALL SELECT NULL),
  (SELECT unnest(['document', 'market', 'market_history', 'regulatory', 'filings', 'macro', 'calculation', 'web', 'knowledge', 'unsupported']) AS category)),
se AS (SELECT lower(split_part(locator, ':', 2)) AS entity, source_type, split_part(locator, ':', 1) AS field, coalesce(as_of, '') <> '' AS dated, coalesce(published_at, '') <> '' AS published,
  source_id, provider, coalesce(metadata['quality_tier'] = 'public_authority', false) AS authority FROM sources),
met AS (SELECT r.key, r.category, se.* FROM req r JOIN se ON (r.entity IS NULL OR r.entity = se.entity) AND CASE r.category
  WHEN 'document' THEN source_type = 'document' WHEN 'market' THEN source_type = 'market_data' AND field <> 'close' AND dated WHEN 'market_history' THEN field = 'close' AND dated
  WHEN 'regulatory' THEN source_type = 'regulatory_filing' AND dated WHEN 'filings' THEN field = 'filing' AND published WHEN 'macro' THEN source_type = 'macro_data' AND dated
  WHEN 'calculation' THEN source_type = 'calculation' WHEN 'web' THEN source_type = 'web' ELSE false END),
cnt AS (SELECT key, count(*) AS n, count(DISTINCT source_id) AS docs, bool_or(authority) OR count(DISTINCT provider) >= 2 AS web_enough, bool_or(field = 'quotes') AS quoted FROM met GROUP BY key),
cov AS (SELECT key, category, CASE WHEN category = 'web' AND NOT coalesce(web_enough, false) THEN 0 ELSE coalesce(n, 0) END AS candidates, coalesce(docs, 0) AS documents,
  CASE WHEN category = 'market' AND NOT coalesce(quoted, false) THEN 'quotes' ELSE '' END AS missing_fields FROM req LEFT JOIN cnt USING (key)),
covered AS (SELECT key, candidates, documents, missing_fields, category = 'knowledge' OR (candidates > 0 AND missing_fields = '' AND NOT (category = 'document' AND documents < 3)) AS covered FROM cov)"""


def oracle_sql(tokens: str, bm25, cosine: str) -> dict[str, str]:
    """SQL beside the queries; ``tokens``, ``bm25(where)`` and ``cosine`` are the shared pieces over documents and embeddings."""
    han = r"\x{4e00}-\x{9fff}"
    terms = lambda name, source, key, text: rf"""{name}_r AS (SELECT {key}, unnest(regexp_extract_all({text}, '[A-Za-z0-9_]+|[{han}]+')) AS r FROM {source}),
{name} AS (SELECT {key}, lower(r) AS term FROM {name}_r WHERE regexp_matches(r, '^[A-Za-z0-9_]') AND length(r) > 1
  UNION SELECT {key}, substr(r, CAST(i AS BIGINT), 2) FROM (SELECT {key}, r, unnest(range(1, length(r))) AS i FROM {name}_r WHERE regexp_matches(r, '^[{han}]') AND length(r) > 1))"""  # noqa: E731
    hybrid = f"""WITH {bm25()}, {cosine},
a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM bm), b AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM cos WHERE score >= 0.2 AND vec_id IN (SELECT doc_id FROM documents WHERE text IS NOT NULL)),
x AS (SELECT doc_id, CAST(coalesce(1.0 / (60 + a.r), 0) AS DOUBLE) + CAST(coalesce(1.0 / (60 + b.r), 0) AS DOUBLE) AS score FROM a FULL JOIN b USING (doc_id))"""
    blocks = """WITH p AS (SELECT DISTINCT tenant_id, user_id, document_id, page_number AS page, blocks_json FROM personal_document_pages WHERE json_valid(blocks_json)),
u AS (SELECT tenant_id, user_id, document_id, page, unnest(CAST(blocks_json AS JSON[])) AS x, generate_subscripts(CAST(blocks_json AS JSON[]), 1) - 1 AS pos FROM p WHERE json_type(CAST(blocks_json AS JSON)) = 'ARRAY'),
r AS (SELECT tenant_id, user_id, document_id, page, CAST(coalesce(TRY_CAST(json_extract_string(x, '$.order') AS INT), pos) AS INT) AS number, coalesce(lower(json_extract_string(x, '$.label')), 'text') AS label, trim(json_extract_string(x, '$.content'), ' ') AS content,
  CASE WHEN lower(json_extract_string(x, '$.label')) = 'heading' THEN trim(json_extract_string(x, '$.content'), ' ') ELSE nullif(trim(json_extract_string(x, '$.paragraph_title'), ' '), '') END AS own FROM u),
h AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY tenant_id, user_id, document_id ORDER BY page, number ROWS UNBOUNDED PRECEDING) AS title FROM r WHERE content <> '' AND label NOT IN ('header', 'header_image', 'footer', 'footer_image', 'number'))"""
    return {
        "block_titles": f"{blocks} SELECT tenant_id, user_id, document_id, page, number, label, title FROM h",
        "block_groups": f"""{blocks}, f AS (SELECT *, label IN ('table', 'chart') AS alone, CASE WHEN label IN ('table', 'chart') OR row_number() OVER w = 1 OR lag(title) OVER w IS DISTINCT FROM title OR lag(page) OVER w <> page OR lag(label) OVER w IN ('table', 'chart') THEN 1 ELSE 0 END AS b
  FROM h WINDOW w AS (PARTITION BY tenant_id, user_id, document_id ORDER BY page, number)),
g AS (SELECT *, sum(b) OVER (PARTITION BY tenant_id, user_id, document_id ORDER BY page, number ROWS UNBOUNDED PRECEDING) - 1 AS part FROM f)
SELECT tenant_id, user_id, document_id, CAST(part AS BIGINT) AS part, CASE WHEN bool_or(alone) THEN max(label) ELSE 'text' END AS label, min(title) AS title, min(page) AS page, md5(string_agg(content, chr(10) || chr(10) ORDER BY number, content)) AS content FROM g GROUP BY tenant_id, user_id, document_id, part""",
        "search_lexical": rf"""WITH w AS (SELECT doc_id AS record_id, text AS whole, unnest(range(0, greatest(0, CAST(ceil((length(text) - 800) / 600.0) AS BIGINT)) + 1)) AS i FROM documents WHERE text IS NOT NULL),
c AS (SELECT concat(record_id, '-', i) AS chunk_id, record_id, i * 600 AS start, least(i * 600 + 800, length(whole)) AS stop, substr(whole, i * 600 + 1, 800) AS content FROM w),
runs AS (SELECT chunk_id, unnest(regexp_extract_all(content, '[A-Za-z0-9_]+|[{han}]+')) AS r FROM c),
tok AS (SELECT chunk_id, lower(r) AS term FROM runs WHERE regexp_matches(r, '^[A-Za-z0-9_]') AND length(r) > 1 UNION ALL SELECT chunk_id, r FROM runs WHERE regexp_matches(r, '^[{han}]') AND length(r) = 1
  UNION ALL SELECT chunk_id, substr(r, CAST(i AS BIGINT), 2) FROM (SELECT chunk_id, r, unnest(range(1, length(r))) AS i FROM runs WHERE regexp_matches(r, '^[{han}]') AND length(r) > 1)),
len AS (SELECT c.chunk_id, count(t.term) AS n FROM c LEFT JOIN tok t USING (chunk_id) GROUP BY c.chunk_id),
q AS (SELECT lower(r) AS term, count(*) AS qf FROM (SELECT unnest(regexp_extract_all('{QUESTION}', '[A-Za-z0-9_]+')) AS r) WHERE length(r) > 1 GROUP BY 1),
tf AS (SELECT chunk_id, term, count(*) AS f FROM tok WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS d FROM tf GROUP BY term), st AS (SELECT count(*) AS nn, avg(n) AS av FROM len),
bm AS (SELECT chunk_id, sum(qf * ln(1 + (nn - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * greatest(n, 1) / av))) AS score FROM tf JOIN q USING (term) JOIN df USING (term) JOIN len USING (chunk_id) CROSS JOIN st GROUP BY chunk_id),
top AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS place FROM bm QUALIFY place <= 20), h AS (SELECT * FROM top JOIN c USING (chunk_id)),
g AS (SELECT *, max(stop) OVER (PARTITION BY record_id ORDER BY start, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start >= reach OR stop <= start THEN 1 ELSE 0 END) OVER (PARTITION BY record_id ORDER BY start, place ROWS UNBOUNDED PRECEDING) AS isl FROM g),
m AS (SELECT record_id, CASE WHEN count(*) = 1 THEN min(chunk_id) ELSE substr(sha256(string_agg(chunk_id, chr(0) ORDER BY start, place)), 1, 32) END AS chunk_id, max(score) AS score, min(place) AS place, min(start) AS start, max(stop) AS stop FROM i GROUP BY record_id, isl)
SELECT row_number() OVER (ORDER BY place) AS rank, record_id, chunk_id, round(score, 6) AS score, start, stop, md5(substr(text, CAST(start AS BIGINT) + 1, CAST(stop - start AS BIGINT))) AS content FROM m JOIN documents ON doc_id = record_id""",
        "search_vector": f"WITH {cosine} SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank, round(score, 6) AS score FROM cos WHERE score >= 0.5 QUALIFY rank <= 10",
        "search_hybrid": f"""{hybrid}, y AS (SELECT x.*, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) > 1 AS later FROM x JOIN documents USING (doc_id))
SELECT doc_id, row_number() OVER (ORDER BY later, score DESC, doc_id) AS rank, round(score, 8) AS score FROM y QUALIFY rank <= 20""",
        "search_acl": f"WITH {bm25('source = ' + chr(39) + 'filing' + chr(39))} SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, round(score, 6) AS score FROM bm QUALIFY rank <= 20",
        "search_trace": f"""{hybrid} SELECT (SELECT count(text) FROM documents) AS candidates, (SELECT count(*) FROM bm) AS lexical, (SELECT count(*) FROM cos WHERE vec_id IN (SELECT doc_id FROM documents WHERE text IS NOT NULL)) AS vector_before_threshold,
(SELECT count(*) FROM b) AS vector, least(20, (SELECT count(*) FROM x)) AS chosen, least(20, (SELECT count(*) FROM x)) AS returned""",
        "readable_pages": """SELECT d.tenant_id, d.user_id, d.document_id, count(*) AS pages, max(created_at) AS created_at FROM (SELECT DISTINCT tenant_id, user_id, document_id, created_at FROM personal_documents) d
JOIN (SELECT DISTINCT tenant_id, user_id, document_id, page_number FROM personal_document_pages) p USING (tenant_id, user_id, document_id)
WHERE EXISTS (SELECT 1 FROM personal_documents a WHERE a.tenant_id = d.tenant_id AND a.document_id = d.document_id AND a.user_id = 'u_desk_shared' AND a.text_characters IS NOT NULL) GROUP BY ALL""",
        "evidence_selection": f"""WITH RECURSIVE t AS (SELECT DISTINCT lower(r) AS term FROM (SELECT unnest(regexp_extract_all('{QUESTION}', '[A-Za-z0-9_]+')) AS r) WHERE length(r) > 1),
e AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS evidence_id, n_chars AS cost, lower(concat_ws(' ', text, company, title)) AS hay, CASE source WHEN 'filing' THEN 'regulatory_filing' WHEN 'web_article' THEN 'web' ELSE 'document' END AS st,
  CASE WHEN lang = 'en' THEN 0.9 ELSE 0.5 END AS conf, coalesce(-day(CAST(publish_date AS DATE)), -100000) AS rp, company, kb_name FROM documents WHERE text IS NOT NULL),
s AS (SELECT e.*, (SELECT count(*) FROM t WHERE contains(e.hay, t.term)) AS ov, concat_ws('::', coalesce(nullif(company, ''), 'global'), st, kb_name) AS grp, CASE st WHEN 'regulatory_filing' THEN 5 WHEN 'document' THEN 2 ELSE 1 END AS sp, CASE st WHEN 'web' THEN 1 ELSE 0 END AS qp FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ov DESC, sp DESC, qp DESC, conf DESC, rp DESC, evidence_id DESC) AS turn FROM s),
p AS (SELECT *, row_number() OVER (ORDER BY turn, grp) AS place FROM n),
f(place, used, taken) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), false
  UNION ALL SELECT p.place, CASE WHEN used + cost <= 60000 THEN used + cost ELSE used END, used + cost <= 60000 FROM f JOIN p ON p.place = f.place + 1)
SELECT evidence_id, grp AS "group", cost, place FROM f JOIN p USING (place) WHERE taken""",
        "evidence_types": "SELECT source_type, count(s.pos) AS rows FROM (SELECT unnest(['regulatory_filing', 'calculation', 'market_data', 'macro_data', 'document', 'web', 'user_input']) AS source_type) LEFT JOIN sources s USING (source_type) GROUP BY source_type",
        "coverage_by_category": f"WITH {_COVERAGE} SELECT * FROM covered",
        "recovered_gaps": f"""WITH {_COVERAGE}, g AS (SELECT pos AS gap_id, published_at IS NOT NULL AS resolvable, CASE WHEN source_type <> 'calculation' THEN concat(lower(split_part(locator, ':', 2)), '/', CASE source_type WHEN 'web' THEN 'web' WHEN 'market_data' THEN 'market' ELSE 'regulatory' END) END AS key FROM sources WHERE as_of IS NULL)
SELECT gap_id, resolvable AND CASE WHEN key IS NULL THEN (SELECT bool_and(covered) FROM covered) ELSE coalesce(covered, false) END AS resolved FROM g LEFT JOIN covered USING (key)""",
        "conflicting_evidence": """SELECT o_custkey AS entity, o_orderpriority AS field_name, CAST(year(o_orderdate) AS INT) AS period, count(DISTINCT o_orderstatus) AS values, array_to_string(list_sort(list(DISTINCT o_orderkey)), ',') AS ids
FROM orders GROUP BY 1, 2, 3 HAVING count(DISTINCT o_orderstatus) > 1""",
        "merged_sources": "SELECT source_id, arg_min_null(title, pos) AS title, count(DISTINCT concat_ws(chr(1), coalesce(source_type, chr(0)), coalesce(title, chr(0)), coalesce(provider, chr(0)), coalesce(retrieved_at, chr(0)))) > 1 AS conflict, count(*) AS rows FROM sources GROUP BY source_id",
        "valid_claims": """WITH d AS (SELECT company, concat('c', doc_id) AS claim_id, CAST(doc_id AS VARCHAR) AS id, lang, title, text, source, kb_name,
  trim(CASE WHEN lang = 'en' THEN substr(text, 11, 20) WHEN lang = 'de' THEN 'kurz' WHEN lang = 'fr' THEN '' ELSE 'no such words' END) AS quote FROM documents WHERE text IS NOT NULL AND company IS NOT NULL AND trim(coalesce(title, '')) <> '')
SELECT company AS report_id, claim_id, 'inferred' AS status, '' AS evidence_ids FROM d WHERE lang = 'fr'
UNION ALL SELECT company, claim_id, CASE WHEN source = 'web_article' THEN 'inferred' ELSE 'supported' END, id FROM d WHERE coalesce(lang, '') <> 'fr' AND length(quote) >= 8 AND kb_name = 'public_research' AND contains(text, quote)""",
        "report_issues": """WITH d AS (SELECT company AS report_id, CAST(doc_id AS VARCHAR) AS id, *, kb_name = 'public_research' AS known, source IS NOT NULL OR publish_date IS NOT NULL AS cited FROM documents WHERE text IS NOT NULL AND company IS NOT NULL),
r AS (SELECT report_id, count(*) FILTER (lang = 'zh') AS zh, count(*) FILTER (lang = 'de') AS de, bool_or(known) AS has_any FROM d GROUP BY 1), n AS (SELECT CAST(NULL AS VARCHAR) AS none)
SELECT report_id, 'report_section_missing' AS code, none AS claim_id, '## Data gaps' AS evidence_id FROM r, n WHERE NOT zh > de
UNION ALL SELECT report_id, 'unknown_report_citation', none, id FROM d, n WHERE cited AND NOT coalesce(known, false)
UNION ALL SELECT report_id, 'supported_claim_without_evidence', concat('c', id), none FROM d, n WHERE coalesce(lang, '') <> 'fr' AND NOT coalesce(known, false)
UNION ALL SELECT report_id, 'claim_citation_missing', concat('c', id), id FROM d WHERE coalesce(lang, '') <> 'fr' AND known AND NOT cited
UNION ALL SELECT report_id, 'source_footnote_missing', concat('c', id), id FROM d WHERE coalesce(lang, '') <> 'fr' AND known AND publish_date IS NULL
UNION ALL SELECT report_id, 'calculation_inputs_missing', none, id FROM d, n WHERE known AND source = 'research_note' AND title IS NULL
UNION ALL SELECT report_id, 'calculation_input_unknown', none, id FROM d, n WHERE known AND source = 'research_note' AND title IS NOT NULL
UNION ALL SELECT report_id, 'data_gap_not_rendered', none, 'source_unreadable' FROM r, n WHERE zh > de AND EXISTS (SELECT 1 FROM d WHERE d.report_id = r.report_id AND d.lang = 'zh' AND d.source IS NOT NULL)
UNION ALL SELECT report_id, 'risk_notice_missing', none, none FROM r, n WHERE NOT de > zh
UNION ALL SELECT report_id, 'no_evidence', none, none FROM r, n WHERE NOT coalesce(has_any, false)""",
        "fact_suffix": f"WITH {_EVENTS} SELECT tenant_id, user_id, thread_id, sequence, CAST(sum(tokens) OVER (PARTITION BY tenant_id, user_id, thread_id ORDER BY sequence DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM ev WHERE kind = 'atomic_fact' QUALIFY used <= 150",
        "run_groups": f"""WITH {_EVENTS}, x AS (SELECT *, CASE WHEN lag(sequence) OVER w IS NULL OR lag(run_id) OVER w IS DISTINCT FROM run_id THEN 1 ELSE 0 END AS b FROM ev WINDOW w AS (PARTITION BY tenant_id, user_id, thread_id ORDER BY sequence))
SELECT tenant_id, user_id, thread_id, sequence, CAST(sum(b) OVER (PARTITION BY tenant_id, user_id, thread_id ORDER BY sequence ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_number FROM x""",
        "thread_windows": f"""WITH {_EVENTS}, p AS (SELECT * FROM ev WHERE kind <> 'atomic_fact'), x AS (SELECT *, CASE WHEN lag(sequence) OVER w IS NULL OR lag(run_id) OVER w IS DISTINCT FROM run_id THEN 1 ELSE 0 END AS b FROM p WINDOW w AS (PARTITION BY tenant_id, user_id, thread_id ORDER BY sequence)),
g AS (SELECT *, sum(b) OVER (PARTITION BY tenant_id, user_id, thread_id ORDER BY sequence ROWS UNBOUNDED PRECEDING) AS rn FROM x), rc AS (SELECT tenant_id, user_id, thread_id, rn, sum(tokens) AS cost FROM g GROUP BY ALL),
ru AS (SELECT *, sum(cost) OVER w AS used, row_number() OVER w AS k FROM rc WINDOW w AS (PARTITION BY tenant_id, user_id, thread_id ORDER BY rn DESC ROWS UNBOUNDED PRECEDING)),
nw AS (SELECT tenant_id, user_id, thread_id, count(*) AS recent, min(sequence) AS first_ FROM g JOIN (SELECT tenant_id, user_id, thread_id, rn FROM ru WHERE k = 1 OR used <= 300) USING (tenant_id, user_id, thread_id, rn) GROUP BY ALL),
fs AS (SELECT *, sum(tokens) OVER (PARTITION BY tenant_id, user_id, thread_id ORDER BY sequence DESC ROWS UNBOUNDED PRECEDING) AS used FROM ev WHERE kind = 'atomic_fact' QUALIFY used <= 150),
ft AS (SELECT tenant_id, user_id, thread_id, count(*) AS facts, sum(tokens) AS ftok FROM fs GROUP BY ALL), sz AS (SELECT tenant_id, user_id, thread_id, count(*) AS events, CAST(sum(tokens) AS BIGINT) AS tokens FROM p GROUP BY ALL),
j AS (SELECT *, tokens + coalesce(ftok, 0) >= 680 AND recent < events AS compact FROM sz LEFT JOIN ft USING (tenant_id, user_id, thread_id) JOIN nw USING (tenant_id, user_id, thread_id))
SELECT tenant_id, user_id, thread_id, events, tokens, coalesce(facts, 0) AS facts, compact, CASE WHEN compact THEN first_ - 1 ELSE 0 END AS covered_through, CASE WHEN compact THEN recent ELSE events END AS "left" FROM j""",
        "last_runs": f"""WITH {_EVENTS}, r AS (SELECT tenant_id, user_id, thread_id, run_id, max(sequence) AS last FROM ev WHERE run_id IS NOT NULL GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, user_id, thread_id ORDER BY last DESC, run_id DESC) AS k FROM r QUALIFY k <= 3) SELECT tenant_id, user_id, thread_id, run_id, row_number() OVER (PARTITION BY tenant_id, user_id, thread_id ORDER BY k DESC) AS place FROM n""",
        "memory_slots": f"""WITH l AS (SELECT tenant_id, user_id, memory_id, kind, title, content, coalesce(updated_at, created_at) AS written FROM personal_memories WHERE memory_id IS NOT NULL),
m AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY written DESC NULLS LAST, title DESC NULLS LAST, content DESC NULLS LAST) = 1), c AS (SELECT *, concat('Note: ', title) AS note FROM m),
{terms("mt", "m", "memory_id", "concat_ws(' ', title, content)")}, {terms("ct", "c", "memory_id", "concat_ws(' ', 'Note: ' || title, content)")},
ms AS (SELECT memory_id, count(*) AS n FROM mt GROUP BY 1), cs AS (SELECT memory_id, count(*) AS n FROM ct GROUP BY 1),
p AS (SELECT ct.memory_id AS candidate_id, mt.memory_id, count(*) AS both_ FROM ct JOIN mt USING (term) GROUP BY ALL),
s AS (SELECT p.*, m.written, both_ / (cs.n + ms.n - both_) AS sim FROM p JOIN cs ON cs.memory_id = p.candidate_id JOIN ms ON ms.memory_id = p.memory_id JOIN c ON c.memory_id = p.candidate_id JOIN m ON m.memory_id = p.memory_id
  WHERE c.tenant_id = m.tenant_id AND c.user_id = m.user_id AND c.kind = m.kind)
SELECT candidate_id, memory_id, round(sim, 6) AS similarity FROM s WHERE sim >= 0.6 QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY sim DESC, written DESC, memory_id DESC) = 1""",
        "promoted_memories": """SELECT user_id, entity, count(DISTINCT run) AS runs, coalesce(bool_or(fact), false) AS explicit, coalesce(bool_or(fact), false) OR count(DISTINCT run) >= 2 AS promoted
FROM (SELECT user_id, unnest(entities) AS entity, lower(trim(run_id)) AS run, contains(lower(event_kind), 'fact') AS fact FROM conversation_events WHERE entities IS NOT NULL AND run_id IS NOT NULL) GROUP BY ALL""",
        "newest_memories": """SELECT tenant_id, user_id, memory_id, written AS "at", row_number() OVER (PARTITION BY tenant_id, user_id ORDER BY written DESC NULLS LAST, memory_id DESC) AS place FROM (SELECT DISTINCT tenant_id, user_id, memory_id, coalesce(updated_at, created_at) AS written FROM personal_memories) QUALIFY place <= 2""",
        "message_pages": f"WITH {_EVENTS} SELECT tenant_id, user_id, thread_id, sequence, event_id FROM ev WHERE kind IN ('usermessage', 'assistantmessage') AND sequence > 2 QUALIFY row_number() OVER (PARTITION BY tenant_id, user_id, thread_id ORDER BY sequence) <= 5",
        "run_ids": "SELECT DISTINCT tenant_id, user_id, thread_id, lower(trim(run_id)) AS run FROM conversation_events WHERE run_id IS NOT NULL",
        "appended_ledger": """WITH e AS (SELECT * FROM conversation_events WHERE thread_id IS NOT NULL AND received_at IS NOT NULL), l AS (SELECT event_id, min(thread_id) AS thread_id, min(sequence) AS sequence FROM e WHERE received_at <= TIMESTAMPTZ '2025-12-31 00:00:00+00' GROUP BY 1),
n AS (SELECT event_id, min(thread_id) AS thread_id, min(occurred_at) AS happened FROM e WHERE received_at > TIMESTAMPTZ '2025-12-31 00:00:00+00' GROUP BY 1 HAVING min(occurred_at) IS NOT NULL)
SELECT n.thread_id, n.event_id, CAST(coalesce(last, 0) + row_number() OVER (PARTITION BY n.thread_id ORDER BY happened, n.event_id) AS BIGINT) AS sequence FROM n LEFT JOIN (SELECT thread_id, max(sequence) AS last FROM l GROUP BY 1) USING (thread_id) WHERE n.event_id NOT IN (SELECT event_id FROM l)""",
        "thread_views": """WITH x AS (SELECT tenant_id, user_id, thread_id, occurred_at, coalesce(event_id, '') AS id FROM conversation_events WHERE occurred_at IS NOT NULL)
SELECT tenant_id, user_id, thread_id, first(id ORDER BY occurred_at, id) AS event_id, first(id ORDER BY occurred_at DESC, id DESC) AS last_event, min(occurred_at) AS created_at, max(occurred_at) AS updated_at FROM x GROUP BY ALL""",
        "landed_charts": f"WITH {_MONTHS} SELECT symbol, CAST(day AS VARCHAR) AS date, close, CASE WHEN symbol LIKE '1%' THEN 'close' ELSE 'adjusted_close' END AS price_basis FROM m WHERE close > 0",
        "landed_daily": f"WITH {_MONTHS} SELECT symbol, CAST(day AS VARCHAR) AS date, close FROM m WHERE month(day) <> 5 AND close > 0 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY day DESC) <= 23",
        "landed_bars": "SELECT CAST(p_partkey AS VARCHAR) AS symbol, '2024-02-01' AS date, p_retailprice AS open, CASE WHEN p_size > 25 THEN p_retailprice ELSE p_retailprice + 1 END AS high, p_retailprice AS low, p_retailprice AS close, CAST(0 AS DOUBLE) AS volume FROM part",
        "quote_facts": "SELECT CAST(c_custkey AS VARCHAR) AS symbol, 'current_price' AS field_name, c_acctbal AS value, 'USD' AS unit FROM customer WHERE c_mktsegment <> 'AUTOMOBILE' UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'trailing_pe', CAST(c_nationkey AS DOUBLE), 'ratio' FROM customer WHERE c_mktsegment = 'BUILDING'",
        "quote_gaps": """SELECT CAST(c_custkey AS VARCHAR) AS symbol, 'market_provider_unavailable' AS code, 'current_price,trailing_pe' AS missing FROM customer WHERE c_mktsegment = 'AUTOMOBILE'
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'market_fields_missing', 'trailing_pe' FROM customer WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING') UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'market_as_of_missing', '' FROM customer WHERE c_mktsegment = 'HOUSEHOLD'""",
        "web_evidence": """WITH x AS (SELECT provider AS search, pos AS rank, title, concat(replace(provider, '_', '-'), CASE WHEN provider LIKE 'open%' THEN '.example.gov' ELSE '.example.com' END) AS domain, CASE WHEN provider LIKE 'open%' THEN ':8443' ELSE '' END AS port, split_part(locator, ':', 1) AS q FROM sources WHERE source_type = 'web' AND title IS NOT NULL)
SELECT search, rank, concat('https://', domain, port, '/', replace(url_encode(title), '%20', '+'), '?q=', q) AS url, domain, CASE WHEN port <> '' THEN 'public_authority' ELSE 'open_web' END AS quality_tier FROM x QUALIFY row_number() OVER (PARTITION BY search, lower(regexp_replace(title, '\\s+', ' ', 'g')) ORDER BY rank) = 1""",
        "metric_batch": """WITH c AS (SELECT *, CAST(c_nationkey AS DOUBLE) AS k, c_acctbal AS b, c_acctbal / 100000 AS r1, CAST(c_nationkey AS DOUBLE) / 100 AS r2, CAST(c_nationkey AS DOUBLE) / 1000 AS i FROM customer),
s AS (SELECT *, list_stddev_samp([r1, r2, 0.01::DOUBLE]) AS sd, power((1 + r1) * (1 + r2) * 1.01, 4.0) - 1 AS ann, least(0, b / greatest(k + 1, b) - 1, 7 / greatest(k + 1, b, 7) - 1) AS dd FROM c),
x AS (SELECT c_custkey AS request_id, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'ratio' WHEN 'BUILDING' THEN 'cagr' WHEN 'FURNITURE' THEN 'loan_payment' WHEN 'HOUSEHOLD' THEN 'sharpe' WHEN 'MACHINERY' THEN 'max_drawdown' ELSE 'quotient' END AS operation, * FROM s)
SELECT request_id, operation, CASE WHEN operation = 'quotient' THEN 'unknown_operation' WHEN k = 3 THEN 'invalid_unit' WHEN operation = 'ratio' AND k = 0 THEN 'division_by_zero' WHEN operation = 'cagr' AND (b <= 0 OR k <= 0) THEN 'invalid_input'
  WHEN operation = 'sharpe' AND r1 <= -1 THEN 'invalid_return' WHEN operation = 'max_drawdown' AND b <= 0 THEN 'invalid_series' WHEN operation = 'sharpe' AND sd = 0 THEN 'division_by_zero' END AS error_code,
 CASE WHEN error_code IS NOT NULL THEN NULL WHEN operation = 'ratio' THEN round(b / k, 6) WHEN operation = 'cagr' THEN round(power((k + 1) / b, 1 / k) - 1, 6) WHEN operation = 'loan_payment' THEN round(CASE WHEN i = 0 THEN b / 12 ELSE b * i * power(1 + i, 12) / (power(1 + i, 12) - 1) END, 6)
  WHEN operation = 'sharpe' THEN round((ann - 0.02) / (sd * sqrt(12)), 6) WHEN operation = 'max_drawdown' THEN round(dd, 6) END AS value FROM x""",
        "point_ratios": """WITH o AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
e AS (SELECT o_custkey AS pair_id, o_totalprice AS n, greatest(c_acctbal, 0) AS d, CASE WHEN year(o_orderdate) <> 1995 THEN 'period_mismatch' WHEN o_orderstatus <> 'F' THEN 'unit_mismatch' WHEN c_acctbal <= 0 THEN 'division_by_zero' END AS error_code FROM o JOIN customer ON c_custkey = o_custkey)
SELECT pair_id, CASE WHEN error_code IS NULL THEN round(n / d, 6) END AS value, error_code FROM e""",
        "stable_ids": r"""WITH j AS (SELECT pos, [CASE WHEN x IS NULL THEN 'null' ELSE concat('"', replace(replace(replace(replace(replace(x, '\', '\\'), '"', '\"'), chr(9), '\t'), chr(10), '\n'), chr(13), '\r'), '"') END FOR x IN [provider, published_at, title]] AS v FROM sources)
SELECT pos, concat('source_', substr(sha256(concat('{"provider": ', v[1], ', "published_at": ', v[2], ', "title": ', v[3], '}')), 1, 20)) AS id FROM j""",
        "field_names": "SELECT doc_id, regexp_replace(regexp_replace(lower(title), '[''’]', '', 'g'), '[\\s-]+', '_', 'g') AS name FROM documents WHERE title IS NOT NULL",
        "redacted_props": """SELECT event_id, concat('{"nested": [{"Password": "***REDACTED***", "content": "***OMITTED***", "props": ', coalesce(props, 'null'), '}], "token": "***REDACTED***"}') AS props FROM events""",
        "term_similarity": f"""WITH d AS (SELECT * FROM documents WHERE text IS NOT NULL AND title IS NOT NULL), {terms("a", "d", "doc_id", "title")}, {terms("b", "d", "doc_id", "text")},
n AS (SELECT doc_id, count(*) AS n FROM a GROUP BY 1), m AS (SELECT doc_id, count(*) AS m FROM b GROUP BY 1), i AS (SELECT doc_id, count(*) AS i FROM a JOIN b USING (doc_id, term) GROUP BY 1)
SELECT doc_id, round(coalesce(coalesce(i, 0) / nullif(coalesce(n, 0) + coalesce(m, 0) - coalesce(i, 0), 0), 0), 6) AS similarity FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN i USING (doc_id)""",
        "quality_tiers": "SELECT pos AS rank, CASE WHEN provider LIKE 'open%' THEN 'public_authority' ELSE 'open_web' END AS tier, lower(regexp_replace(title, '\\s+', ' ', 'g')) AS key FROM sources WHERE source_type = 'web' AND title IS NOT NULL",
        "script_estimates": r"""WITH c AS (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[^\x{3400}-\x{9fff}]', '', 'g')) AS h, length(regexp_replace(text, '[\w\s\x0B\x{3400}-\x{9fff}]', '', 'g')) AS p FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(ceil((70 * h + 35 * (n - h - p) + 65 * p) * 11 / 1000) AS BIGINT) AS tokens FROM c""",
        "index_readiness": """WITH m AS (SELECT * FROM personal_index_manifests QUALIFY row_number() OVER (PARTITION BY tenant_id, user_id, document_id ORDER BY indexed_at DESC NULLS LAST, index_status DESC NULLS LAST) = 1)
SELECT tenant_id, user_id, count(*) AS documents, bool_and(coalesce(index_status = 'vector_ready', false)) AS ready, count(DISTINCT embedding_dimension) AS dimensions FROM (SELECT DISTINCT tenant_id, user_id, document_id FROM personal_documents) LEFT JOIN m USING (tenant_id, user_id, document_id) GROUP BY ALL""",
    }
