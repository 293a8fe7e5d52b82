"""All queries of the library's operators over the given tables, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspan.functions import text
from tallyspan.functions import tokens as tk
from tallyspan.functions.formula import compile_formula
from tallyspan.operators import facts, instants, ledger, retrieval, selection, series, state
from tallyspan.plans import evidence, library
from tallyspan.session import table
from tallyspan.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUESTION = "refinancing costs of covered bonds and interest coverage"
K = 20

# ---- SQL pieces that several checks share ----
_TOK = r"""runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+|[\x{4e00}-\x{9fff}]+')) AS r FROM documents WHERE text IS NOT NULL),
tok AS (SELECT doc_id, lower(r) AS term FROM runs WHERE regexp_matches(r, '^[A-Za-z0-9_]') AND length(r) > 1
  UNION ALL SELECT doc_id, r FROM runs WHERE regexp_matches(r, '^[\x{4e00}-\x{9fff}]') AND length(r) = 1
  UNION ALL SELECT doc_id, substr(r, CAST(i AS BIGINT), 2) FROM (SELECT doc_id, r, unnest(range(1, length(r))) AS i FROM runs
            WHERE regexp_matches(r, '^[\x{4e00}-\x{9fff}]') AND length(r) > 1))"""


def _bm25_sql(where: str = "TRUE") -> str:
    return f"""{_TOK},
cand AS (SELECT doc_id FROM documents WHERE text IS NOT NULL AND {where}),
len AS (SELECT c.doc_id, count(t.term) AS n FROM cand c LEFT JOIN tok t USING (doc_id) GROUP BY c.doc_id),
q AS (SELECT lower(r) AS term, count(*) AS qf FROM (SELECT unnest(regexp_extract_all('{QUESTION}', '[A-Za-z0-9_]+')) AS r) WHERE length(r) > 1 GROUP BY 1),
tf AS (SELECT doc_id, term, count(*) AS f FROM tok JOIN cand USING (doc_id) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS d FROM tf GROUP BY term),
st AS (SELECT count(*) AS nn, avg(n) AS av FROM len),
bm AS (SELECT doc_id, sum(qf * ln(1 + (nn - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * greatest(n, 1) / av))) AS score
  FROM tf JOIN q USING (term) JOIN df USING (term) JOIN len USING (doc_id) CROSS JOIN st GROUP BY doc_id)"""


_COS = """qv AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
cos AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS score FROM embeddings, qv)"""

_COS_EACH = """cos AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 12) AS score
  FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0)"""


def _bm25_each_sql(where: str = "TRUE") -> str:
    return f"""WITH {_TOK},
cand AS (SELECT doc_id FROM documents WHERE text IS NOT NULL AND {where}),
len AS (SELECT c.doc_id, count(t.term) AS n FROM cand c LEFT JOIN tok t USING (doc_id) GROUP BY c.doc_id),
tf AS (SELECT doc_id, term, count(*) AS f FROM tok JOIN cand USING (doc_id) GROUP BY ALL),
q AS (SELECT doc_id AS query_id, term, count(*) AS qf FROM tok WHERE doc_id % 100 = 0 GROUP BY ALL),
df AS (SELECT term, count(*) AS d FROM tf GROUP BY term),
st AS (SELECT count(*) AS nn, avg(n) AS av FROM len),
bm AS (SELECT query_id, doc_id, round(sum(qf * ln(1 + (nn - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * greatest(n, 1) / av))), 12) AS score
  FROM tf JOIN q USING (term) JOIN df USING (term) JOIN len USING (doc_id) CROSS JOIN st GROUP BY query_id, doc_id)
SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= {K}"""


_MONTHS = """m AS (SELECT o_orderpriority AS series, date_trunc('month', o_orderdate) AS month, avg(o_totalprice) AS value FROM orders GROUP BY ALL)"""
_FACTS = """f AS (SELECT n_name AS entity, CAST(year(o_orderdate) AS VARCHAR) AS period, sum(l_extendedprice) AS revenue,
  sum(l_extendedprice * (1 - l_discount)) AS gross_profit, sum(l_extendedprice * (1 - l_discount) * (1 - l_tax)) AS net_income
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""


def _monthly(s: SparkSession, d: str) -> DataFrame:
    return (
        table(s, d, "orders")
        .groupBy(F.col("o_orderpriority").alias("series"), F.date_trunc("month", F.col("o_orderdate")).alias("month"))
        .agg(F.avg("o_totalprice").alias("value"))
    )


def _facts(s: SparkSession, d: str) -> DataFrame:
    """Facts per nation and year, unpivoted; the dimension tables are small and Spark broadcasts them by size."""
    lines = table(s, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount", "l_tax")
    orders = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    sides = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    keyed = orders.join(sides, F.col("o_custkey") == F.col("c_custkey"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    wide = (
        lines.join(keyed, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("n_name").alias("entity"), F.year("o_orderdate").cast("string").alias("period"))
        .agg(
            F.sum("l_extendedprice").alias("revenue"),
            F.sum(net).alias("gross_profit"),
            F.sum(net * (1 - F.col("l_tax"))).alias("net_income"),
        )
    )
    return wide.unpivot(["entity", "period"], ["revenue", "gross_profit", "net_income"], "field", "value").withColumn("unit", F.lit("USD"))


def _query_vector(s: SparkSession, d: str) -> list[float]:
    row = table(s, d, "embeddings").orderBy("vec_id").select("embedding").first()  # one vector: the question
    return [float(x) for x in row["embedding"]]


def _scored(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    return retrieval.bm25(docs, QUESTION).join(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source")), "doc_id")


def _every_hundredth(df: DataFrame, key: str, held: str) -> DataFrame:
    """The rows whose id is divisible by 100, as queries."""
    return df.where((F.col(key) % 100 == 0) & F.col(held).isNotNull()).select(F.col(key).alias("query_id"), held)


def _bm25_each(docs: DataFrame, held: str = "true") -> DataFrame:
    best = retrieval.bm25_each(docs.where(held), _every_hundredth(docs, "doc_id", "text"), K)
    return best.select("query_id", "doc_id", _r("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _cosine_each(vectors: DataFrame, k: int | None, least: float = -1.0) -> DataFrame:
    best = retrieval.cosine_each(vectors, _every_hundredth(vectors, "vec_id", "embedding"), k, least)
    return best.select("query_id", "vec_id", _r("score").alias("score"), *([F.col("rank").cast("bigint").alias("rank")] if k else []))


def _urls(s: SparkSession, d: str) -> DataFrame:
    """Links derived from the sources: provider and locator with the tracking noise that search results carry."""
    src = table(s, d, "sources")
    link = F.concat(
        F.lit("HTTPS://WWW."), F.regexp_replace("provider", "_", "-"), F.lit(".Example.COM/"), F.regexp_replace("locator", ":", "/"),
        F.lit("?utm_source=feed&id="), F.col("source_id"), F.lit("&gclid=x#top"),
    )
    return src.select("pos", "source_id", link.alias("url"))


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def queries() -> dict[str, Query]:
    t = table
    q: dict[str, Query] = {
        "p2_found": lambda s, d: instants.changed_instants(t(s, d, "sources"), t(s, d, "source_providers")),
        # retrieval
        "bm25_topk": lambda s, d: retrieval.top(retrieval.bm25(t(s, d, "documents"), QUESTION), K).select("doc_id", _r("score").alias("score"), F.col("rank").cast("bigint").alias("rank")),
        "bm25_filtered": lambda s, d: retrieval.top(retrieval.bm25(t(s, d, "documents").where("source = 'filing'"), QUESTION), K).select("doc_id", _r("score").alias("score"), F.col("rank").cast("bigint").alias("rank")),
        "term_frequencies": lambda s, d: retrieval.postings(t(s, d, "documents")).groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").alias("occurrences")),
        "token_counts": lambda s, d: t(s, d, "documents").select("doc_id", F.coalesce(tk.count_tokens(F.col("text")), F.lit(0)).cast("bigint").alias("n_tokens")),
        "cosine_topk": lambda s, d: retrieval.top(retrieval.cosine(t(s, d, "embeddings"), _query_vector(s, d)), K, "vec_id").select("vec_id", _r("score").alias("score"), F.col("rank").cast("bigint").alias("rank")),
        "cosine_threshold": lambda s, d: retrieval.cosine(t(s, d, "embeddings"), _query_vector(s, d)).where("score >= 0.2").select("vec_id", _r("score").alias("score")),
        "bm25_topk_each": lambda s, d: _bm25_each(t(s, d, "documents")),
        "bm25_filtered_each": lambda s, d: _bm25_each(t(s, d, "documents"), "source = 'filing'"),
        "cosine_topk_each": lambda s, d: _cosine_each(t(s, d, "embeddings"), K),
        "cosine_threshold_each": lambda s, d: _cosine_each(t(s, d, "embeddings"), None, 0.2),
        "rrf_hybrid": lambda s, d: retrieval.top(
            retrieval.fuse(retrieval.bm25(t(s, d, "documents"), QUESTION), retrieval.cosine(t(s, d, "embeddings"), _query_vector(s, d)).withColumnRenamed("vec_id", "doc_id"), "doc_id"), K
        ).select("doc_id", _r("score", 8).alias("score"), F.col("rank").cast("bigint").alias("rank")),
        "diversified_topk": lambda s, d: retrieval.diversify(_scored(s, d), "source", K).select("doc_id", "source", F.col("position").cast("bigint").alias("position")),
        "retrieval_trace": lambda s, d: retrieval.bm25(t(s, d, "documents"), QUESTION).agg(F.count("*").alias("hits"), _r(F.max("score")).alias("best")).crossJoin(t(s, d, "documents").agg(F.count("text").alias("candidates"))),
        "overlap_merge": lambda s, d: retrieval.merge_overlaps(
            t(s, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("start"), (F.unix_micros(F.col("ts").cast("timestamp")) + (F.col("value") * 60000000).cast("bigint")).alias("stop")), ["user_id"]
        ),
        # series
        "returns_by_series": lambda s, d: series.returns(_monthly(s, d), "series", "month", "value").select("series", "month", _r("change").alias("change")),
        "risk_pack": lambda s, d: series.risk_pack(_monthly(s, d), "series", "month", "value", 12).select(
            "series", "points", *[_r(c).alias(c) for c in ("total_return", "annualized_return", "annualized_volatility", "sharpe", "max_drawdown")]
        ),
        "latest_previous_change": lambda s, d: series.latest_change(_monthly(s, d), "series", "month", "value").select("series", *[_r(c, 4).alias(c) for c in ("latest", "previous", "difference")]),
        "last_written_daily": lambda s, d: series.last_written(
            t(s, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", "ts", "value"), ["user_id", "day"], "ts", "event_id"
        ).select("user_id", F.col("day").cast("string").alias("day"), "event_id", "value"),
        "scalar_formulas": lambda s, d: t(s, d, "customer").where("c_acctbal > 0").select(
            "c_custkey",
            _r(series.future_value(F.col("c_acctbal"), F.lit(0.05), F.lit(3))).alias("future_value"),
            _r(series.present_value(F.col("c_acctbal"), F.lit(0.05), F.lit(3))).alias("present_value"),
            _r(series.loan_payment(F.col("c_acctbal"), F.lit(0.01), F.lit(12))).alias("loan_payment"),
        ),
        "cagr_by_nation": lambda s, d: (lambda f: f.groupBy("entity").agg(F.min_by("value", "period").alias("b"), F.max_by("value", "period").alias("e"), F.count("*").alias("n")).select("entity", _r(series.cagr(F.col("b"), F.col("e"), (F.col("n") - 1).cast("double"))).alias("cagr")))(_facts(s, d).where("field = 'revenue'")),
        # facts
        "derived_ratios": lambda s, d: facts.derive_ratios(_facts(s, d)).select("entity", "period", "ratio", _r("value").alias("value")),
        "conflicting_flags": lambda s, d: facts.conflicts(t(s, d, "lineitem"), ["l_orderkey"], "l_returnflag"),
        "latest_order": lambda s, d: facts.latest(t(s, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"),
        # selection
        "interleaved": lambda s, d: selection.interleave(_scored(s, d), "source", [F.desc("score"), "doc_id"], 40).select("doc_id", "source", F.col("place").cast("bigint").alias("place")),
        "greedy_budget": lambda s, d: selection.greedy_fill(
            retrieval.ranked(retrieval.bm25(t(s, d, "documents"), QUESTION)).join(t(s, d, "documents").select("doc_id", "n_chars"), "doc_id"), 20000, "n_chars", "rank"
        ).select("doc_id", F.col("rank").cast("bigint").alias("rank"), "n_chars"),
        # ledger and library
        "coverage": lambda s, d: ledger.coverage(
            t(s, d, "mix_targets").select("source").distinct().withColumn("minimum", F.lit(50)), t(s, d, "documents").where("text is not null"), ["source"], "company"
        ),
        "library": lambda s, d: ledger.library(t(s, d, "personal_documents"), t(s, d, "personal_document_pages"), t(s, d, "personal_index_manifests")),
        "without_manifest": lambda s, d: ledger.without_manifest(t(s, d, "personal_documents"), t(s, d, "personal_index_manifests")).select("tenant_id", "user_id", "document_id"),
        "broken_references": lambda s, d: ledger.broken_references(
            t(s, d, "conversation_events").where("entities is not null").select("event_id", "entities"), "event_id", "entities",
            t(s, d, "documents").where("kb_name = 'personal_knowledge' AND lang = 'de'").select(F.trim(F.regexp_extract("title", "^(.*?) [–-] ", 1)).alias("entity")), "entity"
        ).distinct(),
        "formula_margin": lambda s, d: t(s, d, "lineitem").select(
            "l_orderkey", "l_linenumber",
            _r(compile_formula("(revenue - cost) / revenue", {"revenue": F.col("l_extendedprice"), "cost": F.col("l_extendedprice") * (1 - F.col("l_tax"))})).alias("margin"),
        ),
        "citations": lambda s, d: ledger.citations(t(s, d, "conversation_events"), "event_id", "content"),
        # text utilities
        "token_estimates": lambda s, d: t(s, d, "documents").where("text is not null").select("doc_id", tk.estimate_by_bytes(F.col("text")).alias("by_bytes")),
        "hidden_credentials": lambda s, d: t(s, d, "conversation_events").where("content is not null").select(
            "event_id", text.hide_credentials(F.concat(F.lit("Token: "), F.coalesce("run_id", F.lit("none")), F.lit("; "), "content")).alias("message")
        ),
        "content_ids": lambda s, d: t(s, d, "documents").select("doc_id", F.substring(tk.content_id(F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))), 1, 20).alias("content_id")),
        "canonical_urls": lambda s, d: _urls(s, d).select("pos", tk.canonical_url(F.col("url")).alias("url")),
        "first_per_url": lambda s, d: _urls(s, d).groupBy(tk.canonical_url(F.col("url")).alias("url")).agg(F.min("pos").alias("pos")),
        # state
        "current_memories": lambda s, d: state.current_view(t(s, d, "personal_memories").select("memory_id", "kind", "title", F.coalesce("updated_at", "created_at").alias("written_at")), ["memory_id"], "written_at", "title").select("memory_id", "kind", "title", "written_at", F.col("created_at_first").alias("first_at")),
        "appended_once": lambda s, d: state.appended_once(t(s, d, "conversation_events").select("event_id", F.md5(F.coalesce("content", F.lit(""))).alias("body")), "event_id", ["body"]),
        "run_states": lambda s, d: state.run_states(t(s, d, "conversation_events")),
        "retention": lambda s, d: state.kept_after(t(s, d, "events"), "ts", "2024-01-15").groupBy("event_type").agg(F.count("*").alias("n")),
        "dense_sequence": lambda s, d: state.dense_sequence(t(s, d, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "dense"),
        "budget_usage": lambda s, d: t(s, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count("*").alias("events"), F.count_distinct("event_type").alias("kinds")),
        "json_props": lambda s, d: t(s, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k")),
        # extensions
        "tumbling_counts": lambda s, d: t(s, d, "events").groupBy(F.date_trunc("day", F.col("ts")).alias("day"), "event_type").agg(F.count("*").alias("n")),
        "rollup_revenue": lambda s, d: t(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")),
        "pricing_summary": lambda s, d: t(s, d, "lineitem").where("l_shipdate <= '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), _r(F.avg("l_discount")).alias("avg_disc"), F.count("*").alias("n")),
        "stream_deduplicated": lambda s, d: jobs.run_to_files(
            jobs.deduplicated(jobs.event_stream(s, d, "conversation_events", "occurred_at").select("event_id", "occurred_at").where("occurred_at is not null"), "event_id", "occurred_at", "30 days")
        ).select("event_id"),
        "stream_tumbling": lambda s, d: jobs.run_to_latest(
            jobs.tumbling(jobs.event_stream(s, d, "events", "ts"), "ts", "1 day", "1 hour", "event_type", "value"), ["window_start", "event_type"]
        ).withColumn("total", _r("total")),
    }
    return q | evidence.queries() | library.queries()


def oracle_sql() -> dict[str, str]:
    bm = _bm25_sql()
    return evidence.oracle_sql(_TOK, _bm25_sql, _COS) | library.oracle_sql() | {
        "bm25_topk": f"WITH {bm} SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm ORDER BY score DESC, doc_id LIMIT {K}",
        "bm25_filtered": f"WITH {_bm25_sql('source = ' + chr(39) + 'filing' + chr(39))} SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm ORDER BY score DESC, doc_id LIMIT {K}",
        "term_frequencies": f"WITH {_TOK} SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM tok GROUP BY term",
        "token_counts": f"WITH {_TOK} SELECT d.doc_id, count(term) AS n_tokens FROM documents d LEFT JOIN tok USING (doc_id) GROUP BY d.doc_id",
        "cosine_topk": f"WITH {_COS} SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM cos ORDER BY score DESC, vec_id LIMIT {K}",
        "cosine_threshold": f"WITH {_COS} SELECT vec_id, round(score, 6) AS score FROM cos WHERE score >= 0.2",
        "bm25_topk_each": _bm25_each_sql(),
        "bm25_filtered_each": _bm25_each_sql("source = 'filing'"),
        "cosine_topk_each": f"WITH {_COS_EACH} SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM cos QUALIFY rank <= {K}",
        "cosine_threshold_each": f"WITH {_COS_EACH} SELECT query_id, vec_id, round(score, 6) AS score FROM cos WHERE score >= 0.2",
        "rrf_hybrid": f"""WITH {bm}, {_COS},
a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM bm),
b AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM cos),
x AS (SELECT doc_id, coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0) AS score FROM a FULL JOIN b USING (doc_id))
SELECT doc_id, round(CAST(score AS DOUBLE), 8) AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM x ORDER BY score DESC, doc_id LIMIT {K}""",
        "diversified_topk": f"""WITH {bm}, x AS (SELECT doc_id, coalesce(source, '') AS source, score FROM bm JOIN documents USING (doc_id)),
y AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) > 1 AS later FROM x)
SELECT doc_id, source, row_number() OVER (ORDER BY later, score DESC, doc_id) AS position FROM y ORDER BY later, score DESC, doc_id LIMIT {K}""",
        "retrieval_trace": f"WITH {bm} SELECT (SELECT count(*) FROM bm) AS hits, (SELECT round(max(score), 6) FROM bm) AS best, (SELECT count(text) FROM documents) AS candidates",
        "overlap_merge": """WITH s AS (SELECT user_id, epoch_us(ts) AS start, epoch_us(ts) + CAST(trunc(value * 60000000) AS BIGINT) AS stop FROM events),
r AS (SELECT *, max(stop) OVER (PARTITION BY user_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS isl FROM r)
SELECT user_id, min(start) AS start, max(stop) AS stop, count(*) AS spans FROM i GROUP BY user_id, isl""",
        "returns_by_series": f"WITH {_MONTHS} SELECT series, month, round(value / lag(value) OVER (PARTITION BY series ORDER BY month) - 1, 6) AS change FROM m",
        "risk_pack": f"""WITH {_MONTHS}, r AS (SELECT *, value / lag(value) OVER (PARTITION BY series ORDER BY month) - 1 AS c,
value / max(value) OVER (PARTITION BY series ORDER BY month ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM m),
g AS (SELECT series, count(*) AS points, max_by(value, month) / min_by(value, month) - 1 AS tr, power(product(1 + c), 12.0 / count(c)) - 1 AS ar,
stddev_samp(c) * sqrt(12) AS av, least(0, min(dd)) AS md FROM r GROUP BY series)
SELECT series, points, round(tr, 6) AS total_return, round(ar, 6) AS annualized_return, round(av, 6) AS annualized_volatility,
round((ar - 0.02) / av, 6) AS sharpe, round(md, 6) AS max_drawdown FROM g""",
        "latest_previous_change": f"""WITH {_MONTHS}, r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY month DESC) AS n FROM m),
g AS (SELECT series, max(value) FILTER (n = 1) AS l, max(value) FILTER (n = 2) AS p FROM r GROUP BY series)
SELECT series, round(l, 4) AS latest, round(p, 4) AS previous, round(l - p, 4) AS difference FROM g""",
        "last_written_daily": "SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, max_by(event_id, ts) AS event_id, max_by(value, ts) AS value FROM events GROUP BY ALL",
        "scalar_formulas": """SELECT c_custkey, round(c_acctbal * power(1.05, 3), 6) AS future_value, round(c_acctbal / power(1.05, 3), 6) AS present_value,
round(c_acctbal * 0.01 * power(1.01, 12) / (power(1.01, 12) - 1), 6) AS loan_payment FROM customer WHERE c_acctbal > 0""",
        "cagr_by_nation": f"WITH {_FACTS}, g AS (SELECT entity, min_by(revenue, period) AS b, max_by(revenue, period) AS e, count(*) AS n FROM f GROUP BY entity) SELECT entity, round(power(e / b, 1.0 / (n - 1)) - 1, 6) AS cagr FROM g",
        "derived_ratios": f"WITH {_FACTS} SELECT entity, period, 'net_margin' AS ratio, round(net_income / revenue, 6) AS value FROM f UNION ALL SELECT entity, period, 'gross_margin', round(gross_profit / revenue, 6) FROM f",
        "conflicting_flags": "SELECT l_orderkey, count(DISTINCT l_returnflag) AS values, count(*) AS rows FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) > 1",
        "latest_order": "SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
        "interleaved": f"""WITH {bm}, x AS (SELECT doc_id, coalesce(source, '') AS source, score FROM bm JOIN documents USING (doc_id)),
y AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS pass FROM x)
SELECT doc_id, source, row_number() OVER (ORDER BY pass, source) AS place FROM y ORDER BY pass, source LIMIT 40""",
        "greedy_budget": f"""WITH RECURSIVE {bm}, x AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm JOIN documents USING (doc_id)),
g(rank, used, taken) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), false
  UNION ALL SELECT x.rank, CASE WHEN used + n_chars <= 20000 THEN used + n_chars ELSE used END, used + n_chars <= 20000 FROM g JOIN x ON x.rank = g.rank + 1)
SELECT doc_id, x.rank, n_chars FROM g JOIN x USING (rank) WHERE taken""",
        "coverage": """SELECT source, 50 AS minimum, coalesce(n, 0) AS documents, coalesce(n, 0) >= 50 AS covered FROM (SELECT DISTINCT source FROM mix_targets)
LEFT JOIN (SELECT source, count(DISTINCT company) AS n FROM documents WHERE text IS NOT NULL GROUP BY source) USING (source)""",
        "library": """SELECT d.tenant_id, d.user_id, d.document_id, d.page_count, p.pages, p.characters, coalesce(m.index_status, 'missing') AS index_status
FROM (SELECT DISTINCT tenant_id, user_id, document_id, page_count FROM personal_documents) d
LEFT JOIN (SELECT tenant_id, user_id, document_id, count(*) AS pages, CAST(sum(n) AS BIGINT) AS characters FROM (SELECT tenant_id, user_id, document_id, page_number, max(length(text)) AS n
  FROM personal_document_pages GROUP BY ALL) GROUP BY ALL) p USING (tenant_id, user_id, document_id)
LEFT JOIN (SELECT tenant_id, user_id, document_id, max_by(index_status, indexed_at) AS index_status FROM personal_index_manifests GROUP BY ALL) m USING (tenant_id, user_id, document_id)""",
        "without_manifest": "SELECT tenant_id, user_id, document_id FROM personal_documents d ANTI JOIN personal_index_manifests m USING (tenant_id, user_id, document_id)",
        "broken_references": """SELECT DISTINCT event_id, entity FROM (SELECT event_id, unnest(entities) AS entity FROM conversation_events WHERE entities IS NOT NULL) e
WHERE NOT EXISTS (SELECT 1 FROM documents WHERE kb_name = 'personal_knowledge' AND lang = 'de' AND trim(regexp_extract(title, '^(.*?) [–-] ', 1)) = e.entity)""",
        "formula_margin": "SELECT l_orderkey, l_linenumber, round((l_extendedprice - l_extendedprice * (1 - l_tax)) / l_extendedprice, 6) AS margin FROM lineitem",
        "citations": r"SELECT DISTINCT event_id, unnest(regexp_extract_all(content, '\[\^([^\]\s]+)\]', 1)) AS cited FROM conversation_events WHERE content IS NOT NULL",
        "token_estimates": "SELECT doc_id, CAST(greatest(1, (strlen(text) + 2) // 3) AS BIGINT) AS by_bytes FROM documents WHERE text IS NOT NULL",
        "hidden_credentials": r"""WITH m AS (SELECT event_id, concat('Token: ', coalesce(run_id, 'none'), '; ', content) AS x FROM conversation_events WHERE content IS NOT NULL),
a AS (SELECT event_id, regexp_replace(x, '\b[Bb][Ee][Aa][Rr][Ee][Rr]\s+[^\s,;]+', 'Bearer ***REDACTED***', 'g') AS x FROM m),
b AS (SELECT event_id, regexp_replace(x, '\bsk-[a-z0-9_-]+', 'sk-***REDACTED***', 'gi') AS x FROM a),
c AS (SELECT event_id, regexp_replace(x, '\b(api_key|api-key|apikey|access_token|access-token|accesstoken|token|password|secret|authorization)\s*[:=]\s*[^\s,;]+', '\1=***REDACTED***', 'gi') AS x FROM b)
SELECT event_id, regexp_replace(x, '(http[s]?://[^:/@\s]+:)[^@\s]+@', '\1***REDACTED***@', 'gi') AS message FROM c""",
        "content_ids": "SELECT doc_id, substr(sha256(concat(coalesce(title, ''), chr(0), coalesce(text, ''))), 1, 20) AS content_id FROM documents",
        "canonical_urls": "SELECT pos, concat('https://www.', replace(provider, '_', '-'), '.example.com/', replace(locator, ':', '/'), '?id=', source_id) AS url FROM sources",
        "first_per_url": "SELECT concat('https://www.', replace(provider, '_', '-'), '.example.com/', replace(locator, ':', '/'), '?id=', source_id) AS url, min(pos) AS pos FROM sources GROUP BY 1",
        "current_memories": """WITH x AS (SELECT memory_id, kind, title, coalesce(updated_at, created_at) AS written_at FROM personal_memories)
SELECT memory_id, kind, title, written_at, min(written_at) OVER (PARTITION BY memory_id) AS first_at FROM x QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY written_at DESC, title DESC) = 1""",
        "appended_once": "SELECT event_id, min(md5(coalesce(content, ''))) AS body, count(DISTINCT md5(coalesce(content, ''))) > 1 AS conflict, count(*) AS deliveries FROM conversation_events GROUP BY event_id",
        "run_states": r"""WITH e AS (SELECT *, regexp_replace(lower(event_kind), '[^a-z]', '', 'g') AS k FROM conversation_events WHERE run_id IS NOT NULL)
SELECT lower(trim(regexp_replace(run_id, '[\n\t\r]', '', 'g'))) AS run, min(occurred_at) AS first_at, max(occurred_at) AS last_at, max(sequence) AS last_sequence, count(*) AS events,
count(*) FILTER (k IN ('usermessage', 'user', 'human')) AS user_messages, count(*) FILTER (k IN ('assistantmessage', 'assistant', 'ai')) AS assistant_messages,
count(*) FILTER (k = 'toolevent') AS tool_events FROM e GROUP BY 1""",
        "retention": "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY event_type",
        "dense_sequence": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dense FROM events",
        "budget_usage": "SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) AS events, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id",
        "json_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
        "tumbling_counts": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
        "rollup_revenue": "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
        "pricing_summary": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
        "stream_tumbling": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
        "stream_deduplicated": "SELECT DISTINCT event_id FROM conversation_events WHERE occurred_at IS NOT NULL",
    }
