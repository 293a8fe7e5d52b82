"""Queries of identifiers, audit rows and the document library over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspan.functions import checks
from tallyspan.operators import audit, evidence, library
from tallyspan.session import table

DOCUMENT = ["tenant_id", "user_id", "document_id"]
ASKED = "credit quality outlook"


def _calls(s: SparkSession, d: str) -> DataFrame:
    """Events as audit rows of calls: purchases are calls of a model, values are attempts and tokens."""
    value = F.floor(F.coalesce("value", F.lit(0.0))).cast("int")
    return table(s, d, "events").select(
        F.concat_ws(":", F.lit("call"), "event_type", F.col("user_id").cast("string")).alias("call_id"), "user_id", "event_id", F.when(F.col("event_type") == "purchase", "model").otherwise("tool").alias("capability"),
        (value % 2 == 0).alias("consumed"), value.alias("network_attempts"), value.alias("input_tokens"), F.length("props").alias("output_tokens"), F.when(value > 20, "succeeded").otherwise("failed").alias("status"), "ts",
    )


def _entities(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversation_events").where("entities is not null").select(F.explode("entities").alias("entity")).distinct()


def _mentions(s: SparkSession, d: str) -> DataFrame:
    """Every event with an entity of its run: the first by name."""
    e = table(s, d, "conversation_events").where("run_id is not null")
    first = e.select("run_id", F.explode("entities").alias("entity")).groupBy("run_id").agg(F.min("entity").alias("entity"))
    return e.select("event_id", "run_id").join(first, "run_id").select("event_id", "entity").distinct()


def queries() -> dict:
    t = table
    return {
        "identifier_checks": lambda s, d: t(s, d, "sources").select(
            "pos", checks.ticker(F.split_part("locator", F.lit(":"), F.lit(2))).alias("ticker"), checks.series_id(F.split_part("locator", F.lit(":"), F.lit(3))).alias("series"), checks.iso_date(F.col("published_at")).cast("string").alias("day"),
            checks.gap_code(F.col("source_type")).alias("code"), checks.safe_identifier(F.col("title")).alias("name"), checks.valid_key(F.col("locator")).alias("key"), checks.fact_period(F.col("as_of"), F.col("published_at")).alias("period"),
        ),
        "discovery_terms": lambda s, d: t(s, d, "documents").where("title is not null").select("doc_id", F.array_join(checks.discovery_tokens(F.col("title")), "|").alias("terms")),
        "merged_calls": lambda s, d: audit.merged_calls(_calls(s, d).select("call_id", "event_id", "status"), "call_id", "event_id").select("call_id", "status", "number"),
        "call_usage": lambda s, d: audit.usage(_calls(s, d), ["user_id"]),
        "call_successes": lambda s, d: audit.successes(_calls(s, d).withColumn("day", F.to_date("ts")), ["user_id", "capability"], "day", "status", "ts"),
        "catalogue_ranks": lambda s, d: audit.catalogue_ranks(t(s, d, "documents").where("title is not null").select(F.lower(F.trim("title")).alias("name"), F.coalesce("company", F.lit("")).alias("about")).distinct(), ASKED, "name", "about", 30).select("name", "about", "points"),
        "entity_provenance": lambda s, d: audit.without_provenance(_mentions(s, d), t(s, d, "conversation_events").where("entities is not null").select("event_id", "entities")).select("event_id", "entity"),
        "entity_leaks": lambda s, d: audit.leaks(t(s, d, "personal_memories").where("content is not null").select("memory_id", "content"), _entities(s, d), "memory_id", "content", "entity"),
        "vector_dimensions": lambda s, d: library.dimensions(t(s, d, "embeddings"), ["label"]).select("label", "vectors", "least", "most", "consistent"),
        "unit_vectors": lambda s, d: library.unit_vectors(t(s, d, "embeddings"), "vec_id").select("vec_id", F.round(F.get("embedding", F.lit(0)), 6).alias("first"), F.size("embedding").alias("n")),
        "ready_libraries": lambda s, d: library.ready(t(s, d, "personal_documents"), t(s, d, "personal_index_manifests").groupBy(*DOCUMENT).agg(F.max_by("index_status", F.struct("indexed_at", "index_status")).alias("index_status")), DOCUMENT, ["tenant_id"]),
        "merged_documents": lambda s, d: (lambda x: library.merged_sets(x.where("kb_name = 'public_research'").drop("kb_name"), x.where("kb_name = 'personal_knowledge'").drop("kb_name"), ["company", "source"]))(t(s, d, "documents").where("company is not null and source is not null").select("company", "source", "kb_name", "doc_id")),
        "unexpired_memories": lambda s, d: library.unexpired(t(s, d, "personal_memories").select("memory_id", "created_at").distinct(), "created_at", "2026-06-01 00:00:00", 200 * 86_400).select("memory_id", "created_at"),
        "cascaded_pages": lambda s, d: library.cascade({"pages": t(s, d, "personal_document_pages").select(*DOCUMENT, "page_number").distinct()}, t(s, d, "personal_documents").where("text_characters is null"), DOCUMENT)["pages"],
        "first_gaps": lambda s, d: evidence.first_gaps(
            t(s, d, "sources").where("published_at is null").select(F.lit("published_at_missing").alias("code"), F.split_part("locator", F.lit(":"), F.lit(2)).alias("entity"), "source_type", F.col("provider").alias("tool"), F.col("title").alias("message"), "pos").withColumnRenamed("source_type", "requirement"), "pos"
        ).select("entity", "requirement", "tool", "message", "pos"),
    }


def oracle_sql() -> dict[str, str]:
    calls = """c AS (SELECT concat_ws(':', 'call', event_type, CAST(user_id AS VARCHAR)) AS call_id, user_id, event_id, ts, CASE WHEN event_type = 'purchase' THEN 'model' ELSE 'tool' END AS capability,
  CAST(floor(coalesce(value, 0)) AS INT) AS v, length(props) AS p FROM events), k AS (SELECT *, v % 2 = 0 AS consumed, CASE WHEN v > 20 THEN 'succeeded' ELSE 'failed' END AS status FROM c)"""
    return {
        "identifier_checks": r"""WITH x AS (SELECT *, upper(trim(split_part(locator, ':', 2))) AS t, upper(trim(split_part(locator, ':', 3))) AS s, regexp_replace(substr(regexp_replace(trim(title), '[^A-Za-z0-9._-]+', '_', 'g'), 1, 80), '^[._-]+|[._-]+$', '', 'g') AS n FROM sources)
SELECT pos, CASE WHEN regexp_matches(t, '^[A-Z0-9][A-Z0-9.\-]{0,14}$') THEN t END AS ticker, CASE WHEN regexp_matches(s, '^[A-Z0-9][A-Z0-9_.\-]{0,49}$') THEN s END AS series,
 CASE WHEN regexp_matches(published_at, '^\d{4}-\d{2}-\d{2}$') THEN CAST(TRY_CAST(published_at AS DATE) AS VARCHAR) END AS day, CASE WHEN regexp_matches(source_type, '^[a-z][a-z0-9_]{0,79}$') THEN source_type ELSE 'data_gap' END AS code,
 coalesce(nullif(n, ''), 'item') AS name, coalesce(regexp_matches(locator, '^[A-Za-z0-9][A-Za-z0-9._:\-]{0,199}$'), false) AS key,
 CASE WHEN nullif(trim(as_of), '') IS NOT NULL AND nullif(trim(published_at), '') IS NOT NULL THEN concat(trim(as_of), '/', trim(published_at)) ELSE nullif(trim(published_at), '') END AS period FROM x""",
        "discovery_terms": r"""WITH r AS (SELECT doc_id, regexp_extract_all(lower(title), '[a-z0-9_]+(?:[.\-][a-z0-9_]+)*|[\x{4e00}-\x{9fff}]+') AS l FROM documents WHERE title IS NOT NULL)
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS terms FROM r""",
        "merged_calls": f"WITH {calls} SELECT call_id, arg_max(status, event_id) AS status, CAST(split_part(call_id, ':', 3) AS BIGINT) AS number FROM k GROUP BY call_id",
        "call_usage": f"""WITH {calls} SELECT user_id, count(*) FILTER (consumed AND capability <> 'model') AS tool_calls, count(*) FILTER (consumed AND capability = 'model') AS model_calls, CAST(sum(greatest(v, 0)) AS BIGINT) AS network_attempts,
CAST(sum(greatest(v, 0)) AS BIGINT) AS input_tokens, CAST(coalesce(sum(p), 0) AS BIGINT) AS output_tokens FROM k GROUP BY user_id""",
        "call_successes": f"WITH {calls} SELECT user_id, capability, count(*) AS calls, count(DISTINCT CAST(ts AS DATE)) AS runs, max(ts) AS last_at FROM k WHERE status = 'succeeded' GROUP BY ALL",
        "catalogue_ranks": rf"""WITH e AS (SELECT DISTINCT lower(trim(title)) AS name, coalesce(company, '') AS about FROM documents WHERE title IS NOT NULL),
t AS (SELECT *, list_distinct(regexp_extract_all(lower(concat_ws(' ', name, about)), '[a-z0-9_]+(?:[.\-][a-z0-9_]+)*|[\x{{4e00}}-\x{{9fff}}]+')) AS l FROM e),
p AS (SELECT name, about, len(list_intersect(l, ['credit', 'quality', 'outlook'])) + CASE WHEN contains('{ASKED}', name) OR contains(name, '{ASKED}') THEN 3 ELSE 0 END AS points FROM t)
SELECT name, about, points FROM p WHERE points > 0 ORDER BY points DESC, name LIMIT 30""",
        "entity_provenance": """WITH e AS (SELECT * FROM conversation_events WHERE run_id IS NOT NULL), f AS (SELECT run_id, min(n) AS entity FROM (SELECT run_id, unnest(entities) AS n FROM e) GROUP BY 1)
SELECT DISTINCT event_id, entity FROM e JOIN f USING (run_id) WHERE entity IS NOT NULL AND NOT EXISTS (SELECT 1 FROM conversation_events o WHERE o.event_id = e.event_id AND list_contains(o.entities, f.entity))""",
        "entity_leaks": r"""WITH n AS (SELECT DISTINCT lower(trim(unnest(entities))) AS name FROM conversation_events), m AS (SELECT DISTINCT memory_id, concat(' ', array_to_string(list_filter(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+'), lambda w: w <> ''), ' '), ' ') AS t FROM personal_memories WHERE content IS NOT NULL)
SELECT DISTINCT memory_id, name FROM m, n WHERE name <> '' AND contains(t, concat(' ', array_to_string(list_filter(regexp_split_to_array(name, '[^\p{L}\p{N}]+'), lambda w: w <> ''), ' '), ' '))""",
        "vector_dimensions": "SELECT label, count(*) AS vectors, CAST(min(coalesce(len(embedding), -1)) AS INT) AS least, CAST(max(coalesce(len(embedding), -1)) AS INT) AS most, min(coalesce(len(embedding), -1)) = max(coalesce(len(embedding), -1)) AND min(coalesce(len(embedding), -1)) > 0 AS consistent FROM embeddings GROUP BY label",
        "unit_vectors": "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings) SELECT vec_id, round(e[1] / n, 6) AS first, CAST(len(e) AS INT) AS n FROM v WHERE n > 0 AND len(e) >= 2",
        "ready_libraries": """WITH m AS (SELECT tenant_id, user_id, document_id, arg_max(index_status, (indexed_at, index_status)) AS status FROM personal_index_manifests GROUP BY ALL)
SELECT tenant_id, count(*) AS documents, bool_and(coalesce(status = 'vector_ready', false)) AS ready FROM (SELECT DISTINCT tenant_id, user_id, document_id FROM personal_documents) LEFT JOIN m USING (tenant_id, user_id, document_id) GROUP BY tenant_id""",
        "merged_documents": "SELECT company, source, doc_id FROM documents WHERE company IS NOT NULL AND source IS NOT NULL AND kb_name IN ('public_research', 'personal_knowledge') QUALIFY row_number() OVER (PARTITION BY company, source ORDER BY kb_name, doc_id DESC) = 1",
        "unexpired_memories": "SELECT DISTINCT memory_id, created_at FROM personal_memories WHERE created_at + INTERVAL 200 DAY > TIMESTAMPTZ '2026-06-01 00:00:00+00'",
        "cascaded_pages": "SELECT DISTINCT tenant_id, user_id, document_id, page_number FROM personal_document_pages p WHERE NOT EXISTS (SELECT 1 FROM personal_documents d WHERE d.text_characters IS NULL AND d.tenant_id = p.tenant_id AND d.user_id = p.user_id AND d.document_id = p.document_id)",
        "first_gaps": "SELECT split_part(locator, ':', 2) AS entity, source_type AS requirement, provider AS tool, title AS message, pos FROM sources WHERE published_at IS NULL QUALIFY row_number() OVER (PARTITION BY entity, source_type, provider ORDER BY pos) = 1",
    }
