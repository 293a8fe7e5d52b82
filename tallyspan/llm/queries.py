"""Queries of the text operators over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspan.llm import conversations, mixing, privacy, residue, scans, splitting, tokenizing
from tallyspan.session import table

#: Key of the stand-ins in the queries; a deployment passes its own.
DEMONSTRATION_KEY = "tallyspan"


def _documents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(table(spark, d, t) for t in ("personal_document_pages", "personal_index_manifests", "chunking_policies"))


def _redacted(spark: SparkSession, d: str, style: str) -> DataFrame:
    rows = privacy.contents(table(spark, d, "conversation_events"), table(spark, d, "personal_memories"))
    names = table(spark, d, "name_parts")
    return privacy.redact(rows, privacy.learned_families(rows, names), DEMONSTRATION_KEY, style, privacy.known_parts(names))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": lambda s, d: splitting.found(*_documents(s, d)),
        "p1_pieces": lambda s, d: splitting.pieces(*_documents(s, d)),
        "p1_reassembled": lambda s, d: splitting.reassembled(*_documents(s, d)),
        "p1_fitting_counts": lambda s, d: splitting.fitting_counts(*_documents(s, d)),
        "p3_found": lambda s, d: scans.found(table(s, d, "personal_document_pages")),
        "p3_repaired_pages": lambda s, d: scans.repaired_pages(table(s, d, "personal_document_pages")),
        "p4_found": lambda s, d: conversations.conversations(table(s, d, "conversation_events")),
        "p5_found": lambda s, d: privacy.found(
            table(s, d, "conversation_events"), table(s, d, "personal_memories"), table(s, d, "name_parts")
        ),
        "p5_redacted": lambda s, d: _redacted(s, d, "placeholder"),
        "p5_surrogates": lambda s, d: _redacted(s, d, "surrogate"),
        "p6_ids": lambda s, d: tokenizing.encode_texts(table(s, d, "documents").select("doc_id", "text")),
        "p6_decoded": lambda s, d: tokenizing.decode_ids(tokenizing.encode_texts(table(s, d, "documents").select("doc_id", "text"))).select("doc_id", F.md5("text").alias("text")),
        "p7_mixes": lambda s, d: mixing.mix_copies(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p7_shares": lambda s, d: mixing.mix_report(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p7_marginals": lambda s, d: mixing.marginal_report(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p8_found": lambda s, d: residue.found(table(s, d, "documents")),
        "p8_clean_documents": lambda s, d: residue.without_residue(table(s, d, "documents")).select(
            "doc_id", "source", F.length("text").alias("n_characters")
        ),
    }


def oracle_sql() -> dict[str, str]:
    visible = r"regexp_matches({0}, '[^\p{{Z}}\p{{C}}]')"
    items = rf"""
WITH p AS (SELECT DISTINCT tenant_id, user_id, document_id, page_number, text, blocks_json FROM personal_document_pages),
j AS (SELECT *, CASE WHEN json_valid(blocks_json) AND json_type(TRY_CAST(blocks_json AS JSON)) = 'ARRAY'
                      AND json_array_length(TRY_CAST(blocks_json AS JSON)) > 0 THEN TRY_CAST(blocks_json AS JSON) END AS b FROM p),
i AS (
  SELECT tenant_id, user_id, document_id, page_number, 'block' AS item_kind,
         CAST(json_extract_string(x, '$.order') AS INT) AS block_order, json_extract_string(x, '$.content') AS content
  FROM (SELECT *, unnest(CAST(b AS JSON[])) AS x FROM j WHERE b IS NOT NULL)
  UNION ALL
  SELECT tenant_id, user_id, document_id, page_number, 'page', -1, text FROM j WHERE b IS NULL),
f AS (SELECT DISTINCT tenant_id, user_id, document_id, chunking_version FROM personal_index_manifests)
SELECT DISTINCT i.tenant_id, i.user_id, i.document_id, page_number, item_kind, block_order, md5(content) AS text, true AS within, true AS overlapping
FROM i LEFT JOIN f USING (tenant_id, user_id, document_id) JOIN chunking_policies c ON c.chunking_version = coalesce(f.chunking_version, 'legacy')
WHERE length(content) > max_chars AND {visible.format('content')}"""
    return {
        "p1_reassembled": items,
        "p6_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS text FROM documents",
        "p4_found": r"""
WITH e AS (
  SELECT lower(regexp_replace(run_id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS run_id, sequence, event_id, content,
         coalesce(regexp_replace(lower(event_kind), '[^\p{L}\p{N}]', '', 'g'), '') AS kind
  FROM conversation_events WHERE run_id IS NOT NULL),
d AS (SELECT DISTINCT run_id, sequence, event_id, kind, content FROM e WHERE run_id <> ''),
m AS (SELECT *, CASE WHEN kind IN ('usermessage', 'user', 'human') THEN 'user'
                     WHEN kind IN ('assistantmessage', 'assistant', 'ai') THEN 'assistant' END AS speaker FROM d),
bad AS (
  SELECT run_id FROM m GROUP BY run_id, event_id HAVING count(*) > 1
  UNION SELECT run_id FROM m GROUP BY run_id, sequence HAVING count(*) > 1
  UNION SELECT run_id FROM m WHERE speaker IS NOT NULL AND NOT coalesce(regexp_matches(content, '[^\p{Z}\p{C}]'), false)),
t AS (
  SELECT run_id, event_id, speaker, row_number() OVER (PARTITION BY run_id ORDER BY sequence) AS turn,
         count(*) OVER (PARTITION BY run_id) AS n
  FROM m WHERE speaker IS NOT NULL AND run_id NOT IN (SELECT run_id FROM bad)),
ok AS (SELECT run_id FROM t GROUP BY run_id
       HAVING bool_and((turn % 2 = 1) = (speaker = 'user')) AND max(n) % 2 = 0)
SELECT run_id, CAST(turn AS BIGINT) AS turn, speaker, event_id FROM t WHERE run_id IN (SELECT run_id FROM ok)""",
        "p1_found": rf"""
WITH p AS (SELECT DISTINCT tenant_id, user_id, document_id, page_number, text, blocks_json FROM personal_document_pages),
j AS (SELECT *, CASE WHEN json_valid(blocks_json) AND json_type(TRY_CAST(blocks_json AS JSON)) = 'ARRAY'
                      AND json_array_length(TRY_CAST(blocks_json AS JSON)) > 0 THEN TRY_CAST(blocks_json AS JSON) END AS b FROM p),
i AS (
  SELECT tenant_id, user_id, document_id, page_number, 'block' AS item_kind,
         CAST(json_extract_string(x, '$.order') AS INT) AS block_order, json_extract_string(x, '$.content') AS content
  FROM (SELECT *, unnest(CAST(b AS JSON[])) AS x FROM j WHERE b IS NOT NULL)
  UNION ALL
  SELECT tenant_id, user_id, document_id, page_number, 'page', -1, text FROM j WHERE b IS NULL),
f AS (SELECT DISTINCT tenant_id, user_id, document_id, chunking_version, chunk_count FROM personal_index_manifests),
s AS (
  SELECT i.*, coalesce(length(content), 0) AS n, coalesce({visible.format('content')}, false) AS v, c.max_chars, c.overlap_chars
  FROM i LEFT JOIN f USING (tenant_id, user_id, document_id)
  JOIN chunking_policies c ON c.chunking_version = coalesce(f.chunking_version, 'legacy')),
l AS (
  SELECT tenant_id, user_id, document_id, sum(CASE WHEN NOT v THEN 0 WHEN n <= max_chars THEN 1
         ELSE ceil((n - overlap_chars) / CAST(max_chars - overlap_chars AS DOUBLE)) END) AS least
  FROM s GROUP BY ALL)
SELECT DISTINCT item_kind, tenant_id, user_id, document_id, page_number, block_order FROM s WHERE v AND n > max_chars
UNION
SELECT 'manifest', tenant_id, user_id, document_id, 0, -1 FROM f JOIN l USING (tenant_id, user_id, document_id)
WHERE chunk_count IS NOT NULL AND chunk_count < least""",
    }
