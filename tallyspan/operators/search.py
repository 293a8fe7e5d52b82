"""Search over chunks: metadata and access filters, lexical, vector and hybrid modes, diversification, overlap merging."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspan.operators import retrieval
from tallyspan.session import cut

MODES = ("lexical", "vector", "hybrid")
#: Bounds of a request.
MOST_RESULTS, MOST_FILTERS, MOST_CHARACTERS, LEAST_SIMILARITY = 20, 50, 8_000, 0.5


def matching(rows: DataFrame, filters: Mapping[str, object] | None = None, access: Mapping[str, object] | None = None) -> DataFrame:
    """Rows whose columns equal all filters; a null filter asks for nothing. ``access`` is what a deployment sets: it takes
    the place of the request's filter of the same column, so that a request can't widen it."""
    wanted = {**(filters or {}), **(access or {})}
    if len(wanted) > MOST_FILTERS:
        raise ValueError(f"more than {MOST_FILTERS} filters")
    held = rows
    for column, value in wanted.items():
        if value is not None:
            held = held.where(F.col(column).eqNullSafe(F.lit(value)))
    return held


def readable(rows: DataFrame, permissions: DataFrame, keys: list[str], reader: str) -> DataFrame:
    """Rows for which ``permissions`` (keys, principal_id, permission) lets ``reader`` read."""
    granted = permissions.where((F.col("principal_id") == reader) & (F.col("permission") == "read")).select(*keys).distinct()
    return rows.join(granted, keys, "left_semi")


def _checked(query: str, mode: str, k: int) -> str:
    if not query or not query.strip() or len(query) > MOST_CHARACTERS:
        raise ValueError("query is empty or too long")
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if not 1 <= k <= MOST_RESULTS:
        raise ValueError(f"k must be between 1 and {MOST_RESULTS}")
    return query.strip()


def _lists(
    candidates: DataFrame, query: str, mode: str, vectors: DataFrame | None, query_vector: list[float] | None, key: str, text: str
) -> tuple[DataFrame | None, DataFrame | None]:
    """The lexical and the vector scores that a mode needs, the latter of all vectors of candidates."""
    if mode != "lexical" and (vectors is None or query_vector is None):
        raise ValueError(f"{mode} search needs vectors and a query vector")
    lexical = retrieval.bm25(candidates, query, key, text) if mode != "vector" else None
    near = retrieval.cosine(vectors.join(candidates.select(key), key, "left_semi"), query_vector, key) if mode != "lexical" else None
    return lexical, near


def _hits(lexical: DataFrame | None, near: DataFrame | None, key: str, least: float) -> DataFrame:
    """``key`` and score of everything found: one list, or the fusion of both; vectors below the threshold leave first."""
    if near is None:
        return lexical
    close = near.where(F.col("score") >= least)
    return close if lexical is None else retrieval.fuse(lexical, close, key).select(key, "score")


def _chosen(held: DataFrame, scored: DataFrame, k: int, diversify_by: str | None, key: str) -> DataFrame:
    """The candidates of the best k with their score and place."""
    if diversify_by is None:
        best = retrieval.top(scored, k, key).withColumnRenamed("rank", "place")
    else:
        best = retrieval.diversify(scored.join(held.select(key, diversify_by), key), diversify_by, k, key).withColumnRenamed("position", "place").drop(diversify_by)
    return held.join(F.broadcast(best), key)  # k rows


def search(
    candidates: DataFrame, query: str, mode: str = "lexical", k: int = 5, filters: Mapping[str, object] | None = None, access: Mapping[str, object] | None = None,
    vectors: DataFrame | None = None, query_vector: list[float] | None = None, diversify_by: str | None = None,
    key: str = "chunk_id", text: str = "content", record: str | None = "record_id", least: float = LEAST_SIMILARITY,
) -> DataFrame:
    """The best k candidates with their rank, merged where they overlap in one record, so that fewer than k may come out.

    Filters come first, then scores, threshold, fusion, diversification and the cut to k, and overlaps are merged at the end
    among the k rows. With ``record`` the candidates hold it, start and stop (places in the record). ``vectors`` has ``key``
    and embedding.
    """
    asked, held = _checked(query, mode, k), matching(candidates, filters, access)
    scored = _hits(*_lists(held, asked, mode, vectors, query_vector, key, text), key, least)
    chosen = _chosen(held, scored, k, diversify_by, key)
    if record is None:
        return chosen.withColumn("rank", F.col("place").cast("bigint")).drop("place")
    return merge_hits(chosen, record, key, text)


def merge_hits(chosen: DataFrame, record: str, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """Chosen chunks (place, score, start, stop) that overlap in a record as one: record, key, rank, score, start, stop, text.

    Touching chunks stay apart, as do empty ones. A merged chunk has the best score and the first place
    of its parts, their text put together by places, and the SHA-256 of their ids as its key.
    """
    empty = F.col("stop") <= F.col("start")
    at = W.partitionBy(record, empty).orderBy("start", "place")
    reach = F.max("stop").over(at.rowsBetween(W.unboundedPreceding, -1))
    alone = reach.isNull() | (F.col("start") >= reach) | empty
    parts = chosen.withColumn("__island", F.sum(alone.cast("int")).over(at.rowsBetween(W.unboundedPreceding, 0)))
    row = F.struct("start", "place", "stop", F.col(key).alias("id"), F.col(text).alias("text"))
    merged = parts.groupBy(record, empty.alias("__empty"), "__island").agg(F.array_sort(F.collect_list(row)).alias("p"), F.max("score").alias("score"), F.min("place").alias("__place"))
    whole = F.aggregate(
        F.slice("p", 2, F.size("p")),
        F.struct(F.get("p", F.lit(0))["text"].alias("text"), F.get("p", F.lit(0))["stop"].cast("bigint").alias("stop")),
        lambda acc, x: F.struct(
            F.concat(acc["text"], F.substring(x["text"], (acc["stop"] - x["start"] + 1).cast("int"), F.length(x["text"]))).alias("text"), F.greatest(acc["stop"], x["stop"].cast("bigint")).alias("stop")
        ),
    )
    ids = F.transform("p", lambda x: x["id"].cast("string"))
    made = merged.withColumn("w", whole).select(
        record,
        F.when(F.size("p") == 1, F.get(ids, F.lit(0))).otherwise(F.substring(F.sha2(F.array_join(ids, "\0"), 256), 1, 32)).alias(key),
        "score",
        F.get("p", F.lit(0))["start"].alias("start"),
        F.col("w.stop").alias("stop"),
        F.col("w.text").alias(text),
        "__place",
    )
    return made.withColumn("rank", F.row_number().over(W.orderBy("__place")).cast("bigint")).drop("__place")  # at most k rows


def trace(
    candidates: DataFrame, query: str, mode: str, k: int, vectors: DataFrame | None = None, query_vector: list[float] | None = None,
    key: str = "chunk_id", text: str = "content", record: str = "record_id", least: float = LEAST_SIMILARITY,
) -> DataFrame:
    """One row of counts: candidates, lexical hits, vectors before and after the threshold, chosen and returned chunks.

    The scores are written once and read by every count."""
    none = candidates.limit(0).select(key, F.lit(0.0).alias("score"))
    lexical, near = (None if x is None else cut(x) for x in _lists(candidates, _checked(query, mode, k), mode, vectors, query_vector, key, text))
    found = cut(_hits(lexical, near, key, least))
    returned = merge_hits(_chosen(candidates, found, k, None, key), record, key, text)
    one = lambda df, name, what=F.count("*"): df.agg(what.alias(name))
    return (
        one(candidates, "candidates")
        .crossJoin(one(none if lexical is None else lexical, "lexical"))
        .crossJoin((none if near is None else near).agg(F.count("*").alias("vector_before_threshold"), F.count_if(F.col("score") >= least).alias("vector")))
        .crossJoin(one(found, "chosen", F.least(F.count("*"), F.lit(k).cast("bigint"))))
        .crossJoin(one(returned, "returned"))  # every side is one row
    )
