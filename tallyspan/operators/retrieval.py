"""Lexical and vector retrieval: BM25, cosine, rank fusion, diversification and overlap merging."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspan.functions.tokens import count_tokens, term_hits, times_in, tokens
from tallyspan.operators.blocks import BLOCK, before, with_figures
from tallyspan.session import cut

K1, B, RRF_K = 1.2, 0.75, 60
#: Vectors in a block; scores are rounded to these digits before they are ranked, so that equal vectors tie.
VECTORS, DIGITS = 128, 12
#: Texts and queries in a block of term counts, cells (rows times terms) of one as a matrix, blocks of texts that a task meets.
TEXTS, QUERIES, CELLS, MET = 1024, 512, 1 << 22, 16
#: Terms of texts that are scored at once.
ENTRIES = 1 << 21
_TERMS = re.compile("[A-Za-z0-9_]{2,}|[一-鿿]+")


def query_terms(query: str) -> Counter[str]:
    """The terms of a query as ``tokens`` makes them, with their number."""
    runs = " ".join(_TERMS.findall(query)).lower().split()
    if query.isascii():
        return Counter(runs)
    han = lambda r: [r] if len(r) == 1 else [r[i : i + 2] for i in range(len(r) - 1)]
    return Counter(t for r in runs for t in (han(r) if r[0] >= "一" else [r]))


def bm25(documents: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and score of the documents with a positive score.

    Length and terms of a text are counted in one scan; the narrow counts are written once and read twice, for the corpus
    figures (documents, mean length, document frequencies: one row) and for the scores. No postings are built for a single
    question.
    """
    asked = sorted(query_terms(query).items())
    held = documents.where(F.col(text).isNotNull())
    # The hits are a column of their own, so that one search serves all terms.
    searched = held.select(key, text, count_tokens(F.col(text)).alias("__n"), term_hits(F.col(text), [t for t, _ in asked]).alias("__hits"))
    counted = cut(searched.select(key, "__n", *[times_in(F.col("__hits"), t, F.col(text)).alias(f"__f{i}") for i, (t, _) in enumerate(asked)]))
    figures = counted.agg(
        F.count("*").alias("__docs"),
        F.avg("__n").alias("__avg"),
        *[F.count_if(F.col(f"__f{i}") > 0).alias(f"__d{i}") for i in range(len(asked))],
    )
    norm = K1 * (1 - B + B * F.greatest(F.col("__n"), F.lit(1)) / F.greatest(F.col("__avg"), F.lit(1e-9)))
    score: Column = F.lit(0.0)
    for i, (_, times) in enumerate(asked):
        idf = F.log(1 + (F.col("__docs") - F.col(f"__d{i}") + 0.5) / (F.col(f"__d{i}") + 0.5))
        tf = F.col(f"__f{i}")
        score = score + times * idf * tf * (K1 + 1) / (tf + norm)
    return counted.crossJoin(F.broadcast(figures)).select(key, score.alias("score")).where("score > 0")


def top(scored: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """The best k by score, ties by key, with their rank."""
    best = scored.orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), key)))  # k rows


def postings(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """term, key and tf of every document."""
    return (
        documents.where(F.col(text).isNotNull())
        .select(key, F.explode(tokens(F.col(text))).alias("term"))
        .groupBy("term", key)
        .agg(F.count("*").alias("tf"))
    )


def cosine(vectors: DataFrame, query: list[float], key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key`` and cosine of every vector to the query; vectors of other length, with nulls or of zero norm drop out."""
    q = np.asarray(query, dtype=np.float64)
    size = float(np.sqrt(q @ q))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            fits = batch.map(lambda v: v is not None and len(v) == len(q))
            out = np.full(len(batch), np.nan)
            if fits.any() and size > 0:
                m = np.stack([np.asarray(v, dtype=np.float64) for v in batch[fits]])
                norm = np.sqrt(np.einsum("ij,ij->i", m, m)) * size
                out[fits.to_numpy()] = np.divide(m @ q, norm, out=np.full(len(m), np.nan), where=norm > 0)
            yield pd.Series(out)

    scored = vectors.select(key, score(F.col(vector).cast("array<double>")).alias("score"))
    return scored.where(F.col("score").isNotNull() & ~F.isnan("score"))


def top_each(scored: DataFrame, k: int, query: str, key: str) -> DataFrame:
    """The best k of every query with their rank; Spark cuts to k inside tasks before it shuffles by query."""
    rank = F.row_number().over(W.partitionBy(query).orderBy(F.desc("score"), key))
    return scored.withColumn("score", F.round("score", DIGITS)).withColumn("rank", rank).where(F.col("rank") <= k)


def _counted(texts: DataFrame, rows: int, cells: int = CELLS) -> DataFrame:
    """Blocks of term counts of the texts (id, text): their number and that of their tokens, the ids of those with terms,
    the block's terms in order with the texts each is in (found), and per text, in the order of the terms, how many it has
    (sizes), which (cols) and how often (times)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, kind = 0, pa.null()
        ids: list = []
        sizes: list[int] = []
        cols: list[int] = []
        times: list[int] = []
        place: dict[str, int] = {}

        def block() -> pa.RecordBatch:
            terms = sorted(place)
            order = np.empty(len(terms), dtype=np.int64)
            order[np.asarray([place[t] for t in terms], dtype=np.int64)] = np.arange(len(terms))
            c, f = order[np.asarray(cols, dtype=np.int64)], np.asarray(times, dtype=np.int64)
            by_term = np.argsort(np.repeat(np.arange(len(ids)), sizes) * max(1, len(terms)) + c)
            c, f = c[by_term], f[by_term]
            small = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()
            made = {
                "n": [n], "tokens": [int(f.sum())], "ids": pa.array([ids], pa.list_(kind)), "terms": [terms],
                "found": [np.bincount(c, minlength=len(terms)).tolist()], "sizes": [np.asarray(sizes, dtype=np.int64).tobytes()], "cols": [small(c)], "times": [small(f)],
            }
            types = (pa.int64(), pa.int64(), None, pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([x if t is None else pa.array(x, t) for x, t in zip(made.values(), types, strict=True)], names=list(made))

        for batch in batches:
            kind = batch.schema.field(0).type
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                terms = query_terms(text) if i is not None else {}
                # A text of very many terms begins a block of its own.
                if ids and (len(ids) >= rows or (len(ids) + 1) * (len(place) + len(terms)) > cells):
                    yield block()
                    n = 0
                    for held in (ids, sizes, cols, times, place):
                        held.clear()
                n += 1
                if terms:
                    ids.append(i)
                    sizes.append(len(terms))
                    cols += [place.setdefault(t, len(place)) for t in terms]
                    times += terms.values()
        if n:
            yield block()

    kind = texts.schema[0].dataType.simpleString()
    return texts.mapInArrow(pack, f"n bigint, tokens bigint, ids array<{kind}>, terms array<string>, found array<bigint>, sizes binary, cols binary, times binary")


def _unpacked(sizes: bytes, cols: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of a block's entries."""
    s = np.frombuffer(sizes, dtype=np.int64)
    rows = np.repeat(np.arange(len(s)), s)
    wide = lambda x: np.frombuffer(x, dtype=f"u{len(x) // max(1, len(rows))}" if len(rows) else "u1").astype(np.int64)
    return rows, wide(cols), wide(times)


class _Asked:
    """A block of queries with the best k texts that each has met so far.

    A matrix product in single precision says which texts can be among the best: all its terms are positive, so a rough
    score is off by no more than a share known beforehand. Those alone are scored in double precision, term by term in the
    terms' order, so that texts with the same counts have the same score wherever they stand.
    """

    def __init__(self, ids: list, terms: list[str], entries: tuple[np.ndarray, np.ndarray, np.ndarray], found: np.ndarray, n: int, k: int):
        rows, cols, times = entries
        self.ids, self.k = ids, k
        self.place = {t: i for i, t in enumerate(terms)}
        idf = np.log(1 + (n - found + 0.5) / (found + 0.5))
        self.weights = np.zeros((len(terms), len(ids)))
        self.weights[cols, rows] = times * idf[cols]
        self.rough = self.weights.astype(np.float32)
        self.off = (int(np.bincount(rows).max()) + 8) * 2.0**-23
        self.query, self.key, self.score = np.zeros(0, dtype=np.int64), None, np.zeros(0)
        self.least = np.zeros(len(ids))

    def meet(self, ids: list, terms: list[str], entries: tuple[np.ndarray, np.ndarray, np.ndarray], average: float) -> None:
        rows, cols, times = entries
        norm = K1 * (1 - B + B * np.maximum(np.bincount(rows, times, len(ids)), 1) / max(average, 1e-9))
        weight = times * (K1 + 1) / (times + norm[rows])
        place = np.asarray([self.place.get(t, -1) for t in terms], dtype=np.int64)
        common = np.flatnonzero(place >= 0)
        held = place[cols] >= 0
        rows, cols, weight = rows[held], cols[held], weight[held]
        matrix = np.zeros((len(ids), len(common)), dtype=np.float32)
        matrix[rows, np.searchsorted(common, cols)] = weight
        rough = matrix @ self.rough[place[common]]
        near = (rough > 0) & (rough >= self.least)
        if self.k < len(ids) and near.sum() > 2 * self.k * len(self.ids):
            kth = np.partition(rough, len(ids) - self.k, axis=0)[len(ids) - self.k].astype(np.float64)
            near &= rough >= kth * (1 - self.off) - 2 * 10.0**-DIGITS
        texts, queries = np.nonzero(near)
        if not len(texts):
            return
        starts = np.searchsorted(rows, np.arange(len(ids) + 1))
        counts = starts[texts + 1] - starts[texts]
        parts = np.flatnonzero(np.diff(np.cumsum(counts) // ENTRIES)) + 1
        scores = []
        for t, q, c in zip(*(np.split(x, parts) for x in (texts, queries, counts)), strict=True):
            pair = np.repeat(np.arange(len(t)), c)
            at = np.arange(len(pair)) + np.repeat(starts[t] - (np.cumsum(c) - c), c)
            scores.append(np.bincount(pair, self.weights[place[cols[at]], q[pair]] * weight[at], len(t)))
        self._keep(queries, np.asarray(ids)[texts], np.round(np.concatenate(scores), DIGITS))

    def _keep(self, query: np.ndarray, key: np.ndarray, score: np.ndarray) -> None:
        if self.key is not None:
            query, key, score = (np.concatenate(x) for x in ((self.query, query), (self.key, key), (self.score, score)))
        order = np.lexsort((key, -score, query))
        query, key, score = query[order], key[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        last = rank == self.k - 1
        self.least[query[last]] = score[last] * (1 - self.off) - 2 * 10.0**-DIGITS
        self.query, self.key, self.score = query[rank < self.k], key[rank < self.k], score[rank < self.k]


def bm25_each(documents: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", text: str = "text", rows: int = TEXTS, asked_rows: int = QUERIES) -> DataFrame:
    """query_id, ``key``, score and rank of the best k documents of every query; ``queries`` has query_id and ``text``.

    The documents are read once, into blocks of term counts. Every block of queries meets every block of documents; a task
    keeps k documents per query of all that it meets, so that no pairs of query and document are written.
    """
    held = documents.where(F.col(text).isNotNull()).select(key, text)
    blocks = cut(_counted(held, rows))
    figures = blocks.agg(F.sum("n"), F.sum("tokens"), F.count("*")).first()
    n, average = figures[0] or 0, (figures[1] or 0) / max(1, figures[0] or 0)
    wanted = cut(queries.where(F.col(text).isNotNull()).select("query_id", text))
    # Somewhat more partitions than full blocks, so that an uneven one is still a single block.
    asked = cut(_counted(wanted.repartition(max(1, math.ceil(1.25 * wanted.count() / asked_rows))), asked_rows)).withColumn("__block", F.monotonically_increasing_id())
    found = blocks.select(F.explode(F.arrays_zip("terms", "found")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.found").alias("d"))
    named = asked.select("__block", F.posexplode("terms").alias("at", "term")).join(found, "term", "left")
    in_order = F.array_sort(F.collect_list(F.struct("at", F.coalesce("d", F.lit(0)).alias("d"))))
    in_texts = named.groupBy("__block").agg(F.transform(in_order, lambda x: x["d"]).alias("found"))
    asked = asked.drop("found", "n", "tokens").join(in_texts, "__block")
    asked = cut(asked.select("__block", *[F.col(c).alias(f"q_{c}") for c in ("ids", "terms", "sizes", "cols", "times", "found")]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best, types = None, None, []

        def kept() -> pa.RecordBatch:
            columns = [[best.ids[q] for q in best.query], best.key.tolist(), best.score]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["query_id", key, "score"])

        for batch in batches:
            types = [*(batch.schema.field(c).type.value_type for c in ("q_ids", "ids")), pa.float64()]
            for i in range(batch.num_rows):
                get = lambda c, batch=batch, i=i: batch.column(c)[i].as_py()
                if block != get("__block"):
                    if best is not None and best.key is not None:
                        yield kept()
                    block = get("__block")
                    best = _Asked(get("q_ids"), get("q_terms"), _unpacked(get("q_sizes"), get("q_cols"), get("q_times")), np.asarray(get("q_found")), n, k)
                best.meet(get("ids"), get("terms"), _unpacked(get("sizes"), get("cols"), get("times")), average)
        if best is not None and best.key is not None:
            yield kept()

    types = [df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (documents, key))]
    met = blocks.where(F.size("ids") > 0).select("ids", "terms", "sizes", "cols", "times").repartition(max(1, math.ceil(figures[2] / MET)))
    # One block of queries is held while the texts of a partition pass, so the queries are the outer side.
    pairs = asked.repartition(max(1, asked.count())).hint("shuffle_replicate_nl").crossJoin(met)
    return top_each(pairs.mapInArrow(score, f"query_id {types[0]}, {key} {types[1]}, score double"), k, "query_id", key)


def cosine_each(vectors: DataFrame, queries: DataFrame, k: int | None, least: float = -1.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, ``key``, score and rank of the best k vectors (all for None) of every query with a cosine of ``least``.

    ``queries`` has query_id and ``vector``. Blocks of rows meet blocks of queries as matrices, and k per query are kept
    of each meeting. Vectors of other length than the query or of zero norm drop out.
    """

    def packed(df: DataFrame, name: str) -> DataFrame:
        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for dim, part in batch.groupby(batch["v"].map(len)):
                    for i in range(0, len(part) if dim else 0, VECTORS):
                        cut_out = part.iloc[i : i + VECTORS]
                        m = np.stack(cut_out["v"].to_numpy()).astype(np.float64)
                        yield pd.DataFrame({f"{name}_dim": [dim], f"{name}_ids": [cut_out["id"].to_list()], f"{name}_m": [m.tobytes()]})

        slim = df.select(F.col("query_id" if name == "q" else key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        # A null among the numbers makes the cosine null.
        slim = slim.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
        return slim.mapInPandas(pack, f"{name}_dim int, {name}_ids array<bigint>, {name}_m binary")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.q_dim != r.r_dim:
                    continue
                q, m = (np.frombuffer(x, dtype=np.float64).reshape(-1, r.q_dim) for x in (r.q_m, r.r_m))
                with np.errstate(divide="ignore", invalid="ignore"):
                    made = (q @ m.T) / np.sqrt((q * q).sum(1))[:, None] / np.sqrt((m * m).sum(1))[None, :]
                made, ids = np.round(made, DIGITS), np.asarray(r.r_ids)
                for query, line in zip(r.q_ids, made, strict=True):
                    kept = np.flatnonzero(line >= least)
                    kept = kept[np.lexsort((ids[kept], -line[kept]))][:k]
                    yield pd.DataFrame({"query_id": query, key: ids[kept], "score": line[kept]})

    # The blocks of queries are few beside those of rows: one partition of queries for a hundred of rows.
    asked = cut(packed(queries, "q").repartition(max(1, queries.rdd.getNumPartitions() // 100)))
    scored = packed(vectors, "r").crossJoin(asked).mapInPandas(score, f"query_id bigint, {key} bigint, score double")
    return scored if k is None else top_each(scored, k, "query_id", key)


def ranked(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """All rows with their rank by score, ties by key, as ``top`` counts them.

    Rows are sorted in ranges of (score, key); a rank is the place inside a range plus the rows of the ranges before, of
    which there is one figure per range. Ranges are drawn from a sample, so rows are written once, before and after, and read
    from there.
    """
    place = F.monotonically_increasing_id()  # the partition in the upper 31 bits, the place in it in the lower 33
    order = [F.desc("score"), F.asc(key)]
    held = cut(cut(scored).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", place))
    held = held.withColumn("__range", F.shiftright("__at", 33))
    sizes = held.groupBy("__range").agg(F.count("*").alias("__n"))
    ahead = F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1))  # a row per range
    sizes = sizes.select("__range", F.coalesce(ahead, F.lit(0)).alias("__ahead"))
    rank = F.col("__ahead") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    return held.join(F.broadcast(sizes), "__range").withColumn("rank", rank).drop("__at", "__range", "__ahead")


def fuse(first: DataFrame, second: DataFrame, key: str, least: float | None = None) -> DataFrame:
    """Reciprocal rank fusion of all rows of two scored lists; with ``least``, rows of the second below it leave first."""
    held = second if least is None else second.where(F.col("score") >= least)
    a = ranked(first, key).select(key, F.col("rank").alias("first_rank"))
    b = ranked(held, key).select(key, F.col("rank").alias("second_rank"))
    part = lambda r: F.coalesce(1.0 / (RRF_K + F.col(r)), F.lit(0.0))
    return a.join(b, key, "full").select(key, "first_rank", "second_rank", (part("first_rank") + part("second_rank")).alias("score"))


def diversify(scored: DataFrame, group: str, k: int, key: str = "doc_id") -> DataFrame:
    """The best of every group first, then the rest by score, k in all; position counts from 1."""
    firsts = F.row_number().over(W.partitionBy(group).orderBy(F.desc("score"), key))
    # No group gives more than k, so the rank is cut inside each group before anything is sorted.
    marked = scored.withColumn("__r", firsts).where(F.col("__r") <= k).withColumn("__later", F.col("__r") > 1)
    best = marked.orderBy("__later", F.desc("score"), key).limit(k)
    position = F.row_number().over(W.orderBy("__later", F.desc("score"), key))  # k rows
    return best.select(key, group, "score", position.alias("position"))


def merge_overlaps(spans: DataFrame, group: list[str], start: str = "start", stop: str = "stop", width: float = 86_400e6) -> DataFrame:
    """Islands of spans that overlap (touching ones stay apart): group, start, stop, spans.

    ``width`` is the length of a block of start positions, by default a day of microseconds (see ``blocks``): how far the
    spans before reach and how many islands they began come from the figures of earlier blocks.
    """
    cut_up = spans.withColumn(BLOCK, F.floor(F.col(start) / width))
    reach = cut_up.groupBy(*group, BLOCK).agg(F.max(stop).alias("__top"))
    reach = reach.select(*group, BLOCK, F.max("__top").over(before(group)).alias("__reach"))
    w = W.partitionBy(*group, BLOCK).orderBy(start, stop)
    so_far = F.greatest("__reach", F.max(stop).over(w.rowsBetween(W.unboundedPreceding, -1)))
    flagged = with_figures(cut_up, reach, group).withColumn("__so_far", so_far).withColumn(
        "__new", F.when(F.col("__so_far").isNull() | (F.col(start) >= F.col("__so_far")), 1).otherwise(0)
    )
    parts = (
        flagged.withColumn("__in", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*group, BLOCK, "__in")
        .agg(F.min(start).alias(start), F.max(stop).alias(stop), F.count("*").alias("spans"))
    )
    begun = parts.groupBy(*group, BLOCK).agg(F.max("__in").alias("__n"))
    begun = begun.select(*group, BLOCK, F.coalesce(F.sum("__n").over(before(group)), F.lit(0)).alias("__begun"))
    return (
        with_figures(parts, begun, group)
        .groupBy(*group, (F.col("__in") + F.col("__begun")).alias("__island"))
        .agg(F.min(start).alias(start), F.max(stop).alias(stop), F.sum("spans").alias("spans"))
        .drop("__island")
    )
