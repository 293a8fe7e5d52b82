"""Operators take all rows: results over more rows than any shortlist, against brute force."""

import random

import numpy as np
import pytest

from tallyspan.operators import retrieval, selection
from tallyspan.plans import catalog


def test_fusion_takes_ranks_beyond_a_hundred(spark):
    n = 400
    one = {i: float(n - i) for i in range(n)}  # 0 is first here and last there
    two = {i: float((i * 7) % n) for i in range(0, n, 2)}
    two[0] = -1.0
    frame = lambda d: spark.createDataFrame(list(d.items()), "doc_id bigint, score double").repartition(5)
    rank = lambda d: {k: i for i, k in enumerate(sorted(d, key=lambda k: (-d[k], k)), 1)}

    def want(a, b):
        a, b = rank(a), rank(b)
        return {k: (a.get(k), b.get(k), sum(1.0 / (60 + r[k]) for r in (a, b) if k in r)) for k in {*a, *b}}

    got = {r["doc_id"]: tuple(r)[1:] for r in retrieval.fuse(frame(one), frame(two), "doc_id").collect()}
    assert got == want(one, two) and got[0][:2] == (1, 200)
    got = {r["doc_id"]: tuple(r)[1:] for r in retrieval.fuse(frame(one), frame(two), "doc_id", 100.0).collect()}
    assert got == want(one, {k: v for k, v in two.items() if v >= 100})
    ties = spark.range(300).selectExpr("id AS doc_id", "1.0D AS score").repartition(7)
    assert {(r["doc_id"], r["rank"]) for r in retrieval.ranked(ties).collect()} == {(i, i + 1) for i in range(300)}
    assert retrieval.fuse(frame(one).limit(0), frame(two).limit(0), "doc_id").count() == 0


def test_greedy_fill_goes_through_all_rows(spark):
    draw = random.Random(2)
    for costs, budget in (([draw.choice([1, 3, 40, 90, 300, 2000]) for _ in range(600)], 1000), ([9] * 50 + [0, 2, None, 1], 19), ([500], 3), ([], 5)):
        want, used = set(), 0
        for i, c in enumerate(costs):
            if c is not None and used + c <= budget:
                want, used = want | {i}, used + c
        items = spark.createDataFrame(list(enumerate(costs)), "place bigint, cost int").repartition(6)
        assert {r["place"] for r in selection.greedy_fill(items, budget, "cost", "place").collect()} == want


def test_greedy_budget_sees_documents_beyond_rank_sixty(spark, tmp_path):
    rows = [(i, "covered bonds", 19_999 if i == 1 else 500 if i < 90 else 1) for i in range(1, 101)]
    spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["greedy_budget"](spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["rank"]) for r in got} == {(1, 1), (90, 90)}


def test_every_query_row_finds_its_neighbours(spark, tmp_path):
    draw = np.random.default_rng(4)
    made = draw.normal(size=(450, 8)).astype("float32")
    made[7], made[11] = made[300], 0.0  # a tie, and a vector without direction
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(made)] + [(600, None), (601, [1.0, 2.0])]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    unit = made.astype(float) / np.where((n := np.linalg.norm(made.astype(float), axis=1)) > 0, n, np.nan)[:, None]
    got = catalog.queries()["cosine_topk_each"](spark, str(tmp_path)).collect()
    want = {}
    for q in range(0, 450, 100):
        line = np.round(unit @ unit[q], 12)
        for rank, i in enumerate(sorted(np.flatnonzero(~np.isnan(line)), key=lambda i: (-line[i], i))[:20], 1):
            want[q, rank] = (int(i), line[i])
    assert {(r["query_id"], r["rank"]): r["vec_id"] for r in got} == {k: v[0] for k, v in want.items()}
    assert [r["score"] for r in got] == pytest.approx([want[r["query_id"], r["rank"]][1] for r in got], abs=1e-6)

    words = ["bank", "bond", "debt", "rate", "loan", "cash"]
    docs = [(i, " ".join(words[int(x)] for x in draw.integers(0, 6, 9)), "filing" if i % 3 else "news") for i in range(1, 250)] + [(300, None, "news")]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, only in (("bm25_topk_each", "true"), ("bm25_filtered_each", "source = 'filing'")):
        got = catalog.queries()[name](spark, str(tmp_path)).collect()
        assert {r["query_id"] for r in got} == {100, 200}
        for q in (100, 200):
            scored = {r["doc_id"]: round(r["score"], 6) for r in retrieval.bm25(held.where(only), docs[q - 1][1]).collect()}
            mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
            assert [r["score"] for r in mine] == pytest.approx(sorted(scored.values(), reverse=True)[:20], abs=2e-6)
            assert all(scored[r["doc_id"]] == pytest.approx(r["score"], abs=2e-6) for r in mine)
