"""BM25 of many queries: what tasks hand on doesn't grow with the pairs of query and document."""

import random

import duckdb
import pytest

from tallyspan.operators import retrieval
from tallyspan.plans import catalog

WORDS = ["bank", "bond", "Debt", "rate", "loan", "cash", "利率", "利率风险", "的", "x", "K2", "b_1"]


@pytest.fixture
def handed_on(monkeypatch):
    """The rows that come to the ranking."""
    seen, rank = [], retrieval.top_each

    def counted(scored, *args):
        seen.append((scored.count(), scored.rdd.getNumPartitions()))
        return rank(scored, *args)

    monkeypatch.setattr(retrieval, "top_each", counted)
    return seen


def documents(spark, path, n):
    draw = random.Random(n)
    texts = [" ".join(draw.choice(WORDS) for _ in range(draw.randint(1, 12))) for _ in range(n)]
    odd = [None, "", "  ", "x y", "K", "的", texts[0], texts[0], texts[9], texts[19], "İstanbul ſtate Kelvin"]
    rows = [(i, t, draw.choice(["filing", "news", None])) for i, t in enumerate([*texts, *odd])]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return rows


def same_as_sql(spark, path, name):
    got = sorted(map(tuple, catalog.queries()[name](spark, str(path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(catalog.oracle_sql()[name]).fetchall())
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=2e-6)
    return got


def test_all_documents_hand_on_the_best_only(spark, tmp_path, handed_on):
    documents(spark, tmp_path, 2500)
    got = same_as_sql(spark, tmp_path, "bm25_topk_each")
    ((rows, tasks),) = handed_on
    assert len(got) == 25 * 20 and rows <= 25 * 20 * tasks


def test_filtered_documents_hand_on_the_best_only(spark, tmp_path, handed_on):
    documents(spark, tmp_path, 2500)
    got = same_as_sql(spark, tmp_path, "bm25_filtered_each")
    ((rows, tasks),) = handed_on
    assert len(got) == 25 * 20 and rows <= 25 * 20 * tasks


def test_small_blocks_give_the_same(spark, tmp_path):
    rows = documents(spark, tmp_path, 300)
    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    asked = held.where("doc_id % 7 = 0").selectExpr("doc_id AS query_id", "text")
    want = sorted(map(tuple, retrieval.bm25_each(held, asked, 5).collect()))
    assert sorted(map(tuple, retrieval.bm25_each(held, asked, 5, rows=9, asked_rows=4).collect())) == want
    best = retrieval.top(retrieval.bm25(held, rows[7][1]).selectExpr("doc_id", "round(score, 12) AS score"), 5).collect()
    assert [r[1] for r in want if r[0] == 7] and {r["doc_id"] for r in best} == {r[1] for r in want if r[0] == 7}
    named = held.selectExpr("concat('d', doc_id) AS doc_id", "text")
    assert retrieval.bm25_each(named, asked, 5).count() == len(want)
    assert retrieval.bm25_each(held.limit(0), asked, 5).count() == 0 and retrieval.bm25_each(held, asked.limit(0), 5).count() == 0


def test_a_text_of_very_many_terms_has_a_block_of_its_own(spark):
    texts = [(i, f"bank bond rate{i % 3}") for i in range(60)]
    texts.insert(30, (99, " ".join(f"w{i}" for i in range(3000)) + " bank"))
    held = spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1)
    blocks = [(len(r["ids"]), len(r["terms"])) for r in retrieval._counted(held, 40, 4000).collect()]
    assert blocks == [(30, 5), (1, 3001), (30, 5)]
    got = retrieval.bm25_each(held, held.where("doc_id = 99").selectExpr("doc_id AS query_id", "text"), 3).collect()
    assert [(r["doc_id"], r["rank"]) for r in got] == [(99, 1), (0, 2), (1, 3)]
