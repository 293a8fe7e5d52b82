import os

import pytest

from tallyspan.llm import mixing as mx
from tallyspan.llm import tokenizing as tk

TARGET = "mix_name string, total_fraction double, source string, target_share double, max_repeats int"
SIZED = "doc_id bigint, source string, language string, topic string, n_tokens bigint"


GOAL = "mix_name string, source string, cap int, goal double"


def test_raking_meets_sources_and_caps(spark):
    cells = spark.createDataFrame([(s, lang, t, 100 + 7 * i) for i, (s, lang, t) in enumerate((s, lang, t) for s in "ab" for lang in ("en", "zh") for t in ("x", "y"))], "source string, language string, topic string, tokens bigint")
    goal = lambda a, b: spark.createDataFrame([("m", "a", 2, a), ("m", "b", 1, b), ("m", "absent", 9, 100.0)], GOAL)
    out = mx.rake(cells, goal(300.0, 100.0)).toPandas()
    held = (out["factor"] * out["tokens"]).groupby(out["source"]).sum()
    assert held["a"] == pytest.approx(300) and held["b"] == pytest.approx(100) and (out["factor"] <= 2).all()
    short = mx.rake(cells, goal(3000.0, 1000.0)).toPandas()
    assert short["factor"].tolist() == pytest.approx(short["source"].map({"a": 2.0, "b": 1.0}).tolist())


def test_every_topic_and_language_is_raked_however_many(spark):
    """Two sources whose topics and languages are spread unevenly: the marginals are met for each of 150 topics."""
    rows = [(s, f"l{i % 20}", f"t{i % 150}", 50 + (i * (31 if s == "a" else 17)) % 400) for s in "ab" for i in range(600)]
    cells = spark.createDataFrame(rows, "source string, language string, topic string, tokens bigint").groupBy("source", "language", "topic").sum("tokens").withColumnRenamed("sum(tokens)", "tokens")
    all_ = sum(r[3] for r in rows)
    out = mx.rake(cells, spark.createDataFrame([("m", "a", 9, 0.8 * all_), ("m", "b", 9, 0.2 * all_)], GOAL)).toPandas()
    made = out["factor"] * out["tokens"]
    assert made.groupby(out["source"]).sum()["a"] == pytest.approx(0.8 * all_)
    for column in ("language", "topic"):
        want, got = out["tokens"].groupby(out[column]).sum() / all_, made.groupby(out[column]).sum() / made.sum()
        assert len(want) == {"language": 20, "topic": 150}[column] and (got - want).abs().max() < 0.01 * want.max()


def test_a_draw_ends_exactly_where_many_rows_share_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(mx, "SORTED_ROWS", 3)
    monkeypatch.setattr(mx, "BUCKETS", 4)
    rows = [("m", i, "a", 7, 0, 0.25) for i in range(2000)] + [("m", 5000 + i, "b", 3, 1, 0.9) for i in range(500)]
    made = mx._drawn(spark.createDataFrame(rows, "mix_name string, doc_id bigint, source string, n_tokens bigint, base bigint, part double")).toPandas()
    assert len(made) == 2500
    taken = (made["extra"] * made["n_tokens"]).groupby(made["source"]).sum()
    assert taken["a"] == pytest.approx(3500, abs=7) and taken["b"] == pytest.approx(1350, abs=3)


def test_draw_meets_targets_to_within_a_document(spark):
    rows = [(i, ("big", "mid", "tiny")[0 if i % 3 == 0 or i % 7 else 1] if i > 9 else "tiny", "en" if i % 4 else "zh", f"t{i % 5}", 10 + i * 37 % 400) for i in range(3000)]
    targets = spark.createDataFrame([("m", 0.5, "big", 0.6, 1), ("m", 0.5, "mid", 0.3, 4), ("m", 0.5, "tiny", 0.1, 3), ("n", 0.1, "mid", 1.0, 2)], TARGET)
    sized = spark.createDataFrame(rows, SIZED)
    got = mx.mix_copies(sized, targets, sized=sized).toPandas()
    total = sum(r[4] for r in rows)
    held = (got["copies"] * got["n_tokens"]).groupby([got["mix_name"], got["source"]]).sum()
    assert held["m", "big"] == pytest.approx(0.3 * total, abs=420) and held["m", "mid"] == pytest.approx(0.15 * total, abs=420)
    tiny = sum(r[4] for r in rows if r[1] == "tiny")
    assert held["m", "tiny"] == 3 * tiny and held["n", "mid"] == pytest.approx(0.1 * total, abs=420)
    assert mx.mix_rows(mx.mix_copies(sized, targets, sized=sized)).count() == got["copies"].sum()


@pytest.mark.skipif(not os.path.exists(f"{tk.TOKENIZER_DIR}/{tk.TOKENIZER_FILE}"), reason="needs the public vocabulary")
def test_documents_with_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "alpha beta", None, "a", None, "x"), (2, None, "en", "a", "T – Outlook", "x"), (3, "", "EN", None, "T", "x"), (4, "gamma " * 50, "en-XX", "a", "T – Outlook", "x")], "doc_id bigint, text string, lang string, source string, title string, copies string")
    targets = spark.createDataFrame([("m", 1.0, "a", 1.0, 2), ("m", 1.0, None, 1.0, 2)], TARGET)
    assert {r["doc_id"] for r in mx.mix_copies(docs, targets).collect()} <= {1, 4}
    assert mx.mix_copies(docs.limit(0), targets).count() == 0 and mx.mix_copies(docs, targets.limit(0)).count() == 0
    assert mx.mix_report(docs, targets).count() == 2
    got = {(r["marginal"], r["value"]): r["target_share"] for r in mx.marginal_report(docs, targets).collect()}
    assert got.keys() == {("language", "und"), ("language", "en"), ("topic", "none"), ("topic", "outlook")}
