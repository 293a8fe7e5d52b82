"""Search, chunks, evidence, reports, memory, web results, metrics and cleaning against brute force and written-out cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyspan.functions import clean
from tallyspan.functions import tokens as tk
from tallyspan.operators import chunks, evidence, memory, metrics, search, state, validation, web
from tallyspan.sources import payloads


def test_windows_cover_a_text_within_their_size_and_end_naturally():
    draw = random.Random(1)
    for _ in range(150):
        text = "".join(draw.choice(["bond ", "costs. ", "利率", "，", "\n\n", "x", " 7 "]) for _ in range(draw.randint(0, 120)))
        size = draw.randint(4, 30)
        overlap = draw.randint(0, size // 2)
        made = list(chunks.windows(text, size, overlap))
        places = [m.span() for m in chunks.TOKEN.finditer(text)]
        assert bool(made) == bool(places)
        for start, stop, first, last in made:
            assert 0 < last - first <= size and (start, stop) == (places[first][0], places[last - 1][1])
        for (_, _, a, b), (_, _, c, _) in zip(made, made[1:], strict=False):
            assert c == max(a + 1, b - overlap) and b - a >= int(0.8 * size)
        if made:
            assert made[0][2] == 0 and made[-1][3] == len(places)
    assert [w[3] for w in chunks.windows("a b c d e f g h. i j k", 10, 2)][0] == 9  # the sentence ends inside the last fifth


def test_tables_keep_their_header_and_every_row():
    table = "| item | value |\n| --- | --- |\n" + "".join(f"| row{i} | {i} |\n" for i in range(12))
    parts = chunks.table_parts(table, 34)
    assert len(parts) > 1 and all(p.startswith("| item | value |\n| --- | --- |\n") and len(chunks.TOKEN.findall(p)) <= 34 for p in parts)
    assert [x for p in parts for x in p.split("\n")[2:] if x] == [f"| row{i} | {i} |" for i in range(12)]
    html = "<table><tr><th>a</th></tr>" + "".join(f"<tr><td>{i}</td></tr>" for i in range(9)) + "</table>"
    parts = chunks.table_parts(html, 70)
    assert len(parts) > 1 and all(p.startswith("<table><tr><th>a</th></tr>") and p.endswith("</table>") for p in parts)
    assert chunks.table_parts("short", 50) == ["short"]
    long_row = "| h |\n|---|\n| " + "w " * 60 + "|\n"
    assert "".join(p[10:] for p in chunks.table_parts(long_row, 30)).count("w") == 60


def test_block_groups(spark):
    blocks = [
        {"label": "heading", "content": "One", "order": 0}, {"label": "text", "content": "a", "order": 1}, {"label": "text", "content": "b", "order": 2}, {"label": "table", "content": "| t |", "order": 3},
        {"label": "text", "content": "c", "order": 4}, {"label": "footer", "content": "x", "order": 5}, {"label": "text", "content": " ", "order": 6}, {"label": "text", "content": "d", "order": 7, "paragraph_title": "Two"},
    ]
    rows = [("d", 1, json.dumps(blocks)), ("d", 1, json.dumps(blocks)), ("d", 2, json.dumps([{"label": "text", "content": "e", "order": 0}])), ("d", 3, "unreadable"), ("d", 4, None)]
    made = chunks.layout_blocks(spark.createDataFrame(rows, "doc string, page_number int, blocks_json string"), ["doc"])
    got = [(r["part"], r["label"], r["title"], r["page"], r["content"]) for r in chunks.block_groups(made, ["doc"]).orderBy("part").collect()]
    assert got == [(0, "text", "One", 1, "One\n\na\n\nb"), (1, "table", "One", 1, "| t |"), (2, "text", "One", 1, "c"), (3, "text", "Two", 1, "d"), (4, "text", "Two", 2, "e")]
    parts = chunks.split_tables(chunks.block_groups(made, ["doc"]), 50)
    assert parts.count() == 5 and chunks.block_groups(made.limit(0), ["doc"]).count() == 0


def test_overlapping_hits_are_merged(spark):
    text = "liquidity resilience of the treasury in detail"
    spans = [(0, 20), (10, 30), (30, 40), (5, 5), (38, 46)]
    rows = [(f"c{i}", "r", p, s, a, b, text[a:b]) for i, ((a, b), s, p) in enumerate(zip(spans, (1.0, 3.0, 2.0, 9.0, 0.5), (4, 2, 3, 1, 5), strict=True))]
    got = [tuple(r) for r in search.merge_hits(spark.createDataFrame(rows, "chunk_id string, record_id string, place int, score double, start int, stop int, content string"), "record_id").select("rank", "score", "start", "stop", "content").orderBy("rank").collect()]
    assert got == [(1, 9.0, 5, 5, ""), (2, 3.0, 0, 30, text[:30]), (3, 2.0, 30, 46, text[30:46])]


def test_requests_are_checked_and_filters_of_a_deployment_win(spark):
    docs = spark.createDataFrame([(1, "bond costs", "a"), (2, "bond", "b"), (3, None, "b")], "doc_id bigint, text string, source string")
    run = lambda **k: [r["doc_id"] for r in search.search(docs, "bond", key="doc_id", text="text", record=None, **k).orderBy("rank").collect()]
    assert run() == [2, 1] and run(filters={"source": "a"}) == [1] and run(filters={"source": "a"}, access={"source": "b"}) == [2] and run(filters={"source": None}) == [2, 1]
    assert run(filters={"source": "none"}) == []
    for bad in ({"k": 0}, {"k": 21}, {"mode": "rerank"}, {"mode": "vector"}, {"filters": {f"f{i}": None for i in range(51)}}):
        with pytest.raises(ValueError):
            run(**bad)
    with pytest.raises(ValueError):
        search.search(docs, " ", key="doc_id", text="text", record=None)


def test_selection_over_a_large_group_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(evidence, "RANKS", 7)
    draw = random.Random(4)
    rows = [(f"e{i:03d}", f"{draw.choice(['covered bond', 'coverage', 'rates', ''])}", draw.choice(["hot", "hot", "hot", "a", None]), "t", None, None, draw.choice(["web", "document", "calculation"]), draw.choice([None, "open_web"]), draw.choice([0.5, 0.9]), draw.choice([None, 3, 8]), draw.choice([1, 5, 40, 300])) for i in range(160)]
    schema = "evidence_id string, content string, entity string, title string, field_name string, value double, source_type string, quality_tier string, confidence double, rank int, cost int"
    df = evidence.scored(spark.createDataFrame(rows, schema), "covered bond coverage").withColumn("group", evidence.group_key(F.col("entity"), F.col("source_type"), F.lit("p")))
    got = {r["evidence_id"] for r in evidence.selected(df, 700).collect()}

    def key(r):
        text = " ".join(x for x in (r[1], r[2], r[3]) if x is not None).lower()
        return (sum(t in text for t in ("covered", "bond", "coverage")), evidence.SOURCE_PRIORITY[r[6]], evidence.QUALITY_PRIORITY.get(r[7], 0), 0, r[8], -r[9] if r[9] else evidence.NO_RANK, r[0])

    groups = {}
    for r in sorted(rows, key=key, reverse=True):
        groups.setdefault(f"{r[2] or 'global'}::{r[6]}::p", []).append(r)
    want, used, turn = set(), 0, 0
    while any(len(g) > turn for g in groups.values()):
        for name in sorted(groups):
            if len(groups[name]) > turn and used + groups[name][turn][10] <= 700:
                want, used = want | {groups[name][turn][0]}, used + groups[name][turn][10]
        turn += 1
    assert got == want


def test_claims_need_their_quote(spark):
    ledger = spark.createDataFrame([("e1", "net income rose by 4 per cent", "document", None, []), ("e2", "a snippet that says income fell", "web", "search_result_snippet", []), ("e3", "income of 25 by formula", "calculation", None, ["declarative_formula"])], "evidence_id string, content string, source_type string, content_basis string, tags array<string>")
    rows = [("r", "c1", 1, "t", "net income rose", ["e1", "e2", "e1", "zz"]), ("r", "c2", 2, "t", "income fell", ["e2"]), ("r", "c3", 3, "t", "income of 25", ["e3"]), ("r", "c4", 4, "t", "short", ["e1"]), ("r", "c5", 5, "t", None, None), ("r", "c6", 6, " ", "net income rose", ["e1"]), ("r", "c7", 21, "t", "net income rose", ["e1"]), ("r", "c8", 7, "t", "not said anywhere", ["e1"])]
    got = {r["claim_id"]: (r["status"], r["evidence_ids"]) for r in validation.valid_claims(spark.createDataFrame(rows, "report_id string, claim_id string, place int, text string, quote string, evidence_ids array<string>"), ledger).collect()}
    assert got == {"c1": ("supported", ["e1"]), "c2": ("inferred", ["e2"]), "c3": ("inferred", ["e3"]), "c5": ("inferred", [])}
    claims = spark.createDataFrame([("c1", ["e1", "e2"]), ("c2", ["e3"]), ("c3", [])], "claim_id string, evidence_ids array<string>")
    assert {r["claim_id"] for r in validation.without_conflicts(claims, spark.createDataFrame([("e2",)], "evidence_id string")).collect()} == {"c2", "c3"}


def test_windows_of_memory_over_block_borders(spark, monkeypatch):
    monkeypatch.setattr(memory, "WIDTH", 4)
    draw = random.Random(9)
    rows = [(t, i, draw.choice(["r1", "r1", "r2", None]), draw.randint(1, 9)) for t in ("hot", None, "b") for i in range(1, 40 if t == "hot" else 9) if draw.random() < 0.8]
    df = spark.createDataFrame(rows, "thread string, sequence int, run_id string, tokens int")
    got = {(r["thread"], r["sequence"]) for r in memory.suffix_within(df, ["thread"], "sequence", "tokens", 30).collect()}
    runs = {(r["thread"], r["sequence"]): r["run_number"] for r in memory.run_groups(df, ["thread"], "sequence").collect()}
    want, numbers = set(), {}
    for t in ("hot", None, "b"):
        mine, used, n, last = sorted(r for r in rows if r[0] == t), 0, 0, object()
        for r in reversed(mine):
            used += r[3]
            if used > 30:
                break
            want.add(r[:2])
        for r in mine:
            n, last = n + (r[2] != last), r[2]
            numbers[r[:2]] = n
    assert got == want and runs == numbers


def test_slots_and_promotion(spark):
    m = [("u", "m1", "profile", "Currency", "prefers euro amounts in all tables", 2), ("u", "m2", "profile", "Style", "prefers euro amounts in all tables now", 3), ("v", "m3", "profile", "Currency", "prefers euro amounts in all tables", 9), ("u", "m4", "other", "Currency", "x", 1)]
    c = [("u", "c1", "profile", " currency ", "something else"), ("u", "c2", "profile", "Money", "prefers euro amounts in all tables"), ("u", "c3", "profile", "Tone", "writes short answers"), (None, "c4", "profile", None, None)]
    memories = spark.createDataFrame(m, "user_id string, memory_id string, kind string, title string, content string, at int").withColumn("updated_at", F.timestamp_seconds("at"))
    got = {r["candidate_id"]: r["memory_id"] for r in memory.memory_slots(spark.createDataFrame(c, "user_id string, candidate_id string, kind string, title string, content string"), memories, ["user_id"]).collect()}
    assert got == {"c1": "m1", "c2": "m1"}
    rows = [("a", 0.9, "add", "今后", "t", "c"), ("b", 0.9, "add", "s", "t", "只用于本次报告"), ("d", 0.7, "add", "s", "t", "c"), ("e", 0.9, "ignore", "s", "t", "c"), ("f", 0.75, "add", "s", "t", "今后本次也是")]
    kept = memory.usable_candidates(spark.createDataFrame(rows, "id string, confidence double, operation string, scope string, title string, content string"))
    assert {r["id"] for r in kept.collect()} == {"a", "f"}


def test_web_results_are_kept_in_order_of_rank(spark):
    """A result that loses by its address doesn't take a later one's content with it."""
    rows = [("q", 1, "https://a.com/x", "one"), ("q", 2, "https://a.com/x?utm_source=1", "two"), ("q", 3, "https://b.com/", "TWO "), ("q", 4, "https://c.com", "one"), ("q", 5, "ftp://d.com/", "five"), ("q", 6, "https://e.com", " "), ("w", 1, "https://a.com/x", "one"), ("q", 7, "https://sub.b.com/?b=%C3%A9&a=", "seven")]
    df = spark.createDataFrame([(s, r, "t", u, c, None, None) for s, r, u, c in rows], "search string, rank int, title string, url string, description string, extra_snippets array<string>, published_at string")
    got = {(r["search"], r["rank"]): r["url"] for r in web.web_evidence(df, ["search"]).collect()}
    assert got == {("q", 1): "https://a.com/x", ("q", 3): "https://b.com/", ("q", 7): "https://sub.b.com/?b=%C3%A9&a=", ("w", 1): "https://a.com/x"}
    assert {r["rank"] for r in web.web_evidence(df.where("search = 'q'"), ["search"], ["b.com"]).collect()} == {2 + 1, 7}
    assert web.web_evidence(df.limit(0), ["search"]).count() == 0
    host = "https://x.example.com:8443/a?UTM_Medium=1&GCLID=2&b=1"
    assert spark.createDataFrame([(host,)], "u string").select(tk.canonical_url(F.col("u"))).first()[0] == "https://x.example.com:8443/a?b=1"


def test_metric_requests(spark):
    rows = [
        (1, "ratio", {"numerator": 1.0, "denominator": 3.0}, None, None), (2, "ratio", {"numerator": 1.0, "denominator": 0.0}, None, None), (3, "ratio", {"numerator": None}, None, None), (4, "nope", {}, None, None),
        (5, "future_value", {"present_value": 100.0, "rate": 0.1, "periods": 2.0}, None, "EUR"), (6, "future_value", {"present_value": 100.0, "rate": -1.0, "periods": 2.0}, None, None), (7, "max_drawdown", {}, [100.0, 80.0, 120.0, 110.0], None),
        (8, "max_drawdown", {}, [1.0, 0.0], None), (9, "annualized_volatility", {"periods_per_year": 12.0}, [0.1], None), (10, "annualized_return", {"periods_per_year": 12.0}, [0.1, -1.0], None), (11, "sharpe", {"periods_per_year": 12.0, "risk_free_rate": 0.0}, [0.1, 0.1], None),
        (12, "loan_payment", {"principal": 120.0, "rate": 0.0, "periods": 12.0}, None, "EUR_per_period"), (13, "cagr", {"begin": 1e-90, "end": 1e90, "years": 0.1}, None, None), (14, "ratio", {"numerator": 1.0, "denominator": 2.0}, None, "EUR"),
        (15, "max_drawdown", None, None, None),
    ]
    df = spark.createDataFrame(rows, "request_id int, operation string, inputs map<string,double>, series array<double>, unit string")
    got = {r["request_id"]: r["error_code"] or r["value"] for r in metrics.metric_batch(df).collect()}
    want = {1: 0.3333333333, 2: "division_by_zero", 3: "invalid_input", 4: "unknown_operation", 5: 121.0, 6: "invalid_rate", 7: -0.2, 8: "invalid_series", 9: "invalid_series", 10: "invalid_return", 11: "division_by_zero", 12: 10.0, 13: "numeric_overflow", 14: "invalid_unit", 15: "invalid_series"}
    assert {k: v if isinstance(v, str) else pytest.approx(v) for k, v in got.items()} == want


def test_values_are_cleaned(spark):
    one = lambda c, **v: spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} {'double' if isinstance(x, float) else 'string'}" for k, x in v.items())).select(c).first()[0]
    assert one(clean.rounded(F.col("a"), 2), a=2.675) == 2.67 and one(clean.rounded(F.col("a"), 0), a=2.5) == 2.0
    assert one(clean.normal_text(F.col("a")), a="ﬁne\r\n\r\n\r\n\r\nＡ \x07 b  c \n") == "fine\n\nA b c"
    assert one(clean.field_name(F.col("a")), a="Stockholders' equity") == "stockholders_equity"
    nested = {"Token": "x", "list": list(range(130)), "deep": [{"content": "y", "ok": "z" * 2100}]}
    got = json.loads(one(clean.redact_json(F.col("a")), a=json.dumps(nested)))
    assert got["Token"] == clean.HIDDEN and got["list"][-1] == "... 30 more" and got["deep"][0]["content"] == clean.OMITTED and len(got["deep"][0]["ok"]) == 2012
    assert one(clean.redact_json(F.col("a")), a="{broken") is None
    assert one(clean.or_default(F.col("a"), F.lit("d")), a="0") == "d" and one(clean.first_text(F.col("a"), F.lit(" b ")), a=" ") == "b" and one(clean.confidence(F.col("a")), a="1.7") == 1.0 and one(clean.confidence(F.col("a")), a="high") == 0.5
    assert [one(clean.exchange_code(F.col("a")), a=x) for x in ("600519.ss", "000001", "AAPL", "0700.HK")] == ["600519.SH", "000001.SZ", "AAPL.US", "0700.HK"]
    assert [one(clean.symbol_class(F.col("a")), a=x) for x in ("600519.SS", "aapl", "ü")] == ["a_share", "us", "other"]


def test_more_payloads(spark):
    def landed(kind, *objects):
        return payloads.parsed(spark.createDataFrame([(json.dumps(o),) for o in objects] + [("{broken",), (None,)], "payload string"), "payload", kind)

    tick = landed("tick", {"data": {"tick_list": [{"code": "aapl", "tick_time": "1710000000000", "last_price": "2.5"}, {"code": "b", "price": "1"}]}})
    assert [(r["symbol"], str(r["as_of"]), r["current_price"]) for r in payloads.first_ticks(tick).collect()] == [("AAPL", "2024-03-09", 2.5)]
    chart = landed("history", {"symbol": "A", "chart": {"result": [{"timestamp": [1704067200, 1704067200, 1704153600], "indicators": {"quote": [{"close": [1.0, 2.0, None]}]}}]}})
    assert [(str(r["date"]), r["close"], r["price_basis"]) for r in payloads.chart_history(chart).collect()] == [("2024-01-01", 2.0, "close")]
    pages = spark.createDataFrame([("d", json.dumps({"page": 1, "blocks": [{"block_label": "text", "block_content": "b", "block_order": 2}, {"block_label": "doc_title", "block_content": "T", "block_order": 1}, {"block_label": "number", "block_content": "7"}, {"block_content": " "}]}))], "doc string, payload string")
    rows = pages.select("doc", F.from_json("payload", payloads.SCHEMAS["ocr"]).alias("p")).select("doc", "p.*")
    assert [(r["number"], r["label"], r["content"], r["title"]) for r in payloads.ocr_blocks(rows, "doc").orderBy("number").collect()] == [(0, "heading", "T", "T"), (1, "text", "b", "T")]
    facts = spark.createDataFrame([(1, "Revenues", "USD", 5.0, "p"), (1, "RevenueFromContractWithCustomerExcludingAssessedTax", "USD", 7.0, "q"), (1, "Unheard", "USD", 1.0, "p")], "cik bigint, concept string, unit string, value double, period string")
    assert [(r["label"], r["value"]) for r in payloads.labelled_facts(facts).collect()] == [("Revenue", 7.0)]
    found = landed("search", {"web": {"results": [{"title": "t", "url": "https://a.com", "description": "d"}] * 3}}).withColumn("search", F.lit("q"))
    assert payloads.search_results(found, "search", 2).count() == 2
    found = landed("pages", {"data": {"webPages": {"value": [{"name": "t", "url": "https://a.com", "snippet": "d", "summary": None}]}}}).withColumn("search", F.lit("q"))
    assert payloads.page_results(found, "search", 9).first()["extra_snippets"] == []


def test_ledger_scans_and_appends(spark):
    ledger = spark.createDataFrame([("t", "e1", 1, "user"), ("t", "e2", 5, "ai"), ("u", "e3", 2, "user")], "thread string, event_id string, sequence int, event_kind string")
    assert [r["event_id"] for r in state.scan_after(ledger, {"thread": "t"}, 0, 5, ["ai"]).collect()] == ["e2"]
    new = spark.createDataFrame([("t", "e2", 1), ("t", "e9", 2), ("t", "e9", 2), ("w", "e8", 3)], "thread string, event_id string, at int").withColumn("at", F.timestamp_seconds("at"))
    assert {(r["event_id"], r["sequence"]) for r in state.appended(ledger, new, "thread", "event_id", ["at", "event_id"]).collect()} == {("e9", 6), ("e8", 1)}


def test_identifiers_and_answers(spark):
    one = lambda c, text: spark.createDataFrame([(text,)], "a string").select(c).first()[0]
    from tallyspan.functions import checks

    assert [one(checks.ticker(F.col("a")), x) for x in (" aapl ", "x y", None, "600519.SS")] == ["AAPL", None, None, "600519.SS"]
    assert [str(one(checks.iso_date(F.col("a")), x)) for x in ("2024-02-29", "2023-02-29", "2024-2-1", None)] == ["2024-02-29", "None", "None", "None"]
    assert one(checks.series_ids(F.split("a", ",")), "cpi, gdp,CPI,b d") == ["CPI", "GDP"]
    assert one(checks.report_text(F.col("a")), "# a\n[b] | `c`") == "\\# a \\[b\\] \\| \\`c\\`"
    assert [one(checks.gap_code(F.col("a")), x) for x in ("as_of_missing", "Bad code", None)] == ["as_of_missing", "data_gap", "data_gap"]
    assert one(checks.discovery_tokens(F.col("a")), "corpus.search for 利率研究 and v2-beta v2-beta") == ["corpus.search", "for", "利率研究", "and", "v2-beta"]
    assert [one(checks.safe_identifier(F.col("a")), x) for x in ("../a b/c", "…", None)] == ["a_b_c", "item", "item"]
    assert [one(checks.fenced_json(F.col("a")), x) for x in ('so:\n```json\n{"a": 1}\n```', 'x {"b": {"c": 2}} y', "{broken", None)] == ['{"a": 1}', '{"b": {"c": 2}}', None, None]
    assert one(checks.at(F.split("a", ","), 2, F.lit("d")), "x,y") == "d" and one(checks.fact_period(F.lit(" "), F.col("a")), "2024") == "2024"


def test_library_and_audit(spark):
    from tallyspan.operators import audit, library

    docs = spark.createDataFrame([("d1", "x"), ("d2", "y"), ("d2", "y")], "id string, body string")
    new = spark.createDataFrame([("d2", None), ("d3", "z")], "id string, body string")
    assert {tuple(r) for r in library.merged_sets(docs, new, ["id"]).collect()} == {("d1", "x"), ("d2", None), ("d3", "z")}
    vectors = spark.createDataFrame([("d1", [3.0, 4.0]), ("d2", None), ("d3", [0.0, 0.0]), ("d4", [1.0]), ("d5", [float("inf"), 1.0])], "id string, embedding array<double>")
    assert [(r["id"], r["embedding"]) for r in library.unit_vectors(vectors, "id").collect()] == [("d1", [0.6, 0.8])]
    made = library.embed_missing(docs.unionByName(new), vectors.where("id = 'd1'"), "id", "body", lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert sorted((r["id"], r["embedding"]) for r in made.collect()) == [("d2", [1.0, 1.0]), ("d2", [1.0, 1.0]), ("d3", [1.0, 1.0])]
    manifests = spark.createDataFrame([("d1", "m", 2), ("d4", "m", 2), ("d3", "other", 2)], "id string, embedding_model string, embedding_dimension int")
    assert [r["id"] for r in library.vectors_of_model(vectors, manifests, ["id"], "m").collect()] == ["d1"]
    rows = spark.createDataFrame([("c:2", 1, "a"), ("c:10", 2, "b"), ("c:2", 3, "z"), ("odd", 1, "q")], "call_id string, place int, status string")
    assert [(r["call_id"], r["status"]) for r in audit.merged_calls(rows, "call_id", "place").orderBy("number", "call_id").collect()] == [("odd", "q"), ("c:2", "z"), ("c:10", "b")]
    texts = spark.createDataFrame([(1, "Harrow Freight's margin"), (2, "harrow the field freight"), (3, None), (4, "利率 Wexley")], "id int, t string")
    names = spark.createDataFrame([("Harrow Freight",), ("Wexley",), (" ",), (None,)], "n string")
    assert {tuple(r) for r in audit.leaks(texts, names, "id", "t", "n").collect()} == {(1, "harrow freight"), (4, "wexley")}
    assert audit.leaks(texts, names.limit(0), "id", "t", "n").count() == 0
    observed = spark.createDataFrame([("r1", "succeeded", 2), ("r2", "succeeded", 1), ("r3", "failed", 5)], "run string, status string, observations int")
    assert [r["run"] for r in audit.eligible(observed).collect()] == ["r1"]
    assert library.cascade({"docs": docs}, new, ["id"])["docs"].count() == 1
