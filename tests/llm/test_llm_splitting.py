import json
import math

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspan.llm import splitting as sp

POLICIES = [("legacy", 60, 10), ("small", 20, 5)]
PAGE = "tenant_id string, user_id string, document_id string, page_number int, text string, extraction_method string, blocks_json string, pieces string"
MANIFEST = "tenant_id string, user_id string, document_id string, content_sha256 string, chunk_count int, chunking_version string, index_status string, indexed_at timestamp"


@given(st.text(alphabet="ab c.,\n|!。中文́👩‍", max_size=400), st.integers(2, 60), st.integers(0, 30))
@settings(max_examples=300, deadline=None)
def test_pieces_cover_the_text_within_the_limit_with_the_exact_overlap(text, limit, overlap):
    spans = sp.piece_spans(text, limit, overlap)
    if not spans:
        assert not any(c.isalnum() for c in text)
        return
    if len(text) <= limit:
        assert spans == [(0, len(text))]
        return
    overlap = min(overlap, limit - 1)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and len(spans) >= math.ceil((len(text) - overlap) / (limit - overlap))
    assert all(b - a <= limit for a, b in spans)
    assert all(spans[i][1] - spans[i + 1][0] == overlap for i in range(len(spans) - 1))


def test_cuts_fall_on_natural_boundaries():
    text = "\n".join(f"| row {i} | {i * 11} | value |" for i in range(60))
    assert all(text[b - 1] == "\n" for _, b in sp.piece_spans(text, 300, 30)[:-1])
    prose = "This is a sentence about rates. " * 60
    assert all(prose[:b].endswith(". ") for _, b in sp.piece_spans(prose, 200, 20)[:-1])


def test_very_long_text_without_any_boundary():
    spans = sp.piece_spans("x" * 300_000, 1200, 150)
    assert len(spans) == math.ceil((300_000 - 150) / 1050) and max(b - a for a, b in spans) <= 1200


def tables(spark, pages, manifests):
    return (
        spark.createDataFrame([(*p, "clash") for p in pages], PAGE),
        spark.createDataFrame(manifests, MANIFEST),
        spark.createDataFrame(POLICIES, "chunking_version string, max_chars int, overlap_chars int"),
    )


def test_found_in_all_cases(spark):
    block = lambda order, content: {"label": "text", "content": content, "page_number": 1, "order": order}
    pages = [
        ("t", "u", "d1", 1, "x" * 61, None, None),
        ("t", "u", "d1", 1, "x" * 61, None, None),
        ("t", "u", "d1", 2, "y" * 61, "mcp", "[]"),
        ("t", "u", "d1", 3, "z" * 60, "mcp", "{broken"),
        ("t", "u", "d1", 4, "　" * 99, "mcp", "null"),
        ("t", "u", "d1", 5, None, None, None),
        ("t", "u", "d2", 1, "ignored" * 30, "mcp", json.dumps([block(1, "b" * 21), block(2, "c" * 20), block(3, None), block(4, " " * 50)])),
        (None, "u", "d3", 1, "n" * 61, None, None),
    ]
    manifests = [
        ("t", "u", "d1", "h", 4, None, "ok", None),
        ("t", "u", "d2", "h", 2, "small", "ok", None),
        ("t", "u", "d2", "h", 2, "small", "ok", None),
        ("t", "u", "empty", "h", 0, "small", "ok", None),
        ("t", "u", "null", "h", None, "small", "ok", None),
    ]
    got = {tuple(r) for r in sp.found(*tables(spark, pages, manifests)).collect()}
    assert got == {
        ("page", "t", "u", "d1", 1, -1), ("page", "t", "u", "d1", 2, -1), ("block", "t", "u", "d2", 1, 1), ("page", None, "u", "d3", 1, -1),
        ("manifest", "t", "u", "d1", 0, -1), ("manifest", "t", "u", "d2", 0, -1),
    }
    made = sp.pieces(*tables(spark, pages, manifests)).collect()
    assert all(len(r["piece_text"]) == r["piece_end"] - r["piece_start"] for r in made) and len(made) == 8


def test_empty_tables(spark):
    assert sp.found(*tables(spark, [], [])).count() == 0 and sp.pieces(*tables(spark, [], [])).count() == 0
