import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspan.llm import tokenizing as tk

pytestmark = pytest.mark.skipif(not os.path.exists(f"{tk.TOKENIZER_DIR}/{tk.TOKENIZER_FILE}"), reason="needs the public vocabulary")


@pytest.fixture(scope="module")
def codec():
    return tk.Codec(tk.load_model())


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{tk.TOKENIZER_DIR}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    return lambda text: other.encode(text, add_special_tokens=False).ids


@given(st.text(max_size=200) | st.text(alphabet="ab '\n\t 1.,é中  s", max_size=200))
@settings(max_examples=400, deadline=None)
def test_equals_the_public_library_and_round_trips(codec, reference, text):
    ids = codec.encode(text)
    assert ids == reference(text) and codec.decode(ids) == text and codec.count(text) == len(ids)


def test_special_strings_are_text(codec, reference):
    text = "<|endoftext|> a  b \n <|endoftext|>"
    assert codec.encode(text) == reference(text) and 50256 not in codec.encode(text)


def test_rows(spark, reference):
    long = "interest coverage " * 20_000
    rows = [(1, None, "k"), (2, "", "k"), (3, " ", "k"), (4, "a\n\n b", "k"), (4, "a\n\n b", "k"), (5, long, "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, other string")
    got = tk.encode_texts(df).collect()
    assert [r["ids"] for r in got if r["doc_id"] < 3] == [[], []] and len(got) == 6
    assert next(r["ids"] for r in got if r["doc_id"] == 5) == reference(long)
    assert {r["doc_id"]: r["n_tokens"] for r in tk.count_tokens(df).collect()}[5] == len(reference(long))
    back = tk.decode_ids(tk.encode_texts(df)).collect()
    assert {r["doc_id"]: r["text"] for r in back}[4] == "a\n\n b"
    assert tk.encode_texts(df.limit(0)).count() == 0
