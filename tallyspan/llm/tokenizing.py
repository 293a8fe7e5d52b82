"""Encoding a corpus with a public byte-level BPE vocabulary (problem 6).

A sentencepiece BPE model is written directly from the vocabulary file: every token is a piece of byte-mapped
characters whose score is its negative rank, normalisation is the identity, and an unknown piece stands after the last
id. Texts are cut into the vocabulary's pre-tokens, these are encoded by the model, and decoding maps pieces back to
bytes. Tokens of words seen before come from a table that each task keeps, bounded by ``CACHE`` entries.

Defined results: null and empty texts have an empty list of ids. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER_FILE = "byte_bpe_50k.tiktoken"
CACHE = 500_000
#: Pre-tokens of the public vocabulary (a fixed pattern published with it).
PRETOKENS = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


@lru_cache(maxsize=1)
def byte_characters() -> tuple[str, ...]:
    """The visible character that stands for each byte: itself where printable, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, spare = {}, 0
    for byte in range(256):
        if byte in printable:
            table[byte] = chr(byte)
        else:
            table[byte], spare = chr(256 + spare), spare + 1
    return tuple(table[b] for b in range(256))


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids, from a file of base64 ranks."""
    lines = Path(path).read_bytes().splitlines()
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 0x7F
        out.append(low | (0x80 if n else 0))
        if not n:
            return bytes(out)


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model whose piece ids are the vocabulary's ids.

    Field numbers are those of the public sentencepiece model message: pieces 1 (text 1, score 2, type 3), trainer 2
    (model type 3, unknown id 40, absent begin 41, end 42, padding 43), normaliser 3 (name 1, dummy prefix 3, extra
    white space 4, escaped white space 5).
    """
    chars = byte_characters()
    by_id = sorted((rank, token) for token, rank in ranks.items())
    if [rank for rank, _ in by_id] != list(range(len(by_id))):
        raise ValueError("ids must run from 0 without gaps")
    out = bytearray()
    for rank, token in by_id:
        text = "".join(chars[b] for b in token).encode()
        out += _field(1, _field(1, text) + b"\x15" + struct.pack("<f", -float(rank)) + _number(3, 1))
    out += _field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2))
    absent = (1 << 64) - 1
    out += _field(
        2, _number(3, 2) + _number(4, len(by_id) + 1) + _number(40, len(by_id)) + b"".join(_number(n, absent) for n in (41, 42, 43))
    )
    out += _field(3, _field(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return bytes(out)


class Codec:
    """Encodes and decodes texts with one model; keeps the ids of words it has met."""

    def __init__(self, model: bytes):
        self.processor = sentencepiece.SentencePieceProcessor()
        self.processor.LoadFromSerializedProto(model)
        self.chars = byte_characters()
        self.bytes = {c: b for b, c in enumerate(self.chars)}
        self.pretokens: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def _pretoken(self, token: str) -> tuple[int, ...]:
        ids = self.pretokens.get(token)
        if ids is None:
            mapped = "".join([self.chars[b] for b in token.encode("utf-8", "surrogatepass")])
            ids = tuple(self.processor.encode(mapped))
            if len(self.pretokens) >= CACHE:
                self.pretokens.clear()
            if len(token) <= 64:
                self.pretokens[token] = ids
        return ids

    def _word(self, word: str) -> tuple[int, ...]:
        ids = tuple(i for token in PRETOKENS.findall(word) for i in self._pretoken(token))
        if len(self.words) >= CACHE:
            self.words.clear()
        if len(word) <= 64:
            self.words[word] = ids
        return ids

    def parts(self, text: str) -> list[tuple[int, ...]]:
        """Ids of the words of ``text``.

        A space before a character that is no white space always begins a pre-token, so the text may be cut there; runs
        of white space stay in one part.
        """
        if "  " in text:
            return [self._word(text)] if len(text) < 64 else [self._pretoken(t) for t in PRETOKENS.findall(text)]
        words = text.split(" ")
        out, get = [], self.words.get
        first = words[0]
        if first:
            out.append(get(first) or self._word(first))
        held = ""
        for word in words[1:]:
            if not word or word[0].isspace():
                held += " " + word  # the space belongs to the white space that follows
                continue
            if held:
                out = [self._pretoken(t) for t in PRETOKENS.findall(text)]
                return out
            word = " " + word
            out.append(get(word) or self._word(word))
        if held:
            return [self._pretoken(t) for t in PRETOKENS.findall(text)]
        return out

    def encode(self, text: str | None) -> list[int]:
        return [i for part in self.parts(text) for i in part] if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, self.parts(text))) if text else 0

    def decode(self, ids: list[int]) -> str:
        pieces = "".join(self.processor.id_to_piece(int(i)) for i in ids)
        return bytes(self.bytes[c] for c in pieces).decode("utf-8", "surrogatepass")


_CODECS: dict[int, Codec] = {}


def _codec(model: bytes) -> Codec:
    """One codec per worker process and model."""
    key = hash(model)
    if key not in _CODECS:
        _CODECS[key] = Codec(model)
    return _CODECS[key]


def load_model(directory: str = TOKENIZER_DIR, name: str = TOKENIZER_FILE) -> bytes:
    """The serialised model of a vocabulary file; its size is that of the vocabulary, about one megabyte."""
    return model_bytes(load_ranks(str(Path(directory) / name)))


def encode_texts(df: DataFrame, text: str = "text", out: str = "ids", model: bytes | None = None) -> DataFrame:
    """Replace ``text`` by the list of its token ids."""
    shared = df.sparkSession.sparkContext.broadcast(model or load_model())
    keep = [c for c in df.columns if c != text]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + f", `{out}` array<int>"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            flat: list[int] = []
            ends = [0]
            for value in batch.column(len(keep)).to_pylist():
                if value:
                    for part in codec.parts(value):
                        flat += part
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(
                pa.array(np.asarray(ends, dtype=np.int32)), pa.array(np.asarray(flat, dtype=np.int32))
            )
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [ids], names=[*keep, out])

    return df.select(*keep, text).mapInArrow(encode, schema)


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", model: bytes | None = None) -> DataFrame:
    """Replace ``text`` by the number of its tokens."""
    shared = df.sparkSession.sparkContext.broadcast(model or load_model())
    keep = [c for c in df.columns if c != text]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + f", `{out}` bigint"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            sizes = pa.array([codec.count(v) for v in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [sizes], names=[*keep, out])

    return df.select(*keep, text).mapInArrow(count, schema)


def decode_ids(df: DataFrame, ids: str = "ids", out: str = "text", model: bytes | None = None) -> DataFrame:
    """Replace a list of ids by the text it stands for."""
    shared = df.sparkSession.sparkContext.broadcast(model or load_model())

    @F.pandas_udf("string")
    def decode(column):
        codec = _codec(shared.value)
        return column.map(lambda x: codec.decode(x) if x is not None else None)

    return df.select(*[c for c in df.columns if c != ids], decode(ids).alias(out))
