"""Finding residue of templates and failed pages by a positive-unlabelled naive Bayes model (problem 8).

A text is cut into passages (lines and sentences). Records that hold one of a few unmistakable phrases are the trusted
records: passages with such a phrase are positives, the other passages of these records are residue or real text, and
everything else is unlabelled. Expectation-maximisation of a naive Bayes model over words and word pairs estimates how
residue and real text are worded. How residue is worded is counted in trusted records alone, since anything frequent in the
corpus could otherwise turn itself into a class; wordings that trusted records share with others are found in those, too.
The model is fitted on the passages of about ``FIT_DOCUMENTS`` documents and ``FIT_CHARACTERS`` characters at most, taken
by a hash of the id; every passage of every document is scored by it, whole.

The score of a passage is the highest sum of log-odds over a run of neighbouring words, so that residue glued to real
text is still seen; a run over less than half of its passage needs more. One place of a passage adds ``HIGHEST`` at most,
which is below ``THRESHOLD``: no word, pair or phrase decides alone. A record is residue if one of its passages scores ``THRESHOLD`` or more.

Defined results: null, empty and blank texts are no residue. Repeated records are scored each.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_DOCUMENTS, FIT_CHARACTERS = 20_000, 60_000_000
ROUNDS = 4
#: Probability of residue before its words are seen, for a passage of a trusted record at first and of any other record.
IN_TRUSTED, ELSEWHERE = 0.5, 0.003
#: Words and pairs of a passage overlap, so no more than this many count as independent.
INDEPENDENT = 6
THRESHOLD = 3.9
#: Bounds of what one place adds to a run.
HIGHEST, LOWEST = 2.0, -3.5
#: What a run lacks that covers less than half of its passage: ordinary words then need more places to speak for residue.
PARTIAL = 3.0
#: What a word adds that the model hasn't seen.
UNKNOWN = -0.5
#: Features of fewer passages than this don't enter the model, but for those of trusted passages.
LEAST_PASSAGES = 2

# Phrases of trusted passages, after lower case, digits as 0 and every symbol as a token of its own.
SEEDS = (
    # unfilled fields of templates
    "{ {", "$ {", "{ %", "< %", "# {", "[ [", "x . xx", "your text here", "hello undefined",
    # filler in place of text
    "lorem ipsum", "ipsum lorem", "placeholder text", "dummy text", "sample text", "texte provisoire", "todo :",
    "copy coming soon", "content coming soon", "text coming soon",
    # errors in place of content
    "000 not found", "000 forbidden", "000 bad gateway", "gateway time", "access denied", "traceback (", "erreur 000", "fehler 000",
    # scripts, cookies, another browser or a check of the visitor
    "enable javascript", "activer javascript", "aktivieren sie javascript", "< noscript", "requires cookies", "browser is not supported", "are human",
)

_SENTENCE_ENDS = [(end, end.rstrip(" ") + "\n") for end in (". ", "! ", "? ", "; ", "… ", "。", "！", "？", "；")]


class _Table(dict):
    """Translation of characters: digits to 0, letters kept, everything else set apart by blanks; made as it is met."""

    def __missing__(self, code: int) -> str | int:
        char = chr(code)
        if char.isdigit():
            value: str | int = "0"
        elif 0x4E00 <= code <= 0x9FFF:
            value = f" {char} "
        elif char.isalpha() or char == "·" or unicodedata.combining(char):
            value = code
        elif char.isspace():
            value = " "
        elif char in "'’":
            value = "'"
        else:
            value = f" {char} "
        self[code] = value
        return value


_TABLE = _Table()


def passages(text: str) -> list[list[str]]:
    """The words of every passage. Numbers of three digits stay 000, all others are 0."""
    text = unicodedata.normalize("NFC", text).replace("....", " ·fill· ").replace("_____", " ·fill· ").lower()
    for end, mark in _SENTENCE_ENDS:
        if end in text:
            text = text.replace(end, mark)
    out = []
    for line in text.split("\n"):
        words = line.translate(_TABLE).split()
        if words:
            out.append(words)
    return out


def _features(words: list[str]) -> tuple[list[str], list[str]]:
    units = [w if not w.startswith("0") or w in ("0", "000") else ("000" if len(w) == 3 else "0") for w in words]
    return units, [f"{a} {b}" for a, b in zip(["^", *units], units, strict=False)]


_SEEDED = re.compile("|".join(f" {re.escape(p)} " for p in SEEDS))


def is_trusted(units: list[str]) -> bool:
    """Whether a passage holds one of the phrases."""
    return _SEEDED.search(f" {' '.join(units)} ") is not None


def fit(counted: Iterable[tuple[str, bool, int]], rounds: int = ROUNDS) -> dict[str, float]:
    """Log-odds of residue per feature, by EM over (passage as words joined by blanks, of a trusted record, number)."""
    index: dict[str, int] = {}
    vectors, trusted_passage, in_trusted, numbers = [], [], [], []
    for joined, of_trusted, number in counted:
        units, pairs = _features(joined.split(" "))
        vectors.append(np.asarray(list({index.setdefault(f, len(index)) for f in (*units, *pairs)}), dtype=np.int64))
        trusted_passage.append(is_trusted(units))
        in_trusted.append(of_trusted)
        numbers.append(float(number))
    # What the phrases weigh where the sample has none of them.
    prior = {f: HIGHEST for phrase in SEEDS for f in ([" ".join(p) for p in itertools.pairwise(phrase.split(" "))])}
    if not any(trusted_passage) or all(trusted_passage):
        return prior
    size, many = len(index), len(vectors)
    sure, inside, weight = np.asarray(trusted_passage), np.asarray(in_trusted), np.asarray(numbers)
    lengths = np.asarray([len(v) for v in vectors], dtype=float)
    flat, row = np.concatenate(vectors), np.repeat(np.arange(many), lengths.astype(np.int64))
    prior_inside = IN_TRUSTED
    q = np.where(sure, 1.0, np.where(inside, IN_TRUSTED, 0.0))
    for step in range(rounds + 1):
        as_residue = np.where(inside, q * weight, 0.0)
        as_text = (1 - q) * weight
        residue, text = np.bincount(flat, as_residue[row], size), np.bincount(flat, as_text[row], size)
        if step == rounds:
            break
        ratio = np.log((residue + 0.02) / (as_residue.sum() + 1)) - np.log((text + 0.4) / (as_text.sum() + 1))
        score = np.bincount(row, np.clip(ratio, -4, 4)[flat], many) / lengths * np.minimum(lengths, INDEPENDENT)
        start = np.where(inside, prior_inside, ELSEWHERE)
        q = np.where(sure, 1.0, 1 / (1 + np.exp(-np.clip(score + np.log(start / (1 - start)), -40, 40))))
        open_ = inside & ~sure
        if open_.any():
            prior_inside = float(np.clip((q * weight)[open_].sum() / weight[open_].sum(), 1e-4, 0.9))
    # Odds of the feature's passages, not a ratio of rates: a word of both kinds must be in more residue than text.
    log_odds = np.clip(np.log(residue + 0.1) - np.log(text + 0.05), -7, 7)
    seen = np.bincount(flat, np.where(sure, LEAST_PASSAGES, weight)[row], size)
    return prior | {f: round(float(log_odds[i]), 4) for f, i in index.items() if seen[i] >= LEAST_PASSAGES}


class Scorer:
    def __init__(self, weights: dict[str, float]):
        self.words = {f: w / 2 for f, w in weights.items() if " " not in f}
        self.pairs = {f: w for f, w in weights.items() if " " in f}
        # A passage without any of these words has no place that adds to a run.
        self.raising = {f for f, w in self.words.items() if w > 0} | {
            f.split(" ")[1] for f, w in self.pairs.items() if w > 0
        }
        if "0" in self.raising:  # numbers of any length but three
            self.raising |= {"0" * n for n in range(2, 40) if n != 3}

    def passage(self, words: list[str]) -> float:
        if self.raising.isdisjoint(words):
            return 0.0
        units, pairs = _features(words)
        best = run = 0.0
        begin = length = 0
        word, pair = self.words.get, self.pairs.get
        for at, (unit, both) in enumerate(zip(units, pairs, strict=True)):
            w = pair(both)
            if w is None:  # a pair that the model hasn't seen: back off to the word
                w = word(unit, UNKNOWN)
            run += HIGHEST if w > HIGHEST else LOWEST if w < LOWEST else w
            if run < 0:
                run, begin = 0.0, at + 1
            elif run > best:
                best, length = run, at + 1 - begin
        return best if 2 * length >= len(units) else max(0.0, best - PARTIAL)

    def text(self, text: str | None) -> float:
        return max(map(self.passage, passages(text)), default=0.0) if text else 0.0


def _sample(documents: DataFrame, limit: int, characters: int) -> DataFrame:
    """About ``limit`` documents and ``characters`` characters, or all if there are fewer: texts with a low hash of their id.

    The bound of the hash follows from the number and size of the documents, so that nothing has to be sorted or moved.
    """
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text")
    size = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("c")).first()
    share = min(1.0, limit / max(1, size["n"]), characters / max(1, size["c"]))
    low = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 32) - 1)) < int(share * (1 << 32))
    return texts.where(low) if share < 1 else texts


def fit_model(documents: DataFrame, limit: int = FIT_DOCUMENTS, characters: int = FIT_CHARACTERS) -> dict[str, float]:
    """The model of a corpus. Tasks cut, label and count the sample's passages; the driver gets the distinct ones."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: Counter[tuple[str, bool]] = Counter()
            for text in batch["text"]:
                units = [_features(words)[0] for words in passages(text)]
                trusted = any(map(is_trusted, units))
                found.update((" ".join(u), trusted) for u in units)
            yield pd.DataFrame([(p, t, n) for (p, t), n in found.items()], columns=["passage", "trusted", "n"])

    counted = (
        _sample(documents.select("doc_id", "text"), limit, characters)
        .mapInPandas(count, "passage string, trusted boolean, n bigint")
        .groupBy("passage", "trusted")
        .agg(F.sum("n").alias("n"))
    )
    rows = counted.toPandas().sort_values(["passage", "trusted"])
    return fit(rows.itertuples(index=False, name=None))


def residue_scores(documents: DataFrame, weights: dict[str, float]) -> DataFrame:
    """doc_id and the highest passage score of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": batch["text"].map(scorer.text).astype(float)})

    return documents.select("doc_id", "text").mapInPandas(score, "doc_id bigint, score double")


def found(documents: DataFrame, limit: int = FIT_DOCUMENTS, threshold: float = THRESHOLD) -> DataFrame:
    """Ids of the documents that hold residue, wholly or in some part; distinct."""
    scored = residue_scores(documents, fit_model(documents, limit))
    return scored.where(F.col("score") >= threshold).select("doc_id").distinct()


def without_residue(documents: DataFrame, limit: int = FIT_DOCUMENTS) -> DataFrame:
    """The documents that hold no residue, all columns kept."""
    return documents.join(found(documents, limit), "doc_id", "left_anti")
