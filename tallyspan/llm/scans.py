"""Repairing text of scanned pages (problem 3).

The lines of a page are labelled by a hidden Markov model with the states header, number, body and break. Of a line five
features of its layout are observed: its place on the page, its shape, whether the same line (apart from numbers and
misread letters) stands on another page of the document and how much of its use in the corpus is at edges, its width, and
whether a blank line sets it off. A state emits each of them by a table of its own. The tables begin as rough guesses
(``START``) and are fitted by Baum-Welch on all pages; every page is decoded by the fitted model, whose labels are final.

Body and break lines are then put together again: words broken at line or page ends are joined, and words that the corpus
knows only with other letters are corrected from the word counts of all pages.

Defined results: null, empty and blank texts and pages of one line have no noise lines. Repeated pages count once in the
result. Lines are counted from 1 between line feeds; a carriage return belongs to no word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspan.session import cut

ROUNDS = 4
#: Weight of the first guesses beside the expected counts of a round.
GUESS = 0.05
#: Bound of the list of settled words that tasks hold to skip lookups; words beyond it are looked up by a join.
SETTLED_WORDS = 200_000
#: A plain word is a misreading if the other spelling is this many times as frequent and at least so frequent.
TIMES, LEAST = 10, 10
#: Distinct tokens that a task counts before it hands them on.
TASK_TOKENS = 300_000
#: Filled lines from the top and bottom that count as the edge of a page in the share of a line's use at edges.
EDGE = 3
#: Longest line that may be looked up as a header.
HEADER_WIDTH = 120
KEYS = ("tenant_id", "user_id", "document_id")

# Confusions of character recognition, as misread -> true.
CONFUSIONS = [
    ("c", "e"), ("e", "c"), ("1", "i"), ("1", "l"), ("†", "t"), ("í", "i"), ("0", "o"), ("ä", "a"), ("5", "s"), ("cl", "d"), ("ii", "u"),
    ("9", "g"), ("rn", "m"), ("li", "h"), ("6", "b"), ("8", "b"), ("n", "ri"), ("vv", "w"), ("h", "li"), ("ri", "n"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("g", "q"), ("q", "g"),
    ("m", "rn"), ("d", "cl"), ("u", "ii"), ("w", "vv"), ("í", "l"), ("|", "l"), ("4", "a"), ("3", "e"), ("7", "t"), ("2", "z"), ("l", "i"), ("i", "l"),
]
DIGIT_OF = {"O": "0", "o": "0", "l": "1", "I": "1", "|": "1", "Z": "2", "z": "2", "S": "5", "s": "5", "B": "8", "b": "6"}
HYPHENS = "-‐‑¬­"
PUNCTUATION = ".,;:!?()[]{}\"'“”‘’«»„|<>/=*_·•"

_D = "[0-9OIlZS]"
_NUMBERING = re.compile(
    rf"^[\s\-–—\[(]*(?:(?:page|seite|pagina|página|pag\.?|p\.|s\.|第)\s*)?[\-–—\[(]?\s*(?:(?={_D}*\s?[0-9]){_D}(?:\s?{_D}){{0,3}}|[ivxlc]{{1,6}})"
    rf"\s*页?\s*(?:(?:\||/|of|von|sur|de)\s*{_D}{{1,4}})?[\s\-–—\])]*$",
    re.I,
)
# At the edge of a page a number may have every digit misread, if marks or a page word set it off.
_MISREAD = "[0-9OolIZzSs|]{1,4}"
_MISREAD_NUMBERING = re.compile(
    rf"^(?:[\-–—\[(]\s*{_MISREAD}(?:\s*/\s*{_MISREAD})?\s*[\-–—\])]|{_MISREAD}\s*/\s*{_MISREAD}"
    rf"|(?i:page|seite|pagina|página|pag\.?|p\.|第)\s*{_MISREAD}(?:\s*(?:/|of|von|sur|de)\s*{_MISREAD})?\s*页?)$"
)
_CLEAN_NUMBER = re.compile(r"^[+\-–]?[\d][\d.,'’:]*%?$|^\d{4}[-–/]\d{2,4}$")
_LETTERED_NUMBER = re.compile(r"^[+\-–]?(?=[^\d]*\d|[OIl][.,])[\dOoIl|ZzSsBb.,'’]+%?$")
_HAN = re.compile(r"[㐀-鿿]")
_COLUMNS = re.compile(r"\S\s{2,}[\d(+\-]")
_BROKEN = re.compile(rf"[{HYPHENS}][ \r]*\n\s*")
_CAPTION = re.compile(r"^(?:chart|figure|fig\.|table|abbildung|tabelle|graphique|tableau|gráfico)\b.{0,60}$", re.I)
_PAGE_PART = re.compile(r"^\s*[0-9OIlZS]{1,4}\s{2,}|\s{2,}[0-9OIlZS]{1,4}\s*$")
# Letters and their misreadings become one spelling: an m is read as rn, n as ri, d as cl, h as li, u as ii, w as vv.
_FOLD = str.maketrans({"m": "rri", "n": "ri", "d": "ei", "h": "ii", "u": "ii", "w": "vv", "c": "e", "0": "o", "1": "i", "l": "i", "|": "i", "í": "i"}
                      | {"5": "s", "9": "g", "†": "t", "ä": "a", "6": "b", " ": ""})
HEADER_SHAPES = ("caps", "title", "sentence")
STATES = ("header", "number", "body", "break")


def fold_line(line: str) -> int:
    """Key of a line that is the same on all pages: without numbers and page number, misread letters folded."""
    low = re.sub(r"(?<!\w)\d+(?!\w)", "#", re.sub(r"\s+", " ", _PAGE_PART.sub("", line.strip()))).lower()
    return xxhash.xxh64_intdigest(low.translate(_FOLD)) - (1 << 63)


def shape(line: str) -> str:
    s = line.strip()
    if not s:
        return "blank"
    if "  " not in s and (len(s) > HEADER_WIDTH or len(s) > 24 and s[0].islower()) and s[0] not in "|<":
        return "text"  # the usual line
    if len(s) <= 24 and _NUMBERING.match(s):
        return "num"
    if s[0] == "|" or s[0] == "<" or _COLUMNS.search(s) and not _PAGE_PART.search(line):
        return "table"
    if len(s) <= 16 and _CLEAN_NUMBER.match(s):
        return "value"
    if _CAPTION.match(s):
        return "table"
    if len(s) <= HEADER_WIDTH and s[-1] == "." and s[0].isupper():
        return "sentence"
    if len(s) <= HEADER_WIDTH and s[-1] not in ".,;:-¬­‐)%" and (s[0].isupper() or s[0].isdigit()):
        letters = [c for c in s if c.isalpha()]
        return "caps" if letters and all(c.isupper() for c in letters) else "title"
    return "text"


def layout(text: str) -> tuple[list[str], list[str], list[str]]:
    """Lines, their place (T0.. from the top, B0.. from the bottom, of filled lines; M for the middle) and their shape."""
    lines = text.replace("\r", "").split("\n")
    shapes = [shape(x) for x in lines]
    filled = [i for i, s in enumerate(shapes) if s != "blank"]
    places = ["M"] * len(lines)
    last = len(filled) - 1
    for rank, i in enumerate(filled):
        back = last - rank
        if rank < 2 * EDGE and rank <= back:
            places[i] = f"T{rank}"
        elif back < 2 * EDGE:
            places[i] = f"B{back}"
        elif rank >= 2 * EDGE:
            continue
        if len(lines[i]) <= 40 and _MISREAD_NUMBERING.match(lines[i].strip()):
            shapes[i] = "num" if min(rank, back) < EDGE else "oddnum"
    return lines, places, shapes


FEATURES = ("place", "shape", "mark", "width", "off")
PLACES = ("M", *(f"{side}{i}" for side in "TB" for i in range(2 * EDGE)))
SHAPES = ("text", "blank", "num", "oddnum", "table", "value", "sentence", "caps", "title")
_MARKS_SEEN = ("", "rhi", "shi", "run", "sun")
#: Bits of a line's number in a page that are set aside for its mark.
MARK_BITS = 3
VALUES = dict(zip(FEATURES, (PLACES, SHAPES, _MARKS_SEEN, ("0", "12", "40", "80", "more"), ("", "off")), strict=True))
#: What a state can't emit: a running header is a line that comes again at edges, a page number has the form of one.
NEVER = 1e-30
# Rough guesses of what each state emits, from which the fit begins; values not named share what is left evenly.
START = {
    "place": {
        "header": {"T0": 0.4, "T1": 0.1, "T2": 0.04, "B0": 0.2, "B1": 0.12, "B2": 0.04, "M": 0.02},
        "number": {"T0": 0.15, "T1": 0.1, "B0": 0.5, "B1": 0.1, "M": 0.02},
        "body": {"M": 0.6},
        "break": {"M": 0.8},
    },
    "shape": {
        "header": {"title": 0.6, "caps": 0.25, "sentence": 0.1, "num": NEVER, "oddnum": NEVER, "blank": NEVER, "text": 0.01, "table": 0.01, "value": NEVER},
        "number": {"num": 0.98, "oddnum": 0.02, "blank": NEVER, "text": NEVER, "table": NEVER, "title": NEVER, "caps": NEVER, "sentence": NEVER, "value": NEVER},
        "body": {"text": 0.8, "title": 0.08, "sentence": 0.03, "table": 0.03, "caps": 0.01, "num": 0.002, "blank": 1e-4},
        "break": {"blank": 0.85, "caps": 0.08, "title": 0.05, "num": 1e-4},
    },
    "mark": {
        "header": {"rhi": 0.6, "shi": 0.25, "run": 0.12, "sun": NEVER, "": NEVER},
        "number": {"": 0.98},
        "body": {"": 0.9, "rhi": 0.0005, "shi": 0.001, "run": 0.004, "sun": 0.04},
        "break": {"": 0.85, "rhi": 0.0005, "shi": 0.001, "run": 0.004, "sun": 0.03},
    },
    "width": {"header": {"40": 0.5, "80": 0.4}, "number": {"12": 0.85, "40": 0.13}, "body": {"80": 0.6}, "break": {"0": 0.85}},
    "off": {"header": {"off": 0.6}, "number": {"off": 0.5}, "body": {"off": 0.1}, "break": {"off": 0.5}},
}
# Rough guesses of what follows a state, in the order of ``STATES``; the first row is the top of a page.
MOVES = (
    (0.4, 0.15, 0.35, 0.1),
    (0.1, 0.15, 0.25, 0.5),
    (0.1, 0.02, 0.38, 0.5),
    (0.03, 0.04, 0.8, 0.13),
    (0.05, 0.05, 0.65, 0.25),
)


# An observation as one number of mixed radix, the mark last; lines that have no mark yet have its first value.
_RADIX = ("place", "shape", "width", "off", "mark")
_SIZES = tuple(len(VALUES[f]) for f in _RADIX)
_AT = {f: {v: i for i, v in enumerate(VALUES[f])} for f in FEATURES}


def _observation(code: int) -> tuple[str, ...]:
    """The values of ``FEATURES`` that a number stands for."""
    at = dict(zip(_RADIX, np.unravel_index(code, _SIZES), strict=True))
    return tuple(VALUES[f][at[f]] for f in FEATURES)


def _unmarked(lines: list[str], places: list[str], shapes: list[str]) -> np.ndarray:
    """The numbers of the lines' observations, without marks."""
    out, last = np.zeros(len(lines), dtype="<u2"), len(lines) - 1
    place_at, shape_at, width_at, off_at = (_AT[f] for f in _RADIX[:4])
    for i, (place, kind) in enumerate(zip(places, shapes, strict=True)):
        n = len(lines[i])
        off = kind != "blank" and (i == 0 or i == last or shapes[i - 1] == "blank" or shapes[i + 1] == "blank")
        width = "0" if kind == "blank" else "12" if n <= 12 else "40" if n <= 40 else "80" if n <= 80 else "more"
        at = place_at[place] * _SIZES[1] + shape_at[kind]
        out[i] = ((at * _SIZES[2] + width_at[width]) * _SIZES[3] + off_at["off" if off else ""]) * _SIZES[4]
    return out


def _looked_at(pages: DataFrame) -> DataFrame:
    """doc, page_number, h and the observations without marks (seen) of all pages of more than one line, and of their lines
    that could be a header (capitalised, short, without end mark) the number, the key and whether they are at an edge."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, page, h, text in zip(batch["doc"], batch["page_number"], batch["h"], batch["text"], strict=True):
                if text and "\n" in text:
                    lines, places, shapes = layout(text)
                    at = [i for i, kind in enumerate(shapes) if kind in HEADER_SHAPES]
                    edges = [places[i] != "M" and int(places[i][1:]) < EDGE for i in at]
                    rows.append((doc, page, h, _unmarked(lines, places, shapes).tobytes(), at, [fold_line(lines[i]) for i in at], edges))
            yield pd.DataFrame(rows, columns=["doc", "page_number", "h", "seen", "line", "key", "edge"])

    kinds = "doc bigint, page_number int, h bigint, seen binary, line array<int>, key array<bigint>, edge array<boolean>"
    return pages.select("doc", "page_number", "h", "text").mapInPandas(look, kinds)


@F.pandas_udf(T.BinaryType())
def _marked(seen: pd.Series, marks: pd.Series) -> pd.Series:
    out = []
    for s, m in zip(seen, marks, strict=True):
        codes = np.frombuffer(s, dtype="<u2").copy()
        if m is not None:
            lines = np.asarray(m, dtype=np.int64)
            codes[lines >> MARK_BITS] += (lines & ((1 << MARK_BITS) - 1)).astype("<u2")
        out.append(codes.tobytes())
    return pd.Series(out, dtype=object)


def observed(pages: DataFrame) -> DataFrame:
    """doc, page_number, h, the observations (seen) and the number (n) of all pages of more than one line.

    Lines that could be a header are marked by repetition (r: on another page of the document, s: not) and use (hi: at edges
    five times or more). Lines that stand inside pages in more than a fifth of their uses have no mark.
    """
    place = ["doc", "page_number", "h"]
    held = cut(_looked_at(pages))
    keys = held.select(*place, F.explode(F.arrays_zip("line", "key", "edge")).alias("x")).select(*place, "x.*")
    corpus = keys.groupBy("key").agg(F.count("*").alias("n"), F.count_if("edge").alias("n_edge"))
    common = corpus.where("n_edge >= 0.8 * n")
    document = keys.groupBy("doc", "key").agg((F.min("page_number") != F.max("page_number")).alias("again"))
    share = F.when(F.col("n_edge") >= 5, "hi").otherwise("un")
    mark = F.concat(F.when(F.col("again"), "r").otherwise("s"), share)
    number = reduce(lambda c, i: c.when(mark == _MARKS_SEEN[i], i), range(2, len(_MARKS_SEEN)), F.when(mark == _MARKS_SEEN[1], 1))
    marked = (
        keys.where(F.col("page_number").isNotNull())
        .join(common, "key")
        .join(document, ["doc", "key"])
        .groupBy(*place)
        .agg(F.collect_set(F.shiftleft("line", MARK_BITS) + number).alias("marks"))
    )
    return held.groupBy(*place, "seen").agg(F.count("*").alias("n")).join(marked, place, "left").select(*place, _marked("seen", "marks").alias("seen"), "n")


class Model:
    """Logarithms of the moves between states and of what each state emits; decodes many pages at once."""

    def __init__(self, moves: np.ndarray | None = None, tables: dict[str, np.ndarray] | None = None):
        self.moves = np.log(np.asarray(MOVES)) if moves is None else moves
        self.tables = tables or {f: np.log(np.asarray([self._guess(f, s) for s in STATES])) for f in FEATURES}
        self._codes: dict[tuple[str, ...], int] = {}
        self._emit = np.zeros((0, len(STATES)))

    @staticmethod
    def _guess(feature: str, state: str) -> list[float]:
        named = START[feature][state]
        rest = max(NEVER, 1 - sum(named.values())) / max(1, len(VALUES[feature]) - len(named))
        return [named.get(v, rest) for v in VALUES[feature]]

    def _coded(self, pages: list[list[tuple[str, ...]]] | list[np.ndarray]) -> list[np.ndarray]:
        """Pages, of observations or of their numbers, in the order in which the model met the observations."""
        if any(isinstance(page, np.ndarray) for page in pages):
            met = np.unique(np.concatenate(pages))
            at = np.zeros(int(met.max(initial=0)) + 1, dtype=np.int64)
            at[met] = [self._codes.setdefault(_observation(c), len(self._codes)) for c in met]
            coded = [at[page] for page in pages]
        else:
            coded = [np.asarray([self._codes.setdefault(o, len(self._codes)) for o in page], dtype=np.int64) for page in pages]
        new = list(self._codes)[len(self._emit) :]
        if new:
            made = [sum(self.tables[f][:, VALUES[f].index(v)] for f, v in zip(FEATURES, o, strict=True)) for o in new]
            self._emit = np.vstack([self._emit, made])
        return coded

    def _blocks(self, pages: list[list[tuple[str, ...]]] | list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Pages of like length as one matrix (line, page) of observation codes, and where it holds a line."""
        coded = self._coded(pages)
        order = sorted((i for i in range(len(pages)) if len(coded[i])), key=lambda i: len(coded[i]))
        at = 0
        while at < len(order):
            longest, end = len(coded[order[at]]), at
            while end < len(order) and len(coded[order[end]]) <= 1.3 * longest + 2 and (end - at) * len(coded[order[end]]) < 400_000:
                end += 1
            end = max(end, at + 1)
            block = order[at:end]
            codes, filled = np.zeros((len(coded[block[-1]]), len(block)), dtype=np.int64), np.zeros((len(coded[block[-1]]), len(block)), dtype=bool)
            for j, i in enumerate(block):
                codes[: len(coded[i]), j], filled[: len(coded[i]), j] = coded[i], True
            yield block, codes, filled
            at = end

    def decode(self, pages: list[list[tuple[str, ...]]] | list[np.ndarray]) -> list[list[str]]:
        """The most likely states of the lines of every page."""
        out: list[list[str]] = [[] for _ in pages]
        for block, codes, filled in self._blocks(pages):
            emit = self._emit[codes]
            score, back = self.moves[0] + emit[0], np.zeros((*codes.shape, len(STATES)), dtype=np.int8)
            for t in range(1, len(codes)):
                through = score[:, :, None] + self.moves[1:][None]
                back[t] = through.argmax(1)
                new = through.max(1) + emit[t]
                score = np.where(filled[t][:, None], new, score)
                back[t][~filled[t]] = np.arange(len(STATES))
            at, path = score.argmax(1), np.zeros(codes.shape, dtype=np.int8)
            for t in range(len(codes) - 1, -1, -1):
                path[t] = at
                at = np.take_along_axis(back[t], at[:, None], 1)[:, 0]
            for j, i in enumerate(block):
                out[i] = [STATES[s] for s in path[: int(filled[:, j].sum()), j]]
        return out

    def expected(self, pages: list[list[tuple[str, ...]]] | list[np.ndarray], times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Expected moves and, per observation code, expected uses of every state, by forward and backward passes; ``times``
        says how often each page is there."""
        moves, uses = np.zeros(self.moves.shape), np.zeros((0, len(STATES)))
        times = np.ones(len(pages)) if times is None else np.asarray(times, dtype=float)
        go = np.exp(self.moves[1:])
        for block, codes, filled in self._blocks(pages):
            if len(uses) < len(self._emit):
                uses = np.vstack([uses, np.zeros((len(self._emit) - len(uses), len(STATES)))])
            often = times[block]
            emit = np.exp(self._emit - self._emit.max(1, keepdims=True))[codes]
            ahead, behind = np.zeros(emit.shape), np.ones(emit.shape)
            for t in range(len(codes)):
                new = (np.exp(self.moves[0])[None] if t == 0 else ahead[t - 1] @ go) * emit[t]
                new = new / new.sum(1, keepdims=True)
                ahead[t] = new if t == 0 else np.where(filled[t][:, None], new, ahead[t - 1])
            for t in range(len(codes) - 2, -1, -1):
                new = (behind[t + 1] * emit[t + 1]) @ go.T
                behind[t] = np.where(filled[t + 1][:, None], new / new.sum(1, keepdims=True), 1.0)
            held = ahead * behind
            held = held / held.sum(2, keepdims=True) * (filled * often)[:, :, None]
            for state in range(len(STATES)):
                uses[:, state] += np.bincount(codes.ravel(), held[:, :, state].ravel(), len(uses))
            moves[0] += held[0].sum(0)
            for t in range(1, len(codes)):
                after = emit[t] * behind[t]
                share = np.where(filled[t], often / ((ahead[t - 1] @ go) * after).sum(1), 0.0)
                moves[1:] += go * ((ahead[t - 1] * share[:, None]).T @ after)
        return moves, uses

    @classmethod
    def from_counts(cls, moves: np.ndarray, uses: dict[tuple[str, ...], np.ndarray], guess: float = GUESS) -> Model:
        """The maximisation step: shares of the expected counts and, with weight ``guess``, of the first guesses. The
        guesses keep the states apart, so that none turns into another kind of line that is more frequent."""
        of_state, first = sum(uses.values()), cls().tables
        tables = {f: np.exp(first[f]) * (guess * of_state[:, None] + 1) for f in FEATURES}
        for observation, n in uses.items():
            for f, v in zip(FEATURES, observation, strict=True):
                tables[f][:, VALUES[f].index(v)] += n
        # What a state can't emit stays so, however small an expected count would let it grow from round to round.
        logs = {f: np.where(first[f] <= np.log(NEVER) / 2, first[f], np.log(t / t.sum(1, keepdims=True))) for f, t in tables.items()}
        smooth = moves + 0.5
        return cls(np.log(smooth / smooth.sum(1, keepdims=True)), logs)


def fit_model(seen: DataFrame, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over the observations of all pages (seen, n): tasks sum the expected counts of their pages, the driver gets
    a row per kind of observation."""
    # Pages with the same observations are counted once, with their number.
    alike = cut(seen.groupBy("seen").agg(F.sum("n").alias("n")))
    model = Model()
    for _ in range(rounds):
        current = model

        def count(batches: Iterator[pd.DataFrame], current: Model = current) -> Iterator[pd.DataFrame]:
            for batch in batches:
                moves, uses = current.expected([np.frombuffer(x, dtype="<u2") for x in batch["seen"]], batch["n"].to_numpy())
                rows = [(f">{a}", line.tolist()) for a, line in enumerate(moves)]
                rows += [("|".join(o), uses[c].tolist()) for o, c in current._codes.items() if c < len(uses)]
                yield pd.DataFrame(rows, columns=["what", "n"])

        summed = alike.mapInPandas(count, "what string, n array<double>").groupBy("what").agg(*[F.sum(F.get("n", i)).alias(f"n{i}") for i in range(len(STATES))])
        counts = {r["what"]: np.asarray(r[1:], dtype=float) for r in summed.collect()}
        if not counts:
            return model
        moves = np.vstack([counts.pop(f">{a}", np.zeros(len(STATES))) for a in range(len(STATES) + 1)])
        model = Model.from_counts(moves, {tuple(o.split("|")): n for o, n in counts.items()})
    return model


def clean_number(token: str) -> str | None:
    """A number with letters in place of digits, as it should read."""
    if not _LETTERED_NUMBER.match(token) or not any(c.isalpha() or c == "|" for c in token):
        return None
    fixed = "".join(DIGIT_OF.get(c, c) for c in token)
    digits = sum(c.isdigit() for c in token)
    if not _CLEAN_NUMBER.match(fixed) or digits == 0:
        return None
    return fixed


def word_counts(pages: DataFrame) -> DataFrame:
    """word (lower case) and n over all pages; parts of words broken at line ends aren't counted.

    Tasks count the tokens of their pages, so that only distinct tokens are shuffled; case and punctuation are taken off
    those.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"]:
                if text:
                    seen.update(_BROKEN.sub("\x01", text).split())
            if len(seen) > TASK_TOKENS:
                yield pd.DataFrame(seen.items(), columns=["t", "n"])
                seen.clear()
        yield pd.DataFrame(seen.items(), columns=["t", "n"])

    raw = pages.select("text").mapInPandas(count, "t string, n bigint").groupBy("t").agg(F.sum("n").alias("n"))
    return (
        raw.where(~F.col("t").contains("\u0001"))
        .select(F.lower(F.btrim("t", F.lit(PUNCTUATION))).alias("word"), "n")
        .where((F.length("word") >= 2) & F.col("word").rlike(r"\p{L}") & ~F.col("word").rlike(r"[㐀-鿿]"))
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
    )


def _others(word: str) -> list[str]:
    out = set()
    for wrong, right in CONFUSIONS:
        at = word.find(wrong)
        while at >= 0:
            out.add(word[:at] + right + word[at + len(wrong) :])
            at = word.find(wrong, at + 1)
    return sorted(out)


_ODD = re.compile(r"[0-9†|ﬁﬂﬀíä]")


def _others_twice(word: str) -> list[str]:
    """Spellings with two places changed, one of which takes away a character that no word has inside."""
    odd = len(_ODD.findall(word))
    return sorted({b for a in _others(word) if len(_ODD.findall(a)) < odd for b in _others(a)} - {word, *_others(word)})


@F.pandas_udf(T.ArrayType(T.StringType()))
def _other_spellings(words: pd.Series) -> pd.Series:
    return words.map(_others)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _spellings_two_off(words: pd.Series) -> pd.Series:
    return words.map(_others_twice)


def corrections(words: DataFrame) -> DataFrame:
    """word, fixed: misread words and how they should read, from the counts of all words.

    A word with a character that no word has inside (a digit, a dagger) needs a known other spelling, with two places changed
    if one isn't enough; a word of letters alone needs one that is far more frequent.
    """
    known = words.select(F.col("word").alias("fixed"), F.col("n").alias("m"))
    odd = F.col("word").rlike(r"\p{L}[0-9†|ﬁﬂﬀ]|[0-9†|ﬁﬂﬀ]\p{L}")
    clean = ~F.col("fixed").rlike(r"[0-9†|ﬁﬂﬀ]")
    fits = F.when(odd, clean & (F.col("m") > F.col("n"))).otherwise(
        (F.col("m") >= TIMES * F.col("n")) & (F.col("m") >= LEAST)
    )

    def chosen(options: DataFrame) -> DataFrame:
        return options.join(known, "fixed").where(fits).groupBy("word").agg(F.max_by("fixed", F.struct("m", "fixed")).alias("fixed"))

    long = words.where(F.length("word") >= 3)
    once = cut(chosen(long.select("word", "n", F.explode(_other_spellings("word")).alias("fixed"))))
    # What stays odd has perhaps two misread places; these are few.
    rest = long.where((F.length("word") >= 6) & odd).join(once, "word", "left_anti")
    frequent = F.col("m") >= LEAST
    twice = rest.select("word", "n", F.explode(_spellings_two_off("word")).alias("fixed")).join(known, "fixed").where(clean & frequent)
    return once.unionByName(twice.groupBy("word").agg(F.max_by("fixed", F.struct("m", "fixed")).alias("fixed")))


def like_case(fixed: Column, sample: Column) -> Column:
    """``fixed`` in lower case, written with the capitals of ``sample``."""
    upper = (F.upper(sample) == sample) & (F.lower(sample) != sample) & (F.length(F.regexp_replace(sample, r"\P{L}", "")) > 1)
    first = F.substring(sample, 1, 1)
    return F.when(upper, F.upper(fixed)).when(
        first != F.lower(first), F.concat(F.upper(F.substring(fixed, 1, 1)), fixed.substr(F.lit(2), F.length(fixed)))
    ).otherwise(fixed)


_MARKS = "tenant_id string, user_id string, document_id string, page_number int, h bigint, line_no int, kind string, token string, other string"


def labelled_marks(pages: DataFrame, model: Model, settled: frozenset[str]) -> DataFrame:
    """What the decoded pages hold that is noise or has to be looked up.

    kind: header, number (whole lines); fixed (token with other as its correct form); word (token to look up); hyphen
    (token joined, other joined with the hyphen); open and start (the broken end and the first word of a page).
    """
    shared = pages.sparkSession.sparkContext.broadcast((model.moves, model.tables, settled))

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        moves, tables, known = shared.value
        decoder = Model(moves, tables)
        for batch in batches:
            rows: list[tuple] = []
            held = [r for r in batch[[*KEYS, "page_number", "h", "text", "seen"]].itertuples(index=False, name=None) if r[5] and r[5].strip()]
            decoded = decoder.decode([np.frombuffer(r[6] or b"", dtype="<u2") for r in held])
            for (tenant, user, document, page, h, text, _), states in zip(held, decoded, strict=True):
                lines = text.replace("\r", "").split("\n")
                put = lambda no, kind, token="", other="": rows.append((tenant, user, document, page, h, no, kind, token, other))  # noqa: E731,B023
                broken: tuple[int, str, str] | None = None
                first = True
                for no, (line, state) in enumerate(zip(lines, states or ["body"], strict=True), 1):
                    if state in ("header", "number"):
                        put(no, state)
                        continue
                    tokens = line.split()
                    if not tokens:
                        continue
                    if first:
                        put(no, "start", tokens[0])
                        first = False
                    if broken is not None:
                        at, part, mark_ = broken
                        tail = tokens.pop(0).rstrip(PUNCTUATION)
                        put(at, "hyphen", part + tail, part + "-" + tail)
                        broken = None
                    if tokens and len(tokens[-1]) > 1 and tokens[-1][-1] in HYPHENS and tokens[-1][-2].isalnum():
                        last = tokens.pop()
                        broken = (no, last[:-1].lstrip(PUNCTUATION), last[-1])
                    for token in tokens:
                        if token in known:
                            continue
                        t = token.strip(PUNCTUATION)
                        if len(t) < 2 or t.lower() in known or _CLEAN_NUMBER.match(t) or _HAN.search(t):
                            continue
                        number = clean_number(t)
                        if number is not None:
                            put(no, "fixed", t, number)
                        else:
                            put(no, "word", t)
                if broken is not None:
                    put(broken[0], "open", broken[1])
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _MARKS.split(", ")])

    return pages.mapInPandas(mark, _MARKS)


def found(pages: DataFrame) -> DataFrame:
    """Noise of scanned pages: keys, page_number, line_no, noise_type, repaired; distinct rows."""
    return noise(pages).where("noise_type <> 'carried'").select(*KEYS, "page_number", "line_no", "noise_type", "repaired").distinct()


def narrowed(pages: DataFrame) -> DataFrame:
    """Keys, page_number, text, a hash of the document's keys (doc) and one of the text (h), for pages with text."""
    return pages.where(F.col("text").isNotNull()).select(
        *KEYS, F.col("page_number").cast("int").alias("page_number"), "text", F.xxhash64(*KEYS).alias("doc"), F.xxhash64("text").alias("h")
    )


def noise(pages: DataFrame) -> DataFrame:
    """As ``found``, with the hash of the page's text (h), the token as it stands in the line ('' for whole lines and words
    broken at its end) and, for words broken across pages, the punctuation after their end (tail_mark). Rows of type
    'carried' say that the first word of a page belongs to the page before."""
    narrow = narrowed(pages)
    seen = cut(observed(narrow))
    page = ["doc", "page_number", "h"]
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in page])
    joined = narrow.join(seen.select(*[F.col(c).alias(f"__{c}") for c in page], "seen"), same, "left")
    model = fit_model(seen)
    words = cut(word_counts(narrow))
    fixes = cut(corrections(words))
    settled = frozenset(
        r["word"]
        for r in words.where((F.col("n") >= 3) & ~F.col("word").rlike(r"\d"))  # a misread number may be frequent, too
        .join(fixes, "word", "left_anti")
        .orderBy(F.desc("n"), "word")
        .limit(SETTLED_WORDS)
        .select("word")
        .collect()
    )
    marks = cut(labelled_marks(joined, model, settled))
    place = [*KEYS, "page_number", "h", "line_no"]
    none = F.lit("")
    lines = marks.where(F.col("kind").isin("header", "number")).select(
        *place, F.when(F.col("kind") == "header", "running_header").otherwise("page_number").alias("noise_type"), none.alias("repaired"), none.alias("token"), none.alias("tail_mark")
    )
    numbers = marks.where("kind = 'fixed'").select(*place, F.lit("misread_char").alias("noise_type"), F.col("other").alias("repaired"), "token", none.alias("tail_mark"))
    misread = (
        marks.where("kind = 'word'")
        .withColumn("word", F.lower("token"))
        .join(fixes, "word")
        .select(*place, F.lit("misread_char").alias("noise_type"), like_case(F.col("fixed"), F.col("token")).alias("repaired"), "token", none.alias("tail_mark"))
    )
    tail = F.rtrim(F.col("token"), F.lit(PUNCTUATION))
    following = marks.where("kind = 'start'").select(
        *KEYS, (F.col("page_number") - 1).alias("page_number"), F.col("h").alias("next_h"), F.col("line_no").alias("next_line"), tail.alias("tail"), F.expr("substring(token, length(tail) + 1)").alias("tail_mark")
    )
    across = (
        marks.where("kind = 'open'")
        .join(following, [*KEYS, "page_number"])
        .select(*place, F.concat("token", "tail").alias("token"), F.concat("token", F.lit("-"), "tail").alias("other"), "tail_mark", "next_h", "next_line")
    )
    inside = marks.where("kind = 'hyphen'").select(*place, "token", "other", none.alias("tail_mark"), F.lit(None).cast("bigint").alias("next_h"), F.lit(None).cast("int").alias("next_line"))
    breaks = inside.unionByName(across)
    plain = words.select(F.col("word").alias("__plain"), F.col("n").alias("n_plain"))
    kept = words.select(F.col("word").alias("__kept"), F.col("n").alias("n_kept"))
    looked = (
        breaks.join(plain, F.lower("token") == F.col("__plain"), "left")
        .join(kept, F.lower("other") == F.col("__kept"), "left")
        .withColumn("word", F.lower("token"))
        .join(fixes, "word", "left")
        .withColumn("tail", F.element_at(F.split("other", "-"), -1))
        .withColumn("__tail", F.lower("tail"))
        .join(words.select(F.col("word").alias("__tail"), F.col("n").alias("n_tail")), "__tail", "left")
    )
    n_plain, n_kept = F.coalesce("n_plain", F.lit(0)), F.coalesce("n_kept", F.lit(0))
    span = F.col("other").rlike(r"^\d[\d.,]*-\d[\d.,]*%?$")
    repaired = (
        F.when(span, F.col("other"))
        .when((n_plain == 0) & (n_kept == 0) & (F.coalesce("n_tail", F.lit(0)) >= 3), None)
        .when(n_kept > n_plain, F.col("other"))
        .when(F.col("fixed").isNotNull(), like_case(F.col("fixed"), F.col("token")))
        .otherwise(F.col("token"))
    )
    joined_words = looked.select(*place, F.lit("hyphen_break").alias("noise_type"), repaired.alias("repaired"), none.alias("token"), "tail_mark", "next_h", "next_line").where(
        F.col("repaired").isNotNull() & (F.col("repaired") != "")
    )
    # A broken word over two pages gives one row for each of them.
    here = F.struct(*[F.col(c) for c in ("page_number", "h", "line_no", "noise_type", "repaired", "token", "tail_mark")])
    there = F.struct(
        (F.col("page_number") + 1).alias("page_number"), F.col("next_h").alias("h"), F.col("next_line").alias("line_no"), F.lit("carried").alias("noise_type"), none.alias("repaired"), none.alias("token"), none.alias("tail_mark")
    )
    hyphens = joined_words.select(*KEYS, F.explode(F.when(F.col("next_h").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("x")).select(*KEYS, "x.*")
    return lines.unionByName(numbers).unionByName(misread).unionByName(hyphens)


def rebuilt(text: str, found_noise: Iterable[tuple[int, str, str, str, str]]) -> str:
    """A page's text in paragraphs, from its noise rows (line_no, noise_type, repaired, token, tail_mark).

    Whole noise lines go. A word is replaced where it stands alone between blanks and punctuation, which stay; a broken word
    takes the punctuation of both its ends. Lines of a paragraph are joined by a blank; rows of tables and headings in
    capitals stay lines of their own.
    """
    gone: set[int] = set()
    whole: dict[int, tuple[str, str]] = {}
    fixed: dict[int, dict[str, str]] = {}
    carried = False
    for no, kind, repaired, token, tail_mark in found_noise:
        if kind in ("running_header", "page_number"):
            gone.add(no)
        elif kind == "hyphen_break":
            whole[no] = max(whole.get(no, ("", "")), (repaired, tail_mark))
        elif kind == "carried":
            carried = True
        else:
            fixed.setdefault(no, {})[token] = repaired
    blocks: list[list[str]] = [[]]
    lines = text.replace("\r", "").split("\n")
    take_head, ends = carried, None  # whether the first word of the next line is used up; where its punctuation goes
    for no, line in enumerate(lines, 1):
        if no in gone:
            continue
        tokens = line.split()
        if not tokens:
            if ends is None:
                blocks.append([])
            continue
        kind = shape(line)
        own = kind in ("table", "caps", "value")
        if take_head:
            head = tokens.pop(0)
            if ends is not None:
                ends[0][ends[1]] += head[len(head.rstrip(PUNCTUATION)) :]
        take_head, ends = False, None
        changes, made = fixed.get(no, {}), []
        for token in tokens:
            t = token.strip(PUNCTUATION)
            if t in changes:
                at = token.index(t)
                token = token[:at] + changes[t] + token[at + len(t) :]
            made.append(token)
        if no in whole and made:
            word, tail_mark = whole[no]
            last = made[-1]
            made[-1] = last[: len(last) - len(last.lstrip(PUNCTUATION))] + word + tail_mark
            rest = any(lines[i].split() and i + 1 not in gone for i in range(no, len(lines)))
            take_head, ends = rest, (made, len(made) - 1) if rest else None
        if own and blocks[-1]:
            blocks.append([])
        if made:
            blocks[-1].append(made)  # type: ignore[arg-type]
        if own:
            blocks.append([])
    return "\n".join(" ".join(" ".join(made) for made in block) for block in blocks if block)


@F.pandas_udf(T.StringType())
def _rebuilt(text: pd.Series, found_noise: pd.Series) -> pd.Series:
    names = ("line_no", "noise_type", "repaired", "token", "tail_mark")
    return pd.Series([rebuilt(t, [tuple(x[n] for n in names) for x in (f if f is not None else [])]) for t, f in zip(text, found_noise, strict=True)], dtype=object)


def repaired_pages(pages: DataFrame) -> DataFrame:
    """Every page as paragraphs: keys, page_number, text. Noise lines go, broken words are joined (a word over two pages
    comes out whole on the first) and misread ones corrected; a blank line ends a paragraph unless a broken word goes on
    after it. Repeated pages come out once."""
    place = [*KEYS, "page_number", "h"]
    row = F.struct("line_no", "noise_type", "repaired", "token", "tail_mark")
    by_page = noise(pages).groupBy(*place).agg(F.array_sort(F.collect_set(row)).alias("noise"))
    other = by_page.select(*[F.col(c).alias(f"__{c}") for c in place], "noise")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in place])
    held = narrowed(pages).dropDuplicates(place)
    return held.join(other, same, "left").select(*KEYS, "page_number", _rebuilt("text", "noise").alias("text"))
