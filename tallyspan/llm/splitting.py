"""Splitting oversized items at natural boundaries (problem 1).

An item is cut into atoms at every sentence, line or table-row end; an atom that alone would not fit is cut again at
clauses, words and at last between grapheme clusters. All pairs of neighbouring segments stand in a heap keyed by the
strength of the boundary between them, and the weakest boundaries are merged first while the combined size plus the
overlap fits the limit. Every piece after the first begins ``overlap`` characters before its own segment, so that two
consecutive pieces share exactly that many characters. Sizes are code points.

Defined results: an item without a visible character has no pieces, one within the limit has a single piece that is the
item itself, whatever the limit. Null content counts as empty. An overlap of the limit or more is lowered to limit - 1.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspan.functions.text import has_visible
from tallyspan.session import cut

DOC_KEYS = ("tenant_id", "user_id", "document_id")
DEFAULT_VERSION = "legacy"

# Strengths of boundaries, the strongest first. Fixed patterns of where a text, table or list may be cut.
_COARSE = regex.compile(
    r"(?P<s6>\n[ \t\r]*\n\s*)|(?P<s5></table>\s*|</t(?:r|head|body)>\s*(?=<))"
    r"|(?P<s4>\r?\n(?=\s*(?:\||[-*•]\s|\d+[.)]\s)))|(?P<s3>\r?\n)"
    r"|(?P<s2>[.!?…;]+[\"'”’)\]]*\s+|[。！？；]+[”’」』）]*\s*)"
)
_FINE = regex.compile(r"(?P<s1>[,，、:：]\s*|\s+|\|)")
_GRAPHEME = regex.compile(r"\X")


def _cuts(text: str, lo: int, hi: int, pattern: regex.Pattern) -> list[tuple[int, int]]:
    """(position, strength) of the boundaries strictly inside text[lo:hi]; the position is where the next atom begins."""
    found = []
    for m in pattern.finditer(text, lo, hi):
        if lo < m.end() < hi:
            found.append((m.end(), int(m.lastgroup[1:])))
    return found


def _atoms(text: str, limit: int) -> list[tuple[int, int]]:
    """Starts of the atoms with the strength of the boundary before each; every atom has at most ``limit`` characters."""
    out: list[tuple[int, int]] = [(0, 9)]
    out.extend(_cuts(text, 0, len(text), _COARSE))
    for pattern in (_FINE, None):
        if all((out[i + 1][0] if i + 1 < len(out) else len(text)) - out[i][0] <= limit for i in range(len(out))):
            return out
        refined: list[tuple[int, int]] = []
        for i, (start, strength) in enumerate(out):
            end = out[i + 1][0] if i + 1 < len(out) else len(text)
            refined.append((start, strength))
            if end - start <= limit:
                continue
            if pattern is not None:
                refined.extend(_cuts(text, start, end, pattern))
                continue
            last = start
            for m in _GRAPHEME.finditer(text, start, end):
                if m.end() - last > limit:
                    at = m.start() if m.start() > last else last + limit
                    while m.end() - at > limit:  # one cluster longer than the limit
                        refined.append((at, 0))
                        at += limit
                    refined.append((at, 0))
                    last = at
        out = refined
    return out


def piece_spans(text: str | None, max_chars: int, overlap: int) -> list[tuple[int, int]]:
    """Half-open spans of the pieces of ``text``, in order."""
    if text is None or not regex.search(r"[^\p{Z}\p{C}ᅟᅠ⠀ㅤﾠ͏]", text):
        return []
    n = len(text)
    max_chars = max(1, int(max_chars))
    if n <= max_chars:
        return [(0, n)]
    overlap = min(max(0, int(overlap)), max_chars - 1)
    atoms = _atoms(text, max_chars - overlap)
    start = [a for a, _ in atoms]
    end = start[1:] + [n]
    strength = [s for _, s in atoms]
    following = list(range(1, len(atoms))) + [-1]
    before = [-1, *range(len(atoms) - 1)]
    alive = [True] * len(atoms)
    heap = [(strength[i + 1], end[i + 1] - start[i], i, i + 1) for i in range(len(atoms) - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, left, right = heapq.heappop(heap)
        if not (alive[left] and alive[right]) or following[left] != right or end[right] - start[left] != size:
            continue  # one of the two has grown since; the pair stands in the heap again
        if size + (overlap if left else 0) > max_chars:
            continue
        end[left], alive[right] = end[right], False
        after = following[right]
        following[left] = after
        if after >= 0:
            before[after] = left
            heapq.heappush(heap, (strength[after], end[after] - start[left], left, after))
        if before[left] >= 0:
            heapq.heappush(heap, (strength[left], end[left] - start[before[left]], before[left], left))
    return [(max(0, start[i] - (overlap if i else 0)), end[i]) for i in range(len(atoms)) if alive[i]]


_SPANS = T.ArrayType(T.StructType().add("piece_start", "integer").add("piece_end", "integer"))


@F.pandas_udf(_SPANS)
def _spans_udf(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for content, limit, overlap in batches:
        yield pd.Series(
            [
                [{"piece_start": a, "piece_end": b} for a, b in piece_spans(t, m, o)]
                for t, m, o in zip(content, limit, overlap, strict=True)
            ]
        )


def page_items(pages: DataFrame) -> DataFrame:
    """The items of every page: its blocks, or its text where blocks_json is null, blank, unreadable or has no blocks.

    Columns: the document's keys, page_number, item_kind, block_order, item_no (place on the page), content. Rows that
    are repeated stay here; they are dropped once the items are small.
    """
    keyed = pages.select(*DOC_KEYS, "page_number", "text", F.try_parse_json("blocks_json").alias("__v")).select(
        *DOC_KEYS, "page_number", "text", F.try_variant_get("__v", "$", "array<variant>").alias("__b")
    )
    blocks = F.transform(
        F.col("__b"),
        lambda b, i: F.struct(
            F.lit("block").alias("item_kind"),
            F.try_variant_get(b, "$.order", "int").alias("block_order"),
            i.alias("item_no"),
            F.try_variant_get(b, "$.content", "string").alias("content"),
        ),
    )
    page = F.array(
        F.struct(
            F.lit("page").alias("item_kind"),
            F.lit(-1).alias("block_order"),
            F.lit(0).alias("item_no"),
            F.col("text").alias("content"),
        )
    )
    return keyed.select(
        *DOC_KEYS,
        "page_number",
        F.explode(F.when(F.coalesce(F.size("__b"), F.lit(0)) > 0, blocks).otherwise(page)).alias("__i"),
    ).select(*DOC_KEYS, "page_number", "__i.*")


def latest_manifests(manifests: DataFrame) -> DataFrame:
    """One manifest per document: the one indexed last; repeated rows count once."""
    return manifests.groupBy(*DOC_KEYS).agg(
        F.max_by(
            F.struct("chunking_version", "chunk_count"),
            F.struct("indexed_at", F.coalesce("chunk_count", F.lit(-1)), F.coalesce("chunking_version", F.lit(""))),
        ).alias("__m")
    ).select(*DOC_KEYS, "__m.chunking_version", "__m.chunk_count", F.lit(True).alias("has_manifest"))


def with_policy(df: DataFrame, policies: DataFrame) -> DataFrame:
    """Add max_chars and overlap_chars by chunking_version; a null or unknown version takes the default policy."""
    known = policies.select("chunking_version", "max_chars", "overlap_chars").dropDuplicates(["chunking_version"])
    default = known.agg(
        F.max(F.when(F.col("chunking_version") == DEFAULT_VERSION, F.col("max_chars"))).alias("__max"),
        F.max(F.when(F.col("chunking_version") == DEFAULT_VERSION, F.col("overlap_chars"))).alias("__over"),
    )
    return (
        df.join(known, "chunking_version", "left")
        .crossJoin(F.broadcast(default))  # one row
        .withColumn("max_chars", F.coalesce("max_chars", "__max"))
        .withColumn("overlap_chars", F.coalesce("overlap_chars", "__over"))
        .drop("__max", "__over")
    )


def split_items(pages: DataFrame, manifests: DataFrame, policies: DataFrame) -> DataFrame:
    """Every item once, with the spans of its pieces under its document's policy.

    Columns: the document's keys, page_number, item_kind, block_order, item_no, content (null where the item is within
    every policy's limit and so is its own single piece), n_chars, visible, max_chars, overlap_chars, pieces. Content
    travels through the join only where it may have to be cut.
    """
    least = policies.agg(F.min("max_chars").alias("__least"))  # one row
    items = page_items(pages).crossJoin(F.broadcast(least))
    slim = items.select(
        *DOC_KEYS,
        "page_number",
        "item_kind",
        "block_order",
        "item_no",
        F.coalesce(F.length("content"), F.lit(0)).alias("n_chars"),
        has_visible(F.col("content")).alias("visible"),
        F.xxhash64("content").alias("__h"),
        F.when(F.length("content") > F.coalesce("__least", F.lit(0)), F.col("content")).alias("content"),
    )
    once = slim.dropDuplicates(
        [*DOC_KEYS, "page_number", "item_kind", "block_order", "item_no", "n_chars", "__h"]
    ).drop("__h")
    joined = with_policy(once.join(latest_manifests(manifests), list(DOC_KEYS), "left"), policies)
    small = F.slice(
        F.array(
            F.struct(F.lit(0).alias("piece_start"), F.col("n_chars").alias("piece_end"))
        ),
        1,
        F.when(F.col("visible"), 1).otherwise(0),
    )
    over = F.col("visible") & (F.col("n_chars") > F.col("max_chars"))
    large = joined.where(over).withColumn("pieces", _spans_udf("content", "max_chars", "overlap_chars"))
    return large.unionByName(joined.where(~over).withColumn("pieces", small.cast(large.schema["pieces"].dataType)))


def pieces(pages: DataFrame, manifests: DataFrame, policies: DataFrame) -> DataFrame:
    """The pieces of all oversized items, in order: keys, page_number, item_kind, block_order, piece_no, start, end, text."""
    return (
        split_items(pages, manifests, policies)
        .where(F.size("pieces") > 1)
        .select(
            *DOC_KEYS,
            "page_number",
            "item_kind",
            "block_order",
            "content",
            F.posexplode("pieces").alias("piece_no", "p"),
        )
        .select(
            *DOC_KEYS,
            "page_number",
            "item_kind",
            "block_order",
            "piece_no",
            "p.piece_start",
            "p.piece_end",
            F.col("content").substr(F.col("p.piece_start") + 1, F.col("p.piece_end") - F.col("p.piece_start")).alias(
                "piece_text"
            ),
        )
    )


def found(pages: DataFrame, manifests: DataFrame, policies: DataFrame) -> DataFrame:
    """Items that had to be cut and manifests whose chunk_count is below the least possible number of pieces.

    The candidates come from the splitter: an item with more than one piece, and a document whose count is below the
    number of pieces made; the formula for the least number then decides the manifests.
    """
    split = split_items(pages, manifests, policies)
    sized = split.select(
        *DOC_KEYS,
        "page_number",
        "item_kind",
        "block_order",
        F.size("pieces").cast("bigint").alias("made"),
        F.when(~F.col("visible"), 0)
        .when(F.col("n_chars") <= F.col("max_chars"), 1)
        .otherwise(
            F.ceil((F.col("n_chars") - F.col("overlap_chars")) / (F.col("max_chars") - F.col("overlap_chars")))
        )
        .cast("bigint")
        .alias("least"),
    )
    per_item = cut(sized)  # small rows, used twice; the items are split once
    cut_items = per_item.where(F.col("made") > 1).select(
        "item_kind", *DOC_KEYS, "page_number", F.col("block_order").cast("int").alias("block_order")
    )
    totals = per_item.groupBy(*DOC_KEYS).agg(F.sum("made").alias("made"), F.sum("least").alias("least"))
    short = (
        latest_manifests(manifests)
        .where(F.col("chunk_count").isNotNull())
        .join(totals, list(DOC_KEYS), "left")
        .where((F.col("chunk_count") < F.coalesce("made", F.lit(0))) & (F.col("chunk_count") < F.coalesce("least", F.lit(0))))
        .select(
            F.lit("manifest").alias("item_kind"),
            *DOC_KEYS,
            F.lit(0).alias("page_number"),
            F.lit(-1).alias("block_order"),
        )
    )
    return cut_items.unionByName(short).distinct()


def fitting_counts(pages: DataFrame, manifests: DataFrame, policies: DataFrame) -> DataFrame:
    """Per document the number of pieces made, beside the count its manifest holds."""
    made = split_items(pages, manifests, policies).groupBy(*DOC_KEYS).agg(
        F.sum(F.size("pieces").cast("bigint")).alias("pieces_made")
    )
    return made.join(latest_manifests(manifests).select(*DOC_KEYS, "chunk_count"), list(DOC_KEYS), "left").select(
        *DOC_KEYS, F.col("chunk_count").cast("bigint").alias("chunk_count"), "pieces_made"
    )


def reassembled(pages: DataFrame, manifests: DataFrame, policies: DataFrame) -> DataFrame:
    """Every item that was cut, put together again from its pieces: keys, page_number, item_kind, block_order, the MD5 of the
    text, and whether all pieces are within the limit and share exactly the overlap with the next; distinct rows."""
    empty = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    add = lambda acc, p: F.struct(
        F.concat(acc["text"], F.substring(F.col("content"), F.greatest(acc["at"], p["piece_start"]) + 1, p["piece_end"] - F.greatest(acc["at"], p["piece_start"]))).alias("text"), p["piece_end"].alias("at")
    )
    following = F.arrays_zip(F.slice("pieces", 2, F.size("pieces") - 1).alias("b"), F.slice("pieces", 1, F.size("pieces") - 1).alias("a"))
    return (
        split_items(pages, manifests, policies)
        .where(F.size("pieces") > 1)
        .select(
            *DOC_KEYS,
            "page_number",
            "item_kind",
            "block_order",
            F.md5(F.aggregate("pieces", empty, add)["text"]).alias("text"),
            F.forall("pieces", lambda p: p["piece_end"] - p["piece_start"] <= F.col("max_chars")).alias("within"),
            F.forall(following, lambda x: x["a"]["piece_end"] - x["b"]["piece_start"] == F.col("overlap_chars")).alias("overlapping"),
        )
        .distinct()
    )
