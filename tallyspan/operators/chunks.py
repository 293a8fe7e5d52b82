"""Cutting documents and their layout blocks into chunks for an index."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words, single Han characters and single marks.
TOKEN = re.compile(r"[A-Za-z0-9_]+|[一-鿿]|[^\sA-Za-z0-9_一-鿿]")
# Where a window ends naturally: blank lines, line ends, ends of sentences with closing quotes and blanks.
BOUNDARY = re.compile(r"\n{2,}|\n|[。！？.!?][\"'”’)\]]*\s*")
#: The share of a window that a natural end leaves at least.
LEAST_SHARE = 0.8
BLOCKS = "array<struct<label:string,content:string,page_number:int,order:int,paragraph_title:string>>"


def windows(text: str, size: int, overlap: int) -> Iterator[tuple[int, int, int, int]]:
    """start, stop (characters) and first, last (tokens, exclusive) of the chunks of one text: ``size`` tokens at most, the
    next one beginning ``overlap`` tokens before the end, ended at the last natural place of their last fifth."""
    places = [m.span() for m in TOKEN.finditer(text)]
    n, start = len(places), 0
    while start < n:
        hard = end = min(start + size, n)
        if hard < n:
            least = min(hard - 1, start + max(1, int(LEAST_SHARE * size)))
            stops = [m.end() for m in BOUNDARY.finditer(text, places[least - 1][0], places[hard - 1][1])]
            if stops:
                end = max((i for i in range(least, hard + 1) if places[i - 1][1] <= stops[-1]), default=hard)
        yield places[start][0], places[end - 1][1], start, end
        if end >= n:
            return
        start = max(start + 1, end - overlap)


def chunk_windows(documents: DataFrame, size: int = 1024, overlap: int = 256, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, chunk (from 0), chunk_id, start, stop, first, last and content of every chunk; texts without tokens give none.

    Each chunk begins where the last one ended, so a text is cut in one pass; texts are independent and stay in their tasks.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be below the size of a chunk")
    kind = documents.schema[key].dataType.simpleString()

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, t in zip(batch[key], batch[text], strict=True):
                rows = [(k, i, f"{k}-t{size}o{overlap}-{i}", *w, t[w[0] : w[1]]) for i, w in enumerate(windows(t, size, overlap))]
                if rows:
                    yield pd.DataFrame(rows, columns=[key, "chunk", "chunk_id", "start", "stop", "first", "last", "content"])

    held = documents.where(F.col(text).isNotNull()).select(key, text)
    return held.mapInPandas(cut_up, f"{key} {kind}, chunk int, chunk_id string, start int, stop int, first int, last int, content string")


def layout_blocks(pages: DataFrame, keys: list[str]) -> DataFrame:
    """The blocks of pages with readable blocks_json in order: keys, page, number, label, content, own_title, title.

    ``title`` is filled forward through a document: a block without one has that of the last block before it that has; the
    content of a heading is its own. Headers, footers, page numbers and blocks without content drop out. Repeated pages count
    once."""
    once = pages.where("blocks_json is not null").select(*keys, F.col("page_number").alias("page"), "blocks_json").distinct()
    rows = once.select(*keys, "page", F.posexplode(F.from_json("blocks_json", BLOCKS)).alias("pos", "b")).select(
        *keys,
        "page",
        F.coalesce("b.order", "pos").alias("number"),
        F.coalesce(F.lower("b.label"), F.lit("text")).alias("label"),
        F.trim("b.content").alias("content"),
        F.when(F.lower("b.label") == "heading", F.trim("b.content")).otherwise(F.nullif(F.trim("b.paragraph_title"), F.lit(""))).alias("own_title"),
    )
    held = rows.where((F.col("content") != "") & ~F.col("label").isin("header", "header_image", "footer", "footer_image", "number"))
    before = W.partitionBy(*keys).orderBy("page", "number").rowsBetween(W.unboundedPreceding, 0)  # the pages of one document
    return held.withColumn("title", F.last("own_title", ignorenulls=True).over(before))


def block_groups(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of text blocks of one title and page as one text; tables and charts stay alone: keys, part (from 0), label,
    title, page, content."""
    order = W.partitionBy(*keys).orderBy("page", "number")
    alone = F.col("label").isin("table", "chart")
    differs = ~F.lag("title").over(order).eqNullSafe(F.col("title")) | (F.lag("page").over(order) != F.col("page")) | F.lag(alone).over(order)
    begins = alone | F.coalesce(differs, F.lit(True)) | (F.row_number().over(order) == 1)
    numbered = blocks.withColumn("part", F.sum(begins.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)) - 1)
    return numbered.groupBy(*keys, "part").agg(
        F.max(F.when(alone, F.col("label")).otherwise("text")).alias("label"),
        F.min("title").alias("title"),
        F.min("page").alias("page"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "content"))), lambda x: x["content"]), "\n\n").alias("content"),
    )


def _count(text: str) -> int:
    return sum(1 for _ in TOKEN.finditer(text))


def _sliced(text: str, size: int) -> list[str]:
    """A text cut between tokens, ``size`` tokens each."""
    places = [m.span() for m in TOKEN.finditer(text)]
    groups = [places[i : i + size] for i in range(0, len(places), size)]
    return [text[g[0][0] : g[-1][1]] for g in groups]


def _rows(table: str) -> tuple[str, list[str], str]:
    """What stands before the rows of a table with its header, the rows, and what stands after them: HTML rows, else lines,
    where a second line of rules belongs to the header."""
    html = [m.span() for m in re.finditer(r"(?is)<tr\b.*?</tr\s*>", table)]
    if len(html) > 1:
        return table[: html[0][1]], [table[a:b] for a, b in html[1:]], table[html[-1][1] :]
    lines = table.splitlines(keepends=True)
    ruled = len(lines) > 1 and "-" in lines[1] and not lines[1].strip(" \t\r\n|:-")
    return "".join(lines[: 1 + ruled]), lines[1 + ruled :], ""


def table_parts(content: str, size: int) -> list[str]:
    """A table as parts of ``size`` tokens at most: whole rows, each part with the header (and, for HTML, the end) of the
    table; a row that is too long itself is cut between tokens. A table without rows stays whole, one whose header leaves no
    room is cut between tokens."""
    if _count(content) <= size:
        return [content]
    head, rows, tail = _rows(content)
    if not rows:
        return [content]
    room = size - _count(head + tail)
    if room <= 0:
        return _sliced(content, size)
    units = [piece for row in rows for piece in ([row] if _count(row) <= room else _sliced(row, room))]
    parts, used = [[]], 0
    for unit, n in zip(units, map(_count, units), strict=True):
        if parts[-1] and used + n > room:
            parts.append([])
            used = 0
        parts[-1].append(unit)
        used += n
    return [head + "".join(p) + tail for p in parts]


def split_tables(groups: DataFrame, size: int) -> DataFrame:
    """``block_groups`` with oversized tables cut into parts: adds piece (from 0)."""
    rest = [c for c in groups.columns if c != "content"]
    kinds = ", ".join(f"{c} {groups.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*r[:-1], i, p) for r in batch[[*rest, "content"]].itertuples(index=False, name=None) for i, p in enumerate(table_parts(r[-1], size))]
            yield pd.DataFrame(rows, columns=[*rest, "piece", "content"])

    tables = groups.where("label = 'table'").mapInPandas(run, f"{kinds}, piece int, content string")
    return groups.where("label <> 'table'").select(*rest, F.lit(0).alias("piece"), "content").unionByName(tables)
