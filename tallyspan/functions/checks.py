"""Checks and small normal forms of identifiers, periods, codes and landed answers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_SERIES = 20


def ticker(text: Column) -> Column:
    """A ticker in capitals, null if it can't be one."""
    t = F.upper(F.trim(text))
    return F.when(t.rlike(r"^[A-Z0-9][A-Z0-9.\-]{0,14}$"), t)


def series_id(text: Column) -> Column:
    """A macro series' id in capitals, null if it can't be one."""
    t = F.upper(F.trim(text))
    return F.when(t.rlike(r"^[A-Z0-9][A-Z0-9_.\-]{0,49}$"), t)


def series_ids(listed: Column) -> Column:
    """A list of series ids: valid, distinct, in their order; null if more than ``MOST_SERIES`` remain."""
    held = F.array_distinct(F.filter(F.transform(listed, series_id), lambda x: x.isNotNull()))
    return F.when(F.size(held) <= MOST_SERIES, held)


def iso_date(text: Column) -> Column:
    """A date written YYYY-MM-DD that is in the calendar, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def fact_period(start: Column, end: Column) -> Column:
    """start/end, or the end alone for a point in time."""
    s, e = F.nullif(F.trim(start), F.lit("")), F.nullif(F.trim(end), F.lit(""))
    return F.when(s.isNotNull() & e.isNotNull(), F.concat(s, F.lit("/"), e)).otherwise(e)


def at(values: Column, index: int, default: Column) -> Column:
    """The value at an index from 0, the default where the array is too short or the value is empty."""
    return F.coalesce(F.nullif(F.get(values, F.lit(index)), F.lit("")), default)


def report_text(text: Column) -> Column:
    """Text that can stand in a line of a report: one line, without marks of headings, links, code and tables."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.regexp_replace(flat, r"([\\`*_\[\]<>#|])", r"\\$1")


def gap_code(code: Column) -> Column:
    """A gap's code, 'data_gap' if it isn't written in small letters, digits and underscores."""
    return F.when(code.rlike(r"^[a-z][a-z0-9_]{0,79}$"), code).otherwise("data_gap")


def discovery_tokens(text: Column) -> Column:
    """Distinct tokens of a name or description: Latin words with inner dots and hyphens, and whole Han runs."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]+(?:[.\-][a-z0-9_]+)*|[一-鿿]+"), F.lit(0)))


def safe_identifier(text: Column, most: int = 80) -> Column:
    """A name that can be part of a path: other characters become underscores, none at its ends; 'item' if nothing is left."""
    held = F.regexp_replace(F.substring(F.regexp_replace(F.trim(text), r"[^A-Za-z0-9._-]+", "_"), 1, most), r"^[._-]+|[._-]+$", "")
    return F.coalesce(F.nullif(held, F.lit("")), F.lit("item"))


def valid_key(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,199}$"), F.lit(False))


def fenced_json(text: Column) -> Column:
    """The JSON object of an answer, also inside a fence of three backticks; null if it can't be read."""
    held = F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")))
    return F.when(F.try_parse_json(held).isNotNull(), held)
