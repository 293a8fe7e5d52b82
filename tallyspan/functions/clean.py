"""Cleaning of texts and values: normal forms, field names, stable ids, rounding and redaction of nested values."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys whose values are secret, and keys whose values are content that logs leave out.
SECRET_KEYS = frozenset("api_key apikey access_token authorization password secret token".split())
CONTENT_KEYS = frozenset("content text body prompt messages report".split())
HIDDEN, OMITTED = "***REDACTED***", "***OMITTED***"
MOST_ITEMS, MOST_CHARACTERS = 100, 2_000


@F.pandas_udf(T.DoubleType())
def _round_half_even(value: pd.Series, digits: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else round(v, int(d)) for v, d in zip(value, digits, strict=True)], dtype="float64")


def rounded(value: Column, digits: int) -> Column:
    """Rounded as the binary value says, ties to even; Spark's own rounding takes the decimal text of a value instead."""
    return _round_half_even(value.cast("double"), F.lit(digits))


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normal_text(text: Column) -> Column:
    """NFKC; line feeds only, no control characters, single blanks, no blanks at line ends, two line feeds at most."""
    plain = F.regexp_replace(F.regexp_replace(_nfkc(text), "\r\n?", "\n"), r"[\x00-\x08\x0B-\x1F\x7F]", "")
    single = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"[ \t]+", " "), r" ?\n ?", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(single, r"^\s+|\s+$", "")


def field_name(label: Column) -> Column:
    """A label as a field's name: lower case, without apostrophes, blanks and hyphens as underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(label), "['’]", ""), r"[\s-]+", "_")


def _quoted(value: Column) -> Column:
    """A string as JSON writes it, other than ASCII kept."""
    escaped = F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), '"', r'\\"')
    for char, code in (("\n", r"\\n"), ("\r", r"\\r"), ("\t", r"\\t")):
        escaped = F.regexp_replace(escaped, char, code)
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def stable_id(prefix: str, **parts: Column) -> Column:
    """prefix_ and 20 digits of the SHA-256 of the parts as JSON with sorted keys, ', ' and ': ' between, nulls kept."""
    fields = [F.concat(F.lit(json.dumps(k) + ": "), F.coalesce(_quoted(parts[k].cast("string")), F.lit("null"))) for k in sorted(parts)]
    whole = F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(whole, 256), 1, 20))


def redact_value(value, secret: frozenset[str] = SECRET_KEYS, content: frozenset[str] = CONTENT_KEYS):
    """A nested value without secrets and content: values of such keys are replaced, lists and strings are cut to their bounds
    with a note of what is left out."""
    if isinstance(value, dict):
        return {k: HIDDEN if k.lower() in secret else OMITTED if k.lower() in content else redact_value(v, secret, content) for k, v in value.items()}
    if isinstance(value, list):
        kept = [redact_value(v, secret, content) for v in value[:MOST_ITEMS]]
        return kept + ([f"... {len(value) - MOST_ITEMS} more"] if len(value) > MOST_ITEMS else [])
    if isinstance(value, str) and len(value) > MOST_CHARACTERS:
        return value[:MOST_CHARACTERS] + f"... {len(value) - MOST_CHARACTERS} more"
    return value


@F.pandas_udf(T.StringType())
def redact_json(text: pd.Series) -> pd.Series:
    """JSON texts with ``redact_value`` applied, keys sorted; unreadable ones are null."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(redact_value(json.loads(t)), ensure_ascii=False, sort_keys=True)
        except ValueError:
            return None

    return text.map(one)


def or_default(value: Column, default: Column) -> Column:
    """The default where a value is null, zero or empty text."""
    text = value.cast("string")
    return F.when(value.isNull() | (text == "") | (text.try_cast("double") == 0), default).otherwise(value)


def first_text(*values: Column) -> Column:
    """The first that has a visible character, without outer blanks."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


def confidence(value: Column, default: float = 0.5) -> Column:
    """A number between 0 and 1; the default where it is none."""
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), default).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def has_han(text: Column) -> Column:
    return F.coalesce(text.rlike("[一-鿿]"), F.lit(False))


def symbol_class(symbol: Column) -> Column:
    """Where a ticker is traded: 'a_share' (six digits, also with .SS, .SH or .SZ), 'us' or 'other'."""
    s = F.upper(F.trim(symbol))
    return F.when(s.rlike(r"^\d{6}(\.(SS|SH|SZ))?$"), "a_share").when(s.rlike(r"^[A-Z][A-Z0-9.\-]{0,9}$"), "us").otherwise("other")


def exchange_code(symbol: Column) -> Column:
    """The ticker with its market: six digits get .SZ, .SS becomes .SH, others get .US."""
    s = F.upper(F.trim(symbol))
    return F.when(s.rlike(r"^\d{6}$"), F.concat(s, F.lit(".SZ"))).when(s.endswith(".SS"), F.regexp_replace(s, r"\.SS$", ".SH")).when(s.contains("."), s).otherwise(F.concat(s, F.lit(".US")))
