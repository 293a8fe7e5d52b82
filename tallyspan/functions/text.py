"""Text predicates and normalisers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A character is visible unless it is a separator, control, format or unassigned character or one of
# the letters and symbols that are drawn as a blank.
VISIBLE = r"[^\p{Z}\p{C}\u115F\u1160\u2800\u3164\uFFA0\u034F]"
_FULLWIDTH = "".join(chr(0xFF01 + i) for i in range(94)) + "\u3000\u00a0\u202f\u2009"
_ASCII = "".join(chr(0x21 + i) for i in range(94)) + "    "


def has_visible(text: Column) -> Column:
    """True when the text holds at least one visible character; false for null."""
    return F.coalesce(text.rlike(VISIBLE), F.lit(False))


def strip_outer(text: Column) -> Column:
    """Remove outer white space of any script, including zero-width characters."""
    return F.regexp_replace(text, r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", "")


def fold_width(text: Column) -> Column:
    """Map full-width ASCII and wide blanks to their plain forms."""
    return F.translate(text, _FULLWIDTH, _ASCII)


# How credentials stand in error messages, and what is left of them; applied in this order.
HIDDEN = "***REDACTED***"
CREDENTIALS = [
    (r"(?i)\bbearer\s+[^\s,;]+", f"Bearer {HIDDEN}"),
    (r"(?i)\bsk-[a-z0-9_-]+", f"sk-{HIDDEN}"),
    (r"(?i)\b(api[_-]?key|access[_-]?token|token|password|secret|authorization)\s*[:=]\s*[^\s,;]+", f"$1={HIDDEN}"),
    (r"(?i)(https?://[^:/@\s]+:)[^@\s]+@", f"$1{HIDDEN}@"),
]


def hide_credentials(message: Column, limit: int | None = None) -> Column:
    """An error message without the credentials in it; ``limit`` keeps its first characters only, as short logs do."""
    shown = message if limit is None else F.substring(message, 1, limit)
    for pattern, left in CREDENTIALS:
        shown = F.regexp_replace(shown, pattern, left)
    return shown
