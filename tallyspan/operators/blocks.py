"""Windows over keys that may hold a large part of all rows.

A window that is ordered over a whole key puts the key into one task. Here the rows of a key are cut into blocks that
follow each other in the order (days, months, ranges of positions); windows run inside a block, and what a block needs
from the ones before is one row of figures, folded over the blocks of its key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = "__block"


def by_time(at: str, characters: int) -> Column:
    """The block of a date, a timestamp or ISO text: its first characters (4: year, 7: month, 10: day)."""
    return F.substring(F.col(at).cast("string"), 1, characters)


def before(keys: list[str]) -> W:
    """All blocks of a key before the current one."""
    return W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)


def with_figures(rows: DataFrame, figures: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the figures of their key and block; null keys and blocks meet each other."""
    names = [*keys, BLOCK]
    other = figures.select(*[F.col(c).alias(f"__of_{c}") for c in names], *[c for c in figures.columns if c not in names])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in names])
    return rows.join(other, same, "left").drop(*[f"__of_{c}" for c in names])
