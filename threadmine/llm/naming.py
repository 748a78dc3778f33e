"""Column names that meet none of a table's, and draws that repeated rows cannot swell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free_prefix(prefix: str, columns: list[str]) -> str:
    """``prefix``, as often as it takes for no column to begin with it, whatever its case."""
    free = prefix
    while any(c.lower().startswith(free) for c in columns):
        free += prefix
    return free


def exact(columns: list[str]) -> list[Column]:
    """The columns by their names to the letter, dots included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def drawn(rows: DataFrame, share: float, seed: int) -> DataFrame:
    """Different rows, each with the chance ``share``.

    The draw goes by all columns, so an id that many rows have is thinned like any other, and
    rows that repeat others are dropped: at most ``share`` times the rows are expected.
    """
    u = F.pmod(F.xxhash64(*exact(rows.columns), F.lit(seed)), F.lit(1 << 32))
    return rows.filter(u / F.lit(float(1 << 32)) < F.lit(share)).distinct()
