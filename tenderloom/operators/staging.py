"""Evaluate expensive columns exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def computed_once(df: DataFrame, columns: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """Add columns through a generator over one row.

    A plain projection would be inlined: Catalyst copies its expressions into every
    filter pushed through it. Filters on anything derived from these columns stay
    above the generator and read the finished values. ``keep`` limits what is carried on.
    """
    carried = ["*"] if keep is None else keep
    return df.select(*carried, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
