"""Costly derived columns that are computed once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def computed(df: DataFrame, cols: dict[str, Column], keep: Sequence[str] | None = None) -> DataFrame:
    """Add columns and pass them through a one-row ``inline``.

    Filters on the new columns stay above it. Pushed down through plain projections they would repeat
    the whole calculation, inputs included, inside the filter.
    """
    keep = [c for c in (keep or df.columns) if c not in cols]
    staged = df.select(*keep, *[c.alias(f"__c_{n}") for n, c in cols.items()])
    row = F.array(F.struct(*[F.col(f"__c_{n}").alias(n) for n in cols]))
    return staged.select(*keep, F.inline(row))
