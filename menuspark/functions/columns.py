"""How to keep costly expressions from being copied."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a costly value that it names several times: the value is computed once a row, as a lambda's argument, where a plain
    expression would be copied to each place."""
    return F.element_at(F.transform(F.array(value), use), 1)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once for each row.

    Catalyst moves filters and projections below others by copying the expressions they use; nested higher-order functions then
    grow out of hand. It doesn't move anything through a generator's output, so the columns come out of one that makes
    one row. It stays in the same stage and needs no shuffle.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
