"""Keeping costly columns computed once.

A filter on a computed column is normally pushed below its projection, which
copies the whole expression into the filter for every mention and evaluates it
there again. Emitting the columns through a one-row generator stops that:
filters on them stay above, while filters on other columns still go down.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, keep: Sequence[str], computed: Mapping[str, Column]) -> DataFrame:
    """``keep`` columns as they are plus ``computed`` ones, evaluated once per row."""
    one = F.array(F.struct(*[c.alias(name) for name, c in computed.items()]))
    return df.select(*[F.col(f"`{c}`") for c in keep], F.inline_outer(one))
