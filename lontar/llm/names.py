"""Operators' own columns beside columns of any name.

``plain`` calls a table's columns c0, c1, ... so that neither dots and blanks in their names nor names that an operator
uses itself can hurt; ``restored`` gives them back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def plain(df: DataFrame, **more: Column) -> DataFrame:
    """df's columns as c0, c1, ..., and more columns (over df's own names) whose names don't look like that."""
    return df.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(df.columns)], *[x.alias(name) for name, x in more.items()])


def restored(staged: DataFrame, df: DataFrame) -> DataFrame:
    """The columns of df in a table made from ``plain(df)``, under their names."""
    return staged.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)])
