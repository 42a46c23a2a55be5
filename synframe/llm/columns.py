"""Columns of any name beside those that an operator uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def held(docs: DataFrame, *used: str) -> DataFrame:
    """The used columns, and all others in a struct ``_rest``: no column of an operator can meet one of the table's own."""
    rest = [named(c).alias(f"_{i}") for i, c in enumerate(docs.columns) if c not in used]
    return docs.select(*map(named, used), F.struct(*(rest or [F.lit(0).alias("_")])).alias("_rest"))


def freed(df: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """``held`` undone: the columns of ``docs`` in their order."""
    return df.select(*[named(c) if c in used else F.col("_rest").getField(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])
