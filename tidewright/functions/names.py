"""Column names as users write them: any characters, so they are always quoted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """The column of exactly this name, dots, brackets and backquotes included."""
    return F.col(f"`{name.replace('`', '``')}`")


def cols(names) -> list[Column]:
    return [col(x) for x in names]
