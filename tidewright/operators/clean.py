"""Missing runs, imputation, duplicate times, masks, splits, units and derived columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import col, cols
from ..functions.numeric import finite, half_up
from ..plans.order import numbered, with_neighbours, with_neighbours_of

ALGORITHMS = ("linear", "ffill", "spline", "zero")


def missing_runs(df: DataFrame, column: str, pos: str = "pos") -> DataFrame:
    """start, end and length of each closed interval of consecutive missing values."""
    marked = with_neighbours(df.select(col(pos), col(column)), column, pos).where(col(column).isNull())
    runs = marked.groupBy(F.coalesce(F.col("__prev.pos") + 1, F.lit(0)).cast("long").alias("start")).agg(F.max(col(pos)).alias("end"))
    return runs.withColumn("length", F.col("end") - F.col("start") + 1)


def impute(df: DataFrame, column: str, algorithm: str, start: int | None = None, end: int | None = None, pos: str = "pos") -> DataFrame:
    """df with the missing values of column, of all rows or of the closed interval [start, end], filled.

    linear goes straight from the last valid value before to the first after (0 if there is none before, that before if none after);
    spline does so along 3t^2 - 2t^3; ffill repeats the one before; zero is 0.
    """
    if start is None:
        return impute_all(df, {column: algorithm}, pos)
    _known(algorithm)
    v, inside = col(column), col(pos).between(start, end)
    # the neighbours of the whole interval: the last valid before its start, the first after its end
    here = F.struct(col(pos).alias("pos"), v.alias("value"))
    edge = df.where(v.isNotNull()).agg(F.max(F.when(col(pos) < start, here)).alias("b"), F.min(F.when(col(pos) > end, here)).alias("a")).first()
    low = edge["b"]["value"] if edge["b"] else 0.0
    high = edge["a"]["value"] if edge["a"] else low
    first, last = edge["b"]["pos"] if edge["b"] else start - 1, edge["a"]["pos"] if edge["a"] else end + 1
    filled = _filled(algorithm, col(pos), F.lit(low), F.lit(high), F.lit(first), F.lit(last), F.lit(start), F.lit(end - start + 1))
    return df.withColumn(column, F.when(inside, F.coalesce(v, filled)).otherwise(v))


def impute_all(df: DataFrame, algorithms: dict[str, str], pos: str = "pos") -> DataFrame:
    """df with all missing values of these columns filled, each by its algorithm, in one pass over the rows."""
    for algorithm in algorithms.values():
        _known(algorithm)
    zero = {c: F.coalesce(col(c), F.lit(0.0)) for c, a in algorithms.items() if a == "zero"}
    if zero:
        df = df.withColumns(zero)
    columns = [c for c, a in algorithms.items() if a != "zero"]
    if not columns:
        return df
    n = df.count() if any(algorithms[c] != "ffill" for c in columns) else 0
    out, made = with_neighbours_of(df, columns, pos), {}
    for i, c in enumerate(columns):
        before, after = F.col(f"__prev{i}"), F.col(f"__next{i}")
        low = F.coalesce(before["value"], F.lit(0.0))
        high = F.coalesce(after["value"], low)
        first, last = F.coalesce(before["pos"], F.lit(-1)), F.coalesce(after["pos"], F.lit(n))
        made[c] = F.coalesce(col(c), _filled(algorithms[c], col(pos), low, high, first, last, first + 1, last - first - 1))
    return out.withColumns(made).drop(*[f"__{x}{i}" for i in range(len(columns)) for x in ("prev", "next")])


def _known(algorithm: str) -> None:
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm: {algorithm}")


def _filled(algorithm: str, at: Column, low: Column, high: Column, first: Column, last: Column, begin: Column, length: Column) -> Column:
    """The value at a position between low (at first) and high (at last), or inside the interval from begin of some length."""
    if algorithm == "zero":
        return F.lit(0.0)
    if algorithm == "ffill":
        return low
    if algorithm == "linear":
        t = F.when(last - first <= 1, 0.5).otherwise((at - first) / F.greatest(last - first, F.lit(1)))
        return half_up(low + (high - low) * t, 4)
    t = (at - begin + 1) / (length + 1)
    return half_up(low + (high - low) * (-2.0 * t * t * t + 3.0 * t * t), 4)


def deduplicate(df: DataFrame, time: str, how: str, columns: list[str], pos: str = "pos") -> DataFrame:
    """One row per time (missing times are one group): its first row with the means of `columns`, its first or its last row; positions are counted anew."""
    if how not in ("mean", "first", "last"):
        raise ValueError(f"unknown way: {how}")
    rest = [c for c in df.columns if c not in (time, pos)]
    row = F.struct(col(pos), *cols(rest))
    ends = [F.min(row).alias("__row")] if how != "last" else [F.max(row).alias("__row")]
    means = [F.avg(col(c)).alias(f"__m{i}") for i, c in enumerate(columns)] if how == "mean" else []
    out = df.groupBy(col(time)).agg(*ends, F.min(col(pos)).alias("__first"), F.count(F.lit(1)).alias("__n"), *means)
    of = lambda c: F.col("__row")[c]
    value = {c: F.when(F.col("__n") > 1, F.coalesce(half_up(f"__m{i}", 4), of(c))).otherwise(of(c)) for i, c in enumerate(columns)} if how == "mean" else {}
    kept = out.select(of(pos).alias("__pos"), col(time), *[value.get(c, of(c)).alias(c) for c in rest])
    return numbered(kept, [F.col("__pos")], F.floor(F.col("__pos") / 65536), pos).drop("__pos").select(*cols(df.columns))


def mask(df: DataFrame, name: str, start: int, end: int, pos: str = "pos") -> DataFrame:
    """df with a 0/1 column, 1 from start to end; a column of this name is replaced."""
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_]*", name) or name == pos:
        raise ValueError(f"bad name: {name}")
    if not 0 <= start <= end < df.count():
        raise ValueError(f"no rows from {start} to {end}")
    return df.withColumn(name, col(pos).between(start, end).cast("bigint"))


def split(df: DataFrame, ratio: int, pos: str = "pos", name: str = "split") -> DataFrame:
    """train, val and test in row order: ratio percent to train, half of the rest (rounded down) to test."""
    if not 50 <= ratio <= 85:
        raise ValueError("ratio must be from 50 to 85")
    n = df.count()
    train = n * ratio // 100
    val = n - train - (n - train) // 2
    return df.withColumn(name, F.when(col(pos) < train, "train").when(col(pos) < train + val, "val").otherwise("test"))


def convert_unit(df: DataFrame, column: str, factor: float, offset: float = 0.0) -> DataFrame:
    return df.withColumn(column, half_up(col(column).try_cast("double") * F.lit(float(factor)) + F.lit(float(offset)), 4))


def derive(df: DataFrame, name: str, terms: list[str], operators: list[str]) -> DataFrame:
    """name = terms joined by operators from left to right, without precedence; anything missing, and division by 0, is missing."""
    if len(terms) < 2 or len(operators) != len(terms) - 1:
        raise ValueError("two terms or more, with an operator between each two")
    apply = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: F.try_divide(a, b)}
    out: Column = col(terms[0]).try_cast("double")
    for op, term in zip(operators, terms[1:], strict=True):
        out = apply[op](out, col(term).try_cast("double"))
    staged = df.withColumn("__raw", finite(out))
    return staged.withColumn(name, half_up("__raw", 4)).drop("__raw")


def duplicate_groups(df: DataFrame, time: str, pos: str = "pos") -> DataFrame:
    """Times that several rows share: the number of rows and the first one."""
    out = df.groupBy(col(time)).agg(F.count(F.lit(1)).alias("size"), F.min(col(pos)).alias("first_pos"))
    return out.where("size > 1")
