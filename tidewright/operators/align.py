"""Alignment of a side table on time, formula columns, and the union of several tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import formula, time_parts
from ..functions.names import col, cols
from ..functions.numeric import floor_round, number
from ..plans.order import Halo, hours, numbered

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


MAX_SIDE_COLUMNS = 100


class AlignmentError(ValueError):
    """A side table that can't be put on the main one's times."""


def seconds(time: str):
    return F.floor(F.timestamp_diff("MICROSECOND", F.expr(EPOCH), col(time)) / 1_000_000)


def _met(df: DataFrame, time: str, side: DataFrame, side_time: str, how: str, tolerance: float | None, pos: str, side_pos: str, day: int) -> DataFrame:
    """__main and __side: the row of df that each row of side goes to.

    nearest: the seconds of both tables are put in one sequence, cut into days; the nearest known second of earlier and later days is carried over.
    """
    main = df.where(col(time).isNotNull()).groupBy(seconds(time).alias("__sec")).agg(F.min(col(pos)).alias("__main"))
    asked = side.where(col(side_time).isNotNull()).select(seconds(side_time).alias("__sec"), col(side_pos).alias("__side"))
    if how == "exact":
        return asked.join(main, "__sec").select("__main", "__side")
    if how != "nearest":
        raise ValueError(f"unknown way: {how}")
    both = main.select("__sec", F.struct("__sec", "__main").alias("__m")).unionByName(asked.select("__sec").distinct(), allowMissingColumns=True).withColumn("__d", F.floor(F.col("__sec") / day))
    inside = Window.partitionBy("__d").orderBy("__sec")
    both = both.withColumns({"__l": F.last("__m", True).over(inside.rangeBetween(Window.unboundedPreceding, 0)), "__r": F.last("__m", True).over(Window.partitionBy("__d").orderBy(F.desc("__sec")).rangeBetween(Window.unboundedPreceding, 0))})
    days = both.groupBy("__d").agg(F.max("__m").alias("__hi"), F.min("__m").alias("__lo"))
    order = Window.orderBy("__d")
    days = days.select(F.col("__d").alias("__k"), F.last("__hi", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("__pl"), F.last("__lo", True).over(Window.orderBy(F.desc("__d")).rowsBetween(Window.unboundedPreceding, -1)).alias("__pr"))
    near = both.where("__m is null").join(days, F.col("__d") == F.col("__k"))
    left, right = F.coalesce("__l", "__pl"), F.coalesce("__r", "__pr")
    pick = F.when(left.isNull(), right).when(right.isNull(), left).when(F.col("__sec") - left["__sec"] <= right["__sec"] - F.col("__sec"), left).otherwise(right)
    near = near.withColumn("__p", pick).where("__p is not null")
    if tolerance is not None:
        near = near.where(F.abs(F.col("__p.__sec") - F.col("__sec")) <= tolerance * 60)
    return asked.join(near.select("__sec", F.col("__p.__main").alias("__main")), "__sec").select("__main", "__side")


def _last_values(df: DataFrame, time: str, side: DataFrame, side_time: str, columns: dict[str, str], how: str, tolerance: float | None, pos: str, side_pos: str, day: int) -> DataFrame:
    """__main and the numbers of the last row of side that goes there."""
    met = _met(df, time, side, side_time, how, tolerance, pos, side_pos, day).groupBy("__main").agg(F.max("__side").alias("__side"))
    values = side.select(col(side_pos).alias("__s"), *[number(col(c)).alias(name) for c, name in columns.items()])
    return met.join(values, F.col("__side") == F.col("__s")).drop("__s", "__side")


def align(df: DataFrame, time: str, side: DataFrame, side_time: str, column: str, name: str, *, how: str = "exact", tolerance: float | None = None, pos: str = "pos", side_pos: str = "pos", day: int = 86_400) -> DataFrame:
    """df with `name`: each row of side goes to a row of df, the first one of the equal (exact) or nearest second (the earlier of two);
    of several rows of side that meet in one row the last stays. tolerance in minutes, inclusive."""
    last = _last_values(df, time, side, side_time, {column: name}, how, tolerance, pos, side_pos, day)
    return df.join(last, col(pos) == F.col("__main"), "left").drop("__main")


def align_table(df: DataFrame, time: str, side: DataFrame, side_time: str, columns: dict[str, str] | None = None, *, how: str = "exact", tolerance: float | None = None, pos: str = "pos", side_pos: str = "pos") -> tuple[DataFrame, dict]:
    """df with the numeric columns of a side table (name by name, or all under names of their own), and what became of it: columns that held no number
    on the rows that met (`nonNumeric`, left out), cells that were no number (`coerced`), counts of rows and the share of df that has values.
    Refused: an unknown time column, no column, too many columns, times that can't be read, no meeting at all, no number at all."""
    if side_time not in side.columns:
        raise AlignmentError(f"the side table has no column {side_time}")
    wanted = columns if columns is not None else {c: c for c in side.columns if c not in (side_time, side_pos)}
    if not wanted or any(c not in side.columns or c == side_time for c in wanted):
        raise AlignmentError("no columns besides the time, or unknown ones")
    if len(wanted) > MAX_SIDE_COLUMNS:
        raise AlignmentError(f"more than {MAX_SIDE_COLUMNS} columns")
    if len(set(wanted.values())) < len(wanted) or set(wanted.values()) & set(df.columns):
        raise AlignmentError("names that are taken or occur twice")
    side_rows = side.count()
    main_rows, readable = df.agg(F.count(F.lit(1)), F.count(col(time))).first()
    if not readable:
        raise AlignmentError("no time of the main table can be read")
    last = _last_values(df, time, side, side_time, wanted, how, tolerance, pos, side_pos, 86_400)
    names = list(wanted.values())
    matched, *held = last.agg(F.count(F.lit(1)), *[F.count(col(n)) for n in names]).first()
    if not matched:
        raise AlignmentError(f"no row of the side table meets the main one ({how})")
    empty = [c for (c, _), n in zip(wanted.items(), held, strict=True) if not n]
    if len(empty) == len(wanted):
        raise AlignmentError(f"no column holds numbers: {', '.join(empty)}")
    kept = {c: n for c, n in wanted.items() if c not in empty}
    out = df.join(last.select("__main", *cols(kept.values())), col(pos) == F.col("__main"), "left").drop("__main")
    counts = dict(zip(wanted, held, strict=True))
    stats = {"sideRows": side_rows, "matchedSideRows": matched, "matchedMainRows": matched, "mainRows": main_rows, "unmatchedSideRows": side_rows - matched, "coverage": matched / main_rows * 100}
    return out, {"keys": list(kept.values()), "nonNumeric": empty, "coerced": {c: matched - counts[c] for c in kept}, "stats": stats}


def formula_column(df: DataFrame, time: str, name: str, text: str, pos: str = "pos") -> DataFrame:
    """df with a formula of the time's parts; ties at the fourth place go up, also below zero."""
    raw = df.withColumn("__raw", formula(text, time_parts(col(time), col(pos))))
    return raw.withColumn(name, floor_round(F.col("__raw"), 4)).drop("__raw")


def _stacked(frames: list[DataFrame], time: str, pos: str) -> DataFrame:
    if not 2 <= len(frames) <= 12:
        raise ValueError("from 2 to 12 tables")
    if any(time not in f.columns for f in frames):
        raise ValueError("every table needs the time column")
    empty = [i for i, f in enumerate(frames) if f.isEmpty()]
    if empty:
        raise ValueError(f"tables without rows: {empty}")
    out = None
    for i, f in enumerate(frames):
        one = f.withColumn("__file", F.lit(i))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out.withColumnRenamed(pos, "__old")


def merge(frames: list[DataFrame], time: str, pos: str = "pos") -> DataFrame:
    """All columns of all frames, sorted by time (missing last), then frame and position, with new positions."""
    return _by_time(_stacked(frames, time, pos), time, pos).drop("__file", "__old")


def _by_time(stacked: DataFrame, time: str, pos: str) -> DataFrame:
    # rows without a time come last, in parts of 65,536 positions of a file
    none = col(time).isNull()
    key = F.struct(F.coalesce(hours(col(time)), F.lit(1 << 62)), F.when(none, F.col("__file")), F.when(none, F.floor(F.col("__old") / 65536)))
    return numbered(stacked, [col(time).asc_nulls_last(), F.col("__file"), F.col("__old")], key, pos)


def merge_receipt(frames: list[DataFrame], time: str, pos: str = "pos") -> DataFrame:
    """One row: files, rows, columns, columns that not every table has and the cells that are empty for it, rows that sorting moves, steps back in time before and
    after it, rows whose time (missing counts as one) an earlier row has, times that are missing, first and last time."""
    every = [c for i, f in enumerate(frames) for c in f.columns if c != pos and not any(c in g.columns for g in frames[:i])]
    partial = [c for c in every if not all(c in f.columns for f in frames)]
    rows = [f.count() for f in frames]
    gaps = sum(n * sum(c not in f.columns for c in every) for n, f in zip(rows, frames, strict=True))
    stacked = _stacked([f.select(col(pos), col(time)) for f in frames], time, pos)
    # places before sorting: by file and position, in parts of 65,536 positions of a file
    laid = numbered(stacked, [F.col("__file"), F.col("__old")], F.struct("__file", F.floor(F.col("__old") / 65536)), "__at")
    placed = _by_time(laid, time, "__to")
    per = laid.groupBy(col(time).alias("__t")).agg(F.count(F.lit(1)).alias("n"))
    totals = per.agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("__t").isNull(), F.col("n"))), F.lit(0)).alias("empty_times"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_times"), F.min("__t").alias("start"), F.max("__t").alias("end"))
    moved = placed.agg(F.coalesce(F.sum((F.col("__at") != F.col("__to")).cast("long")), F.lit(0))).first()[0]
    back = backjumps(laid, time, "__at").first()[0]
    known = {"files": len(frames), "columns": len(every), "union_only": ",".join(partial), "gap_cells": gaps, "rows_moved": moved, "backjumps_before": back, "backjumps_after": 0}
    return totals.withColumns({k: F.lit(v).cast("string" if isinstance(v, str) else "long") for k, v in known.items()})


def backjumps(df: DataFrame, time: str, pos: str = "pos") -> DataFrame:
    """How often a row is earlier in time than the one before it."""
    halo = Halo(df.select(col(pos), col(time)).where(col(time).isNotNull()), 1, pos)
    back = halo.df.withColumn("__back", F.lag(col(time)).over(halo.window) > col(time))
    return halo.own(back).agg(F.coalesce(F.sum(F.col("__back").cast("long")), F.lit(0)).alias("backjumps"))
