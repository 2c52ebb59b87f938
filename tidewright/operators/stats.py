"""Statistics: population deviation, quartiles at sorted[int(n * q)], histograms, overview, level counts."""

from __future__ import annotations

import math
from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import col
from ..plans.order import numbered


@dataclass(frozen=True)
class Stats:
    n: int
    missing: int
    mean: float | None = None
    std: float | None = None
    median: float | None = None
    q1: float | None = None
    q3: float | None = None
    min: float | None = None
    max: float | None = None


def order_statistics_of(df: DataFrame, wanted: dict[str, list[int]]) -> dict[str, list[float]]:
    """For each column the k-th smallest valid values, k from 0, of all columns in one pass. Equal values are counted first, then ranges of
    (column, value); the driver gets one count per column and range and the values looked for, and no task sorts a column."""
    names = [c for c, ks in wanted.items() if ks]
    if not names:
        return {c: [] for c in wanted}
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), col(c).cast("double").alias("v")) for i, c in enumerate(names)])).alias("x")
    counts = df.select(cells).select("x.*").where("v is not null").groupBy("i", "v").agg(F.count(F.lit(1)).alias("c"))
    ranges = counts.repartitionByRange("i", "v").withColumn("part", F.spark_partition_id()).persist()
    try:
        below: dict[int, int] = {}
        spans: dict[int, list[tuple[int, int, int]]] = {}
        for row in ranges.groupBy("i", "part").agg(F.sum("c").alias("c")).orderBy("i", "part").collect():
            start = below.get(row["i"], 0)
            spans.setdefault(row["i"], []).append((row["part"], start, start + row["c"]))
            below[row["i"]] = start + row["c"]
        home = {(i, k): next((p, lo) for p, lo, hi in spans[i] if lo <= k < hi) for i, c in enumerate(names) for k in wanted[c]}
        upto = F.sum("c").over(Window.partitionBy("i", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        few = ranges.where(F.struct("i", "part").isin([F.struct(F.lit(i), F.lit(p)) for i, p in {(i, p) for (i, _), (p, _) in home.items()}])).withColumn("upto", upto)
        at = [(i, k) for i, c in enumerate(names) for k in wanted[c]]
        found = few.agg(*[F.min(F.when((F.col("i") == i) & (F.col("part") == home[i, k][0]) & (F.col("upto") > k - home[i, k][1]), F.col("v"))) for i, k in at]).first()
        values = dict(zip(at, found, strict=True))
        return {c: [values[names.index(c), k] for k in ks] for c, ks in wanted.items()}
    finally:
        ranges.unpersist()


def order_statistics(df: DataFrame, column: str, ks: list[int]) -> list[float]:
    return order_statistics_of(df, {column: ks})[column]


def quantile(df: DataFrame, column: str, q: float) -> float | None:
    """The value at place (n - 1) q of the sorted valid ones, between two by a straight line."""
    n = df.agg(F.count(col(column))).first()[0]
    if not n:
        return None
    at = (n - 1) * q
    low, high = order_statistics(df, column, [math.floor(at), math.ceil(at)])
    return low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high


def stats_of(df: DataFrame, columns: list[str]) -> dict[str, Stats]:
    """The statistics of all columns: one aggregation, and one pass for all order statistics."""
    made = [f for c in columns for v in [col(c)] for f in (F.count(v), F.count(F.lit(1)) - F.count(v), F.avg(v), F.stddev_pop(v), F.min(v), F.max(v))]
    row = list(df.agg(*made).first()) if columns else []
    plain = {c: row[6 * i : 6 * i + 6] for i, c in enumerate(columns)}
    found = order_statistics_of(df, {c: [int(n * 0.25), int(n * 0.75), (n - 1) // 2, n // 2] if n else [] for c, (n, *_) in plain.items()})
    out = {}
    for c, (n, missing, mean, std, low, high) in plain.items():
        q1, q3, a, b = found[c] or (None,) * 4
        out[c] = Stats(n, missing, mean, std, (a + b) / 2, q1, q3, low, high) if n else Stats(0, missing)
    return out


def column_stats(df: DataFrame, column: str) -> Stats:
    return stats_of(df, [column])[column]


def stats_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: its statistics and the share of missing values in percent of all rows."""
    rows = [(c, *astuple(x), x.missing / (x.n + x.missing) * 100 if x.n + x.missing else 0.0) for c, x in stats_of(df, columns).items()]
    return df.sparkSession.createDataFrame(rows, "name string, n long, missing long, mean double, std double, median double, q1 double, q3 double, min double, max double, missing_rate double")


def matrix_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: global_max, the largest value of all columns, 1 at least."""
    return df.agg(F.greatest(F.lit(1.0), *[F.max(col(c)).cast("double") for c in columns]).alias("global_max"))


def histogram_marks(df: DataFrame, column: str, bins: int = 25) -> DataFrame:
    """One row: n, missing, min, max, mean, median, bin_width and the bins that hold mean and median."""
    if not 2 <= bins <= 200:
        raise ValueError("bins must be from 2 to 200")
    x = column_stats(df, column)
    span = (x.max - x.min) or 1.0 if x.n else None
    at = lambda v: None if span is None else min(bins - 1, max(0, math.floor((v - x.min) / span * bins)))
    width = None if span is None else (x.max - x.min) / bins or 1.0
    return df.sparkSession.createDataFrame([(x.n, x.missing, x.min, x.max, x.mean, x.median, width, at(x.mean), at(x.median))], "n long, missing long, min double, max double, mean double, median double, bin_width double, mean_bin int, median_bin int")


def histogram(df: DataFrame, column: str, bins: int = 25) -> DataFrame:
    """bin, edge (its lower one) and count for every bin; the highest value is in the last bin."""
    if not 2 <= bins <= 200:
        raise ValueError("bins must be from 2 to 200")
    v = col(column)
    low, high = df.agg(F.min(v), F.max(v)).first()
    width = 1.0 if low is None or high == low else (high - low) / bins
    counts = df.where(v.isNotNull()).groupBy(F.least(F.floor((v - F.lit(low)) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    axis = df.sparkSession.range(bins if low is not None else 0).select(F.col("id").cast("int").alias("bin"))
    return axis.join(counts, "bin", "left").select("bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("edge"), F.coalesce("count", F.lit(0)).alias("count"))


def value_counts(df: DataFrame, column: str, pos: str = "pos") -> DataFrame:
    """level, count, first_pos and code, its number by first appearance; blank levels don't count."""
    c = col(column)
    out = df.where(c.isNotNull() & (F.trim(c) != "")).groupBy(c.alias("level")).agg(F.count(F.lit(1)).alias("count"), F.min(col(pos)).alias("first_pos"))
    return numbered(out, [F.col("first_pos")], F.floor(F.col("first_pos") / 65536), "code").withColumn("code", F.col("code").cast("int"))


def level_totals(df: DataFrame, column: str, shown: int = 200, pos: str = "pos") -> DataFrame:
    """One row: how many levels there are, and how many rows have a level that is not among the first `shown`."""
    return value_counts(df, column, pos).agg(F.count(F.lit(1)).alias("unique_total"), F.coalesce(F.sum(F.when(F.col("code") >= shown, F.col("count"))), F.lit(0)).alias("rest_count"))


def overview(df: DataFrame, time: str, columns: list[str]) -> DataFrame:
    """One row: rows, missing cells, rows with a time that another has, times that are missing, first and last time."""
    times = df.groupBy(col(time).alias("__t")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(col(c).isNull().cast("long")).alias(f"m{i}") for i, c in enumerate(columns)])
    missing = sum((F.coalesce(F.sum(f"m{i}"), F.lit(0)) for i in range(len(columns))), F.lit(0))
    return times.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), missing.alias("missing_cells"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"), F.coalesce(F.sum(F.when(F.col("__t").isNull(), F.col("n"))), F.lit(0)).alias("time_missing"), F.min("__t").alias("first_time"), F.max("__t").alias("last_time"))


def first_complete(df: DataFrame, columns: list[str], scan_rows: int, pos: str = "pos") -> DataFrame:
    """Smallest position within the first rows at which all columns hold something, and the number of such rows."""
    full = col(pos) < scan_rows
    for c in columns:
        full = full & col(c).isNotNull() & ((F.trim(col(c)) != "") if dict(df.dtypes)[c] == "string" else F.lit(True))
    return df.where(full).agg(F.min(col(pos)).alias("first_pos"), F.count(F.lit(1)).alias("complete_rows"))
