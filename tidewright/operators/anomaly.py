"""Anomaly detection and repair. A detection is the frame with a boolean column and two bounds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import predicate
from ..functions.names import col
from ..functions.numeric import half_up
from ..plans.order import Halo
from .clean import impute
from .stats import column_stats, quantile

TRAIL, LEAST, WIDTH = 33, 5, 4.0


def _outside(df: DataFrame, column: str, low: float | None, high: float | None) -> DataFrame:
    flag = F.coalesce((col(column) < F.lit(low)) | (col(column) > F.lit(high)), F.lit(False))
    return df.withColumns({"anomaly": flag, "lower": F.lit(low).cast("double"), "upper": F.lit(high).cast("double")})


def detect(df: DataFrame, column: str, method: str, *, expression: str = "", contamination: float = 0.01, seed: int = 42, pos: str = "pos") -> DataFrame:
    """df with anomaly, lower and upper by 3sigma, iqr, mad, expr or iforest."""
    if method == "mad":
        return _mad(df, column, pos)
    if method == "iforest":
        return isolation(df, column, contamination, seed, pos=pos)
    stats = column_stats(df, column)
    if method == "3sigma":
        low, high = (None, None) if not stats.n else (stats.mean - 3 * stats.std, stats.mean + 3 * stats.std)
        return _outside(df, column, low, high)
    if method == "iqr":
        low, high = (None, None) if not stats.n else (stats.q1 - 1.5 * (stats.q3 - stats.q1), stats.q3 + 1.5 * (stats.q3 - stats.q1))
        return _outside(df, column, low, high)
    if method == "expr":
        known = {k: F.lit(getattr(stats, k)).cast("double") for k in ("mean", "std", "median", "q1", "q3", "min", "max")}
        out = df.withColumn("anomaly", predicate(expression, {"v": col(column), **known}))
        low, high = out.where(~F.col("anomaly")).agg(F.min(col(column)), F.max(col(column))).first()
        return out.withColumns({"lower": F.lit(low).cast("double"), "upper": F.lit(high).cast("double")})
    raise ValueError(f"unknown method: {method}")


def _mad(df: DataFrame, column: str, pos: str) -> DataFrame:
    """Beyond 4 mean absolute deviations from the median of the last 33 rows, of which 5 must be valid; the bounds are the widest of any row judged."""
    halo = Halo(df, TRAIL - 1, pos)
    out = halo.df.withColumn("__near", F.collect_list(col(column)).over(halo.last(TRAIL)))
    # deviations are added up in row order: in another one the sum may differ in its last bit, which decides where a value lies on a bound
    out = halo.own(out).withColumn("__sorted", F.array_sort("__near"))
    n = F.size("__near")
    middle = (F.get("__sorted", F.floor((n - 1) / 2).cast("int")) + F.get("__sorted", F.floor(n / 2).cast("int"))) / 2
    judged = col(column).isNotNull() & (n >= LEAST)
    out = out.withColumn("__m", F.when(judged, middle))
    out = out.withColumn("__d", F.when(judged, F.aggregate("__near", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("__m"))) / n))
    out = out.withColumns({"__lo": F.col("__m") - WIDTH * F.col("__d"), "__hi": F.col("__m") + WIDTH * F.col("__d")}).drop("__near", "__sorted")
    low, high = out.agg(F.min("__lo"), F.max("__hi")).first()
    flag = F.coalesce((col(column) < F.col("__lo")) | (col(column) > F.col("__hi")), F.lit(False))
    return out.withColumns({"anomaly": flag, "lower": F.lit(low).cast("double"), "upper": F.lit(high).cast("double")}).drop("__m", "__d", "__lo", "__hi")


def isolation(df: DataFrame, column: str, contamination: float, seed: int, trees: int = 200, sample: int = 256, pos: str = "pos") -> DataFrame:
    """A one-dimensional isolation forest: trees are grown on the driver from a bounded sample of rows, drawn by their positions so that copies of a value are drawn independently, every row is scored by nested comparisons in Arrow batches."""
    import numpy as np

    rng = np.random.default_rng(seed)
    drawn = [r[0] for r in df.where(col(column).isNotNull()).select(col(column), F.xxhash64(col(pos), F.lit(seed)).alias("h"), col(pos).alias("p")).orderBy("h", "p").limit(trees * sample // 8).select(col(column)).collect()]
    if len(drawn) < 3:
        return _outside(df, column, None, None)
    values = np.array(drawn)

    def grow(x, depth: int):
        if len(x) <= 1 or depth >= 8 or x.min() == x.max():
            return [(depth + _path(len(x)), None)]
        cut = rng.uniform(x.min(), x.max())
        return grow(x[x < cut], depth + 1) + [(None, cut)] + grow(x[x >= cut], depth + 1)

    forest = []
    for _ in range(trees):
        tree = grow(rng.choice(values, min(sample, len(values)), replace=False), 0)
        forest.append((np.array([c for _, c in tree if c is not None]), np.array([d for d, _ in tree if d is not None])))

    @F.pandas_udf("double")
    def depth(v: pd.Series) -> pd.Series:
        x = v.to_numpy(float)
        total = sum(leaf[np.searchsorted(cuts, x, side="right")] for cuts, leaf in forest)
        return pd.Series(np.where(np.isnan(x), np.nan, 2.0 ** (-(total / len(forest)) / _path(min(sample, len(values))))))

    out = df.withColumn("__score", F.when(col(column).isNotNull(), depth(col(column))))
    limit = quantile(out, "__score", 1 - contamination)
    out = out.withColumn("anomaly", F.coalesce(F.col("__score") > F.lit(limit), F.lit(False)))
    low, high = (quantile(out.where(~F.col("anomaly")), column, q) for q in (0.005, 0.995))
    return out.withColumns({"lower": half_up(F.lit(low).cast("double"), 4), "upper": half_up(F.lit(high).cast("double"), 4)}).drop("__score")


def _path(n: int) -> float:
    import math

    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def summary(detected: DataFrame, column: str) -> DataFrame:
    """One row: rows, anomalies, the rest, the rate in percent and the bounds."""
    n, found = F.count(F.lit(1)), F.count_if("anomaly")
    return detected.agg(F.lit(column).alias("name"), n.alias("total"), found.alias("count"), (n - found).alias("normal"), F.coalesce(F.try_divide(found, n) * 100, F.lit(0.0)).alias("rate"), F.max("lower").alias("lower"), F.max("upper").alias("upper"))


def summary_totals(df: DataFrame, flags: list[str]) -> DataFrame:
    """One row over the flag columns of several detections: anomalies, their share of all cells in percent, columns with any, cells."""
    found = df.agg(F.count(F.lit(1)).alias("__n"), *[F.coalesce(F.sum(col(f).cast("long")), F.lit(0)).alias(f"__{i}") for i, f in enumerate(flags)])
    counts = [F.col(f"__{i}") for i in range(len(flags))]
    total, cells = sum(counts, F.lit(0)), F.col("__n") * len(flags)
    return found.select(total.cast("long").alias("total_anomalies"), F.coalesce(F.try_divide(total, cells) * 100, F.lit(0.0)).alias("overall_rate"), sum(((c > 0).cast("int") for c in counts), F.lit(0)).cast("long").alias("cols_affected"), cells.cast("long").alias("total_cells"))


def repair(detected: DataFrame, column: str, how: str, pos: str = "pos") -> DataFrame:
    """clip to the bounds, nan_impute (missing, then linear) or mask_only (a 0/1 column if there is any anomaly)."""
    flag, v = F.col("anomaly"), col(column)
    if how == "clip":
        # below the lower bound goes to it, everything else that is flagged to the upper
        out = detected.withColumn(column, F.when(flag & (v < F.col("lower")), half_up("lower", 4)).when(flag, half_up("upper", 4)).otherwise(v))
    elif how == "nan_impute":
        out = impute(detected.withColumn(column, F.when(~flag, v)), column, "linear", pos=pos)
    elif how == "mask_only":
        out = detected.withColumn(f"anomaly_mask_{column}", flag.cast("bigint")) if not detected.where(flag).isEmpty() else detected
    else:
        raise ValueError(f"unknown repair: {how}")
    return out.drop("anomaly", "lower", "upper")
