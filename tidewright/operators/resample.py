"""Resampling to a dense axis of buckets with explicit rules for gaps."""

from __future__ import annotations

from bisect import bisect
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import col, cols
from ..functions.numeric import half_up
from ..plans.order import Halo, with_neighbours_of
from .stats import quantile

METHODS = ("mean", "sum", "first", "interpolate")
#: Different steps of time that are gathered on the driver.
MAX_STEPS = 10_000
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def minute_bucket(ts: Column, minutes: int) -> Column:
    """Number of the bucket since 1970."""
    return F.floor(F.timestamp_diff("MICROSECOND", F.expr(EPOCH), ts) / (60_000_000 * minutes))


def bucket_start(bucket: Column, minutes: int) -> Column:
    return F.timestamp_add("MINUTE", bucket * minutes, F.expr(EPOCH))


def interval_minutes(df: DataFrame, time: str, pos: str = "pos") -> int:
    """Median of the positive steps of time in row order, in minutes: 1 at least, ties to even."""
    halo = Halo(df.select(col(pos), col(time)).where(col(time).isNotNull()), 1, pos)
    step = F.timestamp_diff("MICROSECOND", F.lag(col(time)).over(halo.window), col(time)) / 1e6
    steps = halo.own(halo.df.withColumn("__step", step)).where("__step > 0").select("__step")
    # a series has few different steps as a rule; of more than the driver takes the median is found by ranges
    counts = sorted(steps.groupBy("__step").agg(F.count(F.lit(1)).alias("n")).limit(MAX_STEPS + 1).collect())
    if len(counts) > MAX_STEPS:
        middle = quantile(steps, "__step", 0.5)
    else:
        n = sum(r["n"] for r in counts)
        upto = list(accumulate(r["n"] for r in counts))
        middle = sum(counts[bisect(upto, k)]["__step"] for k in ((n - 1) // 2, n // 2)) / 2 if n else None
    return max(1, round(middle / 60)) if middle else 1


def aggregate(df: DataFrame, time: str, columns: list[str], minutes: int, method: str, up: bool, pos: str = "pos") -> DataFrame:
    """Bucket number and value of each column for the buckets that hold rows."""
    if method not in METHODS or not 1 <= minutes <= 1440:
        raise ValueError("unknown method or width")
    first = lambda c: F.min_by(col(c), F.when(col(c).isNotNull(), F.struct(col(time), col(pos))))
    kinds = dict(df.dtypes)

    def value(c: str) -> Column:
        if kinds[c] in ("string",) or method == "first" or (method == "interpolate" and up):
            return first(c)
        return F.sum(col(c)) if method == "sum" else F.avg(col(c))

    return df.where(col(time).isNotNull()).groupBy(minute_bucket(col(time), minutes).alias("bucket")).agg(*[value(c).alias(c) for c in columns])


def preview(df: DataFrame, time: str, minutes: int) -> DataFrame:
    """One row of counts, without the rows: source_rows, unparsed, bucket_count, filled_buckets, empty_buckets."""
    per = df.groupBy(minute_bucket(col(time), minutes).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    held = F.count("bucket")
    return per.agg(F.sum("n").alias("source_rows"), F.coalesce(F.sum(F.when(F.col("bucket").isNull(), F.col("n"))), F.lit(0)).alias("unparsed"), (F.max("bucket") - F.min("bucket") + 1).alias("bucket_count"), held.alias("filled_buckets"), (F.max("bucket") - F.min("bucket") + 1 - held).alias("empty_buckets"))


def resample(df: DataFrame, time: str, columns: list[str], minutes: int, method: str = "mean", *, source_minutes: int | None = None, pos: str = "pos") -> DataFrame:
    """pos, time and columns on a dense axis from the first bucket to the last. With finer buckets than the source gaps are filled, by
    straight lines (interpolate) or the value before, else after; otherwise only interpolate fills them."""
    source = interval_minutes(df, time, pos) if source_minutes is None else source_minutes
    up = minutes < source
    held = aggregate(df, time, columns, minutes, method, up, pos)
    low, high = held.agg(F.min("bucket"), F.max("bucket")).first()
    axis = df.sparkSession.range(low, high + 1).withColumnRenamed("id", "__at") if low is not None else df.sparkSession.range(0).withColumnRenamed("id", "__at")
    out = axis.join(held, F.col("__at") == F.col("bucket"), "left").withColumn(pos, F.col("__at") - F.lit(low or 0))
    kinds = dict(df.dtypes)
    gaps = [c for c in columns if up or (method == "interpolate" and kinds[c] != "string")]
    if gaps:
        out, made = with_neighbours_of(out, gaps, pos), {}
        for i, c in enumerate(gaps):
            a, b = F.col(f"__prev{i}"), F.col(f"__next{i}")
            line = [a["value"] + (b["value"] - a["value"]) * ((col(pos) - a["pos"]) / F.greatest(b["pos"] - a["pos"], F.lit(1)))] if method == "interpolate" and kinds[c] != "string" else []
            made[c] = F.coalesce(col(c), *line, a["value"], b["value"])
        out = out.withColumns(made)
    # many columns written out in place would be more code than a generated method may hold
    numbers = {c: half_up(c if len(columns) <= 8 else col(c), 2) for c in columns if kinds[c] != "string"}
    return out.withColumns({time: bucket_start(F.col("__at"), minutes), **numbers}).select(col(pos), col(time), *cols(columns))
