"""Row positions and the windows over them, shaped so that no task holds the whole frame.

A frame has a dense position from 0. Windows of bounded reach run inside buckets of positions, each with a halo of the rows before
it; unbounded scans run inside buckets and are carried over by sums of one row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.names import col

POS = "pos"
BUCKET = 65_536


def numbered(df: DataFrame, order: list[Column], bucket: Column | None = None, pos: str = POS) -> DataFrame:
    """df with a new dense position by `order`. bucket: a monotone, coarser key of the order's first column; counts per bucket give
    each bucket's first position, so only one row per bucket passes through an unpartitioned window."""
    if bucket is None:
        return df.withColumn(pos, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    df = df.withColumn("__k", bucket)
    counts = df.groupBy("__k").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(F.col("__k").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("__k").alias("__key"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    out = df.join(counts, F.col("__k").eqNullSafe(F.col("__key")))
    rank = F.row_number().over(Window.partitionBy("__k").orderBy(*order)) - 1
    return out.withColumn(pos, (F.col("__before") + rank).cast("long")).drop("__k", "__key", "__before")


def hours(ts: Column) -> Column:
    """The hour since 1970 of a timestamp without time zone: a coarser key for numbered()."""
    return F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts) / 3_600_000_000)


class Halo:
    """Positions dealt to buckets with the `reach` rows before each; `window` orders a bucket, `own` drops the halo afterwards."""

    def __init__(self, df: DataFrame, reach: int, pos: str = POS, size: int = BUCKET):
        size = max(size, reach)
        at = F.floor(col(pos) / size)
        both = F.when(col(pos) % size >= size - reach, F.array(at, at + 1)).otherwise(F.array(at))
        self.df = df.withColumn("__b", F.explode(both)).withColumn("__own", at == F.col("__b"))
        self.window: WindowSpec = Window.partitionBy("__b").orderBy(col(pos))

    def before(self, n: int) -> WindowSpec:
        return self.window.rowsBetween(-n, -1)

    def last(self, n: int) -> WindowSpec:
        return self.window.rowsBetween(1 - n, 0)

    @staticmethod
    def own(df: DataFrame) -> DataFrame:
        return df.where("__own").drop("__b", "__own")


def with_neighbours_of(df: DataFrame, columns: list[str], pos: str = POS, size: int = BUCKET) -> DataFrame:
    """df with __prev0, __next0, __prev1 and so on: for each column the nearest valid (pos, value) before and after each row, itself included; NULL
    beyond the ends. All columns share one window in each direction and one table of what is carried between buckets."""
    df = df.withColumn("__b", F.floor(col(pos) / size))
    here = [F.when(col(c).isNotNull(), F.struct(col(pos).alias("pos"), col(c).alias("value"))) for c in columns]
    ends = df.groupBy("__b").agg(*[f(h).alias(f"__{name}{i}") for i, h in enumerate(here) for f, name in ((F.max, "last"), (F.min, "first"))])
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.last(f"__{name}{i}", True).over(w).alias(f"__{to}{i}") for i in range(len(columns)) for name, w, to in (("last", before, "before"), ("first", after, "after"))]
    ends = ends.select(F.col("__b").alias("__k"), *carried)
    inside = Window.partitionBy("__b").orderBy(col(pos)).rowsBetween(Window.unboundedPreceding, 0)
    # what follows is looked up backwards: a frame that is open at its end would be gone through anew for every row
    back = Window.partitionBy("__b").orderBy(col(pos).desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({f"__{name}{i}": F.last(h, True).over(w) for i, h in enumerate(here) for name, w in (("prev", inside), ("next", back))})
    out = out.join(ends, F.col("__b") == F.col("__k"))
    out = out.withColumns({f"__{name}{i}": F.coalesce(f"__{name}{i}", f"__{beyond}{i}") for i in range(len(columns)) for name, beyond in (("prev", "before"), ("next", "after"))})
    return out.drop("__b", "__k", *[f"__{x}{i}" for i in range(len(columns)) for x in ("before", "after")])


def with_neighbours(df: DataFrame, column: str, pos: str = POS, size: int = BUCKET) -> DataFrame:
    """with_neighbours_of() for one column: __prev and __next."""
    return with_neighbours_of(df, [column], pos, size).withColumnsRenamed({"__prev0": "__prev", "__next0": "__next"})


def with_running(df: DataFrame, column: str, pos: str = POS, size: int = BUCKET) -> DataFrame:
    """df with __sum and __count of the valid values before each row."""
    df = df.withColumn("__b", F.floor(col(pos) / size))
    sums = df.groupBy("__b").agg(F.sum(col(column)).alias("__s"), F.count(col(column)).alias("__n"))
    carry = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("__b").alias("__k"), F.coalesce(F.sum("__s").over(carry), F.lit(0.0)).alias("__s0"), F.coalesce(F.sum("__n").over(carry), F.lit(0)).alias("__n0"))
    inside = Window.partitionBy("__b").orderBy(col(pos)).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumns({"__sum": F.coalesce(F.sum(col(column)).over(inside), F.lit(0.0)), "__count": F.coalesce(F.count(col(column)).over(inside), F.lit(0))})
    out = out.join(sums, F.col("__b") == F.col("__k"))
    return out.withColumns({"__sum": F.col("__s0") + F.col("__sum"), "__count": F.col("__n0") + F.col("__count")}).drop("__b", "__k", "__s0", "__n0")
