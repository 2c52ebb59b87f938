"""The quality of a frame as it is: missing cells and stretches, rows of equal time, and what a chart of it can't show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import col, cols
from ..plans.order import BUCKET, with_neighbours_of
from .explore import MAX_POINTS, downsample_extremes
from .resample import interval_minutes
from .stats import overview

MAX_SEGMENTS, MAX_GROUPS, MAX_GROUP_ROWS = 300, 200, 100
MAX_MARKS, MAX_ANOMALY_POINTS = 80, 4000


def _numeric(df: DataFrame, time: str | None, pos: str) -> list[str]:
    return [c for c, k in df.dtypes if k in ("double", "float", "bigint", "int", "smallint", "tinyint") and c not in (time, pos)]


def _blank(df: DataFrame, column: str) -> Column:
    c = col(column)
    return (F.coalesce(c, F.lit("")) == "") if dict(df.dtypes)[column] == "string" else c.isNull()


def column_quality(df: DataFrame, time: str | None, pos: str = "pos") -> DataFrame:
    """One row per column: name, total, missing (empty texts count), valid, rate in percent of all rows, and whether it can be imputed."""
    names, numbers = [c for c in df.columns if c != pos], _numeric(df, time, pos)
    n, *missing = df.agg(F.count(F.lit(1)), *[F.count_if(_blank(df, c)) for c in names]).first()
    rows = [(c, n, m, n - m, m / n * 100 if n else 0.0, c in numbers) for c, m in zip(names, missing, strict=True)]
    return df.sparkSession.createDataFrame(rows, "name string, total long, missing long, valid long, rate double, imputable boolean")


def totals(df: DataFrame, time: str, pos: str = "pos") -> DataFrame:
    """One row: rows, columns, missing cells, their share of all cells in percent, rows whose time an earlier one has, times that several rows share (missing
    ones are one of them) and the share of such rows in percent."""
    names = [c for c in df.columns if c != pos]
    per = df.groupBy(col(time).alias("__t")).agg(F.count(F.lit(1)).alias("n"), sum((F.count_if(_blank(df, c)) for c in names), F.lit(0)).alias("m"))
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.lit(len(names)).cast("long").alias("columns"), F.coalesce(F.sum("m"), F.lit(0)).alias("missing_cells"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"), F.count_if(F.col("n") > 1).alias("duplicate_groups"))
    share = lambda part, whole: F.coalesce(F.try_divide(F.col(part), whole) * 100, F.lit(0.0))
    return out.withColumns({"missing_rate": share("missing_cells", F.col("rows") * F.col("columns")), "duplicate_rate": share("duplicate_rows", F.col("rows"))})


def frame_info(df: DataFrame, time: str, columns: list[str], pos: str = "pos") -> DataFrame:
    """One row: all columns but the position, cells of `columns`, the share of these that is missing and of rows whose time an earlier one has, in percent, and
    the sampling interval in minutes."""
    known = overview(df, time, columns)
    cells, share = F.col("rows") * len(columns), lambda part, whole: F.coalesce(F.try_divide(part, whole) * 100, F.lit(0.0))
    made = known.select(F.lit(len([c for c in df.columns if c != pos])).cast("long").alias("columns"), cells.cast("long").alias("cells"), share(F.col("missing_cells"), cells).alias("missing_rate"), share(F.col("duplicate_rows"), F.col("rows")).alias("duplicate_rate"))
    return made.withColumn("interval_minutes", F.lit(interval_minutes(df, time, pos)).cast("long"))


def missing_segments(df: DataFrame, time: str, columns: list[str] | None = None, pos: str = "pos") -> DataFrame:
    """name, start, end, length, start_time, end_time of each stretch of missing values of the numeric columns, the first MAX_SEGMENTS of each, and whether
    a column has more (truncated). All columns in one pass; only the few that are reported meet in a window."""
    columns = _numeric(df, time, pos) if columns is None else columns
    near = with_neighbours_of(df.select(col(pos).alias("pos"), col(time).alias("time"), *cols(columns)), columns, "pos")
    cells = F.array(*[F.struct(F.lit(c).alias("name"), col(c).isNull().alias("gap"), (F.coalesce(F.col(f"__prev{i}.pos"), F.lit(-1)) + 1).alias("start")) for i, c in enumerate(columns)])
    gaps = near.select("pos", "time", F.explode(F.filter(cells, lambda x: x["gap"])).alias("x")).select("pos", "time", "x.name", "x.start")
    runs = gaps.groupBy("name", "start").agg(F.max("pos").alias("end"), F.min(F.struct("pos", "time"))["time"].alias("start_time"), F.max(F.struct("pos", "time"))["time"].alias("end_time"))
    first = Window.partitionBy("name").orderBy("start")
    counts = runs.groupBy("name").agg((F.count(F.lit(1)) > MAX_SEGMENTS).alias("truncated"))
    shown = runs.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= MAX_SEGMENTS).drop("nth")
    return shown.join(counts, "name").select("name", F.col("start").cast("long").alias("start"), "end", (F.col("end") - F.col("start") + 1).alias("length"), "start_time", "end_time", "truncated")


def duplicate_detail(df: DataFrame, time: str, pos: str = "pos") -> DataFrame:
    """The MAX_GROUPS largest groups of rows of equal time (missing ones are one group), of equal size the first: time, size, first_pos, the positions of their first
    MAX_GROUP_ROWS rows and whether there are more. Positions are gathered for the groups that are shown only."""
    groups = df.groupBy(col(time).alias("time")).agg(F.count(F.lit(1)).alias("size"), F.min(col(pos)).alias("first_pos")).where("size > 1")
    shown = groups.orderBy(F.desc("size"), "first_pos").limit(MAX_GROUPS)
    # at most MAX_GROUPS rows, so this side is small
    rows = df.select(col(time).alias("t"), col(pos).alias("p")).join(F.broadcast(shown), F.col("t").eqNullSafe(F.col("time")))
    nth = F.row_number().over(Window.partitionBy("first_pos").orderBy("p"))
    listed = rows.withColumn("nth", nth).where(F.col("nth") <= MAX_GROUP_ROWS).groupBy("time", "size", "first_pos").agg(F.array_sort(F.collect_list("p")).alias("positions"))
    return listed.withColumn("truncated", F.col("size") > MAX_GROUP_ROWS)


def quality_series(df: DataFrame, columns: list[str], points: int = 0, flags: dict[str, str] | None = None, pos: str = "pos") -> DataFrame:
    """What a chart of several columns shows: column, pos, value, and whether a point is marked as missing or as an anomaly (flags: the boolean column of each).

    points 0: every row; else the positions that downsample_extremes keeps. Of the missing ones the first MAX_MARKS of a column are marked, of the anomalies
    the first of a budget that the columns share: counts inside a bucket of positions, and one row of counts per bucket that is carried over."""
    if not columns:
        raise ValueError("no columns")
    flags = flags or {}
    shown = df
    if points > 0:
        kept = downsample_extremes(df, columns, max(20, min(points, MAX_POINTS)), pos).withColumnRenamed(pos, "__kept")
        shown = df.join(F.broadcast(kept), col(pos) == F.col("__kept"))
    budget = max(200, MAX_ANOMALY_POINTS // len(columns))
    numbers = [col(c).cast("double").alias(f"value{i}") for i, c in enumerate(columns)]
    found = [(F.coalesce(col(flags[c]), F.lit(False)) if c in flags else F.lit(False)).alias(f"flag{i}") for i, c in enumerate(columns)]
    shown = shown.select(col(pos).alias("pos"), F.floor(col(pos) / BUCKET).alias("bucket"), *numbers, *found)
    marks = {f"{k}{i}": m for i in range(len(columns)) for k, m in (("gap", F.col(f"value{i}").isNull()), ("bad", F.col(f"flag{i}")))}
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = shown.groupBy("bucket").agg(*[F.count_if(m).alias(k) for k, m in marks.items()])
    carried = carried.select(F.col("bucket").alias("key"), *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_before") for k in marks])
    inside = Window.partitionBy("bucket").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    shown = shown.withColumns({k: F.count_if(m).over(inside) for k, m in marks.items()}).join(carried, F.col("bucket") == F.col("key"))
    first = lambda k, n: marks[k] & (F.col(k) + F.col(f"{k}_before") <= n)
    cells = [F.struct(F.lit(c).alias("name"), F.col(f"value{i}").alias("value"), first(f"gap{i}", MAX_MARKS).alias("missing_mark"), first(f"bad{i}", budget).alias("anomaly_mark")) for i, c in enumerate(columns)]
    return shown.select("pos", F.explode(F.array(*cells)).alias("x")).select("x.name", "pos", "x.value", "x.missing_mark", "x.anomaly_mark")


def quality_counts(df: DataFrame, columns: list[str], flags: dict[str, str] | None = None) -> DataFrame:
    """One row per column: all its missing values and anomalies, whatever a chart shows of them."""
    flags = flags or {}
    made = [f for c in columns for f in (F.count_if(col(c).isNull()), F.count_if(col(flags[c])) if c in flags else F.lit(0))]
    row = list(df.agg(*made).first())
    rows = [(c, row[2 * i], row[2 * i + 1]) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "name string, missing long, anomalies long")
