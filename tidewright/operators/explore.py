"""Pages, calendar windows and down-sampling for display."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import col, cols
from ..functions.numeric import half_up

SPANS = ("year", "month", "week", "day")
MAX_CELLS, MAX_POINTS, MAX_HULLS = 600_000, 6000, 8


def page(df: DataFrame, offset: int, limit: int, pos: str = "pos") -> DataFrame:
    if not 1 <= limit <= 500:
        raise ValueError("a page has 1 to 500 rows")
    return df.where(col(pos).between(offset, offset + limit - 1)).orderBy(col(pos))


def periods(df: DataFrame, time: str, span: str) -> DataFrame:
    """The natural periods (weeks from Monday) that hold rows: start and number of rows."""
    if span not in SPANS:
        raise ValueError(f"unknown span: {span}")
    start = F.date_trunc(span, col(time)).cast("timestamp_ntz")
    return df.where(col(time).isNotNull()).groupBy(start.alias("start")).agg(F.count(F.lit(1)).alias("rows"))


def period_window(df: DataFrame, time: str, span: str, offset: int = 0) -> DataFrame:
    """The rows of the offset-th period; an offset outside is moved to the nearest period."""
    found = periods(df, time, span).orderBy("start").select("start")
    n = found.count()
    at = min(max(offset, 0), max(n - 1, 0))
    row = found.offset(at).limit(1).collect()
    if not row:
        return df.limit(0)
    return df.where(F.date_trunc(span, col(time)).cast("timestamp_ntz") == F.lit(row[0]["start"]).cast("timestamp_ntz"))


def period_info(df: DataFrame, time: str, span: str, offset: int = 0) -> DataFrame:
    """One row: start and end of the offset-th period, its rows and all rows, how many periods there are, its number from 1, the offset that was
    taken and whether it was moved. span may be "all"."""
    total = df.count()
    if span == "all":
        return df.sparkSession.createDataFrame([(None, None, total, total, 1, 1, 0, False)], _PERIOD)
    found = periods(df, time, span)
    n = found.count()
    if not n:
        raise ValueError("no time can be read")
    at = min(max(offset, 0), n - 1)
    row = found.orderBy("start").offset(at).limit(1)
    end = F.date_trunc(span, F.timestamp_add("HOUR", F.lit({"year": 24 * 370, "month": 24 * 32, "week": 24 * 7, "day": 24}[span]), F.col("start"))).cast("timestamp_ntz")
    return row.select(F.col("start").alias("from"), end.alias("to"), F.col("rows").alias("window_rows"), F.lit(total).cast("long").alias("total_rows"), F.lit(n).cast("long").alias("period_total"), F.lit(at + 1).cast("long").alias("period_index"), F.lit(at).cast("long").alias("offset"), F.lit(at != offset).alias("clamped"))


_PERIOD = "`from` timestamp_ntz, `to` timestamp_ntz, window_rows long, total_rows long, period_total long, period_index long, offset long, clamped boolean"


def column_values(df: DataFrame, column: str, max_rows: int | None = None, pos: str = "pos") -> DataFrame:
    """A column in row order, of the first max_rows rows if given."""
    kept = df if max_rows is None else df.where(col(pos) < max_rows)
    return kept.select(col(pos), col(column)).orderBy(col(pos))


def raw_series(df: DataFrame, columns: list[str], pos: str = "pos") -> DataFrame:
    if df.count() * len(columns) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells")
    return df.select(col(pos), *cols(columns)).orderBy(col(pos))


def downsample_mean(df: DataFrame, column: str, every: int = 4, pos: str = "pos") -> DataFrame:
    """The mean of each four rows (all rows as they are if there are 500 or fewer), to 2 places."""
    if df.count() <= 500:
        return df.select(col(pos).alias("pos"), col(column).alias(column))
    out = df.groupBy(F.floor(col(pos) / every).alias("g")).agg(F.avg(col(column)).alias("__m"))
    return out.select((F.col("g") * every).alias("pos"), half_up("__m", 2).alias(column))


def downsample_extremes(df: DataFrame, columns: list[str], cap: int, pos: str = "pos") -> DataFrame:
    """Positions of the first smallest and largest value and the first and last missing one of each column in cap // 4 buckets; thinned evenly beyond cap, the last kept."""
    n = df.count()
    if n <= cap:
        return df.select(col(pos))
    buckets = max(1, cap // 4)
    bucket = F.floor(((col(pos) + 1) * buckets - 1) / n)
    picks = []
    for c in columns:
        low, high, gap = F.struct(col(c), col(pos)), F.struct(col(c), -col(pos)), F.when(col(c).isNull(), col(pos))
        valid = col(c).isNotNull()
        picks += [F.min(F.when(valid, low))[pos], -F.max(F.when(valid, high))["col2"], F.min(gap), F.max(gap)]
    found = df.groupBy(bucket.alias("b")).agg(F.array(*picks).alias("p")).select(F.explode("p").alias(pos)).where(col(pos).isNotNull()).distinct()
    # at most 4 positions per column and bucket from here on
    at = [r[0] for r in found.orderBy(col(pos)).collect()]
    if len(at) > cap:
        step = -(-len(at) // cap)
        at = sorted({*at[::step], at[-1]})
    return df.sparkSession.createDataFrame([(x,) for x in at], f"{pos} long")


def _corners(b, p, v, signs):
    """Which points, sorted by p, may win: those on the upper or lower hull of (p, sum of signed values) in their bucket for some choice of signs."""
    import numpy as np

    keep = np.zeros(len(p), bool)
    for sign in signs:
        w = v @ sign
        for way in (w, -w):
            at = np.arange(len(p))
            # points on or below the chord of their neighbours go; what is left over after the last round does no harm
            for _ in range(64):
                if len(at) < 3:
                    break
                i, j, k = at[:-2], at[1:-1], at[2:]
                below = (way[j] - way[i]) * (p[k] - p[i]) <= (way[k] - way[i]) * (p[j] - p[i])
                gone = below & (b[i] == b[j]) & (b[j] == b[k])
                if not gone.any():
                    break
                at = np.concatenate((at[:1], j[~gone], at[-1:]))
            keep[at] = True
    return keep


def _reducer(span: list[float], held: int = 65_536):
    """A function for mapInArrow that passes on the corners of each bucket; it holds those found so far and some batches."""
    import numpy as np
    import pyarrow as pa

    signs = [np.array((1.0, *s)) / span for s in itertools.product((1.0, -1.0), repeat=len(span) - 1)]

    def reduced(batches):
        table = pa.Table.from_batches(batches).sort_by("p")
        # rows of a bucket are neighbours, as buckets follow positions
        x = [table[c].to_numpy() for c in table.column_names]
        return table.filter(pa.array(_corners(x[0], x[1], np.column_stack(x[2:]), signs))).combine_chunks().to_batches()

    def run(batches):
        kept, new, rows = [], [], 0
        for batch in batches:
            new.append(batch)
            rows += batch.num_rows
            if rows > max(held, sum(x.num_rows for x in kept)):
                kept, new, rows = reduced(kept + new), [], 0
        if kept or rows:
            yield from reduced(kept + new)

    return run


def lttb(df: DataFrame, columns: list[str], cap: int, pos: str = "pos") -> DataFrame:
    """Positions that largest-triangle-three-buckets keeps, areas added up over columns in units of their ranges; missing values count as the
    column's mean. Of several rows of the same area the first is kept.

    Each pick depends on the last, but for any choice of signs the area is linear in (p, sum of signed values), so only corners of these
    points' hulls can win. Tasks reduce buckets to them, first where the rows are, then by bucket, and the driver goes through some dozens of rows a
    bucket. Beyond MAX_HULLS columns there would be too many choices of signs, and all rows pass through the driver in order, bucket by bucket.
    """
    import numpy as np

    n = df.count()
    if n <= cap or cap < 3:
        return df.select(col(pos))
    stats = df.agg(*[f(col(c)) for c in columns for f in (F.avg, F.min, F.max)]).first()
    mean, span = [x if x is not None else 0.0 for x in stats[::3]], [float(b - a) if a is not None and b > a else 1.0 for a, b in zip(stats[1::3], stats[2::3], strict=True)]
    every, names = (n - 2) / (cap - 2), [f"v{i}" for i in range(len(columns))]
    bucket = F.when(F.col("p") == 0, -1).when(F.col("p") == n - 1, cap - 2).otherwise(F.floor((F.col("p") - 1) / F.lit(every))).cast("int")
    rows = df.select(col(pos).cast("double").alias("p"), *[F.coalesce(col(c).cast("double"), F.lit(float(m))).alias(v) for v, c, m in zip(names, columns, mean, strict=True)]).select(bucket.alias("b"), "p", *names)
    centres = {r["b"]: np.array(list(r)[1:]) for r in rows.groupBy("b").agg(F.avg("p"), *[F.avg(v) for v in names]).collect()}
    if len(columns) <= MAX_HULLS:
        reduce = _reducer(span)
        rows = rows.mapInArrow(reduce, rows.schema).repartition("b").mapInArrow(reduce, rows.schema)
    picked, last = [], None
    for b, group in itertools.groupby(rows.orderBy("p").toLocalIterator(), key=lambda r: r["b"]):
        x = np.array([list(r)[1:] for r in group])
        if last is None or b == cap - 2:
            choice = 0
        else:
            c = centres[b + 1]
            area = sum(abs((last[0] - c[0]) * (x[:, i] - last[i]) - (last[0] - x[:, 0]) * (c[i] - last[i])) / span[i - 1] for i in range(1, x.shape[1]))
            choice = int(np.argmax(area))
        last = x[choice]
        picked.append((int(last[0]),))
    return df.sparkSession.createDataFrame(picked, f"{pos} long")
