"""Registered queries of the time-series engine over the driver's tables, and the same in DuckDB SQL.

The main series is `events` with pos = event_id; v is value with two rows of every 17 missing, spiked has 9999 at every 501st row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.numeric import half_up, half_up_sql
from .operators import align, anomaly, clean, explore, features, quality, resample, stats, timeparse
from .plans.order import numbered
from .sources import presets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SIZE = 65_536


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    v = F.when(~(F.col("event_id") % 17).isin(3, 4), F.col("value"))
    return e.select(F.col("event_id").alias("pos"), F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", v.alias("v"), F.when(F.col("event_id") % 501 == 0, 9999.0).otherwise(v).alias("spiked"))


EV = """ev AS (
  SELECT event_id AS pos, ts, user_id, event_type, value, CASE WHEN event_id % 17 IN (3, 4) THEN NULL ELSE value END AS v,
         CASE WHEN event_id % 501 = 0 THEN 9999.0 WHEN event_id % 17 IN (3, 4) THEN NULL ELSE value END AS spiked
  FROM events)"""
NEAR = """near AS (
  SELECT *, last_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS pp, last_value({c} IGNORE NULLS) OVER b AS pv,
         first_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS np, first_value({c} IGNORE NULLS) OVER a AS nv
  FROM {t} WINDOW b AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def near(column: str, of: str = "ev") -> str:
    return NEAR.format(c=column, t=of)


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def up(x: str, digits: int) -> str:
    return half_up_sql(x, digits)


# --- statistics -----------------------------------------------------------------------------------------------------------------

@query("overview", f"""WITH {EV}, per AS (SELECT date_trunc('hour', ts) AS h, count(*) AS n, sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS m FROM ev GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(m) AS BIGINT) AS missing_cells, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, CAST(0 AS BIGINT) AS time_missing, min(h) AS first_time, max(h) AS last_time FROM per""")
def _overview(spark, d):
    return stats.overview(events(spark, d).withColumn("h", F.date_trunc("hour", "ts").cast("timestamp_ntz")), "h", ["v"])


def _stats_sql(column: str, table: str) -> str:
    return f"""SELECT '{column}' AS name, n, missing, {up('mean', 6)} AS mean, {up('std', 6)} AS std, (s[(n - 1) // 2 + 1] + s[n // 2 + 1]) / 2 AS median,
 s[CAST(floor(n * 0.25) AS BIGINT) + 1] AS q1, s[CAST(floor(n * 0.75) AS BIGINT) + 1] AS q3, s[1] AS min, s[n] AS max, {up('rate', 6)} AS missing_rate
FROM (SELECT count({column}) AS n, count(*) - count({column}) AS missing, avg({column}) AS mean, stddev_pop({column}) AS std, list_sort(list({column}) FILTER ({column} IS NOT NULL)) AS s, (count(*) - count({column}))::DOUBLE / count(*) * 100 AS rate FROM {table})"""


@query("stats_matrix", f"WITH {EV} {_stats_sql('v', 'ev')} UNION ALL {_stats_sql('spiked', 'ev')}")
def _matrix(spark, d):
    return _rounded(stats.stats_matrix(events(spark, d), ["v", "spiked"]), 6, "mean", "std", "missing_rate")


@query("frame_info", f"""WITH {EV}, h AS (SELECT *, date_trunc('hour', ts) AS hour FROM ev), d AS (SELECT date_diff('microsecond', lag(hour) OVER (ORDER BY pos), hour) / 1e6 AS step FROM h)
SELECT CAST(7 AS BIGINT) AS columns, 2 * count(*) AS cells, sum(CAST(v IS NULL AS BIGINT) + CAST(value IS NULL AS BIGINT)) / (2.0 * count(*)) * 100 AS missing_rate, (count(*) - count(DISTINCT hour)) / CAST(count(*) AS DOUBLE) * 100 AS duplicate_rate,
 (SELECT CAST(greatest(1, round_even(median(step) / 60, 0)) AS BIGINT) FROM d WHERE step > 0) AS interval_minutes FROM h""")
def _frame_info(spark, d):
    return quality.frame_info(events(spark, d).withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz")), "hour", ["v", "value"])


@query("matrix_scale", f"WITH {EV} SELECT greatest(1.0, max(v), max(spiked))::DOUBLE AS global_max FROM ev")
def _scale(spark, d):
    return stats.matrix_scale(events(spark, d), ["v", "spiked"])


@query("stats_lineitem", " UNION ALL ".join(_stats_sql(c, "lineitem") for c in ("l_quantity", "l_extendedprice")))
def _lineitem(spark, d):
    return _rounded(stats.stats_matrix(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_quantity", "l_extendedprice"]), 6, "mean", "std", "missing_rate")


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: half_up(F.col(c), digits) for c in columns})


@query("histogram_25", f"""WITH {EV}, s AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / 25 AS w FROM ev),
 c AS (SELECT least(CAST(floor((v - lo) / w) AS INTEGER), 24) AS bin, count(*) AS count FROM ev, s WHERE v IS NOT NULL GROUP BY 1)
SELECT CAST(b AS INTEGER) AS bin, {up('e', 6)} AS edge, coalesce(count, 0) AS count FROM (SELECT b, lo + b * w AS e FROM s, range(25) r(b)) LEFT JOIN c ON bin = b""")
def _histogram(spark, d):
    return _rounded(stats.histogram(events(spark, d), "v"), 6, "edge")


@query("value_counts", f"WITH {EV} SELECT event_type AS level, count(*) AS count, min(pos) AS first_pos, CAST(row_number() OVER (ORDER BY min(pos)) - 1 AS INTEGER) AS code FROM ev WHERE trim(event_type) <> '' GROUP BY 1")
def _levels(spark, d):
    return stats.value_counts(events(spark, d), "event_type")


@query("first_complete", f"WITH {EV} SELECT min(pos) AS first_pos, count(*) AS complete_rows FROM ev WHERE pos >= 3 AND pos < 1000 AND v IS NOT NULL AND trim(event_type) <> ''")
def _complete(spark, d):
    return stats.first_complete(events(spark, d).where("pos >= 3"), ["v", "event_type"], 1000)


@query("freq_detect", f"WITH {EV}, s AS (SELECT (epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY pos))) / 1e6 AS d FROM ev) SELECT CAST(greatest(1, round_even(median(d) / 60, 0)) AS BIGINT) AS minutes FROM s WHERE d > 0")
def _frequency(spark, d):
    return spark.createDataFrame([(resample.interval_minutes(events(spark, d), "ts"),)], "minutes long")


@query("missing_runs", f"WITH {EV}, m AS (SELECT pos, pos - row_number() OVER (ORDER BY pos) AS g FROM ev WHERE v IS NULL) SELECT min(pos) AS start, max(pos) AS \"end\", max(pos) - min(pos) + 1 AS length FROM m GROUP BY g")
def _runs(spark, d):
    return clean.missing_runs(events(spark, d), "v")


@query("quality_missing", f"WITH {EV} SELECT * FROM (SELECT 'v' AS name, count(*) - count(v) AS missing FROM ev UNION ALL SELECT 'event_type', sum(CASE WHEN coalesce(event_type, '') = '' THEN 1 ELSE 0 END)::BIGINT FROM ev UNION ALL SELECT 'ts', count(*) - count(ts) FROM ev)")
def _quality(spark, d):
    e = events(spark, d).agg(F.sum(F.col("v").isNull().cast("long")).alias("v"), F.sum((F.coalesce("event_type", F.lit("")) == "").cast("long")).alias("event_type"), F.sum(F.col("ts").isNull().cast("long")).alias("ts"))
    return e.selectExpr("stack(3, 'v', v, 'event_type', event_type, 'ts', ts) as (name, missing)")


@query("duplicate_groups", "SELECT o_orderdate AS ts, count(*) AS size, min(o_orderkey) AS first_pos FROM orders GROUP BY 1 HAVING count(*) > 1")
def _duplicates(spark, d):
    return clean.duplicate_groups(_orders(spark, d).withColumn("pos", F.col("o_orderkey")), "ts")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders by key, with dates as times."""
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), "o_totalprice", "o_orderpriority")


@query("level_totals", f"WITH {EV}, l AS (SELECT count(*) AS n, row_number() OVER (ORDER BY min(pos)) - 1 AS code FROM ev WHERE trim(event_type) <> '' GROUP BY event_type) SELECT count(*) AS unique_total, CAST(coalesce(sum(CASE WHEN code >= 3 THEN n END), 0) AS BIGINT) AS rest_count FROM l")
def _level_totals(spark, d):
    return stats.level_totals(events(spark, d), "event_type", 3)


@query("histogram_marks", f"""WITH {EV}, s AS (SELECT count(v) AS n, count(*) - count(v) AS missing, min(v) AS min, max(v) AS max, avg(v) AS mean, median(v) AS median, (max(v) - min(v)) / 25 AS w FROM ev)
SELECT n, missing, min, max, {up('mean', 6)} AS mean, median, {up('w', 6)} AS bin_width, CAST(floor((mean - min) / (max - min) * 25) AS INTEGER) AS mean_bin, CAST(floor((median - min) / (max - min) * 25) AS INTEGER) AS median_bin FROM s""")
def _marks(spark, d):
    return _rounded(stats.histogram_marks(events(spark, d), "v"), 6, "mean", "bin_width")


_CELLS = f"{EV}, q AS (SELECT pos, CASE WHEN pos % 50 <> 7 THEN date_trunc('hour', ts) END AS t, v, spiked, CASE WHEN pos % 9 = 0 THEN '' ELSE event_type END AS event_type FROM ev)"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """Hours as times, some of them missing, and levels, some of them empty."""
    at, level = F.when(F.col("pos") % 50 != 7, F.date_trunc("hour", "ts").cast("timestamp_ntz")), F.when(F.col("pos") % 9 == 0, "").otherwise(F.col("event_type"))
    return events(spark, d).select("pos", at.alias("t"), "v", "spiked", level.alias("event_type"))


@query("quality_columns", f"WITH {_CELLS}, m AS (SELECT count(*) AS n, count(*) - count(t) AS t, count(*) - count(v) AS v, count(*) - count(spiked) AS spiked, sum(CASE WHEN event_type = '' THEN 1 ELSE 0 END)::BIGINT AS e FROM q), x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, n AS total, {k} AS missing, {i} AS imputable FROM m" for c, k, i in (("t", "t", "false"), ("v", "v", "true"), ("spiked", "spiked", "true"), ("event_type", "e", "false"))) + ") SELECT name, total, missing, total - missing AS valid, missing::DOUBLE / total * 100 AS rate, imputable FROM x")
def _column_quality(spark, d):
    return quality.column_quality(_cells(spark, d), "t")


@query("quality_totals", f"""WITH {_CELLS}, g AS (SELECT t, count(*) AS n FROM q GROUP BY t), x AS (SELECT (SELECT count(*) FROM q) AS rows, CAST(4 AS BIGINT) AS columns,
 (SELECT CAST(sum(CASE WHEN t IS NULL THEN 1 ELSE 0 END + CASE WHEN v IS NULL THEN 1 ELSE 0 END + CASE WHEN spiked IS NULL THEN 1 ELSE 0 END + CASE WHEN event_type = '' THEN 1 ELSE 0 END) AS BIGINT) FROM q) AS missing_cells,
 (SELECT CAST(sum(n - 1) AS BIGINT) FROM g) AS duplicate_rows, (SELECT count(*) FROM g WHERE n > 1) AS duplicate_groups) SELECT *, missing_cells::DOUBLE / (rows * columns) * 100 AS missing_rate, duplicate_rows::DOUBLE / rows * 100 AS duplicate_rate FROM x""")
def _quality_totals(spark, d):
    return quality.totals(_cells(spark, d), "t")


_GAPS = " UNION ALL ".join(f"SELECT '{c}' AS name, pos, pos - row_number() OVER (ORDER BY pos) AS g, t FROM q WHERE {c} IS NULL" for c in ("v", "spiked"))


@query("missing_segments", f"""WITH {_CELLS}, g AS ({_GAPS}), r AS (SELECT name, min(pos) AS start, max(pos) AS "end", arg_min(t, pos) FILTER (true) AS a, max(pos) AS z FROM g GROUP BY name, g), n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY start) AS nth, count(*) OVER (PARTITION BY name) > 300 AS truncated FROM r)
SELECT n.name, n.start, n."end", n."end" - n.start + 1 AS length, b.t AS start_time, e.t AS end_time, truncated FROM n JOIN q b ON b.pos = n.start JOIN q e ON e.pos = n."end" WHERE nth <= 300""")
def _segments(spark, d):
    return quality.missing_segments(_cells(spark, d), "t")


@query("duplicate_detail", f"""WITH {_CELLS}, g AS (SELECT t AS time, count(*) AS size, min(pos) AS first_pos, list(pos ORDER BY pos) AS l FROM q GROUP BY t HAVING count(*) > 1 ORDER BY size DESC, first_pos LIMIT 200)
SELECT time, size, first_pos, array_to_string(l[1:100], ',') AS positions, size > 100 AS truncated FROM g""")
def _duplicate_detail(spark, d):
    return quality.duplicate_detail(_cells(spark, d), "t").withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


_MARKED = "count(*) FILTER ({f}) OVER (PARTITION BY name ORDER BY pos ROWS UNBOUNDED PRECEDING) <= {n}"


@query("quality_series", f"""WITH {EV}, x AS (SELECT 'v' AS name, pos, v AS value, false AS flag FROM ev UNION ALL SELECT 'spiked', pos, spiked, coalesce(spiked > 300, false) FROM ev)
SELECT name, pos, value, value IS NULL AND {_MARKED.format(f='value IS NULL', n=80)} AS missing_mark, flag AND {_MARKED.format(f='flag', n=2000)} AS anomaly_mark FROM x""")
def _series(spark, d):
    df = events(spark, d).withColumn("bad", F.coalesce(F.col("spiked") > 300, F.lit(False)))
    return quality.quality_series(df, ["v", "spiked"], flags={"spiked": "bad"})


# --- cleaning -------------------------------------------------------------------------------------------------------------------

_FILL = {
    "zero": "0.0", "ffill": "coalesce(pv, 0.0)",
    "linear": up("raw", 4), "spline": up("raw", 4),
}
_RAW = {
    "zero": "0.0", "ffill": "0.0",
    "linear": "coalesce(pv, 0.0) + (coalesce(nv, pv, 0.0) - coalesce(pv, 0.0)) * ((pos - coalesce(pp, -1))::DOUBLE / (coalesce(np, n) - coalesce(pp, -1)))",
    "spline": "coalesce(pv, 0.0) + (coalesce(nv, pv, 0.0) - coalesce(pv, 0.0)) * (-2.0::DOUBLE * t * t * t + 3.0::DOUBLE * t * t)",
}
for _name in clean.ALGORITHMS:

    @query(f"impute_{_name}", f"""WITH {EV}, {near('v')}, x AS (SELECT *, (pos - coalesce(pp, -1))::DOUBLE / (coalesce(np, n) - coalesce(pp, -1)) AS t FROM near, (SELECT count(*) AS n FROM ev)),
 y AS (SELECT *, {_RAW[_name]} AS raw FROM x) SELECT pos, coalesce(v, {_FILL[_name]}) AS v FROM y""")
    def _impute(spark, d, name=_name):
        return clean.impute(events(spark, d), "v", name).select("pos", "v")


@query("impute_interval", f"""WITH {EV}, e AS (SELECT (SELECT max_by(v, pos) FROM ev WHERE pos < 20 AND v IS NOT NULL) AS b, (SELECT max(pos) FROM ev WHERE pos < 20 AND v IS NOT NULL) AS bp, (SELECT min_by(v, pos) FROM ev WHERE pos > 21 AND v IS NOT NULL) AS a, (SELECT min(pos) FROM ev WHERE pos > 21 AND v IS NOT NULL) AS ap),
 y AS (SELECT pos, v, b + (a - b) * ((pos - bp)::DOUBLE / (ap - bp)) AS raw FROM ev, e) SELECT pos, CASE WHEN pos BETWEEN 20 AND 21 THEN coalesce(v, {up('raw', 4)}) ELSE v END AS v FROM y""")
def _interval(spark, d):
    return clean.impute(events(spark, d), "v", "linear", 20, 21).select("pos", "v")


_HOURLY = f"{EV}, h AS (SELECT pos, date_trunc('hour', ts) AS ts, v, event_type FROM ev)"


def _hourly(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("pos", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "v", "event_type")


for _name in ("mean", "first", "last"):
    _end = "max" if _name == "last" else "min"
    _value = f"CASE WHEN n > 1 THEN coalesce({up('m', 4)}, w) ELSE w END" if _name == "mean" else "w"

    @query(f"dedupe_{_name}", f"""WITH {_HOURLY}, g AS (SELECT ts, count(*) AS n, avg(v) AS m, {_end}(pos) AS p FROM h GROUP BY ts), k AS (SELECT g.*, h.v AS w, h.event_type FROM g JOIN h ON h.pos = g.p)
SELECT row_number() OVER (ORDER BY p) - 1 AS pos, ts, {_value} AS v, event_type FROM k""")
    def _dedupe(spark, d, name=_name):
        return clean.deduplicate(_hourly(spark, d), "ts", name, ["v"])


@query("mask_generate", f"WITH {EV} SELECT pos, CAST(pos BETWEEN 100 AND 199 AS BIGINT) AS mask FROM ev")
def _mask(spark, d):
    return clean.mask(events(spark, d), "mask", 100, 199).select("pos", "mask")


@query("split", f"WITH {EV}, c AS (SELECT count(*) * 70 // 100 AS t, count(*) AS n FROM ev) SELECT pos, CASE WHEN pos < t THEN 'train' WHEN pos < t + (n - t) - (n - t) // 2 THEN 'val' ELSE 'test' END AS split FROM ev, c")
def _split(spark, d):
    return clean.split(events(spark, d), 70).select("pos", "split")


@query("convert_unit", f"WITH {EV}, x AS (SELECT pos, v * 1.8::DOUBLE + 32.0::DOUBLE AS r FROM ev) SELECT pos, CASE WHEN r IS NOT NULL THEN {up('r', 4)} END AS v FROM x")
def _unit(spark, d):
    return clean.convert_unit(events(spark, d), "v", 1.8, 32.0).select("pos", "v")


@query("derived_chain", f"WITH {EV}, x AS (SELECT pos, CASE WHEN user_id - 7 <> 0 THEN ((v + value) * v) / (user_id - 7) END AS r FROM ev) SELECT pos, CASE WHEN r IS NOT NULL THEN {up('r', 4)} END AS made FROM x")
def _derived(spark, d):
    return clean.derive(events(spark, d).withColumn("u", F.col("user_id") - 7), "made", ["v", "value", "v", "u"], ["+", "*", "/"]).select("pos", "made")


_WIDE = 40


def _wide(spark: SparkSession, d: str) -> DataFrame:
    """Forty columns with gaps of their own."""
    made = [F.when(F.col("pos") % (11 + i) >= 2, F.col("value") + i).alias(f"w{i}") for i in range(_WIDE)]
    return events(spark, d).select("pos", "ts", *made)


_WIDE_SQL = "wide AS (SELECT event_id AS pos, ts, " + ", ".join(f"CASE WHEN event_id % {11 + i} >= 2 THEN value + {i} END AS w{i}" for i in range(_WIDE)) + " FROM events)"


def _wide_near(of: str) -> str:
    """The valid neighbours of all columns: the positions pp, np and values pv, nv."""
    made = [f"{f}({x} IGNORE NULLS) OVER {w} AS {n}{i}" for i in range(_WIDE) for f, w, n, x in (("last_value", "b", "pp", f"CASE WHEN w{i} IS NOT NULL THEN pos END"), ("last_value", "b", "pv", f"w{i}"), ("first_value", "a", "np", f"CASE WHEN w{i} IS NOT NULL THEN pos END"), ("first_value", "a", "nv", f"w{i}"))]
    return f"SELECT *, {', '.join(made)} FROM {of} WINDOW b AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def _own(sql: str, i: int) -> str:
    for name in ("pp", "pv", "np", "nv"):
        sql = re.sub(rf"\b{name}\b", f"{name}{i}", sql)
    return sql


@query("impute_wide", f"WITH {_WIDE_SQL}, near AS ({_wide_near('wide')}), y AS (SELECT *, " + ", ".join(f"{_own(_RAW['linear'], i)} AS raw{i}" for i in range(_WIDE)) + " FROM near, (SELECT count(*) AS n FROM wide)) SELECT pos, " + ", ".join(f"coalesce(w{i}, {up(f'raw{i}', 4)}) AS w{i}" for i in range(_WIDE)) + " FROM y")
def _impute_wide(spark, d):
    return clean.impute_all(_wide(spark, d), {f"w{i}": "linear" for i in range(_WIDE)}).drop("ts")


_LINE = "CASE WHEN w{i} IS NOT NULL THEN w{i} WHEN pp{i} IS NULL THEN nv{i} WHEN np{i} IS NULL THEN pv{i} ELSE pv{i} + (nv{i} - pv{i}) * ((pos - pp{i})::DOUBLE / (np{i} - pp{i})) END"


@query("resample_wide", f"""WITH {_WIDE_SQL}, g AS (SELECT CAST(epoch(date_trunc('second', ts)) AS BIGINT) // 900 AS b, {', '.join(f'avg(w{i}) AS w{i}' for i in range(_WIDE))} FROM wide GROUP BY 1),
 axis AS (SELECT b.b AS b, b.b - lo AS pos FROM (SELECT min(b) AS lo, max(b) AS hi FROM g), LATERAL (SELECT unnest(range(lo, hi + 1)) AS b) b), d AS (SELECT axis.pos, axis.b, g.* EXCLUDE (b) FROM axis LEFT JOIN g USING (b)), near AS ({_wide_near('d')}),
 x AS (SELECT pos, b, {', '.join(f"{_LINE.format(i=i)} AS r{i}" for i in range(_WIDE))} FROM near)
SELECT pos, timestamp '1970-01-01' + to_minutes(b * 15) AS ts, {', '.join(f"CASE WHEN r{i} IS NOT NULL THEN {up(f'r{i}', 2)} END AS w{i}" for i in range(_WIDE))} FROM x""")
def _resample_wide(spark, d):
    return resample.resample(_wide(spark, d), "ts", [f"w{i}" for i in range(_WIDE)], 15, "interpolate", source_minutes=1)


# --- resampling -----------------------------------------------------------------------------------------------------------------

def _resample_sql(method: str, minutes: int, up_: bool) -> str:
    first = "arg_min(v, pos) FILTER (v IS NOT NULL)"
    agg = {"mean": "avg(v)", "sum": "sum(v)", "first": first, "interpolate": first if up_ else "avg(v)"}[method]
    line = "CASE WHEN v IS NOT NULL THEN v WHEN pp IS NULL THEN nv WHEN np IS NULL THEN pv ELSE pv + (nv - pv) * ((pos - pp)::DOUBLE / (np - pp)) END"
    value = line if method == "interpolate" else "coalesce(v, pv, nv)" if up_ else "v"
    return f"""WITH {EV}, g AS (SELECT CAST(epoch(ts) AS BIGINT) // {minutes * 60} AS b, {agg} AS v FROM (SELECT pos, date_trunc('second', ts) AS ts, v FROM ev) GROUP BY 1),
 axis AS (SELECT b.b AS b, b.b - lo AS pos FROM (SELECT min(b) AS lo, max(b) AS hi FROM g), LATERAL (SELECT unnest(range(lo, hi + 1)) AS b) b), d AS (SELECT axis.pos, axis.b, g.v FROM axis LEFT JOIN g USING (b)),
 {near('v', 'd')}, x AS (SELECT pos, b, {value} AS r FROM near)
SELECT pos, timestamp '1970-01-01' + to_minutes(b * {minutes}) AS ts, CASE WHEN r IS NOT NULL THEN {up('r', 2)} END AS v FROM x"""


for _name in resample.METHODS:
    for _way, _minutes in (("down", 30), ("up", 1)):

        @query(f"resample_{_name}_{_way}", _resample_sql(_name, _minutes, _way == "up"))
        def _resample(spark, d, name=_name, minutes=_minutes):
            return resample.resample(events(spark, d), "ts", ["v"], minutes, name, source_minutes=4 if minutes == 1 else 1)


@query("resample_lineitem_day", f"WITH g AS (SELECT l_shipdate AS ts, sum(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT date_diff('day', (SELECT min(ts) FROM g), t) AS pos, t::TIMESTAMP AS ts, CASE WHEN q IS NOT NULL THEN {up('q', 2)} END AS l_quantity FROM (SELECT unnest(generate_series((SELECT min(ts)::TIMESTAMP FROM g), (SELECT max(ts)::TIMESTAMP FROM g), interval 1 day)) AS t) LEFT JOIN g ON g.ts = t")
def _ship(spark, d):
    df = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), "l_quantity", F.lit(0).cast("long").alias("pos"))
    return resample.resample(df, "ts", ["l_quantity"], 1440, "sum", source_minutes=1440)


@query("resample_preview", f"WITH {EV}, g AS (SELECT CAST(floor(epoch(ts) / 900) AS BIGINT) AS b, count(*) AS n FROM ev GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS source_rows, CAST(0 AS BIGINT) AS unparsed, max(b) - min(b) + 1 AS bucket_count, count(*) AS filled_buckets, max(b) - min(b) + 1 - count(*) AS empty_buckets FROM g")
def _preview(spark, d):
    return resample.preview(events(spark, d), "ts", 15)


# --- anomalies ------------------------------------------------------------------------------------------------------------------

_S = "s AS (SELECT avg(spiked) AS mean, stddev_pop(spiked) AS std, count(spiked) AS n, list_sort(list(spiked) FILTER (spiked IS NOT NULL)) AS l FROM ev)"
_BOUNDS = {"3sigma": "mean - 3 * std AS lo, mean + 3 * std AS hi", "iqr": "q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi"}
_Q = "q AS (SELECT *, l[CAST(floor(n * 0.25) AS BIGINT) + 1] AS q1, l[CAST(floor(n * 0.75) AS BIGINT) + 1] AS q3 FROM s)"
_MAD = """w AS (SELECT pos, spiked, list(spiked) FILTER (spiked IS NOT NULL) OVER (ORDER BY pos ROWS BETWEEN 32 PRECEDING AND CURRENT ROW) AS l FROM ev),
 m AS (SELECT pos, spiked, l, len(l) AS n, CASE WHEN spiked IS NOT NULL AND len(l) >= 5 THEN list_median(l) END AS med FROM w),
 a AS (SELECT pos, spiked, med, CASE WHEN med IS NOT NULL THEN list_sum(list_transform(l, lambda x: abs(x - med))) / n END AS dev FROM m),"""
for _name in ("3sigma", "iqr"):

    @query(f"detect_{_name}", f"WITH {EV}, {_S}, {_Q}, b AS (SELECT {_BOUNDS[_name]} FROM q) SELECT pos, coalesce(spiked < lo OR spiked > hi, false) AS anomaly FROM ev, b")
    def _detect(spark, d, name=_name):
        return anomaly.detect(events(spark, d), "spiked", name).select("pos", "anomaly")


@query("detect_mad", f"WITH {EV}, {_MAD.rstrip(',')} SELECT pos, coalesce(spiked < med - 4 * dev OR spiked > med + 4 * dev, false) AS anomaly FROM a")
def _mad(spark, d):
    return anomaly.detect(events(spark, d), "spiked", "mad").select("pos", "anomaly")


@query("detect_expr", f"WITH {EV}, {_S} SELECT pos, coalesce((abs(spiked - mean) > 2 * std AND spiked > 0) OR spiked < 1, false) AS anomaly FROM ev, s")
def _expr(spark, d):
    return anomaly.detect(events(spark, d), "spiked", "expr", expression="abs(v - mean) > 2 * std && v > 0 || v < 1").select("pos", "anomaly")


@query("detect_summary", f"WITH {EV}, {_S}, {_Q}, b AS (SELECT {_BOUNDS['iqr']} FROM q), c AS (SELECT count(*) AS total, CAST(sum(CAST(coalesce(spiked < lo OR spiked > hi, false) AS BIGINT)) AS BIGINT) AS count, max(lo) AS lo, max(hi) AS hi FROM ev, b) SELECT 'spiked' AS name, total, count, total - count AS normal, count::DOUBLE / total * 100 AS rate, {up('lo', 6)} AS lower, {up('hi', 6)} AS upper FROM c")
def _summary(spark, d):
    return _rounded(anomaly.summary(anomaly.detect(events(spark, d), "spiked", "iqr"), "spiked"), 6, "lower", "upper")


@query("detect_totals", f"WITH {EV}, f AS (SELECT coalesce(spiked > 300, false) AS a, coalesce(v < 1, false) AS b FROM ev), s AS (SELECT CAST(sum(a::INT) AS BIGINT) AS a, CAST(sum(b::INT) AS BIGINT) AS b, count(*) AS n FROM f) SELECT a + b AS total_anomalies, (a + b)::DOUBLE / (n * 2) * 100 AS overall_rate, CAST((a > 0)::INT + (b > 0)::INT AS BIGINT) AS cols_affected, n * 2 AS total_cells FROM s")
def _totals(spark, d):
    df = events(spark, d).select(F.coalesce(F.col("spiked") > 300, F.lit(False)).alias("a"), F.coalesce(F.col("v") < 1, F.lit(False)).alias("b"))
    return anomaly.summary_totals(df, ["a", "b"])


@query("detect_iforest")
def _forest(spark, d):
    return anomaly.detect(events(spark, d), "spiked", "iforest").select("pos", "anomaly")


_B = f"WITH {EV}, {_S}, {_Q}, b AS (SELECT {_BOUNDS['iqr']} FROM q), f AS (SELECT pos, spiked, lo, hi, coalesce(spiked < lo OR spiked > hi, false) AS bad FROM ev, b)"


@query("repair_clip", f"{_B} SELECT pos, CASE WHEN bad AND spiked < lo THEN {up('lo', 4)} WHEN bad THEN {up('hi', 4)} ELSE spiked END AS spiked FROM f")
def _clip(spark, d):
    return anomaly.repair(anomaly.detect(events(spark, d), "spiked", "iqr"), "spiked", "clip").select("pos", "spiked")


@query("repair_nan_impute", f"{_B}, c AS (SELECT pos, CASE WHEN bad THEN NULL ELSE spiked END AS v FROM f), {near('v', 'c')}, y AS (SELECT *, {_RAW['linear']} AS raw FROM near, (SELECT count(*) AS n FROM ev)) SELECT pos, coalesce(v, {up('raw', 4)}) AS spiked FROM y")
def _refill(spark, d):
    return anomaly.repair(anomaly.detect(events(spark, d), "spiked", "iqr"), "spiked", "nan_impute").select("pos", "spiked")


@query("repair_mask_only", f"{_B} SELECT pos, CAST(bad AS BIGINT) AS anomaly_mask_spiked FROM f")
def _masked(spark, d):
    return anomaly.repair(anomaly.detect(events(spark, d), "spiked", "iqr"), "spiked", "mask_only").select("pos", "anomaly_mask_spiked")


# --- features -------------------------------------------------------------------------------------------------------------------

@query("feat_calendar", f"WITH {EV} SELECT pos, hour(ts)::DOUBLE AS feat_hour, day(ts)::DOUBLE AS feat_day, month(ts)::DOUBLE AS feat_month, (isodow(ts) - 1)::DOUBLE AS feat_weekday, CASE WHEN isodow(ts) >= 6 THEN 1.0 ELSE 0.0 END::DOUBLE AS feat_is_weekend, CASE WHEN strftime(ts, '%Y-%m-%d') IN ('2024-01-01', '2024-01-15') THEN 1.0 ELSE 0.0 END::DOUBLE AS feat_holiday FROM ev")
def _calendar(spark, d):
    return features.calendar(events(spark, d).select("pos", "ts"), "ts", ["2024-01-01", "2024-01-15"]).drop("ts")


_TURNS = {"hour": "hour(ts) / 24.0::DOUBLE", "weekday": "(isodow(ts) - 1) / 7.0::DOUBLE", "month": "(month(ts) - 1) / 12.0::DOUBLE"}


@query("feat_cyclical", f"WITH {EV}, x AS (SELECT pos, " + ", ".join(f"{f}({2 * math.pi!r}::DOUBLE * ({t})) AS {k}_{f}" for k, t in _TURNS.items() for f in ("sin", "cos")) + " FROM ev) SELECT pos, " + ", ".join(f"{up(f'{k}_{f}', 3)} AS feat_{k}_{f}" for k in _TURNS for f in ("sin", "cos")) + " FROM x")
def _cyclical(spark, d):
    return features.cyclical(events(spark, d).select("pos", "ts"), "ts").drop("ts")


@query("feat_lag", f"WITH {EV} SELECT pos, lag(v, 1) OVER (ORDER BY pos) AS lag_v_t1, lag(v, 96) OVER (ORDER BY pos) AS lag_v_t96 FROM ev")
def _lag(spark, d):
    return features.lags(events(spark, d).select("pos", "v"), "v", [1, 96]).drop("v")


_W = "OVER (ORDER BY pos ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
_ROLL = {
    "mean": "avg(v) {o}", "max": "max(v) {o}", "min": "min(v) {o}", "median": "median(v) {o}",
    "std": "list(v) FILTER (v IS NOT NULL) {o}",
}
for _name, _sql in _ROLL.items():
    _short = "med" if _name == "median" else _name
    _r = (lambda x, k=_name: x if k in ("max", "min") else up(x, 2))
    _raw = ", ".join(f"{_sql.format(o=_W.format(w=w))} AS r{w}" for w in (5, 16))
    _mid = ("SELECT pos, " + ", ".join(f"CASE WHEN len(r{w}) > 0 THEN sqrt(list_sum(list_transform(r{w}, lambda q: (q - list_avg(r{w})) * (q - list_avg(r{w})))) / len(r{w})) END AS r{w}" for w in (5, 16)) + " FROM x") if _name == "std" else "SELECT * FROM x"

    @query(f"roll_{_name}", f"WITH {EV}, x AS (SELECT pos, {_raw} FROM ev), y AS ({_mid}) SELECT pos, " + ", ".join(f"CASE WHEN pos >= {w} AND r{w} IS NOT NULL THEN {_r(f'r{w}')} END AS roll_{_short}_v_w{w}" for w in (5, 16)) + " FROM y")
    def _roll(spark, d, name=_name):
        return features.rolling(events(spark, d).select("pos", "v"), "v", [5, 16], [name]).drop("v")


def _folded(step: str) -> str:
    """What a state that starts as NULL is before each row, folded over the rows one after the other; a is the list of states so far, b holds the row's value."""
    return f"""WITH {EV}, l AS (SELECT list_prepend([NULL::DOUBLE], list([v] ORDER BY pos)) AS l FROM ev), r AS (SELECT list_reduce(l, lambda a, b: list_append(a, {step})) AS r FROM l),
 s AS (SELECT unnest(r) AS state, generate_subscripts(r, 1) - 1 AS pos FROM r)"""


@query("expanding_mean", _folded("CASE WHEN b[1] IS NULL THEN a[-1] ELSE coalesce(a[-1], 0.0) + b[1] END") + f""", n AS (SELECT pos, count(v) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM ev), m AS (SELECT n.pos, CASE WHEN n > 0 THEN state / n END AS m FROM n JOIN s USING (pos))
SELECT pos, CASE WHEN m IS NOT NULL THEN {up('m', 2)} END AS expanding_mean_v FROM m""")
def _expanding(spark, d):
    return features.expanding_mean(events(spark, d).select("pos", "v"), "v").drop("v")


@query("ewm_prev", _folded(f"CASE WHEN b[1] IS NULL THEN a[-1] WHEN a[-1] IS NULL THEN b[1] ELSE a[-1] + {2 / 13!r}::DOUBLE * (b[1] - a[-1]) END") + f" SELECT s.pos, CASE WHEN state IS NOT NULL THEN {up('state', 2)} END AS ewm_v_s12 FROM s JOIN ev USING (pos)")
def _ewm(spark, d):
    return features.ewm(events(spark, d).select("pos", "v"), "v", 12).drop("v")


for _name, _sql in (("1", "v - lag(v, 1) OVER o"), ("2", "(v - lag(v, 1) OVER o) - (lag(v, 1) OVER o - lag(v, 2) OVER o)"), ("seasonal", "v - lag(v, 24) OVER o")):
    _column = "diff_season24_v" if _name == "seasonal" else f"diff{_name}_v"

    @query(f"diff_{_name}", f"WITH {EV}, x AS (SELECT pos, {_sql} AS r FROM ev WINDOW o AS (ORDER BY pos)) SELECT pos, CASE WHEN r IS NOT NULL THEN {up('r', 4)} END AS {_column} FROM x")
    def _diff(spark, d, column=_column):
        return features.differences(events(spark, d).select("pos", "v"), "v", [24]).select("pos", column)


@query("fft_energies", f"WITH {EV}, c AS (SELECT count(*) AS n FROM ev), k AS (SELECT k, n FROM c, LATERAL (SELECT unnest(range(1, CAST(least(50, n // 2) + 1 AS BIGINT))) AS k)), s AS (SELECT k, n, sum(coalesce(v, 0) * cos({2 * math.pi!r}::DOUBLE * ((pos * k) % n) / n)) AS a, sum(coalesce(v, 0) * sin({2 * math.pi!r}::DOUBLE * ((pos * k) % n) / n)) AS b FROM ev, k GROUP BY k, n), m AS (SELECT k, sqrt(a * a + b * b) / n AS m FROM s) SELECT CAST(k AS INTEGER) AS k, {up('m', 6)} AS magnitude FROM m")
def _energies(spark, d):
    return _rounded(features.spectrum(events(spark, d), "v"), 6, "magnitude")


@query("fft_topk", f"""WITH {EV}, c AS (SELECT count(*) AS n FROM ev), k AS (SELECT k, n FROM c, LATERAL (SELECT unnest(range(1, CAST(least(50, n // 2) + 1 AS BIGINT))) AS k)), s AS (SELECT k, n, sum(coalesce(v, 0) * cos({2 * math.pi!r}::DOUBLE * ((pos * k) % n) / n)) AS a, sum(coalesce(v, 0) * sin({2 * math.pi!r}::DOUBLE * ((pos * k) % n) / n)) AS b FROM ev, k GROUP BY k, n), m AS (SELECT k, sqrt(a * a + b * b) / n AS m FROM s), top AS (SELECT k, row_number() OVER (ORDER BY m DESC, k) AS i FROM m QUALIFY i <= 3),
 w AS (SELECT pos, list(coalesce(v, 0.0)) OVER (ORDER BY pos ROWS BETWEEN 64 PRECEDING AND CURRENT ROW) AS l FROM ev), x AS (SELECT pos, i, list_sum(list_transform(l, lambda x, j: x * cos({2 * math.pi!r}::DOUBLE * ((k * (j - 1)) % len(l)) / len(l)))) AS c, list_sum(list_transform(l, lambda x, j: x * sin({2 * math.pi!r}::DOUBLE * ((k * (j - 1)) % len(l)) / len(l)))) AS s, len(l) AS z FROM w, top), y AS (SELECT pos, i, sqrt(c * c + s * s) / z AS r FROM x)
SELECT pos, """ + ", ".join(f"max(CASE WHEN i = {i} THEN {up('r', 2)} END) AS fft_top{i}_v" for i in (1, 2, 3)) + " FROM y GROUP BY pos")
def _topk(spark, d):
    return features.dominant(events(spark, d).select("pos", "v"), "v").drop("v")


_SUMS = ", ".join(f"sum(coalesce(v, 0) * {f}({2 * math.pi * k / 64!r}::DOUBLE * (pos % 64))) OVER o AS {a}{k}" for k in range(1, 17) for a, f in (("c", "cos"), ("s", "sin")))
_AMPS = "[" + ", ".join(f"sqrt(c{k} * c{k} + s{k} * s{k}) / 64" for k in range(1, 17)) + "]"


@query("spectral_entropy", f"WITH {EV}, x AS (SELECT pos, {_SUMS} FROM ev WINDOW o AS (ORDER BY pos ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING)), a AS (SELECT pos, {_AMPS} AS a FROM x), h AS (SELECT pos, -list_sum(list_transform(list_filter(list_transform(a, lambda y: y / list_sum(a)), lambda p: p > 0), lambda p: p * log2(p))) AS h FROM a WHERE pos >= 64) SELECT pos, CASE WHEN h IS NOT NULL THEN {up('h', 4)} END AS spec_entropy_v FROM ev LEFT JOIN h USING (pos)")
def _entropy(spark, d):
    return features.spectral(events(spark, d).select("pos", "v"), "v").select("pos", "spec_entropy_v")


@query("power_ratio", f"WITH {EV}, x AS (SELECT pos, {_SUMS} FROM ev WINDOW o AS (ORDER BY pos ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING)), a AS (SELECT pos, {_AMPS} AS a FROM x), h AS (SELECT pos, list_sum(a[1:4]) / (list_sum(a[8:16]) + 1e-10) AS h FROM a WHERE pos >= 64) SELECT pos, CASE WHEN h IS NOT NULL THEN {up('h', 2)} END AS power_ratio_v FROM ev LEFT JOIN h USING (pos)")
def _power(spark, d):
    return features.spectral(events(spark, d).select("pos", "v"), "v").select("pos", "power_ratio_v")


_TYPES = ("click", "view", "purchase", "signup", "error")


@query("onehot", f"WITH {EV} SELECT pos, " + ", ".join(f"CAST(coalesce(event_type = '{t}', false) AS BIGINT) AS event_type_{t}" for t in _TYPES) + " FROM ev")
def _onehot(spark, d):
    return features.one_hot(events(spark, d).select("pos", "event_type"), "event_type").drop("event_type")


@query("ordinal", f"WITH {EV}, l AS (SELECT event_type, row_number() OVER (ORDER BY min(pos)) - 1 AS code FROM ev WHERE trim(event_type) <> '' GROUP BY 1) SELECT pos, coalesce(code, -1) AS event_type_ordinal FROM ev LEFT JOIN l USING (event_type)")
def _ordinal(spark, d):
    return features.ordinal(events(spark, d).select("pos", "event_type"), "event_type").drop("event_type")


@query("target_mean", f"WITH {EV}, m AS (SELECT event_type, avg(v) AS r FROM ev WHERE trim(event_type) <> '' GROUP BY 1) SELECT pos, CASE WHEN r IS NOT NULL THEN {up('r', 2)} END AS event_type_target_mean FROM ev LEFT JOIN m USING (event_type)")
def _target(spark, d):
    return features.target_mean(events(spark, d).select("pos", "event_type", "v"), "event_type", "v").drop("event_type", "v")


# --- alignment ------------------------------------------------------------------------------------------------------------------

def _side(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh event, 40 seconds later or at its own time."""
    return events(spark, d).where("pos % 7 = 0").select("pos", F.timestamp_add("SECOND", F.when(F.col("pos") % 2 == 0, 0).otherwise(40), F.col("ts")).alias("t"), F.col("value").alias("rain"))


_SIDE = "m AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS sec, min(pos) AS main FROM ev GROUP BY 1), sd AS (SELECT pos AS side, CAST(floor(epoch(ts)) AS BIGINT) + CASE WHEN pos % 2 = 0 THEN 0 ELSE 40 END AS sec, value AS rain FROM ev WHERE pos % 7 = 0)"


@query("align_exact", f"WITH {EV}, {_SIDE}, l AS (SELECT main, arg_max(rain, side) AS rain FROM sd JOIN m USING (sec) GROUP BY main) SELECT pos, rain FROM ev LEFT JOIN l ON pos = main")
def _exact(spark, d):
    return align.align(events(spark, d), "ts", _side(spark, d), "t", "rain", "rain").select("pos", "rain")


@query("align_nearest", f"""WITH {EV}, {_SIDE}, p AS (SELECT sd.*, a.sec AS ls, a.main AS lm FROM sd ASOF LEFT JOIN m a ON sd.sec >= a.sec), n AS (SELECT p.*, b.sec AS rs, b.main AS rm FROM p ASOF LEFT JOIN m b ON p.sec <= b.sec),
 c AS (SELECT side, rain, sec, CASE WHEN ls IS NULL THEN rs WHEN rs IS NULL THEN ls WHEN sec - ls <= rs - sec THEN ls ELSE rs END AS hit, CASE WHEN ls IS NULL THEN rm WHEN rs IS NULL THEN lm WHEN sec - ls <= rs - sec THEN lm ELSE rm END AS main FROM n),
 l AS (SELECT main, arg_max(rain, side) AS rain FROM c WHERE abs(hit - sec) <= 60 GROUP BY main) SELECT pos, rain FROM ev LEFT JOIN l ON pos = main""")
def _nearest(spark, d):
    return align.align(events(spark, d), "ts", _side(spark, d), "t", "rain", "rain", how="nearest", tolerance=1).select("pos", "rain")


@query("align_table", f"WITH {EV}, {_SIDE}, l AS (SELECT main, arg_max(rain, side) AS rain, arg_max(side * 2.0::DOUBLE, side) AS twice FROM sd JOIN m USING (sec) GROUP BY main) SELECT pos, rain, twice FROM ev LEFT JOIN l ON pos = main")
def _table(spark, d):
    side = _side(spark, d).withColumns({"twice": F.col("pos") * 2.0, "note": F.lit("text")})
    return align.align_table(events(spark, d).select("pos", "ts"), "ts", side, "t")[0].drop("ts")


@query("align_receipt", f"WITH {EV}, {_SIDE}, l AS (SELECT main, max(side) AS side FROM sd JOIN m USING (sec) GROUP BY main), c AS (SELECT (SELECT count(*) FROM sd) AS side_rows, (SELECT count(*) FROM l) AS matched, (SELECT count(*) FROM l WHERE side % 5 = 0) AS coerced, (SELECT count(*) FROM ev) AS main_rows) SELECT side_rows, matched, side_rows - matched AS unmatched, coerced, 'note' AS non_numeric, matched::DOUBLE / main_rows * 100 AS coverage FROM c")
def _table_receipt(spark, d):
    side = _side(spark, d).withColumns({"rain": F.when(F.col("pos") % 5 == 0, "none").otherwise(F.col("rain").cast("string")), "note": F.lit("text")})
    receipt = align.align_table(events(spark, d).select("pos", "ts"), "ts", side, "t")[1]
    found = receipt["stats"]
    return spark.createDataFrame([(found["sideRows"], found["matchedSideRows"], found["unmatchedSideRows"], receipt["coerced"]["rain"], ",".join(receipt["nonNumeric"]), found["coverage"])], "side_rows long, matched long, unmatched long, coerced long, non_numeric string, coverage double")


def _parts(spark: SparkSession, d: str) -> list[DataFrame]:
    e = events(spark, d)
    at = F.when(F.col("pos") % 1000 != 999, F.date_trunc("hour", "ts").cast("timestamp_ntz")).alias("ts")
    return [e.where("pos % 3 = 0").select("pos", at, "v"), e.where("pos % 3 = 1").select("pos", at, "v", "event_type"), e.where("pos % 3 = 2").select("pos", at, "v")]


_MERGED = f"WITH {EV}, x AS (SELECT pos AS old, pos % 3 AS f, CASE WHEN pos % 1000 <> 999 THEN date_trunc('hour', ts) END AS ts, v, CASE WHEN pos % 3 = 1 THEN event_type END AS event_type FROM ev)"


@query("merge_union", f"{_MERGED} SELECT row_number() OVER (ORDER BY ts NULLS LAST, f, old) - 1 AS pos, ts, v, event_type FROM x")
def _merge(spark, d):
    return align.merge(_parts(spark, d), "ts")


@query("merge_receipt", f"""{_MERGED}, a AS (SELECT *, row_number() OVER (ORDER BY f, old) - 1 AS place, row_number() OVER (ORDER BY ts NULLS LAST, f, old) - 1 AS dest FROM x),
 j AS (SELECT lag(ts) OVER (ORDER BY place) > ts AS back FROM a WHERE ts IS NOT NULL)
SELECT CAST(3 AS BIGINT) AS files, count(*) AS rows, CAST(3 AS BIGINT) AS columns, 'event_type' AS union_only, CAST(sum(CASE WHEN f <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS gap_cells, CAST(sum(CASE WHEN place <> dest THEN 1 ELSE 0 END) AS BIGINT) AS rows_moved,
 (SELECT CAST(sum(CASE WHEN back THEN 1 ELSE 0 END) AS BIGINT) FROM j) AS backjumps_before, CAST(0 AS BIGINT) AS backjumps_after,
 count(*) - count(DISTINCT ts) - CASE WHEN count(ts) < count(*) THEN 1 ELSE 0 END AS duplicate_times, count(*) - count(ts) AS empty_times, min(ts) AS start, max(ts) AS "end" FROM a""")
def _receipt(spark, d):
    return align.merge_receipt(_parts(spark, d), "ts")


@query("backjumps", f"WITH {EV}, x AS (SELECT pos, CASE WHEN pos % 10 = 0 THEN ts - INTERVAL 1 DAY ELSE ts END AS t FROM ev), y AS (SELECT lag(t) OVER (ORDER BY pos) > t AS b FROM x) SELECT CAST(sum(CASE WHEN b THEN 1 ELSE 0 END) AS BIGINT) AS backjumps FROM y")
def _back(spark, d):
    return align.backjumps(events(spark, d).withColumn("ts", F.when(F.col("pos") % 10 == 0, F.timestamp_add("DAY", F.lit(-1), F.col("ts"))).otherwise(F.col("ts"))), "ts")


@query("formula_exo", f"WITH {EV}, x AS (SELECT pos, 10 + 3 * sin(2 * pi() * (hour(ts) + minute(ts) / 60.0::DOUBLE) / 24) + greatest(day(ts) / 7.0::DOUBLE, 1) - (pos - floor(pos / 5.0::DOUBLE) * 5) * dayofweek(ts) AS r FROM ev) SELECT pos, floor(r * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS made FROM x")
def _formula(spark, d):
    return align.formula_column(events(spark, d), "ts", "made", "10 + 3 * sin(2 * PI * hour / 24) + max(day / 7, 1) - idx % 5 * weekday").select("pos", "made")


# --- exploration ----------------------------------------------------------------------------------------------------------------

for _name in explore.SPANS:

    @query(f"period_window_{_name}", f"WITH {EV}, p AS (SELECT DISTINCT date_trunc('{_name}', ts)::TIMESTAMP AS s FROM ev), k AS (SELECT s FROM p ORDER BY s LIMIT 1 OFFSET (SELECT least(1, count(*) - 1) FROM p)) SELECT pos, ts, v FROM ev WHERE date_trunc('{_name}', ts)::TIMESTAMP = (SELECT s FROM k)")
    def _period(spark, d, name=_name):
        return explore.period_window(events(spark, d), "ts", name, 1).select("pos", "ts", "v")


for _name, _unit_ in (("year", "1 YEAR"), ("month", "1 MONTH"), ("week", "7 DAY"), ("day", "1 DAY")):

    @query(f"period_info_{_name}", f"WITH {EV}, p AS (SELECT date_trunc('{_name}', ts)::TIMESTAMP AS s, count(*) AS n FROM ev GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY s) AS i, count(*) OVER () AS c FROM p) SELECT s AS \"from\", s + INTERVAL {_unit_} AS \"to\", n AS window_rows, (SELECT count(*) FROM ev) AS total_rows, c AS period_total, i AS period_index, i - 1 AS \"offset\", c < 4 AS clamped FROM r WHERE i = least(4, c)")
    def _info(spark, d, name=_name):
        return explore.period_info(events(spark, d), "ts", name, 3)


@query("row_page", f"WITH {EV} SELECT pos, ts, v FROM ev WHERE pos BETWEEN 100 AND 149")
def _page(spark, d):
    return explore.page(events(spark, d), 100, 50).select("pos", "ts", "v")


@query("downsample_mean", f"WITH {EV}, x AS (SELECT pos // 4 * 4 AS p, avg(v) AS m FROM ev GROUP BY 1) SELECT p AS pos, CASE WHEN m IS NOT NULL THEN {up('m', 2)} END AS v FROM x")
def _means(spark, d):
    return explore.downsample_mean(events(spark, d), "v")


@query("downsample_extremes", f"""WITH {EV}, b AS (SELECT pos, v, ((pos + 1) * 50 - 1) // (SELECT count(*) FROM ev) AS b FROM ev),
 r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY v NULLS LAST, pos) AS lo, row_number() OVER (PARTITION BY b ORDER BY v DESC NULLS LAST, pos) AS hi FROM b),
 p AS (SELECT DISTINCT pos FROM (SELECT pos FROM r WHERE v IS NOT NULL AND (lo = 1 OR hi = 1) UNION ALL SELECT min(pos) FROM b WHERE v IS NULL GROUP BY b UNION ALL SELECT max(pos) FROM b WHERE v IS NULL GROUP BY b)),
 n AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS i, count(*) OVER () AS c FROM p), t AS (SELECT pos, i, c, CAST(ceil(c / 200.0::DOUBLE) AS BIGINT) AS step FROM n)
SELECT pos FROM t WHERE c <= 200 OR i % step = 0 OR i = c - 1""")
def _extremes(spark, d):
    return explore.downsample_extremes(events(spark, d), ["v"], 200)


_AREA = "abs((l.p - c.p) * (x.v0 - l.v0) - (l.p - x.p) * (c.v0 - l.v0)) / s.s0 + abs((l.p - c.p) * (x.v1 - l.v1) - (l.p - x.p) * (c.v1 - l.v1)) / s.s1"


@query("lttb", f"""WITH RECURSIVE {EV}, s AS (SELECT count(*) AS n, avg(v) AS m0, avg(value) AS m1, max(v) - min(v) AS s0, max(value) - min(value) AS s1 FROM ev),
 r AS (SELECT CAST(CASE WHEN pos = 0 THEN -1 WHEN pos = n - 1 THEN 198 ELSE floor((pos - 1) / (CAST(n - 2 AS DOUBLE) / 198)) END AS INT) AS b, CAST(pos AS DOUBLE) AS p, coalesce(v, m0) AS v0, coalesce(value, m1) AS v1 FROM ev, s),
 centre AS (SELECT b, avg(p) AS p, avg(v0) AS v0, avg(v1) AS v1 FROM r GROUP BY b),
 held AS (SELECT b, list(struct_pack(p := p, v0 := v0, v1 := v1) ORDER BY p) AS pts FROM r GROUP BY b),
 last AS (
  SELECT b, p, v0, v1 FROM r WHERE b = -1
  UNION ALL
  SELECT b, w.p, w.v0, w.v1 FROM (
   SELECT g.b, list_max(list_transform(g.pts, lambda x: struct_pack(area := {_AREA}, q := -x.p, p := x.p, v0 := x.v0, v1 := x.v1))) AS w
   FROM last AS l JOIN held AS g ON g.b = l.b + 1 JOIN centre AS c ON c.b = l.b + 2, s))
SELECT CAST(p AS BIGINT) AS pos FROM last UNION ALL SELECT CAST(p AS BIGINT) FROM r WHERE b = 198""")
def _lttb(spark, d):
    return explore.lttb(events(spark, d), ["v", "value"], 200)


# --- times as text --------------------------------------------------------------------------------------------------------------

@query("time_parse", f"WITH {EV} SELECT pos, CASE WHEN pos % 5 <> 0 THEN date_trunc('minute', ts) END AS t FROM ev")
def _parse(spark, d):
    text = F.when(F.col("pos") % 5 == 0, F.date_format("ts", "dd.MM.yyyy")).when(F.col("pos") % 2 == 0, F.date_format("ts", "yyyy-M-d H:mm")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm"))
    return events(spark, d).select("pos", timeparse.parse(text, "YYYY-MM-DD HH:mm").alias("t"))


@query("time_render", f"WITH {EV} SELECT pos, strftime(ts, '%Y/%-m/%-d %-H:%M') AS short, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) AS unix FROM ev")
def _render(spark, d):
    return events(spark, d).select("pos", timeparse.render(F.col("ts"), "YYYY/M/D H:mm").alias("short"), timeparse.render(F.col("ts"), "YYYY-MM-DDTHH:mm:ss").alias("iso"), timeparse.render(F.col("ts"), "epoch_s").alias("unix"))


@query("time_vote", "SELECT 'MM/DD/YYYY' AS us, 'YYYY-MM-DD' AS iso, 'YYYY/MM/DD HH:mm' AS read, CAST((SELECT count(*) FROM events WHERE event_id % 5 <> 0) AS BIGINT) AS hits, CAST((SELECT count(*) FROM events) AS BIGINT) AS filled")
def _vote(spark, d):
    df = events(spark, d)
    us = timeparse.vote(df.select(F.date_format("ts", "M/d/yyyy HH:mm:ss").alias("t")), "t")
    iso = timeparse.vote(df.select(F.when(F.col("pos") % 2 == 0, F.date_format("ts", "yyyy-M-d")).otherwise(F.date_format("ts", "dd-MM-yyyy")).alias("t")).where("t is not null"), "t")
    form, hits, full = timeparse.best_format(df.select(F.when(F.col("pos") % 5 == 0, "soon").otherwise(F.date_format("ts", "yyyy/M/d H:mm")).alias("t")), "t")
    return spark.createDataFrame([(us, iso, form, hits, full)], "us string, iso string, read string, hits long, filled long")


@query("time_changed", f"WITH {EV} SELECT CAST(sum(CASE WHEN strftime(ts, '%Y-%m-%d %H:%M') <> strftime(ts, '%Y-%m-%d %H:%M:%S') THEN 1 ELSE 0 END) AS BIGINT) AS changed FROM ev")
def _changed(spark, d):
    return spark.createDataFrame([(timeparse.changed_cells(events(spark, d), "ts", "YYYY-MM-DD HH:mm", "YYYY-MM-DD HH:mm:ss"),)], "changed long")


@query("time_detect", "SELECT 'stamp' AS name, 'YYYY-MM-DD HH:mm:ss' AS format")
def _detect_time(spark, d):
    df = events(spark, d).select("v", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("stamp"))
    name, form, _ = timeparse.pick_time_column(df.withColumnRenamed("stamp", "timestamp").select("v", "timestamp"))
    return spark.createDataFrame([("stamp" if name == "timestamp" else name, form)], "name string, format string")


# --- generated frames and pipelines ---------------------------------------------------------------------------------------------

for _name in ("pv", "load"):

    @query(f"preset_{_name}")
    def _preset(spark, d, name=_name):
        return presets.frame(spark, name)


for _name in presets.EXOGENOUS:

    @query(f"exo_preset_{_name}")
    def _exo(spark, d, name=_name):
        return presets.exogenous(events(spark, d), "ts", name, 11, temperature="value").select("pos", name)


@query("workspace_chain", f"WITH {EV}, {near('v')}, y AS (SELECT *, {_RAW['linear']} AS raw FROM near, (SELECT count(*) AS n FROM ev)), i AS (SELECT pos, coalesce(v, {up('raw', 4)}) AS v FROM y), x AS (SELECT pos, v * 2.0::DOUBLE AS r FROM i), z AS (SELECT pos, {up('r', 4)} AS v FROM x), l AS (SELECT pos, v, v - lag(v, 1) OVER (ORDER BY pos) AS g FROM z) SELECT pos, v, CASE WHEN g IS NOT NULL THEN {up('g', 4)} END AS diff1_v FROM l")
def _chain(spark, d):
    from .plans.pipeline import Workspace

    w = Workspace.open(events(spark, d).select("pos", "ts", "v"), "ts")
    w.apply("impute", all={"v": "linear"}).apply("convert_unit", column="v", factor=3.0).undo()
    return w.apply("convert_unit", column="v", factor=2.0).apply("feature_diff", columns=["v"]).df.select("pos", "v", "diff1_v")
