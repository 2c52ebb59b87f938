"""Calendar, lag, rolling, difference, spectral and categorical features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import col, cols
from ..functions.numeric import half_up
from ..plans.order import BUCKET, Halo, with_running
from .stats import value_counts

MAX_COLUMNS, MAX_LEVELS, MAX_WINDOW = 400, 200, 5000


def calendar(df: DataFrame, time: str, holidays: list[str] = ()) -> DataFrame:
    t = col(time)
    parts = {"hour": F.hour(t), "day": F.dayofmonth(t), "month": F.month(t), "weekday": F.weekday(t), "is_weekend": (F.weekday(t) >= 5).cast("int"), "holiday": F.date_format(t, "yyyy-MM-dd").isin(list(holidays)).cast("int") if holidays else F.when(t.isNotNull(), 0)}
    return df.withColumns({f"feat_{k}": c.cast("double") for k, c in parts.items()})


def cyclical(df: DataFrame, time: str, parts: tuple[str, ...] = ("hour", "weekday", "month"), keep: bool = True) -> DataFrame:
    """Sine and cosine of hour of day, weekday and month, to 3 places; they take the place of the plain numbers unless these are kept."""
    t = col(time)
    turns = {k: x for k, x in {"hour": F.hour(t) / 24.0, "weekday": F.weekday(t) / 7.0, "month": (F.month(t) - 1) / 12.0}.items() if k in parts}
    raw = df.withColumns({f"__{k}_{n}": f(F.lit(2 * math.pi) * x) for k, x in turns.items() for n, f in (("sin", F.sin), ("cos", F.cos))})
    out = raw.withColumns({f"feat_{k}_{n}": half_up(f"__{k}_{n}", 3) for k in turns for n in ("sin", "cos")}).drop(*[f"__{k}_{n}" for k in turns for n in ("sin", "cos")])
    return out if keep else out.drop(*[f"feat_{k}" for k in turns])


def lags(df: DataFrame, column: str, steps: list[int], pos: str = "pos") -> DataFrame:
    halo = Halo(df, max(steps), pos)
    return halo.own(halo.df.withColumns({f"lag_{column}_t{s}": F.lag(col(column), s).over(halo.window) for s in steps}))


def rolling(df: DataFrame, column: str, windows: list[int], kinds: list[str], pos: str = "pos") -> DataFrame:
    """Over the w rows before each, missing ones dropped; NULL in the first w rows. mean, std (population) and med are rounded to 2 places."""
    if max(windows) > MAX_WINDOW or len(windows) * len(kinds) > MAX_COLUMNS:
        raise ValueError("too wide a window or too many columns")
    halo = Halo(df, max(windows), pos)
    raw: dict[str, Column] = {}
    for w in windows:
        over = halo.before(w)
        if "std" in kinds or "median" in kinds:
            raw[f"__l{w}"] = F.collect_list(col(column)).over(over)
        for kind, f in (("mean", F.avg), ("max", F.max), ("min", F.min)):
            if kind in kinds:
                raw[f"__{kind}{w}"] = f(col(column)).over(over)
    out = halo.own(halo.df.withColumns(raw))
    made = {}
    for w in windows:
        near, n, full = F.col(f"__l{w}"), F.size(f"__l{w}"), col(pos) >= w
        if "std" in kinds:
            out = out.withColumn(f"__a{w}", F.aggregate(near, F.lit(0.0), lambda a, x: a + x) / F.when(n > 0, n))
            out = out.withColumn(f"__std{w}", F.sqrt(F.aggregate(near, F.lit(0.0), _square(F.col(f"__a{w}"))) / F.when(n > 0, n)))
            made[f"roll_std_{column}_w{w}"] = F.when(full, half_up(f"__std{w}", 2))
        if "median" in kinds:
            out = out.withColumn(f"__s{w}", F.array_sort(near)).withColumn(f"__med{w}", (F.get(f"__s{w}", F.floor((n - 1) / 2).cast("int")) + F.get(f"__s{w}", F.floor(n / 2).cast("int"))) / 2)
            made[f"roll_med_{column}_w{w}"] = F.when(full, half_up(f"__med{w}", 2))
        for kind in ("mean", "max", "min"):
            if kind in kinds:
                made[f"roll_{kind}_{column}_w{w}"] = F.when(full, half_up(f"__mean{w}", 2) if kind == "mean" else F.col(f"__{kind}{w}"))
    return out.withColumns(made).select(*cols(df.columns), *cols(made))


def _square(mean: Column):
    return lambda a, x: a + (x - mean) * (x - mean)


def expanding_mean(df: DataFrame, column: str, pos: str = "pos") -> DataFrame:
    out = with_running(df, column, pos).withColumn("__mean", F.try_divide("__sum", "__count"))
    return out.withColumn(f"expanding_mean_{column}", half_up("__mean", 2)).drop("__sum", "__count", "__mean")


def _states(x, start: float, alpha: float, lanes: int = 256):
    """The state after each value: s + alpha (x - s). The values run in lanes side by side, each from 0; what reaches a lane is added afterwards."""
    import numpy as np

    n = len(x)
    steps = -(-n // lanes) if n else 0
    grid = np.zeros(lanes * steps)
    grid[:n] = x
    grid = grid.reshape(lanes, steps)
    own, keep = np.empty_like(grid), (1 - alpha) ** np.arange(1, steps + 1)
    state = np.zeros(lanes)
    for t in range(steps):
        state = state + alpha * (grid[:, t] - state)
        own[:, t] = state
    reach = np.empty(lanes)
    for i in range(lanes if steps else 0):
        reach[i] = start
        start = start * keep[-1] + own[i, -1]
    return (own + reach[:, None] * keep).ravel()[:n] if steps else grid.ravel()


def ewm(df: DataFrame, column: str, span: int = 12, pos: str = "pos", size: int = BUCKET) -> DataFrame:
    """The exponentially weighted state before each row, to 2 places; missing values leave it as it is. Buckets of positions first yield
    their effect on a state (a factor and a sum, or their own state if there was none), then run with the state that reaches them."""
    import numpy as np
    import pyarrow as pa

    alpha = 2 / (min(500, max(2, span)) + 1)
    name = f"ewm_{column}_s{span}"
    narrow = df.select(F.floor(col(pos) / size).alias("b"), col(pos).cast("long").alias("p"), col(column).cast("double").alias("v"))

    def sorted_values(table):
        table = table.sort_by("p")
        return table, table["v"].to_numpy()

    def effect(table):
        v = sorted_values(table)[1]
        moved = _states(v, 0.0, alpha)[-1]
        own = v[0] if len(v) == 1 else _states(v[1:], v[0], alpha)[-1]
        return pa.table({"b": table["b"][:1], "keep": [(1 - alpha) ** len(v)], "moved": [float(moved)], "own": [float(own)]})

    # one row per bucket of 65,536 positions
    effects = narrow.where("v is not null").groupBy("b").applyInArrow(effect, "b long, keep double, moved double, own double").orderBy("b").toLocalIterator()
    state, reach = None, []
    for r in effects:
        reach.append((r["b"], state))
        state = r["own"] if state is None else r["keep"] * state + r["moved"]
    # a bucket without a value has the state that the next one with any starts from
    reach.append((1 << 62, state))
    starts = df.sparkSession.createDataFrame(reach, "k long, start double")
    carried = narrow.select(F.col("b").alias("k")).distinct().unionByName(starts, allowMissingColumns=True).groupBy("k").agg(F.max("start").alias("start"), F.count(F.lit(1)).alias("n"))
    known = carried.join(starts.select(F.col("k").alias("k2"), F.lit(True).alias("known")), F.col("k") == F.col("k2"), "left")
    onwards = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    carried = known.select("k", F.last(F.when(F.col("known"), F.struct("start")), True).over(onwards)["start"].alias("start"))

    def run(table):
        table, v = sorted_values(table)
        start = table["start"][0].as_py()
        there = ~np.isnan(v)
        x = v[there]
        if start is None:
            states = np.concatenate(([np.nan], x[:1], _states(x[1:], x[0], alpha) if len(x) > 1 else []))
        else:
            states = np.concatenate(([start], _states(x, start, alpha)))
        before = np.cumsum(there) - there
        return pa.table({"p": table["p"], "ewm": pa.array(states[before], from_pandas=True)})

    made = narrow.join(carried, F.col("b") == F.col("k")).select("b", "p", "v", "start").groupBy("b").applyInArrow(run, "p long, ewm double")
    made = made.select(F.col("p").alias("__pos"), F.col("ewm").alias("__ewm"))
    return df.join(made, col(pos) == F.col("__pos")).withColumn(name, half_up("__ewm", 2)).drop("__pos", "__ewm")


def differences(df: DataFrame, column: str, seasons: list[int] = (), pos: str = "pos") -> DataFrame:
    """diff1, diff2 (difference of the difference) and seasonal differences, to 4 places."""
    halo = Halo(df, max([2, *seasons]), pos)
    v = col(column)
    raw = {f"__{p}": F.lag(col(column), p).over(halo.window) for p in sorted({1, 2, *seasons})}
    out = halo.own(halo.df.withColumns(raw))
    out = out.withColumns({"__d1": v - F.col("__1"), "__d2": (v - F.col("__1")) - (F.col("__1") - F.col("__2")), **{f"__s{p}": v - F.col(f"__{p}") for p in seasons}})
    made = {f"diff1_{column}": half_up("__d1", 4), f"diff2_{column}": half_up("__d2", 4), **{f"diff_season{p}_{column}": half_up(f"__s{p}", 4) for p in seasons}}
    return out.withColumns(made).select(*cols(df.columns), *cols(made))


def spectrum(df: DataFrame, column: str, pos: str = "pos") -> DataFrame:
    """k and magnitude |sum x e^(-2 pi i k n / N)| / N of the whole series for k up to min(50, N // 2); missing values are 0. One pass for all k."""
    n = df.count()
    ks = range(1, min(50, n // 2) + 1)
    if not ks:
        return df.sparkSession.createDataFrame([], "k int, magnitude double")
    v = F.coalesce(col(column), F.lit(0.0))
    angle = lambda k: F.lit(2 * math.pi) * (col(pos) * k % n) / n
    sums = df.agg(*[F.sum(v * f(angle(k))).alias(f"{a}{k}") for k in ks for a, f in (("c", F.cos), ("s", F.sin))])
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), (F.sqrt(F.col(f"c{k}") * F.col(f"c{k}") + F.col(f"s{k}") * F.col(f"s{k}")) / n).alias("magnitude")) for k in ks])
    return sums.select(F.explode(pairs).alias("x")).select("x.*")


def dominant(df: DataFrame, column: str, pos: str = "pos") -> DataFrame:
    """fft_top1..3: per row the amplitude, over the last 65 rows (fewer at the start), at the three strongest frequencies of the whole series; to 2 places."""
    top = [r["k"] for r in spectrum(df, column, pos).orderBy(F.desc("magnitude"), "k").limit(3).collect()]
    halo = Halo(df, 64, pos)
    v = F.coalesce(col(column), F.lit(0.0))
    over = halo.last(65)
    near = halo.own(halo.df.withColumns({f"__{a}{i}": F.sum(v * f(F.lit(2 * math.pi * k / 65) * (col(pos) % 65))).over(over) for i, k in enumerate(top) for a, f in (("c", F.cos), ("s", F.sin))} | {"__head": F.when(col(pos) < 64, F.collect_list(v).over(over))}))
    made = {}
    for i, k in enumerate(top):
        size = F.size("__head").cast("double")
        part = lambda f, k=k, size=size: F.aggregate(F.transform("__head", lambda x, j: x * f(F.lit(2 * math.pi * k) * j / size)), F.lit(0.0), lambda a, x: a + x)  # noqa: E731, B023
        near = near.withColumns({f"__hc{i}": part(F.cos), f"__hs{i}": part(F.sin)})
        c, s = F.coalesce(f"__hc{i}", f"__c{i}"), F.coalesce(f"__hs{i}", f"__s{i}")
        near = near.withColumn(f"__m{i}", F.sqrt(c * c + s * s) / F.coalesce(size, F.lit(65.0)))
        made[f"fft_top{i + 1}_{column}"] = half_up(f"__m{i}", 2)
    return near.withColumns(made).select(*cols(df.columns), *cols(made))


def spectral(df: DataFrame, column: str, high: int = 8, pos: str = "pos") -> DataFrame:
    """Spectral entropy (to 4 places) and the ratio of low (k up to 4) to high frequencies (to 2) over the 64 rows before each; NULL in the first 64."""
    halo = Halo(df, 64, pos)
    v, over = F.coalesce(col(column), F.lit(0.0)), halo.before(64)
    ks = range(1, 17)
    near = halo.own(halo.df.withColumns({f"__{a}{k}": F.sum(v * f(F.lit(2 * math.pi * k / 64) * (col(pos) % 64))).over(over) for k in ks for a, f in (("c", F.cos), ("s", F.sin))}))
    near = near.withColumn("__amp", F.array(*[F.sqrt(F.col(f"__c{k}") * F.col(f"__c{k}") + F.col(f"__s{k}") * F.col(f"__s{k}")) / 64 for k in ks]))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    near = near.withColumn("__sum", total(F.col("__amp")))
    near = near.withColumns({"__h": -total(F.transform(F.filter(F.transform("__amp", lambda x: F.try_divide(x, F.col("__sum"))), lambda p: p > 0), lambda p: p * F.log2(p))), "__r": total(F.slice("__amp", 1, 4)) / (total(F.slice("__amp", high, 17 - high)) + 1e-10)})
    made = {f"spec_entropy_{column}": F.when(col(pos) >= 64, half_up("__h", 4)), f"power_ratio_{column}": F.when(col(pos) >= 64, half_up("__r", 2))}
    return near.withColumns(made).select(*cols(df.columns), *cols(made))


def category_text(df: DataFrame, column: str) -> Column:
    """How a level is written: whole numbers without a fraction."""
    c, kind = col(column), dict(df.dtypes)[column]
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string")) if kind in ("double", "float") else c.cast("string")


def _levels(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("__level", category_text(df, column))


def one_hot(df: DataFrame, column: str, pos: str = "pos") -> DataFrame:
    df = _levels(df, column)
    levels = [r["level"] for r in value_counts(df, "__level", pos).orderBy("code").limit(MAX_LEVELS + 1).collect()]
    if len(levels) > MAX_LEVELS:
        raise ValueError(f"more than {MAX_LEVELS} levels")
    return df.withColumns({f"{column}_{x}": F.coalesce((F.col("__level") == x).cast("bigint"), F.lit(0).cast("bigint")) for x in levels}).drop("__level")


def ordinal(df: DataFrame, column: str, pos: str = "pos") -> DataFrame:
    df = _levels(df, column)
    codes = value_counts(df, "__level", pos).select(F.col("level").alias("__of"), F.col("code").alias("__code"))
    return df.join(codes, F.col("__level") == F.col("__of"), "left").withColumn(f"{column}_ordinal", F.coalesce("__code", F.lit(-1)).cast("bigint")).drop("__level", "__of", "__code")


def target_mean(df: DataFrame, column: str, target: str) -> DataFrame:
    """Mean of target by category, aggregated before the join, to 2 places; NULL for blanks."""
    df = _levels(df, column)
    means = df.where(F.col("__level").isNotNull() & (F.trim("__level") != "")).groupBy(F.col("__level").alias("__of")).agg(F.avg(col(target)).alias("__mean"))
    means = means.select("__of", half_up("__mean", 2).alias("__made"))
    return df.join(means, F.col("__level") == F.col("__of"), "left").withColumn(f"{column}_target_mean", F.col("__made")).drop("__level", "__of", "__made")
