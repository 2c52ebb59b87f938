"""Seeded example frames and exogenous columns. Every number of the stream that a generator of this seed would draw is found by its place in it,
so rows are generated in any order and on any machine."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.names import col
from ..functions.numeric import floor_round, half_up

EXOGENOUS = ("humidity", "pressure", "cloud_cover", "dew_point", "radiation_ghi", "radiation_dni", "electricity_price", "grid_frequency")
#: Exogenous columns that have values where the time is missing.
TIMELESS = ("pressure", "cloud_cover", "dew_point", "grid_frequency")
START = "timestamp_ntz'2024-06-01 00:00:00'"
# Level names of the example frames, and cloud cover by day
WEATHER = ("晴朗", "多云", "少云", "阴天")
TIERS = ("高峰电价", "低谷电价")
CLOUDS = (2.0, 5.0, 7.0, 3.0)
#: Rows of a frame and minutes between them.
FRAMES = {"pv": (2880, 15), "load": (720, 60)}


def draws(seed: int):
    """A pandas UDF: the numbers in [0, 1) at these places of the stream of a PCG64 generator, found by jumping ahead."""
    import numpy as np

    @F.pandas_udf(DoubleType())
    def draw(at: pd.Series) -> pd.Series:
        out, places = np.empty(len(at)), at.fillna(0).to_numpy(np.int64)
        for part in np.split(np.arange(len(places)), np.flatnonzero(np.diff(places) != 1) + 1):
            if len(part):
                out[part] = np.random.Generator(np.random.PCG64(seed).advance(int(places[part[0]]))).random(len(part))
        return pd.Series(out).where(at.notna().to_numpy())

    return draw


def _wave(hour: Column, shift: int, period: int) -> Column:
    return F.sin((hour - shift) / period * (math.pi if period == 13 else 2 * math.pi))


def _even(x: Column, digits: int) -> Column:
    """Rounded to the even neighbour after scaling."""
    return F.rint(x * 10.0**digits) / 10.0**digits


def frame(spark: SparkSession, name: str, seed: int = 7) -> DataFrame:
    """pv: 2,880 rows of 15 minutes with a gap, a spike and a negative value; load: 720 rows of an hour with a spike."""
    rows, minutes = FRAMES[name]
    u, pos = draws(seed), F.col("pos")
    df = spark.range(0, rows, 1, 4).withColumnRenamed("id", "pos")
    minute = pos * minutes % 1440
    hour = F.floor(minute / 60).cast("double")
    ts = F.timestamp_add("MINUTE", pos * minutes, F.expr(START)).alias("timestamp")
    if name == "pv":
        hour = minute / 60.0
        day, a_day = (minute >= 360) & (minute <= 1140), 53
        # daylight draws come first, so many a day; then one for each row of power, temperature and wind
        days = rows * minutes // 1440 * a_day
        df = df.withColumns({"u0": u(F.when(day, F.floor(pos * minutes / 1440) * a_day + (minute - 360) / minutes).cast("long")), **{f"u{i + 1}": u(F.lit(days + i * rows) + pos) for i in range(3)}})
        light = F.greatest(F.when(day, _wave(hour, 6, 13) * 920 + (F.col("u0") - 0.5) * 60).otherwise(0.0), F.lit(0.0))
        power = F.when(light > 0, light * 1.85 + (F.col("u1") - 0.5) * 30).otherwise(0.0)
        power = F.when(pos.between(380, 388), None).when(pos == 550, 3100.0).when(pos == 820, -80.0).otherwise(_even(power, 2))
        warmth = 20 + _wave(hour, 4, 24) * 10 + (F.col("u2") - 0.5) * 2
        weather = F.get(F.array(*map(F.lit, WEATHER)), (F.floor(pos / 96) % 4).cast("int"))
        return df.select("pos", ts, power.alias("active_power"), _even(light, 1).alias("irradiance"), _even(warmth, 1).alias("temperature"), _even(2.5 + F.col("u3") * 3.5, 1).alias("wind_speed"), weather.alias("weather_type"))
    df = df.withColumns({"u0": u(pos), "u1": u(F.lit(rows) + pos)})
    busy = F.when(hour.between(9, 11) | hour.between(19, 21), 110.0).otherwise(0.0)
    load = F.when(pos == 120, 890.0).otherwise(half_up(350 + _wave(hour, 3, 24) * 80 + busy + (F.col("u0") - 0.5) * 25, 2))
    return df.select("pos", ts, load.alias("load_demand"), half_up(22 + _wave(hour, 5, 24) * 8, 1).alias("temperature"), half_up(60 + (F.col("u1") - 0.5) * 20, 1).alias("humidity"), F.when(hour.between(8, 21), TIERS[0]).otherwise(TIERS[1]).alias("price_tier"))


def exogenous(df: DataFrame, time: str, name: str, seed: int, pos: str = "pos", temperature: str | None = "temperature") -> DataFrame:
    """df with one of the known exogenous columns; dew_point needs a temperature, 20 degrees where that is missing. Without a time there is no value but for TIMELESS."""
    if name not in EXOGENOUS:
        raise ValueError(f"unknown preset: {name}")
    if name == "dew_point" and temperature not in df.columns:
        raise ValueError("dew_point needs a temperature column")
    hour, at, u = F.hour(col(time)).cast("double"), col(pos), draws(seed)
    out = df.withColumn("__u", u(at))
    noise = F.col("__u") - 0.5
    day, sun = F.coalesce(hour.between(6, 19), F.lit(False)), _wave(hour, 6, 13)
    if name == "electricity_price":
        # the draws of the dear hours come first, those of the cheap ones after one for each row
        out = out.withColumn("__w", u(at + F.lit(df.count())))
        made = floor_round(F.when(hour.between(8, 21), 0.85 + F.col("__u") * 0.15).otherwise(0.35 + F.col("__w") * 0.1), 3)
    elif name == "cloud_cover":
        cover = F.get(F.array(*map(F.lit, CLOUDS)), (F.floor(at / 96) % 4).cast("int"))
        made = F.least(F.greatest(F.floor(cover + noise * 4 + 0.5).cast("double"), F.lit(0.0)), F.lit(10.0))
    elif name == "dew_point":
        made = floor_round(F.coalesce(col(temperature).try_cast("double"), F.lit(20.0)) - 5 - F.col("__u") * 3, 1)
    elif name in ("radiation_ghi", "radiation_dni"):
        peak, spread = (800, 50) if name == "radiation_ghi" else (650, 40)
        made = floor_round(F.when(day, sun * peak + noise * spread).otherwise(0.0), 1)
    else:
        made = {"humidity": floor_round(60 + 20 * _wave(hour, 6, 24) + noise * 15, 1), "pressure": floor_round(1013.25 + noise * 8, 1), "grid_frequency": floor_round(50 + noise * 0.1, 3)}[name]
    if name not in TIMELESS:
        made = F.when(col(time).isNotNull(), made)
    return out.withColumn(name, made).drop("__u", "__w")
