"""Recognition, parsing and rendering of times written as text or numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import col
from .stats import quantile

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
# Formats that are recognised, in the order that decides between equal votes
FORMATS = (
    "YYYY-MM-DD HH:mm:ss.SSS",
    "YYYY-MM-DD HH:mm:ss",
    "YYYY/MM/DD HH:mm:ss.SSS",
    "YYYY/MM/DD HH:mm",
    "YYYY-MM-DDTHH:mm:ss.SSS",
    "YYYY-MM-DDTHH:mm:ss",
    "YYYY-MM-DD HH:mm",
    "YYYY-MM-DD",
    "YYYY/MM/DD",
    "epoch_ms",
    "epoch_s",
    "YYYYMMDDHHmmss",
    "YYYYMMDD",
    "MM/DD/YYYY",
    "DD-MM-YYYY",
)
# Formats whose text may go on after the time when votes are counted
OPEN_ENDED = ("YYYY-MM-DDTHH:mm:ss.SSS", "YYYY-MM-DDTHH:mm:ss", "MM/DD/YYYY", "DD-MM-YYYY")
# Formats for display; any other template of at most 64 characters may be given by hand
DISPLAY = (
    "YYYY-MM-DD HH:mm:ss",
    "YYYY-MM-DD HH:mm",
    "YYYY-MM-DD",
    "YYYY/MM/DD HH:mm",
    "YYYY/MM/DD",
    "YYYY-MM-DDTHH:mm:ss",
    "YYYY-MM-DD HH:mm:ss.SSS",
    "YYYYMMDDHHmmss",
    "YYYYMMDD",
    "epoch_ms",
    "epoch_s",
)
TOKENS = {"YYYY": (r"\d{4}", "yyyy", "y"), "SSS": (r"\d{1,6}", "SSS", "[SSSSSS][SSS][SS][S]"), "MM": (r"\d{1,2}", "MM", "M"), "DD": (r"\d{1,2}", "dd", "d"), "HH": (r"\d{1,2}", "HH", "H"), "mm": (r"\d{1,2}", "mm", "m"), "ss": (r"\d{1,2}", "ss", "s"), "M": (r"\d{1,2}", "M", "M"), "D": (r"\d{1,2}", "d", "d"), "H": (r"\d{1,2}", "H", "H"), "m": (r"\d{1,2}", "m", "m")}
NAME_HINTS = ("time", "date", "timestamp", "ts", "时间", "日期")
SAMPLE, LEAST_RATE = 20, 0.6


def _parts(template: str) -> list[tuple[bool, str]]:
    template = template.replace("yyyy", "YYYY").replace("dd", "DD").replace("hh", "HH")
    found, at = [], 0
    pattern = re.compile("|".join(sorted(TOKENS, key=len, reverse=True)))
    while at < len(template):
        m = pattern.match(template, at)
        found.append((True, m[0]) if m else (False, template[at]))
        at = m.end() if m else at + 1
    return found


def to_regex(template: str) -> str:
    packed = not re.search(r"[^A-Za-z]", template)
    widths = {"YYYY": r"\d{4}", "SSS": r"\d{3}"}
    return "^" + "".join((widths.get(x, r"\d{2}") if packed else TOKENS[x][0]) if token else re.escape(x) for token, x in _parts(template)) + "$"


def to_java(template: str, parse: bool) -> str:
    """A pattern of the JVM's formatter; for parsing, numbers may lack leading zeros unless nothing separates them."""
    packed = not re.search(r"[^A-Za-z]", template)
    which = 2 if parse and not packed else 1
    return "".join(TOKENS[x][which] if token else ("''" if x == "'" else f"'{x}'" if x.isalpha() else x) for token, x in _parts(template))


def vote_regex(template: str) -> str:
    """What a sample must look like to count for a format."""
    if template in ("epoch_s", "epoch_ms"):
        return rf"^\d{{{13 if template == 'epoch_ms' else 10}}}$"
    whole = to_regex(template).replace(TOKENS["SSS"][0], r"\d{1,3}")
    return whole[:-1] if template in OPEN_ENDED else whole


def votes(df: DataFrame, column: str) -> dict[str, int]:
    """How many of the first 20 values that aren't missing have the shape of each format."""
    text = F.trim(col(column).cast("string"))
    sample = df.where(col(column).isNotNull()).select(text.alias("t")).limit(SAMPLE)
    hits = sample.agg(*[F.sum(F.col("t").rlike(vote_regex(f)).cast("int")) for f in FORMATS]).first()
    return {f: n or 0 for f, n in zip(FORMATS, hits, strict=True)}


def vote(df: DataFrame, column: str) -> str | None:
    """The format that fits most of the first 20 values, of several the first; None if none fits any."""
    found = votes(df, column)
    best = max(FORMATS, key=lambda f: (found[f], -FORMATS.index(f)))
    return best if found[best] else None


def best_format(df: DataFrame, column: str) -> tuple[str | None, int, int]:
    """The format by which most values can be read, the vote's winner first and then in order, the values that it reads and those that aren't blank."""
    first = vote(df, column)
    order = sorted((f for f in FORMATS if not f.startswith("epoch")), key=lambda f: (f != first, FORMATS.index(f)))
    text = F.trim(col(column).cast("string"))
    full, *hits = df.agg(F.count_if(text != ""), *[F.count(parse(col(column), f)) for f in order]).first()
    at = max(range(len(order)), key=lambda i: (hits[i], -i))
    return (order[at], hits[at], full) if hits[at] else (None, 0, full)


def epoch_kind(df: DataFrame, column: str) -> str | None:
    """epoch_s or epoch_ms if all values are whole and their median is in range."""
    x = col(column).try_cast("double")
    whole = df.agg(F.min((x == F.rint(x)).cast("int"))).first()[0]
    middle = quantile(df.select(x.alias("x")), "x", 0.5) if whole else None
    if not whole or middle is None:
        return None
    return "epoch_s" if 1e8 <= middle < 1e10 else "epoch_ms" if 1e11 <= middle < 1e13 else None


def parse(c: Column, template: str, offset_seconds: int = 0) -> Column:
    """A timestamp without time zone, NULL where the text isn't exactly of that format."""
    if template in ("epoch_s", "epoch_ms"):
        micros = F.floor(c.try_cast("double") * (1e6 if template == "epoch_s" else 1e3)).cast("long") + offset_seconds * 1_000_000
        return F.timestamp_add("MICROSECOND", micros, F.expr(EPOCH))
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(to_regex(template)), F.try_to_timestamp(text, F.lit(to_java(template, True)))).cast("timestamp_ntz")


def render(ts: Column, template: str, offset_seconds: int = 0) -> Column:
    if template in ("epoch_s", "epoch_ms"):
        micros = F.timestamp_diff("MICROSECOND", F.expr(EPOCH), ts) - offset_seconds * 1_000_000
        return F.floor(micros / (1_000_000 if template == "epoch_s" else 1000)).cast("string")
    return F.date_format(ts, to_java(template, False))


def pick_time_column(df: DataFrame) -> tuple[str | None, str | None, list[tuple[str, str]]]:
    """(column, format, rejected): a column of timestamps, else the first with a telling name of which 60 % can be read."""
    rejected = []
    for name, kind in df.dtypes:
        if kind in ("timestamp", "timestamp_ntz"):
            return name, None, rejected
    for name, kind in df.dtypes:
        if not any(h in name.lower() for h in NAME_HINTS):
            continue
        if kind != "string":
            form, read, full = epoch_kind(df, name), *df.agg(F.count(col(name)), F.count(col(name))).first()
        else:
            form, read, full = best_format(df, name)
        if form is None:
            rejected.append((name, "no known format"))
            continue
        if full and read / full >= LEAST_RATE:
            return name, form, rejected
        rejected.append((name, f"{read} of {full} can be read"))
    return None, None, rejected


def examples(df: DataFrame, column: str, template: str, shown: str = "YYYY-MM-DD HH:mm:ss", n: int = 3) -> DataFrame:
    """The first values that aren't missing, before and after reading them by a format."""
    few = df.where(col(column).isNotNull()).select(col(column).cast("string").alias("before")).limit(n)
    return few.withColumn("after", render(parse(F.col("before"), template), shown))


def changed_cells(df: DataFrame, time: str, old: str, new: str) -> int:
    """How many times look different in another display format; 0 for the same one, without counting."""
    if old == new:
        return 0
    return df.where(~render(col(time), old).eqNullSafe(render(col(time), new))).count()


def set_time(df: DataFrame, column: str, template: str, offset_seconds: int = 0) -> DataFrame:
    return df.withColumn(column, parse(col(column), template, offset_seconds))
