"""A frame with its history: each version is a lazy plan, so undo and redo move a cursor and compute nothing."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import align, anomaly, clean, explore, features, resample, stats, timeparse


@dataclass(frozen=True)
class Meta:
    time: str | None = None
    time_format: str | None = None
    labels: dict = field(default_factory=dict)
    holidays: tuple = ()
    derived: tuple = ()
    #: The family of each generated column.
    features: dict = field(default_factory=dict)
    epoch: int = 0


class StaleDetection(ValueError):
    """The values have changed since the detection, or it finds something else now."""


#: Generated columns of a command at most.
MAX_FEATURES = 400
FAMILIES = {"feature_calendar": "time", "feature_lag": "lag", "feature_diff": "diff", "feature_category": "category"}


COMMANDS: dict[str, Callable[[DataFrame, Meta, dict], tuple[DataFrame, Meta]]] = {}
#: Commands that leave all values as they are.
QUIET = {"rename_column", "set_time_format", "mask-generate", "mask-delete", "holidays", "split_apply", "derived_column", "exo-formula", "feature_lag", "feature_diff", "feature_calendar", "feature_category"}


def command(name: str):
    def add(f):
        COMMANDS[name] = f
        return f

    return add


def _with(meta: Meta, **changes) -> Meta:
    return Meta(**{**meta.__dict__, **changes})


@command("rename_column")
def _rename(df, meta, p):
    if p["to"] in df.columns:
        raise ValueError(f"there is a column {p['to']}")
    moved = lambda x: p["to"] if x == p["column"] else x
    known = {moved(k): v for k, v in meta.labels.items()}
    if p.get("label"):
        known[p["to"]] = p["label"]
    return df.withColumnRenamed(p["column"], p["to"]), _with(meta, time=moved(meta.time), labels=known, derived=tuple(map(moved, meta.derived)), features={moved(k): v for k, v in meta.features.items()})


@command("delete_column")
def _delete(df, meta, p):
    if p["column"] == meta.time:
        raise ValueError("the time column can't be deleted")
    return df.drop(p["column"]), meta


@command("convert_unit")
def _unit(df, meta, p):
    return clean.convert_unit(df, p["column"], p["factor"], p.get("offset", 0.0)), _with(meta, labels={**meta.labels, p["column"]: p.get("unit", "")})


@command("derived_column")
def _derived(df, meta, p):
    return clean.derive(df, p["name"], p["terms"], p["operators"]), _with(meta, derived=(*meta.derived, p["name"]))


@command("split_apply")
def _split(df, meta, p):
    return clean.split(df, p["ratio"]), meta


@command("mask-generate")
def _mask(df, meta, p):
    return clean.mask(df, p["name"], p["start"], p["end"]), meta


@command("mask-delete")
def _unmask(df, meta, p):
    return df.drop(*[c for c in p["columns"] if c in df.columns]), meta


@command("holidays")
def _holidays(df, meta, p):
    from datetime import date

    days = tuple(sorted({date.fromisoformat(x).isoformat() for x in p["days"]}))
    if len(days) > 200:
        raise ValueError("at most 200 days")
    return df, _with(meta, holidays=days)


@command("set_time_col")
def _set_time(df, meta, p):
    return timeparse.set_time(df, p["column"], p["format"], p.get("offset_seconds", 0)), _with(meta, time=p["column"], time_format=p["format"])


@command("set_time_format")
def _format(df, meta, p):
    if len(p["format"]) > 64:
        raise ValueError("at most 64 characters")
    if not meta.time:
        raise ValueError("there is no time column")
    return df, _with(meta, time_format=p["format"])


@command("resample")
def _resample(df, meta, p):
    return resample.resample(df, meta.time, [c for c in df.columns if c not in ("pos", meta.time)], p["minutes"], p.get("method", "mean")), meta


@command("impute")
def _impute(df, meta, p):
    for t in p.get("targets", []):
        if df.where(names.col("pos").between(t["start"], t["end"]) & names.col(t["column"]).isNull()).isEmpty():
            raise ValueError(f"nothing is missing in {t['column']} from {t['start']} to {t['end']}")
        df = clean.impute(df, t["column"], t["algorithm"], t["start"], t["end"])
    if p.get("all"):
        df = clean.impute_all(df, p["all"])
    if p.get("dedupe"):
        df = clean.deduplicate(df, meta.time, p["dedupe"], [c for c, k in df.dtypes if k == "double"])
    return df, meta


@command("anomaly-repair")
def _repair(df, meta, p):
    for column in p["columns"]:
        df = anomaly.repair(anomaly.detect(df, column, p["method"], **p.get("options", {})), column, p["how"])
    return df, meta


@command("feature_calendar")
def _calendar(df, meta, p):
    df = features.calendar(df, meta.time, list(meta.holidays))
    parts = ("hour", "weekday", "month") if p.get("cyclical") is True else tuple(p.get("cyclical") or ())
    return (features.cyclical(df, meta.time, parts, p.get("keep", True)) if parts else df), meta


@command("feature_lag")
def _lag(df, meta, p):
    for c in p["columns"]:
        if p.get("lags"):
            df = features.lags(df, c, p["lags"])
        if p.get("windows"):
            df = features.rolling(df, c, p["windows"], p.get("stats", ["mean"]))
        if p.get("expanding"):
            df = features.expanding_mean(df, c)
        if p.get("ewmSpan"):
            df = features.ewm(df, c, p["ewmSpan"])
    return df, meta


@command("feature_diff")
def _diff(df, meta, p):
    for c in p["columns"]:
        df = features.differences(df, c, p.get("seasons", []))
    if p.get("fftDominant"):
        df = features.dominant(df, p["columns"][0])
    if p.get("spectral"):
        df = features.spectral(df, p["columns"][0])
    return df, meta


@command("feature_category")
def _category(df, meta, p):
    kind = p["kind"]
    if kind == "target":
        return features.target_mean(df, p["column"], p["target"]), meta
    return (features.one_hot if kind == "onehot" else features.ordinal)(df, p["column"]), meta


@command("exo-formula")
def _formula(df, meta, p):
    return align.formula_column(df, meta.time, p["name"], p["formula"]), meta


@command("exo-preset")
def _preset(df, meta, p):
    from ..sources import presets

    return presets.exogenous(df, meta.time, p["name"], p["seed"], temperature=p.get("temperature")), meta


@command("exo-file")
def _side(df, meta, p):
    from ..sources import io

    # the file is pinned by its content when the command is given, and must be the same when it is replayed
    io.check_content(p["path"], p.get("sha"))
    p["sha"] = io.content_sha(p["path"])
    side = io.read(df.sparkSession, p["path"])
    side = timeparse.set_time(side, p["time"], p["format"]) if p.get("format") else side
    wanted = p.get("columns") or ({p["column"]: p["name"]} if p.get("column") else io.variable_names([c for c in side.columns if c not in (p["time"], "pos")]))
    out, p["receipt"] = align.align_table(df, meta.time, side, p["time"], wanted, how=p.get("how", "exact"), tolerance=p.get("tolerance"))
    return out, meta


@command("repair")
def _pinned_repair(df, meta, p):
    """A repair by a detection that is made again; it must find as many anomalies and the same bounds as when it was recorded."""
    found = anomaly.detect(df, p["column"], p["method"], **p.get("options", {}))
    seen = list(found.agg(F.count_if("anomaly"), F.max("lower"), F.max("upper")).first())
    if p.get("found") not in (None, seen):
        raise StaleDetection(f"{p['column']}: recorded {p['found']}, now {seen}")
    p["found"] = seen
    return anomaly.repair(found, p["column"], p["how"]), meta


def _generated(before: DataFrame, base: DataFrame, after: DataFrame, meta: Meta, family: str) -> tuple[DataFrame, Meta, dict]:
    """The columns that a command generated are registered under its family; those of the family that it didn't generate again have gone."""
    made = [c for c in after.columns if c not in base.columns]
    if not made:
        raise ValueError("no column was generated")
    if len(made) > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} columns")
    gone = [c for c in before.columns if c not in base.columns and c not in made]
    kept = {c: f for c, f in meta.features.items() if c not in gone}
    return after, _with(meta, features=kept | dict.fromkeys(made, family)), {"family": family, "columns": made, "created": sum(c not in before.columns for c in made), "removed": gone}


class Workspace:
    def __init__(self, df: DataFrame, meta: Meta):
        self.versions: list[tuple[DataFrame, Meta]] = [(df, meta)]
        self.log: list[dict] = []
        #: What each command of the log reported.
        self.receipts: list[dict] = []
        self.cursor = 0
        self.detections: dict[str, tuple[int, DataFrame, dict]] = {}

    @classmethod
    def open(cls, df: DataFrame, time: str | None = None) -> Workspace:
        return cls(df, Meta(time=time))

    @property
    def df(self) -> DataFrame:
        return self.versions[self.cursor][0]

    @property
    def meta(self) -> Meta:
        return self.versions[self.cursor][1]

    def apply(self, kind: str, **params) -> Workspace:
        """One command more; what was undone is dropped only if it succeeds."""
        if kind not in COMMANDS:
            raise ValueError(f"unknown command: {kind}")
        before, meta, receipt = self.df, self.meta, {}
        if family := FAMILIES.get(kind):
            # the family's columns are made anew
            base = before.drop(*[c for c, f in meta.features.items() if f == family])
            df, meta = COMMANDS[kind](base, meta, params)
            df, meta, receipt = _generated(before, base, df, meta, family)
        else:
            df, meta = COMMANDS[kind](before, meta, params)
            receipt = params.pop("receipt", {})
        if kind == "set_time_format":
            receipt = {"changed": timeparse.changed_cells(df, meta.time, self.meta.time_format or timeparse.DISPLAY[0], meta.time_format)}
        return self._commit(df, meta, kind, params, receipt)

    def _commit(self, df: DataFrame, meta: Meta, kind: str, params: dict, receipt: dict) -> Workspace:
        if kind not in QUIET:
            meta = _with(meta, epoch=meta.epoch + 1)
        del self.versions[self.cursor + 1 :], self.log[self.cursor :], self.receipts[self.cursor :]
        self.versions.append((df, meta))
        self.log.append({"kind": kind, "params": params})
        self.receipts.append(receipt)
        self.cursor += 1
        return self

    def restore(self, version: int) -> Workspace:
        if not 0 <= version < len(self.versions):
            raise ValueError("no such version")
        self.cursor, self.detections = version, {}
        return self

    def undo(self) -> Workspace:
        return self.restore(max(0, self.cursor - 1))

    def redo(self) -> Workspace:
        return self.restore(min(len(self.versions) - 1, self.cursor + 1))

    def detect(self, column: str, method: str, **options) -> DataFrame:
        found = anomaly.detect(self.df, column, method, **options)
        self.detections[column] = (self.meta.epoch, found, {"method": method, "options": options})
        return found

    def repair(self, column: str, how: str) -> Workspace:
        """Repairs by the detection made last; refused if values changed since."""
        if column not in self.detections or self.detections[column][0] != self.meta.epoch:
            raise StaleDetection(column)
        _, found, by = self.detections[column]
        seen = list(found.agg(F.count_if("anomaly"), F.max("lower"), F.max("upper")).first())
        return self._commit(anomaly.repair(found, column, how), self.meta, "repair", {"column": column, "how": how, **by, "found": seen}, {"repaired": seen[0]})

    def stats(self, columns: list[str]) -> DataFrame:
        return stats.stats_matrix(self.df, columns)

    def page(self, offset: int = 0, limit: int = 50) -> DataFrame:
        return explore.page(self.df, offset, limit)

    def save_log(self) -> str:
        """All commands, and how many of them are in effect."""
        return json.dumps({"time": self.versions[0][1].time, "log": self.log, "cursor": self.cursor}, ensure_ascii=False)

    @classmethod
    def replay(cls, df: DataFrame, saved: str) -> Workspace:
        """The plans of a saved log, built again over df; what was undone can still be redone."""
        state = json.loads(saved)
        out = cls.open(df, state["time"])
        for step in state["log"]:
            out.apply(step["kind"], **step["params"])
        return out.restore(state.get("cursor", len(state["log"])))

    def save(self, path: str) -> None:
        """The log as a file, which is there whole or not at all."""
        write_whole(path, self.save_log())

    @classmethod
    def reopen(cls, df: DataFrame, path: str) -> Workspace:
        with open(path, encoding="utf-8") as f:
            return cls.replay(df, f.read())

    def script(self, path: str) -> str:
        """A Python program whose build(spark) reads the table at path and gives the frame as it is now."""
        steps = [f"    w.apply({step['kind']!r}, **{step['params']!r})" for step in self.log[: self.cursor]]
        head = ["from tidewright.plans.pipeline import Workspace", "from tidewright.sources import io", "", "", "def build(spark):", f"    w = Workspace.open(io.read(spark, {path!r}), {self.versions[0][1].time!r})"]
        return "\n".join([*head, *steps, "    return w.df", ""])


def write_whole(path: str, text: str) -> None:
    """A file that is there whole or not at all."""
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f"{path}.part", path)
