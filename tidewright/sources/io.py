"""Reading and writing tables by extension."""

from __future__ import annotations

import csv
import hashlib
import os
import re
import shutil
import tempfile
import uuid
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import col
from ..functions.numeric import number
from ..plans.order import numbered

# Encodings that are tried, in order
ENCODINGS = ("utf-8-sig", "utf-8", "gbk", "gb18030")
# Texts that stand for a missing value in text files
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# Text files by extension; all of them are separated by commas
TEXT = (".csv", ".tsv", ".txt")


def unique_names(names: list[str]) -> list[str]:
    """Stripped; blanks are named unnamed; repeats get _1, _2 and so on."""
    out: list[str] = []
    taken: set[str] = set()
    last: dict[str, int] = {}
    for name in (n.strip() or "unnamed" for n in names):
        k, new = last.get(name, 0), name
        while new in taken:
            k += 1
            new = f"{name}_{k}"
        last[name] = k
        taken.add(new)
        out.append(new)
    return out


def clean(df: DataFrame, missing: tuple[str, ...] = ("",)) -> DataFrame:
    """Texts stripped, blank ones and numbers that aren't finite NULL; in text files those that stand for a missing value too."""
    made = {}
    for name, kind in df.dtypes:
        c = col(name)
        if kind == "string":
            made[name] = F.when(~F.trim(c).isin(*missing), F.trim(c))
        elif kind in ("double", "float"):
            made[name] = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    return df.withColumns(made) if made else df


def _scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='shared-')}"
    return f"{at.rstrip('/')}/text-{uuid.uuid4().hex}"


def _decoded(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a file that isn't UTF-8, in the first encoding that all of them allow. In GBK no byte of a character but the line feed looks like one."""
    lines = spark.read.text(path).select(F.col("value").cast("binary").alias("raw"))

    def reader(encoding: str, errors: str):
        def decode(raw: pd.Series) -> pd.Series:
            return raw.map(lambda x: _decode(x, encoding, errors))

        return F.pandas_udf(decode, "string")

    for encoding in ENCODINGS[2:]:
        if lines.where(reader(encoding, "none")("raw").isNull()).isEmpty():
            return lines.select(reader(encoding, "strict")("raw").alias("value"))
    raise ValueError(f"{path} is in none of the encodings {', '.join(ENCODINGS)}")


def _decode(raw: bytes, encoding: str, errors: str) -> str | None:
    try:
        return raw.decode(encoding)
    except UnicodeDecodeError:
        if errors == "strict":
            raise
        return None


def _text_frame(spark: SparkSession, path: str) -> DataFrame:
    """A text file with a header. Its encoding is judged by all its lines, and it is split between tasks unless a quoted cell holds a line feed."""
    lines = spark.read.text(path)
    quotes = F.regexp_count(F.col("value"), F.lit('"'))
    wrong, open_ = lines.agg(F.count_if(~F.is_valid_utf8("value")), F.count_if(quotes % 2 == 1)).first()
    options = {"inferSchema": True, "multiLine": open_ > 0, "escape": '"'}
    if not wrong:
        df = spark.read.csv(path, header=True, encoding="UTF-8", **options)
    else:
        decoded = _decoded(spark, path)
        head = decoded.first()["value"]
        names = unique_names(next(csv.reader([head])))
        at = _scratch(spark)
        # the file's first line is the first of its first partition
        decoded.withColumn("id", F.monotonically_increasing_id()).where("id > 0").select("value").write.text(at)
        df = spark.read.csv(at, header=False, **options)
        df = df.toDF(*names) if df.columns else df
    df = df.toDF(*unique_names([n.removeprefix("\ufeff") for n in df.columns]))
    df = clean(df, MISSING)
    # a column is numeric if all its cells but missing ones are
    texts = [c for c, kind in df.dtypes if kind == "string"]
    if texts:
        counts = df.agg(*[f for c in texts for f in (F.count(col(c)), F.count(col(c).try_cast("double")))]).first()
        numeric = [c for i, c in enumerate(texts) if counts[2 * i] and counts[2 * i] == counts[2 * i + 1]]
        df = df.withColumns({c: col(c).try_cast("double") for c in numeric}) if numeric else df
    return df


def _feather(spark: SparkSession, path: str) -> DataFrame:
    """A file of Arrow batches, each read by the task that it falls to; the driver sees the schema only. Files of the first version have no batches and
    pass through the driver."""
    import pyarrow as pa
    import pyarrow.feather
    from pyspark.sql.pandas.types import to_arrow_schema

    try:
        with pa.OSFile(path) as f:
            reader = pa.ipc.open_file(f)
            n, empty = reader.num_record_batches, reader.schema.empty_table()
    except pa.ArrowInvalid:
        return spark.createDataFrame(pyarrow.feather.read_table(path))
    plain = pa.schema([(x.name, x.type.value_type if pa.types.is_dictionary(x.type) else x.type) for x in empty.schema])
    schema = spark.createDataFrame(empty.cast(plain)).schema
    kinds = to_arrow_schema(schema).types

    def load(batches):
        for batch in batches:
            with pa.OSFile(path) as f:
                held = pa.ipc.open_file(f)
                for i in batch.column(0).to_pylist():
                    one = held.get_batch(i)
                    yield pa.RecordBatch.from_arrays([c.cast(k, safe=False) for c, k in zip(one.columns, kinds, strict=True)], plain.names)

    # tasks take batches in order, so positions are those of the file
    return spark.range(0, n, 1, max(1, min(n, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(load, schema)


def read(spark: SparkSession, path: str, pos: str | None = "pos") -> DataFrame:
    """A table with clean cells, unique names and row positions."""
    kind = os.path.splitext(path)[1].lower()
    if kind == ".parquet":
        df = spark.read.parquet(path)
    elif kind in (".feather", ".ft", ".arrow"):
        df = _feather(spark, path)
    elif kind in (".xlsx", ".xls"):
        df = spark.createDataFrame(pd.read_excel(path))  # needs openpyxl, or xlrd for .xls
    else:
        df = _text_frame(spark, path)
    df = clean(df.toDF(*unique_names(df.columns)))
    return df if pos is None else with_positions(df, pos)


def with_positions(df: DataFrame, pos: str = "pos") -> DataFrame:
    """Dense positions in the order of the files, by counts per partition."""
    marked = df.withColumn("__id", F.monotonically_increasing_id())
    return numbered(marked, [F.col("__id")], F.shiftright("__id", 33), pos).drop("__id")


def write(df: DataFrame, path: str, kind: str, *, time: str | None = None, template: str | None = None) -> None:
    """A dataset as parquet or csv; a single file as feather or xlsx. Nothing is overwritten."""
    from ..operators.timeparse import render

    if time and template:
        df = df.withColumn(time, render(col(time), template))
    if kind == "parquet":
        df.write.mode("errorifexists").parquet(path)
    elif kind == "csv":
        df.write.mode("errorifexists").csv(path, header=True)
    elif kind == "csv-file":
        # one file for spreadsheets, with a byte order mark, row by row
        with open(path, "x", encoding="utf-8-sig", newline="") as f:
            rows = csv.writer(f)
            rows.writerow(df.columns)
            rows.writerows(df.toLocalIterator())
    elif kind == "feather":
        _write_feather(df, path)
    elif kind == "xlsx":
        df.toPandas().to_excel(path, index=False)
    else:
        raise ValueError(f"unknown kind: {kind}")


def _write_feather(df: DataFrame, path: str, rows: int = 65_536) -> None:
    """One file, a batch of rows after the other."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.schema)
    with open(path, "xb") as f, pa.ipc.new_file(f, schema) as out:
        stream = df.toLocalIterator()
        while part := list(islice(stream, rows)):
            out.write_batch(pa.RecordBatch.from_pylist([r.asDict(recursive=True) for r in part], schema))


def codecs() -> dict[str, bool]:
    """Which kinds can be written here."""
    import importlib.util

    return {"csv": True, "parquet": True, "feather": importlib.util.find_spec("pyarrow") is not None, "xlsx": importlib.util.find_spec("openpyxl") is not None}


def datasets(folder: str) -> list[str]:
    known = (*TEXT, ".parquet", ".feather", ".ft", ".xlsx")
    return sorted(x for x in os.listdir(folder) if x.lower().endswith(known))


def free_name(folder: str, name: str, stamp: str) -> str:
    """A path inside the folder that nothing has yet; names can't lead out of it."""
    if not re.fullmatch(r"[^/\\\0]+", name) or name.startswith("."):
        raise ValueError(f"bad name: {name}")
    stem, kind = os.path.splitext(name)
    at, k = os.path.join(folder, name), 0
    while os.path.exists(at):
        k += 1
        at = os.path.join(folder, f"{stem}__{stamp}{f'_{k}' if k > 1 else ''}{kind}")
    return at


def open_dataset(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder by its name."""
    if name not in datasets(folder):
        raise FileNotFoundError(name)
    return read(spark, os.path.join(folder, name))


def save_dataset(df: DataFrame, folder: str, name: str, stamp: str, **options) -> str:
    """Writes a table into the folder under a name that nothing has yet, and tells which."""
    at = free_name(folder, name, stamp)
    write(df, at, {".parquet": "parquet", ".feather": "feather", ".xlsx": "xlsx"}.get(os.path.splitext(at)[1].lower(), "csv"), **options)
    return at


class ContentChanged(ValueError):
    """A file is no longer the one that was recorded."""


def content_sha(path: str) -> str:
    """The first 16 digits of the SHA-256 of a file, or of the sorted files of a folder."""
    files = sorted(os.path.join(at, x) for at, _, names in os.walk(path) for x in names) if os.path.isdir(path) else [path]
    digest = hashlib.sha256()
    for name in files:
        with open(name, "rb") as f:
            while part := f.read(1 << 20):
                digest.update(part)
    return digest.hexdigest()[:16]


def check_content(path: str, expected: str | None) -> None:
    if expected and content_sha(path) != expected:
        raise ContentChanged(f"{path} has changed since it was recorded with {expected}")


def inspect(spark: SparkSession, path: str) -> dict:
    """What a side table offers: for each column the name it would get (none if it needs one by hand, with the reason), whether it holds numbers and whether
    it is the time; and how many could be taken over."""
    from ..operators.timeparse import pick_time_column

    df = read(spark, path, None)
    time, form, _ = pick_time_column(df)
    held = df.agg(F.count(F.lit(1)), *[F.count(number(col(c))) if k not in ("timestamp", "timestamp_ntz", "date") else F.lit(0) for c, k in df.dtypes]).first()
    columns, used = [], set()
    for (name, _), n in zip(df.dtypes, held[1:], strict=True):
        key = "" if name == time else variable_name(name) if re.search(r"[A-Za-z0-9]", name) else ""
        reason = "" if name == time else "not ASCII" if not name.isascii() else "no letter or digit" if not key else "name is taken" if key in used else ""
        if key and not reason:
            used.add(key)
        columns.append({"from": name, "key": key if key and not reason else None, "numeric": n > 0, "time": name == time, "needsName": bool(reason), "reason": reason})
    return {"rows": held[0], "columns": columns, "time": time, "format": form, "sha": content_sha(path), "importable": sum(c["numeric"] and not c["time"] for c in columns)}


def content_name(path: str) -> str:
    """<stem>__<first 12 digits of the SHA-256><extension>."""
    with open(path, "rb") as f:
        digest = hashlib.file_digest(f, "sha256").hexdigest()
    stem, kind = os.path.splitext(os.path.basename(path))
    return f"{stem}__{digest[:12]}{kind}"


SIDE_FOLDER = "_exo"


def store_side(folder: str, path: str) -> str:
    """Copies a side table into the dataset folder's own place for them, named by its content: equal files are one, and a changed one leaves the
    old there for logs that refer to it."""
    at = os.path.join(folder, SIDE_FOLDER, content_name(path))
    if not os.path.exists(at):
        os.makedirs(os.path.dirname(at), exist_ok=True)
        shutil.copyfile(path, f"{at}.part")
        os.replace(f"{at}.part", at)
    return at


def side_tables(folder: str) -> list[str]:
    at = os.path.join(folder, SIDE_FOLDER)
    return datasets(at) if os.path.isdir(at) else []


def variable_name(header: str) -> str:
    """An ASCII name for a header: letters, digits and underscores, 64 at most, starting with a letter; empty if nothing is left."""
    out = re.sub(r"_+", "_", re.sub(r"[^A-Za-z0-9_]", "_", header)).strip("_")
    return (out if re.match(r"[A-Za-z]", out) else f"c_{out}")[:64] if out else ""


def variable_names(headers: list[str]) -> dict[str, str]:
    """Names for headers; refused if one isn't ASCII, leaves no name or has that of another."""
    made = {h: variable_name(h) for h in headers}
    bad = [h for h in headers if not h.isascii() or not made[h] or list(made.values()).count(made[h]) > 1]
    if bad:
        raise ValueError(f"these need names by hand: {', '.join(bad)}")
    return made
