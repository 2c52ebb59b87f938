"""Sharding by sampled splitters, native.

Keys are drawn with probability in proportion to size, quantiles of the draw become range
boundaries, and records are range-partitioned by them; a range that holds far more than its
share is cut again by a draw of its own, until none does. Inside ranges, running sums of size give every
record its place on one line of bytes, which is then cut into shards of equal length
(law ``bytes``): two shards differ by less than the sizes of two records.

The key is (CRC-32, doc_id, digest of the text, number of the row), so equal texts lie together, yet a group of copies
larger than a range can be cut anywhere within, even between rows that are alike. The row's number is drawn once and written
with the row, so a lost executor doesn't change it.

Defined cases: a null text counts as empty (size 16, CRC 0); repeated rows get slots of their own in
any order, as they are alike; a null doc_id sorts with 0; an empty table gives an empty result; further columns are
kept by shard_rows(), whose own columns (size, text_crc32, shard, slot) replace others of the same name.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import or_empty, table, written

#: Bytes that a record takes beside its text.
OVERHEAD = 16
#: Keys drawn for each boundary; with the number of ranges this bounds what reaches the driver.
DRAWS = 64
#: A range is overfull beyond so many times its share.
OVERFULL = 2.0


def sized(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    body = or_empty(text)
    crc = F.crc32(body.cast("binary"))
    key = F.concat(F.lpad(F.hex(crc), 8, "0"), F.lpad(F.hex(F.coalesce(F.col(doc_id), F.lit(0))), 16, "0"), F.lpad(F.hex(F.xxhash64(body)), 16, "0"))
    return df.withColumns({"size": (F.octet_length(body) + OVERHEAD).cast("long"), "text_crc32": crc, "__key": key})


def _splitters(rows: DataFrame, total: Column, parts: Column, by: list[str], seed: int) -> DataFrame:
    """Boundaries for each group of `by`: quantiles of a draw of keys, each drawn with probability DRAWS * parts * size / total. Some DRAWS * parts keys are gathered."""
    u = F.pmod(F.xxhash64("__key", F.lit(seed)), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))
    drawn = rows.where(u < F.lit(float(DRAWS)) * parts * F.col("size") / total)
    keys = F.array_sort(F.collect_list("__key"))
    out = drawn.withColumn("parts", parts).groupBy(*by).agg(keys.alias("keys"), F.first("parts").alias("parts"))
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.col("parts") - 1, F.lit(1))), lambda i: F.get(F.col("keys"), F.floor(i * F.size("keys") / F.col("parts")).cast("int")))
    return out.select(*by, F.array_distinct(cut).alias("cuts"))


def ranges(rows: DataFrame, n_ranges: int) -> tuple[DataFrame, int]:
    """rows (with distinct keys) with __range (int, ordered as the keys are), none of them overfull unless a single record is; and the sum of sizes."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return rows.withColumn("__range", F.lit(0)), 0
    share = total / n_ranges
    cuts: list[str] = []
    found = _splitters(rows.withColumn("__g", F.lit(0)), F.lit(float(total)), F.lit(n_ranges), ["__g"], 17).collect()
    for row in found:
        cuts = sorted({c for c in row["cuts"] if c is not None})
    for seed in count(18):
        held = _ranged(rows, cuts).groupBy("__range").agg(F.sum("size").alias("held"), F.max("size").alias("most"))
        # a range of one record, or of one that is overfull itself and some that fit, is left
        over = held.where((F.col("held") > OVERFULL * share) & (F.col("held") - F.when(F.col("most") > share, F.col("most")).otherwise(0) > share)).collect()
        if not over:
            break
        # each round draws anew, so a range that got no boundary gets one in a later round
        inside = _ranged(rows, cuts).where(F.col("__range").isin([r["__range"] for r in over]))
        sums = F.create_map(*[F.lit(x) for r in over for x in (r["__range"], float(r["held"]))])
        parts = F.ceil(sums[F.col("__range")] / F.lit(share)).cast("int") + 1
        more = {c for row in _splitters(inside, sums[F.col("__range")], parts, ["__range"], seed).collect() for c in row["cuts"] if c is not None}
        cuts = sorted({*cuts, *more})
    return _ranged(rows, cuts), total


def _ranged(rows: DataFrame, cuts: list[str]) -> DataFrame:
    """The number of boundaries at or below the key, found in two steps of about sqrt(n) comparisons."""
    if not cuts:
        return rows.withColumn("__range", F.lit(0))
    step = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    heads = F.array(*[F.lit(b[0]) for b in blocks])
    block = F.size(F.filter(heads, lambda b: b <= F.col("__key")))
    inner = F.get(F.array(*[F.array(*[F.lit(c) for c in b]) for b in blocks]), F.col("__block") - 1)
    within = F.size(F.filter(inner, lambda b: b <= F.col("__key")))
    out = rows.withColumn("__block", block)
    return out.withColumn("__range", F.when(F.col("__block") == 0, 0).otherwise((F.col("__block") - 1) * step + within).cast("int")).drop("__block")


def shard_rows(df: DataFrame, n_shards: int, *, doc_id: str = "doc_id", text: str = "text", per_shard: int = 8) -> DataFrame:
    """df (as sized() gives it) with shard and slot. The rows are written twice, without the columns that the caller drops."""
    own = F.lpad(F.hex(F.xxhash64(F.monotonically_increasing_id())), 16, "0")
    rows = written(df.withColumn("__key", F.concat("__key", own)), "keyed")
    rows, total = ranges(rows, n_shards * per_shard)
    if not total:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).drop("__range", "__key")
    held = rows.groupBy("__range").agg(F.sum("size").alias("held"), F.count(F.lit(1)).alias("n"))
    # one row per range, n_shards * per_shard and a few more: the running sums over them fit one task
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(F.col("__range").alias("__r"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("__bytes"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__rows"))
    inside = Window.partitionBy("__range").orderBy("__key")
    sums = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.join(F.broadcast(held), F.col("__range") == F.col("__r")).drop("__r")
    middle = F.col("__bytes") + F.sum("size").over(sums) - F.col("size") / 2
    placed = placed.withColumns({"__at": middle, "__line": F.col("__rows") + F.row_number().over(inside) - 1})
    placed = placed.withColumn("shard", F.least(F.floor(F.col("__at") * n_shards / F.lit(total)), F.lit(n_shards - 1)).cast("int"))
    placed = written(placed.drop("__at", "__bytes", "__rows", "__range", "__key"), "sharded")
    first = placed.groupBy(F.col("shard").alias("__s")).agg(F.min("__line").alias("__first"))
    out = placed.join(F.broadcast(first), F.col("shard") == F.col("__s"))
    return out.withColumn("slot", (F.col("__line") - F.col("__first")).cast("long")).drop("__s", "__first", "__line")


def write_shards(sharded: DataFrame, path: str, n_shards: int) -> None:
    """One folder per shard, records in slot order."""
    sharded.repartitionByRange(n_shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = sized(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "__key")
    out = shard_rows(narrow, 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
