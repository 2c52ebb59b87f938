"""What several operators share: the word rule and tables written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but space and the five ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine's only where the session names none and runs on this machine alone."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """The same rows from a table in the shared folder: computed once, lineage cut, safe from lost executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def numbered_copies(df: DataFrame, by: list[str]) -> DataFrame:
    """df with __n, how many rows are alike in `by`, and __nth, the place of each among them from 1. Only rows that are not alone are shuffled;
    they are counted in parts, so a group may hold any share of the rows. Rows that are alike in everything may be numbered in any order."""
    keys = [f"__by{i}" for i in range(len(by))]
    groups = df.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    if groups.isEmpty():
        return df.withColumns({"__n": F.lit(1).cast("long"), "__nth": F.lit(1).cast("long")})
    groups = written(groups, "repeated")
    same = lambda other: [F.col(c).eqNullSafe(other[k]) for c, k in zip(by, keys, strict=True)]
    alone = df.join(groups, same(groups), "left_anti").withColumns({"__n": F.lit(1).cast("long"), "__nth": F.lit(1).cast("long")})
    part = F.pmod(F.monotonically_increasing_id(), F.lit(64)).cast("int")
    rows = written(df.join(groups, same(groups)).drop(*keys).withColumn("__part", part), "copies")
    sizes = rows.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col("__part").alias("__p")).agg(F.count(F.lit(1)).alias("__m"))
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__m").over(before), F.lit(0))).drop("__m")
    inside = Window.partitionBy(*by, "__part").orderBy(F.lit(0))
    rows = rows.withColumn("__nth", F.row_number().over(inside).cast("long")).join(sizes, [*same(sizes), F.col("__part") == F.col("__p")])
    rows = rows.withColumn("__nth", F.col("__nth") + F.col("__before"))
    return alone.unionByName(rows.select(*alone.columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
