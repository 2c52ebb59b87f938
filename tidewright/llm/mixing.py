"""Mixing sources to target weights.

Tokens are added up per source, targets are set by weight under a ceiling, and each
document is repeated floor(rate) times plus one copy drawn by a hash of its id and text with the
rate's fraction as probability. Of n rows alike in id, source and text, which no hash can tell apart, the first
floor(n * fraction + 1 - draw) get the copy; for n = 1 that is the plain draw.

Defined cases: a null text has size 0; a null source is a source of its own, sorted last;
null and repeated ids draw by their texts; a source of size 0 has target 0; an empty table gives an empty result;
further columns pass through, and the columns added here replace others of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, numbered_copies, table

#: A table of targets with no more sources than this is sent to every executor; a larger one is joined by shuffle.
BROADCAST_SOURCES = 10_000


def draw(doc_id: str, digest: str, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of a keyed digest of id and text."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.col(digest)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, source: str, size: str, weights: Sequence[float], ceiling: float) -> DataFrame:
    """One row per source: source_size and target, the total shared by weight with no target above ceiling * size.

    Sharing the excess again until none is above the ceiling ends at one level L with
    target = min(ceiling * size, weight * L); it is found from prefix sums over the sources by
    ceiling * size / weight. Only this one-row-per-source table passes through an unpartitioned window.
    """
    per = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    all_rows = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fill = Window.orderBy("ratio", "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.desc("ratio"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("rank", rank).withColumn("weight", weight).withColumn("ratio", F.lit(ceiling) * F.col("source_size") / F.col("weight"))
    capped = F.coalesce(F.sum("source_size").over(before), F.lit(0))
    per = per.withColumn("level", (F.sum("source_size").over(all_rows) - F.lit(ceiling) * capped) / F.sum("weight").over(after))
    # the first source in filling order that stays under its ceiling sets the level for itself and all later ones
    per = per.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(all_rows)["level"])
    target = F.when(F.col("weight") * F.col("level") < F.lit(ceiling) * F.col("source_size"), F.col("weight") * F.col("level")).otherwise(F.lit(ceiling) * F.col("source_size"))
    return per.select("source", "source_size", target.cast("double").alias("target"))


def mix(df: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = (5, 2, 1), ceiling: float = 3.0, seed: str = "mix-1") -> DataFrame:
    """df with size, source_size, target, rate and copies, the number of times each document is taken."""
    sized = df.withColumns({"size": n_words(F.col(text)), "__digest": F.md5(F.coalesce(F.col(text), F.lit("")))})
    goal = targets(sized.select(F.col(source), "size"), source, "size", weights, ceiling)
    few = len(sized.select(source).distinct().limit(BROADCAST_SOURCES + 1).collect()) <= BROADCAST_SOURCES
    goal = goal.withColumnsRenamed({"source": "__source", "source_size": "__source_size", "target": "__target"})
    goal = F.broadcast(goal) if few else goal
    out = sized.join(goal, sized[source].eqNullSafe(goal["__source"]), "left")
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    out = out.withColumns({"source_size": F.col("__source_size"), "target": F.col("__target"), "rate": rate})
    whole = F.floor("rate").cast("int")
    out = numbered_copies(out.drop("__source", "__source_size", "__target"), [doc_id, source, "__digest"])
    drawn = F.floor(F.col("__n") * (F.col("rate") - whole) + (1 - draw(doc_id, "__digest", seed)))
    return out.withColumn("copies", whole + (F.col("__nth") <= drawn).cast("int")).drop("__n", "__nth", "__digest")


def emit(mixed: DataFrame) -> DataFrame:
    """The mixture itself: every document as many times as it is taken, numbered by copy."""
    return mixed.where(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM per
), weighed AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM ranked
), ratios AS (
  SELECT *, 3.0::DOUBLE * source_size / weight AS ratio FROM weighed
), levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - 3.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own
  FROM ratios
), level AS (
  SELECT own AS level FROM levels WHERE own <= ratio ORDER BY ratio, rank LIMIT 1
), goal AS (
  SELECT source, source_size, least(weight * level, 3.0::DOUBLE * source_size) AS target FROM levels LEFT JOIN level ON true
), drawn AS (
  SELECT s.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
         CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || digest), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS u,
         count(*) OVER (PARTITION BY doc_id, s.source, digest) AS n, row_number() OVER (PARTITION BY doc_id, s.source, digest) AS nth
  FROM sized s LEFT JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN nth <= floor(n * (rate - floor(rate)) + (1 - u)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM drawn
"""
