"""Packing by optimal length buckets.

The global histogram of lengths is brought down to at most a few ten thousand classes; dynamic programming over it chooses
the bucket boundaries that need the least padding. Inside a bucket all documents are padded to its boundary, so a batch
holds floor(budget / boundary) of them (one at least), and the n-th document of a bucket belongs to batch n div that number.
n is counted in two steps, inside salted parts of a bucket and by sums over the parts, so a hot bucket isn't one task.

Lengths up to EXACT are classes of their own; longer ones are rounded up to 10 significant bits, for the choice of boundaries only: a
bucket is padded to the longest document in it, so the padding is the least there is up to EXACT and, beyond, exceeds it by under 0.2 % of the
longer documents' lengths. A document longer than the budget is a batch of its own: none is cut or dropped.

Defined cases: a null text has length 1, its end token; equal lengths are ordered by salt and id; repeated rows are packed like any others; an empty
table gives an empty result; further columns pass through, and those added here replace others of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, table, written

BUCKETS, BUDGET = 16, 32_768
EXACT = 16_384
BITS = 10
#: Salted parts of each bucket: so many at least, and one for so many documents, as one bucket may hold them all.
PARTS, PART_ROWS = 64, 1_000_000
#: A table of the parts' sizes with no more rows than this is sent to every executor; a larger one is joined by shuffle.
BROADCAST_PARTS = 100_000


def length_class(length: Column) -> Column:
    """The length itself up to EXACT, beyond that the next number of BITS significant bits."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length, F.lit(1)))) - (BITS - 1)).cast("long")
    return F.when(length <= EXACT, length).otherwise(F.ceil(length / step).cast("long") * step)


def boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper bounds of at most so many buckets with the least total padding, for (length, count) pairs.

    best[j] = min over i < j of old[i] + length[j] * (count[j] - count[i]) - (sum[j] - sum[i]) is a minimum of lines in length[j]
    whose slopes fall with i, so each bucket more takes one pass over a convex hull.
    """
    hist = sorted(histogram)
    n = len(hist)
    counts, sums = [0], [0]
    for length, count in hist:
        counts.append(counts[-1] + count)
        sums.append(sums[-1] + length * count)
    best: list[int | None] = [0] + [None] * n
    choice: list[list[int]] = []
    for _ in range(min(buckets, n)):
        hull: list[tuple[int, int, int]] = []
        at, new, came = 0, [None] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            if best[j - 1] is not None:
                line = (-counts[j - 1], best[j - 1] + sums[j - 1], j - 1)
                while len(hull) > 1 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                    hull.pop()
                hull.append(line)
            if not hull:
                continue
            x = hist[j - 1][0]
            at = min(at, len(hull) - 1)
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            new[j] = hull[at][0] * x + hull[at][1] + x * counts[j] - sums[j]
            came[j] = hull[at][2]
        best = new
        choice.append(came)
    out, j = [], n
    for came in reversed(choice):
        if j == 0:
            break
        out.append(hist[j - 1][0])
        j = came[j]
    return sorted(out)


def pack(sized: DataFrame, length: str, *, doc_id: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """sized with bucket, bucket_length, batch_id ("bucket-number"), slot and padding."""
    spark, sized = sized.sparkSession, sized.withColumn("__class", length_class(F.col(length)))
    histogram = [(r["__class"], r["n"]) for r in sized.groupBy("__class").agg(F.count(F.lit(1)).alias("n")).collect()]
    bounds = boundaries(histogram, buckets) or [1]
    limits = F.array(*[F.lit(b).cast("long") for b in bounds])
    bucket = F.size(F.filter(limits, lambda b: b < F.col("__class")))
    n_parts = max(PARTS, sum(n for _, n in histogram) // PART_ROWS)
    part = F.pmod(F.xxhash64(doc_id, length), F.lit(n_parts)).cast("int")
    out = sized.withColumn("bucket", bucket).withColumn("__part", part)
    # a row for each part comes to the driver
    parts = sorted(out.groupBy("bucket", "__part").agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("top")).collect())
    tops, before, rows = [1] * len(bounds), [0] * len(bounds), []
    for b, p, n, top in parts:
        rows.append((b, p, before[b]))
        before[b], tops[b] = before[b] + n, max(tops[b], top)
    sizes = spark.createDataFrame(rows, "__b int, __p int, __before long")
    capacity = F.array(*[F.lit(max(1, budget // t)).cast("long") for t in tops])
    out = out.withColumn("bucket_length", F.get(F.array(*[F.lit(t).cast("long") for t in tops]), F.col("bucket")))
    inside = Window.partitionBy("bucket", "__part").orderBy(F.col(doc_id), F.col(length))
    out = out.withColumn("__rn", F.row_number().over(inside) - 1)
    out = out.join(F.broadcast(sizes) if len(rows) <= BROADCAST_PARTS else sizes, (F.col("bucket") == F.col("__b")) & (F.col("__part") == F.col("__p")))
    nth, room = F.col("__before") + F.col("__rn"), F.get(capacity, F.col("bucket"))
    out = out.withColumns({"batch_id": F.concat_ws("-", "bucket", F.floor(nth / room)), "slot": (nth % room).cast("int"), "padding": F.col("bucket_length") - F.col(length)})
    return out.drop("__class", "__part", "__b", "__p", "__before", "__rn")


def batches(packed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per batch with its documents in order; a batch is bounded by the budget."""
    return packed.groupBy("batch_id", "bucket", "bucket_length").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", doc_id))), lambda x: x[doc_id]).alias("doc_ids"))


def packed_documents(docs: DataFrame) -> DataFrame:
    """The documents with their places; the length is the number of words and one end token."""
    return pack(docs.withColumn("n_tokens", n_words(F.col("text")) + 1), "n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", (n_words(F.col("text")) + 1).alias("n_tokens"))
    return pack(written(sized, "lengths"), "n_tokens")
