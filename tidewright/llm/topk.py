"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become sparse rows of integer weights by term (dimension). A block of queries of bounded size goes to every task;
each task holds its candidates in blocks as postings by term, scatters query weight times posting weight into a dense array
of scores, term after term, picks the best of a block by partition selection and merges them with those it has.
The tasks' winners, at most k for each query and task, are merged by a window over each query.

Defined cases: vectors that are null or hold null or non-finite components take no part; vectors of different lengths
meet in the terms that both have; equal scores rank by smaller id; an id that occurs in several rows is one query, by its smallest
vector, and no candidate of its own, while for other queries each row counts; null ids take no part; without
candidates a query has no rows; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Queries that are sent to the tasks at once, and that are scored against a block of candidates at once.
QUERY_BLOCK, TILE = 4096, 128
CANDIDATES = 4096
NONE = -(1 << 62)


def usable(vector: str) -> Column:
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def weights(vector: str) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")))


def _matrix(rows: list, dims: int):
    import numpy as np

    out = np.zeros((len(rows), dims), np.int64)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def _score(queries, postings, n: int, out):
    """Scores of all pairs: for each term the queries' weights times the posting list, added where it points."""
    import numpy as np

    out[:] = 0
    for t, (ids, w) in enumerate(postings):
        q = queries[:, t]
        rows = np.flatnonzero(q)
        if len(ids) == n and len(rows) == len(q):
            out += q[:, None] * w
        elif len(ids) and len(rows):
            out[np.ix_(rows, ids)] += q[rows, None] * w
    return out


def _best(ids, scores, k: int):
    """The k best of each row, equal scores by smaller id, best first."""
    import numpy as np

    order = np.lexsort((ids, -scores), axis=-1)[:, :k]
    return np.take_along_axis(ids, order, -1), np.take_along_axis(scores, order, -1)


def _block(queries, query_ids, vectors, ids, k: int):
    """(ids, scores) of each query's k best in one block of candidates."""
    import numpy as np

    by_id = np.argsort(ids, kind="stable")
    ids, vectors = ids[by_id], vectors[by_id]
    n, size = len(ids), min(k, len(ids))
    postings = [(np.flatnonzero(c), c[c != 0]) for c in vectors.T]
    top_ids, top = np.full((len(queries), k), -1, np.int64), np.full((len(queries), k), NONE, np.int64)
    for at in range(0, len(queries), TILE):
        scores = _score(queries[at : at + TILE], postings, n, np.empty((len(queries[at : at + TILE]), n), np.int64))
        scores[query_ids[at : at + TILE, None] == ids] = NONE
        if np.abs(np.where(scores == NONE, 0, scores)).max(initial=0) < (1 << 49):
            # place in the block breaks ties, so that the partition has one answer
            key = np.where(scores == NONE, NONE, scores * CANDIDATES + (CANDIDATES - 1 - np.arange(n)))
            pick = np.argpartition(key, n - size, axis=1)[:, n - size :]
        else:
            pick = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=-1)[:, :size]
        top_ids[at : at + TILE, :size] = ids[pick]
        top[at : at + TILE, :size] = np.take_along_axis(scores, pick, 1)
    return top_ids, top


def _searcher(shared, k: int):
    def search(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        query_ids, queries = shared.value
        best_ids, best = np.full((len(queries), k), -1, np.int64), np.full((len(queries), k), NONE, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, CANDIDATES):
                part = batch.slice(at, CANDIDATES)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                column = part.column(1)
                rows = np.split(column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))[:-1])
                dims = max(queries.shape[1], max(map(len, rows)))
                wide = np.pad(queries, ((0, 0), (0, dims - queries.shape[1])))
                found_ids, found = _block(wide, query_ids, _matrix(rows, dims), ids, k)
                best_ids, best = _best(np.hstack((best_ids, found_ids)), np.hstack((best, found)), k)
        rows, places = np.nonzero(best != NONE)
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[rows]), pa.array(best_ids[rows, places]), pa.array(best[rows, places])], ["query_id", "vec_id", "score"])

    return search


def search(queries: DataFrame, candidates: DataFrame, k: int, *, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query by integer inner product."""
    import numpy as np

    spark = candidates.sparkSession
    rows = candidates.where(usable(vector) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), weights(vector).alias("w"))
    asked = queries.where(usable(vector) & F.col(vec_id).isNotNull()).groupBy(F.col(vec_id).cast("long").alias("vec_id")).agg(F.min(weights(vector)).alias("w"))
    stream, found = asked.toLocalIterator(), []
    while block := list(islice(stream, QUERY_BLOCK)):
        matrix = _matrix([r["w"] for r in block], max(len(r["w"]) for r in block))
        shared = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in block], np.int64), matrix))
        part = rows.mapInArrow(_searcher(shared, k), "query_id long, vec_id long, score long")
        found.append(written(part, "found"))
        shared.destroy()
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = found[0]
    for part in found[1:]:
        out = out.union(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors.where("vec_id % 50 = 0"), vectors, 5)


ORACLE = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256.0::DOUBLE * x::DOUBLE) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""
