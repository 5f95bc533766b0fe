"""Exact top-k inner products by Fagin's threshold algorithm.

Queries go to the tasks in blocks of bounded size; candidates stay where they are and stream past
them in blocks.  A block has, for every dimension, its vectors in falling and in rising order.
All lists are read in step, in strides that double; every vector met is scored in full, and a
query is done with the block once its k-th score, that of earlier blocks included, beats the bound
(the score of a vector that would stand at the present place in each list) or no vector is unmet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

BLOCK, QUERIES = 8192, 1024  # candidates and queries that are compared at a time
SENT = 32_768  # queries that are sent to the tasks at a time, and come to the driver for that
_STEP = 32
_EXACT = float(1 << 53)


def usable(vector: Column) -> Column:
    """Neither null nor holding a null or non-finite component."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def quantised(vectors: list, scale: float) -> np.ndarray:
    """floor(scale x), filled with zeros to the width of the longest."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = np.floor(scale * np.asarray(v, np.float64))
    return out


def _widened(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.hstack([a, np.zeros((len(a), width - a.shape[1]))])


def _whole(a: np.ndarray) -> np.ndarray:
    """As Python's integers, for scores that doubles cannot hold exactly."""
    return np.array([[int(x) for x in row] for row in a], object).reshape(a.shape)


def threshold_top(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, row id and score of the k best rows of each query, rows of its own id and scores below ``least`` left out."""
    order = np.argsort(row_ids, kind="stable")  # ids rise with place, so ties go to the smaller place
    rows, row_ids = rows[order], row_ids[order]
    apart = row_ids != query_ids[:, None]
    if np.abs(queries).sum(axis=1).max(initial=0) * np.abs(rows).max(initial=0) >= _EXACT:
        queries, rows = _whole(queries), _whole(rows)
    n, width = rows.shape
    least = np.full(len(queries), -np.inf, rows.dtype) if least is None else least
    falling = [np.argsort(-rows[:, d], kind="stable") for d in range(width)]
    rising = [np.argsort(rows[:, d], kind="stable") for d in range(width)]
    seen = np.zeros((len(queries), n), bool)
    scores = np.full((len(queries), n), -np.inf, rows.dtype)
    live, depth, step, found = np.arange(len(queries)), 0, _STEP, []
    while len(live) and depth < n:
        stop = min(n, depth + step)
        q = queries[live]
        fresh, bound = np.zeros((len(live), n), bool), np.zeros(len(live), rows.dtype)
        for d in range(width):
            for lists, asking in ((falling[d], q[:, d] > 0), (rising[d], q[:, d] < 0)):
                asking = np.flatnonzero(asking)
                fresh[asking[:, None], lists[depth:stop]] = True
                bound[asking] += q[asking, d] * rows[lists[stop - 1], d]
        fresh[~(q != 0).any(axis=1), depth:stop] = True  # all scores are zero: any order is a list
        fresh &= ~seen[live]
        met = np.flatnonzero(fresh.any(axis=0))
        got = np.where(fresh[:, met] & apart[np.ix_(live, met)], q @ rows[met].T, scores[np.ix_(live, met)])
        scores[np.ix_(live, met)] = got
        seen[live] |= fresh
        own = scores[live]
        last = np.sort(own, axis=1)[:, n - k] if n >= k and own.dtype == object else np.partition(own, n - k, axis=1)[:, n - k] if n >= k else np.full(len(live), -np.inf)
        last = np.maximum(last, least[live])
        done = (last > bound).astype(bool) | seen[live].all(axis=1) | (stop == n)
        for i in np.flatnonzero(done):
            best = np.flatnonzero((own[i] >= last[i]) & (own[i] > -np.inf))
            best = best[np.argsort(-own[i, best], kind="stable")[:k]]
            found.append((np.full(len(best), live[i]), best, own[i, best]))
        live, depth, step = live[~done], stop, step * 2
    number, at, score = (np.concatenate([x[c] for x in found]) if found else np.zeros(0) for c in range(3))
    return number.astype(np.int64), row_ids[at.astype(np.int64)], score


class _Best:
    """The k best of each query over all blocks so far."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int):
        self.queries, self.ids, self.k = queries, ids, k
        self.number, self.row, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def meet(self, rows: np.ndarray, row_ids: np.ndarray) -> None:
        width = max(self.queries.shape[1], rows.shape[1])
        self.queries, rows = _widened(self.queries, width), _widened(rows, width)
        least = np.full(len(self.ids), -np.inf, object)
        full = np.flatnonzero(np.bincount(self.number, minlength=len(self.ids)) >= self.k) if len(self.number) else []
        if len(full):
            last = np.searchsorted(self.number, full, "right") - 1
            least[full] = self.score[last]
        news = [(self.number, self.row, self.score)]
        for a in range(0, len(self.ids), QUERIES):
            number, row, score = threshold_top(self.queries[a:a + QUERIES], self.ids[a:a + QUERIES], rows, row_ids, self.k, least[a:a + QUERIES])
            news.append((number + a, row, score))
        number, row, score = (np.concatenate([x[c] for x in news]) for c in range(3))
        order = np.argsort(row, kind="stable")
        order = order[np.argsort(-score[order], kind="stable")]
        order = order[np.argsort(number[order], kind="stable")]
        number, row, score = number[order], row[order], score[order]
        place = np.arange(len(number)) - np.searchsorted(number, number)
        self.number, self.row, self.score = (x[place < self.k] for x in (number, row, score))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, block: int = BLOCK, sent: int = SENT) -> DataFrame:
    """``vectors(vec_id, vector)`` and ``queries(query_id, vector)`` to ``(query_id, rank, vec_id, score)``.

    Components are floor(scale * x).  Candidates are all rows whose id is not the query's; of
    equal scores the smaller id comes first.  Vectors that are null or hold a null or non-finite
    component take no part; shorter vectors are as if filled with zeros.  Repeated candidate rows
    count apart; a repeated query (id and vector) is answered once.  Null ids take no part.
    Scores are exact; one beyond 64 bits among a query's best is an OverflowError.  Candidates
    are not shuffled: a task returns at most k rows for each query.
    """
    vectors = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"))
    queries = queries.where(F.col("query_id").isNotNull() & usable(F.col("vector"))).select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")).distinct()
    spark = vectors.sparkSession
    queries = stored(queries.withColumn("asked", F.xxhash64("vector")))
    parts = max(1, -(-queries.count() // (sent // 2)))  # by hash: some are larger than others
    schema = "query_id long, asked long, vec_id long, score long"

    def search(held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = held.value
            ids = asked.column("query_id").to_numpy()
            best = _Best(quantised(asked.column("vector").to_pylist(), scale), ids, k)
            waiting, many = [], 0

            def meet() -> None:
                rows = pa.Table.from_batches(waiting)
                best.meet(quantised(rows.column("vector").to_pylist(), scale), rows.column("vec_id").to_numpy())

            for batch in batches:
                for start in range(0, batch.num_rows, block):
                    waiting.append(batch.slice(start, block))
                    many += waiting[-1].num_rows
                    if many >= block:
                        meet()
                        waiting, many = [], 0
            if many:
                meet()
            score = [int(x) for x in best.score]
            if any(x.bit_length() > 63 for x in score):
                raise OverflowError("a score does not fit 64 bits: use a smaller scale")
            asked_of = asked.column("asked").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[best.number]), pa.array(asked_of[best.number]), pa.array(best.row, pa.int64()), pa.array(score, pa.int64())], schema=pa.schema([(c.split()[0], pa.int64()) for c in schema.split(", ")]))

        return vectors.mapInArrow(run, schema)

    found = None
    for part in range(parts):
        own = queries.where(F.pmod(F.xxhash64("query_id", "asked"), F.lit(parts)) == part).toArrow()  # at most about ``sent`` rows
        if own.num_rows:
            now = search(spark.sparkContext.broadcast(own))
            found = now if found is None else found.unionByName(now)
    if found is None:
        found = spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
