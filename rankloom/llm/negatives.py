"""Hard negatives by branch-and-bound over ball trees.

Anchors and candidates meet in cells, a block of anchors by a group of candidates.  The candidates
of a cell stream past its anchors in blocks, each a ball tree: a node's centre and radius bound
the inner product with an anchor above and below.  A node is left out for an anchor when its
labels cannot do, when its bounds lie outside the anchor's score windows, or when its upper bound
lies strictly beneath the k-th score found so far; the rest is scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored
from .topk import _EXACT, _whole, _widened, quantised, usable

LEAF = 128
BLOCK = 8192  # candidates of one tree
ANCHORS = 1 << 16  # anchors of a cell, about
GROUP = 1 << 22  # candidates of a cell, at most about
_AT_ONCE = 8192  # anchors that are scored against a leaf together
_FOUND = "key long, slot int, vec_id long, score long"


class BallTree:
    """Rows of one block in nodes; parents come before children, a leaf has no child (-1)."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(rows))
        self.start, self.stop, self.left, self.right, centres, self.radius, self.low, self.high = [], [], [], [], [], [], [], []
        todo = [(0, len(rows), -1, False)]
        while todo:
            a, b, parent, right = todo.pop()
            own, node = order[a:b], len(self.start)
            if parent >= 0:
                (self.right if right else self.left)[parent] = node
            points, of = rows[own], labels[own]
            centre = points.mean(axis=0)
            low, high = of.min(), of.max()
            for list_, x in ((self.start, a), (self.stop, b), (self.left, -1), (self.right, -1), (centres, centre), (self.radius, float(np.sqrt(((points - centre) ** 2).sum(axis=1).max()))), (self.low, low), (self.high, high)):
                list_.append(x)
            if b - a <= leaf:
                continue
            widths = points.max(axis=0) - points.min(axis=0) if points.shape[1] else np.zeros(1)
            if low == high and not widths.max() > 0:
                continue
            key = of if low < high else points[:, int(widths.argmax())]
            sort = np.argsort(key, kind="stable")
            order[a:b] = own[sort]
            middle = (b - a) // 2
            if low < high:  # labels part where one ends
                middle = int(np.searchsorted(key[sort], key[sort][middle])) or int(np.searchsorted(key[sort], key[sort][middle], "right"))
            todo += [(a + middle, b, node, True), (a, a + middle, node, False)]
        self.rows, self.ids, self.labels = rows[order], ids[order], labels[order]
        self.centres = np.array(centres)
        self.sizes = np.sqrt((self.centres ** 2).sum(axis=1)) + np.array(self.radius)


class Search:
    """The k best candidates of every anchor and slot, a slot being a score window; ties go to the smaller id."""

    def __init__(self, anchors: np.ndarray, ids: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.anchors, self.ids, self.labels, self.low, self.high, self.k, self.same = anchors, ids, labels, low, high, k, same
        self.bounds = low.astype(float), high.astype(float)
        self.best = np.full((*low.shape, k), -np.inf, low.dtype)
        self.found = np.full((*low.shape, k), np.iinfo(np.int64).max)
        self.scored = 0  # pairs

    def meet(self, tree: BallTree) -> None:
        width = max(self.anchors.shape[1], tree.rows.shape[1])
        self.anchors, rows, centres = _widened(self.anchors, width), _widened(tree.rows, width), _widened(tree.centres, width)
        exact = np.abs(self.anchors).sum(axis=1).max(initial=0) * np.abs(rows).max(initial=0) < _EXACT
        if not exact and self.best.dtype != object:
            self.best, self.low, self.high = self.best.astype(object), self.low.astype(object), self.high.astype(object)
        anchors = self.anchors if exact else _whole(self.anchors)
        rows = rows if exact else _whole(rows)
        norms = np.sqrt((self.anchors ** 2).sum(axis=1))
        todo = [(0, np.arange(len(self.ids)))]
        while todo:
            node, live = todo.pop()
            if self.same:
                live = live[(tree.low[node] <= self.labels[live]) & (self.labels[live] <= tree.high[node])]
            elif tree.low[node] == tree.high[node]:
                live = live[self.labels[live] != tree.low[node]]
            middle, reach = self.anchors[live] @ centres[node], norms[live] * tree.radius[node]
            slack = 1e-9 * norms[live] * tree.sizes[node] + 1e-6  # more than doubles may be off
            up, down = (middle + reach + slack)[:, None], (middle - reach - slack)[:, None]
            least, most = self.bounds[0][live], self.bounds[1][live]
            may = (up >= least) & (down <= most) & (least <= most) & (up >= self.best[live, :, -1].astype(float))
            stay = may.any(axis=1)
            live, may, middle = live[stay], may[stay], middle[stay]
            if not len(live):
                continue
            if tree.left[node] < 0:
                self._score(live, may, anchors, rows, tree, node)
                continue
            # Each anchor sees the nearer child first, so that its k-th score is high when the other comes.
            first, second = tree.left[node], tree.right[node]
            nearer = self.anchors[live] @ (centres[first] - centres[second]) >= 0
            todo += [(first, live[~nearer]), (second, live), (first, live[nearer])]

    def _score(self, live: np.ndarray, may: np.ndarray, anchors: np.ndarray, rows: np.ndarray, tree: BallTree, node: int) -> None:
        if len(live) > _AT_ONCE:
            for a in range(0, len(live), _AT_ONCE):
                self._score(live[a:a + _AT_ONCE], may[a:a + _AT_ONCE], anchors, rows, tree, node)
            return
        part = slice(tree.start[node], tree.stop[node])
        ids = tree.ids[part]
        scores = anchors[live] @ rows[part].T
        self.scored += scores.size
        fits = (tree.labels[part] == self.labels[live][:, None]) == self.same
        fits &= ids != self.ids[live][:, None]
        for slot in range(self.low.shape[1]):
            asked = np.flatnonzero(may[:, slot])
            at = live[asked]
            s = scores[asked]
            good = fits[asked] & (s >= self.low[at, slot][:, None]) & (s <= self.high[at, slot][:, None]) & (s >= self.best[at, slot, -1][:, None])
            good = good.astype(bool)
            if good.any() and s.dtype != object and s.shape[1] > self.k:  # no more than a leaf's own k best, and ties
                shown = np.where(good, s, -np.inf)
                good &= s >= np.partition(shown, s.shape[1] - self.k, axis=1)[:, [s.shape[1] - self.k]]
            r, c = np.nonzero(good)
            if len(r):
                self._keep(slot, at[r], s[r, c], ids[c])

    def _keep(self, slot: int, number: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(number)
        number = np.r_[number, np.repeat(touched, self.k)]
        score = np.concatenate([score, self.best[touched, slot].ravel()])
        ids = np.r_[ids, self.found[touched, slot].ravel()]
        order = np.argsort(ids, kind="stable")
        order = order[np.argsort(-score[order], kind="stable")]
        order = order[np.argsort(number[order], kind="stable")]
        number, score, ids = number[order], score[order], ids[order]
        place = np.arange(len(number)) - np.searchsorted(number, number)
        top = place < self.k
        self.best[number[top], slot, place[top]] = score[top]
        self.found[number[top], slot, place[top]] = ids[top]

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchor number, slot, id and score."""
        number, slot, place = np.nonzero((self.best > -np.inf).astype(bool))
        return number, slot, self.found[number, slot, place], self.best[number, slot, place]


def _matrix(table: pa.Table, scale: float) -> np.ndarray:
    """floor(scale x) of the vectors, filled with zeros to the width of the longest."""
    lists = table.column("vector").combine_chunks()
    widths = np.diff(lists.offsets.to_numpy())
    if len(widths) and (widths == widths[0]).all():
        return np.floor(scale * lists.flatten().to_numpy()).reshape(len(widths), widths[0])
    return quantised(lists.to_pylist(), scale)


def _windows(positives: list, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of each slot, whole numbers; a slot without a positive lets nothing through."""
    slots = max(map(len, positives), default=0)
    least, most = np.full((len(positives), slots), np.inf, object), np.full((len(positives), slots), -np.inf, object)
    for i, scores in enumerate(positives):
        for j, s in enumerate(scores):
            least[i, j], most[i, j] = -(-low * s // 100), high * s // 100
    wide = any(abs(s) >= _EXACT for scores in positives for s in scores)
    return (least, most) if wide else (least.astype(float), most.astype(float))


def _cells(batches: Iterator[pa.RecordBatch], scale: float, k: int, window: tuple[int, int] | None, block: int, leaf: int) -> Iterator[pa.RecordBatch]:
    """The cells of a task, each its anchors first and then its candidates."""
    cell, asked, search, waiting, many = None, [], None, [], 0

    def begin() -> Search:
        t = pa.Table.from_batches(asked)
        vectors = _matrix(t, scale)
        if window is None:
            low, high = np.full((len(vectors), 1), -np.inf), np.full((len(vectors), 1), np.inf)
        else:
            low, high = _windows(t.column("scores").to_pylist(), *window)
        return Search(vectors, t.column("vec_id").to_numpy(), t.column("label").to_numpy(), low, high, k, window is None)

    def meet() -> None:
        t = pa.Table.from_batches(waiting)
        search.meet(BallTree(_matrix(t, scale), t.column("label").to_numpy(), t.column("vec_id").to_numpy(), leaf))

    def end() -> pa.RecordBatch:
        key = pa.Table.from_batches(asked).column("key").to_numpy()
        number, slot, ids, score = search.results()
        score = [int(x) for x in score]
        if any(x.bit_length() > 63 for x in score):
            raise OverflowError("a score does not fit 64 bits: use a smaller scale")
        return pa.RecordBatch.from_arrays([pa.array(key[number]), pa.array(slot.astype(np.int32)), pa.array(ids), pa.array(score, pa.int64())], ["key", "slot", "vec_id", "score"])

    for batch in batches:
        cells, kinds = batch.column("cell").to_numpy(), batch.column("key").is_valid().to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds.astype(np.int8)) != 0)) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows]):
            if a == b:
                continue
            if cells[a] != cell:
                if many:
                    meet()
                if search is not None:
                    yield end()
                cell, asked, search, waiting, many = cells[a], [], None, [], 0
            if kinds[a]:
                asked.append(batch.slice(a, b - a))
                continue
            if not asked:
                continue  # candidates that nobody asks for
            search = search or begin()
            for first in range(a, b, block):
                waiting.append(batch.slice(first, min(block, b - first)))
                many += waiting[-1].num_rows
                if many >= block:
                    meet()
                    waiting, many = [], 0
    if many:
        meet()
    if search is not None:
        yield end()


def search(candidates: DataFrame, anchors: DataFrame, k: int, window: tuple[int, int] | None, scale: float, block: int, leaf: int, n_anchors: int, n_candidates: int, per_cell: int, per_group: int) -> DataFrame:
    """``(key, slot, rank, vec_id, score)``: each anchor's k best of its own label, or of others within its windows.

    Anchors are dealt by key to blocks, candidates by a hash of their id and vector to groups; a
    row goes once to each cell of its block or group, and a cell returns k rows for an anchor and slot.
    """
    spark = candidates.sparkSession
    blocks = max(1, -(-n_anchors // per_cell))
    groups = max(1, -(-n_candidates // per_group), min(spark.sparkContext.defaultParallelism, -(-n_candidates // block)))
    asked = anchors.withColumn("cell", F.explode(F.expr(f"transform(sequence(0, {groups - 1}), g -> cast(pmod(xxhash64(key), {blocks}) * {groups} + g as int))")))
    given = candidates.withColumn("cell", F.explode(F.expr(f"transform(sequence(0, {blocks - 1}), b -> cast(b * {groups} + pmod(xxhash64(vec_id, vector), {groups}) as int))")))
    given = given.withColumn("key", F.lit(None).cast("long")).withColumn("scores", F.lit(None).cast("array<long>"))
    if "scores" not in anchors.columns:
        asked = asked.withColumn("scores", F.lit(None).cast("array<long>"))
    both = asked.unionByName(given).repartitionById(blocks * groups, F.col("cell"))
    both = both.sortWithinPartitions("cell", F.col("key").isNull())
    found = both.mapInArrow(lambda it: _cells(it, scale, k, window, block, leaf), _FOUND)
    rank = F.row_number().over(Window.partitionBy("key", "slot").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100), scale: float = 256.0, block: int = BLOCK, leaf: int = LEAF, per_cell: int = ANCHORS, per_group: int = GROUP) -> DataFrame:
    """``vectors`` and ``anchors(vec_id, label, vector)`` to ``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Components are floor(scale * x), scores exact inner products.  An anchor's positives are its
    best rows of the same label and another id; the negatives of a positive are the best rows of
    other labels whose score is within ``window`` per cent of the positive's (of a negative
    positive's score, nothing is).  Ties go to the smaller id.  Rows with a null id or label, or a
    vector that is null or holds a null or non-finite component, take no part; shorter vectors are
    as if filled with zeros.  Labels are whole numbers.  Repeated candidates count apart; a
    repeated anchor (id, label and vector) is answered once.  Scores beyond 64 bits are an OverflowError.
    """
    def fit(df: DataFrame) -> DataFrame:
        good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))
        return df.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"))

    candidates = fit(vectors)
    asked = stored(fit(anchors).distinct().withColumn("key", F.monotonically_increasing_id()))  # stored: the keys stay
    sizes = asked.count(), candidates.count()
    own = stored(search(candidates, asked, positives, None, scale, block, leaf, *sizes, per_cell, per_group).select("key", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    scores = own.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))  # as many as there are positives
    found = search(candidates, asked.join(scores, "key"), negatives, window, scale, block, leaf, *sizes, per_cell, per_group)
    paired = found.select("key", "slot", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(own, ["key", "slot"])
    return paired.join(asked.select("key", F.col("vec_id").alias("anchor_id")), "key").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
