"""SimHash near-duplicates through a hierarchical index in Gray order.

Fingerprints (not documents) are indexed.  Two fingerprints within three bits agree on at
least one of four 16-bit segments, so a fingerprint goes to four coarse nodes, one for each
segment that is masked to the front.  Inside a node the fingerprints are sorted by Gray rank;
upper nodes hold the bits that all their members share (the masked pattern), and a pair of
nodes is pruned as soon as the differences of the shared bits exceed the threshold.  A coarse
node above ``node_limit`` members is factored again, by four segments of the bits left, as often
as it takes; nothing is dropped.
A task returns a spanning forest of the links it finds, so output is linear in its input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import broadcast_if_small, cut, divided, give_back, stored

SEED = 42
_LEAF = 8
_FRONTIER = 1 << 18
_ROWS = 1 << 20  # members that a task indexes at a time, and one node more
HOT = 100_000  # documents of one fingerprint


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash; no words give zero, fewer than ``shingle`` words one shingle of all."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII space
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    stops = (ends - 1).tolist()
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hashed(joined, SEED)
    stops = stops[shingle - 1:]
    counts = np.zeros(64, np.int64)
    for k in range(0, len(stops), 1 << 16):
        part = [hashed(joined[a:b], SEED) for a, b in zip(starts[k:k + (1 << 16)], stops[k:k + (1 << 16)])]
        bits = np.unpackbits(np.array(part, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(stops), bitorder="little").view(np.uint64)[0])


def _print_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])
    give_back()


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, fp)``, fp the fingerprint's 64 bits as a signed long."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(lambda it: _print_batches(it, shingle), "doc_id long, fp long")


# ---------------------------------------------------------------- the index, inside a task


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each value in the reflected Gray sequence."""
    rank = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class _Forest:
    """Union-find over 0..n-1 for whole arrays of links."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            over = self.parent[up]
            if np.array_equal(up, over):
                return up
            self.parent[x] = over
            x = over

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


class GrayIndex:
    """Fingerprints of many coarse nodes, sorted by Gray rank in each, under levels of masked patterns."""

    def __init__(self, node: np.ndarray, value: np.ndarray):
        order = np.lexsort((gray_rank(value), node))
        self.value, node = value[order], node[order]
        self.first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, np.int64)
        self.size = np.diff(np.r_[self.first, len(node)])
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # start, stop, all-ones, any-ones
        self.at: list[np.ndarray] = []  # by level: index of each coarse node's first entry
        width = _LEAF
        while len(node):
            many = -(-self.size // width)
            base = np.r_[0, np.cumsum(many)[:-1]]
            local = np.arange(many.sum()) - np.repeat(base, many)
            start = np.repeat(self.first, many) + local * width
            stop = np.minimum(start + width, np.repeat(self.first + self.size, many))
            self.levels.append((start, stop, np.bitwise_and.reduceat(self.value, start), np.bitwise_or.reduceat(self.value, start)))
            self.at.append(base)
            if many.max() == 1:
                break
            width *= 2
        self.depth = np.zeros(len(self.size), np.int64)
        for i in range(len(self.levels)):
            self.depth[-(-self.size // (_LEAF << i)) > 1] = i + 1

    def forest(self, bits: int) -> _Forest:
        """Link all members of a coarse node that differ in at most ``bits`` bits."""
        found = _Forest(len(self.value))
        work = []
        for level in range(len(self.levels)):
            root = self.at[level][self.depth == level]
            root = root[self.levels[level][1][root] - self.levels[level][0][root] > 1]
            if len(root):
                work.append((level, root, root))
        while work:
            level, a, b = work.pop()
            if len(a) > _FRONTIER:
                half = len(a) // 2
                work += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
                continue
            start, stop, ones, some = self.levels[level]
            # differences that any two members must have: accumulated from the masked patterns
            keep = np.bitwise_count((ones[a] & ~some[b]) | (ones[b] & ~some[a])) <= bits
            a, b = a[keep], b[keep]
            near = np.bitwise_count((some[a] | some[b]) & ~(ones[a] & ones[b])) <= bits  # no two members differ in more
            self._chain(found, start[a[near]], stop[a[near]], start[b[near]], stop[b[near]])
            a, b = a[~near], b[~near]
            if not len(a):
                continue
            if level == 0:
                self._leaves(found, start[a], stop[a], start[b], stop[b], bits)
            else:
                work.append((level - 1, *self._below(level, a, b)))
        return found

    def _below(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, stop = self.levels[level][:2]
        below = self.levels[level - 1][0]
        x, y = np.searchsorted(below, start[a]), np.searchsorted(below, start[b])  # a child starts where its parent does
        two_a, two_b = (stop[k] - start[k] > _LEAF << (level - 1) for k in (a, b))
        pairs = [(x, y, np.ones(len(a), bool)), (x, y + 1, two_b), (x + 1, y, two_a & (a != b)), (x + 1, y + 1, two_a & two_b)]
        return np.concatenate([u[m] for u, _, m in pairs]), np.concatenate([v[m] for _, v, m in pairs])

    def _chain(self, found: _Forest, a0, a1, b0, b1) -> None:
        for lo, hi in ((a0, a1), (b0, b1)):
            many = hi - lo
            if len(many):
                member = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                found.link(np.repeat(a0, many), member)

    def _leaves(self, found: _Forest, a0, a1, b0, b1, bits: int) -> None:
        for i in range(_LEAF):
            x = a0 + i
            for j in range(_LEAF):
                y = b0 + j
                ok = (x < a1) & (y < b1) & (x < y)
                u, v = x[ok], y[ok]
                hit = np.bitwise_count(self.value[u] ^ self.value[v]) <= bits
                found.link(u[hit], v[hit])


def _linked(node: np.ndarray, value: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    index = GrayIndex(node, value.view(np.uint64))
    root = index.forest(bits).roots(np.arange(len(index.value)))
    far = np.flatnonzero(root != np.arange(len(root)))
    ends = index.value.view(np.int64)
    if len(far):
        yield pa.RecordBatch.from_arrays([pa.array(ends[far]), pa.array(ends[root[far]])], ["a", "b"])


def _link_batches(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node: whole nodes are indexed together, a bounded number of rows at a time."""
    held, many = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        many += batch.num_rows
        if many >= _ROWS:
            node, value = (np.concatenate(x) for x in zip(*held))
            stop = int(np.searchsorted(node, node[-1]))  # the last node may go on
            yield from _linked(node[:stop], value[:stop], bits)
            held, many = [(node[stop:], value[stop:])], len(node) - stop
    if many:
        yield from _linked(*(np.concatenate(x) for x in zip(*held)), bits)


# ---------------------------------------------------------------- the index, across tasks


def _factored(rows: DataFrame, left: int) -> tuple[DataFrame, int]:
    """Members in the nodes below theirs: one for each of four segments of the ``left`` bits not fixed yet, which becomes fixed."""
    width = left // 4

    def branch(t: int) -> str:
        above = ((1 << t * width) - 1) << 64 - t * width
        above -= (above >> 63) << 64  # as a signed number
        segment = f"shiftrightunsigned(shiftleft(rest, {t * width}), {64 - width})"
        return f"struct(xxhash64(node, {t}, {segment}) as node, (rest & ({above}L)) | (shiftleft(rest, {width}) & ~({above}L)) as rest)"

    each = F.explode(F.expr(f"array({', '.join(branch(t) for t in range(4))})")).alias("k")
    return rows.select("fp", each).select("fp", "k.node", "k.rest"), left - width


def links(prints: DataFrame, node_limit: int = 1024) -> DataFrame:
    """Distinct ``prints(fp)`` to links ``(a, b)`` that join all fingerprints within three bits.

    The result is a set of spanning forests: two fingerprints within three bits are always
    connected through it, and every link in it is one of at most three bits or a chain of such.
    Members of nodes above ``node_limit`` go to four nodes each of the next level, where a
    quarter of the bits left is fixed too; a node with no more than ten bits left has no more
    than 1024 members, so the levels end and the rows stay in proportion to the members.
    """
    rows, left = prints.select("fp", F.lit(0).cast("long").alias("node"), F.col("fp").alias("rest")), 64
    dealt = None
    while True:
        rows, left = _factored(rows, left)
        # Nodes are named by a 64-bit hash: two that share a name are only compared needlessly.
        large = cut(rows.groupBy("node").agg(F.count("*").alias("members")).where(F.col("members") > node_limit).select("node"))
        if left <= 10 or large.isEmpty():
            now, rows = rows, None
        else:
            rows = stored(rows)
            now, rows = rows.join(large, "node", "left_anti"), rows.join(large, "node", "left_semi")
        dealt = now.select("node", "fp") if dealt is None else dealt.unionByName(now.select("node", "fp"))
        if rows is None:
            return dealt.repartition("node").sortWithinPartitions("node").mapInArrow(lambda it: _link_batches(it, 3), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, node_limit: int = 1024) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, fingerprint, component_id, fp)``, one row per input row.

    Null and empty texts have fingerprint zero and link like any other.  Repeated rows stay
    repeated.  A null ``doc_id`` keeps its row and its fingerprint; it names no component unless
    all documents with linked fingerprints have none (component null).  Other columns are ignored.
    """
    prints = stored(fingerprints(docs, shingle))
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("many")))
    # Fingerprints are the nodes, also those that only rows without an id have; ids come in after.
    joined = components(links(classes.select("fp"), node_limit)).select(F.col("node").alias("fp"), F.col("component").alias("part"))
    joined = stored(classes.join(joined, "fp"))
    first = joined.groupBy("part").agg(F.min("rep").alias("component_id"))
    linked = joined.join(first, "part").select("fp", "component_id")
    parts = classes.join(linked, "fp", "left").select(F.col("fp").alias("own"), F.coalesce("component_id", "rep").alias("component_id"), "many")
    # Fingerprints of very many documents, of which there are few, do not gather their rows in one task.
    hot = stored(parts.where(F.col("many") > HOT))
    crowd, others = (prints, prints) if hot.isEmpty() else divided(prints, F.col("fp"), hot.select("own"))
    placed = others.join(parts, F.col("fp") == F.col("own"))
    if crowd is not others:
        placed = placed.unionByName(crowd.join(broadcast_if_small(hot, 100_000), F.col("fp") == F.col("own")))
    return placed.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")
