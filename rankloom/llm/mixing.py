"""Mixing sources to target weights by fitting subset sums.

Documents are counted by source and exact size.  A source gives whole copies of itself as often as
its target holds it; of the rest of the target, the counts by size give an even share, rounded from
the largest size down so that less than the largest document stays open.  What stays open is a
bounded knapsack over the sizes and counts still free, by dynamic programming.  Counts become
documents in the order of a seeded hash.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ranks
from ..sources.matrix import numbered
from .shared import broadcast_if_small, stored

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3  # times that a source, and any of its documents, may be taken
WINDOW = 1 << 16  # the largest open budget that the dynamic program is given
_CHUNK = 4096  # documents of one source and size that are put in order together
_SMALL = 500_000


def words(text: Column) -> Column:
    """Runs of characters that are no white space of ASCII; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fit(budget: int, sizes: Sequence[int], counts: Sequence[int]) -> dict[int, int]:
    """How many of each size come nearest to the budget, the smaller sum where two are as near.

    Sums are bits of one number.  Counts are split into powers of two; the first part that reaches
    a sum is noted beside it, and its predecessor was reached before, so that going back uses no
    part twice.  Sums end at twice the budget: beyond that, nothing is nearer.
    """
    top = 2 * budget
    mask, reached = (1 << (top + 1)) - 1, 1
    by, parts = np.full(top + 1, -1, np.int64), []
    for size, count in sorted(zip(sizes, counts), reverse=True):
        if not 0 < size <= top:
            continue
        left, step = min(count, top // size), 1
        while left > 0 and not reached >> budget & 1:
            many = min(step, left)
            new = reached << size * many & mask & ~reached
            if new:
                bits = np.frombuffer(new.to_bytes(top // 8 + 1, "little"), np.uint8)
                by[np.flatnonzero(np.unpackbits(bits, bitorder="little")[:top + 1])] = len(parts)
                reached |= new
            parts.append((size, many))
            left, step = left - many, step * 2
    sums = np.r_[0, np.flatnonzero(by >= 0)]
    at = int(sums[np.lexsort((sums, np.abs(sums - budget)))[0]])
    found: dict[int, int] = {}
    while at:
        size, many = parts[by[at]]
        found[size] = found.get(size, 0) + many
        at -= size * many
    return found


def shares(sources: DataFrame, weights: Sequence[float], most: int) -> DataFrame:
    """``sources(source, words)`` with ``place`` (by code point, null last) and ``target``.

    All words are shared by weight; a share above ``most`` times its source is cut to that and the
    excess shared by the others.  The driver sees three sums a round.
    """
    sources = stored(numbered(sources.withColumn("_by", F.struct(F.col("source").isNull().alias("last"), "source")), "_by", "place").drop("_by"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("place") % len(weights) + 1)
    total = sources.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    level, before = 0.0, None
    while True:
        full = most * F.col("words") < level * weight
        many, held, free = sources.agg(F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, F.col("words"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, weight)), F.lit(0.0))).first()
        if many == before or not free:
            break
        level, before = (total - most * held) / free, many
    return sources.withColumn("target", F.least(level * weight, (most * F.col("words")).cast("double")))


def _opened(counts: DataFrame, sources: DataFrame, picked: DataFrame | None) -> DataFrame:
    """``(place, open)``: the budget that the counts and picks leave of each source's rest."""
    used = counts.select("place", (F.col("size") * F.col("take")).alias("w"))
    if picked is not None:
        used = used.unionByName(picked.select("place", (F.col("size") * F.col("more")).alias("w")))
    return sources.join(used.groupBy("place").agg(F.sum("w").alias("w")), "place", "left").select("place", (F.col("rest") - F.coalesce("w", F.lit(0))).alias("open"))


def _free(counts: DataFrame, picked: DataFrame | None) -> DataFrame:
    """``(place, size, free)``: documents of each size that are not taken yet."""
    if picked is None:
        return counts.select("place", "size", (F.col("n") - F.col("take")).alias("free"))
    more = picked.groupBy("place", "size").agg(F.sum("more").alias("more"))
    return counts.join(more, ["place", "size"], "left").select("place", "size", (F.col("n") - F.col("take") - F.coalesce("more", F.lit(0))).alias("free"))


def _fitted(counts: DataFrame, sources: DataFrame, window: int) -> DataFrame:
    """``(place, size, more)``: documents for the budget that the even share leaves open."""
    picked = None
    while True:  # budgets too large for the dynamic program: the largest sizes that fit, all sources at once
        open_ = stored(_opened(counts, sources, picked))
        above = open_.where(F.col("open") > window)
        if above.isEmpty():
            break
        best = _free(counts, picked).where("free > 0").join(above, "place").where("size <= open")
        step = stored(best.groupBy("place").agg(F.max(F.struct("size", "free", "open")).alias("s")).select("place", F.col("s.size").alias("size"), F.expr("least(s.free, s.open div s.size)").alias("more")))
        if step.isEmpty():
            break
        picked = step if picked is None else stored(picked.unionByName(step))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        found = fit(int(rows["open"].iloc[0]), rows["size"].tolist(), rows["free"].tolist())
        return pd.DataFrame({"place": rows["place"].iloc[0], "size": list(found), "more": list(found.values())})

    # One row for each size up to twice the window: a group's rows are bounded whatever the source holds.
    asked = _free(counts, picked).where("free > 0").join(open_.where((F.col("open") > 0) & (F.col("open") <= window)), "place").where("size <= 2 * open")
    found = stored(asked.groupBy("place").applyInPandas(solve, "place int, size long, more long"))
    return found if picked is None else found.unionByName(picked)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, seed: int = 42, window: int = WINDOW) -> DataFrame:
    """``docs(doc_id, source, size)`` to ``(doc_id, source, size, source_size, target, taken, copies)``, a row for each row.

    Sources in code point order, null last, have the weights in turn and share the words of all
    documents; none is taken more than ``most`` times.  ``copies`` says how often a document is
    taken and ``taken`` how many words that gives: for every source, the sum that is nearest to its
    target which the knapsack reaches.  Null and negative sizes are zero, and such documents are
    never taken.  Repeated rows are documents of their own; rows with the same id and size are
    exchangeable.  The choice depends on ids, sizes and ``seed`` only.
    """
    rows = stored(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.greatest(F.coalesce(F.col("size"), F.lit(0)), F.lit(0)).cast("long").alias("size")))
    counts = stored(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = shares(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("docs")), weights, most)
    goal = F.least(F.round("target").cast("long"), most * F.col("words"))
    whole = F.when(F.col("words") > 0, F.expr("goal div words")).otherwise(0)
    sources = stored(sources.withColumn("goal", goal).withColumn("whole", whole).withColumn("rest", F.col("goal") - F.col("whole") * F.col("words")))

    known = broadcast_if_small(sources.select(F.col("source").alias("_s"), "place", "docs", "words", "rest"), _SMALL)
    by_size = counts.join(known, F.col("source").eqNullSafe(F.col("_s"))).select("place", "size", "n", "docs", "words", "rest")
    # Of the documents this large or larger, so many: rounding leaves less than the largest size open.
    placed = ranks.placed(by_size.withColumn("v", F.col("size").cast("double")).withColumn("rc", F.col("n")), ["place"])
    share = "cast(cast({} as decimal(19,0)) * cast(rest as decimal(19,0)) as decimal(38,0)) div cast(words as decimal(19,0))"
    take = F.expr(f"case when words = 0 or size = 0 then 0 else {share.format('(docs - less)')} - {share.format('(docs - less - n)')} end").cast("long")
    by_size = stored(placed.select("place", "size", "n", take.alias("take")))
    more = _fitted(by_size, sources, window).groupBy("place", "size").agg(F.sum("more").alias("more"))
    chosen = by_size.join(more, ["place", "size"], "left").select("place", "size", "n", (F.col("take") + F.coalesce("more", F.lit(0))).alias("k"))
    chosen = stored(chosen.join(broadcast_if_small(sources.drop("docs", "goal", "rest"), _SMALL), "place"))

    # Documents of one source and size are dealt by hash; one part of them is cut, all others go in or stay out whole.
    hint = broadcast_if_small(chosen.withColumnsRenamed({"source": "_s", "size": "_z"}), _SMALL)
    order = F.xxhash64(F.lit(seed), "doc_id")
    dealt = rows.join(hint, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))).drop("_s", "_z").withColumn("_o", order)
    dealt = dealt.withColumn("_part", F.when((F.col("k") > 0) & (F.col("k") < F.col("n")), F.pmod(F.shiftrightunsigned("_o", 8), F.ceil(F.col("n") / _CHUNK))))
    parts = dealt.where("_part is not null").groupBy("place", "size", "_part").agg(F.count("*").alias("_many"), F.first("k").alias("_k"))
    parts = parts.withColumn("_before", F.sum("_many").over(Window.partitionBy("place", "size").orderBy("_part")) - F.col("_many"))
    cut = stored(parts.where("_before <= _k and _k < _before + _many").select(F.col("place").alias("_p"), F.col("size").alias("_z"), F.col("_part").alias("_cut"), (F.col("_k") - F.col("_before")).alias("_of")))
    dealt = dealt.join(broadcast_if_small(cut, _SMALL), (F.col("place") == F.col("_p")) & (F.col("size") == F.col("_z")), "left")
    inside = F.row_number().over(Window.partitionBy("place", "size").orderBy("_o", "doc_id"))  # the rows of one part
    split = F.coalesce(F.col("_part") == F.col("_cut"), F.lit(False))
    sure = dealt.where(~split).withColumn("_in", F.coalesce(F.col("_part") < F.col("_cut"), F.col("k") >= F.col("n")))
    torn = dealt.where(split).withColumn("_in", inside <= F.col("_of"))
    copies = (F.col("whole") + F.col("_in").cast("long")).cast("int")
    done = sure.unionByName(torn).withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0))
    return done.select("doc_id", "source", "size", F.col("words").alias("source_size"), "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
