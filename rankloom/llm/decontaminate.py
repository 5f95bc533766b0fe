"""Benchmark decontamination by winnowing, in DataFrame operations only.

Every window (13 consecutive words of a benchmark item, or the whole of a shorter item) holds
``w`` overlapping k-grams; the smallest k-gram hash of each run of ``w`` is its fingerprint.  A
document that contains a window has the same run and so the same fingerprint: no shared window
is missed.  Fingerprints of documents and items are joined, each hit is extended to the windows
around it, and those are compared word for word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, divided

WINDOW = 13
GRAM = 5
_PARTS = 64
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; other letters as they are.  Null has none."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def upto(n: Column) -> Column:
    """0 .. n-1, none for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _grams(hashes: Column, k: int) -> Column:
    return F.transform(upto(F.size(hashes) - (k - 1)), lambda i: F.xxhash64(*(hashes[i + j] for j in range(k))))


def _least_of_runs(grams: Column, w: int) -> Column:
    """The least of each run of ``w``, by doubling; each distinct one once."""
    def halve(g: Column, done: int) -> Column:
        step = min(done, w - done)
        if not step:
            return F.array_distinct(g)
        return bind(F.transform(upto(F.size(g) - step), lambda i: F.least(g[i], g[i + step])), lambda h: halve(h, done + step))

    return halve(grams, 1)


def _shape(length: int) -> tuple[int, int]:
    """k and w for windows of so many words: a window has exactly w k-grams."""
    k = min(GRAM, length)
    return k, length - k + 1


def _prints(words: Column, lengths: list[int]) -> Column:
    """All fingerprints of a text, for every window length in use."""
    def one(hashes: Column, n: int) -> Column:
        k, w = _shape(n)
        return F.transform(bind(_grams(hashes, k), lambda g: _least_of_runs(g, w)), lambda x: F.xxhash64(F.lit(n), x))

    return bind(F.transform(words, lambda x: F.xxhash64(x)), lambda h: reduce(lambda a, b: F.concat(a, b), (one(h, n) for n in lengths)))


def _starts(words: Column, hits: Column, n: int) -> Column:
    """Where windows of ``n`` words begin that hold a k-gram among the hits."""
    k, w = _shape(n)

    # Hits lie in parts by their last bits: looking one up does not pass all others.
    table = F.transform(upto(F.lit(_PARTS)), lambda part: F.filter(hits, lambda h: F.pmod(h, F.lit(_PARTS)) == part))

    def among(found: Column, x: Column) -> Column:
        return bind(x, lambda h: F.array_contains(found[F.pmod(h, F.lit(_PARTS)).cast("int")], h))

    def around(g: Column) -> Column:
        marked = bind(table, lambda found: F.filter(upto(F.size(g)), lambda p: among(found, F.xxhash64(F.lit(n), g[p]))))
        last = F.size(g) - w
        near = F.transform(marked, lambda p: F.when(last >= p - (w - 1), F.sequence(F.greatest(p - (w - 1), F.lit(0)), F.least(p, last))).otherwise(F.array().cast("array<int>")))
        return F.array_distinct(F.flatten(near))

    return bind(F.transform(words, lambda x: F.xxhash64(x)), lambda h: bind(_grams(h, k), around))


def _sized(starts: Column, n: int) -> Column:
    return F.transform(starts, lambda s: F.struct(s.alias("s"), F.lit(n).alias("n")))


def item_windows(items: DataFrame) -> DataFrame:
    """``items(item_id, text)`` to distinct windows ``(window, n, item_ids)``."""
    split = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    sized = split.withColumn("n", F.least(F.size("words"), F.lit(WINDOW)))
    each = sized.select("item_id", "n", F.explode(bind(F.col("words"), lambda ws: F.transform(upto(F.size(ws) - F.col("n") + 1), lambda i: F.array_join(F.slice(ws, i + 1, F.col("n")), " ")))).alias("window"))
    return each.groupBy("n", "window").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and are clean.  Repeated rows stay repeated; rows that
    share a ``doc_id`` but not the text are judged apart (column ``text_hash``).  An empty
    benchmark leaves all documents clean; items without words, or whose id is null, name nothing
    (a null item's windows still count as hit).  Other columns are ignored.
    """
    windows = cut(item_windows(items))
    lengths = sorted(r.n for r in windows.select("n").distinct().collect())  # 13 values at most
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    scanned = keyed.select("doc_id", "text_hash", words_of(F.col("text")).alias("words"))
    if not lengths:
        return _verdict(scanned.select("doc_id", "text_hash", F.size("words").alias("n_words"), F.lit(0).alias("n_hit"), F.array().cast("array<string>").alias("ids")))
    marked = cut(scanned.select("doc_id", "text_hash", F.size("words").alias("n_words"), _prints(F.col("words"), lengths).alias("prints")))
    own = windows.select(F.explode(_prints(F.split("window", " "), lengths)).alias("print")).distinct()
    hits = marked.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.explode("prints").alias("print")).join(own, "print").groupBy("d", "h").agg(F.collect_set("print").alias("hits"))
    # Candidates only: words again, and the windows around each hit; texts without a hit stay where they are.
    hits = cut(hits)
    touched, _ = divided(keyed, F.xxhash64("doc_id", "text_hash"), hits.select(F.xxhash64("d", "h")))
    near = touched.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))).select("doc_id", "text_hash", words_of(F.col("text")).alias("words"), "hits")
    spans = near.select("doc_id", "text_hash", "words", F.explode(reduce(lambda a, b: F.concat(a, b), (_sized(_starts(F.col("words"), F.col("hits"), n), n) for n in lengths))).alias("x"))
    spans = spans.select("doc_id", "text_hash", "x.s", "x.n", F.array_join(F.slice("words", F.col("x.s") + 1, F.col("x.n")), " ").alias("window"))
    true = spans.join(windows, ["n", "window"]).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("s", (F.col("s") + F.col("n")).alias("e")))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("ids"))
    nothing = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate("spans", nothing, lambda a, x: F.struct(F.greatest(a["end"], x["e"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["end"], x["s"]))).alias("n")))["n"]
    found = true.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), covered.alias("n_hit"), "ids")
    whole = marked.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    return _verdict(whole.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids")))


def _verdict(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id", F.col("n_words").cast("long"), F.col("n_hit").cast("long"), F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("ids"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "text_hash")


SQL = r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iu AS (
  SELECT item_id, w, least(len(w), 13) AS n FROM iw WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM iu)
), dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), lens AS (SELECT DISTINCT n FROM iu), dg AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM dw, lens WHERE len(w) >= n)
), hit AS (SELECT d.doc_id, d.i, d.n, win.item_id FROM dg d JOIN win ON d.g = win.g AND d.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
