"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of characters.

Every code point is a symbol of its own; an n-gram is two numbers of 21 bits a symbol, ``high``
(all but the last three) and ``gram`` (the last three).  Counts of the trusted text of every
language are gathered over the whole corpus, order by order, and grow with it.

Scoring is a join of the documents' n-grams with the count tables, both dealt to shards by size
and all symbols before the last one, so no key has more rows than a language has code points.
Documents are taken in bundles of bounded size.  An n-gram's probability is ``a + b * p``, with
``p`` that of the n-gram without its first symbol, and ``a`` and ``b`` follow from counts that lie
in one shard.  A bundle sends each of its distinct n-grams of every size once to the shards, gets
back ``a`` and ``b``, goes up through the sizes and sums its documents.  Short n-grams, which every
bundle asks for, lie in several shards, the more the larger the input.  No task holds more of the
model than its shard or what its bundle needs, and there is no other way of scoring for smaller
models.  A document is rejected when its perplexity lies above a quantile of its language, taken
over trusted documents that the model was not trained on.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import broadcast_if_small, give_back, steady, stored

ORDER = 5
SYMBOLS = 0x110001  # all code points, and 0 before a text
BITS = 21  # of a symbol in a number; three symbols fill a long
POOLED = "*"  # the model of all trusted text, for languages without their own
QUANTILE = 0.98
PRIOR = 100  # characters at the language's mean that the smoothed perplexity adds to every document
HELD_OUT = 5  # one trusted document in so many sets thresholds
BACK_OFF = 50  # held-out documents that the quantile over all languages weighs as much as, beside a language's own
BIN = 1000  # histogram bins for one nat
SLACK = 1e-6  # nats above a limit that still pass: scores are kept in single precision
LANGUAGES = 10_000  # with trusted text; one row for each comes to the driver
BROADCAST_IDS = 2_000_000  # labelled ids, 8 bytes each, that may be broadcast
BUNDLE = 1 << 25  # characters of text in a bundle
SHARD = 1 << 22  # characters of text for each shard
SHORT = 3  # n-grams of up to so many symbols are held by several shards
COPIES = 64  # shards, at most, that hold one short n-gram
SHARDS_PER_COPY = 32
_CHUNK = 1 << 18  # characters whose n-grams a task holds at a time
_ASKED = 1 << 20  # n-grams that a shard looks up at a time
_PRIME, _FACTORS = (1 << 31) - 1, (1_640_531_527, 1_405_695_061)  # of the hash that deals n-grams
_SLICE = 1000  # rows of a batch that are Python strings at a time
_MASK = (1 << BITS) - 1


# ---------------------------------------------------------------- n-grams in a task


def _coded(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both numbers of the n-gram that ends at each character of all texts, and where each text ends."""
    sizes = np.array([len(t) for t in texts], np.int64)
    pad = "\0" * (order - 1)
    points = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.cumsum(sizes + (order - 1)) - sizes
    own = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    real = np.zeros(len(points) + 1, np.int64)
    real[own] = points[own].astype(np.int64) + 1
    high, low = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    for back in range(order - 1, -1, -1):
        part = high if back > 2 else low
        part <<= BITS
        part |= real[own - back]
    return high, low, np.cumsum(sizes)


def _distinct(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams, and the place of each given one among them."""
    h, g = pa.array(high).dictionary_encode(), pa.array(low).dictionary_encode()
    wide = max(1, len(g.dictionary))
    both = pa.array(h.indices.to_numpy().astype(np.int64) * wide + g.indices.to_numpy()).dictionary_encode()
    code = both.dictionary.to_numpy()
    return h.dictionary.to_numpy()[code // wide], g.dictionary.to_numpy()[code % wide], both.indices.to_numpy()


def _added(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tallies as one: distinct n-grams with the sums of their numbers."""
    high, low, many = (np.concatenate([p[i] for p in parts]) for i in range(3))
    high, low, at = _distinct(high, low)
    return high, low, np.bincount(at, many, len(low)).astype(np.int64)


class _Tally:
    """Distinct n-grams by language with their numbers, chunk by chunk."""

    def __init__(self) -> None:
        self.parts: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        self.loose: dict[str, int] = {}

    def add(self, lang: str, high: np.ndarray, low: np.ndarray) -> None:
        high, low, at = _distinct(high, low)
        own = self.parts.setdefault(lang, [])
        own.append((high, low, np.bincount(at, minlength=len(low))))
        self.loose[lang] = self.loose.get(lang, 0) + len(low)
        if len(own) > 1 and self.loose[lang] > len(own[0][1]) + (1 << 18):
            own[:] = [_added(own)]
            self.loose[lang] = 0

    def items(self) -> Iterator[tuple[str, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        for lang, parts in self.parts.items():
            yield lang, _added(parts)


def _language(name: str | None) -> str:
    return "" if name is None or name == POOLED else name


def _by_language(batch: pa.RecordBatch, lang: int, text: int) -> Iterator[tuple[str, list[int], list[str]]]:
    """Chunks of bounded size of one batch: the language, the rows and their texts."""
    for start in range(0, batch.num_rows, _SLICE):
        texts = batch.column(text).slice(start, _SLICE).to_pylist()
        groups: dict[str, list[int]] = {}
        for i, name in enumerate(batch.column(lang).slice(start, _SLICE).to_pylist()):
            groups.setdefault(_language(name), []).append(i)
        for name, rows in groups.items():
            part, many = [], 0
            for i in rows:
                part.append(i)
                many += len(texts[i] or "")
                if many > _CHUNK:
                    yield name, [start + k for k in part], [texts[k] or "" for k in part]
                    part, many = [], 0
            if part:
                yield name, [start + k for k in part], [texts[k] or "" for k in part]


# ---------------------------------------------------------------- counts


def _histograms(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    kept = _Tally()
    for batch in batches:
        for name, _, texts in _by_language(batch, 0, 1):
            high, low, _ = _coded(texts, order)
            if len(low):
                kept.add(name, high, low)
    for name, (high, low, many) in kept.items():
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(low)), pa.array(high), pa.array(low), pa.array(many)], ["lang", "high", "gram", "n"])
    give_back()


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """``texts(lang, text)`` to ``(lang, high, gram, n)``, with the sums over all languages as language ``*``."""
    own = stored(texts.select("lang", "text").mapInArrow(lambda it: _histograms(it, order), "lang string, high long, gram long, n long").groupBy("lang", "high", "gram").agg(F.sum("n").alias("n")))
    return own.unionByName(own.groupBy("high", "gram").agg(F.sum("n").alias("n")).select(F.lit(POOLED).alias("lang"), "high", "gram", "n"))


def _last(n: int) -> tuple[Column, Column]:
    """The last ``n`` symbols of an n-gram."""
    high = F.col("high").bitwiseAND(F.lit((1 << BITS * (n - 3)) - 1)) if n > 3 else F.lit(0).cast("long")
    return high, F.col("gram").bitwiseAND(F.lit((1 << BITS * min(n, 3)) - 1)).cast("long")


def continuation_counts(counts: DataFrame, order: int = ORDER) -> dict[int, DataFrame]:
    """By size: the counts themselves, and for shorter n-grams the numbers of their distinct left neighbours."""
    by_size = {order: stored(counts)}
    for n in range(order - 1, 0, -1):
        high, gram = _last(n)
        by_size[n] = stored(by_size[n + 1].groupBy("lang", high.alias("high"), gram.alias("gram")).agg(F.count("*").alias("n")))
    return by_size


def discounts(by_size: dict[int, DataFrame]) -> dict[tuple[str, int], tuple[float, float, float]]:
    """The three discounts of each language and size, from how many n-grams have counts of one to four."""
    sizes = reduce(DataFrame.unionByName, (df.select("lang", F.lit(n).alias("size"), "n") for n, df in by_size.items()))
    rows = sizes.groupBy("lang", "size").agg(*(F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4))).limit(LANGUAGES * len(by_size) + 1).collect()
    if len(rows) > LANGUAGES * len(by_size):
        raise ValueError(f"more than {LANGUAGES} languages have trusted text")
    out = {}
    for r in rows:
        y = r.n1 / (r.n1 + 2 * r.n2) if r.n1 + r.n2 else 0.5
        out[r.lang, r["size"]] = tuple(min(max(i - (i + 1) * y * r[f"n{i + 1}"] / r[f"n{i}"], 0.05), i - 0.05) if r[f"n{i}"] else i * 0.5 for i in (1, 2, 3))
    return out


def _shares(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """What the discount takes from each count."""
    return np.array([0.0, *d])[np.minimum(n, 3)]


# ---------------------------------------------------------------- shards


class _Pairs:
    """N-grams to find again: places of two-number keys."""

    def __init__(self, high: np.ndarray, low: np.ndarray):
        self.highs, self.lows = np.unique(high), np.unique(low)
        code = np.searchsorted(self.highs, high) * max(1, len(self.lows)) + np.searchsorted(self.lows, low)
        self.order = np.argsort(code, kind="stable")
        self.codes = code[self.order]

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The place of each n-gram in the arrays given at first, -1 for none."""
        if not len(self.codes):
            return np.full(len(high), -1)
        h, g = np.minimum(np.searchsorted(self.highs, high), len(self.highs) - 1), np.minimum(np.searchsorted(self.lows, low), len(self.lows) - 1)
        code = h * len(self.lows) + g
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.highs[h] == high) & (self.lows[g] == low) & (self.codes[at] == code), self.order[at], -1)


def _cut_to(high: np.ndarray, low: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The last ``n`` symbols."""
    return (high & ((1 << BITS * (n - 3)) - 1) if n > 3 else np.zeros_like(high)), low & ((1 << BITS * min(n, 3)) - 1)


def _before(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All symbols but the last."""
    return high >> BITS, low >> BITS | (high & _MASK) << 2 * BITS


def coefficients(high: np.ndarray, low: np.ndarray, many: np.ndarray, d: tuple[float, float, float]) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """From the counts of one size: ``a`` and ``b`` of n-grams, whose probability is ``a + b * p``.

    ``p`` is that of the n-gram without its first symbol.
    """
    if not len(many):
        return lambda high, low: (np.zeros(len(low), np.float32), np.ones(len(low), np.float32))
    took = _shares(many, d)
    first, last, at = _distinct(*_before(high, low))
    whole, taken = (np.bincount(at, w, len(first)) for w in (many, took))
    grams, contexts, left = _Pairs(high, low), _Pairs(first, last), many - took

    def of(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seen, known = grams.find(high, low), contexts.find(*_before(high, low))
        total = np.where(known >= 0, whole[known], 1.0)
        return (np.where(seen >= 0, left[seen], 0.0) / total).astype(np.float32), (np.where(known >= 0, taken[known], 1.0) / total).astype(np.float32)

    return of


def _slot(lang: str, size: int, high: np.ndarray, low: np.ndarray, copy: int, shards: int) -> np.ndarray:
    """The shard of n-grams: by language, size and all symbols before the last."""
    high, low = _before(high, low)
    mixed = (high % _PRIME * _FACTORS[0] + zlib.crc32(lang.encode()) + size) % _PRIME
    mixed = (mixed + low % _PRIME) * _FACTORS[1] % _PRIME
    return (mixed + copy * _FACTORS[0]) % _PRIME % shards


def _slots_of(copies: int, shards: int) -> Column:
    """``_slot`` as a column, for all copies."""
    prime = F.lit(_PRIME)
    high, low = F.shiftright("high", BITS), F.shiftright("gram", BITS).bitwiseOR(F.shiftleft(F.col("high").bitwiseAND(F.lit(_MASK)), 2 * BITS))
    mixed = F.pmod(F.pmod(high, prime) * F.lit(_FACTORS[0]) + F.crc32(F.col("lang").cast("binary")) + F.col("size"), prime)
    mixed = F.pmod((mixed + F.pmod(low, prime)) * F.lit(_FACTORS[1]), prime)
    each = F.sequence(F.lit(0).cast("long"), F.when(F.col("size") <= SHORT, copies - 1).otherwise(0).cast("long"))
    return F.array_distinct(F.transform(each, lambda copy: F.pmod(F.pmod(mixed + copy * F.lit(_FACTORS[0]), prime), F.lit(shards).cast("long"))))


def _packed(*arrays: np.ndarray) -> bytes:
    """Sorted numbers, byte by place: most of them repeat."""
    return pa.compress(b"".join(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays), codec="zstd", asbytes=True)


def _unpacked(data: bytes, many: int, arrays: int = 2, kind: type = np.int64) -> list[np.ndarray]:
    wide = np.dtype(kind).itemsize
    flat = np.frombuffer(pa.decompress(data, decompressed_size=wide * many * arrays, codec="zstd"), np.uint8)
    return [np.ascontiguousarray(flat[i * wide * many:(i + 1) * wide * many].reshape(wide, many).T).view(kind).ravel() for i in range(arrays)]


def _bundles(batches: Iterator[pa.RecordBatch], text: int, size: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows in the order they come, with the number of their bundle.

    A row's bundle follows from the characters of all rows before it in the task, so it is the same
    however the rows are cut into batches.
    """
    held, base = 0, TaskContext.get().partitionId() << 24
    for batch in batches:
        before = held + np.r_[0, np.cumsum(pc.utf8_length(batch.column(text)).fill_null(0).to_numpy().astype(np.int64))]
        held, number = int(before[-1]), before[:-1] // size
        cuts = np.flatnonzero(np.r_[True, np.diff(number) != 0]) if batch.num_rows else np.zeros(0, np.int64)
        for start, stop in zip(cuts, np.r_[cuts[1:], batch.num_rows]):
            yield base + int(number[start]), batch.slice(start, stop - start)


def _slices(rows: list[int], many: list[int], most: int = _ASKED) -> Iterator[list[int]]:
    """``rows`` in runs of at most ``most`` n-grams, or of one row."""
    part, held = [], 0
    for i in rows:
        if part and held + many[i] > most:
            yield part
            part, held = [], 0
        part.append(i)
        held += many[i]
    if part:
        yield part


_NEED = "shard long, bundle long, by string, size int, many long, grams binary"


def _need_batches(batches: Iterator[pa.RecordBatch], order: int, known: frozenset[str], shards: int, copies: int, size: int) -> Iterator[pa.RecordBatch]:
    """The distinct n-grams of every bundle and size, a row for each shard and language."""
    def rows(bundle: int, tally: _Tally) -> Iterator[pa.RecordBatch]:
        for by, (high, low, _) in tally.items():
            for n in range(order, 1, -1):
                if n < order:
                    high, low, _ = _distinct(*_cut_to(high, low, n))
                slot = _slot(by, n, high, low, bundle % copies if n <= SHORT else 0, shards)
                at = np.lexsort((low, high, slot))
                high, low, slot = high[at], low[at], slot[at]
                cuts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1], True])
                packs = [_packed(high[a:b], low[a:b]) for a, b in zip(cuts, cuts[1:])]
                many = len(packs)
                yield pa.RecordBatch.from_arrays([pa.array(slot[cuts[:-1]]), pa.array([bundle] * many, pa.int64()), pa.array([by] * many), pa.array([n] * many, pa.int32()), pa.array(np.diff(cuts)), pa.array(packs, pa.binary())], [x.split()[0] for x in _NEED.split(", ")])

    now, tally = None, _Tally()
    for bundle, batch in _bundles(batches, 1, size):
        if bundle != now:
            if now is not None:
                yield from rows(now, tally)
            now, tally = bundle, _Tally()
        for name, _, texts in _by_language(batch, 0, 1):
            high, low, _ = _coded(texts, order)
            if len(low):
                tally.add(name if name in known else POOLED, high, low)
    if now is not None:
        yield from rows(now, tally)
    now = tally = None
    give_back()


def _row_batches(batches: Iterator[pa.RecordBatch], text: int, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of every bundle in compressed parts."""
    for bundle, part in ((n, b.slice(start, _SLICE)) for n, b in _bundles(batches, text, size) for start in range(0, b.num_rows, _SLICE)):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(part)
        yield pa.RecordBatch.from_arrays([pa.array([bundle], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["bundle", "rows"])


@dataclass(frozen=True)
class Model:
    """Sharded count tables, and what has a row for each language or code point."""

    counts: DataFrame  # lang, size, high, gram, n, for sizes from two
    of: dict[tuple[str, int], tuple[float, float, float]]
    first: dict[str, tuple[np.ndarray, np.ndarray]]  # by language: symbols and their probabilities, at most one for each code point
    order: int = ORDER

    @property
    def languages(self) -> frozenset[str]:
        return frozenset(self.first) - {POOLED}

    def unigrams(self, by: str, symbol: np.ndarray) -> np.ndarray:
        symbols, p = self.first[by]
        at = np.minimum(np.searchsorted(symbols, symbol), len(symbols) - 1)
        return np.where(symbols[at] == symbol, p[at], p[-1])

    def scored(self, docs: DataFrame, emit: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch], schema, size: int = BUNDLE, per_shard: int = SHARD) -> DataFrame:
        """``emit(rows, characters, nll)`` over all rows of ``docs``, which is read twice and must deal its rows alike both times."""
        docs = steady(docs)
        lang, text = docs.columns.index("lang"), docs.columns.index("text")
        whole = docs.agg(F.sum(F.char_length("text"))).first()[0] or 0
        shards = max(1, -(-whole // per_shard))
        copies = max(1, min(COPIES, shards // SHARDS_PER_COPY))
        order, of, known = self.order, self.of, self.languages
        model = docs.sparkSession.sparkContext.broadcast(Model(None, of, self.first, order))  # no more than code points and languages
        needs = docs.select("lang", "text").mapInArrow(lambda it: _need_batches(it, order, known, shards, copies, size), _NEED)
        sharded = self.counts.select(F.explode(_slots_of(copies, shards)).alias("slot"), "lang", "size", "high", "gram", "n")

        def lookup(asked: pa.Table, held: pa.Table) -> pa.Table:
            many, out = asked.column("many").to_pylist(), [b""] * asked.num_rows
            if out:
                names = held.column("lang").combine_chunks().dictionary_encode()
                number = {x: i for i, x in enumerate(names.dictionary.to_pylist())}
                at, sizes, high, low, n = names.indices.to_numpy(), *(held.column(c).to_numpy() for c in ("size", "high", "gram", "n"))
                groups: dict[tuple[str, int], list[int]] = {}
                for i, key in enumerate(zip(asked.column("by").to_pylist(), asked.column("size").to_pylist())):
                    groups.setdefault(key, []).append(i)
                for (by, wide), rows in groups.items():
                    mine = np.flatnonzero((at == number.get(by, -1)) & (sizes == wide))
                    found = coefficients(high[mine], low[mine], n[mine], of.get((by, wide), (0.5, 1.0, 1.5)))
                    for some in _slices(rows, many):
                        parts = [_unpacked(asked.column("grams")[i].as_py(), many[i]) for i in some]
                        a, b = found(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)))
                        ends = np.cumsum([many[i] for i in some])[:-1]
                        for i, x, y in zip(some, np.split(a, ends), np.split(b, ends)):
                            out[i] = _packed(x, y)
            return asked.drop_columns(["shard"]).append_column("parts", pa.array(out, pa.binary()))

        found = needs.groupBy("shard").cogroup(sharded.groupBy("slot")).applyInArrow(lookup, "bundle long, by string, size int, many long, grams binary, parts binary")
        parts = docs.mapInArrow(lambda it: _row_batches(it, text, size), "bundle long, rows binary")

        def summed(rows: pa.Table, scores: pa.Table) -> pa.Table:
            many, groups = scores.column("many").to_pylist(), {}
            for i, (by, wide) in enumerate(zip(scores.column("by").to_pylist(), scores.column("size").to_pylist())):
                groups.setdefault(by, {}).setdefault(wide, []).append(i)
            ready = {}
            for by, own in groups.items():
                for wide in range(2, order + 1):
                    high, low = (np.concatenate(x) for x in zip(*(_unpacked(scores.column("grams")[i].as_py(), many[i]) for i in own[wide])))
                    a, b = (np.concatenate(x) for x in zip(*(_unpacked(scores.column("parts")[i].as_py(), many[i], kind=np.float32) for i in own[wide])))
                    p = a + b * (model.value.unigrams(by, low & _MASK) if wide == 2 else p[places.find(*_cut_to(high, low, wide - 1))])
                    places = _Pairs(high, low)
                ready[by] = places, -np.log(p).astype(np.float32)
            high = low = a = b = p = places = None
            done = []
            for part in rows.column("rows"):
                for batch in pa.ipc.open_stream(part.as_buffer()):
                    chars, nll = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
                    for name, at, texts in _by_language(batch, lang, text):
                        high, low, ends = _coded(texts, order)
                        if not len(low):
                            continue
                        by = name if name in known else POOLED
                        high, low, each = _distinct(high, low)
                        if order == 1:
                            own = -np.log(model.value.unigrams(by, low))
                        else:
                            place = ready[by][0].find(high, low)
                            if (place < 0).any():
                                raise RuntimeError("the documents' rows were dealt differently in the second reading")
                            own = ready[by][1][place].astype(np.float64)
                        total = np.r_[0.0, np.cumsum(own[each])]
                        starts = np.r_[0, ends[:-1]]
                        chars[at], nll[at] = ends - starts, total[ends] - total[starts]
                    done.append(emit(batch, chars, nll))
            ready = None
            give_back()
            return pa.Table.from_batches(done)

        return parts.groupBy("bundle").cogroup(found.groupBy("bundle")).applyInArrow(summed, schema)


def kneser_ney(texts: DataFrame, order: int = ORDER) -> Model | None:
    """A model of ``texts(lang, text)``; None without any character.

    A language has a row for each of its distinct code points in the driver, and in the tables
    no key has more rows than there are code points in its text.
    """
    by_size = continuation_counts(gram_counts(texts, order), order)
    of = discounts(by_size)
    if not of:
        return None
    first: dict[str, list[tuple[int, int]]] = {}
    for r in by_size[1].collect():  # bounded: code points by language
        first.setdefault(r.lang, []).append((r.gram, r.n))
    made = {}
    for name, own in first.items():
        symbol, n = (np.array(x, np.int64) for x in zip(*sorted(own)))
        took = _shares(n, of[name, 1])
        unseen = took.sum() / n.sum() / SYMBOLS
        made[name] = np.r_[symbol, SYMBOLS + 1], np.r_[(n - took) / n.sum() + unseen, unseen]
    counts = reduce(DataFrame.unionByName, (by_size[n].select("lang", F.lit(n).alias("size"), "high", "gram", "n") for n in range(2, order + 1))) if order > 1 else by_size[1].select("lang", F.lit(1).alias("size"), "high", "gram", "n").limit(0)
    return Model(counts, of, made, order)


# ---------------------------------------------------------------- the classifier


@dataclass
class Classifier:
    """A trained model with its thresholds by language: mean and limit in nats, and the held-out documents behind them."""

    model: Model | None
    limits: dict[str, tuple[float, float, int]] = field(default_factory=dict)
    bundle: int = BUNDLE
    per_shard: int = SHARD

    def score(self, docs: DataFrame) -> DataFrame:
        """``(doc_id, lang, n, nll)``: characters and their summed negative log-likelihood, a row for each row."""
        slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
        if self.model is None:
            return slim.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n"), F.lit(0.0).alias("nll"))

        def emit(rows: pa.RecordBatch, chars: np.ndarray, nll: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1).fill_null(""), pa.array(chars), pa.array(nll)], ["doc_id", "lang", "n", "nll"])

        return self.model.scored(slim, emit, "doc_id long, lang string, n long, nll double", self.bundle, self.per_shard)

    def judge(self, docs: DataFrame) -> DataFrame:
        """Scores with ``perplexity``, ``smoothed_perplexity``, ``threshold``, ``n_held_out`` and ``keep``.

        ``perplexity`` is the document's own, ``smoothed_perplexity`` that with ``PRIOR`` more
        characters at the mean of its language; the latter is held against the threshold.  A text
        without characters has the mean of its language.  ``n_held_out`` documents of the language
        are behind its threshold.
        """
        scored, names = self.score(docs), "l string, mean double, most double, held long"
        limits = scored.sparkSession.createDataFrame([(k, float(m), float(x), int(h)) for k, (m, x, h) in self.limits.items() if k != POOLED], names)
        mean, most, _ = self.limits.get(POOLED, (0.0, float("inf"), 0))
        own = scored.join(broadcast_if_small(limits, LANGUAGES), F.col("lang") == F.col("l"), "left").withColumn("mean", F.coalesce("mean", F.lit(mean))).withColumn("most", F.coalesce("most", F.lit(most)))
        smoothed = (F.col("nll") + PRIOR * F.col("mean")) / (F.col("n") + PRIOR)
        plain = F.when(F.col("n") > 0, F.col("nll") / F.col("n")).otherwise(F.col("mean"))
        return own.select("doc_id", "lang", F.col("n").alias("n_chars_scored"), F.exp(plain).alias("perplexity"), F.exp(smoothed).alias("smoothed_perplexity"), F.exp("most").alias("threshold"), F.coalesce("held", F.lit(0)).cast("long").alias("n_held_out"), (smoothed <= F.col("most")).alias("keep"))

    def kept(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs`` that stay, all columns as they are."""
        if self.model is None:
            return docs
        limits, other, at = self.limits, self.limits.get(POOLED, (0.0, float("inf"), 0)), docs.columns.index("lang")

        def emit(rows: pa.RecordBatch, chars: np.ndarray, nll: np.ndarray) -> pa.RecordBatch:
            own = [other if name == POOLED else limits.get(name or "", other) for name in rows.column(at).to_pylist()]
            mean, most = (np.array([x[i] for x in own]) for i in (0, 1))
            return rows.filter(pa.array((nll + PRIOR * mean) / (chars + PRIOR) <= most))

        return self.model.scored(docs, emit, docs.schema, self.bundle, self.per_shard)


def train(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, bundle: int = BUNDLE, per_shard: int = SHARD) -> Classifier:
    """A classifier from ``docs(doc_id, lang, text)`` and ``labels(doc_id, quality, toxic)``.

    Trusted are all documents with quality 1 that no label calls toxic or leaves open, without a
    cap; repeated labels count once.  One in five of them, dealt by a hash of the id, is held out
    for the thresholds: the ``quantile`` of what they have above their language's mean, by
    language, with the quantile over all languages weighing ``BACK_OFF`` documents beside a
    language's own.  A null language is the language "".  Without trusted text nothing is
    rejected.
    """
    good = broadcast_if_small(stored(labels.groupBy(F.col("doc_id").alias("d")).agg(F.max("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(1))).alias("t")).where("q = 1 and t = 0").select("d")), BROADCAST_IDS)
    trusted = docs.join(good, F.col("doc_id") == F.col("d"), "left_semi").select("doc_id", "lang", "text")
    fold = F.pmod(F.conv(F.substring(F.md5(F.col("doc_id").cast("long").cast("string")), 1, 8), 16, 10).cast("long"), F.lit(HELD_OUT))
    made = Classifier(kneser_ney(trusted.where(fold != 0), order), bundle=bundle, per_shard=per_shard)
    if made.model is None:
        return made
    held = stored(made.score(stored(trusted.where(fold == 0))).where("n > 0").select(F.when(F.col("lang") == POOLED, "").otherwise(F.col("lang")).alias("lang"), "n", "nll"))
    means = stored(held.groupBy("lang").agg((F.sum("nll") / F.sum("n")).alias("mean"), F.count("*").alias("held")))
    over = held.join(broadcast_if_small(means, LANGUAGES), "lang").select("lang", ((F.col("nll") + PRIOR * F.col("mean")) / (F.col("n") + PRIOR) - F.col("mean")).alias("over"))
    # Exact quantiles of what documents have above their language's mean, from a histogram.
    bins = stored(over.groupBy("lang", F.ceil(F.col("over") * BIN).alias("bin")).count())
    bins = bins.unionByName(bins.groupBy("bin").agg(F.sum("count").alias("count")).select(F.lit(POOLED).alias("lang"), "bin", "count"))
    window = Window.partitionBy("lang")
    reached = bins.withColumn("docs", F.sum("count").over(window)).withColumn("below", F.sum("count").over(window.orderBy("bin"))).where(F.col("below") >= quantile * F.col("docs"))
    found = {r.lang: r.bin / BIN for r in reached.groupBy("lang").agg(F.min("bin").alias("bin")).collect()}  # one row for each language
    if found:
        whole = held.agg((F.sum("nll") / F.sum("n")).alias("mean"), F.count("*").alias("held")).first()
        made.limits = {r.lang: (r["mean"], r["mean"] + (r.held * found[r.lang] + BACK_OFF * found[POOLED]) / (r.held + BACK_OFF) + SLACK, r.held) for r in means.collect()}
        made.limits[POOLED] = whole["mean"], whole["mean"] + found[POOLED] + SLACK, whole.held
    return made
