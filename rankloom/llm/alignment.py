"""Cross-tokenizer alignment with corpus-wide counts of linked ids.

Documents are encoded by both tokenizers in bundles of bounded size, which are stored.  Where both
tokenizers begin a token at every lone space, a bundle holds its distinct words once, and documents
are rows of word numbers.  A bundle's distinct id pairs with their counts alone go to the stripes.
A stripe is a set of ids of the second tokenizer: all pairs with them are added up in one dense
block, ids of the stripe by ids of the first tokenizer, whose row maxima are the best counts.  The
pairs that a bundle asks for meet the block of their stripe again, and the answers go back to the
bundle's links.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator, Sequence
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import SPACE, codec
from .shared import give_back, stored

BUNDLE = 1 << 22  # characters of text in a bundle, about; a longer text is a bundle of its own
STRIPE = 64  # ids of the second tokenizer in a block
_AT_ONCE = 1 << 18  # characters that a tokenizer is given at a time
_KEPT = 1 << 18  # words whose ids a task keeps from bundle to bundle
_LONE = re.compile(r"(?<=\S) (?=\S)")  # a space between two characters that are none

_PACKED = ("many", "words", "n_a", "n_b", "a", "b")  # whole numbers of 32 bits, packed
_LONGS = ("doc_id", "keys", "times")
_BUNDLED = "bundle string, " + ", ".join([*(f"{c} binary" for c in _PACKED), *(f"{c} array<long>" for c in _LONGS)])
_ASKED = "stripe int, bundle string, cells array<int>, times array<long>"
_COUNTED = "stripe int, cells array<int>, counts array<long>, best array<long>"
_ANSWER = "bundle string, stripe int, counts array<long>, best array<boolean>"
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _bytes_of_levels() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and all others as code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, and the bytes of all their ids."""

    def __init__(self, first: bytes, second: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_str(first.decode())
        self.first.encode_special_tokens = True
        own = codec(second)
        self.second = own.library
        level = _bytes_of_levels()
        names = {i: t for t, i in self.first.get_vocab(with_added_tokens=True).items()}
        self.n_a = max(names, default=-1) + 1
        self.bytes_a = [bytes(level[c] for c in names[i]) if i in names and all(c in level for c in names[i]) else b"" for i in range(self.n_a)]
        self.n_b = self.second.get_piece_size()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in ((i, self.second.id_to_piece(i)) for i in range(self.n_b))]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        split = json.loads(first)
        ahead = split.get("pre_tokenizer") or {}
        # A space that stands alone begins a token on the first side by its pattern, on the second because no piece has one behind other characters.
        self.by_word = own.by_word and not split.get("normalizer") and ahead.get("type") == "ByteLevel" and ahead.get("use_regex", True) and not ahead.get("add_prefix_space")
        self.known: dict[str, tuple[list[int], list[int]]] = {}

    def words(self, text: str | None) -> list[str]:
        """Parts that are encoded apart, each behind a space; none for a text that has U+2581, which the second side spells as a space."""
        if not text or SPACE in text:
            return []
        return _LONE.split(text) if self.by_word else [text]

    def ids(self, words: list[str]) -> tuple[Sequence[list[int]], Sequence[list[int]], np.ndarray]:
        """Both sides' ids of each word behind a space, and whether both spell it byte for byte; else there are none."""
        if len(self.known) > _KEPT:
            self.known = {}
        fresh, begin = [w for w in words if w not in self.known], 0
        while begin < len(fresh):
            end, many = begin, 0
            while end < len(fresh) and (end == begin or many + len(fresh[end]) < _AT_ONCE):
                many += len(fresh[end]) + 1
                end += 1
            part = fresh[begin:end]
            a = [e.ids for e in self.first.encode_batch_fast([f" {w}" for w in part], add_special_tokens=False)]
            b = self.second.encode(part, num_threads=1)
            own, lengths = f" {' '.join(part)}".encode(), pc.binary_length(pa.array(part, pa.string())).to_numpy() + 1
            if not (self._spells(a, own, lengths, self.bytes_a, self.sizes_a) and self._spells(b, own, lengths, self.bytes_b, self.sizes_b)):  # which ones, word by word
                good = [b"".join(map(self.bytes_a.__getitem__, x)) == f" {w}".encode() == b"".join(map(self.bytes_b.__getitem__, y)) for x, y, w in zip(a, b, part)]
                a, b = ([x if g else [] for x, g in zip(side, good)] for side in (a, b))
            self.known.update(zip(part, zip(a, b)))
            begin = end
        a, b = zip(*map(self.known.__getitem__, words)) if words else ((), ())
        return a, b, np.fromiter(map(len, a), np.int64, len(a)) > 0

    @staticmethod
    def _spells(ids: list[list[int]], own: bytes, lengths: np.ndarray, spelt: list[bytes], sizes: np.ndarray) -> bool:
        """Whether the ids of all words spell them: all bytes in turn, and as many for each word."""
        flat, many = _flat(ids)
        return bool((_summed(sizes[flat], _cuts(many)) == lengths).all()) and b"".join(map(spelt.__getitem__, flat.tolist())) == own

    def ends(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where each id ends, in bytes of all words laid end to end; and for each byte, whether an id of either side ends behind it."""
        ends = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        marks = [np.zeros(int(ends[0][-1]) + 1 if len(a) else 1, bool) for _ in ends]
        for mark, own in zip(marks, ends):
            mark[own] = True
        return *ends, *marks

    def keys(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A number for each id pair that orders pairs by stripe; ids go to stripes in turn."""
        stripes = -(-self.n_b // STRIPE)
        return ((b.astype(np.int64) % stripes) * STRIPE + b // stripes) * self.n_a + a

    def links(self, a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the ids of each link, and where each word's links end: where neither side has an end between, one id of each lies over the bytes."""
        ends_a, _, mark_a, mark_b = self.ends(a, b)
        either = mark_a | mark_b
        ends = np.flatnonzero(either)
        return np.cumsum(mark_a)[ends - 1], np.cumsum(mark_b)[ends - 1], np.cumsum(either)[np.r_[0, ends_a][cuts_a]]

    @cached_property
    def written(self) -> list[str]:
        """Every id with what may follow it in a group: a comma, and the bar or semicolon behind a side's last."""
        return [f"{i}{end}" for end in (",", "|") for i in range(self.n_a)] + [f"{i}{end}" for end in (",", ";") for i in range(self.n_b)]

    def groups(self, a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """How many groups each word has, and all of them written: ids of both sides between the ends that they share."""
        ends_a, ends_b, mark_a, mark_b = self.ends(a, b)
        upto = np.cumsum(mark_a & mark_b)
        group_a, group_b = upto[ends_a - 1], upto[ends_b - 1]
        upto_a, upto_b = np.cumsum(np.bincount(group_a)), np.cumsum(np.bincount(group_b))
        shift_a, shift_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        shift_a[upto_a - 1], shift_b[upto_b - 1] = self.n_a, self.n_b
        row = np.empty(len(a) + len(b), np.int64)
        row[np.arange(len(a)) + np.r_[0, upto_b][group_a]] = a + shift_a
        row[np.arange(len(b)) + upto_a[group_b]] = 2 * self.n_a + b + shift_b
        flat, at = list(map(self.written.__getitem__, row.tolist())), (cuts_a + cuts_b).tolist()
        return np.diff(upto[np.r_[0, ends_a][cuts_a]]), ["".join(flat[x:y])[:-1] for x, y in zip(at, at[1:])]


@lru_cache(maxsize=1)
def pair(first: bytes, second: bytes) -> Pair:
    return Pair(first, second)


def _cuts(sizes: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(sizes, dtype=np.int64)]


def _summed(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums between cuts that lie end to end."""
    return np.diff(np.r_[0, np.cumsum(values, dtype=np.int64)][cuts])


def _flat(lists: Sequence[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers laid end to end, and how many each list has."""
    many = np.fromiter(map(len, lists), np.int32, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(many.sum())), many


def _packed(numbers: np.ndarray) -> bytes:
    """How many whole numbers, and they byte by place, compressed: high bytes are mostly zero."""
    planes = np.ascontiguousarray(numbers.astype(np.uint32)).view(np.uint8).reshape(-1, 4).T
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    many = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=4 * many, codec="zstd"), np.uint8).reshape(4, many)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.int64)


def _bundle(own: Pair, ids: list[int | None], many: list[int], parts: list[str]) -> pa.RecordBatch:
    """One row: documents as rows of word numbers, the ids of the words, and the id pairs with their counts."""
    coded = pa.array(parts, pa.string()).dictionary_encode()
    words, flat, many = coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.array(many, np.int64)
    a, b, good = own.ids(words)
    bad = _summed(~good[flat], _cuts(many)) > 0  # a document with a word that is not spelt has no tokens
    flat, many = flat[np.repeat(~bad, many)], np.where(bad, 0, many)
    (flat_a, n_a), (flat_b, n_b) = _flat(a), _flat(b)
    at_a, at_b, upto = own.links(flat_a, flat_b, _cuts(n_a))
    often = np.bincount(flat, minlength=len(words))
    keys, which = np.unique(own.keys(flat_a[at_a], flat_b[at_b]), return_inverse=True)
    times = np.bincount(which, np.repeat(often, np.diff(upto)), len(keys)).astype(np.int64)
    packed = {"many": many, "words": flat, "n_a": n_a, "n_b": n_b, "a": flat_a, "b": flat_b}
    longs = {"doc_id": ids, "keys": keys, "times": times}
    return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *(pa.array([_packed(packed[c])], pa.binary()) for c in _PACKED), *(pa.array([longs[c]], pa.list_(pa.int64())) for c in _LONGS)], ["bundle", *_PACKED, *_LONGS])


def _bundles(batches: Iterator[pa.RecordBatch], models, size: int) -> Iterator[pa.RecordBatch]:
    """Documents of a task in bundles, numbered once: what is stored is never dealt anew."""
    own = pair(*models.value)
    ids, many, parts, held = [], [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            if ids and held + len(text or "") > size:
                yield _bundle(own, ids, many, parts)
                ids, many, parts, held = [], [], [], 0
            words = own.words(text)
            ids.append(key)
            many.append(len(words))
            parts += words
            held += len(text or "") + 1
    if ids:
        yield _bundle(own, ids, many, parts)
    own.known = {}
    give_back()


def _asked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A bundle's pairs by stripe, as cells of the stripe's block."""
    block = STRIPE * width
    for batch in batches:
        for i in range(batch.num_rows):
            keys, times = (batch.column(c)[i].values.to_numpy() for c in ("keys", "times"))
            stripe = keys // block
            cuts = np.flatnonzero(np.r_[True, np.diff(stripe) != 0]) if len(keys) else np.zeros(0, np.int64)
            bounds = pa.array(np.r_[cuts, len(keys)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(stripe[cuts].astype(np.int32)), pa.array([batch.column("bundle")[i].as_py()] * len(cuts)), pa.ListArray.from_arrays(bounds, pa.array((keys % block).astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(times))], ["stripe", "bundle", "cells", "times"])


def _counted(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Each stripe of a task, one after the other, added up in a dense block; with the maxima of its rows."""
    stripe, block = None, np.zeros((STRIPE, width), np.int64)
    flat = block.ravel()

    def close() -> pa.RecordBatch:
        cells = np.flatnonzero(flat)
        out = pa.RecordBatch.from_arrays([pa.array([stripe], pa.int32()), pa.array([cells.astype(np.int32)], pa.list_(pa.int32())), pa.array([flat[cells]], pa.list_(pa.int64())), pa.array([block.max(axis=1)], pa.list_(pa.int64()))], ["stripe", "cells", "counts", "best"])
        flat[cells] = 0
        return out

    for batch in batches:
        for at, cells, times in zip(batch.column("stripe").to_pylist(), batch.column("cells"), batch.column("times")):
            if at != stripe:
                if stripe is not None:
                    yield close()
                stripe = at
            np.add.at(flat, cells.values.to_numpy(), times.values.to_numpy())
    if stripe is not None:
        yield close()


def _answered(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A stripe's counts come first and fill its block; then every bundle's cells are looked up."""
    flat, filled, best = np.zeros(STRIPE * width, np.int64), np.zeros(0, np.int64), None
    for batch in batches:
        names, stripes, found, tops = [], [], [], []
        for i, bundle in enumerate(batch.column("bundle").to_pylist()):
            cells = batch.column("cells")[i].values.to_numpy()
            if bundle is None:
                flat[filled] = 0
                filled, best = cells, batch.column("best")[i].values.to_numpy()
                flat[cells] = batch.column("counts")[i].values.to_numpy()
                continue
            counts = flat[cells]
            names.append(bundle)
            stripes.append(batch.column("stripe")[i].as_py())
            found.append(counts)
            tops.append(counts == best[cells // width])
        bounds = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(stripes, pa.int32()), pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(found))), pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(tops)))], ["bundle", "stripe", "counts", "best"])


def _scored(bundle: pa.Table, answers: pa.Table, own: Pair) -> pa.Table:
    """A bundle's documents from its words and the answers of the stripes, which together are as its keys."""
    row = {"keys": bundle.column("keys")[0].values.to_numpy(), **{c: _unpacked(bundle.column(c)[0].as_py()) for c in _PACKED}}
    order = np.argsort(answers.column("stripe").to_numpy())
    counts, best = ([answers.column(c)[int(i)].values.to_numpy(zero_copy_only=False) for i in order] for c in ("counts", "best"))
    counts, best = np.concatenate([np.zeros(0, np.int64), *counts]), np.concatenate([np.zeros(0, bool), *best])
    if len(counts) != len(row["keys"]):
        raise RuntimeError("stripes did not answer for every pair of a bundle")
    a, b, cuts_a, cuts_b = row["a"], row["b"], _cuts(row["n_a"]), _cuts(row["n_b"])
    at_a, at_b, cuts = own.links(a, b, cuts_a)
    which = np.searchsorted(row["keys"], own.keys(a[at_a], b[at_b]))
    n_groups, written = own.groups(a, b, cuts_a, cuts_b)
    words, of = row["words"], _cuts(row["many"])
    each = [row["n_a"], row["n_b"], n_groups, np.diff(cuts), _summed(best[which], cuts), _summed(counts[which], cuts)]
    columns = [bundle.column("doc_id")[0].values, *(pa.array(_summed(x[words], of)) for x in each)]
    numbers, at = words.tolist(), of.tolist()
    groups = pa.array([";".join(map(written.__getitem__, numbers[x:y])) for x, y in zip(at, at[1:])], pa.string())
    return pa.table([*columns, groups], [c.split()[0] for c in _RESULT.split(", ")])


def align(docs: DataFrame, first: str, second: str, bundle: int = BUNDLE) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)``, a row for each row.

    ``first`` is the file of a byte-level tokenizer, ``second`` that of a SentencePiece model;
    a space and the text are encoded by both.  Ids are linked where their bytes overlap.  An id
    pair's count is how many links of all documents hold it; ``count_sum`` adds it up over a
    document's links and ``n_best`` says how many of them have the highest count of their second
    id, ties included.  ``groups`` are the ids between two bytes where both sides end:
    ``a1,a2|b1;a3|b2,b3``.  Null and empty texts, and those that a side does not spell byte for
    byte, have no tokens: zeros and an empty string.  Repeated rows count each.  The files' sizes
    do not grow with the data; they are read here and sent to the tasks.
    """
    spark = docs.sparkSession
    contents = []
    for path in (first, second):
        with open(path, "rb") as file:
            contents.append(file.read())
    models = spark.sparkContext.broadcast(tuple(contents))
    width = pair(*contents).n_a
    bundles = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _bundles(it, models, bundle), _BUNDLED))
    asked = bundles.select("bundle", "keys", "times").mapInArrow(lambda it: _asked(it, width), _ASKED)
    counts = stored(asked.select("stripe", "cells", "times").repartition("stripe").sortWithinPartitions("stripe").mapInArrow(lambda it: _counted(it, width), _COUNTED))
    none = F.lit(None).cast("array<long>")
    both = counts.withColumn("bundle", F.lit(None).cast("string")).unionByName(asked.select("stripe", "bundle", "cells", none.alias("counts"), none.alias("best")))
    answers = both.repartition("stripe").sortWithinPartitions("stripe", F.col("bundle").isNotNull()).mapInArrow(lambda it: _answered(it, width), _ANSWER)

    def score(own: pa.Table, found: pa.Table) -> pa.Table:
        return _scored(own, found, pair(*models.value))

    return bundles.drop("times").groupBy("bundle").cogroup(answers.groupBy("bundle")).applyInArrow(score, _RESULT)
