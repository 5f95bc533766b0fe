"""SentencePiece encoding with source spans, and decoding.

Normalisation walks the compiled character map (a double-array trie) and takes the longest
prefix at each place; every normalised byte keeps the source byte it came from.  Pieces lie end
to end on the normalised text, so their bounds project to spans of source bytes.  Where the map
is empty and no piece reaches over a word boundary, this is done once for each word, and kept.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back

SPACE = "▁"
_CHUNK = 1 << 18  # characters of text in one output batch
_SLICE = 1000  # rows of a batch that are Python strings at a time
_KEPT = 1 << 23  # characters of words that a worker keeps


def _fields(blob: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = blob[at]
            at += 1
            out |= (byte & 127) << shift
            if byte < 128:
                return out
            shift += 7

    while at < len(blob):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, blob[at:at + size]
        at += size


class CharacterMap:
    """The compiled map: source prefixes to their normalised strings."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, np.uint32, size // 4, 4).tolist() if size else []
        self.strings = blob[4 + size:] if blob else b""

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix of ``text[at:]`` and what it becomes."""
        units, found = self.units, None
        if not units:
            return None
        node = self._offset(units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != text[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.strings[found[1]:self.strings.index(b"\0", found[1])]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)


class Codec:
    """One model in one worker."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec, trainer, self.pieces, self.kinds = {}, {}, [], []
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b""))
                self.kinds.append(piece.get(3, 1))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                spec = dict(_fields(value))
        self.map = CharacterMap(spec.get(2, b""))
        self.dummy, self.trim, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        self.suffix = bool(trainer.get(24, 0))
        self.symbols = sorted((p for p, k in zip(self.pieces, self.kinds) if k == 4), key=len, reverse=True)
        self.bytes = {i: int(p[3:5], 16) for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == 6}
        self.sizes = np.array([1 if i in self.bytes else len(p) for i, p in enumerate(self.pieces)], np.int64)  # in normalised bytes
        self.end = self.library.eos_id()
        mark = SPACE.encode()
        crossing = any(mark in p.lstrip(mark) for p, k in zip(self.pieces, self.kinds) if k in (1, 4))
        self.by_word = not self.map.units and not self.symbols and not crossing and self.dummy and self.escape and not self.trim and not self.suffix and bool(self.bytes) and mark in self.pieces
        self._forget()

    def _forget(self) -> None:
        self.word, self.first, self.many, self.kept = {}, np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        self.flat, self.spans = np.zeros(0, np.int32), np.zeros(0, np.int32)

    # ------------------------------------------------------------ any model

    def normalised(self, text: bytes) -> tuple[bytes, list[int]]:
        """The normalised text and, for each of its bytes and its end, the source byte."""
        out, source, at, space = bytearray(), [], 0, SPACE.encode() if self.escape else b" "
        if text and not self.map.units and not self.symbols and not self.trim:  # no prefix is mapped: all characters at once
            norm, places = self._unmapped(text)
            return norm, places.tolist()

        def step() -> tuple[bytes, int]:
            for symbol in self.symbols:
                if text.startswith(symbol, at):
                    return symbol, len(symbol)
            mapped = self.map.longest(text, at)
            if mapped:
                return mapped[1], mapped[0]
            size = 1 + (text[at] >= 0xC0) + (text[at] >= 0xE0) + (text[at] >= 0xF0)
            return text[at:at + size], size

        while self.trim and at < len(text):
            became, size = step()
            if became != b" ":
                break
            at += size
        if at == len(text):
            return b"", [at] if text else [0]
        if self.dummy and not self.suffix:
            out += space
            source += [at] * len(space)
        after_space = self.trim
        while at < len(text):
            became, size = step()
            while after_space and became.startswith(b" "):
                became = became[1:]
            for byte in became:
                own = space if byte == 32 else bytes([byte])
                out += own
                source += [at] * len(own)
            if became:
                after_space = became.endswith(b" ")
            at += size
            after_space = after_space and self.trim
        if self.trim:
            while out.endswith(space):
                at = source[len(out) - len(space)]
                del out[len(out) - len(space):], source[len(source) - len(space):]
        if self.dummy and self.suffix:
            out += space
            source += [at] * len(space)
        return bytes(out), source + [at]

    def _unmapped(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """``normalised`` where every character stays and only spaces are written differently."""
        space, own = SPACE.encode() if self.escape else b" ", np.frombuffer(text, np.uint8)
        begin = np.maximum.accumulate(np.where(own & 0xC0 != 0x80, np.arange(len(own)), 0))
        source, extra = np.repeat(begin, np.where(own == 32, len(space), 1)), space if self.dummy else b""
        if self.suffix:
            return text.replace(b" ", space) + extra, np.r_[source, np.full(len(extra) + 1, len(text))]
        return extra + text.replace(b" ", space), np.r_[np.zeros(len(extra), np.int64), source, len(text)]

    def _whole(self, text: str) -> tuple[list[int], list[int], list[int]]:
        ids = self.library.encode(text)
        parts = self.library.encode(text, out_type=str)
        norm, source = self.normalised(text.encode("utf-8", "surrogatepass"))
        starts, ends, at = [], [], 0
        for i, part in zip(ids, parts):
            if i in self.bytes:  # the last byte of a character carries its span
                lead = at
                while norm[lead] & 0xC0 == 0x80:
                    lead -= 1
                size = 1 + (norm[lead] >= 0xC0) + (norm[lead] >= 0xE0) + (norm[lead] >= 0xF0)
                starts.append(source[lead])
                ends.append(source[lead + size] if at == lead + size - 1 else source[lead])
                at += 1
            else:
                size = len(part.encode())
                starts.append(source[at])
                ends.append(source[at + size])
                at += size
        return ids, starts, ends

    # ------------------------------------------------------------ word by word

    def _learn(self, words: list[str]) -> None:
        """Normalise words, each behind a space, and keep their pieces with the sizes of the source spans these project to."""
        lone = [self.pieces.index(SPACE.encode())]  # a text's last space: the library gives an empty text no pieces
        ids = [got if word else lone for word, got in zip(words, self.library.encode(words, num_threads=1))]
        norm, source = self._unmapped("".join(f" {w}" for w in words).encode("utf-8", "surrogatepass"))
        flat = np.fromiter((i for x in ids for i in x), np.int32)
        ends = len(SPACE.encode()) + np.cumsum(self.sizes[flat])  # behind the space that stands before every text
        if len(flat) and ends[-1] != len(norm):
            raise RuntimeError("pieces do not cover the normalised words")
        spans = source[ends] - source[ends - self.sizes[flat]]
        self.kept += sum(map(len, words)) + 64 * len(words)
        many = np.array([len(x) for x in ids], np.int64)
        self.first = np.r_[self.first, len(self.flat) + np.cumsum(many) - many]
        self.many = np.r_[self.many, many]
        self.flat, self.spans = np.r_[self.flat, flat], np.r_[self.spans, spans.astype(np.int32)]
        start = len(self.word)
        self.word.update((w, start + i) for i, w in enumerate(words))

    @staticmethod
    def _words(text: str) -> list[str]:
        """What the library must be given, word by word, to get the text's pieces; the first space of each later word is the library's own."""
        words = text.split(" ")
        if "" not in words:
            return words
        out, run = [], 0
        for i, w in enumerate(words):
            if w or i == len(words) - 1:
                out.append(" " * run + w)
                run = 0
            else:
                run += 1
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids with an end id, starts and ends in source bytes, all laid end to end; and the bounds of each text."""
        if not self.by_word or any(SPACE in t for t in texts):
            each = [self._whole(t) for t in texts]
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            bounds = np.r_[0, np.cumsum([len(x[0]) + 1 for x in each])]
            ids, starts, ends = (np.fromiter((i for x, n in zip(each, sizes) for i in [*x[k], self.end if k == 0 else n]), np.int32, int(bounds[-1])) for k in range(3))
            return ids, starts, ends, bounds
        split = [self._words(t) if t else [] for t in texts]
        if self.kept > _KEPT:
            self._forget()
        fresh = {w for ws in split for w in ws if w not in self.word}
        if fresh:
            self._learn(list(fresh))
        lookup = self.word.__getitem__
        counts = np.array([len(ws) for ws in split], np.int64)
        at = np.fromiter((lookup(w) for ws in split for w in ws), np.int64, int(counts.sum()))
        many = self.many[at]
        position = np.repeat(self.first[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        word_bounds = np.r_[0, np.cumsum(many)]
        cuts = word_bounds[np.r_[0, np.cumsum(counts)]]  # where each text's pieces begin, without end ids
        ids, size = self.flat[position], self.spans[position].astype(np.int64)
        begins = cuts[:-1][np.diff(cuts) > 0]
        size[begins] -= 1  # the space before the text is not in the source
        total = np.r_[0, np.cumsum(size)]
        ends = total[1:] - np.repeat(total[cuts[:-1]], np.diff(cuts))
        where = cuts[1:]
        last = total[cuts[1:]] - total[cuts[:-1]]
        starts = np.insert(ends - size, where, last)
        return np.insert(ids, where, self.end), starts.astype(np.int32), np.insert(ends, where, last).astype(np.int32), cuts + np.arange(len(cuts))


@lru_cache(maxsize=2)
def codec(model: bytes) -> Codec:
    return Codec(model)


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def _encode_batches(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    own = codec(model.value)
    for batch in batches:
        for first in range(0, batch.num_rows, _SLICE):
            texts = [t or "" for t in batch.column(1).slice(first, _SLICE).to_pylist()]
            begin = 0
            while begin < len(texts):
                end, many = begin, 0
                while end < len(texts) and (end == begin or many + len(texts[end]) <= _CHUNK):
                    many += len(texts[end])
                    end += 1
                ids, starts, ends, bounds = own.encode(texts[begin:end])
                flat = ids.tolist()
                cut = bounds.tolist()
                decoded = own.library.decode([flat[a:b] for a, b in zip(cut, cut[1:])], num_threads=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first + begin, end - begin), _lists(ids, bounds), _lists(starts, bounds), _lists(ends, bounds), pa.array(decoded, pa.string())],
                    ["doc_id", "ids", "starts", "ends", "decoded"])
                begin = end
    give_back()


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, ids, starts, ends, decoded)``, a row for each row.

    Ids close with the end id; ``starts`` and ``ends`` are source bytes (UTF-8), the end id's
    span is empty at the end of the text, the first bytes of a character spelt in bytes have
    empty spans at its start.  Null is an empty text.  ``decoded`` is what the ids decode to.
    The model file (its size does not grow with the data) is read here and sent to the tasks.
    """
    with open(model_path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _encode_batches(it, model), "doc_id long, ids array<int>, starts array<int>, ends array<int>, decoded string")
