"""Packing token sequences by harmonic classes, one worker at a time.

A document's ids (its text's ids, then the end id) are cut into pieces.  A piece whose length lies
in (C/(k+1), C/k] belongs to class k, and a bin of class k takes exactly k such pieces, whatever
other workers do: no shuffle and no shared state.  Because cutting is free, the rest of a document
that would waste too much of its class's bin first gives off a piece of exactly floor(C/(k+1)) ids,
which fills its share of a bin, and goes on with what is left.  Pieces that a worker's last,
incomplete bins hold are packed by first fit, decreasing, so classes leave no bins of their own.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import as_array, slices, tidy

#: Share of a bin that a whole rest may leave empty in its class before it is cut.
WASTE = 0.02
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)


#: A run of Latin letters, then ASCII marks: two pre-tokens at most, and lower-casing A-Z first
#: changes nothing, since neither part has a character that composes with another.
WORD_AND_MARKS = (
    r"^(?P<word>[A-Za-z\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{00FF}]+)(?P<marks>[!-/:-@\[-`{-~]*)$"
)
#: Stands between parts that are encoded in one call; parts that contain it are encoded alone.
SENTINEL = "\x01"


class ChunkEncoder:
    """Ids of texts for a lower-casing tokenizer whose pre-tokens never span white space.

    A text is split at ASCII white space, and chunks of a word and marks are split there too.  Each
    distinct part is encoded once and remembered; the memory is emptied when it holds ``most``.
    """

    def __init__(self, path: str, most: int = 400_000, join: int = 100):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread for each Spark task
        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.join = most, join
        (self.sentinel,) = self._ids(SENTINEL)
        self.forget()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.flat, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def _learn(self, parts: list[str]) -> None:
        plain = [p for p in parts if SENTINEL not in p]
        found, sizes = [self.flat], [self.sizes]
        for at in range(0, len(plain), self.join):
            group = plain[at : at + self.join]
            ids = np.array(self._ids(f" {SENTINEL} ".join(group) + f" {SENTINEL}"), "<u4")
            ends = np.flatnonzero(ids == self.sentinel)
            found.append(np.delete(ids, ends))
            sizes.append(np.diff(np.append(-1, ends)) - 1)
        odd = [p for p in parts if SENTINEL in p]
        for p in odd:
            found.append(np.array(self._ids(p), "<u4"))
            sizes.append(np.array([len(found[-1])]))
        for p in (*plain, *odd):
            self.rows[p] = len(self.rows)
        self.flat, self.sizes = np.concatenate(found).astype("<u4"), np.concatenate(sizes)

    def _lookup(self, parts: list[str]) -> np.ndarray:
        """The row of each part in ``sizes``; the parts are distinct."""
        rows = self.rows
        new = [p for p in parts if p not in rows]
        if len(rows) + len(new) > self.most and rows:
            self.forget()
            rows, new = self.rows, parts
        if new:
            self._learn(new)
        return np.fromiter(map(rows.__getitem__, parts), np.int64, len(parts))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of each text's ids, and all ids.  A null text has none."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        bounds = lists.offsets.to_numpy()
        coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds = bounds - bounds[0]
        if not len(coded):
            return np.zeros(len(texts) + 1, np.int64), np.zeros(0, "<u4")
        chunks = coded.dictionary
        two = pc.extract_regex(chunks, WORD_AND_MARKS)
        word = pc.if_else(two.is_null(), chunks, pc.ascii_lower(pc.struct_field(two, "word")))
        marks = pc.fill_null(pc.struct_field(two, "marks"), "")
        parts = pa.concat_arrays([word, marks]).dictionary_encode()
        rows = self._lookup(parts.dictionary.to_pylist())[parts.indices.to_numpy()]
        firsts = np.cumsum(self.sizes) - self.sizes
        n, codes = len(chunks), coded.indices.to_numpy()
        pair = np.empty((len(codes), 2), np.int64)  # the parts of each chunk; no marks: no ids
        pair[:, 0], pair[:, 1] = rows[:n][codes], rows[n:][codes]
        pair = pair.ravel()
        each = self.sizes[pair]
        ends = np.concatenate(([0], np.cumsum(each)))
        take = np.repeat(firsts[pair] - ends[:-1], each)
        take += np.arange(len(take))
        return ends[2 * bounds], self.flat[take]


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One encoder for all tasks of a Python worker."""
    return ChunkEncoder(path)


def cut(total: int, capacity: int, waste: float = WASTE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document with ``total`` ids."""
    pieces, at = [], 0
    while total - at >= capacity:
        pieces.append((at, capacity))
        at += capacity
    while at < total:
        rest = total - at
        k = capacity // rest
        length = rest if k * rest >= (1 - waste) * capacity or k >= 1 / waste else capacity // (k + 1)
        pieces.append((at, length))
        at += length
    return pieces


class HarmonicBins:
    """Open bins of one worker: at most one per class."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {}

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        out, offset = [], 0
        for p in pieces:
            out.append((*p, self.next_id, offset))
            offset += p[2]
        self.next_id += 1
        return out

    def add(self, piece: tuple) -> list[tuple]:
        """Put a piece (doc_id, start, length, ...) in its class's bin; the bin's rows if that fills it."""
        k = self.capacity // piece[2]
        bin_ = self.open.setdefault(k, [])
        bin_.append(piece)
        return self._close(self.open.pop(k)) if len(bin_) == k else []

    def finish(self) -> list[tuple]:
        """The rows of the incomplete bins' pieces, packed by first fit, decreasing."""
        rest = sorted((p for b in self.open.values() for p in b), key=lambda p: -p[2])
        bins: list[tuple[int, list]] = []
        for p in rest:
            for i, (free, got) in enumerate(bins):
                if free >= p[2]:
                    got.append(p)
                    bins[i] = (free - p[2], got)
                    break
            else:
                bins.append((self.capacity - p[2], [p]))
        self.open = {}
        return [row for _, got in bins for row in self._close(got)]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 1,
    waste: float = WASTE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer_path`` must be readable on the executors and name a tokenizer whose pre-tokens end
    at white space.  Null and empty texts: the end id alone.  Null ids and repeated rows: each row
    is packed.  Empty table: empty result.  Other columns are ignored.  Long texts are cut into
    full sequences; a worker holds one slice of texts and at most one open bin per class.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder = encoder(tokenizer_path)
        bins = HarmonicBins(capacity, TaskContext.get().partitionId() << 40)
        schema = pa.schema([(f.name, pa.int64()) for f in SCHEMA])

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], schema=schema)

        rows: list[tuple] = []
        for batch in batches:
            all_ids, all_texts = batch.column(0), as_array(batch.column(1))
            for lo, hi in slices(all_texts):
                doc_ids = all_ids.slice(lo, hi - lo).to_pylist()
                bounds, ids = own_encoder.encode(all_texts.slice(lo, hi - lo))
                for i, doc_id in enumerate(doc_ids):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], np.array([end_id], "<u4")).astype("<u4")
                    data, total = memoryview(own.tobytes()), len(own)
                    for start, length in cut(total, capacity, waste):
                        crc = zlib.crc32(data[4 * start : 4 * (start + length)])
                        rows += bins.add((doc_id, start, length, crc, total))
                if len(rows) >= 20_000:
                    yield out(rows)
                    rows = []
        rows += bins.finish()
        if rows:
            yield out(rows)
        own_encoder.forget()  # the worker is kept for other stages; the tokenizer stays

    slim = docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{text_col}` AS text")
    return slim.mapInArrow(tidy(run), SCHEMA)


__all__ = ["ChunkEncoder", "HarmonicBins", "cut", "encoder", "pack"]
