"""Edit-aware token counts.

A document's text is cut into leaves at white space, where no pre-token can span, and two segment
trees stand over the leaves: their code points and their tokens.  An edit finds its leaves by a
descent through the code-point sums, and only their text, with a neighbour where the edit touches a
leaf's end, is encoded again; the sums above them are updated.  The total after any number of edits
is the root.

``count_edited`` counts before and after in one pass over the texts.  Where edits come later, and
again and again, ``stored_leaves`` makes a table of leaves to keep, ``edit_leaves`` gives the table
after a batch of edits, and ``token_totals`` its sums; only leaves that an edit touches are read as
text and encoded again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_array, saved, slices
from .packing import ChunkEncoder, encoder

#: A leaf ends at the first white space after so many code points.
LEAF = 512
SPACE = re.compile("[ \t\n\x0b\x0c\r]")


class SegmentTree:
    """Sums over a fixed number of leaves; a leaf's value may change."""

    def __init__(self, values: list[int]):
        self.size = 1
        while self.size < len(values):
            self.size *= 2
        self.sums = [0] * self.size + list(values) + [0] * (self.size - len(values))
        for i in range(self.size - 1, 0, -1):
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    @property
    def total(self) -> int:
        return self.sums[1]

    def value(self, leaf: int) -> int:
        return self.sums[self.size + leaf]

    def update(self, leaf: int, value: int) -> None:
        i = self.size + leaf
        change = value - self.sums[i]
        while i and change:
            self.sums[i] += change
            i //= 2

    def find(self, position: int) -> tuple[int, int]:
        """The leaf that holds unit ``position``, and the sum before that leaf."""
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if position - before >= self.sums[i]:
                before += self.sums[i]
                i += 1
        return i - self.size, before


def leaves(text: str, size: int = LEAF) -> list[str]:
    """Cut a text before white space, about every ``size`` code points."""
    out, at = [], 0
    while len(text) - at > size:
        m = SPACE.search(text, at + size)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


class DocumentCount:
    """The token count of one text under edits."""

    def __init__(self, pieces: list[str], tokens: list[int], own: ChunkEncoder):
        self.pieces, self.own = list(pieces), own
        self.points, self.tokens = SegmentTree([len(p) for p in pieces]), SegmentTree(tokens)
        self.encoded = 0  # leaves encoded again so far

    @classmethod
    def of(cls, text: str, own: ChunkEncoder) -> DocumentCount:
        pieces = leaves(text)
        return cls(pieces, np.diff(own.encode(pa.array(pieces, pa.large_string()))[0]).tolist(), own)

    @property
    def total(self) -> int:
        return self.tokens.total

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    def replace(self, start: int, end: int, text: str) -> None:
        """Put ``text`` in place of the code points [start, end)."""
        n = self.points.total
        start, end = max(0, min(start, n)), max(0, min(max(start, end), n))
        # The code points on both sides of the edit are its boundary context.
        first, before = self.points.find(max(0, start - 1)) if n else (0, 0)
        last, last_before = self.points.find(min(n - 1, end)) if n else (0, 0)
        region = "".join(self.pieces[first : last + 1])
        region = region[: start - before] + text + region[end - before :]
        self.pieces[first] = region
        self.points.update(first, len(region))
        self.tokens.update(first, len(self.own.encode(pa.array([region], pa.large_string()))[1]))
        for leaf in range(first + 1, last + 1):  # their text now stands in the first one
            self.pieces[leaf] = ""
            self.points.update(leaf, 0)
            self.tokens.update(leaf, 0)
        self.encoded += last - first + 1

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Edits of the text as it is now; neighbours in one leaf share a call.  Where they overlap,
        an edit begins where the one before it, by start and end, has ended."""
        groups: list[list[tuple[int, int, str]]] = []
        apart: list[tuple[int, int, str]] = []
        for s, e, text in sorted(edits, key=lambda e: (e[0], e[1])):
            s = max(s, apart[-1][1]) if apart else s
            apart.append((s, max(s, e), text))
        for e in apart:
            if groups and e[0] - groups[-1][-1][1] < LEAF // 4 and e[1] - groups[-1][0][0] < 4 * LEAF:
                groups[-1].append(e)
            else:
                groups.append([e])
        for group in reversed(groups):  # from the end, so that earlier positions hold
            lo, hi = group[0][0], max(e[1] for e in group)
            old = self._slice(lo, hi)
            new, at = [], lo
            for s, e, text in group:
                new += [old[at - lo : s - lo], text]
                at = e
            self.replace(lo, hi, "".join(new) + old[at - lo :])

    def _slice(self, lo: int, hi: int) -> str:
        if hi <= lo:
            return ""
        first, before = self.points.find(lo)
        out, size = [], 0
        while size < hi - before and first < len(self.pieces):
            out.append(self.pieces[first])
            size += len(out[-1])
            first += 1
        return "".join(out)[lo - before : hi - before]


def count_edited(docs: DataFrame, edits: Column, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_after, n_leaves, n_encoded (leaves encoded again).

    ``edits``: array of (start, end, text), in code points of the row's text; null or empty: none.
    Where edits overlap, the later start begins where the earlier edit has ended; of equal starts the
    one with the smaller end comes first.  Null and empty texts: no tokens, one empty leaf; very long
    ones are counted whole.  Null ids and repeated rows: each row is counted.  Empty table: empty
    result.  Other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        for batch in batches:
            texts, changes = as_array(batch.column(1)), as_array(batch.column(2))
            for lo, hi in slices(texts):
                pieces = [leaves(t or "") for t in texts.slice(lo, hi - lo).to_pylist()]
                ends = np.append(0, np.cumsum([len(p) for p in pieces]))
                bounds, _ = own.encode(pa.array([x for p in pieces for x in p], pa.large_string()))
                tokens, rows = np.diff(bounds), []
                for i, edit in enumerate(changes.slice(lo, hi - lo).to_pylist()):
                    counts = tokens[ends[i] : ends[i + 1]]
                    before = after = int(counts.sum())
                    encoded = 0
                    if edit:
                        tree = DocumentCount(pieces[i], counts.tolist(), own)
                        tree.apply([(e["start"], e["end"], e["text"] or "") for e in edit])
                        after, encoded = tree.total, tree.encoded
                    rows.append((before, len(edit or ()), after, len(pieces[i]), encoded))
                yield pa.record_batch(
                    [batch.column(0).slice(lo, hi - lo), *[pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]],
                    names=["doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_leaves", "n_encoded"],
                )

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), edits.alias("edits"))
    names = ("doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_leaves", "n_encoded")
    return slim.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


LEAVES = "doc_id bigint, key bigint, leaf int, points bigint, tokens bigint, text string"


def stored_leaves(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The leaves of all texts, to be written as a table: doc_id, key (digest of id and text as they
    were, which names the document from now on), leaf, points, tokens and text.

    Null and empty texts: one empty leaf.  Rows equal in id and text are one document.  Null ids:
    they are counted, but no edit names them.  Very long texts have as many leaves as they need.
    Other columns are ignored.  Empty table: empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        for batch in batches:
            texts = as_array(batch.column(2))
            for lo, hi in slices(texts):
                pieces = [leaves(t or "") for t in texts.slice(lo, hi - lo).to_pylist()]
                flat = [x for p in pieces for x in p]
                bounds, _ = own.encode(pa.array(flat, pa.large_string()))
                row = np.repeat(np.arange(lo, hi), [len(p) for p in pieces])
                yield pa.record_batch(
                    [
                        batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array([i for p in pieces for i in range(len(p))], pa.int32()),
                        pa.array([len(x) for x in flat], pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(flat, pa.string()),
                    ],
                    names=["doc_id", "key", "leaf", "points", "tokens", "text"],
                )

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    return slim.dropDuplicates(["doc_id", "key"]).mapInArrow(run, LEAVES)


def token_totals(table: DataFrame) -> DataFrame:
    """doc_id, key, n_tokens, n_points and n_leaves of each document of a table of leaves; of an empty one, none."""
    sums = [F.sum("tokens").alias("n_tokens"), F.sum("points").alias("n_points"), F.count(F.lit(1)).alias("n_leaves")]
    return table.groupBy("doc_id", "key").agg(*sums)


def edit_leaves(table: DataFrame, edits: DataFrame, tokenizer_path: str) -> DataFrame:
    """The table of leaves after ``edits`` (doc_id, start, end, text), in code points of the texts as
    they stand in the table.

    The sizes of the edited documents' leaves tell which leaves an edit touches, with a neighbour
    where it touches an end; only these are read as text, edited and encoded.  Edits outside a text
    are moved to its end; overlaps as in ``count_edited``, where edits of one place come in the order
    of their texts; equal edits are applied as often as they stand there.  Edits of unknown or null
    ids change nothing; null texts delete; without edits or leaves the table stays as it is.  Very
    long texts are read leaf by leaf.  Other columns of the edits are ignored.
    """
    asked = edits.where("doc_id IS NOT NULL").select("doc_id", F.col("start").cast("long"), F.col("end").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    # Equal edits stay apart by their numbers.
    asked = asked.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end", "text")))
    sizes = table.select("doc_id", "key", "leaf", "points").join(asked.select("doc_id").distinct(), "doc_id", "left_semi")
    own = Window.partitionBy("doc_id", "key")
    before = F.sum("points").over(own.orderBy("leaf").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("points")
    placed = sizes.select("doc_id", "key", "leaf", "points", before.alias("at"), F.sum("points").over(own).alias("n"))
    start = F.greatest(F.lit(0), F.least("start", "n"))
    end = F.greatest(start, F.least("end", "n"))
    pairs = placed.join(asked, "doc_id").withColumns({"s": start, "e": end}).where("at <= e AND at + points >= s")
    changes = F.sort_array(F.collect_set(F.struct("s", "e", "nth", "text"))).alias("edits")
    touched = saved(pairs.groupBy("doc_id", "key", "leaf", "at").agg(changes), "touched-leaves")
    work = table.join(touched, ["doc_id", "key", "leaf"])

    def run(leaves_of: pa.Table) -> pa.Table:
        encode = encoder(tokenizer_path)
        rows = sorted(leaves_of.to_pylist(), key=lambda r: r["leaf"])
        out, lo = [], 0
        while lo < len(rows):  # neighbouring leaves are a text of their own
            hi = lo + 1
            while hi < len(rows) and rows[hi]["leaf"] == rows[hi - 1]["leaf"] + 1:
                hi += 1
            run_of, first = rows[lo:hi], rows[lo]["at"]
            doc = DocumentCount([r["text"] for r in run_of], [r["tokens"] for r in run_of], encode)
            own = sorted({(e["s"] - first, e["e"] - first, e["nth"], e["text"]) for r in run_of for e in r["edits"]})
            doc.apply([(s, e, text) for s, e, _, text in own])
            out += [
                {**{c: r[c] for c in ("doc_id", "key", "leaf")}, "points": doc.points.value(i), "tokens": doc.tokens.value(i), "text": doc.pieces[i]}
                for i, r in enumerate(run_of)
            ]
            lo = hi
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        names = ["doc_id", "key", "leaf", "points", "tokens", "text"]
        return pa.table([pa.array([r[n] for r in out], k) for n, k in zip(names, kinds, strict=True)], names=names)

    changed = work.groupBy("doc_id", "key").applyInArrow(run, LEAVES)
    rest = table.join(touched.select("doc_id", "key", "leaf"), ["doc_id", "key", "leaf"], "left_anti")
    return rest.select(*changed.columns).unionByName(changed)
