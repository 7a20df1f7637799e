"""Line dedup by winnowing over line hashes.

A shingle is the fewest lines from a non-blank line on that hold ``SHINGLE`` words; its key is a
hash of their line hashes.  Windows are the fewest lines from each line on that hold ``GUARANTEE``
words, and the shingle of least key within a window is a fingerprint.  So any run of lines with
``GUARANTEE`` words that two documents share holds a fingerprint that both have, and every match
has at least ``SHINGLE`` words.  A line that holds ``SHINGLE`` words alone is always a fingerprint,
whatever stands around it and however short the document is, so each of its repeats is found.

The first place of each fingerprint, by (doc_id, row key, line), comes from grouped minima, and
every other place is matched with the first one only: a line that a third of all documents hold
costs a row each.  (So a run of short lines that two documents share stays in the later one if each
of its fingerprints stood elsewhere before.)  A match is extended both ways over equal lines, and the run is deleted from the
later document.  So of a repeated run no line of ``SHINGLE`` words and no stretch of ``GUARANTEE`` words is left whole, a deleted
line always stands in an earlier place, and the first occurrence of every line is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_array, saved, tidy
from .native import let

SHINGLE, GUARANTEE = 6, 24


def line_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash (0 for a blank line) and the number of words of each \\n-split line."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    counts = np.array([len(x.split()) for x in lines], np.int64)
    out = np.array([xxhash.xxh3_64_intdigest(x.strip(b" \t\x0b\x0c\r")) or 1 for x in lines], np.uint64)
    out[counts == 0] = 0
    return out, counts


def fingerprints(hashes: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """(line, key) of the shingles that are one line, or the (rightmost) least of some window."""
    real = np.flatnonzero(counts > 0)
    sums = np.append(0, np.cumsum(counts[real]))
    # A shingle or window from line i ends with the first line at which it holds enough words.
    ends = np.searchsorted(sums, sums[:-1] + SHINGLE, "left").tolist()
    spans = np.searchsorted(sums, sums[:-1] + GUARANTEE, "left").tolist()
    n = len(real)
    keys = [xxhash.xxh3_64_intdigest(hashes[real[i] : real[j - 1] + 1].tobytes()) if j <= n else None for i, j in enumerate(ends)]
    found = {i: keys[i] for i in np.flatnonzero(counts[real] >= SHINGLE).tolist()}
    for i, span in enumerate(spans):
        if span > n:
            break
        best, p = i, i + 1
        while p < n and ends[p] <= span:
            if keys[p] <= keys[best]:
                best = p
            p += 1
        found[best] = keys[best]
    return [(int(real[i]), k - (1 << 63)) for i, k in sorted(found.items())]


def extend(own: np.ndarray, other: np.ndarray, at: int, there: int) -> tuple[int, int]:
    """The longest run [start, end) of ``own`` around ``at`` that equals ``other`` around ``there``."""
    n = min(len(own) - at, len(other) - there)
    differ = np.flatnonzero(own[at : at + n] != other[there : there + n])
    end = at + (int(differ[0]) if len(differ) else n)
    n = min(at, there)
    differ = np.flatnonzero(own[at - n : at][::-1] != other[there - n : there][::-1])
    start = at - (int(differ[0]) if len(differ) else n)
    return start, end


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines, prints = [], []
        for text in as_array(batch.column(2)).to_pylist():
            h, c = line_hashes(text or "")
            lines.append(h.tobytes())
            prints.append([{"h": k, "at": i} for i, k in fingerprints(h, c)])
        kind = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32())]))
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(lines, pa.binary()), pa.array(prints, kind)], names=["id", "key", "lines", "prints"]
        )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, lines, other lines, matches) to the runs to delete."""
    for batch in batches:
        keys, runs = [], []
        own_lines, others, matches = (batch.column(i).to_pylist() for i in range(1, 4))
        for i, key in enumerate(batch.column(0).to_pylist()):
            own, other = np.frombuffer(own_lines[i], np.uint64), np.frombuffer(others[i], np.uint64)
            got: list[dict] = []
            done: dict[int, int] = {}  # by shift: the end of the last run, whose inner matches need no look
            for m in sorted(matches[i], key=lambda m: (m["at"], m["there"])):
                shift = m["at"] - m["there"]
                if m["at"] < done.get(shift, -1):
                    continue
                start, end = extend(own, other, m["at"], m["there"])
                done[shift] = end
                got.append({"s": start, "e": end})
            keys.append(key)
            runs.append(got)
        kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(runs, kind)], names=["key", "runs"])


def repeated_runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, runs): the line ranges to delete from the rows whose (id, text) have that key."""
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    kind = "id bigint, key bigint, lines binary, prints array<struct<h:bigint,at:int>>"
    profile = saved(keyed.mapInArrow(tidy(_profile), kind), "lines")
    places = profile.select("id", "key", F.explode("prints").alias("p")).select("id", "key", "p.h", "p.at").distinct()
    place = F.struct("id", "key", "at")
    firsts = places.groupBy("h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Written, so that the join reads shuffles alone and the places of a very common line can be split.
    firsts = saved(firsts.select("h", "first"), "line-firsts")
    later = places.join(firsts.hint("merge"), "h").where(place != F.col("first"))
    later = later.select("key", "at", F.col("first.key").alias("other"), F.col("first.at").alias("there"))
    by_pair = later.groupBy("key", "other").agg(F.collect_list(F.struct("at", "there")).alias("matches"))
    # Copies of a row have one key and one profile.  Written, so that the joins read shuffles alone
    # and a document that is the first for very many can be split.
    lines = saved(profile.groupBy("key").agg(F.first("lines").alias("lines")), "line-hashes")
    both = by_pair.join(lines, "key").join(lines.select(F.col("key").alias("other"), F.col("lines").alias("there_lines")), "other")
    found = both.select("key", "lines", "there_lines", "matches").mapInArrow(tidy(_runs), "key bigint, runs array<struct<s:int,e:int>>")
    return found.groupBy("key").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, text, n_lines, n_removed): ``row`` is the struct of all columns of ``docs``, whatever
    their names, ``text`` what is left of the text.

    Documents are ordered by id, then by row key; nulls come first.  Rows equal in id and text are
    one document, and each gets the same result.  Null texts stay null with no lines, empty ones
    stay empty, and very long ones are worked on whole.  A repeat within one document is a repeat.
    Empty table: empty result.  All columns of ``docs`` travel in ``row``, so their names clash with
    none.
    """
    runs = saved(repeated_runs(docs, id_col, text_col), "line-runs")
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64(id_col, text_col).alias("key"))
    text = F.col("row")[text_col]
    lines = F.split(text, "\n", -1)
    # Sets of line numbers, so that a long text costs its lines and not its lines times its runs.
    gone = F.array_distinct(F.flatten(F.transform(F.filter("runs", lambda r: r["e"] > r["s"]), lambda r: F.sequence(r["s"], r["e"] - 1))))
    # Every document may have runs, so they are joined by shuffle at every size.
    out = keyed.join(runs.withColumn("gone", gone).drop("runs").hint("merge"), "key", "left")
    left = let(lines, lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone")), lambda i: F.get(x, i)))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_removed = F.coalesce(F.when(text.isNotNull(), F.size("gone")), F.lit(0)).cast("long")
    return out.select(
        "row",
        F.when(F.col("gone").isNull() | (F.size("gone") == 0), text).otherwise(F.array_join(left, "\n")).alias("text"),
        n_lines.alias("n_lines"),
        n_removed.alias("n_removed"),
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with repeated runs taken out of the texts and ``size_col``, if there, counted anew.

    A row that loses all its words is dropped; a row that had none stays as it is.  Nulls, ties,
    repeated rows, very long texts, clashing names and empty tables: as in ``dedup_lines``.
    """
    out = dedup_lines(docs, id_col, text_col)
    has_words = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    out = out.where((F.col("n_removed") == 0) | has_words)
    new = {text_col: F.col("text"), size_col: F.when(F.col("n_removed") == 0, F.col("row")[size_col]).otherwise(F.length("text")) if size_col in docs.columns else None}
    kinds = dict(docs.dtypes)
    return out.select(*[(new[c].cast(kinds[c]) if new.get(c) is not None else F.col("row")[c]).alias(c) for c in docs.columns])
