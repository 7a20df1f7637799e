"""Column-building helpers for operators that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: characters other than space and U+0009 to U+000D.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for each row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK, -1), "")


def prefix_sums(sizes: Column, block: int = 128) -> Column:
    """Sums of the elements before each element of a long array, in two levels of blocks."""
    empty = F.array().cast("array<bigint>")

    def running(values: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))
        return F.aggregate(
            values, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"]).alias("out"))
        )["out"]

    n_blocks = F.ceil(F.size(sizes) / block).cast("int")
    parts = F.when(F.size(sizes) == 0, F.array().cast("array<array<bigint>>")).otherwise(
        F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda i: F.slice(sizes, i * block + 1, block))
    )

    def joined(p: Column) -> Column:
        totals = F.transform(p, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda s, x: s + x))
        firsts = running(totals)
        return F.flatten(F.zip_with(p, firsts, lambda b, first: F.transform(running(b), lambda x: x + first)))

    return let(parts, joined)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of a pattern: array of (start, end, hit) in code points.

    The pattern must not match the empty string.  Positions come from the lengths of what lies
    between the matches, so the text is searched a second time only where there is a match.
    """
    pat = F.lit(pattern)
    none = F.array().cast("array<struct<start:bigint,end:bigint,hit:string>>")

    def placed(hits: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        steps = F.zip_with(
            F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: (F.length(g) + F.length(h)).cast("long")
        )

        def rows(s: Column) -> Column:
            ends = F.zip_with(prefix_sums(s), s, lambda a, b: a + b)
            return F.zip_with(
                ends, hits, lambda e, h: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("hit"))
            )

        return F.when(F.size(hits) == 0, none).otherwise(let(steps, rows))

    return let(F.regexp_extract_all(text, pat, 0), placed)
