"""Exact dedup by two-pass Bloom filtering, in DataFrame operations only.

Texts are equal when they are identical without white space (space and U+0009 to U+000D).  Of equal
texts the one with the most code points stays, then that of the least id.

The first pass sets bits: each row's digest names a few slots of a filter, and a slot that at least
two rows name stays set.  A row is possibly repeated if all its slots are set, so every row with a
copy is, and few others.  What the first pass shuffles is numbers of slots, summed up before they
travel.  The second pass looks each row's slots up in the filter.  Rows with a slot that is not set
have no copy: they pass straight through.  Only the others are shuffled, by digest.

The filter has a fixed largest size (``MAX_BITS``), which bounds the broadcast however many rows
there are.  A corpus of more rows than the filter holds well makes more rows possibly repeated; that
costs a shuffle of digests and changes no result.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, partitions_for, saved

#: Bits of the filter for each row, and at most: 128 MB.
BITS_PER_ROW, MAX_BITS = 16, 1 << 30
#: Slots that a digest names.
HASHES = 2
#: The filter is kept in words of 64 bits and pages of so many words.
WORD, PAGE = 64, 512


def squeezed(text: Column) -> Column:
    """A text without white space; null counts as empty."""
    return functools.reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SPACES, F.coalesce(text, F.lit("")))


def filter_bits(rows: int, per_row: int = BITS_PER_ROW, most: int = MAX_BITS) -> int:
    """The size of a filter for so many rows: a power of two, a page at least."""
    wanted = 1 << max(0, rows * per_row - 1).bit_length()
    return max(WORD * PAGE, min(most, wanted))


def _slot(digest: Column, number: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(number)), F.lit(bits))


def repeated_slots(digests: DataFrame, bits: int, hashes: int = HASHES) -> DataFrame:
    """The filter as pages (page, words) of the slots that two rows or more of ``digests`` (sha) name.

    At most ``bits`` / 8 bytes.
    """
    slots = F.array_distinct(F.array(*[_slot(F.col("sha"), n, bits) for n in range(hashes)]))
    named = digests.select(F.explode(slots).alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    word = F.floor(F.col("slot") / WORD)
    words = named.groupBy(word.alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(slot % {WORD} as int)))").alias("bits"))
    held = F.map_from_entries(F.collect_list(F.struct((F.col("word") % PAGE).cast("int").alias("at"), "bits")))  # a page at most
    pages = words.groupBy(F.floor(F.col("word") / PAGE).alias("page")).agg(held.alias("held"))
    every = F.sequence(F.lit(0), F.lit(PAGE - 1))
    return pages.select("page", F.transform(every, lambda i: F.coalesce(F.element_at("held", i), F.lit(0).cast("long"))).alias("words"))


def possibly_repeated(rows: DataFrame, pages: DataFrame, bits: int, hashes: int = HASHES) -> DataFrame:
    """``rows`` (with the digest ``sha``) with ``again``: whether the filter has all of a row's slots."""
    again = F.lit(True)
    for n in range(hashes):
        page, words = f"_page{n}", f"_words{n}"
        rows = rows.withColumn(f"_slot{n}", _slot(F.col("sha"), n, bits)).withColumn(page, F.floor(F.col(f"_slot{n}") / (WORD * PAGE)))
        rows = rows.join(F.broadcast(pages.select(F.col("page").alias(page), F.col("words").alias(words))), page, "left")
        inside = (F.col(f"_slot{n}") % (WORD * PAGE)).cast("int")
        bit = F.getbit(F.element_at(words, F.floor(inside / WORD).cast("int") + 1), inside % WORD)
        again = again & (F.coalesce(bit, F.lit(0)) == 1)
    own = [c for c in rows.columns if not c.startswith(("_page", "_words", "_slot"))]
    return rows.select(*own, again.alias("again"))


def _first(id_col: str, tie: str) -> Column:
    """What is least in the row that stays."""
    return F.struct((-F.col("n_points")).alias("n"), F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(tie).alias("tie"))


def mark_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_BITS
) -> DataFrame:
    """doc_id, keep_id (the row that stays), group_size, kept and text_sha256 of every row.

    Null texts and those of white space alone equal the empty text and are copies of each other.
    Null ids take part and come after all ids; keep_id is null only where no row of a longest text
    has an id.  Repeated rows: each gets its row and one of them is kept.  Very long texts are read
    whole.  Empty table: empty result.  Other columns are ignored, whatever their names.
    """
    text = F.col(text_col)
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        F.unhex(F.sha2(squeezed(text), 256)).alias("sha"),
        F.coalesce(F.length(text), F.lit(0)).alias("n_points"),
        F.monotonically_increasing_id().alias("row"),
    )
    slim = saved(slim, "exact-digests")  # the texts are read once, and a row's number stays
    bits = filter_bits(slim.count(), bits_per_row, max_bits)
    pages = saved(repeated_slots(slim, bits), "exact-filter")
    marked = possibly_repeated(slim, pages, bits)

    sha = F.lower(F.hex("sha")).alias("text_sha256")
    alone = marked.where(~F.col("again")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha
    )
    # A group of very many copies is dealt to as many parts as there are partitions.
    salts = partitions_for(docs)
    some = marked.where("again").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    parts = some.groupBy("sha", "salt").agg(F.min(_first("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("n"))
    whole = parts.groupBy("sha").agg(F.min("best").alias("best"), F.sum("n").alias("group_size"))
    spread = parts.select("sha", "salt").join(whole.hint("merge"), "sha")
    found = some.join(spread.hint("merge"), ["sha", "salt"])
    copies = found.select("doc_id", F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.tie")).alias("kept"), sha)
    return alone.unionByName(copies)


def without_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_BITS
) -> DataFrame:
    """The rows of ``docs``, all columns as they are, with one row of each group of equal texts.

    Which one, and what nulls, empty and very long texts and repeated rows do, is as in
    ``mark_copies``; of rows equal in id and length the one of least row digest stays.  Rows that
    the filter clears are not shuffled.
    """
    text = F.col(text_col)
    packed = docs.select(
        F.struct("*").alias("row"),
        F.unhex(F.sha2(squeezed(text), 256)).alias("sha"),
        F.coalesce(F.length(text), F.lit(0)).alias("n_points"),
        F.col(id_col).alias("id"),
        F.xxhash64(*docs.columns).alias("tie"),
    )
    digests = saved(packed.select("sha"), "exact-digests")
    bits = filter_bits(digests.count(), bits_per_row, max_bits)
    marked = possibly_repeated(packed, saved(repeated_slots(digests, bits), "exact-filter"), bits)
    # The least row of a group is found before the shuffle and after it: a part sends one row.
    best = marked.where("again").groupBy("sha").agg(F.min_by("row", _first("id", "tie")).alias("row"))
    return marked.where(~F.col("again")).select("row.*").unionByName(best.select("row.*"))
