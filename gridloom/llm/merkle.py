"""A Merkle manifest of a dataset: per source a hash trie over the rows by id, and one over the sources.

A row's place in its source decides where it hangs.  Places come from a radix trie of the ids:
histograms of id prefixes, each level counted from the one below, give every prefix the number of
rows before it, and only the few ids of a last prefix are ordered with one another.  Nothing is
sorted as a whole, and no task sees more than a prefix.

A place written to the base of the fanout keys the hash trie: nodes with a common prefix have a
common ancestor.  ``TIER`` digits are reduced at a time, longest prefix first: the nodes of a prefix
meet in one task, which hashes them up to their common ancestor, so 33 thousand million rows take
four shuffles and not 23, each a 2,187th of the one before.

Proofs come down the same way.  A prefix has one path (the siblings of its ancestors), which meets
the nodes below it once; leaves add their own siblings.  Paths are never copied to the rows.

Sources are ranked among each other by ranges of their names, and go through the same trie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions_for, saved

#: Nodes that become one, and levels that are reduced at a time (a task holds FANOUT ** TIER nodes).
FANOUT, TIER = 3, 7
#: Bits of an id that a last prefix leaves out, and of each digit above; the topmost prefix has 12.
LAST_BITS, DIGIT_BITS = 13, 13
SHIFTS = tuple(range(LAST_BITS, 64, DIGIT_BITS))  # 13, 26, 39, 52
#: Columns of a leaf, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def _part(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: dict[str, Column]) -> Column:
    """The digest of a row: each column as its length in bytes and its value, or ``-``."""
    return F.unhex(F.sha2(F.concat(*[_part(columns[c]) for c in COLUMNS]), 256))


def tampered_leaf(columns: dict[str, Column]) -> Column:
    """The digest of a row as it was tampered with: its text without line feeds, if the CRC-32 of its id is even."""
    even = F.crc32(F.coalesce(columns["doc_id"].cast("string"), F.lit("-")).cast("binary")) % 2 == 0
    cut = columns | {"text": F.replace(columns["text"], F.lit("\n"), F.lit(""))}
    return F.when(even & F.contains(columns["text"], F.lit("\n")), leaf_digest(cut))


def ranked_by_id(rows: DataFrame) -> DataFrame:
    """``rows`` (source, doc_id, leaf, m and others) with ``rank`` (rows of the source before it) and ``n`` (rows of the source).

    Ascending by id, nulls first, then by leaf.  ``m`` is how many rows one row stands for.
    """
    prefix = [F.coalesce(F.shiftright("doc_id", s), F.lit(-(1 << 62))) for s in SHIFTS]  # null is a prefix of its own, the first
    rows = rows.withColumns({f"_p{k}": p for k, p in enumerate(prefix)})
    names = [f"_p{k}" for k in range(len(SHIFTS))]
    counts = [rows.groupBy("source", *names).agg(F.sum("m").alias("c"))]
    for k in range(1, len(SHIFTS)):  # the histogram of a level comes from the one below
        counts.append(counts[-1].groupBy("source", *names[k:]).agg(F.sum("c").alias("c")))
    before = None
    for k in reversed(range(len(SHIFTS))):
        above = names[k + 1 :]
        within = Window.partitionBy("source", *above)
        first = F.sum("c").over(within.orderBy(names[k]).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c")
        level = counts[k].withColumn("_own", first)
        if before is None:
            before = level.withColumn("n", F.sum("c").over(within)).withColumnRenamed("_own", "_first").drop("c")
        else:
            joined = level.join(before, ["source", *above])
            before = joined.select("source", *names[k:], (F.col("_first") + F.col("_own")).alias("_first"), "n")
    cell = Window.partitionBy("source", *names).orderBy(F.col("doc_id").asc_nulls_first(), "leaf")
    own = F.sum("m").over(cell.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("m")
    out = rows.withColumn("_own", own).join(before, ["source", *names])
    return out.withColumn("rank", F.col("_first") + F.col("_own")).drop("_own", "_first", *names)


def ranked_by_name(names: DataFrame) -> DataFrame:
    """``names`` (distinct ``source`` and others) with ``rank`` among all of them, bytewise.

    Ranges of names are ordered one by one; the counts of the ranges, as many as there are
    partitions, give each its first rank.
    """
    held = names.repartitionByRange(partitions_for(names), "source").withColumn("_range", F.spark_partition_id())
    held = saved(held, "merkle-sources")
    counts = held.groupBy("_range").agg(F.count(F.lit(1)).alias("c"))  # a row for each partition
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    firsts = counts.select("_range", (F.sum("c").over(upto) - F.col("c")).alias("_first"))
    within = Window.partitionBy("_range").orderBy("source")
    return held.withColumn("_own", F.row_number().over(within) - 1).join(F.broadcast(firsts), "_range").withColumn("rank", F.col("_first") + F.col("_own")).drop("_range", "_first", "_own")


def digest(parts: list[bytes]) -> bytes:
    """H of digests, as hexadecimal text."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def levels_of(nodes: list[bytes], up: int) -> list[list[bytes]]:
    """The nodes of a prefix, and what they become on each of ``up`` levels."""
    out = [nodes]
    for _ in range(up):
        last = out[-1]
        out.append([digest(last[i : i + FANOUT]) for i in range(0, len(last), FANOUT)])
    return out


def height(n: int) -> int:
    """Levels from so many nodes up to one."""
    out = 0
    while n > 1:
        n, out = -(-n // FANOUT), out + 1
    return out


def siblings(levels: list[list[bytes]], i: int) -> str:
    """The siblings of a node on the way up, level by level, left to right."""
    out = []
    for nodes in levels[:-1]:
        a = i - i % FANOUT
        out += [nodes[k].hex() for k in range(a, min(a + FANOUT, len(nodes))) if k != i]
        i //= FANOUT
    return "".join(out)


def folded(leaf: bytes, path: str, spots: list[tuple[int, int]]) -> str:
    """The root that a leaf and a path give; ``spots``: the rank and the number of nodes of each trie on the way."""
    now, at = leaf.hex(), 0
    for rank, n in spots:
        while n > 1:
            digit, run = rank % FANOUT, min(FANOUT, n - (rank - rank % FANOUT))
            others = path[at : at + 64 * (run - 1)]
            now = hashlib.sha256((others[: 64 * digit] + now + others[64 * digit :]).encode()).hexdigest()
            at += 64 * (run - 1)
            rank, n = rank // FANOUT, -(-n // FANOUT)
    return now


def _by_prefix(rows: DataFrame, digits: int, *order: str) -> DataFrame:
    """Rows (source, rank) with those of one prefix of ``digits`` digits fewer together and in order."""
    rows = rows.withColumn("prefix", F.floor(F.col("rank") / FANOUT**digits))
    return rows.repartition(partitions_for(rows), "source", "prefix").sortWithinPartitions("source", "prefix", *order)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows by (source, prefix), from batches in which those stand together."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = row["source"], row["prefix"]
            if key != now and held:
                yield held
                held = []
            now = key
            held.append(row)
    if held:
        yield held


def _reduce(tier: int, digits: int):
    """Nodes of a tier to nodes of the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            up = min(digits, height(rows[0]["n"]) - digits * tier)
            top = levels_of([r["node"] for r in rows], up)[-1][0]
            yield pa.RecordBatch.from_pylist([{"source": rows[0]["source"], "rank": rows[0]["prefix"], "n": rows[0]["n"], "node": top}], schema=_NODES)

    return run


_NODES = pa.schema([("source", pa.string()), ("rank", pa.int64()), ("n", pa.int64()), ("node", pa.binary())])


def climb(nodes: DataFrame, name: str, digits: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes (source, rank, n, node) of each tier, and the last node of each source."""
    tiers, tops = [nodes.select("source", "rank", "n", "node")], []
    most = nodes.agg(F.max("n")).first()[0] or 0
    for tier in range(max(1, -(-height(most) // digits))):
        made = _by_prefix(tiers[-1], digits, "rank").mapInArrow(_reduce(tier, digits), "source string, rank bigint, n bigint, node binary")
        made = saved(made, f"merkle-{name}-{tier}")
        reach = FANOUT ** (digits * (tier + 1))
        tops.append(made.where(F.col("n") <= reach))
        tiers.append(made.where(F.col("n") > reach))
    top = tops[0]
    for t in tops[1:]:
        top = top.union(t)
    return tiers[:-1], top.select("source", "n", F.col("node").alias("subroot"))


#: What comes down: the path above a prefix, the roots, the source's own place and number of nodes, and how many sources there are.
_PATH = "source string, rank bigint, n bigint, path string, subroot binary, root binary, place bigint, places bigint"


def _descend(tier: int, digits: int, leaves: bool):
    """A prefix's path and its nodes to the nodes' paths; from leaves, to their rows."""
    paths = pa.schema([
        ("source", pa.string()), ("rank", pa.int64()), ("n", pa.int64()), ("path", pa.string()), ("subroot", pa.binary()),
        ("root", pa.binary()), ("place", pa.int64()), ("places", pa.int64()),
    ])
    rows_out = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for above, *nodes in _groups(batches):  # the path stands first
            up = min(digits, height(above["n"]) - digits * tier)
            levels = levels_of([r["node"] for r in nodes], up)
            out = []
            for i, r in enumerate(nodes):
                path = siblings(levels, i) + above["path"]
                if not leaves:
                    out.append({k: above[k] for k in ("source", "n", "subroot", "root", "place", "places")} | {"rank": r["rank"], "path": path})
                    continue
                root = above["root"].hex()
                got = folded(r["bad"] or r["node"], path, [(r["rank"], above["n"]), (above["place"], above["places"])])
                out.append({
                    "doc_id": r["doc_id"], "source": above["source"], "leaf": r["node"].hex(), "subroot": above["subroot"].hex(), "root": root,
                    "proof_sha256": hashlib.sha256(path.encode()).hexdigest(), "folded_root": got, "verified": got == root,
                })
            yield pa.RecordBatch.from_pylist(out, schema=rows_out if leaves else paths)

    return run


_ROWS = "doc_id bigint, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def descend(tiers: list[DataFrame], starts: DataFrame, digits: int, rows: DataFrame | None = None) -> DataFrame:
    """Paths (``_PATH``) of the first tier's nodes, or the rows of the manifest if ``rows`` are given.

    ``starts``: a path of each source's last node, from which it goes down.
    """
    begun = starts.withColumn("tier", F.expr("CASE " + " ".join(f"WHEN n <= {FANOUT ** (digits * (t + 1))} THEN {t}" for t in range(len(tiers))) + " END"))
    came = None
    for tier in reversed(range(len(tiers))):
        leaves = rows is not None and tier == 0
        paths = begun.where(F.col("tier") == tier).drop("tier")
        # A path's own rank is the prefix of the nodes below it.
        paths = paths if came is None else paths.unionByName(came)
        paths = paths.withColumn("first", F.lit(0)).withColumn("prefix", F.col("rank"))
        own = rows if leaves else tiers[tier]
        own = own.withColumn("first", F.lit(1)).withColumn("prefix", F.floor(F.col("rank") / FANOUT**digits)).drop("n")
        both = paths.unionByName(own, allowMissingColumns=True)
        both = both.repartition(partitions_for(both), "source", "prefix").sortWithinPartitions("source", "prefix", "first", "rank")
        came = both.mapInArrow(_descend(tier, digits, leaves), _ROWS if leaves else _PATH)
        if tier:
            came = saved(came, "merkle-paths")
    return came


def manifest(docs: DataFrame, digits: int = TIER) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    ``docs`` has the five ``COLUMNS``.  Null values of any of them count as ``-`` in the leaf; null
    sources are a source of their own, the first, and null ids come first in their source, where
    the CRC of ``-`` decides on tampering.  Repeated rows: each is a leaf, and those equal in all
    five columns follow each other; rows of one id are ordered by leaf.  Empty texts are empty, not
    null.  Very long texts are hashed whole.  Empty table: empty result.  Other columns are ignored,
    whatever their names.  ``digits``: the levels that one task hashes at a time.
    """
    columns = {c: F.col(c) for c in COLUMNS}
    key = F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("0"))  # null is the first
    slim = docs.select(key.alias("source"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(columns).alias("leaf"), tampered_leaf(columns).alias("bad"))
    # Rows equal in all columns count once until they have their places.
    leaves = saved(slim.groupBy("source", "doc_id", "leaf", "bad").agg(F.count(F.lit(1)).alias("m")), "merkle-leaves")
    placed = ranked_by_id(leaves)
    parts = F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(1 << 16).cast("long"))  # copies, in runs of bounded arrays
    placed = placed.withColumn("_run", F.explode(parts))
    placed = placed.withColumn("_copy", F.explode(F.sequence(F.col("_run"), F.least(F.col("_run") + (1 << 16), F.col("m")) - 1)))
    placed = placed.select("source", (F.col("rank") + F.col("_copy")).alias("rank"), "n", F.col("leaf").alias("node"), "doc_id", "bad")
    placed = saved(placed, "merkle-placed")

    tiers, subroots = climb(placed, "rows", digits)
    named = ranked_by_name(subroots)
    places = named.count()
    named = saved(named.withColumn("places", F.lit(places).cast("long")), "merkle-named")
    every = named.select(F.lit("").alias("source"), "rank", F.col("places").alias("n"), F.col("subroot").alias("node"))
    upper, top = climb(every, "sources", digits)
    start = top.select("source", F.lit(0).cast("long").alias("rank"), "n", F.lit("").alias("path"), "subroot", F.col("subroot").alias("root"), F.lit(0).cast("long").alias("place"), F.lit(1).cast("long").alias("places"))
    above = descend(upper, start, digits).select(F.col("rank").alias("place"), "path", "root")
    starts = named.withColumnRenamed("rank", "place").join(above, "place")
    starts = starts.select("source", F.lit(0).cast("long").alias("rank"), "n", "path", "subroot", "root", "place", "places")
    out = descend(tiers, saved(starts, "merkle-starts"), digits, placed)
    source = F.when(F.col("source") != "0", F.substring("source", 2, 1 << 30))
    return out.withColumn("source", source)
