"""N-gram Jaccard join by prefix trees, giving the components of the linked documents.

A document's set holds its distinct word n-grams.  Two sets of sizes m and n link when
|A & B| >= t |A | B|, which asks for an overlap of at least t / (1 + t) (m + n).

1. One pass makes the sets, names each by a digest (equal sets, so all exact copies, are one node
   from here on), and reports locally frequent n-grams.  Their totals, at most ``frequent`` rows,
   fix the global order: rare n-grams by hash, then the frequent ones by rising count.  Any fixed
   order gives the same links; this one keeps shared passages out of the prefixes.
2. Two linked sets share an n-gram within the first n - ceil(t n) + 1 of each.  These prefixes go
   to buckets of n-grams as packed arrays; an n-gram of very many sets is dealt to several buckets.
   A small group yields its pairs that pass the length bound; a large one yields each member's
   pairs with the group's first sets, and its member list.  A pair's common n-grams in the
   prefixes bound its overlap from above.
3. The join itself is by radix tries.  A block holds a trie of sets, stored in global order from
   the frequent end, and the sets that probe it.  A probe walks the trie, counts each shared path
   once, and leaves a subtree when the overlap so far plus what can remain is below the least
   overlap asked for there, or when all of it is in the probe's own component.  A block yields a
   spanning forest of what it has found, never pairs: one row for each merging of components.
4. The first tries hold, for each set, the partner that most of its prefix names; components of
   these links are found.  Pairs of small groups that are still apart probe each other.  Members of
   a large group's list that are still in several components meet in blocks of bitmaps first: bit i
   of a set's bitmap is the parity of its n-grams with hash i modulo the bitmap's length, so two
   bitmaps differ in at most as many bits as the sets do in n-grams, which bounds the overlap.  The
   sets of a block that have such a possible partner are its trie and its probes.  Two sets that
   share several lists meet in the largest one only.  A pair inside one component cannot change it,
   so no link is lost, and copies of one text, however many, cost a row each instead of a pair each.

The sides of all joins grow with the corpus, so they are joined by shuffle at every size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_array, forget, mix, partitions_for, saved, slices, tidy, word_hashes
from .components import connected_components

#: Largest lists of each set that its pairs are looked for first.
TOPS = 4
#: Probes that walk a trie together.
TOGETHER = 32
#: Bits of the bitmap that tells which texts a verification needs.
BITMAP = 1 << 23


@dataclass(frozen=True)
class Limits:
    """Sizes at which work is cut up; no link depends on them.  They travel to the workers."""

    #: Most frequent n-grams that the global order places one by one (16 bytes each on the driver).
    frequent: int = 1 << 17
    #: An n-gram is reported as frequent by a segment of documents that holds it so often.
    least_count: int = 8
    least_share: float = 1 / 500
    segment: int = 2_000_000
    #: A group of at most this many sets yields its pairs; a larger one yields a star and its list.
    small: int = 8
    #: Sets that stand first in a large group, by name; all of a family's copies meet the same ones.
    leaders: int = 8
    #: Sets in a block's trie, sets that probe it, and n-grams of either.
    block: int = 512
    probes: int = 4096
    tokens: int = 1 << 22
    #: Prefix entries of one n-gram in one bucket; an n-gram with more is dealt to several.
    hot: int = 1 << 17


LIMITS = Limits()
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def shingle_sets(texts: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; fewer than k words: the sequence as one."""
    bounds, h = word_hashes(texts)
    n, lag = len(h), 1
    with np.errstate(over="ignore"):
        grams = mix(h + np.uint64(k))
        for lag in range(1, k):
            m = max(0, n - lag)
            grams[:m] = mix(grams[:m] * MULTIPLIERS[lag % 4] + h[lag:][:m])
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo >= k:
                yield np.unique(grams[lo : hi - k + 1])
            elif hi > lo:
                yield np.array([xxhash.xxh3_64_intdigest(h[lo:hi].tobytes(), seed=1)], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def set_id(grams: np.ndarray) -> int:
    """A set's name: a 64-bit digest as a signed integer; 0 for the empty set."""
    if not len(grams):
        return 0
    return xxhash.xxh3_64_intdigest(grams.tobytes(), seed=len(grams)) - (1 << 63) or 1


def parities(grams: np.ndarray) -> np.ndarray:
    """A bitmap of one to two bits for each n-gram, in words of 64: the parity of the n-grams of each slot.

    Its length is a power of two, so the exclusive or of its halves is the bitmap of half the length.
    """
    width = max(64, 1 << (max(1, len(grams)) - 1).bit_length())
    odd = np.bincount((grams & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<u8")


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (along the last axis) at a shorter length."""
    while bits.shape[-1] > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


class Order:
    """The global order: rare n-grams by hash, then frequent ones by rising count."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, limits: Limits):
        self.limits = limits
        by_count = np.lexsort((hashes, counts))
        rank = np.empty(len(hashes), np.int64)
        rank[by_count] = np.arange(len(hashes))
        by_hash = np.argsort(hashes)
        self.hashes, self.rank = hashes[by_hash], rank[by_hash]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        hot = counts > limits.hot
        by = np.argsort(hashes[hot])
        self.hot, self.hot_counts = hashes[hot][by], counts[hot][by]

    def arrange(self, grams: np.ndarray) -> np.ndarray:
        """Sorted hashes to the global order."""
        if not len(self.hashes):
            return grams
        maybe = np.flatnonzero(self.maybe[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, grams[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == grams[maybe]
        where = maybe[hit]
        if not len(where):
            return grams
        frequent = grams[where][np.argsort(self.rank[at[hit]], kind="stable")]
        return np.concatenate((np.delete(grams, where), frequent))

    def dealt(self, grams: np.ndarray, sids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and salts of prefix entries: one row each, with salt 0, unless the n-gram is hot.

        A hot n-gram's entries are dealt by set.  The sets with the least digests, some leaders of
        them, go to all salts, so that every salt's members meet the same first sets.  Counts are of
        rows: where most are copies of few sets, a salt may hold very few, and no leader.  So the
        members of every salt are listed, however few they are, and meet in the n-gram's list.
        """
        row, salt = np.arange(len(grams)), np.zeros(len(grams), np.int64)
        if not len(self.hot):
            return row, salt
        at = np.minimum(np.searchsorted(self.hot, grams), len(self.hot) - 1)
        hit = np.flatnonzero(self.hot[at] == grams)
        count = self.hot_counts[at[hit]]
        salts = -(-count // self.limits.hot)
        salt[hit] = (mix(sids[hit].view(np.uint64)) % salts.astype(np.uint64)).astype(np.int64)
        first = sids[hit] / 2.0**64 + 0.5 < 4 * self.limits.leaders / count
        copies = salts[first] - 1
        more = np.repeat(hit[first], copies)
        turn = np.arange(len(more)) - np.repeat(np.cumsum(copies) - copies, copies) + 1
        salt[hit[first]] = 0
        return np.append(row, more), np.append(salt, turn)


def required(m: np.ndarray | int, n: np.ndarray | int, t: Fraction) -> np.ndarray | int:
    """The least overlap of linked sets of these sizes: ceil(t (m + n) / (1 + t))."""
    a, b = t.numerator, t.numerator + t.denominator
    return -((-a * (m + n)) // b)


def _sets(table: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    texts = as_array(table.column(1))
    for lo, hi in slices(texts):
        yield from zip(range(lo, hi), shingle_sets(texts.slice(lo, hi - lo), k), strict=True)


def _profile(k: int, limits: Limits):
    """(doc_id, text, key) to rows of kind 0 (doc_id, size, set, key, bitmap) and 1 (n-gram, local count)."""

    def frequent(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        if not held:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        keep = counts >= max(limits.least_count, len(held) * limits.least_share)
        return values[keep], counts[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*[(c, pa.int64()) for c in ("kind", "id", "n", "sid", "key")], ("bits", pa.binary())])

        def out(kind: int, *columns, bits: list[bytes] | None = None) -> pa.RecordBatch:
            size = len(columns[1])
            numbers = [pa.array(c, pa.int64()) for c in (np.full(size, kind), *columns)]
            return pa.record_batch([*numbers, pa.nulls(size, pa.binary()) if bits is None else pa.array(bits, pa.binary())], schema=schema)

        held: list[np.ndarray] = []
        seen: set[int] = set()  # copies within a segment count once
        total = 0
        for batch in batches:
            n, sid, bits = [], [], []
            for _, grams in _sets(batch, k):
                n.append(len(grams))
                sid.append(set_id(grams))
                bits.append(parities(grams).tobytes())
                if sid[-1] in seen:
                    continue
                seen.add(sid[-1])
                held.append(grams)
                total += len(grams)
                if total >= limits.segment:
                    v, c = frequent(held)
                    yield out(1, v.view(np.int64), c, c, c)
                    held, total = [], 0
                    seen.clear()
            yield out(0, batch.column(0), n, sid, batch.column(2), bits=bits)
        v, c = frequent(held)
        yield out(1, v.view(np.int64), c, c, c)

    return run


def _prefixes(k: int, t: Fraction, order, n_buckets: int):
    """(doc_id, text) to packed prefixes: rows (bucket, n-grams, sets, sizes)."""
    schema = pa.schema([("bucket", pa.int32()), ("grams", pa.binary()), ("sids", pa.binary()), ("sizes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrange = order.value.arrange
        seen: set[int] = set()
        parts: list[tuple[np.ndarray, int, int]] = []
        rows = 0

        def flush() -> pa.RecordBatch:
            grams = np.concatenate([p[0] for p in parts])
            each = [len(p[0]) for p in parts]
            sids = np.repeat(np.array([p[1] for p in parts], np.int64), each)
            sizes = np.repeat(np.array([p[2] for p in parts], np.uint32), each)
            row, salt = order.value.dealt(grams, sids)
            grams, sids, sizes = grams[row], sids[row], sizes[row]
            bucket = (((grams % np.uint64(n_buckets)).astype(np.int64) + salt) % n_buckets).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[by], np.arange(n_buckets + 1))
            some = [b for b in range(n_buckets) if cuts[b] < cuts[b + 1]]
            pieces = [by[cuts[b] : cuts[b + 1]] for b in some]
            return pa.record_batch(
                [pa.array(some, pa.int32()), *[pa.array([a[p].tobytes() for p in pieces], pa.binary()) for a in (grams, sids, sizes)]],
                schema=schema,
            )

        for batch in batches:
            for _, grams in _sets(batch, k):
                n = len(grams)
                if not n:
                    continue
                sid = set_id(grams)
                if sid in seen:  # a copy within this task; copies elsewhere meet in the buckets
                    continue
                if len(seen) < 1_000_000:
                    seen.add(sid)
                length = n - int(required_self(n, t)) + 1
                parts.append((arrange(grams)[:length], sid, n))
                rows += length
                if rows >= 400_000:
                    yield flush()
                    parts, rows = [], 0
        if parts:
            yield flush()

    return run


def required_self(n: int, t: Fraction) -> int:
    """The least overlap of a set of size n with any linked set: ceil(t n)."""
    return -((-t.numerator * n) // t.denominator)


def _unique_pairs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct (x, y) first stands, and how often it occurs."""
    by = np.lexsort((y, x))
    new = np.ones(len(x), bool)
    new[1:] = (x[by][1:] != x[by][:-1]) | (y[by][1:] != y[by][:-1])
    at = np.flatnonzero(new)
    return by[at], np.diff(np.append(at, len(x)))


def _possible(votes: Column, t: Fraction) -> Column:
    """Whether sets of sizes m and n whose prefixes share so many n-grams may link.

    Of the set whose prefix ends first in the global order, every common n-gram within the prefix
    is a vote; the rest has ceil(t size) - 1 n-grams.
    """
    a, b = t.numerator, t.denominator
    rest = F.expr(f"({a} * greatest(m, n) + {b - 1}) div {b} - 1")
    return votes + rest >= F.expr(f"({a} * (m + n) + {a + b - 1}) div {a + b}")


def _similar(m: np.ndarray, n: np.ndarray, t: Fraction) -> np.ndarray:
    return t.denominator * np.minimum(m, n) >= t.numerator * np.maximum(m, n)


def _groups(t: Fraction, order, limits: Limits):
    """Packed prefixes, sorted by bucket, to pairs (kind 0: sets x and y, votes of small groups,
    votes of stars, sizes) and the rows of large groups and of all hot n-grams (kind 1: n-gram, set,
    0, 0, size, size)."""
    names = ("x", "y", "small", "star", "m", "n")

    def out(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
        kinds = pa.array(np.full(len(columns[0]), kind, np.int32))
        return pa.record_batch([kinds, *[pa.array(c.astype(np.int64)) for c in columns]], names=["kind", *names])

    def bucket(grams: np.ndarray, sids: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        by = np.lexsort((sids, grams))
        grams, sids, sizes = grams[by], sids[by], sizes[by].astype(np.int64)
        keep = np.ones(len(grams), bool)
        keep[1:] = (grams[1:] != grams[:-1]) | (sids[1:] != sids[:-1])
        grams, sids, sizes = grams[keep], sids[keep], sizes[keep]
        starts = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
        each = np.diff(np.append(starts, len(grams)))
        many = np.repeat(each, each)
        first = np.repeat(starts, each)
        ends, others = [], []
        for d in range(1, limits.small):
            i = np.flatnonzero((many[d:] <= limits.small) & (grams[d:] == grams[:-d])) + d
            i = i[_similar(sizes[i], sizes[i - d], t)]
            ends.append(i)
            others.append(i - d)
        large = np.flatnonzero(many > limits.small)
        # A hot n-gram's sets lie in several groups, so even a small one of them is no whole group.
        listed = np.flatnonzero((many > limits.small) | np.isin(grams, order.value.hot))
        members, leaders = [large[:0]], [large[:0]]
        for r in range(limits.leaders):
            i = large[large - first[large] > r]
            i = i[_similar(sizes[i], sizes[first[i] + r], t)]
            members.append(i)
            leaders.append(first[i] + r)
        zero = np.zeros(len(listed), np.int64)
        pairs = (([*ends, large[:0]], [*others, large[:0]]), (members, leaders))
        for k, (i, j) in enumerate((np.concatenate(a), np.concatenate(b)) for a, b in pairs):
            at, votes = _unique_pairs(sids[i], sids[j])
            none = np.zeros(len(at), np.int64)
            yield out(0, sids[i][at], sids[j][at], none if k else votes, votes if k else none, sizes[i][at], sizes[j][at])
        yield out(1, grams[listed].view(np.int64), sids[listed], zero, zero, sizes[listed], sizes[listed])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            a = [b"".join(h[i].as_py() for h in held) for i in range(3)]
            yield from bucket(np.frombuffer(a[0], np.uint64), np.frombuffer(a[1], np.int64), np.frombuffer(a[2], np.uint32))

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, b in enumerate(ids):
                if b != now and held:
                    yield from close()
                    held = []
                now = b
                held.append((batch.column(1)[i], batch.column(2)[i], batch.column(3)[i]))
        if held:
            yield from close()

    return run


class Trie:
    """Sets in the global order from the frequent end, as a radix trie.

    Sorted sets that share a path of tokens stand together: a run of them is a node, the tokens
    common to all of it are the node's label, and each set ends at a leaf.  Nodes are numbered
    level by level.
    """

    def __init__(self, sets: list[np.ndarray]):
        by = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        lists = [sets[i] for i in by]
        self.order, sizes = np.array(by, np.int64), np.array([len(x) for x in lists], np.int64)
        starts = np.cumsum(sizes) - sizes
        self.vocabulary, self.codes = np.unique(np.concatenate([*lists, np.zeros(0, np.uint64)]), return_inverse=True)
        shared = np.zeros(len(lists), np.int64)  # tokens at the beginning that equal those of the set before
        for i in range(1, len(lists)):
            end = min(sizes[i - 1], sizes[i])
            differ = np.flatnonzero(lists[i - 1][:end] != lists[i][:end])
            shared[i] = differ[0] if len(differ) else end
        nodes, level = [], [(0, len(lists), 0, -1)] if lists else []
        self.levels: list[tuple[int, int]] = []
        while level:
            below = []
            for lo, hi, depth, parent in level:
                to = int(sizes[lo] if hi - lo == 1 else shared[lo + 1 : hi].min())
                if hi - lo > 1:
                    edges = [lo, *(lo + 1 + np.flatnonzero(shared[lo + 1 : hi] == to)).tolist(), hi]
                    below += [(a, z, to, len(nodes)) for a, z in zip(edges[:-1], edges[1:], strict=True)]
                nodes.append((parent, starts[lo] + depth, to - depth, to, sizes[lo:hi].min(), sizes[lo:hi].max(), lo, hi))
            self.levels.append((len(nodes) - len(level), len(nodes)))
            level = below
        columns = np.array(nodes, np.int64).reshape(-1, 8).T
        self.parent, self.start, self.length, self.to, self.least, self.most, self.lo, self.hi = columns
        self.leaves = np.flatnonzero(self.hi - self.lo == 1)

    def walk(self, probes: list[np.ndarray], t: Fraction, own: np.ndarray | None = None, groups: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each probe that links with some sets: its number, theirs, and their overlaps.

        The probes go down the trie together, level by level.  A probe leaves a subtree when the
        overlap so far plus what can remain is below the least overlap asked for there, so a set
        that is not named cannot link.  With ``own`` (the component of each set) and ``groups`` (of
        each probe) it also leaves subtrees that are wholly in its own component.
        """
        if not len(self.order) or not probes:
            return
        n = np.array([len(x) for x in probes], np.int64)[:, None]
        inside = np.zeros((len(probes), len(self.vocabulary)), bool)
        tokens, who = np.concatenate(probes), np.repeat(np.arange(len(probes)), n[:, 0])
        at = np.minimum(np.searchsorted(self.vocabulary, tokens), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == tokens
        inside[who[hit], at[hit]] = True
        got, alive = np.zeros((len(probes), len(self.to)), np.int64), np.zeros((len(probes), len(self.to)), bool)
        if own is not None:
            own = own[self.order]
            turns = np.cumsum(np.append(False, own[1:] != own[:-1]))
            whole = np.where(turns[self.lo] == turns[self.hi - 1], own[self.lo], -1)
        for k, (a, z) in enumerate(self.levels):
            node = np.arange(a, z)
            above = alive[:, self.parent[a:z]] if k else np.ones((len(probes), z - a), bool)
            if own is not None:
                above = above & (whole[a:z] != groups[:, None])
            some = above.any(0)
            node, above = node[some], above[:, some]
            if not len(node):
                break
            each = self.length[node]
            ends = np.cumsum(each)
            place = np.repeat(self.start[node] - (ends - each), each) + np.arange(each.sum())
            common = np.zeros((len(probes), len(place) + 1), np.int32)
            np.cumsum(inside[:, self.codes[place]], axis=1, out=common[:, 1:])
            now = common[:, ends] - common[:, ends - each] + (got[:, self.parent[node]] if k else 0)
            got[:, node] = now
            possible = now + np.minimum(self.most[node] - self.to[node], n - now)
            alive[:, node] = above & (possible >= required(n, self.least[node], t))
        linked = alive[:, self.leaves]
        for p in np.flatnonzero(linked.any(1)).tolist():
            leaf = self.leaves[linked[p]]
            yield p, self.order[self.lo[leaf]], got[p, leaf]

    def together(self) -> int:
        """How many probes go down together, so that a step's memory is bounded."""
        return max(1, min(TOGETHER, (1 << 22) // max(1, len(self.codes))))

    def overlaps(self, probe: np.ndarray, t: Fraction, among: list[int] | None = None) -> dict[int, int]:
        """Overlaps of one probe with the sets (or those of the numbers in ``among``) that link with it."""
        some = None if among is None else set(among)
        found = [dict(zip(i.tolist(), c.tolist(), strict=True)) for _, i, c in self.walk([probe], t)]
        return {i: c for x in found for i, c in x.items() if some is None or i in some}


def spanning_forest(
    ids: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], probe_ids: np.ndarray, probe_roots: np.ndarray, probes: list[np.ndarray], t: Fraction
) -> list[tuple[int, int]]:
    """Links between sets of a trie and its probes, one for each merging of components.

    ``roots`` tell which sets are known to be in one component.
    """
    trie = Trie(sets)
    _, code = np.unique(np.concatenate([roots, probe_roots]), return_inverse=True)
    own, asking = code[: len(ids)], code[len(ids) :]
    out: list[tuple[int, int]] = []
    by = np.argsort([len(x) for x in probes], kind="stable")
    step = trie.together()
    for lo in range(0, len(by), step):
        some = by[lo : lo + step]
        for p, found, _ in trie.walk([probes[i] for i in some], t, own, asking[some]):
            x = some[p]
            for c, first in zip(*np.unique(own[found], return_index=True), strict=True):
                mine = asking[x]
                if c != mine and own[found[first]] != mine:
                    out.append((int(probe_ids[x]), int(ids[found[first]])))
                    own[own == c], asking[asking == c] = mine, mine
    return out


def _pack48(tokens: np.ndarray) -> bytes:
    return (tokens >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack48(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :6] = raw
    return full.view("<u8").reshape(-1)


def _bitmap(df: DataFrame, key: str) -> np.ndarray:
    """A bitmap of fixed size over the hashes of a column; a set bit may stand for other values."""
    slot = F.pmod(F.xxhash64(key), F.lit(BITMAP))
    bits = df.select((slot / 32).cast("int").alias("a"), (slot % 32).cast("int").alias("b")).groupBy("a")
    out = np.zeros(BITMAP // 32, np.int64)
    for r in bits.agg(F.expr("bit_or(shiftleft(1L, b))").alias("m")).toLocalIterator():
        out[r["a"]] = r["m"]
    return out


def _needed_sets(docs: DataFrame, profile: DataFrame, wanted: DataFrame, order, k: int) -> DataFrame:
    """(sid, tokens) of the wanted sets, made again from one text each.

    Ids that share a bit may bring other sets along, and repeated rows of an id one more row of a
    set for each task; whoever joins them takes one.
    """
    reps = profile.join(wanted.hint("merge"), "sid").groupBy("sid").agg(F.min("id").alias("id"))
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(reps, "id"))  # BITMAP / 4 bytes
    schema = pa.schema([("sid", pa.int64()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            slot = batch.column(2).to_numpy()
            hit = (bits.value[slot // 32] >> (slot % 32)) & 1 == 1
            if not hit.any():
                continue
            batch = batch.filter(pa.array(hit))
            sids, tokens = [], []
            for _, grams in _sets(batch, k):
                sid = set_id(grams)
                if sid not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(sid)
                    sids.append(sid)
                    tokens.append(_pack48(order.value.arrange(grams)[::-1]))
            yield pa.record_batch([pa.array(sids, pa.int64()), pa.array(tokens, pa.binary())], schema=schema)

    slots = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP)).alias("slot"))
    return slots.mapInArrow(tidy(run), "sid bigint, tokens binary")


def _linked(docs: DataFrame, profile: DataFrame, rows: DataFrame, order, k: int, t: Fraction) -> DataFrame:
    """Edges (u, v) of a spanning forest in each block of rows (*KEY, sid, root, held).

    The sets that are held stand in the block's trie; the others probe it.  A set travels once for
    each block, not once for each pair.
    """
    rows = saved(rows.select(*KEY, "sid", "root", "held"), "jaccard-blocks")
    if rows.isEmpty():
        return rows.selectExpr("sid AS u", "root AS v")
    sets = _needed_sets(docs, profile, rows.select("sid").distinct(), order, k)
    blocks = rows.join(sets.hint("merge"), "sid")

    def run(block: pa.Table) -> pa.Table:
        sides: dict[bool, dict[int, tuple[int, bytes]]] = {True: {}, False: {}}
        columns = (block.column(c).to_pylist() for c in ("sid", "root", "held", "tokens"))
        for sid, root, held, tokens in zip(*columns, strict=True):
            sides[held][sid] = root, tokens  # copies of a set are equal
        both = [(np.array(list(x), np.int64), np.array([r for r, _ in x.values()], np.int64), [_unpack48(z) for _, z in x.values()]) for x in (sides[True], sides[False])]
        found = spanning_forest(*both[0], *both[1], t)
        return pa.table([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

    out = saved(blocks.groupBy(*KEY).applyInArrow(run, "u bigint, v bigint"), "jaccard-links")
    forget(rows)
    return out


#: What names a block: a partner or a list's n-gram, a part of the trie, a part of the probes.
KEY = ("tile", "part", "chunk")


def _partner_blocks(pairs: DataFrame, limits: Limits) -> DataFrame:
    """Pairs (x, y, rx, ry: their components) as blocks: each y is a trie, the sets x probe it."""
    asked = pairs.groupBy("y").agg(F.max("ry").alias("ry"), F.ceil(F.count(F.lit(1)) / limits.block).alias("c"))
    key = [F.col("y").alias("tile"), F.lit(-1).cast("long").alias("part")]
    held = asked.select(*key, F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("chunk"), F.col("y").alias("sid"), F.col("ry").alias("root"), F.lit(True).alias("held"))
    probes = pairs.join(asked.select("y", "c").hint("merge"), "y")
    probes = probes.select(*key, F.pmod(F.xxhash64("x"), F.col("c")).alias("chunk"), F.col("x").alias("sid"), F.col("rx").alias("root"), F.lit(False).alias("held"))
    return held.union(probes)


def may_link(held: list[np.ndarray], probes: list[np.ndarray], m: np.ndarray, n: np.ndarray, apart: Callable[[int], np.ndarray], t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Which of the sets held and of the probes have a partner on the other side that their bitmaps
    and sizes allow, among the probes that ``apart`` (the number of a held set) tells."""
    of_held, of_probes = np.array([len(x) for x in held]), np.array([len(x) for x in probes])
    hits, hit = np.zeros(len(held), bool), np.zeros(len(probes), bool)
    for width in np.unique(of_probes).tolist():
        some = np.flatnonzero(of_probes == width)
        full = np.stack([probes[i] for i in some])
        for least in np.unique(np.minimum(of_held, width)).tolist():
            other = fold(full, least)
            for i in np.flatnonzero(np.minimum(of_held, width) == least).tolist():
                near = np.flatnonzero(_similar(n[some], m[i], t) & apart(i)[some])
                if not len(near):
                    continue
                differ = np.bitwise_count(other[near] ^ fold(held[i], least)).sum(1, dtype=np.int64)
                at = some[near]
                good = at[(n[at] + m[i] - differ) // 2 >= required(n[at], m[i], t)]
                hits[i] |= len(good) > 0
                hit[good] = True
    return hits, hit


def _list_blocks(profile: DataFrame, lists: DataFrame, roots: DataFrame, t: Fraction, limits: Limits) -> DataFrame | None:
    """Blocks for the large groups' lists (gram, sid, n) that hold several components, if any.  The
    lists' table is read once and deleted.

    Of a list, two sets of its largest component need no look, nor do two sets that share a larger
    list.  So the sets that do not share the larger list that most of them share, or those outside
    the largest component if they are fewer, are compared with all of the list.
    """
    rows = lists.join(roots.hint("merge"), lists.sid == roots.id, "left").select("gram", "sid", "n", F.coalesce("root", "sid").alias("root"))
    rows = saved(rows, "jaccard-lists")
    forget(lists)
    counts = rows.groupBy("gram", "root").agg(F.count(F.lit(1)).alias("c"))
    mixed = counts.groupBy("gram").agg(F.sum("c").alias("m"), F.max(F.struct("c", "root")).alias("b"))
    mixed = mixed.select("gram", "m", F.col("b.root").alias("main"), (F.col("m") - F.col("b.c")).alias("others")).where("others > 0")
    near = first = saved(rows.join(mixed.hint("merge"), "gram"), "jaccard-near")
    forget(rows)
    if near.isEmpty():
        return None
    # A set's lists are at most as many as its prefix has n-grams.
    largest = F.slice(F.sort_array(F.collect_list(F.struct("m", "gram")), asc=False), 1, TOPS)
    near = near.join(near.groupBy("sid").agg(largest.alias("tops")).hint("merge"), "sid")
    modes = near.groupBy("gram", F.col("tops")[0]["gram"].alias("top")).agg(F.count(F.lit(1)).alias("c"))
    modes = modes.groupBy("gram").agg(F.max(F.struct("c", "top"))["top"].alias("mode"))
    covered = (F.col("mode") != F.col("gram")) & F.exists("tops", lambda x: x["gram"] == F.col("mode"))
    near = saved(near.join(modes.hint("merge"), "gram").withColumn("covered", covered).drop("mode"), "jaccard-covered")
    forget(first)
    plan = near.groupBy("gram").agg(F.count(F.when(~F.col("covered"), 1)).alias("loose"), F.sum("n").alias("tokens"))
    near = near.join(plan.hint("merge"), "gram").withColumn("k", F.least("loose", "others")).where("k > 0")
    share = F.col("tokens") / limits.tokens
    near = near.withColumns({
        "held": F.when(F.col("loose") <= F.col("others"), ~F.col("covered")).otherwise(F.col("root") != F.col("main")),
        "parts": F.ceil(F.greatest(F.col("k") / limits.block, share * F.col("k") / F.col("m"))),
        "chunks": F.ceil(F.greatest(F.col("m") / limits.probes, share)),
        "tops": F.transform(F.filter("tops", lambda x: x > F.struct(F.col("m"), F.col("gram"))), lambda x: x["gram"]),
    })
    bits = profile.groupBy("sid").agg(F.first("bits").alias("bits"))
    near = near.select(F.col("gram").alias("tile"), "sid", "n", "root", "tops", "held", "parts", "chunks").join(bits.hint("merge"), "sid")
    held = near.where("held").withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts"))).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    probes = near.withColumn("chunk", F.pmod(F.xxhash64("sid", F.lit(1)), F.col("chunks"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    columns = [*KEY, "sid", "n", "root", "tops", "bits"]
    blocks = held.select(*columns, F.lit(True).alias("held")).union(probes.select(*columns, F.lit(False).alias("held")))

    def run(block: pa.Table) -> pa.Table:
        side = block.column("held").to_numpy()
        sides = [block.filter(pa.array(x)).combine_chunks() for x in (side, ~side)]
        (m, n), (own, others) = ([x.column(c).to_numpy() for x in sides] for c in ("n", "root"))
        (mine, theirs) = ([np.frombuffer(b, "<u8") for b in x.column("bits").to_pylist()] for x in sides)
        larger = np.full((len(n), TOPS), np.iinfo(np.int64).min)
        for i, tops in enumerate(sides[1].column("tops").to_pylist()):
            larger[i, : len(tops)] = tops
        known = sides[0].column("tops").to_pylist()

        def apart(i: int) -> np.ndarray:
            out = others != own[i]
            for top in known[i]:
                out &= (larger != top).all(1)
            return out

        hits, hit = may_link(mine, theirs, m, n, apart, t)
        found = [x.filter(pa.array(h)).select([*KEY, "sid", "root", "held"]) for x, h in zip(sides, (hits, hit), strict=True)]
        return pa.concat_tables(found)

    return blocks.groupBy(*KEY).applyInArrow(run, "tile bigint, part bigint, chunk bigint, sid bigint, root bigint, held boolean")


def _rooted(docs: DataFrame, k: int, threshold: tuple[int, int], id_col: str, text_col: str, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """Rows (id, key, n, root) with words, and rows (id, key, n) without; key: digest of id and text."""
    t = Fraction(*threshold)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("key"))
    sc = docs.sparkSession.sparkContext
    first = saved(docs.mapInArrow(tidy(_profile(k, limits)), "kind bigint, id bigint, n bigint, sid bigint, key bigint, bits binary"), "jaccard-profile")
    profile = first.where("kind = 0").select("id", "n", "sid", "key", "bits")
    frequent = first.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n"))
    top = frequent.orderBy(F.desc("n"), "id").limit(limits.frequent).collect()  # at most so many rows
    grams = np.array([r["id"] for r in top], np.int64).view(np.uint64)
    order = sc.broadcast(Order(grams, np.array([r["n"] for r in top], np.int64), limits))

    parts = partitions_for(docs)
    packed = docs.mapInArrow(tidy(_prefixes(k, t, order, 4 * parts)), "bucket int, grams binary, sids binary, sizes binary")
    dealt = packed.repartition(parts, "bucket").sortWithinPartitions("bucket")
    kind = "kind int, x bigint, y bigint, small bigint, star bigint, m bigint, n bigint"
    met = saved(dealt.mapInArrow(tidy(_groups(t, order, limits)), kind), "jaccard-met")

    pairs = met.where("kind = 0").groupBy("x", "y").agg(F.sum("small").alias("small"), F.sum("star").alias("star"), F.max("m").alias("m"), F.max("n").alias("n"))
    pairs = saved(pairs, "jaccard-candidates")
    lists = saved(met.where("kind = 1").selectExpr("x AS gram", "y AS sid", "n"), "jaccard-members")
    forget(met)
    votes = F.col("small") + F.col("star")
    best = pairs.where(_possible(votes, t)).groupBy("x").agg(F.max(F.struct(votes.alias("w"), (-F.col("y")).alias("y"))).alias("b"))
    best = best.select("x", (-F.col("b.y")).alias("y"))
    first = best.select("x", "y", F.col("x").alias("rx"), F.col("y").alias("ry"))
    links = _linked(docs, profile, _partner_blocks(first, limits), order, k, t)
    roots = connected_components(links)

    a = roots.select(F.col("id").alias("x"), F.col("root").alias("rx"))
    b = roots.select(F.col("id").alias("y"), F.col("root").alias("ry"))
    # A pair that shares no n-gram of a large group has all its votes from small ones; the others
    # meet in the blocks of a list.
    apart = pairs.where(_possible(F.col("small"), t) & (F.col("small") > 0)).join(best.hint("merge"), ["x", "y"], "left_anti")
    apart = apart.join(a.hint("merge"), "x", "left").join(b.hint("merge"), "y", "left").select("x", "y", F.coalesce("rx", "x").alias("rx"), F.coalesce("ry", "y").alias("ry"))
    blocks = _partner_blocks(apart.where("rx <> ry"), limits)
    of_lists = _list_blocks(profile, lists, roots, t, limits)
    more = _linked(docs, profile, blocks if of_lists is None else blocks.union(of_lists), order, k, t)
    if not more.isEmpty():
        roots = connected_components(links.union(more))
    forget(pairs)

    full = profile.where("n > 0").join(roots.withColumnRenamed("id", "sid").hint("merge"), "sid", "left")
    return full.select("id", "key", "n", F.coalesce("root", "sid").alias("root")), profile.where("n = 0").select("id", "key", "n")


def jaccard_components(
    docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (75, 100), id_col: str = "doc_id", text_col: str = "text",
    limits: Limits = LIMITS,
) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) of every row.

    Null and empty texts: size 0, linked with nothing, their own id as component.  Null ids: the
    row takes part, but null is a component's name only if no row of it has an id.  Repeated rows:
    each gets its row.  Very long texts count whole.  Ties do not arise: a link is a matter of
    sets, and a component's name is its least id.  Empty table: empty result.  Other columns are
    ignored, whatever their names.  ``limits`` change no result.  N-grams are compared by 64-bit
    digests in prefixes and by 48 bits of them in overlaps.
    """
    full, empty = _rooted(docs, k, threshold, id_col, text_col, limits)
    least = full.groupBy("root").agg(F.min("id").alias("component_id"))
    named = full.join(least.hint("merge"), "root").selectExpr("id AS doc_id", "n AS n_shingles", "component_id")
    return named.union(empty.selectExpr("id", "n", "id"))


def one_of_each(
    docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (75, 100), id_col: str = "doc_id", text_col: str = "text",
    limits: Limits = LIMITS,
) -> DataFrame:
    """The rows of ``docs``, all columns as they are, with one row of each component.

    The row of least id stays, then of least digest of id and text; null ids come last.  Of rows
    equal in id and text one stays.  Rows without words, so those of null and empty texts, have no
    links and all stay.  Very long texts count whole.  Empty table: empty result.
    """
    full, _ = _rooted(docs, k, threshold, id_col, text_col, limits)
    full = saved(full, "jaccard-rooted")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    best = full.groupBy("root").agg(F.min(rank).alias("best")).select("root", F.col("best.key").alias("stays"))
    lost = full.join(best.hint("merge"), "root").where("key <> stays").select(F.col("key").alias("_key")).distinct()
    copies = full.groupBy("key").count().where("count > 1").select(F.col("key").alias("_key"))
    packed = docs.select(F.struct("*").alias("row"), F.xxhash64(id_col, text_col).alias("_key")).join(lost.hint("merge"), "_key", "left_anti")
    once = packed.join(copies, "_key", "left_anti")
    several = packed.join(copies, "_key", "left_semi").groupBy("_key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return once.select("row.*").unionByName(several.select("row.*"))
