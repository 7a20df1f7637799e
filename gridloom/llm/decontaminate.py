"""Benchmark decontamination by latent semantic retrieval.

1. One pass over the whole corpus counts in how many documents each word is (hashed to ``BINS``
   sums), and makes its part of a randomised SVD.  The counts give the weights of TF-IDF,
   min(CAP, max(0, ln(N / df) - floor)): with the first of ``FLOORS``, words of more than a
   twentieth of all documents weigh nothing, and very rare ones no more than rare ones.  Items of
   which too few words would have a weight go through by themselves with a lower floor.
2. The SVD is of the TF-IDF passages.  Rows are the corpus's passages and, with a fixed multiple of
   the corpus's mass, the benchmark items; columns are the words of the items (more than ``COLUMNS``
   of them share as many columns by hash), D their weights.  For the counts C of the corpus and a random sparse sign matrix O, every task adds its part of C'C O
   from the pairs of item words that share a passage; the sums are streamed together.  Since
   (C D)'(C D) (O / D) = D (C'C O), the weights may come afterwards, and the Nystrom form of the
   randomised SVD gives the right singular vectors of the weighted passages from that one pass.
3. Candidates come from the cosine in the latent space.  Every window of 24 words, every 8 words of
   every text, is compared with every item: a word's part of the cosines is its column's singular
   vector times all items', so a window's cosines are sums over its few weighted words.  A window at
   ``LEAST_COSINE`` or more makes a pair of its stretch and the item, if the stretch has enough of the
   item's words.  The cosine alone would lose paraphrases that have given up an item's weighted words,
   and items that have none (they are in nearly every document, or consist of common words).  So what
   the check accepts and the cosine has not named is sought by an index as well: a text that holds
   the share ``LCS_ALONE`` of an item's words leaves out so few that one of the item's rarest words
   is there, or else the answer's rarest.  ``by_cosine`` tells for each row whether the cosine led to it.
4. In the stretch of a pair, the windows are ranked by their cosine with the item, and the words
   around them are compared with it: longest common subsequence, and whether the item's answer (its
   last ``ANSWER`` words) is there.  Copies have
   nearly the whole sequence; paraphrases have a good part of it, or a smaller one and the answer.
   Common words that are merely strewn around in the item's order are no match: without the answer,
   some of the item's own weight is there, or a stretch of twice the item's length is enough.

The benchmark is the stated query set.  It is searched for in one survey and one search of the
corpus, together with all its items, as long as they have ``MOST_WORDS`` words; what is broadcast is
bounded by that: some hundred bytes for each item word, RANK numbers for each item and each column.
Further items go through in the same way, with a survey and a search of their own, so none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_array, hashes, mix, partitions_for, slices, split_words, tidy

BINS = 1 << 18
FLOORS, CAP, LEAST_WEIGHT = (3.0, 1.5, 0.0), 4.0, 0.05
#: Words of an item that must have an eighth of CAP as weight, or a quarter of a short item.
WEIGHTED = 5
BLOCK, WINDOW = 8, 3
RANK, EXTRA = 256, 64
#: Columns of the SVD.
COLUMNS = 1 << 13
#: Words of more than this share of the items, and of more than five, tell no items apart.
COMMON = 0.05
#: Words of the items that go through together; an item with more goes alone.
MOST_WORDS = 1 << 19
#: Items that are projected together, and words up to which an item's places are kept as bits.
TOGETHER, SHORT = 256, 4096
#: A window's least cosine with an item that makes it a candidate.
LEAST_COSINE = 0.35
#: Items whose cosines are summed up together, and windows.
COLUMNS_OF, WINDOWS = 64, 1 << 16
#: The items' share in the SVD, as a multiple of the corpus's mass.
ITEM_MASS = 8.0
#: Share of an item's words in the common subsequence: alone, or with the answer.
LCS_ALONE, LCS_WITH_ANSWER, ANSWER = 0.6, 0.45, 8
#: Common words in order may stand around a window by chance.  Without the answer, there is this share
#: of the item's own weight (times how the item's and the window's lengths differ), or a stretch of
#: COMPACT times the item's length is enough by itself.
OWN_WEIGHT, COMPACT = 0.05, 2
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds, each word's code, and the hash by code: lower-cased, without marks at the ends."""
    bounds, codes, words = split_words(texts)
    return bounds, codes, hashes(pc.utf8_trim(pc.utf8_lower(words), MARKS))


def bins_of(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(BINS)).astype(np.int64)


def _summed(df: DataFrame, dtype: type) -> dict[int, np.ndarray]:
    """Sums by part of arrays (part, data).  They are streamed: a task holds its parts' totals,
    never all tasks' shares, and the driver gets one array a part."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(data.as_buffer(), dtype)
                sums[part] = sums[part] + x if part in sums else x.copy()
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["part", "data"])

    rows = df.repartition(partitions_for(df), "part").mapInArrow(tidy(add), "part int, data binary").collect()
    return {r["part"]: np.frombuffer(r["data"], dtype) for r in rows}


def _parts(arrays: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(arrays), pa.int32()), pa.array([a.tobytes() for a in arrays.values()], pa.binary())], names=["part", "data"])


@dataclass
class Survey:
    """What the pass over the corpus gives: ln(N / df) by bin, and C'C O with its O; a row for each column."""

    rarity: np.ndarray
    vocabulary: np.ndarray
    product: np.ndarray
    slot: np.ndarray
    sign: np.ndarray


def lookup(vocabulary: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The place of each hash in a sorted vocabulary, -1 where it is not there."""
    if not len(vocabulary):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return np.where(vocabulary[at] == h, at, -1)


def columns_of(vocabulary: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Of n columns that of each hashed word, -1 for words outside the vocabulary."""
    at = lookup(vocabulary, h)
    return at if len(vocabulary) <= n else np.where(at >= 0, (mix(h) % np.uint64(n)).astype(np.int64), -1)


def telling_words(items: list[np.ndarray]) -> np.ndarray:
    """The sorted distinct words of items, without those of too many items; repeated items count once.

    They are the columns of the SVD, and so of the cosine.
    """
    each = [np.unique(w) for w in {w.tobytes(): w for w in items}.values()]
    values, counts = np.unique(np.concatenate([*each, np.zeros(0, np.uint64)]), return_counts=True)
    return values[counts <= max(5, COMMON * len(each))]


def survey(docs: DataFrame, vocabulary: np.ndarray, seed: int = 11, chunk: int = 1 << 14) -> Survey:
    """One pass over the texts.  BINS counts and a row of RANK + EXTRA numbers for each of at most
    COLUMNS columns are summed by part and come to the driver: 23 MB, whatever the benchmark's size."""
    m = min(len(vocabulary), COLUMNS)
    width = min(max(m, 1), RANK + EXTRA)
    rng = np.random.default_rng(seed)
    slot, sign = rng.permutation(np.arange(m) % width), rng.choice([-1.0, 1.0], m)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, slot, sign))
    rows = max(1, chunk // width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, slots, signs = shared.value
        df, n, total = np.zeros(BINS), 0, np.zeros((m, width))
        for batch in batches:
            texts = as_array(batch.column(0))
            for lo, hi in slices(texts):
                bounds, codes, h = plain_words(texts.slice(lo, hi - lo))
                doc = np.repeat(np.arange(hi - lo, dtype=np.int64), np.diff(bounds))
                once = _distinct(doc * BINS + bins_of(h)[codes])
                df += np.bincount(once % BINS, minlength=BINS)
                n += hi - lo
                column = columns_of(words, h, m)[codes]
                at = np.flatnonzero(column >= 0)
                passage = doc[at] * (1 << 32) + (at - bounds[doc[at]]) // (BLOCK * WINDOW)
                _sketched(passage, column[at], slots, signs, total)
        parts = {i: df[i * chunk : (i + 1) * chunk] for i in range(BINS // chunk)}
        parts |= {1_000_000 + i: total[i * rows : (i + 1) * rows] for i in range(-(-m // rows))}
        yield _parts({-1: np.array([float(n)]), **parts})

    sums = _summed(docs.select("text").mapInArrow(tidy(run), "part int, data binary"), np.float64)
    n = float(sums[-1][0]) if sums else 0.0
    df = [sums[i] for i in sorted(sums) if 0 <= i < 1_000_000]
    product = [sums[i].reshape(-1, width) for i in sorted(sums) if i >= 1_000_000]
    rarity = np.log(max(n, 1.0) / np.maximum(np.concatenate(df), 1)) if df else np.zeros(BINS)
    return Survey(rarity.astype(np.float32), vocabulary, np.vstack(product) if product else np.zeros((m, width)), slot, sign)


def weights_of(rarity: np.ndarray, floor: float = FLOORS[0]) -> np.ndarray:
    return np.clip(rarity - floor, 0, CAP).astype(np.float32)


@dataclass
class Items:
    """Benchmark items: ids, their words' hashes, the weight of each bin, and the columns' words."""

    ids: list[int]
    words: list[np.ndarray]
    weights: np.ndarray
    vocabulary: np.ndarray
    #: By bin, to tell which of an item's words are its rarest; the weights if there is none.
    rarity: np.ndarray | None = None

    def __post_init__(self):
        # Every column has some weight, so that the survey's product can be weighted afterwards.
        self.width = min(len(self.vocabulary), COLUMNS)
        self.column_weights = np.full(self.width, LEAST_WEIGHT)
        np.maximum.at(self.column_weights, self.columns(self.vocabulary), self.weights[bins_of(self.vocabulary)].astype(np.float64))

    def rows(self, lo: int, hi: int) -> np.ndarray:
        """The weighted counts of some items, a row each."""
        out = np.zeros((hi - lo, self.width), np.float32)
        for i, h in enumerate(self.words[lo:hi]):
            c = self.columns(h)
            c = c[c >= 0]
            np.add.at(out[i], c, self.column_weights[c])
        return out

    def blocks(self) -> Iterator[np.ndarray]:
        """All rows, TOGETHER at a time."""
        for lo in range(0, len(self.ids), TOGETHER):
            yield self.rows(lo, min(lo + TOGETHER, len(self.ids)))

    def columns(self, h: np.ndarray) -> np.ndarray:
        """The column of each hashed word, -1 for words of no item."""
        return columns_of(self.vocabulary, h, self.width)


def _sketched(owner: np.ndarray, column: np.ndarray, slot: np.ndarray, sign: np.ndarray, out: np.ndarray) -> None:
    """Add sum over owners' counts c of c (c' O) to ``out``; O has sign[c] at (c, slot[c]).

    Entries stand by owner.  Pairs of entries of one owner are listed by their distance.
    """
    width = out.shape[1]
    base, to, value = column * width, slot[column] if len(column) else column, sign[column] if len(column) else column
    flat = out.reshape(-1)
    keys, values = [base + to], [value]
    live = np.arange(len(owner))
    for lag in range(1, BLOCK * WINDOW):
        live = live[live + lag < len(owner)]
        live = live[owner[live + lag] == owner[live]]
        if not len(live):
            break
        far = live + lag
        keys += [base[live] + to[far], base[far] + to[live]]
        values += [value[far], value[live]]
    key = np.concatenate(keys)
    if len(key):
        flat += np.bincount(key, np.concatenate(values), len(flat))


def latent_space(seen: Survey, items: Items, rank: int = RANK) -> np.ndarray:
    """Right singular vectors (columns x rank) of the weighted passages and items."""
    m = items.width
    omega = np.zeros((m, seen.product.shape[1]))
    omega[np.arange(m), seen.slot] = seen.sign / items.column_weights
    corpus = items.column_weights[:, None] * seen.product
    of_items = np.zeros_like(corpus)
    for own in items.blocks():
        own = own.astype(np.float64)
        of_items += own.T @ (own @ omega)
    mass, own_mass = np.linalg.norm(corpus), np.linalg.norm(of_items)
    scale = max(1.0, ITEM_MASS * mass / own_mass) if own_mass else 1.0
    y = corpus + scale * of_items
    y += 1e-9 * np.linalg.norm(y) * omega
    core = omega.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-10 * max(values.max(), 1e-300)
    u, _, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    return u[:, :rank].astype(np.float32)


class Places(dict):
    """The places of each word; ``get`` gives them as bits, which long items do not keep."""

    def get(self, word: int, default: int = 0) -> int:
        return sum(1 << i for i in self[word]) if word in self else default


def bits_of(words: np.ndarray) -> dict[int, int]:
    """The places of each word, as bits."""
    where: dict[int, list[int]] = Places()
    for i, x in enumerate(words.tolist()):
        where.setdefault(x, []).append(i)
    return {x: where.get(x) for x in where} if len(words) <= SHORT else where


def common_words(a: np.ndarray, where: dict[int, int]) -> int:
    """Length of the longest common subsequence with the words of ``bits_of``, one row of bits for
    each word of ``a``; a word that is not there leaves the row as it is."""
    row = 0
    for x in a.tolist():
        bits = where.get(x, 0)
        if bits:
            y = row | bits
            row = y & (y ^ (y - ((row << 1) | 1)))
    return row.bit_count()


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    return common_words(a, bits_of(b))


def least_common(words: int, share: float) -> int:
    """The fewest common words that are the share of so many."""
    return max(1, int(np.ceil(share * words - 1e-9)))


def _distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values; a sort is faster here than a table of hashes."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each count, one after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


@dataclass
class Windows:
    """Windows of which the columns' words have a good part of the weight: their texts, where they begin,
    the least sum of parts that makes a cosine of LEAST_COSINE, the rows of blocks that each consists of,
    and those blocks' entries (column and weight, cut by block)."""

    row: np.ndarray
    begin: np.ndarray
    norm: np.ndarray
    of: list[np.ndarray]
    column: np.ndarray
    value: np.ndarray
    cuts: np.ndarray


def weighted_windows(it: Items, bounds: np.ndarray, codes: np.ndarray, by_code: np.ndarray) -> list[Windows]:
    """The windows that may have a cosine with some item, WINDOWS blocks together.

    They depend on the weights alone, so finders with the same weights share them.
    """
    n, out = np.diff(bounds), []
    if not it.width or not len(codes):
        return out
    weight_of, column_of = it.weights[bins_of(by_code)], it.columns(by_code)
    inside = (column_of >= 0) & (weight_of > LEAST_WEIGHT)
    at = np.flatnonzero(inside[codes])
    if not len(at):
        return out
    square = weight_of.astype(np.float64) ** 2
    mass, of_columns = (np.append(0.0, np.cumsum(x[codes])) for x in (square, np.where(inside, square, 0.0)))
    # A text's blocks, and after them two empty ones, so that no window reaches into the next text.
    base = np.append(0, np.cumsum(-(-n // BLOCK) + WINDOW - 1))
    doc = np.repeat(np.arange(len(n)), n)[at]
    block = base[doc] + (at - bounds[doc]) // BLOCK
    column, value = column_of[codes[at]], weight_of[codes[at], None]
    starts = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(at))
    for lo in range(0, len(starts) - 1, WINDOWS):  # so that a very long text takes no more memory
        hi = min(lo + WINDOWS, len(starts) - 1)
        # Neighbouring parts share the blocks that a window may begin in before the first.
        first = max(0, lo - WINDOW + 1)
        own = block[starts[first:hi]]
        window = _distinct(np.concatenate([block[starts[lo:hi]] - k for k in range(WINDOW)]))
        d = np.searchsorted(base, window, "right") - 1
        begin = (window - base[d]) * BLOCK
        some = (window >= 0) & (begin < n[d])
        window, d, begin = window[some], d[some], begin[some]
        start = bounds[d] + begin
        end = np.minimum(start + BLOCK * WINDOW, bounds[d + 1])
        total = np.maximum(mass[end] - mass[start], 1e-9)
        # No cosine is above the columns' share of the window (twice it, as words may be repeated).
        some = 2 * (of_columns[end] - of_columns[start]) >= LEAST_COSINE**2 * total
        window, d, begin, total = window[some], d[some], begin[some], total[some]
        used = np.flatnonzero(np.isin(own, np.concatenate([window + k for k in range(WINDOW)])))
        if not len(used):
            continue
        each = np.diff(starts[first : hi + 1])[used]
        entry = _ranges(starts[first + used], each)
        of = [lookup(own[used], window + k) for k in range(WINDOW)]  # -1, where there is no entry, is the empty last row
        norm = (LEAST_COSINE * np.sqrt(total)).astype(np.float32)
        out.append(Windows(d, begin, norm, of, column[entry], value[entry], np.cumsum(each) - each))
    return out


class Finder:
    """Finds items of like lengths in texts."""

    def __init__(self, items: Items, v: np.ndarray):
        self.items, self.v = items, v
        self._parts: list[np.ndarray] | None = None
        projected = []
        for own in items.blocks():
            norms = np.sqrt((own**2).sum(1))
            projected.append(np.where(norms[:, None] > 0, (own @ v) / np.maximum(norms, 1e-9)[:, None], 0).astype(np.float32))
        #: Each item in the latent space, over its norm.
        self.projected = np.concatenate(projected) if projected else np.zeros((0, v.shape[1]), np.float32)
        self.words = np.unique(np.concatenate([*items.words, np.zeros(0, np.uint64)]))
        #: The items that have enough weighted words for the cosine to tell.
        telling = [self._weighted(w) >= min(WEIGHTED, -(-len(w) // 4)) for w in items.words]
        self.by_cosine = np.flatnonzero(np.array(telling, bool))
        rarity = items.weights if items.rarity is None else items.rarity
        self.alone = np.array([least_common(len(w), LCS_ALONE) for w in items.words])
        self.with_answer = np.array([least_common(len(w), LCS_WITH_ANSWER) for w in items.words])
        self.reach = np.array([max(BLOCK * WINDOW, 2 * len(w)) for w in items.words])
        #: Every stretch that the check looks at stands in two neighbouring blocks of so many words.
        self.stretch = int(BLOCK * WINDOW + 2 * self.reach.max()) if len(items.words) else 1
        index, kinds = [], []
        for q, h in enumerate(items.words):
            place = np.searchsorted(self.words, h)
            order = np.argsort(-rarity[bins_of(h)], kind="stable")
            tail = order[order >= len(h) - ANSWER]
            # Of so many words one is there when ``alone`` words are; with the answer all of its words.
            telling = np.unique(np.append(place[order[: len(h) - self.alone[q] + 1]], place[tail[0]]))
            index.append(np.stack([telling, np.full(len(telling), q)]))
            own, times = np.unique(place, return_counts=True)
            kinds.append(np.stack([own, times, np.isin(own, place[-ANSWER:])]))
        index = np.concatenate([*index, np.zeros((2, 0), np.int64)], axis=1)
        index = index[:, np.argsort(index[0], kind="stable")]
        self.index, self.index_at = index[1], np.searchsorted(index[0], np.arange(len(self.words) + 1))
        self.kinds = np.concatenate([*kinds, np.zeros((3, 0), np.int64)], axis=1)
        self.kinds_at = np.append(0, np.cumsum([k.shape[1] for k in kinds])).astype(np.int64)
        self.answer_kinds = np.array([k[2].sum() for k in kinds])
        #: At which places an item's words are, as bits.
        self.places: list[dict[int, int]] = []
        self.codes, shares = [], []
        for q, h in enumerate(items.words):
            place = np.searchsorted(self.words, h)
            own, times, _ = kinds[q]
            weight = (times * items.weights[bins_of(self.words[own])]) ** 2
            shares.append(weight / max(weight.sum(), 1e-9))
            self.places.append(bits_of(place))
            self.codes.append(place)
        #: Each word's share of its item's own weight, beside ``kinds``.
        self.shares = np.concatenate([*shares, np.zeros(0, np.float32)])
        lengths = np.array([len(w) for w in items.words])
        self.least_weight = OWN_WEIGHT * np.minimum(lengths, BLOCK * WINDOW) / np.maximum(lengths, BLOCK * WINDOW)

    def _weighted(self, h: np.ndarray) -> int:
        """How many of an item's words have a weight that tells, and a column."""
        return int(((self.items.weights[bins_of(h)] >= CAP / 8) & (self.items.columns(h) >= 0)).sum())

    def _cosine_parts(self) -> list[np.ndarray]:
        """For each column its part of the cosines with the items, COLUMNS_OF items at a time."""
        if self._parts is None:  # made where it is used; it does not travel
            of = [self.projected[self.by_cosine[i : i + COLUMNS_OF]] for i in range(0, len(self.by_cosine), COLUMNS_OF)]
            self._parts = [(self.v @ p.T).astype(np.float32) for p in of]
        return self._parts

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_parts": None}

    def near(self, windows: list[Windows], first: np.ndarray, stretches: np.ndarray) -> np.ndarray:
        """Stretch times the number of items, plus the item, where a window's cosine is LEAST_COSINE or more."""
        out, m = [np.zeros(0, np.int64)], len(self.items.ids)
        for w in windows:
            for k, parts in enumerate(self._cosine_parts()):
                sums = np.zeros((len(w.cuts) + 1, parts.shape[1]), np.float32)
                sums[:-1] = np.add.reduceat(parts[w.column] * w.value, w.cuts, axis=0)
                cosines = sums[w.of[0]]
                for x in w.of[1:]:
                    cosines += sums[x]
                row, item = np.nonzero(cosines >= w.norm[:, None])
                q = self.by_cosine[k * COLUMNS_OF + item]
                # The stretch that holds all that the check looks at around the window.
                d = w.row[row]
                stretch = np.minimum(np.maximum(w.begin[row] - self.reach[q], 0) // self.stretch, stretches[d] - 1)
                out.append((first[d] + stretch) * m + q)
        return np.unique(np.concatenate(out))

    def in_item(self, q: int, place: np.ndarray) -> np.ndarray:
        """Which of the words (by their places among all items' words, -1: none) are in an item."""
        return np.isin(place, self.kinds[0, self.kinds_at[q] : self.kinds_at[q + 1]])

    def pairs(self, bounds: np.ndarray, place: np.ndarray, windows: list[Windows]) -> list[tuple[int, int, int, int, bool]]:
        """(row, item, start, end, whether the cosine named it) of the candidates' stretches that have
        enough of an item's words."""
        n, width = np.diff(bounds), len(self.words)
        blocks = -(-n // self.stretch)
        stretches = np.where(blocks > 1, blocks - 1, blocks)
        first = np.cumsum(stretches) - stretches
        at = np.flatnonzero(place >= 0)
        doc = np.repeat(np.arange(len(n)), n)[at]
        block = (at - bounds[doc]) // self.stretch
        one, before = block < stretches[doc], block > 0
        key = np.concatenate([(first[doc] + block)[one] * width + place[at[one]], (first[doc] + block - 1)[before] * width + place[at[before]]])
        key = _distinct(key)
        where, word = key // width, key % width
        each = np.diff(self.index_at)[word]
        m = len(self.items.ids)
        near = self.near(windows, first, stretches)
        pair = _distinct(np.append(np.repeat(where, each) * m + self.index[_ranges(self.index_at[word], each)], near))
        out = []
        for lo in range(0, len(pair), 1 << 15):
            where, q = pair[lo : lo + (1 << 15)] // m, pair[lo : lo + (1 << 15)] % m
            each = np.diff(self.kinds_at)[q]
            own, times, of_answer = self.kinds[:, _ranges(self.kinds_at[q], each)]
            there = lookup(key, np.repeat(where, each) * width + own) >= 0
            starts = np.cumsum(each) - each
            common = np.add.reduceat(times * there, starts)
            answer = np.add.reduceat(of_answer * there, starts) == self.answer_kinds[q]
            good = (common >= self.alone[q]) | (answer & (common >= self.with_answer[q]))
            d = np.searchsorted(first, where[good], "right") - 1
            start = bounds[d] + (where[good] - first[d]) * self.stretch
            end = np.minimum(start + 2 * self.stretch, bounds[d + 1])
            led = lookup(near, pair[lo : lo + (1 << 15)][good]) >= 0
            out += zip(d.tolist(), q[good].tolist(), start.tolist(), end.tolist(), led.tolist(), strict=True)
        return out

    def check(self, q: int, words: np.ndarray, at: np.ndarray) -> tuple[int, bool, bool]:
        """Common words, whether the answer is there, and whether that is enough, of a stretch of which
        ``words`` are in the item and stand at ``at``."""
        if len(words) < self.with_answer[q]:
            return 0, False, False
        common = common_words(words, self.places[q])
        if common < self.with_answer[q]:
            return common, False, False
        tail = self.codes[q][-ANSWER:]
        answer = False
        if len(words) >= len(tail):
            runs = (np.lib.stride_tricks.sliding_window_view(words, len(tail)) == tail).all(1)
            answer = bool((runs & (at[len(tail) - 1 :] - at[: len(at) - len(tail) + 1] == len(tail) - 1)).any())
        return common, answer, bool(answer or common >= self.alone[q])

    def by_chance(self, q: int, words: np.ndarray, at: np.ndarray) -> bool:
        """Whether words in the item's order are common ones only, strewn over a wide stretch."""
        own = slice(self.kinds_at[q], self.kinds_at[q + 1])
        if float(self.shares[own][np.isin(self.kinds[0, own], words)].sum()) >= self.least_weight[q]:
            return False
        ends = np.searchsorted(at, at + COMPACT * len(self.codes[q]))
        return not any(z - i >= self.alone[q] and common_words(words[i:z], self.places[q]) >= self.alone[q] for i, z in enumerate(ends.tolist()))

    def span(self, q: int, words: np.ndarray, at: np.ndarray, common: int) -> tuple[int, int]:
        """Start and end of the shortest stretch that ends first, and then starts last, among those
        that hold a common subsequence of so many words."""
        lo, hi = common, len(words)
        while lo < hi:  # the fewest words from the front
            n = (lo + hi) // 2
            lo, hi = (lo, n) if common_words(words[:n], self.places[q]) >= common else (n + 1, hi)
        end, lo, hi = lo, 0, lo - common
        while lo < hi:  # the most words left out before them
            n = (lo + hi + 1) // 2
            lo, hi = (n, hi) if common_words(words[n:end], self.places[q]) >= common else (lo, n - 1)
        return int(at[lo]), int(at[end - 1]) + 1

    def find(self, prepared: tuple[np.ndarray, np.ndarray, np.ndarray], shared: dict[int, list[Windows]] | None = None) -> list[tuple[int, int, int, int, float, int, bool, int]]:
        """(row, item_id, start word, end word, cosine, common words, answer there, item words, whether
        the cosine led there) of what is found in texts that ``plain_words`` has prepared.  ``shared``
        keeps the windows of these texts for other finders with the same weights."""
        it = self.items
        if not len(it.ids):
            return []
        bounds, codes, by_code = prepared
        place = lookup(self.words, by_code)[codes]
        shared = {} if shared is None else shared
        if id(it.weights) not in shared:
            shared[id(it.weights)] = weighted_windows(it, bounds, codes, by_code)
        by_cosine: set[tuple[int, int]] = set()
        out: dict[tuple[int, int], tuple] = {}
        for d, q, start, end, led in self.pairs(bounds, place, shared[id(it.weights)]):
            at = np.flatnonzero(self.in_item(q, place[start:end]))
            words = place[start + at]
            most, _, enough = self.check(q, words, at)
            if not enough:
                continue
            if led:
                by_cosine.add((d, q))
            # Windows that start in the stretch, with the words that the check takes around them.
            lo = np.arange(-(-(start - bounds[d]) // BLOCK) * BLOCK, end - bounds[d], BLOCK) + bounds[d]
            a = np.maximum(lo - self.reach[q], bounds[d])
            z = np.minimum(lo + BLOCK * WINDOW + self.reach[q], bounds[d + 1])
            inside = np.flatnonzero((a >= start) & (z <= end))
            first, last = np.searchsorted(at, a - start), np.searchsorted(at, z - start)
            cosine = self.cosines(q, by_code[codes[start:end]], lo - start)
            done: set[tuple[int, int]] = set()
            for w in inside[np.argsort(-cosine[inside], kind="stable")].tolist():
                i, j = part = (int(first[w]), int(last[w]))
                if part in done:
                    continue
                done.add(part)
                common, answer, enough = self.check(q, words[i:j], at[i:j])
                if not enough or ((d, q) in out and common <= out[d, q][4]) or (not answer and self.by_chance(q, words[i:j], at[i:j])):
                    continue
                first_word, end_word = self.span(q, words[i:j], at[i:j] + (start - bounds[d]), common)
                out[d, q] = (first_word, end_word, it.ids[q], float(cosine[w]), common, answer, len(it.words[q]))
                if common == most:
                    break
        return [(d, v[2], v[0], v[1], *v[3:], (d, q) in by_cosine) for (d, q), v in sorted(out.items())]

    def cosines(self, q: int, h: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The item's cosine in the latent space with the windows from ``lo`` on of the words ``h``."""
        it = self.items
        weight, col = it.weights[bins_of(h)], it.columns(h)
        col[weight <= LEAST_WEIGHT] = -1  # too common to tell
        part = np.where(col >= 0, (self.v[col] @ self.projected[q]) * weight, 0) if it.width else np.zeros(len(h))
        hi = np.minimum(lo + BLOCK * WINDOW, len(h))
        # The item's norm is over the columns only, so its other words are no part of the mass.
        weight = np.where((col < 0) & self.in_item(q, lookup(self.words, h)), 0, weight)
        total, mass = (np.append(0, np.cumsum(x, dtype=np.float64)) for x in (part, weight.astype(np.float64) ** 2))
        return (total[hi] - total[lo]) / np.sqrt(np.maximum(mass[hi] - mass[lo], 1e-9))


def finders(docs: DataFrame, items: list[tuple[int, str]]) -> list[Finder]:
    """Finders for the items: one for each class of lengths and each floor that they need.

    Null and empty items find nothing.
    """
    bounds, codes, by_code = plain_words(pa.array([t for _, t in items], pa.string()))
    h = by_code[codes]
    left = [(i, h[lo:hi]) for (i, _), lo, hi in zip(items, bounds[:-1], bounds[1:], strict=True) if hi > lo]
    out: list[Finder] = []
    if not left:
        return out
    seen = survey(docs.select("text"), telling_words([w for _, w in left]))
    # Rare items need lower floors than the others, and long ones wider stretches.
    by_kind: dict[tuple[float, int], list[tuple[int, np.ndarray]]] = {}
    for i, w in left:
        least = min(WEIGHTED, -(-len(w) // 4))
        floor = next((f for f in FLOORS if (weights_of(seen.rarity[bins_of(w)], f) >= CAP / 8).sum() >= least), FLOORS[-1])
        by_kind.setdefault((floor, len(w).bit_length() // 3), []).append((i, w))
    for floor in FLOORS:
        some = {k: v for k, v in by_kind.items() if k[0] == floor}
        if some:
            weights = weights_of(seen.rarity, floor)
            all_of = [x for v in some.values() for x in v]
            whole = Items([i for i, _ in all_of], [w for _, w in all_of], weights, seen.vocabulary, seen.rarity)
            v = latent_space(seen, whole) if whole.width else np.zeros((0, 1), np.float32)
            out += [Finder(Items([i for i, _ in x], [w for _, w in x], weights, seen.vocabulary, seen.rarity), v) for _, x in sorted(some.items())]
    return out


def _groups(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items with words, by id and text, in groups of MOST_WORDS words."""
    group: list[tuple[int, str]] = []
    size = 0
    for r in benchmark.where("text IS NOT NULL").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        n = len(r["text"].split())
        if group and size + n > MOST_WORDS:
            yield group
            group, size = [], 0
        group.append((r["item_id"], r["text"]))
        size += n
    if group:
        yield group


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, start_word, end_word (the words of
    the document that hold the common subsequence), cosine, common_words, item_words, answer_found,
    by_cosine (whether the cosine search named the place).

    Of several places the one with the most common words counts, then that of the highest cosine,
    then the first.  Null and empty texts: nothing found; very long ones are searched whole.  Null
    ids and repeated rows: each row is searched.  Repeated items: each is found.  Empty tables: empty
    result.  Null and empty item texts find nothing.  Other columns are ignored, whatever their names.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id bigint, item_id bigint, start_word bigint, end_word bigint, cosine double, common_words bigint, item_words bigint, answer_found boolean, by_cosine boolean"
    kinds = [pa.int64()] * 4 + [pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
    names = [x.split()[0] for x in schema.split(", ")]

    def searched(found) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), as_array(batch.column(1))
                rows = []
                for lo, hi in slices(texts):
                    prepared, shared = plain_words(texts.slice(lo, hi - lo)), {}
                    for f in found.value:
                        rows += [(ids[lo + d], i, s, e, round(c, 4), k, m, a, led) for d, i, s, e, c, k, a, m, led in f.find(prepared, shared)]
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        return slim.mapInArrow(tidy(run), schema)

    out = None
    for items in _groups(benchmark):
        part = searched(docs.sparkSession.sparkContext.broadcast(finders(slim, items)))  # bounded by MOST_WORDS
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, in whose text no item is found.

    Null and empty texts stay; very long ones are searched whole.  Null ids do not matter, since texts
    alone decide, and repeated rows fare alike.  Empty
    benchmark: all rows stay; empty ``docs``: empty result.  The columns may have any names.
    """
    at = docs.columns.index(text_col)
    texts_of = docs.select(F.col(text_col).alias("text"))

    def searched(df: DataFrame, found) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = as_array(batch.column(at))
                clean = np.ones(len(texts), bool)
                for lo, hi in slices(texts):
                    prepared, shared = plain_words(texts.slice(lo, hi - lo)), {}
                    for f in found.value:
                        for row in f.find(prepared, shared):
                            clean[lo + row[0]] = False
                yield batch.filter(pa.array(clean))

        return df.mapInArrow(tidy(run), df.schema)

    out = docs
    for items in _groups(benchmark):
        out = searched(out, docs.sparkSession.sparkContext.broadcast(finders(texts_of, items)))  # bounded by MOST_WORDS
    return out


__all__ = ["Finder", "Items", "contaminated", "lcs", "without_contaminated"]
