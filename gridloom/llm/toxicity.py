"""Toxicity by a classifier chain over hashed words and word beginnings.

The chain predicts categories in a given order, each a label of its own: by default low quality,
then toxicity.  The model of each category sees the text features and the probabilities of the
categories before it, and learns from the rows whose label it knows.  In training those
probabilities are out-of-fold: each fold's come from models that have not seen it, as the ones at
prediction come from unseen texts.  So what many rows tell of an earlier category helps a later one
that few rows are labelled for.

Text features are the words of a text (present or not, lower-cased, marks at the ends taken off)
and their beginnings of ``STEMS`` characters.  Of all features in the sample the ``N_FEATURES`` of
highest chi-squared are kept, if it is at least ``LEAST_CHI``: those of the last category first.
The sample holds at most ``max_rows`` labelled rows and ``MAX_FEATURES`` distinct features, so what
the driver holds is bounded; prediction runs over all rows by Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_array, hashes, saved, slices, split_words
from .training import fit_logistic, sigmoid

MAX_ROWS = 6_000
N_FEATURES = 600
#: Features that many rows hold, which come to the driver to be counted; the rarer ones stay away.
MAX_FEATURES = 1 << 18
#: The chain's categories and the label that each is read from: the worst value of each document.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}
#: Least chi-squared of a feature: one in two thousand by chance.
LEAST_CHI = 12.0
STEMS = (5, 7)
FOLDS = 4
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def feature_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and 64-bit features; a pair may stand more than once."""
    bounds, codes, words = split_words(texts)
    plain = pc.utf8_trim(pc.utf8_lower(words), MARKS)
    kinds = [hashes(plain)]
    for k in STEMS:
        with np.errstate(over="ignore"):
            kinds.append(hashes(pc.utf8_slice_codeunits(plain, 0, k)) * np.uint64(2 * k + 1))
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    # Each word of a text once, before its features are listed.
    pairs = np.unique(row * np.int64(1 + len(plain)) + codes.astype(np.int64))
    row, codes = pairs // (1 + len(plain)), pairs % (1 + len(plain))
    return np.tile(row, len(kinds)), np.concatenate([h[codes] for h in kinds])


@dataclass
class Chain:
    """features: sorted hashes; models: for each category its weights and intercept."""

    categories: tuple[str, ...]
    features: np.ndarray
    models: list[tuple[np.ndarray, float]]
    threshold: float = 0.5  # of the last category

    def matrix(self, texts: pa.Array) -> np.ndarray:
        """Rows by features, 1 where present, and one column for the number of features present."""
        x = np.zeros((len(texts), len(self.features) + 1), np.float32)
        if len(self.features):
            row, h = feature_hashes(texts)
            at = np.minimum(np.searchsorted(self.features, h), len(self.features) - 1)
            hit = self.features[at] == h
            x[row[hit], at[hit]] = 1
            x[:, -1] = np.log1p(x[:, :-1].sum(1))
        return x

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, rows by categories."""
        out = np.zeros((len(x), len(self.categories)), np.float64)
        for k, (w, b) in enumerate(self.models):
            out[:, k] = sigmoid(np.hstack([x, out[:, :k]]) @ w + b)
        return out


def fit_chain(categories: tuple[str, ...], features: np.ndarray, x: np.ndarray, y: np.ndarray, l2: float = 0.5) -> Chain:
    """x: rows by features, y: rows by categories (0/1, NaN where it is not known)."""
    fold = np.random.default_rng(3).permutation(len(x)) % FOLDS
    earlier = np.zeros((len(x), 0))
    models = []
    for k in range(len(categories)):
        own, known = np.hstack([x, earlier]), ~np.isnan(y[:, k])
        models.append(fit_logistic(own[known], y[known, k], l2))
        p = np.zeros(len(x))
        for f in range(FOLDS):
            if (fold == f).any():
                w, b = fit_logistic(own[known & (fold != f)], y[known & (fold != f), k], l2)
                p[fold == f] = sigmoid(own[fold == f] @ w + b)
        earlier = np.hstack([earlier, p[:, None]])
    known = ~np.isnan(y[:, -1])
    return Chain(categories, features, models, best_threshold(earlier[known, -1], y[known, -1]))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of highest F1 on out-of-fold probabilities, at most one half."""
    by = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[by])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(y.sum(), 1))
    last = np.append(p[by][1:] < p[by][:-1], True) if len(y) else np.zeros(0, bool)
    if not last.any() or not y.any():
        return 0.5
    k = int(np.argmax(np.where(last, f1, -1)))
    below = p[by][k + 1] if k + 1 < len(y) else 0.0
    return float(min(0.5, (p[by][k] + below) / 2))


def _chi_squared(seen: np.ndarray, seen_pos: np.ndarray, n: int, n_pos: int) -> np.ndarray:
    """Chi-squared of presence against a category, for features that point toward it."""
    a, b = seen_pos, seen - seen_pos
    c, d = n_pos - a, n - n_pos - b
    below = np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1e-9)
    return np.where(a * d > b * c, n * (a * d - b * c) ** 2 / below, 0)


def train(
    docs: DataFrame, labels: DataFrame, categories: Mapping[str, str] | None = None, max_rows: int = MAX_ROWS, n_features: int = N_FEATURES
) -> Chain:
    """A chain over ``categories`` (name to an expression over the label columns, 1 where it holds).

    A document's label in a category is the worst of its label rows, null where it has none.  Null
    ids are left out.  No labels: a chain without features, which finds nothing.  Null and empty
    texts have no features; very long ones are read whole.
    """
    categories = dict(categories or CATEGORIES)
    marks = [F.max(F.expr(e)).cast("double").alias(f"_y{k}") for k, e in enumerate(categories.values())]
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*marks).where(" OR ".join(f"_y{k} IS NOT NULL" for k in range(len(marks))))
    known = known.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary"))).limit(max_rows)
    names = [f"_y{k}" for k in range(len(marks))]
    some = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # max_rows rows of a few numbers

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_array(batch.column(1))
            for lo, hi in slices(texts):
                row, h = feature_hashes(texts.slice(lo, hi - lo))
                by = np.argsort(row, kind="stable")
                cuts = np.searchsorted(row[by], np.arange(hi - lo + 1))
                data = [np.unique(h[by[cuts[i] : cuts[i + 1]]]).view(np.int64) for i in range(hi - lo)]
                own = [c.slice(lo, hi - lo) for c in batch.columns]
                yield pa.record_batch([own[0], pa.array(data, pa.list_(pa.int64())), *own[2:]], names=["doc_id", "h", *names])

    kind = "doc_id bigint, h array<bigint>, " + ", ".join(f"{n} double" for n in names)
    sample = saved(some.select("doc_id", "text", *names).mapInArrow(listed, kind), "toxicity-sample")
    # Features that fewer than three rows hold can't be learned from.  Each is counted by category.
    counted = sample.select(F.explode("h").alias("h"), *names).groupBy("h").agg(F.count(F.lit(1)).alias("n"), *[F.count(n).alias(f"n{n}") for n in names], *[F.sum(n).alias(f"p{n}") for n in names])
    counted = counted.where("n >= 3").orderBy(F.desc("n"), "h").limit(MAX_FEATURES).collect()  # MAX_FEATURES rows of a few numbers
    totals = sample.agg(*[F.count(n).alias(f"n{n}") for n in names], *[F.sum(n).alias(f"p{n}") for n in names]).first()
    if not counted:
        return Chain(tuple(categories), np.zeros(0, np.uint64), [(np.zeros(1 + k), -3.0) for k in range(len(categories))])
    values = np.array([r["h"] for r in counted], np.int64).view(np.uint64)
    chosen: list[int] = []
    for n in reversed(names):
        seen, pos = (np.array([r[c + n] or 0 for r in counted], float) for c in "np")
        score = _chi_squared(seen, pos, totals["n" + n], int(totals["p" + n] or 0))
        more = np.argsort(-score, kind="stable")
        chosen += [i for i in more[score[more] >= LEAST_CHI].tolist() if i not in set(chosen)][: n_features - len(chosen)]
    features = np.sort(values[np.array(sorted(chosen), np.int64)])
    # Only the chosen features of the sample's rows come to the driver.
    wanted = docs.sparkSession.sparkContext.broadcast(features)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.flatnonzero(np.isin(wanted.value, np.array(h, np.int64).view(np.uint64))).astype(np.int32) for h in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.int32())), *batch.columns[2:]], names=["doc_id", "at", *names])

    rows = sample.mapInArrow(places, kind.replace("h array<bigint>", "at array<int>")).collect()  # max_rows rows of n_features at most
    rows.sort(key=lambda r: tuple((v is None, v) for v in (r["doc_id"], r["at"], *[r[n] for n in names])))
    x = np.zeros((len(rows), len(features) + 1), np.float32)
    for i, r in enumerate(rows):
        x[i, r["at"]] = 1
    x[:, -1] = np.log1p(x[:, :-1].sum(1))
    y = np.array([[np.nan if r[n] is None else r[n] for n in names] for r in rows], float)
    return fit_chain(tuple(categories), features, x, y)


def predict(docs: DataFrame, chain: Chain, threshold: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, p_<category> of each category in the chain's order (rounded to 6 places), toxic.

    ``toxic``: the last category's probability reaches the threshold, the chain's own by default; a
    tie with it counts.  Null and empty texts have no features; very long ones are read whole.  Null
    ids and repeated rows: each row is scored.  Empty table: empty result.  Other columns are
    ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # N_FEATURES hashes and weights
    least = chain.threshold if threshold is None else threshold
    names = ["doc_id", *[f"p_{c}" for c in chain.categories], "toxic"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_array(batch.column(1))
            for lo, hi in slices(texts):
                p = shared.value.predict(shared.value.matrix(texts.slice(lo, hi - lo)))
                yield pa.record_batch(
                    [batch.column(0).slice(lo, hi - lo), *[pa.array(np.round(c, 6)) for c in p.T], pa.array(p[:, -1] >= least)], names=names
                )

    schema = "doc_id bigint, " + ", ".join(f"p_{c} double" for c in chain.categories) + ", toxic boolean"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
