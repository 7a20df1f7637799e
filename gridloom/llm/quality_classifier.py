"""Quality classification by hierarchical empirical Bayes.

Evidence: a ridge logistic model over binned document statistics, learned from at most
``max_rows`` labelled rows, gives each document the log-odds of low quality; taking off the
sample's own log-odds leaves the log-likelihood ratio of the document.

Priors: each host and each path of a host has its own rate of low quality.  The expected counts
under the evidence, summed by grouped aggregation, estimate them, shrunk twice: a host's rate
toward the global one, a path's toward its host's, with strengths from the spread of the rates
(method of moments), so a path of few documents keeps its host's rate.  A document's posterior
adds its evidence to its path's prior log-odds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .native import let, words
from .training import fit_logistic, labelled_sample

MAX_ROWS = 20_000
BINS = 12
#: Paths that may be broadcast (about 100 bytes each); more are joined by shuffle.
MOST_BROADCAST = 100_000
#: A prior moves a document by at most this much log-odds: evidence decides, hosts shade.
PRIOR_REACH = 2.0


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text as shares and lengths; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")

    def share(pattern: str) -> Column:
        return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / chars

    lines = F.split(text, "\n", -1)
    n_lines = F.size(lines).cast("double")
    n, distinct, length = F.col("_w.n").cast("double"), F.col("_w.d").cast("double"), F.col("_w.c").cast("double")
    some = F.greatest(n, F.lit(1.0))
    return {
        "words": F.log1p(n),
        "word_length": length / some,
        "distinct": distinct / some,
        "symbols": share(r"[#*$%&|<>]+"),
        "upper": share(r"[A-Z]+"),
        "digits": share(r"[0-9]+"),
        "marks": share(r"[!?]+"),
        "stops": share(r"[.,;:]+"),
        "line_words": F.log1p(n / n_lines),
        "repeated_lines": (n_lines - F.size(F.array_distinct(lines))) / n_lines,
    }


def with_words(df: DataFrame, text: Column) -> DataFrame:
    counts = F.transform(
        F.array(words(text)),
        lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"), F.length(F.array_join(w, "")).alias("c")),
    )[0]
    return df.withColumn("_w", counts)


@dataclass
class Evidence:
    """Binned logistic model: for each statistic its inner bin edges and its bins' log-odds."""

    edges: dict[str, list[float]] = field(default_factory=dict)
    weights: dict[str, list[float]] = field(default_factory=dict)
    intercept: float = 0.0
    base: float = 0.0  # log-odds of low quality in the sample

    def column(self, of: dict[str, Column]) -> Column:
        """The log-likelihood ratio of low quality."""
        out = F.lit(self.intercept - self.base)
        for name, edges in self.edges.items():
            w = self.weights[name]
            part = F.lit(w[-1])
            for edge, weight in zip(reversed(edges), reversed(w[:-1]), strict=True):
                part = F.when(of[name] <= edge, weight).otherwise(part)
            out = out + part
        return out


def fit_evidence(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Evidence:
    """Learn from labelled rows (quality 0/1, 1 good); no labels: no evidence and even odds."""
    some = labelled_sample(docs.select("doc_id", "text"), labels, "quality", max_rows, worst=F.min)
    of = statistics(F.col("text"))
    rows = with_words(some, F.col("text")).select(*[c.alias(k) for k, c in of.items()], "_label").collect()
    rows = np.array(sorted(tuple(r) for r in rows), float).reshape(len(rows), len(of) + 1)
    x, bad = rows[:, :-1], (rows[:, -1] == 0).astype(float)
    base = (bad.sum() + 0.5) / (len(bad) + 1)
    model = Evidence(base=float(np.log(base / (1 - base))))
    parts = []
    for k, name in enumerate(of):
        edges = np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0)
        # Finer at the ends, where what is unusual lies.
        if len(x):
            edges = np.unique(np.concatenate((edges, np.quantile(x[:, k], [0.01, 0.03, 0.97, 0.99]))))
        model.edges[name] = edges.tolist()
        parts.append(np.eye(len(edges) + 1)[np.searchsorted(edges, x[:, k], "left")])
    w, model.intercept = fit_logistic(np.hstack(parts), bad)
    at = 0
    for name in of:
        size = len(model.edges[name]) + 1
        model.weights[name] = w[at : at + size].tolist()
        at += size
    return model


def _expected(llr: Column, log_odds: Column | float) -> Column:
    return 1 / (1 + F.exp(-(llr + log_odds)))


def priors(evidence: DataFrame, base: float) -> DataFrame:
    """(host, path, prior): each path's shrunken log-odds, from rows (host, path, llr).

    Strength of shrinkage at each level: mean * (1 - mean) / variance of the rates between the
    groups, less what sampling alone gives, at least 1.
    """
    groups = evidence.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), F.sum(_expected(F.col("llr"), base)).alias("s")
    )
    groups = saved(groups, "priors")
    hosts = groups.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))

    def strength(df: DataFrame, n: str, s: str, centre: Column) -> float:
        rate, weight = F.col(s) / F.col(n), F.col(n)
        r = df.agg(
            F.sum(weight * (rate - centre) ** 2).alias("v"), F.sum(weight).alias("w"), F.count(F.lit(1)).alias("g"),
            F.sum(weight * centre * (1 - centre)).alias("b"),
        ).first()
        if not r["w"]:
            return 1.0
        within = r["b"] / r["w"]
        between = max((r["v"] - (r["g"] - 1) * within) / r["w"], 1e-6)
        return float(min(max(within / between, 1.0), 1e6))

    total = groups.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    rate = (total["s"] / total["n"]) if total["n"] else 0.5
    rate = min(max(rate, 1e-4), 1 - 1e-4)
    k1 = strength(hosts, "hn", "hs", F.lit(rate))
    hosts = hosts.withColumn("hr", (F.col("hs") + k1 * rate) / (F.col("hn") + k1))
    both = groups.join(hosts, "host")
    k2 = strength(both, "n", "s", F.col("hr"))
    r = (F.col("s") + k2 * F.col("hr")) / (F.col("n") + k2)
    r = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), r))
    odds = F.log(r / (1 - r))
    near = F.greatest(F.lit(base - PRIOR_REACH), F.least(F.lit(base + PRIOR_REACH), odds))
    return both.select("host", "path", near.alias("prior"), r.alias("path_rate"), F.col("hr").alias("host_rate"))


def scored(
    docs: DataFrame, labels: DataFrame, text_col: str = "text", host_col: str = "source", path_col: str = "lang",
    id_col: str = "doc_id", max_rows: int = MAX_ROWS, carried: Sequence[str] | None = None,
) -> DataFrame:
    """(row, evidence, host_rate, path_rate, p_low, kept): ``row`` is the struct of the columns of
    ``docs`` that are ``carried``, all of them unless given; ``kept`` unless the posterior of low quality is above one half.

    Null and empty texts have the statistics of an empty text; very long ones are read whole.  Null
    hosts and paths are groups of their own.  Null ids and repeated rows: each row is scored.  Equal
    posteriors fare alike, and one half is kept, so without labels every row is.  Empty table: empty
    result.  Columns travel in ``row``, so their names clash with none; what is carried is written
    once, so a caller that needs no text leaves it out.  Repeated label rows of one id count once,
    with the lowest quality.
    """
    packed = docs.select(
        F.struct(*(docs.columns if carried is None else carried)).alias("row"), F.col(text_col).alias("text"),
        F.coalesce(F.concat(F.lit("="), F.col(host_col)), F.lit("")).alias("host"),
        F.coalesce(F.concat(F.lit("="), F.col(path_col)), F.lit("")).alias("path"),
    )
    model = fit_evidence(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, max_rows)
    # The statistics stand once for each row, not once for each bin that is compared with them.
    once = F.struct(*[c.alias(k) for k, c in statistics(F.col("text")).items()])
    llr = let(once, lambda s: model.column({k: s[k] for k in model.edges}))
    # Written once, since the priors and the posteriors both read the evidence.
    judged = saved(with_words(packed, F.col("text")).select("row", "host", "path", llr.alias("llr")), "judged")
    table = saved(priors(judged, model.base), "path-priors")
    few = table.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    out = judged.join(F.broadcast(table) if few else table, ["host", "path"])
    p = _expected(F.col("llr"), F.col("prior"))
    # Never null, so that a filter on it infers no null test that would make the evidence again.
    kept = F.coalesce(p <= 0.5, F.lit(True))
    return out.select("row", F.col("llr").alias("evidence"), "host_rate", "path_rate", p.alias("p_low"), kept.alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that the classifier keeps.

    Nulls, empty and very long texts, repeated rows, clashing names and empty tables: as in ``scored``.
    """
    return scored(docs, labels, **kw).where("kept").select("row.*")
