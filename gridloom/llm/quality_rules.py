"""Quality rules: a learned decision list over document statistics, as Spark conditionals.

The statistics are column expressions.  The list is learned by sequential covering from labelled
rows: a rule is a conjunction of thresholds that grows by the condition of highest FOIL gain on two
thirds of the rows still uncovered, is pruned back on the other third, and is kept while it is
precise there; the rows it covers are then taken out.  The ordered rules become one ``CASE WHEN``.

The learner sees at most ``max_rows`` labelled rows (the lowest digests of their ids), eleven
numbers each, so the driver's share is bounded; the statistics and the rules run over all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import WORD_BREAK, let, words
from .training import labelled_sample

#: Labelled rows that the learner may see.
MAX_ROWS = 20_000
FEATURES = (
    "n_words", "word_len", "symbol_share", "dup_line_share", "repeat_share", "upper_share",
    "digit_share", "mark_share", "distinct_share", "line_words",
)


def repeat_words(ws: Column) -> Column:
    """How many words stand in a 3-word window that occurs twice or more in the same text."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(ws) - 3),
        lambda i: F.struct(F.xxhash64(ws[i], ws[i + 1], ws[i + 2]).alias("h"), i.alias("i")),
    )

    def covered(s: Column) -> Column:
        last = F.size(s) - 1
        twice = F.filter(
            s,
            lambda x, j: ((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["h"] == x["h"]))
            | ((j < last) & (s[F.least(j + 1, last)]["h"] == x["h"])),
        )
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(-3).alias("p"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            at, start,
            lambda a, p: F.struct(p.alias("p"), (a["n"] + F.least(F.lit(3), p - a["p"])).alias("n")),
            lambda a: a["n"],
        )

    return F.when(F.size(ws) < 4, F.lit(0).cast("long")).otherwise(let(F.sort_array(windows), covered))


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add a struct column ``_stats`` with the base counts and the learner's features."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def removed(pattern: str) -> Column:
        return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")

    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(
        words(text),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            repeat_words(ws).alias("n_repeat_words"),
            F.size(F.array_distinct(ws)).cast("long").alias("n_distinct"),
        ),
    )
    per_line = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    extra = F.struct(
        removed(r"[#*$%&|<>]+").alias("n_symbols"),
        removed(r"[A-Z]+").alias("n_upper"),
        removed(r"[0-9]+").alias("n_digits"),
        removed(r"[!?]+").alias("n_marks"),
    )
    return docs.withColumn("_c", counts).withColumn("_l", per_line).withColumn("_x", extra)


def features() -> dict[str, Column]:
    """The learner's features over the columns of ``with_statistics``."""
    c = lambda k: F.col(k).cast("double")
    n, chars, lines = F.greatest(c("_c.n_words"), F.lit(1.0)), F.greatest(c("_c.word_chars"), F.lit(1.0)), F.greatest(c("_l.n_lines"), F.lit(1.0))
    return {
        "n_words": c("_c.n_words"),
        "word_len": c("_c.word_chars") / n,
        "symbol_share": c("_x.n_symbols") / chars,
        "dup_line_share": c("_l.n_dup_lines") / lines,
        "repeat_share": c("_c.n_repeat_words") / n,
        "upper_share": c("_x.n_upper") / chars,
        "digit_share": c("_x.n_digits") / chars,
        "mark_share": c("_x.n_marks") / chars,
        "distinct_share": c("_c.n_distinct") / n,
        "line_words": c("_c.n_words") / lines,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
        v = x[:, names.index(self.feature)]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self, of: dict[str, Column]) -> Column:
        v = of[self.feature]
        return v > self.threshold if self.above else v <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x, names)
    return out


def _thresholds(x: np.ndarray, most: int = 48) -> list[np.ndarray]:
    cuts = []
    for k in range(x.shape[1]):
        v = np.unique(x[:, k])
        if len(v) > most:
            v = np.unique(np.quantile(x[:, k], np.linspace(0, 1, most + 1)))
        cuts.append((v[1:] + v[:-1]) / 2)
    return cuts


def grow(x: np.ndarray, bad: np.ndarray, names: tuple[str, ...], most: int = 4) -> Rule:
    """Add the condition of highest FOIL gain until the rule covers low-quality rows only."""
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < most:
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p or not n:
            break
        now, best, gain = np.log2(p / (p + n)), None, 1e-9
        xi, bi = x[inside], bad[inside]
        for k, cut in enumerate(_thresholds(xi)):
            order = np.argsort(xi[:, k], kind="stable")
            v, b = xi[order, k], np.concatenate(([0], np.cumsum(bi[order])))
            at = np.searchsorted(v, cut, "right")
            for above in (False, True):
                p1 = b[-1] - b[at] if above else b[at]
                all1 = len(v) - at if above else at
                g = np.where(p1 > 0, p1 * (np.log2(np.maximum(p1, 1e-9) / np.maximum(all1, 1)) - now), 0)
                if len(g) and g.max() > gain:
                    gain, best = float(g.max()), Condition(names[k], above, float(cut[int(g.argmax())]))
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x, names)
    return tuple(rule)


def prune(rule: Rule, x: np.ndarray, bad: np.ndarray, names: tuple[str, ...]) -> Rule:
    """Drop final conditions while (covered bad - covered good) / covered does not fall."""

    def value(r: Rule) -> float:
        c = _covers(r, x, names)
        p, n = int((c & bad).sum()), int((c & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if value(rule[:k]) >= value(best):
            best = rule[:k]
    return best


def learn(x: np.ndarray, bad: np.ndarray, names: tuple[str, ...] = FEATURES, precision: float = 0.95, most: int = 12) -> list[Rule]:
    """The ordered rules that reject; no rows or no low-quality row: no rules."""
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < most and (left & bad).sum() >= 3:
        at = np.flatnonzero(left)
        hold = at[len(rules) % 3 :: 3]
        fit = np.setdiff1d(at, hold)
        rule = grow(x[fit], bad[fit], names)
        if not rule:
            break
        rule = prune(rule, x[hold], bad[hold], names)
        c = _covers(rule, x[at], names)
        right = (c & bad[at]).sum()
        if not right or right / c.sum() < precision:
            break
        rules.append(rule)
        left[at[c]] = False
    return rules


def as_column(rules: list[Rule], of: dict[str, Column]) -> Column:
    """The number (from 1) of the first rule that rejects a row, else 0: one CASE WHEN."""
    out = None
    for k, rule in enumerate(rules, 1):
        test = rule[0].column(of)
        for c in rule[1:]:
            test = test & c.column(of)
        out = F.when(test, k) if out is None else out.when(test, k)
    return (F.lit(0) if out is None else out.otherwise(0)).cast("int")


def fit_rules(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **kw) -> list[Rule]:
    """Learn from the labelled rows (doc_id, quality 0/1) of ``docs``; null labels are left out.

    Repeated label rows of one id count once, with the lowest quality.
    """
    of = features()
    slim = labelled_sample(docs.select("doc_id", "text"), labels, "quality", max_rows, worst=F.min)
    rows = with_statistics(slim).select(*[v.alias(k) for k, v in of.items()], "_label", "doc_id").collect()
    rows.sort(key=lambda r: tuple(r))
    x = np.array([r[: len(of)] for r in rows], float).reshape(len(rows), len(of))
    bad = np.array([r["_label"] == 0 for r in rows], bool)
    order = np.random.default_rng(7).permutation(len(rows))
    return learn(x[order], bad[order], tuple(of), **kw)


def apply_rules(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, rule (the first rejecting rule, 0: none) and kept.

    Null and empty texts: all counts 0, base_failed.  Very long texts are counted whole, by sorting
    their windows.  Null ids and repeated rows: each row is judged.  The first of several rules that
    hold decides.  Empty table: empty result.  Other columns are ignored, whatever their names.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = with_statistics(slim).select(
        "doc_id",
        F.col("_c.n_words").alias("n_words"),
        F.col("_c.word_chars").alias("word_chars"),
        F.col("_x.n_symbols").alias("n_symbols"),
        F.col("_l.n_dup_lines").alias("n_dup_lines"),
        F.col("_c.n_repeat_words").alias("n_repeat_words"),
        as_column(rules, features()).alias("rule"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


__all__ = ["WORD_BREAK", "Condition", "apply_rules", "as_column", "fit_rules", "learn", "with_statistics"]
