"""Secret scans: fixed patterns, and a randomness test battery over encoded-looking tokens.

Base spans come from three patterns.  The method then takes every run of 20 or more characters of
the base-64 alphabets that holds a letter and a digit, infers its encoding (hexadecimal, base 32,
36, 62 or 64), and asks whether it could be uniform noise in that alphabet, by three tests:

* chi-squared uniformity, over all characters by the number of equal pairs, whose mean and variance
  are known for short tokens too, and over four groups of them.  Letters are grouped by how common
  they are in words, so words fill the groups unevenly.  The smaller p-value counts, twice;
* runs of lower case, upper case, digits and marks: words and identifiers change class too seldom;
* lag-one serial correlation of the characters' places in the alphabet.

Fisher's rule joins them into one p-value.  Words and identifiers with structure get small ones.  No
encoding has + or / beside - or _: a run that holds both is cut at the rarer pair, and its pieces of
20 or more characters are tested.

Short tokens carry little evidence, so false discoveries are controlled by length class.  Of noise
the p-values are uniform, so those of at least a few hundredths tell how much noise there is in a
class (the estimate of Storey); the cut is the lowest p-value down to which at most a share ``q`` of
the reported tokens is more than noise explains.  The counts behind the cuts cover all distinct tokens
of the corpus and are one row per class and grid cell.  Tokens above the cut and ``LEAST_P`` are added as spans of kind
``random``.  All of it is column expressions.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .native import let, matches

# The base patterns (group 2 of an assignment is its value).
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"[A-Za-z0-9+/_-]{20,}"
# The alphabets, tried in this order.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: What a run that holds characters of both pairs is cut into, at the rarer of them.
PAIRS = {"[+/]": r"[A-Za-z0-9_-]{20,}", "[_-]": r"[A-Za-z0-9+/]{20,}"}
LENGTH_CLASSES = (20, 24, 32, 40, 48, 64, 96)
#: Below it a token is no noise, whatever the counts say: one noise token in a thousand.
LEAST_P = 1e-3
#: Grid of p-values: cell k holds p in (10^-(k+1)/4, 10^-k/4].
CELLS = 60


# The letters by how common they are in English words.
COMMON, MIDDLE, RARE = "etaoinsrh", "ldcumfpgb", "wyvkxjqz"
CLASSES = (r"[a-z]", r"[A-Z]", r"[0-9]", r"[+/_-]")


def _groups(symbols: str) -> list[str]:
    """The four groups of an alphabet's characters for the chi-squared test."""
    if len(symbols) == 16:
        return [symbols[i:j] for i, j in ((0, 5), (5, 10), (10, 13), (13, 16))]
    letters = ["".join(c for c in symbols if c.lower() in g) for g in (COMMON, MIDDLE, RARE)]
    return [*letters, "".join(c for c in symbols if not c.isalpha())]


def _escaped(symbols: str) -> str:
    return "[" + "".join("\\" + c if c in "-_+/" else c for c in symbols) + "]"


def _encoding(symbols: str) -> Column:
    """What the tests need to know of an alphabet."""
    shares = [sum(bool(re.match(c, x)) for x in symbols) / len(symbols) for c in CLASSES]
    change = 1 - sum(p * p for p in shares)  # between neighbours
    both = sum(p * (1 - p) ** 2 for p in shares)  # before and after a character
    groups = _groups(symbols)
    return F.struct(
        F.lit(symbols).alias("symbols"), F.lit(change).alias("change"), F.lit(both - change**2).alias("cov"),
        F.array(*[F.lit(_escaped(g)) for g in groups]).alias("groups"), F.array(*[F.lit(len(g) / len(symbols)) for g in groups]).alias("shares"),
    )


def _tail(z: Column) -> Column:
    """Upper tail of the normal law for z >= 0, by a rational fit times its density (the relative
    error stays below a thousandth as far as the grid of p-values goes)."""
    t = 1 / (1 + 0.2316419 * z)
    fit = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return fit * F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _tail(F.abs(z)))


def _battery(token: Column, of: Column) -> Column:
    """The joint p-value of a token whose characters all stand in the alphabet of an encoding."""
    zero = F.lit(0.0)
    letters = F.split(token, "(?!^)")

    def total(values: Column) -> Column:
        return F.aggregate(values, zero, lambda s, v: s + v)

    def pairs(x: Column, value) -> Column:
        return total(F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x)), value))

    n = F.length(token).cast("double")
    seen = F.transform(of["groups"], lambda g: (n - F.length(F.regexp_replace(token, g, F.lit("")))).cast("double"))
    chi = total(F.zip_with(seen, of["shares"], lambda o, p: (o - n * p) * (o - n * p) / (n * p)))
    # Three degrees of freedom have a closed form.
    p_groups = let(F.greatest(chi, zero), lambda x: 2 * _tail(F.sqrt(x)) + F.sqrt(2 * x / math.pi) * F.exp(-x / 2))
    # Over all characters the statistic is a count of equal pairs, with known mean and variance.
    size, both = F.length(of["symbols"]).cast("double"), n * (n - 1) / 2
    equal = total(F.transform(F.split(of["symbols"], "(?!^)"), lambda c: let((n - F.length(F.replace(token, c, F.lit("")))).cast("double"), lambda o: o * (o - 1) / 2)))
    z_equal = (equal - both / size - 0.5) / F.sqrt(both / size * (1 - 1 / size))
    p_chi = F.least(F.lit(1.0), 2 * F.least(p_groups, F.when(z_equal > 0, _tail(z_equal)).otherwise(1.0)))

    kind = lambda c: F.coalesce(*[F.when(c.rlike(k), i) for i, k in enumerate(CLASSES)])
    turns = pairs(F.transform(letters, kind), lambda a, b: F.when(a != b, 1.0).otherwise(0.0))
    mean, var = (n - 1) * of["change"], (n - 1) * of["change"] * (1 - of["change"]) + 2 * (n - 2) * of["cov"]
    # A count moves in steps of one: half a step of continuity.
    z_runs = F.greatest(F.abs(turns - mean) - 0.5, zero) / F.sqrt(F.greatest(var, F.lit(1e-9)))

    def serial(x: Column) -> Column:
        def about(m: Column) -> Column:
            spread = total(F.transform(x, lambda c: (c - m) * (c - m)))
            lagged = pairs(x, lambda a, b: (a - m) * (b - m))
            return F.when(spread > 1e-9, (lagged / F.greatest(spread, F.lit(1e-9)) + 1 / n) * F.sqrt(n)).otherwise(8.0)

        return let(total(x) / n, about)

    z_serial = let(F.transform(letters, lambda c: (F.instr(of["symbols"], c) - 1).cast("double")), serial)
    ps = F.greatest(p_chi * _two_sided(z_runs) * _two_sided(z_serial), F.lit(1e-290))
    # -ln of the product is half of Fisher's statistic, chi-squared with six degrees of freedom.
    return let(-F.log(ps), lambda h: F.exp(-h) * (1 + h + h * h / 2))


def p_random(token: Column) -> Column:
    """The joint p-value of a token under uniform noise in its encoding; null if it has none."""
    encoding = None
    for symbols in ALPHABETS.values():
        test = token.rlike(f"^{_escaped(symbols)}+$")
        encoding = F.when(test, _encoding(symbols)) if encoding is None else encoding.when(test, _encoding(symbols))
    mixed = token.rlike("[0-9]") & token.rlike("[A-Za-z]")
    return F.when(mixed, let(encoding, lambda e: F.when(e.isNotNull(), _battery(token, e))))


def _pieces(m: Column) -> Column:
    """A match of TOKEN as an array of itself, or of its pieces if no alphabet holds all of it."""
    (slash, no_slash), (dash, no_dash) = PAIRS.items()
    hit = m["hit"]

    def cut(pattern: str) -> Column:
        return F.transform(matches(hit, pattern), lambda x: F.struct((m["start"] + x["start"]).alias("start"), (m["start"] + x["end"]).alias("end"), x["hit"].alias("hit")))

    def first(pattern: str, other: str) -> Column:
        return let(cut(pattern), lambda x: F.when(F.size(x) > 0, x).otherwise(cut(other)))

    slashes, dashes = (F.length(hit) - F.length(F.regexp_replace(hit, p, "")) for p in (slash, dash))
    # At the other pair if no piece is long enough; a tie is cut at the slashes.
    pieces = F.when(slashes <= dashes, first(no_slash, no_dash)).otherwise(first(no_dash, no_slash))
    return F.when((slashes > 0) & (dashes > 0), pieces).otherwise(F.array(m))


def candidates(text: Column) -> Column:
    """Tokens of a text: array of (start, end, p, class, cell, id); tokens without an encoding are left out."""

    def one(m: Column) -> Column:
        n = m["end"] - m["start"]
        k = F.lit(-1)
        for i, least in enumerate(LENGTH_CLASSES):
            k = F.when(n >= least, i).otherwise(k)
        return let(
            p_random(m["hit"]),
            lambda p: F.struct(
                m["start"].alias("start"), m["end"].alias("end"), p.alias("p"), k.alias("class"),
                F.least(F.lit(CELLS - 1), F.floor(-4 * F.log10(F.greatest(p, F.lit(1e-30))))).cast("int").alias("cell"),
                F.xxhash64(m["hit"]).alias("id"),
            ),
        )

    return F.filter(F.transform(F.flatten(F.transform(matches(text, TOKEN), _pieces)), one), lambda c: c["p"].isNotNull())


def cuts(counts: list[tuple[int, int, int]], q: float) -> dict[int, int]:
    """For each length class the first grid cell whose tokens are not reported (CELLS: none).

    ``counts``: (class, cell, tokens).  Cells up to k hold the p-values above c = 10^(-(k+1)/4), and
    of N noise tokens N (1 - c) are there.  N is at most the tokens above c, and three that chance may
    have left out, over 1 - c, for each c down to a hundredth.  The cut follows the last k at which at
    most a share q of the tokens up to it is more than that noise.
    """
    out = {}
    above = [10 ** (-(k + 1) / 4) for k in range(CELLS)]
    for k in range(len(LENGTH_CLASSES)):
        own = [0] * CELLS
        for c, cell, n in counts:
            if c == k:
                own[cell] += n
        upto = [sum(own[: cell + 1]) for cell in range(CELLS)]
        noise = min((upto[cell] + 3) / (1 - above[cell]) for cell in range(8))
        fine = [cell for cell in range(CELLS) if upto[cell] - noise * (1 - above[cell]) <= q * upto[cell]]
        out[k] = max(fine, default=-1) + 1
    return out


def scan(docs: DataFrame, q: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, found.

    ``found`` is the array of (start, kind, end), in code points, end exclusive, by start and then
    by kind as in KINDS; a token that is also a base span stands under both kinds.  Null and empty
    texts: no spans.  Very long texts are scanned whole.  Null ids and repeated rows: each row is
    scanned.  Empty table: empty result.  Other columns are ignored, whatever their names.  The texts
    are read once; a small job then counts the p-values of all tokens.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")

    def span(kind: int):
        return lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"))

    assign = F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["hit"], ASSIGN, 2)) >= 8)
    # Spans and tested tokens without the texts, written once: the cuts need them all first.
    tested = saved(
        slim.select(
            "doc_id",
            F.transform(assign, span(0)).alias("assign"),
            F.transform(matches(text, ACCESS), span(1)).alias("access"),
            F.transform(matches(text, HEX), span(2)).alias("hex"),
            candidates(text).alias("tokens"),
        ),
        "secrets",
    )
    # Copies of a token are one piece of evidence.
    cells = tested.select(F.explode("tokens").alias("c")).select("c.class", "c.cell", "c.id").distinct().groupBy("class", "cell").count()
    cut = cuts([(r[0], r[1], r[2]) for r in cells.collect()], q)  # at most 7 x 60 rows
    stays = F.create_map(*[F.lit(x) for kv in cut.items() for x in kv])
    random = F.filter("tokens", lambda c: (c["cell"] < stays[c["class"]]) & (c["p"] >= LEAST_P))
    found = tested.select("doc_id", "assign", "access", "hex", F.transform(random, span(3)).alias("random"))
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans: Column) -> Column:
        return F.array_join(
            F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))),
            ",",
        )

    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat(base, "random")).alias("spans"),
        F.array_sort(F.concat(base, "random")).alias("found"),
    )
