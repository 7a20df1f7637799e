"""Sums of doubles that do not depend on the order of the rows.

A double is a whole number of units of 2^-1074.  Such numbers are added up as digits of 32 bits:
a value spreads over three neighbouring digits, each digit is a sum of integers, which Spark may
add in any order and combine on the map side, and the digits of a group, 70 at most, are put
together at the end and rounded once.  The result is the double nearest to the true sum.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A digit's bits, and the exponent of the last unit of a double.
DIGIT, LEAST = 32, 1074
#: Digits that count what is no number: infinities and NaN.
PLUS, MINUS, NAN = -1, -2, -3

PARTS = "array<struct<digit:int,value:bigint>>"


def digits(x: Column) -> Column:
    """The digits of a double as (digit, value); null has none."""
    x = x.cast("double")
    size = F.abs(x)
    # One below the exponent, since a logarithm may be rounded up to the next whole number.
    top = F.greatest(F.floor(F.log2(size)) - 1, F.lit(-LEAST))
    digit = F.greatest(F.floor((top - 52 + LEAST) / DIGIT), F.lit(0)).cast("int")
    up = F.lit(LEAST) - digit * DIGIT  # the scale goes in halves, as the whole may have no double
    half = F.floor(up / 2)
    whole = x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), up - half)

    def split(y: Column) -> Column:
        two = F.floor(y / float(1 << 64)).cast("double")
        rest = y - two * float(1 << 64)
        one = F.floor(rest / float(1 << 32)).cast("double")
        parts = [rest - one * float(1 << 32), one, two]
        return F.array(*[F.struct((digit + n).alias("digit"), p.cast("bigint").alias("value")) for n, p in enumerate(parts)])

    def only(kind: int) -> Column:
        return F.array(F.struct(F.lit(kind).alias("digit"), F.lit(1).cast("bigint").alias("value")))

    odd = F.when(F.isnan(x), only(NAN)).when(x == math.inf, only(PLUS)).when(x == -math.inf, only(MINUS))
    none = F.array().cast(PARTS)
    return odd.when(x.isNull() | (x == 0), none).otherwise(F.transform(F.array(whole), split)[0]).cast(PARTS)


def digits_of(values: np.ndarray) -> dict[int, int]:
    """The digits of the sum of many doubles."""
    out: dict[int, int] = {}
    values = np.asarray(values, np.float64).reshape(-1)
    for kind, found in ((NAN, np.isnan(values)), (PLUS, values == np.inf), (MINUS, values == -np.inf)):
        if found.any():
            out[kind] = int(found.sum())
    values = values[np.isfinite(values) & (values != 0)]
    for at in range(0, len(values), 1 << 19):  # sums of so many digits are exact in a double
        m, e = np.frexp(values[at : at + (1 << 19)])
        whole = np.abs(np.ldexp(m, 53)).astype(np.uint64)
        shift = e.astype(np.int64) - 53 + LEAST
        whole >>= np.maximum(-shift, 0).astype(np.uint64)
        shift = np.maximum(shift, 0)
        by, mask = (shift % DIGIT).astype(np.uint64), np.uint64((1 << DIGIT) - 1)
        low, high = (whole & mask) << by, (whole >> np.uint64(DIGIT)) << by
        first = shift // DIGIT
        parts = (low & mask, (low >> np.uint64(DIGIT)) + (high & mask), high >> np.uint64(DIGIT))
        for n, p in enumerate(parts):
            sums = np.bincount(first + n, weights=np.copysign(p.astype(np.float64), m))
            for d in np.flatnonzero(sums).tolist():
                out[d] = out.get(d, 0) + int(sums[d])
    return out


def total(parts: Mapping[int, int]) -> float:
    """The double nearest to a sum of digits."""
    if parts.get(NAN) or (parts.get(PLUS) and parts.get(MINUS)):
        return math.nan
    if parts.get(PLUS) or parts.get(MINUS):
        return math.inf if parts.get(PLUS) else -math.inf
    whole = sum(v << (DIGIT * d) for d, v in parts.items() if d >= 0)
    try:
        return whole / (1 << LEAST)  # division of integers rounds once
    except OverflowError:
        return math.inf if whole > 0 else -math.inf


def _totals(names: Sequence[str], keys: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k) for k in keys]
            for n in names:
                sums = [total({p["digit"]: p["value"] for p in x}) if x is not None else None for x in batch.column(n).to_pylist()]
                columns.append(pa.array(sums, pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, *names])

    return run


def rounded(sums: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Rows with each named column of digits (``PARTS``) as a double."""
    kinds = dict(sums.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [f"`{n}` double" for n in names])
    return sums.select(*keys, *names).mapInArrow(_totals(names, keys), schema)


def summed(parts: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The sums of columns of digits by ``keys``, as columns of digits; null where no row has any."""

    def named(n: str) -> Column:
        return F.transform(F.col(n), lambda p: F.struct(F.lit(n).alias("name"), p["digit"].alias("digit"), p["value"].alias("value")))

    each = parts.select(*keys, F.explode(F.concat(*[named(n) for n in names])).alias("p"))
    sums = each.groupBy(*keys, F.col("p.name").alias("name"), F.col("p.digit").alias("digit")).agg(F.sum("p.value").alias("value"))
    held = F.struct("digit", "value")  # 70 digits at most
    return sums.groupBy(*keys).agg(*[F.collect_list(F.when(F.col("name") == n, held)).cast(PARTS).alias(n) for n in names])


def exact_sums(df: DataFrame, keys: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """The exact sum of each column by ``keys``, rounded once to a double.

    Nulls are left out; a group in which all are null sums to 0.  Infinities and NaN give what
    addition gives, NaN for infinities of both signs.
    """
    names = list(sums)
    zero = F.array(F.struct(F.lit(0).alias("digit"), F.lit(0).cast("bigint").alias("value"))).cast(PARTS)  # keeps every group
    parts = df.select(*keys, *[F.concat(zero, digits(c)).alias(n) for n, c in sums.items()])
    return rounded(summed(parts, keys, names), keys, names)


__all__ = ["digits", "digits_of", "exact_sums", "rounded", "summed", "total"]
