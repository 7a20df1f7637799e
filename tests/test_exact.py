"""Exact sums against math.fsum."""

from __future__ import annotations

import math
import random
import struct

import numpy as np
from gridloom.operators.exact import digits_of, exact_sums, total
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

ODD = [5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -1.7976931348623157e308, 1e16, 1.0, -1e16, 2.0**-53, 0.1, -0.0, 2.0**63, 1 / 3, 1e-310]


def numbers(seed, n):
    rng = random.Random(seed)
    out = [struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(n)]
    return [x for x in out if math.isfinite(x) and abs(x) < 1e300] + [rng.uniform(-1, 1) * 10 ** rng.randint(-20, 20) for _ in range(n)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, min_value=-1e300, max_value=1e300), max_size=40))
def test_numpy_digits(values):
    assert total(digits_of(np.array(values))) == math.fsum(values)


def test_no_numbers():
    assert math.isnan(total(digits_of(np.array([1.0, math.nan])))) and math.isnan(total(digits_of(np.array([math.inf, -math.inf]))))
    assert total(digits_of(np.array([math.inf, 1.0]))) == math.inf and total({}) == 0.0
    assert total(digits_of(np.array([1.7e308, 1.7e308]))) == math.inf


def test_columns(spark):
    groups = {"odd": ODD, **{f"g{n}": numbers(n, 200) for n in range(5)}, "nan": [1.0, math.nan], "inf": [math.inf, 3.0], "both": [math.inf, -math.inf]}
    data = [(k, x) for k, v in groups.items() for x in v] + [("null", None), ("odd", None)]
    for n in (1, 7):
        df = spark.createDataFrame(data, "k string, x double").repartition(n)
        got = {r["k"]: (r["s"], r["q"]) for r in exact_sums(df, ["k"], {"s": F.col("x"), "q": F.col("x") * 0.5}).collect()}
        for k, v in groups.items():
            if k in ("nan", "both"):
                assert math.isnan(got[k][0])
            elif k == "inf":
                assert got[k][0] == math.inf
            else:
                assert got[k] == (math.fsum(v), math.fsum(x * 0.5 for x in v)), k
        assert got["null"] == (0.0, 0.0)
    assert exact_sums(spark.createDataFrame([], "k string, x double"), ["k"], {"s": F.col("x")}).count() == 0
