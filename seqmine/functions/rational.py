"""Exact fractions as ``struct<num bigint, den bigint>`` with positive denominator."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


@F.pandas_udf(LongType())
def _gcd(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.gcd(a.to_numpy(np.int64), b.to_numpy(np.int64)))


def rational(num: Column, den: Column) -> Column:
    """Reduced fraction; null when the denominator is zero."""
    num, den = num.cast("bigint"), den.cast("bigint")
    shared = F.greatest(_gcd(F.coalesce(num, F.lit(0)), F.coalesce(den, F.lit(0))), F.lit(1)) * F.signum(
        F.coalesce(den, F.lit(1))).cast("bigint")
    return F.when(den != 0, F.struct(whole_div(num, shared).alias("num"), whole_div(den, shared).alias("den")))


def whole_div(a: Column, b: Column) -> Column:
    """Integer division rounding towards zero."""
    return F.call_function("div", a, b)


def floor_div(a: Column, b: Column) -> Column:
    """Integer division rounding down, for ``b > 0``, without going through doubles."""
    return whole_div(a - F.pmod(a, b), b)


def add(a: Column, b: Column) -> Column:
    return rational(a["num"] * b["den"] + b["num"] * a["den"], a["den"] * b["den"])


def subtract(a: Column, b: Column) -> Column:
    return rational(a["num"] * b["den"] - b["num"] * a["den"], a["den"] * b["den"])


def multiply(a: Column, b: Column) -> Column:
    return rational(a["num"] * b["num"], a["den"] * b["den"])


def divide(a: Column, b: Column) -> Column:
    return rational(a["num"] * b["den"], a["den"] * b["num"])


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1, by cross products wide enough for any two BIGINTs."""
    left = a["num"].cast("decimal(19,0)") * b["den"].cast("decimal(19,0)")
    right = b["num"].cast("decimal(19,0)") * a["den"].cast("decimal(19,0)")
    return F.when(left < right, -1).when(left > right, 1).otherwise(0)


def nearest(a: Column) -> Column:
    """Nearest integer, halves upwards."""
    two = F.lit(2).cast("bigint")
    return floor_div(two * a["num"] + a["den"], two * a["den"])
