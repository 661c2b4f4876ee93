"""Scalar functions that have no built-in of their own."""

from __future__ import annotations

import math
import zlib
from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .kernels import ERF_FAR, ERF_MIDDLE, ERF_NEAR
from .values import col


def _ratio(pair: tuple[Sequence[float], Sequence[float]], x: Column) -> Column:
    horner = lambda cs: reduce(lambda acc, c: acc * x + F.lit(c), cs[1:], F.lit(cs[0]))
    return horner(pair[0]) / horner(pair[1])


def error_function(c: Column | str) -> Column:
    """The error function by rational approximations, to double precision, in the JVM; null stays null."""
    x = col(c)
    y = F.abs(x)
    square = x * x
    near = x * _ratio(ERF_NEAR, square)
    middle = F.exp(-square) * _ratio(ERF_MIDDLE, y)
    tail = F.exp(-square) / y * (F.lit(1 / math.sqrt(math.pi)) - _ratio(ERF_FAR, F.lit(1.0) / square) / square)
    return F.when(y <= 0.46875, near).when(F.isnan(x), x).otherwise(F.signum(x) * (F.lit(1.0) - F.when(y <= 4, middle).otherwise(tail)))


def normal_cdf(c: Column | str) -> Column:
    """The standard normal distribution function."""
    return (F.lit(1.0) + error_function(col(c) / math.sqrt(2))) * 0.5


def quote(c: Column | str) -> Column:
    """Percent-encoding that leaves letters, digits and ``-._~`` as they are; a blank becomes %20."""
    out = F.url_encode(col(c))
    for sign, code in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(sign), F.lit(code))
    return out


def mapped(c: Column | str, values: Mapping) -> Column:
    """The value that a literal map has for the column's, null where it has none."""
    return F.try_element_at(F.create_map(*(F.lit(v) for pair in values.items() for v in pair)), col(c))


def escape_html(c: Column | str) -> Column:
    out = col(c)
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def epoch_to_date(seconds: Column | str, zone: str) -> Column:
    """The calendar date at a place of a moment given in seconds since 1970 (UTC)."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=col(seconds))))


def after_last(c: Column | str, mark: str) -> Column:
    return F.substring_index(col(c), mark, -1)


def compress(c: Column | str) -> Column:
    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(zlib.compress, na_action="ignore")

    return run(col(c).cast("binary"))


def decompress(c: Column | str) -> Column:
    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(zlib.decompress, na_action="ignore")

    return run(col(c))
