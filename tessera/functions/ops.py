"""The closed operator language as Column builders. No Python runs on rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T



def number(c: Column) -> Column:
    """Double before any arithmetic; NaN counts as missing, infinity stays."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def moment(c: Column) -> Column:
    """UTC wall clock; what can't be parsed raises."""
    return c.cast("timestamp_ntz")


def type_tag(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.IntegralType):
        return "int"
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return "float"
    return "str" if isinstance(kind, T.StringType) else kind.typeName()


def key(c: Column, tag: str = "str") -> Column:
    """Category key: missing is a key of its own, different from any text."""
    return F.when(c.isNull(), F.lit("N:")).otherwise(F.concat(F.lit(f"V:{tag}:"), c.cast("string")))


def pair(left: Column, right: Column) -> Column:
    """Two keys as one, injectively: the first one's length goes in front."""
    return F.concat(F.length(left).cast("string"), F.lit(":"), left, right)


def epoch_days(c: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c) / F.lit(86400e6)


def _divide(a: Column, b: Column, **_) -> Column:
    return F.when(F.abs(b) > 1e-12, a / b)


def _clip(x: Column, lower: float, upper: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(float(lower)), F.least(F.lit(float(upper)), x)))


ROWWISE: dict[str, Callable[..., Column]] = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": _divide,
    "log1p_abs": lambda x: F.log1p(F.abs(x)),
    "sqrt_abs": lambda x: F.sqrt(F.abs(x)),
    "square": lambda x: x * x,
    "abs": F.abs,
    "clip": _clip,
    "is_missing": lambda x: x.isNull().cast("double"),
    "cross": pair,
    "year": lambda c: F.year(c).cast("double"),
    "month": lambda c: F.month(c).cast("double"),
    "dayofweek": lambda c: F.weekday(c).cast("double"),
    "days_between": lambda a, b: F.timestamp_diff("MICROSECOND", b, a) / F.lit(86400e6),
}


def finite(c: Column) -> Column:
    """Output rule: infinite values are missing."""
    return F.when(F.abs(c) < F.lit(float("inf")), c)
