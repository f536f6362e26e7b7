"""String form of cell values, matching Python/pandas ``str()`` of a value.

Used wherever a value is compared or listed as text (value resolution,
distinct lists).  Doubles need care: Spark prints ``1.23456789E8`` where
Python prints ``123456789.0``; the rewrite below is pure column logic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.names import col

_E_FORM = r"^(-?)(\d)(?:\.(\d+))?E(-?\d+)$"


def _python_float_text(c: Column) -> Column:
    s = c.cast("string")
    sign = F.regexp_extract(s, _E_FORM, 1)
    lead = F.regexp_extract(s, _E_FORM, 2)
    frac = F.regexp_replace(F.regexp_extract(s, _E_FORM, 3), "0+$", "")
    e = F.regexp_extract(s, _E_FORM, 4).cast("int")
    digits = F.concat(lead, frac)
    n = F.length(digits)
    # positional form, exponent >= 0
    pos_big = F.when(
        n <= e + 1,
        F.concat(digits, F.repeat(F.lit("0"), e + 1 - n), F.lit(".0")),
    ).otherwise(F.concat(F.substr(digits, F.lit(1), e + 1), F.lit("."),
                         F.substr(digits, e + 2)))
    # positional form, -4 <= exponent < 0
    pos_small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    exp_txt = F.concat(F.when(e < 0, F.lit("-")).otherwise(F.lit("+")),
                       F.lpad(F.abs(e).cast("string"), 2, "0"))
    sci = F.concat(lead, F.when(frac != "", F.concat(F.lit("."), frac)).otherwise(F.lit("")),
                   F.lit("e"), exp_txt)
    rewritten = F.concat(sign, F.when((e >= 16) | (e < -4), sci)
                         .when(e >= 0, pos_big).otherwise(pos_small))
    special = (F.when(F.isnan(c), F.lit("nan"))
               .when(c == float("inf"), F.lit("inf"))
               .when(c == float("-inf"), F.lit("-inf")))
    return F.coalesce(special, F.when(s.rlike(_E_FORM), rewritten).otherwise(s))


def as_text(c: Column | str, dtype: T.DataType, dates: bool = False) -> Column:
    """Text form of a column of type ``dtype`` as Python would print it.

    ``dates``: the timestamps of the column are all midnight, so only their
    dates are shown (:func:`all_midnight` finds out).
    """
    c = F.col(c) if isinstance(c, str) else c
    if dates and isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return _python_float_text(c)          # a FLOAT prints its own shortest form, not that of its double
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def all_midnight(df: DataFrame, column: str) -> bool:
    """Whether a timestamp column holds dates only (one aggregate over that column; no value counts as no)."""
    if not isinstance(df.schema[column].dataType, (T.TimestampType, T.TimestampNTZType)):
        return False
    c = col(column)
    return bool(df.agg(F.bool_and(F.date_trunc("day", c) == c)).first()[0])


def is_numeric(dtype: T.DataType) -> bool:
    """pandas counts bools as numeric for the equality filter."""
    return isinstance(dtype, (T.NumericType, T.BooleanType))
