"""Group aggregates with pandas null rules (A2/A3) and share summary.

Every aggregate here is a Spark hash aggregate with a partial (map-side)
phase, so a hot group key is combined before the shuffle.  The median, which
cannot be combined, is selected by counts over ranges of values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.names import col
from quarry.operators.median import exact_median

NUMERIC_ONLY = {"sum", "mean", "median", "std", "var", "prod"}


def agg_expr(func: str, column: str, dtype: T.DataType,
             order_col: str | None = None) -> Column:
    """Spark expression for a pandas ``GroupBy.agg(func)`` name."""
    c = col(column)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        c = F.nanvl(c, F.lit(None).cast(dtype))      # pandas: NaN is missing
    numeric = isinstance(dtype, (T.NumericType, T.BooleanType))
    if func in NUMERIC_ONLY and not numeric:
        raise TypeError(f"agg_func '{func}' needs a numeric column; '{column}' is {dtype.simpleString()}")
    if isinstance(dtype, T.BooleanType) and func in NUMERIC_ONLY:
        c = c.cast("int")
    if func == "count":
        return F.count(c)
    if func == "size":
        return F.count(F.lit(1))
    if func == "sum":
        zero = F.lit(0) if isinstance(dtype, (T.IntegralType, T.BooleanType)) else F.lit(0.0)
        return F.coalesce(F.sum(c), zero)
    if func == "mean":
        return F.avg(c)
    if func == "min":
        return F.min(c)
    if func == "max":
        return F.max(c)
    if func == "std":
        return F.stddev_samp(c)
    if func == "var":
        return F.var_samp(c)
    if func == "nunique":
        return F.count_distinct(c)
    if func == "prod":
        return F.coalesce(F.product(c), F.lit(1.0))
    if func in ("first", "last"):
        if not order_col:
            raise ValueError(f"agg_func '{func}' needs order_by (Spark rows have no order)")
        pick = F.min_by if func == "first" else F.max_by
        o = col(order_col)
        # first/last non-null value in row order
        return pick(c, F.when(c.isNotNull(), o))
    raise ValueError(f"Unsupported agg_func '{func}'")


def _with_medians(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """One row per group (k0, k1, ...) and one column m0, m1, ... per median."""
    out = None
    for i, name in enumerate(cols):
        dtype = df.schema[name].dataType
        if not isinstance(dtype, (T.NumericType, T.BooleanType)):
            raise TypeError(f"agg_func 'median' needs a numeric column; '{name}' is {dtype.simpleString()}")
        value = col(name).cast("int" if isinstance(dtype, T.BooleanType) else "double")
        value = F.when(~F.isnan(value), value)
        one = exact_median(df, [col(k) for k in keys], value).withColumnRenamed("median", f"m{i}")
        out = one if out is None else out.join(one, [f"k{j}" for j in range(len(keys))], "full")
    return out


def group_by(df: DataFrame, keys: list[str], aggs: list[tuple[str, str | None]],
             order_col: str | None = None, sort: bool = True) -> DataFrame:
    """Null keys dropped, one output column per ``(func, column)``.

    ``(func, None)`` means the row count per group, named ``count``.
    Output names follow ``<func>_<column>``.  Medians are selected over ranges
    of values (:mod:`quarry.operators.median`) and joined to the other
    aggregates, one row per group on both sides.
    """
    out = df
    for k in keys:
        out = out.where(col(k).isNotNull())
        if isinstance(df.schema[k].dataType, (T.DoubleType, T.FloatType)):
            out = out.where(~F.isnan(col(k)))
    names, exprs, medians = [], [], []
    for func, of in aggs:
        names.append("count" if of is None else f"{func}_{of}")
        if of is None:
            exprs.append(F.count(F.lit(1)).alias("count"))
        elif func == "median":
            medians.append(of)
        else:
            exprs.append(agg_expr(func, of, df.schema[of].dataType, order_col).alias(names[-1]))
    res = out.groupBy(*[col(k) for k in keys]).agg(*(exprs or [F.lit(1).alias("__group")]))
    if medians:
        found = _with_medians(out, keys, medians)
        on = F.lit(True)
        for i, k in enumerate(keys):
            on = on & (col(k) == found[f"k{i}"])
        res = res.join(found, on, "left")
        for i, of in enumerate(medians):
            res = res.withColumnRenamed(f"m{i}", f"median_{of}")
    res = res.select(*[col(k) for k in keys], *[col(n) for n in names])
    return res.orderBy(*[col(k) for k in keys]) if sort else res


def share(df: DataFrame, predicate: Column | str) -> DataFrame:
    """``matched`` of ``total`` rows satisfy the predicate, in one pass."""
    p = F.expr(predicate) if isinstance(predicate, str) else predicate
    return df.agg(F.count_if(F.coalesce(p, F.lit(False))).alias("matched"),
                  F.count(F.lit(1)).alias("total"))
