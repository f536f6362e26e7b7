"""The table catalogue and its forgiving query functions.

``Tables`` keeps named DataFrames with a role (primary/supplemental) and
exposes the table functions: list, profile, schema, count, rows, distinct,
predicate query, group-by, share.  Every function returns a lazy DataFrame;
table, column and value names are resolved exactly, then case-insensitively,
then by closest match.  Names are metadata and resolve on the driver;
values resolve by Spark jobs (:mod:`quarry.operators.resolve`).
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.similarity import resolve_name
from quarry.functions.names import col as named
from quarry.functions.values import all_midnight, as_text, is_numeric
from quarry.operators import aggregate as agg
from quarry.operators.profile_store import ProfileStore
from quarry.operators.resolve import Resolution, resolve_value
from quarry.operators.value_dictionary import ValueDictionary
from quarry.session import is_folder

# Fixed value: a file/table stem starting with 8+ digits and "_" is a batch output.
PRIMARY_STEM = r"^\d{8,}_"

_FORBIDDEN = {"reflect", "try_reflect", "java_method"}


def view_name(name: str) -> str:
    """A valid view name for any table name; names that are valid already stay."""
    if re.fullmatch(r"[A-Za-z0-9_]+", name):
        return name
    return re.sub(r"[^A-Za-z0-9_]", "_", name) + "_" + hashlib.sha256(name.encode()).hexdigest()[:8]


def _check_expression(spark: SparkSession, expr: str) -> None:
    """Refuse subqueries and reflection by the parsed expression, not by words in it."""
    parsed = spark._jsparkSession.sessionState().sqlParser().parseExpression(expr)
    todo = [parsed]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind in ("ScalarSubquery", "Exists", "InSubquery", "ListQuery", "LateralSubquery") or \
                kind == "UnresolvedFunction" and node.nameParts().mkString(".").split(".")[-1].lower() in _FORBIDDEN:
            raise ValueError("Invalid query expression: reflection and subqueries are not allowed")
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]


def role_of(stem: Column | str) -> Column:
    """M3: primary for timestamp-prefixed names, else supplemental."""
    s = F.col(stem) if isinstance(stem, str) else stem
    return F.when(s.rlike(PRIMARY_STEM), F.lit("primary")).otherwise(F.lit("supplemental"))


def normalise(df: DataFrame, nan_as_null: bool = False) -> DataFrame:
    """Strip header whitespace and refuse case-insensitive duplicates.

    ``nan_as_null`` rewrites NaN to NULL in every float column up front
    (pandas semantics for free predicates too), but a projection over the
    scan stops filters from reaching Parquet, so it is off by default:
    aggregates, group keys and distinct lists treat NaN as missing anyway.
    """
    names = [c.strip() for c in df.columns]
    seen: dict[str, str] = {}
    for n in names:
        if n.lower() in seen:
            raise ValueError(f"Columns '{seen[n.lower()]}' and '{n}' differ only by case")
        seen[n.lower()] = n
    out = df.toDF(*names)
    if not nan_as_null:
        return out
    fixes = {f.name: F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType))
             for f in out.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return out.withColumns(fixes) if fixes else out


class InvalidEnumValue(ValueError):
    """F8: a filter value outside a column's canonical list."""

    def __init__(self, column: str, allowed: list[str]):
        self.column, self.allowed_values = column, allowed
        super().__init__(f"Invalid {column} value; allowed values: {allowed}")


@dataclass
class Filter:
    column: str
    value: str
    predicate: Column
    resolution: Resolution | None


class Tables:
    """A catalogue of named DataFrames with the reference's table tools."""

    def __init__(self, spark: SparkSession, enums: dict[str, list[str]] | None = None,
                 dictionaries: str | None = None):
        """``enums``: columns with a canonical value list (e.g. ``Status``).

        A filter on such a column (exact column name) must use one of the
        values (F8), and its distinct list is the canonical list (A5).
        ``dictionaries``: a folder for value dictionaries; values of text
        columns of tables registered with :meth:`register_files` are then
        resolved and listed from there.
        """
        self.spark = spark
        self.dictionaries = dictionaries
        self._files: dict[str, tuple] = {}
        self._tables: dict[str, DataFrame] = {}
        self._roles: dict[str, str] = {}
        self.enums = dict(enums or {})

    # ---- catalogue --------------------------------------------------------
    def register(self, name: str, df: DataFrame, role: str | None = None,
                 view: bool = True, nan_as_null: bool = False) -> DataFrame:
        df = normalise(df, nan_as_null)
        if role is None:
            role = "primary" if re.match(PRIMARY_STEM, name) else "supplemental"
        self._tables[name] = df
        self._roles[name] = role
        if view:
            df.createOrReplaceTempView(view_name(name))
        return df

    def register_files(self, name: str, path: str, fmt: str = "parquet", options: dict[str, str] | None = None,
                       **kw) -> DataFrame:
        """Register the files of ``path``; values of its text columns come from dictionaries, if there is a folder for them."""
        spark, options = self.spark, options or {}
        loaded = spark.read.format(fmt).options(**options).load(path)
        df = self.register(name, loaded, **kw)
        if not self.dictionaries:
            return df
        raw = loaded.schema
        base = {"basePath": path} if is_folder(spark, path) else {}

        def files() -> list[str]:
            return spark.read.format(fmt).options(**options).schema(raw).load(path).inputFiles()

        def read(some: list[str]) -> DataFrame:
            return normalise(spark.read.format(fmt).options(**options, **base).schema(raw).load(some))
        self._files[name] = (files, read)
        return df

    def values_of(self, table: str, column: str) -> DataFrame | None:
        """The refreshed dictionary (v, n) of a text column; None where there is none."""
        if not self.dictionaries or table not in self._files or \
                not isinstance(self._tables[table].schema[column].dataType, T.StringType):
            return None
        known = ValueDictionary(self.spark, self.dictionaries, table, column, *self._files[table])
        known.refresh()
        return known.values()

    def stored_profile(self, table: str) -> DataFrame:
        """M1 from stored sketches, refreshed by the table's new files (see :mod:`quarry.operators.profile_store`)."""
        t = self.resolve_table(table)
        if not self.dictionaries or t not in self._files:
            raise ValueError(f"Table '{t}' has no stored profile: register its files and name a folder for dictionaries")
        store = ProfileStore(self.spark, self.dictionaries, t, *self._files[t])
        store.refresh()
        return store.profile()

    def names(self) -> list[str]:
        return list(self._tables)

    def roles(self) -> dict[str, str]:
        return dict(self._roles)

    def table(self, name: str) -> DataFrame:
        return self._tables[self.resolve_table(name)]

    def resolve_table(self, name: str) -> str:
        return resolve_name(name, list(self._tables), label="Table")[0]

    def resolve_column(self, table: str, column: str) -> str:
        df = self.table(table)
        return resolve_name(column, df.columns, label="Column")[0]

    def list_tables(self) -> DataFrame:
        """M1/M3 listing: one row per table with role and column count."""
        rows = [(n, self._roles[n], len(df.columns)) for n, df in self._tables.items()]
        return self.spark.createDataFrame(rows, "table_name string, role string, n_columns int")

    def schema(self, table: str) -> DataFrame:
        """M2: column, type, ordinal."""
        t = self.resolve_table(table)
        rows = [(f.name, f.dataType.simpleString(), i + 1)
                for i, f in enumerate(self._tables[t].schema.fields)]
        return self.spark.createDataFrame(rows, "column_name string, data_type string, ordinal int")

    def profile(self, tables: list[str] | None = None, approx: bool = True, rsd: float = 0.02) -> DataFrame:
        """M1 re-aimed: per column rows, missing values (null or NaN) and approximate distinct count.

        ``rsd`` is the relative standard deviation of the distinct counts; NaN is not a value of its own.

        One aggregate job per table (single scan, partial aggregation), the
        wide row unpivoted by exploding one struct per column, tables unioned.
        """
        parts = []
        for name in (tables or list(self._tables)):
            t = self.resolve_table(name)
            df = self._tables[t]
            fields = df.schema.fields
            exprs = [F.count(F.lit(1)).alias("__rows")]
            for i, f in enumerate(fields):
                c = named(f.name)
                if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                    c = F.when(~F.isnan(c), c)
                exprs.append(F.count(c).alias(f"n{i}"))
                if approx:
                    atomic = not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
                    exprs.append((F.approx_count_distinct(c, rsd) if atomic
                                  else F.lit(None).cast("long")).alias(f"d{i}"))
            wide = df.agg(*exprs)
            # unpivot the one wide row: one struct per column, exploded
            cells = F.array(*[
                F.struct(F.lit(f.name).alias("column_name"),
                         F.lit(f.dataType.simpleString()).alias("data_type"),
                         F.lit(i + 1).alias("ordinal"),
                         F.col(f"n{i}").alias("non_null"),
                         (F.col(f"d{i}") if approx else F.lit(None).cast("long")).alias("approx_distinct"))
                for i, f in enumerate(fields)])
            long = wide.select("__rows", F.explode(cells).alias("c")).select("__rows", "c.*")
            parts.append(long.select(
                F.lit(t).alias("table_name"), F.lit(self._roles[t]).alias("role"),
                "column_name", "data_type", F.col("ordinal").cast("int").alias("ordinal"),
                F.col("__rows").alias("row_count"),
                (F.col("__rows") - F.col("non_null")).alias("null_count"),
                "approx_distinct"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    # ---- filters ----------------------------------------------------------
    def equality_filter(self, df: DataFrame, column: str, value: str, table: str | None = None) -> Filter:
        """numeric equality when both sides are numeric, else resolved text."""
        col = resolve_name(column, df.columns, label="Column")[0]
        dtype = df.schema[col].dataType
        c = F.col(f"`{col}`")
        if is_numeric(dtype):
            try:
                num = float(value)
            except (TypeError, ValueError):
                num = None
            if num is not None:
                lhs = c.cast("double") if isinstance(dtype, T.BooleanType) else c
                # a FLOAT column holds the rounded literal
                rhs = F.lit(num).cast(dtype) if isinstance(dtype, T.FloatType) else F.lit(num)
                return Filter(col, value, lhs == rhs, None)
        known = self.values_of(table, col) if table else None
        res = resolve_value(df, col, value) if known is None else resolve_value(known, "v", value)
        if isinstance(dtype, T.StringType) and res.variants:
            pred = c.isin(res.variants)
        else:
            pred = F.lower(as_text(c, dtype, all_midnight(df, col))) == F.lit(res.value.lower())
        return Filter(col, res.value, pred, res)

    def _filtered(self, table: str, filter_column: str | None, filter_value: str | None):
        t = self.resolve_table(table)
        df = self._tables[t]
        if filter_column in self.enums and filter_value not in self.enums[filter_column]:
            raise InvalidEnumValue(filter_column, sorted(self.enums[filter_column]))
        if filter_column and filter_value not in (None, ""):      # an empty value means the whole table
            f = self.equality_filter(df, filter_column, filter_value, t)
            return t, df.where(f.predicate), f
        return t, df, None

    def count_rows(self, table: str, filter_column: str | None = None,
                   filter_value: str | None = None) -> DataFrame:
        """A1: exact count as a one-row DataFrame."""
        t, df, f = self._filtered(table, filter_column, filter_value)
        return df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(t).alias("table_name"),
            F.lit(f.column if f else None).cast("string").alias("filter_column"),
            F.lit(f.value if f else None).cast("string").alias("filter_value"),
            "row_count")

    def get_rows(self, table: str, filter_column: str | None = None,
                 filter_value: str | None = None) -> DataFrame:
        """all matching rows, every column, no limit (lazy)."""
        return self._filtered(table, filter_column or None,
                              None if filter_value == "" else filter_value)[1]

    def query(self, table: str, expr: str | Column) -> DataFrame:
        """a Spark SQL boolean expression (or Column) over one table."""
        df = self.table(table)
        if isinstance(expr, str):
            try:
                _check_expression(self.spark, expr)
                pred = F.expr(expr)
                out = df.where(pred)
                out.schema  # analyse now so bad names fail here
            except ValueError:
                raise
            except Exception as exc:  # noqa: BLE001 - reported to the caller
                raise ValueError(f"Invalid query expression: {exc}") from exc
            return out
        return df.where(expr)

    def contains(self, table: str, column: str, needle: str) -> DataFrame:
        """substring filter; NULL cells never match (a NULL predicate drops
        the row), and the plain predicate reaches the scan as StringContains."""
        df = self.table(table)
        col = resolve_name(column, df.columns, label="Column")[0]
        return df.where(F.col(f"`{col}`").contains(needle))

    # ---- aggregates -------------------------------------------------------
    def distinct_values(self, table: str, column: str) -> DataFrame:
        """A4: non-null values as text, distinct, sorted as strings.

        A5: an enum column (exact name) lists its canonical values instead.
        """
        if column in self.enums:
            return self.spark.createDataFrame([(v,) for v in sorted(self.enums[column])],
                                              f"`{column}` string")
        df = self.table(table)
        col = resolve_name(column, df.columns, label="Column")[0]
        known = self.values_of(self.resolve_table(table), col)
        if known is not None:
            return known.select(F.col("v").alias(col)).orderBy(named(col))
        dtype = df.schema[col].dataType
        c = F.col(f"`{col}`")
        present = c.isNotNull() & ~F.isnan(c) if isinstance(dtype, (T.DoubleType, T.FloatType)) \
            else c.isNotNull()
        return df.where(present).select(as_text(c, dtype, all_midnight(df, col)).alias(col)).distinct().orderBy(named(col))

    def group_by(self, table: str, group_column: str | list[str],
                 agg_column: str | None = None, agg_func: str = "count",
                 order_by: str | None = None, sort: bool = True) -> DataFrame:
        """A2/A3: rows per group, or ``<func>_<column>`` per group."""
        df = self.table(table)
        keys = [group_column] if isinstance(group_column, str) else list(group_column)
        keys = [resolve_name(k, df.columns, label="Column")[0] for k in keys]
        if agg_column:
            col = resolve_name(agg_column, df.columns, label="Column")[0]
            aggs = [(agg_func, col)]
        else:
            aggs = [("count", None)]
        return agg.group_by(df, keys, aggs, order_col=order_by, sort=sort)

    def share(self, table: str, predicate: str | Column) -> DataFrame:
        """How many rows satisfy a predicate, out of how many."""
        return agg.share(self.table(table), predicate)


def load_tables(spark: SparkSession, sf_dir: str, names: list[str] | None = None,
                views: bool = False, dictionaries: str | None = None) -> Tables:
    """Register the parquet tables of one directory (one file or folder per table).

    Session temp views are only created on request, so loading never
    replaces views the caller already has.
    """
    from quarry.sources.files import TABLES
    t = Tables(spark, dictionaries=dictionaries)
    for n in names or TABLES:
        t.register_files(n, f"{sf_dir}/{n}.parquet", role="supplemental", view=views)
    return t
