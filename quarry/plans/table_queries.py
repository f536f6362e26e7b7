"""Registered plans for the table functions (catalogue, filters, aggregates).

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over
the whole given tables; ``ORACLE`` holds the equivalent DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.names import col as named
from quarry.operators.tables import Tables, load_tables, role_of
from quarry.session import scratch_path
from quarry.sources.files import TABLES

# Doubles are compared after rounding on both sides.
DIGITS = 4


def _t(spark: SparkSession, sf_dir: str, *names: str) -> Tables:
    return load_tables(spark, sf_dir, list(names))


def _with_dictionaries(spark: SparkSession, sf_dir: str, *names: str) -> Tables:
    """Values resolve in a stored dictionary, here a new one: the files are read for it once, then by the query."""
    return load_tables(spark, sf_dir, list(names), dictionaries=scratch_path(spark, "dictionaries"))


def count_rows_numeric(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").count_rows("lineitem", "quantity", "17.0")


def count_rows_ci(spark, sf_dir) -> DataFrame:
    return _with_dictionaries(spark, sf_dir, "region").count_rows("region", "r_name", "asia")


def count_rows_fuzzy(spark, sf_dir) -> DataFrame:
    return _with_dictionaries(spark, sf_dir, "orders").count_rows("order", "orderpriority", "urgent")


def get_rows_filtered(spark, sf_dir) -> DataFrame:
    return _with_dictionaries(spark, sf_dir, "events").get_rows("events", "event_type", "purchse")


def get_rows_all(spark, sf_dir) -> DataFrame:
    # a column without a value returns the whole table
    return _t(spark, sf_dir, "nation").get_rows("nation", "n_name", "")


def query_rows(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "orders").query(
        "orders", 'o_totalprice > 400000 and o_orderpriority == "1-URGENT"')


def contains_filter(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "part").contains("part", "p_name", "widget")


def group_count(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "orders").group_by("orders", "orderpriority")


def _group(func, table, key, col):
    def run(spark, sf_dir):
        out = _t(spark, sf_dir, table).group_by(table, key, col, func)
        name = out.columns[-1]
        if func in ("mean", "std", "var", "median", "sum", "prod"):
            out = out.withColumn(name, F.round(name, DIGITS))
        return out
    run.__name__ = f"group_{func}"
    return run


GROUP_CASES = {
    "group_mean": ("mean", "orders", "orderpriority", "o_totalprice"),
    "group_sum": ("sum", "lineitem", "l_returnflag", "l_extendedprice"),
    "group_min": ("min", "lineitem", "l_returnflag", "l_shipdate"),
    "group_max": ("max", "orders", "o_orderstatus", "o_totalprice"),
    "group_median": ("median", "lineitem", "l_linestatus", "l_quantity"),
    "group_std": ("std", "lineitem", "l_returnflag", "l_discount"),
    "group_var": ("var", "orders", "o_orderpriority", "o_totalprice"),
    "group_nunique": ("nunique", "lineitem", "l_returnflag", "l_partkey"),
    "group_size": ("size", "customer", "c_mktsegment", "c_acctbal"),
    "group_count_col": ("count", "events", "event_type", "value"),
    "group_min_text": ("min", "part", "p_type", "p_name"),
}


def distinct_values(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "part").distinct_values("part", "p_type")


def distinct_doubles(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").distinct_values("lineitem", "l_discount")


def share_summary(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "orders").share("orders", "o_orderstatus = 'F'")


def table_profile(spark, sf_dir) -> DataFrame:
    # approx_distinct and Spark type names have no DuckDB twin; compared elsewhere
    return load_tables(spark, sf_dir).profile(approx=False).drop("data_type", "approx_distinct", "role")


def group_prod(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "nation").group_by("nation", "n_regionkey", "n_nationkey", "prod")


def group_first(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "orders").group_by("orders", "o_custkey", "o_totalprice", "first", order_by="o_orderkey")


def group_last(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "orders").group_by("orders", "o_custkey", "o_orderpriority", "last", order_by="o_orderkey")


PROFILED = ["customer", "events"]


def profile_distinct(spark, sf_dir) -> DataFrame:
    """M1: every column's approximate distinct counts, of the one-pass and the stored profile, held against the exact one."""
    t = _with_dictionaries(spark, sf_dir, *PROFILED)
    exact = None
    for name in PROFILED:
        df = t.table(name)
        for c in df.columns:
            one = df.select(named(c).alias("v")).where("v IS NOT NULL").distinct().agg(
                F.count(F.lit(1)).alias("exact_distinct")).select(
                F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), "exact_distinct")
            exact = one if exact is None else exact.unionByName(one)
    keys = ["table_name", "column_name"]
    stored = None
    for name in PROFILED:
        one = t.stored_profile(name).select(F.lit(name).alias("table_name"), "column_name",
                                            F.col("approx_distinct").alias("stored"), "row_count")
        stored = one if stored is None else stored.unionByName(one)
    both = exact.join(t.profile().select(*keys, "approx_distinct"), keys).join(stored, keys)
    near = lambda c: F.abs(F.col(c) - F.col("exact_distinct")) <= 0.1 * F.col("exact_distinct")
    return both.select(*keys, "row_count", "exact_distinct", near("approx_distinct").alias("within_a_tenth"),
                       near("stored").alias("stored_within_a_tenth"))


def table_roles(spark, sf_dir) -> DataFrame:
    """M3 over an output listing derived from ``orders``: batch outputs carry
    a ``yyyyMMddHHmmss_`` stem, notes do not."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    stem = F.when(F.col("o_orderstatus") == "F",
                  F.concat(F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("_output")))\
        .otherwise(F.concat(F.lit("notes_"), F.col("o_orderkey").cast("string")))
    return o.select(F.col("o_orderkey"), stem.alias("stem")).select(
        "o_orderkey", "stem", role_of("stem").alias("role"))


QUERIES = {
    "count_rows_numeric": count_rows_numeric,
    "count_rows_ci": count_rows_ci,
    "count_rows_fuzzy": count_rows_fuzzy,
    "get_rows_filtered": get_rows_filtered,
    "get_rows_all": get_rows_all,
    "query_rows": query_rows,
    "contains_filter": contains_filter,
    "group_count": group_count,
    **{k: _group(*v) for k, v in GROUP_CASES.items()},
    "distinct_values": distinct_values,
    "distinct_doubles": distinct_doubles,
    "group_prod": group_prod,
    "group_first": group_first,
    "group_last": group_last,
    "share_summary": share_summary,
    "table_profile": table_profile,
    "profile_distinct": profile_distinct,
    "table_roles": table_roles,
}


_SQL_AGG = {
    "mean": "round(avg({c}), 4)", "sum": "round(coalesce(sum({c}), 0), 4)",
    "min": "min({c})", "max": "max({c})", "median": "round(median({c}), 4)",
    "std": "round(stddev_samp({c}), 4)", "var": "round(var_samp({c}), 4)",
    "nunique": "count(distinct {c})", "size": "count(*)", "count": "count({c})",
}

# Column lists of the given tables, for the profile oracle.
_COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
               "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                 "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}


def _profile_sql() -> str:
    parts = []
    for t in TABLES:
        for i, c in enumerate(_COLUMNS[t]):
            parts.append(
                f"select '{t}' as table_name, '{c}' as column_name, {i + 1} as ordinal, "
                f"count(*) as row_count, count(*) - count({c}) as null_count from {t}")
    return "\nunion all\n".join(parts)


ORACLE = {
    "count_rows_numeric": "select 'lineitem' as table_name, 'l_quantity' as filter_column, "
                          "'17.0' as filter_value, count(*) as row_count from lineitem where l_quantity = 17",
    "count_rows_ci": "select 'region' as table_name, 'r_name' as filter_column, 'ASIA' as filter_value, "
                     "count(*) as row_count from region where lower(r_name) = 'asia'",
    "count_rows_fuzzy": "select 'orders' as table_name, 'o_orderpriority' as filter_column, "
                        "'1-URGENT' as filter_value, count(*) as row_count from orders "
                        "where o_orderpriority = '1-URGENT'",
    "get_rows_filtered": "select * from events where event_type = 'purchase'",
    "get_rows_all": "select * from nation",
    "query_rows": "select * from orders where o_totalprice > 400000 and o_orderpriority = '1-URGENT'",
    "contains_filter": "select * from part where contains(p_name, 'widget')",
    "group_count": "select o_orderpriority, count(*) as count from orders "
                   "where o_orderpriority is not null group by 1",
    **{k: f"select {key_col}, {_SQL_AGG[f].format(c=c)} as {f}_{c} from {t} "
          f"where {key_col} is not null group by 1"
       for k, (f, t, _k, c) in GROUP_CASES.items()
       for key_col in [{"orderpriority": "o_orderpriority"}.get(_k, _k)]},
    "distinct_values": "select distinct p_type from part where p_type is not null",
    "distinct_doubles": "select distinct cast(l_discount as varchar) as l_discount from lineitem "
                        "where l_discount is not null",
    "group_prod": "select n_regionkey, product(n_nationkey) as prod_n_nationkey from nation group by 1",
    "group_first": "select o_custkey, arg_min(o_totalprice, o_orderkey) as first_o_totalprice from orders group by 1",
    "group_last": "select o_custkey, arg_max(o_orderpriority, o_orderkey) as last_o_orderpriority from orders group by 1",
    "share_summary": "select count(*) filter (where o_orderstatus = 'F') as matched, "
                     "count(*) as total from orders",
    "table_profile": _profile_sql(),
    "profile_distinct": "\nunion all\n".join(
        f"select '{t}' as table_name, '{c}' as column_name, count(distinct {c}) as exact_distinct, true as within_a_tenth, "
        f"count(*) as row_count, true as stored_within_a_tenth from {t}" for t in PROFILED for c in _COLUMNS[t]),
    "table_roles": "select o_orderkey, stem, case when regexp_matches(stem, '^[0-9]{8,}_') "
                   "then 'primary' else 'supplemental' end as role from ("
                   "select o_orderkey, case when o_orderstatus = 'F' then "
                   "strftime(o_orderdate, '%Y%m%d%H%M%S') || '_output' "
                   "else 'notes_' || cast(o_orderkey as varchar) end as stem from orders)",
}
