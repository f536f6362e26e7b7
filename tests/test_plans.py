"""Plan checks: pushdown, pruning, no Python in native-only operators, contract."""

import __spark_entry__ as entry
from quarry.operators.tables import load_tables
from quarry.plans import shape_queries as SQ
from quarry.plans import table_queries as TQ
from tests.conftest import SF001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(spark):
    t = load_tables(spark, SF001, ["orders"])
    p = _plan(t.query("orders", "o_totalprice > 400000").select("o_orderkey"))
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,400000.0)]" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in p


def test_native_operators_have_no_python(spark):
    for fn in (TQ.group_count, TQ.table_profile, SQ.consecutive_dedup, SQ.request_status,
               SQ.decode_groups, SQ.enum_violations, SQ.dedupe_chunks):
        p = _plan(fn(spark, SF001))
        assert "Python" not in p, fn.__name__


def test_group_by_is_partial_then_final(spark):
    p = _plan(TQ.group_count(spark, SF001))
    assert p.count("HashAggregate") >= 2


def test_entry_contract(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "replacement_intent" in df.columns
