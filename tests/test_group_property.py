"""Property test: our group-by equals pandas' groupby(...).agg(func) on random nullable data."""

import math

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.operators.tables import Tables

FUNCS = ["count", "sum", "mean", "min", "max", "median", "std", "var", "nunique", "size", "prod"]

rows = st.lists(st.tuples(st.sampled_from(["a", "b", "B", None]),
                          st.one_of(st.none(), st.integers(-5, 5).map(float))),
                min_size=1, max_size=25)


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6)


@settings(max_examples=12, deadline=None)
@given(rows, st.sampled_from(FUNCS))
def test_group_by_matches_pandas(spark, data, func):
    pdf = pd.DataFrame(data, columns=["g", "v"]).astype({"v": "float64"})
    exp = pdf.groupby("g")["v"].agg(func).reset_index()
    t = Tables(spark)
    t.register("r", spark.createDataFrame(data, "g string, v double"))
    got = t.group_by("r", "g", "v", func).collect()
    assert [r[0] for r in got] == list(exp["g"])
    assert [_norm(r[1]) for r in got] == [_norm(x) for x in exp["v"]]
