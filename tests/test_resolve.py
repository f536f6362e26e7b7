import difflib
import random
import string

import pytest

from quarry.functions.similarity import NotFound, resolve_name
from quarry.operators.resolve import bulk_resolve, resolve_value
from quarry.operators.quality import STATUS_VALUES
from tests.conftest import SF01


@pytest.mark.parametrize("needle,domain,expected,kind,score", [
    ("no stok", STATUS_VALUES, "No stock", "fuzzy", 0.9333),
    ("open sales", STATUS_VALUES, "Open Sales Order", "fuzzy", 0.7692),
    ("bin stock", STATUS_VALUES, "No stock", "fuzzy", 0.8235),   # misleading, kept visible
    ("stat", ["status", "state", "details"], "state", "fuzzy", None),
    ("ab", ["abc", "abd"], "abd", "fuzzy", 0.8),
    ("orderpriority", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                       "o_orderdate", "o_orderpriority"], "o_orderpriority", "fuzzy", 0.9286),
    ("lineitems", ["region", "nation", "lineitem", "orders"], "lineitem", "fuzzy", 0.9412),
    ("order", ["region", "nation", "lineitem", "orders"], "orders", "fuzzy", 0.9091),
])
def test_resolve_name_goldens(needle, domain, expected, kind, score):
    got, k, s = resolve_name(needle, domain)
    assert (got, k) == (expected, kind)
    if score is not None:
        assert round(s, 4) == score


def test_resolve_name_errors():
    with pytest.raises(NotFound):
        resolve_name("scrap", STATUS_VALUES)


def test_case_collision_last_spelling_wins():
    assert resolve_name("asia", ["ASIA", "Asia"])[0] == "Asia"


@pytest.mark.parametrize("table,col,needle,expected,kind,score", [
    ("region", "r_name", "asia", "ASIA", "case", 1.0),
    ("region", "r_name", "Asai", "ASIA", "fuzzy", 0.75),
    ("region", "r_name", "middle-east", "MIDDLE EAST", "fuzzy", 0.9091),
    ("region", "r_name", "amerika", "AMERICA", "fuzzy", 0.8571),
    ("orders", "o_orderpriority", "urgent", "1-URGENT", "fuzzy", 0.8571),
    ("orders", "o_orderpriority", "not specified", "4-NOT SPECIFIED", "fuzzy", 0.9286),
    ("part", "p_type", "medum", "MEDIUM", "fuzzy", 0.9091),
    ("part", "p_brand", "brand2", "Brand#2", "fuzzy", 0.9231),
    ("customer", "c_mktsegment", "househld", "HOUSEHOLD", "fuzzy", 0.9412),
    ("events", "event_type", "purchse", "purchase", "fuzzy", 0.9333),
    ("region", "r_name", "ASIA", "ASIA", "exact", 1.0),
])
def test_resolve_value_goldens(spark, table, col, needle, expected, kind, score):
    df = spark.read.parquet(f"{SF01}/{table}.parquet")
    r = resolve_value(df, col, needle)
    assert (r.value, r.kind, round(r.score, 4)) == (expected, kind, score)


def test_resolve_value_not_found(spark):
    df = spark.read.parquet(f"{SF01}/region.parquet")
    with pytest.raises(NotFound):
        resolve_value(df, "r_name", "zzz")


def test_resolve_value_matches_difflib_random(spark):
    rnd = random.Random(7)
    words = ["".join(rnd.choice(string.ascii_lowercase[:8]) for _ in range(rnd.randint(3, 9)))
             for _ in range(300)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for _ in range(10):
        needle = "".join(rnd.choice(string.ascii_lowercase[:8]) for _ in range(rnd.randint(3, 9)))
        exp = difflib.get_close_matches(needle, list(dict.fromkeys(words)), n=1, cutoff=0.6)
        if needle in words:
            assert resolve_value(df, "w", needle).value == needle
        elif exp:
            assert resolve_value(df, "w", needle).value == exp[0]
        else:
            with pytest.raises(NotFound):
                resolve_value(df, "w", needle)


def test_bulk_resolve_kinds(spark):
    d = spark.createDataFrame([("ASIA",), ("EUROPE",), ("AMERICA",), ("Asia",)], "v string")
    n = spark.createDataFrame([("ASIA",), ("europe",), ("amerika",), ("zzz",), (None,)], "n string")
    got = {r.needle: (r.resolved, r.match_kind) for r in bulk_resolve(n, "n", d, "v").collect()}
    assert got == {"ASIA": ("ASIA", "exact"), "europe": ("EUROPE", "case"),
                   "amerika": ("AMERICA", "fuzzy"), "zzz": (None, "none")}


def test_bulk_resolve_grid_matches_difflib(spark):
    rnd = random.Random(3)
    words = sorted({"".join(rnd.choice("abcdef") for _ in range(rnd.randint(2, 12))) for _ in range(400)})
    needles = ["".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 12))) for _ in range(60)]
    d = spark.createDataFrame([(w,) for w in words], "v string")
    n = spark.createDataFrame([(x,) for x in needles], "n string")
    # tiny cells force the multi-bucket grid path
    got = {r.needle: r.resolved for r in bulk_resolve(n, "n", d, "v", cell_rows=7).collect()}
    for x in set(needles):
        if x in words:
            exp = x
        else:
            m = difflib.get_close_matches(x, words, n=1, cutoff=0.6)
            exp = m[0] if m else None
        assert got[x] == exp, x


def test_many_case_variants_fall_back_to_lower_predicate(spark, monkeypatch):
    import quarry.operators.resolve as R
    from quarry.operators.tables import Tables
    monkeypatch.setattr(R, "MAX_VARIANTS", 2)
    t = Tables(spark)
    t.register("v", spark.createDataFrame([("Asia",), ("ASIA",), ("asia",), ("Europe",)], "r string"))
    r = R.resolve_value(t.table("v"), "r", "aSiA")
    assert r.kind == "case" and r.variants is None
    assert t.count_rows("v", "r", "aSiA").first().row_count == 3


def test_bulk_resolve_unicode(spark):
    d = spark.createDataFrame([("Müller",), ("Straße",), ("café",)], "v string")
    n = spark.createDataFrame([("muller",), ("strase",), ("cafe",), ("zzzz",)], "n string")
    got = {r.needle: r.resolved for r in bulk_resolve(n, "n", d, "v", cell_rows=1).collect()}
    for x in ["muller", "strase", "cafe", "zzzz"]:
        m = difflib.get_close_matches(x, ["müller", "straße", "café"], n=1, cutoff=0.6)
        exp = {"müller": "Müller", "straße": "Straße", "café": "café"}[m[0]] if m else None
        assert got[x] == exp
