import base64
import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import access as A
from quarry.operators import quality as Q
from quarry.operators.access import request_status, strip_links


def encoded(document) -> str:
    """Base64 of a JSON document, or of raw bytes."""
    raw = document if isinstance(document, bytes) else json.dumps(document).encode()
    return base64.b64encode(raw).decode()


def signed_in(*groups) -> str:
    return encoded({"claims": [{"typ": "groups", "val": g} for g in groups]})


HEADERS = {
    "several": (signed_in("ops", "dl", "qa"), ["ops", "dl", "qa"]),
    "repeated": (signed_in("dl", "ops", "dl"), ["dl", "ops"]),
    "no_groups": (signed_in(), []),
    "other_claims": (encoded({"claims": [{"typ": "roles", "val": "dl"}, {"typ": "groups", "val": "ops"}],
                              "name_typ": "n"}), ["ops"]),
    "null_value": (encoded({"claims": [{"typ": "groups", "val": None}, {"typ": "groups", "val": "dl"}]}), ["dl"]),
    "null_claim": (encoded({"claims": [None, {"typ": "groups", "val": "dl"}]}), ["dl"]),
    "no_claims": (encoded({"auth_typ": "x"}), []),
    "claims_no_list": (encoded({"claims": {"typ": "groups", "val": "dl"}}), None),
    "claims_text": (encoded({"claims": "groups"}), []),
    "cut_padding": (signed_in("abcd").rstrip("=")[:-3], []),
    "bytes_no_json": (encoded(b"\xff\xfe\x00 groups"), []),
    "json_no_object": (encoded([1, 2]), []),
    "not_base64": ("%%%", []),
    "blank": ("   ", []),
    "absent": (None, []),
}


def test_groups_of_every_kind_of_header(spark):
    df = spark.createDataFrame([(k, h) for k, (h, _) in HEADERS.items()], "k string, h string")
    got = {r.k: r.g for r in df.select("k", A.group_ids("h").alias("g")).collect()}
    for k, (_, groups) in HEADERS.items():
        if groups is None:              # an object in place of the list: no group may come of it but its own
            assert set(got[k]) <= {"dl"}
        else:
            assert got[k] == groups, k


def test_download_needs_the_group_only_if_one_is_asked_for(spark):
    df = spark.createDataFrame([(k, h) for k, (h, _) in HEADERS.items()], "k string, h string")

    def allowed(require, group):
        return {r.k for r in df.where(A.can_download(A.group_ids("h"), require, group)).collect()}
    members = {k for k, (_, g) in HEADERS.items() if g and "dl" in g}
    assert allowed(True, "dl") - {"claims_no_list"} == members
    assert allowed(True, "d") == set()                          # no part of a name
    for require, group in ((False, "dl"), (True, None), (True, ""), (False, None)):
        assert allowed(require, group) == set(HEADERS)


@pytest.mark.parametrize("name,unsafe", [
    ("..\\..\\etc\\passwd", True), ("../x", True), ("/etc/passwd", True), ("a..b.csv", False),
    ("report.csv", False), ("sub/..", True), ("", True),
])
def test_path_rule(spark, name, unsafe):
    df = spark.createDataFrame([(name,)], "f string")
    assert df.select(A.unsafe_name(F.col("f"))).first()[0] is unsafe


def test_request_status_chain(spark):
    ok = signed_in("dl")
    reqs = spark.createDataFrame([
        (1, "/api/chat", "", None, None),
        (2, "/api/messages", "", None, None),
        (3, "/api/files/a.csv", "u", signed_in("x"), "a.csv"),
        (4, "/api/files/../a.csv", "u", ok, "../a.csv"),
        (5, "/api/files/b.csv", "u", ok, "b.csv"),
        (6, "/api/files/a.csv", "u", ok, "a.csv"),
    ], "id int, path string, principal_id string, principal string, filename string")
    listing = spark.createDataFrame([("a.csv",), ("a.csv",)], "filename string")
    got = {r.id: r.status for r in request_status(reqs, listing, True, "dl").collect()}
    assert got == {1: 401, 2: 200, 3: 403, 4: 403, 5: 404, 6: 200}
    off = {r.id: r.status for r in request_status(reqs, listing, False, "dl").collect()}
    assert off[1] == 200 and off[3] == 200


def test_strip_links(spark):
    df = spark.createDataFrame([(True, ["f"]), (False, ["g"])], "can_download boolean, files array<string>")
    assert [r.files for r in strip_links(df, "files").collect()] == [["f"], []]


def test_enum_violations(spark):
    df = spark.createDataFrame([("No stock",), ("no stock",), (None,), ("no stock",)], "Status string")
    got = {r.Status: r.n for r in Q.enum_violations(df, "Status", Q.STATUS_VALUES).collect()}
    assert got == {"no stock": 2, None: 1}


def test_duplicates_and_schema_diff(spark):
    df = spark.createDataFrame([("P1",), ("P1",), ("P2",)], "PartNumber string")
    assert [tuple(r) for r in Q.duplicate_keys(df, ["PartNumber"]).collect()] == [("P1", 2)]
    diff = {(r.column_name, r.problem) for r in
            Q.schema_diff(df.withColumn("Extra", F.lit(1)), Q.OBSOLESCENCE_COLUMNS).collect()}
    assert diff == {("Extra", "unexpected"), ("Status", "missing"), ("Details", "missing"),
                    ("ModelProcessedDate", "missing")}


def test_tables_enum_rules(spark):
    from quarry.operators.tables import InvalidEnumValue, Tables
    t = Tables(spark, enums={"Status": Q.STATUS_VALUES})
    t.register("obs", spark.createDataFrame([("P1", "No stock"), ("P2", "Open WorkOrder")],
                                            "PartNumber string, Status string"))
    assert t.count_rows("obs", "Status", "No stock").first().row_count == 1
    with pytest.raises(InvalidEnumValue) as e:
        t.get_rows("obs", "Status", "no stok")
    assert e.value.allowed_values == sorted(Q.STATUS_VALUES)
    assert t.get_rows("obs", "status", "no stok").count() == 1     # lower-case name: fuzzy path
    assert t.distinct_values("obs", "Status").count() == 15
    counts = {r.Status: r.n for r in Q.enum_counts(t.table("obs"), "Status", Q.STATUS_VALUES).collect()}
    assert counts["No stock"] == 1 and counts["Sold in Past Two Years"] == 0 and len(counts) == 15


def test_required_column_and_no_rows_message(spark):
    from quarry.operators import extract as X
    from quarry.operators.results import no_rows_message
    with pytest.raises(KeyError, match="Available"):
        X.extract_rules(spark.createDataFrame([(1,)], "id int"), "Comments")
    assert no_rows_message(spark.range(0)) == "No rows matched."
    assert no_rows_message(spark.range(1)) is None
