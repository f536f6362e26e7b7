import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import extract as X

GOLDEN = [
    ("Boards still carry K4-77Q, yet the agreed path forward is 8ZT_21", 1, "K4-77Q", "8ZT_21"),
    ("From June on we are phasing out M9.11/B and will buy TT-5083-A only", 1, "M9.11/B", "TT-5083-A"),
    ("Stock of WX_90 is low, provisional replacement: 3CC-1", 1, "WX_90", "3CC-1"),
    ("Both L0.L1 and 77GH-2 passed the drop test", 0, None, None),
]


def _comments(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, Comments string")


def test_rule_extractor_on_plain_sentences(spark):
    out = X.extract_rules(_comments(spark, [g[0] for g in GOLDEN])).orderBy("id").collect()
    for row, (_, intent, old, new) in zip(out, GOLDEN):
        assert (row.replacement_intent, row.old_part, row.new_part) == (intent, old, new)
        assert row.error is None and 0 <= row.confidence <= 1
    assert out[3].confidence == 0.7


def test_blank_rows_untouched_and_br_processed(spark):
    out = X.extract_rules(_comments(spark, ["   ", None, "<br>"])).orderBy("id").collect()
    assert out[0].replacement_intent is None and out[0].rationale is None
    assert out[1].replacement_intent is None
    assert out[2].replacement_intent == 0          # "<br>" is processed, cleans to ""


def test_cue_without_direction(spark):
    out = X.extract_rules(_comments(spark, ["A12B is under evaluation next to C34D"])).first()
    assert out.replacement_intent == 1 and out.old_part is None


PAIRS = [
    # the cue's sides, not the ends of the sentence
    ("In Q4 2025, PART-001 replaced by X9Y", [("PART-001", "X9Y")]),
    ("transition to N5Y from P5X", [("P5X", "N5Y")]),
    ("P5X in 2025Q4 replaced by N5Y as of FY26", [("P5X", "N5Y")]),
    ("Everyone voted in favor of N1Y over P1X.", [("P1X", "N1Y")]),
    ("P1X has N1Y as provisional replacement.", [("P1X", "N1Y")]),
    # several pairs, chains, one pair once
    ("P1X was replaced by N1Y. In Q1, A1B was replaced by C1D.", [("P1X", "N1Y"), ("A1B", "C1D")]),
    ("P1X replaced by N1Y replaced by C1D", [("P1X", "N1Y"), ("N1Y", "C1D")]),
    ("Phasing out P1X in favor of N1Y", [("P1X", "N1Y")]),
    # a part that belongs to another cue is left to it
    ("Phasing out P1X, while A1B is replaced by C1D.", [("A1B", "C1D")]),
    ("P1X replaced by N1Y, phasing out A1B", [("P1X", "N1Y")]),
    ("N1Y adopted, retiring P1X", [("P1X", "N1Y")]),
    # nothing to pair
    ("P1X was replaced by P1X.", []), ("We are retiring P1X.", []), ("Path forward unclear.", []),
    ("P1X is an alternative to N1Y", []), ("a\x01P1X\x01 replaced by \x01N1Y", [("P1X", "N1Y")]),
]


def test_pairs_by_position(spark):
    from quarry.functions.pairing import replacement_pairs
    df = _comments(spark, [t for t, _ in PAIRS]).withColumn("p", replacement_pairs(F.col("Comments")))
    got = {r.Comments: [(x.old_part, x.new_part) for x in r.p] for r in df.collect()}
    for text, pairs in PAIRS:
        assert got[text] == pairs, text
    assert [r.p for r in df.select(replacement_pairs(F.lit(None).cast("string")).alias("p")).limit(1).collect()] == [None]


def test_every_cue_is_found(spark):
    from quarry.functions.text import CUE_PHRASES, DIRECTIONAL_CUES
    assert len(CUE_PHRASES) == 15
    df = _comments(spark, [f"A1 {c.upper()} B2" for c in CUE_PHRASES])
    rows = X.extract_rules(df).orderBy("id").collect()
    for cue, row in zip(CUE_PHRASES, rows):
        assert row.replacement_intent == 1
        pair = {"retiring": ("B2", "A1"), "phasing out": ("B2", "A1"), "movement away from": ("B2", "A1")}
        want = pair.get(cue, ("A1", "B2")) if cue in DIRECTIONAL_CUES else (None, None)
        assert (row.old_part, row.new_part) == want, cue
        assert row.cue_phrase == (cue if want[0] else None)


def test_extra_response_fields_are_refused(spark):
    body = {"replacement_intent": True, "replacement_pairs": [], "rationale": "r", "confidence": 0.5}
    df = spark.createDataFrame([(json.dumps(body),), (json.dumps({**body, "note": 1}),)], "j string")
    parsed, err = X.parse_response("j")
    rows = df.select(parsed.alias("p"), err.alias("e")).collect()
    assert rows[0].e is None and rows[1].p is None and rows[1].e == "Unexpected field 'note'"


def _fake(responses):
    """An extractor factory returning canned responses by payload text."""
    def make():
        def call(texts):
            out = []
            for t in texts:
                r = responses[t.split("\n", 1)[1]]
                if isinstance(r, Exception):
                    raise r
                out.append(r)
            return out
        return call
    return make


def test_model_row_states(spark):
    ok_two = json.dumps({"replacement_intent": True, "replacement_pairs": [
        {"old_part": "A1", "new_part": "B2", "cue_phrase": "replaced by"},
        {"old_part": "C3", "new_part": "D4", "cue_phrase": "x"}], "rationale": "r", "confidence": 0.8})
    no_pairs = json.dumps({"replacement_intent": False, "replacement_pairs": [],
                           "rationale": "none", "confidence": 0.3})
    missing = json.dumps({"replacement_intent": True, "replacement_pairs": [], "rationale": "r"})
    partial_pair = json.dumps({"replacement_intent": True, "replacement_pairs": [{"old_part": "Z9"}],
                               "rationale": "r", "confidence": 0.5})
    texts = ["two", "none", "missing", "bad", "nocall", "partial"]
    resp = {"two": ok_two, "none": no_pairs, "missing": missing, "bad": "{not json",
            "nocall": None, "partial": partial_pair}
    df = _comments(spark, texts + ["  "])
    out = {r.Comments: r for r in X.extract_with_model(df, _fake(resp), retries=0).collect()}
    assert (out["two"].replacement_intent, out["two"].old_part, out["two"].new_part) == (1, "A1", "B2")
    assert out["two"].error is None and out["two"].confidence == 0.8
    assert out["none"].replacement_intent == 0 and out["none"].old_part is None
    assert out["missing"].error == "'confidence'" and out["missing"].replacement_intent is None
    assert out["bad"].error.startswith("Invalid JSON")
    assert out["nocall"].error == "No tool call returned"
    assert (out["partial"].old_part, out["partial"].new_part) == ("Z9", "")
    assert out["  "].error is None and out["  "].replacement_intent is None


def test_model_call_failure_is_per_row(spark):
    df = _comments(spark, ["boom"])
    out = X.extract_with_model(df, _fake({"boom": RuntimeError("quota exceeded")}),
                               retries=1, backoff_s=0.01).first()
    assert out.error == "quota exceeded" and out.replacement_intent is None


def test_keep_prior(spark):
    df = spark.createDataFrame([(0, "x1", 1, "OLD", "NEW", "cue", 0.5, "r", None)],
                               "id long, Comments string, replacement_intent int, old_part string, "
                               "new_part string, cue_phrase string, confidence double, "
                               "rationale string, error string")
    resp = {"x1": json.dumps({"replacement_intent": False, "replacement_pairs": [],
                              "rationale": "n", "confidence": 0.2})}
    kept = X.extract_with_model(df, _fake(resp), keep_prior=True).first()
    cleared = X.extract_with_model(df, _fake(resp)).first()
    assert kept.old_part == "OLD" and cleared.old_part is None
    assert kept.replacement_intent == 0 and kept.confidence == 0.2


def test_pairs_flags_routes_scores(spark):
    df = _comments(spark, [g[0] for g in GOLDEN] + ["A12B is under evaluation next to C34D"])
    e = X.extract_rules(df)
    flags = {r.id: r.f for r in e.select("id", X.review_flag(e).alias("f")).collect()}
    assert flags[4] is True and flags[0] is False
    routes = {r.id: r.route for r in e.select("id", X.route(e).alias("route")).collect()}
    assert routes[1] == "approve" and routes[4] == "review"
    gold = spark.createDataFrame([(0, 1, "K4-77Q", "8ZT_21"), (3, 0, None, None)],
                                 "id long, gold_intent int, gold_old string, gold_new string")
    s = {r.field: r for r in X.scores(e, gold, "id").collect()}
    assert s["replacement_intent"].tp == 1 and s["replacement_intent"].fp == 0
    assert s["old_part"].f1 == 1.0


def test_universe_and_incremental(spark):
    df = _comments(spark, [g[0] for g in GOLDEN] + [GOLDEN[0][0], "  "])
    e = X.extract_rules(df)
    uni = spark.createDataFrame([("K4-77Q",), ("K4-77Q",)], "pn string")
    u = {r.id: (r.old_known, r.new_known) for r in X.universe_check(e, uni, "pn").collect()}
    assert u[0] == (True, False) and u[3] == (None, None) and len(u) == 6
    calls = []

    def run(todo):
        calls.append(todo.count())
        return X.extract_rules(todo)
    prior = X.extract_rules(df.where("id = 1")).withColumn("text_key", X.text_key("Comments"))
    out = X.incremental(df, prior, run).collect()
    assert calls == [3]            # 4 distinct non-blank texts, 1 already known
    assert len(out) == 6 and sum(1 for r in out if r.reused) == 1


def test_parse_response_schema_errors(spark):
    df = spark.createDataFrame([('{"replacement_intent": "maybe", "replacement_pairs": [], '
                                 '"rationale": "r", "confidence": 1}',), ("[1,2]",)], "j string")
    parsed, err = X.parse_response("j")
    rows = df.select(parsed.alias("p"), err.alias("e")).collect()
    assert rows[0].p is None and "replacement_intent" in rows[0].e
    assert rows[1].e is not None


@pytest.mark.parametrize("conf,intent,old,new,rules", [
    (1.5, 1, "A", "B", ["confidence_out_of_range"]),
    (0.5, 0, "A", "", ["pair_without_intent"]),
    (0.5, 1, "A", "A", ["same_old_and_new"]),
])
def test_rule_violations(spark, conf, intent, old, new, rules):
    df = spark.createDataFrame([(conf, intent, old, new)],
                               "confidence double, replacement_intent int, old_part string, new_part string")
    assert [r.rule for r in X.rule_violations(df).collect()] == rules


def test_plan_of_rule_extraction_has_one_python_stage(spark):
    e = X.extract_rules(spark.createDataFrame([(1, "a")], "id long, Comments string"))
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "BatchEvalPython" not in plan
    assert F is not None


def test_resumable_skips_finished_buckets(spark, scratch):
    texts = [g[0] for g in GOLDEN] * 3 + ["  "]
    df = _comments(spark, texts)
    path = f"{scratch}/results"
    seen = []

    def run(todo):
        seen.append(todo.count())
        return X.extract_rules(todo)
    out = X.resumable(df, path, run, buckets=4)
    assert sum(seen) == 4 and out.count() == len(texts)
    assert out.where("replacement_intent = 1").count() == 9
    seen.clear()
    again = X.resumable(df, path, run, buckets=4)      # a restart: nothing left to call
    assert sum(seen) == 0 and again.count() == len(texts)


def test_gold_scores_blank_rows(spark):
    """A false intent on a blank comment must count against the extractor."""
    from quarry.plans import extract_queries as XQ
    from tests.conftest import SF001
    gold = XQ.gold(spark, SF001)
    blank = gold.where("id % 5 = 4")
    assert gold.count() == spark.read.parquet(f"{SF001}/part.parquet").count()
    assert blank.count() > 0 and blank.where("NOT (gold_intent <=> 0) OR gold_old IS NOT NULL").count() == 0
    false = blank.selectExpr("id", "1 as replacement_intent", "'A' as old_part", "'B' as new_part")
    assert {r.fp for r in X.scores(false, gold, "id").collect()} == {blank.count()}
