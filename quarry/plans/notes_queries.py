"""Registered plans over notes that reach every outcome of the extraction rules.

One note per part, by a table of sentences with what a reader makes of them.
The note is built from the sentence, the expected row from the reading; the
extractor never sees the latter.  ``{k}`` stands for the part's number.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import extract as X

#: (note, first cue or None, pairs as (old, new, cue)); a blank note has None for its pairs.
NOTES = [
    ("In Q4 2025, part P{k}X was replaced by N{k}Y.", "replaced by", [("P{k}X", "N{k}Y", "replaced by")]),
    ("We are retiring P{k}X this quarter.", "retiring", []),
    ("Supply will transition to N{k}Y from P{k}X.", "transition to", [("P{k}X", "N{k}Y", "transition to")]),
    ("For P{k}X the path forward is N{k}Y.", "path forward", [("P{k}X", "N{k}Y", "path forward")]),
    ("An alternative to P{k}X could be N{k}Y.", "alternative", []),
    ("The team stays focused on N{k}Y and P{k}X.", "focused on", []),
    ("N{k}Y is under evaluation next to P{k}X.", "under evaluation", []),
    ("The current consideration covers P{k}X and N{k}Y.", "current consideration", []),
    ("P{k}X is no longer viable, N{k}Y takes its place.", "no longer viable", [("P{k}X", "N{k}Y", "no longer viable")]),
    ("Buyers are phasing out P{k}X, with N{k}Y to follow.", "phasing out", [("P{k}X", "N{k}Y", "phasing out")]),
    ("Everyone voted in favor of N{k}Y over P{k}X.", "in favor of", [("P{k}X", "N{k}Y", "in favor of")]),
    ("Demand for P{k}X has shifted toward N{k}Y in FY26.", "shifted toward", [("P{k}X", "N{k}Y", "shifted toward")]),
    ("We see movement away from P{k}X toward N{k}Y.", "movement away from", [("P{k}X", "N{k}Y", "movement away from")]),
    ("For P{k}X a sourcing review introduced N{k}Y.", "sourcing review introduced",
     [("P{k}X", "N{k}Y", "sourcing review introduced")]),
    ("P{k}X has N{k}Y as provisional replacement.", "provisional replacement",
     [("P{k}X", "N{k}Y", "provisional replacement")]),
    ("P{k}X was replaced by N{k}Y. In Q1, A{k}B was replaced by C{k}D.", "replaced by",
     [("P{k}X", "N{k}Y", "replaced by"), ("A{k}B", "C{k}D", "replaced by")]),
    ("P{k}X replaced by N{k}Y replaced by C{k}D", "replaced by",
     [("P{k}X", "N{k}Y", "replaced by"), ("N{k}Y", "C{k}D", "replaced by")]),
    ("Phasing out P{k}X in favor of N{k}Y", "phasing out", [("P{k}X", "N{k}Y", "phasing out")]),
    ("Phasing out P{k}X, while A{k}B is replaced by C{k}D.", "phasing out", [("A{k}B", "C{k}D", "replaced by")]),
    ("P{k}X and N{k}Y met all limits in Q3.", None, []),
    ("P{k}X was replaced by P{k}X.", "replaced by", []),
    ("Path forward unclear for the site.", "path forward", []),
    ("<br>", None, []),
    ("   ", None, None),
    (None, None, None),
]


def _sql(template: str | None, key: str) -> str:
    """A template as SQL text that Spark and DuckDB both read."""
    if template is None:
        return "cast(null as varchar(200))"
    pieces = ["'" + p.replace("'", "''") + "'" for p in template.split("{k}")]
    return f"concat({f', {key}, '.join(pieces)})" if len(pieces) > 1 else pieces[0]


def _case(key: str, values: list[str]) -> str:
    return f"case {key} % {len(NOTES)} " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end"


NOTE_CASE = _case("p_partkey", [_sql(n, "p_partkey") for n, _, _ in NOTES])


def notes(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey as id", f"{NOTE_CASE} as Comments")


def notes_flat(spark, sf_dir) -> DataFrame:
    """X7 with X3: the first pair of every note."""
    return X.extract_rules(notes(spark, sf_dir))


def notes_pairs(spark, sf_dir) -> DataFrame:
    """Every pair of every note."""
    c = X.with_clean(notes(spark, sf_dir), "Comments")
    return X.explode_pairs(X.with_baseline_response(c, "__clean", "resp", gate=F.col("__processed")), "resp", ["id"])


def notes_review(spark, sf_dir) -> DataFrame:
    """X8 and X9 over every outcome."""
    e = notes_flat(spark, sf_dir)
    return e.select("id", X.review_flag(e).alias("needs_review"), X.route(e).alias("route"))


def notes_scores(spark, sf_dir) -> DataFrame:
    """X12 against readers who disagree with the rules: they see intent in every tenth part of whatever note,
    never in focused-on notes, and swap the parts of every seventh."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    gold = part.selectExpr("p_partkey as id", f"{_GOLD['intent']} as gold_intent", f"{_GOLD['old']} as gold_old",
                           f"{_GOLD['new']} as gold_new")
    return X.scores(notes_flat(spark, sf_dir), gold, "id")


def response_violations(spark, sf_dir) -> DataFrame:
    """D4 over extraction rows that break each rule, alone and together (a model's answers, derived from part)."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        "p_partkey as id", "p_size / 40.0D as confidence", "cast(p_partkey % 2 as int) as replacement_intent",
        "case when p_partkey % 3 = 0 then p_brand when p_partkey % 3 = 1 then '' end as old_part",
        "case when p_partkey % 9 < 5 then p_brand else p_type end as new_part")
    return X.rule_violations(rows).select("id", "rule")


def answers():
    """A model client that answers by plain rules; some answers are missing, broken, refused or fail."""
    def call(payloads: list[str]) -> list:
        out = []
        for p in payloads:
            text = p.split("\n", 1)[1]
            pairs = [{"old_part": "A1", "new_part": "B2", "cue_phrase": "replaced by"}] if "replaced by" in text else []
            body = {"replacement_intent": bool(pairs), "replacement_pairs": pairs, "rationale": str(len(text)),
                    "confidence": 0.75}
            if "phasing out" in text.lower():
                del body["confidence"]
            if "viable" in text:
                body["note"] = "not asked for"
            out.append(None if "retiring" in text else "{broken" if "voted" in text
                       else RuntimeError("quota") if "movement" in text else json.dumps(body))
        return out
    return call


def model_extract(spark, sf_dir) -> DataFrame:
    """X1 with X5 and X6: a model client answers for every note; some answers fail, row by row."""
    return X.extract_with_model(notes(spark, sf_dir), answers, retries=0)


_K = "p_partkey"
_READ = {
    "intent": _case(_K, ["cast(null as int)" if pairs is None else str(int(cue is not None)) for _, cue, pairs in NOTES]),
    **{name: _case(_K, [_sql(pairs[0][i] if pairs else None, _K) for _, _, pairs in NOTES])
       for i, name in enumerate(("old", "new", "cue"))},
    "first": _case(_K, [_sql(cue, _K) for _, cue, _ in NOTES]),
    "blank": _case(_K, [str(pairs is None).lower() for _, _, pairs in NOTES]),
}
_GOLD = {
    "intent": f"case when {_K} % 10 = 0 then 1 when {_K} % {len(NOTES)} = 5 then 0 else coalesce({_READ['intent']}, 0) end",
    "old": f"case when {_K} % 7 = 0 then {_READ['new']} else {_READ['old']} end",
    "new": f"case when {_K} % 7 = 0 then {_READ['old']} else {_READ['new']} end",
}
_ROWS = f"""select {_K} as id, {NOTE_CASE} as Comments, {_READ['intent']} as intent, {_READ['old']} as old_part,
  {_READ['new']} as new_part, {_READ['cue']} as cue, {_READ['first']} as first_cue, {_READ['blank']} as blank,
  {_GOLD['intent']} as gold_intent, {_GOLD['old']} as gold_old, {_GOLD['new']} as gold_new from part"""
_FLAT = f"""select id, Comments, intent as replacement_intent, old_part, new_part, cue as cue_phrase,
  case when blank then null when old_part is not null then 0.9::double when intent = 1 then 0.5::double
    else 0.7::double end as confidence,
  case when blank then null when old_part is not null then 'Cue "' || cue || '" moves from ' || old_part || ' to ' || new_part || '.'
    when intent = 1 then 'Cue "' || first_cue || '" without a clear old-to-new direction.'
    else 'No replacement cue found.' end as rationale, cast(null as varchar) as error from ({_ROWS})"""


def _score_sql(field: str, tp: str, fp: str, fn: str) -> str:
    return (f"select '{field}' as field, count(*) filter (where {tp}) as tp, count(*) filter (where {fp}) as fp, "
            f"count(*) filter (where {fn}) as fn from ({_ROWS})")


def _part_score(name: str) -> str:
    same = f"coalesce({name}_part = gold_{name}, false)"
    return _score_sql(f"{name}_part", same, f"{name}_part is not null and not {same}",
                      f"gold_{name} is not null and not {same}")


QUERIES = {f.__name__: f for f in (notes_flat, notes_pairs, notes_review, notes_scores, response_violations, model_extract)}

ORACLE = {
    "notes_flat": _FLAT,
    "notes_pairs": "\nunion all\n".join(
        f"select {_K} as id, {n + 1} as pair_no, {_sql(old, _K)} as old_part, {_sql(new, _K)} as new_part, "
        f"'{cue}' as cue_phrase from part where {_K} % {len(NOTES)} = {i}"
        for i, (_, _, pairs) in enumerate(NOTES) for n, (old, new, cue) in enumerate(pairs or [])),
    "notes_review": f"""select id, case when intent = 1 then old_part is null when intent = 0 then false end as needs_review,
        case when blank then 'skipped' when intent = 1 and old_part is null then 'review'
          when old_part is not null then 'approve' else 'review' end as route from ({_ROWS})""",
    "notes_scores": f"""
        select *, round(2 * p * r / (p + r), 4) as f1 from (
          select field, tp, fp, fn, round(tp / (tp + fp), 4) as precision, round(tp / (tp + fn), 4) as recall,
            tp / (tp + fp) as p, tp / (tp + fn) as r
          from ({_score_sql("replacement_intent", "intent = 1 and gold_intent = 1", "intent = 1 and gold_intent = 0",
                            "coalesce(intent, 0) = 0 and gold_intent = 1")}
                union all {_part_score("old")} union all {_part_score("new")}))""".replace(
        "select *, round(2", "select field, tp, fp, fn, precision, recall, round(2"),
    "response_violations": """
        with rows as (select p_partkey as id, p_size / 40.0 as confidence, p_partkey % 2 as intent,
            case when p_partkey % 3 = 0 then p_brand when p_partkey % 3 = 1 then '' end as old_part,
            case when p_partkey % 9 < 5 then p_brand else p_type end as new_part from part)
        select id, 'confidence_out_of_range' as rule from rows where confidence < 0 or confidence > 1
        union all select id, 'pair_without_intent' from rows where intent = 0
        union all select id, 'same_old_and_new' from rows where intent = 1 and old_part = new_part""",
    "model_extract": f"""
        with r as (select *, lower(clean) as low from (select id, Comments, blank, case when Comments = '<br>' then ''
            else trim(Comments) end as clean from ({_ROWS}))),
        s as (select *, case when blank then null when contains(clean, 'retiring') then 'No tool call returned'
            when contains(clean, 'voted') then 'Invalid JSON in tool arguments' when contains(clean, 'movement') then 'quota'
            when contains(low, 'phasing out') then '''confidence'''
            when contains(clean, 'viable') then 'Unexpected field ''note''' end as error from r)
        select id, Comments, case when not blank and error is null then contains(clean, 'replaced by')::int end as replacement_intent,
          case when error is null and contains(clean, 'replaced by') then 'A1' end as old_part,
          case when error is null and contains(clean, 'replaced by') then 'B2' end as new_part,
          case when error is null and contains(clean, 'replaced by') then 'replaced by' end as cue_phrase,
          case when not blank and error is null then 0.75::double end as confidence,
          case when not blank and error is null then length(clean)::varchar end as rationale, error from s""",
}
