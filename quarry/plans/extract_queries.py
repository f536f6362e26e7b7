"""Registered plans for text clean-up and extraction (T, X operators).

The given ``documents`` hold no cue phrases and no tags, so extraction runs
on a comments view derived from ``part`` by one CASE expression that Spark
and DuckDB both accept (it grows with ``part``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as TX
from quarry.operators import extract as X

COMMENT_CASE = """case p_partkey % 5
 when 0 then concat('Boards still carry P', p_partkey, 'X, yet the agreed path forward is N', p_partkey, 'Y')
 when 1 then concat('<b>Buyers</b> plan on phasing out P', p_partkey, 'X once N', p_partkey, 'Y is in stock')
 when 2 then concat('Stock of P', p_partkey, 'X is low, provisional replacement: N', p_partkey, 'Y')
 when 3 then concat('Both P', p_partkey, 'X &amp; N', p_partkey, 'Y passed the drop test')
 else '   ' end"""
COMMENTS_SQL = f"select p_partkey as id, {COMMENT_CASE} as Comments from part"


def comments(spark, sf_dir) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.selectExpr("p_partkey as id", f"{COMMENT_CASE} as Comments")


def strip_tags(spark, sf_dir) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", TX.strip_tags("html").alias("stripped"))


def collapse_ws(spark, sf_dir) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", TX.collapse_ws("html").alias("collapsed"))


def clean_text(spark, sf_dir) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", TX.clean_text("html").alias("cleaned"))


def clean_comments(spark, sf_dir) -> DataFrame:
    c = comments(spark, sf_dir)
    return c.select("id", TX.clean_text("Comments").alias("cleaned"),
                    TX.prompt_payload(TX.clean_text("Comments")).alias("payload"))


def part_tokens(spark, sf_dir) -> DataFrame:
    c = comments(spark, sf_dir)
    return c.select("id", F.array_join(TX.part_tokens("Comments"), " ").alias("tokens"),
                    F.size(TX.part_tokens("Comments")).alias("n_tokens"))


def extract_flat(spark, sf_dir) -> DataFrame:
    return X.extract_rules(comments(spark, sf_dir))


def extract_parsed(spark, sf_dir) -> DataFrame:
    """X2 path: rule responses rendered as JSON, parsed back, flattened."""
    j = X.responses_json(comments(spark, sf_dir))
    parsed, err = X.parse_response("__json")
    out = j.withColumn("__r", parsed).withColumn("__e", err).drop("__json", "__clean")
    return X.flatten(out, "__r", "__e", F.col("__processed")).drop("__processed")


def extract_pairs(spark, sf_dir) -> DataFrame:
    c = X.with_clean(comments(spark, sf_dir), "Comments")
    r = X.with_baseline_response(c, "__clean", "resp", gate=F.col("__processed"))
    return X.explode_pairs(r, "resp", ["id"])


def review_flags(spark, sf_dir) -> DataFrame:
    e = extract_flat(spark, sf_dir)
    return e.select("id", "replacement_intent", X.review_flag(e).alias("needs_review"))


def confidence_routes(spark, sf_dir) -> DataFrame:
    e = extract_flat(spark, sf_dir)
    return e.groupBy(X.route(e).alias("route")).agg(F.count(F.lit(1)).alias("n"))


def intent_share(spark, sf_dir) -> DataFrame:
    """A6 on extraction output: "n of m comments have replacement_intent = 1"."""
    from quarry.operators.aggregate import share
    return share(extract_flat(spark, sf_dir), "replacement_intent = 1")


def _universe(spark, sf_dir) -> DataFrame:
    # Known part numbers: every old-style code, new-style codes of parts sized <= 25.
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    old = part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string"), F.lit("X")).alias("pn"))
    new = part.where(F.col("p_size") <= 25).select(
        F.concat(F.lit("N"), F.col("p_partkey").cast("string"), F.lit("Y")).alias("pn"))
    return old.unionByName(new)


def part_universe_check(spark, sf_dir) -> DataFrame:
    e = extract_flat(spark, sf_dir).where(F.col("replacement_intent") == 1)
    return X.universe_check(e, _universe(spark, sf_dir), "pn").select(
        "id", "old_part", "new_part", "old_known", "new_known")


def incremental_extract(spark, sf_dir) -> DataFrame:
    """X11: an earlier run already extracted the comments of small parts
    (``p_size <= 25``); only the rest may reach the extractor."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    earlier = part.where(F.col("p_size") <= 25).selectExpr("p_partkey as id", f"{COMMENT_CASE} as Comments")
    prior = X.extract_rules(earlier.where(~TX.is_blank("Comments"))) \
        .withColumn("text_key", X.text_key("Comments")).dropDuplicates(["text_key"])
    c = comments(spark, sf_dir)
    out = X.incremental(c, prior, X.extract_rules)
    return out.select("id", "replacement_intent", "old_part", "new_part", "reused")


def gold(spark, sf_dir) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    m = k % 5
    return part.select(                # blank comments (m = 4) have no intent
        k.alias("id"),
        F.when(m <= 2, 1).otherwise(0).alias("gold_intent"),
        F.when(m <= 2, F.concat(F.lit("P"), k.cast("string"), F.lit("X"))).alias("gold_old"),
        F.when(m <= 2, F.concat(F.lit("N"), k.cast("string"), F.lit("Y"))).alias("gold_new"))


def extraction_scores(spark, sf_dir) -> DataFrame:
    return X.scores(extract_flat(spark, sf_dir), gold(spark, sf_dir), "id")


def rule_violations(spark, sf_dir) -> DataFrame:
    e = extract_flat(spark, sf_dir)
    return X.rule_violations(e).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "strip_tags": strip_tags,
    "collapse_ws": collapse_ws,
    "clean_text": clean_text,
    "clean_comments": clean_comments,
    "part_tokens": part_tokens,
    "extract_flat": extract_flat,
    "extract_parsed": extract_parsed,
    "extract_pairs": extract_pairs,
    "review_flags": review_flags,
    "confidence_routes": confidence_routes,
    "intent_share": intent_share,
    "part_universe_check": part_universe_check,
    "incremental_extract": incremental_extract,
    "extraction_scores": extraction_scores,
    "rule_violations": rule_violations,
}

_WS = (r"'[\t\n\x0B\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
       r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'")
_CLEAN = ("trim(regexp_replace(replace(replace(replace(replace("
          "regexp_replace({c}, '<[^>]+>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), "
          "'&quot;', '\"'), '&amp;', '&'), " + _WS + ", ' ', 'g'))")
_CLEAN_C = ("trim(regexp_replace(replace(regexp_replace({c}, '<[^>]+>', ' ', 'g'), '&amp;', '&'), "
            + _WS + ", ' ', 'g'))")
_M = "(id % 5)"
_EXPECTED = f"""
  case when {_M} = 4 then null when {_M} <= 2 then 1 else 0 end as replacement_intent,
  case when {_M} <= 2 then 'P' || id || 'X' end as old_part,
  case when {_M} <= 2 then 'N' || id || 'Y' end as new_part,
  case {_M} when 0 then 'path forward' when 1 then 'phasing out'
           when 2 then 'provisional replacement' end as cue_phrase,
  case when {_M} = 4 then null when {_M} <= 2 then 0.9::double else 0.7::double end as confidence,
  case when {_M} = 4 then null
       when {_M} <= 2 then 'Cue "' || (case {_M} when 0 then 'path forward' when 1 then 'phasing out'
           else 'provisional replacement' end) || '" moves from P' || id || 'X to N' || id || 'Y.'
       else 'No replacement cue found.' end as rationale,
  cast(null as varchar) as error"""
_EXTRACTED = f"select id, Comments, {_EXPECTED} from ({COMMENTS_SQL})"
_TOK = r"'\b([A-Z][A-Z0-9._/-]*[0-9][A-Z0-9._/-]*|[0-9][A-Z0-9._/-]*[A-Z][A-Z0-9._/-]*)\b'"

ORACLE = {
    "strip_tags": "select page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') as stripped from pages",
    "collapse_ws": f"select page_id, trim(regexp_replace(html, {_WS}, ' ', 'g')) as collapsed from pages",
    "clean_text": f"select page_id, {_CLEAN.replace('{c}', 'html')} as cleaned from pages",
    "clean_comments": f"select id, {_CLEAN_C.replace('{c}', 'Comments')} as cleaned, "
                      f"'TEXT:' || chr(10) || {_CLEAN_C.replace('{c}', 'Comments')} as payload from ({COMMENTS_SQL})",
    "part_tokens": f"select id, array_to_string(regexp_extract_all(Comments, {_TOK}, 1), ' ') as tokens, "
                   f"cast(len(regexp_extract_all(Comments, {_TOK}, 1)) as integer) as n_tokens from ({COMMENTS_SQL})",
    "extract_flat": _EXTRACTED,
    "extract_parsed": _EXTRACTED,
    "extract_pairs": f"select id, 1 as pair_no, old_part, new_part, cue_phrase from ({_EXTRACTED}) "
                     "where old_part is not null",
    "review_flags": f"select id, replacement_intent, (replacement_intent = 1 and "
                    f"(coalesce(old_part, '') = '' or coalesce(new_part, '') = '')) as needs_review "
                    f"from ({_EXTRACTED})",
    "confidence_routes": f"select case when error is not null then 'failed' "
                         f"when replacement_intent is null then 'skipped' "
                         f"when replacement_intent = 1 and (coalesce(old_part,'') = '' or coalesce(new_part,'') = '') then 'review' "
                         f"when confidence >= 0.85 then 'approve' else 'review' end as route, "
                         f"count(*) as n from ({_EXTRACTED}) group by 1",
    "intent_share": f"select count(*) filter (where replacement_intent = 1) as matched, count(*) as total "
                    f"from ({_EXTRACTED})",
    "part_universe_check": f"select id, old_part, new_part, true as old_known, "
                           f"(select p_size from part where p_partkey = e.id) <= 25 as new_known "
                           f"from ({_EXTRACTED}) e where replacement_intent = 1",
    "incremental_extract": f"select e.id, replacement_intent, old_part, new_part, "
                           f"case when {_M} = 4 then null else p.p_size <= 25 end as reused "
                           f"from ({_EXTRACTED}) e join part p on p.p_partkey = e.id",
    "extraction_scores": f"""
        with j as (select id, replacement_intent, old_part, new_part from ({_EXTRACTED}) where {_M} <> 4)
        select field, tp, fp, fn, round(tp / (tp + fp), 4) as precision, round(tp / (tp + fn), 4) as recall,
               round(2.0 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))), 4) as f1
        from (
          select 'replacement_intent' as field, count(*) filter (where replacement_intent = 1) as tp,
                 0::bigint as fp, 0::bigint as fn from j
          union all select 'old_part', count(*) filter (where old_part is not null), 0::bigint, 0::bigint from j
          union all select 'new_part', count(*) filter (where new_part is not null), 0::bigint, 0::bigint from j)""",
    "rule_violations": f"""
        select rule, count(*) as n from (
          select 'confidence_out_of_range' as rule from ({_EXTRACTED}) where confidence < 0 or confidence > 1
          union all select 'pair_without_intent' from ({_EXTRACTED})
            where replacement_intent = 0 and (coalesce(old_part, '') <> '' or coalesce(new_part, '') <> '')
          union all select 'same_old_and_new' from ({_EXTRACTED})
            where replacement_intent = 1 and old_part = new_part) group by rule""",
}
