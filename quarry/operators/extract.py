"""Structured extraction of part-replacement records.

Shape of the job::

    raw text --clean (T4)--> payload --(X1 model plug-in | X7 rules)--> JSON/struct
             --parse (X2)--> first pair flattened (X3) + row error (X5)
             --ensure 7 output columns (X6)

The rule-based extractor (X7) is pure column expressions.  The model
plug-in (X1) runs in ``mapInPandas``: one client per partition, Arrow
batches, bounded concurrency through the partition count, per-row error
capture so one bad row never fails the task.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import text as TX
from quarry.functions.pairing import replacement_pairs
from quarry.operators.membership import Universe, known_keys
from quarry.session import path_exists, scratch_path

PAIR = T.StructType([
    T.StructField("old_part", T.StringType()),
    T.StructField("new_part", T.StringType()),
    T.StructField("cue_phrase", T.StringType()),
])
# Fixed value: the tool-call argument schema (all four fields required).
RESPONSE_SCHEMA = T.StructType([
    T.StructField("replacement_intent", T.BooleanType()),
    T.StructField("replacement_pairs", T.ArrayType(PAIR)),
    T.StructField("rationale", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
])
REQUIRED = ["replacement_intent", "replacement_pairs", "rationale", "confidence"]
# Fixed value: output columns added to the input, in order.
OUTPUT_COLUMNS = [("replacement_intent", "int"), ("old_part", "string"),
                  ("new_part", "string"), ("cue_phrase", "string"),
                  ("confidence", "double"), ("rationale", "string"), ("error", "string")]

# [ours] confidence of the rule extractor by outcome
CONF_PAIR, CONF_CUE_ONLY, CONF_NO_CUE = 0.9, 0.5, 0.7


# ---- X7: rule-based response ---------------------------------------------
def with_baseline_response(df: DataFrame, cleaned: str, out: str,
                           gate: Column | None = None) -> DataFrame:
    """Add a response struct built from cue lexicon, part tokens and their positions.

    Every directional cue pairs the nearest parts on its sides (see
    :mod:`quarry.functions.pairing`); cue without a pair -> intent, no pair;
    no cue -> no intent.  Pairs and cue are computed once as columns so the
    regex work is not repeated per use.
    """
    c = F.col(cleaned)
    df = df.withColumn("__pairs", replacement_pairs(c)).withColumn("__first", TX.first_cue(c))
    pairs = F.coalesce(F.col("__pairs"), F.array().cast(T.ArrayType(PAIR)))
    has_pair = F.coalesce(F.size("__pairs") > 0, F.lit(False))
    pair = F.get(F.col("__pairs"), F.lit(0))
    old, new = pair["old_part"], pair["new_part"]
    cue = F.coalesce(pair["cue_phrase"], F.col("__first"))
    rationale = (F.when(has_pair, F.concat(F.lit('Cue "'), cue, F.lit('" moves from '), old,
                                           F.lit(" to "), new, F.lit(".")))
                 .when(cue.isNotNull(), F.concat(F.lit('Cue "'), cue,
                                                 F.lit('" without a clear old-to-new direction.')))
                 .otherwise(F.lit("No replacement cue found.")))
    conf = (F.when(has_pair, F.lit(CONF_PAIR)).when(cue.isNotNull(), F.lit(CONF_CUE_ONLY))
            .otherwise(F.lit(CONF_NO_CUE)))
    resp = F.struct(cue.isNotNull().alias("replacement_intent"), pairs.alias("replacement_pairs"),
                    rationale.alias("rationale"), conf.alias("confidence"))
    # spark_partition_id() >= 0 always holds: a no-op that makes this
    # projection nondeterministic (the optimizer cannot fold it away, unlike
    # ``rand() < 2``), so a later filter on derived columns (intent, parts)
    # is evaluated on the computed struct instead of being pushed below it
    # and re-running the rules inside the filter.
    barrier = F.spark_partition_id() >= 0
    keep = barrier if gate is None else (barrier & gate)
    return df.withColumn(out, F.when(keep, resp)).drop("__pairs", "__first")


# ---- X2: parse a JSON response ----------------------------------------------
def parse_response(resp: Column | str) -> tuple[Column, Column]:
    """``(struct, error)`` from a JSON string.

    Bad JSON, a missing/ill-typed required key or a key that the schema does
    not have gives an error message and a NULL struct (all-or-nothing).  A
    missing key reads like Python's ``KeyError`` text: ``'confidence'``.
    """
    r = F.col(resp) if isinstance(resp, str) else resp
    keys = F.json_object_keys(r)
    parsed = F.from_json(r, RESPONSE_SCHEMA, {"mode": "PERMISSIVE"})
    # no lambdas: the response may be computed by a Python UDF upstream
    missing = F.array_except(F.array(*[F.lit(k) for k in REQUIRED]),
                             F.coalesce(keys, F.array().cast("array<string>")))
    extra = F.array_except(keys, F.array(*[F.lit(k) for k in REQUIRED]))
    badtype = F.array_compact(F.array(*[F.when(parsed[k].isNull(), F.lit(k)) for k in REQUIRED]))
    error = (F.when(r.isNull(), F.lit("No tool call returned"))
             .when(keys.isNull(), F.lit("Invalid JSON in tool arguments"))
             .when(F.size(missing) > 0, F.concat(F.lit("'"), F.element_at(missing, 1), F.lit("'")))
             .when(F.size(extra) > 0, F.concat(F.lit("Unexpected field '"), F.element_at(extra, 1), F.lit("'")))
             .when(F.size(badtype) > 0, F.concat(F.lit("Invalid value for '"),
                                                 F.element_at(badtype, 1), F.lit("'"))))
    return F.when(error.isNull(), parsed), error


# ---- X3/X5/X6: flatten into the seven output columns ------------------------
def flatten(df: DataFrame, response: str, error: str, processed: Column,
            keep_prior: bool = False) -> DataFrame:
    """Write the response into the seven output columns.

    ``processed`` is the F7 gate; unprocessed rows keep prior values (or
    NULL).  With ``keep_prior`` a successful response without pairs keeps
    earlier old/new/cue values and a failed one keeps every earlier value.
    """
    for name, typ in OUTPUT_COLUMNS:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(typ))
    r, e = F.col(response), F.col(error)
    ok = processed & e.isNull()
    failed = processed & e.isNotNull()
    pair = F.try_element_at(r["replacement_pairs"], F.lit(1))
    has_pair = ok & pair.isNotNull()

    def prior(name):
        return F.col(name) if keep_prior else F.lit(None)

    new_vals = {
        "replacement_intent": F.when(ok, r["replacement_intent"].cast("int"))
        .when(failed, prior("replacement_intent")).otherwise(F.col("replacement_intent")),
        "old_part": F.when(has_pair, F.coalesce(pair["old_part"], F.lit("")))
        .when(processed, prior("old_part")).otherwise(F.col("old_part")),
        "new_part": F.when(has_pair, F.coalesce(pair["new_part"], F.lit("")))
        .when(processed, prior("new_part")).otherwise(F.col("new_part")),
        "cue_phrase": F.when(has_pair, F.coalesce(pair["cue_phrase"], F.lit("")))
        .when(processed, prior("cue_phrase")).otherwise(F.col("cue_phrase")),
        "confidence": F.when(ok, r["confidence"]).when(failed, prior("confidence"))
        .otherwise(F.col("confidence")),
        "rationale": F.when(ok, r["rationale"]).when(failed, prior("rationale"))
        .otherwise(F.col("rationale")),
        "error": F.when(processed, e).otherwise(F.col("error")),
    }
    return df.withColumns({k: v.cast(dict(OUTPUT_COLUMNS)[k]) for k, v in new_vals.items()}) \
        .drop(response, error)


def require_column(df: DataFrame, text_col: str) -> None:
    """Fail before any job when the text column is absent."""
    if text_col not in df.columns:
        raise KeyError(f"Column '{text_col}' not found. Available: {df.columns}")


def with_clean(df: DataFrame, text_col: str) -> DataFrame:
    """Add ``__processed`` (F7 gate) and ``__clean`` (T4) once."""
    require_column(df, text_col)
    return df.withColumn("__processed", ~TX.is_blank(text_col)) \
        .withColumn("__clean", TX.clean_text(text_col))


def extract_rules(df: DataFrame, text_col: str = "Comments", keep_prior: bool = False) -> DataFrame:
    """X7 end to end: clean, rule response, flatten.  No Python in the plan
    except the entity unescape of rows that contain ``&``."""
    out = with_baseline_response(with_clean(df, text_col), "__clean", "__resp",
                                 gate=F.col("__processed"))
    out = out.withColumn("__err", F.lit(None).cast("string"))
    return flatten(out, "__resp", "__err", F.col("__processed"), keep_prior) \
        .drop("__processed", "__clean")


def responses_json(df: DataFrame, text_col: str = "Comments") -> DataFrame:
    """Rule responses rendered as tool-argument JSON in ``__json`` (feeds X2)."""
    out = with_baseline_response(with_clean(df, text_col), "__clean", "__resp",
                                 gate=F.col("__processed"))
    return out.withColumn("__json", F.to_json("__resp")).drop("__resp")


# ---- X1: model plug-in -------------------------------------------------------
Extractor = Callable[[list[str]], list[str | None]]


def extract_with_model(df: DataFrame, make_extractor: Callable[[], Extractor],
                       text_col: str = "Comments", partitions: int | None = None,
                       batch_rows: int = 32, retries: int = 3, backoff_s: float = 1.0,
                       keep_prior: bool = False) -> DataFrame:
    """Call a user-supplied extractor on the cleaned payloads.

    ``make_extractor()`` runs once per partition (one client per task) and
    returns ``f(payloads) -> list of JSON strings`` (tool arguments; None
    means no tool call).  ``partitions`` bounds concurrent callers, i.e. the
    remote quota in flight.  Failures are retried with back-off, then stored
    per row in ``error``; the task itself never fails on a bad row.

    Results should be materialised (``checkpoint``/table write) before more
    than one action runs on them: a re-run would pay for every call again.
    """
    work = with_clean(df, text_col)
    work = work.withColumn("__payload", F.when(F.col("__processed"), TX.prompt_payload(F.col("__clean"))))\
        .drop("__clean")
    if partitions:
        work = work.repartition(partitions)
    schema = T.StructType(work.schema.fields + [
        T.StructField("__resp", T.StringType()), T.StructField("__call_err", T.StringType())])

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        fn = make_extractor()
        for pdf in batches:
            resp: list[str | None] = [None] * len(pdf)
            err: list[str | None] = [None] * len(pdf)
            idx = [i for i, p in enumerate(pdf["__payload"]) if isinstance(p, str)]
            for start in range(0, len(idx), batch_rows):
                chunk = idx[start:start + batch_rows]
                texts = [pdf["__payload"].iat[i] for i in chunk]
                for attempt in range(retries + 1):
                    try:
                        outs = fn(texts)
                        if len(outs) != len(texts):
                            raise RuntimeError("extractor returned a wrong number of results")
                        for i, o in zip(chunk, outs):
                            if isinstance(o, BaseException):
                                err[i] = str(o)
                            elif o is None:
                                err[i] = "No tool call returned"
                            else:
                                resp[i] = o if isinstance(o, str) else json.dumps(o)
                        break
                    except Exception as exc:  # noqa: BLE001 - recorded per row
                        if attempt == retries:
                            for i in chunk:
                                err[i] = str(exc)
                        else:
                            time.sleep(backoff_s * (2 ** attempt))
            yield pdf.assign(__resp=resp, __call_err=err)

    called = work.mapInPandas(run, schema)
    parsed, perr = parse_response(F.col("__resp"))
    called = called.withColumn("__parsed", parsed) \
        .withColumn("__err", F.coalesce(F.col("__call_err"), perr))
    return flatten(called.drop("__payload", "__resp", "__call_err"), "__parsed", "__err",
                   F.col("__processed"), keep_prior).drop("__processed")


# ---- X4, X8-X12 --------------------------------------------------------------
def explode_pairs(df: DataFrame, response: str, keys: list[str]) -> DataFrame:
    """One row per replacement pair (position from 1); none -> no rows.

    ``posexplode_outer`` + a filter on the position: a plain ``posexplode``
    makes Catalyst infer ``size(pairs) > 0`` and push it below the
    projection, re-evaluating the whole rule extraction inside the filter.
    """
    return (df.select(*keys, F.posexplode_outer(F.col(response)["replacement_pairs"]).alias("pos", "pair"))
            .where(F.col("pos").isNotNull())
            .select(*keys, (F.col("pos") + 1).alias("pair_no"), "pair.old_part", "pair.new_part",
                    "pair.cue_phrase"))


def review_flag(df: DataFrame) -> Column:
    """Intent without a complete old/new pair needs a human."""
    return (F.col("replacement_intent") == 1) & (
        (F.coalesce(F.col("old_part"), F.lit("")) == "") |
        (F.coalesce(F.col("new_part"), F.lit("")) == ""))


def route(df: DataFrame, approve_at: float = 0.85) -> Column:
    """Failed / review / approve / skipped."""
    return (F.when(F.col("error").isNotNull(), F.lit("failed"))
            .when(F.col("replacement_intent").isNull(), F.lit("skipped"))
            .when(review_flag(df), F.lit("review"))
            .when(F.col("confidence") >= approve_at, F.lit("approve"))
            .otherwise(F.lit("review")))


def universe_check(extracted: DataFrame, universe: DataFrame, part_col: str) -> DataFrame:
    """Flag whether extracted old/new parts exist in the known universe (null: no part).

    Rows without parts, and those whose parts are certainly unknown, meet no
    join (:mod:`quarry.operators.membership`).
    """
    return known_keys(extracted, {"old_part": "old_known", "new_part": "new_known"}, Universe(universe, part_col))


def text_key(text_col: str) -> Column:
    """Identity of a comment for re-use: SHA-256 of its tag-stripped,
    whitespace-collapsed text.  JVM-only on purpose (no entity unescape), so
    keying every row never calls Python; texts that differ only in entity
    spelling are extracted once each, never merged wrongly."""
    return F.sha2(F.coalesce(TX.collapse_ws(TX.strip_tags(text_col)), F.lit("")), 256)


def incremental(df: DataFrame, prior: DataFrame, run: Callable[[DataFrame], DataFrame],
                text_col: str = "Comments") -> DataFrame:
    """X11: extract only texts not seen before, then join results back.

    ``prior`` holds ``text_key`` plus the seven output columns from earlier
    runs.  Texts are de-duplicated by key (hash aggregate: a comment repeated
    a million times is one call), anti-joined against ``prior``, sent to
    ``run`` and unioned with ``prior``; every input row then picks up its
    result by key.  Blank rows have no key, never reach ``run`` and get NULL
    results; of repeated rows of ``prior`` any one counts.
    """
    outs = [n for n, _ in OUTPUT_COLUMNS]
    prior = prior.dropDuplicates(["text_key"])
    keyed = df.where(~TX.is_blank(text_col)).withColumn("text_key", text_key(text_col))
    todo = (keyed
            .groupBy("text_key").agg(F.min(text_col).alias(text_col))
            .join(prior.select("text_key"), "text_key", "left_anti"))
    fresh = run(todo).select("text_key", *outs).withColumn("reused", F.lit(False))
    results = prior.select("text_key", *outs).withColumn("reused", F.lit(True)).unionByName(fresh)
    return _with_results(df, keyed, results, outs, text_col)


def _with_results(df: DataFrame, keyed: DataFrame, results: DataFrame, outs: list[str], text_col: str) -> DataFrame:
    """Every row with its result; blank rows are set aside, so they meet no join."""
    found = keyed.drop(*[c for c in outs if c in keyed.columns]).join(results, "text_key", "left")
    blank = df.where(TX.is_blank(text_col)).drop(*outs)
    return found.unionByName(blank, allowMissingColumns=True)


def resumable(df: DataFrame, results_path: str, run: Callable[[DataFrame], DataFrame],
              text_col: str = "Comments", buckets: int = 16) -> DataFrame:
    """X11 at backlog scale: extract new texts in hash buckets, appending each
    finished bucket to a results table, so a lost job resumes where it stopped.

    ``results_path`` lives on shared storage.  Each bucket is one distributed
    job (the loop runs over a fixed bucket count, never over data); texts
    already in the table are skipped, so re-running is idempotent and never
    pays for a model call twice.  Returns every input row joined to its result.
    """
    spark = df.sparkSession
    outs = [n for n, _ in OUTPUT_COLUMNS]
    schema = T.StructType([T.StructField("text_key", T.StringType())] +
                          [T.StructField(n, T.DataType.fromDDL(t)) for n, t in OUTPUT_COLUMNS])

    def done() -> DataFrame:
        if not path_exists(spark, results_path):      # any other read error must not look like "no results yet"
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(results_path).dropDuplicates(["text_key"])

    keyed = df.where(~TX.is_blank(text_col)).withColumn("text_key", text_key(text_col))
    # the new texts are written once by bucket, so the input is read and grouped once
    todo_path = scratch_path(spark, "new-texts")
    (keyed.groupBy("text_key").agg(F.min(text_col).alias(text_col))
     .join(done().select("text_key"), "text_key", "left_anti")
     .withColumn("bucket", F.pmod(F.xxhash64("text_key"), F.lit(buckets)).cast("int"))
     .write.partitionBy("bucket").parquet(todo_path))
    todo = spark.read.schema(f"text_key string, `{text_col}` string, bucket int").parquet(todo_path)
    for b in range(buckets):
        res = run(todo.where(F.col("bucket") == b).drop("bucket")).select("text_key", *outs)
        res.write.mode("append").parquet(results_path)
    return _with_results(df, keyed, done(), outs, text_col)


def scores(pred: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """Precision / recall / F1 per field in one aggregate.

    ``gold`` has ``key, gold_intent, gold_old, gold_new``.  A blank
    prediction never counts as a hit; a gold row without a prediction counts
    as a miss.  A ratio without a denominator is NULL.
    """
    j = gold.join(pred.select(key, "replacement_intent", "old_part", "new_part"), key, "left")
    nb = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    p_i = F.coalesce(F.col("replacement_intent"), F.lit(0)) == 1
    g_i = F.col("gold_intent") == 1
    fields = []
    for name, tp, fp, fn in [
        ("replacement_intent", p_i & g_i, p_i & ~g_i, ~p_i & g_i),
        ("old_part", nb("old_part") & (F.col("old_part") == F.col("gold_old")),
         nb("old_part") & ~F.coalesce(F.col("old_part") == F.col("gold_old"), F.lit(False)),
         nb("gold_old") & ~F.coalesce(F.col("old_part") == F.col("gold_old"), F.lit(False))),
        ("new_part", nb("new_part") & (F.col("new_part") == F.col("gold_new")),
         nb("new_part") & ~F.coalesce(F.col("new_part") == F.col("gold_new"), F.lit(False)),
         nb("gold_new") & ~F.coalesce(F.col("new_part") == F.col("gold_new"), F.lit(False))),
    ]:
        fields.append(F.struct(F.lit(name).alias("field"),
                               F.count_if(F.coalesce(tp, F.lit(False))).alias("tp"),
                               F.count_if(F.coalesce(fp, F.lit(False))).alias("fp"),
                               F.count_if(F.coalesce(fn, F.lit(False))).alias("fn")))
    agg = j.agg(F.array(*fields).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    p = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return agg.withColumn("precision", F.round(p, 4)).withColumn("recall", F.round(r, 4)) \
        .withColumn("f1", F.round(F.try_divide(2 * p * r, p + r), 4))


def rule_violations(df: DataFrame) -> DataFrame:
    """Confidence outside [0,1]; pairs present although intent is false."""
    rules = F.array(
        F.when((F.col("confidence") < 0) | (F.col("confidence") > 1), F.lit("confidence_out_of_range")),
        F.when((F.col("replacement_intent") == 0) &
               ((F.coalesce(F.col("old_part"), F.lit("")) != "") |
                (F.coalesce(F.col("new_part"), F.lit("")) != "")), F.lit("pair_without_intent")),
        F.when((F.col("replacement_intent") == 1) & F.col("old_part").isNotNull() &
               (F.col("old_part") == F.col("new_part")), F.lit("same_old_and_new")),
    )
    return df.withColumn("rule", F.explode(F.filter(rules, lambda x: x.isNotNull())))
