"""Value resolution against a column's values (R3) and in bulk.

R3 runs at most three small aggregate jobs, each a partial+final hash
aggregate that returns one row:

1. exact / case-insensitive hit (and the set of case variants, which lets
   the later filter be a pushed-down ``IN``);
2. only on a miss: distinct lower-cased values, cut by the exact length
   bound of the cutoff, the best of each Arrow batch, reduced with
   ``max(struct(score, value))`` (ties go to the larger value, as in difflib);
3. the case variants of the winner.

Nothing but the winning value travels to the driver.  With a stored
dictionary (:mod:`quarry.operators.value_dictionary`) these jobs read its
values, and the table itself is read once, by the query.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.names import col
from quarry.functions.similarity import CUTOFF, NotFound
from quarry.functions.values import all_midnight, as_text
from quarry.operators.close_cells import best_in_cell, best_matches
from quarry.session import ensure_checkpoint_dir, materialize


@dataclass
class Resolution:
    value: str
    kind: str            # exact | case | fuzzy
    score: float
    variants: list[str] = field(default_factory=list)


def length_bound(la: Column, lb: Column, cutoff: float = CUTOFF) -> Column:
    """Native pre-filter: the best score two strings of these lengths can reach."""
    return (F.least(la, lb) * 2.0) >= (la + lb) * F.lit(cutoff)


def _best_of_batches(needle: str, cutoff: float):
    def run(batches):
        for pdf in batches:
            left = pd.DataFrame({"needle": [needle], "ln": [needle]})
            best = best_in_cell(left, pdf.assign(lv=pdf["cand"], canon=pdf["cand"]), cutoff)
            yield best.rename(columns={"lv": "cand"})[["cand", "score"]]
    return run


# Case variants of one value are collected only when their (measured) count
# is at most this; beyond it the filter compares lower-cased text instead.
MAX_VARIANTS = 256


def _variants(vals: DataFrame, low: str, n_var: int) -> list[str] | None:
    if n_var == 0:
        return []
    if n_var > MAX_VARIANTS:
        return None
    return sorted(r["v"] for r in vals.where(F.lower("v") == F.lit(low)).distinct().collect())


def resolve_value(df: DataFrame, column: str, needle: str,
                  cutoff: float = CUTOFF, label: str = "Value") -> Resolution:
    """Resolve ``needle`` against the non-null text values of ``column``.

    ``variants`` lists every spelling that lower-cases to the winner when
    there are at most ``MAX_VARIANTS`` of them (the filter then becomes a
    pushed-down ``IN``); it is None when there are more.
    """
    dtype = df.schema[column].dataType
    v = as_text(col(column), dtype, all_midnight(df, column))
    vals = df.select(v.alias("v")).where(F.col("v").isNotNull())
    low = needle.lower()
    hit = F.when(F.lower("v") == F.lit(low), F.col("v"))
    row = vals.agg(
        F.max(F.when(F.col("v") == F.lit(needle), F.lit(1))).alias("exact"),
        F.count_distinct(hit).alias("n_var"), F.max(hit).alias("last")).first()
    if row["exact"] or row["n_var"]:
        variants = _variants(vals, low, row["n_var"])
        if row["exact"]:
            return Resolution(needle, "exact", 1.0, variants)
        return Resolution(row["last"], "case", 1.0, variants)

    n = len(low)
    cands = vals.select(F.lower("v").alias("cand")).distinct().where(length_bound(F.length("cand"), F.lit(n), cutoff))
    scored = cands.mapInPandas(_best_of_batches(low, cutoff), "cand string, score double")
    best = scored.agg(F.max(F.struct("score", "cand")).alias("b")).first()["b"]
    if best is None:
        sample = [r["v"] for r in vals.distinct().orderBy("v").limit(20).collect()]
        raise NotFound(f"{label} '{needle}' not found. Available (first 20): {sample}")
    hit = F.when(F.lower("v") == F.lit(best["cand"]), F.col("v"))
    row = vals.agg(F.count_distinct(hit).alias("n_var"), F.max(hit).alias("last")).first()
    return Resolution(row["last"], "fuzzy", float(best["score"]),
                      _variants(vals, best["cand"], row["n_var"]))


def bulk_resolve(needles: DataFrame, needle_col: str, dictionary: DataFrame,
                 value_col: str, cutoff: float = CUTOFF,
                 cell_rows: int = 2_000) -> DataFrame:
    """Resolve many needles against one dictionary column.

    Output: ``needle, resolved, match_kind, score`` (NULL resolved = no match).

    1. distinct needles left-joined to the dictionary on ``lower(value)``
       and reduced per needle: exact hit, else the case variant (largest
       spelling, deterministic);
    2. only needles without either go to the similarity join: both sides
       keyed by candidate length (needles fan out over the window their
       length allows), every length split into a grid of bounded cells; a
       cell bounds the scores of all its pairs at once, scores the few that
       remain and emits one candidate per needle
       (:mod:`quarry.operators.close_cells`); a hash aggregate keeps the top-1.

    The intermediate tables are written once to the shared scratch folder
    (``spark.checkpoint.dir``) because each feeds two branches.
    """
    ensure_checkpoint_dir(needles.sparkSession)
    nd = needles.select(col(needle_col).cast("string").alias("needle")) \
        .where(F.col("needle").isNotNull()).distinct()
    dl = (dictionary.select(col(value_col).cast("string").alias("value"))
          .where(F.col("value").isNotNull())
          .groupBy(F.lower("value").alias("lv")).agg(F.max("value").alias("canon")))
    dl = materialize(dl, "resolve-dict")
    # distinct values: a value repeated a billion times meets its needle once
    dv = (dictionary.select(col(value_col).cast("string").alias("value")).where(F.col("value").isNotNull())
          .distinct().withColumn("__lv", F.lower("value")))
    first = (nd.join(dv, F.lower(nd["needle"]) == dv["__lv"], "left")
             .groupBy("needle")
             .agg(F.max(F.when(F.col("value") == F.col("needle"), F.col("value"))).alias("exact"),
                  F.max("value").alias("case")))
    first = materialize(first, "resolve-first")
    found = first.where(F.col("case").isNotNull()).select(
        "needle", F.coalesce("exact", "case").alias("resolved"),
        F.when(F.col("exact").isNotNull(), F.lit("exact")).otherwise(F.lit("case")).alias("match_kind"),
        F.lit(1.0).alias("score"))
    rest = first.where(F.col("case").isNull()).select("needle", F.lower("needle").alias("ln"))
    scored = _grid_length_join(rest, dl, cutoff, cell_rows)
    best = scored.groupBy("needle").agg(F.max(F.struct("score", "lv", "canon")).alias("b"))
    fuzzy = rest.join(best, "needle", "left").select(
        "needle", F.col("b.canon").alias("resolved"),
        F.when(F.col("b").isNotNull(), F.lit("fuzzy")).otherwise(F.lit("none")).alias("match_kind"),
        F.col("b.score").alias("score"))
    return found.unionByName(fuzzy)


def _grid_length_join(rest: DataFrame, dl: DataFrame, cutoff: float,
                      cell_rows: int) -> DataFrame:
    """Similarity join on length windows, split into a grid of bounded cells.

    A needle of length ``n`` can only reach the cutoff against candidates
    whose length lies in ``[n*c/(2-c), n*(2-c)/c]``.  Both sides are keyed by
    candidate length; each length is split into ``needle buckets x
    candidate buckets`` so no cell holds more than about ``cell_rows`` rows
    per side however skewed the lengths are.
    """
    cand = dl.withColumn("len", F.length("lv"))
    ln = F.length("ln")
    # one wider on both sides: the rounded bounds must not lose a score that equals the cutoff
    lo = F.greatest(F.ceil(ln * cutoff / (2.0 - cutoff)) - 1, F.lit(1)).cast("int")
    hi = F.floor(ln * (2.0 - cutoff) / cutoff).cast("int") + 1
    nd = rest.withColumn("len", F.explode(F.sequence(lo, hi)))

    return best_matches(nd, cand, ["len"], cutoff, cell_rows)


__all__ = ["Resolution", "resolve_value", "bulk_resolve", "length_bound", "NotFound"]
