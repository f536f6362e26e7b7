"""A training-data pipeline over ``documents``: five stages, each by one of the operators.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one
before kept.  All stages but the last return the columns of ``docs``; the
result of each is written as Parquet under ``spark.checkpoint.dir`` and read
again, so a lost executor never repeats an earlier stage.  What a stage wrote on
the way, and the result of the stage before, go once its own result is written.

In every stage a null text stays null and a null id stays: neither is a
duplicate, a leak or toxic (a toxic text goes whatever its id).  Repeated rows
are each judged like one row; rows that share an id are dropped together by
near_dedup if one of them is, for it decides on ids.  Ties go to the smaller
id.  Other columns pass through unchanged whatever their names, and an empty
table stays empty with its columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import bm25_wand, duck_bpe, hamming_minhash, line_winnow, zstd_toxicity
from quarry.llm.common import split_members, table
from quarry.session import discard, settle, ship_package

SHINGLE_WORDS = 2       # near duplicates by the rule of operator 7: two-word shingles, similarity 0.8 or more


def toxicity(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that score as toxic (0.5 or more); the model learns from the labelled rows of docs."""
    ship_package(spark)
    return zstd_toxicity.keep_ordinary(docs, zstd_toxicity.train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated line runs; a document that loses all its words goes. ``n_chars`` follows the text."""
    ship_package(spark)
    # the operator's own columns must not replace data columns of those names
    aside = {c: f"__data_{c}" for c in docs.columns if c.lower() in ("n_removed", "removed_words")}
    cut = line_winnow.dedup_lines(docs.withColumnsRenamed(aside))
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = cut.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
                             .cast(docs.schema["n_chars"].dataType))
    return cut.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each component of near duplicates."""
    ship_package(spark)
    found = hamming_minhash.near_duplicates(docs, n=SHINGLE_WORDS, num=80, den=100)
    gone = found.where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    # texts that certainly stay are not moved
    some, rest = split_members(docs, "doc_id", gone.select(F.col("__gone").alias("doc_id")))
    return some.join(gone.hint("merge"), some["doc_id"] == gone["__gone"], "left_anti").unionByName(rest)


def decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    ship_package(spark)
    return bm25_wand.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text that is left.

    The word cache is half its default: here executors still hold what the earlier stages grew to.
    """
    ship_package(spark)
    return duck_bpe.encode(docs, *duck_bpe.public_ranks(), max_words=duck_bpe.MAX_WORDS // 2)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontaminate", decontaminate), ("encode", encode)]

#: No stage but the joins is expressible in SQL (dictionaries, winnowing, signatures, BM25, BPE).
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done = settle(lambda: stage(spark, docs, sf_dir), f"pipeline-{name}")     # leaves the stage's result alone
        discard(docs)
        docs = done
    return docs
