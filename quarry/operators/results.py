"""Result shaping (P1-P6): paging, Markdown chunks, repeat removal, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.names import col
from quarry.functions.values import as_text
from quarry.operators.ordinal import with_ordinal

# Rows per chunk and the inline-row limit of the base tool.
CHUNK_ROWS = 60
INLINE_LIMIT = 200


def page(df: DataFrame, order: list[str | Column], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``rn, chunk_id, row_from, row_to, total`` for every row (1-based).

    A data column that has one of these names is kept as ``<name>_data``.
    """
    added = ["rn", "chunk_id", "row_from", "row_to", "total"]
    o = with_ordinal(df, order, "__rn", total="__total")
    o = o.withColumnsRenamed({c: f"{c}_data" for c in added if c in df.columns})
    o = o.withColumnsRenamed({"__rn": "rn", "__total": "total"})
    return (o.withColumn("chunk_id", F.floor((F.col("rn") - 1) / chunk_rows).cast("long"))
            .withColumn("row_from", F.col("chunk_id") * chunk_rows + 1)
            .withColumn("row_to", F.least((F.col("chunk_id") + 1) * chunk_rows, F.col("total"))))


def markdown_chunks(df: DataFrame, order: list[str | Column],
                    chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """P1+P2: one Markdown table per chunk, nulls blank, header ``Rows a–b of n``.

    Each group holds at most ``chunk_rows`` rows, so the ordered
    ``collect_list`` per chunk is bounded.
    """
    cols = df.columns
    cells = [F.coalesce(as_text(F.col(f"`{c}`"), df.schema[c].dataType), F.lit("")) for c in cols]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    p = page(df.withColumn("__line", line), order, chunk_rows)
    head = "| " + " | ".join(cols) + " |\n|" + "|".join([" --- "] * len(cols)) + "|"
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "__line"))),
                                    lambda x: x["__line"]), "\n")
    return (p.groupBy("chunk_id", "row_from", "row_to", "total").agg(body.alias("__rows"))
            .select("chunk_id", "row_from", "row_to", "total",
                    F.concat(F.lit("**Rows "), F.col("row_from").cast("string"), F.lit("–"),
                             F.col("row_to").cast("string"), F.lit(" of "),
                             F.col("total").cast("string"), F.lit("**\n\n" + head + "\n"),
                             F.col("__rows")).alias("body")))


def drop_repeats(df: DataFrame, value_col: str, order: list[str]) -> DataFrame:
    """Keep the first row (in ``order``) of each distinct value.

    A hash aggregate with ``min(struct(order..., rest...))``: partial
    aggregation collapses a value repeated a billion times map-side, so a
    hot value never lands whole in one task.
    """
    rest = [c for c in df.columns if c != value_col and c not in order]
    first = F.min(F.struct(*[col(c) for c in order + rest])).alias("__first")
    return df.groupBy(col(value_col)).agg(first).select(
        *[F.col("__first")[c].alias(c) for c in order + rest], col(value_col))


def status_sentence(part: Column | str, status: Column | str, details: Column | str) -> Column:
    """P4, one row: ``Part X has a status of “S”.`` plus details when useful."""
    of = lambda c: F.col(c) if isinstance(c, str) else c
    d = F.trim(F.regexp_replace(F.coalesce(of(details).cast("string"), F.lit("")),
                                r"^[\s\x85\xa0]+|[\s\x85\xa0]+$", ""))
    base = F.concat(F.lit("Part "), F.coalesce(of(part).cast("string"), F.lit("Unknown PartNumber")),
                    F.lit(" has a status of “"),
                    F.coalesce(of(status).cast("string"), F.lit("Unknown Status")), F.lit("”."))
    return F.when((d != "") & (F.lower(d) != "nan"),
                  F.concat(base, F.lit(" Additional details: "), d)).otherwise(base)


def answer(df: DataFrame, keys: list[str], sentence: str) -> DataFrame:
    """P4, per request (one request per key group): sentence for one row,
    a count message for several.  One aggregate, no driver round trip."""
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(
        F.when(n == 1, F.min(sentence))
        .otherwise(F.concat(n.cast("string"),
                            F.lit(" records match your request. The full results are shown below.")))
        .alias("answer"), n.alias("n_rows"))


def answer_requests(requests: DataFrame, rows: DataFrame, keys: list[str], sentence: str,
                    inline_limit: int | None = None) -> DataFrame:
    """P4 for every request: one column ``answer`` and ``n_rows``, whatever the outcome.

    A request asks for the ``rows`` with its ``keys``.  One row: its sentence;
    more than ``inline_limit``: the answer for a generated file; several: the
    count; none (also for a null key): no data.  Rows are counted per key
    first, so a request meets one row and a key asked for a billion times is
    an equi-join with one row a key.
    """
    n = F.count(F.lit(1))
    found = rows.groupBy(*[col(k).alias(f"__{i}") for i, k in enumerate(keys)]).agg(
        n.alias("__n"), F.min(col(sentence)).alias("__sentence"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & (col(k) == F.col(f"__{i}"))
    out = requests.join(found, on, "left").withColumn("n_rows", F.coalesce("__n", F.lit(0)))
    file = F.lit(False) if inline_limit is None else F.col("n_rows") > inline_limit
    text = (F.when(F.col("n_rows") == 0, F.lit("No data was returned."))
            .when(F.col("n_rows") == 1, F.col("__sentence"))
            .when(file, F.lit("The requested file has been generated."))
            .otherwise(F.concat(F.col("n_rows").cast("string"),
                                F.lit(" records match your request. The full results are shown below."))))
    return out.withColumn("answer", text).drop("__n", "__sentence", *[f"__{i}" for i in range(len(keys))])


def no_rows_message(df: DataFrame) -> str | None:
    """``"No rows matched."`` for an empty result (one-row probe), else None."""
    return "No rows matched." if df.isEmpty() else None


def summary(df: DataFrame, table: str) -> DataFrame:
    """One row ``table, total, columns``."""
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(table).alias("table_name"), "total",
        F.lit(", ".join(df.columns)).alias("columns"))


def inline_or_export(df: DataFrame, limit: int | None = INLINE_LIMIT) -> str:
    """K4: ``inline`` when at most ``limit`` rows, else ``export``.

    Probes ``limit + 1`` rows only; never counts the whole result.
    """
    if limit is None:
        return "inline"
    return "export" if df.limit(limit + 1).count() > limit else "inline"
