"""SQL sources (S2, S3, S5, S8): tables and queries of a database, and free query text.

A table is read by many tasks, by predicates over a whole-number column.  The
database itself says where to cut: one query for the column's range, one for
how many rows lie in equal slices of it, and again for slices that hold more
than a task's share, until they hold less or one key.  Slices are joined until
each predicate has about the same number of rows, so a column with gaps or
heaps of keys is still read evenly.  Columns and filters push down to the source as usual.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quarry.operators.tables import Tables

#: Opening and closing quotes of names by dialect.
QUOTES = {"spark": "``", "sqlserver": "[]", "ansi": '""'}
#: Slices of the key range that are counted for each read task.
SLICES_PER_TASK = 16

# a part of a name: quoted in any dialect (a doubled closing quote stands for one), or plain up to the next dot
_PART = re.compile(r"""\s*(?:\[((?:[^\]]|\]\])*)\]|"((?:[^"]|"")*)"|`((?:[^`]|``)*)`|([^.\[\]"`]+?))\s*(\.|$)""")


def split_name(raw: str) -> list[str]:
    """The one to three parts of a table name (catalogue, schema, table), without their quotes."""
    parts, at, more = [], 0, True
    while more:
        found = _PART.match(raw, at)
        if not found:
            raise ValueError(f"Not a table name: {raw!r}")
        for text, close in zip(found.groups()[:4], ("]", '"', "`", ""), strict=True):
            if text is not None:
                parts.append(text.replace(close * 2, close) if close else text)
        at, more = found.end(), found[5] == "."
    if len(parts) > 3 or at != len(raw) or not all(parts):
        raise ValueError(f"Not a table name: {raw!r}")
    return parts


def quote_part(part: str, style: str = "spark") -> str:
    opening, closing = QUOTES[style]
    return opening + part.replace(closing, closing * 2) + closing


def quote_ident(raw: str, style: str = "spark") -> str:
    """A table name of one to three parts, quoted for a dialect, whatever quotes it came with."""
    return ".".join(quote_part(p, style) for p in split_name(raw))


def run_sql(spark: SparkSession, text: str, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """S3: free SQL text over named DataFrames (registered as temp views)."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(text)


def _reader(spark: SparkSession, url: str, properties: dict[str, str] | None):
    r = spark.read.format("jdbc").option("url", url)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    return r


def read_jdbc(spark: SparkSession, url: str, table: str | None = None, query: str | None = None,
              properties: dict[str, str] | None = None, partition_column: str | None = None,
              lower_bound: int | None = None, upper_bound: int | None = None,
              num_partitions: int | None = None, quote: str | None = None) -> DataFrame:
    """A lazy JDBC table or query; filters and columns push down.

    ``quote`` names the dialect whose quotes the table name gets (None: it is
    passed on as given).  With ``partition_column`` and bounds the read is
    split into ``num_partitions`` equal ranges; :func:`read_table` finds column
    and ranges itself.
    """
    r = _reader(spark, url, properties)
    if query is not None:
        r = r.option("query", query)
    else:
        r = r.option("dbtable", quote_ident(table, quote) if quote else table)
    if partition_column:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower_bound)
             .option("upperBound", upper_bound).option("numPartitions", num_partitions or 8))
    df = r.load()
    return df.toDF(*[c.strip() for c in df.columns])


def _whole_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)
            or (isinstance(f.dataType, T.DecimalType) and f.dataType.scale == 0)]


def read_predicates(spark: SparkSession, url: str, table: str, columns: list[str], tasks: int,
                    properties: dict[str, str] | None = None, quote: str = "ansi") -> list[str]:
    """Predicates that share out a table's rows evenly, each row in exactly one; [] if no column tells rows apart.

    The column is the one of ``columns`` with the widest range.  All queries
    aggregate in the database; what comes back is one row, then at most
    ``tasks`` * SLICES_PER_TASK + 1 rows a query, whatever the size of the
    table.  Fewer than ``tasks`` slices are heavy at a time and each query cuts
    them in SLICES_PER_TASK, so a 64-bit range takes 16 queries at the worst.
    """
    name = quote_ident(table, quote)
    named = {c: quote_part(c, quote) for c in columns}
    if not columns:
        return []
    ranges = read_jdbc(spark, url, properties=properties, query="SELECT " + ", ".join(
        f"MIN({q}) AS lo{i}, MAX({q}) AS hi{i}" for i, q in enumerate(named.values())) + f" FROM {name}").first()
    span = {c: (int(ranges[2 * i]), int(ranges[2 * i + 1])) for i, c in enumerate(columns) if ranges[2 * i] is not None}
    if not span:
        return []
    column = max(span, key=lambda c: span[c][1] - span[c][0])
    (low, high), key = span[column], named[column]
    if high == low:
        return []
    todo, done, none = [(low, high + 1)], [], 0         # ranges [from, to) to be sliced; (from, rows) of finished slices
    total = None
    while todo:
        slices = tasks * SLICES_PER_TASK if total is None else SLICES_PER_TASK
        width = [(b - a - 1) // slices + 1 for a, b in todo]
        which = "CASE " + " ".join(f"WHEN {key} >= {a} AND {key} < {b} THEN {k * slices} + ({key} - {a}) / {w}"
                                   for k, ((a, b), w) in enumerate(zip(todo, width, strict=True))) + " END"
        counted = read_jdbc(spark, url, properties=properties, query=(
            f"SELECT slice, COUNT(*) AS n FROM (SELECT {which} AS slice FROM {name}"
            + (f" WHERE {' OR '.join(f'({key} >= {a} AND {key} < {b})' for a, b in todo)}" if total is not None else "")
            + ") s GROUP BY slice")).collect()
        rows = {None if r[0] is None else int(r[0]): int(r[1]) for r in counted}
        if total is None:
            none = rows.pop(None, 0)
            total = sum(rows.values())
        heavy = []
        for s, n in rows.items():
            (a, b), w = todo[s // slices], width[s // slices]
            start = a + s % slices * w
            if n * tasks > total and w > 1:
                heavy.append((start, min(start + w, b)))
            else:
                done.append((start, n))
        todo = heavy
    cuts, filled, goal = [], 0, total / tasks
    for start, n in sorted(done):
        if filled and filled + n > goal * (len(cuts) + 1) and len(cuts) < tasks - 1:
            cuts.append(start)
        filled += n
    edges = [None, *cuts, None]
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        both = [f"{key} >= {a}"] if a is not None else []
        both += [f"{key} < {b}"] if b is not None else []
        out.append(" AND ".join(both) or f"{key} IS NOT NULL")
    return out + ([f"{key} IS NULL"] if none else [])


def read_table(spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None,
               partition_column: str | None = None, tasks: int = 8, quote: str = "ansi") -> DataFrame:
    """A lazy table read by ``tasks`` parallel queries of about equal size.

    ``partition_column`` is a whole-number column (default: the one with the
    widest range); rows where it is null are read by a query of their own.  A
    table without such a column is read by one task.
    """
    probe = read_jdbc(spark, url, table, properties=properties, quote=quote)
    raw = _reader(spark, url, properties).option("dbtable", quote_ident(table, quote)).load()
    columns = [partition_column] if partition_column else _whole_columns(raw)
    predicates = read_predicates(spark, url, table, columns, tasks, properties, quote)
    if len(predicates) < 2:
        return probe
    df = spark.read.jdbc(url, quote_ident(table, quote), predicates=predicates, properties=properties or {})
    return df.toDF(*probe.columns)


def load_sql_tables(spark: SparkSession, url: str, tables: list[str], properties: dict[str, str] | None = None,
                    tasks: int = 8, quote: str = "ansi", partition_columns: dict[str, str] | None = None) -> Tables:
    """S2 in the catalogue: every named table or view, role ``primary``, under the last part of its name.

    Two tables with the same last part are refused.
    """
    out = Tables(spark)
    for table in tables:
        name = split_name(table)[-1].strip()
        if name in out.names():
            raise ValueError(f"Two tables are called {name!r}")
        out.register(name, read_table(spark, url, table, properties, (partition_columns or {}).get(table), tasks, quote),
                     role="primary")
    return out
