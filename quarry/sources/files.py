"""File sources (S1, S4-S6): single files and folder catalogues."""

from __future__ import annotations

# Fixed value: the table names of a test-data directory.
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


import re  # noqa: E402
from dataclasses import dataclass  # noqa: E402

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

# Fixed value: a batch output stem starts with at least 8 digits and "_".
_PRIMARY = re.compile(r"^\d{8,}_")
_FORMATS = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".orc": "orc"}


@dataclass
class Entry:
    table: str
    path: str
    fmt: str
    role: str


def _list(spark: SparkSession, path: str) -> list[tuple[str, str, bool]]:
    """(name, full path, is_dir) of one folder level via the Hadoop FileSystem API."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    out = [(s.getPath().getName(), s.getPath().toString(), s.isDirectory()) for s in fs.listStatus(p)]
    return sorted(out)


def _fmt_of_dir(spark: SparkSession, path: str) -> str | None:
    for name, _, is_dir in _list(spark, path):
        if not is_dir:
            for ext, fmt in _FORMATS.items():
                if name.endswith(ext) or (fmt == "parquet" and name.endswith(".snappy.parquet")):
                    return fmt
    return None


def catalogue(spark: SparkSession, folder: str) -> list[Entry]:
    """The tables of a folder, one per file or dataset directory.

    Names starting with ``~$``, ``_`` or ``.`` are skipped (lock files,
    markers).  A directory of dataset directories is a workbook: each inner
    directory is a sheet, named ``<stem>__<sheet>`` when there are several.
    Role: ``primary`` for ``\\d{8,}_`` stems, else ``supplemental``.
    Listing is metadata on the driver; data stays lazy.
    """
    entries: list[Entry] = []
    for name, full, is_dir in _list(spark, folder):
        if name.startswith(("~$", "_", ".")):
            continue
        stem, ext = (name, "") if is_dir else (name.rsplit(".", 1)[0], "." + name.rsplit(".", 1)[-1])
        role = "primary" if _PRIMARY.match(stem) else "supplemental"
        if not is_dir:
            if ext.lower() in _FORMATS:
                entries.append(Entry(stem, full, _FORMATS[ext.lower()], role))
            continue
        fmt = _fmt_of_dir(spark, full)
        if fmt:
            entries.append(Entry(stem, full, fmt, role))
            continue
        sheets = [(n, p) for n, p, d in _list(spark, full) if d and not n.startswith(("_", "."))]
        for sheet, sp in sheets:
            sfmt = _fmt_of_dir(spark, sp)
            if sfmt:
                entries.append(Entry(f"{stem}__{sheet}" if len(sheets) > 1 else stem, sp, sfmt, role))
    return entries


def read_entry(spark: SparkSession, e: Entry) -> DataFrame:
    """One lazy reader per entry; CSV/JSON get a header and inferred types."""
    r = spark.read.format(e.fmt)
    if e.fmt == "csv":
        r = r.option("header", "true").option("inferSchema", "true")
    return r.load(e.path)


def load_folder(spark: SparkSession, folder: str, kind: str = "files"):
    """Register every table of a folder in a new :class:`Tables`."""
    from quarry.operators.tables import Tables
    if kind.lower() != "files":
        raise ValueError(f"Unknown source kind: {kind!r}")
    t = Tables(spark)
    for e in catalogue(spark, folder):
        t.register(e.table, read_entry(spark, e), role=e.role)
    return t
