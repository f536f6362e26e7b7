"""Summaries of a table of files, refreshed by new files only.

A summary can be merged (counts add up, sketches unite), so a refresh reads only
files that it has not read before: a table that grows by a file a day costs one
file a day, and a question is answered from the summary alone.

Layout under ``root``: a folder per summary, in it one folder per generation
with ``values`` (the summary's rows, batch) and ``files`` (path, length, time,
batch).  A batch counts once its files are listed, so a refresh that dies
half-way leaves nothing behind that is read.  A file that changed or went away,
or too many batches, start a new generation; the newest complete one is named
by the file ``current``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import path_exists

#: Batches after which a summary is written anew in one piece.
MAX_BATCHES = 32


def list_files(spark: SparkSession, paths: list[str]) -> dict[str, tuple[int, int]]:
    """(length, modification time) of every file, by path; ``paths`` are URIs, as ``inputFiles`` gives them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = {}
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))
        status = target.getFileSystem(conf).getFileStatus(target)
        out[status.getPath().toString()] = (int(status.getLen()), int(status.getModificationTime()))
    return out


class FileSummary:
    """A summary of a table of files: what ``summarise`` makes of some files, merged by ``merge``.

    ``files()`` names the table's files now, ``read(files)`` reads some of them.
    """

    #: Columns of the summary.
    schema: str

    def __init__(self, spark: SparkSession, root: str, name: str, files: Callable[[], list[str]],
                 read: Callable[[list[str]], DataFrame]):
        self.spark, self.files, self.read = spark, files, read
        self.home = f"{root.rstrip('/')}/{hashlib.sha256(name.encode()).hexdigest()[:24]}"

    def summarise(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError

    def merge(self, parts: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _current(self, generation: str | None = None) -> str | None:
        """The folder of the newest complete generation; with an argument: make that the newest."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.home}/current")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if generation is not None:
            out = fs.create(path, True)
            out.writeBytes(generation)
            out.close()
        elif not fs.exists(path):
            return None
        else:
            stream = fs.open(path)
            generation = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
        return f"{self.home}/{generation}"

    def _known(self, folder: str | None) -> dict[str, tuple[int, int, str]]:
        if folder is None or not path_exists(self.spark, f"{folder}/files"):
            return {}
        rows = self.spark.read.schema("path string, length long, time long, batch string").parquet(f"{folder}/files").collect()
        return {r.path: (r.length, r.time, r.batch) for r in rows}

    def _write(self, folder: str, values: DataFrame, listed: dict[str, tuple[int, int]]) -> None:
        batch = uuid.uuid4().hex
        values.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{folder}/values")
        self.spark.createDataFrame([(p, *s, batch) for p, s in listed.items()],
                                   "path string, length long, time long, batch string") \
            .coalesce(1).write.mode("append").parquet(f"{folder}/files")

    def _stored(self, folder: str, known: dict) -> DataFrame:
        batches = sorted({b for _, _, b in known.values()})             # at most MAX_BATCHES + 1
        return self.merge(self.spark.read.schema(f"{self.schema}, batch string").parquet(f"{folder}/values")
                          .where(F.col("batch").isin(batches)).drop("batch"))

    def refresh(self) -> int:
        """Bring the summary up to date; returns how many of the table's files were read."""
        folder = self._current()
        known, now = self._known(folder), list_files(self.spark, self.files())
        fresh = {p: s for p, s in now.items() if p not in known}
        if folder is None or any(now.get(p) != (length, time) for p, (length, time, _) in known.items()):
            generation = uuid.uuid4().hex
            if now:
                self._write(f"{self.home}/{generation}", self.summarise(self.read(sorted(now))), now)
            self._current(generation)
            return len(now)
        if fresh:
            self._write(folder, self.summarise(self.read(sorted(fresh))), fresh)
            known = self._known(folder)
        if len({b for _, _, b in known.values()}) > MAX_BATCHES:
            generation = uuid.uuid4().hex
            self._write(f"{self.home}/{generation}", self._stored(folder, known), now)
            self._current(generation)
        return len(fresh)

    def values(self) -> DataFrame:
        """The merged summary, as of the last refresh."""
        folder = self._current()
        known = self._known(folder)
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self._stored(folder, known)
