"""X1/X11 on a stream: a paid model is asked once per distinct text, whatever is lost or repeated.

Every micro-batch writes its rows, takes the texts that no earlier call has
answered, and calls the model for at most ``budget`` of them; the rest waits in
a list that the next micro-batch takes over.  A task writes the answers of each
small group of calls to the ledger as soon as it has them, so a stream that is
killed between calls and write, or a batch that runs again, finds them there
and repeats none; only a group in flight can be asked twice.

Folders under ``home``: ``calls`` (the ledger: text_key, response, call_error),
``rows`` (the stream's rows with their keys, a folder per batch) and ``waiting``
(texts over the budget, a folder per batch).  A batch that runs again rewrites
its own folders, so nothing is counted twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as TX
from quarry.functions.names import col
from quarry.operators import extract as X
from quarry.session import path_exists

LEDGER = "text_key string, response string, call_error string"


def _store(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path, in tasks; Hadoop writes ``file:/x`` for ``file:///x``."""
    if path.startswith(("file:", "/")):
        return pa.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(path)


class ModelStream:
    """The state of one stream of model calls under ``home``, on storage that all executors share."""

    def __init__(self, spark: SparkSession, home: str, make_extractor: Callable[[], X.Extractor], text_col: str = "Comments",
                 budget: int | None = None, partitions: int = 4, group: int = 8):
        """``budget``: calls per micro-batch, shared by its tasks (None: no bound); ``partitions``: concurrent callers;
        ``group``: texts whose answers are written together."""
        self.spark, self.home, self.make, self.text_col = spark, home.rstrip("/"), make_extractor, text_col
        self.budget, self.partitions, self.group = budget, partitions, group

    def _table(self, name: str, schema) -> DataFrame:
        if not path_exists(self.spark, f"{self.home}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.home}/{name}")

    def calls(self) -> DataFrame:
        """The ledger, one row per text; of a text that was asked twice any answer counts, an answer before an error."""
        return (self._table("calls", LEDGER).groupBy("text_key")
                .agg(F.min(F.struct(F.col("response").isNull().alias("failed"), "response", "call_error")).alias("c"))
                .select("text_key", "c.response", "c.call_error"))

    def _ask(self, todo: DataFrame) -> None:
        """Call the model for (text_key, text) and write every answer to the ledger."""
        make, size, ledger = self.make, self.group, f"{self.home}/calls"     # on storage that all executors share

        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            store, root = _store(ledger)
            store.create_dir(root, recursive=True)
            call = make()
            for pdf in batches:
                for start in range(0, len(pdf), size):
                    some = pdf.iloc[start:start + size]
                    try:
                        answers = call(some["payload"].tolist())
                        if len(answers) != len(some):
                            raise RuntimeError("extractor returned a wrong number of results")
                        errors = [str(a) if isinstance(a, BaseException) else "No tool call returned" if a is None else None
                                  for a in answers]
                        answers = [a if e is None else None for a, e in zip(answers, errors)]
                    except Exception as exc:  # noqa: BLE001 - recorded per row, as in the batch job
                        answers, errors = [None] * len(some), [str(exc)] * len(some)
                    done = pa.table({"text_key": some["text_key"].tolist(), "response": pa.array(answers, pa.string()),
                                     "call_error": pa.array(errors, pa.string())})
                    # whole or not at all: written aside, then moved into the ledger
                    name = uuid.uuid4().hex
                    pa.parquet.write_table(done, f"{root}/_{name}.tmp", filesystem=store)
                    store.move(f"{root}/_{name}.tmp", f"{root}/{name}.parquet")
                    yield pd.DataFrame({"n": [len(some)]})

        todo.repartition(self.partitions, "text_key").mapInPandas(run, "n long").agg(F.sum("n")).collect()

    def _take(self, fresh: DataFrame, batch: int) -> None:
        """Ask for what ``fresh`` (text_key, payload) and the waiting list hold and the ledger lacks, up to the budget."""
        before = self._table(f"waiting/batch={batch - 1}", "text_key string, payload string")
        todo = (fresh.unionByName(before).groupBy("text_key").agg(F.min("payload").alias("payload"))
                .join(self.calls().select("text_key"), "text_key", "left_anti"))
        target = f"{self.home}/waiting/batch={batch}"
        todo.write.mode("overwrite").parquet(target)
        todo = self.spark.read.schema("text_key string, payload string").parquet(target)
        self._ask(todo if self.budget is None else todo.orderBy("text_key").limit(self.budget))
        # the list of the batch shrinks only when the next one takes it over: until then the ledger says what is done

    def process(self, rows: DataFrame, batch: int) -> None:
        """One micro-batch (for ``foreachBatch``)."""
        keyed = rows.withColumn("text_key", F.when(~TX.is_blank(col(self.text_col)), X.text_key(col(self.text_col))))
        target = f"{self.home}/rows/batch={batch}"
        keyed.write.mode("overwrite").parquet(target)
        keyed = self.spark.read.schema(keyed.schema).parquet(target)
        fresh = keyed.where("text_key IS NOT NULL").groupBy("text_key").agg(F.min(col(self.text_col)).alias("text"))
        fresh = fresh.join(self.calls().select("text_key"), "text_key", "left_anti")
        self._take(fresh.select("text_key", TX.prompt_payload(TX.clean_text("text")).alias("payload")), batch)

    def run(self, stream: DataFrame, checkpoint: str, name: str = "model_stream") -> None:
        """Take everything available now; later runs with the same checkpoint go on from there."""
        q = (stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).queryName(name).start())
        q.awaitTermination()

    def waiting(self) -> int:
        """Distinct texts that still have no answer, for want of budget or because their call failed on the way."""
        rows = self._all_rows()
        if rows is None:
            return 0
        keys = rows.where("text_key IS NOT NULL").select("text_key").distinct()
        return keys.join(self.calls().select("text_key"), "text_key", "left_anti").count()

    def catch_up(self) -> int:
        """Ask for waiting texts, up to the budget; returns how many still wait."""
        rows = self._all_rows()
        if rows is not None:
            keys = rows.where("text_key IS NOT NULL").groupBy("text_key").agg(F.min(col(self.text_col)).alias("text"))
            todo = keys.join(self.calls().select("text_key"), "text_key", "left_anti").select(
                "text_key", TX.prompt_payload(TX.clean_text("text")).alias("payload"))
            self._ask(todo if self.budget is None else todo.orderBy("text_key").limit(self.budget))
        return self.waiting()

    def _all_rows(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.home}/rows").drop("batch") if path_exists(self.spark, f"{self.home}/rows") else None

    def results(self) -> DataFrame | None:
        """Every row so far with the output columns of the batch job; a text without an answer yet has nulls."""
        rows = self._all_rows()
        if rows is None:
            return None
        found = rows.join(self.calls(), "text_key", "left")
        parsed, error = X.parse_response(F.col("response"))
        asked = F.col("text_key").isNotNull() & (F.col("response").isNotNull() | F.col("call_error").isNotNull())
        found = (found.withColumn("__asked", asked).withColumn("__parsed", parsed)
                 .withColumn("__err", F.when(F.col("__asked"), F.coalesce("call_error", error))))
        return X.flatten(found.drop("response", "call_error"), "__parsed", "__err", F.col("__asked")).drop("__asked", "text_key")
