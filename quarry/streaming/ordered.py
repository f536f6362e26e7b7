"""E2 in event-time order: consecutive-duplicate suppression over files that arrive out of order.

Rows of a conversation wait in a small buffer until the watermark (greatest
event time seen, less ``lateness``) has passed them, then leave in order of
(event time, tiebreak) and meet the batch rule
(:func:`quarry.operators.events.consecutive_dedup`).  So any order of arrival
within ``lateness`` gives the batch result, over any number of triggers.

State: the rows of the last ``lateness`` of event time, one timer per bucket,
and per conversation the last row that left (its place and id).  A row that
belongs before a row of its conversation that has left comes too late: no rule
can be applied to it any more, so it goes out with ``late`` set, uncompared, and
changes no state.  Rows that are behind the watermark but after everything that
has left are still in order and are not late.  Rows with an empty id or without
a conversation pass at once; they are never compared.

Conversations share ``BUCKETS`` buckets by hash.  Rows move to the stateful step,
wait there and leave it as packed Arrow tables of one bucket, so a step costs a
few calls per bucket and trigger, not some per row.

The watermark column is a copy that is dropped before the stateful step:
Spark then leaves the decision on late rows to the rule above instead of
dropping them unseen.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from quarry.session import scratch_path
from quarry.streaming.runner import run_available

#: Event time of the row that ends a stream; no data may reach it.
END = "9999-12-31 00:00:00"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of conversations in state; a checkpoint holds for one number only.
BUCKETS = 512
#: A task packs about so many rows or bytes at a time; a packed table has at most ``SLICE_ROWS`` rows.
PACK_ROWS, PACK_BYTES, SLICE_ROWS = 1 << 18, 32 << 20, 1 << 16


def _codec():
    """(pack, unpack): a table as Arrow streams of at most ``SLICE_ROWS`` rows, and back.

    Functions in here are local so that they travel by value: Spark's streaming
    process on the driver cannot import this package.
    """
    def pack(rows: pa.Table) -> Iterator[bytes]:
        for at in range(0, rows.num_rows, SLICE_ROWS):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_table(rows.slice(at, SLICE_ROWS))
            yield sink.getvalue().to_pybytes()

    def unpack(packed: Iterable[bytes]) -> pa.Table:
        return pa.concat_tables([pa.ipc.open_stream(data).read_all() for data in packed])

    return pack, unpack


def _packed(rows: DataFrame, key: str) -> DataFrame:
    """(bucket, packed): the rows, packed by bucket of their conversation."""
    pack, _ = _codec()

    def cut(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        bucket = table.column(0).to_numpy()
        order = np.argsort(bucket, kind="stable")
        table, bucket = table.select(range(1, table.num_columns)).take(order).combine_chunks(), bucket[order]
        ends = np.r_[np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
        out = [(bucket[lo], data) for lo, hi in zip(np.r_[0, ends[:-1]], ends, strict=True)
               for data in pack(table.slice(lo, hi - lo))]
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()),
                                           pa.array([data for _, data in out], pa.binary())], ["bucket", "packed"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= PACK_ROWS or sum(b.nbytes for b in held) >= PACK_BYTES:
                yield cut(held)
                held = []
        if held:
            yield cut(held)

    bucket = F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(BUCKETS)).cast("int")
    return rows.select(bucket.alias("__bucket"), "*").mapInArrow(run, "bucket int, packed binary")


def _unpacked(packed: DataFrame, schema: T.StructType) -> DataFrame:
    _, unpack = _codec()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                yield from unpack([data.as_buffer()]).to_batches()

    return packed.mapInArrow(run, schema)


def in_order(schema: T.StructType, conv: int, at: int, tie: int, ident: int) -> StatefulProcessor:
    """The stateful step over packed rows of ``schema`` (columns by number: conversation, event time in
    microseconds, tiebreak, id)."""
    pack, unpack = _codec()
    binary = T.StructType([T.StructField("packed", T.BinaryType())])

    class InOrder(StatefulProcessor):
        """Holds rows until the watermark passes them; keeps those whose id differs from the one before."""

        def init(self, handle) -> None:
            self.handle = handle
            fields = schema.fields
            self.row = Row("packed")
            self.buffer = handle.getListState("buffer", binary)
            self.last = handle.getMapState(
                "last", T.StructType([T.StructField("conversation", fields[conv].dataType)]),
                T.StructType([T.StructField("at", T.LongType()), T.StructField("tie", fields[tie].dataType),
                              T.StructField("id", fields[ident].dataType)]))

        def _place(self, at, tie) -> tuple:
            """Sort key: nulls first, as in the batch order."""
            return (at is not None, at or 0, tie is not None, tie if tie is not None else 0)

        def _wait(self, rows: pa.Table, fired: int | None = None) -> None:
            """One timer, due when the watermark has passed the earliest of ``rows`` and of those that wait.

            A timer that has just fired is still listed, but will not fire again.
            """
            times = rows.column(at)
            due = 1 if times.null_count else max(pc.min(times).as_py() // 1000 + 1, 1)
            timers = [t for t in self.handle.listTimers() if t != fired]
            if not timers or due < min(timers):
                for t in timers:
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(due)

        def _out(self, rows: pa.Table, late: bool) -> Iterator[Row]:
            marked = rows.append_column("late", pa.array(np.full(rows.num_rows, late)))
            return (self.row(data) for data in pack(marked))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            fresh = unpack(r[1] for r in rows)
            if self.last.exists():
                keys = fresh.column(conv).to_pylist()
                left = {k: self.last.getValue((k,)) for k in set(keys)}
                passed = {k: self._place(v[0], v[1]) for k, v in left.items() if v is not None}
                late = pa.array([k in passed and self._place(a, t) < passed[k] for k, a, t in
                                 zip(keys, fresh.column(at).to_pylist(), fresh.column(tie).to_pylist(), strict=True)])
                yield from self._out(fresh.filter(late), True)
                fresh = fresh.filter(pc.invert(late))
            if fresh.num_rows:
                self.buffer.appendList([(data,) for data in pack(fresh)])
                self._wait(fresh)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            rows = unpack(r[0] for r in self.buffer.get())
            passed = pc.fill_null(pc.less(rows.column(at), timerValues.getCurrentWatermarkInMs() * 1000), True)
            ready, waiting = rows.filter(passed), rows.filter(pc.invert(passed))
            if ready.num_rows:
                ready = ready.combine_chunks()
                order = {"key": pc.dictionary_encode(ready.column(conv)).combine_chunks().indices, "at": ready.column(at)}
                if pa.types.is_floating(ready.column(tie).type):
                    order["nan"] = pc.is_nan(ready.column(tie))
                order = pa.table(order | {"tie": ready.column(tie)})
                index = pc.sort_indices(order, sort_keys=[(c, "ascending") for c in order.column_names],
                                        null_placement="at_start")
                ready, code = ready.take(index), order.column("key").take(index).to_numpy()
                ends = np.r_[np.flatnonzero(code[1:] != code[:-1]), len(code) - 1]
                ids, keep, start, known = ready.column(ident).to_pylist(), [], 0, self.last.exists()
                place = ready.select([conv, at, tie]).take(pa.array(ends))
                for end, k, a, t in zip(ends, *(c.to_pylist() for c in place.columns), strict=True):
                    last = self.last.getValue((k,)) if known else None
                    before = None if last is None else last[2]
                    for i in ids[start:end + 1]:
                        keep.append(i != before)
                        before = i
                    self.last.updateValue((k,), (a, t, before))
                    start = end + 1
                yield from self._out(ready.filter(pa.array(keep)), False)
                self.buffer.clear()
                if waiting.num_rows:
                    self.buffer.appendList([(data,) for data in pack(waiting)])
            if waiting.num_rows:
                self._wait(waiting, expiredTimerInfo.getExpiryTimeInMs())

        def close(self) -> None:
            pass

    return InOrder()


def _as_micros(df: DataFrame) -> DataFrame:
    """Timestamps as microseconds: exact in Python and in state, whatever the time zone."""
    return df.select(*[F.unix_micros(F.col(f"`{f.name}`").cast("timestamp")).alias(f.name)
                       if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def _from_micros(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[F.timestamp_micros(F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name)
                       if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) else F.col(f"`{f.name}`")
                       for f in schema.fields], "late")


def ordered_dedup_stream(stream: DataFrame, key: str, ts_col: str, tiebreak: str, id_col: str,
                         lateness: str = "1 hour") -> DataFrame:
    """The stream's columns and ``late``: kept rows (false) and rows beyond the bound (true).

    ``ts_col`` is a timestamp; a null one comes before all others.  Event times
    before 1970 and from ``END`` on are outside the watermark's range.  A column
    called ``late`` is refused.  Sets the session's state store to RocksDB,
    which timers need.
    """
    if "late" in stream.columns:
        raise ValueError("the stream has a column 'late' already")
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = stream.schema
    c = lambda name: F.col(f"`{name}`")
    timed = stream.withColumn("__at", c(ts_col).cast("timestamp")).withWatermark("__at", lateness)
    # the predicate names the watermark column, so it stays above it: an end row moves the watermark, no more
    data = timed.where(F.coalesce(F.col("__at") < F.lit(END).cast("timestamp"), F.lit(True))).drop("__at")
    free = (F.coalesce(c(id_col).cast("string"), F.lit("")) == "") | c(key).isNull()
    wire = _as_micros(data.where(~free))
    names = [f.name for f in wire.schema.fields]
    processor = in_order(wire.schema, *map(names.index, (key, ts_col, tiebreak, id_col)))
    kept = _packed(wire, key).groupBy("bucket").transformWithState(processor, "packed binary", "Append", "EventTime")
    kept = _unpacked(kept, T.StructType([*wire.schema.fields, T.StructField("late", T.BooleanType())]))
    return _from_micros(kept, schema).unionByName(data.where(free).withColumn("late", F.lit(False)))


def run_to_end(stream: DataFrame, key: str, ts_col: str, tiebreak: str, id_col: str, name: str,
               lateness: str = "1 hour", sink: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run over everything there is, then release what still waits; returns the sink (with ``late``).

    Two runs of one query, whatever the amount of data: the first takes all
    files, the second an end row in a folder of its own, whose event time moves
    the watermark past every row.
    """
    spark = stream.sparkSession
    sink, checkpoint = sink or scratch_path(spark, f"{name}-out"), checkpoint or scratch_path(spark, f"{name}-ckpt")
    end = scratch_path(spark, f"{name}-end")
    nothing = spark.createDataFrame([], stream.schema)
    nothing.write.parquet(end)
    both = stream.unionByName(spark.readStream.schema(stream.schema).parquet(end))
    query = ordered_dedup_stream(both, key, ts_col, tiebreak, id_col, lateness)
    run_available(query, name, sink, checkpoint)
    kind = stream.schema[ts_col].dataType
    spark.range(1).select(*[F.lit(END if f.name == ts_col else None).cast("timestamp" if f.name == ts_col else f.dataType)
                            .cast(kind if f.name == ts_col else f.dataType).alias(f.name)
                            for f in stream.schema.fields]).write.mode("append").parquet(end)
    return run_available(query, name, sink, checkpoint)


def on_time(out: DataFrame) -> DataFrame:
    """The kept rows, without the mark."""
    return out.where("NOT late").drop("late")


def late_counts(out: DataFrame, key: str) -> DataFrame:
    """How many rows of each conversation came beyond the bound."""
    return out.where("late").groupBy(F.col(f"`{key}`")).agg(F.count(F.lit(1)).alias("n_late"))
