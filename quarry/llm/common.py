"""Helpers shared by the operators: bounded Arrow slices, word splitting, ids.

A *word* is ``[^\\x20\\x09-\\x0D]+`` throughout: text between ASCII blanks.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text bytes that one task works on at a time (a longer text stands alone).
SLICE_BYTES = 4 << 20
#: Bytes of one Arrow batch between the JVM and Python.
ARROW_BYTES = 8 << 20


_held: dict = {}


def hold(key, build: Callable):
    """The object that ``build`` makes, kept by this worker process until it is asked for another one.

    Workers serve many tasks and operators; only one large object (model,
    codec, word cache) stays in memory at a time.  ``hold(None, ...)`` only
    drops what is held.
    """
    if key not in _held:
        _held.clear()
        gc.collect()
        give_back()
        if key is None:
            return None
        _held[key] = build()
    return _held[key]


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], column: str | int,
           max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one slice holds about ``max_bytes`` of text."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def give_back() -> None:
    """Return freed memory to the system: an idle worker must not hold what a finished task used."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):      # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, with Arrow batches to Python of at most ARROW_BYTES (a session setting; a smaller one stays).

    Spark's default of 64 MB is held in the JVM and in Python for every task.
    """
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", conf.get(name))) > ARROW_BYTES or not re.fullmatch(r"\d+b?", conf.get(name)):
        conf.set(name, str(ARROW_BYTES))
    return docs


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the row each belongs to (null: none)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, rows = lists.flatten(), pc.list_parent_indices(lists)
    real = pc.not_equal(words, "")          # blanks at either end give empty strings
    return words.filter(real), rows.filter(real).to_numpy().astype(np.int64)


def word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(id of each word, its row, the distinct words that the ids index)."""
    words, rows = split_words(texts)
    coded = words.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), rows, coded.dictionary


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the public splitmix64 finaliser)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bits of a membership filter: 1,024 broadcast rows of 4 KB at most, whatever the data's size.
FILTER_BITS = 1 << 25


def _maybe(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """``rows`` with ``__maybe``: false only where the id is certainly not in ``ids``.

    A bitmap of id hashes, built by aggregation and broadcast; its size is fixed
    by FILTER_BITS.  With far more ids than bits it says true for every row and
    the caller's join moves all rows, as it would without the filter.
    """
    slot = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(FILTER_BITS))
    bits = (ids.select(slot.alias("__slot"))
            .groupBy(F.bitmap_bucket_number("__slot").alias("__bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("__slot")).alias("__bits"))
            # the 4 KB as numbers of 8 bytes, so that a row's bit is found without text functions
            .select("__bucket", F.expr("transform(sequence(0, 511), i ->"
                                       " CAST(conv(hex(substring(__bits, 8 * i + 1, 8)), 16, -10) AS bigint))").alias("__bits")))
    word = "get(__bits, CAST(bitmap_bit_position(__slot) DIV 64 AS INT))"
    place = "CAST(56 - bitmap_bit_position(__slot) DIV 8 % 8 * 8 + bitmap_bit_position(__slot) % 8 AS INT)"
    hit = F.coalesce(F.expr(f"(shiftright({word}, {place}) & 1L) = 1"), F.lit(False))
    return (rows.withColumn("__slot", slot)
            .join(F.broadcast(bits), F.expr("bitmap_bucket_number(__slot) = __bucket"), "left")
            .withColumn("__maybe", hit).drop("__slot", "__bucket", "__bits"))


def members(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose id may be in ``ids`` (a single column of that name): all that are, and few others."""
    return _maybe(rows, column, ids).where("__maybe").drop("__maybe")


def split_members(rows: DataFrame, column: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose id may be in ``ids``, rows whose id is certainly not)."""
    marked = _maybe(rows, column, ids)
    return marked.where("__maybe").drop("__maybe"), marked.where("NOT __maybe").drop("__maybe")
