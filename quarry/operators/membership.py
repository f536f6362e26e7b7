"""Membership at scale (X10, G3): is a key in a universe, without moving rows that cannot match.

The universe's distinct keys are counted, and a bitmap of their hashes is built
by aggregation: BITS_PER_KEY bits a key, at most MAX_BITS, so what is broadcast
has a fixed bound (16 MB).  A key whose bit is not set is certainly unknown: its
row is answered on the spot.  Null keys are set aside.  Only rows whose bit is
set are joined to the universe, which decides.  Beyond MAX_BITS / BITS_PER_KEY
keys the bitmap fills up and says "perhaps" more often; results do not change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.names import col
from quarry.session import materialize

BITS_PER_KEY = 16
MIN_BITS, MAX_BITS = 1 << 15, 1 << 27


class Universe:
    """A set of keys with its bitmap; both are written once."""

    def __init__(self, keys: DataFrame, column: str):
        self.keys = materialize(keys.select(col(column).cast("string").alias("__key")).where("__key IS NOT NULL").distinct(),
                                "universe")
        self.size = self.keys.count()
        self.bits = MIN_BITS
        while self.bits < min(self.size * BITS_PER_KEY, MAX_BITS):
            self.bits *= 2
        slot = self._slot(F.col("__key"))
        self.bitmap = materialize(self.keys.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("__bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("__bits")), "universe-bits")

    def _slot(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.bits))

    def perhaps(self, rows: DataFrame, column: str, name: str) -> DataFrame:
        """``rows`` with the boolean ``name``: false where the key is null or certainly unknown.  No shuffle."""
        slot = self._slot(col(column).cast("string"))
        byte = F.conv(F.hex(F.expr("substring(__bits, CAST(bitmap_bit_position(__slot) DIV 8 AS INT) + 1, 1)")), 16, 10)
        hit = byte.cast("int").bitwiseAND(F.expr("shiftleft(1, CAST(bitmap_bit_position(__slot) % 8 AS INT))")) > 0
        marked = rows.withColumn("__slot", F.when(col(column).isNotNull(), slot)).join(
            F.broadcast(self.bitmap), F.bitmap_bucket_number("__slot") == F.col("__bucket"), "left")
        return marked.withColumn(name, F.coalesce(hit, F.lit(False))).drop("__slot", "__bucket", "__bits")

    def decide(self, rows: DataFrame, column: str, name: str) -> DataFrame:
        """``rows``, whose bits are all set, with the boolean ``name``: whether the key is in the universe."""
        known = self.keys.withColumn("__in", F.lit(True))
        return (rows.join(known, col(column).cast("string") == F.col("__key"), "left")
                .withColumn(name, F.coalesce("__in", F.lit(False))).drop("__key", "__in"))


def known_keys(rows: DataFrame, columns: dict[str, str], universe: Universe) -> DataFrame:
    """``rows`` with a boolean per column of ``columns`` (column -> name): is its key known; null for a null key.

    Rows are written once with what the bitmap says, because every combination
    of columns that are to be decided is a branch of its own: a branch joins
    only for its columns, and the rows without any never leave their task.
    """
    for i, c in enumerate(columns):
        rows = universe.perhaps(rows, c, f"__m{i}")
    rows = materialize(rows, "membership")
    out = None
    for choice in range(2 ** len(columns)):
        branch = rows
        for i, (c, name) in enumerate(columns.items()):
            branch = branch.where(f"__m{i}" if choice >> i & 1 else f"NOT __m{i}")
        for i, (c, name) in enumerate(columns.items()):
            if choice >> i & 1:
                branch = universe.decide(branch, c, name)
            else:
                branch = branch.withColumn(name, F.when(col(c).isNotNull(), F.lit(False)))
        out = branch if out is None else out.unionByName(branch)
    return out.drop(*[f"__m{i}" for i in range(len(columns))])
