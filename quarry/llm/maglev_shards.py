"""Operator 3: shard placement by a permutation-filled lookup table.

A table with a prime number of slots is filled by the shards in turns: each
shard walks its own permutation of the slots (an offset and a step taken from
hashes of its name) and claims the first free one; a shard of weight w claims w
slots a turn.  All shards get the same share to within one turn, and when a
shard leaves, few rows of the others move.

A row goes to the shard that owns the slot of its key's hash.  The table has
``slots`` rows whatever the data's size; it is sent to every task by broadcast,
so placement reads the documents once and shuffles nothing.  The key is meant
to be unique (the document id): rows with equal keys share a shard by design.

Only DataFrame functions run on the data.  Filling the table is a loop over its
slots in the driver.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table

SLOTS = 65_537
SHARDS = tuple(f"shard-{k:04d}" for k in range(128))
MAX_SLOTS = 2_000_003       # proven bound of the broadcast: 12 bytes a slot


def _hash(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n ** 0.5) + 1))


def lookup_table(shards: list[str] | tuple[str, ...], slots: int = SLOTS,
                 weights: dict[str, int] | None = None) -> list[int]:
    """Owner (index into ``shards``) of each slot; ``slots`` must be prime."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and distinct")
    if slots > MAX_SLOTS or not _is_prime(slots) or slots < len(shards):
        raise ValueError("slots must be a prime from the number of shards up to MAX_SLOTS")
    turns = [int((weights or {}).get(s, 1)) for s in shards]
    if min(turns) < 0 or not any(turns):
        raise ValueError("weights must not be negative, nor all zero")
    # the order of names must not matter, only the names
    order = sorted(range(len(shards)), key=lambda k: shards[k])
    at = [_hash(s, "offset") % slots for s in shards]
    step = [_hash(s, "step") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    owner, free = [-1] * slots, slots
    while free:
        for k in order:
            for _ in range(turns[k]):
                while owner[at[k]] >= 0:
                    at[k] = (at[k] + step[k]) % slots
                owner[at[k]] = k
                free -= 1
                if not free:
                    return owner
    return owner


def slot_table(spark: SparkSession, shards, slots: int, weights=None, name: str = "shard") -> DataFrame:
    """The table as rows (slot, shard): one literal, split in the JVM."""
    owners = ",".join(shards[k] for k in lookup_table(shards, slots, weights))
    return spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", name))


def slot_of(key, slots: int):
    """Slot of a key: the first 60 bits of its MD5, modulo the slots (null: null)."""
    return (F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
            % F.lit(slots)).cast("int")


def place(docs: DataFrame, shards=SHARDS, key_col: str = "doc_id", slots: int = SLOTS, weights=None) -> DataFrame:
    """All rows and columns of ``docs`` with ``slot`` and ``shard`` added.

    A null key has null slot and shard.  Columns of ``docs`` called ``slot`` or
    ``shard`` are replaced.  Shard names must not hold commas.
    """
    if any("," in s for s in shards):
        raise ValueError("shard names must not hold commas")
    owners = slot_table(docs.sparkSession, shards, slots, weights).withColumnRenamed("slot", "__slot")
    rest = docs.drop("slot", "shard")
    rows = rest.withColumn("slot", slot_of(F.col(f"`{key_col}`") if key_col in rest.columns else docs[key_col], slots))
    return rows.join(F.broadcast(owners), rows["slot"] == owners["__slot"], "left").drop("__slot")


def op3_maglev_shards(spark, sf_dir: str) -> DataFrame:
    """Shard of every document now and after the last shard is drained; ``n_bytes`` sizes the shards."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0))
                                                    .cast("long").alias("n_bytes"))
    drained = slot_table(spark, SHARDS, SLOTS, {SHARDS[-1]: 0}, "shard_drained").withColumnRenamed("slot", "__slot")
    placed = place(docs)
    return (placed.join(F.broadcast(drained), placed["slot"] == drained["__slot"], "left")
            .select("doc_id", "n_bytes", "slot", "shard", "shard_drained",
                    (F.col("shard") != F.col("shard_drained")).alias("moved")))
