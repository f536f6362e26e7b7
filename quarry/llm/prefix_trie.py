"""Operator 12: prefix trie of conversations by whole-sequence collapse.

Every conversation becomes a sequence of turns; equal sequences collapse into
one *weighted sequence* (its smallest conversation stands for it, its weight
is how many share it, its end list names them).  Sequences that are proper
prefixes of others are dropped by an anti-join: the rest are the leaves.  A
trie node is a distinct prefix; everything about it is a sum over the weighted
sequences that pass through it, so no group is ever collected.

A prefix is named by its depth and 128 bits: the XOR of the MD5s of (place,
turn digest) along it.  XOR can be summed in any order, so a conversation is
scanned in stretches of STRETCH turns whose totals are scanned in turn: no
task holds a whole conversation, however long.

Sums over a subtree need no walk.  Each node belongs to its smallest member's
sequence, and the nodes that belong to one sequence r are its last ones, from
some depth top(r) on (members only get fewer on the way down).  So with
tail(s, d) = bytes of the turns of s from depth d on, for any node at depth d
and the sequences s through it:

    sum of n_convs * bytes over its subtree = sum of weight(s) * tail(s, d)
    sum of bytes over its subtree           = sum of tail(s, max(d, top(s)))
    children                                = how many s have top(s) <= d + 1 <= length(s)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import table
from quarry.session import discard, materialize

GROUP = 5               # conversations c - c % GROUP .. share the head of the first of them
HEADS = 9               # heads have crc32(c) % HEADS turns
STRETCH = 1024          # turns of a conversation in one group, at most
END_BITS = 12           # ids of an end list in one group: those that agree but for the last 12 bits

KEY = ["depth", "a", "b"]


def _digest(role, text):
    """MD5 (hex) of a turn; role and text cannot run into each other."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def _before(rows: DataFrame, order: str, **totals) -> DataFrame:
    """``rows`` with what the stretches of the same conversation before theirs add up to."""
    earlier = Window.partitionBy("conv").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv", order).agg(*[f(c).alias(c) for c, f in totals.items()])
    sums = sums.select("conv", order, *[F.coalesce(f(c).over(earlier), F.lit(0)).alias(f"{c}_before")
                                        for c, f in totals.items()])
    return rows.join(sums, ["conv", order])


def numbered(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """(conv, pos from 1, digest, n_bytes) of every turn, without the texts.

    Turns stand in order of ``turn`` (null first); equal turns in order of role
    and digest, so repeated rows have a defined order.  Null roles and texts
    are empty.  Rows without a conversation id belong to no conversation.
    """
    c = lambda name: F.col(f"`{name}`")
    role = F.coalesce(c(role_col).cast("string"), F.lit(""))
    rows = conversations.where(c(conv_col).isNotNull()).select(
        c(conv_col).cast("long").alias("conv"), c(turn_col).alias("turn"), role.alias("role"),
        _digest(c(role_col), c(text_col)).alias("digest"),
        F.coalesce(F.octet_length(c(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes"))
    rows = rows.withColumn("part", F.coalesce(F.floor(F.col("turn") / STRETCH).cast("long"), F.lit(-2 ** 63)))
    here = Window.partitionBy("conv", "part").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    rows = rows.withColumn("at", F.row_number().over(here).cast("long")).withColumn("one", F.lit(1))
    return _before(rows, "part", one=F.sum).select("conv", (F.col("at") + F.col("one_before")).alias("pos"),
                                                   "digest", "n_bytes")


def rebuilt(turns: DataFrame, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(conversations (conv, length), their turns (conv, pos, digest, n_bytes)), with shared heads.

    Conversation c gets the first h turns of conversation c - c % group, then
    its own after its first h; h = crc32(c) % heads.  At most ``group``
    conversations on either side of zero share a head, and a head is shorter
    than ``heads``, so the join adds a bounded number of rows a conversation.
    """
    size = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    drawn = size.withColumn("base", F.col("conv") - F.col("conv") % group) \
        .withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % heads)
    convs = drawn.join(size.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left") \
        .withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0))))
    own = turns.join(convs.select("conv", "h", "head"), "conv").where("pos > h") \
        .select("conv", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "digest", "n_bytes")
    lent = turns.where(F.col("pos") < heads).withColumnRenamed("conv", "base") \
        .join(convs.select("conv", "base", "h"), "base").where("pos <= h").select("conv", "pos", "digest", "n_bytes")
    lengths = convs.select("conv", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    return lengths, own.unionByName(lent)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, a, b, parent_a, parent_b, digest, n_bytes, upto): the prefix that ends at each turn.

    ``upto`` are the bytes of the prefix.
    """
    name = F.md5(F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("digest")).cast("binary"))
    lane = lambda k: F.conv(F.substring(name, k, 16), 16, -10).cast("long")
    rows = turns.select("conv", "pos", "digest", "n_bytes", lane(1).alias("a"), lane(17).alias("b"),
                        F.expr(f"(pos - 1) DIV {STRETCH}").alias("part"))
    here = Window.partitionBy("conv", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"a_here": F.bit_xor("a").over(here), "b_here": F.bit_xor("b").over(here),
                             "n_here": F.sum("n_bytes").over(here)})
    rows = _before(rows, "part", a=F.bit_xor, b=F.bit_xor, n_bytes=F.sum)
    a, b = F.col("a_here").bitwiseXOR(F.col("a_before")), F.col("b_here").bitwiseXOR(F.col("b_before"))
    return rows.select("conv", F.col("pos").alias("depth"), a.alias("a"), b.alias("b"),
                       a.bitwiseXOR(F.col("a")).alias("parent_a"), b.bitwiseXOR(F.col("b")).alias("parent_b"),
                       "digest", "n_bytes", (F.col("n_here") + F.col("n_bytes_before")).alias("upto"))


def end_lists(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256): digest of the ids of each sequence's conversations, ascending.

    SHA-256 needs its bytes in order, so a sequence's list is read by one task;
    what that task reads has been joined before into texts of up to 4,096 ids,
    and it holds one of them at a time.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, done = None, None, []
        for batch in batches:
            for *this, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if this != key:
                    if key:
                        done.append((*key, digest.hexdigest()))
                    key, digest = this, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names)
                done = []
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, digest.hexdigest())], names)

    names = [*KEY, "ends_sha256"]
    texts = ends.groupBy(*KEY, F.shiftright("conv", END_BITS).alias("part")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda x: x.cast("string")), ",").alias("ids"))
    return (texts.repartition(*KEY).sortWithinPartitions(*KEY, "part").select(*KEY, "ids")
            .mapInArrow(run, "depth long, a long, b long, ends_sha256 string"))


def trie(lengths: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node of the trie of the sequences ``turns`` (conv, pos, digest, n_bytes).

    ``lengths`` (conv, length) names every conversation, also those without a
    turn.  Columns: see op12; also ``digest``, that of the node's last turn
    (root: null).  No conversation, no node.
    """
    steps = materialize(prefixes(turns), "trie-steps")
    full = steps.join(lengths.withColumnRenamed("length", "depth"), ["conv", "depth"]) \
        .select("conv", *KEY, F.col("upto").alias("total"))
    root = lengths.where("length = 0").select("conv", *[F.lit(0).cast("long").alias(k) for k in (*KEY, "total")])
    full = materialize(full.unionByName(root), "trie-full")
    sequences = full.groupBy(*KEY).agg(F.min("conv").alias("rep"), F.count(F.lit(1)).alias("weight"),
                                       F.min("total").alias("total"))
    sequences = materialize(sequences.withColumnRenamed("depth", "length"), "trie-sequences")
    ends = materialize(end_lists(full), "trie-ends")

    of = sequences.select("rep", "weight", "length", "total")
    zero = F.lit(0).cast("long")
    paths = steps.withColumnRenamed("conv", "rep").join(of, "rep").unionByName(
        of.select("*", *[zero.alias(k) for k in (*KEY, "parent_a", "parent_b", "n_bytes", "upto")],
                  F.lit(None).cast("string").alias("digest")))
    paths = paths.withColumn("tail", F.col("total") - F.col("upto") + F.col("n_bytes")).drop("total", "upto", "n_bytes")
    paths = materialize(paths, "trie-paths")

    inner = paths.where("depth < length").select(*KEY).distinct()
    leaves = sequences.withColumnRenamed("length", "depth").join(inner, KEY, "left_anti").select("rep", F.lit(1).alias("leaf"))

    owner = F.min(F.struct("rep", "tail", "parent_a", "parent_b")).alias("own")
    owned = materialize(paths.groupBy(*KEY).agg(owner).select(*KEY, "own.*"), "trie-owned")
    tops = owned.groupBy("rep").agg(F.min(F.struct("depth", "tail", "parent_a", "parent_b")).alias("t")).select(
        "rep", F.col("t.depth").alias("top"), F.col("t.tail").alias("top_tail"), (F.col("t.depth") - 1).alias("depth"),
        F.col("t.parent_a").alias("a"), F.col("t.parent_b").alias("b"))
    tops = tops.join(owned.select(*KEY, F.col("rep").alias("above")), KEY, "left").drop(*KEY)
    known = materialize(of.select("rep").join(tops, "rep", "left").join(leaves, "rep", "left"), "trie-known")

    through = paths.join(known, "rep")
    once = F.when(F.col("top").isNull(), 0).when(F.col("depth") >= F.col("top"), F.col("tail")).otherwise(F.col("top_tail"))
    child = (F.col("depth") < F.col("length")) & (F.col("depth") + 1 >= F.col("top"))
    nodes = through.groupBy(*KEY).agg(
        F.min(F.struct("rep", "top", "above", "digest")).alias("own"), F.sum("weight").alias("n_convs"),
        F.sum(F.coalesce(child, F.lit(False)).cast("long")).alias("n_children"),
        F.sum(F.coalesce("leaf", F.lit(0)).cast("long")).alias("n_leaves"),
        F.sum(F.col("weight") * F.col("tail") - once).alias("saved_tokens"))
    parent = F.when(F.col("depth") == 0, None).when(F.col("depth") > F.col("own.top"), F.col("own.rep")) \
        .otherwise(F.col("own.above"))
    nodes = nodes.join(ends, KEY, "left").select(
        F.col("own.rep").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        F.col("own.digest").alias("digest"))
    nodes = materialize(nodes, "trie-nodes")
    discard(steps, full, sequences, ends, paths, owned, known)
    return nodes


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """The trie of the conversations with shared heads: one row per node.

    ``conv_id`` smallest member, ``depth``, ``parent_conv_id`` (root: null),
    ``n_convs`` members, ``n_children``, ``n_leaves`` (childless nodes of its
    subtree, itself included), ``saved_tokens`` (over its subtree: members but
    one, times the bytes of the last text), ``ends_sha256`` (the ids that end
    here, ascending, comma-joined) and ``digest`` of its last turn.

    Null roles and texts are empty, rows without a conversation id are left
    out, equal turns of one conversation stand in order of role and digest
    (repeated rows count as turns), other columns are ignored, an empty table
    has no node.
    """
    turns = materialize(numbered(conversations, conv_col, turn_col, role_col, text_col), "trie-turns")
    lengths, again = rebuilt(turns, group, heads)
    lengths, again = materialize(lengths, "trie-lengths"), materialize(again, "trie-rebuilt")
    discard(turns)
    nodes = trie(lengths, again)
    discard(lengths, again)
    return nodes


def with_last_turn(nodes: DataFrame, conversations: DataFrame, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``nodes`` with the role and text of each node's last turn (root: null)."""
    role, text = F.col(f"`{role_col}`"), F.col(f"`{text_col}`")
    said = conversations.select(_digest(role, text).alias("digest"),
                                F.coalesce(role.cast("string"), F.lit("")).alias("last_role"),
                                F.coalesce(text.cast("string"), F.lit("")).alias("last_text"))
    return nodes.join(said.dropDuplicates(["digest"]), "digest", "left")


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations")).drop("digest")


#: CRC-32 of the decimal id: the bits of its bytes, one step each (DuckDB has no such function).
_CRC = ("xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split({0}::varchar, ''), "
        "lambda x: [ascii(x)::bigint, 0, 0, 0, 0, 0, 0, 0]))), "
        "lambda c, x: xor(xor(c, x) >> 1, CASE WHEN xor(c, x) % 2 = 1 THEN 3988292384::bigint ELSE 0 END)))")

ORACLE = f"""
WITH own AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''),
    md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS turns,
    {_CRC.format("conv_id")} % 9 AS h
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
again AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM own c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
paths AS (
  SELECT conv_id, len(turns) AS size, depth, turns[1:depth] AS node, turns[depth].t AS last
  FROM again, unnest(range(0, len(turns) + 1)) AS g(depth)),
nodes AS (
  SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, max(CASE WHEN depth > 0 THEN strlen(last) ELSE 0 END) AS bytes,
    coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (size = depth), '') AS ends, max(size) = depth AS childless
  FROM paths GROUP BY depth, node),
up AS (
  SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = n.node[1:n.depth - 1]
    AND n.depth > 0),
kids AS (SELECT depth - 1 AS depth, parent_conv_id AS conv_id, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY ALL),
below AS (
  SELECT p.depth, p.node, sum(CASE WHEN n.childless THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved_tokens
  FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.depth, p.node)
SELECT u.conv_id, u.depth::bigint AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children,
  n_leaves::bigint AS n_leaves, saved_tokens::bigint AS saved_tokens, sha256(ends) AS ends_sha256
FROM up u LEFT JOIN kids k ON k.depth = u.depth AND k.conv_id = u.conv_id
  JOIN below b ON b.depth = u.depth AND b.node = u.node
"""
