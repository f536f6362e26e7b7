"""Operator 7: near duplicates by MinHash and a multi-index Hamming join.

A document's set holds its distinct word shingles.  Its signature has
``SYMBOLS`` b-bit symbols (b = 16), one per hash function; a symbol of two sets
with similarity J differs with probability about 1 - J.

Multi-index join.  The signature is split into chunks of ``CHUNK`` symbols.  If
two signatures differ in at most ``chunks * (ERRORS + 1) - 1`` symbols, some
chunk differs in at most ``ERRORS`` (pigeonhole).  Those errors are enumerated:
a key is made of a chunk with each choice of ``ERRORS`` symbols left out, so
such a pair always shares a key.  With the defaults that guarantees all pairs up
to 19 differing symbols of 50, and a pair of similarity 0.8 shares no key with
probability 2e-6.

From keys to links, without writing out all pairs of a group:

1. documents with equal sets form a class, found by partial aggregation; only
   one row per class goes on;
2. star: each class meets the smallest class of each of its buckets, and the
   confirmed links give components;
3. a pair of one bucket still matters only if its classes are in different
   components; in buckets of up to ``PAIRED`` classes those pairs are formed;
4. larger buckets take the root of their largest component as centre, and two
   members meet only over a rare shingle in which both differ from it, which
   finds every link of the group (``_around_centres`` has the proof); members
   that can be linked to no other go first, and differences become rows once;
5. every link is confirmed on the full shingle sets, cut again from the texts.

Joins on keys, centres and classes are sort-merge joins that adaptive execution
splits where a key is hot.  Components come from alternating star contractions
with aggregation by minimum; intermediate tables are written once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import members as members_of
from quarry.llm.common import hold, mix64, slices, small_batches, table, word_ids
from quarry.session import discard, materialize, settle

SYMBOLS, CHUNK, ERRORS = 50, 5, 1
FAR = 25            # signatures that differ in more symbols are not compared (J = 0.8: probability 1e-6)
PAIRED = 24         # buckets up to this size have their open pairs formed directly
LANES = -(-SYMBOLS // 4)
DIFF_BITS = 1024    # bitmap of a member's differences from its centre
STARS = 3           # rounds of stars around centres at most, before the pairs that are left
COMPARED = 2_000    # in groups up to this size bitmaps are compared first: that costs less than rows of differences
_U = np.uint64


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of each text's distinct n-word shingles, their rows); rows ascend.

    A-Z are lowered.  A text with fewer than n words but at least one has its
    whole word sequence as its only shingle.
    """
    ids, rows, vocab = word_ids(pc.ascii_lower(pc.fill_null(texts, "")))
    word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocab.cast(pa.binary()).to_pylist()), _U, len(vocab))
    count = np.bincount(rows, minlength=len(texts))
    size = np.where(count > 0, np.maximum(count - n + 1, 1), 0)
    row = np.repeat(np.arange(len(texts)), size)
    start = (np.cumsum(count) - count)[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    width = np.minimum(n, count)[row]
    value = np.full(len(row), 0x2545F4914F6CDD1D, _U) * width.astype(_U)
    for k in range(n):
        here = k < width
        value[here] = mix64(value[here] + word[ids[start[here] + k]])
    key = value ^ mix64(row + 1)
    order = np.argsort(key, kind="stable")
    fresh = np.ones(len(key), bool)
    fresh[order[1:]] = key[order[1:]] != key[order[:-1]]
    return value[fresh], row[fresh]


def _per_row(values: np.ndarray, rows: np.ndarray, n: int, reduce: np.ufunc, empty: int = 0) -> np.ndarray:
    out = np.full(n, empty, values.dtype)
    if len(rows):
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        out[rows[first]] = reduce.reduceat(values, first)
    return out


def identity(value: np.ndarray, rows: np.ndarray, n: int) -> list[bytes]:
    """128 bits per row that name its set."""
    a = _per_row(mix64(value), rows, n, np.add)
    b = _per_row(mix64(value ^ _U(0xD6E8FEB86659FD93)), rows, n, np.add)
    both = np.column_stack([a, b]).astype(">u8").tobytes()
    return [both[k * 16:k * 16 + 16] for k in range(n)]


def signatures(value: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """(n, 4 * LANES) symbols of 16 bits; columns from SYMBOLS on are zero."""
    out = np.zeros((n, 4 * LANES), np.uint16)
    factors = mix64(np.arange(1, SYMBOLS + 1)) | _U(1)
    for k in range(SYMBOLS):
        least = _per_row(value * factors[k], rows, n, np.minimum)
        out[:, k] = (mix64(least) & _U(0xFFFF)).astype(np.uint16)
    return out


def chunk_keys(symbols: np.ndarray) -> np.ndarray:
    """All keys of each signature: a chunk with every choice of ERRORS symbols left out."""
    keys = []
    for c, at in enumerate(range(0, SYMBOLS, CHUNK)):
        cols = range(at, min(at + CHUNK, SYMBOLS))
        for m, left_out in enumerate(combinations(cols, min(ERRORS, len(cols) - 1))):
            value = np.full(len(symbols), (c << 32 | m) + 1, _U)
            for k in cols:
                if k not in left_out:
                    value = mix64(value * _U(0x9E3779B97F4A7C15) + symbols[:, k])
            keys.append(value)
    return np.column_stack(keys).view(np.int64)


_LANE_COLS = [f"s{k}" for k in range(LANES)]
_BIT_COLS = [f"d{k}" for k in range(DIFF_BITS // 64)]


def _sketch(docs: DataFrame, n: int) -> DataFrame:
    """(id, th, n_shingles, cls, s0..): text hash, set size, set identity (null: empty set), signature."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(None, None)
        for part in slices(batches, 2):
            size = part.num_rows
            value, rows = shingles(part.column(2), n)
            count = np.bincount(rows, minlength=size).astype(np.int64)
            cls = pa.array(identity(value, rows, size), pa.binary(), mask=count == 0)
            lanes = signatures(value, rows, size).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(count), cls,
                                              *(pa.array(lanes[:, k].copy()) for k in range(LANES))],
                                             ["id", "th", "n_shingles", "cls", *_LANE_COLS])

    schema = "id long, th long, n_shingles long, cls binary, " + ", ".join(f"{c} long" for c in _LANE_COLS)
    return small_batches(docs.select("id", F.xxhash64("text").alias("th"), "text")).mapInArrow(run, schema)


def _keys(reps: DataFrame) -> DataFrame:
    """(key, node): one row per key of a signature."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            lanes = np.column_stack([part.column(c).to_numpy() for c in _LANE_COLS])
            keys = chunk_keys(np.ascontiguousarray(lanes).view(np.uint16))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), pa.array(np.repeat(part.column("node").to_numpy(), keys.shape[1]))],
                ["key", "node"])

    return reps.select("node", *_LANE_COLS).mapInArrow(run, "key long, node long")


def _near(a: str, b: str, num: int, den: int) -> str:
    """SQL: the set sizes allow the similarity and the signatures are not far apart."""
    masks = [0xFFFF, 0xFFFF0000, 0xFFFF00000000, -0x1000000000000]
    differ = " + ".join(f"CAST((({a}.{c} ^ {b}.{c}) & {m}L) <> 0 AS INT)" for c in _LANE_COLS for m in masks)
    sizes = f"least({a}.n_shingles, {b}.n_shingles) * {den} >= greatest({a}.n_shingles, {b}.n_shingles) * {num}"
    return f"{sizes} AND {differ} < {FAR}"


def _confirm(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(None, None)
        for part in slices(batches, 2, 2 << 20):
            size = part.num_rows
            sets = [shingles(part.column(k), n) for k in (2, 3)]
            count = [np.bincount(r, minlength=size) for _, r in sets]
            row = np.concatenate([r for _, r in sets])
            mixed = np.concatenate([v ^ mix64(r + 1) for v, r in sets])
            order = np.argsort(mixed, kind="stable")
            twice = row[order[1:]][mixed[order[1:]] == mixed[order[:-1]]]
            both = np.bincount(twice, minlength=size)
            linked = den * both >= num * (count[0] + count[1] - both)
            yield part.select([0, 1]).filter(pa.array(linked & (both > 0)))

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    # one plan at every size: pairs and texts grow with the corpus, so neither is broadcast
    return (pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "ta", "tb")
            .mapInArrow(run, "a long, b long"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, comp) for the nodes of ``edges`` (a, b): comp is the smallest node reachable.

    Alternating large-star and small-star contractions until the edges stop
    changing; every round moves the edges once, no group is ever collected.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .where("u <> v").distinct(), name)
    seen = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not state[0] or state == seen:
            break
        seen = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), name)
        discard(e)
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(moved.unionByName(root.withColumnRenamed("m", "v")).distinct(), name)
        discard(large)
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("comp", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 2,
                    num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Documents whose shingle sets have ``den * |A n B| >= num * |A u B|`` are
    linked; component_id is the smallest doc_id reachable, and the document
    that has it is kept.  A null text, or one without a word, has an empty set
    and is linked with nothing.  A null id is linked with nothing, its component
    is null and it is kept.  Rows that share an id are one document if their
    sets are equal (all of them have the same result), else each is linked by
    its own text.  Other columns are ignored.
    """
    return settle(lambda: _near_duplicates(docs, id_col, text_col, n, num, den), "near-duplicates")


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sketch = materialize(_sketch(rows, n), "sketch")
    named = sketch.where("id IS NOT NULL AND cls IS NOT NULL")
    first = named.groupBy("cls").agg(F.min("id").alias("rep")).withColumnRenamed("cls", "c")
    reps = materialize(named.join(first, (named["cls"] == first["c"]) & (named["id"] == first["rep"]))
                       .dropDuplicates(["cls"]).drop("c", "id")
                       .withColumn("node", F.monotonically_increasing_id()), "classes")
    links = _links(rows, reps, n, num, den)
    comps = components(links)

    label = (reps.select("cls", "rep", "node").join(comps, "node", "left")
             .select("cls", "rep", F.coalesce("comp", "node").alias("comp")))
    least = label.groupBy("comp").agg(F.min("rep").alias("component_id"))
    label = label.join(least, "comp").select(F.col("cls").alias("c"), "component_id")
    shown = ["id", "n_shingles", "cls"]
    found = named.select(shown).join(label, F.col("cls") == F.col("c"), "left")
    alone = (sketch.where("id IS NULL OR cls IS NULL").select(shown)
             .withColumn("component_id", F.col("id")))
    return (found.drop("c").unionByName(alone)
            .select(F.col("id").alias("doc_id"), "n_shingles", "component_id",
                    F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")))


def _links(rows: DataFrame, reps: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Confirmed links (a, b) between classes: enough of them to connect every component."""
    keys = materialize(_keys(reps), "keys")
    shared = keys.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("size")).where("size > 1")
    members = materialize(keys.join(shared.select("key", "hub"), "key"), "buckets")
    discard(keys)
    nodes = members.select("node").distinct()
    near = materialize(reps.join(nodes, "node", "left_semi"), "candidates")
    texts = materialize(
        members_of(rows, "id", near.select(F.col("rep").alias("id")))      # other texts are not moved
        .select(F.col("id").alias("rep"), F.xxhash64("text").alias("th"), "text")
        .join(near.select("node", "rep", "th").hint("merge"), ["rep", "th"]).select("node", "text").dropDuplicates(["node"]),
        "candidate-texts")
    sign = near.select("node", "n_shingles", *_LANE_COLS)

    def close(pairs):
        """Distinct pairs (a < b) that the signatures do not rule out."""
        return (pairs.distinct().join(sign.alias("x"), F.col("a") == F.col("x.node"))
                .join(sign.alias("y"), F.col("b") == F.col("y.node"))
                .where(F.expr(_near("x", "y", num, den))).select("a", "b"))

    star = close(members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")))
    tested = materialize(star, "star")
    links = materialize(_confirm(tested, texts, n, num, den), "links")

    # buckets whose classes are not connected yet
    comps = components(links)
    placed = materialize(members.join(comps, "node", "left")
                         .select("key", "node", F.coalesce("comp", "node").alias("comp")), "placed")
    mixed = (placed.groupBy("key", "comp").agg(F.count("*").alias("n"))
             .groupBy("key").agg(F.sum("n").alias("size"), F.count("*").alias("comps"),
                                 F.max(F.struct("n", (-F.col("comp")).alias("root"))).alias("main"))   # ties: smallest
             .where("comps > 1"))
    small = mixed.where(F.col("size") <= PAIRED).select("key")
    open_ = materialize(placed.join(small, "key", "left_semi").join(sign, "node"), "open-buckets")
    pair = (open_.alias("x").join(open_.alias("y"), (F.col("x.key") == F.col("y.key"))
                                  & (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp"))
                                  & F.expr(_near("x", "y", num, den)))
            .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
            .join(tested, ["a", "b"], "left_anti"))
    found = materialize(_confirm(pair, texts, n, num, den), "links")
    large = (placed.join(mixed.where(F.col("size") > PAIRED).select("key", (-F.col("main.root")).alias("centre")), "key")
             .select("centre", "node", "comp").distinct())
    return links.unionByName(found).unionByName(_around_centres(large, texts, n, num, den))


def _differences(groups: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """Adds to (centre, node, comp): size, centre_size, diff, the shingles in one of the two sets only, and its bitmap.

    ``diff`` ranks first what only the node has (rare in a group), then what
    only the centre has; each by hash, so all nodes of a centre rank alike.  In
    the bitmap the bit ``hash % DIFF_BITS`` of each of them is set.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(None, None)
        for part in slices(batches, 3, 1 << 20):
            size = part.num_rows
            sets = [shingles(part.column(k), n) for k in (3, 4)]
            count = [np.bincount(r, minlength=size).astype(np.int64) for _, r in sets]
            value = np.concatenate([v for v, _ in sets])
            row = np.concatenate([r for _, r in sets])
            order = np.lexsort((value, row))
            removed = np.repeat([True, False], [len(v) for v, _ in sets])[order]
            value, row = value[order], row[order]
            same = np.r_[False, (value[1:] == value[:-1]) & (row[1:] == row[:-1])]
            alone = ~same & ~np.r_[same[1:], False]
            value, row, removed = value[alone], row[alone], removed[alone]
            ends = np.r_[0, np.cumsum(np.bincount(row, minlength=size))]
            ranked = value[np.lexsort((value, removed, row))].view(np.int64)
            diff = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ranked))
            bits = np.zeros((size, DIFF_BITS), bool)
            bits[row, (mix64(value) % _U(DIFF_BITS)).astype(np.int64)] = True
            words = np.packbits(bits, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(count[1]),
                                              pa.array(count[0]), diff,
                                              *(pa.array(words[:, k].copy()) for k in range(len(_BIT_COLS)))],
                                             ["centre", "node", "comp", "size", "centre_size", "diff", *_BIT_COLS])

    centre = texts.select(F.col("node").alias("centre"), F.col("text").alias("tc"))
    return (groups.join(centre.hint("merge"), "centre").join(texts.hint("merge"), "node").select("centre", "node", "comp", "tc", "text")
            .mapInArrow(run, "centre long, node long, comp long, size long, centre_size long, diff array<long>, "
                        + ", ".join(f"{c} long" for c in _BIT_COLS)))


def _open_members(part: DataFrame, enough: str) -> DataFrame:
    """``part`` without the members of groups up to ``COMPARED`` that can be linked to no other one, by their bitmaps."""
    size = part.groupBy("centre").agg(F.count("*").alias("of"))
    some = part.join(size.where(F.col("of") <= COMPARED), "centre", "left_semi")
    many = part.join(size.where(F.col("of") > COMPARED), "centre", "left_semi")
    some = some.alias("x").join(some.alias("y"), F.expr("x.centre = y.centre AND x.comp <> y.comp"
                                                        f" AND (x.outside OR y.outside) AND {enough}"), "left_semi")
    return materialize(some.unionByName(many), "open-members")


def _shared(part: DataFrame) -> DataFrame:
    """The rows of ``part`` with each difference ``el`` of their head, and its rank k, that may lead to a link.

    A difference that members of one component have, or none of them outside,
    joins nothing (components only grow).  So the differences become rows once,
    without the members' other columns, and only those that are left get them.
    """
    # the members of a centre are dealt over all tasks before they become rows
    rows = materialize(part.select("centre", "node", "comp", "outside", "head").repartition("centre", "node")
                       .select("centre", "node", "comp", "outside", F.posexplode("head").alias("k", "el"))
                       .withColumn("k", F.col("k") + 1), "prefix-rows")
    met = (rows.groupBy("centre", "el").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("outside").alias("any"))
           .where("lo <> hi AND any").select("centre", "el"))
    shared = materialize(rows.join(met.hint("merge"), ["centre", "el"]).select("centre", "node", "k", "el")
                         .join(part.hint("merge"), ["centre", "node"]), "shared")
    discard(rows)
    return shared


def _around_centres(groups: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """All links across components inside groups that hold many members of one component.

    With D(x) the symmetric difference of x and the centre, |x ^ y| =
    |D(x)| + |D(y)| - 2 |D(x) n D(y)|, and x, y are linked iff |x ^ y| is at most
    r (|x| + |y|), r = (den - num) / (den + num).  Let y be any member and x one
    that is not linked to the centre, so |D(x)| > r (|x| + |centre|); one of any
    two members of different components is like that.  A link then needs
    |D(x) n D(y)| > (1 - r) / 2 |D(y)| common differences, and for the pair at
    least c = (|D(x)| + |D(y)| - r (|x| + |y|)) / 2, which is at least |D(x)| -
    |x| (den - num) / num by the triangle inequality and |y| <= |x| den / num.
    With the differences of both ranked alike, the first common one is among the
    first |D| - c + 1 of each.  What only one document adds ranks first, so x
    meets y over a shared, rare difference.  Members that share one such
    difference by chance are told apart before they become rows: of the bits in
    one bitmap that the other lacks each stands for a difference they do not
    share, and c must remain.  In groups of up to ``COMPARED`` members those that
    fail this with every other one go before; larger groups keep all members.

    Links need not all be found, only enough to connect: first the members that
    share an early difference meet one of them, a member of the component with
    most of them (``STARS`` rounds, while links are found; a row per member and
    difference at most).  Then only pairs whose components still differ meet,
    once each, at their first common difference.
    """
    d = materialize(_differences(groups, texts, n), "differences")
    sizes = "CAST(size({a}.diff) AS bigint)"
    link = "{den} * (x.size + y.size - {delta}) >= {num} * (x.size + y.size + {delta})"
    at_centre = (f"{den} * (size + centre_size - size(diff)) >= {num} * (size + centre_size + size(diff))")
    links = materialize(d.where(f"node <> centre AND {at_centre}")
                        .select(F.col("centre").alias("a"), F.col("node").alias("b"),
                                F.col("centre").alias("ca"), F.col("comp").alias("cb")), "links")
    # a component is named by its root, so the centre's component is the centre
    part = d.select("centre", "node", "comp", "size", *_BIT_COLS, F.size("diff").cast("long").alias("nd"),
                    ((F.col("comp") != F.col("centre")) & ~F.expr(at_centre)).alias("outside"), "diff")
    # | |D(x)| - |D(y)| | <= |x ^ y|: members too near to the centre to reach any outside one go
    reach = f"{den + num} * nd - {den - num} * size"
    lowest = part.where("outside").groupBy("centre").agg(F.min(F.expr(reach)).alias("lowest"))
    part = part.join(lowest, "centre").where(f"outside OR {den + num} * nd + {den - num} * size >= lowest").drop("lowest")
    # see above: common differences needed at least, by one side's sizes alone
    few = f"nd - CAST(floor(size * {den - num} / {num}) AS bigint)"
    least = f"greatest(1, {few}, if(outside, 1, CAST(floor(nd * {num} / {den + num}) AS bigint) + 1))"
    part = materialize(part.withColumn("head", F.expr(f"slice(diff, 1, CAST(greatest(nd - {least} + 1, 0) AS INT))"))
                       .drop("diff"), "members")
    # common differences needed, times 2 (den + num); the first common one is early in both rankings
    need = f"({den + num} * (x.nd + y.nd) - {den - num} * (x.size + y.size))"
    early = " AND ".join(f"{need} <= {2 * (den + num)} * ({a}.nd - {a}.k + 1)" for a in "xy")
    # a bit that only one of them has stands for one of its differences that the other lacks
    lacking = {a: " + ".join(f"bit_count({a}.{c} & ~{b}.{c})" for c in _BIT_COLS) for a, b in ("xy", "yx")}
    enough = " AND ".join(f"{need} <= {2 * (den + num)} * ({a}.nd - ({lacking[a]}))" for a in "xy")
    early += f" AND {enough}"

    def linked(x: DataFrame, y: DataFrame, where: str = "true") -> DataFrame:
        """(a, b, ca, cb): the links of members of ``x`` and ``y`` that share a difference, with their components."""
        met = (x.alias("x").join(y.alias("y"), (F.col("x.centre") == F.col("y.centre")) & (F.col("x.el") == F.col("y.el"))
                                 & (F.col("x.comp") != F.col("y.comp")) & F.expr(f"{early} AND {where}"))
               .select(F.col("x.centre").alias("centre"), F.col("x.node").alias("a"), F.col("y.node").alias("b"),
                       F.col("x.comp").alias("ca"), F.col("y.comp").alias("cb")).distinct())
        left = d.select("centre", F.col("node").alias("a"), "size", "diff").alias("x")
        right = d.select("centre", F.col("node").alias("b"), "size", "diff").alias("y")
        both = (met.alias("m").join(left, (F.col("m.centre") == F.col("x.centre")) & (F.col("m.a") == F.col("x.a")))
                .join(right, (F.col("m.centre") == F.col("y.centre")) & (F.col("m.b") == F.col("y.b"))))
        delta = f"({sizes.format(a='x')} + {sizes.format(a='y')} - 2 * size(array_intersect(x.diff, y.diff)))"
        return both.where(link.format(den=den, num=num, delta=delta)).select("m.a", "m.b", "ca", "cb")

    shared = _shared(_open_members(part, enough))
    prefix = None
    for k in range(STARS + 1):
        roots = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        discard(prefix)
        prefix = materialize(
            shared.join(roots.select(F.col("node").alias("comp"), F.col("comp").alias("root")), "comp", "left")
            .withColumn("comp", F.coalesce("root", "comp")).drop("root"), "prefixes")
        if k == STARS:
            break
        kept = ["node", "comp", "size", "nd", "k", *_BIT_COLS]
        hubs = (prefix.where("outside").groupBy("centre", "el", "comp")
                .agg(F.count("*").alias("n"), F.min(F.struct(*kept)).alias("hub"))
                .groupBy("centre", "el").agg(F.max_by("hub", F.struct("n", -F.col("comp"))).alias("hub"))
                .select("centre", "el", "hub.*"))
        stars = materialize(linked(hubs, prefix), "links")
        if stars.isEmpty():
            break
        links = materialize(links.unionByName(stars), "links")
    # what is left, each pair at its first common difference
    rest = linked(prefix.where("outside"), prefix, "x.el = element_at(array_intersect(x.head, y.head), 1)")
    return links.unionByName(rest).select("a", "b")


def op7_hamming_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=2, num=80, den=100)


ORACLE = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS s FROM words),
classes AS (SELECT min(doc_id) AS rep, list_sort(s) AS s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
items AS (SELECT rep, n, unnest(s) AS x FROM classes),
pairs AS (
  SELECT a.rep AS a, b.rep AS b FROM items a JOIN items b ON a.x = b.x AND a.rep < b.rep
    AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT rep AS a, rep AS b FROM classes UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
comp AS (SELECT a AS rep, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, len(d.s)::bigint AS n_shingles, coalesce(c.c, d.doc_id) AS component_id,
  coalesce(c.c, d.doc_id) = d.doc_id AS kept
FROM sets d LEFT JOIN classes k ON list_sort(d.s) = k.s AND len(d.s) > 0 LEFT JOIN comp c ON k.rep = c.rep
"""
