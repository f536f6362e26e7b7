"""Operator 2: removal of repeated line runs by winnowing.

A line ends at a newline or after ``.``, ``!`` or ``?`` and a blank; it keeps
its ending, so the lines of a text join to the text.  Lines compare without
outer blanks, by a hash.  Blank lines count by their number between lines.

1. Fingerprints.  Hashes of ``GRAM`` neighbouring lines are winnowed: of every
   ``WINDOW`` in a row the smallest (rightmost on ties) is selected; a line of
   at least ``long_line`` words is a fingerprint by itself.  Two equal runs of
   ``GRAM + WINDOW - 1`` lines hold the same window, so they share a
   fingerprint; a run of fewer lines and at least ``MIN_WORDS`` words has a line
   of ``MIN_WORDS / (GRAM + WINDOW - 2)`` words, which is ``long_line``.  So every
   run that may be deleted shares a fingerprint, whatever stands around it.
2. Positions.  Places of fingerprints meet the fingerprints that occur again;
   these seeds go to their rows.  Rows without one take no further part.
3. Extension.  A match is extended from its seeds both ways: of each line the
   shortest run from it, and the shortest run up to it, of at least
   ``MIN_WORDS`` words is kept if it holds a seed.  A longer run is the union of
   such passages, and each is fixed by its own lines, so it is found again
   wherever the run stands, whatever the seed's other places look like.
4. Each passage meets the earliest place that holds it, whichever document that
   is: two passages of one run may have different sources.  Passages that an
   earlier document holds are deleted from the later one, and inside one
   document those that stood before.

Only DataFrame functions are used.  Work is linear in the lines: a line
has two passages, and an occurrence meets one place, never the other
occurrences.  A hot passage skews a sort-merge join, which adaptive execution
splits; the least places are found by partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import members, split_members, table
from quarry.session import discard, materialize, settle

GRAM = 2            # lines hashed together
WINDOW = 3          # line grams of which one is selected
MIN_WORDS = 30      # words in a run that is deleted
HOT = 1_000         # a fingerprint with more than this part of all repeated places is hot: there are fewer than HOT

#: the text with U+0001 behind every line
_CUT = r"""replace(replace(replace(replace(__text, '\n', '\n\u0001'), '. ', '. \u0001'), '! ', '! \u0001'),
           '? ', '? \u0001')"""
#: the same cuts, but the blank or newline that ends a line is left out, so that trimming makes equal lines equal
_COMPARED = r"""replace(replace(replace(replace(__text, '. ', '.\u0001'), '! ', '!\u0001'), '? ', '?\u0001'),
                '\n', '\u0001')"""


def _once(expr: str):
    """An array expression that the optimizer may not copy into filters above it (it would run again there)."""
    return F.expr(f"if(spark_partition_id() >= 0, {expr}, null)")


def _words(line):
    """Blanks in a trimmed line plus one; 0 for a blank line."""
    blanks = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    return F.when(line == "", 0).otherwise(blanks + 1)


def line_table(docs: DataFrame) -> DataFrame:
    """(id, th, n, h, w, at): document id, text hash, lines; hash, words and place of every line with a word."""
    rows = (docs.where("__id IS NOT NULL AND __text IS NOT NULL")
            .select(F.col("__id").alias("id"), F.xxhash64("__text").alias("th"),
                    _once(f"transform(split({_COMPARED}, '\\u0001'), u -> trim(u))").alias("u"))
            .select("id", "th", F.transform("u", lambda u: F.xxhash64(u)).alias("h"),
                    F.transform("u", _words).alias("w")))
    full = "filter(arrays_zip(h, w, sequence(0, size(h) - 1)), x -> x.w > 0)"
    return (rows.select("id", "th", "h", "w", _once(f"if(array_contains(w, 0), {full}, null)").alias("z"))
            .selectExpr("id", "th", "size(h) AS n", "coalesce(z.h, h) AS h", "coalesce(z.w, w) AS w",
                        "coalesce(z.`2`, sequence(0, size(h) - 1)) AS at")
            .where("size(h) > 0"))


def fingerprints(lines: DataFrame, gram: int, window: int, long_line: int) -> DataFrame:
    """(id, th, p): the selected fingerprints of each row, p an array of (key, pos) with pos counting lines with words."""
    fields = ", ".join(["x"] + [f"h[i + {k}]" for k in range(1, gram)])
    grams = f"transform(slice(h, 1, greatest(size(h) - {gram - 1}, 0)), (x, i) -> xxhash64({fields}))"
    # places only, no structs: the least gram of the window from i on, the rightmost of equal ones
    least = "i"
    for k in range(1, window):
        before = " AND ".join(f"g[i + {k}] <= {f'g[i + {j}]' if j else 'x'}" for j in range(k))
        least = f"if(i + {k} < size(g) AND {before}, i + {k}, {least})"
    picked = f"transform(slice(g, 1, greatest(size(g) - {window - 1}, least(size(g), 1))), (x, i) -> {least})"
    # the same gram is selected by neighbouring windows: it counts once
    marked = f"transform(array_distinct({picked}), i -> named_struct('key', g[i], 'pos', i))"
    alone = (f"array_compact(transform(w, (x, i) -> if(x >= {long_line}, named_struct('key', xxhash64(h[i]), 'pos', i),"
             " null)))")
    return (lines.select("id", "th", "h", "w", _once(grams).alias("g"))
            .select("id", "th", _once(f"concat({marked}, {alone})").alias("p")))


def seeds(marks: DataFrame) -> DataFrame:
    """(id, th, seeds): per row the places of its fingerprints that occur again anywhere, ascending."""
    places = marks.select("id", "th", F.explode("p").alias("f")).select(
        F.col("f.key").alias("key"), "id", "th", F.col("f.pos").alias("pos"))
    again = materialize(places.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "repeated-keys")
    every = again.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") * HOT > every
    # fewer than HOT keys can be hot, so they are sent to the tasks; their places are not moved by key
    marked = (members(places, "key", again.select("key"))
              .join(F.broadcast(again.where(is_hot).select("key", F.lit(True).alias("hot"))), "key", "left"))
    rest = marked.where("hot IS NULL").join(again.where(~is_hot).select("key").hint("merge"), "key")
    return (rest.select("id", "th", "pos").unionByName(marked.where("hot").select("id", "th", "pos"))
            .groupBy("id", "th").agg(F.sort_array(F.collect_set("pos")).alias("seeds")))


def passages(lines: DataFrame, found: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, p): the shortest runs of at least ``min_words`` words from each line on and up to each line, with a seed.

    p is an array of (key, first, last), places counting all lines.  Every line
    of a run of at least ``min_words`` words lies in a passage inside the run: in
    the one up to it if the run has enough words so far, else in the one from
    the run's start.
    """
    # v0: words * 2^20 + lines of each line; v1, v2, ...: the same of 2, 4, ... lines from it on
    levels = max(min_words - 1, 0).bit_length()
    # the most lines from line i on that are too few, by ever smaller steps; the line behind them makes them enough
    enough = f"{min_words} * 1048576L"
    step = "coalesce(get(a, i + CAST(s % 1048576L AS int)), 0L)"
    few = (f"aggregate(array({', '.join(f'v{k}' for k in reversed(range(levels)))}), 0L,"
           f" (s, a) -> if(s + {step} < {enough}, s + {step}, s))") if levels else "0L"
    # a seed is within reach from the line on, or the line before is one, whose passages end where this line's begin
    reach = f"coalesce(get(ns, greatest(i - 1, 0)) < i + {min_words}, false)"
    # the last line of the shortest run from the line on; the number of lines where the text ends before
    stops = f"transform(v0, (x, i) -> if({reach}, i + CAST({few} % 1048576L AS int), size(v0)))"
    # the shortest run up to a line starts at the last line whose run ends there or before: up to the lines from
    # e[i] on and before e[i + 1] it starts at i, and up to e[i] it is the run from i on
    lasts = "greatest(x, coalesce(get(e, i + 1), size(e)) - 1)"
    # the last of these lines, -1 where none of the runs from i on holds a seed
    reached = (f"transform(e, (x, i) -> if(x < size(e) AND coalesce(get(ns, i) < i + {min_words} AND get(ns, i) <= {lasts},"
               f" false), {lasts}, -1))")
    first = "greatest(e[i], ns[i])"
    runs = "array_compact(transform(l, (z, i) -> if(z < 0, null, {made})))"
    # texts without blank lines: places are line numbers, a passage has one key
    one = "named_struct('key', xxhash64(slice(h, i + 1, b - i), h[b]), 'first', i, 'last', b)"
    made = f"transform(sequence({first}, z), b -> {one})"
    plain = f"flatten({runs.format(made=made)})"
    # blank lines inside a passage count by the distance to the next line, those before or behind it one by one
    uh = ("transform(h, (x, i) -> if(i + 1 = size(at) OR at[least(i + 1, size(at) - 1)] - at[i] = 1, x,"
          " xxhash64(x, at[least(i + 1, size(at) - 1)] - at[i])))")
    # the run up to e[i] is there already where no blank line follows it
    made = {"ahead": f"if(ns[i] <= e[i], array(named_struct('first', i, 'last', e[i], 'least', 0)), array())",
            "behind": f"transform(sequence({first}, z), b -> named_struct('first', i, 'last', b,"
                      " 'least', if(b = e[i], 1, 0)))"}
    # no line has its shortest run from i where the next line's run ends in the same line
    none = "get(e, i + 1) = e[i]"
    made["behind"] = f"if(coalesce({none}, false), array(), {made['behind']})"
    held = {side: f"flatten({runs.format(made=made[side])})" for side in made}
    body = "xxhash64(slice(uh, r.first + 1, r.last - r.first), h[r.last])"
    room = {"ahead": "at[r.first] - if(r.first = 0, -1, at[greatest(r.first - 1, 0)]) - 1",
            "behind": "if(r.last + 1 = size(at), n, at[least(r.last + 1, size(at) - 1)]) - at[r.last] - 1"}
    hashed = {side: f"filter(transform({held[side]}, r -> named_struct('body', {body}, 'first', at[r.first],"
                    f" 'last', at[r.last], 'least', r.least, 'room', {room[side]})), r -> r.least <= r.room)"
              for side in held}
    placed = {"ahead": "transform(sequence(r.least, r.room), k -> named_struct('key', if(k = 0, r.body, xxhash64(k, r.body, 0)),"
                       " 'first', r.first - k, 'last', r.last))",
              "behind": "transform(sequence(r.least, r.room), k -> named_struct('key', if(k = 0, r.body, xxhash64(0, r.body, k)),"
                        " 'first', r.first, 'last', r.last + k))"}
    spaced = ", ".join(f"flatten(transform({hashed[side]}, r -> {expr}))" for side, expr in placed.items())
    # the next seed of every line up to the last seed
    following = ("flatten(zip_with(seeds, concat(array(-1), slice(seeds, 1, size(seeds) - 1)),"
                 " (s, p) -> array_repeat(s, s - p)))")
    rows = (members(lines, "id", found.select("id")).join(found.hint("merge"), ["id", "th"])
            .select("id", "th", "n", "h", "at", _once("transform(w, x -> x * 1048576L + 1L)").alias("v0"),
                    _once(following).alias("ns"), _once(f"if(n = size(h), null, {uh})").alias("uh")))
    for k in range(1, levels):
        rows = rows.withColumn(f"v{k}", _once(f"transform(v{k - 1}, (x, i) -> x + coalesce(get(v{k - 1}, i + {1 << k - 1}),"
                                              " 0L))"))
    return (rows.select("id", "th", "n", "h", "at", "ns", "uh", _once(stops).alias("e"))
            .withColumn("l", _once(reached))
            .select("id", "th", _once(f"if(uh IS NULL, {plain}, concat({spaced}))").alias("p")))


def repeated_runs(lines: DataFrame, gram: int = GRAM, window: int = WINDOW, long_line: int | None = None,
                  min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, runs): the line runs to delete, as arrays of (first, last), one row per document that has any.

    ``long_line`` is the largest number of words that keeps the guarantee unless a smaller one is given.
    """
    sure = -(-min_words // max(gram + window - 2, 1))
    marks = materialize(fingerprints(lines, gram, window, min(long_line or sure, sure)), "fingerprints")
    found = materialize(seeds(marks), "seeds")
    held = materialize(passages(lines, found, min_words), "passages")
    places = held.select("id", "th", F.explode("p").alias("f")).select("id", "th", "f.*")
    place = F.struct("id", "th", "first")
    source = (places.groupBy("key").agg(F.min(place).alias("s"), F.count("*").alias("n")).where("n > 1")
              .selectExpr("key", "s.id AS sid", "s.th AS sth", "s.first AS sfirst"))
    # one plan at every size: both sides grow with the corpus, so neither is broadcast
    gone = (places.join(source.hint("merge"), "key").where("id > sid OR (id = sid AND th = sth AND first > sfirst)")
            .select("id", "th", F.expr("first * 4294967296L + last").alias("run")))
    # in order of their first lines the last ones rise too, so neighbours show where a run ends
    before = "concat(array(-2), slice(r.last, 1, size(r) - 1))"
    behind = "concat(slice(r.first, 2, size(r) - 1), array(2147483647))"
    starts = f"array_compact(zip_with(r.first, {before}, (a, b) -> if(a > b + 1, a, null)))"
    stops = f"array_compact(zip_with(r.last, {behind}, (a, b) -> if(b > a + 1, a, null)))"
    spans = "transform(r, x -> named_struct('first', CAST(x DIV 4294967296L AS int), 'last', CAST(x % 4294967296L AS int)))"
    return (gone.groupBy("id", "th").agg(F.sort_array(F.collect_set("run")).alias("r"))
            .select("id", "th", _once(spans).alias("r"))
            .select("id", "th", _once(f"zip_with({starts}, {stops}, (a, b) -> named_struct('first', a, 'last', b))")
                    .alias("runs")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM,
                window: int = WINDOW, long_line: int | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the text cut and two columns added: n_removed (lines) and removed_words.

    Documents are ordered by id and the earliest occurrence of a run stays.
    Rows that share an id are never cut against each other, and of different
    texts under one id only that with the least hash loses what repeats inside
    itself.  Null ids and null or empty texts pass unchanged with zeros.  Columns of ``docs`` named like
    the added ones are replaced, all others pass through.  U+0001 ends a line
    and is dropped from a text that is cut.
    """
    rest = docs.drop("n_removed", "removed_words")
    rows = rest.withColumns({"__id": F.col(f"`{id_col}`").cast("long"), "__text": F.col(f"`{text_col}`").cast("string")})
    lines = materialize(line_table(rows.select("__id", "__text")), "lines")
    runs = settle(lambda: repeated_runs(lines, gram, window, long_line, min_words), "line-runs")
    discard(lines)
    runs = runs \
        .withColumnsRenamed({"id": "__rid", "th": "__rth", "runs": "__runs"})
    names, zero = [F.col(f"`{c}`") for c in rest.columns], F.lit(0).cast("long")
    # texts that cannot be cut stay where they are
    cuttable, whole = split_members(rows, "__id", runs.select(F.col("__rid").alias("__id")))
    gone = "flatten(transform(__runs, r -> slice(__u, r.first + 1, r.last - r.first + 1)))"
    # the lines before, between and behind the runs
    kept = ("flatten(zip_with(concat(array(0), transform(__runs, r -> r.last + 1)),"
            " concat(transform(__runs, r -> r.first), array(size(__u))), (a, b) -> slice(__u, a + 1, b - a)))")
    cut = (cuttable.withColumn("__th", F.xxhash64("__text"))
           .join(runs.hint("merge"), (F.col("__id") == F.col("__rid")) & (F.col("__th") == F.col("__rth")), "left")
           .withColumn("__u", _once(f"if(__runs IS NULL, null, split({_CUT}, '\\u0001'))"))
           .withColumn("__gone", _once(gone))
           .withColumn("__kept", _once(f"array_join({kept}, '')")))
    # a newline stands at the end of a line only
    trimmed = F.transform("__gone", lambda u: F.trim(F.replace(u, F.lit("\n"), F.lit(""))))
    words = F.aggregate(trimmed, zero, lambda s, u: s + _words(u))
    cut = cut.select(
        *[F.coalesce("__kept", n).alias(c) if c == text_col else n for c, n in zip(rest.columns, names, strict=True)],
        F.coalesce(F.size("__gone").cast("long"), zero).alias("n_removed"), F.coalesce(words, zero).alias("removed_words"))
    return cut.unionByName(whole.select(*names, zero.alias("n_removed"), zero.alias("removed_words")))


def op2_line_winnow(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
