"""Operator 6: byte-level BPE by recursive queries, encoding and decoding.

Each task holds an in-memory DuckDB with the merge table: one row
``(left id, right id, merged id)`` for every two tokens whose bytes join to a
token; the merged id is the rank.  A text is cut into words by the tokenizer's
pattern.  The words that a task has not met yet go to DuckDB as token-position
rows; a recursive query joins neighbours to the merge table and contracts each
word's leftmost pair of minimum rank, until no pair is left.  The remaining rows
are joined to the token table and come back ordered by word and position; Arrow
joins each word's run of them into its id list and its bytes.  Texts are then
put together from their words in order.

Long words contract all non-overlapping occurrences of the minimum-rank pair in
one step when the merged token belongs to no pair of lower rank (then no new
pair can come first, so the result is the same); the number of steps is bounded
by the distinct ranks instead of the length.

Rows are independent: no shuffle.  The rank file (bounded size) goes to the
tasks as bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quarry.llm.common import hold, slices, small_batches, table

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
MAX_RANK_BYTES = 64 << 20
QUERY_BYTES = 512 << 10     # bytes of new words in one recursive query
LONG_WORD = 64              # bytes from which occurrences are contracted together
MAX_WORDS = 600_000         # encoded words kept per process; beyond half of it those not used since go
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

#: One contraction per word and step.
_SHORT = """
WITH RECURSIVE step(word, pos, tok, live) AS (
  SELECT word, pos, tok, true FROM fresh
  UNION ALL
  (WITH pairs AS (
    SELECT word, pos, tok, prev, merged
    FROM (SELECT word, pos, tok, CASE WHEN lag(word) OVER w = word THEN lag(pos) OVER w END AS prev,
            CASE WHEN lead(word) OVER w = word THEN lead(tok) OVER w END AS nxt FROM step WHERE live
          WINDOW w AS (ORDER BY word::BIGINT << 20 | pos))      -- one sort; many small partitions cost more
    LEFT JOIN merges ON tok = lft AND nxt = rgt),
  firsts AS (SELECT word, min(merged::BIGINT << 20 | pos) AS best FROM pairs GROUP BY word)
  SELECT word, pos, CASE WHEN pos = best & 1048575 THEN (best >> 20)::INT ELSE tok END, best IS NOT NULL
  FROM pairs JOIN firsts USING (word)
  WHERE best IS NULL OR prev IS NULL OR prev <> best & 1048575))
"""
#: All occurrences per word and step where that is safe (see the module text).
_LONG = """
WITH RECURSIVE step(word, pos, tok, live) AS (
  SELECT word, pos, tok, true FROM fresh
  UNION ALL
  SELECT word, pos, CASE WHEN hit THEN best ELSE tok END, best IS NOT NULL
  FROM (
    SELECT *, lag(hit, 1, false) OVER (PARTITION BY word ORDER BY pos) AS swallowed
    FROM (
      SELECT *, coalesce(merged = best AND CASE WHEN safe
          THEN row_number() OVER (PARTITION BY word, merged = best, isle ORDER BY pos) % 2 = 1
          ELSE row_number() OVER (PARTITION BY word, merged = best ORDER BY pos) = 1 END, false) AS hit
      FROM (
        SELECT *, nr - row_number() OVER (PARTITION BY word, merged = best ORDER BY pos) AS isle
        FROM (
          SELECT word, pos, tok, merged, nr, min(merged) OVER (PARTITION BY word) AS best,
            arg_min(safe, merged) OVER (PARTITION BY word) AS safe
          FROM (SELECT word, pos, tok, row_number() OVER w AS nr, lead(tok) OVER w AS nxt FROM step WHERE live
                WINDOW w AS (PARTITION BY word ORDER BY pos))
          LEFT JOIN merges ON tok = lft AND nxt = rgt))))
  WHERE NOT swallowed)
"""
_FOLD = """
SELECT word, digits, token FROM step JOIN tokens ON tok = id WHERE NOT live ORDER BY word, pos
"""


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def _values(column: pa.Array) -> list:
    return column.to_numpy(zero_copy_only=False).tolist()       # several times faster than to_pylist()


def _joined(offsets: pa.Array, parts: pa.Array, by: str | bytes) -> list:
    """The parts from each offset to the next, joined."""
    return _values(pc.binary_join(pa.LargeListArray.from_arrays(offsets, parts), pa.scalar(by, parts.type)))


class Codec:
    """The merge table in DuckDB, and the words encoded so far."""

    def __init__(self, data: bytes, pattern: str, max_words: int = MAX_WORDS):
        import duckdb
        import regex

        self.max_words = max_words
        self.ranks = read_ranks(data)
        self.pattern = regex.compile(pattern)
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        left, right, merged = [], [], []
        lowest: dict[int, int] = {}                     # token -> lowest rank of a pair that it belongs to
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
                    lowest[a] = min(rank, lowest.get(a, rank))
                    lowest[b] = min(rank, lowest.get(b, rank))
        ints = lambda x: pa.array(x, pa.int32())
        merges = pa.table({"lft": ints(left), "rgt": ints(right), "merged": ints(merged),
                           "safe": pa.array([lowest.get(m, m + 1) > m for m in merged], pa.bool_())})
        tokens = pa.table({"id": ints(list(self.ranks.values())), "digits": [str(i) for i in self.ranks.values()],
                           "token": pa.array(list(self.ranks), pa.binary())})
        self.db = duckdb.connect(":memory:")
        self.db.execute("SET threads = 1")
        self.db.execute("SET preserve_insertion_order = false")
        for name, rows in (("merges", merges), ("tokens", tokens)):
            self.db.register(f"{name}_in", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_in")
            self.db.unregister(f"{name}_in")
        self.words: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}   # those of the half before; used again, they move to ``words``

    def _contract(self, words: list[str], recursion: str) -> None:
        raw = [w.encode() for w in words]
        sizes = np.array([len(b) for b in raw])
        flat = np.frombuffer(b"".join(raw), np.uint8)
        start = np.cumsum(sizes) - sizes
        fresh = pa.table({
            "word": pa.array(np.repeat(np.arange(len(raw)), sizes).astype(np.int32)),
            "pos": pa.array((np.arange(len(flat)) - np.repeat(start, sizes)).astype(np.int32)),
            "tok": pa.array(np.array(self.single, np.int32)[flat])})
        self.db.register("fresh", fresh)
        got = self.db.sql(recursion + _FOLD).to_arrow_table().combine_chunks()
        self.db.unregister("fresh")
        # every word has a token, so the rows of word i are those from ends[i - 1] on
        ends = np.cumsum(np.bincount(got["word"].to_numpy(), minlength=len(words)))
        offsets = pa.array(np.concatenate([[0], ends]), pa.int64())
        ids = _joined(offsets, got["digits"].combine_chunks(), ",")
        data = _joined(offsets, got["token"].combine_chunks(), b"")
        self.words.update(zip(words, zip(ids, data, strict=True), strict=True))

    def learn(self, words: Iterable[str]) -> None:
        """Encode words that are not known yet, in queries of bounded size."""
        short, long, size = [], [], 0
        for word in words:
            n = len(word.encode())
            if n >= LONG_WORD:
                long.append(word)
                continue
            short.append(word)
            size += n
            if size >= QUERY_BYTES:
                self._contract(short, _SHORT)
                short, size = [], 0
        if short:
            self._contract(short, _SHORT)
        group, size = [], 0
        for word in long:
            group.append(word)
            size += len(word.encode())
            if size >= QUERY_BYTES:
                self._contract(group, _LONG)
                group, size = [], 0
        if group:
            self._contract(group, _LONG)

    def encode(self, texts: list[str]) -> list[tuple[str, int, bytes]]:
        """Per text (ids joined by commas, their number, decoded bytes), put together from its words in order."""
        if len(self.words) > self.max_words // 2:
            self.older, self.words = self.words, {}
        cut = [self.pattern.findall(t) for t in texts]
        # distinct words are looked up once; their places are filled from arrays, which stay in the processor's caches
        coded = pa.array(list(chain.from_iterable(cut)), pa.large_string()).dictionary_encode()
        distinct = _values(coded.dictionary)
        unknown = set(distinct) - self.words.keys()
        again = unknown & self.older.keys()
        self.words.update((w, self.older[w]) for w in again)
        self.learn(unknown - again)
        found = [self.words[w] for w in distinct]
        offsets = pa.array(np.cumsum([0, *map(len, cut)]), pa.int64())
        ids = _joined(offsets, pa.array([f[0] for f in found], pa.large_string()).take(coded.indices), ",")
        data = _joined(offsets, pa.array([f[1] for f in found], pa.large_binary()).take(coded.indices), b"")
        return [(i, i.count(",") + 1 if i else 0, d) for i, d in zip(ids, data, strict=True)]


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           output: str = "digest", max_words: int = MAX_WORDS) -> DataFrame:
    """Encode and decode every whole text.

    ``output='digest'``: doc_id, n_tokens, ids_sha256, decoded_sha256.
    ``output='ids'``: doc_id, n_tokens, ids (array of int), decoded (binary).
    ``max_words`` bounds the encoded words that a worker keeps (some 350 bytes
    each); fewer take less memory and more time.
    A null or empty text has no token and decodes to nothing.  Null ids and
    repeated rows give a row each; other columns are ignored.
    """
    if len(ranks) > MAX_RANK_BYTES:
        raise ValueError("the rank file is larger than MAX_RANK_BYTES")
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    digest = output == "digest"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = sent.value
        codec = hold(("bpe", data, pattern, max_words), lambda: Codec(data, pattern, max_words))
        for part in slices(batches, 1):
            n, first, second = [], [], []
            for ids, size, data in codec.encode(pc.fill_null(part.column(1), "").to_pylist()):
                n.append(size)
                if digest:
                    first.append(hashlib.sha256(ids.encode()).hexdigest())
                    second.append(hashlib.sha256(data).hexdigest())
                else:
                    first.append([int(i) for i in ids.split(",")] if ids else [])
                    second.append(data)
            kinds = (pa.string(), pa.string()) if digest else (pa.list_(pa.int32()), pa.binary())
            names = ["ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(first, kinds[0]), pa.array(second, kinds[1])],
                ["doc_id", "n_tokens", *names])

    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return small_batches(narrow).mapInArrow(run, SCHEMA if digest else "doc_id long, n_tokens long, ids array<int>, decoded binary")


def public_ranks(name: str = TOKENIZER) -> tuple[bytes, str]:
    """(rank file, word pattern) of a public tokenizer; ``name`` may also be a path."""
    import os

    import public_tokenizers

    with open(name if os.path.sep in name else public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def op6_duck_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), *public_ranks())
