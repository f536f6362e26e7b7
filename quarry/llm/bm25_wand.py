"""Operator 10: benchmark decontamination with BM25 and block-max WAND.

The benchmark items are the indexed documents and every passage of the training
texts is a query.  A passage is two neighbouring steps of ``step`` words, with
``step`` at least the longest item, so an item that was copied whole lies whole
in some passage.

Weights are BM25 impacts divided by the item's score for its own words, so a
score is the share of an item's BM25 weight that a passage holds and one
threshold fits all items.  Items are indexed in blocks, with each term's largest
weight per block.  For a batch of passages:

1. a passage whose terms' largest weights stay under the threshold together
   holds no hit (the WAND pivot rule);
2. the sum of its terms' block maxima bounds every block; blocks under the
   threshold are skipped without a look at their postings;
3. the postings of the remaining (passage, block) pairs are scored exactly, and
   every item at or above the threshold is retrieved.

A hit is verified in the text: the share of the question's and of the answer's
word n-grams that the passage holds.  The answer is the last fifth of an item's
words unless a column names it.

Documents are read once and not shuffled.  The index is loaded in shards of at
most ``SHARD_BYTES`` of item text (term statistics are always those of the whole
benchmark), so a task's memory does not grow with the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import slices, small_batches, table, word_ids

K1, B = 1.2, 0.75
THRESHOLD = 0.5         # share of an item's own BM25 score
NGRAM = 5
OVERLAP = 0.5           # of the question's n-grams, and of the answer's
ANSWER_SHARE = 0.2
MIN_STEP = 64
BLOCK = 8               # items per index block
CELLS = 1 << 20         # (passage, block) bounds held at a time
SHARD_BYTES = 8 << 20   # item text of one index shard: the bound of what a task holds
SCHEMA = ("doc_id long, item_id long, score double, question_overlap double, answer_overlap double, "
          "first_word long")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _split(col):
    """Words of a text, A-Z lowered."""
    return F.filter(F.split(F.translate(col, _UPPER, _LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")


@dataclass
class Index:
    """One shard."""

    items: np.ndarray                   # item ids
    words: list[np.ndarray]             # per item its words as term numbers
    answer: list[int]                   # per item where its answer begins
    terms: pa.Array
    start: np.ndarray                   # postings by term: items and weights
    item: np.ndarray
    weight: np.ndarray
    block_start: np.ndarray             # block maxima by term
    block: np.ndarray
    block_max: np.ndarray
    block_first: np.ndarray             # first posting of each block entry
    top: np.ndarray                     # largest weight by term
    step: int

    @classmethod
    def build(cls, rows: list[tuple], n_items: int, mean_len: float, step: int) -> Index:
        """``rows``: (item id, words, document frequencies, first word of the answer)."""
        names = sorted({w for _, ws, _, _ in rows for w in ws})
        number = {w: k for k, w in enumerate(names)}
        post = []
        for k, (_, ws, dfs, _) in enumerate(rows):
            tf: dict[int, list] = {}
            for w, df in zip(ws, dfs, strict=True):
                tf.setdefault(number[w], [0, df])[0] += 1
            norm = K1 * (1 - B + B * len(ws) / mean_len)
            impact = {t: np.log(1 + (n_items - df + 0.5) / (df + 0.5)) * n * (K1 + 1) / (n + norm)
                      for t, (n, df) in tf.items()}
            total = sum(impact.values())
            post += [(t, k, v / total) for t, v in impact.items()]
        t = np.array([p[0] for p in post], np.int64)
        item = np.array([p[1] for p in post], np.int64)
        weight = np.array([p[2] for p in post], np.float64)
        top = np.zeros(len(names))
        np.maximum.at(top, t, weight)
        by = np.lexsort((item, t))
        t, item, weight = t[by], item[by], weight[by]
        edges = np.arange(len(names) + 1)
        n_blocks = -(-len(rows) // BLOCK)
        key = t * n_blocks + item // BLOCK
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        return cls(np.array([r[0] for r in rows], np.int64),
                   [np.array([number[w] for w in ws], np.int64) for _, ws, _, _ in rows], [r[3] for r in rows],
                   pa.array(names, pa.string()), np.searchsorted(t, edges), item, weight,
                   np.searchsorted(t[first], edges), item[first] // BLOCK,
                   np.maximum.reduceat(weight, first) if len(key) else np.zeros(0),
                   np.r_[first, len(t)], top, step)


def _expand(start: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated ranges start[k]:start[k + 1] of the keys: (index of the key, place)."""
    size = start[keys + 1] - start[keys]
    owner = np.repeat(np.arange(len(keys)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + start[keys][owner]


def _passages(index: Index, texts: pa.Array):
    """(term of every word or -1, row of every word, passage keys and terms of the distinct pairs, bases)."""
    ids, rows, vocab = word_ids(pc.ascii_lower(pc.fill_null(texts, "")))
    lookup = pc.fill_null(pc.index_in(vocab, value_set=index.terms), -1).to_numpy(zero_copy_only=False)
    term = lookup.astype(np.int64)[ids] if len(ids) else np.zeros(0, np.int64)
    n = np.bincount(rows, minlength=len(texts))
    steps = np.maximum(-(-n // index.step), 1)
    base = np.cumsum(steps) - steps                     # first passage number of a row
    begin = np.cumsum(n) - n
    here = np.flatnonzero(term >= 0)
    own = (here - begin[rows[here]]) // index.step      # step of each word; passage p holds steps p and p + 1
    number = base[rows[here]] + own
    before = own > 0
    width = len(index.terms)
    pairs = np.unique(np.concatenate([number * width + term[here], (number[before] - 1) * width + term[here[before]]]))
    return term, begin, n, base, steps, pairs // width, pairs % width


def retrieve(index: Index, passage: np.ndarray, term: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """(passage, item, score) of every pair at or above the threshold; ``passage`` ascends."""
    slack = threshold - 1e-9
    if not len(passage):
        return []
    # pivot rule: a passage whose maxima do not reach the threshold together cannot hold a hit
    group = np.cumsum(np.r_[True, passage[1:] != passage[:-1]]) - 1
    alive = np.bincount(group, index.top[term])[group] >= slack
    passage, term = passage[alive], term[alive]
    if not len(passage):
        return []
    group = np.cumsum(np.r_[True, passage[1:] != passage[:-1]]) - 1
    number = passage[np.r_[True, passage[1:] != passage[:-1]]]
    n_blocks, n_items = -(-len(index.items) // BLOCK), len(index.items)
    out = []
    size = max(1, CELLS // n_blocks)                    # passages bounded together
    edge = np.searchsorted(group, np.arange(0, group[-1] + 1 + size, size))
    for k, (lo, hi) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
        owner, place = _expand(index.block_start, term[lo:hi])
        cell = (group[lo:hi] - k * size)[owner] * n_blocks + index.block[place]
        bound = np.bincount(cell, index.block_max[place], size * n_blocks)
        live = bound[cell] >= slack                     # blocks that may hold a hit; the others are skipped
        cell, place = cell[live], place[live]
        owner, post = _expand(index.block_first, place)
        pair = (cell // n_blocks)[owner] * n_items + index.item[post]
        pair, inverse = np.unique(pair, return_inverse=True)
        score = np.bincount(inverse, index.weight[post], len(pair))
        for j in np.flatnonzero(score >= slack):
            out.append((int(number[pair[j] // n_items + k * size]), int(pair[j] % n_items), float(score[j])))
    return out


def _grams(words: np.ndarray, n: int) -> set:
    n = max(1, min(n, len(words)))
    return {tuple(words[k:k + n].tolist()) for k in range(len(words) - n + 1)}


def _overlap(part: np.ndarray, text: np.ndarray, n: int) -> float:
    """Share of the part's word n-grams that occur in the text (no word: 1)."""
    if not len(part):
        return 1.0
    want = _grams(part, n)
    size = len(next(iter(want)))
    return len(want & _grams(text, size)) / len(want) if len(text) >= size else 0.0


def hits(index: Index, texts: pa.Array, threshold: float, overlap: float, ngram: int) -> dict:
    """(row, item) -> (score, question overlap, answer overlap, first word) of verified hits, best passage first."""
    term, begin, n, base, _, passage, terms = _passages(index, texts)
    best: dict[tuple[int, int], tuple] = {}
    for p, item, score in retrieve(index, passage, terms, threshold):
        row = int(np.searchsorted(base, p, "right")) - 1
        first = (p - int(base[row])) * index.step
        text = term[begin[row] + first:begin[row] + min(first + 2 * index.step, n[row])]
        words, cut = index.words[item], index.answer[item]
        tail = words[cut:]
        question = _overlap(words[:cut], text, ngram)
        answer = _overlap(tail, text, max(1, min(ngram, len(tail) // 2)))   # short: a changed end must not hide it
        if question >= overlap and answer >= overlap:
            found = score, question, answer, first
            if (row, item) not in best or found[:3] > best[row, item][:3]:
                best[row, item] = found
    return best


def load(benchmark: DataFrame, shard_bytes: int = SHARD_BYTES, answer_share: float = ANSWER_SHARE,
         answer_col: str | None = None) -> Iterator[Index]:
    """The index, one shard after another.

    Items with null id or text, or without a word, are left out; of repeated ids
    each row is an item.  With ``answer_col`` that column's words follow the
    text's as the answer.
    """
    text = benchmark["text"].cast("string")
    answer = _split(benchmark[answer_col].cast("string")) if answer_col else F.array().cast("array<string>")
    items = (benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), _split(text).alias("q"),
                              F.coalesce(answer, F.array().cast("array<string>")).alias("a"))
             .where("item_id IS NOT NULL AND q IS NOT NULL AND size(q) + size(a) > 0")
             .select("item_id", F.concat("q", "a").alias("ws"), F.size("q").alias("n_q")))
    total = items.agg(F.count("*").alias("n"), F.avg(F.size("ws")).alias("mean"), F.max(F.size("ws")).alias("most"),
                      F.sum(F.length(F.array_join("ws", " "))).alias("bytes")).first()
    if not total["n"]:
        return
    shards = -(-total["bytes"] // shard_bytes)
    step = max(MIN_STEP, total["most"])
    seen = items.select(F.explode(F.array_distinct("ws")).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    keyed = items.withColumn("key", F.xxhash64("item_id", "ws"))
    for shard in range(shards):
        mine = keyed.where(F.pmod("key", F.lit(shards)) == shard)
        rows = (mine.select("item_id", "key", "n_q", F.posexplode("ws").alias("pos", "w")).join(seen, "w")
                .groupBy("item_id", "key", "n_q").agg(F.array_sort(F.array_distinct(F.collect_list(F.struct("pos", "w", "df"))))
                                                      .alias("x")).collect())
        rows = sorted(rows, key=lambda r: (r["item_id"], r["key"]))
        yield Index.build([(r["item_id"], [x["w"] for x in r["x"]], [x["df"] for x in r["x"]],
                            r["n_q"] if answer_col else len(r["x"]) - max(1, round(answer_share * len(r["x"]))))
                           for r in rows], total["n"], float(total["mean"]), step)


def search(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           threshold: float = THRESHOLD, overlap: float = OVERLAP, ngram: int = NGRAM, **index) -> DataFrame:
    """Verified hits: doc_id, item_id, score, question_overlap, answer_overlap, first_word.

    One row per input row and item, of its best passage; ``first_word`` is where
    that passage begins.  Null or empty texts have no hit; null ids keep theirs;
    repeated rows give their hits again.  Other columns are ignored.
    """
    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    sc = docs.sparkSession.sparkContext
    out = None
    for shard in load(benchmark, **index):
        found = small_batches(narrow).mapInArrow(_searcher(sc.broadcast(shard), threshold, overlap, ngram), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def _searcher(sent, threshold, overlap, ngram):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for part in slices(batches, 1):
            best = hits(index, part.column(1), threshold, overlap, ngram)
            rows = np.array([r for r, _ in best], np.int64)
            cols = [pa.array([v[k] for v in best.values()], t) for k, t in
                    enumerate((pa.float64(), pa.float64(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(rows)), pa.array(index.items[[i for _, i in best]]), *cols],
                [c.split()[0] for c in SCHEMA.split(", ")])
    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = THRESHOLD,
               overlap: float = OVERLAP, ngram: int = NGRAM, **index) -> DataFrame:
    """The rows without a verified hit, all columns unchanged."""
    at, sc = docs.columns.index(text_col), docs.sparkSession.sparkContext

    def cleaner(sent):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, at):
                keep = np.ones(part.num_rows, bool)
                keep[[r for r, _ in hits(sent.value, part.column(at), threshold, overlap, ngram)]] = False
                yield part.filter(pa.array(keep))
        return run

    for shard in load(benchmark, **index):
        docs = small_batches(docs).mapInArrow(cleaner(sc.broadcast(shard)), docs.schema)
    return docs


def op10_bm25_wand(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
