"""Operator 1: repetition rules from suffix arrays.

Each text is a sequence of words.  Its suffixes are sorted by prefix doubling
and the longest common prefix (LCP) of neighbours is kept.  The LCP intervals
are the maximal repeated substrings; a position's longest repeat is the larger
of its two neighbouring LCPs, so the union of ``[i, i + longest repeat(i))`` is
the union of the spans of all intervals.  Texts of one Arrow slice are sorted
together, vectorised: the row number leads every sort key, so no repeat is ever
found across two texts.

Rows are independent: no shuffle, no state beyond one slice of text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quarry.llm.common import mix64, slices, small_batches, table, word_ids

WINDOW = 5              # words in a repeat, at least
MIN_WORDS = 10          # shorter texts fail the base rule
MAX_REPEAT_WORDS = 0.20  # base rule: share of words inside repeats
MAX_REPEAT_CHARS = 0.20  # method: share of word characters covered by repeats
MAX_LONGEST = 50        # method: words of the longest single repeat

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, base_failed boolean, kept boolean, repeat_chars long, "
          "longest_repeat long, spans array<struct<first:int,last:int>>")


def longest_repeats(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For every word position the length of the longest repeat that starts there.

    ``rows`` must ascend.  Prefix doubling: ranks at level h order the suffixes
    by their first h words; only groups that are still tied are sorted again.
    When a tied pair separates, its LCP follows from the ranks of the levels
    below, longest first.
    """
    n = len(ids)
    if n < 2:
        return np.zeros(n, np.int64)
    at = np.arange(n)
    last = np.flatnonzero(np.r_[rows[1:] != rows[:-1], True])
    end = (last + 1)[np.searchsorted(last, at)]              # one past the text's last word
    width = int(ids.max()) + 2
    rank = rows * width + ids                                # level 1
    follow = np.where(at + 1 < end, np.r_[ids[1:], 0] + 1, 0)
    order = np.lexsort((follow, rank))
    fresh = np.r_[True, (rank[order[1:]] != rank[order[:-1]]) | (follow[order[1:]] != follow[order[:-1]])]
    levels, h = [(1, rank)], 2
    lcp = np.zeros(n + 1, np.int64)                          # lcp[k]: slots k-1 and k
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, at, 0))
    slots = np.flatnonzero(~fresh | ~np.r_[fresh[1:], True])  # slots of groups of two or more
    while len(slots):
        levels.append((h, rank.copy()))
        pos = order[slots]
        nxt = pos + h
        second = np.where(nxt < end[pos], rank[np.minimum(nxt, n - 1)] + 1, 0)
        by = np.lexsort((second, rank[pos]))
        pos, second = pos[by], second[by]
        order[slots] = pos
        group = rank[pos]
        same = np.r_[False, group[1:] == group[:-1]]
        split = same & np.r_[False, second[1:] != second[:-1]]
        b = np.flatnonzero(split)
        lcp[slots[b]] = _common(pos[b - 1], pos[b], h, levels, end, n)
        fresh = ~same | split
        rank[pos] = np.maximum.accumulate(np.where(fresh, slots, 0))
        slots = slots[~fresh | ~np.r_[fresh[1:], True]]
        h *= 2
    best = np.empty(n, np.int64)
    best[order] = np.maximum(lcp[:-1], lcp[1:])
    return best


def _common(a, b, known, levels, end, n):
    length = np.full(len(a), known, np.int64)
    for size, rank in reversed(levels[:-1]):
        x, y = a + length, b + length
        ok = (x < end[a]) & (y < end[b])
        ok &= rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)]
        length += np.where(ok, size, 0)
    return length


def _suspects(ids: np.ndarray, rows: np.ndarray, n_rows: int, window: int) -> np.ndarray:
    """Rows in which some window of words may occur twice (equal windows always count)."""
    flag = np.zeros(n_rows, bool)
    m = len(ids) - window + 1
    if m < 2:
        return flag
    word = mix64(ids + 1)
    key = mix64(rows[:m] + 1)
    for k in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + word[k:k + m]
    starts = np.flatnonzero(rows[:m] == rows[window - 1:])   # windows inside one text
    key = key[starts]
    by = np.argsort(key)
    key = key[by]
    flag[rows[starts[by[1:][key[1:] == key[:-1]]]]] = True
    return flag


def _measure(texts: pa.Array, window: int) -> dict[str, np.ndarray]:
    n = len(texts)
    texts = pc.fill_null(texts, "")
    ids, rows, vocab = word_ids(texts)
    count = lambda r, w=None: np.bincount(r, w, n).astype(np.int64)
    chars = pc.utf8_length(vocab).to_numpy().astype(np.int64)
    out = {"n_words": count(rows), "word_chars": count(rows, chars[ids])}
    out["n_symbols"] = pc.count_substring_regex(texts, "[#*$%&|<>]").to_numpy().astype(np.int64)

    lines = pc.split_pattern(texts, "\n")
    line_row = pc.list_parent_indices(lines).to_numpy().astype(np.int64)
    coded = lines.flatten().dictionary_encode()
    worded = pc.match_substring_regex(coded.dictionary, r"[^\x20\x09-\x0D]")
    worded = worded.to_numpy(zero_copy_only=False)[coded.indices.to_numpy()]
    line_row, line = line_row[worded], coded.indices.to_numpy()[worded]
    distinct = np.unique(line_row * (len(coded.dictionary) + 1) + line)
    out["n_dup_lines"] = count(line_row) - count(distinct // (len(coded.dictionary) + 1))

    here = np.flatnonzero(_suspects(ids, rows, n, window)[rows])
    best = longest_repeats(ids[here], rows[here])
    first = np.flatnonzero(best >= window)
    edge = np.zeros(len(here) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + best[first], -1)
    inside = np.cumsum(edge[:-1]) > 0
    word = here[inside]
    out["n_repeat_words"] = count(rows[word])
    out["repeat_chars"] = count(rows[word], chars[ids[word]])
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, rows[here[first]], best[first])
    out["longest_repeat"] = longest

    # maximal covered stretches, as word numbers inside their text
    r = rows[here]
    opens = np.flatnonzero(inside & np.r_[True, ~inside[:-1] | (r[1:] != r[:-1])])
    closes = np.flatnonzero(inside & np.r_[~inside[1:] | (r[1:] != r[:-1]), True]) if len(here) else opens
    begin = np.r_[0, np.cumsum(out["n_words"])][rows[here[opens]]]
    spans = pa.StructArray.from_arrays([pa.array(here[opens] - begin, pa.int32()),
                                        pa.array(here[closes] - begin, pa.int32())], ["first", "last"])
    offsets = np.r_[0, np.cumsum(count(rows[here[opens]]))]
    out["spans"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)
    return out


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
               min_words: int = MIN_WORDS, max_repeat_words: float = MAX_REPEAT_WORDS,
               max_repeat_chars: float = MAX_REPEAT_CHARS, max_longest: int = MAX_LONGEST) -> DataFrame:
    """Repetition measures and verdict, one row per input row.

    ``spans`` are the covered word ranges (0-based, both ends included).
    ``base_failed``: fewer than ``min_words`` words, or more than
    ``max_repeat_words`` of them inside repeated windows.  ``kept``: not
    base_failed, at most ``max_repeat_chars`` of the word characters covered,
    and no single repeat above ``max_longest`` words.

    A null or empty text has no word: zeros, base_failed, not kept.  Null ids
    and repeated rows are measured like any other; other columns are ignored
    and an empty table gives an empty result.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            m = _measure(part.column(1), window)
            words = m["n_words"]
            failed = (words < min_words) | (m["n_repeat_words"] > max_repeat_words * words + 1e-9)
            kept = ~failed & (m["repeat_chars"] <= max_repeat_chars * m["word_chars"] + 1e-9) \
                & (m["longest_repeat"] <= max_longest)
            cols = [part.column(0), *(pa.array(m[c]) for c in ("n_words", "word_chars", "n_symbols",
                    "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(kept),
                    pa.array(m["repeat_chars"]), pa.array(m["longest_repeat"]), m["spans"]]
            yield pa.RecordBatch.from_arrays(cols, names)

    names = [c.strip().split(" ")[0] for c in SCHEMA.split(", ")]
    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return small_batches(narrow).mapInArrow(run, SCHEMA)


def op1_suffix_repetition(spark, sf_dir: str) -> DataFrame:
    return repetition(table(spark, sf_dir, "documents")).drop("spans", "longest_repeat")


_W51 = " || ' ' || ".join(f"lead(word, {k}) OVER p" for k in range(1, 51))
ORACLE = f"""
WITH words AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
    FROM documents)),
runs AS (
  SELECT doc_id, pos, word,
    word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p || ' ' || lead(word, 3) OVER p
      || ' ' || lead(word, 4) OVER p AS five,
    md5(word || ' ' || {_W51}) AS long_run
  FROM words WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
twice AS (
  SELECT doc_id, pos, word, five IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, five) > 1 AS rep,
    long_run IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, long_run) > 1 AS long_rep
  FROM runs),
cover AS (
  SELECT doc_id, word, long_rep, max(rep::int) OVER (PARTITION BY doc_id ORDER BY pos
    ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS covered FROM twice),
per_doc AS (
  SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, sum(covered) AS n_repeat_words,
    sum(length(word) * covered) AS repeat_chars, max(long_rep::int) AS too_long FROM cover GROUP BY doc_id),
dup_lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (
    SELECT doc_id, unnest(str_split(coalesce(text, ''), chr(10))) AS line FROM documents)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
measured AS (
  SELECT d.doc_id, coalesce(n_words, 0)::bigint AS n_words, coalesce(word_chars, 0)::bigint AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols,
    coalesce(n_dup_lines, 0)::bigint AS n_dup_lines, coalesce(n_repeat_words, 0)::bigint AS n_repeat_words,
    coalesce(repeat_chars, 0)::bigint AS repeat_chars, coalesce(too_long, 0) AS too_long
  FROM documents d LEFT JOIN per_doc p ON d.doc_id = p.doc_id LEFT JOIN dup_lines l ON d.doc_id = l.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
    AND 100 * repeat_chars <= 20 * word_chars AND too_long = 0 AS kept, repeat_chars
FROM measured
"""
