"""The closest candidate of every needle of a cell, with few calls of the scorer.

Two exact bounds come before the sequence matcher, both for all pairs of a
block at once: the characters two strings share as multisets, and the length
of their longest common subsequence.  The matcher's blocks stand in order in
both strings, so they form a common subsequence and no score can exceed
``2 * lcs / (len(a) + len(b))``.  The subsequence lengths of one needle with all
candidates are found bit-parallel: a machine word per candidate, a few word
operations per candidate character.  Candidates are then scored from the
greatest bound down, and no more once the bound falls below the best score.

A filter by the rare characters that close strings must share was measured
first and not kept: at a cutoff of 0.6 more pairs met under shared characters
(595,599) than there were pairs of like length (446,592; 300 two-word names
against 1,500).
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.similarity import score

#: Needles whose bounds are computed together (the block is NEEDLES x candidates of the cell).
NEEDLES = 128
#: Bits of a machine word: a longer needle has only the bound by character counts.
WORD = 64
#: Characters of a candidate that gets the bound by subsequences: more than any that a needle of WORD can match.
MAX_CODED = 1024


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Candidates:
    """The candidates of a cell: character counts and lengths."""

    def __init__(self, texts: list[str], buckets: int = 64):
        points = [code_points(t) for t in texts]
        self.texts, self.buckets = texts, buckets
        self.lengths = np.array([len(p) for p in points], np.int64)
        self.counts = np.array([np.bincount(p % buckets, minlength=buckets) for p in points],
                               np.int32).reshape(len(texts), buckets)

    @functools.cached_property
    def coded(self) -> tuple[np.ndarray, np.ndarray]:
        """(alphabet, character codes of the candidates up to MAX_CODED characters, 0 for padding), made when first needed."""
        points = [code_points(t) if n <= MAX_CODED else np.zeros(0, np.uint32) for t, n in zip(self.texts, self.lengths)]
        alphabet = np.unique(np.concatenate([*points, np.zeros(0, np.uint32)]))
        codes = np.zeros((len(points), max((len(p) for p in points), default=0)), np.int32)
        for row, p in zip(codes, points):
            row[:len(p)] = np.searchsorted(alphabet, p) + 1
        return alphabet, codes

    def count_bound(self, needles: list[np.ndarray]) -> np.ndarray:
        """Upper bounds of the scores (needles x candidates) from character counts; collisions only loosen them."""
        own = np.array([np.bincount(p % self.buckets, minlength=self.buckets) for p in needles], np.int32)
        shared = np.minimum(own[:, None, :], self.counts[None, :, :]).sum(axis=2)
        total = np.array([len(p) for p in needles])[:, None] + self.lengths[None, :]
        return 2.0 * shared / np.maximum(total, 1)

    def subsequence_bound(self, needle: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores of one needle (up to WORD characters) with some candidates."""
        alphabet, codes = self.coded
        n, lengths = len(needle), self.lengths[which]
        places = np.zeros(len(alphabet) + 1, np.uint64)
        for i, point in enumerate(needle):
            at = int(np.searchsorted(alphabet, point))
            if at < len(alphabet) and alphabet[at] == point:
                places[at + 1] |= np.uint64(1 << i)
        rows = np.full(len(which), np.uint64(2 ** 64 - 1))
        with np.errstate(over="ignore"):
            for column in codes[which, :int(lengths.max(initial=0))].T:
                hit = places[column]
                rows = (rows + (rows & hit)) | (rows & ~hit)
        common = n - np.bitwise_count(rows & np.uint64(2 ** n - 1)).astype(np.int64)
        return np.where(lengths <= MAX_CODED, 2.0 * common / np.maximum(n + lengths, 1), 1.0)


def best_in_cell(left: pd.DataFrame, right: pd.DataFrame, cutoff: float, scored: list | None = None) -> pd.DataFrame:
    """The best candidate of each needle of a cell: greatest score, then greatest text.

    ``scored`` collects, for tests, how many pairs the scorer saw.
    """
    rows = []
    if len(left) and len(right):
        left = left.drop_duplicates("needle")
        canon, found = right["canon"].tolist(), Candidates(right["lv"].tolist())
        needles = list(zip(left["needle"], left["ln"]))
        for start in range(0, len(needles), NEEDLES):
            block = [(needle, low, code_points(low)) for needle, low in needles[start:start + NEEDLES]]
            bounds = found.count_bound([p for *_, p in block])
            for (needle, low, points), bound in zip(block, bounds):
                which = np.flatnonzero(bound >= cutoff - 1e-9)
                if not len(which):
                    continue
                limit = bound[which]
                if len(points) <= WORD:
                    limit = np.minimum(limit, found.subsequence_bound(points, which))
                best: tuple | None = None
                for k in np.argsort(-limit, kind="stable"):
                    if limit[k] < cutoff - 1e-9 or (best and limit[k] < best[0] - 1e-9):
                        break
                    j = which[k]
                    value = score(low, found.texts[j], cutoff)
                    if scored is not None:
                        scored.append((low, found.texts[j]))
                    if value is not None and (best is None or (value, found.texts[j], canon[j]) > best):
                        best = (value, found.texts[j], canon[j])
                if best:
                    rows.append((needle, best[1], best[2], best[0]))
    return pd.DataFrame(rows, columns=["needle", "lv", "canon", "score"])


def split_cells(needles: DataFrame, values: DataFrame, keys: list[str], cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``nb`` and ``cb``: a key with many rows becomes a grid of cells of about ``cell_rows`` rows a side."""
    def buckets(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg((F.floor(F.count(F.lit(1)) / F.lit(cell_rows)) + 1).cast("int").alias(name))

    grid = buckets(needles, "n_nb").join(buckets(values, "n_cb"), keys)       # one row per key that both sides have
    needles = (needles.join(grid, keys)
               .withColumn("nb", F.pmod(F.xxhash64("needle"), F.col("n_nb")).cast("int"))
               .withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("n_cb") - 1))))
    values = (values.join(grid, keys)
              .withColumn("cb", F.pmod(F.xxhash64("lv"), F.col("n_cb")).cast("int"))
              .withColumn("nb", F.explode(F.sequence(F.lit(0), F.col("n_nb") - 1))))
    return needles, values


def best_matches(needles: DataFrame, values: DataFrame, keys: list[str], cutoff: float, cell_rows: int) -> DataFrame:
    """(needle, lv, canon, score): the best candidate of every needle in every cell of the same keys."""
    nd, cand = split_cells(needles, values, keys, cell_rows)
    cell = [*keys, "nb", "cb"]
    return (nd.select(*cell, "needle", "ln").groupBy(*cell)
            .cogroup(cand.select(*cell, "lv", "canon").groupBy(*cell))
            .applyInPandas(lambda left, right: best_in_cell(left, right, cutoff),
                           "needle string, lv string, canon string, score double"))
