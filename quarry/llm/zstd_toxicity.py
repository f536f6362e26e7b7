"""Operator 4: toxicity by compression distance with Zstandard dictionaries.

Two dictionaries are trained, one on ordinary text and one on toxic text.  A
window (a word; longer ones are cut) is compressed once with the ordinary and
once with the toxic dictionary in front of it; the bytes that the toxic one
saves are the window's gain.  Counts and shares of windows above gain
thresholds are the features of a logistic regression, fitted on labelled texts
that no dictionary has seen, so the thresholds are calibrated out of sample.

What makes windows of a few bytes work:

* both compressors hold the same ordinary dictionary, followed by equally long
  toxic or further ordinary content, so ordinary words cost the same in both;
* the toxic samples are the windows of toxic texts that hold byte n-grams
  over-represented there (document frequencies, two-proportion z score);
* every window is followed by a fixed trailer that both dictionaries end with:
  Zstandard looks for no match in the last bytes of its input.

Fitting uses a bounded sample of labelled rows (``SAMPLE_BYTES`` of text per
class, chosen by a hash of the id).  Scoring is row by row, without a shuffle;
the dictionaries (under 100 KB) go to the tasks with the function.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import give_back, hold, mix64, slices, small_batches, split_words, table

SAMPLE_BYTES = 12 << 20     # labelled text per class that the fit may use
ORDINARY_DICT = 64 << 10
TOXIC_DICT = 8 << 10
WINDOW_BYTES = 48           # longer words are cut
GRAM = 6
LEVELS = (2, 3, 4, 5)       # gains in bytes whose counts are features
MAX_CACHE = 200_000         # window gains kept per process
TRAILER = bytes(33 + (k * 37) % 90 for k in range(48))
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_LAZY2, min_match=4, window_log=18, hash_log=16, chain_log=17, search_log=6,
        target_length=32, write_content_size=False, write_dict_id=False, write_checksum=False)
    words = zstandard.ZstdCompressionDict(content + TRAILER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=words, compression_params=params)


@dataclass
class Model:
    """``weights`` is None where the labels do not allow a fit: every text gets ``prior``."""

    prior: float
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: np.ndarray | None = None
    _pair: tuple | None = field(default=None, repr=False, compare=False)
    _gains: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self):
        return {"prior": self.prior, "ordinary": self.ordinary, "toxic": self.toxic, "weights": self.weights,
                "_pair": None, "_gains": {}}

    def held(self) -> Model:
        """The copy that this worker keeps, with its gains, from task to task."""
        fitted = None if self.weights is None else self.weights.tobytes()
        return hold(("toxicity", self.prior, fitted, self.ordinary, self.toxic), lambda: self)

    def gains(self, words: list[bytes]) -> np.ndarray:
        """Bytes saved by the toxic dictionary, the largest over a word's windows."""
        if self._pair is None:
            self._pair = _compressor(self.ordinary), _compressor(self.toxic)
        if len(self._gains) > MAX_CACHE:
            self._gains.clear()
        plain, toxic = (c.compress for c in self._pair)
        known, out = self._gains, np.empty(len(words), np.int64)
        for k, word in enumerate(words):
            gain = known.get(word)
            if gain is None:
                gain = -99
                for at in range(0, len(word), WINDOW_BYTES):
                    window = b" " + word[at:at + WINDOW_BYTES] + b" " + TRAILER
                    gain = max(gain, len(plain(window)) - len(toxic(window)))
                known[word] = gain
            out[k] = gain
        return out

    def features(self, texts: pa.Array) -> np.ndarray:
        words, rows = split_words(texts)
        coded = words.dictionary_encode()
        gain = self.gains(coded.dictionary.cast(pa.binary()).to_pylist())[coded.indices.to_numpy()]
        n = len(texts)
        total = np.maximum(np.bincount(rows, minlength=n), 1)
        hits = [np.bincount(rows[gain >= g], minlength=n) for g in LEVELS]
        return np.column_stack([np.ones(n), *(np.log1p(h) for h in hits), *(np.sqrt(h / total) for h in hits)])

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights, -30, 30)))


def _grams(text: bytes) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = len(raw) - GRAM + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(GRAM if n > 0 else 0):
        out = (out << np.uint64(8)) | raw[k:n + k]
    return out


def _doc_freq(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate([np.unique(_grams(b" " + b" ".join(t.split()) + b" ")) for t in texts]),
                     return_counts=True)


def _dictionary(size: int, samples: list[bytes], **how) -> bytes:
    while size >= 512:
        try:
            return zstandard.train_dictionary(size, samples, level=3, **how).as_bytes()
        except zstandard.ZstdError:          # too few samples for this size
            size //= 2
    return b"".join(samples)[:512]


def _windows(texts: list[bytes], words: int) -> list[bytes]:
    return [b" ".join(w[k:k + words]) for w in map(bytes.split, texts) for k in range(0, len(w), words)]


def fit(texts: list[str], toxic: list[int], ids: list[int]) -> Model:
    """Three quarters of the rows train the dictionaries, the rest calibrates."""
    y = np.array(toxic, bool)
    prior = float((y.sum() + 1) / (len(y) + 2))
    part = mix64(np.array(ids, np.int64).astype(np.uint64)) % np.uint64(4)
    raw = [t.encode() for t in texts]
    pick = lambda cls, learn: [b for b, c, p in zip(raw, y, part, strict=True)
                               if c == cls and (p != 0) == learn]
    bad, good = pick(True, True), pick(False, True)
    if min(len(bad), len(good)) < 10 or not pick(True, False) or not pick(False, False):
        return Model(prior)
    gram, count = _doc_freq(bad)
    other, freq = _doc_freq(good)
    at = np.minimum(np.searchsorted(other, gram), len(other) - 1)
    base = np.where(other[at] == gram, freq[at], 0)
    p1, p0, pool = count / len(bad), base / len(good), (count + base) / (len(bad) + len(good))
    z = (p1 - p0) / np.sqrt(pool * (1 - pool) * (1 / len(bad) + 1 / len(good)) + 1e-12)
    over = set(gram[(z > 4.5) & (p1 > 4 * p0) & (count >= 4)].tolist())
    marked: dict[bytes, bool] = {}
    samples = []
    for text in bad:
        for word in text.split():
            window = b" " + word[:WINDOW_BYTES] + b" "
            if window not in marked:
                marked[window] = not over.isdisjoint(_grams(window).tolist())
            if marked[window]:
                samples.append(window)
    if len(samples) < 10:
        return Model(prior)
    plain = _windows(good, 8)
    base_dict = _dictionary(ORDINARY_DICT, plain)
    toxic_dict = _dictionary(TOXIC_DICT, samples, k=32, d=6)
    filler = _dictionary(TOXIC_DICT, plain[:20_000], k=32, d=6).ljust(len(toxic_dict))[-len(toxic_dict):]
    model = Model(prior, base_dict + filler, base_dict + toxic_dict)

    rest = np.flatnonzero(part == 0)
    x = np.vstack([model.features(pa.array([texts[k]])) for k in rest])
    model.weights = _logistic(x, y[rest].astype(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 40) -> np.ndarray:
    """Newton's method with an L2 penalty on all weights but the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9),
                               x.T @ (y - p) - penalty * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _fold(col, folds: int):
    return F.crc32(col.cast("string").cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on labelled rows with ``crc32(doc_id as text) mod 5`` not 0.

    Rows with a null id, text or label are left out; of repeated labels of an
    id the largest counts.  If the labelled text of a class exceeds
    ``sample_bytes``, ids are thinned evenly by their hash to about that size.
    """
    marks = (labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
             .where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(_fold(F.col("doc_id"), 5) != 0)
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    rows = (docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
            .where("doc_id IS NOT NULL AND text IS NOT NULL"))
    sizes = {r["toxic"]: r["size"] for r in
             rows.select("doc_id", F.octet_length("text").alias("size")).join(marks, "doc_id")
             .groupBy("toxic").agg(F.sum("size").alias("size")).collect()}
    share = {k: min(1.0, sample_bytes / max(v, 1)) for k, v in sizes.items()}
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    limit = F.lit(0)
    for k, v in share.items():
        limit = F.when(F.col("toxic") == k, F.lit(round(v * 1_000_000))).otherwise(limit)
    chosen = marks.where(slot < limit)
    # thin the texts before the join moves them
    most = round(max(share.values(), default=0.0) * 1_000_000)
    got = rows.where(slot < most).join(chosen, "doc_id").dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
    sample = got["text"].to_pylist(), [int(t > 0) for t in got["toxic"].to_pylist()], got["doc_id"].to_pylist()
    del got
    model = fit(*sample)
    del sample
    give_back()         # the driver must not hold what the sample and its n-grams used
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    A null or empty text has no window: its score is what the calibration gives
    a text without hits.  A null id is scored too, with held_out null.  Repeated
    rows give a row each; other columns are ignored.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model.held()
        for part in slices(batches, 2):
            s = held.score(part.column(2))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"),
                         (_fold(docs[id_col].cast("long"), 5) == 0).alias("held_out"),
                         docs[text_col].cast("string").alias("text"))
    return small_batches(narrow).mapInArrow(run, SCHEMA)


def keep_ordinary(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose text scores under 0.5, all columns unchanged."""
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model.held()
        for part in slices(batches, at):
            yield part.filter(pa.array(held.score(part.column(at)) < 0.5))

    return small_batches(docs).mapInArrow(run, docs.schema)


def op4_zstd_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
