"""Operator 9: language identification with a byte convolutional network.

Filters of several widths slide over the bytes of a fixed-length window, the
largest response of each filter over the window is kept (max pooling), and a
softmax over the pooled responses gives the language.  A text's prediction is
the mean of its windows' log-probabilities; windows cover the whole text.

The network is trained in numpy (Adam, cross-entropy) on windows of a bounded
sample of labelled rows.  A filter of width w over one-hot bytes is a sum of w
table look-ups; neighbouring bytes are looked up in pairs.

Scoring is row by row, without a shuffle; the weights (a few hundred KB) go to
the tasks with the function.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import slices, small_batches, table

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
SAMPLE_BYTES = 8 << 20      # labelled text per language that the fit may use
TRAIN_WINDOWS = 24_000      # windows that the fit draws from it
STEPS, BATCH, RATE = 700, 128, 0.02
BLOCK = 1024                # windows scored at a time
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(windows of bytes, zero-padded; the row of each).  An empty text has one blank window."""
    raw = pc.fill_null(texts, "").cast(pa.binary())
    size = pc.binary_length(raw).to_numpy().astype(np.int64)
    count = np.maximum(1, -(-size // WINDOW))
    rows = np.repeat(np.arange(len(size)), count)
    out = np.zeros(int(count.sum()) * WINDOW, np.uint8)
    begin = (np.cumsum(count) - count) * WINDOW
    flat = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
    out[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(len(flat))] = flat
    return out.reshape(-1, WINDOW), rows


@dataclass
class Net:
    langs: list[str]
    tables: list[np.ndarray] = field(default_factory=list)   # per width: (width, 256, FILTERS)
    bias: list[np.ndarray] = field(default_factory=list)     # per width: (FILTERS,)
    out: np.ndarray | None = None                            # (features, languages)
    out_bias: np.ndarray | None = None

    def __post_init__(self):
        if not self.tables and self.langs:
            rng = np.random.default_rng(7)
            for w in WIDTHS:
                self.tables.append((rng.normal(0, 0.3, (w, 256, FILTERS))).astype(np.float32))
                self.bias.append(np.zeros(FILTERS, np.float32))
            size = FILTERS * len(WIDTHS)
            self.out = rng.normal(0, size ** -0.5, (size, len(self.langs))).astype(np.float32)
            self.out_bias = np.zeros(len(self.langs), np.float32)
        self._pairs = None

    def __getstate__(self):
        return {**self.__dict__, "_pairs": None}

    def responses(self, x: np.ndarray, k: int) -> np.ndarray:
        """Filter responses of the k-th width, (windows, positions, FILTERS)."""
        t, w = self.tables[k], WIDTHS[k]
        n = x.shape[1] - w + 1
        z = t[0][x[:, :n]]
        for j in range(1, w):
            z += t[j][x[:, j:n + j]]
        return z

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities of the windows; bytes are looked up in pairs."""
        if self._pairs is None:
            self._pairs = []
            for t in self.tables:
                w = len(t)
                pairs = [(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, w - 1, 2)]
                self._pairs.append((pairs, t[w - 1] if w % 2 else None))
        two = x[:, :-1].astype(np.intp) * 256 + x[:, 1:]
        pooled = []
        for k, w in enumerate(WIDTHS):
            n = WINDOW - w + 1
            pairs, single = self._pairs[k]
            z = pairs[0][two[:, :n]]
            for j, p in enumerate(pairs[1:], 1):
                z += p[two[:, 2 * j:2 * j + n]]
            if single is not None:
                z += single[x[:, w - 1:w - 1 + n]]
            pooled.append(np.maximum(z.max(1) + self.bias[k], 0))
        return self._softmax(np.concatenate(pooled, 1))

    def _softmax(self, feats: np.ndarray) -> np.ndarray:
        z = feats @ self.out + self.out_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        rng = np.random.default_rng(11)
        params = [*self.tables, *self.bias, self.out, self.out_bias]
        m = [np.zeros_like(p) for p in params]
        v = [np.zeros_like(p) for p in params]
        for step in range(1, STEPS + 1):
            at = rng.integers(0, len(x), BATCH)
            for p, g, mm, vv in zip(params, self._gradients(x[at], y[at]), m, v, strict=True):
                mm += 0.1 * (g - mm)
                vv += 0.01 * (g * g - vv)
                rate = RATE * (1 - step / (STEPS + 1))
                p -= rate * (mm / (1 - 0.9 ** step)) / (np.sqrt(vv / (1 - 0.99 ** step)) + 1e-7)
        self._pairs = None

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n, rows = len(x), np.arange(len(x))[:, None]
        best, pooled = [], []
        for k in range(len(WIDTHS)):
            z = self.responses(x, k)
            at = z.argmax(1)                                             # (windows, FILTERS)
            best.append(at)
            pooled.append(np.take_along_axis(z, at[:, None, :], 1)[:, 0] + self.bias[k])
        raw = np.concatenate(pooled, 1)
        feats = np.maximum(raw, 0)
        d = np.exp(self._softmax(feats))
        d[np.arange(n), y] -= 1
        d /= n
        back = (d @ self.out.T) * (raw > 0)
        tables, biases = [], []
        for k, w in enumerate(WIDTHS):
            g = back[:, k * FILTERS:(k + 1) * FILTERS]
            table_grad = np.zeros_like(self.tables[k])
            cols = np.broadcast_to(np.arange(FILTERS), g.shape)
            for j in range(w):
                np.add.at(table_grad[j], (x[rows, best[k] + j], cols), g)
            tables.append(table_grad)
            biases.append(g.sum(0))
        return [*tables, *biases, feats.T @ d, d.sum(0)]


def fit(texts: list[str], langs: list[str]) -> Net:
    """Train on windows drawn evenly over the languages (and over each one's windows)."""
    names = sorted(set(langs))
    net = Net(names)
    if len(names) < 2:
        return net
    rng = np.random.default_rng(5)
    xs, ys = [], []
    for k, name in enumerate(names):
        x, _ = windows(pa.array([t for t, g in zip(texts, langs, strict=True) if g == name]))
        pick = rng.integers(0, len(x), min(TRAIN_WINDOWS // len(names), 4 * len(x)))
        xs.append(x[pick])
        ys.append(np.full(len(pick), k))
    net.fit(np.concatenate(xs), np.concatenate(ys))
    return net


def _fold(col, folds: int):
    return F.crc32(col.cast("string").cast("binary")) % folds


def train(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> Net:
    """Fit on rows with text, lang and id whose ``crc32(doc_id as text) mod 4`` is not 2.

    A language with more than ``sample_bytes`` of text is thinned evenly by a
    hash of the id to about that size.
    """
    rows = (docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"),
                        docs["lang"].cast("string").alias("lang"))
            .where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL AND text <> ''")
            .where(_fold(F.col("doc_id"), 4) != 2))
    sizes = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size")).collect()
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    limit = F.lit(0)
    for r in sizes:
        share = min(1.0, sample_bytes / max(r["size"], 1))
        limit = F.when(F.col("lang") == r["lang"], F.lit(round(share * 1_000_000))).otherwise(limit)
    got = rows.where(slot < limit).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return fit(got["text"].to_pylist(), got["lang"].to_pylist())


def identify(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score (probability of the prediction) for every row.

    A null text, or one without a letter, is ``und`` with score 0; so is every
    text if no language was learned.  With one learned language it gets score 1.
    A null id is predicted too, with held_out null.  Repeated rows give a row
    each; other columns are ignored.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*net.langs, UNKNOWN])
        for part in slices(batches, 2, 1 << 20):
            known = part.column(3).to_numpy(zero_copy_only=False).astype(bool)
            n = part.num_rows
            if not net.langs:
                best, prob = np.zeros(n, np.int64), np.zeros(n)
            elif len(net.langs) == 1:
                best, prob = np.zeros(n, np.int64), np.ones(n)
            else:
                x, rows = windows(part.column(2))
                total = np.zeros((n, len(net.langs)))
                for at in range(0, len(x), BLOCK):
                    np.add.at(total, rows[at:at + BLOCK], net.log_probs(x[at:at + BLOCK]))
                mean = total / np.bincount(rows, minlength=n)[:, None]
                p = np.exp(mean - mean.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best, prob = p.argmax(1), p.max(1)
            known = known & bool(net.langs)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(names[np.where(known, best, len(net.langs))].tolist()),
                 pa.array(np.where(known, prob, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    text = docs[text_col].cast("string")
    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"),
                         (_fold(docs[id_col].cast("long"), 4) == 2).alias("held_out"), text.alias("text"),
                         F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return small_batches(narrow).mapInArrow(run, SCHEMA)


def op9_byte_cnn(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
