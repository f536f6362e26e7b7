"""Operator 8: token counts from a compiled finite-state tokenizer.

A SentencePiece BPE model is turned into a deterministic transducer over
characters.  Two facts make that exact for any merge order:

* a merge never crosses the border between two final tokens, so the encoding
  of a prefix is the encoding of a shorter prefix plus one last token;
* a sequence of tokens is the encoding of its text if and only if every two
  neighbours, encoded alone, stay as they are.

So the last token of every prefix is the one token that ends there and may
follow the last token of the prefix before it.  A state holds the suffix that
can still grow into a piece, with the last token and the relative token count
at each of its positions; a transition carries the change of the token count
(negative where tokens merge).  Piece lengths bound the states; they are
compiled when first met.

A text is cut into chunks.  A chunk's map takes the state before it to the
state after it and adds a count; behind its first word border the map no longer
depends on the incoming state.  Maps compose associatively, and a prefix scan
over the chunks gives the count at every chunk's end.  Words that lie whole in
one chunk start from the start state, so equal words of a slice run once.

Rows are independent: no shuffle.  The model (bounded size) goes to the tasks
as bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quarry.llm.common import hold, slices, small_batches, table

SPACE = "▁"
TOKENIZER = "piece_bpe_32k.model"
MAX_TOKENS = 4096
CHUNK_BYTES = 16 << 10
MAX_MODEL_BYTES = 64 << 20
MAX_STATES = 200_000        # compiled states kept per process; beyond it they are compiled anew
MAX_WORDS = 300_000         # word counts kept per process, likewise
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

START = 0


class Transducer:
    """Character transducer of a SentencePiece BPE model with byte fallback."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only identity normalisation with a leading blank is supported")
        if any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.score = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.grows = {p[:k] for p in self.score for k in range(1, len(p))}
        if any(a != SPACE and b == SPACE for p in self.score for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("a piece spans a word border")
        #: characters that take part in no merge: words end before and after them
        joined = {c for p in self.score if len(p) > 1 for c in p}
        self.lone_newline = "\n" not in joined
        self.reset()

    def reset(self) -> None:
        self.fits: dict[tuple[str, str], bool] = {}
        self.words: dict[str, int] = {}
        self.delta: list[dict[str, tuple[int, int]]] = [{}]
        self.state: list[tuple] = [("", ((0, None, 0),))]
        self.known: dict[tuple, int] = {self.state[0]: START}
        self.shared: dict[tuple, tuple] = {}

    def merge(self, text: str) -> list[str]:
        """Plain BPE: join the best-scored neighbours, leftmost first, until none joins."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, left: str | None, token: str) -> bool:
        key = (left or "", token)
        ok = self.fits.get(key)
        if ok is None:
            ok = self.fits[key] = self.merge(key[0] + token) == ([token] if left is None else [left, token])
        return ok

    def weight(self, token: str) -> int:
        return 1 if token in self.score else len(token.encode())   # byte fallback

    def compile(self, state: int, char: str) -> tuple[int, int]:
        suffix, past = self.state[state]
        found = None
        for back, left, count in past:                  # a token may start at each of these places
            token = suffix[len(suffix) - back:] + char
            if (back == 0 or token in self.score) and self.may_follow(left, token):
                if found:
                    raise AssertionError("two encodings of one prefix")
                found = token, count + self.weight(token)
        token, total = found
        share = self.shared.setdefault
        grown = [share(x := (0, token, 0), x)]
        for back, left, count in past:
            if suffix[len(suffix) - back:] + char in self.grows:
                grown.append(share(x := (back + 1, left, count - total), x))
        longest = max(b for b, _, _ in grown)
        key = ((suffix + char)[len(suffix) + 1 - longest:] if longest else "", tuple(grown))
        nxt = self.known.get(key)
        if nxt is None:
            nxt = self.known[key] = len(self.state)
            self.state.append(key)
            self.delta.append({})
        step = self.delta[state][char] = nxt, total
        return step

    def run(self, text: str, state: int = START) -> tuple[int, int]:
        """(state after the text, tokens gained), from a state within a word."""
        total, delta = 0, self.delta
        for char in text:
            step = delta[state].get(char) or self.compile(state, char)
            state = step[0]
            total += step[1]
        return state, total


class ChunkMap:
    """What a chunk does to (state, count).

    ``head`` is read from the incoming state.  If the chunk holds a word border,
    ``count`` tokens follow up to the chunk's end, where the state is ``state``
    whatever came in; otherwise ``state`` is None.
    """

    __slots__ = ("head", "count", "state")

    def __init__(self, head: str, count: int = 0, state: int | None = None):
        self.head, self.count, self.state = head, count, state

    def then(self, other: ChunkMap, fst: Transducer) -> ChunkMap:
        if self.state is None:
            return ChunkMap(self.head + other.head, other.count, other.state)
        state, gained = fst.run(other.head, self.state)
        if other.state is not None:
            state = other.state
        return ChunkMap(self.head, self.count + gained + other.count, state)

    def total(self, fst: Transducer) -> int:
        return fst.run(self.head, START)[1] + self.count


def prefix_scan(maps: list[ChunkMap], fst: Transducer) -> list[ChunkMap]:
    """Inclusive scan in log2(n) rounds; entry k maps the text's start to chunk k's end."""
    step = 1
    while step < len(maps):
        maps = maps[:step] + [maps[k - step].then(maps[k], fst) for k in range(step, len(maps))]
        step *= 2
    return maps


def count_tokens(texts: pa.Array, fst: Transducer, chunk_bytes: int = CHUNK_BYTES) -> np.ndarray:
    """Token count of each text (null or empty: 0)."""
    n = len(texts)
    if len(fst.state) > MAX_STATES:
        fst.reset()
    elif len(fst.words) > MAX_WORDS:
        fst.words.clear()
    texts = pc.fill_null(texts, "")
    # U+2581 in a text is read as a blank; every text that is not empty gets one in front
    marked = pc.replace_substring(texts, SPACE, " ")
    marked = pc.if_else(pc.equal(marked, ""), "", pc.binary_join_element_wise(" ", marked, ""))
    flat = marked.cast(pa.binary())
    end = np.cumsum(pc.binary_length(flat).to_numpy().astype(np.int64))
    if not len(end) or not end[-1]:
        return np.zeros(n, np.int64)
    data = np.frombuffer(b"".join(flat.to_pylist()), np.uint8)
    begin = np.r_[0, end[:-1]]

    space = data == 0x20
    border = space & ~np.r_[False, space[:-1]]
    if fst.lone_newline:
        newline = data == 0x0A
        border |= newline | np.r_[False, newline[:-1]]
    border[begin[begin < end]] = True
    # chunk cuts, moved to the next character border
    long = np.flatnonzero(end - begin > chunk_bytes)
    cuts = np.concatenate([np.arange(begin[d] + chunk_bytes, end[d], chunk_bytes) for d in long]) if len(long) \
        else np.zeros(0, np.int64)
    for _ in range(3):
        cuts = cuts + ((cuts < len(data)) & ((data[np.minimum(cuts, len(data) - 1)] & 0xC0) == 0x80))
    cuts = cuts[cuts < len(data)]
    cut = border.copy()
    cut[cuts] = True
    starts = np.flatnonzero(cut)
    hard = border[starts]
    whole = hard & np.r_[hard[1:], True]                     # a word that no cut divides
    offsets = pa.py_buffer(np.r_[starts, len(data)].astype(np.int32))
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, offsets, pa.py_buffer(data)])
    coded = words.filter(pa.array(whole)).dictionary_encode()
    seen, run = fst.words, fst.run
    each = np.array([seen[w] if w in seen else seen.setdefault(w, run(w)[1]) for w in
                     pc.replace_substring(coded.dictionary, " ", SPACE).to_pylist()], np.int64)
    row = np.searchsorted(end, starts, "right")              # the text of each word
    total = np.zeros(n, np.int64)
    if len(each):
        total += np.bincount(row[whole], each[coded.indices.to_numpy()], n).astype(np.int64)

    # texts with divided words: chunk maps and their scan
    parts = np.flatnonzero(~whole)
    chunk = np.searchsorted(cuts, starts, "right")
    text_of = dict(zip(parts.tolist(), pc.replace_substring(words.take(pa.array(parts)), " ", SPACE).to_pylist(),
                       strict=True)) if len(parts) else {}
    for d in np.unique(row[parts]).tolist():
        lo, hi = np.searchsorted(parts, [np.searchsorted(row, d), np.searchsorted(row, d, "right")])
        mine = parts[lo:hi].tolist()
        maps, by_chunk = [], {}
        for p in mine:
            by_chunk.setdefault(int(chunk[p]), []).append(p)
        for c in range(int(chunk[mine[0]]), int(chunk[mine[-1]]) + 1):
            got = by_chunk.get(c, [])
            head = "".join(text_of[p] for p in got if not hard[p])
            tail = [p for p in got if hard[p]]
            a, b = np.searchsorted(chunk, [c, c + 1])
            inner = bool((hard[a:b]).any())
            if tail:
                state, count = fst.run(text_of[tail[-1]], START)
                maps.append(ChunkMap(head, count, state))
            else:
                maps.append(ChunkMap(head, 0, START if inner else None))
        total[d] += prefix_scan(maps, fst)[-1].total(fst)
    return total


def token_counts(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text",
                 max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Bytes and tokens of every whole text, as the SentencePiece library counts them.

    A null or empty text has 0 bytes and 0 tokens.  Null ids and repeated rows
    give a row each; other columns are ignored.
    """
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError("the model is larger than MAX_MODEL_BYTES")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = sent.value
        fst = hold(("fst", data), lambda: Transducer(data))
        for part in slices(batches, 1):
            texts = part.column(1)
            tokens = count_tokens(texts, fst)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), pa.array(tokens),
                 pa.array(tokens > max_tokens)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return small_batches(narrow).mapInArrow(run, SCHEMA)


def model_bytes(name: str = TOKENIZER) -> bytes:
    """The bytes of a public model file; ``name`` may also be a path."""
    import os

    import public_tokenizers

    with open(name if os.path.sep in name else public_tokenizers.path(name), "rb") as f:
        return f.read()


def op8_fst_tokens(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), model_bytes())
