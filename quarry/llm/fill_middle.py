"""Operator 11: fill-in-the-middle examples by a piece table.

A document is a list of *pieces*: descriptors (buffer, start, length) over
buffers that never change, the text itself and the sentinels.  Cutting a text
at two line borders splits its one piece into three; an arrangement is a
permutation of those pieces with sentinel pieces between them; the text comes
back through the inverse permutation.  Nothing is copied to arrange or to
hash: a digest reads the described bytes piece by piece.

Cuts and forms are drawn from a hash of the seed and the row's id, so a row
gives the same example wherever and however often it runs.  Rows are
independent: one pass, no shuffle; a task holds one Arrow slice of texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import slices, small_batches, table

SEED = 7
FIM_PERCENT = 100       # of the documents that can be cut
SPM_PERCENT = 50        # of those: suffix first; the rest: prefix first
SENTINELS = ("<P>", "<S>", "<M>")

TEXT, MARKS = 0, 1      # buffers
PREFIX, MIDDLE, SUFFIX = 0, 1, 2
#: Order of the parts in each form.
FORMS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: Sentinel (index into SENTINELS) that stands before a part.
MARK_OF = {PREFIX: 0, SUFFIX: 1, MIDDLE: 2}

PIECE = "struct<buffer:string,start:long,length:long>"


class PieceTable:
    """Descriptors over immutable byte buffers."""

    __slots__ = ("buffers", "pieces")

    def __init__(self, buffers: tuple, pieces: list[tuple[int, int, int]]):
        self.buffers, self.pieces = buffers, pieces

    @classmethod
    def of(cls, text: bytes, marks: bytes = b"") -> PieceTable:
        return cls((text, marks), [(TEXT, 0, len(text))])

    def cut(self, offsets: Iterable[int]) -> PieceTable:
        """Pieces split at byte offsets of the whole (ascending); an offset at a border gives an empty piece."""
        out, todo, at = [], list(offsets), 0
        for buffer, start, length in self.pieces:
            while todo and todo[0] <= at + length:
                here = todo.pop(0) - at
                out.append((buffer, start, here))
                start, length, at = start + here, length - here, at + here
            out.append((buffer, start, length))
            at += length
        return PieceTable(self.buffers, out)

    def take(self, order: Iterable[int]) -> PieceTable:
        return PieceTable(self.buffers, [self.pieces[k] for k in order])

    def put_before(self, extra: list[tuple[int, int, int]]) -> PieceTable:
        """One extra piece before each piece."""
        return PieceTable(self.buffers, [p for pair in zip(extra, self.pieces, strict=True) for p in pair])

    def views(self) -> Iterator[memoryview]:
        for buffer, start, length in self.pieces:
            yield memoryview(self.buffers[buffer])[start:start + length]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for view in self.views():
            digest.update(view)
        return digest.hexdigest()

    def read(self) -> bytes:
        return b"".join(self.views())


def _check(sentinels: tuple[str, str, str]) -> tuple[bytes, list[tuple[int, int, int]]]:
    """The sentinel buffer and its pieces; sentinels must be found again wherever they stand next to text."""
    marks = [s.encode() for s in sentinels]
    if len(marks) != 3 or not all(marks) or len(set(marks)) != 3:
        raise ValueError("three different sentinels must be given")
    if any(m[:1] in other[1:] for m in marks for other in marks):
        raise ValueError("the first character of a sentinel must not occur inside one")
    ends = np.cumsum([len(m) for m in marks])
    return b"".join(marks), [(MARKS, int(e) - len(m), len(m)) for m, e in zip(marks, ends, strict=True)]


def line_ends(text: bytes) -> np.ndarray:
    """Byte offset after each line; a line ends at its newline or at the end of the text."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return ends if not text or text.endswith(b"\n") else np.r_[ends, len(text)]


def chars(text: bytes, piece: tuple[int, int, int]) -> int:
    """Code points of a piece of ``text``."""
    part = np.frombuffer(text, np.uint8)[piece[1]:piece[1] + piece[2]]
    return int(np.count_nonzero((part & 0xC0) != 0x80))


def arrange(text: bytes, draws: tuple[int, int, int, int], marks: bytes, mark_pieces: list,
            fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> tuple[int, str, PieceTable, PieceTable]:
    """(lines, form, the three parts, the arranged pieces); a plain text has one part, itself."""
    ends, whole = line_ends(text), PieceTable.of(text, marks)
    n = len(ends)
    if not text or draws[2] % 100 >= fim_percent \
            or any(marks[s:s + length] in text for _, s, length in mark_pieces):
        return n, "plain", whole, whole
    form = "spm" if draws[3] % 100 < spm_percent else "psm"
    cuts = sorted(d % (n + 1) for d in draws[:2])
    parts = whole.cut([int(ends[k - 1]) if k else 0 for k in cuts])
    order = FORMS[form]
    return n, form, parts, parts.take(order).put_before([mark_pieces[MARK_OF[k]] for k in order])


def rebuild(output: bytes, form: str, marks: bytes, mark_pieces: list) -> PieceTable:
    """The text's pieces, over the output as the buffer: found sentinels cut it, the inverse permutation orders it."""
    if form == "plain":
        return PieceTable.of(output)
    order, found, at = FORMS[form], [], 0
    for k in order:
        _, start, length = mark_pieces[MARK_OF[k]]
        at = output.find(marks[start:start + length], at)
        if at < 0:
            raise ValueError(f"an output of form {form} lacks a sentinel")
        found += [at, at + length]
        at += length
    # cut() gives: nothing, sentinel, part, sentinel, part, sentinel, part
    cut = PieceTable.of(output).cut(found)
    back = [order.index(part) for part in (PREFIX, MIDDLE, SUFFIX)]
    return cut.take([2 * k + 2 for k in back])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
                   fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT,
                   sentinels: tuple[str, str, str] = SENTINELS, outputs: bool = True) -> DataFrame:
    """One fill-in-the-middle example per input row.

    Columns: the id, ``n`` (lines), ``form`` (plain, psm, spm), ``prefix_chars``
    and ``middle_chars`` (null if plain), ``output_sha256`` (streamed over the
    arranged pieces), ``restored_sha256`` (of the text rebuilt from the output's
    bytes and the form); with ``outputs`` also ``output`` (the example) and
    ``pieces`` (its descriptors).

    A null text is empty, an empty text is plain with n = 0, a text that holds a
    sentinel is plain.  A null id draws by the seed alone.  Repeated rows give
    equal examples, other columns are ignored whatever their names, an empty
    table gives an empty result.
    """
    marks, mark_pieces = _check(sentinels)
    draw = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), F.lit("")))
                              .cast("binary"), 256), 1, 32)
    names = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output", "pieces"]
    piece = pa.struct([("buffer", pa.string()), ("start", pa.int64()), ("length", pa.int64())])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(piece)]
    width = len(names) if outputs else len(names) - 2

    def one(text: bytes, hashed: str) -> tuple:
        draws = tuple(int(hashed[k:k + 8], 16) for k in range(0, 32, 8))
        n, form, parts, arranged = arrange(text, draws, marks, mark_pieces, fim_percent, spm_percent)
        output = text if form == "plain" else arranged.read()
        sizes = (None, None) if form == "plain" else (chars(text, parts.pieces[PREFIX]),
                                                      chars(text, parts.pieces[MIDDLE]))
        row = (n, form, *sizes, arranged.sha256(), rebuild(output, form, marks, mark_pieces).sha256())
        return row if not outputs else (*row, output.decode("utf-8", "replace"),
                                        [(("text", "sentinels")[b], s, length) for b, s, length in arranged.pieces])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            rows = [one(b"" if not t.is_valid else t.as_buffer().to_pybytes(), d.as_py())
                    for t, d in zip(part.column(2), part.column(1), strict=True)]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds[:width], strict=True)] if rows \
                else [pa.array([], k) for k in kinds[:width]]
            yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["doc_id", *names[:width]])

    narrow = docs.select(docs[id_col].alias("doc_id"), draw.alias("draw"), docs[text_col].cast("string").alias("text"))
    schema = f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, n long, form string, prefix_chars long, " \
        "middle_chars long, output_sha256 string, restored_sha256 string"
    made = small_batches(narrow).mapInArrow(run, f"{schema}, output string, pieces array<{PIECE}>" if outputs else schema)
    return made.withColumnRenamed("doc_id", id_col)


def restore(examples: DataFrame, output_col: str = "output", form_col: str = "form", name: str = "text",
            sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """All rows and columns of ``examples`` and, as ``name``, the text each was made from.

    A null output or form gives null; a column called ``name`` is replaced.  An
    output without its form's sentinels ends the job with an error.
    """
    marks, mark_pieces = _check(sentinels)

    @F.pandas_udf("string")
    def back(output, form):
        return output.combine(form, lambda o, f: None if o is None or f is None else
                              rebuild(o.encode(), f, marks, mark_pieces).read().decode())

    return small_batches(examples).withColumn(name, back(F.col(f"`{output_col}`"), F.col(f"`{form_col}`")))


def op11_fill_middle(spark, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents"), outputs=False)


ORACLE = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines,
    ('0x' || substr(h, 1, 8))::bigint AS h1, ('0x' || substr(h, 9, 8))::bigint AS h2,
    ('0x' || substr(h, 17, 8))::bigint AS h3, ('0x' || substr(h, 25, 8))::bigint AS h4
  FROM (SELECT *, sha256('7:' || coalesce(doc_id::varchar, '')) AS h FROM documents)),
counted AS (
  SELECT *, len(lines) - CASE WHEN text = '' OR lines[len(lines)] = '' THEN 1 ELSE 0 END AS n,
    text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 AS plain
  FROM cut),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM counted),
ends AS (
  SELECT *, CASE WHEN a = n THEN length(text) ELSE a + coalesce(list_sum([length(x) for x in lines[1:a]]), 0) END AS pa,
    CASE WHEN b = n THEN length(text) ELSE b + coalesce(list_sum([length(x) for x in lines[1:b]]), 0) END AS pb
  FROM cuts),
parts AS (
  SELECT *, left(text, pa::bigint) AS prefix, substr(text, (pa + 1)::bigint, (pb - pa)::bigint) AS middle,
    substr(text, (pb + 1)::bigint) AS suffix FROM ends)
SELECT doc_id, n::bigint AS n, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN pa::bigint END AS prefix_chars, CASE WHEN NOT plain THEN (pb - pa)::bigint END AS middle_chars,
  sha256(CASE WHEN plain THEN text WHEN h4 % 100 < 50 THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
    ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
