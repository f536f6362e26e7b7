"""Text clean-up and token expressions.

All of these are JVM-side column expressions except entity unescaping,
which has no built-in; it runs as an Arrow pandas UDF and only sees rows
that actually contain ``&`` (other rows are fed NULL, see ``unescape``).
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The tag pattern and the Python ``str.isspace`` character set
# (what Python's Unicode ``\s`` matches), written out because Java's ``\s``
# is ASCII-only and ``(?U)\s`` lacks U+001C..U+001F.
TAG_PATTERN = r"<[^>]+>"
PY_WHITESPACE = (r"[\t\n\x0b\x0c\r \x1c-\x1f\x85\xa0\u1680\u2000-\u200a"
                 r"\u2028\u2029\u202f\u205f\u3000]+")

# Fixed value: part-number token rule ("alphanumeric codes with possible dots,
# slashes, underscores, dashes" that mix letters and digits).
PART_TOKEN_PATTERN = (r"\b([A-Z][A-Z0-9._/-]*[0-9][A-Z0-9._/-]*"
                      r"|[0-9][A-Z0-9._/-]*[A-Z][A-Z0-9._/-]*)\b")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_tags(c: Column | str) -> Column:
    """Every ``<...>`` run becomes one space (not HTML-aware)."""
    return F.regexp_replace(_col(c), TAG_PATTERN, " ")


@F.pandas_udf(T.StringType())
def _unescape_batch(s: pd.Series) -> pd.Series:
    return s.map(lambda v: html.unescape(v) if isinstance(v, str) else None)


# Declared nondeterministic on purpose: Catalyst then never pushes a filter
# on derived columns (intent, parts, ...) below the projection that calls
# Python, which would evaluate the whole clean-up twice.  Filter the input
# *before* cleaning to keep scan pushdown.
_unescape_udf = _unescape_batch.asNondeterministic()


def unescape(c: Column | str) -> Column:
    """One-pass HTML5 entity unescape (numeric and named, longest prefix).

    Spark evaluates a Python UDF for every input row even under ``when``, so
    rows without ``&`` are handed to it as NULL and coalesced back.
    """
    c = _col(c)
    return F.coalesce(_unescape_udf(F.when(c.contains("&"), c)), c)


def collapse_ws(c: Column | str) -> Column:
    """Runs of Python-Unicode whitespace become one space, then trim."""
    return F.trim(F.regexp_replace(_col(c), PY_WHITESPACE, " "))


def clean_text(c: Column | str) -> Column:
    """T4: strip tags, unescape entities, collapse whitespace; NULL -> ''."""
    c = _col(c)
    return F.coalesce(collapse_ws(unescape(strip_tags(c))), F.lit(""))


def is_blank(c: Column | str) -> Column:
    """F7 gate: NULL or whitespace-only *raw* text is not processed."""
    c = _col(c)
    return c.isNull() | (F.regexp_replace(c, PY_WHITESPACE, "") == "")


def prompt_payload(cleaned: Column | str) -> Column:
    """T5: the user message body sent to a model."""
    return F.concat(F.lit("TEXT:\n"), _col(cleaned))


def part_tokens(c: Column | str) -> Column:
    """Part-number-looking tokens in text order (array<string>)."""
    return F.regexp_extract_all(_col(c), F.lit(PART_TOKEN_PATTERN), 1)


# The replacement cue lexicon (15 phrases, reference order).
CUE_PHRASES = [
    "replaced by", "retiring", "transition to", "path forward", "alternative",
    "focused on", "under evaluation", "current consideration", "no longer viable",
    "phasing out", "in favor of", "shifted toward", "movement away from",
    "sourcing review introduced", "provisional replacement",
]
# [ours] Cues that name a direction (old part first, new part after).  The
# rest signal intent without saying which part replaces which.
DIRECTIONAL_CUES = [
    "replaced by", "retiring", "transition to", "path forward", "no longer viable",
    "phasing out", "in favor of", "shifted toward", "movement away from",
    "sourcing review introduced", "provisional replacement",
]


def first_cue(c: Column | str) -> Column:
    """The earliest cue phrase in the (lower-cased) text, else NULL.

    Ties at one position go to the longer phrase.  Pure expressions: one
    ``instr`` per cue, min over a struct array.
    """
    low = F.lower(_col(c))
    hits = F.array(*[
        F.struct(F.instr(low, F.lit(p)).alias("pos"),
                 F.lit(-len(p)).alias("neg_len"), F.lit(p).alias("cue"))
        for p in CUE_PHRASES])
    found = F.filter(hits, lambda h: h["pos"] > 0)
    return F.when(F.size(found) > 0, F.array_min(found)["cue"])


def is_directional(cue: Column | str) -> Column:
    return _col(cue).isin(DIRECTIONAL_CUES)
