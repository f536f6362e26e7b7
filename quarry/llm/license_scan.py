"""Operator 13: licence scan by Aho-Corasick and licence expressions.

A text becomes its words (A-Z lower-cased; ASCII punctuation and blanks part
words), joined by single blanks.  One Aho-Corasick automaton finds every place
of every notice phrase and of the identifier tag in that stream, in one pass
whatever the number of phrases.  Behind a tag stands a licence expression: a
shunting-yard parser turns it into postfix order, and the postfix form is
evaluated with a stack, for the licences it names and for whether it can be
met by licences of a given set.

Rows are independent: one pass over the texts, no shuffle; a task holds one
Arrow slice of texts.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import slices, small_batches, table

#: The base: phrases (their words, one blank between) and labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: The method's own notices.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "isc license": "isc",
    "boost software license": "bsl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc0 1 0 universal": "cc0",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: Families of licence identifiers: an identifier belongs to the longest family that it equals or that it
#: continues with a version or a variant ("-2.0-only", "-3-clause").
FAMILIES = ("gpl", "lgpl", "agpl", "gfdl", "apache", "mit", "bsd", "isc", "mpl", "epl", "bsl", "cc-by", "cc-by-sa",
            "cc-by-nc", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd", "cc0", "unlicense", "zlib", "artistic", "0bsd")
PERMISSIVE = frozenset({"apache", "mit", "bsd", "isc", "bsl", "cc-by", "cc0", "unlicense", "zlib", "0bsd"})

#: Chance that a text with one phrase, notice or tag is not under that licence; independent places multiply.
DOUBT = 0.5

BREAKS = bytes(c if chr(c).isascii() and chr(c).isalnum() or c > 127 else 32 for c in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(rb"[ \t]*(?:([()])|([a-z0-9][a-z0-9.:+-]*))")
PRIORITY = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str | None:
    """Label of a licence identifier (lower case); a ``licenseref-`` name is its own; None if unknown."""
    name = identifier.rstrip("+")
    if re.fullmatch(r"(documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+", name):
        return name
    parts = name.split("-")
    for k in range(len(parts), 0, -1):
        if "-".join(parts[:k]) in FAMILIES:
            return "-".join(parts[:k])
    return None


def tokens(text: bytes) -> list[str]:
    """Tokens of the expression that ``text`` (lower case, one line) begins with.

    The expression ends before whatever cannot go on: another character, a
    second name in a row, an operator without a name behind it.
    """
    out, at, open_, want_name = [], 0, 0, True
    good = 0                                    # tokens up to the last place where the expression could end
    while found := TOKEN.match(text, at):
        token = (found[1] or found[2]).decode()
        if token in PRIORITY:
            if want_name:
                break
            want_name = True
        elif token == "(":
            if not want_name or (out and out[-1] == "with"):
                break
            open_ += 1
        elif token == ")":
            if want_name or not open_:
                break
            open_ -= 1
        elif not want_name:
            break
        else:
            want_name = False
        out.append(token)
        if not want_name and not open_:
            good = len(out)
        at = found.end()
    return out[:good]


def postfix(infix: list[str]) -> list[str]:
    """Shunting yard: WITH binds before AND, AND before OR; equal operators from left to right."""
    out, held = [], []
    for token in infix:
        if token in PRIORITY:
            while held and held[-1] != "(" and PRIORITY[held[-1]] >= PRIORITY[token]:
                out.append(held.pop())
            held.append(token)
        elif token == "(":
            held.append(token)
        elif token == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                raise ValueError("a closing bracket without an opening one")
            held.pop()
        else:
            out.append(token)
    if "(" in held:
        raise ValueError("an opening bracket without a closing one")
    return out + held[::-1]


def evaluate(rpn: list[str], allowed: frozenset[str] = PERMISSIVE) -> tuple[frozenset[str], bool]:
    """(labels of the licences named, whether the expression can be met by allowed licences alone).

    An OR offers a choice, an AND asks for both.  The right side of WITH names
    an exception: it gives no label and only grants more than its licence does.
    An unknown name gives no label and is not allowed.
    """
    stack: list[tuple[frozenset[str], bool]] = []
    for token in rpn:
        if token not in PRIORITY:
            label = family(token)
            stack.append((frozenset([label] if label else []), label in allowed))
            continue
        if len(stack) < 2:
            raise ValueError(f"{token} lacks a side")
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append(left)
        else:
            stack.append((left[0] | right[0], left[1] or right[1] if token == "or" else left[1] and right[1]))
    if len(stack) != 1:
        raise ValueError("not one expression")
    return stack[0]


@functools.lru_cache(maxsize=4)
def automaton(phrases: tuple[tuple[str, str], ...], notices: tuple[tuple[str, str], ...]):
    """Aho-Corasick over `` phrase ``, a blank on both sides, so that only whole words match.

    A value is (words of the phrase, base label or None, the method's label or None, is it the tag).
    """
    base, own = dict(phrases), dict(notices)
    found = ahocorasick.Automaton()
    for phrase in {**base, **own, TAG: None}:
        found.add_word(f" {phrase} ", (phrase.count(" ") + 1, base.get(phrase), own.get(phrase), phrase == TAG))
    found.make_automaton()
    return found


def scan_text(text: bytes, machine, allowed: frozenset[str] = PERMISSIVE) -> dict:
    """What one text holds: see scan_licenses."""
    lowered = text.lower()                                  # bytes: A-Z only
    words = lowered.translate(BREAKS).split()
    out = {"n_words": len(words), "n_base": 0, "first_word": None, "last_word": None, "base_labels": "",
           "labels": "", "score": 0.0, "n_notices": 0, "expressions": [], "permissive": None}
    if not words:
        return out
    stream = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace")
    hits = list(machine.iter(stream))
    if not hits:
        return out
    blanks = np.flatnonzero(np.frombuffer(stream.encode("utf-32-le"), np.uint32) == 32)
    base, own, starts, verdicts, places = set(), set(), [], [], None
    for end, (width, base_label, own_label, is_tag) in hits:
        start = int(np.searchsorted(blanks, end)) - width   # the phrase's last blank, counted back
        if base_label:
            base.add(base_label)
            starts.append(start)
        if own_label:
            own.add(own_label)
            out["n_notices"] += 1
        if is_tag:
            places = places or [m.end() for m in WORD.finditer(lowered)]
            line = lowered[places[start + width - 1]:].split(b"\n", 1)[0].split(b"\r", 1)[0]
            infix = tokens(line[1:]) if line[:1] == b":" else []
            if infix:
                labels, met = evaluate(postfix(infix), allowed)
                own |= labels
                verdicts.append(met)
                out["expressions"].append(" ".join(infix).replace("( ", "(").replace(" )", ")"))
    if verdicts or base or own:
        out["permissive"] = all(verdicts) if verdicts else (base | own) <= allowed
    if starts:
        out |= {"n_base": len(starts), "first_word": min(starts), "last_word": max(starts)}
    out["base_labels"], out["labels"] = ",".join(sorted(base)), ",".join(sorted(base | own))
    out["score"] = 1 - DOUBT ** (len(starts) + out["n_notices"] + len(verdicts))
    return out


KINDS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
         "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "n_notices": pa.int64(),
         "expressions": pa.list_(pa.string()), "permissive": pa.bool_()}
SCHEMA = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, n_notices long, expressions array<string>, permissive boolean")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None,
                  allowed: Iterable[str] = PERMISSIVE) -> DataFrame:
    """One row per input row: where licences are named, which, and whether ``allowed`` ones suffice.

    ``n_base`` counts all places of the base ``phrases`` (overlapping ones too),
    ``first_word``/``last_word`` are the least and greatest start (words from 0,
    null without a place), ``base_labels`` their labels and ``labels`` also those
    of the method's ``notices`` and licence expressions (distinct, sorted,
    comma-joined).  ``expressions`` lists the parsed expressions in order of
    place.  ``permissive``: every expression can be met, and without any
    expression every label is allowed; null if nothing was found.  ``score`` is
    1 - 0.5 ** (places of phrases, notices and expressions).

    A null or empty text has no word, no label and score 0; a tag without an
    expression counts for nothing.  Repeated rows and null ids are scanned like
    any other, other columns are ignored, an empty table gives an empty result.
    """
    known = tuple((PHRASES if phrases is None else phrases).items())
    extra = tuple((NOTICES if notices is None else notices).items())
    for phrase, label in known + extra:
        if phrase.encode().lower().translate(BREAKS).split() != phrase.encode().split(b" ") or "," in label:
            raise ValueError(f"a phrase must be lower-case words with single blanks, a label without comma: {phrase!r}")
    allowed = frozenset(allowed)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(known, extra)
        for part in slices(batches, 1):
            found = [scan_text(t.as_buffer().to_pybytes() if t.is_valid else b"", machine, allowed)
                     for t in part.column(1)]
            cols = [pa.array([f[name] for f in found], kind) for name, kind in KINDS.items()]
            yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["doc_id", *KINDS])

    narrow = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return small_batches(narrow).mapInArrow(run, f"doc_id {kind}, {SCHEMA}").withColumnRenamed("doc_id", id_col)


def op13_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).withColumn("expressions", F.array_join("expressions", "; "))
