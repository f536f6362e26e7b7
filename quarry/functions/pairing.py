"""Which part replaces which, by the positions of cues and part tokens.

A text is cut into sentences, and a sentence into its cues, part tokens and
*back words* ("to N from P") in text order.  A cue says where its old part
stands: before it ("P replaced by N") or after it ("phasing out P ... N").
Each cue takes the nearest tokens on its sides, so other codes in the sentence
do not matter, and a sentence with several cues gives several pairs.  Dates
such as ``Q4`` or ``FY26`` look like part numbers but are never parts here.

Column expressions only; every list is bound once (:func:`_let`), so a
sentence is searched once, whatever the number of its cues.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import CUE_PHRASES, DIRECTIONAL_CUES, PART_TOKEN_PATTERN

#: Cues whose old part comes after them; the other directional cues have it before them.
OLD_AFTER = ["retiring", "phasing out", "movement away from"]
OLD_BEFORE = [c for c in DIRECTIONAL_CUES if c not in OLD_AFTER]
#: The cue that may also close its clause: "P has N as provisional replacement".
CLOSING = ["provisional replacement"]
#: Between two parts behind a cue of new parts: the second one is the old part.
BACK_WORDS = ["from", "instead of", "over", "replacing"]
#: Codes that name a time.
CALENDAR = r"^(?:Q[1-4](?:[-/]?(?:FY|CY)?\d{2,4})?|(?:FY|CY)[-/]?\d{2,4}|H[12]|\d{4}[-/]?[QH][1-4])$"

_longest = lambda words: "|".join(sorted(words, key=len, reverse=True))
_ITEM = (rf"(?i:\b(?:{_longest(CUE_PHRASES)})\b)|{PART_TOKEN_PATTERN.replace('(', '(?:', 1)}"
         rf"|(?i:\b(?:{_longest(BACK_WORDS)})\b)")
_SENTENCE_END = r"(?<=[.!?])\s+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _items(sentence: Column) -> Column:
    """The cues, tokens and back words of a sentence in order: structs (i, v, kind)."""
    marked = F.regexp_replace(F.regexp_replace(sentence, "\x01", " "), _ITEM, "\x01$0\x01")

    def item(x: Column, i: Column) -> Column:
        low = F.lower(x)
        kind = (F.when(low.isin(CUE_PHRASES), F.lit("cue")).when(low.isin(BACK_WORDS), F.lit("back"))
                .when(x.rlike(CALENDAR), F.lit("date")).otherwise(F.lit("part")))
        return F.struct(i.alias("i"), F.when(kind == "part", x).otherwise(low).alias("v"), kind.alias("kind"))

    # every other piece of the split is an item, the rest is the text between
    return F.filter(F.transform(F.split(marked, "\x01"), item), lambda e: e["i"] % 2 == 1)


def _sentence_pairs(sentence: Column) -> Column:
    def of_kind(items: Column, kind: str) -> Column:
        return F.filter(items, lambda e: e["kind"] == kind)

    def between(things: Column, low: Column, high: Column, cues: list[str] | None = None) -> Column:
        """Whether one of ``things`` stands behind place ``low`` and before ``high`` (null: to the end)."""
        return F.exists(things, lambda e: (e["i"] > low) & (high.isNull() | (e["i"] < high))
                        & (e["v"].isin(cues) if cues else F.lit(True)))

    def pair(cue: Column, found: Column) -> Column:
        sides = F.struct(F.filter(found["parts"], lambda t: t["i"] < cue["i"]).alias("left"),
                         F.filter(found["parts"], lambda t: t["i"] > cue["i"]).alias("right"))

        def choose(side: Column) -> Column:
            n = F.size(side["left"])
            left, before_left = F.get(side["left"], n - 1), F.get(side["left"], n - 2)
            first, second, third = (F.get(side["right"], F.lit(k)) for k in range(3))
            back = F.coalesce(between(found["backs"], first["i"], second["i"]) & second["i"].isNotNull(), F.lit(False))
            # the next part belongs to the next cue: "phasing out P, while A is replaced by B"
            owned = between(found["cues"], second["i"], third["i"], OLD_BEFORE) & \
                ~between(found["cues"], first["i"], second["i"])
            # the last part was adopted by the cue before: "P replaced by N, phasing out A"
            adopted = F.exists(found["cues"], lambda e: e["v"].isin(OLD_BEFORE) & (e["i"] < left["i"])
                               & (before_left["i"].isNull() | (e["i"] > before_left["i"])))
            after = cue["v"].isin(OLD_AFTER)
            closing = cue["v"].isin(CLOSING) & first["i"].isNull()
            old = F.when(after, first["v"]).when(closing, before_left["v"]).when(back, second["v"]).otherwise(left["v"])
            new = (F.when(after & second["i"].isNotNull() & ~F.coalesce(owned, F.lit(False)), second["v"])
                   .when(after, F.when(~F.coalesce(adopted, F.lit(False)), left["v"]))
                   .when(closing, left["v"]).otherwise(first["v"]))
            return F.struct(old.alias("old_part"), new.alias("new_part"), cue["v"].alias("cue_phrase"))

        return _let(sides, choose)

    def pairs(items: Column) -> Column:
        lists = F.struct(of_kind(items, "cue").alias("cues"), of_kind(items, "part").alias("parts"),
                         of_kind(items, "back").alias("backs"))
        return _let(lists, lambda found: F.transform(
            F.filter(found["cues"], lambda c: c["v"].isin(DIRECTIONAL_CUES)), lambda c: pair(c, found)))

    return _let(_items(sentence), pairs)


def replacement_pairs(text: Column) -> Column:
    """array<struct<old_part, new_part, cue_phrase>>: complete pairs in text order, each once with its first cue."""
    every = F.flatten(F.transform(F.split(text, _SENTENCE_END), _sentence_pairs))
    whole = F.filter(every, lambda p: p["old_part"] != p["new_part"])       # null: a side is missing
    return _let(whole, lambda ps: F.filter(ps, lambda p, k: ~F.exists(
        F.slice(ps, F.lit(1), k), lambda q: (q["old_part"] == p["old_part"]) & (q["new_part"] == p["new_part"]))))
