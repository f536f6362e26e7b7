"""Bounds that lose no close match, few scored pairs, results equal to difflib."""
import difflib
import random

import numpy as np
import pandas as pd
import pytest

from quarry.functions.similarity import score
from quarry.operators import close_cells as CC
from quarry.operators.resolve import bulk_resolve


def check(spark, needles, values, **kw):
    got = {r.needle: r for r in bulk_resolve(
        spark.createDataFrame([(n,) for n in needles], "n string").repartition(3), "n",
        spark.createDataFrame([(v,) for v in values], "v string").repartition(3), "v", **kw).collect()}
    assert set(got) == set(needles)
    lower = {v.lower() for v in values}
    for n in set(needles):
        if n.lower() in lower:
            assert got[n].match_kind in ("exact", "case")
        else:
            best = difflib.get_close_matches(n.lower(), sorted(lower), n=1, cutoff=0.6)
            assert [got[n].resolved.lower()] == best if best else got[n].resolved is None, n
            assert got[n].match_kind == ("fuzzy" if best else "none")
    return got


@pytest.mark.parametrize("alphabet,top", [("abc", 9), ("etaoinshrdlu qz-7", 14), ("ABCDEFGHJKLMNPRSTUVWXYZ0123456789", 11)])
def test_equals_difflib_on_random_strings(spark, alphabet, top):
    rng = random.Random(alphabet)
    weights = [1 / (k + 1) for k in range(len(alphabet))]
    make = lambda: "".join(rng.choices(alphabet, weights, k=rng.randint(1, top)))
    check(spark, [make() for _ in range(150)], [make() for _ in range(220)], cell_rows=25)


def test_odd_strings(spark):
    values = ["", "a", "é" * 40, "日本語テキスト", "x" * 300, "y" * 250 + "z" * 20, "Open WorkOrder", "open workorder", "😀😀b"]
    needles = ["", "b", "é" * 39, "日本語テスト", "x" * 280, "x" * 600, "y" * 260, "open work order", "😀b", "aa", "z" * 64]
    got = check(spark, needles, values)
    assert got["x" * 280].match_kind == "fuzzy" and got["y" * 260].match_kind == "fuzzy"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], old + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_bounds_are_exact_and_never_below_the_score():
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdé") for _ in range(rng.randint(0, 70))) for _ in range(60)] + [""]
    cell = CC.Candidates(texts)
    every = np.arange(len(texts))
    for needle in [t[:64] for t in texts[:25]] + ["", "zzz", "a" * 64]:
        points = CC.code_points(needle)
        counted, ordered = cell.count_bound([points])[0], cell.subsequence_bound(points, every)
        for text, by_counts, by_order in zip(texts, counted, ordered):
            assert by_order == pytest.approx(2 * lcs(needle, text) / max(len(needle) + len(text), 1))
            real = score(needle, text, 0.0) if needle or text else 0.0
            assert real <= by_order + 1e-9 <= by_counts + 2e-9


def test_few_pairs_reach_the_scorer():
    """Two-word names of natural letters: the scorer sees a small part of what character counts let through."""
    rng = random.Random(4)
    letters, weights = "etaoinshrdlcumwfgypbvkjxqz", [12, 9, 8, 7.5, 7, 6.7, 6.3, 6, 6, 4, 4, 2.8, 2.8, 2.4, 2.4, 2.2, 2, 2, 1.9,
                                                      1.5, 1, .8, .15, .15, .1, .07]
    word = lambda: "".join(rng.choices(letters, weights, k=rng.randint(3, 9)))
    values = sorted({f"{word()} {word()}" for _ in range(1500)})
    needles = [v[:-1] + "x" if k % 2 else f"{word()} {word()}" for k, v in enumerate(values[:200])]
    scored: list = []
    got = CC.best_in_cell(pd.DataFrame({"needle": needles, "ln": needles}), pd.DataFrame({"lv": values, "canon": values}),
                          0.6, scored)
    passed = int((CC.Candidates(values).count_bound([CC.code_points(n) for n in needles]) >= 0.6).sum())
    print("pairs", len(needles) * len(values), "after counts", passed, "scored", len(scored), "rows out", len(got))
    assert len(scored) * 10 < passed and len(got) <= len(needles)
