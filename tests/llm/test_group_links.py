"""Links inside large groups: whole components from rows that grow with the members, not with their pairs."""

import random

from quarry.llm import hamming_minhash as h


def _texts(members=60):
    """A centre, ``members`` near copies of a text that shares half of the centre, and some on their own."""
    words = [f"w{k}" for k in range(100)]
    other = words[:50] + [f"v{k}" for k in range(50)]
    texts = {0: " ".join(words)}
    rng = random.Random(5)
    for k in range(1, members + 1):
        mine = list(other)
        mine[rng.randrange(60, 100)] = f"own{k}"
        texts[k] = " ".join(mine)
    for k in range(members + 1, members + 6):
        texts[k] = " ".join(words[:50] + [f"z{k}x{j}" for j in range(50)])
    return texts


def _shingles(text):
    words = text.split()
    return set(zip(words, words[1:], strict=False))


def test_links_of_a_large_group_connect_it_without_all_its_pairs(spark):
    texts = _texts()
    frame = spark.createDataFrame(list(texts.items()), "node long, text string")
    groups = spark.createDataFrame([(0, k, k) for k in texts], "centre long, node long, comp long")
    links = {tuple(r) for r in h._around_centres(groups, frame, 2, 80, 100).collect()}
    assert len(links) <= 4 * len(texts)                        # all pairs, both ways: 3540
    for a, b in links:
        x, y = _shingles(texts[a]), _shingles(texts[b])
        assert 100 * len(x & y) >= 80 * len(x | y)
    comps = {r.node: r.comp for r in h.components(spark.createDataFrame(list(links), "a long, b long")).collect()}
    assert comps == {k: 1 for k in range(1, 61)}


def test_links_that_stars_miss_are_found(spark, monkeypatch):
    """Without stars the pairs at their first common difference give the same components."""
    monkeypatch.setattr(h, "STARS", 0)
    texts = _texts(20)
    frame = spark.createDataFrame(list(texts.items()), "node long, text string")
    groups = spark.createDataFrame([(0, k, k) for k in texts], "centre long, node long, comp long")
    links = h._around_centres(groups, frame, 2, 80, 100)
    assert {r.node: r.comp for r in h.components(links).collect()} == {k: 1 for k in range(1, 21)}
