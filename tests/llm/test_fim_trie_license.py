"""Fill-in-the-middle, prefix trie and licence scan against plain brute force."""
import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm import fill_middle as FM
from quarry.llm import license_scan as LS
from quarry.llm import prefix_trie as PT
from quarry.session import discard, materialize
from tests.conftest import SF001, SF01

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# ---------------------------------------------------------------- 11

def plain_fim(doc_id, text, fim=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(sha(f"{seed}:{'' if doc_id is None else doc_id}")[k:k + 8], 16) for k in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, None)))
    if h[3] % 100 < spm:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


ODD = ["", None, "\n", "\n\n\n", "one line", "one line\n", "a\nb\nc", "é\nßü\n漢字\n😀", "has <S> in it\nx", "<P", "<\nP>\n<S\n>",
       "\r\n\r\nx\r", "a\x00b\nc", "x" * 300_000 + "\n" + "y\n" * 50_000, "<<<\n<\n<M\n"]


def test_fim_equals_brute_force(spark):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab\n<P>é") for _ in range(rng.randrange(60))) for _ in range(400)]
    rows = [(k, t, "clash", k) for k, t in enumerate(texts)] + [(None, "null\nid\n", "x", 0), (5, texts[5], "twin", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(3)
    for fim, spm in ((100, 50), (40, 10)):
        got = FM.fill_in_middle(docs, fim_percent=fim, spm_percent=spm).collect()
        want = [(k, *plain_fim(k, t, fim, spm)) for k, t, *_ in rows]
        assert sorted(map(repr, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got))) \
            == sorted(map(repr, want))
        by_id = {k: t or "" for k, t, *_ in rows}
        for r in got:
            assert r.output_sha256 == sha(r.output) and r.restored_sha256 == sha(by_id[r.doc_id])
            buffers = {"text": by_id[r.doc_id].encode(), "sentinels": b"<P><S><M>"}
            assert b"".join(buffers[p.buffer][p.start:p.start + p.length] for p in r.pieces).decode() == r.output


def test_fim_round_trip_from_stored_outputs(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    made = FM.fill_in_middle(docs).withColumn("text", F.lit("replaced"))
    back = FM.restore(made).select("doc_id", "text").join(
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("was")), "doc_id")
    assert back.count() == docs.count() and back.where("text <> was").count() == 0
    lost = spark.createDataFrame([(None, "psm"), ("x", None)], "output string, form string")
    assert [r.text for r in FM.restore(lost).collect()] == [None, None]


def test_fim_other_sentinels_and_empty_table(spark):
    docs = spark.createDataFrame([(k, "aa\nbb\ncc\n") for k in range(20)], "doc_id string, text string")
    marks = ("<|pre|>", "<|suf|>", "<|mid|>")
    made = FM.fill_in_middle(docs, sentinels=marks)
    assert {r.text for r in FM.restore(made, sentinels=marks).collect()} == {"aa\nbb\ncc\n"}
    assert FM.fill_in_middle(docs.limit(0)).count() == 0
    for bad in (("a", "a", "b"), ("", "x", "y"), ("<<", "<", "x")):
        with pytest.raises(ValueError):
            FM.fill_in_middle(docs, sentinels=bad)


def test_op11_columns(spark):
    got = FM.op11_fill_middle(spark, SF001)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    assert got.columns[:7] == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    for r in got.collect():
        *head, output = plain_fim(r.doc_id, docs[r.doc_id])
        assert tuple(r) == (r.doc_id, *head, sha(output), sha(docs[r.doc_id] or ""))


# ---------------------------------------------------------------- 12

def plain_trie(rows, group=5, heads=9):
    """rows: (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs[c].append(((turn is not None, turn or 0), role, tie, text))
    turns = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in convs.items()}
    again = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (abs(c) % group) * (1 if c >= 0 else -1)
        again[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(again):
        for d in range(len(again[c]) + 1):
            members[again[c][:d]].append(c)
        ends[again[c]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = sum(saved[k] for k in children[node]) + \
            ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
        out.append((members[node][0], len(node), members[node[:-1]][0] if node else None, len(members[node]),
                    len(children[node]), leaves[node], saved[node], sha(",".join(map(str, ends[node])))))
    return sorted(out, key=repr)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
KIND = "conv_id long, turn long, role string, text string"


def nodes_of(frame, **kw):
    return sorted((tuple(r) for r in PT.prefix_trie(frame, **kw).select(*TRIE).collect()), key=repr)


def test_trie_equals_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for c in [*range(-12, 60), 100, 101, 103, 10 ** 12 + 7, 2 ** 62, -5_000]:
        for turn in range(rng.choice([1, 2, 3, 3, 5, 9, 14])):
            rows.append((c, rng.choice([turn, turn, turn, None]) if rng.random() < .1 else turn,
                         rng.choice(["user", "user", "user", None]), rng.choice(["a", "a", "a", "é", "", None, "bb"])))
    rows += rows[5:9]                                            # repeated rows
    rows += [(None, 0, "user", "no conversation"), (None, None, None, None)]
    frame = spark.createDataFrame(rows, KIND).withColumns({"conv": F.lit(1), "depth": F.lit("clash"), "a": F.lit(2)})
    assert nodes_of(frame.repartition(3)) == plain_trie(rows)


def test_trie_of_equal_and_turnless_conversations(spark):
    # 8001.. have no base and fewer turns than their heads now and then: members of the root alone
    rows = [(c, t, "u", f"t{t}") for c in range(5, 6000, 5) for t in range(3)]
    rows += [(c, 0, "u", "x") for c in (8001, 8002, 8003, 8004, 9001, 9002, 9003)]
    got = nodes_of(spark.createDataFrame(rows, KIND))
    assert got == plain_trie(rows)
    root = next(r for r in got if r[1] == 0)
    assert root[3] == 1199 + 7 and root[2] is None


def test_trie_of_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(PT, "STRETCH", 16)
    rows = [(c, t, "u", "same" if t < 170 else f"{c}-{t}") for c in (0, 3, 7, 10) for t in range(200 + c)]
    rows += [(20, 7, "u", f"tied {k}") for k in range(60)]       # more ties than a stretch has turns
    assert nodes_of(spark.createDataFrame(rows, KIND)) == plain_trie(rows)


def test_trie_empty_other_columns_and_last_turn(spark):
    empty = spark.createDataFrame([], KIND)
    assert nodes_of(empty) == []
    rows = [(0, 0, "u", "hi"), (0, 1, "s", None), (1, 0, "u", "hi")]
    frame = spark.createDataFrame(rows, "`c.id` int, at int, who string, said string")
    nodes = PT.prefix_trie(frame, "c.id", "at", "who", "said", group=1, heads=1)
    assert sorted((tuple(r) for r in nodes.select(*TRIE).collect()), key=repr) == plain_trie(rows, 1, 1)
    said = {(r.conv_id, r.depth): (r.last_role, r.last_text) for r in
            PT.with_last_turn(nodes, frame, "who", "said").collect()}
    assert said == {(0, 0): (None, None), (0, 1): ("u", "hi"), (0, 2): ("s", "")}


def test_op12_equals_brute_force_and_leaves_one_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF01}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    got = PT.op12_prefix_trie(spark, SF01)
    assert got.columns == TRIE
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_trie(rows)


def test_discard_removes_only_written_tables(spark):
    frame = materialize(spark.range(5).toDF("x"), "kept-or-not")
    path = frame._quarry_scratch
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    discard(spark.range(3), frame)
    assert not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)


# ---------------------------------------------------------------- 13

def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(k, label) for phrase, label in LS.PHRASES.items() for p in [phrase.split()]
              for k in range(len(words)) if words[k:k + len(p)] == p]
    starts = [k for k, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in places})))


def test_base_places_equal_brute_force(spark):
    rng = random.Random(5)
    bits = ["gnu", "General", "PUBLIC", "license", "Apache", "cc", "by", "MIT", "nc", "K", "é", "1", ".", "-", "\n", " ", ", "]
    texts = [*ODD, "CC-BY cc by,cc/by", "gnu general public license" * 2, "apache mit license license"]
    texts += [rng.choice([" ", "", "-"]).join(rng.choice(bits) for _ in range(rng.randrange(80))) for _ in range(600)]
    rows = [(k, t, "clash") for k, t in enumerate(texts)] + [(None, "MIT license", ""), (3, "MIT license", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = LS.scan_licenses(docs.repartition(3)).collect()
    assert len(got) == len(rows)
    assert sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == \
        sorted(repr((k, *plain_scan(t))) for k, t, _ in rows)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels or r.expressions)
    assert LS.scan_licenses(docs.limit(0)).count() == 0


EXPRESSIONS = [                 # text, labels, expressions, permissive
    ("SPDX-License-Identifier: MIT", "mit", ["mit"], True),
    ("// SPDX-License-Identifier: GPL-2.0-only OR MIT */\nint x;", "gpl,mit", ["gpl-2.0-only or mit"], True),
    ("SPDX-License-Identifier: GPL-2.0-or-later AND MIT", "gpl,mit", ["gpl-2.0-or-later and mit"], False),
    ("SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception", "apache", ["apache-2.0 with llvm-exception"], True),
    ("spdx-license-identifier: (mit or gpl-3.0+) and (bsd-3-clause or lgpl-2.1)", "bsd,gpl,lgpl,mit",
     ["(mit or gpl-3.0+) and (bsd-3-clause or lgpl-2.1)"], True),
    ("SPDX-License-Identifier: MIT OR GPL-2.0 AND LGPL-2.1", "gpl,lgpl,mit", ["mit or gpl-2.0 and lgpl-2.1"], True),
    ("SPDX-License-Identifier: (MIT OR GPL-2.0) AND LGPL-2.1", "gpl,lgpl,mit", ["(mit or gpl-2.0) and lgpl-2.1"], False),
    ("SPDX-License-Identifier: MIT this is prose", "mit", ["mit"], True),
    ("SPDX-License-Identifier: MIT AND", "mit", ["mit"], True),
    ("SPDX-License-Identifier: (MIT", "", [], None),
    ("SPDX-License-Identifier:\nMIT", "", [], None),
    ("SPDX-License-Identifier MIT", "", [], None),
    ("SPDX-License-Identifier: Made-Up-1.0", "", ["made-up-1.0"], False),
    ("SPDX-License-Identifier: LicenseRef-Own", "licenseref-own", ["licenseref-own"], False),
    ("SPDX-License-Identifier: MIT\n# SPDX-License-Identifier: GPL-2.0", "gpl,mit", ["mit", "gpl-2.0"], False),
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc", [], False),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of", "mit", [], True),
    ("nothing here", "", [], None),
]


def test_expressions_and_notices(spark):
    rows = [(k, t) for k, (t, *_) in enumerate(EXPRESSIONS)]
    got = {r.doc_id: r for r in LS.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (text, labels, expressions, permissive) in enumerate(EXPRESSIONS):
        assert (got[k].labels, got[k].expressions, got[k].permissive) == (labels, expressions, permissive), text


def test_postfix_evaluation_equals_python(spark):
    rng = random.Random(9)
    names = ["mit", "gpl-2.0", "apache-2.0", "lgpl-2.1", "epl-2.0", "isc"]

    def make(depth):
        if not depth or rng.random() < .2:
            return [rng.choice(names)]
        inner = make(depth - 1) + [rng.choice(["and", "or"])] + make(depth - 1)
        return ["(", *inner, ")"] if rng.random() < .5 else inner

    for _ in range(500):
        infix = make(4)
        truth = {n: str(LS.family(n) in LS.PERMISSIVE) for n in names}
        labels, met = LS.evaluate(LS.postfix(infix))
        assert met == eval(" ".join(truth.get(t, t) for t in infix))    # and/or bind in Python as they do here
        assert labels == {LS.family(t) for t in infix if t in names}
        assert LS.tokens(" ".join(infix).encode()) == infix
    deep = ["("] * 20_000 + ["mit"] + [")"] * 20_000
    assert LS.evaluate(LS.postfix(deep)) == (frozenset({"mit"}), True)
    for bad in (["("], [")"], ["mit", "mit"], ["and"], ["mit", "or"]):
        with pytest.raises(ValueError):
            LS.evaluate(LS.postfix(bad))


def test_op13_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    got = LS.op13_license_scan(spark, SF01).collect()
    assert len(got) == len(docs) and sum(r.n_base for r in got) > 20
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_scan(docs[r.doc_id])
    with pytest.raises(ValueError):
        LS.scan_licenses(spark.read.parquet(f"{SF01}/documents.parquet"), phrases={"Upper Case": "x"})
