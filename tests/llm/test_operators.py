"""The training-data operators against brute force, the public libraries, and edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import (bm25_wand, byte_cnn, duck_bpe, fst_tokens, hamming_minhash, line_winnow, maglev_shards,
                        seekable_warc, suffix_repetition, zstd_toxicity)
from quarry.session import materialize, ship_package

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, score string, key long, n_removed long, shard string"
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "One."), (None, "null id text here"), (5, "same text twice " * 4),
        (5, "same text twice " * 4), (6, "x" * 70_000), (7, "Ä日本 🙂 ▁ \x01 <s> 0x\x00 | # end"), (8, "a " * 30_000)]


@pytest.fixture(scope="module", autouse=True)
def _code(spark):
    ship_package(spark)


def frame(spark, rows):
    """Documents with columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, "z") for i, t in rows], DOC)


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


# ---- 1 ----------------------------------------------------------------------------------------------------

def test_longest_repeats_against_brute_force():
    random.seed(1)
    for _ in range(150):
        docs = [[random.choice("abc"[:random.randint(1, 3)]) for _ in range(random.randint(0, 25))]
                for _ in range(random.randint(1, 4))]
        ids = np.array([ord(w) - 97 for d in docs for w in d], np.int64)
        rows = np.array([i for i, d in enumerate(docs) for _ in d], np.int64)
        want = []
        for d in docs:
            for i in range(len(d)):
                best = 0
                for j in range(len(d)):
                    k = 0
                    while i != j and max(i, j) + k < len(d) and d[i + k] == d[j + k]:
                        k += 1
                    best = max(best, k)
                want.append(best)
        got = suffix_repetition.longest_repeats(ids, rows).tolist()
        assert [g if g > 1 else 0 for g in got] == [w if w > 1 else 0 for w in want]


def test_repetition_rows(spark):
    line = " ".join(f"w{k}" for k in range(60))
    docs = EDGE + [(10, line), (11, line + " x " + line), (12, "a b c d e f g h i j k\na b c\na b c")]
    got = {r["doc_id"]: r for r in suffix_repetition.repetition(frame(spark, docs)).collect()}
    assert got[1]["n_words"] == got[2]["n_words"] == 0 and got[1]["base_failed"] and not got[1]["kept"]
    assert got[10]["kept"] and got[10]["n_repeat_words"] == 0
    assert got[11]["longest_repeat"] == 60 and got[11]["n_repeat_words"] == 120 and got[11]["base_failed"]
    assert [tuple(s) for s in got[11]["spans"]] == [(0, 59), (61, 120)]
    assert got[12]["n_dup_lines"] == 1 and got[7]["n_symbols"] == 4
    assert got[8]["n_repeat_words"] == 30_000 and not got[8]["kept"]
    assert suffix_repetition.repetition(frame(spark, EDGE)).count() == len(EDGE)
    assert suffix_repetition.repetition(frame(spark, [])).count() == 0


# ---- 2 ----------------------------------------------------------------------------------------------------

def cut_lines(text):
    return re.split(r"(?<=\n)|(?<=[.!?] )", text)


def brute_lines(docs, min_words=line_winnow.MIN_WORDS):
    """Lines covered by a run of at least min_words words that occurs earlier (any earlier document, or place)."""
    split = {i: cut_lines(t) for i, t in docs}
    out = {}
    for i in sorted(split):
        mine = [x.strip(" \n") for x in split[i]]
        gone = set()
        for j in sorted(split):
            if j > i:
                break
            other = [x.strip(" \n") for x in split[j]]
            for shift in range(-len(mine) + 1, len(other)):
                if i == j and shift >= 0:
                    continue
                run = []
                for k in range(len(mine) + 1):
                    if k < len(mine) and 0 <= k + shift < len(other) and mine[k] == other[k + shift]:
                        run.append(k)
                        continue
                    if sum(len(mine[r].split(" ")) if mine[r] else 0 for r in run) >= min_words:
                        gone.update(run)
                    run = []
        out[i] = "".join(x for k, x in enumerate(split[i]) if k not in gone)
    return out


def test_line_dedup_against_brute_force(spark):
    random.seed(4)
    make = lambda n: " ".join(random.choice("abcdefghij") + str(random.randint(0, 999)) for _ in range(n))
    passages = ["".join(make(random.randint(3, 20)) + random.choice([". ", "! ", ".\n", "\n"]) for _ in range(12))
                for _ in range(6)]
    docs = []
    for i in range(60):
        parts = ["".join(make(random.randint(2, 15)) + ". " for _ in range(random.randint(1, 5)))]
        parts += random.sample(passages, random.randint(0, 2)) + [make(6) + ". Short line. "]
        docs.append((i, "".join(random.sample(parts, len(parts)))))
    docs.append((60, docs[3][1]))
    got = {r["doc_id"]: r for r in line_winnow.dedup_lines(frame(spark, docs)).collect()}
    # nothing goes that brute force over all earlier places would keep ...
    for i, least in brute_lines(docs).items():
        rest = iter(cut_lines(got[i]["text"]))
        assert all(line in rest for line in cut_lines(least) if line), i
    # ... and every passage goes from all documents but the first
    for passage in passages:
        holders = [i for i, t in docs if passage in t]
        lines = [x for x in cut_lines(passage) if x]
        assert all(x in got[holders[0]]["text"] for x in lines)
        assert not any(x in cut_lines(got[i]["text"]) for i in holders[1:] for x in lines)
    assert got[60]["text"].strip() == "" and got[60]["lang"] == "en" and set(got[0].asDict()) == \
        {"doc_id", "text", "lang", "score", "key", "shard", "n_removed", "removed_words"}
    assert all(got[i]["text"] == t for i, t in docs if not got[i]["n_removed"])


def test_line_dedup_finds_passages_whose_lines_stand_elsewhere(spark):
    """A part of a passage in an earlier document must not hide the whole passage in another one."""
    random.seed(11)
    make = lambda n: " ".join(random.choice("abcdefghij") + str(random.randint(0, 999)) for _ in range(n))
    docs = []
    for t in range(0, 120, 3):
        lines = [make(n) + ". " for n in (16, 20, 16)]
        alone = lambda: make(9) + ". "
        docs += [(t, alone() + lines[1] + alone()), (t + 1, alone() + "".join(lines) + alone()),
                 (t + 2, alone() + "".join(lines) + alone())]
    shared = [make(random.randint(1, 19)) + random.choice([". ", "\n", ".\n\n", "! "]) for _ in range(25)]
    for i in range(120, 180):
        parts = []
        for _ in range(random.randint(2, 5)):
            k = random.randrange(25)
            parts += [*shared[k:k + random.randint(1, 8)], make(random.randint(1, 9)) + random.choice([". ", "\n\n"])]
        docs.append((i, "".join(parts)))
    got = {r["doc_id"]: r["text"] for r in line_winnow.dedup_lines(frame(spark, docs)).collect()}
    least = brute_lines(docs)
    assert all(got[i] == least[i] for i in range(120))
    for i in range(120, 180):       # short runs without a long line may lack a fingerprint, all others go
        rest = iter(cut_lines(got[i]))
        assert all(line in rest for line in cut_lines(least[i]) if line), i
    assert sum(got[i] == least[i] for i in range(120, 180)) >= 58


def test_line_dedup_equals_brute_force_for_every_document(spark):
    """Few distinct lines of every length, some repeated inside a document, blank ones between: each text as by brute force."""
    random.seed(23)
    make = lambda n: " ".join(random.choice("abcdefghij") + str(random.randint(0, 99)) for _ in range(n))
    shared = [make(random.choice([1, 2, 5, 9, 10, 14, 29, 30, 33])) + random.choice([". ", "\n", "! "]) for _ in range(40)]
    docs = []
    for i in range(150):
        parts = []
        for _ in range(random.randint(1, 7)):
            k = random.randrange(40)
            parts += [*shared[k:k + random.randint(1, 9)], make(random.randint(1, 6)) + random.choice([". ", "? ", "\n"])]
        docs.append((i, "".join(parts)))
    got = {r["doc_id"]: r["text"] for r in line_winnow.dedup_lines(frame(spark, docs)).collect()}
    assert got == brute_lines(docs)


def test_line_dedup_does_not_depend_on_unrelated_text(spark):
    """Runs of 42 words in three lines, each in two documents: the second copy always goes."""
    random.seed(42)
    make = lambda n: " ".join(random.choice("abcdefghij") + str(random.randint(0, 9999)) for _ in range(n))
    common = make(20) + ". "
    for extra in ("", common):
        docs = []
        for t in range(100):
            run = "".join(make(14) + ". " for _ in range(3))
            docs += [(2 * t, make(5) + ". " + run + extra + make(7) + ". "), (2 * t + 1, extra + make(6) + ". " + run)]
        got = {r["doc_id"]: r for r in line_winnow.dedup_lines(frame(spark, docs)).collect()}
        assert all(got[2 * t]["n_removed"] == 0 and got[2 * t + 1]["removed_words"] == 42 for t in range(100))


def test_line_dedup_edges(spark):
    got = line_winnow.dedup_lines(frame(spark, EDGE)).collect()
    assert sorted(((r["doc_id"] or 0), r["text"] or "") for r in got if r["doc_id"] != 8) == \
        sorted(((i or 0), t or "") for i, t in EDGE if i != 8)
    assert line_winnow.dedup_lines(frame(spark, [])).count() == 0


# ---- 3 ----------------------------------------------------------------------------------------------------

def test_lookup_table_and_placement(spark):
    names = [f"s{k}" for k in range(7)]
    owner = maglev_shards.lookup_table(names, 1009)
    counts = np.bincount(owner)
    assert counts.max() - counts.min() <= 1 and len(owner) == 1009
    shuffled = random.sample(names, 7)
    assert [names[k] for k in owner] == [shuffled[k] for k in maglev_shards.lookup_table(shuffled, 1009)]
    fewer = maglev_shards.lookup_table(names, 1009, {"s3": 0})
    moved = sum(a != b for a, b in zip(owner, fewer, strict=True))
    assert counts[3] <= moved < 2.2 * counts[3]
    heavy = np.bincount(maglev_shards.lookup_table(names, 1009, {"s0": 3}))
    assert abs(heavy[0] - 3 * heavy[1]) <= 3
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8)):
        with pytest.raises(ValueError):
            maglev_shards.lookup_table(*bad)
    rows = maglev_shards.place(frame(spark, EDGE), names, slots=1009).collect()
    assert len(rows) == len(EDGE)
    for r in rows:
        if r["doc_id"] is None:
            assert r["slot"] is None and r["shard"] is None
        else:
            slot = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16) % 1009
            assert r["slot"] == slot and r["shard"] == names[owner[slot]]


# ---- 4 and 9 ----------------------------------------------------------------------------------------------

def test_toxicity_learns_and_holds_out(spark):
    random.seed(6)
    syll = ["ka", "lo", "mi", "ten", "ru", "sha", "ve", "dor"]
    word = lambda: "".join(random.choice(syll) for _ in range(random.randint(1, 4)))
    bad = ["blockhead", "nitwit", "scoundrel", "dimwit"]
    docs, labels = [], []
    for i in range(600):
        text = [word() for _ in range(120)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                text[random.randrange(120)] = random.choice(bad)
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    d, lab = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = zstd_toxicity.train(d, lab)
    rows = zstd_toxicity.score(d, model).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held]) > 0.93
    kept = {r["doc_id"] for r in zstd_toxicity.keep_ordinary(d, model).collect()}
    assert kept == {r["doc_id"] for r in rows if not r["predicted"]}
    edge = zstd_toxicity.score(frame(spark, EDGE), model).collect()
    assert len(edge) == len(EDGE) and all(0 <= r["score"] <= 1 for r in edge)
    none = zstd_toxicity.train(frame(spark, []), lab.limit(0))
    assert none.weights is None and zstd_toxicity.score(d, none).count() == 600


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = byte_cnn.train(docs)
    got = byte_cnn.identify(docs, net).join(docs, "doc_id").where("held_out AND n_chars > 30").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.95
    edge = byte_cnn.identify(frame(spark, EDGE + [(9, "12 34 !!")]), net).collect()
    und = {r["doc_id"] for r in edge if r["lang_pred"] == "und"}
    assert und == {1, 2, 3, 9} and all(0 <= r["score"] <= 1 for r in edge)
    empty = byte_cnn.train(docs.limit(0))
    assert {r["lang_pred"] for r in byte_cnn.identify(frame(spark, EDGE), empty).collect()} == {"und"}


# ---- 5 ----------------------------------------------------------------------------------------------------

def test_warc_round_trip(spark, scratch):
    page = "<p>" + "é" * 200 + "</p>"
    rows = [(5, "u\n5", page), (3, "u3", page), (9, None, page), (1, "u1", "tiny"), (2, "u2", "tiny"), (4, "u4", None),
            (6, "u6", ""), (None, "n", page), (7, "u7", "z" * 3_000_000), (8, "u8", "\r\n\r\nWARC/1.1"), (3, "u3", page)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("frame", pages_extra())
    index = seekable_warc.write(pages.repartition(2), scratch, frame_bytes=1000)
    got = {(r["page_id"], r["record_type"]): r for r in seekable_warc.read(index).collect()}
    assert seekable_warc.read(index).count() == len(rows)
    digest = hashlib.sha256(page.encode()).hexdigest()
    assert got[3, "response"]["refers_to"] is None and got[5, "revisit"]["refers_to"] == 3
    assert got[9, "revisit"]["payload_digest"] == digest and got[9, "revisit"]["payload_bytes"] == len(page.encode())
    assert {k for k in got if k[0] in (1, 2, 4, 6)} == {(k, "response") for k in (1, 2, 4, 6)}
    assert got[4, "response"]["payload_bytes"] == 0 and got[7, "response"]["payload_bytes"] == 3_000_000
    assert got[None, "response"]["payload_digest"] == digest
    assert seekable_warc.lookup(index, [8]).collect()[0]["payload_bytes"] == 12
    first = index.first()
    frames = seekable_warc.seek_table(first["bundle"])
    assert frames[first["frame"]][:2] == (first["frame_offset"], first["frame_bytes"])
    assert seekable_warc.read(seekable_warc.write(pages.limit(0), scratch)).count() == 0


def pages_extra():
    from pyspark.sql import functions as F

    return F.lit(99)


# ---- 6 and 8 ----------------------------------------------------------------------------------------------

def odd_texts():
    random.seed(8)
    parts = list("abcdeéñ  \n\t▁0123'.,-\x00") + ["the", "ing", "日本", "🙂", "     ", "<s>", "<0x0A>", "----", "'ll"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 50))) for _ in range(400)]
    return [*texts, "", " ", "▁", "a" * 700, "ab" * 300, " " * 90, "=" * 500, "<|endoftext|>",
            "".join(random.choice("abcdetins") for _ in range(3000))]


def test_bpe_equals_the_library(spark):
    import tiktoken

    data, pattern = duck_bpe.public_ranks()
    lib = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=duck_bpe.read_ranks(data), special_tokens={})
    docs = [*enumerate(odd_texts(), 100), *EDGE]
    rows = duck_bpe.encode(frame(spark, docs), data, pattern).collect()
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((i or 0, len(ids := lib.encode_ordinary(t or "")), digest(",".join(map(str, ids)).encode()),
                   digest((t or "").encode())) for i, t in docs)
    assert sorted((r[0] or 0, *r[1:]) for r in rows) == want
    ids = duck_bpe.encode(frame(spark, docs[:20]), data, pattern, output="ids").collect()
    assert all(r["ids"] == lib.encode_ordinary(dict(docs)[r["doc_id"]]) for r in ids)
    assert duck_bpe.encode(frame(spark, []), data, pattern).count() == 0


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    model = fst_tokens.model_bytes()
    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = [*odd_texts(), *[t for _, t in EDGE]]
    want = [len(x) for x in lib.encode([t or "" for t in texts], num_threads=1)]
    fst = fst_tokens.Transducer(model)
    for chunk in (16 << 10, 7, 64):
        assert fst_tokens.count_tokens(pa.array(texts), fst, chunk).tolist() == want
    rows = fst_tokens.token_counts(frame(spark, EDGE), model).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["n_bytes"], r["over_limit"]) for r in rows) == sorted(
        (i or 0, n, len((t or "").encode()), n > 4096) for (i, t), n in zip(EDGE, want[-len(EDGE):], strict=True))


# ---- 7 ----------------------------------------------------------------------------------------------------

def brute_components(docs, n=2):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in docs:
        w = words((t or "").translate(low))
        sets.append({tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min(i, least.get(find(k), i))
    return {i: (len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(docs)}


@pytest.mark.parametrize("paired", [24, 3])
def test_near_duplicates_against_brute_force(spark, monkeypatch, paired):
    monkeypatch.setattr(hamming_minhash, "PAIRED", paired)
    random.seed(9)
    docs = []
    for g in range(6):
        base = [f"w{random.randint(0, 400)}" for _ in range(60)]
        for _ in range(30 if g else 60):
            text = list(base)
            for _ in range(random.randint(0, 9)):
                k = random.randrange(len(text))
                if random.random() < 0.5:
                    del text[k]
                else:
                    text[k] = f"n{random.randint(0, 60)}"
            docs.append((len(docs), " ".join(text)))
    docs += [(900, None), (901, ""), (902, "Word"), (903, "word"), (904, "two words"), (905, docs[0][1].upper())]
    random.shuffle(docs)
    rows = hamming_minhash.near_duplicates(frame(spark, docs)).collect()
    want = brute_components(docs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_near_duplicate_edges(spark):
    rows = hamming_minhash.near_duplicates(frame(spark, EDGE)).collect()
    assert len(rows) == len(EDGE)
    assert all(r["kept"] and r["component_id"] == r["doc_id"] for r in rows)
    assert hamming_minhash.near_duplicates(frame(spark, [])).count() == 0


def test_pigeonhole_guarantee():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 65536, (200, 4 * hamming_minhash.LANES)).astype(np.uint16)
    b = a.copy()
    limit = hamming_minhash.SYMBOLS // hamming_minhash.CHUNK * (hamming_minhash.ERRORS + 1) - 1
    for row in b:
        row[rng.choice(hamming_minhash.SYMBOLS, limit, replace=False)] ^= 1
    keys = [hamming_minhash.chunk_keys(x) for x in (a, b)]
    assert all(set(x) & set(y) for x, y in zip(*map(np.ndarray.tolist, keys), strict=True))


# ---- 10 ---------------------------------------------------------------------------------------------------

def test_wand_retrieves_all_above_threshold_and_verifies(spark):
    random.seed(10)
    vocab = [f"t{k}" for k in range(300)]
    text = lambda n: [random.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(text(random.randint(12, 50)))) for k in range(50)]
    docs = [(i, " ".join(text(200))) for i in range(60)]
    for i in range(0, 60, 3):
        w = docs[i][1].split()
        at = random.randrange(len(w))
        docs[i] = (i, " ".join(w[:at] + items[i % 50][1].upper().split() + w[at:]))
    bench = spark.createDataFrame(items + [(99, None), (98, "")], "item_id long, text string")
    (index,) = list(bm25_wand.load(bench))
    # every pair at or above a low threshold, against plain BM25
    _, _, _, _, _, passage, term = bm25_wand._passages(index, pa.array([t for _, t in docs]))
    dense = np.zeros((len(index.terms), len(index.items)))
    dense[np.repeat(np.arange(len(index.terms)), np.diff(index.start)), index.item] = index.weight
    want = set()
    for p in np.unique(passage):
        total = dense[term[passage == p]].sum(0)
        want |= {(int(p), int(i)) for i in np.flatnonzero(total >= 0.2)}
    assert {(p, i) for p, i, _ in bm25_wand.retrieve(index, passage, term, 0.2)} == want
    d = frame(spark, [*docs, (500, None), (501, ""), (None, items[0][1])])
    planted = {(i, i % 50) for i in range(0, 60, 3)} | {(None, 0)}
    assert {(r["doc_id"], r["item_id"]) for r in bm25_wand.search(d, bench).collect()} == planted
    assert {(r["doc_id"], r["item_id"]) for r in bm25_wand.search(d, bench, shard_bytes=2000).collect()} == planted
    clean = bm25_wand.keep_clean(d, bench, shard_bytes=2000).collect()
    assert len(clean) == 63 - len(planted) and not {(r["doc_id"], 0) for r in clean} & {(i, 0) for i, _ in planted}
    assert bm25_wand.search(d, bench.limit(0)).count() == 0


# ---- pipeline ---------------------------------------------------------------------------------------------

def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "encode"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= before
    assert docs.where("n_chars <> length(text)").count() == 0
    assert cp.encode(spark, docs, SF).count() == docs.count()
