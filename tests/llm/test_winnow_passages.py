"""Passages of op2 against a plain search, and the work that they take per line."""

import random

from pyspark.sql import functions as F

from quarry.llm import common, line_winnow


def plain_search(words, seeds, enough):
    """(first, last) of the shortest runs from each line on and up to each line that hold a seed."""
    runs = set()
    for i in range(len(words)):
        ahead = next((j for j in range(i, len(words)) if sum(words[i:j + 1]) >= enough), None)
        behind = next((j for j in range(i, -1, -1) if sum(words[j:i + 1]) >= enough), None)
        runs |= {(i, ahead)} if ahead is not None else set()
        runs |= {(behind, i)} if behind is not None else set()
    return {(a, b) for a, b in runs if any(a <= s <= b for s in seeds)}


def test_passages_equal_a_plain_search(spark):
    random.seed(4)
    rows, seeds = {}, {}
    for k in range(60):
        rows[k] = [random.choice([1, 1, 2, 3, 8, 14, 40]) for _ in range(random.randint(1, 70))]
        seeds[k] = sorted(random.sample(range(len(rows[k])), random.randint(1, min(3, len(rows[k])))))
    text = lambda k: "\n".join(" ".join(["w"] * n) for n in rows[k])
    lines = line_winnow.line_table(spark.createDataFrame([(k, text(k)) for k in rows], "__id long, __text string"))
    found = lines.select("id", "th").join(spark.createDataFrame(list(seeds.items()), "id long, seeds array<int>"), "id")
    for enough in (30, 7, 1):
        got = line_winnow.passages(lines, found, enough).select("id", F.explode("p").alias("p")).collect()
        spans = [(r["id"], r["p"]["first"], r["p"]["last"]) for r in got]
        assert len(spans) == len(set(spans))
        assert set(spans) == {(k, a, b) for k in rows for a, b in plain_search(rows[k], seeds[k], enough)}


def test_a_line_takes_one_search_of_few_steps(spark):
    lines = line_winnow.line_table(spark.createDataFrame([(1, "a b\nc d")], "__id long, __text string"))
    found = lines.selectExpr("id", "th", "array(0) AS seeds")
    plan = line_winnow.passages(lines, found)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1       # not a fold over up to MIN_WORDS lines in either direction


def test_fingerprints_equal_plain_winnowing_and_compare_numbers(spark):
    random.seed(9)
    texts = [(k, "\n".join(" ".join([random.choice("abc")] * random.choice([1, 2, 12])) for _ in range(random.randint(1, 30))))
             for k in range(50)]
    lines = line_winnow.line_table(spark.createDataFrame(texts, "__id long, __text string"))
    marks = line_winnow.fingerprints(lines, 2, 3, 10)
    got = {r["id"]: sorted((f["key"], f["pos"]) for f in r["p"]) for r in marks.collect()}
    for r in lines.selectExpr("id", "w", "transform(h, x -> xxhash64(x)) AS one", "if(size(h) > 1, transform(sequence(0,"
                              " size(h) - 2), i -> xxhash64(h[i], h[i + 1])), array()) AS g").collect():
        g, places = r["g"], set()
        for i in range(max(len(g) - 2, min(len(g), 1))):
            places.add(min(range(i, min(i + 3, len(g))), key=lambda p: (g[p], -p)))
        alone = [(r["one"][i], i) for i, n in enumerate(r["w"]) if n >= 10]
        assert got[r["id"]] == sorted([(g[p], p) for p in places] + alone)
    bare = line_winnow.fingerprints(spark.createDataFrame([(1, 2, [3], [4])], lines.select("id", "th", "h", "w").schema), 2, 3, 10)
    assert "arrays_zip" not in bare._jdf.queryExecution().optimizedPlan().toString()     # a struct for every line


def test_membership_takes_no_text_function_per_row(spark):
    ids = spark.range(0, 100_000, 97)
    rows = common.members(spark.range(100_000), "id", ids)
    got = {r["id"] for r in rows.collect()}
    assert got >= set(range(0, 100_000, 97)) and len(got) < 1_200       # 1,031 ids and a few others
    above_join = rows._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "hex(" not in above_join and "conv(" not in above_join


def test_cut_texts_and_words_of_whole_runs(spark):
    """Lines of every ending, blanks around them: what is cut and counted, taken by runs and not line by line."""
    run = "  one two three four five! six seven eight? nine ten \n\n eleven" + " w" * 20 + ". "
    docs = [(1, "a b. " + run + "c d\n"), (2, "x\n" + run + "y  z. " + "q " * 12 + "\n" + run + "end"), (3, run)]
    out = line_winnow.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {r["doc_id"]: tuple(r[c] for c in ("text", "n_removed", "removed_words")) for r in out.collect()}
    assert got == {1: (docs[0][1], 0, 0), 2: ("x\ny  z. " + "q " * 12 + "\nend", 10, 62), 3: ("", 5, 31)}
    assert "exists(" not in out._jdf.queryExecution().optimizedPlan().toString()
