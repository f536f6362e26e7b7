"""The pipeline's stages on nulls, repeated rows, clashing columns and empty tables; what runs leave behind."""
import os

import corpus_pipeline as cp
from quarry.session import ensure_checkpoint_dir, materialize

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_removed long, key string, cls string"


def sentence(seed, n=60):
    return " ".join(f"w{(seed * 7919 + k * 104729) % 997}" for k in range(n)) + "."


def documents(spark):
    same = sentence(1)
    rows = [(None, same), (1, same), (2, same), (3, None), (4, ""), (5, sentence(5)), (5, sentence(5)), (6, sentence(6)),
            (None, None)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "k", "c") for i, t in rows], SCHEMA)


def kept(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=repr)


def test_stages_keep_nulls_and_columns_and_handle_repeats(spark):
    docs = documents(spark)
    every = kept(docs)
    for name, stage in cp.STAGES[:-1]:
        out = materialize(stage(spark, docs, SF), "edge")
        assert out.schema.names == docs.columns and out.where("n_removed <> 7 OR key <> 'k' OR cls <> 'c'").count() == 0
        got = kept(out)
        assert (3, None) in got and (4, "") in got and (None, None) in got and (None, sentence(1)) in got
        assert (6, sentence(6)) in got
        if name in ("toxicity", "decontaminate"):
            assert got == every                                # ordinary texts, no leaks
        if name == "near_dedup":                               # of equal texts the smallest id; equal rows of one id stay
            assert (1, sentence(1)) in got and (2, sentence(1)) not in got and got.count((5, sentence(5))) == 2
        if name == "line_dedup":                               # rows of one id are never cut against each other
            assert (1, sentence(1)) in got and (2, sentence(1)) not in got and got.count((5, sentence(5))) == 2
    assert cp.encode(spark, docs, SF).count() == len(every)


def test_stages_on_an_empty_table(spark):
    docs = documents(spark).limit(0)
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0
    assert cp.encode(spark, docs, SF).count() == 0


def test_a_run_leaves_its_result_alone(spark):
    home = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(home))
    out = cp.run(spark, SF)
    left = set(os.listdir(home)) - before
    assert out.count() > 0 and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {name.rsplit("-", 1)[0] for name in left} == {"pipeline-encode"}, left
