"""near_dedup: rows that large groups make, and texts that its last join moves."""

import pytest
from pyspark.sql import Row

import corpus_pipeline
from quarry.llm import hamming_minhash as h


def _texts():
    """A centre, 20 near copies of a text that shares half of it, and 30 that share that half with it only."""
    words = [f"w{k}" for k in range(100)]
    texts = {0: " ".join(words)}
    for k in range(1, 21):
        texts[k] = " ".join(words[:50] + [f"v{j}" for j in range(49)] + [f"own{k}"])
    for k in range(21, 51):
        texts[k] = " ".join(words[:50] + [f"z{k}x{j}" for j in range(50)])
    return texts


@pytest.mark.parametrize("compared", [0, None])
def test_differences_become_rows_once_and_only_shared_ones_go_on(spark, monkeypatch, compared):
    if compared is not None:        # as in groups that are too large for comparing bitmaps
        monkeypatch.setattr(h, "COMPARED", compared, raising=False)
    made, write = [], h.materialize

    def counted(df, name):
        out = write(df, name)
        if "el" in out.columns:
            made.append((out.count(), out.select("node").distinct().count()))
        return out

    monkeypatch.setattr(h, "materialize", counted)
    texts = _texts()
    frame = spark.createDataFrame(list(texts.items()), "node long, text string")
    groups = spark.createDataFrame([(0, k, k) for k in texts], "centre long, node long, comp long")
    links = h._around_centres(groups, frame, 2, 80, 100)
    assert {r.node: r.comp for r in h.components(links).collect()} == {k: 1 for k in range(1, 21)}
    assert made[0][1] == (20 if compared is None else 50)              # members that can be linked; all in a larger group
    assert len(made) > 2 and all(nodes == 20 for _, nodes in made[1:])   # what one member has alone goes no further


def test_near_dedup_moves_only_texts_that_may_go(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [Row(doc_id=1, text=text, n_chars=3), Row(doc_id=2, text=text, n_chars=4), Row(doc_id=2, text="other words", n_chars=5),
            Row(doc_id=None, text=text, n_chars=6), Row(doc_id=3, text=None, n_chars=7), Row(doc_id=4, text="alone here", n_chars=8)]
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), "")
    assert sorted(r.n_chars for r in out.collect()) == [3, 6, 7, 8]
    assert "bitmap_construct_agg" in out._jdf.queryExecution().optimizedPlan().toString()
