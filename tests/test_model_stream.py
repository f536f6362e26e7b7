"""X1/X11 on a stream: no call twice, a budget per trigger, results equal to the batch job."""
import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from quarry.operators import extract as X
from quarry.streaming.model import ModelStream

SCHEMA = "id long, Comments string"


def client(folder, fail_on=None):
    """An extractor that notes every text it is asked for, one file each."""
    def make():
        def call(payloads):
            out = []
            for p in payloads:
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                    f.write(p)
                text = p.split("\n", 1)[1]
                if text == "down":
                    raise RuntimeError("no route")
                out.append(None if text == "silent" else json.dumps({
                    "replacement_intent": "by" in text, "confidence": 0.5, "rationale": text,
                    "replacement_pairs": [{"old_part": "A1", "new_part": "B2", "cue_phrase": "by"}] if "by" in text else []}))
            return out
        return call
    return make


def asked(folder):
    return sorted(open(f"{folder}/{f}").read().split("\n", 1)[1] for f in os.listdir(folder))


@pytest.fixture()
def place(scratch):
    os.mkdir(f"{scratch}/asked")
    return scratch


def arrive(spark, place, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{place}/in")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")


def test_every_text_is_asked_once_over_triggers_and_runs(spark, place):
    m = ModelStream(spark, f"file://{place}/home", client(f"{place}/asked"), partitions=2, group=2)
    arrive(spark, place, [(1, "A1 by B2"), (2, "plain"), (3, "  "), (4, None), (5, "A1 <b>by</b> B2")])
    m.run(arrive(spark, place, [(6, "plain"), (7, "silent"), (8, "A1 by B2")]), f"{place}/ck")
    m.run(arrive(spark, place, [(9, "plain"), (10, "new")]), f"{place}/ck")
    assert asked(f"{place}/asked") == ["A1 by B2", "new", "plain", "silent"]
    got = {r.id: r for r in m.results().collect()}
    assert sorted(got) == list(range(1, 11)) and m.waiting() == 0
    assert got[5].old_part == got[8].old_part == "A1" and got[9].replacement_intent == 0
    assert got[7].error == "No tool call returned" and got[3].error is None and got[4].replacement_intent is None
    batch = X.extract_with_model(spark.read.schema(SCHEMA).parquet(f"{place}/in"), client(f"{place}/asked"), retries=0)
    columns = ["id", "Comments", *[c for c, _ in X.OUTPUT_COLUMNS]]
    assert sorted(map(repr, m.results().select(columns).collect())) == sorted(map(repr, batch.select(columns).collect()))


def test_a_batch_that_runs_again_repeats_no_call(spark, place):
    """Killed after the calls, before the batch was committed: the same batch comes again."""
    m = ModelStream(spark, f"file://{place}/home", client(f"{place}/asked"), group=1)
    rows = spark.createDataFrame([(1, "A1 by B2"), (2, "plain"), (3, "plain")], SCHEMA)
    m.process(rows, 0)
    m.process(rows, 0)
    again = ModelStream(spark, f"file://{place}/home", client(f"{place}/asked"), group=1)
    again.process(rows, 0)
    again.process(rows.where("id = 2"), 1)
    assert asked(f"{place}/asked") == ["A1 by B2", "plain"]
    assert sorted(r.id for r in again.results().collect()) == [1, 2, 2, 3]


def test_answers_before_a_crash_are_kept(spark, place):
    """A client that dies for good half-way: what it answered before is in the ledger, the rest is asked later."""
    marks = f"{place}/asked"
    sound = client(marks)

    def dying():
        inner = sound()

        def call(payloads):
            if len(os.listdir(marks)) >= 3:
                os._exit(1)                     # the worker process is gone, no exception to catch
            return inner(payloads)
        return call
    rows = spark.createDataFrame([(k, f"text {k} by") for k in range(8)], SCHEMA)
    broken = ModelStream(spark, f"file://{place}/home", dying, partitions=1, group=1)
    with pytest.raises(Exception):
        broken.process(rows, 0)
    assert len(asked(marks)) == 3
    m = ModelStream(spark, f"file://{place}/home", client(marks), partitions=1, group=1)
    m.process(rows, 0)
    assert asked(marks) == sorted(f"text {k} by" for k in range(8))


def test_the_budget_holds_per_trigger_and_nothing_is_lost(spark, place):
    m = ModelStream(spark, f"file://{place}/home", client(f"{place}/asked"), budget=3, group=2)
    m.process(spark.createDataFrame([(k, f"t{k}") for k in range(5)], SCHEMA), 0)
    assert len(asked(f"{place}/asked")) == 3 and m.waiting() == 2
    m.process(spark.createDataFrame([(9, "t9"), (10, "t10")], SCHEMA), 1)
    assert len(asked(f"{place}/asked")) == 6 and m.waiting() == 1
    assert m.results().where(F.col("rationale").isNull()).count() == 1
    assert m.catch_up() == 0
    assert asked(f"{place}/asked") == ["t0", "t1", "t10", "t2", "t3", "t4", "t9"]


def test_failed_calls_are_rows_with_errors(spark, place):
    m = ModelStream(spark, f"file://{place}/home", client(f"{place}/asked"), group=1)
    assert m.results() is None and m.waiting() == 0 and m.catch_up() == 0
    m.process(spark.createDataFrame([(1, "down"), (2, "fine")], SCHEMA), 0)
    got = {r.id: r for r in m.results().collect()}
    assert got[1].error == "no route" and got[2].error is None
