"""Versioned runs: published as one unit, kept by their readers, verified."""

import glob
import os
import tempfile

import pytest

from opsrisk.plans import pipeline as L
from opsrisk.sources import files as IO
from opsrisk.sources import runs

ALERTS = "alert_id string, workflow_id string, note string, share double"


@pytest.fixture
def base():
    return tempfile.mkdtemp(prefix="opsrisk-runs-", dir="/tmp") + "/out"


def table(spark, n, shift=0):
    notes = [None, "", " blank ends ", 'a "quoted", one', "two\nlines\r\nthree", "back\\slash", "é\t"]
    return spark.createDataFrame([(f"A{i + shift}", f"W{i % 3}", notes[i % len(notes)], i / 7) for i in range(n)], ALERTS)


def result(spark, n, shift=0):
    preds = spark.createDataFrame([(f"W{i + shift}", "high", {"high": 1.0}, ["f"]) for i in range(n)], "workflow_id string, predicted_risk string, risk_probability map<string,double>, risk_factors array<string>")
    strings = lambda cols: spark.createDataFrame([tuple(f"{c}{i + shift}" for c in cols) for i in range(n)], ", ".join(f"{c} string" for c in cols))
    kinds = spark.createDataFrame([("status", "open", n, 0.5, None)], IO.CATEGORIES_SCHEMA)
    return L.PipelineResult(preds, {"n": n}, strings(IO.ALERT_COLUMNS), strings(IO.RECOMMENDATION_COLUMNS), preds, kinds)


def whole(out):
    return {k: (sorted(map(repr, v.collect())) if hasattr(v, "collect") else v) for k, v in out.items() if k != "run"}


@pytest.mark.parametrize("fmt", runs.FORMATS)
def test_tables_come_back_as_written(spark, base, fmt):
    df = table(spark, 50)
    run = runs.commit(spark, runs.write_table(spark, runs.start(base), "t", "t", df.repartition(3), fmt))
    assert run.number == 1 and run.tables["t"]["rows"] == 50
    back = runs.read_table(spark, runs.open_run(spark, base), "t")
    assert back.schema == df.schema and sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    assert runs.verify(spark, run) == []
    empty = runs.commit(spark, runs.write_table(spark, runs.start(base), "t", "t", df.limit(0), fmt))
    assert runs.verify(spark, empty) == [] and runs.read_table(spark, empty, "t").count() == 0


def test_a_save_that_dies_leaves_the_former_run_whole(spark, base, monkeypatch):
    assert L.load_published(spark, base) is None
    L.publish_outputs(spark, result(spark, 5), base)
    before = whole(L.load_published(spark, base))
    steps = ("write_table", "write_document", "commit", "_rename_new")
    deaths = 0
    for name in steps:
        for at in range(4):
            calls = []

            def dies(*args, real=getattr(runs, name), at=at, calls=calls):
                calls.append(1)
                if len(calls) == at + 1:
                    raise KeyboardInterrupt
                return real(*args)

            with monkeypatch.context() as m:
                m.setattr(runs, name, dies)
                try:
                    L.publish_outputs(spark, result(spark, 9, 100), base)
                except KeyboardInterrupt:
                    deaths += 1
                    assert whole(L.load_published(spark, base)) == before
                else:
                    break
        if L.load_published(spark, base)["run"].number != 1:  # the step is done fewer than four times: the last save ended
            before = whole(L.load_published(spark, base))
    assert deaths == 7 and before["kpi_summary"] == {"n": 9}


def test_readers_keep_their_run(spark, base):
    first = L.publish_outputs(spark, result(spark, 4), base)
    held = L.load_published(spark, base)
    want = whole(held)
    second = L.publish_outputs(spark, result(spark, 6, 50), base, "parquet")
    assert (first.number, second.number) == (1, 2)
    assert whole(held) == want == whole(L.load_published(spark, base, 1))
    assert L.load_published(spark, base)["kpi_summary"] == {"n": 6} and L.load_published(spark, base, 3) is None
    assert IO.load_outputs(spark, L.run_paths(spark, base, 1))["kpi_summary"] == {"n": 4}


def test_two_writers_get_two_numbers(spark, base, monkeypatch):
    a = runs.write_document(spark, runs.start(base), "d", "d.json", {"x": 1})
    b = runs.write_document(spark, runs.start(base), "d", "d.json", {"x": 2})
    with monkeypatch.context() as m:
        m.setattr(runs, "numbers", lambda *_: [])  # both see an empty log
        assert [runs.commit(spark, r).number for r in (a, b)] == [1, 2]
    assert [runs.read_document(spark, runs.open_run(spark, base, n), "d")["x"] for n in (1, 2)] == [1, 2]


def test_damage_is_found(spark, base):
    run = runs.commit(spark, runs.write_table(spark, runs.start(base), "t", "t", table(spark, 20), "csv"))
    part = max(glob.glob(run.path("t/part-*")), key=os.path.getsize)
    with open(part, "rb") as f:
        text = f.read()
    for crc in glob.glob(run.path("t/.*.crc")):
        os.unlink(crc)
    with open(part, "wb") as f:
        f.write(text.replace(b"W1", b"W2", 1))  # as long as before
    assert runs.verify(spark, run) == ["t"]
    with open(part, "ab") as f:
        f.write(b"more")
    with pytest.raises(runs.RunDamaged):
        runs.read_table(spark, run, "t")
    assert runs.verify(spark, run) == ["t"]


def test_expire(spark, base):
    for i in range(4):
        runs.commit(spark, runs.write_document(spark, runs.start(base), "d", "d.json", {"x": i}))
    dead = runs.write_document(spark, runs.start(base), "d", "d.json", {})
    assert runs.expire(spark, base, 2) == [1, 2]
    assert runs.numbers(spark, base) == [3, 4] and len(glob.glob(f"{base}/runs/*")) == 3  # a young unfinished save stays
    runs.expire(spark, base, 2, unfinished_after_hours=-1)
    assert not os.path.exists(dead.path("")) and runs.read_document(spark, runs.open_run(spark, base, 3), "d") == {"x": 2}
    with pytest.raises(ValueError):
        runs.expire(spark, base, 0)
