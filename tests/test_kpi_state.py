import itertools
import os
import random
import tempfile

import pytest
from conftest import row
from pyspark.sql import functions as F

from opsrisk.operators import kpi_state, kpis


@pytest.fixture
def flows(make_df):
    rng = random.Random(4)
    rows = [
        row(
            workflow_id=f"W{i}", department=rng.choice(["Finance", "IT", "HR", None]), status=rng.choice(["open", "completed"]), priority=rng.choice(["low", "high", None]),
            elapsed_hours=rng.choice([None, rng.uniform(0, 200)]), sla_hours=rng.choice([None, 0.0, rng.uniform(1, 100)]), automation_score=rng.choice([0.1, 0.2, 0.3, None]),
            avg_handling_time_minutes=rng.uniform(0, 1e9), risk_label=rng.choice(["low", "medium", "high", None, "odd"]),
        )
        for i in range(200)
    ]
    rows += [rows[0], rows[0]]  # repeated rows count
    return make_df(rows)


def _metrics(state):
    return {r.metric: r.value for r in kpi_state.metrics_of_state(state, labels=True).collect()}


def _categories(df):
    return sorted(tuple(r) for r in df.collect())


def test_any_cut_merges_to_the_same_state(flows):
    """Batches merged in two steps give the state of the whole table, to the last digit, and the KPIs of the plain pass."""
    whole = kpi_state.partial_state(flows, "risk_label")
    cut = lambda k: kpi_state.partial_state(flows.where(F.pmod(F.xxhash64("workflow_id"), F.lit(5)) == k), "risk_label")
    old = kpi_state.merge_states(cut(3).unionByName(cut(0)).unionByName(cut(4)))
    merged = kpi_state.merge_states(cut(2).unionByName(old).unionByName(cut(1)))
    key = lambda df: sorted(map(repr, df.select(kpi_state.STATE_SCHEMA.fieldNames()).collect()))
    assert key(merged) == key(kpi_state.merge_states(whole))
    assert _metrics(merged) == _metrics(whole)
    plain = {r.metric: r.value for r in kpis.kpi_metrics_long(flows, label_col="risk_label").collect()}
    assert _metrics(whole) == pytest.approx(plain, rel=1e-9)
    for a, b in itertools.zip_longest(_categories(kpi_state.categories_of_state(merged)), _categories(kpis.category_table(flows))):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-9)


def test_saved_batches_count_once_and_whole(spark, flows):
    path = tempfile.mkdtemp(prefix="opsrisk-test-", dir="/tmp") + "/state"
    part = lambda k: flows.where(F.pmod(F.xxhash64("workflow_id"), F.lit(2)) == k)
    assert kpi_state.read_state(spark, path).count() == 0
    assert kpi_state.add_batch(part(0), path, "2026/01 a=b", "risk_label")
    assert not kpi_state.add_batch(part(0), path, "2026/01 a=b", "risk_label")
    first = _metrics(kpi_state.read_state(spark, path))
    assert kpi_state.add_batch(part(1), path, "two", "risk_label")
    assert _metrics(kpi_state.read_state(spark, path)) == _metrics(kpi_state.partial_state(flows, "risk_label"))
    # a save that died before its end does not count, and is written anew
    died = [f for f in kpi_state.saved_batches(spark, path) if f.endswith("two")][0].removeprefix("file:")
    os.remove(f"{died}/_SUCCESS")
    assert _metrics(kpi_state.read_state(spark, path)) == first
    assert kpi_state.add_batch(part(1), path, "two", "risk_label")
    assert _metrics(kpi_state.read_state(spark, path)) == _metrics(kpi_state.partial_state(flows, "risk_label"))


def test_new_batch_reads_its_file_only(spark, flows):
    d = tempfile.mkdtemp(prefix="opsrisk-test-", dir="/tmp")
    for k in (0, 1):
        flows.where(F.pmod(F.xxhash64("workflow_id"), F.lit(2)) == k).write.parquet(f"{d}/in-{k}")
    kpi_state.add_batch(spark.read.parquet(f"{d}/in-0"), f"{d}/state", "0")
    files = spark.read.parquet(f"{d}/in-1")
    assert all("in-1" in f for f in kpi_state.partial_state(files).inputFiles())
    kpi_state.add_batch(files, f"{d}/state", "1")
    assert all("/state/" in f for f in kpi_state.read_state(spark, f"{d}/state").inputFiles())


def test_empty_and_odd_values(spark, make_df):
    empty = kpi_state.partial_state(make_df([row()]).limit(0), "risk_label")
    assert empty.count() == 0
    got = _metrics(empty)
    assert got["volume.total_workflows"] == 0 and got["sla.avg_sla_utilization"] == 0 and got["efficiency.avg_error_rate"] is None
    wide = kpi_state.partial_state(make_df([row(avg_handling_time_minutes=float("inf")), row(avg_handling_time_minutes=1.0), row(avg_handling_time_minutes=float("nan"))]))
    assert _metrics(wide)["efficiency.avg_handling_time_minutes"] == float("inf")
    assert _metrics(kpi_state.partial_state(make_df([row(avg_handling_time_minutes=1e20), row(avg_handling_time_minutes=3.0)])))["efficiency.avg_handling_time_minutes"] == pytest.approx(5e19)
