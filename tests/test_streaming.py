import tempfile
import time

from conftest import SF_SMALL

from opsrisk.operators.alerts import generate_alerts
from opsrisk.sources import tables
from opsrisk.streaming.alerts_stream import alert_stream, read_workflow_stream, start_alert_sink


def test_stream_alerts_equal_batch(spark):
    d = tempfile.mkdtemp(prefix="opsrisk-stream-", dir="/tmp")
    w = tables.workflows_labeled(spark, SF_SMALL)
    w.repartition(4).write.parquet(f"{d}/in")
    q = start_alert_sink(read_workflow_stream(spark, f"{d}/in", max_files_per_trigger=2), f"{d}/out",
                         f"{d}/ckpt", available_now=True, generated_at="t0")
    q.awaitTermination(300)
    got = spark.read.parquet(f"{d}/out")
    want = generate_alerts(w, generated_at="t0", dedup=False)
    assert got.count() == want.count()
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_csv_stream_matches_batch(spark):
    d = tempfile.mkdtemp(prefix="opsrisk-stream-", dir="/tmp")
    w = tables.workflows_labeled(spark, SF_SMALL)
    w.repartition(3).write.option("header", True).csv(f"{d}/in")
    q = start_alert_sink(read_workflow_stream(spark, f"{d}/in", fmt="csv"), f"{d}/out", f"{d}/ckpt",
                         available_now=True, generated_at="t0")
    q.awaitTermination(300)
    got = spark.read.parquet(f"{d}/out")
    want = generate_alerts(w, generated_at="t0", dedup=False)
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == want.count()
