import glob
import tempfile

from pyspark.sql import functions as F

from opsrisk.sources import files as IO
from opsrisk.sources import runs


def test_csv_files_hold_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(IO, "CSV_FILE_ROWS", 100)
    base = tempfile.mkdtemp(prefix="opsrisk-growth-", dir="/tmp")
    alerts = spark.range(0, 950, numPartitions=1).select(*[F.concat(F.lit(f"{c}\n"), F.col("id").cast("string")).alias(c) for c in IO.ALERT_COLUMNS])
    IO.save_alerts(alerts, f"{base}/alerts")
    run = runs.commit(spark, runs.write_table(spark, runs.start(f"{base}/runs"), "alerts", "alerts", alerts, "csv"))
    for path in (f"{base}/alerts", run.path("alerts")):
        assert len(glob.glob(f"{path}/*.csv")) == 10
    assert runs.verify(spark, run) == []
    assert IO._read_csv(spark, f"{base}/alerts", IO.ALERTS_SCHEMA).exceptAll(alerts).count() == 0
