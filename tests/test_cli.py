import tempfile

from conftest import SF_SMALL

from opsrisk.plans import cli
from opsrisk.sources import files as IO
from opsrisk.sources import tables


def test_cli_train_then_run(spark):
    d = tempfile.mkdtemp(prefix="opsrisk-cli-", dir="/tmp")
    tables.workflows_labeled(spark, SF_SMALL).write.parquet(f"{d}/w.parquet")
    assert cli.main(["train", "--data-path", f"{d}/w.parquet", "--model-path", f"{d}/m", "--metadata-path",
                     f"{d}/m.json", "--num-trees", "5"], spark=spark) == 0
    assert cli.main(["run", "--data-path", f"{d}/w.parquet", "--model-path", f"{d}/m", "--output-dir", f"{d}/out"],
                    spark=spark) == 0
    assert IO.path_exists(spark, f"{d}/out/reports/kpi_summary.json")


def test_cli_missing_model_and_data(spark):
    d = tempfile.mkdtemp(prefix="opsrisk-cli-", dir="/tmp")
    assert cli.main(["run", "--data-path", f"{d}/none.csv", "--model-path", f"{d}/m", "--output-dir", f"{d}/o"],
                    spark=spark) == 2
