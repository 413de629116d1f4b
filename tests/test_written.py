from conftest import row
from pyspark.sql import functions as F

from opsrisk.operators import models as M
from opsrisk.plans import pipeline as L
from opsrisk.plans import train
from opsrisk.session import written


def test_written_frame_is_read_by_column(spark):
    df = spark.range(20).select("id", F.create_map(F.lit("k"), "id").alias("m"), F.lit("x").alias("t"))
    back = written(df, "t")
    assert [r.asDict() for r in back.orderBy("id").collect()] == [r.asDict() for r in df.collect()]
    assert "ReadSchema: struct<id:bigint>" in back.select("id")._jdf.queryExecution().executedPlan().toString()
    untyped = written(df.withColumn("n", F.lit(None)), "t")
    assert untyped.count() == 20 and untyped.columns[-1] == "n"


def test_run_and_training_read_a_written_table(spark, make_df, monkeypatch):
    rows = make_df([row(workflow_id=f"WF-{i}", risk_label=("low", "medium", "high")[i % 3], elapsed_hours=float(i)) for i in range(40)])
    model = M.dummy_pipeline(strategy="most_frequent").fit(rows)
    res = L.run_pipeline(spark, rows, model_path="unused", model=model, generated_at="t")
    assert res.scored.inputFiles() and all(f.endswith(".parquet") for f in res.scored.inputFiles())
    seen = []
    split = M.stratified_split
    monkeypatch.setattr(M, "stratified_split", lambda df, *a, **k: seen.append(df) or split(df, *a, **k))
    train.train_and_evaluate(rows, num_trees=2, max_depth=2, logistic_max_iter=5)
    assert seen[0].inputFiles() and seen[0].count() == 40
