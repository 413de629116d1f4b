"""Alerts and recommendations over a stream of workflow records.

Features, rules, alert rows and recommendations are stateless Column
expressions, so the batch operators apply unchanged to a streaming frame, without
state: every record of the stream gets its alerts, none is dropped as late. A fitted ``PipelineModel`` (all stages row-wise) can score the stream for R7.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import alerts as A
from ..operators import models as M
from ..operators.rules import with_triggers
from ..schema import DEFAULT_RULE_CONFIG, LABELED_WORKFLOW_SCHEMA, RuleConfig
from ..session import scratch_path
from ..sources.files import CSV_DIALECT, type_workflows


def read_workflow_stream(spark: SparkSession, path: str, fmt: str = "parquet", max_files_per_trigger: int = 100) -> DataFrame:
    """Files arriving under ``path`` as a typed workflow stream (schema fixed up front)."""
    reader = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        text = LABELED_WORKFLOW_SCHEMA.fields
        from pyspark.sql import types as T

        schema = T.StructType([T.StructField(f.name, T.StringType()) for f in text])
        return type_workflows(reader.schema(schema).options(**CSV_DIALECT).csv(path))
    return type_workflows(reader.schema(LABELED_WORKFLOW_SCHEMA).parquet(path))


def scored_stream(stream: DataFrame, cfg: RuleConfig = DEFAULT_RULE_CONFIG, model: PipelineModel | None = None) -> DataFrame:
    if model is not None:
        stream = M.predict(model, stream)
    return with_triggers(stream, cfg, "predicted_risk" if model is not None else None)


def alert_stream(stream: DataFrame, cfg: RuleConfig = DEFAULT_RULE_CONFIG, model: PipelineModel | None = None,
                 generated_at: str | None = None) -> DataFrame:
    """A1-A2 on a stream, one alert for every trigger of every record (no dedup, so no record is ever late)."""
    return A.alerts_from_scored(scored_stream(stream, cfg, model), generated_at or A.run_timestamp())


def start_alert_sink(stream: DataFrame, output_path: str, checkpoint: str | None = None, fmt: str = "parquet",
                     available_now: bool = False, **kw) -> StreamingQuery:
    """Append alerts to ``output_path``; progress is kept under the shared checkpoint folder."""
    spark = stream.sparkSession
    writer = (
        alert_stream(stream, **kw)
        .writeStream.format(fmt)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "alert-stream"))
        .option("path", output_path)
        .outputMode("append")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def start_recommendation_sink(stream: DataFrame, output_path: str, checkpoint: str | None = None, fmt: str = "parquet",
                              model: PipelineModel | None = None, cfg: RuleConfig = DEFAULT_RULE_CONFIG,
                              available_now: bool = False) -> StreamingQuery:
    spark = stream.sparkSession
    recs = A.recommendations_from_scored(scored_stream(stream, cfg, model), "predicted_risk" if model else None)
    writer = (
        recs.writeStream.format(fmt)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "rec-stream"))
        .option("path", output_path)
        .outputMode("append")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
