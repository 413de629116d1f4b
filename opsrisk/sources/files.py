"""Sources and sinks.

Reads never repair or drop rows: every column is read as text, the missing
value tokens are mapped to null, and typed columns come from lenient casts
(bad number or date → null, which validation then reports). Sinks write
Spark-style directories (one part file per task), so writes scale with the
cluster; the KPI and metadata JSON documents are KBs and go through the
Hadoop FileSystem API from the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..schema import (
    ALERT_COLUMNS,
    DATETIME_COLUMNS,
    DOUBLE_COLUMNS,
    LONG_COLUMNS,
    PREDICTION_COLUMNS,
    RECOMMENDATION_COLUMNS,
    RISK_LABELS,
)

# fixed values: text tokens read as missing (the pandas CSV reader's default set)
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


# --- file system helpers (Hadoop FS: local, HDFS, object stores alike) ---------------


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_path(spark, path)
    return bool(fs.exists(p))


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a folder was written to its end (Spark's success mark); a plain file is complete if it exists."""
    fs, p = _fs_path(spark, path)
    return bool(fs.exists(p)) and (bool(fs.getFileStatus(p).isFile()) or path_exists(spark, path.rstrip("/") + "/_SUCCESS"))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write one small UTF-8 document (overwrite)."""
    fs, p = _fs_path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """Read one small UTF-8 document; whole-file read through the FS API."""
    fs, p = _fs_path(spark, path)
    jvm = spark.sparkContext._jvm
    stream = fs.open(p)
    try:
        data = jvm.org.apache.commons.io.IOUtils.toByteArray(stream)
    finally:
        stream.close()
    return bytes(data).decode("utf-8")


# --- S1-S3: workflow scan --------------------------------------------------------------


def _na_to_null(c: Column) -> Column:
    return F.when(~F.coalesce(c.isin(*NA_TOKENS), F.lit(False)), c)


def _typed(name: str, c: Column) -> Column:
    """Lenient typing of one text column by contract type."""
    if name in DOUBLE_COLUMNS:
        d = c.try_cast("double")
        return F.when(~F.isnan(d), d).alias(name)
    if name in LONG_COLUMNS:
        # counts may be fractional (7.5, -1.5): they are checked and used as they stand
        d = c.try_cast("double")
        return F.when(~F.isnan(d), d).alias(name)
    if name in DATETIME_COLUMNS:
        return c.try_cast("timestamp_ntz").alias(name)
    return c.alias(name)


def parse_timestamps(df: DataFrame) -> DataFrame:
    """Lenient parse of the datetime columns that are present and still text."""
    types = dict(df.dtypes)
    return df.withColumns(
        {c: F.col(c).try_cast("timestamp_ntz") for c in DATETIME_COLUMNS if c in types and types[c] == "string"}
    )


UNPARSED = "_unparsed"


def type_workflows(raw: DataFrame) -> DataFrame:
    """Text columns → contract types (unknown extra columns stay text).

    Numeric text that does not parse becomes null in its typed column and is
    kept, unchanged, in the ``_unparsed`` map (column → original text; null when
    the row has none), so loading never loses what the source held."""
    cols = []
    rescued = []
    for name, typ in raw.dtypes:
        c = F.col(f"`{name}`")
        if name == _ROW_TEXT:
            rescued.append(F.when(c.isNotNull(), F.struct(F.lit(name).alias("k"), c.alias("v"))))
            continue
        if typ == "string":
            text = _na_to_null(c)
            typed = _typed(name, text)
            cols.append(typed)
            if name in DOUBLE_COLUMNS or name in LONG_COLUMNS:
                rescued.append(F.when(text.isNotNull() & typed.isNull(), F.struct(F.lit(name).alias("k"), text.alias("v"))))
        elif name in DATETIME_COLUMNS and typ != "timestamp_ntz":
            cols.append(c.try_cast("timestamp_ntz").alias(name))
        elif name in DOUBLE_COLUMNS and typ != "double":
            cols.append(c.try_cast("double").alias(name))
        elif name in LONG_COLUMNS and typ not in ("bigint", "double"):
            cols.append(c.try_cast("double" if typ in ("float",) or typ.startswith("decimal") else "bigint").alias(name))
        else:
            cols.append(c)
    if rescued and UNPARSED not in raw.columns:
        kept = F.filter(F.array(*rescued), lambda x: x.isNotNull())
        cols.append(F.when(F.size(kept) > 0, F.map_from_entries(kept)).alias(UNPARSED))
    return raw.select(*cols)


# Quotes inside a quoted field are doubled, on read and write; a backslash is an ordinary character.
CSV_DIALECT = {"header": True, "quote": '"', "escape": '"'}
_ROW_TEXT = "_row_text"


def _scan_csv(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """Text columns by the header. A row with another number of fields keeps its text in ``_row_text``."""
    reader = spark.read.options(**CSV_DIALECT).option("multiLine", multi_line)
    names = reader.option("inferSchema", False).csv(path).columns
    fields = [T.StructField(c, T.StringType()) for c in [*names, _ROW_TEXT]]
    return reader.schema(T.StructType(fields)).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _ROW_TEXT).csv(path)


def load_workflow_data(spark: SparkSession, path: str, fmt: str | None = None, multi_line: bool = True) -> DataFrame:
    """Scan a workflow table (CSV with header, or parquet) with contract types.

    Quoted CSV fields may hold quotes (doubled), commas and, with ``multi_line``, line ends; a file is
    then one scan task, so very large files without line ends in fields are better read without it.
    A row with too many or too few fields keeps its whole text in ``_unparsed`` under ``_row_text``.

    Raises ``FileNotFoundError`` when the path does not exist (S3)."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"Workflow data file not found: {path}")
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    try:
        if fmt == "parquet":
            raw = spark.read.parquet(path)
        else:
            raw = _scan_csv(spark, path, multi_line)
    except AnalysisException as e:  # path vanished between the check and the scan
        raise FileNotFoundError(f"Workflow data file not found: {path}") from e
    return type_workflows(raw)


# --- S4-S7: output sinks ------------------------------------------------------------------


def predictions_flat(predictions: DataFrame) -> DataFrame:
    """Probability map → one column per label (missing class → null), factors joined by '; '."""
    cols = [F.col("workflow_id"), F.col("predicted_risk")]
    cols += [F.try_element_at("risk_probability", F.lit(label)).alias(f"risk_probability_{label}") for label in RISK_LABELS]
    cols.append(F.array_join("risk_factors", "; ").alias("risk_factors"))
    return predictions.select(*cols)


# Quoted fields may hold line ends, so a reader takes a file whole: files stay small however large a task's part is.
CSV_FILE_ROWS = 200_000


def _write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**CSV_DIALECT).option("maxRecordsPerFile", CSV_FILE_ROWS).csv(path)


def save_predictions(predictions: DataFrame, path: str) -> None:
    flat = predictions if "risk_probability" not in predictions.columns else predictions_flat(predictions)
    _write_csv(flat.select(*PREDICTION_COLUMNS), path)


def save_alerts(alerts: DataFrame, path: str) -> None:
    """Fixed column order; an empty result still writes the header."""
    _write_csv(alerts.select(*ALERT_COLUMNS), path)


def save_recommendations(recs: DataFrame, path: str) -> None:
    """S6."""
    _write_csv(recs.select(*RECOMMENDATION_COLUMNS), path)


def save_json(spark: SparkSession, doc: dict, path: str) -> None:
    """A small nested document, indent 2."""
    write_text(spark, path, json.dumps(doc, indent=2))


def _categories_path(path: str) -> str:
    return path.removesuffix(".json") + "_categories"


def save_kpi_categories(categories: DataFrame, path: str) -> None:
    """The category rows beside the document ``path``, as a folder of JSON lines."""
    categories.write.mode("overwrite").json(_categories_path(path))


CATEGORIES_SCHEMA = "dimension string, value string, workflow_count bigint, avg_sla_utilization double, avg_error_rate double"


def load_json(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, path))


# --- S8: model persistence -----------------------------------------------------------------


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str):
    from pyspark.ml import PipelineModel

    if not path_exists(spark, path):
        raise FileNotFoundError(f"Trained model not found at {path}. Run the training job first.")
    return PipelineModel.load(path)


# --- S10: reload of saved outputs ------------------------------------------------------------

PREDICTIONS_SCHEMA = T.StructType(
    [T.StructField("workflow_id", T.StringType()), T.StructField("predicted_risk", T.StringType())]
    + [T.StructField(f"risk_probability_{label}", T.DoubleType()) for label in RISK_LABELS]
    + [T.StructField("risk_factors", T.StringType())]
)
ALERTS_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ALERT_COLUMNS])
RECOMMENDATIONS_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RECOMMENDATION_COLUMNS])


def _read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.options(**CSV_DIALECT).option("multiLine", True).schema(schema).csv(path)


def load_outputs(spark: SparkSession, paths: dict[str, str]) -> dict | None:
    """Reload predictions, alerts, recommendations (lazy frames) and the KPI document.

    ``paths`` keys: predictions, alerts, recommendations, kpi_summary and
    optionally workflows (raw table) and metadata. None when any of the four
    outputs is missing or was not written to its end; raw table and metadata are optional."""
    required = ("predictions", "alerts", "recommendations", "kpi_summary")
    if any(not is_complete(spark, paths[k]) for k in required):
        return None
    out = {
        "predictions": _read_csv(spark, paths["predictions"], PREDICTIONS_SCHEMA),
        "alerts": _read_csv(spark, paths["alerts"], ALERTS_SCHEMA),
        "recommendations": _read_csv(spark, paths["recommendations"], RECOMMENDATIONS_SCHEMA),
        "kpi_summary": load_json(spark, paths["kpi_summary"]),
        "kpi_categories": None,
        "workflows": None,
        "model_metadata": None,
    }
    categories = _categories_path(paths["kpi_summary"])
    if is_complete(spark, categories):
        out["kpi_categories"] = spark.read.schema(CATEGORIES_SCHEMA).json(categories)
    raw = paths.get("workflows")
    if raw and path_exists(spark, raw):
        out["workflows"] = load_workflow_data(spark, raw)
    meta = paths.get("metadata")
    if meta and path_exists(spark, meta):
        out["model_metadata"] = load_json(spark, meta)
    return out
