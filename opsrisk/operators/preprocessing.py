"""Feature preprocessing fitted on the training split (F1-F5), as pyspark.ml stages.

``WorkflowFeatures`` adds the five ratios (P7). ``WorkflowPreprocessor``
learns, in a few aggregate passes and nothing gathered per row:
exact medians of the 16 numeric features (F1), mean and population standard
deviation after imputation (F2), the most frequent value of each categorical
with ties to the smallest (F3), and the sorted category lists (F4). Its model
is one projection: impute, scale, one-hot (unseen or missing → all zeros),
then a ``VectorAssembler`` (F5). One-hot blocks are sparse, so a column of many values stays one column. All fitted state is in params, so the
stages save and load with the ``PipelineModel``.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ratios import as_double
from ..schema import CATEGORICAL_FEATURES, LEAKAGE_COLUMNS, NUMERIC_FEATURES
from .features import engineer_features
from .selection import exact_medians, narrow_input


class WorkflowFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """P7 as a pipeline stage (input unchanged plus the five ratios)."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return engineer_features(dataset)


class _PrepParams(Params):
    numericCols = Param(Params._dummy(), "numericCols", "numeric feature columns", TypeConverters.toListString)
    categoricalCols = Param(Params._dummy(), "categoricalCols", "categorical feature columns", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "feature vector column", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(numericCols=list(NUMERIC_FEATURES), categoricalCols=list(CATEGORICAL_FEATURES), outputCol="features")


class WorkflowPreprocessor(Estimator, _PrepParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, numericCols=None, categoricalCols=None, outputCol=None, materialize=None):
        super().__init__()
        kwargs = {k: v for k, v in self._input_kwargs.items() if v is not None and k != "materialize"}
        self._set(**kwargs)
        self.materialize = materialize  # False: the fitted frame is read from a table, so passes over it are cheap

    def _fit(self, dataset: DataFrame) -> "WorkflowPreprocessorModel":
        num = self.getOrDefault(self.numericCols)
        cat = self.getOrDefault(self.categoricalCols)
        leaked = sorted(set(num + cat) & set(LEAKAGE_COLUMNS))
        if leaked:
            raise ValueError(f"leakage columns used as features: {leaked}")
        stats = fit_statistics(dataset, num, cat, self.materialize)
        model = WorkflowPreprocessorModel()
        model._set(
            numericCols=num,
            categoricalCols=cat,
            outputCol=self.getOrDefault(self.outputCol),
            statistics=json.dumps(stats),
        )
        return model


class WorkflowPreprocessorModel(Model, _PrepParams, DefaultParamsReadable, DefaultParamsWritable):
    statistics = Param(Params._dummy(), "statistics", "fitted statistics (JSON)", TypeConverters.toString)

    def stats(self) -> dict:
        return json.loads(self.getOrDefault(self.statistics))

    def input_columns(self) -> list[str]:
        return list(self.getOrDefault(self.numericCols)) + list(self.getOrDefault(self.categoricalCols))

    def vector_layout(self) -> list[str]:
        """Slot names of the output vector, in order."""
        s = self.stats()
        names = list(self.getOrDefault(self.numericCols))
        for c in self.getOrDefault(self.categoricalCols):
            names += [f"{c}={v}" for v in s["categories"][c]]
        return names

    def _transform(self, dataset: DataFrame) -> DataFrame:
        s = self.stats()
        cols = {}
        slots = []
        for c in self.getOrDefault(self.numericCols):
            x = F.coalesce(as_double(c), F.lit(s["median"][c] if s["median"][c] is not None else 0.0))
            cols[f"__n_{c}"] = (x - F.lit(s["mean"][c])) / F.lit(s["scale"][c])
            slots.append(f"__n_{c}")
        cat = [c for c in self.getOrDefault(self.categoricalCols) if s["categories"][c]]
        text, index, block = ([f"__{kind}_{c}" for c in cat] for kind in ("t", "i", "o"))
        for c, t in zip(cat, text):
            cols[t] = F.coalesce(F.col(c).cast("string"), F.lit(s["mode"][c]))
        out = self.getOrDefault(self.outputCol)
        staged = dataset.withColumns(cols)
        if cat:
            # a value not seen in the fit gets the index after the last one, which the encoder drops
            for c, t, i in zip(cat, text, index):
                staged = StringIndexerModel.from_labels(s["categories"][c], t, outputCol=i, handleInvalid="keep").transform(staged)
            staged = OneHotEncoder(inputCols=index, outputCols=block, dropLast=True).fit(staged).transform(staged)
        assembled = VectorAssembler(inputCols=slots + block, outputCol=out, handleInvalid="keep").transform(staged)
        return assembled.drop(*slots, *text, *index, *block)


def fit_statistics(df: DataFrame, numeric: list[str], categorical: list[str], materialize: bool | None = None) -> dict:
    """F1-F4 statistics over ``df``: bounded driver results only."""
    # the numeric block alone, materialised once unless the input is persisted
    num_df, cols = narrow_input(df, {c: as_double(c) for c in numeric}, materialize)
    medians = exact_medians(num_df.select(*[cols[c].alias(c) for c in numeric]), numeric, materialize=False)
    imputed = {c: F.coalesce(cols[c], F.lit(medians[c] if medians[c] is not None else 0.0)) for c in numeric}
    moments = num_df.agg(
        *[F.avg(e).alias(f"m_{c}") for c, e in imputed.items()],
        *[F.stddev_pop(e).alias(f"s_{c}") for c, e in imputed.items()],
    ).first()
    mean = {c: float(moments[f"m_{c}"] or 0.0) for c in numeric}
    # a constant column keeps scale 1 (its centred values are all 0)
    scale = {c: (float(moments[f"s_{c}"]) if moments[f"s_{c}"] else 1.0) for c in numeric}
    modes, categories = categorical_statistics(df, categorical) if categorical else ({}, {})
    return {"median": medians, "mean": mean, "scale": scale, "mode": modes, "categories": categories}


def categorical_statistics(df: DataFrame, categorical: list[str]) -> tuple[dict, dict]:
    """Most frequent value per column (ties → smallest) and the sorted category
    lists after imputation. One exploded ``groupBy``; the lists are the model's own content, one entry for each category."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in categorical])
    counts = (
        df.select(F.explode(pairs).alias("p"))
        .select("p.feature", "p.value")
        .where(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    modes: dict[str, str | None] = {c: None for c in categorical}
    best: dict[str, tuple[int, str]] = {}
    cats: dict[str, set] = {c: set() for c in categorical}
    for r in counts:
        f, v, n = r["feature"], r["value"], int(r["n"])
        cats[f].add(v)
        cur = best.get(f)
        if cur is None or n > cur[0] or (n == cur[0] and v < cur[1]):
            best[f] = (n, v)
    for f, (_n, v) in best.items():
        modes[f] = v
    return modes, {c: sorted(cats[c]) for c in categorical}


def category_modes(df: DataFrame, categorical: list[str]) -> DataFrame:
    """F3 as a frame: (feature, mode) via min(struct(-count, value)): two partial aggregates."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in categorical])
    counts = (
        df.select(F.explode(pairs).alias("p"))
        .select("p.feature", "p.value")
        .where(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.groupBy("feature").agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col("value"))).alias("b")).select(
        "feature", F.col("b.value").alias("mode")
    )
