"""Feature pipelines and the shared fit -> score step."""

from __future__ import annotations

import time

from pyspark.ml import Pipeline
from pyspark.ml.feature import MinMaxScaler, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystack.operators.prep import FeatureSpec


def feature_stages(spec: FeatureSpec, output: str = "features", scale: bool = False,
                   drop_base: bool = True):
    """Indexers and one-hot encoders for categoricals, assembler, optional
    min-max scaling (fitted on the training table). With ``drop_base`` the
    alphabetically first level is the base level and gets no column (R's
    treatment coding): levels are indexed in descending order and the last
    index is dropped."""
    stages, cols = [], list(spec.numeric)
    for c in spec.categorical:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}__i",
                                 stringOrderType="alphabetDesc" if drop_base else "alphabetAsc",
                                 handleInvalid="error"),
                   OneHotEncoder(inputCol=f"{c}__i", outputCol=f"{c}__v", dropLast=drop_base)]
        cols.append(f"{c}__v")
    raw = output + "_raw" if scale else output
    stages.append(VectorAssembler(inputCols=cols, outputCol=raw, handleInvalid="keep"))
    if scale:
        stages.append(MinMaxScaler(inputCol=raw, outputCol=output))
    return stages


def positive_score(df: DataFrame, prob_col: str = "probability", index: int = 1) -> DataFrame:
    return df.withColumn("score", vector_to_array(F.col(prob_col))[index])


def fit_score(estimator, spec: FeatureSpec, train: DataFrame, evaluate: DataFrame, id_col: str,
              scale: bool = False, label_col: str = "label"):
    """Fit ``features -> estimator`` on ``train``; score ``evaluate``.
    Returns (scored (id, label, score), fitted PipelineModel, seconds)."""
    t0 = time.perf_counter()
    est = estimator.copy().setFeaturesCol("features").setLabelCol(label_col)
    model = Pipeline(stages=feature_stages(spec, scale=scale) + [est]).fit(
        train.withColumn(label_col, F.col(spec.label).cast("double")))
    scored = positive_score(model.transform(evaluate.withColumn(label_col, F.col(spec.label).cast("double"))))
    out = scored.select(id_col, F.col(spec.label).alias("label"), "score")
    return out, model, time.perf_counter() - t0
