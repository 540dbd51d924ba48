"""Trainable text sentiment: tokens -> hashed term counts -> IDF ->
logistic regression; label POSITIVE / NEGATIVE with the positive-class
probability as score (the reference only reads such labels from a file)."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_sentiment(labelled: DataFrame, text: str, label: str, num_features: int = 1 << 18):
    """``label`` is 1 for positive, 0 for negative. Whole texts are used."""
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"\W+", minTokenLength=2),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_tfidf", minDocFreq=2),
        LogisticRegression(featuresCol="_tfidf", labelCol="_y", regParam=0.01, maxIter=50)])
    return pipe.fit(labelled.withColumn("_y", F.col(label).cast("double")))


def score_sentiment(df: DataFrame, model, pos: str = "POSITIVE", neg: str = "NEGATIVE") -> DataFrame:
    s = model.transform(df).withColumn("score", vector_to_array("probability")[1])
    s = s.withColumn("label", F.when(F.col("score") > 0.5, F.lit(pos)).otherwise(F.lit(neg)))
    return s.drop("_tok", "_tf", "_tfidf", "rawPrediction", "probability", "prediction")
