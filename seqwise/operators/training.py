"""Distributed training of the eight prediction heads with MLlib.

The neural multi-task network is re-aimed as one model per head on the same
window features (6 numeric + one-hot of the last event's name, channel and
hour): weighted logistic regressions for the two binary and four class heads
(class weights as in ``class_weights``), linear regressions for the two
regression heads. Fits are distributed (tree aggregation of gradients); the
output columns are the raw outputs that ``decode_predictions`` and
``evaluate`` consume."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqwise.operators.aggregates import class_weights
from seqwise.operators.windows import LAST_EVENT_FEATURES, NUMERIC_FEATURES

CLASS_HEADS = {  # output: (target, classes, weighted)
    "p_next_event": ("target_next_event", 7, True),
    "p_channel": ("target_channel", 3, True),
    "p_action": ("target_recommended_action", 20, False),
    "p_active_period": ("target_active_period", 4, True),
}
BINARY_HEADS = {"p_purchase": "target_purchase", "p_churn": "target_churn"}
REGRESSION_HEADS = {"p_engagement": "target_engagement", "p_inactivity": "target_inactivity"}
NEG = -1e9  # margin of classes the fitted model never saw


def _features(train: DataFrame):
    enc = OneHotEncoder(inputCols=LAST_EVENT_FEATURES, outputCols=[f"{c}_oh" for c in LAST_EVENT_FEATURES],
                        handleInvalid="keep", dropLast=False)
    asm = VectorAssembler(inputCols=NUMERIC_FEATURES + [f"{c}_oh" for c in LAST_EVENT_FEATURES],
                          outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[enc, asm]).fit(train)


def _with_weight(df: DataFrame, target: str, classes: int, weighted: bool, col: str) -> DataFrame:
    if not weighted:
        return df.withColumn(col, F.lit(1.0))
    w = class_weights(df, target, classes).select(F.col("cls").alias("_cls"), F.col("weight").alias(col))
    return df.join(F.broadcast(w), F.col(target) == F.col("_cls"), "left").drop("_cls") \
             .withColumn(col, F.coalesce(F.col(col), F.lit(1.0)))


def fit_heads(train: DataFrame, max_iter: int = 50, reg: float = 1e-3) -> dict:
    feat = _features(train)
    t = feat.transform(train).select("features", *BINARY_HEADS.values(), *REGRESSION_HEADS.values(),
                                      *[v[0] for v in CLASS_HEADS.values()])
    # Eight fits read the same rows: compute the windows once (memory and disk,
    # recomputed from lineage if an executor is lost); released after the fits.
    t = t.persist()
    try:
        return _fit_all(feat, t, max_iter, reg)
    finally:
        t.unpersist()


def _fit_all(feat, t: DataFrame, max_iter: int, reg: float) -> dict:
    models = {"_features": feat}
    for out, target in BINARY_HEADS.items():
        models[out] = LogisticRegression(featuresCol="features", labelCol=target, weightCol="_w", maxIter=max_iter,
                                         regParam=reg, family="binomial").fit(_with_weight(t, target, 2, True, "_w"))
    for out, (target, classes, weighted) in CLASS_HEADS.items():
        tw = _with_weight(t, target, classes, weighted, "_w")
        models[out] = LogisticRegression(featuresCol="features", labelCol=target, weightCol="_w",
                                         maxIter=max_iter, regParam=reg, family="multinomial").fit(tw)
    for out, target in REGRESSION_HEADS.items():
        models[out] = LinearRegression(featuresCol="features", labelCol=target, maxIter=max_iter,
                                       regParam=reg).fit(t)
    return models


def predict_heads(models: dict, df: DataFrame, keep: list[str]) -> DataFrame:
    """The 8 raw outputs per row (binary: logit; classes: margins padded to
    the head's class count; regressions: value)."""
    x = models["_features"].transform(df).select(*keep, "features")
    cols = []
    for out in BINARY_HEADS:
        m = models[out]
        x = m.setPredictionCol(f"_pred_{out}").setRawPredictionCol(f"_raw_{out}") \
             .setProbabilityCol(f"_prob_{out}").transform(x)
        cols.append(vector_to_array(f"_raw_{out}")[1].alias(out))
    for out, (_, classes, _) in CLASS_HEADS.items():
        m = models[out]
        x = m.setPredictionCol(f"_pred_{out}").setRawPredictionCol(f"_raw_{out}") \
             .setProbabilityCol(f"_prob_{out}").transform(x)
        arr = vector_to_array(f"_raw_{out}")
        pad = F.array_repeat(F.lit(NEG), F.greatest(F.lit(classes) - F.size(arr), F.lit(0)))
        cols.append(F.slice(F.concat(arr, pad), 1, classes).alias(out))
    for out in REGRESSION_HEADS:
        x = models[out].setPredictionCol(out).transform(x)
        cols.append(F.col(out))
    return x.select(*keep, *cols)
