"""Boosted trees on the log scale of the target, candidates chosen on validation rows, and the preparation of an experiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.operators import encode, metrics, records


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="keep").transform(df)


def boosted(train: DataFrame, rows: DataFrame, features: list[str], target: str = "y", params: dict | None = None) -> DataFrame:
    """``rows`` with ``prediction``: gradient-boosted trees fitted on log(1 + target) of ``train``, turned back and never below zero."""
    from pyspark.ml.regression import GBTRegressor

    settings = {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "seed": 17} | (params or {})
    model = GBTRegressor(featuresCol="_features", labelCol="_z", predictionCol="_p", **settings).fit(_assembled(train.withColumn("_z", F.log1p(target)), features))
    return model.transform(_assembled(rows, features)).withColumn("prediction", F.greatest(F.expm1("_p"), F.lit(0.0))).drop("_features", "_p")


def chosen(train: DataFrame, validation: DataFrame, features: list[str], candidates: dict[str, dict], target: str = "y") -> tuple[str, DataFrame]:
    """The candidate with the least error on validation rows, and all with theirs (``name, mae, medae``); the list of candidates is bounded by its author."""
    if not candidates:
        raise ValueError("no candidates")
    scored = None
    for name, params in candidates.items():
        rows = boosted(train, validation, features, target, params).select(F.lit(name).alias("name"), F.col(target).alias("y"), "prediction")
        scored = rows if scored is None else scored.unionByName(rows)
    errors = metrics.regression_metrics(scored, ["name"]).select("name", "mae", "medae")
    best = encode.best_candidate(errors.withColumn("_all", F.lit(1)), ["_all"]).head()
    return best["name"], errors


def prepared(spark: SparkSession, cases: DataFrame, features: list[str], path: str, key: str = "case_id", target: str = "y", split: str = "split") -> None:
    """The inputs of an experiment under ``path``: index, targets and features by split, and serialised records; outcome columns are refused among features."""
    records.reject_names(features)
    cases.select(key, split).write.mode("errorifexists").parquet(f"{path}/index")
    cases.select(key, split, F.col(target).alias("y"), (F.col(target) > 0).cast("int").alias("y_binary")).write.mode("errorifexists").partitionBy(split).parquet(f"{path}/targets")
    cases.select(key, split, *features).write.mode("errorifexists").partitionBy(split).parquet(f"{path}/features")
    records.serialised(cases.select(key, *features), key).join(cases.select(key, split), key).write.mode("errorifexists").partitionBy(split).parquet(f"{path}/records")
