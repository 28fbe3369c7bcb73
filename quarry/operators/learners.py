"""Tree-ensemble learners (M1-M5).

* ``random_forest``  -> Spark ML's ``RandomForestRegressor`` (every feature considered per split)
* ``xgboost``        -> histogram boosting (``boosting.py``), grown by level, second-order gain with L2
* ``lightgbm``       -> the same, grown best leaf first up to ``num_leaves``

The forest accepts neither NULL nor NaN, so its features must be imputed first; boosters learn a side for them.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import boosting

MAX_DEPTH_LIMIT = 30
log = logging.getLogger(__name__)

# Learner parameter names, their equivalents here, and the boosters' defaults.
PARAM_MAP = {
    "random_forest": {"n_estimators": "numTrees", "max_depth": "maxDepth", "min_samples_leaf": "minInstancesPerNode",
                      "max_features": "featureSubsetStrategy", "max_bins": "maxBins", "seed": "seed",
                      "subsample": "subsamplingRate", "bootstrap": "bootstrap"},
    "xgboost": {"n_estimators": "rounds", "max_depth": "max_depth", "max_leaves": "max_leaves", "learning_rate": "rate", "eta": "rate",
                "reg_lambda": "l2", "reg_alpha": "l1", "gamma": "min_gain", "min_child_weight": "min_weight", "subsample": "rows",
                "colsample_bytree": "columns", "max_bin": "bins", "max_bins": "bins", "seed": "seed", "random_state": "seed"},
    "lightgbm": {"n_estimators": "rounds", "max_depth": "max_depth", "num_leaves": "max_leaves", "learning_rate": "rate",
                 "reg_lambda": "l2", "reg_alpha": "l1", "min_split_gain": "min_gain", "min_child_samples": "min_weight", "subsample": "rows",
                 "colsample_bytree": "columns", "max_bin": "bins", "max_bins": "bins", "seed": "seed", "random_state": "seed"},
}
BOOSTERS = {
    "xgboost": {"rounds": 100, "rate": 0.3, "max_depth": 6, "max_leaves": None, "l2": 1.0, "min_weight": 1.0},
    "lightgbm": {"rounds": 100, "rate": 0.1, "max_depth": None, "max_leaves": 31, "l2": 0.0, "min_weight": 20.0},
}
LEARNERS = tuple(PARAM_MAP)


@dataclass
class FittedModel:
    learner: str
    features: list[str]
    label: str
    model: object
    params: dict = field(default_factory=dict)

    def predict(self, df: DataFrame, pred_col: str = "prediction") -> DataFrame:
        if isinstance(self.model, boosting.BoostedModel):
            out = self.model.transform(df).drop("features")
        else:
            assembled = df if "features" in df.columns else assemble(df, self.features)
            out = self.model.transform(assembled).drop("features")
        return out.withColumnRenamed("prediction", pred_col) if pred_col != "prediction" else out

    def importances(self, spark) -> DataFrame:
        """M5: shares of the impurity or gain that splits save, descending."""
        boosted = isinstance(self.model, boosting.BoostedModel)
        imp = self.model.gains() if boosted else self.model.featureImportances.toArray().tolist()
        rows = sorted(zip(self.features, imp), key=lambda t: (-t[1], t[0]))
        return spark.createDataFrame(rows, "feature string, importance double")


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error").transform(df)


def _subset_strategy(v) -> str:
    """A whole number is a number of features, a fraction a share of them (1.0: all)."""
    if isinstance(v, str):
        return v
    if isinstance(v, int):
        return str(v)
    return "all" if v >= 1.0 else str(float(v))


def spark_params(learner: str, params: dict | None) -> dict:
    """Translate learner parameters; names a learner does not know are dropped."""
    mapping = PARAM_MAP[learner]
    out = {}
    for k, v in (params or {}).items():
        if k not in mapping or v is None:
            continue
        sk = mapping[k]
        if sk in ("numTrees", "maxDepth", "minInstancesPerNode", "maxBins", "seed"):
            v = int(round(float(v)))
        elif sk == "subsamplingRate":
            v = float(v)
        elif sk == "bootstrap":
            v = bool(v)
        elif sk == "featureSubsetStrategy":
            v = _subset_strategy(v)
        out[sk] = v
    if "maxDepth" in out:
        if not 1 <= out["maxDepth"] <= MAX_DEPTH_LIMIT:
            log.warning("max_depth %s is outside 1 to %s", out["maxDepth"], MAX_DEPTH_LIMIT)
        out["maxDepth"] = max(1, min(out["maxDepth"], MAX_DEPTH_LIMIT))
    if "subsamplingRate" in out:
        out["subsamplingRate"] = min(1.0, max(1e-3, out["subsamplingRate"]))
    return out


def booster_settings(learner: str, params: dict | None) -> boosting.Settings:
    """A booster's parameters over its defaults; names it does not know are dropped. Shares are shares (1 and
    1.0: all); a depth or number of leaves of 0 or less is no limit."""
    out = dict(BOOSTERS[learner])
    for k, v in (params or {}).items():
        name = PARAM_MAP[learner].get(k)
        if name is None or v is None:
            continue
        if name in ("rounds", "max_depth", "max_leaves", "bins", "seed"):
            v = int(round(float(v)))
            v = None if name in ("max_depth", "max_leaves") and v <= 0 else v
        else:
            v = float(v)
        out[name] = min(1.0, max(1e-3, v)) if name in ("rows", "columns") else v
    return boosting.Settings(**out)


def fit(learner: str, train: DataFrame, features: list[str], label: str, params: dict | None = None,
        cuts: list[list[float]] | None = None) -> FittedModel:
    """M1-M3: fit one learner on the training rows (imputed, for the forest), or on rows that already have their feature
    vector, or, for a booster, bins that ``boosting.prepare`` made with ``cuts``."""
    if learner not in PARAM_MAP:
        raise ValueError(f"unknown learner {learner!r}; expected one of {LEARNERS}")
    if learner in BOOSTERS:
        model = boosting.fit(train, features, label, booster_settings(learner, params), cuts)
        return FittedModel(learner, list(features), label, model, dict(params or {}))
    sp = spark_params(learner, params)
    sp.setdefault("seed", 42)
    sp.setdefault("featureSubsetStrategy", "all")
    if "features" not in train.columns:
        train = assemble(train.select(*features, F.col(label).cast("double").alias(label)), features)
    model = RandomForestRegressor(featuresCol="features", labelCol=label, **sp).fit(train)
    return FittedModel(learner, list(features), label, model, dict(params or {}))
