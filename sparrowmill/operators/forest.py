"""District risk by a random forest, with hold-out by state and intervals over trees."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.storage import shared_dir

FEATURES = ("fail_rate", "n_tests", "slope", "state_rate", "season", "wqi", "density")


def _stages(trees: int, depth: int, leaf: int, seed: int) -> list:
    return [
        VectorAssembler(inputCols=list(FEATURES), outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed),
    ]


def _auc(scored: DataFrame) -> float:
    return BinaryClassificationEvaluator(rawPredictionCol="p").evaluate(scored)


def cross_validated(rows: DataFrame, folds: int = 10, trees: int = 200, depth: int = 12, leaf: int = 10, seed: int = 42) -> dict:
    """auc_mean, auc_std (population) and aucs of folds in time: each judged on the quarters after those it is fitted on.

    Quarters in order are cut into folds + 1 runs of about equal length. A fold whose
    training or test rows are of one class has no AUC and is passed over.
    """
    quarters = [r[0] for r in rows.select("quarter").distinct().orderBy("quarter").collect()]
    cuts = [round(k * len(quarters) / (folds + 1)) for k in range(1, folds + 2)]
    aucs = []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        train, test = rows.where(F.col("quarter").isin(quarters[:lo])), rows.where(F.col("quarter").isin(quarters[lo:hi]))
        if any(df.agg(F.countDistinct("label")).first()[0] < 2 for df in (train, test)):
            continue
        scored = Pipeline(stages=_stages(trees, depth, leaf, seed)).fit(train).transform(test)
        aucs.append(_auc(scored.select("label", vector_to_array("probability")[1].alias("p"))))
    return {"auc_mean": float(np.mean(aucs)) if aucs else None, "auc_std": float(np.std(aucs)) if aucs else None, "aucs": aucs}


def top_importances(model, most: int = 3) -> list[tuple[str, float]]:
    """The most important features, dearest first; equal ones in the order of FEATURES."""
    weights = model.stages[-1].featureImportances.toArray()
    return [(FEATURES[k], float(weights[k])) for k in np.argsort(-weights, kind="stable")[:most]]


def save(model, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str):
    return PipelineModel.load(path)


def fit(rows: DataFrame, held_out: tuple[str, ...], trees: int = 300, depth: int = 12, leaf: int = 10, seed: int = 42):
    """A pipeline of scaler and forest fitted on the other states' rows, and (auc, precision, recall) on those held out."""
    stages = _stages(trees, depth, leaf, seed)
    model = Pipeline(stages=stages).fit(rows.where(~F.col("state").isin(*held_out)))
    scored = model.transform(rows.where(F.col("state").isin(*held_out))).select("label", vector_to_array("probability")[1].alias("p"))
    counts = scored.agg(F.count_if((F.col("p") >= 0.5) & (F.col("label") == 1)).alias("tp"), F.count_if(F.col("p") >= 0.5).alias("said"), F.count_if(F.col("label") == 1).alias("pos")).first()
    return model, {"auc": _auc(scored), "precision": counts["tp"] / max(1, counts["said"]), "recall": counts["tp"] / max(1, counts["pos"])}


def _tree_arrays(model) -> list[tuple[np.ndarray, ...]]:
    """feature (-1: a leaf), threshold, left, right and probability of each tree's nodes, as the saved model has them."""
    path = f"{shared_dir(SparkSession.active())}/forest-{uuid.uuid4().hex}"
    model.stages[-1].write().overwrite().save(path)
    nodes = SparkSession.active().read.parquet(f"{path}/data").select("treeID", "nodeData.*").toPandas().sort_values(["treeID", "id"])
    out = []
    for _, t in nodes.groupby("treeID"):
        split = t["split"].tolist()
        counts = np.asarray([np.asarray(s) for s in t["impurityStats"]], float)
        feature = np.asarray([s["featureIndex"] for s in split])
        threshold = np.asarray([s["leftCategoriesOrThreshold"][0] if f >= 0 else 0.0 for s, f in zip(split, feature)])
        out.append((np.where(t["leftChild"] < 0, -1, feature), threshold, t["leftChild"].to_numpy(), t["rightChild"].to_numpy(), counts[:, 1] / counts.sum(1)))
    return out


def scores(model, rows: DataFrame, resamples: int = 200, seed: int = 42) -> DataFrame:
    """rows with risk (0 to 100) and the 2.5 and 97.5 percentiles of means over resampled trees; the trees are walked as arrays."""
    ready = rows
    for stage in model.stages[:-1]:
        ready = stage.transform(ready)
    trees = _tree_arrays(model)
    draws = np.random.default_rng(seed).integers(0, len(trees), (resamples, len(trees)))

    @F.pandas_udf("struct<risk:double,lower:double,upper:double>")
    def interval(x: pd.Series) -> pd.DataFrame:
        if not len(x):
            return pd.DataFrame({"risk": [], "lower": [], "upper": []}, dtype=float)
        table = np.stack(x.to_numpy())
        votes, every = np.zeros((len(x), len(trees))), np.arange(len(x))
        for k, (feature, threshold, left, right, p) in enumerate(trees):
            at = np.zeros(len(x), int)
            while (inner := feature[at] >= 0).any():
                low = table[every, np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(low, left[at], right[at]), at)
            votes[:, k] = p[at]
        means = np.stack([votes[:, d].mean(1) for d in draws], 1)
        lower, upper = np.percentile(means, (2.5, 97.5), axis=1)
        return pd.DataFrame({"risk": 100 * votes.mean(1), "lower": 100 * lower, "upper": 100 * upper})

    return ready.withColumn("s", interval(vector_to_array("features"))).select(*rows.columns, "s.risk", "s.lower", "s.upper")
