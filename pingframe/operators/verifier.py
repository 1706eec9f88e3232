"""Second-stage verifier: boosted trees on the thirteen features, scene-level holdout."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import FEATURE_NAMES
from .evaluation import accuracy, roc_auc


def holdout_scenes(rows: DataFrame, val_frac: float = 0.25, seed: int = 0, scene: str = "scene") -> DataFrame:
    """Adds `split`: whole scenes go to `val` by rank of a seeded hash; neither side is left empty."""
    from .scale import ranked
    scenes = rows.select(scene).distinct().withColumn("_h", F.xxhash64(F.lit(seed), F.col(scene)))
    n = scenes.count()
    n_val = min(max(1, round(val_frac * n)), n - 1) if val_frac > 0 else 0
    order = ranked(scenes, [], [F.asc("_h"), F.asc(scene)], "_r")
    return rows.join(order.select(scene, F.when(F.col("_r") <= n_val, "val").otherwise("train").alias("split")), scene)


def train_verifier(rows: DataFrame, label: str = "label", seed: int = 0, val_frac: float = 0.25, rounds: int = 20,
                   depth: int = 3) -> tuple[PipelineModel, DataFrame]:
    """Fitted pipeline and its held-out (auc, accuracy) from feature rows with `scene` and a 0/1 label."""
    split = holdout_scenes(rows, val_frac, seed)
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=FEATURE_NAMES, outputCol="features", handleInvalid="error"),
        GBTClassifier(labelCol=label, featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed)])
    model = pipe.fit(split.where("split = 'train'"))
    held = score_features(model, split.where("split = 'val'"))
    auc = roc_auc(held, "verifier_p", label)
    acc = accuracy(held, 0.5, "verifier_p", label)
    return model, auc.withColumn("_k", F.lit(1)).join(acc.withColumn("_k", F.lit(1)), "_k").drop("_k")


def score_features(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds `verifier_p`; refuses a model fitted on another feature order."""
    order = model.stages[0].getInputCols()
    if list(order) != FEATURE_NAMES:
        raise ValueError(f"verifier expects features {FEATURE_NAMES}, model has {list(order)}")
    scored = model.transform(rows)
    return scored.withColumn("verifier_p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
