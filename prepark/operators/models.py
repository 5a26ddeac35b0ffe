"""Model operators on MLlib: F2/F5 logistic regression, F8/F9 random forest, A11 save/load.

scikit-learn's LogisticRegression(C=1) minimises sum(logloss) + ||w||^2 / 2;
MLlib minimises mean(logloss) + regParam/2 ||w||^2, so regParam = 1/n_train
with no standardisation is the same objective. Trees are binned, so forests match
in metrics, not in splits; they are grown by ``forest`` from counted cells, and by MLlib
only where these are too many for a task.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IndexToString, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kinds import numeric_columns, path_not_found, qcol
from ..session import write_scratch
from .forest import ForestModel, fit_forest
from .metrics import accuracy, roc_auc, split_column


def _prepare(df: DataFrame, target: str, dropna: bool = True, numeric_only: bool = True) -> tuple[DataFrame, list[str]]:
    if target not in df.columns:
        raise ValueError(f"nothing to learn: the table has no column {target!r}")
    if dropna:
        df = df.dropna()
    feats = numeric_columns(df, exclude=[target]) if numeric_only else [c for c in df.columns if c != target]
    if not feats:
        raise ValueError("the table has no number column to learn from")
    return df, feats


MAX_CLASSES = 100


def _classes(df: DataFrame, target: str) -> list | None:
    """The target's values in sorted order, or None if they are 0 and 1 already."""
    values = [r[0] for r in df.select(qcol(target)).dropna().distinct().limit(MAX_CLASSES + 1).collect()]
    if len(values) > MAX_CLASSES:
        raise ValueError(f"{target!r} has over {MAX_CLASSES} values: too many to be classes")
    if all(not isinstance(v, (str, bool)) and float(v) in (0.0, 1.0) for v in values):
        return None
    return sorted(values)


def _complete(feats: list[str]):
    """True where no feature is missing (null or NaN)."""
    good = F.lit(True)
    for c in feats:
        x = qcol(c).cast("double")
        good = good & x.isNotNull() & ~F.isnan(F.coalesce(x, F.lit(0.0)))
    return good


def _evaluate(pred: DataFrame) -> dict:
    acc = accuracy(pred, "label", "prediction").first()["accuracy"]
    scored = pred.select("label", vector_to_array("probability")[1].alias("score"))
    n_classes = pred.select("label").distinct().limit(3).count()
    auc = roc_auc(scored, "label", "score").first()["roc_auc"] if n_classes == 2 else None
    return {"accuracy": None if acc is None else float(acc), "roc_auc": None if auc is None else float(auc)}


def train_logistic(df: DataFrame, target: str = "target", key: str | list[str] | None = None,
                   max_iter: int = 2000, test_fraction: float = 0.2, seed: int = 42,
                   dropna: bool = True, numeric_only: bool = True) -> tuple[PipelineModel, dict]:
    """drop missing rows, numeric features, >= 10 rows, 80/20 split by key
    hash (F1), fit, and report accuracy and ROC AUC on the test part.

    Returns the fitted pipeline (features in ``model.feature_names``) and the
    metrics dict. The target may hold any values (text, booleans, numbers other
    than 0 and 1): they become classes in sorted order, and the pipeline ends with
    their names (``predicted_label``); over ``MAX_CLASSES`` of them are an error (an id taken
    for a class). The split needs a row key; by default the
    features themselves are hashed. The reference's second variant is
    ``max_iter=1000, dropna=False, numeric_only=False`` (every column must
    then already be a number; rows with a missing feature are not learned from).
    """
    df, feats = _prepare(df, target, dropna, numeric_only)
    k = (qcol(key) if isinstance(key, str) else F.struct(*[qcol(c) for c in key])) if key else \
        F.struct(*[qcol(c) for c in feats])
    classes = _classes(df, target)
    label = (qcol(target) if classes is None
             else F.nullif(F.array_position(F.array(*[F.lit(v) for v in classes]), qcol(target)), F.lit(0)) - 1).cast("double")
    tagged = df.select(*[qcol(c).cast("double").alias(c) for c in feats],
                       label.alias("label"), split_column(k, test_fraction, seed).alias("_split"))
    tagged = tagged.where(_complete(feats) & F.col("label").isNotNull())
    counts = {r["_split"]: r["n"] for r in tagged.groupBy("_split").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_rows = sum(counts.values())
    if n_rows < 10:
        raise ValueError(f"{n_rows} complete rows are too few to split and learn from; 10 is the least")
    n_train = counts.get("train", 0)
    lr = LogisticRegression(featuresCol="features", labelCol="label", maxIter=max_iter,
                            regParam=1.0 / max(n_train, 1), elasticNetParam=0.0, standardization=False)
    names = [] if classes is None else [IndexToString(inputCol="prediction", outputCol="predicted_label",
                                                      labels=[str(v) for v in classes])]
    # "keep": scoring returns every row; rows with a missing feature get a null score in predict
    pipe = Pipeline(stages=[VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep"), lr, *names])
    model = pipe.fit(tagged.where(F.col("_split") == "train"))
    model.feature_names = feats
    metrics = _evaluate(model.transform(tagged.where(F.col("_split") == "test")))
    return model, metrics


def predict(model: PipelineModel | ForestModel | None, df: DataFrame, feature_names: list[str] | None = None) -> DataFrame:
    """score rows; the trained feature list is checked by name first.

    One row per input row. Adds ``prediction`` and ``risk`` (probability of class 1), and
    ``predicted_label`` if the classes are not 0 and 1; all are null where a feature is missing.
    """
    if model is None:
        raise RuntimeError("there is no model: train or load one first")
    feats = feature_names or getattr(model, "feature_names", None) or model.stages[0].getInputCols()
    if not feats:
        raise ValueError("the model has no feature to score by")
    missing_cols = [c for c in feats if c not in df.columns]
    if missing_cols:
        raise ValueError(f"the table lacks the model's columns {missing_cols}")
    cast = df.select(*[qcol(c) for c in df.columns if c not in feats],
                     *[qcol(c).cast("double").alias(c) for c in feats])
    good = _complete(feats)
    if isinstance(model, ForestModel):
        return model.scored(cast, good).select(*[qcol(c) for c in df.columns], "prediction", "risk")
    out = model.transform(cast)
    got = [F.when(good, F.col("prediction")).alias("prediction"),
           F.when(good, vector_to_array("probability")[1]).alias("risk")]
    if "predicted_label" in out.columns:
        got.append(F.when(good, F.col("predicted_label")).alias("predicted_label"))
    return out.select(*[qcol(c) for c in df.columns], *got)


def train_forest(df: DataFrame, target: str = "target", features: list[str] | None = None, num_trees: int = 100,
                 max_depth: int = 30, seed: int = 42) -> ForestModel | PipelineModel:
    """F8: random forest on all given features (100 trees, seed 42)."""
    feats = features or numeric_columns(df, exclude=[target])
    data = df.select(*[qcol(c).cast("double").alias(c) for c in feats],
                     qcol(target).cast("double").alias("label")).dropna()
    data = write_scratch(data, "forest-rows")  # read several times
    return fit_forest(data, feats, num_trees, max_depth, seed) or _mllib_forest(data, feats, num_trees, max_depth, seed)


def _mllib_forest(data: DataFrame, feats: list[str], num_trees: int, max_depth: int, seed: int) -> PipelineModel:
    # deep trees: cache node ids (checkpointed to the shared folder every 10 levels) and give each
    # level pass more memory, so fewer passes over the data -- same trees, about 4x faster
    rf = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=num_trees, maxDepth=max_depth,
                                featureSubsetStrategy="sqrt", seed=seed, cacheNodeIds=True, checkpointInterval=10,
                                maxMemoryInMB=1024)
    model = Pipeline(stages=[VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep"), rf]).fit(data)
    model.feature_names = feats
    return model


def save_model(model: PipelineModel | ForestModel, path: str) -> str:
    """Write a fitted pipeline or forest (overwrites)."""
    if isinstance(model, ForestModel):
        return model.save(path)
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel | ForestModel | None:
    """Read a pipeline or forest; None when nothing is there. Other faults are raised."""
    if (forest := ForestModel.load(SparkSession.builder.getOrCreate(), path)) is not None:
        return forest
    try:
        model = PipelineModel.load(path)
    except Exception as e:  # noqa: BLE001 - only an absent path means "no model"
        if not path_not_found(e):
            raise
        return None
    model.feature_names = model.stages[0].getInputCols()
    return model
