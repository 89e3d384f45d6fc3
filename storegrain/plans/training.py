"""Model families (boosted trees, linear models, networks), training, evaluation and batch scoring."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import (
    LogisticRegression, LogisticRegressionModel, MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from storegrain import schemas
from storegrain.functions.columns import clip
from storegrain.operators import metrics as quality
from storegrain.operators import requests, splits
from storegrain.plans import boosting, network, stages
from storegrain.session import stage

# Task name and whether it is a classification.
TASKS = [(t, t.startswith("survival")) for t in schemas.TARGETS]

# Hyperparameters.
BOOSTED_TREES = {"maxIter": 300, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.8,
                 "columnRate": 0.8, "minChildWeight": 3.0, "seed": 42}
HIDDEN_LAYERS = [256, 128, 64]
PATIENCE = 20
#: A network is trained in legs of a few iterations; between them the validation part is looked at.
NETWORK_ITERATIONS, LEG_ITERATIONS = 120, 4
PARALLEL_TASKS = 3

# Model classes per family: regression, classification.
MODEL_CLASSES = {
    "linear": (LinearRegressionModel, LogisticRegressionModel),
    "network": (LinearRegressionModel, MultilayerPerceptronClassificationModel),
}


def _estimator(family: str, task: str, classify: bool, width: int, options: dict):
    columns = {"featuresCol": "features", "labelCol": task}
    if family == "linear":
        return LogisticRegression(**columns, **options) if classify else LinearRegression(**columns, **options)
    if family == "network":
        if classify:
            layers = [width, *options.get("layers", HIDDEN_LAYERS), 2]
            return MultilayerPerceptronClassifier(
                **columns, layers=layers, maxIter=options.get("maxIter", NETWORK_ITERATIONS), seed=42)
        return LinearRegression(**columns)
    raise ValueError(f"unknown model family {family}")


def log_loss(scored: DataFrame, task: str) -> float | None:
    """Mean log loss of the ``probability`` of a 0/1 target; None without rows."""
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), vector_to_array("probability")[1]))
    return scored.agg(F.avg(-F.when(F.col(task) > 0.5, F.log(p)).otherwise(F.log1p(-p)))).first()[0]


def fit_in_legs(estimator: MultilayerPerceptronClassifier, data: DataFrame, valid: DataFrame | None, task: str,
                leg: int = LEG_ITERATIONS, patience: int = PATIENCE):
    """Train a network leg by leg, each going on where the one before stopped; stop after ``patience`` legs without a smaller loss on ``valid``.

    Returns the model of the best leg and the legs: task, leg, iterations so far, loss on the validation part, whether it is the best so far.
    Without validation rows all legs are one.
    """
    limit, legs, best, kept = estimator.getMaxIter(), [], None, None
    net, held = network.Network(estimator, data), None
    try:
        if valid is None or valid.isEmpty():
            net.advance(limit)
            return net.model(net.weights), legs
        loss, held = None, network.packed(valid, task)
        while (done := len(legs) * leg) < limit:
            ended = net.ended
            net.advance(min(leg, limit - done))
            loss = loss if ended else net.loss(held)  # a training that has ended keeps its weights
            better = best is None or loss < best
            legs.append((task, len(legs) + 1, min(limit, done + leg), loss, better))
            if better:
                best, kept = loss, net.weights
            elif len(legs) - max(i for _, i, _, _, good in legs if good) >= patience:
                break
        return net.model(kept), legs
    finally:
        net.release()
        if held is not None:
            held.unpersist()


def clip_heads(df: DataFrame, prefix: str = "p_") -> DataFrame:
    """Risk within 0..1, break-even at least 1."""
    risk, months = f"{prefix}risk_score", f"{prefix}break_even_months"
    return df.withColumns({risk: clip(F.col(risk), 0.0, 1.0), months: clip(F.col(months), 1.0)})


@dataclass
class TaskModels:
    """One fitted model per target."""

    family: str
    columns: list[str]
    models: dict = field(default_factory=dict)
    #: Of networks: task, leg, iterations, validation loss, best so far.
    legs: list[tuple] = field(default_factory=list)

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``p_<target>`` for every head; risk within 0..1, break-even at least 1."""
        # Targets are set aside: a model must not see or overwrite them.
        out = VectorAssembler(inputCols=self.columns, outputCol="features", handleInvalid="error").transform(df)
        for task, classify in TASKS:
            model = self.models[task].copy()
            if classify:
                model = model.setPredictionCol("_guess").setProbabilityCol("_probability").setRawPredictionCol("_raw")
                out = model.transform(out).withColumn(f"p_{task}", vector_to_array("_probability")[1])
                out = out.drop("_guess", "_probability", "_raw")
            else:
                out = model.setPredictionCol(f"p_{task}").transform(out)
        return clip_heads(out).drop("features")

    def save(self, spark: SparkSession, path: str) -> None:
        for task, model in self.models.items():
            model.write().overwrite().save(f"{path}/{task}")
        _save_info(spark, path, self.family, self.columns)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TaskModels | TreeModels":
        rows = spark.read.parquet(f"{path}/info").orderBy("position").collect()  # one row per feature
        columns = [r.feature for r in rows]
        if rows[0].family == "trees":
            return TreeModels(columns, boosting.BoostedModel.load(spark, f"{path}/trees"))
        kinds = MODEL_CLASSES[rows[0].family]
        return TaskModels(rows[0].family, columns, {task: kinds[classify].load(f"{path}/{task}") for task, classify in TASKS})

    def legs_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.legs, "task string, leg int, iterations int, valid_loss double, is_best boolean")

    def info(self) -> dict:
        return {"name": self.family, "tasks": ",".join(self.models), "n_features": len(self.columns)}


@dataclass
class TreeModels:
    """Boosted trees of all targets."""

    columns: list[str]
    model: boosting.BoostedModel
    family: str = "trees"

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``p_<target>`` for every head; risk within 0..1, break-even at least 1."""
        return clip_heads(self.model.predict(df))

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.save(spark, f"{path}/trees")
        _save_info(spark, path, self.family, self.columns)

    def importance(self, spark: SparkSession, k: int = 10) -> DataFrame:
        """The ``k`` most important features per target, by the mean gain of their splits; shares sum to 1 over all features."""
        table = spark.createDataFrame(self.model.importance(), "task string, feature string, importance double")
        window = Window.partitionBy("task").orderBy(F.desc("importance"), "feature")
        return table.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)

    def info(self) -> dict:
        return {"name": self.family, "tasks": ",".join(t for t, _ in self.model.heads), "n_features": len(self.columns)}


def _save_info(spark: SparkSession, path: str, family: str, columns: list[str]) -> None:
    spark.createDataFrame([(family, i, c) for i, c in enumerate(columns)], "family string, position int, feature string").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/info")


def train(df: DataFrame, columns: list[str], family: str = "trees", parallel: int = PARALLEL_TASKS, valid: DataFrame | None = None, **options) -> TaskModels | TreeModels:
    """Fit the six heads on a feature table; heads are fitted side by side.

    Classification labels are whether the target exceeds one half. Null inputs are an error for linear models and networks; trees
    count them as smallest. ``valid`` are rows by which networks stop early (``leg``, ``patience``).
    """
    def with_labels(rows):
        return rows.withColumns({t: (F.col(t) > 0.5).cast("double") if c else F.col(t).cast("double") for t, c in TASKS})

    labelled = with_labels(df)
    if family == "trees":
        settings = boosting.Settings(**{**BOOSTED_TREES, **options})
        return TreeModels(columns, boosting.fit(labelled.select(*columns, *schemas.TARGETS), columns, TASKS, settings))
    assembler = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="error")
    data = stage(assembler.transform(labelled).select("features", *schemas.TARGETS), "training")
    held = None if valid is None or family != "network" else stage(assembler.transform(with_labels(valid)).select("features", *schemas.TARGETS), "validation")
    pace = {k: options[k] for k in ("leg", "patience") if k in options}
    options = {k: v for k, v in options.items() if k not in pace}

    def fit(task):
        name, classify = task
        estimator = _estimator(family, name, classify, len(columns), options)
        return name, *(fit_in_legs(estimator, data, held, name, **pace) if classify and family == "network" else (estimator.fit(data), []))

    with ThreadPoolExecutor(parallel) as pool:
        found = list(pool.map(fit, TASKS))
    return TaskModels(family, columns, {name: model for name, model, _ in found}, [x for _, _, legs in found for x in legs])


def ensemble(df: DataFrame, members: list[TaskModels | TreeModels], weights: list[float] | None = None) -> DataFrame:
    """Weighted mean of the members' heads, all on the same rows; equal weights by default."""
    weights = weights or [1.0 / len(members)] * len(members)
    heads = [f"p_{t}" for t, _ in TASKS]
    out = df
    for i, member in enumerate(members):
        out = member.predict(out).withColumnsRenamed({h: f"_m{i}_{h}" for h in heads})
    return weighted_mean(out, {h: [f"_m{i}_{h}" for i in range(len(members))] for h in heads}, weights)


def weighted_mean(df: DataFrame, sources: dict[str, list[str]], weights: list[float]) -> DataFrame:
    """New columns as weighted sums of others, which are dropped."""
    columns = {
        name: reduce(lambda a, b: a + b, [F.col(c) * F.lit(w) for c, w in zip(parts, weights)])
        for name, parts in sources.items()
    }
    return df.withColumns(columns).drop(*[c for parts in sources.values() for c in parts])


def score(df: DataFrame, state: stages.FeatureState, models: TaskModels | TreeModels, key: str, digits: int | None = 4) -> DataFrame:
    """Model rows to final predictions, one row out per row in; inputs stay beside the scores. The risk level is that of the score before rounding."""
    inputs = [c for c in df.columns if c not in schemas.TARGETS]
    carried = df.select("*", F.struct(*inputs).alias("_inputs"))
    scored = models.predict(stages.transform_features(carried, state, [key, "_inputs"]))
    heads = {f"p_{t}": t for t, _ in TASKS}
    out = scored.select("_inputs.*", *[F.col(p).alias(t) for p, t in heads.items()])
    return requests.postprocess(out, digits)


def evaluate_model(scored: DataFrame, name: str) -> DataFrame:
    return quality.evaluate(scored, name)


@dataclass
class TrainingResult:
    run_id: str
    models: TaskModels | TreeModels
    state: stages.FeatureState
    metrics: DataFrame
    events: DataFrame
    sizes: DataFrame


def train_run(stores: DataFrame, root: str, key: str = "biz_id", family: str = "trees", fit_on: str = "train",
              reuse: DataFrame | None = None, **options) -> TrainingResult:
    """Load, clean, label, build features, split, train, evaluate, save; every step is logged.

    ``reuse`` hands over labelled rows instead of building them. ``fit_on='all'`` learns
    encoders and scaling from all rows, ``'train'`` from the training part only.
    """
    spark = stores.sparkSession
    run_id = str(uuid.uuid4())
    labelled = reuse if reuse is not None else stages.label_stage(stages.clean_stage(stores), key)
    labelled = stage(splits.assign_split(labelled, key), "labelled")
    source = labelled.filter("split = 'train'") if fit_on == "train" else labelled
    state = stages.fit_features(labelled, fit_on=source)
    matrix = stages.transform_features(labelled, state, [key, "split"])
    path = f"{root}/features/{run_id}"
    matrix.write.partitionBy("split").parquet(path)
    stored = spark.read.parquet(path)
    sizes = splits.split_counts(stored)

    log = RunLog(spark, f"{root}/training_runs")
    counts = {r.split: r.n for r in sizes.collect()}  # three rows
    log.write(run_id, "started", model_type=family, train_size=counts.get("train", 0), val_size=counts.get("val", 0),
              test_size=counts.get("test", 0), n_features=len(state.columns))
    log.write(run_id, "training", model_type=family)
    try:
        models = train(stored.filter("split = 'train'"), state.columns, family, valid=stored.filter("split = 'val'"), **options)
        for task, number, iterations, loss, _ in getattr(models, "legs", []):
            log.write(run_id, "training", model_type=family, metrics={f"{task}_leg": float(number), f"{task}_iterations": float(iterations), f"{task}_valid_loss": loss})
        log.write(run_id, "evaluating", model_type=family)
        metrics = stage(evaluate_model(models.predict(stored.filter("split = 'test'")), family), "metrics")
        models.save(spark, f"{root}/models/{run_id}")
        state.save(f"{root}/state/{run_id}")
        numbers = {r.metric: r.value for r in metrics.collect() if r.value is not None}  # one row per metric
        log.write(run_id, "completed", model_type=family, metrics=numbers, model_path=f"{root}/models/{run_id}",
                  artifacts_path=f"{root}/state/{run_id}")
    except Exception as error:
        log.write(run_id, "failed", model_type=family, error_message=str(error))
        raise
    return TrainingResult(run_id, models, state, metrics, log.events(), sizes)


class RunLog:
    """Append-only training events."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, run_id: str, status: str, **values) -> None:
        known = {"run_id": run_id, "status": status, **values}
        row = self.spark.range(1).select(*[
            (F.current_timestamp() if f.name == "event_ts" else _literal(known.get(f.name), f.dataType)).alias(f.name)
            for f in schemas.RUN_EVENTS.fields])
        row.write.mode("append").parquet(self.path)

    def events(self) -> DataFrame:
        return self.spark.read.schema(schemas.RUN_EVENTS).parquet(self.path)


def _literal(value, kind):
    if isinstance(value, dict):
        return F.create_map(*[F.lit(x) for kv in value.items() for x in kv]) if value else F.lit(None).cast(kind)
    return F.lit(value).cast(kind)
