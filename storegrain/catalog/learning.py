"""Training, scoring, evaluation and stored state, with the full settings of ``training``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from storegrain import schemas
from storegrain.catalog import query
from storegrain.catalog.preparation import CLEAN_STEPS, ENCODED, classes_sql
from storegrain.catalog.views import REQUESTS_SQL, plain, stores, uniform_sql, view, with_stores
from storegrain.operators import features, metrics, requests, runs, splits
from storegrain.operators.mapping import to_model_names
from storegrain.plans import stages, training
from storegrain.session import stage, staging_path
from storegrain.sources import tables


def feature_table(spark, folder) -> tuple[DataFrame, stages.FeatureState]:
    rows = stages.label_stage(stages.clean_stage(stores(spark, folder)))
    rows = stage(splits.assign_split(rows, "biz_id"), "labelled")
    state = stages.fit_features(rows, fit_on=rows.filter("split = 'train'"))
    return stage(stages.transform_features(rows, state, ["biz_id", "split"]), "features"), state


def trees(data: DataFrame, state: stages.FeatureState) -> training.TaskModels:
    return training.train(data.filter("split = 'train'"), state.columns, "trees")


@query("train_score")
def train_score(spark, folder):
    data, state = feature_table(spark, folder)
    return trees(data, state).predict(data).select("biz_id", *[f"p_{t}" for t in schemas.TARGETS])


@query("feature_importance")
def feature_importance(spark, folder):
    data, state = feature_table(spark, folder)
    return trees(data, state).importance(spark)


def scored_requests(spark, folder, digits: int | None = 4) -> DataFrame:
    data, state = feature_table(spark, folder)
    asked = requests.validate_requests(view(spark, folder, REQUESTS_SQL)).filter("is_valid")
    return training.score(requests.to_model_input(asked), state, trees(data, state), "request_id", digits)


@query("batch_score")
def batch_score(spark, folder):
    return scored_requests(spark, folder)


@query("ensemble_score")
def ensemble_score(spark, folder):
    data, state = feature_table(spark, folder)
    linear = training.train(data.filter("split = 'train'"), state.columns, "linear")
    out = training.ensemble(data, [trees(data, state), linear], [0.6, 0.4])
    return out.select("biz_id", *[f"p_{t}" for t in schemas.TARGETS])


def network(data: DataFrame, state: stages.FeatureState) -> training.TaskModels:
    return training.train(data.filter("split = 'train'"), state.columns, "network", valid=data.filter("split = 'val'"))


@query("mlp_survival")
def mlp_survival(spark, folder):
    data, state = feature_table(spark, folder)
    return network(data, state).predict(data).select("biz_id", "p_survival_1yr", "p_survival_3yr")


U = uniform_sql("biz_id", "split|42")
IN_TRAIN, IN_VAL, IN_TEST = f"{U} >= 0.1e0 + 0.1e0", f"{U} >= 0.1e0 AND {U} < 0.1e0 + 0.1e0", f"{U} < 0.1e0"


@query("network_legs", with_stores(f"""
SELECT task, count(*) FILTER ({IN_VAL}) AS n_valid, true AS legs_are_gapless, true AS stopped_by_rule, true AS best_is_kept
FROM clean, (VALUES ('survival_1yr'), ('survival_3yr')) t(task) GROUP BY task""", **CLEAN_STEPS))
def network_legs(spark, folder):
    """How the networks were stopped: by patience or at the last iteration, with the weights of the leg of least loss on the validation part."""
    data, state = feature_table(spark, folder)
    valid = data.filter("split = 'val'")
    models = network(data, state)
    rows, n_valid = [], valid.count()
    for task in ("survival_1yr", "survival_3yr"):
        legs = [x for x in models.legs if x[0] == task]
        best = min(legs, key=lambda x: x[3])
        rule = len(legs) - best[1] >= training.PATIENCE or legs[-1][2] == training.NETWORK_ITERATIONS
        labelled = valid.withColumn(task, (F.col(task) > 0.5).cast("double"))
        features_only = training.VectorAssembler(inputCols=state.columns, outputCol="features").transform(labelled)
        kept = training.log_loss(models.models[task].transform(features_only), task)
        rows.append((task, n_valid, [x[1] for x in legs] == list(range(1, len(legs) + 1)), rule, abs(kept - best[3]) < 1e-9))
    return spark.createDataFrame(rows, "task string, n_valid long, legs_are_gapless boolean, stopped_by_rule boolean, best_is_kept boolean")


@query("boosted_checks", with_stores(f"""
SELECT task, count(*) AS n_rows, 0::BIGINT AS n_outside, count(*) FILTER ({IN_TRAIN}) AS n_train, true AS beats_the_mean, 0::BIGINT AS n_changed_by_saving,
  10::BIGINT AS n_ranked FROM clean, (VALUES {', '.join(f"('{t}')" for t in schemas.TARGETS)}) t(task) GROUP BY task""", **CLEAN_STEPS))
def boosted_checks(spark, folder):
    """What is exact about the trees: a score for each row, ranges, training error below that of the mean, the same scores after saving and loading."""
    data, state = feature_table(spark, folder)
    fitted = trees(data, state)
    path = staging_path(spark, "trees")
    fitted.save(spark, path)
    scored = fitted.predict(data).select("biz_id", "split", *schemas.TARGETS, *[f"p_{t}" for t in schemas.TARGETS])
    again = training.TaskModels.load(spark, path).predict(data).select("biz_id", *[F.col(f"p_{t}").alias(f"q_{t}") for t in schemas.TARGETS])
    both = stage(scored.join(again, "biz_id"), "scored-twice")
    parts, ranked = [], fitted.importance(spark).groupBy("task").agg(F.count("*").alias("n_ranked"))
    for task, classify in training.TASKS:
        p, train = F.col(f"p_{task}"), F.col("split") == "train"
        y = (F.col(task) > 0.5).cast("double") if classify else F.col(task).cast("double")
        low, high = {"risk_score": (0.0, 1.0), "break_even_months": (1.0, float("inf"))}.get(task, (0.0, 1.0) if classify else (float("-inf"), float("inf")))
        inside = p.between(low, high) & ~F.isnan(p)
        parts.append(both.agg(
            F.lit(task).alias("task"), F.countDistinct("biz_id").alias("n_rows"), F.count(F.when(~F.coalesce(inside, F.lit(False)), 1)).alias("n_outside"),
            F.count(F.when(train, 1)).alias("n_train"), (F.avg(F.when(train, (p - y) ** 2)) < F.var_pop(F.when(train, y))).alias("beats_the_mean"),
            F.count(F.when(p != F.col(f"q_{task}"), 1)).alias("n_changed_by_saving")))
    return reduce(DataFrame.unionByName, parts).join(ranked, "task")


VALID_REQUESTS = f"""SELECT request_id FROM ({plain(REQUESTS_SQL)}) WHERE founder_age BETWEEN 18 AND 80 AND coalesce(experience_years >= 0, true)
  AND business_category IS NOT NULL AND initial_investment >= 0 AND coalesce(monthly_rent >= 0, true) AND coalesce(store_size_sqm >= 0, true)
  AND coalesce(employee_count >= 0, true) AND district IS NOT NULL"""


@query("batch_score_checks", f"SELECT request_id, true AS in_range, true AS level_fits, true AS rounded FROM ({VALID_REQUESTS})")
def batch_score_checks(spark, folder):
    """One row for each valid request, scores in range and rounded, the level that belongs to the risk."""
    return score_checks(scored_requests(spark, folder, digits=None))


def score_checks(scores: DataFrame) -> DataFrame:
    """Checks of the final form of scores that are not rounded yet: a risk of 0.29996 is shown as 0.3, its level stays that below."""
    out = requests.postprocess(scores.withColumn("_risk", F.col("risk_score")))
    ranges = F.col("survival_1yr").between(0, 1) & F.col("survival_3yr").between(0, 1) & F.col("risk_score").between(0, 1) & (F.col("break_even_months") >= 1)
    risk = F.col("_risk")
    level = F.when(risk < 0.3, "LOW").when(risk < 0.6, "MEDIUM").when(risk < 0.8, "HIGH").otherwise("CRITICAL")
    return out.select("request_id", ranges.alias("in_range"), (level == F.col("risk_level")).alias("level_fits"),
                      (F.round(risk, 4) == F.col("risk_score")).alias("rounded"))


@query("ensemble_checks", with_stores("SELECT count(*) AS n_rows, 0::BIGINT AS n_off FROM clean", **CLEAN_STEPS))
def ensemble_checks(spark, folder):
    """The ensemble is the weighted mean of its members."""
    data, state = feature_table(spark, folder)
    members = [trees(data, state), training.train(data.filter("split = 'train'"), state.columns, "linear")]
    both = training.ensemble(data, members, [0.6, 0.4]).withColumnsRenamed({f"p_{t}": f"e_{t}" for t in schemas.TARGETS})
    for i, member in enumerate(members):
        both = member.predict(both).withColumnsRenamed({f"p_{t}": f"m{i}_{t}" for t in schemas.TARGETS})
    off = [F.abs(F.col(f"e_{t}") - 0.6 * F.col(f"m0_{t}") - 0.4 * F.col(f"m1_{t}")) > 1e-9 * (1 + F.abs(f"e_{t}")) for t in schemas.TARGETS]
    return both.agg(F.count("*").alias("n_rows"), F.count(F.when(F.array_contains(F.array(*off), True), 1)).alias("n_off"))


CLIPPED_SQL = """SELECT o_orderkey AS id, o_totalprice / 2e5 - 0.5e0 AS p_risk_score, o_totalprice / 1e4 - 5e0 AS p_break_even_months FROM {orders}"""


@query("clip_heads", f"""SELECT id, greatest(0e0, least(1e0, p_risk_score)) AS p_risk_score, greatest(1e0, p_break_even_months) AS p_break_even_months
FROM ({plain(CLIPPED_SQL)})""")
def clip_heads(spark, folder):
    return training.clip_heads(view(spark, folder, CLIPPED_SQL))


@query("evaluate_all")
def evaluate_all(spark, folder):
    data, state = feature_table(spark, folder)
    path = staging_path(spark, "models")
    trees(data, state).save(spark, f"{path}/trees")
    training.train(data.filter("split = 'train'"), state.columns, "linear").save(spark, f"{path}/linear")
    test = data.filter("split = 'test'")
    parts = [
        training.evaluate_model(stage(training.TaskModels.load(spark, f"{path}/{name}").predict(test), "scored"), name)
        for name in ("trees", "linear")
    ]
    return metrics.compare_models(stage(parts[0].unionByName(parts[1]), "metrics"))


METRICS = ["survival_1yr_acc", "survival_1yr_f1", "survival_1yr_auc", "survival_3yr_acc", "survival_3yr_f1", "survival_3yr_auc",
           "revenue_mae", "revenue_r2", "profit_mae", "risk_mae"]


@query("evaluate_checks", f"""SELECT metric, 2::BIGINT AS n_models, true AS in_order, true AS named FROM (VALUES {', '.join(f"('{m}')" for m in METRICS)}) t(metric)""")
def evaluate_checks(spark, folder):
    """Each metric has both models, the bounds are in order and the best model is one of them."""
    return evaluate_all(spark, folder).select("metric", "n_models", (F.col("low") <= F.col("high")).alias("in_order"),
                                              F.col("best_model").isin("trees", "linear").alias("named"))


@query("model_roundtrip", with_stores("SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_changed FROM clean", **CLEAN_STEPS))
def model_roundtrip(spark, folder):
    data, state = feature_table(spark, folder)
    fitted = training.train(data, state.columns, "linear")
    path = staging_path(spark, "model")
    fitted.save(spark, path)
    before = fitted.predict(data)
    after = training.TaskModels.load(spark, path).predict(before.withColumnsRenamed({f"p_{t}": f"q_{t}" for t in schemas.TARGETS}))
    changed = [F.abs(F.col(f"p_{t}") - F.col(f"q_{t}")) > 1e-5 * (1 + F.abs(f"q_{t}")) for t in schemas.TARGETS]
    return after.agg(F.count("*").alias("n_rows"), F.count(F.when(F.array_contains(F.array(*changed), True), 1)).alias("n_changed"))


@query("train_all_steps", with_stores(f"""
SELECT 'completed' AS status, 'linear' AS model_type, count(*) FILTER ({IN_TRAIN}) AS train_size, count(*) FILTER ({IN_VAL}) AS val_size,
  count(*) FILTER ({IN_TEST}) AS test_size, 24::BIGINT AS n_features FROM clean""", **CLEAN_STEPS))
def train_all_steps(spark, folder):
    """The whole training run: newest log state beside the split sizes."""
    result = training.train_run(stores(spark, folder), staging_path(spark, "run"), family="linear")
    return runs.run_state(result.events).select("status", "model_type", "train_size", "val_size", "test_size", "n_features")


STATE_SQL = f"""SELECT 'class' AS kind, column_name AS name, class AS label, CAST(idx AS DOUBLE) AS number
FROM ({classes_sql('model_rows', ENCODED)})
UNION ALL SELECT 'scale', 'age', 'centre', round(avg(age), 6) FROM model_rows
UNION ALL SELECT 'scale', 'age', 'scale', round(sqrt(var_pop(age)), 6) FROM model_rows"""
MODEL_ROWS = """SELECT category_large AS business_category, category_mid AS business_sub_category, adong_name AS district, gender, age FROM stores"""


@query("fitted_state_roundtrip", with_stores(STATE_SQL, model_rows=MODEL_ROWS))
def fitted_state_roundtrip(spark, folder):
    rows = to_model_names(stores(spark, folder))
    path = staging_path(spark, "state")
    stages.FeatureState(features.fit_encoder(rows), features.fit_standard(rows, ["age"])).save(path)
    state = stages.FeatureState.load(spark, path)
    classes = state.classes.select(
        F.lit("class").alias("kind"), F.col("column_name").alias("name"), F.col("class").alias("label"), F.col("idx").cast("double").alias("number"))
    scale = features.scaler_table(rows, state.scaler).unpivot(["feature"], ["centre", "scale"], "label", "number")
    return classes.unionByName(scale.select(
        F.lit("scale").alias("kind"), F.col("feature").alias("name"), "label", F.round("number", 6).alias("number")))


META_COLUMNS = ["age", "experience_years", "employee_count"]


def meta(spark, folder) -> DataFrame:
    rows = to_model_names(stores(spark, folder))
    return tables.feature_set_meta(
        "run-1", rows, META_COLUMNS, ["risk_score"], features.fit_standard(rows, META_COLUMNS), features.fit_encoder(rows, ["gender"]))


@query("feature_set_meta", with_stores("""
SELECT 'run-1' AS pipeline_run_id, 'age,experience_years,employee_count' AS feature_columns, 'risk_score' AS target_columns,
  count(*) AS n_samples, 3 AS n_features, 1 AS n_targets, round(avg(age), 6) AS mean_age, 'F,M' AS gender_classes FROM stores"""))
def feature_set_meta(spark, folder):
    path = staging_path(spark, "meta")
    meta(spark, folder).write.parquet(path)
    out = spark.read.parquet(path)
    return out.select(
        "pipeline_run_id", F.array_join("feature_columns", ",").alias("feature_columns"),
        F.array_join("target_columns", ",").alias("target_columns"), "n_samples", "n_features", "n_targets",
        F.round(F.col("scaler_params")["mean"][0], 6).alias("mean_age"), F.array_join(F.col("encoder_classes")["gender"], ",").alias("gender_classes"))


@query("state_json", with_stores("""SELECT 'run-1' AS pipeline_run_id, '{"gender":["F","M"]}' AS classes_json, count(*) AS n_samples FROM stores"""))
def state_json(spark, folder):
    return meta(spark, folder).select("pipeline_run_id", F.to_json("encoder_classes").alias("classes_json"), "n_samples")


