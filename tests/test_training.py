from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from storegrain import schemas
from storegrain.catalog import learning, load_all
from storegrain.operators import labels, requests, runs
from storegrain.plans import network, stages, training

HEADS = [f"p_{t}" for t in schemas.TARGETS]
REGISTRY = load_all()


@pytest.fixture(scope="module")
def prepared(spark):
    people = requests.synthetic_applicants(spark.range(400).select(F.col("id").cast("string").alias("biz_id")), "biz_id")
    labelled = labels.label_all(people)
    state = stages.fit_features(labelled)
    return people, state, stages.transform_features(labelled, state, ["biz_id"]).cache()


def in_range(df):
    return df.filter("p_survival_1yr < 0 or p_survival_1yr > 1 or p_survival_3yr < 0 or p_survival_3yr > 1 "
                     "or p_risk_score < 0 or p_risk_score > 1 or p_break_even_months < 1").isEmpty()


def test_trees_learn_the_risk_rule(spark, prepared):
    people, state, data = prepared
    models = training.train(data, state.columns, "trees", maxIter=4, maxDepth=4)
    out = models.predict(data)
    assert out.count() == 400 and in_range(out) and set(HEADS) <= set(out.columns)
    error = out.agg(F.avg(F.abs(F.col("p_risk_score") - F.col("risk_score"))), F.stddev("risk_score")).first()
    assert error[0] < error[1]
    top = models.importance(spark)
    assert top.groupBy("task").count().filter("count > 10").isEmpty() and top.select("task").distinct().count() == 6
    scored = training.score(people, state, models, "biz_id")
    assert scored.count() == 400 and {"risk_level", "recommendations", "age"} <= set(scored.columns)


@pytest.mark.parametrize("family, options", [("linear", {"maxIter": 5}), ("network", {"layers": [8], "maxIter": 10})])
def test_save_and_load_predict_alike(spark, prepared, tmp_path, family, options):
    _, state, data = prepared
    models = training.train(data, state.columns, family, **options)
    models.save(spark, str(tmp_path))
    again = training.TaskModels.load(spark, str(tmp_path))
    a = {r.biz_id: [r[h] for h in HEADS] for r in models.predict(data).collect()}
    b = {r.biz_id: [r[h] for h in HEADS] for r in again.predict(data).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-5) for k in a)
    assert in_range(models.predict(data))


def test_ensemble_is_the_weighted_mean(spark, prepared):
    _, state, data = prepared
    models = training.train(data, state.columns, "linear", maxIter=5)
    alone = {r.biz_id: r.p_risk_score for r in models.predict(data).collect()}
    both = {r.biz_id: r.p_risk_score for r in training.ensemble(data, [models, models]).collect()}
    assert both == pytest.approx(alone)
    weighted = training.ensemble(data, [models, models], [0.6, 0.4])
    assert {r.biz_id: r.p_risk_score for r in weighted.collect()} == pytest.approx(alone)


def test_whole_run_and_its_log(spark, folder, tmp_path):
    from storegrain.catalog.views import stores

    result = training.train_run(stores(spark, folder), str(tmp_path), family="linear", maxIter=5)
    state = runs.run_state(result.events).first()
    assert state.status == "completed" and state.n_features == 24 and state.completed_at is not None
    assert state.train_size + state.val_size + state.test_size == sum(r.n for r in result.sizes.collect())
    assert {"survival_1yr_auc", "revenue_r2", "risk_mae"} <= set(state.metrics)
    newest = runs.latest_completed(runs.run_state(result.events)).first()
    models = training.TaskModels.load(spark, newest.model_path)
    fitted = stages.FeatureState.load(spark, newest.artifacts_path)
    people = requests.applicants(spark, 20)
    assert training.score(people, fitted, models, "id").count() == 20


def test_failures_are_logged(spark, folder, tmp_path):
    from storegrain.catalog.views import stores

    labelled = labels.label_all(requests.synthetic_applicants(spark.range(50).select(F.col("id").cast("string").alias("biz_id")), "biz_id"))
    with pytest.raises(ValueError):
        training.train_run(stores(spark, folder), str(tmp_path), family="nonsense", reuse=labelled)
    events = training.RunLog(spark, f"{tmp_path}/training_runs").events()
    state = runs.run_state(events).first()
    assert state.status == "failed" and "nonsense" in state.error_message


def test_networks_stop_by_the_validation_part(spark, prepared):
    _, state, data = prepared
    parts = data.withColumn("part", F.pmod(F.xxhash64("biz_id"), F.lit(4)))
    train, valid = parts.filter("part > 0").drop("part"), parts.filter("part = 0").drop("part")
    models = training.train(train, state.columns, "network", valid=valid, layers=[6], maxIter=60, leg=3, patience=2)
    table = models.legs_table(spark).collect()
    for task in ("survival_1yr", "survival_3yr"):
        legs = [r for r in table if r.task == task]
        assert [r.leg for r in legs] == list(range(1, len(legs) + 1)) and legs[-1].iterations == min(60, 3 * len(legs))
        best = min(legs, key=lambda r: r.valid_loss)
        assert best.is_best and (len(legs) - best.leg == 2 or legs[-1].iterations == 60)
        seen = training.VectorAssembler(inputCols=state.columns, outputCol="features").transform(valid)
        assert training.log_loss(models.models[task].transform(seen), task) == pytest.approx(best.valid_loss)
    assert in_range(models.predict(data))
    again = training.train(train, state.columns, "network", valid=valid.limit(0), layers=[6], maxIter=5)
    assert again.legs == [] and in_range(again.predict(data))


def test_legs_of_a_network_go_on_where_the_last_one_stopped(prepared):
    _, state, data = prepared
    rows = training.VectorAssembler(inputCols=state.columns, outputCol="features").transform(data)
    found = []
    for leg in (1, 6):
        estimator = training._estimator("network", "survival_1yr", True, len(state.columns), {"layers": [5], "maxIter": 6})
        model, legs = training.fit_in_legs(estimator, rows, rows, "survival_1yr", leg=leg)
        assert legs[-1][2] == 6 and training.log_loss(model.transform(rows), "survival_1yr") == pytest.approx(legs[-1][3])
        found.append(model.weights.toArray())
    assert found[0] == pytest.approx(found[1], rel=1e-6, abs=1e-9)
    first = estimator.copy().setMaxIter(0).fit(rows)
    assert legs[-1][3] < training.log_loss(first.transform(rows), "survival_1yr")


def test_gradient_of_a_network():
    rng, layers = np.random.default_rng(0), [5, 7, 4, 2]
    weights, x, y = rng.normal(size=84), rng.normal(size=(30, 5)), rng.integers(0, 2, 30)
    loss, gradient = network.block_loss(weights, layers, x, y, True)
    by_steps = [(network.block_loss(weights + e, layers, x, y, True)[0] - network.block_loss(weights - e, layers, x, y, True)[0]) / 2e-6 for e in np.eye(84) * 1e-6]
    assert gradient == pytest.approx(by_steps, abs=1e-6) and network.block_loss(weights, layers, x, y, False)[0] == pytest.approx(loss)


def test_registered_queries_train_with_the_full_settings(monkeypatch):
    from storegrain.catalog import learning

    asked = []
    monkeypatch.setattr(learning, "feature_table", lambda *_: (SimpleNamespace(filter=lambda _: None), SimpleNamespace(columns=["a"])))
    monkeypatch.setattr(learning.training, "train", lambda df, columns, family, **options: asked.append((family, options)) or stop())
    for name in ("train_score", "feature_importance", "mlp_survival"):
        with pytest.raises(InterruptedError):
            REGISTRY[name].run(None, None)
    assert asked == [("trees", {}), ("trees", {}), ("network", {"valid": None})]
    assert training.BOOSTED_TREES["maxIter"] == 300 and training.HIDDEN_LAYERS == [256, 128, 64]


def stop():
    raise InterruptedError


def test_level_belongs_to_the_score_before_rounding(spark):
    scores = spark.createDataFrame([("a", 0.5, 0.5, 0.29996, 3.0, 1.0, 1.0), ("b", 0.5, 0.5, 0.59999, 3.0, 1.0, 1.0), ("c", 0.5, 0.5, 0.2, 3.0, 1.0, 1.0)],
                                   "request_id string, survival_1yr double, survival_3yr double, risk_score double, break_even_months double, monthly_revenue double, monthly_profit double")
    assert [(r.risk_score, r.risk_level) for r in requests.postprocess(scores).orderBy("request_id").collect()] == [(0.3, "LOW"), (0.6, "MEDIUM"), (0.2, "LOW")]
    assert {tuple(r)[1:] for r in learning.score_checks(scores).collect()} == {(True, True, True)}


def test_rows_of_a_network_are_packed_once(prepared, monkeypatch):
    """Further gradients read the kept blocks, not the table; they are released at the end."""
    _, state, data = prepared
    rows = training.VectorAssembler(inputCols=state.columns, outputCol="features").transform(data)
    made, packed = [], network.packed
    monkeypatch.setattr(network, "packed", lambda *a: made.append(packed(*a)) or made[-1])
    estimator = training._estimator("network", "survival_1yr", True, len(state.columns), {"layers": [5], "maxIter": 6})
    training.fit_in_legs(estimator, rows, rows, "survival_1yr", leg=2)
    assert len(made) == 2 and not any(blocks.is_cached for blocks in made)


def test_many_rows_are_dealt_evenly_with_the_same_gradient(spark, prepared, monkeypatch):
    _, state, data = prepared
    rows = training.VectorAssembler(inputCols=state.columns, outputCol="features").transform(data).coalesce(1)
    layers, found = [len(state.columns), 5, 2], []
    weights = np.random.default_rng(1).normal(size=5 * len(state.columns) + 17)
    for many in (False, True):
        if many:
            monkeypatch.setattr(network, "BLOCK", 10)
            monkeypatch.setattr(network, "FINE", 5)
        blocks = network.packed(rows, "survival_1yr")
        sizes = [len(y) for part in blocks.glom().collect() for _, y in part]
        parts = [sum(len(y) for _, y in part) for part in blocks.glom().collect()]
        found.append(network.loss_over(blocks, "survival_1yr", layers, weights))
        blocks.unpersist()
        assert sum(sizes) == 400 and (not many or max(sizes) == 5 and max(parts) <= 2 * min(parts))
    assert found[0][0] == pytest.approx(found[1][0]) and found[0][1] == pytest.approx(found[1][1])


def test_blocks_of_a_network_share_their_arrays():
    rng, layers, room = np.random.default_rng(0), [5, 7, 4, 2], network.Room()
    weights = rng.normal(size=84)
    for n in (30, 12, 41):
        x, y = rng.normal(size=(n, 5)), rng.integers(0, 2, n)
        alone, shared = network.block_loss(weights, layers, x, y, True), network.block_loss(weights, layers, x, y, True, room)
        assert alone[0] == shared[0] and (alone[1] == shared[1]).all()
