"""Models and graph against direct computations on small data."""

from __future__ import annotations

import inspect
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ledgerlens.operators import graph
from ledgerlens.operators.models import boosting, boundary, density, ensemble, forest, reconstruction, screening
from ledgerlens.plans import catalog
from ledgerlens.schema import FEATURE_NAMES


def frame(spark, x, extra=None):
    names = [f"f{i}" for i in range(x.shape[1])]
    pdf = pd.DataFrame(x, columns=names).assign(loan_id=[f"L{i:05d}" for i in range(len(x))])
    return spark.createDataFrame(pdf if extra is None else pdf.assign(**extra)), names


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(800, 4))
    x[:12] += 9
    return x


def test_forest_ranks_planted_outliers_first(spark, planted):
    df, names = frame(spark, planted)
    model = forest.fit_forest(df, names, trees=50)
    scored = model.score(df).toPandas().sort_values("decision")
    assert set(scored["loan_id"].head(12)) == {f"L{i:05d}" for i in range(12)}
    assert 0.03 < (scored["prediction"] == -1).mean() < 0.07


def test_forest_is_repeatable_and_survives_saving(spark, planted, tmp_path):
    df, names = frame(spark, planted)
    first, second = (forest.fit_forest(part, names, trees=20) for part in (df, df.repartition(5)))
    pd.testing.assert_frame_equal(
        first.nodes.sort_values(["tree", "node"]).reset_index(drop=True),
        second.nodes.sort_values(["tree", "node"]).reset_index(drop=True),
    )
    first.save(spark, str(tmp_path / "forest"))
    again = forest.IsolationForest.load(spark, str(tmp_path / "forest"))
    a, b = (m.score(df).select("loan_id", "decision").toPandas().set_index("loan_id") for m in (first, again))
    pd.testing.assert_frame_equal(a, b)


def test_scores_follow_the_nodes_of_every_tree(spark, planted):
    """Rows on a threshold go left, as do rows without a value; a block of rows ends inside the table."""
    rng = np.random.default_rng(4)
    x = np.vstack([np.round(planted, 1)] * 6)
    df, names = frame(spark, x)
    model = forest.fit_forest(df, names, trees=7, sample=48)
    x[rng.random(x.shape) < 0.02] = np.nan
    x[5] = np.inf
    trees = [part.set_index("node") for _, part in model.nodes.groupby("tree")]
    cuts = model.nodes.dropna(subset=["threshold"])
    x[:200, 0] = rng.choice(cuts.loc[cuts["feature"] == 0, "threshold"].to_numpy(), 200)

    def depth(tree, row):
        at = 0
        while tree.at[at, "low"] != at:
            at = tree.at[at, "high" if row[tree.at[at, "feature"]] > tree.at[at, "threshold"] else "low"]
        return tree.at[at, "depth"]

    got = model.score(frame(spark, x)[0].coalesce(1)).toPandas().sort_values("loan_id")["decision"].to_numpy()
    some = np.r_[np.arange(210), np.arange(4000, 4200)]
    want = [-(2.0 ** (-sum(depth(t, x[i]) for t in trees) / len(trees) / forest.average_depth(48))) - model.offset for i in some]
    np.testing.assert_allclose(got[some], want, rtol=1e-12)


def test_screen_scores_a_table_once(spark, monkeypatch):
    """The cut of a new forest and the scores of its rows come from one walk through the trees."""
    rng = np.random.default_rng(10)
    pdf = pd.DataFrame(rng.normal(size=(300, len(FEATURE_NAMES))), columns=FEATURE_NAMES)
    features = spark.createDataFrame(pdf.assign(loan_id=[f"L{i:03d}" for i in range(300)], officer_id="O1"))
    walks, walk = [], forest.IsolationForest.raw_score
    monkeypatch.setattr(forest.IsolationForest, "raw_score", lambda self, spark: (walks.append(1), walk(self, spark))[1])
    screen, scored = screening.fit_and_screen(features, keep=screening.ALERT_COLUMNS)
    assert len(walks) == 1 and screen.training_samples == 300
    apart = screening.fit_screen(features)
    assert screen.forest.offset == apart.forest.offset
    sides = [screen.alerts(s, None).toPandas().sort_values("alert_id", ignore_index=True) for s in (scored, apart.score(features))]
    pd.testing.assert_frame_equal(*sides)
    assert len(sides[0])


def test_constant_decision_has_no_risk(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "loan_id string, decision double")
    assert {r["anomaly_risk"] for r in forest.risk_from_decision(df).collect()} == {0.0}


def test_roc_auc_counts_pairs(spark):
    rng = np.random.default_rng(3)
    label, score = rng.integers(0, 2, 400), rng.integers(0, 25, 400) / 4.0
    df = spark.createDataFrame([(int(y), float(x)) for y, x in zip(label, score)] + [(1, None), (None, 2.0)], "label int, score double")
    pos, neg = score[label == 1], score[label == 0]
    want = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))
    got = boosting.roc_auc(df).first()
    assert (got["positives"], got["negatives"]) == (len(pos), len(neg)) and got["roc_auc"] == pytest.approx(want, abs=1e-12)
    assert boosting.roc_auc(df.filter("label = 1")).first()["roc_auc"] == 0.0
    assert boosting.roc_auc(df.limit(0)).first()["roc_auc"] == 0.0


def brute_lof(x, k):
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    radius = np.sort(d, axis=1)[:, k - 1]
    near = [np.flatnonzero(d[i] <= radius[i]) for i in range(n)]
    lrd = np.array([1 / (np.mean(np.maximum(radius[near[i]], d[i, near[i]])) + 1e-10) for i in range(n)])
    return np.array([lrd[near[i]].mean() / lrd[i] for i in range(n)])


@pytest.mark.parametrize("per_cell", [6, 40, 100000])
def test_lof_matches_brute_force(spark, per_cell):
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.integers(0, 60, 260) * 3.0, rng.integers(0, 8, 260), rng.integers(0, 3, 260)]).astype(float)
    x[:20] = x[20:40]
    x[0] = [900.0, 50.0, 9.0]
    df, names = frame(spark, x)
    got = density.local_outlier_factor(df, names, k=5, per_cell=per_cell).toPandas().set_index("loan_id")["lof"]
    want = pd.Series(brute_lof(x, 5), index=[f"L{i:05d}" for i in range(len(x))])
    np.testing.assert_allclose(got.loc[want.index], want, rtol=1e-6)


@pytest.mark.parametrize("max_cells", [16, 4096])
def test_lof_with_one_value_in_a_third_of_the_rows(spark, max_cells):
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.integers(1, 400, 900) * 1000.0, rng.integers(0, 24, 900), rng.integers(0, 60, 900)]).astype(float)
    x[::3, 0] = 5000.0
    x[5::90] = [5000.0, 12.0, 0.0]
    df, names = frame(spark, x)
    points = df.groupBy(*names).count()
    tree = density.cell_tree(points, names, 30, max_cells)
    sizes = np.bincount(tree.cell_of(np.unique(x, axis=0)))
    assert sizes.max() < 6 * max(30, len(x) // max_cells)  # the hot value is cut along the other coordinates
    got = density.local_outlier_factor(df, names, per_cell=30, max_cells=max_cells).toPandas().set_index("loan_id")["lof"]
    want = pd.Series(brute_lof(x, 20), index=[f"L{i:05d}" for i in range(len(x))])
    np.testing.assert_allclose(got.loc[want.index], want, rtol=1e-6)


def test_boxes_of_a_block_are_not_compared_with_all_cells():
    rng = np.random.default_rng(4)
    low = rng.uniform(0, 1000, (4096, 7))
    high = low + rng.uniform(0, 20, low.shape)
    points = 500 + rng.uniform(0, 30, (128, 7))
    for radius in (rng.uniform(0, 250, 128), np.r_[np.inf, np.zeros(127)], np.zeros(128)):
        tracemalloc.start()
        i, j = density.touched_boxes(points, radius, low, high)
        held = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        gap = np.maximum(0, np.maximum(low[None] - points[:, None], points[:, None] - high[None]))
        want = np.nonzero(np.sqrt((gap**2).sum(axis=2)) <= radius[:, None])
        assert (i.tolist(), j.tolist()) == (want[0].tolist(), want[1].tolist())
        assert np.isinf(radius[0]) or held < 8e6  # all boxes at once take over 50 MB
    assert len(density.touched_boxes(points[:0], radius[:0], low, high)[0]) == 0


def test_lof_of_few_and_no_rows(spark):
    x = np.array([[0.0, 1.0], [0.0, 1.0], [5.0, 2.0]])
    df, names = frame(spark, x)
    assert density.local_outlier_factor(df, names, k=1).count() == 3
    assert density.local_outlier_factor(df.limit(0), names).count() == 0


def test_boundary_scores_planted_outliers_highest(spark, planted):
    df, names = frame(spark, planted)
    scored = boundary.fit_boundary(df, names).score(df).toPandas().sort_values("boundary_score")
    assert {f"L{i:05d}" for i in range(12)} <= set(scored["loan_id"].tail(60))
    assert 0.08 < scored["is_outlier"].mean() < 0.12


def test_boundary_reaches_the_minimum_in_eight_passes(spark):
    """Against gradient descent on the same objective until it stands still."""
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=(700, 3)), rng.normal(loc=4, size=(60, 3))])
    df, names = frame(spark, x)
    model = boundary.fit_boundary(df, names, dimension=16)
    z = boundary._map((x - x.mean(0)) / x.std(0), model.directions, model.phases)
    mean = z.mean(axis=0)
    width, scale = np.std(z @ mean) / 4, 1 / (0.5 * len(z))

    def value_and_gradient(theta):
        sums = boundary._sums(z, theta[:-1], theta[-1], width) * scale
        return 0.5 * theta[:-1] @ theta[:-1] - theta[-1] + sums[0], np.r_[theta[:-1], -1.0] + sums[1 : len(theta) + 1]

    theta = np.r_[mean, mean @ mean]
    for _ in range(40000):
        theta = theta - 0.005 * value_and_gradient(theta)[1]
    low, start = value_and_gradient(theta)[0], value_and_gradient(np.r_[mean, mean @ mean])[0]
    got = value_and_gradient(np.r_[model.weights, model.rho])[0]
    assert got - low <= 0.02 * (start - low)


def test_reconstruction_error_matches_numpy(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(
        rng.normal(size=(300, 6)) * [5, 3, 2, 4, 1, 1], columns=reconstruction.FEATURES
    ).assign(loan_id=range(300))
    model = reconstruction.fit_reconstruction(spark.createDataFrame(pdf), k=3)
    got = model.score(spark.createDataFrame(pdf)).toPandas().set_index("loan_id").sort_index()
    x = pdf[reconstruction.FEATURES].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    _, _, vt = np.linalg.svd(z - z.mean(0), full_matrices=False)
    p = vt[:3].T
    mse = ((z - z @ p @ p.T) ** 2).mean(1)
    np.testing.assert_allclose(got["mse"], mse, rtol=1e-6)
    assert model.threshold == pytest.approx(np.sort(mse)[int(300 * 0.95) - 1])
    assert got["anomaly_score"].between(0, 1).all() and got["is_anomaly"].sum() == 15


def test_split_is_exact_and_repeatable(spark):
    df = spark.range(5000).select(F.col("id").alias("loan_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    train, test = boosting.stratified_split(df, "label", "loan_id")
    assert {r["label"]: r["count"] for r in train.groupBy("label").count().collect()} == {0: 3600, 1: 400}
    assert train.join(test, "loan_id").count() == 0 and train.count() + test.count() == 5000
    again, _ = boosting.stratified_split(df.repartition(9), "label", "loan_id")
    assert again.exceptAll(train).count() == 0


def test_boosting_learns_a_separable_set(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    df, names = frame(spark, x, {"label": ((x[:, 0] > 0.3) & (x[:, 1] > -1)).astype(int)})
    training = boosting.train_classifier(df, names, trees=10, folds=2)
    assert training.metrics["roc_auc"] > 0.95 and training.metrics["cv_f1_mean"] > 0.85
    assert training.importances[0][0] == "f0"
    assert training.metrics["training_samples"] + training.metrics["test_samples"] == 600


def _boost_rows(spark, n=500):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 4, n), np.round(rng.normal(size=n), 1)])
    return frame(spark, x, {"label": ((x[:, 0] + x[:, 1] - x[:, 2] + rng.normal(size=n)) > 1.5).astype(int)})


@pytest.mark.parametrize("whole", [2_000_000, 0])
def test_boosting_equals_the_library(spark, monkeypatch, whole):
    """Same margins and weights as Spark's own boosted trees, grown by one task or by a job per level."""
    monkeypatch.setattr(boosting, "WHOLE_ROWS", whole)
    df, names = _boost_rows(spark)
    model = boosting.fit_boosted(df, names, trees=4)
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(df)
    library = GBTClassifier(labelCol="label", predictionCol="predicted", maxIter=4, maxDepth=5, stepSize=0.1).fit(rows)
    got, want = (
        m.transform(d).orderBy("loan_id").select(vector_to_array("rawPrediction")[1].alias("m"), "predicted").toPandas()
        for m, d in ((model, df), (library, rows))
    )
    np.testing.assert_allclose(got, want, rtol=1e-9)
    np.testing.assert_allclose(model.stages[-1].featureImportances.toArray(), library.featureImportances.toArray(), rtol=1e-9)


def test_parts_are_fitted_side_by_side(spark, monkeypatch):
    """Parts give the models of single fits, in blocks over several tasks and in one task; their models judge rows alike."""
    df, names = _boost_rows(spark)
    third = F.pmod(F.xxhash64("loan_id"), F.lit(3))
    alone = [boosting.fit_parts(df.filter(third != i), names, [F.lit(True)], trees=12, depth=3)[0] for i in range(3)]
    together = [boosting.fit_parts(df, names, [third != i for i in range(3)], trees=12, depth=3)]
    for name, value in (("WHOLE_ROWS", 0), ("TASK_ROWS", 300), ("BLOCK_ROWS", 100)):
        monkeypatch.setattr(boosting, name, value)
    together.append(boosting.fit_parts(df, names, [third != i for i in range(3)], trees=12, depth=3))
    for models in together:
        for one, other in zip(alone, models, strict=True):
            np.testing.assert_array_equal(one.feature, other.feature)
            np.testing.assert_allclose(one.threshold, other.threshold)
            np.testing.assert_allclose(one.value, other.value, atol=1e-9)
    pdf = df.withColumn("m", boosting.fold_margin(alone, [F.col(c) for c in names], third)).withColumn("fold", third).toPandas()
    for i, model in enumerate(alone):
        own = pdf[pdf["fold"] == i]
        scored = boosting.library_model(spark, model, "label", 42).transform(df.filter(third == i))
        want = scored.select("loan_id", vector_to_array("rawPrediction")[1].alias("w")).toPandas().set_index("loan_id")["w"]
        np.testing.assert_allclose(own.set_index("loan_id")["m"].sort_index(), want.sort_index(), rtol=1e-9)


def test_folds_cost_no_jobs_of_their_own(spark):
    """Trees and folds do not multiply jobs: a fit was a few jobs for every level of every tree of every fold."""
    df, names = _boost_rows(spark)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("boosted", "boosted")
    boosting.train_classifier(df, names, trees=10, folds=3)
    jobs = len(tracker.getJobIdsForGroup("boosted"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs < 100


def test_lost_margins_come_from_the_trees(monkeypatch, tmp_path):
    """An executor without the file of a task's margins makes it anew from all trees; one with the last file adds one tree."""
    monkeypatch.setattr(boosting.tempfile, "gettempdir", lambda: str(tmp_path))
    codes = boosting.Codes.of([4])
    block = codes.encoded([np.array([0, 1, 2, 3])]), np.array([1, -1, 1, -1], np.int8), np.array([1, 1, 1, 0], np.uint8)
    trees = [(n, [(np.array([0, -1, -1]), np.array([n, 0, 0]), np.array([0.0, 1.0, 10.0]))]) for n in range(3)]
    asked = []

    def so_far(first, end):
        asked.append((first, end))
        return trees[first:end]

    def all_of(folder, done):
        return [m for _, m in boosting._margins(codes, folder, 1, 0, iter([block]), so_far, done, 0.5)][0].tolist()

    steps = [all_of("kept", n) for n in (1, 2, 2, 3)]
    assert asked == [(0, 1), (1, 2), (2, 3)] and steps[1] == steps[2]
    assert all_of("lost", 3) == steps[3] == [[2.0, 11.0, 15.5, 0.0]]
    assert asked[3:] == [(0, 3)]


def test_folds_are_fits_of_the_whole_classifier(spark, monkeypatch):
    """`gbt_folds` fits as many trees as `gbt_metrics`: 100, in five folds."""
    form = inspect.signature(boosting.train_classifier)
    asked = []

    def record(*args, **options):
        bound = form.bind(*args, **options)
        bound.apply_defaults()
        asked.append((bound.arguments["trees"], bound.arguments["folds"]))

    df = spark.createDataFrame([("L1", True)], "loan_id string, is_fraud boolean")
    monkeypatch.setattr(catalog, "_labelled_book", lambda *_: df)
    monkeypatch.setattr(catalog, "_features_of", lambda book, *_: book)
    monkeypatch.setattr(boosting, "train_classifier", record)
    monkeypatch.setattr(boosting, "metrics_frame", lambda matrix, _: matrix)
    catalog.gbt_folds(spark, "")
    catalog.gbt_metrics(spark, "")
    assert asked == [(100, 5), (100, 0)]


def test_metrics_without_positives_are_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, predicted int")
    row = boosting.confusion_metrics(df).first()
    assert (row["precision"], row["recall"], row["f1_score"]) == (0.0, 0.0, 0.0)


def test_screen_alerts_and_model_store(spark, tmp_path):
    rng = np.random.default_rng(9)
    x = np.abs(rng.normal(size=(400, len(FEATURE_NAMES))))
    x[:6] *= 12
    pdf = pd.DataFrame(x, columns=FEATURE_NAMES).assign(
        loan_id=[f"L{i:03d}" for i in range(400)], officer_id="O1", label=[int(i < 6 or i % 40 == 0) for i in range(400)]
    )
    features = spark.createDataFrame(pdf)
    screen = screening.train_screen(features, trees=5, folds=0)
    scored = screen.score(features)
    assert scored.filter("risk_score < 0 or risk_score > 100").count() == 0
    alerts = screen.alerts(scored, n=10).collect()
    assert 0 < len(alerts) <= 10 and {a["detection_method"] for a in alerts} == {"ml"}
    path = str(tmp_path / "screen")
    screen.save(spark, path)
    again = screening.Screen.load(spark, path)
    a, b = (s.score(features).select("loan_id", "risk_score").toPandas().sort_values("loan_id") for s in (screen, again))
    np.testing.assert_allclose(a["risk_score"], b["risk_score"])
    with pytest.raises(Exception):
        screening.Screen.load(spark, str(tmp_path / "nothing"))


def test_factors_and_types(spark):
    base = dict.fromkeys(FEATURE_NAMES, 0.0)
    rows = [
        {**base, "loan_id": "none"},
        {**base, "loan_id": "late", "is_after_hours": 1.0, "amount_vs_avg": 3.0},
        {**base, "loan_id": "phone", "shared_phone_count": 2.0, "geographic_density": 9.0, "officer_volume_z": -3.0},
    ]
    df = spark.createDataFrame(pd.DataFrame(rows)).withColumn("f", screening.risk_factors())
    got = {r["loan_id"]: (r["f"], r["t"]) for r in df.withColumn("t", screening.type_of_factors(F.col("f"))).collect()}
    assert got["none"] == (["statistical_anomaly"], "ml_anomaly")
    assert got["late"] == (["high_loan_amount", "after_hours_transaction"], "timing_anomaly")
    assert got["phone"] == (["unusual_officer_volume", "shared_phone_number", "geographic_clustering"], "ghost_loan")


def test_ensemble_weights_available_scores(spark):
    df = spark.createDataFrame([(0.8, None, 0.2), (None, None, None), (1.0, 1.0, None)], "a double, b double, c double")
    rows = ensemble.combine_scores(df, {"isolation_forest": "a", "huggingface": "b", "other": "c"}).collect()
    assert rows[0]["ensemble_score"] == pytest.approx((0.8 * 0.25 + 0.2 * 0.2) / 0.45) and rows[0]["models_used"] == 2
    assert (rows[1]["ensemble_score"], rows[1]["models_used"], rows[1]["risk_level"]) == (0.5, 0, "MEDIUM")
    assert rows[2]["risk_level"] == "HIGH"


def test_time_features_fall_back(spark):
    df = spark.createDataFrame(
        [("1", 5.0, "23:45", "2024-01-06"), ("2", None, "noon", "soon"), ("3", 1.0, None, None)],
        "loan_id string, amount double, approval_time string, loan_date string",
    )
    rows = [list(r)[1:] for r in ensemble.ensemble_features(df).orderBy("loan_id").collect()]
    assert rows[0] == [5.0, 23.0, 45.0, 1.0, 5.0, 1.0, 1.0]
    assert rows[1] == [0.0, 12.0, 0.0, 0.0, 2.0, 6.0, 0.0]
    assert rows[2] == [1.0, 12.0, 0.0, 0.0, 2.0, 6.0, 0.0]


def test_outside_scorer_sees_bounded_batches(spark):
    df = spark.createDataFrame([(f"{'x' * (i % 5)}",) for i in range(100)], "t string")

    def load():
        def score(texts):
            assert len(texts) <= 8
            return texts.str.len() / 10

        return score

    got = ensemble.batch_score(df, load, "t", batch_size=8)
    assert got.filter("abs(score - length(t) / 10.0) > 1e-9").count() == 0


@pytest.mark.parametrize("shape", ["chain", "star", "mixed"])
def test_components(spark, shape):
    if shape == "chain":
        links = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(120)]
    elif shape == "star":
        links = [("hub", f"z{i}") for i in range(200)]
    else:
        links = [("a", "b"), ("c", "b"), ("x", "y"), ("y", "x"), ("m", "m"), ("q", "c")]
    got = {r["id"]: r["component"] for r in graph.connected_components(spark.createDataFrame(links, "source string, target string")).collect()}
    if shape == "mixed":
        assert got == {"a": "a", "b": "a", "c": "a", "q": "a", "x": "x", "y": "x"}
    else:
        smallest = min(n for pair in links for n in pair)
        assert set(got.values()) == {smallest} and len(got) == len({n for pair in links for n in pair})


def test_steps_of_components_send_no_links_through_the_driver(spark, monkeypatch):
    plans, write = [], graph.Scratch.write

    def kept(self, df, name):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return write(self, df, name)

    monkeypatch.setattr(graph.Scratch, "write", kept)
    links = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(40)]
    found = graph.connected_components(spark.createDataFrame(links, "source string, target string"))
    assert {r["component"] for r in found.collect()} == {"n00"}
    assert len(plans) > 4 and not any("Broadcast" in plan for plan in plans)


def test_graph_of_a_small_book(make_loans):
    rows = [
        ("L1", "B1", "O1", "07", "G"),
        ("L2", "B2", "O1", "07", "G"),
        ("L3", "B3", "O2", "07", "G"),
        ("L4", "B4", "O2", "09", None),
        ("L5", "B4", None, None, None),
    ]
    names = ["loan_id", "borrower_id", "officer_id", "phone_number", "guarantor_name"]
    loans = make_loans([{**dict(zip(names, r)), "amount": 10.0} for r in rows])
    nodes = {r["id"]: r["risk"] for r in graph.nodes(loans).collect()}
    assert nodes["B:B1"] == "medium" and nodes["B:B4"] == "low" and nodes["O:O1"] == "low"
    assert sum(k.startswith("G:") for k in nodes) == 1
    phone = {(r["source"], r["target"]) for r in graph.edges(loans).filter("type = 'shared_phone'").collect()}
    assert phone == {("B:B1", "B:B2"), ("B:B1", "B:B3")}
    assert graph.phone_pair_edges(loans).count() == 3
    (cluster,) = graph.suspicious_clusters(graph.nodes(loans), graph.edges(loans)).collect()
    assert (cluster["size"], cluster["high_risk_count"], cluster["risk_level"]) == (4, 1, "medium")
    shown = graph.nodes(loans).filter("id in ('B:B1', 'B:B2')")
    assert graph.keep_known(graph.edges(loans), shown).count() == 1
    assert graph.nodes(loans, sample=2).filter("type = 'borrower'").count() == 2
