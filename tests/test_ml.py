import random

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from fleetrisk.operators import ml, policy

COLS = ("kb_id string, cve_id string, month string, cvss_score double, severity string, exploitation string, "
        "patch_age_days int, attack_vector string, attack_complexity string, privileges_required string, "
        "user_interaction string, scope string, confidentiality_impact string, integrity_impact string, "
        "availability_impact string")


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(600):
        score = round(rnd.uniform(0, 10), 1)
        rows.append((f"KB{i % 40}", f"CVE-2024-{i:05d}", rnd.choice(["2026-Jan", "2026-Feb"]), score,
                     "Critical" if score >= 9 else "Important" if score >= 7 else "Low",
                     rnd.choice(["Exploited:Yes", "Exploited:No"]), rnd.choice([None, 10, 100, 200]),
                     rnd.choice(["N", "L", "A"]), "L", rnd.choice(["N", "L"]), rnd.choice(["N", "R"]), "U",
                     rnd.choice(["H", "L"]), "N", "N"))
    df = spark.createDataFrame(rows, COLS)
    return policy.label(policy.apply_policy(df)).cache()


def test_unseen_and_null_categories_encode_to_zero(spark):
    train = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 1.0), ("a", 3.0, 1.0)], "c string, x double, row_weight double")
    stages = ml.preprocessing(train, scale=False, categorical=("c",), numeric=("x",))
    model = Pipeline(stages=stages).fit(train)
    test = spark.createDataFrame([("a", 1.0), ("zzz", 1.0), (None, 1.0)], "c string, x double")
    vecs = [r.features.toArray().tolist() for r in model.transform(test).collect()]
    assert vecs[0][1:] != [0.0, 0.0] and vecs[1][1:] == [0.0, 0.0] and vecs[2][1:] == [0.0, 0.0]


def test_splits(spark, labelled):
    frame = ml.model_frame(labelled)
    train, test = ml.hash_split(frame)
    assert train.count() + test.count() == 600 and 60 < test.count() < 180
    assert sorted(r.cve_id for r in ml.hash_split(frame.repartition(5))[1].collect()) == sorted(r.cve_id for r in test.collect())
    tr, te = ml.stratified_split(frame, "priority_label")
    n = {r.priority_label: r["count"] for r in frame.groupBy("priority_label").count().collect()}
    t = {r.priority_label: r["count"] for r in te.groupBy("priority_label").count().collect()}
    assert all(t[k] == -(-n[k] * 20 // 100) for k in n)
    assert tr.count() + te.count() == 600


def test_stratified_split_is_the_sorted_one(spark, labelled):
    """The split by selection cuts where a sort of all rows would."""
    frame = ml.model_frame(labelled).where("priority_label is not null").select(*ml.ROW_KEY, "priority_label")
    h = F.xxhash64(*ml.ROW_KEY, F.lit(ml.SEED))
    rows = frame.select("priority_label", F.struct(h, *ml.ROW_KEY).alias("k"), "cve_id").collect()
    for percent in (0, 1, 20, 50, 100):
        train, test = ml.stratified_split(frame, "priority_label", percent)
        got = {r.cve_id for r in test.collect()}
        want = set()
        for label in {r.priority_label for r in rows}:
            own = sorted((tuple(r.k), r.cve_id) for r in rows if r.priority_label == label)
            n = -(-len(own) * percent // 100)
            want |= {c for _, c in own[len(own) - n:]}
        assert got == want and train.count() + test.count() == len(rows), percent


def test_kmeans_runs_share_passes_and_reach_the_best_fit(spark, labelled, monkeypatch):
    from pyspark.ml.clustering import KMeans
    frame = ml.training_set(labelled)
    _, feats, arrays = ml._prepared(frame)
    best = min(KMeans(k=4, seed=s, weightCol="row_weight", maxIter=100, tol=1e-6).fit(feats).summary.trainingCost for s in range(6))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("kmeans", "")
    runs = ml.kmeans_runs(arrays, [(4, s) for s in range(10)] + [(2, 0), (4, 0)])
    jobs = len(tracker.getJobIdsForGroup("kmeans"))
    spark.sparkContext.setJobGroup("", "")
    assert min(cost for cost, _ in runs[:10]) <= best * 1.01 and runs[0][0] == runs[11][0] and len(runs[10][1]) == 2
    assert jobs < 4 * (ml.KMEANS_MAX_ITER + 2)  # a few jobs a pass under adaptive execution, however many runs
    cost, centres = runs[0]
    got = ml.NearestCentre(centres.tolist()).transform(feats).select("features", "row_weight", "cluster").collect()
    far = [[float(((r.features.toArray() - c) ** 2).sum()) for c in centres] for r in got]
    assert all(d[r.cluster] == min(d) for d, r in zip(far, got)) and sum(min(d) * r.row_weight for d, r in zip(far, got)) == pytest.approx(cost)
    assert ml.kmeans_runs(arrays.limit(0), [(2, 0)])[0][0] == 0.0


def test_models_learn_the_policy(spark, labelled, tmp_path):
    frame = ml.training_set(labelled)
    models = ml.Models(ml.fit_regression(frame, trees=30), ml.fit_classification(frame, max_iter=200),
                       ml.fit_clustering(frame, restarts=2))
    pred = ml.predict(models, labelled)
    reg = {r.metric: r.value for r in ml.regression_metrics(pred, "risk_score", "ml_risk").collect()}
    cls = {r.metric: r.value for r in ml.classification_metrics(pred, "priority_label", "ml_priority").collect()}
    assert reg["r2"] > 0.8 and cls["accuracy"] > 0.7
    assert pred.select("cluster").distinct().count() <= ml.CLUSTERS
    folder = str(tmp_path / "models")
    models.save(folder)
    assert ml.Models.missing(folder) == []
    again = ml.predict(ml.Models.load(folder), labelled)
    a = sorted((r.cve_id, r.ml_risk, r.ml_priority, r.cluster) for r in pred.collect())
    b = sorted((r.cve_id, r.ml_risk, r.ml_priority, r.cluster) for r in again.collect())
    assert a == b
    assert ml.Models.missing(str(tmp_path / "nothing")) == list(ml.Models.NAMES)


def test_compaction_keeps_weights(spark, labelled):
    c = ml.compact(ml.model_frame(labelled), ml.LABELS)
    assert c.agg(F.sum("row_weight")).first()[0] == 600


def test_compacted_features_equal_uncompacted(spark, labelled):
    """Weighted preprocessing of compacted rows gives the features of the rows themselves."""
    frame = ml.model_frame(labelled).unionByName(ml.model_frame(labelled.where("cvss_score > 6")))
    each = frame.withColumn("row_weight", F.lit(1.0))
    inputs = list(ml.MODEL_INPUTS)
    out = {}
    for name, rows in (("each", each), ("compact", ml.compact(frame))):
        model = Pipeline(stages=ml.preprocessing(rows, scale=True)).fit(rows)
        out[name] = {tuple(r[c] for c in inputs): r.features.toArray() for r in model.transform(frame.select(*inputs)).distinct().collect()}
    assert out["each"].keys() == out["compact"].keys()
    assert max(abs(out["each"][k] - out["compact"][k]).max() for k in out["each"]) < 1e-9
    scaled = [v[:3] for r in each.select(*inputs).collect() for v in [out["each"][tuple(r[c] for c in inputs)]]]
    n = len(scaled)
    for i in range(3):
        mean = sum(v[i] for v in scaled) / n
        assert abs(mean) < 1e-9 and abs(sum(v[i] ** 2 for v in scaled) / n - 1) < 1e-9


def test_weighted_median(spark):
    for values in ([(1.0, 1.0), (2.0, 1.0), (9.0, 5.0)], [(1.0, 2.0), (4.0, 2.0)], [(3.0, 1.0), (None, 9.0)]):
        flat = sorted(v for v, w in values for _ in range(int(w)) if v is not None)
        want = (flat[(len(flat) - 1) // 2] + flat[len(flat) // 2]) / 2
        assert ml.weighted_median(spark.createDataFrame(values, "x double, w double"), "x", "w") == want


def test_stage_metric_and_status(spark):
    metrics = spark.createDataFrame([("mae", 0.5)], "metric string, value double")
    summary = ml.run_summary("r1", {"regression": metrics})
    assert [tuple(r) for r in ml.stage_metric(summary, "regression", "mae").collect()] == [("r1", 0.5)]
    assert {(r.stage, r.status) for r in ml.run_status(summary, ["regression", "clustering"]).collect()} == {
        ("regression", "complete"), ("clustering", "missing")}


def test_elbow_k1_is_total_sum_of_squares(spark, labelled):
    e = {r.k: r.wcss for r in ml.elbow(ml.training_set(labelled), max_k=3, restarts=2).collect()}
    assert e[1] >= e[2] >= e[3] >= 0


def test_classification_metrics_with_absent_label(spark):
    df = spark.createDataFrame([("High", "High"), ("Low", "High"), ("Medium", "Medium"), ("Low", "Low")], "t string, p string")
    m = {r.metric: r.value for r in ml.classification_metrics(df, "t", "p").collect()}
    assert m["accuracy"] == 0.75
    # f1: High 2/3 (support 1), Medium 1 (1), Low 2/3 (2) -> (2/3 + 1 + 4/3) / 4
    assert m["weighted_f1"] == pytest.approx((2 / 3 + 1 + 4 / 3) / 4, abs=1e-6)
    r = {x.metric: x.value for x in ml.regression_metrics(
        spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 3.0)], "y double, p double"), "y", "p").collect()}
    assert r["mae"] == pytest.approx(1 / 3, abs=1e-6) and r["r2"] == pytest.approx(0.5, abs=1e-6)


def test_profiles_are_drawn_as_their_rows(spark):
    """Rows of equal weight that add up to the profile's; up to the bound they are its rows."""
    rows = spark.createDataFrame([("a", 1.0), ("b", 5.0), ("c", 16.0), ("d", 1000.0), ("e", 0.5)], "k string, row_weight double")
    found = {r.k: (r.n, r.w, r.least) for r in ml.drawn_apart(rows, 16).groupBy("k").agg(
        F.count("*").alias("n"), F.sum("row_weight").alias("w"), F.min("row_weight").alias("least")).collect()}
    assert found == {"a": (1, 1.0, 1.0), "b": (5, 5.0, 1.0), "c": (16, 16.0, 1.0), "d": (16, 1000.0, 62.5), "e": (1, 0.5, 0.5)}


def test_forest_on_profiles_predicts_like_one_on_rows(spark, labelled, monkeypatch):
    """Predictions differ by little more than those of two forests on rows with different seeds."""
    rows = ml.model_frame(labelled)
    for least in (3, 5, 7, 8):  # profiles of one to five rows
        rows = rows.unionByName(ml.model_frame(labelled.where(F.col("cvss_score") > least)))
    inputs, each = list(ml.MODEL_INPUTS), rows.withColumn("row_weight", F.lit(1.0))
    found = []
    for train, seed in ((each, ml.SEED), (each, ml.SEED + 1), (ml.compact(rows, ml.LABELS), ml.SEED)):
        monkeypatch.setattr(ml, "SEED", seed)
        model = ml.fit_regression(train, trees=40, pieces=16)
        found.append({tuple(r[c] for c in inputs): r.ml_risk for r in model.transform(ml.model_frame(labelled)).collect()})
    first, again, profiles = found
    gap = lambda other: sum(abs(first[k] - other[k]) for k in first) / len(first)
    assert gap(profiles) < 2 * gap(again)


def test_a_forest_in_parts_is_one_forest(spark, tmp_path):
    """All trees are grown whatever the driver may hold; mean prediction, importances and a saved copy agree with the parts."""
    import random
    rnd = random.Random(5)
    rows = [(rnd.choice(["Low", "High"]), *["N"] * len(ml.CVSS_METRICS), float(rnd.randint(0, 100)) / 10, float(rnd.randint(0, 900)), float(rnd.randint(0, 1)))
            for _ in range(300)]
    schema = ", ".join(f"{c} string" for c in ml.CATEGORICAL) + ", " + ", ".join(f"{c} double" for c in ml.NUMERIC) + ", risk_score double, row_weight double"
    frame = spark.createDataFrame([(*r, r[-3] + r[-1], 1.0) for r in rows], schema)
    model = ml.fit_regression(frame, trees=12, nodes=1500)
    forest = model.stages[-1]
    parts = [ml.RandomForestRegressionModel.load(p) for p in forest.getOrDefault("parts")]
    assert isinstance(forest, ml.Forest) and len(parts) > 1 and sum(p.getNumTrees for p in parts) == 12
    assert all(p.totalNumNodes <= 1500 * 1.5 for p in parts)
    assert len({p.trees[0].toDebugString for p in parts}) == len(parts)  # each part draws anew
    out = model.transform(frame)
    feats = ml.PipelineModel(stages=model.stages[:-1]).transform(frame).select("features", *frame.columns)
    own = {}
    for p in parts:
        for r in p.transform(feats).collect():
            key = (r.cvss_score, r.patch_age_days, r.exploited_flag, r.severity)
            own[key, id(p)] = r.ml_risk * p.getNumTrees / 12
    for r in out.collect():
        key = (r.cvss_score, r.patch_age_days, r.exploited_flag, r.severity)
        assert abs(r.ml_risk - sum(own[key, id(p)] for p in parts)) < 1e-9
    assert out.columns == [*ml.PipelineModel(stages=model.stages[:-1]).transform(frame).columns, "ml_risk"]
    assert ml.regression_metrics(out, "risk_score", "ml_risk").where("metric = 'r2'").first().value > 0.9
    assert {r.feature for r in ml.feature_importance(model, frame, top=2).collect()} == {"cvss_score__imp", "exploited_flag__imp"}
    model.write().overwrite().save(str(tmp_path / "m"))
    copy = ml.PipelineModel.load(str(tmp_path / "m"))
    assert all(str(tmp_path) in p for p in copy.stages[-1].getOrDefault("parts"))
    assert sorted(r.ml_risk for r in copy.transform(frame).collect()) == sorted(r.ml_risk for r in out.collect())
    small = ml.fit_regression(frame.limit(20), trees=3)
    assert isinstance(small.stages[-1], ml.RandomForestRegressionModel)


def _many_profiles(spark, rows: int = 300, seed: int = 5):
    rnd = random.Random(seed)
    data = [(rnd.choice(["Low", "High", None]), *[rnd.choice("NLA") for _ in ml.CVSS_METRICS], float(rnd.randint(0, 100)) / 10, float(rnd.randint(0, 900)),
             float(rnd.randint(0, 1)), rnd.uniform(0, 16), float(rnd.randint(1, 9))) for _ in range(rows)]
    schema = ", ".join(f"{c} string" for c in ml.CATEGORICAL) + ", " + ", ".join(f"{c} double" for c in ml.NUMERIC) + ", risk_score double, row_weight double"
    return spark.createDataFrame(data, schema)


def test_a_tree_grown_by_a_task_is_that_of_sparks_trainer(spark):
    """Same bins, splits and means as Spark's tree on the same rows, whole and of bounded depth."""
    from pyspark.ml.regression import DecisionTreeRegressor

    frame = _many_profiles(spark)
    frame = frame.unionByName(frame.limit(40))  # rows may come twice
    feats = Pipeline(stages=ml.preprocessing(frame, scale=False)).fit(frame).transform(frame).cache()
    groups, bounds = ml.forest.binned(feats.repartition(3), "risk_score")
    *arrays, n = ml.forest.grouped(groups, len(bounds))
    assert n.sum() == 340 and len(n) == 300 and max(len(b) for b in bounds if b is not None) == ml.forest.BINS - 1
    x = [r.features.toArray() for r in feats.select("features").collect()]
    for depth in (0, 1, 3, 30):
        tree = ml.forest.grow(*arrays, n, [0 if b is None else len(b) + 1 for b in bounds], depth)
        nodes = spark.createDataFrame(ml.forest.node_rows(tree, 0, 0, bounds).to_pandas())
        path = f"{ml.shared_folder(spark, 'tree')}/data"
        nodes.select("treeID", F.from_json(F.to_json("nodeData"), ml.forest.NODES.split("nodeData ", 1)[1]).alias("nodeData")).write.parquet(path)
        got = ml.forest.predicted(ml.np.array(x), ml.forest.loaded(spark, [path.removesuffix("/data")]))
        model = DecisionTreeRegressor(labelCol="risk_score", weightCol="row_weight", maxDepth=depth).fit(feats)
        want = [r.prediction for r in model.transform(feats).select("prediction").collect()]
        assert len(tree["feature"]) == model.numNodes and max(abs(got - want)) < 1e-9, depth


def test_large_forests_are_not_grown_on_the_driver(spark, monkeypatch):
    """Beyond the bound of nodes tasks grow all trees, the same ones however the rows lie; beyond the bound of broadcasts Spark's trainer does, in parts."""
    from fleetrisk.operators import joins

    frame = _many_profiles(spark)
    fits = ml.RandomForestRegressor

    def refused(*_, **__):
        raise AssertionError("Spark's trainer was asked")

    monkeypatch.setattr(ml, "RandomForestRegressor", refused)
    out = []
    for rows in (frame, frame.repartition(7).orderBy("patch_age_days")):
        model = ml.fit_regression(rows, trees=12, nodes=1500)
        assert sum(model.stages[-1].getOrDefault("trees")) == 12
        out.append([r.ml_risk for r in model.transform(frame).orderBy("cvss_score", "patch_age_days", "risk_score").collect()])
    assert out[0] == out[1]
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 1000)
    monkeypatch.setattr(ml, "RandomForestRegressor", fits)
    model = ml.fit_regression(frame, trees=4, nodes=500)
    parts = [ml.RandomForestRegressionModel.load(p) for p in model.stages[-1].getOrDefault("parts")]
    assert len(parts) > 1 and sum(p.getNumTrees for p in parts) == 4
    want = ml.np.mean([p.transform(ml.PipelineModel(stages=model.stages[:-1]).transform(frame)).orderBy("cvss_score", "patch_age_days", "risk_score").toPandas()["ml_risk"]
                       * p.getNumTrees for p in parts], axis=0) * len(parts) / 4
    got = [r.ml_risk for r in model.transform(frame).orderBy("cvss_score", "patch_age_days", "risk_score").collect()]  # several passes
    assert max(abs(want - got)) < 1e-9


def test_saved_rows_are_not_saved_again_to_be_split(spark, labelled, monkeypatch):
    rows = ml.saved(ml.model_frame(labelled).select(*ml.ROW_KEY, "priority_label"))
    want = [sorted(r.cve_id for r in part.collect()) for part in ml.stratified_split(rows, "priority_label")]
    monkeypatch.setattr(ml, "saved", lambda df: pytest.fail("saved again"))
    assert [sorted(r.cve_id for r in part.collect()) for part in ml.stratified_split(rows, "priority_label", stored=True)] == want
