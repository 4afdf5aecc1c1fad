"""Supporting models on the labelled rows, distributed with ``pyspark.ml``.

Regression (random forest on the policy score), classification (multinomial
logistic regression with balanced class weights on the priority label) and
k-means clustering, each a Pipeline of preprocessing + estimator. Metrics are
plain aggregates; splits are hash-based so they do not depend on partitioning.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IndexToString, OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetrisk.functions.cvss import exploited
from fleetrisk.operators import forest
from fleetrisk.operators.joins import join_dimension, saved
from fleetrisk.operators.rank import rank_within
from fleetrisk.schemas import CVSS_METRICS
from fleetrisk.session import shared_folder

# fixed values: model settings
SEED = 2137
TEST_PERCENT = 20
FOREST_TREES = 200
FOREST_MAX_DEPTH = 30  # the deepest Spark grows; on compacted rows leaves are pure well before
FOREST_NODES = 500_000  # nodes of trees that the driver holds at once; a larger forest is grown in parts
LOGISTIC_MAX_ITER = 2000
LOGISTIC_C = 1.0
CLUSTERS = 5
CLUSTER_RESTARTS = 10
ELBOW_MAX_K = 10
CATEGORICAL = ("severity",) + CVSS_METRICS
NUMERIC = ("cvss_score", "patch_age_days", "exploited_flag")
NOT_FEATURES = ("scan_id", "kb_id", "cve_id", "month", "published_date", "exploitation", "policy_risk",
                "policy_priority", "policy_drivers", "top_driver", "risk_score", "priority_label")
ROW_KEY = ("kb_id", "cve_id", "month")


def model_frame(df: DataFrame) -> DataFrame:
    """Typed model inputs: exploitation flag, numeric columns as double."""
    return df.withColumns({
        "exploited_flag": exploited(F.col("exploitation")).cast("double"),
        "cvss_score": F.col("cvss_score").cast("double"),
        "patch_age_days": F.col("patch_age_days").cast("double"),
    })


def feature_columns(df: DataFrame) -> DataFrame:
    """Exclude-list projection: drop ids, dates, labels and policy outputs (absent names ignored)."""
    return df.drop(*NOT_FEATURES)


def weighted_median(df: DataFrame, col: str, weight: str) -> float:
    """Median of ``col`` with each row counted ``weight`` times: as many rows at most
    below as above; between two middle values their mean. No value: 0."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.sum(weight).alias("w"))
    total = counts.agg(F.sum("w")).first()[0]
    if not total:
        return 0.0
    upto = Window.orderBy(col)  # over the distinct values of one model input
    ranked = counts.withColumn("c", F.sum("w").over(upto))
    low = ranked.where(F.col("c") >= total / 2).agg(F.min(col)).first()[0]
    high = ranked.where(F.col("c") > total / 2).agg(F.min(col)).first()[0]
    return (low + (low if high is None else high)) / 2


def scaling(rows: DataFrame, numeric=NUMERIC, weight: str = "row_weight") -> tuple[dict, dict, dict]:
    """(medians, means, deviations) of the numeric inputs, each row counted ``weight`` times;
    mean and population deviation are of the values with the median in place of missing ones."""
    medians = {c: weighted_median(rows, c, weight) for c in numeric}
    w, filled = F.col(weight), {c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) for c in numeric}
    sums = rows.agg(F.sum(w).alias("n"), *[F.sum(w * e).alias(f"s_{c}") for c, e in filled.items()]).first()
    n = sums["n"] or 1.0
    means = {c: (sums[f"s_{c}"] or 0.0) / n for c in numeric}
    squares = rows.agg(*[F.sum(w * F.pow(e - F.lit(means[c]), 2)).alias(c) for c, e in filled.items()]).first()
    return medians, means, {c: ((squares[c] or 0.0) / n) ** 0.5 for c in numeric}


def preprocessing(rows: DataFrame, scale: bool, categorical=CATEGORICAL, numeric=NUMERIC, out: str = "features",
                  weight: str = "row_weight") -> list:
    """One-hot strings (unseen / null -> all zeros), median-imputed numerics, optional scaling.

    Medians, means and deviations are of the rows that the compacted ``rows`` stand for
    (each counted ``weight`` times), so features equal those fitted on the rows themselves.
    """
    idx = [f"{c}__idx" for c in categorical]
    ohe = [f"{c}__ohe" for c in categorical]
    imp = [f"{c}__imp" for c in numeric]
    medians, means, deviations = scaling(rows, numeric, weight)
    filled = {c: f"coalesce(cast({c} as double), {medians[c]!r}d)" for c in numeric}
    if scale:
        filled = {c: f"({e} - {means[c]!r}d) / {deviations[c] or 1.0!r}d" for c, e in filled.items()}
    imputed = ", ".join(f"{e} AS {c}__imp" for c, e in filled.items())
    return [
        SQLTransformer(statement=f"SELECT *, {imputed} FROM __THIS__"),
        StringIndexer(inputCols=list(categorical), outputCols=idx, handleInvalid="keep", stringOrderType="alphabetAsc"),
        # the indexer sends unseen / null to its last index; dropLast turns that slot into all zeros
        OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True),
        VectorAssembler(inputCols=imp + ohe, outputCol=out),
    ]


def compact(df: DataFrame, label=None, weight: str = "row_weight") -> DataFrame:
    """Collapse rows with equal model inputs (and label) to one row with a count weight.

    Model inputs depend only on CVE metadata, so the (kb, cve, month) rows repeat
    the same feature vectors many times; a weighted fit over distinct vectors, with
    weighted preprocessing, has the same objective for logistic regression and
    k-means. The forest draws its bootstrap over profiles, each with its rows as
    weight, where a row-wise bootstrap would draw rows. Partial aggregation shrinks
    the data before the shuffle; profiles grow with the distinct CVEs.
    """
    if weight in df.columns:
        return df
    labels = [label] if isinstance(label, str) else list(label or [])
    cols = list(CATEGORICAL) + list(NUMERIC) + labels
    return df.groupBy(*cols).agg(F.count(F.lit(1)).cast("double").alias(weight))


LABELS = ("risk_score", "priority_label")


def training_set(labelled: DataFrame) -> DataFrame:
    """Compacted, checkpointed model input shared by all fits (reads the lineage once)."""
    return saved(compact(model_frame(labelled), LABELS))


def row_hash(key=ROW_KEY, seed: int = SEED):
    return F.pmod(F.xxhash64(*[F.col(k) for k in key], F.lit(seed)), F.lit(100))


def hash_split(df: DataFrame, test_percent: int = TEST_PERCENT, key=ROW_KEY, seed: int = SEED):
    """Deterministic ~80/20 split on a hash of the row key (stable under repartitioning)."""
    h = row_hash(key, seed)
    return df.where(h >= test_percent), df.where(h < test_percent)


#: a row's hash falls into one of 2 ** SPLIT_BITS ranges of equal width
SPLIT_BITS = 12


def stratified_split(df: DataFrame, label: str, test_percent: int = TEST_PERCENT, key=ROW_KEY,
                     seed: int = SEED, stored: bool = False):
    """Exact per-label split: within each label, rows ordered by hash and key (distinct within
    a label); the last ceil(test% * n_label) go to test.

    By selection, not by sorting: counts per (label, hash range) tell in which range the
    boundary lies, only that range's rows, one of 2 ** SPLIT_BITS, are ranked, and the
    row at the boundary cuts the table in two. ``stored``: the rows are saved already.
    """
    df = df if stored else saved(df)  # read three times below
    hashed = df.withColumn("_h", F.xxhash64(*[F.col(k) for k in key], F.lit(seed)))
    hashed = hashed.withColumn("_range", F.shiftright("_h", 64 - SPLIT_BITS))
    counts = hashed.groupBy(label, "_range").agg(F.count(F.lit(1)).alias("_c"))  # labels x ranges rows at most
    upto, whole = Window.partitionBy(label).orderBy("_range"), Window.partitionBy(label)
    counts = counts.withColumns({"_upto": F.sum("_c").over(upto), "_n": F.sum("_c").over(whole)})
    train_n = F.col("_n") - F.ceil(F.col("_n") * test_percent / 100.0)
    edge = (counts.withColumn("_train", train_n).where((F.col("_upto") > F.col("_train")) & (F.col("_upto") - F.col("_c") <= F.col("_train")))
            .select(F.col(label).alias("_label"), F.col("_range").alias("_edge"), (F.col("_train") - F.col("_upto") + F.col("_c")).alias("_keep")))
    edge = edge.checkpoint(eager=True)  # a row for each label that has test rows
    same = F.col(label).eqNullSafe(F.col("_label"))
    row = F.struct("_h", *key)
    inside = hashed.join(F.broadcast(edge), same).where(F.col("_range") == F.col("_edge"))
    ranked = rank_within(inside.select(F.col("_label"), "_h", *key, "_keep"), ["_label"], [F.col("_h").asc()] + [F.col(k).asc() for k in key], "_r")
    cut = ranked.where(F.col("_r") <= F.col("_keep")).groupBy("_label").agg(F.max(row).alias("_cut")).select(F.col("_label").alias("_cut_label"), "_cut")
    edge = edge.join(cut, F.col("_label").eqNullSafe(F.col("_cut_label")), "left").drop("_cut_label").checkpoint(eager=True)
    placed = hashed.join(F.broadcast(edge), same, "left")
    is_train = (F.col("_edge").isNull() | (F.col("_range") < F.col("_edge"))
                | ((F.col("_range") == F.col("_edge")) & F.coalesce(row <= F.col("_cut"), F.lit(False))))
    return placed.where(is_train).select(df.columns), placed.where(~is_train).select(df.columns)


# ---------------------------------------------------------------- models

def drawn_apart(rows: DataFrame, pieces: int, weight: str = "row_weight") -> DataFrame:
    """Each compacted row as up to ``pieces`` rows of equal weight, whose weights add up to its own.

    The forest draws each row a Poisson number of times. A profile of at most ``pieces`` rows is drawn as its
    rows would be; of a larger one of weight w the drawn weight has mean w too, and a deviation of
    w / sqrt(pieces) where rows have sqrt(w).
    """
    n = F.greatest(F.lit(1), F.least(F.lit(pieces), F.col(weight).cast("int")))
    kept = [c for c in rows.columns if c != weight]
    return rows.select(*kept, F.explode(F.array_repeat(F.col(weight) / n, n)).alias(weight))


class ForestWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        for k, part in enumerate(self.instance.getOrDefault("parts")):
            RandomForestRegressionModel.load(part).write().overwrite().save(f"{path}/part-{k:05d}")


class ForestReader(DefaultParamsReader):
    def load(self, path: str) -> "Forest":
        own = super().load(path)
        return own._set(parts=[f"{path}/part-{k:05d}" for k in range(len(own.getOrDefault("parts")))])


class Forest(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """A forest in ``parts``, folders of forests of ``trees`` trees each; the prediction is the mean over all trees.

    The driver and a task hold as many parts as may be broadcast: rows take the sum of these in a pass of
    their own, and are saved between passes. So ``transform`` runs jobs.
    """

    parts = Param(Params._dummy(), "parts", "folders of the parts")
    trees = Param(Params._dummy(), "trees", "number of trees of each part")

    def __init__(self, parts: list[str] | None = None, trees: list[int] | None = None, features: str = "features", prediction: str = "ml_risk"):
        super().__init__()
        self._set(featuresCol=features, predictionCol=prediction)
        if parts is not None:
            self._set(parts=list(parts), trees=[int(n) for n in trees])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spark, columns, total = dataset.sparkSession, dataset.columns, sum(self.getOrDefault(self.trees))
        out, passes = dataset.withColumn("_trees_sum", F.lit(0.0)), forest.batches_of(spark, self.getOrDefault(self.parts))
        for k, parts in enumerate(passes):
            added = F.col("_trees_sum") + forest.sum_of_trees(spark, parts, self.getFeaturesCol())
            out = out.select(*columns, added.alias("_trees_sum"))
            if k + 1 < len(passes):
                out = saved(out)
        return out.select(*columns, (F.col("_trees_sum") / total).alias(self.getPredictionCol()))

    @property
    def featureImportances(self) -> np.ndarray:
        """Mean over the trees of each tree's importances, which add up to 1."""
        return forest.importances(SparkSession.active(), self.getOrDefault(self.parts))

    def write(self) -> ForestWriter:
        return ForestWriter(self)

    @classmethod
    def read(cls) -> ForestReader:
        return ForestReader(cls)


def fit_regression(train: DataFrame, label: str = "risk_score", trees: int = FOREST_TREES,
                   max_depth: int = FOREST_MAX_DEPTH, pieces: int = 1, nodes: int = FOREST_NODES) -> PipelineModel:
    """Forest on compacted rows; with ``pieces`` (at most so many draws of a profile, see ``drawn_apart``) its
    bootstrap comes to that of the rows, for as many times the rows to fit on.

    Spark's trainer keeps all trees in the driver, and trees grow with the profiles. If they may have more than
    ``nodes`` nodes in all, the trees are grown one by one in tasks (``operators.forest``) and kept in the shared folder
    in parts of about so many nodes (``Forest``). Trees, depth and draws are the same. If the binned profiles are too large to be
    broadcast, Spark's trainer grows the parts, each with a seed of its own, of as many trees as the nodes of the trees before allow.
    """
    rows = compact(train, label)
    stages = preprocessing(rows, scale=False)
    drawn = drawn_apart(rows, pieces)

    def grower(number: int, seed: int) -> RandomForestRegressor:
        return RandomForestRegressor(featuresCol="features", labelCol=label, predictionCol="ml_risk",
                                     weightCol="row_weight", numTrees=number, maxDepth=max_depth,
                                     featureSubsetStrategy="all", seed=seed)

    per_tree = math.ceil(2 * (1 - math.exp(-1)) * drawn.count())  # a bootstrap draws 63 % of the rows, and a leaf holds one at least
    if per_tree * trees <= nodes:
        return Pipeline(stages=stages + [grower(trees, SEED)]).fit(drawn)
    prepared = Pipeline(stages=stages).fit(drawn)
    feats = prepared.transform(drawn).select("features", label, "row_weight")
    groups, bounds = forest.binned(feats, label)
    arrays = forest.grouped(groups, len(bounds))
    if arrays is not None:
        columns = {"featuresCol": "features", "labelCol": label, "predictionCol": "ml_risk", "weightCol": "row_weight"}
        return PipelineModel(stages=prepared.stages + [Forest(*forest.grown(rows.sparkSession, arrays, bounds, trees, max_depth, SEED, nodes, columns))])
    feats = saved(feats)
    folder, parts, sizes = shared_folder(rows.sparkSession, "forest"), [], []
    while sum(sizes) < trees:
        number = min(trees - sum(sizes), max(1, nodes // per_tree))
        part = grower(number, SEED + len(parts)).fit(feats)
        per_tree = max(1, -(-part.totalNumNodes // number))
        parts.append(f"{folder}/part-{len(parts):05d}")
        sizes.append(number)
        part.write().overwrite().save(parts[-1])
        del part
    return PipelineModel(stages=prepared.stages + [Forest(parts, sizes)])


def balanced_weights(df: DataFrame, label: str, count_col: str | None = None) -> DataFrame:
    """weight = n / (k * n_class) (times the row count of a compacted row), from a k-row table."""
    rows = F.col(count_col) if count_col else F.lit(1.0)
    counts = df.groupBy(label).agg(F.sum(rows).alias("_nc"))
    everything = Window.partitionBy()  # over the k-row class table only
    w = counts.select(label, (F.sum("_nc").over(everything)
                              / (F.count(F.lit(1)).over(everything) * F.col("_nc"))).alias("_cw"))
    return df.join(w, label).withColumn("class_weight", F.col("_cw") * rows).drop("_cw")


def fit_classification(train: DataFrame, label: str = "priority_label", max_iter: int = LOGISTIC_MAX_ITER,
                       c: float = LOGISTIC_C) -> PipelineModel:
    """Multinomial logistic regression, balanced class weights, L2 with C mapped to regParam.

    An objective ``C * sum(w * loss) + |b|^2 / 2`` equals Spark's
    ``sum(w * loss) / sum(w) + regParam / 2 * |b|^2`` with regParam = 1 / (C * sum(w));
    balanced weights sum to n.
    """
    weighted = balanced_weights(compact(train, label), label, count_col="row_weight")
    n = weighted.agg(F.sum("row_weight")).first()[0] or 0
    indexer = StringIndexer(inputCol=label, outputCol="label__idx")
    lr = LogisticRegression(featuresCol="features", labelCol="label__idx", weightCol="class_weight",
                            predictionCol="ml_priority__idx", probabilityCol="ml_priority__prob",
                            rawPredictionCol="ml_priority__raw", family="multinomial", maxIter=max_iter,
                            regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False)
    model = Pipeline(stages=preprocessing(weighted, scale=True) + [indexer, lr]).fit(weighted)
    labels = model.stages[-2].labels
    to_text = IndexToString(inputCol="ml_priority__idx", outputCol="ml_priority", labels=labels)
    return PipelineModel(stages=model.stages + [to_text])


#: profiles, by a hash, among which starting centres are chosen; a bound, whatever the data
START_SAMPLE = 4096
KMEANS_MAX_ITER, KMEANS_TOLERANCE = 100, 1e-4


class NearestCentre(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Number of the nearest of ``centres`` (of equally near ones: the first), as column expressions."""

    centres = Param(Params._dummy(), "centres", "cluster centres, a list of lists")

    def __init__(self, centres: list[list[float]] | None = None, features: str = "features", prediction: str = "cluster"):
        super().__init__()
        self._set(featuresCol=features, predictionCol=prediction)
        if centres is not None:
            self._set(centres=[[float(v) for v in c] for c in centres])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        x = vector_to_array(F.col(self.getFeaturesCol()))
        square = lambda c: F.aggregate(F.zip_with(x, F.array(*[F.lit(v) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
        far = F.array(*[square(c) for c in self.getOrDefault(self.centres)])
        return (dataset.withColumn("_far", far)
                .withColumn(self.getPredictionCol(), (F.array_position("_far", F.array_min("_far")) - 1).cast("int")).drop("_far"))


def starting_centres(x: np.ndarray, w: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ among weighted rows: each next centre with a chance in proportion to weight x squared distance."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.choice(len(x), p=w / w.sum()))]
    near = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        p = w * near
        chosen.append(int(rng.choice(len(x), p=p / p.sum())) if p.sum() > 0 else chosen[0])
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def kmeans_runs(feats: DataFrame, starts: list[tuple[int, int]], max_iter: int = KMEANS_MAX_ITER,
                tolerance: float = KMEANS_TOLERANCE) -> list[tuple[float, np.ndarray]]:
    """(cost, centres) of a k-means run for each (k, seed), all in one pass over ``feats`` per iteration.

    feats: x (array of doubles), w. A task assigns its rows to the centres of every run and sends one row
    per run and cluster; sums of a cluster meet as many arrays as there are tasks. The driver
    sees centres only. A run ends when no centre moves farther than ``tolerance``; a
    cluster without rows keeps its centre. Jobs = iterations of the longest run + 2.
    """
    sample = feats.orderBy(F.xxhash64("x"), "x").limit(START_SAMPLE).collect()
    if not sample:
        return [(0.0, np.zeros((0, 0)))] * len(starts)
    x, w = np.array([r["x"] for r in sample]), np.array([r["w"] for r in sample])
    centres = [starting_centres(x, w, k, seed) for k, seed in starts]
    moving = set(range(len(starts)))

    def passed(runs: list[int], costs: bool = False) -> dict[int, list]:
        now = {r: centres[r] for r in runs}

        def run(batches):
            total = {r: [np.zeros(len(c)), np.zeros(c.shape), np.zeros(len(c))] for r, c in now.items()}
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, w = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1), batch.column(1).to_numpy()
                own = (x * x).sum(1)
                for r, c in now.items():
                    far = own[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
                    best = far.argmin(1)
                    held = np.zeros((len(x), len(c)))
                    held[np.arange(len(x)), best] = w
                    total[r][0] += held.sum(0)
                    total[r][1] += held.T @ x
                    if costs:  # of no use to an iteration, and the most of its time
                        total[r][2] += np.bincount(best, w * ((x - c[best]) ** 2).sum(1), len(c))
            rows = [(r, k, n[k], cost[k], sums[k].tolist()) for r, (n, sums, cost) in total.items() for k in range(len(n))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64())])],
                                             names=["run", "k", "n", "cost", "sums"])

        partial = feats.select("x", "w").mapInArrow(run, "run int, k int, n double, cost double, sums array<double>")
        added = lambda arrays: F.reduce(arrays, F.array_repeat(F.lit(0.0), x.shape[1]), lambda a, b: F.zip_with(a, b, lambda p, q: p + q))
        out = partial.groupBy("run", "k").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.collect_list("sums").alias("s")).select(
            "run", "k", "n", "cost", added(F.col("s")).alias("sums")).collect()
        found: dict[int, list] = {}
        for r in out:
            found.setdefault(r["run"], []).append(r)
        return found

    for _ in range(max_iter):
        if not moving:
            break
        for r, rows in passed(sorted(moving)).items():
            new = centres[r].copy()
            for row in rows:
                if row["n"] > 0:
                    new[row["k"]] = np.array(row["sums"]) / row["n"]
            if ((new - centres[r]) ** 2).sum(1).max() <= tolerance ** 2:
                moving.discard(r)
            centres[r] = new
    costs = passed(list(range(len(starts))), costs=True)
    return [(sum(row["cost"] for row in costs[r]), centres[r]) for r in range(len(starts))]


def _prepared(train: DataFrame) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """(fitted preprocessing, features, the same as x and w for ``kmeans_runs``)."""
    rows = compact(train)
    prep = Pipeline(stages=preprocessing(rows, scale=True)).fit(rows)
    feats = prep.transform(rows).select("features", "row_weight")
    return prep, feats, feats.select(vector_to_array("features").alias("x"), F.col("row_weight").cast("double").alias("w")).checkpoint(eager=True)


def fit_clustering(train: DataFrame, k: int = CLUSTERS, restarts: int = CLUSTER_RESTARTS) -> PipelineModel:
    """k-means on scaled features; ``restarts`` seeds, lowest training cost kept."""
    prep, _, arrays = _prepared(train)
    runs = kmeans_runs(arrays, [(k, SEED + i) for i in range(restarts)])
    return PipelineModel(stages=[prep, NearestCentre(min(runs, key=lambda r: r[0])[1].tolist())])


def total_sum_of_squares(feats: DataFrame, weight: str = "row_weight") -> float:
    """Weighted sum of squared distances of the feature vectors from their mean (k-means with k = 1)."""
    mean = feats.select(Summarizer.mean(F.col("features"), F.col(weight)).alias("m")).first().m
    if mean is None:
        return 0.0
    mu = F.array(*[F.lit(float(v)) for v in mean.toArray()])
    sq = F.aggregate(F.zip_with(vector_to_array(F.col("features")), mu, lambda a, b: (a - b) * (a - b)),
                     F.lit(0.0), lambda acc, x: acc + x)
    return feats.agg(F.sum(F.col(weight) * sq)).first()[0] or 0.0


def elbow(train: DataFrame, max_k: int = ELBOW_MAX_K, restarts: int = CLUSTER_RESTARTS) -> DataFrame:
    """(k, wcss) for k = 1..max_k, the best of ``restarts`` starts each; k = 1 is the total
    sum of squares from an aggregate. All starts of all k share their passes."""
    _, feats, arrays = _prepared(train)
    starts = [(k, SEED + i) for k in range(2, max_k + 1) for i in range(restarts)]
    runs = kmeans_runs(arrays, starts)
    rows = [(1, float(total_sum_of_squares(feats)))]
    for k in range(2, max_k + 1):
        rows.append((k, min(float(cost) for (own, _), (cost, _) in zip(starts, runs) if own == k)))
    return train.sparkSession.createDataFrame(rows, "k int, wcss double")


# ---------------------------------------------------------------- metrics

def regression_metrics(pred: DataFrame, label: str, prediction: str, weight: str | None = None) -> DataFrame:
    """MAE, RMSE, R^2 as one aggregate (long table); with ``weight``, over compacted
    rows each standing for ``weight`` identical rows (same values)."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    if weight is None:
        a = pred.agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"),
                     F.sum(F.abs(y - p)).alias("sae"), F.sum((y - p) * (y - p)).alias("sse"))
    else:
        w = F.col(weight).cast("double")
        a = pred.agg(F.sum(w).alias("n"), F.sum(w * y).alias("sy"), F.sum(w * y * y).alias("syy"),
                     F.sum(w * F.abs(y - p)).alias("sae"), F.sum(w * (y - p) * (y - p)).alias("sse"))
    out = a.select(
        (F.col("sae") / F.col("n")).alias("mae"),
        F.sqrt(F.col("sse") / F.col("n")).alias("rmse"),
        (F.lit(1.0) - F.col("sse") / (F.col("syy") - F.col("sy") * F.col("sy") / F.col("n"))).alias("r2"))
    return out.selectExpr("stack(3, 'mae', round(mae, 6), 'rmse', round(rmse, 6), 'r2', round(r2, 6)) as (metric, value)")


def classification_metrics(pred: DataFrame, label: str, prediction: str, weight: str | None = None) -> DataFrame:
    """Accuracy and support-weighted F1 from the confusion counts (k x k rows);
    with ``weight``, counts are sums of the compacted rows' weights."""
    n = F.count(F.lit(1)) if weight is None else F.sum(F.col(weight))
    conf = pred.groupBy(F.col(label).alias("t"), F.col(prediction).alias("p")).agg(n.alias("n"))
    true_n = conf.groupBy(F.col("t").alias("c")).agg(F.sum("n").alias("support"))
    pred_n = conf.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("predicted"))
    tp = conf.where(F.col("t") == F.col("p")).select(F.col("t").alias("c"), F.col("n").alias("tp"))
    per = (true_n.join(pred_n, "c", "left").join(tp, "c", "left")
           .fillna(0, subset=["predicted", "tp"])
           .withColumn("f1", F.when(F.col("support") + F.col("predicted") > 0,
                                    2.0 * F.col("tp") / (F.col("support") + F.col("predicted"))).otherwise(0.0)))
    out = per.agg((F.sum("tp") / F.sum("support")).alias("accuracy"),
                  (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))
    return out.selectExpr("stack(2, 'accuracy', round(accuracy, 6), 'weighted_f1', round(weighted_f1, 6)) as (metric, value)")


def cluster_profile(pred: DataFrame, score: str = "risk_score", weight: str | None = None) -> DataFrame:
    """Rows and mean score per cluster; with ``weight``, over compacted rows (each
    standing for ``weight`` identical rows), which gives the same sizes and means."""
    if weight is None:
        return pred.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"),
                                           F.round(F.avg(score), 2).alias("mean_risk"))
    w = F.col(weight)
    return pred.groupBy("cluster").agg(F.sum(w).cast("bigint").alias("size"),
                                       F.round(F.sum(w * F.col(score)) / F.sum(w), 2).alias("mean_risk"))


def cluster_scatter(pred: DataFrame, score: str = "risk_score", weight: str | None = None) -> DataFrame:
    """Chart data: rows per (rounded CVSS, rounded risk, cluster)."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight).cast("bigint")
    return pred.groupBy(F.round("cvss_score").alias("cvss_bin"), F.round(score).alias("risk_bin"), "cluster").agg(n.alias("rows"))


def feature_importance(model: PipelineModel, frame: DataFrame, top: int = 10) -> DataFrame:
    """Top forest feature importances with names from the assembled vector's metadata.
    Model-sized data (one row per feature), not data-sized."""
    feats = PipelineModel(stages=model.stages[:-1]).transform(frame.limit(1)).schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for group in feats.values() for a in group}
    imp = model.stages[-1].featureImportances
    rows = [(names.get(i, str(i)), float(imp[i])) for i in range(len(imp))]
    spark = frame.sparkSession
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)


# ---------------------------------------------------------------- inference and artefacts

@dataclass
class Models:
    regression: PipelineModel
    classification: PipelineModel
    clustering: PipelineModel

    NAMES = ("regression", "classification", "clustering")

    def save(self, folder: str) -> None:
        for name in self.NAMES:
            getattr(self, name).write().overwrite().save(f"{folder.rstrip('/')}/{name}")

    @classmethod
    def load(cls, folder: str) -> "Models":
        return cls(*[PipelineModel.load(f"{folder.rstrip('/')}/{name}") for name in cls.NAMES])

    @classmethod
    def missing(cls, folder: str) -> list[str]:
        """Names of model artefacts that cannot be loaded from ``folder``."""
        out = []
        for name in cls.NAMES:
            try:
                PipelineModel.load(f"{folder.rstrip('/')}/{name}")
            except Exception:  # noqa: BLE001 - any load failure means the artefact is unusable
                out.append(name)
        return out


def fit_all(frame: DataFrame) -> Models:
    """The three independent fits as concurrent Spark jobs (driver threads submit)."""
    with ThreadPoolExecutor(max_workers=3) as pool:
        fits = [pool.submit(fit, frame) for fit in (fit_regression, fit_classification, fit_clustering)]
        return Models(*[f.result() for f in fits])


def train_models(labelled: DataFrame) -> Models:
    return fit_all(training_set(labelled))


@dataclass
class Evaluated:
    """Models and their metrics on rows that they were not fitted on."""

    models: Models
    regression: DataFrame
    classification: DataFrame
    everything: DataFrame  # compacted, with row_weight


def evaluated_models(frame: DataFrame) -> Evaluated:
    """Regression fitted on the hash split, classification on the stratified one, clusters on all rows;
    metrics are those of each split's other side.

    frame: row key, model inputs and labels. Metrics of compacted rows (inputs + labels, with
    counts) are those of the rows.
    """
    frame = saved(frame)
    train, test = (saved(compact(part, LABELS)) for part in hash_split(frame))
    c_train, c_test = (saved(compact(part, LABELS)) for part in stratified_split(frame, "priority_label", stored=True))
    everything = saved(compact(frame, LABELS))
    with ThreadPoolExecutor(max_workers=3) as pool:  # independent Spark jobs
        fits = [pool.submit(fit, rows) for fit, rows in ((fit_regression, train), (fit_classification, c_train), (fit_clustering, everything))]
        models = Models(*[f.result() for f in fits])
    return Evaluated(models, regression_metrics(models.regression.transform(test), "risk_score", "ml_risk", "row_weight"),
                     classification_metrics(models.classification.transform(c_test), "priority_label", "ml_priority", "row_weight"), everything)


MODEL_INPUTS = CATEGORICAL + NUMERIC


def predict(models: Models, scored: DataFrame) -> DataFrame:
    """Adds ml_risk, ml_priority and cluster to policy-scored rows.

    The three models see only the model inputs, which take as many distinct
    values as there are CVE profiles. So inference runs once per distinct input
    profile (a partially aggregated distinct), and the predictions join back to
    the rows null-safe on the inputs, broadcast only under the measured size bound.
    """
    frame = model_frame(scored)
    inputs = list(MODEL_INPUTS)
    profiles = frame.select(*inputs).distinct()
    out = models.regression.transform(profiles).select(*inputs, "ml_risk")
    out = models.classification.transform(out).select(*inputs, "ml_risk", "ml_priority")
    out = models.clustering.transform(out).select(*inputs, "ml_risk", "ml_priority", F.col("cluster").cast("int"))
    dim = out.select(*[F.col(c).alias(f"_p_{c}") for c in inputs], "ml_risk", "ml_priority", "cluster")
    same = reduce(lambda a, b: a & b, [frame[c].eqNullSafe(dim[f"_p_{c}"]) for c in inputs])
    return join_dimension(frame, dim, same, "left").select(*scored.columns, "ml_risk", "ml_priority", "cluster")


def stage_metric(summary: DataFrame, stage: str, metric: str) -> DataFrame:
    """Look up one metric of a stage in a long summary: run_id, value (no row if absent)."""
    return summary.where((F.col("stage") == stage) & (F.col("metric") == metric)).select("run_id", "value")


def run_status(summary: DataFrame, stages: list[str]) -> DataFrame:
    """Per expected stage (run_id, stage, status): complete if it has metrics, else missing."""
    runs = summary.select("run_id").distinct().withColumn("stage", F.explode(F.array(*[F.lit(s) for s in stages])))
    have = summary.groupBy("run_id", "stage").agg(F.count("*").alias("metrics"))
    return runs.join(have, ["run_id", "stage"], "left").select(
        "run_id", "stage", F.when(F.coalesce("metrics", F.lit(0)) > 0, "complete").otherwise("missing").alias("status"))


def run_summary(run_id: str, stages: dict[str, DataFrame]) -> DataFrame:
    """Long table (run_id, stage, metric, value) from per-stage metric tables."""
    out = None
    for stage, metrics in stages.items():
        part = metrics.select(F.lit(run_id).alias("run_id"), F.lit(stage).alias("stage"), "metric",
                              F.col("value").cast("double").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out

