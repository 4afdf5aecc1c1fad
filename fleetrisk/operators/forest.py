"""Regression trees on binned rows, each grown whole by one task in numpy.

Spark's own trainer sends every row to every tree at every level and keeps all trees in the driver. A tree
only sees the bins of a row's inputs, so rows of equal bins, label and weight are one *group* with a count, groups of
equal bins are one *cell*, and a tree grows on the drawn sums of its cells. Groups are broadcast (below a measured
size, see ``grouped``), trees are rows that tasks take one by one, and the nodes are written by the tasks in the
format of Spark's own forests. Bins, bootstrap (a Poisson number of draws a row), criterion (variance), depth and
stopping are those of Spark's trainer with all inputs tried at every node.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetrisk.operators import joins
from fleetrisk.session import shared_folder, ship_package

# fixed values: as Spark's trainer has them
BINS = 32
BIN_SAMPLE = 10_000  # rows that bounds of bins are chosen from
EPSILON = 1e-12  # share of a node's mean square below which a variance or a gain is rounding
#: of an array of nodes that tasks predict with at once: input, bound or prediction, two children
NODE_BYTES = 2 + 8 + 4 + 4

NODES = ("treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,"
         "leftChild:int,rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>")


def bounds_of(values: np.ndarray, weights: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Bounds between bins of about equal weight, midway between neighbouring values; all of them if there are few."""
    found, at = np.unique(values, return_inverse=True)
    middle = (found[:-1] + found[1:]) / 2
    if len(middle) < bins:
        return middle
    upto = np.cumsum(np.bincount(at, weights))
    stride = upto[-1] / bins
    out, target = [], stride
    for k in range(1, len(found)):
        if abs(upto[k - 1] - target) < abs(upto[k] - target):
            out.append(middle[k - 1])
            target += stride
    return np.array(out)


def binary_inputs(feats: DataFrame) -> set[int]:
    """Numbers of the inputs that the assembled vector's metadata names as one-hot."""
    return {a["idx"] for a in feats.schema["features"].metadata.get("ml_attr", {}).get("attrs", {}).get("binary", [])}


def binned(feats: DataFrame, label: str, weight: str = "row_weight") -> tuple[DataFrame, list[np.ndarray | None]]:
    """(codes, y, w, n): rows by the bins of their inputs (a byte each), label and weight, saved; and each input's
    bounds, None for a one-hot input, whose bin is its value."""
    one_hot = binary_inputs(feats)
    rows = feats.select(vector_to_array("features").alias("x"), F.col(label).cast("double").alias("y"), F.col(weight).cast("double").alias("w"))
    sample = rows.orderBy(F.xxhash64("x", "y", "w"), "x", "y", "w").limit(BIN_SAMPLE).select("x", "w").collect()
    x, w = np.array([r["x"] for r in sample]), np.array([r["w"] for r in sample])
    bounds = [None if f in one_hot else bounds_of(x[:, f], w) for f in range(x.shape[1])]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if batch.column(1).null_count or batch.column(2).null_count:
                raise ValueError("a training row has no label or weight")
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            codes = np.empty(x.shape, np.uint8)
            for f, own in enumerate(bounds):
                codes[:, f] = x[:, f] if own is None else np.searchsorted(own, x[:, f])
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1), batch.column(2)], names=["codes", "y", "w"])

    coded = rows.mapInArrow(code, "codes binary, y double, w double")
    return joins.saved(coded.groupBy("codes", "y", "w").agg(F.count(F.lit(1)).alias("n"))), bounds


def grouped(groups: DataFrame, inputs: int, max_bytes: int | None = None) -> tuple | None:
    """(cells, cell of each group, y, w, n) as arrays, in an order of their own; None beyond ``max_bytes``, the bound of broadcasts."""
    if groups.count() * (inputs + 28) > (joins.BROADCAST_BYTES if max_bytes is None else max_bytes):
        return None
    table = groups.toArrow()
    codes = np.frombuffer(b"".join(table["codes"].to_pylist()), np.uint8).reshape(-1, inputs)
    y, w, n = (table[c].to_numpy() for c in ("y", "w", "n"))
    order = np.lexsort((w, y, *codes.T[::-1]))
    codes, y, w, n = codes[order], y[order], w[order], n[order]
    new = np.r_[True, (codes[1:] != codes[:-1]).any(1)]
    return codes[new], np.cumsum(new).astype(np.int32) - 1, y, w, n


def grow(cells: np.ndarray, cell: np.ndarray, y: np.ndarray, w: np.ndarray, draws: np.ndarray, bins: list[int], max_depth: int) -> dict[str, np.ndarray]:
    """One tree on groups drawn ``draws`` times each, level by level: nodes in an order in which children come after their parent.

    bins: of each input, 0 for a one-hot one. Of a node: feature (-1: leaf), at (a row goes left up to this bin; of a one-hot
    input the left value), left, right, w, wy, wyy, raw (draws), gain.
    """
    sums = [np.bincount(cell, v, len(cells)) for v in (draws * w, draws * w * y, draws * w * y * y, draws)]
    held = sums[3] > 0
    codes, sums = cells[held], [s[held] for s in sums]
    used = [f for f in range(cells.shape[1]) if len(codes) and codes[:, f].min() != codes[:, f].max()]
    node, first, count, out = np.zeros(len(codes), np.int64), 0, 1, []
    for depth in range(max_depth + 1):
        tw, ty, tyy, raw = (np.bincount(node, s, count) for s in sums)
        with np.errstate(divide="ignore", invalid="ignore"):
            mean, square = ty / tw, tyy / tw
            best = np.where(square - mean * mean > EPSILON * square, EPSILON * square, np.inf)  # gains have to exceed it
            gain, feature, at = np.full(count, -1.0), np.full(count, -1, np.int32), np.zeros(count, np.int64)
            for f in used if depth < max_depth and len(node) else ():
                if bins[f]:
                    place = node * bins[f] + codes[:, f]
                    lw, ly = (np.bincount(place, s, count * bins[f]).reshape(count, -1).cumsum(1)[:, :-1] for s in sums[:2])
                    full = np.bincount(place, minlength=count * bins[f]).reshape(count, -1).cumsum(1)
                    some = (full[:, :-1] > 0) & (full[:, :-1] < full[:, -1:])
                else:
                    one = codes[:, f] == 1
                    lw, ly = (t[:, None] - np.bincount(node[one], s[one], count)[:, None] for t, s in ((tw, sums[0]), (ty, sums[1])))
                    ones = np.bincount(node[one], minlength=count)
                    some = ((ones > 0) & (ones < np.bincount(node, minlength=count)))[:, None]
                rw, ry = tw[:, None] - lw, ty[:, None] - ly
                got = np.where(some, (ly * ly / lw + ry * ry / rw - (ty * mean)[:, None]) / tw[:, None], -np.inf)
                top = got.argmax(1)
                own = got[np.arange(count), top]
                better = own > best
                best[better], gain[better], feature[better] = own[better], own[better], f
                at[better] = top[better] if bins[f] else (ly / lw > ry / rw)[better, 0]
        split = feature >= 0
        left = np.where(split, first + count + 2 * (np.cumsum(split) - 1), -1)
        out.append({"feature": feature, "at": at, "left": left, "right": np.where(split, left + 1, -1), "w": tw, "wy": ty, "wyy": tyy, "raw": raw, "gain": gain})
        if not split.any():
            break
        on = split[node]
        codes, node, sums = codes[on], node[on], [s[on] for s in sums]
        code, one_hot = codes[np.arange(len(node)), feature[node]], np.array([not b for b in bins])[feature[node]]
        right = np.where(one_hot, code != at[node], code > at[node])
        node = left[node] - first - count + right
        first, count = first + count, 2 * int(split.sum())
    return {k: np.concatenate([level[k] for level in out]) for k in out[0]}


def node_rows(tree: dict[str, np.ndarray], number: int, part: int, bounds: list[np.ndarray | None]) -> pa.RecordBatch:
    """The nodes of a tree as Spark's forests save them, and their part."""
    size, leaf, one_hot = len(tree["feature"]), tree["feature"] < 0, np.array([b is None for b in bounds])[tree["feature"]]
    value = np.array([a if h or f < 0 else bounds[f][a] for f, a, h in zip(tree["feature"].tolist(), tree["at"].tolist(), one_hot.tolist())], float)
    offsets = np.r_[0, np.cumsum(~leaf)].astype(np.int32)
    w, wy, wyy = tree["w"], tree["wy"], tree["wyy"]
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(w > 0, wy / w, 0.0)
        impurity = np.where(w > 0, np.maximum(wyy / w - mean * mean, 0.0), 0.0)
    split = pa.StructArray.from_arrays([pa.array(tree["feature"], pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(value[~leaf])),
                                        pa.array(np.where(leaf | ~one_hot, -1, 2), pa.int32())], names=["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    stats = pa.ListArray.from_arrays(np.arange(size + 1, dtype=np.int32) * 3, pa.array(np.stack([w, wy, wyy], 1).ravel()))
    data = pa.StructArray.from_arrays(
        [pa.array(np.arange(size), pa.int32()), pa.array(mean), pa.array(impurity), stats, pa.array(tree["raw"].astype(np.int64)), pa.array(tree["gain"]),
         pa.array(tree["left"], pa.int32()), pa.array(tree["right"], pa.int32()), split],
        names=["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, number), pa.int32()), data, pa.array(np.full(size, part), pa.int32())], names=["treeID", "nodeData", "part"])


def grown(spark: SparkSession, groups: tuple, bounds: list[np.ndarray | None], trees: int, max_depth: int, seed: int, nodes: int,
          columns: dict[str, str]) -> tuple[list[str], list[int]]:
    """Folders of forests in Spark's format, of about ``nodes`` nodes each, and their numbers of trees.

    A task grows and writes one tree after the other. columns: the forests' featuresCol, labelCol, predictionCol, weightCol."""
    ship_package(spark)
    cells = groups[0]
    per_part = max(1, int(nodes // max(1, 2 * min(len(cells), int(np.ceil((1 - np.exp(-1)) * groups[4].sum()))))))
    sizes = [min(per_part, trees - k) for k in range(0, trees, per_part)]
    shared = spark.sparkContext.broadcast(groups)
    bins = [0 if b is None else len(b) + 1 for b in bounds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                *groups, n = shared.value
                tree = grow(*groups, np.random.default_rng((seed, t)).poisson(n), bins, max_depth)
                yield node_rows(tree, t % per_part, t // per_part, bounds)

    tasks = min(trees, 4 * spark.sparkContext.defaultParallelism)
    top = shared_folder(spark, "forest")
    spark.range(0, trees, 1, tasks).mapInArrow(run, NODES + ", part int").write.partitionBy("part").parquet(f"{top}/grown")
    shared.destroy()
    parts = [f"{top}/part-{k:05d}" for k in range(len(sizes))]
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(top).getFileSystem(spark._jsc.hadoopConfiguration())
    entry = lambda kind, name, params: {"class": f"org.apache.spark.ml.regression.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version,
                                        "uid": f"{name}_{uuid.uuid4().hex[:12]}", "paramMap": params | {"impurity": "variance", "maxDepth": max_depth, "seed": seed}, "defaultParamMap": {}}
    for k, (part, size) in enumerate(zip(parts, sizes)):
        fs.mkdirs(path(part))
        if not fs.rename(path(f"{top}/grown/part={k}"), path(f"{part}/data")):
            raise OSError(f"{part}/data can't be written")
        about = entry("RandomForestRegressionModel", "rfr", columns | {"featureSubsetStrategy": "all", "numTrees": size}) | {"numFeatures": cells.shape[1], "numTrees": size}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{part}/metadata")
        own = [(i, json.dumps(entry("DecisionTreeRegressionModel", "dtr", columns)), 1.0) for i in range(size)]
        spark.createDataFrame(own, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{part}/treesMetadata")
    return parts, sizes


# ---------------------------------------------------------------- saved forests

def nodes_of(spark: SparkSession, parts: list[str]) -> DataFrame:
    """(part, treeID, nodeData): the nodes of the forests in ``parts``."""
    frames = [spark.read.schema(NODES).parquet(f"{p}/data").withColumn("part", F.lit(k)) for k, p in enumerate(parts)]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def inputs_of(spark: SparkSession, part: str) -> int:
    return json.loads(spark.read.text(f"{part}/metadata").first()[0])["numFeatures"]


def importances(spark: SparkSession, parts: list[str]) -> np.ndarray:
    """Mean over the trees of each tree's importances: gains times weights of an input's nodes, of the tree's sum."""
    d = F.col("nodeData")
    each = nodes_of(spark, parts).where(d["leftChild"] >= 0).groupBy("part", "treeID", d["split"]["featureIndex"].alias("f")).agg(
        F.sum(d["gain"] * d["impurityStats"][0]).alias("g")).orderBy("part", "treeID", "f").collect()
    total: dict[tuple, float] = {}
    for r in each:
        total[r["part"], r["treeID"]] = total.get((r["part"], r["treeID"]), 0.0) + r["g"]
    out = np.zeros(inputs_of(spark, parts[0]))
    for r in each:
        out[r["f"]] += r["g"] / (total[r["part"], r["treeID"]] or 1.0)
    return out / (out.sum() or 1.0)


def loaded(spark: SparkSession, parts: list[str]) -> list[tuple[np.ndarray, ...]]:
    """(input or -1, bound or prediction, left, right) of the nodes of each tree; a row goes left up to the bound."""
    d = F.col("nodeData")
    split = d["split"]
    mirrored = (split["numCategories"] == 2) & (split["leftCategoriesOrThreshold"][0] == 1.0)  # the left value is 1
    bound = F.when(split["numCategories"] == 2, 0.5).otherwise(split["leftCategoriesOrThreshold"][0])
    table = nodes_of(spark, parts).select(
        "part", "treeID", d["id"].alias("id"), split["featureIndex"].cast("smallint").alias("f"), F.when(d["leftChild"] >= 0, bound).otherwise(d["prediction"]).alias("v"),
        F.when(mirrored, d["rightChild"]).otherwise(d["leftChild"]).alias("l"), F.when(mirrored, d["leftChild"]).otherwise(d["rightChild"]).alias("r")).toArrow()
    part, tree, at, *rest = (table[c].to_numpy() for c in ("part", "treeID", "id", "f", "v", "l", "r"))
    order = np.lexsort((at, tree, part))
    cuts = np.flatnonzero((np.diff(part[order]) != 0) | (np.diff(tree[order]) != 0)) + 1
    return [tuple(own) for own in zip(*[np.split(a[order], cuts) for a in rest])]


def predicted(x: np.ndarray, trees: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """Sum over the trees of their predictions for the rows of ``x``."""
    out = np.zeros(len(x))
    for feature, value, left, right in trees:
        at, moving = np.zeros(len(x), np.int64), np.arange(len(x)) if len(feature) and left[0] >= 0 else np.arange(0)
        while len(moving):
            here = at[moving]
            here = np.where(x[moving, feature[here]] <= value[here], left[here], right[here])
            at[moving] = here
            moving = moving[left[here] >= 0]
        out += value[at]
    return out


def batches_of(spark: SparkSession, parts: list[str], max_bytes: int | None = None) -> list[list[str]]:
    """Neighbouring parts whose nodes can be broadcast together."""
    sizes = {r["part"]: r["n"] * NODE_BYTES for r in nodes_of(spark, parts).groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    bound, out, held = joins.BROADCAST_BYTES if max_bytes is None else max_bytes, [], 0
    for k, part in enumerate(parts):
        if not out or held + sizes[k] > bound:
            out.append([])
            held = 0
        out[-1].append(part)
        held += sizes[k]
    return out


def sum_of_trees(spark: SparkSession, parts: list[str], features: str):
    """Column: the sum of the predictions of all trees in ``parts``."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast(loaded(spark, parts))

    @F.pandas_udf("double")
    def summed(x):
        import pandas as pd
        return pd.Series(predicted(np.stack(x.to_numpy()), shared.value) if len(x) else np.zeros(0))

    return summed(vector_to_array(F.col(features)))
