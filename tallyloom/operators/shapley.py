"""Shapley values of tree models: what each feature adds to a prediction, exact for the path-dependent expectation.

For a leaf, only the features on its path matter. A feature that the row agrees with keeps the leaf's value, one left out
keeps the share of the training rows that went that way. Both are known for all 2^m agreements of m features, so a table
for each leaf holds their Shapley values, and a row looks its agreements up. Leaves on longer paths make the same
sums for the agreements that occur among the rows of a batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import shared_dir, stored
from .ranks import quantiles
from .vectors import matrix

#: Features on a path up to which a leaf has a table of all agreements.
TABLE = 8
#: Leaves whose tables are made at a time, and rows that are looked up at a time.
LEAVES, ROWS = 512, 8192


@dataclass
class Leaf:
    """The features on the way to a leaf, the interval (low, high] of each, the share of training rows that kept to it, and the weighted value."""

    features: list[int]
    low: list[float]
    high: list[float]
    share: list[float]
    value: float


def leaves(spark: SparkSession, model) -> list[Leaf]:
    """The leaves of all trees of a regression model of pyspark.ml on continuous features, read from its saved form."""
    path = f"{shared_dir(spark)}/tallyloom/model-{uuid.uuid4().hex}"
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data")
    rows = rows if "treeID" in rows.columns else rows.select(F.lit(0).alias("treeID"), F.struct("*").alias("nodeData"))
    trees: dict[int, dict[int, tuple]] = {}
    for r in rows.select("treeID", "nodeData.*").collect():  # as many rows as the model has nodes
        if r.split.numCategories >= 0 and r.leftChild >= 0:
            raise ValueError("categorical splits have no interval")
        trees.setdefault(r.treeID, {})[r.id] = (r.prediction, r.rawCount, r.leftChild, r.rightChild, r.split.featureIndex, (r.split.leftCategoriesOrThreshold or [0.0])[0])
    weights = list(getattr(model, "treeWeights", [1.0]))
    if len(weights) > 1 and "Forest" in type(model).__name__:
        weights = [w / sum(weights) for w in weights]
    out = []
    for t, nodes in sorted(trees.items()):
        stack = [(0, {})]
        while stack:
            at, way = stack.pop()
            value, count, left, right, feature, cut = nodes[at]
            if left < 0:
                way = sorted(way.items())
                out.append(Leaf([f for f, _ in way], [x[0] for _, x in way], [x[1] for _, x in way], [x[2] for _, x in way], value * weights[t]))
                continue
            low, high, share = way.get(feature, (-np.inf, np.inf, 1.0))
            stack.append((left, way | {feature: (low, min(high, cut), share * nodes[left][1] / count)}))
            stack.append((right, way | {feature: (max(low, cut), high, share * nodes[right][1] / count)}))
    return out


def values(share: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Shapley values (leaf, agreement, feature) of leaves worth 1; share: (leaf, feature), kept: (agreement, feature), 0 or 1.

    Subsets of the other features are counted by size: the product of (share + kept * t) over them has the sum over
    subsets of size s as its coefficient of t^s.
    """
    m = share.shape[1]
    out = np.zeros((len(share), len(kept), m))
    weight = [factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)]
    z, o = share[:, None, :], kept[None].astype(float)
    for j in range(m):
        poly = np.zeros((len(share), len(kept), m))
        poly[..., 0] = 1.0
        for size, i in enumerate(x for x in range(m) if x != j):
            for s in range(size + 1, 0, -1):
                poly[..., s] = poly[..., s] * z[..., i] + poly[..., s - 1] * o[..., i]
            poly[..., 0] = poly[..., 0] * z[..., i]
        out[..., j] = (o[..., j] - z[..., j]) * (poly @ np.array(weight))
    return out


def base_value(model_leaves: list[Leaf]) -> float:
    """The expectation over the training rows."""
    return float(sum(leaf.value * np.prod(leaf.share) for leaf in model_leaves))


def _tables(model_leaves: list[Leaf]) -> list[np.ndarray | None]:
    """(agreement, feature) values of each leaf; None for those on long paths."""
    out: list[np.ndarray | None] = [None] * len(model_leaves)
    for m in range(1, TABLE + 1):
        at = [i for i, leaf in enumerate(model_leaves) if len(leaf.features) == m]
        kept = (np.arange(1 << m)[:, None] >> np.arange(m)) & 1
        for lo in range(0, len(at), LEAVES):
            part = at[lo : lo + LEAVES]
            v = values(np.array([model_leaves[i].share for i in part]), kept) * np.array([model_leaves[i].value for i in part])[:, None, None]
            for i, table in zip(part, v):
                out[i] = table
    return out


def contributions(model_leaves: list[Leaf], tables: list[np.ndarray | None], x: np.ndarray) -> np.ndarray:
    """(row, feature): what each feature adds to the prediction of each row of x."""
    out = np.zeros(x.shape)
    for leaf, table in zip(model_leaves, tables):
        if not leaf.features:
            continue
        part = x[:, leaf.features]
        # a value that is not a number goes right, as in the trees: beyond every cut
        part = np.where(np.isnan(part), np.inf, part)
        kept = (part > leaf.low) & ((part <= leaf.high) | np.isposinf(leaf.high))
        if table is not None:
            out[:, leaf.features] += table[kept @ (1 << np.arange(len(leaf.features)))]
        else:
            met, back = np.unique(kept, axis=0, return_inverse=True)
            out[:, leaf.features] += (values(np.array([leaf.share]), met)[0] * leaf.value)[back.ravel()]
    return out


def explained(rows: DataFrame, model, columns: list[str]) -> DataFrame:
    """rows with `contributions`, an array of doubles in the order of columns, and `base`: they add up to the prediction.

    columns are numbers, in the order in which the model has its features; null counts as not a number.
    """
    spark = rows.sparkSession
    known = leaves(spark, model)
    base = base_value(known)
    free = next(n for n in ("x", *(f"x{i}" for i in range(len(rows.columns) + 1))) if n not in rows.columns)
    nan = F.lit(float("nan"))
    with_x = rows.withColumn(free, F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), nan) for c in columns]))
    kinds = T.StructType([*rows.schema.fields, T.StructField("contributions", T.ArrayType(T.DoubleType())), T.StructField("base", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None
        for b in batches:
            tables = tables or _tables(known)
            for lo in range(0, b.num_rows, ROWS):
                t = b.slice(lo, ROWS)
                phi = contributions(known, tables, matrix(pa.chunked_array([t.column(t.num_columns - 1)])))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(phi) + 1, dtype=np.int32) * len(columns)), pa.array(phi.ravel()))
                yield pa.RecordBatch.from_arrays([*t.columns[:-1], lists, pa.array(np.full(len(phi), base))], names=kinds.names)

    return with_x.mapInArrow(run, kinds)


def sampled(rows: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows, the first by a hash of their keys: the same ones however the table is partitioned."""
    return rows.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)


def mean_contributions(told: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean_abs) of explained rows."""
    each = told.select(F.posexplode("contributions").alias("i", "phi")).groupBy("i").agg(F.round(F.avg(F.abs("phi")), 6).alias("mean_abs"))
    return each.select(F.element_at(F.array(*map(F.lit, columns)), F.col("i") + 1).alias("feature"), "mean_abs")


def feature_effect(told: DataFrame, columns: list[str], feature: str) -> DataFrame:
    """(mean_abs, positive, low, high): a feature's mean contribution, how often it is positive, and its mean where the feature is under its 33rd and over its 66th percentile."""
    phi = F.get("contributions", F.lit(columns.index(feature)))
    rows = stored(told.select(F.col(f"`{feature}`").alias("v"), phi.alias("phi")), "contributions")  # read twice, explained once
    cut = quantiles(rows, [], "v", [0.33, 0.66]).select(F.get("quantiles", F.lit(0)).alias("a"), F.get("quantiles", F.lit(1)).alias("b"))
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return rows.join(F.broadcast(cut), F.lit(True), "left").agg(mean(F.abs("phi"), "mean_abs"), mean((F.col("phi") > 0).cast("double"), "positive"), mean(F.when(F.col("v") < F.col("a"), F.abs("phi")), "low"), mean(F.when(F.col("v") > F.col("b"), F.abs("phi")), "high"))
