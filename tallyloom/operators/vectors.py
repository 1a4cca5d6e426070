"""Vectors: neighbours, weighted leader vectors, centroids."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Vectors of a block of corpus or queries that meet in one task.
BLOCK = 4096
#: Of one where all meet all and the task goes through its corpus part by part; and blocks up to which these grow with the table.
WIDEST, FEW = 32768, 6
#: Queries whose neighbours are sorted at a time.
STRIP = 64
#: Places of a similarity.
PLACES = 6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / F.when(n > 0, n).otherwise(1.0)).otherwise(0.0)


def rounded(x: np.ndarray) -> np.ndarray:
    """x to PLACES, half-way cases as Spark's round has them: away from 0 by the shortest decimal."""
    scaled = x * 10.0**PLACES
    out = np.round(scaled) / 10.0**PLACES
    half = np.flatnonzero(np.abs(np.abs(scaled - np.trunc(scaled)) - 0.5) < 1e-6)
    if len(half):
        some, back = np.unique(x[half], return_inverse=True)
        out[half] = np.array([float(Decimal(repr(v)).quantize(Decimal(1).scaleb(-PLACES), ROUND_HALF_UP)) for v in some.tolist()])[back]
    return out + 0.0  # no negative zero


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column of lists of one length, as rows of doubles."""
    one = column.combine_chunks()
    return one.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(one), -1)


def paired(corpus: DataFrame, asked: DataFrame, block: int = BLOCK, widest: int = BLOCK):
    """Rows of both, grouped so that each block of one meets each block of the other in one task; `ask` tells them apart.

    Blocks of more than `block` rows, `widest` at most, are made where there would be more than FEW: each row is copied once for each block of the other.
    """
    blocks = lambda rows: max(1, -(-rows // min(max(block, -(-rows // FEW)), max(block, widest))))
    n, m = blocks(corpus.count()), blocks(asked.count())
    place = lambda k: F.pmod(F.xxhash64("item"), F.lit(k)).cast("int")
    left = corpus.select("*", place(n).alias("c"), F.lit(False).alias("ask")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    right = asked.select("*", place(m).alias("q"), F.lit(True).alias("ask")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return left.unionByName(right, allowMissingColumns=True).groupBy("c", "q")


def neighbours(queries: DataFrame, vectors: DataFrame, k: int = 20) -> DataFrame:
    """(item, rank, neighbor, similarity): for each query the k most similar other vectors, exactly.

    Corpus and queries are dealt into blocks; a task multiplies one block of each and keeps k rows a
    query, so rows put out grow with queries * corpus blocks, never with all pairs.
    """

    def run(t: pa.Table) -> pa.Table:
        ask = t.column("ask").to_numpy()
        ids = t.column("item").to_numpy()
        v = matrix(t.column("vec"))
        norm = np.sqrt((v * v).sum(1, keepdims=True))
        v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
        sim = v[ask] @ v[~ask].T
        q, c = ids[ask], ids[~ask]
        sim[q[:, None] == c[None]] = -np.inf
        keep = min(k, len(c))
        out = []
        for a in range(0, len(q) if keep else 0, STRIP):
            part = sim[a : a + STRIP]
            # what can reach the k-th after rounding; ties are settled by item, however many there are
            least = np.partition(part, len(c) - keep, axis=1)[:, len(c) - keep, None] - 2 * 10.0**-PLACES
            row, at = np.nonzero((part >= least) & np.isfinite(part))
            value, other = rounded(part[row, at]), c[at]
            order = np.lexsort((other, -value, row))
            row, value, other = row[order], value[order], other[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append((q[a + row[best]], other[best], value[best]))
        item, other, value = (np.concatenate(x) for x in zip(*out)) if out else (q[:0], c[:0], np.zeros(0))
        return pa.table({"item": item, "neighbor": other, "similarity": value})

    found = paired(vectors.select("item", "vec"), queries.select("item", "vec")).applyInArrow(run, "item long, neighbor long, similarity double")
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("similarity"), "neighbor"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item", "rank", "neighbor", "similarity")


def weighted_means(rows: DataFrame, key: str) -> DataFrame:
    """(key, i, value): component i of sum(w * v) / sum(w) over rows (key, vec, w); 0 where the weights sum to 0. Vectors are added up by batch before they are dealt by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.table({"key": b.column(key), "w": b.column("w"), "vec": b.column("vec")}).filter(b.column("vec").is_valid())
            if not len(t):
                continue
            v, w = matrix(t.column("vec")), t.column("w").to_numpy().astype(np.float64)
            coded = t.column("key").combine_chunks().dictionary_encode(null_encoding="encode")
            at, width = coded.indices.to_numpy(), v.shape[1]
            total, weight = np.zeros((len(coded.dictionary), width)), np.bincount(at, w, len(coded.dictionary))
            np.add.at(total, at, v * w[:, None])
            n = len(total)
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(np.repeat(np.arange(n), width))), pa.array(np.tile(np.arange(width, dtype=np.int32), n)), pa.array(total.ravel()), pa.array(np.repeat(weight, width))], ["key", "i", "s", "w"])

    kind = rows.schema[key].dataType.simpleString()
    sums = rows.select(key, F.col("w").cast("double").alias("w"), "vec").mapInArrow(run, f"key {kind}, i int, s double, w double").groupBy("key", "i").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
    return sums.select(F.col("key").alias(key), "i", F.when(F.col("w") != 0, F.col("s") / F.when(F.col("w") != 0, F.col("w")).otherwise(1.0)).otherwise(0.0).alias("value"))


def as_vectors(components: DataFrame, key: str) -> DataFrame:
    return components.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "value"))), lambda x: x["value"]).alias("vec"))


def centroid_distances(vectors: DataFrame) -> DataFrame:
    """(item, cluster, distance) to the mean of the cluster."""
    c = as_vectors(weighted_means(vectors.withColumn("w", F.lit(1.0)), "cluster"), "cluster").select("cluster", F.col("vec").alias("mean"))
    return vectors.join(c, "cluster").select("item", "cluster", F.sqrt(F.aggregate(F.zip_with("vec", "mean", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)).alias("distance"))
