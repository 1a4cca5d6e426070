"""Hard negatives by a full score sort: an anchor's scores of all rows, sorted, and searched for the limits of its positives.

Rows are dealt into blocks by a hash of their id and anchors into others; a task has one block of each. It computes
all integer scores, sorts them by score and id, and reads the best k of a label (first pass, positives) or, by binary
search for each positive's limits, the first k of other labels between them (second pass, negatives). What a task
puts out is at most k rows for an anchor or positive; the blocks' lists are merged by rank. So the sort is whole over
all rows, and no task holds more than a block of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import discard, partitions, stored
from .whitening import finite, longest, matrix, whole

#: Positives of an anchor, negatives of a positive, and percent of the positive's score that a negative must reach (fixed values).
POSITIVES, NEGATIVES, LOWER = 5, 5, 80
#: Scale of the whole numbers that components become; every how many ids is an anchor; labels are a ring of so many (fixed values).
SCALE, ANCHOR_EACH, LABELS = 256, 100, 10
#: Vector entries of a block at most, rows at least, and scores that are sorted at a time.
ENTRIES, LEAST_ROWS, SCORES = 1 << 20, 512, 1 << 21


def scores(asked: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: in doubles where all sums are below 2^53, else longs, else Python's integers held within a long."""
    most = asked.shape[1] * int(np.abs(asked).max(initial=0)) * int(np.abs(x).max(initial=0))
    if most < 1 << 53:
        return (asked.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 62:
        return asked @ x.T
    return np.clip(asked.astype(object) @ x.T.astype(object), 1 - (1 << 62), (1 << 62) - 1).astype(np.int64)


def sorted_scores(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's scores, negated and ascending, and the places they had; of equal ones the first place comes first."""
    n = score.shape[1]
    if n and int(np.abs(score).max(initial=0)) < (1 << 62) // n:
        key = np.sort(np.arange(n) - score * n, axis=1)  # score and place in one number
        at = key % n
        return (key - at) // n, at
    at = np.argsort(-score, axis=1, kind="stable")
    return np.take_along_axis(-score, at, 1), at


def lower_limit(positive: int, percent: int) -> int:
    """The least whole score with percent * positive <= 100 * score."""
    return -(-percent * positive // 100)


class Block:
    """A task's rows, in order of id, and its anchors."""

    def __init__(self, t: pa.Table, width: int):
        t = t.sort_by([("id", "ascending"), ("label", "ascending")])
        ask = t.column("ask").to_numpy()
        x = matrix(t.column("x"), width)
        ids, labels = t.column("id").to_numpy(), t.column("label").to_numpy()
        self.ids, self.labels, self.x = ids[~ask], labels[~ask], x[~ask]
        self.a_ids, self.a_labels, self.a_x = ids[ask], labels[ask], x[ask]
        self.n, self.a_n = t.column("n").to_numpy()[~ask], t.column("n").to_numpy()[ask]
        self.positives = t.column("positives").filter(pa.array(ask)).to_pylist() if "positives" in t.column_names else []

    def strips(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, negated scores ascending, places) of each anchor."""
        step = max(1, SCORES // max(1, len(self.ids)))
        for lo in range(0, len(self.a_ids), step):
            below, at = sorted_scores(scores(self.a_x[lo : lo + step], self.x))
            yield from ((lo + k, below[k], at[k]) for k in range(len(at)))


def numbered(vectors: DataFrame, labels: int | None) -> tuple[DataFrame, int]:
    """(id, label, x, n) of the rows that take part, and the length of x; n tells apart rows that share an id."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("vec")).where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vec")))
    width = longest(rows)
    label = F.when(F.col("id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(labels))).otherwise(F.col("label")) if labels else F.col("label")
    x = whole(F.col("vec"), SCALE, 0, width)
    return rows.select("id", label.alias("label"), x.alias("x"), F.xxhash64(label, x).alias("n")).dropDuplicates(["id", "label", "n", "x"]), width


def paired(rows: DataFrame, anchors: DataFrame, width: int) -> DataFrame:
    """Both, each row beside the number of a block of rows and of a block of anchors: those of one task."""
    spark = rows.sparkSession
    most = max(1, ENTRIES // max(1, width))

    def blocks(df: DataFrame, side: str) -> int:
        count = df.count()
        least = -(-count // most)
        return max(1, least, min(partitions(spark), count // LEAST_ROWS) if side == "c" else 0)

    c, q = blocks(rows, "c"), blocks(anchors, "q")
    place = lambda n: F.pmod(F.xxhash64("id", "n"), F.lit(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("*", F.lit(False).alias("ask"), place(c).alias("c")).withColumn("q", all_(q))
    right = anchors.select("*", F.lit(True).alias("ask"), place(q).alias("q")).withColumn("c", all_(c))
    return left.unionByName(right, allowMissingColumns=True).groupBy("c", "q")


def positives_of(rows: DataFrame, anchors: DataFrame, width: int, k: int = POSITIVES) -> DataFrame:
    """(a, a_n, id, n, score) of the k rows of an anchor's label with the highest scores, ties by smaller id, itself left out."""

    def run(t: pa.Table) -> pa.Table:
        b = Block(t, width)
        out = []
        for a, below, at in b.strips():
            same = at[np.flatnonzero(b.labels[at] == b.a_labels[a])[: k + 1]]
            same = same[(b.ids[same] != b.a_ids[a]) | (b.n[same] != b.a_n[a])][:k]
            score = scores(b.a_x[a : a + 1], b.x[same])[0]
            out.append(np.stack([np.full(len(same), b.a_ids[a]), np.full(len(same), b.a_n[a]), b.ids[same], b.n[same], score], 1))
        found = np.concatenate(out) if out else np.zeros((0, 5), np.int64)
        return pa.table({c: found[:, i] for i, c in enumerate(["a", "a_n", "id", "n", "score"])})

    found = paired(rows, anchors, width).applyInArrow(run, "a long, a_n long, id long, n long, score long")
    best = F.row_number().over(W.partitionBy("a", "a_n").orderBy(F.desc("score"), "id", "n"))
    return found.withColumn("at", best).where(F.col("at") <= k).drop("at")


def negatives_of(rows: DataFrame, asked: DataFrame, width: int, k: int = NEGATIVES, lower: int = LOWER) -> DataFrame:
    """(a, a_n, p, p_n, id, score) of each positive's first k rows of another label within its limits.

    asked: anchors with positives, an array of struct(id, n, score).
    """

    def run(t: pa.Table) -> pa.Table:
        b = Block(t, width)
        out = []
        for a, below, at in b.strips():
            other = np.flatnonzero(b.labels[at] != b.a_labels[a])
            for p in b.positives[a]:
                # negated scores ascend: from -positive on, as long as they do not pass -lower limit
                lo, hi = np.searchsorted(other, [np.searchsorted(below, -p["score"], "left"), np.searchsorted(below, -lower_limit(p["score"], lower), "right")])
                out += [(b.a_ids[a], b.a_n[a], p["id"], p["n"], b.ids[at[i]], p["score"], -below[i]) for i in other[lo : min(hi, lo + k)]]
        names = ["a", "a_n", "p", "p_n", "id", "positive_score", "score"]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(names, zip(*out))} if out else {c: pa.array([], pa.int64()) for c in names})

    found = paired(rows, asked, width).applyInArrow(run, "a long, a_n long, p long, p_n long, id long, positive_score long, score long")
    rank = F.row_number().over(W.partitionBy("a", "a_n", "p", "p_n").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, ring: int | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, lower: int = LOWER) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of (vec_id, embedding, label).

    is_anchor: a condition on the column `id`. ring: labels of ids divisible by 7 become (label + 1) modulo it, if given.
    Rows with a null id, label or vector, or a null or non-finite entry, take no part; a shorter vector counts as
    ending in zeros. Rows that agree in id, label and vector are one; others that share an id are several. A
    positive without negatives within its limits gives no row, nor does an anchor without others of its label.
    Scores beyond +-2^62 count as that.
    """
    part, width = numbered(vectors, ring)
    rows = stored(part, "scored-rows")
    anchors = rows.where(is_anchor)
    first = positives_of(rows, anchors, width, positives).groupBy(F.col("a").alias("id"), F.col("a_n").alias("n")).agg(F.sort_array(F.collect_list(F.struct("id", "n", "score"))).alias("positives"))
    asked = stored(anchors.join(first, ["id", "n"]), "anchors")
    found = stored(negatives_of(rows, asked, width, negatives, lower), "hard-negatives")
    discard(rows, asked)
    return found.select(F.col("a").alias("anchor_id"), F.col("p").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of the embeddings whose id is divisible by 100."""
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % ANCHOR_EACH == 0, LABELS)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = v.label AS same, v.vec_id AS id, CAST(list_dot_product(a.x::DOUBLE[], v.x::DOUBLE[]) AS BIGINT) AS score
  FROM (SELECT * FROM v WHERE vec_id % 100 = 0) a JOIN v ON a.vec_id <> v.vec_id
), p AS (
  SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY rank <= 5
"""
