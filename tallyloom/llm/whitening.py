"""Whitening of embeddings with an exact scatter: residues of several primes, reduced sums, Chinese remainders, then eigh in doubles.

Entries are whole numbers x. With n vectors of the fit list and their sums S, every vector is centred without rounding
as z = n * x - S, and the scatter sum(z z') = n^3 * V is a matrix of whole numbers far beyond a double's 53 bits. Each
partition multiplies z modulo some primes, which doubles do exactly; Spark adds the residues of all partitions up;
the Chinese remainder theorem makes one whole number of the residues of an entry. Only V itself, one correctly rounded
division an entry, is a double.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import discard, stored

#: Components that are returned, and scale and offset of the whole numbers that entries become (fixed values).
COMPONENTS, SCALE, OFFSET = 16, 64, 1_000_000
#: Residues lie within half a prime below 2^PRIME_BITS of 0, so STRIP products add up to less than 2^53.
PRIME_BITS, STRIP = 21, 4096
#: Entries beyond this count as this.
FAR = 1 << 61


def finite(vec: Column) -> Column:
    """Whether a vector is not null and holds finite entries only; an empty one does."""
    return vec.isNotNull() & F.coalesce(F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def whole(vec: Column, scale: int, offset: int, length: int) -> Column:
    """floor(scale * c) + offset of each entry c, as longs; a vector shorter than length ends in zeros."""
    filled = F.concat(vec, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(length) - F.size(vec))))
    return F.transform(filled, lambda c: F.least(F.greatest(F.floor(c.cast("double") * scale), F.lit(-FAR)), F.lit(FAR)) + offset)


def longest(rows: DataFrame) -> int:
    """Entries of the longest vector `vec`; 0 without rows."""
    return rows.agg(F.coalesce(F.max(F.size("vec")), F.lit(0))).first()[0]


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """The vectors of a column of lists of that length, as rows."""
    one = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return one.flatten().to_numpy(zero_copy_only=False).reshape(len(one), width)


def primes(product: int) -> list[int]:
    """The largest primes below 2^PRIME_BITS, as many as it takes to multiply beyond the product."""
    out, at, so_far = [], 1 << PRIME_BITS, 1
    while so_far <= product:
        at -= 1
        if all(at % q for q in range(2, int(at**0.5) + 1)):
            out.append(at)
            so_far *= at
    return out


def remaindered(residues: dict[int, int]) -> int:
    """The whole number nearest 0 with those residues by prime (Garner's mixed radix)."""
    value, product = 0, 1
    for p, r in residues.items():
        value += product * ((r - value) * pow(product, -1, p) % p)
        product *= p
    return value - product if 2 * value > product else value


@dataclass
class Whitening:
    """n vectors with sums S; V's components as columns by falling eigenvalue; explained shares; largest error of the identity."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: list[float | None]
    used: np.ndarray
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, without rounding: longs where all fit, else Python's integers."""
        small = self.n * (int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)) < 1 << 62
        return x * self.n - np.array(self.sums, np.int64) if small else x.astype(object) * self.n - np.array(self.sums, object)

    def project(self, z: np.ndarray) -> np.ndarray:
        """Whitened rows of centred vectors: NaN at components without variance."""
        out = (z / self.n).astype(np.float64) @ (self.vectors / np.sqrt(np.where(self.used, self.values, 1.0)))
        out[:, ~self.used] = np.nan
        return out


def moments(fit: DataFrame, width: int) -> tuple[int, list[int], int]:
    """Rows of the fit list, sums by dimension, and the largest distance of an entry from 0, all exact; dimensions alone reach the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, most, total = 0, 0, [0] * width
        for b in batches:
            x = matrix(b.column("x"), width)
            n, most = n + len(x), max(most, int(np.abs(x).max(initial=0)))
            for lo in range(0, len(x), STRIP):  # halves of 31 bits, so that no strip overflows
                part = x[lo : lo + STRIP]
                high, low = (part >> 31).sum(0), (part & 0x7FFFFFFF).sum(0)
                total = [t + (h << 31) + w for t, h, w in zip(total, high.tolist(), low.tolist())]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([str(t) for t in total]), pa.array([n] * width, pa.int64()), pa.array([most] * width, pa.int64())], ["i", "s", "n", "most"])

    rows = fit.mapInArrow(partial, "i int, s string, n long, most long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"), F.max("most").alias("most")).collect()
    rows = sorted(rows, key=lambda r: r.i)
    return (rows[0].n, [int(r.s) for r in rows], max(r.most for r in rows)) if rows else (0, [0] * width, 0)


def scatter(fit: DataFrame, model: Whitening, most: int) -> list[list[int]]:
    """sum(z z') over the fit list, as Python's integers: dimensions squared, whatever the rows."""
    n, sums, width = model.n, model.sums, len(model.sums)
    # |z| <= n * most + |S|, and there are n products; twice that for the sign
    used = primes(2 * n * (n * most + max(map(abs, sums))) ** 2)
    upper = np.triu_indices(width)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(used), width, width), np.int64)
        seen = False
        for b in batches:
            x = matrix(b.column("x"), width)
            seen = seen or len(x) > 0
            for lo in range(0, len(x), STRIP):
                for k, p in enumerate(used):
                    z = ((x[lo : lo + STRIP] % p) * (n % p) - np.array([s % p for s in sums], np.int64)) % p
                    z = np.where(2 * z > p, z - p, z).astype(np.float64)  # nearest 0
                    total[k] = (total[k] + (z.T @ z).astype(np.int64)) % p
        for k in range(len(used) if seen else 0):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(upper[0]), k, np.int32)), pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array(total[k][upper])], ["k", "i", "j", "r"])

    reduced = fit.mapInArrow(partial, "k int, i int, j int, r long").groupBy("i", "j", "k").agg(F.sum("r").alias("r"))
    entries = reduced.groupBy("i", "j").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "r"))), lambda x: x["r"]).alias("r")).collect()
    out = [[0] * width for _ in range(width)]
    for e in entries:
        out[e.i][e.j] = out[e.j][e.i] = remaindered({p: r % p for p, r in zip(used, e.r)})
    return out


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of (covariance of the whitened fit list - identity), summed over the list itself."""
    width, at = len(model.sums), np.flatnonzero(model.used)
    if not len(at):
        return 0.0

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(at), len(at)))
        for b in batches:
            x = matrix(b.column("x"), width)
            for lo in range(0, len(x), STRIP):
                w = model.project(model.centred(x[lo : lo + STRIP]))[:, at]
                total += w.T @ w
        i, j = np.indices(total.shape, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "v"])

    error = F.abs(F.sum("v") / model.n - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    return fit.mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(error.alias("e")).agg(F.max("e")).first()[0]


def fitted(x: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of the distinct vectors of column x (arrays of `width` longs), up to that many components.

    Repeated vectors count once. Components are unit eigenvectors with the entry farthest from 0 positive; those without
    variance (beyond the rank) are not used. Without rows or variance no component is.
    """
    fit = stored(x.select("x").distinct(), "fit-list")
    n, sums, most = moments(fit, width) if width else (0, [], 0)
    none = np.zeros(0)
    model = Whitening(n, sums, none, np.zeros((width, 0)), [], none.astype(bool))
    if n:
        exact = scatter(fit, model, most)
        v = np.array([[float(Fraction(c, n**3)) for c in row] for row in exact])
        trace = float(Fraction(sum(exact[i][i] for i in range(width)), n**3))
        e, u = np.linalg.eigh(v)
        at = np.argsort(-e, kind="stable")[:components]
        u = u[:, at] * np.where(np.take_along_axis(u[:, at], np.abs(u[:, at]).argmax(0)[None], 0) < 0, -1.0, 1.0)
        floor = width * np.finfo(np.float64).eps * max(e.max(), 0.0)
        model.values, model.vectors, model.used = e[at], u, e[at] > floor
        model.explained = [(float(a / trace) if k else 0.0) if trace > 0 else None for a, k in zip(e[at], model.used)]
        model.identity_error = identity_error(fit, model)
    discard(fit)
    return model


def whitened(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> tuple[DataFrame, Whitening]:
    """(id, deviation, whitened) of every row with a finite vector, and the fitted whitening.

    whitened: an array of up to `components` doubles, NaN for components without variance; deviation: the sum
    of (n * x - S)^2, exact, null where it exceeds a long. Rows whose vector is null or holds null or non-finite
    entries are dropped; a vector shorter than the longest counts as ending in zeros. Ids may be null or repeat:
    each row is returned, and equal vectors count once in the fit. Entries count as +-2^61 after scaling where they lie beyond.
    """
    quoted = lambda c: F.col(f"`{c}`")
    rows = vectors.select(quoted(id_column).alias("id"), quoted(column).alias("vec")).where(finite(F.col("vec")))
    width = longest(rows)
    x = rows.select("id", whole(F.col("vec"), scale, offset, width).alias("x"))
    model = fitted(x, width, components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, STRIP):
                part = b.slice(lo, STRIP)
                z = model.centred(matrix(part.column("x"), width))
                far = z.dtype == object or len(z) and width * int(np.abs(z).max(initial=0)) ** 2 >= 1 << 63
                squares = (z.astype(object) ** 2).sum(1).tolist() if far else (z * z).sum(1).tolist()
                w = model.project(z)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([s if s < 1 << 63 else None for s in squares], pa.int64()), lists], ["id", "deviation", "whitened"])

    kind = rows.schema["id"].dataType.simpleString()
    return x.mapInArrow(run, f"id {kind}, deviation long, whitened array<double>"), model


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """Every finite vector of embeddings on each of the first components."""
    rows, model = whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    explained = F.array(*[F.lit(e).cast("double") for e in model.explained]).cast("array<double>")
    each = rows.select(F.col("id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "value"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.when(~F.isnan("value"), F.col("value")).alias("whitened"),
        F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
