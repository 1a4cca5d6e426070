"""SimHash document fingerprints and the search for all fingerprints within a Hamming radius.

Terms are word shingles; each occurrence votes +1 or -1 on every bit of the fingerprint by the bits
of its hash, so a term weighs as often as it occurs. The sign of the sum is the bit. Two texts that
share most of their terms agree in most bits.

Search: the fingerprint is cut into blocks, and there is a table for each, keyed by its bits (those of
the fingerprint permuted so that the block comes first). Two fingerprints that differ in at most
2 * blocks - 1 bits differ in at most one bit of some block, so a query that looks up its own bits
and all with one bit changed, in each table, meets all fingerprints within that radius. Those kept
are stored once for each table, and only the queries are multiplied by the bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import partitions, stored
from .textblocks import M1, block_of, hash_spans, mix, shingles_of, slices, words_of

BITS = 128
SHINGLE = 3
#: Bits within which two fingerprints are near: a likeness of 0.93, as of texts with one word of 100 or more changed.
RADIUS = 9
#: Tables: one for each block of 25 or 26 bits.
BLOCKS = 5
#: Terms whose votes are summed at a time.
TERMS = 1 << 16


def simhash(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """A row (high, low) of 64-bit halves for each text; a text without words has 0."""
    data, offsets = block_of(texts)
    starts, ends, before = words_of(data, offsets)
    term, upto = shingles_of(hash_spans(data, starts, ends), before, shingle)
    votes = np.zeros((len(texts), BITS), np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(upto))
    for a in range(0, len(term), TERMS):
        t, d = term[a : a + TERMS], doc[a : a + TERMS]
        bits = np.unpackbits(np.stack([t, mix(t + M1)], 1).view(np.uint8), axis=1)
        first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        votes[d[first]] += 2 * ones - np.diff(np.r_[first, len(d)])[:, None]
    return np.packbits(votes > 0, axis=1).view(">u8").astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal bits."""
    return 1 - np.bitwise_count(a ^ b).sum(1) / BITS


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp_hi long, fp_lo long) of each row; a null or wordless text has the fingerprint 0."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = simhash(b.column("text"), shingle).view(np.int64)
            yield pa.record_batch([b.column("id"), pa.array(fp[:, 0]), pa.array(fp[:, 1])], ["id", "fp_hi", "fp_lo"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, fp_hi long, fp_lo long").withColumnRenamed("id", id_col)


def block_bits(blocks: int, hi: str = "fp_hi", lo: str = "fp_lo") -> list[tuple[Column, int]]:
    """(bits as a number, width) of each block of a fingerprint in two columns, from the highest bit on."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    if blocks < 3 or max(np.diff(cuts)) > 58:
        raise ValueError("there must be at least 3 blocks")

    def part(word: str, a: int, z: int) -> Column:  # bits a to z of a word, from its highest
        return F.shiftrightunsigned(F.col(word), 64 - z).bitwiseAND((1 << (z - a)) - 1)

    out = []
    for a, z in zip(cuts, cuts[1:]):
        if z <= 64:
            bits = part(hi, a, z)
        elif a >= 64:
            bits = part(lo, a - 64, z - 64)
        else:
            bits = F.shiftleft(part(hi, a, 64), z - 64).bitwiseOR(part(lo, 0, z - 64))
        out.append((bits, z - a))
    return out


def neighbours(fps: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """For each distinct fingerprint (fp_hi, fp_lo) of `queries`: n_near long, the rows of `fps` within the radius.

    Equal fingerprints meet once, with their number of rows. A pair is met in the first table in
    which it is looked up and only there, and the distance is part of the join's condition, so the
    join puts out true neighbours only. Rows in which a half is null take no part.
    """
    if radius >= 2 * blocks:
        raise ValueError("the radius must be under twice the number of blocks")
    some = queries.select("fp_hi", "fp_lo").where("fp_hi IS NOT NULL AND fp_lo IS NOT NULL").distinct()
    every = fps.where("fp_hi IS NOT NULL AND fp_lo IS NOT NULL").groupBy("fp_hi", "fp_lo").agg(F.count("*").alias("n"))

    def entry(i: int, bits: Column) -> Column:  # the table's number above the bits
        return bits.bitwiseOR(F.lit(i << 58))

    def changed(e: Column, width: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda b: e.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))

    own = F.array(*[entry(i, bits) for i, (bits, _) in enumerate(block_bits(blocks))])
    probes = F.concat(own, *[changed(entry(i, bits), width) for i, (bits, width) in enumerate(block_bits(blocks))])
    asked = some.select(F.col("fp_hi").alias("q_hi"), F.col("fp_lo").alias("q_lo"), F.explode(probes).alias("key"))
    kept = every.select("fp_hi", "fp_lo", "n", F.explode(own).alias("key"))
    differ = F.bit_count(F.col("q_hi").bitwiseXOR(F.col("fp_hi"))) + F.bit_count(F.col("q_lo").bitwiseXOR(F.col("fp_lo")))
    pairs = zip(block_bits(blocks, "q_hi", "q_lo"), block_bits(blocks))
    first = F.coalesce(*[F.when(F.bit_count(q.bitwiseXOR(d)) <= 1, F.lit(i)) for i, ((q, _), (d, _)) in enumerate(pairs)])
    met = asked.hint("merge").join(kept, "key").where((differ <= radius) & (first == F.shiftrightunsigned("key", 58)))
    return met.groupBy(F.col("q_hi").alias("fp_hi"), F.col("q_lo").alias("fp_lo")).agg(F.sum("n").alias("n_near"))


def with_next_row(docs: DataFrame) -> DataFrame:
    """Rows (bucket, ghost, key, doc_id, text) partitioned by bucket and sorted, in which the row after each own row is its successor.

    Order: doc_id (null first), then text; the first row follows the last. Buckets are ranges
    between quantiles, which are ids of the table, so the row that opens a bucket is known without
    a global sort; it is also put at the end of the bucket before it, as a ghost.
    """
    spark = docs.sparkSession
    src = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(2**63))).alias("key"))
    n = 3 * partitions(spark)
    row = src.agg(F.percentile_approx("key", [(i + 1) / n for i in range(n - 1)], 20 * n).alias("q"), F.min("key").alias("least")).first()
    cuts = np.array(sorted(set(row["q"] or [])), np.int64)
    least = row["least"] if row["least"] is not None else 0

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column("key").to_numpy(zero_copy_only=False)
            own = np.searchsorted(cuts, key, "right")
            opens = np.flatnonzero(np.isin(key, cuts)) if len(cuts) else np.zeros(0, int)
            wraps = np.flatnonzero(key == least)
            at = np.concatenate([np.arange(len(key)), opens, wraps])
            bucket = np.concatenate([own, own[opens] - 1, np.full(len(wraps), len(cuts))])
            ghost = np.concatenate([np.zeros(len(key), int), np.ones(len(opens), int), np.full(len(wraps), 2)])
            yield pa.record_batch([pa.array(bucket.astype(np.int32)), pa.array(ghost.astype(np.int32)), *(b.column(c).take(pa.array(at)) for c in ("key", "doc_id", "text"))], ["bucket", "ghost", "key", "doc_id", "text"])

    dealt = src.mapInArrow(deal, "bucket int, ghost int, key long, doc_id long, text string")
    return dealt.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "ghost", "key", F.asc_nulls_first("text"))


def edited(text: str, following: str) -> str:
    """text with its last quarter (code points, rounded down) replaced by as many of the first of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to it and to the next document.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex), near_edited,
    near_next, fp_hi, fp_lo. Null texts are empty; empty and wordless texts have the fingerprint 0.
    Repeated ids follow one another in the order of their texts; null ids come first. An empty
    table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in slices(batches):
            block = pa.Table.from_batches([x for x in (last, b) if x is not None]).combine_chunks().to_batches()[0]
            last = block.slice(block.num_rows - 1)
            if block.num_rows < 2:
                continue
            bucket, ghost = block.column("bucket").to_numpy(), block.column("ghost").to_numpy()
            use = np.flatnonzero((ghost[:-1] == 0) & (bucket[:-1] == bucket[1:]))
            if not len(use):
                continue
            texts = [x or "" for x in block.column("text").to_pylist()]
            new = [edited(texts[i], texts[i + 1]) for i in use]
            fp, fe = simhash(block.column("text")), simhash(pa.array(new, pa.string()))
            ids, own = block.column("doc_id").take(pa.array(use)), fp[use]
            yield pa.record_batch(
                [
                    ids,
                    pa.array([len(texts[i]) for i in use], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in new]),
                    pa.array([f"{int(a):016x}{int(c):016x}" for a, c in own]),
                    pa.array([f"{int(a):016x}{int(c):016x}" for a, c in fe]),
                    pa.array(likeness(own, fe)),
                    pa.array(likeness(own, fp[use + 1])),
                    pa.array(own[:, 0].astype(np.int64)),
                    pa.array(own[:, 1].astype(np.int64)),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "fp_hi", "fp_lo"],
            )

    return with_next_row(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, fp_hi long, fp_lo long")


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of documents; n_near: of those with an id divisible by 50, the other documents within the radius."""
    prints = stored(fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet")), "fingerprints")
    asks = F.coalesce(F.col("doc_id") % 50 == 0, F.lit(False))
    near = stored(neighbours(prints, prints.where(asks)), "near-fingerprints")
    asked = prints.where(asks).join(near, ["fp_hi", "fp_lo"], "left").withColumn("n_near", F.col("n_near") - 1)
    return asked.unionByName(prints.where(~asks).withColumn("n_near", F.lit(None).cast("long"))).drop("fp_hi", "fp_lo")
