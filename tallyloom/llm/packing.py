"""Best-two-fit packing of tokenised documents into sequences of a fixed capacity.

A bin is filled greedily, each time with the longest unpacked piece that fits; then its smallest
piece is taken out again if two unpacked pieces fit the widened gap more tightly. Only lengths
matter to that, so the plan is made on the table of lengths (as many rows as the capacity, however
large the corpus) and repeats each bin composition as often as the lengths last. Pieces find their
place by their rank among pieces of equal length; ranks are counted by bucket, so no length, however
common, is handled by one task.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import partitions, stored
from .textblocks import block_of, hash_spans, ragged, slices, words_of

CAPACITY = 4096
END_ID = 1
#: Words whose ids a Python worker remembers at most; beyond it, it starts anew.
WORDS_KEPT = 2_000_000
#: Bytes of text that are looked up at a time: new words are put among those remembered once for each.
LOOKED_UP = 8 << 20
#: New words that the tokenizer encodes at a time: what it returns for a word takes over a thousand bytes.
ENCODED = 8192

_tokenizers: dict[str, WordIds] = {}


class WordIds:
    """Ids of white-space separated words, by a tokenizer whose pieces never hold white space; words are remembered by hash."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.key, self.at, self.count, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each word)."""
        h, which, back = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.key) + len(h) > WORDS_KEPT:
            self.clear()
        i = np.searchsorted(self.key, h)
        new = np.flatnonzero((i >= len(self.key)) | (self.key[np.minimum(i, len(self.key) - 1)] != h)) if len(self.key) else np.arange(len(h))
        if len(new):
            ids, count = self._encoded(data, starts[which[new]], ends[which[new]])
            at = np.cumsum(count) - count + len(self.ids)
            self.ids = np.concatenate([self.ids, ids])
            self.key, self.at, self.count = (np.insert(x, i[new], y) for x, y in ((self.key, h[new]), (self.at, at), (self.count, count)))
            i = np.searchsorted(self.key, h)
        i = i[back]
        count = self.count[i]
        row, j = ragged(count)
        return self.ids[self.at[i][row] + j], count

    def _encoded(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of words by the tokenizer, some at a time."""
        raw, ids, count = memoryview(data), [], []
        for at in range(0, len(starts), ENCODED):
            words = [str(raw[a:b], "utf-8") for a, b in zip(starts[at : at + ENCODED].tolist(), ends[at : at + ENCODED].tolist())]
            some = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            count.append(np.array([len(x) for x in some], np.int64))
            ids.append(np.array([y for x in some for y in x], np.uint32))
        return np.concatenate(ids), np.concatenate(count)


def _word_ids(path: str) -> WordIds:
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def document_ids(texts: pa.Array, tokenizer: str, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, each followed by end_id; offsets)."""
    data, offsets = block_of(texts)
    starts, ends, before = words_of(data, offsets)
    ids, count = _word_ids(tokenizer).of(data, starts, ends)
    upto = np.concatenate([[0], np.cumsum(count)])[before]
    at = upto + np.arange(len(upto))
    out = np.full(len(ids) + len(texts), end_id, np.uint32)
    put = np.ones(len(out), bool)
    put[at[1:] - 1] = False
    out[put] = ids
    return out, at


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the token ids of each document, cut only where they exceed the capacity.

    A null or empty text is the single id end_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=LOOKED_UP):
            ids, at = document_ids(b.column("text"), tokenizer, end_id)
            n = -(-np.diff(at) // capacity)
            doc, piece = ragged(n)
            start = piece * capacity
            length = np.minimum(np.diff(at)[doc] - start, capacity)
            raw, first = memoryview(ids.astype("<u4")).cast("B"), 4 * (at[doc] + start)
            crc = [zlib.crc32(raw[a:z]) for a, z in zip(first.tolist(), (first + 4 * length).tolist())]
            yield pa.record_batch([b.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(lengths: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """[(number of bins, lengths in each)] that pack the given numbers of pieces by length."""
    if lengths and (min(lengths) < 1 or max(lengths) > capacity):
        raise ValueError("lengths must be from 1 to the capacity")
    have = np.zeros(capacity + 1, np.int64)
    for k, n in lengths.items():
        have[k] = n
    plan = []
    left = np.flatnonzero(have)
    while len(left):
        used = np.zeros(capacity + 1, np.int64)
        fill, gap = [], capacity
        i = len(left)
        while gap:
            i = min(i, int(np.searchsorted(left, gap, "right"))) - 1
            if i < 0:
                break
            k = int(left[i])
            n = min(gap // k, int(have[k]))
            fill += [k] * n
            used[k] += n
            gap -= n * k
        while gap and (two := _tighter(left, have, used, fill[-1], gap)):
            out = fill.pop()
            used[out] -= 1
            gap += out - sum(two)
            fill = sorted([*fill, *two], reverse=True)
            for k in two:
                used[k] += 1
        kinds = np.flatnonzero(used)
        times = int((have[kinds] // used[kinds]).min())
        have[kinds] -= times * used[kinds]
        plan.append((times, fill))
        left = left[have[left] > 0]
    return plan


def _tighter(left: np.ndarray, have: np.ndarray, used: np.ndarray, smallest: int, gap: int) -> tuple[int, int] | None:
    """The two unpacked lengths that fill the gap left by the smallest piece best, if better than it does."""
    spare = have[left] - used[left]
    free, spare = left[spare > 0], spare[spare > 0]
    if not len(free):
        return None
    a = free[free < gap + smallest]
    i = np.searchsorted(free, gap + smallest - a, "right") - 1
    fits = i >= 0
    a, i = a[fits], i[fits]
    single = (free[i] == a) & (spare[i] < 2)
    i = np.where(single, i - 1, i)
    a, i = a[i >= 0], i[i >= 0]
    if not len(a):
        return None
    best = int(np.argmax(a + free[i]))
    return (int(a[best]), int(free[i[best]])) if a[best] + free[i[best]] > smallest else None


def places(plan: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """For runs of ranks among pieces of a length, where they go: the first rank, bin, pieces in a bin and offset in it."""
    rank: Counter[int] = Counter()
    rows, base = [], 0
    for times, fill in plan:
        offset = 0
        for k, n in Counter(fill).items():
            rows.append((k, rank[k], base, n, offset))
            rank[k] += times * n
            offset += k * n
        base += times
    rows.sort()
    k, r, b, n, o = np.array(rows, np.int64).reshape(-1, 5).T
    return {"key": (k << 45) + r, "rank": r, "bin": b, "per": n, "offset": o}


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset.

    Every row of docs is packed, repeated ones too. Ids are those of the tokenizer without special
    tokens, then end_id. Sequences are gapless from 0; an empty table gives no rows.
    """
    spark = docs.sparkSession
    made = stored(pieces(docs, tokenizer, capacity, end_id), "pieces")
    lengths = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}  # a row for each length up to the capacity
    where = spark.sparkContext.broadcast(places(best_two_fit(lengths, capacity)))
    spread = made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(partitions(spark))).cast("int"))
    upto = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    first = spread.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("first"))
    own = F.row_number().over(W.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = spread.withColumn("own", own).join(first, ["bucket", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("own")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = where.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(p["key"], (length << 45) + rank, "right") - 1
            x = rank - p["rank"][i]
            place = [pa.array(p["bin"][i] + x // p["per"][i]), pa.array(p["offset"][i] + x % p["per"][i] * length)]
            yield pa.record_batch([*b.columns[:-1], *place], [*b.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("word_bpe_49k.json"))
