"""Removal of every byte that lies in a long byte string found twice or more, by suffix order.

1. Each 400-byte string holds exactly one anchor: its leftmost least 32-byte gram by hash. Strings
   that are equal have equal anchors at equal places, so a string whose anchor gram is found once
   cannot repeat. Successive strings with one anchor form a segment.
2. Segments whose anchor gram repeats are collected by equal bytes, with their number. Two different
   segments can share a 400-byte string only if they agree in 300 bytes around their anchors, at one
   of four places; the others are left out.
3. One of each is dealt to a shard by its gram. The suffixes of a shard are ordered by external
   induced sorting with common prefixes (module induced); strings next to each other that agree in
   400 bytes repeat, as do those of segments that were found twice.
4. A gram with more than HOT distinct segments (a passage that stands in a great many documents) is
   not given to one shard: its strings are compared across shards, grouped by a 128-bit hash.
5. Starts found go back to all documents that hold the segment, whose bytes are then cut.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .induced import repeated_starts
from .tables import discard, free_names, partitions, quoted, stored
from .textblocks import M1, block_of, hash_spans, mix, ragged, slices

LENGTH = 400
GRAM = 32
#: Distinct segments of a gram that one shard takes, and bytes of segments that it sorts at a time.
HOT, SHARD_BYTES = 2048, 64 << 20
#: Bytes of a shard, or of an array of its sort, beyond which they lie on disk.
IN_MEMORY = 16 << 20
#: Bytes of text cut into segments at a time: what fits in a processor's cache.
CACHED = 1 << 18
#: Places around an anchor at which two segments may agree.
PLACES = 4


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> dict[str, np.ndarray]:
    """Of texts back to back: doc, first and last start of each run of strings with one anchor, and the hash of its gram."""
    n, width = int(offsets[-1]), length - GRAM + 1
    none = {"doc": np.zeros(0, np.int64), "first": np.zeros(0, np.int64), "last": np.zeros(0, np.int64), "anchor": np.zeros(0, np.int64), "gram": np.zeros(0, np.uint64)}
    starts = n - length + 1
    if starts <= 0:
        return none
    eights = np.ndarray((n + 1,), "<u8", data, strides=(1,))
    grams = n - GRAM + 1
    h = np.zeros(grams, np.uint64)
    for i in range(0, GRAM, 8):
        h = (h ^ eights[i : i + grams]) * M1
        h ^= h >> np.uint64(29)
    h = mix(h)
    # the least of (hash, place) in each window of grams, by minima from both ends of blocks
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)
    padded = np.full(-(-grams // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:grams] = key
    rows = padded.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = np.minimum(after[:starts], before[width - 1 : width - 1 + starts]) & np.uint64(0xFFFFFFFF)
    # strings that stay inside a text
    doc_len = np.diff(offsets)
    fits = np.maximum(doc_len - length + 1, 0)
    doc, i = ragged(fits)
    if not len(doc):
        return none
    at = offsets[doc] + i
    a = anchor[at]
    new = np.r_[True, (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])]
    head = np.flatnonzero(new)
    last = np.r_[head[1:], len(at)] - 1
    return {"doc": doc[head], "first": i[head], "last": i[last], "anchor": a[head].astype(np.int64) - offsets[doc[head]], "gram": h[a[head].astype(np.int64)]}


def _hashes() -> tuple[Column, Column]:
    """96 bits of hashes of the text, by which equal texts are handled once."""
    text = F.coalesce("text", F.lit(""))
    return F.xxhash64(text), F.crc32(text.cast("binary"))


def _keyed(texts: DataFrame) -> DataFrame:
    """(text, t1, t2)"""
    return texts.withColumns(dict(zip(("t1", "t2"), _hashes())))


def _segment_rows(texts: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=CACHED):
            data, offsets = block_of(b.column("text"))
            s = segments(data, offsets, length)
            begin, end = offsets[s["doc"]] + s["first"], offsets[s["doc"]] + s["last"] + length
            doc = pa.array(s["doc"])
            yield pa.record_batch(
                [b.column("t1").take(doc), b.column("t2").take(doc), *(pa.array(x.astype(np.int32)) for x in (s["first"], s["last"], s["anchor"])), *(pa.array(x.view(np.int64)) for x in (s["gram"], hash_spans(data, begin, end, 1)))],
                ["t1", "t2", "first", "last", "anchor", "gram", "h1"],
            )

    return texts.select("t1", "t2", "text").mapInArrow(run, "t1 long, t2 long, first int, last int, anchor int, gram long, h1 long")


def _agreements(data: np.ndarray, offsets: np.ndarray, anchor: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, hash) of the bytes around each anchor that a common string must hold: left and right of it by PLACES splits."""
    step = length // PLACES
    rows, keys = [], []
    for i in range(PLACES):
        begin, end = offsets[:-1] + anchor - i * step, offsets[:-1] + anchor + length - (i + 1) * step
        ok = np.flatnonzero((begin >= offsets[:-1]) & (end <= offsets[1:]))
        rows.append(ok)
        keys.append(hash_spans(data, begin[ok], end[ok], 10 + i))
    return np.concatenate(rows), np.concatenate(keys)


def _cut_out(wanted: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """(gram, h1, n, keys, bytes) of the wanted segments (with t1, t2, first, last, anchor); keys: their agreements."""
    per_text = wanted.groupBy("t1", "t2").agg(F.collect_list(F.struct("gram", "h1", "n", "first", "last", "anchor")).alias("s"))
    both = per_text.join(texts, ["t1", "t2"]).select("s", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=1 << 20):
            s = b.column("s").flatten()
            size = np.diff(b.column("s").offsets.to_numpy())
            data, offsets = block_of(b.column("text"))
            first, last, anchor = (s.field(k).to_numpy().astype(np.int64) for k in ("first", "last", "anchor"))
            begin = np.repeat(offsets[:-1], size) + first
            spread = last - first + length
            row, i = ragged(spread)
            parts = np.r_[data[begin[row] + i], np.zeros(8, np.uint8)]
            at = np.r_[0, np.cumsum(spread)]
            who, key = _agreements(parts, at, anchor - first, length)
            by = np.argsort(who, kind="stable")
            keys = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(who, minlength=len(first)))].astype(np.int32)), pa.array(key[by].view(np.int64)))
            raw = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(parts[:-8])])
            yield pa.record_batch([*(s.field(k) for k in ("gram", "h1", "n")), keys, raw], ["gram", "h1", "n", "keys", "bytes"])

    return both.mapInArrow(run, "gram long, h1 long, n long, keys array<long>, bytes binary")


def _runs(hit: np.ndarray) -> np.ndarray:
    """[first, last] of each run of true values."""
    edge = np.diff(np.r_[0, hit.astype(np.int8), 0])
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], 1).astype("<i4")


class Shard:
    """The segments of a shard: their bytes in a file if they are many, their keys in memory."""

    def __init__(self):
        self.file = tempfile.SpooledTemporaryFile(max_size=IN_MEMORY)
        self.keys: list[pa.RecordBatch] = []
        self.sizes: list[np.ndarray] = []
        self.bytes = 0

    def add(self, b: pa.RecordBatch) -> None:
        data, offsets = block_of(b.column("bytes"))
        self.file.write(memoryview(data)[: offsets[-1]])
        self.keys.append(b.select(["gram", "h1", "n"]))
        self.sizes.append(np.diff(offsets))
        self.bytes += int(offsets[-1])

    def solved(self, length: int) -> Iterator[pa.RecordBatch]:
        """(gram, h1, runs) of its segments with repeated strings."""
        offsets = np.r_[0, np.cumsum(np.concatenate(self.sizes))].astype(np.int64)
        self.file.flush()
        self.file.seek(0)
        if self.bytes > IN_MEMORY:
            data = np.memmap(self.file, np.uint8, "r", shape=(self.bytes,))
        else:
            data = np.frombuffer(self.file.read(), np.uint8)
        hit, at = repeated_starts(data, offsets, length, IN_MEMORY), 0
        for b in self.keys:
            many, found = b.column("n").to_numpy() > 1, []
            for i, m in enumerate(many.tolist(), at):
                found.append(_runs(hit[offsets[i] : offsets[i + 1] - length + 1] | m))
            at += b.num_rows
            use = pa.array([i for i, x in enumerate(found) if len(x)], pa.int64())
            yield pa.record_batch([*(b.column(k).take(use) for k in ("gram", "h1")), pa.array([x.tobytes() for x in found if len(x)], pa.binary())], ["gram", "h1", "runs"])
        self.file.close()


def _sorted_shards(cut: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """(gram, h1, runs): the starts in each segment whose strings repeat, by the suffix order of shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = Shard(), None
        for b in slices(batches, "bytes", 1 << 20):
            gram = b.column("gram").to_numpy()
            if held.bytes > shard_bytes:  # ends where the gram changes
                at = 0 if gram[0] != last else int(np.argmax(gram != gram[0])) if (gram != gram[0]).any() else len(gram)
                if at:
                    held.add(b.slice(0, at))
                if at == len(gram):
                    continue
                yield from held.solved(length)
                held, b = Shard(), b.slice(at)
            held.add(b)
            last = gram[-1]
        if held.bytes:
            yield from held.solved(length)

    dealt = cut.select("gram", "h1", "n", "bytes").repartition(partitions(cut.sparkSession), "gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(run, "gram long, h1 long, runs binary")


def _hashed_strings(cut: DataFrame, length: int) -> DataFrame:
    """The same for grams with too many segments for a shard: strings are grouped by hash, whichever tasks hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "bytes", 1 << 18):
            data, offsets = block_of(b.column("bytes"))
            row, i = ragged(np.diff(offsets) - length + 1)
            at = offsets[row] + i
            w = [hash_spans(data, at, at + length, seed).view(np.int64) for seed in (3, 4)]
            row = pa.array(row)
            yield pa.record_batch([*(b.column(k).take(row) for k in ("gram", "h1", "n")), pa.array(i.astype(np.int32)), *map(pa.array, w)], ["gram", "h1", "n", "at", "w1", "w2"])

    each = cut.select("gram", "h1", "n", "bytes").mapInArrow(run, "gram long, h1 long, n long, at int, w1 long, w2 long")
    again = each.groupBy("w1", "w2").agg(F.sum("n").alias("times")).where("times > 1")
    found = each.join(again, ["w1", "w2"], "left_semi").groupBy("gram", "h1").agg(F.sort_array(F.collect_list("at")).alias("at"))

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = []
            for x in b.column("at"):
                v = x.values.to_numpy()
                hit = np.zeros(int(v[-1]) + 1, bool)
                hit[v] = True
                runs.append(_runs(hit).tobytes())
            yield pa.record_batch([*(b.column(k) for k in ("gram", "h1")), pa.array(runs, pa.binary())], ["gram", "h1", "runs"])

    return found.mapInArrow(join_up, "gram long, h1 long, runs binary")


def repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(t1, t2, starts) of the distinct texts with repeated strings; starts: struct(first, runs) of each segment with some."""
    keyed = _keyed(docs.select("text"))
    rows = stored(_segment_rows(keyed, length), "segments")
    again = stored(rows.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1").select("gram"), "grams-found-again")  # stored, so that the join can be split at a hot gram
    found = stored(rows.join(again, "gram", "left_semi"), "repeated-grams")
    wanted = found.groupBy("gram", "h1").agg(F.count("*").alias("n"), F.min(F.struct("t1", "t2", "first", "last", "anchor")).alias("one")).select("gram", "h1", "n", "one.*")
    texts = keyed.join(found.select("t1", "t2").distinct(), ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"])
    cut = stored(_cut_out(wanted, texts, length), "segment-bytes")
    discard(rows)
    each = cut.select("gram", "h1", "n", F.explode("keys").alias("key"))
    agreed = stored(each.groupBy("gram", "key").agg(F.sum("n").alias("times")).where("times > 1").select("gram", "key"), "agreements")
    alike = each.join(agreed, ["gram", "key"], "left_semi").select("gram", "h1").distinct()
    per_gram = alike.groupBy("gram").agg(F.count("*").alias("n_distinct"))
    chosen = cut.drop("keys").join(alike.join(per_gram, "gram"), ["gram", "h1"])
    chosen = stored(chosen, "alike")
    runs = _sorted_shards(chosen.where(F.col("n_distinct") <= hot), length, shard_bytes).unionByName(_hashed_strings(chosen.where(F.col("n_distinct") > hot), length))
    runs = stored(runs, "repeated-starts")
    starts = found.select("gram", "h1", "t1", "t2", "first").distinct().join(runs, ["gram", "h1"]).groupBy("t1", "t2").agg(F.collect_list(F.struct("first", "runs")).alias("starts"))
    starts = stored(starts, "starts")
    discard(found, cut, chosen, runs, again, agreed)
    return starts


def covered(starts: pa.Scalar, length: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes [from, to) that the strings from these starts cover."""
    if not starts.is_valid:
        return []
    first, runs = starts.values.field("first").to_pylist(), starts.values.field("runs").to_pylist()
    both = np.concatenate([np.frombuffer(r, "<i4").reshape(-1, 2).astype(np.int64) + f for f, r in zip(first, runs)])
    both = both[np.argsort(both[:, 0], kind="stable")]
    begin, end = both[:, 0], np.maximum.accumulate(both[:, 1] + length)
    new = np.r_[True, begin[1:] > end[:-1]]
    return list(zip(begin[new].tolist(), end[np.r_[np.flatnonzero(new)[1:], len(end)] - 1].tolist()))


def without_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """All columns of docs, with n_bytes, n_removed, n_spans, kept_sha256 and kept_text.

    A byte of a text goes if it is covered by a string of `length` bytes that also starts anywhere
    else in the table, in whichever row; all copies go, and strings are judged on the input. The
    digest is over the bytes that stay; kept_text is their text, in which a character that lost
    some of its bytes is dropped. A null text is empty; repeated rows count as copies. Columns
    of docs may have any names; those with the new names are replaced.
    """
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    columns = [c for c in docs.columns if c not in new]
    base = docs.select(*[quoted(c) for c in columns])
    a, b, starts = free_names(columns + new, 3)
    found = repeats(base, length, hot, shard_bytes).select(F.col("t1").alias(a), F.col("t2").alias(b), F.col("starts").alias(starts))
    one, two = _hashes()
    rows = base.withColumns({a: one, b: two}).join(found, [a, b], "left")
    rows = rows.select(*[quoted(c).alias("text" if c == "text" else f"c{i}") for i, c in enumerate(columns)], F.col(starts).alias("starts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for s, t in zip(b.column("starts"), b.column("text")):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                spans = covered(s, length)
                kept, at = [], 0
                for x, y in spans:
                    kept.append(raw[at:x])
                    at = y
                kept = b"".join([*kept, raw[at:]])
                out.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")))
            more = [pa.array([x[i] for x in out], k) for i, k in enumerate([pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()])]
            yield pa.record_batch([*b.columns[:-1], *more], [*columns, *new])

    kinds = [T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.StringType()]
    return rows.mapInArrow(run, T.StructType([*base.schema.fields, *(T.StructField(n, k) for n, k in zip(new, kinds))]))


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What stays of each document after all 400-byte strings found twice or more are cut, as digest and as text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeats(docs).drop("text")
