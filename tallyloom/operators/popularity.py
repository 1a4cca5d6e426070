"""Additions, removals and co-occurrence by popularity, for many baskets' owners at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..storage import Scratch, release, stored
from .ranks import ranked

#: Bytes of packed lists that a task adds up at a time, owners of a task, and pairs of a basket's items that it counts at a time.
LISTS, OWNERS, PAIRS = 1 << 20, 8192, 1 << 22
#: Rows (owner, item) whose lists are sent at a time, about 130 bytes each: owners go in waves, so that only one wave's lists lie in shuffle files.
WAVE = 1 << 26
#: Wanted items up to which every task knows them all.
WANTED = 1 << 18
LISTED = "item long, n long, others binary"
#: Names that are no advice, as they are written (fixed values).
SIX_BASICS = ["Plains", "Island", "Swamp", "Mountain", "Forest", "Wastes"]


def without_basics(rows: DataFrame, column: str = "item") -> DataFrame:
    """The rows whose name is none of the six basics, case and all."""
    return rows.where(~F.col(column).isin(SIX_BASICS))


def additions(mine: DataFrame, rates: DataFrame, k: int = 20) -> DataFrame:
    """(owner, rank, item, score): the k items of the leader found in most of its baskets that the owner lacks.

    mine: (owner, leader, item). Only the leader's first k + (items owned) items can be among them, and of these the owner
    gets the first k places that it does not hold, so its own items travel no further than to the places they take.
    """
    ranked = rates.withColumn("place", F.row_number().over(W.partitionBy("leader").orderBy(F.desc("n"), "item"))).select("leader", "item", "place", F.col("n").alias("score"))
    pairs = mine.groupBy("owner", "leader").agg(F.count("item").alias("m"))
    reach = pairs.withColumn("m", F.sum("m").over(W.partitionBy("owner"))).groupBy("leader").agg((F.max("m") + k).alias("reach"))
    top = ranked.join(F.broadcast(reach), "leader").where("place <= reach").drop("reach")
    taken = mine.select("owner", "item").join(top.select("leader", "item", "place"), "item").join(pairs, ["owner", "leader"], "left_semi").select("owner", "leader", "place")
    marks = pairs.select("owner", "leader", F.lit(0).alias("place")).unionByName(taken)
    w = W.partitionBy("owner", "leader").orderBy("place")
    free = marks.withColumn("lacks", F.col("place") - F.dense_rank().over(w) + 1).withColumn("next", F.lead("place").over(w)).where(F.col("lacks") < k)
    end = F.least(F.col("next") - 1, F.col("place") + k - F.col("lacks"))
    free = free.withColumn("end", end).where("end > place").select("owner", "leader", F.explode(F.sequence(F.col("place") + 1, F.col("end"))).alias("place"))
    rank = F.row_number().over(W.partitionBy("owner").orderBy(F.desc("score"), "item"))
    return free.join(top, ["leader", "place"]).withColumn("rank", rank).where(F.col("rank") <= k).select("owner", "rank", "item", "score")


def removals(mine: DataFrame, rates: DataFrame, frequency: DataFrame, k: int = 20) -> DataFrame:
    """(owner, rank, item, support, frequency): the k owned items least found in the leader's baskets, then overall; absent is 0."""
    j = mine.select("owner", "leader", "item").distinct().join(rates.select("leader", "item", F.col("n").alias("support")), ["leader", "item"], "left").join(frequency.select("item", F.col("n").alias("frequency")), "item", "left")
    j = j.select("owner", "item", F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("frequency", F.lit(0)).alias("frequency"))
    rank = F.row_number().over(W.partitionBy("owner").orderBy("support", "frequency", "item"))
    return j.withColumn("rank", rank).where(F.col("rank") <= k).select("owner", "rank", "item", "support", "frequency")


def additions_or_fallback(mine: DataFrame, rates: DataFrame, items: DataFrame, k: int = 20, least: int = 20) -> DataFrame:
    """As additions; owners with fewer than `least` of them, such as those of unknown leaders, get the items co-occurring most with theirs."""
    own = stored(additions(mine, rates, max(k, least)), "additions")
    known = own.groupBy("owner").agg(F.count("*").alias("m")).where(F.col("m") >= least).select("owner")
    rest = mine.join(known, "owner", "left_anti")
    return own.join(known, "owner", "left_semi").where(F.col("rank") <= k).withColumn("way", F.lit("leader")).unionByName(cooccurrence_scores(rest, items, k).withColumn("way", F.lit("together")))


def pairwise_support(lists: DataFrame, items: DataFrame, k: int | None = 20) -> DataFrame:
    """(owner, rank, item, support): the k items (None: all) of each list (owner, item) least found in one basket with its others; for lists of unknown leaders."""
    own = lists.select("owner", "item").distinct()
    with Scratch() as keep:
        held = keep(own, "owned")
        together = _together(held, items.join(held.select("item").distinct(), "item", "left_semi"), None, keep)
        s = stored(together.select("owner", "item", F.col("score").alias("s")), "support")
    j = own.join(s, ["owner", "item"], "left").select("owner", "item", F.coalesce("s", F.lit(0)).alias("support"))
    ranked = j.withColumn("rank", F.row_number().over(W.partitionBy("owner").orderBy("support", "item")))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def removals_or_support(mine: DataFrame, rates: DataFrame, frequency: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(owner, rank, item, support, frequency, way): as removals; for owners of leaders without rates, by how often an item stands in one basket with the owner's others.

    mine: (owner, leader, item); an item that is its owner's leader, and the six basics, are never removed where items are names.
    """
    known = mine.join(rates.select("leader").distinct(), "leader", "left_semi")
    unknown = mine.join(rates.select("leader").distinct(), "leader", "left_anti")
    support = pairwise_support(unknown, items, None).drop("rank").join(frequency.select("item", F.col("n").alias("frequency")), "item", "left")
    support = support.select("owner", "item", "support", F.coalesce("frequency", F.lit(0)).alias("frequency"), F.lit("together").alias("way"))
    rank = F.row_number().over(W.partitionBy("owner").orderBy("support", "frequency", "item"))
    together = support.withColumn("rank", rank).where(F.col("rank") <= k)
    return removals(known, rates, frequency, k).withColumn("way", F.lit("leader")).unionByName(together)


def cooccurrence(items: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(item, other, n): baskets that hold both. With `wanted`, item is one of those: the semi-join comes before the self-join."""
    left = items.select("basket_id", "item")
    if wanted is not None:
        left = left.join(wanted.select("item").distinct(), "item", "left_semi")
    right = items.select("basket_id", F.col("item").alias("other"))
    return left.join(right, "basket_id").where("item <> other").groupBy("item", "other").agg(F.count("*").alias("n"))


def _coded(values: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of values) of longs, ascending from each head on: the first and then the differences, 7 bits a byte."""
    x = values.view(np.uint64)
    step = np.where(head, x, x - np.r_[x[:1], x[:-1]])
    size = np.ones(len(x), np.int64)
    for j in range(1, 10):
        size += step >= np.uint64(1 << 7 * j)
    upto = np.r_[0, np.cumsum(size)]
    out = np.empty(upto[-1], np.uint8)
    for j in range(int(size.max(initial=0))):
        some = size > j
        out[upto[:-1][some] + j] = (step[some] >> np.uint64(7 * j)).astype(np.uint8) & 127 | (size[some] > j + 1).astype(np.uint8) << 7
    return out, upto


def _decoded(data: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, list of each) of lists that stand in data from each of upto to the next; none is empty."""
    ends = np.flatnonzero(data < 128)
    starts = np.r_[0, ends[:-1] + 1]
    step = (data[starts] & 127).astype(np.uint64)
    for j in range(1, int((ends - starts).max(initial=0)) + 1):
        some = starts + j <= ends
        step[some] |= (data[starts[some] + j] & 127).astype(np.uint64) << np.uint64(7 * j)
    first = np.searchsorted(starts, upto[:-1])
    total, which = np.cumsum(step), np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(starts)]))
    return (total - (total[first] - step[first])[which]).view(np.int64), which


def _lists(item: np.ndarray, n: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    """(item, n, others) of rows in the order of item, n and other: a packed list for each item and n."""
    head = np.r_[True, (item[1:] != item[:-1]) | (n[1:] != n[:-1])]
    data, upto = _coded(other, head)
    first = np.flatnonzero(head)
    lists = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.r_[upto[first], upto[-1]].astype(np.int32)), pa.py_buffer(data)])
    return pa.record_batch([pa.array(item[first]), pa.array(n[first]), lists], ["item", "n", "others"])


def packed(pairs: DataFrame) -> DataFrame:
    """(item, n, others): the others that stand n times with an item, some thousands a row, in 2 or 3 bytes each where items are many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _lists(*(b.column(c).to_numpy() for c in ("item", "n", "other")))

    return pairs.select("item", "n", "other").sortWithinPartitions("item", "n", "other").mapInArrow(run, LISTED)


def _counted(item: np.ndarray, other: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """_lists of rows in the order of item and other."""
    if n.min() < n.max():
        order = np.lexsort((n, item))
        item, other, n = item[order], other[order], n[order]
    return _lists(item, n, other)


def listed(items: DataFrame, wanted: DataFrame, parts: int) -> DataFrame:
    """packed(cooccurrence(items, wanted)) without a row for each pair: baskets send packed lists, which are added up where an item's lists meet."""
    asked = wanted.select("item").distinct()
    if asked.limit(WANTED + 1).count() <= WANTED:
        known = items.join(F.broadcast(asked.withColumn("wanted", F.lit(True))), "item", "left")
    else:  # nearly all, as a rule; lists of others meet no owner
        known = items.withColumn("wanted", F.lit(True))
    baskets = known.where("basket_id IS NOT NULL").groupBy("basket_id").agg(F.collect_list("item").alias("items"), F.collect_list(F.when(F.col("wanted"), F.col("item"))).alias("asked"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            here, mine = b.column("items"), b.column("asked")
            item, other = mine.flatten().to_numpy(), here.flatten().to_numpy()
            size, own = (pc.list_value_length(c).to_numpy() for c in (here, mine))
            m, start = np.repeat(size, own).astype(np.int64), np.repeat(np.cumsum(size) - size, own)
            upto = np.cumsum(m)
            at = 0
            while at < len(item):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
                some = m[at:to]
                place = np.arange(some.sum()) + np.repeat(start[at:to] - (np.cumsum(some) - some), some)
                left, right = np.repeat(item[at:to], some), other[place]
                differ = left != right
                if differ.any():
                    left, right, n, _ = _summed(left[differ], right[differ], np.ones(int(differ.sum()), np.int64))
                    yield _counted(left, right, n)
                at = to

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in _slices(batches):
            other, which = _values(b.column("others"))
            parts = [(b.column("item").to_numpy()[which], other, b.column("n").to_numpy()[which])]
            item, other, n, _ = _summed(*(np.concatenate(x) for x in zip(*parts, *([rest] if rest else []))))
            cut = int(np.searchsorted(item, item[-1]))  # the last item may go on
            if cut:
                yield _counted(item[:cut], other[:cut], n[:cut])
            rest = item[cut:], other[cut:], n[cut:]
        if rest is not None:
            yield _counted(*rest)

    sent = baskets.where("size(items) > 1 AND size(asked) > 0").select("items", "asked").mapInArrow(pairs, LISTED)
    return sent.repartition(parts, "item").sortWithinPartitions("item").mapInArrow(added, LISTED)


def reaching(owned: DataFrame, lists: DataFrame) -> DataFrame:
    """(owner, item, n, others): the lists of the items that an owner has; a row for a list, not for each other item in it."""
    # both sides are small, but what they make is not: as many tasks as shuffles have, whatever the sizes
    n = int(owned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df: df.repartition(n, "item")
    return dealt(owned.select("owner", "item")).join(dealt(lists), "item").select("owner", "item", "n", "others")


def _summed(owner: np.ndarray, other: np.ndarray, n: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """n and own added up for each (owner, other), in their order; none is negative."""
    own = np.zeros_like(n) if own is None else own
    low = [int(owner.min()), int(other.min()), 0, 0]
    bits = [(int(x.max()) - a).bit_length() for x, a in zip((owner, other, n, own), low)]
    if sum(bits) < 64:  # one number holds all, and numbers sort faster than rows
        key = owner - low[0]
        for x, a, width in zip((other, n, own), low[1:], bits[1:]):
            key = (key << width) | (x - a)
        key.sort()
        own = key & ((1 << bits[3]) - 1)
        n = (key >> bits[3]) & ((1 << bits[2]) - 1)
        key >>= bits[3] + bits[2]
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        key = key[head]
        owner, other = (key >> bits[1]) + low[0], (key & ((1 << bits[1]) - 1)) + low[1]
        return owner, other, np.add.reduceat(n, head), np.add.reduceat(own, head)
    order = np.lexsort((other, owner))
    owner, other = owner[order], other[order]
    head = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])])
    return owner[head], other[head], np.add.reduceat(n[order], head), np.add.reduceat(own[order], head)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows again, about LISTS bytes of packed lists at a time."""
    for b in batches:
        upto = np.cumsum(pc.binary_length(b.column("others")).to_numpy())
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + LISTS, "right")))
            yield b.slice(at, to - at)
            at = to


def _values(lists: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, list of each) of packed lists."""
    upto = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
    return _decoded(np.frombuffer(lists.buffers()[2], np.uint8)[upto[0] : upto[-1]], upto - upto[0])


def added_up(rows: DataFrame, owners: int, k: int | None = None) -> DataFrame:
    """(owner, item, score) of rows (owner, item, n, others): for each other item the sum of n.

    With k: of what the owner lacks, the k best, ties by item. Without: of what the owner has. Rows meet by owner, and
    a task holds the scores of the owners of some lists, and those of an owner that goes on.
    """
    kind = rows.schema["owner"].dataType.simpleString()

    def told(names: pa.Array, owner: np.ndarray, other: np.ndarray, score: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        keep = own > 0 if k is None else own == 0
        owner, other, score = owner[keep], other[keep], score[keep]
        if k is not None and len(owner):
            head = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            size = np.diff(np.r_[head, len(owner)])
            floor = np.array([np.partition(score[a : a + m], m - k)[m - k] if m > k else 0 for a, m in zip(head.tolist(), size.tolist())])
            some = np.flatnonzero(score >= np.repeat(floor, size))
            some = some[np.lexsort((other[some], -score[some], owner[some]))]
            some = some[np.arange(len(some)) - np.searchsorted(owner[some], owner[some]) < k]
            owner, other, score = owner[some], other[some], score[some]
        return pa.record_batch([names.take(pa.array(owner)), pa.array(other), pa.array(score)], ["owner", "item", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in _slices(batches):
            column = b.column("owner")
            if rest is not None:
                column = pa.concat_arrays([rest[0], column])
            coded = column.dictionary_encode(null_encoding="encode")
            code = coded.indices.to_numpy().astype(np.int64)
            other, which = _values(b.column("others"))
            at, items, n = code[len(code) - b.num_rows :], b.column("item").to_numpy(), b.column("n").to_numpy()
            parts = [(at[which], other, n[which], np.zeros(len(which), np.int64)), (at, items, np.zeros_like(n), np.ones_like(n))]
            if rest is not None:
                parts.append((np.zeros(len(rest[1]), np.int64), *rest[1:]))
            owner, *sums = _summed(*(np.concatenate(x) for x in zip(*parts)))
            cut = int(np.searchsorted(owner, code[-1]))  # the last owner may go on
            yield told(coded.dictionary, owner[:cut], *(x[:cut] for x in sums))
            rest = (column.slice(len(column) - 1), *(x[cut:] for x in sums))
        if rest is not None:
            yield told(rest[0], np.zeros(len(rest[1]), np.int64), *rest[1:])

    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-owners // OWNERS))
    return rows.repartition(n, "owner").sortWithinPartitions("owner").mapInArrow(run, f"owner {kind}, item long, score long")


def _together(owned: DataFrame, items: DataFrame, k: int | None, keep: Scratch) -> DataFrame:
    """added_up for distinct rows (owner, item); items that are no numbers are numbered in their order."""
    kind = owned.schema["item"].dataType
    if not isinstance(kind, LongType):
        ids = keep(ranked(owned.select("item").unionByName(items.select("item")).distinct().where("item IS NOT NULL"), ["item"]).withColumn("rank", F.col("rank").cast("long")), "numbers")
        numbered = lambda df, *c: df.join(ids, "item").select(*c, F.col("rank").alias("item"))
        found = _together(numbered(owned, "owner"), numbered(items, "basket_id"), k, keep)
        return found.withColumnRenamed("item", "rank").join(ids, "rank").select("owner", "item", "score")
    spark = owned.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = keep(listed(items.select("basket_id", "item"), owned, n), "lists")
    counts = owned.agg(F.count("*").alias("rows"), F.count_distinct("owner").alias("owners")).first()
    waves = max(1, -(-counts.rows // WAVE))
    if waves == 1:
        return added_up(reaching(owned, lists), counts.owners, k)
    sums = []
    for wave in range(waves):
        release(spark)
        some = owned.where(F.pmod(F.xxhash64("owner"), F.lit(waves)) == wave)
        sums.append(keep(added_up(reaching(some, lists), -(-counts.owners // waves), k), "sums"))
    release(spark)
    return reduce(lambda a, b: a.unionByName(b), sums)


def cooccurrence_scores(mine: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(owner, rank, item, score): the k items not owned with the largest sum of co-occurrences with those owned, a stored table.

    All co-occurrences of an owner's items are added up, but they travel as packed lists, one for each item and count.
    """
    with Scratch() as keep:
        best = _together(keep(mine.select("owner", "item").distinct(), "owned"), items, k, keep)
        rank = F.row_number().over(W.partitionBy("owner").orderBy(F.desc("score"), "item"))
        return stored(best.select("owner", rank.alias("rank"), "item", "score"), "scores")
