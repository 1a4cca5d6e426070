"""MinHash near-duplicate groups with sequential Bayesian verification.

1. Each text becomes the set of its word shingles; equal sets are one class from here on.
2. Classes whose MinHash signatures agree in all rows of a band share a bucket. At a similarity of
   0.8, 32 bands of 4 rows miss a pair with a probability of 5e-8.
3. Candidates are compared one batch of signature rows after another. After m of n rows agree, the
   posterior of the similarity (uniform prior) is Beta(m + 1, n - m + 1); the pair is dropped as soon
   as the chance that it reaches the threshold falls under MISS.
4. Survivors are verified on their full sets, in whole numbers.

No bucket is expanded into rows of pairs: first each member is compared with the smallest id of its
bucket, and links join them into components. Then members of a bucket that are still in different
components are compared, block by block inside tasks. A bucket with more than WIDE members outside
its main component is first split by a second band, and what is still as wide by a third, as a first
pass. Then the members of such buckets that are still apart meet whole: in blocks if no more
than WIDE are left outside, else by their rare shingles, of which alike sets share one. So a pair
that agrees in one band is compared however wide its bucket is. Blocks see signatures only; the sets
of members with a plausible partner follow, and tasks put out only links that join components.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import connected
from .tables import discard, free_names, partitions, quoted, stored
from .textblocks import LOWER, M1, block_of, hash_spans, mix, ragged, shingles_of, slices, words_of

BANDS, ROWS = 32, 4
#: Rows compared before each look at the posterior, and the chance to miss a true pair at each look.
BATCH, MISS = 16, 1e-6
#: Bytes of text hashed at a time: what fits in a processor's cache.
CACHED = 1 << 18
#: Members of a block of a bucket, and pairs that a task compares at a time.
GROUP, PAIRS = 512, 100_000
#: Members outside the main component beyond which a bucket is split by another band, and bands of the last split.
WIDE, DEPTH = 2048, 3

_random = np.random.default_rng(20)
MULTIPLY = _random.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _random.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def row_number() -> Column:
    """The id, never null; with the hash of the text it names a row."""
    return F.coalesce("doc_id", F.lit(-(2**63)))


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts in a row, offsets). A-Z are lower-cased."""
    data, offsets = block_of(texts)
    data = LOWER[data]
    starts, ends, before = words_of(data, offsets)
    h, upto = shingles_of(hash_spans(data, starts, ends), before, k)
    for a, z in zip(upto[:-1].tolist(), upto[1:].tolist()):
        h[a:z].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[upto[:-1][np.diff(upto) > 0]] = True
    return h[new], np.r_[0, np.cumsum(new)][upto]


def signatures(sets: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """A row of 16-bit MinHash values for each set that is not empty."""
    first = upto[:-1][np.diff(upto) > 0]
    out = np.empty((len(first), BANDS * ROWS), np.uint16)
    if len(first):
        for j in range(BANDS * ROWS):
            least = np.minimum.reduceat(sets * MULTIPLY[j] + ADD[j], first)
            out[:, j] = (mix(least) >> np.uint64(48)).astype(np.uint16)
    return out


def signed(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, t1, n_shingles, c1, c2, sig): a hash of the text, one of 128 bits of the set, and the signature as bytes; null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=CACHED):
            sets, upto = shingle_sets(b.column("text"), k)
            n = np.diff(upto)
            some = n > 0
            hashes = np.zeros((2, len(n)), np.uint64)
            if some.any():
                for i in range(2):
                    hashes[i, some] = np.add.reduceat(mix(sets + np.uint64((i + 1) * int(M1) % 2**64)), upto[:-1][some])
            sig = np.zeros((len(n), BANDS * ROWS), np.uint16)
            sig[some] = signatures(sets, upto)
            raw = [x.tobytes() if y else None for x, y in zip(sig, some)]
            yield pa.record_batch([b.column("doc_id"), b.column("t1"), pa.array(n), pa.array(hashes[0].view(np.int64)), pa.array(hashes[1].view(np.int64)), pa.array(raw, pa.binary())], ["doc_id", "t1", "n_shingles", "c1", "c2", "sig"])

    return docs.select("doc_id", "text", text_hash().alias("t1")).mapInArrow(run, "doc_id long, t1 long, n_shingles long, c1 long, c2 long, sig binary")


def least_matches(threshold: float, miss: float = MISS) -> np.ndarray:
    """For each number of compared rows: the fewest matches with which the posterior still gives the threshold a chance of `miss`."""

    def chance(m: int, n: int) -> float:  # P(similarity >= threshold | m of n), by the binomial form of the beta distribution
        return sum(comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))

    return np.array([next(m for m in range(n + 1) if chance(m, n) >= miss) for n in range(1, BANDS * ROWS + 1)])


def not_ruled_out(sig: np.ndarray, i: np.ndarray, j: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which of the pairs of rows (i, j) of sig survive all batches."""
    live, matches = np.arange(len(i)), np.zeros(len(i), np.int64)
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        matches = matches + (sig[i[live], n - BATCH : n] == sig[j[live], n - BATCH : n]).sum(1)
        ok = matches >= need[n - 1]
        live, matches = live[ok], matches[ok]
    return live


def _matrix(sigs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sigs.to_pylist()), np.uint16).reshape(len(sigs), -1)


def plausible(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose signatures are not ruled out, batch after batch."""
    sigs = classes.select("id", "sig")
    both = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    need = least_matches(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            n = x.num_rows
            if n:
                live = pa.array(not_ruled_out(np.concatenate([_matrix(x.column(c)) for c in ("sa", "sb")]), np.arange(n), np.arange(n) + n, need))
                yield pa.record_batch([x.column(c).take(live) for c in ("a", "b")], ["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


class Joined:
    """Components that the links found so far have made one; holds an entry for each link only."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, c: int) -> int:
        path = []
        while c in self.up:
            path.append(c)
            c = self.up[c]
        for x in path[:-1]:
            self.up[x] = c
        return c


def alike(u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets."""
    i = np.searchsorted(v, u)
    common = int((v[np.minimum(i, len(v) - 1)] == u).sum())
    return 100 * common >= percent * (len(u) + len(v) - common)


def mixed(rows: DataFrame) -> tuple[DataFrame, bool]:
    """The rows (key, path, id, n, c) of buckets with more than one component, with others and m_main: members outside and in the main one; and whether any is wide."""
    per_component = rows.groupBy("key", "c").agg(F.count("*").alias("n_c"))
    sizes = per_component.groupBy("key").agg(F.sum("n_c").alias("m"), F.max(F.struct("n_c", "c")).alias("most"), F.count("*").alias("times")).where("times > 1")
    sizes = stored(sizes.select("key", (F.col("m") - F.col("most.n_c")).alias("others"), F.col("most.n_c").alias("m_main"), F.col("most.c").alias("main")), "bucket-sizes")
    return rows.join(sizes, "key"), not sizes.where(F.col("others") > WIDE).isEmpty()


def split_by_band(rows: DataFrame, sigs: DataFrame) -> DataFrame:
    """Buckets split by each band after the last one of their path: (key, path, id, n, c), a row for each such band."""
    after = f"sequence(cast(floor(log2(path)) AS int) + 1, {BANDS - 1})"
    keys = F.expr(f"transform({after}, i -> struct(xxhash64(key, i, substring(sig, {2 * ROWS} * i + 1, {2 * ROWS})) AS key, path + shiftleft(1L, i) AS path))")
    each = rows.where(F.col("path") < 1 << (BANDS - 1)).join(sigs, "id").select("id", "n", "c", F.explode(keys).alias("k"))
    return each.select("k.key", "k.path", "id", "n", "c")


def split_by_shingle(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members of buckets by their rare shingles: (key, path, id, n, c), a row for each; path is 0.

    Shingles have one order for all sets, the rarest first. The first one that two sets have in common stands
    among the first floor((100 - percent) * n / 100) + 1 of both if they are alike, so no link is lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for b in slices(iter([x]), "set", CACHED):
                data, offsets = block_of(b.column("set"))
                row = pa.array(np.repeat(np.arange(b.num_rows), np.diff(offsets) // 8))
                yield pa.record_batch([pa.array(data[:-8].view(np.int64)), *(b.column(k).take(row) for k in ("id", "n", "c"))], ["key", "id", "n", "c"])

    members = rows.select("id", "n", "c").dropDuplicates(["id"])
    each = stored(members.join(sets, "id").select("id", "n", "c", "set").mapInArrow(run, "key long, id long, n long, c long"), "shingles")
    times = stored(each.groupBy("key").agg(F.count("*").alias("times")), "shingle-counts")
    place = F.row_number().over(W.partitionBy("id").orderBy("times", "key"))
    some = each.join(times, "key").withColumn("place", place).where((F.col("times") > 1) & (F.col("place") <= F.floor((100 - percent) * F.col("n") / 100) + 1))
    return some.select("key", F.lit(0).cast("long").alias("path"), "id", "n", "c")


def dealt_blocks(rows: DataFrame) -> DataFrame:
    """(g, left, both, path, id, n, c): members of buckets dealt into groups of two blocks, or of one (both) whose own members meet.

    Members outside the main component meet each other and all of the main one, whose members don't meet.
    """

    def hashed(n):  # the number of one of n blocks
        return F.pmod(F.xxhash64("id", F.lit(7)), n).cast("int")

    sized = rows.withColumns({"o": F.ceil(F.col("others") / GROUP).cast("int"), "m": F.ceil(F.col("m_main") / GROUP).cast("int")})
    own = sized.withColumn("x", F.when(F.col("c") == F.col("main"), F.col("o") + hashed(F.col("m"))).otherwise(hashed(F.col("o"))))
    meets = F.when(F.col("c") == F.col("main"), F.col("o")).otherwise(F.col("o") + F.col("m"))
    each = own.withColumn("y", F.explode(F.sequence(F.lit(0), meets - 1)))
    return each.select(F.xxhash64("key", F.least("x", "y"), F.greatest("x", "y")).alias("g"), (F.col("x") <= F.col("y")).alias("left"), (F.col("x") == F.col("y")).alias("both"), "path", "id", "n", "c")


def _pairs_of(t: pa.Table, percent: int, need: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of groups g, in order of g, between components, whose signatures are not ruled out and whose first agreeing bands are the path; any band, if it is 0."""
    g, left, both, path, n, c = (t.column(k).to_numpy() for k in ("g", "left", "both", "path", "n", "c"))
    sig = _matrix(t.column("sig").combine_chunks())
    head = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    size = np.diff(np.r_[head, len(g)])
    row = np.repeat(head + size, size) - np.arange(len(g)) - 1  # rows after it in its group
    upto = np.cumsum(row)
    top = 1 << np.frexp(path.astype(np.float64))[1].astype(np.int64)
    at = 0
    while at < len(g):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        k, d = ragged(row[at:to])
        i = k + at
        j = i + 1 + d
        use = (both[i] | (left[i] != left[j])) & (c[i] != c[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        i, j = i[use], j[use]
        live = not_ruled_out(sig, i, j, need)
        i, j = i[live], j[live]
        agree = (sig[i] == sig[j]).reshape(-1, BANDS, ROWS).all(2) @ (1 << np.arange(BANDS, dtype=np.int64))
        first = ((agree & (top[i] - 1)) == path[i]) & (agree > 0)
        yield i[first], j[first]
        at = to


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches, sorted by g, cut where g changes."""
    rest = None
    for x in batches:
        if not x.num_rows:
            continue
        t = pa.Table.from_batches([x]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([x])])
        g = t.column("g").to_numpy()
        cut = int(np.searchsorted(g, g[-1]))  # the last group may go on in the next batch
        rest = t.slice(cut)
        if cut:
            yield t.slice(0, cut)
    if rest is not None:
        yield rest


def partnered(dealt: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """The rows of dealt blocks, with sig, that have a plausible partner in their group."""
    need = least_matches(percent / 100)
    names = ["g", "left", "both", "path", "id", "n", "c", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_group(batches):
            some = np.zeros(t.num_rows, bool)
            for i, j in _pairs_of(t, percent, need):
                some[i] = some[j] = True
            if some.any():
                yield from t.filter(pa.array(some)).combine_chunks().to_batches()

    rows = dealt.join(sigs, "id").select(names).repartition(partitions(dealt.sparkSession), "g").sortWithinPartitions("g")
    return rows.mapInArrow(run, "g long, left boolean, both boolean, path long, id long, n long, c long, sig binary")


def links_between(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components of partnered rows, verified on the full sets.

    A pair is not verified if links of the same task already join its components, so a task puts out
    at most a link for each component it saw.
    """
    need = least_matches(percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = Joined()
        for t in _by_group(batches):
            ids, c = t.column("id").to_numpy(), t.column("c").to_numpy()
            full = t.column("set").combine_chunks()
            out = []
            for i, j in _pairs_of(t, percent, need):
                for x, y in zip(i.tolist(), j.tolist()):
                    cx, cy = joined.root(int(c[x])), joined.root(int(c[y]))
                    if cx != cy and alike(*(np.frombuffer(full[q].as_buffer(), np.uint64) for q in (x, y)), percent):
                        joined.up[max(cx, cy)] = min(cx, cy)
                        out.append(sorted((int(ids[x]), int(ids[y]))))
            yield pa.record_batch([pa.array([p[q] for p in out], pa.int64()) for q in range(2)], ["a", "b"])

    whole = rows.join(sets, "id").repartition(partitions(rows.sparkSession), "g").sortWithinPartitions("g")
    return whole.select("g", "left", "both", "path", "id", "n", "c", "sig", "set").mapInArrow(run, "a long, b long")


def found_links(dealt: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links of dealt blocks, a stored table."""
    rows = stored(partnered(dealt, sigs, percent), "partnered")
    links = stored(links_between(rows, sets, percent), "links-between")
    discard(rows)
    return links


def links_of_bands(rows: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """Links (a, b) between components of buckets (key, path, id, n, c), and the keys of wide ones, None if there are none.

    Wide buckets are split by further bands, so their links are not all there.
    """
    (now, wide), dealt, keys = mixed(rows), None, None
    if wide:
        keys = stored(now.where(F.col("others") > WIDE).select("key").distinct(), "wide-keys")
    for depth in range(1, DEPTH + 1):
        split = wide and depth < DEPTH
        some = dealt_blocks(now.where(F.col("others") <= WIDE) if split else now)
        dealt = some if dealt is None else dealt.unionByName(some)
        if not split:
            break
        now, wide = mixed(stored(split_by_band(now.where(F.col("others") > WIDE), sigs), "wide-buckets"))
    return found_links(dealt, sigs, sets, percent), keys


def links_of_rest(rows: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All links (a, b) between components of buckets (key, path, id, n, c) of any width."""
    now, wide = mixed(rows)
    if not wide:
        return found_links(dealt_blocks(now), sigs, sets, percent)
    by_shingle = stored(split_by_shingle(now.where(F.col("others") > WIDE), sets, percent), "rare-shingles")
    return found_links(dealt_blocks(now.where(F.col("others") <= WIDE)).unionByName(dealt_blocks(mixed(by_shingle)[0])), sigs, sets, percent)


def joined_by(links: DataFrame, groups: DataFrame) -> DataFrame:
    """groups (id, component) of all ids, with one name for those that links (a, b) join; a stored table."""
    own = lambda x: groups.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
    between = links.join(own("a"), "a").join(own("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    names = connected(between).select(F.col("id").alias("component"), F.col("component").alias("root"))
    return stored(groups.join(names, "component", "left").select("id", F.coalesce("root", "component").alias("component")), "groups")


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = pa.array([alike(*(np.frombuffer(q.as_buffer(), np.uint64) for q in two), percent) for two in zip(x.column("sa"), x.column("sb"))], pa.bool_())
            yield pa.record_batch([x.column("a").filter(ok), x.column("b").filter(ok)], ["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(id, set) of the shingles of the wanted classes (id, doc_id, t1), from the text of the row that stands for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=CACHED):
            sets, upto = shingle_sets(b.column("text"), k)
            yield pa.record_batch([b.column("id"), pa.array([sets[x:y].tobytes() for x, y in zip(upto[:-1].tolist(), upto[1:].tolist())], pa.binary())], ["id", "set"])

    rows = docs.select(row_number().alias("row"), text_hash().alias("t1"), "text").join(wanted.select("id", row_number().alias("row"), "t1"), ["row", "t1"]).dropDuplicates(["id"])
    return rows.select("id", "text").mapInArrow(run, "id long, set binary")


def _grouped(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t1, n_shingles, c1, c2) of every row, and (c1, c2, component, component_id) of every set that is not empty."""
    marked = stored(signed(docs, k), "signatures")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "t1")).alias("one")
    reps = marked.where("n_shingles > 0").groupBy("c1", "c2").agg(one, F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    classes = stored(reps.select(F.monotonically_increasing_id().alias("id"), "c1", "c2", "one.doc_id", "one.t1", "n", "sig"), "classes")
    sigs = classes.select("id", "sig")
    bands = F.posexplode(F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(sig, {2 * ROWS} * i + 1, {2 * ROWS})))"))
    rows = classes.select("id", "n", bands.alias("band", "key"))
    shared = stored(rows.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("id", "n")).alias("star")).where("m > 1").select("key", "star"), "shared-buckets")
    bucket = stored(rows.join(shared, "key"), "buckets")
    sets = stored(_sets(docs, classes.select("id", "doc_id", "t1").join(bucket.select("id").distinct(), "id", "left_semi"), k), "sets")

    def fits(x, y):
        return (100 * F.least(x, y) >= percent * F.greatest(x, y))

    stars = stored(bucket.where((F.col("star.id") != F.col("id")) & fits(F.col("n"), F.col("star.n"))).select(F.col("star.id").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    first = stored(similar(plausible(stars, classes, percent / 100), sets, percent), "first-links")
    groups = stored(classes.select("id").join(connected(first), "id", "left").select("id", F.coalesce("component", "id").alias("component")), "groups")

    def labelled(rows):
        return rows.select("key", F.expr("shiftleft(1L, band)").alias("path"), "id", "n").join(groups.select("id", F.col("component").alias("c")), "id")

    second, wide = links_of_bands(labelled(bucket), sigs, sets, percent)
    if not second.isEmpty():
        groups = joined_by(second, groups)
    if wide is not None:
        rest = links_of_rest(labelled(bucket.join(wide, "key", "left_semi")), sigs, sets, percent)
        if not rest.isEmpty():
            groups = joined_by(rest, groups)
    of_class = stored(classes.select("id", "c1", "c2", "doc_id").join(groups, "id").select("c1", "c2", "doc_id", "component"), "class-components")
    least = stored(of_class.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component-ids")
    of_class = stored(of_class.drop("doc_id").join(least, "component"), "set-components")
    discard(classes, shared, bucket, sets, stars, first, groups, second, least)
    return marked.drop("sig"), of_class


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs (doc_id, text).

    Texts are linked if 100 * |intersection| >= percent * |union| of their sets of k-word shingles.
    component_id is the smallest doc_id that can be reached; kept marks the rows of that id. A null,
    empty or wordless text has an empty set and is its own group. Each row is linked by its own
    text, rows that repeat an id too. A row without doc_id is linked like others, but names no group:
    where no row of a group has one, component_id is null and its rows are kept.
    """
    marked, of_class = _grouped(docs, k, percent)
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return marked.join(of_class, ["c1", "c2"], "left").select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, of which one of each near-duplicate group is left: that with the smallest doc_id, then hash of the text.

    Rows without doc_id stay only where no other of their group has one. Texts without words are
    groups of their own; rows with the same doc_id and text are one. Columns of docs may have any names.
    """
    marked, of_class = _grouped(docs, k, percent)
    rows = marked.join(of_class.select("c1", "c2", "component"), ["c1", "c2"], "left")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "t1")).alias("one")
    kept = rows.where("n_shingles > 0").groupBy("component").agg(one).select("one.doc_id", "one.t1").unionByName(rows.where("n_shingles = 0").select("doc_id", "t1").distinct())
    own = free_names(docs.columns, 2)
    kept = stored(kept.select(row_number().alias(own[0]), F.col("t1").alias(own[1])), "kept-rows")
    keyed = docs.withColumns(dict(zip(own, (row_number(), text_hash()))))
    return keyed.join(kept, own, "left_semi").dropDuplicates(own).select(*[quoted(c) for c in docs.columns])


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of documents by 4-word shingles."""
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4)
