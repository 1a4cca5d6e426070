"""Suffix order and common prefixes by recursive induced sorting, on arrays that live on disk when they are large.

S* suffixes (those that start a rise) are named by the substrings up to the next one; if names repeat,
their order comes from the same procedure on the string of names. From the ordered S* suffixes the
others are induced: a priority queue holds suffixes by first character, within it in the order of
arrival. Taking suffixes in order and queueing the one that starts a place earlier fills the L
queues from left to right, then the S queues from right to left. With each tuple goes the length of
its common prefix with the tuple before it in its queue: one more than the least value between the
two suffixes that queued them.

Queues are stretches of one array each. All tuples of a run of characters whose queues are complete
are taken a stretch at a time, so the work is done on whole arrays of at most STRETCH elements, and
the passes read and write the queues in order, which is what a disk is good at. Every array that
grows with the text is taken from a Space, which puts large ones into files, those by symbol too, as the names
of a recursion are its symbols: what stays in memory is a few stretches.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np

from .textblocks import ragged

#: Arrays with more bytes go to files in the task's temporary folder.
IN_MEMORY = 16 << 20
#: Names of a string that is sorted in memory, at the end of the recursion.
SHORT = 1 << 20
#: Of so many S* suffixes, one is compared with its predecessor from the start.
SAMPLE = 8
#: Elements that are worked on at a time.
STRETCH = 1 << 20


class Space:
    """Arrays in memory or, if large, in files without a name, which go away with the arrays."""

    def __init__(self, in_memory: int = IN_MEMORY):
        self.in_memory, self.on_disk = in_memory, 0

    def __enter__(self) -> Space:
        return self

    def __exit__(self, *_) -> None:
        pass

    def array(self, n: int, dtype) -> np.ndarray:
        size = n * np.dtype(dtype).itemsize
        if size <= self.in_memory or not n:
            return np.zeros(n, dtype)
        self.on_disk += size
        with tempfile.TemporaryFile(prefix="queues-") as f:
            return np.memmap(f, dtype, "w+", shape=(n,))

    def numbers(self, n: int) -> np.ndarray:
        """An array for places of a text of about n symbols."""
        return self.array(n, np.int32 if n < 2**31 - 16 else np.int64)


def stretches(n: int, start: int = 0) -> Iterator[tuple[int, int]]:
    """[from, to) of the stretches of a range."""
    for a in range(start, n, STRETCH):
        yield a, min(a + STRETCH, n)


def summed(space: Space, *parts: np.ndarray, start: int = 0) -> np.ndarray:
    """start, and the sums of the parts up to each place: one more element than they have."""
    out, so_far = space.array(len(parts[0]) + 1, np.int64), start
    out[0] = so_far
    for a, z in stretches(len(parts[0])):
        out[a + 1 : z + 1] = so_far + np.cumsum(sum(np.asarray(x[a:z], np.int64) for x in parts))
        so_far = int(out[z])
    return out


def copied(space: Space, values: np.ndarray) -> np.ndarray:
    out = space.array(len(values), np.int64)
    for a, z in stretches(len(values)):
        out[a:z] = values[a:z]
    return out


def counted(values: Iterator[np.ndarray], k: int, space: Space) -> np.ndarray:
    """How often each number under k occurs."""
    out = space.array(k, np.int64)
    for v in values:
        if k <= STRETCH:
            out += np.bincount(v, minlength=k)
        else:
            u, n = np.unique(v, return_counts=True)
            out[u] += n
    return out


def starts_of(sorted_values: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before it."""
    out = np.ones(len(sorted_values), bool)
    np.not_equal(sorted_values[1:], sorted_values[:-1], out=out[1:])
    return out


def sizes_of(starts: np.ndarray, n: int) -> np.ndarray:
    """The lengths of the runs that start at these places of n."""
    out = np.empty(len(starts), np.int64)
    np.subtract(starts[1:], starts[:-1], out=out[:-1])
    out[-1:] = n - starts[-1:]
    return out


def least_between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The minimum of values[lo..hi], both included, for many ranges."""
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    out = np.empty(len(lo), values.dtype)
    table, k = values, 0
    for want in range(int(level.max()) + 1 if len(lo) else 0):
        while k < want:
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
            k += 1
        at = np.flatnonzero(level == want)
        out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << want) + 1])
    return out


class Prefixes:
    """Common-prefix values carried with the queues: the least value passed since each queue's last arrival."""

    def __init__(self, k: int, cap: int):
        self.since, self.cap = np.full(k, cap, np.int64), cap

    def arrive(self, passed: np.ndarray, j: np.ndarray, queue: np.ndarray, first: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Values of arrivals sorted by queue. passed: values between the taken tuples; j: who queued each; fresh: its queue was empty."""
        value = np.zeros(len(j), np.int64)
        later = np.flatnonzero(~first)
        value[later] = least_between(passed, j[later - 1] + 1, j[later])
        heads = np.flatnonzero(first)
        upto = np.minimum.accumulate(passed)
        value[heads] = np.minimum(self.since[queue[heads]], upto[j[heads]])
        value = np.minimum(value + 1, self.cap)
        value[heads[fresh[heads]]] = 0
        after = np.full(len(passed) + 1, self.cap, np.int64)
        after[:-1] = np.minimum.accumulate(passed[::-1])[::-1]
        np.minimum(self.since, after[0], out=self.since)
        last = heads + sizes_of(heads, len(j)) - 1
        self.since[queue[last]] = after[j[last] + 1]
        return value

    def none(self, passed: np.ndarray) -> None:
        if len(passed):
            np.minimum(self.since, passed.min(), out=self.since)


def _complete(left: np.ndarray, c: int, step: int) -> int:
    """The first character from c on, in that direction, whose queue still waits for tuples."""
    width = 64
    while 0 <= c < len(left):
        part = left[c : c + width] if step > 0 else left[max(0, c - width + 1) : c + 1][::-1]
        found = np.flatnonzero(part)
        if len(found):
            return c + step * int(found[0])
        c += step * len(part)
        width = min(2 * width, STRETCH)
    return c


def _names(code: Callable[[np.ndarray], np.ndarray], at: np.ndarray, length: np.ndarray, base: int, rank: np.ndarray, done: int) -> np.ndarray:
    """Ranks of the substrings from at to at + length, by their symbols from `done` on, within their ranks so far; equal ones share a rank. None is the start of another."""
    m = len(at)
    rank, live = rank.copy(), np.arange(m)
    while len(live):
        take = max(1, int((62 - np.log2(m + 1)) // np.log2(base + 1)))
        key = rank[live]
        for s in range(done, done + take):
            inside = s <= length[live]
            key = key * (base + 1) + np.where(inside, code(np.where(inside, at[live] + s, 0)) + 1, 0)
        order = np.argsort(key, kind="stable")
        key, who = key[order], live[order]
        old = rank[who]
        starts = starts_of(key)
        first = np.maximum.accumulate(np.where(starts, np.arange(len(key)), 0))
        of_old = np.maximum.accumulate(np.where(starts_of(old), np.arange(len(key)), 0))
        rank[who] = old + first - of_old
        size = sizes_of(np.flatnonzero(starts), len(key))
        done += take
        live = who[np.repeat(size > 1, size) & (length[who] >= done)]
    return rank


def _star_ranks(code: Callable[[np.ndarray], np.ndarray], stars: np.ndarray, base: int, space: Space) -> np.ndarray:
    """The rank of the substring of each S* suffix, up to the next one; equal ones share a rank.

    More substrings than a stretch are dealt into groups by one symbol after another, on disk, until
    groups, or some next to each other, are small enough to be sorted in memory.
    """
    m = len(stars)
    rank, group, fresh = space.numbers(m), space.numbers(m), None
    for a, z in stretches(m):
        group[a:z] = np.arange(a, z)

    def length(i: np.ndarray) -> np.ndarray:
        return np.where(i < m - 1, stars[np.minimum(i + 1, m - 1)] - stars[i], 0).astype(np.int64)

    def solve(a: int, z: int, heads: np.ndarray, depth: int) -> None:
        """heads: where groups of equal symbols so far start."""
        who = np.asarray(group[a:z])
        within = np.zeros(z - a, np.int64)
        within[heads - a] = heads - a
        rank[who] = a + _names(code, stars[who].astype(np.int64), length(who), base, np.maximum.accumulate(within), depth)

    todo = [(0, m, 0)] if m else []
    while todo:
        a, z, depth = todo.pop()
        if z - a <= STRETCH:
            solve(a, z, np.array([a]), depth)
            continue
        one = np.asarray(group[a : a + 1])
        if length(one)[0] < depth:  # the group has ended, all at once, so all are equal
            for x, y in stretches(z, a):
                rank[group[x:y]] = a
            continue

        def symbols(x: int, y: int, depth: int = depth) -> np.ndarray:
            return code(stars[group[x:y]].astype(np.int64) + depth)

        size = counted((symbols(x, y) for x, y in stretches(z, a)), base, space)
        begin = summed(space, size, start=a)
        fresh = space.numbers(m) if fresh is None else fresh
        head = copied(space, begin[:-1])
        for x, y in stretches(z, a):
            s = symbols(x, y)
            by = np.argsort(s, kind="stable")
            s = s[by]
            first = np.flatnonzero(starts_of(s))
            n = sizes_of(first, len(s))
            fresh[head[s] + np.arange(len(s)) - np.repeat(first, n)] = np.asarray(group[x:y])[by]
            head[s[first]] += n
        for x, y in stretches(z, a):
            group[x:y] = fresh[x:y]
        c = 0
        while c < base:
            d = int(np.searchsorted(begin, begin[c] + STRETCH, "right")) - 1
            if d <= c:
                todo.append((int(begin[c]), int(begin[c + 1]), depth + 1))
                c += 1
                continue
            d = min(d, base, c + STRETCH)
            if begin[d] > begin[c]:
                solve(int(begin[c]), int(begin[d]), begin[c:d][size[c:d] > 0], depth + 1)
            c = d
    return rank


def _types(text: np.ndarray, space: Space) -> tuple[np.ndarray, np.ndarray]:
    """Whether the next other symbol is larger, and how many equal ones follow one another, at each place."""
    n = len(text)
    rises, run = space.array(n, bool), space.array(n, np.int16)
    rises[n - 1], run[n - 1] = True, 1
    for a, z in reversed(list(stretches(n - 1))):
        step = np.sign(np.diff(text[a : z + 1].astype(np.int64)))
        i = np.arange(z - a)
        change = np.minimum.accumulate(np.where(step != 0, i, z - a)[::-1])[::-1]
        inside = change < z - a
        rises[a:z] = np.where(inside, step[np.minimum(change, z - a - 1)] > 0, rises[z])
        run[a:z] = np.minimum(np.where(inside, change - i + 1, z - a - i + int(run[z])), np.iinfo(np.int16).max)
    return rises, run


def doubled(text: np.ndarray) -> np.ndarray:
    """The suffixes of a short text that ends with its only least number, in order: by their first 1, 2, 4, ... symbols."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    starts = starts_of(text[order])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    ahead = 1
    live = order[np.repeat((size := sizes_of(np.flatnonzero(starts), n)) > 1, size)]
    while len(live):
        key = rank[live] * (n + 1) + rank[np.minimum(live + ahead, n - 1)] + 1
        by = np.argsort(key, kind="stable")
        key, live = key[by], live[by]
        old, starts = rank[live], starts_of(key)
        first = np.maximum.accumulate(np.where(starts, np.arange(len(key)), 0))
        of_old = np.maximum.accumulate(np.where(starts_of(old), np.arange(len(key)), 0))
        rank[live] = old + first - of_old
        live = live[np.repeat((size := sizes_of(np.flatnonzero(starts), len(key))) > 1, size)]
        ahead *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def suffix_order(text: np.ndarray, k: int, space: Space, prefix=None, cap: int = 0) -> tuple[np.ndarray, np.ndarray | None]:
    """The suffixes of text in order, and the common prefix of each with the one before it, up to cap (under 2 ** 15).

    text: numbers under k that end with the only 0. prefix(i, j, known): common prefixes of the suffixes
    at i and j, of which so many symbols are known to agree, needed for the S* suffixes; without it,
    no prefixes are carried.
    """
    n = len(text)
    rises, run = _types(text, space)

    def star(a: int, z: int) -> np.ndarray:  # of the places from a on, a > 0
        return a + np.flatnonzero(rises[a:z] & ~rises[a - 1 : z - 1])

    m = sum(len(star(a, z)) for a, z in stretches(n, 1))
    stars, done = space.numbers(m), 0
    for a, z in stretches(n, 1):
        found = star(a, z)
        stars[done : done + len(found)] = found
        done += len(found)
    index = _star_order(text, rises, stars, k, space)
    order = space.numbers(m)
    for a, z in stretches(m):
        order[a:z] = stars[index[a:z]]

    count = counted((text[a:z] for a, z in stretches(n)), k, space)
    falls = counted((text[a:z][~rises[a:z]] for a, z in stretches(n)), k, space)
    star_count = counted((text[order[a:z]] for a, z in stretches(m)), k, space)
    at = summed(space, falls, star_count)
    scan = space.numbers(int(at[-1]))
    lcp = space.array(len(scan), np.int16) if prefix is not None else None
    ahead = summed(space, star_count)
    star_lcp = _star_prefixes(order, index, stars, run, prefix, space) if prefix is not None else None
    for a, z in stretches(m):
        of = text[order[a:z]]
        place = at[of] + falls[of] + np.arange(a, z) - ahead[of]
        scan[place] = order[a:z]
        if prefix is not None:
            lcp[place] = star_lcp[index[a:z]]
    carried = None
    if prefix is not None:
        for a, z in stretches(k):
            there = star_count[a:z] > 0
            lcp[(at[a:z] + falls[a:z])[there]] = 0
        carried = Prefixes(k, cap)
    del order, index, stars, star_lcp, ahead

    def seams(lo: int, hi: int, begin: np.ndarray, others: np.ndarray, row: np.ndarray, values: np.ndarray) -> None:
        """Between the last L and the first S suffix of a character that has both: the shorter of their runs of it."""
        for a, z in stretches(hi, lo):
            s = (begin[a:z] + falls[a:z])[(falls[a:z] > 0) & (others[a:z] > 0)]
            values[s] = np.minimum(np.minimum(run[row[s]], run[row[s - 1]]), cap)

    # L suffixes, from left to right
    head, wait = copied(space, at[:-1]), copied(space, falls)

    def take_left(start: int, end: int) -> None:
        for a, z in stretches(end, start):
            left_of(a, z)

    def left_of(a: int, z: int) -> None:
        prev = np.asarray(scan[a:z]) - 1
        j = np.flatnonzero(~rises[prev])
        if not len(j):
            if carried:
                carried.none(lcp[a:z])
            return
        new = prev[j]
        queue = text[new]
        by = np.argsort(queue, kind="stable")
        queue, new, j = queue[by].astype(np.int64), new[by], j[by]
        first = starts_of(queue)
        start = np.flatnonzero(first)
        size = sizes_of(start, len(queue))
        slot = head[queue] + np.arange(len(queue)) - np.repeat(start, size)
        scan[slot] = new
        if carried:
            lcp[slot] = carried.arrive(lcp[a:z], j, queue, first, head[queue] == at[queue])
        head[queue[start]] += size
        wait[queue[start]] -= size

    c = 0
    while c < k:
        to = _complete(wait, c, 1)
        if to > c:
            if carried:
                seams(c, to, at, star_count, scan, lcp)
            take_left(int(at[c]), int(at[to]))
            c = to
            continue
        a = int(at[c])
        while (z := int(head[c])) > a:
            take_left(a, z)
            a = z
        if carried:
            seams(c, c + 1, at, star_count, scan, lcp)
        take_left(int(at[c] + falls[c]), int(at[c + 1]))
        c += 1

    # S suffixes, from right to left
    del head, wait, star_count
    begin = summed(space, count)
    out = space.numbers(n)
    values = space.array(n + 1, np.int16) if prefix is not None else None
    upto, c = summed(space, falls), 0
    while c < k:  # some characters with few L suffixes at once, or one with many by stretches
        d = min(max(c + 1, int(np.searchsorted(upto, upto[c] + STRETCH, "right")) - 1), c + STRETCH)
        parts = [ragged(falls[c:d])] if upto[d] - upto[c] <= STRETCH else ((0, np.arange(x, y)) for x, y in stretches(int(falls[c])))
        for row, i in parts:
            row = row + c
            out[begin[row] + i] = scan[at[row] + i]
            if prefix is not None:
                values[begin[row] + i] = lcp[at[row] + i]
        c = d
    if prefix is not None:
        carried = Prefixes(k, cap)
    del scan, lcp, upto, at
    rest = count  # those of each character that rise
    for a, z in stretches(k):
        rest[a:z] -= falls[a:z]
    tail, wait = copied(space, begin[1:]), copied(space, rest)
    out[0] = n - 1
    tail[0] -= 1
    wait[0] -= 1

    def take_right(start: int, end: int) -> None:
        for x, y in stretches(end - start):
            right_of(end - y, end - x)

    def right_of(a: int, z: int) -> None:
        prev = np.asarray(out[a:z])[::-1] - 1
        passed = values[a + 1 : z + 1][::-1] if carried else None
        j = np.flatnonzero(rises[prev] & (prev >= 0))
        if not len(j):
            if carried:
                carried.none(passed)
            return
        new = prev[j]
        queue = text[new]
        by = np.argsort(queue, kind="stable")
        queue, new, j = queue[by].astype(np.int64), new[by], j[by]
        first = starts_of(queue)
        start = np.flatnonzero(first)
        size = sizes_of(start, len(queue))
        slot = tail[queue] - 1 - np.arange(len(queue)) + np.repeat(start, size)
        out[slot] = new
        if carried:
            fresh = tail[queue] == begin[queue + 1]
            got = carried.arrive(passed, j, queue, first, fresh)
            values[slot + 1] = got
        tail[queue[start]] -= size
        wait[queue[start]] -= size

    c = k - 1
    while c >= 0:
        to = _complete(wait, c, -1)
        if to < c:
            if carried:
                seams(to + 1, c + 1, begin, rest, out, values)
            take_right(int(begin[to + 1]), int(begin[c + 1]))
            c = to
            continue
        z = int(begin[c + 1])
        while (a := int(tail[c])) < z:
            take_right(a, z)
            z = a
        if carried:
            seams(c, c + 1, begin, rest, out, values)
        take_right(int(begin[c]), int(begin[c] + falls[c]))
        c -= 1
    return out, values[:n] if values is not None else None


def _star_prefixes(order: np.ndarray, index: np.ndarray, stars: np.ndarray, run: np.ndarray, prefix, space: Space) -> np.ndarray:
    """By place in stars: the common prefix of each S* suffix with the one before it in order.

    One in SAMPLE is compared from its start. Another one starts d symbols after such a one; d symbols
    after that one's predecessor there is an S* suffix too, if the common prefix reaches beyond the
    run of equal symbols there, and a smaller one, so all of the prefix but d symbols is known to agree.
    """
    m = len(stars)
    before, out = space.numbers(m), space.array(m, np.int16)
    least = int(index[0]) if m else 0
    for a, z in stretches(m, 1):
        before[index[a:z]] = order[a - 1 : z - 1]
    for a, z in stretches(-(-m // SAMPLE)):
        k = np.arange(a, z) * SAMPLE
        k = k[k != least]
        out[k] = prefix(before[k], stars[k], np.zeros(len(k), np.int64))
    for a, z in stretches(m):
        k = np.arange(a, z)
        k = k[(k % SAMPLE > 0) & (k != least)]
        s = k // SAMPLE * SAMPLE
        known = out[s] - (stars[k] - stars[s]).astype(np.int64)
        known[known <= run[stars[k]]] = 0
        out[k] = prefix(before[k], stars[k], known)
    return out


def _star_order(text: np.ndarray, rises: np.ndarray, stars: np.ndarray, k: int, space: Space) -> np.ndarray:
    """The places in stars of the S* suffixes in order: by their names, or by the same sorting of the string of names."""

    def code(i: np.ndarray) -> np.ndarray:
        return 2 * text[i].astype(np.int64) + rises[i]

    m = len(stars)
    rank = _star_ranks(code, stars, 2 * k, space)
    there = space.array(m, bool)
    for a, z in stretches(m):
        there[rank[a:z]] = True
    name, names = space.numbers(m), 0
    for a, z in stretches(m):  # of each rank that occurs, its number among those
        name[a:z] = names + np.cumsum(there[a:z]) - there[a:z]
        names += int(there[a:z].sum())
    if names == m:
        order = space.numbers(m)
        for a, z in stretches(m):
            order[rank[a:z]] = np.arange(a, z)
        return order
    for a, z in stretches(m):
        rank[a:z] = name[rank[a:z]]
    del there, name
    return doubled(np.asarray(rank)) if m <= SHORT else suffix_order(rank, names, space)[0]


def repeated_starts(data: np.ndarray, offsets: np.ndarray, length: int, in_memory: int = IN_MEMORY) -> np.ndarray:
    """For each byte: whether the `length` bytes from it, inside its text, also start at another byte of any text.

    data: texts back to back, in memory or in a file; offsets: where each starts.
    """
    n = len(data) + len(offsets) - 1  # a mark follows each text
    with Space(in_memory) as space:
        raw, text, left = space.array(n + 8, np.uint8), space.array(n + 1, np.uint16), space.array(n + 1, np.int16)
        used = np.flatnonzero(counted((data[a:z] for a, z in stretches(len(data))), 256, space))
        code = np.zeros(256, np.uint16)
        code[used] = np.arange(len(used)) + 2
        for a, z in stretches(n):
            text[a:z] = 1

        def places(a: int, z: int) -> np.ndarray:
            lo, hi = np.searchsorted(offsets, [a, z - 1], "right") - 1  # the texts of the first and the last byte
            return np.arange(a, z) + np.repeat(np.arange(lo, hi + 1), np.diff(np.clip(offsets[lo : hi + 2], a, z)))

        for a, z in stretches(len(data)):
            at, i = places(a, z), np.arange(a, z)
            raw[at] = data[a:z]
            text[at] = code[data[a:z]]
            left[at] = np.minimum(offsets[at - i + 1] - i, length)
        eights = np.ndarray((n + 1,), "<u8", raw, strides=(1,))

        def prefix(i: np.ndarray, j: np.ndarray, known: np.ndarray) -> np.ndarray:
            i, j = i.astype(np.int64), j.astype(np.int64)
            out = known.copy()
            most = np.minimum(left[i], left[j]).astype(np.int64)
            live, words = np.flatnonzero(out < most), 1
            while len(live):  # 8 bytes first, then 64 at a time
                ahead = out[live, None] + 8 * np.arange(words)
                ahead = np.minimum(ahead, n - np.maximum(i[live], j[live])[:, None])  # inside the array; beyond `most` anyway
                x = eights[i[live, None] + ahead] ^ eights[j[live, None] + ahead]
                differs = x != 0
                at = differs.argmax(1)
                same = differs[np.arange(len(live)), at]
                x = x[np.arange(len(live)), at]
                low = x & (~x + np.uint64(1))
                out[live] += np.where(same, 8 * at + (np.frexp(low.astype(np.float64))[1] - 1) // 8, 8 * words)
                live, words = live[~same & (out[live] < most[live])], 8
            return np.minimum(out, most)

        order, lcp = suffix_order(text, len(used) + 2, space, prefix, length)
        hit, out = space.array(n + 1, bool), space.array(len(data), bool)
        for a, z in stretches(n + 1, 1):
            same = a + np.flatnonzero(lcp[a:z] >= length)
            one, two = order[same], order[same - 1]
            both = (left[one] >= length) & (left[two] >= length)  # marks between texts are no match
            hit[one[both]] = True
            hit[two[both]] = True
        for a, z in stretches(len(data)):
            out[a:z] = hit[places(a, z)]
        return out
