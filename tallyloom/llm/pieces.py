"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

Encoding starts from characters and keeps an agenda of neighbouring pairs whose union is a piece of
the vocabulary; the best-scored one (then the leftmost) is merged until none is left. With
merge-dropout a candidate is skipped when the keyed hash of (seed, document, place of the chunk, left
piece, right piece, position) falls under the dropout rate: the same text gives other segmentations for other seeds,
always the same for one seed. Characters outside the vocabulary become byte pieces.

The pieces of such a vocabulary never hold a space mark after another character, so merges stay
within a chunk: a run of spaces and the characters up to the next space. Every occurrence draws its own
skips. Equal chunks of a block are encoded once without dropout, which gives their candidates; the
occurrences that skip none of these share that encoding, all others are merged again, in step.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .packing import tokenizer_path
from .textblocks import M1, Index, block_of, hash_spans, mix, ragged, slices

DROPOUT = 0.1
SEED = 17
#: Chunks with more characters are merged one by one, with a heap, in n log n steps.
LONG_CHUNK = 48
#: Characters or candidates of occurrences that are worked on at a time.
PART = 1 << 20
#: Bytes of text encoded at a time: equal chunks of them are encoded once.
BLOCK = 4 << 20
MARK = "▁"
NONE = np.iinfo(np.int32).max

_vocabularies: dict[str, Vocabulary] = {}


class Vocabulary:
    """Pieces, scores as ranks (lower merges first) and the pairs that merge."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        normal = {names[i]: i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        if any(MARK in x.lstrip(MARK) for x in normal):
            raise ValueError("a piece holds a space mark inside")
        self.byte0 = next(i for i in range(n) if sp.is_byte(i))
        order = sorted(normal.values(), key=lambda i: (-sp.get_score(i), i))
        self.rank = np.full(n, NONE, np.int32)
        self.rank[order] = np.arange(len(order))
        self.of_rank = np.array(order, np.int32)
        pairs = sorted((normal[x[:k]] * n + normal[x[k:]], self.rank[i]) for x, i in normal.items() for k in range(1, len(x)) if x[:k] in normal and x[k:] in normal)
        self.n, self.pair, self.pair_rank = n, Index(np.array([p for p, _ in pairs], np.uint64)), np.array([*(r for _, r in pairs), NONE], np.int32)
        self.char = np.full(0x110000, -1, np.int32)
        for x, i in normal.items():
            if len(x) == 1 and x != MARK:
                self.char[ord(x)] = i
        self.char[ord(" ")] = normal[MARK]  # a written mark itself goes to bytes, so that it is not read back as a space
        raw = [bytes([i - self.byte0]) if sp.is_byte(i) else names[i].replace(MARK, " ").encode() if names[i] in normal else b"" for i in range(n)]
        self.length = np.array([len(x) for x in raw], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the union of two pieces; NONE where it is no piece."""
        i = self.pair.find((left * self.n + right).view(np.uint64))
        i[(left < 0) | (right < 0)] = -1
        return self.pair_rank[i]  # -1: the last one, NONE


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def candidate_hash(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of candidates of these pieces at these characters."""
    return mix((left.astype(np.uint64) << np.uint64(32)) + right.astype(np.uint64) + at.astype(np.uint64) * M1)


def skipped(key: np.ndarray, candidate: np.ndarray, dropout: float) -> np.ndarray:
    """Whether candidates are skipped, by the hash of key and candidate."""
    return mix(key ^ candidate) >> np.uint64(11) < np.uint64(min(dropout, 1.0) * 2.0**53)


def agenda(symbols: list[int], key: int, v: Vocabulary, dropout: float) -> list[tuple[int, int]]:
    """[(piece, first character)] of one chunk, merged with a heap as agenda."""
    n = len(symbols)
    piece, nxt, prev = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int]] = []

    def push(at: np.ndarray) -> None:
        at = at[np.array([0 <= i and nxt[i] < n for i in at.tolist()], bool)]
        if not len(at):
            return
        a, b = np.array([piece[i] for i in at.tolist()], np.int64), np.array([piece[nxt[i]] for i in at.tolist()], np.int64)
        rank = v.merged(a, b)
        use = rank < NONE
        if dropout:
            use &= ~skipped(np.full(len(at), key, np.uint64), candidate_hash(np.maximum(a, 0), np.maximum(b, 0), at), dropout)
        for i, r, x, y in zip(at[use].tolist(), rank[use].tolist(), a[use].tolist(), b[use].tolist()):
            heapq.heappush(heap, (r, i, x, y))

    push(np.arange(n - 1))
    while heap:
        r, i, x, y = heapq.heappop(heap)
        j = nxt[i]
        if piece[i] != x or j >= n or piece[j] != y:
            continue
        piece[i], piece[j] = int(v.of_rank[r]), -2
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
        push(np.array([prev[i], i]))
    out, i = [], 0
    while i < n:
        out.append((piece[i], i))
        i = nxt[i]
    return out


def merge_chunks(symbols: np.ndarray, counts: np.ndarray, key: np.ndarray, v: Vocabulary, dropout: float, seen: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunk, piece, first character) of all chunks, each given as initial symbols; all are merged in step.

    seen: takes (chunk, left piece, right piece, position) of all candidates; long chunks are then left out.
    """
    chunk, at = ragged(counts)
    piece = symbols.astype(np.int64)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    long = counts > LONG_CHUNK
    if long.any():
        first = np.cumsum(counts) - counts
        for c in np.flatnonzero(long).tolist() if seen is None else []:
            got = agenda(symbols[first[c] : first[c] + counts[c]].tolist(), int(key[c]), v, dropout)
            done.append((np.full(len(got), c), np.array([p for p, _ in got], np.int64), np.array([i for _, i in got], np.int64)))
        stay = ~long[chunk]
        chunk, at, piece = chunk[stay], at[stay], piece[stay]

    def candidates(i: np.ndarray) -> np.ndarray:
        a, b = piece[i], piece[i + 1]
        rank = np.where(chunk[i] == chunk[i + 1], v.merged(a, b), NONE).astype(np.int64)
        if seen is not None:
            c = np.flatnonzero(rank < NONE)
            seen.append((chunk[i[c]], a[c], b[c], at[i[c]]))
        if dropout:
            c = np.flatnonzero(rank < NONE)
            rank[c[skipped(key[chunk[i[c]]], candidate_hash(a[c], b[c], at[i[c]]), dropout)]] = NONE
        return rank

    rank = np.full(len(piece), NONE, np.int64)
    if len(piece) > 1:
        rank[:-1] = candidates(np.arange(len(piece) - 1))
    head = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]) if len(piece) else np.zeros(0, np.int64)
    size = np.diff(np.r_[head, len(chunk)])
    while len(piece):
        best = np.minimum.reduceat((rank << 32) + np.arange(len(rank)), head)
        ended = (best >> 32) == NONE
        i = (best & 0xFFFFFFFF)[~ended]
        keep = np.ones(len(piece), bool)
        if ended.any():
            over = np.repeat(ended, size)
            done.append((chunk[over], piece[over], at[over]))
            keep[over] = False
            size = size[~ended]
        piece[i] = v.of_rank[rank[i]]
        keep[i + 1] = False
        i = (np.cumsum(keep) - 1)[i] if ended.any() else i - np.arange(len(i))
        chunk, piece, at, rank = chunk[keep], piece[keep], at[keep], rank[keep]
        size = size - 1
        head = np.cumsum(size) - size
        rank[i] = NONE
        before = i[i > 0] - 1
        before = before[chunk[before] == chunk[before + 1]]
        after = i[i < len(piece) - 1]
        fresh = np.concatenate([before, after[chunk[after] == chunk[after + 1]]])
        rank[fresh] = candidates(fresh)
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    c, p, a = (np.concatenate(x) for x in zip(*done))
    order = np.lexsort((a, c))
    return c[order], p[order], a[order]


def drawn(symbols: np.ndarray, counts: np.ndarray, key: np.ndarray, back: np.ndarray, v: Vocabulary, dropout: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(encoding, piece, first character) of the encodings that occurrences draw, the chunk of each encoding, and the encoding of each occurrence.

    key, back: of each occurrence, its key and its chunk.
    """
    seen: list[tuple[np.ndarray, ...]] = []
    out = [merge_chunks(symbols, counts, np.zeros(len(counts), np.uint64), v, 0.0, seen)]
    chunk, left, right, place = (np.concatenate(x) for x in zip(*seen)) if seen else [np.zeros(0, np.int64)] * 4
    order = np.argsort(chunk, kind="stable")
    own = candidate_hash(left, right, place)[order]
    n = np.bincount(chunk, minlength=len(counts))
    begin, first = np.cumsum(n) - n, np.cumsum(counts) - counts
    of, mine = [np.arange(len(counts))], back.copy()
    work = np.cumsum(np.maximum(n, counts)[back])
    cuts = np.unique(np.searchsorted(work, np.arange(PART, work[-1] + 1, PART))) if len(back) else []
    for part in np.split(np.arange(len(back)), cuts):
        row, k = ragged(n[back[part]])
        i = begin[back[part]][row] + k
        again = counts[back[part]] > LONG_CHUNK
        again[row[skipped(key[part][row], own[i], dropout)]] = True
        part = part[again]
        row, k = ragged(counts[back[part]])
        c, p, at = merge_chunks(symbols[first[back[part]][row] + k], counts[back[part]], key[part], v, dropout)
        base = sum(map(len, of))
        mine[part] = base + np.arange(len(part))
        of.append(back[part])
        out.append((c + base, p, at))
    c, p, at = (np.concatenate(x) for x in zip(*out))
    return c, p, at, np.concatenate(of), mine


def encode(texts: pa.Array, ids: np.ndarray, v: Vocabulary, dropout: float = DROPOUT, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(piece ids of all texts in a row, offsets). ids: a number for each text, from which its chunks draw their skips."""
    data, offsets = block_of(texts)
    n = int(offsets[-1])
    space = data[:n] == 0x20
    head = np.zeros(n + 1, bool)
    head[:n] = space
    head[1:n] &= ~space[:-1] if n else False
    filled = np.flatnonzero(np.diff(offsets) > 0)
    head[offsets[filled]] = True
    starts = np.flatnonzero(head[:n])
    ends = np.r_[starts[1:], n]
    opening = np.zeros(len(starts), np.int64)
    before = np.searchsorted(starts, offsets)
    opening[before[:-1][filled]] = 1
    doc, j = ragged(np.diff(before))
    key = mix(np.uint64(seed * int(M1) % 2**64) + mix(mix(ids.astype(np.int64).view(np.uint64)[doc] + M1) ^ j.astype(np.uint64)))
    _, one, back = np.unique(mix(hash_spans(data, starts, ends) + opening.astype(np.uint64)), return_index=True, return_inverse=True)
    # code points of the distinct chunks
    row, k = ragged(ends[one] - starts[one])
    raw = data[starts[one][row] + k]
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    leads = np.bincount(row[(raw & 0xC0) != 0x80], minlength=len(one))
    counts = leads + opening[one]
    symbols = np.empty(int(counts.sum()), np.int64)
    first = np.cumsum(counts) - counts
    put = np.ones(len(symbols), bool)
    put[first[opening[one] == 1]] = False
    symbols[~put] = v.char[0x20]
    symbols[put] = v.char[points]
    point = np.full(len(symbols), 0x20, np.uint32)
    point[put] = points
    if dropout:
        c, p, at, of, back = drawn(symbols, counts, key, back, v, dropout)
    else:
        c, p, at = merge_chunks(symbols, counts, key[one], v, dropout)
        of = np.arange(len(one))
    # characters outside the vocabulary become their bytes
    odd = np.flatnonzero(p < 0)
    if len(odd):
        as_bytes = [chr(x).encode() for x in point[first[of[c[odd]]] + at[odd]].tolist()]
        times = np.ones(len(p), np.int64)
        times[odd] = [len(x) for x in as_bytes]
        c, p, was_odd = np.repeat(c, times), np.repeat(p, times), np.repeat(p < 0, times)
        p[was_odd] = v.byte0 + np.frombuffer(b"".join(as_bytes), np.uint8).astype(np.int64)
    size = np.bincount(c, minlength=len(of))
    begin = np.cumsum(size) - size
    row, k = ragged(size[back])
    out = p[begin[back][row] + k]
    return out, np.r_[0, np.cumsum(size[back])][before]


def decode(ids: np.ndarray, offsets: np.ndarray, v: Vocabulary) -> tuple[bytes, np.ndarray]:
    """(bytes of all texts in a row, offsets): the pieces' bytes, without the space that encoding puts before a text."""
    count = v.length[ids]
    row, k = ragged(count)
    raw = v.bytes[v.first[ids][row] + k]
    at = np.r_[0, np.cumsum(count)][offsets]
    filled = np.diff(at) > 0
    keep = np.ones(len(raw), bool)
    keep[at[:-1][filled]] = False
    return raw[keep].tobytes(), at - np.r_[0, np.cumsum(filled)]


def encoded(docs: DataFrame, model: str, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """(doc_id, ids array<int>) of every text. A null or empty text has no ids; a null doc_id counts as -1 in the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for b in slices(batches, most=BLOCK):
            ids, at = encode(b.column("text"), b.column("doc_id").fill_null(-1).to_numpy(), v, dropout, seed)
            yield pa.record_batch([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for b in batches:
            lists = b.column("ids")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            size = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()], np.int64)
            raw, at = decode(flat, np.r_[0, np.cumsum(size)], v)
            yield pa.record_batch([b.column("doc_id"), pa.array([raw[x:y].decode() for x, y in zip(at[:-1].tolist(), at[1:].tolist())], pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encoding_digests(docs: DataFrame, model: str, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, decoded_sha256, lossless) of every text: digests of its ids and of what they decode to.

    ids_crc32 is over the ids as little-endian unsigned 32-bit numbers. A null text is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for b in slices(batches, most=BLOCK):
            ids, at = encode(b.column("text"), b.column("doc_id").fill_null(-1).to_numpy(), v, dropout, seed)
            raw, to = decode(ids, at, v)
            data, offsets = block_of(b.column("text"))
            data = data.tobytes()
            words = memoryview(ids.astype("<u4")).cast("B")
            span = lambda x, k: zip((k * x[:-1]).tolist(), (k * x[1:]).tolist())
            yield pa.record_batch(
                [
                    b.column("doc_id"),
                    pa.array(np.diff(at)),
                    pa.array([zlib.crc32(words[x:y]) for x, y in span(at, 4)], pa.int64()),
                    pa.array([hashlib.sha256(raw[x:y]).hexdigest() for x, y in span(to, 1)]),
                    pa.array([raw[x:y] == data[s:e] for (x, y), (s, e) in zip(span(to, 1), span(offsets, 1))]),
                ],
                ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "lossless"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, lossless boolean")


def op7_merge_dropout(spark, sf_dir: str) -> DataFrame:
    """Every document encoded with merge-dropout and decoded again."""
    return encoding_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("piece_bpe_32k.model"))
