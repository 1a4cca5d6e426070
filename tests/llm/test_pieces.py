import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import pieces as p

from .common import awkward, docs_frame, prose, saved

PATH = p.tokenizer_path("piece_bpe_32k.model")


def encode(texts, ids=None, **kw):
    ids = np.arange(len(texts)) if ids is None else np.array(ids)
    out, at = p.encode(pa.array(texts, pa.string()), ids, p.vocabulary(PATH), **kw)
    return [out[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


def decode(rows):
    flat = np.array([x for r in rows for x in r], np.int64)
    raw, at = p.decode(flat, np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int64), p.vocabulary(PATH))
    return [raw[a:b].decode() for a, b in zip(at[:-1], at[1:])]


def test_without_dropout_it_is_the_librarys_encoding():
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [t or "" for i, t in awkward() if i != 15] + [" lead", "trail ", "a  b   c", prose(300, 2), "Hello  world\nfoo <0x0A> <s> é漢字"]
    assert encode(texts, dropout=0.0) == [sp.encode(t) for t in texts]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" ▁abtheinr\n"), st.characters(blacklist_categories=["Cs"])), max_size=80), max_size=6), st.integers(0, 2**70), st.floats(0, 1))
def test_round_trip(texts, seed, dropout):
    assert decode(encode(texts, dropout=dropout, seed=seed)) == texts


def slow(text, key, v, dropout):
    """One chunk: the best candidate of all, again and again."""
    sym = [(int(v.char[ord(c)]), i) for i, c in enumerate(text)]
    while True:
        best = None
        for i in range(len(sym) - 1):
            (a, x), (b, _) = sym[i], sym[i + 1]
            r = int(v.merged(np.array([a]), np.array([b]))[0])
            if r == p.NONE or (dropout and p.skipped(np.array([key], np.uint64), p.candidate_hash(*(np.array([q]) for q in (a, b, x))), dropout)[0]):
                continue
            if best is None or (r, i) < best:
                best = (r, i)
        if best is None:
            return sym
        r, i = best
        sym[i : i + 2] = [(int(v.of_rank[r]), sym[i][1])]


def test_agenda_in_step_and_plain_agree():
    v = p.vocabulary(PATH)
    words = prose(40, 5).split() + ["internationalization", "thethethethe", "aaaaaaaaaaaa"]
    for w in words:
        text = " " + w
        sym = v.char[[ord(c) for c in text]].astype(np.int64)
        for key in (1, 2**63 + 5):
            want = slow(text, key, v, 0.3)
            assert p.agenda(sym.tolist(), key, v, 0.3) == want
            c, q, at = p.merge_chunks(sym, np.array([len(sym)]), np.array([key], np.uint64), v, 0.3)
            assert list(zip(q.tolist(), at.tolist())) == want


def test_seeds_vary_and_repeat():
    t = [prose(200, 3)]
    assert encode(t, seed=1) == encode(t, seed=1) != encode(t, seed=2)
    assert len(encode(t, dropout=0.5)[0]) > len(encode(t, dropout=0.0)[0])
    assert len(encode(t, dropout=1.0)[0]) == len(t[0]) + 1
    assert encode(t, ids=[1]) != encode(t, ids=[2])


def test_query(spark, tmp_path):
    rows = awkward() + [(6, prose(120, 1))]
    got = p.op7_merge_dropout(spark, saved(spark, tmp_path, rows)).collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)
    want = []
    for i, t in rows:
        ids = encode([t], ids=[-1 if i is None else i])[0]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_ids, r.ids_crc32, r.decoded_sha256) for r in got), key=str) == sorted(want, key=str)


def plain(text, number, v):
    """A whole document by the slow agenda: chunk after chunk, each with its own key."""
    out, chunks = [], re.findall(r" +[^ ]*|[^ ]+", text)
    for j, c in enumerate(chunks):
        inner = p.mix(p.mix(np.array([number], np.int64).view(np.uint64) + p.M1) ^ np.array([j], np.uint64))
        key = int(p.mix(np.uint64(p.SEED * int(p.M1) % 2**64) + inner)[0])
        c = c if j else " " + c
        for piece, at in slow(c, key, v, p.DROPOUT):
            out += [piece] if piece >= 0 else [v.byte0 + b for b in c[at].encode()]
    return out


def test_query_against_the_slow_agenda(spark, tmp_path):
    v = p.vocabulary(PATH)
    rows = [(i, t) for i, t in awkward() if len(t or "") < 1000 and i not in (9, 15)] + [(40 + i, prose(25, 70 + i).capitalize() + ", naïve  Straße 漢.\nEnd") for i in range(6)]
    got = {r.doc_id: (r.n_ids, r.ids_crc32) for r in p.op7_merge_dropout(spark, saved(spark, tmp_path, rows)).collect()}
    for i, t in rows:
        ids = plain(t or "", -1 if i is None else i, v)
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i


def test_encode_and_decode_frames(spark):
    rows = awkward()
    back = p.decoded(p.encoded(docs_frame(spark, rows), PATH), PATH).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert p.encoding_digests(docs_frame(spark, []), PATH).count() == 0


def test_every_occurrence_draws_its_own_skips():
    v = p.vocabulary(PATH)
    word, n = "internationalization", 3000
    text = " ".join([word] * n)
    out, at = p.encode(pa.array([text, text]), np.array([3, 4]), v)
    one = out[: at[1]].tolist()
    # a piece with the space mark opens each occurrence
    opens = [i for i, x in enumerate(one) if v.bytes[v.first[x]] == 0x20] + [len(one)]
    forms = [tuple(one[a:b]) for a, b in zip(opens[:-1], opens[1:])]
    assert len(forms) == n and len(set(forms)) > 50
    assert forms != [tuple(x) for x in forms[:1]] * n and out[at[1] :].tolist() != one
    # each is what the plain agenda gives for its key
    key = p.mix(np.uint64(p.SEED * int(p.M1) % 2**64) + p.mix(p.mix(np.full(40, 3, np.uint64) + p.M1) ^ np.arange(40, dtype=np.uint64)))
    for i in range(40):
        assert tuple(x for x, _ in slow(" " + word, int(key[i]), v, p.DROPOUT)) == forms[i]
