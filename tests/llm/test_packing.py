import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyloom.llm import packing as p
from tallyloom.llm.textblocks import block_of, words_of

from .common import awkward, docs_frame, prose, saved

PATH = p.tokenizer_path("word_bpe_49k.json")


def test_ids_equal_the_tokenizers():
    tok = Tokenizer.from_file(PATH)
    texts = [t for _, t in awkward()] + ["Σίσυφος ΑΣ İstanbul ﬁ e\u0301 a\u0308b", "a\u00a0b\u2003c 's't"]
    ids, at = p.document_ids(pa.array(texts), PATH)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == [*tok.encode(t or "", add_special_tokens=False).ids, 1]


def test_query_is_a_gapless_packing_of_all_pieces(spark, tmp_path):
    tok = Tokenizer.from_file(PATH)
    rows = awkward() + [(6, prose(120, 1)), (30, prose(4000, 4)), (31, prose(4000, 5))]
    got = p.op5_best_fit_packing(spark, saved(spark, tmp_path, rows)).collect()
    want = Counter()
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[i, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for x in bins.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 4096
    assert len(bins) <= -(-sum(r.length for r in got) // 4096) + 1


def test_empty_table(spark):
    assert p.packed(docs_frame(spark, []), PATH).count() == 0


def test_a_smallest_piece_gives_way_to_two_that_fit_more_tightly():
    # greedy: 60 + 30, and 10 are left; without the 30, 25 + 15 fill all
    assert p.best_two_fit({60: 1, 30: 1, 25: 1, 15: 1}, 100) == [(1, [60, 25, 15]), (1, [30])]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=20))
def test_plan_packs_everything(lengths):
    used = Counter()
    for times, fill in p.best_two_fit(lengths, 50):
        assert sum(fill) <= 50 and times > 0
        for k in fill:
            used[k] += times
    assert used == Counter(lengths)
    n = sum(t for t, _ in p.best_two_fit(lengths, 50))
    assert n <= 2 * -(-sum(k * c for k, c in lengths.items()) // 50) + 1  # no two bins are at most half full


def test_new_words_are_encoded_some_at_a_time(monkeypatch):
    words = p.WordIds(PATH)
    text = " ".join(f"w{i}é{i * i}" for i in range(500))
    data, offsets = block_of(pa.array([text]))
    starts, ends, _ = words_of(data, offsets)
    want = words.of(data, starts, ends)
    sizes = []

    class Counted:
        def encode_batch_fast(self, some, add_special_tokens, own=words.tokenizer):
            sizes.append(len(some))
            return own.encode_batch_fast(some, add_special_tokens=add_special_tokens)

    monkeypatch.setattr(p, "ENCODED", 64)
    words.clear()
    words.tokenizer = Counted()
    got = words.of(data, starts, ends)
    assert max(sizes) <= 64 and sum(sizes) == 500
    assert all((x == y).all() for x, y in zip(got, want))
