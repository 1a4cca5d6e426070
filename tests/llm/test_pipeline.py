import pyarrow as pa

import corpus_pipeline as c
from tallyloom.llm import packing

from .common import awkward, docs_frame, prose, saved
from .test_neardup import brute as near
from .test_privacy import base
from .test_quality import brute as quality
from .test_suffixdup import brute as cut

STOPS = "the of and to a in is it for on"


def text(n, seed):
    w = prose(n, seed, 2000).split()
    for i, s in enumerate(STOPS.split() * (n // 60 + 1)):
        w.insert(7 * i + 3, s)
    return " ".join(w)


def corpus():
    shared = prose(100, 4242, 2000)
    rows = [(1000 + i, text(90, i)) for i in range(20)] + [(2000 + i, text(90, i) + " end") for i in range(6)]
    rows += [(3000 + i, text(80, 100 + i) + " " + shared + " " + text(40, 200 + i)) for i in range(4)]
    rows += [(4000 + i, text(80, 300 + i) + f" write to user{i}@mail.example.com or +1 242 555 34{i:02d} now") for i in range(4)]
    short = " ".join(f"{w[:4]:x<4}" for w in prose(51, 777, 2000).split())  # 51 words, 254 bytes
    rows += [(5000 + i, text(60, 500 + i) + " " + short + " " + text(60, 600 + i)) for i in range(3)]
    rows += [(1003, text(90, 700)), (1004, text(90, 2) + " end")]  # ids that repeat, with a text of their own and with a near copy
    return awkward() + rows + [rows[3]]


def test_stages_against_brute_force(spark, tmp_path):
    path = saved(spark, tmp_path, corpus())
    docs = spark.read.parquet(f"{path}/documents.parquet")
    outs = []
    for k, (_, stage) in enumerate(c.STAGES):
        out = stage(spark, docs, path)
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        outs.append([tuple(r) for r in docs.collect()])
        if k < 4:
            assert docs.columns == c.COLUMNS
    pairs = lambda rows: [(r[0], r[1]) for r in rows]
    key = lambda r: str(r)
    first = pairs(outs[0])
    assert all(not quality(t)[-1] for _, t in first)
    assert {i for i, _ in first} >= {i for i, _ in corpus() if i is not None and i >= 1000}
    numbered = dict(enumerate(sorted(set(first), key=lambda r: (r[0] is None, r[0] or 0, r[1]))))
    groups = near([(n, t) for n, (_, t) in numbered.items()], 5)
    second = pairs(outs[1])
    assert len(second) == len({g for _, g in groups.values()}) and set(second) <= set(first)
    of = {r: groups[n][1] for n, r in numbered.items()}
    assert len({of[r] for r in second}) == len(second)
    assert all(i == min(x for (x, _), g in of.items() if g == of[i, t]) for i, t in second)
    assert (1003, text(90, 700)) in second and (1004, text(90, 2) + " end") not in second
    assert not {2000 + i for i in range(6)} & {i for i, _ in second}
    left = [(i, n - gone) for i, n, gone, _, _ in cut(second, c.REPEATED)]
    third = pairs(outs[2])
    assert sorted((i, len(t.encode())) for i, t in third) == sorted((i, n) for i, n in left if n)
    lengths = dict(left)
    assert sum(lengths[3000 + i] for i in range(4)) < sum(len(t.encode()) for i, t in second if 3000 <= i < 3004) - 4 * 400
    assert sum(lengths[5000 + i] for i in range(3)) <= sum(len(t.encode()) for i, t in second if 5000 <= i < 5003) - 3 * 254
    fourth = outs[3]
    assert all(not base(r[1]) for r in fourth) and len(fourth) == len(third)
    assert all(r[4] == len(r[1]) for r in fourth)
    clean = [(i, t) for i, t in third if not base(t)]
    assert set(clean) <= set(pairs(fourth))
    ids, want = {r[0]: 0 for r in fourth}, {r[0]: 0 for r in fourth}
    for r in outs[4]:
        ids[r[0]] += r[3]
    for r in fourth:
        want[r[0]] += len(packing.document_ids(pa.array([r[1]]), packing.tokenizer_path("word_bpe_49k.json"))[0])
    assert ids == want
    got = [tuple(r) for r in c.run(spark, path).collect()]
    assert sorted((r[:5] for r in got), key=key) == sorted((r[:5] for r in outs[4]), key=key)
