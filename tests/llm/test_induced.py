import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import induced

ALPHABETS = [2, 3, 30]


def naive(text):
    t = text.tolist()
    order = sorted(range(len(t)), key=lambda i: t[i:])
    lcp = [0]
    for a, b in zip(order, order[1:]):
        x = 0
        while t[a + x : a + x + 1] == t[b + x : b + x + 1]:
            x += 1
        lcp.append(x)
    return order, lcp


def prefix_of(text, cap):
    t = text.tolist()

    def prefix(i, j, known):
        out = []
        for a, b in zip(i.tolist(), j.tolist()):
            x = 0
            while x < cap and t[a + x : a + x + 1] == t[b + x : b + x + 1]:
                x += 1
            out.append(x)
        assert (known <= np.array(out, np.int64)).all()
        return np.array(out, np.int64)

    return prefix


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=120), st.integers(1, 40), st.booleans())
def test_order_and_prefixes(body, cap, on_disk):
    text = np.array([*body, 0], np.uint16)
    with induced.Space(0 if on_disk else 1 << 20) as space:
        order, lcp = induced.suffix_order(text, 4, space, prefix_of(text, cap), cap)
        want, values = naive(text)
        assert order.tolist() == want
        assert lcp.tolist() == [min(v, cap) for v in values]


@pytest.mark.parametrize("k", ALPHABETS)
@pytest.mark.parametrize("seed", range(4))
def test_longer_texts(k, seed):
    r = np.random.default_rng(seed)
    unit = r.integers(1, k, 40)
    body = np.concatenate([r.integers(1, k, 300), unit, unit, np.full(60, 1), r.integers(1, k, 200), unit, np.full(90, k - 1), unit[:20], unit])
    text = np.r_[body, 0].astype(np.uint16)
    with induced.Space() as space:
        order, lcp = induced.suffix_order(text, k + 1, space, prefix_of(text, 50), 50)
    want, values = naive(text)
    assert order.tolist() == want and lcp.tolist() == [min(v, 50) for v in values]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=60).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6), st.integers(1, 12))
def test_repeated_starts(texts, length):
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    seen = {}
    for i, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            seen.setdefault(t[s : s + length], []).append(offsets[i] + s)
    want = np.zeros(len(data), bool)
    for at in seen.values():
        if len(at) > 1:
            want[at] = True
    assert (induced.repeated_starts(data, offsets, length) == want).all()


def plain_starts(data, offsets, length):
    seen, raw, want = {}, data.tobytes(), np.zeros(len(data), bool)
    starts = [s for a, z in zip(offsets[:-1], offsets[1:]) for s in range(a, z - length + 1)]
    for s in starts:
        seen[raw[s : s + length]] = seen.get(raw[s : s + length], 0) + 1
    for s in starts:
        want[s] = seen[raw[s : s + length]] > 1
    return want


@pytest.mark.parametrize("stretch", [97, 1000])
@pytest.mark.parametrize("in_memory", [0, 1 << 24])
def test_stretches_and_files(monkeypatch, stretch, in_memory):
    monkeypatch.setattr(induced, "STRETCH", stretch)
    r = np.random.default_rng(stretch)
    base = r.integers(97, 101, 400).astype(np.uint8)
    texts = [np.concatenate([r.integers(97, 105, r.integers(0, 300)).astype(np.uint8), base[: r.integers(50, 400)]]) for _ in range(20)] + [np.full(200, 97, np.uint8)] * 2
    data, offsets = np.concatenate(texts), np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    assert (np.asarray(induced.repeated_starts(data, offsets, 40, in_memory)) == plain_starts(data, offsets, 40)).all()


def test_a_shard_larger_than_its_memory(tmp_path):
    """96 MB of text with under 64 MB of memory of its own: its arrays, over 2000 MB, lie in files, those of the names too."""
    code = """
import threading, time
import numpy as np
from tallyloom.llm import induced
r = np.random.default_rng(3)
induced.STRETCH, induced.SHORT = 1 << 17, 1 << 16
n, piece = 96 << 20, r.integers(97, 123, 5000).astype(np.uint8)
data = np.memmap('DATA', np.uint8, 'w+', shape=(n,))
for a in range(0, n, 1 << 20):
    data[a : a + (1 << 20)] = r.integers(97, 123, 1 << 20)
at = np.arange(10**6, n - 10**6, 4 * 10**6)
for i, a in enumerate(at.tolist()):
    data[a : a + 5000] = piece
    data[[a - 1, a + 5000]] = i  # copies differ around the piece
hold, seen = induced.Space.array, []
induced.Space.array = lambda self, k, t: (seen.append(k * np.dtype(t).itemsize), hold(self, k, t))[1]
before = int(open('/proc/self/status').read().split('RssAnon:')[1].split()[0])
peak = [before]
go = True
def watch():
    while go:
        peak.append(int(open('/proc/self/status').read().split('RssAnon:')[1].split()[0])); time.sleep(0.05)
t = threading.Thread(target=watch); t.start()
hit = induced.repeated_starts(data, np.array([0, n]), 400, 1 << 20)
held = max(peak) - before
go = False; t.join()
want = np.zeros(n, bool)
for a in at.tolist():
    want[a : a + 4601] = True
assert (np.asarray(hit) == want).all(), (int(hit.sum()), int(want.sum()))
print(sum(seen) >> 20, held >> 10)
"""
    import subprocess
    import sys

    out = subprocess.run([sys.executable, "-c", code.replace("DATA", str(tmp_path / "data"))], capture_output=True, text=True, timeout=900)
    assert out.returncode == 0, out.stderr[-2000:]
    made, held = map(int, out.stdout.split())
    assert made > 2000 and held < 64, out.stdout
    print(made, held)
