import hashlib
import math
import re

from pyspark.sql import functions as F

from tallyloom.llm import privacy

from .common import awkward, docs_frame, prose, saved

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ORDER = ["email", "ip", "card", "phone", "term"]


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        t += x - 9 if x > 9 else x
    return t % 10 == 0


def base(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            entity = m[0].lower() if kind == "email" else f"{kind} " + (re.sub("[^0-9.]", "", m[0]) if kind == "ip" else d)
            out.append((m.start(), ORDER.index(kind), m.end(), entity))
    return sorted(out)


SPACE = r"\x20\x09-\x0D"
TERM = rf"(?<![^{SPACE}])[^\W\d_]{{3,}}(?=[.,;:!?]*(?:[{SPACE}]|\Z))"


def model(rows):
    """(text number, base, terms told, to remove) by the definition of the model."""
    found = [(i, t or "", base(t)) for i, t in rows]
    n, n_t = len(rows), {}
    distinct = {}
    for _, t, b in found:
        for w in {m[0] for m in re.finditer(TERM, t.lower())}:
            n_t[w] = n_t.get(w, 0) + 1
        if b:
            distinct.setdefault(t, [0, {x for *_, x in b}, {m[0].lower() for m in re.finditer(TERM, t)}])[0] += 1
    texts = list(distinct.values())
    entities = {}
    for w, es, _ in texts:
        for e in es:
            rows_, k = entities.get(e, (0, 0))
            entities[e] = (rows_ + w, k + 1)
    entities = {e: r for e, (r, k) in entities.items() if k > 1 and r < n}
    most = lambda n_e: n_e**privacy.GENERALISE * n ** (1 - privacy.GENERALISE) * (1 + 1e-9)
    tested = max(1, sum(c <= most(max(entities.values(), default=0)) for c in n_t.values()))
    told = {}
    for e, n_e in entities.items():
        mine = [(w, terms) for w, es, terms in texts if e in es]
        k, n_et = {}, {}
        for w, terms in mine:
            for t in terms:
                if n_t[t] <= most(n_e):
                    k[t], n_et[t] = k.get(t, 0) + 1, n_et.get(t, 0) + w
        effect = sum(c * c for c in k.values()) / max(1, sum(k.values()))
        for t in k:
            own, alone = k[t] / effect, n_t[t] - n_et[t]
            x = own / (own + alone)
            for g in (privacy.GENERALISE, privacy.REMOVE):
                q = (n_e / n) ** (1 - g)
                if x > q and own * math.log2(x / q) + (alone * math.log2((1 - x) / (1 - q)) if alone else 0) >= math.log2(tested / privacy.CHANCE):
                    told[e, t] = g
    return found, told, texts, n_t


def brute(rows):
    found, told, _, _ = model(rows)
    for i, t, b in found:
        entities = {x for *_, x in b}
        terms = {(m.start(), 4, m.end()) for m in re.finditer(TERM, t) if any((x, m[0].lower()) in told for x in entities)}
        listing = lambda s: ",".join(f"{ORDER[k]}:{a}:{z}" for a, k, z in sorted(s))
        plain = {(a, k, z) for a, k, z, _ in b}
        yield (i, *(sum(k == j for _, j, _, _ in b) for k in range(4)), hashlib.sha256(listing(plain).encode()).hexdigest(), listing(plain | terms))


def rows_with_data():
    odd = [
        "a@b.c_d@e.f x@y.z. a@b", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112", "call +1 (242) 555-3475 or +12 or +49 30 1234567.",
        "é😀 me@x.org 漢字 10.0.0.1 5500005555555559", "@" * 50 + "a" * 30000 + "@", "1" * 30000, "a@" + "b." * 3000 + "c", "1 " * 4000, "+1" + "(" * 5000, "1.2." * 3000, "x@y.z " * 60,
    ]
    rows = [*awkward(), *((300 + i, t) for i, t in enumerate(odd))]
    rows += [(400 + i, f"{prose(30, i)} Contact Zebulon, agent zebulon at zeb@hidden.example.com today {prose(20, 50 + i)}") for i in range(24)]
    rows += [(500 + i, prose(15, 900 + i)) for i in range(400)]
    rows += [(1000 + i, f"{prose(6, 70 + i % 9)} Marlow Jorund ask 10.9.8.{i % 5} {'or marlow@sea.example.org' if i % 3 else ''} {prose(4, 30 + i % 4)}") for i in range(90)]
    rows += [(950, rows[-500][1])]
    return rows


def test_query_against_brute_force(spark, tmp_path):
    rows = rows_with_data()
    got = privacy.op8_privacy(spark, saved(spark, tmp_path, rows)).collect()
    have = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in got), key=str)
    want = sorted(brute(rows), key=str)
    for a, b in zip(have, want):
        assert a == b
    assert len(have) == len(want)
    assert any("term:" in r.spans for r in got if r.doc_id in range(400, 424))
    assert all(r.spans == "" for r in got if r.doc_id is not None and 500 <= r.doc_id < 900)


def holders_of_zebulon():
    return [(i, f"Contact Zebulon, agent zebulon at zeb@hidden.example.com now {i} {prose(60, i)}") for i in range(24)] + [(100 + i, f"agent {prose(30, 40 + i)}") for i in range(400)] + [(999, None), (998, "no data")]


def test_sanitised_text(spark):
    rows = holders_of_zebulon()
    out = {r.doc_id: r for r in privacy.sanitised(docs_frame(spark, rows)).collect()}
    assert len(out) == len(rows) and out[999].text is None and out[998].text == "no data" and out[120].text == dict(rows)[120]
    assert "zeb@" not in out[0].text and "ebulon" not in out[0].text and "[EMAIL]" in out[0].text
    assert out[0].bucket == "b" and out[0].id == "x"
    clash = docs_frame(spark, rows).withColumns({"base": F.lit(1), "terms": F.lit(2), "t1": F.lit(3), "told": F.lit(4), "__t1": F.lit("mine"), "a.b": F.lit(5), "own_0": F.lit(6), "OWN_1": F.lit(7)})
    got = privacy.sanitised(clash)
    assert got.columns == clash.columns
    assert {r.doc_id: r.text for r in got.where("base = 1 AND terms = 2 AND t1 = 3 AND __t1 = 'mine' AND `a.b` = 5 AND own_0 = 6 AND OWN_1 = 7").collect()} == {i: r.text for i, r in out.items()}


def test_terms_are_generalised_by_what_subsumes_them(spark, monkeypatch):
    monkeypatch.setattr(privacy, "REMOVE", 0.999)  # all are generalised
    out = {r.doc_id: r.text for r in privacy.sanitised(docs_frame(spark, holders_of_zebulon())).collect()}
    # 'contact', 'zebulon' and 'now' stand beside the address only; 'agent' does in all their texts, and in many others
    assert out[3].startswith("Agent Agent, agent agent at [EMAIL] agent 3")


def test_planted_terms_are_found_and_other_words_are_left_alone(spark):
    import random

    r = random.Random(5)
    pool = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(4, 9))) for _ in range(30000)]
    word = lambda: pool[min(int(r.paretovariate(0.6)) - 1, 29999)]
    body = lambda n: [word() for _ in range(n)]
    rows, planted, doc = [], {}, 0
    for e in range(25):
        code = f"qz{pool[20000 + e]}"
        for _ in range(r.randint(9, 16)):
            t = body(120)
            if r.random() < 0.95:
                t.insert(r.randint(0, 100), code)
                planted.setdefault(doc, code)
            t.insert(r.randint(0, 100), f"owner{e}@mail.example.org")
            rows.append((doc, " ".join(t)))
            doc += 1
    near = body(150) + ["copied@mail.example.org"]
    for i in range(60):  # near copies of one text, and equal ones, tell nothing
        rows.append((doc + i, " ".join(near[:i] + [word()] + near[i + 1 :]) if i % 3 else " ".join(near)))
    doc += 60
    rows += [(doc + i, " ".join(body(120) + [f"single{i}@mail.example.org"])) for i in range(300)]
    doc += 300
    rows += [(doc + i, " ".join(body(120))) for i in range(1500)]
    got = {x.doc_id: x for x in privacy.spans_of(docs_frame(spark, rows)).collect()}
    text = dict(rows)
    terms = lambda i: [text[i][int(a) : int(b)] for k, a, b in (s.split(":") for s in got[i].spans.split(",") if s) if k == "term"]
    found = sum(planted[i] in terms(i) for i in planted)
    other = sum(len([w for w in terms(i) if w != planted.get(i)]) for i, _ in rows)
    words = sum(len(re.findall(TERM, t)) for i, t in rows if got[i].n_email)
    assert found >= 0.9 * len(planted) and other <= 0.01 * words
    assert all(got[i].n_term == 0 for i, _ in rows if not got[i].n_email)
    print("planted terms found", found / len(planted), "other words left", 1 - other / words)


def test_plan_has_no_python(spark):
    plan = privacy.spans_of(docs_frame(spark, [(1, "a@b.cc")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert privacy.spans_of(docs_frame(spark, [])).count() == 0


def test_terms_far_away_and_entities_of_one_text(spark):
    far = prose(60, 7)
    rows = [(i, f"Zebulon wrote {prose(40, 500 + i)} {far} and asks for replies to zeb@hidden.example.com today. ZEBULON {prose(20, 600 + i)} zebulon") for i in range(16)]
    rows += [(100 + i, f"and wrote asks for replies today {far} {prose(5, i)}") for i in range(600)]
    rows += [(900, "Ignatius alone has ig@hidden.example.com")]
    got = {r.doc_id: r for r in privacy.spans_of(docs_frame(spark, rows)).collect()}
    told = lambda i: {dict(rows)[i][int(a) : int(b)].lower() for k, a, b in (x.split(":") for x in got[i].spans.split(",")) if k == "term"}
    # the common words do not tell, however near
    assert told(1) == {"zebulon"} and got[1].n_term == 3
    assert all(got[i].n_term == 0 for i in got if i >= 100)
    # one text, however often it is repeated, tells nothing
    assert privacy.spans_of(docs_frame(spark, [(1, "Zebulon a@b.cc")] * 30 + [(2, "else")] * 900)).agg({"n_term": "sum"}).first()[0] == 0
