import random
import re
from collections import defaultdict

from tallyloom.operators import advisor


def test_detected_leader_moves_a_basket_once(spark):
    r = random.Random(3)
    rates = {(leader, item): r.randrange(1, 10_001) / 10_000 for leader in range(40) for item in range(60) if r.random() < 0.4}
    cards = {(b, r.randrange(70)) for b in range(80) for _ in range(5)}
    got = advisor.detected_leader(spark.createDataFrame(sorted(cards), "basket_id long, item long"), spark.createDataFrame([(a, i, x) for (a, i), x in rates.items()], "leader long, item long, rate double"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    want = {}
    for b in {b for b, _ in cards}:
        met = defaultdict(list)
        for i in (i for c, i in cards if c == b):
            for leader in range(40):
                if (leader, i) in rates:
                    met[leader].append(round(rates[leader, i] * 10_000))
        if met:
            want[b] = {leader: (sum(x) / 10_000 / len(x), len(x)) for leader, x in met.items()}
    rows = {x.basket_id: x for x in got.collect()}
    assert rows.keys() == want.keys()
    for b, x in rows.items():
        mean, n = want[b][x.leader]
        assert x.matched == n and abs(x.score - mean) < 0.00501
        assert all(m <= x.score + 0.00501 for m, _ in want[b].values())
    assert len(re.findall(r"Exchange hashpartitioning\(basket_id", plan)) == 1
