"""Subject pairs by blocks against pair by pair."""

import math
import random
from collections import Counter

import pytest

from latticework.operators import similarity as S


def nmi(x, y):
    both = sorted(set(x) & set(y))
    if not both:
        return None
    n, joint = len(both), Counter((x[k], y[k]) for k in both)
    px, py = Counter(x[k] for k in both), Counter(y[k] for k in both)
    i = sum(c / n * math.log(c * n / (px[a] * py[b])) for (a, b), c in joint.items())
    h = -sum(c / n * math.log(c / n) for p in (px, py) for c in p.values())
    return 1.0 if h == 0 else 2 * i / h


@pytest.mark.parametrize("block", [2, 7, 512])
def test_every_pair_once(spark, block):
    """Missing nodes, subjects without a common node, a single module, several keys, nulls."""
    rng = random.Random(block)
    rows, own = [], {}
    for k in (1, 2):
        for s in range(17):
            for node in range(20):
                if rng.random() < 0.8 and not (s == 3 and node > 5) and not (s == 4 and node < 10):
                    m = 1 if s == 5 else rng.randrange(4)
                    rows.append((k, s, node, m))
                    own.setdefault((k, s), {})[node] = m
    rows += [(1, None, 2, 1), (1, 2, None, 1), (2, 2, 2, None)]
    df = spark.createDataFrame(rows, "k int, subject long, node int, module int").repartition(3)
    got = [(r["k"], r["s1"], r["s2"], r["nmi"]) for r in S.subject_pairs_nmi(df, ["k"], block=block).collect()]
    want = {(k, a, b): v for k in (1, 2) for a in range(17) for b in range(a + 1, 17) if (v := nmi(own[k, a], own[k, b])) is not None}
    assert len(got) == len(want) and {g[:3]: g[3] for g in got} == pytest.approx(want)


def test_no_join_on_nodes(spark):
    df = spark.createDataFrame([(s, n, n % 2) for s in range(4) for n in range(6)], "subject long, node int, module int")
    plan = S.subject_pairs_nmi(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert S.subject_pairs_nmi(df.limit(0)).count() == 0
