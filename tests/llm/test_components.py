import random

import numpy as np

from tidewater.llm.components import components, roots


def brute(edges):
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def test_components(spark):
    pick = random.Random(2)
    edges = [(pick.randint(-200, 200), pick.randint(-200, 200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5001 + i) for i in range(50)]
    want = brute([e for e in edges if e[0] != e[1]])
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    assert {r.node: r.label for r in got} == want and len(got) == len(want)
    a, b = np.array([e for e in edges if e[0] != e[1]]).T
    assert dict(zip(*map(np.ndarray.tolist, roots(a, b)), strict=True)) == want


def test_none(spark):
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []
