import datetime
import math
import os
from itertools import combinations

import pytest

import __spark_entry__ as entry
from tidewater.plans.panel import returns

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_tau_of_all_dates_equals_all_pairs(spark):
    by = {}
    for r in returns(spark, SF).collect():
        by.setdefault(r.ticker, {})[r.dt] = r.g
    got = {(r.a, r.b): r for r in entry.queries()["kendall_tau"](spark, SF).collect()}
    assert set(got) == set(combinations(sorted(by), 2))
    sign = lambda v: (v > 0) - (v < 0)
    for (a, b), r in got.items():
        days = sorted(by[a].keys() & by[b].keys())
        score = nx = ny = 0
        for s, t in combinations(days, 2):
            x, y = sign(by[a][s] - by[a][t]), sign(by[b][s] - by[b][t])
            score, nx, ny = score + x * y, nx + abs(x), ny + abs(y)
        assert r.n == len(days) and (r.n < 2 or math.isclose(r.tau, score / math.sqrt(nx * ny), abs_tol=2e-9))
    assert any(d >= datetime.date(1996, 1, 1) for d in by["A"])
