"""Recursions over long series as associative scans: segments in parallel, their composites carried, then every step.

A step of a recursion is a map; maps compose. Each segment of SIZE steps folds its own steps into one map, maps of segments
are composed over blocks of segments and over blocks of blocks, and with what comes before it each segment makes its rows.
All three passes are folds of at most SIZE steps in a task, but for the topmost, which has a map for SIZE**2 steps, so that
time is proportional to steps and one long series is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.special import let

SIZE = 128


def segmented(rows: DataFrame, *values: str, size: int = SIZE) -> DataFrame:
    """(ticker, seg, v): the ordered steps (idx, values) of every stretch of `size` steps; idx counts from 1."""
    return rows.groupBy("ticker", F.expr(f"(idx - 1) div {size}").alias("seg")).agg(F.array_sort(F.collect_list(F.struct("idx", *values))).alias("v"))


def _rows(first: str, step: str, row: str, kind: str) -> str:
    """Array of `row` at every element e of v, of the state s.a before it."""
    none = f"cast(array() as array<{kind}>)"
    return f"aggregate(v, named_struct('a', {first}, 'out', {none}), (s, e) -> named_struct('a', {step}, 'out', array_append(s.out, {row})), s -> s.out)"


def carried(parts: DataFrame, identity: str, kind: str, joined: Callable[[str, str], str], size: int = SIZE) -> DataFrame:
    """(ticker, seg, before): the composite of the maps m of all earlier segments. joined(a, b) is the map of a, then b."""
    held = lambda df, *key: df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seg", "m"))).alias("v"))
    told = lambda first: "inline(" + _rows(first, joined("s.a", "e.m"), "named_struct('seg', e.seg, 'before', s.a)", f"struct<seg: bigint, before: {kind}>") + ")"
    blocks = held(parts.withColumn("block", F.expr(f"seg div {size}")), "ticker", "block")
    tops = blocks.selectExpr("ticker", "block as seg", f"aggregate(v, {identity}, (a, e) -> {joined('a', 'e.m')}) as m")
    tops = held(tops, "ticker").selectExpr("ticker", told(identity)).withColumnsRenamed({"seg": "block", "before": "first"})
    return blocks.join(tops, ["ticker", "block"]).selectExpr("ticker", told("first"))


def _array(items: list[str]) -> str:
    return f"array({', '.join(items)})"


def variance_paths(rows: DataFrame, omega: list[float], alpha: list[float], beta: list[float], mu: float = 0.0, floor: float = 1e-12, x: str = "g") -> DataFrame:
    """(ticker, seg, idx, x, s2): variances of K regimes at every step given the steps before it, from their unconditional ones.

    s2' = max(omega + alpha (x - mu)^2 + beta s2, floor). The map max(a + b s2, c) is closed under composition. The first
    variance has a denominator of 1e-6 at least.
    """
    k = range(len(omega))
    shock = lambda i: f"({omega[i]!r}D + {alpha[i]!r}D * (e.x - {mu!r}D) * (e.x - {mu!r}D))"

    def composite(a: str, b: Callable[[int, str], str]) -> str:
        return "named_struct('a', {}, 'b', {}, 'c', {})".format(
            _array([f"{b(i, 'a')} + {b(i, 'b')} * {a}.a[{i}]" for i in k]),
            _array([f"{b(i, 'b')} * {a}.b[{i}]" for i in k]),
            _array([f"greatest({b(i, 'a')} + {b(i, 'b')} * {a}.c[{i}], {b(i, 'c')})" for i in k]),
        )

    one = lambda i, part: {"a": shock(i), "b": f"{beta[i]!r}D", "c": f"{floor!r}D"}[part]
    identity = "named_struct('a', {}, 'b', {}, 'c', {})".format(*(_array([v] * len(omega)) for v in ("0D", "1D", "0D")))
    kind = "struct<a: array<double>, b: array<double>, c: array<double>>"
    held = segmented(rows.withColumn("x", F.col(x).cast("double")), "x")
    parts = held.selectExpr("ticker", "seg", f"aggregate(v, {identity}, (a, e) -> {composite('a', one)}) as m")
    before = carried(parts, identity, kind, lambda a, b: composite(a, lambda i, part: f"{b}.{part}[{i}]"))
    start = [omega[i] / max(1 - alpha[i] - beta[i], 1e-6) for i in k]
    first = _array([f"greatest(before.a[{i}] + before.b[{i}] * {start[i]!r}D, before.c[{i}])" for i in k])
    step = _array([f"greatest({shock(i)} + {beta[i]!r}D * s.a[{i}], {floor!r}D)" for i in k])
    out = _rows(first, step, "named_struct('idx', e.idx, 'x', e.x, 's2', s.a)", "struct<idx: bigint, x: double, s2: array<double>>")
    return held.join(before, ["ticker", "seg"]).selectExpr("ticker", "seg", f"inline({out})")


def state_filter(rows: DataFrame, move: list[list[float]], prior: list[float], keep: tuple[str, ...] = ()) -> DataFrame:
    """(ticker, idx, keep, pred, p, ll) of rows (ticker, idx, keep, logf): state probabilities before and after every step.

    logf: log densities of the step in every state; ll: the step's log density; prior: the prediction of the first step; the
    rows of move sum to 1. Where a step has no density in any state, p stays as predicted and ll has ln(1e-12) in its place.
    Products are of K x K matrices with a logarithm of their scale beside them. A segment whose product is all zero, which
    takes a move with zeros, starts from the prior.
    """
    k = range(len(prior))
    top = F.array_max("logf")
    some = top > float("-inf")
    steps = rows.withColumn("top", F.when(some, top).otherwise(0.0)).withColumn("w", F.when(some, F.transform("logf", lambda x: F.exp(x - F.col("top")))).otherwise(F.transform("logf", lambda x: F.lit(1e-12))))
    held = segmented(steps, "top", "w", *keep)
    at = lambda a, i, j: f"{a}[{i * len(prior) + j}]"
    ahead = lambda a, j, i: f"if(e.idx = 1, {at(a, j, i)}, {' + '.join(f'{move[h][j]!r}D * {at(a, h, i)}' for h in k)})"

    def scaled(items: list[str], c: str) -> str:
        return let(let(_array(items), "q", "named_struct('q', q, 'h', array_max(q))"), "r", f"named_struct('m', transform(r.q, z -> if(r.h > 0D, z / r.h, 0D)), 'c', {c} + if(r.h > 0D, ln(r.h), 0D))")

    identity = f"named_struct('m', {_array(['1D' if i == j else '0D' for i in k for j in k])}, 'c', 0D)"
    product = scaled([f"e.w[{j}] * ({ahead('a.m', j, i)})" for j in k for i in k], "a.c + e.top")
    parts = held.selectExpr("ticker", "seg", f"aggregate(v, {identity}, (a, e) -> {product}) as m")
    joined = lambda a, b: scaled([" + ".join(f"{at(f'{b}.m', j, h)} * {at(f'{a}.m', h, i)}" for h in k) for j in k for i in k], f"{a}.c + {b}.c")
    before = carried(parts, identity, "struct<m: array<double>, c: double>", joined)
    raw = _array([" + ".join(f"{at('before.m', j, i)} * {prior[i]!r}D" for i in k) for j in k])
    total = "aggregate(u, 0D, (y, z) -> y + z)"
    first = let(raw, "u", f"if({total} > 0D, transform(u, z -> z / {total}), {_array([f'{x!r}D' for x in prior])})")
    pred = _array([f"if(e.idx = 1, s.a.p[{j}], {' + '.join(f'{move[i][j]!r}D * s.a.p[{i}]' for i in k)})" for j in k])
    joint = "named_struct('pred', g, 'u', zip_with(g, e.w, (y, z) -> y * z))"
    mass = "aggregate(h.u, 0D, (y, z) -> y + z)"
    state = let(let(pred, "g", joint), "h", let(mass, "n", f"named_struct('pred', h.pred, 'p', if(n > 0D, transform(h.u, z -> z / n), h.pred), 'll', e.top + ln(if(n > 0D, n, 1e-12D)))"))
    kind = "struct<pred: array<double>, p: array<double>, ll: double>"
    kept = [(c, rows.schema[c].dataType.simpleString()) for c in ("idx", *keep)]
    none = f"cast(array() as array<struct<{', '.join(f'{c}: {t}' for c, t in kept)}, r: {kind}>>)"
    row = ", ".join(f"'{c}', e.{c}" for c, _ in kept)
    both = f"named_struct('a', r, 'out', array_append(s.out, named_struct({row}, 'r', r)))"
    begin = f"named_struct('a', named_struct('pred', a, 'p', a, 'll', 0D), 'out', {none})"
    fold = let(first, "a", f"aggregate(v, {begin}, (s, e) -> {let(state, 'r', both)}, s -> s.out)")
    return held.join(before, ["ticker", "seg"]).selectExpr("ticker", f"inline({fold})").select("ticker", "idx", *keep, "r.*")


def gaussian_logs(x: str, variances: list[str], mu: str = "0D") -> str:
    """Log densities of x under normals of these variances."""
    return _array([f"-0.5D * (ln(2D * pi() * {v}) + ({x} - {mu}) * ({x} - {mu}) / {v})" for v in variances])


def stationary(move: list[list[float]], steps: int = 50, floor: float = 1e-12) -> list[float]:
    """State probabilities after `steps` moves from equal ones, floored and made to sum to 1 at each."""
    p = [1 / len(move)] * len(move)
    for _ in range(steps):
        p = [max(sum(p[i] * move[i][j] for i in range(len(p))), floor) for j in range(len(p))]
        p = [x / sum(p) for x in p]
    return p


def hamilton_filter(rows: DataFrame, omega: list[float], alpha: list[float], beta: list[float], mu: float, move: list[list[float]], x: str = "g") -> DataFrame:
    """(ticker, idx, x, s2, pred, p, ll) of a Markov-switching GARCH whose regimes have variance paths of their own."""
    paths = variance_paths(rows, omega, alpha, beta, mu, x=x)
    logs = paths.withColumn("logf", F.expr(gaussian_logs("x", [f"s2[{i}]" for i in range(len(omega))], f"{mu!r}D")))
    return state_filter(logs, move, stationary(move), ("x", "s2"))


def predictive(filtered: DataFrame, move: list[list[float]]) -> DataFrame:
    """(ticker, idx, pred): the prediction of every step, and of the one after the last."""
    ahead = _array([" + ".join(f"{move[i][j]!r}D * p[{i}]" for i in range(len(move))) for j in range(len(move))])
    last = filtered.groupBy("ticker").agg(F.max("idx").alias("idx"), F.max_by("p", "idx").alias("p")).selectExpr("ticker", "idx + 1 as idx", f"{ahead} as pred")
    return filtered.select("ticker", "idx", "pred").unionByName(last)
