"""Special functions as SQL expressions over doubles, for which Spark has no built-in one."""

from __future__ import annotations

import math


def lgamma(x: str) -> str:
    """Logarithm of the gamma function for x > 0, to about 1e-13 of its size: Stirling's series of x + 8 less the logarithms on the way."""
    z = f"({x} + 8D)"
    down = " + ".join(f"ln({x} + {i}D)" for i in range(8))
    series = f"(1D / 12 - (1D / 360 - (1D / 1260 - (1D / 1680 - 1D / 1188 / {z} / {z}) / {z} / {z}) / {z} / {z}) / {z} / {z}) / {z}"
    return f"(({z} - 0.5D) * ln({z}) - {z} + {0.5 * math.log(2 * math.pi)!r}D + {series} - ({down}))"


#: A published rational approximation of the normal tail, from the highest power down: fixed values.
_TAIL_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_TAIL_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def let(value: str, name: str, then: str) -> str:
    """An expression of a value that is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def _polynomial(x: str, coefficients: tuple[float, ...]) -> str:
    out = f"{coefficients[0]!r}D"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}D)"
    return out


def normal_cdf(x: str) -> str:
    """Distribution function of the standard normal, to about 1e-15; 0 and 1 beyond 7."""
    tail = f"if(abs(y) > 7D, 0D, exp(-y * y / 2D) * {_polynomial('abs(y)', _TAIL_TOP)} / {_polynomial('abs(y)', _TAIL_BOTTOM)})"
    return let(x, "y", let(tail, "q", "if(y > 0D, 1D - q, q)"))


def t_cdf(x: str, nu: float, terms: int = 1000) -> str:
    """Distribution function of Student's t: a finite sum in the cosine of atan(x / sqrt(nu)) for a whole number of degrees of
    freedom, else a series in x^2 / (nu + x^2), whose n-th term falls as n to the power -1 - nu / 2."""
    if nu == int(nu):
        odd, sums, weight = int(nu) % 2, [], 1.0
        for k in range(int(nu) // 2 if not odd else (int(nu) - 1) // 2):
            sums.append(f"{weight!r}D * pow(c, {2 * k + odd})")
            weight *= (2 * k + 2) / (2 * k + 3) if odd else (2 * k + 1) / (2 * k + 2)
        total = f"sin(a) * ({' + '.join(sums) or '0D'})"
        inner = f"(a + {total}) / pi()" if odd else f"{total} / 2D"
        return let(f"atan({x} / {math.sqrt(nu)!r}D)", "a", let("cos(a)", "c", f"0.5D + {inner}"))
    scale = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(math.pi * nu)
    z = f"(y * y / ({nu!r}D + y * y))"
    fold = f"aggregate(sequence(1, {terms}), named_struct('c', 1D, 's', 1D), (a, n) -> named_struct('c', a.c * (n - {nu / 2!r}D) / n * {z}, 's', a.s + a.c * (n - {nu / 2!r}D) / n * {z} / (2 * n + 1)), a -> a.s)"
    return let(x, "y", f"0.5D + {scale!r}D * y / sqrt(1D + y * y / {nu!r}D) * {fold}")


def ged_deviation(scale: str, shape: str) -> str:
    """Standard deviation of a generalised error distribution of this scale and shape."""
    three, one = lgamma(f"(3D / {shape})"), lgamma(f"(1D / {shape})")
    return f"({scale} * exp(0.5D * ({three} - {one})))"


def merged_logs(a: str, b: str) -> str:
    """Pair (m, s), for s exp(m), of the sum of two such pairs; m is -Infinity only where nothing positive came in."""
    m = f"greatest({a}.m, {b}.m)"
    part = lambda p: f"if({p}.s > 0D, {p}.s * exp({p}.m - {m}), 0D)"
    return f"named_struct('m', {m}, 's', {part(a)} + {part(b)})"


def log_pair(x: str) -> str:
    """Pair of exp(x)."""
    return f"named_struct('m', {x}, 's', if({x} > double('-Infinity'), 1D, 0D))"


def log_of(pair: str) -> str:
    return f"if({pair}.s > 0D, {pair}.m + ln({pair}.s), double('-Infinity'))"
