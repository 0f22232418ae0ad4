"""Statistics as columns: binomial tail, isotonic fit over anchors, interpolation, hashed uniforms."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_PRIME = 2147483647


def log_factorial(n: Column) -> Column:
    """ln(n!) by Stirling's series at n+10, walked back; error below 1e-13 of the value."""
    x = n + 10.0
    series = 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5)) - 1 / (1680 * F.pow(x, 7))
    back = sum((F.log(n + float(i)) for i in range(1, 11)), F.lit(0.0))
    return (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + series - back


def binomial_p_half(k: Column, n: Column) -> Column:
    """Two-sided exact p-value of k successes in n fair trials.

    Under p = 1/2 the outcomes no likelier than k are both tails from m = min(k, n-k). The tail is
    pmf(m) times a sum of ratios that fall off like a Gaussian, so 12*sqrt(n) terms reach double
    precision; the array per row is that short even for very large n.
    """
    m = F.least(k, n - k)
    log_pmf = log_factorial(n) - log_factorial(m) - log_factorial(n - m) - n * math.log(2.0)
    terms = F.least(m, F.ceil(12 * F.sqrt(n)).cast("bigint") + 50)
    tail = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), terms),
        F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("t")),
        lambda acc, j: F.struct(
            (acc["s"] + acc["t"]).alias("s"),
            (acc["t"] * (m - j) / (n - m + j + 1)).alias("t"),
        ),
        lambda acc: acc["s"],
    )
    p = F.when(2 * m == n, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.exp(log_pmf) * tail))
    return F.when((n == 0) | (k < 0) | (k > n), 1.0).otherwise(p)


def signal_verdict(wins: Column, total: Column, p: Column, alpha: float = 0.05) -> Column:
    return (
        F.when((total == 0) | (p >= alpha), "weak")
        .when(wins / total > 0.5, "alive")
        .otherwise("dead")
    )


def decay_label(train_v: Column, test_v: Column, train_n: Column, test_n: Column) -> Column:
    return (
        F.when((train_n == 0) | (test_n == 0), "insufficient_oos")
        .when(test_v == "dead", "reversed")
        .when((train_v == "alive") & (test_v == "alive"), "confirmed_alive")
        .when(train_v == "alive", "train_only")
        .otherwise("noise")
    )


def isotonic_fit(points: Column) -> Column:
    """Weighted non-decreasing fit of a small x-sorted array of struct(x, y, w).

    y_i = max over j<=i of min over k>=i of the weighted mean of points j..k: the same projection
    pooling adjacent violators gives. The array holds one entry per confidence bucket.
    """
    n = F.size(points)

    def mean(j, k):
        part = F.slice(points, j, k - j + 1)
        wy = F.aggregate(part, F.lit(0.0), lambda a, p: a + p["y"] * p["w"])
        w = F.aggregate(part, F.lit(0.0), lambda a, p: a + p["w"])
        return wy / w

    fitted = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.struct(
            F.element_at(points, i)["x"].alias("x"),
            F.array_max(
                F.transform(
                    F.sequence(F.lit(1), i),
                    lambda j: F.array_min(F.transform(F.sequence(i, n), lambda k: mean(j, k))),
                )
            ).alias("y"),
        ),
    )
    return F.when(n > 0, fitted)


def interpolate(c: Column, pts: Column) -> Column:
    """Piecewise-linear value of `c` on x-sorted struct(x, y) anchors, clamped at both ends."""
    n = F.size(pts)
    first, last = F.element_at(pts, 1), F.element_at(pts, -1)
    seg = F.element_at(
        F.filter(
            F.sequence(F.lit(1), n - 1),
            lambda i: (F.element_at(pts, i)["x"] <= c) & (c <= F.element_at(pts, i + 1)["x"]),
        ),
        1,
    )
    a, b = F.element_at(pts, seg), F.element_at(pts, seg + 1)
    line = F.when(b["x"] == a["x"], b["y"]).otherwise(
        a["y"] + (c - a["x"]) / (b["x"] - a["x"]) * (b["y"] - a["y"])
    )
    return (
        F.when(pts.isNull() | (n == 0), c)
        .when(c <= first["x"], first["y"])
        .when(c >= last["x"], last["y"])
        .otherwise(line)
    )


def hash_pair(key: Column) -> tuple[Column, Column]:
    """Two independent 32-bit integers of a key, identical in any engine with md5."""
    h = F.md5(key.cast("string"))
    part = lambda s: F.conv(F.substring(h, s, 8), 16, 10).cast("bigint")
    return part(1), part(9)


def rep_uniform(a: Column, b: Column, rep: Column) -> Column:
    """Replicate `rep`'s integer uniform in [0, HASH_PRIME); pairwise independent over replicates."""
    return (a * rep + b) % HASH_PRIME


def _poisson1_cuts() -> tuple[int, ...]:
    """P(X <= i) of Poisson(1) in units of the uniform, as far as the uniform can tell from 1."""
    cuts, p, total, i = [], math.exp(-1), math.exp(-1), 0
    while int(total * HASH_PRIME) < HASH_PRIME - 1:
        cuts.append(int(total * HASH_PRIME))
        i += 1
        p /= i
        total += p
    return tuple(cuts)


POISSON1_CUTS = _poisson1_cuts()


def poisson1(u: Column) -> Column:
    """Poisson(1) draw from an integer uniform."""
    return sum(((u >= cut).cast("int") for cut in POISSON1_CUTS), F.lit(0))


def poisson1_draws(u: np.ndarray) -> np.ndarray:
    """`poisson1` of an array of integer uniforms, as doubles."""
    u = u.astype(np.int32)
    w = np.zeros(u.shape, np.uint8)
    for cut in POISSON1_CUTS:
        w += u >= cut
    return w.astype(np.float64)


def poisson_draws(mean: float, u: np.ndarray) -> np.ndarray:
    """Poisson draws by inversion at integer uniforms in [0, HASH_PRIME).

    The distribution is summed over thirteen standard deviations and 30 to both sides of its mean, beyond which there is less than the uniforms can tell.
    """
    reach = 13 * math.sqrt(mean) + 30
    k = np.arange(max(0, math.floor(mean - reach)), math.ceil(mean + reach) + 1)
    steps = np.concatenate([[0.0], np.cumsum(math.log(mean) - np.log(k[1:]))])
    below = np.cumsum(np.exp(steps + k[0] * math.log(mean) - mean - math.lgamma(k[0] + 1)))
    return k[np.minimum(np.searchsorted(below, (u + 0.5) / HASH_PRIME, "right"), len(k) - 1)]


def nearest_rank(p: float, m: Column) -> Column:
    """1-based nearest-rank position ceil(p*m), at least 1 and at most m."""
    return F.least(m, F.greatest(F.lit(1), F.ceil(F.lit(p) * m))).cast("bigint")
