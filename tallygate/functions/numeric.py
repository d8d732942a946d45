"""Intervals, ratings and likelihood ratios on plain numbers. Everything here works on sufficient statistics of a few numbers."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from ..errors import fail

ELO_CLAMP = 1e-4

# Coefficients of Acklam's rational approximation of the normal quantile.
_CENTRE_NUM = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_CENTRE_DEN = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_TAIL_NUM = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_TAIL_DEN = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
TAIL = 0.02425
# Fixed values of the pentanomial test: a bucket's least count, and how near to its poles the search begins.
LEAST_COUNT, EDGE = 1e-3, 1e-9


def _poly(coefficients: tuple[float, ...], x: float) -> float:
    out = 0.0
    for c in coefficients:
        out = out * x + c
    return out


def normal_quantile(p: float) -> float:
    if not 0 < p < 1:
        return math.copysign(math.inf, p - 0.5) if p in (0, 1) else math.nan
    if TAIL <= p <= 1 - TAIL:
        q = p - 0.5
        return q * _poly(_CENTRE_NUM, q * q) / _poly(_CENTRE_DEN, q * q)
    q = math.sqrt(-2 * math.log(min(p, 1 - p)))
    x = _poly(_TAIL_NUM, q) / _poly(_TAIL_DEN, q)
    return x if p < 0.5 else -x


def normal_quantiles(p: np.ndarray) -> np.ndarray:
    """Of numbers between 0 and 1."""
    q = p - 0.5
    tail = np.sqrt(-2 * np.log(np.minimum(p, 1 - p)))
    outer = _poly(_TAIL_NUM, tail) / _poly(_TAIL_DEN, tail)
    return np.where((p >= TAIL) & (p <= 1 - TAIL), q * _poly(_CENTRE_NUM, q * q) / _poly(_CENTRE_DEN, q * q), np.where(p < 0.5, outer, -outer))


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


@lru_cache(4096)
def z_two_sided(confidence: float) -> float:
    return normal_quantile(1 - (1 - confidence) / 2)


# --- binomial intervals --------------------------------------------------------------------------


def wilson(p: float, n: float, confidence: float) -> tuple[float, float]:
    z = z_two_sided(confidence)
    d = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / d
    margin = z / d * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return max(0.0, centre - margin), min(1.0, centre + margin)


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - front * _fraction(1 - x, b, a) / b
    return front * _fraction(x, a, b) / a


def _fraction(x: float, a: float, b: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


@lru_cache(65536)
def beta_quantile(p: float, a: float, b: float) -> float:
    """Newton steps kept between bounds by bisection."""
    if p <= 0 or p >= 1:
        return float(p >= 1)
    lo, hi = 0.0, 1.0
    mean, sd = a / (a + b), math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
    x = min(max(mean + sd * normal_quantile(p), 1e-12), 1 - 1e-12)
    log_b = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    for _ in range(200):
        f = beta_cdf(x, a, b) - p
        if f > 0:
            hi = x
        else:
            lo = x
        slope = math.exp((a - 1) * math.log(x) + (b - 1) * math.log1p(-x) - log_b) if 0 < x < 1 else 0.0
        step = x - f / slope if slope > 0 and math.isfinite(slope) else math.nan
        new = step if lo < step < hi else (lo + hi) / 2
        if abs(new - x) <= 1e-16 + 1e-15 * x or hi - lo < 1e-17:
            return new
        x = new
    return x


def clopper_pearson(k: int, n: int, confidence: float) -> tuple[float, float]:
    a = (1 - confidence) / 2
    return (beta_quantile(a, k, n - k + 1) if k else 0.0), (beta_quantile(1 - a, k + 1, n - k) if k < n else 1.0)


def jeffreys(k: int, n: int, confidence: float) -> tuple[float, float]:
    a = (1 - confidence) / 2
    return (beta_quantile(a, k + 0.5, n - k + 0.5) if k else 0.0), (beta_quantile(1 - a, k + 0.5, n - k + 0.5) if k < n else 1.0)


def binomial_interval(method: str, k: int, n: int, confidence: float) -> tuple[float, float]:
    if n == 0:
        fail("EmptyInput", "an interval needs a trial")
    return wilson(k / n, n, confidence) if method == "wilson" else (clopper_pearson if method == "exact" else jeffreys)(k, n, confidence)


# --- ratings ---------------------------------------------------------------------------------------


def elo_from_score(p: float) -> float:
    return -400 * math.log10(1 / min(max(p, ELO_CLAMP), 1 - ELO_CLAMP) - 1)


def score_from_elo(e: float) -> float:
    return 1 / (1 + 10 ** (-e / 400))


def elo_interval(score: float, n: float, confidence: float) -> tuple[float, float]:
    lo, hi = wilson(score, n, confidence)
    return elo_from_score(lo), elo_from_score(hi)


def bayes_probabilities(elo: float, drawelo: float) -> tuple[float, float, float]:
    """Win, draw, loss in the BayesElo model."""
    win, loss = 1 / (1 + 10 ** ((drawelo - elo) / 400)), 1 / (1 + 10 ** ((drawelo + elo) / 400))
    return win, 1 - win - loss, loss


def drawelo_from_rates(win: float, loss: float) -> float:
    w, x = (min(max(v, ELO_CLAMP), 1 - ELO_CLAMP) for v in (win, loss))
    return 200 * math.log10((1 - x) / x * (1 - w) / w)


# --- sequential tests ------------------------------------------------------------------------------


def wald_bounds(alpha: float, beta: float) -> tuple[float, float]:
    return math.log(beta / (1 - alpha)), math.log((1 - beta) / alpha)


def wald_steps(elo0: float, elo1: float) -> tuple[float, float]:
    """What a win and a loss add to the log likelihood ratio."""
    p0, p1 = score_from_elo(elo0), score_from_elo(elo1)
    return math.log(p1 / p0), math.log((1 - p1) / (1 - p0))


def wald_llr(elo0: float, elo1: float, wins: int, losses: int) -> float:
    up, down = wald_steps(elo0, elo1)
    return wins * up + losses * down


def trinomial_llr(elo0: float, elo1: float, wins: int, draws: int, losses: int) -> tuple[float, float | None]:
    """(llr, drawelo); no drawelo without games."""
    n = wins + draws + losses
    if not n:
        return 0.0, None
    d = drawelo_from_rates(wins / n, losses / n)
    before, after = bayes_probabilities(elo0, d), bayes_probabilities(elo1, d)
    return sum(k * math.log(b / a) for k, a, b in zip((wins, draws, losses), before, after, strict=True) if k), d


def pentanomial_llr(elo0: float, elo1: float, buckets: list[int]) -> float:
    """Generalised ratio over pair scores 0, 1/4, ..., 1; empty buckets count 0.001."""
    counts = np.maximum(np.array(buckets, float), LEAST_COUNT)
    p, scores = counts / counts.sum(), np.arange(5) / 4

    def fitted(elo: float) -> np.ndarray:
        # The likeliest distribution with this mean: p / (1 + x a) where the mean of a is zero.
        a = scores - score_from_elo(elo)
        lo, hi = -1 / a.max() + EDGE, -1 / a.min() - EDGE
        for _ in range(100):
            x = (lo + hi) / 2
            lo, hi = (x, hi) if (p * a / (1 + x * a)).sum() > 0 else (lo, x)
        return p / (1 + (lo + hi) / 2 * a)

    return float(counts.sum() * (p * (np.log(fitted(elo1)) - np.log(fitted(elo0)))).sum())


# --- resampling ------------------------------------------------------------------------------------


def quantile(values: np.ndarray, q: float) -> float:
    """Linear between order statistics (type 7)."""
    return float(np.quantile(values, q))


def ranks(p_low: float, p_high: float, n: int) -> tuple[int, int]:
    """Indices of the interval's ends among n sorted draws."""
    return min(math.floor(p_low * n), n - 1), min(max(math.ceil(p_high * n) - 1, 0), n - 1)


def percentile_interval(draws: np.ndarray, confidence: float) -> tuple[float, float]:
    a = (1 - confidence) / 2
    lo, hi = ranks(a, 1 - a, len(draws))
    s = np.sort(draws)
    return float(s[lo]), float(max(s[hi], s[lo]))


def basic_interval(draws: np.ndarray, effect: float, confidence: float) -> tuple[float, float]:
    lo, hi = percentile_interval(draws, confidence)
    return 2 * effect - hi, 2 * effect - lo


def acceleration(left_out: np.ndarray, weights: np.ndarray | None = None) -> float:
    """Skewness of leave-one-out values; ``weights`` says how often each stands."""
    w = np.ones(len(left_out)) if weights is None else weights
    if w.sum() <= 0:
        return 0.0
    gap = (w * left_out).sum() / w.sum() - left_out
    return acceleration_from_sums((w * gap**3).sum(), (w * gap**2).sum())


def acceleration_from_sums(cubes: float, squares: float) -> float:
    return 0.0 if squares < 1e-12 else float(cubes / (6 * squares**1.5))


def bca_levels(share_below: float, n: int, a: float, confidence: float) -> tuple[float, float]:
    """Corrected levels of the two ends, from the share of draws below the effect among n."""
    z0 = normal_quantile(min(max(share_below, 0.5 / n), 1 - 0.5 / n))

    def level(p: float) -> float:
        s = z0 + normal_quantile(p)
        d = 1 - a * s
        return normal_cdf(s if abs(d) < 1e-12 else z0 + s / d)

    tail = (1 - confidence) / 2
    return level(tail), level(1 - tail)


def bca_interval(draws: np.ndarray, effect: float, a: float, confidence: float) -> tuple[float, float]:
    s = np.sort(draws)
    lo, hi = ranks(*bca_levels(float((s < effect).mean()), len(s), a, confidence), len(s))
    return float(s[lo]), float(max(s[hi], s[lo]))


# --- searches --------------------------------------------------------------------------------------


def smallest(lo: int, hi: int, good: Callable[[int], bool]) -> int:
    """The least integer in [lo, hi] that is good, if good ones follow the others."""
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if good(mid) else (mid + 1, hi)
    return lo
