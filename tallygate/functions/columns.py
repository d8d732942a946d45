"""The closed forms as column expressions, so that they run inside Spark's generated code, one value per group."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SprtConfig, Thresholds
from . import numeric


def between(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def wilson(p: Column, n: Column, confidence: float) -> tuple[Column, Column]:
    """Null where n is 0."""
    z = numeric.z_two_sided(confidence)
    n = F.when(n > 0, n.cast("double"))
    d = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / d
    margin = z / d * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.greatest(centre - margin, F.lit(0.0)), F.least(centre + margin, F.lit(1.0))


def elo_from_score(p: Column) -> Column:
    return -400 * F.log10(1 / between(p, numeric.ELO_CLAMP, 1 - numeric.ELO_CLAMP) - 1)


def points2(outcome: Column, win: str = "candidate_win") -> Column:
    """Twice the points of an outcome, so that sums stay whole numbers."""
    return F.when(outcome == win, 2).when(outcome == "draw", 1).when(outcome.isNotNull(), 0)


def verdict(ci_low: Column, ci_high: Column, t: Thresholds) -> Column:
    return F.when(ci_low >= t.pass_above, "pass").when(ci_high <= t.fail_below, "fail").otherwise("inconclusive")


def wald_llr(config: SprtConfig, wins: Column, losses: Column) -> Column:
    up, down = numeric.wald_steps(config.elo0, config.elo1)
    return wins * up + losses * down


def drawelo(wins: Column, draws: Column, losses: Column) -> Column:
    n = F.nullif(wins + draws + losses, F.lit(0)).cast("double")
    w, x = (between(c / n, numeric.ELO_CLAMP, 1 - numeric.ELO_CLAMP) for c in (wins, losses))
    return 200 * F.log10((1 - x) / x * (1 - w) / w)


def trinomial_llr(config: SprtConfig, wins: Column, draws: Column, losses: Column) -> Column:
    d = drawelo(wins, draws, losses)

    def probabilities(elo: float) -> tuple[Column, Column, Column]:
        win, loss = (1 / (1 + F.pow(F.lit(10.0), (d + s * elo) / 400)) for s in (-1, 1))
        return win, 1 - win - loss, loss

    out = F.lit(0.0)
    for k, p0, p1 in zip((wins, draws, losses), probabilities(config.elo0), probabilities(config.elo1), strict=True):
        out = out + F.when(k > 0, k * F.log(p1 / p0)).otherwise(0.0)
    return out


def sprt_verdict(llr: Column, config: SprtConfig) -> Column:
    lo, hi = numeric.wald_bounds(config.alpha, config.beta)
    return F.when(llr >= hi, "pass").when(llr <= lo, "fail").otherwise("inconclusive")


def bootstrap_interval(draws: Column, effect: Column, method: str, confidence: float, resamples: int) -> tuple[Column, Column]:
    """Percentile or basic interval from an array of draws."""
    tail = (1 - confidence) / 2
    lo, hi = (F.get(F.sort_array(draws), F.lit(i)) for i in numeric.ranks(tail, 1 - tail, resamples))
    return (lo, hi) if method == "percentile" else (2 * effect - hi, 2 * effect - lo)
