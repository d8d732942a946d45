"""Family-wise correction of several claims: the level at which each pass would just stand, by Bonferroni or Holm."""

from __future__ import annotations

from ..errors import fail
from ..functions import numeric
from ..schema import Metric, Options

# The least level searched, and halvings of the search.
FLOOR, STEPS = 1e-12, 60


def achieved_alpha(m: Metric, report: dict, confidence: float) -> float:
    """The least level at which the lower bound still meets the threshold, by bisection."""
    n, effect = report["paired_count"], report["effect"]

    def lower(gamma: float) -> float:
        if m.kind == "elo":
            return numeric.elo_interval(numeric.score_from_elo(effect), n, 1 - gamma)[0]
        return numeric.binomial_interval(m.ci_method, report["candidate_count"], n, 1 - gamma)[0] - 0.5

    lo, hi = FLOOR, 1 - confidence
    for _ in range(STEPS):
        mid = lo + (hi - lo) / 2
        lo, hi = (lo, mid) if lower(mid) >= report["pass_above"] else (mid, hi)
    return hi


def adjust(achieved: list[float | None], alpha: float, method: str) -> list[tuple[float | None, bool | None]]:
    """(threshold, stands) of each claim; None for those that make none. The family is all of them.

    Holm takes claims of one level, as FLOOR is for all that lie below it, in their order.
    """
    m = len(achieved)
    out: list[tuple[float | None, bool | None]] = [(None, None)] * m
    standing = True
    for k, i in enumerate(sorted((i for i, a in enumerate(achieved) if a is not None), key=lambda i: achieved[i])):
        level = alpha / (m if method == "bonferroni" else m - k)
        stands = achieved[i] <= level
        standing = standing and stands
        out[i] = level, stands if method == "bonferroni" else standing
    return out


def apply_correction(reports: list[dict], metrics: list[Metric], o: Options) -> None:
    if o.correction == "none" or len(reports) < 2:
        return
    if any("cluster_count" in r for r in reports):
        fail("CorrectionConflictsWithClusterById", "correction doesn't apply to clusters")
    for m in metrics:
        if m.kind in ("mean-diff", "quantile-diff"):
            fail("CorrectionRequiresClosedFormCi", f"correction doesn't apply to {m.kind}")
    achieved = [achieved_alpha(m, r, o.confidence) if r["verdict"] == "pass" else None for m, r in zip(metrics, reports, strict=True)]
    for r, a, (level, stands) in zip(reports, achieved, adjust(achieved, 1 - o.confidence, o.correction), strict=True):
        verdict = r["verdict"] if stands is None else "pass" if stands else "inconclusive"
        promoted = "promoted" if (r["validity"], verdict) == ("valid", "pass") else "not_promoted"
        r |= {"correction_method": o.correction, "family_size": len(reports)}
        if a is not None:
            r |= {"achieved_alpha": a, "adjusted_alpha_threshold": level}
        r |= {"unadjusted_verdict": r["verdict"], "family_adjusted_verdict": verdict, "family_adjusted_promotion": promoted}
