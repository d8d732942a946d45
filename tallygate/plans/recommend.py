"""Match plans: which pairs to play next, from the widths of a matrix's intervals."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

from ..errors import fail
from ..functions import numeric
from ..schema import SCHEMA_VERSION
from .matrix import matrix

MOST = 2**64 - 1


def plan(spark: SparkSession, legacy: list, match_tables: list, *, min_elo: float, confidence: float = 0.95, **options) -> dict:
    if not math.isfinite(min_elo) or min_elo <= 0:
        fail("InvalidThreshold", "min_elo must be finite and positive")
    m = matrix(spark, legacy, match_tables, confidence=confidence, **options)
    found = {c["name"]: c for c in m["candidates"]}
    rows = [_recommend(cell, found, min_elo, confidence) for cell in m["matrix"]]
    # Pairs without an interval first, then those that need the most games.
    rows.sort(key=lambda r: (r["current_ci_half_width"] is not None, -(MOST if r["estimated_additional_trials"] is None else r["estimated_additional_trials"]), r["row"], r["col"]))
    return {"schema_version": SCHEMA_VERSION, "min_elo": min_elo, "recommendations": rows}


def _recommend(cell: dict, found: dict[str, dict], target: float, confidence: float) -> dict:
    out = {"row": cell["row"], "col": cell["col"], "status": cell["status"], "current_ci_half_width": None, "estimated_additional_trials": None, "note": None}
    if cell["ci_low"] is None:
        apart = cell["status"] == "disconnected"
        return out | {"note": "no games connect these two yet; a direct one is needed first" if apart else "connected, but by too few games to survive resampling; more games on the way between them would help"}
    now = (cell["ci_high"] - cell["ci_low"]) / 2
    out["current_ci_half_width"] = now
    ends = [found[n] for n in (cell["row"], cell["col"]) if n in found]
    if now <= target:
        return out | {"estimated_additional_trials": 0}
    exact = by_wilson(ends[0], now, target, confidence) if len(ends) == 1 else None
    return out | {"estimated_additional_trials": by_width(ends, now, target) if exact is None else exact}


def by_wilson(c: dict, now: float, target: float, confidence: float) -> int | None:
    """For a baseline cell whose interval is Wilson's own: the games at which that is narrow enough."""
    n = c["paired_count"]
    if not n:
        return None
    draws = n - c["candidate_count"] - c["baseline_count"]
    p = (c["candidate_count"] + draws / 2) / n

    def half_width(k: int) -> float:
        lo, hi = numeric.elo_interval(p, k, confidence)
        return (hi - lo) / 2

    if abs(half_width(n) - now) > 1e-6:
        return None
    needed = n * (now / target) ** 2
    if not math.isfinite(needed) or needed >= 2**64:
        return MOST
    top = max(int(needed * 2), n + 1)
    return max(0, int(needed) - n) if half_width(top) > target else numeric.smallest(n, top, lambda k: half_width(k) <= target) - n


def by_width(ends: list[dict], now: float, target: float) -> int | None:
    """Widths fall as the root of the games of the end that has fewer."""
    n = min((c["paired_count"] for c in ends), default=0)
    needed = n * (now / target) ** 2
    if not n or not math.isfinite(needed):
        return None
    return MOST if needed >= 2**64 else max(0, int(needed) - n)
