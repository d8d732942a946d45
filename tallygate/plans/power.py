"""Sample sizes: how many trials a gate needs to pass a candidate of a given strength."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import fail
from ..functions import numeric
from ..operators import netting
from ..operators.resample import generator
from ..operators.trials import raise_error
from ..schema import CI_METHODS, DEFAULT_SEED, SCHEMA_VERSION, Metric, SprtConfig, check_confidence, one_of

# The most trials searched, sizes in a row that must do, sizes looked at on either side, simulated tests.
MOST, WINDOW, AROUND, REPLICATIONS = 5_000_000, 20, 500, 2_000


def least_passing(n: int, p0: float, method: str, confidence: float) -> int:
    """The fewest wins of n whose interval clears p0; n + 1 if none does. Lower bounds rise with the wins."""
    return numeric.smallest(0, n + 1, lambda k: k > n or numeric.binomial_interval(method, k, n, confidence)[0] >= p0)


def power_at(n: int, p0: float, p1: float, method: str, confidence: float) -> float:
    """P(passing wins or more of n at p1), summed in log space."""
    k = least_passing(n, p0, method, confidence)
    if k > n:
        return 0.0
    ks = np.arange(k, n + 1)
    logs = _log_factorials(n)
    terms = logs[n] - logs[ks] - logs[n - ks] + ks * math.log(p1) + (n - ks) * math.log1p(-p1)
    return float(min(1.0, np.exp(terms).sum()))


@lru_cache(1)
def _factorials(size: int) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, size + 1)))])


def _log_factorials(n: int) -> np.ndarray:
    return _factorials(1 << max(12, n.bit_length()))


def smallest_n(p0: float, p1: float, method: str, confidence: float, target: float) -> tuple[int, float]:
    """The first n from which the power stays at the target for a window; power isn't monotone in n."""
    z = numeric.z_two_sided(confidence), numeric.normal_quantile(target)
    hi = max(1, int(((z[0] * math.sqrt(p0 * (1 - p0)) + z[1] * math.sqrt(p1 * (1 - p1))) / (p1 - p0)) ** 2))
    at = lru_cache(None)(lambda n: power_at(n, p0, p1, method, confidence))
    if hi > MOST:
        fail("PowerSearchExceededCap", f"more than {MOST} trials")
    while at(hi) < target:
        if hi >= MOST:
            fail("PowerSearchExceededCap", f"more than {MOST} trials")
        hi = min(2 * hi, MOST)
    hi = numeric.smallest(1, hi, lambda n: at(n) >= target)
    run = 0
    for n in range(max(1, hi - AROUND), min(hi + AROUND, MOST) + 1):
        run = run + 1 if at(n) >= target else 0
        if run == WINDOW:
            return n - WINDOW + 1, at(n - WINDOW + 1)
    return hi, at(hi)


def estimate_trials(metric: str, min_effect: float, assume_effect: float, *, ci_method: str = "wilson", confidence: float = 0.95, target_power: float = 0.8, paired: bool = False, assume_sd: float | None = None, sd_source: str = "assume-sd") -> dict:
    if metric == "quantile-diff":
        fail("PowerUnsupportedForQuantileDiff", "there is no sample size for quantile-diff")
    one_of(metric, ("winrate", "sign-test", "elo", "mean-diff"), "UnsupportedPowerMetric")
    one_of(ci_method, CI_METHODS)
    if metric in ("elo", "mean-diff") and ci_method != "wilson":
        fail("IncompatibleCiMethod", f"interval {ci_method} doesn't apply to {metric}")
    if not (math.isfinite(min_effect) and math.isfinite(assume_effect)):
        fail("InvalidThreshold", "effects must be finite")
    if assume_effect <= min_effect:
        fail("PowerRequiresEffectGap", f"the assumed effect {assume_effect} must exceed the least {min_effect}")
    check_confidence(confidence)
    if not math.isfinite(target_power) or not 0 < target_power < 1:
        fail("InvalidTargetPower", f"power must lie between 0 and 1, got {target_power}")
    if metric != "mean-diff" and assume_sd is not None:
        fail("AssumeSdOnlyForMeanDiff", f"a standard deviation doesn't apply to {metric}")
    notes = ["Holds if the true effect is the assumed one; a smaller one needs more trials."]
    head = {"schema_version": SCHEMA_VERSION, "metric": metric, "ci_method": ci_method, "min_effect": min_effect, "assume_effect": assume_effect, "confidence": confidence, "target_power": target_power}
    if metric == "mean-diff":
        return _mean_diff(head, notes, assume_sd, sd_source, paired)
    p0, p1 = (numeric.score_from_elo(e) if metric == "elo" else 0.5 + e for e in (min_effect, assume_effect))
    if not (0 < p0 < 1 and 0 < p1 < 1):
        fail("InvalidThreshold", f"effects imply proportions {p0} and {p1}, which must lie between 0 and 1")
    n, power = smallest_n(p0, p1, ci_method, confidence, target_power)
    if paired:
        notes.append("Pairing by id may need fewer; that depends on the data and isn't modelled.")
    return head | {"estimated_trials": n, "achieved_power": power, "method": "exact_binomial_search", "notes": notes}


def _mean_diff(head: dict, notes: list[str], sd: float | None, source: str, paired: bool) -> dict:
    if sd is None:
        fail("MeanDiffPowerRequiresSd", "mean-diff needs a standard deviation or a pilot")
    if not math.isfinite(sd) or sd <= 0:
        fail("InvalidAssumeSd", f"the standard deviation must be positive, got {sd}")
    z = numeric.normal_quantile((1 + head["confidence"]) / 2)
    delta = head["assume_effect"] - head["min_effect"]
    exact = ((z + numeric.normal_quantile(head["target_power"])) * sd / delta) ** 2
    if not math.isfinite(exact) or exact > MOST:
        fail("PowerSearchExceededCap", f"more than {MOST} trials")
    n = max(1, math.ceil(exact))
    notes.append("A normal model of the paired differences, whose standard deviation this is; a bootstrap of skewed ones will differ.")
    if paired:
        notes.append("Pairs by id were netted in the pilot." if source == "pilot" else "Pairing has no bearing on a given standard deviation.")
    power = numeric.normal_cdf(delta * math.sqrt(n) / sd - z)
    return head | {"ci_method": "normal", "estimated_trials": n, "achieved_power": power, "method": "normal_approximation_closed_form", "notes": notes, "assume_sd": sd, "sd_source": source}


def pilot_sd(df: DataFrame, paired: bool = False) -> float:
    """Standard deviation of a pilot's differences."""
    metrics = [Metric("mean-diff")]
    row = netting.totals(netting.by_key(df, metrics), metrics, paired).first()
    if not row["n_rows"]:
        fail("EmptyInput", "there are no records")
    raise_error(row["error"])
    if row["late_error"]:
        raise_error(netting.repeated(df, metrics, paired).first())
    if row["n_diff"] < 2:
        fail("InsufficientPilotData", f"a pilot needs two differences, got {row['n_diff']}")
    if not row["sd_diff"]:
        fail("ZeroVariancePilotData", "all differences of the pilot are equal")
    return float(row["sd_diff"])


def sprt_trials(config: SprtConfig, *, horizon: int | None = None, spark: SparkSession | None = None) -> dict:
    """Expected trials of Wald's test at either hypothesis, and the risk of no decision by a horizon midway between."""
    lower, upper = numeric.wald_bounds(config.alpha, config.beta)
    up, down = numeric.wald_steps(config.elo0, config.elo1)

    def expected(elo: float, a: float) -> int:
        p = numeric.score_from_elo(elo)
        n = (a * upper + (1 - a) * lower) / (p * up + (1 - p) * down)
        if not math.isfinite(n) or n < 0:
            fail("InvalidThreshold", f"no expected number of trials ({n})")
        return math.ceil(n)

    notes = [
        "At either hypothesis; a strength between them needs more, most of all midway.",
        "Wald's approximation, which leaves out the overshoot at the end.",
        "Counts decisive trials only.",
    ]
    out = {"schema_version": SCHEMA_VERSION, "elo0": config.elo0, "elo1": config.elo1, "alpha": config.alpha, "beta": config.beta, "expected_trials_under_h0": expected(config.elo0, config.alpha), "expected_trials_under_h1": expected(config.elo1, 1 - config.beta), "method": "wald_asn_approximation"}
    if horizon is not None:
        out |= {"horizon": horizon, "probability_no_decision_by_horizon": undecided(spark, config, horizon)}
        notes.append(f"The risk is a simulation of {REPLICATIONS} tests.")
    return out | {"notes": notes}


def undecided(spark: SparkSession, config: SprtConfig, horizon: int, replications: int = REPLICATIONS, seed: int = DEFAULT_SEED) -> float:
    """Share of simulated tests, at the strength midway, that reach no bound within the horizon."""
    lower, upper = numeric.wald_bounds(config.alpha, config.beta)
    up, down = numeric.wald_steps(config.elo0, config.elo1)
    p = numeric.score_from_elo((config.elo0 + config.elo1) / 2)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f["id"].tolist():
                g, at, left, open_ = generator(seed, r), 0.0, horizon, True
                while left and open_:
                    k = min(left, 65_536)
                    path = at + np.cumsum(np.where(g.random(k) < p, up, down))
                    open_, at, left = not ((path >= upper) | (path <= lower)).any(), path[-1], left - k
                yield pd.DataFrame({"open": [int(open_)]})

    slices = max(1, spark.sparkContext.defaultParallelism)
    return float(spark.range(0, replications, 1, slices).mapInPandas(run, "open int").agg(F.avg("open")).first()[0])
