"""Input schemas, enumerations and checked configurations."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import types as T

from .errors import fail

SCHEMA_VERSION = 1
DEFAULT_SEED = 0x5EED
BASELINE = "baseline"

# The words of the input and of the reports.
STATUSES = ("ok", "timeout", "crash", "invalid")
FAILURES = ("timeout", "crash", "invalid")
OUTCOMES = ("baseline_win", "candidate_win", "draw")
MATCH_OUTCOMES = ("a_win", "b_win", "draw")
METRICS = ("winrate", "mean-diff", "sign-test", "elo", "quantile-diff")
CI_METHODS = ("wilson", "exact", "jeffreys")
BOOTSTRAPS = ("percentile", "bca", "basic")
POLICIES = ("report-only", "exclude", "loss")
VARIANTS = ("wald", "trinomial", "pentanomial")
CORRECTIONS = ("none", "bonferroni", "holm")

_S, _D, _L = T.StringType(), T.DoubleType(), T.LongType()
TRIAL_COLUMNS = ("id", "baseline", "candidate", "result", "baseline_status", "candidate_status")
TRIAL_SCHEMA = T.StructType(
    [T.StructField(c, _D if c in ("baseline", "candidate") else _S) for c in TRIAL_COLUMNS] + [T.StructField("line", _L, False)]
)
MATCH_COLUMNS = ("id", "a", "b", "result")
MATCH_SCHEMA = T.StructType([T.StructField(c, _S) for c in MATCH_COLUMNS] + [T.StructField("line", _L, False)])


def one_of(value: str, allowed: tuple[str, ...], kind: str = "InvalidThreshold") -> str:
    if value not in allowed:
        fail(kind, f"{value!r} is none of {', '.join(allowed)}")
    return value


def check_confidence(c: float) -> float:
    if not math.isfinite(c) or not 0 < c < 1:
        fail("InvalidConfidence", f"confidence must lie between 0 and 1, got {c}")
    return c


@dataclass(frozen=True)
class Thresholds:
    pass_above: float = 0.0
    fail_below: float = 0.0

    def __post_init__(self):
        if not (math.isfinite(self.pass_above) and math.isfinite(self.fail_below)):
            fail("InvalidThreshold", "thresholds must be finite")
        if self.fail_below > self.pass_above:
            fail("InvalidThreshold", f"fail threshold {self.fail_below} lies above pass threshold {self.pass_above}")

    @classmethod
    def symmetric(cls, min_effect: float) -> Thresholds:
        return cls(min_effect, -min_effect)


@dataclass(frozen=True)
class FailureCaps:
    max_timeouts: int | None = None
    max_crashes: int | None = None
    max_invalid: int | None = None

    def breach(self, timeouts: int, crashes: int, invalid: int) -> str | None:
        """Why the run is invalid, if it is: the first cap, in this order, that is exceeded."""
        for n, cap, what in ((timeouts, self.max_timeouts, "timeout(s)"), (crashes, self.max_crashes, "crash(es)"), (invalid, self.max_invalid, "invalid result(s)")):
            if cap is not None and n > cap:
                return f"{n} {what} exceed the cap of {cap}"
        return None


@dataclass(frozen=True)
class Metric:
    """One metric of a comparison with what it needs."""

    kind: str
    ci_method: str = "wilson"
    bootstrap: str = "percentile"
    policy: str = "report-only"
    quantile: float | None = None

    def __post_init__(self):
        one_of(self.kind, METRICS)
        one_of(self.ci_method, CI_METHODS)
        one_of(self.bootstrap, BOOTSTRAPS)
        one_of(self.policy, POLICIES)
        if self.kind not in ("winrate", "elo") and self.policy != "report-only":
            fail("IncompatibleFailurePolicy", f"failure policy {self.policy} doesn't apply to {self.kind}")
        if self.kind not in ("winrate", "sign-test") and self.ci_method != "wilson":
            fail("IncompatibleCiMethod", f"interval {self.ci_method} doesn't apply to {self.kind}")
        if self.kind == "quantile-diff":
            if self.bootstrap == "bca":
                fail("IncompatibleBootstrapMethod", "bca doesn't apply to quantile-diff")
            q = 0.5 if self.quantile is None else self.quantile
            if not math.isfinite(q) or not 0 < q < 1:
                fail("InvalidQuantile", f"quantile must lie between 0 and 1, got {q}")
            object.__setattr__(self, "quantile", q)
        else:
            object.__setattr__(self, "quantile", None)

    @property
    def numeric(self) -> bool:
        return self.kind in ("mean-diff", "sign-test", "quantile-diff")


@dataclass(frozen=True)
class SprtConfig:
    elo0: float
    elo1: float
    alpha: float = 0.05
    beta: float = 0.05

    def __post_init__(self):
        if not (math.isfinite(self.elo0) and math.isfinite(self.elo1)):
            fail("InvalidThreshold", "elo0 and elo1 must be finite")
        if self.elo0 >= self.elo1:
            fail("InvalidThreshold", f"elo0 ({self.elo0}) must be less than elo1 ({self.elo1})")
        for name in ("alpha", "beta"):
            v = getattr(self, name)
            if not math.isfinite(v) or not 0 < v < 1:
                fail("InvalidThreshold", f"{name} must lie between 0 and 1, got {v}")


@dataclass(frozen=True)
class Options:
    """How a comparison is run."""

    confidence: float = 0.95
    resamples: int = 10_000
    seed: int = DEFAULT_SEED
    paired: bool = False
    clustered: bool = False
    thresholds: Thresholds = field(default_factory=Thresholds)
    caps: FailureCaps = field(default_factory=FailureCaps)
    correction: str = "none"
