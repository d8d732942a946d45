"""Sequential probability ratio tests on the counts so far: Wald, trinomial and pentanomial."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import fail
from ..functions import columns, numeric
from ..operators import netting
from ..operators.trials import raise_error
from ..schema import SCHEMA_VERSION, VARIANTS, FailureCaps, Metric, Options, SprtConfig, one_of
from .compare import apply_caps, failure_breakdown, promotion

BUCKET_NAMES = ("score_0_0", "score_0_5", "score_1_0", "score_1_5", "score_2_0")


def net_buckets(buckets: list[int]) -> tuple[int, int, int]:
    """Wins, draws and losses of pairs."""
    return buckets[3] + buckets[4], buckets[2], buckets[0] + buckets[1]


def sprt(df: DataFrame, config: SprtConfig, variant: str = "wald", *, paired: bool = False, policy: str = "report-only", caps: FailureCaps | None = None) -> dict:
    one_of(variant, VARIANTS)
    metrics = [Metric("winrate", policy=policy)]
    keys = netting.by_key(df, metrics, context="sprt")
    five = variant == "pentanomial"
    row = (netting.pentanomial(keys, policy) if five else netting.totals(keys, metrics, paired)).first().asDict()
    if not row["n_rows"]:
        fail("EmptyInput", "there are no records")
    if five and not paired:
        fail("InvalidThreshold", "the pentanomial variant needs records paired by id")
    raise_error(row["error"])
    raise_error(row["late_error"] if five or not row["late_error"] else netting.repeated(df, metrics, paired).first())
    lower, upper = numeric.wald_bounds(config.alpha, config.beta)
    drawelo, buckets = None, None
    if five:
        buckets = [int(row[f"bucket_{b}"]) for b in range(5)]
        w, d, n = net_buckets(buckets)
        llr = numeric.pentanomial_llr(config.elo0, config.elo1, buckets)
    else:
        w, d, n = (int(row[f"{x}_{netting.name(policy)}"] or 0) for x in "wdl")
        if variant == "wald":
            llr = numeric.wald_llr(config.elo0, config.elo1, w, n)
        else:
            llr, drawelo = numeric.trinomial_llr(config.elo0, config.elo1, w, d, n)
    unit = "belo" if variant == "trinomial" else "elo"
    h0, h1 = f"H0 ({unit} <= {config.elo0:+.1f})", f"H1 ({unit} >= {config.elo1:+.1f})"
    if llr >= upper:
        verdict, reason = "pass", f"LLR {llr:.3f} reached the upper bound {upper:.3f}: {h1} stands against {h0}"
    elif llr <= lower:
        verdict, reason = "fail", f"LLR {llr:.3f} reached the lower bound {lower:.3f}: {h0} stands against {h1}"
    else:
        verdict, reason = "inconclusive", f"LLR {llr:.3f} lies between {lower:.3f} and {upper:.3f}: keep testing"
    breakdown = failure_breakdown(row)
    sums = {k: sum(b[k] for b in breakdown.values()) for k in ("timeout", "crash", "invalid")}
    report = {
        "schema_version": SCHEMA_VERSION,
        "verdict": verdict,
        "validity": "valid",
        "promotion": promotion("valid", verdict),
        "llr": llr,
        "lower_bound": lower,
        "upper_bound": upper,
        "elo0": config.elo0,
        "elo1": config.elo1,
        "alpha": config.alpha,
        "beta": config.beta,
        "candidate_wins": w,
        "baseline_wins": n,
        "draws": d,
        "timeouts": sums["timeout"],
        "crashes": sums["crash"],
        "invalid": sums["invalid"],
        "failure_breakdown": breakdown,
        "reason": reason,
        "drawelo": drawelo,
        "sprt_variant": variant,
        "pentanomial_counts": dict(zip(BUCKET_NAMES, buckets, strict=True)) if five else None,
        "raw_trial_count": int(row["games"] or 0) if five else None,
        "paired_count": int(row["pairs"]) if five else None,
    }
    apply_caps(report, Options(caps=caps or FailureCaps()))
    return report


def by_group(df: DataFrame, config: SprtConfig, variant: str, by: tuple[str, ...] = (), *, paired: bool = False, policy: str = "report-only") -> DataFrame:
    """(by, wins, draws, losses, llr, verdict): Wald or trinomial tests of many groups as one declared plan."""
    metrics = [Metric("winrate", policy=policy)]
    rows = netting.totals(netting.by_key(df, metrics, by), metrics, paired, by)
    p = netting.name(policy)
    rows = rows.select(*by, F.col(f"w_{p}").alias("wins"), F.col(f"d_{p}").alias("draws"), F.col(f"l_{p}").alias("losses"))
    counts = F.col("wins"), F.col("draws"), F.col("losses")
    rows = rows.withColumn("llr", columns.wald_llr(config, counts[0], counts[2]) if variant == "wald" else columns.trinomial_llr(config, *counts))
    if variant == "trinomial":
        rows = rows.withColumn("drawelo", columns.drawelo(*counts))
    return rows.withColumn("verdict", columns.sprt_verdict(F.col("llr"), config))
