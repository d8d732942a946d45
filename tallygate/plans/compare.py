"""Comparison reports: one Spark pass for all metrics, then arithmetic on its one row of counts."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import fail
from ..functions import columns, numeric
from ..operators import netting, ranks, resample
from ..operators.trials import raise_error
from ..schema import SCHEMA_VERSION, Metric, Options, Thresholds, check_confidence, one_of
from .correction import apply_correction


def promotion(validity: str, verdict: str) -> str:
    return "promoted" if (validity, verdict) == ("valid", "pass") else "not_promoted"


def decide(ci_low: float, ci_high: float, t: Thresholds) -> tuple[str, str]:
    if ci_low >= t.pass_above:
        return "pass", f"CI lower bound {ci_low:.4f} meets the pass threshold {t.pass_above:.4f}"
    if ci_high <= t.fail_below:
        return "fail", f"CI upper bound {ci_high:.4f} is at or below the fail threshold {t.fail_below:.4f}"
    return "inconclusive", f"CI [{ci_low:.4f}, {ci_high:.4f}] crosses neither the pass ({t.pass_above:.4f}) nor the fail ({t.fail_below:.4f}) threshold"


def aggregate(verdicts: list[str]) -> str:
    return next((v for v in ("fail", "inconclusive") if v in verdicts), "pass")


def failure_breakdown(row: dict) -> dict:
    return {s: {k: int(row[f"{s}_{k}"] or 0) for k in ("timeout", "crash", "invalid")} for s in netting.SIDES}


def _check(metrics: list[Metric], o: Options) -> None:
    if o.clustered:
        if o.paired:
            fail("ClusterByIdConflictsWithPairedById", "clusters and pairs by id exclude each other")
        for m in metrics:
            if m.kind not in ("winrate", "elo"):
                fail("IncompatibleClusterById", f"clusters don't apply to {m.kind}")


def compare(df: DataFrame, metrics: list[Metric], options: Options | None = None) -> dict:
    """The report of one metric, or for several the report of all."""
    o = options or Options()
    one_of(o.correction, ("none", "bonferroni", "holm"))
    _check(metrics, o)
    keys = netting.by_key(df, metrics)
    if any(m.kind in ("mean-diff", "quantile-diff") for m in metrics) or o.clustered:
        keys = keys.persist()
    try:
        row = netting.totals(keys, metrics, o.paired).first().asDict()
        if not row["n_rows"]:
            fail("EmptyInput", "there are no records")
        check_confidence(o.confidence)
        raise_error(row["error"])
        if row["late_error"]:
            raise_error(netting.repeated(df, metrics, o.paired).first())
        if o.paired or o.clustered:
            row |= {"records_with_id": 0, "max_id_count": 0}
        reports = [_report(m, _measure(m, row, keys, o), row, o) for m in metrics]
    finally:
        keys.unpersist()
    for r in reports:
        apply_caps(r, o)
    apply_correction(reports, metrics, o)
    if len(reports) == 1:
        return reports[0]
    verdict = aggregate([r["verdict"] for r in reports])
    validity = "invalid" if any(r["validity"] == "invalid" for r in reports) else "valid"
    out = {"schema_version": SCHEMA_VERSION, "verdict": verdict, "validity": validity, "promotion": promotion(validity, verdict)}
    if o.correction != "none":
        out["simultaneous_claims_promotion"] = "promoted" if all(r["family_adjusted_promotion"] == "promoted" for r in reports) else "not_promoted"
    return out | {"reports": reports}


def _measure(m: Metric, row: dict, keys: DataFrame, o: Options) -> dict:
    """Counts, effect and interval of a metric."""
    zero = {"baseline_count": 0, "candidate_count": 0, "paired_count": 0, "effect": 0.0, "ci_low": 0.0, "ci_high": 0.0}
    if m.kind in ("winrate", "elo"):
        w, d, n = (int(row[f"{x}_{netting.name(m.policy)}"] or 0) for x in "wdl")
        total = w + n + (d if m.kind == "elo" else 0)
        if not total:
            return zero | {"warning": f"no {'trials' if m.kind == 'elo' else 'decisive trials'} to compute {m.kind} from"}
        score = (w + d / 2) / total if m.kind == "elo" else w / total
        effect = numeric.elo_from_score(score) if m.kind == "elo" else score - 0.5
        out = {"baseline_count": n, "candidate_count": w, "paired_count": total, "effect": effect}
        if o.clustered:
            return out | _clustered(m, row, keys, o, total)
        lo, hi = numeric.elo_interval(score, total, o.confidence) if m.kind == "elo" else (x - 0.5 for x in numeric.binomial_interval(m.ci_method, w, total, o.confidence))
        return out | {"ci_low": lo, "ci_high": hi}
    if m.kind == "sign-test":
        pos, neg = int(row["pos"]), int(row["neg"])
        if not pos + neg:
            return zero | {"warning": "no untied pairs for the sign test"}
        lo, hi = numeric.binomial_interval(m.ci_method, pos, pos + neg, o.confidence)
        return {"baseline_count": neg, "candidate_count": pos, "paired_count": pos + neg, "effect": pos / (pos + neg) - 0.5, "ci_low": lo - 0.5, "ci_high": hi - 0.5}
    n = int(row["n_diff"])
    if not n:
        return zero | {"warning": f"no pairs of numbers for {m.kind}"} | ({"quantile": m.quantile} if m.quantile else {})
    diffs = keys.where("diff is not null").select("diff", F.xxhash64("key").alias("tie"))
    counts = {"baseline_count": n, "candidate_count": n, "paired_count": n}
    if m.kind == "mean-diff":
        effect = float(row["mean_diff"])
        return counts | {"effect": effect} | dict(zip(("ci_low", "ci_high"), mean_interval(diffs, n, effect, m.bootstrap, o), strict=True))
    at = ranks.order_statistics(diffs, "diff", n)
    h = m.quantile * (n - 1)
    ends = at(np.array(sorted({math.floor(h), min(math.floor(h) + 1, n - 1)})))
    effect = float(ends[0] + (h - math.floor(h)) * (ends[-1] - ends[0]))
    lo, hi = quantile_interval(at, n, m.quantile, effect, m.bootstrap, o)
    return counts | {"effect": effect, "ci_low": lo, "ci_high": hi, "quantile": m.quantile}


def quantile_interval(at: Callable[[np.ndarray], np.ndarray], n: int, q: float, effect: float, method: str, o: Options) -> tuple[float, float]:
    """Interval of the quantile ``effect`` of n values, of which ``at`` gives those at given ranks.

    ``bca`` is here for users of the library; reports refuse it, since a step function has no sound jackknife.
    """
    if n == 1:
        return effect, effect
    draws = resample.bootstrap_quantiles(at, n, q, o.resamples, o.seed)
    if method == "percentile":
        return numeric.percentile_interval(draws, o.confidence)
    if method == "basic":
        return numeric.basic_interval(draws, effect, o.confidence)
    # Leaving one out, the quantile lies between two of three neighbours: three values stand for all n.
    h = q * (n - 2)
    k = math.floor(h)
    ranks = np.minimum(np.arange(k, k + 3), n - 1)
    x = at(np.unique(ranks))[np.searchsorted(np.unique(ranks), ranks)]
    left_out = np.array([lo + (h - k) * (hi - lo) for lo, hi in ((x[1], x[2]), (x[0], x[2]), (x[0], x[1]))])
    return numeric.bca_interval(draws, effect, numeric.acceleration(left_out, np.array([k + 1, 1, n - k - 2])), o.confidence)


def mean_interval(diffs: DataFrame, n: int, effect: float, method: str, o: Options) -> tuple[float, float]:
    """Interval of the mean ``effect`` of n rows (diff, tie)."""
    if n == 1:
        return effect, effect
    table, means = resample.bootstrap_means(diffs, "diff", o.resamples, o.seed, tie="tie")
    draws = np.array(means.first()["draws"])
    table.drop()
    if method == "percentile":
        return numeric.percentile_interval(draws, o.confidence)
    if method == "basic":
        return numeric.basic_interval(draws, effect, o.confidence)
    # Leaving one out moves the mean by (diff - mean) / (n - 1), so the jackknife is two sums.
    gap = (F.col("diff") - effect) / (n - 1)
    cubes, squares = diffs.agg(F.sum(gap * gap * gap), F.sum(gap * gap)).first()
    return numeric.bca_interval(draws, effect, numeric.acceleration_from_sums(cubes, squares), o.confidence)


def _clustered(m: Metric, row: dict, keys: DataFrame, o: Options, n: int) -> dict:
    def statistic(wdl: np.ndarray) -> float:
        w, d, x = wdl
        if m.kind == "elo":
            return numeric.elo_from_score((w + d / 2) / (w + d + x))
        return w / (w + x) - 0.5 if w + x else math.nan

    table = netting.cluster_table(keys, m.policy).orderBy("w", "d", "l").toPandas()
    p = netting.name(m.policy)
    return {"cluster_count": int(row[f"clusters_{p}"]), "max_cluster_size": int(row[f"largest_{p}"])} | resample.cluster_bootstrap(keys.sparkSession, table, n, statistic, o.confidence, o.resamples, o.seed)


def _report(m: Metric, out: dict, row: dict, o: Options) -> dict:
    t = o.thresholds
    verdict, reason = ("inconclusive", out["warning"]) if "warning" in out else decide(out["ci_low"], out["ci_high"], t)
    breakdown = failure_breakdown(row)
    failures = {k: sum(b[k] for b in breakdown.values()) for k in ("timeout", "crash", "invalid")}
    quality, warnings = data_quality(m, out, failures, row)
    optional = {k: out[k] for k in ("quantile", "cluster_count", "max_cluster_size", "effective_sample_size", "design_effect") if k in out}
    return {
        "schema_version": SCHEMA_VERSION,
        "verdict": verdict,
        "validity": "valid",
        "promotion": promotion("valid", verdict),
        "metric": m.kind,
        "baseline_count": out["baseline_count"],
        "candidate_count": out["candidate_count"],
        "paired_count": out["paired_count"],
        "effect": out["effect"],
        "confidence": o.confidence,
        "ci_low": out["ci_low"],
        "ci_high": out["ci_high"],
        "pass_above": t.pass_above,
        "fail_below": t.fail_below,
        "timeouts": failures["timeout"],
        "crashes": failures["crash"],
        "invalid": failures["invalid"],
        "failure_breakdown": breakdown,
        "reason": reason,
        "estimated_additional_trials": None if "cluster_count" in out else additional_trials(m, verdict, out, t, o.confidence),
        "warnings": warnings,
        "data_quality": quality,
        **optional,
    }


def data_quality(m: Metric, out: dict, failures: dict, row: dict) -> tuple[dict, list[str]]:
    n, failed = out["paired_count"], sum(failures.values())
    draws = n - out["baseline_count"] - out["candidate_count"] if m.kind == "elo" else 0
    tail = n * min(out["quantile"], 1 - out["quantile"]) if out.get("quantile") and n else None
    tiny = n < 30
    flags = {
        "tiny_sample": (tiny, f"small sample: {n} trial(s), fewer than 30"),
        "high_failure_rate": (n + failed > 0 and failed / (n + failed) > 0.2, f"{failed} of {n + failed} trials failed"),
        "draw_heavy": (n > 0 and draws / max(1, n) > 0.5, f"{draws} of {n} trials were draws"),
        "effect_within_noise_floor": (not tiny and abs(out["effect"]) < (out["ci_high"] - out["ci_low"]) / 2, "the effect is smaller than half the interval"),
        "thin_quantile_tail": (tail is not None and tail < 10, f"only about {tail or 0:.1f} observation(s) beyond the quantile"),
        "low_id_diversity": (row["records_with_id"] >= 10 and row["max_id_count"] >= 3, f"one id occurs {row['max_id_count']} times among {row['records_with_id']} records with id"),
    }
    return {k: bool(v) for k, (v, _) in flags.items()}, [text for v, text in flags.values() if v]


def additional_trials(m: Metric, verdict: str, out: dict, t: Thresholds, confidence: float) -> int | None:
    """How many more trials would take the interval off the threshold, were the effect to stay."""
    n, effect = out["paired_count"], out["effect"]
    if verdict != "inconclusive" or not n:
        return None
    target = effect - t.pass_above if effect > t.pass_above else t.fail_below - effect if effect < t.fail_below else None
    now = (out["ci_high"] - out["ci_low"]) / 2
    if target is None or not math.isfinite(now) or now <= target:
        return None
    needed = n * (now / target) ** 2
    if not math.isfinite(needed) or needed >= 2**64:
        return 2**64 - 1
    plain = max(0, int(needed) - n)
    if m.kind in ("mean-diff", "quantile-diff"):
        return plain
    p = numeric.score_from_elo(effect) if m.kind == "elo" else effect + 0.5

    def half_width(k: int) -> float:
        if m.kind == "elo":
            lo, hi = numeric.elo_interval(p, k, confidence)
        elif m.ci_method == "wilson":
            lo, hi = numeric.wilson(p, k, confidence)
        else:
            lo, hi = numeric.binomial_interval(m.ci_method, min(k, max(0, math.floor(p * k + 0.5))), k, confidence)
        return (hi - lo) / 2

    top = max(int(needed * 2), n + 1)
    return plain if half_width(top) > target else numeric.smallest(n, top, lambda k: half_width(k) <= target) - n


def apply_caps(report: dict, o: Options) -> None:
    why = o.caps.breach(report["timeouts"], report["crashes"], report["invalid"])
    report["validity"] = "invalid" if why else "valid"
    if why:
        report |= {"verdict": "inconclusive", "reason": f"INVALID: {why}. Strength not evaluated."}
        if "estimated_additional_trials" in report:
            report["estimated_additional_trials"] = None
    report["promotion"] = promotion(report["validity"], report["verdict"])


def closed_form(df: DataFrame, metrics: list[Metric], options: Options | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Winrate, elo and sign test of each group of ``by`` as one declared plan: (by, metric, counts, effect, interval, verdict).

    For tables of many groups, where no report is assembled on the driver. Errors of rows don't raise here;
    ``has_error`` tells of groups that have some.
    """
    o = options or Options()
    return _closed(netting.totals(netting.by_key(df, metrics, by), metrics, o.paired, by), metrics, o, by)


def closed_form_sets(df: DataFrame, metrics: list[Metric], sets: list[tuple[str, ...]], options: Options | None = None) -> DataFrame:
    """The same for several sets of keys at once, as by GROUPING SETS, with its ``grouping_id``: (keys, grouping_id, metric, ...).

    Rows are netted by id once, within the finest groups; tallies of these are what all sets add up. So rows are exchanged
    by id once, whatever the number of sets, and a group's tally once for each.
    """
    o = options or Options()
    by = tuple(dict.fromkeys(c for s in sets for c in s))
    rows = netting.totals(netting.by_key(df, metrics, by), metrics, o.paired, by, sets)
    return _closed(rows, metrics, o, (*by, "grouping_id"))


def _closed(rows: DataFrame, metrics: list[Metric], o: Options, by: tuple[str, ...]) -> DataFrame:
    if any(m.kind not in ("winrate", "elo", "sign-test") or m.ci_method != "wilson" for m in metrics):
        fail("IncompatibleCiMethod", "only closed-form intervals by Wilson's method")
    parts = []
    for m in metrics:
        if m.kind == "sign-test":
            w, d, n = F.col("pos"), F.lit(0), F.col("neg")
        else:
            w, d, n = (F.col(f"{x}_{netting.name(m.policy)}") for x in "wdl")
        total = w + n + (d if m.kind == "elo" else F.lit(0))
        score = F.try_divide((w + d / 2 if m.kind == "elo" else w).cast("double"), total)
        lo, hi = columns.wilson(score, total, o.confidence)
        scale = columns.elo_from_score if m.kind == "elo" else (lambda x: x - 0.5)
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        ends = [zero(scale(x)).alias(k) for k, x in (("effect", score), ("ci_low", lo), ("ci_high", hi))]
        parts.append(F.struct(F.lit(m.kind).alias("metric"), n.alias("baseline_count"), w.alias("candidate_count"), total.cast("long").alias("paired_count"), *ends))
    out = rows.select(*by, F.expr("error is not null or late_error is not null").alias("has_error"), F.explode(F.array(*parts)).alias("m")).select(*by, "m.*", "has_error")
    verdict = F.when(F.col("paired_count") == 0, "inconclusive").otherwise(columns.verdict(F.col("ci_low"), F.col("ci_high"), o.thresholds))
    return out.withColumn("verdict", verdict)


def grouped_mean_diff(df: DataFrame, by: tuple[str, ...], method: str = "percentile", options: Options | None = None) -> DataFrame:
    """(by, paired_count, effect, ci_low, ci_high, verdict, has_error): bootstrap intervals of the mean difference of each group, as one plan.

    A large group is resampled by many tasks. A group of one pair has its difference as its interval.
    """
    o = options or Options()
    check_confidence(o.confidence)
    one_of(method, ("percentile", "basic"))
    m = [Metric("mean-diff", bootstrap=method)]
    keys = netting.by_key(df, m, by)
    sums = netting.totals(keys, m, o.paired, by).where("n_diff > 0").select(*(F.col(c).alias(f"_{c}") for c in by), "n_diff", "mean_diff", F.expr("error is not null or late_error is not null").alias("has_error"))
    diffs = keys.where("diff is not null").select(*by, "diff", F.xxhash64("key").alias("tie"))
    _, means = resample.bootstrap_means(diffs, "diff", o.resamples, o.seed, by, tie="tie")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    lo, hi = columns.bootstrap_interval(F.col("draws"), F.col("mean_diff"), method, o.confidence, o.resamples)
    one = lambda x: F.when(F.col("n") == 1, F.col("mean_diff")).otherwise(x)
    out = means.join(sums, same).select(*by, F.col("n_diff").alias("paired_count"), F.col("mean_diff").alias("effect"), one(lo).alias("ci_low"), one(hi).alias("ci_high"), "has_error")
    return out.select(*by, "paired_count", "effect", "ci_low", "ci_high", columns.verdict(F.col("ci_low"), F.col("ci_high"), o.thresholds).alias("verdict"), "has_error")
