"""Command line: ``python -m tallygate compare|sprt|matrix|plan|power``. Exit 0 pass, 1 fail, 2 inconclusive, 3 error."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .errors import GateError, fail
from .plans.compare import compare
from .plans.matrix import matrix
from .plans.power import estimate_trials, pilot_sd, sprt_trials
from .plans.recommend import plan
from .plans.sprt import sprt
from .schema import BOOTSTRAPS, CI_METHODS, CORRECTIONS, DEFAULT_SEED, METRICS, POLICIES, VARIANTS, FailureCaps, Metric, Options, SprtConfig, Thresholds
from .sources.readers import read, read_files
from .sources.sinks import to_json, to_markdown, write

EXIT = {"pass": 0, "fail": 1, "inconclusive": 2}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("tallygate")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.add_argument("--report-json")
        p.add_argument("--report-md")
        return p

    def caps(p: argparse.ArgumentParser) -> None:
        for k in ("timeouts", "crashes", "invalid"):
            p.add_argument(f"--max-{k}", type=int)
        p.add_argument("--failure-policy", choices=POLICIES, default="report-only")
        p.add_argument("--format", choices=("jsonl", "csv"))
        p.add_argument("--paired-by-id", action="store_true")

    p = command("compare")
    p.add_argument("input")
    p.add_argument("--metric", required=True, action="append", choices=METRICS)
    p.add_argument("--confidence", type=float, default=0.95)
    p.add_argument("--min-effect", type=float, default=0.0)
    p.add_argument("--pass-above", type=float)
    p.add_argument("--fail-below", type=float)
    p.add_argument("--resamples", type=int, default=10_000)
    p.add_argument("--seed", type=int, default=DEFAULT_SEED)
    p.add_argument("--ci-method", choices=CI_METHODS, default="wilson")
    p.add_argument("--bootstrap-method", choices=BOOTSTRAPS, default="percentile")
    p.add_argument("--quantile", type=float)
    p.add_argument("--cluster-by-id", action="store_true")
    p.add_argument("--claim-correction", choices=CORRECTIONS, default="none")
    caps(p)

    p = command("sprt")
    p.add_argument("input")
    _hypotheses(p)
    p.add_argument("--sprt-variant", choices=VARIANTS, default="wald")
    caps(p)

    for name in ("matrix", "plan"):
        p = command(name)
        p.add_argument("inputs", nargs="*")
        p.add_argument("--matches", action="append", default=[])
        p.add_argument("--format", choices=("jsonl", "csv"))
        p.add_argument("--confidence", type=float, default=0.95)
        p.add_argument("--paired-by-id", action="store_true")
        p.add_argument("--resamples", type=int, default=2_000)
        p.add_argument("--seed", type=int, default=DEFAULT_SEED)
        p.add_argument("--bootstrap-method", choices=BOOTSTRAPS, default="percentile")
        if name == "plan":
            p.add_argument("--min-elo", type=float, required=True)

    p = command("power")
    p.add_argument("--metric", choices=METRICS)
    p.add_argument("--sprt", action="store_true")
    p.add_argument("--horizon", type=int)
    p.add_argument("--min-effect", type=float, default=0.0)
    p.add_argument("--assume-effect", type=float)
    p.add_argument("--confidence", type=float, default=0.95)
    p.add_argument("--target-power", type=float, default=0.8)
    p.add_argument("--ci-method", choices=CI_METHODS, default="wilson")
    p.add_argument("--paired-by-id", action="store_true")
    p.add_argument("--assume-sd", type=float)
    p.add_argument("--pilot")
    p.add_argument("--format", choices=("jsonl", "csv"))
    _hypotheses(p)
    return top


def _hypotheses(p: argparse.ArgumentParser) -> None:
    for k in ("elo0", "elo1", "belo0", "belo1"):
        p.add_argument(f"--{k}", type=float)
    p.add_argument("--alpha", type=float, default=0.05)
    p.add_argument("--beta", type=float, default=0.05)


def _config(a: argparse.Namespace, variant: str) -> SprtConfig:
    """The trinomial variant takes BayesElo, the others Elo; the other pair must not be given."""
    own, other = ("belo", "elo") if variant == "trinomial" else ("elo", "belo")
    given = [getattr(a, f"{own}{i}") for i in (0, 1)]
    if any(getattr(a, f"{other}{i}") is not None for i in (0, 1)):
        fail("InvalidThreshold", f"the {variant} variant takes --{own}0 and --{own}1")
    if None in given:
        fail("InvalidThreshold", f"--{own}0 and --{own}1 are required")
    return SprtConfig(*given, a.alpha, a.beta)


def _caps(a: argparse.Namespace) -> FailureCaps:
    return FailureCaps(a.max_timeouts, a.max_crashes, a.max_invalid)


def run(spark: SparkSession, a: argparse.Namespace) -> dict:
    if a.command == "compare":
        if a.quantile is not None and "quantile-diff" not in a.metric:
            fail("QuantileRequiresQuantileDiffMetric", "--quantile needs --metric quantile-diff")
        sides = Thresholds.symmetric(a.min_effect)
        t = Thresholds(sides.pass_above if a.pass_above is None else a.pass_above, sides.fail_below if a.fail_below is None else a.fail_below)
        metrics = [Metric(m, a.ci_method, a.bootstrap_method, a.failure_policy, a.quantile if m == "quantile-diff" else None) for m in a.metric]
        return compare(read(spark, a.input, fmt=a.format), metrics, Options(a.confidence, a.resamples, a.seed, a.paired_by_id, a.cluster_by_id, t, _caps(a), a.claim_correction))
    if a.command == "sprt":
        return sprt(read(spark, a.input, fmt=a.format), _config(a, a.sprt_variant), a.sprt_variant, paired=a.paired_by_id, policy=a.failure_policy, caps=_caps(a))
    if a.command in ("matrix", "plan"):
        legacy = read_files(spark, a.inputs, a.format) if a.inputs else []
        tables = read_files(spark, a.matches, a.format, match=True) if a.matches else []
        options = {"confidence": a.confidence, "paired": a.paired_by_id, "resamples": a.resamples, "seed": a.seed, "method": a.bootstrap_method}
        return matrix(spark, legacy, tables, **options) if a.command == "matrix" else plan(spark, legacy, tables, min_elo=a.min_elo, **options)
    if a.sprt:
        return sprt_trials(_config(a, "wald"), horizon=a.horizon, spark=spark)
    if a.metric is None or a.assume_effect is None:
        fail("InvalidThreshold", "--metric and --assume-effect are required")
    sd, source = a.assume_sd, "assume-sd"
    if a.pilot:
        if a.metric != "mean-diff":
            fail("AssumeSdOnlyForMeanDiff", f"a pilot doesn't apply to {a.metric}")
        sd, source = pilot_sd(read(spark, a.pilot, fmt=a.format), a.paired_by_id), "pilot"
    return estimate_trials(a.metric, a.min_effect, a.assume_effect, ci_method=a.ci_method, confidence=a.confidence, target_power=a.target_power, paired=a.paired_by_id, assume_sd=sd, sd_source=source)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tallygate").getOrCreate()
    try:
        report = run(spark, a)
        print(to_json(report))
        for path, text in ((a.report_json, to_json), (a.report_md, to_markdown)):
            if path:
                write(text(report), path)
    except (GateError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 3
    return EXIT.get(report.get("verdict"), 0)
