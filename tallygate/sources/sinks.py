"""Reports as JSON, as Markdown and as one-row tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def to_json(report: dict) -> str:
    return json.dumps(report, indent=2, ensure_ascii=False)


def to_frame(spark: SparkSession, report: dict) -> DataFrame:
    """A report as a table of one row, nested as the report is."""
    return spark.read.json(spark.sparkContext.parallelize([json.dumps(report)], 1))


def _effect(metric: str, x: float) -> str:
    return f"{x * 100:+.1f} pp" if metric in ("winrate", "sign-test") else f"{x:+.1f} elo" if metric == "elo" else f"{x:+.4f}"


def _table(head: list[str], rows: list[list]) -> list[str]:
    cell = lambda x: "-" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x)
    return ["| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]


def _comparison(r: dict) -> list[str]:
    e = lambda k: _effect(r["metric"], r[k])
    rows = [["verdict", r["verdict"]], ["validity", r["validity"]], ["promotion", r["promotion"]], ["effect", e("effect")], [f"{r['confidence']:.0%} interval", f"{e('ci_low')} to {e('ci_high')}"], ["trials", r["paired_count"]], ["baseline / candidate", f"{r['baseline_count']} / {r['candidate_count']}"], ["timeouts / crashes / invalid", f"{r['timeouts']} / {r['crashes']} / {r['invalid']}"]]
    rows += [[k.replace("_", " "), r[k]] for k in ("quantile", "cluster_count", "max_cluster_size", "effective_sample_size", "design_effect", "correction_method", "family_size", "achieved_alpha", "adjusted_alpha_threshold", "family_adjusted_verdict", "family_adjusted_promotion") if k in r]
    if r["estimated_additional_trials"] is not None:
        rows.append(["further trials, about", r["estimated_additional_trials"]])
    return [f"## {r['metric']}", "", *_table(["", ""], rows), "", r["reason"], *(f"- {w}" for w in r["warnings"]), ""]


def to_markdown(report: dict) -> str:
    if "reports" in report:
        lines = ["# Comparison", "", f"**{report['verdict']}** ({report['validity']}, {report['promotion']})", ""]
        for r in report["reports"]:
            lines += _comparison(r)
    elif "llr" in report:
        keys = ("verdict", "validity", "promotion", "sprt_variant", "llr", "lower_bound", "upper_bound", "elo0", "elo1", "candidate_wins", "draws", "baseline_wins", "timeouts", "crashes", "invalid", "drawelo", "raw_trial_count", "paired_count")
        lines = ["# Sequential test", "", *_table(["", ""], [[k.replace("_", " "), report[k]] for k in keys if report[k] is not None])]
        if report["pentanomial_counts"]:
            lines += ["", *_table(["pair score", "pairs"], [[k, v] for k, v in report["pentanomial_counts"].items()])]
        lines += ["", report["reason"]]
    elif "matrix" in report:
        names = list(dict.fromkeys(x for c in report["matrix"] for x in (c["row"], c["col"])))
        cells = {(c["row"], c["col"]): (c["elo_diff"], c["ci_low"], c["ci_high"]) for c in report["matrix"]}
        cells |= {(b, a): tuple(None if x is None else -x for x in (d, hi, lo)) for (a, b), (d, lo, hi) in cells.items()}
        show = lambda d, lo, hi: "-" if d is None else f"{d:+.1f}" + (f" [{lo:+.1f}, {hi:+.1f}]" if lo is not None else "")
        lines = ["# Matrix", "", *_table(["", *names], [[a, *("" if a == b else show(*cells[(a, b)]) for b in names)] for a in names]), ""]
        lines += _table(["candidate", "elo", "low", "high", "wins", "losses", "games", "component"], [[c[k] for k in ("name", "elo", "ci_low", "ci_high", "candidate_count", "baseline_count", "paired_count", "component")] for c in report["candidates"]])
    elif "recommendations" in report:
        lines = [f"# Matches to play for half-widths of {report['min_elo']:g} elo", "", *_table(["", "", "status", "half-width", "further games", "note"], [[r[k] for k in ("row", "col", "status", "current_ci_half_width", "estimated_additional_trials", "note")] for r in report["recommendations"]])]
    elif "method" in report:
        lines = ["# Sample size", "", *_table(["", ""], [[k.replace("_", " "), v] for k, v in report.items() if k != "notes" and v is not None]), "", *(f"- {n}" for n in report["notes"])]
    else:
        lines = ["# Comparison", "", *_comparison(report)]
    return "\n".join(lines).rstrip() + "\n"


def write(text: str, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
