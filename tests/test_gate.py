"""Reports over small inputs, against values known from elsewhere."""

import json
import re

import pytest
from pyspark.sql import functions as F

from tallygate.cli import main, parser, run
from tallygate.errors import GateError
from tallygate.plans.compare import closed_form, compare
from tallygate.plans.matrix import matrix
from tallygate.plans.power import pilot_sd, undecided
from tallygate.plans.recommend import plan
from tallygate.plans.sprt import by_group, sprt
from tallygate.schema import FailureCaps, Metric, Options, SprtConfig, Thresholds
from tallygate.sources.readers import read
from tallygate.sources.sinks import to_frame, to_markdown

W, L, D = "candidate_win", "baseline_win", "draw"


def outcomes(spark, wins, losses, draws=0, ids=None):
    words = [W] * wins + [L] * losses + [D] * draws
    return spark.createDataFrame([(str(ids(i)) if ids else str(i), w, i + 1) for i, w in enumerate(words)], "id string, result string, line long")


def pairs(spark, diffs):
    return spark.createDataFrame([(str(i), 0.0, float(d), i + 1) for i, d in enumerate(diffs)], "id string, baseline double, candidate double, line long")


def kind_of(call):
    with pytest.raises(GateError) as e:
        call()
    return e.value.kind


def test_two_claims_with_holm(spark):
    o = Options(thresholds=Thresholds.symmetric(0.02), correction="holm")
    r = compare(outcomes(spark, 62, 38), [Metric("winrate"), Metric("elo")], o)
    a, b = r["reports"]
    assert (a["effect"], a["ci_low"], a["ci_high"]) == pytest.approx((0.12, 0.022097552875490645, 0.20902400754104664), abs=1e-12)
    assert (b["effect"], b["ci_low"], b["ci_high"]) == pytest.approx((85.04323715257746, 15.364961311521332, 154.7215129936337), abs=1e-9)
    assert a["achieved_alpha"] == pytest.approx(0.045327562117809694, abs=1e-12)
    assert b["achieved_alpha"] == pytest.approx(0.016420872210740903, abs=1e-12)
    assert (a["adjusted_alpha_threshold"], b["adjusted_alpha_threshold"]) == pytest.approx((0.05, 0.025))
    assert r["simultaneous_claims_promotion"] == r["promotion"] == "promoted"
    assert a["data_quality"] == dict.fromkeys(a["data_quality"], False) and a["warnings"] == []


def test_bonferroni_may_undo_a_pass(spark):
    o = Options(thresholds=Thresholds.symmetric(0.02), correction="bonferroni")
    a, b = compare(outcomes(spark, 62, 38), [Metric("winrate"), Metric("elo")], o)["reports"]
    assert (a["family_adjusted_verdict"], b["family_adjusted_verdict"], a["verdict"]) == ("inconclusive", "pass", "pass")


def test_one_scan_equals_separate_ones(spark):
    df = spark.createDataFrame([(str(i), 1.0 * (i % 7), 1.0 * (i % 5), (W, L, D)[i % 3], i + 1) for i in range(60)], "id string, baseline double, candidate double, result string, line long")
    metrics = [Metric("winrate"), Metric("sign-test"), Metric("elo"), Metric("mean-diff"), Metric("quantile-diff", quantile=0.25)]
    o = Options(resamples=200)
    assert compare(df, metrics, o)["reports"] == [compare(df.repartition(3), [m], o) for m in metrics]


@pytest.mark.parametrize("method", ["percentile", "basic", "bca"])
def test_mean_interval_covers_and_is_reproducible(spark, method):
    df = pairs(spark, [0.1 * (i % 9) for i in range(90)])
    o = Options(resamples=400)
    r = compare(df, [Metric("mean-diff", bootstrap=method)], o)
    assert r["effect"] == pytest.approx(0.4) and r["ci_low"] < 0.4 < r["ci_high"]
    again = compare(df.repartition(5), [Metric("mean-diff", bootstrap=method)], o)
    assert (r["ci_low"], r["ci_high"], r["effect"]) == pytest.approx((again["ci_low"], again["ci_high"], again["effect"]), rel=1e-12)


def test_draws_follow_values_alone(spark, monkeypatch):
    """Rows without ids or lines, in any partitions, with frequent values: the same draws. Blocks of another length draw alike."""
    from tallygate.operators import resample

    rows = [(0.0, float(v)) for v in [*range(300), *[7] * 200, *(0.5 * k * k for k in range(40))]]
    df = spark.createDataFrame(rows, "baseline double, candidate double")
    monkeypatch.setattr(resample, "BLOCK", 64)
    monkeypatch.setattr(resample, "TOGETHER", 2)
    o = Options(resamples=700)
    found = [compare(x, [Metric("mean-diff", bootstrap="bca")], o) for x in (df.coalesce(1), df.repartition(7), spark.createDataFrame(rows[::-1], df.schema).repartition(3))]
    assert all(f["paired_count"] == 540 for f in found)
    assert all((f["ci_low"], f["ci_high"]) == pytest.approx((found[0]["ci_low"], found[0]["ci_high"]), rel=1e-12) for f in found)
    monkeypatch.setattr(resample, "BLOCK", 1024)
    other = compare(df, [Metric("mean-diff", bootstrap="bca")], o)
    width = found[0]["ci_high"] - found[0]["ci_low"]
    assert other["ci_high"] - other["ci_low"] == pytest.approx(width, rel=0.15) and other["ci_low"] == pytest.approx(found[0]["ci_low"], abs=0.15 * width)


def test_rows_without_id_and_equal_lines_are_their_own(spark):
    df = spark.createDataFrame([(W, 1), (W, 1), (L, 1), (None, 2)], "result string, line long").where("result is not null")
    assert compare(df.union(df), [Metric("winrate")])["paired_count"] == 6


def test_grouped_mean_difference_equals_single_ones(spark):
    from tallygate.plans.compare import grouped_mean_diff

    rows = [(("a", "b", None, "c")[min(i % 4, 3) if i < 400 else 0], 0.0, float((i * 37) % 101) - 40, i + 1) for i in range(3000)] + [("one", 0.0, 4.0, 5000), ("none", None, None, 5001)]
    df = spark.createDataFrame(rows, "team string, baseline double, candidate double, line long").withColumn("baseline_status", F.when(F.col("team") == "none", "ok"))
    o = Options(resamples=300)
    got = {r.team: r for r in grouped_mean_diff(df, ("team",), options=o).collect()}
    assert set(got) == {"a", "b", None, "c", "one"} and (got["one"].ci_low, got["one"].ci_high) == (4.0, 4.0)
    for team in ("a", "b", None, "c"):
        r = compare(df.where(F.col("team").eqNullSafe(team)).drop("team"), [Metric("mean-diff")], o)
        g = got[team]
        assert (g.paired_count, g.verdict, g.has_error) == (r["paired_count"], r["verdict"], False)
        assert (g.effect, g.ci_low, g.ci_high) == pytest.approx((r["effect"], r["ci_low"], r["ci_high"]), rel=1e-9)


@pytest.mark.parametrize("kind", ["even", "frequent", "wide", "two"])
def test_order_statistics_by_narrowing(spark, monkeypatch, kind):
    """Ranges of more than a few rows are narrowed until they are short; frequent values and outliers included."""
    import numpy as np

    from tallygate.operators import ranks

    g = np.random.default_rng(5)
    x = {"even": g.uniform(size=4000), "frequent": np.where(g.uniform(size=4000) < 0.4, 3.0, g.normal(size=4000)), "wide": np.exp(g.normal(0, 60, 4000)), "two": g.integers(0, 2, 4000) * 1e9}[kind]
    monkeypatch.setattr(ranks, "SORTED", 100)
    df = spark.createDataFrame([(float(v),) for v in x], "d double").repartition(5)
    at, y = ranks.order_statistics(df, "d", len(x)), np.sort(x)
    for wanted in ([0], [3999], [0, 3999], [2000, 2001], [*range(1980, 2020), 7, 3500]):
        assert (at(np.array(wanted)) == y[wanted]).all()
    assert (at(np.array([[5, 6], [7, 5]])) == y[[[5, 6], [7, 5]]]).all()


def test_ranks_of_groups(spark):
    from tallygate.operators.ranks import ranked

    rows = [((None, "a", "b")[i % 3], float(i % 11) if i % 2 else 4.0) for i in range(500)]
    table, df = ranked(spark.createDataFrame(rows, "g string, x double").repartition(6), "x", ("g",))
    got = df.collect()
    for g in (None, "a", "b"):
        mine = sorted((r["rank"], r.x, r.n) for r in got if r.g == g)
        assert [m[1] for m in mine] == sorted(x for k, x in rows if k == g) and [m[0] for m in mine] == list(range(mine[0][2]))
    table.drop()


def test_netting_by_id(spark):
    df = spark.createDataFrame([("a", W, 1), ("a", W, 2), ("b", W, 3), ("b", D, 4), ("c", W, 5), ("c", L, 6), (None, L, 7)], "id string, result string, line long")
    r = compare(df, [Metric("elo")], Options(paired=True))
    assert (r["candidate_count"], r["baseline_count"], r["paired_count"]) == (2, 1, 4)
    assert kind_of(lambda: compare(df.union(df.limit(1)), [Metric("elo")], Options(paired=True))) == "DuplicateId"
    numbers = spark.createDataFrame([("a", 0.0, 1.0, 1), ("a", 0.0, -3.0, 2), ("b", 0.0, 1.0, 3)], "id string, baseline double, candidate double, line long")
    assert kind_of(lambda: compare(numbers, [Metric("mean-diff")])) == "DuplicateId"
    s = compare(numbers, [Metric("sign-test")], Options(paired=True))
    assert (s["candidate_count"], s["baseline_count"]) == (1, 1)


def test_clusters(spark):
    df = outcomes(spark, 60, 40, ids=lambda i: i // 10)
    r = compare(df, [Metric("winrate")], Options(clustered=True, resamples=500))
    assert (r["cluster_count"], r["max_cluster_size"], r["estimated_additional_trials"]) == (10, 10, None)
    assert r["design_effect"] > 3 and r["effective_sample_size"] == pytest.approx(100 / r["design_effect"])
    assert kind_of(lambda: compare(df, [Metric("winrate")], Options(clustered=True, paired=True))) == "ClusterByIdConflictsWithPairedById"
    assert kind_of(lambda: compare(df, [Metric("mean-diff")], Options(clustered=True))) == "IncompatibleClusterById"
    assert kind_of(lambda: compare(df, [Metric("winrate"), Metric("elo")], Options(clustered=True, correction="holm", resamples=50))) == "CorrectionConflictsWithClusterById"


def test_failure_policies_and_caps(spark):
    rows = [(W, "ok", "ok"), (L, None, "crash"), (None, "timeout", "ok"), ("odd", "crash", "crash"), (W, None, None)]
    df = spark.createDataFrame([(*r, i + 1) for i, r in enumerate(rows)], "result string, baseline_status string, candidate_status string, line long")
    assert kind_of(lambda: compare(df, [Metric("winrate")])) == "UnrecognizedOutcome"
    got = {p: compare(df, [Metric("elo", policy=p)]) for p in ("exclude", "loss")}
    assert [(r["candidate_count"], r["baseline_count"], r["paired_count"]) for r in got.values()] == [(2, 0, 2), (3, 1, 5)]
    r = compare(df, [Metric("elo", policy="loss")], Options(caps=FailureCaps(max_crashes=2)))
    assert (r["validity"], r["verdict"], r["promotion"], r["crashes"], r["timeouts"]) == ("invalid", "inconclusive", "not_promoted", 3, 1)
    assert r["failure_breakdown"]["candidate"] == {"timeout": 0, "crash": 2, "invalid": 0}
    assert compare(df, [Metric("elo", policy="loss")], Options(caps=FailureCaps(max_crashes=3)))["validity"] == "valid"


def test_errors_come_in_line_order(spark):
    schema = "id string, baseline double, candidate double, result string, baseline_status string, candidate_status string, line long"
    make = lambda *rows: spark.createDataFrame([(*r, i + 1) for i, r in enumerate(rows)], schema)
    nan = make(("a", 1.0, 2.0, None, None, None), ("b", float("nan"), 1.0, None, None, None), ("c", 1.0, None, None, None, None))
    with pytest.raises(GateError) as e:
        compare(nan, [Metric("mean-diff")])
    assert (e.value.kind, e.value.line) == ("InvalidValue", 2)
    assert kind_of(lambda: compare(make(("a", 1.0, 2.0, None, None, None)), [Metric("winrate")])) == "SchemaMismatch"
    assert kind_of(lambda: compare(make(("a", None, None, W, "bad", None)), [Metric("winrate")])) == "UnrecognizedStatus"
    assert kind_of(lambda: compare(make().limit(0), [Metric("winrate")])) == "EmptyInput"
    assert kind_of(lambda: compare(outcomes(spark, 1, 0), [Metric("winrate")], Options(confidence=1.0))) == "InvalidConfidence"
    assert compare(outcomes(spark, 0, 0, 5), [Metric("winrate")])["verdict"] == "inconclusive"


def test_quality_flags_and_further_trials(spark):
    r = compare(outcomes(spark, 12, 9, 40, ids=lambda i: i % 5), [Metric("elo")], Options(thresholds=Thresholds(0, -1)))
    assert r["data_quality"]["draw_heavy"] and r["data_quality"]["low_id_diversity"] and r["data_quality"]["effect_within_noise_floor"]
    n = compare(outcomes(spark, 55, 45), [Metric("winrate")])["estimated_additional_trials"]
    assert n and abs(n - 284) < 10


def test_sprt(spark):
    c = SprtConfig(0, 20)
    w = sprt(outcomes(spark, 400, 300), c)
    assert w["verdict"] == "pass" and w["drawelo"] is None and w["candidate_wins"] == 400
    t = sprt(outcomes(spark, 4, 3, 13), c, "trinomial")
    assert t["verdict"] == "inconclusive" and t["drawelo"] > 0
    rows = [(str(i // 2), (W, D, L)[(i * 7 + i // 3) % 3], i + 1) for i in range(40)]
    five = sprt(spark.createDataFrame(rows, "id string, result string, line long"), c, "pentanomial", paired=True)
    assert sum(five["pentanomial_counts"].values()) == five["paired_count"] == 20 and five["raw_trial_count"] == 40
    assert kind_of(lambda: sprt(outcomes(spark, 3, 0), c, "pentanomial", paired=True)) == "DuplicateId"
    assert kind_of(lambda: sprt(outcomes(spark, 3, 0), c, "pentanomial")) == "InvalidThreshold"
    g = by_group(outcomes(spark, 400, 300), c, "wald").first()
    assert g["llr"] == pytest.approx(w["llr"]) and g["verdict"] == "pass"


def legacy(spark):
    return [("matrix_legacy_a", outcomes(spark, 3, 1, 1)), ("matrix_legacy_b", outcomes(spark, 1, 3, 1))]


def test_star_matrix_and_plan(spark):
    m = matrix(spark, legacy(spark), [])
    a, b = m["candidates"]
    assert (a["elo"], a["ci_low"], a["ci_high"]) == pytest.approx((147.19071411783776, -148.1919432915074, 442.5733715271827), abs=1e-9)
    cell = m["matrix"][2]
    assert (cell["elo_diff"], cell["ci_low"], cell["ci_high"], cell["status"]) == (pytest.approx(294.38142823567557), pytest.approx(-123.35273196242588), pytest.approx(712.115588433777), "inferred")
    p = plan(spark, legacy(spark), [], min_elo=400)
    assert [(r["row"], r["col"], r["estimated_additional_trials"]) for r in p["recommendations"]] == [("baseline", "matrix_legacy_a", 0), ("baseline", "matrix_legacy_b", 0), ("matrix_legacy_a", "matrix_legacy_b", 0)]
    assert kind_of(lambda: plan(spark, legacy(spark), [], min_elo=0)) == "InvalidThreshold"


def games(spark, rows):
    return spark.createDataFrame([(*r, i + 1) for i, r in enumerate(rows)], "id string, a string, b string, result string, line long")


def test_mixed_graph(spark):
    rows = [("h1", "matrix_legacy_a", "matrix_legacy_b", "a_win"), ("h2", "isolated_x", "isolated_y", "a_win"), ("h3", "isolated_x", "isolated_y", "b_win")]
    m = matrix(spark, legacy(spark), [games(spark, rows)], resamples=600)
    by = {c["name"]: c for c in m["candidates"]}
    assert list(by) == ["matrix_legacy_a", "matrix_legacy_b", "isolated_x", "isolated_y"]
    assert by["matrix_legacy_a"]["elo"] == pytest.approx(168.51345241374688, abs=1e-6)
    assert by["matrix_legacy_b"]["elo"] == pytest.approx(-168.51345259495548, abs=1e-6)
    assert [c["component"] for c in m["candidates"]] == [1, 1, 0, 0]
    cells = {(c["row"], c["col"]): c for c in m["matrix"]}
    assert cells[("baseline", "isolated_x")]["status"] == "disconnected"
    assert cells[("baseline", "matrix_legacy_a")]["ci_low"] == pytest.approx(-405.3, abs=60)
    assert cells[("matrix_legacy_a", "matrix_legacy_b")]["ci_low"] is None
    p = plan(spark, legacy(spark), [games(spark, rows)], min_elo=20, resamples=600)["recommendations"]
    assert [r["current_ci_half_width"] is None for r in p] == [True] * 8 + [False] * 2
    assert kind_of(lambda: matrix(spark, [], [games(spark, [("1", "x", "x", "draw")])])) == "SchemaMismatch"
    assert kind_of(lambda: matrix(spark, [], [games(spark, [("1", "x", "y", "won")])])) == "UnrecognizedOutcome"
    assert kind_of(lambda: matrix(spark, [], [games(spark, [("1", "x", "y", "draw")] * 3)], paired=True)) == "DuplicateId"


@pytest.mark.parametrize("method", ["basic", "bca"])
def test_graph_bootstrap_methods(spark, method):
    rows = [(None, *p, r) for p, n in ((("x", "y"), 12), (("y", "z"), 9), (("x", "z"), 10)) for r in ["a_win"] * n + ["b_win"] * 6 + ["draw"] * 2]
    m = matrix(spark, [], [games(spark, rows)], resamples=200, method=method)
    assert all(c["ci_low"] < c["elo_diff"] < c["ci_high"] for c in m["matrix"])


def test_readers(spark, tmp_path):
    p = tmp_path / "t.jsonl"
    p.write_text('{"id":"a","result":"candidate_win","extra":1}\n\n{"id":"b","baseline":1,"candidate":2.5,"result":null}\n')
    rows = read(spark, str(p)).orderBy("line").collect()
    assert [(r.line, r.id, r.result, r.baseline, r.candidate, r._error) for r in rows] == [(1, "a", W, None, None, None), (3, "b", None, 1.0, 2.5, None)]
    for bad in ('{"id":1}', "not json", '{"id":"a"} x', '{"id":"a","id":"b"}', "[1]", '{"baseline":"1"}', '{"id":"a"},{"id":"b"}'):
        p.write_text(bad + "\n")
        assert kind_of(lambda: compare(read(spark, str(p)), [Metric("winrate")])) == "InvalidJson", bad
    c = tmp_path / "t.CSV"
    c.write_text("id,baseline,candidate\na,1,2\nb,,\nc,x,1\n")
    rows = read(spark, str(c)).orderBy("line").collect()
    assert [(r.line, r.id, r.baseline, r.candidate, r._error is None) for r in rows] == [(2, "a", 1.0, 2.0, True), (3, "b", None, None, True), (4, "c", None, 1.0, False)]
    assert kind_of(lambda: read(spark, str(tmp_path / "none.jsonl"))) == "Io"


def test_command_line(spark, tmp_path, capsys):
    p = tmp_path / "t.jsonl"
    p.write_text("".join(json.dumps({"id": str(i), "result": W if i < 62 else L}) + "\n" for i in range(100)))
    md = tmp_path / "r.md"
    assert main(["compare", str(p), "--metric", "winrate", "--metric", "elo", "--min-effect", "0.02", "--report-md", str(md)]) == 0
    assert json.loads(capsys.readouterr().out)["verdict"] == "pass" and "winrate" in md.read_text()
    assert main(["compare", str(p), "--metric", "winrate", "--min-effect", "-1"]) == 3
    assert main(["sprt", str(p), "--elo0", "0", "--elo1", "5"]) == 2
    assert main(["compare", str(p), "--metric", "winrate", "--quantile", "0.5"]) == 3
    assert main(["power", "--metric", "winrate", "--assume-effect", "0.05"]) == 0
    r = run(spark, parser().parse_args(["power", "--sprt", "--elo0", "0", "--elo1", "20"]))
    assert r["expected_trials_under_h0"] == 1601


def test_reports_render_and_pilots(spark):
    r = compare(outcomes(spark, 6, 3, 1), [Metric("elo")])
    assert to_frame(spark, r).first()["metric"] == "elo" and to_markdown(r).startswith("# Comparison")
    assert "| baseline |" in to_markdown(matrix(spark, legacy(spark), [])).replace("|  | baseline", "| baseline")
    assert to_markdown(plan(spark, legacy(spark), [], min_elo=50)).startswith("# Matches")
    assert to_markdown(sprt(outcomes(spark, 3, 1), SprtConfig(0, 5))).startswith("# Sequential")
    assert pilot_sd(pairs(spark, [1, 2, 3, 4])) == pytest.approx(1.2909944487)
    assert kind_of(lambda: pilot_sd(pairs(spark, [1]))) == "InsufficientPilotData"
    assert kind_of(lambda: pilot_sd(pairs(spark, [1, 1]))) == "ZeroVariancePilotData"
    assert undecided(spark, SprtConfig(0, 20), 3000) == pytest.approx(0.318, abs=0.04)


def test_declared_reports_by_group(spark):
    df = outcomes(spark, 62, 38).selectExpr("*", "'g' as team")
    rows = closed_form(df, [Metric("winrate"), Metric("elo")], by=("team",)).orderBy("metric").collect()
    assert [(r.team, r.metric, r.verdict, r.paired_count) for r in rows] == [("g", "elo", "pass", 100), ("g", "winrate", "pass", 100)]
    assert rows[1].ci_low == pytest.approx(0.022097552875490645)


def test_streams(spark, tmp_path):
    from tallygate.streaming.sequential import pentanomial_verdict, running_pairs, running_sprt

    src = tmp_path / "in"
    src.mkdir()
    for b in range(2):
        (src / f"{b}.json").write_text("".join(json.dumps({"id": str(i // 2), "result": (W, D)[i % 2]}) + "\n" for i in range(b * 5, b * 5 + 5)))
    read_ = lambda: spark.readStream.schema("id string, result string").option("maxFilesPerTrigger", 1).json(str(src))
    q = running_sprt(read_(), SprtConfig(0, 20), "trinomial").writeStream.format("memory").queryName("sprt_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    row = spark.table("sprt_out").first()
    assert (row.wins, row.draws, row.losses, row.verdict) == (5, 5, 0, "inconclusive")
    q = running_pairs(read_()).writeStream.format("memory").queryName("pairs_out").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.id, r.bucket) for r in spark.table("pairs_out").collect()) == [(str(i), 3) for i in range(5)]
    assert pentanomial_verdict([0, 0, 0, 5, 0], SprtConfig(0, 20))[0] > 0


@pytest.mark.parametrize(("n", "q"), [(2, 0.5), (3, 0.9), (17, 0.25), (40, 0.5), (41, 0.95)])
def test_quantile_bca_has_the_full_jackknife(n, q):
    import numpy as np

    from tallygate.functions import numeric
    from tallygate.operators.resample import bootstrap_quantiles
    from tallygate.plans.compare import quantile_interval

    x = np.sort(np.random.default_rng(n).exponential(size=n))
    at, o = (lambda ranks: x[ranks]), Options(resamples=500)
    left_out = np.array([np.quantile(np.delete(x, i), q) for i in range(n)])
    effect = float(np.quantile(x, q))
    expected = numeric.bca_interval(bootstrap_quantiles(at, n, q, 500, o.seed), effect, numeric.acceleration(left_out), 0.95)
    assert quantile_interval(at, n, q, effect, "bca", o) == pytest.approx(expected)
    assert quantile_interval(at, 1, q, 3.0, "bca", o) == (3.0, 3.0)


def test_lines_over_many_blocks(spark, tmp_path):
    """A file read in many blocks is numbered as a whole, and every file of a folder for itself."""
    for name, n in (("a", 5000), ("b", 300)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"id": f"{name}{i}", "result": W}) + "\n" * (1 + i % 2) for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000b")
    try:
        rows = read(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 5300 and all(r.line == 1 + i + i // 2 for r in rows for i in [int(r.id[1:])])


@pytest.mark.parametrize("joins", [False, True])
def test_large_graphs_equal_small_ones(spark, monkeypatch, joins):
    """Components and ratings by joins against those of one machine, on random graphs of several components, chains and lone nodes."""
    import random

    from tallygate.operators.graph import Graph
    from tallygate.operators import large_graph
    from tallygate.operators.large_graph import ratings, strong_components

    monkeypatch.setattr(large_graph, "IN_TASK", 8 if joins else 100)
    r, edges = random.Random(1), {}
    for _ in range(60):
        a, b = sorted(r.sample(range(26), 2))
        if a // 9 == b // 9 or r.random() < 0.15:
            edges[a, b] = r.choice([(3, 2, 1), (2, 0, 0), (0, 4, 0), (1, 1, 5), (0, 0, 2)])
    edges |= {(k, k + 1): (2, 3, 0) for k in (0, 1, 2, 9, 10)}
    if joins:  # one component of many edges, which settles soon, and one of few
        edges = {(a, b): (2 + a % 3, 2 + b % 2, 1) for b in range(6) for a in range(b)} | {(8, 9): (1, 2, 0)}
    g = Graph(26, [(a, b, *w) for (a, b), w in edges.items()])
    label, elo = g.fit()
    rows = [(f"n{a:02}", f"n{b:02}", *w) for (a, b), w in edges.items()]
    schema = "lo string, hi string, lo_wins long, hi_wins long, draws long"
    half = [[(*x[:2], *(k // 2 for k in x[2:])) for x in rows], [(*x[:2], *(k - k // 2 for k in x[2:])) for x in rows]]
    got = {x.node: x for x in ratings(*(spark.createDataFrame(h, schema) for h in half)).collect()}
    played = sorted({i for pair in edges for i in pair})
    assert sorted(got) == [f"n{i:02}" for i in played]
    for i in played:
        x = got[f"n{i:02}"]
        assert x.component == f"n{min(j for j in range(26) if label[j] == label[i]):02}" and x.elo == pytest.approx(elo[i], abs=1e-3)
    chain = [(i, i + 1) for i in range(12)] + [(20, 22), (22, 21), (21, 20), (21, 25)]
    found = strong_components(spark.createDataFrame([(i,) for i in (*range(13), 20, 21, 22, 25, 99)], "node long"), spark.createDataFrame(chain, "u long, v long"))
    assert {x.node: x.component for x in found.collect()} == {**{i: i for i in range(13)}, 20: 20, 21: 20, 22: 20, 25: 25, 99: 99}


def test_pairs_in_event_time(spark, tmp_path):
    """Repeated deliveries, a third record, a late one, a half that is given up, and a group key."""
    from datetime import datetime, timedelta

    from tallygate.streaming.windows import paired_windows, replay

    at = lambda hours: datetime(2024, 1, 1) + timedelta(hours=hours)
    first = [("x", "p1", 1, W, at(1)), ("x", "p1", 1, W, at(1)), ("x", "p2", 2, L, at(2)), ("y", "p3", 3, D, at(3)), ("y", "p3", 4, D, at(2.5)), ("x", "h", 5, W, at(4)), ("x", None, 6, W, at(4)), ("y", "n", 7, None, at(4))]
    second = [("x", "p1", 8, D, at(5)), ("x", "p2", 2, L, at(2)), ("x", "p2", 9, L, at(25)), ("y", "p3", 10, W, at(26))]
    third = [("x", "late", 11, W, at(3)), ("x", "h", 12, W, at(1)), ("y", "q", 13, L, at(60)), ("y", "q", 14, W, at(61))]
    end = [("x", "end", 15, W, at(1000))]
    schema = "team string, id string, line long, result string, ts timestamp"
    found = replay(spark, [spark.createDataFrame(b, schema) for b in (first, second, third, end)], lambda s: paired_windows(s, ("team",), delay="6 hours", forget="40 hours"), str(tmp_path / "stream"))
    got = sorted((r.start.day, r.team, *(r[f"bucket_{b}"] for b in range(5)), r.unpaired, r.excess) for r in found.collect())
    assert got == [(1, "x", 0, 0, 0, 1, 0, 0, 0), (1, "y", 0, 0, 1, 0, 0, 0, 0), (2, "x", 1, 0, 0, 0, 0, 1, 0), (2, "y", 0, 0, 0, 0, 0, 0, 1), (3, "y", 0, 0, 1, 0, 0, 0, 0)]


def test_many_files_are_one_scan(spark, tmp_path):
    """Names with blanks and plus signs, folders of files, and both formats; lines and errors are a file's own."""
    from tallygate.sources.readers import read_files

    (tmp_path / "a b+c.jsonl").write_text("".join(json.dumps({"id": f"a{i}", "result": W}) + "\n" for i in range(4)))
    (tmp_path / "d%20e.jsonl").write_text(json.dumps({"id": "d", "result": L}) + "\n")
    (tmp_path / "f.csv").write_text("id,result\nf1,draw\nf2,draw\n")
    (tmp_path / "g.jsonl").mkdir()
    for k in range(3):
        (tmp_path / "g.jsonl" / f"part-{k}.json").write_text(json.dumps({"id": f"g{k}", "result": D}) + "\n")
    paths = [str(tmp_path / x) for x in ("a b+c.jsonl", "d%20e.jsonl", "f.csv", "g.jsonl")]
    files = read_files(spark, paths)
    assert files.names == ["a b+c", "d%20e", "f", "g"]
    got = sorted((r.of_file, r.id, r.line) for r in files.rows.collect())
    assert got == [(0, "a0", 1), (0, "a1", 2), (0, "a2", 3), (0, "a3", 4), (1, "d", 1), (2, "f1", 2), (2, "f2", 3), (3, "g0", 1), (3, "g1", 1), (3, "g2", 1)]
    scans = read_files(spark, paths[:2] + paths[3:]).rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in scans
    m = matrix(spark, files, [])
    assert [(c["name"], c["candidate_count"], c["paired_count"]) for c in m["candidates"]] == [("a b+c", 4, 4), ("d%20e", 0, 1), ("f", 0, 2), ("g", 0, 3)]
    (tmp_path / "h.jsonl").write_text(json.dumps({"id": "h", "result": W}) + "\n{bad\n")
    with pytest.raises(GateError, match="2"):
        matrix(spark, read_files(spark, [*paths, str(tmp_path / "h.jsonl")]), [])
    assert kind_of(lambda: read_files(spark, [paths[0], str(tmp_path / "x" / "a b+c.csv")])) == "InvalidThreshold"


def test_standard_input_and_shared_folder(spark, monkeypatch):
    import io
    from types import SimpleNamespace

    from tallygate.sources.scratch import shared_folder

    data = "".join(json.dumps({"id": str(i), "result": W}) + "\n" for i in range(50_000)).encode()
    monkeypatch.setattr("sys.stdin", SimpleNamespace(buffer=io.BytesIO(data)))
    rows = read(spark, "-")
    assert rows.count() == 50_000 and rows.agg({"line": "max"}).first()[0] == 50_000
    remote = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None), conf=SimpleNamespace(get=lambda *a: None))
    assert kind_of(lambda: shared_folder(remote)) == "Io"


def test_duplicate_ids_name_the_second_record(spark):
    rows = [("a", 1.0, 5), ("b", 2.0, 3), ("a", 1.0, 9), ("a", 1.0, 7), ("b", 1.0, 20), (None, 1.0, 1), (None, 1.0, 2)]
    df = spark.createDataFrame([(i, 0.0, c, n) for i, c, n in rows], "id string, baseline double, candidate double, line long")
    with pytest.raises(GateError, match="line 7.* id a"):
        compare(df, [Metric("mean-diff")])
    with pytest.raises(GateError, match="line 9.* id a"):
        compare(df, [Metric("mean-diff")], Options(paired=True))
    with pytest.raises(GateError, match="line 7.* id a"):
        pilot_sd(df)


def test_grouping_sets_equal_separate_groups(spark):
    from tallygate.plans.compare import closed_form_sets

    df = spark.createDataFrame([(f"k{i // 2}", (W, L, D)[i % 3], i + 1, "xy"[i // 2 % 2], (None, "q")[i // 4 % 2]) for i in range(120)], "id string, result string, line long, team string, day string")
    sets, metrics, o = [("team", "day"), ("day",), ()], [Metric("winrate"), Metric("elo")], Options(paired=True)
    got = {(r.team, r.day, r.grouping_id, r.metric): tuple(r)[4:] for r in closed_form_sets(df, metrics, sets, o).collect()}
    for keys, number in ((("team", "day"), 0), (("day",), 2), ((), 3)):
        for r in closed_form(df, metrics, o, keys).collect():
            x = r.asDict()
            assert got.pop((x.get("team"), x.get("day"), number, r.metric)) == tuple(r)[len(keys) + 1 :]
    assert not got


def test_draws_are_shared_out_fairly():
    import numpy as np

    from tallygate.operators.resample import shares

    n, blocks, rs = 1000, 7, np.arange(3000)
    of = {b: k for b, k, _ in shares(n, blocks, 1, rs, 0, blocks)}
    assert list(of) == list(range(blocks)) and (sum(of.values()) == n).all()
    size = np.diff([i * n // blocks for i in range(blocks + 1)])
    for b in of:
        assert of[b].mean() == pytest.approx(size[b], rel=0.02) and of[b].var() == pytest.approx(size[b] * (1 - size[b] / n), rel=0.12)
    some = {b: k for b, k, _ in shares(n, blocks, 1, rs[10:20], 3, 5)}
    assert list(some) == [3, 4] and all((some[b] == of[b][10:20]).all() for b in some)
    few = {b: k for b, k, _ in shares(40, 4, 1, rs, 0, 4)}  # splits made draw by draw
    assert (sum(few.values()) == 40).all() and few[0].var() == pytest.approx(40 * 0.25 * 0.75, rel=0.12)


@pytest.mark.parametrize("method", ["percentile", "basic", "bca"])
def test_mean_intervals_cover(method):
    """Of samples of 30 from an exponential distribution, about nine tenths of the 90 % intervals hold the mean."""
    import numpy as np

    from tallygate.functions import numeric
    from tallygate.operators.resample import drawn_sums

    hit = 0
    for sample in range(300):
        x = np.sort(np.random.default_rng(sample).exponential(size=30))
        draws, gap = drawn_sums(x, 30, 0, sample, np.arange(400)) / 30, (x - x.mean()) / 29
        if method == "bca":
            lo, hi = numeric.bca_interval(draws, x.mean(), numeric.acceleration_from_sums((gap**3).sum(), (gap**2).sum()), 0.9)
        else:
            lo, hi = numeric.percentile_interval(draws, 0.9) if method == "percentile" else numeric.basic_interval(draws, x.mean(), 0.9)
        hit += lo <= 1 <= hi
    assert 0.79 < hit / 300 < 0.95


@pytest.mark.parametrize("q", [0.5, 0.8])
def test_quantile_intervals_cover(q):
    import numpy as np

    from tallygate.functions import numeric
    from tallygate.operators.resample import bootstrap_quantiles

    hit, true = 0, numeric.normal_quantile(q) if q != 0.5 else 0.0
    for sample in range(400):
        x = np.sort(np.random.default_rng(sample).normal(size=60))
        lo, hi = numeric.percentile_interval(bootstrap_quantiles(lambda r, x=x: x[r], 60, q, 400, sample), 0.9)
        hit += lo <= true <= hi
    assert 0.83 < hit / 400 < 0.96


def test_pairs_of_nodes_are_not_moved(spark):
    """Cells against all pairs one by one, places unlike names; no exchange lies above the join that makes the pairs."""
    import random

    from tallygate.plans.matrix import cells

    r = random.Random(3)
    nodes = [(f"n{i}", (7 * i) % 40, i % 3, float(i)) for i in range(40)]
    met = {tuple(sorted(r.sample([n[0] for n in nodes], 2))) for _ in range(200)}
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = cells(spark.createDataFrame(nodes, "node string, place long, component long, elo double"), spark.createDataFrame(sorted(met), "lo string, hi string"))
        plan = made._jdf.queryExecution().executedPlan().toString()
        got = {(c.row_name, c.col_name): (c.elo_diff, c.status) for c in made.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    status = lambda a, b: "disconnected" if a[2] != b[2] else "direct" if tuple(sorted((a[0], b[0]))) in met else "inferred"
    assert got == {(a[0], b[0]): (a[3] - b[3] if a[2] == b[2] else None, status(a, b)) for a in nodes for b in nodes if a[1] < b[1]}
    above = plan[: re.search(r"(Join|CartesianProduct).*row_place.*<.*col_place", plan).start()]
    assert "Exchange" not in above


def test_ids_of_a_part_share_a_state_and_a_timer():
    """A thousand ids in two calls and one of the timer: pairs, a repeated record, third records, and halves given up once their time is over."""
    import pandas as pd

    from tallygate.streaming.windows import PairUp

    class State:
        value = None
        get = lambda self: self.value
        update = lambda self, v: setattr(self, "value", v)
        clear = lambda self: setattr(self, "value", None)

    class Handle:
        def __init__(self):
            self.state, self.timers = State(), set()
            self.getValueState = lambda *_: self.state
            self.registerTimer, self.deleteTimer = self.timers.add, self.timers.remove

    class Clock:
        getCurrentWatermarkInMs = getExpiryTimeInMs = lambda self: 1_600

    handle, pairs = Handle(), PairUp(["team", "id"], 1_000)
    pairs.init(handle)
    frame = lambda rows: pd.DataFrame(rows, columns=["team", "id", "line", "points", "ms"])
    first = list(pairs.handleInputRows((0,), iter([frame([("x", f"i{k}", k, k % 3, k) for k in range(700)]), frame([("x", f"i{k}", k, k % 3, k) for k in range(1000)])]), None))
    assert sum(map(len, first)) == 0 and handle.timers == {1_000}
    second = pd.concat(pairs.handleInputRows((0,), iter([frame([("x", f"i{k}", 5000 + k, 1, 2_000) for k in range(0, 1000, 2)] + [("x", "i0", 9000, 1, 1_500)])]), None))
    assert len(second) == 501 and second["bucket"].tolist() == [k % 3 + 1 for k in range(0, 1000, 2)] + [-1]
    assert (second["completed"].astype("datetime64[ms]").astype("int64") == 2_000).all() and handle.timers == {1_001}
    handle.timers.clear()  # it fires
    clock = Clock()
    clock.getExpiryTimeInMs = lambda: 1_001
    gone = pd.concat(pairs.handleExpiredTimer((0,), clock, clock))
    assert gone["id"].tolist() == [f"i{k}" for k in range(1, 601, 2)] and gone["bucket"].isna().all() and handle.timers == {1_601}
    assert (gone["completed"].astype("datetime64[ms]").astype("int64") == [1_000 + k for k in range(1, 601, 2)]).all()


def test_sums_of_a_block_are_those_of_single_draws(monkeypatch):
    """Streams of any lengths, some empty, whatever is drawn at a time; every draw mixed by itself in whole numbers."""
    import numpy as np

    from tallygate.operators import resample

    def place(bits: int, j: int, size: int) -> int:
        x, high = (bits + j * resample.DRAW) % 2**32, bits >> 32
        for i, (shift, factor) in enumerate(resample.MIX32):
            x = (x ^ (x >> shift)) * factor % 2**32
            x ^= high if i == 0 else 0
        return x * size >> 32

    g = np.random.default_rng(5)
    values, k, bits = g.normal(size=53), g.integers(0, 70, 40), g.integers(0, 2**64, 40, np.uint64)
    k[:3] = 0
    expected = [sum(values[place(int(b), j, 53)] for j in range(n)) for b, n in zip(bits, k)]
    for cells in (1, 100, 1 << 16):
        monkeypatch.setattr(resample, "CELLS", cells)
        assert resample.block_sums(values, k, bits) == pytest.approx(expected, abs=1e-9)
    assert resample.block_sums(values, k * 0, bits).tolist() == [0] * 40


def test_pairs_of_unlike_components_bring_no_edges(spark):
    """They are made apart from the others, from names alone; each pair comes once, with its interval."""
    from tallygate.plans.matrix import cells

    nodes = [(f"n{i}", 30 - i, i % 4, float(i)) for i in range(30)]
    ends = [(30 - b, 30 - a, 1.0 * a, 2.0 * b) for a in range(30) for b in range(a) if a % 4 == b % 4]  # (place, place, low, high), lower place first
    ends = [(min(a, b), max(a, b), x, y) for a, b, x, y in ends]
    met = [("n0", "n4"), ("n1", "n2")]
    made = cells(spark.createDataFrame(nodes, "node string, place long, component long, elo double"), spark.createDataFrame(met, "lo string, hi string"), spark.createDataFrame(ends, "a long, b long, ci_low double, ci_high double"))
    branches = made._jdf.queryExecution().optimizedPlan().children()
    assert branches.size() == 2 and "disconnected" in branches.apply(0).toString() and "met" not in branches.apply(0).toString()
    interval = {(a, b): (x, y) for a, b, x, y in ends}
    got = [(c.row_name, c.col_name, c.elo_diff, c.ci_low, c.ci_high, c.status) for c in made.collect()]
    status = lambda a, b: "disconnected" if a[2] != b[2] else "direct" if tuple(sorted((a[0], b[0]))) in met else "inferred"
    want = [(a[0], b[0], a[3] - b[3] if a[2] == b[2] else None, *interval.get((a[1], b[1]), (None, None)), status(a, b)) for a in nodes for b in nodes if a[1] < b[1]]
    assert sorted(got, key=lambda x: x[:2]) == sorted(want, key=lambda x: x[:2])
