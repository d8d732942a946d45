"""Numbers against independently computed constants."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallygate.errors import GateError
from tallygate.functions import numeric as f
from tallygate.operators.graph import Graph
from tallygate.operators.resample import bootstrap_quantiles
from tallygate.plans import power
from tallygate.schema import Metric, SprtConfig, Thresholds


@pytest.mark.parametrize(("c", "z"), [(0.9, 1.6448536), (0.95, 1.9599640), (0.99, 2.5758293)])
def test_normal_quantile(c, z):
    assert f.z_two_sided(c) == pytest.approx(z, abs=1e-7)
    assert f.normal_cdf(z) == pytest.approx(1 - (1 - c) / 2, abs=1e-7)


@pytest.mark.parametrize(("k", "n", "ends"), [(50, 100, (0.4038315, 0.5961685)), (60, 100, (0.5020026, 0.6905987))])
def test_wilson(k, n, ends):
    assert f.wilson(k / n, n, 0.95) == pytest.approx(ends, abs=1e-7)


@pytest.mark.parametrize(
    ("k", "n", "c", "exact", "jeffreys"),
    [
        (5, 20, 0.95, (0.086571, 0.491046), (0.102398, 0.464195)),
        (0, 10, 0.95, (0, 0.308497), (0, 0.217196)),
        (50, 100, 0.95, (0.398321, 0.601679), (0.403174, 0.596826)),
        (100, 100, 0.95, (0.963783, 1), (0.975255, 1)),
        (1, 1, 0.95, (0.025, 1), (0.146746, 1)),
        (7, 7, 0.99, (0.469117, 1), (0.581439, 1)),
    ],
)
def test_beta_intervals(k, n, c, exact, jeffreys):
    assert f.clopper_pearson(k, n, c) == pytest.approx(exact, abs=1e-6)
    assert f.jeffreys(k, n, c) == pytest.approx(jeffreys, abs=1e-6)


@given(st.floats(1e-6, 1 - 1e-6), st.floats(0.5, 300), st.floats(0.5, 300))
@settings(max_examples=60, deadline=None)
def test_beta_quantile_inverts(p, a, b):
    assert f.beta_cdf(f.beta_quantile(p, a, b), a, b) == pytest.approx(p, abs=1e-9)


def test_ratings():
    assert f.elo_from_score(0.62) == pytest.approx(85.04323715257746)
    assert f.elo_interval(0.62, 100, 0.95) == pytest.approx((15.364961311521332, 154.7215129936337), abs=1e-9)
    assert f.score_from_elo(f.elo_from_score(0.7)) == pytest.approx(0.7)
    win, _, loss = f.bayes_probabilities(10, 200)
    assert f.elo_from_score(win + (1 - win - loss) / 2) == pytest.approx(7.302, abs=0.01)


def test_sequential_ratios():
    assert f.pentanomial_llr(0, 10, [5, 20, 50, 20, 5]) == pytest.approx(-0.206511723, abs=1e-8)
    assert f.pentanomial_llr(0, 20, [2, 10, 70, 10, 2]) == pytest.approx(-1.523230410, abs=1e-8)
    assert f.trinomial_llr(0, 20, 60, 0, 40)[0] == pytest.approx(f.wald_llr(0, 20, 60, 40), rel=0.05)
    assert f.trinomial_llr(0, 20, 0, 0, 0) == (0.0, None)
    assert f.wald_bounds(0.05, 0.05) == pytest.approx((-math.log(19), math.log(19)))


def test_quantiles_and_bootstrap_ends():
    assert f.quantile(np.arange(1, 11), 0.9) == pytest.approx(9.1)
    d = np.arange(100.0)
    lo, hi = f.percentile_interval(d, 0.9)
    assert f.basic_interval(d, 50, 0.9) == (100 - hi, 100 - lo)
    assert f.bca_levels(0.5, 1000, 0.0, 0.95) == pytest.approx((0.025, 0.975), abs=1e-8)
    assert f.acceleration(np.ones(5)) == 0


def test_quantile_bootstrap_equals_plain_resampling():
    g = np.random.default_rng(1)
    values = np.sort(g.normal(size=80))
    plain = np.array([np.quantile(g.choice(values, 80), 0.3) for _ in range(6000)])
    ours = bootstrap_quantiles(lambda r: values[r], 80, 0.3, 6000, 5)
    assert ours.mean() == pytest.approx(plain.mean(), abs=0.01)
    assert np.quantile(ours, [0.05, 0.95]) == pytest.approx(np.quantile(plain, [0.05, 0.95]), abs=0.04)


def test_fit_of_a_cycle_and_components():
    g = Graph(3, [(0, 1, 7, 3, 0), (1, 2, 6, 4, 0), (0, 2, 9, 1, 0)])
    label, elo = g.fit()
    assert len(set(label)) == 1 and elo[0] == 0
    w = 10 ** (elo / 400)
    for i, won in enumerate((16, 9, 5)):
        assert sum(10 * w[i] / (w[i] + w[j]) for j in range(3) if j != i) == pytest.approx(won, abs=1e-6)
    assert list(Graph(3, [(0, 1, 5, 0, 0), (1, 2, 1, 1, 0)]).components()) in ([0, 1, 1], [1, 0, 0])


@pytest.mark.parametrize(
    ("metric", "effects", "target", "method", "n", "p"),
    [
        ("elo", (20, 35), 0.8, "wilson", 4281, 0.8043871725361499),
        ("winrate", (0, 0.05), 0.8, "wilson", 796, 0.8096),
        ("winrate", (0.02, 0.1), 0.9, "wilson", 413, 0.9088),
        ("elo", (10, 60), 0.9, "wilson", 527, 0.9082),
        ("winrate", (0, 0.08), 0.8, "exact", 325, 0.8158),
    ],
)
def test_power(metric, effects, target, method, n, p):
    r = power.estimate_trials(metric, *effects, target_power=target, ci_method=method)
    assert r["estimated_trials"] == n and r["achieved_power"] == pytest.approx(p, abs=1e-4)


def test_power_of_means_and_sequential_tests():
    r = power.estimate_trials("mean-diff", 0.02, 0.10, assume_sd=0.15)
    assert (r["estimated_trials"], round(r["achieved_power"], 9)) == (28, 0.805703217)
    s = power.sprt_trials(SprtConfig(0, 20))
    assert (s["expected_trials_under_h0"], s["expected_trials_under_h1"]) == (1601, 1603)


@pytest.mark.parametrize(
    ("make", "kind"),
    [
        (lambda: Thresholds(0, 1), "InvalidThreshold"),
        (lambda: Thresholds.symmetric(-1), "InvalidThreshold"),
        (lambda: SprtConfig(5, 5), "InvalidThreshold"),
        (lambda: SprtConfig(0, 5, alpha=1), "InvalidThreshold"),
        (lambda: Metric("elo", ci_method="exact"), "IncompatibleCiMethod"),
        (lambda: Metric("sign-test", policy="loss"), "IncompatibleFailurePolicy"),
        (lambda: Metric("quantile-diff", bootstrap="bca"), "IncompatibleBootstrapMethod"),
        (lambda: Metric("quantile-diff", quantile=1.0), "InvalidQuantile"),
        (lambda: power.estimate_trials("winrate", 0.1, 0.1), "PowerRequiresEffectGap"),
        (lambda: power.estimate_trials("winrate", 0, 0.1, target_power=1), "InvalidTargetPower"),
        (lambda: power.estimate_trials("winrate", 0, 0.6), "InvalidThreshold"),
        (lambda: power.estimate_trials("winrate", 0, 1e-7), "PowerSearchExceededCap"),
        (lambda: power.estimate_trials("quantile-diff", 0, 1), "PowerUnsupportedForQuantileDiff"),
        (lambda: power.estimate_trials("mean-diff", 0, 1), "MeanDiffPowerRequiresSd"),
        (lambda: power.estimate_trials("mean-diff", 0, 1, assume_sd=0), "InvalidAssumeSd"),
        (lambda: power.estimate_trials("elo", 0, 1, assume_sd=1), "AssumeSdOnlyForMeanDiff"),
    ],
)
def test_configuration_errors(make, kind):
    with pytest.raises(GateError) as e:
        make()
    assert e.value.kind == kind
