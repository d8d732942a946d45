"""Registered queries against their SQL in DuckDB."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tallygate import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_same_rows(spark, duck, name):
    a, b = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLE[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].sort_values(cols, ignore_index=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-6)


RESAMPLED = ["quantile_diff", "quantile_diff_basic", "cluster_bootstrap", "matrix_general", "matrix_bca", "matrix_dense", "sprt_horizon"]


def test_only_resampled_reports_lack_sql():
    assert sorted(n for n in queries.QUERIES if n not in queries.ORACLE) == sorted(RESAMPLED)


@pytest.mark.parametrize("name", ["mean_diff_percentile", "mean_diff_bca", "quantile_diff", "quantile_diff_basic", "cluster_bootstrap"])
def test_resampled_intervals(spark, duck, name):
    """The effect is SQL's; the interval is about as wide as theory has it."""
    r = queries.QUERIES[name](spark, SF).first()
    assert r.ci_low < r.effect < r.ci_high
    if name == "cluster_bootstrap":
        w, x = duck.execute(f"SELECT count(*) FILTER (result = 'candidate_win'), count(*) FILTER (result = 'baseline_win') FROM ({queries.duck(queries.CLUSTERS)}) c").fetchone()
        assert (r.candidate_count, r.baseline_count) == (w, x) and r.effect == pytest.approx(w / (w + x) - 0.5, abs=1e-6) and 0.3 < r.design_effect < 3
        return
    d = np.sort(duck.execute(f"SELECT candidate - baseline FROM ({queries.duck(queries.PAIRS)}) p").fetchnumpy()["(candidate - baseline)"])
    n = len(d)
    if name.startswith("mean"):
        assert r.effect == pytest.approx(d.mean(), abs=1e-5) and (r.ci_high - r.ci_low) / 2 == pytest.approx(1.96 * d.std(ddof=1) / n**0.5, rel=0.15)
    else:
        assert r.effect == pytest.approx(np.quantile(d, r.quantile), abs=1e-5)
        step = 1.96 * (r.quantile * (1 - r.quantile) / n) ** 0.5
        lo, hi = np.quantile(d, [r.quantile - step, r.quantile + step])
        assert (r.ci_high - r.ci_low) == pytest.approx(hi - lo, rel=0.35)


@pytest.mark.parametrize("name", ["matrix_general", "matrix_bca"])
def test_matrix_intervals(spark, duck, name):
    cells = queries.QUERIES[name](spark, SF).collect()
    elo = {r[0]: r[1] for r in duck.execute(f"SELECT name, elo FROM ({queries.ORACLE['matrix_ratings']}) r").fetchall()}
    assert len(cells) == 10
    for c in cells:
        assert c.status == "direct" and c.ci_low < c.elo_diff < c.ci_high and c.elo_diff == pytest.approx(elo[c.row] - elo[c.col], abs=0.01)


def test_dense_matrix(spark, duck):
    cells = queries.QUERIES["matrix_dense"](spark, SF).collect()
    n = duck.execute(f"SELECT count(DISTINCT a) FROM ({queries.duck(queries._ROUND)}) r").fetchone()[0]
    assert len(cells) == n * (n - 1) // 2 and all(c.ci_low < c.elo_diff < c.ci_high for c in cells)


def test_horizon(spark):
    assert 0.2 < queries.QUERIES["sprt_horizon"](spark, SF).first().probability_no_decision_by_horizon < 0.9


def test_claims_of_one_level_keep_their_order(spark, tmp_path):
    """Both levels lie below the least one searched, where rounding would order them in SQL."""
    prices = [1100.0] * 300 + [900.0] * 30 + [1010.0] * 10
    lines = [(o, k, p, f) for o, x in enumerate(prices) for k, p, f in ((1, 1000.0, "N"), (2, x, "R"))]
    pd.DataFrame(lines, columns=["l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag"]).to_parquet(tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet')")
    a, b = queries.QUERIES["claim_correction"](spark, str(tmp_path)).collect(), con.execute(queries.ORACLE["claim_correction"]).fetchall()
    assert sorted(map(tuple, a)) == sorted(b) and {r.metric: r.adjusted_alpha_threshold for r in a} == {"winrate": 0.025, "sign-test": 0.05}
