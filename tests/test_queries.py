"""Registered queries against their SQL form at the smallest scale."""

import os

import pytest

import check
import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = """flagship_mean_reversion w02_ema w10_frama w12_super_smoother w15_connors_rsi w26_adx w40_chaikin_vol w53_dominant_cycle w55_supertrend
w59_patterns w60_drawdown_episodes w67_fill_gaps w72_hurst w80_cusum s11_venue_dialects f05_s09_dead_letters f09_market_quality f17_distance_anomalies
k05_depth_walk k09_priority_sample a03_volume_profile a04_trade_value_area a06_trade_statistics a07_backtest_metrics a18_es_decomposition a20_covariance_pairs
a29_psi a31_a32_rank_tests a60_random_stress j06_trade_vs_mid j07_trade_excursions j08_b17_multi_timeframe_vote j16_triangles j18_pre_trade_checks
b12_backtest b14_monte_carlo t07_circuit_breaker t17_position_ledger x01_black_scholes x25_a65_variant_split m03_unit_root m06_granger m10_garch_fit
m15_tail_dependence l07_a66_attribution p10_p11_random_mix w78_correlation_graph""".split()
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
NAMES = list(QUERIES) if os.environ.get("TAPEWORKS_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE:
        assert len(got) > 0
        return
    want = con.execute(ORACLE[name]).df()
    if not len(want):
        assert list(sorted(got.columns)) == list(sorted(want.columns)) and not len(got)
        return
    ok, why = check.compare(got, want)
    assert ok, why


def test_entry_and_registry(spark):
    assert entry.entry(spark).schema.names == ["symbol", "signals", "avg_next_return", "avg_rsi"]
    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) > 200
