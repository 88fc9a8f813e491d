import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import bench
from impulsar import C, LocalProjection, fe, interact
from impulsar.functions.dist import normal_isf, student_isf, student_log_sf
from impulsar.functions.lag_weights import default_bandwidth, quadratic_spectral, weights
from impulsar.operators import ranks
from impulsar.operators.covariance import _lagged
from impulsar.plans.options import Options, cluster_terms, lag_numbers, memory_bytes
from impulsar.plans.terms import plan_terms
from impulsar.sources.panel import clock


@pytest.mark.parametrize(("name", "value"), [("horizons", -1), ("horizons", True), ("covariance", "hc9"), ("hac_lags", -1), ("alpha", 1.0), ("alpha", 5e-324), ("demean_tol", 0.0), ("max_iter", 0), ("few_cluster_threshold", 1), ("hac_debias", 1), ("memory_budget", "lots"), ("memory_budget", 0)])
def test_options_are_checked(name, value):
    with pytest.raises(ValueError):
        LocalProjection(**({"horizons": 1} | {name: value}))


def test_small_parsers():
    assert memory_bytes("1.5 kb") == 1536 and Options(2, memory_budget="4GB").memory_budget == 4 << 30
    assert lag_numbers(3, "l") == (1, 2, 3) and lag_numbers([5, 2], "l") == (5, 2)
    for bad in (-1, True, [0], [1, 1], "2", 2**63, 10_001):
        with pytest.raises(ValueError):
            lag_numbers(bad, "l")
    assert cluster_terms("a") == (("a",),) and cluster_terms(("b", "a")) == (("a", "b"),) and cluster_terms(["a", ("c", "b")]) == (("a",), ("b", "c"))
    for bad in ([], list("abcde"), ["a", "a"], [("a", "a")], 5):
        with pytest.raises(ValueError):
            cluster_terms(bad)


def test_benchmark_report(tmp_path):
    assert bench.median_interval([2.0]) == (2.0, 2.0, 2.0)
    median, low, high = bench.median_interval([1.0, 2.0, 3.0, 4.0, 100.0])
    assert (median, low, high) == (3.0, 1.0, 100.0)
    bench.write_artifacts(str(tmp_path / "out"), {"value": 1}, {"a": [1.0, 2.0]})
    assert json.loads((tmp_path / "out/report.json").read_text()) == {"value": 1}
    assert (tmp_path / "out/times.csv").read_text().split() == ["query,run,seconds", "a,0,1.0", "a,1,2.0"]


def test_quantiles():
    assert normal_isf(0.025) == pytest.approx(1.959963984540054, rel=1e-14)
    for df, t in ((1, 12.706204736174696), (4, 2.7764451051977987), (30, 2.0422724563012373)):
        assert student_isf(0.025, df) == pytest.approx(t, rel=1e-11)
    t = student_isf(1e-20, 5)
    assert student_log_sf(t, 5) == pytest.approx(math.log(1e-20), rel=1e-10)


def test_kernel_weights():
    z = np.array([0.0, 0.05, 0.0999, 0.1001, 2.0])
    exact = [1.0] + [3 * (math.sin(x) / x - math.cos(x)) / x**2 for x in z[1:]]
    np.testing.assert_allclose(quadratic_spectral(z), exact, rtol=1e-10)
    assert list(weights("bartlett", 1, np.array([1, 2]))) == [0.5, 0.0]
    assert default_bandwidth(100, 0) == 4 and default_bandwidth(100, 9) == 9


def test_terms():
    plan = plan_terms((interact("a", "b", by=C("g", levels=["u", "v"])),), ("c", interact("b", "a")), {"a", "b", "c", "g"}, {})
    assert list(plan.terms) == ["a:b:g[u]", "a:b:g[v]", "c", "b:a", "a", "b", "g[v]", "a:g[v]", "b:g[v]"]
    assert plan.families[0].basis == ("a:b:g[u]", "a:b:g[v]") and "a" in plan.nuisance and "c" not in plan.nuisance
    for bad in (lambda: interact(), lambda: interact("a", "a"), lambda: interact("a", by="a"), lambda: C("g", levels=[]), lambda: C("g", levels=[1, 1]), lambda: fe(), lambda: C("g", levels=[None])):
        with pytest.raises(ValueError):
            bad()


def test_clock(spark):
    df = spark.createDataFrame([("+007",), (" 7",), ("7.0",), ("9223372036854775808",), ("-3",)], "t string")
    assert [r[0] for r in df.select(clock(df, "t")).collect()] == [7, None, None, None, -3]
    df = spark.createDataFrame([(2.0**53,), (3.0,), (2.5,), (float("nan"),)], "t double")
    assert [r[0] for r in df.select(clock(df, "t")).collect()] == [None, 3, None, None]
    for kind in ("date", "timestamp", "boolean", "decimal(10,0)"):
        with pytest.raises(ValueError):
            clock(spark.createDataFrame([], f"t {kind}"), "t")


@pytest.mark.parametrize("kernel", ["bartlett", "parzen", "quadratic_spectral"])
@pytest.mark.parametrize(("units", "rows", "span", "bandwidths"), [(6, 5, 2**62, [2**61, 3]), (30_000, 2, 2**62, [2**60, 2]), (2, 90, 120, [100, 7]), (2, 90, 10**9, [10**9, 10**7]), (1, 150, 10**6, [10**5, 10**3]), (3, 80, 80, [0, 80])])
def test_serial_sums_match_pairs(kernel, units, rows, span, bandwidths):
    rng = np.random.default_rng(units + rows)
    time = np.concatenate([np.sort(rng.choice(span, rows, replace=False) if span < 10**7 else np.unique(rng.integers(0, span, rows * 2))[:rows]) for _ in range(units)])
    unit = np.repeat(np.arange(units), rows)
    s = rng.normal(size=(len(unit), 2, 2))
    expected = np.einsum("nhi,nhj->hij", s, s)
    for apart in range(1, rows):
        for i in range(apart, rows):
            now = np.arange(units) * rows + i
            lag = time[now] - time[now - apart]
            for h, b in enumerate(bandwidths):
                g = np.einsum("n,ni,nj->ij", weights(kernel, b, lag), s[now, h], s[now - apart, h])
                expected[h] += g + g.T
    np.testing.assert_allclose(_lagged(unit, time, s, kernel, bandwidths), expected, rtol=1e-9, atol=1e-8)


def _dummies(frame, keys):
    return np.concatenate([(frame[k].to_numpy()[:, None] == np.unique(frame[k])).astype(float) for k in keys], axis=1)


@pytest.mark.parametrize("dense", [2000, 0])
@pytest.mark.parametrize("kind", ["crossed", "sparse", "apart", "latin"])
def test_rank_of_three_and_more_effects(spark, monkeypatch, kind, dense):
    """Against the dummies themselves, by a dense matrix at the end and by single levels only."""
    rng = np.random.default_rng(len(kind))
    n = {"crossed": 300, "sparse": 60, "apart": 120, "latin": 144}[kind]
    frame = pd.DataFrame({"a": rng.integers(0, 30, n), "b": rng.integers(0, 17, n), "c": rng.integers(0, 12, n), "d": rng.integers(0, 5, n)})
    if kind == "apart":  # two graphs without a common level, and levels that only meet in one row
        frame = frame.assign(**{k: frame[k] * 2 + np.arange(n) % 2 for k in frame})
    if kind == "latin":  # pairs of all effects are complete, the third is a function of the others
        i, j = np.divmod(np.arange(n), 12)
        frame = pd.DataFrame({"a": i, "b": j, "c": (i + j) % 12, "d": (i + 2 * j) % 12})
    monkeypatch.setattr(ranks, "MAX_DENSE", dense)
    rows = spark.createDataFrame(frame).withColumn("c", F.concat(F.lit("c"), "c"))
    for keys in (["a", "b", "c"], ["d", "c", "b", "a"]):
        found = ranks.effect_rank(rows, keys, [frame[k].nunique() for k in keys], "exact")
        assert (found.rank, found.exact) == (np.linalg.matrix_rank(_dummies(frame, keys)), True)


def test_rank_with_many_levels(spark):
    """The query's shape with more units than a dense matrix of all levels may have: seasons hold whole periods, cells are nations by seasons."""
    units, periods = 2500, 24
    rows = spark.range(units * periods).selectExpr("id % 2500 AS unit", "id div 2500 AS time", "concat_ws('-', id % 2500 % 25, id div 2500 % 12) AS cell").where("(unit * 7 + time) % 5 <> 0")
    found = ranks.effect_rank(rows, ["unit", "time", "cell"], [units, periods, 300], "exact")
    assert (found.rank, found.exact) == (units + periods - 1 + 300 - 25 - 12 + 1, True)


def test_rank_of_two_large_effects(spark):
    """More levels beside the largest effect than a dense matrix may have: one ring through all levels of two, around which the third does not add up to nothing."""
    rows = spark.range(6000).selectExpr("id div 2 AS a", "(id + 1) div 2 % 3000 AS b", "id div 3 % 4 AS c")
    found = ranks.effect_rank(rows, ["a", "b", "c"], [3000, 3000, 4], "exact")
    assert (found.rank, found.exact) == (3000 + 3000 - 1 + 1, True)


def test_rank_refuses_beyond_its_budget(spark, monkeypatch):
    rows = spark.range(400).selectExpr("id % 19 AS a", "id * 7 % 13 AS b", "id * id % 11 AS c")
    monkeypatch.setattr(ranks, "MAX_CELLS", 10)
    with pytest.raises(ValueError, match="budget of 10 pairs"):
        ranks.effect_rank(rows, ["a", "b", "c"], [19, 13, 6], "exact")
