import sys
import types
import warnings

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from impulsar import C, FewClustersWarning, LocalProjection, fe, interact
from impulsar.operators import absorb
from impulsar.plotting import plot_irf
from impulsar.sources.panel import read_panel

from .oracle import estimates

warnings.simplefilter("ignore", FewClustersWarning)


def make(units=20, periods=12, seed=881, drop=()):
    rng = np.random.default_rng(seed)
    df = pd.DataFrame({"unit": np.repeat(np.arange(units), periods), "time": np.tile(np.arange(periods), units)})
    df["third"], df["state"] = df.unit % 3, df.unit // 4
    df["x"], df["z"] = rng.normal(size=(2, len(df)))
    df["y"] = 0.5 * df.x + 0.1 * df.unit + rng.normal(size=len(df))
    return df.drop(index=list(drop)).reset_index(drop=True)


BALANCED, GAPPED = make(), make(drop=(5, 17, 100))


def fit(df, horizons=2, options=None, **spec):
    model = LocalProjection(horizons=horizons, **({"covariance": "homoskedastic"} | (options or {})))
    return model.fit(df, **({"outcome": "y", "shock": "x", "controls": ["z"], "unit": "unit", "time": "time"} | spec))


def close(model, df, horizons=2, names=("x", "z"), **oracle):
    at = [list(model.feature_names_in_).index(n) for n in names]
    coef, se = estimates(df, horizons, **oracle)
    np.testing.assert_allclose(model.coef_[:, at], coef, rtol=1e-8, atol=1e-10)
    np.testing.assert_allclose(model.stderr_[:, at], se, rtol=1e-8, atol=1e-10)


@pytest.mark.parametrize("effects", [(), ("unit",), ("time",), ("unit", "time"), ("unit", "time", "third")])
@pytest.mark.parametrize("kind", ["homoskedastic", "hc1"])
def test_effects_match_dummies(spark, effects, kind):
    close(fit(GAPPED, options={"covariance": kind}, fixed_effects=effects), GAPPED, effects=[(e,) for e in effects], kind=kind)


@pytest.mark.parametrize("kind", ["hc0", "hc2", "hc3"])
def test_robust(spark, kind):
    close(fit(GAPPED, options={"covariance": kind}), GAPPED, kind=kind)


def test_leverage_needs_no_effects(spark):
    with pytest.raises(ValueError, match="HC2"):
        fit(GAPPED, options={"covariance": "hc2"}, fixed_effects=["unit"])


@pytest.mark.parametrize(("cluster", "terms", "policy", "parameters"), [
    ("unit", [("unit",)], "nonnested", 2 + 10), ("unit", [("unit",)], "full", 2 + 29), ("unit", [("unit",)], "none", 2),
    (["state", "time"], [("state",), ("time",)], "nonnested", 3), (("third", "time"), [("third", "time")], "nonnested", 2 + 29), (["unit", "time", ("third", "state")], [("unit",), ("time",), ("third", "state")], "none", 2),
])
def test_clusters(spark, cluster, terms, policy, parameters):
    model = fit(GAPPED, options={"covariance": "cluster", "cluster_df": policy}, fixed_effects=["unit", "time"], cluster=cluster)
    assert set(model.correction_rank_by_horizon_) == {parameters}
    close(model, GAPPED, effects=[("unit",), ("time",)], kind="cluster", clusters=terms, correction=parameters)


@pytest.mark.parametrize("kernel", ["bartlett", "parzen", "quadratic_spectral"])
@pytest.mark.parametrize(("kind", "effects"), [("hac", ("unit",)), ("hac", ("time",)), ("driscoll_kraay", ("unit",))])
def test_serial(spark, kernel, kind, effects):
    model = fit(GAPPED, 1, options={"covariance": kind, "hac_kernel": kernel, "hac_lags": 2, "hac_debias": False}, fixed_effects=effects)
    close(model, GAPPED, 1, effects=[(e,) for e in effects], kind=kind, kernel=kernel)


def test_cumulative_and_joint_effect(spark):
    model = fit(GAPPED, options={"response": "cumulative"}, fixed_effects=["unit", fe("third", "time")])
    close(model, GAPPED, effects=[("unit",), ("third", "time")], cumulative=True)


@pytest.mark.parametrize("acceleration", ["none", "irons_tuck", "aitken"])
def test_alternating_projections_agree(spark, monkeypatch, acceleration):
    direct = fit(GAPPED, 1, fixed_effects=["unit", "time"])
    monkeypatch.setattr(absorb, "MAX_LEVELS", 3)
    monkeypatch.setattr(absorb, "MAX_VALUES", 0)
    swept = fit(GAPPED, 1, options={"demean_acceleration": acceleration}, fixed_effects=["unit", "time"])
    assert (direct.demeaning_diagnostics_["method"], swept.demeaning_diagnostics_["method"]) == ("exact_schur", "map")
    assert list(swept.model_rank_by_horizon_) == list(direct.model_rank_by_horizon_)
    np.testing.assert_allclose(swept.coef_, direct.coef_, rtol=1e-7)
    np.testing.assert_allclose(swept.stderr_, direct.stderr_, rtol=1e-7)


@pytest.mark.parametrize(("effects", "kind"), [(("unit", "time"), "hc1"), (("time", "wave"), "hc1"), (("unit", "time", "wave"), "cluster")])
def test_level_values_agree(spark, monkeypatch, effects, kind):
    data = GAPPED.assign(wave=(GAPPED.unit * 7 + GAPPED.time * 3) % 5)
    options = {"covariance": kind, "fe_dof": "exact"}
    more = {"cluster": "unit"} if kind == "cluster" else {}
    direct = fit(data, 1, options=options, fixed_effects=effects, **more)
    monkeypatch.setattr(absorb, "MAX_LEVELS", 3)
    solved = fit(data, 1, options=options, fixed_effects=effects, **more)
    assert (direct.demeaning_diagnostics_["method"], solved.demeaning_diagnostics_["method"]) == ("exact_schur", "schur_cg")
    assert list(solved.model_rank_by_horizon_) == list(direct.model_rank_by_horizon_)
    np.testing.assert_allclose(solved.coef_, direct.coef_, rtol=1e-8)
    np.testing.assert_allclose(solved.stderr_, direct.stderr_, rtol=1e-8)
    frames = [m.residuals_frame(1).toPandas().sort_values(["unit", "time"]).select_dtypes("number").to_numpy() for m in (solved, direct)]
    np.testing.assert_allclose(*frames, atol=1e-8)


def test_level_values_give_up(spark, monkeypatch):
    monkeypatch.setattr(absorb, "MAX_LEVELS", 3)
    with pytest.raises(RuntimeError, match="did not converge in 1 iterations"):
        fit(GAPPED, 1, options={"max_iter": 1}, fixed_effects=["unit", "time"])


@pytest.mark.parametrize(("counts", "columns", "main"), [([50, 10**6], 4, 0), ([10**7, 1000], 4, 0), ([50, 10**7], 4, 1), ([10**7, 10**7], 4, None)])
def test_group_of_level_values(counts, columns, main):
    assert absorb.vector_group(["__u", "other"], counts, "__u", columns) == main


def test_shift_and_scale(spark):
    base = fit(GAPPED, 1, fixed_effects=["unit", "time"])
    moved = GAPPED.assign(x=GAPPED.x + 1e8, y=GAPPED.y * 1e6)
    np.testing.assert_allclose(fit(moved, 1, fixed_effects=["unit", "time"]).coef_, base.coef_ * 1e6, rtol=1e-6)


def test_lags_and_per_horizon_samples(spark):
    model = fit(GAPPED, 2, options={"sample": "per_horizon"}, outcome_lags=1, shock_lags=[2], fixed_effects=["unit"])
    assert list(model.feature_names_in_) == ["x", "z", "y_lag1", "x_lag2"]
    value = GAPPED.set_index(["unit", "time"])
    for h in range(3):
        rows = []
        for (u, t), r in value.iterrows():
            try:
                rows.append((u, r.x, r.z, value.y[u, t - 1], value.x[u, t - 2], value.y[u, t + h]))
            except KeyError:
                continue
        a = pd.DataFrame(rows)
        a = a.groupby(0).transform(lambda c: c - c.mean()).to_numpy()
        np.testing.assert_allclose(model.coef_[h], np.linalg.lstsq(a[:, :4], a[:, 4], rcond=None)[0], rtol=1e-9)
        assert model.n_obs_by_horizon_[h] == len(rows)


def test_moderation(spark):
    model = fit(GAPPED, 1, shock=interact("x", by=C("third")), fixed_effects=["unit"])
    wide = GAPPED.assign(**{f"l{k}": GAPPED.x * (GAPPED.third == k) for k in range(3)})
    coef, _ = estimates(wide, 1, x=("l0", "l1", "l2", "z"), effects=[("unit",)])
    frame = model.irf_frame()
    np.testing.assert_allclose(frame.pivot(index="horizon", columns="level", values="estimate").to_numpy(), coef[:, :3], rtol=1e-9)
    assert {t["term"] for t in model.absorbed_terms_} == {"third[1]", "third[2]"}
    assert set(frame.level_n_obs) <= set(range(300))

    model = fit(GAPPED, 1, controls=(), shock=interact("x", by="z"), fixed_effects=["unit"])
    wide = GAPPED.assign(xz=GAPPED.x * GAPPED.z)
    coef, _ = estimates(wide, 1, x=("x", "xz", "z"), effects=[("unit",)])
    np.testing.assert_allclose(model.irf_frame(at=[2.0]).estimate, coef[:, 0] + 2 * coef[:, 1], rtol=1e-9)
    with pytest.raises(ValueError, match="at="):
        model.irf_frame()


def test_singletons(spark):
    rows = [(0, 0, 0), (0, 1, 1), (1, 0, 1), (1, 1, 0), (2, 0, 5), (3, 7, 1), (2, 8, 6)]
    df = pd.DataFrame(rows, columns=["unit", "time", "x"]).assign(y=np.arange(7.0), z=1.0)
    from impulsar.operators.sample import prune_singletons

    kept, dropped, rounds = prune_singletons(spark.createDataFrame(df), ["unit", "time"])
    assert (kept.count(), dropped, rounds) == (4, 3, 2)


def test_errors_leave_it_unfitted(spark):
    cases = [
        (GAPPED.assign(x=1.0), {"fixed_effects": ["unit"]}, "negligible within variation"),
        (GAPPED.assign(z=GAPPED.x), {}, "rank deficient"),
        (pd.concat([GAPPED, GAPPED.iloc[:1]]), {}, "duplicate"),
        (GAPPED.assign(x=np.where(GAPPED.index == 3, np.nan, GAPPED.x)), {}, "complete"),
        (GAPPED.assign(x=np.where(GAPPED.index == 3, np.inf, GAPPED.x)), {}, "finite"),
        (GAPPED.assign(x="a"), {}, "numeric"),
        (GAPPED.assign(time=GAPPED.time + 0.5), {}, "time must"),
        (GAPPED.drop(columns="z"), {}, "missing required columns"),
        (GAPPED, {"controls": ["x"]}, "duplicate columns"),
        (GAPPED, {"cluster": "unit"}, "only valid"),
    ]
    for df, spec, message in cases:
        model = LocalProjection(horizons=1, covariance="homoskedastic")
        with pytest.raises(ValueError, match=message):
            model.fit(df, **({"outcome": "y", "shock": "x", "controls": ["z"], "unit": "unit", "time": "time"} | spec))
        assert not hasattr(model, "coef_")
    with pytest.raises(ValueError, match="no valid observations"):
        fit(GAPPED, 40)


def test_inputs_and_results(spark):
    text = GAPPED.assign(x=GAPPED.x.map(repr), time=GAPPED.time.map(lambda t: f"+{t:03d}"))
    model = fit(text, 1, fixed_effects=["unit"])
    np.testing.assert_allclose(model.coef_, fit(GAPPED, 1, fixed_effects=["unit"]).coef_, rtol=1e-12)
    array = GAPPED[["unit", "time", "x", "z", "y"]].to_numpy()
    named = fit(array, 1, column_names=["unit", "time", "x", "z", "y"], fixed_effects=["unit"])
    np.testing.assert_allclose(named.coef_, model.coef_, rtol=1e-12)
    table = fit(pa.Table.from_pandas(GAPPED), 1, fixed_effects=["unit"])
    np.testing.assert_allclose(table.coef_, model.coef_, rtol=1e-12)
    assert list(model.to_frame().columns) == ["horizon", "sample", "response", "n_obs", "coefficient", "estimate", "std_error", "ci_low", "ci_high"]
    assert model.to_spark().count() == 4
    rest = model.residuals_frame(1).toPandas()
    assert len(rest) == model.n_obs_ and abs(rest.residual.sum()) < 1e-8
    assert model.sample_frame(0).count() == model.n_obs_
    assert (model.n_units_, model.n_periods_) == (20, 12)
    assert "n_obs" in model.summary()


class Axes:
    """Records what is drawn."""

    def __init__(self):
        self.calls = []

    def plot(self, x, y, **style):
        self.calls.append(("plot", list(x), list(y), style))
        return [self]

    def get_color(self):
        return "own"

    def __getattr__(self, name):
        return lambda *args, **style: self.calls.append((name, *args, style))


def test_plots(spark, monkeypatch):
    pyplot = types.ModuleType("matplotlib.pyplot")
    package = types.ModuleType("matplotlib")
    package.pyplot = pyplot
    monkeypatch.setitem(sys.modules, "matplotlib", package)
    monkeypatch.setitem(sys.modules, "matplotlib.pyplot", pyplot)
    model, ax = fit(GAPPED, 2, fixed_effects=["unit"]), Axes()
    assert plot_irf(model, ax=ax) is ax
    path = model.irf_frame("x")
    assert ("plot", [0, 1, 2], list(path.estimate)) in [c[:3] for c in ax.calls]
    band = next(c for c in ax.calls if c[0] == "fill_between")
    assert list(band[2]) == list(path.ci_low) and list(band[3]) == list(path.ci_high)
    assert band[-1]["color"] == "own" and band[-1]["label"] == "95% confidence"
    with pytest.raises(ValueError, match="shock"):
        plot_irf(model, "z", ax=ax)
    with pytest.raises(ValueError, match="band_alpha"):
        plot_irf(model, ax=ax, band_alpha=2)


def test_panels_from_files(spark, tmp_path):
    GAPPED.to_csv(tmp_path / "panel.csv", index=False)
    GAPPED.to_parquet(tmp_path / "panel.parquet")
    read = [fit(read_panel(spark, str(tmp_path / f"panel.{kind}"), kind), 1, fixed_effects=["unit"]).coef_ for kind in ("csv", "parquet")]
    for coef in read:
        np.testing.assert_allclose(coef, fit(GAPPED, 1, fixed_effects=["unit"]).coef_, rtol=1e-12)


def test_progress_and_warning(spark):
    seen = []
    with pytest.warns(FewClustersWarning):
        fit(GAPPED, 1, options={"covariance": "cluster"}, fixed_effects=["unit"], cluster="unit", progress_callback=seen.append)
    assert [e.stage for e in seen][:2] == ["validate specification", "prepare panel"] and seen[-1].stage == "assemble results"


def test_t_critical_values(spark):
    model = fit(GAPPED, 0, options={"covariance": "cluster", "few_cluster_threshold": None}, fixed_effects=["unit"], cluster="unit")
    assert model.critical_values_[0] == pytest.approx(2.093024054408263, rel=1e-12)


@pytest.mark.parametrize("covariance", ["cluster", "hac"])
def test_horizon_batches_agree(spark, covariance):
    more = {"cluster": ["unit", "time"]} if covariance == "cluster" else {}
    whole = fit(GAPPED, 3, options={"covariance": covariance}, fixed_effects=["unit", "time"], **more)
    least = fit(GAPPED, 3, options={"covariance": covariance, "memory_budget": "1GB"}, fixed_effects=["unit", "time"], **more).memory_diagnostics_["minimum_bytes"]
    small = fit(GAPPED, 3, options={"covariance": covariance, "memory_budget": least}, fixed_effects=["unit", "time"], **more)
    assert (small.memory_diagnostics_["batch_size"], small.demeaning_diagnostics_["batch_size"], whole.demeaning_diagnostics_["batch_size"]) == (1, 1, 4)
    assert small.memory_diagnostics_["planned_peak_bytes"] == least
    np.testing.assert_allclose(small.coef_, whole.coef_, rtol=1e-10)
    np.testing.assert_allclose(small.stderr_, whole.stderr_, rtol=1e-10)
    assert small.residuals_frame(3).count() == whole.n_obs_
    with pytest.raises(ValueError, match="memory_budget"):
        fit(GAPPED, 3, options={"memory_budget": 100})


def test_bandwidth_is_reported(spark):
    model = fit(GAPPED, 1, options={"covariance": "hac", "hac_lags": 10**9}, fixed_effects=["unit"])
    assert model.covariance_diagnostics_[0]["bandwidth"] == 10**9
