"""Panel local projections: one fit, horizons 0..H."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impulsar.functions.dist import normal_isf, student_isf
from impulsar.functions.lag_weights import default_bandwidth
from impulsar.operators import covariance as cov
from impulsar.operators.absorb import BLOCK_VALUES, factor, make_plan, strategy
from impulsar.operators.align import lead, outcomes, row_marks, unit_window, with_masks
from impulsar.operators.ranks import Rank, effect_rank, nested
from impulsar.operators.sample import mask_groups, prune_singletons, survey
from impulsar.plans.options import Options, cluster_terms, lag_grid, lag_numbers
from impulsar.plans.terms import MAX_LEVELS, as_effects, as_terms, plan_terms, sources
from impulsar.progress import ProgressEvent, Reporter
from impulsar.sources.panel import key, name, prepare, to_spark

EPS = float(np.finfo(np.float64).eps)
MAX_BATCH = 32
#: Rows that a task holds at least, whatever the memory budget.
LEAST_ROWS = 64


class FewClustersWarning(UserWarning):
    """A cluster term has few clusters."""


def _finite(value, what: str):
    if not np.isfinite(value).all():
        raise ValueError(f"numerical range exceeded while computing {what}")
    return value


def signal_floor(n: int, effects: int, largest_group: int, iterative: bool, tol: float) -> float:
    """Relative norm below which what absorption leaves of a column is rounding."""
    if not effects:
        return 0.0
    length = n if effects >= 2 else largest_group
    share = length * EPS / (1 - length * EPS) * (effects + 1) + (10 * tol if iterative else 0.0)
    return share * math.sqrt(n)


class LocalProjection:
    """Estimator of impulse responses; see :class:`impulsar.plans.options.Options` for the settings."""

    def __init__(self, *, horizons: int, **settings):
        self.options = Options(horizons, **settings)
        for field in self.options.__dataclass_fields__:
            setattr(self, field, getattr(self.options, field))

    # Fitting

    def fit(self, data, *, column_names=None, outcome: str, shock, controls=(), outcome_lags=0, shock_lags=0, control_lags=0, unit: str, time: str, fixed_effects=(), cluster=None, progress: bool = False, progress_callback: Callable[[ProgressEvent], None] | None = None) -> LocalProjection:
        """Fit on a Spark DataFrame, a pandas DataFrame, or an array with ``column_names``.

        A lag count gives lags 1..count, a sequence its own grid, a mapping one
        of these for each column.  Leads and lags match exact periods within a
        unit; rows without every lag are no anchors but remain future outcomes.
        """
        if not isinstance(progress, bool):
            raise ValueError("progress must be a boolean")
        if progress_callback is not None and not callable(progress_callback):
            raise ValueError("progress_callback must be callable or None")
        with Reporter(progress, progress_callback) as reporter:
            held: list[DataFrame] = []
            try:
                result = self._fit(data, column_names, outcome, shock, controls, outcome_lags, shock_lags, control_lags, unit, time, fixed_effects, cluster, reporter, held)
            except BaseException:
                for df in held:
                    df.unpersist()
                raise
        for df in getattr(self, "_held", []):
            df.unpersist()
        self.__dict__.update(result, _held=held)
        return self

    def _fit(self, data, column_names, outcome, shock, controls, outcome_lags, shock_lags, control_lags, unit, time, fixed_effects, cluster, reporter, held):
        o = self.options
        reporter.update("validate specification")
        shocks, controls, effects, clusters = as_terms(shock, "shock"), as_terms(controls, "controls"), as_effects(fixed_effects), cluster_terms(cluster)
        if not shocks:
            raise ValueError("shock must be a column name or a non-empty sequence of column names")
        if effects and o.covariance in ("hc2", "hc3"):
            raise ValueError("HC2 and HC3 are not supported with fixed effects; use covariance='hc0' or covariance='hc1'")
        if o.covariance == "cluster" and not clusters:
            raise ValueError("cluster must be supplied when covariance='cluster'")
        if clusters and o.covariance != "cluster":
            raise ValueError("cluster is only valid when covariance='cluster'")
        plain = [t for t in (*shocks, *controls) if isinstance(t, str)]
        if len(set(plain)) < len(plain):
            raise ValueError("shock and controls must not contain duplicate columns")
        for label, setting in (("outcome_lags", outcome_lags), ("shock_lags", shock_lags), ("control_lags", control_lags)):
            for value in setting.values() if hasattr(setting, "values") and label != "outcome_lags" else (setting,):
                lag_numbers(value, label)
        numeric, categories = sources((*shocks, *controls))
        numeric = list(dict.fromkeys([outcome, *numeric]))
        wanted = [unit, time, *categories, *[k for e in effects for k in e], *[k for c in clusters for k in c]]

        df = to_spark(data, column_names)
        spark = df.sparkSession
        reporter.context = spark.sparkContext
        self._memory(len(shocks) + len(controls))  # too small a budget fails before the panel is read

        reporter.update("prepare panel")
        keys = [c for c in dict.fromkeys(wanted) if c != time or any(time in e for e in (*effects, *clusters, tuple(categories)))]
        panel = prepare(df, required=[*numeric, *wanted, time], numeric=numeric, time=time)
        if panel.first_time + panel.span + o.horizons > 2**63 - 1:
            raise ValueError("time plus requested horizons exceeds the int64 range")
        frame = panel.frame
        # A key that is also a number keeps its own type; so does the clock where it is a key.
        both = [c for c in keys if c in numeric]
        if both or time in keys:
            frame = self._keys_too(df, panel, [*both], time, numeric)

        reporter.update("generate terms and lags")
        levels = {t.by.column: self._levels(frame, t.by, unit) for t in shocks if getattr(t, "by", None) is not None and not isinstance(t.by, str)}
        plan = plan_terms(shocks, controls, set(df.columns), levels)
        number = lambda c: F.col(f"`__v_{c}`")
        values = {outcome: number(outcome)} | {n: t.column(number) for n, t in plan.terms.items()}
        lags = [
            *lag_grid(outcome_lags, {outcome: (outcome,)}, "outcome_lags"),
            *lag_grid(shock_lags, {f.name: f.basis for f in plan.families}, "shock_lags"),
            *lag_grid(control_lags, {k: (v,) for k, v in plan.control_names.items()}, "control_lags"),
        ]
        lags = list(dict.fromkeys(lags))
        lag_names = [f"{source}_lag{n}" for source, n in lags]
        if clash := [x for x in lag_names if x in df.columns or x in plan.terms]:
            raise ValueError(f"lag names conflict with columns: {clash}")
        features = [*([] if effects else ["Intercept"]), *plan.terms, *lag_names]
        batch, block_rows, memory = self._memory(len(features))

        reporter.update("align outcomes and select samples")
        level_of = [(family, i) for family in plan.families if family.kind == "categorical" for i in range(len(family.levels))]
        window = unit_window(name(unit))
        frame = frame.withColumns({f"__x_{n}": v for n, v in values.items()})
        columns = [F.col(f"`__x_{n}`") for n in plan.terms] + [lead(F.col(f"`__x_{s}`"), -n, window, panel.span) for s, n in lags]
        if not effects:
            columns = [F.lit(1.0), *columns]
        xs, ys = [f"__c{i}" for i in range(len(features))], [f"__y{h}" for h in range(o.horizons + 1)]
        groups = [("__u", (unit,)), *[(f"__f{i}", e) for i, e in enumerate(effects)], *[(f"__g{i}", c) for i, c in enumerate(clusters)]]
        aligned = frame.select(
            *[key(columns_).alias(alias) for alias, columns_ in groups], "__t",
            *[(F.col(name(family.moderator)) == F.lit(family.levels[i])).alias(f"__s{j}") for j, (family, i) in enumerate(level_of)],
            *[c.alias(x) for c, x in zip(columns, xs, strict=True)],
            *[c.alias(y) for c, y in zip(outcomes(F.col(f"`__x_{outcome}`"), o.horizons, window, panel.span, o.response), ys, strict=True)],
            *[c.alias(n) for n, c in row_marks(window).items()],
        )
        valid = F.lit(True)
        for x in xs[len(features) - len(lags) :] if lags else []:
            valid = valid & F.col(x).isNotNull()
        aligned = with_masks(aligned, ys, valid, o.sample).persist(StorageLevel.MEMORY_AND_DISK)
        held.append(aligned)
        effect_keys, dropped, rounds = [f"__f{i}" for i in range(len(effects))], {}, {}

        if o.sample == "common":
            samples = [(list(range(o.horizons + 1)), aligned.where("__m0"))]
        else:
            found, _ = mask_groups(aligned, "__u", o.horizons)
            samples = [(hs, aligned.where(f"__m{hs[0]}")) for hs in found]
        n_h = o.horizons + 1
        k_all = len(features)
        out = {"coef": np.full((n_h, k_all), np.nan), "se": np.full((n_h, k_all), np.nan), "cov": np.full((n_h, k_all, k_all), np.nan)}
        ranks, corrections, dfs, nobs = (np.zeros(n_h, dtype=int) for _ in range(4))
        dfs = np.full(n_h, np.inf)
        kept_all, diagnostics, absorbed, support, warned, fits, group_of, cov_diagnostics = None, [], [], {f.name: {v: {} for v in f.levels} for f in plan.families if f.kind == "categorical"}, set(), [], np.zeros(n_h, dtype=int), [None] * n_h
        shown, methods, fit_of, n_units, n_periods, gaps = {}, [], {}, 0, 0, False

        for number_, (horizons, rows) in enumerate(samples):
            reporter.update("factorize fixed effects", number_, len(samples), f"horizons {horizons[0]}..{horizons[-1]}")
            gone = turns = 0
            order = {e: ("__u" if effects[i] == (unit,) else e) for i, e in enumerate(effect_keys)}
            cluster_keys = [("__u" if c == (unit,) else f"__g{i}") for i, c in enumerate(clusters)]
            keys = [*order.values(), *cluster_keys, "__u", "__t"]
            zs = [*xs, *[ys[h] for h in horizons]]
            aggregates = lambda mask: (
                {"n": f"count_if({mask})"}
                | {f"{label}{c}": f"{f}(if({mask}, {c}, null))" for c in zs for label, f in (("a", "avg"), ("l", "min"), ("h", "max"))}
                | {f"s{j}": f"count_if({mask} and __s{j})" for j in range(len(level_of))}
                | {f"z{j}": f"count_if({mask} and {xs[features.index(family.basis[i])]} != 0)" for j, (family, i) in enumerate(level_of)}
            )
            mask = f"__m{horizons[0]}"
            sizes_of, stats = survey(aligned, mask, keys, aggregates(mask) | {"again": "max(int(__again))", "gaps": "max(int(__gap))"})
            if stats["again"]:
                raise ValueError("unit and time must identify each row; duplicate keys found")
            n_units, n_periods, gaps = sizes_of["__u"][3], sizes_of["__t"][3], bool(stats["gaps"])
            rows = rows.drop(*[f"__m{h}" for h in range(n_h)], "__first", "__again", "__gap")
            if o.singleton_policy == "drop" and any(sizes_of[e][1] == 1 for e in order.values()):
                rows, gone, turns = prune_singletons(rows, list(order.values()))
                sizes_of, stats = survey(rows, "true", keys, aggregates("true"))
                if any(e == (unit,) for e in effects):
                    rows = rows.repartition("__u").sortWithinPartitions("__u", "__t")
            for h in horizons:
                dropped[h], rounds[h], group_of[h] = gone, turns, number_
            if gone:
                rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
                held.append(rows)
            n = int(stats["n"])
            if not n:
                raise ValueError(f"no valid observations at horizon {horizons[0]}")
            _finite(np.array([stats[f"{e}{y}"] for y in zs[k_all:] for e in "lh"]), "regression outcomes")
            for j, (family, i) in enumerate(level_of):
                for h in horizons:
                    support[family.name][family.levels[i]][h] = {"n_obs": int(stats[f"s{j}"]), "nonzero_shock_n_obs": int(stats[f"z{j}"])}
            mean = np.array([stats[f"a{c}"] for c in zs])
            scale = np.array([max(stats[f"h{c}"] - stats[f"a{c}"], stats[f"a{c}"] - stats[f"l{c}"]) for c in zs])
            if not effects:
                scale = np.array([max(abs(stats[f"h{c}"]), abs(stats[f"l{c}"])) for c in zs])
            scale = np.where((scale > 0) & np.isfinite(scale), scale, 1.0)
            counts = [sizes_of[e][0] for e in order.values()]

            iterated = bool(effects) and strategy(list(order.values()), counts, "__u") is None
            rank = self._rank(rows, list(order.values()), counts, None) if iterated else None  # over its budget it refuses before anything is absorbed
            for at in range(0, len(horizons), batch):
                some = horizons[at : at + batch]
                now = np.r_[0:k_all, k_all + at : k_all + at + len(some)]
                reporter.update("absorb regressors", message=f"{k_all} columns")
                laid, how, schur = make_plan(rows, [zs[i] for i in now], list(order.values()), counts, unit="__u", center=mean[now], scale=scale[now], tol=o.demean_tol, max_iter=o.max_iter, acceleration=o.demean_acceleration, block_rows=block_rows(k_all, len(some)))
                if laid is not rows:
                    held.append(laid)
                rank = rank or self._rank(rows, list(order.values()), counts, schur)
                _, _, r = factor(laid, how)
                norms = np.sqrt((r[:, :k_all] ** 2).sum(axis=0))
                largest = max((sizes_of[e][2] for e in order.values()), default=n)
                floor = signal_floor(n, len(effects), largest, how.iterative, o.demean_tol)
                weak = ~np.isfinite(norms) | (norms == 0) | (norms <= floor)
                if bad := [features[i] for i in np.flatnonzero(weak) if features[i] not in plan.nuisance]:
                    raise ValueError(f"residualized design has zero or negligible within variation at horizon {horizons[0]} for columns {bad}")
                kept = np.flatnonzero(~weak)
                if kept_all is not None and not np.array_equal(kept, kept_all):
                    raise ValueError("generated lower-order terms are absorbed differently across horizons; use a common sample or revise the specification")
                kept_all = kept
                k = len(kept)
                model_rank = k + rank.rank
                if n <= model_rank:
                    note = "" if rank.exact else " under the conservative rank bound"
                    raise ValueError(f"residual degrees of freedom must be positive{note} at horizon {horizons[0]} (n={n}, model rank={model_rank})")

                if at == 0:
                    absorbed += [{"term": features[i], "horizons": tuple(horizons), "reason": "absorbed by fixed effects or zero within variation"} for i in np.flatnonzero(weak)]
                    correction, correction_rank, nested_effects, labels = model_rank, rank, (), ["#".join(c) for c in clusters]
                    if o.covariance == "cluster":
                        correction, nested_effects, correction_rank = self._parameters(rows, list(order.values()), counts, effects, clusters, cluster_keys, k, rank)
                        if o.cluster_correction == "cr1" and n <= correction:
                            raise ValueError("cluster correction requires positive degrees of freedom under the selected parameter-count policy")
                        sizes = [sizes_of[g][0] for g in cluster_keys]
                        for label, g in zip(labels, sizes, strict=True):
                            if g < 2:
                                raise ValueError(f"cluster term {label!r} requires at least two clusters")
                            if o.few_cluster_threshold is not None and g < o.few_cluster_threshold and label not in warned:
                                warnings.warn(f"cluster term {label!r} has only {g} clusters; cluster-robust inference may be unreliable, and CR1 does not remove the problem", FewClustersWarning, stacklevel=4)
                                warned.add(label)
                        if o.cluster_inference == "t":
                            dfs[horizons] = min(sizes) - 1
                    ranks[horizons], corrections[horizons], nobs[horizons] = model_rank, correction, n

                reporter.update("prepare solver", message=f"{k} retained columns")
                rx = np.linalg.qr(r[:, [*kept, *range(k_all, len(now))]], mode="r")
                rx = rx * np.where(np.diag(rx) < 0, -1.0, 1.0)[:, None]
                rxx, rxy, ryy = rx[:k, :k], rx[:k, k:], rx[k:, k:]
                unit_columns = rxx / np.sqrt((rxx**2).sum(axis=0))
                singular = np.linalg.svd(unit_columns, compute_uv=False)
                if singular[-1] <= EPS * max(n, k) * singular[0]:
                    raise ValueError(f"residualized design is numerically rank deficient at horizon {some[0]}: rank {int((singular > EPS * max(n, k) * singular[0]).sum())} of {k}")
                condition = float((singular[0] / singular[-1]) ** 2)
                beta = _finite(np.linalg.solve(rxx, rxy), "coefficients")
                squares = (ryy**2).sum(axis=0)
                fit = cov.Fit(kept, k_all, rxx, beta)

                reporter.update("estimate horizon batch", at, len(horizons), f"horizons {some[0]}..{some[-1]}")
                reporter.update("calculate covariance", message=f"horizons {some[0]}..{some[-1]}")
                meats, note, spread = self._meats(laid, how, fit, some, squares, n, model_rank, correction, cluster_keys, labels, sizes_of["__t"][0], k)
                reporter.update("estimate horizon batch", at + len(some), len(horizons))
                inverse = np.linalg.inv(rxx)
                v = inverse @ meats @ inverse.T
                v = _finite((v + v.transpose(0, 2, 1)) / 2, "normalized covariance")
                diagonal = np.diagonal(v, axis1=1, axis2=2)
                share = (2 * n + 4 * k) * EPS
                rough = np.abs(np.diagonal(inverse @ spread @ inverse.T, axis1=1, axis2=2)) if spread is not None else np.abs(v).max(axis=(1, 2))[:, None]
                if (where := np.argwhere(diagonal < -share / (1 - share) * rough)).size:
                    raise ValueError(f"{o.covariance} covariance has a negative variance at horizon {some[where[0][0]]}, feature {where[0][1]}")
                for j, h in enumerate(some):
                    zero = tuple(np.flatnonzero(diagonal[j] < 0).tolist())
                    v[j][list(zero), list(zero)] = 0.0
                    cov_diagnostics[h] = note(j) | {"negative_variance_cleanup": zero}
                # Back to the units of the input.
                sx, sy = scale[kept], scale[now][k_all:]
                b = _finite(beta * sy[None, :] / sx[:, None], "coefficients")
                v = _finite(v * (sy**2)[:, None, None] / np.outer(sx, sx)[None], "covariance in original units")
                for j, h in enumerate(some):
                    out["coef"][h, kept], out["se"][h, kept] = b[:, j], np.sqrt(np.diagonal(v[j]))
                    out["cov"][h][np.ix_(kept, kept)] = v[j]
                if at == 0:
                    diagnostics.append({"horizons": tuple(horizons), "n_obs": n, "absorbed_rank": rank.rank, "model_rank": model_rank, "df_resid": n - model_rank, "exact": rank.exact, "method": rank.method, "correction_rank": correction, "correction_rank_exact": correction_rank.exact, "correction_rank_method": correction_rank.method, "nested_effects": tuple(nested_effects)})
                    shown[number_] = {"solver": "scaled_qr", "condition": condition, "within_signal_floor": floor, "normalized_within_norms": norms[kept], "factor": "tsqr"}
                    methods.append(how)
                for h in some:
                    fit_of[h] = len(fits)
                fits.append((laid, how, fit, some, sy))

        reporter.update("assemble results")
        coef, se, v = out["coef"][:, kept_all], out["se"][:, kept_all], out["cov"][:, kept_all][:, :, kept_all]
        critical = np.array([normal_isf(o.alpha / 2) if np.isinf(d) else student_isf(o.alpha / 2, d) for d in dfs])
        ci = _finite(np.stack([coef - critical[:, None] * se, coef + critical[:, None] * se], axis=-1), "confidence intervals")
        return {
            "coef_": coef, "stderr_": se, "covariance_": v, "conf_int_": ci, "horizons_": np.arange(n_h),
            "feature_names_in_": np.asarray([features[i] for i in kept_all], dtype=object), "shock_names_in_": np.asarray([f.name for f in plan.families], dtype=object),
            "shock_families_": tuple(plan.families), "shock_support_": support, "absorbed_terms_": tuple(absorbed), "sample_": o.sample, "response_": o.response,
            "n_obs_by_horizon_": nobs, "model_rank_by_horizon_": ranks, "df_resid_by_horizon_": nobs - ranks, "correction_rank_by_horizon_": corrections,
            "inference_df_by_horizon_": dfs, "critical_values_": critical, "n_obs_": int(nobs.max()), "n_units_": n_units, "n_periods_": n_periods,
            "degrees_of_freedom_diagnostics_": {"policy": o.fe_dof, "by_cache_group": tuple(diagnostics)},
            "memory_diagnostics_": memory,
            "cache_group_by_horizon_": group_of, "covariance_diagnostics_": tuple(cov_diagnostics),
            "covariance_config_": {"kind": o.covariance, "cluster_terms": tuple("#".join(c) for c in clusters)} | {x: getattr(o, x) if o.covariance == "cluster" else None for x in ("cluster_correction", "cluster_df", "cluster_group_adjustment", "cluster_inference", "few_cluster_threshold")} | {x: getattr(o, x) if o.covariance in ("hac", "driscoll_kraay") else None for x in ("hac_lags", "hac_kernel", "hac_debias")},
            "singleton_diagnostics_": {"policy": o.singleton_policy, "dropped_by_horizon": np.array([dropped[h] for h in range(n_h)]), "rounds_by_horizon": np.array([rounds[h] for h in range(n_h)])},
            "linear_algebra_diagnostics_": {"solver": "scaled_qr", "by_cache_group": tuple(shown.values())},
            "demeaning_diagnostics_": {"method": methods[0].method, "method_by_cache_group": tuple(m.method for m in methods), "iterations_by_cache_group": tuple(m.iterations for m in methods), "acceleration_accepted_by_cache_group": tuple(m.accepted for m in methods), "backend": "spark", "cache_mode": "shared_design" if len(samples) == 1 else "mask_grouped", "acceleration": o.demean_acceleration, "consecutive_clock": not gaps, "batch_size": batch},
            "_fits": fits, "_fit_of": fit_of, "_unit": unit, "_time": time, "_first_time": panel.first_time, "_irfplot": None, "_spark": spark,
        }

    @staticmethod
    def _keys_too(df, panel, both, time, numeric):
        """Rows again with keys that are also numbers, or the clock itself, in their own types."""
        from impulsar.sources.panel import clock, number

        numbers = [number(df, c).alias(f"__v_{c}") for c in numeric]
        rest = [c for c in panel.frame.columns if not c.startswith("__") and c not in both and c != time]
        return df.select((clock(df, time) - F.lit(panel.first_time)).alias("__t"), *[F.col(name(c)) for c in rest], *[F.col(name(c)) for c in both if c != time], clock(df, time).alias(time), *numbers)

    @staticmethod
    def _levels(frame: DataFrame, category, unit: str) -> tuple:
        """Observed levels in order of their first (unit, time); declared levels must be the same set."""
        rows = frame.groupBy(name(category.column)).agg(F.min(F.struct(F.col(name(unit)).alias("u"), F.col("__t").alias("t"))).alias("first")).limit(MAX_LEVELS + 1).collect()
        observed = [r[0] for r in sorted(rows, key=lambda r: tuple(r["first"]))]
        if len(observed) > MAX_LEVELS:
            raise ValueError(f"{category.column!r} has more than {MAX_LEVELS} levels; group them before fitting")
        if category.levels is None:
            return tuple(observed)
        if set(observed) != set(category.levels):
            raise ValueError(f"declared levels for {category.column!r} must match its observed levels")
        return category.levels

    def _memory(self, k: int):
        """(horizons in a batch, rows in a task's block by regressors and horizons, what the plan says) under the budget.

        Planned are a task's arrays: ``width`` numbers a row (columns and scores,
        with what is made of them) and the meats.  A unit's rows stay together,
        so a unit longer than a block adds to it.
        """
        k, most, budget = k + 1, min(MAX_BATCH, self.options.horizons + 1), self.options.memory_budget
        width = lambda k, h: k + h + k * h
        need = lambda h, rows: 24 * (width(k, h) * rows + k * k * (h + 1))
        if budget is None:
            return most, lambda k, h: max(LEAST_ROWS, BLOCK_VALUES // width(k, h)), {"budget_bytes": None, "scope": "unbudgeted"}
        if need(1, LEAST_ROWS) > budget:
            raise ValueError(f"memory_budget={budget} bytes is below the planned minimum of {need(1, LEAST_ROWS)} bytes; increase memory_budget or reduce horizons or features")
        batch = max(h for h in range(1, most + 1) if need(h, LEAST_ROWS) <= budget)
        rows = min(max(LEAST_ROWS, BLOCK_VALUES // width(k, batch)), (budget - need(batch, 0)) // (24 * width(k, batch)))
        return batch, lambda k, h: rows, {"budget_bytes": budget, "scope": "task arrays", "minimum_bytes": need(1, LEAST_ROWS), "planned_peak_bytes": need(batch, rows), "batch_size": batch, "block_rows": rows}

    def _rank(self, rows, keys, counts, schur) -> Rank:
        if schur is not None and (self.options.fe_dof == "exact" or len(keys) < 3):
            return Rank(schur[0] + schur[1], True, "components" if len(keys) == 2 else "schur")
        return effect_rank(rows, keys, counts, self.options.fe_dof)

    def _parameters(self, rows, keys, counts, effects, clusters, cluster_keys, k, full):
        """(parameters a cluster correction counts, effects left out as nested, rank of the others)."""
        policy = self.options.cluster_df
        if policy == "full" or policy == "nonnested" and not effects:
            return k + full.rank, (), full
        if policy == "none":
            return k, (), Rank(0, True, "none")
        inside = [i for i, e in enumerate(effects) if any(set(c) <= set(e) for c in clusters) or any(nested(rows, keys[i], g) for c, g in zip(clusters, cluster_keys, strict=True) if not set(c) <= set(e))]
        rest = [i for i in range(len(effects)) if i not in inside]
        rank = full if not inside else effect_rank(rows, [keys[i] for i in rest], [counts[i] for i in rest], self.options.fe_dof) if rest else Rank(1, True, "intercept")
        label = lambda e: e[0] if len(e) == 1 else e
        return k + rank.rank, tuple(label(effects[i]) for i in inside), rank

    def _meats(self, df, plan, fit, horizons, squares, n, model_rank, correction, cluster_keys, labels, periods, k):
        """(meats in the orthonormal basis, diagnostics by position, absolute component sum or None)."""
        o, m = self.options, len(horizons)
        if o.covariance == "homoskedastic":
            return np.eye(k)[None] * (squares / (n - model_rank))[:, None, None], lambda j: {"kind": "homoskedastic"}, None
        if o.covariance.startswith("hc"):
            meat = cov.robust(df, plan, fit, o.covariance)
            return meat * (n / (n - model_rank) if o.covariance == "hc1" else 1.0), lambda j: {"kind": o.covariance}, None
        if o.covariance == "cluster":
            subsets, parts, sizes = cov.clustered(df, plan, fit, cluster_keys, (k, m), max(1, df.sparkSession.sparkContext.defaultParallelism))
            least = min(size for s, size in zip(subsets, sizes, strict=True) if len(s) == 1)
            total, spread, notes = np.zeros((m, k, k)), np.zeros((m, k, k)), []
            for subset, part, size in zip(subsets, parts, sizes, strict=True):
                if size < 2:
                    raise ValueError(f"cluster intersection {'#'.join(labels[i] for i in subset)!r} requires at least two clusters")
                used = least if o.cluster_group_adjustment == "min" else size
                if o.cluster_correction == "cr1":
                    part = part * (used / (used - 1) * (n - 1) / (n - correction))
                sign = 1 if len(subset) % 2 else -1
                total, spread = total + sign * part, spread + np.abs(part)
                notes.append({"terms": tuple(labels[i] for i in subset), "n_clusters": size, "sign": sign, "adjustment_clusters": used if o.cluster_correction == "cr1" else None})
            note = {"kind": "cluster", "correction": o.cluster_correction, "correction_rank": correction, "parameter_count": o.cluster_df, "group_adjustment": o.cluster_group_adjustment, "components": tuple(notes)}
            return total, lambda j: dict(note), spread
        widths = [o.hac_lags if o.hac_lags is not None else default_bandwidth(periods, h) for h in horizons]
        if o.covariance == "hac":
            meat = cov.hac(df, plan, fit, "__u", o.hac_kernel, widths)
        else:
            meat = cov.driscoll_kraay(df, plan, fit, o.hac_kernel, widths, k)
        meat = meat * (n / (n - model_rank) if o.hac_debias else 1.0)
        return meat, lambda j: {"kind": o.covariance, "kernel": o.hac_kernel, "bandwidth": widths[j], "debias": o.hac_debias}, None

    # Results

    def _need_fit(self) -> None:
        if not hasattr(self, "coef_"):
            raise RuntimeError("the estimator is not fitted")

    def to_frame(self) -> pd.DataFrame:
        """Coefficient paths in tidy long form."""
        self._need_fit()
        rows = [
            (int(h), self.sample_, self.response_, int(self.n_obs_by_horizon_[h]), f, self.coef_[h, j], self.stderr_[h, j], *self.conf_int_[h, j])
            for h in self.horizons_ for j, f in enumerate(self.feature_names_in_)
        ]
        return pd.DataFrame(rows, columns=["horizon", "sample", "response", "n_obs", "coefficient", "estimate", "std_error", "ci_low", "ci_high"])

    def to_spark(self) -> DataFrame:
        self._need_fit()
        rows = [tuple(float(x) if isinstance(x, np.floating) else int(x) if isinstance(x, np.integer) else x for x in r) for r in self.to_frame().itertuples(index=False, name=None)]
        return self._spark.createDataFrame(rows, "horizon long, sample string, response string, n_obs long, coefficient string, estimate double, std_error double, ci_low double, ci_high double")

    def irf_frame(self, shock: str | None = None, *, at=None, levels=None) -> pd.DataFrame:
        """Response paths of a shock: at values of a moderator, by level, or plain."""
        self._need_fit()
        by_name = {f.name: f for f in self.shock_families_}
        shock = self.shock_families_[0].name if shock is None else shock
        if shock not in by_name:
            raise ValueError(f"shock {shock!r} is not fitted; choose one of {list(by_name)}")
        family, names = by_name[shock], list(self.feature_names_in_)
        if levels is not None and family.kind != "categorical":
            raise ValueError("levels is only valid for categorical shocks")
        if at is not None and family.kind != "continuous":
            raise ValueError("at is only valid for continuous moderated shocks")
        if family.kind == "continuous":
            if at is None or not len(at):
                raise ValueError("continuous moderated shocks require at=[...] values")
            paths = [(None, float(x), {family.basis[0]: 1.0, family.basis[1]: float(x)}) for x in at]
            if not all(math.isfinite(p[1]) for p in paths):
                raise ValueError("at values must be finite")
        elif family.kind == "categorical":
            if levels is not None and (unknown := set(levels) - set(family.levels)):
                raise ValueError(f"unknown shock levels: {sorted(unknown, key=str)}")
            paths = [(v, None, {b: 1.0}) for v, b in zip(family.levels, family.basis, strict=True) if levels is None or v in levels]
            if not paths:
                raise ValueError("levels must select at least one fitted category")
        else:
            paths = [(None, None, {family.basis[0]: 1.0})]
        rows = []
        for level, value, weight in paths:
            c = np.zeros(len(names))
            for n, w in weight.items():
                c[names.index(n)] = w
            variance = np.einsum("i,hij,j->h", c, self.covariance_, c)
            if (variance < -100 * EPS * np.abs(self.covariance_).max(axis=(1, 2)) * np.abs(c).sum() ** 2).any():
                raise ValueError("shock contrast has a materially negative variance")
            for h, estimate, se in zip(self.horizons_, self.coef_ @ c, np.sqrt(np.maximum(variance, 0.0)), strict=True):
                half = self.critical_values_[h] * se
                seen = self.shock_support_[family.name][level][int(h)] if level is not None else {}
                rows.append((int(h), family.name, level, value, int(self.n_obs_by_horizon_[h]), seen.get("n_obs"), seen.get("nonzero_shock_n_obs"), estimate, se, estimate - half, estimate + half))
        return pd.DataFrame(rows, columns=["horizon", "shock", "level", "at", "n_obs", "level_n_obs", "nonzero_shock_n_obs", "estimate", "std_error", "ci_low", "ci_high"])

    def residuals_frame(self, horizon: int) -> DataFrame:
        """(unit, time, residual) of a horizon's anchors, lazily."""
        self._need_fit()
        if not self.options.retain_residuals:
            raise ValueError("residuals were not retained")
        laid, plan, fit, horizons, scale = self._fits[self._fit_of[horizon]]
        at = horizons.index(horizon)
        rows = cov.residual_frame(laid, plan, fit, "__u", horizons)
        return rows.select(F.col("__u").alias(self._unit), (F.col("__t") + F.lit(self._first_time)).alias(self._time), (F.col(f"residual_{horizon}") * float(scale[at])).alias("residual"))

    def sample_frame(self, horizon: int) -> DataFrame:
        """(unit, time) of a horizon's anchors."""
        self._need_fit()
        laid = self._fits[self._fit_of[horizon]][0]
        return laid.select(F.col("__u").alias(self._unit), (F.col("__t") + F.lit(self._first_time)).alias(self._time))

    def plot_irf(self, coefficient: str | None = None, **style):
        from impulsar.plotting import plot_irf

        self._need_fit()
        return plot_irf(self, coefficient, **style)

    @property
    def irfplot(self):
        """Default axes, made once."""
        self._need_fit()
        if self._irfplot is None:
            self._irfplot = self.plot_irf()
        return self._irfplot

    def summary(self) -> str:
        self._need_fit()
        return f"LocalProjection(horizons=0..{self.horizons}, response={self.response_!r}, sample={self.sample_!r}, n_obs={self.n_obs_}, covariance={self.covariance}, backend={self.demeaning_diagnostics_['backend']})"
