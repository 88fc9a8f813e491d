"""Named queries over the driver's tables, one or more for each operator, and their SQL."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impulsar.estimator import FewClustersWarning, LocalProjection
from impulsar.functions.lag_weights import default_bandwidth
from impulsar.operators.absorb import make_plan, residual_rows
from impulsar.operators.absorb import blocks as blocks_of
from impulsar.operators.align import cumulative, lead, outcomes, row_marks, unit_window, with_masks
from impulsar.operators.ranks import effect_rank, nested
from impulsar.operators.sample import mask_groups, prune_singletons
from impulsar.plans.oracle import cumulative_sql, lead_sql, lp_sql, panel_sql, partial_sql
from impulsar.plans.terms import C, fe, interact
from impulsar.sources.panel import Panel, clock, prepare

DIGITS = 5
TABLES = {"sup": ("lineitem", "supplier", "nation"), "evt": ("events",), "usr": ("events",), "sec": ("events",), "reg": ("lineitem", "supplier", "nation"), "cus": ("orders",)}
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def panel(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for table in TABLES[name]:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(panel_sql(name).replace("datediff('day', DATE '2024-01-01', CAST(ts AS DATE))", "datediff(CAST(ts AS DATE), DATE '2024-01-01')"))


def checked(df: DataFrame) -> Panel:
    extra = [c for c in df.columns if c not in ("unit", "time", "y", "x1", "x2")]
    return prepare(df, required=["unit", "time", "y", "x1", "x2", *extra], numeric=["y", "x1", "x2"], time="time")


def aligned(df: DataFrame, horizons: int, *, response: str = "level", sample: str = "common", lags=()) -> tuple[Panel, DataFrame]:
    p = checked(df)
    w = unit_window("unit")
    named = [lead(F.col(f"__v_{c}"), -n, w, p.span).alias(f"{c}_lag{n}") for c, n in lags]
    rows = p.frame.select("*", *[c.alias(f"__y{h}") for h, c in enumerate(outcomes(F.col("__v_y"), horizons, w, p.span, response))], *named, *[c.alias(n) for n, c in row_marks(w).items()])
    valid = F.lit(True)
    for c, n in lags:
        valid = valid & F.col(f"{c}_lag{n}").isNotNull()
    return p, with_masks(rows, [f"__y{h}" for h in range(horizons + 1)], valid, sample)


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return keep


def rounded(column):
    return F.round(column, DIGITS) + F.lit(0.0)


def one_row(spark: SparkSession, **values) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string' if isinstance(v, str) else 'long'}" for k, v in values.items()))


# Sources, clock, alignment


@query(f"WITH p AS ({panel_sql('sup')}) SELECT count(*) AS n_rows, count(DISTINCT unit) AS n_units, count(DISTINCT time) AS n_periods, count(*) - count(DISTINCT (unit, time)) AS n_repeated, CAST(max(time) - min(time) AS BIGINT) AS span FROM p")
def panel_validate_counts(spark, sf):
    p, rows = aligned(panel(spark, sf, "sup"), 0)
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("__first").cast("long")).alias("n_units"), F.count_distinct("__t").alias("n_periods"), F.sum(F.col("__again").cast("long")).alias("n_repeated"), F.lit(p.span).alias("span"))


@query(f"WITH p AS ({panel_sql('sup')}) SELECT CAST(time AS BIGINT) AS period, count(*) AS n_rows FROM p GROUP BY 1")
def clock_canonical_strings(spark, sf):
    texts = panel(spark, sf, "sup").select(F.concat(F.lit("+00"), F.col("time").cast("string")).alias("time"))
    return texts.select(clock(texts, "time").alias("period")).groupBy("period").agg(F.count(F.lit(1)).alias("n_rows"))


def _shift(name: str, steps: tuple[int, ...]):
    sql = f"WITH p AS ({panel_sql(name)}) SELECT CAST(unit AS VARCHAR) AS unit, time, " + ", ".join(f"round({lead_sql('y', s)}, {DIGITS}) + 0.0 AS {'lead' if s > 0 else 'lag'}{abs(s)}" for s in steps) + " FROM p"

    def run(spark, sf):
        p = checked(panel(spark, sf, name))
        w = unit_window("unit")
        return p.frame.select(F.col("unit").cast("string").alias("unit"), (F.col("__t") + p.first_time).alias("time"), *[rounded(lead(F.col("__v_y"), s, w, p.span)).alias(f"{'lead' if s > 0 else 'lag'}{abs(s)}") for s in steps])

    return run, sql


for _name, _panel, _steps in (("lead_exact_h", "sup", (1, 4)), ("lag_exact_l", "sup", (-1, -3)), ("lead_lag_gapped", "usr", (2, -1)), ("lead_string_unit", "evt", (1,))):
    QUERIES[_name], ORACLE_SQL[_name] = _shift(_panel, _steps)


@query(f"WITH p AS ({panel_sql('usr')}) SELECT unit, time, round({cumulative_sql('y', 2)}, {DIGITS}) + 0.0 AS sum2 FROM p")
def cumulative_response(spark, sf):
    p = checked(panel(spark, sf, "usr"))
    return p.frame.select("unit", (F.col("__t") + p.first_time).alias("time"), rounded(cumulative(F.col("__v_y"), 2, unit_window("unit"), p.span)).alias("sum2"))


_LEADS = ", ".join(f"{lead_sql('y', h)} AS y{h}" for h in range(4))


@query(f"WITH p AS ({panel_sql('sup')}), l AS (SELECT *, {_LEADS}, {lead_sql('x1', -2)} AS lagged FROM p) SELECT unit, time FROM l WHERE y0 IS NOT NULL AND y1 IS NOT NULL AND y2 IS NOT NULL AND y3 IS NOT NULL AND lagged IS NOT NULL")
def anchor_common(spark, sf):
    p, rows = aligned(panel(spark, sf, "sup"), 3, lags=[("x1", 2)])
    return rows.where("__m0").select("unit", (F.col("__t") + p.first_time).alias("time"))


@query(f"WITH p AS ({panel_sql('usr')}), l AS (SELECT *, {_LEADS} FROM p) " + " UNION ALL ".join(f"SELECT CAST({h} AS BIGINT) AS horizon, count(y{h}) AS n_obs FROM l" for h in range(4)))
def anchor_per_horizon(spark, sf):
    _, rows = aligned(panel(spark, sf, "usr"), 3, sample="per_horizon")
    wide = rows.agg(*[F.sum(F.col(f"__m{h}").cast("long")).alias(f"n{h}") for h in range(4)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(h).cast("long").alias("horizon"), F.col(f"n{h}").alias("n_obs")) for h in range(4)])).alias("r")).select("r.*")


_SPARSE = ", ".join(f"{lead_sql('y', h)} AS y{h}" for h in range(6))
_MASKS = " UNION ALL ".join(f"SELECT CAST({h} AS BIGINT) AS horizon, count(*) AS n, coalesce(bit_xor(hash(unit, time)), 0) AS x FROM l WHERE y{h} IS NOT NULL" for h in range(6))


@query(f"WITH p AS ({panel_sql('sup')}), l AS (SELECT *, {_SPARSE} FROM p WHERE time % 3 = 0), m AS ({_MASKS}), f AS (SELECT horizon, min(horizon) OVER (PARTITION BY n, x) AS first FROM m) SELECT horizon, CAST(dense_rank() OVER (ORDER BY first) - 1 AS BIGINT) AS mask_group FROM f")
def mask_groups_sparse(spark, sf):
    """Every third period only: horizons that hit no period share one (empty) sample, the others have their own."""
    _, rows = aligned(panel(spark, sf, "sup").where("time % 3 = 0"), 5, sample="per_horizon")
    groups, _ = mask_groups(rows, "unit", 5)
    return spark.createDataFrame([(h, g) for g, hs in enumerate(groups) for h in hs], "horizon long, mask_group long")


@query(f"WITH p AS ({panel_sql('evt')}) SELECT count(*) = count(DISTINCT unit) * count(DISTINCT time) AS balanced, max(gap) IS NOT NULL AND max(gap) > 1 AS has_gap FROM (SELECT *, time - lag(time) OVER (PARTITION BY unit ORDER BY time) AS gap FROM p)")
def balanced_check(spark, sf):
    _, rows = aligned(panel(spark, sf, "evt"), 0)
    return rows.agg((F.count(F.lit(1)) == F.count_distinct("unit") * F.count_distinct("__t")).alias("balanced"), F.max("__gap").alias("has_gap"))


@query(f"WITH p AS ({panel_sql('usr')}) SELECT sum(CASE WHEN gap > 1 THEN 1 ELSE 0 END) = 0 AS consecutive, CAST(sum(CASE WHEN gap > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_gaps FROM (SELECT time - lag(time) OVER (PARTITION BY unit ORDER BY time) AS gap FROM p)")
def consecutive_check(spark, sf):
    _, rows = aligned(panel(spark, sf, "usr"), 0)
    gaps = F.sum(F.col("__gap").cast("long"))
    return rows.agg((gaps == 0).alias("consecutive"), gaps.alias("n_gaps"))


def _prune_sql(rounds: int) -> str:
    parts = [f"p AS ({panel_sql('cus')})", f"r0 AS (SELECT unit, time FROM (SELECT *, {lead_sql('y', 1)} AS y1 FROM p) WHERE y1 IS NOT NULL)"]
    for i in range(rounds):
        parts.append(f"r{i + 1} AS (SELECT unit, time FROM (SELECT *, count(*) OVER (PARTITION BY unit) AS a, count(*) OVER (PARTITION BY time) AS b FROM r{i}) WHERE a > 1 AND b > 1)")
    return f"WITH {', '.join(parts)} SELECT unit, time FROM r{rounds}"


@query(_prune_sql(12))
def singleton_prune(spark, sf):
    p, rows = aligned(panel(spark, sf, "cus"), 1)
    kept, _, _ = prune_singletons(rows.where("__m0").select("unit", "__t"), ["unit", "__t"])
    return kept.select("unit", (F.col("__t") + p.first_time).alias("time"))


# Absorption and ranks


def _absorbed(spark, sf, name: str, effects: list[str], divisor: int = 1) -> DataFrame:
    import pyarrow as pa

    p = checked(panel(spark, sf, name))
    rows = p.frame.select(F.col("unit"), F.col("__t"), (F.col("__t") + p.first_time).alias("time"), *[F.col(c) for c in p.frame.columns if c in ("season", "nation", "region")], (F.col("__v_y") / divisor).alias("y"), F.col("__v_x1").alias("x1"))
    if "joint" in effects:
        rows = rows.withColumn("joint", F.to_json(F.struct("region", "time")))
    if "group" in effects:
        rows = rows.withColumn("group", F.to_json(F.struct(F.expr("unit % 20").alias("g"), "time")))
    rows = rows.repartition("unit").sortWithinPartitions("unit", "__t").persist()
    stats = rows.agg(*[F.count_distinct(e).alias(e) for e in effects], *[f(c).alias(f"{n}{c}") for c in ("y", "x1") for n, f in (("a", F.avg), ("l", F.min), ("h", F.max))]).first()
    center = np.array([stats["ay"], stats["ax1"]])
    scale = np.array([max(stats[f"h{c}"] - stats[f"a{c}"], stats[f"a{c}"] - stats[f"l{c}"]) or 1.0 for c in ("y", "x1")])
    laid, plan, _ = make_plan(rows, ["y", "x1"], effects, [stats[e] for e in effects], unit="unit", center=center, scale=scale, tol=1e-11, max_iter=1000)

    def run(batches):
        for batch, starts in blocks_of(batches, plan):
            z = residual_rows(batch, starts, plan) * plan.scale
            yield pa.RecordBatch.from_arrays([batch.column("unit"), batch.column("time"), pa.array(z[:, 0]), pa.array(z[:, 1])], names=["unit", "time", "y", "x1"])

    kind = rows.schema["unit"].dataType.simpleString()
    return laid.mapInArrow(run, f"unit {kind}, time long, y double, x1 double").select(F.col("unit").cast("string").alias("unit"), "time", (F.round("y", 4) + 0.0).alias("y"), (F.round("x1", 4) + 0.0).alias("x1"))


def _absorbed_sql(name: str, keys: list[str], sweeps: int, divisor: int = 1) -> str:
    sql, last, n = [f"p AS ({panel_sql(name)})", f"d0 AS (SELECT * REPLACE (CAST(y AS DOUBLE) / {divisor} AS y) FROM p)"], "d0", 0
    extra = ", nation, region" if name == "sup" else ""
    for _ in range(sweeps):
        for k in keys:
            n += 1
            sql.append(f"d{n} AS (SELECT unit, time, season{extra}, y - avg(y) OVER (PARTITION BY {k}) AS y, x1 - avg(x1) OVER (PARTITION BY {k}) AS x1 FROM {last})")
            last = f"d{n}"
    return f"WITH {', '.join(sql)} SELECT CAST(unit AS VARCHAR) AS unit, time, round(y, 4) + 0.0 AS y, round(x1, 4) + 0.0 AS x1 FROM {last}"


for _name, _panel, _effects, _keys, _sweeps, _divisor in (
    ("fe_oneway_demean", "sup", ["unit"], ["unit"], 1, 1),
    ("fe_oneway_other", "sup", ["nation"], ["nation"], 1, 1),
    ("fe_balanced_twoway", "evt", ["unit", "time"], ["unit", "time"], 1, 1),
    ("fe_twoway_unbalanced", "sup", ["unit", "time"], ["unit", "time"], 12, 1),
    ("fe_joint_key", "sup", ["unit", "joint"], ["unit", "region, time"], 12, 1),
    ("fe_threeway", "sup", ["unit", "time", "season"], ["unit", "time", "season"], 12, 1),
    ("fe_sparse_twoway", "usr", ["unit", "time"], ["unit", "time"], 40, 1),
    # From SF 0.01 on both effects have over a thousand levels; below, the graph is too sparse for the SQL's sweeps to converge.
    ("fe_two_large", "cus", ["unit", "group"], ["unit", "unit % 20, time"], 45, 100_000),
):
    QUERIES[_name] = lambda spark, sf, _p=_panel, _e=_effects, _d=_divisor: _absorbed(spark, sf, _p, _e, _d)
    ORACLE_SQL[_name] = _absorbed_sql(_panel, _keys, _sweeps, _divisor)


# The supplier panel's graph of units and periods is connected.
@query(f"WITH p AS ({panel_sql('sup')}) SELECT CAST(count(DISTINCT unit) + count(DISTINCT time) - 1 AS BIGINT) AS fe_rank FROM p")
def fe_rank_twoway(spark, sf):
    p = checked(panel(spark, sf, "sup"))
    counts = p.frame.agg(F.count_distinct("unit"), F.count_distinct("__t")).first()
    return one_row(spark, fe_rank=effect_rank(p.frame, ["unit", "__t"], list(counts), "exact").rank)


def _rank_of(spark, sf, effects: list[str], mode: str) -> DataFrame:
    rows = checked(panel(spark, sf, "sup")).frame.withColumn("cell", F.to_json(F.struct("nation", "season"))).persist()
    counts = rows.agg(*[F.count_distinct(e) for e in effects]).first()
    found = effect_rank(rows, effects, list(counts), mode)
    return spark.createDataFrame([(found.rank, found.exact, found.method)], "fe_rank long, exact boolean, method string")


# A season holds whole periods, a nation whole suppliers, and all nations meet all seasons.
@query(f"WITH p AS ({panel_sql('sup')}) SELECT CAST(count(DISTINCT unit) + count(DISTINCT time) - 1 + count(DISTINCT (nation, season)) - count(DISTINCT nation) - count(DISTINCT season) + 1 AS BIGINT) AS fe_rank, TRUE AS exact FROM p")
def fe_rank_threeway(spark, sf):
    return _rank_of(spark, sf, ["unit", "__t", "cell"], "exact").drop("method")


@query(f"WITH p AS ({panel_sql('sup')}) SELECT CAST(count(DISTINCT unit) + count(DISTINCT time) - 1 AS BIGINT) AS fe_rank, TRUE AS exact, 'reduced' AS method FROM p")
def fe_rank_reduced(spark, sf):
    return _rank_of(spark, sf, ["unit", "__t", "season"], "exact")


# The most components of a pair: a season each of periods and seasons.
@query(f"WITH p AS ({panel_sql('sup')}) SELECT CAST(count(DISTINCT unit) + count(DISTINCT time) + count(DISTINCT season) - count(DISTINCT season) AS BIGINT) AS fe_rank, FALSE AS exact, 'conservative' AS method FROM p")
def fe_rank_conservative(spark, sf):
    return _rank_of(spark, sf, ["unit", "__t", "season"], "conservative")


@query(f"WITH p AS ({panel_sql('sup')}) SELECT (SELECT max(c) = 1 FROM (SELECT count(DISTINCT nation) AS c FROM p GROUP BY unit)) AS unit_in_nation, (SELECT max(c) = 1 FROM (SELECT count(DISTINCT region) AS c FROM p GROUP BY nation)) AS nation_in_region, (SELECT max(c) = 1 FROM (SELECT count(DISTINCT nation) AS c FROM p GROUP BY time)) AS time_in_nation")
def fe_nested_in_cluster(spark, sf):
    rows = panel(spark, sf, "sup")
    found = tuple(nested(rows, a, b) for a, b in (("unit", "nation"), ("nation", "region"), ("time", "nation")))
    return spark.createDataFrame([found], "unit_in_nation boolean, nation_in_region boolean, time_in_nation boolean")


# Fits


def _fit(spark, sf, name: str, horizons: int, *, controls=("x2",), shock="x1", options=None, **more) -> LocalProjection:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", FewClustersWarning)
        return LocalProjection(horizons=horizons, **({"covariance": "homoskedastic"} | (options or {}))).fit(panel(spark, sf, name), outcome="y", shock=shock, controls=list(controls), unit="unit", time="time", **more)


def _tidy(model: LocalProjection, interval: bool = False, digits: int = DIGITS, only: tuple[str, ...] = ("x1", "x2")) -> DataFrame:
    bounds = [(F.round(c, digits) + 0.0).alias(c) for c in ("ci_low", "ci_high")] if interval else []
    return model.to_spark().where(F.col("coefficient").isin(*only)).select("horizon", "n_obs", "coefficient", (F.round("estimate", digits) + 0.0).alias("estimate"), (F.round("std_error", digits) + 0.0).alias("std_error"), *bounds)


def _lp(name: str, sql: str, where: str, horizons: int, *, interval=False, only=("x1", "x2"), **spec) -> None:
    QUERIES[name] = lambda spark, sf: _tidy(_fit(spark, sf, where, horizons, **spec), interval, only=only)
    ORACLE_SQL[name] = sql


_U, _UT, _ONE = [("unit",)], [("unit",), ("time",)], ["unit", "time"]
_CONNECTED = "units + periods - 1"
_NORMAL = {"covariance": "cluster", "cluster_inference": "normal"}

_lp("lp_fit_tidy", lp_sql("sup", 4, effects=_U, kind="cluster", clusters=_U, correction="3", interval=True), "sup", 4, interval=True, fixed_effects=["unit"], cluster="unit", options=_NORMAL)
_lp("lp_ols_coef", lp_sql("sup", 3, rank="1"), "sup", 3)
_lp("lp_single_regressor", lp_sql("evt", 2, x=("x1",), rank="1"), "evt", 2, controls=(), only=("x1",))
_lp("lp_lagged_coef", lp_sql("sup", 2, x=("x1", "x1_lag1"), lags=[("x1", 1)], rank="1"), "sup", 2, controls=(), shock_lags=1, only=("x1", "x1_lag1"))
_lp("lp_outcome_lag_coef", lp_sql("usr", 1, x=("x1", "y_lag1"), lags=[("y", 1)], rank="1"), "usr", 1, controls=(), outcome_lags=1, only=("x1", "y_lag1"))
_lp("lp_cumulative_coef", lp_sql("sup", 3, response="cumulative", rank="1"), "sup", 3, options={"response": "cumulative"})
_lp("lp_per_horizon_coef", lp_sql("usr", 2, sample="per_horizon", rank="1"), "usr", 2, options={"sample": "per_horizon"})
_lp("lp_twoway_fe_coef", lp_sql("sup", 2, effects=_UT, sweeps=10, rank=_CONNECTED), "sup", 2, fixed_effects=_ONE)
_lp("lp_balanced_twoway", lp_sql("evt", 2, effects=_UT, sweeps=2, rank=_CONNECTED), "evt", 2, fixed_effects=_ONE)
_lp("lp_time_fe_coef", lp_sql("sup", 1, effects=[("time",)], rank="periods"), "sup", 1, fixed_effects=["time"])
_lp("vcov_homoskedastic", lp_sql("sup", 2, effects=_U, rank="units"), "sup", 2, fixed_effects=["unit"])
for _kind in ("hc0", "hc1"):
    _lp(f"vcov_{_kind}", lp_sql("sup", 2, effects=_U, rank="units", kind=_kind), "sup", 2, fixed_effects=["unit"], options={"covariance": _kind})
for _kind in ("hc2", "hc3"):
    _lp(f"vcov_{_kind}", lp_sql("sup", 1, rank="1", kind=_kind), "sup", 1, options={"covariance": _kind})
_lp("vcov_cluster_cr0", lp_sql("sup", 2, effects=_U, kind="cluster", clusters=[("nation",)], extra=", nation, region"), "sup", 2, fixed_effects=["unit"], cluster="nation", options=_NORMAL | {"cluster_correction": "cr0"})
_lp("vcov_cluster_cr1", lp_sql("sup", 2, effects=_UT, sweeps=10, kind="cluster", clusters=_U, correction="(2 + periods)"), "sup", 2, fixed_effects=_ONE, cluster="unit", options=_NORMAL)
_lp("vcov_cluster_full_df", lp_sql("sup", 1, effects=_U, kind="cluster", clusters=_U, correction="(2 + units)"), "sup", 1, fixed_effects=["unit"], cluster="unit", options=_NORMAL | {"cluster_df": "full"})
_lp("vcov_cluster_none_df", lp_sql("sup", 1, effects=_U, kind="cluster", clusters=_U, correction="2"), "sup", 1, fixed_effects=["unit"], cluster="unit", options=_NORMAL | {"cluster_df": "none"})
_lp("vcov_cluster_interaction", lp_sql("sup", 1, effects=_U, kind="cluster", clusters=[("nation", "season")], correction="(2 + units)", extra=", nation, region"), "sup", 1, fixed_effects=["unit"], cluster=("nation", "season"), options=_NORMAL)
for _how in ("min", "component"):
    _lp(f"vcov_cluster_twoway_{_how}", lp_sql("sup", 1, effects=_U, kind="cluster", clusters=[("nation",), ("time",)], correction="3", names=_how, extra=", nation, region"), "sup", 1, fixed_effects=["unit"], cluster=["nation", "time"], options=_NORMAL | {"cluster_group_adjustment": _how})
_lp("vcov_cluster_threeway", lp_sql("sup", 1, effects=_U, kind="cluster", clusters=[("unit",), ("time",), ("region", "season")], correction="3", extra=", nation, region"), "sup", 1, fixed_effects=["unit"], cluster=["unit", "time", ("region", "season")], options=_NORMAL)
for _kernel, _short in (("bartlett", "bartlett"), ("parzen", "parzen"), ("quadratic_spectral", "qs")):
    _lp(f"vcov_hac_{_short}", lp_sql("sup", 2, effects=_U, rank="units", kind="hac", kernel=_kernel, bandwidth=3), "sup", 2, fixed_effects=["unit"], options={"covariance": "hac", "hac_kernel": _kernel, "hac_lags": 3})
    _lp(f"vcov_dk_{_short}", lp_sql("sup", 2, effects=_U, rank="units", kind="dk", kernel=_kernel), "sup", 2, fixed_effects=["unit"], options={"covariance": "driscoll_kraay", "hac_kernel": _kernel})
for _kernel, _short in (("bartlett", "bartlett"), ("quadratic_spectral", "qs")):  # a clock of seconds: wide and sparse
    _lp(f"vcov_hac_seconds_{_short}", lp_sql("sec", 0, effects=_U, rank="units", kind="hac", kernel=_kernel, bandwidth=864_000), "sec", 0, fixed_effects=["unit"], options={"covariance": "hac", "hac_kernel": _kernel, "hac_lags": 864_000})
_lp("conf_int_normal", lp_sql("sup", 1, rank="1", kind="hc1", interval=True), "sup", 1, interval=True, options={"covariance": "hc1"})
_lp("conf_int_t", lp_sql("reg", 1, effects=_U, kind="cluster", clusters=_U, correction="3", interval=True, value=2.7764451051977987), "reg", 1, interval=True, fixed_effects=["unit"], cluster="unit", options={"covariance": "cluster"})


@query(f"WITH p AS ({panel_sql('sup')}) SELECT CAST(v AS BIGINT) AS horizon, CAST(greatest(v, floor(4 * pow((SELECT count(DISTINCT time) FROM p) / 100.0, 2.0 / 9))) AS BIGINT) AS bandwidth FROM generate_series(0, 6) t(v)")
def bandwidth_default(spark, sf):
    periods = panel(spark, sf, "sup").agg(F.count_distinct("time")).first()[0]
    return spark.createDataFrame([(h, default_bandwidth(periods, h)) for h in range(7)], "horizon long, bandwidth long")


# Terms


_PRODUCT = lp_sql("evt", 1, x=("x1", "x1 * x2"), rank="1").replace("'x1 * x2' AS coefficient", "'x1:x2' AS coefficient")


@query(_PRODUCT)
def term_product(spark, sf):
    """A product as a control: no lower-order terms come with it."""
    return _tidy(_fit(spark, sf, "evt", 1, controls=(interact("x1", "x2"),)), only=("x1", "x1:x2"))


@query(partial_sql("sup", 1, "x1 * x2", ("x1", "x2"), parameters="4"))
def term_shock_hierarchy(spark, sf):
    """A product as a shock brings its factors."""
    model = _fit(spark, sf, "sup", 1, shock=interact("x1", "x2"), controls=())
    return _tidy(model, only=("x1:x2",)).drop("coefficient")


@query(f"WITH p AS ({panel_sql('sup')}) SELECT DISTINCT 'region[' || region || ']' AS term FROM p WHERE region <> (SELECT arg_min(region, unit) FROM p)")
def term_absorbed(spark, sf):
    """Levels of a category that the unit effect absorbs are left out and recorded."""
    model = _fit(spark, sf, "sup", 1, shock=interact("x1", by=C("region")), controls=(), fixed_effects=["unit"])
    return spark.createDataFrame([(t["term"],) for t in model.absorbed_terms_], "term string")


_LEVELS = lp_sql("sup", 1, x=("CASE WHEN season % 2 = 0 THEN x1 ELSE 0 END", "CASE WHEN season % 2 = 1 THEN x1 ELSE 0 END"), effects=[("unit", "season % 2")])


@query(f"WITH b AS ({_LEVELS}) SELECT horizon, CASE WHEN coefficient LIKE '%= 0%' THEN 'even' ELSE 'odd' END AS level, n_obs, estimate FROM b")
def term_categorical_irf(spark, sf):
    rows = panel(spark, sf, "sup").withColumn("half", F.when(F.col("season") % 2 == 0, "even").otherwise("odd"))
    model = LocalProjection(horizons=1, covariance="homoskedastic").fit(rows, outcome="y", shock=interact("x1", by=C("half")), unit="unit", time="time", fixed_effects=[fe("unit", "half")])
    frame = model.irf_frame()
    return spark.createDataFrame([(int(r.horizon), r.level, int(r.n_obs), round(r.estimate, DIGITS) + 0.0) for r in frame.itertuples()], "horizon long, level string, n_obs long, estimate double")


@query(f"WITH p AS ({panel_sql('sup')}), l AS (SELECT *, {lead_sql('y', 1)} AS y1 FROM p) SELECT CASE WHEN season % 2 = 0 THEN 'even' ELSE 'odd' END AS level, count(*) AS level_n_obs, CAST(sum(CASE WHEN x1 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS nonzero_shock_n_obs FROM l WHERE y1 IS NOT NULL GROUP BY 1")
def term_support_counts(spark, sf):
    rows = panel(spark, sf, "sup").withColumn("half", F.when(F.col("season") % 2 == 0, "even").otherwise("odd"))
    model = LocalProjection(horizons=1, covariance="homoskedastic").fit(rows, outcome="y", shock=interact("x1", by=C("half")), unit="unit", time="time", fixed_effects=["unit"])
    seen = {r.level: (r.level, int(r.level_n_obs), int(r.nonzero_shock_n_obs)) for r in model.irf_frame().itertuples()}
    return spark.createDataFrame(list(seen.values()), "level string, level_n_obs long, nonzero_shock_n_obs long")


_AT = (0.02, 0.06)


# The response at z is the coefficient of x1 where the product is x1 times (x2 - z).
@query(" UNION ALL ".join(f"SELECT {z} AS at, horizon, estimate, std_error FROM ({partial_sql('sup', 2, 'x1', (f'x1 * (x2 - {z})', 'x2'), by='unit', parameters='4', cluster='nation', extra=', nation')})" for z in _AT).replace("SELECT 0.02 AS at", "SELECT CAST(0.02 AS DOUBLE) AS at").replace("SELECT 0.06 AS at", "SELECT CAST(0.06 AS DOUBLE) AS at"))
def term_continuous_irf(spark, sf):
    model = _fit(spark, sf, "sup", 2, shock=interact("x1", by="x2"), controls=(), fixed_effects=["unit"], cluster="nation", options=_NORMAL)
    frame = model.irf_frame(at=list(_AT))
    return spark.createDataFrame([(int(r.horizon), r.at, round(r.estimate, DIGITS) + 0.0, round(r.std_error, DIGITS) + 0.0) for r in frame.itertuples()], "horizon long, at double, estimate double, std_error double")


@query(lp_sql("sup", 2, x=("x1",), effects=_U, rank="units", interval=True).replace("coefficient, round", "coefficient AS shock, round"))
def irf_frame_contrast(spark, sf):
    frame = _fit(spark, sf, "sup", 2, controls=(), fixed_effects=["unit"]).irf_frame()
    return spark.createDataFrame([(int(r.horizon), int(r.n_obs), r.shock, round(r.estimate, DIGITS) + 0.0, round(r.std_error, DIGITS) + 0.0, round(r.ci_low, DIGITS) + 0.0, round(r.ci_high, DIGITS) + 0.0) for r in frame.itertuples()], "horizon long, n_obs long, shock string, estimate double, std_error double, ci_low double, ci_high double")


@query(f"WITH p AS ({panel_sql('sup')}), l AS (SELECT *, {lead_sql('y', 1)} AS y1 FROM p) SELECT 'scaled_qr' AS solver, true AS ill_conditioned, count(*) AS n_obs FROM l WHERE y1 IS NOT NULL")
def diagnostics_qr_path(spark, sf):
    rows = panel(spark, sf, "sup").withColumn("x2", F.col("x1") + 1e-6 * F.col("x2"))
    model = LocalProjection(horizons=1, covariance="homoskedastic").fit(rows, outcome="y", shock="x1", controls=["x2"], unit="unit", time="time", fixed_effects=["unit"])
    found = model.linear_algebra_diagnostics_
    return one_row(spark, solver=found["solver"], n_obs=model.n_obs_).select("solver", F.lit(found["by_cache_group"][0]["condition"] > 1e6).alias("ill_conditioned"), "n_obs")


@query(f"WITH p AS ({panel_sql('sup')}), l AS (SELECT *, {lead_sql('y', 2)} AS y2, {lead_sql('y', 1)} AS y1 FROM p) SELECT unit, time FROM l WHERE y1 IS NOT NULL AND y2 IS NOT NULL")
def sample_frame(spark, sf):
    return _fit(spark, sf, "sup", 2, fixed_effects=["unit"]).sample_frame(1)
