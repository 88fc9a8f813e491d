"""SQL of the same estimates, for engines that have no estimator.

``lp_sql`` writes a query for up to two regressors: outcomes in long form by
horizon, effects taken out by unrolled group-mean sweeps, coefficients by
Cramer's rule, and the covariance by the formula of its kind.
"""

from __future__ import annotations

PANELS = {
    "sup": "SELECT l_suppkey AS unit, CAST((year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1 AS BIGINT) AS time, sum(l_quantity) AS y, avg(l_discount) AS x1, avg(l_tax) AS x2 FROM lineitem GROUP BY 1, 2",
    "evt": "SELECT event_type AS unit, CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS time, avg(value) AS y, CAST(count(*) AS DOUBLE) AS x1, avg(CAST(user_id % 7 AS DOUBLE)) AS x2 FROM events GROUP BY 1, 2",
    "usr": "SELECT user_id AS unit, CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS time, sum(value) AS y, CAST(count(*) AS DOUBLE) AS x1, avg(CAST(event_id % 11 AS DOUBLE)) AS x2 FROM events GROUP BY 1, 2",
    "reg": "SELECT n_regionkey AS unit, CAST((year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1 AS BIGINT) AS time, sum(l_quantity) AS y, avg(l_discount) AS x1, avg(l_tax) AS x2 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2",
    "sec": "SELECT user_id AS unit, CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS time, sum(value) AS y, CAST(count(*) AS DOUBLE) + avg(CAST(event_id % 5 AS DOUBLE)) AS x1, avg(CAST(event_id % 11 AS DOUBLE)) AS x2 FROM events GROUP BY 1, 2",
    "cus": "SELECT o_custkey AS unit, CAST((year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1 AS BIGINT) AS time, sum(o_totalprice) AS y, CAST(count(*) AS DOUBLE) AS x1, avg(CAST(o_orderkey % 13 AS DOUBLE)) AS x2 FROM orders GROUP BY 1, 2",
}


def panel_sql(panel: str) -> str:
    """The panel with its further keys: season, and nation and region where units are suppliers."""
    if panel == "sup":
        return f"SELECT p.*, time % 12 AS season, s_nationkey AS nation, n_regionkey AS region FROM ({PANELS[panel]}) p JOIN supplier ON unit = s_suppkey JOIN nation ON s_nationkey = n_nationkey"
    return f"SELECT p.*, time % 12 AS season FROM ({PANELS[panel]}) p"


def lead_sql(value: str, steps: int, span: str = "") -> str:
    low, high = (f"{abs(steps)} {'FOLLOWING' if steps > 0 else 'PRECEDING'}",) * 2 if steps else ("CURRENT ROW", "CURRENT ROW")
    return f"max({value}) OVER (PARTITION BY unit ORDER BY time RANGE BETWEEN {low} AND {high})"


def cumulative_sql(value: str, steps: int) -> str:
    frame = f"OVER (PARTITION BY unit ORDER BY time RANGE BETWEEN CURRENT ROW AND {steps} FOLLOWING)"
    return f"CASE WHEN count({value}) {frame} = {steps + 1} THEN sum({value}) {frame} END"


def partial_sql(panel: str, horizons: int, target: str, others: tuple[str, ...], *, by: str = "", parameters: str = "0", cluster: str = "", extra: str = "", digits: int = 5) -> str:
    """(horizon, n_obs, estimate, std_error) of one regressor: the others are taken out of it and of the outcome one after another.

    ``by`` is an absorbed key, without one the mean goes; ``parameters`` is what
    the variance counts, over (n, units); with ``cluster`` it is CR1.
    """
    ys = ", ".join(f"{lead_sql('y', h)} AS y{h}" for h in range(horizons + 1))
    where = " AND ".join(f"y{h} IS NOT NULL" for h in range(horizons + 1))
    columns = ", ".join(f"CAST({x} AS DOUBLE) AS o{i}" for i, x in enumerate(others))
    long = " UNION ALL ".join(f"SELECT *, {h} AS h, y{h} AS v, CAST({target} AS DOUBLE) AS t{', ' + columns if columns else ''} FROM l WHERE {where}" for h in range(horizons + 1))
    names = ["v", "t", *[f"o{i}" for i in range(len(others))]]
    over = f"OVER (PARTITION BY h{', ' + by if by else ''})"
    kept = f"h, unit, time{extra}"
    sql = [f"p AS ({panel_sql(panel)})", f"l AS (SELECT *, {ys} FROM p)", f"r AS ({long})", f"d0 AS (SELECT {kept}, {', '.join(f'{n} - avg({n}) {over} AS {n}' for n in names)} FROM r)"]
    for i in range(len(others)):
        rest = [n for n in names if n != f"o{i}" and not (n[0] == "o" and int(n[1:]) < i)]
        sql.append(f"d{i + 1} AS (SELECT {kept}, {', '.join(f'{n} - o{i} * (sum({n} * o{i}) OVER (PARTITION BY h) / sum(o{i} * o{i}) OVER (PARTITION BY h)) AS {n}' for n in rest)} FROM d{i})")
    last = f"d{len(others)}"
    sql += [f"g AS (SELECT h, count(*) AS n, count(DISTINCT unit) AS units, sum(t * v) / sum(t * t) AS c, sum(t * t) AS tt FROM {last} GROUP BY h)", f"e AS (SELECT {last}.*, n, units, c, tt, v - c * t AS e FROM {last} JOIN g USING (h))"]
    if cluster:
        sql.append(f"w AS (SELECT h, CAST(count(*) AS DOUBLE) / (count(*) - 1) * any_value((n - 1.0) / (n - ({parameters}))) * sum(s * s) AS m FROM (SELECT h, {cluster}, any_value(n) AS n, any_value(units) AS units, sum(t * e) AS s FROM e GROUP BY h, {cluster}) GROUP BY h)")
    else:
        sql.append(f"w AS (SELECT h, sum(e * e) / any_value(n - ({parameters})) * any_value(tt) AS m FROM e GROUP BY h)")
    return f"WITH {', '.join(sql)} SELECT CAST(h AS BIGINT) AS horizon, CAST(n AS BIGINT) AS n_obs, round(c, {digits}) + 0.0 AS estimate, round(sqrt(m) / tt, {digits}) + 0.0 AS std_error FROM g JOIN w USING (h)"


def lp_sql(panel: str, horizons: int, *, effects=(), x=("x1", "x2"), lags=(), kind="homoskedastic", response="level", sample="common", clusters=(), correction="", bandwidth=None, kernel="bartlett", sweeps=1, rank="0", extra="", names=None, value=1.959963984540054, interval=False, digits=5) -> str:
    """``rank``: SQL for the rank of the effects, ``correction``: for the parameters of CR1, over ``g`` (n, units, periods by h)."""
    k = len(x)
    x1, x2 = x[0], x[1] if k == 2 else "0.0"
    step = cumulative_sql if response == "cumulative" else lead_sql
    ys = ", ".join(f"{step('y', h)} AS y{h}" for h in range(horizons + 1))
    lagged = "".join(f", {lead_sql(v, -n)} AS {v}_lag{n}" for v, n in lags)
    need = [f"{v}_lag{n} IS NOT NULL" for v, n in lags]
    common = [f"y{h} IS NOT NULL" for h in range(horizons + 1)] if sample == "common" else []
    where = " AND ".join([*need, *common]) or "TRUE"
    long = " UNION ALL ".join(f"SELECT unit, time, season{extra}, {h} AS h, y{h} AS y, CAST({x1} AS DOUBLE) AS a, CAST({x2} AS DOUBLE) AS b FROM s WHERE y{h} IS NOT NULL" for h in range(horizons + 1))
    keys = [", ".join(e) for e in effects] or [None]
    sql, last = [f"p AS ({panel_sql(panel)})", f"l AS (SELECT *, {ys}{lagged} FROM p)", f"s AS (SELECT * FROM l WHERE {where})", f"d0 AS ({long})"], "d0"
    n = 0
    for _ in range(sweeps):
        for key in keys:
            n += 1
            over = f"OVER (PARTITION BY h{', ' + key if key else ''})"
            sql.append(f"d{n} AS (SELECT unit, time, season{extra}, h, y - avg(y) {over} AS y, a - avg(a) {over} AS a, b - avg(b) {over} AS b FROM {last})")
            last = f"d{n}"
    if k == 2:
        solve = "(ta * sbb - tb * sab) / (saa * sbb - sab * sab) AS ca, (tb * saa - ta * sab) / (saa * sbb - sab * sab) AS cb, sbb / (saa * sbb - sab * sab) AS baa, -sab / (saa * sbb - sab * sab) AS bab, saa / (saa * sbb - sab * sab) AS bbb"
    else:
        solve = "ta / saa AS ca, 0.0 AS cb, 1 / saa AS baa, 0.0 AS bab, 0.0 AS bbb"
    sql += [
        f"g AS (SELECT h, count(*) AS n, count(DISTINCT unit) AS units, count(DISTINCT time) AS periods, sum(a * a) AS saa, sum(a * b) AS sab, sum(b * b) AS sbb, sum(a * y) AS ta, sum(b * y) AS tb FROM {last} GROUP BY h)",
        f"f AS (SELECT h, n, units, periods, {k} + {rank} AS mr, {correction or '0'} AS cr, {solve} FROM g)",
        f"e AS (SELECT r.*, n, units, periods, mr, cr, baa, bab, bbb, y - a * ca - b * cb AS e FROM {last} r JOIN f USING (h))",
    ]
    if kind == "homoskedastic":
        sql.append("v AS (SELECT h, sum(e * e) / any_value(n - mr) AS s2 FROM e GROUP BY h)")
        var = "s2 * baa AS va, s2 * bbb AS vb"
    else:
        if kind.startswith("hc"):
            lever = "(1 - 1.0 / n - a * a * baa - 2 * a * b * bab - b * b * bbb)"
            weight = {"hc2": f" / {lever}", "hc3": f" / ({lever} * {lever})"}.get(kind, "")
            factor = "any_value(n / (n - mr)) *" if kind == "hc1" else ""
            sql.append(f"m AS (SELECT h, {factor} sum(e * e * a * a{weight}) AS maa, {factor} sum(e * e * a * b{weight}) AS mab, {factor} sum(e * e * b * b{weight}) AS mbb FROM e GROUP BY h)")
        elif kind == "cluster":
            from itertools import combinations

            parts, counts = [], []
            for i, term in enumerate(clusters):
                counts.append(f"(SELECT count(DISTINCT ({', '.join(term)})) FROM e WHERE e.h = f.h) AS g{i}")
            sql.append(f"gc AS (SELECT h, n, cr, {', '.join(counts)} FROM f)")
            least = f"least({', '.join(f'g{i}' for i in range(len(clusters)))})" if len(clusters) > 1 else "g0"
            for size in range(1, len(clusters) + 1):
                for subset in combinations(range(len(clusters)), size):
                    by = ", ".join(dict.fromkeys(c for i in subset for c in clusters[i]))
                    used = "count(*)" if names == "component" else f"any_value({least})"
                    cr1 = f"* (CAST({used} AS DOUBLE) / ({used} - 1)) * any_value((n - 1.0) / (n - cr))" if correction else ""
                    sign = "" if size % 2 else "-"
                    parts.append(f"SELECT q.h, {sign}sum(sa * sa) {cr1} AS maa, {sign}sum(sa * sb) {cr1} AS mab, {sign}sum(sb * sb) {cr1} AS mbb FROM (SELECT h, {by}, sum(a * e) AS sa, sum(b * e) AS sb FROM e GROUP BY h, {by}) q JOIN gc ON gc.h = q.h GROUP BY q.h")
            sql.append(f"m AS (SELECT h, sum(maa) AS maa, sum(mab) AS mab, sum(mbb) AS mbb FROM ({' UNION ALL '.join(parts)}) GROUP BY h)")
        else:
            rows = "SELECT h, unit, time, a * e AS sa, b * e AS sb FROM e" if kind == "hac" else "SELECT h, 0 AS unit, time, sum(a * e) AS sa, sum(b * e) AS sb FROM e GROUP BY h, time"
            width = str(bandwidth) if bandwidth is not None else "greatest(f.h, CAST(floor(4 * pow(periods / 100.0, 2.0 / 9)) AS INTEGER))"
            d = "abs(i.time - j.time)"
            if kernel == "bartlett":
                weight = f"CASE WHEN {d} <= w THEN 1 - {d} / (w + 1.0) ELSE 0 END"
            elif kernel == "parzen":
                weight = f"CASE WHEN {d} > w THEN 0 WHEN {d} / (w + 1.0) <= 0.5 THEN 1 - 6 * pow({d} / (w + 1.0), 2) * (1 - {d} / (w + 1.0)) ELSE 2 * pow(1 - {d} / (w + 1.0), 3) END"
            else:
                z = f"(6 * pi() * {d} / (5.0 * w))"
                weight = f"CASE WHEN {d} = 0 THEN 1 WHEN w = 0 THEN 0 WHEN {z} < 0.1 THEN 1 - pow({z}, 2) / 10 + pow({z}, 4) / 280 - pow({z}, 6) / 15120 ELSE 3 * (sin({z}) / {z} - cos({z})) / pow({z}, 2) END"
            sql += [
                f"sc AS ({rows})",
                f"wd AS (SELECT f.h, n, mr, {width} AS w FROM f)",
                f"m AS (SELECT i.h, any_value(CAST(n AS DOUBLE) / (n - mr)) * sum(i.sa * j.sa * ({weight})) AS maa, any_value(CAST(n AS DOUBLE) / (n - mr)) * sum(i.sa * j.sb * ({weight})) AS mab, any_value(CAST(n AS DOUBLE) / (n - mr)) * sum(i.sb * j.sb * ({weight})) AS mbb FROM sc i JOIN sc j ON i.h = j.h AND i.unit = j.unit JOIN wd ON wd.h = i.h GROUP BY i.h)",
            ]
        sql.append("v AS (SELECT f.h, baa * baa * maa + 2 * baa * bab * mab + bab * bab * mbb AS va, bab * bab * maa + 2 * bab * bbb * mab + bbb * bbb * mbb AS vb FROM m JOIN f USING (h))")
        var = "va, vb"
    bounds = f", round(c - {value} * se, {digits}) + 0.0 AS ci_low, round(c + {value} * se, {digits}) + 0.0 AS ci_high" if interval else ""
    rows = " UNION ALL ".join(f"SELECT h, n, '{name}' AS coefficient, c{s} AS c, sqrt(v{s}) AS se FROM o" for name, s in list(zip(x, "ab", strict=False)))
    sql += [f"o AS (SELECT f.h, n, ca, cb, {var} FROM f JOIN v USING (h))", f"t AS ({rows})"]
    return f"WITH {', '.join(sql)} SELECT CAST(h AS BIGINT) AS horizon, CAST(n AS BIGINT) AS n_obs, coefficient, round(c, {digits}) + 0.0 AS estimate, round(se, {digits}) + 0.0 AS std_error{bounds} FROM t"
