"""Explicit-dummy least squares with brute-force covariances, for small panels."""

from itertools import combinations

import numpy as np
import pandas as pd

from impulsar.functions.lag_weights import weights


def sample(df, horizons, cumulative=False):
    """Common-sample rows and their outcomes by exact periods."""
    value = df.set_index(["unit", "time"])["y"].to_dict()
    rows, out = [], []
    for i, (u, t) in enumerate(zip(df["unit"], df["time"], strict=True)):
        path = [value.get((u, t + h)) for h in range(horizons + 1)]
        if all(v is not None for v in path):
            rows.append(i)
            out.append(np.cumsum(path) if cumulative else path)
    return df.iloc[rows].reset_index(drop=True), np.array(out)


def estimates(df, horizons, *, x=("x", "z"), effects=(), kind="homoskedastic", clusters=(), correction=None, lags=2, kernel="bartlett", cumulative=False):
    """(horizons x regressors) coefficients and standard errors of the regressors."""
    s, ys = sample(df, horizons, cumulative)
    z = np.column_stack([s[list(x)].to_numpy(float), *[pd.get_dummies(s[list(e)].astype(str).agg("#".join, axis=1)).to_numpy(float) for e in effects]] + ([] if effects else [np.ones(len(s))]))
    bread, rank, n, k = np.linalg.pinv(z.T @ z), np.linalg.matrix_rank(z), len(s), len(x)
    coef, se = [], []
    for y in ys.T:
        b = bread @ z.T @ y
        e = y - z @ b
        score = z * e[:, None]
        if kind == "homoskedastic":
            v = bread * (e @ e) / (n - rank)
        else:
            if kind in ("hc0", "hc1", "hc2", "hc3"):
                lever = 1 - np.einsum("ij,jk,ik->i", z, bread, z)
                w = {"hc0": 1, "hc1": n / (n - rank), "hc2": 1 / lever, "hc3": 1 / lever**2}[kind]
                meat = (score * np.broadcast_to(w, n)[:, None]).T @ score
            elif kind == "cluster":
                meat = 0
                groups = [s[list(c)].astype(str).agg("#".join, axis=1) for c in clusters]
                least = min(g.nunique() for g in groups)
                for size in range(1, len(groups) + 1):
                    for subset in combinations(groups, size):
                        total = pd.DataFrame(score).groupby(pd.concat(subset, axis=1).agg("|".join, axis=1).to_numpy()).sum().to_numpy()
                        cr1 = least / (least - 1) * (n - 1) / (n - correction) if correction else 1
                        meat = meat + (-1) ** (size + 1) * cr1 * total.T @ total
            else:
                unit = s["unit"].to_numpy() if kind == "hac" else np.zeros(n)
                time = s["time"].to_numpy()
                meat = 0
                for i in range(n):
                    for j in range(n):
                        if unit[i] == unit[j]:
                            d = abs(int(time[i]) - int(time[j]))
                            w = 1.0 if d == 0 else weights(kernel, lags, np.array([d]))[0]
                            meat = meat + w * np.outer(score[i], score[j])
            v = bread @ meat @ bread
        coef.append(b[:k])
        se.append(np.sqrt(np.diag(v)[:k]))
    return np.array(coef), np.array(se)
