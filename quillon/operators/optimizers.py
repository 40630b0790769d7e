"""Weights from small matrices: one grouped task for each rebalance date, numpy inside.

A group is one covariance matrix, whose size is the number of assets, not of rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

RIDGE = 1e-8


def project_simplex(v: np.ndarray) -> np.ndarray:
    u = np.sort(v)[::-1]
    level = (np.cumsum(u) - 1) / np.arange(1, len(v) + 1)
    return np.maximum(v - level[u > level][-1], 0)


def long_only(w: np.ndarray) -> np.ndarray:
    w = np.maximum(np.nan_to_num(w), 0)
    return w / w.sum() if w.sum() > 0 else np.full(len(w), 1 / len(w))


def _ridged(cov: np.ndarray) -> np.ndarray:
    return cov + RIDGE * np.eye(len(cov))


def mean_variance(cov: np.ndarray, mu: np.ndarray | None = None, aversion: float = 1.0, rounds: int = 20000) -> np.ndarray:
    """Maximises w mu - aversion w cov w over the simplex, by accelerated projected gradient."""
    cov, n = _ridged(cov), len(cov)
    mu = np.zeros(n) if mu is None else mu
    step = 1 / (2 * aversion * max(np.linalg.eigvalsh(cov)[-1], 1e-12))
    w = v = np.full(n, 1 / n)
    t = 1.0
    for _ in range(rounds):
        new = project_simplex(v + step * (mu - 2 * aversion * cov @ v))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t_new * (new - w)
        if (new - w) @ (v - new) > 0:
            v, t_new = new, 1.0
        if np.abs(new - w).max() < 1e-12:
            return new
        w, t = new, t_new
    return w


def risk_budget(cov: np.ndarray, budget: np.ndarray | None = None, rounds: int = 500, tol: float = 1e-9) -> np.ndarray:
    """Weights whose shares of risk are the budget (equal by default), by multiplicative updates."""
    cov, n = _ridged(cov), len(cov)
    target = np.full(n, 1 / n) if budget is None else long_only(np.where(np.isnan(budget), 1 / n, budget))
    w = long_only(1 / np.sqrt(np.maximum(np.diag(cov), 1e-16)))
    for _ in range(rounds):
        share = np.maximum(w * (cov @ w), 1e-18)
        share /= share.sum()
        if np.abs(share - target).max() < tol:
            break
        w = long_only(w * np.sqrt(target / share))
    return w


def linkage(distance: np.ndarray, method: str) -> list[tuple[int, int, float, int]]:
    """Agglomerative merges (a, b, height, size) of a distance matrix: single or ward."""
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    name, size, out = list(range(len(d))), [1] * len(d), []
    for made in range(len(d), 2 * len(d) - 1):
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        a, b = sorted((name[i], name[j]))
        total = size[i] + size[j]
        out.append((a, b, float(d[i, j]), total))
        if method == "single":
            new = np.minimum(d[i], d[j])
        else:
            s = np.array(size)
            with np.errstate(invalid="ignore"):
                new = np.sqrt(np.maximum(((s + size[i]) * d[i] ** 2 + (s + size[j]) * d[j] ** 2 - s * d[i, j] ** 2) / (s + total), 0))
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        name[i], size[i] = made, total
    return out


def leaf_order(merges: list[tuple[int, int, float, int]], n: int) -> list[int]:
    stack, out = [2 * n - 2], []
    while stack:
        x = stack.pop()
        if x < n:
            out.append(x)
        else:
            a, b = merges[x - n][:2]
            stack += [b, a]
    return out


def clusters(merges: list[tuple[int, int, float, int]], n: int, k: int) -> list[list[int]]:
    """At most k clusters: the last k - 1 merges are undone."""
    parts = {i: [i] for i in range(n)}
    for m, (a, b, _, _) in enumerate(merges[: n - k]):
        parts[n + m] = parts.pop(a) + parts.pop(b)
    return [sorted(p) for p in parts.values()]


def _correlation(cov: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-16))
    c = np.clip(cov / np.outer(sd, sd), -1, 1)
    np.fill_diagonal(c, 1)
    return c


def _distance(cov: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((1 - _correlation(cov)) / 2, 0))


def _bisected(cov: np.ndarray, variance: Callable[[np.ndarray], float]) -> np.ndarray:
    n = len(cov)
    w, parts = np.ones(n), [leaf_order(linkage(_distance(cov), "single"), n)]
    while parts:
        part = parts.pop()
        if len(part) < 2:
            continue
        left, right = part[: len(part) // 2], part[len(part) // 2 :]
        a, b = (variance(cov[np.ix_(p, p)]) for p in (left, right))
        share = 1 - a / (a + b) if a + b > 0 else 0.5
        w[left] *= share
        w[right] *= 1 - share
        parts += [left, right]
    return long_only(w)


def _inverse_variance_risk(cov: np.ndarray) -> float:
    w = long_only(1 / np.maximum(np.diag(cov), 1e-16))
    return float(w @ cov @ w)


def _equal_risk(cov: np.ndarray) -> float:
    w = risk_budget(cov)
    return float(w @ cov @ w)


def hierarchical_risk_parity(cov: np.ndarray) -> np.ndarray:
    return risk_budget(cov) if len(cov) <= 2 else _bisected(_ridged(cov), _inverse_variance_risk)


def hierarchical_equal_risk(cov: np.ndarray) -> np.ndarray:
    return risk_budget(cov) if len(cov) <= 2 else _bisected(_ridged(cov), _equal_risk)


def minimum_variance(cov: np.ndarray) -> np.ndarray:
    try:
        w = np.linalg.solve(_ridged(cov), np.ones(len(cov)))
    except np.linalg.LinAlgError:
        return mean_variance(cov, None, 1e6)
    w = w / w.sum()
    return mean_variance(cov, None, 1e6) if (w < 0).any() or not np.isfinite(w).all() else w


def nested_clusters(cov: np.ndarray, most: int | None = None) -> np.ndarray:
    n = len(cov)
    if n <= 2:
        return minimum_variance(cov)
    k = min(n, most or max(2, round(np.sqrt(n))))
    inner = np.zeros((n, k))
    for j, part in enumerate(clusters(linkage(_distance(cov), "ward"), n, k)):
        inner[part, j] = minimum_variance(cov[np.ix_(part, part)])
    return long_only(inner @ minimum_variance(inner.T @ cov @ inner))


def olmar_step(relatives: np.ndarray, before: np.ndarray, epsilon: float = 10.0) -> np.ndarray:
    """One on-line step towards the moving average: relatives is a window of price relatives, oldest first."""
    x = np.where(np.isfinite(relatives) & (relatives > 0), relatives, 1.0)
    forecast = (1 / np.cumprod(x[::-1], axis=0)).mean(axis=0)
    away = forecast - forecast.mean()
    norm = away @ away
    if norm <= 1e-16:
        return before
    return project_simplex(before + max(0.0, (epsilon - before @ forecast) / norm) * away)


METHODS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "mean_variance": mean_variance,
    "risk_parity": risk_budget,
    "hrp": hierarchical_risk_parity,
    "herc": hierarchical_equal_risk,
    "min_variance": minimum_variance,
    "nco": nested_clusters,
}


def optimize(cov: DataFrame, method: str | Callable[[np.ndarray], np.ndarray], by: list[str], asset_type: str = "long") -> DataFrame:
    """by, asset, weight from a long covariance table (by, row, col, value), in which no pair may be missing; groups run in parallel."""
    solve = METHODS[method] if isinstance(method, str) else method
    types = dict(cov.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        m = rows.pivot(index="row", columns="col", values="value").sort_index().sort_index(axis=1)
        if m.isna().to_numpy().any():
            raise ValueError("a covariance is missing")
        out = pd.DataFrame({"asset": m.index, "weight": solve(m.to_numpy())})
        for k in by:
            out[k] = rows[k].iloc[0]
        return out[[*by, "asset", "weight"]]

    return cov.groupBy(*by).applyInPandas(run, ", ".join([f"{k} {types[k]}" for k in by] + [f"asset {asset_type}", "weight double"]))


def olmar(prices: DataFrame, window: int = 5, epsilon: float = 10.0, by: str = "strategy", asset_type: str = "long") -> DataFrame:
    """by, date, asset, weight: prices (by, date, asset, relative), a strategy in each task as every step needs the last."""
    kind = dict(prices.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        m = rows.pivot(index="date", columns="asset", values="relative").sort_index()
        w, made = np.full(m.shape[1], 1 / m.shape[1]), []
        for i in range(len(m)):
            if i + 1 >= window:
                w = olmar_step(m.to_numpy()[i + 1 - window : i + 1], w, epsilon)
            made.append(w)
        out = pd.DataFrame(made, index=m.index, columns=m.columns).stack().rename("weight").reset_index()
        out[by] = rows[by].iloc[0]
        return out[[by, "date", "asset", "weight"]]

    return prices.groupBy(by).applyInPandas(run, f"{by} {kind[by]}, date date, asset {asset_type}, weight double")
