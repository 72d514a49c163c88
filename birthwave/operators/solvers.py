"""Small numeric solves on grouped sums: called per key inside tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd


def minimise(f, x0: np.ndarray, tol: float = 1e-8, limit: int = 100) -> tuple[np.ndarray, float, bool]:
    """Quasi-Newton minimum of a smooth function of a few parameters, with central differences."""
    x = np.asarray(x0, float)
    k, value = len(x), f(x)

    def gradient(at):
        h = 1e-4 * np.maximum(1.0, np.abs(at))
        return np.array([(f(at + e) - f(at - e)) / (2 * d) for e, d in zip(np.diag(h), h)])

    g, inverse, quiet = gradient(x), np.eye(k) / 100, 0
    for _ in range(limit):
        step = -inverse @ g
        if step @ g >= 0:
            inverse, step = np.eye(k) / 100, -g / 100
        step *= min(1.0, 2.0 / np.abs(step).max()) if step.any() else 1.0
        scale, trial = 1.0, f(x + step)
        while not trial <= value + 1e-4 * scale * (step @ g) and scale > 1e-6:
            scale /= 3
            trial = f(x + scale * step)
        if not trial <= value:
            return x, value, bool(np.abs(g).max() < 1e-2)
        quiet = quiet + 1 if value - trial < tol else 0
        new = gradient(x + scale * step)
        dx, dg = scale * step, new - g
        x, value, g = x + dx, trial, new
        if quiet == 2 or np.abs(g).max() < 1e-6:
            return x, value, True
        curve = dx @ dg
        if curve > 1e-12:
            left = np.eye(k) - np.outer(dx, dg) / curve
            inverse = left @ inverse @ left.T + np.outer(dx, dx) / curve
    return x, value, False


def factor(theta: np.ndarray, k: int) -> np.ndarray:
    """Relative covariance factor of ``k`` terms: lower triangular, its entries row by row."""
    lam = np.zeros((k, k))
    lam[np.tril_indices(k)] = theta
    return lam


def _start(k: int) -> np.ndarray:
    return (0.3 * np.eye(k))[np.tril_indices(k)]


def _log_det(m: np.ndarray) -> np.ndarray:
    return np.linalg.slogdet(m)[1]


def _result(
    n: float, beta: np.ndarray, vcov: np.ndarray, lam: np.ndarray, scale: float, deviance: float, parameters: int, converged: bool,
    re: np.ndarray, re_var: np.ndarray,
) -> dict:
    return dict(
        n=float(n), beta=beta, vcov=vcov, cov=scale**2 * lam @ lam.T, singular=bool(np.abs(np.diag(lam)).min() < 1e-4),
        sigma=float(scale), loglik=-deviance / 2, aic=deviance + 2 * parameters, bic=deviance + parameters * np.log(n),
        converged=converged, re=re, re_var=re_var,
    )


def reml(a: np.ndarray, c: np.ndarray, q: float, n: float, log_weights: float, random: list[int]) -> dict:
    """Profiled REML of a linear mixed model from sums per group.

    ``a`` (groups, p, p) and ``c`` (groups, p) are weighted cross products of the
    terms with themselves and with the outcome, ``q`` is the outcome's own;
    ``random`` lists the terms whose coefficients vary between groups.
    """
    p, k, pick = a.shape[1], len(random), np.asarray(random)
    az, ax, cz = a[:, pick][:, :, pick], a[:, pick], c[:, pick]

    def profile(theta):
        lam = factor(theta, k)
        m = lam.T @ az @ lam + np.eye(k)
        la, lc = lam.T @ ax, cz @ lam
        ma, mc = np.linalg.solve(m, la), np.linalg.solve(m, lc[..., None])[..., 0]
        xvx = a.sum(0) - np.einsum("gki,gkj->ij", la, ma)
        xvy = c.sum(0) - np.einsum("gki,gk->i", la, mc)
        beta = np.linalg.solve(xvx, xvy)
        rss = q - np.einsum("gk,gk->", lc, mc) - beta @ xvy
        s2 = max(rss, 1e-12) / (n - p)
        deviance = _log_det(m).sum() + _log_det(xvx) + (n - p) * (1 + np.log(2 * np.pi * s2)) - log_weights
        return deviance, beta, xvx, s2, lam, m

    theta, deviance, converged = minimise(lambda t: profile(t)[0], _start(k))
    _, beta, xvx, s2, lam, m = profile(theta)
    u = np.linalg.solve(m, ((cz - ax @ beta) @ lam)[..., None])[..., 0]
    return _result(
        n, beta, s2 * np.linalg.inv(xvx), lam, np.sqrt(s2), deviance, p + len(theta) + 1, converged,
        u @ lam.T, s2 * (lam @ np.linalg.inv(m) @ lam.T),
    )


def laplace(x: np.ndarray, sw: np.ndarray, so: np.ndarray, n: float, g: np.ndarray, random: list[int]) -> dict:
    """Laplace maximum likelihood of a logistic mixed model from weighted cells.

    ``x`` has the terms of each cell, ``sw`` and ``so`` its trials and events, ``g``
    the number of its group. The search counts as converged only if the group
    effects settled in its last evaluation too.
    """
    z, p, k, count = x[:, random], x.shape[1], len(random), int(g.max()) + 1
    warm, settled = np.zeros((count, k)), True

    def per_group(values):
        flat = values.reshape(len(values), -1)
        sums = [np.bincount(g, weights=flat[:, i], minlength=count) for i in range(flat.shape[1])]
        return np.stack(sums, -1).reshape(count, *values.shape[1:])

    def fitted(params, u0):
        nonlocal settled
        lam = factor(params[:-p], k)
        zl, offset, u, settled = z @ lam, x @ params[-p:], u0.copy(), False
        for _ in range(50):
            eta = offset + np.einsum("ij,ij->i", zl, u[g])
            mean = 1 / (1 + np.exp(-eta))
            grad = per_group(zl * (so - sw * mean)[:, None]) - u
            v = sw * mean * (1 - mean)
            m = per_group(zl[:, :, None] * zl[:, None, :] * v[:, None, None]) + np.eye(k)
            step = np.linalg.solve(m, grad[..., None])[..., 0]
            largest = np.abs(step).max()
            u += step / max(1.0, largest / 5)
            if largest < 1e-8:
                settled = True
                break
        loglik = so @ eta - sw @ np.logaddexp(0, eta)
        return -2 * loglik + (u * u).sum() + _log_det(m).sum(), u, m, lam

    def deviance(params):
        nonlocal warm
        value, u, _, _ = fitted(params, warm)
        if not np.isfinite(value):
            warm = np.zeros((count, k))
            return 1e300
        warm = u
        return value

    share = min(max(so.sum() / sw.sum(), 1e-6), 1 - 1e-6)
    begin = np.concatenate([_start(k), np.zeros(p)])
    begin[-p] = np.log(share / (1 - share))
    best, value, converged = minimise(deviance, begin)
    # Curvature of the deviance gives the covariance of all parameters.
    size = len(best)
    h, hess, eye = 1e-3, np.zeros((size, size)), np.eye(size)
    for i in range(size):
        for j in range(i, size):
            corners = [(1, 1), (1, -1), (-1, 1), (-1, -1)]
            d = [a * b * deviance(best + h * (a * eye[i] + b * eye[j])) for a, b in corners]
            hess[i, j] = hess[j, i] = sum(d) / (4 * h * h)
    vcov = (2 * np.linalg.pinv(hess))[-p:, -p:]
    vcov[np.diag_indices(p)] = np.maximum(np.diag(vcov), 0.0)
    _, u, m, lam = fitted(best, warm)
    return _result(n, best[-p:], vcov, lam, 1.0, value, size, converged and settled, u @ lam.T, lam @ np.linalg.inv(m) @ lam.T)


def _straight(fit: dict, slope_only: bool) -> dict:
    """A fit with intercept and slope in the layout of the specification grid: both effects, zero where one is absent."""
    random = [1] if slope_only else [0, 1]
    groups = len(fit["re"])
    re, var, cov = np.zeros((groups, 2)), np.zeros((groups, 2, 2)), np.zeros((2, 2))
    re[:, random] = fit["re"]
    var[np.ix_(range(groups), random, random)] = fit["re_var"]
    cov[np.ix_(random, random)] = fit["cov"]
    sd = np.sqrt(np.diag(cov))
    cor = np.nan if slope_only or sd.min() == 0 else float(cov[0, 1] / (sd[0] * sd[1]))
    vcov = fit["vcov"]
    out = {k: v for k, v in fit.items() if k != "cov"}
    return out | dict(
        beta=[float(b) for b in fit["beta"]], vcov=[float(vcov[0, 0]), float(vcov[0, 1]), float(vcov[1, 1])],
        sd=[float(v) for v in sd], cor=cor, re=re, re_var=var,
    )


def reml_fit(suff: pd.DataFrame, slope_only: bool) -> dict:
    """REML of a linear growth model with intercept and slope from named sums per group."""
    s = {c: suff[c].to_numpy(float) for c in ("n", "sw", "swx", "swxx", "swy", "swxy", "swyy", "slw")}
    a = np.stack([np.stack([s["sw"], s["swx"]], -1), np.stack([s["swx"], s["swxx"]], -1)], -2)
    c = np.stack([s["swy"], s["swxy"]], -1)
    return _straight(reml(a, c, s["swyy"].sum(), s["n"].sum(), s["slw"].sum(), [1] if slope_only else [0, 1]), slope_only)


def laplace_fit(cells: pd.DataFrame, slope_only: bool) -> tuple[np.ndarray, dict]:
    """Logistic growth model with intercept and slope from weighted cells."""
    births, g = np.unique(cells["birth"].to_numpy(), return_inverse=True)
    age, sw, so = (cells[c].to_numpy(float) for c in ("age_s", "sw", "swo"))
    x = np.stack([np.ones_like(age), age], -1)
    fit = laplace(x, sw, so, float(cells["n"].sum()), g, [1] if slope_only else [0, 1])
    return births, _straight(fit, slope_only)
