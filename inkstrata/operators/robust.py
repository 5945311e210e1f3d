"""Anomaly detectors that a few bad rows don't move: robust covariance, the one-class machine."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kept import kept as _kept
from .learn import _flag_top, _matrix, _scored, quantile
from .profile import keyed_sample
from .stats import chi2_cdf


def _distance(x: np.ndarray, mean: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    y = x - mean
    return np.einsum("ij,jk,ik->i", y, inverse, y)


def _fits(df: DataFrame, vec: str, models: list[tuple], cuts: list[float]) -> list[tuple]:
    """(mean, covariance) of the rows within each model's cut: moments are summed by partition in one pass for
    all models."""
    d = len(models[0][0])

    def sums(frames):
        n, s, q = np.zeros(len(models)), np.zeros((len(models), d)), np.zeros((len(models), d, d))
        for f in frames:
            if len(f):
                x = _matrix(f, vec)
                for i, ((mean, inverse), cut) in enumerate(zip(models, cuts, strict=True)):
                    y = x[_distance(x, mean, inverse) <= cut] - models[0][0]
                    n[i], s[i], q[i] = n[i] + len(y), s[i] + y.sum(axis=0), q[i] + y.T @ y
        for i in range(len(models)):
            yield pd.DataFrame({"m": i, "at": np.arange(1 + d + d * d), "v": np.concatenate([[n[i]], s[i], q[i].ravel()])})

    rows = df.select(vec).mapInPandas(sums, "m int, at int, v double").groupBy("m", "at").agg(F.sum("v").alias("v")).orderBy("m", "at").collect()
    v = np.array([r["v"] for r in rows]).reshape(len(models), -1)
    out = []
    for x in v:
        n, s, q = max(x[0], 1), x[1 : 1 + d] / max(x[0], 1), x[1 + d :].reshape(d, d) / max(x[0], 1)
        out.append((s + models[0][0], q - np.outer(s, s)))
    return out


def _inverse(fit: tuple) -> tuple:
    return fit[0], np.linalg.pinv(fit[1], hermitian=True)


def _volume(fit: tuple) -> float:
    sign, log = np.linalg.slogdet(fit[1])
    return log if sign > 0 else -math.inf


def chi2_quantile(p: float, d: int) -> float:
    """By bisection of the distribution function."""
    low, high = 0.0, 10.0 * d + 100
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, d) < p else (low, mid)
    return (low + high) / 2


def minimum_covariance(df: DataFrame, key: str, vec: str, support: float | None = None, starts: int = 6, steps: int = 2, most: int = 12, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(mean, covariance) of the ``support`` share of rows whose covariance has the least determinant, brought
    to the scale of normal rows and weighted again.

    Starts are d + 1 rows each, of a keyed sample; concentration steps take the rows nearest by the last
    covariance, all starts in one pass over all rows, then the best two to the end.
    """
    df = _kept(df.select(key, vec))
    few = np.stack(keyed_sample(df.select(key, vec), key, 500).orderBy(key).toPandas()[vec].to_numpy()).astype(float)
    d, rng = few.shape[1], np.random.default_rng(seed)
    n = df.count()
    support = support if support is not None else min(1.0, (n + d + 1) / 2 / n)
    fits = []
    for _ in range(starts):
        x = few[rng.choice(len(few), min(len(few), d + 1), replace=False)]
        fits.append((x.mean(axis=0), np.cov(x, rowvar=False, bias=True).reshape(d, d) + 1e-9 * np.eye(d) * max(few.var(), 1e-12)))

    def cuts(models, exact):
        if exact:
            return [quantile(_scored(df.select(vec), vec, lambda x, m=m: _distance(x, *m), "_d"), "_d", support) for m in models]
        scored = df.select(vec)
        for i, m in enumerate(models):
            scored = _scored(scored, vec, lambda x, m=m: _distance(x, *m), f"_d{i}")
        return list(scored.agg(*[F.percentile_approx(f"_d{i}", support, 1000) for i in range(len(models))]).first())

    for _ in range(steps):
        models = [_inverse(f) for f in fits]
        fits = _fits(df, vec, models, cuts(models, False))
    fits = sorted(fits, key=_volume)[:2]
    for _ in range(most):
        models = [_inverse(f) for f in fits]
        new = _fits(df, vec, models, cuts(models, False))
        done = all(_volume(b) >= _volume(a) - 1e-9 for a, b in zip(fits, new, strict=True))
        fits = new
        if done:
            break
    best = min(fits, key=_volume)
    for weighted in (False, True):
        model = _inverse(best)
        middle = quantile(_scored(df.select(vec), vec, lambda x, m=model: _distance(x, *m), "_d"), "_d", 0.5)
        best = best[0], best[1] * middle / chi2_quantile(0.5, d)
        if not weighted:
            best = _fits(df, vec, [_inverse(best)], [chi2_quantile(0.975, d)])[0]
    return best


def robust_envelope(df: DataFrame, key: str, vec: str, share: float = 0.01, name: str = "anomaly_ee", **more) -> DataFrame:
    """-1 for the ``share`` of rows farthest by the minimum covariance determinant, 1 for the others."""
    model = _inverse(minimum_covariance(df, key, vec, **more))
    return _flag_top(_scored(df, vec, lambda x: _distance(x, *model), "_score"), "_score", share, name).drop("_score")


def one_class_machine(
    df: DataFrame, key: str, vec: str, nu: float = 0.01, features: int = 256, gamma: float | None = None, rounds: int = 12, name: str = "anomaly_svm", score: str | None = None, max_sample: int = 20_000
) -> DataFrame:
    """-1 for rows outside the one-class machine with a Gaussian kernel, 1 for the others.

    The nu-problem in random Fourier features: the direction is a mean of rows in which none weighs more than
    1 / (nu n). Each round puts that weight on the nu n rows that score least, whose mean is summed
    by partition, and goes there as far as the direction gets shorter, which leads to the optimum. The offset is the
    nu-quantile of the scores, so that a share of nu rows, those at the margin, is outside. Only the kernel's
    width comes from a sample. ``score`` names a column for the distance from the offset.
    """
    rest, df = df, _kept(df.select(key, vec))
    if gamma is None:
        sample = np.stack(keyed_sample(df.select(key, vec), key, max_sample).toPandas()[vec].to_numpy()).astype(float)
        gamma = 1 / max(sample.shape[1] * sample.var(), 1e-12)
    d = df.select(F.size(vec).alias("n")).first()["n"]
    rng = np.random.default_rng(0)
    w, b = rng.normal(size=(d, features)) * math.sqrt(2 * gamma), rng.uniform(0, 2 * math.pi, features)
    phi = lambda x: np.cos(x @ w + b) * math.sqrt(2 / features)

    def mean_of(direction, cut):
        """Of the features of rows that score at most ``cut``; all without a direction."""

        def sums(frames):
            total, n = np.zeros(features), 0
            for f in frames:
                if len(f):
                    p = phi(_matrix(f, vec))
                    p = p if direction is None else p[p @ direction <= cut]
                    total, n = total + p.sum(axis=0), n + len(p)
            yield pd.DataFrame({"i": np.arange(features), "s": total, "n": n})

        rows = df.select(vec).mapInPandas(sums, "i int, s double, n bigint").groupBy("i").agg((F.sum("s") / F.sum("n")).alias("m")).orderBy("i").collect()
        return np.array([r["m"] for r in rows])

    direction = mean_of(None, 0.0)
    for _ in range(rounds):
        cut = _scored(df.select(vec), vec, lambda x, u=direction: phi(x) @ u, "_s").agg(F.percentile_approx("_s", nu, 10_000)).first()[0]
        step = mean_of(direction, cut) - direction
        direction = direction + min(1.0, max(0.0, -float(direction @ step) / max(float(step @ step), 1e-300))) * step
    scored = _kept(_scored(df, vec, lambda x: phi(x) @ direction, "_s"))
    rho = quantile(scored, "_s", nu)
    scored = scored.select(F.col(key), "_s")
    out = rest.join(scored, key).withColumn(name, F.when(F.col("_s") < rho, -1).otherwise(1))
    return out.withColumn(score, F.col("_s") - rho).drop("_s") if score else out.drop("_s")
