"""Fits by aggregated moments: Spark sums them, the driver solves a small system (its size is the number of terms)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel


def _solve(a: np.ndarray, b: np.ndarray, ridge: float) -> np.ndarray:
    return np.linalg.solve(a + ridge * np.eye(len(b)), b)


def weighted_least_squares(rows: DataFrame, y: Column, terms: Sequence[Column], weight: Column | None = None, ridge: float = 0.0) -> list[float]:
    """Coefficients (intercept first) of y on ``terms``; one aggregation of X'WX and X'Wy. Rows with a null go."""
    w = F.lit(1.0) if weight is None else weight
    x = [F.lit(1.0), *terms]
    rows = rows.select(y.cast("double").alias("y"), w.cast("double").alias("w"), *[c.cast("double").alias(f"x{i}") for i, c in enumerate(x)]).dropna()
    k = len(x)
    sums = [F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]
    sums += [F.sum(F.col("w") * F.col(f"x{i}") * F.col("y")).alias(f"b{i}") for i in range(k)]
    m = rows.agg(*sums).first()
    a = np.array([[m[f"a{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    return _solve(a, np.array([m[f"b{i}"] or 0.0 for i in range(k)]), ridge).tolist()


def _cells(rows: DataFrame, y: Column, x: Sequence[Column], discrete: bool) -> DataFrame:
    """y, the terms and ``n``, persisted for the steps of a fit: rows, or, of discrete terms, their distinct values counted."""
    rows = rows.select(y.cast("double").alias("y"), *[c.cast("double").alias(f"x{i}") for i, c in enumerate(x)]).dropna()
    cells = rows.groupBy(*rows.columns).agg(F.count("*").cast("double").alias("n")) if discrete else rows.withColumn("n", F.lit(1.0))
    return cells.persist(StorageLevel.MEMORY_AND_DISK)


def logistic(rows: DataFrame, y: Column, terms: Sequence[Column], ridge: float = 1e-6, steps: int = 8, tolerance: float = 1e-10, discrete: bool = False) -> list[float]:
    """Coefficients (intercept first) of a logistic model by Newton's method; each step is one aggregation of the cells."""
    x = [F.lit(1.0), *terms]
    rows = _cells(rows, y, x, discrete)
    k, beta = len(x), np.zeros(len(x))
    for _ in range(steps):
        eta = sum((float(b) * F.col(f"x{i}") for i, b in enumerate(beta)), F.lit(0.0))
        p = rows.withColumn("p", 1 / (1 + F.exp(-eta)))
        v = F.col("n") * F.col("p") * (1 - F.col("p"))
        sums = [F.sum(v * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]
        sums += [F.sum(F.col("n") * (F.col("y") - F.col("p")) * F.col(f"x{i}")).alias(f"b{i}") for i in range(k)]
        m = p.agg(*sums).first()
        a = np.array([[m[f"a{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
        step = _solve(a, np.array([m[f"b{i}"] or 0.0 for i in range(k)]) - ridge * beta, ridge)
        beta = beta + step
        if np.abs(step).max() < tolerance:
            break
    rows.unpersist()
    return beta.tolist()


def count_regression(rows: DataFrame, y: Column, terms: Sequence[Column], dispersion: float, steps: int = 10, ridge: float = 1e-6, discrete: bool = False) -> list[float]:
    """Negative binomial regression with log link and fixed dispersion by Fisher scoring; each step is one aggregation of the cells."""
    x = [F.lit(1.0), *terms]
    rows = _cells(rows, y, x, discrete)
    k = len(x)
    mean = rows.agg(F.sum(F.col("n") * F.col("y")) / F.sum("n")).first()[0] or 1.0
    beta = np.zeros(k)
    beta[0] = np.log(max(mean, 1e-9))
    for _ in range(steps):
        eta = sum((float(b) * F.col(f"x{i}") for i, b in enumerate(beta)), F.lit(0.0))
        p = rows.withColumn("m", F.exp(eta))
        w = F.col("n") * F.col("m") / (1 + dispersion * F.col("m"))
        g = F.col("n") * (F.col("y") - F.col("m")) / (1 + dispersion * F.col("m"))
        sums = [F.sum(w * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]
        sums += [F.sum(g * F.col(f"x{i}")).alias(f"b{i}") for i in range(k)]
        m = p.agg(*sums).first()
        a = np.array([[m[f"a{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
        step = _solve(a, np.array([m[f"b{i}"] or 0.0 for i in range(k)]) - ridge * beta, ridge)
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    rows.unpersist()
    return beta.tolist()


def cluster_errors(rows: DataFrame, y: Column, terms: Sequence[Column], beta: Sequence[float], cluster: Column) -> tuple[list[float], int]:
    """Standard errors of a logistic fit that hold when rows of a cluster go together, and the number of clusters.

    Two aggregations: scores and information are summed by cluster, then the outer products of the clusters' scores. The
    sandwich has the factor C / (C - 1).
    """
    x = [F.lit(1.0), *terms]
    k = len(x)
    rows = rows.select(y.cast("double").alias("y"), cluster.alias("cluster"), *[c.cast("double").alias(f"x{i}") for i, c in enumerate(x)]).dropna()
    p = rows.withColumn("p", 1 / (1 + F.exp(-sum((float(b) * F.col(f"x{i}") for i, b in enumerate(beta)), F.lit(0.0)))))
    v = F.col("p") * (1 - F.col("p"))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    by_cluster = p.groupBy("cluster").agg(
        *[F.sum((F.col("y") - F.col("p")) * F.col(f"x{i}")).alias(f"u{i}") for i in range(k)], *[F.sum(v * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"a{i}_{j}") for i, j in pairs]
    )
    m = by_cluster.agg(F.count("*").alias("n"), *[F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m{i}_{j}") for i, j in pairs], *[F.sum(f"a{i}_{j}").alias(f"a{i}_{j}") for i, j in pairs]).first()
    full = lambda c: np.array([[m[f"{c}{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    inverse = np.linalg.inv(full("a"))
    sandwich = inverse @ full("m") @ inverse * m["n"] / (m["n"] - 1)
    return np.sqrt(np.diag(sandwich)).tolist(), m["n"]


def dispersed_counts(rows: DataFrame, y: Column, terms: Sequence[Column], offset: Column | None = None, ridge: float = 1.0, steps: int = 60, tolerance: float = 1e-8, discrete: bool = False) -> dict:
    """Negative binomial regression with log link whose dispersion follows the mean: ``log mu = offset + b x`` and
    ``log alpha = a0 + a1 log mu``, mean and dispersion fitted jointly by Newton's method with halved steps.

    Each step is one aggregation of log-likelihood, gradient and second derivatives over the (counted) cells; digamma and
    trigamma differences are finite sums over a count. It ends with the first step that moves no parameter by more than
    ``tolerance``: a small gradient alone leaves a parameter of little curvature open. ``ridge`` holds the terms, not the intercept. Returns ``beta``
    (intercept first), ``a0``, ``a1``, ``loglik`` (without terms of y alone), ``gradient`` (its largest element) and ``n``.
    """
    x = [F.lit(1.0), *terms]
    k = len(x)
    off = F.lit(0.0) if offset is None else offset
    named = [y.cast("double").alias("y"), off.cast("double").alias("off"), *[c.cast("double").alias(f"x{i}") for i, c in enumerate(x)]]
    cells = rows.select(*named).dropna()
    cells = cells.groupBy(*cells.columns).agg(F.count("*").cast("double").alias("n")) if discrete else cells.withColumn("n", F.lit(1.0))
    cells = cells.persist(StorageLevel.MEMORY_AND_DISK)
    start = cells.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("y"), F.sum(F.col("n") * F.col("off")).alias("o")).first()
    theta = np.zeros(k + 2)
    theta[0], theta[k] = np.log(max(start["y"] / start["n"], 1e-9)) - start["o"] / start["n"], np.log(0.3)
    penalty = np.array([0.0, *[ridge] * (k - 1), 0.0, 0.0])

    def at(t: np.ndarray):
        """Penalised log-likelihood, gradient and Hessian."""
        eta = F.col("off") + sum((float(b) * F.col(f"x{i}") for i, b in enumerate(t[:k])), F.lit(0.0))
        z = cells.withColumn("eta", eta).withColumn("mu", F.exp("eta")).withColumn("r", F.exp(-(float(t[k]) + float(t[k + 1]) * F.col("eta"))))
        r, mu, yy = F.col("r"), F.col("mu"), F.col("y")
        below = F.when(yy > 0, F.sequence(F.lit(0), yy.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
        total = lambda f: F.aggregate(below, F.lit(0.0), lambda acc, j: acc + f(r + j))
        z = z.withColumns({"s0": total(F.log), "s1": total(lambda v: 1 / v), "s2": total(lambda v: 1 / (v * v))})
        q = F.col("s1") + F.log(r / (r + mu)) + (mu - yy) / (r + mu)
        dq = -F.col("s2") + 1 / r - 1 / (r + mu) - (mu - yy) / ((r + mu) * (r + mu))
        z = z.withColumns({
            "l": F.col("s0") + r * F.log(r / (r + mu)) + yy * F.log(mu / (r + mu)),
            "g": r * (yy - mu) / (r + mu), "h": -r * q,
            "ee": -mu * r * (r + yy) / ((r + mu) * (r + mu)), "el": -r * mu * (yy - mu) / ((r + mu) * (r + mu)), "ll": r * q + r * r * dq,
        })
        a1, n, h, ee, el, ll, e = float(t[k + 1]), F.col("n"), F.col("h"), F.col("ee"), F.col("el"), F.col("ll"), F.col("eta")
        # how eta and log alpha move with each parameter
        by_eta = [F.col(f"x{i}") for i in range(k)] + [F.lit(0.0), F.lit(0.0)]
        by_log = [a1 * F.col(f"x{i}") for i in range(k)] + [F.lit(1.0), e]
        sums = [F.sum(n * F.col("l")).alias("l"), *[F.sum(n * (F.col("g") * by_eta[i] + h * by_log[i])).alias(f"g{i}") for i in range(k + 2)]]
        for i in range(k + 2):
            for j in range(i, k + 2):
                second = ee * by_eta[i] * by_eta[j] + el * (by_eta[i] * by_log[j] + by_log[i] * by_eta[j]) + ll * by_log[i] * by_log[j]
                sums.append(F.sum(n * (second + h * by_eta[i] if i < k and j == k + 1 else second)).alias(f"h{i}_{j}"))
        m = z.agg(*sums).first()
        gradient = np.array([m[f"g{i}"] for i in range(k + 2)]) - penalty * t
        hessian = np.array([[m[f"h{min(i, j)}_{max(i, j)}"] for j in range(k + 2)] for i in range(k + 2)]) - np.diag(penalty)
        return m["l"] - 0.5 * float(penalty @ (t * t)), gradient, hessian

    value, gradient, hessian = at(theta)
    for _ in range(steps):
        curve = -hessian
        while np.linalg.eigvalsh(curve)[0] <= 0:  # far from the optimum: towards the gradient
            curve = curve + np.eye(k + 2) * max(1.0, -2 * np.linalg.eigvalsh(curve)[0])
        step = np.linalg.lstsq(curve, gradient, rcond=1e-12)[0]  # what the rows leave open stays where it is
        for _ in range(30):
            tried = at(theta + step)
            if tried[0] >= value - 1e-9 * abs(value):
                break
            step = step / 2
        theta = theta + step
        value, gradient, hessian = tried
        if np.abs(step).max() <= tolerance:
            break
    cells.unpersist()
    return {"beta": theta[:k].tolist(), "a0": float(theta[k]), "a1": float(theta[k + 1]), "loglik": float(value), "gradient": float(np.abs(gradient).max()), "n": start["n"]}


def predict(beta: Sequence[float], terms: Sequence[Column]) -> Column:
    return sum((float(b) * t for b, t in zip(beta[1:], terms, strict=True)), F.lit(float(beta[0])))


def standardised(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns mean-filled, centred and scaled by their sample standard deviation (``z_`` names)."""
    stats = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"s_{c}") for c in columns])
    out = rows.crossJoin(F.broadcast(stats))
    z = {f"z_{c}": (F.coalesce(F.col(c), F.col(f"m_{c}")) - F.col(f"m_{c}")) / F.nullif(F.col(f"s_{c}"), F.lit(0.0)) for c in columns}
    return out.withColumns(z).drop(*[f"{p}_{c}" for p in "ms" for c in columns])
