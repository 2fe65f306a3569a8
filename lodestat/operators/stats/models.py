"""Regression procedures from sums of products.

Every pass over the data is one aggregation whose result has a size set by the number of terms; the
driver solves systems of that size. Where a likelihood needs functions Spark lacks, batches are summed
in numpy before one aggregation. Results: one row per term.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions import dist
from lodestat.operators.preprocess import AnalysisError, complete_cases, design, number

_RESULT = "term string, estimate double, std_error double, statistic double, p_value double, ci_low double, ci_high double"


def _frame(df: DataFrame, outcome: str, predictors: Sequence[str], extra: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    d, terms = design(complete_cases(df, [outcome, *predictors, *extra]), predictors)
    return d.withColumn("y", number(outcome)), terms


def _dot(b: Sequence[float], x: str = "x") -> Column:
    out = F.lit(0.0)
    for i, v in enumerate(b):
        out = out + F.col(x)[i] * F.lit(float(v))
    return out


def _products(k: int, weight: Column = None, y: Column | None = None) -> list[Column]:
    w = F.lit(1.0) if weight is None else weight
    out = [F.sum(w * F.col("x")[i] * F.col("x")[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]
    if y is not None:
        out += [F.sum(w * F.col("x")[i] * y).alias(f"b{i}") for i in range(k)]
    return out


def _matrix(row, k: int, p: str = "a") -> np.ndarray:
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = row[f"{p}{i}_{j}"]
    return m


def _vector(row, k: int, p: str = "b") -> np.ndarray:
    return np.array([row[f"{p}{i}"] for i in range(k)], float)


def _inverse(a: np.ndarray) -> np.ndarray:
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    return np.linalg.pinv(a / np.outer(scale, scale), rcond=1e-12) / np.outer(scale, scale)


def term_rows(df: DataFrame, terms: Sequence[str], b: np.ndarray, cov: np.ndarray, dof: float | None, alpha: float = 0.05) -> DataFrame:
    """Wald rows: t with dof, else normal."""
    rows = []
    q = dist.t_ppf(1 - alpha / 2, dof) if dof else dist.norm_ppf(1 - alpha / 2)
    for t, e, s in zip(terms, b, np.sqrt(np.maximum(np.diag(cov), 0.0))):
        z = e / s if s > 0 else math.nan
        p = (dist.t_two_sided(z, dof) if dof else 2 * dist.norm_sf(abs(z))) if s > 0 else math.nan
        rows.append((t, *[None if math.isnan(v) or math.isinf(v) else float(v) for v in (e, s, z, p, e - q * s, e + q * s)]))
    return df.sparkSession.createDataFrame(rows, _RESULT)


def _ols(d: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, int, float, float]:
    r = d.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("my"), *_products(k, y=F.col("y"))).first()
    if r["n"] <= k:
        raise AnalysisError("too few complete observations")
    inv = _inverse(_matrix(r, k))
    b = inv @ _vector(r, k)
    s = d.agg(F.sum((F.col("y") - _dot(b)) ** 2).alias("rss"), F.sum((F.col("y") - r["my"]) ** 2).alias("tss")).first()
    return b, inv, r["n"], s["rss"], s["tss"]


def ols(df: DataFrame, outcome: str, predictors: Sequence[str], covariance: str = "classical", alpha: float = 0.05) -> DataFrame:
    """Least squares; classical covariance with t, or HC3 with normal inference (also for ancova)."""
    d, terms = _frame(df, outcome, predictors)
    k = len(terms)
    b, inv, n, rss, _ = _ols(d, k)
    if covariance == "classical":
        return term_rows(df, terms, b, inv * rss / (n - k), float(n - k), alpha)
    h = F.lit(0.0)
    for i in range(k):
        for j in range(k):
            h = h + F.col("x")[i] * F.col("x")[j] * F.lit(float(inv[i, j]))
    w = (F.col("y") - _dot(b)) ** 2 / (1 - h) ** 2
    meat = _matrix(d.withColumn("w", w).agg(*_products(k, F.col("w"))).first(), k)
    return term_rows(df, terms, b, inv @ meat @ inv, None, alpha)


def regression_f_test(df: DataFrame, outcome: str, predictors: Sequence[str]) -> DataFrame:
    d, terms = _frame(df, outcome, predictors)
    k = len(terms)
    _, _, n, rss, tss = _ols(d, k)
    f = ((tss - rss) / (k - 1)) / (rss / (n - k))
    return df.sparkSession.createDataFrame([(n, f, k - 1, n - k, 1 - rss / tss, dist.f_sf(f, k - 1, n - k))], "n bigint, statistic double, df_model int, df_resid int, r_squared double, p_value double")


def exact_median(df: DataFrame, value: str, accuracy: int = 10_000) -> float:
    """The median (mean of the two middle ones) of finite numbers, 0 without any. An approximate quantile on
    either side brackets it; only the rows between them, about 4 / accuracy of all, are sorted."""
    d = df.where(F.col(value).isNotNull())
    ask = [0.5 - 2 / accuracy, 0.5 + 2 / accuracy]
    lo, hi = d.agg(F.percentile_approx(value, ask, accuracy).alias("q")).first()["q"] or (None, None)
    if lo is None:
        return 0.0
    r = d.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(value) < lo, 1)).alias("below")).first()
    between = d.where(F.col(value).between(lo, hi)).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    left, right = (r["n"] - 1) // 2 - r["below"], r["n"] // 2 - r["below"]
    w = Window.orderBy(value)
    upto = between.withColumn("upto", F.sum("n").over(w))
    pick = lambda k: F.min(F.when(F.col("upto") > k, F.col(value)))
    a, b = upto.agg(pick(left), pick(right)).first()
    return (a + b) / 2


def huber(df: DataFrame, outcome: str, predictors: Sequence[str], t: float = 1.345, rounds: int = 50) -> DataFrame:
    """M-estimate with Huber weights; scale from the (exact) median absolute residual, each round."""
    d, terms = _frame(df, outcome, predictors)
    k = len(terms)
    d = d.select("x", "y").cache()
    b = _ols(d, k)[0]
    scale = 1.0
    for _ in range(rounds):
        e = F.col("y") - _dot(b)
        scale = exact_median(d.select(F.abs(e).alias("e")), "e") / 0.6744897501960817
        if scale <= 0:
            break
        w = F.least(F.lit(1.0), F.lit(t * scale) / F.greatest(F.abs(e), F.lit(1e-300)))
        r = d.withColumn("w", w).agg(*_products(k, F.col("w"), F.col("y"))).first()
        new = _inverse(_matrix(r, k)) @ _vector(r, k)
        done = np.max(np.abs(new - b)) <= 1e-8 * max(1.0, np.max(np.abs(new)))
        b = new
        if done:
            break
    u = (F.col("y") - _dot(b)) / scale if scale > 0 else F.lit(0.0)
    psi = F.greatest(F.lit(-t), F.least(F.lit(t), u))
    r = d.agg(F.count(F.lit(1)).alias("n"), F.sum(psi**2).alias("s"), F.avg((F.abs(u) <= t).cast("double")).alias("m"), *_products(k)).first()
    d.unpersist()
    n, m = r["n"], r["m"] or 1.0
    kappa = 1 + k / n * (1 - m) / m
    cov = kappa**2 * (r["s"] * scale**2 / (n - k)) / m**2 * _inverse(_matrix(r, k))
    return term_rows(df, terms, b, cov, None)


def iv_2sls(df: DataFrame, outcome: str, exposure: str, instruments: Sequence[str], covariates: Sequence[str] = ()) -> DataFrame:
    """Two-stage least squares; residuals use the actual exposure; normal inference."""
    base = complete_cases(df, [outcome, exposure, *instruments, *covariates])
    d, terms = design(base, [exposure, *covariates])
    d = d.withColumnRenamed("x", "__xx")
    d, zterms = design(d, [*instruments, *covariates])
    d = d.withColumnRenamed("x", "__z").withColumn("y", number(outcome))
    k, m = len(terms), len(zterms)
    if m < k:
        raise AnalysisError("fewer instruments than coefficients")
    s = [F.sum(F.col("__z")[i] * F.col("__z")[j]).alias(f"a{i}_{j}") for i in range(m) for j in range(i, m)]
    s += [F.sum(F.col("__z")[i] * F.col("__xx")[j]).alias(f"c{i}_{j}") for i in range(m) for j in range(k)]
    s += [F.sum(F.col("__z")[i] * F.col("y")).alias(f"b{i}") for i in range(m)]
    r = d.agg(F.count(F.lit(1)).alias("n"), *s).first()
    zz, zx, zy = _inverse(_matrix(r, m)), np.array([[r[f"c{i}_{j}"] for j in range(k)] for i in range(m)]), _vector(r, m)
    inv = _inverse(zx.T @ zz @ zx)
    b = inv @ zx.T @ zz @ zy
    rss = d.agg(F.sum((F.col("y") - _dot(b, "__xx")) ** 2).alias("v")).first()["v"]
    return term_rows(df, terms, b, inv * rss / (r["n"] - k), None)


def _newton(d: DataFrame, k: int, step: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], start: np.ndarray, rounds: int = 60, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray, bool]:
    b = start
    info = np.eye(k)
    for _ in range(rounds):
        score, info = step(b)
        move = _inverse(info) @ score
        big = np.max(np.abs(move))
        b = b + move * min(1.0, 5.0 / big if big > 0 else 1.0)
        if big <= tol * max(1.0, np.max(np.abs(b))):
            return b, info, True
    return b, info, False


def glm(df: DataFrame, outcome: str, predictors: Sequence[str], family: str, ridge: float = 0.0) -> tuple[DataFrame, DataFrame, np.ndarray, list[str], np.ndarray, bool]:
    """Canonical logistic or Poisson fit, in column expressions. ridge penalises all but the constant."""
    d, terms = _frame(df, outcome, predictors)
    d = d.select("x", "y").cache()
    k = len(terms)
    pen = np.diag([0.0] + [ridge] * (k - 1))

    def step(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        eta = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), _dot(b)))
        mu = 1 / (1 + F.exp(-eta)) if family == "binomial" else F.exp(eta)
        w = mu * (1 - mu) if family == "binomial" else mu
        r = d.withColumns({"w": w, "e": F.col("y") - mu}).agg(*_products(k, F.col("w")), *[F.sum(F.col("x")[i] * F.col("e")).alias(f"b{i}") for i in range(k)]).first()
        return _vector(r, k) - pen @ b, _matrix(r, k) + pen

    b, info, done = _newton(d, k, step, np.zeros(k))
    return df, d, b, terms, info, done


def _likelihood(d: DataFrame, b: np.ndarray, family: str) -> float:
    eta = _dot(b)
    if family == "binomial":
        v = F.col("y") * eta - F.when(eta > 30, eta).otherwise(F.log1p(F.exp(F.least(eta, F.lit(30.0)))))
        return d.agg(F.sum(v).alias("v")).first()["v"]
    raw = batch_sums(d, lambda x, y, beta: _poisson_ll(x, y, beta), b, 1)
    return float(raw[0])


def _poisson_ll(x: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
    eta = x @ b
    return np.array([np.sum(y * eta - np.exp(eta) - _lgamma(y + 1))])


def _fit_glm(df: DataFrame, outcome: str, predictors: Sequence[str], family: str) -> DataFrame:
    _, d, b, terms, info, done = glm(df, outcome, predictors, family)
    aic = -2 * _likelihood(d, b, family) + 2 * len(b)
    d.unpersist()
    return term_rows(df, terms, b, _inverse(info), None).withColumn("aic", F.lit(aic)).withColumn("converged", F.lit(done))


def logistic_glm(df: DataFrame, outcome: str, predictors: Sequence[str]) -> DataFrame:
    return _fit_glm(df, outcome, predictors, "binomial")


def poisson_glm(df: DataFrame, outcome: str, predictors: Sequence[str]) -> DataFrame:
    return _fit_glm(df, outcome, predictors, "poisson")


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of gamma for positive arguments: Stirling's series eight steps further on."""
    x = np.array(x, float)
    shift = np.zeros_like(x)
    for _ in range(8):
        shift += np.log(x)
        x = x + 1.0
    i = 1.0 / x
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + i / 12 - i**3 / 360 + i**5 / 1260 - i**7 / 1680 + i**9 / 1188 - shift


def _erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function: the series of positive terms up to 3, the continued fraction beyond."""
    x = np.asarray(x, float)
    a = np.abs(x)
    near, far = np.minimum(a, 3.0), np.clip(a, 3.0, 27.0)
    term = near.copy()
    total = term.copy()
    for n in range(1, 70):
        term = term * (2 * near * near / (2 * n + 1))
        total += term
    small = 1 - 2 / math.sqrt(math.pi) * np.exp(-near * near) * total
    tail = np.zeros_like(far)
    for n in range(60, 0, -1):
        tail = (n / 2) / (far + tail)
    large = np.exp(-far * far) / math.sqrt(math.pi) / (far + tail)
    out = np.where(a <= 3.0, small, np.where(a > 27.0, 0.0, large))
    return np.where(x < 0, 2 - out, out)


def _phi(z: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


def _cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(-z / math.sqrt(2))


def batch_sums(d: DataFrame, fn: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], b: np.ndarray, size: int) -> np.ndarray:
    """Sum of fn(X, y, b) over all batches of (x, y): an array per batch, then one aggregation."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            if len(y):
                x = np.array(batch.column(0).flatten(), float).reshape(len(y), -1)
                total += fn(x, y, b)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    parts = d.select("x", "y").mapInArrow(run, "v array<double>")
    r = parts.agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(size)]).first()
    return np.array([r[i] or 0.0 for i in range(size)])


def _packed(score: np.ndarray, info: np.ndarray, ll: float) -> np.ndarray:
    return np.concatenate(([ll], score, info.ravel()))


def _maximise(d: DataFrame, fn, k: int, start: np.ndarray, rounds: int = 80, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray, float, bool]:
    """Newton with step halving; fn returns (log-likelihood, score, information) sums packed."""
    b, lam = start, 0.0
    v = batch_sums(d, fn, b, 1 + k + k * k)
    for _ in range(rounds):
        ll, score, info = v[0], v[1 : 1 + k], v[1 + k :].reshape(k, k)
        eig = np.linalg.eigvalsh(info)
        lam = max(0.0, 1e-6 - eig[0])
        move = np.linalg.solve(info + lam * np.eye(k), score)
        size = 1.0
        while True:
            new = b + size * move
            v = batch_sums(d, fn, new, 1 + k + k * k)
            if v[0] >= ll - 1e-12 * abs(ll) or size < 1e-6:
                break
            size /= 2
        b = new
        if np.max(np.abs(size * move)) <= tol * max(1.0, np.max(np.abs(b))):
            return b, v[1 + k :].reshape(k, k), v[0], True
    return b, v[1 + k :].reshape(k, k), v[0], False


def probit_glm(df: DataFrame, outcome: str, predictors: Sequence[str]) -> DataFrame:
    d, terms = _frame(df, outcome, predictors)
    d, k = d.select("x", "y").cache(), len(terms)

    def fn(x: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
        q = 2 * y - 1
        z = q * (x @ b)
        p = np.maximum(_cdf(z), 1e-300)
        m = q * _phi(z) / p
        w = m * (m + x @ b)
        return _packed(x.T @ m, (x * w[:, None]).T @ x, float(np.log(p).sum()))

    b, info, ll, done = _maximise(d, fn, k, np.zeros(k))
    d.unpersist()
    return term_rows(df, terms, b, _inverse(info), None).withColumn("aic", F.lit(-2 * ll + 2 * k)).withColumn("converged", F.lit(done))


def _digamma(x: np.ndarray, order: int = 0) -> np.ndarray:
    """Digamma (order 0) or trigamma (order 1) for positive arguments."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(8):
        out += -1.0 / x if order == 0 else 1.0 / x**2
        x = x + 1.0
    i = 1.0 / x
    if order == 0:
        return out + np.log(x) - i / 2 - i**2 / 12 + i**4 / 120 - i**6 / 252 + i**8 / 240
    return out + i + i**2 / 2 + i**3 / 6 - i**5 / 30 + i**7 / 42 - i**9 / 30


def negative_binomial_glm(df: DataFrame, outcome: str, predictors: Sequence[str], rounds: int = 40) -> DataFrame:
    """Log link with theta estimated: fits of the coefficients and Newton steps on theta in turn."""
    d, terms = _frame(df, outcome, predictors)
    d, k = d.select("x", "y").cache(), len(terms)
    _, d0, b, _, _, _ = glm(df, outcome, predictors, "poisson")
    d0.unpersist()
    theta = 1.0

    def of_theta(x: np.ndarray, y: np.ndarray, p: np.ndarray) -> np.ndarray:
        t, mu = p[-1], np.exp(np.clip(x @ p[:-1], -30, 30))
        s = _digamma(t + y) - _digamma(np.full_like(y, t)) + math.log(t) + 1 - np.log(t + mu) - (y + t) / (mu + t)
        i = -_digamma(t + y, 1) + _digamma(np.full_like(y, t), 1) - 1 / t + 2 / (mu + t) - (y + t) / (mu + t) ** 2
        ll = _lgamma(t + y) - math.lgamma(t) - _lgamma(y + 1) + t * math.log(t) + y * np.log(mu) - (t + y) * np.log(t + mu)
        return np.array([ll.sum(), s.sum(), i.sum()])

    def of_b(x: np.ndarray, y: np.ndarray, p: np.ndarray) -> np.ndarray:
        t, mu = p[-1], np.exp(np.clip(x @ p[:-1], -30, 30))
        w = mu / (1 + mu / t)
        return _packed(x.T @ ((y - mu) / (1 + mu / t)), (x * w[:, None]).T @ x, 0.0)

    info, ll, done = np.eye(k), 0.0, False
    for _ in range(rounds):
        v = batch_sums(d, of_b, np.append(b, theta), 1 + k + k * k)
        info = v[1 + k :].reshape(k, k)
        move = _inverse(info) @ v[1 : 1 + k]
        b = b + move
        ll, s, i = batch_sums(d, of_theta, np.append(b, theta), 3)
        new = theta + s / i if i > 0 else theta * 2
        new = min(max(new, theta / 4), theta * 4)
        done = np.max(np.abs(move)) < 1e-8 and abs(new - theta) < 1e-7 * theta
        theta = new
        if done or theta > 1e8:
            break
    d.unpersist()
    return term_rows(df, terms, b, _inverse(info), None).withColumn("theta", F.lit(float(theta))).withColumn("aic", F.lit(float(-2 * ll + 2 * (k + 1)))).withColumn("converged", F.lit(bool(done)))


def tobit_regression(df: DataFrame, outcome: str, predictors: Sequence[str], left: float | None = None, right: float | None = None) -> DataFrame:
    """Censored normal likelihood, log sigma as last parameter; left defaults to the least outcome."""
    d, terms = _frame(df, outcome, predictors)
    d, k = d.select("x", "y").cache(), len(terms)
    if left is None:
        left = d.agg(F.min("y")).first()[0]
    b0, _, n, rss, _ = _ols(d, k)
    lo, hi = float(left), math.inf if right is None else float(right)

    def ll_of(x: np.ndarray, y: np.ndarray, p: np.ndarray) -> np.ndarray:
        s = math.exp(p[-1])
        xb = x @ p[:-1]
        at_lo, at_hi = y <= lo, y >= hi
        out = -0.5 * ((y - xb) / s) ** 2 - p[-1] - 0.5 * math.log(2 * math.pi)
        out[at_lo] = np.log(np.maximum(_cdf((lo - xb[at_lo]) / s), 1e-300))
        if hi < math.inf:
            out[at_hi] = np.log(np.maximum(_cdf((xb[at_hi] - hi) / s), 1e-300))
        return out

    def fn(x: np.ndarray, y: np.ndarray, p: np.ndarray) -> np.ndarray:
        m = len(p)
        s = math.exp(p[-1])
        xb = x @ p[:-1]
        r = (y - xb) / s
        at_lo, at_hi = y <= lo, y >= hi
        gx, gl = r / s, r * r - 1  # derivatives by the mean and by log sigma
        hxx, hxl, hll = np.full_like(r, 1 / s**2), 2 * r / s, 2 * r * r
        for at, bound, sign in ((at_lo, lo, -1.0), (at_hi, hi, 1.0)):
            if math.isinf(bound) or not at.any():
                continue
            z = sign * (xb[at] - bound) / s
            lam = _phi(z) / np.maximum(_cdf(z), 1e-300)
            dl = lam * (lam + z)
            gx[at], gl[at] = sign * lam / s, -z * lam
            hxx[at], hxl[at], hll[at] = dl / s**2, sign * (lam - z * dl) / s, -z * lam + z * z * dl
        score = np.append(x.T @ gx, gl.sum())
        info = np.zeros((m, m))
        info[:-1, :-1] = (x * hxx[:, None]).T @ x
        info[:-1, -1] = info[-1, :-1] = x.T @ hxl
        info[-1, -1] = hll.sum()
        return _packed(score, info, float(ll_of(x, y, p).sum()))

    start = np.append(b0, 0.5 * math.log(max(rss / n, 1e-12)))
    b, info, ll, done = _maximise(d, fn, k + 1, start)
    d.unpersist()
    return term_rows(df, [*terms, "log_sigma"], b, _inverse(info), None).withColumn("log_likelihood", F.lit(float(ll))).withColumn("converged", F.lit(done))


#: Fixed values of the Firth fit: rounds, floor of the weights, largest step, tolerance.
FIRTH_ROUNDS, FIRTH_FLOOR, FIRTH_STEP, FIRTH_TOLERANCE = 100, 1e-9, 5.0, 1e-8


def firth_logistic(df: DataFrame, outcome: str, predictors: Sequence[str], rounds: int = FIRTH_ROUNDS) -> DataFrame:
    """Logistic fit with Jeffreys' penalty: information first, then the score with leverages."""
    d, terms = _frame(df, outcome, predictors)
    d, k = d.select("x", "y").cache(), len(terms)

    def info_of(x: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
        p = dist.logit(x @ b)
        return ((x * np.maximum(p * (1 - p), FIRTH_FLOOR)[:, None]).T @ x).ravel()

    b, done = np.zeros(k), False
    inv = np.eye(k)
    for _ in range(rounds):
        inv = _inverse(batch_sums(d, info_of, b, k * k).reshape(k, k))

        def score_of(x: np.ndarray, y: np.ndarray, b: np.ndarray, inv: np.ndarray = inv) -> np.ndarray:
            p = dist.logit(x @ b)
            w = np.maximum(p * (1 - p), FIRTH_FLOOR)
            h = w * np.einsum("ij,jk,ik->i", x, inv, x)
            return x.T @ (y - p + h * (0.5 - p))

        move = inv @ batch_sums(d, score_of, b, k)
        move *= min(1.0, FIRTH_STEP / max(np.max(np.abs(move)), 1e-300))
        b = b + move
        if np.max(np.abs(move)) < FIRTH_TOLERANCE:
            done = True
            break
    d.unpersist()
    return term_rows(df, terms, b, inv, None).withColumn("converged", F.lit(done))


def ipw(df: DataFrame, outcome: str, treatment: str, covariates: Sequence[str], clip: float = 0.01) -> DataFrame:
    """Hajek contrast with propensities from a ridge logistic fit (penalty 1), clipped; effective sizes."""
    base = complete_cases(df, [outcome, treatment, *covariates])
    _, d0, b, _, _, _ = glm(base, treatment, covariates, "binomial", ridge=1.0)
    d0.unpersist()
    d, _ = _frame(base, outcome, covariates, [treatment])
    p = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), 1 / (1 + F.exp(-_dot(b)))))
    t = number(treatment)
    d = d.withColumn("w", F.when(t == 1, 1 / p).otherwise(1 / (1 - p))).withColumn("t", t)
    s = lambda e, v: F.sum(F.when(F.col("t") == v, e).otherwise(0.0))
    w, y = F.col("w"), F.col("y")
    r = d.agg(s(w * y, 1).alias("wy1"), s(w, 1).alias("w1"), s(w * w, 1).alias("ww1"), s(w * y, 0).alias("wy0"), s(w, 0).alias("w0"), s(w * w, 0).alias("ww0"), F.count(F.lit(1)).alias("n"))
    return r.select("n", (F.col("wy1") / F.col("w1") - F.col("wy0") / F.col("w0")).alias("effect"), (F.col("w1") ** 2 / F.col("ww1")).alias("ess_treated"), (F.col("w0") ** 2 / F.col("ww0")).alias("ess_control"))


__all__ = ["batch_sums", "firth_logistic", "glm", "huber", "ipw", "iv_2sls", "logistic_glm", "negative_binomial_glm", "ols", "poisson_glm", "probit_glm", "regression_f_test", "term_rows", "tobit_regression"]
