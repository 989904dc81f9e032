"""Vector expressions (JVM), and densities and samplers of the von Mises-Fisher distribution (numpy)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def doubles(v: Column | str) -> Column:
    return F.transform(_col(v), lambda x: x.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product in double precision, summed in order."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def length(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column | str, eps: float = 1e-12) -> Column:
    """The vector over its length, or over ``eps`` if that is larger."""
    once = F.array(F.greatest(length(v), F.lit(eps)))  # bound by a lambda, or each element would compute the length anew
    return F.transform(once, lambda n: F.transform(_col(v), lambda x: x.cast("double") / n))[0]


def usable(v: Column | str, dim: int) -> Column:
    """Whether a vector has ``dim`` finite numbers that aren't all zero; false for null."""
    c = _col(v)
    infinite = F.lit(float("inf"))
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < infinite))
    return F.coalesce((F.size(c) == dim) & fine & F.exists(c, lambda x: x != 0), F.lit(False))


def log_sphere_area(d: int) -> float:
    """Log surface of the unit sphere in ``d`` dimensions."""
    return math.log(2) + d / 2 * math.log(math.pi) - math.lgamma(d / 2)


def log_bessel_i(v: float, x: float) -> float:
    """Log of the modified Bessel function of the first kind.

    By its power series in logs up to 1,500, beyond by the uniform expansion (order above 0) or the large-argument one.
    """
    if x <= 0:
        return 0.0 if v == 0 else -math.inf
    if x <= 1500:
        m = np.arange(0, int(x) + 200)
        terms = (2 * m + v) * math.log(x / 2) - np.array([math.lgamma(i + 1) + math.lgamma(i + v + 1) for i in m])
        top = terms.max()
        return float(top + np.log(np.exp(terms - top).sum()))
    if v <= 1:
        mu = 4 * v * v
        return x - 0.5 * math.log(2 * math.pi * x) + math.log1p(-(mu - 1) / (8 * x) + (mu - 1) * (mu - 9) / (128 * x * x))
    z = x / v
    root = math.sqrt(1 + z * z)
    t = 1 / root
    eta = root + math.log(z / (1 + root))
    u1 = (3 * t - 5 * t**3) / 24
    u2 = (81 * t**2 - 462 * t**4 + 385 * t**6) / 1152
    return v * eta - 0.5 * math.log(2 * math.pi * v) - 0.5 * math.log(root) + math.log1p(u1 / v + u2 / v**2)


def vmf_log_norm_const(d: int, kappa: float) -> float:
    """Log normalising constant of the density; the uniform one below a concentration of 1e-8."""
    if kappa < 1e-8:
        return -log_sphere_area(d)
    v = d / 2 - 1
    return v * math.log(kappa) - d / 2 * math.log(2 * math.pi) - log_bessel_i(v, kappa)


def sphere_uniform(n: int, d: int, rng: np.random.Generator) -> np.ndarray:
    x = rng.standard_normal((n, d))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def sample_vmf(mean: np.ndarray, kappa: float, n: int, rng: np.random.Generator) -> np.ndarray:
    """Draws around a unit mean: the cosine by vectorised rejection from a beta envelope, the rest uniform."""
    mean = np.asarray(mean, float)
    d = len(mean)
    if kappa < 1e-8:
        return sphere_uniform(n, d, rng)
    b = (d - 1) / (2 * kappa + math.sqrt(4 * kappa * kappa + (d - 1) ** 2))
    x0 = (1 - b) / (1 + b)
    c = kappa * x0 + (d - 1) * math.log(1 - x0 * x0)
    cosine = np.empty(0)
    while len(cosine) < n:
        beta = rng.beta((d - 1) / 2, (d - 1) / 2, 2 * n + 16)
        w = (1 - (1 + b) * beta) / (1 - (1 - b) * beta)
        keep = kappa * w + (d - 1) * np.log(1 - x0 * w) - c >= np.log(rng.random(len(w)))
        cosine = np.r_[cosine, w[keep]]
    cosine = cosine[:n, None]
    side = rng.standard_normal((n, d))
    side -= (side @ mean)[:, None] * mean
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
    return cosine * mean + np.sqrt(np.maximum(0, 1 - cosine**2)) * side


def banerjee_kappa(r: float | np.ndarray, d: int) -> float | np.ndarray:
    """Concentration of a mean resultant length."""
    r = np.clip(r, 1e-6, 1 - 1e-6)
    return np.clip(r * (d - r * r) / (1 - r * r), 1e-2, 1e5)
