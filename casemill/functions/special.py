"""Distribution tails and quantiles, for already aggregated rows only.

Spark SQL has no normal, t or chi-square distribution. The heavy part of every test is counts and
sums in Spark; these functions finish one row per group.
"""

from __future__ import annotations

import math
import sys
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

# Executors need not have this package installed: its functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TINY = 1e-300
_STEPS = 1_000_000


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _lentz(first: float, term) -> float:
    """Value of a continued fraction ``first + a1/(b1 + a2/(b2 + …))`` given ``term(i) -> (a, b)``."""
    value = first or _TINY
    c, d = value, 0.0
    for i in range(1, _STEPS):
        a, b = term(i)
        d = 1.0 / ((b + a * d) or _TINY)
        c = (b + a / c) or _TINY
        step = c * d
        value *= step
        if abs(step - 1.0) < 1e-15:
            return value
    raise ArithmeticError(f"a continued fraction did not converge in {_STEPS} steps")


def chi2_upper(x: float, dof: float) -> float:
    """P(X > x) of the chi-square distribution: regularised upper incomplete gamma."""
    if x <= 0:
        return 1.0
    a, y = dof / 2.0, x / 2.0
    scale = math.exp(a * math.log(y) - y - math.lgamma(a))
    if y < a + 1.0:
        part = total = 1.0 / a
        for i in range(1, _STEPS):
            part *= y / (a + i)
            total += part
            if part < total * 1e-16:
                return 1.0 - total * scale
        raise ArithmeticError(f"a series did not converge in {_STEPS} steps")
    fraction = _lentz(y + 1.0 - a, lambda i: (-i * (i - a), y + 2.0 * i + 1.0 - a))
    return scale / fraction


def beta_regularized(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_regularized(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )

    def term(i: int) -> tuple[float, float]:
        m = i // 2
        if i % 2:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    return front / (a * _lentz(1.0, term))


def _log_gamma_step(a: float, b: float) -> float:
    """ln Γ(a + b) - ln Γ(a) without subtracting two large numbers, for a small ``b``."""
    if a < 16.0:
        return math.lgamma(a + b) - math.lgamma(a)

    def rest(z: float) -> float:
        return 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)

    return (a - 0.5) * math.log1p(b / a) + b * math.log(a + b) - b + rest(a + b) - rest(a)


def _t_within(t: float, dof: float) -> float:
    """P(-t < T < t) as a series of positive terms, which keeps its digits for any number of degrees of freedom."""
    half, y = dof / 2.0, t * t / (dof + t * t)
    front = _log_gamma_step(half, 0.5) - math.lgamma(0.5) + 0.5 * math.log(y) + half * math.log1p(-y) + math.log(2.0)
    part = total = 1.0
    for i in range(_STEPS):
        part *= (half + 0.5 + i) / (1.5 + i) * y
        total += part
        if part < total * 1e-17:
            return min(1.0, total * math.exp(front))
    raise ArithmeticError(f"a series did not converge in {_STEPS} steps")


def t_cdf(t: float, dof: float) -> float:
    if t == 0:
        return 0.5
    if t * t <= min(dof, 64.0):
        return 0.5 + math.copysign(0.5 * _t_within(abs(t), dof), t)
    # Further out the fraction gives the tail itself.
    tail = 0.5 * beta_regularized(dof / 2.0, 0.5, dof / (dof + t * t))
    return 1.0 - tail if t >= 0 else tail


def t_quantile(p: float, dof: float) -> float:
    """Quantile by bisection on the distribution function."""
    low, high = -1.0, 1.0
    while t_cdf(high, dof) < p:
        high *= 2.0
    while t_cdf(low, dof) > p:
        low *= 2.0
    for _ in range(200):
        middle = 0.5 * (low + high)
        if middle in (low, high):
            break
        if t_cdf(middle, dof) < p:
            low = middle
        else:
            high = middle
    return 0.5 * (low + high)


@F.pandas_udf(DoubleType())
def _normal_p(z: pd.Series) -> pd.Series:
    return z.map(normal_two_sided, na_action="ignore")


@F.pandas_udf(DoubleType())
def _chi2_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_upper(a, d) if d > 0 else 1.0 for a, d in zip(x, dof)], dtype="float64")


@F.pandas_udf(DoubleType())
def _t_q(p: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([t_quantile(a, d) if d > 0 else None for a, d in zip(p, dof)], dtype="float64")


def normal_p_value(z: Column) -> Column:
    """Two-sided p-value of a standard normal statistic."""
    return _normal_p(z)


def chi2_p_value(statistic: Column, dof: Column) -> Column:
    return _chi2_p(statistic.cast("double"), dof.cast("double"))


def t_critical(confidence: float, dof: Column) -> Column:
    """Two-sided critical value of the t distribution."""
    return _t_q(F.lit(1.0 - (1.0 - confidence) / 2.0), dof.cast("double"))


# Coefficients of Acklam's rational approximation of the normal quantile.
_TAIL_NUM = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838, -2.549732539343734,
             4.374664141464968, 2.938163982698783)
_TAIL_DEN = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996, 3.754408661907416, 1.0)
_MID_NUM = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02,
            -3.066479806614716e+01, 2.506628277459239)
_MID_DEN = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01,
            -1.328068155288572e+01, 1.0)
_TAIL_FROM = 0.02425


def normal_quantiles(p: np.ndarray) -> np.ndarray:
    """Normal quantiles of an array, relative error about 1e-9."""
    p = np.asarray(p, dtype="float64")
    tail = np.minimum(p, 1.0 - p)
    q = np.sqrt(-2.0 * np.log(tail))
    outer = np.polyval(_TAIL_NUM, q) / np.polyval(_TAIL_DEN, q)
    d = p - 0.5
    inner = np.polyval(_MID_NUM, d * d) * d / np.polyval(_MID_DEN, d * d)
    return np.where(tail < _TAIL_FROM, np.where(p < 0.5, outer, -outer), inner)


def normal_score(rank, n):
    """Expected normal order statistic of a rank among n."""
    return normal_quantiles((np.asarray(rank, dtype="float64") - 0.375) / (n + 0.25))


_NORMAL = NormalDist()
_NODES, _WEIGHTS = (v.tolist() for v in np.polynomial.legendre.leggauss(12))
# The series below starts this many ranks from either end; its first term left out is then below 1e-12.
_SERIES_FROM = 16


def _score_at(x: float, n: int) -> float:
    """The score of a rank or of a point between ranks, from the nearer end, where it keeps its digits."""
    tail = min(x, n + 1 - x)
    z = _NORMAL.inv_cdf((tail - 0.375) / (n + 0.25))
    return z if x == tail else -z


def _integrals(a: float, b: float, n: int) -> tuple[float, float]:
    """Integrals of the score and of its square from ``a`` to ``b``, both below the middle.

    Gauss-Legendre over panels that double their distance from the end, so that each one is as far from the
    singularity there as it is long. Nothing large is subtracted, as the closed form would for short ranges.
    """
    linear, squares = [], []
    while a < b:
        until = min(b, 2.0 * a)
        half = (until - a) / 2.0
        for node, weight in zip(_NODES, _WEIGHTS):
            z = _NORMAL.inv_cdf((a + half * (1.0 + node) - 0.375) / (n + 0.25))
            linear.append(half * weight * z)
            squares.append(half * weight * z * z)
        a = until
    return math.fsum(linear), math.fsum(squares)


def _corrections(x: float, n: int) -> tuple[float, float]:
    """Derivative terms of the Euler-Maclaurin series (midpoint form) at ``x``, for the score and its square.

    With ``u`` the slope of the score z, the derivative of ``g(z) u**k`` is ``(g' + k z g) u**(k+1)``, which
    gives the first, third and fifth derivatives of z and of z squared.
    """
    z = _score_at(x, n)
    zz = z * z
    u = math.sqrt(2.0 * math.pi) * math.exp(zz / 2.0) / (n + 0.25)
    odd, even = (1.0 + 2.0 * zz) * u**3, (7.0 + 46.0 * zz + 24.0 * zz * zz) * u**5
    linear = -u / 24.0 + odd * 7.0 / 5760.0 - even * 31.0 / 967680.0
    odd, even = (8.0 + 4.0 * zz) * u**3, (104.0 + 192.0 * zz + 48.0 * zz * zz) * u**5
    squares = z * (-2.0 * u / 24.0 + odd * 7.0 / 5760.0 - even * 31.0 / 967680.0)
    return linear, squares


def score_sums(first: int, last: int, n: int) -> tuple[float, float]:
    """Sum of the scores of ranks first…last, and of their squares, in work that grows with log(last / first).

    The Euler-Maclaurin series has an error below 1e-12 from ``_SERIES_FROM`` ranks on; the few ranks nearer
    to an end are terms of their own, as where such a series is shifted to where it converges.
    """
    low, high = max(first, _SERIES_FROM + 1), min(last, n - _SERIES_FROM)
    # Without a middle part the range has at most twice as many ranks, all of them near an end.
    outer = [*range(first, low), *range(high + 1, last + 1)] if low <= high else range(first, last + 1)
    scores = [_score_at(r, n) for r in outer]
    linear, squares = math.fsum(scores), math.fsum(z * z for z in scores)
    if low <= high:
        a, b, middle = low - 0.5, high + 0.5, (n + 1) / 2.0
        below = _integrals(a, min(b, middle), n)
        above = _integrals(n + 1 - b, n + 1 - max(a, middle), n)
        start, stop = _corrections(a, n), _corrections(b, n)
        linear += below[0] - above[0] + (stop[0] - start[0])
        squares += below[1] + above[1] + (stop[1] - start[1])
    return linear, squares


# Polynomial coefficients of Royston's approximation (highest power first).
_LAST = (-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0)
_NEXT_TO_LAST = (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0)
_SMALL_GAMMA = (0.459, -2.273)
_SMALL_MEAN = (-0.0006714, 0.025054, -0.39978, 0.5440)
_SMALL_LOG_SD = (-0.0020322, 0.062767, -0.77857, 1.3822)
_LARGE_MEAN = (0.0038915, -0.083751, -0.31082, -1.5861)
_LARGE_LOG_SD = (0.0030302, -0.082676, -0.4803)


def shapiro_finish(
    n: int, score_squares: float, x_scores: float, ends: float, next_ends: float, squares: float
) -> tuple[float, float]:
    """W and its p-value from the sums over a group.

    ``ends`` is the largest minus the smallest value, ``next_ends`` the same one rank further in.
    """
    if not squares > 0:
        return 1.0, 1.0  # a constant group has no spread
    m_last, m_next = (float(v) for v in normal_score(np.array([n, n - 1]), n))
    u = 1.0 / math.sqrt(n)
    last = m_last / math.sqrt(score_squares) + float(np.polyval(_LAST, u))
    weighted = last * ends
    rest, rest_squares, used = x_scores - m_last * ends, score_squares - 2.0 * m_last**2, 2.0 * last**2
    if n > 5:
        after = m_next / math.sqrt(score_squares) + float(np.polyval(_NEXT_TO_LAST, u))
        weighted += after * next_ends
        rest -= m_next * next_ends
        rest_squares -= 2.0 * m_next**2
        used += 2.0 * after**2
    weighted += rest / math.sqrt(rest_squares / (1.0 - used))
    w = min(1.0, weighted * weighted / squares)
    if w >= 1.0:
        return 1.0, 1.0
    off, log_n = math.log(1.0 - w), math.log(n)
    if n <= 11:
        gamma = float(np.polyval(_SMALL_GAMMA, n))
        if off >= gamma:
            return w, 0.0
        y, mean, sd = -math.log(gamma - off), np.polyval(_SMALL_MEAN, n), np.polyval(_SMALL_LOG_SD, n)
    else:
        y, mean, sd = off, np.polyval(_LARGE_MEAN, log_n), np.polyval(_LARGE_LOG_SD, log_n)
    z = (y - float(mean)) / math.exp(float(sd))
    return w, 0.5 * math.erfc(z / math.sqrt(2.0))


@F.pandas_udf(StructType([StructField("linear", DoubleType()), StructField("squares", DoubleType())]))
def _score_sums(first: pd.Series, last: pd.Series, n: pd.Series) -> pd.DataFrame:
    # Most values occur once, and one rank is one score; only longer ranges are summed one by one.
    linear = normal_score(first.to_numpy(), n.to_numpy())
    squares = linear * linear
    for i in np.flatnonzero(last.to_numpy() != first.to_numpy()):
        linear[i], squares[i] = score_sums(int(first.iloc[i]), int(last.iloc[i]), int(n.iloc[i]))
    return pd.DataFrame({"linear": linear, "squares": squares})


@F.pandas_udf(StructType([StructField("w", DoubleType()), StructField("p", DoubleType())]))
def _shapiro_finish(
    n: pd.Series, mm: pd.Series, xm: pd.Series, ends: pd.Series, next_ends: pd.Series, squares: pd.Series
) -> pd.DataFrame:
    rows = [shapiro_finish(int(r[0]), *r[1:]) for r in zip(n, mm, xm, ends, next_ends, squares)]
    return pd.DataFrame(rows, columns=["w", "p"], dtype="float64")


def rank_score_sums(first: Column, last: Column, n: Column) -> Column:
    """Struct (linear, squares): normal-score sums over the ranks first…last of n."""
    return _score_sums(first, last, n)


def shapiro_result(n: Column, mm: Column, xm: Column, ends: Column, next_ends: Column, squares: Column) -> Column:
    """Struct (w, p) for one aggregated group."""
    return _shapiro_finish(n, mm, xm, ends, next_ends, squares)
