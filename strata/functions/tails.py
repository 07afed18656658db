"""Tail probabilities of the normal, chi-square and Student t distributions.

* ``normal_upper_tail_sql`` is one SQL expression (series below x = 2, continued
  fraction above) that Spark and DuckDB both evaluate, so Wilcoxon p-values stay a
  JVM-side column and remain checkable against SQL.
* The scalar functions are used through a pandas UDF on aggregated test rows only
  (one row per test), never per data row.
"""

import math

SQRT2 = math.sqrt(2.0)
PERFECT_R_TOL = 1e-12  # |r| within this of 1 counts as perfect correlation
SQRT_PI = math.sqrt(math.pi)
_SERIES_TERMS = 60
_CF_DEPTH = 60


def _erfc_sql(x: str) -> str:
    """erfc(x) for x >= 0 as SQL text over the column/expression ``x`` (referenced often:
    pass a plain column name)."""
    # erf(x) = 2/sqrt(pi) exp(-x^2) * x * (1 + c1 (1 + c2 (1 + ...))), c_k = 2x^2/(2k+1)
    inner = "1.0"
    for k in range(_SERIES_TERMS, 0, -1):
        inner = f"(1.0 + (2.0 * {x} * {x} / {2 * k + 1}.0) * {inner})"
    series = f"(1.0 - {2.0 / SQRT_PI!r} * exp(-{x} * {x}) * {x} * {inner})"
    # erfc(x) = exp(-x^2)/sqrt(pi) * 1/(x + (1/2)/(x + 1/(x + (3/2)/(x + ...))))
    cf = f"{x}"
    for n in range(_CF_DEPTH, 0, -1):
        cf = f"({x} + {n / 2.0!r} / {cf})"
    frac = f"(exp(-{x} * {x}) / {SQRT_PI!r} / {cf})"
    return f"(CASE WHEN {x} < 2.0 THEN {series} ELSE {frac} END)"


def normal_upper_tail_sql(z: str, x: str) -> str:
    """P(Z > z) where column ``x`` holds |z|/sqrt(2)."""
    e = _erfc_sql(x)
    return f"(CASE WHEN {z} >= 0 THEN 0.5 * {e} ELSE 1.0 - 0.5 * {e} END)"


# ------------------------------------------------------------------------------------
# Scalar functions (double precision, standard series / continued fractions).
# ------------------------------------------------------------------------------------

def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / SQRT2)


def _gamma_q(a: float, x: float) -> float:
    """Regularized upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    gln = math.lgamma(a)
    if x < a + 1.0:  # series for P
        ap, s, d = a, 1.0 / a, 1.0 / a
        for _ in range(10000):
            ap += 1.0
            d *= x / ap
            s += d
            if abs(d) < abs(s) * 1e-16:
                break
        return max(0.0, 1.0 - s * math.exp(-x + a * math.log(x) - gln))
    # continued fraction for Q (modified Lentz)
    tiny = 1e-300
    b = x + 1.0 - a
    c = 1.0 / tiny
    d = 1.0 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-16:
            break
    return math.exp(-x + a * math.log(x) - gln) * h


def chi2_sf(x: float, df: float) -> float:
    if x is None or df is None or math.isnan(x) or df <= 0:
        return float("nan")
    return _gamma_q(df / 2.0, x / 2.0)


def _betacf(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = tiny if abs(d) < tiny else d
    d = 1.0 / d
    h = d
    for m in range(1, 10000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-16:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|) for Student t with ``df`` degrees of freedom."""
    if t is None or df is None or math.isnan(t) or df <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def pearson_p(r: float, n: float) -> float:
    """Two-sided p of a Pearson correlation (t test with n - 2 dof)."""
    if r is None or n is None or n < 3 or math.isnan(r):
        return float("nan")
    if abs(r) >= 1.0 - PERFECT_R_TOL:
        return 0.0
    df = n - 2.0
    return t_two_sided(r * math.sqrt(df / (1.0 - r * r)), df)


# pandas UDF wrappers (Arrow batches of aggregated rows)
def chi2_sf_udf():
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def _chi2(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([chi2_sf(float(a), float(b)) if pd.notna(a) and pd.notna(b) else None
                          for a, b in zip(x, df)], dtype="float64")
    return _chi2


def pearson_p_udf():
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def _p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([pearson_p(float(a), float(b)) if pd.notna(a) and pd.notna(b) else None
                          for a, b in zip(r, n)], dtype="float64")
    return _p
