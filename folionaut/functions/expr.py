"""Scalar functions that neither Spark nor SQL has, as SQL text that both Spark and DuckDB read.

Each takes and gives SQL text; `column` makes a Spark column of it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abramowitz and Stegun 7.1.26, error below 1.5e-7.
_ERF_P = 0.3275911
_ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
#: Acklam's rational approximation of the normal quantile, relative error below 1.15e-9.
_PPF_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
_PPF_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
_PPF_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_PPF_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)
_LOW = 0.02425
#: Normal quantiles at 95 and 99 percent; the summary block's own, rounded one.
Z = {95: 1.6448536, 99: 2.3263479}
Z95_SUMMARY = 1.6449
EULER = 0.5772156649
TRADING_DAYS = 252


def _number(x: float) -> str:
    return f"({x!r}e0)" if "e" not in repr(x) else f"({x!r})"


def polynomial(coefficients, x: str) -> str:
    """Horner's scheme, highest power first."""
    out = _number(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {_number(c)})"
    return out


def norm_cdf(x: str) -> str:
    u = f"(abs({x}) / sqrt(2.0e0))"
    t = f"(1.0e0 / (1.0e0 + {_number(_ERF_P)} * {u}))"
    tail = f"({polynomial(_ERF_A[::-1], t)} * {t} * exp(-{u} * {u}))"
    return f"(case when {x} >= 0 then 1.0e0 - 0.5e0 * {tail} else 0.5e0 * {tail} end)"


def norm_pdf(x: str, mean: str = "0.0e0", sd: str = "1.0e0") -> str:
    return f"(exp(-0.5e0 * (({x}) - {mean}) * (({x}) - {mean}) / ({sd} * {sd})) / ({sd} * sqrt(2.0e0 * pi())))"


def norm_ppf(p: str) -> str:
    q, r = f"(({p}) - 0.5e0)", f"((({p}) - 0.5e0) * (({p}) - 0.5e0))"
    side = lambda u: f"({polynomial(_PPF_C, u)} / ({polynomial(_PPF_D, u)} * {u} + 1.0e0))"
    low, high = f"sqrt(-2.0e0 * ln({p}))", f"sqrt(-2.0e0 * ln(1.0e0 - ({p})))"
    middle = f"({polynomial(_PPF_A, r)} * {q} / ({polynomial(_PPF_B, r)} * {r} + 1.0e0))"
    return f"(case when ({p}) < {_LOW}e0 then {side(low)} when ({p}) > {1 - _LOW}e0 then -{side(high)} else {middle} end)"


def chi2_tail(q: str, df: int = 10) -> str:
    """P(X > q) for an even number of degrees of freedom: a finite sum."""
    terms, term = ["1.0e0"], "1.0e0"
    for i in range(1, df // 2):
        term = f"{term} * ({q} / 2.0e0) / {i}.0e0"
        terms.append(f"({term})")
    return f"(exp(-({q}) / 2.0e0) * ({' + '.join(terms)}))"


def column(sql: str) -> Column:
    return F.expr(sql)


def ratio(over: Column | str, under: Column | str) -> Column:
    """over / under; null where under is 0, as a value of 0 has no change from it and no ratio to it."""
    return F.try_divide(over, under)
