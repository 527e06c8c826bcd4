"""Column expressions shared by every layer.

All helpers return built-in Catalyst expressions (no UDFs), so they stay inside whole-stage
codegen. Conventions that keep Spark and ANSI SQL engines in agreement:

* ratios are computed in double and rounded to ``RATIO_DIGITS``;
* a zero denominator gives NULL (``nullif``), never an error — ANSI mode is on;
* ``floor`` results are cast back to double (Spark returns bigint, most SQL engines double).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

RATIO_DIGITS = 9


def dec_scale(digits: int) -> int:
    """Decimal scale a double is fixed to before rounding: enough places to absorb binary
    representation error (2.385 is stored as 2.38499999...), few enough to stay inside a
    double's 15-16 significant digits."""
    return 10 if digits <= 2 else 12


def dround(x, digits: int = 0) -> Column:
    """Round the decimal value of ``x`` half-up (exact NUMBER semantics), returned as double.

    Rounding the binary double directly can turn a decimal tie (2.385 -> 2.39) into 2.38; fixing
    the value to ``dec_scale`` decimals first makes the tie exact."""
    d = F.round(_c(x).cast(f"decimal(38,{dec_scale(digits)})"), digits)
    return d.cast("double")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- arithmetic / row level (PRJ3, PRJ4, FN6, FN7) ---------------------------------------

def nullif_zero(x) -> Column:
    x = _c(x)
    return F.when(x != 0, x)


def gap(a, b) -> Column:
    """Row-level difference a - b (safety-stock gap, production gap, unfulfilled)."""
    return _c(a) - _c(b)


def pct(a, b, digits: int = 2) -> Column:
    """round(100 * a / nullif(b, 0), digits) in double."""
    return dround(F.lit(100.0) * _c(a).cast("double") / nullif_zero(_c(b).cast("double")), digits)


def fdiv(a, b) -> Column:
    """a / nullif(b, 0) in double."""
    return _c(a).cast("double") / nullif_zero(_c(b).cast("double"))


def ratio(num, den, digits: int | None = RATIO_DIGITS) -> Column:
    """Ratio of (already aggregated) values with a NULL-safe denominator (AGG11/AGG12)."""
    r = fdiv(num, den)
    return dround(r, digits) if digits is not None else r


def floor_d(x) -> Column:
    """floor() that stays double."""
    return F.floor(_c(x)).cast("double")


# --- predicates and flags (PRJ13-15, FN1-FN5, FN26-FN28) ---------------------------------

def iff(pred: Column, a, b) -> Column:
    """IFF(p, a, b): a NULL predicate takes the ELSE branch."""
    a = a if isinstance(a, Column) else F.lit(a)
    b = b if isinstance(b, Column) else F.lit(b)
    return F.when(pred, a).otherwise(b)


def flag(pred: Column) -> Column:
    """Two-valued flag: TRUE when the predicate holds, FALSE otherwise (NULL -> FALSE)."""
    return F.when(pred, F.lit(True)).otherwise(F.lit(False))


def threshold_flag(rate, cut: float) -> Column:
    """Three-valued flag: NULL rate -> NULL, else rate < cut (strict)."""
    return _c(rate) < F.lit(cut)


def band(rules: Sequence[tuple[Column, str]], default) -> Column:
    """Ordered classifier; the first matching rule wins."""
    expr = None
    for pred, label in rules:
        expr = F.when(pred, F.lit(label)) if expr is None else expr.when(pred, F.lit(label))
    d = default if isinstance(default, Column) else F.lit(default)
    return d if expr is None else expr.otherwise(d)


def banded(col, bands: Sequence[tuple[float, float, str]], default=None) -> Column:
    """BETWEEN-band classifier (inclusive bounds), first band wins (BLD7)."""
    c = _c(col)
    return band([(c.between(lo, hi), label) for lo, hi, label in bands],
                F.lit(default) if not isinstance(default, Column) else default)


def cycle(n, values: Sequence) -> Column:
    """Cyclic assignment: values[n mod k] (BLD6)."""
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (F.pmod(_c(n), F.lit(len(values))) + 1).cast("int"))


def bucket(col, n: int) -> Column:
    """Deterministic portable bucket of a string key: first 32 bits of md5 mod n (BLD5).

    md5 is used (not xxhash64) so any SQL engine can reproduce the assignment.
    """
    h = F.conv(F.substring(F.md5(_c(col).cast("string")), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(n))


def yyyymmdd(d) -> Column:
    return F.date_format(_c(d), "yyyyMMdd")


def attention_state(n_signals) -> Column:
    """FN26: two or more co-occurring signals, one signal, none."""
    n = _c(n_signals)
    return band([(n >= 2, "High Risk"), (n == 1, "Watchlist")], "Healthy")


def kpi_band(value, good: float, warn: float) -> Column:
    """FN27: KPI band with NULL kept as its own 'Unavailable' band."""
    v = _c(value)
    return (F.when(v.isNull(), F.lit("Unavailable"))
            .when(v >= good, F.lit("On target"))
            .when(v >= warn, F.lit("Watch"))
            .otherwise(F.lit("Below target")))


def active_signals(flags: Iterable[tuple[str, str]], sep: str = " · ") -> Column:
    """FN28: names of TRUE flags joined; NULL / FALSE flags are skipped."""
    return F.concat_ws(sep, *[F.when(_c(c), F.lit(name)) for c, name in flags])


# --- aggregates (AGG6-AGG9, AGG18) --------------------------------------------------------

def count_if(pred: Column) -> Column:
    """COUNT_IF(pred): NULL predicates are not counted."""
    return F.count_if(pred)


def first_when(value, pred: Column) -> Column:
    """MIN(IFF(pred, value, NULL)) — first date/value at which a condition holds."""
    return F.min(F.when(pred, _c(value)))


def any_when(pred: Column) -> Column:
    """MAX(IFF(pred, TRUE, FALSE)) — boolean any; FALSE for an empty-match group."""
    return F.max(flag(pred))


def value_when(value, pred: Column) -> Column:
    """MAX(IFF(pred, value, NULL))."""
    return F.max(F.when(pred, _c(value)))


def avg_when(value, pred: Column) -> Column:
    """AVG over eligible rows only."""
    return F.avg(F.when(pred, _c(value)))


def sum_ratio(num, den, digits: int | None = RATIO_DIGITS) -> Column:
    """SUM(num) / NULLIF(SUM(den), 0)."""
    return ratio(F.sum(_c(num)), F.sum(_c(den)), digits)


def count_ratio(num_pred: Column, den_pred: Column, digits: int | None = RATIO_DIGITS) -> Column:
    """COUNT_IF(p) / NULLIF(COUNT_IF(q), 0)."""
    return ratio(F.count_if(num_pred), F.count_if(den_pred), digits)


def kpi_pct(ratio_col, digits: int = 1) -> Column:
    """round(100 * ratio, 1) for headline KPIs."""
    return dround(F.lit(100.0) * _c(ratio_col), digits)


def days_between(start, end) -> Column:
    """DATEDIFF('day', start, end) = end - start, as int; NULL stays NULL."""
    return F.datediff(_c(end), _c(start))
