"""Column functions shared by the reports: rates, exact means, labels, tiers.

Numeric policy.  The reports publish values rounded to two decimals, half
away from zero (SQL ``ROUND(numeric, 2)``), once.  Doubles would make the last
digit depend on summation order (which differs per partitioning), so:

* a stored ratio (a percent held as double) is rounded from its decimal value
  in one step;
* means sum exact decimals of 13 places (a stored ratio of 15 significant
  digits fits; a computed percent ``100*n/d`` is divided to 13 places) and
  are rounded by integer division of the exact sum by the count;
* counts give percents by rounded integer division.

Sums of decimals are associative, so the result does not depend on how
Spark splits the partial aggregates.  All of it stays inside whole-stage
codegen (``div`` is the SQL integral division).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Exact percents: up to 7 digits before and 13 after the point.
EXACT = "DECIMAL(20,13)"

# Every helper takes column names / SQL expressions (str) or Columns.  With
# str inputs the whole formula is built as one SQL expression (one
# ``F.expr`` call instead of a dozen Column calls: plans are built faster);
# the ``*_sql`` twins return the text so formulas can be nested.


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _all_sql(*xs) -> bool:
    return all(isinstance(x, str) for x in xs)


def idiv(num: Column, den: Column) -> Column:
    """SQL integral division (``num div den``), bigint."""
    return F.call_function("div", num, den)


# -- SQL text builders ----------------------------------------------------------
def round_div_sql(num: str, den: str) -> str:
    d = f"nullif({den}, 0)"
    q = f"((abs({num}) * 2 + {d}) div ({d} * 2))"
    return f"(CASE WHEN ({num}) < 0 THEN -{q} ELSE {q} END)"


def hundredths_to_double_sql(h: str) -> str:
    return f"(CAST({h} AS DOUBLE) / 100.0D)"


def ratio_exact_sql(ratio: str) -> str:
    return f"CAST(coalesce({ratio}, 0D) AS {EXACT})"


def ratio2_sql(ratio: str) -> str:
    return f"CAST(CAST(coalesce({ratio}, 0D) AS DECIMAL(18,2)) AS DOUBLE)"


def pct_sql(n: str, d: str) -> str:
    return hundredths_to_double_sql(round_div_sql(f"({n}) * 10000", d))


def pct_exact_sql(n: str, d: str) -> str:
    return f"CAST(CAST(({n}) * 100 AS DECIMAL(20,0)) / nullif(CAST({d} AS DECIMAL(19,0)), 0) AS {EXACT})"


def mean2_sql(value: str) -> str:
    return hundredths_to_double_sql(round_div_sql(f"(sum({value}) * 100)", f"count({value})"))


def exact_mean_sql(value: str) -> str:
    return f"(sum({value}) / CAST(count({value}) AS DECIMAL(20,0)))"


def to_hundredths_sql(value: str) -> str:
    return f"CAST(CAST({value} AS DECIMAL(18,2)) * 100 AS BIGINT)"


def mean2_of_hundredths_sql(value: str) -> str:
    h = to_hundredths_sql(value)
    return hundredths_to_double_sql(round_div_sql(f"sum({h})", f"count({h})"))


# -- Column functions -------------------------------------------------------------
def round_div(num, den) -> Column:
    """Nearest integer to ``num/den`` (halves away from zero); ``den > 0``.

    Null when ``den`` is null or 0.
    """
    if _all_sql(num, den):
        return F.expr(round_div_sql(num, den))
    num, den = _c(num), _c(den)
    den = F.nullif(den, F.lit(0))
    q = idiv(F.abs(num) * 2 + den, den * 2)
    return F.when(num < 0, -q).otherwise(q)


def hundredths_to_double(h) -> Column:
    """Integer hundredths -> double with two decimals (``h / 100``)."""
    if isinstance(h, str):
        return F.expr(hundredths_to_double_sql(h))
    return h.cast("double") / F.lit(100.0)


def _sql_only(*xs) -> None:
    if not _all_sql(*xs):
        raise TypeError("column names or SQL expressions are expected")


def ratio_exact(ratio: str) -> Column:
    """A stored percent (double, null as 0) as an exact decimal."""
    _sql_only(ratio)
    return F.expr(ratio_exact_sql(ratio))


def ratio2(ratio) -> Column:
    """A stored percent, null as 0, rounded once to 2 decimals, half away from zero."""
    if isinstance(ratio, str):
        return F.expr(ratio2_sql(ratio))
    return F.coalesce(ratio, F.lit(0.0)).cast("decimal(18,2)").cast("double")


def pct(n, d) -> Column:
    """``100 * n / d`` rounded to 2 decimals; null when ``d`` is 0 or null."""
    if _all_sql(n, d):
        return F.expr(pct_sql(n, d))
    return hundredths_to_double(round_div(_c(n) * 10000, _c(d)))


def pct_exact(n: str, d: str) -> Column:
    """``100 * n / d`` to 13 decimals; null when ``d`` is 0 or null."""
    _sql_only(n, d)
    return F.expr(pct_exact_sql(n, d))


def mean2(value: str) -> Column:
    """Aggregate: mean of non-null exact decimals, rounded once to 2 decimals.

    Null when there is no non-null value (``AVG`` semantics).
    """
    _sql_only(value)
    return F.expr(mean2_sql(value))


def exact_mean(value: str) -> Column:
    """Aggregate: the mean of exact decimals as a decimal (for ordering)."""
    _sql_only(value)
    return F.expr(exact_mean_sql(value))


def mean2_of_hundredths(value) -> Column:
    """Aggregate: mean of a 2-decimal double column, rounded to 2 decimals."""
    if isinstance(value, str):
        return F.expr(mean2_of_hundredths_sql(value))
    h = (value.cast("decimal(18,2)") * F.lit(100)).cast("bigint")
    return hundredths_to_double(round_div(F.sum(h), F.count(h)))


def tier(value: Column, bands: Sequence[tuple[object, str]], otherwise: str) -> Column:
    """First label whose lower bound ``value >= bound`` holds, else ``otherwise``."""
    expr = None
    for bound, label in bands:
        cond = value >= F.lit(bound)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(otherwise) if expr is not None else F.lit(otherwise)


def month_label(ts) -> Column:
    """``'September 2024'``: month name blank-padded to 9 characters, space, year."""
    t = _c(ts)
    return F.concat(F.rpad(F.date_format(t, "MMMM"), 9, " "), F.lit(" "), F.date_format(t, "yyyy"))


def month_label_of(year, month) -> Column:
    """``month_label`` of the first day of (year, month); null if either is null.

    Lets a report group by the two integers and label the (small) result.
    """
    return month_label(F.make_date(_c(year), _c(month), F.lit(1)))


def weekday_name(ts) -> Column:
    return F.date_format(_c(ts), "EEEE")


def iso_weekday(ts) -> Column:
    """Monday 1 .. Sunday 7."""
    return (F.weekday(_c(ts)) + 1).cast("int")


def hour_label(hour: Column) -> Column:
    """``5`` -> ``'05:00'``."""
    return F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":00"))
