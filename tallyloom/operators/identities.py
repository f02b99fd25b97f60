"""Accounting identities scored with tolerances inferred from the rounding of their own inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNITS = (1e6, 1e5, 1e4, 1e3)


def rounding_unit(v: Column) -> Column:
    """The coarsest of a million to a thousand that a figure is a multiple of, else 1."""
    fits = lambda u: F.abs(v - F.rint(v / u) * u) <= F.abs(v) * 1e-12
    return reduce(lambda done, u: done.when(fits(u), F.lit(u)), UNITS[1:], F.when(fits(UNITS[0]), F.lit(UNITS[0]))).otherwise(F.lit(1.0))


def tolerance(terms: list[Column]) -> Column:
    """The sum of the rounding units of the terms that are there and not 0; 1 at least."""
    each = [F.when(t.isNotNull() & (t != 0), rounding_unit(t)).otherwise(F.lit(0.0)) for t in terms]
    return F.greatest(F.lit(1.0), reduce(lambda a, b: a + b, each))


def check(name: str, lhs: Column, rhs: Column, terms: list[Column], needed: list[Column], gate: Column | None = None) -> Column:
    """One check as a struct; NULL where an input it needs is missing or its gate is shut: an omitted check is no failure."""
    ready = reduce(lambda a, b: a & b, [c.isNotNull() for c in needed]) & (gate if gate is not None else F.lit(True))
    tol = tolerance(terms)
    row = F.struct(F.lit(name).alias("check"), lhs.alias("lhs"), rhs.alias("rhs"), tol.alias("tolerance"), (F.abs(lhs - rhs) <= tol).alias("passed"))
    return F.when(ready, row)


def checks(wide: DataFrame, keys: list[str], derived_liabilities: Column | None = None) -> DataFrame:
    """Rows (keys, ``check``, ``lhs``, ``rhs``, ``tolerance``, ``passed``), all checks of a year made from its one wide row.

    ``wide`` also carries ``prior_cash``, the cash of the fiscal year before by number. A year without any check that can
    be made gets one failing ``insufficient_data`` row. Optional terms (minority interest, currency effect) count as 0
    where they are missing and then add nothing to the tolerance. Where liabilities are derived, the balance sheet is
    held against the reported liabilities and equity instead, or not at all.
    """
    c = F.col
    derived = derived_liabilities if derived_liabilities is not None else F.lit(False)
    minority, fx = F.coalesce("noncontrolling_interest_in_income", F.lit(0.0)), F.coalesce("fx_effect_on_cash", F.lit(0.0))
    three = lambda a, b, d: [c(a), c(b), c(d)]
    made = [
        check("balance_sheet_equation", c("total_assets"), c("total_liabilities") + c("total_equity"), t := three("total_assets", "total_liabilities", "total_equity"), t, ~derived),
        check("balance_sheet_equation_independent", c("total_assets"), c("total_liabilities_and_equity"), t := [c("total_assets"), c("total_liabilities_and_equity")], t, derived),
        check("gross_profit_buildup", c("gross_profit"), c("revenue") - c("cost_of_revenue"), t := three("gross_profit", "revenue", "cost_of_revenue"), t),
        check("operating_income_buildup", c("operating_income"), c("gross_profit") - c("operating_expenses"), t := three("operating_income", "gross_profit", "operating_expenses"), t),
        check("net_income_buildup", c("net_income"), c("pretax_income") - c("income_tax_expense") - minority, [*(t := three("net_income", "pretax_income", "income_tax_expense")), c("noncontrolling_interest_in_income")], t),
        check("cash_roll_forward", c("cash_and_equivalents") - c("prior_cash"), c("cfo") + c("cfi") + c("cff") + fx, [*(t := [c("cash_and_equivalents"), c("prior_cash"), c("cfo"), c("cfi"), c("cff")]), c("fx_effect_on_cash")], t),
    ]
    lacking = F.struct(F.lit("insufficient_data").alias("check"), F.lit(None).cast("double").alias("lhs"), F.lit(None).cast("double").alias("rhs"), F.lit(0.0).alias("tolerance"), F.lit(False).alias("passed"))
    found = F.filter(F.array(*made), lambda x: x.isNotNull())
    return wide.select(*keys, F.inline(F.when(F.size(found) > 0, found).otherwise(F.array(lacking))))


def with_prior(wide: DataFrame, keys: list[str], year: str, column: str, name: str) -> DataFrame:
    """A column of the fiscal year before by number, not of the column shown before: NULL where that year is missing.
    ``wide`` has one row per key and year; one window over a key's few years, no self-join."""
    w = Window.partitionBy(*keys).orderBy(year)
    return wide.withColumn(name, F.when(F.lag(year).over(w) == F.col(year) - 1, F.lag(column).over(w)))


def report(found: DataFrame, keys: list[str]) -> DataFrame:
    """Per entity: whether every check passed, how many did, and of how many."""
    return found.groupBy(*keys).agg(F.bool_and("passed").alias("passed"), F.count_if("passed").alias("n_passed"), F.count(F.lit(1)).alias("n_total"))


def residuals(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Retained earnings less what the year before, income and payouts explain; told, never scored. Needs ``prior_retained``."""
    c = F.col
    explained = c("prior_retained") + c("net_income") - F.coalesce("dividends_paid", F.lit(0.0)) - F.coalesce("share_repurchases", F.lit(0.0))
    gap = c("retained_earnings") - explained
    return wide.where("retained_earnings is not null and prior_retained is not null and net_income is not null").select(*keys, gap.alias("residual"), F.when(c("total_assets") != 0, gap / c("total_assets") * 100).alias("residual_pct"))
