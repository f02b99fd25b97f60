"""Ratio grids that tell "not available" from "not meaningful", and the formulas behind them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (ratio, numerator, subtracted from it, divisor, whether the divisor must be positive).
RATIOS = [
    ("gross_margin", "gross_profit", None, "revenue", False),
    ("operating_margin", "operating_income", None, "revenue", False),
    ("net_margin", "net_income", None, "revenue", False),
    ("roa", "net_income", None, "total_assets", False),
    ("roe", "net_income", None, "total_equity", True),
    ("current_ratio", "total_current_assets", None, "total_current_liabilities", False),
    ("quick_ratio", "total_current_assets", "inventory", "total_current_liabilities", False),
    ("asset_turnover", "revenue", None, "total_assets", False),
    ("debt_to_equity", "total_liabilities", None, "total_equity", True),
    ("fcf", "cfo", "capex", None, False),
    ("fcf_margin", "cfo", "capex", "revenue", False),
]


def cell(ratio: str, value: Column, inputs: list[Column], divisor: Column | None, positive: bool) -> Column:
    """(``ratio``, ``status``, ``value``): ``n/a`` where an input is missing, else ``n/m`` where the divisor is 0 or not
    positive as it must be, else ``ok``; the value is only computed for ``ok``."""
    missing = reduce(lambda a, b: a | b, [c.isNull() for c in inputs])
    senseless = F.lit(False) if divisor is None else (divisor <= 0 if positive else divisor == 0)
    status = F.when(missing, "n/a").when(senseless, "n/m").otherwise("ok")
    return F.struct(F.lit(ratio).alias("ratio"), status.alias("status"), F.when(~missing & ~senseless, value).alias("value"))


def ratio_grid(wide: DataFrame, keys: list[str], previous_revenue: str | None = None) -> DataFrame:
    """All ratios of each wide row, from one pass. ``previous_revenue``: the column of the year shown before, for growth."""
    made = []
    for name, top, less, under, positive in RATIOS:
        inputs = [F.col(x) for x in (top, less, under) if x]
        amount = F.col(top) - F.col(less) if less else F.col(top)
        divisor = F.col(under) if under else None
        made.append(cell(name, F.try_divide(amount, divisor) if under else amount, inputs, divisor, positive))
    if previous_revenue:
        now, before = F.col("revenue"), F.col(previous_revenue)
        made.append(cell("revenue_growth", F.try_divide(now - before, before), [now, before], before, False))
    return wide.select(*keys, F.inline(F.array(*made)))


def formula(top: Column, under: Column, less: Column | None = None) -> Column:
    """A spreadsheet formula over cell addresses."""
    return F.concat(F.lit("="), top, F.lit("/"), under) if less is None else F.concat(F.lit("=("), top, F.lit("-"), less, F.lit(")/"), under)
