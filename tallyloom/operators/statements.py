"""Values that follow exactly from others, the scale of share counts, and the grid in wide form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEMS = (
    "revenue cost_of_revenue gross_profit research_development selling_marketing_expense general_administrative_expense operating_expenses operating_income interest_expense "
    "pretax_income pretax_domestic pretax_foreign income_tax_expense net_income noncontrolling_interest_in_income eps_diluted weighted_diluted_shares cash_and_equivalents accounts_receivable inventory "
    "total_current_assets total_current_liabilities ppe_net total_assets accounts_payable long_term_debt total_liabilities total_liabilities_and_equity retained_earnings total_equity "
    "cfo capex cfi dividends_paid share_repurchases cff fx_effect_on_cash"
).split()
#: Items whose tag a derivation or check asks for.
TAGGED = ("total_equity", "total_liabilities")
SCALES = (1.0, 1e3, 1e6)


def wide(grid: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per entity and year, one column per item; an item that the grid lacks is NULL."""
    keys = keys or ["cik", "fiscal_year"]
    cells = [F.max(F.when(F.col("item_key") == i, F.col("value"))).alias(i) for i in ITEMS]
    tags = [F.max(F.when(F.col("item_key") == i, F.col("tag"))).alias(f"tag_{i}") for i in TAGGED if "tag" in grid.columns]
    return grid.groupBy(*keys).agg(*cells, *tags)


def derive(grid: DataFrame, item: str, value: Column, marker: str, side: DataFrame | None = None) -> DataFrame:
    """The grid's ``item`` filled with what follows from other items.

    Only where an entity reports the item in none of its years; a year whose ``value`` is NULL stays NULL. Where one is
    derived, its tag is ``derived:<marker>``. ``value`` is over the wide row of the entity and year, with ``tag_<item>`` of
    the balance items beside it, and the columns of ``side`` (by ``cik``).
    """
    w = wide(grid)
    w = w.join(side, "cik", "left") if side is not None else w
    none = grid.where(F.col("item_key") == item).groupBy("cik").agg((F.count("value") == 0).alias("absent"))
    new = w.select("cik", "fiscal_year", F.lit(item).alias("item_key"), value.alias("d")).join(none.where("absent").select("cik"), "cik", "left_semi")
    joined = grid.join(new.where("d is not null"), ["cik", "fiscal_year", "item_key"], "left")
    tag = F.when(F.col("d").isNotNull(), F.lit(f"derived:{marker}")).otherwise(F.col("tag"))
    return joined.withColumn("tag", tag).withColumn("value", F.coalesce("value", "d")).drop("d")


#: The tag of equity that is the parent's alone, and the one that tells of a minority interest.
PARENT_ONLY, MINORITY = "stockholdersequity", "minorityinterest"


def has_minority(facts: DataFrame, tag: str = MINORITY) -> DataFrame:
    """(``cik``, ``minority``): the entities with any entry of the tag, whatever its unit, period and form."""
    return facts.where(F.col("tag") == tag).select("cik").distinct().withColumn("minority", F.lit(True))


def derive_total_liabilities(grid: DataFrame, minority: DataFrame | None = None, parent_only: str = PARENT_ONLY, whole: str = "total_liabilities_and_equity") -> DataFrame:
    """Liabilities as liabilities-and-equity (``whole``) less equity. Refused for a year whose equity is the parent's alone
    (its tag is ``parent_only``) where the entity has a minority interest: the rest would hold that too. ``minority``:
    (``cik``, ``minority``), see ``has_minority``."""
    rest = F.col(whole) - F.col("total_equity")
    barred = F.coalesce("minority", F.lit(False)) & (F.col("tag_total_equity") == parent_only)
    value = rest if minority is None else F.when(~F.coalesce(barred, F.lit(False)), rest)
    return derive(grid, "total_liabilities", value, f"{whole}-total_equity", minority)


def derive_pretax_income(grid: DataFrame) -> DataFrame:
    """Income before tax as its domestic and foreign parts; both are needed."""
    return derive(grid, "pretax_income", F.col("pretax_domestic") + F.col("pretax_foreign"), "pretax_domestic+pretax_foreign")


def nearest_scale(filed: Column, implied: Column) -> Column:
    """Which of 1, 1,000 and 1,000,000 brings a filed count nearest, in logs, to the implied one; the smaller on a tie."""
    options = F.array(*[F.struct(F.abs(F.log(filed * s) - F.log(implied)).alias("gap"), F.lit(i).alias("i"), F.lit(s).alias("scale")) for i, s in enumerate(SCALES)])
    return F.array_min(options)["scale"]


def share_scale(rows: DataFrame, keys: list[str], year: str, shares: str, per_share: str, income: str) -> DataFrame:
    """Per entity, the scale its share counts are filed in: the years vote by income over income per share, the most
    recent voter wins a tie; without votes the latest count under a million counts as millions. Years with a NULL or 0
    among the three, or a count that is not positive, do not vote."""
    s, e, i = F.col(shares), F.col(per_share), F.col(income)
    implied = F.when((e != 0) & (i != 0) & (s > 0), i / e)
    vote = F.when(implied > 0, nearest_scale(s, implied))
    votes = rows.withColumn("scale", vote).where("scale is not null").groupBy(*keys, "scale").agg(F.count(F.lit(1)).alias("n"), F.max(year).alias("latest"))
    won = votes.groupBy(*keys).agg(F.max_by("scale", F.struct("n", "latest")).alias("won"))
    last = rows.groupBy(*keys).agg(F.max_by(shares, F.when(s.isNotNull(), F.col(year))).alias("last"))
    fallback = F.when((F.col("last") > 0) & (F.col("last") < 1e6), 1e6).otherwise(1.0)
    return last.join(won, keys, "left").select(*keys, F.coalesce("won", fallback).alias("scale"))
