"""Reported facts resolved to one value per item and period: the latest filing's value, the earliest filing's year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.spelling import real_date, tag_name, unit_name

ANNUAL_FORMS = ("10-K", "10-K/A")
ANNUAL_DAYS = (330, 400)


def annual_forms(form: Column | str = "form") -> Column:
    return (F.col(form) if isinstance(form, str) else form).isin(*ANNUAL_FORMS)


def is_instant(start: Column) -> Column:
    """A balance-sheet fact has no start date, or an empty one."""
    return start.isNull() | (F.trim(start) == "")


def is_annual(start: Column, end: Column) -> Column:
    """Whether two dates lie a fiscal year apart, 52- and 53-week years included."""
    return F.datediff(end, start).between(*ANNUAL_DAYS)


def normalised(entries: DataFrame) -> DataFrame:
    """Fact entries with one spelling of tags, units and dates. NaN values are NULL; ``instant`` tells that no start is given."""
    return entries.select(
        "entry_id", "cik", tag_name("tag").alias("tag"), unit_name("unit").alias("unit"),
        real_date("period_start").alias("start"), real_date("period_end").alias("end"), real_date("filed").alias("filed"),
        is_instant(F.col("period_start")).alias("instant"), F.when(~F.isnan("val"), F.col("val")).alias("val"), "fy", "form",
    )


def chains(specs: DataFrame) -> DataFrame:
    """One row per item and tag, with the tag's place in the item's chain; the best tag has place 0."""
    return specs.select("item_key", "kind", unit_name("unit").alias("unit"), F.posexplode("tags").alias("place", "t")).select("item_key", "kind", "unit", "place", tag_name("t").alias("tag"))


def eligible(facts: DataFrame, specs: DataFrame) -> DataFrame:
    """Annual facts of the chains' tags in the chains' units, with a value and real dates. One pass over the facts: the
    forms and nulls are tested before the join; the dictionary of tags is a few hundred rows at most."""
    f = facts.where(annual_forms() & F.col("val").isNotNull() & F.col("end").isNotNull() & F.col("filed").isNotNull())
    kind = F.when(F.col("kind") == "instant", F.col("instant")).otherwise(~F.col("instant") & is_annual(F.col("start"), F.col("end")))
    return f.join(chains(specs), ["tag", "unit"]).where(kind)


def periods(found: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and period end: the value filed last, the fiscal year filed first, and whether a later filing changed the
    value. Entries of one filing date are ordered by ``entry_id``. One aggregation, no window."""
    order = F.struct("filed", "entry_id")
    g = found.groupBy(*keys, "end").agg(
        F.max_by("val", order).alias("value"), F.min_by("fy", order).alias("fiscal_year"), F.max("filed").alias("filed"),
        (F.min("filed") != F.max("filed")).alias("refiled"), F.min_by("val", order).alias("first_value"),
    )
    return g.select(*keys, "end", "value", "fiscal_year", "filed", (F.col("refiled") & (F.col("value") != F.col("first_value"))).alias("restated"))


def resolve(entries: DataFrame, specs: DataFrame) -> DataFrame:
    """(``cik``, ``item_key``, ``end``, ``value``, ``fiscal_year``, ``filed``, ``restated``, ``tag``): for each period on
    its own, the first tag of the item's chain that reports it. Two shuffles at most, on keys of one entity and item."""
    p = periods(eligible(normalised(entries), specs), ["cik", "item_key", "place", "tag"])
    first = F.min_by(F.struct("value", "fiscal_year", "filed", "restated", "tag"), "place").alias("r")
    return p.groupBy("cik", "item_key", "end").agg(first).select("cik", "item_key", "end", "r.*")


def recent_years(resolved: DataFrame, anchor: str = "total_assets", n: int = 5) -> DataFrame:
    """The last ``n`` distinct fiscal years of each entity's anchor item, with the latest period end of each."""
    ends = resolved.where((F.col("item_key") == anchor) & F.col("fiscal_year").isNotNull()).groupBy("cik", "fiscal_year").agg(F.max("end").alias("end"))
    w = Window.partitionBy("cik").orderBy(F.desc("end"), F.desc("fiscal_year"))
    return ends.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def for_periods(resolved: DataFrame, years: DataFrame) -> DataFrame:
    """The resolved values at the period ends of the chosen years."""
    return resolved.join(years.select("cik", "end"), ["cik", "end"], "left_semi")


def dense_grid(resolved: DataFrame, years: DataFrame, items: DataFrame) -> DataFrame:
    """Every item for every chosen year of every entity; a value that is not reported is NULL, never 0. The items are the
    dictionary's few dozen rows."""
    cells = years.crossJoin(F.broadcast(items.select("item_key")))
    return cells.join(resolved.select("cik", "item_key", "end", "value", "tag", "restated"), ["cik", "item_key", "end"], "left")


def provenance(grid: DataFrame) -> DataFrame:
    """Per entity and item, the tags its years came from, in order of year, each once."""
    told = grid.where("tag is not null").groupBy("cik", "item_key").agg(F.array_sort(F.collect_list(F.struct("fiscal_year", "tag"))).alias("t"))
    return told.select("cik", "item_key", F.array_join(F.array_distinct(F.transform("t", lambda x: x["tag"])), ",").alias("tags"))
