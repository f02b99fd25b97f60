"""Sheets as tables of cells: pivoted statements, addresses, formulas, escaped text, commentary rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.ratios import RATIOS, formula

NOT_REPORTED = "n/r"


def escape_cell(text: Column) -> Column:
    """Text that a spreadsheet would run as a formula gets a leading quote."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def address(column: Column, row: Column) -> Column:
    """The address of a cell, its column counted from 1: one letter to Z, two to ZZ; NULL beyond."""
    high, low = F.floor((column - 1) / 26).cast("int"), (column - 1) % 26
    letters = F.when(column <= 26, F.char(65 + low)).when(column <= 702, F.concat(F.char(64 + high), F.char(65 + low)))
    return F.concat(letters, row.cast("string"))


def quote_sheet(name: Column) -> Column:
    """The name of a sheet as a formula refers to it: quoted where it holds a blank or a dash."""
    return F.when(name.rlike(r"[ -]"), F.concat(F.lit("'"), name, F.lit("'"))).otherwise(name)


# Sheets of statements, number formats, the row of headers and the unit in which share counts are shown.
SHEETS = {"income": "Income Statement", "balance": "Balance Sheet", "cashflow": "Cash Flow"}
MONEY, PER_SHARE, PERCENT, RATIO, SHARES = "#,##0;(#,##0)", "#,##0.00;(#,##0.00)", "0.0%", "0.00", "#,##0.0;(#,##0.0)"
HEADER, SHOWN_SHARES = 3, 1_000_000.0
# Labels and formats of the ratios, in the order of their rows.
RATIO_ROWS = [
    ("gross_margin", "Gross margin", PERCENT), ("operating_margin", "Operating margin", PERCENT), ("net_margin", "Net margin", PERCENT), ("roa", "Return on assets", PERCENT), ("roe", "Return on equity", PERCENT),
    ("current_ratio", "Current ratio", RATIO), ("quick_ratio", "Quick ratio", RATIO), ("asset_turnover", "Asset turnover", RATIO), ("debt_to_equity", "Debt-to-equity", RATIO), ("fcf", "Free cash flow", MONEY),
    ("fcf_margin", "Free cash flow margin", PERCENT), ("revenue_growth", "Revenue growth (YoY)", PERCENT),
]
_ROW_OF = {key: HEADER + 1 + i for i, (key, *_) in enumerate(RATIO_ROWS)}


def placed_cells(grid: DataFrame, specs: DataFrame) -> DataFrame:
    """``grid`` with each cell's ``label``, ``unit``, ``sheet``, ``row``, ``col`` and ``at``, its address: years are columns from
    B on, the items of a statement are rows in order of key. ``specs`` is the dictionary, a few dozen rows."""
    order = F.row_number().over(Window.partitionBy("statement").orderBy("item_key"))
    known = F.create_map(*[F.lit(x) for pair in SHEETS.items() for x in pair])
    items = specs.select("item_key", "label", "unit", F.coalesce(F.try_element_at(known, F.lower("statement")), "statement").alias("sheet"), (order + HEADER).cast("int").alias("row"))
    years = grid.groupBy("cik").agg(F.array_sort(F.collect_set("fiscal_year")).alias("shown"))
    cells = grid.join(F.broadcast(items), "item_key").join(years, "cik").withColumn("col", (F.array_position("shown", F.col("fiscal_year")) + 1).cast("int")).drop("shown")
    return cells.withColumn("at", F.concat(quote_sheet(F.col("sheet")), F.lit("!"), address(F.col("col"), F.col("row"))))


def ratio_cells(cells: DataFrame, ratios: DataFrame) -> DataFrame:
    """(``cik``, ``fiscal_year``, ``ratio``, ``row``, ``col``, ``cell``, ``format``): each ratio as a formula over the addresses of
    its inputs, or ``n/a`` and ``n/m`` as its status says. The margin of free cash flow refers to its own sheet's row."""
    inputs = sorted({x for _, top, less, under, _ in RATIOS for x in (top, less, under) if x})
    at = cells.groupBy("cik", "fiscal_year", "col").agg(*[F.max(F.when(F.col("item_key") == i, F.col("at"))).alias(i) for i in inputs])
    before = F.lag("revenue").over(Window.partitionBy("cik").orderBy("col"))
    c, eq = F.col, F.lit("=")
    made = {name: formula(c(top), c(under), c(less) if less else None) if under else F.concat(eq, c(top), F.lit("-"), c(less)) for name, top, less, under, _ in RATIOS}
    made["fcf_margin"] = F.concat(eq, address(c("col"), F.lit(_ROW_OF["fcf"])), F.lit("/"), c("revenue"))
    made["revenue_growth"] = F.concat(F.lit("=("), c("revenue"), F.lit("-"), c("before"), F.lit(")/"), c("before"))
    rows = F.inline(F.array(*[F.struct(F.lit(k).alias("ratio"), F.lit(_ROW_OF[k]).alias("row"), made[k].alias("formula"), F.lit(fmt).alias("format")) for k, _, fmt in RATIO_ROWS]))
    each = at.withColumn("before", before).select("cik", "fiscal_year", "col", rows)
    shown = F.when(c("status") == "ok", c("formula")).otherwise(c("status"))
    return each.join(ratios.select("cik", "fiscal_year", "ratio", "status"), ["cik", "fiscal_year", "ratio"]).select("cik", "fiscal_year", "ratio", "row", "col", shown.alias("cell"), "format")


def _fields(*values: tuple) -> Column:
    """A row's (text, number, format) as cells from column 1 on."""
    return F.inline(F.array(*[F.struct(F.lit(i + 1).alias("col"), F.lit(t).cast("string").alias("text"), F.lit(v).cast("double").alias("number"), F.lit(f).cast("string").alias("format")) for i, (t, v, f) in enumerate(values)]))


def _tie_out(checks: DataFrame, residuals: DataFrame) -> DataFrame:
    """The rows of the tie-out: of each check its difference and verdict, then residuals, which are not scored. Rows are
    numbered over a company's few checks."""
    c, none = F.col, None
    told = checks.withColumn("row", F.row_number().over(Window.partitionBy("cik").orderBy("fiscal_year", "check")) + 4)
    name = F.concat_ws("_", "check", c("fiscal_year").cast("string"))
    scored = told.select("cik", "row", _fields((name, none, none), (none, c("fiscal_year"), none), (none, c("lhs"), MONEY), (none, c("rhs"), MONEY), (none, c("lhs") - c("rhs"), MONEY), (none, c("tolerance"), MONEY), (F.when(c("passed"), "PASS").otherwise("FAIL"), none, none)))
    last = told.groupBy("cik").agg(F.max("row").alias("last"))
    rest = residuals.join(last, "cik").withColumn("row", c("last") + 4 + F.row_number().over(Window.partitionBy("cik").orderBy("fiscal_year")))
    unscored = rest.select("cik", "row", _fields(("Retained earnings roll-forward", none, none), (none, c("fiscal_year"), none), (none, c("residual"), MONEY), (none, c("residual_pct") / 100, PERCENT)))
    return scored.unionByName(unscored).where("text is not null or number is not null")


def workbook(cells: DataFrame, ratios: DataFrame, checks: DataFrame, residuals: DataFrame, scales: DataFrame) -> DataFrame:
    """(``cik``, ``sheet``, ``row``, ``col``, ``text``, ``number``, ``formula``, ``format``): all cells of each company's workbook,
    three statements, ratios and tie-out. A value that is not reported reads ``n/r``; share counts are shown in millions
    by the company's ``scales``. A union of narrow rows."""
    c, lit, none = F.col, F.lit, F.lit(None)

    def out(df: DataFrame, sheet: Column, row: Column, col: Column, text: Column = none, number: Column = none, made: Column = none, fmt: Column = none) -> DataFrame:
        return df.select("cik", sheet.alias("sheet"), row.cast("int").alias("row"), col.cast("int").alias("col"), escape_cell(text.cast("string")).alias("text"), number.cast("double").alias("number"), made.cast("string").alias("formula"), fmt.cast("string").alias("format"))

    shares = c("unit") == "shares"
    shown = cells.join(scales, "cik", "left").withColumn("shown", F.when(shares, c("value") * F.coalesce("scale", lit(1.0)) / SHOWN_SHARES).otherwise(c("value")))
    fmt = F.when(shares, SHARES).when(c("unit") == "USD/shares", PER_SHARE).otherwise(MONEY)
    labels = cells.groupBy("cik", "sheet", "row", "label", "unit").agg(F.max(F.coalesce(c("tag").startswith("derived:"), lit(False))).alias("derived"))
    label = F.concat("label", F.when(shares, " (millions)").otherwise(""), F.when(c("derived"), " (derived)").otherwise(""))
    years = cells.select("cik", "sheet", "col", "fiscal_year").distinct()
    ratio_label = F.get(F.array(*[lit(name) for _, name, _ in RATIO_ROWS]), c("row") - (HEADER + 1))
    is_formula = c("cell").startswith("=")
    parts = [
        out(labels, c("sheet"), c("row"), lit(1), label),
        out(years, c("sheet"), lit(HEADER), c("col"), F.concat(lit("FY"), c("fiscal_year").cast("string"))),
        out(shown, c("sheet"), c("row"), c("col"), F.when(c("shown").isNull(), NOT_REPORTED), c("shown"), none, F.when(c("shown").isNotNull(), fmt)),
        out(ratios.select("cik", "row").distinct(), lit("Ratios"), c("row"), lit(1), ratio_label),
        out(ratios, lit("Ratios"), c("row"), c("col"), F.when(~is_formula, c("cell")), none, F.when(is_formula, c("cell")), F.when(is_formula, c("format"))),
        out(_tie_out(checks, residuals), lit("Tie-out"), c("row"), c("col"), c("text"), c("number"), none, c("format")),
    ]
    return reduce(DataFrame.unionByName, parts)


def statement_sheet(grid: DataFrame, keys: list[str], entity: list[str], column: str, width: int, value: str) -> DataFrame:
    """Long cells to one row per key: ``years``, the values of ``column`` that the entity's sheet shows, and a text column
    for each, ``v1`` the first; a missing value reads ``n/r``. ``width``: how many an entity has at most, as chosen when
    the grid was made. The years are an array of that many, not a fixed list."""
    shown = grid.groupBy(*entity).agg(F.array_sort(F.collect_set(column)).alias("shown"))
    placed = grid.join(shown, entity).withColumn("place", F.array_position("shown", F.col(column)))
    cells = [F.coalesce(F.max(F.when(F.col("place") == i, F.col(value))).cast("string"), F.lit(NOT_REPORTED)).alias(f"v{i}") for i in range(1, width + 1)]
    return placed.groupBy(*keys).agg(F.array_join(F.first("shown"), ",").alias("years"), *cells)


def commentary_rows(items: DataFrame, citations: DataFrame, key: str, order: str) -> DataFrame:
    """A row per citation, the item's label on its first only; an item without any gets one row with its reason.
    ``items``: key, ``label``, ``reason``; ``citations``: key, order, ``quote``."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("bigint")
    numbered = citations.withColumn("n", n)
    joined = items.join(numbered, key, "left")
    first = F.col("n").isNull() | (F.col("n") == 1)
    return joined.select(key, F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), F.when(first, F.col("label")).alias("label"), F.when(F.col("n").isNull(), F.col("reason")).otherwise(F.col("quote")).alias("body"))
