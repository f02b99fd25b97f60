"""Queries over reported facts: resolution, statements, identities, ratios, sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.figures import format_figure, parse_figure
from tallyloom.functions.spelling import item_name, real_date
from tallyloom.functions.text import sentences
from tallyloom.operators import facts as fx
from tallyloom.operators import identities as ids
from tallyloom.operators import statements as st
from tallyloom.operators.cells import commentary_rows, escape_cell, placed_cells, ratio_cells, statement_sheet, workbook
from tallyloom.operators.drafts import verdicts
from tallyloom.operators.evals import cell_accuracy
from tallyloom.operators.grounding import series_direction, year_claims
from tallyloom.operators.ratios import ratio_grid
from tallyloom.plans.sqlparts import ALL, FACTS, GRID, WIDE, YEARS, date, item, tolerance
from tallyloom.session import checkpointed, table


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    """Resolved once and kept in the shared folder: years, grid and checks all come from it, the facts are read once."""
    return checkpointed(fx.resolve(table(spark, d, "fact_entry"), table(spark, d, "tag_spec")))


def _grid(spark: SparkSession, d: str) -> DataFrame:
    r = _resolved(spark, d)
    return fx.dense_grid(r, fx.recent_years(r), table(spark, d, "tag_spec"))


def _wide(spark: SparkSession, d: str) -> DataFrame:
    return st.wide(_grid(spark, d))


def _with_prior(spark: SparkSession, d: str) -> DataFrame:
    return ids.with_prior(_wide(spark, d), ["cik"], "fiscal_year", "cash_and_equivalents", "prior_cash")


KEYS = ["cik", "fiscal_year"]


def q01_latest_filed_wins(spark: SparkSession, d: str) -> DataFrame:
    found = fx.eligible(fx.normalised(table(spark, d, "fact_entry")), table(spark, d, "tag_spec"))
    return fx.periods(found, ["cik", "item_key", "place", "tag"]).withColumn("place", F.col("place").cast("bigint"))


def q02_fallback_chain(spark: SparkSession, d: str) -> DataFrame:
    return fx.resolve(table(spark, d, "fact_entry"), table(spark, d, "tag_spec"))


def q03_annual_durations(spark: SparkSession, d: str) -> DataFrame:
    f = fx.normalised(table(spark, d, "fact_entry"))
    return f.where(fx.annual_forms() & ~F.col("instant") & fx.is_annual(F.col("start"), F.col("end"))).select("entry_id", F.datediff("end", "start").cast("bigint").alias("days"))


def q04_recent_years(spark: SparkSession, d: str) -> DataFrame:
    return fx.recent_years(_resolved(spark, d))


def q05_dense_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d)


def q06_period_semi_join(spark: SparkSession, d: str) -> DataFrame:
    r = _resolved(spark, d)
    return fx.for_periods(r, fx.recent_years(r)).select("cik", "item_key", "end", "value")


def q07_provenance_tags(spark: SparkSession, d: str) -> DataFrame:
    return fx.provenance(_grid(spark, d))


def _derived(spark: SparkSession, d: str) -> DataFrame:
    """The grid with liabilities derived where a company reports none. The dictionary has no liabilities-and-equity and no
    minority interest: assets stand for the one, income attributable to the parent tells of the other."""
    minority = st.has_minority(fx.normalised(table(spark, d, "fact_entry")), "netresultattributable")
    return st.derive_total_liabilities(_grid(spark, d), minority, "equityofparent", "total_assets")


def q08_derived_liabilities(spark: SparkSession, d: str) -> DataFrame:
    return _derived(spark, d).where("item_key = 'total_liabilities'").select("cik", "fiscal_year", "value", "tag")


def q09_derived_gross_profit(spark: SparkSession, d: str) -> DataFrame:
    g = st.derive(_grid(spark, d), "gross_profit", F.col("revenue") - F.col("cost_of_revenue"), "revenue-cost_of_revenue")
    return g.where("item_key = 'gross_profit'").select("cik", "fiscal_year", "value", "tag")


def q10_identity_checks(spark: SparkSession, d: str) -> DataFrame:
    return ids.checks(_with_prior(spark, d), KEYS)


def q11_cash_roll_forward(spark: SparkSession, d: str) -> DataFrame:
    return q10_identity_checks(spark, d).where(F.col("check") == "cash_roll_forward")


def _optional(spark: SparkSession, d: str) -> DataFrame:
    """Operating income stands for income before tax and interest for the optional term."""
    return _with_prior(spark, d).withColumn("pretax_income", F.col("operating_income")).withColumn("noncontrolling_interest_in_income", F.col("interest_expense"))


def q12_optional_term_identity(spark: SparkSession, d: str) -> DataFrame:
    return ids.checks(_optional(spark, d), KEYS).where(F.col("check") == "net_income_buildup")


def _drafts(figures: DataFrame) -> DataFrame:
    """One draft on each company's item with two years or more, each with one of 13 kinds of faults or none."""
    w = Window.partitionBy("subject").orderBy("fiscal_year")
    ends = figures.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("subject"))).withColumn("before", F.lag("figure").over(w)).withColumn("first", F.first("figure").over(w))
    last = ends.groupBy("subject", "cik", "item_key").agg(F.max_by(F.struct("fiscal_year", "figure", "before", "first", "value"), "fiscal_year").alias("l"), F.max("n").alias("n")).where("n >= 2").select("subject", "cik", "item_key", "l.*")
    plain = lambda c: F.regexp_replace(c, " shares$", "")
    year, f, g, first = F.col("fiscal_year").cast("string"), plain(F.col("figure")), plain(F.col("before")), plain(F.col("first"))
    other_sign = F.when(f.startswith("-"), F.substr(f, F.lit(2))).otherwise(F.concat(F.lit("-"), f))
    chunk = F.concat("item_key", F.lit("-0001"))
    cited = lambda text, chunk_id, quote: F.to_json(F.struct(text.alias("text"), F.array(F.struct(chunk_id.alias("chunk_id"), quote.alias("quote"))).alias("citations")), {"ignoreNullFields": "false"})
    said = lambda *parts: F.to_json(F.struct(F.concat(*parts).alias("text")))
    quote, lit = F.concat("item_key", F.lit(" is reported")), F.lit
    kinds = [
        lit("not json"),
        cited(lit("a"), lit("BAD"), quote),
        cited(lit(None).cast("string"), chunk, quote),
        cited(lit("a"), lit("none-9999"), quote),
        cited(lit("a"), chunk, F.repeat(lit("x"), 301)),
        cited(lit("a"), chunk, lit("  ab ")),
        cited(lit("a"), chunk, lit("not in the text at all")),
        said(lit("It was $1.0101T.")),
        said(lit("It was "), other_sign, lit(".")),
        said(g, lit(" in FY"), year, lit(" was told.")),
        said(lit("It rose to "), f, lit(" from "), g, lit(".")),
        said(lit("It rose steadily from "), first, lit(" to "), f, lit(".")),
        cited(F.concat(lit("It was "), f, lit(" in FY"), year, lit(".")), chunk, quote),
    ]
    kind = ((F.col("cik") + F.length("item_key")) % len(kinds)).cast("int")
    return last.select(F.col("subject").alias("draft_id"), "subject", F.get(F.array(*kinds), kind).alias("raw"))


def q66_draft_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Drafts on the companies' figures, held against them and against a chunk on each item of the dictionary."""
    f = checkpointed(_figures(spark, d).withColumn("subject", F.concat_ws("-", F.col("cik").cast("string"), "item_key")))
    chunks = table(spark, d, "tag_spec").select(F.concat("item_key", F.lit("-0001")).alias("chunk_id"), F.concat("item_key", F.lit(" is reported, as "), "label").alias("text"))
    return verdicts(_drafts(f), f.select("subject", "fiscal_year", "figure"), chunks)


def q67_all_checks(spark: SparkSession, d: str) -> DataFrame:
    """All checks of a derived grid, with items standing for those the dictionary lacks: the parts of operating expenses
    for their sum, and three kinds of assets for liabilities-and-equity, so that a derived balance sheet is checked."""
    w = ids.with_prior(st.wide(_derived(spark, d)), ["cik"], "fiscal_year", "cash_and_equivalents", "prior_cash")
    c = F.col
    w = w.withColumn("pretax_income", c("operating_income")).withColumn("noncontrolling_interest_in_income", c("interest_expense"))
    w = w.withColumn("operating_expenses", c("research_development") + c("selling_marketing_expense") + c("general_administrative_expense"))
    w = w.withColumn("total_liabilities_and_equity", c("total_current_assets") + c("ppe_net"))
    derived = F.max(F.coalesce(c("tag_total_liabilities").startswith("derived:"), F.lit(False))).over(Window.partitionBy("cik"))
    return ids.checks(w.withColumn("derived", derived), KEYS, c("derived"))


def q13_insufficient_data(spark: SparkSession, d: str) -> DataFrame:
    return q10_identity_checks(spark, d).where(F.col("check") == "insufficient_data")


def q14_residuals(spark: SparkSession, d: str) -> DataFrame:
    w = ids.with_prior(_wide(spark, d), ["cik"], "fiscal_year", "retained_earnings", "prior_retained")
    r = ids.residuals(w, KEYS)
    return r.select(*KEYS, F.round("residual", 2).alias("residual"), F.round("residual_pct", 6).alias("residual_pct"))


def q15_report(spark: SparkSession, d: str) -> DataFrame:
    return ids.report(q10_identity_checks(spark, d), ["cik"])


def _ratios(spark: SparkSession, d: str) -> DataFrame:
    w = _wide(spark, d).withColumn("before", F.lag("revenue").over(Window.partitionBy("cik").orderBy("fiscal_year")))
    return ratio_grid(w, KEYS, "before").withColumn("value", F.round("value", 9))


def q16_ratio_grid(spark: SparkSession, d: str) -> DataFrame:
    return _ratios(spark, d)


def q17_free_cash_flow(spark: SparkSession, d: str) -> DataFrame:
    return _ratios(spark, d).where(F.col("ratio").isin("fcf", "fcf_margin"))


def q18_growth(spark: SparkSession, d: str) -> DataFrame:
    return _ratios(spark, d).where("ratio = 'revenue_growth'")


def q19_share_scale(spark: SparkSession, d: str) -> DataFrame:
    return st.share_scale(_wide(spark, d), ["cik"], "fiscal_year", "weighted_diluted_shares", "eps_diluted", "net_income")


def _figures(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "tag_spec").select("item_key", "unit")
    g = _grid(spark, d).join(F.broadcast(units), "item_key").where("value is not null")
    return g.select("cik", "item_key", "fiscal_year", "value", format_figure(F.col("value"), F.col("unit")).alias("figure"))


def q20_format_figures(spark: SparkSession, d: str) -> DataFrame:
    return _figures(spark, d).select("cik", "item_key", "fiscal_year", "figure")


def q21_parse_figures(spark: SparkSession, d: str) -> DataFrame:
    return _figures(spark, d).select("cik", "item_key", "fiscal_year", F.round(parse_figure(F.col("figure")), 2).alias("parsed"))


def q22_escape_cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "line_item").select("obs_id", escape_cell(F.col("value_text")).alias("cell"))


def q23_statement_sheet(spark: SparkSession, d: str) -> DataFrame:
    """Each company's sheets: its presented years are the columns, oldest first; a row per item of each statement."""
    specs = table(spark, d, "tag_spec").select("item_key", "statement", "label")
    g = _grid(spark, d).join(F.broadcast(specs), "item_key").withColumn("v", F.col("value").cast("decimal(38,2)"))
    return statement_sheet(g, ["cik", "statement", "item_key", "label"], ["cik"], "fiscal_year", 5, "v")


def q24_formulas(spark: SparkSession, d: str) -> DataFrame:
    """Every ratio as the formula that a workbook would hold, or why it holds none."""
    g = checkpointed(_grid(spark, d))
    w = st.wide(g).withColumn("before", F.lag("revenue").over(Window.partitionBy("cik").orderBy("fiscal_year")))
    return ratio_cells(placed_cells(g, table(spark, d, "tag_spec")), ratio_grid(w, KEYS, "before")).select("cik", "fiscal_year", "ratio", "cell")


def q69_workbook(spark: SparkSession, d: str) -> DataFrame:
    """All cells of the companies' workbooks, with derived liabilities."""
    g = checkpointed(_derived(spark, d))
    cells = placed_cells(g, table(spark, d, "tag_spec"))
    w = st.wide(g).withColumn("before", F.lag("revenue").over(Window.partitionBy("cik").orderBy("fiscal_year")))
    w = ids.with_prior(ids.with_prior(w, ["cik"], "fiscal_year", "cash_and_equivalents", "prior_cash"), ["cik"], "fiscal_year", "retained_earnings", "prior_retained")
    scales = st.share_scale(w, ["cik"], "fiscal_year", "weighted_diluted_shares", "eps_diluted", "net_income")
    derived = F.coalesce(F.col("tag_total_liabilities").startswith("derived:"), F.lit(False))
    return workbook(cells, ratio_cells(cells, ratio_grid(w, KEYS, "before")), ids.checks(w, KEYS, derived), ids.residuals(w, KEYS), scales)


def q25_commentary_rows(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "company").select(F.col("cik_str").alias("cik"), F.col("title").alias("label"), F.lit("no documents").alias("reason"))
    quotes = table(spark, d, "documents").where("section is not null").select("cik", "doc_id", F.col("section").alias("quote"))
    return commentary_rows(items, quotes, "cik", "doc_id")


def q41_directions(spark: SparkSession, d: str) -> DataFrame:
    series = _grid(spark, d).where("value is not null")
    return series_direction(series, ["cik", "item_key"], "fiscal_year", "value")


def q42_cell_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Cells resolved from the facts against the standing snapshot values of the same company, item and period."""
    gold = _resolved(spark, d).select("cik", "item_key", "end", "value")
    r = table(spark, d, "resolved_value").select("cik", item_name("item_key").alias("item_key"), real_date("period_end").alias("end"), real_date("filed").alias("f"), "loaded_at", "snapshot_id", "value").where("f is not null")
    actual = r.groupBy("cik", "item_key", "end").agg(F.max_by("value", F.struct("f", "loaded_at", "snapshot_id")).alias("value"))
    return cell_accuracy(gold, actual, ["cik", "item_key", "end"], "item_key")


def q57_check_sheet(spark: SparkSession, d: str) -> DataFrame:
    """The checks as a sheet shows them: difference and verdict."""
    c = q10_identity_checks(spark, d)
    return c.select(*KEYS, F.concat_ws("_", "check", F.col("fiscal_year").cast("string")).alias("check_id"), (F.col("lhs") - F.col("rhs")).alias("diff"), F.when(F.col("passed"), "PASS").otherwise("FAIL").alias("verdict"))


def q58_fact_trim(spark: SparkSession, d: str) -> DataFrame:
    """Facts of the dictionary's tags in annual filings whose period ends in 2016 or later; tags left without facts are gone."""
    f = fx.normalised(table(spark, d, "fact_entry")).where(fx.annual_forms() & (F.col("end") >= F.lit("2016-01-01").cast("date")))
    return f.join(F.broadcast(fx.chains(table(spark, d, "tag_spec")).select("tag").distinct()), "tag", "left_semi").groupBy("cik", "tag").agg(F.count(F.lit(1)).alias("n"), F.max("end").alias("last_end"))


def q59_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Filled cells of each item's grid."""
    return _grid(spark, d).groupBy("item_key").agg(F.count("value").alias("n_filled"), F.count(F.lit(1)).alias("n_cells"), F.count_if("restated").alias("n_restated"))


def q60_nested_gold(spark: SparkSession, d: str) -> DataFrame:
    """Each company's grid as one nested document, and what reading it back gives: its cells and their sum."""
    cells = _grid(spark, d).where("value is not null").groupBy("cik", "item_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("fiscal_year").cast("string"), "value")))).alias("years"))
    docs = cells.groupBy("cik").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("item_key", F.map_entries("years").alias("e")))))).alias("j"))
    back = docs.select("cik", F.from_json("j", "MAP<STRING, ARRAY<STRUCT<key: STRING, value: DOUBLE>>>").alias("m")).select("cik", F.explode("m").alias("item_key", "e")).select("cik", "item_key", F.explode("e").alias("c"))
    return back.groupBy("cik", "item_key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c.value").cast("decimal(38,4)")).cast("double").alias("total"))


def q61_year_claims(spark: SparkSession, d: str) -> DataFrame:
    figures = _figures(spark, d).select("cik", "fiscal_year", F.col("figure").alias("token"))
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "cik", F.explode(sentences(F.col("text"))).alias("sentence"))
    years = _figures(spark, d).select("cik", "fiscal_year", F.explode(F.array(F.concat(F.lit("$"), F.format_number(F.round(F.abs("value") / 1e6, 1), 1)), F.regexp_extract("figure", r"^-?(.*?)(?: shares)?$", 1))).alias("token"))
    return year_claims(docs, figures.unionByName(years))


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q") and name[1:3].isdigit() and callable(f)}


def _check_sql(name: str, lhs: str, rhs: str, terms: list[str], needed: list[str], frm: str = "w") -> str:
    gate = " AND ".join(f"{n} IS NOT NULL" for n in needed)
    return f"SELECT cik, fiscal_year, '{name}' AS \"check\", {lhs} AS lhs, {rhs} AS rhs, {tolerance(terms)} AS tolerance, abs(({lhs}) - ({rhs})) <= {tolerance(terms)} AS passed FROM {frm} WHERE {gate}"


_W = "w AS (SELECT a.*, b.cash_and_equivalents AS prior_cash FROM wide a LEFT JOIN wide b ON b.cik = a.cik AND b.fiscal_year = a.fiscal_year - 1)"
_BS = ["total_assets", "total_liabilities", "total_equity"]
_GP = ["gross_profit", "revenue", "cost_of_revenue"]
_CASH = ["cash_and_equivalents", "prior_cash", "cfo", "cfi", "cff"]
_CHECKS = " UNION ALL ".join(
    [
        _check_sql("balance_sheet_equation", "total_assets", "total_liabilities + total_equity", _BS, _BS),
        _check_sql("gross_profit_buildup", "gross_profit", "revenue - cost_of_revenue", _GP, _GP),
        _check_sql("cash_roll_forward", "cash_and_equivalents - prior_cash", "cfo + cfi + cff + coalesce(fx_effect_on_cash, 0)", [*_CASH, "fx_effect_on_cash"], _CASH),
    ]
)
_ALL_CHECKS = f"""{ALL}, {_W}, made AS ({_CHECKS}), checks AS (SELECT * FROM made UNION ALL
  SELECT cik, fiscal_year, 'insufficient_data', NULL::DOUBLE, NULL::DOUBLE, 0.0::DOUBLE, false FROM w WHERE NOT EXISTS (SELECT 1 FROM made m WHERE m.cik = w.cik AND m.fiscal_year = w.fiscal_year))"""

_RATIO = [
    ("gross_margin", "gross_profit", "gross_profit", "revenue", "= 0"), ("operating_margin", "operating_income", "operating_income", "revenue", "= 0"), ("net_margin", "net_income", "net_income", "revenue", "= 0"),
    ("roa", "net_income", "net_income", "total_assets", "= 0"), ("roe", "net_income", "net_income", "total_equity", "<= 0"), ("current_ratio", "total_current_assets", "total_current_assets", "total_current_liabilities", "= 0"),
    ("quick_ratio", "total_current_assets - inventory", "total_current_assets, inventory", "total_current_liabilities", "= 0"), ("asset_turnover", "revenue", "revenue", "total_assets", "= 0"),
    ("debt_to_equity", "total_liabilities", "total_liabilities", "total_equity", "<= 0"), ("fcf_margin", "cfo - capex", "cfo, capex", "revenue", "= 0"), ("revenue_growth", "revenue - before", "revenue, before", "before", "= 0"),
]


def _ratio_sql() -> str:
    parts = ["SELECT cik, fiscal_year, 'fcf' AS ratio, CASE WHEN cfo IS NULL OR capex IS NULL THEN 'n/a' ELSE 'ok' END AS status, round(cfo - capex, 9) AS value FROM b"]
    for name, top, inputs, under, bad in _RATIO:
        missing = " OR ".join(f"{x.strip()} IS NULL" for x in [*inputs.split(","), under])
        parts.append(f"SELECT cik, fiscal_year, '{name}', CASE WHEN {missing} THEN 'n/a' WHEN {under} {bad} THEN 'n/m' ELSE 'ok' END, CASE WHEN {missing} OR {under} {bad} THEN NULL ELSE round(({top}) / {under}, 9) END FROM b")
    return f"{ALL}, b AS (SELECT *, lag(revenue) OVER (PARTITION BY cik ORDER BY fiscal_year) AS before FROM wide), ratios AS ({' UNION ALL '.join(parts)}) SELECT * FROM ratios"


def _formula_sql() -> str:
    """Formulas of the same ratios over addresses, told by the statuses above."""
    made = {"fcf": "'=' || cfo || '-' || capex", "fcf_margin": "'=' || chr((64 + col)::INT) || '13/' || revenue", "revenue_growth": "'=(' || revenue || '-' || before || ')/' || before", "quick_ratio": "'=(' || total_current_assets || '-' || inventory || ')/' || total_current_liabilities"}
    for name, top, _, under, _ in _RATIO:
        made.setdefault(name, f"'=' || {top} || '/' || {under}")
    cases = " ".join(f"WHEN '{name}' THEN {f}" for name, f in made.items())
    items = "revenue gross_profit operating_income net_income total_assets total_equity total_current_assets total_current_liabilities inventory total_liabilities cfo capex".split()
    cells = ", ".join(f"max(addr) FILTER (item_key = '{i}') AS {i}" for i in items)
    return f"""{_ratio_sql().removesuffix(' SELECT * FROM ratios')},
sh AS (SELECT item_key, chr(39) || CASE statement WHEN 'income' THEN 'Income Statement' WHEN 'balance' THEN 'Balance Sheet' ELSE 'Cash Flow' END || chr(39) AS sheet, 3 + row_number() OVER (PARTITION BY statement ORDER BY item_key) AS r FROM tag_spec),
pc AS (SELECT cik, fiscal_year, item_key, col, sheet || '!' || chr((64 + col)::INT) || r::VARCHAR AS addr FROM (SELECT *, 1 + dense_rank() OVER (PARTITION BY cik ORDER BY fiscal_year) AS col FROM grid JOIN sh USING (item_key))),
aw AS (SELECT cik, fiscal_year, col, {cells} FROM pc GROUP BY ALL), ab AS (SELECT *, lag(revenue) OVER (PARTITION BY cik ORDER BY fiscal_year) AS before FROM aw)
SELECT cik, fiscal_year, ratio, CASE WHEN status <> 'ok' THEN status ELSE CASE ratio {cases} END END AS cell FROM ratios JOIN ab USING (cik, fiscal_year)"""


_FIGURE = """CASE WHEN value < 0 THEN '-' ELSE '' END || CASE WHEN unit = 'USD/shares' THEN '$' || format('{:,.2f}', abs(value))
  ELSE CASE WHEN unit = 'shares' THEN '' ELSE '$' END || CASE WHEN abs(value) >= 1e9 THEN format('{:,.2f}', abs(value) / 1e9) || 'B' WHEN abs(value) >= 1e6 THEN format('{:,.2f}', abs(value) / 1e6) || 'M'
    WHEN abs(value) >= 1e3 THEN format('{:,.2f}', abs(value) / 1e3) || 'K' ELSE format('{:,.2f}', abs(value)) END || CASE WHEN unit = 'shares' THEN ' shares' ELSE '' END END"""
_FIGURES = f"{ALL}, fig AS (SELECT cik, item_key, fiscal_year, value, {_FIGURE} AS figure FROM grid JOIN (SELECT item_key, unit FROM tag_spec) USING (item_key) WHERE value IS NOT NULL)"


def _derived_sql(item_key: str, value: str, marker: str, barred: str = "false") -> str:
    return f"""{ALL}, absent AS (SELECT cik FROM grid WHERE item_key = '{item_key}' GROUP BY 1 HAVING count(value) = 0),
eq AS (SELECT cik, fiscal_year, tag AS equity_tag FROM grid WHERE item_key = 'total_equity'), mi AS (SELECT DISTINCT cik AS minority FROM facts WHERE tag = 'netresultattributable'),
n AS (SELECT cik, fiscal_year, CASE WHEN {barred} THEN NULL ELSE {value} END AS v FROM wide JOIN eq USING (cik, fiscal_year) LEFT JOIN mi ON minority = cik WHERE cik IN (SELECT cik FROM absent)),
dv AS (SELECT g.cik, g.item_key, g.fiscal_year, coalesce(g.value, CASE WHEN g.item_key = '{item_key}' THEN n.v END) AS value, CASE WHEN g.item_key = '{item_key}' AND n.v IS NOT NULL THEN 'derived:{marker}' ELSE g.tag END AS tag
FROM grid g LEFT JOIN n ON n.cik = g.cik AND n.fiscal_year = g.fiscal_year)"""


_BARRED = "equity_tag = 'equityofparent' AND minority IS NOT NULL"
_LIABILITIES = _derived_sql("total_liabilities", "total_assets - total_equity", "total_assets-total_equity", _BARRED)
_BSI, _OP = ["total_assets", "lse"], ["operating_income", "gross_profit", "opex"]
_SIX = " UNION ALL ".join(
    [
        _check_sql("balance_sheet_equation", "total_assets", "liabilities + total_equity", ["total_assets", "liabilities", "total_equity"], ["total_assets", "liabilities", "total_equity"], "(SELECT * FROM w6 WHERE NOT made_up)"),
        _check_sql("balance_sheet_equation_independent", "total_assets", "lse", _BSI, _BSI, "(SELECT * FROM w6 WHERE made_up)"),
        _check_sql("gross_profit_buildup", "gross_profit", "revenue - cost_of_revenue", _GP, _GP, "w6"),
        _check_sql("operating_income_buildup", "operating_income", "gross_profit - opex", _OP, _OP, "w6"),
        _check_sql("net_income_buildup", "net_income", "operating_income - income_tax_expense - coalesce(interest_expense, 0)", ["net_income", "operating_income", "income_tax_expense", "interest_expense"], ["net_income", "operating_income", "income_tax_expense"], "w6"),
        _check_sql("cash_roll_forward", "cash_and_equivalents - prior_cash", "cfo + cfi + cff + coalesce(fx_effect_on_cash, 0)", [*_CASH, "fx_effect_on_cash"], _CASH, "w6"),
    ]
)
_ALL_SIX = f"""{_LIABILITIES}, dw AS (SELECT cik, fiscal_year, max(value) AS liabilities, coalesce(max(tag) LIKE 'derived:%', false) AS here FROM dv WHERE item_key = 'total_liabilities' GROUP BY ALL),
w6 AS (SELECT a.*, b.cash_and_equivalents AS prior_cash, liabilities, bool_or(here) OVER (PARTITION BY a.cik) AS made_up, a.research_development + a.selling_marketing_expense + a.general_administrative_expense AS opex, a.total_current_assets + a.ppe_net AS lse
  FROM wide a JOIN dw ON dw.cik = a.cik AND dw.fiscal_year = a.fiscal_year LEFT JOIN wide b ON b.cik = a.cik AND b.fiscal_year = a.fiscal_year - 1),
made AS ({_SIX}) SELECT * FROM made UNION ALL SELECT cik, fiscal_year, 'insufficient_data', NULL::DOUBLE, NULL::DOUBLE, 0.0::DOUBLE, false FROM w6 WHERE NOT EXISTS (SELECT 1 FROM made m WHERE m.cik = w6.cik AND m.fiscal_year = w6.fiscal_year)"""
_SHEET = ", ".join(f"coalesce(max(CASE WHEN n = {i} THEN value::DECIMAL(38, 2) END)::VARCHAR, 'n/r') AS v{i}" for i in range(1, 6))
_LOG = "abs(ln(s * {k}) - ln(implied))"

_PARSED = """CASE WHEN figure LIKE '-%' THEN -1 ELSE 1 END * regexp_extract(replace(figure, ',', ''), '[0-9.]+')::DOUBLE
 * CASE WHEN figure LIKE '%K%' THEN 1e3 WHEN figure LIKE '%M%' THEN 1e6 WHEN figure LIKE '%B%' THEN 1e9 ELSE 1 END"""
# What each planted fault is to be found as; a change is told of by the figures as they are written.
_DRAFTS = f"""{_FIGURES}, p AS (SELECT cik, item_key, fiscal_year, figure, {_PARSED} AS v FROM fig),
s AS (SELECT *, lag(v) OVER w AS u, lag(figure) OVER w AS g, first_value(v) OVER w AS v0, first_value(fiscal_year) OVER w AS y0, first_value(figure) OVER w AS f0, count(*) OVER (PARTITION BY cik, item_key) AS n FROM p WINDOW w AS (PARTITION BY cik, item_key ORDER BY fiscal_year)),
l AS (SELECT s.*, bool_or(coalesce(u > 0 AND v > 0 AND (v - u) / u < -0.005, false)) OVER (PARTITION BY cik, item_key) AS dips, row_number() OVER (PARTITION BY cik, item_key ORDER BY fiscal_year DESC) AS r, (cik + length(item_key)) % 13 AS k FROM s WHERE n >= 2),
t AS (SELECT * FROM l WHERE r = 1)
SELECT cik::VARCHAR || '-' || item_key AS draft_id, CASE k WHEN 0 THEN 'not_json' WHEN 1 THEN 'bad_shape' WHEN 2 THEN 'refusal_with_citations' WHEN 3 THEN 'unknown_chunk' WHEN 4 THEN 'too_long' WHEN 5 THEN 'too_short' WHEN 6 THEN 'not_verbatim' WHEN 7 THEN 'ungrounded'
  WHEN 8 THEN 'wrong_sign' WHEN 9 THEN CASE WHEN g = figure THEN 'ok' ELSE 'wrong_year' END
  WHEN 10 THEN CASE WHEN u > 0 AND v > 0 AND (v - u) / u < -0.02 THEN 'wrong_direction' ELSE 'ok' END
  WHEN 11 THEN CASE WHEN NOT (v0 > 0 AND v > 0) OR abs((v - v0) / v0) <= 0.02 THEN 'ok' WHEN v < v0 THEN 'wrong_direction' WHEN dips THEN 'not_steady' ELSE 'ok' END ELSE 'ok' END AS verdict FROM t"""

SQL = {
    "q66_draft_verdicts": _DRAFTS,
    "q01_latest_filed_wins": f"WITH {FACTS} SELECT * FROM per",
    "q02_fallback_chain": f"WITH {FACTS} SELECT * EXCLUDE (place) FROM res",
    "q03_annual_durations": f"WITH {FACTS} SELECT entry_id, (e - s)::BIGINT AS days FROM facts WHERE form IN ('10-K', '10-K/A') AND NOT instant AND e - s BETWEEN 330 AND 400",
    "q04_recent_years": f"WITH {FACTS}, {YEARS} SELECT * FROM yrs",
    "q05_dense_grid": f"WITH {FACTS}, {YEARS}, {GRID} SELECT * FROM grid",
    "q06_period_semi_join": f'WITH {FACTS}, {YEARS} SELECT cik, item_key, "end", value FROM res SEMI JOIN (SELECT cik, "end" FROM yrs) USING (cik, "end")',
    "q07_provenance_tags": f"WITH {FACTS}, {YEARS}, {GRID}, t AS (SELECT cik, item_key, tag, min(fiscal_year) AS y FROM grid WHERE tag IS NOT NULL GROUP BY ALL) SELECT cik, item_key, string_agg(tag, ',' ORDER BY y, tag) AS tags FROM t GROUP BY ALL",
    "q08_derived_liabilities": f"{_LIABILITIES} SELECT cik, fiscal_year, value, tag FROM dv WHERE item_key = 'total_liabilities'",
    "q09_derived_gross_profit": _derived_sql("gross_profit", "revenue - cost_of_revenue", "revenue-cost_of_revenue") + " SELECT cik, fiscal_year, value, tag FROM dv WHERE item_key = 'gross_profit'",
    "q67_all_checks": _ALL_SIX,
    "q10_identity_checks": f"{_ALL_CHECKS} SELECT * FROM checks",
    "q11_cash_roll_forward": f"{_ALL_CHECKS} SELECT * FROM checks WHERE \"check\" = 'cash_roll_forward'",
    "q12_optional_term_identity": f"{ALL}, w AS (SELECT * FROM wide) "
    + _check_sql("net_income_buildup", "net_income", "operating_income - income_tax_expense - coalesce(interest_expense, 0)", ["net_income", "operating_income", "income_tax_expense", "interest_expense"], ["net_income", "operating_income", "income_tax_expense"]),
    "q13_insufficient_data": f"{_ALL_CHECKS} SELECT * FROM checks WHERE \"check\" = 'insufficient_data'",
    "q14_residuals": f"""{ALL}, r AS (SELECT a.cik, a.fiscal_year, a.total_assets, a.retained_earnings - (b.retained_earnings + a.net_income - coalesce(a.dividends_paid, 0) - coalesce(a.share_repurchases, 0)) AS gap
FROM wide a JOIN wide b ON b.cik = a.cik AND b.fiscal_year = a.fiscal_year - 1)
SELECT cik, fiscal_year, round(gap, 2) AS residual, CASE WHEN total_assets <> 0 THEN round(gap / total_assets * 100, 6) END AS residual_pct FROM r WHERE gap IS NOT NULL""",
    "q15_report": f"{_ALL_CHECKS} SELECT cik, bool_and(passed) AS passed, count(*) FILTER (passed)::BIGINT AS n_passed, count(*)::BIGINT AS n_total FROM checks GROUP BY cik",
    "q16_ratio_grid": _ratio_sql(),
    "q17_free_cash_flow": _ratio_sql() + " WHERE ratio IN ('fcf', 'fcf_margin')",
    "q18_growth": _ratio_sql() + " WHERE ratio = 'revenue_growth'",
    "q19_share_scale": f"""{ALL}, v AS (SELECT cik, fiscal_year, weighted_diluted_shares AS s, net_income / nullif(eps_diluted, 0) AS implied FROM wide WHERE net_income <> 0),
votes AS (SELECT cik, fiscal_year, CASE WHEN {_LOG.format(k=1.0)} <= {_LOG.format(k=1e3)} AND {_LOG.format(k=1.0)} <= {_LOG.format(k=1e6)} THEN 1.0 WHEN {_LOG.format(k=1e3)} <= {_LOG.format(k=1e6)} THEN 1000.0 ELSE 1000000.0 END::DOUBLE AS scale FROM v WHERE s > 0 AND implied > 0),
won AS (SELECT cik, scale FROM votes GROUP BY cik, scale QUALIFY row_number() OVER (PARTITION BY cik ORDER BY count(*) DESC, max(fiscal_year) DESC) = 1),
last_ AS (SELECT cik, arg_max(weighted_diluted_shares, fiscal_year) AS l FROM wide GROUP BY 1)
SELECT cik, coalesce(scale, CASE WHEN l > 0 AND l < 1e6 THEN 1000000.0 ELSE 1.0 END)::DOUBLE AS scale FROM last_ LEFT JOIN won USING (cik)""",
    "q20_format_figures": f"{_FIGURES} SELECT cik, item_key, fiscal_year, figure FROM fig",
    "q21_parse_figures": f"""{_FIGURES} SELECT cik, item_key, fiscal_year, round(CASE WHEN figure LIKE '-%' THEN -1 ELSE 1 END * regexp_extract(replace(figure, ',', ''), '[0-9.]+')::DOUBLE
 * CASE WHEN figure LIKE '%K%' THEN 1e3 WHEN figure LIKE '%M%' THEN 1e6 WHEN figure LIKE '%B%' THEN 1e9 ELSE 1 END, 2) AS parsed FROM fig""",
    "q22_escape_cells": "SELECT obs_id, CASE WHEN regexp_matches(value_text, '^[=+\\-@\\t\\r]') THEN '''' || value_text ELSE value_text END AS cell FROM line_item",
    "q23_statement_sheet": f"""WITH {FACTS}, {YEARS}, {GRID}, n AS (SELECT *, dense_rank() OVER (PARTITION BY cik ORDER BY fiscal_year) AS n, count(DISTINCT fiscal_year) OVER (PARTITION BY cik) AS n_years FROM grid JOIN (SELECT item_key, statement, label FROM tag_spec) USING (item_key))
SELECT cik, statement, item_key, label, string_agg(DISTINCT fiscal_year::VARCHAR, ',' ORDER BY fiscal_year::VARCHAR) AS years, {_SHEET} FROM n GROUP BY cik, statement, item_key, label""",
    "q24_formulas": _formula_sql(),
    "q25_commentary_rows": """WITH q AS (SELECT cik, section, row_number() OVER (PARTITION BY cik ORDER BY doc_id) AS n FROM documents WHERE section IS NOT NULL)
SELECT cik_str AS cik, coalesce(n, 0)::BIGINT AS n, CASE WHEN n IS NULL OR n = 1 THEN title END AS label, CASE WHEN n IS NULL THEN 'no documents' ELSE section END AS body FROM company LEFT JOIN q ON q.cik = cik_str""",
    "q41_directions": f"""{ALL}, x AS (SELECT cik, item_key, fiscal_year, value, lead(value) OVER (PARTITION BY cik, item_key ORDER BY fiscal_year) AS nx FROM grid WHERE value IS NOT NULL),
g AS (SELECT cik, item_key, count(*)::BIGINT AS n_points, min(value) AS least, arg_min(value, fiscal_year) AS a, arg_max(value, fiscal_year) AS b, max(CASE WHEN value > 0 THEN (nx - value) / value END) AS up, min(CASE WHEN value > 0 THEN (nx - value) / value END) AS down FROM x GROUP BY ALL),
c AS (SELECT *, CASE WHEN n_points >= 2 AND least > 0 THEN (b - a) / a END AS ch FROM g)
SELECT cik, item_key, n_points, round(ch, 6) AS change, CASE WHEN ch > 0.02 THEN 'up' WHEN ch < -0.02 THEN 'down' WHEN ch IS NOT NULL THEN 'flat' END AS direction,
       CASE WHEN ch > 0.02 THEN down >= -0.005 WHEN ch < -0.02 THEN up <= 0.005 END AS steady FROM c""",
    "q42_cell_accuracy": f"""WITH {FACTS}, a AS (SELECT cik, {item('item_key')} AS item_key, {date('period_end')} AS "end", {date('filed')} AS f, loaded_at, snapshot_id, value FROM resolved_value),
l AS (SELECT cik, item_key, "end", last(value ORDER BY f, loaded_at, snapshot_id) AS v FROM a WHERE f IS NOT NULL GROUP BY ALL),
j AS (SELECT res.item_key, value IS NOT DISTINCT FROM v OR coalesce(abs(value - v) <= 1, false) AS same FROM res LEFT JOIN l USING (cik, item_key, "end"))
SELECT item_key, count(*) FILTER (same)::BIGINT AS n_match, count(*)::BIGINT AS n_cells, round(count(*) FILTER (same) / count(*), 6)::DOUBLE AS accuracy FROM j GROUP BY ROLLUP (item_key)""",
    "q57_check_sheet": f"{_ALL_CHECKS} SELECT cik, fiscal_year, \"check\" || '_' || fiscal_year::VARCHAR AS check_id, lhs - rhs AS diff, CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END AS verdict FROM checks",
    "q58_fact_trim": f"WITH {FACTS} SELECT cik, tag, count(*)::BIGINT AS n, max(e) AS last_end FROM facts WHERE form IN ('10-K', '10-K/A') AND e >= DATE '2016-01-01' AND tag IN (SELECT tag FROM chain) GROUP BY ALL",
    "q59_coverage": f"WITH {FACTS}, {YEARS}, {GRID} SELECT item_key, count(value)::BIGINT AS n_filled, count(*)::BIGINT AS n_cells, count(*) FILTER (restated)::BIGINT AS n_restated FROM grid GROUP BY item_key",
    "q60_nested_gold": f"WITH {FACTS}, {YEARS}, {GRID} SELECT cik, item_key, count(*)::BIGINT AS n, sum(value::DECIMAL(38, 4))::DOUBLE AS total FROM grid WHERE value IS NOT NULL GROUP BY ALL",
}
