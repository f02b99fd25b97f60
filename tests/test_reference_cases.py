"""Behaviour of the reported-facts operators on small cases with known results."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions.figures import format_figure, parse_figure
from tallyloom.functions.text import clean_markup, filing_chunks, pack, parse_markup, sentences
from tallyloom.operators import evals, runlog
from tallyloom.operators import facts as fx
from tallyloom.operators import identities as ids
from tallyloom.operators import retrieval as rt
from tallyloom.operators import statements as stm
from tallyloom.operators.cells import address, commentary_rows, escape_cell, placed_cells, ratio_cells, statement_sheet, workbook
from tallyloom.operators.grounding import claimed_direction, grounded, is_negative, quote_verdict, series_direction
from tallyloom.operators.ratios import ratio_grid
from tallyloom.operators.runlog import ranked
from tallyloom.sources.readers import company_list, trimmed

ENTRY = "entry_id BIGINT, cik BIGINT, segment_id BIGINT, tag STRING, unit STRING, period_start STRING, period_end STRING, val DOUBLE, fy INT, fp STRING, form STRING, filed STRING"
SPEC = "item_key STRING, label STRING, statement STRING, kind STRING, tags ARRAY<STRING>, unit STRING"


def _entries(spark, rows):
    return spark.createDataFrame([(i, 1, 1, t, u, s, e, v, fy, "FY", form, filed) for i, (t, u, s, e, v, fy, form, filed) in enumerate(rows)], ENTRY)


def _specs(spark, rows):
    return spark.createDataFrame([(k, k, "x", kind, tags, unit) for k, kind, tags, unit in rows], SPEC)


def test_resolution(spark):
    entries = _entries(
        spark,
        [
            ("Assets", "USD", None, "2024-12-31", 100.0, 2024, "10-K", "2025-02-01"),
            ("Assets", "USD", "", "2024-12-31", 105.0, 2025, "10-K/A", "2026-02-01"),
            ("Assets", "USD", None, "2024-12-31", 999.0, 2024, "10-Q", "2027-02-01"),
            ("Revenues", "USD", "2024-10-01", "2024-12-31", 1.0, 2024, "10-K", "2025-02-01"),
            ("Revenues", "USD", "2024-01-01", "2024-12-31", 100.0, 2024, "10-K", "2025-02-01"),
            ("Eps", "USD/shares", "2024-01-01", "2024-12-31", 6.0, 2024, "10-K", "2025-02-01"),
            ("OldFx", "USD", "2022-01-01", "2022-12-31", -5.0, 2022, "10-K", "2023-02-01"),
            ("NewFx", "USD", "2023-01-01", "2023-12-31", 3.0, 2023, "10-K", "2024-02-01"),
            ("Fallback", "USD", "2023-01-01", "2023-12-31", 999.0, 2023, "10-K", "2029-02-01"),
            ("Preferred", "USD", "2023-01-01", "2023-12-31", 10.0, 2023, "10-K", "2024-02-01"),
            ("Preferred", "USD", "2023-01-01", "2023-12-31", None, 2023, "10-K", "2028-02-01"),
        ],
    )
    specs = _specs(
        spark,
        [("assets", "instant", ["Assets"], "USD"), ("revenue", "duration", ["Revenues"], "USD"), ("eps", "duration", ["Eps"], "USD"), ("fx", "duration", ["NewFx", "OldFx"], "USD"), ("pref", "duration", ["Preferred", "Fallback"], "USD")],
    )
    got = {(r["item_key"], str(r["end"])): (r["value"], r["fiscal_year"], r["restated"]) for r in fx.resolve(entries, specs).collect()}
    assert got == {
        ("assets", "2024-12-31"): (105.0, 2024, True), ("revenue", "2024-12-31"): (100.0, 2024, False), ("fx", "2022-12-31"): (-5.0, 2022, False),
        ("fx", "2023-12-31"): (3.0, 2023, False), ("pref", "2023-12-31"): (10.0, 2023, False),
    }
    assert fx.resolve(entries.where("false"), specs).count() == 0


def _wide(spark, **values):
    columns = [*stm.ITEMS, "prior_cash"]
    row = (1, 2024, *[values.get(c) for c in columns])
    return spark.createDataFrame([row], "cik INT, fiscal_year INT, " + ", ".join(f"{c} DOUBLE" for c in columns))


def _checks(spark, derived=None, **values):
    return {r["check"]: (r["passed"], r["lhs"], r["rhs"], r["tolerance"]) for r in ids.checks(_wide(spark, **values), ["cik", "fiscal_year"], derived).collect()}


def test_identities(spark):
    assert _checks(spark, total_assets=100.0, total_liabilities=40.0, total_equity=50.0) == {"balance_sheet_equation": (False, 100.0, 90.0, 3.0)}
    assert _checks(spark) == {"insufficient_data": (False, None, None, 0.0)}
    cash = {"cash_and_equivalents": 2e6, "prior_cash": 1e6, "cfo": 3e6, "cfi": -1e6, "cff": -1e6}
    assert _checks(spark, **cash)["cash_roll_forward"] == (True, 1e6, 1e6, 5e6)
    assert _checks(spark, **cash, fx_effect_on_cash=1e6)["cash_roll_forward"][3] == 6e6
    circular = _checks(spark, F.lit(True), total_assets=100.0, total_liabilities=40.0, total_equity=60.0, total_liabilities_and_equity=900.0)
    assert circular == {"balance_sheet_equation_independent": (False, 100.0, 900.0, 2.0)}
    assert _checks(spark, F.lit(True), total_assets=100.0, total_liabilities=40.0, total_equity=60.0) == {"insufficient_data": (False, None, None, 0.0)}
    net = _checks(spark, net_income=8.0, pretax_income=10.0, income_tax_expense=2.0, operating_income=5.0, gross_profit=9.0, operating_expenses=4.0)
    assert net["net_income_buildup"] == (True, 8.0, 8.0, 3.0) and net["operating_income_buildup"][0]
    assert _checks(spark, net_income=7.0, pretax_income=10.0, income_tax_expense=2.0, noncontrolling_interest_in_income=1.0)["net_income_buildup"] == (True, 7.0, 7.0, 4.0)


def _grid(spark, rows):
    return spark.createDataFrame(rows, "cik BIGINT, item_key STRING, fiscal_year INT, value DOUBLE, tag STRING")


def test_derivations(spark):
    def liabilities(rows, facts=()):
        minority = stm.has_minority(spark.createDataFrame(list(facts), "cik BIGINT, tag STRING"))
        got = stm.derive_total_liabilities(_grid(spark, [(1, *r) for r in rows]), minority).where("item_key = 'total_liabilities'").orderBy("fiscal_year").collect()
        return [(r["value"], r["tag"]) for r in got]

    year = lambda y, whole, equity, tag, own=None: [("total_liabilities_and_equity", y, whole, "a"), ("total_equity", y, equity, tag), ("total_liabilities", y, own, None if own is None else "l")]
    marker = "derived:total_liabilities_and_equity-total_equity"
    assert liabilities(year(2024, 100.0, 60.0, "stockholdersequity")) == [(40.0, marker)]
    # Refused for the year whose equity is the parent's alone, not for the entity's others; assets are no stand-in.
    both = [*year(2023, 90.0, 50.0, "equitywithminority"), *year(2024, 100.0, 60.0, "stockholdersequity")]
    assert liabilities(both, [(1, "minorityinterest")]) == [(40.0, marker), (None, None)]
    assert liabilities(both, [(2, "minorityinterest")]) == [(40.0, marker)] * 2
    assert liabilities([*year(2024, None, 60.0, "b"), ("total_assets", 2024, 100.0, "a")]) == [(None, None)]
    assert liabilities([*year(2023, 90.0, 50.0, "b", 7.0), *year(2024, 100.0, 60.0, "b")]) == [(7.0, "l"), (None, None)]  # reported in one year
    one = [(1, "pretax_domestic", 2024, 5.0, "a"), (1, "pretax_income", 2024, None, None)]
    assert stm.derive_pretax_income(_grid(spark, one)).where("item_key = 'pretax_income'").first()["value"] is None
    both = [*one, (1, "pretax_foreign", 2024, 2.0, "a")]
    assert tuple(stm.derive_pretax_income(_grid(spark, both)).where("item_key = 'pretax_income'").first()[3:]) == (7.0, "derived:pretax_domestic+pretax_foreign")


def test_a_derived_balance_sheet_is_checked_against_what_was_filed(spark):
    rows = [(1, "total_liabilities_and_equity", 2024, 100.0, "a"), (1, "total_assets", 2024, 100.0, "a"), (1, "total_equity", 2024, 60.0, "b"), (1, "total_liabilities", 2024, None, None)]
    w = stm.wide(stm.derive_total_liabilities(_grid(spark, rows))).withColumn("prior_cash", F.lit(None).cast("double"))
    (got,) = ids.checks(w, ["cik"], F.col("tag_total_liabilities").startswith("derived:")).collect()
    assert (got["check"], got["passed"], got["lhs"], got["rhs"]) == ("balance_sheet_equation_independent", True, 100.0, 100.0)


def test_sheet_and_addresses(spark):
    rows = [(1, "cash", 2011, 5.0, "t"), (1, "cash", 2015, None, None), (1, "debt", 2015, 2.0, "t"), (2, "cash", 1999, 1.0, "t")]
    got = {(r["cik"], r["item_key"]): tuple(r)[2:] for r in statement_sheet(_grid(spark, rows), ["cik", "item_key"], ["cik"], "fiscal_year", 2, "value").collect()}
    assert got == {(1, "cash"): ("2011,2015", "5.0", "n/r"), (1, "debt"): ("2011,2015", "n/r", "2.0"), (2, "cash"): ("1999", "1.0", "n/r")}
    at = spark.createDataFrame([(1,), (26,), (27,), (52,), (53,), (702,), (703,)], "c INT").select(address(F.col("c"), F.lit(7))).collect()
    assert [r[0] for r in at] == ["A7", "Z7", "AA7", "AZ7", "BA7", "ZZ7", None]


def test_workbook_cells(spark):
    items = [("revenue", "Revenue", "income", "USD"), ("cfo", "Cash from operations", "cashflow", "USD"), ("capex", "Capex", "cashflow", "USD"), ("net_income", "=Net", "income", "USD"), ("weighted_diluted_shares", "Shares", "income", "shares"), ("total_equity", "Equity", "balance", "USD")]
    specs = spark.createDataFrame(items, "item_key STRING, label STRING, statement STRING, unit STRING")
    values = {"revenue": (100.0, 110.0), "cfo": (30.0, None), "capex": (10.0, 5.0), "net_income": (7.0, 9.0), "weighted_diluted_shares": (5.0, 5.0), "total_equity": (-1.0, 2.0)}
    g = _grid(spark, [(1, i, 2020 + y, v, "derived:x" if i == "total_equity" else "t") for i, each in values.items() for y, v in enumerate(each)])
    cells = placed_cells(g, specs)
    w = ids.with_prior(ids.with_prior(stm.wide(g), ["cik"], "fiscal_year", "cash_and_equivalents", "prior_cash"), ["cik"], "fiscal_year", "retained_earnings", "prior_retained")
    w = w.withColumn("before", F.lag("revenue").over(Window.partitionBy("cik").orderBy("fiscal_year")))
    made = ratio_cells(cells, ratio_grid(w, ["cik", "fiscal_year"], "before"))
    got = {(r["ratio"], r["fiscal_year"]): r["cell"] for r in made.collect()}
    assert got["net_margin", 2020] == "='Income Statement'!B4/'Income Statement'!B5" and got["roe", 2020] == "n/m" and got["roe", 2021] == "='Income Statement'!C4/'Balance Sheet'!C4"
    assert got["fcf", 2020] == "='Cash Flow'!B5-'Cash Flow'!B4" and got["fcf_margin", 2020] == "=B13/'Income Statement'!B5" and got["fcf_margin", 2021] == "n/a"
    assert got["revenue_growth", 2021] == "=('Income Statement'!C5-'Income Statement'!B5)/'Income Statement'!B5" and got["revenue_growth", 2020] == "n/a"
    scales = spark.createDataFrame([(1, 1e6)], "cik BIGINT, scale DOUBLE")
    book = {(r["sheet"], r["row"], r["col"]): (r["text"], r["number"], r["formula"]) for r in workbook(cells, made, ids.checks(w, ["cik", "fiscal_year"]), ids.residuals(w, ["cik", "fiscal_year"]), scales).collect()}
    assert book["Income Statement", 4, 1] == ("'=Net", None, None) and book["Income Statement", 6, 1][0] == "Shares (millions)" and book["Income Statement", 6, 2][1] == 5.0
    assert book["Cash Flow", 5, 3] == ("n/r", None, None) and book["Balance Sheet", 4, 1][0] == "Equity (derived)" and book["Balance Sheet", 3, 2][0] == "FY2020"
    assert book["Ratios", 13, 2] == (None, None, got["fcf", 2020]) and book["Ratios", 13, 1][0] == "Free cash flow"
    assert book["Tie-out", 5, 1][0] == "insufficient_data_2020" and book["Tie-out", 5, 7][0] == "FAIL"


def _chunks(text, label, target, overlap):
    sents, out, cur = [s for s in re.split(r"(?<=[.!?])\s+", text) if s] or [text], [], []
    for i, s in enumerate(sents):
        cur.append(s)
        if sum(len(x) + 1 for x in cur) >= target or i == len(sents) - 1:
            out.append(f"{label} {' '.join(cur)}")
            kept = []
            while sum(len(x) + 1 for x in kept) < overlap and len(kept) < len(cur):
                kept.insert(0, cur[-1 - len(kept)])
            cur = kept
    return out


def test_filing_chunks(spark):
    risk = " ".join(f"Risk {i} could harm us." for i in range(60))
    views = " ".join(f"Sales rose by {i}%." for i in range(50))
    listed = "Item 1A. Risk Factors\nItem 1B. Unresolved Staff Comments\nItem 7. Management's Discussion\nItem 8. Financial Statements\n"
    one = f"{listed}ITEM 1A.\nRISK\u00a0FACTORS\n{risk}\nsee Item 7. Management's Discussion there\nItem 2: Properties\nnone\nManagement's Discussion and Analysis\n{views}\nItem 7A quantitative"
    df = spark.createDataFrame([(1, one), (2, "no sections"), (3, None), (4, ""), (5, "Risk factors are many.\nx")], "k INT, t STRING").withColumn("f", F.lit("clash")).withColumn("s", F.lit(1))
    got = [(r["k"], r["chunk_id"], r["chunk"]) for r in filing_chunks(df, "k", "t", 50, 10).orderBy("k", "chunk_id").collect()]
    a = _chunks(f"ITEM 1A. RISK FACTORS {risk} see Item 7. Management's Discussion there", "Item 1A. Risk Factors", 200, 40)
    b = _chunks(f"Management's Discussion and Analysis {views}", "Item 7. Management's Discussion and Analysis", 200, 40)
    assert got == [(1, f"item1a-{i:04}", x) for i, x in enumerate(a)] + [(1, f"item7-{i:04}", x) for i, x in enumerate(b)]


def test_ranks_by_bucket(spark):
    df = spark.range(500).select(F.lit(1).alias("k"), (F.col("id") % 100).alias("o"), "id").union(spark.createDataFrame([(None, 3, 900)], "k INT, o BIGINT, id BIGINT"))
    got = ranked(df.where("k = 1"), "k", F.floor(F.col("o") / 10), ["o", "id"]).orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1, 501)) and [(r["o"], r["id"]) for r in got] == sorted((r["o"], r["id"]) for r in got)


@pytest.mark.parametrize(("shares", "eps", "income", "scale"), [(751_800.0, 11.39, 8_223_000_000.0, 1e3), (2_574_000_000.0, None, None, 1.0), (751.8, None, None, 1e6), (None, None, None, 1.0), (0.0, 1.0, 5.0, 1.0)])
def test_share_scale(spark, shares, eps, income, scale):
    df = spark.createDataFrame([(1, 2024, shares, eps, income)], "k INT, y INT, s DOUBLE, e DOUBLE, i DOUBLE")
    assert stm.share_scale(df, ["k"], "y", "s", "e", "i").first()["scale"] == scale


def test_ratio_statuses(spark):
    w = _wide(spark, revenue=100.0, gross_profit=40.0, net_income=5.0, total_equity=-1.0, total_liabilities=3.0, cfo=7.0, capex=2.0, total_assets=0.0).withColumn("before", F.lit(None).cast("double"))
    got = {r["ratio"]: (r["status"], r["value"]) for r in ratio_grid(w, ["cik"], "before").collect()}
    assert got["gross_margin"] == ("ok", 0.4) and got["roe"] == ("n/m", None) and got["roa"] == ("n/m", None) and got["current_ratio"] == ("n/a", None)
    assert got["fcf"] == ("ok", 5.0) and got["fcf_margin"] == ("ok", 0.05) and got["revenue_growth"] == ("n/a", None)


def test_figures(spark):
    cases = [(391_035_000_000.0, "USD", "$391.04B"), (5_230_000.0, "USD", "$5.23M"), (123_456.0, "USD", "$123.46K"), (42.0, "USD", "$42.00"), (-1_234_567_890.0, "USD", "-$1.23B"), (6.42, "USD/shares", "$6.42"), (15_550_000_000.0, "shares", "15.55B shares"), (0.0, "USD", "$0.00"), (None, "USD", None)]
    df = spark.createDataFrame([(v, u) for v, u, _ in cases], "v DOUBLE, u STRING").withColumn("f", format_figure(F.col("v"), F.col("u")))
    assert [r["f"] for r in df.select("f").collect()] == [c[2] for c in cases]
    back = spark.createDataFrame([("$391.04B",), ("($5.00)",), ("(5.00)",), ("−$1.2K",), ("15.55B shares",), ("words",), (None,)], "t STRING").select(parse_figure(F.col("t"))).collect()
    assert [r[0] for r in back] == [pytest.approx(391.04e9), -5.0, -5.0, -1200.0, pytest.approx(15.55e9), None, None]


def test_fusion_and_bm25(spark):
    rows = [(1, 0, d, i + 1) for i, d in enumerate("abc")] + [(1, 1, "c", 1), (1, 1, "a", 2)]
    got = {r["doc_id"]: r["score"] for r in rt.fuse(spark.createDataFrame(rows, "query_id INT, list_id INT, doc_id STRING, rank INT"), 10).collect()}
    assert got == {"a": pytest.approx(23 / 132), "c": pytest.approx(24 / 143), "b": pytest.approx(1 / 12)}
    docs = spark.createDataFrame([(1, "cash flow rose"), (2, "revenue fell"), (3, None), (4, "other words here")], "doc_id INT, text STRING")
    queries = spark.createDataFrame([("q", "cash cash"), ("none", "zebra")], "query_id STRING, query STRING")
    assert [(r["query_id"], r["doc_id"]) for r in rt.bm25(docs, queries, 5).collect()] == [("q", 1)]
    assert rt.bm25(docs, queries, 0).count() == 0 and rt.bm25(docs.where("false"), queries, 5).count() == 0


def test_nearest_matches_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = [(i, [float(x) for x in rng.normal(size=4).astype("float32")]) for i in range(120)] + [(120, [0.0] * 4), (121, None)]
    df = spark.createDataFrame(v, "vec_id BIGINT, embedding ARRAY<FLOAT>")
    got = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in rt.nearest(df, df.where("vec_id % 50 = 0"), 5, block=16).collect()}
    m = np.array([x for _, x in v[:120]])
    for q in (0, 50, 100):
        s = np.round(m @ m[q] / (np.linalg.norm(m, axis=1) * np.linalg.norm(m[q])), 6)
        order = sorted(range(120), key=lambda i: (-s[i], i))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, pytest.approx(s[i])) for i in order]


def test_text(spark):
    html = "<html><script>x</script><p>Cash\xa0 flow &amp; more</p><style>y</style><div>  two   words </div></html>"
    df = spark.createDataFrame([(html,), (None,), ("",)], "h STRING")
    assert [r[0] for r in df.select(clean_markup(F.col("h"))).collect()] == ["Cash flow & more\ntwo words", None, ""]
    assert [r[0] for r in df.select(parse_markup("h")).collect()] == ["Cash flow & more\ntwo words", None, ""]

    def packed(sents, target, overlap):
        out, cur, n = [], [], 0
        for i, s in enumerate(sents):
            cur, n = [*cur, s], n + len(s) + 1
            if n >= target or i == len(sents) - 1:
                out.append(" ".join(cur))
                keep, m = [], 0
                for x in reversed(cur):
                    if m >= overlap:
                        break
                    keep, m = [x, *keep], m + len(x) + 1
                cur, n = (keep, m) if overlap else ([], 0)
        return out

    text = " ".join(f"Sentence {i} {'x' * (i % 7 * 5)}." for i in range(40))
    s = spark.createDataFrame([(text,)], "t STRING").select(sentences(F.col("t")).alias("s"))
    sents = s.first()["s"]
    for target, overlap in ((60, 0), (60, 20), (200, 60), (5, 3)):
        assert s.select(pack(F.col("s"), target, overlap)).first()[0] == packed(sents, target, overlap)


def test_grounding(spark):
    df = spark.createDataFrame([("1.04", ["$391.04B"]), ("391.04B", ["$391.04B"]), ("391", ["$391.04B"]), ("5", ["5%"])], "t STRING, h ARRAY<STRING>")
    assert [r[0] for r in df.select(grounded(F.col("t"), F.col("h"))).collect()] == [False, True, False, False]
    neg = spark.createDataFrame([("fell to -$5.00", "5.00"), ("rose to $5.00", "5.00"), ("($5.00)", "$5.00"), ("(5)", "5")], "t STRING, n STRING")
    assert [r[0] for r in neg.select(is_negative(F.col("t"), F.col("n"))).collect()] == [True, False, True, False]
    q = spark.createDataFrame([("cash rose", "the cash rose"), ("Cash rose", "the cash rose"), ("abc", "abc"), ("x" * 301, "x" * 400), ("cash rose", None)], "q STRING, c STRING")
    assert [r[0] for r in q.select(quote_verdict(F.col("q"), F.col("c"))).collect()] == ["ok", "not_verbatim", "too_short", "too_long", "unknown_chunk"]
    c = spark.createDataFrame([("Revenue rose.",), ("Revenue did not rise, it fell",), ("sales rose as costs fell",), ("technology rose",)], "c STRING")
    assert [r[0] for r in c.select(claimed_direction(F.col("c"))).collect()] == ["up", None, None, None]
    series = spark.createDataFrame([(1, 2020, 10.0), (1, 2021, 9.0), (1, 2022, 20.0), (2, 2020, 10.0), (2, 2021, 11.0), (3, 2020, -1.0), (3, 2021, 5.0), (4, 2020, 1.0)], "k INT, y INT, v DOUBLE")
    got = {r["k"]: (r["direction"], r["steady"]) for r in series_direction(series, ["k"], "y", "v").collect()}
    assert got == {1: ("up", False), 2: ("up", True), 3: (None, None), 4: (None, None)}


def test_cells_and_metrics(spark, tmp_path):
    c = spark.createDataFrame([("=1+1",), ("-5",), ("plain",), (None,)], "c STRING")
    assert [r[0] for r in c.select(escape_cell(F.col("c"))).collect()] == ["'=1+1", "'-5", "plain", None]
    items = spark.createDataFrame([(1, "A", "why"), (2, "B", "why")], "k INT, label STRING, reason STRING")
    quotes = spark.createDataFrame([(1, 5, "x"), (1, 6, "y")], "k INT, o INT, quote STRING")
    assert sorted(map(tuple, commentary_rows(items, quotes, "k", "o").collect())) == [(1, 1, "A", "x"), (1, 2, None, "y"), (2, 0, "B", "why")]
    ranked = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query_id STRING, doc_id INT, rank INT")
    gold = spark.createDataFrame([("q", 2), ("q", 9), ("p", 1)], "query_id STRING, doc_id INT")
    per = evals.precision_recall(ranked, gold, 5)
    assert sorted(map(tuple, per.collect())) == [("p", 0, 0.0, 0.0), ("q", 1, 0.2, 0.5)]
    assert evals.mean_metrics(per.where("false")).first()["mean_precision"] is None
    cells = spark.createDataFrame([(1, "g", 1.0), (2, "g", None), (3, "g", 5.0)], "k INT, g STRING, value DOUBLE")
    actual = spark.createDataFrame([(1, 1.9), (2, None)], "k INT, value DOUBLE")
    assert evals.cell_accuracy(cells, actual, ["k"], "g").where("g is null").first()["n_match"] == 2
    e = spark.createDataFrame([(1, t, x) for t, x in enumerate("EEvEoEE")], "u INT, t INT, x STRING")
    assert sorted(r["length"] for r in runlog.streaks(e, "u", ["t"], F.col("x") == "E", F.col("x") == "v", F.floor(F.col("t") / 2)).collect()) == [2, 3]
    (tmp_path / "c.json").write_text('{"0": {"cik_str": 5, "ticker": "A", "title": "T"}, "1": {"cik_str": 6, "ticker": "B", "title": null}}')
    assert [tuple(r) for r in company_list(spark, str(tmp_path / "c.json")).collect()] == [(0, 5, "A", "T"), (1, 6, "B", None)]
    t = spark.createDataFrame([("aaaa item 1a bbbb item 8 cccc item 8 dddd",), ("nothing",)], "h STRING")
    assert [r[0] for r in t.select(trimmed(F.col("h"), "item 1a", "item 8", 2)).collect()] == ["a item 1a bbbb item 8 cccc item 8 d", "nothing"]


def test_year_claims(spark):
    from tallyloom.operators.grounding import year_claims

    said = spark.createDataFrame([(1, 5, "Revenue was $5.00M in fiscal 2016."), (2, 5, "In fiscal 2017 it was $5.00M."), (3, 5, "$5.00M in fiscal 2016 and fiscal 2017"), (4, None, "fiscal 2016: $5.00M"), (5, 5, None)], "doc_id INT, cik INT, sentence STRING")
    figures = spark.createDataFrame([(5, 2016, "$5.00M"), (5, 2015, "$5.00M"), (5, 2017, "$9.00M")], "cik INT, fiscal_year INT, token STRING")
    assert [tuple(r) for r in year_claims(said, figures).collect()] == [(2, 2017, "$5.00M", "2015,2016")]


def test_run_table_and_eviction(spark):
    import datetime as dt

    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("a", t(0), 1, "start"), ("a", t(10), 2, "done"), ("a", t(20), 3, "error"), ("b", t(0), 4, "start"), ("c", t(0), 5, "start"), ("c", t(500), 6, "done")]
    e = spark.createDataFrame(rows, "run STRING, at TIMESTAMP_NTZ, i INT, s STRING")
    got = runlog.run_table(e, "run", "at", F.col("s"), F.col("s").isin("done", "error"), 300, "i")
    assert {r["run"]: (r["status"], r["last_status"]) for r in got.collect()} == {"a": ("done", "error"), "b": ("timeout", "start"), "c": ("timeout", "done")}
    handles = spark.createDataFrame([(i, t(i), i % 2 == 0) for i in range(10)], "id INT, at TIMESTAMP_NTZ, over BOOLEAN")
    kept = runlog.evict(handles, F.col("over"), F.col("at"), ["at", "id"], F.lit(t(9)).cast("timestamp_ntz"), 7, 6)
    assert sorted(r["id"] for r in kept.collect()) == [1, 3, 5, 7, 8, 9]
    assert runlog.evict(handles.where("false"), F.col("over"), F.col("at"), ["at"], F.lit(t(9)).cast("timestamp_ntz"), 7, 6).count() == 0


def test_streams_equal_tables(spark, tmp_path):
    from tallyloom.streaming.runs import event_stream, first_seen, replay, terminal_states, windowed_counts

    rows = [(i, 1.7e9 + 60.0 * i, i % 3, "ab"[i % 2]) for i in range(50)] + [(0, 1.7e9, 0, "a")]
    e = spark.createDataFrame(rows, "event_id INT, s DOUBLE, user_id INT, event_type STRING").selectExpr("event_id", "timestamp_seconds(s) AS ts", "user_id", "event_type")
    e.repartition(3).write.parquet(str(tmp_path / "ev"))
    path = str(tmp_path / "ev")
    assert sorted(map(tuple, replay(terminal_states(event_stream(spark, path))).collect())) == sorted(map(tuple, terminal_states(e).collect()))
    counts = replay(windowed_counts(event_stream(spark, path), "1 day", "10 minutes")).collect()
    assert sum(r["n"] for r in counts) == 51
    assert replay(first_seen(event_stream(spark, path), "1 day").select("event_id"), "append").count() == 50


def test_streaks_over_buckets_match_a_plain_walk(spark):
    import random

    rnd = random.Random(11)
    rows = [(rnd.choice([1, 1, 1, 2, None]), i, rnd.choice("EEEov")) for i in range(600)]
    df = spark.createDataFrame(rows, "u INT, t INT, x STRING").withColumn("b", F.lit("clash")).withColumn("n", F.lit(0))
    want = {}
    for u in (1, 2, None):
        run = 0
        for _, _, x in [*[r for r in rows if r[0] == u], (u, 0, "o")]:
            if x == "E":
                run += 1
            elif x != "v":
                if run:
                    want.setdefault(u, []).append(run)
                run = 0
    for width in (1, 7, 50, 1000):
        got = {}
        for r in runlog.streaks(df, "u", ["t"], F.col("x") == "E", F.col("x") == "v", F.floor(F.col("t") / width)).collect():
            got.setdefault(r["u"], []).append(r["length"])
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert runlog.streaks(df.where("false"), "u", ["t"], F.col("x") == "E", bucket=F.col("t")).count() == 0
