"""Units, nested records, history: against brute force, round trips and the stated cases of nulls, ties and empty tables."""

import datetime as dt
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.functions.quantities import caption_power, read_quantity, text_number, text_power, unit_power
from tallyloom.functions.spelling import item_name, iso_text, tag_name, unit_name
from tallyloom.operators.ledger import _Sweep, resolved_value_ledger
from tallyloom.operators.nested import TABLES, emit_tagged, read_table, with_schema, write_tagged
from tallyloom.operators import units
from tallyloom.operators.units import changepoints, in_common_units, scale_powers

RESOLVED = "snapshot_id BIGINT, cik BIGINT, segment_id BIGINT, item_key STRING, period_end STRING, value DOUBLE, tag STRING, filed STRING, fiscal_year INT, restated BOOLEAN, loaded_at TIMESTAMP_NTZ"
LINES = "obs_id BIGINT, cik BIGINT, item_key STRING, label STRING, statement STRING, fiscal_year INT, feed STRING, value DOUBLE, value_text STRING, unit STRING, caption STRING, loaded_at TIMESTAMP_NTZ"
SPECS = "item_key STRING, label STRING, statement STRING, kind STRING, tags ARRAY<STRING>, unit STRING"
T0 = dt.datetime(2020, 1, 1)


def test_spellings(spark):
    dates = ["2017-02-01", " 2017-02-01 ", "20170201", "2017-02-01T00:00:00Z", "01-Feb-2017", "Feb 1, 2017", "02/01/2017", "2017/02/01"]
    df = spark.createDataFrame([(d,) for d in [*dates, "n/a", "", None, "0000-00-00", "2017-02-30", "31-Feb-2017"]], "d STRING")
    got = [r[0] for r in df.select(iso_text("d")).collect()]
    assert got == ["2017-02-01"] * len(dates) + [None] * 6
    one = spark.createDataFrame([("us-gaap:SalesNetTotal", "iso4217:USD/xbrli:shares", "Net Income"), ("sales_net_total", "USD-per-shares", "net-income ")], "t STRING, u STRING, i STRING")
    assert one.select(tag_name("t"), unit_name("u"), item_name("i")).distinct().collect() == [("salesnettotal", "usd/shares", "net_income")]


def test_numbers_and_scales():
    cases = {"1 258,8": 1258.8, "3.374,0": 3374.0, "2,21 USD": 2.21, "(19,381.0)": -19381.0, "US$ 45.723.211": 45723211.0, "US$−3.015 billion": -3.015, "$(2.903)bn": -2.903, "0.5": 0.5, "$887,638": 887638.0, "n/r": None, "--": None}
    assert {t: text_number(t) for t in cases} == cases
    assert [text_power(t, "USD") for t in ("8,160 mille US dollars", "$5k", "$1.5bn", "90 USD", "465.572,0", "6.63 lakh")] == [3, 3, 9, 0, None, 5]
    assert text_power("610.0c per share", "USD/shares") == -2 and text_power("878 basis points", "pure") == -4 and text_power("343 per mille", "pure") == -3
    assert [unit_power(u, "USD") for u in ("USD (000s)", "MUSD", "USDm", "$B", "USD crore", "iso4217:USD", "US cents")] == [3, 6, 6, 9, 7, None, -2]
    assert unit_power("round lots (100)", "shares") == 2 and unit_power("USD/1,000 shares", "USD/shares") == -3
    mixed = "In millions, except shares which are in thousands and per share data"
    assert [caption_power(mixed, k) for k in ("USD", "shares", "USD/shares", "pure")] == [6, 3, 0, None]
    assert caption_power("figures rounded to the nearest thousand", "USD") is None and caption_power("not in thousands: whole USD", "USD") == 0
    assert read_quantity(float("nan"), "5k USD", None, "(in millions)", "USD") == (5.0, 3)
    assert read_quantity(None, None, "USD", None, "USD") == (None, None) and read_quantity(1.0, None, None, None, None) == (1.0, None)


@given(st.lists(st.tuples(st.sampled_from([0.0, 0.1, 3.0, 3.1, 6.0]), st.sampled_from([1.0, 2.0])), min_size=1, max_size=9), st.sampled_from([0.3, 1.0]))
@settings(max_examples=150, deadline=None)
def test_changepoints_are_exact(points, penalty):
    def cost(a, b):
        n = sum(w for _, w in points[a:b])
        m = sum(x * w for x, w in points[a:b]) / n
        return sum(w * (x - m) ** 2 for x, w in points[a:b])

    n, best = len(points), float("inf")
    for mask in range(1 << (n - 1)):
        cuts = [0, *[i + 1 for i in range(n - 1) if mask >> i & 1], n]
        best = min(best, sum(cost(a, b) + penalty for a, b in zip(cuts, cuts[1:])))
    cuts = [*changepoints(points, penalty), n]
    assert cuts[0] == 0 and sum(cost(a, b) + penalty for a, b in zip(cuts, cuts[1:])) == pytest.approx(best)


def _lines(spark, rows):
    full = [(i, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame([(i, c, k, None, None, y, f, v, t, u, cap, T0) for i, c, k, y, f, v, t, u, cap in full], LINES)


def test_silent_feed_and_silent_company(spark):
    rows = []
    for c in range(12):
        amount = 1_000_000.0 * (c + 3)
        rows += [(c, "revenue", 2015, "plain", amount, None, "USD", "whole dollars"), (c, "Revenue", 2015, "short", amount / 1000, None, "USD", None)]
    for y in range(2010, 2020):  # counts filed in thousands from 2015 on; income and income per share tell of it
        count = 50_000_000.0 + 100_000 * y
        rows += [(99, "weighted_diluted_shares", y, "plain", count / (1000 if y >= 2015 else 1), None, "shares", None)]
        rows += [(99, "net_income", y, "plain", count * 2, None, "USD", "whole dollars"), (99, "eps_diluted", y, "plain", 2.0, None, "USD/shares", "USD thousands, except per share data")]
    rows += [(None, "revenue", None, None, 5.0, None, None, None), (1, "unheard_of", 2015, "short", 5.0, None, None, None), (1, "revenue", 2015, "short", None, "not reported", None, None), (1, "revenue", 2015, "short", 0.0, None, None, None)]
    specs = spark.createDataFrame([(k, None, None, None, [], u) for k, u in (("revenue", "USD"), ("net_income", "USD"), ("eps_diluted", "USD/shares"), ("weighted_diluted_shares", "shares"))], SPECS)
    lines = _lines(spark, rows).withColumn("number", F.lit("x")).withColumn("kind", F.lit(1))  # clashing names
    got = {r["obs_id"]: r["exp10"] for r in scale_powers(lines, specs).collect()}
    want = {i: 3 if (r[3] == "short" and r[1].lower() == "revenue") or (r[1] == "weighted_diluted_shares" and r[2] >= 2015) else 0 for i, r in enumerate(rows) if r[5] is None}
    assert got == want
    assert in_common_units(lines, specs).where("obs_id = 1").first()["amount"] == pytest.approx(3_000_000.0)
    assert scale_powers(lines.where("false"), specs).count() == 0 and scale_powers(lines, specs.where("false")).where("exp10 <> 0").count() == 0


@given(st.lists(st.tuples(st.integers(0, 5), st.sampled_from("abN"), st.integers(0, 6)), max_size=14))
@settings(max_examples=200, deadline=None)
def test_sweep_keeps_every_belief(records):
    """At each day the open rows are the versions made anew from what was known then."""
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    records = sorted(records, key=lambda r: r[2])
    sweep, rows = _Sweep(), []
    for v, s, d in records:
        rows += sweep.record(day(v), (s,), day(d))
    rows += sweep.standing()
    for today in range(8):
        known = {}
        for v, s, d in records:
            if d <= today:
                known[v] = s
        starts = [v for i, v in enumerate(sorted(known)) if i == 0 or known[v] != known[sorted(known)[i - 1]]]
        want = {(day(v), day(n) if n is not None else dt.date(9999, 12, 31), (known[v],)) for v, n in zip(starts, [*starts[1:], None])}
        assert {r[:3] for r in rows if r[3] <= day(today) and (r[4] is None or r[4] > day(today))} == want


def test_ledger_cases(spark):
    at = lambda n: T0 + dt.timedelta(days=n)
    rows = [
        (1, 1, 7, "Net Income", "2015-12-31", 1.0, "t", "2016-01-05", 2015, False, at(0)),
        (2, 1, 7, "net_income", "Dec 31, 2015", 1.0, "t", "2016-03-05", 2015, False, at(1)),  # repeats the state
        (3, 1, 7, "net-income", "20151231", 2.0, "t", "2016-05-05", 2015, True, at(2)),
        (4, 1, 7, "NET_INCOME", "2015-12-31", None, "t", "2016-04-01", 2015, None, at(9)),  # late, splits
        (5, 1, 7, "net_income", "2015-12-31", 9.0, "t", "2016-05-05", 2015, True, at(1)),  # loaded before 3
        (6, 1, 7, "net_income", "2015-12-31", 8.0, "t", None, 2015, True, at(3)),
        (7, 1, 7, "net_income", "2015-12-31", 8.0, "t", "n/a", 2015, True, at(3)),
        (8, None, None, "x", None, float("nan"), None, "2016-01-01", None, None, None),
        (9, None, None, "x", None, float("nan"), None, "2016-02-01", None, None, at(1)),
    ]
    df = spark.createDataFrame(rows, RESOLVED).withColumn("v", F.lit("clash")).withColumn("k0", F.lit(0))
    ledger = resolved_value_ledger(df)
    now = ledger.where("recorded_to is null and segment_id = 7").orderBy("valid_from").select(F.col("valid_from").cast("string"), F.col("valid_to").cast("string"), "value").collect()
    assert [tuple(r) for r in now] == [("2016-01-05", "2016-04-01", 1.0), ("2016-04-01", "2016-05-05", None), ("2016-05-05", "9999-12-31", 2.0)]
    assert ledger.where("recorded_to is not null and segment_id = 7").count() >= 2
    assert ledger.where("segment_id is null").count() == 1
    assert resolved_value_ledger(df.where("false")).count() == 0


def test_nested_round_trip(spark, tmp_path):
    entry = {"end": "2020-12-31", "val": 5, "fy": 2020}
    usual = {"cik": 1, "entityName": "A", "facts": {"us-gaap": {"Tag": {"label": None, "units": {"USD": [entry, None, entry], "EUR": entry}}, "No": {"units": None}}, "srt": None, "dei": {}}}
    listed = {"cik": "2", "facts": [{"taxonomy": "dei", "concepts": [{"tag": "T", "units": [{"unit": "pure", "entries": [entry]}, {"unit": "x"}]}]}, {"taxonomy": "none"}]}
    texts = [json.dumps(usual), json.dumps({"status": "ok", "data": listed}), json.dumps(json.dumps(usual)), json.dumps({"companyfacts": [usual, listed]}), '{"facts": {"us', "", None, "{}", '{"cik": 3, "meta": {"facts": "x", "units": ["y"]}}', json.dumps(usual | {"meta": {"facts": "x"}})]
    df = spark.createDataFrame([(i, i, t, "clash") for i, t in enumerate(texts)], "file_id BIGINT, cik BIGINT, payload STRING, key STRING")
    tagged = emit_tagged(df)
    entries = sorted((r["file_id"], r["taxonomy"], r["tag"], r["unit"], r["pos"]) for r in with_schema(tagged, "entry").collect())
    a = [("us-gaap", "Tag", "EUR", 0), ("us-gaap", "Tag", "USD", 0), ("us-gaap", "Tag", "USD", 2)]
    b = [("dei", "T", "pure", 0)]
    assert entries == sorted([(0, *x) for x in a] + [(1, *x) for x in b] + [(2, *x) for x in a] + [(3, *x) for x in a + b] + [(9, *x) for x in a])
    status = {r["file_id"]: r["status"] for r in with_schema(tagged, "file").collect()}
    assert [status[i] for i in (4, 5, 6, 7)] == ["broken", "empty", "empty", "ok"]
    path = write_tagged(tagged, str(tmp_path / "flat"))
    rows = {t: read_table(spark, path, t) for t in TABLES}
    for child, parent in (("entry", "unit"), ("unit", "tag"), ("tag", "file")):
        assert rows[child].join(rows[parent].select(F.col("key").alias("parent")), "parent", "left_anti").count() == 0
    assert with_schema(emit_tagged(df.where("false")), "entry").count() == 0


def test_results_do_not_depend_on_partitions(spark):
    random.seed(1)
    rows = [(i, 1, random.randint(1, 3), "a", "2015-12-31", float(random.randint(1, 2)), "t", f"2016-0{random.randint(1, 9)}-01", 2015, False, T0 + dt.timedelta(days=random.randint(0, 9))) for i in range(200)]
    df = spark.createDataFrame(rows, RESOLVED)
    results = [sorted(map(str, resolved_value_ledger(df.repartition(n)).collect())) for n in (1, 7)]
    assert results[0] == results[1]


def test_a_feed_that_changes_its_unit(spark):
    """A silent feed goes from dollars to thousands, then to lakh, within its history: each stretch gets its own power."""
    rows, want = [], {}
    for day in range(0, 900, 3):
        at, cik = dt.datetime(2016, 1, 4) + dt.timedelta(days=day), day % 40
        amount = 1_000_000.0 * (cik + 3)
        power = 0 if day < 300 else 3 if day < 600 else 5
        rows.append((len(rows), cik, "revenue", None, None, 2015, "plain", amount, None, "USD", "whole dollars", at))
        if day % 7:  # not in the weeks of a change
            want[len(rows)] = power
        rows.append((len(rows), cik, "revenue", None, None, 2015, "shifty", amount / 10**power, None, None, None, at))
    specs = spark.createDataFrame([("revenue", "USD")], "item_key STRING, unit STRING")
    got = {r["obs_id"]: r["exp10"] for r in scale_powers(spark.createDataFrame(rows, LINES), specs).collect()}
    assert sum(got[i] != p for i, p in want.items()) <= 4  # a week that holds a change goes to one side


def test_the_search_decides_within_a_feed(monkeypatch):
    rows = [("f", "USD", f"2016-{w:03}", 0 if w < 30 else 30, 9) for w in range(70)]
    both = units._feed_powers(("f", "USD"), rows)
    assert both == [("f", "USD", None, "2016-029", 0), ("f", "USD", "2016-029", None, 3)]
    monkeypatch.setattr(units, "changepoints", lambda points, penalty: [0])
    assert units._feed_powers(("f", "USD"), rows) == [("f", "USD", None, None, 3)]


def test_a_level_between_factors_tells_nothing():
    rows = [("f", "USD", "2016-001", 15, 9)]
    assert units._feed_powers(("f", "USD"), rows) == [("f", "USD", None, None, None)]
    strays = [("f", "USD", f"2016-{w:03}", off, n) for w in range(20) for off, n in ((0, 9), (30, 1))]
    assert [r[-1] for r in units._feed_powers(("f", "USD"), strays)] == [0]
    assert units.FACTORS["USD"] == (-2, 0, 3, 5, 6, 7, 9) and units.FACTORS["pure"] == (-4, -3, -2, 0)
