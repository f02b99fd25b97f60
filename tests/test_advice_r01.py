
from statistics import median

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.operators.units import _count_powers, _weighted_median
from tallyloom.plans.runs import q51_filing_history, q64_annual_filings


@given(st.dictionaries(st.integers(-9, 9), st.integers(1, 9), min_size=1, max_size=9))
@settings(max_examples=300, deadline=None)
def test_weighted_median(counts):
    assert _weighted_median(counts) == median([v for v, n in counts.items() for _ in range(n)])


def test_every_reading_of_a_level_counts():
    key = (1, "weighted_diluted_shares")
    rows = [(*key, 2016, 60, 0, 50), (*key, 2016, 58, 1, 60), (*key, 2016, 61, 1, 60), (*key, 2016, 90, 1, 1000)]
    assert _count_powers(key, rows) == [(*key, 2016, 60, 3)]


def test_no_customers_orders_are_brought_into_one_row(spark, tmp_path):
    columns = ["1L AS o_custkey", "id AS o_orderkey", "date_add(DATE'2020-01-01', int(id DIV 2)) AS o_orderdate", "if(id % 4 = 3, 'O', 'F') AS o_orderstatus"]
    spark.range(1000).selectExpr(*columns).write.parquet(f"{tmp_path}/orders.parquet")
    one, every = (f(spark, str(tmp_path)) for f in (q51_filing_history, q64_annual_filings))
    assert [r["accession"] for r in one.collect()] == [998]
    ranks = [(r["n"], r["accession"]) for r in every.orderBy("n").collect()]
    assert ranks[:3] == [(1, 998), (2, 996), (3, 997)] and [n for n, _ in ranks] == list(range(1, 751))
    plans = [f._jdf.queryExecution().executedPlan().toString() for f in (one, every)]
    assert not any("collect_list" in p for p in plans)
