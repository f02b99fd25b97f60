
import pytest
from pyspark.sql import functions as F

from tallyloom.llm.chunking import split_text
from tallyloom.llm.mixing import domain_posteriors, mix
from tallyloom.llm.places import natural_places
from tallyloom.llm.survivors import closed_order, survivors


@pytest.mark.parametrize(
    ("text", "starts"),
    [
        ("Cash rose by 5.5% in the year under report.\tThe rate of tax fell to 8.8% after that. We closed two sites.\tIt was late.", ["Cash", "The", "We", "It"]),
        ("Sales of the segment rose by 4% on the year before.   Our plant was closed for some weeks after the fire. We\topened\tanother one since.", ["Sales", "Our", "We"]),
        ("借入金は来年に返済期限を迎える。\t水道メーター事業の利益率は改善した。\t当社は拠点を閉鎖した。", ["借入金", "水道", "当社"]),
        ("Purchases of plant and equipment, net.   1,000.5   2,000\nRent, cf. note 5.\t1,000\t2,000\nIndex of leases ........ 7", ["Purchases", "Rent", "Index"]),
    ],
)
def test_prose_with_odd_blanks_is_no_table(text, starts):
    found = [o for o, _ in natural_places(text)]
    assert len(found) == len(starts) and all(text[o:].startswith(s) for o, s in zip(found, starts)), [text[o : o + 12] for o in found]


def test_places_beside_the_window_are_used():
    short, long = "Cash rose. ", "word " * 65 + "end. "
    text = short + long + short
    offsets = {o for o, _ in natural_places(text)} | {len(text)}
    assert len(long) <= 4 * 85 + 3 < len(text) and {b for _, b in split_text(text, 85, 0)} <= offsets


ENTRY = "entry_id BIGINT, cik BIGINT, segment_id BIGINT, tag STRING, unit STRING, period_start STRING, period_end STRING, val DOUBLE, fy INT, fp STRING, form STRING, filed STRING, loaded_at TIMESTAMP_NTZ"


def test_closed_order():
    assert closed_order([("x", "p"), ("p", "q"), ("q", "r"), ("r", "q"), ("r", "z")]) == {"x": set(), "p": {"x"}, "q": {"x", "p"}, "r": {"x", "p"}, "z": {"x", "p", "q", "r"}}


def test_undated_rows_take_the_topologically_latest(spark):
    rows = []

    def fact(cik, form, filed, val=1.0):
        rows.append((len(rows), cik, 1, "T", "USD", None, "2015-12-31", val, 2015, "FY", form, filed, None))

    for i, (a, b) in enumerate([("8-K", "10-K"), ("6-K", "10-K"), ("S-1", "10-K"), ("10-K", "10-K/A")]):
        fact(i, a, "2016-01-01")
        fact(i, b, "2016-02-01")
    fact(90, "10-K/A", None)
    fact(90, "10-K", "n/a")  # before 10-K/A, though three states precede it
    fact(91, "8-K", None)
    fact(91, "20-F", None)  # not comparable: by entry
    fact(92, "10-K/A", None, None)
    fact(92, "8-K", None)  # the only one with a value
    got = {r["cik"]: (r["val_entry_id"], r["fy_entry_id"], r["n_rows"]) for r in survivors(spark.createDataFrame(rows, ENTRY)).where("cik >= 90").collect()}
    assert got == {90: (8, 9, 2), 91: (11, 10, 2), 92: (13, 13, 2)}


DOCS = "doc_id BIGINT, text STRING, source STRING"


def test_a_copy_in_a_targeted_source_is_kept(spark):
    docs = spark.createDataFrame([(1, "risk of loss", "wire"), (2, "risk of loss", "risk"), (3, "margin and growth", "review")], DOCS)
    targets = spark.createDataFrame([("risk", 0.5, 1), ("review", 0.5, 1)], "source STRING, target_share DOUBLE, max_repeats INT")
    assert {(r["doc_id"], r["domain"]) for r in mix(docs, targets).collect()} == {(2, "risk"), (3, "review")}


def test_flat_posteriors_keep_their_mass(spark):
    k = 25
    rows = [(i, i if i < k else None, 10, [0.0] * k) for i in range(525)]
    got = domain_posteriors(spark.createDataFrame(rows, "doc_id BIGINT, slot INT, n_tokens BIGINT, ll ARRAY<DOUBLE>"), k)
    assert all(sum(r["p"]) == pytest.approx(1.0) for r in got.collect())
    flat = got.where("slot is null").select(F.explode("p").alias("x")).agg(F.min("x"), F.max("x")).first()
    assert flat == (pytest.approx(1 / k), pytest.approx(1 / k))
