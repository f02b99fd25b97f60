"""Drafts with one planted fault each, and what must not be taken for a fault."""

import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators.drafts import VERDICTS, verdicts
from tallyloom.operators.grounding import clauses, grounded, is_negative, numbers_told

GROWING = [(2020, "$80.00B"), (2021, "$100.00B"), (2022, "$90.00B"), (2023, "$120.00B")]
FIGURES = {"growing": GROWING, "loss": [(2022, "$3.00B"), (2023, "-$9.45B")], "count": [(2022, "15.00B shares"), (2023, "15.55B shares")], "flat": [(2022, "$100.00B"), (2023, "$101.00B")], "odd": [(2023, "$1.00B"), (2023, "$2.00B"), (2022, "$3.00B")], "thin": [(2023, "$391.04B")]}
CHUNKS = {"item7-0001": "Net sales were strong, at 77 stores.", "item1a-0002": "x" * 400}


def cite(chunk, quote):
    return {"chunk_id": chunk, "quote": quote}


CASES = [
    ("growing", None, "not_json"),
    ("growing", "{not", "not_json"),
    ("growing", "[1]", "bad_shape"),
    ("growing", {"citations": []}, "bad_shape"),
    ("growing", {"text": 5}, "bad_shape"),
    ("growing", {"text": "a", "citations": {"chunk_id": "item7-0001"}}, "bad_shape"),
    ("growing", {"text": "a", "citations": [cite("Item7-1", "abcde")]}, "bad_shape"),
    ("growing", {"text": "a", "citations": [cite("x" * 60 + "-0001", "abcde")]}, "bad_shape"),
    ("growing", {"text": "a", "citations": [{"chunk_id": "item7-0001"}]}, "bad_shape"),
    ("growing", {"text": None, "citations": [cite("item7-0001", "Net sales")]}, "refusal_with_citations"),
    ("growing", {"text": None}, "ok"),
    ("growing", {"text": "", "citations": []}, "ok"),
    ("growing", {"text": "a", "citations": [cite("item7-0009", "Net sales")]}, "unknown_chunk"),
    ("growing", {"text": "a", "citations": [cite("item1a-0002", "x" * 301)]}, "too_long"),
    ("growing", {"text": "a", "citations": [cite("item7-0001", "  Net   ")]}, "too_short"),
    ("growing", {"text": "a 999", "citations": [cite("item7-0001", "Net sales"), cite("item7-0001", "net sales")]}, "not_verbatim"),
    ("growing", {"text": "At 77 stores it was $120.00B.", "citations": [cite("item7-0001", "at 77 stores")]}, "ok"),
    ("thin", {"text": "It was 1.04."}, "ungrounded"),
    ("thin", {"text": "It was 391.04."}, "ungrounded"),
    ("thin", {"text": "It was $391."}, "ungrounded"),
    ("thin", {"text": "It was 391.04B."}, "ok"),
    ("nobody", {"text": "It was 1."}, "ungrounded"),
    ("nobody", {"text": "It rose by much."}, "ok"),
    ("loss", {"text": "It was $9.45B."}, "wrong_sign"),
    ("loss", {"text": "It was 9.45B."}, "wrong_sign"),
    ("loss", {"text": "It was -$9.45B."}, "ok"),
    ("loss", {"text": "It was ($9.45B) in FY2023."}, "ok"),
    ("loss", {"text": "It was ($3.00B)."}, "wrong_sign"),
    ("loss", {"text": "It was (2023)."}, "ok"),
    ("count", {"text": "There were 15.55B shares in FY2023."}, "ok"),
    ("growing", {"text": "FY2022: $120.00B."}, "wrong_year"),
    ("growing", {"text": "It was $90.00B in the most recent fiscal year."}, "wrong_year"),
    ("growing", {"text": "It was $120.00B in the latest year."}, "ok"),
    ("growing", {"text": "It went from $90.00B in FY2022 to $120.00B in FY2023."}, "ok"),
    ("growing", {"text": "It went from $90.00B in FY2022 to $120.00B in FY2022."}, "wrong_year"),
    ("odd", {"text": "It was $3.00B in the latest year."}, "ok"),
    ("growing", {"text": "It fell to $120.00B from $90.00B."}, "wrong_direction"),
    ("growing", {"text": "It rose to $120.00B from $90.00B."}, "ok"),
    ("growing", {"text": "It declined to $120.00B."}, "wrong_direction"),
    ("growing", {"text": "It declined to $120.00B from before."}, "ok"),
    ("growing", {"text": "It declined to $80.00B."}, "ok"),
    ("growing", {"text": "It did not decline to $120.00B."}, "ok"),
    ("growing", {"text": "It may decline to $120.00B."}, "ok"),
    ("growing", {"text": "It was flat at $120.00B."}, "wrong_direction"),
    ("flat", {"text": "It was unchanged at $101.00B."}, "ok"),
    ("flat", {"text": "It fell to $101.00B."}, "ok"),
    ("growing", {"text": "Costs fell while it reached $120.00B."}, "ok"),
    ("growing", {"text": "It rose steadily from $80.00B to $120.00B."}, "not_steady"),
    ("growing", {"text": "It rose from $80.00B to $120.00B."}, "ok"),
    ("loss", {"text": "It rose to -$9.45B."}, "ok"),
]


def test_verdicts(spark):
    drafts = spark.createDataFrame([(i, s, d if d is None or isinstance(d, str) else json.dumps(d)) for i, (s, d, _) in enumerate(CASES)], "draft_id INT, subject STRING, raw STRING").withColumn("v", F.lit("clash")).withColumn("figures", F.lit(1))
    figures = spark.createDataFrame([(s, y, f) for s, each in FIGURES.items() for y, f in each], "subject STRING, fiscal_year INT, figure STRING")
    chunks = spark.createDataFrame(list(CHUNKS.items()), "chunk_id STRING, text STRING")
    got = {r["draft_id"]: r["verdict"] for r in verdicts(drafts, figures, chunks).collect()}
    wrong = [(*c[:2], c[2], got[i]) for i, c in enumerate(CASES) if got[i] != c[2]]
    assert not wrong and {c[2] for c in CASES} == {*VERDICTS, "ok"}
    assert verdicts(drafts.where("false"), figures, chunks).count() == 0
    assert verdicts(drafts, figures.where("false"), chunks.where("false")).count() == len(CASES)


def test_numbers_and_clauses(spark):
    text = "5-3, (4.5%) and (2024): −$7 FY2023 to 8."
    df = spark.createDataFrame([(text,), ("",), (None,)], "t STRING")
    rows = [r["n"] for r in df.select(numbers_told(F.col("t")).alias("n")).collect()]
    assert [(n["token"], n["negative"]) for n in rows[0]] == [("5", False), ("3,", False), ("4.5%", True), ("2024", False), ("$7", True), ("2023", False), ("8", False)] and rows[1] == []
    assert rows[0][-1]["before"] == " FY2023 to "
    cut = spark.createDataFrame([("Sales rose 2.5% and costs fell; it, too, was flat: yes.",)], "t STRING").select(clauses(F.col("t"))).first()[0]
    assert cut == ["Sales rose 2.5%", "costs fell", "it, too, was flat", "yes"]
    held = spark.createDataFrame([("$416", "$416.16B"), ("1.04", "$391.04B"), ("$5", "(-$5)"), ("9.45B", "FY1: -$9.45B")], "t STRING, h STRING")
    assert [tuple(r) for r in held.select(grounded(F.col("t"), F.array("h")), is_negative(F.col("h"), F.col("t"))).collect()] == [(False, False), (False, False), (True, True), (True, True)]


@pytest.mark.parametrize("text", ["a" * 200_000, "1 " * 3_000])
def test_long_texts(spark, text):
    assert spark.createDataFrame([(text,)], "t STRING").select(F.size(numbers_told(F.col("t")))).first()[0] == text.count("1")
