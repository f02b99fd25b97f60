"""Filings data as tables: company lists, fact files, filing histories, caches, and the checks on their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "STRUCT<start: STRING, `end`: STRING, val: DOUBLE, fy: INT, fp: STRING, form: STRING, filed: STRING>"
FACTS = f"STRUCT<cik: STRING, entityName: STRING, facts: MAP<STRING, MAP<STRING, STRUCT<units: MAP<STRING, ARRAY<{ENTRY}>>>>>>"


def company_list(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of companies, in the order it is written: ``place``, ``cik_str``, ``ticker``, ``title``."""
    raw = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "MAP<STRING, STRUCT<cik_str: BIGINT, ticker: STRING, title: STRING>>")
    return raw.select(F.posexplode(F.map_values(parsed)).alias("place", "c")).select("place", "c.*")


def ticker(c: Column | str) -> Column:
    """A ticker in its one spelling, NULL where it can be none."""
    t = F.upper(F.trim(c))
    return F.when(t.rlike(r"^[A-Z][A-Z0-9.\-]{0,9}$"), t)


def padded_cik(c: Column | str) -> Column:
    """A company number of 10 digits; NULL where it is negative or no number."""
    n = (F.col(c) if isinstance(c, str) else c).try_cast("bigint")
    return F.when(n >= 0, F.lpad(n.cast("string"), 10, "0"))


def resolve_ticker(companies: DataFrame) -> DataFrame:
    """(``ticker``, ``cik``): the first company of each ticker, by the time it was added, then the lower number."""
    t = companies.select(ticker("ticker").alias("ticker"), "cik_str", "added_at").where("ticker is not null")
    return t.groupBy("ticker").agg(F.min_by("cik_str", F.struct("added_at", "cik_str")).alias("c")).select("ticker", padded_cik(F.col("c")).alias("cik"))


def long_facts(files: DataFrame, taxonomy: str = "us-gaap") -> DataFrame:
    """Fact files of the usual layout as long rows, parsed with a schema by the JVM; other layouts give no rows here (the
    nested operator reads them). ``pos`` is the place within the unit."""
    f = files.select("file_id", F.from_json("payload", FACTS, {"mode": "PERMISSIVE"}).alias("j"))
    tags = f.select("file_id", F.col("j.cik").alias("cik"), F.explode(F.col("j.facts")[taxonomy]).alias("tag", "t"))
    units = tags.select("file_id", "cik", "tag", F.explode("t.units").alias("unit", "e"))
    return units.select("file_id", "cik", "tag", "unit", F.posexplode("e").alias("pos", "x")).where("x is not null").select("file_id", "cik", "tag", "unit", "pos", "x.*")


def zipped(history: DataFrame, key: str, arrays: list[str]) -> DataFrame:
    """Parallel arrays of a filing history as rows, with their place."""
    return history.select(key, F.posexplode(F.arrays_zip(*arrays)).alias("place", "z")).select(key, "place", "z.*")


def latest_annual(filings: DataFrame, key: str) -> DataFrame:
    """The first filing listed with the form 10-K, amendments left out."""
    return filings.where("form = '10-K'").groupBy(key).agg(F.min_by(F.struct("accession", "filed"), "place").alias("r")).select(key, "r.*")


def cache_key(url: Column | str) -> Column:
    return F.sha2(url, 256)


def source_url(cik: Column, accession: Column, document: Column) -> Column:
    """The archive path of a filing's document; the number without leading zeros, the accession without dashes."""
    return F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), cik.cast("bigint").cast("string"), F.lit("/"), F.regexp_replace(accession, "-", ""), F.lit("/"), document)


def trimmed(html: Column, start: str, end: str, margin: int) -> Column:
    """A long page cut to the stretch from before the first ``start`` to after the last ``end``; whole if either is missing."""
    low = F.lower(html)
    first = F.locate(start, low)
    last = F.length(html) - F.locate(end[::-1], F.reverse(low)) + 1
    begin = F.greatest(F.lit(1), first - margin)
    return F.when((first > 0) & F.contains(low, F.lit(end)), F.substring(html, begin, F.least(F.length(html), last + margin) - begin + 1)).otherwise(html)
