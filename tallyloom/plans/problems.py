"""Queries of the general training-data operators: units, nested records, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.ledger import resolved_value_ledger
from tallyloom.operators.nested import emit_tagged, read_table, write_tagged
from tallyloom.operators.units import in_common_units, scale_powers
from tallyloom.session import scratch_path, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    powers = scale_powers(table(spark, sf_dir, "line_item"), table(spark, sf_dir, "tag_spec"))
    return powers.where("exp10 <> 0").select("obs_id", "exp10")


def p2_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_common_units(table(spark, sf_dir, "line_item"), table(spark, sf_dir, "tag_spec"))


def _flat(spark: SparkSession, sf_dir: str) -> str:
    """All tables of the payloads, written in one pass to the shared folder."""
    return write_tagged(emit_tagged(table(spark, sf_dir, "companyfacts")), scratch_path(spark, "nested"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, _flat(spark, sf_dir), "entry").select("file_id", "taxonomy", "tag", "unit", "pos")


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per table, its rows and how many of them find their parent row."""
    path = _flat(spark, sf_dir)
    rows = spark.read.parquet(path).select("table", "key", "parent")
    known = rows.select(F.col("key").alias("parent"), F.lit(1).alias("found"))
    linked = rows.join(known, "parent", "left")
    return linked.groupBy(F.col("table").alias("table_name")).agg(F.count(F.lit(1)).alias("n_rows"), F.count("parent").alias("n_children"), F.count("found").alias("n_linked"))


def p4_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved_value_ledger(table(spark, sf_dir, "resolved_value"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    standing = p4_ledger(spark, sf_dir).where("recorded_to is null")
    text = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return standing.select("segment_id", "item_key", "period_end", text("valid_from"), text("valid_to"))


QUERIES = {"p2_found": p2_found, "p2_amounts": p2_amounts, "p3_found": p3_found, "p3_links": p3_links, "p4_found": p4_found, "p4_ledger": p4_ledger}

def _date(c: str) -> str:
    """A date in any of the spellings, as SQL."""
    s = f"trim({c})"
    named = f"try_strptime({s}, ['%d-%b-%Y', '%b %d, %Y', '%m/%d/%Y', '%Y/%m/%d', '%Y%m%d'])"
    return f"CASE WHEN regexp_matches({s}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast({s}[1:10] AS DATE) ELSE try_cast({named} AS DATE) END"


SQL = {
    "p4_found": f"""
WITH r AS (
  SELECT segment_id, regexp_replace(lower(trim(item_key)), '[\\s_-]+', '_', 'g') AS item_key,
         coalesce(strftime({_date('period_end')}, '%Y-%m-%d'), trim(period_end)) AS period_end, {_date('filed')} AS f,
         coalesce(value::VARCHAR, '-') || '|' || coalesce(fiscal_year::VARCHAR, '-') || '|' || coalesce(restated::VARCHAR, '-') AS s, loaded_at, snapshot_id
  FROM resolved_value),
d AS (SELECT * FROM r WHERE f IS NOT NULL QUALIFY row_number() OVER (PARTITION BY segment_id, item_key, period_end, f ORDER BY loaded_at DESC NULLS LAST, snapshot_id DESC) = 1),
c AS (SELECT *, lag(s) OVER (PARTITION BY segment_id, item_key, period_end ORDER BY f) AS p FROM d),
v AS (SELECT * FROM c WHERE p IS NULL OR p <> s)
SELECT segment_id, item_key, period_end, strftime(f, '%Y-%m-%d') AS valid_from,
       coalesce(strftime(lead(f) OVER (PARTITION BY segment_id, item_key, period_end ORDER BY f), '%Y-%m-%d'), '9999-12-31') AS valid_to
FROM v""",
}
