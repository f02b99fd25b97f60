"""Queries of the text operators and the SQL that states their results where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.bpe import encode_corpus
from tallyloom.llm.chunking import cut_places, split_oversized
from tallyloom.llm.mixing import mix, shares_reached
from tallyloom.llm.spam import spam_scores, stuffed_pages
from tallyloom.llm.survivors import duplicate_survivors, survivors
from tallyloom.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_places(table(spark, sf_dir, "documents"), table(spark, sf_dir, "rag_settings")).select("doc_id", "start_char")


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "documents"), table(spark, sf_dir, "rag_settings"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_survivors(table(spark, sf_dir, "fact_entry"))


def p5_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors(table(spark, sf_dir, "fact_entry")).select("group_id", "n_rows", "val", "val_entry_id", "filed", "fy", "fy_entry_id")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares_reached(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffed_pages(table(spark, sf_dir, "documents"))


def p8_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per host, its pages and how many are stuffed."""
    s = spam_scores(table(spark, sf_dir, "documents"))
    return s.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("score") > 0.5).alias("n_stuffed"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p5_found, p5_survivors, p6_ids, p7_mix, p7_shares, p8_found, p8_hosts)}


def _date(c: str) -> str:
    s = f"trim({c})"
    named = f"try_strptime({s}, ['%d-%b-%Y', '%b %d, %Y', '%m/%d/%Y', '%Y/%m/%d', '%Y%m%d'])"
    return f"CASE WHEN regexp_matches({s}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast({s}[1:10] AS DATE) ELSE try_cast({named} AS DATE) END"


SQL = {
    "p5_found": f"""
WITH r AS (
  SELECT entry_id, cik, segment_id,
         regexp_replace(regexp_replace(lower(trim(tag)), '^us-gaap[:_]', ''), '[^a-z0-9]', '', 'g') AS tag,
         regexp_replace(regexp_replace(replace(lower(unit), ' ', ''), '(iso4217|xbrli)[:_]', '', 'g'), '-per-', '/') AS unit,
         coalesce({_date('period_start')}::VARCHAR, nullif(trim(period_start), '')) AS a, coalesce({_date('period_end')}::VARCHAR, nullif(trim(period_end), '')) AS b,
         {_date('filed')} AS f, CASE WHEN NOT isnan(val) THEN val END AS v, fy
  FROM fact_entry),
g AS (SELECT *, min(entry_id) OVER w AS group_id, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY cik, segment_id, tag, unit, a, b)),
o AS (SELECT group_id, entry_id, v, fy,
             row_number() OVER (PARTITION BY group_id ORDER BY v IS NULL, f IS NULL, f DESC, entry_id DESC) AS rv,
             row_number() OVER (PARTITION BY group_id ORDER BY fy IS NULL, f IS NULL, f, entry_id) AS rf
      FROM g WHERE n > 1)
SELECT group_id, max(CASE WHEN rv = 1 AND v IS NOT NULL THEN entry_id END) AS val_entry_id, max(CASE WHEN rf = 1 AND fy IS NOT NULL THEN entry_id END) AS fy_entry_id
FROM o GROUP BY group_id""",
}
