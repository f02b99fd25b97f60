"""Queries over run events, filing histories and company keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import runlog
from tallyloom.operators.nested import emit_tagged, with_schema
from tallyloom.session import table
from tallyloom.sources.readers import cache_key, padded_cik, resolve_ticker, source_url, ticker
from tallyloom.streaming.runs import event_stream, replay, terminal_states, windowed_counts


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def q45_daily_runs(spark: SparkSession, d: str) -> DataFrame:
    return runlog.daily(_events(spark, d), "ts", 340)


def q45_count_since(spark: SparkSession, d: str) -> DataFrame:
    return runlog.count_since(_events(spark, d), F.col("ts"), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))


def q46_latest_run(spark: SparkSession, d: str) -> DataFrame:
    """The newest purchase of each user, and only then whether its value is enough."""
    newest = runlog.latest(_events(spark, d).where("event_type = 'purchase'"), ["user_id"], ["ts", "event_id"], ["event_id", "value"])
    return newest.where("value >= 20")


def q47_first_insert(spark: SparkSession, d: str) -> DataFrame:
    return runlog.first_insert(_events(spark, d), ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"])


def q48_circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    found = runlog.streaks(_events(spark, d), "user_id", ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "view")
    return found.groupBy("user_id").agg(F.max("length").alias("longest"), F.count_if(F.col("length") >= 3).alias("n_open"))


def q49_evict_finished(spark: SparkSession, d: str) -> DataFrame:
    """Sign-ups run on, all else is finished; what stays at noon of the last full day."""
    now = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    handles = _events(spark, d).where(F.col("ts") <= now).select("event_id", "ts", "event_type")
    kept = runlog.evict(handles, F.col("event_type") != "signup", F.col("ts"), ["ts", "event_id"], now, 1800, 64)
    return kept.select("event_id")


def q50_stream_terminal_state(spark: SparkSession, d: str) -> DataFrame:
    return replay(terminal_states(event_stream(spark, f"{d}/events.parquet"))).select("user_id", "last_type", "last_event", "n_events")


def q54_stream_windows(spark: SparkSession, d: str) -> DataFrame:
    counts = replay(windowed_counts(event_stream(spark, f"{d}/events.parquet")), "complete")
    return counts.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def _annual(spark: SparkSession, d: str) -> DataFrame:
    """Orders that stand for annual filings, one row each; amendments and quarterly ones left out."""
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", "o_orderdate", (-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("age"))


def q51_filing_history(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's newest annual filing; combined before the shuffle, so a customer may have any number."""
    g = _annual(spark, d).groupBy("o_custkey").agg(F.min_by(F.struct("o_orderkey", "o_orderdate"), F.struct("age", "o_orderkey")).alias("r"))
    return g.select("o_custkey", F.col("r.o_orderkey").alias("accession"), F.date_format("r.o_orderdate", "yyyy-MM-dd").alias("filed"))


def q52_validate_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "company").select("cik_str", ticker("ticker").alias("ticker"), padded_cik("cik_str").alias("cik"))


def q52_resolve_ticker(spark: SparkSession, d: str) -> DataFrame:
    return resolve_ticker(table(spark, d, "company"))


def q52_source_url(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    url = source_url(F.col("cik"), F.concat_ws("-", F.lpad(F.col("cik").cast("string"), 10, "0"), F.lit("00"), F.col("doc_id").cast("string")), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".htm")))
    return docs.select("doc_id", url.alias("url"), cache_key(url).alias("cache_key"))


def q53_json_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k BIGINT")["k"]
    return _events(spark, d).groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.max(k).alias("most"))


def q55_long_facts(spark: SparkSession, d: str) -> DataFrame:
    """Entries of one taxonomy in all layouts of the files."""
    e = with_schema(emit_tagged(table(spark, d, "companyfacts")), "entry").where("taxonomy = 'us-gaap'")
    return e.select("file_id", "tag", "unit", F.col("pos").cast("bigint").alias("pos"), "end", "val")


def q56_files(spark: SparkSession, d: str) -> DataFrame:
    """What became of each fact file."""
    files = with_schema(emit_tagged(table(spark, d, "companyfacts")), "file")
    return files.select("file_id", "status")


def q62_run_table(spark: SparkSession, d: str) -> DataFrame:
    """A user's day as a run: purchases and errors end it, and two hours are the limit."""
    e = _events(spark, d).withColumn("run_id", F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")))
    runs = runlog.run_table(e, "run_id", "ts", F.col("event_type"), F.col("event_type").isin("purchase", "error"), 7200, "event_id")
    return runs.select("run_id", "status", "last_status")


def q63_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Per company, why it would get no commentary."""
    docs = table(spark, d, "documents").groupBy("cik").agg(F.count(F.lit(1)).alias("n_docs"), F.max(F.when(F.length("text") > 0, "text")).isNotNull().alias("has_text"))
    values = table(spark, d, "resolved_value").groupBy("cik").agg(F.count("value").alias("n_values"))
    c = table(spark, d, "company").select(F.col("cik_str").alias("cik"), F.col("ticker").isNotNull().alias("listed")).join(docs, "cik", "left").join(values, "cik", "left")
    why = runlog.outcome(F.col("n_values").isNotNull(), ~F.col("listed"), F.coalesce("n_values", F.lit(0)) > 0, F.coalesce("n_docs", F.lit(0)) > 0, F.when(F.col("has_text"), F.lit("text")))
    return c.select("cik", why.alias("reason"))


def q64_annual_filings(spark: SparkSession, d: str) -> DataFrame:
    """All annual filings of each customer, newest first; ranked month by month, so a customer may have any number."""
    month = F.floor(F.col("age") / (30 * 86_400_000_000))
    every = runlog.ranked(_annual(spark, d), "o_custkey", month, ["age", "o_orderkey"])
    return every.select("o_custkey", F.col("n").cast("bigint").alias("n"), F.col("o_orderkey").alias("accession"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filed"))


def q65_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Texts that occur under several ids, by their fingerprint: the lowest id and the number of ids."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", cache_key("text").alias("digest"))
    return t.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_ids")).where("n_ids > 1")


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q") and callable(f) and name[1:3].isdigit()}

SQL = {
    "q45_daily_runs": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*)::BIGINT AS n, count(*) >= 340 AS capped FROM events GROUP BY 1",
    "q45_count_since": "SELECT count(*)::BIGINT AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15'",
    "q46_latest_run": "SELECT * FROM (SELECT user_id, event_id, value FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE value >= 20",
    "q47_first_insert": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    "q48_circuit_breaker": """WITH e AS (SELECT user_id, event_type = 'error' AS f, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events WHERE event_type <> 'view'),
i AS (SELECT user_id, g, count(*) AS n FROM e WHERE f GROUP BY ALL) SELECT user_id, max(n)::BIGINT AS longest, count(*) FILTER (n >= 3)::BIGINT AS n_open FROM i GROUP BY user_id""",
    "q49_evict_finished": """WITH h AS (SELECT event_id, ts, event_type <> 'signup' AS done FROM events WHERE ts <= TIMESTAMP '2024-01-30 12:00:00'),
a AS (SELECT * FROM h WHERE NOT done OR ts >= TIMESTAMP '2024-01-30 11:30:00'), r AS (SELECT count(*) AS n FROM a WHERE NOT done)
SELECT event_id FROM a WHERE NOT done UNION ALL SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS k FROM a WHERE done), r WHERE k <= 64 - n""",
    "q50_stream_terminal_state": "SELECT user_id, arg_max(event_type, row(ts, event_id)) AS last_type, arg_max(event_id, row(ts, event_id)) AS last_event, count(*)::BIGINT AS n_events FROM events GROUP BY user_id",
    "q54_stream_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL",
    "q51_filing_history": "SELECT o_custkey, o_orderkey AS accession, strftime(o_orderdate, '%Y-%m-%d') AS filed FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1",
    "q52_validate_keys": "SELECT cik_str, CASE WHEN regexp_matches(upper(trim(ticker)), '^[A-Z][A-Z0-9.\\-]{0,9}$') THEN upper(trim(ticker)) END AS ticker, lpad(cik_str::VARCHAR, 10, '0') AS cik FROM company",
    "q52_resolve_ticker": "SELECT upper(trim(ticker)) AS ticker, lpad(cik_str::VARCHAR, 10, '0') AS cik FROM company WHERE regexp_matches(upper(trim(ticker)), '^[A-Z][A-Z0-9.\\-]{0,9}$') QUALIFY row_number() OVER (PARTITION BY upper(trim(ticker)) ORDER BY added_at, cik_str) = 1",
    "q52_source_url": """WITH u AS (SELECT doc_id, 'https://www.sec.gov/Archives/edgar/data/' || cik::VARCHAR || '/' || lpad(cik::VARCHAR, 10, '0') || '00' || doc_id::VARCHAR || '/doc' || doc_id::VARCHAR || '.htm' AS url FROM documents) SELECT doc_id, url, sha256(url) AS cache_key FROM u""",
    "q53_json_props": "SELECT event_type, count(json_extract(props, '$.k'))::BIGINT AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total, max(json_extract(props, '$.k')::BIGINT) AS most FROM events GROUP BY 1",
    "q62_run_table": """WITH e AS (SELECT user_id::VARCHAR || '-' || strftime(ts, '%Y%m%d') AS run_id, ts, event_id, event_type FROM events),
g AS (SELECT run_id, min(ts) AS c, last(event_type ORDER BY ts, event_id) AS last_status, min(row(ts, event_id, event_type)) FILTER (event_type IN ('purchase', 'error')) AS x FROM e GROUP BY run_id)
SELECT run_id, CASE WHEN x IS NULL OR x[1] > c + INTERVAL 7200 SECONDS THEN 'timeout' ELSE x[3] END AS status, last_status FROM g""",
    "q63_outcomes": """WITH d AS (SELECT cik, count(*) AS n_docs, bool_or(length(text) > 0) AS t FROM documents GROUP BY cik), v AS (SELECT cik, count(value) AS n FROM resolved_value GROUP BY cik)
SELECT cik_str AS cik, CASE WHEN n IS NULL THEN 'does not report this item' WHEN ticker IS NULL THEN 'stopped after repeated failures' WHEN n = 0 THEN 'no value in any year' WHEN n_docs IS NULL THEN 'no passages retrieved' WHEN NOT coalesce(t, false) THEN 'failed twice' END AS reason
FROM company LEFT JOIN d ON d.cik = cik_str LEFT JOIN v ON v.cik = cik_str""",
    "q64_annual_filings": "SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n, o_orderkey AS accession, strftime(o_orderdate, '%Y-%m-%d') AS filed FROM orders WHERE o_orderstatus = 'F'",
    "q65_fingerprints": "SELECT sha256(text) AS digest, min(doc_id) AS first_id, count(*)::BIGINT AS n_ids FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
}
