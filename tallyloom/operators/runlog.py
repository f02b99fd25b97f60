"""Run history as tables: counts, lookups, idempotent inserts, failure streaks, eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_since(runs: DataFrame, at: Column, since: Column) -> DataFrame:
    return runs.where(at >= since).agg(F.count(F.lit(1)).alias("n"))


def daily(runs: DataFrame, at: str, cap: int) -> DataFrame:
    """Runs per UTC day and whether the cap was reached."""
    day = F.date_format(at, "yyyy-MM-dd").alias("day")
    return runs.groupBy(day).agg(F.count(F.lit(1)).alias("n")).withColumn("capped", F.col("n") >= cap)


def latest(runs: DataFrame, keys: list[str], at: list[str], columns: list[str]) -> DataFrame:
    """The newest row of each key, by partial aggregation."""
    return runs.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*at)).alias("r")).select(*keys, "r.*")


def first_insert(runs: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """What stays of inserts that ignore keys already there: the first row of each key."""
    return runs.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("r")).select(*keys, "r.*")


def ranked(rows: DataFrame, key: str, bucket: Column, order: list[str], name: str = "n") -> DataFrame:
    """``rows`` with their place within the key, from 1. ``bucket`` rises with the order, so a key that holds much of the
    table is ranked bucket by bucket, in as many tasks; the buckets' sizes alone are summed up per key."""
    placed = rows.withColumn("bucket", bucket)
    sizes = placed.groupBy(key, "bucket").agg(F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(Window.partitionBy(key).orderBy("bucket")) - F.col("size")
    starts = sizes.select(key, "bucket", before.alias("before"))
    inner = F.row_number().over(Window.partitionBy(key, "bucket").orderBy(*order))
    return placed.withColumn("inner", inner).join(starts, [key, "bucket"]).withColumn(name, F.col("before") + F.col("inner")).drop("inner", "before", "bucket")


def streaks(events: DataFrame, key: str, order: list[str], failed: Column, ignored: Column | None = None, bucket: Column | None = None) -> DataFrame:
    """(key, ``length``) of every unbroken run of failures. Ignored rows neither add nor break; a NULL verdict is no failure; a
    NULL key is a key of its own.

    Rows are walked per key and ``bucket`` (an hour of the first order column if none is given; it must rise with the
    order), so a key that holds much of the table is spread over as many tasks as it has buckets. Each bucket is then
    summed up in what it begins with, ends with and has in between, and only those few numbers are joined over a
    key's buckets, whose number the calendar bounds.
    """
    e = events.where(~F.coalesce(ignored, F.lit(False))) if ignored is not None else events
    b = bucket if bucket is not None else F.date_trunc("hour", F.col(order[0]))
    rows = e.select(F.col(key), b.alias("b"), F.coalesce(failed, F.lit(False)).alias("f"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    within = Window.partitionBy(key, "b").orderBy(*[f"o{i}" for i in range(len(order))])
    marked = rows.withColumn("g", F.sum((~F.col("f")).cast("bigint")).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    # Island g holds the failures after the g-th success of the bucket; island 0 touches its start, the last one its end.
    islands = marked.groupBy(key, "b", "g").agg(F.count_if("f").alias("n"))
    placed = islands.withColumn("last", F.max("g").over(Window.partitionBy(key, "b")))
    inner = placed.where((F.col("g") > 0) & (F.col("g") < F.col("last")) & (F.col("n") > 0)).select(key, F.col("n").alias("length"))
    edges = placed.groupBy(key, "b", "last").agg(F.max(F.when(F.col("g") == 0, F.col("n"))).alias("head"), F.max(F.when(F.col("g") == F.col("last"), F.col("n"))).alias("tail"))
    over = Window.partitionBy(key).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    broken = (F.col("last") > 0).cast("bigint")
    run = edges.withColumn("open", F.sum(broken).over(over)).withColumn("close", F.col("open") - broken)
    parts = run.select(key, F.explode(F.array(F.struct(F.col("close").alias("r"), F.coalesce("head", F.lit(0)).alias("n")), F.struct(F.col("open").alias("r"), F.when(F.col("last") > 0, F.col("tail")).otherwise(0).alias("n")))).alias("p"))
    joined = parts.groupBy(key, F.col("p.r").alias("r")).agg(F.sum("p.n").alias("length")).where("length > 0").select(key, "length")
    return inner.unionByName(joined)


def evict(handles: DataFrame, finished: Column, finished_at: Column, order: list[str], now: Column, ttl_seconds: int, cap: int) -> DataFrame:
    """Which handles stay: a finished one goes when older than the time to live; then, while more than ``cap`` are left, the
    oldest finished ones go. Running ones always stay.

    Among the finished, those that stay are the newest few: at most ``cap``, taken by a bounded top-k, without a sort of all.
    """
    alive = handles.withColumn("done", finished).where(~finished | (finished_at >= now - F.expr(f"INTERVAL {ttl_seconds} SECONDS")))
    running = alive.where(~F.col("done"))
    room = max(0, cap - running.count())
    newest = alive.where("done").orderBy(*[F.desc(c) for c in order]).limit(room)
    return running.unionByName(newest).drop("done")


def run_table(events: DataFrame, key: str, at: str, status: Column, terminal: Column, timeout_seconds: int, tie: str) -> DataFrame:
    """One row per run from its events, as idempotent creation followed by keyed updates leaves it: when it was created, its
    first terminal status and when, or ``timeout`` where none came in time. One aggregation."""
    order = F.struct(at, tie)
    g = events.groupBy(key).agg(F.min(at).alias("created_at"), F.min(F.when(terminal, F.struct(F.col(at).alias("t"), F.col(tie).alias("i"), status.alias("s")))).alias("end"), F.max_by(status, order).alias("last_status"))
    late = F.col("end").isNull() | (F.col("end.t") > F.col("created_at") + F.expr(f"INTERVAL {timeout_seconds} SECONDS"))
    return g.select(key, "created_at", F.when(late, F.lit("timeout")).otherwise(F.col("end.s")).alias("status"), F.when(~late, F.col("end.t")).alias("completed_at"), "last_status")


def outcome(reported: Column, open_circuit: Column, has_figures: Column, has_chunks: Column, text: Column) -> Column:
    """Why an item has no commentary; the first reason that holds, NULL where it has one."""
    return (
        F.when(~reported, "does not report this item").when(open_circuit, "stopped after repeated failures").when(~has_figures, "no value in any year").when(~has_chunks, "no passages retrieved").when(text.isNull(), "failed twice")
    )
