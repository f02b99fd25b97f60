"""Pages that are mostly stuffed keywords, links or tags, found by bagged trees trained on weak labels."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.pagefeatures import VOTES, page
from tallyloom.session import checkpointed

#: Most labelled pages the trees are trained on (a uniform sample by id hash); everything else covers all pages.
TRAINING_PAGES = 20_000
TREES, DEPTH = 30, 6
#: Pages of the corpus rate that a host's own rate is shrunk by, and the most that trees or a host can be sure, in odds.
PRIOR_PAGES, SUREST = 20, 1e4
#: How far a host's rate moves its pages: 1 would take pages of a host as independent of each other.
HOST_WEIGHT = 0.5


def page_features(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``host`` (the page's source), ``f``, its features, and ``votes``; each page is read once, in its task."""
    slim = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("host"), "text")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("host", T.StringType()), T.StructField("f", T.ArrayType(T.DoubleType())), T.StructField("votes", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            read = [page(t) for t in b.column("text").to_pylist()]
            f, votes = pa.array([r[0] for r in read], pa.list_(pa.float64())), pa.array([r[1] for r in read], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("host").cast(pa.string()), f, votes], names=["doc_id", "host", "f", "votes"])

    return slim.mapInArrow(run, schema)


def weak_label(votes: Column) -> Column:
    """1.0 where more votes are for a page being stuffed than against, 0.0 where fewer, NULL where none is cast or they tie."""
    total = F.aggregate(votes, F.lit(0), lambda a, v: a + v)
    return F.when(total > 0, F.lit(1.0)).when(total < 0, F.lit(0.0))


def _tree_scores(pages: DataFrame) -> DataFrame:
    """``pages`` with ``tree_score``, the trees' probability with both kinds of labelled pages weighing the same."""
    labelled = pages.withColumn("label", weak_label(F.col("votes"))).where("label is not null")
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:  # trees grown on pages of one kind say that kind of every page
        return pages.withColumn("tree_score", F.lit(float(next(iter(counts), 0.0))))
    share = min(1.0, TRAINING_PAGES / sum(counts.values()))
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    sample = sample.withColumn("features", array_to_vector("f")).withColumn("weight", F.when(F.col("label") == 1, F.lit(counts[0.0] / counts[1.0])).otherwise(F.lit(1.0)))
    trees = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, maxBins=64, minInstancesPerNode=2, featureSubsetStrategy="onethird", subsamplingRate=1.0, seed=7, labelCol="label", weightCol="weight", featuresCol="features"
    )
    model = trees.fit(sample)
    return model.transform(pages.withColumn("features", array_to_vector("f"))).withColumn("tree_score", vector_to_array("probability")[1])


def spam_scores(docs: DataFrame) -> DataFrame:
    """(``doc_id``, ``host``, ``votes``, ``tree_score``, ``score``): the trees' probability that a page is stuffed, and the
    same smoothed by its host's rate.

    Weak labels come from the majority of several votes; bagged decision trees (each on a bootstrap of the pages, every
    split on a third of the features) are trained on at most ``TRAINING_PAGES`` labelled pages and decide for all pages,
    whatever their votes. The trees weigh both kinds alike, so their odds are what the page itself tells; they are
    multiplied by the odds of the page's host, whose rate is the mean over all its pages, shrunk to the corpus rate. A
    NULL, empty or blank page scores 0 and counts in no rate; a NULL host is a host of its own.
    """
    pages = checkpointed(page_features(docs))
    read = _tree_scores(pages.where(F.size("votes") == len(VOTES))).select("doc_id", "host", "votes", "tree_score")
    rates = read.groupBy("host").agg(F.sum("tree_score").alias("s"), F.count(F.lit(1)).alias("n"))
    overall = rates.agg((F.sum("s") / F.sum("n")).alias("all"))
    odds = lambda p: F.log(F.greatest(F.least(p / (1 - F.least(p, F.lit(1 - 1e-9))), F.lit(SUREST)), F.lit(1 / SUREST)))
    shrunk = rates.crossJoin(overall).select("host", odds((F.col("s") + PRIOR_PAGES * F.col("all")) / (F.col("n") + PRIOR_PAGES)).alias("rate"), odds(F.col("all")).alias("base"))
    logit = odds(F.col("tree_score")) + HOST_WEIGHT * (F.col("rate") - F.col("base"))
    scored = read.join(shrunk, "host").select("doc_id", "host", "votes", "tree_score", (1 / (1 + F.exp(-logit))).alias("score"))
    blank = pages.where(F.size("votes") != len(VOTES)).select("doc_id", "host", "votes", F.lit(0.0).alias("tree_score"), F.lit(0.0).alias("score"))
    return scored.unionByName(blank)


def stuffed_pages(docs: DataFrame) -> DataFrame:
    """The ids of pages scored over a half."""
    return spam_scores(docs).where("score > 0.5").select("doc_id")
