"""Ranked retrieval for many queries at once: BM25, vector similarity, fusion, thresholds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyloom.functions.groups import to_batch
from tallyloom.functions.text import words

Embed = Callable[[Column], Column]
Rerank = Callable[[Column, Column], Column]

K1, B, EPSILON = 1.5, 0.75, 0.25
FUSION_K, POOL, FINAL = 60, 18, 6


def _said(docs: DataFrame, text: str, wanted: DataFrame | None) -> DataFrame:
    """(``doc_id``, ``term``) of every word; with ``wanted`` (``term``, of stated queries) of those words only, which are
    kept where the text is read, before anything is counted or shuffled."""
    said = docs.select("doc_id", F.explode(words(F.col(text))).alias("term"))
    return said if wanted is None else said.join(F.broadcast(wanted.select("term").distinct()), "term", "left_semi")


def term_counts(docs: DataFrame, text: str = "text", wanted: DataFrame | None = None) -> DataFrame:
    """(``doc_id``, ``term``, ``tf``), of the ``wanted`` terms if there are any stated."""
    return _said(docs, text, wanted).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def known_terms(docs: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """The ``wanted`` terms that occur in any text."""
    return _said(docs, text, wanted).select("term").distinct()


def bm25(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(``query_id``, ``doc_id``, ``score``, ``rank``) of the best ``k`` documents with a positive score for each query.

    Okapi with k1 1.5 and b 0.75; a negative idf becomes a quarter of the mean idf; a query's repeated words count each
    time. Statistics cover all documents and words, combined before the shuffle; the words of a document are cut to the
    queries' before they are counted and shuffled. Scores are rounded to 9 places before ranking, ties go to the lower
    id; repeated rows count as one longer document's words.
    """
    cut = docs.select("doc_id", words(F.coalesce("text", F.lit(""))).alias("w"))
    corpus = cut.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("w")).alias("avgdl"))
    df = cut.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(corpus.select("n"))
    idf = df.withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = idf.agg((F.avg("idf") * EPSILON).alias("floor"))
    asked = queries.select("query_id", F.explode(words(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    terms = idf.join(asked, "term").crossJoin(mean).select("query_id", "term", "times", F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf")).alias("idf"))
    said = cut.select("doc_id", F.size("w").alias("dl"), F.explode("w").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    tf = said.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    hits = tf.join(terms, "term").crossJoin(corpus.select("avgdl"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scores = hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 9).alias("score")).where("score > 0")
    return top(scores, k)


def top(scores: DataFrame, k: int, keys: tuple[str, ...] = ("query_id",), item: str = "doc_id") -> DataFrame:
    """The best ``k`` rows of each key by score, then the lower item; none for ``k`` of 0 or less."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col(item))
    return scores.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= max(k, 0))


def _block(rows: pa.Scalar) -> tuple[list, np.ndarray]:
    """Ids and vectors of a block, the vectors read from their buffer as one matrix."""
    each = rows.values
    vectors = each.field("v")
    return each.field("i").to_pylist(), vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, squared: bool = False, block: int = 1024) -> DataFrame:
    """(``query_id``, ``doc_id``, ``score``, ``rank``): exact best ``k`` of all vectors for each query vector, by cosine or by
    1 / (1 + squared distance); ties go to the lower id. A query without length scores 0 everywhere.

    Both sides have ``vec_id`` and ``embedding``. They are put in blocks by id hash, about ``block`` rows each, and every pair
    of blocks is one matrix product that gives its best ``k`` per query; only those are shuffled. NULL vectors are left out.
    """

    def blocks(df: DataFrame, name: str) -> DataFrame:
        some = df.where("embedding is not null")
        n = max(1, -(-some.count() // block))
        each = F.struct(F.col("vec_id").alias("i"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
        return some.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias(f"{name}_block")).agg(F.collect_list(each).alias(name))

    out = T.StructType([T.StructField("query_id", queries.schema["vec_id"].dataType), T.StructField("doc_id", vectors.schema["vec_id"].dataType), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(out)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, d in zip(batch.column("q"), batch.column("d"), strict=True):
                (asked, a), (ids, b) = _block(q), _block(d)
                product = a @ b.T
                if squared:
                    score = 1.0 / (1.0 + np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * product, 0.0))
                else:
                    norm = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :]
                    score = np.divide(product, norm, out=np.zeros_like(product), where=norm > 0)
                score = np.round(score, 6)
                named = np.array(ids)
                rows = [(asked[r], ids[c], float(score[r, c])) for r in range(len(asked)) for c in np.lexsort((named, -score[r]))[: max(k, 0)]]
                yield to_batch(rows, arrow)

    pairs = blocks(queries, "q").crossJoin(blocks(vectors, "d")).select("q", "d")
    return top(pairs.mapInArrow(best, out), k)


def hash_embedding(text: Column) -> Column:
    """A stand-in for an embedding model: 16 numbers from 0 to 1, the first bytes of the text's digest."""
    digest = F.sha2(text, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(F.substr(digest, 2 * i + 1, F.lit(2)), 16, 10).cast("double") / 255)


def shared_words(query: Column, text: Column) -> Column:
    """A stand-in for a reranking model: the share of the query's words that the text holds."""
    asked = F.array_distinct(words(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, words(text))), F.size(asked)), F.lit(0.0))


def hybrid(chunks: DataFrame, queries: DataFrame, embed: Embed = hash_embedding, rerank: Rerank | None = None, least_fused: float = 0.0, least_reranked: float = 0.0, k: int = 20) -> DataFrame:
    """(``query_id``, ``doc_id``, ``score``, ``rank``, ``scored_by``, ``text``): the final few chunks of each query.

    Words and vectors rank the chunks (``doc_id``, ``text``) for the stated ``queries`` (``query_id``, ``query``); the rankings
    are fused and cut to the pool, which ``rerank`` scores anew if there is one; what scores less than the limit of the
    scale it is scored by is dropped. ``embed`` and ``rerank`` are expressions, or Pandas UDFs around a model. Chunks
    without text are in no ranking."""
    told = chunks.where("text is not null").select("doc_id", "text")
    by_vector = nearest(told.select(F.col("doc_id").alias("vec_id"), embed(F.col("text")).alias("embedding")), queries.select(F.col("query_id").alias("vec_id"), embed(F.col("query")).alias("embedding")), k)
    lists = bm25(told, queries, k).select("query_id", F.lit(0).alias("list_id"), "doc_id", "rank").unionByName(by_vector.select("query_id", F.lit(1).alias("list_id"), "doc_id", "rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("first"), F.col("doc_id"))
    pool = fuse(lists).withColumn("at", F.row_number().over(order)).where(F.col("at") <= POOL)
    rows = pool.join(told, "doc_id").join(F.broadcast(queries.select("query_id", "query")), "query_id")  # the pool's rows alone
    scored = rows.withColumn("score", F.round(rerank(F.col("query"), F.col("text")), 9)) if rerank else rows
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("at"))
    kept = scored.where(F.col("score") >= (least_reranked if rerank else least_fused)).withColumn("rank", F.row_number().over(last).cast("bigint")).where(F.col("rank") <= FINAL)
    return kept.select("query_id", "doc_id", "score", "rank", F.lit("rerank" if rerank else "rrf").alias("scored_by"), "text")


def fuse(rankings: DataFrame, k: int = FUSION_K) -> DataFrame:
    """Reciprocal rank fusion of rows (``query_id``, ``list_id``, ``doc_id``, ``rank``); ties go to the document seen first."""
    first = F.min(F.struct("list_id", "rank"))
    return rankings.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score"), first.alias("first"))


def retrieve(rankings: DataFrame, least: float, pool: int = POOL, final: int = FINAL, k: int = FUSION_K) -> DataFrame:
    """Fused, cut to the pool, then to those that score ``least``, then to the final few."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("first"), F.col("doc_id"))
    ranked = fuse(rankings, k).withColumn("rank", F.row_number().over(w).cast("bigint"))
    return ranked.where((F.col("rank") <= pool) & (F.col("score") >= least) & (F.col("rank") <= final)).select("query_id", "doc_id", "score", "rank")
