"""Texts over a size limit cut into overlapping pieces at natural places."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyloom.functions.groups import to_batch
from tallyloom.llm.places import natural_places

CHARS = 4  # a token is counted as four code points


def _cut(text: str, low: int, high: int, offsets: list[int], strength: list[int], most: int) -> int:
    """The strongest place near the middle of text[low:high], else the nearest one anywhere in it; where it has none, a
    blank near the middle, else the middle itself."""
    mid, reach = (low + high) // 2, (high - low) // 4
    a, b = bisect_left(offsets, max(mid - reach, low + 1)), bisect_right(offsets, min(mid + reach, high - 1))
    if a < b:
        return offsets[max(range(a, b), key=lambda i: (strength[i], -abs(offsets[i] - mid)))]
    # None lies in the window, so those on either side of it are the only ones left.
    if beside := [offsets[i] for i in (a - 1, a) if 0 <= i < len(offsets) and low < offsets[i] < high]:
        return min(beside, key=lambda o: abs(o - mid))
    near = max(1, min(reach, most // 4))
    right = next((i + 1 for i in range(mid, min(mid + near, high - 1)) if text[i].isspace()), None)
    left = text.rfind(" ", max(low + 1, mid - near), mid)
    choices = [c for c in (right, left + 1 if left > low else None) if c is not None and low < c < high]
    return min(choices, key=lambda c: abs(c - mid)) if choices else mid


def bisected(text: str, target: int, overlap: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The places a text over ``target`` tokens is bisected over, as (offset, strength), and the (start, end) of its pieces;
    a smaller one has no such places and is one piece.

    Recursive bisection: a range over the limit less the overlap is cut at the strongest natural place near its middle,
    or at the nearest one, each part likewise; only a stretch without any is cut within. Then each piece but the first is
    begun about ``overlap`` tokens earlier, at a natural place or a blank. No piece exceeds the limit and every code point
    lies in one. An overlap over half the limit counts as half.
    """
    most = CHARS * target + CHARS - 1
    if len(text) // CHARS <= target or target <= 0:
        return [], [(0, len(text))]
    shared = max(0, min(CHARS * overlap, most // 2))
    limit = max(1, most - shared)
    places = natural_places(text)
    offsets, strength = [o for o, _ in places], [s for _, s in places]
    leaves, todo = [], [(0, len(text))]
    while todo:
        low, high = todo.pop()
        if high - low <= limit:
            leaves.append((low, high))
        else:
            at = _cut(text, low, high, offsets, strength, most)
            todo += [(at, high), (low, at)]
    out = [leaves[0]]
    for low, high in leaves[1:]:
        begin = max(0, low - shared)
        if shared:
            a, b = bisect_left(offsets, begin), bisect_right(offsets, low - shared // 2)
            if a < b:
                begin = offsets[a]
            else:
                blank = next((i + 1 for i in range(begin, low) if text[i].isspace()), begin)
                begin = blank if blank < low else begin
        out.append((min(low, max(begin, out[-1][0] + 1)), high))
    return places, out


def split_text(text: str, target: int, overlap: int) -> list[tuple[int, int]]:
    return bisected(text, target, overlap)[1]


def with_limits(docs: DataFrame, settings: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, ``target`` and ``overlap`` of every document. NULL or unknown settings mean ``default``;
    where there is no such row either, 800 and 100."""
    s = settings.dropDuplicates(["settings_id"]).select("settings_id", F.col("chunk_target_tokens").alias("t"), F.col("chunk_overlap_tokens").alias("o"))
    default = s.where("settings_id = 'default'").agg(F.coalesce(F.max("t"), F.lit(800)).alias("dt"), F.coalesce(F.max("o"), F.lit(100)).alias("do"))
    return docs.select("doc_id", "text", "settings_id").join(s, "settings_id", "left").crossJoin(default).select("doc_id", "text", F.coalesce("t", "dt").alias("target"), F.coalesce("o", "do").alias("overlap"))


def _oversized(docs: DataFrame, settings: DataFrame) -> DataFrame:
    return with_limits(docs, settings).where(F.floor(F.length("text") / CHARS) > F.col("target"))


def _per_text(df: DataFrame, f, schema: T.StructType) -> DataFrame:
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text, target, overlap in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows.extend((doc_id, *r) for r in f(text, target, overlap))
                if len(rows) > 5_000:
                    yield to_batch(rows, arrow)
                    rows = []
            yield to_batch(rows, arrow)

    return df.select("doc_id", "text", "target", "overlap").mapInArrow(run, schema)


def visited(docs: DataFrame, texts: bool = True) -> DataFrame:
    """One visit of each text of ``with_limits``: (``doc_id``, ``piece``, ``start_char``, ``end_char``,
    ``strength``, ``text``). A place that the text is bisected over has its ``strength`` and no ``piece``; a piece has its
    number, its end and, if ``texts`` are asked for, its text. A NULL text is one piece without a text."""
    types = {"doc_id": T.LongType(), "piece": T.IntegerType(), "start_char": T.LongType(), "end_char": T.LongType(), "strength": T.IntegerType(), "text": T.StringType()}
    schema = T.StructType([T.StructField(c, t) for c, t in types.items()])

    def rows(text: str | None, target: int, overlap: int) -> Iterator[tuple]:
        if text is None:
            yield (0, 0, 0, None, None)
            return
        places, pieces = bisected(text, target, overlap)
        for at, strength in places:
            yield (None, at, None, strength, None)
        for i, (a, b) in enumerate(pieces):
            yield (i, a, b, None, text[a:b] if texts else None)

    return _per_text(docs, rows, schema)


def cut_places(docs: DataFrame, settings: DataFrame) -> DataFrame:
    """(``doc_id``, ``start_char``, ``strength``): the natural places that every document over its limit is bisected over. A
    NULL or empty text has none."""
    return visited(_oversized(docs, settings), texts=False).where("piece is null").select("doc_id", "start_char", "strength")


def split_oversized(docs: DataFrame, settings: DataFrame) -> DataFrame:
    """(``doc_id``, ``piece``, ``start_char``, ``end_char``, ``text``): the pieces of every document, one piece where it
    is within its limit; a NULL or empty text gives one piece with that text. Work is per text, inside tasks, without a
    shuffle; repeated rows give repeated pieces."""
    return visited(with_limits(docs, settings)).where("piece is not null").drop("strength")
