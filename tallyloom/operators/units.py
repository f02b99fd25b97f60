"""Quantities recorded in different units and scales, converted to the unit each item is defined in."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyloom.functions.groups import map_groups, small
from tallyloom.functions.quantities import KINDS, read_quantity
from tallyloom.functions.spelling import item_name
from tallyloom.session import checkpointed

#: Powers of ten by which a silent source of each kind may be off: none, or any that a source of the kind may state.
FACTORS = {kind: tuple(sorted({0, *(power for _, power in words)})) for kind, words in KINDS.items()}
#: How near a level must lie to a factor, in powers of ten; one between factors tells nothing.
NEAR = 0.45
#: What a change costs: for a feed, whose weeks hold many readings and some strays, as much as a few strays by a
#: thousand; for one company's yearly counts as much as a shift by a tenfold.
FEED_PENALTY, PENALTY = 20.0, 1.0
#: The items that tell of a count: income over income per share.
IMPLIED = {"weighted_diluted_shares": ("net_income", "eps_diluted")}
#: Most rows of scales that are sent to all tasks; a larger table is joined by its keys.
BROADCAST_ROWS = 200_000


def changepoints(points: list[tuple[float, float]], penalty: float = PENALTY) -> list[int]:
    """Starts of the segments of (value, weight) points that minimise the weighted squared error plus ``penalty`` for
    each segment. Exact: optimal partitioning, with starts pruned that can no longer be best."""
    w, wx, wxx = [0.0], [0.0], [0.0]
    for x, n in points:
        w.append(w[-1] + n)
        wx.append(wx[-1] + n * x)
        wxx.append(wxx[-1] + n * x * x)

    def cost(i: int, j: int) -> float:
        n = w[j] - w[i]
        return max(0.0, wxx[j] - wxx[i] - (wx[j] - wx[i]) ** 2 / n)

    best, last, open_ = [-penalty], [0], [0]
    for j in range(1, len(points) + 1):
        total, start = min((best[i] + cost(i, j) + penalty, i) for i in open_)
        best.append(total)
        last.append(start)
        open_ = [i for i in open_ if best[i] + cost(i, j) <= total] + [j]
    starts, j = [], len(points)
    while j > 0:
        starts.append(j := last[j])
    return starts[::-1]


def _segments(points: list[tuple[float, float]], penalty: float = PENALTY) -> list[tuple[int, int, float, float]]:
    """(from, to, level, weight) of each segment."""
    starts = changepoints(points, penalty)
    out = []
    for a, b in zip(starts, [*starts[1:], len(points)], strict=True):
        n = sum(p[1] for p in points[a:b])
        out.append((a, b, sum(p[0] * p[1] for p in points[a:b]) / n, n))
    return out


def _factor(off: float, kind: str) -> int | None:
    near = min(FACTORS[kind], key=lambda f: abs(off - f))
    return near if abs(off - near) <= NEAR else None


def _median(values: list[float]) -> float:
    s = sorted(values)
    return s[len(s) // 2] if len(s) % 2 else (s[len(s) // 2 - 1] + s[len(s) // 2]) / 2


def _weighted_median(counts: dict[float, int]) -> float:
    """The median of values that each stand as often as counted, without spelling them out."""
    s, half, upto = sorted(counts.items()), sum(counts.values()) / 2, 0
    for i, (value, n) in enumerate(s):
        upto += n
        if upto > half:
            return value
        if upto == half:
            return (value + s[i + 1][0]) / 2
    raise ValueError("no values")


def _feed_powers(key: tuple, rows: list[tuple]) -> list[tuple]:
    """Rows are (feed, kind, week, off, n): how far the logs of a feed's silent numbers lie under the levels that others
    state for the same company, item and year. (feed, kind, after, until, power) of each segment of its weeks; the power is
    NULL where the segment's level is near no factor."""
    weeks = [(week, list(group)) for week, group in groupby(rows, key=lambda r: r[2])]
    points = []
    for _, group in weeks:
        n = sum(r[4] for r in group)
        points.append((sum(r[3] * r[4] for r in group) / n / 10, float(n)))
    out, before = [], None
    segments = _segments(points, FEED_PENALTY)
    for a, b, *_ in segments:
        counts: dict[float, int] = {}
        for r in (r for _, group in weeks[a:b] for r in group):
            counts[r[3] / 10] = counts.get(r[3] / 10, 0) + r[4]
        until = weeks[b - 1][0] if b < len(weeks) else None
        out.append((*key, before, until, _factor(_weighted_median(counts), key[1])))
        before = until
    return out


def _count_powers(key: tuple, rows: list[tuple]) -> list[tuple]:
    """Rows are (cik, item, year, level, said, n): one company's history of a count, levels in tenths of log10.
    said: 0 a silent number; 1 an amount stated with its scale; 2 one implied by other items."""
    silent = [(r[2], r[3] / 10, r[5]) for r in rows if r[4] == 0]
    counted = {said: {} for said in (1, 2)}
    for r in rows:
        if r[4]:
            year = counted[r[4]].setdefault(r[2], {})
            year[r[3] / 10] = year.get(r[3] / 10, 0) + r[5]
    known = {said: {y: _weighted_median(c) for y, c in counted[said].items()} for said in counted}
    everywhere = [v for said in (1, 2) for v in known[said].values()] if any(known.values()) else []
    out = []
    segments = _segments([(level, float(n)) for _, level, n in silent]) if silent else []
    top = max((s[2] for s in segments), default=0.0)
    for a, b, level, _ in segments:
        years = {y for y, *_ in silent[a:b]}
        here = next((v for said in (1, 2) if (v := [known[said][y] for y in years if y in known[said]])), everywhere)
        power = _factor((_median(here) if here else top) - level, "shares")
        out += [(*key, year, round(value * 10), power) for year, value, _ in silent[a:b]]
    return out


def _tenths(level):
    return F.round(level * 10).cast("int")


def stated(lines: DataFrame, specs: DataFrame) -> DataFrame:
    """``obs_id``, keys, ``kind`` (the item's unit), ``number`` and ``said``: the power of ten stated by the number's own
    text, else by ``unit``, else by ``caption``; NULL where the row is silent. An item without a spec has no ``kind`` and no ``said``."""
    spec = specs.select(item_name("item_key").alias("item"), F.col("unit").alias("kind")).dropDuplicates(["item"])
    rows = lines.select(
        "obs_id", F.coalesce("cik", F.lit(-1)).alias("cik"), item_name("item_key").alias("item"), F.coalesce("fiscal_year", F.lit(-1)).alias("year"), F.coalesce("feed", F.lit("")).alias("feed"),
        F.coalesce(F.date_format(F.date_trunc("week", "loaded_at"), "yyyy-MM-dd"), F.lit("")).alias("week"), "value", "value_text", "unit", "caption",
    )
    kept = ["obs_id", "cik", "item", "year", "feed", "week", "kind"]
    joined = rows.join(spec, "item", "left").select(*kept, "value", "value_text", "unit", "caption")
    out = T.StructType([joined.schema[c] for c in kept] + [T.StructField("number", T.DoubleType()), T.StructField("said", T.IntegerType())])
    arrow = to_arrow_schema(out)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [read_quantity(*row) for row in zip(*[b.column(c).to_pylist() for c in ("value", "value_text", "unit", "caption", "kind")], strict=True)]
            number, said = ([f[i] for f in found] for i in (0, 1))
            columns = [b.column(c).cast(arrow.field(c).type) for c in kept] + [pa.array(number, pa.float64()), pa.array(said, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return joined.mapInArrow(read, out).where(F.col("number").isNotNull())


def scale_powers(lines: DataFrame, specs: DataFrame, implied: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """``obs_id``, ``number`` and ``exp10``: number x 10^exp10 is the amount in the item's unit. One row per row with a number.

    A scale stated in the row holds. A silent row takes the scale of its source, found by segmenting the source's history
    of log values with an exact penalised changepoint search: for money, rates and per-share amounts the source is the
    feed, whose values are taken relative to the level that other rows state for the same company, item and year, as its
    rows are of companies of all sizes; for counts it is the company, whose own filing scale may change from year to year,
    its levels held against stated counts and those ``implied`` by one item over another. Levels that lie by a factor of
    the kind from the known ones are unit changes.

    Both histories are histograms (a row for each week or year and tenth of log10) made by partial aggregation, so a
    source's length is bounded by calendar and number range, however many rows it has. NULL keys are keys of their own;
    a source without any evidence counts as unscaled, one whose level is near no factor has a NULL ``exp10``. Rows without
    a number are left out.
    """
    implied = IMPLIED if implied is None else implied
    rows = checkpointed(stated(lines, specs))
    level = F.log10(F.abs("number"))
    usable = rows.where((F.col("number") != 0) & (F.abs("number") < 1e300) & F.col("kind").isin(*KINDS))
    keys = ["cik", "item", "year"]

    told = usable.where(F.col("said").isNotNull()).groupBy(*keys, _tenths(level + F.col("said")).alias("amount")).agg(F.count(F.lit(1)).alias("n"))
    reference = told.groupBy(*keys).agg(F.max_by("amount", F.struct("n", "amount")).alias("amount"))

    quiet = usable.where(F.col("said").isNull())
    by_feed = quiet.where(F.col("kind") != "shares").groupBy("feed", "kind", "week", *keys, _tenths(level).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    offsets = by_feed.join(reference, keys).groupBy("feed", "kind", "week", (F.col("amount") - F.col("level")).alias("off")).agg(F.sum("n").alias("n"))
    feeds = map_groups(offsets, ["feed", "kind"], ["week", "off"], _feed_powers, "feed STRING, kind STRING, after STRING, until STRING, power INT")

    from_feed = rows.alias("r").join(
        small(feeds, BROADCAST_ROWS).alias("f"),
        (F.col("r.feed") == F.col("f.feed"))
        & (F.col("r.kind") == F.col("f.kind"))
        & (F.col("f.after").isNull() | (F.col("r.week") > F.col("f.after")))
        & (F.col("f.until").isNull() | (F.col("r.week") <= F.col("f.until"))),
        "left",
    ).select("r.*", F.coalesce("r.said", "f.power").alias("known"), (F.col("r.said").isNull() & F.col("f.feed").isNotNull() & F.col("f.power").isNull()).alias("unclear"))

    counts = usable.where(F.col("kind") == "shares")
    histories = counts.groupBy(*keys, _tenths(level + F.coalesce("said", F.lit(0))).alias("level"), F.when(F.col("said").isNull(), 0).otherwise(1).alias("told")).agg(F.count(F.lit(1)).alias("n"))
    amount = F.log10(F.abs("number")) + F.col("known")
    for count, (whole, each) in implied.items():
        two = from_feed.where(F.col("item").isin(whole, each) & F.col("known").isNotNull() & (F.col("number") != 0) & (F.abs("number") < 1e300))
        ends = two.groupBy("cik", "year").agg(F.avg(F.when(F.col("item") == whole, amount)).alias("a"), F.avg(F.when(F.col("item") == each, amount)).alias("b"))
        ratio = ends.where("a is not null and b is not null").select("cik", F.lit(count).alias("item"), "year", _tenths(F.col("a") - F.col("b")).alias("level"), F.lit(2).alias("told"), F.lit(1).cast("bigint").alias("n"))
        histories = histories.unionByName(ratio)
    companies = map_groups(histories, ["cik", "item"], ["year", "level", "told"], _count_powers, "cik BIGINT, item STRING, year INT, level INT, power INT")
    silent_count = (F.col("kind") == "shares") & F.col("said").isNull() & (F.col("number") != 0)
    placed = from_feed.withColumn("level", F.when(silent_count, _tenths(level))).join(companies.select(*keys, "level", F.col("power").alias("of_company"), F.lit(True).alias("found")), [*keys, "level"], "left")
    unclear = F.col("unclear") | (F.col("found").isNotNull() & F.col("of_company").isNull())
    return placed.select("obs_id", "number", F.when(~unclear, F.coalesce("known", "of_company", F.lit(0))).cast("int").alias("exp10"))


def in_common_units(lines: DataFrame, specs: DataFrame) -> DataFrame:
    """Each row with a number, as an amount in its item's unit."""
    out = scale_powers(lines, specs)
    return out.select("obs_id", "number", "exp10", (F.col("number") * F.pow(F.lit(10.0), F.col("exp10"))).alias("amount"))
