"""Bitemporal history of changing attributes, built from snapshots that arrive late, twice or out of order."""

from __future__ import annotations

import datetime as dt
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyloom.functions.groups import to_batch
from tallyloom.functions.spelling import item_name, iso_text, real_date

OPEN_END = dt.date(9999, 12, 31)
UNKNOWN = "0001-01-01"


class _Sweep:
    """Beliefs about one entity while its records are swept in the order in which they became known.

    ``valid`` holds the known valid dates in order and ``state`` what stands at each. ``start`` holds the dates at which
    a version begins, ``since`` the day from which that version, with its present end, has been believed.
    """

    def __init__(self) -> None:
        self.valid: list[dt.date] = []
        self.state: list[tuple] = []
        self.start: list[dt.date] = []
        self.since: list[tuple[dt.date, tuple]] = []

    def _end(self, i: int) -> dt.date:
        return self.start[i + 1] if i + 1 < len(self.start) else OPEN_END

    def _begins(self, i: int) -> bool:
        return i == 0 or self.state[i - 1] != self.state[i]

    def record(self, valid: dt.date, state: tuple, day: dt.date) -> list[tuple]:
        """Learn on ``day`` that ``state`` stood at ``valid``; gives back the rows that this supersedes."""
        i = bisect_left(self.valid, valid)
        if i < len(self.valid) and self.valid[i] == valid:
            if self.state[i] == state:
                return []
            self.state[i] = state
        else:
            self.valid.insert(i, valid)
            self.state.insert(i, state)
        # Only what begins here or at the next date can change, and so the end of the version before.
        touched = [i] + ([i + 1] if i + 1 < len(self.valid) else [])
        low = max(0, bisect_right(self.start, valid) - 1)
        if low < len(self.start) and self.start[low] == valid:
            low = max(0, low - 1)
        high = bisect_right(self.start, self.valid[touched[-1]])
        before = [(self.start[k], self._end(k), *self.since[k]) for k in range(low, high)]
        starts = {s for s, *_ in before}
        for k in touched:
            (starts.add if self._begins(k) else starts.discard)(self.valid[k])
        after = sorted(starts)
        stop = self.start[high] if high < len(self.start) else OPEN_END
        known = {(s, e, st): since for s, e, since, st in before}
        rows = [(s, e, self.state[bisect_left(self.valid, s)]) for s, e in zip(after, [*after[1:], stop], strict=True)]
        self.start[low:high] = after
        self.since[low:high] = [(known.pop((s, e, st), day), st) for s, e, st in rows]
        return [(s, e, st, since, day) for (s, e, st), since in known.items() if since != day]

    def standing(self) -> list[tuple]:
        return [(s, self._end(k), st, since, None) for k, s in enumerate(self.start) for since, st in [self.since[k]]]


def _comparable(x: object) -> object:
    return "NaN" if isinstance(x, float) and x != x else x


def bitemporal_ledger(
    df: DataFrame,
    keys: dict[str, Column],
    valid: Column,
    recorded: Column,
    tie: Column,
    state: list[str],
) -> DataFrame:
    """One row per belief about a version: keys, ``valid_from``, ``valid_to``, the state columns, ``recorded_from`` and
    ``recorded_to`` (NULL while the belief stands; days).

    A version starts at the first valid date and at each whose state differs from that of the date before; it ends where
    the next starts, or at 9999-12-31. A late or corrected record splits or joins the intervals it overlaps: their rows
    are closed with the day it came, never overwritten. Of several records of one valid date and one recording day the
    last recorded stands, then the highest ``tie``. A NULL state (NaN likewise) is a state like any other; rows without
    a valid date are left out; a NULL recording time counts as the earliest; NULL keys form an entity of their own.
    Input columns that aren't named do not matter, whatever their names.

    Repeats are collapsed by (entity, valid date, recording day) with partial aggregation before the shuffle by entity,
    so the rows of an entity are bounded by the calendar, not by how often a snapshot was repeated; the sweep streams
    over sorted rows and holds one entity's dates at a time.
    """
    names = list(keys)
    last = F.struct(recorded.alias("r"), tie.alias("t"), *[F.col(c).alias(f"s{i}") for i, c in enumerate(state)])
    day = F.coalesce(recorded.cast("date"), F.lit(UNKNOWN).cast("date"))
    slim = (
        df.select(*[e.alias(f"k{i}") for i, e in enumerate(keys.values())], valid.alias("v"), day.alias("d"), last.alias("z"))
        .where(F.col("v").isNotNull())
        .groupBy(*[f"k{i}" for i in range(len(names))], "v", "d")
        .agg(F.max("z").alias("z"))
    )
    ks = [f"k{i}" for i in range(len(names))]
    slim = slim.select(*ks, "v", "d", *[F.col(f"z.s{i}").alias(f"s{i}") for i in range(len(state))])
    swept = slim.repartition(*ks).sortWithinPartitions(*ks, "d", "v")
    out = T.StructType(
        [T.StructField(n, slim.schema[f"k{i}"].dataType) for i, n in enumerate(names)]
        + [T.StructField("valid_from", T.DateType()), T.StructField("valid_to", T.DateType())]
        + [T.StructField(c, slim.schema[f"s{i}"].dataType) for i, c in enumerate(state)]
        + [T.StructField("recorded_from", T.DateType()), T.StructField("recorded_to", T.DateType())]
    )
    n_keys, arrow = len(names), to_arrow_schema(out)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, beliefs, raw, rows = None, _Sweep(), {}, []

        def add(found: list[tuple]) -> None:
            rows.extend((*key, s, e, *raw[st], a, b) for s, e, st, a, b in found)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:n_keys] != key:
                    if key is not None:
                        add(beliefs.standing())
                    key, beliefs, raw = row[:n_keys], _Sweep(), {}
                values = row[n_keys + 2 :]
                mark = tuple(map(_comparable, values))
                raw.setdefault(mark, values)
                add(beliefs.record(row[n_keys], mark, row[n_keys + 1]))
            if len(rows) > 20_000:
                yield to_batch(rows, arrow)
                rows.clear()
        if key is not None:
            add(beliefs.standing())
        yield to_batch(rows, arrow)

    return swept.mapInArrow(sweep, out)


def resolved_value_ledger(resolved: DataFrame) -> DataFrame:
    """The ledger of ``resolved_value``: entity (segment, item, period end), valid by filing date, recorded by load day.
    A period end that is no real date keeps its own text, trimmed."""
    r = resolved.select("segment_id", "item_key", "period_end", "filed", "loaded_at", "snapshot_id", "value", "fiscal_year", "restated")
    return bitemporal_ledger(
        r,
        {"segment_id": F.col("segment_id"), "item_key": item_name("item_key"), "period_end": F.coalesce(iso_text("period_end"), F.trim("period_end"))},
        valid=real_date("filed"),
        recorded=F.col("loaded_at"),
        tie=F.col("snapshot_id"),
        state=["value", "fiscal_year", "restated"],
    )
