"""Deeply nested JSON documents turned into related flat tables in one pass."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyloom.functions.groups import to_batch

TAGGED = T.StructType([T.StructField(c, T.StringType()) for c in ("table", "key", "parent", "payload")])

#: The schema that each table's payload gets. ``val_text`` keeps a value as it was written that is
#: no number, not finite, or a whole number that ``val`` can't hold to the digit.
TABLES = {
    "file": "file_id BIGINT, row_cik BIGINT, cik STRING, entity_name STRING, status STRING",
    "tag": "file_id BIGINT, taxonomy STRING, tag STRING, label STRING, description STRING",
    "unit": "file_id BIGINT, taxonomy STRING, tag STRING, unit STRING, n_entries INT",
    "entry": (
        "file_id BIGINT, taxonomy STRING, tag STRING, unit STRING, pos INT, `start` STRING, `end` STRING, val DOUBLE, "
        "val_text STRING, fy INT, fp STRING, form STRING, filed STRING, frame STRING, segments STRING"
    ),
}


def _text(x: object) -> str | None:
    return x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def _number(x: object) -> float | None:
    if isinstance(x, bool) or x is None:
        return None
    try:
        return float(x)
    except (TypeError, ValueError, OverflowError):
        return None


def _whole(x: object) -> int | None:
    n = _number(x)
    return int(n) if n is not None and n == n and abs(n) < 2**31 and n == int(n) else None


def _named(x: object, names: tuple[str, ...], inner: tuple[str, ...]) -> Iterator[tuple[object, object]]:
    """(name, body) pairs of a level, given as an object by name or as a list of objects that carry their name."""
    if isinstance(x, dict):
        yield from x.items()
    elif isinstance(x, list):
        for part in x:
            if isinstance(part, dict):
                name = next((part[n] for n in names if n in part), None)
                yield name, next((part[n] for n in inner if n in part), None) if inner else part


class _Visitor:
    """Depth-first walk over one payload; collects (table, key, parent, payload)."""

    def __init__(self, file_id: int, row_cik: int | None) -> None:
        self.file_id, self.row_cik, self.rows = file_id, row_cik, []
        self.seen: dict[str, int] = {}

    def emit(self, table: str, parent: str | None, name: str, body: dict) -> str:
        key = name if parent is None else f"{parent}/{name}"
        again = self.seen[key] = self.seen.get(key, -1) + 1
        key += f"#{again}" if again else ""
        self.rows.append((table, key, parent, json.dumps({"file_id": self.file_id} | body, ensure_ascii=False)))
        return key

    def file(self, text: str | None) -> None:
        status, whole = "ok", None
        if text is None or not text.strip():
            status = "empty"
        else:
            try:
                whole = json.loads(text.lstrip("﻿"))
                while isinstance(whole, str):
                    whole = json.loads(whole)
            except (ValueError, RecursionError):
                status, whole = "broken", None
        root = self.emit("file", None, str(self.file_id), {"row_cik": self.row_cik, "status": status} | self._head(whole))
        for company in self._companies(whole):
            for taxonomy, tags in _named(company["facts"], ("taxonomy", "name"), ("concepts", "tags")):
                for tag, body in _named(tags, ("tag", "concept", "name"), ()):
                    if isinstance(taxonomy, str) and isinstance(tag, str):
                        self.tag(root, taxonomy, tag, body if isinstance(body, dict) else {})

    def _companies(self, x: object) -> Iterator[dict]:
        """The objects that hold facts, whatever they are wrapped in; facts are not searched further."""
        if isinstance(x, str):
            try:
                x = json.loads(x)
            except (ValueError, RecursionError):
                return
        if isinstance(x, dict):
            if isinstance(x.get("facts"), (dict, list)):
                yield x
            elif isinstance(x.get("facts"), str) and "cik" in x:
                try:
                    yield from self._companies(x | {"facts": json.loads(x["facts"])})
                except (ValueError, RecursionError):
                    return
            else:
                for part in x.values():
                    if isinstance(part, (dict, list)):
                        yield from self._companies(part)
        elif isinstance(x, list):
            for part in x:
                yield from self._companies(part)

    def _head(self, whole: object) -> dict:
        first = next(self._companies(whole), whole if isinstance(whole, dict) else {})
        return {"cik": _text(first.get("cik")), "entity_name": _text(first.get("entityName"))}

    def tag(self, root: str, taxonomy: str, tag: str, body: dict) -> None:
        ids = {"taxonomy": taxonomy, "tag": tag}
        key = self.emit("tag", root, f"{taxonomy}:{tag}", ids | {"label": _text(body.get("label")), "description": _text(body.get("description"))})
        for unit, entries in _named(body.get("units"), ("unit", "name"), ("entries", "values", "facts")):
            if isinstance(unit, str):
                listed = entries if isinstance(entries, list) else [entries]
                found = [(pos, e) for pos, e in enumerate(listed) if isinstance(e, dict)]
                under = self.emit("unit", key, unit, ids | {"unit": unit, "n_entries": len(found)})
                for pos, e in found:
                    self.emit("entry", under, str(pos), ids | {"unit": unit, "pos": pos} | self._entry(e))

    def _entry(self, e: dict) -> dict:
        raw = e.get("val")
        val = _number(raw)
        plain = val is not None and abs(val) < 1e308 and (not isinstance(raw, int) or abs(raw) <= 2**53)  # NaN and infinities are not
        out = {c: _text(e.get(c)) for c in ("start", "end", "fp", "form", "filed", "frame", "segments")}
        return out | {"val": val if val is not None and abs(val) < 1e308 else None, "val_text": None if plain else _text(raw), "fy": _whole(e.get("fy"))}


def emit_tagged(files: DataFrame) -> DataFrame:
    """Rows (table, key, parent, payload) of every file, tag, unit and entry in ``companyfacts`` payloads.

    Each payload is read once, by a depth-first visitor inside its task; nothing is shuffled. Layouts and wrappings are
    followed wherever facts lie (objects by name, lists of named objects, envelopes, JSON within a JSON string). A
    payload that is NULL, empty or no whole JSON gives its file row only, with that status. An entry is an object; a
    NULL element counts in ``pos`` and gives no row; a lone object has ``pos`` 0. Keys are paths, so a child's
    ``parent`` is its parent's ``key``; a name that occurs twice within a parent gets ``#1`` and so on. A NULL
    ``file_id`` is kept. Other columns, whatever their names, are not read.
    """
    arrow = to_arrow_schema(TAGGED)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for file_id, cik, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                one = _Visitor(file_id, cik)
                one.file(text)
                rows += one.rows
                if len(rows) > 20_000:
                    yield to_batch(rows, arrow)
                    rows = []
            yield to_batch(rows, arrow)

    return files.select("file_id", "cik", "payload").mapInArrow(visit, TAGGED)


def with_schema(tagged: DataFrame, name: str) -> DataFrame:
    """One table of the tagged rows with its own columns, and ``key`` and ``parent`` to link it."""
    return tagged.where(F.col("table") == name).select("key", "parent", F.from_json("payload", TABLES[name]).alias("p")).select("key", "parent", "p.*")


def write_tagged(tagged: DataFrame, path: str) -> str:
    """Write all tables in one pass, partitioned by their tag."""
    tagged.write.mode("overwrite").partitionBy("table").parquet(path)
    return path


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One flat table of what ``write_tagged`` wrote; only its partition is read."""
    return with_schema(spark.read.schema(TAGGED).parquet(path), name)
