"""Figures written for readers, and read back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a number is written in a text, and the suffixes of scales.
NUMBER = r"\$?\d[\d,]*(?:\.\d+)?[%BMKTbmkt]?"
SUFFIXES = [(1e9, "B"), (1e6, "M"), (1e3, "K")]


def format_figure(value: Column, unit: Column | str) -> Column:
    """``$391.04B``, ``-$1.23B``, ``15.55B shares``, ``$6.42``: the suffix is chosen before rounding, per-share amounts get none."""
    unit = F.lit(unit) if isinstance(unit, str) else unit
    size = F.abs(value)
    scaled = F.lit(None).cast("string")
    for least, letter in reversed(SUFFIXES):
        scaled = F.when(size >= least, F.concat(F.format_number(size / least, 2), F.lit(letter))).otherwise(F.coalesce(scaled, F.format_number(size, 2)))
    plain = F.format_number(size, 2)
    body = F.when(unit == "USD/shares", F.concat(F.lit("$"), plain)).when(unit == "shares", F.concat(scaled, F.lit(" shares"))).otherwise(F.concat(F.lit("$"), scaled))
    return F.when(value.isNotNull(), F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), body))


def parse_figure(text: Column) -> Column:
    """The number a figure stands for: signs as ``-`` or parentheses, K, M, B, T and ``%``; NULL where it is none."""
    s = F.regexp_replace(F.trim(text), r"[−–]", "-")
    pattern = r"^(\()?(-)?\$?(\d[\d,]*(?:\.\d+)?)([KMBT%]?)(\))?(?: shares)?$"
    part = lambda i: F.regexp_extract(s, pattern, i)
    scale = F.when(part(4) == "K", 1e3).when(part(4) == "M", 1e6).when(part(4) == "B", 1e9).when(part(4) == "T", 1e12).otherwise(1.0)
    number = F.regexp_replace(part(3), ",", "").try_cast("double") * scale
    negative = (part(2) == "-") | (part(1) == "(")
    return F.when(s.rlike(pattern), F.when(negative, -number).otherwise(number))


def number_tokens(text: Column) -> Column:
    """Every number as it is written in a text."""
    return F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1))
