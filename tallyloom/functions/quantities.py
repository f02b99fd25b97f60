"""Numbers, and the units and scales stated beside them, read from a row's text columns.

The patterns are plain Python, run on Arrow batches inside tasks: as Spark expressions they outgrow what the JVM compiles
into one method, and fall back to interpretation.
"""

from __future__ import annotations

import re
from functools import lru_cache

# How sources write a power of ten beside an amount. First match wins.
MONEY = [
    (r"cent|¢|^usc$|\busc\b", -2),
    (r"lakh", 5),
    (r"crore", 7),
    (r"billion|milliard|\bmrd|\bbn\b|\bb\b|\bbusd\b|\busdb\b|usd_b\b|usdbn\b", 9),
    (r"million|millones|\bmio|\bmn\b|\bmm\b|\bm\b|\bmusd\b|\busdm\b|usd_m\b|usdmn\b", 6),
    (r"thousand|tausend|\bmille\b|milliers|\bmiles\b|\btsd|\bk\b|\bkusd\b|\btusd\b|\busdk\b|usd_k\b|\b0?00s?\b|1[,.]?000", 3),
]
SHARES = [
    (r"\blots?\b", 2),
    (r"billion|\bbn\b|\bmrd", 9),
    (r"million|millones|\bmio|\bmn\b|\bmm\b|\bm\b", 6),
    (r"thousand|tausend|\bmille\b|milliers|\bmiles\b|\btsd|\bk\b|\b0?00s?\b|1[,.]?000", 3),
]
PER_SHARE = [
    (r"(?:/|per) ?(?:thousand|1[,.]?000|k\b|tsd)", -3),
    (r"cent|¢|\busc\b|\bc\b", -2),
]
PURE = [
    (r"basis|\bbps?\b", -4),
    (r"per ?mille|permille|‰", -3),
    (r"per ?cent|percent|\bpct\b|%", -2),
]
SIZES = [(r"billion|milliard|\bmrd", 9), (r"million|millones|\bmio|\bmn\b", 6), (r"thousand|tausend|milliers|\bmiles\b|\btsd", 3)]
KINDS = {"USD": MONEY, "shares": SHARES, "USD/shares": PER_SHARE, "pure": PURE}

#: Captions that name a power of ten without stating the scale of the numbers, and those that deny one.
BESIDE = r"nearest|contracts?\b|\bnote \d"
WHOLE = r"whole|not scaled|not in (?:thousand|million)|full amounts|unscaled|actual (?:amounts|dollars)"


def _first(text: str, words: list[tuple[str, int]]) -> int | None:
    return next((power for pattern, power in words if re.search(pattern, text)), None)


def _spaced(text: str) -> str:
    """Lower case, with a blank between a digit or dollar sign and a letter so that words can be told apart."""
    return re.sub(r"\s+", " ", re.sub(r"(?<=[\d$])(?=[^\W\d_])", " ", text.strip().lower()))


@lru_cache(20_000)
def unit_power(unit: str, kind: str) -> int | None:
    """The power of ten that a unit states; None where it names the measure alone."""
    return _first(_spaced(re.sub(r"[()]", " ", unit)), KINDS.get(kind, []))


@lru_cache(20_000)
def caption_power(caption: str, kind: str) -> int | None:
    """The power of ten that a table caption states for a kind of measure; None where it states none for it."""
    c = re.sub(r"\s+", " ", re.sub(r"\$ ?0?00s?\b", " thousand ", caption.lower().strip()))
    if kind == "USD/shares":
        return 0 if "per share" in c else None
    if kind not in ("USD", "shares") or re.search(BESIDE, c):
        return None
    if re.search(WHOLE, c):
        return 0
    if kind == "USD":
        return _first(c, SIZES)
    m = re.search(r"(?:except shares? which (?:are|is)|share counts?|and shares|^shares|share amounts) (?:are )?in (\w+)", c)
    return _first(m[1], SIZES) if m else 0 if re.search(r"except (?:for )?(?:number of )?shares?\b(?! amounts)", c) else None


def text_power(text: str, kind: str) -> int | None:
    """The power of ten stated in the words around a number; 0 where a currency or share word stands alone."""
    words = re.sub(r"[-−–(]*\d[\d.,'\s]*\)?", " ", _spaced(text))
    words = re.sub(r"\bus ?dollars?\b|\bus ?\$|\$|\busd?\b", " usd ", words).strip()
    power = _first(words, KINDS.get(kind, []))
    return power if power is not None else 0 if words and kind in KINDS else None


def text_number(text: str) -> float | None:
    """The number written in a text, its sign, grouping and decimal mark told from its form; None where there is none.

    The later of two kinds of mark is the decimal one; a mark that occurs twice groups. A single mark before exactly
    three last digits groups, unless a power of ten above a thousand follows or only ``0`` stands before it.
    """
    m = re.search(r"\d[\d.,'\s]*", text)
    if not m:
        return None
    s = re.sub(r"[\s']|[.,]+\s*$", "", m[0])
    large = re.search(r"million|millones|mio|\d\)? ?mn|\d\)? ?mm?\b|billion|\d\)? ?bn|\d\)? ?b\b|mrd|crore|lakh", text.lower())
    if re.fullmatch(r"\d+(?:,\d{3}){2,}|\d+(?:\.\d{3}){2,}", s) or (re.fullmatch(r"[1-9]\d{0,2}[.,]\d{3}", s) and not large):
        s = re.sub(r"[.,]", "", s)
    try:
        number = float(re.sub(r"[.,](?=.*[.,])", "", s).replace(",", "."))
    except ValueError:
        return None
    return -number if re.search(r"\(\s*[^\d()]{0,4}\d[\d.,\s]*\)|[-−–]\s*[^\d\s]{0,3}\s?\d", text) else number


def read_quantity(value: float | None, text: str | None, unit: str | None, caption: str | None, kind: str | None) -> tuple[float | None, int | None]:
    """(number, power of ten stated). The text counts only where ``value`` is missing or NaN; its own scale comes before
    the unit's, the unit's before the caption's. No kind: no power."""
    said = None
    if value is None or value != value:
        value = text_number(text) if text else None
        said = text_power(text, kind) if value is not None and kind else None
    if value is None or not kind:
        return value, said
    if said is None and unit:
        said = unit_power(unit, kind)
    if said is None and caption:
        said = caption_power(caption, kind)
    return value, said
