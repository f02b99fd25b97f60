"""Where a text may naturally be cut: starts of sentences, headings, list items, table rows and paragraphs."""

from __future__ import annotations

import re
from itertools import pairwise

TEXT, BLOCK, LINE, SENTENCE = 4, 3, 2, 1

# Abbreviations that do not end a sentence, in the languages of the corpus, lower case, without the stop.
ABBREVIATIONS = frozenset(
    "vs approx est ca circa exh fig figs art arts sec sect no nos nr pp p para paras par ch chap vol ed eds vgl anm abs abb kap tz ziff "
    "cf env aprox mr mrs ms dr prof st incl excl inkl exkl bzw ggf rd tsd mio mrd núm num pág págs véase sr sra ej ex usw "
    "jan feb mar apr jun jul aug sep sept oct nov dec mär okt dez janv févr avr juil déc ene abr ago dic viz ff ref refs dept gov rev".split()
)
MONTHS = frozenset(
    "januar februar märz april mai juni juli august september oktober november dezember jan feb mär apr jun jul aug sep sept okt nov dez".split()
)
MARK = re.compile(r"\s*(?:[-•*–—‣·◦▪►»>#]+|\(?[0-9]{1,3}(?:\.[0-9]{1,3})*[.)]|\(?[a-zA-Z][.)]|\(?[ivxIVX]{1,5}[.)])(?=\s)")
NUMBERED_TITLE = re.compile(r"\s*(?:note|item|part|section|chapter|article|anmerkung|abschnitt|teil|ziffer|nota|parte|sección|artículo|partie|annexe)\s+(?:\d+[a-z]?|[ivx]+)\.(?=\s)", re.IGNORECASE)
TABULAR = re.compile(r"\S {3,}\S|\S *\.{4,} *\d|\|.*\||\t.*\t")
GAP = re.compile(r" {3,}|\.{4,}|[ ]*[|\t][ |\t]*")
#: Gaps further apart than this on average, in columns, do not make a line with sentences in it a table row.
LONGEST_CELL = 30
WIDE = re.compile(r"[\u3000-\u9fff\uff00-\uff60]")
STOP = re.compile(r"([.!?…]+)((?:[)\]\"”’'»]|[   ]»)*)(\s*)(?=\S)|[。！？]+[」』）)]*(\s*)(?=\S)")
OPENERS = "([{\"“„«'‘¡¿$€£"
ENDED = re.compile(r"[.!?。！？…][)\]\"”’'»」』）]*\s*$")
#: Shorter lines are not taken as wrapped prose.
SHORTEST_WRAP = 25
SHORTENED = re.compile(rf"(?:^|[\s(])(?:[^\W\d_]|{'|'.join(sorted(ABBREVIATIONS))})\.\s*$", re.IGNORECASE)
BLANKS = " \t\r\x0b\x0c    ​﻿"


def _starts_sentence(c: str, after: str) -> bool:
    # A name such as "eVelora" begins a sentence too.
    return c.isupper() or (c.islower() and after.isupper()) or c.isdigit() or c in OPENERS or (c.isalpha() and not c.islower() and not c.isupper()) or (c in "-−–" and after.isdigit())


def _sentences(text: str, low: int, high: int, found: dict[int, int]) -> None:
    """Starts of the sentences after the first within text[low:high]."""
    for m in STOP.finditer(text, low, high):
        at = m.end()
        if at >= high:
            break
        c, after = text[at], text[at + 1 : at + 2]
        if m[1] is None:  # a full-width stop needs no blank
            found.setdefault(at, SENTENCE)
            continue
        gap = m[3]
        begin = m.start()
        while begin > low and not text[begin - 1].isspace():
            begin -= 1
        word = text[begin : m.start()].strip("([{\"“„«'‘¡¿)]}”’»")
        if not gap:
            # A lost blank: the stop follows a word or number and a capitalised word follows it.
            before = text[m.start() - 1 : m.start()]
            if not (c.isupper() or c in "¡¿«(") or "/" in word or "@" in word:
                continue
            if not (before.islower() or before.isdigit() or before in ")%$”»") or (after and not (after.islower() or after.isspace() or c in "¡¿«(")):
                continue
            if m[1] == "." and (len(word) == 1 or word.lower() in ABBREVIATIONS):
                continue
            found.setdefault(at, SENTENCE)
            continue
        if not _starts_sentence(c, after):
            continue
        if set(m[1]) == {"."} and not m[2]:
            if len(m[1]) > 3 or (word == "" and len(m[1]) > 1):
                continue
            bare = word.lower()
            last = bare.rpartition("-")[2].rpartition("(")[2].rpartition("’")[2]
            if (len(last) == 1 and last.isalpha()) or last in ABBREVIATIONS or re.fullmatch(r"(?:[a-z]\.)+[a-z]", bare):
                continue
            if re.fullmatch(r"\d{1,2}", word):
                following = re.match(r"[^\W\d_]+", text[at : at + 12])
                if following and following[0].lower() in MONTHS:
                    continue
        found.setdefault(at, SENTENCE)


def _lines(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for part in text.split("\n"):
        out.append((at, at + len(part)))
        at += len(part) + 1
    return out


def _first(text: str, low: int, high: int) -> int:
    while low < high and (text[low].isspace() or text[low] in BLANKS):
        low += 1
    return low


def is_tabular(line: str) -> bool:
    return ("   " in line or "|" in line or "...." in line or "\t" in line or ". . ." in line) and TABULAR.search(line) is not None


def is_row(line: str) -> bool:
    """Whether a line is a row of a table: it has the gaps of one, and is no prose with odd blanks. Prose ends a sentence
    and has long stretches between its gaps."""
    if not is_tabular(line):
        return False
    stretches = sum(1 for cell in GAP.split(line) if cell.strip())
    return len(line.strip()) + len(WIDE.findall(line)) < LONGEST_CELL * stretches or not (ENDED.search(line) or STOP.search(line))


def natural_places(text: str) -> list[tuple[int, int]]:
    """(offset, strength) of every natural place, in order; offsets count code points and the first is 0.

    A line break is taken as a wrap, and opens nothing, where lines of the text are shown to be wrapped (a line of some
    length without an end is followed by one in lower case) and the line is about as full as those.
    """
    lines = _lines(text)
    shown = [(_first(text, a, b), len(text[a:b].rstrip())) for a, b in lines]
    raw = [text[a:b] for a, b in lines]
    blank = [at >= b for (at, _), (_, b) in zip(shown, lines, strict=True)]
    tabular = [is_row(r) for r in raw]
    tails = [r.rstrip()[-16:] for r in raw]  # longer than any abbreviation with its stop and what closes after it
    ended = [bool(ENDED.search(r)) and not SHORTENED.search(r) for r in tails]
    words = [len(re.match(r"\S*", text[at:b])[0]) for (at, _), (_, b) in zip(shown, lines, strict=True)]

    def runs_on(i: int) -> bool:
        """Whether line i is shown to continue the one before it."""
        return shown[i - 1][1] >= SHORTEST_WRAP and not (blank[i - 1] or ended[i - 1] or tabular[i - 1] or tabular[i] or blank[i]) and text[shown[i][0]].islower() and not MARK.match(raw[i])

    width = min((shown[i - 1][1] + 1 + words[i] for i in range(1, len(lines)) if runs_on(i)), default=0)
    found: dict[int, int] = {}
    start = None  # of the run of lines that wraps make one
    for i, (a, b) in enumerate(lines):
        at = shown[i][0]
        if blank[i]:
            start = None
            continue
        marked = MARK.match(text, a, b) if not tabular[i] else None
        soft = False
        if start is not None and width and not tabular[i] and not tabular[i - 1] and not (marked and ended[i - 1]):
            soft = runs_on(i) or (shown[i - 1][1] + 1 + words[i] >= width and not (marked and text[at] in "•*‣·◦▪►"))
        if soft:
            continue
        found[at] = BLOCK if start is None else LINE
        start = at
    whole = sorted(found)
    for low, high in pairwise([*whole, len(text)]):
        line = text[low : high if (nl := text.find("\n", low, high)) < 0 else nl]
        if is_row(line):
            continue
        title = NUMBERED_TITLE.match(line) or MARK.match(line)
        _sentences(text, low + (title.end() if title else 0), high, found)
    if not text:
        return []
    if whole and whole[0] != 0:
        found.pop(whole[0])
    found[0] = TEXT
    return sorted(found.items())
