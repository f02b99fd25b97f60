"""Text of documents: markup removed, lines, sections, sentences, words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean_markup(html: Column) -> Column:
    """Lines of visible text by patterns alone: scripts and styles dropped, tags to line breaks, blanks collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", "")
    text = F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", "\n"), "\u00a0", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


@F.pandas_udf(T.StringType())
def parse_markup(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The same with an HTML parser: entities and malformed tags as a browser reads them."""
    from html.parser import HTMLParser

    class Text(HTMLParser):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.parts, self.hidden = [], 0

        def handle_starttag(self, tag: str, attrs: list) -> None:
            self.hidden += tag in ("script", "style")

        def handle_endtag(self, tag: str) -> None:
            self.hidden -= tag in ("script", "style") and self.hidden > 0

        def handle_data(self, data: str) -> None:
            if not self.hidden:
                self.parts.append(data)

    def one(html: str | None) -> str | None:
        if html is None:
            return None
        reader = Text()
        reader.feed(html)
        reader.close()
        lines = (" ".join(x.replace("\xa0", " ").split()) for x in "\n".join(reader.parts).split("\n"))
        return "\n".join(x for x in lines if x)

    for batch in batches:
        yield batch.map(one)


def sentences(text: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` and white space; a text without any end is one sentence."""
    parts = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda x: x != "")
    return bound(parts, lambda each: F.when(F.size(each) > 0, each).otherwise(F.array(text)))


def words(text: Column) -> Column:
    """Runs of a-z and 0-9 in lower case; an accented letter ends a word."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is evaluated once, however often ``f`` and functions within it refer to it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def pack(sents: Column, target: int, overlap: int) -> Column:
    """Sentences packed greedily into chunks of ``target`` characters, each begun with the shortest run of the last
    sentences that reaches ``overlap``. A fold over the array, inside the JVM."""
    indexed = bound(sents, lambda each: F.transform(each, lambda s, i: F.struct(s.alias("s"), (i == F.size(each) - 1).alias("last"))))
    empty = F.struct(F.array().cast("array<string>").alias("cur"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        cur = F.concat(acc["cur"], F.array(x["s"]))
        n = acc["n"] + F.length(x["s"]) + 1
        emit = (n >= target) | x["last"]
        carried = F.aggregate(
            F.reverse(cur),
            F.struct(F.array().cast("array<string>").alias("c"), F.lit(0).alias("m")),
            lambda a, s: F.when(a["m"] >= overlap, a).otherwise(F.struct(F.concat(F.array(s), a["c"]).alias("c"), (a["m"] + F.length(s) + 1).alias("m"))),
        )
        keep = F.lit(overlap > 0)
        return F.when(
            emit,
            F.struct(
                F.when(keep, carried["c"]).otherwise(F.array().cast("array<string>")).alias("cur"), F.when(keep, carried["m"]).otherwise(F.lit(0)).alias("n"), F.concat(acc["out"], F.array(F.array_join(cur, " "))).alias("out")
            ),
        ).otherwise(F.struct(cur.alias("cur"), n.alias("n"), acc["out"].alias("out")))

    return F.aggregate(indexed, empty, step, lambda acc: acc["out"])


#: At the start of a line.
AT_LINE = r"(?<![^\n])"


def longest_section(text: Column, heading: str, boundary: str) -> Column:
    """(``start``, ``span``) of the longest stretch from a heading to the next boundary after it, or the end; NULL where the
    text has no heading. Both are patterns at the start of a line, and may run over several lines; the first heading wins
    a tie. One split and one fold over its parts, inside the JVM."""
    parts = F.split(text, rf"(?={AT_LINE}(?:{heading}|{boundary}))", -1)
    # A heading over two lines may hold another on its second, which begins the next part.
    joined = bound(parts, lambda each: F.zip_with(each, F.slice(each, 2, F.size(each)), lambda p, after: F.struct(F.length(p).cast("bigint").alias("n"), F.concat(p, F.coalesce(after, F.lit(""))).alias("t"))))
    marks = F.transform(joined, lambda p: F.struct(p["n"].alias("n"), p["t"].rlike(rf"\A(?:{heading})").alias("h"), p["t"].rlike(rf"\A(?:{boundary})").alias("b")))
    none, zero = F.lit(-1).cast("bigint"), F.lit(0).cast("bigint")
    empty = F.struct(zero.alias("at"), none.alias("open"), none.alias("start"), none.alias("span"))

    def closed(acc: Column) -> tuple[Column, Column]:
        longer = (acc["open"] >= 0) & (acc["at"] - acc["open"] > acc["span"])
        return F.when(longer, acc["open"]).otherwise(acc["start"]), F.when(longer, acc["at"] - acc["open"]).otherwise(acc["span"])

    def step(acc: Column, x: Column) -> Column:
        # Of the headings before one boundary the first has the longest stretch, so only it is kept open.
        start, span = closed(acc)
        left = F.when(x["b"], none).otherwise(acc["open"])
        opened = F.when(x["h"] & (left < 0), acc["at"]).otherwise(left)
        return F.struct((acc["at"] + x["n"]).alias("at"), opened.alias("open"), F.when(x["b"], start).otherwise(acc["start"]).alias("start"), F.when(x["b"], span).otherwise(acc["span"]).alias("span"))

    def finish(acc: Column) -> Column:
        start, span = closed(acc)
        return F.when(start >= 0, F.struct(start.alias("start"), span.alias("span")))

    return F.aggregate(marks, empty, step, finish)


def section_text(text: Column, found: Column, blank: str = r"\s+") -> Column:
    """The text of a section with its white space collapsed."""
    return F.trim(F.regexp_replace(F.substring(text, found["start"].cast("int") + 1, found["span"].cast("int")), blank, " "))


# Fixed values: (key, label, number of the item, start of its title, its bare title), and of the items that end it.
SECTIONS = [
    (
        "item1a", "Item 1A. Risk Factors", "1a", r"risk\s+factors", r"risk\s+factors",
        [("1b", r"unresolved\s+staff\s+comments", r"unresolved\s+staff\s+comments"), ("2", "properties", "properties")],
    ),
    (
        "item7", "Item 7. Management's Discussion and Analysis", "7", r"management.?s?\s+discussion",
        r"management.?s?\s+discussion\s+and\s+analysis(?:\s+of\s+financial\s+condition\s+and\s+results\s+of\s+operations)?",
        [("7a", "quantitative", r"quantitative\s+and\s+qualitative[^\n]*"), ("8", r"financial\s+statements", r"financial\s+statements\s+and\s+supplementary\s+data")],
    ),
]


def _headed(number: str, title: str, bare: str) -> str:
    """Either ``Item <n>. <title>``, or the bare title as a line of its own; any case, Unicode blanks."""
    return rf"(?iuU:item\s*{number}\.?:?\s*{title}|[ \t]*{bare}[ \t]*(?=\n|\z))"


def filing_chunks(filings: DataFrame, key: str, text: str, target_tokens: int, overlap_tokens: int) -> DataFrame:
    """(key, ``section``, ``chunk_id``, ``chunk``): the chunks of the sections 1A and 7 of each filing's cleaned text.

    Sentences of a section are packed to about the target, each chunk begun with the section's label; ids are the
    section's key and the chunk's number. A section that is not found gives no rows. All work is within the row."""
    filings = filings.select(key, F.col(text).alias("filing_text"))
    text = "filing_text"
    found = [
        F.struct(F.lit(name).alias("name"), F.lit(label).alias("label"), longest_section(F.col(text), _headed(n, title, bare), "|".join(_headed(*b) for b in bounds)).alias("at"))
        for name, label, n, title, bare, bounds in SECTIONS
    ]
    each = filings.select(key, text, F.explode(F.array(*found)).alias("f")).where("f.at is not null")
    each = each.select(key, F.struct("f.name", "f.label", section_text(F.col(text), F.col("f.at"), r"(?U)\s+").alias("body")).alias("s"))
    packed = pack(sentences(F.col("s.body")), max(4 * target_tokens, 1), max(4 * overlap_tokens, 0))
    rows = each.select(key, "s.name", "s.label", F.posexplode(packed).alias("pos", "body"))
    return rows.select(key, F.col("label").alias("section"), F.concat("name", F.lit("-"), F.lpad(F.col("pos").cast("string"), 4, "0")).alias("chunk_id"), F.trim(F.concat("label", F.lit(" "), "body")).alias("chunk"))
