"""Drafted commentary held against its figures and cited chunks: the first rule that a draft breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.figures import parse_figure
from tallyloom.operators.grounding import BASELINE, CLAIM, EVERY_STEP, FLAT, REVERSAL, _any, claimed_direction, clauses, numbers_told, quote_verdict, stands

# The shape of a draft, of a chunk's id, how near a year stands to its number, and how it is named there.
DRAFT = "STRUCT<text: STRING, citations: ARRAY<STRUCT<chunk_id: STRING, quote: STRING>>>"
CHUNK_ID, LONGEST_ID = r"^[a-z0-9_]+-\d{4}$", 64
NEAR = 35
YEAR_BEFORE, YEAR_AFTER = r"(?i)FY\s*(\d{4})\s*:?\s*$", r"(?i)^\s*(?:in|for|during|of)?\s*FY\s*(\d{4})\b"
RECENT = r"(?:the\s+)?(?:most\s+recent|latest|current|last\s+reported)\s+(?:fiscal\s+)?years?"
RECENT_BEFORE, RECENT_AFTER = rf"(?i){RECENT}\s*(?:of|:)?\s*$", rf"(?i)^\s*(?:in|for|during|of|as)?\s*{RECENT}\b"
#: The verdicts, in the order in which a draft is held against them; ``ok`` where it breaks none.
VERDICTS = (
    "not_json", "bad_shape", "refusal_with_citations", "unknown_chunk", "too_long", "too_short", "not_verbatim", "ungrounded", "wrong_sign", "wrong_year", "wrong_direction", "not_steady",
)


def _shaped(raw: Column, draft: Column) -> Column:
    """Whether JSON has the shape of a draft: a text or null, and maybe a list of citations with whole ids and quotes."""
    kind = lambda path: F.schema_of_variant(F.try_variant_get(F.try_parse_json(raw), path, "variant"))
    text, listed = kind("$.text"), kind("$.citations")
    whole = F.forall(F.coalesce(draft["citations"], F.array().cast("array<struct<chunk_id:string,quote:string>>")), lambda c: c.isNotNull() & c["quote"].isNotNull() & c["chunk_id"].rlike(CHUNK_ID) & (F.length(c["chunk_id"]) <= LONGEST_ID))
    return text.isin("STRING", "VOID") & (listed.isNull() | listed.startswith("ARRAY")) & F.coalesce(whole, F.lit(False))


def series(figures: DataFrame) -> DataFrame:
    """Per ``subject`` its figures as an array of (``year``, ``line``, ``value``) in order of year, and ``sound``: whether no year
    has two values. A subject has a figure a year."""
    each = figures.select("subject", F.col("fiscal_year").alias("year"), F.concat(F.lit("FY"), F.col("fiscal_year").cast("string"), F.lit(": "), "figure").alias("line"), parse_figure(F.col("figure")).alias("value")).distinct()
    g = each.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("year", "line", "value"))).alias("figures"))
    known = F.filter("figures", lambda f: f["value"].isNotNull())
    return g.withColumn("sound", F.size(F.array_distinct(F.transform(known, lambda f: f["year"]))) == F.size(F.array_distinct(F.transform(known, lambda f: F.struct(f["year"], f["value"])))))


def _citations(read: DataFrame, chunks: DataFrame) -> DataFrame:
    cited = read.select("draft_id", F.posexplode("citations").alias("place", "c")).select("draft_id", "place", "c.chunk_id", "c.quote")
    held = cited.join(chunks.select("chunk_id", F.col("text").alias("chunk")), "chunk_id", "left")
    verdict = quote_verdict(F.col("quote"), F.col("chunk"))
    return held.select("draft_id", F.struct(F.lit(4).alias("stage"), F.col("place").cast("int").alias("place"), verdict.alias("verdict")).alias("v")).where("v.verdict <> 'ok'")


def _numbers(read: DataFrame) -> DataFrame:
    """The verdict of each number of a text: it stands in a figure or quote, under its sign, and of the year it is given to."""
    n = read.select("draft_id", "figures", "quotes", "sound", F.posexplode(numbers_told(F.col("text"))).alias("place", "n")).select("draft_id", "figures", "quotes", "sound", "place", "n.*")
    token, lines = F.col("token"), F.transform("figures", lambda f: f["line"])
    under = lambda sign: F.exists(F.concat(lines, F.col("quotes")), lambda h: stands(h, token, sign))
    true_years = F.transform(F.filter("figures", lambda f: stands(f["line"], token, F.col("negative"))), lambda f: f["year"])
    before, after = F.right("before", F.lit(NEAR)), F.left("after", F.lit(NEAR))
    named = lambda side, pattern: F.when(side.rlike(pattern), F.regexp_extract(side, pattern, 1).cast("int"))
    latest = F.array_max(F.transform(F.filter("figures", lambda f: f["value"].isNotNull()), lambda f: f["year"]))
    recent = F.when(F.col("sound") & (before.rlike(RECENT_BEFORE) | after.rlike(RECENT_AFTER)), latest)
    claimed = F.array_distinct(F.filter(F.array(named(before, YEAR_BEFORE), named(after, YEAR_AFTER), recent), lambda y: y.isNotNull()))
    wrong_year = (F.size("claimed") == 1) & (F.size("true_years") > 0) & ~F.array_contains("true_years", F.get("claimed", F.lit(0)))
    seen = n.withColumn("same", under(F.col("negative"))).withColumn("other", under(~F.col("negative"))).withColumn("claimed", claimed).withColumn("true_years", true_years)
    verdict = F.when(~F.col("same") & ~F.col("other"), "ungrounded").when(~F.col("same"), "wrong_sign").when(wrong_year, "wrong_year")
    return seen.select("draft_id", F.struct(F.lit(5).alias("stage"), F.col("place").cast("int").alias("place"), verdict.alias("verdict")).alias("v")).where("v.verdict is not null")


def _directions(read: DataFrame) -> DataFrame:
    """The verdict of each clause that claims one direction of change between years whose figures it names; of one year
    alone, since the year before it. Nothing is said of changes within the bands, and of figures that are not positive."""
    known = F.filter("figures", lambda f: f["value"].isNotNull())
    c = read.where("sound").withColumn("known", known).where("size(known) >= 2").select("draft_id", "known", "figures", F.posexplode(clauses(F.col("text"))).alias("place", "clause"))
    c = c.withColumn("claim", claimed_direction(F.col("clause"))).where("claim is not null").withColumn("told", numbers_told(F.col("clause")))
    years = F.array_distinct(F.transform(F.filter("figures", lambda f: F.exists("told", lambda n: stands(f["line"], n["token"], n["negative"]))), lambda f: f["year"]))
    c = c.withColumn("years", years).where("size(years) > 0")
    later = F.array_max("years")
    prior = F.array_max(F.transform(F.filter("known", lambda f: f["year"] < later), lambda f: f["year"]))
    earlier = F.when(F.size("years") >= 2, F.array_min("years")).otherwise(F.when(~F.col("clause").rlike(_any(BASELINE)), prior))
    c = c.withColumn("later", later).withColumn("earlier", earlier)
    value = lambda year: F.get(F.transform(F.filter("known", lambda f: f["year"] == F.col(year)), lambda f: f["value"]), F.lit(0))
    c = c.withColumn("a", value("earlier")).withColumn("b", value("later")).where("a > 0 and b > 0").withColumn("change", (F.col("b") - F.col("a")) / F.col("a"))
    span = F.transform(F.filter("known", lambda f: f["year"].between(F.col("earlier"), F.col("later"))), lambda f: f["value"])
    steps = F.zip_with(span, F.slice(span, 2, F.size(span)), lambda x, y: F.when((x > 0) & (y > 0), (y - x) / x))
    rises, level = F.col("claim") == "up", F.col("claim") == "flat"
    reversed_ = F.coalesce(F.exists(steps, lambda r: F.when(rises, r < -REVERSAL).otherwise(r > REVERSAL)), F.lit(False))
    against = (F.abs("change") > FLAT) & ((F.col("change") > 0) != rises)
    unsteady = (F.abs("change") > FLAT) & F.col("clause").rlike(_any(EVERY_STEP)) & reversed_
    verdict = F.when(level, F.when(F.abs("change") > CLAIM, "wrong_direction")).when(against, "wrong_direction").when(unsteady, "not_steady")
    return c.select("draft_id", F.struct(F.lit(6).alias("stage"), F.col("place").cast("int").alias("place"), verdict.alias("verdict")).alias("v")).where("v.verdict is not null")


def verdicts(drafts: DataFrame, figures: DataFrame, chunks: DataFrame) -> DataFrame:
    """(``draft_id``, ``verdict``): the first of ``VERDICTS`` that holds, else ``ok``.

    ``drafts``: (``draft_id``, ``subject``, ``raw`` JSON); ``figures``: (``subject``, ``fiscal_year``, ``figure``), a few of each
    subject; ``chunks``: (``chunk_id``, ``text``). Citations are joined by chunk id and numbers and clauses held against
    the few figures of the draft's own row; only verdicts are shuffled after. A NULL draft is no JSON. A draft whose text
    is empty may cite nothing; a subject without figures grounds numbers in quotes alone.
    """
    parsed = drafts.select("draft_id", "subject", "raw", F.from_json("raw", DRAFT).alias("d"))
    none = F.array().cast("array<struct<chunk_id:string,quote:string>>")
    empty = (F.coalesce(F.col("d.text"), F.lit("")) == "") & (F.size(F.coalesce(F.col("d.citations"), none)) > 0)
    form = F.when(F.try_parse_json("raw").isNull(), "not_json").when(~F.coalesce(_shaped(F.col("raw"), F.col("d")), F.lit(False)), "bad_shape").when(empty, "refusal_with_citations")
    formed = parsed.withColumn("form", form)
    sound = formed.where("form is null").select("draft_id", "subject", "d.text", F.coalesce("d.citations", none).alias("citations"))
    told = sound.where("text <> ''").join(series(figures), "subject", "left")
    told = told.withColumn("figures", F.coalesce("figures", F.array().cast("array<struct<year:int,line:string,value:double>>"))).withColumn("sound", F.coalesce("sound", F.lit(False)))
    told = told.withColumn("quotes", F.transform("citations", lambda c: c["quote"]))
    found = _citations(sound, chunks).unionByName(_numbers(told)).unionByName(_directions(told))
    first = found.groupBy("draft_id").agg(F.min("v").alias("v"))
    return formed.select("draft_id", "form").join(first, "draft_id", "left").select("draft_id", F.coalesce("form", F.col("v.verdict"), F.lit("ok")).alias("verdict"))
