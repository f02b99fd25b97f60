"""Whether quoted text, numbers and claims about direction are borne out by their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.figures import NUMBER
from tallyloom.functions.text import bound

LONGEST_QUOTE, SHORTEST_QUOTE = 300, 5
# Relative changes under which a series counts as flat, over which a claim that it is flat is wrong, and
# that a steady series may reverse by.
FLAT, CLAIM, REVERSAL = 0.02, 0.05, 0.005

# Words that claim a direction, that deny, hedge or compare, and that claim a direction of every step.
# Plain substrings, without word boundaries; that is their meaning.
UP = (
    r"increas(?:e|ed|es|ing)|rose|rise|rises|risen|rising|grew|grow|grows|grown|growing|growth|expand(?:ed|ing|s)?|expansion|improv(?:e|ed|es|ement)|climb(?:ed|s)?|"
    r"jump(?:ed|s)?|surg(?:ed|es)?|gain(?:ed|s)?|accelerated|doubled|rebound(?:ed|ing)?|recover(?:ed|y|ing)?|advanc(?:ed|es|ing)|rebuilt|up\s+from|higher\s+than"
)
DOWN = (
    r"decreas(?:e|ed|es|ing)|declin(?:e|ed|es|ing)|fell|fall|falls|fallen|falling|drop(?:ped|s|ping)?|contract(?:ed|ion)|shrank|shrunk|shrinking|slipped|reduc(?:e|ed|es|tion)|"
    r"weaken(?:ed)?|deteriorat(?:ed|ion)|halved|tumbl(?:ed|es|ing)|slump(?:ed|ing)?|slid|slide|retreat(?:ed|ing)?|lower\s+than|down\s+from"
)
LEVEL = r"flat|unchanged|stable|steady|little\s+changed|in\s+line\s+with"
NEGATION = r"not|no|never|nor|without|n't|rather\s+than|instead\s+of"
HEDGE = r"may|might|could|would|should|expect(?:s|ed)?|anticipat(?:e|es|ed)|forecast(?:s|ed)?|guidance|outlook|project(?:s|ed|ion)|estimat(?:e|es|ed)|if|assum(?:e|es|ing)"
BASELINE = r"from|versus|vs\.?|compared\s+(?:with|to)|against|than|prior[- ]year|year\s+earlier"
EVERY_STEP = r"steadily|consistently|continuously|each\s+year|every\s+year"
#: Where a text is cut into clauses, and how a number is written in it.
CONJUNCTIONS = r"and|but|while|whereas|although|though|despite|however|including|includes|included|excluding|offset|partially"
CLAUSE = rf"(?i)[.;:!?](?!\d)\s*|\s+(?:{CONJUNCTIONS})\s*"


def _any(words: str) -> str:
    return f"(?i)(?:{words})"


def quote_verdict(quote: Column, chunk: Column) -> Column:
    """The first rule a citation breaks: ``unknown_chunk``, ``too_long``, ``too_short``, ``not_verbatim``; else ``ok``."""
    return (
        F.when(chunk.isNull(), "unknown_chunk")
        .when(F.length(quote) > LONGEST_QUOTE, "too_long")
        .when(F.length(F.trim(quote)) < SHORTEST_QUOTE, "too_short")
        .when(~F.contains(chunk, quote), "not_verbatim")
        .otherwise("ok")
    )


#: Minus signs, and what may follow a number that is a part of a longer one.
MINUS = "[-−–]"
_BEFORE, _AFTER = rf"(?:^|[^\d]){MINUS}\$? ?", r"(?!\.?\d)(?![%BMKTbmkt])"


def _standing(token: Column, negative: bool) -> Column:
    """The pattern of a token that stands in a text as a number of its own, with the sign: a minus before it, or, save for
    bare digits, parentheses around it make it negative."""
    quoted = F.concat(F.lit(r"\Q"), token, F.lit(r"\E"))
    bare = token.rlike(r"^\d+$")
    if negative:
        signed = F.concat(F.lit(rf"(?<={_BEFORE})(?<![\d.])"), quoted, F.lit(_AFTER))
        return F.when(bare, signed).otherwise(F.concat(signed, F.lit(r"|(?<=\()"), quoted, F.lit(r"(?=\))")))
    plain = F.concat(F.lit(rf"(?<!{_BEFORE})(?<![\d.])"), quoted, F.lit(_AFTER))
    return F.when(bare, plain).otherwise(F.concat(plain, F.lit(r"(?!(?<=\("), quoted, F.lit(r")\))")))


def stands(text: Column, token: Column, negative: Column) -> Column:
    """Whether a token stands in a text as a whole number under the sign."""
    return F.when(negative, F.rlike(text, _standing(token, True))).otherwise(F.rlike(text, _standing(token, False)))


def grounded(token: Column, haystacks: Column) -> Column:
    """Whether a number token stands in any of the texts as a whole number, under either sign."""
    return F.exists(haystacks, lambda h: F.rlike(h, _standing(token, True)) | F.rlike(h, _standing(token, False)))


def is_negative(text: Column, token: Column) -> Column:
    """Whether a token is written as a negative figure: a minus before it, or parentheses around it."""
    return F.rlike(text, _standing(token, True))


def numbers_told(text: Column) -> Column:
    """An array of (``token``, ``negative``, ``before``, ``after``) for the numbers of a text; ``before`` and ``after`` are what
    lies between it and its neighbours, a year named as ``FY<year>`` being no neighbour."""
    at = lambda a, i: F.coalesce(F.get(a, i), F.lit(""))

    def one(parts: Column, tokens: Column, t: Column, i: Column) -> Column:
        labelled = lambda j: at(parts, j).rlike(r"(?i)FY\s*$")
        touching = F.concat(F.when(i > 0, F.right(at(tokens, i - 1), F.lit(1))).otherwise(F.lit("")), at(parts, i))
        wrapped = at(parts, i).endswith("(") & at(parts, i + 1).startswith(")") & ~t.rlike(r"^\d+$")
        before = F.when((i > 0) & labelled(i - 1), F.concat(at(parts, i - 1), at(tokens, i - 1), at(parts, i))).otherwise(at(parts, i))
        after = F.when(labelled(i + 1), F.concat(at(parts, i + 1), at(tokens, i + 1), at(parts, i + 2))).otherwise(at(parts, i + 1))
        return F.struct(t.alias("token"), (touching.rlike(rf"(?:^|[^\d]){MINUS}\$? ?$") | wrapped).alias("negative"), before.alias("before"), after.alias("after"))

    cut = F.struct(F.split(text, NUMBER, -1).alias("p"), F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1)).alias("t"))
    return bound(cut, lambda s: F.transform(s["t"], lambda t, i: one(s["p"], s["t"], t, i)))


def clauses(text: Column) -> Column:
    """The clauses of a text: cut at its stops, but not within numbers, and before conjunctions that turn to another matter."""
    return F.filter(F.split(text, CLAUSE), lambda c: F.trim(c) != "")


def claimed_direction(clause: Column) -> Column:
    """``up``, ``down`` or ``flat`` where a clause claims just one; NULL where it claims none or more, denies or hedges."""

    def told(low: Column) -> Column:
        votes = F.filter(F.array(*[F.when(low.rlike(p), F.lit(name)) for name, p in (("up", UP), ("down", DOWN), ("flat", LEVEL))]), lambda x: x.isNotNull())
        return bound(votes, lambda v: F.when((F.size(v) == 1) & ~low.rlike(NEGATION) & ~low.rlike(HEDGE), F.get(v, F.lit(0))))

    return bound(F.lower(clause), told)


def series_direction(series: DataFrame, keys: list[str], year: str, value: str) -> DataFrame:
    """Per key, over its years in order: first and last value, relative change, its direction beyond the dead band, and
    whether it never reverses by more than half a percent on the way. Series of one point, or with a value that is not
    positive, have a NULL direction."""
    w = Window.partitionBy(*keys).orderBy(year)
    step = series.withColumn("next", F.lead(value).over(w))
    rel = (F.col("next") - F.col(value)) / F.col(value)
    each = F.when((F.col(value) > 0) & F.col("next").isNotNull(), rel)
    g = step.withColumn("rel", each).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.min_by(value, year).alias("first"), F.max_by(value, year).alias("last"), F.max("rel").alias("up"), F.min("rel").alias("down")
    )
    ok = (F.col("n") >= 2) & (F.col("least") > 0)
    change = F.when(ok, (F.col("last") - F.col("first")) / F.col("first"))
    direction = F.when(change > FLAT, "up").when(change < -FLAT, "down").when(change.isNotNull(), "flat")
    steady = F.when(direction == "up", F.col("down") >= -REVERSAL).when(direction == "down", F.col("up") <= REVERSAL)
    return g.select(*keys, F.col("n").alias("n_points"), F.round(change, 6).alias("change"), direction.alias("direction"), steady.alias("steady"))


def year_claims(sentences: DataFrame, figures: DataFrame) -> DataFrame:
    """Figures quoted with the wrong fiscal year. ``sentences``: (``doc_id``, ``cik``, ``sentence``); ``figures``: (``cik``,
    ``fiscal_year``, ``token``).

    A sentence counts where it names one year only (``fiscal 2016``, ``FY2016``, ``Geschäftsjahr 2016``); each of its
    number tokens that is a figure of the company in other years but not in that one is reported, with the years it is
    true of. One equi-join on company and token.
    """
    years = F.array_distinct(F.regexp_extract_all(F.col("sentence"), F.lit(r"(?i)(?:fiscal(?: year)? |FY ?|Gesch[äa]ftsjahr |exercice |ejercicio )((?:19|20)\d{2})"), F.lit(1)))
    tokens = F.array_distinct(F.regexp_extract_all(F.col("sentence"), F.lit(f"({NUMBER})"), F.lit(1)))
    said = sentences.withColumn("y", years).where(F.size("y") == 1).select("doc_id", "cik", F.col("y")[0].cast("int").alias("claimed"), F.explode(tokens).alias("token"))
    true = said.join(figures.select("cik", "token", "fiscal_year").distinct(), ["cik", "token"])
    g = true.groupBy("doc_id", "claimed", "token").agg(F.max((F.col("fiscal_year") == F.col("claimed")).cast("int")).alias("ok"), F.array_sort(F.collect_set("fiscal_year")).alias("years"))
    return g.where("ok = 0").select("doc_id", "claimed", "token", F.array_join(F.transform("years", lambda y: y.cast("string")), ",").alias("true_years"))
