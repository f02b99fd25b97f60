"""Queries over documents and vectors: cleaning, sections, words, retrieval, grounding, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.figures import NUMBER, format_figure, number_tokens
from tallyloom.functions.spelling import item_name
from tallyloom.functions.text import clean_markup, filing_chunks, longest_section, pack, parse_markup, section_text, sentences, words
from tallyloom.operators import evals
from tallyloom.operators import retrieval as rt
from tallyloom.operators.grounding import CONJUNCTIONS, DOWN, HEDGE, LEVEL, NEGATION, UP, claimed_direction, clauses, numbers_told, quote_verdict
from tallyloom.plans.sqlparts import item
from tallyloom.session import table

HEADING = r"(?:\d+\. )?(?:[Ll]iquidity|LIQUIDITY|[Rr]isiken|RISIKEN|[Rr]iesgos|RIESGOS|[Rr]isques|RISQUES)"
BOUNDARY = r"(?:\d+\. )?(?:[Oo]verview|OVERVIEW|PART [IVX]+|[Pp]erspectivas|PERSPECTIVAS|[Pp]erspectives|PERSPECTIVES|[Aa]usblick|AUSBLICK|Outlook and plans|Results by segment)"
TARGET, OVERLAP = 3200, 400


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def q26_clean_markup(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(clean_markup(F.col("text")).cast("binary")).alias("digest"))


def q26_parse_markup(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.length(parse_markup("text")).cast("bigint").alias("n_chars"))


def q27_section_extract(spark: SparkSession, d: str) -> DataFrame:
    """The longest stretch under one of the headings; each is a line of its own."""
    whole = lambda p: rf"{p}(?=\n|\z)"
    found = _docs(spark, d).withColumn("f", longest_section(F.col("text"), whole(HEADING), whole(BOUNDARY))).where("f is not null")
    return found.select("doc_id", "f.start", "f.span", F.md5(section_text(F.col("text"), F.col("f")).cast("binary")).alias("digest"))


def q68_filing_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the documents that are risk factors or management's discussion, each set as a filing with its list of
    contents: both headings stand twice, and only the second leads to a section."""
    listed = "Contents\nItem 1A. Risk Factors\nItem 1B. Unresolved Staff Comments\nItem 7. Management's Discussion and Analysis\nItem 8. Financial Statements\n"
    head = F.when(F.col("section") == "item1a", F.lit("Item 1A.\nRisk Factors\n")).otherwise(F.lit("MANAGEMENT'S DISCUSSION AND ANALYSIS\n"))
    end = F.when(F.col("section") == "item1a", F.lit("\nItem 2. Properties\nnone\n")).otherwise(F.lit("\nItem 7A: Quantitative and qualitative disclosures\nnone\n"))
    docs = _docs(spark, d).where("section in ('item1a', 'item7') and text is not null").select("doc_id", F.concat(F.lit(listed), head, "text", end).alias("filing"))
    c = filing_chunks(docs, "doc_id", "filing", 800, 100)
    return c.select("doc_id", "chunk_id", F.length("chunk").cast("bigint").alias("n_chars"), F.md5(F.col("chunk").cast("binary")).alias("digest"))


def q28_sentences(spark: SparkSession, d: str) -> DataFrame:
    s = _docs(spark, d).where("text is not null").select("doc_id", sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("bigint").alias("n"), F.md5(F.array_join("s", "|").cast("binary")).alias("digest"))


def q29_chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    s = _docs(spark, d).where("text is not null").select("doc_id", sentences(F.col("text")).alias("s"))
    c = s.select("doc_id", F.posexplode(pack(F.col("s"), TARGET, OVERLAP)).alias("pos", "chunk"))
    key = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("-"), F.lpad(F.col("pos").cast("string"), 4, "0"))
    return c.select("doc_id", key.alias("chunk_id"), F.length("chunk").cast("bigint").alias("n_chars"), F.md5(F.col("chunk").cast("binary")).alias("digest"))


def q30_word_stats(spark: SparkSession, d: str) -> DataFrame:
    w = _docs(spark, d).select("doc_id", F.coalesce(F.lower("lang"), F.lit("-")).alias("lang"), words(F.coalesce("text", F.lit(""))).alias("w"))
    lengths = w.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("w").cast("bigint")).alias("n_words"))
    terms = w.select("lang", F.explode(F.array_distinct("w")).alias("t")).groupBy("lang", "t").agg(F.count(F.lit(1)).alias("df")).groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"), F.max("df").alias("max_df"))
    return lengths.join(terms, "lang", "left").select("lang", "n_docs", "n_words", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), F.coalesce("max_df", F.lit(0)).alias("max_df"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tag_spec").select(F.col("item_key").alias("query_id"), F.col("label").alias("query"))


def _bm25(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    return rt.bm25(_docs(spark, d), _queries(spark, d), k)


def q31_bm25(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _vectors(spark: SparkSession, d: str, squared: bool) -> DataFrame:
    v = table(spark, d, "embeddings")
    return rt.nearest(v, v.where("vec_id % 50 = 0"), 10, squared)


def q32_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d, False)


def q33_nearness(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d, True)


def _by_count(spark: SparkSession, d: str) -> DataFrame:
    """A second ranking of the same queries: by plain counts of their words."""
    asked = _queries(spark, d).select("query_id", F.explode(F.array_distinct(words(F.col("query")))).alias("term"))
    hits = rt.term_counts(_docs(spark, d), wanted=asked).join(F.broadcast(asked), "term").groupBy("query_id", "doc_id").agg(F.sum("tf").cast("double").alias("score"))
    return rt.top(hits, 20)


def _lists(spark: SparkSession, d: str) -> DataFrame:
    one = _bm25(spark, d).select("query_id", F.lit(0).alias("list_id"), "doc_id", "rank")
    return one.unionByName(_by_count(spark, d).select("query_id", F.lit(1).alias("list_id"), "doc_id", "rank"))


def q34_fusion(spark: SparkSession, d: str) -> DataFrame:
    return rt.fuse(_lists(spark, d)).select("query_id", "doc_id", F.round("score", 9).alias("score"))


def q35_retrieve(spark: SparkSession, d: str) -> DataFrame:
    return rt.retrieve(_lists(spark, d), 0.014).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


def q70_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Words and vectors fused, the pool reranked by shared words; with the digest of each chunk that is left."""
    r = rt.hybrid(_docs(spark, d), _queries(spark, d), rerank=rt.shared_words, least_reranked=0.3)
    return r.select("query_id", "doc_id", "score", "rank", "scored_by", F.md5(F.col("text").cast("binary")).alias("digest"))


def q71_hybrid_fused(spark: SparkSession, d: str) -> DataFrame:
    """The same without a reranking model: the fused scores and their own limit."""
    r = rt.hybrid(_docs(spark, d), _queries(spark, d), least_fused=0.0125)
    return r.select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank", "scored_by")


def _gold(spark: SparkSession, d: str) -> DataFrame:
    """Documents that name the queried item in full."""
    docs = _docs(spark, d).select("doc_id", F.lower("text").alias("t"))
    return docs.join(F.broadcast(_queries(spark, d)), F.contains("t", F.lower("query"))).select("query_id", "doc_id")


def q36_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    p = evals.precision_recall(_bm25(spark, d), _gold(spark, d), 10)
    return p.select("query_id", F.col("hits").cast("bigint").alias("hits"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def q37_refusal_rate(spark: SparkSession, d: str) -> DataFrame:
    tags = table(spark, d, "tag_spec").select(F.explode("tags").alias("query_id")).withColumn("query", F.col("query_id"))
    asked = _queries(spark, d).unionByName(tags)
    terms = asked.select("query_id", F.explode(words(F.col("query"))).alias("term"))
    hits = terms.join(rt.known_terms(_docs(spark, d), terms), "term").select("query_id")
    return evals.refusal_rate(asked, hits)


def q38_quote_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Each document's first sentence, cited from the document of the even id at or before its own."""
    quotes = _docs(spark, d).where("text is not null").select("doc_id", (F.col("doc_id") - F.col("doc_id") % 2).alias("cited"), F.get(sentences(F.col("text")), F.lit(0)).alias("quote"))
    chunks = _docs(spark, d).select(F.col("doc_id").alias("cited"), F.col("text").alias("chunk"))
    return quotes.join(chunks, "cited", "left").select("doc_id", quote_verdict(F.col("quote"), F.col("chunk")).alias("verdict"))


def q39_number_tokens(spark: SparkSession, d: str) -> DataFrame:
    n = _docs(spark, d).select("doc_id", number_tokens(F.coalesce("text", F.lit(""))).alias("n"))
    return n.select("doc_id", F.size("n").cast("bigint").alias("n_numbers"), F.md5(F.array_join("n", " ").cast("binary")).alias("digest"))


def q40_number_grounding(spark: SparkSession, d: str) -> DataFrame:
    """How many of a document's figures are figures of its company, under the sign they are written with."""
    units = table(spark, d, "tag_spec").select("item_key", "unit")
    r = table(spark, d, "resolved_value").where("value is not null").select("cik", item_name("item_key").alias("item_key"), "value").join(F.broadcast(units), "item_key")
    forms = F.array(F.regexp_replace(format_figure(F.abs("value"), F.col("unit")), " shares$", ""), F.concat(F.lit("$"), F.format_number(F.abs("value"), 0)))
    figures = r.select("cik", (F.col("value") < 0).alias("negative"), F.explode(forms).alias("token")).distinct().withColumn("known", F.lit(1))
    told = F.array_distinct(F.transform(numbers_told(F.coalesce("text", F.lit(""))), lambda n: F.struct(n["token"].alias("token"), n["negative"].alias("negative"))))
    said = _docs(spark, d).select("doc_id", "cik", F.explode(told).alias("n")).select("doc_id", "cik", "n.token", "n.negative")
    return said.join(figures, ["cik", "token", "negative"], "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.count("known").alias("n_grounded"), F.count_if("negative").alias("n_negative"))


def q41_claims(spark: SparkSession, d: str) -> DataFrame:
    c = _docs(spark, d).where("text is not null").select("doc_id", F.explode_outer(clauses(F.col("text"))).alias("c")).select("doc_id", claimed_direction(F.col("c")).alias("direction"))
    return c.groupBy("doc_id").agg(*[F.count_if(F.col("direction") == x).alias(f"n_{x}") for x in ("up", "down", "flat")])


def q43_section_counts(spark: SparkSession, d: str) -> DataFrame:
    g = _docs(spark, d).groupBy(F.coalesce("section", F.lit("-")).alias("section")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text").cast("bigint")).alias("n_chars"))
    return g.withColumn("enough", (F.col("n_docs") >= 5) & (F.col("n_chars") >= 2000))


def q44_rates(spark: SparkSession, d: str) -> DataFrame:
    """Three shares, each with its own hits and count."""
    text = F.col("text").isNotNull() & (F.trim("text") != "")
    parts = {"has_text": text, "has_source": F.col("source").isNotNull(), "has_section": F.col("section").isNotNull()}
    n = F.count(F.lit(1))
    return _docs(spark, d).agg(n.alias("n"), *[F.count_if(c).alias(f"{k}_hits") for k, c in parts.items()], *[F.round(F.try_divide(F.count_if(c), n), 6).alias(f"{k}_rate") for k, c in parts.items()])


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q") and callable(f) and name[1:3].isdigit()}

_SENT = r"list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"
_SENTS = f"CASE WHEN len({_SENT}) > 0 THEN {_SENT} ELSE [text] END"
_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9]+)', 1)"
_NUMBERS = f"regexp_extract_all(coalesce(text, ''), '({NUMBER})', 1)"
_BM25 = f"""
w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
tf AS (SELECT doc_id, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM w) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w),
idf AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), st),
fl AS (SELECT avg(idf) * 0.25 AS fl FROM idf),
qt AS (SELECT query_id, t AS term, count(*) AS times FROM (SELECT item_key AS query_id, unnest(regexp_extract_all(lower(label), '([a-z0-9]+)', 1)) AS t FROM tag_spec) GROUP BY ALL),
sc AS (SELECT query_id, doc_id, round(sum(times * CASE WHEN idf < 0 THEN fl ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / avgdl))), 9) AS score
       FROM tf JOIN qt USING (term) JOIN idf USING (term) JOIN w USING (doc_id), st, fl GROUP BY query_id, doc_id),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 20)"""
_FUSED = f"""WITH {_BM25},
cs AS (SELECT query_id, doc_id, sum(tf)::DOUBLE AS score FROM tf JOIN (SELECT DISTINCT query_id, term FROM qt) USING (term) GROUP BY ALL),
ct AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cs QUALIFY rank <= 20),
li AS (SELECT query_id, doc_id, 0 AS l, rank FROM bm UNION ALL SELECT query_id, doc_id, 1, rank FROM ct),
fu AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(l * 1000 + rank) AS first_ FROM li GROUP BY ALL)"""
_EMBED = "list_transform(range(16), lambda i: ('0x' || substr(sha256({0}), (1 + 2 * i)::BIGINT, 2))::INT / 255)"
# Words rank texts alone: those without are in no list and count in no mean.
_BM25_TEXTS = _BM25.replace("AS w FROM documents)", "AS w FROM documents WHERE text IS NOT NULL)")
_HYBRID = f"""WITH {_BM25_TEXTS},
qe AS (SELECT item_key AS query_id, label AS query, {_EMBED.format('label')} AS q FROM tag_spec), de AS (SELECT doc_id, {_EMBED.format('text')} AS e FROM documents WHERE text IS NOT NULL),
vs AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(e, q), 6) DESC, doc_id) AS rank FROM qe CROSS JOIN de QUALIFY rank <= 20),
li AS (SELECT query_id, doc_id, 0 AS l, rank FROM bm UNION ALL SELECT query_id, doc_id, 1, rank FROM vs),
fu AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(l * 1000 + rank) AS first_ FROM li GROUP BY ALL),
po AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_, doc_id) AS at_ FROM fu QUALIFY at_ <= 18)"""
_ASKED = "list_distinct(regexp_extract_all(lower(query), '([a-z0-9]+)', 1))"
_VEC = """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id AS doc_id, round({how}, 6) AS score FROM q CROSS JOIN embeddings)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10"""
_CLEAN = r"""regexp_replace(regexp_replace(text, '(?is)<(script|style)\b.*?</(script|style)>', '', 'g'), '(?s)<[^>]*>', chr(10), 'g')"""
_UNESCAPE = f"replace(replace(replace(replace(replace(replace({_CLEAN}, chr(160), ' '), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
_FIG = """CASE WHEN value < 0 THEN '-' ELSE '' END || CASE WHEN unit = 'USD/shares' THEN '$' || format('{:,.2f}', abs(value))
  ELSE CASE WHEN unit = 'shares' THEN '' ELSE '$' END || CASE WHEN abs(value) >= 1e9 THEN format('{:,.2f}', abs(value) / 1e9) || 'B' WHEN abs(value) >= 1e6 THEN format('{:,.2f}', abs(value) / 1e6) || 'M'
    WHEN abs(value) >= 1e3 THEN format('{:,.2f}', abs(value) / 1e3) || 'K' ELSE format('{:,.2f}', abs(value)) END || CASE WHEN unit = 'shares' THEN ' shares' ELSE '' END END"""
# RE2 looks neither ahead nor back: a stop within a number is first taken out, then the text is cut.
_CLAUSES = rf"string_split(regexp_replace(regexp_replace(lower(text), '[.;:!?]([0-9])', chr(2) || '\1', 'g'), '[.;:!?]\s*|\s+(?:{CONJUNCTIONS})\s*', chr(1), 'g'), chr(1))"


SQL = {
    "q26_clean_markup": f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN md5(coalesce(array_to_string(list_filter(list_transform(string_split({_UNESCAPE}, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), lambda x: x <> ''), chr(10)), '')) END AS digest FROM documents",
    "q27_section_extract": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos, length(text) AS whole FROM documents WHERE text IS NOT NULL),
a AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(line) - 1 AS at_ FROM l),
b AS (SELECT *, coalesce(min(CASE WHEN regexp_matches(line, '^{BOUNDARY}\\z') THEN at_ END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), whole) AS stop FROM a),
c AS (SELECT * FROM b WHERE regexp_matches(line, '^{HEADING}\\z') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY stop - at_ DESC, at_) = 1)
SELECT doc_id, at_::BIGINT AS start, (stop - at_)::BIGINT AS span, md5(trim(regexp_replace(substring(text, (at_ + 1)::BIGINT, (stop - at_)::BIGINT), '\\s+', ' ', 'g'))) AS digest FROM c JOIN documents USING (doc_id)""",
    "q28_sentences": f"SELECT doc_id, len({_SENTS})::BIGINT AS n, md5(array_to_string({_SENTS}, '|')) AS digest FROM documents WHERE text IS NOT NULL",
    "q30_word_stats": f"""WITH w AS (SELECT doc_id, coalesce(lower(lang), '-') AS lang, {_WORDS} AS w FROM documents),
t AS (SELECT lang, t, count(DISTINCT doc_id) AS df FROM (SELECT lang, doc_id, unnest(w) AS t FROM w) GROUP BY ALL), tt AS (SELECT lang, count(*) AS n_terms, max(df) AS max_df FROM t GROUP BY lang)
SELECT lang, count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_words, coalesce(any_value(n_terms), 0)::BIGINT AS n_terms, coalesce(any_value(max_df), 0)::BIGINT AS max_df FROM w LEFT JOIN tt USING (lang) GROUP BY lang""",
    "q31_bm25": f"WITH {_BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bm",
    "q32_cosine": _VEC.format(how="list_cosine_similarity(embedding::DOUBLE[], q)"),
    "q33_nearness": _VEC.format(how="1 / (1 + list_distance(embedding::DOUBLE[], q) ** 2)"),
    "q34_fusion": f"{_FUSED} SELECT query_id, doc_id, round(score, 9) AS score FROM fu",
    "q35_retrieve": f"{_FUSED}, r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_, doc_id) AS rank FROM fu) SELECT query_id, doc_id, round(score, 9) AS score, rank FROM r WHERE rank <= 6 AND score >= 0.014",
    "q70_hybrid": f"""{_HYBRID}, re AS (SELECT query_id, doc_id, at_, text, round(len(list_intersect({_ASKED}, {_WORDS})) / len({_ASKED}), 9)::DOUBLE AS score FROM po JOIN qe USING (query_id) JOIN documents USING (doc_id))
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, at_) AS rank, 'rerank' AS scored_by, md5(text) AS digest FROM re WHERE score >= 0.3 QUALIFY rank <= 6""",
    "q71_hybrid_fused": f"{_HYBRID} SELECT query_id, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, at_) AS rank, 'rrf' AS scored_by FROM po WHERE score >= 0.0125 QUALIFY rank <= 6",
    "q36_precision_recall": f"""WITH {_BM25}, g AS (SELECT item_key AS query_id, doc_id FROM tag_spec JOIN documents ON contains(lower(text), lower(label)))
SELECT g.query_id, count(bm.doc_id)::BIGINT AS hits, round(count(bm.doc_id) / 10, 6)::DOUBLE AS precision, round(count(bm.doc_id) / count(*), 6)::DOUBLE AS recall FROM g LEFT JOIN (SELECT * FROM bm WHERE rank <= 10) bm ON bm.query_id = g.query_id AND bm.doc_id = g.doc_id GROUP BY 1""",
    "q37_refusal_rate": f"""WITH q AS (SELECT item_key AS query_id, label AS query FROM tag_spec UNION ALL SELECT unnest(tags), unnest(tags) FROM tag_spec), t AS (SELECT DISTINCT unnest({_WORDS}) AS t FROM documents),
h AS (SELECT DISTINCT query_id FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '([a-z0-9]+)', 1)) AS t FROM q) JOIN t USING (t))
SELECT count(*)::BIGINT AS n_queries, count(*) FILTER (h.query_id IS NULL)::BIGINT AS n_refused, (count(*) FILTER (h.query_id IS NULL) / count(*))::DOUBLE AS rate FROM q LEFT JOIN h USING (query_id)""",
    "q38_quote_grounding": f"""WITH q AS (SELECT doc_id, doc_id - doc_id % 2 AS cited, ({_SENTS})[1] AS quote FROM documents WHERE text IS NOT NULL)
SELECT q.doc_id, CASE WHEN d.text IS NULL THEN 'unknown_chunk' WHEN length(quote) > 300 THEN 'too_long' WHEN length(trim(quote)) < 5 THEN 'too_short' WHEN NOT contains(d.text, quote) THEN 'not_verbatim' ELSE 'ok' END AS verdict
FROM q LEFT JOIN documents d ON d.doc_id = q.cited""",
    "q39_number_tokens": f"SELECT doc_id, len({_NUMBERS})::BIGINT AS n_numbers, md5(coalesce(array_to_string({_NUMBERS}, ' '), '')) AS digest FROM documents",
    "q40_number_grounding": f"""WITH r AS (SELECT cik, value, unit FROM (SELECT cik, {item('item_key')} AS item_key, value FROM resolved_value WHERE value IS NOT NULL) JOIN (SELECT item_key, unit FROM tag_spec) USING (item_key)),
f AS (SELECT cik, value < 0 AS negative, regexp_replace({_FIG.replace("value < 0", "false")}, ' shares$', '') AS token FROM r UNION SELECT cik, value < 0, '$' || format('{{:,.0f}}', abs(value)) FROM r),
p AS (SELECT doc_id, cik, {_NUMBERS} AS n, string_split_regex(coalesce(text, ''), '{NUMBER}') AS s FROM documents),
u AS (SELECT doc_id, cik, n[i] AS token, CASE WHEN i > 1 THEN right(n[i - 1], 1) ELSE '' END || s[i] AS b, s[i + 1] AS a FROM (SELECT *, unnest(range(1, len(n) + 1)) AS i FROM p)),
t AS (SELECT DISTINCT doc_id, cik, token, regexp_matches(b, '(^|[^0-9])[-−–]\\$? ?$') OR (ends_with(b, '(') AND starts_with(a, ')') AND NOT regexp_matches(token, '^[0-9]+$')) AS negative FROM u)
SELECT doc_id, count(*)::BIGINT AS n_tokens, count(f.token)::BIGINT AS n_grounded, count(*) FILTER (t.negative)::BIGINT AS n_negative FROM t LEFT JOIN f ON f.cik = t.cik AND f.token = t.token AND f.negative = t.negative GROUP BY doc_id""",
    "q41_claims": f"""WITH s AS (SELECT doc_id, unnest({_CLAUSES}) AS s FROM documents WHERE text IS NOT NULL),
v AS (SELECT doc_id, regexp_matches(s, '{UP}') AS u, regexp_matches(s, '{DOWN}') AS d, regexp_matches(s, '{LEVEL}') AS l, regexp_matches(s, '{NEGATION.replace("'", "''")}') OR regexp_matches(s, '{HEDGE}') AS x FROM s)
SELECT doc_id, count(*) FILTER (NOT x AND u AND NOT d AND NOT l)::BIGINT AS n_up, count(*) FILTER (NOT x AND d AND NOT u AND NOT l)::BIGINT AS n_down, count(*) FILTER (NOT x AND l AND NOT u AND NOT d)::BIGINT AS n_flat FROM v GROUP BY doc_id""",
    "q43_section_counts": "SELECT coalesce(section, '-') AS section, count(*)::BIGINT AS n_docs, sum(length(text))::BIGINT AS n_chars, count(*) >= 5 AND sum(length(text)) >= 2000 AS enough FROM documents GROUP BY 1",
    "q44_rates": """WITH b AS (SELECT text IS NOT NULL AND trim(text) <> '' AS t, source IS NOT NULL AS s, section IS NOT NULL AS c FROM documents)
SELECT count(*)::BIGINT AS n, count(*) FILTER (t)::BIGINT AS has_text_hits, count(*) FILTER (s)::BIGINT AS has_source_hits, count(*) FILTER (c)::BIGINT AS has_section_hits,
 round(count(*) FILTER (t) / count(*), 6)::DOUBLE AS has_text_rate, round(count(*) FILTER (s) / count(*), 6)::DOUBLE AS has_source_rate, round(count(*) FILTER (c) / count(*), 6)::DOUBLE AS has_section_rate FROM b""",
}
