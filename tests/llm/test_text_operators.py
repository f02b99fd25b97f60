"""Tokenizer, chunks, survivors, mixing, stuffed pages: against public encoders, round trips, brute force and held-out pages."""

import base64
import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm.bpe import PATTERN, VOCABULARY, encode_corpus, encoder, token_counts
from tallyloom.llm.chunking import cut_places, split_oversized, split_text
from tallyloom.llm.mixing import fit_mix, fit_rates, mix, shares_reached
from tallyloom.llm.pagefeatures import NAMES, VOTES, page
from tallyloom.llm.places import natural_places
from tallyloom.llm.spam import spam_scores, stuffed_pages, weak_label
from tallyloom.llm.survivors import duplicate_survivors, keyed, learned_precedence, states, survivors

DOCS = "doc_id BIGINT, text STRING, source STRING, settings_id STRING"


@pytest.fixture(scope="session")
def public():
    tiktoken = pytest.importorskip("tiktoken")
    with open(VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@given(st.text(max_size=60) | st.lists(st.sampled_from(["a", "The", " ", "  ", "\n", "\t", " ", "ing", "日", "'s", "0", "é", "=", "😀", "aaaa"]), max_size=30).map("".join))
@settings(max_examples=400, deadline=None)
def test_encoding_is_exact(public, text):
    assert encoder().encode(text) == public(text)


def test_long_runs_are_exact(public):
    for text in ("a" * 5000, "ab" * 3000, "-" * 4000, " " * 3000 + "x", "日本" * 900, "Zz9" * 2000):
        assert encoder().encode(text) == public(text)


def test_corpus_encoding(spark, public):
    rows = [(1, "Net income rose."), (2, ""), (3, None), (3, None), (4, "<|endoftext|> x"), (None, "y")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").withColumn("ids", F.lit(1)).withColumn("t", F.lit("clash"))
    got = sorted(map(str, ((r["doc_id"], r["ids"]) for r in encode_corpus(df).collect())))
    assert got == sorted(map(str, ((i, public(t) if t else []) for i, t in rows)))
    counts = {(r["doc_id"], r["n_tokens"]) for r in token_counts(df.select("doc_id", "text")).collect()}
    assert counts == {(i, len(public(t)) if t else 0) for i, t in rows}
    assert encode_corpus(df.where("false")).count() == 0


@pytest.mark.parametrize(
    ("text", "starts"),
    [
        ("One here. Two there.", ["One", "Two"]),
        ("Held on Sept. 30, 2012, e.g. cash (see Fig. 3). It rose approx. 5.5%. U.S. sales fell.", ["Held", "It", "U.S."]),
        ("Der Kredit läuft am 30. Juni 2020 aus, v. a. z. B. hier. Bleibt das so? Ja.", ["Der", "Bleibt", "Ja"]),
        ("Liquidity\nCash rose.The rate fell.\n\n1. First item\n2. Second item", ["Liquidity", "Cash", "The", "1.", "2."]),
        ("A line that was wrapped because it\nwas long. Another one also wrapped\nhere again by someone.", ["A line", "Another"]),
        ("Note 4. Leases\nRent    1,000.5   2,000\nCash    5   6", ["Note 4.", "Rent", "Cash"]),
        ("売上は増加した。利益は減った。", ["売上", "利益"]),
        ("We said so. eVelora is ours.", ["We", "eVelora"]),
        ("Is it over? No! (It goes on.) Done.", ["Is", "No", "(It", "Done"]),
        ("", []),
        ("   \n  ", [" "]),
    ],
)
def test_natural_places(text, starts):
    found = [o for o, _ in natural_places(text)]
    assert len(found) == len(starts) and all(text[o:].startswith(s) for o, s in zip(found, starts)), [text[o : o + 12] for o in found]


@given(st.lists(st.sampled_from(["Cash rose. ", "It fell by 5.5% e.g. there. ", "\n\n", "x" * 90, "- item\n", "日本。", " "]), max_size=60).map("".join), st.integers(1, 40), st.integers(0, 30))
@settings(max_examples=300, deadline=None)
def test_pieces_cover_and_fit(text, target, overlap):
    pieces = split_text(text, target, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    if len(text) // 4 > target:
        assert all((b - a) // 4 <= target and a < b for a, b in pieces)
        assert all(c <= b and a < c and b < d for (a, b), (c, d) in zip(pieces, pieces[1:]))


def test_split_oversized(spark):
    text = "A sentence of some length here. " * 60
    docs = spark.createDataFrame([(1, text, None, None), (2, None, None, "tiny"), (3, "", None, "unheard"), (4, "short", None, "tiny")], DOCS).withColumn("target", F.lit("clash"))
    limits = spark.createDataFrame([("default", 100, 20), ("tiny", 10, 0)], "settings_id STRING, chunk_target_tokens INT, chunk_overlap_tokens INT")
    pieces = split_oversized(docs, limits).orderBy("doc_id", "piece").collect()
    assert [(r["doc_id"], r["text"]) for r in pieces if r["doc_id"] > 1] == [(2, None), (3, ""), (4, "short")]
    mine = [r for r in pieces if r["doc_id"] == 1]
    assert len(mine) > 1 and all(text[r["start_char"] : r["end_char"]] == r["text"] for r in mine)
    assert all(0 < a["end_char"] - b["start_char"] <= 100 for a, b in zip(mine, mine[1:]))
    assert [r["start_char"] for r in cut_places(docs, limits).orderBy("start_char").collect()] == list(range(0, len(text), 32))
    assert split_oversized(docs.where("false"), limits).count() == 0 and split_oversized(docs, limits.where("false")).count() == 4


ENTRY = "entry_id BIGINT, cik BIGINT, segment_id BIGINT, tag STRING, unit STRING, period_start STRING, period_end STRING, val DOUBLE, fy INT, fp STRING, form STRING, filed STRING, loaded_at TIMESTAMP_NTZ"


def _brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    out = set()
    for g in groups.values():
        if len(g) > 1:
            ok = lambda r: r[11] or "0"
            v = [r for r in g if r[7] is not None and r[7] == r[7]]
            f = [r for r in g if r[8] is not None]
            val = max(v, key=lambda r: (r[11] is not None, ok(r), r[0]))[0] if v else None
            fy = min(f, key=lambda r: (r[11] is None, ok(r), r[0]))[0] if f else None
            out.add((min(r[0] for r in g), val, fy))
    return out


def test_survivors(spark):
    rnd = random.Random(5)
    spell = [("us-gaap:NetResult", "USD"), ("netResult", "iso4217:USD"), ("net_result", " usd "), ("NET RESULT", "Usd")]
    rows = []
    for i in range(400):
        tag, unit = rnd.choice(spell)
        filed = rnd.choice([None, "2016-03-01", "2016-04-01", "2017-03-01"])
        rows.append((i, rnd.randint(1, 60), 1, tag, unit, rnd.choice([None, ""]), rnd.choice(["2015-12-31", "Dec 31, 2015", "20151231"]), rnd.choice([None, float("nan"), 1.0, 2.0]), rnd.choice([None, 2015, 2016]), "FY", rnd.choice(["10-K", "10-K/A"]), filed, None))
    df = spark.createDataFrame(rows, ENTRY).withColumn("rank", F.lit(1)).withColumn("state", F.lit("clash"))
    assert {tuple(r) for r in duplicate_survivors(df).collect()} == _brute(rows)
    assert duplicate_survivors(df.where("false")).count() == 0
    one = survivors(df.limit(1)).first()
    assert one["n_rows"] == 1


def test_undated_rows_follow_learned_precedence(spark):
    rows = []
    for i in range(20):  # amendments come after originals wherever there are dates
        rows += [(2 * i, i, 1, "T", "USD", None, "2015-12-31", 1.0, 2015, "FY", "10-K", "2016-01-01", None), (2 * i + 1, i, 1, "T", "USD", None, "2015-12-31", 2.0, 2015, "FY", "10-K/A", "2016-02-01", None)]
    rows += [(900, 99, 1, "T", "USD", None, "2015-12-31", 7.0, 2014, "FY", "10-K/A", None, None), (901, 99, 1, "T", "USD", None, "2015-12-31", 8.0, 2013, "FY", "10-K", "n/a", None)]
    df = spark.createDataFrame(rows, ENTRY)
    assert learned_precedence(states(keyed(df)))["form"] == {"10-K": set(), "10-K/A": {"10-K"}}
    got = survivors(df).where("cik = 99").first()
    assert (got["val_entry_id"], got["fy_entry_id"], got["val_undated"]) == (900, 901, True)
    assert duplicate_survivors(df).where("group_id = 900").first()[1:] == (901, 900)


def test_undated_rows_follow_values_of_years(spark):
    """Later filings give later fiscal years to the same fact; an undated row with a later year is the more current."""
    rows = []
    for i in range(12):
        rows += [(3 * i + j, i, 1, "T", "USD", None, "2015-12-31", 1.0, 2015 + j, "FY", "10-K", f"201{6 + j}-02-01", None) for j in range(3)]
    rows += [(901, 99, 1, "T", "USD", None, "2010-12-31", 7.0, 2012, "FY", "10-K", None, None), (902, 99, 1, "T", "USD", None, "2010-12-31", 8.0, 2010, "FY", "10-K", "n/a", None)]
    got = survivors(spark.createDataFrame(rows, ENTRY)).where("cik = 99").first()
    assert (got["val_entry_id"], got["val"], got["fy_entry_id"]) == (901, 7.0, 902)


def _corpus(spark, n=240):
    rnd = random.Random(3)
    kinds = {"risk": "loss failure dispute penalty regulator", "review": "revenue margin growth demand price", "tiny": "auditor opinion letter report firm"}
    rows = []
    for i in range(n):
        source = "tiny" if i % 40 == 0 else rnd.choice(["risk", "review"])
        text = " ".join(rnd.choice(kinds[source].split()) for _ in range(rnd.randint(20, 60))) + f" {i}"
        rows.append((i, text, source if i % 11 else None, None))
    rows += [(1000, rows[1][1], "risk", None), (1001, "", "risk", None), (1002, None, "risk", None), (1003, "unwanted words", "other", None)]
    return spark.createDataFrame(rows, DOCS)


def test_mix(spark):
    docs = _corpus(spark).withColumn("cap", F.lit("clash")).withColumn("p", F.lit(0)).withColumn("slot", F.lit(7))
    targets = spark.createDataFrame([("risk", 0.5, 2), ("review", 0.3, 1), ("tiny", 0.1, 3), ("absent", 0.1, 4)], "source STRING, target_share DOUBLE, max_repeats INT")
    mixed = mix(docs, targets).cache()
    caps, longest = {"risk": 2, "review": 1, "tiny": 3}, 0
    for r in mixed.collect():
        assert 1 <= r["uses"] <= caps[r["domain"]] and r["doc_id"] not in (1001, 1002, 1003)
        longest = max(longest, r["n_tokens"])
    assert mixed.where("doc_id in (1, 1000)").count() <= 1
    rows = shares_reached(docs, targets).collect()
    got, total = {r["source"]: r["share"] for r in rows}, sum(r["tokens"] for r in rows)
    assert got["absent"] == 0.0 and rows[0]["rounds"] > 0
    for s, want in (("risk", 0.5), ("review", 0.3), ("tiny", 0.1)):
        assert got[s] == pytest.approx(want / 0.9, abs=2 * longest / total)  # to within a text
    assert mix(docs.where("false"), targets).count() == 0 and mix(docs, targets.where("false")).count() == 0
    assert shares_reached(docs.where("false"), targets).count() == 4
    assert {r["domain"] for r in mix(docs, targets.where("source = 'risk'")).collect()} == {"risk"}


def test_every_text_is_soft(spark):
    rnd = random.Random(6)
    kinds = {"risk": "loss failure dispute penalty regulator", "review": "revenue margin growth demand price"}
    rows = []
    for i in range(300):
        source = rnd.choice(["risk", "review"])
        own, other = kinds[source].split(), kinds["review" if source == "risk" else "risk"].split()
        rows.append((i, " ".join(rnd.choice(own if rnd.random() < 0.6 else other) for _ in range(4)), source if i % 10 else None))
    texts = fit_mix(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING"), spark.createDataFrame([("risk", 0.6, 2), ("review", 0.4, 2)], "source STRING, target_share DOUBLE, max_repeats INT")).texts.collect()
    assert all(sum(r["p"]) == pytest.approx(1.0) for r in texts)
    assert sum(0.001 < min(r["p"]) for r in texts) > 0.9 * len(texts)  # those with a source too
    assert len({round(r["rate"], 6) for r in texts}) > 20  # rates follow the posteriors, not the source alone


def test_gradient_balances_overlapping_domains(spark):
    """Domains that overlap in all texts: uniform rates miss the targets by far, the rounds bring them near."""
    rnd = random.Random(8)
    rows = []
    for i in range(4000):
        best = rnd.randrange(3)
        p = [rnd.random() * 0.8 + (0.5 if j == best else 0.0) for j in range(3)]
        rows.append((i, rnd.randint(50, 500), [x / sum(p) for x in p], best, 2))
    texts = spark.createDataFrame(rows, "doc_id BIGINT, n_tokens BIGINT, p ARRAY<DOUBLE>, best INT, cap INT")
    shares = [0.38, 0.33, 0.29]
    neutral = fit_rates(texts, shares, rounds=0)
    fitted, goal, rounds, residual, start = fit_rates(texts, shares)
    assert neutral[2] == 0 and neutral[3] == start > 0.02 and rounds >= 2 and residual < start / 3
    got = fitted.select(*[F.sum(F.col("rate") * F.col("n_tokens") * F.get("p", F.lit(i))) for i in range(3)]).first()
    assert all(abs(g - w) <= 1.01 * residual * sum(goal) + 1e-6 for g, w in zip(got, goal))
    assert fitted.where("rate < 0 or rate > cap").count() == 0


PROSE = "The company held cash of $5.5 million at the end of the year. We depend on the supplier for our plant, and it could harm our sales if they were to end the contract. "
KEYWORDS = ["best broker, best broker, free best broker, top best broker, ", "#bestbroker #payrollapp #bestbroker #freepayrollapp ", "https://a12.example/best-broker https://b7.invalid/payroll-app ", "Audit Software in Oakburl | audit software near Elmtorn | audit software @ Ashwexh | "]
LISTS = ["Index of exhibits\n" + "".join(f"3.{i}  Lease and plant number {i} ........ {i * 7}\n" for i in range(20)), "(in millions)    FY2014   FY2015\n" + "".join(f"Item {i}    {i * 7}.5   {i}\n" for i in range(20))]


def test_features_tell_pages_apart():
    at = {n: i for i, n in enumerate(NAMES)}
    assert page(None) == page("") == page(" \n ") == ([], [])
    seen = [page(t) for t in (*(k * 12 for k in KEYWORDS), *LISTS, PROSE * 5, "日本語の文章を書いた。", "x", "…", "a" * 5000, "# # #")]
    assert all(len(f) == len(NAMES) and len(v) == len(VOTES) and all(0 <= x for x in f) for f, v in seen)
    assert all(page(k * 12)[0][at["median_glue"]] < 0.1 for k in KEYWORDS) and page(PROSE * 5)[0][at["median_glue"]] > 0.3
    # The median window stands for what over half of a page is.
    keywords = KEYWORDS[0] * 20
    mostly = [page(PROSE * n + "\n" + keywords)[0][at["median_glue"]] for n in (1, 40)]
    assert mostly[0] < 0.1 and mostly[1] > 0.3


def _pages(n=150):
    rnd = random.Random(2)
    rows, spam = [], set()
    for i in range(n):
        kind = i % 3
        text = PROSE * rnd.randint(1, 4) if kind == 0 else rnd.choice(LISTS) if kind == 1 else PROSE + "\n" + rnd.choice(KEYWORDS) * rnd.randint(12, 25)
        spam |= {i} if kind == 2 else set()
        rows.append((i, text, rnd.choice(["a", "b", None]), None))
    return rows, spam


def test_stuffed_pages_held_out(spark):
    rows, spam = _pages()
    rows += [(900, None, "a", None), (901, "", None, None), (902, " \n", "a", None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("label", F.lit("clash")).withColumn("f", F.lit(1)).withColumn("votes", F.lit("clash"))
    assert {r["doc_id"] for r in stuffed_pages(df).collect()} == spam
    assert {r["score"] for r in spam_scores(df.where("doc_id >= 900")).collect()} == {0.0}
    assert stuffed_pages(df.where("false")).count() == 0
    assert stuffed_pages(df.where("doc_id % 3 = 0")).count() == 0  # pages of one kind


#: Stuffed, but with neither promotion, nor a ruling phrase, nor links enough for a vote.
QUIET = ["penny share tips", "audit software", "balance sheet template", "payroll app", "margin calculator", "invoice loan", "stock screener", "tax filing help", "dividend calendar", "earnings date", "quarterly results", "buy shares"]


def test_trees_decide_where_votes_do_not(spark):
    rnd = random.Random(4)
    rows, spam = _pages()
    quiet = [(500 + i, " / ".join(rnd.sample(QUIET, 12) + rnd.sample(QUIET, 12) + rnd.sample(QUIET, 12)), "a", None) for i in range(5)]
    scores = {r["doc_id"]: r for r in spam_scores(spark.createDataFrame(rows + quiet, DOCS)).withColumn("label", weak_label(F.col("votes"))).collect()}
    assert {scores[r[0]]["label"] for r in quiet} == {None}  # the votes alone find none of them
    assert all(scores[r[0]]["score"] > 0.5 for r in quiet) and {i for i, r in scores.items() if i < 500 and r["score"] > 0.5} == spam


def test_hosts_decide_between_like_pages(spark):
    rows, spam = _pages()
    rows = [(i, t, "bad" if i in spam else "good", None) for i, t, *_ in rows]
    doubtful = PROSE * 2 + "\n" + "audit software / payroll app / invoice loan\n" * 9
    rows += [(700, doubtful, "bad", None), (701, doubtful, "good", None)]
    got = {r["doc_id"]: r for r in spam_scores(spark.createDataFrame(rows, DOCS)).where("doc_id >= 700").collect()}
    assert got[700]["tree_score"] == got[701]["tree_score"]  # without the hosts both would be decided alike
    assert got[700]["score"] > 0.5 > got[701]["score"]


def test_times_do_not_matter(spark):
    df = spark.createDataFrame([(1, 1, 1, "T", "USD", None, "2015-12-31", 1.0, 2015, None, None, "2016-01-01", dt.datetime(2020, 1, 1)), (2, 1, 1, "T", "USD", "", "2015-12-31", 2.0, None, None, None, "2016-01-01", None)], ENTRY)
    assert [tuple(r) for r in duplicate_survivors(df).collect()] == [(1, 2, 1)]
