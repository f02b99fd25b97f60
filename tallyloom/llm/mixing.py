"""Records of several sources combined to target shares of all tokens, with soft membership of every text in every source."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.bpe import VOCABULARY, encoder
from tallyloom.session import checkpointed

#: Buckets of token ids a text's domain is told from, and labelled texts the classifier is fitted on at most.
BUCKETS, TRAINING_PAGES = 1 << 12, 20_000
#: How many independent words a text may count as: its likelihood is tempered to one of these, whichever tells held-out labels best.
WORDS = (0.0, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0)
#: How far a recorded source is trusted as evidence of the domain; a wrong one is taken to be any source's, by their sizes.
TRUST = 0.95
#: Most gradient steps, and the largest gap, as a share of the mix, at which they end.
ROUNDS, CLOSE = 60, 1e-5
BITS = 12


@dataclass
class Mix:
    """``texts``: (``doc_id``, ``n_tokens``, ``p``, ``best``, ``domain``, ``cap``, ``rate``) of every text that may be used;
    ``goal``: tokens that each domain is to have; ``rounds`` taken; ``residual``: the largest gap left, as a share of the total;
    ``start``: the same before the first step."""

    texts: DataFrame
    domains: list[str]
    caps: list[int]
    goal: list[float]
    rounds: int
    residual: float
    start: float


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def _lists(matrix: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32()), pa.array(matrix.ravel()))


def _numbers(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _learned(slim: DataFrame, k: int, vocabulary: str) -> np.ndarray:
    """(fold, domain, bucket): log probabilities of token buckets, each fold's learned from the other fold's texts; a text
    counts a bucket once. Fitted on at most ``TRAINING_PAGES`` labelled texts, a uniform sample by hash; its table of
    counts has at most 2 x domains x ``BUCKETS`` rows."""
    labelled = slim.where("slot is not null")
    share = min(1.0, TRAINING_PAGES / max(1, labelled.count()))
    sample = labelled.where(F.pmod(F.xxhash64(F.lit("train"), "digest"), F.lit(1_000_000)) < F.lit(int(1_000_000 * share)))

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for b in batches:
            found = [sorted({i % BUCKETS for i in encode(t)}) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("fold"), b.column("slot"), pa.array(found, pa.list_(pa.int32()))], names=["fold", "slot", "buckets"])

    seen = sample.select("fold", "slot", "text").mapInArrow(buckets, "fold INT, slot INT, buckets ARRAY<INT>")
    counted = seen.select("fold", "slot", F.explode("buckets").alias("b")).groupBy("fold", "slot", "b").agg(F.count(F.lit(1)).alias("n"))
    counts = np.ones((2, k, BUCKETS))
    for r in counted.collect():
        counts[1 - r["fold"], r["slot"], r["b"]] += r["n"]
    return np.log(counts / counts.sum(axis=2, keepdims=True))


def scored_texts(docs: DataFrame, goals: DataFrame, domains: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per distinct non-empty text: ``doc_id`` (the lowest of those whose source is in ``goals``, else of those
    without a source), ``source`` (NULL if unknown), ``slot`` (its place in ``domains``), ``n_tokens`` and ``ll``, the
    mean log likelihood of its token buckets in each domain, by a classifier that has not seen it. Copies count as one
    text, so that none passes its cap under another id; a text that only sources without a target have is left out.

    Each text is read, tokenized and scored once, in its task; only ids and scores are shuffled, combined before, and a
    text's copies never meet in one task."""
    slot = reduce(lambda done, i: done.when(F.col("source") == domains[i], F.lit(i)), range(len(domains)), F.when(F.lit(False), F.lit(0)))
    slim = docs.where(F.length("text") > 0).select("doc_id", "source", slot.alias("slot"), F.sha2("text", 256).alias("digest"), "text")
    slim = slim.where("slot is not null or source is null").withColumn("fold", F.pmod(F.xxhash64("digest"), F.lit(2)).cast("int"))
    theta = _learned(slim, len(domains), vocabulary)
    kept = ["doc_id", "source", "slot", "digest"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for b in batches:
            n, ll = [], []
            for text, fold in zip(b.column("text").to_pylist(), b.column("fold").to_pylist(), strict=True):
                ids = encode(text)
                n.append(len(ids))
                at = np.unique(np.array(ids, dtype=np.int64) % BUCKETS)
                ll.append(theta[fold][:, at].mean(axis=1).tolist() if len(at) else [0.0] * len(domains))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(n, pa.int64()), pa.array(ll, pa.list_(pa.float64()))], names=[*kept, "n_tokens", "ll"])

    types = {f.name: f.dataType.simpleString() for f in slim.schema}
    counted = slim.select(*kept, "fold", "text").mapInArrow(score, ", ".join(f"{c} {types[c]}" for c in kept) + ", n_tokens BIGINT, ll ARRAY<DOUBLE>").where("n_tokens > 0")
    best = F.struct(F.col("slot").isNull().alias("u"), "doc_id", "source", "slot", "n_tokens", "ll")
    return counted.groupBy("digest").agg(F.min(best).alias("b")).select("b.doc_id", "b.source", "b.slot", "b.n_tokens", "b.ll")


def domain_posteriors(texts: DataFrame, k: int, trust: float = TRUST) -> DataFrame:
    """``texts`` with ``p``, the posterior of each domain given the text and, where there is one, its recorded source.

    A text's likelihood is tempered to that number of independent ``WORDS`` which gives the recorded sources the highest
    mean log probability; as every text is scored by a classifier that has not seen it, the posteriors are calibrated by
    held-out labels. A recorded source is evidence that holds with probability ``trust``, so it is no certainty either."""
    counts = {r["slot"]: r["n"] for r in texts.where("slot is not null").groupBy("slot").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = np.array([counts.get(i, 0) + 1.0 for i in range(k)])
    prior = np.log(sizes / sizes.sum())
    told = np.log(1 + trust / (1 - trust) * sizes.sum() / sizes)

    def held_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(WORDS)), 0
        for b in batches:
            ll, slot = _matrix(b.column("ll"), k), b.column("slot").to_numpy()
            n += len(slot)
            for i, w in enumerate(WORDS):
                total[i] += np.log(np.maximum(_softmax(prior + w * ll)[np.arange(len(slot)), slot], 1e-300)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(WORDS)), pa.int32()), pa.array(total)], names=["i", "log"])

    known = texts.where("slot is not null").select("slot", "ll")
    fit = {r["i"]: r["log"] for r in known.mapInArrow(held_out, "i INT, log DOUBLE").groupBy("i").agg(F.sum("log").alias("log")).collect()}
    words = WORDS[max(range(len(WORDS)), key=lambda i: fit.get(i, 0.0))]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = prior + words * _matrix(b.column("ll"), k)
            slot = b.column("slot").to_numpy(zero_copy_only=False)
            at = np.flatnonzero(b.column("slot").is_valid().to_numpy(zero_copy_only=False))
            own = slot[at].astype(int)
            scores[at, own] += told[own]
            yield pa.RecordBatch.from_arrays([*b.columns, _lists(_softmax(scores))], names=[*b.schema.names, "p"])

    return texts.mapInArrow(placed, texts.withColumn("p", F.array().cast("array<double>")).schema)


def _rates(batch: pa.RecordBatch, k: int, start: float, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of a batch as a matrix, and its texts' rates after all steps so far."""
    p, cap = _matrix(batch.column("p"), k), batch.column("cap").to_numpy(zero_copy_only=False).astype(float)
    rate = cap * start
    for step in steps:
        rate = np.clip(rate + cap * (p @ step), 0.0, cap)
    return p, rate


def fit_rates(texts: DataFrame, shares: list[float], rounds: int = ROUNDS) -> tuple[DataFrame, list[float], int, float, float]:
    """``texts`` with ``rate``, each text's expected uses from 0 to its ``cap``; the tokens each domain is to have, the
    rounds taken, the largest gap left and that of the start, as shares of the mix.

    ``texts`` has ``n_tokens``, ``p`` over the domains, ``best`` (the domain it is counted for) and ``cap``. Projected
    gradient on least squares: the residuals are the gaps of the domains' expected tokens (by ``p``) from their targets,
    weighted by the inverse of what one unit of each moves; with that weighting the step is 1 and each round lessens
    them. All rates start at one share of their caps. The rounds end when the largest gap is ``CLOSE``, or no longer
    falls by a twentieth. The total is the largest at which every domain with texts can be counted, and is expected, to
    reach its target: its own texts at their caps, those of others at their start.

    A round is one aggregation to one number per domain. A text's rate follows from its own row and the few numbers of
    the rounds before, so no rates are kept or shuffled.
    """
    k = len(shares)
    weight, best = F.col("n_tokens") * F.col("cap"), F.col("best")
    p = lambda i: F.get("p", F.lit(i))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    own = lambda x, name: [F.sum(F.when(best == i, x(i))).alias(f"{name}{i}") for i in range(k)]
    sums = texts.agg(*own(lambda i: weight, "c"), *own(lambda i: weight * p(i), "o"), *[F.sum(weight * p(i)).alias(f"e{i}") for i in range(k)], *[F.sum(weight * p(i) * p(j)).alias(f"p{i}_{j}") for i, j in pairs]).first()
    counted, own_, expected = (np.array([float(sums[f"{n}{i}"] or 0.0) for i in range(k)]) for n in "coe")
    live = [i for i in range(k) if counted[i] > 0 and shares[i] > 0]
    if not live:
        return texts.withColumn("rate", F.lit(0.0)), [0.0] * k, 0, 0.0, 0.0
    told = sum(shares[i] for i in live)
    at_most = lambda most: min(most[i] * told / shares[i] for i in live)
    filled = at_most(counted) / counted.sum()
    total = at_most(np.minimum(counted, own_ + filled * (expected - own_)))
    goal = np.array([shares[i] / told * total if i in live else 0.0 for i in range(k)])
    gram = np.zeros((k, k))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = float(sums[f"p{i}_{j}"] or 0.0)
    inverse = np.linalg.pinv(gram, rcond=1e-9, hermitian=True)
    start, steps, gaps_seen = float(total / counted.sum()), [], []

    def spent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(k)
        for b in batches:
            q, rate = _rates(b, k, start, steps)
            whole += (rate * b.column("n_tokens").to_numpy()) @ q
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(whole)], names=["i", "tokens"])

    slim = texts.select("p", "cap", "n_tokens")
    while True:
        now = {r["i"]: r["tokens"] for r in slim.mapInArrow(spent, "i INT, tokens DOUBLE").groupBy("i").agg(F.sum("tokens").alias("tokens")).collect()}
        gaps = goal - np.array([now.get(i, 0.0) for i in range(k)])
        gaps_seen.append(float(np.abs(gaps).max() / total))
        stalled = len(gaps_seen) > 3 and gaps_seen[-1] > 0.95 * gaps_seen[-2]
        if gaps_seen[-1] <= CLOSE or stalled or len(steps) == rounds:
            break
        steps.append(inverse @ gaps)

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_rates(b, k, start, steps)[1])], names=[*b.schema.names, "rate"])

    return texts.mapInArrow(rated, texts.withColumn("rate", F.lit(0.0)).schema), goal.tolist(), len(steps), gaps_seen[-1], gaps_seen[0]


def fit_mix(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> Mix:
    """Every text's posteriors and rate; see ``mix``."""
    goals = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("cap"))
    there = docs.where(F.length("text") > 0).select("source").distinct()
    rows = goals.join(there, "source", "left_semi").orderBy("source").collect()  # at most the target table's dozen
    domains, shares, caps = [r["source"] for r in rows], [float(r["share"] or 0.0) for r in rows], [max(0, int(r["cap"])) for r in rows]
    if not rows:
        none = docs.where("false").select("doc_id", F.lit(0).cast("bigint").alias("n_tokens"), F.array().cast("array<double>").alias("p"), F.lit(0).alias("best"), F.lit("").alias("domain"), F.lit(0).alias("cap"), F.lit(0.0).alias("rate"))
        return Mix(none, [], [], [], 0, 0.0, 0.0)
    told = domain_posteriors(checkpointed(scored_texts(docs, goals, domains, vocabulary)), len(domains))
    best = F.coalesce("slot", F.array_position("p", F.array_max("p")).cast("int") - 1)
    texts = told.select("doc_id", "n_tokens", "p", best.alias("best"))
    placed = texts.withColumn("cap", F.get(F.array(*[F.lit(c) for c in caps]), F.col("best"))).withColumn("domain", F.get(F.array(*[F.lit(d) for d in domains]), F.col("best")))
    fitted, goal, rounds, residual, start = fit_rates(checkpointed(placed), shares)
    return Mix(checkpointed(fitted), domains, caps, goal, rounds, residual, start)


def _cuts(turns: DataFrame, goal: Column) -> DataFrame:
    """Per ``best``, the place in the order ``h`` up to which the tokens of its uses reach its goal.

    Two histograms of ranges of ``h`` find it, bounded however large a domain is; the first has a dozen x 4096 rows."""
    high, low = F.shiftright("h", 62 - BITS), F.shiftright("h", 62 - 2 * BITS).bitwiseAND((1 << BITS) - 1)
    coarse = turns.groupBy("best", high.alias("b")).agg(F.sum("n_tokens").alias("t"))
    run = coarse.withColumn("upto", F.sum("t").over(Window.partitionBy("best").orderBy("b"))).withColumn("want", goal).where("upto > want")
    first = run.groupBy("best").agg(F.min("b").alias("b"), F.min_by(F.col("want") - (F.col("upto") - F.col("t")), "b").alias("left"))
    fine = turns.withColumn("b", high).join(F.broadcast(first), ["best", "b"]).groupBy("best", "b", "left", low.alias("c")).agg(F.sum("n_tokens").alias("t"))
    at = fine.withColumn("upto", F.sum("t").over(Window.partitionBy("best").orderBy("c"))).where("upto - t / 2 >= left").groupBy("best").agg(F.min("c").alias("c"))
    cut = first.join(at, "best", "left").withColumn("c", F.coalesce("c", F.lit(1 << BITS)))
    return cut.select("best", (F.shiftleft(F.col("b").cast("bigint"), 62 - BITS) + F.shiftleft(F.col("c").cast("bigint"), 62 - 2 * BITS)).alias("below"))


def dealt(mix: Mix) -> DataFrame:
    """The texts of the mix with whole ``uses``.

    Each use that a text's cap allows has a turn: how many uses come before it, plus a number drawn by the text's hash,
    less its rate. Uses with a turn under 0 make up the rates by chance alone; in the order of turns each domain's are
    taken up to where its counted tokens are its goal, so they are met to within a text and higher rates come first."""
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    longest = F.lit(float(max([1, *mix.caps])))
    turn = lambda n: F.least(F.lit((1 << 62) - 1), ((F.col("lead") + n + longest) / (2 * longest + 1) * F.lit(float((1 << 62) - 1))).cast("bigint"))
    placed = mix.texts.withColumn("lead", drawn - F.col("rate")).where("cap > 0")
    turns = F.transform(F.sequence(F.lit(0), F.col("cap") - 1), turn)
    cuts = _cuts(placed.select("best", "n_tokens", F.explode(turns).alias("h")), F.get(_numbers(mix.goal), F.col("best")))
    below = F.coalesce("below", F.when(F.get(_numbers(mix.goal), F.col("best")) > 0, F.lit(1 << 62)).otherwise(F.lit(0)))  # none lies beyond the goal
    uses = F.size(F.filter(turns, lambda h: h < below))
    return placed.join(F.broadcast(cuts), "best", "left").withColumn("uses", uses).where("uses > 0").select("doc_id", "domain", "n_tokens", "uses", "p")  # a row per domain


def mix(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(``doc_id``, ``domain``, ``n_tokens``, ``uses``): the mix. Every text that is used, how often, and the source it
    counts for: its own, or of a document without one its likeliest.

    Every text belongs softly to all domains, by a classifier's posteriors; rates of use are fitted so that the domains'
    expected tokens, and the tokens counted for each source, meet the targets. Documents of a source without a target,
    empty and NULL texts are not used; a target without documents cannot be met, and its share falls to the others in
    proportion. A NULL ``max_repeats`` counts as 1.
    """
    return dealt(fit_mix(docs, targets, vocabulary)).drop("p")


def shares_reached(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per source of the targets: its target share; tokens, share, texts and most uses of what is counted for it;
    ``expected_share`` by posteriors; and of the fit, the same in all rows, ``rounds`` and ``residual`` (the largest gap
    left, as a share of the mix)."""
    fitted = fit_mix(docs, targets, vocabulary)
    mixed = checkpointed(dealt(fitted))
    used = F.col("n_tokens") * F.col("uses")
    got = mixed.groupBy(F.col("domain").alias("source")).agg(F.sum(used).alias("tokens"), F.count(F.lit(1)).alias("texts"), F.max("uses").alias("most_uses"))
    whole = mixed.agg(F.sum(used).alias("whole"), *[F.sum(used * F.get("p", F.lit(i))).alias(f"e{i}") for i in range(len(fitted.domains))])
    named = F.create_map(*[x for i, d in enumerate(fitted.domains) for x in (F.lit(d), F.col(f"e{i}"))]) if fitted.domains else F.lit(None).cast("map<string,double>")
    joined = targets.select("source", "target_share", "max_repeats").join(got, "source", "left").crossJoin(whole.select("whole", named.alias("expected")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(
        "source", "target_share", "max_repeats", zero(F.col("tokens")).alias("tokens"), zero(F.col("texts")).alias("texts"), zero(F.col("most_uses")).alias("most_uses"),
        zero(F.try_divide("tokens", "whole")).alias("share"), zero(F.try_divide(F.try_element_at("expected", "source"), "whole")).alias("expected_share"),
        F.lit(fitted.rounds).alias("rounds"), F.lit(fitted.residual).alias("residual"),
    )
