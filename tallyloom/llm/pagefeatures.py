"""What tells prose, honest lists and stuffed keywords apart within one page: features of its windows, and weak votes."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import chain, pairwise

import numpy as np

# Words without which sentences of the corpus languages can hardly be written.
FUNCTION_WORDS = frozenset(
    "the a an of to and or in on for by with from at as is are was were be been it its this that these those we our us you your they their he his her not but if while because since than then there may could would will can has have had do did does which who what into over under per against between under such any all more most so no "
    "der die das den dem des ein eine einen einem einer und oder zu im in am an auf aus bei mit nach von vom vor zum zur für über um durch gegen bis ist sind war waren wird wurde wurden werden hat haben hatte wir uns unser unsere sich nicht auch als wie dies diese dieser könnten könnte sollte wegen ohne wenn sowie "
    "le la les un une des du de et ou à au aux en dans par pour sur avec sans est sont était ont été a nous notre nos vous votre il elle ils se ce cette ces qui que dont ne pas plus si comme pourrait pourraient serait hors "
    "el los las un una unos unas del y o al en con por para sin sobre es son fue fueron ha han se su sus que no más si como este esta estos nuestra nuestro podría podríamos habría sido hasta frente otros".split()
)
# Words that sellers of traffic put around their keywords.
PROMOTION = frozenset("free cheap best top online discount official fast instant near-me compare review new deals offers tags labels tag label keywords".split())
LINK = re.compile(r"<a\s[^>]*>.*?</a>|\[[^\]]*\]\([^)]*\)|https?://\S+|www\.\S+|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}/\S*", re.IGNORECASE)
#: A window without any of these is not searched for links.
LINK_HINTS = ("://", "www.", "<a", "](", ".com")
PARTICLE, HAN = re.compile(r"[はがをにのでともや]"), re.compile(r"[぀-ヿ㐀-鿿]")
#: Marks between words become blanks, save ``#`` and ``-``, which are parts of tags and names.
APART = str.maketrans({c: " " for c in "|@»«★•/–—,;:!?()[]{}<>\"'“”„’‘`*=+~_。、，！？（）「」"} | {"\u00a0": " "})

#: Measures of a window; a page has the mean and the median of each over its characters.
MEASURES = ("glue", "linked", "tagged", "again", "once", "figures", "marks", "commas", "length", "ends")
NAMES = [f"mean_{m}" for m in MEASURES] + [f"median_{m}" for m in MEASURES] + ["vocabulary", "squeezed", "size"]
#: Votes for (1) and against (-1) a page being stuffed.
VOTES = ("links", "hashtags", "ruling_phrase", "promotion", "sentences", "figures", "varied")
WINDOW, WIDE = 16, 60
ENDS, MARKS = (". ", "! ", "? ", "。"), "|@»★•/–#"
#: Places of the counts that are summed as one number; no window has as many words.
ONCE, FIGURE = 1 << 28, 1 << 56


def _apart(text: str) -> str:
    """``text`` with a blank for each mark of ``APART``; ``translate`` is quick on ASCII alone."""
    if text.isascii():
        return text.translate(APART)
    for c in APART:
        text = text.replace(chr(c), " ")
    return text


def _windows(text: str) -> list[str]:
    """Every line that is not blank; a long one in stretches of words, or of characters where it has no blanks."""
    out = []
    for line in text.split("\n"):
        words = line.split()
        if not words:
            continue
        if len(line) > 4 * WIDE and len(line) > 2 * WIDE * len(words) // 3:
            out += [line[i : i + WIDE] for i in range(0, len(line), WIDE)]
        elif len(words) < WINDOW + 8:
            out.append(line)
        else:
            edges = [*range(0, len(words) - WINDOW // 2, WINDOW), len(words)]
            out += [" ".join(words[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    return out


def page(text: str | None) -> tuple[list[float], list[int]]:
    """The page's features (``NAMES``) and its votes (``VOTES``, 0 for none); both empty for a NULL, empty or blank page.

    Features describe windows of about a line: the share of function words (of particles among Japanese letters), of link and
    hashtag characters, of word pairs that come back on the page, of words that occur once, of figures, the rate of
    separators, commas and sentence ends, the length of words. The median window stands for what over half of the page
    is. Votes are counts over the page as a whole, and no feature holds any of them.
    """
    windows = _windows(text or "")
    if not windows:
        return [], []
    joined, none = "\n".join(windows), [0] * len(windows)
    ascii_page, links, bare = joined.isascii(), none, joined
    if any(map(joined.__contains__, LINK_HINTS)):
        links = [sum(map(len, LINK.findall(w))) if any(map(w.__contains__, LINK_HINTS)) else 0 for w in windows]
        bare = "\n".join([LINK.sub(" ", w) if n else w for w, n in zip(windows, links, strict=True)])
    low = [x.split() for x in _apart(bare.lower()).split("\n")]
    words, pairs = Counter(chain.from_iterable(low)), Counter(chain.from_iterable(map(pairwise, low)))
    n_words, n_pairs = max(1, words.total()), max(1, pairs.total())
    back, tags = {p for p, c in pairs.items() if c > 2}, {w for w in words if w[0] == "#"} if "#" in joined else set()
    digits = {w for w in words if w[0].isdigit() and not any(map(str.isalpha, w))}
    # What is counted of a word, in one number: a function word, one that occurs once, a figure.
    kinds = {w: (w in FUNCTION_WORDS) + (c == 1) * ONCE for w, c in words.items()}
    for w in digits:
        kinds[w] += FIGURE
    kind = kinds.__getitem__
    counted = [sum(map(kind, lo)) for lo in low]
    known_ends, known_marks = [e for e in ENDS if e in joined], [m for m in MARKS if m in joined]
    ends = [sum(map(w.count, known_ends)) + (w[-1] in ".!?") for w in windows]
    n_ends = sum(ends)
    counts = np.array(
        [
            [len(w) for w in windows],
            [len(lo) for lo in low],
            [c % ONCE for c in counted],
            links,
            [sum(len(w) for w in lo if w in tags) for lo in low] if tags else none,
            [sum(map(back.__contains__, pairwise(lo))) for lo in low] if back else none,
            [c // ONCE % ONCE for c in counted],
            [c // FIGURE for c in counted],
            [sum(map(w.count, known_marks)) for w in windows] if known_marks else none,
            [w.count(",") for w in windows] if "," in joined else none,
            ends,
        ],
        dtype=float,
    )
    sizes, n = counts[0], np.maximum(1.0, counts[1])
    total = float(sizes.sum())
    values = np.empty((len(windows), len(MEASURES)))
    values[:, 0] = counts[2] / n
    values[:, 1:3] = np.minimum(1.0, counts[3:5] / sizes).T
    values[:, 3] = counts[5] / np.maximum(1.0, n - 1)
    values[:, 4:6] = (counts[6:8] / n).T
    values[:, 6:8] = np.minimum(2.0, counts[8:10] / n).T
    values[:, 8] = np.minimum(30.0, sizes / n)
    values[:, 9] = np.minimum(1.0, counts[10] / n)
    if not ascii_page:
        for i in np.flatnonzero(counts[2] == 0).tolist():
            if not windows[i].isascii() and (han := len(HAN.findall(windows[i]))) * 4 > len(windows[i]):
                values[i, 0] = min(1.0, 2 * len(PARTICLE.findall(windows[i])) / han)
    order = np.argsort(values, axis=0, kind="stable")
    at = (np.cumsum(sizes[order], axis=0) >= total / 2).argmax(axis=0)
    each = np.arange(len(MEASURES))
    medians = values[order[at, each], each]
    raw = joined.encode("utf-8", "replace")
    f = [*(sizes @ values / total).tolist(), *medians.tolist(), len(words) / n_words, len(zlib.compress(raw, 1)) / len(raw), min(1.0, total / 10_000)]
    glued = f[MEASURES.index("glue")]
    votes = [
        int(2 * sum(links) > total),
        int(3 * sum(words[w] for w in tags) > n_words),
        int(n_pairs >= 20 and 12 * max(pairs.values(), default=0) > n_pairs),
        int(n_words >= 20 and 10 * sum(words[w] for w in PROMOTION) > n_words),
        -int(40 * n_ends > n_words and glued > 0.12),
        -int(4 * sum(words[w] for w in digits) > n_words),
        -int(not any(links) and not tags and 10 * len(pairs) >= 8 * pairs.total()),
    ]
    return f, votes
