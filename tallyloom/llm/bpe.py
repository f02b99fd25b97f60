"""Exact byte-pair encoding of whole texts with a public vocabulary, in time linear in the text."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the pattern that splits a text before the merges, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces kept with their ids in each Python worker; the store is emptied when full.
KEPT = 200_000

_loaded: dict[str, Encoder] = {}


class Encoder:
    """A vocabulary of ranked byte strings. Bytes are held as Latin-1 text, one character a byte, for the automaton."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.rank = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in pairs}
        self.piece = {r: s for s, r in self.rank.items()}
        self.automaton = ahocorasick.Automaton()
        for s, r in self.rank.items():
            self.automaton.add_word(s, r)
        self.automaton.make_automaton()
        self.split = regex.compile(PATTERN).findall
        self.run = regex.compile(r"(?:^|\s) (?:\s|$)").search
        self.shorter: dict[int, int | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}

    def merged(self, s: str) -> list[str]:
        """Merges by definition: the adjacent pair of lowest rank first, leftmost among equals. For short strings."""
        parts = list(s)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get(parts[i] + parts[i + 1], 1 << 40))
            if parts[best] + parts[best + 1] not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def adjacent(self, a: int, b: int) -> bool:
        """Whether token b may follow token a: whether merging their joint bytes gives just these two."""
        ok = self.fits.get((a, b))
        if ok is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            x, y = self.piece[a], self.piece[b]
            ok = self.fits[a, b] = self.merged(x + y) == [x, y]
        return ok

    def next_shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of a token."""
        if token not in self.shorter:
            s = self.piece[token]
            self.shorter[token] = next((self.rank[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.rank), None)
        return self.shorter[token]

    def encode_piece(self, s: str) -> list[int]:
        """The ids of one piece. From each place the longest token is tried first, then its shorter prefixes; a place from
        which nothing fits is closed for good and the token before it is shortened. A list of tokens is the encoding
        just where each neighbouring pair is, and there is one for each prefix, so a closed place never opens again."""
        whole = self.rank.get(s)
        if whole is not None:
            return [whole]
        longest: list[int] = [-1] * len(s)
        length = [0] * len(s)
        for end, r in self.automaton.iter(s):
            n = len(self.piece[r])
            if n > length[end - n + 1]:
                length[end - n + 1], longest[end - n + 1] = n, r
        open_ = bytearray(b"\1") * (len(s) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(s):
            end = at + len(self.piece[token])
            if open_[end] and (not out or self.adjacent(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < len(s) else -1
                continue
            shorter = self.next_shorter(token)
            while shorter is None:
                open_[at] = 0
                token = out.pop()
                at -= len(self.piece[token])
                shorter = self.next_shorter(token)
            token = shorter
        return out

    def encode_word(self, word: str) -> list[int]:
        """The ids of a stretch that begins a text or with the one blank before it; kept for the next time."""
        ids: list[int] = []
        for piece in self.split(word):
            found = self.known.get(piece)
            if found is None:
                found = self._keep(piece, self.encode_piece(piece.encode("utf-8").decode("latin-1")))
            ids += found
        return self._keep(word, ids)

    def _keep(self, s: str, ids: list[int]) -> list[int]:
        if len(s) <= 64:
            if len(self.known) >= KEPT:
                self.known.clear()
            self.known[s] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """A text is cut before each blank with something other than white space before or after it: no piece of the
        pattern reaches over one. What lies between is encoded once and kept."""
        first, *rest = text.split(" ")
        words = [first, *[" " + w for w in rest]]
        if self.run(text):
            joined = [first]
            for w in words[1:]:
                if (len(w) == 1 or w[1].isspace()) and (joined[-1] == "" or joined[-1][-1].isspace()):
                    joined[-1] += w
                else:
                    joined.append(w)
            words = joined
        ids: list[int] = []
        known, missed = self.known.get, self.encode_word
        for w in words:
            found = known(w)
            ids += missed(w) if found is None else found
        return ids


def encoder(path: str = VOCABULARY) -> Encoder:
    """The encoder of a vocabulary file, loaded once a process; where the file is not at ``path``, the installed one of its name."""
    if path not in _loaded:
        at = path
        if not os.path.exists(at):
            import public_tokenizers

            at = public_tokenizers.path(os.path.basename(path))
        _loaded[path] = Encoder(at)
    return _loaded[path]


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ``ids``): the token ids of every text, without special tokens. An empty and a NULL text give an empty list;
    repeated rows are kept. Nothing is shuffled; each Python worker loads the vocabulary once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                ids = pa.array([encode(t) if t else [] for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    slim = docs.select(F.col(key), F.col(text).alias("t"))
    return slim.mapInArrow(run, T.StructType([T.StructField(key, slim.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def token_counts(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows with ``n_tokens`` (BIGINT) in place of their text; 0 for NULL and empty texts."""
    rest = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for b in batches:
            n = pa.array([len(encode(t)) if t else 0 for t in b.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], n], names=[*rest, "n_tokens"])

    fields = [docs.schema[c] for c in rest] + [T.StructField("n_tokens", T.LongType())]
    return docs.select(F.col(text), *rest).mapInArrow(run, T.StructType(fields))
