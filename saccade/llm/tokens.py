"""Token counts by trie-shared dynamic programming over a unigram vocabulary.

Text is split into pre-tokens (words, with a word mark in front). The distinct pre-tokens of a batch that are not known yet are put
into a trie; each trie node is one prefix and gets the best unigram score of that prefix and its number of tokens, computed
once however many pre-tokens share it; terminal nodes give the counts. A document's count is the sum over its words. A
pre-token of ``LONG`` characters or more is a branch of its own, scored without keeping it in a trie.

The vocabulary comes from a public tokenizer file whose path is a parameter; nothing is trained, for tokenizers never are here. The
file has no probabilities, only the order of its pieces, so they follow Zipf's law: piece r has the score -log(r + 2). A
character without a piece is encoded as its UTF-8 bytes, each with ``BYTE_SCORE``. Of equally good segmentations the one with fewer
tokens counts. Pieces are looked up by 64-bit hashes.

Edge cases: null, empty or wordless text has 0 words and tokens; rows are counted one by one.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import powers

MARK = "▁"
BYTE_SCORE = -20.0
#: Distinct words whose counts a task keeps; a bound on memory, not on words.
CACHE = 500_000
#: Characters from which a pre-token is scored alone, and pre-tokens of one trie.
LONG, TRIE = 64, 50_000
_BASE, _BITS = np.uint64(0xD1342543DE82EF95), 22
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


class Vocabulary:
    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=0)
        self.table = Pieces(self) if pieces else None

    @classmethod
    def load(cls, model_file: str) -> Vocabulary:
        """Ordinary pieces of a sentencepiece model file."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        return cls({name: -math.log(rank + 2) for rank, name in enumerate(names)})


def _width(chars: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of code points."""
    return 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)


class Pieces:
    """A vocabulary as a table from the hash of a piece to its score."""

    def __init__(self, vocabulary: Vocabulary):
        self.longest = vocabulary.longest
        self.powers = powers(_BASE, self.longest + 1)
        hashes = np.array([self._hash(p) for p in vocabulary.pieces], np.uint64)
        order = np.argsort(hashes)
        self.keys, self.scores = hashes[order], np.array(list(vocabulary.pieces.values()), np.float64)[order]
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self._cell(self.keys)] = True

    @staticmethod
    def _hash(piece: str) -> int:
        out = 0
        for c in piece:
            out = (out * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return out

    @staticmethod
    def _cell(hashes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the hashes are pieces, their scores)."""
        likely = np.flatnonzero(self.seen[self._cell(hashes)])
        at = np.minimum(np.searchsorted(self.keys, hashes[likely]), len(self.keys) - 1)
        hit = self.keys[at] == hashes[likely]
        return likely[hit], self.scores[at[hit]]


def trie_counts(tokens: list[str], pieces: Pieces) -> np.ndarray:
    """Tokens of each of the sorted, distinct pre-tokens.

    In sorted order the pre-tokens of one prefix are neighbours: a trie node is the first of them at the prefix's depth. Nodes are
    handled depth by depth: each gets its forward score and its number of tokens from its ancestors, once; terminal nodes give the counts.
    """
    n, longest = len(tokens), pieces.longest
    lengths = np.array([len(t) for t in tokens], np.int64)
    begin = np.cumsum(lengths) - lengths
    chars = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    # forward values of the last depths, by pre-token: best score, fewest tokens at that score, hash of the prefix
    score, least, prefix = {0: np.zeros(n)}, {0: np.zeros(n, np.int64)}, {0: np.zeros(n, np.uint64)}
    out, same, live = np.zeros(n, np.int64), np.ones(n, bool), np.arange(n)
    for depth in range(1, int(lengths.max(initial=0)) + 1):
        live = live[lengths[live] >= depth]
        char = chars[begin[live] + depth - 1]
        before = np.maximum(live - 1, 0)
        shared = same[live] & (live > 0) & (lengths[before] >= depth)
        shared[shared] = chars[begin[before[shared]] + depth - 1] == char[shared]
        same[live] = shared
        own = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            own[live] = prefix[depth - 1][live] * _BASE + (char + 1).astype(np.uint64)
        nodes = live[~shared]
        best, tokens_, single = np.full(len(nodes), -np.inf), np.zeros(len(nodes), np.int64), np.zeros(len(nodes), bool)
        for size in range(min(depth, longest), 0, -1):
            with np.errstate(over="ignore"):
                found, value = pieces.find(own[nodes] - prefix[depth - size][nodes] * pieces.powers[size])
            if size == 1:
                single[found] = True
            value = value + score[depth - size][nodes[found]]
            count = least[depth - size][nodes[found]] + 1
            better = (value > best[found]) | ((value == best[found]) & (count < tokens_[found]))
            best[found[better]], tokens_[found[better]] = value[better], count[better]
        alone = np.flatnonzero(~single)
        width = _width(char[~shared][alone])
        value = score[depth - 1][nodes[alone]] + width * BYTE_SCORE
        better = value > best[alone]
        best[alone[better]], tokens_[alone[better]] = value[better], least[depth - 1][nodes[alone[better]]] + width[better]
        node = np.cumsum(~shared) - 1
        score[depth], least[depth], prefix[depth] = np.zeros(n), np.zeros(n, np.int64), own
        score[depth][live], least[depth][live] = best[node], tokens_[node]
        done = live[lengths[live] == depth]
        out[done] = least[depth][done]
        for values in (score, least, prefix):
            values.pop(depth - longest, None)
    return out


def long_count(token: str, vocabulary: Vocabulary) -> int:
    """Tokens of one long pre-token by the same forward scores; only those of the last places are held."""
    pieces, longest = vocabulary.pieces, vocabulary.longest
    last = deque([(0.0, 0)], maxlen=max(longest, 1))
    for end in range(1, len(token) + 1):
        best, least = -math.inf, 0
        for size, (score, count) in enumerate(reversed(last), 1):
            value = pieces.get(token[end - size : end])
            if value is not None:
                value += score
                if value > best or value == best and count + 1 < least:
                    best, least = value, count + 1
        if token[end - 1] not in pieces:
            width = len(token[end - 1].encode("utf-8", "surrogatepass"))
            if last[-1][0] + width * BYTE_SCORE > best:
                best, least = last[-1][0] + width * BYTE_SCORE, last[-1][1] + width
        last.append((best, least))
    return last[-1][1]


def count_words(words: Iterable[str], vocabulary: Vocabulary) -> dict[str, int]:
    """Tokens of each distinct word, the word mark in front of it."""
    distinct = set(words)
    out = {w: long_count(MARK + w, vocabulary) for w in distinct if len(w) >= LONG}
    short = sorted(w for w in distinct if len(w) < LONG)
    for lo in range(0, len(short), TRIE):
        part = short[lo : lo + TRIE]
        out.update(zip(part, trie_counts([MARK + w for w in part], vocabulary.table).tolist(), strict=True))
    return out


def token_counts(docs: DataFrame, model_file: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, n_words, n_tokens for every row of docs (doc_id, text); whole texts, without a shuffle."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                rows = batch.slice(lo, 512)
                words = [Counter(t.encode().split()) if t else Counter() for t in rows.column(1).to_pylist()]
                new = {w for c in words for w in c if w not in known}
                if len(known) + len(new) > CACHE:
                    known, new = {}, {w for c in words for w in c}
                if new:
                    text = {w.decode(): w for w in new}
                    known.update((text[w], n) for w, n in count_words(text, vocabulary.value).items())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([c.total() for c in words], pa.int64()), pa.array([sum(n * known[w] for w, n in c.items()) for c in words], pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
