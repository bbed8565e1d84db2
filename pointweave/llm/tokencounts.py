"""Token counts by a unigram model, with forward scores shared along a trie.

A pre-token is a word (a run of other than ``[\\x20\\x09-\\x0D]``) behind the piece that marks a word's start. Its
segmentation is the one of the greatest sum of piece scores, of equal ones the one of fewest pieces. A forward score
depends on the characters up to its place only, so the distinct pre-tokens of all documents that a worker sees are inserted
into a trie whose nodes hold the forward score and the number of pieces of their prefix: a shared prefix is computed once, and
a pre-token's count stands at its terminal node. Terminal counts are kept; a document is a sum of them.

The pieces are those of a public sentencepiece vocabulary, which orders them by rank but has no unigram scores; tokenizers
aren't trained here, so none are fitted. By Zipf's law the k-th piece's log-probability is about -log(k + 1); scores are that,
in whole thousandths, so sums are exact. A character that no piece covers is its UTF-8 bytes, a piece each, each scored
``BYTE_COST`` below zero.

What a worker keeps is bounded: the trie is begun anew at ``NODES`` nodes, terminal counts are a cache. What goes is computed
anew, so counts don't depend on it. Everything is local to a row: no shuffle, and a word that all documents share costs one
computation per worker.

Defined results: a null or empty text has no words and no tokens. Rows are independent of each other, so repeated rows get a
row each, and ids (null ones too) and other columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pointweave.llm.common import TwoGenerations, batched

MARK = "▁"
BYTE_COST = 20_000
#: Pre-tokens whose counts a worker keeps, twice; nodes of its trie; bits of a sum that hold the pieces.
CACHE, NODES, PIECE_BITS = 400_000, 100_000, 40
RESULT = "struct<n_words:bigint,n_tokens:bigint,cost:bigint>"


def load_costs(path: str) -> dict[str, int]:
    """Piece to cost, the negative score in thousandths. Control, unknown and byte pieces aren't text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    ranked = sorted(plain, key=lambda i: (-model.get_score(i), i))
    return {model.id_to_piece(i): round(1000 * math.log(k + 2)) for k, i in enumerate(ranked)}


class Pieces:
    """The vocabulary's pieces as a trie: ``step`` from a place by a character, ``whole`` the cost of a piece that ends."""

    def __init__(self, costs: dict[str, int]):
        self.step: dict[int, int] = {}
        self.whole: list[int | None] = [None]
        for piece, cost in costs.items():
            at = 0
            for char in piece:
                key = at << 21 | ord(char)
                at = self.step.get(key)
                if at is None:
                    at = self.step[key] = len(self.whole)
                    self.whole.append(None)
            self.whole[at] = cost


class Trie:
    """Prefixes of pre-tokens. A node has the cost and pieces of its prefix, and the vocabulary's pieces that may still go on
    behind it, each as the node where it begins and its place in the vocabulary."""

    def __init__(self, vocabulary: Pieces):
        self.vocabulary = vocabulary
        self.child: dict[int, int] = {}
        self.cost, self.pieces, self.going = [0], [0], [()]

    def insert(self, text: str) -> int:
        """The text's terminal node."""
        at, get = 0, self.child.get
        for char in text:
            code = ord(char)
            to = get(at << 21 | code)
            at = self.grow(at, char, code) if to is None else to
        return at

    def grow(self, at: int, char: str, code: int) -> int:
        step, whole, costs, pieces = self.vocabulary.step.get, self.vocabulary.whole, self.cost, self.pieces
        n = 1 if code < 128 else len(char.encode())
        best, count, open_ = costs[at] + n * BYTE_COST, pieces[at] + n, []
        for begin, place in (*self.going[at], (at, 0)):
            place = step(place << 21 | code)
            if place is not None:
                open_.append((begin, place))
                own = whole[place]
                if own is not None:
                    own += costs[begin]
                    if own < best or own == best and pieces[begin] + 1 < count:
                        best, count = own, pieces[begin] + 1
        node = self.child[at << 21 | code] = len(costs)
        costs.append(best)
        pieces.append(count)
        self.going.append(tuple(open_))
        return node


class Terminals(TwoGenerations):
    """Pre-token (as bytes, without its mark) to its terminal node's cost, shifted, and number of pieces."""

    def __init__(self, costs: dict[str, int], limit: int = CACHE, nodes: int = NODES):
        super().__init__(limit)
        self.vocabulary, self.nodes = Pieces(costs), nodes
        self.trie = Trie(self.vocabulary)

    def learn(self, words: set[bytes]) -> None:
        for raw in self.unknown(words):
            if len(self.trie.cost) > self.nodes:
                self.trie = Trie(self.vocabulary)
            trie = self.trie if len(raw) <= self.LONGEST else Trie(self.vocabulary)  # a long one's nodes go at once
            end = trie.insert(MARK + raw.decode())
            self[raw] = trie.cost[end] << PIECE_BITS | trie.pieces[end]

    def count(self, texts: list) -> list[tuple[int, int, int]]:
        self.rotate()
        found = [(t or "").encode().split() for t in texts]
        self.learn(set().union(*found))
        get, low = self.__getitem__, (1 << PIECE_BITS) - 1
        sums = [sum(map(get, words)) for words in found]
        return [(len(words), s & low, s >> PIECE_BITS) for words, s in zip(found, sums, strict=True)]


@functools.lru_cache(maxsize=2)
def terminals(path: str) -> Terminals:
    return Terminals(load_costs(path))


def token_counts(text: Column, path: str) -> Column:
    """A struct: n_words, n_tokens, cost (the negative log-likelihood of the segmentation, in thousandths)."""

    @F.arrow_udf(RESULT)
    def unigram_counts(texts: pa.Array) -> pa.Array:
        own = terminals(path)
        rows = [r for part in batched(texts) for r in own.count(part)]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["n_words", "n_tokens", "cost"])

    return unigram_counts(text.cast("string"))
