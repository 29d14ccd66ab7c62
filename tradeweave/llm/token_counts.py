"""Token counts of a unigram tokenizer by count-only Viterbi (operator 5).

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each
character; dynamic programming carries the best score and the number of pieces
on the path to it, and nothing else.

Rules of the tokenizer, kept exactly: spaces become the mark U+2581, one more in front;
of two paths of equal score the one whose last piece starts earlier wins; a
character that no piece spells costs UNKNOWN_COST more than the worst
piece and counts as its UTF-8 bytes (byte fallback).  Scores are multiples of
2**-10, so sums are exact and ties are true ties.

No piece holds a mark after another character, so the best path is the best
path of each stretch of marks with the characters behind it; stretches
repeat and are remembered up to a bound.  Null and empty texts have no tokens.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import Column, DataFrame

from tradeweave.llm.arrow_map import per_text

MARK = "▁"
UNKNOWN_COST = 10.0
KNOWN_STRETCHES, KNOWN_LENGTH = 300_000, 48
STRETCH = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def unigram_vocabulary(model: str | None = None) -> list[tuple[str, float]]:
    """Pieces of a model file with unigram scores.

    The public file orders pieces by rank and has no probabilities; a piece's
    score is the logarithm of Zipf's law at its rank, in steps of 2**-10.
    Control, unknown and byte pieces spell no text.
    """
    import sentencepiece

    read = sentencepiece.SentencePieceProcessor(model_file=model or default_model())
    pieces = [read.id_to_piece(i) for i in range(read.get_piece_size()) if not (read.is_control(i) or read.is_unknown(i) or read.is_byte(i))]
    return [(piece, -round(1024 * math.log(rank + 2)) / 1024) for rank, piece in enumerate(pieces)]


class Viterbi:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.matches = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.single = {piece for piece, _ in vocabulary if len(piece) == 1}
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_COST
        self.separable = not any(MARK in piece.lstrip(MARK) for piece, _ in vocabulary)

    def count(self, text: str) -> int:
        """Pieces on the best path of a text whose spaces are marks."""
        best = [-math.inf] * (len(text) + 1)
        pieces = [0] * (len(text) + 1)
        best[0] = 0.0
        at = 0
        for end, (size, score) in self.matches.iter(text):
            while at < end:
                self._close(text, at, best, pieces)
                at += 1
            start = end + 1 - size
            found = best[start] + score
            # Matches of one end come longest first, so a tie keeps the earlier start.
            if found > best[end + 1]:
                best[end + 1], pieces[end + 1] = found, pieces[start] + 1
        while at < len(text):
            self._close(text, at, best, pieces)
            at += 1
        return pieces[-1]

    def _close(self, text: str, at: int, best: list[float], pieces: list[int]) -> None:
        """Let an unknown character end at ``at`` once all matches that end there are in."""
        if text[at] not in self.single and best[at] + self.unknown > best[at + 1]:
            best[at + 1], pieces[at + 1] = best[at] + self.unknown, pieces[at] + len(text[at].encode())


class StretchCounts(dict):
    """Stretches met by this Python worker; starts anew when full."""

    def __init__(self, viterbi: Viterbi):
        super().__init__()
        self.viterbi = viterbi

    def __missing__(self, stretch: str) -> int:
        found = self.viterbi.count(stretch)
        if len(stretch) <= KNOWN_LENGTH:
            if len(self) >= KNOWN_STRETCHES:
                self.clear()
            self[stretch] = found
        return found

    def total(self, text: str) -> int:
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        return sum(map(self.__getitem__, STRETCH.findall(marked))) if self.viterbi.separable else self.viterbi.count(marked)


@lru_cache(maxsize=2)
def _worker_counts(vocabulary: tuple) -> StretchCounts:
    return StretchCounts(Viterbi(list(vocabulary)))


def count_tokens(docs: DataFrame, keep: list[str | Column] | None = None, text: str = "text", model: str | None = None) -> DataFrame:
    """``keep`` with n_tokens of each whole text; no shuffle."""
    # The size of a tokenizer's vocabulary, whatever the documents' number.
    shared = docs.sparkSession.sparkContext.broadcast(tuple(unigram_vocabulary(model)))

    def prepare():
        counts = _worker_counts(shared.value)
        return lambda texts: [(counts.total(x),) for x in texts]

    return per_text(docs, prepare, "n_tokens long", keep if keep is not None else ["doc_id"], text)
