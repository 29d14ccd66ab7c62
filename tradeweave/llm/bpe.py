"""BPE encoding and decoding with a tokenization automaton (operator 9).

Compiling.  The automaton reads tokens; being in the state of a token means that it
was read last.  It starts with an arc for each byte between all states.  The merges are taken in order, and each adds a
gadget: merge k, (u, v) -> x, takes the arc v away from every state whose token still ends in u when
merge k is applied, also where v only begins the arc's token, and adds the arc x, unless an earlier gadget already
took the arc v from the state u, so that x can never be read.  A token ends in u until a merge inside
it consumes that u; the same holds for what it begins with.  States and arcs that no
gadget tells apart are one row and one column of the table from the start, and equal rows and columns are
merged at the end.  What is left is a table of one bit for each state and arc: whether the arc is there; it leads to
the state of its token.  The table's size is that of the tokenizer, and it is broadcast.

Encoding.  Every prefix of a pre-split word is read by exactly one path, because BPE output is unique
and is decided by adjacent pairs.  A second automaton names the tokens that end at each byte; for the one of them whose
arc leaves the state at its start, its state is the state at that byte.  So a word is read from left
to right, each byte gets one state, and nothing is tried again.  Decoding emits the labels of the arcs taken.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from functools import lru_cache
from itertools import chain
from pathlib import Path
from typing import NamedTuple

import ahocorasick
import numpy as np
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeweave.llm.arrow_map import per_text

#: Fixed value: how byte-level tokenizers of this family split text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct words a Python worker remembers, and the longest that it remembers.
KNOWN_WORDS, KNOWN_LENGTH = 300_000, 48
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files of this family, and its byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    moved = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class Table(NamedTuple):
    """The compiled automaton."""

    labels: dict[int, bytes]  # of every id, special tokens too
    special: dict[str, int]
    tokens: list[int]  # the arcs: ids that can be read
    entered: np.ndarray  # by place in tokens: the state an arc leads to
    column: np.ndarray  # by place in tokens: the arc's column
    absent: bytes  # a bit for each state and column: whether gadgets took the arc away
    stride: int  # bytes of a row; the last row is the start, which has every arc


def _gadgets(merges: list[tuple[int, int, int]], single: list[int]) -> tuple[dict, dict, dict]:
    """Merges that act, by (u, v), and for each readable token the pieces it begins and ends in, with the merge that consumes each."""
    gadgets: dict[tuple[int, int], int] = {}
    begins = {i: ((i, NEVER),) for i in single}
    ends = dict(begins)
    for k, (u, v, x) in enumerate(merges):
        if u not in ends or v not in begins:
            continue
        # Of two merges of the same rank the one further left comes first.
        earlier = (gadgets.get((a, b), NEVER) for a, left in ends[u] for b, right in begins[v] if gadgets.get((a, b), NEVER) < left and gadgets.get((a, b), NEVER) <= right)
        blocked = min(earlier, default=NEVER) < k
        gadgets.setdefault((u, v), k)
        if not blocked and x not in begins:
            begins[x] = ((x, NEVER), (u, k), *begins[u][1:])
            ends[x] = ((x, NEVER), (v, k), *ends[v][1:])
    return gadgets, begins, ends


def _classes(profiles: dict[int, tuple], ranks: dict[int, list[int]], cut: Callable) -> tuple[dict[int, int], dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Class of each token by how many gadgets of each piece reach it, and for each piece its classes in order of that number."""
    numbers: dict[tuple, int] = {}
    of_token = {}
    for token, profile in profiles.items():
        key = tuple((piece, n) for piece, consumed in profile if (n := cut(ranks.get(piece, ()), consumed)))
        of_token[token] = numbers.setdefault(key, len(numbers))
    by_piece: dict[int, list] = {}
    for key, number in numbers.items():
        for piece, n in key:
            by_piece.setdefault(piece, []).append((n, number))
    return of_token, {piece: tuple(np.array(sorted(found)).T) for piece, found in by_piece.items()}


def _distinct(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of a table of booleans, and the number of each row among them."""
    seen: dict[bytes, int] = {}
    number = np.array([seen.setdefault(row.tobytes(), len(seen)) for row in np.packbits(table, axis=1)], np.int32)
    return table[np.unique(number, return_index=True)[1]], number


@lru_cache(maxsize=2)
def compiled(definition: str) -> Table:
    """The automaton of one byte-level BPE tokenizer file's content."""
    parsed = json.loads(definition)
    letters = byte_letters()
    spell = lambda piece: bytes(letters[c] for c in piece)
    ids = {spell(piece): i for piece, i in parsed["model"]["vocab"].items() if all(c in letters for c in piece)}
    labels = {i: label for label, i in ids.items()}
    special = {token["content"]: token["id"] for token in parsed["added_tokens"]}
    for content, i in special.items():
        labels[i] = content.encode()
        if ids.get(content.encode()) == i:
            del ids[content.encode()]
    pairs = [[spell(x) for x in (pair.split(" ") if isinstance(pair, str) else pair)] for pair in parsed["model"]["merges"]]
    merges = [(ids[u], ids[v], ids[u + v]) for u, v in pairs]
    gadgets, begins, ends = _gadgets(merges, [i for label, i in ids.items() if len(label) == 1])

    of_left: dict[int, list[int]] = {}
    of_right: dict[int, list[int]] = {}
    for (u, v), k in gadgets.items():  # in order of k
        of_left.setdefault(u, []).append(k)
        of_right.setdefault(v, []).append(k)
    state, states_of = _classes(ends, of_left, bisect_left)
    column, columns_of = _classes(begins, of_right, bisect_right)
    absent = np.zeros((max(state.values(), default=0) + 1, max(column.values(), default=0) + 1), bool)
    for (u, v), k in gadgets.items():
        n, rows = states_of[u]
        m, columns = columns_of[v]
        rows = rows[np.searchsorted(n, bisect_left(of_left[u], k), "right") :]
        columns = columns[np.searchsorted(m, bisect_left(of_right[v], k), "right") :]
        absent[np.ix_(rows, columns)] = True

    # Rows and columns that turned out equal are one.
    absent, row_of = _distinct(absent)
    absent, column_of = _distinct(np.ascontiguousarray(absent.T))
    packed = np.packbits(np.vstack([absent.T, np.zeros((1, len(absent)), bool)]), axis=1, bitorder="little")
    tokens = list(begins)
    entered = row_of[[state[t] for t in tokens]]
    return Table(labels, special, tokens, entered, column_of[[column[t] for t in tokens]], packed.tobytes(), packed.shape[1])


class Automaton:
    """A compiled table at work."""

    def __init__(self, table: Table):
        self.labels, self.special, self.absent, self.stride = table.labels, table.special, table.absent, table.stride
        self.start = len(table.absent) // table.stride - 1
        self.endings = ahocorasick.Automaton()
        for token, entered, column in zip(table.tokens, table.entered.tolist(), table.column.tolist()):
            label = table.labels[token]
            self.endings.add_word(label.decode("latin-1"), (token, len(label), entered, column >> 3, 1 << (column & 7)))
        self.endings.make_automaton()
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.split = regex.compile(SPLIT)

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """The arcs of the only path that reads one pre-split word."""
        absent, stride = self.absent, self.stride
        row = [-1] * (len(word) + 1)  # of the table, in bytes, at each place that is read
        arc: list[tuple[int, int]] = [(0, 0)] * (len(word) + 1)
        row[0] = self.start * stride
        for last, (token, size, entered, at, bit) in self.endings.iter(word.decode("latin-1")):
            end = last + 1
            before = row[end - size]
            if before >= 0 and row[end] < 0 and not absent[before + at] & bit:
                row[end], arc[end] = entered * stride, (token, size)
        path, end = [], len(word)
        while end:
            token, size = arc[end]
            if not size:
                raise ValueError(f"the vocabulary cannot spell {word!r}")
            path.append(token)
            end -= size
        return tuple(reversed(path))

    def encode(self, text: str, words: dict) -> list[int]:
        if self.cut is None or not any(name in text for name in self.special):
            return self._encode_plain(text, words)
        ids: list[int] = []
        for piece in self.cut.split(text):
            ids.extend((self.special[piece],) if piece in self.special else self._encode_plain(piece, words))
        return ids

    def _encode_plain(self, text: str, words: dict) -> list[int]:
        return list(chain.from_iterable(map(words.__getitem__, self.split.findall(text))))

    def decode(self, ids: list[int]) -> bytes:
        """Bytes on the arcs of ``ids``, with what is no UTF-8 replaced as a decoder to text does."""
        spelled = b"".join(map(self.labels.__getitem__, ids))
        try:
            spelled.decode()
        except UnicodeDecodeError:
            spelled = spelled.decode("utf-8", "replace").encode()
        return spelled


class WordTable(dict):
    """Words met by this Python worker and their ids; starts anew when full."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.automaton.encode_word(word.encode())
        if len(word) <= KNOWN_LENGTH:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[word] = ids
        return ids


#: Of this Python worker, by the digest of the tokenizer file.
_AT_WORK: dict[str, tuple[Automaton, WordTable, dict[int, str]]] = {}


def _worker_tables(shared: Broadcast) -> tuple[Automaton, WordTable, dict[int, str]]:
    digest, table = shared.value
    if digest not in _AT_WORK:
        _AT_WORK.clear()
        automaton = Automaton(table)
        _AT_WORK[digest] = automaton, WordTable(automaton), {i: str(i) for i in automaton.labels}
    return _AT_WORK[digest]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, tokenizer: str | None = None, text: str = "text", keep: list[str | Column] | None = None) -> DataFrame:
    """``keep`` columns (all by default) with ``ids array<int>`` of each whole text.

    A null or empty text has no ids.  Extra columns are passed through.
    """
    table = _share(docs.sparkSession, tokenizer)

    def prepare():
        automaton, words, _ = _worker_tables(table)
        return lambda texts: [(automaton.encode(x, words),) for x in texts]

    kept = keep if keep is not None else _all_columns(docs, "ids")
    packed = docs.select(F.struct(*kept).alias("kept"), F.col(text).alias("whole text"))
    return per_text(packed, prepare, "ids array<int>", ["kept"], "whole text").select("kept.*", "ids")


def decode(encoded: DataFrame, tokenizer: str | None = None, ids: str = "ids", keep: list[str | Column] | None = None) -> DataFrame:
    """``keep`` columns with ``decoded string``; null ids decode to an empty text."""
    table = _share(encoded.sparkSession, tokenizer)

    def prepare():
        automaton, _, _ = _worker_tables(table)
        return lambda texts: [(automaton.decode(list(map(int, x.split(",")))) .decode() if x else "",) for x in texts]

    kept = keep if keep is not None else _all_columns(encoded, "decoded")
    joined = encoded.select(F.struct(*kept).alias("kept"), F.array_join(F.col(ids).cast("array<string>"), ",").alias("joined"))
    return per_text(joined, prepare, "decoded string", ["kept"], "joined").select("kept.*", "decoded")


def round_trip(docs: DataFrame, tokenizer: str | None = None, text: str = "text", keep: list[str | Column] | None = None) -> DataFrame:
    """Encode and decode in one pass and keep only digests.

    Adds n_tokens, ids_sha256 (of the decimal ids joined by commas) and
    decoded_sha256 (of the decoded text in UTF-8).  Ids and decoded texts never
    leave the task, so nothing larger than one batch is held.
    """
    table = _share(docs.sparkSession, tokenizer)

    def prepare():
        automaton, words, digits = _worker_tables(table)

        def one(x: str) -> tuple:
            ids = automaton.encode(x, words)
            joined = ",".join(map(digits.__getitem__, ids)).encode()
            return len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(automaton.decode(ids)).hexdigest()

        return lambda texts: [one(x) for x in texts]

    return per_text(docs, prepare, "n_tokens long, ids_sha256 string, decoded_sha256 string", keep if keep is not None else ["doc_id"], text)


def _all_columns(df: DataFrame, added: str) -> list[Column]:
    """Every column by position's name; one that clashes with the added column gives way."""
    return [F.col(f"`{c}`") for c in df.columns if c != added]


def _share(spark: SparkSession, tokenizer: str | None) -> Broadcast:
    """The compiled table, made once by the driver; its size is that of the tokenizer."""
    definition = Path(tokenizer or default_tokenizer()).read_text(encoding="utf-8")
    return spark.sparkContext.broadcast((hashlib.sha256(definition.encode()).hexdigest(), compiled(definition)))
