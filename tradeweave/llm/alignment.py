"""Alignment of two tokenizers' tokens, each distinct text once (operator 11).

1. Rows are shuffled by their full text: equal texts are one row with a multiplicity,
   summed before the shuffle, so a text of a third of all rows is a few rows.
2. Each distinct text is encoded by both tokenizers and aligned in one Arrow pass.  Ends of tokens
   in bytes are laid end to end; where both tokenizers end a token, a group
   ends, and each stretch between neighbouring ends is one link of the two tokens that cover it.
3. The links of a text are kept as its distinct (A, B) pairs with their occurrences.  A pair's count is
   the number of documents that hold it: texts weighted by their multiplicity.
4. Counts come back to the texts.  The pairs of highest count, ``HOT_PAIRS`` at most, are broadcast; that
   covers nearly all links, and all of a frequent pair.  The others, none of them
   frequent, are joined through a shuffle.  Then the measures are joined to the rows by the text's digest.

Texts that are null, empty, or not spelled back exactly by both tokenizers have no tokens: zeros and an
empty groups_sha256.  Rows without id and repeated rows are answered like any other.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeweave.llm.arrow_map import per_text
from tradeweave.llm.bpe import SPLIT, byte_letters
from tradeweave.session import write_table

#: Pairs that are broadcast with their counts: 2 million rows of 17 bytes at most.
HOT_PAIRS = 2_000_000
#: Texts encoded at once.
SOME_TEXTS = 512


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Spelling:
    """What a tokenizer's ids stand for: bytes, their number, and digits followed by either of two separators."""

    def __init__(self, labels: list[bytes], last: str):
        self.labels = labels
        self.sizes = np.array([len(x) for x in labels], np.int64)
        self.digits = [f"{i}{after}" for i in range(len(labels)) for after in (",", last)]


class Aligner:
    """Both tokenizers; A reads a blank and the text, B the text, to which it adds the blank itself."""

    def __init__(self, definition: str, model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_str(definition)
        self.first.encode_special_tokens = True
        self.first.no_padding()
        self.first.no_truncation()
        letters = byte_letters()
        spell = lambda piece: bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        self.a = Spelling([spell(self.first.id_to_token(i) or "") for i in range(self.first.get_vocab_size())], "|")
        self.second = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(self.second.get_piece_size())
        spell = lambda i: bytes([int(self.second.id_to_piece(i)[3:-1], 16)]) if self.second.is_byte(i) else self.second.id_to_piece(i).replace("▁", " ").encode()
        self.b = Spelling([spell(i) for i in ids], ";")
        self.digits = [*self.a.digits, *self.b.digits]
        self.ranks = self._by_rank(json.loads(definition))

    def _by_rank(self, parsed: dict):
        """The first tokenizer as a table of ranks, which encodes faster; None if its ids are not the order of its merges."""
        import tiktoken

        split, labels = parsed["pre_tokenizer"] or {}, self.a.labels
        plain = parsed["normalizer"] is None and split.get("type") == "ByteLevel" and not split["add_prefix_space"] and split.get("use_regex", True)
        ids = {labels[i]: i for piece, i in parsed["model"]["vocab"].items() if self.first.id_to_token(i) == piece and not any(t["id"] == i for t in parsed["added_tokens"])}
        letters = byte_letters()
        merges = [m.split(" ") if isinstance(m, str) else m for m in parsed["model"]["merges"]]
        made = [ids.get(bytes(letters[c] for c in left + right)) for left, right in merges]
        single = [ids.get(bytes([x])) for x in range(256)]
        if not plain or None in made or None in single or [*sorted(single), *made] != list(range(len(ids))):
            return None
        return tiktoken.Encoding("by rank", pat_str=SPLIT, mergeable_ranks=ids, special_tokens={})

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both for each text; none where either does not spell the text."""
        spaced = [" " + x for x in texts]
        first = [self.ranks.encode_ordinary(x) for x in spaced] if self.ranks else [self.first.encode(x, add_special_tokens=False).ids for x in spaced]
        second = self.second.encode(texts, num_threads=1)
        made = []
        for text, spelled, a, b in zip(texts, spaced, first, second):
            want = spelled.encode()
            same = text and b"".join(map(self.a.labels.__getitem__, a)) == want and b"".join(map(self.b.labels.__getitem__, b)) == want
            made.append((a, b) if same else ([], []))
        return made

    def align(self, texts: list[str]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of each text."""
        return [row for i in range(0, len(texts), SOME_TEXTS) for row in self._align(self.encode(texts[i : i + SOME_TEXTS]))]

    def _align(self, ids: list[tuple[list[int], list[int]]]) -> list[tuple]:
        counts = np.array([(len(a), len(b)) for a, b in ids], np.int64).reshape(-1, 2)
        a, b = (np.fromiter(chain.from_iterable(pair[k] for pair in ids), np.int64, int(counts[:, k].sum())) for k in (0, 1))
        if not len(a):
            return [(0, 0, 0, 0, "", [], [])] * len(ids)
        # Both spell the same bytes, so ends counted over all texts fit together.  Two rising runs are merged; an end of both stands twice.
        ends = np.concatenate((np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])))
        order = np.argsort(ends, kind="stable")
        ends, of_b = ends[order], order >= len(a)
        first = np.concatenate(([True], ends[1:] != ends[:-1]))
        both = np.flatnonzero(~first)
        links = np.flatnonzero(first)
        # A link belongs to the tokens that end there or are still open.
        before_b = np.cumsum(of_b) - of_b
        pair = a[(np.arange(len(ends)) - before_b)[links]] * len(self.b.labels) + b[before_b[links]]
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[order[both - 1]] = True
        last_b[order[both] - len(a)] = True
        text_of = lambda side, n: np.repeat(np.arange(len(ids)), counts[:, side])[n]
        group_cuts = np.concatenate(([0], np.cumsum(np.bincount(text_of(0, np.flatnonzero(last_a)), minlength=len(ids)))))
        n_links = np.bincount(text_of(0, (np.arange(len(ends)) - before_b)[links]), minlength=len(ids))
        spelled, spelled_cuts = self._spelled(a, b, last_a, last_b), np.concatenate(([0], np.cumsum(counts.sum(axis=1))))
        # Distinct pairs of each text, in order of text and pair.
        size = len(self.a.labels) * len(self.b.labels)
        key = np.repeat(np.arange(len(ids)), n_links) * size + pair
        key.sort()
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        times = np.diff(np.append(new, len(key))).astype(np.int32)
        of_text, pair = np.divmod(key[new], size)
        pair_cuts = np.searchsorted(of_text, np.arange(len(ids) + 1))
        rows = []
        for i, (n_a, n_b) in enumerate(counts.tolist()):
            digest = hashlib.sha256("".join(spelled[spelled_cuts[i] : spelled_cuts[i + 1]])[:-1].encode()).hexdigest() if n_a else ""
            own = slice(pair_cuts[i], pair_cuts[i + 1])
            rows.append((n_a, n_b, int(group_cuts[i + 1] - group_cuts[i]), int(n_links[i]), digest, pair[own], times[own]))
        return rows

    def _spelled(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> list[str]:
        """Each id's digits and separator, in order of group, the ids of A before those of B."""
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        held_a, held_b = np.cumsum(np.bincount(group_a)), np.concatenate(([0], np.cumsum(np.bincount(group_b))))
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + held_b[group_a]] = a * 2 + last_a
        code[np.arange(len(b)) + held_a[group_b]] = (b + len(self.a.labels)) * 2 + last_b
        return list(map(self.digits.__getitem__, code.tolist()))


@lru_cache(maxsize=1)
def _worker_aligner(definition: str, model: bytes) -> Aligner:
    return Aligner(definition, model)


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """whole (each distinct text that is not empty) and n, the rows that hold it."""
    whole = docs.select(F.col(text).cast("string").alias("whole")).where("whole <> ''")
    return whole.groupBy("whole").agg(F.count("*").alias("n"))


def aligned_texts(texts: DataFrame, tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """key (digest of the text), n, n_a, n_b, n_groups, n_links, groups_sha256, and the distinct pairs with their times, of each text."""
    first, second = tokenizers or default_tokenizers()
    context = texts.sparkSession.sparkContext
    # The size of two vocabularies, whatever the documents' number.
    shared = context.broadcast((Path(first).read_text(encoding="utf-8"), Path(second).read_bytes()))

    def prepare():
        return _worker_aligner(*shared.value).align

    fields = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    return per_text(texts.withColumn("key", text_key("whole")), prepare, fields, ["key", "n"], "whole")


def text_key(column: str) -> Column:
    return F.unhex(F.sha2(F.col(column).cast("string").cast("binary"), 256))


def pair_counts(aligned: DataFrame, second_size: int) -> DataFrame:
    """pair, count (documents that hold it linked) and best (whether no pair of its A id has a higher count)."""
    counts = aligned.select("n", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("n").alias("count"))
    counts = write_table(counts.withColumn("a", F.floor(F.col("pair") / second_size)), "pair-counts")
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    return write_table(counts.join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best")), "pair-best")


def _hot_bound(counts: DataFrame, most: int) -> tuple[int, bool]:
    """Least count of pairs of which there are at most ``most``, rounded up to a power of two, and whether others are left."""
    by_size = counts.groupBy(F.floor(F.log2(F.col("count").cast("double"))).cast("int").alias("size")).agg(F.count("*").alias("n"))
    held = 0
    for size, n in sorted(by_size.collect(), reverse=True):  # a row for each power of two
        if held + n > most:
            return 1 << (size + 1), True
        held += n
    return 1, False


def measures(aligned: DataFrame, counts: DataFrame, most: int = HOT_PAIRS) -> DataFrame:
    """key, n_best and count_sum of each text that has links."""
    bound, rest = _hot_bound(counts, most)
    links = aligned.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("key", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    hot = F.broadcast(counts.where(F.col("count") >= bound))
    best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")
    summed = F.sum(F.col("times") * F.col("count")).alias("count_sum")
    found = links.join(hot, "pair").groupBy("key").agg(best, summed)
    if not rest:
        return found
    cold = links.join(hot, "pair", "left_anti").join(counts.where(F.col("count") < bound), "pair").groupBy("key").agg(best, summed)
    return found.unionByName(cold).groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, keep: list[str | Column], text: str = "text", tokenizers: tuple[str, str] | None = None, most: int = HOT_PAIRS) -> tuple[DataFrame, DataFrame]:
    """``keep`` of each row with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256; and the table of pairs (a, b, count, best)."""
    import sentencepiece

    second_size = sentencepiece.SentencePieceProcessor(model_file=(tokenizers or default_tokenizers())[1]).get_piece_size()
    aligned = write_table(aligned_texts(distinct_texts(docs, text), tokenizers), "aligned-texts")
    counts = pair_counts(aligned, second_size)
    # Written, so that the join below is one that adaptive execution splits where a text is very frequent.
    found = aligned.drop("n", "pairs", "times").where("n_a > 0").join(measures(aligned, counts, most), "key")
    found = write_table(found, "text-measures")
    zeros = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    rows = docs.select(F.struct(*keep).alias("kept"), F.when(F.col(text) != "", text_key(text)).alias("key"))
    known = rows.where("key IS NOT NULL").join(found, "key", "left").unionByName(rows.where("key IS NULL"), allowMissingColumns=True)
    pairs = counts.select(F.floor(F.col("pair") / second_size).alias("a"), (F.col("pair") % second_size).alias("b"), "count", "best")
    return known.select("kept.*", *zeros, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")), pairs


def report(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of each row."""
    return align(docs, ["doc_id"])[0]
