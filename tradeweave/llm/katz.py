"""Katz backoff language model (operator 6).

log P(w | h) is evaluated recursively: a pair seen in training has its
Good-Turing discounted share; any other backs off to P(w), times a weight that makes the
shares of each history sum to one exactly; a word never seen backs off to the one unknown
outcome, which holds what discounting took from the words.

How the work is dealt:

* Texts are read once and written as chunks of about CHUNK_TOKENS tokens (their words'
  hashes and positions in that list), in a table bucketed by chunk, so that later joins on the
  chunk move only the small side.
* Each chunk lists its words once, dealt to blocks by ranges of their hashes; a block sums
  the counts of all chunks and answers each with ids and counts in the order it asked.
* Each chunk lists its distinct pairs of known words once, dealt to blocks by
  the first word.  A block sums the counts of all chunks, keeps them as a table
  and answers each chunk with the counts in the order it asked, so
  neither tokens nor pairs travel twice.  A first word with many tokens is spread over blocks by the
  second word; its sums are added up afterwards.
* Backoff weights are summed by blocks of first words and answered in the same way.

All counts cover all training texts.  Tokens are the words of a text (A-Z lower-cased, separated by
ASCII blanks) and one end; the end is also the history of the first word.
Null and empty texts are just an end.  Without training texts every
probability is one.  Rows are scored one by one, so repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tradeweave.llm.words import hashed, mix, split
from tradeweave.session import new_folder, ship_package

#: Tokens of a chunk, and tokens of a block of pairs.
CHUNK_TOKENS, BLOCK_TOKENS = 1_000_000, 1_000_000
#: Counts up to this are discounted.
DISCOUNTED = 5
#: No word holds a blank, so the end has a hash of its own kind.
END = xxhash.xxh64_intdigest(b" ")


def pack(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def discounts(of_counts: list[int]) -> list[float]:
    """Factors for counts 1..DISCOUNTED from numbers of items seen 1..DISCOUNTED + 1 times.

    Good-Turing with Katz's correction, so that the mass taken is n1 / N.  Where
    the numbers of a small corpus give a factor outside (0, 1), half a count is taken off instead.
    """
    k = DISCOUNTED
    n = [0.0, *map(float, of_counts)]
    if all(n[1 : k + 2]):
        common = (k + 1) * n[k + 1] / n[1]
        found = [((r + 1) * n[r + 1] / (n[r] * r) - common) / (1 - common) if common != 1 else -1.0 for r in range(1, k + 1)]
        if all(0 < d < 1 for d in found):
            return found
    return [(r - 0.5) / r for r in range(1, k + 1)]


@dataclass
class Unigrams:
    """Numbers that P(w) needs besides the count of w."""

    tokens: int
    kinds: int
    factors: list[float]
    scale: float
    unknown: float

    @classmethod
    def of(cls, tokens: int, kinds: int, of_counts: list[int]) -> Unigrams:
        factors = discounts(of_counts)
        if not tokens:
            return cls(0, 0, factors, 1.0, 1.0)
        taken = sum(n * r * (1 - d) for r, (n, d) in enumerate(zip(of_counts, factors), 1)) / tokens
        # The unknown outcome holds one token's share at least.
        unknown = max(taken, 1 / (tokens + 1))
        return cls(tokens, kinds, factors, (1 - unknown) / (1 - taken), unknown)

    def probability(self, counts: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.ones(len(counts))
        seen = discounted(counts, self.factors) / self.tokens * self.scale
        return np.where(counts > 0, seen, self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + 1 * (self.kinds + 1)))


def discounted(counts: np.ndarray, factors: list[float]) -> np.ndarray:
    table = np.array([0.0, *factors, 1.0])
    return counts * table[np.minimum(counts, DISCOUNTED + 1)]


def backoff(held: np.ndarray, history: np.ndarray, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factor on seen pairs and backoff weight of each history.

    ``held`` is the discounted sum of its pairs, ``history`` its count, ``covered`` the sum of P(w)
    over the words seen after it.  One token's share at least is left for backing off.
    """
    left = np.maximum(1 - held / history, 1 / (history + 1))
    return np.where(held > 0, (1 - left) * history / np.maximum(held, 1e-300), 1.0), left / np.maximum(1 - covered, 1e-300)


@dataclass
class Model:
    """Tables in the shared folder, as packed blocks: words (block, words, n), pairs (block, h, w, c), backoffs (block, h, held, covered)."""

    words: DataFrame
    pairs: DataFrame
    backoffs: DataFrame
    unigrams: Unigrams
    factors: list[float]
    scores: DataFrame


def _written(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder, one file a task.

    Kinds of rows have columns of their own, so that a reader of one kind reads no bytes of the others.  A folder for each kind
    would do that too, but on a plain local or mounted file system Hadoop starts a process for every file and folder it makes.
    """
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bucketed(df: DataFrame, name: str, by: str, buckets: int) -> DataFrame:
    """Written to the shared folder in buckets, so that joins on ``by`` leave it where it is."""
    path = new_folder(df.sparkSession, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, by).sortBy(by).saveAsTable(table)
    return df.sparkSession.table(table)


def _chunks(docs: DataFrame, keep: list[str | Column], train: Column, text: str, size: int) -> DataFrame:
    chosen = docs.select(F.struct(*keep).alias("kept"), train.alias("train"), F.col(text).cast("string").alias("t"))
    item = T.StructType([chosen.schema["kept"], T.StructField("train", T.BooleanType()), T.StructField("n", T.LongType())])
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("docs", T.ArrayType(item)), *(T.StructField(c, T.BinaryType()) for c in ("words", "local", "tokens"))])
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, hashes, rows = TaskContext.get().partitionId() << 24, 0, [], []

        def close() -> pa.RecordBatch:
            nonlocal number, held
            vocabulary, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
            sizes = np.array([r[2] for r in rows])
            taught = np.repeat([bool(r[1]) for r in rows], sizes)
            local = np.bincount(tokens[taught], minlength=len(vocabulary)).astype(np.uint32)
            listed = [{"kept": kept, "train": bool(t), "n": n} for kept, t, n in rows]
            values = [number, listed, pack(vocabulary), pack(local), pack(tokens.astype(np.int32))]
            number, held = number + 1, 0
            hashes.clear(), rows.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(values, arrow)], names=arrow.names)

        for batch in batches:
            for kept, taught, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = split(t or "")
                found = np.append(hashed(words), np.uint64(END))
                hashes.append(found)
                rows.append((kept, taught, len(found)))
                held += len(found)
                if held >= size:
                    yield close()
        if rows:
            yield close()

    return chosen.mapInArrow(cut, schema)


def _rows(frames: Iterator[pd.DataFrame], make) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for row in frame.itertuples(index=False):
            yield make(row)


def _sequences(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Tokens of a chunk, the token before each, whether each is for training, and where texts start."""
    tokens = unpack(row.tokens, np.int32).astype(np.int64)
    sizes = np.array([d["n"] for d in row.docs])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    before = np.roll(tokens, 1)
    before[starts] = tokens[-1]  # every text ends in the end
    return tokens, before, np.repeat([d["train"] for d in row.docs], sizes), starts, len(sizes)


def _joined(replies: list | None, name: str, dtype) -> np.ndarray:
    """One array of the parts that blocks replied with, in the order of blocks."""
    return np.concatenate([unpack(r[name], dtype) for r in replies]) if replies is not None and len(replies) else np.empty(0, dtype)


def _known(row) -> tuple[np.ndarray, np.ndarray]:
    """Id (-1: not in training) and training count of each word of a chunk."""
    return _joined(row.answers, "ids", np.int64), _joined(row.answers, "n", np.int64)


def _by_chunk(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """The replies to each chunk in the order of blocks.  A chunk asks a block once, so the list is bounded by the chunk."""
    return rows.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("block", *columns))).alias(name))


def _pairs(tokens, before, ids, counts, blocks: int) -> tuple:
    """Distinct pairs of known words in the order they are asked for: by block, then by ids."""
    both = (ids[before] >= 0) & (ids[tokens] >= 0)
    keys, inverse = np.unique(before[both] * np.int64(len(ids)) + tokens[both], return_inverse=True)
    first, second = keys // len(ids), keys % len(ids)
    h, w = ids[first], ids[second]
    # A frequent first word is spread over so many blocks that each gets half a block's tokens of it.
    spread = 1 + counts[first] // (BLOCK_TOKENS // 2)
    block = ((mix(h.view(np.uint64)) + mix(w.view(np.uint64)) % spread.astype(np.uint64)) % np.uint64(blocks)).astype(np.int64)
    order = np.lexsort((w, h, block))
    return both, inverse, order, block[order], h[order], w[order], counts[first][order], counts[second][order]


def score_corpus(docs: DataFrame, train: Column, keep: list[str | Column] | None = None, text: str = "text", chunk_tokens: int = CHUNK_TOKENS) -> Model:
    """Train on the rows where ``train`` holds and score all rows.

    ``scores`` has ``keep``, n_tokens, n_known (tokens seen in training), train_tokens, base_score
    (add-one unigram) and score, both the log10 probability of the text.
    """
    spark = docs.sparkSession
    ship_package(spark)
    keep = keep if keep is not None else ["doc_id"]
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    chunks = _bucketed(_chunks(docs, keep, F.coalesce(train, F.lit(False)), text, chunk_tokens), "katz-chunks", "chunk", buckets)

    # As many blocks of words as chunks: a block then gets about as many words as a chunk has.
    word_blocks = max(1, chunks.count())

    def listed(row) -> pd.DataFrame:
        words, local = unpack(row.words, np.uint64), unpack(row.local, np.uint32).astype(np.int64)
        block = ((words >> np.uint64(32)) * np.uint64(word_blocks) >> np.uint64(32)).astype(np.int64)
        cuts, parts = _parts(block)
        return pd.DataFrame({"block": block[cuts], "chunk": row.chunk, "words": [pack(words[a:b]) for a, b in parts], "n": [pack(local[a:b]) for a, b in parts]})

    uses = chunks.select("chunk", "words", "local").mapInPandas(lambda frames: _rows(frames, listed), "block long, chunk long, words binary, n binary")
    words = _written(uses.groupBy("block").applyInPandas(_sum_words, "kind string, block long, chunk long, words binary, n binary, seen array<long>, ids binary, uses binary"), "katz-words")
    tables = words.where("kind = 'words'").select("block", "words", "n", "seen")
    seen = tables.select(*[F.coalesce(F.sum(F.get("seen", F.lit(i))), F.lit(0)) for i in range(DISCOUNTED + 3)]).first()
    unigrams = Unigrams.of(seen[0], seen[1], list(seen[2:]))
    replied = words.where("kind = 'reply'").select("block", "chunk", "ids", F.col("uses").alias("n"))
    answers = _by_chunk(replied, "answers", "ids", "n")
    blocks = 1 + unigrams.tokens // BLOCK_TOKENS

    def asked(row) -> pd.DataFrame:
        tokens, before, taught, _, _ = _sequences(row)
        ids, counts = _known(row)
        both, inverse, order, block, h, w, n_h, n_w = _pairs(tokens, before, ids, counts, blocks)
        c = np.bincount(inverse, weights=taught[both], minlength=len(order)).astype(np.int64)[order]
        cuts, parts = _parts(block)
        columns = {"block": block[cuts], "chunk": np.full(len(cuts), row.chunk)}
        columns |= {name: [pack(x[a:b]) for a, b in parts] for name, x in (("h", h), ("w", w), ("n_h", n_h), ("n_w", n_w), ("c", c))}
        return pd.DataFrame(columns)

    requests = chunks.select("chunk", "docs", "tokens").join(answers, "chunk").mapInPandas(
        lambda frames: _rows(frames, asked), "block long, chunk long, h binary, w binary, n_h binary, n_w binary, c binary"
    )

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        return _sum_block(frame, unigrams)

    out = "kind string, block long, chunk long, h binary, w binary, c binary, ids binary, held binary, n_h binary, covered binary, seen array<long>, found binary"
    pairs = _written(requests.groupBy("block").applyInPandas(summed, out), "katz-pairs")
    few = pairs.where("kind = 'history'").select(*[F.coalesce(F.sum(F.get("seen", F.lit(r))), F.lit(0)) for r in range(DISCOUNTED + 1)]).first()
    factors = discounts(list(few))

    def histories(row) -> pd.DataFrame:
        held = unpack(row.held, np.int64).reshape(-1, DISCOUNTED + 1)
        value = held[:, :DISCOUNTED] @ (np.array(factors) * np.arange(1, DISCOUNTED + 1)) + held[:, DISCOUNTED]
        ids = unpack(row.ids, np.int64)
        cuts, parts = _parts(ids >> 32)
        columns = (("h", ids), ("n_h", unpack(row.n_h, np.int64)), ("held", value), ("covered", unpack(row.covered, np.float64)))
        return pd.DataFrame({"block": (ids >> 32)[cuts]} | {name: [pack(x[a:b]) for a, b in parts] for name, x in columns})

    partial = pairs.where("kind = 'history'").select("ids", "held", "n_h", "covered").mapInPandas(
        lambda frames: _rows(frames, histories), "block long, h binary, n_h binary, held binary, covered binary"
    )
    weights = replied.select("block", "chunk", "ids").groupBy("block").cogroup(partial.groupBy("block")).applyInPandas(
        _weigh, "block long, chunk long, scale binary, weight binary"
    )
    together = (
        chunks.select("chunk", "docs", "tokens").join(answers, "chunk")
        .join(_by_chunk(weights, "weights", "scale", "weight"), "chunk")
        .join(_by_chunk(pairs.where("kind = 'reply'"), "replies", "found"), "chunk", "left")
    )
    fields = [("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double")]
    kept = docs.select(*keep).schema
    schema = T.StructType([T.StructField("kept", kept), *T._parse_datatype_string(", ".join(f"{a} {b}" for a, b in fields)).fields])
    arrow = to_arrow_schema(schema)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = _Row({name: batch.column(name)[i].as_py() for name in batch.schema.names})
                values = _score_chunk(row, unigrams, factors, blocks)
                columns = [[d["kept"] for d in row.docs], *values]
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(columns, arrow)], names=arrow.names)

    scores = together.mapInArrow(scored, schema).select("kept.*", *[name for name, _ in fields])
    return Model(tables, pairs.where("kind = 'pairs'").select("block", "h", "w", "c"), partial, unigrams, factors, scores)


class _Row:
    def __init__(self, values: dict):
        self.__dict__.update(values)


def _parts(block: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Starts of runs of equal blocks, and the runs."""
    cuts = np.flatnonzero(np.diff(block, prepend=-1))
    return cuts, list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(block)]))


def _sum_words(frame: pd.DataFrame) -> pd.DataFrame:
    """Counts of a block's words over all chunks, and a reply to each chunk; an id is the block and a place in it."""
    lists, counts = [unpack(x, np.uint64) for x in frame["words"]], [unpack(x, np.int64) for x in frame["n"]]
    words, which = np.unique(np.concatenate(lists), return_inverse=True)
    total = np.bincount(which, weights=np.concatenate(counts)).astype(np.int64)
    block = int(frame["block"].iloc[0])
    ids = np.where(total > 0, (block << 32) + np.arange(len(words)), -1)
    known = total > 0
    of_counts = np.bincount(total[known], minlength=DISCOUNTED + 2)[1 : DISCOUNTED + 2].tolist()
    table = {"kind": ["words"], "chunk": [None], "words": [pack(words[known])], "n": [pack(total[known])], "seen": [[int(total.sum()), int(known.sum()), *of_counts]], "ids": [None], "uses": [None]}
    ends = np.cumsum([len(x) for x in lists])[:-1]
    own_ids, own_counts = np.split(ids[which], ends), np.split(total[which], ends)
    replies = {"kind": "reply", "chunk": frame["chunk"].tolist(), "ids": [pack(x) for x in own_ids], "uses": [pack(x) for x in own_counts]}
    made = pd.concat([pd.DataFrame(table), pd.DataFrame(replies)], ignore_index=True).assign(block=block)
    made["chunk"] = made["chunk"].astype("Int64")
    return made[["kind", "block", "chunk", "words", "n", "seen", "ids", "uses"]].replace({np.nan: None})


def _weigh(asked: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """Factor on seen pairs and backoff weight of each word that a chunk asked about; a word without pairs in training backs off whole."""
    parts = [[unpack(x, t) for x in found[name]] for name, t in (("h", np.int64), ("n_h", np.int64), ("held", np.float64), ("covered", np.float64))]
    h, n_h, held, covered = (np.concatenate(x) if x else np.empty(0) for x in parts)
    ids, which = np.unique(h.astype(np.int64), return_inverse=True)
    history = np.ones(len(ids))
    history[which] = n_h
    scale, weight = backoff(np.bincount(which, held, len(ids)), history, np.bincount(which, covered, len(ids))) if len(ids) else (np.empty(0), np.empty(0))
    rows = []
    for chunk, block, packed in zip(asked["chunk"], asked["block"], asked["ids"]):
        mine = unpack(packed, np.int64)
        own_scale, own_weight = np.ones(len(mine)), np.ones(len(mine))
        if len(ids):
            at = np.minimum(np.searchsorted(ids, mine), len(ids) - 1)
            hit = ids[at] == mine
            own_scale[hit], own_weight[hit] = scale[at[hit]], weight[at[hit]]
        rows.append((block, chunk, pack(own_scale), pack(own_weight)))
    return pd.DataFrame(rows, columns=["block", "chunk", "scale", "weight"])


def _sum_block(frame: pd.DataFrame, unigrams: Unigrams) -> pd.DataFrame:
    """Counts of one block over all chunks: the pairs, what their histories hold, and a reply to each chunk."""
    columns = {name: [unpack(x, np.int64) for x in frame[name]] for name in ("h", "w", "n_h", "n_w", "c")}
    sizes = [len(x) for x in columns["h"]]
    h, w, n_h, n_w, c = (np.concatenate(columns[name]) for name in ("h", "w", "n_h", "n_w", "c"))
    order = np.lexsort((w, h))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(h[order]) != 0) | (np.diff(w[order]) != 0)
    group = np.cumsum(new) - 1
    total = np.bincount(group, weights=c[order]).astype(np.int64)
    reply = np.empty(len(order), np.int64)
    reply[order] = total[group]
    first = order[np.flatnonzero(new)]
    held = total > 0
    first, total = first[held], total[held]
    ids, which = np.unique(h[first], return_inverse=True)
    small = np.minimum(total, DISCOUNTED + 1)
    table = np.zeros((len(ids), DISCOUNTED + 1), np.int64)
    # Pairs seen r times for each small r, and the tokens of those seen more often.
    np.add.at(table, (which, small - 1), np.where(total > DISCOUNTED, total, 1))
    covered = np.bincount(which, weights=unigrams.probability(n_w[first]), minlength=len(ids))
    history = np.zeros(len(ids), np.int64)
    history[which] = n_h[first]
    seen = np.bincount(total, minlength=DISCOUNTED + 2)[1 : DISCOUNTED + 2].tolist()
    block = int(frame["block"].iloc[0])
    none = [None] * 1
    pairs = {"kind": "pairs", "chunk": none, "h": [pack(h[first])], "w": [pack(w[first])], "c": [pack(total)]}
    held_by = {"kind": "history", "chunk": none, "ids": [pack(ids)], "held": [pack(table.reshape(-1))], "n_h": [pack(history)], "covered": [pack(covered)], "seen": [seen]}
    parts = np.split(reply, np.cumsum(sizes)[:-1])
    replies = {"kind": "reply", "chunk": frame["chunk"].tolist(), "found": [pack(x) for x in parts]}
    made = pd.concat([pd.DataFrame(x) for x in (pairs, held_by, replies)], ignore_index=True).assign(block=block)
    made["chunk"] = made["chunk"].astype("Int64")
    return made[["kind", "block", "chunk", "h", "w", "c", "ids", "held", "n_h", "covered", "seen", "found"]].replace({np.nan: None})


def _score_chunk(row: _Row, unigrams: Unigrams, factors: list[float], blocks: int) -> list[list]:
    tokens, before, _, starts, size = _sequences(row)
    ids, counts = _known(row)
    both, inverse, order, _, _, _, _, _ = _pairs(tokens, before, ids, counts, blocks)
    found = np.zeros(len(order), np.int64)
    found[order] = _joined(row.replies, "found", np.int64)
    c = np.zeros(len(tokens), np.int64)
    c[both] = found[inverse]
    scale, weight = _joined(row.weights, "scale", np.float64), _joined(row.weights, "weight", np.float64)
    word = unigrams.probability(counts)
    pair = scale[before] * discounted(c, factors) / np.maximum(counts[before], 1)
    # The recursion: the pair if it was seen, else the history's weight times the word, which itself backs off to the unknown.
    logs = np.log10(np.where(c > 0, pair, weight[before] * word[tokens]))
    base = unigrams.base(counts)[tokens]
    sums = [np.add.reduceat(x, starts) for x in (np.ones(len(tokens), np.int64), (counts[tokens] > 0).astype(np.int64), base, logs)]
    return [sums[0].tolist(), sums[1].tolist(), [unigrams.tokens] * size, sums[2].tolist(), sums[3].tolist()]
