"""Byte-level convolutional quality classifier in numpy (operator 1).

A document is cut into overlapping chunks of 256 bytes, one every 128 bytes, so
that every byte of it is covered.  Learned filters slide over embedded bytes;
each filter's largest and mean answer describe a chunk; a hidden layer judges
each chunk; its units are max-pooled over all chunks of the document and
combined into one probability.

Fitting uses a bounded sample of labelled rows (``TRAIN_ROWS`` per label, texts
up to ``TRAIN_BYTES``), chosen by a hash of the id, on the driver.  Scoring
covers whole texts of every row in an Arrow map without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeweave.llm.arrow_map import per_text

HALF, WIDTH, STRIDE = 128, 8, 4
WINDOWS = (HALF - WIDTH) // STRIDE + 1
PAD = 256
BYTE_DIMS, FILTERS, HIDDEN = 8, 24, 16
#: Bounds of the sample that the filters are learned from.
TRAIN_ROWS, TRAIN_BYTES, EPOCHS = 2_000, 20_000, 10
#: Batches to learn from at least; small samples go round more often.
LEAST_STEPS = 300
#: A document is of good quality from this score on.
THRESHOLD = 0.3
#: Half chunks that go through the filters at once.
BLOCK = 512


@dataclass
class Layout:
    """Bytes of several documents in rows of HALF bytes; a document has two rows at least."""

    codes: np.ndarray
    real: np.ndarray  # windows of each row that hold a byte of the text
    first: np.ndarray  # first row of each document
    inside: np.ndarray  # rows that start a chunk: their next row is of the same document


def lay_out(texts: list[bytes]) -> Layout:
    counts = np.array([max(2, -(-len(x) // HALF)) for x in texts])
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    codes = np.full(int(counts.sum()) * HALF, PAD, dtype=np.int16)
    lengths = np.zeros(int(counts.sum()), dtype=np.int64)
    for x, row, n in zip(texts, first, counts):
        codes[row * HALF : row * HALF + len(x)] = np.frombuffer(x, dtype=np.uint8)
        lengths[row : row + n] = np.clip(len(x) - HALF * np.arange(n), 0, HALF)
    real = np.clip(-(-lengths // STRIDE), 1, WINDOWS).astype(np.float32)
    inside = np.ones(len(lengths), dtype=bool)
    inside[first + counts - 1] = False
    return Layout(codes.reshape(-1, HALF), real, first, inside)


class ConvNet:
    """Parameters, the forward pass and one step of learning."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "bytes": normal(257, BYTE_DIMS, scale=0.5),
            "filters": normal(WIDTH * BYTE_DIMS, FILTERS, scale=(2 / (WIDTH * BYTE_DIMS)) ** 0.5),
            "filter_bias": np.zeros(FILTERS, np.float32),
            "judge": normal(2 * FILTERS, HIDDEN, scale=(2 / (2 * FILTERS)) ** 0.5),
            "judge_bias": np.zeros(HIDDEN, np.float32),
            "out": normal(HIDDEN, scale=HIDDEN**-0.5),
            "out_bias": np.zeros(1, np.float32),
        }
        self.p["bytes"][PAD] = 0

    def windows(self, codes: np.ndarray) -> np.ndarray:
        embedded = self.p["bytes"][codes]
        rows, offset, item = embedded.strides
        view = np.lib.stride_tricks.as_strided(embedded, (len(codes), WINDOWS, WIDTH * BYTE_DIMS), (rows, offset * STRIDE, item))
        return view.reshape(-1, WIDTH * BYTE_DIMS)

    def answers(self, windows: np.ndarray) -> np.ndarray:
        found = windows @ self.p["filters"]
        found += self.p["filter_bias"]
        return np.maximum(found, 0, out=found).reshape(-1, WINDOWS, FILTERS)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 of each text; rows are taken in blocks of bounded size."""
        at = lay_out(texts)
        largest, mean = (np.empty((len(at.codes), FILTERS), np.float32) for _ in range(2))
        for i in range(0, len(at.codes), BLOCK):
            found = self.answers(self.windows(at.codes[i : i + BLOCK]))
            largest[i : i + BLOCK] = found.max(axis=1)
            mean[i : i + BLOCK] = found.sum(axis=1) / at.real[i : i + BLOCK, None]
        pooled = self._pool(at, largest, mean)[-1]
        return 1 / (1 + np.exp(-(pooled @ self.p["out"] + self.p["out_bias"]).astype(np.float64)))

    def _pool(self, at: Layout, largest: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What describes each chunk, the hidden units of each chunk, and their maxima in each document."""
        described = np.concatenate([np.maximum(largest[:-1], largest[1:]), (mean[:-1] + mean[1:]) / 2], axis=1)
        hidden = np.maximum(described @ self.p["judge"] + self.p["judge_bias"], 0)
        hidden[~at.inside[:-1]] = 0
        return described, hidden, np.maximum.reduceat(hidden, at.first, axis=0)

    def gradients(self, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted logistic loss, by the chain rule from the output back to the bytes."""
        p, at = self.p, lay_out(texts)
        windows = self.windows(at.codes)
        found = self.answers(windows)
        peak = found.argmax(axis=1)
        largest = np.take_along_axis(found, peak[:, None], axis=1)[:, 0]
        mean = found.sum(axis=1) / at.real[:, None]
        described, hidden, pooled = self._pool(at, largest, mean)
        logits = pooled @ p["out"] + p["out_bias"]
        slope = ((1 / (1 + np.exp(-logits)) - labels) * weights / len(labels)).astype(np.float32)
        grads = {"out": pooled.T @ slope, "out_bias": slope.sum(keepdims=True)}
        # Only the chunk with the largest value of a hidden unit is responsible for it.
        ends = np.append(at.first[1:], len(hidden) + 1) - 1
        back = np.zeros_like(hidden)
        for d, (a, b) in enumerate(zip(at.first, ends)):
            back[a + hidden[a:b].argmax(axis=0), np.arange(HIDDEN)] = slope[d] * p["out"]
        back *= hidden > 0
        grads["judge"], grads["judge_bias"] = described.T @ back, back.sum(axis=0)
        chunk = back @ p["judge"].T
        to_largest, to_mean = (np.zeros_like(largest) for _ in range(2))
        left = largest[:-1] >= largest[1:]
        to_largest[:-1] += chunk[:, :FILTERS] * left
        to_largest[1:] += chunk[:, :FILTERS] * ~left
        to_mean[:-1] += chunk[:, FILTERS:] / 2
        to_mean[1:] += chunk[:, FILTERS:] / 2
        answer = np.repeat((to_mean / at.real[:, None])[:, None], WINDOWS, axis=1)
        np.put_along_axis(answer, peak[:, None], np.take_along_axis(answer, peak[:, None], 1) + to_largest[:, None], 1)
        answer *= found > 0
        answer = answer.reshape(-1, FILTERS)
        grads["filters"], grads["filter_bias"] = windows.T @ answer, answer.sum(axis=0)
        spread = (answer @ p["filters"].T).reshape(-1, BYTE_DIMS)
        starts = np.arange(WINDOWS)[:, None] * STRIDE + np.arange(WIDTH)
        codes = at.codes[:, starts].reshape(-1)
        grads["bytes"] = np.stack([np.bincount(codes, spread[:, d], 257) for d in range(BYTE_DIMS)], axis=1).astype(np.float32)
        grads["bytes"][PAD] = 0
        return grads


def fit(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, batch: int = 24, rate: float = 0.004, seed: int = 7) -> ConvNet:
    """Adam over shuffled batches; the rarer label weighs as much as the other."""
    net, rng = ConvNet(seed), np.random.default_rng(seed)
    labels = np.asarray(labels, np.float32)
    share = labels.mean()
    weights = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    rounds = max(epochs, -(-LEAST_STEPS // -(-len(texts) // batch)))
    steps, total = 0, rounds * -(-len(texts) // batch)
    for _ in range(rounds):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), batch):
            picked = order[i : i + batch]
            steps += 1
            now = rate * (1 - steps / (total + 1))
            for k, g in net.gradients([texts[j] for j in picked], labels[picked], weights[picked]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net.p[k] -= now * (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.999**steps)) + 1e-8)
    return net


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a missing id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, longest: int = TRAIN_BYTES) -> ConvNet | None:
    """Learn from at most ``rows`` rows of each label outside fold 0; None if one label has no row.

    Ids are chosen from the label table alone, so at most 2 * rows ids meet the
    documents, and at most 2 * rows texts of at most ``longest`` bytes reach the
    driver.  An id with two labels takes the smaller one.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(fold(F.col("doc_id"), 5) != 0)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = F.xxhash64("doc_id")
    chosen = known.where("quality = 0").orderBy(order, "doc_id").limit(rows).unionByName(known.where("quality = 1").orderBy(order, "doc_id").limit(rows))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= longest)
    # chosen has 2 * rows ids at most.
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality")).collect()
    found.sort(key=lambda r: r["doc_id"])
    kinds = [r["quality"] for r in found]
    if not 0 < sum(kinds) < len(kinds):
        return None
    return fit([r["text"].encode() for r in found], kinds)


def score(docs: DataFrame, net: ConvNet | None, keep: list[str | Column], threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` with score (double, 0 to 1) and predicted (int) of each whole text.

    Null and empty texts are scored as empty.  Without a model (no labels of one
    kind) the score is 0.5, which keeps a document.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def prepare():
        model = shared.value

        def run(texts: list[str]) -> list[tuple]:
            scores = model.score([x.encode() for x in texts]).tolist() if model and texts else [0.5] * len(texts)
            return [(s, int(s >= threshold)) for s in scores]

        return run

    return per_text(docs, prepare, "score double, predicted int", keep)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs, unchanged, whose text the classifier does not reject."""
    net = train(docs, labels)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"), F.col("text").alias("text"))
    return score(row, net, ["kept"], threshold).where("predicted = 1").select("kept.*")
