"""Near-duplicate groups by b-bit MinHash (operator 2).

1. Each text becomes a set of hashed 3-word shingles, 128 minima, 25 band keys of five
   minima, and a packed signature of the low 2 bits of each minimum.
2. Texts with equal sets are one class, so exact copies never meet each other.
3. Classes that share a band key are candidates.  Inside a bucket, signatures
   are compared by counting equal 2-bit fields and correcting for chance; only a
   forest of the pairs that may be alike leaves the task, never all pairs.
4. The forests' components are families; each family's full sets are compared
   exactly, again leaving one forest.  Its components are the groups.

A pair at the threshold shares no band with probability 4e-7 and falls under the signature cut
(five standard errors lower) with about the same.  Buckets and families above a size
are split into blocks, and every pair of blocks is one task, so no task
holds more than two blocks and no pair is left out.

Texts that are null, or hold no words, have no shingles and are linked with nothing.
Rows without an id keep to themselves: their component is null and they are kept.
Rows repeating an id and its text are one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeweave.functions.columns import broadcast_if_small
from tradeweave.llm.arrow_map import per_group, per_text
from tradeweave.llm.components import components
from tradeweave.llm.words import hashed, mix, split
from tradeweave.session import ship_package, write_table

WORDS, ALIKE_TOP, ALIKE_BOTTOM = 3, 85, 100
MINIMA, BANDS, PER_BAND, BITS = 128, 25, 5, 2
#: Five standard errors of the estimate below the threshold of 0.85.
MAY_BE_ALIKE = 0.66
#: Classes of one bucket, and classes and shingles of one family, that make a block.
BUCKET_BLOCK, FAMILY_BLOCK, SHINGLE_BLOCK = 10_000, 3_000, 2_000_000
FIELDS = np.uint64(0x5555555555555555)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    spelled = split(text)
    if not spelled:
        return np.empty(0, np.uint64)
    if len(spelled) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(spelled), seed=len(spelled))], np.uint64)
    hashes = hashed(spelled)
    n = len(hashes) - words + 1
    mixed = np.zeros(n, np.uint64)
    for i in range(words):
        mixed = mix(mixed ^ hashes[i : i + n])
    return np.unique(mixed)


_RANDOM = np.random.default_rng(11)
_ODD = (_RANDOM.integers(0, 1 << 32, (MINIMA, 1), dtype=np.uint32) | np.uint32(1))
_SHIFT = _RANDOM.integers(0, 1 << 32, (MINIMA, 1), dtype=np.uint32)


def minima(found: np.ndarray) -> np.ndarray:
    """Minimum of each of MINIMA linear functions of the (already mixed) hashes modulo 2**32; blocks stay in the cache."""
    least = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    upper = (found >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(upper), 512):
        values = upper[None, i : i + 512] * _ODD
        values += _SHIFT
        np.minimum(least, values.min(axis=1), out=least)
    return least


def _signature(text: str) -> tuple:
    found = shingles(text)
    if not len(found):
        return 0, None, None, None
    least = minima(found)
    mixed = np.zeros(BANDS, np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least[: BANDS * PER_BAND].reshape(BANDS, PER_BAND).T:
        mixed = mix(mixed ^ column)
    low = (least & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(BITS))
    packed = np.bitwise_or.reduce(low, axis=1)
    return len(found), _set_key(found), mixed.view(np.int64).tolist(), packed.tobytes()


def signatures(docs: DataFrame, keep: list[str | Column]) -> DataFrame:
    """``keep`` with n_shingles, set_key (a digest of the set), bands and signature of each row."""
    return per_text(docs, lambda: lambda texts: [_signature(x) for x in texts], "n_shingles long, set_key binary, bands array<long>, signature binary", keep)


def forest(count: int, alike: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Label of each of ``count`` items, equal exactly if a chain of like items joins them.

    ``alike(x, others)`` tells which of ``others`` x is linked to; it is asked
    only about items that are not yet joined to x.
    """
    label = np.arange(count)
    for x in range(count - 1):
        others = x + 1 + np.flatnonzero(label[x + 1 :] != label[x])
        if len(others):
            met = others[alike(x, others)]
            if len(met):
                label[np.isin(label, label[met])] = label[x]
    return label


def _sizes_fit(sizes: np.ndarray, x: int, others: np.ndarray) -> np.ndarray:
    small, large = np.minimum(sizes[others], sizes[x]), np.maximum(sizes[others], sizes[x])
    return ALIKE_BOTTOM * small >= ALIKE_TOP * large


def like_signatures(sizes: np.ndarray, packed: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
    """Pairs whose similarity, estimated from equal fields and corrected for fields that agree by chance, is high enough."""
    chance = 0.5**BITS

    def alike(x: int, others: np.ndarray) -> np.ndarray:
        differ = packed[others] ^ packed[x]
        differ = (differ | (differ >> np.uint64(1))) & FIELDS
        equal = 1 - np.bitwise_count(differ).sum(axis=1) / MINIMA
        return ((equal - chance) / (1 - chance) >= MAY_BE_ALIKE) & _sizes_fit(sizes, x, others)

    return alike


def like_sets(sets: list[np.ndarray]) -> Callable[[int, np.ndarray], np.ndarray]:
    """Pairs with ALIKE_BOTTOM * intersection >= ALIKE_TOP * union, from the full sets."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(int(flat.max()) + 1, np.int32)

    def alike(x: int, others: np.ndarray) -> np.ndarray:
        fit = _sizes_fit(sizes, x, others)
        picked = others[fit]
        if len(picked):
            mine = flat[starts[x] : starts[x] + sizes[x]]
            mark[mine] = 1
            ends = np.cumsum(sizes[picked])
            at = np.arange(ends[-1]) + np.repeat(starts[picked] - (ends - sizes[picked]), sizes[picked])
            common = np.add.reduceat(mark[flat[at]], ends - sizes[picked])
            mark[mine] = 0
            fit[fit] = ALIKE_BOTTOM * common >= ALIKE_TOP * (sizes[picked] + sizes[x] - common)
        return fit

    return alike


def _star(keys: list[bytes], label: np.ndarray) -> dict[str, list]:
    """Each item of a joined set tied to the smallest key of its set."""
    least: dict[int, bytes] = {}
    for key, k in zip(keys, label.tolist()):
        least[k] = min(least.get(k, key), key)
    tied = [(key, least[k]) for key, k in zip(keys, label.tolist()) if key != least[k]]
    return {"a": [key for key, _ in tied], "b": [key for _, key in tied]}


def _in_blocks(members: DataFrame, group: str, blocks: Column) -> DataFrame:
    """Members dealt to blocks by their key, and each copied to every pair its block is in; one block stays as it is."""
    own = F.pmod(F.xxhash64("set_key", F.lit(3)), F.col("blocks")).cast("int")
    dealt = members.withColumn("blocks", blocks.cast("int")).withColumn("own", own)
    pair = F.expr("explode(transform(sequence(0, blocks - 1), j -> struct(least(own, j) AS i, greatest(own, j) AS j)))")
    spread = dealt.withColumn("pair", pair)
    return spread.select(F.xxhash64(group, "pair.i", "pair.j").alias("task"), "*").drop("own", "blocks", "pair")


def _candidate_links(classes: DataFrame) -> DataFrame:
    """(a, b) set keys of classes tied by signatures in some bucket."""
    banded = classes.select("set_key", F.explode("bands").alias("bucket"))
    # Bands often gather the same classes: of equal buckets one is enough.
    shape = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("set_key")).alias("x"), F.sum(F.xxhash64("set_key").cast("decimal(38,0)")).alias("s"))
    buckets = shape.where("n > 1").groupBy("n", "x", "s").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    buckets = write_table(buckets, "buckets")
    members = banded.join(broadcast_if_small(buckets), "bucket").join(classes.select("set_key", "n_shingles", "signature"), "set_key")
    tasks = _in_blocks(members, "bucket", F.ceil(F.col("n") / BUCKET_BLOCK)).select("task", "set_key", "n_shingles", "signature")

    def tie(group: pa.Table) -> dict[str, list]:
        keys = group.column("set_key").to_pylist()
        packed = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint64).reshape(len(keys), -1)
        return _star(keys, forest(len(keys), like_signatures(group.column("n_shingles").to_numpy(), packed)))

    return per_group(tasks, "task", tie, "a binary, b binary")


def _confirmed_links(docs: DataFrame, families: DataFrame) -> DataFrame:
    """(a, b) set keys of classes tied by their full sets; families has set_key, doc_id, n_shingles and family."""
    sizes = families.groupBy("family").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
    wanted = families.join(sizes, "family").select(
        "doc_id", "set_key", "family", F.greatest(F.ceil(F.col("n") / FAMILY_BLOCK), F.ceil(F.col("total") / SHINGLE_BLOCK)).alias("blocks")
    )
    wanted = write_table(wanted, "families")
    # One text stands for each class; an id with several texts is told apart by the digest.
    texts = docs.select("doc_id", "text").join(broadcast_if_small(wanted), "doc_id")

    def sets() -> Callable:
        def one(text: str) -> tuple:
            found = shingles(text)
            return _set_key(found), found.view(np.int64).tolist()

        return lambda whole: [one(x) for x in whole]

    full = per_text(texts, sets, "digest binary, shingles array<long>", ["set_key", "family", "blocks"]).where("digest = set_key").drop("digest")
    tasks = _in_blocks(full, "family", F.col("blocks")).select("task", "set_key", "shingles")

    def tie(group: pa.Table) -> dict[str, list]:
        # Rows repeating an id and its text are one class.
        found = dict(zip(group.column("set_key").to_pylist(), group.column("shingles")))
        sets_of = [x.values.to_numpy() for x in found.values()]
        return _star(list(found), forest(len(found), like_sets(sets_of)))

    return per_group(tasks, "task", tie, "a binary, b binary")


def _judged(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows' signatures, written, and (set_key, component, keeper) of each class: its group's least id, and whether it stands for the group."""
    ship_package(docs.sparkSession)
    marked = write_table(signatures(docs, ["doc_id"]), "signatures")
    some = marked.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    # Pre-aggregated on the map side, so a class of a third of all rows is a few rows in the shuffle.
    classes = some.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    classes = write_table(classes, "classes")
    family = components(_candidate_links(classes))
    families = classes.select("set_key", "doc_id", "n_shingles").join(family.select(F.col("node").alias("set_key"), F.col("component").alias("family")), "set_key")
    linked = components(_confirmed_links(docs, families))
    named = linked.join(classes.select(F.col("set_key").alias("node"), "doc_id"), "node")
    smallest = named.groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("least"))
    moved = named.join(smallest, "component").select(F.col("node").alias("set_key"), F.col("least.doc_id").alias("least"), (F.col("node") == F.col("least.node")).alias("first"))
    found = classes.select("set_key", F.col("doc_id").alias("own")).join(moved, "set_key", "left")
    found = found.select("set_key", F.coalesce("least", "own").alias("component"), F.coalesce("first", F.lit(True)).alias("keeper"))
    # Written, so that the join with a class of very many rows is one that adaptive execution splits.
    return marked, write_table(found, "judged")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs."""
    marked, found = _judged(docs)
    # Rows without shingles or id need no look-up.
    known = marked.where("set_key IS NOT NULL AND doc_id IS NOT NULL").join(found, "set_key")
    alone = marked.where("set_key IS NULL OR doc_id IS NULL").withColumn("component", F.col("doc_id"))
    result = known.select("doc_id", "n_shingles", "component").unionByName(alone.select("doc_id", "n_shingles", "component"))
    return result.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row, unchanged, of each group, and the rows that have no like.

    The row that stays is of the group's least id and, of that id's texts in the group, of the one
    with the least digest; of rows that share both, the first by text and by all columns as JSON.
    Rows without id or without words stay.  Ids that occur once are judged by id; only
    rows of repeated ids are told apart by their texts.
    """
    marked, found = _judged(docs)
    worded = marked.where("set_key IS NOT NULL AND doc_id IS NOT NULL").join(found, "set_key")
    worded = worded.select("doc_id", "set_key", (F.col("keeper") & (F.col("doc_id") == F.col("component"))).alias("stays"))
    empty = marked.where("set_key IS NULL AND doc_id IS NOT NULL").select("doc_id", "set_key", F.lit(True).alias("stays"))
    rows = write_table(worded.unionByName(empty), "near-copies")
    by_id = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("stays").alias("some"), F.max(F.col("set_key").isNotNull()).alias("worded"))
    decided = write_table(by_id.where("NOT some OR n > 1 AND worded").select(F.col("doc_id").alias("id"), F.col("some").alias("again")), "near-copy-ids")

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.col("text").alias("whole text"))
    single = packed.join(broadcast_if_small(decided), "id", "left_anti").select("row.*")
    if decided.where("again").isEmpty():
        return single
    again = packed.join(broadcast_if_small(decided.where("again")), "id")
    told = per_text(again, lambda: lambda texts: [(_set_key(shingles(x)),) for x in texts], "digest binary", ["row", "id"], "whole text")
    keepers = rows.where("stays AND set_key IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("set_key").alias("digest")).distinct()
    order = Window.partitionBy("id", "digest").orderBy("row.text", F.to_json("row"))
    first = told.join(keepers, ["id", "digest"]).withColumn("place", F.row_number().over(order)).where("place = 1")
    return single.unionByName(first.select("row.*")).unionByName(told.where("digest IS NULL").select("row.*"))


def _set_key(found: np.ndarray) -> bytes | None:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None
