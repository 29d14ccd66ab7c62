"""Prefix trie of conversations, screened by a count-min sketch (operator 12).

1. Each turn becomes a digest of its role and text; texts are not shuffled.
2. A conversation's turns, in order, pass through a running digest, so each
   prefix has one; a task holds one turn at a time, however long a conversation is.
3. The prefix digests are counted in a count-min sketch of two rows of counters.
   Only whether a counter passed one matters, so two bitmaps are all that
   is broadcast: ``COUNTERS`` bits each at most.
4. An estimate of one proves a prefix to be of a single conversation.  Such tails
   are emitted where they lie; only the prefixes that may be shared are grouped exactly.
   A sketch that is too full lets more prefixes through and changes no result.

Sums over subtrees need no walk over levels.  Every node belongs to its smallest
member; what a member owns is one stretch of its own path.  So a node's sum
is the sum of its members' stretches, less what its own member owns above it.

Null roles and texts are empty.  Turns of a conversation are taken by turn, null first;
equal turns by the digest of role and text.  Rows without conv_id belong to
no conversation.  Repeated rows are turns of their own.  A table without
conversations has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tradeweave.session import ship_package, write_table

#: Counters of one row of the sketch: this many for each prefix, up to a bound that fixes the broadcast's size.
COUNTERS_EACH, COUNTERS = 8, 1 << 28
SKETCH_ROWS = 2
#: Bits of one stored piece of a bitmap (what bitmap_construct_agg builds), and ids in one piece of a list.
PIECE_BITS, PIECE_IDS = 32_768, 8_192
DIGEST_BYTES = 16


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest of role and text, and words of the text of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    spelled = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where("conv_id IS NOT NULL").select(
        "conv_id",
        "turn",
        F.unhex(F.sha2(spelled, 256)).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest"))
    return turns.select("conv_id", place.alias("place"), "digest", "words")


def with_starts(turns: DataFrame) -> DataFrame:
    """Turns and, for each conversation, a row of place 0 without digest: its empty prefix."""
    return turns.unionByName(_starts(turns.where("place = 1").select("conv_id")))


def _starts(ids: DataFrame) -> DataFrame:
    return ids.select("conv_id", F.lit(0).alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))


def rebuilt(turns: DataFrame, block: int = 20, heads: int = 4) -> DataFrame:
    """Conversations that start like the first of their block of ids; with their rows of place 0.

    Conversation c takes the first h turns of c - c % block, then its own turns after its
    first h, where h = crc32 of the decimal c modulo ``heads``.  A base's head goes to under 2 * block conversations.
    """
    turns = write_table(turns, "ordered-turns")
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    ids = turns.where("place = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % block).alias("base"), head.alias("h"))
    bases = turns.where((F.col("conv_id") % block == 0) & (F.col("place") < heads)).withColumnRenamed("conv_id", "base")
    taken = ids.where("h > 0").join(bases, "base").where("place <= h").select("conv_id", "place", "digest", "words")
    own = turns.where(F.col("place") > head)
    return own.unionByName(taken).unionByName(_starts(ids.select("conv_id")))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, prefix, parent (their digests), words and last (whether the conversation ends there) of each prefix."""
    ship_package(turns.sparkSession)
    schema = T.StructType([turns.schema["conv_id"], *T._parse_datatype_string("depth int, prefix binary, parent binary, words long, last boolean").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running, depth, held = hashlib.sha256(), 0, None
        for batch in batches:
            done = []
            for conv, place, digest, words in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "digest", "words"))):
                if held:
                    done.append((*held, place == 0))
                if place == 0:
                    running, depth, above = hashlib.sha256(), 0, None
                else:
                    running.update(digest)
                    depth, above = depth + 1, held[2]
                held = (conv, depth, running.digest()[:DIGEST_BYTES], above, words)
            yield _batch(done, arrow)
        if held:
            yield _batch([(*held, True)], arrow)

    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(x), type=f.type) for x, f in zip(columns, schema)], names=schema.names)


def _counters(digest: str, width: int) -> list[Column]:
    """The counter of a digest in each row of the sketch, all rows laid end to end."""
    return [F.pmod(F.xxhash64(digest, F.lit(r)), F.lit(width)) + F.lit(r * width) for r in range(SKETCH_ROWS)]


def screened(found: DataFrame, most_counters: int = COUNTERS) -> DataFrame:
    """found with shared and parent_shared: whether the sketch's estimate is over one.

    Digests stay only where they are needed: a proven tail below a proven tail has none.
    """
    wanted = max(2, min(most_counters, COUNTERS_EACH * found.count()))
    width = 1 << (wanted - 1).bit_length()
    counted = found.where("depth > 0").select(F.explode(F.array(*_counters("prefix", width))).alias("counter")).groupBy("counter").agg(F.count("*").alias("n"))
    over = counted.where("n > 1").withColumn("piece", F.floor(F.col("counter") / PIECE_BITS))
    pieces = over.groupBy("piece").agg(F.bitmap_construct_agg(F.col("counter") % PIECE_BITS).alias("bits"))
    bitmap = np.zeros(-(-SKETCH_ROWS * width // PIECE_BITS) * PIECE_BITS // 8, np.uint8)
    for row in pieces.toLocalIterator():  # SKETCH_ROWS * COUNTERS bits at most
        at = row["piece"] * PIECE_BITS // 8
        bitmap[at : at + PIECE_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    bits = found.sparkSession.sparkContext.broadcast(bitmap)

    names = found.columns
    asked = [c.alias(f"{digest}_{r}") for digest in ("prefix", "parent") for r, c in enumerate(_counters(digest, width))]
    schema = T.StructType([*found.schema.fields, T.StructField("shared", T.BooleanType()), T.StructField("parent_shared", T.BooleanType())])

    def over_one(batch: pa.RecordBatch, digest: str) -> np.ndarray:
        all_over = np.ones(batch.num_rows, bool)
        for r in range(SKETCH_ROWS):
            counter = batch.column(f"{digest}_{r}").to_numpy()
            all_over &= (bits.value[counter >> 3] >> (counter & 7).astype(np.uint8) & 1).astype(bool)
        return all_over

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth = batch.column("depth").to_numpy()
            flags = [(depth == 0) | over_one(batch, "prefix"), (depth <= 1) | over_one(batch, "parent")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, flags)], names=schema.names)

    marked = found.select("*", *asked).mapInArrow(run, schema)
    return marked.withColumns({"prefix": F.when(F.col("shared"), F.col("prefix")), "parent": F.when(F.col("shared") | F.col("parent_shared"), F.col("parent"))})


def end_lists(ends: DataFrame) -> DataFrame:
    """prefix and the digest of its comma-joined conv_ids in ascending order.

    Ids are sorted and spelled by ranges of (prefix, conv_id), so a prefix with
    very many is spread; one task then only feeds its pieces, in order, to the digest.
    """
    ship_package(ends.sparkSession)
    pieces = T.StructType([ends.schema["prefix"], T.StructField("first", ends.schema["conv_id"].dataType), T.StructField("piece", T.StringType())])
    spelled = to_arrow_schema(pieces)
    hashed = T._parse_datatype_string("prefix binary, ends_sha256 string")
    digests = to_arrow_schema(hashed)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: list[tuple] = []
            for prefix, conv in zip(batch.column("prefix").to_pylist(), batch.column("conv_id").to_pylist()):
                if done and done[-1][0] == prefix and len(done[-1][2]) < PIECE_IDS:
                    done[-1][2].append(str(conv))
                else:
                    done.append((prefix, conv, [str(conv)]))
            yield _batch([(prefix, first, ",".join(ids)) for prefix, first, ids in done], spelled)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_prefix, running = None, None
        for batch in batches:
            done = []
            for prefix, piece in zip(batch.column("prefix").to_pylist(), batch.column("piece").to_pylist()):
                if prefix != open_prefix:
                    if running:
                        done.append((open_prefix, running.hexdigest()))
                    open_prefix, running = prefix, hashlib.sha256()
                else:
                    running.update(b",")
                running.update(piece.encode())
            yield _batch(done, digests)
        if running:
            yield _batch([(open_prefix, running.hexdigest())], digests)

    by_range = ends.select("prefix", "conv_id").repartitionByRange("prefix", "conv_id").sortWithinPartitions("prefix", "conv_id")
    listed = write_table(by_range.mapInArrow(spell, pieces), "trie-ends")
    return listed.repartition("prefix").sortWithinPartitions("prefix", "first").mapInArrow(digest, hashed)


def nodes(turns: DataFrame, most_counters: int = COUNTERS) -> DataFrame:
    """The trie's nodes, from turns with rows of place 0: conv_id (the smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens (words of repeated prefixes in the subtree) and ends_sha256."""
    found = write_table(prefixes(turns), "trie-prefixes")
    marked = write_table(screened(found, most_counters), "trie-screened")
    rows = marked.where("shared")
    heads, tails = marked.where("NOT shared AND parent_shared"), marked.where("NOT shared AND NOT parent_shared")
    # Depth, parent and words follow from the prefix; as keys they let the counts be summed before the shuffle.
    exact = rows.groupBy("prefix", "parent", "depth", "words").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    exact = write_table(exact.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "trie-nodes")

    children = exact.where("depth > 0").select("parent").unionByName(heads.select("parent")).groupBy("parent").agg(F.count("*").alias("n_children"))
    counted = write_table(exact.join(children.withColumnRenamed("parent", "prefix"), "prefix", "left").fillna(0, ["n_children"]), "trie-children")

    # What each conversation owns: its leaf, and the words saved on its stretch.
    owned = (
        marked.where("NOT shared AND last").select("conv_id", F.lit(1).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved"))
        .unionByName(counted.select("conv_id", (F.col("n_children") == 0).cast("long").alias("leaf"), "saved"))
        .groupBy("conv_id").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    )
    # Written, so that a conversation with very many prefixes is a skewed join that adaptive execution splits.
    owned = write_table(owned.where("leaf > 0 OR saved > 0"), "trie-owned")
    sums = rows.select("prefix", "conv_id").join(owned, "conv_id").groupBy("prefix").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("of_members"))
    above = F.sum("saved").over(Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1))
    summed = counted.withColumn("above", F.coalesce(above, F.lit(0))).join(sums, "prefix").join(end_lists(rows.where("last")), "prefix", "left")
    summed = write_table(summed, "trie-sums")

    owner = exact.select(F.col("prefix").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    one = F.lit(1).cast("long")
    # A prefix that only the sketch lets through may lie below a proven tail: its parent is its conversation's own.
    parent = F.coalesce("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id"))).alias("parent_conv_id")
    shared_nodes = summed.join(owner, "parent", "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), parent, "n_convs", "n_children", "n_leaves",
        (F.col("of_members") - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )

    def alone(part: DataFrame, parent: str) -> DataFrame:
        spelled = F.when(F.col("last"), F.col("conv_id").cast("string")).otherwise("")
        return part.select(
            "conv_id", F.col("depth").cast("long").alias("depth"), F.col(parent).alias("parent_conv_id"), one.alias("n_convs"), (~F.col("last")).cast("long").alias("n_children"),
            one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.sha2(spelled.cast("binary"), 256).alias("ends_sha256"),
        )

    first_alone = heads.join(owner, "parent")
    return shared_nodes.unionByName(alone(first_alone, "parent_conv_id")).unionByName(alone(tails, "conv_id"))


def trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are."""
    return nodes(with_starts(write_table(ordered_turns(conversations), "ordered-turns")))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations that share the starts of their blocks."""
    return nodes(rebuilt(ordered_turns(conversations)))
