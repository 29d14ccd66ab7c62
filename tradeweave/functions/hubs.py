"""Exact handling of entities with very many partners.

Enumerating all pairs of partners of one entity costs its degree squared.  The
operators that need such pairs enumerate them only below a degree bound.  Above
it they use that what an entity meets through hubs depends only on which hubs it
touches, and work with classes of entities that touch the same hubs.  A class is known
by a digest of its hubs and spelled out as rows; no row holds a set of hubs or partners.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeweave.session import write_table

HUB_DEGREE = 1_000
#: What one bitmap row spans: the chunk of bitmap_construct_agg.
CHUNK = 32_768
#: A chunk with fewer of a hub's entities is listed: 8 bytes for each of them are less than a bitmap.
FULL = 512


class Hubs(NamedTuple):
    ids: DataFrame  # hub, degree
    touch: DataFrame  # id, hub
    classes: DataFrame  # id, hub_class, hubs (how many); only entities that touch a hub
    spelled: DataFrame  # hub_class, hub

    def reach(self, full: int = FULL, list_rows: int = HUB_DEGREE) -> DataFrame:
        """(hub_class, reach): the distinct entities that touch any hub of a class.

        A hub's entities are numbered.  A chunk of numbers of which a hub has ``full`` or more is a bitmap of
        4 KB, and what a hub has besides is listed, ``list_rows`` to a row: a bitmap for a few bits would be
        mostly zeros, and there is one for every hub and chunk.  Bitmaps are joined once per set of hubs that
        have any, lists per class, and what is listed counts if it is not in the bitmaps.
        One hub alone reaches its degree.
        """
        numbered = write_table(_numbered(self.touch.select("id").distinct()), "hub-numbers")
        placed = write_table(self.touch.join(numbered, "id").select("hub", "at", F.floor(F.col("at") / CHUNK).alias("chunk")), "hub-places")
        busy = write_table(placed.groupBy("hub", "chunk").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= full).drop("n"), "hub-chunks")
        bits = write_table(placed.join(busy, ["hub", "chunk"]).groupBy("hub", "chunk").agg(F.bitmap_construct_agg(F.col("at") % CHUNK).alias("bits")), "hub-bits")
        rest = placed.join(busy, ["hub", "chunk"], "left_anti").join(self.ids, "hub")
        slot = F.pmod(F.xxhash64("at"), F.ceil(F.col("degree") / F.lit(list_rows)))
        lists = write_table(rest.groupBy("hub", slot.alias("slot")).agg(F.collect_list("at").alias("members")).drop("slot"), "hub-lists")

        sizes = self.spelled.groupBy("hub_class").agg(F.count(F.lit(1)).alias("n"), F.min("hub").alias("hub"))
        alone = sizes.where("n = 1").join(self.ids, "hub").select("hub_class", F.col("degree").alias("reach"))
        several = self.spelled.join(sizes.where("n > 1").select("hub_class"), "hub_class")

        kinds = write_table(several.join(bits.select("hub").distinct(), "hub").groupBy("hub_class").agg(_digest("hub").alias("kind")), "hub-kinds")
        first = kinds.groupBy("kind").agg(F.min("hub_class").alias("hub_class"))
        unions = several.join(first, "hub_class").join(bits, "hub").groupBy("kind", "chunk").agg(F.bitmap_or_agg("bits").alias("bits"))
        unions = write_table(unions, "hub-unions")
        in_bits = kinds.join(unions.groupBy("kind").agg(F.sum(F.bitmap_count("bits")).alias("reach")), "kind").select("hub_class", "reach")

        # A class with very many listed entities counts them as rows, so that no row holds more than list_rows squared.
        volume = several.join(lists.groupBy("hub").agg(F.sum(F.size("members")).alias("n")), "hub").groupBy("hub_class").agg(F.sum("n").alias("n"))
        volume = write_table(volume.join(kinds, "hub_class", "left"), "hub-volumes")
        bound = list_rows * list_rows
        asked = lambda some: several.join(volume.where(some), "hub_class").join(lists, "hub")
        gathered = asked(F.col("n") <= bound).groupBy("hub_class", "kind").agg(F.array_distinct(F.flatten(F.collect_list("members"))).alias("members"))
        gathered = write_table(gathered.select("hub_class", "kind", F.size("members").cast("long").alias("reach"), F.when(F.col("kind").isNotNull(), F.col("members")).alias("members")), "hub-gathered")
        listed = gathered.where("kind IS NULL").select("hub_class", "reach")
        rows = gathered.where("kind IS NOT NULL").select("hub_class", "kind", F.explode("members").alias("at")).unionByName(
            asked(F.col("n") > bound).select("hub_class", "kind", F.explode("members").alias("at")).distinct()
        )
        known = rows.withColumn("chunk", F.floor(F.col("at") / CHUNK)).join(unions, ["kind", "chunk"], "left")
        beside = known.where(F.col("bits").isNull() | ~_has_bit("bits", "at")).groupBy("hub_class").agg(F.count(F.lit(1)).alias("reach"))
        counted = in_bits.unionByName(listed).unionByName(beside).groupBy("hub_class").agg(F.sum("reach").alias("reach"))
        return alone.unionByName(counted)


def _digest(hub: str) -> Column:
    """Names a set of hubs by their number and two digests that do not depend on order."""
    return F.concat_ws(":", F.count(F.lit(1)), F.bit_xor(F.xxhash64(hub)), F.bit_xor(F.xxhash64(hub, F.lit(1))))


def _numbered(ids: DataFrame) -> DataFrame:
    """(id, at): numbers from 0 without gaps, so that chunks fill up however many tasks number them."""
    raw = write_table(ids.withColumn("_k", F.monotonically_increasing_id()), "hub-raw-numbers").withColumn("_task", F.shiftright("_k", 33))
    # One row per task that numbered ids.
    before = F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    starts = raw.groupBy("_task").agg(F.count(F.lit(1)).alias("_n")).select("_task", F.coalesce(before, F.lit(0)).alias("_start"))
    return raw.join(F.broadcast(starts), "_task").select("id", (F.col("_start") + F.col("_k").bitwiseAND(F.lit((1 << 33) - 1))).alias("at"))


def _has_bit(bits: str, at: str) -> Column:
    place = f"({at} % {CHUNK})"
    byte = f"cast(conv(hex(substring({bits}, cast({place} div 8 AS int) + 1, 1)), 16, 10) AS int)"
    return F.expr(f"shiftright({byte}, cast({place} % 8 AS int)) & 1 = 1")


def split_hubs(pairs: DataFrame, hub_degree: int = HUB_DEGREE) -> Hubs | None:
    """Hubs among distinct undirected (id, nbr) pairs, or None if there are none.

    At most 2 * edges / hub_degree entities can be hubs.  Equal sets of hubs are found by
    their number and two digests that do not depend on order.
    """
    ids = write_table(
        pairs.groupBy("id").agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") > hub_degree).withColumnRenamed("id", "hub"), "hubs"
    )
    if ids.isEmpty():
        return None
    touch = write_table(pairs.join(ids.select(F.col("hub").alias("nbr")), "nbr").select("id", F.col("nbr").alias("hub")), "hub-touch")
    classes = write_table(touch.groupBy("id").agg(_digest("hub").alias("hub_class"), F.count(F.lit(1)).alias("hubs")), "hub-classes")
    first = classes.groupBy("hub_class").agg(F.min("id").alias("id"))
    spelled = write_table(touch.join(first, "id").select("hub_class", "hub"), "hub-class-rows")
    return Hubs(ids, touch, classes, spelled)
