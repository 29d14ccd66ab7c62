"""Evidence that two entities are the same company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeweave.functions.columns import attach, deal_out
from tradeweave.functions.names import PREFIX_MAX, PREFIX_SCALE, jaro_winkler
from tradeweave.operators.edges import neighbour_pairs
from tradeweave.session import ship_package, write_table


def name_similarity(pairs: DataFrame, entities: DataFrame, prefix_scale: str = "standard") -> DataFrame:
    """Adds name_sim: Jaro-Winkler similarity of the lower-case names."""
    named = attach(pairs, entities, "unbanked_id", {"name": "_u_name"})
    named = attach(named, entities, "banked_id", {"name": "_b_name"})
    return score_names(named, F.lower("_u_name"), F.lower("_b_name"), prefix_scale).drop("_u_name", "_b_name")


def score_names(rows: DataFrame, first: Column, second: Column, prefix_scale: str = "standard") -> DataFrame:
    """Adds name_sim, computed once for each distinct pair of names and joined back by the names' digests.

    Names repeat: a hundred branches of one company against a hundred of another are one comparison.
    """
    ship_package(rows.sparkSession)
    keyed = rows.withColumns({"_first": first, "_second": second})
    keyed = write_table(keyed.withColumn("_names", F.when(F.col("_first").isNotNull() & F.col("_second").isNotNull(), F.md5(F.concat(F.char_length("_first").cast("string"), F.lit(":"), "_first", "_second")))), "named-pairs")
    distinct = keyed.where("_names IS NOT NULL").select("_names", "_first", "_second").distinct()
    known = deal_out(distinct, "_names").select("_names", jaro_winkler(F.col("_first"), F.col("_second"), prefix_scale).alias("name_sim"))
    return keyed.drop("_first", "_second").join(write_table(known, "name-scores"), "_names", "left").drop("_names")


def name_bound(first: Column, second: Column) -> Column:
    """A name similarity that cannot be exceeded, from the lengths and the common start of two names.

    At most as many letters agree as the shorter name has; agreement in the
    first letters can then add a tenth of what is left for each.
    """
    n, m = F.char_length(first).cast("double"), F.char_length(second).cast("double")
    jaro = F.when(F.greatest(n, m) > 0, (F.least(n, m) / F.greatest(n, m) + 2.0) / 3.0).otherwise(1.0)
    start = F.lit(0)
    for k in range(1, PREFIX_MAX + 1):
        start = F.when(F.substring(first, 1, k) == F.substring(second, 1, k), F.least(F.lit(k), n, m)).otherwise(start)
    return F.least(jaro + start * PREFIX_SCALE * (1.0 - jaro), F.lit(1.0))


def _same_attribute(pairs: DataFrame, entities: DataFrame, attribute: str, output: str) -> DataFrame:
    both = attach(pairs, entities, "unbanked_id", {attribute: "_u"})
    both = attach(both, entities, "banked_id", {attribute: "_b"})
    equal = F.when(F.col("_u") == F.col("_b"), 1.0).otherwise(0.0)
    return both.withColumn(output, equal).drop("_u", "_b")


def industry_match(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds industry_sim: 1.0 for the same industry, 0.0 otherwise or if unknown."""
    return _same_attribute(pairs, entities, "sic_code", "industry_sim")


def region_match(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds region_sim: 1.0 for the same region, 0.0 otherwise or if unknown."""
    return _same_attribute(pairs, entities, "region", "region_sim")


def partner_counts(partners: DataFrame) -> DataFrame:
    """Distinct undirected partners per entity, from (id, nbr) pairs."""
    return partners.groupBy("id").agg(F.count(F.lit(1)).alias("partners"))


def trading_overlap(pairs: DataFrame, trades: DataFrame, partners: DataFrame | None = None) -> DataFrame:
    """Adds trading_sim: Jaccard overlap of the partner sets, 0 if both are empty.

    Only the partners of the less connected side are listed and then looked up
    among those of the other side, so a pair costs its smaller degree even when
    the other side trades with a third of all entities.  ``partners``, if given, are
    the distinct undirected (id, nbr) pairs of ``trades``.
    """
    partners = neighbour_pairs(trades) if partners is None else partners
    counts = partner_counts(partners)
    sized = pairs
    for side, name in (("unbanked_id", "_n_u"), ("banked_id", "_n_b")):
        sized = sized.join(counts.select(F.col("id").alias(side), F.col("partners").alias(name)), side, "left")
    sized = sized.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("_n_u", "_n_b")})

    list_u = F.col("_n_u") <= F.col("_n_b")
    listed = sized.where((F.col("_n_u") > 0) & (F.col("_n_b") > 0)).select(
        "unbanked_id",
        "banked_id",
        F.when(list_u, F.col("unbanked_id")).otherwise(F.col("banked_id")).alias("_listed"),
        F.when(list_u, F.col("banked_id")).otherwise(F.col("unbanked_id")).alias("_probed"),
    )
    shared = (
        listed.join(partners.select(F.col("id").alias("_listed"), "nbr"), "_listed")
        .join(partners.select(F.col("id").alias("_probed"), "nbr"), ["_probed", "nbr"], "left_semi")
        .groupBy("unbanked_id", "banked_id")
        .agg(F.count(F.lit(1)).alias("_shared"))
    )
    common = F.coalesce("_shared", F.lit(0)).cast("double")
    union = (F.col("_n_u") + F.col("_n_b")).cast("double") - common
    return (
        sized.join(shared, ["unbanked_id", "banked_id"], "left")
        .withColumn("trading_sim", F.when(union > 0, common / union).otherwise(0.0))
        .drop("_n_u", "_n_b", "_shared")
    )
