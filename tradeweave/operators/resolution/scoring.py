"""Weighted match confidence."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeweave.functions.columns import attach, rounded
from tradeweave.functions.prefixes import SLACK
from tradeweave.operators.edges import neighbour_pairs
from tradeweave.operators.resolution.blocking import ATTRIBUTES, attainable_candidates, least_support, name_keys
from tradeweave.operators.resolution.signals import name_bound, partner_counts, score_names, trading_overlap
from tradeweave.schema import MATCH_COLUMNS
from tradeweave.session import write_table

# Share of each signal in the confidence, and the least kept.
WEIGHTS = {"name_sim": 0.40, "industry_sim": 0.20, "region_sim": 0.15, "trading_sim": 0.25}
MIN_CONFIDENCE = 0.45


def _confidence(weights: Mapping[str, float], trading: Column, name: Column | None = None) -> Column:
    return (
        F.lit(weights["name_sim"]) * (F.col("name_sim") if name is None else name)
        + F.lit(weights["industry_sim"]) * F.col("industry_sim")
        + F.lit(weights["region_sim"]) * F.col("region_sim")
        + F.lit(weights["trading_sim"]) * trading
    )


def match_confidence(
    signals: DataFrame,
    weights: Mapping[str, float] = WEIGHTS,
    min_conf: float | None = MIN_CONFIDENCE,
    ids: tuple[str, str] = MATCH_COLUMNS[:2],
) -> DataFrame:
    """Match edges: the threshold sees the exact sum, the stored values are rounded."""
    scored = signals.withColumn("exact", _confidence(weights, F.col("trading_sim")))
    if min_conf is not None:
        scored = scored.where(F.col("exact") >= min_conf)
    return scored.select(
        *ids,
        rounded(F.col("exact"), 4).alias("confidence"),
        rounded(F.col("name_sim"), 4).alias("name_sim"),
        "industry_sim",
        "region_sim",
        rounded(F.col("trading_sim"), 4).alias("trading_sim"),
    ).select(*ids, *MATCH_COLUMNS[2:])


def attribute_signals(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """Industry and region signals and both names, with one look-up per side."""
    fields = {"name": "name", "sic_code": "sic", "region": "region"}
    both = attach(pairs, entities, "unbanked_id", {k: f"_u_{v}" for k, v in fields.items()})
    both = attach(both, entities, "banked_id", {k: f"_b_{v}" for k, v in fields.items()})
    same = lambda f: F.when(F.col(f"_u_{f}") == F.col(f"_b_{f}"), 1.0).otherwise(0.0)
    return both.select(
        *pairs.columns,
        same("sic").alias("industry_sim"),
        same("region").alias("region_sim"),
        F.lower("_u_name").alias("_u_name"),
        F.lower("_b_name").alias("_b_name"),
    )


def score_pairs(
    pairs: DataFrame,
    entities: DataFrame,
    trades: DataFrame,
    weights: Mapping[str, float] = WEIGHTS,
    min_conf: float | None = MIN_CONFIDENCE,
    prefix_scale: str = "standard",
    partners: DataFrame | None = None,
) -> DataFrame:
    """All four signals and the confidence of given (banked_id, unbanked_id) pairs.

    The overlap of two partner sets is at most the smaller size over the larger, and
    names of different lengths are alike up to a bound.  Pairs that would miss
    the threshold even at both bounds are dropped before names are compared,
    and with the true name similarity again before partners are.
    """
    partners = neighbour_pairs(trades) if partners is None else partners
    signals = attribute_signals(pairs.select("banked_id", "unbanked_id"), entities)
    names = (F.col("_u_name"), F.col("_b_name"))
    if min_conf is None:
        scored = score_names(signals, *names, prefix_scale)
    else:
        counts = partner_counts(partners)
        bounded = signals
        for side, name in (("unbanked_id", "_n_u"), ("banked_id", "_n_b")):
            bounded = bounded.join(
                counts.select(F.col("id").alias(side), F.col("partners").alias(name)), side, "left"
            )
        most = F.greatest(F.coalesce("_n_u", F.lit(0)), F.coalesce("_n_b", F.lit(0))).cast("double")
        least = F.least(F.coalesce("_n_u", F.lit(0)), F.coalesce("_n_b", F.lit(0))).cast("double")
        bounded = bounded.withColumn("_at_best", F.when(most > 0, least / most).otherwise(0.0)).drop("_n_u", "_n_b")
        # The small allowance keeps rounding in the bound from dropping a pair.
        attainable = _confidence(weights, F.col("_at_best"), name_bound(*names)) >= min_conf - 1e-9
        scored = score_names(bounded.where(attainable), *names, prefix_scale)
        scored = scored.where(_confidence(weights, F.col("_at_best")) >= min_conf - 1e-9).drop("_at_best")
    scored = scored.drop("_u_name", "_b_name")
    return match_confidence(trading_overlap(scored, trades, partners), weights, min_conf)


def match_entities(
    entities: DataFrame,
    trades: DataFrame,
    weights: Mapping[str, float] = WEIGHTS,
    min_conf: float = MIN_CONFIDENCE,
    partners: DataFrame | None = None,
    **blocking,
) -> DataFrame:
    """The whole pipeline: blocking by what can reach the threshold, signals, confidence.

    Entities of one name, industry and region are a kind, and all signals but the partners are worked out
    per pair of kinds.  Pairs of entities that have partners in common are met at these and scored one by one; of the
    others, whole pairs of kinds match or don't, and they are spelled out last.  What ids stand for that several
    entities have depends on the pair, so such pairs are scored by ``score_pairs``.
    """
    partners = neighbour_pairs(trades) if partners is None else partners
    known = entities.where(F.col("entity_id").isNotNull())
    repeated = write_table(known.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("entity_id"), "repeated-ids")
    odd = not repeated.isEmpty()
    if odd:
        known = known.join(repeated, "entity_id", "left_anti")
    keys = name_keys(entities, **blocking)
    unbanked = _side(known, "unbanked", keys.unbanked)
    banked = _side(known, "banked", keys.banked)
    base = _confidence(weights, F.lit(0.0), F.lit(0.0))

    alike = write_table(_kind_pairs(unbanked, banked, weights, min_conf), "kind-pairs")
    met = _meetings(unbanked, banked, partners).where(_confidence(weights, F.col("trading_sim"), F.lit(1.0)) >= min_conf - SLACK)
    met = write_table(met, "meetings")
    reach = alike.select("u_name", "b_name", base.alias("reach")).unionByName(met.select("u_name", "b_name", _confidence(weights, F.col("trading_sim"), F.lit(0.0)).alias("reach")))
    reach = reach.groupBy("u_name", "b_name").agg(F.max("reach").alias("reach"))
    named = reach.join(unbanked.names.select(F.col("number").alias("u_name"), F.lower("name").alias("_u_name")), "u_name")
    named = named.join(banked.names.select(F.col("number").alias("b_name"), F.lower("name").alias("_b_name")), "b_name")
    attainable = F.col("reach") + F.lit(weights["name_sim"]) * name_bound(F.col("_u_name"), F.col("_b_name")) >= min_conf - SLACK
    names = write_table(score_names(named.where(attainable), F.col("_u_name"), F.col("_b_name")).select("u_name", "b_name", "name_sim"), "name-pairs")

    shared = met.join(names, ["u_name", "b_name"])
    close = write_table(match_confidence(shared, weights, min_conf), "matches-met")
    kinds = match_confidence(alike.join(names, ["u_name", "b_name"]).withColumn("trading_sim", F.lit(0.0)), weights, min_conf, ("u_kind", "b_kind"))
    found = close.unionByName(_spelled(kinds, close, unbanked, banked))
    if odd:
        pairs = write_table(attainable_candidates(entities, partners, weights, min_conf, **blocking, only=repeated), "attainable")
        found = found.unionByName(score_pairs(pairs, entities, trades, weights, min_conf, partners=partners))
    return found


#: Members of a kind that are listed in one row.
MEMBERS = 1_000


class _Side(NamedTuple):
    names: DataFrame  # number, name
    keys: DataFrame  # name (its number), key
    kinds: DataFrame  # kind, name (its number), members, and the attributes
    members: DataFrame  # id, kind, slot


def _side(entities: DataFrame, status: str, keys: DataFrame) -> _Side:
    """The entities of a status whose names have keys."""
    keys = write_table(keys, "name-keys")
    numbered = lambda rows, as_: rows.withColumn(as_, F.monotonically_increasing_id())
    names = write_table(numbered(keys.select("name").distinct(), "number"), "names")
    attributes = list(ATTRIBUTES.values())
    rows = entities.where(F.col("status") == status).select(F.col("entity_id").alias("id"), "name", *attributes)
    rows = rows.join(names, "name").select("id", F.col("number").alias("name"), *attributes)
    kinds = write_table(numbered(rows.groupBy("name", *attributes).agg(F.count(F.lit(1)).alias("members")), "kind"), "kinds")
    a, b = rows.alias("a"), kinds.alias("b")
    same = F.col("a.name") == F.col("b.name")
    for c in attributes:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    members = a.join(b, same).select("id", "kind", F.pmod(F.xxhash64("id"), _slots("members")).alias("slot"))
    keys = keys.join(names, "name").select(F.col("number").alias("name"), "key")
    return _Side(names, keys, kinds, write_table(members, "members"))


def _slots(members: str) -> Column:
    return F.ceil(F.col(members) / F.lit(MEMBERS))


def _same(attribute: str) -> Column:
    return F.when(F.col(f"u_{attribute}") == F.col(f"b_{attribute}"), 1.0).otherwise(0.0)


def _prefixed(rows: DataFrame, prefix: str, *keep: str) -> DataFrame:
    return rows.select(*keep, *[F.col(c).alias(f"{prefix}_{c}") for c in rows.columns if c not in keep])


def _kind_pairs(unbanked: _Side, banked: _Side, weights: Mapping[str, float], min_conf: float) -> DataFrame:
    """(u_kind, b_kind, u_name, b_name, and the signals of attributes) of kinds that share a key and can match without partners."""
    every = None
    for signals in least_support(weights, min_conf):
        if "trading_sim" in signals:
            continue
        shared = [ATTRIBUTES[s] for s in signals]
        left, right = (
            _prefixed(side.kinds.drop("members").join(side.keys, "name").select("*", *[F.col(c).alias(f"on_{c}") for c in shared]), prefix, "key", *[f"on_{c}" for c in shared])
            for side, prefix in ((unbanked, "u"), (banked, "b"))
        )
        met = left.join(right, ["key", *[f"on_{c}" for c in shared]])
        met = met.select("u_kind", "b_kind", "u_name", "b_name", *[_same(c).alias(s) for s, c in ATTRIBUTES.items()])
        every = met if every is None else every.unionByName(met)
    if every is None:
        columns = [F.lit(0).cast("long").alias(c) for c in ("u_kind", "b_kind", "u_name", "b_name")]
        return unbanked.kinds.limit(0).select(*columns, *[F.lit(0.0).alias(s) for s in ATTRIBUTES])
    return every.distinct()


def _meetings(unbanked: _Side, banked: _Side, partners: DataFrame) -> DataFrame:
    """The pairs of entities that share a key and a partner, with their names and all signals but the names'."""
    counts = partner_counts(partners)

    def sides(side: _Side, prefix: str) -> tuple[DataFrame, DataFrame]:
        rows = side.members.select("id", "kind").join(side.kinds.drop("members"), "kind")
        at = rows.select("id", "name").join(side.keys, "name").select("id", "key")
        return at.join(partners, "id").select("nbr", "key", F.col("id").alias(f"{prefix}_id")), _prefixed(rows.join(counts, "id"), prefix)

    (mine, u), (theirs, b) = sides(unbanked, "u"), sides(banked, "b")
    # Names that share several keys meet at each of them, at all the partners they share.
    met = mine.join(theirs, ["nbr", "key"]).select("u_id", "b_id", "key").repartition("u_id", "b_id")
    shared = met.groupBy("u_id", "b_id", "key").agg(F.count(F.lit(1)).alias("n")).groupBy("u_id", "b_id").agg(F.max("n").cast("double").alias("n"))
    union = (F.col("u_partners") + F.col("b_partners")).cast("double") - F.col("n")
    return shared.join(u, "u_id").join(b, "b_id").select(
        F.col("u_id").alias("unbanked_id"), F.col("b_id").alias("banked_id"), "u_name", "b_name",
        *[_same(c).alias(s) for s, c in ATTRIBUTES.items()], (F.col("n") / union).alias("trading_sim"),
    )


def _spelled(kinds: DataFrame, known: DataFrame, unbanked: _Side, banked: _Side) -> DataFrame:
    """The pairs of entities behind pairs of kinds, without those already known: these have partners in common."""
    lists = banked.members.groupBy(F.col("kind").alias("b_kind"), "slot").agg(F.collect_list("id").alias("ids"))
    slots = banked.kinds.select(F.col("kind").alias("b_kind"), F.explode(F.sequence(F.lit(0).cast("long"), _slots("members") - 1)).alias("slot"))
    at = banked.members.select(F.col("id").alias("banked_id"), F.col("kind").alias("b_kind"), "slot")
    less = known.select("unbanked_id", "banked_id").join(at, "banked_id").groupBy("unbanked_id", "b_kind", "slot").agg(F.collect_list("banked_id").alias("less"))
    rows = kinds.join(slots, "b_kind").join(unbanked.members.select(F.col("id").alias("unbanked_id"), F.col("kind").alias("u_kind")), "u_kind").drop("u_kind")
    rows = rows.join(less, ["unbanked_id", "b_kind", "slot"], "left").join(lists, ["b_kind", "slot"])
    left = F.when(F.col("less").isNull(), F.col("ids")).otherwise(F.array_except("ids", "less"))
    return rows.withColumn("banked_id", F.explode(left)).select(*MATCH_COLUMNS)


def score_named_pair(
    entities: DataFrame,
    trades: DataFrame,
    banked_id,
    unbanked_id,
    min_conf: float | None = MIN_CONFIDENCE,
    prefix_scale: str = "standard",
) -> DataFrame:
    """Score one given pair without blocking; no threshold when min_conf is None."""
    id_type = entities.schema["entity_id"].dataType
    banked = entities.where(F.col("entity_id") == F.lit(banked_id)).select(
        F.col("entity_id").alias("banked_id"), F.lit(unbanked_id).cast(id_type).alias("unbanked_id")
    )
    exists = entities.where(F.col("entity_id") == F.lit(unbanked_id)).select(
        F.col("entity_id").alias("unbanked_id")
    )
    pair = banked.join(exists, "unbanked_id", "left_semi")
    return score_pairs(pair, entities, trades, min_conf=min_conf, prefix_scale=prefix_scale)
