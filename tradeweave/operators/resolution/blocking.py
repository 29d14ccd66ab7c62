"""Candidate pairs by fuzzy name tokens."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeweave.functions.columns import attach, broadcast_if_small, largest_first, rounded
from tradeweave.functions.names import fuzzy_vocabulary
from tradeweave.functions.prefixes import SLACK, early, enough, ranked
from tradeweave.session import write_table

WORD_BREAK = r"[^\p{L}\p{N}]+"


def _query_words(name: Column, strip: str, n_tokens: int) -> Column:
    """First words of a name after the given characters are removed."""
    clean = F.translate(name, strip, "")
    return F.slice(F.split(F.lower(clean), " "), 1, n_tokens)


def _index_words(name: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(name), WORD_BREAK)), lambda w: w != "")


def _word_matches(words: DataFrame, banked: DataFrame, max_edits: int) -> DataFrame:
    """(query word, indexed word, weight): rarer words and closer spellings weigh more.

    The rarity depends on the share of names that hold a word, so a match keeps
    its score as the table grows, and it is positive for any number of names.
    """
    indexed = banked.select(F.explode("words").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("names")
    )
    total = banked.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    names = F.col("names").cast("double")
    rarity = F.log(1.0 + (total - names + 0.5) / (names + 0.5))
    shorter = F.least(F.length("left_token"), F.length("right_token")).cast("double")
    close = 1.0 - F.col("edits").cast("double") / shorter
    return (
        fuzzy_vocabulary(words, indexed, max_edits)
        .join(indexed.select(F.col("token").alias("right_token"), "names"), "right_token")
        .select(
            F.col("left_token").alias("query"),
            F.col("right_token").alias("word"),
            (rarity * close).alias("weight"),
        )
        .where(F.col("weight") > 0)
    )


def _plain(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), WORD_BREAK, " "))


def _unlisted(rows: DataFrame) -> DataFrame:
    """Rows made from lists: the planner takes a list for one word, so left alone it would broadcast millions of them."""
    return rows.hint("merge")


def _equal_names(unbanked: DataFrame, banked: DataFrame, matches: DataFrame, postings: DataFrame) -> DataFrame:
    """(phrase, banked_id, score) of equal names, however common their words are."""
    pairs = unbanked.where("plain <> ''").select("phrase", "plain").distinct().join(banked.select("banked_id", "plain"), "plain")
    asked = pairs.select("phrase", "banked_id", F.posexplode("phrase").alias("pos", "query"))
    best = (
        asked.join(matches, "query").join(postings, ["banked_id", "word"])
        .groupBy("phrase", "banked_id", "pos").agg(F.max("weight").alias("weight"))
    )
    return best.groupBy("phrase", "banked_id").agg(F.sum("weight").alias("score"))


class _Hits(NamedTuple):
    """What the words of names say, per distinct phrase of first words and not per entity."""

    unbanked: DataFrame  # unbanked_id, phrase, plain, and attributes
    banked: DataFrame  # banked_id, words, plain, and attributes
    alone: list[DataFrame]  # phrase, word0, score: words that pass by themselves
    both: DataFrame | None  # phrase, word0, word1, score: words that pass together
    matches: DataFrame  # query, word, weight


def _hits(entities: DataFrame, n_tokens: int, max_edits: int, min_score: float, strip: str, attributes: tuple[str, ...] = ()) -> _Hits:
    if n_tokens not in (1, 2):
        raise ValueError("blocking uses the first one or two words")
    banked = entities.where(F.col("status") == "banked").select(
        F.col("entity_id").alias("banked_id"), _index_words(F.col("name")).alias("words"), _plain(F.col("name")).alias("plain"), *attributes
    )
    words = _query_words(F.col("name"), strip, n_tokens)
    unbanked = entities.where(F.col("status") == "unbanked").select(
        F.col("entity_id").alias("unbanked_id"), words.alias("phrase"), _plain(F.col("name")).alias("plain"), *attributes
    )
    phrases = unbanked.select("phrase").distinct()
    queries = phrases.select(F.explode("phrase").alias("token")).where(F.col("token") != "").distinct()
    matches = write_table(_word_matches(queries, banked, max_edits), "block-matches")

    def place(i: int) -> DataFrame:
        return phrases.where(F.size("phrase") > i).select("phrase", F.col("phrase")[i].alias("query")).join(
            matches, "query"
        ).select("phrase", F.col("word").alias(f"word{i}"), F.col("weight").alias(f"weight{i}"))

    alone = [
        place(i).where(F.col(f"weight{i}") > min_score).select("phrase", F.col(f"word{i}").alias("word0"), F.col(f"weight{i}").alias("score"))
        for i in range(n_tokens)
    ]
    both = None
    if n_tokens == 2:
        both = place(0).join(place(1), "phrase").withColumn("score", F.col("weight0") + F.col("weight1")).where(F.col("score") > min_score).drop("weight0", "weight1")
    return _Hits(unbanked, banked, alone, both, matches)


def _word_pairs(banked: DataFrame, *keep: str) -> DataFrame:
    first = banked.select("banked_id", *keep, F.explode("words").alias("word0"), "words")
    return _unlisted(first.select("banked_id", *keep, "word0", F.explode("words").alias("word1")))


def block_candidates(
    entities: DataFrame,
    n_tokens: int = 2,
    max_edits: int = 2,
    min_score: float = 3.0,
    strip: str = "()",
) -> DataFrame:
    """(unbanked_id, banked_id, block_score) of pairs whose score exceeds min_score, or whose whole names are equal.

    The score adds, over the first words of the unbanked name, the weight of the
    best matching word of the banked name.  Work is done per distinct phrase of
    first words, not per entity, and a word too common to pass on its own is only
    ever joined together with the other word.
    """
    found = _hits(entities, n_tokens, max_edits, min_score, strip)
    postings = _unlisted(found.banked.select("banked_id", F.explode("words").alias("word")))
    hits = [
        broadcast_if_small(one).join(postings.withColumnRenamed("word", "word0"), "word0").select("phrase", "banked_id", "score") for one in found.alone
    ]
    if found.both is not None:
        hits.append(broadcast_if_small(found.both).join(_word_pairs(found.banked), ["word0", "word1"]).select("phrase", "banked_id", "score"))
    hits.append(_equal_names(found.unbanked, found.banked, found.matches, postings))
    scored = hits[0]
    for more in hits[1:]:
        scored = scored.unionByName(more)
    best = scored.groupBy("phrase", "banked_id").agg(F.max("score").alias("score"))
    return best.join(found.unbanked.select("unbanked_id", "phrase"), "phrase").select(
        "unbanked_id", "banked_id", rounded(F.col("score"), 6).alias("block_score")
    )


#: The attribute behind each signal that is all or nothing.
ATTRIBUTES = {"industry_sim": "sic_code", "region_sim": "region"}


class NameKeys(NamedTuple):
    """Names that share a key are those that ``block_candidates`` puts together."""

    unbanked: DataFrame  # name, key
    banked: DataFrame  # name, key


def name_keys(entities: DataFrame, n_tokens: int = 2, max_edits: int = 2, min_score: float = 3.0, strip: str = "()") -> NameKeys:
    """What names must have in common, worked out per distinct name: a word, two words, or the whole name."""
    found = _hits(entities, n_tokens, max_edits, min_score, strip, ("name",))
    asked = write_table(found.unbanked.select("name", "phrase", "plain").distinct(), "block-unbanked-names")
    held = write_table(found.banked.select("name", "words", "plain").distinct(), "block-banked-names")
    # Words are letters and digits, so the three kinds of keys differ.
    by_words = found.alone[0].select("phrase", F.col("word0").alias("key"))
    for more in found.alone[1:]:
        by_words = by_words.unionByName(more.select("phrase", F.col("word0").alias("key")))
    if found.both is not None:
        by_words = by_words.unionByName(found.both.select("phrase", F.concat_ws(" ", "word0", "word1").alias("key")))
    by_words = write_table(by_words.distinct(), "block-keys")
    whole = F.concat(F.lit("= "), "plain").alias("key")
    equal = asked.where("plain <> ''").select("name", "plain", F.explode("phrase").alias("query")).join(found.matches.select("query", "word"), "query")
    equal = equal.where(F.array_contains(F.split("plain", " "), F.col("word"))).select("name", whole)
    unbanked = asked.join(by_words, "phrase").select("name", "key").unionByName(equal).distinct()

    first = held.select("name", "words", F.explode("words").alias("word0"))
    every = _unlisted(first.select("name", F.col("word0").alias("key")))
    if found.both is not None:
        every = every.unionByName(_unlisted(first.select("name", "word0", F.explode("words").alias("word1"))).select("name", F.concat_ws(" ", "word0", "word1").alias("key")))
    every = every.unionByName(held.where("plain <> ''").select("name", whole))
    numbers = write_table(unbanked.select("key").distinct().withColumn("number", F.monotonically_increasing_id()), "block-key-numbers")
    numbered = lambda rows: rows.join(numbers, "key").select("name", F.col("number").alias("key"))
    return NameKeys(numbered(unbanked), numbered(every).distinct())


def least_support(weights: Mapping[str, float], min_conf: float) -> list[tuple[str, ...]]:
    """Smallest sets of signals besides the name without which no name reaches the threshold."""
    others = [s for s in weights if s != "name_sim"]
    enough: list[tuple[str, ...]] = []
    for n in range(len(others) + 1):
        for some in combinations(others, n):
            reach = weights["name_sim"] + sum(weights[s] for s in some)
            if reach >= min_conf - SLACK and not any(set(e) <= set(some) for e in enough):
                enough.append(some)
    return enough


def attainable_candidates(
    entities: DataFrame,
    partners: DataFrame,
    weights: Mapping[str, float],
    min_conf: float,
    n_tokens: int = 2,
    max_edits: int = 2,
    min_score: float = 3.0,
    strip: str = "()",
    only: DataFrame | None = None,
) -> DataFrame:
    """(unbanked_id, banked_id): the pairs of ``block_candidates`` that can reach a confidence, and no others are made.

    A name alone does not reach the threshold, so a pair also shares an industry, a
    region or enough partners.  The candidates are the union of joins on the
    word together with each of these; the pairs that share no more than a word
    are never put together.  ``partners`` are distinct undirected (id, nbr) pairs.
    ``only``, if given, are ids (entity_id) of which a pair has one at least.
    """
    support = least_support(weights, min_conf)
    if () in support:
        every = block_candidates(entities, n_tokens, max_edits, min_score, strip).select("unbanked_id", "banked_id")
        if only is None:
            return every
        of = lambda rows, side, how: rows.join(only.select(F.col("entity_id").alias(side)), side, how).select("unbanked_id", "banked_id")
        return of(every, "unbanked_id", "left_semi").unionByName(of(of(every, "unbanked_id", "left_anti"), "banked_id", "left_semi"))
    found = _hits(entities, n_tokens, max_edits, min_score, strip, tuple(ATTRIBUTES.values()))
    found = found._replace(unbanked=write_table(found.unbanked, "block-unbanked"), banked=write_table(found.banked, "block-banked"))
    alone = found.alone[0]
    for more in found.alone[1:]:
        alone = alone.unionByName(more)
    alone = write_table(alone.select("phrase", "word0").distinct(), "block-words")
    both = None if found.both is None else write_table(found.both.select("phrase", "word0", "word1").distinct(), "block-word-pairs")
    # Equal names pass by the phrase that asks for them.
    equal = found.unbanked.where("plain <> ''").select("phrase", "plain", F.explode("phrase").alias("query"))
    equal = equal.join(found.matches.select("query", "word"), "query").where(F.array_contains(F.split("plain", " "), F.col("word"))).select("phrase", "plain").distinct()
    equal = write_table(equal, "block-equal-names")
    some = [found]
    if only is not None:
        of = lambda rows, side: rows.join(only.select(F.col("entity_id").alias(side)), side, "left_semi")
        some = [found._replace(unbanked=of(found.unbanked, "unbanked_id")), found._replace(banked=of(found.banked, "banked_id"))]
    pairs = []
    for signals in support:
        keys = [ATTRIBUTES[s] for s in signals if s in ATTRIBUTES]
        if "trading_sim" in signals:
            left = min_conf - weights["name_sim"] - sum(weights[s] for s in signals if s in ATTRIBUTES)
            pairs += [_by_partners(one, alone, both, equal, partners, left / weights["trading_sim"], keys) for one in some]
        else:
            pairs += [_by_attributes(one, alone, both, equal, keys) for one in some]
    every = pairs[0]
    for more in pairs[1:]:
        every = every.unionByName(more)
    return every.distinct()


def _by_attributes(found: _Hits, alone: DataFrame, both: DataFrame | None, equal: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs that share the keys and words that pass."""
    asked = found.unbanked.select("phrase", *keys).dropna().distinct()
    postings = _unlisted(found.banked.select("banked_id", *keys, F.explode("words").alias("word0")))
    met = [broadcast_if_small(asked.join(alone, "phrase")).join(postings, ["word0", *keys])]
    if both is not None:
        met.append(broadcast_if_small(asked.join(both, "phrase")).join(_word_pairs(found.banked, *keys), ["word0", "word1", *keys]))
    met.append(asked.join(equal, "phrase").join(found.banked.select("banked_id", "plain", *keys), ["plain", *keys]))
    every = met[0].select("phrase", "banked_id", *keys)
    for more in met[1:]:
        every = every.unionByName(more.select("phrase", "banked_id", *keys))
    return every.distinct().join(found.unbanked.select("unbanked_id", "phrase", *keys), ["phrase", *keys]).select("unbanked_id", "banked_id")


def _by_partners(found: _Hits, alone: DataFrame, both: DataFrame | None, equal: DataFrame, partners: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    """Pairs that share a word and a partner among the rarest of each, where sets at least this alike must meet."""
    sizes = partners.groupBy("id").agg(F.count(F.lit(1)).alias("size")).withColumn("spare", F.lit(0).cast("long"))
    members = write_table(early(ranked(partners.withColumnRenamed("nbr", "item"), sizes), threshold, 1), "block-partners")
    side = lambda prefix, name: members.select("item", F.col("id").alias(name), *[F.col(c).alias(f"{prefix}_{c}") for c in ("place", "held", "size", "spare")])
    mine = side("a", "unbanked_id").join(found.unbanked.select("unbanked_id", "phrase", *keys), "unbanked_id")
    theirs = side("b", "banked_id").join(found.banked.select("banked_id", "words", "plain", *keys), "banked_id")
    fits, _ = enough(threshold, meetings=1)
    # Words that no phrase asks for are dropped before they are joined.
    asked = alone.select("word0") if both is None else alone.select("word0").unionByName(both.select("word0"))
    by_word = theirs.withColumn("word0", F.explode("words")).join(broadcast_if_small(asked.distinct()), "word0", "left_semi")
    met = [mine.join(alone, "phrase").join(by_word, ["item", "word0", *keys]).where(fits)]
    if both is not None:
        met.append(mine.join(both, "phrase").join(by_word, ["item", "word0", *keys]).where(fits & F.array_contains("words", F.col("word1"))))
    met.append(mine.join(equal, "phrase").join(theirs, ["item", "plain", *keys]).where(fits))
    every = met[0].select("unbanked_id", "banked_id")
    for more in met[1:]:
        every = every.unionByName(more.select("unbanked_id", "banked_id"))
    return every.distinct()


def block_candidates_preview(
    entities: DataFrame,
    n_tokens: int = 1,
    max_edits: int = 2,
    min_score: float = 1.5,
    n: int = 50,
) -> DataFrame:
    """Best candidates found with the first word only, to judge the blocking."""
    best = (
        block_candidates(entities, n_tokens, max_edits, min_score, strip="(")
        .orderBy(largest_first("block_score"), "unbanked_id", "banked_id")
        .limit(n)
    )
    best = attach(best, entities, "unbanked_id", {"name": "unbanked_name"})
    return attach(best, entities, "banked_id", {"name": "banked_name"}).select(
        "unbanked_id", "unbanked_name", "banked_id", "banked_name",
        rounded(F.col("block_score"), 3).alias("block_score"),
    )
