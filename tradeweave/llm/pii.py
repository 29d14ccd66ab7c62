"""Personal data: fixed forms, and identifiers found from their context (operator 3).

Four fixed forms (e-mail, IP, card, phone) are matched in every whole text.
They are seeds of a bootstrap: the words before them are lexical patterns; number-like
and address-like strings that match no fixed form are candidates.  Patterns and
instances form a graph that is scored in rounds: a pattern is as reliable as
the instances it introduces, an instance as the patterns that introduce it.
Reliable patterns then name candidates of a fitting shape.

DataFrame functions only.  The texts are read once; what is found is written,
and the graph is a few small tables made from it by grouped sums.  Rows with no
candidate take no part in any shuffle.  Candidates are looked up by the set of
patterns of a row, so copies of a row are one look-up.

Context is the last two words on the match's line, however long they are.
Null and empty texts have no spans.  Repeated rows are kept and judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeweave.llm.spans import digest, in_blocks, let, matches, merged, overwrite, touches
from tradeweave.session import write_table

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
#: The fixed forms.  Possessive loops and start conditions change no match; they keep long runs linear.
FORMS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap conditions without which a form cannot match.
NEEDS = {"ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
CANDIDATE = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++|\+?[0-9(](?:[\x20().-]{{0,2}}+[0-9])++|(?<![A-Za-z0-9])[A-Za-z]{{1,6}}[-_]?[0-9](?:[-_]?+[A-Za-z0-9])++"
#: A pattern needs so many different seeds, and so large a share of reliable instances.
LEAST_SEEDS, RELIABLE = 3, 0.7
#: How much an instance counts that only other patterns vouch for; under 1, so scores settle and patterns cannot lift each other to certainty.
HEARSAY = 0.5
#: Scoring ends when no pattern's score moves by more than this.
SETTLED = 1e-3


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.char_length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    return F.lit(True)


def _patterns(before: Column) -> Column:
    """Lexical patterns ending in front of a match: its last two words, and a last word that ends in a colon, an equals sign or a number sign."""
    line = F.lower(before)
    two = F.regexp_extract(line, r"(?:^|\s)([^\s0-9]+)\s+([^\s0-9]+)\s*$", 1)
    last = F.regexp_extract(line, r"(?:^|\s)([^\s0-9]+)\s*$", 1)
    return F.filter(
        F.array(F.when(two != "", F.concat_ws(" ", two, last)), F.when(last.rlike(r"\w[:=#]$"), last)),
        lambda p: p.isNotNull(),
    )


def _fits(kind: Column, value: Column) -> Column:
    digits = F.char_length(F.regexp_replace(value, "[^0-9]", ""))
    return (
        F.when(kind == "email", value.contains("@"))
        .when(kind == "ip", value.rlike(r"^[0-9]+(?:\.[0-9]+)+$"))
        .otherwise((digits >= 7) & ~value.contains("@"))
    )


def _valid_matches(kind: str) -> Column:
    return F.filter(matches(F.col("t"), FORMS[kind]), lambda m: _valid(kind, m["value"]))


def _as_span(order: int, kind: str):
    return lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), m["end"].alias("end"))


def _as_seed(kind: str):
    return lambda m: F.struct(F.lit(kind).alias("kind"), m["value"].alias("value"), _patterns(m["before"]).alias("patterns"))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


SPAN = "array<struct<start: int, ord: int, kind: string, end: int>>"


def scan(docs: DataFrame, keep: list[str | Column], text: str = "text") -> DataFrame:
    """``keep`` with base (array of spans), seeds and others (arrays of value, patterns and place)."""
    source = docs.select(F.struct(*keep).alias("kept"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    source = source.withColumn("some", F.col("t").rlike("[0-9@]"))
    found = source
    for kind in KINDS:
        needed = F.col("t").contains("@") if kind == "email" else F.col("some") & F.col("t").rlike(NEEDS[kind])
        found = found.withColumn(kind, F.when(needed, _valid_matches(kind)))
    found = found.withColumn("others", F.when(F.col("some"), matches(F.col("t"), CANDIDATE))).drop("t", "some")
    spans, seeds = [], []
    for i, kind in enumerate(KINDS):
        known = F.coalesce(kind, F.array())
        spans.append(F.transform(known, _as_span(i, kind)))
        seeds.append(F.transform(known, _as_seed(kind)))
    found = found.select("kept", F.array_sort(F.concat(*spans)).alias("base"), F.concat(*seeds).alias("seeds"), "others")
    like = F.filter(F.coalesce("others", F.array()), lambda m: (F.char_length(m["value"]) >= 5) & F.regexp_like(m["value"], F.lit("[0-9@]")))
    apart = let(let(merged(F.col("base")), in_blocks), lambda known: F.filter(like, lambda m: ~touches(known, m["start"], m["end"])))
    placed = F.transform(apart, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), _patterns(m["before"]).alias("patterns")))
    return found.select("kept", F.col("base").cast(SPAN), F.filter("seeds", lambda s: F.size(s["patterns"]) > 0).alias("seeds"), F.filter(placed, lambda m: F.size(m["patterns"]) > 0).alias("others"))


def reliable_patterns(scanned: DataFrame, least: int = LEAST_SEEDS, reliable: float = RELIABLE, settled: float = SETTLED) -> DataFrame:
    """(pattern, kind, score): patterns whose instances are personal data, scored on the graph of patterns and instances.

    Each edge is one distinct (pattern, value), however many rows hold it, so
    copies do not vote.  An instance of the kind counts 1, one known as another kind 0, an unknown one HEARSAY times the
    chance that at least one of its other patterns is right.  A round takes two grouped sums over the edges; edges
    are far fewer than words, because only number- and address-like strings are instances.
    """
    seeds = scanned.select(F.explode("seeds").alias("s")).select(F.explode("s.patterns").alias("pattern"), F.col("s.value").alias("value"), F.col("s.kind").alias("kind"))
    others = scanned.select(F.explode("others").alias("s")).select(F.explode("s.patterns").alias("pattern"), F.col("s.value").alias("value"), F.lit(None).cast("string").alias("kind"))
    edges = write_table(seeds.unionByName(others).distinct(), "pattern-edges")
    known = edges.where("kind IS NOT NULL")
    # Only patterns with enough seeds can become reliable; the rest of the graph cannot matter.
    strong = known.groupBy("pattern", "kind").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= least)
    reach = write_table(
        strong.join(edges.withColumnRenamed("kind", "own"), "pattern")
        .groupBy("pattern", "kind", "value")
        .agg(F.max((F.col("own") == F.col("kind")).cast("int")).alias("seed"), F.max(F.when(F.col("own").isNotNull(), 1).otherwise(0)).alias("known")),
        "pattern-reach",
    )
    trust = F.when(F.col("seed") == 1, 1.0).when(F.col("known") == 1, 0.0)
    scores = write_table(reach.groupBy("pattern", "kind").agg(F.avg(F.coalesce(trust, F.lit(0.0))).alias("score"), F.lit(1.0).cast("double").alias("moved")), "pattern-scores")
    while (scores.agg(F.max("moved")).first()[0] or 0.0) > settled:
        # What an unknown instance says about a pattern is what the other patterns that introduce it say.
        voted = reach.join(scores.select("pattern", "kind", "score"), ["pattern", "kind"]).withColumn("doubt", F.log1p(-F.least("score", F.lit(0.99))))
        instance = voted.where("known = 0").groupBy("kind", "value").agg(F.sum("doubt").alias("all_doubt"))
        belief = HEARSAY * (1 - F.exp(F.col("all_doubt") - F.col("doubt")))
        scores = write_table(
            voted.join(instance, ["kind", "value"], "left")
            .groupBy("pattern", "kind", "score").agg(F.avg(F.coalesce(trust, belief, F.lit(0.0))).alias("new"))
            .select("pattern", "kind", F.col("new").alias("score"), F.abs(F.col("new") - F.col("score")).alias("moved")),
            "pattern-scores",
        )
    return scores.where(F.col("score") >= reliable).drop("moved")


def find(docs: DataFrame, keep: list[str | Column], text: str = "text") -> DataFrame:
    """``keep`` with base and spans (base and contextual finds), each an array of (start, ord, kind, end) in order."""
    scanned = scan(docs, keep, text).withColumn("patterns", F.array_sort(F.array_distinct(F.flatten("others.patterns"))))
    scanned = write_table(scanned.withColumn("key", F.when(F.size("patterns") > 0, F.sha2(F.array_join("patterns", "\n"), 256))), "pii-scan")
    reliable = reliable_patterns(scanned)
    asked = scanned.where("key IS NOT NULL").groupBy("key").agg(F.first("patterns").alias("patterns")).select("key", F.explode("patterns").alias("pattern"))
    # At most the four kinds for each pattern of a row.
    answer = asked.join(reliable, "pattern").groupBy("key").agg(F.collect_list(F.struct("pattern", "kind")).alias("accepted"))
    with_others = scanned.where("key IS NOT NULL").join(answer, "key", "left")
    named = F.transform(
        "others",
        lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.filter(F.lit(list(KINDS)), lambda k: F.exists("accepted", lambda a: (a["kind"] == k) & F.array_contains(m["patterns"], a["pattern"])) & _fits(k, m["value"])).alias("kinds")),
    )
    found = F.transform(
        F.filter(named, lambda m: F.size(m["kinds"]) > 0),
        lambda m: F.struct(m["start"].alias("start"), (F.array_position(F.lit(list(KINDS)), m["kinds"][0]) - 1).cast("int").alias("ord"), m["kinds"][0].alias("kind"), m["end"].alias("end")),
    )
    spans = F.when(F.col("accepted").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", found.cast(SPAN))))
    return (
        with_others.select("kept", "base", spans.alias("spans"))
        .unionByName(scanned.where("key IS NULL").select("kept", "base", F.col("base").alias("spans")))
        .select("kept.*", "base", "spans")
    )


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of each fixed form, digest of the fixed forms and all spans."""
    found = find(docs, ["doc_id"])
    return found.select("doc_id", *map(_count, KINDS), F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets; other columns are unchanged, and a null text stays null."""
    found = find(docs, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")])
    clean = overwrite(F.col("row.text"), F.col("spans"))
    return found.select(*[clean.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
