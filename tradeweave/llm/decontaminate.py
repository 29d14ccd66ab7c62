"""Benchmark decontamination by a broadcast set of test n-grams (operator 7).

Words are runs of ASCII letters and digits and of all other characters beyond
ASCII, after A-Z are lower-cased.  A window is 13 consecutive words of a test
item; an item of fewer words is one window.  The windows' hashes are part of
the plan as a constant set, which every task holds as a hash set; documents are scanned
where they lie, and each hit is verified on the words themselves.  Nothing is shuffled
but the few rows that name the items hit.

The set is bounded: up to ``SET_WINDOWS`` windows are inlined.  A larger
benchmark meets the documents' windows in a join on the hash (see
``_hits_by_join``), with equal results.

Null and empty texts have no words and are never contaminated.  Repeated rows
are judged one by one; null items and items without words match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeweave.session import write_table

N = 13
#: Fixed value: what separates words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows that may be inlined: 8 bytes of hash and the words of each.
SET_WINDOWS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  For text of ASCII letters alone the faster lower() does the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    split = F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN)
    return F.filter(split, lambda w: w != "")


def item_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """(item_id, size, hash, phrase): the windows of every item, each once an item."""
    spelled = benchmark.where("item_id IS NOT NULL").select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    last = F.greatest(F.size("w") - n + 1, F.lit(1))
    at = spelled.select("item_id", "w", F.explode(F.sequence(F.lit(1), last)).alias("i"))
    window = at.select("item_id", F.expr(f"slice(w, i, {n})").alias("window"))
    return window.select("item_id", F.size("window").alias("size"), F.xxhash64("window").alias("hash"), F.concat_ws(" ", "window").alias("phrase")).distinct()


def hits(benchmark: DataFrame, n: int = N, limit: int = SET_WINDOWS):
    """A function from a column of words to array<struct<at, phrase>> of verified hits, or None if the set is too large to inline."""
    found = item_windows(benchmark, n).select("size", "hash", "phrase").distinct().limit(limit + 1).collect()
    if len(found) > limit:
        return None
    by_size: dict[int, list] = {}
    for row in found:
        by_size.setdefault(row["size"], []).append(row)
    empty = F.expr("cast(array() AS array<struct<at: int, phrase: string>>)")

    def of_size(w: Column, size: int, rows: list) -> Column:
        hashes, phrases = sorted({r["hash"] for r in rows}), sorted({r["phrase"] for r in rows})
        starts = F.filter(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.xxhash64(F.slice(w, i, size)).isin(hashes))
        named = F.transform(starts, lambda i: F.struct(i.alias("at"), F.array_join(F.slice(w, i, size), " ").alias("phrase")))
        return F.when(F.size(w) >= size, F.filter(named, lambda h: h["phrase"].isin(phrases))).otherwise(empty)

    return lambda w: F.concat(empty, *[of_size(w, size, rows) for size, rows in sorted(by_size.items())])


def covered(found: Column) -> Column:
    """Number of words inside any of the hits."""
    spans = F.transform(found, lambda h: F.sequence(h["at"], h["at"] + F.size(F.split(h["phrase"], " ")) - 1))
    return F.when(F.size(found) > 0, F.size(F.array_distinct(F.flatten(spans)))).otherwise(0).cast("long")


def _hits_by_join(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """(words, hits) of each distinct word list that has a hit, for a benchmark of any size.

    Documents' windows meet the benchmark's in a join on the hash, which Spark shuffles and
    splits where a window is hot.  Hits depend on the words alone, so each distinct text
    is scanned once, under a digest of its words.
    """
    tests = item_windows(benchmark, n).select("size", "hash", "phrase").distinct()
    sizes = [r["size"] for r in tests.select("size").distinct().collect()]  # n at most
    texts = docs.select(words(F.col("text")).alias("w")).select("w", _digest("w").alias("key")).dropDuplicates(["key"])
    windows = [
        texts.where(F.size("w") >= size)
        .select("key", "w", F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("at"))
        .select("key", "at", F.array_join(F.slice("w", F.col("at"), size), " ").alias("phrase"))
        for size in sizes
    ]
    if not windows:
        return texts.select("key", F.expr("cast(array() AS array<struct<at: int, phrase: string>>)").alias("hits")).limit(0)
    scanned = windows[0]
    for more in windows[1:]:
        scanned = scanned.unionByName(more)
    return scanned.join(tests.select("phrase").distinct(), "phrase").groupBy("key").agg(F.collect_list(F.struct("at", "phrase")).alias("hits"))


def _digest(words_column: str) -> Column:
    return F.sha2(F.array_join(words_column, " "), 256)


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str | Column], n: int = N, limit: int = SET_WINDOWS) -> DataFrame:
    """``keep`` with n_words, n_hit and hits (start in words from 1, and the words hit) of each row."""
    inline = hits(benchmark, n, limit)
    spelled = docs.select(F.struct(*keep).alias("kept"), words(F.col("text")).alias("w"))
    if inline:
        # One projection for the words, one for the hits: neither is computed twice.
        found = spelled.select("kept", F.size("w").cast("long").alias("n_words"), inline(F.col("w")).alias("hits"))
    else:
        known = _hits_by_join(docs, benchmark, n)
        keyed = spelled.select("kept", F.size("w").cast("long").alias("n_words"), _digest("w").alias("key"))
        found = keyed.join(known, "key", "left").select("kept", "n_words", F.coalesce("hits", F.array()).alias("hits"))
    return found.select("kept.*", "n_words", covered(F.col("hits")).alias("n_hit"), "hits")


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """Rows of docs, unchanged, of which under a twentieth of the words stand in test windows.

    The scan is written before rows are dropped: a filter right on it would make the optimizer
    repeat the whole scan, with its set of windows, for every mention of the verdict.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    scanned = write_table(scan(docs, benchmark, [kept], n).select("row", contaminated().alias("contaminated")), "scanned")
    return scanned.where("NOT contaminated").select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """doc_id and the words of each row outside all hits, joined by spaces."""
    w = words(F.col("text")).alias("w")
    found = scan(docs, benchmark, ["doc_id", w], n)
    hit = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + F.size(F.split(h["phrase"], " ")) - 1))))
    left = F.transform(F.array_except(F.sequence(F.lit(1), F.size("w")), hit), lambda i: F.element_at("w", i))
    return found.select("doc_id", F.when(F.size("hits") == 0, F.array_join("w", " ")).otherwise(F.array_join(left, " ")).alias("text"))


def report(docs: DataFrame, benchmark: DataFrame, n: int = N, limit: int = SET_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row.

    What is scanned is written once; items are named for each distinct set of
    phrases hit, so copies of one passage are looked up together.
    """
    scanned = scan(docs, benchmark, ["doc_id"], n, limit).withColumn("phrases", F.array_sort(F.array_distinct("hits.phrase"))).drop("hits")
    scanned = write_table(scanned.withColumn("key", F.when(F.size("phrases") > 0, F.sha2(F.array_join("phrases", "\n"), 256))), "scanned")
    named = scanned.where("key IS NOT NULL").groupBy("key").agg(F.first("phrases").alias("phrases")).select("key", F.explode("phrases").alias("phrase"))
    by_phrase = item_windows(benchmark, n).select("phrase", F.col("item_id").cast("string").alias("item")).distinct()
    items = named.join(by_phrase, "phrase").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hit = scanned.where("key IS NOT NULL").join(items, "key", "left")
    clean = scanned.where("key IS NULL").withColumn("items", F.expr("cast(array() AS array<string>)"))
    return hit.unionByName(clean).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )
