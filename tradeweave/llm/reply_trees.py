"""Conversations from reply trees, formatted for training (operator 13).

1. Messages name their parent.  Self-joins double the ancestor that every message
   knows, so after log2(depth) rounds each knows its root, its depth and the
   scores summed on its path.  Only ids, counts and scores are joined.
2. Messages that nobody answered end the branches of a tree; branches are ranked by
   their score, the highest first, equal ones by the id of their last message.
3. The chosen branches' messages are listed by joining with the same jumps
   from the longest to the shortest, and get their texts.
4. Each branch becomes one conversation: every turn between control strings, with the
   places of the learned texts.  Control strings inside texts get one more
   backslash behind their first character, and lose it again when read back.

DataFrame functions only.  A message of which a third of all others are
answers is one row of the looked-up side; its answers are plain rows that adaptive execution spreads.
A tree of any size is ranked row by row, and only a chosen branch is put together in one row.

A parent that is null, absent or the message itself makes a root.  Messages that hang from a
cycle have no root and are in no conversation.  Null scores count as 0, null roles and texts as
empty.  Of rows that repeat an id one is taken: the smallest parent and score, and the smallest role and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeweave.llm.spans import code_points, let, part
from tradeweave.session import write_table

#: Control strings of public chat templates; turns are marked by the first two.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTROL = r"\|im_start\|>|\|im_end\|>|/?s>|/?INST\]"
LEARNED = ("assistant",)


def escape(text: Column) -> Column:
    """No control string stands in the result; ``unescape`` restores the text."""
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROL})", r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROL})", "$1$2$3")


def jumps(links: DataFrame) -> list[DataFrame]:
    """Tables of id, up (the ancestor 2**k above, null beyond the root), top (the last message on the way),
    steps and total (messages and scores from id to top); in the last one those with a root have no up."""
    known = links.select(F.col("id").alias("parent"))
    here = links.join(known, "parent", "left_semi").where("parent <> id")
    first = links.select("id", "score").join(here.select("id", "parent"), "id", "left")
    state = write_table(first.select("id", F.col("parent").alias("up"), F.col("id").alias("top"), F.lit(1).cast("long").alias("steps"), F.col("score").alias("total")), "reply-jumps")
    made, before = [state], -1
    while True:
        open_rows = state.where("up IS NOT NULL")
        left = open_rows.count()
        # Depths below any message's leave no gap, so a round that ends no path has only cycles left.
        if left in (0, before):
            return made
        before = left
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("top").alias("next_top"), F.col("steps").alias("more"), F.col("total").alias("extra"))
        doubled = open_rows.join(above, "up").select("id", F.col("next").alias("up"), F.col("next_top").alias("top"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("total") + F.col("extra")).alias("total"))
        state = write_table(state.where("up IS NULL").unionByName(doubled), "reply-jumps")
        made.append(state)


def branches(links: DataFrame, most: int = 1) -> DataFrame:
    """root, branch (its last message), rank, node and place (from 1) of the messages of the best ``most`` branches of each tree."""
    unique = write_table(links.groupBy("id").agg(F.min(F.struct("parent", "score")).alias("least")).select("id", "least.parent", "least.score"), "reply-links")
    ways = jumps(unique)
    ends = ways[-1].where("up IS NULL").join(ways[0].select(F.col("up").alias("id")).where("id IS NOT NULL").distinct(), "id", "left_anti")
    rank = F.row_number().over(Window.partitionBy("top").orderBy(F.desc("total"), "id"))
    chosen = ends.withColumn("rank", rank).where(F.col("rank") <= most)
    found = write_table(chosen.select(F.col("top").alias("root"), F.col("id").alias("branch"), "rank", F.col("id").alias("node"), F.col("steps").alias("place")), "reply-branches")
    for k in reversed(range(len(ways))):
        step = ways[k].where("up IS NOT NULL").select(F.col("id").alias("node"), "up")
        further = found.join(step, "node").select("root", "branch", "rank", F.col("up").alias("node"), (F.col("place") - (1 << k)).alias("place"))
        found = write_table(found.unionByName(further), "reply-branches")
    return found


def conversations(messages: DataFrame, most: int = 1, keep: list[str] | None = None, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """root, branch, rank, ``keep`` columns of the branch's last message, n_turns, formatted and loss (array of start and end
    of the learned texts in ``formatted``, in code points) of the best ``most`` branches of each tree.

    messages has id, parent, role, text and, if branches are to be ranked, score; other columns may follow.
    """
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0)) if "score" in messages.columns else F.lit(0.0)
    path = branches(messages.where("id IS NOT NULL").select("id", "parent", score.alias("score")), most)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    kept = F.struct(*keep) if keep else F.struct(F.lit(None).alias("nothing"))
    said = messages.select(F.col("id").alias("node"), role.alias("role"), text.alias("text"), kept.alias("kept"))
    turns = path.join(said, "node")
    of_branch = Window.partitionBy("branch").orderBy("place", "role", "text")
    turns = turns.withColumn("again", F.lag("place").over(of_branch).eqNullSafe(F.col("place"))).where("NOT again")
    turns = turns.withColumn("head", F.concat(F.lit(OPEN), F.url_encode("role"), F.lit("\n"))).withColumn("body", escape(F.col("text")))
    turns = turns.withColumn("size", F.char_length("body").cast("long"))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(CLOSE + "\n")))
    before = F.sum(F.char_length("piece").cast("long")).over(Window.partitionBy("branch").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    turns = turns.withColumn("start", F.coalesce(before, F.lit(0)) + F.char_length("head"))
    span = F.when(F.col("role").isin(*learned), F.struct("start", (F.col("start") + F.col("size")).alias("end")))
    last = F.when(F.col("node") == F.col("branch"), F.col("kept"))
    rows = turns.select("root", "branch", "rank", last.alias("kept"), F.struct("place", "piece", span.alias("span")).alias("turn"))
    whole = rows.groupBy("branch").agg(F.first("root").alias("root"), F.first("rank").alias("rank"), F.first("kept", True).alias("kept"), F.array_sort(F.collect_list("turn")).alias("turns"))
    return whole.select(
        "root", "branch", "rank", *([f"kept.{c}" for c in keep] if keep else []), F.size("turns").cast("long").alias("n_turns"),
        F.array_join("turns.piece", "").alias("formatted"), F.filter("turns.span", lambda s: s.isNotNull()).alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    closed = F.split(formatted, r"<\|im_end\|>\n", -1)
    pieces = let(closed, lambda p: F.slice(p, 1, F.size(p) - 1))

    def turn(piece: Column) -> Column:
        halves = F.split(piece, "\n", 2)
        return F.struct(F.url_decode(F.substring(halves[0], len(OPEN) + 1, 1 << 30)).alias("role"), unescape(halves[1]).alias("text"))

    return F.transform(pieces, turn)


def under_mask(formatted: Column, loss: Column) -> Column:
    """All learned text, unescaped, in order."""
    return let(code_points(formatted), lambda f: F.array_join(F.transform(loss, lambda s: unescape(part(f, s["start"], s["end"]))), ""))


def chains(table: DataFrame) -> DataFrame:
    """Messages of plain conversations (conv_id, turn, role, text): each turn answers the one before, so a tree is one branch.

    Turns are taken by turn, null first, equal turns by the digest of role and text.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest"))
    placed = table.select("conv_id", "turn", "role", "text", digest.alias("digest")).withColumn("place", place)
    above = F.when(F.col("place") > 1, F.struct("conv_id", (F.col("place") - 1).alias("place")))
    return placed.select(F.struct("conv_id", "place").alias("id"), above.alias("parent"), "conv_id", "role", "text")


def report(table: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read back from the formatted conversations."""
    made = conversations(chains(table), keep=["conv_id"])
    read = made.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), under_mask(F.col("formatted"), F.col("loss")).alias("learned"))
    spelled = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spelled.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
