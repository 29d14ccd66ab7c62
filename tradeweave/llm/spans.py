"""Spans of regular expressions as columns: where each match starts and ends, in code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches whose starts are summed up in one go; keeps the work per row linear in practice.
RUN = 200
#: Words kept of what stands before a match on its line.
BEFORE = 2


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value, before>> of the leftmost non-overlapping matches.

    Splitting by a pattern gives what lies between its matches, so a start is
    the sum of the lengths so far.  Sums run over blocks of RUN matches and
    then over blocks, because appending to an array copies it.
    """
    pair = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    # The last gap has no match behind it.
    return let(F.filter(pair, lambda x: x["value"].isNotNull()), _placed)


def _placed(known: Column) -> Column:
    """Matches with their places from (gap, value) pairs."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(known) - 1) / RUN).cast("int")),
        lambda b: _summed(F.slice(known, b * RUN + 1, RUN)),
    )
    start = F.aggregate(
        blocks,
        F.expr("named_struct('at', 0, 'done', cast(array() AS array<array<struct<start: int, end: int, value: string, before: string>>>))"),
        lambda acc, b: F.struct(
            (acc["at"] + b["at"]).alias("at"),
            F.concat(acc["done"], F.array(F.transform(b["done"], lambda m: F.struct((m["start"] + acc["at"]).alias("start"), (m["end"] + acc["at"]).alias("end"), m["value"].alias("value"), m["before"].alias("before"))))).alias("done"),
        ),
        lambda acc: F.flatten(acc["done"]),
    )
    return F.when(F.size(known) > 0, start).otherwise(F.expr("cast(array() AS array<struct<start: int, end: int, value: string, before: string>>)"))


def _summed(block: Column) -> Column:
    """Length of a block of (gap, value) and its matches with starts relative to the block."""

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["value"])
        match = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), _last_words(x["gap"]).alias("before"))
        return F.struct(end.alias("at"), F.concat(acc["done"], F.array(match)).alias("done"))

    return F.aggregate(block, F.expr("named_struct('at', 0, 'done', cast(array() AS array<struct<start: int, end: int, value: string, before: string>>))"), add)


def _last_words(gap: Column) -> Column:
    """The last BEFORE words on the last line of a gap, each with one blank in front of the next."""
    line = F.regexp_replace(F.rtrim(F.substring_index(gap, "\n", -1)), r"\s+", " ")
    return F.substring_index(F.rtrim(line), " ", -BEFORE)


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often the body uses it, inside lambdas too."""
    return F.transform(F.array(value), body)[0]


def code_points(text: Column) -> Column:
    """The text in four bytes a code point, so that ``part`` need not count from the start."""
    return F.encode(text, "UTF-32")


def part(points: Column, start: Column, end: Column) -> Column:
    """Code points start to end (exclusive) of what ``code_points`` gave.

    A blank goes in front while decoding: a leading U+FEFF would be taken for a byte order mark.
    """
    cut = F.substring(points, (start * 4 + 1).cast("int"), ((end - start) * 4).cast("int"))
    return F.substring(F.decode(F.concat(F.unhex(F.lit("00000020")), cut), "UTF-32"), 2, 1 << 30)


def merged(spans: Column) -> Column:
    """array<struct<start, end, kind>>: runs of overlapping spans, each under the kind of its first.

    Spans are structs with start, end and kind in ascending order.  They are merged inside blocks
    of RUN and the blocks are tied one after the other, because appending to an array copies it.
    """
    run = "struct<start: int, end: int, kind: string>"
    as_run = lambda start, end, kind: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), kind.alias("kind"))

    def add(acc: Column, s: Column) -> Column:
        """acc: the runs that are complete, and the open one."""
        last = acc["last"]
        return F.when(s["start"] < last["end"], F.struct(acc["done"].alias("done"), as_run(last["start"], F.greatest(last["end"], s["end"]), last["kind"]).alias("last"))).otherwise(
            F.struct(F.when(last.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(last))).alias("done"), as_run(s["start"], s["end"], s["kind"]).alias("last"))
        )

    start = F.expr(f"named_struct('done', cast(array() AS array<{run}>), 'last', cast(null AS {run}))")
    whole = lambda block: F.aggregate(block, start, add, lambda acc: F.concat(acc["done"], F.array(acc["last"])))

    def tie(acc: Column, runs: Column) -> Column:
        """acc: arrays of complete runs, and the open one, which may swallow the first runs of the block."""
        last = acc["last"]
        hit = F.filter(runs, lambda r: r["start"] < last["end"])
        rest = F.filter(runs, lambda r: last.isNull() | (r["start"] >= last["end"]))
        longer = as_run(last["start"], F.greatest(last["end"], F.coalesce(F.array_max(F.transform(hit, lambda r: r["end"])), F.lit(0))), last["kind"])
        open_run = F.when(last.isNull(), F.lit(None).cast(run)).otherwise(longer)
        complete = F.concat(F.when(last.isNull(), F.expr(f"cast(array() AS array<{run}>)")).otherwise(F.array(open_run)), F.slice(rest, 1, F.greatest(F.size(rest) - 1, F.lit(0))))
        return F.when(F.size(rest) == 0, F.struct(acc["done"].alias("done"), open_run.alias("last"))).otherwise(
            F.struct(F.concat(acc["done"], F.array(complete)).alias("done"), F.element_at(rest, -1).alias("last"))
        )

    begin = F.expr(f"named_struct('done', cast(array() AS array<array<{run}>>), 'last', cast(null AS {run}))")
    in_blocks = lambda all_spans: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_spans) - 1) / RUN).cast("int")), lambda b: whole(F.slice(all_spans, b * RUN + 1, RUN)))
    tied = lambda all_spans: F.aggregate(in_blocks(all_spans), begin, tie, lambda acc: F.concat(F.flatten(acc["done"]), F.array(acc["last"])))
    return let(spans, lambda x: F.when(F.size(x) > 0, tied(x)).otherwise(F.expr(f"cast(array() AS array<{run}>)")))


def in_blocks(runs: Column) -> Column:
    """array<struct<start, end, runs>>: merged runs by RUN, so that ``touches`` looks into few of them."""

    def block(b: Column) -> Column:
        some = F.slice(runs, b * RUN + 1, RUN)
        return F.struct(some[0]["start"].alias("start"), F.element_at(some, -1)["end"].alias("end"), some.alias("runs"))

    none = F.expr("cast(array() AS array<struct<start: int, end: int, runs: array<struct<start: int, end: int, kind: string>>>>)")
    return F.when(F.size(runs) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(runs) - 1) / RUN).cast("int")), block)).otherwise(none)


def touches(blocks: Column, start: Column, end: Column) -> Column:
    """Whether start to end overlaps a run of the blocks."""
    meets = lambda x: (x["start"] < end) & (start < x["end"])
    return F.exists(blocks, lambda b: meets(b) & F.exists(b["runs"], meets))


def overwrite(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by the name of its first kind in brackets.

    Spans are structs of start, order, kind and end in ascending order.  Runs, and the text as code
    points, are computed once; then each gap is cut out by its place, so time grows with the text and its spans.
    """

    def put(runs: Column, points: Column) -> Column:
        before = F.transform(runs, lambda s, i: F.concat(part(points, F.when(i == 0, F.lit(0)).otherwise(F.get(runs, i - 1)["end"]), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.concat(F.array_join(before, ""), part(points, F.element_at(runs, -1)["end"], F.length(points) / 4))

    return F.when(F.size(spans) > 0, let(merged(spans), lambda runs: let(code_points(text), lambda points: put(runs, points)))).otherwise(text)
