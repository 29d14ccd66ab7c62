"""License notices by MinHash bands and exact containment (operator 4).

Templates and texts are compared in shingles of five words.  A text is cut into
windows that start every half template (in shingles) and are long enough that any passage of
the template's length lies wholly in one.  A window that holds CONTAINED of a template
has a similarity of at least 0.45 to it; BANDS bands of one minimum
each miss it with probability 0.55 ** BANDS, under 1e-8.
Windows that meet a template in a band are verified: ``CONTAINED`` of the template's
shingles, counted exactly, must stand in the window.

Expressions on the row only; templates are a constant of fixed size.
Texts and windows without an anchor word are skipped.  Anchors are words of the templates, chosen so
that fewer shingles than are needed for a match hold none of them; no passage that could be verified is lost.

Null and empty texts match nothing; repeated rows are judged alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, CONTAINED, BANDS = 5, 0.8, 32
#: Public license notices by identifier; {..} parts of names and years are left out.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation"
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
}
#: Words of at least so many letters are anchors first; shorter ones stand in most texts.
LONG = 6
#: What separates words once lower-cased.
BETWEEN = r"[^\p{L}\p{N}]+"
EMPTY = "cast(array() AS array<bigint>)"


def plain_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def stride(n: int) -> int:
    """Words between the starts of windows for templates of n words: half of their shingles."""
    return max(1, (n - WORDS + 2) // 2)


def anchors(spelled: list[str]) -> list[str]:
    """Words so that CONTAINED of the template's shingles cannot be had without one of them."""
    distinct = {tuple(spelled[i : i + WORDS]) for i in range(max(1, len(spelled) - WORDS + 1))}
    left, spare, chosen = [set(x) for x in distinct], math.ceil(CONTAINED * len(distinct)) - 1, []
    while len(left) > spare:
        counts = Counter(w for x in left for w in x)
        chosen.append(max(counts, key=lambda w: (len(w) >= LONG, counts[w], len(w), w)))
        left = [x for x in left if chosen[-1] not in x]
    return chosen


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN), lambda w: w != "")


def shingles(w: Column) -> Column:
    """Distinct hashes of five consecutive words; a shorter list is one shingle."""
    last = F.greatest(F.size(w) - WORDS + 1, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(w, i, WORDS))))


def bands(found: Column) -> Column:
    """One key for each band: the smallest shingle under the band's hash, tied to the band."""
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda b: F.xxhash64(b, F.array_min(F.transform(found, lambda x: F.xxhash64(x, b)))))


def _template_table(templates: dict[str, str]) -> Column:
    """Constant array of the templates of one length with their shingles and bands."""
    rows = []
    for name, text in sorted(templates.items()):
        w = F.array(*[F.lit(x) for x in plain_words(text)])
        rows.append(F.transform(F.array(shingles(w)), _as_template(name))[0])
    return F.array(*rows)


def _as_template(name: str):
    return lambda s: F.struct(F.lit(name).alias("license"), s.alias("shingles"), bands(s).alias("bands"))


def find(docs: DataFrame, keep: list[str | Column], text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """``keep`` with found: array<struct<license, at, share>>, at the first word of the window, from 1."""
    templates = TEMPLATES if templates is None else templates
    by_size: dict[int, dict[str, str]] = {}
    for name, spelled in templates.items():
        by_size.setdefault(len(plain_words(spelled)), {})[name] = spelled
    by_size.pop(0, None)
    needed = {size: sorted({a for spelled in group.values() for a in anchors(plain_words(spelled))}) for size, group in by_size.items()}
    some = "|".join(sorted({re.escape(a) for group in needed.values() for a in group})) or "(?!)"
    source = docs.select(F.struct(*keep).alias("kept"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    # Most texts hold no anchor and are not split.
    split = source.select("kept", F.when(F.lower("t").rlike(some), words(F.col("t"))).otherwise(F.expr("cast(array() AS array<string>)")).alias("w"))
    columns = [F.lit(None).cast("array<struct<license: string, at: int, share: double>>").alias("none")]
    for size, group in sorted(by_size.items()):
        columns.append(_matches(size, group, needed[size]).alias(f"found_{size}"))
    found = split.select("kept", *columns)
    every = F.concat(*[F.coalesce(c, F.expr("cast(array() AS array<struct<license: string, at: int, share: double>>)")) for c in found.columns[1:]])
    return found.select("kept", every.alias("found")).select("kept.*", "found")


def _matches(size: int, group: dict[str, str], needed: list[str]) -> Column:
    table, step = _template_table(group), stride(size)
    length = size + step - 1
    starts = F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1)), F.lit(step))
    anchored = F.filter(starts, lambda i: F.arrays_overlap(F.slice("w", i, length), F.array(*map(F.lit, needed))))
    windows = F.transform(anchored, lambda i: F.struct(i.alias("at"), shingles(F.slice("w", i, length)).alias("shingles")))
    keyed = F.transform(windows, lambda x: F.struct(x["at"].alias("at"), x["shingles"].alias("shingles"), bands(x["shingles"]).alias("bands")))

    def of_window(x: Column) -> Column:
        met = F.filter(table, lambda t: F.arrays_overlap(t["bands"], x["bands"]))
        shared = F.transform(met, lambda t: F.struct(t["license"].alias("license"), x["at"].alias("at"), (F.size(F.array_intersect(t["shingles"], x["shingles"])) / F.size(t["shingles"])).alias("share")))
        return F.filter(shared, lambda s: s["share"] >= CONTAINED)

    return F.when(F.size("w") > 0, F.flatten(F.transform(keyed, of_window)))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_licenses and licenses: the identifiers found, sorted and comma-joined."""
    names = F.array_sort(F.array_distinct("found.license"))
    return find(docs, ["doc_id"]).select("doc_id", F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"))


def remove_licensed(docs: DataFrame, refused: list[str]) -> DataFrame:
    """Rows of docs, unchanged, that carry none of the refused licenses."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return find(docs, [row]).where(~F.arrays_overlap("found.license", F.array(*map(F.lit, refused)))).select("row.*")
