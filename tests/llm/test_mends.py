"""Results that must not depend on how many spans, how long a string or how often an id there is."""

import time
from pathlib import Path
from urllib.parse import unquote, urlparse

import pytest
from corpus import BASE, BENCH, documents, edited, prose, table_rows
from pyspark.sql import functions as F

from tradeweave.llm import decontaminate, katz, licenses, near_dedup, pii, secrets, spans


def test_one_row_of_each_group_stays(spark):
    other = prose(7, 90)
    rows = [(1, BASE), (5, edited(BASE, 150)), (5, other), (6, other), (7, prose(8, 70)), (7, prose(8, 70)), (8, ""), (8, ""), (8, BASE), (None, BASE), (9, "A b c d"), (9, "a B c d"), (10, "a b c d")]
    docs = documents(spark, rows).withColumn("gone", F.lit(1)).withColumn("id", F.lit(2)).withColumn("row", F.lit("r")).withColumn("digest", F.lit("d"))
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    want = [(1, BASE), (5, other), (7, prose(8, 70)), (8, ""), (8, ""), (None, BASE), (9, "A b c d")]
    assert table_rows(kept.select("doc_id", "text")) == sorted(want, key=repr)
    assert near_dedup.keep_one(docs.limit(0)).count() == 0


def plain_overwrite(text, found):
    out, at, runs = [], 0, []
    for start, _, kind, end in sorted(found):
        if runs and start < runs[-1][1]:
            runs[-1][1] = max(end, runs[-1][1])
        else:
            runs.append([start, end, kind])
    for start, end, kind in runs:
        out.append(text[at:start] + f"[{kind.upper()}]")
        at = end
    return "".join(out) + text[at:]


@pytest.mark.parametrize("run", [spans.RUN, 2, 1])
def test_overwrite_equals_plain(spark, run, monkeypatch):
    monkeypatch.setattr(spans, "RUN", run)
    text = "﻿é😀" + "abc ﻿" * 40
    cases = [[], [(0, 0, "ip", 3)], [(0, 0, "ip", 1), (0, 1, "card", 5), (4, 0, "email", 6), (6, 0, "ip", 9), (7, 3, "phone", 8), (8, 0, "ip", 30)], [(i, i % 3, "card", i + 2 + i % 7) for i in range(0, 150, 3)], [(0, 0, "ip", 200), *((i, 1, "card", i + 1) for i in range(1, 90))], [(len(text) - 1, 0, "ip", len(text))]]
    rows = spark.createDataFrame([(k, text, sorted(c)) for k, c in enumerate(cases)], "k int, t string, s array<struct<start: int, ord: int, kind: string, end: int>>")
    found = {r.k: r.x for r in rows.select("k", spans.overwrite(F.col("t"), F.col("s")).alias("x")).collect()}
    assert found == {k: plain_overwrite(text, c) for k, c in enumerate(cases)}


def test_redaction_time_is_linear_in_spans(spark):
    text = " ".join(f"at 10.0.{i % 250}.{i % 7} x" for i in range(20_000))
    docs = documents(spark, [(1, text), (2, "1.2.3.4")])
    pii.redact(documents(spark, [(2, "1.2.3.4")])).collect()
    start = time.time()
    found = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert time.time() - start < 30
    assert found[1] == " ".join("at [IP] x" for _ in range(20_000)) and found[2] == "[IP]"


def test_context_words_of_any_length(spark):
    long = "w" * 200 + ":"
    rows = [(i, f"see   {long} +1 (555) 555-{1000 + i} now") for i in range(5)] + [(9, f"see {long} 555-1234567 now")]
    assert {r.doc_id: r.spans for r in pii.report(documents(spark, rows)).collect()}[9] == "phone:206:217"


def test_own_license_templates(spark):
    own = {"own": "every cat that sleeps on this warm mat may keep it for as long as they like it so", "short": "keep off", "none": ""}
    rows = [(1, "Foo. " + own["own"].title() + ". bar"), (2, "every cat that sleeps elsewhere"), (3, "please KEEP off!"), (4, None)]
    found = {r.doc_id: {x.license for x in r.found} for r in licenses.find(documents(spark, rows), ["doc_id"], templates=own).collect()}
    assert found == {1: {"own"}, 2: set(), 3: {"short"}, 4: set()}
    for text in licenses.TEMPLATES.values():
        words = licenses.plain_words(text)
        pieces = {tuple(words[i : i + licenses.WORDS]) for i in range(max(1, len(words) - licenses.WORDS + 1))}
        assert sum(not set(p) & set(licenses.anchors(words)) for p in pieces) < licenses.CONTAINED * len(pieces)


def test_items_without_id_match_nothing(spark):
    items = spark.createDataFrame([(None, BENCH), (4, "erin erin erin")], "item_id long, text string")
    found = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontaminate.report(documents(spark, [(1, BENCH), (2, "erin " * 4)]), items).collect()}
    assert found == {1: (0, 0, False), 2: (4, 1, True)}


def test_long_strings_are_weighed_whole(spark):
    text = "k" + "J8sD93jfLqP0zXcV7bN" * 200
    encoding = secrets._encoding(open(secrets.default_vocabulary(), "rb").read())
    assert secrets.chars_per_token(text, encoding) == len(text) / len(encoding.encode_ordinary(text))
    assert [r.spans for r in secrets.scan(documents(spark, [(1, text)])).collect()] == [f"random:0:{len(text)}"]


def test_katz_tables_have_a_file_a_task(spark):
    model = katz.score_corpus(documents(spark), F.lit(True), chunk_tokens=100)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for table, name in ((model.words, "katz-words"), (model.pairs, "katz-pairs")):
        file = table.inputFiles()[0]
        folder = Path(unquote(urlparse(file).path)).parents
        written = next(x for x in folder if x.name.startswith(name))
        assert 0 < len(list(written.rglob("part-*.parquet"))) <= tasks
        # What one kind of rows needs is null in all others, so its reader reads nothing of theirs.
        rows = spark.read.parquet(str(written))
        own = {c: rows.where(F.col(c).isNotNull()).select("kind").distinct().count() for c in rows.columns if c not in ("kind", "block", "chunk", "seen")}
        assert set(own.values()) == {1}
