"""Operators that compare rows or learn from all of them, and the pipeline, against brute force."""

import collections
import math
import re

import corpus_pipeline
import numpy as np
import pytest
from corpus import BASE, ITEMS, LABELS, ROWS, documents, edited, empty, prose, table_rows

from tradeweave.llm import bpe, components, decontaminate, katz, near_dedup, pii, quality_conv, quality_rules, secrets, token_counts
from tradeweave.llm.queries import QUERIES


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def shingle_set(text):
    w = split(text)
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute_groups(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            if a is None or rows[j][0] is None:
                continue
            same = a == rows[j][0]
            both = len(sets[i] & sets[j])
            if same or (sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both)):
                root[top(i)] = top(j)
    least = {}
    for i, (a, _) in enumerate(rows):
        if a is not None:
            least[top(i)] = min(least.get(top(i), a), a)
    return sorted(((a, len(sets[i]), None if a is None else least[top(i)], a is None or a == least[top(i)]) for i, (a, _) in enumerate(rows)), key=repr)


def brute_kept(rows):
    """Rows of ids that stand for their group; of rows that repeat an id and its text one, unless they have no id or no words."""
    kept = {r[0] for r in brute_groups(rows) if r[3]}
    once = {(i, t): (i, t) for i, t in rows if i in kept and i is not None and split(t)}
    return [*once.values(), *((i, t) for i, t in rows if i in kept and (i is None or not split(t)))]


def copies():
    """Chains of edits, exact copies, and pairs around the threshold."""
    rows, text = list(ROWS), prose(20, 150)
    for step in range(8):
        rows.append((100 + step, text))
        w = text.split(" ")
        w[(step * 19) % len(w)] = f"step{step}"
        text = " ".join(w)
    rows += [(200 + i, BASE) for i in range(30)]
    for i, every in enumerate((12, 20, 30, 36, 40, 44, 60, 90)):
        other = prose(40 + i, 120)
        rows += [(300 + 2 * i, other), (301 + 2 * i, edited(other, every))]
    return rows


def test_near_copies_equal_brute_force(spark):
    rows = copies()
    assert table_rows(near_dedup.groups(documents(spark, rows))) == brute_groups(rows)
    assert near_dedup.groups(empty(spark)).count() == 0
    docs = documents(spark, rows)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    want = [i for i, _ in brute_kept(rows)]
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, want))


def test_near_copies_in_blocks(spark, monkeypatch):
    """With blocks of a few rows every bucket and family is split, and the groups stay."""
    for name, size in (("BUCKET_BLOCK", 2), ("FAMILY_BLOCK", 2), ("SHINGLE_BLOCK", 400)):
        monkeypatch.setattr(near_dedup, name, size)
    rows = copies()
    assert table_rows(near_dedup.groups(documents(spark, rows))) == brute_groups(rows)


def test_similarity_estimate():
    """Corrected for fields that agree by chance, the estimate is right on average."""
    rng = np.random.default_rng(5)
    for share in (0.0, 0.5, 0.9):
        found = []
        for _ in range(60):
            common = rng.integers(0, 1 << 63, int(300 * share), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 300 - len(common), dtype=np.uint64)])) for _ in range(2))
            true = len(common) / (600 - len(common))
            low = [near_dedup.minima(x) & np.uint32(3) for x in (a, b)]
            found.append(((low[0] == low[1]).mean() - 0.25) / 0.75 - true)
        assert abs(np.mean(found)) < 0.03


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (95, 100), (7, 7)] + [(500, 500 + i) for i in range(1, 30)]
    found = dict(table_rows(components.components(spark.createDataFrame(edges, "a long, b long"))))
    assert found == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90, **{500 + i: 500 for i in range(30)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_katz(rows, train):
    texts = [split(t) + [None] for (_, t), use in zip(rows, train) if use]
    words = collections.Counter(w for t in texts for w in t)
    pairs = collections.Counter((h, w) for t in texts for h, w in zip([None, *t[:-1]], t))
    n = sum(words.values())

    def factors(counts):
        seen = collections.Counter(counts.values())
        return [0.0, *katz.discounts([seen[r] for r in range(1, katz.DISCOUNTED + 2)])]

    take = lambda c, d: c * (d[c] if c <= katz.DISCOUNTED else 1.0)
    of_words, of_pairs = factors(words), factors(pairs)
    kept = sum(take(c, of_words) for c in words.values()) / n if n else 0
    unknown = max(1 - kept, 1 / (n + 1))
    single = lambda w: 1.0 if not n else take(words[w], of_words) / n / kept * (1 - unknown) if w in words else unknown
    after = collections.defaultdict(dict)
    for (h, w), c in pairs.items():
        after[h][w] = c

    def probability(h, w):
        if h not in after:
            return single(w)
        held = sum(take(c, of_pairs) for c in after[h].values())
        left = max(1 - held / words[h], 1 / (words[h] + 1))
        if w in after[h]:
            return (1 - left) * take(after[h][w], of_pairs) / held
        return left / (1 - sum(map(single, after[h]))) * single(w)

    out = []
    for i, t in rows:
        w = split(t) + [None]
        base = sum(math.log10((words[x] + 1) / (n + len(words) + 1)) for x in w)
        score = sum(math.log10(probability(h, x)) for h, x in zip([None, *w[:-1]], w))
        out.append((i, len(w), sum(x in words for x in w), n, base, score))
    return out, probability, words, after


@pytest.mark.parametrize("chunk", [katz.CHUNK_TOKENS, 100])
def test_language_model_equals_brute_force(spark, chunk):
    from pyspark.sql import functions as F

    rows = [*ROWS, *((400 + i, prose(60 + i, 90)) for i in range(6))]
    train = [i is None or i % 3 != 1 for i, _ in rows]
    use = F.coalesce(F.col("doc_id") % 3 != 1, F.lit(True))
    found = table_rows(katz.score_corpus(documents(spark, rows), use, chunk_tokens=chunk).scores)
    want, probability, words, after = brute_katz(rows, train)
    for a, b in zip(found, sorted(want, key=repr)):
        assert a[:4] == b[:4]
    key = lambda r: (repr(r[0]), r[1], round(r[4], 4))
    for a, b in zip(sorted(found, key=key), sorted(want, key=key)):
        assert a == pytest.approx(b, rel=1e-9) if a[0] is not None else a[4:] == pytest.approx(b[4:], rel=1e-9)
    # Each history's shares sum to one, the unknown word included.
    for h in list(after)[:20]:
        assert sum(probability(h, w) for w in [*words, "never seen"]) == pytest.approx(1, abs=1e-9)


def test_language_model_without_training_texts(spark):
    from pyspark.sql import functions as F

    assert katz.score_corpus(empty(spark), F.lit(True)).scores.count() == 0
    found = katz.score_corpus(documents(spark), F.lit(False)).scores.collect()
    assert len(found) == len(ROWS) and all(r.score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in found)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The small corpus with good prose, copies, contaminated and poor documents as a folder of tables."""
    path = str(tmp_path_factory.mktemp("corpus"))
    good = [(1000 + i, prose(100 + i, 120) + f" mail user{i}@mail.example.com") for i in range(40)]
    poor = [(2000 + i, f"# | $ {i} > < " * 40) for i in range(40)]
    rows = [*copies(), *good, *poor]
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    labels = LABELS + [(i, 1, 0) for i, _ in good[:30]] + [(i, 0, 0) for i, _ in poor[:30]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline_is_its_stages(spark, folder):
    """The pipeline's rows are what the operators, each held against brute force, decide one after the other on plain lists."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("labels", "benchmark"))
    net = quality_conv.train(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    scores = net.score([(t or "").encode() for _, t in rows])
    rows = [r for r, s in zip(rows, scores) if s >= quality_conv.THRESHOLD]
    assert not {i for i, _ in rows} & set(range(2000, 2040)) and {i for i, _ in rows} >= set(range(1000, 1040))
    rows = brute_kept(rows)
    test_words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) for _, t in ITEMS]
    windows = {tuple(w[k : k + 13]) for w in test_words if w for k in range(max(1, len(w) - 12))}

    def clean(text):
        w, hit = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text)), set()
        for size in {len(x) for x in windows}:
            hit |= {j for k in range(len(w)) if tuple(w[k : k + size]) in windows for j in range(k, k + size)}
        return not hit or 20 * len(hit) < len(w)

    rows = [r for r in rows if clean(r[1])]
    redacted = pii.redact(documents(spark, rows)).select("doc_id", "text").collect()
    assert all("@mail.example.com" not in (t or "") for _, t in redacted)
    want = table_rows(bpe.round_trip(documents(spark, [tuple(r) for r in redacted])))
    assert table_rows(corpus_pipeline.run(spark, folder)) == want
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and len(want) > 40


def test_stages_keep_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for source in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, source, folder).columns == docs.columns


def test_conversation_queries(spark, tmp_path):
    turns = [(c, t, ("user", "assistant")[t % 2], f"hello {t} {c % 3}") for c in range(45) for t in range(c % 5)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    trie, chats = (QUERIES[name](spark, str(tmp_path)) for name in ("op12_prefix_trie", "op13_reply_trees"))
    assert trie.columns == "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    assert chats.columns == "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars".split()
    ids = {c for c, *_ in turns}
    root = trie.where("depth = 0").collect()
    assert len(root) == 1 and root[0].n_convs == len(ids) and root[0].conv_id == min(ids)
    assert {r.conv_id for r in chats.collect()} == ids | {-7}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op12_prefix_trie", "op13_reply_trees"}))
def test_every_query_answers_each_row(spark, folder, name):
    found = QUERIES[name](spark, folder)
    assert found.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    wanted = {
        "op1": "doc_id held_out score predicted", "op2": "doc_id n_shingles component_id kept",
        "op3": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op6": "doc_id held_out n_tokens n_known train_tokens base_score score",
        "op7": "doc_id n_words n_hit n_items items_sha256 contaminated", "op8": "doc_id n_assign n_access n_hex base_sha256 spans",
        "op9": "doc_id n_tokens ids_sha256 decoded_sha256", "op10": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op11": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    }
    assert set(wanted.get(name.split("_")[0], "doc_id").split()) <= set(found.columns)
