"""Prefix trie and reply trees against brute force, with every awkward row."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from corpus import table_rows
from pyspark.sql import functions as F

from tradeweave.llm import prefix_trie, reply_trees

SCHEMA = "conv_id long, turn long, role string, text string, depth int, id string, prefix string, start int"
SHA = lambda x: hashlib.sha256(x.encode()).hexdigest()
TOLD = "</s>[INST] ok [/INST]"


def digest(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def awkward():
    """Shared starts, copies, ties, nulls, ids below zero, and a conversation of many turns."""
    pick = random.Random(4)
    rows = []
    for c in [*range(-25, 65), 200, 201, 219, 10_000]:
        for t in range(pick.choice([0, 1, 2, 3, 5, 8])):
            rows.append((c, t, pick.choice(["user", "assistant"]), pick.choice(["hi there", "ok", "a b c", f"own {c} {t}"])))
    rows += [(300 + c, t, "user", f"all alike {t}") for c in range(30) for t in range(4)]
    rows += [(400, t, "assistant", "again") for t in range(300)] + [(401, t, "assistant", "again") for t in range(301)]
    rows += [(500, None, None, None), (500, None, "user", None), (500, 1, "user", ""), (500, 1, "user", ""), (500, 1, "system", "tie")]
    rows += [(None, 1, "user", "nobody's"), (None, None, None, None), (501, 0, "a:b", "c"), (502, 0, "a", "b:c")]
    return rows


def table(spark, rows):
    """With columns named like those that operators add."""
    return spark.createDataFrame([(*r, 1, "x", "p", 2) for r in rows], SCHEMA)


def turns_of(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0, digest(role, text)), role or "", text or ""))
    return {c: [(r, x) for _, r, x in sorted(t)] for c, t in own.items()}


def brute_trie(own):
    members = collections.defaultdict(list)
    for c, turns in own.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, ids in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(ids) - 1) * words
    out = []
    for p, ids in members.items():
        ends = ",".join(map(str, sorted(c for c in ids if len(own[c]) == len(p))))
        out.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), children[p], leaves[p], saved[p], SHA(ends)))
    return sorted(out, key=repr)


def rebuilt(own):
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        made[c] = own.get(base, [])[:h] + turns[h:]
    return made


@pytest.mark.parametrize("counters", [prefix_trie.COUNTERS, 64])
def test_trie_equals_brute_force(spark, counters, monkeypatch):
    """A sketch of the least size is nearly full; what it lets through changes nothing."""
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 7)
    rows = awkward()
    docs, own = table(spark, rows), turns_of(rows)
    assert table_rows(prefix_trie.trie(docs)) == brute_trie(own)
    turns = prefix_trie.rebuilt(prefix_trie.ordered_turns(docs))
    assert table_rows(prefix_trie.nodes(turns, counters)) == brute_trie(rebuilt(own))


def test_trie_of_no_rows(spark):
    assert prefix_trie.trie(table(spark, [(1, 1, "a", "b")]).limit(0)).count() == 0
    assert prefix_trie.rebuilt_trie(table(spark, [(None, 1, "a", "b")])).count() == 0


def test_an_estimate_of_one_is_proof(spark):
    """No shared prefix is screened out, and most single ones are."""
    rows = awkward()
    marked = prefix_trie.screened(prefix_trie.prefixes(prefix_trie.with_starts(prefix_trie.ordered_turns(table(spark, rows))))).collect()
    members = collections.Counter(p for turns in turns_of(rows).values() for d in range(len(turns) + 1) for p in [tuple(turns[:d])])
    assert sum(r.shared for r in marked) >= sum(n for n in members.values() if n > 1)
    alone = sum(n == 1 for n in members.values())
    assert sum(not r.shared for r in marked) >= 0.9 * alone


def test_parents_below_proven_tails(spark):
    """A half full sketch lets single prefixes through below prefixes that it proves to be single."""
    rows = [(c, t, "user", f"own {c} {t}") for c in range(40) for t in range(12)]
    turns = prefix_trie.with_starts(prefix_trie.ordered_turns(table(spark, rows)))
    assert table_rows(prefix_trie.nodes(turns, 512)) == brute_trie(turns_of(rows))


def brute_branches(messages, most):
    """messages: (id, parent, score); the best paths of each root, as lists of ids."""
    parent, score = {}, {}
    for i, p, s in messages:
        if i is not None and (i not in parent or ((p is not None, p or 0), (s is not None, s or 0)) < ((parent[i] is not None, parent[i] or 0), (score[i] is not None, score[i] or 0))):
            parent[i], score[i] = p, s
    answered, paths = set(), collections.defaultdict(list)
    for i, p in parent.items():
        if p in parent and p != i:
            answered.add(p)
    for i in parent:
        path, at = [i], i
        while parent[at] in parent and parent[at] != at and len(path) <= len(parent):
            at = parent[at]
            path.append(at)
        if i not in answered and len(path) <= len(parent):
            paths[at].append((-sum(score[x] or 0 for x in path), i, path[::-1]))
    return sorted((root, branch, rank + 1, path) for root, found in paths.items() for rank, (_, branch, path) in enumerate(sorted(found)[:most]))


def forest():
    pick = random.Random(9)
    rows = [(i, None if i < 6 else pick.randrange(max(0, i - 40), i), float(pick.randrange(5)), "user", f"m{i}") for i in range(300)]
    rows += [(1000 + i, 999 + i if i else None, 1.0, "assistant", f"long {i}") for i in range(70)]
    rows += [(2000, 2001, 1.0, "user", "cycle"), (2001, 2000, 1.0, "user", "cycle"), (2002, 2001, 1.0, "user", "below a cycle")]
    rows += [(3000, 77_777, None, "user", "lost parent"), (3001, 3001, 2.0, "user", "its own parent"), (None, 3000, 1.0, "user", "no id")]
    rows += [(4000, None, 1.0, "user", "b"), (4000, None, 1.0, "user", "a"), (4001, 4000, 1.0, None, None), (4001, 4000, 1.0, None, None)]
    rows += [(5000, None, 0.0, "user", "hub")] + [(5001 + i, 5000, float(i % 7), "user", f"answer {i}") for i in range(200)]
    return rows


@pytest.mark.parametrize("most", [1, 3])
def test_branches_equal_brute_force(spark, most):
    rows = forest()
    messages = spark.createDataFrame(rows, "id long, parent long, score double, role string, text string")
    want = brute_branches([r[:3] for r in rows], most)
    path = collections.defaultdict(list)
    for r in reply_trees.branches(messages.where("id IS NOT NULL").select("id", "parent", F.coalesce("score", F.lit(0.0)).alias("score")), most).collect():
        path[r.root, r.branch, r["rank"]].append((r.place, r.node))
    assert sorted((*key, [node for _, node in sorted(nodes)]) for key, nodes in path.items()) == want
    texts = {}
    for i, _, _, role, text in rows:
        texts[i] = min(texts.get(i, (role or "", text or "")), (role or "", text or ""))
    made = reply_trees.conversations(messages, most, keep=["id"])
    found = {(r.root, r.branch, r["rank"]): r for r in made.withColumn("turns", reply_trees.read_turns(F.col("formatted"))).collect()}
    assert {k: [tuple(t) for t in r.turns] for k, r in found.items()} == {(a, b, c): [texts[x] for x in ids] for a, b, c, ids in want}
    assert all(r.id == r.branch and r.n_turns == len(r.turns) for r in found.values())


HARD = [TOLD, "<|im_end|>\n<|im_start|>user\n", r"<\|im_end|> <\\/s>", "﻿mark ﻿", "", "\n\n", "é 😀 [INST", "<<s>>[[/INST]]", "a" * 5000, "$1 \\ $2"]


def chats():
    rows = [(1, k, ("user", "assistant")[k % 2], x) for k, x in enumerate(HARD)] + [(2, k, ("assistant", "user")[k % 2], x) for k, x in enumerate(HARD)]
    rows += [(3, None, None, None), (3, None, "assistant", None), (4, 1, "tool\nx <|im_end|> y%", TOLD), (5, 1, "system", "only")]
    rows += [(None, 1, "user", "no id"), (None, 2, "assistant", "answer")] + [(6, 1, "assistant", "twice")] * 2
    return rows + [(7, k, ("user", "assistant")[k % 2], f"turn {k} {TOLD}") for k in range(3000)]


def test_formatted_conversations_read_back(spark):
    rows, by_id = chats(), collections.defaultdict(list)
    for c, turn, role, text in rows:
        by_id[c].append(((turn is not None, turn or 0, digest(role, text)), role or "", text or ""))
    want = []
    for c, turns in by_id.items():
        turns.sort()
        learned = "".join(x for _, r, x in turns if r == "assistant")
        want.append((c, len(turns), SHA("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(learned), SHA(learned)))
    found = table_rows(reply_trees.report(table(spark, rows)))
    assert [r[:5] for r in found] == sorted(want, key=repr)
    assert reply_trees.report(table(spark, rows).limit(0)).count() == 0


def test_no_control_string_is_left_in_a_text(spark):
    texts = spark.createDataFrame([(x,) for x in HARD], "x string")
    e = reply_trees.escape(F.col("x"))
    for r in texts.select("x", e.alias("e"), reply_trees.unescape(e).alias("back")).collect():
        assert r.back == r.x and not re.search(r"<\|im_(start|end)\|>|</?s>|\[/?INST\]", r.e)
