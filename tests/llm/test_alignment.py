"""Token alignment against a plain version that compares byte ranges pair by pair."""

import collections
import hashlib

import public_tokenizers
import pytest
import sentencepiece
from corpus import ROWS, documents, empty, prose, table_rows
from tokenizers import Tokenizer

from tradeweave.llm import alignment
from tradeweave.llm.bpe import byte_letters


def tokens(text, a, b):
    letters = byte_letters()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
    want = (" " + text).encode()
    return (ids_a, bytes_a, ids_b, bytes_b) if text and b"".join(bytes_a) == want == b"".join(bytes_b) else None


def ranges(pieces):
    out, at = [], 0
    for p in pieces:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def brute(rows):
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    held, counts = [], collections.Counter()
    for i, text in rows:
        got = tokens(text or "", a, b)
        if got is None:
            held.append((i, None))
            continue
        ids_a, bytes_a, ids_b, bytes_b = got
        ra, rb = ranges(bytes_a), ranges(bytes_b)
        near = collections.defaultdict(list)
        for j, (s, e) in enumerate(rb):
            for k in range(s, e):
                near[k].append(j)
        links = [(ids_a[x], ids_b[y]) for x, (s, e) in enumerate(ra) for y in sorted({j for k in range(s, e) for j in near[k]})]
        groups, x, y = [], 0, 0
        for cut in sorted({e for _, e in ra} & {e for _, e in rb}):
            left, right = [], []
            while x < len(ra) and ra[x][1] <= cut:
                left.append(str(ids_a[x]))
                x += 1
            while y < len(rb) and rb[y][1] <= cut:
                right.append(str(ids_b[y]))
                y += 1
            groups.append(",".join(left) + "|" + ",".join(right))
        counts.update(set(links))
        held.append((i, (len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    highest = collections.defaultdict(int)
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    out = []
    for i, got in held:
        if got is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, digest = got
        out.append((i, n_a, n_b, n_groups, len(links), sum(counts[p] == highest[p[0]] for p in links), sum(counts[p] for p in links), digest))
    return sorted(out, key=repr), counts


SPECIAL = [(900, "<|endoftext|> <s></s> <unk>"), (901, "a▁b"), (902, "naïve café ﬁ ①"), (903, "\x00\x01 tab\t"), (904, "  two  blanks "), (905, "한국어 emoji 👩‍👩‍👧"), (906, "x"), (907, "x")]


@pytest.mark.parametrize("most", [alignment.HOT_PAIRS, 40, 0])
def test_alignment_equals_brute_force(spark, most):
    """With few or no pairs broadcast, the others come back through the shuffle."""
    rows = [*ROWS, *SPECIAL, *((700 + i, prose(i % 4, 40)) for i in range(12))]
    found, pairs = alignment.align(documents(spark, rows), ["doc_id"], most=most)
    want, counts = brute(rows)
    assert table_rows(found) == want
    assert {(r.a, r.b): r["count"] for r in pairs.collect()} == dict(counts)


def test_alignment_of_no_rows(spark):
    assert alignment.report(empty(spark)).count() == 0
    assert table_rows(alignment.report(documents(spark, [(1, None), (2, "")]))) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_equal_texts_are_one(spark):
    texts = {r.whole: r.n for r in alignment.distinct_texts(documents(spark, [(1, "a b"), (2, "a b"), (3, None), (4, ""), (None, "a b")])).collect()}
    assert texts == {"a b": 3}
