"""Verdicts beyond the fixed forms and counts, written a second time in plain Python."""

import collections
import hashlib
import math
import random
import re

import public_tokenizers
import regex
from corpus import ROWS, documents, prose, table_rows
from tokenizers import Tokenizer

from tradeweave.llm import pii, quality_rules, secrets

SHA = lambda x: hashlib.sha256(x.encode()).hexdigest()


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


VALID = {
    "email": lambda v: True,
    "ip": lambda v: all(int(x) <= 255 for x in v.split(".")),
    "card": lambda v: 12 <= len(re.sub("[^0-9]", "", v)) <= 19 and luhn(re.sub("[^0-9]", "", v)),
    "phone": lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15,
}
FITS = {
    "email": lambda v: "@" in v,
    "ip": lambda v: re.fullmatch(r"[0-9]+(\.[0-9]+)+", v) is not None,
    "card": lambda v: len(re.sub("[^0-9]", "", v)) >= 7 and "@" not in v,
    "phone": lambda v: len(re.sub("[^0-9]", "", v)) >= 7 and "@" not in v,
}


def patterns(gap):
    words = re.sub(r"\s+", " ", gap.rsplit("\n", 1)[-1].rstrip(" ")).rstrip(" ").split(" ")[-2:]
    words = [w.lower() for w in words]
    found = set()
    if len(words) == 2 and all(w and not re.search(r"[\s0-9]", w) for w in words):
        found.add(" ".join(words))
    if words[-1] and not re.search(r"[0-9]", words[-1]) and re.search(r"\w[:=#]$", words[-1], re.ASCII):
        found.add(words[-1])
    return found


def placed(text, form):
    at, out = 0, []
    for m in regex.finditer(form, text, flags=regex.ASCII | regex.VERSION0):
        out.append((m.start(), m.end(), m[0], patterns(text[at : m.start()])))
        at = m.end()
    return out


def brute_context(texts):
    kinds, bases, others, edges = list(pii.FORMS), [], [], set()
    for text in texts:
        base = []
        for order, kind in enumerate(kinds):
            for start, end, value, before in placed(text, pii.FORMS[kind]):
                if VALID[kind](value):
                    base.append((start, order, kind, end))
                    edges |= {(p, value, kind) for p in before}
        loose = [x for x in placed(text, pii.CANDIDATE) if len(x[2]) >= 5 and re.search("[0-9@]", x[2]) and x[3] and not any(s < x[1] and x[0] < e for s, _, _, e in base)]
        edges |= {(p, x[2], None) for x in loose for p in x[3]}
        bases.append(base)
        others.append(loose)
    seeds = collections.Counter((p, kind) for p, _, kind in edges if kind)
    strong = [x for x, n in seeds.items() if n >= 3]
    owners = collections.defaultdict(set)
    for p, value, kind in edges:
        owners[p, value].add(kind)
    reach = {(p, kind): {v: 1.0 if kind in own else 0.0 if own - {None} else None for (q, v), own in owners.items() if q == p} for p, kind in strong}
    score = {x: sum(t or 0.0 for t in values.values()) / len(values) for x, values in reach.items()}
    while True:
        doubt = collections.defaultdict(dict)
        for (p, kind), values in reach.items():
            for v, t in values.items():
                if t is None:
                    doubt[kind, v][p] = 1 - min(score[p, kind], 0.99)
        hearsay = lambda p, kind, v: 0.5 * (1 - math.prod(x for q, x in doubt[kind, v].items() if q != p))
        new = {(p, kind): sum(hearsay(p, kind, v) if t is None else t for v, t in values.items()) / len(values) for (p, kind), values in reach.items()}
        moved, score = max((abs(new[x] - score[x]) for x in new), default=0.0), new
        if moved <= 1e-3:
            break
    out = []
    for base, loose in zip(bases, others):
        spans = list(base)
        for start, end, value, before in loose:
            named = [(k, kind) for k, kind in enumerate(kinds) if FITS[kind](value) and any(score.get((p, kind), 0) >= 0.7 for p in before)]
            if named:
                spans.append((start, *named[0], end))
        out.append(",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans)))
    return out, score


def test_context_spans_equal_brute_force(spark):
    """Patterns of several kinds and strengths, some reliable only by what other patterns believe."""
    pick = random.Random(31)
    texts = [t or "" for _, t in ROWS]
    for i in range(120):
        number = f"+1 (555) 555-{1000 + i}" if pick.random() < 0.6 else f"555-{pick.randrange(10**6, 10**7)}"
        mail = f"user{i}@mail.example.com" if pick.random() < 0.6 else f"user{i}@intranet"
        ip = f"10.0.{i}.{pick.randrange(300)}"
        lead = pick.choice(["call me", "reach via", "Phone:", "my   fax:", "room number", "in total"])
        texts.append(f"{prose(i, 5)} {lead} {number if pick.random() < 0.7 else 'AB-' + str(10**6 + i)} and\nwrite to {mail} or {pick.choice(['host', 'server at', 'addr='])} {ip} {prose(i + 500, 4)}")
    docs = documents(spark, list(enumerate(texts)))
    want, score = brute_context(texts)
    found = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    assert [found[i] for i in range(len(texts))] == want
    base = sum(len(x.split(",")) for x in want if x)
    assert base > 120 and len([s for s in score.values() if s >= 0.7]) >= 3 and len([s for s in score.values() if s < 0.7]) >= 3


def test_random_strings_equal_brute_force(spark):
    pick = random.Random(37)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts = [t or "" for _, t in ROWS]
    for i in range(150):
        kinds = ["".join(pick.choice(letters) for _ in range(pick.choice([8, 16, 20, 40, 300]))), "".join(pick.choice("0123456789abcdef") for _ in range(pick.choice([32, 40, 33]))), "maxConnectionTimeout-2021", "internationalisation1", "A" * 30 + "7", "/usr/share/doc/python3", f"key{i}=" + "x9Y" * 9]
        texts.append(" ".join([prose(i, 4), pick.choice(kinds), "token = " + pick.choice(kinds), prose(i, 3), pick.choice(kinds)]))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for text in texts:
        base = secrets.base_spans(text)
        covered = {k for a, _, b in base for k in range(a, b)}
        more = []
        for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}", text):
            v = m[0]
            core = v.rstrip("=")
            digest = re.fullmatch("[0-9a-fA-F]+", core) and len(core) in (32, 40, 56, 64, 96, 128)
            uuid = re.fullmatch("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", v)
            parts = [x for x in re.split(r"[+/_=-]+", v) if x]
            plain = all(re.fullmatch("[A-Z]?[a-z]+|[A-Z]+|[0-9]+", x) for x in parts)
            mixed = any(c.isdigit() for c in v) or len(re.findall("[a-z][A-Z]|[A-Z]{2}[a-z]", v)) >= 3
            if set(range(m.start(), m.end())) & covered or not any(c.isalpha() for c in v) or not mixed or digest or uuid or plain:
                continue
            if len(v) / len(library.encode(v, add_special_tokens=False).ids) < 2.0:
                more.append((m.start(), 3, m.end()))
        want.append(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base + more)))
    found = {r.doc_id: r.spans for r in secrets.scan(documents(spark, list(enumerate(texts)))).collect()}
    assert [found[i] for i in range(len(texts))] == want
    assert 50 < sum("random" in x for x in want) < 150


def good(line):
    words = re.findall(r"[^\x20\x09-\x0D]+", line)
    n = len(words)
    if not n:
        return True
    if 3 * len(re.findall(r"[#*$%&|<>]", line)) > n:
        return False
    if n >= 3 and 2 * len(regex.findall(r"\p{Lu}", line)) > len(line):
        return False
    if 2 * len(re.findall("!!", line)) > n:
        return False
    if n >= 4 and 3 * sum(a == b for a, b in zip(words, words[1:])) > n:
        return False
    if n <= 12 and re.search(quality_rules.BOILERPLATE, line, re.ASCII):
        return False
    return n < 40 or re.search(r"[.!?,;:…。！？]", line) is not None


def test_line_verdicts_equal_brute_force(spark):
    pick = random.Random(41)
    furniture = ["Home | About | Contact | Login", "All rights reserved", "click here to read more", "BUY NOW THIS DAY", "wow !! wow !! now !!", "go go go go go", "a $ b $ c $", "É À Ü", " ".join(f"w{i}" for i in range(45)), "", "   "]
    rows = [(i, "\n".join(x for _ in range(pick.randrange(2, 6)) for x in (prose(pick.randrange(10**6), pick.randrange(5, 40)), *pick.choices(furniture, k=pick.randrange(0, 9))))) for i in range(150)]
    rows += [(1000 + k, t) for k, (_, t) in enumerate(ROWS)]
    want = []
    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, inside = collections.Counter(zip(w, w[1:], w[2:])), set()
        for k, x in enumerate(zip(w, w[1:], w[2:])):
            if seen[x] > 1:
                inside |= {k, k + 1, k + 2}
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        left = sum(len(re.sub(r"[\x20\x09-\x0D]+", "", x)) for x in t.split("\n") if good(x))
        want.append((i, not failed and 100 * left >= 60 * sum(map(len, w))))
    found = table_rows(quality_rules.report(documents(spark, rows)).select("doc_id", "kept"))
    assert found == sorted(want, key=repr)
    assert 20 < sum(k for _, k in want) < len(want) - 20 and not math.isnan(len(found))
