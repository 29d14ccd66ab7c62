"""Secrets: fixed forms, and random strings shown by poor token efficiency (operator 8).

A vocabulary learned from ordinary text spells words in few tokens and random
strings in many.  A string of key-like characters with under
``LEAST_RATIO`` characters a token is random, unless its form is that of a
digest, a UUID, a number or an identifier made of words and numbers.

One Arrow pass over whole texts, no shuffle.  Null and empty texts have no
spans; repeated rows are judged alike.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame

from tradeweave.llm.arrow_map import per_text
from tradeweave.llm.bpe import SPLIT

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: Without one of these, in lower case, there is no assignment.
NAMES = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LIKE_KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: Strings that a random string is told apart from by form alone.
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})=*\Z")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
WORDLIKE = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)?(?:[+/_=-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)?)*\Z")
CASE_CHANGE = re.compile(r"[a-z][A-Z]|[A-Z]{2}[a-z]")
LEAST_RATIO = 2.0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoding(ranks: bytes):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def chars_per_token(value: str, encoding) -> float:
    return len(value) / len(encoding.encode_ordinary(value))


def is_random(value: str, encoding, least: float = LEAST_RATIO) -> bool:
    letters, digits = any(c.isalpha() for c in value), any(c.isdigit() for c in value)
    if not letters or not (digits or len(CASE_CHANGE.findall(value)) >= 3):
        return False
    if DIGEST.match(value) or UUID.match(value) or WORDLIKE.match(value):
        return False
    return chars_per_token(value, encoding) < least


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of the fixed forms."""
    found = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    lowered = text.lower()
    if any(name in lowered for name in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    return sorted(found)


def find(text: str, encoding, least: float = LEAST_RATIO) -> tuple[list, list]:
    """The spans of the fixed forms, and all spans, in order."""
    base = base_spans(text)
    more = []
    covered = _merged(base)
    starts = [start for start, _ in covered]
    for m in LIKE_KEY.finditer(text):
        # A fixed form that covers part of the string already names it.
        last = bisect_left(starts, m.end()) - 1
        if (last < 0 or covered[last][1] <= m.start()) and is_random(m[0], encoding, least):
            more.append((m.start(), KINDS.index("random"), m.end()))
    return base, sorted(base + more)


def _merged(spans: list) -> list[tuple[int, int]]:
    joined: list[tuple[int, int]] = []
    for start, _, end in spans:
        if joined and start < joined[-1][1]:
            joined[-1] = (joined[-1][0], max(end, joined[-1][1]))
        else:
            joined.append((start, end))
    return joined


def spell(spans: list) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, keep: list[str | Column] | None = None, text: str = "text", vocabulary: str | None = None, least: float = LEAST_RATIO) -> DataFrame:
    """``keep`` with n_assign, n_access, n_hex, n_random, base_sha256 and spans (kind:start:end in code points, comma-joined)."""
    # The size of a tokenizer's vocabulary, whatever the documents' number.
    shared = docs.sparkSession.sparkContext.broadcast(Path(vocabulary or default_vocabulary()).read_bytes())

    def prepare():
        encoding = _encoding(shared.value)

        def one(x: str) -> tuple:
            base, spans = find(x, encoding, least)
            counts = [sum(s[1] == kind for s in spans) for kind in range(len(KINDS))]
            return *counts, hashlib.sha256(spell(base).encode()).hexdigest(), spell(spans)

        return lambda texts: [one(x) for x in texts]

    fields = "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
    return per_text(docs, prepare, fields, keep if keep is not None else ["doc_id"], text)
