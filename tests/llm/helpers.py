"""Brute-force restatements used by several tests (plain Python, no Spark)."""

import hashlib
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def grams(words, n):
    return [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else (
        [" ".join(words)] if words else [])


def simhash_ids(hashes):
    out = 0
    for bit in range(64):
        if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes):
            out |= 1 << bit
    return out


def simhash(text, n=3):
    words = WORD.findall(ascii_lower(text or ""))
    return simhash_ids([xxhash.xxh64_intdigest(g.encode(), 42) for g in grams(words, n)])


def components(ids, fingerprints, radius):
    """Smallest id reachable by links of at most ``radius`` bits."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fingerprints[i] ^ fingerprints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    best = {}
    for i, x in enumerate(ids):
        r = find(i)
        best[r] = x if r not in best else min(best[r], x)
    return [best[find(i)] for i in range(len(ids))]


def similarity(a, b):
    a, b = Counter(a), Counter(b)
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i:i + 8])] > 1:
            covered |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    chars = sum(map(len, words))
    dup = len(lines) - len(set(lines))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    kept = not (failed or 5 * symbols > len(words) or 2 * dup > len(lines)
                or chars < 2 * len(words) or chars > 25 * len(words))
    return len(words), chars, symbols, dup, len(covered), failed, kept


ASSIGN = re.compile(r"""(?:%s)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""" % "|".join(
    "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    for w in ("password", "passwd", "secret", "token", "api_?key")))
BASE = (("assign", ASSIGN, 1, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
        ("hex", re.compile("[0-9a-f]+"), 0, 16))


def secret_spans(text):
    """Base spans ``(start, kind, end)``, by start, then kind."""
    return sorted((m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(BASE)
                  for m in p.finditer(text or "") if len(m[g]) >= least)
