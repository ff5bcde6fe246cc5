"""Plain single-process versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACE = "\x20\t\n\x0b\x0c\r"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def secrets(text):
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
    key = "[aA][pP][iI]_?[kK][eE][yY]"
    rules = [
        ("assign", rf"""({word}|{key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", "AKIA[A-Z0-9]+", 0, 20),
        ("hex", "[0-9a-f]+", 0, 24),
    ]
    spans, counts = [], []
    for rank, (kind, pattern, group, least) in enumerate(rules):
        found = [m for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
        counts.append(len(found))
        spans += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in found]
    listed = ",".join(s for _, _, s in sorted(spans))
    return (*counts, hashlib.sha256(listed.encode()).hexdigest())


def contamination(docs, items):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))

    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows[tuple(w[i : i + size])].update([item] if item is not None else [])
    sizes = sorted({len(w) for w in windows})
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[i : i + size]))) is not None:
                    found |= own
                    hit.update(range(i, i + size))
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def substrings(docs, length=50):
    first = {}
    rows = [(doc, (text or "").encode()) for doc, text in docs]
    for doc, data in rows:
        if doc is not None:
            for i in range(len(data) - length + 1):
                key = data[i : i + length]
                first[key] = min(doc, first.get(key, doc))
    out = []
    for doc, data in rows:
        gone = [False] * len(data)
        for i in range(len(data) - length + 1 if doc is not None else 0):
            if first[data[i : i + length]] < doc:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, k):
    words = space_words(lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def near_duplicates(docs, k=3, percent=85):
    """{doc: (n_shingles, component, kept)} by comparing every pair."""
    sets = {doc: shingles(text, k) for doc, text in docs}
    parent = {doc: doc for doc in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {doc: (len(sets[doc]), root(doc), root(doc) == doc) for doc in ids}


def quality(text):
    words, seen, dup = space_words(text), set(), 0
    for line in (text or "").split("\n"):
        if space_words(line):
            dup += line in seen
            seen.add(line)
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = set()
    for i in range(len(words) - 4):
        if runs[tuple(words[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return (len(words), sum(map(len, words)), symbols, dup, len(hit), failed)


def warc(pages):
    first = {}
    for page, html in sorted((p for p in pages if p[0] is not None), key=lambda p: p[0]):
        data = (html or "").encode()
        if len(data) >= 100:
            first.setdefault(data, page)
    out = []
    for page, html in pages:
        data = (html or "").encode()
        origin = first.get(data, page)
        refers = origin if origin != page else None
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers is not None else "response", refers))
    return out


def site_lines(rows, ratio=0.1, least=4):
    """[(doc, lines, dropped, text)] for (doc, site, text) rows."""
    pages, counts = Counter(site for _, site, _ in rows), Counter()
    for _, site, text in rows:
        counts.update((site, line) for line in {x.strip(SPACE) for x in (text or "").split("\n")} - {""})
    out = []
    for doc, site, text in rows:
        lines = (text or "").split("\n")
        kept = [
            line for line in lines
            if not line.strip(SPACE) or site is None
            or counts[site, line.strip(SPACE)] < least or counts[site, line.strip(SPACE)] <= ratio * pages[site]
        ]
        n = 0 if text is None else len(lines)
        out.append((doc, n, len(lines) - len(kept), None if text is None else "\n".join(kept)))
    return out
