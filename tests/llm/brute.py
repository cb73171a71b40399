"""Plain versions of the operators' contracts, for small inputs."""

import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

GAP = b" \t\n\x0b\x0c\r"


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fold(doc_id, parts):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % parts


def lm_base(docs):
    """doc_id -> (n_tokens, n_known, train_tokens, base_score)"""
    seq = [(i, words(lower(t)) + [None]) for i, t in docs]
    counts = Counter(w for i, ws in seq if fold(i, 7) not in (2, None) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(i, len(ws), sum(counts[w] > 0 for w in ws), n,
             sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in seq]


def fingerprint(text):
    ws = words(lower(text))
    if not ws:
        return 0
    shingles = [" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)] or [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(docs):
    """(doc_id, fingerprint, component_id) of every row"""
    prints = [fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        groups[find(i)].append(d)
    first = {g: min([d for d in ids if d is not None], default=None) for g, ids in groups.items()}
    return [(d, f"{prints[i]:016x}", first[find(i)]) for i, (d, _) in enumerate(docs)]


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"""
    text = text or ""
    ws = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = defaultdict(list)
    for i in range(len(ws) - 7):
        windows[tuple(ws[i:i + 8])].append(i)
    covered = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            len(ws) < 20 or 100 * len(covered) > 30 * len(ws))


PHRASES = {"the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def license_base(text):
    """n_words, n_base, first_word, last_word, base_labels"""
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    found = [(i, label) for p, label in PHRASES.items() for i in range(len(ws)) if ws[i:i + len(p.split())] == p.split()]
    starts = [i for i, _ in found]
    return (len(ws), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found})))


def targets(sizes):
    """Words wanted per source, by raising the common level until the total is met."""
    total, w = 1.5 * sum(sizes), [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    filled = lambda level: sum(min(2 * s, level * x) for s, x in zip(sizes, w))
    low, high = 0.0, 2 * max(sizes, default=0) + 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if filled(mid) < total else (low, mid)
    return [min(2 * s, high * x) for s, x in zip(sizes, w)]


def top_k(vectors, k=5):
    rows = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in rows:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in rows if j != i)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return out
