"""Plain versions of the operators, for small inputs."""

import hashlib
import re

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
sha = lambda b: hashlib.sha256(b).hexdigest()


def lower(text):
    return (text or "").translate(UP)


def words(text):
    return WORD.findall(lower(text))


def exact(rows):
    """doc_id: (keep_id, group_size, kept, sha256)."""
    groups = {}
    for doc, text in rows:
        groups.setdefault(lower(text), []).append(doc)
    return {d: (max(g), len(g), d == max(g), sha(t.encode())) for t, g in groups.items() for d in g}


def repeats(rows, length, keep="none", order=None):
    """doc_id: (n_bytes, n_removed, n_spans, remaining bytes)."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = {}
    for k, (_, b) in enumerate(texts):
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i : i + length], []).append((k, i))
    out = {}
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if len(seen[b[i : i + length]]) > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[d] = (len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g))
    return out


def contamination(rows, items, window=10):
    """doc_id: (n_words, n_hit, sorted item ids)."""
    grams = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = {}
    for d, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if items_found := grams.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= items_found
        out[d] = (len(w), len(hit), sorted(found))
    return out


SECRETS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def secrets(text):
    """Base spans: (start, rank, end)."""
    out = []
    for rank, (_, p, group, least) in enumerate(SECRETS):
        out += [(m.start(), rank, m.end()) for m in p.finditer(text or "") if len(m[group]) >= least]
    return sorted(out)
