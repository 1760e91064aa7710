"""Plain Python versions of the contracts, for small tables."""

import hashlib
import re
import zlib


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii(text):
    """The base spans of a text, as (start, order, end, kind)."""
    out = []
    for order, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), order, m.end(), kind))
    return sorted(out)


def words(text, alnum=False):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+" if alnum else r"[^\x20\x09-\x0D]+", low)


def shingles(text, n=3):
    w = words(text)
    if not w:
        return set()
    return {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def components(docs):
    """op3: {doc_id: (set size, component)} over (doc_id, text) pairs."""
    sets = [(i, shingles(t)) for i, t in docs]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 90 * len(x | y):
                parent[root(a)] = root(b)
    low = {}
    for a, (i, _) in enumerate(sets):
        low[root(a)] = min(low.get(root(a), i), i)
    return [(i, len(s), low[root(a)]) for a, (i, s) in enumerate(sets)]


def repeats(docs, n=50):
    """op9: [(doc_id, bytes, removed, runs, sha of what is kept)]."""
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - n + 1):
            s = b[k : k + n]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - n + 1):
            if first[b[k : k + n]] < i:
                gone[k : k + n] = [True] * n
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def crc(x):
    return zlib.crc32(str(x).encode())
