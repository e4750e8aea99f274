"""Plain Python versions of the operators, written from the contracts alone."""

import hashlib
import re
from collections import Counter
from zlib import crc32

WORD = re.compile(r"[^\x20\x09-\x0D]+")
words = lambda text: WORD.findall(text or "")
sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def quality(text):
    w, text = words(text), text or ""
    at = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if at[tuple(w[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed)


KINDS = {
    "assign": (re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile("[0-9a-f]+"), 0, 32),
}


def secrets(text):
    spans = []
    for k, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        spans += [(m.start(), k, kind, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    n = Counter(s[2] for s in spans)
    return (*[n[k] for k in KINDS], sha(",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))))


def chat(rows):
    """rows: (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
    lost = "".join(x or "" for _, r, x in rows if r == "assistant")
    return (len(rows), sha("".join(f"{r or ''}\n{x or ''}\n" for _, r, x in rows)), len(lost), sha(lost))


def simhash(text):
    import xxhash

    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def repeats(docs, n=100):
    """docs: (doc_id, text).  {doc_id: (bytes, removed, spans, sha of the rest)}."""
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            s = b[i : i + n]
            if s in seen:
                gone[i : i + n] = b"\1" * n
            seen.add(s)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[doc] = (len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def unigram_scores(docs):
    """docs: (doc_id, text).  {doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)}."""
    from math import log10

    low = lambda t: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    held = {d: crc32(str(d).encode()) % 7 == 2 for d, _ in docs}
    c = Counter()
    for d, t in docs:
        if not held[d]:
            c.update([*low(t), None])
    n, v = sum(c.values()), len(c)
    return {d: (held[d], len(w := [*low(t), None]), sum(c[x] > 0 for x in w), n, sum(log10((c[x] + 1) / (n + v + 1)) for x in w)) for d, t in docs}
