"""Plain single-process versions of the operators, written from their definitions, for small inputs."""

import hashlib
import re
from collections import Counter
from math import log10
from zlib import crc32

SPACES = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def ident(i):
    return -(1 << 63) if i is None else i


def rlz(docs, k=20):
    first, out = {}, []
    words = [(i, SPACES.findall(t or "")) for i, t in docs]
    for i, w in words:
        for p in range(len(w) - k + 1):
            g = tuple(w[p:p + k])
            first[g] = min(first.get(g, (ident(i), p)), (ident(i), p))
    for i, w in words:
        gone = set()
        for p in range(len(w) - k + 1):
            if first[tuple(w[p:p + k])] < (ident(i), p):
                gone.update(range(p, p + k))
        out.append((i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))))
    return out


def exact(docs):
    groups = {}
    for i, t in docs:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for i, t in docs:
        ids = groups[lower(t)]
        known = [x for x in ids if x is not None]
        keep = max(known) if known else None
        out.append((i, keep, len(ids), i == keep, sha(lower(t))))
    return out


def suffix(docs, k=50):
    first, out = {}, []
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - k + 1):
            first[b[p:p + k]] = min(first.get(b[p:p + k], ident(i)), ident(i))
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - k + 1):
            if first[b[p:p + k]] < ident(i):
                gone[p:p + k] = b"\1" * k
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone) if not g))))
    return out


def turing(counts):
    n = Counter(c for c in counts if c <= 6)
    try:
        cut = 6 * n[6] / n[1]
        d = [((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) for r in range(1, 6)]
        ok = all(0 < x <= 1 for x in d)
    except ZeroDivisionError:
        ok = False
    return dict(zip(range(1, 6), d)) if ok else {r: 1 - 0.5 / r for r in range(1, 6)}


class Katz:
    """Bigram model over tokenised training texts."""

    def __init__(self, texts):
        self.u, self.b = Counter(), Counter()
        for w in texts:
            self.u.update(w)
            self.b.update(zip(w, w[1:]))
        self.n = sum(self.u.values())
        self.d1, self.d2 = turing(self.u.values()), turing(self.b.values())

    def p1(self, w):
        if w in self.u:
            return self.d1.get(self.u[w], 1) * self.u[w] / (self.n + 1)
        return 1 - sum(self.p1(x) for x in self.u)

    def p2(self, h, w):
        if self.b[h, w]:
            return self.d2.get(self.b[h, w], 1) * self.b[h, w] / (self.u[h] + 1)
        seen = [x for g, x in self.b if g == h]
        if not seen:
            return self.p1(w)
        return (1 - sum(self.p2(h, x) for x in seen)) / (1 - sum(self.p1(x) for x in seen)) * self.p1(w)


def katz(docs):
    toks = [(i, SPACES.findall(lower(t)) + [None]) for i, t in docs]
    held = {i: crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _ in docs}
    m = Katz([w for i, w in toks if not held[i]])
    v = len(m.u)
    return [(i, held[i], len(w), sum(x in m.u for x in w), m.n,
             sum(log10((m.u[x] + 0.1) / (m.n + 0.1 * (v + 1))) for x in w),
             sum(log10(m.p2(h, x) if k else m.p1(x)) for k, (h, x) in enumerate(zip([None, *w], w)))) for i, w in toks]


def leaks(docs, items, k=10):
    windows = {}
    for item, t in items:
        w = ALNUM.findall(lower(t))
        n = min(k, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[p:p + n]), set()).add(item)
    out = []
    for i, t in docs:
        w, hit, found = ALNUM.findall(lower(t)), set(), set()
        for n in range(1, k + 1):
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in windows:
                    hit.update(range(p, p + n))
                    found |= windows[tuple(w[p:p + n])]
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(names), sha(",".join(names)), bool(hit)))
    return out


def jaccard(docs, k=3, num=90, den=100):
    sets = []
    for _, t in docs:
        w = SPACES.findall(lower(t))
        sets.append({tuple(w[p:p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()})
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    low = {}
    for x, (i, _) in enumerate(docs):
        low[find(x)] = min(low.get(find(x), ident(i)), ident(i))
    return [(i, len(s), None if low[find(x)] == ident(None) else low[find(x)]) for x, ((i, _), s) in enumerate(zip(docs, sets))]


def rule_of(url, rules):
    """(host, path, rule) of a URL."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    host = lower(host)
    fits = [r for _, r in rules if ("." + host).endswith("." + r[:r.index("/")]) and path.startswith(r[r.index("/"):])]
    return host, path, max(fits, key=len, default=None)


def viterbi(word, pieces, worst, byte_ids):
    """Best ids of one word (leading blank as U+2581 in ``pieces``)."""
    lead = word.startswith(" ")
    best = [(0.0, 0, [])]
    for b in range(1, len(word) + 1):
        options = []
        for a in range(b):
            s = word[a:b]
            name = "▁" + s[1:] if lead and a == 0 else s
            if "▁" in s:
                name = None
            if name in pieces:
                i, score = pieces[name]
                options.append((best[a][0] + score, -a, best[a][2] + [i]))
            elif b - a == 1:
                options.append((best[a][0] + worst, -a, best[a][2] + [byte_ids[x] for x in s.encode()]))
        best.append(max(options))
    return best[-1][2]
