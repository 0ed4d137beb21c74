"""Plain versions of the operators, for small tables."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ordered(rows):
    """Rows as documents in order; a null id comes first and a repeated row is one document."""
    return sorted({((i is not None, i or 0), t or "") for i, t in rows})


def substrings(rows, depth=100):
    seen, out = {}, {}
    for key, text in ordered(rows):
        body = text.encode()
        gone = bytearray(len(body))
        for s in range(len(body) - depth + 1):
            window = body[s : s + depth]
            if window in seen:
                gone[s : s + depth] = b"\1" * depth
            else:
                seen[window] = True
        kept = bytes(b for b, g in zip(body, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(body)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[key[1] if key[0] else None, text] = (len(body), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def sentences(text):
    found = [(m.start(), m.end()) for m in WORD.finditer(text)]
    out, current = [], []
    for k, (a, b) in enumerate(found):
        current.append((a, b))
        if k == len(found) - 1 or text[b - 1] in ".!?" or "\n" in text[b : found[k + 1][0]]:
            out.append((current[0][0], current[-1][1], len(current)))
            current = []
    return out


def sentence_runs(parts, least, words):
    runs = set()
    for s in range(len(parts)):
        end = s
        while end < len(parts) and (end - s < least or sum(p[2] for p in parts[s:end]) < words):
            end += 1
        if end - s >= least and sum(p[2] for p in parts[s:end]) >= words:
            runs.add((s, end))
        begin = s + 1
        while begin > 0 and (s + 1 - begin < least or sum(p[2] for p in parts[begin : s + 1]) < words):
            begin -= 1
        if s + 1 - begin >= least and sum(p[2] for p in parts[begin : s + 1]) >= words:
            runs.add((begin, s + 1))
    return sorted(runs)


def kept_sentences(rows, least=2, words=10):
    first, every = {}, []
    for key, text in ordered(rows):
        parts = sentences(text)
        for s, e in sentence_runs(parts, least, words):
            content = tuple(text[a:b] for a, b, _ in parts[s:e])
            every.append((key, text, s, e, content))
            first.setdefault(content, (key, text, s))
    gone = collections.defaultdict(set)
    for key, text, s, e, content in every:
        if first[content] != (key, text, s):
            gone[key, text].update(range(s, e))
    out = {}
    for key, text in ordered(rows):
        parts, removed = sentences(text), gone[key, text]
        bounds = [p[0] for p in parts] + [len(text)]
        kept = text if not removed else text[: bounds[0]] + "".join(text[bounds[k] : bounds[k + 1]] for k in range(len(parts)) if k not in removed)
        out[key[1] if key[0] else None, text] = (len(parts), len(removed), kept)
    return out


def shingles(text, k):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def classes(rows, k, num, den):
    """Least id that each id reaches; rows that repeat an id are one node."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows}
    rank = lambda i: (i is not None, i or 0)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if x and y and den * len(x & y) >= num * len(x | y):
                lo, hi = sorted((root(i), root(j)), key=rank)
                parent[hi] = lo
    return {i: root(i) for i, _ in rows}
