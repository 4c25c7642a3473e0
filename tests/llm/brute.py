"""Plain single-machine versions that the operators are held against."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

GAP = re.compile(r"[ \t\n\x0b\x0c\r]+")


def words(text):
    return [w for w in GAP.split(text or "") if w]


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    text = text or ""
    w = words(text)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    return (
        len(w),
        sum(map(len, w)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(inside),
        len(w) < 20 or 100 * len(inside) > 30 * len(w),
    )


def archive(rows):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of (page_id, url, html)."""
    same = defaultdict(list)
    for page, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 100 and page is not None:
            same[body].append(page)
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        first = min(same[body]) if body in same and page is not None else page
        revisit = first != page
        kind = "revisit" if revisit else "response"
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), kind, first if revisit else None))
    return sorted(out, key=repr)


class Union:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def linked_vectors(rows, threshold=0.93):
    """(vec_id, n_links, component_id, kept) of (vec_id, embedding, label)."""

    def good(e, label):
        return bool(label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e))

    groups = defaultdict(list)
    for i, (_, e, label) in enumerate(rows):
        if good(e, label):
            groups[label, len(e)].append(i)
    links, parts = [0] * len(rows), Union(len(rows))
    for members in groups.values():
        x = np.array([rows[i][1] for i in members], np.float32).astype(float)
        norm = np.sqrt((x * x).sum(1))
        near = (x @ x.T) / np.outer(norm, norm) >= threshold
        for a in range(len(members)):
            for b in np.flatnonzero(near[a]):
                if a != b:
                    links[members[a]] += 1
                    parts.join(members[a], members[int(b)])
    least = {}
    for i, row in enumerate(rows):
        root = parts.find(i)
        least[root] = min(least.get(root, row[0]), row[0])
    return sorted((r[0], links[i], least[parts.find(i)], r[0] == least[parts.find(i)]) for i, r in enumerate(rows))


def covered(texts, length):
    """For each text of bytes, which bytes lie in a string of ``length`` bytes that starts twice anywhere."""
    often = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if often[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def repeats(texts, length=400):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text of bytes."""
    out = []
    for t, gone in zip(texts, covered(texts, length), strict=True):
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def near_classes(texts, smoothing, similarity=0.8):
    """The class of each text: the least row that links of weighted Jaccard similarity reach; equal texts are linked."""
    sets = [shingles(t) for t in texts]
    df = Counter(s for x in sets for s in x)
    n = len(texts)
    weight = {s: np.log1p(n / (df[s] + smoothing * n)) for s in df}
    parts = Union(n)
    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (texts[i] or "") == (texts[j] or ""):
                parts.join(i, j)
                continue
            low = sum(min(a[s], b[s]) * weight[s] for s in a.keys() & b.keys())
            high = sum(max(a[s], b[s]) * weight[s] for s in a.keys() | b.keys())
            if high and low >= similarity * high:
                parts.join(i, j)
    return [parts.find(i) for i in range(n)]


def chats(rows):
    """Digests of the conversations of (conv_id, turn, role, text)."""
    marks = r"(<s>|\[INST\]|\[/INST\]|</s>)"

    def escaped(text):
        text = re.sub(r"(\\*)" + marks, lambda m: m[1] * 2 + "\\" + m[2], text)
        return re.sub(r"(?<!\\)(\\+)\Z", lambda m: m[1] * 2, text)

    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append((-1 if turn is None else turn, role or "", text or ""))
    out = []
    for conv, turns in talks.items():
        turns.sort(key=lambda x: x[0])
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        learned = "".join(t for _, r, t in turns if r == "assistant")
        shown = "<s>" + "".join(f"[INST]{escaped(r)}[/INST]{escaped(t)}</s>" for _, r, t in turns)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((conv, len(turns), digest(whole), len(learned), digest(learned), len(shown)))
    return sorted(out, key=repr)


def merkle(rows, seen, arity=3):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root) of (doc_id, source, lang, n_chars, text) rows."""

    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(row):
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])

    def tree(nodes):
        """Root, and for each place the (left, right) siblings of each level."""
        steps, level, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
        while len(level) > 1:
            for place, k in enumerate(at):
                first = k - k % arity
                steps[place].append(("".join(level[first:k]), "".join(level[k + 1 : first + arity])))
            level = [h(*level[i : i + arity]) for i in range(0, len(level), arity)]
            at = [k // arity for k in at]
        return level[0], steps

    groups = defaultdict(list)
    for row, later in zip(rows, seen, strict=True):
        groups[row[1]].append((row[0] is not None, row[0] or 0, leaf(row), row[0], leaf((*row[:4], later))))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    below = {s: tree([x[2] for x in sorted(groups[s])]) for s in order}
    root, top = tree([below[s][0] for s in order]) if order else (None, [])
    out = []
    for place, source in enumerate(order):
        subroot, steps = below[source]
        for (_, _, mine, doc, later), path in zip(sorted(groups[source]), steps, strict=True):
            node = later
            for left, right in path + top[place]:
                node = h(left, node, right)
            out.append((doc, mine, subroot, root, h(*[x + y for x, y in path + top[place]]), node))
    return sorted(out, key=repr)


def earlier_passages(rows, length=50):
    """(doc_id, n_words, n_removed, kept words) of (doc_id, text): windows that a smaller doc_id has are removed."""
    texts = [(words(t), d) for d, t in rows]
    low = {}
    for w, d in texts:
        for i in range(len(w) - length + 1):
            if d is not None:
                k = tuple(w[i : i + length])
                low[k] = min(low.get(k, d), d)
    out = []
    for w, d in texts:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if d is not None and low[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def changed_words(doc_id, text):
    """The words of a text, for a tenth of the ids periodic from some word on."""
    w = words(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def runs(w, least=12):
    """(start, length, period) of all runs of a list, by start, then period."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            a = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - a + q >= max(least, 2 * q) and (a, i + q) not in found:
                found[a, i + q] = q  # periods ascend: the first is the smallest
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def run_report(doc_id, text):
    w = changed_words(doc_id, text)
    found = runs(w)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None, None, None)
    exponent = 1000 * best[1] // best[2] if found else None
    lines = "".join(f"{a},{n},{q}\n" for a, n, q in found)
    return (doc_id, len(found), *best, exponent, sha(lines), sha(" ".join(collapsed(w, found))))
