"""Brute-force versions of the operators, and small awkward tables."""

import collections
import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEST_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def repeats(rows, n):
    at = collections.Counter()
    data = [(t or "").encode() for _, t in rows]
    for b in data:
        at.update(b[i:i + n] for i in range(len(b) - n + 1))
    res = []
    for (d, _), b in zip(rows, data):
        gone = [False] * len(b)
        for i in range(len(b) - n + 1):
            if at[b[i:i + n]] > 1:
                gone[i:i + n] = [True] * n
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        res.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return sorted(res, key=str)


def passages(rows, n):
    first = {}
    words = [WORD.findall(t or "") for _, t in rows]
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - n + 1 if d is not None else 0):
            k = tuple(w[i:i + n])
            first[k] = min(d, first.get(k, d))
    res = []
    for (d, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - n + 1 if d is not None else 0):
            if first[tuple(w[i:i + n])] < d:
                gone[i:i + n] = [True] * n
        res.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(res, key=str)


def contamination(rows, items, n=13):
    def words(t):
        return TEST_WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))

    windows = {}
    for k, t in items:
        w = words(t)
        for i in range(max(1, len(w) - n + 1) if w and k is not None else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(str(k))
    res = []
    for d, t in rows:
        w, hit, own = words(t), set(), set()
        for m in {len(k) for k in windows}:
            for i in range(len(w) - m + 1):
                if tuple(w[i:i + m]) in windows:
                    hit.update(range(i, i + m))
                    own |= windows[tuple(w[i:i + m])]
        res.append((d, len(w), len(hit), len(own), sha(",".join(sorted(own))), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(res, key=str)


def jaccard(rows, n=5, threshold=0.8):
    sets = []
    for _, t in rows:
        w = WORD.findall(t or "")
        sets.append({tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root, links, where = list(range(len(rows))), [0] * len(rows), collections.defaultdict(list)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in {j for g in s for j in where[g]}:
            both = len(s & sets[j])
            if both >= threshold * (len(s) + len(sets[j]) - both) - 1e-9:
                links[i], links[j] = links[i] + 1, links[j] + 1
                root[find(i)] = find(j)
        for g in s:
            where[g].append(i)
    group, copy = {}, {}
    for i, (d, _) in enumerate(rows):
        if sets[i]:
            group[find(i)] = min(group.get(find(i), d), d)
            copy[frozenset(sets[i])] = min(copy.get(frozenset(sets[i]), d), d)
    return sorted((d, group[find(i)] if sets[i] else d, copy[frozenset(sets[i])] if sets[i] else d, links[i]) for i, (d, _) in enumerate(rows))


def awkward(n, seed, null_ids=True):
    """Texts that share passages, some null or empty, ids that repeat, rows that repeat."""
    r = random.Random(seed)
    base = ["".join(r.choice("ab ñ\n") for _ in range(r.randrange(1, 200))) for _ in range(4)]
    rows = []
    for i in range(n):
        t = ""
        for _ in range(r.randrange(5)):
            x = r.choice(base)
            a = r.randrange(len(x))
            t += r.choice([x, x[a:], x[:a], "zq", "a" * 30, "".join(r.choice("abcdefgh ") for _ in range(20))])
        rows.append((r.choice([i, i, i, max(0, i - 1), None if null_ids else i]), r.choice([t, t, t, None, ""])))
    return rows + rows[:3]


def near_copies(seed, n=300):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(3)) for _ in range(300)]
    base = [[r.choice(vocab) for _ in range(120)] for _ in range(4)]
    rows = []
    for i in range(n):
        w = list(r.choice(base)) if r.random() < 0.9 else [r.choice(vocab) for _ in range(r.randrange(40))]
        for _ in range(r.randrange(4)):
            if w:
                w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((i, r.choice([" ".join(w)] * 8 + [None, ""])))
    return rows + rows[:4]
