import collections
import random
import re
import zlib

import pytest

from mailmetrics.llm import spelling


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(count, ratio=5):
    out = {}
    for w, n in count.items():
        around = [x for x in count if near(w, x)]
        best = min(around, key=lambda x: (-count[x], x), default=None)
        form = best if best is not None and count[best] >= ratio * n else None
        out[w] = [form, n, len(around), count.get(form)]
    for w in out:
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        out[w].insert(1, root)
    return sorted((w, *v) for w, v in out.items())


@pytest.mark.parametrize("block", [2048, 3, 1])
def test_near_words(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    r = random.Random(block)
    words = {"".join(r.choice("abé") for _ in range(r.randrange(1, 9))) for _ in range(400)}
    long = "".join(r.choice("abc") for _ in range(900))
    words |= {long, long[:-1], long[1:], long[:500] + "z" + long[501:], "z" + long, "x" * 30, "ÿ", "÷×÷×÷×"}
    count = {w: r.choice([1, 2, 5, 25, 130, 700]) for w in words}
    df = spark.createDataFrame(list(count.items()), "word string, n long")
    got = sorted((tuple(x) for x in spelling.group_variants(df).collect()))
    assert got == brute(count)
    assert spelling.group_variants(df.limit(0)).count() == 0


def corpus(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcDÉ") for _ in range(r.randrange(5, 9))) for _ in range(30)]
    rows = []
    for i in range(120):
        words = [r.choice(base[:r.choice([3, 30])]) for _ in range(r.randrange(60))]
        for k in range(0, len(words), 9):
            x = list(words[k])
            x[r.randrange(len(x))] = r.choice("abcX")
            words[k] = "".join(x)
        rows.append((r.choice([i, 5, None]), r.choice([" ".join(words)] * 6 + [None, "", "1".join(words)]), "x"))
    return rows + rows[:6]


def test_documents(spark):
    rows = corpus(1)
    count = collections.Counter()
    for d, t, _ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m.group().lower(), w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            count[w[:h % len(w)] + w[h % len(w) + 1:] if h % 199 == 0 else w] += 1
    want = brute({w: n for w, n in count.items() if len(w) >= 6 and n >= 5})
    df = spark.createDataFrame(rows, "doc_id long, text string, word string")
    got = sorted((tuple(x) for x in spelling.document_variants(df).collect()))
    assert got == want and any(x[1] for x in want)
    cut = spelling.misspelt(spelling.runs(df)).subtract(spelling.runs(df))
    assert cut.count() > 0
    assert spelling.document_variants(df.limit(0)).collect() == []
