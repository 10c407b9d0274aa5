import collections
import random

import public_tokenizers
import pytest
from brute import sha

from mailmetrics.llm import alignment
from mailmetrics.llm import token_groups as tg

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "a", "  two  spaces ", "x▁y z", "nul\0 byte", "日本語 テキスト 😀👍🏽 ñandú", "=" * 300, "=- " * 90, "<s> </s> <unk> <|endoftext|>x",
       "　a b c\u0085 d", "é" * 150, "tab\tline\n end ", "don't we'll 12'345"]


@pytest.fixture(scope="module")
def aligner():
    with open(A, encoding="utf-8") as a, open(B, "rb") as b:
        return tg.TokenAligner(a.read(), b.read())


def texts(seed, n):
    r = random.Random(seed)
    words = ["the", "of", "unbelievable", "Étion", "zueinen.", "x" * 30, "日本", "don't", "3.14", "(a)", "😀"]
    odd = lambda: chr(r.choice([32, 32, 32, 9, 97, 98, 46, 0xE9, 0x20AC, 0x1F600, 0x3000, 0x85, 0x1C, 0x180E]))
    return [" ".join(r.choice(words) for _ in range(r.randrange(1, 60))) for _ in range(n)] + ["".join(odd() for _ in range(60)) for _ in range(n)]


def groups(aligner, text):
    """Groups of one text, tokenized whole: lists of (A ids, B ids); none if it isn't spelt exactly."""
    if not text:
        return []
    a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(aligner.a_bytes[i] for i in a) != raw or b"".join(aligner.b_bytes[i] for i in b) != raw:
        return []
    ends = []
    for ids, table in ((a, aligner.a_bytes), (b, aligner.b_bytes)):
        at, side = 0, {}
        for i in ids:
            at += len(table[i])
            side[at] = i
        ends.append(side)
    both, found, last = sorted(ends[0].keys() & ends[1].keys()), [], 0
    for c in both:
        found.append(tuple([i for p, i in side.items() if last < p <= c] for side in ends))
        last = c
    return found


def written(found):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in found)


def brute(aligner, rows):
    held = [groups(aligner, t) for _, t in rows]
    links = [collections.Counter((x, y) for a, b in g for x in a for y in b) for g in held]
    count = collections.Counter(p for c in links for p in c)
    most = collections.Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return sorted(((d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()),
                    sum(k for p, k in c.items() if count[p] == most[p[0]]), sum(k * count[p] for p, k in c.items()), sha(written(g)) if g else "")
                   for (d, _), g, c in zip(rows, held, links)), key=str)


@pytest.mark.parametrize("wide,cache", [(1 << 16, 10**6), (3, 20)])
def test_texts(aligner, monkeypatch, wide, cache):
    monkeypatch.setattr(tg, "WIDE", wide)
    monkeypatch.setattr(tg, "CACHE_PARTS", cache)
    aligner.forget()
    some = [t or "" for t in ODD] + texts(1, 80)
    for at in range(0, len(some), 25):
        part = some[at:at + 25]
        got = aligner.texts(part)
        for k, t in enumerate(part):
            want = groups(aligner, t)
            pairs = collections.Counter(x * aligner.many + y for a, b in want for x in a for y in b)
            i, j = got["starts"][k:k + 2]
            assert (got["groups"][k], got["stats"][k][2]) == (written(want), len(want))
            assert dict(zip(got["pairs"][i:j].tolist(), got["times"][i:j].tolist())) == dict(pairs)


def test_fragments_are_a_monoid():
    def fold(parts, r):
        """Joins neighbours in any order: (fragment, closed bytes in order)."""
        items = [(f, c) for f, c in map(tg.Fragment.of, parts)]
        while len(items) > 1:
            i = r.randrange(len(items) - 1)
            (f, c), (g, d) = items[i:i + 2]
            whole, seam = f.join(g)
            items[i:i + 2] = [(whole, c + seam + d)]
        return items[0]

    r = random.Random(5)
    for t in texts(9, 40) + [t for t in ODD if t]:
        raw = (" " + t).encode()
        want = tg.Fragment.of(raw)
        for n in (1, 2, 7, 40):
            f, closed = fold([raw[i:i + n] for i in range(0, len(raw), n)], r)
            assert (f.prefix, f.suffix, closed) == (want[0].prefix, want[0].suffix, want[1])


@pytest.mark.parametrize("chunk,fan,head", [(1 << 16, 16, 1 << 20), (64, 2, 40), (17, 3, 0), (5, 4, 10**6)])
def test_documents(spark, aligner, chunk, fan, head):
    body = ODD + texts(chunk, 12) + [" ".join(texts(3, 15))]
    r = random.Random(chunk)
    rows = [(r.choice([i, i, 3, None]), t) for i, t in enumerate(body)] + [(0, body[20]), (0, body[20]), (None, None)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, pairs string").repartition(3)
    got = alignment.align_documents(df, A, B, chunk=chunk, fan=fan, head=head).collect()
    assert sorted([tuple(x) for x in got], key=str) == brute(aligner, rows)
    assert alignment.align_documents(df.limit(0), A, B, chunk=chunk).collect() == []
