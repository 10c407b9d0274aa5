import random

import pytest
from brute import sha
from tokenizers import Tokenizer

from mailmetrics.llm import bpe, queries

ODD = ["", "<|endoftext|>a b<|endoftext|>", " \n\t  x", "   ", "日本語テキスト 😀👍🏽 ñandú", "a" * 5000, "   x y\x00z",
       "it's 12'345 don't I'LL", "<|endoftext|><|endo"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.vocabulary_path())


@pytest.fixture(scope="module")
def codec():
    with open(queries.vocabulary_path(), encoding="utf-8") as f:
        return bpe.SpeculativeBpe(f.read())


def texts(n):
    r = random.Random(1)
    pick = (lambda: r.randrange(32, 127), lambda: r.randrange(160, 0x3000), lambda: r.randrange(0x1F300, 0x1FAFF))
    return ODD + ["".join(chr(r.choice(pick)()) for _ in range(60)) for _ in range(n)]


def test_equals_the_library(codec, library):
    for t in texts(500):
        ids = library.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_speculation_is_verified(codec):
    words = [w.encode().decode() for w in (" lowest", " unbelievably", "thhaeron", "xyzzyx", " élection")]
    assert codec.encode_words(words) == [codec.merge(w.encode()) for w in words]
    assert any(codec.propose(w.encode()) != codec.merge(w.encode()) for w in words)  # some proposals are wrong


def test_round_trip_and_digests(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "x"), (90, None), (0, ODD[0])]
    df = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, ids string")
    path = queries.vocabulary_path()
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(t or "")))
    assert sorted([tuple(r) for r in bpe.encode_documents(df, path).collect()], key=str) == sorted(want, key=str)
    back = bpe.decode_documents(bpe.encode_documents(df, path, digests=False), path)
    assert sorted([tuple(r) for r in back.collect()], key=str) == sorted([(d, t or "") for d, t in rows], key=str)
    assert bpe.encode_documents(df.limit(0), path).count() == 0


def test_small_cache(spark, monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    with open(queries.vocabulary_path(), encoding="utf-8") as f:
        codec = bpe.SpeculativeBpe(f.read())
    for t in ("one two three four five six", "six seven one two"):
        codec.learn([codec.parts(t)])
        assert codec.digest(codec.parts(t))[0] == len(library.encode(t, add_special_tokens=False).ids)
