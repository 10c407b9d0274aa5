"""Benchmark decontamination with suffix arrays of the training text.

Words are maximal runs of digits, a-z and non-ASCII characters after A-Z are
lower-cased.  Every slice of the training documents is a shard with a suffix
array of its own, sorted by words: all word positions, ordered by the words
that follow (never across a document's end).  Every test suffix is
binary-searched in it.  The array is sorted as deep as a search goes: a first
sort orders all suffixes by their leading words, and only intervals that some
test suffix enters are ordered further, down to the window's length.  What a
search ends with is the interval of all locations; matches that go on beyond
a window are joined along their diagonal into the longest verbatim match.

The test texts are few and are broadcast in blocks of at most
``BLOCK_WORDS`` words; each block sees all training documents.

Nulls, empty texts and texts without words have no hits (``n_words`` 0, not
contaminated).  Test rows without an id or without words are left out; rows
that repeat an id count as one item with several texts.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import seqhash
from .common import Scratch, out, slices, text_bytes

WINDOW_WORDS = 13
#: A document is contaminated if 20 * (words hit) >= words.
HIT_SHARE = 20
#: Test words broadcast at once.
BLOCK_WORDS = 2_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True

RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
                    ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("longest", pa.int64())])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of the first word of each text, and the end)."""
    low = _LOWER[data]
    inside = np.zeros(len(low) + 2, np.int8)
    inside[1:-1] = _IN_WORD[low]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = np.unique(offsets[1:-1])  # a text's end ends a word
    cuts = cuts[(cuts > 0) & (cuts < len(low))]
    if len(cuts):
        cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
        start, end = np.union1d(start, cuts), np.union1d(end, cuts)
    return seqhash.runs(seqhash.prefix(seqhash.BYTE[low]), start, end), np.searchsorted(start, offsets)


class TestSuffixes:
    """The windows of one block of test texts, as rows of word ids of the block's vocabulary."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str]], n: int = WINDOW_WORDS):
        self.n = n
        texts = pa.array([t for _, t in items], pa.string())
        hashes, first = words(*text_bytes(texts))
        self.vocab = np.unique(hashes)
        ids = np.searchsorted(self.vocab, hashes) + 1
        sizes = np.diff(first)
        starts = np.where(sizes > 0, np.maximum(1, sizes - n + 1), 0)  # an item of fewer words is one window, filled up with 0
        own = np.repeat(np.arange(len(items)), starts)
        begin = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(starts) - starts, starts)
        padded = np.append(ids, np.zeros(n, np.int64))
        table = np.lib.stride_tricks.sliding_window_view(padded, n)[begin] * (np.arange(n) < np.minimum(n, first[own + 1] - begin)[:, None])
        table = table.reshape(len(own), n)
        self.windows, back = np.unique(table, axis=0, return_inverse=True) if len(table) else (table, np.zeros(0, np.int64))
        self.sizes = (self.windows > 0).sum(1)
        names = sorted({str(k) for k, _ in items})
        at = {k: j for j, k in enumerate(names)}
        pairs = np.unique(np.array([(p, at[str(items[i][0])]) for p, i in zip(back.reshape(-1).tolist(), own.tolist(), strict=True)], np.int64).reshape(-1, 2), axis=0)
        self.names, self.item_of = names, pairs[:, 1]
        self.item_first = np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))
        #: next window along a text, if it is the same everywhere: for the longest match
        nxt = {}
        for a, b, i, j in zip(back.reshape(-1)[:-1].tolist(), back.reshape(-1)[1:].tolist(), own[:-1].tolist(), own[1:].tolist(), strict=True):
            if i == j:
                nxt.setdefault(int(a), set()).add(int(b))
        self.follow = np.array(sorted((a << 32) | b for a, bs in nxt.items() for b in bs), np.int64)

    def search(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) of every occurrence. ids: the shard's words; ends: where each one's document ends."""
        bits = int(len(self.vocab) + 1).bit_length()
        at = np.flatnonzero(ids)
        node = np.zeros(len(at), np.int64)  # the interval of the suffix array that a suffix is in
        mine = np.zeros(len(self.windows), np.int64)  # the one that a window's search is in
        live = np.arange(len(self.windows))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        depth, nodes = 0, 1
        while len(at) and len(live):
            take = max(1, min(self.n - depth, (62 - nodes.bit_length()) // bits))
            key, want, span = node.copy(), mine.copy(), np.ones(len(live), np.int64)
            for j in range(depth, depth + take):
                p = at + j
                inside = p < ends[at]
                key = (key << bits) | np.where(inside, ids[np.minimum(p, len(ids) - 1)], 0)
                word = self.windows[live, j]
                want = (want << bits) | word
                span = np.where(word > 0, 1, span << bits)  # a shorter window takes all that follows
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            lo, hi = np.searchsorted(key, want), np.searchsorted(key, want + span)
            depth += take
            done = (self.sizes[live] <= depth) & (hi > lo)
            for w, a, b in zip(live[done], lo[done], hi[done], strict=True):
                found.append((np.full(b - a, w), at[a:b]))
            go = (self.sizes[live] > depth) & (hi > lo)
            live, lo, hi, want = live[go], lo[go], hi[go], want[go]
            starts, first = np.unique(lo, return_index=True)
            mine, stops = np.searchsorted(starts, lo), hi[first]
            sizes = stops - starts
            rows = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum()) if len(sizes) else starts
            node = np.repeat(np.arange(len(starts)), sizes)
            at, nodes = at[rows], max(1, len(starts))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def longest(self, win: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each occurrence, the words of the verbatim match that ends there."""
        order = np.lexsort((win, at))
        win, at = win[order], at[order]
        sizes = np.zeros(len(win), np.int64)
        by: dict[int, list[tuple[int, int]]] = {}
        follow = set(self.follow.tolist())
        for i, (w, p) in enumerate(zip(win.tolist(), at.tolist(), strict=True)):
            got = int(self.sizes[w])
            for v, size in by.get(p - 1, ()):
                if (v << 32) | w in follow:
                    got = max(got, size + 1)
            by.setdefault(p, []).append((w, got))
            by.pop(p - 2, None)
            sizes[i] = got
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return sizes[back]


def scan(test: TestSuffixes, texts: pa.Array) -> list[tuple[int, np.ndarray, list[str], int]]:
    """For each text: words, covered runs (start, end, ...), items, longest match."""
    hashes, first = words(*text_bytes(texts))
    at = np.searchsorted(test.vocab, hashes)
    at[at == len(test.vocab)] = 0
    ids = np.where(test.vocab[at] == hashes, at + 1, 0) if len(test.vocab) else np.zeros(len(hashes), np.int64)
    counts = np.diff(first)
    ends = np.repeat(first[1:], counts)
    win, pos = test.search(ids, ends) if len(test.windows) else (ids[:0], ids[:0])
    res = [(int(c), np.zeros(0, np.int64), [], 0) for c in counts]
    if len(win):
        doc = np.searchsorted(first, pos, side="right") - 1
        # documents without words share a first word with the next one
        size = test.longest(win, pos)
        order = np.lexsort((pos, doc))
        win, pos, doc, size = win[order], pos[order], doc[order], size[order]
        for d in np.unique(doc).tolist():
            a, b = np.searchsorted(doc, d), np.searchsorted(doc, d, side="right")
            s = pos[a:b] - first[d]
            e = np.maximum.accumulate(s + test.sizes[win[a:b]])
            new = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
            spans = np.stack([s[new], np.r_[e[new[1:] - 1], e[-1]]], 1).reshape(-1)
            own = {test.names[i] for w in np.unique(win[a:b]).tolist() for i in test.item_of[test.item_first[w]:test.item_first[w + 1]].tolist()}
            res[d] = (int(counts[d]), spans, sorted(own), int(size[a:b].max()))
    return res


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, str]]]:
    """The test texts in blocks of about ``block_words`` words, one block at a time on the driver."""
    rows = benchmark.where("item_id is not null and text is not null").selectExpr("cast(item_id as string) as item_id", "text")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // (block_words * 2)))  # a word takes two characters at least
    for i in range(n):
        yield [(r[0], r[1]) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()]


def covered(spans: np.ndarray) -> int:
    got, end = 0, 0
    for s, e in sorted(zip(spans[::2].tolist(), spans[1::2].tolist(), strict=True)):
        got += max(0, e - max(s, end))
        end = max(end, e)
    return got


def _search(docs: DataFrame, benchmark: DataFrame, n: int, block_words: int, text_col: str, item_col: str, item_text_col: str):
    """``docs`` with the columns _spans, _items, _longest of all blocks but the last, and the last block."""
    spark = docs.sparkSession
    b = benchmark.selectExpr(f"`{item_col}` as item_id", f"cast(`{item_text_col}` as string) as text")
    df = docs.withColumns({"_spans": F.array().cast("array<long>"), "_items": F.array().cast("array<string>"), "_longest": F.lit(0).cast("long")})
    scratch, last = Scratch(spark, "decontaminate"), None
    for i, block in enumerate(_blocks(b, block_words)):  # one is built, sent and searched at a time; the last is left to the caller
        if last is not None:
            df = scratch.stage(df.mapInArrow(functools.partial(_add, last, docs.columns.index(text_col)), df.schema), f"block{i}")
            last.destroy()
        last = spark.sparkContext.broadcast(TestSuffixes(block, n))
    return df, last


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW_WORDS, share: int = HIT_SHARE,
                       block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: words, words hit, items with hits, their digest, the verdict and the longest match."""
    rows = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text")
    df, test = _search(rows, benchmark, n, block_words, "text", item_col, item_text_col)
    return df.mapInArrow(functools.partial(_verdict, test, share), "doc_id long, n_words long, n_hit long, n_items long, "
                         "items_sha256 string, contaminated boolean, longest long")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW_WORDS, share: int = HIT_SHARE,
                        block_words: int = BLOCK_WORDS, text_col: str = "text", item_col: str = "item_id",
                        item_text_col: str = "text") -> DataFrame:
    """``docs`` without its contaminated rows, all columns kept (no shuffle)."""
    df, test = _search(docs, benchmark, n, block_words, text_col, item_col, item_text_col)
    return df.mapInArrow(functools.partial(_clean, test, share, docs.columns.index(text_col)), docs.schema)


def _hits(test, b: pa.RecordBatch, text_at: int) -> list[tuple[int, np.ndarray, list[str], int]]:
    """What the block and the earlier ones (last three columns) find: words, covered runs, items, longest match."""
    got = scan(test.value, b.column(text_at).cast(pa.string()))
    spans, items, longest = (b.column(b.num_columns - i).to_pylist() for i in (3, 2, 1))
    return [(g[0], np.concatenate([np.array(s, np.int64), g[1]]) if s else g[1], sorted({*i, *g[2]}), max(x, g[3]))
            for g, s, i, x in zip(got, spans, items, longest, strict=True)]


def _add(test, text_at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, text_at):
        got = _hits(test, b, text_at)
        new = [pa.array([g[1].tolist() for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.list_(pa.string())),
               pa.array([g[3] for g in got], pa.int64())]
        yield pa.RecordBatch.from_arrays([*b.columns[:-3], *new], names=b.schema.names)


def _verdict(test, share: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        got = _hits(test, b, 1)
        hit = [covered(g[1]) for g in got]
        yield out(RESULT, doc_id=b.column(0), n_words=[g[0] for g in got], n_hit=hit, n_items=[len(g[2]) for g in got],
                  items_sha256=[hashlib.sha256(",".join(g[2]).encode()).hexdigest() for g in got],
                  contaminated=[h > 0 and share * h >= g[0] for h, g in zip(hit, got, strict=True)], longest=[g[3] for g in got])


def _clean(test, share: int, text_at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, text_at):
        keep = [not (0 < (h := covered(g[1])) and share * h >= g[0]) for g in _hits(test, b, text_at)]
        yield pa.RecordBatch.from_arrays(b.columns[:-3], names=b.schema.names[:-3]).filter(pa.array(keep))
