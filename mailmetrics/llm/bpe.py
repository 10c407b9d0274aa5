"""BPE encoding and decoding by speculate and verify.

A text is cut into words by the vocabulary's pre-tokenizer pattern.  For
every distinct word of a slice the greedy longest match proposes tokens.  A
sequence is the BPE encoding of its bytes exactly when every adjacent pair of
its tokens is the encoding of the pair's bytes, so all pairs of all proposed
words are tested at once against a sorted table of judged pairs; a pair not
seen before is judged by merging its bytes.  Only words with a failing pair
are merged exactly.

Nulls count as empty; an empty text has no tokens and decodes to the empty
text.  Strings of special tokens in a text become their ids, as the
tokenizers library does by default, and come back when decoded.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import out, slices

# Fixed value: the byte-level pre-tokenizer's pattern of the vocabulary file.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Distinct words of a generation that a task remembers (bounds memory only; a slice's words always fit).
CACHE_WORDS = 500_000
#: Judged pairs that a worker remembers from task to task (bounds memory only).
CACHE_PAIRS = 2_000_000

RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()),
                    ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
TOKENS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def byte_letters() -> dict[str, int]:
    """Letter -> byte of the byte-level alphabet: printable bytes stand for themselves,
    the others take the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class SpeculativeBpe:
    def __init__(self, vocab_json: str):
        spec = json.loads(vocab_json)
        model = spec["model"]
        letters = byte_letters()
        raw = {t: bytes(letters[c] for c in t) for t in model["vocab"]}
        self.ids = {raw[t]: i for t, i in model["vocab"].items()}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.decimal = {i: str(i) for i in self.bytes_of}
        #: Every prefix of a token -> its id if it is a token itself, else -1.
        self.prefixes: dict[bytes, int] = {}
        for b, i in self.ids.items():
            for n in range(1, len(b)):
                self.prefixes.setdefault(b[:n], -1)
            self.prefixes[b] = i
        #: Pair of ids as one number -> rank; the token that each rank makes.
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            a, b = bytes(letters[c] for c in a), bytes(letters[c] for c in b)
            self.rank[(self.ids[a] << 20) | self.ids[b]] = r
            self.made.append(self.ids[a + b])
        self.byte_id = [self.ids[bytes([b])] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(WORD_PATTERN)
        self.good = np.zeros(0, np.int64)  # judged pairs, sorted codes
        self.bad = np.zeros(0, np.int64)
        #: Remembered words: their ids as text and their tokens' bytes; and the generation before.
        self.text_ids: dict[str, str] = {}
        self.text_bytes: dict[str, bytes] = {}
        self.older: tuple[dict[str, str], dict[str, bytes]] = ({}, {})

    # -- the three steps -------------------------------------------------

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        get, found, i, n = self.prefixes.get, [], 0, len(word)
        while i < n:
            j = i + 1
            t = get(word[i:j])
            end = j
            while j < n:
                j += 1
                more = get(word[i:j])
                if more is None:
                    break
                if more >= 0:
                    t, end = more, j
            found.append(t)
            i = end
        return found

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the lowest rank first, leftmost among equals."""
        byte_id = self.byte_id
        sym = [byte_id[b] for b in word]
        if len(sym) > 64:
            return self._merge_long(sym)
        get, made, never = self.rank.get, self.made, len(self.made)
        ranks = [get((a << 20) | b, never) for a, b in zip(sym, sym[1:])]
        while ranks:
            r = min(ranks)
            if r == never:
                break
            i = ranks.index(r)
            t = made[r]
            sym[i:i + 2] = [t]
            del ranks[i]
            if i:
                ranks[i - 1] = get((sym[i - 1] << 20) | t, never)
            if i < len(ranks):
                ranks[i] = get((t << 20) | sym[i + 1], never)
        return sym

    def _merge_long(self, sym: list[int]) -> list[int]:
        """The same with a heap over a linked list."""
        n = len(sym)
        prev, nxt, rank, made = [*range(-1, n - 1)], [*range(1, n), -1], self.rank, self.made
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := rank.get((sym[i] << 20) | sym[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            new = made[r]
            sym[i], sym[j], nxt[i] = new, -1, nxt[j]
            if nxt[i] >= 0:
                prev[nxt[i]] = i
                if (r := rank.get((new << 20) | sym[nxt[i]])) is not None:
                    heapq.heappush(heap, (r, i, new, sym[nxt[i]]))
            if prev[i] >= 0 and (r := rank.get((sym[prev[i]] << 20) | new)) is not None:
                heapq.heappush(heap, (r, prev[i], sym[prev[i]], new))
        return [t for t in sym if t >= 0]

    def judge(self, codes: np.ndarray) -> np.ndarray:
        """Which pair codes (left * 2^20 + right) are compatible; unseen ones are judged by merging."""
        new = codes[~(_within(codes, self.good) | _within(codes, self.bad))]
        if len(new):
            ok = np.array([self.merge(self.bytes_of[c >> 20] + self.bytes_of[c & 0xFFFFF]) == [c >> 20, c & 0xFFFFF]
                           for c in new.tolist()])
            self.good = np.union1d(self.good, new[ok])
            self.bad = np.union1d(self.bad, new[~ok])
        return _within(codes, self.good)

    def forget(self) -> None:
        """Drop what a task's words left behind (workers are reused)."""
        self.text_ids, self.text_bytes, self.older = {}, {}, ({}, {})
        if len(self.good) + len(self.bad) > CACHE_PAIRS:
            self.good = self.bad = np.zeros(0, np.int64)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        raw = [w.encode() for w in words]
        got = [self.propose(w) for w in raw]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((t for x in got for t in x), np.int64, int(sizes.sum()))
        own = np.repeat(np.arange(len(got)), sizes)
        left = np.flatnonzero(own[:-1] == own[1:]) if len(own) else own
        codes = (flat[left] << 20) | flat[left + 1] if len(left) else left
        pairs, back = np.unique(codes, return_inverse=True)
        failing = np.unique(own[left[~self.judge(pairs)[back]]]) if len(left) else []
        # a token that is not the encoding of its own bytes fails too
        single = np.unique(flat)
        odd = single[[self.whole(t) is False for t in single.tolist()]] if len(single) else single
        if len(odd):
            failing = np.union1d(failing, own[np.isin(flat, odd)])
        for i in np.asarray(failing, np.int64).tolist():
            got[i] = self.merge(raw[i])
        return got

    @functools.lru_cache(maxsize=None)  # noqa: B019  at most one entry a vocabulary id
    def whole(self, t: int) -> bool:
        return self.merge(self.bytes_of[t]) == [t]

    # -- texts -----------------------------------------------------------

    def parts(self, text: str) -> list[str]:
        """The words of a text; a special token's string is a part of its own."""
        if self.special_split is None or not any(s in text for s in self.special):
            return self.words.findall(text)
        found = []
        for x in self.special_split.split(text):
            found += [x] if x in self.special else self.words.findall(x)
        return found

    def learn(self, texts: list[list[str]]) -> None:
        """Encode the words of a slice that are not remembered yet.

        What is remembered has two generations; when the younger one is full,
        it becomes the older one, and only words met again come back from it.
        """
        words = set().union(*texts)
        if len(self.text_ids) + len(words) > CACHE_WORDS:
            self.older = self.text_ids, self.text_bytes
            self.text_ids, self.text_bytes = {}, {}
        ids_of, bytes_of, (old_ids, old_bytes) = self.text_ids, self.text_bytes, self.older
        for s, i in self.special.items():
            ids_of[s], bytes_of[s] = str(i), s.encode()
        words.difference_update(ids_of)
        again = words.intersection(old_ids)
        for w in again:
            ids_of[w], bytes_of[w] = old_ids[w], old_bytes[w]
        words.difference_update(again)
        new, decimal, raw = list(words), self.decimal, self.bytes_of
        for w, ids in zip(new, self.encode_words(new), strict=True):
            ids_of[w] = ",".join([decimal[i] for i in ids])
            bytes_of[w] = b"".join([raw[i] for i in ids])

    def digest(self, parts: list[str]) -> tuple[int, str, str]:
        """(tokens, SHA-256 of the decimal ids, SHA-256 of the decoded bytes)."""
        ids = ",".join(map(self.text_ids.__getitem__, parts))
        text = b"".join(map(self.text_bytes.__getitem__, parts)).decode("utf-8", "replace")
        return (ids.count(",") + 1 if parts else 0, hashlib.sha256(ids.encode()).hexdigest(),
                hashlib.sha256(text.encode()).hexdigest())

    def encode(self, text: str) -> list[int]:
        parts = self.parts(text)
        self.learn([parts])
        return [int(t) for w in parts for t in self.text_ids[w].split(",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


def _within(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(codes), bool)
    at = np.searchsorted(table, codes)
    at[at == len(table)] = 0
    return table[at] == codes


@functools.lru_cache(maxsize=2)
def _codec(vocab_json: str) -> SpeculativeBpe:
    return SpeculativeBpe(vocab_json)


def encode_documents(docs: DataFrame, vocab_path: str, digests: bool = True,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: token count and digests, or (``digests=False``) the ids.

    ``vocab_path``: the vocabulary file (tokenizers JSON, byte-level BPE), read
    on the driver (its size does not depend on the data).
    """
    with open(vocab_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec.value)
        try:
            yield from encode(codec, batches)
        finally:
            codec.forget()

    def encode(codec: SpeculativeBpe, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            parts = [codec.parts(t or "") for t in b.column(1).to_pylist()]
            codec.learn(parts)
            if digests:
                got = [codec.digest(p) for p in parts]
                yield out(RESULT, doc_id=b.column(0), n_tokens=[g[0] for g in got],
                          ids_sha256=[g[1] for g in got], decoded_sha256=[g[2] for g in got])
            else:
                ids = [[int(t) for w in p for t in codec.text_ids[w].split(",")] for p in parts]
                yield out(TOKENS, doc_id=b.column(0), ids=ids)

    rows = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text")
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>"
    return rows.mapInArrow(run, kind)


def decode_documents(tokens: DataFrame, vocab_path: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text); null ids: null text."""
    with open(vocab_path, encoding="utf-8") as f:
        spec = tokens.sparkSession.sparkContext.broadcast(f.read())
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec.value)
        for b in batches:
            yield out(schema, doc_id=b.column(0), text=[None if x is None else codec.decode(x) for x in b.column(1).to_pylist()])

    return tokens.selectExpr("cast(doc_id as long) as doc_id", "ids").mapInArrow(run, "doc_id long, text string")
