"""Two tokenizers' tokens side by side: alignment of one text under both.

Within a text, groups are what lies between byte offsets where tokens of both
end.  A space between two characters that are no white space is such an offset
for a byte-level BPE whose words begin with at most one space and a BPE whose
pieces hold a space only in front, so a text is cut there into parts, and the
groups of a part depend on the part alone: parts met again are remembered.
All parts not met before are tokenized and aligned at once, over arrays.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain

import numpy as np

from .bpe import byte_letters

#: A place where both tokenizers' tokens end whatever stands around it (before the space).
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Parts that a worker remembers (bounds memory only; the parts of one slice always fit).
CACHE_PARTS = 400_000
#: Parts that are tokenized in one call (a call's time grows faster than its text).
JOINED = 500
#: Links of a group beyond which equal ids are counted before pairs are built.
WIDE = 1 << 16


def _starts(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def _spread(starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every entry of the chosen rows of a list column with these offsets."""
    sizes = starts[which + 1] - starts[which]
    row = np.repeat(np.arange(len(which)), sizes)
    return row, np.arange(len(row)) + np.repeat(starts[which] - _starts(sizes)[:-1], sizes)


def _sum_equal(keys: np.ndarray, amounts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, amounts = keys[order], amounts[order]
    heads = np.flatnonzero(np.diff(keys, prepend=-1)) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(amounts, heads) if len(heads) else amounts


class Parts:
    """What is known of parts: columns n_a, n_b, n_groups, n_links, good; lists of (pair, times); the groups as text."""

    def __init__(self):
        self.stats, self.good = np.zeros((0, 4), np.int64), np.zeros(0, bool)
        self.starts, self.pairs, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.texts: list[str] = []

    def add(self, other: Parts) -> None:
        self.stats, self.good = np.concatenate([self.stats, other.stats]), np.concatenate([self.good, other.good])
        self.starts = np.concatenate([self.starts, other.starts[1:] + self.starts[-1]])
        self.pairs, self.times = np.concatenate([self.pairs, other.pairs]), np.concatenate([self.times, other.times])
        self.texts += other.texts

    def only(self, which: np.ndarray) -> Parts:
        new, (_, at) = Parts(), _spread(self.starts, which)
        new.stats, new.good, new.texts = self.stats[which], self.good[which], [self.texts[i] for i in which]
        new.starts, new.pairs, new.times = _starts(self.starts[which + 1] - self.starts[which]), self.pairs[at], self.times[at]
        return new


class TokenAligner:
    """Tokenizer A encodes space + text, B encodes the text and adds the space itself."""

    def __init__(self, vocab_json: str, piece_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(vocab_json)
        self.a.encode_special_tokens = True  # their strings in a text are text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        letters = byte_letters()
        spec = json.loads(vocab_json)
        vocab = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        vocab |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.a_bytes = [vocab.get(i, b"") for i in range(max(vocab) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece holds a space behind another character; texts can't be cut at spaces")
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        self.many = len(pieces)
        #: Decimal ids as text, followed by what stands behind a token inside or at the end of its side of a group.
        self.a_text = [np.array([f"{i}{c}" for i in range(len(self.a_bytes))], object) for c in ",|"]
        self.b_text = [np.array([f"{i}{c}" for i in range(self.many)], object) for c in ",;"]
        self.known, self.ids, self.uses = Parts(), {}, np.zeros(0, np.int64)

    # -- parts -------------------------------------------------------------

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, ...]:
        """(tokens of A and of B per part, ids of A, ids of B, whether both spell the part); a part they don't spell has none."""
        raw = [(" " + p).encode() for p in parts]
        found = self._encode_joined(parts, raw)
        if found is not None:
            return found
        a = [e.ids for e in self.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]
        b = self.b.encode(parts, num_threads=1)
        ga, gb = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        good = np.array([b"".join(map(ga, x)) == r and b"".join(map(gb, y)) == r for x, y, r in zip(a, b, raw, strict=True)], bool)
        a, b = ([x if g else [] for x, g in zip(side, good, strict=True)] for side in (a, b))
        na, nb = (np.array([len(x) for x in side], np.int64) for side in (a, b))
        return na, nb, *(np.fromiter(chain.from_iterable(side), np.int64) for side in (a, b)), good

    def _encode_joined(self, parts: list[str], raw: list[bytes]) -> tuple[np.ndarray, ...] | None:
        """The same for parts that can follow each other in one text (cuts again stand between them); None if they don't come out as they went in."""
        lines = [" ".join(parts[i:i + JOINED]) for i in range(0, len(parts), JOINED)]
        if CUT.split(" ".join(parts)) != parts:
            return None
        a = list(chain.from_iterable(e.ids for e in self.a.encode_batch_fast([" " + x for x in lines], add_special_tokens=False)))
        b = list(chain.from_iterable(self.b.encode(lines, num_threads=1)))
        whole = b"".join(raw)
        if b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return None
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        ends = np.cumsum([len(r) for r in raw])
        last_a, last_b = (np.searchsorted(np.cumsum(size[ids]), ends) + 1 for size, ids in ((self.a_size, ids_a), (self.b_size, ids_b)))
        return np.diff(last_a, prepend=0), np.diff(last_b, prepend=0), ids_a, ids_b, np.ones(len(parts), bool)

    def align(self, parts: list[str]) -> Parts:
        """Tokens, groups and links of every part (the text behind its space)."""
        found = Parts()
        na, nb, ids_a, ids_b, found.good = self._encode(parts)
        end_a, end_b = np.cumsum(self.a_size[ids_a]), np.cumsum(self.b_size[ids_b])
        # each part ends a token of both, so the parts can follow each other in one stream
        closes_a, closes_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
        group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        groups = int(closes_a.sum())
        in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        first_a, first_b = _starts(in_a), _starts(in_b)
        part_of = np.repeat(np.arange(len(parts)), na)[first_a[:-1]]
        n_groups = np.bincount(part_of, minlength=len(parts))
        n_links = np.zeros(len(parts), np.int64)
        np.add.at(n_links, part_of, in_a * in_b)
        found.stats = np.stack([na, nb, n_groups, n_links], axis=1)
        # the groups as text: a group's A tokens, then its B tokens
        texts = np.empty(len(ids_a) + len(ids_b), object)
        texts[np.arange(len(ids_a)) + first_b[group_a]] = np.where(closes_a, self.a_text[1][ids_a], self.a_text[0][ids_a])
        texts[np.arange(len(ids_b)) + first_a[group_b + 1]] = np.where(closes_b, self.b_text[1][ids_b], self.b_text[0][ids_b])
        texts, ends = texts.tolist(), np.cumsum(na + nb).tolist()
        found.texts = ["".join(texts[i:j])[:-1] for i, j in zip([0, *ends], ends)]
        # links, as (part, A id * pieces + B id) with their number
        wide = in_a * in_b > WIDE
        near = np.flatnonzero(~wide[group_a])
        row, at = _spread(first_b, group_a[near])
        keys, times = [(part_of[group_a[near]][row] << 40) | (ids_a[near][row] * self.many + ids_b[at])], [np.ones(len(row), np.int64)]
        for g in np.flatnonzero(wide):
            x, p = np.unique(ids_a[first_a[g]:first_a[g + 1]], return_counts=True)
            y, q = np.unique(ids_b[first_b[g]:first_b[g + 1]], return_counts=True)
            keys.append((int(part_of[g]) << 40) | (x[:, None] * self.many + y).ravel())
            times.append((p[:, None] * q).ravel())
        key, found.times = _sum_equal(np.concatenate(keys), np.concatenate(times))
        found.starts = _starts(np.bincount(key >> 40, minlength=len(parts)))
        found.pairs = key & ((1 << 40) - 1)
        return found

    def _learn(self, words: set[str]) -> None:
        new = words.difference(self.ids)
        if len(self.ids) + len(new) > CACHE_PARTS and self.ids:
            # parts that came back stay, the most used ones up to half the room
            keep = np.flatnonzero(self.uses > 1)
            keep = np.sort(keep[np.argsort(-self.uses[keep], kind="stable")[:CACHE_PARTS // 2]])
            names = list(self.ids)
            self.known, self.uses = self.known.only(keep), np.ones(len(keep), np.int64)
            self.ids = {names[i]: k for k, i in enumerate(keep.tolist())}
            new = words.difference(self.ids)
        if new:
            plain = [w for w in new if not (w[0].isspace() or w[-1].isspace() or "▁" in w)]
            other = list(new.difference(plain))
            for some in (plain, other):
                if some:
                    self.known.add(self.align(some))
            self.ids.update(zip(plain + other, range(len(self.ids), len(self.ids) + len(new))))
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])

    # -- texts -------------------------------------------------------------

    def texts(self, texts: list[str]) -> dict:
        """Per text (each behind one space): good, stats, groups as text, (starts, pairs, times)."""
        cut = [CUT.split(t) if t else [] for t in texts]
        self._learn(set().union(*cut))
        known = self.known
        listed = list(map(self.ids.__getitem__, chain.from_iterable(cut)))
        ids = np.array(listed, np.int64)
        sizes = np.array([len(c) for c in cut], np.int64)
        text = np.repeat(np.arange(len(texts)), sizes)
        good = np.ones(len(texts), bool)
        good[text[~known.good[ids]]] = False
        both, times = np.unique((text << 32) | ids, return_counts=True)
        np.add.at(self.uses, both & 0xFFFFFFFF, times)
        stats = np.zeros((len(texts), 4), np.int64)
        np.add.at(stats, both >> 32, known.stats[both & 0xFFFFFFFF] * times[:, None])
        stats[~good] = 0
        both, times = both[good[both >> 32]], times[good[both >> 32]]
        row, at = _spread(known.starts, both & 0xFFFFFFFF)
        # (text, pair) as one number: pairs stay below the product of the vocabularies
        base = len(self.a_bytes) * self.many
        key, amount = _sum_equal((both >> 32)[row] * base + known.pairs[at], known.times[at] * times[row])
        starts = _starts(np.bincount(key // base, minlength=len(texts)))
        named, ends = list(map(known.texts.__getitem__, listed)), np.cumsum(sizes).tolist()
        names = [";".join(named[i:j]) if g else "" for i, j, g in zip([0, *ends], ends, good.tolist())]
        return {"good": good, "stats": stats, "groups": names, "starts": starts, "pairs": key % base, "times": amount}

    def forget(self) -> None:
        self.known, self.ids, self.uses = Parts(), {}, np.zeros(0, np.int64)


# -- fragments -------------------------------------------------------------


class Fragment:
    """A stretch of a text's bytes: what stands before its first cut (open), what stands between its first
    and last cut (closed) and what stands behind its last cut (open).  Without a cut all of it is ``prefix``.

    Only the open ends are kept; closed stretches are handed to ``closed`` as soon as they are known.
    The value depends on the bytes alone, so ``join`` is associative.
    """

    __slots__ = ("prefix", "suffix")

    def __init__(self, prefix: bytes, suffix: bytes | None = None):
        self.prefix, self.suffix = prefix, suffix  # suffix None: no cut

    @classmethod
    def of(cls, raw: bytes) -> tuple[Fragment, bytes]:
        """(fragment, its closed stretch)."""
        low = next((i for i in range(min(4, len(raw))) if raw[i] & 0xC0 != 0x80), len(raw))
        text = raw[low:].decode("utf-8", "ignore") if raw[low:].isascii() else raw[low:_whole(raw)].decode()
        cuts = [m.start() for m in CUT.finditer(text)]
        if not cuts:
            return cls(raw), b""
        if text.isascii():
            first, last = low + cuts[0], low + cuts[-1]
        else:
            first, last = low + len(text[:cuts[0]].encode()), low + len(text[:cuts[-1]].encode())
        return cls(raw[:first], raw[last:]), raw[first:last]

    def join(self, right: Fragment) -> tuple[Fragment, bytes]:
        """(this and ``right`` as one fragment, what their seam closes)."""
        if self.suffix is not None and right.suffix is not None:
            return Fragment(self.prefix, right.suffix), self.suffix + right.prefix
        if self.suffix is None and right.suffix is None:
            return Fragment.of(self.prefix + right.prefix)
        if self.suffix is None:
            seam, closed = Fragment.of(self.prefix + right.prefix)
            if seam.suffix is None:
                return Fragment(seam.prefix, right.suffix), b""
            return Fragment(seam.prefix, right.suffix), closed + seam.suffix
        seam, closed = Fragment.of(self.suffix + right.prefix)
        if seam.suffix is None:
            return Fragment(self.prefix, seam.prefix), b""
        return Fragment(self.prefix, seam.suffix), seam.prefix + closed


def _whole(raw: bytes) -> int:
    """Length without an unfinished last character."""
    for back in range(1, min(4, len(raw)) + 1):
        x = raw[-back]
        if x & 0xC0 != 0x80:
            size = 1 if x < 0x80 else 2 if x < 0xE0 else 3 if x < 0xF0 else 4
            return len(raw) if size <= back else len(raw) - back
    return len(raw)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
