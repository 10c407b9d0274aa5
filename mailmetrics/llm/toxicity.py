"""Toxicity by noisy-channel deobfuscation.

1. A character language model (counts of letter trigrams inside words, all
   documents) is gathered: letters of a fixed alphabet, so at most 28^3 rows.
2. Words that look obfuscated are restored: look-alike characters
   (leetspeak), letters spaced or dotted apart, and letters repeated are a
   lattice of readings, and Viterbi decoding under the language model and a
   channel that charges every substitution and dropped repeat picks one.
   Every word that holds a look-alike and isn't a plain number (digits, with
   a sign or a currency) is decoded, of any length.  Three or more characters
   spaced or dotted apart are decoded as one word and as words (one may end
   and another begin at each of them), and once weights are known, every part
   of the run is looked up among the weighted words.  Other words stay as they
   are, in lower case.  Readings of one or two letters carry no feature.
3. The restored text is scored: the distinct words of a text and their
   prefixes (so that derived and inflected words count) carry weights, a lower
   confidence bound of the smoothed log odds of toxic against clean learning
   texts (copies count once); a logistic model of the sum, the best and
   the number of weights gives the probability.

Labels come only from rows that the caller marks for learning, from at most
``SAMPLE`` labelled documents (by a hash of the id); everything else covers
all documents.  Texts without words get the score of a text without any
weighted feature.  Documents labelled more than once are toxic if any label is
1.  Without both kinds of labels every score is the share of toxic labels
(0 if there is none).
"""

from __future__ import annotations

import functools
import math
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, out, slices

#: Labelled documents learned from, at most (about): the driver holds their ids, tasks their features.
SAMPLE = 40_000
PREFIXES = (4, 5)
#: A feature's weight is its log odds less so many standard errors; it is kept from LEAST_WEIGHT on.
SURE = 2.0
LEAST_WEIGHT = 1.0
#: Distinct words whose reading and features a task remembers.
CACHE_WORDS = 400_000

# Look-alikes of letters.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
              "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
EDGE = "^"

RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_restored", pa.int64())])

_WORD = regex.compile(r"[\p{L}\p{N}@$!|+(€£¡]+(?:['’\-_.*]\p{L}+)*")
_PLAIN = regex.compile(r"\p{L}+")
_SPACED = regex.compile(r"(?<![\p{L}\p{N}])(?:[\p{L}\p{N}@$!|+][.\-_*]){2,}[\p{L}\p{N}@$!|+](?![\p{L}\p{N}])")
_NUMBER = regex.compile(r"[+$€£|(]?\p{N}+[$€£+%]?")
_REPEAT = re.compile(r"(.)\1\1")
_OPEN, _CLOSE = ".,;:?\"'([{#%&*-–—«»„“”", ".,;:?\"')]}#%&*-–—«»„“”…!|+("
_TAIL = regex.compile(r"(?:([@$+(€£¡|!])\1+|[!|+(]+)$")


def fold(c: str) -> str:
    """A letter of the fixed alphabet, or none."""
    if c in ALPHABET:
        return c
    import unicodedata

    base = unicodedata.normalize("NFD", c)[0]
    return base if base in ALPHABET else ""


_fold = functools.lru_cache(maxsize=10_000)(fold)


class CharModel:
    """Trigram log probabilities over the alphabet and word edges, add-one smoothed."""

    def __init__(self, counts: dict[str, int]):
        self.at = {c: i for i, c in enumerate(ALPHABET + EDGE)}
        n = np.ones((len(self.at),) * 3)
        for t, k in counts.items():
            n[self.at[t[0]], self.at[t[1]], self.at[t[2]]] += k
        self.logp = np.log(n / n.sum(2, keepdims=True)).tolist()

    def restore(self, symbols: list[tuple[str, ...]], substitution: float = 1.0, drop: float = 0.5, words: bool = False) -> str:
        """Viterbi over a lattice: each place offers readings, the first is literal, '' drops the place.

        ``words``: a word may end before any place; the words of the reading are joined by a space.
        """
        at, logp = self.at, self.logp
        edge = at[EDGE]
        done: list[str] = []  # what all readings have in common
        states: dict[tuple[int, int], tuple[float, str]] = {(edge, edge): (0.0, "")}
        for place, readings in enumerate(symbols, 1):
            if words and place > 1:
                s, t = max((s + logp[p][q][edge], t) for (p, q), (s, t) in states.items())
                if (edge, edge) not in states or s > states[edge, edge][0]:
                    states[edge, edge] = (s, t + " ")
            new: dict[tuple[int, int], tuple[float, str]] = {}
            for (p, q), (score, text) in states.items():
                for i, r in enumerate(readings):
                    if r == "":
                        key, s, t = (p, q), score - drop, text
                    else:
                        c = at[r]
                        key, s, t = (q, c), score + logp[p][q][c] - (substitution if i else 0.0), text + r
                    if key not in new or s > new[key][0]:
                        new[key] = (s, t)
            states = new
            if place % 64 == 0:
                common = os.path.commonprefix([t for _, t in states.values()])
                done.append(common)
                states = {k: (s, t[len(common):]) for k, (s, t) in states.items()}
        done.append(max(((s + logp[p][q][edge], t) for (p, q), (s, t) in states.items()), default=(0.0, ""))[1])
        return "".join(done)


def lattice(word: str) -> list[tuple[str, ...]]:
    places: list[tuple[str, ...]] = []
    last = ""
    for c in word:
        if c in " .-_*'’":
            continue
        letter = _fold(c)
        readings = (letter,) if letter else tuple(LOOKALIKES.get(c, ""))
        if readings and c == last:
            readings = (*readings, "")  # a repeat may be dropped
        if readings:
            places.append(readings)
        last = c
    return places


def suspicious(word: str) -> bool:
    """Holds a look-alike and isn't a plain number, or repeats a letter three times."""
    if _PLAIN.fullmatch(word):
        return _REPEAT.search(word) is not None
    return any(c in LOOKALIKES for c in word) and _NUMBER.fullmatch(word) is None


class Reader:
    """Texts to the distinct features of their restored words (``known``: only those)."""

    def __init__(self, model: CharModel, known: dict[str, float] | None = None):
        self.model, self.known = model, known
        self.cache: dict[str, tuple[tuple[str, ...], int]] = {}
        self.starts: set[str] | None = None  # beginnings of known features

    def token(self, token: str) -> tuple[tuple[str, ...], int]:
        """Features of the words of a token (no white space inside), and how many were restored."""
        plain = token.lstrip(_OPEN).rstrip(_CLOSE)
        if plain.isalpha() and _REPEAT.search(plain) is None:
            found = self.features(plain)
            return (found if self.known is None else tuple([f for f in found if f in self.known])), 0
        found, restored = [], 0
        rest = token
        for s in _SPACED.findall(token):
            words, n = self.apart(s)
            found += words
            rest, restored = rest.replace(s, " "), restored + n
        for w in _WORD.findall(rest):
            bare = _TAIL.sub("", w)
            if bare and suspicious(bare):
                found += self.features(self.model.restore(lattice(bare)))
                restored += 1
            else:
                found += self.features("".join(c for c in bare if c.isalpha()))
        return tuple(found if self.known is None else [f for f in found if f in self.known]), restored

    @staticmethod
    def features(w: str) -> tuple[str, ...]:
        if len(w) < 3:
            return ()
        return (w, *[w[:n] + "*" for n in PREFIXES if len(w) > n])

    def apart(self, run: str) -> tuple[list[str], int]:
        """Features of characters spaced or dotted apart (as one word, as words, and known ones of any part), and whether there is a reading."""
        places = lattice(run)
        if len(places) < 3:
            return [], 0
        found = {f for words in (False, True) for w in self.model.restore(places, words=words).split() for f in self.features(w)}
        return [*found, *self.parts(places)], 1

    def parts(self, places: list[tuple[str, ...]]) -> set[str]:
        """Known features that some reading of some part of the places has."""
        if not self.known:
            return set()
        if self.starts is None:
            self.starts = {w[:i] for w in (f.rstrip("*") for f in self.known) for i in range(len(w) + 1)}
        found = set()
        for first in range(len(places)):
            partial = {""}
            for readings in places[first:]:
                letters = [r for r in readings if r]
                found.update(f for p in partial if (f := p + "*") in self.known)  # a letter follows
                longer = {p + r for p in partial for r in letters if p + r in self.starts}
                found.update(p for p in longer if p in self.known)
                partial = longer | partial - {""} if "" in readings else longer
                if not partial:
                    break
        return found

    def read(self, text: str) -> tuple[set[str], int]:
        """(features, distinct readings restored)."""
        tokens = text.lower().split()
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        feats: set[str] = set()
        restored = 0
        for w in set(tokens):
            got = cache.get(w)
            if got is None:
                got = cache[w] = self.token(w)
            if got[0]:
                feats.update(got[0])
            restored += got[1]
        # letters spaced apart: three or more tokens of one character in a row
        sizes = bytes([1 if n == 1 else 0 for n in map(len, tokens)])
        at = sizes.find(b"\1\1\1")
        while at >= 0:
            end = sizes.find(b"\0", at)
            end = len(sizes) if end < 0 else end
            found, n = self.apart("".join(tokens[at:end]))
            feats.update(f for f in found if self.known is None or f in self.known)
            restored += n
            at = sizes.find(b"\1\1\1", end)
        return feats, restored


def char_counts(texts: DataFrame) -> dict[str, int]:
    """Trigrams of folded letters inside words, over all texts: at most 27^3 rows come back."""
    schema = pa.schema([("t", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(ALPHABET) + 1
        total = np.zeros(size**3, np.int64)
        for b in slices(batches):
            text = " ".join(x for x in b.column(0).to_pylist() if x)
            codes = np.frombuffer(("  " + text + "  ").encode("utf-32-le"), np.uint32)
            x = _letters()[np.minimum(codes, 0x17F)]
            edge = x == size - 1
            keep = np.ones(len(x), bool)
            keep[2:] = ~(edge[2:] & edge[1:-1] & edge[:-2])  # at most two edges between words
            x = x[keep]
            y = (x[:-2] * size + x[1:-1]) * size + x[2:]
            total += np.bincount(y, minlength=size**3)
        at = np.flatnonzero(total)
        letters = ALPHABET + EDGE
        yield out(schema, t=[letters[i // size // size] + letters[i // size % size] + letters[i % size] for i in at.tolist()], n=total[at])

    rows = texts.mapInArrow(run, "t string, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()
    return {r.t: r.n for r in rows}


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([(ALPHABET.index(f) if (f := fold(chr(i).lower()[0])) else len(ALPHABET)) for i in range(0x180)], np.int64)


class Scorer:
    def __init__(self, model: CharModel, weights: dict[str, float], coef: np.ndarray, base: float | None):
        self.model, self.weights, self.coef, self.base = model, weights, coef, base

    def inputs(self, feats: set[str]) -> list[float]:
        got = [self.weights[f] for f in feats & self.weights.keys()]
        up = [g for g in got if g > 0]
        return [1.0, sum(got), max(up, default=0.0), math.log1p(len(up))]

    def score(self, feats: set[str]) -> float:
        if self.base is not None:
            return self.base
        z = float(np.dot(self.coef, self.inputs(feats)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps with a small ridge (the inputs are four numbers a row)."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> Scorer:
    """``learn``: a Column over the documents' id; labels of other rows are never read."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = CharModel(char_counts(texts.select("text")))
    marked = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    marked = marked.where("doc_id is not null").where(learn)
    # copies are one example, with the label that most of them have
    same = texts.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    marked = marked.join(same, "doc_id").groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.round(F.avg("toxic")).cast("int").alias("toxic"))
    marked = Scratch(spark, "toxicity").stage(marked, "marked")
    n, positive = marked.agg(F.count("*"), F.sum("toxic")).first()
    if not n or not positive or positive == n:
        return Scorer(model, {}, np.zeros(4), float(positive or 0) / n if n else 0.0)
    spread = 1_000_000
    share = min(spread, round(spread * sample / n))
    chosen = {r.doc_id: r.toxic for r in marked.where(F.pmod(F.xxhash64("h"), F.lit(spread)) < share).collect()}
    shared = spark.sparkContext.broadcast((model, chosen))
    total = np.array([sum(1 for v in chosen.values() if not v), sum(chosen.values())], float)

    def rows_of(batches: Iterator[pa.RecordBatch], known: dict[str, float] | None = None):
        model, chosen = shared.value
        reader = Reader(model, known)
        for b in slices(batches):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i in chosen:
                    yield i, chosen[i], reader.read(t or "")[0]

    counted = pa.schema([("f", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[Counter] = [Counter(), Counter()]
        for _, y, feats in rows_of(batches):
            seen[y].update(feats)
            if len(seen[0]) + len(seen[1]) > 500_000:
                yield out(counted, f=[*seen[0], *seen[1]], clean=[*seen[0].values(), *[0] * len(seen[1])], toxic=[*[0] * len(seen[0]), *seen[1].values()])
                seen = [Counter(), Counter()]
        yield out(counted, f=[*seen[0], *seen[1]], clean=[*seen[0].values(), *[0] * len(seen[1])], toxic=[*[0] * len(seen[0]), *seen[1].values()])

    table = texts.mapInArrow(count, "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # smoothed log odds, less SURE standard errors: weights beyond chance only
    c, t = F.col("clean") + 0.5, F.col("toxic") + 0.5
    w = F.log(t / (float(total[1]) - F.col("toxic") + 0.5)) - F.log(c / (float(total[0]) - F.col("clean") + 0.5))
    low = w - SURE * F.sqrt(1 / t + 1 / c)
    # as many as the sampled rows have features with a weight; no more documents make no more of them
    kept = table.select("f", low.alias("w")).where(F.col("w") >= LEAST_WEIGHT).collect()
    weights = {r.f: r.w for r in kept}
    first = Scorer(model, weights, np.zeros(4), None)
    weighed = spark.sparkContext.broadcast(first)
    sums = pa.schema([("y", pa.int32()), ("x", pa.list_(pa.float64()))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(y, weighed.value.inputs(feats)) for _, y, feats in rows_of(batches, weighed.value.weights)]
        yield out(sums, y=[g[0] for g in got], x=[g[1] for g in got])

    rows = texts.mapInArrow(measure, "y int, x array<double>").collect()  # four numbers a sampled row
    x, y = np.array([r.x for r in rows]).reshape(len(rows), 4), np.array([r.y for r in rows], float)
    if not len(rows) or y.min() == y.max():
        return Scorer(model, weights, np.zeros(4), float(total[1] / total.sum()))
    return Scorer(model, weights, logistic(x, y), None)


def predict(docs: DataFrame, scorer: Scorer, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value.model, shared.value.weights)
        for b in slices(batches):
            got = [reader.read(t or "") for t in b.column(2).to_pylist()]
            score = [shared.value.score(f) for f, _ in got]
            yield out(RESULT, doc_id=b.column(0), held_out=b.column(1), score=score, predicted=[int(s >= 0.5) for s in score],
                      n_restored=[n for _, n in got])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_restored long")
