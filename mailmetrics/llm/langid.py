"""Language ID by nearest centroid over TF-IDF vectors of character n-grams.

A text becomes the counts of its hashed byte 1-, 2- and 3-grams (A-Z
lower-cased, every run of ASCII non-letters one space), damped as
log(1 + count), weighted by inverse document frequency and normalised.  The
document frequencies are counted over all documents learned from.  Every
language has several centroids, found by k-means under the cosine on at most
``SAMPLE`` of its documents (chosen by a hash of the id).  A text gets the
language of the nearest centroid; ``score`` is their cosine (0 to 1).

Rejection by distance: a text is rejected if it has no letter, or if its cosine
is below ``REJECT`` times the cosine that all but the share ``LOW`` of the
nearest centroid's members reach; for a text of fewer than ``SHORT`` letters,
whose few n-grams say less, below that part of it that its letters are of
``SHORT``.  Outliers among the sample don't become centroids: those with less
than the share ``SMALL`` of the members are left out.  ``lang_pred`` of a text without letters, and of a null
text, is ``und`` (score 0); other texts always get a learned language, with
``rejected`` beside it.

Null languages are never learned.  If nothing can be learned, every text is
``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import out, slices, text_bytes

DIMS = 1 << 13
#: Documents of a language that its centroids are fitted on, at most (about).
SAMPLE = 1000
CENTROIDS = 4
REJECT = 0.25
#: Share of a centroid's members whose cosines don't count for the distance (junk among them can't set it).
LOW = 0.01
#: Share of the members below which a centroid is an outlier's.
SMALL = 0.02
#: Letters below which a text may be further away.
SHORT = 20
#: Rows whose dense vectors are held at once.
ROWS = 128
UNKNOWN = "und"

RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()),
                    ("score", pa.float64()), ("rejected", pa.bool_())])
FLAGS = pa.schema([("row", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_LETTER = regex.compile(r"\p{L}")


def counts(texts: pa.Array) -> np.ndarray:
    """(rows, DIMS) counts of hashed n-grams."""
    data, offsets = text_bytes(texts)
    low = _FOLD[data]
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    row = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(offsets))
    low, row = low[keep].astype(np.uint32), row[keep]
    got = np.zeros(len(texts) * DIMS, np.float32)
    code = np.zeros(len(low), np.uint32)
    for n in (1, 2, 3):
        if len(low) < n:
            break
        code = (code[: len(low) - n + 1] << np.uint32(8)) | low[n - 1:]
        slot = ((code + np.uint32(n << 24)) * np.uint32(2654435761)) >> np.uint32(32 - 13)
        same = row[: len(low) - n + 1] == row[n - 1:]
        at = (row[: len(low) - n + 1] * DIMS + slot)[same]
        got += np.bincount(at, minlength=len(got)).astype(np.float32)
    return got.reshape(len(texts), DIMS)


def unit(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(x) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _chunks(batches: Iterator[pa.RecordBatch], text_col: str | int = "text") -> Iterator[pa.RecordBatch]:
    for b in slices(batches, text_col):
        for i in range(0, b.num_rows, ROWS):
            yield b.slice(i, ROWS)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Documents with each n-gram slot, over all rows, and their number."""
    schema = pa.schema([("slot", pa.int32()), ("df", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMS + 1, np.int64)
        for b in _chunks(batches):
            total[:-1] += (counts(b.column(0)) > 0).sum(0)
            total[-1] += b.num_rows
        at = np.flatnonzero(total)
        yield out(schema, slot=at, df=total[at])

    rows = texts.selectExpr("text").mapInArrow(run, "slot int, df long").groupBy("slot").agg(F.sum("df").alias("df")).collect()
    got = np.zeros(DIMS + 1, np.int64)  # DIMS + 1 rows at most
    for r in rows:
        got[r.slot] = r.df
    return got[:-1], int(got[-1])


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means; (centroids, cosine that all but LOW of a centroid's members reach). Starts from far-apart members."""
    first = [int(np.argmax(x @ x.mean(0)))]
    near = x @ x[first[0]]
    for _ in range(1, min(k, len(x))):
        i = int(np.argmin(near))
        if near[i] > 1 - 1e-6:
            break
        first.append(i)
        near = np.maximum(near, x @ x[i])
    c = x[first].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        new = np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    own = (x @ c.T).argmax(1)
    c = c[np.bincount(own, minlength=len(c)) >= SMALL * len(x)]  # the largest is among them: SMALL is below 1 / CENTROIDS
    sim = x @ c.T
    own = sim.argmax(1)
    return c, np.array([np.quantile(sim[own == j, j], LOW, method="lower") if (own == j).any() else 1.0 for j in range(len(c))])


class Centroids:
    def __init__(self, idf: np.ndarray, langs: list[str], vectors: np.ndarray, least: np.ndarray):
        self.idf, self.langs, self.vectors, self.least = idf, langs, vectors, least

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        size = np.array([sum(1 for _ in islice(_LETTER.finditer(t or ""), SHORT)) for t in texts.to_pylist()])
        letters = size > 0
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        sim = unit(counts(texts), self.idf) @ self.vectors.T
        best = sim.argmax(1)
        score = np.where(letters, np.clip(sim[np.arange(len(best)), best], 0, 1), 0).astype(float)
        lang = [self.langs[j] if ok else UNKNOWN for j, ok in zip(best.tolist(), letters.tolist(), strict=True)]
        return lang, score, ~letters | (score < REJECT * self.least[best] * np.minimum(1, size / SHORT))


def fit(docs: DataFrame, learn: Column, sample: int = SAMPLE, k: int = CENTROIDS, id_col: str = "doc_id",
        text_col: str = "text", lang_col: str = "lang") -> Centroids:
    """Learn from the rows where ``learn`` holds and the language is known."""
    rows = docs.where(learn).selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text",
                                        f"cast(`{lang_col}` as string) as lang")
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))  # a text without letters has no language
    df, n = document_frequencies(rows)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    # one row a language; the sampling share of each keeps its sample near the bound
    share = {r.lang: min(1.0, sample / r.n) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return Centroids(idf, [], np.zeros((0, DIMS), np.float32), np.zeros(0))
    spread = 1_000_000
    limit = F.create_map(*[F.lit(x) for kv in share.items() for x in (kv[0], round(kv[1] * spread))])[F.col("lang")]
    picked = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(spread)) < limit)

    def cluster(key, group):
        x = np.concatenate([unit(counts(pa.array(group["text"].iloc[i:i + ROWS], pa.string())), idf) for i in range(0, len(group), ROWS)])
        c, least = kmeans(x, k)
        return pd.DataFrame({"lang": key[0], "vector": [v.astype(np.float32).tolist() for v in c], "least": least})

    got = picked.select("lang", "text").groupBy("lang").applyInPandas(cluster, "lang string, vector array<float>, least double").collect()
    got = sorted(got, key=lambda r: (r.lang, r.vector))
    return Centroids(idf, [r.lang for r in got], np.array([r.vector for r in got], np.float32).reshape(len(got), DIMS),
                     np.array([r.least for r in got]))


def predict(docs: DataFrame, model: Centroids, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches):
            lang, score, rejected = shared.value.predict(b.column(2))
            yield out(RESULT, doc_id=b.column(0), held_out=b.column(1), lang_pred=lang, score=score, rejected=rejected)

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_recognised(docs: DataFrame, model: Centroids, text_col: str = "text") -> DataFrame:
    """The rows that aren't rejected, with all their columns (no shuffle)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches, at):
            yield b.filter(pa.array(~shared.value.predict(b.column(at).cast(pa.string()))[2]))

    return docs.mapInArrow(run, docs.schema)
