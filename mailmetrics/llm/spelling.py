"""Spelling variant grouping by a bit-sliced position index.

Words are runs of letters counted over whole texts.  Two words are near if
one inserted, deleted or replaced code point turns one into the other.  Cut a
word's length s (the shorter one's) in half: near words agree on the first
half or on the rest, whatever the edit, so words are dealt out by hashes of
both halves, for s their own length and one less.  A task indexes the words of
its buckets bit by bit: for each (position, letter) a bitset of the words with
that letter there.  Every word of length s then runs along its letters over 64
words at a time, keeping the sets of words met without an error, with one
replaced letter, and with one letter more (which are compared one position
further on).  Near pairs found by both halves count at the first.

A bucket of more than ``BLOCK`` words is cut into blocks and compared in pairs
of blocks, so no bucket of any size meets in one task; a word's pairs leave the
task as their count and the best of them.

A word's form is its near word of largest count (ties: smallest in code-point
order) if that count is at least ``ratio`` times its own; its root is reached
by following forms, by joins that double the distance.

Null texts have no words, a null doc_id counts as the empty text, repeated
rows count each, an empty table gives an empty one, other columns are ignored.
The runs of one text are held by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, grouped

#: Fixed value: runs of letters.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a bucket that are compared as one block, and letters of a block.
BLOCK = 2048
BLOCK_LETTERS = 1 << 22

NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def lower_ascii(word: Column) -> Column:
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id text, run): every run of letters of every text, A-Z in lower case."""
    found = F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(RUN), F.lit(0)))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")).alias("id"), found.alias("run"))
    return rows.select("id", lower_ascii(F.col("run")).alias("run"))


def misspelt(rows: DataFrame, every: int = 199) -> DataFrame:
    """One letter goes from the runs whose crc32 of ``<id>:<run>`` ``every`` divides: the one at crc32 mod length."""
    rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return rows.select("id", F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("run"))


def vocabulary(rows: DataFrame, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n) of all runs with so many code points and occurrences."""
    words = rows.where(F.length("run") >= least_length).groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return words.where(F.col("n") >= least_count)


def _block(s: Column, block: int) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(block), F.lit(BLOCK_LETTERS).cast("long") / (s + 1))).cast("long")


def buckets(vocab: DataFrame, block: int) -> DataFrame:
    """(s, half, key, lo, hi, side, word, n): the words of each pair of blocks of each bucket."""
    m = F.length("word")

    def halves(s: Column) -> list[Column]:
        first = F.floor(s / 2).cast("int")
        keys = (F.substring(F.col("word"), F.lit(1), first), F.substring(F.col("word"), m - (s - first) + 1, m))
        return [F.struct(s.alias("s"), F.lit(i).alias("half"), F.xxhash64(k).alias("key")) for i, k in enumerate(keys)]

    dealt = vocab.select("word", "n", F.explode(F.array(*halves(m), *halves(m - 1))).alias("k")).select("k.*", "word", "n").where("s > 0")
    big = dealt.groupBy("s", "half", "key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > _block(F.col("s"), block))
    big = big.select("s", "half", "key", F.ceil(F.col("size") / _block(F.col("s"), block)).alias("blocks"))
    dealt = dealt.join(big, ["s", "half", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("word", F.lit(1)), F.col("blocks")))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return pairs.select("s", "half", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
                        (F.col("own") > F.col("other")).cast("int").alias("side"), "word", "n")


class PositionIndex:
    """Bitsets of the words that have a letter at a position; words have s or s + 1 letters."""

    def __init__(self, words: list[str], s: int):
        self.s, self.size = s, np.array([len(w) for w in words])
        text = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        letters, own = np.unique(text, return_inverse=True)
        self.letter = np.zeros((len(words), s + 1), np.int32)  # 0: past the end
        self.letter[np.arange(s + 1) < self.size[:, None]] = own + 1
        self.kinds = len(letters) + 1
        self.width = -(-len(words) // 64)

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)

    def having(self, position: int) -> np.ndarray:
        """(letters, width): bitset of the words with each letter at the position."""
        bits = np.zeros((self.kinds, self.width * 64), bool)
        bits[self.letter[:, position], np.arange(len(self.size))] = True
        bits[0] = False
        return self._pack(bits)

    def sized(self, n: int) -> np.ndarray:
        bits = np.zeros(self.width * 64, bool)
        bits[:len(self.size)] = self.size == n
        return self._pack(bits)

    def near(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (word of s letters, word with one replaced) and (word of s letters, word with one more)."""
        asked = np.flatnonzero(self.size == self.s)
        none = np.zeros((len(asked), self.width), np.uint64)
        exact, replaced, longer = ~none, none.copy(), none
        here = self.having(0)
        for i in range(self.s):
            after = self.having(i + 1)
            same, shifted = here[self.letter[asked, i]], after[self.letter[asked, i]]
            longer = (longer | exact) & shifted
            replaced = (replaced & same) | (exact & ~same)
            exact &= same
            here = after
        replaced &= self.sized(self.s)
        longer = (longer | exact) & self.sized(self.s + 1)
        return (*self._pairs(asked, replaced), *self._pairs(asked, longer))

    @staticmethod
    def _pairs(asked: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, word = np.nonzero(found)
        bits = np.unpackbits(found[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        k, bit = np.nonzero(bits)
        return asked[row[k]], word[k] * 64 + bit


def _near_in(s: int, half: np.ndarray, unit: np.ndarray, cross: np.ndarray, side: np.ndarray, words: list[str], n: np.ndarray) -> pa.RecordBatch:
    index = PositionIndex(words, s)
    a, b, c, d = index.near()
    one, two = np.concatenate([a, c, d]), np.concatenate([b, d, c])
    keep = (unit[one] == unit[two]) & (~cross[one] | (side[one] != side[two]))
    one, two = one[keep], two[keep]
    first = s // 2
    again = (half[one] == 1) & (index.letter[one, :first] == index.letter[two, :first]).all(axis=1)  # the first half has them
    one, two = one[~again], two[~again]
    place = np.empty(len(words), np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((place[two], -n[two], one))
    one, two = one[order], two[order]
    heads = np.flatnonzero(np.diff(one, prepend=-1)) if len(one) else np.zeros(0, np.int64)
    counts = np.diff(np.append(heads, len(one)))
    return pa.RecordBatch.from_arrays([pa.array([words[i] for i in one[heads]], pa.string()), pa.array(counts, pa.int64()),
                                       pa.array(n[two[heads]], pa.int64()), pa.array([words[i] for i in two[heads]], pa.string())], schema=NEAR)


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, bounds in grouped(batches, 5):
        sizes = np.diff(bounds)
        unit = np.repeat(np.arange(len(sizes)), sizes)
        rows = np.flatnonzero(sizes[unit] > 1)
        if not len(rows):
            continue
        s = table.column(0).to_numpy()
        half, lo, hi, side, n = (table.column(k).to_numpy() for k in ("half", "lo", "hi", "side", "n"))
        words = table.column("word").to_pylist()
        ends = np.flatnonzero(np.diff(s[rows])) + 1
        for part in np.split(rows, ends):
            k = int(s[part[0]])
            most = max(1, 2 * BLOCK_LETTERS // (k + 1))
            starts = [0]  # whole units, at most so many words together
            for at in np.flatnonzero(np.diff(unit[part])) + 1:
                if at - starts[-1] >= min(most, BLOCK):
                    starts.append(int(at))
            for i, j in zip(starts, [*starts[1:], len(part)]):
                p = part[i:j]
                yield _near_in(k, half[p], unit[p], (lo != hi)[p], side[p], [words[x] for x in p], n[p])


def near_words(vocab: DataFrame, block: int | None = None) -> DataFrame:
    """(word, n_near, best_n, best) of the distinct words (word, n) that have near words; best: the one of largest n."""
    rows = buckets(vocab, BLOCK if block is None else block)
    keys = ["s", "half", "key", "lo", "hi"]
    found = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_match, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return found.select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def group_variants(vocab: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of the distinct words (word, n)."""
    scratch = Scratch(vocab.sparkSession, "spelling")
    vocab = scratch.stage(vocab.select("word", "n"), "vocabulary")
    near = near_words(vocab).withColumnRenamed("word", "_w")
    is_form = F.col("best_n") >= F.col("n") * ratio
    forms = scratch.stage(vocab.join(near, vocab["word"] == near["_w"], "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "forms")
    roots = forms.where(F.col("form").isNotNull()).select(F.col("word").alias("_w"), F.col("form").alias("_root"))
    k = 0
    while True:  # as many rounds as the logarithm of the longest way: counts grow by ``ratio`` at every step
        further = roots.select(F.col("_w").alias("_at"), F.col("_root").alias("_next"))
        step = roots.join(further, F.col("_root") == F.col("_at"), "left")
        roots = scratch.stage(step.select("_w", F.coalesce("_next", "_root").alias("_root"), F.col("_at").isNotNull().alias("_moved")), f"roots{k}")
        k += 1
        if roots.where("_moved").isEmpty():
            break
    return forms.join(roots, forms["word"] == roots["_w"], "left").select(
        "word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")


def document_variants(docs: DataFrame) -> DataFrame:
    return group_variants(vocabulary(misspelt(runs(docs))))
