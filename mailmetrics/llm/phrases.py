"""Substring dedup with automata of recurring passages.

A word goes if a window of ``n`` consecutive words that covers it also starts
in a document with a smaller id.  Three steps:

1. Confirm recurring passages.  Every window has an anchor, the least hashed
   ``k`` words in it, so equal windows have equal anchors; windows with one
   occurrence of an anchor form a run with a hash of all its words.  Anchor
   keys met in one document only are done with.  Of the others, a run that
   occurs as a whole in two documents recurs; where runs of one anchor differ,
   their windows are compared one by one.  A passage is cut, once, from the
   document with the smallest id that holds it.  Smallest ids come from partial
   minima, so a group of copies is never paired up.
2. Compile Aho-Corasick automata (pyahocorasick, over word ids), sharded by
   passage: a shard holds the passages of a few documents (of 16,384 words of a
   long one), about ``SHARD_WORDS`` words.
3. Stream every document that shares an anchored run with a shard through the
   shard's automaton, ``SHARD_TEXTS`` documents a task, so that a passage in a
   third of all documents is searched by many tasks.  Step 1 hands over no
   places: the automaton locates every occurrence, word for word.  Words
   covered by an occurrence of a passage with a smaller id go.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.  Null and
empty texts have no words; a text of any length is one row, its passages are
spread over shards.  Documents with a null id are neither origin nor repeat:
they keep all words.  Rows that share an id aren't repeats of each other; rows
that repeat id and text are searched once and each returned.  Empty tables give
empty results; ``rewrite_documents`` keeps extra columns, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import seqhash
from .common import Scratch, distinct_texts, keyed, out, row_key, slices, text_bytes

WINDOW_WORDS = 50
ANCHOR_WORDS = 8
#: Words of a shard's passages; documents searched by one task of a shard.
SHARD_WORDS = 200_000
SHARD_TEXTS = 4096
LEN_BITS = 16
#: Passages of one document that start in the same 2^14 words share a shard.
BLOCK_BITS = 14

ENTRY = pa.schema([("dk", pa.int64()), ("rk", pa.int64()), ("a", pa.int64()), ("w", pa.int64()), ("run", pa.int64())])
WINDOW = pa.schema([("dk", pa.int64()), ("rk", pa.int64()), ("run", pa.int64()), ("v", pa.int64())])
SENT = pa.schema([("dk", pa.int64()), ("rk", pa.int64()), ("run", pa.int64()), ("shard", pa.int64()), ("text", pa.string())])
SPAN = pa.schema([("dk", pa.int64()), ("rk", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each text's first word, and the end)."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = np.unique(offsets[1:-1])
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    if len(cuts):
        cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
        start, end = np.union1d(start, cuts), np.union1d(end, cuts)
    return seqhash.runs(seqhash.prefix(seqhash.BYTE[data]), start, end), np.searchsorted(start, offsets)


def _entries(n: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sym, first = word_hashes(*text_bytes(b.column(2)))
            d = seqhash.domains(seqhash.prefix(sym), np.repeat(first[1:], np.diff(first)), n, k)
            doc = np.searchsorted(first, d["first"], side="right") - 1
            take = pa.array(doc)
            yield out(ENTRY, dk=b.column(0).take(take), rk=b.column(1).take(take), a=seqhash.i64(d["anchor"]),
                      w=seqhash.i64(d["whole"]), run=((d["first"] - first[doc]) << LEN_BITS) | (d["last"] - d["first"]))
    return run


def _windows(n: int):
    """Every window of the given runs, hashed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sym, first = word_hashes(*text_bytes(b.column(2)))
            lists = b.column(3)
            runs = np.asarray(lists.flatten()).astype(np.int64)
            doc = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
            size = (runs & ((1 << LEN_BITS) - 1)) + 1
            row = np.repeat(np.arange(len(runs)), size)
            start = (runs >> LEN_BITS)[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            at = start + first[doc[row]]
            v = seqhash.runs(seqhash.prefix(sym), at, at + n)
            take = pa.array(doc[row])
            yield out(WINDOW, dk=b.column(0).take(take), rk=b.column(1).take(take), run=start << LEN_BITS, v=seqhash.i64(v))
    return run


def confirmed(texts: DataFrame, scratch: Scratch, n: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Recurring passages and who is to be searched for them.

    (passage, dk, rk, run): where the document with the smallest id has each;
    (passage, dk, rk): documents with a larger id that hold it somewhere.
    A passage is named by (one, a, w): a run by its anchor and whole hash, a single window by its own hash.
    """
    entries = scratch.stage(texts.mapInArrow(_entries(n, k), "dk long, rk long, a long, w long, run long"), "entries")
    keys = entries.groupBy("a").agg(F.min("dk").alias("d0"), F.max("dk").alias("d1"), F.min("w").alias("lo"), F.max("w").alias("hi"))
    keys = scratch.stage(keys.where("d0 < d1").selectExpr("a", "lo <> hi as mixed"), "keys")  # else a hot anchor can't be split below
    hits = scratch.stage(entries.join(keys, "a"), "hits")
    scratch.free_shuffles()
    scratch.drop("entries", "keys")
    kinds = scratch.stage(hits.groupBy("a", "w").agg(F.min("dk").alias("origin"), F.max("dk").alias("last")), "kinds")
    runs = scratch.stage(hits.join(kinds, ["a", "w"]).where("mixed or origin < last"), "runs")
    scratch.free_shuffles()
    scratch.drop("hits", "kinds")
    shown = runs.where("mixed and dk = origin").groupBy("dk", "rk").agg(F.collect_list("run").alias("runs"))
    windows = texts.join(shown.hint("merge"), ["dk", "rk"]).select("dk", "rk", "text", "runs").mapInArrow(_windows(n), "dk long, rk long, run long, v long")
    windows = scratch.stage(windows, "windows")
    scratch.free_shuffles()
    again = scratch.stage(windows.groupBy("v").agg(F.min("dk").alias("origin"), F.max("dk").alias("last")).where("origin < last").select("v", "origin"), "again")
    single = windows.join(again, "v").selectExpr("true as one", "v as a", "0L as w", "dk", "rk", "run", "origin")
    whole = runs.where("origin < last").selectExpr("false as one", "a", "w", "dk", "rk", "run", "origin")
    met = scratch.stage(whole.unionByName(single), "met")
    scratch.free_shuffles()
    scratch.drop("runs", "windows", "again")
    name = ["one", "a", "w"]
    first = met.where("dk = origin").groupBy(*name).agg(F.min(F.struct("dk", "rk", "run")).alias("f")).select(*name, "f.*")
    return scratch.stage(first, "first"), met.where("dk > origin").select(*name, "dk", "rk")


def _send(n: int):
    """For each document, the words of its passages, and its text once for each shard to be searched."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for dk, rk, text, runs, shards in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = text.encode().split() if runs else ()
                at = [(r >> LEN_BITS, (r >> LEN_BITS) + (r & ((1 << LEN_BITS) - 1)) + n) for r in runs or ()]
                yield out(SENT, dk=[dk] * len(at), rk=[rk] * len(at), run=runs or [], shard=[None] * len(at),
                          text=[b" ".join(words[s:e]).decode() for s, e in at])
                for shard in shards or ():
                    yield out(SENT, dk=[dk], rk=[rk], run=[None], shard=[shard], text=[text])
    return run


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, part, is_text, dk, rk, text), a shard's passages before its texts: words of texts covered by passages."""
    now, ids, automaton = None, {}, None
    for b in slices(batches):
        for shard, part, is_text, dk, rk, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (shard, part) != now:
                now, ids, ready = (shard, part), {}, False
                automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            words = text.encode().split()
            if not is_text:
                passage = tuple([ids.setdefault(w, len(ids) + 1) for w in words])
                old = automaton.get(passage, None)
                if old is None or dk < old[1]:
                    automaton.add_word(passage, (len(words), dk))
                continue
            if not ready:
                automaton.make_automaton()
                ready = True
            cover = np.zeros(len(words) + 2, np.int64)
            for at, (size, origin) in automaton.iter(tuple([ids.get(w, 0) for w in words])):
                if origin < dk:
                    cover[at + 2 - size] += 1
                    cover[at + 2] -= 1
            step = np.diff(np.cumsum(cover) > 0).astype(np.int8) if cover.any() else cover[:0]
            start = np.flatnonzero(step)
            yield out(SPAN, dk=[dk] * (len(start) // 2), rk=[rk] * (len(start) // 2), first=start[::2], last=start[1::2])


def recurring_runs(docs: DataFrame, n: int = WINDOW_WORDS, k: int = ANCHOR_WORDS) -> DataFrame:
    """(dk, rk, runs): for each row of ``keyed`` documents, [first, last) words that the automata cover."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    # rows that share an id aren't repeats of each other, so one of the rows that repeat both id and text is enough
    texts = distinct_texts(docs.where("doc_id is not null"), scratch).select("dk", "rk", "text")
    first, later = confirmed(texts, scratch, n, k)
    words = first.agg(F.sum(F.col("run").bitwiseAND((1 << LEN_BITS) - 1) + n)).first()[0] or 0
    shards = max(1, -(-words // SHARD_WORDS))
    shard = F.expr(f"pmod(xxhash64(dk, shiftright(run, {LEN_BITS + BLOCK_BITS})), {shards}L)")
    name = ["one", "a", "w"]
    asked = scratch.stage(later.join(first.select(*name, shard.alias("shard")), name).select("dk", "rk", "shard").distinct(), "asked")
    scratch.free_shuffles()
    scratch.drop("met")
    # a shard with many texts is searched by several tasks, each with an automaton of its passages
    parts = scratch.stage(asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SHARD_TEXTS).alias("parts")), "parts")
    own = first.select("dk", "rk", "run", F.lit(None).cast("long").alias("shard")).unionByName(
        asked.select("dk", "rk", F.lit(None).cast("long").alias("run"), "shard"))
    own = own.groupBy("dk", "rk").agg(F.collect_list("run").alias("runs"), F.collect_list("shard").alias("shards"))
    sent = texts.join(own.hint("merge"), ["dk", "rk"]).select("dk", "rk", "text", "runs", "shards")
    sent = sent.mapInArrow(_send(n), "dk long, rk long, run long, shard long, text string")
    sent = scratch.stage(sent.withColumn("is_text", F.col("run").isNull()).withColumn("shard", F.coalesce("shard", shard)), "sent")
    scratch.free_shuffles()
    dealt = sent.join(parts, "shard").withColumn("part", F.explode(F.expr(
        "if(is_text, array(pmod(xxhash64(dk, rk), parts)), sequence(0L, parts - 1))")))
    dealt = dealt.repartition("shard", "part").sortWithinPartitions("shard", "part", "is_text").select("shard", "part", "is_text", "dk", "rk", "text")
    spans = scratch.stage(dealt.mapInArrow(_search, "dk long, rk long, first long, last long"), "spans")
    scratch.free_shuffles()
    scratch.drop("sent", "first", "asked", "parts")
    return spans.groupBy("dk", "rk").agg(F.collect_list(F.struct("first", "last")).alias("runs"))


def _kept(texts: pa.Array, runs: pa.Array):
    """For each text: (words, words removed, kept words joined by a space)."""
    for text, spans in zip(texts.cast(pa.binary()).to_pylist(), runs.to_pylist(), strict=True):
        words = (text or b"").split()
        stay = words
        if spans:
            keep = bytearray(b"\x01" * len(words))
            for s in spans:
                keep[s["first"]:s["last"]] = bytes(s["last"] - s["first"])
            stay = list(compress(words, keep))
        yield len(words), len(words) - len(stay), b" ".join(stay)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        got = list(_kept(b.column(1), b.column(2)))
        yield out(RESULT, doc_id=b.column(0), n_words=[g[0] for g in got], n_removed=[g[1] for g in got],
                  kept_sha256=[hashlib.sha256(g[2]).hexdigest() for g in got])


def _rewrite(text_at: int):
    """All columns but the last (the runs); texts that lose words are replaced."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_at):
            texts = b.column(text_at)
            got = _kept(texts, b.column(b.num_columns - 1))
            new = [x.decode() if gone else old for (_, gone, x), old in zip(got, texts.to_pylist(), strict=True)]
            cols = [pa.array(new, texts.type) if i == text_at else b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1])
    return run


def remove_repeated_passages(docs: DataFrame, n: int = WINDOW_WORDS, k: int = ANCHOR_WORDS, id_col: str = "doc_id",
                             text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed and the SHA-256 of the kept words joined by a space."""
    rows = keyed(docs, id_col, text_col)
    joined = rows.join(recurring_runs(rows, n, k).hint("merge"), ["dk", "rk"], "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def rewrite_documents(docs: DataFrame, n: int = WINDOW_WORDS, k: int = ANCHOR_WORDS, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """``docs`` with all its rows and columns; a text that loses words becomes its kept words joined by a space."""
    names = docs.columns
    runs = recurring_runs(keyed(docs, id_col, text_col), n, k).select(F.col("dk").alias("_dk"), F.col("rk").alias("_rk"), F.col("runs").alias("_runs"))
    rows = docs.withColumns({"_dk": F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))), "_rk": row_key(F.col(text_col).cast("string"))})
    rows = rows.join(runs.hint("merge"), ["_dk", "_rk"], "left").select(*names, "_runs")
    return rows.mapInArrow(_rewrite(names.index(text_col)), docs.schema)
