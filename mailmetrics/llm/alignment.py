"""Cross-tokenizer alignment by an associative fragment monoid.

Byte offsets where tokens of both tokenizers end cut a text into groups (see
``token_groups``); the tokens of a group are linked, A with B.  A text of up to
``CHUNK`` bytes is aligned by one task.  A longer one is cut into byte ranges,
wherever these fall, spread over the tasks.  A range yields an open prefix,
closed groups and an open suffix; a tree of joins composes up to ``FAN``
neighbours a level until each text is one fragment, whose open ends the text's
own ends close.  What a seam closes is aligned by the task that joins it, so a
text's groups become pieces in a known order, and only open ends travel up.

How many documents hold a pair linked is counted by partial sums.  Of the
counted pairs the most frequent ``HEAD`` are broadcast (a bound that doesn't
depend on the data); every further pair is joined by a shuffle.

Null and empty texts have no tokens, nor have texts that one of the tokenizers
doesn't spell exactly (all numbers 0, digest '').  Repeated rows are documents
of their own, ids may repeat or be null, an empty table gives an empty one,
other columns are ignored.  The digest of a document runs over its pieces in
order, one after another; nothing else holds a whole long text.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices
from .token_groups import Fragment, TokenAligner, sha

#: Bytes of a text that one task aligns; the byte ranges of longer ones.
CHUNK = 1 << 16
#: Neighbouring fragments that are composed at once.
FAN = 16
#: Pairs whose counts are broadcast (16 bytes each); the others are joined.
HEAD = 1 << 20

_STATS = "n_a long, n_b long, n_groups long, n_links long"
_LINKS = "pairs array<long>, times array<long>"
SHORT = f"doc_id long, {_STATS}, groups_sha256 string, {_LINKS}"
CHUNKS = "rid long, doc_id long, idx long, chunks long, raw binary"
#: A piece (closed groups between two places of a text) and a fragment (open ends of chunks first .. last); a row may be both.
PIECES = f"rid long, doc_id long, pos long, seq int, good boolean, {_STATS}, groups string, {_LINKS}, first long, last long, prefix binary, suffix binary"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split(" ") for x in ddl.split(", "))])


@functools.lru_cache(maxsize=2)
def _aligner(vocab_json: str, piece_model: bytes) -> TokenAligner:
    return TokenAligner(vocab_json, piece_model)


def _lists(starts: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, pa.int64()))


def _batch(schema: pa.Schema, rows: int, found: dict | None = None, **cols) -> pa.RecordBatch:
    """Columns by name; those not given are null."""
    if found is not None:
        cols |= {n: found["stats"][:, i] for i, n in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
        cols |= {"pairs": _lists(found["starts"], found["pairs"]), "times": _lists(found["starts"], found["times"])}
    return pa.RecordBatch.from_arrays([
        (c if isinstance(c, pa.Array) else pa.array(c, f.type)) if (c := cols.get(f.name)) is not None else pa.nulls(rows, f.type) for f in schema], schema=schema)


class Vocabularies:
    """Both vocabulary files, read on the driver (their size does not depend on the data) and sent to the tasks."""

    def __init__(self, spark, a_path: str, b_path: str):
        with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
            self.sent = spark.sparkContext.broadcast((a.read(), b.read()))

    def get(self) -> TokenAligner:
        return _aligner(*self.sent.value)


def _short(vocab: Vocabularies, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = vocab.get()
        for b in slices(batches):
            found = aligner.texts([t or "" for t in b.column("text").to_pylist()])
            digests = [sha(x) if x else "" for x in found["groups"]]
            yield _batch(schema, b.num_rows, found, doc_id=b.column("doc_id"), groups_sha256=digests)

    return run


def _cut(chunk: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for rid, doc, text in zip(b.column("rid").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                raw = (" " + text).encode()
                n = -(-len(raw) // chunk)
                for i in range(n):
                    yield _batch(schema, 1, rid=[rid], doc_id=[doc], idx=[i], chunks=[n], raw=[raw[i * chunk:(i + 1) * chunk]])

    return run


def _pieces(aligner: TokenAligner, schema: pa.Schema, rid, doc_id, pos, seq, raw: list[bytes], **ends) -> pa.RecordBatch:
    """Rows with the groups of closed stretches (each begins with its cut's space, or is empty)."""
    found = aligner.texts([r[1:].decode() for r in raw])
    return _batch(schema, len(raw), found, rid=rid, doc_id=doc_id, pos=pos, seq=seq, good=found["good"], groups=found["groups"], **ends)


def _fragments(vocab: Vocabularies, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = vocab.get()
        for b in slices(batches, "raw"):
            made = [Fragment.of(r) for r in b.column("raw").to_pylist()]
            yield _pieces(aligner, schema, b.column("rid"), b.column("doc_id"), b.column("idx"), [1] * len(made), [c for _, c in made],
                          first=b.column("idx"), last=b.column("idx"), prefix=[f.prefix for f, _ in made], suffix=[f.suffix for f, _ in made])

    return run


def _compose(vocab: Vocabularies, schema: pa.Schema):
    """Neighbouring fragments of one text, at most FAN: what their seams close, and the one fragment they make."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["first", "last", "prefix", "suffix"]).to_pylist(), key=lambda r: r["first"])
        rid, doc = table["rid"][0].as_py(), table["doc_id"][0].as_py()
        whole, pos, closed = Fragment(rows[0]["prefix"], rows[0]["suffix"]), [], []
        for r in rows[1:]:
            whole, seam = whole.join(Fragment(r["prefix"], r["suffix"]))
            if seam:
                pos.append(r["first"])
                closed.append(seam)
        n = len(pos)
        parts = [_pieces(vocab.get(), schema, [rid] * n, [doc] * n, pos, [0] * n, closed)] if n else []
        parts.append(_batch(schema, 1, rid=[rid], doc_id=[doc], first=[rows[0]["first"]], last=[rows[-1]["last"]], prefix=[whole.prefix], suffix=[whole.suffix]))
        return pa.Table.from_batches(parts)

    return run


def _close(vocab: Vocabularies, schema: pa.Schema):
    """A whole text's fragment: its ends close the prefix and the suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = vocab.get()
        for b in slices(batches, "prefix"):
            for column, pos, seq in (("prefix", "first", -1), ("suffix", "last", 2)):
                x = b.filter(b.column(column).is_valid())
                yield _pieces(aligner, schema, x.column("rid"), x.column("doc_id"), x.column(pos), [seq] * x.num_rows, x.column(column).to_pylist())

    return run


def _long_pieces(rows: DataFrame, vocab: Vocabularies, scratch: Scratch, chunk: int, fan: int) -> DataFrame | None:
    """The pieces of all texts of more than ``chunk`` bytes, by a tree of joins; None: there are none."""
    schema = _arrow(PIECES)
    numbered = rows.where(F.octet_length("text") > chunk).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    chunks = scratch.stage(numbered.mapInArrow(_cut(chunk, _arrow(CHUNKS)), CHUNKS), "chunks")  # the numbers are fixed from here on
    most = chunks.agg(F.max("chunks")).first()[0]
    if most is None:
        return None
    spread = chunks.repartition("rid", "idx")
    level = scratch.stage(spread.mapInArrow(_fragments(vocab, schema), PIECES), "fragments0")
    levels, width = [level], 1
    while width < most:
        width *= fan
        open_ends = levels[-1].where(F.col("first").isNotNull()).select("rid", "doc_id", "first", "last", "prefix", "suffix")
        joined = open_ends.groupBy("rid", F.floor(F.col("first") / width).alias("part")).applyInArrow(_compose(vocab, schema), PIECES)
        levels.append(scratch.stage(joined, f"fragments{len(levels)}"))
    levels.append(scratch.stage(levels[-1].where(F.col("first").isNotNull()).mapInArrow(_close(vocab, schema), PIECES), "ends"))
    found = functools.reduce(DataFrame.unionByName, levels)
    return found.where(F.col("good").isNotNull()).drop("first", "last", "prefix", "suffix")


def _pair_counts(short: DataFrame, pieces: DataFrame | None, many: int, scratch: Scratch) -> DataFrame:
    """(pair, n, best): documents that hold each pair linked; whether no pair of its A id is held by more."""
    held = short.select(F.explode("pairs").alias("pair"))
    if pieces is not None:
        held = held.unionByName(pieces.select("rid", F.explode("pairs").alias("pair")).distinct().select("pair"))
    counts = scratch.stage(held.groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "counts")
    a_id = F.floor(F.col("pair") / many).cast("long")
    most = counts.groupBy(a_id.alias("_a")).agg(F.max("n").alias("_most"))
    return scratch.stage(counts.join(most, a_id == F.col("_a")).select("pair", "n", (F.col("n") == F.col("_most")).alias("best")), "pairs")


def _score(rows: DataFrame, counts: DataFrame, total: int, head: int, scratch: Scratch, name: str) -> DataFrame:
    """``rows`` with n_best and count_sum for pairs and times."""
    first = counts if total <= head else counts.orderBy(F.col("n").desc(), "pair").limit(head)
    table = first.toArrow().sort_by("pair")
    sent = rows.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy().astype(np.int64) for c in ("pair", "n", "best")))
    kept = rows.drop("pairs", "times")
    ddl = f"row long, n_best long, count_sum long, pairs array<long>, times array<long>"
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        for b in batches:
            lists, amounts = b.column("pairs"), b.column("times")
            own, times = (np.asarray(x.flatten()).astype(np.int64) for x in (lists, amounts))
            row = np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths().fill_null(0)))
            at = np.searchsorted(pair, own)
            at[at == len(pair)] = 0
            known = pair[at] == own if len(pair) else np.zeros(len(own), bool)
            sums = np.zeros((2, b.num_rows), np.int64)
            for x, values in zip(sums, (best, n)):
                np.add.at(x, row[known], values[at[known]] * times[known])
            starts = np.append(0, np.cumsum(np.bincount(row[~known], minlength=b.num_rows)))
            yield _batch(schema, b.num_rows, row=b.column("row"), n_best=sums[0], count_sum=sums[1],
                         pairs=_lists(starts, own[~known]), times=_lists(starts, times[~known]))

    numbered = scratch.stage(rows.withColumn("row", F.monotonically_increasing_id()), f"{name}-rows") if total > head else None
    if numbered is None:
        keep = [f for f in kept.schema.fields]
        return _carry(rows, keep, run)
    scored = scratch.stage(numbered.select("row", "pairs", "times").mapInArrow(run, ddl), f"{name}-scored")
    rest = scored.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times")
    rest = rest.join(counts, rest["pairs"] == counts["pair"]).groupBy(F.col("row").alias("_r")).agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_b"), F.sum(F.col("n") * F.col("times")).alias("_c"))
    sums = scored.join(rest, scored["row"] == rest["_r"], "left").select(
        F.col("row").alias("_row"), (F.col("n_best") + F.coalesce("_b", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_c", F.lit(0))).alias("count_sum"))
    return numbered.drop("pairs", "times").join(sums, F.col("row") == F.col("_row")).drop("row", "_row")


def _carry(rows: DataFrame, keep: list, run) -> DataFrame:
    """``rows`` without their lists, with the sums of ``run`` beside them (all pairs were broadcast)."""
    names = [f.name for f in keep]
    ddl = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in keep), "n_best long", "count_sum long"])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = pa.RecordBatch.from_arrays([pa.array(np.arange(b.num_rows)), b.column("pairs"), b.column("times")], names=["row", "pairs", "times"])
            for s in run(iter([row])):
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), s.column("n_best"), s.column("count_sum")], names=[*names, "n_best", "count_sum"])

    return rows.mapInArrow(both, ddl)


RESULT = f"rid long, doc_id long, {_STATS}, n_best long, count_sum long, groups_sha256 string"


def _in_order(schema: pa.Schema):
    """One row per text from its pieces, which follow each other in order: sums, and the digest fed piece by piece."""
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = doc = digest = None
        good, sums = True, [0] * len(names)

        def done() -> pa.RecordBatch:
            values = {n: [v if good else 0] for n, v in zip(names, sums)}
            return _batch(schema, 1, rid=[now], doc_id=[doc], groups_sha256=[digest.hexdigest() if good else ""], **values)

        for b in slices(batches, "groups"):
            for r in b.to_pylist():
                if r["rid"] != now:
                    if now is not None:
                        yield done()
                    now, doc, digest, good, sums = r["rid"], r["doc_id"], hashlib.sha256(), True, [0] * len(names)
                good &= r["good"]
                if r["groups"]:
                    digest.update((b";" if sums[0] else b"") + r["groups"].encode())
                sums = [x + r[n] for x, n in zip(sums, names)]
        if now is not None:
            yield done()

    return run


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
                    chunk: int | None = None, fan: int | None = None, head: int | None = None) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a_path``: a byte-level BPE (tokenizers JSON); ``b_path``: a sentencepiece model.
    """
    chunk, fan, head = CHUNK if chunk is None else chunk, FAN if fan is None else fan, HEAD if head is None else head
    spark = docs.sparkSession
    scratch, vocab = Scratch(spark, "alignment"), Vocabularies(spark, a_path, b_path)
    rows = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text")
    short = rows.where(F.col("text").isNull() | (F.octet_length("text") <= chunk))
    short = scratch.stage(short.mapInArrow(_short(vocab, _arrow(SHORT)), SHORT), "short")
    pieces = _long_pieces(rows, vocab, scratch, chunk, fan)
    spelt = None
    if pieces is not None:  # a text with one piece that isn't spelt exactly has no tokens at all
        bad = pieces.where(~F.col("good")).select("rid").distinct()
        spelt = pieces.join(bad, "rid", "left_anti")
    counts = _pair_counts(short, spelt, len(vocab.get().b_bytes), scratch)
    total = counts.count()
    order = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    result = _score(short, counts, total, head, scratch, "short").select(*order)
    if pieces is not None:
        scored = _score(pieces, counts, total, head, scratch, "long")
        whole = scored.repartition("rid").sortWithinPartitions("rid", "pos", "seq").mapInArrow(_in_order(_arrow(RESULT)), RESULT)
        result = result.unionByName(whole.select(*order))
    return result
