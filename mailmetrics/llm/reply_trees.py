"""Chat formatting of reply trees (DataFrame functions only).

Messages (tree, id, parent, role, text, score) form trees by their parents.
Self-joins that double the distance they look up enumerate every root-to-leaf
path: ``up_k`` holds the ancestor 2^k replies above each message, and a leaf
reaches all its ancestors by adding such steps from the largest to the
smallest, so a path of d messages takes 2 log2(d) joins.  Paths are ranked by
score inside their tree; each chosen path becomes one conversation.

The template marks a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``.  In texts
and roles a ``<`` and a ``|`` with nothing or backslashes between them get one
backslash more, so neither marker can come from a text, and one backslash less
restores it.  In a role ``%`` and line feed are written %25 and %0A.

A null text or role is empty.  A parent that is null, absent from the tree or
the message itself makes a root; null is a tree and a message id like any
other, though no reply can name it.  Of several messages with one id in a tree
the best scored one counts (ties: smallest parent, role, text).  Messages on a
cycle, and those below, lie on no root-to-leaf path and come out in none.
Equal scores rank by the id of the leaf; no score ranks last.  An empty table
gives an empty one; other columns are ignored.  A conversation is one row, so
the turns of one path meet in one task; trees don't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

START, END = "<|im_start|>", "<|im_end|>"
#: The role whose texts are under the loss mask.
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _unique(messages: DataFrame) -> DataFrame:
    """One row per (tree, id), under names that clash with nothing."""
    score = F.col("score").cast("double")
    best = F.min(F.struct(score.isNull().alias("a"), (-score).alias("b"), F.col("parent_id").alias("c"),
                          F.coalesce("role", F.lit("")).alias("d"), F.coalesce("text", F.lit("")).alias("e")))
    rows = messages.groupBy(F.col("tree_id").alias("_tree"), F.col("message_id").alias("_id")).agg(best.alias("_m"))
    return rows.select("_tree", "_id", F.col("_m.c").alias("_parent"), F.col("_m.d").alias("_role"),
                       F.col("_m.e").alias("_text"), (-F.col("_m.b")).alias("_score"))


def _same_tree(other: str) -> Column:
    return F.col("_tree").eqNullSafe(F.col(other))


def _steps(parents: DataFrame, total: int, scratch: Scratch) -> tuple[list[DataFrame], DataFrame | None]:
    """([up_0, up_1, ...], messages whose ancestors never end): up_k has (tree, id, ancestor 2^k above)."""
    ups = [scratch.stage(parents, "up0")]
    while not ups[-1].isEmpty():
        if 2 ** (len(ups) - 1) > total:
            return ups, ups[-1]
        last = ups[-1]
        more = last.select(F.col("_tree").alias("_t"), F.col("_id").alias("_at"), F.col("_up").alias("_upper"))
        step = last.join(more, _same_tree("_t") & (F.col("_up") == F.col("_at"))).select("_tree", "_id", F.col("_upper").alias("_up"))
        ups.append(scratch.stage(step, f"up{len(ups)}"))
    return ups[:-1], None


def reply_paths(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(tree, leaf, id, replies from it to the leaf) for every message of every root-to-leaf path."""
    ids = nodes.select(F.col("_tree").alias("_t"), F.col("_id").alias("_up"))
    replies = nodes.select("_tree", "_id", "_parent").where(~F.col("_parent").eqNullSafe(F.col("_id")))
    parents = replies.join(ids, _same_tree("_t") & (F.col("_parent") == F.col("_up"))).select("_tree", "_id", "_up")
    ups, endless = _steps(parents, nodes.count(), scratch)
    paths = nodes.select("_tree", "_id")
    if ups:
        answered = ups[0].select(F.col("_tree").alias("_t"), F.col("_up").alias("_i")).distinct()
        paths = paths.join(answered, _same_tree("_t") & (F.col("_id") == F.col("_i")), "left_anti")
    if endless is not None:
        bad = endless.select(F.col("_tree").alias("_t"), F.col("_id").alias("_i")).distinct()
        paths = paths.join(bad, _same_tree("_t") & F.col("_id").eqNullSafe(F.col("_i")), "left_anti")
    paths = paths.select("_tree", F.col("_id").alias("_leaf"), "_id", F.lit(0).cast("long").alias("_above"))
    for k in reversed(range(len(ups))):
        up = ups[k].select(F.col("_tree").alias("_t"), F.col("_id").alias("_i"), "_up")
        both = paths.join(up, _same_tree("_t") & F.col("_id").eqNullSafe(F.col("_i")), "left")
        here = F.struct("_id", "_above")
        there = F.struct(F.col("_up").alias("_id"), (F.col("_above") + 2 ** k).alias("_above"))
        steps = F.when(F.col("_up").isNull(), F.array(here)).otherwise(F.array(here, there))
        paths = both.select("_tree", "_leaf", F.explode(steps).alias("_s")).select("_tree", "_leaf", "_s._id", "_s._above")
    return scratch.stage(paths, "paths")


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The ``branches`` best paths of every tree, each as one conversation.

    ``messages``: tree_id, message_id, parent_id (any type with an order),
    role, text, score.  A path's score is the mean of its messages' scores.
    Returns tree_id, root_id, leaf_id, rank (from 1 inside the root's tree),
    score, formatted, turns: per turn the place of its text in ``formatted``
    (start from 0, length, code points) and whether it is under the loss mask.
    """
    scratch = Scratch(messages.sparkSession, "replies")
    nodes = scratch.stage(_unique(messages), "messages")
    paths = reply_paths(nodes, scratch)
    scores = nodes.select(F.col("_tree").alias("_t"), F.col("_id").alias("_i"), "_score")
    ranked = paths.join(scores, _same_tree("_t") & F.col("_id").eqNullSafe(F.col("_i"))).groupBy("_tree", "_leaf").agg(
        F.avg("_score").alias("_mean"), F.max(F.struct("_above", "_id"))["_id"].alias("_root"))
    place = F.row_number().over(Window.partitionBy("_tree", "_root").orderBy(F.col("_mean").desc_nulls_last(), "_leaf"))
    chosen = ranked.withColumn("_rank", place).where(F.col("_rank") <= branches).select(
        F.col("_tree").alias("_ct"), F.col("_leaf").alias("_cl"), "_root", "_rank", "_mean")
    turns = paths.join(chosen, _same_tree("_ct") & F.col("_leaf").eqNullSafe(F.col("_cl"))).drop("_ct", "_cl")
    texts = nodes.select(
        F.col("_tree").alias("_t"), F.col("_id").alias("_i"), F.concat(F.lit(START), _escape_role(F.col("_role")), F.lit("\n")).alias("_head"),
        escape(F.col("_text")).alias("_body"), (F.col("_role") == LEARNED).alias("_learned"))
    turns = turns.join(texts, _same_tree("_t") & F.col("_id").eqNullSafe(F.col("_i")))
    before = Window.partitionBy("_tree", "_leaf").orderBy(F.col("_above").desc()).rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("_head") + F.length("_body") + len(END) + 1
    start = F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("_head")
    turns = turns.select(
        "_tree", "_leaf", "_root", "_rank", "_mean",
        F.struct((-F.col("_above")).alias("order"), F.concat("_head", "_body", F.lit(END + "\n")).alias("piece"), start.alias("start"),
                 F.length("_body").cast("long").alias("length"), F.col("_learned").alias("learned")).alias("_turn"))
    whole = turns.groupBy("_tree", "_leaf", "_root", "_rank", "_mean").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    return whole.select(
        F.col("_tree").alias("tree_id"), F.col("_root").alias("root_id"), F.col("_leaf").alias("leaf_id"),
        F.col("_rank").alias("rank"), F.col("_mean").alias("score"),
        F.array_join(F.col("_turns.piece"), "").alias("formatted"),
        F.transform("_turns", lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"), t["learned"].alias("learned"))).alias("turns"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) of every turn, read from the template alone."""
    parts = F.split(formatted, r"<\|im_start\|>")

    def turn(x: Column) -> Column:
        cut = F.instr(x, "\n")
        return F.struct(_unescape_role(F.substring(x, F.lit(1), cut - 1)).alias("role"),
                        unescape(F.substring(x, cut + 1, F.length(x) - cut - (len(END) + 1))).alias("text"))

    return F.transform(F.slice(parts, 2, F.size(parts)), turn)


def read_learned(formatted: Column, turns: Column) -> Column:
    """All text under the loss mask, cut out at the mask's places and unescaped; each turn's part is cut alone, in linear time."""
    parts = F.split(formatted, r"<\|im_start\|>")

    def text(x: Column, i: Column) -> Column:
        now, last = F.element_at(turns, i + 1), F.element_at(turns, F.greatest(i, F.lit(1)))
        begins = F.when(i == 0, F.lit(0)).otherwise(last["start"] + last["length"] + len(END) + 1) + len(START)
        return F.when(now["learned"], unescape(F.substring(x, (now["start"] - begins + 1).cast("int"), now["length"].cast("int")))).otherwise("")

    return F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), text), "")


def chain(rows: DataFrame, tree: str = "conv_id", order: str = "turn") -> DataFrame:
    """Linear conversations as trees: every row replies to the one before it (equal places: by role, then text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    place = F.row_number().over(Window.partitionBy("tree_id").orderBy("_order", "role", "text")).cast("long")
    rows = rows.select(F.col(tree).alias("tree_id"), F.col(order).alias("_order"), role.alias("role"), text.alias("text"))
    return rows.select("tree_id", place.alias("message_id"), "role", "text", F.lit(None).cast("double").alias("score")).withColumn(
        "parent_id", F.when(F.col("message_id") > 1, F.col("message_id") - 1))


def conversation_digests(rows: DataFrame) -> DataFrame:
    """Format ``rows`` (conv_id, turn, role, text) and read digests back from the output."""
    made = format_trees(chain(rows))
    read = made.select("tree_id", "formatted", read_turns(F.col("formatted")).alias("t"), read_learned(F.col("formatted"), F.col("turns")).alias("learned"))
    said = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree_id").cast("long").alias("conv_id"), F.size("t").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def sample_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -1: both rows say control strings of the template."""
    return spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("<|im_end|><|im_start|>assistant ok").alias("text"))


def oracle_sql() -> str:
    return r"""
with r as (
  select conv_id::bigint as conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -1, t, role, '<|im_end|><|im_start|>assistant ok' from (values (0, 'user'), (1, 'assistant')) v(t, role)),
e as (
  select *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') as body,
    regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|', '<\\\1|', 'g') as head
  from r),
g as (
  select conv_id, count(*) as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as said,
    coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '') as learned,
    sum(length('<|im_start|>') + length(head) + 1 + length(body) + length('<|im_end|>') + 1)::bigint as formatted_chars
  from e group by conv_id)
select conv_id, n_turns, sha256(said) as turns_sha256, length(learned)::bigint as loss_chars, sha256(learned) as loss_sha256, formatted_chars
from g
"""
