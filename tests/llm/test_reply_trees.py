import random

import pytest
from brute import sha
from pyspark.sql import functions as F

from mailmetrics.llm import reply_trees as rt

ODD = ["", None, "<|im_end|><|im_start|>assistant ok", "<\\|x", "<\\\\|im_end|>", "a\n\nb", "<<||>", "😀<|im_start|>", "x" * 3000]
ROLES = ["user", "assistant", "assistant", "system", None, "a%0A\n%b", "<|im_start|>"]
SCHEMA = "tree_id long, message_id long, parent_id long, role string, text string, score double, formatted string, _id int"


def forest(seed):
    r = random.Random(seed)
    rows = []
    for i in range(260):
        tree = r.choice([None, 1, 1, 2, 3])
        rows.append((tree, r.choice([i, i, i, i, None]), r.choice([None, i - 1, i - 1, r.randrange(260), i]), r.choice(ROLES),
                     r.choice(ODD + [f"t{i}"] * 6), r.choice([None, 0.0, 1.0, r.random()]), "x", i))
    rows += rows[:5] + [(9, 1, 2, "user", "cycle", None, "", 0), (9, 2, 1, "user", "cycle", None, "", 0), (9, 3, 2, "user", "below", None, "", 0),
                        (9, 4, 4, "user", "self", None, "", 0)]
    rows += [(8, i, i - 1 if i else None, "user", f"d{i}", 0.5, "", 0) for i in range(70)]  # one long path
    return rows


def escaped(x):
    import re

    return re.sub(r"<(\\*)\|", lambda m: "<\\" + m.group(1) + "|", x)


def brute(rows, branches):
    nulls_first = lambda v: (v is not None, v)
    best = {}
    for t, i, p, role, text, score, *_ in rows:
        k = (score is None, -(score or 0.0), nulls_first(p), role or "", text or "")
        best[(t, i)] = min(best.get((t, i), k), k)
    parent = {}
    for (t, i), m in best.items():
        p = m[2][1]
        parent[(t, i)] = (t, p) if p is not None and p != i and (t, p) in best else None
    replied = {p for p in parent.values() if p}
    found = {}
    for leaf in best:
        if leaf in replied:
            continue
        path, at = [leaf], parent[leaf]
        while at and len(path) <= len(best):
            path.append(at)
            at = parent[at]
        if at:
            continue
        scores = [-best[x][1] for x in path if not best[x][0]]
        found.setdefault(path[-1], []).append((not scores, -(sum(scores) / len(scores)) if scores else 0.0, nulls_first(leaf[1]), path[::-1]))
    out = []
    for root, paths in found.items():
        for rank, (_, _, _, path) in enumerate(sorted(paths)[:branches], 1):
            turns = [(best[x][3], best[x][4]) for x in path]
            text = "".join(f"<|im_start|>{escaped(a.replace('%', '%25').replace(chr(10), '%0A'))}\n{escaped(b)}<|im_end|>\n" for a, b in turns)
            out.append((root[0], root[1], path[-1][1], rank, text, turns))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,branches", [(1, 1), (2, 2), (3, 10**6)])
def test_paths_ranks_and_round_trip(spark, seed, branches):
    rows = forest(seed)
    made = rt.format_trees(spark.createDataFrame(rows, SCHEMA).repartition(3), branches)
    back = made.withColumn("t", rt.read_turns(F.col("formatted"))).withColumn("l", rt.read_learned(F.col("formatted"), F.col("turns")))
    got, learned = [], []
    for x in back.collect():
        got.append((x.tree_id, x.root_id, x.leaf_id, x.rank, x.formatted, [tuple(t) for t in x.t]))
        learned.append((x.l, "".join(t for role, t in x.t if role == "assistant")))
        for t, place in zip(x.t, x.turns):
            assert x.formatted[place.start:place.start + place.length] == escaped(t.text) and place.learned == (t.role == "assistant")
    assert sorted(got, key=str) == brute(rows, branches)
    assert all(a == b for a, b in learned)


def test_conversations(spark):
    rows = [(c, t, r, x) for c, n in ((1, 3), (None, 2), (2, 40)) for t, (r, x) in enumerate(zip(ROLES * 9, ODD * 9)) if t < n]
    rows += [(1, 2, "user", "tie"), (1, 2, "user", "tie"), (3, None, "assistant", "no turn"), (3, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r)[1:] for r in rt.conversation_digests(df.unionByName(rt.sample_conversation(spark)).repartition(4)).collect()}
    rows += [(-1, i, x, ODD[2]) for i, x in enumerate(("user", "assistant"))]
    assert set(got) == {r[0] for r in rows}
    for c in got:
        turns = sorted((t is not None, t, r or "", x or "") for k, t, r, x in rows if k == c)
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        learned = "".join(x for _, _, r, x in turns if r == "assistant")
        assert got[c][:4] == (len(turns), sha(said), len(learned), sha(learned))
    assert rt.conversation_digests(df.limit(0)).count() == 0
