"""The prefix trie against all prefixes of all conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import trie
from tidemark.llm.trie import prefix_trie

COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
SCHEMA = "conv_id long, turn long, role string, text string, depth int, `a.b` string"


def plain_trie(rows, branch):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + v[h:]) if branch else tuple(v)
    members = defaultdict(list)
    for c, q in built.items():
        for d in range(len(q) + 1):
            members[q[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for q in members:
        if q:
            children[q[:-1]] += 1
    for q, m in members.items():
        for d in range(len(q) + 1):
            saved[q[:d]] += (len(m) - 1) * (len(q[-1][1].encode()) if q else 0)
            leaves[q[:d]] += not children[q]
    sha = lambda q, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if built[c] == q).encode()).hexdigest()
    return sorted(((min(m), len(q), min(members[q[:-1]]) if q else None, len(m), children[q], leaves[q], saved[q], sha(q, m)) for q, m in members.items()), key=str)


def made(spark, rows, branch):
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA)
    return sorted((tuple(r[c] for c in COLUMNS) for r in prefix_trie(df, branch=branch).collect()), key=str)


def conversations(r, n, most):
    return [(c, t, r.choice(["u", "a", None]), r.choice(["x", "yy", "é", None, "x"])) for c in range(n) for t in range(r.choice(range(most)))]


@pytest.mark.parametrize("branch", [True, False])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nodes_are_those_of_all_prefixes(spark, seed, branch):
    rows = conversations(random.Random(seed), 150, 12)
    assert made(spark, rows, branch) == plain_trie(rows, branch)


@pytest.mark.parametrize("tasks", [1, 2, 13, 60])
def test_copies_and_long_shared_paths_over_many_tasks(spark, tasks, monkeypatch):
    """Copies of one conversation, prefixes of it and branches deep below lie in several tasks; pieces of members are a few numbers long."""
    monkeypatch.setattr(trie, "PIECE", 200)
    same = [("u", "same"), ("a", "é"), ("u", ""), ("a", "same")]
    rows = [(c, t, *same[t % 4]) for c in range(120) for t in range(40)] + [(200 + c, t, *same[t % 4]) for c in range(60) for t in range(c)] + [(400 + c, t, *(same[t % 4] if t < 35 else ("u", str(c)))) for c in range(40) for t in range(37)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert made(spark, rows, False) == plain_trie(rows, False)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_odd_rows_of_conversations(spark):
    """Null turns come first, null roles and texts are empty, rows without conversation are left out, repeated rows are turns, ties go by role."""
    rows = [(1, None, None, None), (1, 0, "u", "x"), (1, 0, "u", "x"), (2, 0, "u", ""), (2, None, "", ""), (None, 0, "u", "x"), (7, 3, "b", "t"), (7, 3, "a", "t"), (8, 1, "u", "w" * 200_000), (10**12, 1, "u", "x")]
    assert made(spark, rows, False) == plain_trie(rows, False)
    assert made(spark, rows, True) == plain_trie(rows, True)
    assert made(spark, [], True) == []
    assert made(spark, [(None, 1, "u", "x")], True) == []
