import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from seatward.llm.prefix_trie import node_turns, numbered, op12_prefix_trie, prefix_trie, subtree_sums

TURNS = "conv_id long, turn long, role string, text string"
RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def sequences(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            out[c].append((turn is not None, turn or 0, role, digest, text))
    return {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in out.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        # The remainder has the sign of c, as in SQL.
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    out = []

    def visit(path):
        below = [visit(p) for p in children[path]]
        mine = sorted(members[path])
        own = (len(mine) - 1) * (len(path[-1][1]) if path else 0)
        leaves, saved = sum(b[0] for b in below) or 1, own + sum(b[1] for b in below)
        ends = ",".join(str(c) for c in mine if len(convs[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((mine[0], len(path), parent, len(mine), len(below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if convs:
        visit(())
    return sorted(out, key=str)


def talk(seed, n=120):
    """Conversations that share beginnings, some of them wholly alike; keys around multiples of a hundred and below zero."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rng.choice([0, 100, 200]) + rng.randrange(-3, 40)
        if any(r[0] == c for r in rows):
            continue
        for i in range(rng.randrange(0, 9)):
            rows.append((c, i if rng.random() < 0.95 else None, rng.choice(["user", "user", None]), rng.choice(["hi", "hi", "hello", "", None, "ö" * 9])))
    return rows


@pytest.mark.parametrize(("seed", "limit"), [(1, None), (2, 3)])
def test_trie_against_brute_force(spark, rows_of, seed, limit):
    rows = talk(seed)
    df = spark.createDataFrame([*rows, (None, 1, "user", "lost")], TURNS).repartition(3)
    assert rows_of(prefix_trie(df, max_group_rows=limit), *RESULT) == brute(sequences(rows))


def test_query_rebuilds_conversations(spark, rows_of, tmp_path):
    rows = talk(3)
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows_of(op12_prefix_trie(spark, str(tmp_path)), *RESULT) == brute(rebuilt(sequences(rows)))


def test_long_hot_and_repeated(spark, rows_of):
    """One conversation of 300 turns, 300 alike, 300 that share the first turn only; repeated rows are turns of their own."""
    rows = [(1, i, "user", f"t{i}") for i in range(300)] + [(1, 300, "user", "again")] * 2
    rows += [(c, i, "user", "x" * (i + 1)) for c in range(1000, 1300) for i in range(3)]
    rows += [(c, i, "user", "x" if i == 0 else f"{c}") for c in range(2000, 2300) for i in range(2)]
    got = rows_of(prefix_trie(spark.createDataFrame(rows, TURNS)), *RESULT)
    assert got == brute(sequences(rows))


def test_empty_and_clashing_names(spark, rows_of):
    assert prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    rows = [(7, 0, None, None), (8, 0, "", "")]
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("mine") for c in ("conv", "pos", "digest", "id", "parent", "depth", "m1")})
    assert rows_of(prefix_trie(df), *RESULT) == brute(sequences(rows))


def test_order_of_turns(spark):
    rows = [(1, 2, "b", "y"), (1, 2, "a", "z"), (1, None, "c", "first"), (1, -4, "d", "second")]
    out = node_turns(prefix_trie(spark.createDataFrame(rows, TURNS)), spark.createDataFrame(rows, TURNS)).orderBy("depth").collect()
    assert [(r["role"], r["text"]) for r in out] == [(None, None), ("c", "first"), ("d", "second"), ("a", "z"), ("b", "y")]
    assert [r["pos"] for r in numbered(spark.createDataFrame(rows, TURNS)).orderBy("pos").collect()] == [1, 2, 3, 4]


def forest(kind, n, rng):
    if kind == "chain":
        return [None, *range(n - 1)]
    if kind == "star":
        return [None] + [0] * (n - 1)
    if kind == "broom":
        return [None, *range(n // 2 - 1), *[n // 2 - 1] * (n - n // 2)]
    return [None if rng.random() < 0.02 or i == 0 else rng.randrange(max(0, i - 5), i) for i in range(n)]


@pytest.mark.parametrize("kind", ["chain", "broom", "random"])
def test_contraction_of_any_shape(spark, rows_of, kind):
    rng = random.Random(kind)
    parents = forest(kind, 250, rng)
    names = rng.sample(range(10_000), 250)
    rows = [(names[i], None if p is None else names[p], rng.randrange(-5, 100), 1) for i, p in enumerate(parents)]
    want = {i: [rows[i][2], 1] for i in range(250)}
    for i in reversed(range(250)):
        if parents[i] is not None:
            for j in (0, 1):
                want[parents[i]][j] += want[i][j]
    df = spark.createDataFrame(rows, "id long, parent long, a long, b long")
    assert rows_of(subtree_sums(df, ["a", "b"]), "id", "a", "b") == sorted(((names[i], *v) for i, v in want.items()), key=str)


def test_contraction_of_nothing(spark):
    assert subtree_sums(spark.createDataFrame([], "id long, parent long, a long"), ["a"]).count() == 0
