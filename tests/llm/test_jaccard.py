import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from seatward.llm.common import WORD
from seatward.llm.components import components
from seatward.llm.jaccard import boundary, can_link, needed, near_duplicates, parity, partners, shared_lists, shingles


def brute_sets(rows):
    out = []
    for key, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(WORD, lower)
        out.append((key, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    return out


def brute(rows):
    sets = brute_sets(rows)
    above = list(range(len(sets)))

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    for i, j in combinations(range(len(sets)), 2):
        a, b = sets[i][1], sets[j][1]
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            above[root(i)] = root(j)
    low = {}
    for i, (key, _) in enumerate(sets):
        if key is not None:
            low[root(i)] = min(low.get(root(i), key), key)
    return sorted(((k, len(s), low.get(root(i)) if s else k) for i, (k, s) in enumerate(sets)), key=str)


def edited(rng, words, rate):
    return [rng.choice("qxz") * 4 if rng.random() < rate else w for w in words]


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(300)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, out = prose(60), []
    for _ in range(12):
        base = prose(rng.choice([6, 8, 9, 10, 12, 14, 20, 40, 120]))
        out += [edited(rng, base, r) for r in (0, 0, 0.01, 0.02, 0.03, 0.05, 0.1)]
        out += [base + prose(rng.randrange(1, 6)), base[: len(base) - rng.randrange(3)], [w.upper() for w in base]]
    out += [prose(rng.randrange(20, 90)) + passage for _ in range(15)]
    hot = prose(80)
    out += [edited(rng, hot, 0.015) for _ in range(60)] + [hot] * 20
    # Chains: each text linked with the next only.
    chain = prose(70)
    for i in range(12):
        out.append(chain[3 * i :] + prose(3 * i))
    out += [prose(k) for k in range(12)] * 2
    rows = [(i * 7 % 1009, " ".join(w)) for i, w in enumerate(out)]
    return rows + [(None, " ".join(hot)), (None, "only null"), (5000, None), (5001, ""), (5002, " \n"), (5003, "tie a b c d e"), (5003, "tie a b c d e")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_against_brute_force(docs_df, rows_of, seed):
    rows = corpus(seed)
    out = near_duplicates(docs_df(rows).repartition(4), carry=["doc_id"])
    assert rows_of(out, "doc_id", "n_shingles", "component_id") == brute(rows)


@pytest.mark.parametrize("small", [0, 4, 8])
def test_boundary_changes_nothing(docs_df, rows_of, monkeypatch, small):
    import seatward.llm.jaccard as module

    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(30)]
    bases = [[rng.choice(vocab) for _ in range(rng.randrange(5, 18))] for _ in range(25)]
    rows = [(i, " ".join(rng.choice(bases)[: rng.randrange(4, 18)] + rng.choice([[], ["tail"], ["x", "y"]]))) for i in range(250)]
    monkeypatch.setattr(module, "boundary", lambda sizes: small)
    assert rows_of(near_duplicates(docs_df(rows)), "doc_id", "n_shingles", "component_id") == brute(rows)


def test_lists_hold_shared_tokens_only(spark):
    ids = spark.range(60_000)
    postings = ids.select(
        F.xxhash64(F.when(F.col("id") % 9 == 0, F.lit(-1)).otherwise(F.col("id") % 50_000)).alias("token"),
        F.xxhash64(F.floor(F.col("id") / 2)).alias("vertex"), F.lit(50).cast("long").alias("n"), F.lit(60).alias("top"), (F.col("id") % 7).alias("rare"),
    ).repartition(3)
    postings = spark.createDataFrame(postings.toPandas(), postings.schema)
    want = postings.select("token", "vertex").distinct()
    want = want.join(want.groupBy("token").count().where("count > 1"), "token").select("token", "vertex")
    got = shared_lists(postings)
    assert sorted(map(tuple, got.select("token", "vertex").collect())) == sorted(map(tuple, want.collect()))
    hubs = got.groupBy("token").agg(F.countDistinct("hub").alias("hubs"), F.count_if(F.col("hub") == F.col("vertex")).alias("own"))
    assert hubs.where("hubs <> 1 OR own <> 1").count() == 0


def test_boundary_follows_cost():
    assert boundary({}) == 10 and 0 <= boundary({n: 1000 for n in range(1, 20)}) < 10
    assert all(needed(n, m) <= min(n, m) for n in range(1, 60) for m in partners(n))


def test_bitmaps_never_lose_a_link():
    rng = np.random.default_rng(3)
    for _ in range(500):
        n, m = int(rng.integers(1, 300)), 0
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        keep = a[rng.random(len(a)) < rng.uniform(0.6, 1)]
        b = np.unique(np.concatenate([keep, rng.integers(0, 2**64, int(rng.integers(0, max(1, n // 3))), dtype=np.uint64)]))
        m = len(b)
        if m and 4 * len(np.intersect1d(a, b)) >= 3 * len(np.union1d(a, b)):
            assert can_link(len(a), parity(a), m, parity(b))
    x, y = (np.unique(rng.integers(0, 2**64, 400, dtype=np.uint64)) for _ in range(2))
    assert not can_link(len(x), parity(x), len(y), parity(y))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(-5, 7), (9000, 9000)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in [*range(61), -5]} == {-5} and {got[1000 + i] for i in range(300)} == {1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_clashing_and_long(docs_df):
    assert near_duplicates(docs_df([])).count() == 0
    long_text = " ".join(f"word{i}" for i in range(30_000))
    df = docs_df([(1, long_text), (2, long_text + " tail"), (3, None)]).withColumns({"n": F.lit("n"), "vertex": F.lit(0), "component_id": F.lit("c")})
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n"]) for r in near_duplicates(df).collect())
    assert got == [(1, 29_996, 1, "n"), (2, 29_997, 1, "n"), (3, 0, 3, "n")]
    assert len(shingles("a b c d e f")) == 2


def test_links_against_brute_force(docs_df, monkeypatch):
    import seatward.llm.jaccard as module

    monkeypatch.setattr(module, "BLOCK_SETS", 7)
    monkeypatch.setattr(module, "COLUMNS", 50)
    rows = [(i, text) for i, (_, text) in enumerate(corpus(4))]
    sets = brute_sets(rows)
    link = lambda a, b: bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)
    want = {k: sum(link(a, b) for i, b in sets if i != k) for k, a in sets}
    out = near_duplicates(docs_df(rows).repartition(4), carry=["doc_id"])
    assert {r["doc_id"]: r["n_links"] for r in out.collect()} == want
    members, links = module.linked_sets(docs_df(rows))
    of = {r["key"]: r["vertex"] for r in members.collect()}
    got = [(r["a"], r["b"]) for r in links.collect()]
    pairs = {tuple(sorted((of[i], of[j]))) for (i, a), (j, b) in combinations(sets, 2) if link(a, b) and of[i] != of[j]}
    assert len(got) == len(set(got)) and set(got) == pairs
