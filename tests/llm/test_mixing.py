import random
import re
from collections import Counter, defaultdict
from math import comb

import pytest
from pyspark.sql import functions as F

from seatward.llm.common import WORD
from seatward.llm.mixing import hypergeometric, mix_sources, mixed_rows, shuffled_shards, source_targets, splitting_tree


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Share by weight, cap, reshare the excess, until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8", "surrogatepass")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = float(sum(sizes.values())), {}
    while True:
        left = total - sum(capped.values())
        free = [s for s in names if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= most * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: float(most * sizes[s]) for s in over}


def words(text):
    return len(re.findall(WORD, text or ""))


def corpus(seed, n=400):
    rng = random.Random(seed)
    names = ["hot"] * 6 + ["a", "b", "é", "z", None, "tiny"]
    rows = []
    for i in range(n):
        source = rng.choice(names)
        length = 0 if source == "tiny" and i % 2 else int(rng.paretovariate(1.2) * 10)
        rows.append((i, " ".join(rng.choice("xyz") * 3 for _ in range(length)), source))
    return rows + [(n, None, "a"), (None, "one two three", "b"), (5, "twice", "b"), (5, "twice", "b")]


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 5, "c": 1000, None: 7}, {"a": 0, "b": 10}, {"a": 0}, {"only": 12}, {"z": 3, "é": 900, "Z": 50, "": 4},
])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_hits_targets_and_reruns_agree(docs_df, rows_of, seed):
    rows = corpus(seed)
    df = docs_df(rows)
    out = mix_sources(df, carry=["doc_id", "source"])
    got = out.collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += words(text)
    want = brute_targets(sizes)
    taken = Counter()
    for r in got:
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * len(r["shards"])
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(5, 0.01 * want[s]), (s, taken[s], want[s])
    again = mix_sources(df.repartition(3), carry=["doc_id", "source"])
    assert rows_of(again, "doc_id", "taken") == rows_of(out, "doc_id", "taken")


def test_mixed_rows_are_the_draws_and_keep_the_columns(docs_df):
    df = docs_df(corpus(3)).withColumns({"size": F.lit("mine"), "row": F.lit(1), "target": F.lit(None).cast("int")})
    out = mixed_rows(df)
    assert out.columns == [*df.columns, "shard", "mix_order"]
    drawn = mix_sources(df, carry=["doc_id"]).agg(F.sum(F.size("shards"))).first()[0]
    assert out.count() == drawn and set(r["size"] for r in out.select("size").collect()) == {"mine"}
    assert {r["shard"] for r in out.collect()} == set(range(8))


def test_empty(docs_df):
    assert mix_sources(docs_df([])).count() == 0
    assert [(r["taken"], r["target"]) for r in mix_sources(docs_df([(1, None), (2, "")])).collect()] == [(0, 0.0), (0, 0.0)]


def test_tree_splits_exactly(spark):
    quota = [0, 1, 7, 5000, 300]
    one = spark.createDataFrame([(quota,)], "quota array<long>")
    leaves = {r["shard"]: r["quota"] for r in splitting_tree(one, 8, 3).collect()}
    assert sorted(leaves) == list(range(8))
    assert [sum(q[i] for q in leaves.values()) for i in range(5)] == quota
    totals = [sum(q) for q in leaves.values()]
    assert max(totals) - min(totals) <= 1 and min(min(q) for q in leaves.values()) >= 0


def test_hypergeometric_distribution(spark):
    pool, good, draws, n = 30, 12, 9, 40_000
    expr = hypergeometric(str(pool), str(good), str(draws), f"((id + 0.5D) / {n}D)")
    got = Counter(r["x"] for r in spark.range(n).select(F.expr(expr).alias("x")).collect())
    for x in range(draws + 1):
        mass = comb(good, x) * comb(pool - good, draws - x) / comb(pool, draws)
        assert abs(got[x] / n - mass) < 1e-3


def test_missing_words_go_past_the_block_of_a_large_document(spark, docs_df):
    # About half of a is drawn; a third of it is one document, in one of the middle ones of eight blocks.
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(20, 180), "a") for i in range(600)]
    large = "w " * (sum(words(t) for _, t, _ in rows) // 2)
    hashed = lambda seed: F.pmod(F.xxhash64(F.lit(seed).cast("long"), F.lit(9000).cast("long"), F.lit(large)), F.lit(8 * 512))
    blocks = spark.range(1).select(*(hashed(seed).alias(f"s{seed}") for seed in range(40))).first()
    seed = next(s for s, block in enumerate(blocks) if block // 512 == 3)
    df = docs_df([*rows, (9000, large, "a"), *((10_000 + i, "w " * 100, "b") for i in range(50))])
    out = mix_sources(df, carry=["doc_id", "source"], weights=(1, 1), max_repeat=20, seed=seed)
    got = [r for r in out.collect() if r["source"] == "a"]
    assert 0.4 < got[0]["target"] / got[0]["source_size"] < 0.6
    assert abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 20


def test_shards_are_shuffled_in_slices(docs_df):
    """Every row once; each task holds whole ranges of a shard's order, and has them in order."""
    mixed = mixed_rows(docs_df(corpus(4, 900)))
    out = shuffled_shards(mixed, 4).withColumn("task", F.spark_partition_id()).withColumn("line", F.monotonically_increasing_id()).collect()
    assert len(out) == mixed.count()
    unsigned = lambda r: r["mix_order"] % (1 << 64)
    homes = {}
    for r in out:
        homes.setdefault((r["shard"], unsigned(r) >> 62), set()).add(r["task"])
    assert all(len(h) == 1 for h in homes.values()) and len(homes) == 32
    for place in homes:
        lines = [r for r in sorted(out, key=lambda r: r["line"]) if (r["shard"], unsigned(r) >> 62) == place]
        assert [r["mix_order"] for r in lines] == sorted(r["mix_order"] for r in lines)
    # The order is not the input's.
    first = [r["doc_id"] for r in sorted(out, key=lambda r: r["line"]) if r["doc_id"] is not None]
    assert first != sorted(first)
