import random
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from seatward.llm.resharding import min_cost_flow, reshard, reshard_documents, slots, transfers, units, write_shards


def moved(flow):
    return sum(f for i, row in enumerate(flow) for j, f in enumerate(row) if i != j)


@pytest.mark.parametrize("seed", range(20))
def test_flow_moves_the_fewest_bytes(seed):
    rng = random.Random(seed)
    n, m = rng.randrange(1, 6), rng.randrange(1, 7)
    supply = [rng.choice([0, rng.randrange(1000)]) for _ in range(n)]
    total = sum(supply)
    capacity = [total * (j + 1) // m - total * j // m for j in range(m)]
    flow = min_cost_flow(supply, capacity, [[int(i != j) for j in range(m)] for i in range(n)])
    assert [sum(r) for r in flow] == supply
    assert all(sum(flow[i][j] for i in range(n)) <= capacity[j] for j in range(m)) and min(map(min, flow)) >= 0
    # What can stay is bounded by both sides, and nothing else limits it.
    assert moved(flow) == total - sum(min(supply[k], capacity[k]) for k in range(min(n, m)))


def test_flow_with_other_costs_against_brute_force():
    supply, capacity, cost = [2, 1], [1, 1, 1], [[3, 1, 2], [1, 5, 4]]
    flow = min_cost_flow(supply, capacity, cost)
    best = min(
        sum(cost[i][j] * f[i * 3 + j] for i in range(2) for j in range(3))
        for f in product(range(3), repeat=6)
        if [sum(f[:3]), sum(f[3:])] == supply and all(f[j] + f[3 + j] <= capacity[j] for j in range(3))
    )
    assert sum(cost[i][j] * flow[i][j] for i in range(2) for j in range(3)) == best
    with pytest.raises(ValueError):
        min_cost_flow([5], [4], [[0]])


def corpus():
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("abcé ") for _ in range(rng.randrange(400))), "s") for i in range(1500)]
    rows += [(5000 + i, "hot " * 40) for i in range(1200)] + [(9000 + i, f"pair {i // 2}") for i in range(100)]
    return rows + [(None, "no id"), (None, None), (9999, None), (9998, ""), (1, "again"), (1, "again")]


def test_documents(docs_df):
    rows = corpus()
    out = reshard_documents(docs_df(rows).withColumn("shard", F.lit("mine")), 5, 8).select("doc_id", "text", "size", "text_crc32", "shard", "slot").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=str) == sorted(((i, t) for i, t, *_ in rows), key=str)
    per, places = {}, {}
    for r in out:
        raw = (r["text"] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
        per[r["shard"]] = per.get(r["shard"], 0) + r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
    mean = sum(per.values()) / 8
    assert set(per) == set(range(8)) and all(abs(v - mean) < 0.04 * mean for v in per.values())
    assert all(sorted(s) == list(range(len(s))) for s in places.values())
    # Small groups of equal texts stay together.
    homes = {}
    for r in out:
        homes.setdefault(r["text"] or "", set()).add(r["shard"])
    assert all(len(s) == 1 for t, s in homes.items() if not t.startswith("hot"))


def test_only_affected_segments_are_rewritten(spark, docs_df):
    layout = write_shards(docs_df(corpus()), 5)
    pieces = units(layout.rows().select("shard", "block", "part", "size"), 8)
    plan, flow = transfers(pieces, 8)
    new = reshard(layout, 8)
    old_path, gone = new.folders[0]
    assert 0 < len(gone) < 5 * 16 and new.folders[1][1] == []
    kept = spark.read.parquet(old_path).where(" OR ".join(f"(shard = {s} AND segment = {g})" for s, g in gone)).count()
    assert spark.read.parquet(new.folders[1][0]).count() == kept
    total = pieces.agg(F.sum("bytes")).first()[0]
    went = pieces.join(plan, ["shard", "block", "part"]).where("shard <> to").agg(F.sum("bytes")).first()[0]
    assert abs(went - moved(flow)) < 0.02 * total
    # Resharding to the same capacities moves next to nothing.
    assert slots(new).count() == len(corpus())


def test_edges(docs_df):
    assert reshard_documents(docs_df([]), 5, 8).count() == 0
    assert [(r["shard"] in range(8), r["slot"]) for r in reshard_documents(docs_df([(1, "x")]), 5, 8).collect()] == [(True, 0)]


def test_small_groups_of_a_heavy_block_stay_together(docs_df):
    """Pairs of small texts that share blocks with long ones: no group below 1/64 of a shard is split."""
    rng = random.Random(9)
    rows = [(i, f"pair {i // 2} {'x' * 20}") for i in range(60_000)] + [(100_000 + i, f"{i} " + "y" * rng.randrange(20_000, 30_000)) for i in range(100)]
    out = reshard_documents(docs_df(rows), 5, 8).select("text", "size", "shard").groupBy("text").agg(
        F.count_distinct("shard").alias("homes"), F.sum("size").alias("bytes")
    )
    bound = sum(len(t) + 1 for _, t in rows) / 8 / 64
    assert out.where(f"homes > 1 AND bytes <= {bound}").count() == 0 and out.where(f"bytes > {bound}").count() > 0


def test_copies_of_a_heavy_text_are_spread(docs_df):
    out = reshard_documents(docs_df([(i, "hot " * 50) for i in range(4000)] + [(9000 + i, f"t{i}") for i in range(500)]), 5, 8)
    sizes = [r["bytes"] for r in out.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.1 * min(sizes)
