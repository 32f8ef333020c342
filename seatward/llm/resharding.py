"""Resharding by minimum-cost flow: the fewest bytes move from an old layout to new capacities, and only affected files are rewritten.

Shards are folders of segments, a segment holds a range of hash blocks, and equal texts fall in one block. The old shards' sizes and the new
capacities make a transport problem in which staying is free and moving a byte costs one; its graph has a node per shard, so it is
solved on the driver. Each old shard's blocks lie on a line by block number, and the flow cuts that line. Segments that no cut
touches keep their files. A block heavier than a small part of a shard is cut further, by more bits of the texts' hash; only rows of one text that
alone is that heavy are told apart by a hash of the key.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatward.llm.common import documents, new_folder, packed, query, stored, text_or_empty, unpacked

BLOCKS, SEGMENTS, PARTS = 1024, 16, 256
# A block, or a text with its copies, is heavy above this share of a shard; at most HEAVY of them a shard can be.
HEAVY = 64
OLD_SHARDS, NEW_SHARDS = 5, 8


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Integer flows from suppliers to receivers, all supply placed, at the least total cost: successive shortest paths.

    ``sum(capacity)`` must not be below ``sum(supply)``.
    """
    if sum(capacity) < sum(supply):
        raise ValueError("the capacities do not hold the supply")
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    room, price, near = {}, {}, {v: [] for v in range(n + m + 2)}

    def link(u: int, v: int, most: int, each: int) -> None:
        room[u, v], room[v, u], price[u, v], price[v, u] = most, 0, each, -each
        near[u].append(v)
        near[v].append(u)

    for i, s in enumerate(supply):
        link(source, i, s, 0)
        for j in range(m):
            link(i, n + j, s, cost[i][j])
    for j, c in enumerate(capacity):
        link(n + j, sink, c, 0)
    left = sum(supply)
    while left:
        far, before, queue = {source: 0}, {}, deque([source])
        while queue:
            u = queue.popleft()
            for v in near[u]:
                if room[u, v] and far[u] + price[u, v] < far.get(v, 1 << 62):
                    far[v], before[v] = far[u] + price[u, v], u
                    queue.append(v)
        path, v = [], sink
        while v != source:
            path.append((before[v], v))
            v = before[v]
        step = min(left, *(room[e] for e in path))
        for u, v in path:
            room[u, v] -= step
            room[v, u] += step
        left -= step
    return [[room[n + j, i] for j in range(m)] for i in range(n)]


@dataclass
class Layout:
    """Live files: folders of shard=/segment=, and in the older ones the segments that were since rewritten elsewhere."""

    spark: SparkSession
    schema: T.StructType
    folders: list[tuple[str, list[tuple[int, int]]]]

    def rows(self) -> DataFrame:
        out = None
        for path, gone in self.folders:
            df = self.spark.read.schema(self.schema).parquet(path)
            for shard, segment in gone:
                df = df.where((F.col("shard") != shard) | (F.col("segment") != segment))
            out = df if out is None else out.unionByName(df)
        return out


def _write(rows: DataFrame, path: str) -> None:
    """One folder per shard and segment. The exchange is split where a segment is much larger than others."""
    spread = rows.hint("rebalance", "shard", "segment").sortWithinPartitions("shard", "segment", "block")
    spread.write.option("compression", "zstd").partitionBy("shard", "segment").parquet(path)


def write_shards(
    docs: DataFrame, shards: int, text: str = "text", key: str = "doc_id", carry: list[str] | None = None, cut_for: int | None = None
) -> Layout:
    """First layout: the shard, block and part of a row follow from a hash of its text.

    Copies of a text that weigh more than 1/HEAVY of one of ``cut_for`` shards (``shards`` by default) have parts by a hash of the key.
    """
    hashed = F.xxhash64(text_or_empty(text))
    size = (F.octet_length(text_or_empty(text)) + 1).cast("long")
    sizes = docs.select(hashed.alias("h"), size.alias("size")).groupBy("h").agg(F.sum("size").alias("bytes"))
    bound = sizes.agg(F.sum("bytes") / (cut_for or shards) / HEAVY).scalar()
    # At most HEAVY texts a shard.
    heavy = stored(sizes.where(F.col("bytes") > bound).select("h", F.lit(True).alias("is_heavy")), "heavy-texts")
    by_key = F.pmod(F.xxhash64(F.col("key"), F.lit(9)), F.lit(PARTS))
    by_text = F.pmod(F.shiftright("h", 32), F.lit(PARTS))
    block = F.pmod(F.shiftright(hashed, 16), F.lit(BLOCKS)).cast("int")
    rows = docs.select(
        packed(docs, carry),
        F.col(key).alias("key"),
        hashed.alias("h"),
        size.alias("size"),
        F.crc32(text_or_empty(text).cast("binary")).alias("text_crc32"),
        F.pmod(hashed, F.lit(shards)).cast("int").alias("shard"),
        block.alias("block"),
        F.floor(block / (BLOCKS // SEGMENTS)).cast("int").alias("segment"),
    )
    rows = rows.join(F.broadcast(heavy), "h", "left").withColumn("part", F.when(F.col("is_heavy"), by_key).otherwise(by_text).cast("int")).drop("h", "is_heavy")
    path = new_folder(docs.sparkSession, "shards")
    _write(rows, path)
    return Layout(docs.sparkSession, rows.schema, [(path, [])])


def units(rows: DataFrame, shards: int) -> DataFrame:
    """(shard, block, part, bytes): what moves as a whole. Part is -1 for a whole block, and a number where a heavy block is cut.

    At most BLOCKS rows a shard, and PARTS for each of the few heavy blocks.
    """
    blocks = rows.groupBy("shard", "block").agg(F.sum("size").alias("bytes"))
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    heavy = [(r["shard"], r["block"]) for r in blocks.where(F.col("bytes") > total / shards / HEAVY).collect()]
    whole = blocks.select("shard", "block", F.lit(-1).alias("part"), "bytes")
    if not heavy:
        return whole
    listed = rows.sparkSession.createDataFrame(heavy, "shard int, block int")
    cut = rows.join(F.broadcast(listed), ["shard", "block"]).groupBy("shard", "block", "part").agg(F.sum("size").alias("bytes"))
    return whole.join(F.broadcast(listed), ["shard", "block"], "left_anti").unionByName(cut)


def transfers(pieces: DataFrame, shards: int) -> tuple[DataFrame, list[list[int]]]:
    """(shard, block, part, to) for every unit, and the flow: bytes from old shard i to new shard j, as planned."""
    sizes = {r["shard"]: r["bytes"] for r in pieces.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}
    old = max(sizes, default=-1) + 1
    supply = [sizes.get(i, 0) for i in range(old)]
    total = sum(supply)
    capacity = [total * (j + 1) // shards - total * j // shards for j in range(shards)]
    flow = min_cost_flow(supply, capacity, [[int(i != j) for j in range(shards)] for i in range(old)])
    ends = []
    for i, row in enumerate(flow):
        at = 0
        # What stays comes first on the line.
        for j in sorted(range(shards), key=lambda j: (j != i, j)):
            if row[j]:
                ends.append((i, at, at + row[j], j))
                at += row[j]
    line = Window.partitionBy("shard").orderBy("block", "part")
    placed = pieces.withColumn("middle", F.sum("bytes").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes") / 2)
    cuts = pieces.sparkSession.createDataFrame(ends, "old int, low long, high long, to int")
    found = placed.join(F.broadcast(cuts), (F.col("shard") == F.col("old")) & (F.col("middle") >= F.col("low")) & (F.col("middle") < F.col("high")))
    return found.select("shard", "block", "part", "to"), flow


def reshard(layout: Layout, shards: int) -> Layout:
    """The layout over ``shards`` shards of near equal bytes. Reads sizes first, then rewrites the segments that something leaves."""
    rows = layout.rows()
    plan = transfers(units(rows.select("shard", "block", "part", "size"), shards), shards)[0].cache()
    segment = F.expr(f"block DIV {BLOCKS // SEGMENTS}").cast("int")
    # At most SEGMENTS a shard.
    moved = [tuple(r) for r in plan.where("shard <> to").select("shard", segment.alias("segment")).distinct().collect()]
    if not moved:
        return layout
    touched = F.lit(False)
    for s, g in moved:
        touched |= (F.col("shard") == s) & (F.col("segment") == g)
    affected = rows.where(touched)
    # The plan is bounded by blocks and parts, not by rows.
    whole = F.broadcast(plan.where("part = -1").select("shard", "block", F.col("to").alias("to_whole")))
    cut = F.broadcast(plan.where("part >= 0").select("shard", "block", "part", F.col("to").alias("to_part")))
    new = (
        affected.join(whole, ["shard", "block"], "left")
        .join(cut, ["shard", "block", "part"], "left")
        .withColumn("shard", F.coalesce("to_part", "to_whole", "shard"))
        .select(*rows.columns)
    )
    path = new_folder(layout.spark, "shards")
    _write(new, path)
    plan.unpersist()
    return Layout(layout.spark, layout.schema, [(p, [*gone, *moved]) for p, gone in layout.folders] + [(path, [])])


def slots(layout: Layout) -> DataFrame:
    """Rows of the live files with ``slot``, their place in the shard from 0 on, without gaps.

    Counts per block and part give the offsets, so a window orders one part of one block at a time.
    """
    rows = layout.rows()
    parts = rows.groupBy("shard", "block", "part").agg(F.count(F.lit(1)).alias("rows"))
    blocks = parts.groupBy("shard", "block").agg(F.sum("rows").alias("in_block"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("ahead", F.coalesce(F.sum("in_block").over(before(Window.partitionBy("shard").orderBy("block"))), F.lit(0)))
    parts = parts.join(blocks.drop("in_block"), ["shard", "block"]).withColumn(
        "ahead", F.col("ahead") + F.coalesce(F.sum("rows").over(before(Window.partitionBy("shard", "block").orderBy("part"))), F.lit(0))
    )
    inside = Window.partitionBy("shard", "block", "part").orderBy("key", "text_crc32")
    return (
        rows.withColumn("inside", F.row_number().over(inside))
        .join(parts.drop("rows"), ["shard", "block", "part"])
        .withColumn("slot", (F.col("ahead") + F.col("inside") - 1).cast("long"))
    )


def reshard_documents(docs: DataFrame, old: int, new: int, text: str = "text", key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """Every row from the files of the new layout, with ``size``, ``text_crc32``, ``shard`` and ``slot``.

    Size is the text's UTF-8 bytes plus one; a null text has none. Equal texts stay together unless their group is heavier than 1/64 of a new
    shard. A text of any length is one row in one shard; one that is heavier than a shard's share makes that shard larger. Rows with a null key and repeated rows are placed like any other; an empty table gives no rows. Input columns named like a
    result column give way to it.
    """
    layout = reshard(write_shards(docs, old, text, key, carry, new), new)
    return unpacked(slots(layout), "size", "text_crc32", "shard", "slot")


@query("op9_reshard")
def op9_reshard(spark: SparkSession, folder: str) -> DataFrame:
    out = reshard_documents(documents(spark, folder), OLD_SHARDS, NEW_SHARDS)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
