"""The trie of conversation prefixes, and subtree totals by parallel tree contraction.

Turns are numbered inside their conversation and reduced to a digest each. A running combination of the digests marks every prefix,
so the nodes of the trie are a group-by, at any depth of conversation. Totals over subtrees come from contraction: each round
rakes all leaves (their totals are known and go into their parents) and compresses unary chains (an independent set of one-child
nodes is spliced out, each leaving what its total needs). Every round is one aggregation and two joins on unique keys over the nodes
still there, and a constant share of them goes, so a chain and a star both end after logarithmically many rounds. Then the rounds are
played back: each spliced node's total is its own part plus the total of the child it left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seatward.llm.common import new_folder, query, stored
from seatward.operators.ordered import SLICE, group_sizes, join_same_key, rank_rows, slice_by_range
from seatward.session import group_limit

# Turns at most that a conversation takes from the first one of its hundred.
HEAD = 6
# Keys of members that are joined to one string; longer lists are digested string by string.
CHUNK = 256


def numbered(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", max_group_rows: int | None = None
) -> DataFrame:
    """(conv, pos, digest, chars): turns numbered from 1 in their conversation, null turn first, ties by role and then by digest.

    A null role or text is empty. Rows without a conversation key belong to no conversation and are left out. Repeated rows are turns of their own.
    ``digest`` is the SHA-256 of role and text, ``chars`` the code points of the text; texts themselves go no further.
    """
    role_, text_ = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    narrow = turns.where(F.col(key).isNotNull()).select(
        F.col(key).alias("conv"),
        F.col(turn).isNotNull().alias("has_turn"),
        F.col(turn).alias("turn"),
        role_.alias("role"),
        F.unhex(F.sha2(F.concat(F.char_length(role_).cast("string"), F.lit(":"), role_, text_), 256)).alias("digest"),
        F.char_length(text_).cast("long").alias("chars"),
    )
    return rank_rows(narrow, ["conv"], ["has_turn", "turn", "role", "digest"], "pos", max_group_rows).select("conv", "pos", "digest", "chars")


def marked(sequences: DataFrame, max_group_rows: int | None = None) -> DataFrame:
    """(conv, pos, chars, m1, m2, x1, x2): m1 and m2 mark the first ``pos`` turns, m xor x the turns before.

    A turn's mark depends on its place, so that the exclusive-or of the first marks stands for the sequence; 120 bits keep sequences apart.
    """
    placed = F.sha2(F.concat(F.col("pos").cast("string").cast("binary"), F.lit(b":"), F.col("digest")), 256)
    lane = lambda at: F.conv(F.substring(placed, at, 15), 16, 10).cast("long")
    rows = sequences.select("conv", "pos", "chars", lane(1).alias("x1"), lane(16).alias("x2"))
    limit = group_limit(sequences.sparkSession, max_group_rows)
    largest, total = group_sizes(rows, ["conv"])
    upto = (Window.unboundedPreceding, 0)
    if largest <= limit:
        w = Window.partitionBy("conv").orderBy("pos").rowsBetween(*upto)
        return rows.select("*", F.bit_xor("x1").over(w).alias("m1"), F.bit_xor("x2").over(w).alias("m2"))
    sliced = slice_by_range(rows, ["conv"], ["pos"], limit, total)
    before = Window.partitionBy("conv").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    parts = sliced.groupBy("conv", SLICE).agg(F.bit_xor("x1").alias("p1"), F.bit_xor("x2").alias("p2"))
    offsets = parts.select(
        "conv", SLICE, *(F.coalesce(F.bit_xor(f"p{i}").over(before), F.lit(0).cast("long")).alias(f"b{i}") for i in (1, 2))
    )
    here = Window.partitionBy("conv", SLICE).orderBy("pos").rowsBetween(*upto)
    joined = join_same_key(sliced, offsets, ["conv", SLICE])
    return joined.select(
        "conv", "pos", "chars", "x1", "x2", *(F.bit_xor(f"x{i}").over(here).bitwiseXOR(F.col(f"b{i}")).alias(f"m{i}") for i in (1, 2))
    )


NODE = ["depth", "m1", "m2"]
_ROOT = {"depth": 0, "m1": 0, "m2": 0}


def _root_columns() -> list[Column]:
    return [F.lit(v).cast("long").alias(c) for c, v in _ROOT.items()]


def member_digests(ends: DataFrame, max_group_rows: int | None = None) -> DataFrame:
    """(depth, m1, m2, ends_sha256): digest of the decimal keys ``conv`` of each node, ascending, joined by commas.

    Keys are ranked inside their node (in slices where a node is large) and joined in pieces of ``CHUNK``; a task digests the pieces of a
    node one after the other and holds one Arrow batch of them.
    """
    ranked = rank_rows(ends, NODE, ["conv"], "at", max_group_rows)
    pieces = (
        ranked.groupBy(*NODE, F.floor((F.col("at") - 1) / CHUNK).alias("piece"))
        .agg(F.sort_array(F.collect_list("conv")).alias("keys"))
        .select(*NODE, "piece", F.array_join("keys", ",").alias("keys"))
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def done(found: list) -> pa.RecordBatch:
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(3)] + [pa.array([f[3] for f in found], pa.string())]
            return pa.RecordBatch.from_arrays(columns, [*NODE, "ends_sha256"])

        for batch in batches:
            found = []
            for *at, keys in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if at != node:
                    if node is not None:
                        found.append((*node, state.hexdigest()))
                    node, state = at, hashlib.sha256(keys.encode())
                else:
                    state.update(b"," + keys.encode())
            yield done(found)
        if node is not None:
            yield done([(*node, state.hexdigest())])

    ordered = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece")
    return ordered.mapInArrow(digest, "depth long, m1 long, m2 long, ends_sha256 string")


def trie(sequences: DataFrame, keys: DataFrame, max_group_rows: int | None = None) -> DataFrame:
    """The stored nodes of the trie, one row each: id, parent (an id), conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, chars
    (of the last turn), ends_sha256.

    ``sequences`` has (conv, pos, digest, chars) with pos 1, 2, 3 ... in each conversation; ``keys`` has every conversation once (conv), those
    without turns too. No conversations, no nodes.
    """
    rows = stored(marked(sequences, max_group_rows), "trie-rows")
    inner = rows.groupBy(F.col("pos").alias("depth"), "m1", "m2").agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars"),
        F.min(F.col("m1").bitwiseXOR(F.col("x1"))).alias("p1"), F.min(F.col("m2").bitwiseXOR(F.col("x2"))).alias("p2"),
    )
    top = keys.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    top = top.select(*_root_columns(), "conv_id", "n_convs", *(F.lit(None).cast("long").alias(c) for c in ("chars", "p1", "p2")))
    nodes = stored(inner.unionByName(top).withColumn("id", F.monotonically_increasing_id()), "trie-nodes")

    last = rows.groupBy("conv").agg(F.max(F.struct(F.col("pos").alias("depth"), "m1", "m2")).alias("end")).select("conv", "end.*")
    turnless = keys.join(last.select("conv"), "conv", "left_anti").select("conv", *_root_columns())
    ends = member_digests(last.unionByName(turnless), max_group_rows)

    above = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("m1").alias("p1"), F.col("m2").alias("p2"), F.col("id").alias("parent"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    # Many children of one parent are one hot key here; the parents are unique, so adaptive execution can split them.
    linked = nodes.where("depth > 0").join(above, ["depth", "p1", "p2"]).select(*NODE, "id", "conv_id", "n_convs", "chars", "parent", "parent_conv_id")
    root = nodes.where("depth = 0").select(*NODE, "id", "conv_id", "n_convs", "chars", *(F.lit(None).cast("long").alias(c) for c in ("parent", "parent_conv_id")))
    linked = stored(linked.unionByName(root), "trie-linked")
    children = linked.where("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("parent", "id")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    full = linked.join(children, "id", "left").join(ends, NODE, "left")
    return stored(
        full.select(
            "id", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.coalesce("chars", F.lit(0)).alias("chars"), F.coalesce("ends_sha256", none).alias("ends_sha256"),
        ),
        "trie",
    )


def subtree_sums(tree: DataFrame, values: list[str]) -> DataFrame:
    """(id, *values): for every node the sums of ``values`` over its subtree, itself included, by rake and compress.

    ``tree`` has unique ids, ``parent`` (an id, null for a root) and long values; a forest is fine, an empty table gives none. ``up_`` columns
    hold what spliced-out nodes between a node and its parent of the moment weigh.
    """
    spark = tree.sparkSession
    known = new_folder(spark, "tree-sums")
    solved = 0

    def keep(sums: DataFrame) -> None:
        nonlocal solved
        sums.write.parquet(f"{known}/part={solved:04d}")
        solved += 1

    schema = tree.select("id", *values).schema
    counted = tree.where("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("k")).withColumnRenamed("parent", "id")
    alive = tree.join(counted, "id", "left").select(
        "id", "parent", F.coalesce("k", F.lit(0)).alias("k"), *values, *(F.lit(0).cast("long").alias(f"up_{v}") for v in values),
        F.lit(None).cast("long").alias("gone"), *(F.lit(None).cast("long").alias(f"rest_{v}") for v in values),
    )
    alive = stored(alive, "tree-alive")
    rounds = []
    while True:
        rounds.append(alive)
        leaf = F.col("k") == 0
        # Rake: leaves go into their parents.
        raked = alive.where("parent IS NOT NULL").groupBy(F.col("parent").alias("of")).agg(
            F.count_if(~leaf).alias("left"), F.min(F.when(~leaf, F.col("id"))).alias("child"),
            *(F.sum(F.when(leaf, F.col(v) + F.col(f"up_{v}")).otherwise(F.lit(0))).alias(f"add_{v}") for v in values),
        )
        inner = alive.where(~leaf).join(raked, F.col("id") == F.col("of")).select(
            "id", "parent", F.col("left").alias("k"), "child", *((F.col(v) + F.col(f"add_{v}")).alias(v) for v in values), *(f"up_{v}" for v in values)
        )
        inner = stored(inner, "tree-inner")
        if inner.isEmpty():
            break
        # Compress: of one-child nodes those whose hash is less than that of both neighbours, so no two of them are neighbours.
        at = lambda c: F.xxhash64(F.col(c), F.lit(len(rounds)))
        chosen = F.coalesce((F.col("k") == 1) & (at("id") < at("parent")) & (at("id") < at("child")), F.lit(False))
        out = inner.where(chosen).select(
            F.col("child").alias("below"), F.col("id").alias("gone"), F.col("parent").alias("above"), *(F.col(v).alias(f"own_{v}") for v in values),
            *(F.col(f"up_{v}").alias(f"over_{v}") for v in values),
        )
        zero = F.lit(0).cast("long")
        alive = stored(
            inner.where(~chosen).join(out, F.col("id") == F.col("below"), "left").select(
                "id", F.coalesce("above", "parent").alias("parent"), "k", *values,
                *((F.col(f"up_{v}") + F.coalesce(F.col(f"own_{v}") + F.col(f"over_{v}"), zero)).alias(f"up_{v}") for v in values),
                "gone", *((F.col(f"own_{v}") + F.col(f"up_{v}")).alias(f"rest_{v}") for v in values),
            ), "tree-alive",
        )
    # Play back: what a round began with is known once the later rounds are.
    for alive in reversed(rounds):
        keep(alive.where("k = 0").select("id", *values))
        below = spark.read.schema(schema).parquet(f"{known}/part=*").select("id", *(F.col(v).alias(f"sum_{v}") for v in values))
        spliced = alive.where("gone IS NOT NULL").join(below, "id")
        keep(spliced.select(F.col("gone").alias("id"), *((F.col(f"rest_{v}") + F.col(f"sum_{v}")).alias(v) for v in values)))
    return spark.read.schema(schema).parquet(f"{known}/part=*")


def trie_totals(nodes: DataFrame) -> DataFrame:
    """The nodes with n_leaves (childless nodes of the subtree) and saved_tokens (code points that sharing the prefix saves in it)."""
    own = nodes.select(
        "id", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")
    )
    return nodes.join(subtree_sums(own, ["n_leaves", "saved_tokens"]), "id")


def prefix_trie(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", max_group_rows: int | None = None
) -> DataFrame:
    """The trie of the conversations as they are: one row a node, see ``trie`` and ``trie_totals``; ``node_turns`` adds role and text.

    Keys must be long. Null turns come first, null roles and texts are empty, rows without a key are in no conversation, tied turns are ordered by role and digest, repeated
    rows are turns of their own. An empty table gives no rows. Texts are read whole. Other columns are not looked at, whatever they are called.
    """
    sequences = stored(numbered(turns, key, turn, role, text, max_group_rows), "trie-turns")
    return trie_totals(trie(sequences, sequences.select("conv").distinct(), max_group_rows))


def node_turns(nodes: DataFrame, turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The nodes of ``prefix_trie`` with role and text of their last turn (null at the root), taken from the smallest member."""
    role_, text_ = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    digest = F.sha2(F.concat(F.char_length(role_).cast("string"), F.lit(":"), role_, text_), 256)
    rows = turns.where(F.col(key).isNotNull()).select(
        F.col(key).alias("conv"), F.col(turn).isNotNull().alias("has_turn"), F.col(turn).alias("turn"), role_.alias("role"), text_.alias("text"), digest.alias("d")
    )
    at = rank_rows(rows, ["conv"], ["has_turn", "turn", "role", "d"], "pos").select(
        F.col("conv").alias("conv_id"), F.col("pos").alias("depth"), "role", "text"
    )
    return nodes.join(at, ["conv_id", "depth"], "left")


def with_shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sequences, keys): conversation c rebuilt from the first h turns of conversation c - c % 100 and its own turns after its first h; h is the CRC-32 of c modulo 6.

    ``turns`` is the stored result of ``numbered``. At most a hundred keys share a head of at most five turns.
    """
    h = lambda c: F.crc32(c.cast("string").cast("binary")) % HEAD
    base = lambda c: c - c % 100
    keys = stored(turns.select("conv").distinct(), "trie-keys")
    heads = turns.where((F.col("conv") % 100 == 0) & (F.col("pos") < HEAD)).withColumnRenamed("conv", "base")
    lengths = heads.groupBy("base").agg(F.max("pos").alias("there"))
    wanted = keys.select("conv", base(F.col("conv")).alias("base"), h(F.col("conv")).alias("h"))
    shared = wanted.join(heads, "base").where("pos <= h").select("conv", "pos", "digest", "chars")
    own = turns.select("*", base(F.col("conv")).alias("base"), h(F.col("conv")).alias("h")).where("pos > h").join(lengths, "base", "left")
    own = own.select("conv", (F.col("pos") - F.col("h") + F.least("h", F.coalesce("there", F.lit(0)))).alias("pos"), "digest", "chars")
    return shared.unionByName(own), keys


CHECK = r"""
    WITH crc_table AS MATERIALIZED (SELECT list(CAST(list_reduce([n] || range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) AS UBIGINT) ORDER BY n) AS t
        FROM (SELECT unnest(range(256)) AS n)),
    ordered AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
            ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(concat(length(coalesce(role, '')), ':', role, text))) AS pos
        FROM conversations WHERE conv_id IS NOT NULL),
    keys AS (SELECT DISTINCT c FROM ordered),
    heads AS (SELECT c, CAST(xor(list_reduce([CAST(4294967295 AS UBIGINT)] || list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS UBIGINT)),
            lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) % 6 AS BIGINT) AS h FROM keys, crc_table),
    parts AS (SELECT k.c, 0 AS part, o.pos, o.role, o.text FROM heads k JOIN ordered o ON o.c = k.c - k.c % 100 AND o.pos <= k.h
        UNION ALL SELECT k.c, 1, o.pos, o.role, o.text FROM heads k JOIN ordered o ON o.c = k.c AND o.pos > k.h),
    turns AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS depth FROM parts),
    paths AS (SELECT c, depth, length(text) AS chars, list(struct_pack(r := role, t := text)) OVER (PARTITION BY c ORDER BY depth) AS path FROM turns),
    member AS (SELECT c, depth, chars, min(c) OVER (PARTITION BY depth, path) AS node FROM paths
        UNION ALL SELECT c, 0, 0, min(c) OVER () FROM keys),
    ends AS (SELECT m.depth, m.node, string_agg(CAST(m.c AS VARCHAR), ',' ORDER BY m.c) AS members
        FROM member m JOIN (SELECT c, max(depth) AS depth FROM member GROUP BY c) l USING (c, depth) GROUP BY ALL),
    nodes AS (SELECT depth, node, count(*) AS n_convs, min(chars) AS chars FROM member GROUP BY ALL),
    linked AS (SELECT n.*, m.node AS parent FROM nodes n LEFT JOIN member m ON m.c = n.node AND m.depth = n.depth - 1),
    children AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL),
    own AS (SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN children USING (depth, node)),
    sums AS (SELECT m.depth, m.node, count(*) FILTER (o.n_children = 0) AS n_leaves, sum((o.n_convs - 1) * o.chars) AS saved_tokens
        FROM own o JOIN member m ON m.c = o.node AND m.depth <= o.depth GROUP BY ALL)
    SELECT o.node AS conv_id, CAST(o.depth AS BIGINT) AS depth, o.parent AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves,
           CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.members, '')) AS ends_sha256
    FROM own o JOIN sums s USING (depth, node) LEFT JOIN ends e USING (depth, node)"""


@query("op12_prefix_trie", CHECK)
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = spark.read.parquet(f"{folder.rstrip('/')}/conversations.parquet")
    sequences, keys = with_shared_heads(stored(numbered(turns), "trie-turns"))
    out = trie_totals(trie(sequences, keys))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
