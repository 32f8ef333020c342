"""Mixing sources to target weights, from exact block quotas that a splitting tree deals out to output shards.

Rows of a source fall by hash into blocks, so the block order is a random permutation of the source. A source takes all its
blocks as often as its target holds its size, and a leading part of them once more. That makes an exact number of block
draws (the quota) per source. A binary tree halves the vector of quotas again and again: the left half of a node gets a
multivariate hypergeometric draw, which is what a random deal without replacement gives. At the leaves each shard owns
disjoint ranges of every source's draws, and orders its own rows by hash. All of it is SQL on a table of
(source, block) totals; texts are only read, joined with that table, and never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seatward.llm.common import WORD, documents, packed, query, stored, text_or_empty, unpacked

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SHARDS = 8
# Ranges of a shard's order that tasks shuffle side by side.
SLICES = 16
SEED = 7
# Blocks a source can have, and rows below which a block is not split further.
MAX_BLOCKS = 4096
BLOCK_ROWS = 64
# Passes that fill what is left of a target inside a block that is not taken whole.
FILL_PASSES = 6
# Rows of the plan (about 100 bytes each) up to which it is broadcast.
MAX_BROADCAST_ROWS = 200_000
# Orders of that block's rows that are tried.
ATTEMPTS = 24


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Targets per source: shares of the total by weight, never above ``max_repeat`` times the source's size.

    ``sizes`` has ``source`` and ``source_size``. Sources in code point order, null last, take the weights in turn. What a
    source cannot take goes to the others by weight. In the order of size over weight the capped sources are a prefix, so one running
    sum finds the level at which the rest fill. There is one row per source, so the windows are over that list only.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    all_rows = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "number").rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        sizes.withColumn("number", F.row_number().over(order))
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
        .withColumn("total", F.sum("source_size").over(all_rows).cast("double"))
        .withColumn("all_weights", F.sum("weight").over(all_rows))
        .withColumn(
            "level",
            (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
            / (F.col("all_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
        )
        .withColumn("open", F.col("cap") > F.col("weight") * F.col("level"))
    )
    rank = F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "number", "level"))
    return levels.withColumn("fill", F.min(rank).over(all_rows)["level"]).select(
        "source", "source_size", "number",
        F.least("cap", F.coalesce(F.col("weight") * F.col("fill"), F.col("cap"))).alias("target"),
    )


# ln n!: exact below ten, Stirling's series above.
_LN_FACT = (
    "IF({n} < 10, element_at(array(0D, 0D, 0.6931471805599453D, 1.791759469228055D, 3.1780538303479458D, 4.787491742782046D,"
    " 6.579251212010101D, 8.525161361065415D, 10.604602902745251D, 12.801827480081469D), CAST({n} AS INT) + 1),"
    " {n} * ln(greatest({n}, 1)) - {n} + 0.9189385332046727D + 0.5D * ln(greatest({n}, 1))"
    " + 1D / (12D * greatest({n}, 1)) - 1D / (360D * pow(greatest({n}, 1), 3)))"
)


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def hypergeometric(pool: str, good: str, draws: str, uniform: str) -> str:
    """SQL for one hypergeometric draw by inversion: successes in ``draws`` of ``pool`` items, ``good`` of them successes.

    The support is cut at twelve standard deviations from the mean, beyond which the mass is below 1e-30.
    """
    fact = lambda n: _LN_FACT.format(n=n)
    log_mass = f"-({fact('x')}) - ({fact('(p.g - x)')}) - ({fact('(p.n - x)')}) - ({fact('(p.t - p.g - p.n + x)')})"
    spread = "(12D * sqrt(p.n * (p.g / p.t) * (1D - p.g / p.t)) + 2D)"
    mean = "(p.n * p.g / p.t)"
    low = f"greatest(0L, p.n + p.g - p.t, CAST(floor({mean} - {spread}) AS BIGINT))"
    high = f"least(p.n, p.g, CAST(ceil({mean} + {spread}) AS BIGINT))"
    pick = (
        "aggregate(m.w, named_struct('left', m.total * p.u, 'at', 0L, 'done', false), (a, w) -> IF(a.done, a, IF(a.left <= w,"
        " named_struct('left', 0D, 'at', a.at, 'done', true), named_struct('left', a.left - w, 'at', a.at + 1L, 'done', false)))).at"
    )
    summed = _let(
        "named_struct('w', v, 'total', aggregate(v, 0D, (a, w) -> a + w))", "m", f"{low} + least({pick}, size(m.w) - 1L)"
    )
    scaled = _let("transform(l, y -> exp(y - array_max(l)))", "v", summed)
    drawn = _let(f"transform(sequence({low}, {high}), x -> {log_mass})", "l", scaled)
    given = f"named_struct('t', CAST({pool} AS BIGINT), 'g', CAST({good} AS BIGINT), 'n', CAST({draws} AS BIGINT), 'u', {uniform})"
    return f"IF({pool} <= 0 OR {good} <= 0 OR {draws} <= 0, 0L, IF({draws} >= {pool}, CAST({good} AS BIGINT), {_let(given, 'p', drawn)}))"


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, quota): one row ``quotas`` with the array ``quota`` split over ``shards`` (a power of two) by the tree.

    Shards get equally many draws (one more or less), sources exactly their quota over all shards.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    nodes = quotas.select(
        F.lit(0).cast("long").alias("node"), "quota", F.expr("aggregate(quota, 0L, (a, q) -> a + q)").alias("all_draws")
    )
    width = shards
    while width > 1:
        half = width // 2
        edge = lambda j: f"((node * {width} + {j}) * all_draws DIV {shards})"
        draw = hypergeometric(
            "a.pool", "quota[i]", "a.draws", f"(shiftrightunsigned(xxhash64({seed}L, {width}L, node, i), 11) / 9007199254740992D)"
        )
        step = _let(
            draw, "x",
            "named_struct('pool', a.pool - quota[i], 'draws', a.draws - x, 'out', array_append(a.out, x))",
        )
        nodes = nodes.withColumn(
            "first",
            F.expr(
                f"aggregate(sequence(0, size(quota) - 1), named_struct('pool', {edge(width)} - {edge(0)},"
                f" 'draws', {edge(half)} - {edge(0)}, 'out', CAST(array() AS ARRAY<BIGINT>)), (a, i) -> {step}).out"
            ),
        )
        nodes = nodes.select(
            "all_draws",
            F.posexplode(F.array("first", F.expr("zip_with(quota, first, (q, x) -> q - x)"))).alias("side", "part"),
            "node",
        ).select((F.col("node") * 2 + F.col("side")).alias("node"), F.col("part").alias("quota"), "all_draws")
        width = half
    return nodes.select(F.col("node").cast("int").alias("shard"), "quota")


def _with_block(docs: DataFrame, text: str, source: str, key: str, seed: int, carry: list[str] | None) -> DataFrame:
    hashed = F.xxhash64(F.lit(seed).cast("long"), F.col(key), F.col(text))
    return docs.select(
        packed(docs, carry),
        F.col(source).alias("source"),
        F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long").alias("size"),
        hashed.alias("h"),
        F.pmod(hashed, F.lit(MAX_BLOCKS)).cast("int").alias("block"),
    )


SOURCE = ["no_source", "source_name"]
SAME_BLOCK = [*SOURCE, "block"]
# A row of a wide block; equal ones are copies.
ITEM = [*SOURCE, "at", "block", "h", "size"]


def _keyed(df: DataFrame) -> DataFrame:
    """A null source as two plain join columns."""
    return df.withColumns({"no_source": F.col("source").isNull(), "source_name": F.coalesce("source", F.lit(""))})


def block_plan(rows: DataFrame, shards: int, seed: int, weights: tuple[int, ...], max_repeat: int) -> tuple[DataFrame, DataFrame]:
    """Per (source, block): the shards that draw it (one entry a draw), and up to which size its rows have the extra draw; and single rows that have it.

    ``rows`` has source, block, size and h. The plan has at most ``MAX_BLOCKS`` rows a source. What is missing when a target ends inside a block is carried on
    over the rows that are not drawn yet.
    """
    blocks = stored(
        rows.groupBy("source", "block").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")), "mix-blocks"
    )
    sources = blocks.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("rows").alias("rows"))
    targets = source_targets(sources.drop("rows"), weights, max_repeat)
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(max_repeat).cast("long"), F.floor(F.col("target") / F.col("source_size"))))
    per_source = stored(
        _keyed(targets)
        .join(_keyed(sources).select("no_source", "source_name", "rows"), ["no_source", "source_name"])
        .withColumn("passes", F.coalesce(whole, F.lit(0)).cast("long"))
        .withColumn("rest", F.round("target").cast("long") - F.col("passes") * F.col("source_size"))
        # A power of two of wide blocks, so that one has about BLOCK_ROWS rows.
        .withColumn(
            "wide",
            F.least(F.lit(MAX_BLOCKS).cast("long"), F.expr(f"CAST(pow(2, floor(log2(greatest(1, rows / {BLOCK_ROWS})))) AS BIGINT)")),
        ),
        "mix-sources",
    )
    fine = _keyed(blocks).join(per_source.drop("source", "rows"), ["no_source", "source_name"]).withColumn(
        "at", F.expr(f"block * wide DIV {MAX_BLOCKS}")
    )
    wide = fine.groupBy(*SOURCE, "at").agg(
        F.sum("words").alias("words"),
        *(F.first(c).alias(c) for c in ("rest", "passes", "number", "wide")),
    )
    in_source = Window.partitionBy(*SOURCE).orderBy("at")
    wide = (
        wide.withColumn("index", F.row_number().over(in_source).cast("long") - 1)
        .withColumn("upto", F.sum("words").over(in_source.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("whole_extra", (F.col("upto") <= F.col("rest")) & (F.col("rest") > 0))
        .withColumn("cut", (F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
        .withColumn("left", F.col("rest") - F.col("upto") + F.col("words"))
        .withColumn("blocks", F.count(F.lit(1)).over(Window.partitionBy(*SOURCE)))
    )
    wide = stored(wide, "mix-wide")
    cut = _small(stored(wide.where("cut").select(*SOURCE, F.col("at").alias("cut_at"), "wide", "left"), "mix-cut"))
    undrawn = (
        _keyed(rows).join(cut, SOURCE).withColumn("at", F.expr(f"block * wide DIV {MAX_BLOCKS}")).where("at >= cut_at AND size > 0")
        .groupBy(*ITEM).agg(F.count(F.lit(1)).alias("copies"), F.first("left").alias("left"))
    )
    limits, picks = _carried(stored(undrawn, "mix-undrawn"), cut.select(*SOURCE, "left"))
    touched = limits.select(*SOURCE, "at").union(picks.select(*SOURCE, "at")).distinct().withColumn("touched", F.lit(True))
    # Blocks with an extra draw, in block order; from the one in which the target ends on, those that gave rows.
    wide = stored(
        wide.join(touched, [*SOURCE, "at"], "left")
        .join(limits, [*SOURCE, "at"], "left")
        .withColumn("extra", F.col("whole_extra") | F.coalesce("touched", F.lit(False)))
        .withColumn("extra_index", F.sum(F.col("extra").cast("long")).over(in_source.rowsBetween(Window.unboundedPreceding, 0)) - 1)
        # Rows up to this size have the extra draw.
        .withColumn("upto_size", F.when(F.col("whole_extra"), F.lit(2**63 - 1)).otherwise(F.coalesce("limit", F.lit(-1)))),
        "mix-extra",
    )
    quota = wide.groupBy("number").agg((F.first("passes") * F.count(F.lit(1)) + F.count_if("extra")).alias("draws"))
    one = quota.agg(F.transform(F.sort_array(F.collect_list(F.struct("number", "draws"))), lambda s: s["draws"]).alias("quota"))
    leaves = splitting_tree(one, shards, seed)
    # Where each shard's range of draws ends, per source.
    ends = (
        leaves.select("shard", F.posexplode("quota").alias("at_source", "draws"))
        .withColumn("end", F.sum("draws").over(Window.partitionBy("at_source").orderBy("shard")))
        .groupBy((F.col("at_source") + 1).alias("number"))
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "end"))), lambda s: s["end"]).alias("ends"))
    )
    owner = lambda draw: f"size(filter(ends, e -> e <= {draw}))"
    dealt = wide.join(ends, "number").select(
        *SOURCE, "at", "upto_size",
        F.expr(
            f"IF(passes > 0, transform(sequence(0L, passes - 1L), p -> {owner('p * blocks + index')}), CAST(array() AS ARRAY<INT>))"
        ).alias("shards"),
        F.expr(owner("passes * blocks + extra_index")).alias("extra_shard"),
    )
    plan = fine.join(dealt, [*SOURCE, "at"]).select(*SAME_BLOCK, "target", "source_size", "upto_size", "extra_shard", "shards")
    return plan, picks


def _small(df: DataFrame) -> DataFrame:
    """Broadcast up to the checked size; beyond it ``df`` is shuffled like any table."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df


def _carried(undrawn: DataFrame, left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(limits, picks): which rows have an extra draw, from the block in which a target ends on.

    ``undrawn`` has the rows (``ITEM``, copies) from that block on, ``left`` the words still missing per source. Rows larger than what is
    left are skipped. Blocks go whole in block order while the rest of their rows fits, as a limit of size per (source, at); the block in which the
    target ends now is filled row by row (picks: ``ITEM``, copies, take). That is repeated with what is left until no undrawn row of the source fits. At
    last the smallest undrawn row goes in if that brings the sum nearer.
    """
    limits, picks = [], []
    items = undrawn.where("size <= left")
    while True:
        in_source = Window.partitionBy(*SOURCE).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        sums = items.groupBy(*SOURCE, "at").agg(F.sum(F.col("size") * F.col("copies")).alias("words"), F.first("left").alias("left"))
        sums = sums.withColumn("upto", F.sum("words").over(in_source)).withColumn("before", F.col("upto") - F.col("words"))
        sums = stored(sums.where("before < left"), "mix-carried")
        limits.append(sums.where("upto <= left").select(*SOURCE, "at", F.col("left").alias("limit")))
        last = sums.where("upto > left").select(*SOURCE, "at", (F.col("left") - F.col("before")).alias("left"))
        filled = stored(_fill(items.drop("left").join(last, [*SOURCE, "at"])), "mix-filled")
        picks.append(filled.where("chosen").select(*ITEM))
        # What is left per source: after the filled block, or after the blocks that went whole.
        now = sums.groupBy(*SOURCE).agg(
            (F.first("left") - F.max(F.when(F.col("upto") <= F.col("left"), F.col("upto")).otherwise(0))).alias("after")
        ).join(filled.groupBy(*SOURCE).agg(F.first("left").alias("filled")), SOURCE, "left").select(
            *SOURCE, F.coalesce("filled", "after").alias("now")
        )
        now = stored(now, "mix-now")
        left = stored(left.join(now, SOURCE, "left").select(*SOURCE, F.coalesce("now", "left").alias("left")), "mix-left")
        behind = items.drop("left").join(sums.select(*SOURCE, "at"), [*SOURCE, "at"], "left_anti")
        over = filled.where("NOT chosen").groupBy(*ITEM).agg(F.count(F.lit(1)).alias("copies"))
        items = behind.unionByName(over).join(_small(left), SOURCE).where("size <= left")
        items = stored(items, "mix-undrawn")
        if items.isEmpty():
            break
    all_limits, all_picks = limits[0], picks[0]
    for more_limits, more_picks in zip(limits[1:], picks[1:], strict=True):
        all_limits, all_picks = all_limits.union(more_limits), all_picks.union(more_picks)
    all_limits = stored(all_limits.groupBy(*SOURCE, "at").agg(F.max("limit").alias("limit")), "mix-limits")
    taken = stored(all_picks.groupBy(*ITEM).agg(F.count(F.lit(1)).alias("take")), "mix-taken")
    nearer = (
        undrawn.drop("left").join(_small(left), SOURCE).where("size < 2 * left")
        .join(all_limits, [*SOURCE, "at"], "left").where("limit IS NULL OR size > limit")
        .join(taken, ITEM, "left").where("copies > coalesce(take, 0)")
        .groupBy(*SOURCE).agg(F.min(F.struct("size", "h", "at", "block")).alias("least"))
        .select(*SOURCE, "least.at", "least.block", "least.h", "least.size", F.lit(1).cast("long").alias("take"))
    )
    takes = taken.unionByName(nearer).groupBy(*ITEM).agg(F.sum("take").alias("take"))
    return all_limits, stored(takes.join(undrawn.drop("left"), ITEM), "mix-picks")


def _fill(cut: DataFrame) -> DataFrame:
    """Rows of the blocks in which a target ends (``ITEM``, one row a copy), with ``chosen``, and ``left`` after it.

    Several orders of a block's rows are tried, the first by size, the others random; the one that ends nearest counts. Each pass takes a leading run of
    the rows that still fit.
    """
    source = Window.partitionBy(*SOURCE, "attempt")
    order = source.orderBy("turn", "h", "size", "copy").rowsBetween(Window.unboundedPreceding, 0)
    df = cut.withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).drop("copies")
    df = df.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)))).withColumn("chosen", F.lit(False))
    df = df.withColumn("turn", F.when(F.col("attempt") == 0, -F.col("size")).otherwise(F.xxhash64("h", "attempt")))
    for _ in range(FILL_PASSES):
        fits = ~F.col("chosen") & (F.col("size") <= F.col("left")) & (F.col("size") > 0)
        df = df.withColumn("fits", fits).withColumn("run", F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0)).over(order))
        df = df.withColumn("now", F.col("fits") & (F.col("run") <= F.col("left")))
        df = df.withColumn("left", F.col("left") - F.sum(F.when(F.col("now"), F.col("size")).otherwise(0)).over(source))
        df = df.withColumn("chosen", F.col("chosen") | F.col("now"))
    best = F.min(F.struct("left", "attempt")).over(Window.partitionBy(*SOURCE))["attempt"]
    return df.withColumn("best", best).where("attempt = best").select(*ITEM, "copy", "left", "chosen")


def mix_sources(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    carry: list[str] | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    max_repeat: int = MAX_REPEAT,
    shards: int = SHARDS,
    seed: int = SEED,
) -> DataFrame:
    """Every row with ``size``, ``source_size``, ``target``, ``taken`` (words, repeats counted) and ``shards``, one entry a draw.

    Size is the number of words; a null text has none. A null source is a source. Rows are drawn whole, ``max_repeat`` times at
    most, and a rerun draws the same. Where a target ends, rows are taken one by one and past the block until no undrawn row of the source fits, so its sum
    ends within half the smallest undrawn row of the target, or short of it where no row that would bring it nearer is left. Repeated rows are drawn each for itself. An empty table gives no rows. Input columns named like a
    result column give way to it.
    """
    rows = _with_block(docs, text, source, key, seed, carry)
    narrow = carry is not None and text not in carry
    rows = stored(rows, "mix-rows") if narrow else rows
    sizes = rows.select("source", "size", "block", "h")
    plan, picks = block_plan(sizes if narrow else stored(sizes, "mix-sizes"), shards, seed, weights, max_repeat)
    drawn = _keyed(rows).join(_small(stored(plan, "mix-plan")), SAME_BLOCK)
    drawn = drawn.join(_small(picks.select(*SAME_BLOCK, "h", "size", "take", "copies")), [*SAME_BLOCK, "h", "size"], "left")
    drawn = drawn.withColumn("extra", F.col("take").isNotNull() | (F.col("size") <= F.col("upto_size")))
    if not picks.where("take < copies").isEmpty():
        # Of repeated rows that are not all picked, as many as are; any of them.
        some = F.coalesce(F.col("take") < F.col("copies"), F.lit(False)) & (F.col("size") > F.col("upto_size"))
        turn = F.row_number().over(Window.partitionBy(*SAME_BLOCK, "h", "size").orderBy("pos"))
        part = drawn.where(some).withColumn("pos", F.monotonically_increasing_id()).withColumn("extra", turn <= F.col("take")).drop("pos")
        drawn = drawn.where(~some).unionByName(part)
    drawn = drawn.withColumn("shards", F.expr("IF(extra, array_append(shards, extra_shard), shards)"))
    out = drawn.select(
        "row", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards", F.col("h").alias("mix_order")
    )
    return unpacked(out, "size", "source_size", "target", "taken", "shards", "mix_order")


def mixed_rows(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **given) -> DataFrame:
    """The mix itself: input columns, one row a draw, with ``shard`` and ``mix_order``, the order inside the shard."""
    wrapped = docs.select(packed(docs), F.col(text).alias("text"), F.col(source).alias("source"), F.col(key).alias("doc_id"))
    drawn = mix_sources(wrapped, **given).where("size(shards) > 0")
    return drawn.select("row", F.posexplode("shards").alias("draw", "shard"), "mix_order").select(
        "row.*", "shard", F.xxhash64("mix_order", "draw").alias("mix_order")
    )


def shuffled_shards(mixed: DataFrame, slices: int = SLICES) -> DataFrame:
    """Rows of a shard in the order of ``mix_order``, in ``slices`` ranges of it: the rows of a range are in one task, and lie there in order.

    ``mix_order`` is a hash, so ranges of equal width hold about equally many rows, whatever the size of a shard.
    """
    at = F.floor((F.shiftrightunsigned("mix_order", 33) * slices) / F.lit(1 << 31))
    return mixed.withColumn("slice", at).repartition("shard", "slice").sortWithinPartitions("shard", "slice", "mix_order").drop("slice")


@query("op2_mix_sources")
def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Per document its words taken, the shards that its draws went to, and its place in their order."""
    return mix_sources(documents(spark, folder), carry=["doc_id"])
