"""Map cells: creation, battle replay with before-images, undo, reset and scoreboards."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatward.functions.dims import ALLIANCES, CELLS_PER_CHAMPION, ROUNDS, dim_df
from seatward.functions.text import SAME_ALLIANCE_NOTE
from seatward.operators.ordered import group_sizes, previous_values, rank_rows
from seatward.operators.writes import expand_slots, insert_ignore
from seatward.session import pin

# Battles of one cell folded in one array; longer chains are folded level by level.
CHUNK = 256


def with_alliance(df: DataFrame, dim: DataFrame, region: str = "region", out: str = "alliance") -> DataFrame:
    """Left join to the region table (22 rows, a local relation); an unknown region gives null."""
    named = dim.select(F.col("region").alias("_region"), F.col("alliance").alias(out))
    return df.join(named, df[region] == named["_region"], "left").drop("_region")


def create_cells(champions: DataFrame, dim: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Five cells per champion of a real alliance; cells that exist already stay as they are."""
    placed = with_alliance(champions.select("email", "region"), dim).filter(F.col("alliance").isin(list(ALLIANCES)))
    cells = expand_slots(placed, CELLS_PER_CHAMPION, "cluster_index").select(
        F.concat(F.col("email"), F.lit("#"), F.col("cluster_index").cast("string")).alias("id"),
        F.col("email").alias("cluster_owner_email"),
        "cluster_index",
        F.col("alliance").alias("current_alliance"),
        F.col("email").alias("current_owner_email"),
        F.col("alliance").alias("original_alliance"),
    )
    return cells if existing is None else insert_ignore(existing, cells, ["id"])


def enrich_battles(battles: DataFrame, champions: DataFrame, dim: DataFrame) -> DataFrame:
    """Winner and loser looked up in the champion table; a missing one gives nulls."""
    info = with_alliance(champions.select("email", "pseudo", "region"), dim)
    out = battles
    for who in ("winner", "loser"):
        side = info.select(
            F.col("email").alias(f"{who}_email"),
            F.lit(True).alias(f"{who}_known"),
            F.col("pseudo").alias(f"{who}_pseudo"),
            F.col("alliance").alias(f"{who}_alliance"),
        )
        out = out.join(side, f"{who}_email", "left")
    return out


def _code(alliance: Column) -> Column:
    return F.when(alliance == "A", 0).when(alliance == "B", 1).when(alliance == "C", 2).when(alliance == "D", 3)


# A battle turns one alliance of its cell into another and leaves the other three. Such a map of the four
# alliances is packed two bits per alliance; 228 (binary 11 10 01 00) changes nothing.
_IDENTITY = 228


def _step(loser: Column, winner: Column) -> Column:
    return (F.lit(_IDENTITY) + F.call_function("shiftleft", winner - loser, 2 * loser)).cast("int")


def _apply(packed: Column, state: Column) -> Column:
    return F.call_function("shiftright", packed, 2 * state).bitwiseAND(F.lit(3))


def _then(first: Column, second: Column) -> Column:
    """The map that runs ``first`` and then ``second``."""
    out = _apply(second, _apply(first, F.lit(0)))
    for s in (1, 2, 3):
        out = out + F.shiftleft(_apply(second, _apply(first, F.lit(s))), 2 * s)
    return out.cast("int")


def _states_before(items: Column, start: Column) -> Column:
    """State before each item of an ordered array of maps, from the state at its start."""
    zero = F.struct(start.cast("int").alias("s"), F.array().cast("array<int>").alias("seen"))
    return F.aggregate(
        items,
        zero,
        lambda acc, x: F.struct(
            _apply(x["_f"], acc["s"]).cast("int").alias("s"), F.concat(acc["seen"], F.array(acc["s"])).alias("seen")
        ),
    )["seen"]


def chain_states(
    chain: DataFrame,
    starts: DataFrame,
    key: str,
    order: Sequence[str],
    chunk: int = CHUNK,
    max_group_rows: int | None = None,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """State in front of every map ``_f`` of each key's ordered chain, as column ``_state``.

    Maps compose, so a chain is cut into chunks of ``chunk`` maps. Each chunk is reduced to one map, the chunk maps
    form a chain ``chunk`` times shorter, and its states are the chunks' starting states. No array exceeds
    ``chunk`` items however long one key's chain is; a chain of 10^12 takes five levels. ``sizes`` may be any upper
    bound on the groups.
    """
    sizes = sizes or group_sizes(chain, [key])
    payload = [c for c in chain.columns if c != key]
    item = F.struct(*order, *[c for c in payload if c not in order])
    levels = max(1, math.ceil(math.log(max(sizes[0], 1), chunk) - 1e-9))
    if levels == 1:
        chunks = chain.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_items"))
        entry = starts.select(key, F.col("start").alias("_start"))
        chunks = chunks.join(entry, key)
    else:
        number = f"_chunk_of_{order[-1]}"
        ranked = rank_rows(chain, [key], order, "_rank", max_group_rows, sizes)
        numbered = ranked.withColumn(number, F.floor((F.col("_rank") - 1) / chunk)).drop("_rank")
        chunks = pin(numbered.groupBy(key, number).agg(F.array_sort(F.collect_list(item)).alias("_items")))
        whole = F.aggregate("_items", F.lit(_IDENTITY), lambda acc, x: _then(acc, x["_f"]))
        maps = chunks.select(key, number, whole.alias("_f"))
        entry = chain_states(maps, starts, key, [number], chunk, max_group_rows)
        chunks = chunks.join(entry.select(key, number, F.col("_state").alias("_start")), [key, number])
    pairs = F.arrays_zip(F.col("_items").alias("_items"), _states_before(F.col("_items"), F.col("_start")).alias("_seen"))
    return (
        chunks.select(key, F.explode(pairs).alias("_p"))
        .select(key, *[F.col(f"_p._items.{c}").alias(c) for c in payload], F.col("_p._seen").alias("_state"))
    )


def judge_battles(battles: DataFrame, champions: DataFrame, cells: DataFrame, dim: DataFrame) -> DataFrame:
    """Battles with all rules that do not depend on other battles: ``reason`` of a rejection, and ``_contest`` where the cell's state decides.

    ``_cell_alliance`` and ``_cell_owner`` are the cell's before any battle.
    """
    w, l = F.col("winner_alliance"), F.col("loser_alliance")
    real = lambda c: c.isNotNull() & (c != "IDF")
    known = cells.select(
        F.col("id").alias("cell_id"),
        F.col("current_alliance").alias("_cell_alliance"),
        F.col("current_owner_email").alias("_cell_owner"),
    )
    return (
        enrich_battles(battles, champions, dim)
        .join(known, "cell_id", "left")
        .withColumn(
            "reason",
            F.coalesce(
                F.when(F.col("winner_email").isNull() | F.col("loser_email").isNull(), "email_missing"),
                F.when(F.col("winner_email") == F.col("loser_email"), "same_champion"),
                F.when(~F.coalesce(F.col("round").between(*ROUNDS), F.lit(False)), "round_invalid"),
                F.when(F.col("winner_known").isNull(), "winner_unknown"),
                F.when(F.col("loser_known").isNull(), "loser_unknown"),
                F.when(~(real(w) & real(l)), "no_alliance"),
                F.when(w == l, F.lit(None).cast("string")).otherwise(
                    F.coalesce(
                        F.when(F.col("cell_id").isNull(), "cell_missing"),
                        F.when(F.col("_cell_alliance").isNull(), "cell_unknown"),
                    )
                ),
            ),
        )
        .withColumn("_contest", F.coalesce(F.col("reason").isNull() & (w != l), F.lit(False)))
    )


def replay_battles(
    battles: DataFrame,
    champions: DataFrame,
    cells: DataFrame,
    dim: DataFrame,
    chunk: int = CHUNK,
    max_group_rows: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Replay a battle log on the cells. Returns (decided log, cells after).

    Champions do not change, so all rules but one are columns of joined rows. Only "the cell still belongs to the
    losing alliance" depends on earlier battles, and only on those of the same cell: ``chain_states`` gives it.
    Log columns: ``outcome`` (transfer, same_alliance, rejected), ``reason`` of a rejection, the cell handed over
    and its alliance and owner before.
    """
    w, l = F.col("winner_alliance"), F.col("loser_alliance")
    checked = judge_battles(battles, champions, cells, dim)
    # Read three times below: the joins run once.
    checked = pin(checked)
    kept = ["id", "ts", "winner_email", "loser_email", "round", "winner_alliance", "loser_alliance", "_cell_owner"]
    chain = checked.filter("_contest").select("cell_id", *kept, _step(_code(l), _code(w)).alias("_f"))
    sizes = group_sizes(chain, ["cell_id"])
    starts = cells.select(F.col("id").alias("cell_id"), _code(F.col("current_alliance")).alias("start"))
    held = chain_states(chain, starts, "cell_id", ["ts", "id"], chunk, max_group_rows, sizes)
    held = held.withColumn("_taken", F.col("_state") == _code(l))
    held = previous_values(
        held, ["cell_id"], ["ts", "id"], ["winner_email"], "_prev_", F.col("_taken"), max_group_rows, sizes
    )
    taken, no_text = F.col("_taken"), F.lit(None).cast("string")
    columns = ["id", "ts", "winner_email", "loser_email", "round", "winner_alliance"]
    contested = held.select(
        *columns,
        F.when(taken, "transfer").otherwise("rejected").alias("outcome"),
        F.when(~taken, "cell_not_of_loser_alliance").alias("reason"),
        F.when(taken, F.col("cell_id")).alias("cell_transferred_id"),
        F.when(taken, l).alias("prev_alliance"),
        F.when(taken, F.coalesce(F.col("_prev_winner_email"), F.col("_cell_owner"))).alias("prev_owner_email"),
        no_text.alias("notes"),
    )
    ally = F.col("reason").isNull()
    others = checked.filter(~F.col("_contest")).select(
        *columns,
        F.when(ally, "same_alliance").otherwise("rejected").alias("outcome"),
        "reason",
        no_text.alias("cell_transferred_id"),
        no_text.alias("prev_alliance"),
        no_text.alias("prev_owner_email"),
        F.when(ally, F.lit(SAME_ALLIANCE_NOTE)).alias("notes"),
    )
    log = contested.unionByName(others)
    return log, cells_after(cells, log)


def cells_after(cells: DataFrame, log: DataFrame) -> DataFrame:
    """Cells with the alliance and owner of their latest transfer."""
    last = (
        log.filter(F.col("cell_transferred_id").isNotNull())
        .groupBy(F.col("cell_transferred_id").alias("id"))
        .agg(F.max_by(F.struct("winner_alliance", "winner_email"), F.struct("ts", "id")).alias("_t"))
    )
    moved = F.col("_t").isNotNull()
    return (
        cells.join(last, "id", "left")
        .withColumns(
            {
                "current_alliance": F.when(moved, F.col("_t.winner_alliance")).otherwise(F.col("current_alliance")),
                "current_owner_email": F.when(moved, F.col("_t.winner_email")).otherwise(
                    F.col("current_owner_email")
                ),
            }
        )
        .select(*cells.columns)
    )


def battle_before_image(transfers: DataFrame, cells: DataFrame, max_group_rows: int | None = None) -> DataFrame:
    """Alliance and owner of the cell before each transfer: the previous transfer's, or the original ones."""
    order = ["ts", "id"]
    prev = previous_values(
        transfers, ["cell_transferred_id"], order, ["winner_alliance", "winner_email"], "_p_",
        max_group_rows=max_group_rows,
    )
    base = cells.select(F.col("id").alias("cell_transferred_id"), "original_alliance", "cluster_owner_email")
    return prev.join(base, "cell_transferred_id").select(
        *transfers.columns,
        F.coalesce(F.col("_p_winner_alliance"), F.col("original_alliance")).alias("before_alliance"),
        F.coalesce(F.col("_p_winner_email"), F.col("cluster_owner_email")).alias("before_owner_email"),
    )


def undo_last(log: DataFrame, cells: DataFrame, k: int = 1) -> tuple[DataFrame, DataFrame]:
    """Undo the ``k`` latest battles of the log. Returns (shorter log, cells).

    A cell moved several times among them goes back to the image before the earliest. A lost previous owner gives
    the cell to its cluster owner.
    """
    undone = log.orderBy(F.col("ts").desc_nulls_first(), F.col("id").desc()).limit(k)
    images = (
        undone.filter(F.col("cell_transferred_id").isNotNull())
        .groupBy(F.col("cell_transferred_id").alias("id"))
        .agg(F.min_by(F.struct("prev_alliance", "prev_owner_email"), F.struct(F.col("ts").isNull(), "ts", "id")).alias("_b"))
    )
    hit = F.col("_b").isNotNull()
    back = (
        cells.join(images, "id", "left")
        .withColumns(
            {
                "current_alliance": F.when(
                    hit, F.coalesce(F.col("_b.prev_alliance"), F.col("original_alliance"))
                ).otherwise(F.col("current_alliance")),
                "current_owner_email": F.when(
                    hit, F.coalesce(F.col("_b.prev_owner_email"), F.col("cluster_owner_email"))
                ).otherwise(F.col("current_owner_email")),
            }
        )
        .select(*cells.columns)
    )
    return log.join(undone.select("id"), "id", "left_anti"), back


def reset_map(cells: DataFrame, log: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Owners and alliances back to the original, seeds cleared, log emptied."""
    changes = {"current_alliance": F.col("original_alliance"), "current_owner_email": F.col("cluster_owner_email")}
    changes |= {c: F.lit(None).cast("double") for c in ("seed_x", "seed_y") if c in cells.columns}
    return cells.withColumns(changes), None if log is None else log.filter(F.lit(False))


def scoreboard(cells: DataFrame) -> DataFrame:
    return cells.groupBy("current_alliance").agg(F.count(F.lit(1)).cast("int").alias("cells"))


def cells_per_champion(champions: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells of each champion's own cluster, 0 for none. Counted before the join."""
    owned = cells.groupBy(F.col("cluster_owner_email").alias("email")).agg(F.count("id").alias("_n"))
    return champions.join(owned, "email", "left").select(
        "email", "pseudo", "region", F.coalesce(F.col("_n"), F.lit(0)).cast("int").alias("nb_cells")
    )


def redistribute(neutral: DataFrame, placed: DataFrame, k: int = 3) -> DataFrame:
    """Assign each neutral champion to one of the ``k`` alliances with fewest champions, by a hash of the e-mail."""
    spark = neutral.sparkSession
    names = dim_df(spark, [(a,) for a in ALLIANCES], [("alliance", "string")])
    counts = placed.groupBy("alliance").agg(F.count(F.lit(1)).alias("_n"))
    fewest = names.join(counts, "alliance", "left").orderBy(F.coalesce(F.col("_n"), F.lit(0)), "alliance").limit(k)
    # At most four rows: one array, looked up by position.
    targets = fewest.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("_n"), F.lit(0)).alias("n"), "alliance"))),
            lambda x: x["alliance"],
        ).alias("targets")
    ).scalar()
    slot = F.conv(F.substring(F.md5("email"), 1, 8), 16, 10).cast("long") % F.lit(k)
    return neutral.withColumn("assigned_alliance", F.element_at(targets, (slot + 1).cast("int")))
