"""Cells and battles."""

from __future__ import annotations

from pyspark.sql import functions as F

from seatward.operators import territory, writes
from seatward.plans.registry import query
from seatward.session import pin
from seatward.sources.streams import closable, drain_to_table, shuffled_files
from seatward.streaming.battles import cells_of_stream, stream_battles

_CELLS = """cells AS (SELECT email || '#' || CAST(i AS VARCHAR) AS id, email AS cluster_owner_email, CAST(i AS INT) AS cluster_index,
        alliance AS current_alliance, email AS current_owner_email, alliance AS original_alliance
    FROM {who} c JOIN dim ON dim.region = c.region, range(5) AS g(i) WHERE alliance IN ('A', 'B', 'C', 'D'))"""
_OWN = _CELLS.format(who="champions")
_FIELD = _CELLS.format(who="fighters")

# Battles with every rule but the last decided, then one step per battle of a cell.
_BATTLES = f"""{_FIELD},
    who AS (SELECT email, pseudo, alliance FROM fighters f LEFT JOIN dim ON dim.region = f.region),
    judged AS (SELECT b.*, w.alliance AS winner_alliance, l.alliance AS loser_alliance, c.original_alliance AS cell_alliance,
        CASE WHEN winner_email IS NULL OR loser_email IS NULL THEN 'email_missing' WHEN winner_email = loser_email THEN 'same_champion'
            WHEN round IS NULL OR round NOT BETWEEN 1 AND 5 THEN 'round_invalid' WHEN w.email IS NULL THEN 'winner_unknown'
            WHEN l.email IS NULL THEN 'loser_unknown'
            WHEN w.alliance IS NULL OR w.alliance = 'IDF' OR l.alliance IS NULL OR l.alliance = 'IDF' THEN 'no_alliance'
            WHEN w.alliance = l.alliance THEN NULL WHEN b.cell_id IS NULL THEN 'cell_missing' WHEN c.id IS NULL THEN 'cell_unknown' END AS bad
        FROM battle_log b LEFT JOIN who w ON w.email = b.winner_email LEFT JOIN who l ON l.email = b.loser_email
        LEFT JOIN cells c ON c.id = b.cell_id),
    chain AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY ts, id) AS rn FROM judged
        WHERE bad IS NULL AND winner_alliance <> loser_alliance),
    step AS (
        SELECT cell_id, rn, id, cell_alliance AS alliance, split_part(cell_id, '#', 1) AS owner, winner_alliance, loser_alliance, winner_email
        FROM chain WHERE rn = 1
        UNION ALL
        SELECT n.cell_id, n.rn, n.id, CASE WHEN s.alliance = s.loser_alliance THEN s.winner_alliance ELSE s.alliance END,
            CASE WHEN s.alliance = s.loser_alliance THEN s.winner_email ELSE s.owner END, n.winner_alliance, n.loser_alliance, n.winner_email
        FROM step s JOIN chain n ON n.cell_id = s.cell_id AND n.rn = s.rn + 1),
    log AS (SELECT j.id, j.ts, j.winner_email, j.loser_email, j.round, j.winner_alliance,
        CASE WHEN bad IS NOT NULL THEN 'rejected' WHEN j.winner_alliance = j.loser_alliance THEN 'same_alliance'
            WHEN s.alliance = s.loser_alliance THEN 'transfer' ELSE 'rejected' END AS outcome,
        CASE WHEN bad IS NOT NULL THEN bad WHEN j.winner_alliance <> j.loser_alliance AND s.alliance <> s.loser_alliance
            THEN 'cell_not_of_loser_alliance' END AS reason,
        CASE WHEN s.alliance = s.loser_alliance THEN j.cell_id END AS cell_transferred_id,
        CASE WHEN s.alliance = s.loser_alliance THEN s.alliance END AS prev_alliance,
        CASE WHEN s.alliance = s.loser_alliance THEN s.owner END AS prev_owner_email,
        CASE WHEN bad IS NULL AND j.winner_alliance = j.loser_alliance THEN 'Même alliance — pas de cession' END AS notes
        FROM judged j LEFT JOIN step s ON s.id = j.id),
    moved AS (SELECT cell_transferred_id AS id, winner_alliance, winner_email FROM log WHERE cell_transferred_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY cell_transferred_id ORDER BY ts DESC, log.id DESC) = 1),
    after AS (SELECT c.id, cluster_owner_email, cluster_index, coalesce(m.winner_alliance, current_alliance) AS current_alliance,
        coalesce(m.winner_email, current_owner_email) AS current_owner_email, original_alliance FROM cells c LEFT JOIN moved m ON m.id = c.id)"""


def _field(t):
    """Cells of the fighters, and the decided battle log with the cells after it."""
    cells = territory.create_cells(t.fighters, t.dim)
    return cells, *territory.replay_battles(t.battle_log, t.fighters, cells, t.dim)


def _decided(t):
    """The same with the log written once, for queries that read both it and the cells after it."""
    cells, log, _ = _field(t)
    log = pin(log)
    return cells, log, territory.cells_after(cells, log)


@query(
    "alliance_of",
    "SELECT email, c.region, alliance FROM champions c LEFT JOIN dim ON dim.region = c.region",
    "champions",
    "dim",
)
def alliance_of(t):
    return territory.with_alliance(t.champions.select("email", "region"), t.dim)


@query("cells_expand", f"WITH {_OWN} SELECT * FROM cells", "champions", "dim")
def cells_expand(t):
    return territory.create_cells(t.champions, t.dim)


@query(
    "cells_insert",
    f"""WITH {_OWN} SELECT id, cluster_owner_email, cluster_index, CASE WHEN cluster_index < 2 THEN 'D' ELSE current_alliance END
        AS current_alliance, current_owner_email, original_alliance FROM cells""",
    "champions",
    "dim",
)
def cells_insert(t):
    """Cells that exist keep what they are: here two of each five, taken by alliance D before."""
    cells = territory.create_cells(t.champions, t.dim)
    there = cells.filter("cluster_index < 2").withColumn("current_alliance", F.lit("D"))
    return territory.create_cells(t.champions, t.dim, there)


@query(
    "cells_per_champion",
    f"""WITH {_OWN} SELECT c.email, c.pseudo, c.region, CAST(count(cells.id) AS INT) AS nb_cells
        FROM champions c LEFT JOIN cells ON cluster_owner_email = c.email GROUP BY c.email, c.pseudo, c.region""",
    "champions",
    "dim",
)
def cells_per_champion(t):
    return territory.cells_per_champion(t.champions, territory.create_cells(t.champions, t.dim))


@query(
    "battles_enriched",
    """WITH who AS (SELECT email, pseudo, alliance FROM fighters f LEFT JOIN dim ON dim.region = f.region)
    SELECT id, w.pseudo AS winner_pseudo, w.alliance AS winner_alliance, l.pseudo AS loser_pseudo, l.alliance AS loser_alliance
    FROM battle_log b LEFT JOIN who w ON w.email = winner_email LEFT JOIN who l ON l.email = loser_email""",
    "battle_log",
    "fighters",
    "dim",
)
def battles_enriched(t):
    out = territory.enrich_battles(t.battle_log, t.fighters, t.dim)
    return out.select("id", "winner_pseudo", "winner_alliance", "loser_pseudo", "loser_alliance")


@query("replay_battles", f"WITH RECURSIVE {_BATTLES} SELECT * FROM log", "battle_log", "fighters", "dim")
def replay_battles(t):
    return _field(t)[1]


def _streamed(t):
    # The log is no plain selection of a given table, so it is written out first.
    folder, delay = shuffled_files(t.battle_log, "ts", 3, 1)
    spark = t.battle_log.sparkSession
    battles = spark.readStream.schema(t.battle_log.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    whole, finish = closable(battles, "ts")
    cells = territory.create_cells(t.fighters, t.dim)
    log = drain_to_table(stream_battles(whole, t.fighters, cells, t.dim, delay), "battles", finish)
    return cells, log


@query("stream_battles", f"WITH RECURSIVE {_BATTLES} SELECT * FROM log", "battle_log", "fighters", "dim")
def battles_on_a_stream(t):
    """The battle log as a stream out of order."""
    return _streamed(t)[1].drop("now_alliance", "now_owner_email")


@query("stream_battle_cells", f"WITH RECURSIVE {_BATTLES} SELECT * FROM after", "battle_log", "fighters", "dim")
def battle_cells_of_a_stream(t):
    return cells_of_stream(*_streamed(t))


@query("replay_cells", f"WITH RECURSIVE {_BATTLES} SELECT * FROM after", "battle_log", "fighters", "dim")
def replay_cells(t):
    return _field(t)[2]


@query(
    "scoreboard",
    f"WITH RECURSIVE {_BATTLES} SELECT current_alliance, CAST(count(*) AS INT) AS cells FROM after GROUP BY 1",
    "battle_log",
    "fighters",
    "dim",
)
def scoreboard(t):
    return territory.scoreboard(_field(t)[2]).orderBy("current_alliance")


@query(
    "battle_before_image",
    f"""WITH RECURSIVE {_BATTLES} SELECT id, cell_transferred_id, prev_alliance AS before_alliance,
        prev_owner_email AS before_owner_email FROM log WHERE outcome = 'transfer'""",
    "battle_log",
    "fighters",
    "dim",
)
def battle_before_image(t):
    cells, log, _ = _field(t)
    moves = log.filter("outcome = 'transfer'").select("id", "ts", "cell_transferred_id", "winner_alliance", "winner_email")
    out = territory.battle_before_image(moves, cells)
    return out.select("id", "cell_transferred_id", "before_alliance", "before_owner_email")


_UNDO = f"""{_BATTLES},
    undone AS (SELECT * FROM log WHERE outcome <> 'rejected' ORDER BY ts DESC, id DESC LIMIT 500),
    image AS (SELECT cell_transferred_id AS id, prev_alliance, prev_owner_email FROM undone WHERE cell_transferred_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY cell_transferred_id ORDER BY ts, undone.id) = 1)"""


@query(
    "undo_last",
    f"""WITH RECURSIVE {_UNDO} SELECT a.id, coalesce(i.prev_alliance, current_alliance) AS current_alliance,
        coalesce(i.prev_owner_email, current_owner_email) AS current_owner_email FROM after a LEFT JOIN image i ON i.id = a.id""",
    "battle_log",
    "fighters",
    "dim",
)
def undo_last(t):
    _, log, after = _decided(t)
    _, cells = territory.undo_last(log.filter("outcome <> 'rejected'"), after, 500)
    return cells.select("id", "current_alliance", "current_owner_email")


@query(
    "undo_log",
    f"WITH RECURSIVE {_UNDO} SELECT id, outcome FROM log WHERE outcome <> 'rejected' AND id NOT IN (SELECT id FROM undone)",
    "battle_log",
    "fighters",
    "dim",
)
def undo_log(t):
    _, log, after = _decided(t)
    return territory.undo_last(log.filter("outcome <> 'rejected'"), after, 500)[0].select("id", "outcome")


@query(
    "reset_map",
    f"""WITH {_FIELD} SELECT *, CAST(NULL AS DOUBLE) AS seed_x, CAST(NULL AS DOUBLE) AS seed_y FROM cells""",
    "fighters",
    "dim",
)
def reset_map(t):
    _, log, after = _decided(t)
    seeded = after.withColumns({"seed_x": F.rand(1), "seed_y": F.rand(2)})
    return territory.reset_map(seeded, log)[0]


_TOTALS = f"""{_OWN} SELECT 'cells' AS what, count(*) AS n FROM cells UNION ALL
    SELECT 'cells_with_seed', count(*) FROM cells WHERE cluster_index > 1 UNION ALL
    SELECT 'invites', count(*) FROM invites"""


@query("totals", f"WITH {_TOTALS}", "champions", "dim", "invites")
def totals(t):
    """Table counts: cells, cells that have a seed point, invitations."""
    seed = F.when(F.col("cluster_index") > 1, F.lit(0.5))
    cells = territory.create_cells(t.champions, t.dim).withColumn("seed_x", seed)
    counts = cells.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("seed_x").isNotNull()).alias("seeded"))
    lines = counts.select(F.inline(F.array(
        F.struct(F.lit("cells").alias("what"), F.col("all").alias("n")),
        F.struct(F.lit("cells_with_seed").alias("what"), F.col("seeded").alias("n")),
    )))
    return lines.unionByName(t.invites.agg(F.count(F.lit(1)).alias("n")).select(F.lit("invites").alias("what"), "n"))


_GONE = "gone AS (SELECT email AS e FROM fighters WHERE region = 'Centre')"


@query(
    "cascade_delete",
    f"""WITH RECURSIVE {_BATTLES}, {_GONE} SELECT id, cluster_owner_email, current_alliance,
        CASE WHEN current_owner_email NOT IN (SELECT e FROM gone) THEN current_owner_email END AS current_owner_email
    FROM after WHERE cluster_owner_email NOT IN (SELECT e FROM gone)""",
    "battle_log",
    "fighters",
    "dim",
)
def cascade_delete(t):
    _, log, after = _decided(t)
    gone = t.fighters.filter("region = 'Centre'").select("email")
    kept = writes.apply_deletes(gone, t.fighters, after, log)["cells"]
    return kept.select("id", "cluster_owner_email", "current_alliance", "current_owner_email")


@query(
    "cascade_delete_battles",
    f"""WITH RECURSIVE {_BATTLES}, {_GONE} SELECT log.id, winner_email, loser_email,
        CASE WHEN c.cluster_owner_email NOT IN (SELECT e FROM gone) THEN cell_transferred_id END AS cell_transferred_id
    FROM log LEFT JOIN cells c ON c.id = cell_transferred_id
    WHERE winner_email NOT IN (SELECT e FROM gone) AND loser_email NOT IN (SELECT e FROM gone)""",
    "battle_log",
    "fighters",
    "dim",
)
def cascade_delete_battles(t):
    _, log, after = _decided(t)
    gone = t.fighters.filter("region = 'Centre'").select("email")
    kept = writes.apply_deletes(gone, t.fighters, after, log)["battles"]
    return kept.select("id", "winner_email", "loser_email", "cell_transferred_id")


@query(
    "redistribute",
    """WITH a AS (SELECT email, alliance FROM champions c LEFT JOIN dim ON dim.region = c.region),
    few AS (SELECT l.alliance, row_number() OVER (ORDER BY count(a.email), l.alliance) - 1 AS slot
        FROM (VALUES ('A'), ('B'), ('C'), ('D')) AS l(alliance) LEFT JOIN a ON a.alliance = l.alliance GROUP BY l.alliance)
    SELECT email, few.alliance AS assigned_alliance FROM a JOIN few ON few.slot = CAST('0x' || substr(md5(email), 1, 8) AS BIGINT) % 3
    WHERE a.alliance = 'IDF'""",
    "champions",
    "dim",
)
def redistribute(t):
    placed = territory.with_alliance(t.champions.select("email", "region"), t.dim)
    out = territory.redistribute(placed.filter("alliance = 'IDF'"), placed)
    return out.select("email", "assigned_alliance")
