"""Registration-shaped inputs derived from the given tables.

Each is one SQL text read by both engines, so a query and its check start from the same rows. ``{ntz}`` and
``{k}`` are the two spots where the dialects differ: the zone-less timestamp type, and one JSON field.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from seatward.functions.dims import INSCRIPTION_POOLS, POOL_LABELS, REGION_ALLIANCE, ROOM_POOLS
from seatward.sources.tables import load

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def _values(rows, names: str) -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(quote(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({names})"


# Quotes are doubled for the check engine; Spark reads dimension tables from ``dims`` instead.
DIM_SQL = {
    "cap": "SELECT pool, CAST(capacity AS INT) AS capacity, CAST(price AS DECIMAL(8,2)) AS price, CAST(ord AS INT) AS ord"
    f" FROM ({_values(INSCRIPTION_POOLS, 'pool, capacity, price, ord')}) AS c",
    "room_cap": "SELECT room_type, CAST(capacity AS INT) AS capacity, CAST(price AS DECIMAL(8,2)) AS price,"
    f" CAST(ord AS INT) AS ord FROM ({_values(ROOM_POOLS, 'room_type, capacity, price, ord')}) AS c",
    "dim": _values(REGION_ALLIANCE, "region, alliance"),
    "labels_dim": _values(POOL_LABELS, "pool, label"),
}

MAIL = "'user' || CAST({} AS STRING) || '@example.com'"

SQL = {
    "payers": f"""
        SELECT c_custkey AS id,
               CASE WHEN c_custkey % 17 = 0 THEN ' ' || {MAIL.format('(2 * c_custkey)')}
                    WHEN c_custkey % 3 = 0 THEN upper({MAIL.format('(2 * c_custkey)')}) ELSE {MAIL.format('(2 * c_custkey)')} END AS email,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'equipe' WHEN 'HOUSEHOLD' THEN 'jeu_libre'
                    WHEN 'MACHINERY' THEN 'narratif' WHEN 'AUTOMOBILE' THEN 'autre' END AS pool,
               CASE WHEN c_custkey % 5 <> 0 THEN 'T' || CAST(c_custkey AS STRING) END AS transaction_id,
               CAST(1 + c_custkey % 4 AS INT) AS expected_champions,
               CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_acctbal AS DECIMAL(12,2)) END AS montant_eur,
               CASE WHEN c_custkey % 11 = 0 THEN '  ' ELSE c_name END AS nom,
               CASE WHEN c_custkey % 13 <> 0 THEN ' ' || c_mktsegment || ' ' END AS prenom,
               CASE WHEN c_custkey % 2 = 0 THEN ' Team ' || CAST(c_nationkey AS STRING) ELSE ' ' END AS team_label,
               CAST('2024-01-01 00:00:00' AS {{ntz}}) AS imported_at
        FROM {{customer}}""",
    # Payers that come in time: some were always there, the others some days after the first order of their address.
    "dated_payers": """
        SELECT p.id, p.email, p.pool, CASE WHEN p.id % 9 <> 0 THEN o.seen END AS imported_at
        FROM {payers} p LEFT JOIN (SELECT o_custkey, min(o_orderdate) + INTERVAL 12 DAY AS seen FROM {orders} GROUP BY o_custkey) o
            ON o.o_custkey = 2 * p.id""",
    "requests": f"""
        SELECT o_orderkey AS id, {MAIL.format('o_custkey')} AS email,
               CASE o_orderkey % 3 WHEN 0 THEN 'equipe' WHEN 1 THEN 'jeu_libre' ELSE 'narratif' END AS pool,
               CASE WHEN o_orderkey % 5 = 0 THEN 'capitaine' WHEN o_orderkey % 5 < 3 THEN 'coequipier' END AS role,
               CASE o_orderstatus WHEN 'O' THEN 'cancelled' WHEN 'P' THEN 'pending'
                    ELSE CASE WHEN o_orderkey % 10 = 0 THEN 'waived' ELSE 'paid' END END AS payment_status,
               o_orderpriority = '5-LOW' AS is_waitlist,
               CAST(CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN 325 ELSE 65 END AS DECIMAL(8,2)) AS amount_eur,
               o_orderdate AS created_at,
               nullif(o_orderdate, o_orderdate) AS promoted_at,
               CASE WHEN o_orderstatus = 'F' AND o_orderkey % 10 <> 0 THEN o_orderdate + INTERVAL 1 DAY END AS paid_at,
               CASE WHEN o_orderstatus = 'O' THEN o_orderdate + INTERVAL 2 DAY END AS cancelled_at,
               CASE WHEN o_orderkey % 6 = 0 THEN 'Backfill phase 7c ' || CAST(o_orderkey AS STRING)
                    WHEN o_orderkey % 6 = 1 THEN 'note' END AS admin_notes
        FROM {{orders}}""",
    "rooms": f"""
        SELECT o_orderkey AS id, {MAIL.format('o_custkey')} AS email,
               CASE o_orderkey % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'double' ELSE 'triple' END AS room_type,
               CASE o_orderstatus WHEN 'O' THEN 'cancelled' WHEN 'P' THEN 'pending' ELSE 'paid' END AS payment_status,
               CAST(CASE o_orderkey % 4 WHEN 0 THEN 56 WHEN 1 THEN 42 WHEN 2 THEN 34 ELSE 90 END AS DECIMAL(8,2)) AS amount_eur,
               o_orderdate AS created_at
        FROM {{orders}}""",
    "forms": f"""
        SELECT o_orderkey AS id, o_orderdate AS created_at,
               CASE WHEN o_orderkey % 17 = 0 THEN '  ' WHEN o_orderkey % 31 = 0 THEN NULL ELSE ' Nom ' || CAST(o_custkey AS STRING) END AS nom,
               CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE 'Prénom & ' || CAST(o_orderkey % 7 AS STRING) || ' ' END AS prenom,
               CASE WHEN o_orderkey % 23 = 0 THEN 'user@host' WHEN o_orderkey % 29 = 0 THEN 'a@b@c.d'
                    WHEN o_orderkey % 37 = 0 THEN NULL ELSE ' User' || CAST(o_custkey AS STRING) || '@Example.com ' END AS email,
               CASE o_orderkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE ' +33 ' || CAST(o_custkey AS STRING) END AS telephone,
               CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'vip'
                    ELSE CASE o_orderkey % 3 WHEN 0 THEN 'equipe' WHEN 1 THEN 'jeu_libre' ELSE 'narratif' END END AS pool,
               CASE WHEN o_orderkey % 43 = 0 THEN 'suite' ELSE CASE o_orderkey % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'double' ELSE 'triple' END END AS room_type,
               CASE WHEN o_orderkey % 3 = 0 THEN ' Team ' || CAST(o_custkey AS STRING) || ' ' ELSE '' END AS team_name,
               CASE WHEN o_orderkey % 47 = 0 THEN 'arbitre' WHEN o_orderkey % 3 = 0 THEN 'capitaine' END AS role,
               CASE WHEN o_orderkey % 9 = 0 THEN ' Ana, Bo ' WHEN o_orderkey % 9 = 1 THEN ' ' END AS co_occupants,
               CASE o_orderkey % 4 WHEN 0 THEN 'paid' WHEN 1 THEN 'waived' WHEN 2 THEN 'pending' ELSE 'cancelled' END AS payment_status,
               CAST(o_totalprice AS DECIMAL(12,2)) AS amount_eur
        FROM {{orders}}""",
    "champions": f"""
        SELECT {MAIL.format('c.c_custkey')} AS email, c.c_name AS pseudo, r.region AS region, c.c_nationkey AS nation_key,
               CASE WHEN c.c_custkey % 4 <> 0 THEN {MAIL.format('(c.c_custkey - c.c_custkey % 4)')} END AS invited_by_email
        FROM {{customer}} c LEFT JOIN {{region_list}} r ON r.idx = c.c_nationkey""",
    "commands": """
        SELECT event_id AS seq, ts,
               CASE WHEN event_id % 50 = 0 THEN -event_id ELSE user_id * 10 + event_id % 10 END AS id,
               CASE event_type WHEN 'purchase' THEN 'paid' WHEN 'signup' THEN 'waived' WHEN 'click' THEN 'unmark'
                    WHEN 'error' THEN 'cancel' ELSE CASE WHEN event_id % 2 = 0 THEN 'notes' ELSE 'payment_url' END END AS action,
               CASE WHEN event_id % 3 = 0 THEN 'reason ' || CAST(event_id AS STRING) END AS reason,
               CASE WHEN event_id % 4 = 1 THEN ' ' WHEN event_id % 4 <> 0 THEN ' v' || CAST(event_id AS STRING) || ' ' END AS value,
               CASE WHEN user_id % 5 <> 0 THEN 'admin' || CAST(user_id % 3 AS STRING) ELSE 'guest' END AS actor
        FROM {events}""",
    "request_log": f"""
        SELECT event_id + 1152921504606846976 AS seq, ts,
               CASE event_type WHEN 'purchase' THEN 'pay' WHEN 'error' THEN 'cancel'
                    WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'unmark' ELSE 'waive' END ELSE 'create' END AS kind,
               {MAIL.format('user_id')} AS email,
               CASE user_id % 3 WHEN 0 THEN 'equipe' WHEN 1 THEN 'jeu_libre' ELSE 'narratif' END AS pool
        FROM {{events}}""",
    # Commands that name a row by the seq that made it: an earlier entry of the same user, which may be no creation.
    "row_log": f"""
        SELECT event_id + 1152921504606846976 AS seq, ts,
               CASE event_type WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'pay' ELSE 'promote' END WHEN 'error' THEN 'cancel'
                    WHEN 'view' THEN CASE event_id % 3 WHEN 0 THEN 'unmark' WHEN 1 THEN 'waive' ELSE 'cancel' END
                    ELSE CASE WHEN event_id % 11 = 0 THEN 'admin' ELSE 'create' END END AS kind,
               {MAIL.format('user_id')} AS email,
               CASE user_id % 3 WHEN 0 THEN 'equipe' WHEN 1 THEN 'jeu_libre' ELSE 'narratif' END AS pool,
               CASE event_id % 4 WHEN 1 THEN p1 WHEN 2 THEN p2 WHEN 3 THEN p4 END + 1152921504606846976 AS target
        FROM (SELECT *, lag(event_id, 1) OVER w AS p1, lag(event_id, 2) OVER w AS p2, lag(event_id, 4) OVER w AS p4
              FROM {{events}} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) AS e""",
    "cap_log": """
        SELECT pool, CAST(count(*) + CASE pool WHEN 'equipe' THEN 2 WHEN 'jeu_libre' THEN 5 ELSE 40 END AS INT) AS capacity
        FROM {payers} WHERE pool IN ('equipe', 'jeu_libre', 'narratif') GROUP BY pool""",
    "fighters": f"""
        SELECT {MAIL.format('user_id')} AS email, 'p' || CAST(user_id AS STRING) AS pseudo,
               CASE user_id % 4 WHEN 0 THEN 'Alsace' WHEN 1 THEN 'Bourgogne' WHEN 2 THEN 'Centre' ELSE 'Lorraine' END AS region
        FROM (SELECT DISTINCT user_id FROM {{events}}) AS u""",
    "battle_log": f"""
        SELECT e.event_id AS id, e.ts, {MAIL.format('e.user_id')} AS winner_email,
               {MAIL.format('((e.user_id + e.k) % e.n)')} AS loser_email, CAST(1 + e.event_id % 5 AS INT) AS round,
               {MAIL.format('((e.event_id * 37) % e.n)')} || '#' || CAST(e.k % 5 AS STRING) AS cell_id
        FROM (SELECT event_id, ts, user_id, CAST({{k}} AS BIGINT) AS k,
                     (SELECT count(DISTINCT user_id) FROM {{events}}) AS n FROM {{events}}) AS e""",
    "invites": f"""
        SELECT md5(CAST(o_orderkey AS STRING)) AS token, {MAIL.format('o_custkey')} AS inviter_email,
               CASE WHEN o_orderstatus = 'F' THEN {MAIL.format('(o_custkey + 1)')} END AS used_by_email,
               CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY END AS used_at
        FROM {{orders}}""",
    # Four attempts a token, and one token that a third of all attempts share.
    "attempts": f"""
        SELECT o_orderkey AS seq,
               CASE WHEN o_orderkey % 3 = 0 THEN md5('0') WHEN o_orderkey % 53 = 0 THEN 'nope'
                    ELSE md5(CAST(CAST(floor(o_orderkey / 4) AS BIGINT) AS STRING)) END AS token,
               'Mate' || CAST(o_custkey + o_orderkey % 8 AS STRING) || '@example.com' AS email,
               CASE WHEN o_orderkey % 59 = 0 THEN '' ELSE 'p' || CAST(o_orderkey AS STRING) END AS pseudo,
               'Alsace' AS region,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END AS is_parisian_redistributed,
               CASE WHEN o_orderkey % 7 <> 0 THEN {{heroes}} END AS heroes,
               CASE WHEN o_orderkey % 4 <> 0 THEN 'f' || CAST(o_orderkey % 4 AS STRING) END AS faction,
               CASE WHEN o_orderkey % 6 <> 0 THEN o_orderpriority END AS story,
               CASE WHEN o_orderkey % 9 <> 0 THEN 'crest ' || CAST(o_orderkey % 9 AS STRING) END AS blason
        FROM {{orders}}""",
    "mates": """
        SELECT 'mate' || CAST(5 * c_custkey AS STRING) || '@example.com' AS email FROM {customer}""",
    "payers_batch": """
        SELECT c_custkey + 1 AS id,
               CASE WHEN c_custkey % 3 = 0 THEN 'user' || CAST(c_custkey AS STRING) || '@EXAMPLE.com'
                    ELSE 'user' || CAST(c_custkey + 1 AS STRING) || '@example.com' END AS email,
               'jeu_libre' AS pool,
               CASE WHEN c_custkey % 4 <> 0 THEN 'T' || CAST(c_custkey - c_custkey % 2 AS STRING) END AS transaction_id,
               CAST(c_acctbal AS DECIMAL(12,2)) AS montant_eur
        FROM {customer}""",
}

# Position of each region in the fixed list, for customers' nation keys.
REGION_LIST = _values([(i, r) for i, (r, _) in enumerate(REGION_ALLIANCE)], "idx, region")
DIALECT = {
    "spark": {"ntz": "TIMESTAMP_NTZ", "k": "get_json_object(props, '$.k')", "heroes": "array('h1', o_orderpriority)"},
    "duckdb": {"ntz": "TIMESTAMP", "k": "json_extract_string(props, '$.k')", "heroes": "['h1', o_orderpriority]"},
}


def _names(text: str) -> set[str]:
    return set(re.findall(r"\{(\w+)\}", text)) - {"ntz", "k", "heroes"}


def table(spark: SparkSession, sf_dir: str, name: str, scan=load) -> DataFrame:
    """The named input as a DataFrame; given tables are read with ``scan``."""
    if name in TABLES:
        return scan(spark, sf_dir, name)
    if name == "region_list":
        from seatward.functions.dims import dim_df

        rows = [(i, r) for i, (r, _) in enumerate(REGION_ALLIANCE)]
        return dim_df(spark, rows, [("idx", "int"), ("region", "string")])
    text = SQL[name]
    sources = {n: table(spark, sf_dir, n, scan) for n in _names(text)}
    return spark.sql(text.format(**DIALECT["spark"], **{n: "{" + n + "}" for n in sources}), **sources)


def _ordered(names: list[str], seen: list[str]) -> list[str]:
    for n in names:
        if n in TABLES or n in seen:
            continue
        if n in SQL:
            _ordered(sorted(_names(SQL[n])), seen)
        seen.append(n)
    return seen


def check_sql(body: str, *names: str, recursive: bool = False) -> str:
    """The check query ``body`` preceded by the inputs it names, in the check engine's dialect."""
    parts = []
    for n in _ordered(list(names), []):
        text = DIM_SQL.get(n) or (REGION_LIST if n == "region_list" else SQL[n])
        parts.append(f"{n} AS ({text.format(**DIALECT['duckdb'], **{m: m for m in _names(text)}).strip()})")
    body = body.strip()
    if not parts:
        return body
    head = "WITH RECURSIVE " if recursive else "WITH "
    joiner = ",\n" if body[:5].upper() == "WITH " else "\n"
    if joiner == ",\n":
        body = body[5:]
        if body[:10].upper() == "RECURSIVE ":
            head, body = "WITH RECURSIVE ", body[10:]
    return head + ",\n".join(parts) + joiner + body
