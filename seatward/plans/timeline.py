"""Replays over event logs."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from seatward.functions.dims import pool_price
from seatward.operators import dedupe, replay
from seatward.plans.registry import LONG_HOLD, query
from seatward.sources.streams import closable, drain_to_table
from seatward.streaming.admission import stream_admission as admit_stream
from seatward.streaming.dedupe import stream_dedupe as dedupe_stream
from seatward.streaming.expiry import stream_expiry as expire_stream


def _kept(minutes: int) -> str:
    return f"""WITH RECURSIVE kept AS (
        SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY 1, 2
        UNION ALL
        SELECT k.user_id, k.event_type, min(e.ts) FROM kept k JOIN events e ON e.user_id = k.user_id AND e.event_type = k.event_type
            AND e.ts >= k.ts + INTERVAL {minutes} MINUTE GROUP BY 1, 2)
    SELECT k.user_id, k.event_type, k.ts, min(e.event_id) AS event_id FROM kept k JOIN events e USING (user_id, event_type, ts) GROUP BY 1, 2, 3"""


def _dedupe(t, minutes: int):
    return dedupe.dedupe_holds(t.events, ["user_id", "event_type"], "ts", "event_id", timedelta(minutes=minutes))


@query("dedupe_holds", _kept(1440))
def dedupe_holds(t):
    return _dedupe(t, 1440)


@query("dedupe_holds_30min", _kept(30))
def dedupe_holds_30min(t):
    return _dedupe(t, 30)


# The rules one log row at a time, from the functions that create, pay, cancel and promote: the state of a pool is the list of its
# live rows. A hold counts for thirty minutes from its creation, unless its e-mail is a payer's; a row's own active hold is reused.
_SEQUENTIAL = """WITH RECURSIVE mails AS (SELECT DISTINCT lower(email) AS email FROM payers),
    paid AS (SELECT pool, count(*) AS paid FROM payers GROUP BY pool),
    entries AS (SELECT l.pool, l.seq, l.ts, l.kind, lower(trim(l.email)) AS email, m.email IS NOT NULL AS payer,
            coalesce(c.capacity, 0) - coalesce(p.paid, 0) AS places, row_number() OVER (PARTITION BY l.pool ORDER BY l.ts, l.seq) AS n
        FROM request_log l LEFT JOIN mails m ON m.email = lower(trim(l.email)) LEFT JOIN cap_log c ON c.pool = l.pool LEFT JOIN paid p ON p.pool = l.pool),
    steps AS (
        SELECT pool, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS VARCHAR) AS email, false AS payer,
            CAST(NULL AS VARCHAR) AS action, CAST(NULL AS BIGINT) AS row_id, CAST(NULL AS BIGINT) AS place, CAST(NULL AS BIGINT) AS row_n,
            CAST(NULL AS BIGINT) AS promoted,
            CAST([] AS STRUCT(n BIGINT, id BIGINT, email VARCHAR, made TIMESTAMP, pending BOOLEAN, wait BOOLEAN, payer BOOLEAN)[]) AS live
        FROM (SELECT DISTINCT pool FROM entries)
        UNION ALL
        SELECT pool, n, seq, ts, email, payer, action,
            CASE WHEN action IN ('held', 'waitlisted') THEN seq WHEN action = 'reused' THEN own.id ELSE target.id END,
            CASE WHEN action = 'waitlisted' THEN waiting + 1 END,
            CASE WHEN action IN ('held', 'waitlisted') THEN n WHEN action NOT IN ('reused', 'unmatched') THEN target.n END,
            CASE WHEN action = 'cancel' AND NOT target.wait THEN head.n END,
            CASE WHEN action IN ('held', 'waitlisted')
                THEN list_append(live, {'n': n, 'id': seq, 'email': email, 'made': ts, 'pending': true, 'wait': action = 'waitlisted', 'payer': payer})
                WHEN action IN ('pay', 'waive', 'unmark') THEN list_transform(live, lambda r:
                    {'n': r.n, 'id': r.id, 'email': r.email, 'made': r.made, 'pending': CASE WHEN r.n = target.n THEN action = 'unmark' ELSE r.pending END,
                     'wait': r.wait, 'payer': r.payer})
                WHEN action = 'cancel' THEN list_transform(list_filter(live, lambda r: r.n <> target.n), lambda r:
                    {'n': r.n, 'id': r.id, 'email': r.email, 'made': r.made, 'pending': r.pending,
                     'wait': r.wait AND NOT (NOT target.wait AND r.n = head.n), 'payer': r.payer})
                ELSE live END
        FROM (SELECT *, CASE WHEN kind <> 'create' THEN CASE WHEN target IS NULL THEN 'unmatched' ELSE kind END
                WHEN own IS NOT NULL THEN 'reused' WHEN places - taken <= 0 THEN 'waitlisted' ELSE 'held' END AS action
            FROM (SELECT e.*, s.live,
                    list_filter(s.live, lambda r: r.email = e.email)[-1] AS target,
                    list_filter(s.live, lambda r: r.email = e.email AND r.pending AND NOT r.wait AND r.made > e.ts - INTERVAL 30 MINUTE)[-1] AS own,
                    list_filter(s.live, lambda r: r.wait)[1] AS head,
                    len(list_filter(s.live, lambda r: r.wait)) AS waiting,
                    len(list_filter(s.live, lambda r: r.pending AND NOT r.wait AND NOT r.payer AND r.made > e.ts - INTERVAL 30 MINUTE)) AS taken
                FROM steps s JOIN entries e ON e.pool = s.pool AND e.n = s.n + 1)))
    """
_DECISIONS = _SEQUENTIAL + "SELECT pool, seq, action, coalesce(row_id, -1) AS row_id, CAST(coalesce(place, 0) AS INT) AS waitlist_position FROM steps WHERE n > 0"
_ANSWERS = (
    _SEQUENTIAL
    + """SELECT seq, row_id, CAST(CASE pool WHEN 'equipe' THEN 325 WHEN 'jeu_libre' THEN 65 WHEN 'narratif' THEN 65 ELSE 65 END AS DOUBLE) AS amount_eur,
        action = 'waitlisted' AS is_waitlist, CAST(coalesce(place, 0) AS INT) AS waitlist_position FROM steps WHERE action IN ('reused', 'held', 'waitlisted')"""
)
_ROWS = (
    _SEQUENTIAL
    + """, done AS (SELECT pool, row_n, max_by(action, n) AS last, max(ts) FILTER (WHERE action = 'cancel') AS cancelled_at
        FROM steps WHERE action IN ('pay', 'waive', 'unmark', 'cancel') GROUP BY pool, row_n),
    settled AS (SELECT pool, row_n, arg_max_null(CASE WHEN action <> 'unmark' THEN ts END, n) AS paid_at FROM steps
        WHERE action IN ('pay', 'waive', 'unmark') GROUP BY pool, row_n),
    moved AS (SELECT pool, promoted, max(ts) AS promoted_at FROM steps WHERE promoted IS NOT NULL GROUP BY pool, promoted)
    SELECT m.pool, m.n, m.seq AS id, m.email, m.ts AS created_at,
        CASE d.last WHEN 'pay' THEN 'paid' WHEN 'waive' THEN 'waived' WHEN 'cancel' THEN 'cancelled' ELSE 'pending' END AS payment_status,
        m.action = 'waitlisted' AND p.promoted IS NULL AS is_waitlist, p.promoted_at, s.paid_at, d.cancelled_at, m.payer AS is_payer
    FROM steps m LEFT JOIN done d ON d.pool = m.pool AND d.row_n = m.n LEFT JOIN settled s ON s.pool = m.pool AND s.row_n = m.n
        LEFT JOIN moved p ON p.pool = m.pool AND p.promoted = m.n WHERE m.action IN ('held', 'waitlisted')"""
)
# Ids above 2^53 stay whole in a comparison only where no null turns their column into floats.
ABSENT = {"row_id": -1, "waitlist_position": 0}
_INPUTS = ("request_log", "cap_log", "payers")


def _replay(t):
    return replay.replay_requests(t.request_log, t.cap_log, t.payers)


@query("replay_requests", _DECISIONS, *_INPUTS)
def replay_requests(t):
    return _replay(t)[0].fillna(ABSENT)


@query("replay_answers", _ANSWERS, *_INPUTS)
def replay_answers(t):
    return replay.answers(_replay(t)[0], pool_price(F.col("pool"))).fillna(ABSENT)


@query("replay_request_rows", _ROWS, *_INPUTS)
def replay_request_rows(t):
    return _replay(t)[1]


def _by_row(fair: bool, start: str) -> str:
    """The rules with commands by row id: the state of a pool is the list of all its rows, cancelled ones too."""
    full = "places - taken <= 0 OR waiting > 0" if fair else "places - taken <= 0"
    live = "r.status <> 'cancelled'"
    active = f"r.status = 'pending' AND NOT r.wait AND {start} > e.ts - INTERVAL 30 MINUTE"
    row = (
        "n BIGINT, id BIGINT, email VARCHAR, made TIMESTAMP, status VARCHAR, wait BOOLEAN, promoted TIMESTAMP, paid TIMESTAMP, gone TIMESTAMP, payer BOOLEAN"
    )
    return f"""WITH RECURSIVE mails AS (SELECT DISTINCT lower(email) AS email FROM payers),
    paid AS (SELECT pool, count(*) AS paid FROM payers GROUP BY pool),
    entries AS (SELECT l.pool, l.seq, l.ts, l.kind, l.target AS wanted, lower(trim(l.email)) AS email, m.email IS NOT NULL AS payer,
            coalesce(c.capacity, 0) - coalesce(p.paid, 0) AS places, row_number() OVER (PARTITION BY l.pool ORDER BY l.ts, l.seq) AS n
        FROM row_log l LEFT JOIN mails m ON m.email = lower(trim(l.email)) LEFT JOIN cap_log c ON c.pool = l.pool LEFT JOIN paid p ON p.pool = l.pool),
    steps AS (
        SELECT pool, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS BIGINT) AS row_id, CAST(NULL AS BIGINT) AS place,
            CAST([] AS STRUCT({row})[]) AS rows FROM (SELECT DISTINCT pool FROM entries)
        UNION ALL
        SELECT pool, n, seq, action,
            CASE WHEN action IN ('held', 'waitlisted', 'created') THEN seq WHEN action = 'reused' THEN own.id WHEN action <> 'unmatched' THEN target.id END,
            CASE WHEN action = 'waitlisted' THEN waiting + 1 END,
            CASE WHEN action IN ('held', 'waitlisted', 'created') THEN list_append(rows, {{'n': n, 'id': seq, 'email': email, 'made': ts, 'status': 'pending',
                    'wait': action = 'waitlisted', 'promoted': CAST(NULL AS TIMESTAMP), 'paid': CAST(NULL AS TIMESTAMP), 'gone': CAST(NULL AS TIMESTAMP), 'payer': payer}})
                WHEN action IN ('reused', 'unmatched') THEN rows
                ELSE list_transform(rows, lambda r: CASE
                    WHEN r.n = target.n THEN {{'n': r.n, 'id': r.id, 'email': r.email, 'made': r.made,
                        'status': CASE action WHEN 'pay' THEN 'paid' WHEN 'waive' THEN 'waived' WHEN 'unmark' THEN 'pending' WHEN 'cancel' THEN 'cancelled' ELSE r.status END,
                        'wait': r.wait AND action <> 'promote', 'promoted': CASE WHEN action = 'promote' THEN ts ELSE r.promoted END,
                        'paid': CASE WHEN action IN ('pay', 'waive') THEN ts WHEN action = 'unmark' THEN NULL ELSE r.paid END,
                        'gone': CASE WHEN action = 'cancel' THEN ts WHEN action = 'promote' THEN r.gone END, 'payer': r.payer}}
                    WHEN action = 'cancel' AND target.status <> 'cancelled' AND NOT target.wait AND r.n = head.n THEN {{'n': r.n, 'id': r.id, 'email': r.email, 'made': r.made,
                        'status': r.status, 'wait': false, 'promoted': ts, 'paid': r.paid, 'gone': r.gone, 'payer': r.payer}}
                    ELSE r END) END
        FROM (SELECT *, CASE WHEN kind = 'admin' THEN 'created'
                WHEN kind = 'create' THEN CASE WHEN own IS NOT NULL THEN 'reused' WHEN {full} THEN 'waitlisted' ELSE 'held' END
                WHEN target IS NULL OR (kind = 'promote' AND (NOT target.wait OR target.status = 'cancelled')) THEN 'unmatched' ELSE kind END AS action
            FROM (SELECT e.*, s.rows,
                    CASE WHEN e.wanted IS NULL THEN list_filter(s.rows, lambda r: r.email = e.email AND {live})[-1]
                        ELSE list_filter(s.rows, lambda r: r.id = e.wanted)[1] END AS target,
                    list_filter(s.rows, lambda r: r.email = e.email AND {active})[-1] AS own,
                    list_filter(s.rows, lambda r: r.wait AND {live})[1] AS head,
                    len(list_filter(s.rows, lambda r: r.wait AND {live})) AS waiting,
                    len(list_filter(s.rows, lambda r: {active} AND NOT r.payer)) AS taken
                FROM steps s JOIN entries e ON e.pool = s.pool AND e.n = s.n + 1)))
    """


_BY_ROW = _by_row(False, "r.made")
_TOLD = "SELECT pool, seq, action, coalesce(row_id, -1) AS row_id, CAST(coalesce(place, 0) AS INT) AS waitlist_position FROM steps WHERE n > 0"
_ROW_INPUTS = ("row_log", "cap_log", "payers")


@query("replay_row_commands", _BY_ROW + _TOLD, *_ROW_INPUTS)
def replay_row_commands(t):
    """Commands that name a row by id, cancelled ones too, promotions out of turn, and rows made by an administrator."""
    return replay.replay_requests(t.row_log, t.cap_log, t.payers)[0].fillna(ABSENT)


@query(
    "replay_row_states",
    _BY_ROW
    + """SELECT pool, r.n, r.id, r.email, r.made AS created_at, r.status AS payment_status, r.wait AS is_waitlist, r.promoted AS promoted_at, r.paid AS paid_at,
        r.gone AS cancelled_at, r.payer AS is_payer
    FROM (SELECT pool, unnest(arg_max(rows, n)) AS r FROM steps GROUP BY pool)""",
    *_ROW_INPUTS,
)
def replay_row_states(t):
    return replay.replay_requests(t.row_log, t.cap_log, t.payers)[1]


@query("replay_fair", _by_row(True, "coalesce(r.promoted, r.made)") + _TOLD, *_ROW_INPUTS)
def replay_fair(t):
    """Nobody passes the waitlist, and a promoted row's hold counts from its promotion."""
    return replay.replay_requests(t.row_log, t.cap_log, t.payers, fair=True, hold_from="promoted_at")[0].fillna(ABSENT)


@query("stream_dedupe", _kept(1440))
def stream_dedupe(t):
    """The event table as a stream; the kept rows equal the batch result."""
    marked = dedupe_stream(t.stream("events"), ["user_id", "event_type"], "ts", "event_id", timedelta(minutes=1440))
    rows = drain_to_table(marked, "dedupe")
    return rows.filter("outcome = 'kept'").drop("outcome", "kept_id")


@query("stream_admission", _DECISIONS, *_INPUTS)
def stream_admission(t):
    rows = drain_to_table(admit_stream(t.stream("request_log"), t.cap_log, t.payers), "admission")
    return rows.filter("seq IS NOT NULL").select("pool", "seq", "action", "row_id", "waitlist_position").fillna(ABSENT)


_IN_ORDER = "SELECT *, 'kept' AS outcome FROM ({})"


@query("stream_dedupe_shuffled", _IN_ORDER.format(_kept(1440)))
def stream_dedupe_shuffled(t):
    """Files out of order within the delay: the kept rows equal the batch result, and nothing is late."""
    events, delay = t.shuffled("events", "events", "ts")
    whole, finish = closable(events, "ts")
    marked = dedupe_stream(whole, ["user_id", "event_type"], "ts", "event_id", timedelta(minutes=1440), delay=delay)
    return drain_to_table(marked, "dedupe", finish).filter("outcome <> 'reused'").drop("kept_id")


@query("stream_admission_shuffled", _DECISIONS, *_INPUTS)
def stream_admission_shuffled(t):
    log, delay = t.shuffled("request_log", "events", "ts")
    whole, finish = closable(log, "ts")
    rows = drain_to_table(admit_stream(whole, t.cap_log, t.payers, delay=delay), "admission", finish)
    return rows.filter("seq IS NOT NULL").select("pool", "seq", "action", "row_id", "waitlist_position").fillna(ABSENT)


# A pool's job at instant i (every seven days) expires what is stale and promotes as many. Both are prefixes, of the holds and of the queue in order,
# so two counts per instant say all: ``up`` rows promoted and ``gone`` promoted rows expired. Waiting rows that are paid never expire.
_EXPIRY = """WITH RECURSIVE week AS (SELECT 7 * 86400000000 AS w, 30 * 86400000000 AS hold),
    line AS (SELECT pool, id, epoch_us(created_at) AS c, payment_status = 'pending' AS p, row_number() OVER (PARTITION BY pool ORDER BY created_at, id) AS r
        FROM requests WHERE is_waitlist AND payment_status <> 'cancelled'),
    queue AS (SELECT *, CAST(sum(CASE WHEN p THEN 1 ELSE 0 END) OVER (PARTITION BY pool ORDER BY r) AS BIGINT) AS np FROM line),
    holds AS (SELECT pool, id, epoch_us(created_at) AS c FROM requests WHERE payment_status = 'pending' AND NOT is_waitlist),
    span AS (SELECT min(epoch_us(created_at)) // w - 1 AS i0, (max(epoch_us(created_at)) + hold) // w + 1 AS i1 FROM requests, week GROUP BY w, hold),
    instants AS (SELECT pool, unnest(range(i0, i1 + 1)) AS i FROM span, (SELECT DISTINCT pool FROM requests)),
    hold_counts AS (SELECT pool, c, sum(count(*)) OVER (PARTITION BY pool ORDER BY c) AS n FROM holds GROUP BY pool, c),
    line_counts AS (SELECT pool, c, sum(count(*)) OVER (PARTITION BY pool ORDER BY c) AS n FROM line GROUP BY pool, c),
    counts AS MATERIALIZED (SELECT n.pool, list(coalesce(h.n, 0) ORDER BY n.i) AS o, list(coalesce(a.n, 0) ORDER BY n.i) AS avail, list(coalesce(d.n, 0) ORDER BY n.i) AS old
        FROM (SELECT pool, i, i * w AS t, i * w - hold AS stale FROM instants, week) n
            ASOF LEFT JOIN hold_counts h ON h.pool = n.pool AND n.stale > h.c
            ASOF LEFT JOIN line_counts a ON a.pool = n.pool AND n.t >= a.c
            ASOF LEFT JOIN line_counts d ON d.pool = n.pool AND n.stale > d.c GROUP BY n.pool),
    known AS MATERIALIZED (SELECT c.*, coalesce(q.np, []) AS np FROM counts c LEFT JOIN (SELECT pool, list(np ORDER BY r) AS np FROM queue GROUP BY pool) q ON q.pool = c.pool),
    runs AS (SELECT pool, i0 AS i, CAST(0 AS BIGINT) AS up, CAST(0 AS BIGINT) AS gone, CAST(0 AS BIGINT) AS o FROM span, (SELECT DISTINCT pool FROM requests)
        UNION ALL
        SELECT pool, i + 1, CAST(least(now_avail, up + now_o - o + now_gone - gone) AS BIGINT), now_gone, now_o
        FROM (SELECT r.*, CAST(n.o[least(r.i + 1, i1) - i0 + 1] AS BIGINT) AS now_o, CAST(n.avail[least(r.i + 1, i1) - i0 + 1] AS BIGINT) AS now_avail,
                CAST(coalesce(n.np[least(r.up, CAST(n.old[least(r.i + 1, i1) - i0 + 1] AS BIGINT))], 0) AS BIGINT) AS now_gone, coalesce(n.np[r.up], 0) AS all_gone, i1
            FROM runs r CROSS JOIN span JOIN known n ON n.pool = r.pool)
        WHERE i < i1 OR gone < all_gone),
    ups AS (SELECT pool, up, min(i) AS i FROM runs GROUP BY ALL),
    ends AS (SELECT pool, gone, min(i) AS i FROM runs GROUP BY ALL),
    changes AS (
        SELECT pool, id, 'expired' AS action, (c + hold) // w + 1 AS i FROM holds, week
        UNION ALL SELECT q.pool, q.id, 'promoted', u.i FROM queue q ASOF JOIN ups u ON u.pool = q.pool AND q.r <= u.up
        UNION ALL SELECT q.pool, q.id, 'expired', e.i FROM (SELECT * FROM queue WHERE p) q ASOF JOIN ends e ON e.pool = q.pool AND q.np <= e.gone)
    SELECT pool, id, action, make_timestamp(i * w) AS at FROM changes, week"""


@query("stream_expiry", _EXPIRY, "requests")
def stream_expiry(t):
    """The order table as a stream out of order; a weekly job expires holds of 30 days and promotes, until nothing is left to expire."""
    requests, delay = t.shuffled("requests", "orders", "o_orderdate")
    whole, finish = closable(requests, "created_at")
    changes = expire_stream(whole, delay, LONG_HOLD, timedelta(days=7))
    return drain_to_table(changes, "expiry", finish).withColumnRenamed("created_at", "at")
