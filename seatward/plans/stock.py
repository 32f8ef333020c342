"""Stock, holds, revenue and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from seatward.functions.rules import check_between, check_in, check_not_null, check_table
from seatward.functions.dims import STATUSES
from seatward.operators import payments, queue, stock
from seatward.plans.registry import AS_OF, CUTOFF, LONG_HOLD, query
from seatward.sources.streams import drain, run_folder
from seatward.streaming.live_stock import latest_stock, stock_at
from seatward.streaming.live_stock import stream_stock as live_stock

_WAIT = """wait AS (SELECT pool, CAST(count(*) AS INT) AS n FROM requests
    WHERE payment_status <> 'cancelled' AND is_waitlist GROUP BY pool)"""
_HELD = f"""held AS (SELECT pool, count(*) AS n FROM requests r
    WHERE NOT is_waitlist AND payment_status = 'pending' AND created_at > {CUTOFF}
      AND NOT EXISTS (SELECT 1 FROM payers p WHERE lower(p.email) = lower(r.email)) GROUP BY pool)"""
_PAID = "paid AS (SELECT pool, count(*) AS n FROM payers GROUP BY pool)"
_FINAL = f"""final AS (SELECT c.pool, c.capacity, CAST(coalesce(paid.n, 0) + coalesce(held.n, 0) AS INT) AS taken,
    CAST(greatest(c.capacity - coalesce(paid.n, 0) - coalesce(held.n, 0), 0) AS INT) AS remaining,
    coalesce(wait.n, 0) AS waitlist_count, c.ord
    FROM cap c LEFT JOIN paid USING (pool) LEFT JOIN held USING (pool) LEFT JOIN wait USING (pool))"""


@query("stock_final", f"WITH {_WAIT}, {_HELD}, {_PAID}, {_FINAL} SELECT * FROM final", "cap", "payers", "requests")
def stock_final(t):
    return stock.stock(t.cap, t.payers, t.requests, t.as_of, LONG_HOLD).orderBy("ord")


@query(
    "stock_payers",
    f"""WITH {_PAID} SELECT c.pool, c.capacity, CAST(coalesce(n, 0) AS INT) AS taken,
    CAST(c.capacity - coalesce(n, 0) AS INT) AS remaining, c.ord FROM cap c LEFT JOIN paid USING (pool)""",
    "cap",
    "payers",
)
def stock_payers(t):
    return stock.stock(t.cap, t.payers, None, policy="payers")


@query(
    "stock_live",
    f"""WITH {_WAIT}, live AS (SELECT pool, count(*) AS n FROM requests
        WHERE payment_status <> 'cancelled' AND NOT is_waitlist GROUP BY pool)
    SELECT c.pool, c.capacity, CAST(coalesce(live.n, 0) AS INT) AS taken,
        CAST(c.capacity - coalesce(live.n, 0) AS INT) AS remaining, coalesce(wait.n, 0) AS waitlist_count, c.ord
    FROM cap c LEFT JOIN live USING (pool) LEFT JOIN wait USING (pool)""",
    "cap",
    "requests",
)
def stock_live(t):
    return stock.stock(t.cap, None, t.requests, policy="live")


@query(
    "stock_status_policy",
    f"""WITH {_WAIT}, occ AS (SELECT pool, count(*) AS n FROM requests WHERE NOT is_waitlist
        AND (payment_status IN ('paid', 'waived') OR (payment_status = 'pending' AND created_at > {CUTOFF})) GROUP BY pool)
    SELECT c.pool, c.capacity, CAST(coalesce(occ.n, 0) AS INT) AS taken,
        CAST(greatest(c.capacity - coalesce(occ.n, 0), 0) AS INT) AS remaining, coalesce(wait.n, 0) AS waitlist_count, c.ord
    FROM cap c LEFT JOIN occ USING (pool) LEFT JOIN wait USING (pool)""",
    "cap",
    "requests",
)
def stock_status_policy(t):
    return stock.stock(t.cap, None, t.requests, t.as_of, LONG_HOLD, policy="status")


@query(
    "stock_by_event",
    f"""WITH r AS (SELECT *, year(created_at) AS event FROM requests),
    c AS (SELECT DISTINCT event, pool, CAST(1000 AS INT) AS capacity FROM r),
    held AS (SELECT event, pool, count(*) AS n FROM r WHERE NOT is_waitlist AND payment_status = 'pending'
        AND created_at > {CUTOFF} AND NOT EXISTS (SELECT 1 FROM payers p WHERE lower(p.email) = lower(r.email))
        GROUP BY event, pool),
    paid AS (SELECT year(imported_at) - 25 AS event, pool, count(*) AS n FROM payers GROUP BY 1, 2),
    wait AS (SELECT event, pool, CAST(count(*) AS INT) AS n FROM r WHERE payment_status <> 'cancelled' AND is_waitlist
        GROUP BY event, pool)
    SELECT CAST(c.event AS INT) AS event, c.pool, c.capacity, CAST(coalesce(paid.n, 0) + coalesce(held.n, 0) AS INT) AS taken,
        CAST(greatest(c.capacity - coalesce(paid.n, 0) - coalesce(held.n, 0), 0) AS INT) AS remaining,
        coalesce(wait.n, 0) AS waitlist_count
    FROM c LEFT JOIN paid USING (event, pool) LEFT JOIN held USING (event, pool) LEFT JOIN wait USING (event, pool)""",
    "payers",
    "requests",
)
def stock_by_event(t):
    """The same operator on a two-column pool key."""
    keys = ["event", "pool"]
    requests = t.requests.withColumn("event", F.year("created_at"))
    payers = t.payers.withColumn("event", F.year("imported_at") - 25)
    cap = requests.select(*keys).distinct().withColumn("capacity", F.lit(1000))
    return stock.stock(cap, payers, requests, t.as_of, LONG_HOLD, keys=keys)


_ROOMS = """taken AS (SELECT room_type, count(*) AS n FROM rooms WHERE payment_status <> 'cancelled' GROUP BY room_type),
    room_stock AS (SELECT c.room_type, c.capacity, CAST(coalesce(n, 0) AS INT) AS taken,
        CAST(c.capacity - coalesce(n, 0) AS INT) AS remaining, c.ord FROM room_cap c LEFT JOIN taken USING (room_type))"""


@query("rooms_stock", f"WITH {_ROOMS} SELECT * FROM room_stock", "room_cap", "rooms")
def rooms_stock(t):
    return stock.simple_stock(t.room_cap, t.rooms).orderBy("ord")


@query(
    "stock_state",
    f"""WITH {_WAIT}, {_HELD}, {_PAID}, {_FINAL} SELECT *, CASE WHEN remaining <= 0 THEN 'full'
        WHEN remaining <= 3 THEN 'tight' ELSE 'open' END AS state,
        CAST(CASE WHEN remaining <= 0 THEN waitlist_count + 1 ELSE 0 END AS INT) AS next_position FROM final""",
    "cap",
    "payers",
    "requests",
)
def stock_state(t):
    labelled = stock.stock_state(stock.stock(t.cap, t.payers, t.requests, t.as_of, LONG_HOLD))
    return labelled.fillna(0, ["next_position"])


@query("rooms_state", f"""WITH {_ROOMS} SELECT *, CASE WHEN remaining <= 0 THEN 'full' WHEN remaining <= 3 THEN 'tight'
    ELSE 'open' END AS state FROM room_stock""", "room_cap", "rooms")
def rooms_state(t):
    return stock.stock_state(stock.simple_stock(t.room_cap, t.rooms))


@query(
    "holds_active",
    f"""SELECT id, email, pool, created_at FROM requests WHERE NOT is_waitlist AND payment_status = 'pending'
        AND created_at > {CUTOFF}""",
    "requests",
)
def holds_active(t):
    return stock.active_holds(t.requests, t.as_of, LONG_HOLD).select("id", "email", "pool", "created_at")


@query(
    "unpaid_holds",
    """SELECT r.id, r.email, r.pool FROM requests r WHERE NOT is_waitlist AND payment_status = 'pending'
        AND NOT EXISTS (SELECT 1 FROM payers p WHERE lower(p.email) = lower(r.email))""",
    "requests",
    "payers",
)
def unpaid_holds(t):
    holds = t.requests.filter(~F.col("is_waitlist") & (F.col("payment_status") == "pending"))
    return stock.unpaid_holds(holds, t.payers).select("id", "email", "pool")


_REVENUE = """SELECT coalesce(pool, '(autre)') AS pool, CAST(count(*) AS INT) AS nb,
    CAST(coalesce(sum(montant_eur), 0) AS DECIMAL(18,2)) AS total_eur FROM payers GROUP BY 1"""


@query(
    "revenue",
    f"""WITH rev AS ({_REVENUE}) SELECT pool, nb, CAST(total_eur AS DOUBLE) AS total_eur,
        CAST((SELECT sum(total_eur) FROM rev) AS DOUBLE) AS grand_total FROM rev""",
    "payers",
)
def revenue(t):
    return stock.with_grand_total(stock.revenue(t.payers)).orderBy("pool")


@query(
    "status_summary",
    """SELECT pool, payment_status, CAST(count(*) AS INT) AS nb, CAST(sum(amount_eur) AS DOUBLE) AS total_eur
        FROM requests GROUP BY pool, payment_status""",
    "requests",
)
def status_summary(t):
    return stock.status_summary(t.requests).orderBy("pool", "payment_status")


@query(
    "captains",
    "SELECT id, email FROM requests WHERE pool = 'equipe' AND role = 'capitaine'",
    "requests",
)
def captains(t):
    return stock.captains(t.requests).select("id", "email")


_TIMELINE = """reads AS (SELECT DISTINCT pool, created_at AS instant FROM requests),
    h AS (SELECT pool, created_at FROM requests r WHERE NOT is_waitlist AND payment_status = 'pending' {paid}),
    line AS (SELECT reads.pool, instant, CAST(count(h.created_at) AS INT) AS active_holds FROM reads LEFT JOIN h
        ON h.pool = reads.pool AND h.created_at <= instant AND h.created_at > instant - INTERVAL 30 DAY GROUP BY reads.pool, instant)"""


@query("holds_timeline", f"WITH {_TIMELINE.format(paid='')} SELECT * FROM line", "requests")
def holds_timeline(t):
    reads = t.requests.select("pool", F.col("created_at").alias("instant"))
    return stock.holds_timeline(t.requests, reads, LONG_HOLD)


_NOT_PAID = "AND NOT EXISTS (SELECT 1 FROM payers p WHERE lower(p.email) = lower(r.email))"


@query(
    "stock_timeline",
    f"""WITH {_PAID}, {_TIMELINE.format(paid=_NOT_PAID)}
    SELECT line.pool, instant, CAST(coalesce(n, 0) + active_holds AS INT) AS taken,
        CAST(greatest(capacity + 400 - coalesce(n, 0) - active_holds, 0) AS INT) AS remaining
    FROM line JOIN cap USING (pool) LEFT JOIN paid USING (pool)""",
    "requests",
    "payers",
    "cap",
)
def stock_timeline(t):
    reads = t.requests.select("pool", F.col("created_at").alias("instant"))
    cap = t.cap.withColumn("capacity", F.col("capacity") + 400)
    return stock.stock_timeline(cap, t.payers, t.requests, reads, LONG_HOLD)


@query(
    "stock_history",
    """WITH reads AS (SELECT DISTINCT pool, created_at AS instant FROM requests),
    mails AS (SELECT lower(email) AS mail, CASE WHEN count(*) > count(imported_at) THEN TIMESTAMP '1900-01-01' ELSE min(imported_at) END AS since
        FROM dated_payers GROUP BY 1),
    holds AS (SELECT r.pool, r.created_at AS a, least(r.created_at + INTERVAL 30 DAY, m.since) AS b FROM requests r LEFT JOIN mails m ON m.mail = lower(r.email)
        WHERE NOT is_waitlist AND payment_status = 'pending'),
    held AS (SELECT s.pool, s.instant, count(h.a) AS n FROM reads s LEFT JOIN holds h ON h.pool = s.pool AND h.a <= s.instant AND s.instant < h.b GROUP BY ALL),
    paid AS (SELECT s.pool, s.instant, count(p.id) AS n FROM reads s
        LEFT JOIN dated_payers p ON p.pool = s.pool AND coalesce(p.imported_at, TIMESTAMP '1900-01-01') <= s.instant GROUP BY ALL)
    SELECT pool, instant, CAST(held.n + paid.n AS INT) AS taken, CAST(greatest(capacity + 400 - held.n - paid.n, 0) AS INT) AS remaining
    FROM held JOIN paid USING (pool, instant) JOIN cap USING (pool)""",
    "requests",
    "dated_payers",
    "cap",
)
def stock_history(t):
    reads = t.requests.select("pool", F.col("created_at").alias("instant"))
    cap = t.cap.withColumn("capacity", F.col("capacity") + 400)
    return stock.stock_history(cap, t.dated_payers, t.requests, reads, LONG_HOLD)


@query(
    "waitlist_queue",
    """SELECT id, pool, email, created_at, CAST(row_number() OVER (PARTITION BY pool ORDER BY created_at, id) AS INT)
        AS queue_position FROM requests WHERE is_waitlist AND payment_status <> 'cancelled'""",
    "requests",
)
def waitlist_queue(t):
    return queue.waitlist_queue(t.requests).select("id", "pool", "email", "created_at", "queue_position")


@query(
    "waitlist_queue_one_pool",
    """SELECT id, pool, CAST(row_number() OVER (ORDER BY created_at, id) AS INT) AS queue_position FROM requests
        WHERE is_waitlist AND payment_status <> 'cancelled' AND pool = 'narratif'""",
    "requests",
)
def waitlist_queue_one_pool(t):
    return queue.waitlist_queue(t.requests, "narratif").select("id", "pool", "queue_position")


@query(
    "waitlist_position",
    """SELECT id, pool, CAST(count(*) OVER (PARTITION BY pool ORDER BY created_at) AS INT) AS waitlist_position
        FROM requests WHERE is_waitlist AND payment_status <> 'cancelled'""",
    "requests",
)
def waitlist_position(t):
    return queue.waitlist_position(t.requests).select("id", "pool", "waitlist_position")


@query(
    "latest_hold",
    f"""SELECT email, pool, id, created_at FROM (SELECT lower(email) AS email, pool, id, created_at,
        row_number() OVER (PARTITION BY lower(email), pool ORDER BY created_at DESC, id DESC) AS rn FROM requests
        WHERE NOT is_waitlist AND payment_status = 'pending' AND created_at > {CUTOFF}) WHERE rn = 1""",
    "requests",
)
def latest_hold(t):
    return queue.latest_hold(t.requests, t.as_of, LONG_HOLD)


@query(
    "backfill_counts",
    """SELECT pool, CAST(count(*) AS INT) AS backfilled FROM requests
        WHERE payment_status = 'paid' AND admin_notes LIKE 'Backfill phase 7c%' GROUP BY pool""",
    "requests",
)
def backfill_counts(t):
    return payments.backfill_counts(t.requests).orderBy("pool")


@query(
    "rule_check",
    """SELECT 'amount_eur_not_null' AS rule, count(*) FILTER (WHERE amount_eur IS NULL) AS bad_rows FROM forms
    UNION ALL SELECT 'nom_not_null', count(*) FILTER (WHERE nom IS NULL) FROM forms
    UNION ALL SELECT 'pool_not_null', count(*) FILTER (WHERE pool IS NULL) FROM forms
    UNION ALL SELECT 'pool_in', count(*) FILTER (WHERE pool NOT IN ('equipe', 'jeu_libre', 'narratif')) FROM forms
    UNION ALL SELECT 'role_in', count(*) FILTER (WHERE role NOT IN ('capitaine', 'coequipier')) FROM forms
    UNION ALL SELECT 'payment_status_in', count(*) FILTER (WHERE payment_status NOT IN ('pending','paid','waived','cancelled')) FROM forms
    UNION ALL SELECT 'amount_eur_between', count(*) FILTER (WHERE amount_eur NOT BETWEEN 1000 AND 400000) FROM forms
    UNION ALL SELECT 'email_unique', CAST(count(*) - count(DISTINCT email) AS BIGINT) FROM forms WHERE email IS NOT NULL
    UNION ALL SELECT 'email_pool_unique', CAST(count(*) - count(DISTINCT (email, pool)) AS BIGINT) FROM forms
        WHERE email IS NOT NULL AND pool IS NOT NULL""",
    "forms",
)
def rule_check(t):
    rules = [
        *check_not_null("amount_eur", "nom", "pool"),
        check_in("pool", ["equipe", "jeu_libre", "narratif"]),
        check_in("role", ["capitaine", "coequipier"]),
        check_in("payment_status", STATUSES),
        check_between("amount_eur", 1000, 400000),
    ]
    return check_table(t.forms, rules, {"email_unique": ["email"], "email_pool_unique": ["email", "pool"]})


@query(
    "stream_stock",
    f"WITH {_WAIT}, {_HELD}, {_PAID}, {_FINAL} SELECT *, {AS_OF} AS as_of FROM final",
    "cap",
    "payers",
    "requests",
)
def stream_stock(t):
    """The order table as a stream; one file is one micro-batch."""
    spark = t.requests.sparkSession
    base = run_folder(spark, "stock")
    writer = live_stock(t.stream("requests"), t.cap, t.payers, f"{base}/rows", f"{base}/stock", LONG_HOLD)
    drain(spark, writer, f"{base}/progress")
    return latest_stock(spark, f"{base}/stock")


_LATER = f"({AS_OF} + INTERVAL 10 DAY)"


@query(
    "stream_stock_later",
    f"WITH {_WAIT}, {_HELD.replace(CUTOFF, f'({_LATER} - INTERVAL 30 DAY)')}, {_PAID}, {_FINAL} SELECT * FROM final",
    "cap",
    "payers",
    "requests",
)
def stream_stock_later(t):
    """The order table in files out of order; ten days after the last row the stock has let go of more holds, with no row having come."""
    spark = t.requests.sparkSession
    base = run_folder(spark, "stock")
    requests, _ = t.shuffled("requests", "orders", "o_orderdate")
    drain(spark, live_stock(requests, t.cap, t.payers, f"{base}/rows", f"{base}/stock", LONG_HOLD), f"{base}/progress")
    later = t.requests.agg(F.max("created_at") + F.expr("INTERVAL 10 DAYS")).scalar()
    return stock_at(spark, f"{base}/rows", t.cap, t.payers, later)
