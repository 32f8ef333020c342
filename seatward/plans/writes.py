"""Snapshot transforms: inserts, promotion, expiry, status commands, admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from seatward.functions.dims import pool_price, room_price
from seatward.functions.rules import room_rules
from seatward.operators import admission, payments, queue, stock, writes
from seatward.plans.registry import AS_OF, CUTOFF, LONG_HOLD, query

_SNAP = ["id", "pool", "payment_status", "is_waitlist", "promoted_at", "cancelled_at", "admin_notes"]
_PRICE = "CAST(CASE pool WHEN 'equipe' THEN 325 ELSE 65 END AS DECIMAL(8,2))"


@query(
    "insert_ignore",
    """WITH fresh AS (SELECT email, min(id) AS id FROM requests GROUP BY email)
    SELECT email, id FROM payers UNION ALL SELECT email, id FROM fresh WHERE email NOT IN (SELECT email FROM payers)""",
    "payers",
    "requests",
)
def insert_ignore(t):
    return writes.insert_ignore(t.payers.select("email", "id"), t.requests.select("email", "id"), ["email"], F.col("id"))


_BACKFILL = """SELECT coalesce(nullif(trim(nom), ''), '—') AS nom, coalesce(nullif(trim(prenom), ''), '—') AS prenom,
        lower(trim(email)) AS email, CAST(NULL AS VARCHAR) AS telephone, pool, nullif(trim(team_label), '') AS team_name,
        CASE WHEN pool = 'equipe' THEN 'capitaine' END AS role, CAST(coalesce(montant_eur, 65.0) AS DOUBLE) AS amount_eur,
        'paid' AS payment_status, imported_at AS paid_at,
        'Backfill phase 7c — depuis paid_users · ' || coalesce('tx=' || transaction_id, 'tx=manuel') AS admin_notes
    FROM payers p WHERE pool IN ('equipe', 'jeu_libre', 'narratif') AND NOT EXISTS (
        SELECT 1 FROM requests r WHERE lower(r.email) = lower(p.email) AND r.pool = p.pool)"""


@query("backfill", _BACKFILL, "payers", "requests")
def backfill(t):
    return payments.backfill(t.payers, t.requests, t.cap)


@query(
    "backfill_append",
    f"""WITH b AS ({_BACKFILL}) SELECT email, pool, payment_status, CAST(amount_eur AS DOUBLE) AS amount_eur, false AS is_waitlist FROM b
    UNION ALL SELECT email, pool, payment_status, CAST(amount_eur AS DOUBLE), is_waitlist FROM requests""",
    "payers",
    "requests",
)
def backfill_append(t):
    target = t.requests.select("email", "pool", "payment_status", F.col("amount_eur").cast("decimal(12,2)"), "is_waitlist")
    return writes.append_rows(target, payments.backfill(t.payers, t.requests, t.cap), {"is_waitlist": False})


@query(
    "reprice",
    f"""SELECT id, pool, CAST(CASE WHEN amount_eur IS DISTINCT FROM {_PRICE} THEN {_PRICE} ELSE amount_eur END AS DOUBLE) AS amount_eur,
        amount_eur IS DISTINCT FROM {_PRICE} AS was_wrong FROM requests""",
    "requests",
)
def reprice(t):
    price = pool_price(F.col("pool"))
    flagged = t.requests.select("id", "pool", "amount_eur", payments.needs_reprice(price).alias("was_wrong"))
    return payments.reprice(flagged, price)


@query(
    "rooms_reprice",
    """SELECT id, room_type, CAST(CASE WHEN amount_eur IN (56, 42, 34) THEN CASE room_type WHEN 'simple' THEN 60
        WHEN 'double' THEN 90 ELSE 110 END ELSE amount_eur END AS DOUBLE) AS amount_eur FROM rooms""",
    "rooms",
)
def rooms_reprice(t):
    rows = t.rooms.select("id", "room_type", "amount_eur")
    return payments.reprice(rows, room_price(F.col("room_type")), [56, 42, 34])


@query(
    "delete_cancelled",
    "SELECT id, pool FROM requests WHERE NOT coalesce(payment_status = 'cancelled' AND admin_notes = 'note', false)",
    "requests",
)
def delete_cancelled(t):
    gone = (F.col("payment_status") == "cancelled") & (F.col("admin_notes") == "note")
    return writes.delete_where(t.requests, gone).select("id", "pool")


_PROMOTED = """freed AS (SELECT pool, count(*) AS n FROM requests r JOIN hit USING (id)
        WHERE payment_status <> 'cancelled' AND NOT is_waitlist GROUP BY pool),
    line AS (SELECT id, pool, row_number() OVER (PARTITION BY pool ORDER BY created_at, id) AS rn FROM requests
        WHERE is_waitlist AND payment_status <> 'cancelled' AND id NOT IN (SELECT id FROM hit)),
    heads AS (SELECT line.id FROM line JOIN freed USING (pool) WHERE rn <= n)"""


@query(
    "promote_batch",
    f"""WITH hit AS (SELECT id FROM requests WHERE role = 'capitaine'), {_PROMOTED}
    SELECT id, pool, CASE WHEN id IN (SELECT id FROM hit) THEN 'cancelled' ELSE payment_status END AS payment_status,
        is_waitlist AND id NOT IN (SELECT id FROM heads) AS is_waitlist,
        CASE WHEN id IN (SELECT id FROM heads) THEN {AS_OF} END AS promoted_at,
        CASE WHEN id IN (SELECT id FROM hit) THEN {AS_OF} ELSE cancelled_at END AS cancelled_at, admin_notes FROM requests""",
    "requests",
)
def promote_batch(t):
    ids = t.requests.filter("role = 'capitaine'").select("id")
    return queue.promote_batch(t.requests, ids, t.as_of).select(*_SNAP)


@query(
    "promote_entries",
    f"""WITH hit AS (SELECT id FROM requests WHERE role = 'capitaine' AND is_waitlist AND payment_status <> 'cancelled')
    SELECT id, pool, payment_status, is_waitlist AND id NOT IN (SELECT id FROM hit) AS is_waitlist,
        CASE WHEN id IN (SELECT id FROM hit) THEN {AS_OF} END AS promoted_at, cancelled_at, admin_notes FROM requests""",
    "requests",
)
def promote_entries(t):
    ids = t.requests.filter("role = 'capitaine'").select("id")
    return queue.promote_entries(t.requests, ids, t.as_of)[0].select(*_SNAP)


@query(
    "promote_unmatched",
    """SELECT DISTINCT c.id FROM commands c WHERE c.id NOT IN (SELECT id FROM requests WHERE is_waitlist AND payment_status <> 'cancelled')""",
    "requests",
    "commands",
)
def promote_unmatched(t):
    """Ids to promote that name no live waitlist row."""
    return queue.promote_entries(t.requests, t.commands.select("id"), t.as_of)[1]


@query(
    "expire_holds",
    f"""WITH hit AS (SELECT id FROM requests WHERE payment_status = 'pending' AND NOT is_waitlist AND created_at < {CUTOFF}),
    {_PROMOTED}
    SELECT id, pool, CASE WHEN id IN (SELECT id FROM hit) THEN 'cancelled' ELSE payment_status END AS payment_status,
        is_waitlist AND id NOT IN (SELECT id FROM heads) AS is_waitlist,
        CASE WHEN id IN (SELECT id FROM heads) THEN {AS_OF} END AS promoted_at,
        CASE WHEN id IN (SELECT id FROM hit) THEN {AS_OF} ELSE cancelled_at END AS cancelled_at,
        CASE WHEN id IN (SELECT id FROM hit) THEN coalesce(admin_notes || chr(10), '') || '↳ Hold expiré (>30 min sans paiement)'
            ELSE admin_notes END AS admin_notes FROM requests""",
    "requests",
)
def expire_holds(t):
    return queue.expire_holds(t.requests, t.as_of, LONG_HOLD).select(*_SNAP)


_STATUS = """known AS (SELECT * FROM commands WHERE action IN ('paid', 'waived', 'unmark', 'cancel')),
    last AS (SELECT id, action, ts FROM known QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, seq DESC) = 1),
    pay AS (SELECT id, action, ts FROM known WHERE action <> 'cancel' QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, seq DESC) = 1),
    lines AS (SELECT id, string_agg('↳ Annulée le ' || strftime(ts, '%d/%m/%Y %H:%M') || coalesce(' — ' || reason, ''), chr(10) ORDER BY ts, seq) AS txt
        FROM known WHERE action = 'cancel' GROUP BY id),
    after AS (SELECT r.id, r.pool, r.is_waitlist,
        CASE last.action WHEN 'unmark' THEN 'pending' WHEN 'cancel' THEN 'cancelled' ELSE coalesce(last.action, r.payment_status) END AS payment_status,
        CASE WHEN pay.id IS NULL THEN r.paid_at WHEN pay.action <> 'unmark' THEN pay.ts END AS paid_at,
        CASE WHEN last.id IS NULL THEN r.cancelled_at WHEN last.action = 'cancel' THEN last.ts END AS cancelled_at,
        CASE WHEN txt IS NULL THEN r.admin_notes ELSE coalesce(r.admin_notes || chr(10), '') || txt END AS admin_notes
        FROM requests r LEFT JOIN last USING (id) LEFT JOIN pay USING (id) LEFT JOIN lines USING (id))"""


@query(
    "apply_status",
    f"WITH {_STATUS} SELECT id, payment_status, paid_at, cancelled_at, admin_notes FROM after",
    "requests",
    "commands",
)
def apply_status(t):
    after, _ = payments.apply_status(t.requests, t.commands)
    return after.select("id", "payment_status", "paid_at", "cancelled_at", "admin_notes")


@query(
    "status_unmatched",
    "SELECT id, seq, action FROM commands WHERE id NOT IN (SELECT id FROM requests)",
    "requests",
    "commands",
)
def status_unmatched(t):
    return payments.apply_status(t.requests, t.commands)[1].select("id", "seq", "action")


@query(
    "newly_cancelled",
    f"""WITH {_STATUS} SELECT a.id FROM after a JOIN requests r USING (id) WHERE a.payment_status = 'cancelled'
        AND r.payment_status <> 'cancelled' AND NOT r.is_waitlist""",
    "requests",
    "commands",
)
def newly_cancelled(t):
    return payments.newly_cancelled(t.requests, payments.apply_status(t.requests, t.commands)[0])


@query(
    "apply_edits",
    """WITH n AS (SELECT id, value FROM commands WHERE action = 'notes' QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, seq DESC) = 1),
    u AS (SELECT id, value FROM commands WHERE action = 'payment_url' QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, seq DESC) = 1)
    SELECT r.id, CASE WHEN n.id IS NOT NULL THEN n.value ELSE admin_notes END AS admin_notes,
        CASE WHEN u.id IS NOT NULL THEN nullif(trim(u.value), '') ELSE 'https://pay.example.com/' || r.pool END AS custom_payment_url
    FROM requests r LEFT JOIN n USING (id) LEFT JOIN u USING (id)""",
    "requests",
    "commands",
)
def apply_edits(t):
    url = F.concat(F.lit("https://pay.example.com/"), F.col("pool"))
    rows = t.requests.select("id", "admin_notes", url.alias("custom_payment_url"))
    return payments.apply_edits(rows, t.commands)[0]


@query(
    "edits_unmatched",
    "SELECT id, seq, action, value FROM commands WHERE action IN ('notes', 'payment_url') AND id NOT IN (SELECT id FROM requests)",
    "requests",
    "commands",
)
def edits_unmatched(t):
    edits = t.commands.filter(F.col("action").isin("notes", "payment_url"))
    rows = t.requests.select("id", "admin_notes", F.lit(None).cast("string").alias("custom_payment_url"))
    return payments.apply_edits(rows, edits)[1].select("id", "seq", "action", "value")


@query(
    "stamp_updated",
    f"""WITH {_STATUS} SELECT a.id, a.payment_status, a.admin_notes, CASE WHEN a.payment_status IS DISTINCT FROM r.payment_status
        OR a.admin_notes IS DISTINCT FROM r.admin_notes THEN {AS_OF} ELSE r.created_at END AS updated_at
    FROM after a JOIN requests r USING (id)""",
    "requests",
    "commands",
)
def stamp_updated(t):
    stamped = t.requests.withColumn("updated_at", F.col("created_at"))
    cols = ["id", "payment_status", "admin_notes", "updated_at"]
    after, _ = payments.apply_status(stamped, t.commands)
    return writes.stamp_updated(stamped.select(*cols), after.select(*cols), t.as_of)


@query(
    "admit_batch",
    """WITH ranked AS (SELECT id, pool, row_number() OVER (PARTITION BY pool ORDER BY created_at, id) AS rn FROM requests),
    s AS (SELECT pool, CAST(sum(expected_champions) AS INT) AS remaining, count(*) FILTER (WHERE montant_eur IS NULL) AS waitlist_count
        FROM payers GROUP BY pool)
    SELECT id, pool, CASE WHEN rn <= remaining THEN 'held' ELSE 'waitlisted' END AS decision, NOT (rn <= remaining) AS is_waitlist,
        CAST(CASE WHEN rn > remaining THEN waitlist_count + rn - remaining ELSE 0 END AS INT) AS waitlist_position
    FROM ranked JOIN s USING (pool)""",
    "requests",
    "payers",
)
def admit_batch(t):
    """A stock that grows with the tables: places are those the payers of the pool expect."""
    places = t.payers.groupBy("pool").agg(
        F.sum("expected_champions").cast("int").alias("remaining"),
        F.count_if(F.col("montant_eur").isNull()).alias("waitlist_count"),
    )
    decided = admission.admit_batch(places, t.requests.select("id", "pool", "created_at"))
    return decided.drop("created_at").fillna(0, ["waitlist_position"])


_FORM_REASON = """CASE WHEN nom IS NULL OR trim(nom) = '' THEN 'nom_blank' WHEN prenom IS NULL OR trim(prenom) = '' THEN 'prenom_blank'
        WHEN email IS NULL OR trim(email) = '' OR NOT regexp_matches(email, '^[^@]+@[^@]+\\.[^@]+$') THEN 'email_invalid'
        WHEN room_type NOT IN ('simple', 'double', 'triple') THEN 'type_invalid' END"""


@query(
    "room_requests",
    f"""WITH s AS (SELECT room_type, CAST(floor(count(*) / 2) AS INT) AS remaining FROM rooms WHERE payment_status = 'pending' GROUP BY room_type),
    f AS (SELECT *, {_FORM_REASON} AS bad FROM forms),
    ranked AS (SELECT id, row_number() OVER (PARTITION BY room_type ORDER BY created_at, id) AS rn FROM f WHERE bad IS NULL),
    d AS (SELECT f.*, coalesce(bad, CASE WHEN rn > coalesce(remaining, 0) THEN 'sold_out' END) AS reason
        FROM f LEFT JOIN ranked USING (id) LEFT JOIN s USING (room_type))
    SELECT id, trim(nom) AS nom, trim(prenom) AS prenom, nullif(trim(telephone), '') AS telephone, lower(trim(email)) AS email, room_type, reason, CASE WHEN reason IS NULL THEN 'held' ELSE 'rejected' END AS decision,
        CAST(CASE WHEN reason IS NULL THEN 2 ELSE 0 END AS INT) AS nights,
        CAST(CASE WHEN reason IS NULL THEN CASE room_type WHEN 'simple' THEN 60 WHEN 'double' THEN 90 ELSE 110 END END AS DOUBLE) AS amount_eur,
        CASE WHEN reason IS NULL AND trim(co_occupants) <> '' THEN 'Co-occupants prévus : ' || trim(co_occupants) END AS admin_notes FROM d""",
    "forms",
    "rooms",
)
def room_requests(t):
    pending = t.rooms.filter("payment_status = 'pending'").groupBy("room_type")
    places = pending.agg(F.floor(F.count(F.lit(1)) / 2).cast("int").alias("remaining"))
    out = admission.room_requests(places, t.forms, room_rules()).fillna(0, ["nights"])
    return out.select("id", "nom", "prenom", "telephone", "email", "room_type", "reason", "decision", "nights", "amount_eur", "admin_notes")


@query(
    "admin_create",
    f"""WITH s AS (SELECT pool, CAST(sum(expected_champions) AS INT) AS remaining FROM payers GROUP BY pool),
    f AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY created_at, id) AS rn FROM forms
        WHERE payment_status IN ('pending', 'paid', 'waived') AND pool IN ('equipe', 'jeu_libre', 'narratif'))
    SELECT id, trim(coalesce(nom, '')) AS nom, lower(trim(coalesce(email, ''))) AS email, nullif(trim(telephone), '') AS telephone, pool,
        CAST({_PRICE} AS DOUBLE) AS amount_eur, payment_status,
        CASE WHEN payment_status = 'paid' THEN (SELECT max(created_at) FROM requests) END AS paid_at,
        NOT (rn <= coalesce(remaining, 0)) AS overbooked FROM f LEFT JOIN s USING (pool)""",
    "forms",
    "payers",
    "requests",
)
def admin_create(t):
    places = t.payers.groupBy("pool").agg(F.sum("expected_champions").cast("int").alias("remaining"))
    out = admission.admin_create(t.forms, t.as_of, places)
    return out.select("id", "nom", "email", "telephone", "pool", "amount_eur", "payment_status", "paid_at", "overbooked")


@query(
    "admin_create_rooms",
    """SELECT id, room_type, CAST(CASE room_type WHEN 'simple' THEN 60 WHEN 'double' THEN 90 WHEN 'triple' THEN 110 END AS DOUBLE)
        AS amount_eur, payment_status FROM forms WHERE payment_status IN ('pending', 'paid', 'waived')
        AND room_type IN ('simple', 'double', 'triple')""",
    "forms",
)
def admin_create_rooms(t):
    out = admission.admin_create(t.forms, t.as_of, key="room_type", price=room_price(F.col("room_type")))
    return out.select("id", "room_type", "amount_eur", "payment_status")


@query(
    "admin_rejected",
    """SELECT id, CASE WHEN pool IS NULL OR pool NOT IN ('equipe', 'jeu_libre', 'narratif') THEN 'type_invalid' ELSE 'status_invalid' END AS reason
    FROM forms WHERE pool IS NULL OR pool NOT IN ('equipe', 'jeu_libre', 'narratif') OR payment_status IS NULL
        OR payment_status NOT IN ('pending', 'paid', 'waived')""",
    "forms",
)
def admin_rejected(t):
    return admission.admin_rejected(t.forms).select("id", "reason")


@query(
    "fifo_heads",
    """SELECT pool, id FROM (SELECT pool, id, row_number() OVER (PARTITION BY pool ORDER BY created_at, id) AS rn FROM requests
        WHERE is_waitlist AND payment_status <> 'cancelled') WHERE rn = 1""",
    "requests",
)
def fifo_heads(t):
    """First in line per pool, as one aggregate."""
    first = F.min_by("id", F.struct("created_at", "id")).alias("id")
    return stock.waiting(t.requests).groupBy("pool").agg(first)
