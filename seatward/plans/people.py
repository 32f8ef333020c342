"""Payers, champions and invitations."""

from __future__ import annotations

from pyspark.sql import functions as F

from seatward.operators import invites, payments, writes
from seatward.plans.registry import AS_OF, query
from seatward.sources.schemas import SCHEMAS
from seatward.sources.streams import drain, run_folder
from seatward.sources.tables import export_csv, read_payers_csv, split_bad_records
from seatward.streaming.imports import import_payers, imported_payers, stream_payers_csv


@query(
    "paid_champions",
    "SELECT email, pseudo FROM champions c WHERE email IN (SELECT email FROM payers)",
    "champions",
    "payers",
)
def paid_champions(t):
    return payments.paid_only(t.champions, t.payers).select("email", "pseudo")


@query(
    "invite_eligible",
    """SELECT id, inviter_email FROM (SELECT id, 'USER' || substr(email, 5) AS inviter_email FROM requests)
        WHERE lower(inviter_email) IN (SELECT email FROM payers)""",
    "requests",
    "payers",
)
def invite_eligible(t):
    return invites.eligible_inviters(_invite_requests(t), t.payers).select("id", "inviter_email")


def _invite_requests(t):
    return t.requests.select("id", F.concat(F.lit("USER"), F.substr("email", F.lit(5))).alias("inviter_email"))


@query(
    "invite_issue",
    """SELECT sha256(CAST(id AS VARCHAR)) AS token, email AS inviter_email, CAST(NULL AS VARCHAR) AS used_by_email
        FROM requests WHERE email IN (SELECT email FROM payers)""",
    "requests",
    "payers",
)
def invite_issue(t):
    token = F.sha2(F.col("id").cast("string"), 256)
    return invites.issue_invites(_invite_requests(t), t.payers, token).drop("used_at")


@query(
    "invites_by_captain",
    """SELECT inviter_email, CAST(count(*) AS INT) AS invites, CAST(count(used_at) AS INT) AS used FROM invites
        GROUP BY inviter_email""",
    "invites",
)
def invites_by_captain(t):
    return invites.invites_by_captain(t.invites).orderBy(F.col("invites").desc(), "inviter_email")


_REDEEM = """
    WITH RECURSIVE known AS (
        SELECT a.seq, a.token, lower(a.email) AS email, a.pseudo, a.region, a.is_parisian_redistributed, a.heroes,
            a.faction, a.story, a.blason, i.inviter_email,
            CASE WHEN a.token IS NULL OR a.token = '' THEN 'token_blank' WHEN a.email IS NULL OR a.email = '' THEN 'email_blank'
                WHEN a.pseudo IS NULL OR a.pseudo = '' THEN 'pseudo_blank' WHEN a.region IS NULL OR a.region = '' THEN 'region_blank'
                WHEN i.token IS NULL THEN 'token_unknown' WHEN i.used_at IS NOT NULL THEN 'token_used' END AS fixed,
            m.email IS NOT NULL AS champion
        FROM attempts a LEFT JOIN invites i ON i.token = a.token LEFT JOIN mates m ON m.email = lower(a.email)),
    rounds AS (
        SELECT 0 AS step, seq, token, email, false AS won FROM known WHERE fixed IS NULL AND NOT champion
        UNION ALL
        SELECT step, seq, token, email, won FROM (
            SELECT step + 1 AS step, seq, token, email,
                row_number() OVER (PARTITION BY token ORDER BY seq) = 1 AND row_number() OVER (PARTITION BY email ORDER BY seq) = 1 AS won
            FROM (SELECT *, bool_or(won) OVER (PARTITION BY token) AS t, bool_or(won) OVER (PARTITION BY email) AS e FROM rounds)
            WHERE NOT t AND NOT e)),
    winners AS (SELECT DISTINCT seq, token, email FROM rounds WHERE won)
    """


@query(
    "forge_tokens",
    _REDEEM
    + """SELECT k.seq, k.token, k.email, CASE WHEN fixed IS NOT NULL THEN fixed WHEN w.seq IS NOT NULL THEN NULL
            WHEN b.seq < k.seq THEN 'token_used' ELSE 'email_taken' END AS reason
        FROM known k LEFT JOIN winners w ON w.seq = k.seq LEFT JOIN winners b ON b.token = k.token""",
    "attempts",
    "invites",
    "mates",
)
def forge_tokens(t):
    result, _ = invites.redeem_tokens(t.attempts, t.invites, t.mates)
    return result.select("seq", "token", "email", "reason")


@query(
    "forge_champions",
    _REDEEM
    + """SELECT k.seq, k.token, k.email, k.pseudo, k.region, coalesce(k.is_parisian_redistributed, false) AS is_parisian_redistributed,
            CAST(coalesce(len(k.heroes), 0) AS INT) AS heroes, k.faction, k.story, k.blason, k.inviter_email AS invited_by_email FROM known k JOIN winners w ON w.seq = k.seq""",
    "attempts",
    "invites",
    "mates",
)
def forge_champions(t):
    _, created = invites.redeem_tokens(t.attempts, t.invites, t.mates)
    return created.withColumn("heroes", F.size("heroes"))


@query(
    "invites_after",
    _REDEEM
    + f"""SELECT i.token, i.inviter_email, coalesce(w.email, i.used_by_email) AS used_by_email,
            CASE WHEN w.seq IS NOT NULL THEN {AS_OF} ELSE i.used_at END AS used_at FROM invites i LEFT JOIN winners w ON w.token = i.token""",
    "attempts",
    "invites",
    "mates",
    "requests",
)
def invites_after(t):
    """Invitations once the attempts are through: who used them, and when."""
    _, created = invites.redeem_tokens(t.attempts, t.invites, t.mates)
    return invites.mark_used(t.invites, created, t.as_of)


@query(
    "cascade_delete_invites",
    """SELECT token, inviter_email FROM invites WHERE inviter_email NOT IN (SELECT email FROM payers WHERE pool = 'narratif')""",
    "invites",
    "payers",
)
def cascade_delete_invites(t):
    """Deleting payers takes their invitations along."""
    gone = t.payers.filter("pool = 'narratif'").select("email")
    return writes.delete_payers(gone, t.payers, t.invites)["invites"].select("token", "inviter_email")


@query(
    "reconcile",
    """WITH c AS (SELECT DISTINCT lower(trim(email)) AS email FROM champions),
        p AS (SELECT DISTINCT lower(trim(email)) AS email FROM payers)
    SELECT coalesce(c.email, p.email) AS email, CASE WHEN p.email IS NULL THEN 'champion_without_payer'
        WHEN c.email IS NULL THEN 'payer_without_champion' ELSE 'matched' END AS status
    FROM c FULL JOIN p ON c.email = p.email""",
    "champions",
    "payers",
)
def reconcile(t):
    return payments.reconcile(t.champions, t.payers)


@query(
    "captain_progress",
    """WITH made AS (SELECT lower(trim(coalesce(invited_by_email, email))) AS email, count(*) AS n FROM champions GROUP BY 1)
    SELECT lower(trim(p.email)) AS email, coalesce(expected_champions, 1) AS expected, CAST(coalesce(n, 0) AS INT) AS forged,
        CAST(coalesce(expected_champions, 1) - coalesce(n, 0) AS INT) AS missing
    FROM payers p LEFT JOIN made ON made.email = lower(trim(p.email))""",
    "champions",
    "payers",
)
def captain_progress(t):
    return payments.captain_progress(t.champions, t.payers)


@query(
    "allowed_commands",
    "SELECT seq, actor FROM commands WHERE actor LIKE 'admin%' AND actor <> 'admin2'",
    "commands",
)
def allowed_commands(t):
    """The access list is itself derived: every actor of the log whose name says admin, but one."""
    admins = t.commands.filter(F.col("actor").startswith("admin") & (F.col("actor") != "admin2"))
    return writes.allowed(t.commands, admins.select(F.col("actor").alias("email")).distinct()).select("seq", "actor")


@query(
    "payers_upsert",
    """WITH keyed AS (SELECT *, coalesce('tx:' || transaction_id, 'em:' || lower(trim(email))) AS k, lower(trim(email)) AS mail FROM payers_batch),
    once AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY k ORDER BY id DESC) = 1),
    fresh AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY mail ORDER BY id DESC) = 1)
    SELECT id, email, pool, transaction_id, CAST(montant_eur AS DOUBLE) AS montant_eur FROM payers
        WHERE coalesce('tx:' || transaction_id, 'em:' || lower(trim(email))) NOT IN (SELECT k FROM fresh)
          AND lower(trim(email)) NOT IN (SELECT mail FROM fresh)
    UNION ALL SELECT id, email, pool, transaction_id, CAST(montant_eur AS DOUBLE) FROM fresh""",
    "payers",
    "payers_batch",
)
def payers_upsert(t):
    return writes.upsert_payers(t.payers.select("id", "email", "pool", "transaction_id", "montant_eur"), t.payers_batch)


@query(
    "payers_import_stream",
    """WITH keyed AS (SELECT *, coalesce('tx:' || transaction_id, 'em:' || lower(trim(email))) AS k, lower(trim(email)) AS mail FROM payers_batch),
    once AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY k ORDER BY id DESC) = 1),
    fresh AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY mail ORDER BY id DESC) = 1)
    SELECT id, email, pool, transaction_id, CAST(montant_eur AS DOUBLE) AS montant_eur FROM payers
        WHERE coalesce('tx:' || transaction_id, 'em:' || lower(trim(email))) NOT IN (SELECT k FROM fresh)
          AND lower(trim(email)) NOT IN (SELECT mail FROM fresh)
    UNION ALL SELECT id, email, pool, transaction_id, CAST(montant_eur AS DOUBLE) FROM fresh""",
    "payers",
    "payers_batch",
)
def payers_import_stream(t):
    """The payer list and then a batch, as CSV files that arrive one after the other; the files of an arrival are one micro-batch."""
    spark = t.payers.sparkSession
    schema = SCHEMAS["paid_users"].replace("id STRING", "id BIGINT", 1)
    names = spark.createDataFrame([], schema).columns
    base = run_folder(spark, "import")
    for rows in (t.payers, t.payers_batch):
        has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c)  # noqa: B023, E731
        export_csv(rows.select(*map(has, names)), f"{base}/in", "append")
        drain(spark, import_payers(stream_payers_csv(spark, f"{base}/in", schema), f"{base}/list"), f"{base}/progress")
    return imported_payers(spark, f"{base}/list", schema).select("id", "email", "pool", "transaction_id", "montant_eur")


@query(
    "payers_csv",
    """SELECT email, pool, transaction_id, expected_champions, CAST(montant_eur AS DOUBLE) AS montant_eur, imported_at, nom,
        prenom, team_label FROM payers""",
    "payers",
)
def payers_csv(t):
    """The payer list written as a CSV export and read back with the declared schema."""
    path = run_folder(t.payers.sparkSession, "payers")
    p = t.payers
    blank = [F.lit(None).cast("string").alias(c) for c in ("adresse", "code_postal", "ville")]
    export_csv(
        p.select(
            "id", "email", "prenom", "nom", *blank, "imported_at", "transaction_id", "pool",
            F.col("email").alias("acheteur_email"), "expected_champions", "team_label", "montant_eur",
        ),
        path,
    )
    good = split_bad_records(read_payers_csv(p.sparkSession, path))
    return good.select(
        "email", "pool", "transaction_id", "expected_champions", "montant_eur", "imported_at", "nom", "prenom", "team_label"
    )


@query("export_csv", "SELECT email, pseudo, region, invited_by_email FROM champions", "champions")
def export_champions(t):
    path = run_folder(t.champions.sparkSession, "champions")
    export_csv(t.champions.select("email", "pseudo", "region", "invited_by_email"), path)
    return t.champions.sparkSession.read.option("header", True).csv(path)
