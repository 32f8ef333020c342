"""Contact fields, validation, prices and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from seatward.functions import rules, text
from seatward.functions.dims import POOL_LABELS, lookup
from seatward.plans.registry import query
from seatward.sources.tables import json_field, parse_crest


@query(
    "normalise_contacts",
    """SELECT id, lower(trim(email)) AS email, trim(nom) AS nom, trim(prenom) AS prenom,
        nullif(trim(telephone), '') AS telephone, nullif(trim(team_name), '') AS team_name FROM forms""",
    "forms",
)
def normalise_contacts(t):
    return text.normalise_contacts(t.forms).select("id", "email", "nom", "prenom", "telephone", "team_name")


_BAD_PERSON = """WHEN nom IS NULL OR trim(nom) = '' THEN 'nom_blank'
        WHEN prenom IS NULL OR trim(prenom) = '' THEN 'prenom_blank'
        WHEN email IS NULL OR trim(email) = '' OR NOT regexp_matches(email, '^[^@]+@[^@]+\\.[^@]+$') THEN 'email_invalid'"""


@query(
    "validate_requests",
    f"""SELECT id, CASE {_BAD_PERSON} WHEN pool IS NULL THEN 'type_null'
        WHEN pool NOT IN ('equipe', 'jeu_libre', 'narratif') THEN 'type_invalid'
        WHEN role NOT IN ('capitaine', 'coequipier') THEN 'role_invalid' END AS reason FROM forms""",
    "forms",
)
def validate_requests(t):
    return rules.validate_requests(t.forms, rules.inscription_rules()).select("id", "reason")


@query(
    "amount_text",
    """SELECT id, replace(CAST(amount_eur AS VARCHAR), '.', ',') AS amount_text,
        CASE pool WHEN 'equipe' THEN '⚔ Compétitif · Équipes' WHEN 'jeu_libre' THEN '🎲 Jeu Libre'
            WHEN 'narratif' THEN '📜 Narratif' ELSE pool END AS label FROM forms""",
    "forms",
)
def amount_text(t):
    label = F.coalesce(lookup(F.col("pool"), POOL_LABELS), F.col("pool")).alias("label")
    return t.forms.select("id", text.money_text(F.col("amount_eur")).alias("amount_text"), label)


@query(
    "payment_link",
    """WITH enc AS (SELECT id, replace(url_encode(trim(prenom)), '%20', '+') AS f, replace(url_encode(trim(nom)), '%20', '+') AS l,
        replace(url_encode(lower(trim(email))), '%20', '+') AS m, replace(url_encode(nullif(trim(telephone), '')), '%20', '+') AS p FROM forms)
    SELECT id, 'https://pay.example.com/collect?firstname=' || coalesce(f, '') || '&lastname=' || coalesce(l, '') || '&email='
        || coalesce(m, '') || CASE WHEN p IS NULL THEN '' ELSE '&phone=' || p END AS link FROM enc""",
    "forms",
)
def payment_link(t):
    c = text.normalise_contacts(t.forms)
    cols = [F.col(n) for n in ("prenom", "nom", "email", "telephone")]
    return c.select("id", text.payment_link("https://pay.example.com/collect", *cols).alias("link"))


@query(
    "json_prop",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
)
def json_prop(t):
    return t.events.select("event_id", json_field(F.col("props"), "$.k", "int").alias("k"))


@query(
    "crest_fields",
    "SELECT event_id, json_extract_string(props, '$.k') AS props_k, json_extract_string(props, '$.none') AS props_none FROM events",
)
def crest_fields(t):
    """A JSON column parsed once, with fields pulled out as text; the parsed column itself is no plain value and is left out."""
    return parse_crest(t.events, "props", ("k", "none")).select("event_id", "props_k", "props_none")


@query(
    "cancel_audit",
    """SELECT id, coalesce(admin_notes || chr(10), '') || '↳ Annulée le ' || strftime(created_at, '%d/%m/%Y %H:%M')
        || coalesce(' — ' || role, '') AS admin_notes FROM requests""",
    "requests",
)
def cancel_audit(t):
    line = text.cancel_line(F.col("created_at"), F.col("role"))
    return t.requests.select("id", text.append_note(F.col("admin_notes"), line).alias("admin_notes"))
