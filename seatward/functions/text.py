"""Column helpers for contact fields, notes, money and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts written into stored notes, and the e-mail pattern.
EMAIL_PATTERN = r"^[^@]+@[^@]+\.[^@]+$"
PLACEHOLDER = "—"
CANCEL_NOTE = "↳ Annulée le "
EXPIRED_NOTE = "↳ Hold expiré (>30 min sans paiement)"
CO_OCCUPANTS_NOTE = "Co-occupants prévus : "
BACKFILL_NOTE = "Backfill phase 7c — depuis paid_users · "
SAME_ALLIANCE_NOTE = "Même alliance — pas de cession"


def norm_email(c: Column) -> Column:
    return F.lower(F.trim(c))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def or_placeholder(c: Column) -> Column:
    return F.coalesce(blank_to_null(c), F.lit(PLACEHOLDER))


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def day_minute(ts: Column) -> Column:
    return F.date_format(ts, "dd/MM/yyyy HH:mm")


def cancel_line(ts: Column, reason: Column) -> Column:
    """A null reason adds nothing: ``concat`` is null when one part is."""
    return F.concat(F.lit(CANCEL_NOTE), day_minute(ts), F.coalesce(F.concat(F.lit(" — "), reason), F.lit("")))


def append_note(notes: Column, line: Column) -> Column:
    return F.concat(F.coalesce(F.concat(notes, F.lit("\n")), F.lit("")), line)


def co_occupants_note(names: Column) -> Column:
    return F.when(~is_blank(names), F.concat(F.lit(CO_OCCUPANTS_NOTE), F.trim(names)))


def money_text(amount: Column) -> Column:
    """Two decimals and a comma, as shown on a summary."""
    return F.replace(amount.cast("decimal(10,2)").cast("string"), F.lit("."), F.lit(","))


def payment_link(base_url: str, first: Column, last: Column, email: Column, phone: Column) -> Column:
    """Form-encoded link; the phone is added only when there is one."""
    core = F.concat(
        F.lit(base_url + "?firstname="),
        F.url_encode(F.coalesce(first, F.lit(""))),
        F.lit("&lastname="),
        F.url_encode(F.coalesce(last, F.lit(""))),
        F.lit("&email="),
        F.url_encode(F.coalesce(email, F.lit(""))),
    )
    extra = F.when(~is_blank(phone), F.concat(F.lit("&phone="), F.url_encode(phone))).otherwise(F.lit(""))
    return F.concat(core, extra)


def normalise_contacts(df, blanks=("telephone", "team_name"), trims=("nom", "prenom")):
    """Ingest step: e-mail lower-cased and trimmed, names trimmed, blank optional fields set to null."""
    changes = {"email": norm_email(F.col("email"))}
    changes |= {c: F.trim(F.col(c)) for c in trims if c in df.columns}
    changes |= {c: blank_to_null(F.col(c)) for c in blanks if c in df.columns}
    return df.withColumns(changes)
