"""Declared schemas of the registration tables, as DDL text."""

from __future__ import annotations

SCHEMAS = {
    "paid_users": """id STRING, email STRING, prenom STRING, nom STRING, adresse STRING, code_postal STRING,
        ville STRING, imported_at TIMESTAMP_NTZ, transaction_id STRING, pool STRING, acheteur_email STRING,
        expected_champions INT, team_label STRING, montant_eur DECIMAL(12,2)""",
    "champions": """id STRING, email STRING, pseudo STRING, region STRING, faction STRING, story STRING,
        is_parisian_redistributed BOOLEAN, blason STRING, heroes ARRAY<STRING>, created_at TIMESTAMP_NTZ,
        updated_at TIMESTAMP_NTZ, invited_by_email STRING""",
    "admin_users": "email STRING, added_at TIMESTAMP_NTZ, note STRING",
    "cells": """id STRING, cluster_owner_email STRING, cluster_index INT, current_alliance STRING,
        current_owner_email STRING, original_alliance STRING, created_at TIMESTAMP_NTZ, seed_x DOUBLE,
        seed_y DOUBLE""",
    "battles": """id STRING, winner_email STRING, loser_email STRING, round INT, cell_transferred_id STRING,
        notes STRING, ts TIMESTAMP_NTZ, prev_alliance STRING, prev_owner_email STRING""",
    "team_invites": """token STRING, inviter_email STRING, used_by_email STRING, used_at TIMESTAMP_NTZ,
        notes STRING, created_at TIMESTAMP_NTZ""",
    "room_reservations": """id STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ, nom STRING,
        prenom STRING, email STRING, telephone STRING, room_type STRING, nights INT, amount_eur DECIMAL(8,2),
        payment_status STRING, paid_at TIMESTAMP_NTZ, cancelled_at TIMESTAMP_NTZ, admin_notes STRING,
        custom_payment_url STRING""",
    "pending_inscriptions": """id STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ, nom STRING,
        prenom STRING, email STRING, telephone STRING, pool STRING, team_name STRING, role STRING,
        amount_eur DECIMAL(8,2), payment_status STRING, paid_at TIMESTAMP_NTZ, cancelled_at TIMESTAMP_NTZ,
        admin_notes STRING, is_waitlist BOOLEAN, promoted_at TIMESTAMP_NTZ""",
}
