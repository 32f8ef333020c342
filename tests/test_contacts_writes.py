from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from seatward.functions import dims, rules, text
from seatward.operators import admission, payments, territory, writes
from seatward.sources import tables


def form(i, **changes):
    base = dict(nom="N", prenom="P", email="a@x.org", pool="equipe", role=None)
    row = {**base, **changes}
    return (i, row["nom"], row["prenom"], row["email"], row["pool"], row["role"])


def test_first_rule_wins(spark):
    cases = [
        (form(1), None),
        (form(2, nom="  ", email="a@b"), "nom_blank"),
        (form(3, prenom=None), "prenom_blank"),
        (form(4, email="a@b"), "email_invalid"),
        (form(5, email="a@b@c.d", pool="vip"), "email_invalid"),
        (form(6, pool="vip", role="x"), "type_invalid"),
        (form(7, role="arbitre"), "role_invalid"),
        (form(8, pool=None), "type_null"),
        (form(9, role="capitaine"), None),
    ]
    df = spark.createDataFrame([c for c, _ in cases], "id int, nom string, prenom string, email string, pool string, role string")
    checked = rules.validate_requests(df, rules.inscription_rules())
    assert {r["id"]: r["reason"] for r in checked.collect()} == {c[0]: want for c, want in cases}
    assert rules.accepted(checked).count() + rules.rejected(checked).count() == len(cases)


def test_texts(spark):
    df = spark.createDataFrame(
        [("  A@X.org ", " ", None, Decimal("65.5"), "a b&c"), ("b@x.org", "x", "old", Decimal(325), None)],
        "email string, telephone string, notes string, amount decimal(8,2), reason string",
    ).withColumn("ts", F.lit("2026-05-03 14:05:59").cast("timestamp_ntz"))
    got = df.select(
        text.norm_email(F.col("email")).alias("email"),
        text.blank_to_null(F.col("telephone")).alias("tel"),
        text.append_note(F.col("notes"), text.cancel_line(F.col("ts"), F.col("reason"))).alias("note"),
        text.money_text(F.col("amount")).alias("money"),
        text.co_occupants_note(F.col("reason")).alias("co"),
        text.payment_link("https://p.example", F.col("reason"), F.lit("L"), F.col("email"), F.col("telephone")).alias("url"),
    ).collect()
    assert got[0].asDict() == {
        "email": "a@x.org",
        "tel": None,
        "note": "↳ Annulée le 03/05/2026 14:05 — a b&c",
        "money": "65,50",
        "co": "Co-occupants prévus : a b&c",
        "url": "https://p.example?firstname=a+b%26c&lastname=L&email=++A%40X.org+",
    }
    assert got[1]["note"] == "old\n↳ Annulée le 03/05/2026 14:05" and got[1]["co"] is None
    assert got[1]["url"].endswith("&phone=x")


def test_prices(spark):
    df = spark.createDataFrame([("equipe",), ("narratif",), ("vip",), (None,)], "pool string")
    assert [r[0] for r in df.select(dims.pool_price(F.col("pool"))).collect()] == [Decimal(325), Decimal(65), Decimal(65), Decimal(65)]
    rooms = spark.createDataFrame([("simple",), ("suite",), (None,)], "room_type string")
    assert [r[0] for r in rooms.select(dims.room_price(F.col("room_type"))).collect()] == [Decimal(60), None, None]


def test_every_region_has_its_alliance(spark):
    counts = dims.region_alliances(spark).groupBy("alliance").count().collect()
    assert {r["alliance"]: r["count"] for r in counts} == {"A": 5, "B": 5, "C": 5, "D": 6, "IDF": 1}


def test_table_report(spark):
    df = spark.createDataFrame([("a", 1), ("a", 9), (None, 2), (None, None)], "email string, round int")
    report = rules.check_table(
        df,
        [*rules.check_not_null("email"), rules.check_between("round", 1, 5), rules.check_in("email", ["a"])],
        {"email_unique": ["email"]},
    )
    assert {r["rule"]: r["bad_rows"] for r in report.collect()} == {
        "email_not_null": 2,
        "round_between": 1,
        "email_in": 0,
        "email_unique": 1,
    }


@pytest.fixture
def commands(spark, at):
    def make(rows):
        data = [(i, at(m), s, a, r, None) for s, (i, m, a, r) in enumerate(rows)]
        return spark.createDataFrame(data, "id long, ts timestamp_ntz, seq long, action string, reason string, value string")

    return make


def test_status_commands(requests_df, commands, at):
    rows = requests_df([dict(id=i, email="a@x", pool="equipe", created_at=at(0), admin_notes="n" if i == 1 else None) for i in range(1, 6)])
    log = commands([
        (1, 5, "paid", None), (1, 6, "cancel", "r"), (1, 7, "cancel", None),
        (2, 5, "cancel", None), (2, 6, "unmark", None),
        (3, 5, "waived", None), (3, 6, "unmark", None),
        (4, 9, "cancel", None), (4, 8, "paid", None),
        (77, 1, "paid", None),
    ])
    after, unknown = payments.apply_status(rows, log)
    got = {r["id"]: (r["payment_status"], r["paid_at"], r["cancelled_at"], r["admin_notes"]) for r in after.collect()}
    line = "↳ Annulée le 01/05/2026 00:0"
    assert got == {
        1: ("cancelled", at(5), at(7), f"n\n{line}6 — r\n{line}7"),
        2: ("pending", None, None, f"{line}5"),
        3: ("pending", None, None, None),
        4: ("cancelled", at(8), at(9), f"{line}9"),
        5: ("pending", None, None, None),
    }
    assert [r["id"] for r in unknown.collect()] == [77]
    assert sorted(r["id"] for r in payments.newly_cancelled(rows, after).collect()) == [1, 4]


def test_edits(spark, at):
    rows = spark.createDataFrame([(1, "a", "u"), (2, "b", "u"), (3, "c", "u")], "id long, admin_notes string, custom_payment_url string")
    log = spark.createDataFrame(
        [(1, at(1), 1, "notes", "x"), (1, at(2), 2, "notes", None), (2, at(1), 3, "payment_url", "  "), (3, at(1), 4, "payment_url", " z ")],
        "id long, ts timestamp_ntz, seq long, action string, value string",
    )
    got = {r["id"]: tuple(r)[1:] for r in payments.apply_edits(rows, log)[0].collect()}
    assert got == {1: (None, "u"), 2: ("b", None), 3: ("c", "z")}


def test_admin_creation(spark, at):
    rows = [(i, at(i), "N", None, " A@X ", " ", "equipe", s) for i, s in enumerate(["paid", "waived", "pending", "cancelled"])]
    df = spark.createDataFrame(rows, "id long, created_at timestamp_ntz, nom string, prenom string, email string, telephone string, pool string, payment_status string")
    stock = spark.createDataFrame([("equipe", 1)], "pool string, remaining int")
    got = {r["id"]: r for r in admission.admin_create(df, at(9), stock).collect()}
    assert set(got) == {0, 1, 2}
    assert [got[i]["paid_at"] for i in range(3)] == [at(9), None, None]
    assert [got[i]["overbooked"] for i in range(3)] == [False, True, True]
    assert (got[0]["email"], got[0]["telephone"], got[0]["prenom"], got[0]["amount_eur"]) == ("a@x", None, "", Decimal(325))


def test_admission_of_a_batch(spark, at):
    reqs = spark.createDataFrame([(i, at(0), "equipe" if i < 9 else "gone") for i in range(10)], "id long, created_at timestamp_ntz, pool string")
    stock = spark.createDataFrame([("equipe", -2, 4), ("x", 1, 0)], "pool string, remaining int, waitlist_count int")
    got = {r["id"]: r["waitlist_position"] for r in admission.admit_batch(stock, reqs).collect()}
    assert got == {**{i: 5 + i for i in range(9)}, 9: 1}
    stock = spark.createDataFrame([("equipe", 3, 0)], "pool string, remaining int, waitlist_count int")
    for limit in (None, 4):
        got = {r["id"]: r["decision"] for r in admission.admit_batch(stock, reqs, "reject", max_group_rows=limit).collect()}
        assert [i for i, d in got.items() if d == "held"] == [0, 1, 2]


def test_insert_ignore_twice(spark):
    target = spark.createDataFrame([("a", 1)], "k string, v int")
    rows = spark.createDataFrame([("a", 9), ("b", 3), ("b", 2)], "k string, v int")
    once = writes.insert_ignore(target, rows, ["k"], F.col("v"))
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 2)]
    assert once.exceptAll(writes.insert_ignore(once, rows, ["k"], F.col("v"))).count() == 0


def test_updates_and_deletes_with_null_predicates(spark):
    df = spark.createDataFrame([(1, 2), (2, None)], "id int, v int")
    assert [tuple(r) for r in writes.update_where(df, F.col("v") > 1, {"v": F.lit(0)}).orderBy("id").collect()] == [(1, 0), (2, None)]
    assert [r["id"] for r in writes.delete_where(df, F.col("v") > 1).collect()] == [2]


def test_backfill_twice(spark, requests_df, at):
    payers = spark.createDataFrame(
        [(" ", None, "A@x.org", "equipe", None, "t1", None, at(0)), ("N", "P", "b@x.org", "autre", "L", None, Decimal(7), at(0))],
        "nom string, prenom string, email string, pool string, team_label string, transaction_id string, montant_eur decimal(12,2), imported_at timestamp_ntz",
    )
    cap = dims.inscription_pools(spark)
    none = requests_df([])
    row = payments.backfill(payers, none, cap).collect()
    assert len(row) == 1 and row[0]["nom"] == "—" and row[0]["role"] == "capitaine" and row[0]["amount_eur"] == Decimal(65)
    assert row[0]["admin_notes"].endswith("tx=t1")
    target = none.withColumn("amount_eur", F.col("amount_eur").cast("decimal(12,2)"))
    once = writes.append_rows(target, payments.backfill(payers, none, cap), {"is_waitlist": False})
    assert once.first()["is_waitlist"] is False and payments.backfill_counts(once).first()["backfilled"] == 1
    assert payments.backfill(payers, once, cap).count() == 0


def test_reprice_twice(requests_df, at):
    rows = requests_df([dict(id=1, pool="equipe", created_at=at(0), amount_eur=Decimal(65)), dict(id=2, pool="narratif", created_at=at(0))])
    once = payments.reprice(rows, dims.pool_price(F.col("pool")))
    assert [r["amount_eur"] for r in once.orderBy("id").collect()] == [Decimal(325), Decimal(65)]
    assert once.exceptAll(payments.reprice(once, dims.pool_price(F.col("pool")))).count() == 0


def test_upsert_is_idempotent(spark):
    schema = "id long, email string, transaction_id string"
    current = spark.createDataFrame([(1, "a@x", "t1"), (2, "b@x", None), (3, "c@x", "t3")], schema)
    batch = spark.createDataFrame([(11, "A@x ", None), (12, "z@x", "t3"), (13, "z2@x", "t3"), (14, "b@x", "t9")], schema)
    once = writes.upsert_payers(current, batch)
    assert sorted(map(tuple, once.collect())) == [(11, "A@x ", None), (13, "z2@x", "t3"), (14, "b@x", "t9")]
    assert once.exceptAll(writes.upsert_payers(once, batch)).count() == 0


def test_cells_are_five_per_placed_champion(spark):
    champions = spark.createDataFrame([("a", "Corse"), ("b", "Île-de-France"), ("c", None), ("d", "Mars")], "email string, region string")
    dim = dims.region_alliances(spark)
    cells = territory.create_cells(champions, dim)
    assert sorted(r["id"] for r in cells.collect()) == [f"a#{i}" for i in range(5)]
    moved = cells.withColumn("current_alliance", F.lit("D"))
    again = territory.create_cells(champions, dim, moved)
    assert again.count() == 5 and again.filter("current_alliance = 'D'").count() == 5
    reset = territory.reset_map(moved)[0]
    assert reset.exceptAll(cells).count() == 0
    assert territory.reset_map(reset)[0].exceptAll(reset).count() == 0


def test_deleting_a_champion(spark, at):
    champions = spark.createDataFrame([("a",), ("b",)], "email string")
    cells = spark.createDataFrame(
        [("a#0", "a", "B", "b"), ("b#0", "b", "A", "a"), ("b#1", "b", "B", "b")],
        "id string, cluster_owner_email string, current_alliance string, current_owner_email string",
    )
    battles = spark.createDataFrame([(1, "a", "b", "b#0"), (2, "b", "c", "a#0"), (3, "b", "c", "b#1")], "id long, winner_email string, loser_email string, cell_transferred_id string")
    out = writes.apply_deletes(spark.createDataFrame([("a",)], "email string"), champions, cells, battles)
    assert sorted(map(tuple, out["cells"].collect())) == [("b#0", "b", "A", None), ("b#1", "b", "B", "b")]
    assert sorted(map(tuple, out["battles"].select("id", "cell_transferred_id").collect())) == [(2, None), (3, "b#1")]
    assert set(out) == {"champions", "cells", "battles"}


def test_deleting_a_payer_takes_its_invitations(spark):
    payers = spark.createDataFrame([("a",), ("b",), (None,)], "email string")
    invites = spark.createDataFrame([("t", "a"), ("u", "b"), ("v", None)], "token string, inviter_email string")
    out = writes.delete_payers(spark.createDataFrame([("a",), ("x",)], "email string"), payers, invites)
    assert sorted(r["token"] for r in out["invites"].collect()) == ["u", "v"]
    assert sorted(str(r["email"]) for r in out["payers"].collect()) == ["None", "b"]


def test_stamp_only_on_change(spark, at):
    old = spark.createDataFrame([(1, "a", at(0)), (2, None, at(0))], "id long, v string, updated_at timestamp_ntz")
    new = spark.createDataFrame([(1, "b", at(0)), (2, None, at(0)), (3, "n", None)], "id long, v string, updated_at timestamp_ntz")
    got = {r["id"]: r["updated_at"] for r in writes.stamp_updated(old, new, at(5)).collect()}
    assert got == {1: at(5), 2: at(0), 3: at(5)}


def test_payers_csv(spark, tmp_path):
    head = "id,email,prenom,nom,adresse,code_postal,ville,imported_at,transaction_id,pool,acheteur_email,expected_champions,team_label,montant_eur\n"
    (tmp_path / "in.csv").write_text(head + "1,a@x,P,N,,,,2026-05-01 10:00:00,t1,equipe,,5,L,325.00\n2,b@x,P,N,,,,nonsense,t2,equipe,,many,L,1\n", encoding="utf-8")
    read = tables.read_payers_csv(spark, str(tmp_path / "in.csv"))
    good = tables.split_bad_records(read, str(tmp_path / "bad")).collect()
    assert len(good) == 1 and good[0]["expected_champions"] == 5 and good[0]["montant_eur"] == Decimal(325)
    assert spark.read.json(str(tmp_path / "bad")).first()["_bad_record"].startswith("2,b@x")


def test_csv_export_keeps_rows(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"]), ("b,c", None)], "email string, heroes array<string>")
    tables.export_csv(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert sorted(tuple(r) for r in back.collect()) == [("a", "x;y"), ("b,c", None)]


def test_crest(spark):
    df = spark.createDataFrame([('{"color": "red", "n": 3}',), ("{broken",), (None,)], "blason string")
    got = tables.parse_crest(df, fields=("color", "n")).select("blason_color", "blason_n").collect()
    assert [tuple(r) for r in got] == [("red", "3"), (None, None), (None, None)]


def test_redistribution_targets(spark):
    placed = spark.createDataFrame([(f"a{i}", "A") for i in range(5)] + [("b", "B"), ("c", "C"), ("c2", "C")], "email string, alliance string")
    neutral = spark.createDataFrame([(f"n{i}",) for i in range(60)], "email string")
    got = {r["assigned_alliance"] for r in territory.redistribute(neutral, placed).collect()}
    assert got == {"D", "B", "C"}


def test_access_list(spark):
    log = spark.createDataFrame([("a", 1), ("b", 2)], "actor string, seq int")
    assert [r["seq"] for r in writes.allowed(log, spark.createDataFrame([("a",)], "email string")).collect()] == [1]
