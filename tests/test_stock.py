from datetime import timedelta
from decimal import Decimal

import pytest

from seatward.functions import dims
from seatward.operators import queue, stock


def by_pool(df):
    return {r["pool"]: r.asDict() for r in df.collect()}


def golden(payers_df):
    rows = [dict(id=i, email=f"t{i}@x.org", pool="equipe", montant_eur=Decimal(325)) for i in range(5)]
    return payers_df([*rows, dict(id=9, email="s@x.org", pool="jeu_libre", montant_eur=Decimal(65))])


def test_golden_stock_and_revenue(spark, requests_df, payers_df, at):
    payers = golden(payers_df)
    got = by_pool(stock.stock(dims.inscription_pools(spark), payers, requests_df([]), at(0)))
    assert [(got[p]["taken"], got[p]["capacity"], got[p]["remaining"]) for p in ("equipe", "jeu_libre", "narratif")] == [
        (5, 12, 7),
        (1, 50, 49),
        (0, 16, 16),
    ]
    total = stock.with_grand_total(stock.revenue(payers)).first()["grand_total"]
    assert total == Decimal("1690.00")


def test_revenue_null_pool_is_its_own_group(payers_df):
    rows = [dict(id=1, email="a@x.org"), dict(id=2, email="b@x.org", pool="autre", montant_eur=Decimal(5))]
    got = {r["pool"]: (r["nb"], r["total_eur"]) for r in stock.revenue(payers_df(rows)).collect()}
    assert got == {"(autre)": (1, Decimal("0.00")), "autre": (1, Decimal("5.00"))}


def test_hold_limit_is_strict_on_both_sides(spark, requests_df, payers_df, at):
    now = at(60)
    ages = [29 + 59 / 60, 30, 30 + 1 / 60]
    reqs = requests_df([dict(id=i, email=f"u{i}@x.org", pool="equipe", created_at=at(60 - a)) for i, a in enumerate(ages)])
    got = by_pool(stock.stock(dims.inscription_pools(spark), payers_df([]), reqs, now))
    assert got["equipe"]["taken"] == 1
    after = {r["id"]: r["payment_status"] for r in queue.expire_holds(reqs, now).collect()}
    assert after == {0: "pending", 1: "pending", 2: "cancelled"}


def test_payer_of_another_pool_does_not_hold(spark, requests_df, payers_df, at):
    reqs = requests_df([dict(id=1, email="Ann@x.org", pool="equipe", created_at=at(50))])
    payers = payers_df([dict(id=1, email="aNN@X.org", pool="jeu_libre")])
    got = by_pool(stock.stock(dims.inscription_pools(spark), payers, reqs, at(60)))
    assert (got["equipe"]["taken"], got["jeu_libre"]["taken"]) == (0, 1)


def test_paid_request_frees_its_place_until_import(spark, requests_df, payers_df, at):
    reqs = requests_df([dict(id=1, email="a@x.org", pool="equipe", created_at=at(50), payment_status="paid")])
    got = by_pool(stock.stock(dims.inscription_pools(spark), payers_df([]), reqs, at(60)))
    assert got["equipe"]["taken"] == 0


def test_clamped_and_unclamped_policies(spark, requests_df, payers_df, at):
    payers = payers_df([dict(id=i, email=f"p{i}@x.org", pool="equipe") for i in range(14)])
    cap = dims.inscription_pools(spark)
    assert by_pool(stock.stock(cap, payers, requests_df([]), at(0)))["equipe"]["remaining"] == 0
    assert by_pool(stock.stock(cap, payers, None, policy="payers"))["equipe"]["remaining"] == -2
    with pytest.raises(ValueError):
        stock.stock(cap, payers, None, policy="guess")


def test_promoted_row_keeps_its_old_date(spark, requests_df, payers_df, at):
    rows = [
        dict(id=1, email="a@x.org", pool="equipe", created_at=at(119)),
        dict(id=2, email="b@x.org", pool="equipe", created_at=at(0), is_waitlist=True),
    ]
    cancelled = spark.createDataFrame([(1,)], "id long")
    after = queue.promote_batch(requests_df(rows), cancelled, at(120))
    head = after.filter("id = 2").first()
    assert (head["is_waitlist"], head["promoted_at"]) == (False, at(120))
    cap = dims.inscription_pools(spark)
    assert by_pool(stock.stock(cap, payers_df([]), after, at(121)))["equipe"]["taken"] == 0
    kept = stock.stock(cap, payers_df([]), after, at(121), hold_from="promoted_at")
    assert by_pool(kept)["equipe"]["taken"] == 1


def test_ties_share_the_position_but_not_the_queue_place(requests_df, at):
    rows = [dict(id=i, email=f"{i}@x.org", pool="equipe", created_at=at(1), is_waitlist=True) for i in (1, 2)]
    reqs = requests_df(rows)
    assert sorted(r["queue_position"] for r in queue.waitlist_queue(reqs).collect()) == [1, 2]
    assert [r["waitlist_position"] for r in queue.waitlist_position(reqs).collect()] == [2, 2]


def test_cancelled_waitlist_row_frees_nothing_and_is_not_promoted(spark, requests_df, at):
    rows = [
        dict(id=1, email="a@x.org", pool="equipe", created_at=at(1), is_waitlist=True),
        dict(id=2, email="b@x.org", pool="equipe", created_at=at(2)),
        dict(id=3, email="c@x.org", pool="equipe", created_at=at(3), is_waitlist=True),
        dict(id=4, email="d@x.org", pool="equipe", created_at=at(4), is_waitlist=True),
    ]
    ids = spark.createDataFrame([(1,), (2,), (2,)], "id long")
    after = {r["id"]: r["is_waitlist"] for r in queue.promote_batch(requests_df(rows), ids, at(9)).collect()}
    assert after == {1: True, 2: False, 3: False, 4: True}


def test_expiry_is_idempotent_and_promotes(requests_df, at):
    rows = [
        dict(id=1, email="a@x.org", pool="equipe", created_at=at(0), admin_notes="x"),
        dict(id=2, email="b@x.org", pool="equipe", created_at=at(55), is_waitlist=True),
    ]
    once = queue.expire_holds(requests_df(rows), at(60))
    assert once.filter("id = 1").first()["admin_notes"].startswith("x\n↳ Hold expiré")
    assert once.filter("id = 2").first()["is_waitlist"] is False
    twice = queue.expire_holds(once, at(60))
    assert once.exceptAll(twice).count() == 0


def test_manual_promotion_reports_unknown(spark, requests_df, at):
    rows = [
        dict(id=1, email="a@x.org", pool="equipe", created_at=at(0), is_waitlist=True),
        dict(id=2, email="b@x.org", pool="equipe", created_at=at(0), is_waitlist=True, payment_status="cancelled"),
        dict(id=3, email="c@x.org", pool="equipe", created_at=at(0)),
    ]
    after, unknown = queue.promote_entries(requests_df(rows), spark.createDataFrame([(1,), (2,), (3,), (7,)], "id long"), at(5))
    assert after.filter("promoted_at is not null").first()["id"] == 1
    assert sorted(r["id"] for r in unknown.collect()) == [2, 3, 7]


def test_timeline_equals_repeated_stock(spark, requests_df, payers_df, at):
    rows = [dict(id=i, email=f"u{i % 4}@x.org", pool="equipe", created_at=at(i * 7 % 60)) for i in range(20)]
    reqs, payers = requests_df(rows), payers_df([dict(id=1, email="U1@x.org", pool="narratif")])
    instants = [at(m) for m in (0, 29, 30, 31, 45, 60, 89, 90)]
    reads = spark.createDataFrame([("equipe", t) for t in instants], "pool string, instant timestamp_ntz")
    cap = dims.inscription_pools(spark)
    for limit in (None, 5):
        got = {
            r["instant"]: r["taken"]
            for r in stock.stock_timeline(cap, payers, reqs, reads, max_group_rows=limit).collect()
        }
        for t in instants:
            started = reqs.filter(reqs.created_at <= stock.as_instant(t))
            assert got[t] == by_pool(stock.stock(cap, payers, started, t))["equipe"]["taken"]


def test_hold_length_is_a_parameter(requests_df, at):
    reqs = requests_df([dict(id=1, email="a@x.org", pool="equipe", created_at=at(0))])
    assert stock.active_holds(reqs, at(60), timedelta(hours=2)).count() == 1
