"""Stock with payers that come in time, and redemption of any shape in few rounds."""

import random
from datetime import timedelta

import pytest

from seatward.operators import invites, stock
from test_replay import HOLD, START

PAYER = "email string, pool string, imported_at timestamp_ntz"


def at(minute):
    return START + timedelta(minutes=minute)


@pytest.mark.parametrize("limit", [None, 25])
def test_history_against_stock_at_each_instant(spark, requests_df, limit):
    """At every instant the history is the stock of the payers and requests that are there by then."""
    rng = random.Random(8)
    rows = [
        dict(id=i, email=f"U{rng.randrange(25)}@x", pool=rng.choice(["a", "b", None]), created_at=at(rng.randrange(200)),
             payment_status=rng.choice(["pending", "pending", "paid"]), is_waitlist=rng.random() < 0.2)
        for i in range(120)
    ]
    paid = [(f"u{rng.randrange(25)}@X", rng.choice(["a", "b", None]), rng.choice([None, *(at(rng.randrange(200)) for _ in range(9))])) for _ in range(14)]
    reqs, payers = requests_df(rows), spark.createDataFrame(paid, PAYER)
    cap = spark.createDataFrame([("a", 30), ("b", 12)], "pool string, capacity int")
    times = [0, 29, 30, 31, 60, 100, 150, 199, 229, 230]
    instants = spark.createDataFrame([(p, at(t)) for t in times for p in ("a", "b", "zzz")], "pool string, instant timestamp_ntz")
    got = {(r["pool"], r["instant"]): (r["taken"], r["remaining"]) for r in stock.stock_history(cap, payers, reqs, instants, HOLD, max_group_rows=limit).collect()}
    assert len(got) == 2 * len(times)
    for t in times:
        there = payers.filter(payers["imported_at"].isNull() | (payers["imported_at"] <= at(t)))
        want = stock.stock(cap, there, reqs.filter(reqs["created_at"] <= at(t)), at(t), HOLD)
        assert {r["pool"]: (r["taken"], r["remaining"]) for r in want.collect()} == {p: v for (p, i), v in got.items() if i == at(t)}


def in_order(attempts):
    used, made, won = set(), set(), set()
    for seq, token, email in sorted(attempts):
        if token not in used and email not in made:
            used.add(token)
            made.add(email)
            won.add(seq)
    return won


def shapes(kind, n):
    rng = random.Random(kind)
    if kind == "chain":
        # Each attempt shares its token with the one before and its e-mail with the one after: only the one before blocks it.
        return [(i, f"t{(i + 1) // 2}", f"e{i // 2}") for i in range(n)]
    if kind == "hot token":
        return [(i, "t" if i % 2 else f"t{i}", f"e{rng.randrange(n)}") for i in range(n)]
    if kind == "islands":
        return [(i, f"t{i % 50}-{rng.randrange(4)}", f"e{i % 50}-{rng.randrange(4)}") for i in range(n)]
    return [(i, f"t{rng.randrange(n // 2)}", f"e{rng.randrange(n // 2)}") for i in range(n)]


@pytest.mark.parametrize(("kind", "fold"), [("chain", 108), ("chain", 500_000), ("hot token", 20), ("islands", 10), ("random", 25), ("random", 500_000)])
def test_winners_of_any_shape(spark, kind, fold):
    attempts = shapes(kind, 120)
    rng = random.Random(2)
    rng.shuffle(attempts)
    df = spark.createDataFrame(attempts, "seq long, token string, email string")
    won, _ = invites.winning_attempts(df, fold)
    assert sorted(r["seq"] for r in won.collect()) == sorted(in_order(attempts))


def test_long_chain_in_few_rounds(spark):
    attempts = shapes("chain", 1000)
    won, rounds = invites.winning_attempts(spark.createDataFrame(attempts, "seq long, token string, email string"))
    assert rounds <= 3 and {r["seq"] for r in won.collect()} == in_order(attempts)


def test_components_of_attempts(spark):
    attempts = [(5, "a", "x"), (3, "b", "x"), (9, "b", "y"), (1, "c", "z"), (4, "d", "w"), (8, "d", "z")]
    got = invites.attempt_components(spark.createDataFrame(attempts, "seq long, token string, email string"))
    assert {r["seq"]: r["component"] for r in got.collect()} == {5: 3, 3: 3, 9: 3, 1: 1, 4: 1, 8: 1}


def test_nothing_to_redeem(spark):
    won, rounds = invites.winning_attempts(spark.createDataFrame([], "seq long, token string, email string"))
    assert won.count() == 0 and rounds == 0
