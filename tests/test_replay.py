"""Log replays against straightforward sequential programs."""

import random
from datetime import datetime, timedelta

import pytest

from seatward.operators import dedupe, invites, replay, territory
from seatward.functions import dims

START = datetime(2026, 5, 1)
HOLD = timedelta(minutes=30)


def clicks(seed, n=300):
    rnd = random.Random(seed)
    return [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(4)}", START + timedelta(minutes=rnd.randrange(0, 900)), i) for i in range(n)]


def sequential_dedupe(rows):
    kept, anchor = set(), {}
    for k, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        if k not in anchor or t >= anchor[k] + HOLD:
            anchor[k] = t
            kept.add((k, t, i))
    return kept


@pytest.mark.parametrize("fold_rows,limit", [(10_000, None), (5, 40)])
def test_dedupe(spark, fold_rows, limit):
    rows = clicks(1)
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, id long")
    got = dedupe.dedupe_holds(df, ["k"], "t", "id", HOLD, fold_rows, limit)
    assert {tuple(r) for r in got.collect()} == sequential_dedupe(rows)


def test_dedupe_differs_from_gap_rule(spark):
    """Clicks 20 minutes apart: each is within the hold of its predecessor, yet every second one is kept."""
    rows = [("a", START + timedelta(minutes=20 * i), i) for i in range(6)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, id long")
    assert sorted(r["id"] for r in dedupe.dedupe_holds(df, ["k"], "t", "id", HOLD).collect()) == [0, 2, 4]


POOLS = ("equipe", "jeu_libre")
CAPS = {"equipe": 3, "jeu_libre": 6}
PAID = [("e1@x.org", "equipe"), ("j1@x.org", "jeu_libre"), ("e2@x.org", "jeu_libre")]


def request_log(seed, n=220):
    rnd = random.Random(seed)
    kinds = ["create"] * 7 + ["pay", "cancel", "cancel", "unmark", "waive"]
    log = []
    for i in range(n):
        pool = POOLS[rnd.random() < 0.3]
        log.append((1000 + i * 3, START + timedelta(minutes=rnd.randrange(0, 240)), rnd.choice(kinds), f"e{rnd.randrange(14)}@x.org", pool))
    return log


def sequential_admission(log):
    """One entry after another over a plain list of rows, each question answered by a scan."""
    payers = {e for e, _ in PAID}
    paid = {p: sum(q == p for _, q in PAID) for p in POOLS}
    rows, decisions = [], {}
    for seq, t, kind, email, pool in sorted(log, key=lambda r: (r[1], r[0])):
        mine = [r for r in rows if r["pool"] == pool]
        if kind == "create":
            active = [r for r in mine if r["status"] == "pending" and not r["wait"] and r["at"] > t - HOLD]
            same = [r for r in active if r["email"] == email]
            if same:
                decisions[seq] = ("reused", same[-1]["id"], None)
                continue
            taken = paid[pool] + sum(r["email"] not in payers for r in active)
            row = dict(id=seq, pool=pool, email=email, at=t, status="pending", wait=CAPS[pool] - taken <= 0, promoted=None, paid=None, gone=None)
            rows.append(row)
            place = sum(r["wait"] and r["status"] != "cancelled" for r in [*mine, row])
            decisions[seq] = ("waitlisted", seq, place) if row["wait"] else ("held", seq, None)
            continue
        live = [r for r in mine if r["email"] == email and r["status"] != "cancelled"]
        if not live:
            decisions[seq] = ("unmatched", None, None)
            continue
        row = live[-1]
        decisions[seq] = (kind, row["id"], None)
        row["status"] = {"pay": "paid", "waive": "waived", "unmark": "pending", "cancel": "cancelled"}[kind]
        if kind == "cancel":
            row["gone"] = t
            if not row["wait"]:
                queue = [r for r in mine if r["wait"] and r["status"] != "cancelled"]
                if queue:
                    queue[0]["wait"], queue[0]["promoted"] = False, t
        else:
            row["gone"], row["paid"] = None, t if kind in ("pay", "waive") else None
    return decisions, {r["id"]: (r["status"], r["wait"], r["promoted"], r["paid"], r["gone"]) for r in rows}


def admission_frames(spark, log):
    df = spark.createDataFrame(log, "seq long, ts timestamp_ntz, kind string, email string, pool string")
    cap = spark.createDataFrame(list(CAPS.items()), "pool string, capacity int")
    payers = spark.createDataFrame([(e.upper(), p) for e, p in PAID], "email string, pool string")
    return df, cap, payers


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("slice_rows", [1_000_000, 40])
def test_admission_replay(spark, seed, slice_rows):
    log = request_log(seed)
    decisions, rows = replay.replay_requests(*admission_frames(spark, log), HOLD, slice_rows, max_group_rows=60)
    want, want_rows = sequential_admission(log)
    got = {r["seq"]: (r["action"], r["row_id"], r["waitlist_position"]) for r in decisions.collect()}
    assert got == want
    got_rows = {
        r["id"]: (r["payment_status"], r["is_waitlist"], r["promoted_at"], r["paid_at"], r["cancelled_at"])
        for r in rows.collect()
    }
    assert got_rows == want_rows


@pytest.mark.parametrize("slice_rows", [1_000_000, 1])
def test_admission_edges(spark, slice_rows):
    """Commands without a row, a pool without capacity, and missing keys."""
    log = [
        (1, START, "pay", "e1@x", "equipe"),
        (2, START, "create", "e2@x", "jeu_libre"),
        (3, START, "cancel", "e9@x", "zzz"),
        (4, START, "create", None, "equipe"),
        (5, START, "create", "e5@x", None),
    ]
    decisions, rows = replay.replay_requests(*admission_frames(spark, log), HOLD, slice_rows)
    got = {r["seq"]: r["action"] for r in decisions.collect()}
    assert got == {1: "unmatched", 2: "held", 3: "unmatched", 4: "held", 5: "waitlisted"}
    assert rows.count() == 3


def test_admission_never_exceeds_capacity(spark):
    """With creations only, the holds active after any admission fit the capacity."""
    log = [r for r in request_log(5, 300) if r[2] == "create"]
    decisions, rows = replay.replay_requests(*admission_frames(spark, log), HOLD)
    payers = {e for e, _ in PAID}
    held = [(r["pool"], r["created_at"], r["email"]) for r in rows.filter("not is_waitlist").collect()]
    for pool, t, _ in held:
        active = [1 for p, s, e in held if p == pool and t - HOLD < s <= t and e not in payers]
        assert sum(q == pool for _, q in PAID) + len(active) <= CAPS[pool]


REGIONS = {"A": "Alsace", "B": "Bourgogne", "C": "Centre", "D": "Lorraine"}


def battles(seed, n=400):
    rnd = random.Random(seed)
    people = [f"p{i}" for i in range(8)]
    out = []
    for i in range(n):
        w, l = rnd.choice(people), rnd.choice([*people, "ghost", "paris"])
        cell = "p0#0" if rnd.random() < 0.5 else rnd.choice([f"{rnd.choice(people)}#{rnd.randrange(5)}", None, "nope"])
        out.append((i, START + timedelta(minutes=rnd.randrange(0, 200)), w, l, rnd.choice([1, 2, 3, 4, 5, 6, None]), cell))
    return out


def field(spark):
    people = [(f"p{i}", f"P{i}", REGIONS["ABCD"[i % 4]]) for i in range(8)] + [("paris", "P", "Île-de-France")]
    champions = spark.createDataFrame(people, "email string, pseudo string, region string")
    dim = dims.region_alliances(spark)
    return champions, territory.create_cells(champions, dim), dim


def sequential_battles(log):
    side = {f"p{i}": "ABCD"[i % 4] for i in range(8)} | {"paris": "IDF"}
    cells = {f"p{i}#{k}": ("ABCD"[i % 4], f"p{i}") for i in range(8) for k in range(5)}
    out = {}
    for i, t, w, l, rnd, cell in sorted(log, key=lambda r: (r[1], r[0])):
        if w == l or rnd is None or not 1 <= rnd <= 5 or l not in side or side[l] == "IDF":
            out[i] = ("rejected", None, None)
        elif side[w] == side[l]:
            out[i] = ("same_alliance", None, None)
        elif cell not in cells or cells[cell][0] != side[l]:
            out[i] = ("rejected", None, None)
        else:
            out[i] = ("transfer", *cells[cell])
            cells[cell] = (side[w], w)
    return out, cells


@pytest.mark.parametrize("chunk,limit", [(256, None), (4, 50)])
def test_battle_replay(spark, chunk, limit):
    log = battles(4)
    champions, cells, dim = field(spark)
    df = spark.createDataFrame(log, "id long, ts timestamp_ntz, winner_email string, loser_email string, round int, cell_id string")
    decided, after = territory.replay_battles(df, champions, cells, dim, chunk, limit)
    want, want_cells = sequential_battles(log)
    got = {r["id"]: (r["outcome"], r["prev_alliance"], r["prev_owner_email"]) for r in decided.collect()}
    assert got == want
    assert {r["id"]: (r["current_alliance"], r["current_owner_email"]) for r in after.collect()} == want_cells


@pytest.mark.parametrize("k", [1, 7, 60])
def test_undo_equals_replay_of_the_shorter_log(spark, k):
    log = battles(6, 250)
    champions, cells, dim = field(spark)
    schema = "id long, ts timestamp_ntz, winner_email string, loser_email string, round int, cell_id string"
    decided, after = territory.replay_battles(spark.createDataFrame(log, schema), champions, cells, dim)
    accepted = decided.filter("outcome <> 'rejected'")
    ids = [r["id"] for r in accepted.orderBy("ts", "id").collect()]
    shorter, back = territory.undo_last(accepted, after, k)
    assert sorted(r["id"] for r in shorter.collect()) == sorted(ids[:-k])
    _, want = sequential_battles([r for r in log if r[0] in set(ids[:-k])])
    assert {r["id"]: (r["current_alliance"], r["current_owner_email"]) for r in back.collect()} == want


def test_undo_after_owner_was_deleted(spark):
    cells = spark.createDataFrame(
        [("a#0", "a", 0, "B", None, "A")],
        "id string, cluster_owner_email string, cluster_index int, current_alliance string, current_owner_email string, original_alliance string",
    )
    log = spark.createDataFrame(
        [(1, START, "b", "a#0", "A", None)],
        "id long, ts timestamp_ntz, winner_email string, cell_transferred_id string, prev_alliance string, prev_owner_email string",
    )
    row = territory.undo_last(log, cells)[1].first()
    assert (row["current_alliance"], row["current_owner_email"]) == ("A", "a")


def sequential_tokens(attempts, unused, used, champions):
    champions, open_, out = set(champions), set(unused), {}
    for seq, token, email, pseudo, region in sorted(attempts):
        email = None if email is None else email.lower()
        blank = [n for n, v in (("token", token), ("email", email), ("pseudo", pseudo), ("region", region)) if not v]
        if blank:
            out[seq] = blank[0] + "_blank"
        elif token not in unused and token not in used:
            out[seq] = "token_unknown"
        elif token not in open_:
            out[seq] = "token_used"
        elif email in champions:
            out[seq] = "email_taken"
        else:
            out[seq] = None
            open_.discard(token)
            champions.add(email)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_token_redemption(spark, seed):
    rnd = random.Random(seed)
    unused, used = [f"t{i}" for i in range(25)], ["u1", "u2"]
    attempts = [
        (i, "t0" if rnd.random() < 0.3 else rnd.choice([*unused, *used, "zz", "", None]), rnd.choice([f"E{rnd.randrange(20)}@x", "", None]) if rnd.random() < 0.2 else f"e{rnd.randrange(20)}@x",
         rnd.choice(["p", "p", "p", ""]), rnd.choice(["r", "r", "r", None]))
        for i in range(160)
    ]
    a = spark.createDataFrame(attempts, "seq long, token string, email string, pseudo string, region string")
    inv = spark.createDataFrame(
        [(t, "cap@x", None, None) for t in unused] + [(t, "cap@x", "o@x", START) for t in used],
        "token string, inviter_email string, used_by_email string, used_at timestamp_ntz",
    )
    champs = spark.createDataFrame([("e3@x",), ("e4@x",)], "email string")
    result, created = invites.redeem_tokens(a, inv, champs)
    want = sequential_tokens(attempts, unused, used, ["e3@x", "e4@x"])
    assert {r["seq"]: r["reason"] for r in result.collect()} == want
    first = created.first()
    assert first["heroes"] == [] and first["is_parisian_redistributed"] is False and first["invited_by_email"] == "cap@x"
    left = invites.mark_used(inv, created, invites.F.lit("2026-05-02 00:00:00").cast("timestamp_ntz"))
    assert left.filter("used_at is not null").count() == 2 + created.count()


def test_failed_redemption_keeps_the_token(spark):
    a = spark.createDataFrame([(1, "t", "old@x", "p", "r"), (2, "t", "new@x", "p", "r")], "seq long, token string, email string, pseudo string, region string")
    inv = spark.createDataFrame([("t", "c@x", None, None)], "token string, inviter_email string, used_by_email string, used_at timestamp_ntz")
    result, created = invites.redeem_tokens(a, inv, spark.createDataFrame([("old@x",)], "email string"))
    assert {r["seq"]: r["reason"] for r in result.collect()} == {1: "email_taken", 2: None}
    assert created.first()["email"] == "new@x"


def test_chained_attempts_take_many_rounds(spark):
    """Each attempt waits for the one before it: the slowest case, still the sequential result."""
    attempts = [(i, f"t{i // 2}", f"e{(i + 1) // 2}@x", "p", "r") for i in range(26)]
    a = spark.createDataFrame(attempts, "seq long, token string, email string, pseudo string, region string")
    tokens = [f"t{i}" for i in range(13)]
    inv = spark.createDataFrame([(t, "c@x", None, None) for t in tokens], "token string, inviter_email string, used_by_email string, used_at timestamp_ntz")
    result, _ = invites.redeem_tokens(a, inv, spark.createDataFrame([("none@x",)], "email string"))
    assert {r["seq"]: r["reason"] for r in result.collect()} == sequential_tokens(attempts, tokens, [], ["none@x"])


@pytest.mark.parametrize("fold_rows", [1, 3, 10_000])
def test_dedupe_null_keys_and_times(spark, fold_rows):
    """Null keys are keys; rows without a time are out, however busy their key is."""
    rows = [(k, p, None if i % 7 == 3 else START + timedelta(minutes=9 * i), i) for i in range(40) for k, p in (("a", "x"), (None, "x"), ("a", None), (None, None), ("", "x"))]
    df = spark.createDataFrame(rows, "k string, p string, t timestamp_ntz, id long")
    want = set()
    for key in {(k, p) for k, p, _, _ in rows}:
        anchor = None
        for t, i in sorted((t, i) for k, p, t, i in rows if (k, p) == key and t is not None):
            if anchor is None or t >= anchor + HOLD:
                anchor = t
                want.add((*key, t, i))
    got = dedupe.dedupe_holds(df, ["k", "p"], "t", "id", HOLD, fold_rows=fold_rows)
    assert {tuple(r) for r in got.select("k", "p", "t", "id").collect()} == want
