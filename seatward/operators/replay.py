"""Admission replay: every request, payment and cancellation of a log in time order, pool by pool.

Each decision of a pool depends on all earlier ones (the applicants of a pool are served one at a time), so a pool
is a sequential chain while pools are independent. A pool's log is cut into slices of ``slice_rows`` rows. One
round replays one slice of every pool, and hands over a table of request rows. A task sees one slice and the few
rows that slice can touch: active holds, rows it commands by e-mail or by id, and as many queue heads as it has
cancellations and promotions. So no task holds a whole pool, and a lost executor repeats one round at most.
"""

from __future__ import annotations

import bisect
import heapq
import math
import uuid
from collections.abc import Iterable
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from seatward.functions.dims import HOLD, interval
from seatward.functions.text import norm_email
from seatward.operators.ordered import group_sizes, rank_rows
from seatward.session import shared_dir

SLICE_ROWS = 250_000

# Request row as the replay keeps it: number in the pool's log, seq of the request, ...
ROW_FIELDS = {
    "n": "long",
    "id": "long",
    "email": "string",
    "created_at": "timestamp_ntz",
    "payment_status": "string",
    "is_waitlist": "boolean",
    "promoted_at": "timestamp_ntz",
    "paid_at": "timestamp_ntz",
    "cancelled_at": "timestamp_ntz",
    "is_payer": "boolean",
}
DECISION_FIELDS = {"seq": "long", "action": "string", "row_id": "long", "waitlist_position": "int"}
ROW_SCHEMA = "pool string, " + ", ".join(f"{c} {t}" for c, t in ROW_FIELDS.items())
STEP_SCHEMA = ROW_SCHEMA + ", " + ", ".join(f"{c} {t}" for c, t in DECISION_FIELDS.items())

CREATIONS = ("create", "admin")
STATUS_AFTER = {"pay": "paid", "waive": "waived", "unmark": "pending", "cancel": "cancelled"}


class PoolDesk:
    """The rows of one pool in reach of a slice, and the decision for one log entry at a time."""

    def __init__(
        self, capacity: int, paid: int, waiting: int, hold_us: int, rows: Iterable[dict] = (), fair: bool = False, promoted_anew: bool = False
    ):
        self.places = capacity - paid
        self.waiting = waiting
        self.hold_us = hold_us
        self.fair, self.promoted_anew = fair, promoted_anew
        self.rows: dict[int, dict] = {}
        self.by_id: dict[int, int] = {}
        self.by_email: dict[str, list[int]] = {}
        self.queue: list[int] = []
        self.expiry: list[tuple[int, int]] = []
        self.active: dict[str, set[int]] = {}
        self.taken = 0
        self.changed: set[int] = set()
        for row in sorted(rows, key=lambda r: r["n"]):
            self._place(row)

    def _place(self, row: dict) -> None:
        self.rows[row["n"]] = row
        self.by_id[row["id"]] = row["n"]
        if row["payment_status"] != "cancelled":
            self._enter(row)

    def _enter(self, row: dict) -> None:
        """A row that is live from now on: the newest of its e-mail unless a later one is, and in the queue at the place of its date."""
        mine = self.by_email.setdefault(row["email"], [])
        if not mine or mine[-1] < row["n"]:
            mine.append(row["n"])
        elif row["n"] not in mine:
            bisect.insort(mine, row["n"])
        if row["is_waitlist"]:
            heapq.heappush(self.queue, row["n"])
        self._activate(row)

    def _start(self, row: dict) -> int:
        return row["promoted_at"] if self.promoted_anew and row["promoted_at"] is not None else row["created_at"]

    def _activate(self, row: dict) -> None:
        if row["payment_status"] == "pending" and not row["is_waitlist"]:
            mine = self.active.setdefault(row["email"], set())
            if row["n"] not in mine:
                mine.add(row["n"])
                heapq.heappush(self.expiry, (self._start(row), row["n"]))
                self.taken += not row["is_payer"]

    def _deactivate(self, row: dict) -> None:
        mine = self.active.get(row["email"], set())
        if row["n"] in mine:
            mine.remove(row["n"])
            self.taken -= not row["is_payer"]

    def _expire(self, now: int) -> None:
        while self.expiry and self.expiry[0][0] <= now - self.hold_us:
            start, n = heapq.heappop(self.expiry)
            # A row that left and came back has an entry for each time.
            if start == self._start(self.rows[n]):
                self._deactivate(self.rows[n])

    def create(self, n: int, seq: int, now: int, email: str, is_payer: bool, by_admin: bool = False):
        self._expire(now)
        held = self.active.get(email)
        if held and not by_admin:
            return "reused", self.rows[max(held)]["id"], None
        full = self.places - self.taken <= 0 or (self.fair and self.waiting > 0)
        wait = full and not by_admin
        row = dict(n=n, id=seq, email=email, created_at=now, payment_status="pending", is_waitlist=wait,
                   promoted_at=None, paid_at=None, cancelled_at=None, is_payer=is_payer)
        self._place(row)
        self.changed.add(n)
        if by_admin:
            return "created", seq, None
        if not wait:
            return "held", seq, None
        self.waiting += 1
        return "waitlisted", seq, self.waiting

    def _newest(self, email: str) -> dict | None:
        """The newest live row of an e-mail."""
        mine = self.by_email.get(email)
        while mine and self.rows[mine[-1]]["payment_status"] == "cancelled":
            mine.pop()
        return self.rows[mine[-1]] if mine else None

    def command(self, kind: str, now: int, email: str, target: int | None = None):
        """``target`` names a row by its id, cancelled ones too; without it the newest live row of the e-mail is meant."""
        self._expire(now)
        if target is None:
            row = self._newest(email)
        else:
            row = self.rows[self.by_id[target]] if target in self.by_id else None
        if kind == "promote" and row is not None and (row["payment_status"] == "cancelled" or not row["is_waitlist"]):
            row = None
        if row is None:
            return "unmatched", None, None
        self.changed.add(row["n"])
        if kind == "promote":
            self._let_in(row, now)
            return kind, row["id"], None
        was_live = row["payment_status"] != "cancelled"
        row["payment_status"] = STATUS_AFTER[kind]
        row["cancelled_at"] = now if kind == "cancel" else None
        if kind != "cancel":
            row["paid_at"] = now if kind in ("pay", "waive") else None
        self._deactivate(row)
        if kind == "cancel":
            if was_live and row["is_waitlist"]:
                self.waiting -= 1
            elif was_live:
                self._promote(now)
        elif not was_live:
            # A cancelled row that comes back is not held against the quota; one that had waited waits again.
            self.waiting += row["is_waitlist"]
            self._enter(row)
        elif kind == "unmark" and self._start(row) > now - self.hold_us:
            self._activate(row)
        return kind, row["id"], None

    def _let_in(self, row: dict, now: int) -> None:
        row["is_waitlist"] = False
        row["promoted_at"] = now
        self.waiting -= 1
        self.changed.add(row["n"])
        if self._start(row) > now - self.hold_us:
            self._activate(row)

    def _promote(self, now: int) -> None:
        while self.queue:
            row = self.rows[heapq.heappop(self.queue)]
            if row["is_waitlist"] and row["payment_status"] != "cancelled":
                self._let_in(row, now)
                return


TIMES = ("created_at", "promoted_at", "paid_at", "cancelled_at")


def _micros(s: pd.Series) -> list:
    whole = s.astype("datetime64[us]").astype("int64")
    return [None if missing else v for v, missing in zip(whole.tolist(), s.isna().tolist())]


def rows_in(pdf: pd.DataFrame) -> list[dict]:
    cols = {c: _micros(pdf[c]) if c in TIMES else pdf[c].tolist() for c in ROW_FIELDS}
    return [dict(zip(cols, values)) for values in zip(*cols.values())]


def replay_entries(desk: PoolDesk, log: pd.DataFrame) -> pd.DataFrame:
    """Decisions for the log rows, then the request rows made or changed."""
    log = log.sort_values("n")
    # Targets come as text: by way of floats, ids above 2^53 would be rounded.
    targets = log["target"].tolist() if "target" in log else [None] * len(log)
    entries = zip(log["n"].tolist(), log["seq"].tolist(), _micros(log["ts"]), log["kind"].tolist(),
                  log["email"].tolist(), log["is_payer"].tolist(), targets, strict=True)
    decided = []
    for n, seq, now, kind, email, is_payer, target in entries:
        if kind in CREATIONS:
            result = desk.create(n, seq, now, email, is_payer, kind == "admin")
        else:
            result = desk.command(kind, now, email, None if target is None else int(target))
        decided.append((seq, *result))
    del entries, targets
    rows = [desk.rows[n] for n in sorted(desk.changed)]
    # Each column is built with its type: by way of floats, ids above 2^53 would be rounded. One at a time, as lists of all columns take as much as the rows.
    columns = {c: _typed(c, [d[i] for d in decided] + [None] * len(rows)) for i, c in enumerate(DECISION_FIELDS)}
    before = [None] * len(decided)
    del decided
    columns |= {c: _typed(c, before + [r[c] for r in rows]) for c in ROW_FIELDS}
    out = pd.DataFrame(columns, copy=False)
    out["pool"] = log["pool"].iloc[0]
    return out


WHOLE = ("waitlist_position", "row_id", "seq", "n", "id")
FLAGS = ("is_waitlist", "is_payer")


def _typed(name: str, values: list):
    if name in WHOLE:
        return pd.array(values, dtype="Int64")
    if name in FLAGS:
        return pd.array(values, dtype="boolean")
    if name in TIMES:
        return pd.Series(pd.array(values, dtype="Int64").to_numpy(np.int64, na_value=np.iinfo(np.int64).min).view("datetime64[us]"))
    return pd.Series(values, dtype="object")


def _step(hold_us: int, fair: bool, promoted_anew: bool):
    columns = [c.split()[0] for c in STEP_SCHEMA.split(", ")]

    def step(log: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if log.empty:
            return pd.DataFrame(columns=columns)
        first = log.iloc[0]
        desk = PoolDesk(int(first["capacity"]), int(first["paid"]), int(first["waiting"]), hold_us, rows_in(rows), fair, promoted_anew)
        return replay_entries(desk, log)[columns]

    return step


def prepare_log(log: DataFrame, cap: DataFrame, payers: DataFrame) -> DataFrame:
    """Log with the fixed facts each decision needs: capacity and payers of the pool, and who is a payer. A ``target`` goes on as text."""
    paid_mail = payers.select(F.lower(F.col("email")).alias("email")).distinct().withColumn("_p", F.lit(True))
    paid_pool = payers.groupBy("pool").agg(F.count(F.lit(1)).alias("_paid"))
    fixed = cap.join(paid_pool, "pool", "left").select("pool", "capacity", F.coalesce("_paid", F.lit(0)).alias("paid"))
    return (
        log.withColumn("email", norm_email(F.col("email")))
        .join(paid_mail, "email", "left")
        .join(fixed, "pool", "left")
        .select(
            "pool", "seq", "ts", "kind", "email",
            F.coalesce("capacity", F.lit(0)).alias("capacity"),
            F.coalesce("paid", F.lit(0)).alias("paid"),
            F.col("_p").isNotNull().alias("is_payer"),
            *([F.col("target").cast("string").alias("target")] if "target" in log.columns else []),
        )
    )


# Rows of a pool's log that are counted together where the heads of its queue are looked for.
BLOCK = 4096
# Between the rounds a pool's name is never null, so that plain joins find its rows.
NAMED, PLAIN = "CASE WHEN pool IS NULL THEN '' ELSE '=' || pool END", "CASE WHEN pool <> '' THEN substring(pool, 2) END"


class _Folder:
    """The tables of one replay in the shared folder.

    What a round hands on is written and read again, not checkpointed: a checkpoint keeps the size that the planner guessed for it, joins multiply such guesses,
    and so they double in length with every round.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        df.write.partitionBy(*by).parquet(f"{self.path}/{name}")
        return self.read(name, df.schema)

    def read(self, name: str, schema: StructType | str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def remove(self, name: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def _wanted(log: DataFrame) -> DataFrame:
    """How many of an e-mail's newest live rows a round can touch (``_want``), for the e-mails that its commands mean."""
    keys = ["_round", "pool", "email"]
    cancels = F.col("kind") == "cancel"
    commands = log.filter(~F.col("kind").isin(*CREATIONS))
    by_mail = commands.filter("target IS NULL") if "target" in log.columns else commands
    # A command takes the newest live row of its e-mail, so c cancellations reach c + 1 rows.
    wanted = by_mail.groupBy(*keys).agg((F.count_if(cancels) + 1).alias("_want"))
    if "target" not in log.columns:
        return wanted
    # Rows that are cancelled by id no longer stand before older rows of their e-mail.
    hit = commands.filter(cancels & F.col("target").isNotNull()).select("_round", "pool", F.col("target").cast("long").alias("id")).distinct()
    made = log.filter(F.col("kind").isin(*CREATIONS)).select("pool", F.col("seq").alias("id"), "email")
    also = hit.join(made, ["pool", "id"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("_also"))
    return wanted.join(also, keys, "left").select(*keys, (F.col("_want") + F.coalesce("_also", F.lit(0))).alias("_want"))


def _pools(rows: DataFrame, part: DataFrame) -> DataFrame:
    """Per pool of a slice: when it begins, how many rows wait, and the block up to which its cancellations and promotions can empty the queue."""
    takes = F.col("kind").isin("cancel", "promote")
    pools = part.groupBy("pool").agg(F.min("ts").alias("_from"), F.count_if(takes).alias("_takes"))
    line = rows.filter("is_waitlist AND payment_status <> 'cancelled'").groupBy("pool", F.floor(F.col("n") / BLOCK).alias("_block")).count()
    before = Window.partitionBy("pool").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    line = line.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    return (
        pools.join(line, "pool", "left")
        .groupBy("pool", "_from")
        .agg(F.coalesce(F.sum("count"), F.lit(0)).alias("waiting"), F.max(F.when(F.col("_before") < F.col("_takes"), F.col("_block"))).alias("_upto"))
    )


def _marked(
    rows: DataFrame, part: DataFrame, pools: DataFrame, wanted: DataFrame, hold: timedelta, hold_from: str, sizes: tuple[int, int], max_group_rows: int | None
) -> DataFrame:
    """``rows`` with ``_reached``: whether the slice can read or change the row. ``sizes`` bounds the rows of an e-mail in a pool."""
    cols = rows.columns
    live = F.col("payment_status") != "cancelled"
    start = F.coalesce("promoted_at", "created_at") if hold_from == "promoted_at" else F.col("created_at")
    active = (F.col("payment_status") == "pending") & ~F.col("is_waitlist") & (start > F.col("_from") - interval(hold))
    heads = F.col("is_waitlist") & live & (F.floor(F.col("n") / BLOCK) <= F.col("_upto"))
    known = rows.join(pools.drop("waiting"), "pool", "left").join(wanted, ["pool", "email"], "left")
    known = known.withColumns({"_gone": ~live, "_back": -F.col("n")})
    known = rank_rows(known, ["pool", "email"], ["_gone", "_back"], "_r", max_group_rows, sizes)
    reached = active | heads | (live & (F.col("_r") <= F.col("_want")))
    if "target" in part.columns:
        ids = part.filter("target IS NOT NULL").select("pool", F.col("target").cast("long").alias("id")).distinct()
        known = known.join(ids.withColumn("_named", F.lit(True)), ["pool", "id"], "left")
        reached = reached | F.col("_named")
    return known.select(*cols, F.coalesce(reached, F.lit(False)).alias("_reached"))


def _slices(ranked: DataFrame, slice_rows: int) -> str:
    """Write the numbered log, a folder per slice; a round reads its own folder only."""
    shared = f"{shared_dir(ranked.sparkSession)}/replay-log-{uuid.uuid4().hex}"
    sliced = ranked.withColumn("_round", F.floor((F.col("n") - 1) / slice_rows).cast("int"))
    sliced.repartition("_round", "pool").write.partitionBy("_round").parquet(shared)
    return shared


def replay_requests(
    log: DataFrame,
    cap: DataFrame,
    payers: DataFrame,
    hold: timedelta = HOLD,
    slice_rows: int = SLICE_ROWS,
    max_group_rows: int | None = None,
    fair: bool = False,
    hold_from: str = "created_at",
) -> tuple[DataFrame, DataFrame]:
    """Replay ``log`` (seq, ts, kind, email, pool, and ``target`` if it has one). Returns (decision per log row, request rows at the end).

    ``create`` reuses the e-mail's active hold, else takes a place if one remains, else joins the waitlist.
    ``pay``, ``waive``, ``unmark`` and ``cancel`` act on the row whose id (the ``seq`` that made it) is ``target``, or where that is null on the newest
    live row of the e-mail in the pool; cancelling a
    row that is not waitlisted promotes the head of the queue. A payment frees its place until the payer list has
    it, and a promoted row keeps its date, so it usually counts no more. Input is validated beforehand.

    By id a cancelled row can be paid, waived or unmarked: it is live again without a look at the quota, and one that waited is back in the queue at the place of its
    date. ``promote`` lets the named waitlist row in, whoever is before it, and ``admin`` makes a row that is neither refused nor
    reused. Ids that name no such row of the pool are ``unmatched``.

    With ``fair``, nobody takes a place while others wait. With ``hold_from="promoted_at"`` a promoted row's hold counts from its promotion.
    """
    known = prepare_log(log, cap, payers)
    sizes = group_sizes(log, ["pool"])
    ranked = rank_rows(known, ["pool"], ["ts", "seq"], "n", max_group_rows, sizes)
    rounds = max(1, math.ceil(sizes[0] / slice_rows))
    step = _step(int(hold.total_seconds() * 1_000_000), fair, hold_from == "promoted_at")
    spark = log.sparkSession
    none = spark.createDataFrame([], ROW_SCHEMA)
    if rounds == 1:
        part = ranked.withColumn("waiting", F.lit(0).cast("long"))
        out = part.groupBy("pool").cogroup(none.groupBy("pool")).applyInPandas(step, STEP_SCHEMA)
        return _decisions(out), _rows(out)
    entries, by_id, shared = _slices(ranked.withColumn("pool", F.expr(NAMED)), slice_rows), "target" in log.columns, _Folder(spark)
    whole = spark.read.schema(StructType([*ranked.schema, StructField("_round", IntegerType())])).parquet(entries)
    wanted = shared.write(_wanted(whole).repartition("_round", "pool"), "wanted", "_round")
    mail_sizes = group_sizes(whole.filter(F.col("kind").isin(*CREATIONS)), ["pool", "email"])
    rows = none
    for k in range(rounds):
        part = whole.filter(F.col("_round") == k).drop("_round")
        pools = shared.write(_pools(rows, part), f"pools/{k}")
        held = _marked(rows, part, pools, wanted.filter(F.col("_round") == k).drop("_round"), hold, hold_from, mail_sizes, max_group_rows)
        held = shared.write(held, f"rows/{k}", "_reached")
        if k:
            shared.remove(f"rows/{k - 1}")
        part = part.join(pools.select("pool", "waiting"), "pool")
        reach = held.filter("_reached").drop("_reached")
        shared.write(part.groupBy("pool").cogroup(reach.groupBy("pool")).applyInPandas(step, STEP_SCHEMA), f"steps/_round={k}")
        rows = _after(held, _rows(shared.read(f"steps/_round={k}", STEP_SCHEMA)))
        if not by_id:
            # By e-mail a cancelled row is out of reach for good.
            rows = rows.filter("payment_status <> 'cancelled'")
    steps = shared.read("steps", STEP_SCHEMA)
    if not by_id:
        rows = rows.unionByName(_rows(steps).filter("payment_status = 'cancelled'"))
    return _decisions(steps).withColumn("pool", F.expr(PLAIN)), rows.withColumn("pool", F.expr(PLAIN))


def _after(held: DataFrame, changed: DataFrame) -> DataFrame:
    """The rows after a slice: those it could not reach stay as they are, of the others those it has not changed."""
    same = held.filter("_reached").join(changed.select("pool", "n"), ["pool", "n"], "left_anti")
    return held.filter("NOT _reached").unionByName(same).drop("_reached").unionByName(changed)


def _decisions(out: DataFrame) -> DataFrame:
    return out.filter(F.col("seq").isNotNull()).select("pool", *DECISION_FIELDS)


def answers(decisions: DataFrame, price: Column) -> DataFrame:
    """What each registration is told: row, price, waitlist flag and position.

    A reused hold is quoted the price of today, whatever its row was stored with.
    """
    told = decisions.filter(F.col("action").isin("reused", "held", "waitlisted"))
    return told.select(
        "seq",
        "row_id",
        price.alias("amount_eur"),
        (F.col("action") == "waitlisted").alias("is_waitlist"),
        "waitlist_position",
    )


def _rows(out: DataFrame) -> DataFrame:
    return out.filter(F.col("n").isNotNull()).select("pool", *ROW_FIELDS)
