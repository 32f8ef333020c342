"""Team invitations: issue, count, and single-use redemption."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatward.session import pin

# Attempts that one task decides one after the other.
FOLD_ATTEMPTS = 500_000
# Rounds of minima before the attempts left are told apart by component.
GREEDY_ROUNDS = 3


def eligible_inviters(requests: DataFrame, payers: DataFrame) -> DataFrame:
    """Requests whose lower-cased captain e-mail is in the payer list as stored."""
    paid = payers.select(F.col("email").alias("_payer"))
    return requests.join(paid, F.lower(F.col("inviter_email")) == F.col("_payer"), "left_semi")


def issue_invites(requests: DataFrame, payers: DataFrame, token: Column | None = None) -> DataFrame:
    """One unused token per eligible request. Live jobs use a random token; tests pass one derived from keys."""
    token = F.uuid() if token is None else token
    return eligible_inviters(requests, payers).select(
        token.alias("token"),
        F.lower(F.col("inviter_email")).alias("inviter_email"),
        F.lit(None).cast("string").alias("used_by_email"),
        F.lit(None).cast("timestamp_ntz").alias("used_at"),
    )


def invites_by_captain(invites: DataFrame) -> DataFrame:
    return invites.groupBy("inviter_email").agg(
        F.count(F.lit(1)).cast("int").alias("invites"), F.count("used_at").cast("int").alias("used")
    )


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) == "")


def _one_by_one(seqs: list, tokens: list, emails: list, used: set, made: set) -> list[bool]:
    """Which attempts win, in order: each takes its token and its e-mail, if both are free."""
    won = []
    for _, token, email in zip(seqs, tokens, emails, strict=True):
        free = token not in used and email not in made
        if free:
            used.add(token)
            made.add(email)
        won.append(free)
    return won


def _fold_all(left: DataFrame) -> DataFrame:
    """The winners among attempts that are few enough for one task, which reads them in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used: set = set()
        made: set = set()
        for batch in batches:
            yield batch.filter(pa.array(_one_by_one(*(batch.column(i).to_pylist() for i in range(3)), used, made), pa.bool_()))

    return left.select("seq", "token", "email").repartition(1).sortWithinPartitions("seq").mapInArrow(run, left.schema)


def _fold_components(labelled: DataFrame) -> DataFrame:
    """The winners, component by component."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        won = _one_by_one(*(rows[c].tolist() for c in ("seq", "token", "email")), set(), set())
        return rows.loc[won, ["seq", "token", "email"]]

    schema = labelled.select("seq", "token", "email").schema
    return labelled.groupBy("component").applyInPandas(run, schema)


def attempt_components(left: DataFrame) -> DataFrame:
    """(seq, token, email, component): attempts that tokens and e-mails connect share the least ``seq`` among them.

    A round takes the least label around each token and e-mail, and then the label of that label, so that chains shorten by doubling.
    """
    labels = pin(left.select("seq", "token", "email", F.col("seq").alias("component")))
    while True:
        by_token = labels.groupBy("token").agg(F.min("component").alias("_t"))
        by_email = labels.groupBy("email").agg(F.min("component").alias("_e"))
        near = labels.join(by_token, "token").join(by_email, "email").select(
            "seq", "token", "email", F.col("component").alias("_was"), F.least("_t", "_e").alias("_near")
        )
        near = pin(near)
        above = near.select(F.col("seq").alias("_near"), F.col("_near").alias("_above"))
        jumped = pin(near.join(above, "_near").select("seq", "token", "email", "_was", F.col("_above").alias("component")))
        labels = jumped.drop("_was")
        if jumped.filter("component <> _was").isEmpty():
            return labels


def _greedy_round(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(winners, what is left): attempts that are the earliest left for their token and for their e-mail win."""
    per_token = left.groupBy("token").agg(F.min_by(F.struct("seq", "email"), "seq").alias("_t"))
    per_email = left.groupBy("email").agg(F.min("seq").alias("seq"))
    won = pin(
        per_token.select(F.col("_t.seq").alias("seq"), "token", F.col("_t.email").alias("email")).join(
            per_email, ["email", "seq"], "left_semi"
        ).select("seq", "token", "email")
    )
    rest = left.join(won.select("token"), "token", "left_anti").join(won.select("email"), "email", "left_anti")
    return won, pin(rest.select("seq", "token", "email"))


def winning_attempts(left: DataFrame, fold_attempts: int = FOLD_ATTEMPTS) -> tuple[DataFrame, int]:
    """(seq, token, email of the winners, rounds taken) among attempts whose token and e-mail are free at the start.

    Few attempts are decided in order by one task. More of them go through rounds of minima, which in random order leave a fraction each. What a few rounds
    leave is told apart by component, as attempts without a token or e-mail in common do not meet: components that fit a task are decided
    in order side by side, and rounds go on with larger ones only.
    """
    left = pin(left.select("seq", "token", "email"))
    parts, rounds, next_split = [], 0, GREEDY_ROUNDS
    while (n := left.count()) > fold_attempts:
        won, left = _greedy_round(left)
        parts.append(won)
        rounds += 1
        if rounds >= next_split and left.count() > fold_attempts:
            next_split = 2 * rounds
            labelled = attempt_components(left)
            sizes = labelled.groupBy("component").count()
            large = pin(sizes.filter(F.col("count") > fold_attempts).select("component"))
            parts.append(pin(_fold_components(labelled.join(large, "component", "left_anti"))))
            left = pin(labelled.join(large, "component", "left_semi").select("seq", "token", "email"))
            rounds += 1
    if n:
        parts.append(pin(_fold_all(left)))
        rounds += 1
    winners = left.limit(0)
    for part in parts:
        winners = winners.unionByName(part)
    return winners, rounds


def redeem_tokens(
    attempts: DataFrame, invites: DataFrame, champions: DataFrame, fold_attempts: int = FOLD_ATTEMPTS
) -> tuple[DataFrame, DataFrame]:
    """Redeem single-use tokens in ``seq`` order, each creating at most one champion per e-mail.

    An attempt wins when its token is unused and its e-mail is no champion yet at its turn; a failed attempt
    leaves the token usable. Taken one by one this is a greedy matching on two keys, see ``winning_attempts``. Minima combine
    map-side, so a token or e-mail with very many attempts is never gathered.

    Returns (attempts with ``reason``, null when accepted; champions created).
    """
    checked = (
        attempts.withColumn("email", F.lower(F.col("email")))
        .join(
            invites.select("token", F.lit(True).alias("_known"), F.col("used_at").alias("_used"), "inviter_email"),
            "token",
            "left",
        )
        .join(champions.select("email", F.lit(True).alias("_champion")), "email", "left")
        .withColumn(
            "_fixed",
            F.coalesce(
                F.when(_blank("token"), "token_blank"),
                F.when(_blank("email"), "email_blank"),
                F.when(_blank("pseudo"), "pseudo_blank"),
                F.when(_blank("region"), "region_blank"),
                F.when(F.col("_known").isNull(), "token_unknown"),
                F.when(F.col("_used").isNotNull(), "token_used"),
            ),
        )
        .drop("_known", "_used")
    )
    checked = pin(checked)
    open_to_win = F.col("_fixed").isNull() & F.col("_champion").isNull()
    winners, _ = winning_attempts(checked.filter(open_to_win), fold_attempts)
    # A loser met a token already used by an earlier winner, or an e-mail made champion by one.
    by_token = winners.select("token", F.col("seq").alias("_token_seq"))
    won_seq = winners.select("seq", F.lit(True).alias("_won"))
    settled = checked.join(won_seq, "seq", "left").join(by_token, "token", "left")
    lost = F.when(F.col("_token_seq") < F.col("seq"), "token_used").otherwise("email_taken")
    reason = F.coalesce(F.col("_fixed"), F.when(F.col("_won").isNull(), lost))
    result = settled.withColumn("reason", reason).drop("_fixed", "_won", "_token_seq", "_champion")
    created = result.filter(F.col("reason").isNull()).drop("reason")
    return result, forged_champions(created)


def forged_champions(accepted: DataFrame) -> DataFrame:
    """Champion rows of accepted attempts, with the defaults of optional fields."""
    has = lambda c, t: F.col(c) if c in accepted.columns else F.lit(None).cast(t)
    return accepted.select(
        "seq",
        "token",
        "email",
        "pseudo",
        "region",
        F.coalesce(has("is_parisian_redistributed", "boolean"), F.lit(False)).alias("is_parisian_redistributed"),
        F.coalesce(has("heroes", "array<string>"), F.array().cast("array<string>")).alias("heroes"),
        *[has(c, "string").alias(c) for c in ("faction", "story", "blason")],
        F.col("inviter_email").alias("invited_by_email"),
    )


def mark_used(invites: DataFrame, created: DataFrame, used_at: Column) -> DataFrame:
    """Invitations after redemption: used tokens carry who and when."""
    used = created.select("token", F.col("email").alias("_by"))
    hit = F.col("_by").isNotNull()
    return (
        invites.join(used, "token", "left")
        .withColumns(
            {
                "used_by_email": F.when(hit, F.col("_by")).otherwise(F.col("used_by_email")),
                "used_at": F.when(hit, used_at).otherwise(F.col("used_at")),
            }
        )
        .select(*invites.columns)
    )
