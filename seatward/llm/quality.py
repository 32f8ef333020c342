"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them, a posterior decides.

Each rule looks at a few counts of a text and votes good, bad, or not at all. How often each pattern of votes occurs is counted
over all documents; a table of at most 3^9 patterns is all the fit sees. A mixture of two classes with independent rules gives
every pattern a posterior probability of good quality, and that decides, not the failure of any one rule.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seatward.llm.common import documents, packed, query, stored, unpacked
from seatward.llm.texts import each, map_texts

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
# Frequent function words of the languages expected; the rule that uses them abstains where none is found.
COMMON = frozenset(
    w.encode()
    for w in "the and of to in is that for with was a by on les des et la le de que un une pour dans der die und das den mit von zu"
    " ein eine ist el los del y en por con para se".split()
)
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))

FEATURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_echo long,"
    " n_common long, n_letters long, n_upper long"
)


def repeat_words(words: list) -> int:
    """Words covered by windows of eight that occur twice or more, the first occurrence included.

    Windows get equal numbers exactly when they are equal: pairs of words are numbered, then pairs of pairs, then those.
    """
    n = len(words)
    if n <= WINDOW:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    for step in (1, 2, 4):
        _, ids = np.unique(ids[:-step] * (n + 1) + ids[step:], return_inverse=True)
    found = np.bincount(ids)[ids] > 1
    if not found.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(found)
    edge[starts] += 1
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def features(text: str | None) -> tuple:
    """The counts the rules look at, in the order of ``FEATURES``; a null text has none of anything."""
    if not text:
        return (0,) * 10
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly the six ASCII blanks
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    upper = len(raw) - len(raw.translate(None, _UPPER))
    lower = len(raw) - len(raw.translate(None, _LOWER))
    wide = len(text) - len(text.encode("ascii", "ignore"))
    return (
        n, chars, symbols, len(lines) - len(set(lines)), repeat_words(words), len(lines),
        sum(map(bytes.__eq__, words[1:], words)), sum(map(COMMON.__contains__, words)), upper + lower + wide, upper,
    )


GOOD, BAD = 1, 2


def _vote(bad: str | None, good: str | None) -> str:
    return f"CASE WHEN {bad or 'false'} THEN {BAD} WHEN {good or 'false'} THEN {GOOD} ELSE 0 END"


# Votes over the counts of ``FEATURES``. Ratios are written as products, so that an empty text divides nothing. Most rules look for
# one defect and abstain where it is absent: that a text has no repeated lines is no sign of quality.
RULES = {
    "length": _vote("n_words < 20", "n_words >= 50"),
    "word_length": _vote("word_chars < 3 * n_words OR word_chars > 12 * n_words", None),
    "symbols": _vote("n_symbols > 0.1 * n_words", None),
    "dup_lines": _vote("n_dup_lines >= 2 AND n_dup_lines > 0.3 * n_lines", None),
    "repeats": _vote("n_repeat_words > 0.3 * n_words", None),
    "echo": _vote("n_echo > 0.1 * n_words", None),
    "capitals": _vote("n_upper > 0.4 * n_letters", None),
    "letters": _vote("n_letters < 0.75 * word_chars", None),
    "common": _vote(None, "n_common > 0.06 * n_words"),
}
# Shares of abstain, good and bad expected per class, and their weight as a share of all documents: they keep a rare class from
# taking over a rule, and fix which class is the good one.
PRIOR_VOTES = {0: (0.6, 0.15, 0.25), 1: (0.57, 0.42, 0.01)}
PRIOR_SHARE = 0.02
PRIOR_GOOD = 0.85


def votes() -> Column:
    """The pattern of votes as one number, a digit to the base three for each rule."""
    return F.expr(" + ".join(f"({sql}) * {3**i}" for i, sql in enumerate(RULES.values()))).cast("int")


def digits(patterns: np.ndarray) -> np.ndarray:
    return (patterns[:, None] // 3 ** np.arange(len(RULES))) % 3


class VoteModel:
    """Two classes (0 bad, 1 good); per rule and class the shares of abstain, good and bad."""

    def __init__(self, good: float, shares: np.ndarray):
        self.good, self.shares = good, shares  # shares: rule, class, vote

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        v = digits(patterns)
        rule = np.arange(len(RULES))
        log = [np.log(self.shares[rule, c, v]).sum(axis=1) for c in (0, 1)]
        odds = log[1] - log[0] + np.log(self.good) - np.log1p(-self.good)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def accuracies(self) -> dict[str, float]:
        """How often a rule's vote is right when it votes."""
        weight = np.array([1 - self.good, self.good])
        right = self.shares[:, 0, BAD] * weight[0] + self.shares[:, 1, GOOD] * weight[1]
        voted = ((1 - self.shares[:, :, 0]) * weight).sum(axis=1)
        return dict(zip(RULES, right / voted, strict=True))


def _prior() -> np.ndarray:
    """Rule, class, vote: a rule that cannot vote good (or bad) has that share among its abstentions."""
    out = np.empty((len(RULES), 2, 3))
    for j, sql in enumerate(RULES.values()):
        for c, (none, good, bad) in PRIOR_VOTES.items():
            one_sided = [f"WHEN false THEN {k}" in sql for k in (GOOD, BAD)]
            out[j, c] = (none + good * one_sided[0] + bad * one_sided[1], good * (not one_sided[0]), bad * (not one_sided[1]))
    return np.maximum(out, 1e-6) / np.maximum(out, 1e-6).sum(axis=2, keepdims=True)


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> VoteModel:
    """Expectation-maximisation over the counted patterns, from the expected shares on.

    A rule whose bad votes turn up as often among good documents as among bad ones is made neutral, never turned round.
    """
    v, counts, prior = digits(patterns), counts.astype(float), _prior()
    strength = max(10.0, PRIOR_SHARE * counts.sum())
    model = VoteModel(PRIOR_GOOD, prior)
    q = model.posterior(patterns)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - q), counts * q])
        seen = np.array([[[w[v[:, j] == k].sum() for k in range(3)] for w in weight] for j in range(len(RULES))])
        shares = seen + strength * prior
        shares /= shares.sum(axis=2, keepdims=True)
        turned = (shares[:, 1, GOOD] * shares[:, 0, BAD] < shares[:, 0, GOOD] * shares[:, 1, BAD])[:, None, None]
        shares = np.where(turned, shares.mean(axis=1, keepdims=True), shares)
        model = VoteModel((weight[1].sum() + strength * PRIOR_GOOD) / (counts.sum() + strength), shares)
        new = model.posterior(patterns)
        if np.abs(new - q).max(initial=0) < 1e-9:
            break
        q = new
    return model


def with_features(df: DataFrame, text: str) -> DataFrame:
    return map_texts(df, F.col(text), each(features), FEATURES)


def fit_quality(measured: DataFrame) -> VoteModel:
    """The model from all documents: their patterns are counted in Spark, at most 3^9 rows come back."""
    counted = measured.groupBy(votes().alias("pattern")).count().toPandas()
    return fit_votes(counted["pattern"].to_numpy(np.int64), counted["count"].to_numpy(np.int64))


BASE_FAILED = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"


def verdict(measured: DataFrame, model: VoteModel, threshold: float = 0.5) -> DataFrame:
    """``p_good``, ``base_failed`` and ``kept`` for rows with the counts. The posterior of every pattern is a table of 3^9 rows."""
    patterns = np.arange(3 ** len(RULES))
    table = measured.sparkSession.createDataFrame(
        list(zip(patterns.tolist(), model.posterior(patterns).tolist(), strict=True)), "pattern int, p_good double"
    )
    judged = measured.withColumn("pattern", votes()).join(F.broadcast(table), "pattern", "left")
    judged = judged.withColumn("base_failed", F.expr(BASE_FAILED))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def quality(docs: DataFrame, text: str = "text", carry: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Every row with its counts, ``base_failed``, ``p_good`` and ``kept``.

    A null or empty text has no words, so it fails the base rule. Repeated rows each count and get equal results; an empty
    table gives no rows. Input columns named like a result column give way to it.
    """
    measured = stored(with_features(docs.select(packed(docs, carry), F.col(text).alias("text")), "text").drop("text"), "quality")
    names = [f.split()[0] for f in FEATURES.split(", ")]
    return unpacked(verdict(measured, fit_quality(measured), threshold), *names, "base_failed", "p_good", "kept")


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that are kept, with the input's columns. Texts are measured twice rather than stored once more."""
    # Texts do not pass through Python where only their counts are wanted.
    model = fit_quality(map_texts(docs, F.col(text), each(features), FEATURES, keep=[]))
    # The text is read out of the row: one more copy of it in a batch is what an executor has no room for.
    measured = with_features(docs.select(packed(docs)), f"row.`{text}`")
    return verdict(measured, model, threshold).where("kept").select("row.*")


@query("op4_quality_votes")
def op4_quality_votes(spark: SparkSession, folder: str) -> DataFrame:
    out = quality(documents(spark, folder), carry=["doc_id"])
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"
    )
