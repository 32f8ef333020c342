import random

import numpy as np
from pyspark.sql import functions as F

from seatward.llm.quality import BAD, FEATURES, GOOD, RULES, features, fit_votes, keep_good, quality, repeat_words

NAMES = [f.split()[0] for f in FEATURES.split(", ")]


def brute_repeat(words):
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for starts in seen.values() if len(starts) > 1 for i in starts for k in range(8)}
    return len(covered)


def test_repeat_words_against_brute_force():
    rng = random.Random(4)
    for _ in range(400):
        words = [rng.choice("abc")] * rng.randrange(3) + [rng.choice("abcdefgh"[: rng.randrange(1, 9)]) for _ in range(rng.randrange(60))]
        words += words[: rng.randrange(30)]
        assert repeat_words(words) == brute_repeat(words)
    assert repeat_words(["w"] * 100_000) == 100_000 and repeat_words([]) == 0


def test_counts():
    got = dict(zip(NAMES, features("a b c #$\n\n a b c #$\n a b c #$\x0b \n"), strict=True))
    assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_lines"]) == (9, 18, 6, 3)
    # Lines are compared whole, blanks included.
    assert got["n_dup_lines"] == 0 and features("x\nx\n\n\nx ")[3] == 1
    assert features(None) == features("") == (0,) * 10


def test_fit_orders_rules_and_never_turns_round():
    rng = np.random.default_rng(1)
    n, k = 20_000, len(RULES)
    good = rng.random(n) < 0.8
    votes = np.zeros((n, k), int)
    for j, sql in enumerate(RULES.values()):
        bad_rate = np.where(good, 0.01, 0.5 if j % 2 else 0.2)
        if f"WHEN false THEN {BAD}" not in sql:
            votes[:, j] = np.where(rng.random(n) < bad_rate, BAD, votes[:, j])
        if f"WHEN false THEN {GOOD}" not in sql:
            votes[:, j] = np.where((votes[:, j] == 0) & (rng.random(n) < np.where(good, 0.8, 0.4)), GOOD, votes[:, j])
    patterns, counts = np.unique(votes @ 3 ** np.arange(k), return_counts=True)
    model = fit_votes(patterns, counts)
    assert abs(model.good - 0.8) < 0.05
    right = (model.posterior(votes @ 3 ** np.arange(k)) > 0.5) == good
    assert right.mean() > 0.95
    # Without any bad document nothing clean is lost, and an empty corpus fits too.
    assert fit_votes(np.array([1 + 6561]), np.array([100])).posterior(np.array([1 + 6561]))[0] > 0.9
    assert fit_votes(np.array([], int), np.array([], int)).good > 0.5


def corpus():
    rng = random.Random(2)
    vocab = ["the", "and", "of"] + ["".join(rng.choice("aeiourstln") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocab) + ("." if i % 12 == 11 else "") for i in range(n))
    clean = [(i, prose(rng.randrange(30, 400))) for i in range(150)]
    junk = [(1000 + i, " ".join(w + rng.choice(["$$$", "###", "%%%"]) for w in prose(80).split())) for i in range(15)]
    junk += [(1100 + i, " ".join(w.upper() + "!!" for w in prose(80).split())) for i in range(15)]
    junk += [(1200 + i, " ".join(w for w in prose(30).split() for _ in range(9))) for i in range(15)]
    return clean, junk


def test_keeps_clean_and_drops_junk(docs_df):
    clean, junk = corpus()
    df = docs_df([*clean, *junk, (2000, None), (2001, ""), (2002, "short"), (None, clean[0][1]), (0, clean[0][1])])
    rows = quality(df, carry=["doc_id"]).collect()
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert {i for i, _ in clean} <= kept and not kept & {i for i, _ in junk} and not kept & {2000, 2001, 2002}
    assert None in kept and sum(r["doc_id"] == 0 for r in rows) == 2
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in rows)
    assert all(not (r["base_failed"] and r["kept"]) for r in rows)


def test_stage_keeps_columns(docs_df):
    clean, junk = corpus()
    df = docs_df([*clean, *junk]).withColumns({"kept": F.lit(1), "pattern": F.lit("p"), "row": F.lit(2)})
    out = keep_good(df)
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} == {i for i, _ in clean}
    assert keep_good(docs_df([])).count() == 0 and quality(docs_df([])).count() == 0
