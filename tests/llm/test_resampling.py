import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seatward.llm import resampling
from seatward.llm.resampling import cutoff, hashed_runs, resample

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RESULT = ("doc_id", "n_words", "n_features", "weight", "score", "rank")


def features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(WORDS, lower)
    return words, words + [" ".join(p) for p in zip(words, words[1:])]


def brute(rows, target, percent=25, min_words=20, seed=7):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    corpus, wanted = Counter(), Counter()
    for _, text in rows:
        corpus.update(map(bucket, features(text)[1]))
    for text in target:
        wanted.update(map(bucket, features(text)[1]))
    s, t = float(sum(corpus.values())), float(sum(wanted.values()))
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s + 10_000) / ((corpus[b] + 1) * (t + 10_000))))
    out = []
    for key, text in rows:
        words, found = features(text)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = i + 1
    return sorted((tuple(r) for r in out), key=str)


def corpus(seed, n=300):
    rng = random.Random(seed)
    letters = ["the", "of", "Été", "straße", "x1", "Ωmega", "a\x85b", "n o"]
    make = lambda: rng.choice([" ", ", ", "-", "\n"]).join(rng.choice(letters) + rng.choice(["", "s", "9"]) for _ in range(rng.randrange(0, 60)))
    return [(i, make()) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, docs_df, rows_of, monkeypatch, seed):
    rows = [*corpus(seed), (9000, None), (9001, ""), (9002, "!!! ..."), (None, "the of " * 30), (9003, "of the " * 20_000), (-5, "x1 " * 19)]
    target = [t for _, t in corpus(seed + 10, 20)]
    want = brute(rows, target)
    df, goal = docs_df(rows), spark.createDataFrame([(t,) for t in target] + [(None,)], "text string")
    assert rows_of(resample(df, goal), *RESULT) == want
    # The same where ranks are put together from slices.
    monkeypatch.setattr(resampling, "SLICE_ROWS", 10)
    assert rows_of(resample(df.repartition(3), goal), *RESULT) == want


def test_repeated_rows_ties_and_clashing_names(spark, docs_df, rows_of):
    rows = [(1, "of the " * 15)] * 9 + [(2, "of the " * 15)] * 3
    df = docs_df(rows).withColumns({"rank": F.lit("mine"), "row": F.lit(1), "weight": F.lit(0.5), "key": F.lit("k")})
    goal = spark.createDataFrame([("of the",)], "text string")
    got = resample(df, goal).collect()
    assert len(got) == 12 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3]
    assert len({(r["doc_id"], r["score"]) for r in got}) == 2 and {r["key"] for r in got} == {"k"}


def test_empty_tables(spark, docs_df):
    goal = spark.createDataFrame([], "text string")
    assert resample(docs_df([]), goal).count() == 0
    got = resample(docs_df([(1, None), (2, "a b")]), goal).collect()
    # With nothing in the target, a bucket's gain is the log of its smoothed share in the corpus, turned round.
    gain = math.floor(1000 * math.log(10_003 / 20_000))
    assert [(r["n_words"], r["weight"], r["rank"]) for r in sorted(got, key=lambda r: r["doc_id"])] == [(0, 0, None), (2, gain, None)]


def test_hashed_runs():
    words, runs = hashed_runs("A b-c", 3)
    assert words == 3 and sorted(runs) == sorted(zlib.crc32(f) for f in (b"a", b"b", b"c", b"a b", b"b c", b"a b c"))
    assert hashed_runs(None) == (0, []) and hashed_runs(" \x00!") == (0, [])


@pytest.mark.parametrize("accuracy", [2, 10_000])
@pytest.mark.parametrize("values", [range(500), [3] * 500, [0] * 490 + list(range(10)), [-7, 5] * 250])
def test_cutoff_is_the_row_at_the_place(spark, accuracy, values):
    """A coarse sketch only makes the bracket wider; hot scores stay inside it."""
    rows = [(v, False, i, i) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "score long, no_key boolean, key long, pos long")
    for k in (1, 7, 250, 499, 500):
        want = sorted(rows, key=lambda r: (-r[0], r[2]))[k - 1]
        got = cutoff(df, k, 500, accuracy)
        assert (got["score"], got["key"]) == (want[0], want[2])
