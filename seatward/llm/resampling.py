"""Importance resampling towards a target corpus.

Features are hashed runs of words. One pass counts the buckets of the corpus, and of the target; a bucket's gain is the log ratio of
its smoothed shares. A second pass scores each document as an array of buckets looked up in the array of gains. Random noise per
document (Gumbel, from a hash of its key) turns "the highest scores" into a draw without replacement by weight. The cutoff of the draw is found
without sorting the corpus: a quantile sketch brackets it, exact counts outside the bracket validate it (or widen it), and only the bracket is sorted.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seatward.llm.common import documents, packed, query, stored, unpacked
from seatward.llm.texts import PIECE, map_texts
from seatward.operators.ordered import rank_rows

BUCKETS = 10_000
LONGEST = 2
MIN_WORDS = 20
PERCENT = 25
SEED = 7
# Resolution of the quantile sketch: its ranks are off by at most one row in so many.
ACCURACY = 10_000
# Rows that a task sorts when drawn rows are ranked.
SLICE_ROWS = 200_000

# Letters and digits stay (A-Z as a-z), bytes of all other characters beyond ASCII too; what else is in ASCII parts words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def hashed_runs(text: str | None, longest: int = LONGEST) -> tuple[int, list[int]]:
    """Words of a text, and the CRC-32 of every run of 1 to ``longest`` words joined by a blank, repeats included."""
    words = text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []
    run = list(map(crc32, words))
    out = run
    if longest > 1:
        spaced = [b" " + w for w in words]
        for k in range(1, longest):
            # The checksum of a longer run goes on from that of the shorter one at the same start.
            run = list(map(crc32, spaced[k:], run))
            out = out + run
    return len(words), out


def _buckets(texts: list[str | None], longest: int, buckets: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(words, features, buckets of all features one text after the other)."""
    runs = [hashed_runs(t, longest) for t in texts]
    sizes = np.array([len(r) for _, r in runs], np.int64)
    flat = np.fromiter(chain.from_iterable(r for _, r in runs), np.int64, int(sizes.sum()))
    return [n for n, _ in runs], sizes, flat % buckets


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows of the one text column. Tasks add up locally; ``buckets`` numbers come back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                _, _, flat = _buckets(batch.column(0).slice(at, PIECE).to_pylist(), longest, buckets)
                held += np.bincount(flat, minlength=buckets)
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(held[found], pa.int64())], ["bucket", "n"])

    summed = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[summed["bucket"].to_numpy(np.int64)] = summed["n"].to_numpy(np.int64)
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares, rounded down."""
    n = len(corpus)
    all_corpus, all_target = float(corpus.sum()), float(target.sum())
    return np.array(
        [floor(1000 * log((t + 1.0) * (all_corpus + n) / ((s + 1.0) * (all_target + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)],
        np.int64,
    )


def weighted(df: DataFrame, text: Column, gains: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """``df`` with n_words, n_features and weight, the mean gain of the text's features rounded down (0 without features)."""
    held = df.sparkSession.sparkContext.broadcast(gains)  # one number a bucket

    def make():
        table = held.value

        def score(texts: list) -> list[tuple]:
            words, sizes, flat = _buckets(texts, longest, len(table))
            upto = np.concatenate([[0], np.cumsum(table[flat])])
            ends = np.cumsum(sizes)
            weight = (upto[ends] - upto[ends - sizes]) // np.maximum(sizes, 1)
            return list(zip(words, sizes.tolist(), weight.tolist(), strict=True))

        return score

    return map_texts(df, text, make, "n_words long, n_features long, weight long")


def noise(key: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise from a hash of seed and key, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(uniform))).cast("long")


def cutoff(rows: DataFrame, k: int, n: int, accuracy: int = ACCURACY) -> dict:
    """The ``k``-th of the ``n`` rows by falling ``score``, then by ``no_key``, ``key`` and ``pos``.

    ``k`` is 1 to ``n``. The sketch gives two scores between which the row should lie. The exact numbers of rows above and inside decide: while the row
    is not inside, the bracket is made twice as wide, up to all rows, so a bad sketch costs time and never the result.
    """
    slack = 2 * n // accuracy + 1
    while True:
        first, last = max(0, k - slack) / n, min(n, k + slack) / n
        low, high = rows.agg(F.percentile_approx("score", [1 - last, 1 - first], accuracy)).first()[0]
        low, high = (None if k + slack >= n else low), (None if k <= slack else high)
        over = F.lit(False) if high is None else F.col("score") > high
        inside = ~over & (F.lit(True) if low is None else F.col("score") >= low)
        above, within = rows.agg(F.count_if(over), F.count_if(inside)).first()
        if above < k <= above + within:
            break
        slack *= 2
    bracket = rows.where(inside).select("score", (-F.col("score")).alias("back"), "no_key", "key", "pos")
    ranked = rank_rows(bracket, [], ["back", "no_key", "key", "pos"], "at", SLICE_ROWS, sizes=(within, within))
    return ranked.where(F.col("at") == k - above).first().asDict()


def resample(
    docs: DataFrame,
    target: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
    carry: list[str] | None = None,
) -> DataFrame:
    """Every row with n_words, n_features, weight, score and rank: 1, 2, 3 ... for the rows drawn, null for the others.

    ``target`` has a text column ``text`` too. Of the rows with at least ``min_words`` words, ``percent`` of a hundred (rounded down) are drawn, by falling
    score; ties go to the smaller key, null keys last, and of rows equal in both any order. A null or empty text has no words and no
    features, weight 0, and is not drawn (unless ``min_words`` is 0). Repeated rows count each for themselves; repeated keys share their noise. An empty
    table gives no rows, an empty target equal gains by corpus share. Input columns named like a result column give way to it. Texts are read whole.
    """
    corpus = bucket_counts(docs.select(F.col(text)))
    gains = bucket_gains(corpus, bucket_counts(target.select(F.col(text))))
    named = docs.select(packed(docs, carry), F.col(key).alias("key"), F.col(text).alias("text"))
    scored = weighted(named, F.col("text"), gains).drop("text")
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("key"), seed))
    scored = stored(scored.withColumn("no_key", F.col("key").isNull()).withColumn("pos", F.monotonically_increasing_id()), "resample")
    open_rows = scored.where(F.col("n_words") >= min_words)
    n = open_rows.count()
    k = percent * n // 100
    names = ("n_words", "n_features", "weight", "score", "rank")
    if k == 0:
        return unpacked(scored.withColumn("rank", F.lit(None).cast("long")), *names)
    cut = cutoff(open_rows, k, n)
    same_key = F.lit(True) if cut["key"] is None else F.col("key") == F.lit(cut["key"])
    earlier = F.lit(False) if cut["key"] is None else F.col("key") < F.lit(cut["key"])
    upto = earlier | (same_key & (F.col("pos") <= cut["pos"]))
    upto = (F.col("no_key") < F.lit(cut["no_key"])) | ((F.col("no_key") == F.lit(cut["no_key"])) & upto)
    drawn = (F.col("n_words") >= min_words) & ((F.col("score") > cut["score"]) | ((F.col("score") == cut["score"]) & upto))
    drawn = F.coalesce(drawn, F.lit(False))
    ranked = rank_rows(
        scored.where(drawn).withColumn("back", -F.col("score")), [], ["back", "no_key", "key", "pos"], "rank", SLICE_ROWS, sizes=(k, k)
    )
    rest = scored.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return unpacked(ranked.drop("back").unionByName(rest), *names)


# The CRC-32 table follows from the rule; the checksum of a feature is one list step a byte.
CHECK = r"""
    WITH crc_table AS MATERIALIZED (SELECT list(CAST(list_reduce([n] || range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) AS UBIGINT) ORDER BY n) AS t
        FROM (SELECT unnest(range(256)) AS n)),
    texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
    words AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
    runs AS (SELECT side, id, unnest(w || list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words),
    features AS (SELECT side, id, f, count(*) AS n FROM runs GROUP BY ALL),
    hashed AS (SELECT f, CAST(xor(list_reduce([CAST(4294967295 AS UBIGINT)] || list_transform(regexp_extract_all(hex(encode(f)), '..'),
            lambda h: CAST((strpos('0123456789ABCDEF', h[1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2]) - 1 AS UBIGINT)),
            lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) % 10000 AS BIGINT) AS bucket
        FROM (SELECT DISTINCT f FROM features), crc_table),
    placed AS (SELECT side, id, bucket, sum(n) AS n FROM features JOIN hashed USING (f) GROUP BY ALL),
    sides AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM placed GROUP BY bucket),
    totals AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM sides),
    gains AS (SELECT bucket, floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST(all_s AS DOUBLE) + 10000) / ((CAST(s AS DOUBLE) + 1) * (CAST(all_t AS DOUBLE) + 10000))))
            AS gain FROM sides, totals),
    weights AS (SELECT id, sum(n) AS n_features, floor(sum(n * gain) / sum(n)) AS weight FROM placed JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id),
    scored AS (SELECT w.id AS doc_id, len(w.w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
            CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || w.id), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
        FROM words w LEFT JOIN weights v ON v.id = w.id WHERE w.side = 'd'),
    ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
    SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank
    FROM scored s LEFT JOIN ranked r ON r.doc_id = s.doc_id"""


@query("op13_importance_resampling", CHECK)
def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    target = spark.read.parquet(f"{folder.rstrip('/')}/benchmark.parquet")
    out = resample(documents(spark, folder), target, carry=["doc_id"])
    return out.select("doc_id", "n_features", "weight", "score", "rank")
