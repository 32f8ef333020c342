"""Exact deduplication: two passes with a Bloom filter between them.

Pass one hashes every text and keeps, in a Bloom filter, the positions that at least two rows hit. Pass two tests
each row against that filter. Rows whose positions are not all in it have no equal text and pass straight through; only the
rest are grouped by SHA-256, so only they shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatward.llm.common import documents, packed, query, stored, text_or_empty, unpacked

# Words of 64 bits in the filter, at most: 2^21 words are 32 MB to broadcast whatever the input. Beyond about four rows
# a word more rows are taken for possible repeats, and shuffle; the result is the same.
MAX_SLOTS = 1 << 21
PROBES = 3


def _slots(rows: int, most: int) -> int:
    """About 16 bits a row, a power of two."""
    return min(most, max(64, 1 << (max(rows, 1) // 4).bit_length()))


def repeated_filter(texts: DataFrame, hashed: str, slots: int) -> DataFrame:
    """(slot, mask): the bits that two rows or more have hit, of a Bloom filter with all probes of a row in one word."""
    hits = texts.select(
        F.pmod(hashed, F.lit(slots)).alias("slot"), F.explode(F.array_distinct(_bits(hashed))).alias("bit")
    )
    twice = hits.groupBy("slot", "bit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.groupBy("slot").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask"))


def _bits(hashed: str):
    more = F.xxhash64(F.col(hashed), F.lit(1))
    return F.array(*(F.shiftright(more, 6 * j).bitwiseAND(63).cast("int") for j in range(PROBES)))


def exact_dedup(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    carry: list[str] | None = None,
    max_slots: int = MAX_SLOTS,
) -> DataFrame:
    """Every row with the row of its text that stays: ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when identical; a null text counts as empty. Of equal texts the row with the largest key
    stays; null keys rank lowest, and of rows that tie on the key exactly one stays. ``carry`` names the input columns to
    return (all by default). Input columns named like a result column give way to it. An empty table gives no rows.
    """
    spark = docs.sparkSession
    slots = _slots(docs.count(), max_slots)
    hashed = docs.select(F.xxhash64(text_or_empty(text)).alias("h"))
    seen_twice = stored(repeated_filter(hashed, "h", slots), "dedup-filter")

    rows = docs.select(
        packed(docs, carry),
        F.col(key).alias("key"),
        F.sha2(text_or_empty(text), 256).alias("text_sha256"),
        F.xxhash64(text_or_empty(text)).alias("h"),
    )
    bits = _bits("h")
    probe = F.expr("shiftleft(1L, bits[0]) | shiftleft(1L, bits[1]) | shiftleft(1L, bits[2])")
    flagged = (
        rows.withColumn("slot", F.pmod("h", F.lit(slots)))
        .withColumn("bits", bits)
        .withColumn("probe", probe)
        # At most max_slots rows of 16 bytes.
        .join(F.broadcast(seen_twice), "slot", "left")
        .withColumn("possible", F.coalesce(F.expr("(mask & probe) = probe"), F.lit(False)))
        .select("row", "key", "text_sha256", "possible")
    )
    single = flagged.where("NOT possible").select(
        "row", F.col("key").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    possible = stored(
        flagged.where("possible").select(
            "row", "key", F.unhex("text_sha256").alias("digest"), F.monotonically_increasing_id().alias("pos")
        ),
        "dedup-possible",
    )
    # A group of any size leaves one row per task here, so the groups are small; the join below splits hot digests.
    groups = possible.groupBy("digest").agg(
        F.max(F.struct("key", "pos")).alias("best"), F.count(F.lit(1)).alias("group_size")
    )
    repeated = possible.join(groups, "digest").select(
        "row",
        F.col("best.key").alias("keep_id"),
        "group_size",
        (F.col("pos") == F.col("best.pos")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
    return unpacked(single.unionByName(repeated), "keep_id", "group_size", "kept", "text_sha256")


def drop_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows that stay, with the input's columns."""
    wrapped = docs.select(packed(docs), F.col(key).alias("k"), F.col(text).alias("t"))
    return exact_dedup(wrapped, "t", "k").where("kept").select("row.*")


CHECK = """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""


@query("op1_exact_dedup", CHECK)
def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(documents(spark, folder), carry=["doc_id"])
