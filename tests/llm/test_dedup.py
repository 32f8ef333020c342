import hashlib
import random

import pytest
from pyspark.sql import functions as F

from seatward.llm.dedup import drop_repeats, exact_dedup


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    top = {t: max(ids, key=lambda i: (i is not None, i or 0)) for t, ids in groups.items()}
    return [(r[0], top[r[1] or ""], len(groups[r[1] or ""]), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows]


ROWS = [(i, random.Random(i % 37).choice("abcde") * (i % 37)) for i in range(300)] + [(1000 + i, f"single {i}") for i in range(200)]
ROWS += [(2000, None), (2001, ""), (2002, None), (None, "single 1"), (None, "only null id"), (2003, "twin"), (2003, "twin")]
ROWS += [(3000 + i, "hot") for i in range(400)] + [(4000, "é" * 200_000), (4001, "é" * 200_000), (4002, "é"), (4003, "é")]


@pytest.mark.parametrize("slots", [64, 1 << 21])
def test_against_brute_force(docs_df, rows_of, slots):
    out = exact_dedup(docs_df(ROWS), max_slots=slots)
    assert rows_of(out, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(brute(ROWS), key=str)
    kept = out.where("kept")
    assert kept.count() == len({t or "" for _, t in ROWS}) == kept.select("text_sha256").distinct().count()
    assert kept.where("NOT doc_id <=> keep_id").count() == 0


def test_filter_passes_most_single_rows(docs_df, spark):
    from seatward.llm.dedup import _bits, _slots, repeated_filter

    n = 5000
    hashed = spark.range(n).select(F.xxhash64("id").alias("h")).unionByName(spark.range(50).select(F.xxhash64("id").alias("h")))
    slots = _slots(n, 1 << 21)
    mask = repeated_filter(hashed, "h", slots)
    seen = spark.range(n).select("id", F.xxhash64("id").alias("h")).withColumn("slot", F.pmod("h", F.lit(slots))).withColumn("bits", _bits("h"))
    hit = seen.join(mask, "slot").where("forall(bits, b -> (shiftright(mask, b) & 1) = 1)")
    assert hit.where("id < 50").count() == 50 and hit.count() < 50 + 0.05 * n


def test_clashing_names_empty_and_columns(docs_df):
    df = docs_df([(1, "a"), (2, "a"), (3, "b")]).withColumns({"kept": F.lit("x"), "row": F.lit(1), "h": F.lit(2), "key": F.lit(3), "keep_id": F.lit("y")})
    out = exact_dedup(df)
    assert sorted(out.columns) == sorted([*df.columns, "group_size", "text_sha256"])
    assert sorted((r["doc_id"], r["keep_id"], r["kept"], r["h"]) for r in out.collect()) == [(1, 2, False, 2), (2, 2, True, 2), (3, 3, True, 2)]
    stay = drop_repeats(df)
    assert stay.columns == df.columns and sorted((r["doc_id"], r["kept"]) for r in stay.collect()) == [(2, "x"), (3, "x")]
    assert exact_dedup(docs_df([])).count() == 0 and drop_repeats(docs_df([])).count() == 0
