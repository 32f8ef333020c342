"""Payer imports: files of one arrival are one batch, and many batches are one step."""

import random

from pyspark.sql import functions as F

from seatward.operators.writes import upsert_payers, upsert_payers_batches
from seatward.plans import QUERIES


def test_import_of_a_table_in_many_files(spark, tmp_path):
    """Rows of a batch that share a transaction or an e-mail meet, whatever file they are in."""
    customers = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    found = []
    for files in (1, 7):
        customers.repartition(files, F.col("c_custkey") % 7).write.parquet(f"{tmp_path}/{files}/customer.parquet")
        rows = QUERIES["payers_import_stream"](spark, f"{tmp_path}/{files}").collect()
        found.append(sorted(map(str, rows)))
    assert found[0] == found[1]


def test_many_batches_equal_one_after_the_other(spark):
    rng = random.Random(5)
    schema = "id long, email string, transaction_id string"
    some = lambda prefix, n: None if rng.random() < 0.15 else f"{prefix}{rng.randrange(n)}"
    base = spark.createDataFrame([(-i, f" U{i}@x", f"t{i}") for i in range(10)], schema)
    batches = [[(100 * k + i, some("u", 12), some("t", 12)) for i in range(9)] for k in range(6)]
    want = base
    for rows in batches:
        want = upsert_payers(want, spark.createDataFrame(rows, schema)).localCheckpoint()
    together = spark.createDataFrame([(*r, k) for k, rows in enumerate(batches) for r in rows], schema + ", batch long")
    got = upsert_payers_batches(base, together, "batch")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
