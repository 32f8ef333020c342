"""The sliced paths must equal the plain windows, with one key holding most rows."""

import random

import pytest

from pyspark.sql import functions as F
from seatward.operators import ordered


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(3)
    rows = [(None if i % 50 == 0 else ("hot" if rnd.random() < 0.7 else f"k{rnd.randrange(9)}"), rnd.randrange(60), i, rnd.randrange(5))
            for i in range(1500)]
    return spark.createDataFrame(rows, "k string, t int, id long, v long").cache()


def same(a, b):
    assert a.columns == b.columns
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_rank(skewed):
    same(ordered.rank_rows(skewed, ["k"], ["t", "id"]), ordered.rank_rows(skewed, ["k"], ["t", "id"], max_group_rows=100))


def test_running_sum(skewed):
    plain = ordered.running_sum(skewed, ["k"], ["t", "id"], "v", "s")
    same(plain, ordered.running_sum(skewed, ["k"], ["t", "id"], "v", "s", max_group_rows=100))


def test_count_up_to(skewed):
    same(ordered.count_up_to(skewed, ["k"], "t"), ordered.count_up_to(skewed, ["k"], "t", max_group_rows=30))


@pytest.mark.parametrize("where", [None, "v = 0"])
def test_previous(skewed, where):
    where = None if where is None else F.expr(where)
    plain = ordered.previous_values(skewed, ["k"], ["t", "id"], ["id", "v"], where=where)
    same(plain, ordered.previous_values(skewed, ["k"], ["t", "id"], ["id", "v"], where=where, max_group_rows=100))


def test_slices_are_bounded(skewed):
    _, total = ordered.group_sizes(skewed, ["k"])
    sliced = ordered.slice_by_range(skewed, ["k"], ["t", "id"], 100, total)
    assert sliced.groupBy(ordered.SLICE).count().agg(F.max("count")).first()[0] <= 300
