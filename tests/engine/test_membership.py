"""Bloom filters of any size: those too large for a plan are dealt into segments."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import membership
from tessera.queries import QUERIES


def test_bloom_in_segments(spark, monkeypatch):
    monkeypatch.setattr(membership, "PLAN_WORDS", 10)
    monkeypatch.setattr(membership, "SEGMENT_WORDS", 64)
    shape = membership.BloomShape.of(20_000, 0.01)
    assert shape.segments > 50 and shape.segment_words <= 64 and shape.segments * shape.segment_words * membership.WORD >= shape.bits
    words = membership.bloom_build(spark.range(20_000), "id", shape)
    assert membership.bloom_value(words, shape) is None
    probes = spark.range(60_000).select("id", (F.col("id") * 2).alias("twice"))
    got = membership.with_maybe(probes, "id", words, shape)
    assert got.columns == ["id", "twice", "maybe"]
    rows = got.collect()
    assert sorted((r.id, r.twice) for r in rows) == [(i, 2 * i) for i in range(60_000)]
    assert all(r.maybe for r in rows if r.id < 20_000) and 0 < sum(r.maybe for r in rows if r.id >= 20_000) < 0.02 * 40_000
    assert not any(r.maybe for r in membership.with_maybe(spark.range(50), "id", words.limit(0), shape).collect())
    assert [r.maybe for r in membership.with_maybe(spark.createDataFrame([(None,), (5,)], "id long"), "id", words, shape).orderBy("id").collect()] == [False, True]


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """A folder of orders, of which each half has more keys than a plan's filter holds."""
    d = str(tmp_path_factory.mktemp("large"))
    status = F.when(F.col("id") % 2 == 0, "F").otherwise("O")
    spark.range(900_000).select(F.col("id").alias("o_orderkey"), status.alias("o_orderstatus")).write.parquet(f"{d}/orders.parquet")
    assert membership.BloomShape.of(450_000, 0.01).bits > membership.PLAN_WORDS * membership.WORD
    return d


def _orders(spark, folder, rows):
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string").write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_no_false_negatives_of_a_large_table(spark, large):
    assert [tuple(r) for r in QUERIES["bloom_no_false_negatives"](spark, large).collect()] == [(900_000, 0)]


def test_no_false_negatives_with_null_keys(spark, tmp_path):
    """NULL is a probe, as in SQL, but no key that could be missed."""
    d = _orders(spark, tmp_path, [(1, "F"), (None, "F"), (None, "O"), (7, None)])
    assert [tuple(r) for r in QUERIES["bloom_no_false_negatives"](spark, d).collect()] == [(4, 0)]


def test_false_positive_rate_of_a_large_table(spark, large):
    assert [tuple(r) for r in QUERIES["bloom_false_positive_rate"](spark, large).collect()] == [(True,)]


@pytest.mark.parametrize("rows", [[(1, "F"), (2, "F")], [(1, "O"), (2, "O")], [(1, None)], []])
def test_false_positive_rate_without_probes_or_keys(spark, tmp_path, rows):
    d = _orders(spark, tmp_path, rows)
    assert [tuple(r) for r in QUERIES["bloom_false_positive_rate"](spark, d).collect()] == [(True,)]
