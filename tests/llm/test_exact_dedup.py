import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup as ed

DATA = [
    (4, "a  b"), (2, "a\tb"), (9, "a b "), (7, None), (5, ""), (6, " "), (1, "\x0b\n"), (None, "a b"), (None, "null only"), (None, "null only"), (2, "a b"), (3, "a\xa0b"),
    (10, "word. " * 40_000), (11, "word.\n" * 40_000), (12, "word. " * 39_999 + "Word. "), (13, "x" * 9000), (14, "x" * 9001), (15, "x" * 9000), (16, "東京 " * 500), (17, "東京  " * 500),
]


def brute(data):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in data]
    out = []
    for (d, _), n in zip(data, norm):
        same = [x for (x, _), m in zip(data, norm) if m == n]
        keep = min((x for x in same if x is not None), default=None)
        out.append((d, keep, len(same), d == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("buckets", [None, 1, 3, 50])
def test_same_as_brute_force(spark, buckets):
    """With few buckets chunk hashes collide; the result is the same."""
    hashed = ed.chunk_hashes if buckets is None else lambda c: F.struct(F.pmod(F.xxhash64(c), F.lit(buckets)).alias("h"))
    df = spark.createDataFrame([(*r, 1) for r in DATA], "doc_id long, text string, recipe int").repartition(3)
    assert sorted((tuple(r) for r in ed.exact_dedup(df, identify=hashed).collect()), key=str) == brute(DATA)


def test_order_of_clashing_chunks_counts(spark):
    """Texts of the same colliding chunks in another order, or one of them twice, are different."""
    a, b = ("a" * 200 + ". "), ("b" * 200 + ". ")
    data = [(1, a + b), (2, b + a), (3, a + b), (4, a + a), (5, b + b), (6, a + a)]
    got = ed.exact_dedup(spark.createDataFrame(data, "doc_id long, text string"), identify=lambda c: F.struct(F.lit(1).alias("h"))).collect()
    assert {r.doc_id: r.keep_id for r in got} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 4}


def test_hashes_are_independent(spark):
    """The second hash is no function of the first: neither is the other's seed."""
    r = spark.createDataFrame([("x",)], "c string").select(ed.chunk_hashes(F.col("c")).alias("h"), F.xxhash64("c", F.lit(ed.SEEDS[1])).alias("chained")).first()
    assert len({r.h.h0, r.h.h1, r.chained}) == 3


def test_chunks_are_the_text(spark):
    df = spark.createDataFrame(DATA, "doc_id long, text string").select(ed.normalised(F.col("text")).alias("n")).select("n", ed.chunks(F.col("n")).alias("c"))
    for r in df.collect():
        assert "".join(r.c) == r.n and all(len(c) <= 4200 for c in r.c)
    assert ed.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
