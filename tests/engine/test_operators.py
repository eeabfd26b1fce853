import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.functions import bitmap, numeric
from tessera.operators import aggregate as agg
from tessera.operators import joins, membership, partitioning, profile
from tessera.sources.synthetic import SyntheticTable
from tessera.streaming.pipeline import stream_sum

CASES = [(10_000, 10, 0, 100, 50, 42), (200_000, 100, 0, 1000, 500, 42), (50_000, 50, 0, 100, 10, 123), (50_000, 50, 0, 100, 95, 456), (10_000, 10, 0, 100, 1000, 789), (10_000, 10, -100, 100, -200, 999), (10_000, 1, 0, 100, 50, 111), (12_345, 37, 0, 100, 50, 777)]


@pytest.mark.parametrize("rows,keys,low,high,limit,seed", CASES)
def test_plans_agree(spark, rows, keys, low, high, limit, seed):
    df = SyntheticTable(rows, keys, low, high, seed).read(spark).select("key", "val")
    want = defaultdict(int)
    for r in df.collect():
        assert 0 <= r.key < keys and low <= r.val < high
        if r.val > limit:
            want[r.key] += r.val
    parts = agg.partial_sums(df, F.col("val") % 7, limit)
    for plan in (agg.threshold_sum(df, limit), agg.range_partitioned_sum(df, limit, 16), agg.adaptive_sum(df, limit), agg.merge_partials(parts), agg.selected_sum(df, F.col("val") > limit)):
        got = plan.collect()
        assert {r.key: r.total for r in got} == want and len(got) == len(want)


def test_generator_ignores_partitioning(spark):
    t = SyntheticTable(rows=1000, seed=5)
    one = sorted(map(tuple, t.read(spark).collect()))
    assert one == sorted(map(tuple, t.read(spark).repartition(7).collect()))
    assert one != sorted(map(tuple, SyntheticTable(rows=1000, seed=6).read(spark).collect()))


@pytest.mark.parametrize("dealt", [lambda df: agg.range_partitioned_sum(df, 5, 8), lambda df: agg.adaptive_sum(df, 5)])
def test_no_raw_row_is_exchanged(spark, dealt):
    """Below every exchange rows are summed, so a key that all rows share moves as a row a task."""
    df = spark.range(0, 1000, 1, 4).select(F.lit(7).alias("key"), F.col("id").alias("val"))
    out = dealt(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    lowest = plan[plan.rindex("Exchange ") :]
    assert "partial_sum" in lowest
    assert [tuple(r) for r in out.collect()] == [(7, sum(range(6, 1000)))]


def test_ranges_are_dealt_by_range(spark):
    df = spark.range(1000).select((F.col("id") % 50).alias("key"), F.col("id").alias("val"))
    rows = agg.range_partitioned_sum(df, 5, 8).select("key", F.spark_partition_id().alias("p")).collect()
    assert [r.key for r in sorted(rows, key=lambda r: (r.p, r.key))] == list(range(50))


def test_filter_and_columns_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id AS key", "id * 2 AS val", "id AS other").write.parquet(f"{tmp_path}/t")
    plan = agg.threshold_sum(spark.read.parquet(f"{tmp_path}/t"), 50)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(val,50)" in plan and "other" not in plan


def test_overflow_raises(spark):
    df = spark.createDataFrame([(1, 2**63 - 1), (1, 1)], "key long, val long")
    with pytest.raises(Exception, match="OVERFLOW"):
        agg.threshold_sum(df, 0).collect()


@pytest.mark.parametrize("left,right", [([], []), ([(1, 1)], []), ([], [(1, 1)]), ([(1, 10), (2, 20), (3, 30)], [(2, 200), (3, 300), (4, 400)]), ([(1, 1), (1, 2), (2, 3), (2, 4), (2, 5)], [(1, 6), (1, 7), (2, 8), (2, 9)]), ([(None, 1), (5, 2)], [(None, 3), (5, 4)])])
def test_joins(spark, left, right):
    a, b = (spark.createDataFrame(x, "key long, payload long") for x in (left, right))
    inner = sorted((k, p, q) for k, p in left for j, q in right if k == j and k is not None)
    assert sorted(map(tuple, joins.inner_join(a, b).collect())) == inner
    outer = inner + [(k, p, None) for k, p in left if k is None or k not in {j for j, _ in right}]
    assert sorted(map(tuple, joins.left_outer_join(a, b).collect()), key=str) == sorted(outer, key=str)


def test_bitmaps(spark):
    r = random.Random(2)
    bits = 200
    sets = [{(b, r.randrange(bits)) for b in range(3) for _ in range(60)} | {(0, 0), (0, 31), (0, 32), (1, 63), (1, 64), (2, 199)} for _ in range(2)]
    df = [spark.createDataFrame(sorted(s), "b long, pos long") for s in sets]
    maps = [bitmap.from_positions(x, F.col("b"), F.col("pos")).cache() for x in df]
    back = lambda m: {tuple(x) for x in bitmap.positions(m).collect()}
    assert [back(m) for m in maps] == sets
    assert back(bitmap.both(*maps)) == sets[0] & sets[1] and back(bitmap.either(*maps)) == sets[0] | sets[1]
    batches = spark.createDataFrame([(b,) for b in range(3)], "batch_id long")
    every = {(b, k) for b in range(3) for k in range(bits)}
    assert back(bitmap.complement(maps[0], batches, bits)) == every - sets[0] and back(bitmap.all_set(batches, bits)) == every
    for by in (0, 1, 5, 31, 32, 63, 64, 100, 199, 200, 300, -1, -32, -63, -100, -200):
        assert back(bitmap.shifted(maps[0], by, bits)) == {(b, k + by) for b, k in sets[0] if 0 <= k + by < bits}, by
    assert {x.batch_id: x.n for x in bitmap.popcount(maps[0]).collect()} == {b: sum(c == b for c, _ in sets[0]) for b in range(3)}
    assert back(bitmap.with_bit(maps[0], 1, 150)) == sets[0] | {(1, 150)} and back(bitmap.with_bit(maps[0], 0, 31, on=False)) == sets[0] - {(0, 31)}
    assert bitmap.has_bit(maps[0], 0, 32) and not bitmap.has_bit(bitmap.with_bit(maps[0], 0, 32, on=False), 0, 32)


def test_bloom(spark):
    shape = membership.BloomShape.of(1000, 0.01)
    assert shape.bits % 64 == 0 and 9585 <= shape.bits < 9700 and shape.hashes == 7
    words = membership.bloom_build(spark.range(1000), "id", shape)
    maybe = lambda df, words: [r.m for r in df.select(membership.maybe_in(F.col("id"), membership.bloom_value(words, shape), shape).alias("m")).collect()]
    inside, outside = maybe(spark.range(1000), words), maybe(spark.range(100_000, 101_000), words)
    assert len(inside) == 1000 and all(inside) and sum(outside) < 50
    assert not any(maybe(spark.range(50), words.limit(0)))
    assert maybe(spark.createDataFrame([(None,)], "id long"), words) == [False]
    assert {r.id for r in membership.in_list(spark.range(5000), "id", list(range(0, 9000, 3))).collect()} == set(range(0, 5000, 3))


@pytest.mark.parametrize("words", [membership.PLAN_WORDS, 10])
def test_bloom_semi_join(spark, monkeypatch, words):
    """With a filter, probed before any exchange, and without one that would be too large."""
    monkeypatch.setattr(membership, "PLAN_WORDS", words)
    df = spark.range(3000).select((F.col("id") % 1500).alias("k"), "id")
    keys = spark.range(0, 9000, 7).select(F.col("id").alias("k"))
    got = membership.bloom_semi_join(df, keys, "k")
    assert sorted(r.id for r in got.collect()) == [i for i in range(3000) if i % 1500 % 7 == 0]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("scalar-subquery" in plan) == (words > 10)
    assert membership.bloom_semi_join(df, keys.limit(0), "k").collect() == []


def test_adaptive_size_formula(spark):
    cases = [(0, 0), (80, 10), (10, 10), (45, 10), (79, 10), (11, 10), (1, 100)]
    df = spark.createDataFrame(cases, "r long, k long").select("r", "k", numeric.adaptive_size(F.lit(99), F.col("r"), F.col("k"), 2, 12).alias("s"))
    assert [x.s for x in df.collect()] == [99, 2, 12, 7, 2, 12, 12]


def test_ranges(spark):
    r = random.Random(1)
    rows = [(r.choice([r.randrange(50), r.randrange(1000)]), r.randrange(100)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "key long, val long")
    parts = partitioning.adaptive_partitions(df, 4).orderBy("part").collect()
    assert parts[0].lo == min(k for k, _ in rows) and parts[-1].hi == max(k for k, _ in rows) + 1
    assert all(a.hi == b.lo and a.lo < a.hi for a, b in zip(parts, parts[1:]))
    for x in parts:
        own = [v for k, v in rows if x.lo <= k < x.hi]
        assert (x.n, x.total or 0) == (len(own), sum(own))
    assert sum(x.n for x in partitioning.density_histogram(df, 4).collect()) == 3000
    assert sum(x.n for x in partitioning.range_partitions(df, 4).collect()) == 3000
    for f in (partitioning.range_partitions, partitioning.density_histogram, partitioning.adaptive_partitions):
        assert f(df.limit(0), 4).collect() == []
    wide = spark.createDataFrame([(2**53 + 1, 1), (0, 1), (2**53, 1)], "key long, val long")
    assert [r.b for r in wide.select(partitioning.equi_width(F.col("key"), 0, 2**53 + 1, 2**30).alias("b")).collect()] == [min(k // ((2**53 + 2) // 2**30), 2**30 - 1) for k in (2**53 + 1, 0, 2**53)]
    one = df.limit(1)
    assert [x.n for x in partitioning.adaptive_partitions(one, 4).collect()] == [1]


def test_stream(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    df.repartition(3).write.parquet(f"{tmp_path}/t")
    df.limit(0).coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
    got = {r.key: r.total for r in stream_sum(spark, f"{tmp_path}/t", F.col("k"), F.col("v"), 500).collect()}
    assert got == {k: sum(v for v in range(501, 1000) if v % 7 == k) for k in range(7)}


def test_measurement(spark):
    t = profile.Latencies()
    for ns in range(1000):
        t.record("scan", ns)
    assert (t.percentile("scan", 0.5), t.percentile("scan", 0.99), t.percentile("scan", 1.0), len(t)) == (499, 989, 999, 1000)
    assert t.markdown("x")[0].startswith("| x | scan | 499 | 989 |") and "100.0%" in t.summary()
    with t.measure("other"):
        pass
    t.reset()
    assert len(t) == 0 and t.summary() == "" and t.percentile("scan", 0.5) == 0
    r = profile.latency_report(spark.range(1000), "id").first()
    assert (r.n, r.p50, r.p99, r.max) == (1000, 499, 989, 999)
    before = profile.Environment.now()
    assert profile.Environment.now().voluntary >= before.voluntary
    rows, watch = profile.observed(spark.range(10), "w", n=F.count("*"))
    assert len(rows.collect()) == 10 and watch.get["n"] == 10


def test_approximate_latencies(spark):
    r = profile.latency_report(spark.range(100_000), "id", accuracy=1000).first()
    assert r.n == 100_000 and r.max == 99_999 and abs(r.p50 - 50_000) <= 100 and abs(r.p99 - 99_000) <= 100


def test_report(spark):
    from tessera.report import run

    lines = run(spark, rows=20_000, keys=12, threshold=500, repeats=1)
    assert len(lines) == 5 and lines[1].startswith("two-phase: passed ") and "of 20000, 12 groups" in lines[1] and lines[-1].startswith("largest sums: ")


def test_work_folder(spark, monkeypatch):
    """A folder that is set is used; without one a single machine takes a temporary one, and a cluster raises an error."""
    from types import SimpleNamespace

    from tessera.sources.tables import work_folder

    def session(master, folder=None):
        kept = {"spark.checkpoint.dir": folder} if folder else {}
        conf = SimpleNamespace(get=lambda k, d=None: kept.get(k, d), set=kept.__setitem__)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))

    assert work_folder(session("spark://x:1", "hdfs://y/z/")) == "hdfs://y/z"
    assert work_folder(session("local[4]")).startswith("/")
    for master in ("spark://x:1", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            work_folder(session(master))
