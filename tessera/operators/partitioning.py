"""Key ranges as data: equi-width ranges, density histograms, and sizes that follow density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tessera.functions.numeric import adaptive_size

RANGE_SCHEMA = "part int, lo long, hi long"
#: A whole partition, in the unit of a bucket's share of one.
SHARE = 1_000_000


def key_span(df: DataFrame) -> tuple[int, int] | None:
    """Smallest and largest key; None without rows."""
    r = df.agg(F.min("key").alias("lo"), F.max("key").alias("hi")).first()
    return None if r.lo is None else (r.lo, r.hi)


def equi_width(key: Column, lo: int, hi: int, parts: int) -> Column:
    """The range of a key: all ranges are equally wide, and the last takes the remainder."""
    width = max(1, (hi - lo + 1) // parts)
    return F.least(F.call_function("div", key.cast("long") - F.lit(lo).cast("long"), F.lit(width).cast("long")), F.lit(parts - 1)).cast("int")


def range_partitions(df: DataFrame, threads: int) -> DataFrame:
    """part, n, total of the passing rows in each of up to four equi-width ranges a thread."""
    if (span := key_span(df)) is None:
        return df.sparkSession.createDataFrame([], "part int, n long, total long")
    parts = min(4 * threads, span[1] - span[0] + 1)
    return df.groupBy(equi_width(F.col("key"), *span, parts).alias("part")).agg(F.count("*").alias("n"), F.sum("val").alias("total"))


def density_histogram(df: DataFrame, threads: int, span: tuple[int, int] | None = None) -> DataFrame:
    """bucket, lo, hi (exclusive) and n of up to sixteen buckets a thread, empty ones too; ``span`` if it is known."""
    spark = df.sparkSession
    if (span := span or key_span(df)) is None:
        return spark.createDataFrame([], "bucket int, lo long, hi long, n long")
    lo, hi = span
    buckets = max(1, min(16 * threads, hi - lo + 1))
    width = max(1, (hi - lo + 1) // buckets)
    counts = df.groupBy(equi_width(F.col("key"), lo, hi, buckets).alias("bucket")).agg(F.count("*").alias("n"))
    frame = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    top = F.when(F.col("bucket") == buckets - 1, F.lit(hi + 1)).otherwise(F.lit(lo) + (F.col("bucket") + 1) * F.lit(width))
    return frame.join(counts, "bucket", "left").select("bucket", (F.lit(lo) + F.col("bucket") * F.lit(width)).cast("long").alias("lo"), top.cast("long").alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def _size(smallest: int, largest: int) -> Column:
    return adaptive_size(F.lit(largest), F.col("n"), F.col("hi") - F.col("lo"), smallest, largest)


def adaptive_sizes(histogram: DataFrame, smallest: int, largest: int) -> DataFrame:
    """bucket, n, keys and size: the number of keys that a partition around the bucket should hold."""
    return histogram.select("bucket", "n", (F.col("hi") - F.col("lo")).alias("keys"), _size(smallest, largest).alias("size"))


def adaptive_ranges(df: DataFrame, threads: int) -> list[Row]:
    """Key ranges (part, lo, hi exclusive): buckets dealt out by the sum of the shares of a partition that each fills.

    One pass finds the span of keys and one the histogram; the driver sees a row a
    bucket, at most sixteen a thread. Shares are whole millionths, so sums are exact.
    """
    if (span := key_span(df)) is None:
        return []
    n_keys = span[1] - span[0] + 1
    size = _size(max(n_keys // (8 * threads), 1), max(n_keys // threads, 1))
    buckets = density_histogram(df, threads, span).withColumn("share", F.call_function("div", (F.col("hi") - F.col("lo")) * SHARE, size)).orderBy("bucket").collect()
    spans: dict[int, list[int]] = {}
    before = 0
    for b in buckets:
        spans.setdefault(before // SHARE, [b.lo, b.hi])[1] = b.hi
        before += b.share
    return [Row(part=k, lo=lo, hi=hi) for k, (lo, hi) in enumerate(spans.values())]


def in_ranges(key: Column, ranges: list[Row]) -> Column:
    """The part of a key, by the ranges' lower ends."""
    ends = F.array(*[F.lit(r.lo) for r in ranges[1:]]) if len(ranges) > 1 else F.array().cast("array<bigint>")
    return F.size(F.filter(ends, lambda e: e <= key))


def adaptive_partitions(df: DataFrame, threads: int) -> DataFrame:
    """part, lo, hi, n, total of the passing rows in each adaptive range."""
    spark = df.sparkSession
    ranges = adaptive_ranges(df, threads)
    frame = spark.createDataFrame(ranges, RANGE_SCHEMA)
    if not ranges:
        return frame.selectExpr("part", "lo", "hi", "0L AS n", "0L AS total")
    sums = df.groupBy(in_ranges(F.col("key"), ranges).alias("part")).agg(F.count("*").alias("n"), F.sum("val").alias("total"))
    return frame.join(sums, "part", "left").select("part", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"), "total")
