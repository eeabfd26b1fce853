"""Membership: Bloom filters that are probed where rows are read, and IN with lists of any length."""

from __future__ import annotations

import functools
import math
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words (of 32 bits) of a filter that a plan may carry, of 8 bytes each: enough for some 400,000 keys at one false positive in a hundred.
PLAN_WORDS = 125_000
#: Words at most of a segment of a larger filter: 8 KB, so that segments are many and even.
SEGMENT_WORDS = 1024
#: Literals in a predicate; longer lists become a table.
LITERALS = 1000
WORD = 32


@dataclass(frozen=True)
class BloomShape:
    """Bits and hashes for so many keys at a false positive rate. A filter too large for a plan is dealt into equal
    segments, and all bits of a key lie in one of them."""

    bits: int
    hashes: int

    @classmethod
    def of(cls, keys: int, rate: float) -> BloomShape:
        keys, rate = max(1, keys), min(0.999, max(1e-9, rate))
        bits = -(-math.ceil(-keys * math.log(rate) / math.log(2) ** 2) // 64) * 64
        return cls(bits, max(1, round(bits / keys * math.log(2))))

    @property
    def segments(self) -> int:
        words = -(-self.bits // WORD)
        return 1 if words <= PLAN_WORDS else -(-words // SEGMENT_WORDS)

    @property
    def segment_words(self) -> int:
        return -(-self.bits // (self.segments * WORD))

    def segment(self, key: Column) -> Column:
        """The segment of a key."""
        return F.pmod(F.xxhash64(F.lit(2), key), F.lit(self.segments).cast("long"))

    def places(self, key: Column) -> list[Column]:
        """The bits of a key in its segment, by double hashing."""
        one, two, bits = F.xxhash64(key), F.xxhash64(F.lit(1), key), F.lit(self.bits if self.segments == 1 else self.segment_words * WORD)
        return [F.pmod(F.pmod(one, bits) + F.lit(i) * F.pmod(two, bits), bits) for i in range(self.hashes)]


def bloom_build(df: DataFrame, key: str, shape: BloomShape) -> DataFrame:
    """word_id, word: the filter's words that are not 0."""
    first = shape.segment(F.col(key)) * F.lit(shape.segment_words * WORD) if shape.segments > 1 else F.lit(0)
    bit = df.select(F.explode(F.array(*(first + p for p in shape.places(F.col(key))))).alias("bit"))
    return bit.groupBy(F.expr(f"bit div {WORD}").alias("word_id")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(bit % {WORD} AS INT))")).alias("word"))


def bloom_value(words: DataFrame, shape: BloomShape) -> Column | None:
    """All words of a filter as one value that an expression may use; None if there are too many for a plan."""
    return bloom_segments(words, shape).select("bloom_words").scalar() if shape.segments == 1 else None


def bloom_segments(words: DataFrame, shape: BloomShape) -> DataFrame:
    """bloom_segment, bloom_words: all words of each segment, in order."""
    n = shape.segment_words
    every = words.sparkSession.range(shape.segments * n).withColumnRenamed("id", "word_id").join(words, "word_id", "left")
    word = F.struct("word_id", F.coalesce("word", F.lit(0).cast("long")).alias("word"))
    rows = every.groupBy(F.expr(f"word_id div {n}").alias("bloom_segment")).agg(F.sort_array(F.collect_list(word)).alias("rows"))
    return rows.select("bloom_segment", F.transform("rows", lambda r: r["word"]).alias("bloom_words"))


def with_maybe(df: DataFrame, key: str, words: DataFrame, shape: BloomShape) -> DataFrame:
    """``df`` and maybe, by ``maybe_in``, for a filter of any size: as a value in the plan, or else rows meet the segment of their key."""
    value = bloom_value(words, shape)
    if value is not None:
        return df.withColumn("maybe", maybe_in(F.col(key), value, shape))
    rows = df.withColumn("bloom_segment", shape.segment(F.col(key))).join(bloom_segments(words, shape), "bloom_segment", "left")
    return rows.withColumn("maybe", maybe_in(F.col(key), F.col("bloom_words"), shape)).drop("bloom_segment", "bloom_words")


def maybe_in(key: Column, value: Column, shape: BloomShape) -> Column:
    """Whether a filter may hold a key, by the words of its segment: false means certainly absent. NULL is absent."""
    is_set = lambda p: F.getbit(F.get(value, F.call_function("div", p, F.lit(WORD)).cast("int")), (p % WORD).cast("int")) == 1
    return functools.reduce(operator.and_, map(is_set, shape.places(key)), key.isNotNull())


def bloom_semi_join(df: DataFrame, keys: DataFrame, key: str, rate: float = 0.01) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys``, exactly. A filter drops most others where they are read, before they
    are shuffled; if it would be too large for a plan, the semi-join goes without."""
    shape = BloomShape.of(keys.count(), rate)
    value = bloom_value(bloom_build(keys, key, shape), shape) if -(-shape.bits // WORD) <= PLAN_WORDS else None
    rows = df if value is None else df.filter(maybe_in(F.col(key), value, shape))
    return rows.join(keys.select(key), key, "left_semi")


def in_list(df: DataFrame, column: str, values: list[int]) -> DataFrame:
    """Rows whose column is in the list: literals (a hash set when long), or a semi-join for very long lists."""
    if len(values) <= LITERALS:
        return df.filter(F.col(column).isin(values))
    rows = df.sparkSession.createDataFrame([(v,) for v in sorted(set(values))], "v long")
    return df.join(rows, F.col(column) == F.col("v"), "left_semi")
