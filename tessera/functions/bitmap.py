"""Selection bitmaps: one bit a row, 32 to a word, words grouped by batch.

A bitmap is a table (batch_id, word_id, word) without words of 0. Words hold 32
bits in a BIGINT, so no shift reaches the sign.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 32
_ALL = (1 << WORD) - 1
KEYS = ["batch_id", "word_id"]


def from_positions(df: DataFrame, batch: Column, position: Column) -> DataFrame:
    """The bitmap of rows' positions within their batches."""
    rows = df.select(batch.alias("batch_id"), position.cast("long").alias("pos"))
    word = F.bit_or(F.expr(f"shiftleft(1L, CAST(pos % {WORD} AS INT))"))
    return rows.groupBy("batch_id", F.expr(f"pos div {WORD}").alias("word_id")).agg(word.alias("word"))


def positions(bitmap: DataFrame) -> DataFrame:
    """batch_id, pos of each set bit."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.getbit(F.col("word"), b) == 1)
    return bitmap.select("batch_id", "word_id", F.explode(bits).alias("bit")).select("batch_id", (F.col("word_id") * WORD + F.col("bit")).alias("pos"))


def popcount(bitmap: DataFrame) -> DataFrame:
    """batch_id, n: set bits."""
    return bitmap.groupBy("batch_id").agg(F.sum(F.bit_count("word").cast("long")).alias("n"))


def _joined(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    return a.join(b.withColumnRenamed("word", "other"), KEYS, how)


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    out = _joined(a, b, "inner").select(*KEYS, F.col("word").bitwiseAND(F.col("other")).alias("word"))
    return out.filter("word <> 0")


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return _joined(a, b, "full").select(*KEYS, F.coalesce("word", zero).bitwiseOR(F.coalesce("other", zero)).alias("word"))


def complement(bitmap: DataFrame, batches: DataFrame, bits: int) -> DataFrame:
    """All bits of the given batches (column batch_id) that are not set, up to ``bits`` in each."""
    frame = batches.select("batch_id").distinct().select("batch_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((bits - 1) // WORD).cast("long"))).alias("word_id"))
    last = (1 << ((bits - 1) % WORD + 1)) - 1
    mask = F.when(F.col("word_id") == (bits - 1) // WORD, F.lit(last)).otherwise(F.lit(_ALL)).cast("long")
    out = frame.join(bitmap, KEYS, "left").select(*KEYS, mask.bitwiseAND(F.bitwise_not(F.coalesce("word", F.lit(0).cast("long")))).alias("word"))
    return out.filter("word <> 0")


def all_set(batches: DataFrame, bits: int) -> DataFrame:
    """Every bit of the given batches."""
    return complement(batches.select("batch_id", F.lit(0).cast("long").alias("word_id"), F.lit(0).cast("long").alias("word")).limit(0), batches, bits)


def shifted(bitmap: DataFrame, by: int, bits: int) -> DataFrame:
    """All bits moved up (down, if negative); those that leave the ``bits`` of a batch are dropped.

    A word's bits land in at most two words, so no bit is unpacked.
    """
    if abs(by) >= bits:
        return bitmap.limit(0)
    whole, part = divmod(by, WORD)
    low = F.col("word").bitwiseAND(F.lit((1 << (WORD - part)) - 1).cast("long"))
    pieces = F.array(
        F.struct((F.col("word_id") + whole).alias("word_id"), F.shiftleft(low, part).alias("word")),
        F.struct((F.col("word_id") + whole + 1).alias("word_id"), F.shiftright("word", WORD - part).alias("word")),
    )
    moved = bitmap.select("batch_id", F.explode(pieces).alias("p")).select("batch_id", "p.word_id", "p.word")
    last, rest = (bits - 1) // WORD, (1 << ((bits - 1) % WORD + 1)) - 1
    kept = F.when(F.col("word_id") == last, F.col("word").bitwiseAND(F.lit(rest).cast("long"))).otherwise(F.col("word"))
    fits = moved.filter((F.col("word_id") >= 0) & (F.col("word_id") <= last)).withColumn("word", kept).filter("word <> 0")
    return fits.groupBy(*KEYS).agg(F.bit_or("word").alias("word"))


def with_bit(bitmap: DataFrame, batch_id: int, pos: int, on: bool = True) -> DataFrame:
    """The bitmap with one bit set or cleared."""
    one = bitmap.sparkSession.createDataFrame([(batch_id, pos // WORD, 1 << (pos % WORD))], "batch_id long, word_id long, word long")
    if on:
        return either(bitmap, one)
    cleared = _joined(bitmap, one, "left").select(*KEYS, F.col("word").bitwiseAND(F.bitwise_not(F.coalesce("other", F.lit(0).cast("long")))).alias("word"))
    return cleared.filter("word <> 0")


def has_bits(bitmap: DataFrame, bits: DataFrame) -> DataFrame:
    """batch_id, pos and is_set of each asked bit (batch_id, pos)."""
    asked = bits.select("batch_id", "pos", F.expr(f"pos div {WORD}").alias("word_id"))
    word = F.coalesce("word", F.lit(0).cast("long"))
    return asked.join(bitmap, KEYS, "left").select("batch_id", "pos", (F.getbit(word, (F.col("pos") % WORD).cast("int")) == 1).alias("is_set"))


def has_bit(bitmap: DataFrame, batch_id: int, pos: int) -> bool:
    word = bitmap.filter((F.col("batch_id") == batch_id) & (F.col("word_id") == pos // WORD)).select("word").first()
    return word is not None and bool(word.word >> (pos % WORD) & 1)
