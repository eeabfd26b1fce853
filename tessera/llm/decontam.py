"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A seed is a fixed mask of word positions: the hash of the words under the mask,
whatever stands in between, so a passage still meets its benchmark item after
words were substituted. Every word position of every document gives one hash
for each mask; a join with the hashes of the benchmark finds hits, and each
hit is verified on the spot: on its diagonal, some window of ``WINDOW`` item
words that holds the seed must agree in at least ``SIMILARITY`` of its words.

Every item, however short, is also searched for as a whole, in pieces of which one is
free of substitutions wherever they fall, and held if ``SIMILARITY`` of all its words
agree; an item of up to four words is one piece.

The benchmark side of the join carries the item's words around each seed. It is
counted, and beyond ``SEEDS`` rows the items are taken in blocks, one pass over the
documents each, so what is broadcast is bounded and documents never shuffle.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import unused

#: Word positions under each mask (a substitution in every fifth word leaves hits of each).
MASKS = ((0, 1, 3, 5, 6, 8), (0, 2, 4, 5, 7, 9), (0, 1, 2, 5, 6, 7))
SHORTEST = 1 + min(max(m) for m in MASKS)
WINDOW = 13
SIMILARITY = 0.8
#: Words of a piece of an item, one more of which than words may differ.
PIECES = (1, 2, 3, 4, 5)
#: Broadcast rows, of about 250 bytes each.
SEEDS = 200_000
#: Words beside a seed's first word that windows can reach.
BEFORE = WINDOW - 1 - max(MASKS[2])
AROUND = BEFORE + WINDOW


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text: runs of letters and digits, in lower case."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def seed_keys(h: Column, i: Column) -> list[Column]:
    """The hash under each mask at position i.

    Near a text's end a mask may not fit; its hash is then one of fewer words, which the benchmark does not hold.
    """
    return [F.xxhash64(F.lit(k), *[F.get(h, i + o) for o in mask]) for k, mask in enumerate(MASKS)]


def positions(df: DataFrame, least: int) -> DataFrame:
    """A row for each position of h that has ``least`` words from it on."""
    n = F.size("h") - least
    rows = df.select("*", F.explode_outer(F.when(n >= 0, F.sequence(F.lit(0), n))).alias("i"))  # outer: no filter that would compute h twice
    return rows.filter("i IS NOT NULL")


def item_words(benchmark: DataFrame) -> DataFrame:
    """item_id and h, the hashes of the item's words, of each different item that has a word."""
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_hashes(F.col("text")).alias("h")).filter(F.size("h") > 0).distinct()


def benchmark_seeds(benchmark: DataFrame) -> DataFrame:
    """key, item_id, and around: the item's words from BEFORE words before the seed on."""
    rows = positions(item_words(benchmark), SHORTEST)
    n, i = F.size("h"), F.col("i")
    masked = [F.when(n - i > max(mask), key) for mask, key in zip(MASKS, seed_keys(F.col("h"), i), strict=True)]
    around = F.array(*[F.when(i + k >= 0, F.get("h", i + k)) for k in range(-BEFORE, WINDOW)])
    seeds = rows.select("item_id", n.alias("n"), around.alias("around"), F.explode(F.array(*masked)).alias("key"))
    return seeds.filter("key IS NOT NULL")


def agreeing_words(h: Column, i: Column, around: Column) -> Column:
    """A bit for each word near the seed, lowest first, that agrees on the diagonal of document word i."""
    bits = [F.when(F.get(h, i + k) == F.get(around, F.lit(k + BEFORE)), 1 << (k + BEFORE)).otherwise(0) for k in range(-BEFORE, WINDOW)]
    return functools.reduce(lambda x, y: x + y, bits)


def most_in_a_window(bits: Column) -> Column:
    """The most bits in WINDOW neighbours that hold the seed.

    Words beyond the item's ends never agree, and of a window that reaches
    beyond them a shifted one holds all words, so such windows do no harm.
    """
    return F.greatest(*[F.bit_count(F.shiftright(bits, s).bitwiseAND(F.lit((1 << WINDOW) - 1))) for s in range(BEFORE + 1)])


def _passages(read: DataFrame, benchmark: DataFrame, names: list[str], seeds_at_once: int) -> DataFrame:
    """The columns ``names`` of ``read``, item_id, n_hits and agreeing; ``read`` has its words' hashes in h."""
    seeds = benchmark_seeds(benchmark)
    at = positions(read, SHORTEST).select(*names, "h", "i", F.explode(F.array(*seed_keys(F.col("h"), F.col("i")))).alias("key"))
    blocks = max(1, math.ceil(seeds.count() / seeds_at_once))
    found = []
    for b in range(blocks):
        own = seeds.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b) if blocks > 1 else seeds
        hits = at.join(F.broadcast(own.select("key", "item_id", "n", "around")), "key")
        found.append(hits.select(*names, "item_id", "n", agreeing_words(F.col("h"), F.col("i"), F.col("around")).alias("bits")))
    # no filter before the sums: within the join it would make Spark copy h to every position
    hits = functools.reduce(DataFrame.unionByName, found).select(*names, "item_id", "n", most_in_a_window(F.col("bits")).alias("same"))
    enough = F.col("same") >= F.ceil(F.least(F.lit(WINDOW), F.col("n")) * SIMILARITY)
    sums = hits.groupBy(*names, "item_id").agg(F.sum(F.when(enough, 1).otherwise(0)).alias("n_hits"), F.max(F.when(enough, F.col("same"))).cast("int").alias("agreeing"))
    return sums.filter("n_hits > 0")


def item_pieces(benchmark: DataFrame) -> DataFrame:
    """item, item_id, words (of the whole item), n, start, size and key of each piece of each item.

    Of n words, n div 5 may differ; of one piece more than that, one holds no
    difference wherever they fall. Pieces have 1 to 5 words.
    """
    items = item_words(benchmark).select(F.xxhash64("item_id", "h").alias("item"), "item_id", F.col("h").alias("words"), F.size("h").alias("n"))
    cut = items.select("*", F.explode(F.sequence(F.lit(0), F.expr("n div 5").cast("int"))).alias("k"))
    cut = cut.withColumn("start", F.expr("k * n div (n div 5 + 1)").cast("int")).withColumn("size", F.expr("(k + 1) * n div (n div 5 + 1)").cast("int") - F.col("start"))
    return cut.select("item", "item_id", "words", "n", "start", "size", F.coalesce(*[F.when(F.col("size") == size, run_key(F.col("words"), F.col("start"), size)) for size in PIECES]).alias("key"))


def run_key(h: Column, i: Column, size: int) -> Column:
    """The hash of ``size`` words from i on."""
    return F.xxhash64(F.lit(size), *[F.get(h, i + o) for o in range(size)])


def _whole_items(read: DataFrame, benchmark: DataFrame, names: list[str], seeds_at_once: int) -> DataFrame:
    """``names``, item_id, n_hits and agreeing where SIMILARITY of an item's words agree on one diagonal, wherever the others stand."""
    pieces = item_pieces(benchmark)
    counts = {r["size"]: r.n for r in pieces.groupBy("size").agg(F.count("*").alias("n")).collect()}  # of five sizes at most
    sizes = sorted(counts) or [PIECES[0]]
    at = positions(read, sizes[0]).select(*names, "h", "i", F.explode(F.array(*[run_key(F.col("h"), F.col("i"), size) for size in sizes])).alias("key"))
    blocks = max(1, math.ceil(sum(counts.values()) / seeds_at_once))
    found = []
    for b in range(blocks):
        own = pieces.filter(F.pmod("item", F.lit(blocks)) == b) if blocks > 1 else pieces
        hits = at.join(F.broadcast(own.select("key", "item", "start")), "key").join(F.broadcast(own.select("item", "item_id", "words", "n").distinct()), "item")
        first = F.col("i") - F.col("start")
        same = F.size(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda x: F.get(F.col("h"), first + x) == F.get(F.col("words"), x)))
        found.append(hits.select(*names, "item_id", "n", same.alias("same")))
    enough = F.col("same") * 5 >= F.col("n") * 4
    hits = functools.reduce(DataFrame.unionByName, found)
    sums = hits.groupBy(*names, "item_id").agg(F.sum(F.when(enough, 1).otherwise(0)).alias("n_hits"), F.max(F.when(enough, F.col("same"))).alias("agreeing"))
    return sums.filter("n_hits > 0")


def leaks(docs: DataFrame, benchmark: DataFrame, seeds_at_once: int = SEEDS) -> DataFrame:
    """doc_id, item_id, n_hits and agreeing, one row for each document and item that share a passage or the whole item.

    A passage is shared if a window of WINDOW item words, or of all words of a shorter
    item, agrees in SIMILARITY of them, found by a seed that fits the item; ``n_hits`` then counts
    verified seeds and ``agreeing`` is the most words that agree in a window. An
    item without such a passage is held if SIMILARITY of all its words agree on one
    diagonal; ``n_hits`` then counts its pieces there and ``agreeing`` its words.

    Null and empty texts have no words, and items without words are in no document.
    Null ids are reported as null, rows of one id together; repeated items count
    once. A text of any length is searched as a whole, on one task. Empty tables give no
    rows. Further columns are ignored, whatever their names.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_hashes(F.col("text")).alias("h"))
    passages = _passages(read, benchmark, ["doc_id"], seeds_at_once)
    items = _whole_items(read, benchmark, ["doc_id"], seeds_at_once)
    both = passages.withColumn("rank", F.lit(0)).unionByName(items.withColumn("rank", F.lit(1)))
    first = both.groupBy("doc_id", "item_id").agg(F.min_by(F.struct("n_hits", "agreeing"), "rank").alias("f"))
    return first.select("doc_id", "item_id", "f.n_hits", "f.agreeing")


def without_leaks(docs: DataFrame, benchmark: DataFrame, seeds_at_once: int = SEEDS) -> DataFrame:
    """The rows of ``docs`` that ``leaks`` has nothing against, all columns as they were.

    A row is its doc_id and its text, so what another row of the id holds, or of none,
    doesn't matter; repeated rows go together. Null and empty texts stay. With an empty
    benchmark all rows stay; an empty table stays empty.
    """
    name, text = unused(docs, "bad_id"), unused(docs, "bad_text")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), word_hashes(F.col("text")).alias("h"))
    found = [find(read, benchmark, ["doc_id", "tag"], seeds_at_once).select("doc_id", "tag") for find in (_passages, _whole_items)]
    bad = found[0].unionByName(found[1]).select(F.col("doc_id").alias(name), F.col("tag").alias(text)).distinct()
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(name)) & (F.xxhash64("text") == F.col(text)), "left_anti")
