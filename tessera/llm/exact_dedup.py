"""Exact duplicates by content-defined chunk recipes, in DataFrame operations only.

A normalised text is cut into chunks at boundaries that depend on the text
alone (sentence ends and a letter-pair rule, 192 to 4,096 characters apart), so
equal texts give equal ordered chunk lists, their recipes. A chunk's identifier is
a pair of independent 64-bit hashes. Identifiers are verified: every distinct chunk of
the corpus meets the other chunks of its identifier once, and one that stands for a
single chunk names it. Recipes that hold an identifier of two chunks, if there is one,
get it made unique by a join with the table of those chunks, so two recipes are
equal exactly when the normalised texts are. Only recipes, about 4 % of the text,
are grouped and joined; no document is moved as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

WHITE = r"[\x20\x09-\x0D]+"
CHUNK = r"(?s).{192,4096}?(?:(?<=[.!?;:] )|(?<=[xyzkwq][aeiou] )|\z)|.{1,4096}"
#: What an identifier is made of, before each hash: hashes after different constants are independent.
SEEDS = (17, 4242)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def chunks(norm: Column) -> Column:
    """The ordered chunks of a text; their concatenation is the text."""
    return F.regexp_extract_all(norm, F.lit(CHUNK), F.lit(0))


def chunk_hashes(chunk: Column) -> Column:
    """The identifier of a chunk."""
    return F.struct(*[F.xxhash64(F.lit(seed), chunk).alias(f"h{k}") for k, seed in enumerate(SEEDS)])


def shared_chunks(docs: DataFrame, text_col: str, identify: Callable[[Column], Column]) -> DataFrame:
    """h, chunk and n (1, 2, ...) of the distinct chunks whose identifier stands for more than one."""
    chunk = F.explode(chunks(normalised(F.col(text_col)))).alias("chunk")
    distinct = docs.select(chunk).select(identify(F.col("chunk")).alias("h"), "chunk").distinct()
    # least and greatest tell whether there are two; chunks themselves move once, to be made distinct
    clash = distinct.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    clash = written(clash, "clashes")
    if clash.isEmpty():
        return clash.select("h", F.lit("").alias("chunk"), F.lit(1).alias("n"))
    own = Window.partitionBy("h").orderBy("chunk")
    return written(distinct.join(clash, "h").withColumn("n", F.row_number().over(own)), "clashing-chunks")


def recipes(docs: DataFrame, id_col: str, text_col: str, identify: Callable[[Column], Column] = chunk_hashes) -> DataFrame:
    """doc_id, text_sha256 and recipe of every row of ``docs``."""
    read = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    digest = F.sha2("norm", 256).alias("text_sha256")
    clash = shared_chunks(docs, text_col, identify)
    plain = read.select("doc_id", digest, F.transform(chunks(F.col("norm")), identify).alias("recipe"))
    if clash.isEmpty():
        return plain
    # the rows that hold a clashing identifier: their chunks meet the table, and the recipe gets each one's number
    name = written(read.select(F.monotonically_increasing_id().alias("row"), "doc_id", digest, chunks(F.col("norm")).alias("parts")), "chunked")
    part = name.select("row", F.posexplode("parts").alias("pos", "chunk")).select("row", "pos", "chunk", identify(F.col("chunk")).alias("h"))
    met = part.join(clash, ["h", "chunk"]).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "n"))).alias("numbers"))
    rows = name.select("row", "doc_id", "text_sha256", F.transform("parts", identify).alias("hashes")).join(met, "row", "left")
    return rows.select("doc_id", "text_sha256", F.struct("hashes", "numbers").alias("recipe"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identify: Callable[[Column], Column] = chunk_hashes) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal normalised text the smallest doc_id stays. Null text is
    empty; all empty texts form one group. A null doc_id never wins over another
    id; a group of null ids only has a null keep_id. Repeated rows count in
    group_size, and all rows with the id that stays are marked kept. A text of any
    length is one recipe, of two numbers for every 192 to 4,096 characters. An empty
    table gives an empty result; further columns are ignored, whatever their names.
    """
    found = written(recipes(docs, id_col, text_col, identify), "recipes")
    groups = found.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    joined = found.join(written(groups, "copies"), "recipe", "left")  # both sides are plain exchanges, so that a hot recipe can be split
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256"
    )
