"""Line dedup: range-partitioned line hashes, streamed in order, to keep bitmaps.

Each document gives two independent 64-bit hashes of the key of each line. The rows (hash,
document, position) are dealt by ranges of all three, so that even a line that a
third of all documents hold spreads over many tasks, and sorted the same way. A
task streams its range: it holds the rows of a line only until enough documents
have been seen to judge it. The first and last line of a range may go on in the
next one; only where a range has too few documents for a verdict of its own do
their rows wait for the sum over ranges, a few rows each. Verdicts come back as
one compressed bitmap per document, and only then does the text meet them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import importable, written

#: White space that is stripped from both ends of a line to give its key.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_DOCS = 10
#: Goes before the key in the second hash, so that keys of one first hash don't share it.
_SEED = 42
VERDICTS = "h1 long, h2 long, id long, tag long, pos int, drop boolean, part int, docs int, edge int"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def first_hash(key: Column) -> Column:
    return F.xxhash64(key)


def second_hash(key: Column) -> Column:
    """Seeded by a constant: were the key hashed first, this would follow from the first hash."""
    return F.xxhash64(F.lit(_SEED), key)


def line_rows(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """h1, h2, id, tag and pos of every line whose key has ``least`` code points; (id, tag) names a document."""
    one = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tag"), F.posexplode(F.transform(lines(F.col(text_col)), line_key)).alias("pos", "key"))
    return one.filter(F.length("key") >= least).select(first_hash(F.col("key")).alias("h1"), second_hash(F.col("key")).alias("h2"), "id", "tag", "pos")


class Stream:
    """Judges sorted rows of one range as they come; see the module's text."""

    def __init__(self, min_docs: int):
        self.min_docs = min_docs
        self.runs = 0  # lines that have ended
        self.key: tuple[int, int] | None = None
        self.docs, self.last, self.first = 0, None, None
        self.held: list[tuple] = []
        self.edges: list[tuple] = []
        self.out: list[tuple] = []

    def rows(self, h1, h2, ids, tags, pos) -> None:
        """Add sorted rows, all as lists."""
        n = len(h1)
        at = 0
        while at < n:
            if (h1[at], h2[at]) != self.key:
                self._end(final=False)
                self.key, self.docs, self.last, self.first = (h1[at], h2[at]), 0, None, (ids[at], tags[at])
            doc = (ids[at], tags[at])
            if doc != self.last:
                self.docs, self.last = self.docs + 1, doc
                if self.docs == self.min_docs:
                    self._drop_held()
            row = (*self.key, *doc, pos[at])
            if self.docs >= self.min_docs:
                self.out.append((*row, True, None, None, None))
            else:
                self.held.append(row)
            at += 1

    def _drop_held(self) -> None:
        self.out += [(*r, True, None, None, None) for r in self.held]
        self.held = []

    def _end(self, final: bool) -> None:
        if self.key is None:
            return
        if self.runs == 0 or final:  # this line may go on in another range
            edge = (1 if self.runs == 0 else 0) | (2 if final else 0)
            self.edges.append((self.key, self.docs, self.first, self.last, edge))
            self.out += [(*r, False, None, None, None) for r in self.held]
        self.held = []
        self.runs += 1

    def finish(self) -> None:
        self._end(final=True)


def _vector_runs(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run of equal hashes, and the documents in it."""
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    doc = new.copy()
    doc[1:] |= (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])
    starts = np.flatnonzero(new)
    return starts, np.add.reduceat(doc, starts, dtype=np.int64)


def verdicts(rows: DataFrame, min_docs: int) -> DataFrame:
    """Rows to drop (drop), rows still open (not drop), and the edges of ranges (edge not null)."""
    importable(rows.sparkSession)

    def judge(batches: Iterable) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("id", pa.int64()), ("tag", pa.int64()), ("pos", pa.int32()), ("drop", pa.bool_()), ("part", pa.int32()), ("docs", pa.int32()), ("edge", pa.int32())])
        part, stream = TaskContext.get().partitionId(), Stream(min_docs)
        unset = np.iinfo(np.int64).min  # a null id, for comparisons only

        def packed() -> Iterator:
            if stream.out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*stream.out, strict=True), schema.types, strict=True)], schema=schema)
                stream.out = []

        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column(2)
            h1, h2, tags, pos = (np.asarray(batch.column(k)) for k in (0, 1, 3, 4))
            ids = np.asarray(raw.fill_null(unset))
            starts, counts = _vector_runs(h1, h2, ids, tags)
            # the first and last line of a batch may go on in another: row by row; the others are whole
            inner = slice(starts[1] if len(starts) > 1 else len(h1), starts[-1] if len(starts) > 1 else len(h1))
            known = lambda s: (h1[s].tolist(), h2[s].tolist(), raw[s.start : s.stop].to_pylist(), tags[s].tolist(), pos[s].tolist())
            stream.rows(*known(slice(0, inner.start)))
            if inner.stop > inner.start:
                stream._end(final=False)
                stream.key = None
                stream.runs += len(starts) - 2
                whole = np.repeat(counts[1:-1] >= min_docs, np.diff(starts[1:]))
                if whole.any():
                    k = np.flatnonzero(whole) + inner.start
                    none = pa.nulls(len(k), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(h1[k]), pa.array(h2[k]), raw.take(pa.array(k)), pa.array(tags[k]), pa.array(pos[k], pa.int32()), pa.array(np.ones(len(k), bool)), none, none, none], schema=schema)
            if inner.stop < len(h1):
                stream.rows(*known(slice(inner.stop, len(h1))))
            if len(stream.out) > 20_000:
                yield from packed()
        stream.finish()
        for (a, b), docs, first, last, edge in stream.edges:
            stream.out.append((a, b, *first, 0, False, part, docs, edge))
            stream.out.append((a, b, *last, 1, False, part, docs, edge))
        yield from packed()

    order = ["h1", "h2", "id", "tag", "pos"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(judge, VERDICTS)


def dropped_rows(judged: DataFrame, min_docs: int) -> DataFrame:
    """(id, tag, pos) of all lines to drop: those judged in their range and open ones over the limit in sum.

    A document on the border of two ranges is in both, next to itself: it is
    the last of one and the first of the next, and is counted once.
    """
    ends = judged.filter("edge IS NOT NULL")
    doc = F.struct("id", "tag")
    spans = ends.groupBy("h1", "h2", "part").agg(F.max("docs").alias("docs"), F.max(F.when(F.col("pos") == 0, doc)).alias("first"), F.max(F.when(F.col("pos") == 1, doc)).alias("last"))
    both = spans.select("h1", "h2", F.explode(F.array(F.struct(F.col("first").alias("doc"), "part"), F.struct(F.col("last").alias("doc"), "part"))).alias("x")).select("h1", "h2", "x.doc", "x.part").distinct()
    twice = both.groupBy("h1", "h2", "doc").agg((F.count("*") - 1).alias("again")).groupBy("h1", "h2").agg(F.sum("again").alias("again"))
    total = spans.groupBy("h1", "h2").agg(F.sum("docs").alias("docs")).join(twice, ["h1", "h2"])
    over = total.filter(F.col("docs") - F.col("again") >= min_docs).select("h1", "h2")
    still = judged.filter("NOT drop AND edge IS NULL").join(over, ["h1", "h2"], "left_semi")
    return judged.filter("drop").select("id", "tag", "pos").unionByName(still.select("id", "tag", "pos"))


@F.pandas_udf(T.BinaryType())
def _bitmap(positions, n_lines):
    """zlib of the bits of the kept lines, the first line in the lowest bit."""
    import pandas as pd

    def one(drop, n):
        keep = np.ones(n, bool)
        keep[np.asarray(drop, dtype=np.int64)] = False
        return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1)

    return pd.Series([one(d, n) for d, n in zip(positions, n_lines, strict=True)])


def keep_flags(bitmap: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n, bitorder="little").astype(bool)


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, least: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tag, n_bits, keep: a bitmap for each document that loses a line.

    A line is lost if its key, of at least ``least`` code points, is found in at
    least ``min_docs`` documents. ``tag`` is a hash of the text: rows of one
    doc_id with different texts are different documents, repeated rows are one.
    Bits after ``n_bits`` (the last dropped line) are kept lines.
    """
    rows = written(line_rows(docs, id_col, text_col, least), "line-hashes")  # read twice: for the ranges' borders, and to be dealt
    judged = written(verdicts(rows, min_docs), "line-verdicts")
    per_doc = dropped_rows(judged, min_docs).groupBy("id", "tag").agg(F.collect_set("pos").alias("drop"))
    sized = per_doc.withColumn("n_bits", F.array_max("drop") + 1)
    return sized.select("id", "tag", "n_bits", _bitmap("drop", "n_bits").alias("keep"))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` in a struct ``doc``, and its n_bits and keep (null: keep all)."""
    left = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tag"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    b = bitmaps.select(F.col("id").alias("b_id"), F.col("tag").alias("b_tag"), "n_bits", "keep")
    # a hash of both: null ids meet too, and one id of many texts is dealt out
    on = (F.xxhash64("id", "tag") == F.xxhash64("b_id", "b_tag")) & F.col("id").eqNullSafe(F.col("b_id")) & (F.col("tag") == F.col("b_tag"))
    return left.join(b.hint("shuffle_hash"), on, "left").select("doc", "n_bits", "keep")


def kept_text(text: str | None, keep: bytes | None, n_bits: int | None) -> tuple[str, int, int]:
    """The lines that stay, joined; the number of lines; the number dropped."""
    text = text or ""
    if keep is None:
        return text, text.count("\n") + 1, 0
    parts = text.split("\n")
    flags = keep_flags(keep, int(n_bits))
    stay = [p for p, k in zip(parts, flags, strict=False) if k] + parts[int(n_bits) :]
    return "\n".join(stay), len(parts), len(parts) - len(stay)


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, least: int = 1) -> DataFrame:
    """``docs`` without the lost lines, all columns as they were; n_chars, if present, follows the text.

    Null text stays null; a text that loses every line is empty. Rows of one doc_id, or
    of none, are told apart by their text; repeated rows are one document. A text of any
    length is one row of its lines' hashes; an empty table stays empty. No other
    column of ``docs`` is read, whatever its name.
    """
    importable(docs.sparkSession)
    joined = with_bitmaps(docs, keep_bitmaps(docs, min_docs, least))

    @F.pandas_udf(T.StringType())
    def text_of(text, keep, n_bits):
        import pandas as pd

        return pd.Series([None if t is None else kept_text(t, k, None if k is None else n)[0] for t, k, n in zip(text, keep, n_bits, strict=True)], dtype=object)

    new = joined.select("doc", text_of("doc.text", "keep", "n_bits").alias("kept"))
    column = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return new.select(*[column[c].alias(c) if c in column else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def line_digest(docs: DataFrame, min_docs: int = MIN_DOCS, least: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every row; null text is one empty line; else as ``line_dedup``."""
    importable(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def digest(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, texts, keeps, bits = (c.to_pylist() for c in batch.columns)
            got = [kept_text(t, k, n) for t, k, n in zip(texts, keeps, bits, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()), pa.array([hashlib.sha256(g[0].encode("utf-8")).hexdigest() for g in got], pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    joined = with_bitmaps(narrow, keep_bitmaps(narrow, min_docs, least)).select("doc.doc_id", "doc.text", "keep", "n_bits")
    return joined.mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
