"""Token-id files in Simple-8b words, written in document order and read back.

A 64-bit word holds a 4-bit selector and 60 bits of payload; the selector names
how many ids share the payload and their width. Selector 0 is the escape: its
payload is the place of a value of more than 60 bits in the file's exception
list, so that every word stands for itself. Every ``BLOCK`` ids start on a word
boundary and the footer keeps each block's word offset, so blocks are coded and
decoded side by side in numpy, from any point on.

File: magic, words, exceptions, block offsets, document ids, id flags, document
lengths, then a trailer of counts. All integers are little-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import give_back, importable, new_dir, open_input, open_output, written

#: Ids of a word and their width by selector (fixed by the coding; 0 is the escape, 1 a run of zeros).
COUNTS = (1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 0
BLOCK = 1024
MAGIC = b"TESSIDS1"
TRAILER = struct.Struct("<6Q8s")
#: Blocks decoded at once.
READ_BLOCKS = 2048
_SLACK = max(COUNTS)
_COUNT = np.array(COUNTS, dtype=np.int64)
#: The largest count that a value of so many bits allows; over 60 bits: 0.
_FITS = np.array([max((c for c, w in zip(COUNTS[1:], WIDTHS[1:], strict=True) if w >= bits), default=0) for bits in range(65)], dtype=np.uint8)


def _bits(values: np.ndarray) -> np.ndarray:
    """Bit lengths, exact for all 64 bits."""
    high = values >> np.uint64(32)
    low = np.frexp((values & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    return np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 32, low)


_FITS_SHORT = _FITS[_bits(np.arange(1 << 16, dtype=np.uint64))]


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, words of each block, and exceptions of a row of unsigned integers."""
    values = np.asarray(values).astype(np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    blocks = -(-n // BLOCK)
    grid = np.zeros((blocks, BLOCK + _SLACK), np.uint64)
    full = np.zeros(blocks * BLOCK, np.uint64)
    full[:n] = values
    grid[:, :BLOCK] = full.reshape(blocks, BLOCK)
    fits = np.full(grid.shape, 255, np.uint8)
    fits[:, :BLOCK] = (_FITS_SHORT[full] if full.max() < len(_FITS_SHORT) else _FITS[_bits(full)]).reshape(blocks, BLOCK)
    pick = np.zeros((blocks, BLOCK), np.uint8)  # escape, unless a selector fits
    smallest = {1: fits}  # the least of so many neighbours, by powers of two
    most = int(fits[:, :BLOCK].max())
    for selector in range(len(COUNTS) - 1, 0, -1):
        count = COUNTS[selector]
        if count > most:
            break
        power = 1 << (count.bit_length() - 1)
        if power not in smallest:
            half = smallest[power // 2]
            smallest[power] = np.minimum(half[:, : half.shape[1] - power // 2], half[:, power // 2 :])
        row = smallest[power]
        least = np.minimum(row[:, :BLOCK], row[:, count - power : count - power + BLOCK])
        pick[least >= count] = selector
    step = _COUNT[pick]
    lengths = np.full(blocks, BLOCK)
    lengths[-1] = n - (blocks - 1) * BLOCK
    starts = np.zeros((blocks, BLOCK), bool)
    rows, at = np.arange(blocks), np.zeros(blocks, np.int64)
    while len(rows):  # one word of every block at a time
        starts[rows, at] = True
        at = at + step[rows, at]
        on = at < lengths[rows]
        rows, at = rows[on], at[on]
    row, col = np.nonzero(starts)
    chosen = pick[row, col]
    words = chosen.astype(np.uint64) << np.uint64(60)
    exceptions = np.zeros(0, np.uint64)
    flat, first = grid.ravel(), row * grid.shape[1] + col
    for selector in np.unique(chosen):
        own = np.flatnonzero(chosen == selector)
        at = first[own]
        if selector == ESCAPE:
            exceptions = flat[at]
            words[own] |= np.arange(len(own), dtype=np.uint64)
            continue
        width, word = np.uint64(WIDTHS[selector]), words[own]
        for k in range(COUNTS[selector] if width else 0):
            word |= flat[at + k] << (np.uint64(k) * width)
        words[own] = word
    return words, np.bincount(row, minlength=blocks), exceptions


def decode(words: np.ndarray, per_block: np.ndarray, exceptions: np.ndarray, n: int) -> np.ndarray:
    """The first n values of whole blocks; the inverse of encode()."""
    blocks = len(per_block)
    out = np.zeros((blocks, BLOCK + _SLACK), np.uint64).ravel()
    selector = (words >> np.uint64(60)).astype(np.int64)
    payload = words & np.uint64((1 << 60) - 1)
    counts = _COUNT[selector]
    before = np.cumsum(counts) - counts
    row = np.repeat(np.arange(blocks), per_block)
    first = np.cumsum(per_block) - per_block
    at = row * (BLOCK + _SLACK) + before - (before[first][row] if blocks else 0)
    for s in np.unique(selector):
        own = np.flatnonzero(selector == s)
        if s == ESCAPE:
            out[at[own]] = exceptions[payload[own].astype(np.int64)]
            continue
        width = np.uint64(WIDTHS[s])
        mask = np.uint64((1 << WIDTHS[s]) - 1)
        for k in range(COUNTS[s] if width else 0):
            out[at[own] + k] = (payload[own] >> (np.uint64(k) * width)) & mask
    return out.reshape(blocks, BLOCK + _SLACK)[:, :BLOCK].ravel()[:n]


class Writer:
    """Writes one file; ids may come in pieces of any size."""

    def __init__(self, uri: str):
        self.out = open_output(uri)
        self.out.write(MAGIC)
        self.rest = np.zeros(0, np.uint64)
        self.n_ids = self.n_words = self.n_exceptions = 0
        self.per_block: list[np.ndarray] = []
        self.exceptions: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.known: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []

    def add(self, doc_ids: Sequence[int | None], lengths: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(np.array([d or 0 for d in doc_ids], "<i8"))
        self.known.append(np.array([d is not None for d in doc_ids], "u1"))
        self.lengths.append(np.asarray(lengths).astype("<i8"))
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // BLOCK * BLOCK
        self._words(ids[:whole])
        self.rest = ids[whole:].astype(np.uint64)

    def _words(self, ids: np.ndarray) -> None:
        words, per_block, exceptions = encode(ids)
        words[words >> np.uint64(60) == ESCAPE] += np.uint64(self.n_exceptions)
        self.out.write(words.astype("<u8").tobytes())
        self.per_block.append(per_block)
        self.exceptions.append(exceptions)
        self.n_ids += len(ids)
        self.n_words += len(words)
        self.n_exceptions += len(exceptions)

    def close(self) -> None:
        self._words(self.rest)
        join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
        offsets = np.concatenate([[0], np.cumsum(join(self.per_block, "<i8"))]).astype("<i8")
        docs = join(self.docs, "<i8")
        for part in (join(self.exceptions, "<u8"), offsets, docs, join(self.known, "u1"), join(self.lengths, "<i8")):
            self.out.write(part.tobytes())
        self.out.write(TRAILER.pack(self.n_ids, self.n_words, self.n_exceptions, len(offsets) - 1, len(docs), BLOCK, MAGIC))
        self.out.close()


class Reader:
    """Reads one file: its documents, and the ids of any run of blocks."""

    def __init__(self, uri: str):
        self.file = open_input(uri)
        size = self.file.size()
        self.n_ids, self.n_words, n_exceptions, blocks, docs, block, magic = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC or block != BLOCK or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{uri} is no token-id file of this version")
        at = len(MAGIC) + 8 * self.n_words

        def part(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(self.file.read_at(n * np.dtype(kind).itemsize, at), kind)
            at += n * np.dtype(kind).itemsize
            return got

        self.exceptions, self.offsets = part("<u8", n_exceptions), part("<i8", blocks + 1)
        self.doc_ids, self.known, self.lengths = part("<i8", docs), part("u1", docs), part("<i8", docs)

    def ids(self, block: int = 0, blocks: int | None = None) -> np.ndarray:
        end = len(self.offsets) - 1 if blocks is None else min(block + blocks, len(self.offsets) - 1)
        first, last = int(self.offsets[block]), int(self.offsets[end])
        words = np.frombuffer(self.file.read_at(8 * (last - first), len(MAGIC) + 8 * first), "<u8")
        return decode(words, np.diff(self.offsets[block : end + 1]), self.exceptions, min(self.n_ids, end * BLOCK) - block * BLOCK)

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """doc_id, ids before it in this file, its ids, their CRC-32 as little-endian 32-bit integers."""
        blocks = len(self.offsets) - 1
        held, held_at, nxt = b"", 0, 0  # bytes read ahead, the id they start at, the next block
        start = 0
        for doc, known, length in zip(self.doc_ids.tolist(), self.known.tolist(), self.lengths.tolist(), strict=True):
            crc, done = 0, 0
            while True:
                lo = 4 * (start + done - held_at)
                piece = memoryview(held)[lo : lo + 4 * (length - done)]
                crc = zlib.crc32(piece, crc)
                done += len(piece) // 4
                if done == length:
                    break
                if nxt >= blocks:
                    raise ValueError("the file ends within a document")
                held_at = nxt * BLOCK
                held = self.ids(nxt, READ_BLOCKS).astype("<u4").tobytes()
                nxt += READ_BLOCKS
            yield doc if known else None, start, length, crc
            start += length


def text_slices(batches: Iterable, most: int = 6_000_000) -> Iterator:
    """Slices of Arrow batches, of about ``most`` bytes of text in the second column and one row at least.

    After each slice Arrow gives back memory, after each batch the worker does, which would hold it beyond its task.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most)))
            yield batch.slice(lo, hi - lo)
            pa.default_memory_pool().release_unused()
            lo = hi
        give_back()


def text_batches(batches: Iterable, most: int = 4_000_000) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of Arrow batches, about ``most`` bytes of text at a time."""
    for part in text_slices(batches, most):
        yield part.column(0).to_pylist(), part.column(1).to_pylist()


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append the end id to every text's ids."""
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(counts + 1) - 1] = False
    out[keep] = ids
    return out, counts + 1


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Write token-id files in ascending doc_id order; returns the manifest.

    Manifest: part, path, n_docs, n_ids, base (ids in earlier files), one row a
    file. A retried task writes a file of a new name; the manifest, itself
    written by Spark's committer, names the file of the attempt that counts.
    Documents are dealt by ranges of (doc_id, text), so repeated ids don't meet
    in one task. Null text is empty, a null doc_id comes first, rows of one id
    are ordered by their text; an empty table gives no files. A text of any length is
    one task's work; further columns are ignored.
    """
    spark = docs.sparkSession
    importable(spark)
    folder = folder or new_dir(spark, "token-files")

    def write(batches: Iterable) -> Iterator:
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        from tessera.llm.tokens import load

        part = TaskContext.get().partitionId()
        path, writer, n_docs = f"{folder}/part-{part:06d}-{uuid.uuid4().hex[:8]}.s8b", None, 0
        for rows in text_slices(batches):
            writer = writer or Writer(path)
            flat, counts = with_end(*load(tokenizer_path).encode(rows.column(1)), end_id)
            writer.add(rows.column(0).to_pylist(), counts, flat)
            n_docs += rows.num_rows
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "n_docs": [n_docs], "n_ids": [writer.n_ids]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(text_col).alias("h"))
    dealt = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    manifest = written(dealt.mapInArrow(write, "part int, path string, n_docs long, n_ids long"), "token-manifest")
    return with_base(manifest)


def with_base(manifest: DataFrame, at_once: int = 1000) -> DataFrame:
    """The manifest and ``base``, the ids in earlier files: running sums within groups of files and over the groups."""
    files = manifest.withColumn("group", F.expr(f"part div {at_once}"))
    groups = files.groupBy("group").agg(F.sum("n_ids").alias("group_ids"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("group", F.coalesce(F.sum("group_ids").over(before(Window.orderBy("group"))), F.lit(0)).alias("group_base"))
    own = F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("group").orderBy("part"))), F.lit(0))
    return written(files.withColumn("own", own).join(groups, "group").select("part", "path", "n_docs", "n_ids", (F.col("group_base") + F.col("own")).alias("base")), "token-bases")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files."""
    importable(manifest.sparkSession)

    def read(batches: Iterable) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for r in batch.to_pylist():
                rows = [(d, r["base"] + s, n, c) for d, s, n, c in Reader(r["path"]).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    files = max(1, manifest.count())
    return manifest.repartitionByRange(files, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as token-id files and read them back; see the two functions above."""
    return read_token_files(write_token_files(docs, tokenizer_path, end_id))
