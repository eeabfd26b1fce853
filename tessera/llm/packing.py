"""Packing into fixed-length sequences: length patterns by non-negative least squares.

The histogram of piece lengths, at most one row a length, is all that the
driver sees. Patterns are multisets of up to four coarse lengths that fill a
sequence, and then a quarter, a sixteenth or a 64th of one for short pieces; non-negative
least squares finds how often to repeat each so that together they use up the histogram;
repeats are rounded down and carried out with exact lengths, and the fit is repeated
while it places many. What remains, with enough short pieces to fill gaps, is packed
best fit first, longest pieces first, into the gaps and into new sequences. All steps work on runs of equal
sequences, so their number depends on the capacity and not on the corpus.

The plan says for each length which ranks go to which run of sequences. A piece
finds its place from its rank among the pieces of its length: its rank within
the task that cut it, plus the pieces of that length in earlier tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import importable, written
from tessera.llm.simple8b import text_slices, with_end

CAPACITY = 4096
#: Coarse lengths in a full sequence, and the most pieces in a pattern.
UNITS = 64
PATTERN_DOCS = 4
#: Equal parts of a sequence that a pattern may fill, once in each.
PARTS = (1, 4, 16, 64)
#: Tokens of short pieces that stay out of patterns within a sequence, as a multiple of the gaps that they may have to fill.
RESERVE = 0.5


class Run(NamedTuple):
    """``n`` pieces of ``length``, one in each sequence from ``sequence`` on, at ``offset``."""

    length: int
    sequence: int
    n: int
    offset: int


def patterns(units: int = UNITS, most: int = PATTERN_DOCS) -> list[tuple[int, ...]]:
    """All multisets of up to ``most`` positive integers with the sum ``units``, largest first."""

    def parts(left: int, largest: int, n: int) -> Iterator[tuple[int, ...]]:
        if left == 0:
            yield ()
        elif n:
            for first in range(min(left, largest), -(-left // n) - 1, -1):
                for rest in parts(left - first, first, n - 1):
                    yield (first, *rest)

    return list(parts(units, units, most))


def nnls(a: np.ndarray, b: np.ndarray, most: int = 2000) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method: at most rank(a) entries are not 0."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * max(1.0, np.abs(a.T @ b).max(initial=0.0))
    for _ in range(most):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= tolerance:
            break
        active[best] = True
        while True:
            own = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, own], b, rcond=None)[0]
            if (s > 0).all():
                break
            low = s <= 0
            step = (x[own][low] / np.maximum(x[own][low] - s[low], 1e-300)).min()
            x[own] += step * (s - x[own])
            gone = own[low & (x[own] <= 1e-9)]
            if not len(gone):
                gone = own[low][:1]
            x[gone], active[gone] = 0, False
        x[:] = 0
        x[np.flatnonzero(active)] = s
    return x


class Plan:
    """Places for all pieces of a histogram of lengths."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in histogram.items():
            self.left[length] = n
        self.runs: list[Run] = []
        self.sequences = self.patterned = 0
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by gap: first sequence, sequences
        self._patterns()
        self._best_fit()

    def _place(self, length: int, sequence: int, n: int, offset: int) -> None:
        self.runs.append(Run(length, sequence, n, offset))
        self.left[length] -= n

    def _patterns(self) -> None:
        """Patterns that fill a sequence, fitted anew while they find a place for many, then those that fill an even part of one exactly."""
        for parts in PARTS:
            if self.capacity % (parts * UNITS):
                continue
            while self._fitted(parts) >= max(1, int(self.left.sum()) // 50):
                pass

    def _fitted(self, parts: int) -> int:
        """Fit patterns to the histogram of what is left and carry them out; the pieces that found a place."""
        whole, before = self.capacity // parts, self.patterned
        self.spare = self._spare(whole) if parts > 1 else np.inf
        width = whole // UNITS
        unit = (np.arange(whole + 1) + width // 2) // width  # pieces of unit 0 only fill gaps
        have = np.bincount(unit, weights=self.left[: whole + 1], minlength=UNITS + 1)
        usable = [p for p in patterns() if all(have[u] for u in p)]
        if not usable or self.spare <= 0:
            return 0
        a = np.zeros((UNITS + 1, len(usable)))
        for k, p in enumerate(usable):
            for u in p:
                a[u, k] += 1
        repeats = np.floor(nnls(a[1:], have[1:]) + 1e-6).astype(np.int64)
        lengths = [np.flatnonzero(unit == u) for u in range(UNITS + 1)]
        first, filled = self.sequences, 0  # parts are numbered through all sequences of this kind
        for k in np.argsort(-repeats, kind="stable"):
            if not repeats[k]:
                break
            filled = self._repeat(usable[k], int(repeats[k]), lengths, parts, first, filled)
        self.sequences = first + -(-filled // parts)
        if filled % parts:
            self._leave(self.sequences - 1, 1, (parts - filled % parts) * whole)
        return self.patterned - before

    def _spare(self, whole: int) -> float:
        """Tokens of pieces up to ``whole`` that may leave for patterns: the rest is kept to fill what longer pieces leave open."""
        length = np.arange(self.capacity + 1)
        long = length > whole
        tokens = length * self.left
        open_now = sum(gap * n for gap, runs in enumerate(self.open) for _, n in runs)
        return float(tokens[~long].sum() - RESERVE * (open_now + tokens[long].sum()))

    def _exact(self, pattern: tuple[int, ...], lengths: list[np.ndarray], whole: int, exact: bool) -> tuple[list[int], int] | None:
        """A length for each place of a pattern, of those that are left, and the room that remains: none if ``exact``."""
        chosen: list[int] = []
        room = whole
        for place, u in enumerate(pattern):
            rest = len(pattern) - place - 1
            fits = [int(x) for x in lengths[u] if self.left[x] > chosen.count(x) and x <= room]
            if exact and rest == 1:  # the last piece closes the part, whatever its unit
                fits = [x for x in fits if room > x and self.left[room - x] > [*chosen, x].count(room - x)]
            if exact and not rest:
                fits = [room] if room and self.left[room] > chosen.count(room) else []
            if not fits:
                return None
            # longest and shortest in turn, and last what fills the sequence best
            chosen.append(fits[-1] if not rest or place % 2 == 0 else fits[0])
            room -= chosen[-1]
        return chosen, room

    def _repeat(self, pattern: tuple[int, ...], n: int, lengths: list[np.ndarray], parts: int, first: int, filled: int) -> int:
        """Carry out a pattern up to n times, from part ``filled`` on; each pass uses up a length, an n, or finds no more."""
        whole = self.capacity // parts
        while n and self.spare > 0 and (found := self._exact(pattern, lengths, whole, parts > 1)):
            chosen, room = found
            times = min([n, *(int(self.left[x]) // chosen.count(x) for x in set(chosen))])
            if parts > 1:
                times = int(min(times, max(1, self.spare // whole)))
            at = 0
            for x in chosen:
                for part in range(parts):
                    start = filled + (part - filled) % parts  # the first part to fill at this place of a sequence
                    if start < filled + times:
                        self._place(x, first + start // parts, -(-(filled + times - start) // parts), part * whole + at)
                at += x
            self.patterned += times * len(chosen)
            if room:
                self._leave(first + filled, times, room)
            filled += times
            n -= times
            self.spare -= times * whole
        return filled

    def _leave(self, first: int, n: int, gap: int) -> None:
        if gap:
            self.open[gap].append((first, n))

    def _best_fit(self) -> None:
        for length in range(self.capacity, 0, -1):
            gap = length
            while self.left[length]:
                while gap <= self.capacity and not self.open[gap]:
                    gap += 1
                if gap > self.capacity:  # new sequences, as full as this length fills them
                    each = self.capacity // length
                    n = max(1, int(self.left[length]) // each)
                    self.open[self.capacity].append((self.sequences, n))
                    self.sequences += n
                    gap = self.capacity
                first, n = self.open[gap].pop()
                each = min(gap // length, int(self.left[length]))
                take = min(n, int(self.left[length]) // each)
                for k in range(each):
                    self._place(length, first, take, self.capacity - gap + k * length)
                if take < n:
                    self.open[gap].append((first + take, n - take))
                self._leave(first, take, gap - each * length)

    def arrays(self) -> dict[str, np.ndarray]:
        """Runs by length, with the number of pieces before each; ``base``: pieces of smaller lengths."""
        runs = sorted(self.runs)
        n = np.array([r.n for r in runs], np.int64)
        length = np.array([r.length for r in runs], np.int64)
        ends = np.cumsum(n)
        totals = np.bincount(length, weights=n, minlength=self.capacity + 2).astype(np.int64)
        return {"first": ends - n, "sequence": np.array([r.sequence for r in runs], np.int64), "offset": np.array([r.offset for r in runs], np.int64), "base": np.cumsum(totals) - totals}


def cut(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32, and the part and rank that order equal lengths."""
    importable(docs.sparkSession)

    def pieces(batches: Iterable) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        from tessera.llm.tokens import load

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for rows in text_slices(batches):
            flat, counts = with_end(*load(tokenizer_path).encode(rows.column(1)), end_id)
            raw = flat.astype("<u4").tobytes()
            n = -(-counts // capacity)
            doc = np.repeat(np.arange(len(counts)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(counts[doc] - start, capacity)
            at = (np.cumsum(counts) - counts)[doc] + start
            crc = [zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            run = length[order]
            rank = np.empty(len(run), np.int64)
            rank[order] = np.arange(len(run)) - np.searchsorted(run, run) + seen[run]
            seen += np.bincount(length, minlength=capacity + 1)
            ids = rows.column(0).take(pa.array(doc))
            columns = [ids, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part), pa.int32()), pa.array(rank)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    rows = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))
    return rows.mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is empty: a piece of the end id alone. Null and repeated ids are
    packed like any other, as rows; ties in length are ordered by task and place. A text
    of any length is cut by the task that reads it. An empty table has no pieces; columns
    beside doc_id and text are ignored, whatever their names.
    """
    cuts = written(cut(docs, tokenizer_path, end_id, capacity), "pieces")
    counts = cuts.groupBy("length", "part").agg(F.count("*").alias("n"))
    plan = Plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)  # a row a length
    place = plan.arrays()
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    def placed(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for b in batches:
            length, rank, ahead = (np.asarray(b[c]) for c in ("length", "rank", "before"))
            at = place["base"][length] + rank + ahead
            run = np.searchsorted(place["first"], at, side="right") - 1
            columns = [*(b[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(place["sequence"][run] + at - place["first"][run]), pa.array(place["offset"][run])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return cuts.join(before, ["length", "part"]).mapInArrow(placed, schema)
