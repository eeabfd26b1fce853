"""Exact tokenisation with a cache of space-delimited units.

Both public BPE vocabularies split a text into pre-tokens that never run across
a single space between two other characters, and merge inside a pre-token only.
So the ids of a text are the ids of its units in a row. Arrow splits a batch of
texts and looks its units up in the cache; units not seen before go to the
tokenizers library, joined to one text, whose ids are cut at the units' borders.
Texts with more white space around a space are cut elsewhere only, and texts that
hold a special token's string are encoded by the library as they are.

The tests compare the ids with the library's for whole texts, special tokens,
all kinds of white space and letters that normalisation composes among them.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Units in a worker's cache; a full one makes way for those used last. This changes nothing but speed.
CACHED_UNITS = 600_000
#: Bytes of the units in it.
CACHED_BYTES = 24_000_000
#: Units that go to the library in one text: its own tables take some hundred bytes an id.
AT_ONCE = 10_000

#: All white space, as Arrow's regular expressions write it.
_WHITE = r"[\x09-\x0d\x1c-\x20\x{85}\pZ]"
#: A text in which a space has white space beside it or stands at an end.
_ODD = f"^{_WHITE}|{_WHITE}$| {_WHITE}|{_WHITE} "
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Marks that end a unit after a word of Latin letters are a pre-token by themselves; the letters are those that no normalisation takes apart.
_MARKS = ".,;:!?%#&$()"
_WORD = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{148}\x{14A}-\x{17E}]+$"
#: Stands between units where ids do not show borders: a word by itself in the vocabularies with word ends.
_BETWEEN = "\x01"


def _ragged(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... ``counts[0]`` numbers, then those from first[1] on, and so forth."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat((first - (ends - counts)).astype(np.int32 if total + int(first.max(initial=0)) < 2**31 else np.int64), counts)
    at += np.arange(total, dtype=at.dtype)
    return at


class UnitTokenizer:
    """encode(texts) -> all ids in one array and the number of ids of each text, as the library's encode() gives them."""

    def __init__(self, path: str):
        import pyarrow as pa
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        #: Whether a space before a unit shows in its ids, and the ids that such a unit begins with.
        self.spaced = self._library([" a"])[0] != self._library(["a"])[0]
        self.opens = np.zeros(1 + max(vocabulary.values()), bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.between = self._library([_BETWEEN])[0]
        self.known = pa.array([], pa.string())
        self.flat, self.counts, self.used = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.batch = 0

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct units, each after a space if that shows: all ids, and how many each unit has."""
        odd = [not u or u[0].isspace() or u[-1].isspace() or " " in u or _BETWEEN in u for u in units]
        joined = [u for u, o in zip(units, odd, strict=True) if not o]
        counts = np.zeros(len(units), np.int64)
        ids, own = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if joined:
            ids = np.array(self._library([" " + " ".join(joined) if self.spaced else f" {_BETWEEN} ".join(joined)])[0], np.uint32)
            if self.spaced:
                own = np.diff(np.append(np.flatnonzero(self.opens[ids]), len(ids)))
            else:
                ends = np.append(np.flatnonzero(ids == self.between[0]), len(ids))
                own = np.diff(np.append(-1, ends)) - 1
                ids = ids[ids != self.between[0]]
            if len(own) != len(joined) or int(own.sum()) != len(ids):  # borders that can't be told from ids
                joined, odd = [], [True] * len(units)
                ids, own = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        single = self._library([" " + u if self.spaced else u for u, o in zip(units, odd, strict=True) if o])
        odd = np.array(odd)
        counts[~odd] = own
        counts[odd] = [len(x) for x in single]
        flat = np.zeros(int(counts.sum()), np.uint32)
        first = np.cumsum(counts) - counts
        flat[_ragged(first[~odd], counts[~odd])] = ids
        flat[_ragged(first[odd], counts[odd])] = np.array([i for x in single for i in x], np.uint32)
        return flat, counts

    def _places(self, units) -> np.ndarray:
        """The numbers of distinct units (an Arrow array) in the cache, -1 for those it has not.

        The cache is looked up in the units and not they in it: their hash table is the smaller one.
        """
        import pyarrow.compute as pc

        place = np.full(len(units), -1, np.int32)
        at = pc.index_in(self.known, value_set=units).fill_null(-1).to_numpy(zero_copy_only=False)
        has = np.flatnonzero(at >= 0)
        place[at[has]] = has
        return place

    def _find(self, units) -> np.ndarray:
        """The numbers of units (an Arrow array) in the cache, where new ones are added."""
        import pyarrow as pa

        if len(self.known) > CACHED_UNITS or self.known.nbytes > CACHED_BYTES:
            self._make_way()
        self.batch += 1
        coded = units.dictionary_encode()
        place = self._places(coded.dictionary)
        missing = place < 0
        if missing.any():
            place[missing] = self._add(coded.dictionary.filter(pa.array(missing)))
        self.used[place] = self.batch
        return place[np.asarray(coded.indices)]

    def _add(self, new) -> np.ndarray:
        """Put distinct units (an Arrow array) that the cache has not into it; their numbers.

        Marks after a word are a pre-token of their own, so such a unit takes the ids of its word, which may be known, and of its marks.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        word = pc.utf8_rtrim(new, characters=_MARKS)
        marked = pc.and_(pc.not_equal(word, new), pc.match_substring_regex(word, _WORD))
        words = word.filter(marked).dictionary_encode()
        single = pc.filter(new, pc.invert(marked))
        base, own = len(self.known), self._places(words.dictionary).astype(np.int64)
        beside = pc.index_in(words.dictionary, value_set=single).fill_null(-1).to_numpy(zero_copy_only=False)
        own[beside >= 0] = base + beside[beside >= 0]
        unknown = own < 0
        own[unknown] = base + len(single) + np.arange(int(unknown.sum()))
        whole = pa.concat_arrays([single, words.dictionary.filter(pa.array(unknown))])
        texts = whole.to_pylist()
        for k in range(0, len(texts), AT_ONCE):
            self._keep(whole.slice(k, AT_ONCE), *self._fresh(texts[k : k + AT_ONCE]))
        if len(words):
            marks = pc.replace_substring_regex(new.filter(marked), _WORD[:-1], "").dictionary_encode()
            ends = self._library(marks.dictionary.to_pylist())
            end_counts = np.array([len(e) for e in ends], np.int64)
            own = own[np.asarray(words.indices)]
            end = np.asarray(marks.indices)
            first, count = np.cumsum(self.counts) - self.counts, self.counts[own] + end_counts[end]
            flat, at = np.zeros(int(count.sum()), np.uint32), np.cumsum(count) - count
            flat[_ragged(at, self.counts[own])] = self.flat[_ragged(first[own], self.counts[own])]
            flat[_ragged(at + self.counts[own], end_counts[end])] = np.array([i for e in ends for i in e], np.uint32)[_ragged((np.cumsum(end_counts) - end_counts)[end], end_counts[end])]
            self._keep(new.filter(marked), flat, count)
        place = np.empty(len(new), np.int64)
        of = marked.to_numpy(zero_copy_only=False)
        place[~of] = base + np.arange(len(single))
        place[of] = base + len(whole) + np.arange(int(of.sum()))
        return place

    def _keep(self, units, flat: np.ndarray, counts: np.ndarray) -> None:
        import pyarrow as pa

        self.known = pa.concat_arrays([self.known, units])
        self.flat, self.counts = np.concatenate([self.flat, flat]), np.concatenate([self.counts, counts])
        self.used = np.concatenate([self.used, np.full(len(counts), self.batch)])

    def _make_way(self) -> None:
        """Keep the half of the cache that was used last, and no unit of many bytes."""
        import pyarrow as pa
        import pyarrow.compute as pc

        size = pc.binary_length(self.known).to_numpy(zero_copy_only=False)
        order = np.argsort(-self.used, kind="stable")
        keep = np.sort(order[(np.arange(len(order)) < CACHED_UNITS // 2) & (np.cumsum(size[order]) < CACHED_BYTES // 2)])
        first = np.cumsum(self.counts) - self.counts
        self.known = self.known.take(pa.array(keep))
        self.flat, self.counts, self.used = self.flat[_ragged(first[keep], self.counts[keep])], self.counts[keep], self.used[keep]

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """``texts``: a list or an Arrow array without nulls."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        mask = lambda x: x.to_numpy(zero_copy_only=False)
        whole = np.zeros(len(texts), bool)
        for content in self.special:
            whole |= mask(pc.match_substring(texts, content, ignore_case=True))  # also in other letters: the library may normalise before it looks
        odd = mask(pc.match_substring_regex(texts, _ODD)) & ~whole
        plain = ~(whole | odd) & (mask(pc.binary_length(texts)) > 0)
        parts = [pc.split_pattern(texts.filter(pa.array(plain)), " "), pa.array([_CUT.split(t) for t in texts.filter(pa.array(odd)).to_pylist()], pa.list_(pa.string()))]
        text = np.concatenate([np.flatnonzero(plain), np.flatnonzero(odd)])  # the text of each row of units
        n = np.concatenate([mask(pc.list_value_length(p)) for p in parts]).astype(np.int64)
        units = pa.concat_arrays([p.flatten() for p in parts])
        head = np.cumsum(n) - n
        own, own_counts = [], np.zeros(0, np.int64)  # ids that don't come from the cache: of first units, and of whole texts
        if self.spaced:
            first = self._library(units.take(pa.array(head)).to_pylist())
            later = np.ones(len(units), bool)
            later[head] = False
            found = np.empty(len(units), np.int32)
            found[later] = self._find(units.filter(pa.array(later)))
            found[head] = np.arange(len(first)) + len(self.known)
            own += first
        else:
            found = self._find(units)
        whole_ids = self._library(texts.filter(pa.array(whole)).to_pylist())
        text, n = np.concatenate([text, np.flatnonzero(whole)]), np.concatenate([n, np.ones(len(whole_ids), np.int64)])
        found = np.concatenate([found, np.arange(len(whole_ids)) + len(self.known) + len(own)])
        own += whole_ids
        own_counts = np.array([len(x) for x in own], np.int64)
        flat = np.concatenate([self.flat, np.array([i for x in own for i in x], np.uint32)])
        counts = np.concatenate([self.counts, own_counts])
        first = np.cumsum(counts) - counts
        rows = np.argsort(text, kind="stable")  # back to the order of the texts
        unit = found[_ragged((np.cumsum(n) - n)[rows], n[rows])]
        per_text = np.zeros(len(texts), np.int64)
        sums = np.append(0, np.cumsum(counts[unit]))
        ends = np.cumsum(n[rows])
        per_text[text[rows]] = sums[ends] - sums[ends - n[rows]]
        return flat[_ragged(first[unit], counts[unit])], per_text


_loaded: dict[str, UnitTokenizer] = {}


def load(path: str) -> UnitTokenizer:
    """The tokenizer of a vocabulary file; a Python worker keeps it from task to task."""
    if path not in _loaded:
        _loaded[path] = UnitTokenizer(path)
    return _loaded[path]
