import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

from tessera.llm import simple8b as s8
from tessera.llm import tokens
from tessera.llm.tokens import UnitTokenizer

#: All characters that Unicode or str.isspace() count as white space.
WHITE = [chr(c) for c in range(0x3001) if chr(c).isspace()] + ["\u200b", "\ufeff"]

TEXTS = [
    "", " ", "a", "Hello world, it's me.", "two  spaces\n\nand\t tabs \n x", " lead and trail ", "ünïcode ñandú 東京 😀 ́x", "<|endoftext|> as text <|startoftext|>",
    "e\u0301 <|endoftext|> \u0301a", "<|endoftext|><|startoftext|>", "a <|ENDOFTEXT|>b", "\u212b \u1e9b\u0323",
    "a\x1cb c\x1f d \x85 e f    g", "x" * 300 + " " + "y" * 70, "\n\n\n", "1234567 89 !?!? ...", "İSTANBUL ΣΑΣ ß ﬁ é", "a\n b\n  c\r\n d",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_give_the_library_ids(name, monkeypatch):
    path = public_tokenizers.path(name)
    lib = Tokenizer.from_file(path)
    rng = np.random.default_rng(1)
    chars = [*"ab c.,'12éK東\u0301\u0327가\u11a8\x01's", *WHITE, "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|"]
    texts = TEXTS + ["".join(rng.choice(chars, rng.integers(0, 60))) for _ in range(1500)]
    texts += [" ".join(rng.choice(list("aéİıŉſßñ"), rng.integers(1, 4)).tobytes().decode("utf-32-le") + "".join(rng.choice(list(".,;:!?%#&$()'-1"), rng.integers(0, 4))) for _ in range(30)) for _ in range(100)]
    texts += [f"a{w}b {w}c{w} d{w}{w}e" for w in WHITE]
    units = UnitTokenizer(path)
    flat, counts = units.encode(texts)
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert flat.tolist() == [i for w in want for i in w]
    monkeypatch.setattr(tokens, "CACHED_UNITS", 50)  # a cache that makes way at every turn
    for lo in range(0, len(texts), 40):
        flat, _ = units.encode(texts[lo : lo + 40])
        assert flat.tolist() == [i for w in want[lo : lo + 40] for i in w]
    flat, counts = units.encode([])
    assert len(flat) == len(counts) == 0


@pytest.mark.parametrize("values", [
    [], [0], [0] * 500, [1] * 61, [2**60 - 1, 2**60, 2**64 - 1, 0, 5], list(range(5000)), [3] * 1023 + [2**63] + [7] * 1025,
])
def test_round_trip(values):
    words, per_block, extra = s8.encode(np.array(values, np.uint64))
    assert s8.decode(words, per_block, extra, len(values)).tolist() == values


def test_random_round_trip_and_density():
    rng = np.random.default_rng(2)
    v = (rng.integers(0, 2**63, 20000).astype(np.uint64) >> rng.integers(0, 63, 20000).astype(np.uint64))
    words, per_block, extra = s8.encode(v)
    assert (s8.decode(words, per_block, extra, len(v)) == v).all()
    assert len(s8.encode(np.full(6000, 4095))[0]) <= 6000 / 5 + 6


def test_file_pieces(tmp_path):
    w = s8.Writer(f"{tmp_path}/x/f.s8b")
    ids = [np.arange(k) * 7 for k in (0, 3, 5000, 1, 2048)]
    w.add([5, None], np.array([0, 3]), np.concatenate(ids[:2]))
    w.add([7, 8, 9], np.array([5000, 1, 2048]), np.concatenate(ids[2:]))
    w.close()
    r = s8.Reader(f"{tmp_path}/x/f.s8b")
    want = [(d, sum(map(len, ids[:k])), len(ids[k]), zlib.crc32(ids[k].astype("<u4").tobytes())) for k, d in enumerate([5, None, 7, 8, 9])]
    assert list(r.documents()) == want
    assert (r.ids(1, 2) == np.concatenate(ids)[1024:3072]).all()


def test_query_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    data = [(k * 3 % 17, t) for k, t in enumerate(TEXTS)] + [(3, None), (None, "null id"), (5, "a"), (5, "a"), (20, "long words " * 30000)]
    df = spark.createDataFrame([Row(doc_id=d, text=t, n_tokens="clash") for d, t in data], "doc_id long, text string, n_tokens string")
    got = sorted(s8.token_digest(df, path).collect(), key=lambda r: r.start)
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == [(r.doc_id is not None, r.doc_id or 0) for r in got]
    start, seen = 0, []
    for r in got:
        assert r.start == start
        start += r.n_tokens
        seen.append((r.doc_id, r.n_tokens, r.ids_crc32))
    want = [(d, np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4")) for d, t in data]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1:])
    assert sorted(seen, key=key) == sorted(((d, len(i), zlib.crc32(i.tobytes())) for d, i in want), key=key)
    assert s8.token_digest(df.limit(0), path).collect() == []


def test_bases_of_many_files(spark):
    rows = [(k, f"f{k}", 1, k * k) for k in range(0, 50, 2)]
    got = s8.with_base(spark.createDataFrame(rows, "part int, path string, n_docs long, n_ids long").repartition(3), at_once=7).collect()
    assert {r.part: r.base for r in got} == {k: sum(n for j, _, _, n in rows if j < k) for k, *_ in rows} and len(got) == len(rows)
