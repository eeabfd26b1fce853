import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

from tessera.llm import packing

SF = "/root/testdata/sf0.1/documents.parquet"


def test_patterns_and_nnls():
    p = packing.patterns(6, 3)
    assert sorted(p) == [(2, 2, 2), (3, 2, 1), (3, 3), (4, 1, 1), (4, 2), (5, 1), (6,)]
    rng = np.random.default_rng(0)
    a, want = rng.random((8, 30)), np.zeros(30)
    want[[3, 7, 20]] = [5, 2, 9]
    x = packing.nnls(a, a @ want)
    assert (x >= 0).all() and np.allclose(a @ x, a @ want, atol=1e-6)


@pytest.mark.parametrize("seed,kind", [(1, "wide"), (2, "short"), (3, "one"), (4, "long"), (5, "few")])
def test_plan_is_whole_and_tight(seed, kind):
    r = random.Random(seed)
    draw = {"wide": lambda: min(4096, max(1, int(r.lognormvariate(6.5, 1.2)))), "short": lambda: r.randint(1, 60), "one": lambda: 1500, "long": lambda: r.randint(2100, 4096), "few": lambda: r.randint(1, 4096)}[kind]
    hist = Counter(draw() for _ in range({"few": 7}.get(kind, 50_000)))
    plan = packing.Plan(hist)
    spans, used = defaultdict(list), Counter()
    for run in plan.runs:
        used[run.length] += run.n
        for k in range(run.n):
            spans[run.sequence + k].append((run.offset, run.length))
    assert used == hist and len(spans) == plan.sequences
    for s in spans.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(k * n for k, n in hist.items())
    least = {"one": -(-50_000 // 2), "long": 50_000}.get(kind, -(-total // 4096))
    assert plan.sequences <= least * 1.002 + 1
    if kind in ("wide", "short"):
        assert plan.patterned > 35_000
    if kind == "wide":  # the plan's size follows the capacity, not the corpus
        assert len(packing.Plan({k: 100 * n for k, n in hist.items()}).runs) < 3 * len(plan.runs)


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables are absent")
def test_patterns_place_most_pieces_of_the_table():
    import duckdb

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [t or "" for (t,) in duckdb.sql(f"SELECT text FROM '{SF}'").fetchall()]
    counts = [len(e.ids) + 1 for e in lib.encode_batch_fast(texts, add_special_tokens=False)]
    hist = Counter(min(4096, n - k) for n in counts for k in range(0, n, 4096))
    plan = packing.Plan(hist)
    assert plan.patterned > 0.8 * sum(hist.values()) and plan.sequences <= -(-sum(counts) // 4096) + 1


def test_query_rows(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    r = random.Random(3)
    words = "the cat sat on unbelievable mats, naïvely 12 times!".split()
    data = [(k, " ".join(r.choices(words, k=r.randint(0, 900)))) for k in range(300)] + [(None, "null id"), (3, "again"), (3, "again"), (900, None), (901, ""), (903, "a <|endoftext|> b"), (902, "cat " * 9000)]
    df = spark.createDataFrame([Row(doc_id=d, text=t, length="clash") for d, t in data], "doc_id long, text string, length string").repartition(7)
    got = packing.pack(df, path).collect()
    want = Counter()
    for d, t in data:
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for k in range(0, len(ids), 4096):
            want[(d, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes()))] += 1
    assert Counter(tuple(x)[:5] for x in got) == want
    spans = defaultdict(list)
    for x in got:
        spans[x.sequence_id].append((x.offset, x.length))
    for s in spans.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(spans) <= -(-sum(x.length for x in got) // 4096) + 2
    assert packing.pack(df.limit(0), path).collect() == []
