import os
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

from tests.llm import test_decontam, test_line_dedup, test_ngram_join

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables are absent")
def test_stages_same_as_brute_force(spark, tmp_path):
    import public_tokenizers

    import corpus_pipeline
    from tessera.llm import toxicity

    start = spark.read.parquet(f"{SF}/documents.parquet")
    kept, docs = [start], start
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs)
        if k < 4:
            assert docs.dtypes == start.dtypes
    rows = [{r.doc_id: r for r in t.collect()} for t in kept[:5]]

    scores = toxicity.toxicity(start, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert set(rows[1]) == {r.doc_id for r in scores if r.predicted == 0}

    found = defaultdict(set)
    for d, r in rows[1].items():
        for x in r.text.split("\n"):
            found[test_line_dedup.key(x)].add(d)
    for d, r in rows[1].items():
        text = "\n".join(x for x in r.text.split("\n") if not test_line_dedup.key(x) or len(found[test_line_dedup.key(x)]) < 10)
        assert rows[2][d].text == text and rows[2][d].n_chars == len(text)
    assert set(rows[2]) == set(rows[1])

    near = test_ngram_join.brute([(d, r.text) for d, r in rows[2].items()])
    assert set(rows[3]) == {c for _, c, _, _ in near}
    assert len(rows[3]) < len(rows[2])

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {w[0] for w in test_decontam.brute([(d, r.text) for d, r in rows[3].items()], items)}
    assert set(rows[4]) == set(rows[3]) - bad

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = kept[5].collect()
    tokens = Counter()
    for p in pieces:
        tokens[p.doc_id] += p["length"]
    assert tokens == {d: len(lib.encode(r.text, add_special_tokens=False).ids) + 1 for d, r in rows[4].items()}
    used = Counter()
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == used[p.sequence_id]
        used[p.sequence_id] += p["length"]
    assert max(used.values()) <= 4096 and len(used) <= -(-sum(used.values()) // 4096) + 1


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables are absent")
def test_stages_take_odd_rows_and_empty_tables(spark):
    """Nulls, empty and repeated rows, and columns of clashing names pass; an empty table stays empty."""
    import corpus_pipeline

    rows = [(None, None, None), (1, "", "x"), (1, "", "x"), (2, None, "y"), (3, "some words in a short text", None), (3, "another text under the same id", "z"), (4, "word " * 30_000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep string").selectExpr("*", "1 AS doc", "2 AS bad_id", "3 AS keep_id", "4 AS id", "5 AS score")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for table in (docs, docs.limit(0)):
            got = stage(spark, table, SF)
            n = got.count()
            assert n == 0 if table is not docs else 0 < n
            if k < 4:
                assert got.dtypes == docs.dtypes
