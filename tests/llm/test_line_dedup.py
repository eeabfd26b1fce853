import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import Row

from tessera.llm import line_dedup as ld

WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute(data, min_docs, least=1):
    found = defaultdict(set)
    for d, t in data:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                found[key(x)].add((d, t))
    out = []
    for d, t in data:
        parts = (t or "").split("\n")
        stay = [x for x in parts if len(found.get(key(x), ())) < min_docs]
        out.append((d, len(parts), len(parts) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=400):
    r = random.Random(seed)
    pool = [f"Line {k} É" for k in range(60)] + ["", "  ", " ", "HOT line"]
    weights = [1 / (k + 1) for k in range(60)] + [3, 1, 1, 8]
    data = [(k, "\n".join(r.choices(["", "\t", " "])[0] + x + r.choice(["", " \r"]) for x in r.choices(pool, weights, k=r.randint(1, 12)))) for k in range(n)]
    return data + [(None, "hot LINE\nown"), (None, "hot line"), (3, None), (3, "hot line\nother"), (5, data[5][1]), (9000, "hot line\n" * 3000 + "end")]


@pytest.mark.parametrize("parts", [1, 7])
def test_same_as_brute_force(spark, parts):
    data = corpus(parts)
    spark.conf.set("spark.sql.shuffle.partitions", str(4 * parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.createDataFrame([Row(doc_id=d, text=t, pos=1, keep="clash") for d, t in data], "doc_id long, text string, pos int, keep string").repartition(5)
    got = sorted((tuple(r) for r in ld.line_digest(df).collect()), key=str)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == brute(data, 10)
    assert sum(g[2] for g in got) > 1000


def test_ranges_add_up(spark):
    """A line of 12 documents over ranges of 5, 4 and 3 (one document on a border) is dropped whole, one of 9 stays."""
    streams, rows = [], [(1, 1, d, 0, 0) for d in range(12)] + [(2, 2, d, 0, 0) for d in range(9)]
    for cut in (rows[:5], rows[4:8] + rows[8:14], rows[14:]):
        s = ld.Stream(10)
        s.rows(*map(list, zip(*cut)))
        s.finish()
        streams.append(s)
    found = []
    for part, s in enumerate(streams):
        found += s.out
        for (a, b), docs, first, last, edge in s.edges:
            found += [(a, b, *first, 0, False, part, docs, edge), (a, b, *last, 1, False, part, docs, edge)]
    got = ld.dropped_rows(spark.createDataFrame(found, ld.VERDICTS), 10).collect()
    assert {(r.id) for r in got} == set(range(12)) and all(r.tag == 0 for r in got)


def test_table_form_and_empty(spark):
    data = [(k, f"Shared\nown {k}") for k in range(10)] + [(20, None), (21, "")]
    df = spark.createDataFrame([Row(doc_id=d, text=t, lang="en", n_chars=0, doc="clash") for d, t in data], "doc_id long, text string, lang string, n_chars long, doc string")
    got = {r.doc_id: r for r in ld.line_dedup(df).collect()}
    assert got[3].text == "own 3" and got[3].n_chars == 5 and got[3].doc == "clash"
    assert got[20].text is None and got[21].text == ""
    assert ld.line_dedup(df).columns == df.columns
    assert ld.line_digest(df.limit(0)).collect() == [] and ld.line_dedup(df.limit(0)).collect() == []


def test_lines_of_one_first_hash_are_told_apart(spark, monkeypatch):
    """Two lines of six documents each that share the first hash both stay."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(ld, "first_hash", lambda key: F.lit(7).cast("long"))
    data = [(k, f"{'one' if k < 6 else 'two'}\nown {k}") for k in range(12)] + [(k, f"shared\nown {k}") for k in range(20, 30)]
    got = {r.doc_id: r.n_dropped for r in ld.line_digest(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {k: int(k >= 20) for k, _ in data}


def test_second_hash_does_not_follow_from_the_first(spark):
    """The hash of the key after a constant is not the hash that the first one gives as a seed."""
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("a",), ("b",)], "key string").select(ld.second_hash(F.col("key")).alias("h"), F.xxhash64("key", F.lit(ld._SEED)).alias("chained")).collect()
    assert all(r.h != r.chained for r in row)
