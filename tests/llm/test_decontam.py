import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Row

from tessera.llm import decontam as dc


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items):
    """Passages by the seeds' own rule, and items as a whole on every diagonal."""
    keys = defaultdict(set)
    bench = {(i, tuple(words(t))) for i, t in items if words(t)}
    for i, w in bench:
        for j in range(len(w)):
            for k, mask in enumerate(dc.MASKS):
                if j + max(mask) < len(w):
                    keys[(k, tuple(w[j + o] for o in mask))].add((i, w, j))
    out, whole = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for d, t in docs:
        w = words(t)
        for p in range(len(w)):
            for c in [(k, tuple(w[p + o] for o in mask)) for k, mask in enumerate(dc.MASKS) if p + max(mask) < len(w)]:
                for i, b, j in keys.get(c, ()):
                    width = min(dc.WINDOW, len(b))
                    best = 0
                    for s in range(max(0, j - dc.BEFORE), min(j, len(b) - width) + 1 if j <= len(b) - width else len(b) - width + 1):
                        best = max(best, sum(0 <= p - j + x < len(w) and w[p - j + x] == b[x] for x in range(s, s + width)))
                    if best >= math.ceil(width * dc.SIMILARITY):
                        out[(d, i)][0] += 1
                        out[(d, i)][1] = max(out[(d, i)][1], best)
        at = defaultdict(list)
        for p, x in enumerate(w):
            at[x].append(p)
        for i, b in bench:
            n, parts = len(b), len(b) // 5 + 1
            for first, same in Counter(p - j for j, x in enumerate(b) for p in at.get(x, ())).items():
                if same * 5 >= n * 4:
                    agree = [0 <= first + j < len(w) and w[first + j] == b[j] for j in range(n)]
                    whole[(d, i)][0] += sum(all(agree[k * n // parts : (k + 1) * n // parts]) for k in range(parts))
                    whole[(d, i)][1] = max(whole[(d, i)][1], same)
    return sorted(((d, i, *v) for (d, i), v in (whole | out).items()), key=str)


def corpus():
    r = random.Random(5)
    vocab = [f"w{k}é" for k in range(40)] + ["the", "of", "x1"]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(40, "of x1"), (41, "sub"), *((k, " ".join(text(r.choice([3, 4, 6, 8, 9, 12, 15, 30, 60])))) for k in range(25)), (30, "too short text"), (31, None), (32, ""), (3, " ".join(text(40)))]
    items += [items[4], (None, " ".join(text(20)))]
    docs = []
    for k in range(150):
        body = text(r.randint(0, 80))
        item = words(r.choice(items)[1])
        if k % 3 == 0 and item:
            part = item[r.randint(0, 3) :] if k % 2 else item
            part = [x if r.random() > r.choice([0, 0.1, 0.2]) else "sub" for x in part]
            at = r.randint(0, len(body))
            body = body[:at] + part + body[at:]
        docs.append((k, r.choice([" ", ", "]).join(body).upper() if k % 7 == 0 else " ".join(body)))
    return docs + [(None, items[4][1]), (5, None), (6, docs[6][1]), (200, "the " * 20000)], items


def test_same_as_brute_force(spark):
    docs, items = corpus()
    d = spark.createDataFrame([Row(doc_id=a, text=b, item_id="clash", key=1, bad_id=2) for a, b in docs], "doc_id long, text string, item_id string, key int, bad_id int")
    b = spark.createDataFrame([Row(item_id=a, text=t, doc_id="clash") for a, t in items], "item_id long, text string, doc_id string")
    want = brute(docs, items)
    assert len(want) > 30
    for at_once in (dc.SEEDS, 300):
        assert sorted((tuple(x) for x in dc.leaks(d, b, at_once).collect()), key=str) == want
    bad = {w[0] for w in want}
    left = dc.without_leaks(d, b)
    assert left.columns == d.columns
    by_row = {k for k, x in enumerate(docs) if brute([x], items)}
    assert sorted(str(tuple(x)[:2]) for x in left.collect()) == sorted(str(x) for k, x in enumerate(docs) if k not in by_row)
    assert {docs[k][0] for k in by_row} == bad
    assert dc.leaks(d.limit(0), b).collect() == [] and dc.leaks(d, b.limit(0)).collect() == []


def test_substitutions(spark):
    item = [f"a{k}" for k in range(26)]
    every5 = [x if k % 5 else "zz" for k, x in enumerate(item)]
    every3 = [x if k % 3 else "zz" for k, x in enumerate(item)]
    d = spark.createDataFrame([(1, " ".join(["q"] * 30 + every5)), (2, " ".join(every3)), (3, " ".join(item[:12])), (4, " ".join(item[7:20]))], "doc_id long, text string")
    b = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    assert {r.doc_id for r in dc.leaks(d, b).collect()} == {1, 3, 4}


def test_rows_not_ids_are_judged(spark):
    item = " ".join(f"a{k}" for k in range(20))
    rows = [(None, item), (None, "clean text"), (None, None), (1, f"so {item}"), (1, "another clean text"), (2, "clean text")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([(9, item)], "item_id long, text string")
    left = [tuple(r) for r in dc.without_leaks(d, b).collect()]
    assert sorted(left, key=str) == sorted([rows[1], rows[2], rows[4], rows[5]], key=str)


def test_whole_items_with_any_fifth_of_words_substituted(spark):
    import itertools

    r = random.Random(3)
    docs, want = [], set()
    items = [(n, [f"i{n}x{k}" for k in range(n)]) for n in (5, 6, 7, 8, 9, 10, 11, 12, 15, 16, 20, 25, 30, 40, 61)]
    for n, item in items:
        places = list(itertools.combinations(range(n), n // 5)) if n < 12 else [tuple(r.sample(range(n), n // 5)) for _ in range(40)]
        for places in places + ([(2, 7, 12)] if n == 15 else []):
            text = ["zz" if k in places else x for k, x in enumerate(item)]
            want.add((len(docs), n))
            docs.append((len(docs), " ".join(["q"] * r.randint(0, 9) + text + ["q"] * r.randint(0, 3))))
    for n, item in items:
        if n < 13:  # one word too many
            docs.append((len(docs), " ".join("zz" if k % 2 else x for k, x in enumerate(item))))
    docs.append((None, None))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id long, text string")
    for at_once in (dc.SEEDS, 40):
        got = dc.leaks(d, b, at_once).collect()
        assert {(x.doc_id, x.item_id) for x in got} == want and len(got) == len(want)
    assert {x.doc_id for x in dc.without_leaks(d, b).collect()} == {x[0] for x in docs} - {w[0] for w in want}
    assert dc.leaks(d.limit(0), b).collect() == [] and dc.leaks(d, b.limit(0)).collect() == []


def test_short_items(spark):
    items = {n: [f"s{n}x{k}" for k in range(n)] for n in range(1, 12)}
    swap = lambda n, *at: " ".join(["and", *("zz" if k in at else x for k, x in enumerate(items[n])), "so"])
    docs = [(1, swap(9, 4)), (2, swap(10, 3, 6)), (3, swap(11, 4, 6)), (4, swap(5, 2)), (5, swap(9, 1, 5)), (7, swap(11, 1, 4, 8))]
    docs += [(20 + n, swap(n)) for n in items] + [(40 + n, swap(n, 0)) for n in range(1, 5)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    want = {(1, 9, 8), (2, 10, 8), (3, 11, 9), (4, 5, 4)} | {(20 + n, n, n) for n in items}
    assert {(x.doc_id, x.item_id, x.agreeing) for x in dc.leaks(d, b).collect()} == want


def test_sql_has_the_same_rule(spark):
    """The registered SQL gives what the operator does, short items, ties and repeated rows among them."""
    duckdb = pytest.importorskip("duckdb")
    from tessera.llm.queries import ORACLE_SQL

    docs, items = corpus()
    db = duckdb.connect()
    for name, rows, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        db.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        db.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    assert sorted(db.sql(ORACLE_SQL["op7_decontamination"]).fetchall(), key=str) == brute(docs, items)
