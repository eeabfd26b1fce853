import math
import random
import zlib

import numpy as np

from tessera.llm import toxicity as tx


def brute_hits(texts):
    out = set()
    for k, t in enumerate(texts):
        code = []
        for c in t.lower():
            o = 32 if 0 < ord(c) <= 32 or ord(c) == 0xA0 else ord(c)
            if not (o == 32 and code[-1:] == [32]):
                code.append(o)
        for n in tx.SIZES:
            for i in range(len(code) - n + 1):
                h = 0
                for o in code[i : i + n]:
                    h = (h * int(tx._STEP) + o) % 2**64
                out.add((k, ((h ^ (h >> 31)) * int(tx._MIX) % 2**64) >> (64 - tx.BITS)))
    return out


def test_hits_same_as_brute_force():
    texts = ["", "ab", "Hello  World\n\tagain", "İstanbul é 東京 😀x", "a", " \n ", "aaaaaaaa", "end"]
    rows, buckets = tx.hits(texts, None)
    assert set(zip(rows.tolist(), buckets.tolist())) == brute_hits(texts)
    wanted = np.zeros(tx.BUCKETS, bool)
    wanted[buckets[::3]] = True
    rows, few = tx.hits(texts, wanted)
    assert set(zip(rows.tolist(), few.tolist())) == {h for h in brute_hits(texts) if wanted[h[1]]}


def corpus(n=1500):
    r = random.Random(8)
    words = ["".join(r.choices("aeioubcdst", k=r.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for k in range(n):
        body = r.choices(words, k=r.randint(1, 120))
        toxic = k % 8 == 0
        if toxic:
            for _ in range(r.randint(1, 4)):
                body.insert(r.randint(0, len(body)), r.choice(["zwurm", "Zwurmig", "kraxxo", "kraxx"]) + r.choice(["", "en", "!"]))
        docs.append((k, " ".join(body)))
        labels.append((k, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    extra = [(None, "zwurm kraxxo zwurm"), (5000, None), (5001, ""), (5002, "x " * 100_000), (3, docs[3][1])]
    df = spark.createDataFrame([(*d, "clash") for d in docs + extra], "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels + [(7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = tx.toxicity(df, lab).collect()
    assert len(got) == len(docs) + len(extra)
    truth = {k: t for k, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    stay = tx.without_toxic(df, lab)
    assert stay.columns == df.columns and {r.doc_id for r in stay.collect()} == {r.doc_id for r in got if not r.predicted}
    assert tx.toxicity(df.limit(0), lab).collect() == []


def test_ratios_weights_and_scores_same_as_brute_force(monkeypatch):
    """Ratios from counted sets, weights from plain proximal steps over all features, scores as sums over sets."""
    monkeypatch.setattr(tx, "AT_ONCE", 7)
    docs, labels = corpus(60)
    texts, y = [t[:80] for _, t in docs], np.array([t for *_, t in labels], float)
    own = [sorted(b for k, b in brute_hits([t])) for t in texts]
    totals = {0: 300, 1: 20}
    n = {k: int((y == k).sum()) for k in (0, 1)}
    ratio = {}
    for b in sorted(set().union(*own)):
        p, q = (sum(b in f for f, label in zip(own, y) if label == k) for k in (1, 0))
        ratio[b] = math.log((p + 1) / (n[1] + 2)) - math.log((q + 1) / (n[0] + 2))
    ends, column = np.cumsum([len(f) for f in own]), np.concatenate(own).astype(np.int32)
    got = tx.log_ratios(ends, column, y)
    assert set(np.flatnonzero(got)) <= set(ratio) and all(abs(got[b] - r) < 1e-12 for b, r in ratio.items())

    names = list(ratio)
    x = np.array([[ratio[b] if b in set(f) else 0.0 for b in names] for f in own])
    weight = np.where(y == 1, totals[1] / n[1], totals[0] / n[0])
    weight /= weight.sum()
    w, b = np.zeros(len(names)), 0.0
    steep = 0.3 * np.linalg.norm((x * weight[:, None]).T @ x, 2)
    for _ in range(60_000):
        e = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
        w = w - x.T @ e / steep
        w = np.sign(w) * np.maximum(np.abs(w) - tx.PENALTY / steep, 0)
        b -= e.sum() / 0.3
    model = tx.learn([np.array(f) for f in own], y, totals)
    loss = lambda z, size: -(weight * (y * np.log(z) + (1 - y) * np.log(1 - z))).sum() + tx.PENALTY * size
    z = 1 / (1 + np.exp(-(x @ w + b)))
    scores = tx.score_texts(model, texts)
    mine = np.array([1 / (1 + math.exp(-model.intercept - sum(float(model.weights[b]) for b in f))) for f in own])
    assert np.allclose(scores, mine, atol=1e-6) and np.allclose(scores, z, atol=0.02)
    size = sum(abs(float(model.weights[b]) / r) for b, r in ratio.items() if r)
    assert loss(scores, size) < loss(z, np.abs(w).sum()) * 1.01
    assert 0 < np.count_nonzero(model.weights) < len(names)


def test_sample_is_bounded_and_whole(spark):
    docs, labels = corpus(400)
    docs += [(9, "short")] * 50
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    known = dict(docs[:400]) | {9: "short"}
    rows, totals = tx.training_rows(df, lab, 30, 4000)
    got = rows.collect()
    for label in (0, 1):
        sizes = [len(r.text) for r in got if r.toxic == label]
        assert 0 < len(sizes) <= 30 and sum(sizes) - max(sizes) < 4000
    assert all(r.text == known[r.doc_id] for r in got) and len({r.doc_id for r in got}) == len(got)
    learnable = [k for k, *_ in labels if zlib.crc32(str(k).encode()) % 5]
    assert sum(totals.values()) == len(learnable)
    rows, _ = tx.training_rows(df, lab, 1000, 10**9)
    assert {r.doc_id for r in rows.collect()} == set(learnable)


def test_labels_of_held_out_rows_do_not_count(spark):
    docs, labels = corpus(400)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    flip = [(k, q, 1 - t if zlib.crc32(str(k).encode()) % 5 == 0 else t) for k, q, t in labels]
    one, two = (sorted(tuple(r) for r in tx.toxicity(df, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()) for x in (labels, flip))
    assert one == two


def test_one_label_only(spark):
    df = spark.createDataFrame([(k, "text") for k in range(20)], "doc_id long, text string")
    lab = spark.createDataFrame([(k, 0, 0) for k in range(20)], "doc_id long, quality int, toxic int")
    assert all(r.predicted == 0 for r in tx.toxicity(df, lab).collect())
    assert len(tx.toxicity(df, lab.limit(0)).collect()) == 20
