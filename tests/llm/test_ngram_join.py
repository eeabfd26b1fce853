import random
import re

import numpy as np
import pytest

from tessera.llm import ngram_join as nj


def grams(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def order(text):
    return tuple(re.findall(r"[^\W_]+", (text or "").lower()))


def brute(data):
    n, sets, words = len(data), [grams(t) for _, t in data], [order(t) for _, t in data]
    links, parent = [0] * n, list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(n):
        for y in range(x + 1, n):
            both, either = len(sets[x] & sets[y]), len(sets[x] | sets[y])
            copies = words[x] == words[y]
            if copies or both and both >= 0.8 * either:
                links[x] += 1
                links[y] += 1
                parent[root(x)] = root(y)
    groups = {}
    for x in range(n):
        groups.setdefault(root(x), []).append(x)
    out = []
    for members in groups.values():
        ids = [data[x][0] for x in members if data[x][0] is not None]
        out += [(data[x][0], min(ids, default=None), len(members), links[x]) for x in members]
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)] + ["é", "the"]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    data = []
    for base in range(12):
        body = text(r.choice([8, 30, 60, 150]))
        for _ in range(r.choice([1, 3, 25])):
            other = list(body)
            for _ in range(r.randint(0, max(1, len(body) // 40))):
                other[r.randrange(len(other))] = r.choice(vocab)
            data.append(" ".join(other))
    body = text(150)
    data += [" ".join([*body[:k], "x%d" % k, *body[k + 1 :]]) for k in range(0, 150, 4)]
    passage = text(40)
    data += [" ".join(text(25) + passage + text(25)) for _ in range(40)]
    data += [data[0], data[1].upper(), data[2].replace(" ", ", "), "", None, "...", "one two", "One, two", "three"]
    rows = [(k * 7 % 1009, t) for k, t in enumerate(data)]
    return rows + [(None, data[0]), (None, "alone here"), (None, "alone here"), (5000, data[3]), (5000, data[3]), (5000, data[20]), (6000, "long text " * 20000)]


@pytest.mark.parametrize("seed,run,block,selected", [(1, 256, 128, 1_000_000), (2, 7, 5, 0), (3, 1, 12, 1_000_000)])
def test_same_as_brute_force(spark, monkeypatch, seed, run, block, selected):
    """With runs and groups in one piece and in many blocks, and texts selected by a broadcast and by a shuffle."""
    monkeypatch.setattr(nj, "BLOCK_TEXTS", run)
    monkeypatch.setattr(nj, "GROUP_TEXTS", block)
    monkeypatch.setattr(nj, "SELECTED", selected)
    data = corpus(seed)
    df = spark.createDataFrame([(d, t, "clash") for d, t in data], "doc_id long, text string, keep_id string").repartition(3)
    got = sorted((tuple(x) for x in nj.ngram_join(df).collect()), key=str)
    assert got == brute(data)
    assert max(g[2] for g in got) > 20
    if seed == 1:
        stay = nj.one_of_each(df)
        assert stay.columns == df.columns
        kept = stay.collect()
        assert {x.doc_id for x in kept} == {g[1] for g in got} and len(kept) == round(sum(1 / g[2] for g in got))
        assert nj.ngram_join(df.limit(0)).collect() == []


def test_one_row_of_each_class_stays(spark):
    body = " ".join(f"v{k}" for k in range(60))
    rows = [(None, body), (None, body + " end"), (None, "one alone"), (None, "one alone"), (None, "two alone"), (4, "apart from others"), (4, "another text"), (4, "another text"), (2, body), (3, None), (None, "")]
    stay = sorted((tuple(r) for r in nj.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert stay == sorted([(2, body), (None, "one alone"), (None, "two alone"), (4, "apart from others"), (4, "another text"), (3, None)], key=str)


def chain(n):
    """Texts of which only neighbours are similar, so that a group of many blocks is one long chain."""
    words = [f"c{k}" for k in range(4 * n + 120)]
    return [(k, " ".join(words[4 * k : 4 * k + 60])) for k in range(n)]


def test_a_chain_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(nj, "GROUP_TEXTS", 4)
    data = chain(60)
    got = sorted((tuple(x) for x in nj.ngram_join(spark.createDataFrame(data, "doc_id long, text string")).collect()), key=str)
    assert got == brute(data) and {g[2] for g in got} == {60}


def test_rows_grow_with_members(spark, monkeypatch):
    """Twice the near copies of one text give about twice the rows at every step, in runs and in blocks."""
    monkeypatch.setattr(nj, "BLOCK_TEXTS", 8)
    monkeypatch.setattr(nj, "GROUP_TEXTS", 8)
    seen = {}
    monkeypatch.setattr(nj, "written", lambda df, name, f=nj.written: (out := f(df, name), seen.setdefault(name, []).append(out.count()))[0])
    body = [f"b{k}" for k in range(150)]
    rows = []
    for n in (75, 150):
        seen.clear()
        data = [(k, " ".join([*body[:k], f"x{k}", *body[k + 1 :]])) for k in range(n)]
        got = nj.ngram_join(spark.createDataFrame(data, "doc_id long, text string")).collect()
        assert {r.class_size for r in got} == {n} and {r.n_links for r in got} == {n - 1}
        rows.append({k: sum(v) for k, v in seen.items()})
    assert all(rows[1][k] <= 2.6 * rows[0][k] + 20 for k in rows[1]), rows


def test_floor_and_similar():
    assert nj.floor_for(0.9) == 8 and nj.floor_for(0.9999) == 6 and nj.floor_for(1.0) == 1
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(400) < 0.93], rng.integers(0, 2**63, 20).astype(np.uint64)])) for _ in range(60)]
    want = [(x, y) for x in range(60) for y in range(60) if x == y or len(np.intersect1d(sets[x], sets[y])) >= 0.8 * len(np.union1d(sets[x], sets[y]))]
    assert 60 < len(want) < 3600
    assert list(zip(*(c.tolist() for c in nj.similar(sets, sets, 0.8)))) == want
    assert list(zip(*(c.tolist() for c in nj.similar(sets[:16], sets[16:], 0.8)))) == [(x, y - 16) for x, y in want if x < 16 <= y]
    block = nj.Block(np.arange(60), np.arange(60) * 2, np.ones(60, np.int64), sets)
    back = nj.Block.unpack(block.pack())
    assert all((a == b).all() for a, b in zip(back.sets, sets, strict=True)) and (back.label == block.label).all() and (back.copies == 1).all()


def test_signature_estimates():
    rng = np.random.default_rng(2)
    x = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    y = np.concatenate([x[: len(x) * 8 // 10], rng.integers(0, 2**63, len(x) // 5).astype(np.uint64)])
    assert abs((nj.signature(x) == nj.signature(y)).mean() - 2 / 3) < 0.1
    assert (nj.signature(x[:1500]) == nj.signature(x[1500:])).mean() < 0.03
