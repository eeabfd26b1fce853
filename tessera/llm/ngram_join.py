"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Texts are sets of word 5-grams. Documents with the same words in the same order
are copies of one class and enter once, as a representative. Each representative
has a signature of min-hashes, and ``TREES`` trees each sort the representatives
by a row of them: a sorted prefix trie, dealt by ranges, in which texts that
share a prefix stand next to each other.

Matching starts with the longest prefix. A run of nodes that share it is compared
by whole signatures, with a margin of several standard errors, and nodes that are
alike are joined. Prefixes are then shortened level by level, each run by itself: a
run that its nodes' groups have joined already is left as it is, any other is
matched again, down to the length at which a pair at the threshold shares a prefix
in some tree with the target recall (``floor_for``). A run over ``BLOCK_TEXTS`` nodes
is joined as a whole, which may add to a group but loses nothing.

Groups are verified by comparing all pairs of their 5-gram sets (of 64-bit gram
hashes). A small group is the work of one cell. A large one is cut into blocks, which
are stored once; a task reads its own block, streams the others past it and returns
one row a member: its number of links and the least label it is linked with. Labels
that are linked merge until no task finds another link between two of them. So rows
stay in proportion to members, however large a group of near copies is, and no pair
is left out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import importable, new_dir, open_input, open_output, unused, written
from tessera.llm.simple8b import text_batches

WORDS = 5
THRESHOLD = 0.8
TREES = 32
#: Min-hashes in a tree's row: the longest prefix.
DEPTH = 8
RECALL = 0.9999
#: Pairs whose signatures agree in less than THRESHOLD minus this are no candidates: four standard errors, about 1 pair in 20,000 at the threshold.
MARGIN = 0.1
#: Nodes of a run that are compared with each other; members, and 5-grams, in a block of a group.
BLOCK_TEXTS = 256
GROUP_TEXTS = 128
BLOCK_GRAMS = 1_000_000
#: Texts that may be selected by a broadcast of their keys, of 40 bytes each; more are selected by a shuffle.
SELECTED = 1_000_000
_WORD = re.compile(r"[^\W_]+")
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 2**32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32)
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Grams:
    """Word hashes of texts; a worker keeps those of frequent words."""

    KEPT = 250_000

    def __init__(self):
        self.known: dict[str, int] = {}

    def words(self, text: str | None) -> np.ndarray:
        import xxhash

        found = _WORD.findall((text or "").lower())
        known = self.known
        if len(known) > self.KEPT:
            known.clear()
        for w in set(found).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))

    @staticmethod
    def grams(words: np.ndarray) -> np.ndarray:
        """The sorted set of 5-gram hashes; a shorter text is one gram, a text without words none."""
        if not len(words):
            return np.zeros(0, np.uint64)
        n = max(1, len(words) - WORDS + 1)
        h = np.zeros(n, np.uint64)
        for k in range(min(WORDS, len(words))):
            h = mix(h * _P + words[k : k + n])
        return np.unique(h)


_grams = Grams()


def copy_class(words: np.ndarray) -> tuple[int, int]:
    """Two hashes of the words in order."""
    powers = np.cumprod(np.full(len(words), _P)) if len(words) else words
    one = mix(np.array([(words * powers).sum() + np.uint64(len(words))], np.uint64))
    two = mix(np.array([(mix(words + _Q) * powers).sum() ^ _Q], np.uint64))
    return int(one.view(np.int64)[0]), int(two.view(np.int64)[0])


def signature(grams: np.ndarray) -> np.ndarray:
    """16 mixed bits of each min-hash, most significant byte first."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_A), 2**32 - 1, np.uint32)
    for lo in range(0, len(x), 2048):
        part = x[lo : lo + 2048]
        np.minimum(least, (part[None, :] * _A[:, None] + _B[:, None]).min(axis=1), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2")


def floor_for(recall: float, threshold: float = THRESHOLD, trees: int = TREES, deepest: int = DEPTH) -> int:
    """The longest prefix that a pair at the threshold shares in some tree with this probability."""
    depth = deepest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, tag (a hash of the text), c1, c2 (copy class), n (5-grams) and sig of every row."""
    importable(docs.sparkSession)

    def sign(batches: Iterable) -> Iterator:
        import pyarrow as pa

        from tessera.llm import ngram_join as nj

        for batch in batches:
            at = 0
            for ids, texts in text_batches([batch.select([0, 1])], 2_000_000):
                rows = []
                for text in texts:
                    words = nj._grams.words(text)
                    grams = Grams.grams(words)
                    rows.append((*copy_class(words), len(grams), signature(grams).tobytes()))
                c1, c2, n, sig = zip(*rows, strict=True)
                columns = [pa.array(ids, pa.int64()), batch.column(2).slice(at, len(ids)), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(n, pa.int32()), pa.array(sig, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "tag", "c1", "c2", "n", "sig"])
                at += len(ids)

    rows = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")), F.xxhash64(text_col))
    return rows.mapInArrow(sign, "id long, tag long, c1 long, c2 long, n int, sig binary")


def run_name(depth: int) -> str:
    """The column of ``forest`` that names the run of a prefix length."""
    return f"run{depth}"


def forest(reps: DataFrame, floor: int) -> DataFrame:
    """node, and run8 to run<floor>: its runs of equal prefixes of each length, where others may share the shortest.

    A row a node and tree. Runs at the ends of a range may go on in the next
    one, so their rows are returned even if they are alone.
    """
    depths = range(DEPTH, floor - 1, -1)
    schema = "node long, " + ", ".join(f"{run_name(d)} long" for d in depths)

    def trees(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            node = np.asarray(batch.column(0))
            if not len(node):
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(len(node), TREES, DEPTH)
            key = np.ascontiguousarray(sig).view(">i8").reshape(len(node), TREES, 2)
            for t in range(TREES):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), t, np.int32)), pa.array(key[:, t, 0].astype(np.int64)), pa.array(key[:, t, 1].astype(np.int64)), pa.array(node)], names=["tree", "k1", "k2", "node"])

    def prefix(rows: np.ndarray, depth: int) -> np.ndarray:
        """Tree and the first ``depth`` min-hashes of each row."""
        cut = lambda k, levels: k >> np.int64(16 * (4 - levels)) if levels else np.zeros_like(k)
        return np.stack([rows[0], cut(rows[1], min(depth, 4)), cut(rows[2], max(0, depth - 4))])

    def code(key: np.ndarray, depth: int) -> np.ndarray:
        u = key.view(np.uint64)
        return mix(mix(mix(u[0] * np.uint64(64) + np.uint64(depth)) ^ u[1]) ^ u[2]).view(np.int64)

    def runs(batches: Iterable) -> Iterator:
        import pyarrow as pa

        held: list[np.ndarray] = []  # the last run, which may go on
        first = True

        def out(rows: np.ndarray, ends: tuple[bool, bool]) -> Iterator:
            key = prefix(rows, floor)
            new = np.ones(rows.shape[1], bool)
            new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
            run = np.cumsum(new) - 1
            keep = np.bincount(run)[run] > 1
            if ends[0]:
                keep |= run == 0
            if ends[1]:
                keep |= run == run[-1]
            if keep.any():
                rows = rows[:, keep]
                yield pa.RecordBatch.from_arrays([pa.array(rows[3]), *(pa.array(code(prefix(rows, d), d)) for d in depths)], names=["node", *map(run_name, depths)])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([np.asarray(c).astype(np.int64) for c in batch.columns])
            key = prefix(rows, floor)
            if held and (key[:, 0] == key[:, -1]).all() and (prefix(held[0][:, :1], floor)[:, 0] == key[:, 0]).all():
                held.append(rows)  # a run over many batches
                continue
            rows = np.concatenate([*held, rows], axis=1)
            key = prefix(rows, floor)
            last = int(np.flatnonzero((key != key[:, -1:]).any(axis=0)).max(initial=-1)) + 1
            if last:
                yield from out(rows[:, :last], (first, False))
                first = False
            held = [rows[:, last:]]
        if held:
            yield from out(np.concatenate(held, axis=1), (first, True))

    order = ["tree", "k1", "k2", "node"]
    rows = reps.select("node", "sig").mapInArrow(trees, "tree int, k1 long, k2 long, node long")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(runs, schema)


def cells(rows: DataFrame, group: str, compare: Callable, schema: str) -> DataFrame:
    """Gather each (bounded) group of rows and call ``compare(rows as Arrow table)`` on it."""

    def walk(batches: Iterable) -> Iterator:
        import pyarrow as pa

        held, now = [], None

        def done() -> Iterator:
            if held:
                yield from compare(pa.Table.from_batches(held)).to_batches()

        for batch in batches:
            g = np.asarray(batch[group])
            if not len(g):
                continue
            starts = np.flatnonzero(np.append(True, g[1:] != g[:-1])).tolist()
            for a, b in zip(starts, [*starts[1:], len(g)], strict=True):
                if now is None or int(g[a]) != now:
                    yield from done()
                    held, now = [], int(g[a])
                held.append(batch.slice(a, b - a))
        yield from done()

    return rows.repartition(group).sortWithinPartitions(group, "node").mapInArrow(walk, schema)


class Labels:
    """Sets of labels that merge; each is named by its least label."""

    def __init__(self, labels: Iterable[int]):
        self.parent = {int(x): int(x) for x in labels}

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def merge(self, a: Iterable[int], b: Iterable[int]) -> None:
        for x, y in zip(a, b, strict=True):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.parent[max(x, y)] = min(x, y)

    def star(self) -> list[tuple[int, int]]:
        """Each label but the least of its set, with that one."""
        return [(k, r) for k in self.parent if (r := self.root(k)) != k]


def alike(sig: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that agree in at least ``least`` places, x < y."""
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(len(sig) - 1):
        y = np.flatnonzero((sig[k + 1 :] == sig[k]).sum(axis=1) >= least) + k + 1
        xs.append(np.full(len(y), k))
        ys.append(y)
    return np.concatenate(xs), np.concatenate(ys)


def _pairs(links: list[tuple[int, int]]):
    import pyarrow as pa

    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def candidates(reps: DataFrame, floor: int) -> DataFrame:
    """node, comp: groups of representatives that the forest joins, from the longest prefix to the shortest."""
    least = int(np.ceil((THRESHOLD - MARGIN) * TREES * DEPTH))
    tries = written(forest(reps, floor), "runs")
    sigs = reps.select("node", "sig")

    def compare(table):
        comp = np.asarray(table["comp"])
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), "u2").reshape(len(comp), -1)
        x, y = alike(sig, least)
        sets = Labels(comp)
        sets.merge(comp[x].tolist(), comp[y].tolist())
        return _pairs(sets.star())

    names = None
    for depth in range(DEPTH, floor - 1, -1):
        rows = tries.select(F.col(run_name(depth)).alias("run"), "node")
        rows = rows.withColumn("comp", F.col("node")) if names is None else named(rows, names)
        sizes = rows.groupBy("run").agg(F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        apart = written(sizes.filter("low <> high").select("run", "size", "low"), "runs-apart")
        rows = rows.join(apart, "run")
        small = cells(rows.filter(F.col("size") <= BLOCK_TEXTS).select("run", "node", "comp").join(sigs, "node"), "run", compare, "a long, b long")
        large = rows.filter((F.col("size") > BLOCK_TEXTS) & (F.col("comp") != F.col("low"))).select(F.col("comp").alias("a"), F.col("low").alias("b"))
        names = renamed(names, components(small.unionByName(large).distinct()))
    return names


def named(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` with the comp of their node, which is the node itself unless ``names`` has it."""
    return rows.join(names, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def renamed(names: DataFrame | None, step: DataFrame) -> DataFrame:
    """``names`` (node, comp) after the comps in ``step`` (node, comp) have got new ones."""
    if names is None:
        return step
    old = names.join(step.select(F.col("node").alias("comp"), F.col("comp").alias("new")), "comp", "left").select("node", F.coalesce("new", "comp").alias("comp"))
    return written(old.unionByName(step.join(names, "node", "left_anti").select("node", "comp")), "components")


def components(links: DataFrame) -> DataFrame:
    """node, comp: the least node linked with each node, over any number of steps.

    Each round every node takes the least of itself and its neighbours, and links
    between the taken names remain; rounds end when none does. Only tables of
    nodes and links move, and each round is written out.
    """
    names = None
    links = written(links.filter("a <> b").select("a", "b"), "links")
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("old"), F.least("a", "m").alias("new")), "least")
        one = links.join(least.select(F.col("old").alias("a"), F.col("new").alias("x")), "a")
        two = one.join(least.select(F.col("old").alias("b"), F.col("new").alias("y")), "b")
        links = written(two.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        step = least.select(F.col("old").alias("node"), F.col("new").alias("comp"))
        if names is None:
            names = step
        else:
            names = written(names.join(step.select(F.col("node").alias("comp"), F.col("comp").alias("new")), "comp", "left").select("node", F.coalesce("new", "comp").alias("comp")), "components")
    return names if names is not None else links.select(F.col("a").alias("node"), F.col("b").alias("comp"))


class Block:
    """Members of a group: node, label, copies and gram sets."""

    def __init__(self, node: np.ndarray, label: np.ndarray, copies: np.ndarray, sets: list[np.ndarray]):
        self.node, self.label, self.copies, self.sets = node, label, copies, sets

    @classmethod
    def of(cls, table) -> Block:
        return cls(*(np.asarray(table[c]) for c in ("node", "label", "copies")), [np.frombuffer(g, "<u8") for g in table["grams"].to_pylist()])

    def pack(self) -> bytes:
        sizes = np.array([len(s) for s in self.sets])
        return b"".join(x.astype("<i8").tobytes() for x in (np.array([len(sizes)]), self.node, self.label, self.copies, sizes)) + np.concatenate(self.sets).astype("<u8").tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> Block:
        n = int(np.frombuffer(data, "<i8", 1)[0])
        node, label, copies, sizes = np.frombuffer(data, "<i8", 4 * n, 8).reshape(4, n)
        return cls(node, label, copies, np.split(np.frombuffer(data, "<u8", offset=8 * (4 * n + 1)), np.cumsum(sizes)[:-1]))


def verified(docs: DataFrame, reps: DataFrame, groups: DataFrame, id_col: str, text_col: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Exact comparison within groups: (node, links) of linked nodes, copies of others counted, and their (node, comp)."""
    wanted = written(groups.join(reps.select("node", "id", "tag", "c1", "c2", "n", "copies"), "node"), "group-members")
    sizes = wanted.groupBy("comp").agg(F.count("*").alias("size"), F.sum("n").alias("heavy"))
    blocks = F.ceil(F.greatest(F.col("size") / GROUP_TEXTS, F.col("heavy") / BLOCK_GRAMS)).cast("int")
    sizes = written(sizes.select("comp", blocks.alias("blocks")), "group-sizes")
    sets = wanted.select("node", "comp", "copies").join(_gram_sets(docs, wanted, id_col, text_col), "node").join(sizes, "comp")
    sets = written(sets.withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")), "group-sets")

    def compare(table):
        import pyarrow as pa

        own = Block.of(table)
        count, low = links_of(own, [own], threshold)
        has = np.flatnonzero(count)
        return pa.table({"node": own.node[has], "low": low[has], "links": count[has]})

    small = written(cells(sets.filter("blocks = 1").withColumn("label", F.col("node")), "comp", compare, "node long, low long, links long"), "links-of-small-groups")
    counts, comps = _large_groups(sets.filter("blocks > 1"), threshold)
    within = components(small.select(F.col("node").alias("a"), F.col("low").alias("b")))
    if counts is None:
        return small.select("node", "links"), within
    return small.select("node", "links").unionByName(counts), within.unionByName(comps)


def _large_groups(sets: DataFrame, threshold: float) -> tuple[DataFrame | None, DataFrame | None]:
    """As ``verified``, for groups of several blocks: rounds of block tasks until no two labels of a group are linked."""
    counts = names = None
    left = written(sets.select("comp").distinct(), "groups-left")
    while not left.isEmpty():
        own = sets.join(left, "comp", "left_semi").select("comp", "block", "node", "copies", "grams")
        own = own.withColumn("label", F.col("node")) if names is None else named(own.withColumnRenamed("comp", "g"), names).withColumnsRenamed({"comp": "label", "g": "comp"})
        found = written(_compared(_stored(own), threshold), "links-of-large-groups")
        if counts is None:
            counts = found.filter("links > 0").select("node", "links")
        step = components(found.select(F.col("label").alias("a"), F.col("low").alias("b")))
        left = written(found.filter("label <> low").select("comp").distinct(), "groups-left")  # others have found all their links
        names = renamed(names, step)
    return counts, names


def _stored(members: DataFrame) -> DataFrame:
    """Write each block of each group once; comp, block, and where it lies."""
    folder = new_dir(members.sparkSession, "group-blocks")

    def store(batches: Iterable) -> Iterator:
        import uuid

        import pyarrow as pa

        out, path, at, held, now = None, f"{folder}/{uuid.uuid4().hex}", 0, [], None

        def done() -> Iterator:
            nonlocal out, at
            if held:
                out = out or open_output(path)
                data = Block.of(pa.Table.from_batches(held)).pack()
                out.write(data)
                yield pa.RecordBatch.from_pydict({"comp": pa.array([now[0]]), "block": pa.array([now[1]], pa.int32()), "path": [path], "at": pa.array([at]), "size": pa.array([len(data)])})
                at += len(data)

        for batch in batches:
            comp, block = np.asarray(batch["comp"]), np.asarray(batch["block"])
            if not len(comp):
                continue
            starts = np.flatnonzero(np.append(True, (comp[1:] != comp[:-1]) | (block[1:] != block[:-1]))).tolist()
            for a, b in zip(starts, [*starts[1:], len(comp)], strict=True):
                if (key := (int(comp[a]), int(block[a]))) != now:
                    yield from done()
                    held, now = [], key
                held.append(batch.slice(a, b - a))
        yield from done()
        if out:
            out.close()

    dealt = members.repartition("comp", "block").sortWithinPartitions("comp", "block", "node")
    return written(dealt.mapInArrow(store, "comp long, block int, path string, at long, size long"), "block-manifest")


def _compared(blocks: DataFrame, threshold: float) -> DataFrame:
    """comp, node, label, low, links of every member of the stored blocks; a task streams a group past one of its blocks."""
    where = F.struct("path", "at", "size")
    lists = written(blocks.groupBy("comp").agg(F.sort_array(F.collect_list(where)).alias("group")), "block-lists")  # a place a block, of GROUP_TEXTS members
    tasks = blocks.select("comp", "block", where.alias("own")).join(lists, "comp").repartition("comp", "block")

    def compare(batches: Iterable) -> Iterator:
        import pyarrow as pa

        files: dict[str, object] = {}

        def read(place: dict) -> Block:
            if place["path"] not in files:
                if len(files) > 100:
                    files.clear()
                files[place["path"]] = open_input(place["path"])
            return Block.unpack(files[place["path"]].read_at(place["size"], place["at"]))

        for batch in batches:
            for row in batch.to_pylist():
                own = read(row["own"])
                others = (own if place == row["own"] else read(place) for place in row["group"])
                count, low = links_of(own, others, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(count), row["comp"])), *map(pa.array, (own.node, own.label, low, count))], names=["comp", "node", "label", "low", "links"])

    return tasks.mapInArrow(compare, "comp long, node long, label long, low long, links long")


def links_of(own: Block, others: Iterable[Block], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each member of ``own`` the copies it is linked with, and the least label that its links lead to within ``own``."""
    count, low = np.zeros(len(own.node), np.int64), own.label.copy()
    within = Labels(own.label)
    for other in others:
        x, y = similar(own.sets, other.sets, threshold)
        if other is own:
            x, y = x[x != y], y[x != y]
            within.merge(own.label[x].tolist(), own.label[y].tolist())
        np.add.at(count, x, other.copies[y])
        np.minimum.at(low, x, other.label[y])
    least: dict[int, int] = {}
    roots = [within.root(k) for k in own.label.tolist()]
    for r, k in zip(roots, low.tolist(), strict=True):
        least[r] = min(k, least.get(r, k))
    return count, np.array([least[r] for r in roots], np.int64)


def _gram_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node and grams (sorted 64-bit hashes) of the wanted documents, from their texts."""
    importable(docs.sparkSession)

    def cut(batches: Iterable) -> Iterator:
        import pyarrow as pa

        from tessera.llm import ngram_join as nj

        for batch in batches:
            at = 0
            for nodes, texts in text_batches([batch.select([0, 1])], 2_000_000):
                own, sets = [], []
                c1, c2 = (batch.column(k).slice(at, len(nodes)).to_pylist() for k in (2, 3))
                at += len(nodes)
                for node, text, one, two in zip(nodes, texts, c1, c2, strict=True):
                    words = nj._grams.words(text)
                    if copy_class(words) == (one, two):  # not another text of the same hash
                        own.append(node)
                        sets.append(Grams.grams(words).astype("<u8").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(sets, pa.binary())], names=["node", "grams"])

    keys = wanted.select(F.xxhash64("id", "tag").alias("w_key"), F.col("id").alias("w_id"), F.col("tag").alias("w_tag"), "node", "c1", "c2")
    few = wanted.count() <= SELECTED
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tag"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    on = (F.xxhash64("id", "tag") == F.col("w_key")) & F.col("id").eqNullSafe(F.col("w_id")) & (F.col("tag") == F.col("w_tag"))
    picked = texts.join(F.broadcast(keys) if few else keys.hint("shuffle_hash"), on)
    sets = picked.select("node", "text", "c1", "c2").mapInArrow(cut, "node long, grams binary")
    return sets.dropDuplicates(["node"])  # a repeated row brings its text again


def similar(one: list[np.ndarray], two: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs x of ``one`` and y of ``two``, sets with a Jaccard similarity of at least ``threshold``, exactly."""
    sets = one if two is one else [*one, *two]
    n = np.array([len(s) for s in sets])
    first, second = n[: len(one)], n[len(sets) - len(two) :]
    rows = np.repeat(np.arange(len(sets)), n)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1  # a gram of one set is in no intersection
    place = np.cumsum(shared) - 1
    use = shared[column]
    rows, column = rows[use], place[column[use]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    both = np.zeros((len(one), len(two)), np.float32)
    width = 4096
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [lo, lo + width])
        dense = np.zeros((len(sets), width), np.float32)
        dense[rows[a:b], column[a:b] - lo] = 1
        both += dense[: len(one)] @ dense[len(sets) - len(two) :].T
    either = first[:, None] + second[None, :] - both
    if two is one:
        np.fill_diagonal(both, first)
        np.fill_diagonal(either, first)
    return np.nonzero(both >= threshold * either - 1e-6)


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows (id, tag, c1, c2), and c1, c2, class_id, class_size, n_links and the kept row (id, tag) of all representatives."""
    importable(docs.sparkSession)
    rows = written(signed(docs, id_col, text_col), "signatures")
    least = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "tag"))
    groups = rows.groupBy("c1", "c2").agg(least.alias("least"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    reps = written(groups.select(F.monotonically_increasing_id().alias("node"), "c1", "c2", "least", "least.id", "least.tag", "copies", "n", "sig"), "representatives")
    known = reps.filter("n > 0")
    near = candidates(known, floor_for(recall, threshold))
    counts, comps = verified(docs, known, near, id_col, text_col, threshold)
    linked = named(reps.select("node", "c1", "c2", "least", "copies"), comps).join(counts, "node", "left")
    linked = written(linked.select("c1", "c2", "comp", "least", "copies", F.coalesce("links", F.lit(0)).alias("others")), "linked")
    classes = written(linked.groupBy("comp").agg(F.min("least").alias("kept"), F.sum("copies").alias("class_size")), "classes")
    of_rep = linked.join(classes, "comp").select("c1", "c2", F.col("kept.id").alias("class_id"), F.col("kept.tag").alias("kept_tag"), "class_size", (F.col("copies") - 1 + F.col("others")).alias("n_links"))
    return rows.select("id", "tag", "c1", "c2"), written(of_rep, "of-representatives")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, class_size, n_links of every row.

    ``n_links``: other rows whose 5-gram sets have a Jaccard similarity of at
    least ``threshold``, copies among them. ``class_id``: the smallest doc_id in
    the class, all rows connected by links; ``class_size``: its rows. Null text
    has no words; all texts without words are copies of each other, and texts of
    fewer than five words are one gram; very long texts are cut into blocks of fewer
    members. Rows without a doc_id are linked like others; a class of such rows only
    has a null class_id. Repeated rows are copies. An empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    rows, of_rep = _classes(docs, id_col, text_col, threshold, recall)
    return rows.select(F.col("id").alias("doc_id"), "c1", "c2").join(of_rep, ["c1", "c2"]).select("doc_id", "class_id", "class_size", "n_links")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of ``docs`` of each class, that of the smallest doc_id, all columns as they were.

    A row without a doc_id stays only if its whole class has none. Of rows with
    the same doc_id and text one stays, of texts under one doc_id that of the
    smallest hash. Null and empty texts are one class; an empty table stays empty.
    """
    rows, of_rep = _classes(docs, "doc_id", "text", threshold, RECALL)
    judged = rows.join(of_rep, ["c1", "c2"]).groupBy("id", "tag").agg(
        F.count("*").alias("n"), F.max(F.col("id").eqNullSafe(F.col("class_id")) & (F.col("tag") == F.col("kept_tag"))).alias("stays")
    )
    judged = written(judged.filter("n > 1 OR NOT stays"), "rows-that-go")
    names = {c: unused(docs, f"gone_{c}") for c in ("id", "tag")}
    own_id, own_tag = F.col("doc_id").cast("long"), F.xxhash64("text")

    def met(which: DataFrame, how: str) -> DataFrame:
        side = which.select(*[F.col(c).alias(x) for c, x in names.items()])
        on = (F.xxhash64(own_id, own_tag) == F.xxhash64(*names.values())) & own_id.eqNullSafe(F.col(names["id"])) & (own_tag == F.col(names["tag"]))
        return docs.join(side, on, how)

    single = met(judged, "left_anti")
    again = judged.filter("n > 1 AND stays")
    return single if again.isEmpty() else single.unionByName(met(again, "left_semi").dropDuplicates(["doc_id", "text"]))
