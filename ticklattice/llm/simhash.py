"""Operator 3, SimHash near-dedup: 64-bit fingerprints, BK-trees over shards that share fingerprint blocks, components."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticklattice.llm._util import Scratch, as_table, connected_components, map_text

#: Most fingerprints of one shard; a BK-tree holds a shard, a task two.
SHARD = 2048
#: Nodes of which a list may be broadcast (a digest and a rank each, 25 MB at most), and pairs of one text that meet in one task.
FEW_NODES, HOT = 250_000, 256
#: Shingles under which two sets differ in more bits, and first shingles of a text that each of its rows carries along.
FEW_SHINGLES, HEAD = 8, 4
SEED = 42


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased, split at [\\x20\\x09-\\x0D]+ (what bytes.lower and bytes.split do)."""
    return text.encode().lower().split()


def shingle_digests(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 digests (n x 8 bytes, most significant first) of the k-word shingles; fewer words: one of them all."""
    import xxhash

    h = xxhash.xxh64_digest
    if not words:
        return np.zeros((0, 8), np.uint8)
    if len(words) <= k:
        grams = [b" ".join(words)]
    else:
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        first = np.concatenate(([0], ends[: len(words) - k])).tolist()
        grams = [line[a:b] for a, b in zip(first, (ends[k - 1 :] - 1).tolist(), strict=True)]
    return np.frombuffer(b"".join([h(g, SEED) for g in grams]), np.uint8).reshape(-1, 8)


def fingerprint(digests: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the digests (none: 0); as a signed 64-bit integer."""
    n = len(digests)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        ones += np.unpackbits(digests[at : at + 4096], axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def simhash(docs: DataFrame, *, text_col: str = "text", keep: Sequence[str] = ("doc_id",), shingle: int = 3) -> DataFrame:
    """`keep` columns with `fp` (long), the SimHash of each whole text. Null, empty and wordless texts: 0."""

    def factory():
        return lambda texts: [[fingerprint(shingle_digests(words_of(t), shingle)) for t in texts]]

    return map_text(docs, text_col, keep, [("fp", T.LongType())], factory)


class BKTree:
    """Nodes keyed below their parent by the integer Hamming distance to it; a search within r follows only the edges
    from d - r to d + r."""

    def __init__(self, values: Sequence[int]):
        self.values = list(values)
        self.children: list[dict[int, int]] = [{} for _ in self.values]
        for i in range(1, len(self.values)):
            at, x = 0, self.values[i]
            while True:
                d = (self.values[at] ^ x).bit_count()
                nxt = self.children[at].get(d)
                if nxt is None:
                    self.children[at][d] = i
                    break
                at = nxt

    def within(self, x: int, r: int) -> list[int]:
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ x).bit_count()
            if d <= r:
                found.append(at)
            todo += [c for e, c in self.children[at].items() if d - r <= e <= d + r]
        return found


def block_masks(n: int, radius: int, bits: int = 64, fill: float = 16.0) -> list[int]:
    """Masks such that two fingerprints within `radius` agree under one of them at least: cut into b blocks, `radius`
    changed bits leave b - radius blocks whole, so every choice of that many blocks is a key. More blocks make longer
    keys and more of them; the fewest are taken at which n evenly spread fingerprints put at most `fill` under a key.
    """
    for b in range(radius + 1, radius + 8):
        edges = [round(i * bits / b) for i in range(b + 1)]
        blocks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(b)]
        masks = [sum(blocks[i] for i in c) for c in combinations(range(b), b - radius)]
        if n / 2.0 ** min(m.bit_count() for m in masks) <= fill:
            break
    return masks


def near_links(prints: DataFrame, radius: int = 3, shard: int = SHARD) -> DataFrame:
    """(r, u, v): pairs of the distinct fingerprints `fp` of a kind `r` (int) within `radius` bits that join the same components
    as all such pairs of that kind.

    Fingerprints that agree under a mask of block_masks meet in one group. A group over `shard` is dealt into shards by
    hash, and each two shards meet in a cell of their own, so a task never holds more than two shards, however common a
    key is. In a cell the BK-tree of the first shard is searched for every member of the second, and only a spanning
    forest of the links found is returned: at most one row for each fingerprint there, never all pairs.
    """
    masks = block_masks(prints.groupBy("r").count().agg(F.max("count")).first()[0] or 0, radius)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keyed = prints.select(
        "fp", F.explode(F.array(*[F.struct((F.col("r") * len(masks) + i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k")) for i, m in enumerate(masks)])).alias("x")
    ).select("fp", "x.t", "x.k")
    many = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    cells = (
        keyed.join(many, ["t", "k"])
        .withColumn("s", F.ceil(F.col("m") / shard).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("s")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
        .select("t", "k", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "fp")
    )
    dealt = cells.repartition("t", "k", "a", "b").sortWithinPartitions("t", "k", "a", "b", "fp")

    def forest(tree: np.ndarray, query: np.ndarray) -> list[tuple[int, int]]:
        values = np.union1d(tree, query).tolist()
        at = {v: i for i, v in enumerate(values)}
        parent = list(range(len(values)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        bk = BKTree([v & 0xFFFFFFFFFFFFFFFF for v in tree.tolist()])
        mine = tree.tolist()
        for q in query.tolist():
            for i in bk.within(q & 0xFFFFFFFFFFFFFFFF, radius):
                x, y = root(at[q]), root(at[mine[i]])
                parent[max(x, y)] = min(x, y)
        return [(v, values[r]) for i, v in enumerate(values) if (r := root(i)) != i]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: np.ndarray) -> list[tuple[int, int, int]]:
            a, own = rows[0, 2], rows[:, 4]
            fps, r = rows[:, 5], int(rows[0, 0]) // len(masks)
            return [(r, u, v) for u, v in forest(fps[own == a], fps if rows[0, 3] == a else fps[own != a])]

        rest = np.zeros((0, 6), np.int64)
        for batch in batches:
            rows = np.concatenate([rest, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)])
            if not len(rows):
                continue
            starts = np.flatnonzero(np.any(rows[1:, :4] != rows[:-1, :4], axis=1)) + 1
            out = [e for g in np.split(rows[: starts[-1]], starts[:-1]) if len(g) > 1 for e in solve(g)] if len(starts) else []
            rest = rows[starts[-1] :] if len(starts) else rows
            yield _table(out, "r", "u", "v")
        yield _table(solve(rest) if len(rest) > 1 else [], "r", "u", "v")

    return dealt.mapInArrow(search, "r long, u long, v long")


def _table(rows: list[tuple[int, ...]], *names: str) -> pa.RecordBatch:
    x = np.array(rows, np.int64).reshape(-1, len(names))
    return pa.RecordBatch.from_arrays([pa.array(x[:, i]) for i in range(len(names))], names=list(names))


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    radius: int = 3,
    shard: int = SHARD,
) -> DataFrame:
    """One row for each row of docs: the id, its fingerprint (16 lowercase hex digits) and component_id, the smallest id
    among all rows that links of `radius` bits or fewer reach, the row itself included.

    Wordless (null, empty) texts have fingerprint zero and link like any other. Null ids are kept; they are no candidate
    for the smallest id, so a component of null ids only has a null component_id. Ids are integers. Repeated rows share a component; an
    empty table gives an empty result; other columns are ignored.
    """
    prints = as_table(simhash(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), shingle=shingle), "prints")
    scratch = Scratch(docs.sparkSession)
    distinct = scratch.table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    labels = connected_components(near_links(distinct.select(F.lit(0).alias("r"), "fp"), radius, shard).select("u", "v"))
    joined = distinct.join(labels, distinct.fp == labels.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    joined = scratch.table(joined, "labels")
    ids = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = as_table(joined.join(ids, "label").select("fp", "component_id"), "classes")
    scratch.clear()
    return prints.join(classes, "fp").select(
        F.col("doc_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def wide_radius(similarity: float, bits: int, miss: float = 1e-6, slack: float = 1.0) -> int:
    """Bits of `bits` by which the SimHashes of two sets of that Jaccard similarity differ at most, but with probability `miss`.
    A bit differs with probability acos(2 s / (1 + s)) / pi at most; in sets of a few shingles with up to `slack` times that."""
    p = min(0.5, slack * math.acos(2 * similarity / (1 + similarity)) / math.pi)
    tail, r = 1.0, -1
    while tail > miss and r < bits:
        r += 1
        tail -= math.comb(bits, r) * p**r * (1 - p) ** (bits - r)
    return r


def more_digests(x: np.ndarray, k: int) -> np.ndarray:
    """Another 64 bits for each digest (n x 8 bytes), the k-th such, by mixing its own."""
    z = x.view(">u8").ravel().astype(np.uint64) + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).astype(">u8").view(np.uint8).reshape(-1, 8)


class BKForest:
    """BK-trees of many shards, grown and searched together, a level at a time: `prints` (words x n, uint64) in the order in which
    a shard's tree takes them, `shard` (n, ascending) names each one's tree, whose root is its first. A node of distance 0 is
    a leaf of its own, so equal fingerprints make no chain."""

    def __init__(self, prints: np.ndarray, shard: np.ndarray):
        self.prints, self.shard, self.edges = prints, shard, 64 * len(prints) + 1
        first = np.concatenate([[True], shard[1:] != shard[:-1]]) if len(shard) else np.zeros(0, bool)
        self.roots = np.flatnonzero(first)
        self.sizes = np.diff(np.append(self.roots, len(shard)))
        at = np.repeat(self.roots, self.sizes)
        todo, keys, nodes = np.flatnonzero(~first), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(todo):
            d = self._distance(prints, todo, at[todo])
            key = at[todo] * self.edges + d
            _, lead, group = np.unique(key, return_index=True, return_inverse=True)
            placed = d == 0
            placed[lead] = True
            keys.append(key[placed])
            nodes.append(todo[placed])
            at[todo] = todo[lead][group]
            todo = todo[~placed]
        keys, nodes = np.concatenate(keys), np.concatenate(nodes)
        by = np.argsort(keys, kind="stable")
        self.keys, self.nodes = keys[by], nodes[by]

    def _distance(self, queries: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return sum((np.bitwise_count(q[i] ^ p[j]).astype(np.int64) for q, p in zip(queries, self.prints, strict=True)), np.zeros(len(i), np.int64))

    def within(self, queries: np.ndarray, shard: np.ndarray, radius: np.ndarray, at_once: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, node, distance) of all nodes within each query's radius in its shard's tree, all of a query in one piece. Only
        the edges from d - r to d + r are followed; a piece holds queries whose trees have `at_once` nodes or a few more."""
        known = self.shard[self.roots]
        tree = np.searchsorted(known, shard)
        asked = np.flatnonzero(tree < len(known))
        asked = asked[known[tree[asked]] == shard[asked]]
        piece = np.cumsum(self.sizes[tree[asked]]) // at_once
        for q in np.split(asked, np.flatnonzero(np.diff(piece)) + 1):
            node, found = self.roots[tree[q]], []
            while len(q):
                d = self._distance(queries, q, node)
                hit = d <= radius[q]
                found.append((q[hit], node[hit], d[hit]))
                lo = np.searchsorted(self.keys, node * self.edges + np.maximum(d - radius[q], 0))
                hi = np.searchsorted(self.keys, node * self.edges + np.minimum(d + radius[q], self.edges - 1), side="right")
                many = hi - lo
                q = np.repeat(q, many)
                node = self.nodes[np.repeat(lo - np.cumsum(many) + many, many) + np.arange(len(q))]
            if found:
                yield tuple(np.concatenate(x) for x in zip(*found, strict=True))


def keep_distinct(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, sample: int = 4096, shard: int = SHARD
) -> DataFrame:
    """docs without those that are near copies (Jaccard similarity of their shingle sets at least `similarity`) of one that
    stays: of each group the row of the smallest id stays (null ids last, then the least digest of the text). Groups are the
    components of all pairs that similar.

    Shards are exact (prefix filter): with the shingles of all texts in one order, two sets that similar share one of their
    first n - ceil(similarity n) + 1. Any order is right; shingles met more than once in about `sample` texts come last, so
    that common passages bring few texts together. The shard of a first shingle is a BK-tree of its texts' SimHashes of 256
    bits; what a search within wide_radius bits finds is a candidate, which loses a similar pair with probability 1e-6. The
    root is the text that shares most of its own first: all are held against the roots first, then each is searched for in
    the whole tree, and those that are not in one component yet are candidates, the nearest of each other component first,
    in rounds of growing numbers until none is left out. A shard of over `shard` texts is dealt into trees of at most about
    that many, of which each two meet in a cell of their own. Pairs that also share one of their HEAD very first
    shingles meet in its shard alone. Exact shingle sets decide about every candidate.
    Equal texts are one class from the start. Wordless texts (null, empty) are one group. Columns are those of docs; an
    empty table gives an empty result. Ids are integers.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    body = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rank = F.struct(F.col(f"`{id_col}`").isNull().alias("n"), F.coalesce(F.col(f"`{id_col}`"), F.lit(0)).alias("i"))
    keyed = docs.select(F.md5(body.cast("binary")).alias("key"), rank.alias("rank"), body.alias("text")).withColumn("node", F.xxhash64("key"))
    prints_of = [f"f{i}" for i in range(4)]
    heads_of = [f"h{i}" for i in range(HEAD)]
    radius, radius_few = wide_radius(similarity, 256), wide_radius(similarity, 256, slack=1.25)

    def digests(text: str) -> np.ndarray:
        x = np.unique(shingle_digests(words_of(text), shingle).view(">u8").ravel().astype(np.uint64))
        return x if len(x) else np.zeros(1, np.uint64)

    def lists(sets: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))

    longs = T.ArrayType(T.LongType())
    some = keyed.where(F.pmod(F.xxhash64("node"), F.lit(-(-docs.count() // sample) or 1)) == 0).dropDuplicates(["node"])
    often = map_text(some, "text", [], [("x", longs)], lambda: lambda texts: [lists([digests(t) for t in texts])])
    often = often.select(F.explode("x").alias("x")).groupBy("x").count().where("count > 1").toArrow()
    grams, seen = (often[c].to_numpy() for c in ("x", "count"))
    by = np.argsort(grams.view(np.uint64))
    shared = spark.sparkContext.broadcast((grams.view(np.uint64)[by], seen[by]))

    def prefixes():
        grams, seen = shared.value

        def run(texts: list[str]):
            out, sizes, prints, heads = [], [], [[] for _ in prints_of], [[] for _ in heads_of]
            for t in texts:
                x = digests(t)
                at = np.searchsorted(grams, x)
                known = np.flatnonzero(at < len(grams))
                known = known[grams[at[known]] == x[known]]
                weight = np.zeros(len(x), np.int64)
                weight[known] = seen[at[known]]
                out.append(x[np.argsort(weight, kind="stable")[: len(x) - math.ceil(similarity * len(x) - 1e-9) + 1]])
                sizes.append(len(x))
                raw = x.astype(">u8").view(np.uint8).reshape(-1, 8)
                for k, f in enumerate(prints):
                    f.append(fingerprint(more_digests(raw, k) if k else raw))
                for k, h in enumerate(heads):
                    h.append(int(out[-1][k].view(np.int64)) if k < len(out[-1]) else None)
            return [lists(out), sizes, *prints, *heads]

        return run

    fields = [("ts", longs), ("size", T.IntegerType()), *[(c, T.LongType()) for c in prints_of + heads_of]]
    first = scratch.table(map_text(keyed.select("node", "text"), "text", ["node"], fields, prefixes), "first")
    together = Window.partitionBy("t")
    keys = first.select("node", F.posexplode("ts").alias("pos", "t")).withColumns({"lo": F.min("node").over(together), "hi": F.max("node").over(together)})
    keys = keys.where("lo <> hi").groupBy("t", "node").agg(F.min("pos").alias("pos"))
    prints = first.groupBy("node").agg(*[F.max(c).alias(c) for c in ("size", *prints_of, *heads_of)])  # equal in all rows of a node
    keys = keys.join(prints, "node").withColumn("degree", F.count(F.lit(1)).over(Window.partitionBy("node")))
    keys = scratch.table(keys.select("t", "node", "size", "pos", "degree", *prints_of, *heads_of), "keys")
    scratch.drop(first)
    least, share = similarity * (1 - 1e-9), similarity / (1 + similarity) * (1 - 1e-9)

    # the trees' roots, the texts that share most, against all of their shards
    hubs = keys.groupBy("t").agg(F.max(F.struct("degree", "node", "size", "pos", *prints_of)).alias("h"), F.count(F.lit(1)).alias("m"))
    hubs = scratch.table(hubs.select("t", "h.*", "m").toDF("t", "_", "b", "bs", "bp", *[f"b{c}" for c in prints_of], "m").drop("_"), "hubs")
    apart = " + ".join(f"bit_count({c} ^ b{c})" for c in prints_of)
    fits = f"least(size, bs) >= {least!r} * greatest(size, bs) and least(size - pos, bs - bp) >= {share!r} * (size + bs) and {apart} <= if(least(size, bs) < {FEW_SHINGLES}, {radius_few}, {radius})"
    pairs = keys.join(hubs, "t").where("node <> b").where(fits).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))
    most = hubs.agg(F.max("m")).first()[0] or 0

    # the other nodes of the shards' trees
    cell = ["t", "a", "b"]

    def solve(rows: np.ndarray, limit: int) -> np.ndarray:
        """Pairs of the cells in rows: of each search the `limit` nearest of every other component."""
        (t, a, b, own, node, size, pos, label), rest = rows[:8], rows[9:]
        prints, heads = rest[: len(prints_of)].view(np.uint64), rest[len(prints_of) :]
        new = (t[1:] != t[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        which = np.concatenate([[0], np.cumsum(new)])
        inner, asks = np.flatnonzero(own == a), np.flatnonzero((a == b) | (own != a))
        forest = BKForest(prints[:, inner], which[inner])
        reach = np.where(similarity * size[asks] < FEW_SHINGLES, radius_few, radius)
        out = [np.zeros((0, 2), np.int64)]
        for q, n, d in forest.within(prints[:, asks], which[asks], reach):
            i, j = asks[q], inner[n]
            low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            ok = (label[i] != label[j]) & ((a[i] != b[i]) | (i > j)) & (low >= least * high) & (d <= np.where(low < FEW_SHINGLES, radius_few, radius))
            ok &= np.minimum(size[i] - pos[i], size[j] - pos[j]) >= share * (low + high)
            i, j, d = i[ok], j[ok], d[ok]
            ok = np.ones(len(i), bool)
            for p in range(HEAD):
                for r in range(HEAD):
                    ok &= (pos[i] <= p) | (pos[j] <= r) | (heads[p, i] != heads[r, j])
            i, j, d = i[ok], j[ok], d[ok]
            by = np.lexsort((d, label[j], i))
            i, j = i[by], j[by]
            starts = np.concatenate([[True], (i[1:] != i[:-1]) | (label[j[1:]] != label[j[:-1]])])[: len(i)]
            rank = np.arange(len(i)) - np.maximum.accumulate(np.where(starts, np.arange(len(i)), 0))
            i, j = i[rank < limit], j[rank < limit]
            out.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], axis=1))
        return np.unique(np.concatenate(out), axis=0)

    def search(limit: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                rows = np.stack([c.fill_null(0).to_numpy().astype(np.int64) for c in batch.columns])
                held = rows if held is None else np.concatenate([held, rows], axis=1)
                ends = np.flatnonzero(np.any(held[:3, 1:] != held[:3, :-1], axis=0)) + 1
                if len(ends):
                    yield _table(solve(held[:, : ends[-1]], limit), "a", "b")
                    held = held[:, ends[-1] :]
            if held is not None and held.shape[1]:
                yield _table(solve(held, limit), "a", "b")

        return run

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for a, b, ga, gb in zip(*batch.columns, strict=True):
                x, y = np.frombuffer(ga.as_buffer(), np.uint64), np.frombuffer(gb.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similarity * (len(x) + len(y) - both):
                    kept.append((a.as_py(), b.as_py()))
            yield _table(kept, "u", "v")

    classes = scratch.table(keyed.groupBy("key", "node").agg(F.min("rank").alias("rank")), "classes")

    def sets_of(nodes: DataFrame) -> DataFrame:
        """The shingle sets of the nodes, from one text each; the nodes go to the texts if they are few."""
        linked = classes.join(nodes, "node", "left_semi").select("key", "rank")
        linked = scratch.table(linked, "linked")
        n = linked.count()
        near = keyed.join(F.broadcast(linked) if n <= FEW_NODES else linked, ["key", "rank"], "left_semi")
        sets = map_text(near, "text", ["node"], [("grams", T.BinaryType())], lambda: lambda texts: [[digests(t).tobytes() for t in texts]])
        out = scratch.table(sets.dropDuplicates(["node"]), "sets")
        scratch.drop(linked)
        return out

    links, labels, tried, sets = None, None, None, None
    near, far = 0, 1
    while True:
        pairs = scratch.table(pairs.distinct() if tried is None else pairs.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        more = sets_of(nodes if sets is None else nodes.join(sets.select("node"), "node", "left_anti"))
        sets = more if sets is None else sets.unionByName(more)
        # a text of many pairs is dealt out in copies, one for each HOT of them
        parts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("s"))
        dealt = pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("s")).cast("int").alias("i"))
        right = sets.toDF("b", "gb").join(parts, "b").select("b", "gb", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("i"))
        facing = dealt.join(sets.toDF("a", "ga"), "a").join(right, ["b", "i"])
        more = scratch.table(facing.select("a", "b", "ga", "gb").mapInArrow(verify, "u long, v long"), "links")
        if links is None or not more.isEmpty():
            links = more if links is None else links.unionByName(more)
            scratch.drop(labels)
            labels = scratch.table(connected_components(links), "labels")
        near, far = far, 32 * far + 1
        if near >= most:
            break
        named = keys.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = named.groupBy("t").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("m")).where(f"lo <> hi and m > {near}").select("t", "m")
        dealt = (
            named.join(mixed, "t")
            .withColumn("s", F.ceil(F.col("m") / shard).cast("int"))
            .withColumn("own", F.pmod(F.xxhash64("node"), F.col("s")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
            .withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")})
            .select(*cell, "own", "node", "size", "pos", "label", "degree", *prints_of, *heads_of)
        )
        dealt = dealt.repartition(*cell).sortWithinPartitions(*cell, F.col("degree").desc(), F.col("node").desc())
        pairs = dealt.mapInArrow(search(far), "a long, b long")

    grouped = classes.join(labels, "node", "left").select("key", "rank", F.coalesce("label", "node").alias("label"))
    stars = grouped.groupBy("label").agg(F.min(F.struct("rank", "key")).alias("s"))
    stay = as_table(stars.select("s.key", "s.rank"), "stay")
    scratch.clear()
    # repeated rows share both key and rank: one of them stays
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.md5(body.cast("binary")).alias("key"), rank.alias("rank"))
    once = Window.partitionBy("key", "rank").orderBy(F.lit(1))
    return whole.join(stay, ["key", "rank"]).withColumn("o", F.row_number().over(once)).where("o = 1").select("d.*")
