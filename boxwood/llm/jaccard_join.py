"""N-gram Jaccard join by a token-group matrix, and the classes that its links form.

A document's set holds its distinct n-word shingles (64-bit hashes). Documents
with the same set are one node from the start. Two nodes link when the Jaccard
similarity of their sets reaches the threshold; classes are connected by links.

1. ``describe``: node, set size, min-hashes, and the beginning of the set
   in one order of all shingles: unusual ones by hash, then those that tasks
   saw in many documents (a bounded table; the order changes the work, never
   the result).
2. Stars: nodes with an equal min-hash are compared with one of them, the one
   with the largest share of frequent shingles, if most of their min-hashes agree; large groups of near
   copies collapse to a class.
3. Matrix: two linked sets share at least LEVEL shingles of their beginnings.
   Only shingles that begin sets of several classes count. Nodes that share
   such shingles stand together in the order of their min-hashes over them;
   ``GROUP`` in a row are a group, and the matrix has the union of their beginnings. Where a class shares
   enough shingles with a group's union, apart from those that only the class itself has there, those
   of its nodes that hold enough of them visit the group.
4. A visited group is opened in two steps: posting lists of the members'
   beginnings tell which members and queries share enough; of these alone the
   whole sets are read, again as posting lists: the bound on the overlap of
   the query and the group's union, then the exact similarity, decide. One
   link for a query and class is enough for the classes.

Sets are read from the texts again for the nodes that a step compares, found
by a Bloom filter. It has 16 bits for each such node, up to 16 MB (8 million nodes); for more
nodes it lets other sets pass, too, which the join by node then drops: that costs
shuffle (of all sets at most), never links.
A 64-bit hash stands for a shingle and for a node.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxwood.llm.common import discard, durable, mix64, n_partitions, quoted, table

#: Shared shingles that make a candidate; fewer for sets that are smaller.
LEVEL = 3
#: Members of a group (a power of two), and queries that one task compares with it, about.
GROUP, VISITS = 256, 512
#: Entries of the table of frequent shingles, and the documents that make one frequent.
HOT, HOT_DOCS = 1 << 18, 24
#: Shingles in which a task looks for repeated ones at once.
_CHUNK = 1_000_000
_SLICE = 256
#: Min-hashes of a node, and how many of them a node shares with a pivot that it is compared with.
_MINHASHES, _AGREE = 4, 3

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def sets_of(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; a text with fewer words has its whole sequence as one."""
    words = [t.lower().split() for t in texts]
    counts = [len(w) for w in words]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), dtype=np.uint64, count=sum(counts))
    shingles = np.zeros(max(0, len(hashes) - width + 1), dtype=np.uint64)
    for k in range(width):
        shingles *= _A
        shingles += hashes[k : k + len(shingles)]
    shingles = mix64(shingles)
    out, at = [], 0
    for own, n in zip(words, counts, strict=True):
        if n >= width:
            x = np.sort(shingles[at : at + n - width + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(own), seed=n)] if n else [], dtype=np.uint64))
        at += n
    return out


def node_of(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=len(shingles))).astype(np.int64))


class Threshold:
    """similarity >= num / den, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def linked(self, shared: np.ndarray, n: int, m: np.ndarray) -> np.ndarray:
        return self.den * shared >= self.num * (n + m - shared)

    def least(self, n: int) -> int:
        """Shingles of a set of n that any partner shares, whatever its size."""
        return -(-self.num * n // self.den)

    def level(self, n: int) -> int:
        return min(LEVEL, self.least(n))

    def beginnings(self, n: int) -> tuple[int, int]:
        """Lengths of the beginning as the larger and as the smaller set of a pair."""
        as_smaller = -(-2 * self.num * n // (self.num + self.den))
        level = self.level(n)
        return min(n, n - self.least(n) + level), min(n, n - as_smaller + level)


def _slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            part = batch.slice(at, _SLICE)
            yield part, sets_of([t or b"" for t in part.column("data").to_pylist()], width)


def _repeated(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    return found[n > 1], n[n > 1]


def survey(docs: DataFrame, id_col: str, width: int) -> DataFrame:
    """Rows of documents (id, n, node; node null for an empty set), and rows of shingles that a task met in several sets (shingle, seen)."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, "n", "node", "shingle", "seen"]
        held: list[np.ndarray] = []
        known: set[int] = set()
        total, ids = 0, None

        def hot() -> pa.RecordBatch:
            found, n = _repeated(held)
            none = lambda t: pa.nulls(len(found), t)
            return pa.RecordBatch.from_arrays([none(ids), none(pa.int64()), none(pa.int64()), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], names=names)

        for part, sets in _slices(batches, width):
            ids = part.column(id_col).type
            nodes = [node_of(s) if len(s) else None for s in sets]
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), none, none], names=names)
            for node, s in zip(nodes, sets, strict=True):
                if node is not None and node not in known:
                    known.add(node)
                    held.append(s)
                    total += len(s)
            if total > _CHUNK:
                yield hot()
                held, total, known = [], 0, set()
        if held:
            yield hot()

    return docs.mapInArrow(run, f"`{id_col}` {kind}, n bigint, node bigint, shingle bigint, seen bigint")


def frequent(surveyed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in many sets, sorted, with their place in the order: the rarer come first. HOT at most."""
    top = surveyed.filter(F.col("shingle").isNotNull()).groupBy("shingle").agg(F.sum("seen").alias("seen")).filter(F.col("seen") >= HOT_DOCS).orderBy(F.desc("seen"), "shingle").limit(HOT).toArrow()
    shingles = top.column("shingle").to_numpy().astype(np.int64).view(np.uint64)
    rank = len(shingles) - np.arange(len(shingles))
    order = np.argsort(shingles)
    return shingles[order], rank[order]


def describe(docs: DataFrame, width: int, threshold: Threshold, hot: tuple[np.ndarray, np.ndarray]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The written table of both, and of it nodes: node, n, h0 to h3, share (of frequent shingles); entries: shingle, node, indexed, of the shingles that begin two nodes or more.

    A task packs its entries by the task that a shingle goes to, and sends
    them with its nodes; there, repeated nodes and lone shingles go.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(hot)
    seeds = mix64(np.arange(1, _MINHASHES + 1, dtype=np.uint64) * _C)
    parts = max(n_partitions(spark), docs.rdd.getNumPartitions())  # so that a task's share doesn't grow with the input
    plain = ["node", "n", *(f"h{k}" for k in range(_MINHASHES))]

    def packed(known: dict[int, tuple], entries: list[tuple[np.ndarray, int, int]]) -> Iterator[pa.RecordBatch]:
        rows = np.array([(node, *x[:-1]) for node, x in known.items()], dtype=np.int64).reshape(-1, len(plain))
        share = np.array([x[-1] for x in known.values()])
        shingle = np.concatenate([e[0] for e in entries]) if entries else np.zeros(0, dtype=np.uint64)
        node = np.repeat(np.array([e[1] for e in entries], dtype=np.int64), [len(e[0]) for e in entries])
        indexed = np.concatenate([np.arange(len(e[0])) < e[2] for e in entries]) if entries else np.zeros(0, dtype=bool)
        row_to = (rows[:, 0].view(np.uint64) % np.uint64(parts)).astype(np.int64)
        entry_to = (mix64(shingle) % np.uint64(parts)).astype(np.int64)
        rows_by, entries_by = np.argsort(row_to, kind="stable"), np.argsort(entry_to, kind="stable")
        row_edges, entry_edges = (np.searchsorted(x[by], np.arange(parts + 1)) for x, by in ((row_to, rows_by), (entry_to, entries_by)))
        for t in range(parts):
            r, e = rows_by[row_edges[t] : row_edges[t + 1]], entries_by[entry_edges[t] : entry_edges[t + 1]]
            if len(r) or len(e):
                blobs = [np.ascontiguousarray(rows[r].T), share[r], shingle[e], node[e], indexed[e]]
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], names=["target", "rows", "share", "shingle", "node", "indexed"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, rank = held.value
        seen: set[int] = set()
        known: dict[int, tuple] = {}
        entries: list[tuple[np.ndarray, int, int]] = []
        total = 0
        for _, sets in _slices(batches, width):
            for s in sets:
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                seen.add(node)
                take, indexed = threshold.beginnings(len(s))
                share, order = 0.0, s
                if len(shingles):
                    at = np.minimum(np.searchsorted(shingles, s), len(shingles) - 1)
                    often = shingles[at] == s
                    if often.any():
                        share = float(often.mean())
                        rare = s[~often]
                        order = rare if len(rare) >= take else np.concatenate([rare, s[often][np.argsort(rank[at[often]], kind="stable")]])
                known[node] = (len(s), *(int(mix64(s ^ seed).min().astype(np.int64)) for seed in seeds), share)
                entries.append((order[:take].copy(), node, indexed))
                total += take
            if total > _CHUNK:
                yield from packed(known, entries)
                known, entries, total = {}, [], 0
        yield from packed(known, entries)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [row for batch in batches for row in batch.to_pylist()]
        if not got:
            return
        rows = np.concatenate([np.frombuffer(r["rows"], dtype=np.int64).reshape(len(plain), -1) for r in got], axis=1)
        join = lambda name, t: np.frombuffer(b"".join(r[name] for r in got), dtype=t)
        share, shingle, node, indexed = join("share", np.float64), join("shingle", np.uint64), join("node", np.int64), join("indexed", bool)
        _, first = np.unique(rows[0], return_index=True)
        yield made(rows[:, first], share[first], None, None)
        order = np.lexsort((node, shingle))
        shingle, node, indexed = shingle[order], node[order], indexed[order]
        new = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (node[1:] != node[:-1])]) if len(shingle) else np.zeros(0, dtype=bool)
        shingle, node, indexed = shingle[new], node[new], indexed[new]
        _, at, n = np.unique(shingle, return_inverse=True, return_counts=True)
        several = n[at] > 1
        yield made(None, node[several], shingle[several], indexed[several])

    def made(rows, share, shingle, indexed) -> pa.RecordBatch:
        if rows is not None:
            none = lambda t: pa.nulls(rows.shape[1], t)
            columns = [*(pa.array(x) for x in rows), pa.array(share), none(pa.int64()), none(pa.bool_())]
        else:
            none = pa.nulls(len(shingle), pa.int64())
            columns = [pa.array(share), *[none] * (len(plain) - 1), pa.nulls(len(shingle), pa.float64()), pa.array(shingle.astype(np.int64)), pa.array(indexed)]
        return pa.RecordBatch.from_arrays(columns, names=[*plain, "share", "shingle", "indexed"])

    sent = docs.mapInArrow(send, "target int, rows binary, share binary, shingle binary, node binary, indexed binary").repartitionById(parts, F.col("target"))
    found = durable(sent.mapInArrow(reduce, ", ".join(f"{c} bigint" for c in plain) + ", share double, shingle bigint, indexed boolean"))
    return found, found.filter(F.col("shingle").isNull()).select(*plain, "share"), found.filter(F.col("shingle").isNotNull()).select("shingle", "node", "indexed")


def bloom_of(nodes: DataFrame) -> np.ndarray:
    """A Bloom filter of two bits for each node, as words of 64 bits; 16 MB at most come to the driver and are broadcast, whatever the number of nodes."""
    bits = 1 << int(np.clip(np.ceil(np.log2(16 * max(1, nodes.count()))), 12, 27))
    at = lambda k: F.pmod(F.xxhash64("node", F.lit(k)), F.lit(bits))
    spots = nodes.select(F.explode(F.array(at(1), at(2))).alias("spot"))
    words = spots.groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def open_sets(docs: DataFrame, width: int, needed: DataFrame) -> DataFrame:
    """node, data (sorted uint64): the sets of the needed nodes (distinct, column node) and of a few others, read from the texts; a row for each task that met the node."""
    words = bloom_of(needed)
    held = docs.sparkSession.sparkContext.broadcast(words)
    bits = 64 * len(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_bits = held.value.view(np.uint64)
        known: set[int] = set()
        for _, sets in _slices(batches, width):
            nodes, data = [], []
            for s in sets:
                if len(s) and (node := node_of(s)) not in known and _may_hold(filter_bits, node, bits):
                    known.add(node)
                    nodes.append(node)
                    data.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(data, pa.binary())], names=["node", "data"])

    return docs.mapInArrow(run, "node bigint, data binary")


_MASK = (1 << 64) - 1
# The primes of the public XXH64 specification, by which Spark's xxhash64 hashes a long.
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def _hash_long(value: int, seed: int, size: int = 8) -> int:
    """XXH64 of one long (size 8) or int (size 4), as Spark chains it over columns."""
    rotate = lambda x, r: ((x << r) | (x >> (64 - r))) & _MASK
    h = (seed + _P5 + size) & _MASK
    if size == 8:
        h ^= rotate(((value & _MASK) * _P2) & _MASK, 31) * _P1 & _MASK
        h = (rotate(h, 27) * _P1 + _P4) & _MASK
    else:
        h ^= (value & 0xFFFFFFFF) * _P1 & _MASK
        h = (rotate(h, 23) * _P2 + _P3) & _MASK
    h ^= h >> 33
    h = h * _P2 & _MASK
    h ^= h >> 29
    h = h * _P3 & _MASK
    return h ^ (h >> 32)


def _may_hold(words: np.ndarray, node: int, bits: int) -> bool:
    first = _hash_long(node, 42)
    for k in (1, 2):
        h = _hash_long(k, first, 4)
        spot = (h - (1 << 64) if h >> 63 else h) % bits
        if not int(words[spot >> 6]) >> (spot & 63) & 1:
            return False
    return True


class Postings:
    """Posting lists: for each token of some sets, the sets that hold it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        tokens = np.concatenate(sets)
        member = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.member = member[order]
        self.union, self.first = np.unique(tokens[order], return_index=True)
        self.last = np.append(self.first[1:], len(tokens))

    def places(self, s: np.ndarray) -> np.ndarray:
        """Where the tokens of s lie that the union holds, too."""
        if not len(self.union):
            return np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.union, s), len(self.union) - 1)
        return at[self.union[at] == s]

    def shared(self, at: np.ndarray) -> np.ndarray:
        """How many of the tokens at these places each set holds."""
        n = self.last[at] - self.first[at]
        spots = np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.member[spots], minlength=len(self.sizes))


class Beginnings(Postings):
    """An opened group's members by the shared shingles of their beginnings."""

    def __init__(self, members: list[tuple[int, int, int, np.ndarray]]):
        nodes, classes, sizes, tokens = zip(*members, strict=True)
        super().__init__(list(tokens))
        self.nodes, self.classes, self.n = (np.array(x, dtype=np.int64) for x in (nodes, classes, sizes))
        self.wanted = np.zeros(len(nodes), dtype=bool)

    def ask(self, own: int, n: int, tokens: np.ndarray, threshold: Threshold) -> bool:
        """Whether a query, as the larger set, shares enough with a member of another class; such members are wanted."""
        at = self.places(tokens)
        if not len(at):
            return False
        enough = self.shared(at) >= np.minimum(LEVEL, -(-threshold.num * self.n // threshold.den))
        found = enough & (self.classes != own) & (self.n <= n) & (threshold.den * self.n >= threshold.num * n)
        self.wanted |= found
        return bool(found.any())


class Group(Postings):
    """Whole sets of members."""

    def __init__(self, members: list[tuple[int, int, np.ndarray]]):
        nodes, classes, sets = zip(*members, strict=True)
        super().__init__(list(sets))
        self.nodes, self.classes = np.array(nodes, dtype=np.int64), np.array(classes, dtype=np.int64)

    def links(self, node: int, own: int, s: np.ndarray, threshold: Threshold) -> list[int]:
        """One linked member of each class other than own."""
        at = self.places(s)
        if len(at) < threshold.least(len(s)) and len(at) < threshold.least(int(self.sizes.min())):
            return []
        shared = self.shared(at)
        linked = np.flatnonzero(threshold.linked(shared, len(s), self.sizes) & (self.classes != own) & (shared > 0))
        _, one = np.unique(self.classes[linked], return_index=True)
        return self.nodes[linked[one]].tolist()


def deal(members: DataFrame, queries: DataFrame) -> DataFrame:
    """members and queries as rows (group, part, asks, and their other columns). A group that many queries visit is opened in several parts, each with some of them.

    The numbers of parts are written first, so that Spark can split the join at a group that many queries visit.
    """
    parts = durable(queries.groupBy("group").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("_parts")))
    opened = members.join(parts, "group").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    asking = queries.join(parts, "group").withColumn("part", F.pmod(F.xxhash64("node"), F.col("_parts").cast("long")).cast("int"))
    return opened.withColumn("asks", F.lit(0)).unionByName(asking.withColumn("asks", F.lit(1))).drop("_parts")


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition(n_partitions(rows.sparkSession), "group", "part").sortWithinPartitions("group", "part", "asks", "node")


def descend(rows: DataFrame, threshold: Threshold) -> DataFrame:
    """Of dealt rows with the columns n, inner, outer (shared shingles of the beginning, indexed or not): those whose whole sets are to be compared (group, part, asks, node, class)."""
    names = ["group", "part", "asks", "node", "class"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, waiting, asking = None, None, [], []

        def found() -> pa.RecordBatch:
            nodes, classes = (x[group.wanted].tolist() for x in (group.nodes, group.classes))
            out = [(0, i, c) for i, c in zip(nodes, classes, strict=True)] + [(1, i, c) for i, c in asking]
            columns = [[at[0]] * len(out), [at[1]] * len(out), *(list(x) for x in zip(*out, strict=True))]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=names)

        for batch in batches:
            inner, outer = (_lists(batch.column(k)) for k in (6, 7))
            for k, (key, part, asks, node, own, n) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(6)), strict=True)):
                if (key, part) != at:
                    if asking:
                        yield found()
                    at, group, waiting, asking = (key, part), None, [], []
                if not asks:
                    waiting.append((node, own, n, inner[k]))
                elif waiting:
                    group = group or Beginnings(waiting)
                    if group.ask(own, n, np.concatenate([inner[k], outer[k]]), threshold):
                        asking.append((node, own))
        if asking:
            yield found()

    columns = _together(rows).select(*names, "n", "inner", "outer")
    return columns.mapInArrow(run, "group bigint, part int, asks int, node bigint, class bigint")


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The rows of a column of lists of longs, none of them null, as arrays of their own."""
    values, edges = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
    return [values[i:j].copy() for i, j in zip(edges, edges[1:], strict=False)]


def visit(rows: DataFrame, sets: DataFrame, threshold: Threshold) -> DataFrame:
    """Links (a, b) of queries with members of the groups that they visit. rows: group, part, asks, node, class; sets: node, data."""
    whole = _together(rows.select("group", "part", "asks", "node", "class").join(sets, "node")).select("group", "part", "asks", "node", "class", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, waiting, last = None, None, [], None
        for batch in batches:
            a, b = [], []
            for key, part, asks, node, own, data in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if (key, part) != at:
                    at, group, waiting = (key, part), None, []
                if (at, asks, node) == last:  # its set came from several tasks
                    continue
                last = (at, asks, node)
                s = np.frombuffer(data, dtype=np.uint64)
                if not asks:
                    waiting.append((node, own, s))
                elif waiting:
                    group = group or Group(waiting)
                    for other in group.links(node, own, s, threshold):
                        a.append(node)
                        b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return whole.mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """node, class for the nodes of edges (a, b): class is the smallest node of the component. Labels spread along edges, with pointer jumping."""
    both = durable(edges.union(edges.select("b", "a")).distinct())
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("class")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "class"), "b").groupBy(F.col("a").alias("node")).agg(F.min("class").alias("near"))
        new = labels.select("node", "class").join(near, "node").select("node", F.col("class").alias("old"), F.least("class", "near").alias("class"))
        jump = labels.select(F.col("node").alias("class"), F.col("class").alias("further"))
        new = durable(new.join(jump, "class").select("node", "old", F.least("class", "further").alias("class")))
        done = new.filter(F.col("old") != F.col("class")).isEmpty()
        discard(labels)
        if done:
            discard(both)
            return new.select("node", "class")
        labels = new


def _class(labels: DataFrame | None, rows: DataFrame) -> DataFrame:
    """rows with column class: the node itself if it has no label."""
    if labels is None:
        return rows.withColumn("class", F.col("node"))
    return rows.join(labels.withColumnRenamed("class", "_c"), "node", "left").withColumn("class", F.coalesce("_c", "node")).drop("_c")


def _stars(nodes: DataFrame, threshold: Threshold) -> DataFrame:
    """Pairs (group, node): each node with the pivots of its min-hashes, where sizes and most min-hashes agree. What is missed here, the matrix finds.

    Pivots are written first, so that Spark can split the join at a min-hash that many nodes have.
    """
    hashes = [f"h{k}" for k in range(_MINHASHES)]
    own = nodes.select("*", F.posexplode(F.array(*hashes)).alias("k", "h"))
    pivots = own.groupBy("k", "h").agg(F.max(F.struct("share", "node", "n", *hashes)).alias("p"), F.count("*").alias("_nodes")).filter("_nodes > 1").drop("_nodes")
    agree = sum((F.col(f"p.{k}") == F.col(k)).cast("int") for k in hashes)
    near = F.least("n", "p.n") * threshold.den >= F.greatest("n", "p.n") * threshold.num
    pairs = own.join(durable(pivots), ["k", "h"]).filter((F.col("p.node") != F.col("node")) & near & (agree >= _AGREE))
    return pairs.select(F.col("p.node").alias("group"), "node").distinct()


def _sql_least(n: str, threshold: Threshold) -> Column:
    return F.expr(f"({n} * {threshold.num} + {threshold.den - 1}) div {threshold.den}")


def _sql_level(n: str, threshold: Threshold) -> Column:
    """Shingles that a set of n shares with the beginning of any smaller partner, at least: the smallest one has least(n)."""
    smallest = f"(({n} * {threshold.num} + {threshold.den - 1}) div {threshold.den})"
    return F.least(F.lit(LEVEL), _sql_least(smallest, threshold))


def _candidates(nodes: DataFrame, entries: DataFrame, labels: DataFrame | None, threshold: Threshold) -> DataFrame:
    """Members of opened groups, and the queries that visit them, as dealt rows (group, part, asks, node, class).

    Shingles that begin sets of one class only say nothing. The nodes that
    have enough of the others are ordered by two min-hashes over these, so that
    nodes that share them stand together, and ``GROUP`` of them in a row are a
    group. The matrix has a row for each group and shingle of its union. Classes
    ask it, not nodes, so that a class of many near copies asks once.
    """
    classed = _class(labels, entries)
    several = durable(classed.groupBy("shingle").agg(F.min("class").alias("_low"), F.max("class").alias("_high")).filter("_low <> _high").select("shingle"))
    shared = classed.join(several, "shingle", "left_semi")
    list_of = lambda which: F.collect_list(F.when(which, F.col("shingle")))
    signature = [F.min(F.xxhash64("shingle", F.lit(k))).alias(f"_s{k}") for k in range(2)]
    packed = shared.groupBy("node").agg(F.first("class").alias("class"), *signature, list_of(F.col("indexed")).alias("inner"), list_of(~F.col("indexed")).alias("outer"))
    packed = durable(packed.join(nodes.select("node", "n"), "node").filter(F.size("inner") + F.size("outer") >= _sql_level("n", threshold)))
    order = ["_s0", "_s1", "node"]
    ordered = packed.repartitionByRange(n_partitions(packed.sparkSession), *order).sortWithinPartitions(*order)
    grouped = durable(ordered.withColumn("group", F.shiftright(F.monotonically_increasing_id(), GROUP.bit_length() - 1)).drop("_s0", "_s1"))

    matrix = grouped.select("group", "class", "n", F.explode("inner").alias("shingle"))
    matrix = matrix.groupBy("shingle", "group").agg(F.min("n").alias("_least"), F.max("n").alias("_most"), F.min("class").alias("_low"), F.max("class").alias("_high"))
    asking = grouped.select("class", "n", F.explode(F.concat("inner", "outer")).alias("shingle"))
    asking = asking.groupBy("shingle", "class").agg(F.min("n").alias("_small"), F.max("n").alias("_large"))
    met = asking.join(matrix, "shingle").filter("(_low <> class or _high <> class) and _least <= _large").filter(F.col("_most") >= _sql_least("_small", threshold))
    visits = met.groupBy("group", "class").agg(F.count("*").alias("_met"), F.min("_small").alias("_small"), F.collect_list("shingle").alias("tokens")).filter(F.col("_met") >= _sql_level("_small", threshold))
    visits = durable(visits.select("group", "class", "tokens"))
    queries = durable(_visitors(grouped, visits, threshold))
    discard(several, packed, visits)
    members = grouped.join(queries.select("group").distinct(), "group", "left_semi").select(*queries.columns)
    out = durable(descend(deal(members, queries), threshold))
    discard(grouped, queries)
    return out


def _visitors(grouped: DataFrame, visits: DataFrame, threshold: Threshold) -> DataFrame:
    """group, node, class, n, inner, outer: of each class that visits groups, the nodes that hold enough of the tokens that it shares with the group.

    The nodes of a large class are dealt to several parts, each of which gets the class's visits.
    """
    parts = durable(grouped.groupBy("class").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("_parts")))
    shown = visits.join(parts, "class").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    shown = shown.select("class", "part", F.lit(0).alias("asks"), F.col("group").alias("id"), F.lit(0).cast("bigint").alias("n"), F.col("tokens").alias("inner"), F.array().cast("array<bigint>").alias("outer"))
    asking = grouped.join(visits.select("class").distinct(), "class", "left_semi").join(parts, "class")
    asking = asking.select("class", F.pmod(F.xxhash64("node"), F.col("_parts").cast("bigint")).cast("int").alias("part"), F.lit(1).alias("asks"), F.col("node").alias("id"), "n", "inner", "outer")
    rows = shown.unionByName(asking).repartition(n_partitions(grouped.sparkSession), "class", "part").sortWithinPartitions("class", "part", "asks", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, groups, waiting, held = None, None, [], []
        for batch in batches:
            rows, found = [], []
            inner, outer = (_lists(batch.column(k)) for k in (5, 6))
            for k, (own, part, asks, i, n) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(5)), strict=True)):
                if (own, part) != at:
                    at, groups, waiting, held = (own, part), None, [], []
                if not asks:
                    waiting.append(inner[k])
                    held.append(i)
                    continue
                groups = groups or Postings(waiting)
                tokens = np.concatenate([inner[k], outer[k]])
                enough = np.flatnonzero(groups.shared(groups.places(tokens)) >= threshold.level(threshold.least(n)))
                rows += [k] * len(enough)
                found += [held[j] for j in enough.tolist()]
            kept = batch.take(pa.array(rows, pa.int64()))
            columns = [pa.array(found, pa.int64()), *(kept.column(j) for j in (3, 0, 4, 5, 6))]
            yield pa.RecordBatch.from_arrays(columns, names=["group", "node", "class", "n", "inner", "outer"])

    return rows.mapInArrow(run, "group bigint, node bigint, class bigint, n bigint, inner array<bigint>, outer array<bigint>")


def link_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """A row for each row of df: id, n_shingles, component_id (the smallest id of the row's class).

    Two rows link when den * |intersection| >= num * |union| of their shingle
    sets; rows with equal sets are of one class. A null or empty text, or one
    without words, has an empty set and is a class of its own. A very long text
    is one set like any other. Repeated rows stay. Null ids are passed over in
    component_id, which is null only if the class has no other id. Other
    columns, whatever their names, are not read. An empty table gives an empty
    result.
    """
    threshold = Threshold(num, den)
    id_name, text_name = quoted(id_col), quoted(text_col)
    docs = df.select(F.col(id_name).alias("_id"), F.col(text_name).cast("binary").alias("data"))
    surveyed = durable(survey(docs, "_id", width))
    texts = docs.select("data")
    found, nodes, entries = describe(texts, width, threshold, frequent(surveyed))

    labels = edges = None
    stars = durable(_stars(nodes, threshold))
    if not stars.isEmpty():
        centres = stars.select("group").distinct().select("group", F.col("group").alias("node"), F.col("group").alias("class"))
        needed = durable(stars.select("node").union(centres.select("node")).distinct())
        opened = open_sets(texts, width, needed)
        edges = durable(visit(deal(centres, stars.withColumn("class", F.col("node"))), opened, threshold))
        discard(needed)
        if not edges.isEmpty():
            labels = components(edges)

    discard(stars)
    candidates = _candidates(nodes, entries, labels, threshold)
    discard(found)
    if not candidates.isEmpty():
        needed = durable(candidates.select("node").distinct())
        more = durable(visit(candidates, open_sets(texts, width, needed), threshold))
        discard(needed)
        if not more.isEmpty():
            labels = components(more if edges is None else edges.union(more))

    discard(candidates)
    rows = surveyed.filter(F.col("n").isNotNull()).select("_id", F.col("n").alias("n_shingles"), "node")
    rows = _class(labels, rows)
    alone = rows.filter(F.col("node").isNull()).select("_id", "n_shingles", F.col("_id").alias("component_id"))
    # Written first, so that Spark can split the join at a class of many rows.
    least = durable(rows.filter(F.col("node").isNotNull()).groupBy("class").agg(F.min("_id").alias("component_id")))
    out = rows.filter(F.col("node").isNotNull()).join(least, "class").select("_id", "n_shingles", "component_id").unionByName(alone)
    return out.withColumnRenamed("_id", id_col)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_classes(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
  FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (
  WITH RECURSIVE r(doc_id, reach) AS (
    SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, p.b FROM r JOIN p ON r.reach = p.a)
  SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, len(s.s) AS n_shingles, r.component_id FROM s JOIN r USING (doc_id)
"""
