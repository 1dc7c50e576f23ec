"""Mixing sources to target weights, with DataFrame functions only.

Sources share all words by weight; a source gives each document at most
``max_epochs`` times. A source's target is met by whole epochs and a part of
one more: documents are permuted by a hash and, of those not longer than what
is missing, the longest beginning that fits is taken; this is repeated with what
is still missing, then a few documents, the largest that fit, close the gap.

An epoch of a source is cut into at most ``blocks`` blocks by ranges of the
permutation. Which shard gets which block comes from a splitting tree: at each
node the blocks of all sources, counted by source, are divided between the
left and the right half of the node's shards by a multivariate hypergeometric
draw, down to single shards; so quotas are exact and blocks disjoint. Each
source's blocks are permuted, and shards take theirs in turn; within a shard,
documents are ordered by another hash.

What comes to the driver is a row per source; the tables that are broadcast
have a row per source, and hold blocks * max_epochs numbers in it at most.
Sizes are summed over ranges of the permutation, so that of a source's n rows
no task holds more than about the square root of n to find where to stop. Everything follows from the seed, the ids and the
sizes, so reruns agree.
"""

from __future__ import annotations

import json
import math
import random
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxwood.llm.common import WORD, durable, quoted, table

#: Sources are listed on the driver; a table with more of them has a wrong source column.
MAX_SOURCES = 100_000
_KEY_BITS = 63
#: Beginnings of the permutation that are taken, one after another.
_BEGINNINGS = 4


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> list[float]:
    """The target of each source: all words shared by weight; what exceeds max_epochs times a source's size is shared again by the others."""
    total = float(sum(n for _, n in sizes))
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    capped: set[int] = set()
    while True:
        rest = total - sum(max_epochs * sizes[i][1] for i in capped)
        shares = sum(w for i, w in enumerate(weight) if i not in capped)
        unit = rest / shares if shares else 0.0
        over = {i for i, (_, n) in enumerate(sizes) if i not in capped and unit * weight[i] > max_epochs * n}
        if not over:
            return [float(max_epochs * n) if i in capped else unit * weight[i] for i, (_, n) in enumerate(sizes)]
        capped |= over


def split_quotas(blocks: list[int], shards: int, seed: int) -> list[list[int]]:
    """quotas[shard][source]: blocks of each source for each shard, by the splitting tree."""
    out: list[list[int]] = [[] for _ in range(shards)]

    def split(first: int, n: int, quota: list[int]) -> None:
        if n == 1:
            out[first] = quota
            return
        half = n // 2
        share = sum(quota) * half
        rng = random.Random(f"{seed}/{first}/{n}")
        room = share // n + (rng.random() < share % n / n)
        drawn = Counter(rng.sample(range(len(quota)), k=room, counts=quota)) if room else Counter()
        left = [drawn[i] for i in range(len(quota))]
        split(first, half, left)
        split(first + half, n - half, [a - b for a, b in zip(quota, left, strict=True)])

    split(0, shards, blocks)
    return out


def shards_of_blocks(blocks: list[int], shards: int, seed: int) -> list[list[int]]:
    """For each source, the shard of each of its blocks: the quotas dealt along a permutation of the blocks."""
    quotas = split_quotas(blocks, shards, seed)
    out = []
    for source, n in enumerate(blocks):
        order = list(range(n))
        random.Random(f"{seed}:{source}").shuffle(order)
        dealt = [0] * n
        at = iter(order)
        for shard in range(shards):
            for _ in range(quotas[shard][source]):
                dealt[next(at)] = shard
        out.append(dealt)
    return out


@dataclass
class Source:
    name: str | None
    size: int
    rows: int
    target: float
    epochs: int = 0
    rest: float = 0.0
    taken: int = 0
    limits: list[float] = field(default_factory=list)  # rows of at most that size are taken up to the key in ends
    ends: list[int] = field(default_factory=list)
    more: list[int] = field(default_factory=list)
    per_epoch: int = 1
    shards: list[int] = field(default_factory=list)


def inline_table(spark: SparkSession, columns: dict[str, tuple[str, list]]) -> DataFrame:
    """A small table from one literal: name -> (type, values)."""
    rows = [dict(zip(columns, values, strict=True)) for values in zip(*(values for _, values in columns.values()), strict=True)]
    schema = "array<struct<" + ",".join(f"{name}:{kind}" for name, (kind, _) in columns.items()) + ">>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), schema)))


def _key(seed: int, epoch: int | Column, id_col: Column, size: Column) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(epoch) if isinstance(epoch, int) else epoch, id_col, size).bitwiseAND(F.lit(2**_KEY_BITS - 1))


def _sources(slim: DataFrame, weights: tuple[int, ...], max_epochs: int) -> list[Source]:
    rows = slim.groupBy("_source").agg(F.sum("_size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r["_source"] is None, r["_source"] or ""))
    goals = targets([(r["_source"], r["size"]) for r in rows], weights, max_epochs)
    out = [Source(r["_source"], r["size"], r["n"], t) for r, t in zip(rows, goals, strict=True)]
    for s in out:
        if s.size:
            s.epochs = min(max_epochs, int(s.target // s.size))
            s.rest = s.target - s.epochs * s.size if s.epochs < max_epochs else 0.0
    return out


def _state(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """_goal_of, _gap and what is taken, of each source; small, for a broadcast."""
    return inline_table(spark, {"_goal_of": ("string", [s.name for s in sources]), "_gap": ("double", [s.rest - s.taken for s in sources]), "_limits": ("array<double>", [s.limits for s in sources]), "_ends": ("array<bigint>", [s.ends for s in sources]), "_more": ("array<bigint>", [s.more for s in sources])})


def _is_taken() -> Column:
    begun = F.exists(F.arrays_zip("_limits", "_ends"), lambda x: (F.col("_size") <= x["_limits"]) & (F.col("_key") <= x["_ends"]))
    return begun | F.array_contains("_more", F.col("_key"))


def _begin(slim: DataFrame, sources: list[Source]) -> None:
    """Takes, of each source's rows that fit into its gap, the longest beginning of the permutation within the gap."""
    bits = max(4, math.ceil(math.log2(max(2, *(s.rows for s in sources))) / 2))
    left = slim.join(F.broadcast(_state(slim.sparkSession, sources)), F.col("_source").eqNullSafe(F.col("_goal_of"))).filter((F.col("_size") <= F.col("_gap")) & ~_is_taken())
    left = left.select("_source", "_gap", "_size", "_key", F.shiftright("_key", _KEY_BITS - bits).alias("_range"))
    along = Window.partitionBy("_source").orderBy("_range")
    sums = left.groupBy("_source", "_gap", "_range").agg(F.sum("_size").alias("_words")).withColumn("_upto", F.sum("_words").over(along))
    # The range in which the gap is passed, and what lies before it.
    passed = sums.groupBy("_source").agg(
        F.min(F.when(F.col("_upto") > F.col("_gap"), F.col("_range"))).alias("_at"),
        F.coalesce(F.max(F.when(F.col("_upto") <= F.col("_gap"), F.col("_upto"))), F.lit(0)).alias("_before"),
    )
    found = {r["_source"]: r for r in passed.collect()}
    inner = [s for s in sources if s.name in found and found[s.name]["_at"] is not None]
    ends = {}
    if inner:
        at = inline_table(slim.sparkSession, {"_in": ("string", [s.name for s in inner]), "_at": ("bigint", [found[s.name]["_at"] for s in inner]), "_before": ("bigint", [found[s.name]["_before"] for s in inner])})
        inside = left.join(F.broadcast(at), F.col("_source").eqNullSafe(F.col("_in")) & (F.col("_range") == F.col("_at")))
        inside = inside.withColumn("_after", F.col("_before") + F.sum("_size").over(Window.partitionBy("_source").orderBy("_key")))
        rows = inside.groupBy("_source").agg(F.min(F.when(F.col("_after") > F.col("_gap"), F.col("_key"))).alias("end"), F.max(F.when(F.col("_after") <= F.col("_gap"), F.col("_after"))).alias("upto")).collect()
        ends = {r["_source"]: r for r in rows}
    for s in sources:
        if s.name in found:
            gap, before = s.rest - s.taken, found[s.name]["_before"]
            r = ends.get(s.name)
            s.limits.append(gap)
            s.ends.append(r["end"] - 1 if r else 2**_KEY_BITS - 1)
            s.taken += r["upto"] if r and r["upto"] is not None else before


def _fill(slim: DataFrame, sources: list[Source], rounds: int, near: float) -> None:
    """Adds to more, a round at a time, the key of the largest row left that fits into each source's gap.

    In the last round the smallest row that doesn't fit is added where that comes nearer to the target.
    """
    for i in range(rounds + 1):
        over = i == rounds
        want = [s for s in sources if s.rest - s.taken >= max(1.0, near * s.target)]
        if not want:
            return
        left = slim.join(F.broadcast(_state(slim.sparkSession, want)), F.col("_source").eqNullSafe(F.col("_goal_of"))).filter(~_is_taken())
        # Rows of one id share a key and are taken together.
        left = left.groupBy("_source", "_gap", "_key").agg(F.sum("_size").alias("_size")).filter((F.col("_size") > F.col("_gap")) & (F.col("_size") < 2 * F.col("_gap")) if over else (F.col("_size") > 0) & (F.col("_size") <= F.col("_gap")))
        best = {r["_source"]: r["x"] for r in left.groupBy("_source").agg((F.min if over else F.max)(F.struct(F.col("_size"), F.col("_key"))).alias("x")).collect()}
        for s in want:
            if x := best.get(s.name):
                s.taken += x["_size"]
                s.more.append(x["_key"])


def _place(sources: list[Source], shards: int, blocks: int, seed: int) -> None:
    for s in sources:
        s.per_epoch = max(1, min(blocks, s.rows // 8))
    last = [max([1, *s.ends]) if s.ends or s.more else 0 for s in sources]
    counts = [s.epochs * s.per_epoch + math.ceil(end / 2**_KEY_BITS * s.per_epoch) for s, end in zip(sources, last, strict=True)]
    for s, dealt in zip(sources, shards_of_blocks(counts, shards, seed), strict=True):
        s.shards = dealt


def _prepared(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """_id, _source, _size, _key, and _whole: the row itself, apart from these names."""
    whole = df.select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(source_col)).cast("string").alias("_source"), words_in(F.col(quoted(text_col))).alias("_size"), F.struct(*map(quoted, df.columns)).alias("_whole"))
    return whole.withColumn("_key", _key(seed, 0, F.col("_id"), F.col("_size")))


def _decide(slim: DataFrame, weights: tuple[int, ...], max_epochs: int, shards: int, blocks: int, seed: int, rounds: int, near: float) -> list[Source]:
    sources = _sources(slim, weights, max_epochs)
    for _ in range(_BEGINNINGS):
        if want := [s for s in sources if s.rest - s.taken >= max(1.0, near * s.target)]:
            _begin(slim, want)
    _fill(slim, sources, rounds, near)
    if sources:
        _place(sources, shards, blocks, seed)
    return sources


def _apply(rows: DataFrame, sources: list[Source], seed: int) -> DataFrame:
    """rows with source_size, target and copies: array<struct<epoch,block,shard,order>>, one for each time that the mix takes the row."""
    copy = "array<struct<epoch:int,block:int,shard:int,order:bigint>>"
    if not sources:
        return rows.withColumns({"source_size": F.lit(None).cast("long"), "target": F.lit(None).cast("double"), "copies": F.lit(None).cast(copy)})
    plan = inline_table(
        rows.sparkSession,
        {
            "_name": ("string", [s.name for s in sources]), "source_size": ("bigint", [s.size for s in sources]), "target": ("double", [s.target for s in sources]), "_epochs": ("int", [s.epochs for s in sources]),
            "_limits": ("array<double>", [s.limits for s in sources]), "_ends": ("array<bigint>", [s.ends for s in sources]), "_more": ("array<bigint>", [s.more for s in sources]), "_per": ("int", [s.per_epoch for s in sources]), "_shards": ("array<int>", [s.shards for s in sources]),
        },
    )
    joined = rows.join(F.broadcast(plan), F.col("_source").eqNullSafe(F.col("_name")))
    id_value, size = F.col("_id"), F.col("_size")
    in_part = _is_taken().cast("int")

    def made(epoch: Column) -> Column:
        # The part of an epoch goes by the key that its cut is for; whole epochs have permutations of their own.
        part = epoch == F.col("_epochs")
        key = F.when(part, F.col("_key")).otherwise(_key(seed, epoch + 1, id_value, size))
        block = F.floor(F.shiftright(key, 31) * F.col("_per") / F.lit(2**32)).cast("int") + epoch * F.col("_per")
        block = F.least(block, F.size("_shards") - 1)
        return F.struct(epoch.cast("int").alias("epoch"), block.alias("block"), F.get("_shards", block).alias("shard"), _key(seed + 1, epoch, id_value, size).alias("order"))

    n = F.col("_epochs") + in_part
    copies = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), made)).otherwise(F.array().cast(copy))
    return joined.withColumn("copies", copies.cast(copy))


def mix_plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, shards: int = 16, blocks: int = 256, seed: int = 0, rounds: int = 8, near: float = 0.0005) -> DataFrame:
    """A row for each row of df: id, size, source_size, target, copies, taken (words that the mix takes).

    A null text has size 0 and is taken with no words; a null source is a
    source of its own and the last one. Rows with a repeated id and equal size are
    taken together. A very long text is taken whole or not at all. Other columns,
    whatever their names, pass through (mix) or are not read (mix_plan). An empty table gives an empty result.
    """
    slim = durable(_prepared(df, id_col, text_col, source_col, seed).drop("_whole"))
    out = _apply(slim, _decide(slim, weights, max_epochs, shards, blocks, seed, rounds, near), seed)
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", (F.size("copies") * F.col("_size")).cast("long").alias("taken"), "copies")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, shards: int = 16, blocks: int = 256, seed: int = 0, rounds: int = 8, near: float = 0.0005) -> DataFrame:
    """The mix: rows of df, each as often as it is taken, dealt to the partitions by shard and shuffled in each; the columns are those of df.

    Nulls, repeated rows and empty tables are treated as in mix_plan.
    """
    prepared = _prepared(df, id_col, text_col, source_col, seed)
    slim = durable(prepared.drop("_whole"))
    rows = _apply(prepared, _decide(slim, weights, max_epochs, shards, blocks, seed, rounds, near), seed)
    rows = rows.select("_whole", F.explode("copies").alias("_copy"))
    return rows.repartitionById(shards, F.col("_copy.shard")).sortWithinPartitions("_copy.order").select("_whole.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
