"""Language-model scores by a hierarchical Pitman-Yor model.

Tokens are words (A-Z in lower case) and an end for each text. A token is
served in the restaurant of the token before it (the end of a text stands for
the beginning of the next), so there is a restaurant for each word and their
number grows with the corpus; all share one parent, whose base is uniform over
the words of the training texts and one more for the unknown.

Seating is kept as the numbers of tables that serve a word in a restaurant.
A Gibbs step draws them for one word in one restaurant given all others:
with c customers and weight a for a new table, t tables have probability in
proportion to S_d(c, t) * a^t (S_d: generalized Stirling numbers). That draw
is exact up to 64 customers; further customers are seated in turn, in leaps of
one fiftieth. Words are independent given the restaurants' totals, so a sweep
runs over all words at once, and the totals are summed between sweeps. The
probabilities of the sweeps after the first are averaged.

Texts are read twice. The first time, each input partition counts its own
pairs (word, word before) and sends them, packed by word, to the word's task
(a bundle). A pair with one customer always has one table, so sweeps move the
other pairs only: a bundle sends its tables of each context to the context's
own task, which sums them and answers the bundles that asked. Two scalars
(customers and tables of the parent) come to the driver. Steps are written to
the shared folder, and seeds are fixed, so lost tasks come out the same again.
At last each partition is sent what it needs of its words and pairs, along
with its texts. The customers of a word's restaurant are as many as the word's
training count, since one token follows each.
The input must give the same partitions when it is read twice, as tables
do; a plan with a shuffle in it is written to the shared folder first. A task
that meets a word of which it was sent nothing fails, so other partitions can't give wrong scores.
Ascending hashes travel as differences, and tables of finished steps are deleted, so that disk
holds about three times the (compressed) input at most.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwood.llm.common import discard, durable, let_go, mix64, quoted, table

EXACT = 64
_SLICE = 512
#: No word holds a space.
END = xxhash.xxh3_64_intdigest(b" end")
#: Kinds of messages between tasks; ASK + k: the tables of contexts after k sweeps.
REPLY, STATE, BUNDLE, SUM, ASK = 0, 1, 2, 3, 10
_MESSAGE = "kind int, target int, origin int, data binary"
Message = tuple[int, int, int, object]


def packed(data: object, level: int = 3) -> bytes:
    """A message's bytes: what shuffles and tables hold of it."""
    raw = pickle.dumps(data, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True)


def unpacked(raw: bytes) -> object:
    return pickle.loads(pa.decompress(memoryview(raw)[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True))


def planes(x: np.ndarray) -> tuple[tuple[int, ...], bytes]:
    """float32 numbers, byte by byte."""
    return x.shape, np.ascontiguousarray(np.ascontiguousarray(x, dtype="<f4").view(np.uint8).reshape(-1, 4).T).tobytes()


def joined(planes_: tuple[tuple[int, ...], bytes]) -> np.ndarray:
    shape, raw = planes_
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(4, -1).T).view("<f4").reshape(shape)


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each token, hash of the token before it, tokens of each text), texts one after another, an end after each."""
    words = [t.lower().split() for t in texts]
    counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    total = int(counts.sum())
    is_word = np.ones(total, dtype=bool)
    is_word[np.cumsum(counts) - 1] = False
    hashes = np.full(total, END, dtype=np.uint64)
    hashes[is_word] = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), dtype=np.uint64, count=total - len(texts))
    return hashes, np.concatenate([np.array([END], dtype=np.uint64), hashes[:-1]]), counts


def bundles_for(size: int) -> int:
    """Tasks that words are dealt to, by the bytes of all texts: 16 MB for each; beyond 64 GB more for each, as every partition sends a message to every task."""
    parts = size / (1 << 24)
    return max(1, math.ceil(min(parts, 64 * math.sqrt(parts))))


def contexts_of(hashes: np.ndarray) -> np.ndarray:
    """48 bits stand for a context, which is a word too; 2 of 10^7 words share them by a chance of a fifth."""
    return hashes >> np.uint64(16)


def owners(contexts: np.ndarray, width: int) -> np.ndarray:
    """The tasks of contexts, and of the words that they are."""
    return (contexts % np.uint64(width)).astype(np.int64)


def pair_keys(hashes: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """56 bits, by which an input partition finds its pairs."""
    return mix64(hashes + mix64(contexts)) >> np.uint64(8)


def squeezed(x: np.ndarray) -> tuple[int, bytes]:
    """Ascending whole numbers as differences, byte by byte, so that bytes that are all zero cost nothing once compressed."""
    steps = np.diff(x.astype("<u8"), prepend=np.uint64(0))
    return len(x), np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def spread(squeezed_: tuple[int, bytes]) -> np.ndarray:
    n, raw = squeezed_
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(8, n).T).view("<u8").reshape(-1), dtype=np.uint64)


def small(x: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as they need."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _read(data: tuple) -> tuple[np.ndarray, ...]:
    """(words, contexts of each, contexts, training counts, whether in held-out texts) of a message of count_pairs."""
    words, fans, low, counts, held = data
    raw = np.zeros((len(counts), 8), dtype=np.uint8)
    raw[:, :6] = np.frombuffer(low, dtype=np.uint8).reshape(-1, 6)
    return spread(words), fans.astype(np.int64), raw.view("<u8").reshape(-1), counts.astype(np.int64), np.unpackbits(held, count=len(counts)).astype(bool)


def _merge(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(keys, words, contexts, training counts, held-out counts) with equal keys summed, by key."""
    keys, words, contexts, *counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    keys, first, at = np.unique(keys, return_index=True, return_inverse=True)
    return keys, words[first], contexts[first], *(np.bincount(at, weights=x, minlength=len(keys)).astype(np.int64) for x in counts)


def _sent(messages: list[Message]) -> Iterator[pa.RecordBatch]:
    """A batch for each message, so that large ones don't meet in one."""
    for kind, target, origin, data in messages:
        values = [pa.array([x], pa.int32()) for x in (kind, target, origin)] + [pa.array([packed(data)], pa.binary())]
        yield pa.RecordBatch.from_arrays(values, names=["kind", "target", "origin", "data"])


def _step(messages: DataFrame, width: int, of) -> DataFrame:
    """The messages that of(target, messages by kind and origin) gives for each target; a target's messages meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(r["kind"], r["origin"], r["target"], unpacked(r["data"])) for batch in batches for r in batch.to_pylist()]
        if got:
            got.sort(key=lambda r: r[:2])
            yield from _sent(of(got[0][2], [(kind, origin, data) for kind, origin, _, data in got]))

    return messages.repartitionById(width, F.col("target")).mapInArrow(run, _MESSAGE)


def count_pairs(docs: DataFrame, width: int) -> DataFrame:
    """Messages to the tasks of words: (words, contexts of each, contexts, counts, whether in held-out texts) of the pairs of an input partition (the origin)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, waiting, block = [], 0, None
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                block = part.column("block")[0].as_py()
                hashes, contexts, counts = tokens_of([t or b"" for t in part.column("data").to_pylist()])
                held = np.repeat(np.asarray(part.column("held_out").to_numpy(zero_copy_only=False), dtype=bool), counts)
                contexts = contexts_of(contexts)
                parts.append(_merge([(mix64(hashes + mix64(contexts)), hashes, contexts, ~held, held)]))
                waiting += len(parts[-1][0])
                if waiting > 2_000_000 + len(parts[0][0]) // 2:
                    parts = [_merge(parts)]
                    waiting = 0
        if not parts:
            return
        _, words, contexts, counts, held = _merge(parts)
        target = owners(contexts_of(words), width)
        order = np.lexsort((contexts, words, target))
        edges = np.searchsorted(target[order], np.arange(width + 1))
        for t in range(width):
            own = order[edges[t] : edges[t + 1]]
            if len(own):
                distinct, fans = np.unique(words[own], return_counts=True)
                low = np.ascontiguousarray(contexts[own].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
                yield from _sent([(BUNDLE, t, block, (squeezed(distinct), small(fans), low, small(counts[own]), np.packbits(held[own] > 0)))])

    return docs.select("block", "held_out", "data").mapInArrow(run, _MESSAGE)


@lru_cache(maxsize=8)
def log_stirling(d: float) -> np.ndarray:
    """log S_d(c, t) for c and t up to EXACT: S(c + 1, t) = S(c, t - 1) + (c - t d) S(c, t)."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(EXACT):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            stay = np.where(t <= c, np.log(np.maximum(c - t * d, 1e-300)), -np.inf) + out[c, 1 : c + 2]
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c, : c + 1], stay)
    return out


def draw_tables(c: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables for c customers each, where a is the weight of a new table."""
    t = np.minimum(c, 1)
    small = np.minimum(c, EXACT)
    stirling = log_stirling(d)
    order = np.argsort(small, kind="stable")
    edges = np.searchsorted(small[order], np.arange(2, EXACT + 2))
    log_a = np.log(a)
    for n in range(2, EXACT + 1):
        own = order[edges[n - 2] : edges[n - 1]]
        for at in range(0, len(own), 1 << 16):
            some = own[at : at + (1 << 16)]
            weight = stirling[n, 1 : n + 1] + log_a[some, None] * np.arange(1, n + 1)
            weight += rng.gumbel(size=weight.shape)
            t[some] = weight.argmax(1) + 1
    more = np.flatnonzero(c > EXACT)
    i, k, weight, last = np.full(len(more), EXACT, dtype=np.int64), t[more], a[more], c[more]
    going = np.arange(len(more))
    while len(going):
        norm = i[going] - d * k[going] + weight[going]
        leap = np.minimum(np.maximum(1, norm / 50).astype(np.int64), last[going] - i[going])
        k[going] += rng.binomial(leap, np.clip(weight[going] / norm, 0, 1))
        i[going] += leap
        going = going[i[going] < last[going]]
    t[more] = k
    return t


class Pairs:
    """A bundle: pairs (word, context) with training counts, and the entries of input partitions."""

    def __init__(self, parts: list[tuple[np.ndarray, ...]]):
        join = lambda k: np.concatenate([x[k] for x in parts])
        words, contexts = np.repeat(join(0), join(1)), join(2)
        # Entries: as they came; pairs: distinct (word, context); words: distinct.
        order = np.lexsort((contexts, words))
        sorted_words, sorted_contexts = words[order], contexts[order]
        new_word = np.concatenate([[True], sorted_words[1:] != sorted_words[:-1]])
        new_pair = new_word | np.concatenate([[True], sorted_contexts[1:] != sorted_contexts[:-1]])
        pair_at = np.cumsum(new_pair) - 1
        self.entry_pair = np.empty(len(order), dtype=np.int64)
        self.entry_pair[order] = pair_at
        self.c = np.bincount(pair_at, weights=join(3)[order]).astype(np.int64)
        self.contexts = sorted_contexts[new_pair]
        self.word_of = (np.cumsum(new_word) - 1)[new_pair]
        self.words = sorted_words[new_word]
        self.c_word = self.by_word(self.c)
        self.many = np.flatnonzero(self.c > 1)

    def by_word(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.word_of, weights=x, minlength=len(self.words)).astype(np.int64)


def asks(contexts: np.ndarray, values: tuple[np.ndarray, ...], origin: int, kind: int, width: int) -> list[Message]:
    """values of contexts (by task, then context), to the contexts' tasks."""
    edges = np.searchsorted(owners(contexts, width), np.arange(width + 1))
    return [(kind, t, origin, (squeezed(contexts[i:j]), *(small(x[i:j]) for x in values))) for t, (i, j) in enumerate(zip(edges, edges[1:], strict=False)) if i < j]


def _by_task(contexts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct contexts by task, then context, and where each of the given ones is."""
    distinct, at = np.unique(contexts, return_inverse=True)
    order = np.lexsort((distinct, owners(distinct, width)))
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], place[at]


def start(target: int, got: list, width: int) -> list[Message]:
    """A table for each pair: the state of a bundle, what its input partitions ask for, tables of its contexts, and its share of the basics.

    Of the pairs that no held-out text of the partition has, those with one customer are not asked for: the partition knows them by that.

    Basics: training tokens; known words; pairs with 1 and 2 customers; words in 1 and 2 restaurants; customers and tables of the parent.
    """
    parts = [_read(data) for *_, data in got]
    pairs = Pairs(parts)
    t, known = np.minimum(pairs.c, 1), pairs.c_word > 0
    n = pairs.by_word(t)
    seen, at = _by_task(pairs.contexts[pairs.c > 0], width)
    single = pairs.c[pairs.c > 0] == 1
    fixed, more = (np.bincount(at[x], minlength=len(seen)).astype(np.int32) for x in (single, ~single))
    moving, context_of = _by_task(pairs.contexts[pairs.many], width)
    state = {
        "c": pairs.c[pairs.many].astype(np.int32), "word_of": pairs.word_of[pairs.many].astype(np.int32), "context_of": context_of.astype(np.int32), "contexts": moving,
        "t": t[pairs.many].astype(np.int32), "single": pairs.by_word(pairs.c == 1).astype(np.int32), "t0": np.minimum(n, 1).astype(np.int32), "sum_t": 0, "parents": [],
    }
    basics = [pairs.c.sum(), known.sum(), (pairs.c == 1).sum(), (pairs.c == 2).sum(), (n == 1).sum(), (n == 2).sum(), n.sum(), known.sum()]
    place = np.full(len(pairs.c), -1, dtype=np.int32)
    place[pairs.many] = np.arange(len(pairs.many))
    asking, first = [], 0
    for (_, block, _), (words, _, contexts, counts, held) in zip(got, parts, strict=True):
        own = pairs.entry_pair[first : first + len(contexts)]
        first += len(contexts)
        own = own[(pairs.c[own] > 1) | ((pairs.c[own] == 1) & (held | (counts == 0)))]
        asking.append((block, np.searchsorted(pairs.words, words), own))
    # Pairs that any partition asks for, by key; partitions ask by their places in that order.
    needed = np.unique(np.concatenate([own for *_, own in asking]))
    keys = pair_keys(pairs.words[pairs.word_of[needed]], pairs.contexts[needed])
    by_key = np.argsort(keys)
    place_of = np.empty(len(needed), dtype=np.int64)
    place_of[by_key] = np.arange(len(needed))
    asked = [(block, small(np.diff(at, prepend=0)), small(np.diff(np.sort(place_of[np.searchsorted(needed, own)]), prepend=0))) for block, at, own in asking]
    bundle = (squeezed(pairs.words), small(pairs.c_word), squeezed(keys[by_key]), place[needed[by_key]], asked)
    return [(STATE, target, 0, state), (BUNDLE, target, 0, bundle), (SUM, -1, target, np.array(basics, dtype=np.float64)), *asks(seen, (fixed, more), target, ASK, width)]


def answer_asks(target: int, got: list) -> list[Message]:
    """For each bundle that has pairs with more than one customer in contexts of this task: tables of those contexts with one customer, and others."""
    contexts, at = np.unique(np.concatenate([spread(data[0]) for *_, data in got]), return_inverse=True)
    sums = [np.bincount(at, weights=np.concatenate([data[k] for *_, data in got]), minlength=len(contexts)).astype(np.int64) for k in (1, 2)]
    out, first = [], 0
    for _, origin, data in got:
        own = at[first : first + len(data[2])][data[2] > 0]
        first += len(data[2])
        if len(own):
            out.append((REPLY, origin, target, tuple(small(x[own]) for x in sums)))
    return out


class Hyper:
    """Discounts from the numbers of singletons and pairs; strengths are fixed."""

    def __init__(self, basics: np.ndarray):
        self.known, n1, n2, m1, m2 = basics[1:6]
        share = lambda a, b: float(np.clip(round(a / max(1.0, a + 2 * b), 3), 0.1, 0.95))
        self.d1, self.d0 = share(n1, n2), share(m1, m2)
        self.s1, self.s0 = 1.0, 1.0
        self.base = 1.0 / (self.known + 1)
        self.first = basics[6:]
        self.tokens = int(basics[0])

    def parent(self, customers: np.ndarray, tables: np.ndarray, totals: np.ndarray) -> np.ndarray:
        return (customers - self.d0 * tables + (self.s0 + self.d0 * totals[1]) * self.base) / (self.s0 + totals[0])


def customers_of(state: dict) -> np.ndarray:
    """Customers of the bundle's words in the parent: the tables that serve them."""
    return state["single"] + np.bincount(state["word_of"], weights=state["t"], minlength=len(state["single"])).astype(np.int64)


def sweep(target: int, got: list, hyper: Hyper, k: int, totals: np.ndarray, burn: int, seed: int, width: int) -> list[Message]:
    """Sweep k of a bundle; totals: customers and tables of the parent before it."""
    state = next(data for kind, _, data in got if kind == STATE)
    replies = [data for kind, _, data in got if kind == REPLY]
    join = lambda i: np.concatenate([x[i] for x in replies]) if replies else np.zeros(0)
    if k == 0:
        state["fixed"] = small(join(0).astype(np.int64))
    tables = state["fixed"] + join(1).astype(np.float64)
    rng = np.random.default_rng((seed, target, k))
    p0 = hyper.parent(customers_of(state), state["t0"], totals)
    if k > burn:
        state["parents"].append(p0.astype(np.float32))
    a = (hyper.s1 + hyper.d1 * tables[state["context_of"]]) * p0[state["word_of"]]
    t = draw_tables(state["c"].astype(np.int64), np.maximum(a, 1e-300), hyper.d1, rng)
    state["t"] = t.astype(np.int32)
    if k >= burn:
        state["sum_t"] = (state["sum_t"] + t).astype(np.int32)
    customers = customers_of(state)
    state["t0"] = draw_tables(customers, np.full(len(customers), (hyper.s0 + hyper.d0 * totals[1]) * hyper.base), hyper.d0, rng).astype(np.int32)
    contexts = state["contexts"]
    more = np.bincount(state["context_of"], weights=t, minlength=len(contexts)).astype(np.int64)
    sums = np.array([customers.sum(), state["t0"].sum()], dtype=np.float64)
    return [(STATE, target, 0, state), (SUM, -1, target, sums), *asks(contexts, (np.zeros(len(contexts), dtype=np.int8), more), target, ASK + k + 1, width)]


def answers(target: int, got: list, hyper: Hyper, totals: np.ndarray, n_sweeps: int, burn: int) -> list[Message]:
    """For each input partition (the target): its words with count, parent's probabilities and tables of their own restaurants in the sweeps kept; keys of pairs with customers, less their discounts."""
    state, (words, c_word, keys, place, asked) = (next(data for kind, _, data in got if kind == x) for x in (STATE, BUNDLE))
    words, keys = spread(words), spread(keys)
    kept = n_sweeps - burn
    parents = np.array([*state["parents"], hyper.parent(customers_of(state), state["t0"], totals)], dtype=np.float32)
    tables = np.zeros((kept, len(words)), dtype=np.int64)
    contexts = contexts_of(words)  # ascending, as the words are
    for kind, _, data in got:
        if kind >= ASK:
            at = np.searchsorted(contexts, spread(data[0]))
            if kind == ASK:
                tables[:, at] += data[1]
            else:
                tables[kind - ASK - burn - 1, at] += data[2]
    rest = np.append(state["c"] - hyper.d1 * state["sum_t"] / kept, 1 - hyper.d1).astype(np.float32)[place]  # the last: one customer
    out = []
    for block, at, own in asked:
        at, own = np.cumsum(at, dtype=np.int64), np.cumsum(own, dtype=np.int64)
        out.append((REPLY, block, target, (squeezed(words[at]), c_word[at], planes(parents[:, at]), small(tables[:, at]), squeezed(keys[own]), planes(rest[own]))))
    return out


def packed_texts(docs: DataFrame, kind: str) -> DataFrame:
    """block, kind (1), ids, held_out, data: a row for each slice of an input partition, its texts packed together, as they cross a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                one = lambda c: pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c))  # noqa: E731, B023
                data = packed([t or b"" for t in part.column("data").to_pylist()], 9)
                yield pa.RecordBatch.from_arrays([part.column("block").slice(0, 1), pa.array([1], pa.int32()), one("id"), one("held_out"), pa.array([data], pa.binary())], names=["block", "kind", "ids", "held_out", "data"])

    return docs.select("block", "id", "held_out", "data").mapInArrow(run, f"block int, kind int, ids array<{kind}>, held_out array<boolean>, data binary")


def _sums(messages: DataFrame) -> np.ndarray | None:
    """The sum of the SUM messages; None if there is none."""
    rows = messages.filter(F.col("kind") == SUM).select("data").collect()
    return sum(unpacked(r["data"]) for r in rows) if rows else None


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 1, n_sweeps: int = 4, burn: int = 1, seed: int = 0) -> DataFrame:
    """A row for each row of df: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from rows whose crc32(id as text) mod folds isn't
    held_fold (a null id counts as an empty text). A null text is an empty
    one: its only token is the end. score is the log10 probability of the text
    under the model, base_score under smoothed word counts. Repeated rows stay
    and count as often as they occur. A very long text is scored whole. Other
    columns, whatever their names, are not read. An empty table gives an empty result.
    """
    spark = df.sparkSession
    fold = F.crc32(F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")).cast("binary")) % folds
    docs = df.select(F.col(quoted(id_col)).alias("id"), (fold == held_fold).alias("held_out"), F.col(quoted(text_col)).cast("binary").alias("data"))
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = durable(docs)
    blocks = max(1, docs.rdd.getNumPartitions())
    docs = docs.withColumn("block", F.spark_partition_id())
    width = bundles_for(docs.agg(F.sum(F.length("data"))).first()[0] or 0)
    kind = dict(df.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    messages = durable(_step(count_pairs(docs, width), width, lambda target, got: start(target, got, width)))
    let_go(spark)
    written = [messages]
    basics = _sums(messages)
    if basics is None:
        return spark.createDataFrame([], schema)
    hyper = Hyper(basics)
    totals = hyper.first
    gathered = messages.filter(F.col("kind").isin(BUNDLE, ASK))
    for k in range(n_sweeps):
        replies = _step(messages.filter(F.col("kind") == ASK + k), width, answer_asks)
        given = messages.filter(F.col("kind") == STATE).unionByName(replies)
        messages = durable(_step(given, width, lambda target, got, k=k, totals=totals: sweep(target, got, hyper, k, totals, burn, seed, width)))
        totals = _sums(messages)
        if k >= burn:
            gathered = gathered.unionByName(messages.filter(F.col("kind") == ASK + k + 1))
        if 1 <= k <= burn:
            discard(written.pop())
        written.append(messages)

    gathered = gathered.unionByName(messages.filter(F.col("kind") == STATE))
    replies = durable(_step(gathered, width, lambda target, got: answers(target, got, hyper, totals, n_sweeps, burn)))
    del messages, gathered, given
    discard(*written)
    none = lambda t: F.lit(None).cast(t)
    rows = packed_texts(docs, kind)
    rows = rows.unionByName(replies.select(F.col("target").alias("block"), F.lit(0).alias("kind"), none(f"array<{kind}>").alias("ids"), none("array<boolean>").alias("held_out"), "data"))
    rows = rows.repartitionById(blocks, F.col("block")).sortWithinPartitions("kind")
    tokens, unit = hyper.tokens, hyper.tokens + 0.5 * (hyper.known + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, words = [], None
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            for data in batch.filter(pa.array(kinds == 0)).column("data"):
                x = unpacked(data.as_py())
                got.append((spread(x[0]), x[1], joined(x[2]), x[3], spread(x[4]), joined(x[5])))
                del x
            asked = batch.filter(pa.array(kinds == 1))
            if not asked.num_rows:
                continue
            if words is None:
                words, counts, parents, tables, keys, rest = (np.concatenate(x, axis=-1) for x in zip(*got, strict=True))
                got = []
                counts = counts.astype(np.int64)
                order, key_order = np.argsort(words), np.argsort(keys)
                words, counts, parents, tables = words[order], counts[order], parents[:, order], tables[:, order]
                # No key at the end, so that a search always finds a place.
                keys, rest = np.append(keys[key_order], np.uint64(0)), np.append(rest[key_order], np.float32(0))
                seen, bases = len(keys) - 1, np.log10((counts + 0.5) / unit)
                weights = (hyper.s1 + hyper.d1 * tables) / (hyper.s1 + counts) / len(tables)
            for at in range(asked.num_rows):
                part = asked.slice(at, 1)
                ids, held = part.column("ids").flatten(), part.column("held_out").flatten()
                hashes, contexts, n = tokens_of(unpacked(part.column("data")[0].as_py()))
                spots, before = np.searchsorted(words, hashes), np.searchsorted(words, contexts[:1])
                if spots.max() == len(words) or (words[spots] != hashes).any():
                    raise RuntimeError("the input was divided into other partitions when it was read again")
                before = np.concatenate([before, spots[:-1]])
                asked_keys = pair_keys(hashes, contexts_of(contexts))
                places = np.searchsorted(keys[:seen], asked_keys)
                trained = ~np.asarray(held.to_numpy(zero_copy_only=False), dtype=bool)
                alone = np.repeat(np.where(trained, 1 - hyper.d1, 0.0), n)
                p = np.where((keys[places] == asked_keys) & (places < seen), rest[places], alone) / (hyper.s1 + counts[before])
                for weight, parent in zip(weights, parents, strict=True):
                    p += weight[before] * parent[spots]
                starts = np.cumsum(n) - n
                add = lambda x: np.add.reduceat(x, starts)  # noqa: E731, B023
                columns = [ids, held, pa.array(n), pa.array(add((counts > 0).astype(np.int64)[spots])), pa.array(np.full(len(n), tokens)), pa.array(add(bases[spots])), pa.array(add(np.log10(p)))]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.mapInArrow(run, schema)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
