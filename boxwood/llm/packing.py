"""Best-fit packing of tokenized documents by a grouping genetic algorithm.

Documents are tokenized and cut into pieces only where they are longer than a
sequence: the first piece takes the odd rest, the others are full. Pieces are
dealt to problems of about ``problem`` pieces; a problem's few bins that are
not full cost little next to its thousands. Several islands work on each
problem, each with its own random numbers and population:

* a chromosome is a list of bins (groups of pieces);
* crossover injects whole well-filled bins of one parent into the other,
  dissolves the other's bins that hold one of the injected pieces, and puts
  the displaced pieces back: in exchange for smaller pieces of bins that they
  fill better, then by best fit, largest first;
* mutation dissolves some of the least filled bins in the same way;
* after every epoch the island's best chromosome goes to the next island of
  the ring, which takes it into its population.

An island stops as soon as its best chromosome has as few bins as the lengths
allow; the first chromosome, by best fit alone, often has, then nothing is left to evolve.
Where best fit has filled most bins, only those with room and as many full ones
with small pieces evolve; the other full bins stay as they are. Islands of an epoch are tasks of a Spark job; between epochs
they live in a table in the shared folder.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwood.llm.common import durable, n_partitions, quoted, table

#: Chunks of text whose ids a task remembers: about 60 MB.
_CACHE = 200_000
#: Characters of texts, and chunks, that are encoded at a time.
_TEXTS, _CHUNKS = 1 << 23, 4096


def _byte_of() -> dict[str, int]:
    """The code points by which byte-level vocabularies write bytes: printable Latin-1 as itself, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _split(text: str, own: dict[str, dict], pattern: re.Pattern) -> Iterator[str | int]:
    """The text between added tokens, and their ids, as the library finds them (own: the file's entries by content)."""
    at = 0
    for m in pattern.finditer(text):
        start, stop, entry = m.start(), m.end(), own[m[0]]
        if entry.get("single_word") and (re.search(r"\w$", text[max(0, start - 1) : start]) or re.match(r"\w", text[stop : stop + 1])):
            continue
        if entry.get("lstrip"):
            start = max(at, len(text[:start].rstrip()))
        if entry.get("rstrip"):
            stop = len(text) - len(text[stop:].lstrip())
        if start > at:
            yield text[at:start]
        yield entry["id"]
        at = stop
    if at < len(text):
        yield text[at:]


class Encoder:
    """Byte-level BPE from a tokenizer file of the tokenizers library, without the tokens that a post-processor adds.

    Ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``.
    encode_special_tokens is the library's: if it is set, special strings are
    ordinary text; else a text is split at the file's added tokens, which
    become their ids. A space before a visible character
    begins a token in the pattern of these files, so a text is the chunks
    between such spaces, and the ids of common chunks are remembered.
    """

    def __init__(self, path: str, encode_special_tokens: bool = False):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"] for x in spec.get("added_tokens", ())}
        vocab = spec["model"]["vocab"]
        if spec["model"].get("type", "BPE") != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("not a plain byte-level BPE file")
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}
        # Fixed value: the pattern of byte-level pre-tokenizers.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self._plain = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._known: dict[str, bytes] = {}
        added = [x for x in spec.get("added_tokens", ()) if x["content"] and not (encode_special_tokens and x.get("special"))]
        #: The library looks for tokens that aren't normalized first, for the others in what is left; the longest of those that begin first counts.
        self._added = []
        for normalized in (False, True):
            own = {x["content"]: x for x in added if bool(x.get("normalized")) == normalized}
            if own:
                self._added.append((own, re.compile("|".join(map(re.escape, sorted(own, key=len, reverse=True))))))
        self._widths = np.zeros(max(ranks.values(), default=0) + 1, dtype=np.int64)  # bytes of each token
        for token, i in ranks.items():
            self._widths[i] = len(token)
        #: White space at a chunk's beginning, or none between two spaces.
        self._odd = re.compile(r"  | \s|^\s")

    def ids(self, text: str) -> np.ndarray:
        """uint32, little-endian."""
        parts: list[str | int] = [text]
        for own, pattern in self._added:
            parts = [y for x in parts for y in (_split(x, own, pattern) if isinstance(x, str) else (x,))]
        return np.frombuffer(b"".join([self._bytes(x) if isinstance(x, str) else x.to_bytes(4, "little") for x in parts]), dtype="<u4")

    def _pack(self, text: str) -> bytes:
        return np.array(self._plain(text), dtype="<u4").tobytes()

    def _bytes(self, text: str) -> bytes:
        if self._odd.search(text):
            return self._pack(text)
        first, *rest = text.split(" ")
        known = self._known
        out = list(map(known.get, rest))
        if None in out:
            plain = self._plain
            for i, x in enumerate(out):
                if x is None:
                    chunk = rest[i]
                    x = known.get(chunk)
                    if x is None:
                        ids = plain(" " + chunk)
                        x = b"".join([i.to_bytes(4, "little") for i in ids])
                        if len(known) < _CACHE:
                            known[chunk] = x
                    out[i] = x
        return self._pack(first) + b"".join(out)


    def many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has. Each different chunk is looked up once."""
        if not texts:
            return np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = split.values.dictionary_encode()
        chunks, at, edges = coded.dictionary, coded.indices.to_numpy().astype(np.int64), split.offsets.to_numpy().astype(np.int64)
        first, last = edges[:-1], edges[1:] - 1
        sizes = pc.binary_length(chunks).to_numpy()
        # White space at a chunk's beginning, or none between two spaces: such texts are encoded whole, as are those with added tokens.
        spaced = pc.utf8_is_space(pc.utf8_slice_codeunits(chunks, 0, 1)).to_numpy(zero_copy_only=False)
        odd = spaced[at]
        empty = np.flatnonzero(sizes == 0)
        if len(empty):
            none = at == empty[0]
            none[last] = False
            odd |= none
        whole = np.maximum.reduceat(odd, first)
        for own, _ in self._added:
            whole |= np.fromiter((any(x in t for x in own) for t in texts), dtype=bool, count=len(texts))
        plain = ~spaced & (sizes > 0)
        found, lengths = self._packed(chunks.filter(pa.array(plain)), sizes[plain])
        bare = self._pack(" ")
        begins = [self.ids(t).tobytes() if w else self._pack(t.split(" ", 1)[0]) for t, w in zip(texts, whole.tolist(), strict=True)]
        # What is taken of each part of a text: its chunk's ids, with a space before it; those of a space alone; none; or what begins this text.
        every = np.zeros(len(chunks) + 2 + len(texts), dtype=np.int64)
        every[: len(chunks)][plain] = 4 * lengths
        every[len(chunks)] = len(bare)
        every[len(chunks) + 2 :] = np.fromiter(map(len, begins), dtype=np.int64, count=len(begins))
        if len(empty):
            at[at == empty[0]] = len(chunks)
        at[np.repeat(whole, np.diff(edges))] = len(chunks) + 1
        at[first] = len(chunks) + 2 + np.arange(len(texts))
        taken = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(every), [None, pa.py_buffer(np.append(0, np.cumsum(every))), pa.py_buffer(b"".join([found, bare, *begins]))]).take(pa.array(at))
        _, stops, ids = taken.buffers()
        stops = np.frombuffer(stops, dtype=np.int64)[edges]
        return np.frombuffer(ids, dtype="<u4", count=stops[-1] // 4), np.diff(stops) // 4

    def _packed(self, chunks: pa.Array, sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The packed ids of these different chunks (of so many bytes, none with a space in it), each with a space before it, one after another; and how many each has."""
        ids, counts = [], [np.zeros(0, dtype=np.int64)]
        for k in range(0, len(chunks), _CHUNKS):
            some = chunks.slice(k, _CHUNKS)
            # Joined and split again, which is much faster than to make a string of each.
            joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(some)], pa.int64()), some), pa.scalar(" ", pa.large_string()))[0].as_py()
            own, n = self._apart(joined.split(" "), sizes[k : k + _CHUNKS])
            ids.append(own)
            counts.append(n)
        return b"".join(ids), np.concatenate(counts)

    def _apart(self, chunks: list[str], sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The same for chunks that are encoded as one text: each takes the tokens of its bytes. If a token reaches into two chunks, they are encoded one by one."""
        ids = np.array(self._plain(" " + " ".join(chunks)), dtype="<u4")
        ends = np.cumsum(self._widths[ids])
        stops = np.cumsum(sizes.astype(np.int64) + 1)
        cuts = np.searchsorted(ends, stops)
        if ends[-1] != stops[-1] or (ends[cuts] != stops).any():
            packed = [self._pack(" " + x) for x in chunks]
            return b"".join(packed), np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4
        return ids.tobytes(), np.diff(cuts, prepend=-1)


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    if n <= capacity:
        return [(0, n)]
    odd = n % capacity
    cuts = ([0] if odd else []) + list(range(odd, n, capacity))
    return [(a, b - a) for a, b in zip(cuts, [*cuts[1:], n], strict=True)]


def tokenize(df: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32 and, if with_ids, ids (little-endian uint32)."""
    kind = dict(df.dtypes)[id_col]

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // _TEXTS
        edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)]
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in (part for whole in batches for part in parts(whole)):
            at, columns = [], [[], [], [], [], []]
            texts, counts = encoder.many([x or "" for x in batch.column(1).to_pylist()])
            stops = np.cumsum(counts + 1)
            ids = np.full(len(texts) + len(counts), end_id, dtype="<u4")
            inside = np.ones(len(ids), dtype=bool)
            inside[stops - 1] = False
            ids[inside] = texts
            raw = memoryview(ids.tobytes())
            for row, (n, stop) in enumerate(zip((counts + 1).tolist(), stops.tolist(), strict=True)):
                first = stop - n
                for k, (start, length) in enumerate(pieces_of(n, capacity)):
                    own = raw[4 * (first + start) : 4 * (first + start + length)]
                    at.append(row)
                    for column, x in zip(columns, (k, start, length, zlib.crc32(own), bytes(own) if with_ids else None), strict=True):
                        column.append(x)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            arrays = [batch.column(0).take(pa.array(at, pa.int64()))] + [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + with_ids], names=[id_col, "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return df.select(F.col(quoted(id_col)), F.col(quoted(text_col))).mapInArrow(run, f"{quoted(id_col)} {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


# --- the genetic algorithm, on one problem -------------------------------------------------

Bins = list[list[int]]


def best_fit(sizes: list[int], items: list[int], bins: Bins, room: list[int], capacity: int) -> None:
    """Puts items, largest first, each into the bin with the least room that still takes it, or into a new one.

    Bins stand in stacks by room; the bits of an integer tell which stacks hold any.
    """
    stacks: dict[int, list[int]] = {}
    mask = 0
    for b, r in enumerate(room):
        if r:
            stacks.setdefault(r, []).append(b)
            mask |= 1 << r
    for i in sorted(items, key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fit = mask >> size
        if fit:
            r = size + (fit & -fit).bit_length() - 1
            stack = stacks[r]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << r)
            bins[b].append(i)
            r -= size
        else:
            b = len(bins)
            bins.append([i])
            room.append(0)
            r = capacity - size
        room[b] = r
        if r:
            stacks.setdefault(r, []).append(b)
            mask |= 1 << r


def rooms(sizes: list[int], bins: Bins, capacity: int) -> list[int]:
    size = sizes.__getitem__
    return [capacity - sum(map(size, b)) for b in bins]


def fitness(sizes: list[int], bins: Bins, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones: sum of squared fills."""
    return -len(bins), sum(((capacity - r) / capacity) ** 2 for r in rooms(sizes, bins, capacity))


def settle(sizes: list[int], displaced: list[int], bins: Bins, room: list[int], capacity: int, rng: random.Random, tries: int = 12) -> None:
    """Puts displaced pieces back: first in exchange for one or two smaller pieces of a bin that they fill better, then by best fit.

    After an exchange the displaced pieces are smaller than before, so they fit more gaps.
    """
    out = sorted((sizes[i], i) for i in displaced)
    order = [b for b, r in enumerate(room) if r and bins[b]]
    rng.shuffle(order)
    for b in order:
        if not out:
            break
        own, r = bins[b], room[b]
        leaving = [(sizes[i], (i,)) for i in own] + [(sizes[i] + sizes[j], (i, j)) for x, i in enumerate(own[:4]) for j in own[x + 1 : 4]]
        best, least = None, 0
        for size, gone in leaving:
            limit = size + r
            at = bisect_right(out, (limit, len(sizes))) - 1
            if at >= 0 and out[at][0] - size > least:
                least, best = out[at][0] - size, (gone, (at,))
            for _ in range(tries if len(out) > 1 else 0):
                one = rng.randrange(len(out))
                two = bisect_right(out, (limit - out[one][0], len(sizes))) - 1
                two -= two == one
                if two >= 0 and out[one][0] + out[two][0] - size > least:
                    least, best = out[one][0] + out[two][0] - size, (gone, (one, two))
            if least == r:
                break
        if best:
            gone, places = best
            come = [out.pop(at)[1] for at in sorted(places, reverse=True)]
            bins[b] = [i for i in own if i not in gone] + come
            room[b] = r - least
            for i in gone:
                insort(out, (sizes[i], i))
    best_fit(sizes, [i for _, i in out], bins, room, capacity)


def least_bins(sizes: list[int], capacity: int) -> int:
    """Bins that any packing needs at least: by the sum; by pieces of which at most k go into one; and by large pieces, whose bins have only so much room for the middling ones."""
    ordered = np.sort(np.array(sizes, dtype=np.int64))[::-1]
    out = -(-int(ordered.sum()) // capacity)
    for k in range(1, 9):
        out = max(out, -(-int((ordered * (k + 1) > capacity).sum()) // k))
    sums = np.append(0, np.cumsum(ordered))
    upto = lambda limit: int(np.searchsorted(-ordered, -limit, side="left"))  # noqa: E731  pieces larger than limit
    half = upto(capacity // 2)
    for at in np.unique(ordered[ordered <= capacity // 2]).tolist():
        alone, rest = upto(capacity - at), upto(at - 1)
        out = max(out, half + -(-max(0, int(sums[rest] - sums[half]) - ((half - alone) * capacity - int(sums[half] - sums[alone]))) // capacity))
    return out


def cross(sizes: list[int], one: Bins, other: Bins, capacity: int, rng: random.Random) -> Bins:
    """other's well-filled bins (a random half of the fuller half) go into one whole; one's bins that share a piece with them dissolve."""
    fills = rooms(sizes, other, capacity)
    bar = sorted(fills)[len(fills) // 2]
    injected = [list(b) for b, r in zip(other, fills, strict=True) if r <= bar and rng.random() < 0.5]
    inside = {i for b in injected for i in b}
    kept, displaced = [], []
    for b in one:
        if inside.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in inside]
    bins = injected + kept
    settle(sizes, displaced, bins, rooms(sizes, bins, capacity), capacity, rng)
    return bins


def mutate(sizes: list[int], bins: Bins, capacity: int, rng: random.Random) -> Bins:
    """Dissolves the least filled bins and a few others."""
    order = sorted(range(len(bins)), key=[-r for r in rooms(sizes, bins, capacity)].__getitem__)
    gone = set(order[: max(1, len(bins) // 50)]) | {b for b in range(len(bins)) if rng.random() < 0.02}
    kept = [list(b) for k, b in enumerate(bins) if k not in gone]
    displaced = [i for k in gone for i in bins[k]]
    settle(sizes, displaced, kept, rooms(sizes, kept, capacity), capacity, rng)
    return kept


def grind(sizes: list[int], bins: Bins, capacity: int, rng: random.Random) -> Bins:
    """Dissolves the least filled bin and, at random, some of those with the most pieces: small pieces fill the gaps of other bins to the last token."""
    room = rooms(sizes, bins, capacity)
    order = sorted(range(len(bins)), key=lambda b: -len(bins[b]) * (0.5 + rng.random()))
    gone = {*order[: max(1, len(bins) // 6)], max(range(len(bins)), key=room.__getitem__)}
    kept = [list(b) for k, b in enumerate(bins) if k not in gone]
    displaced = [i for k in sorted(gone) for i in bins[k]]
    settle(sizes, displaced, kept, [r for k, r in enumerate(room) if k not in gone], capacity, rng)
    return kept


def set_aside(sizes: list[int], first: Bins, capacity: int) -> Bins:
    """The full bins of best fit that take no part in the evolution: all but those with the most pieces, of which as many take part as there are bins with room."""
    room = rooms(sizes, first, capacity)
    full = sorted((b for b, r in enumerate(room) if not r), key=lambda b: (-len(first[b]), b))
    return [first[b] for b in full[len(first) - len(full) :]]


def evolve(sizes: list[int], capacity: int, seed: str, elites: list[Bins], generations: int, population: int, stall: int = 25, least: int | None = None) -> Bins:
    """The best chromosome of an island after some generations, begun from the elites that islands of the same sizes have sent. An island that got no fuller for ``stall`` generations rests.

    Where best fit has filled most bins, the full ones are kept, but for some, so the work goes with the bins that still have room; small pieces are then worth dissolving bins for.
    """
    least = least or least_bins(sizes, capacity)
    if elites and len(elites[0]) <= least:
        return elites[0]
    first: Bins = []
    best_fit(sizes, list(range(len(sizes))), first, [], capacity)
    if len(first) <= least:
        return first
    aside = set_aside(sizes, first, capacity)
    fixed = {i for b in aside for i in b}
    inner = [i for i in range(len(sizes)) if i not in fixed]
    number = {i: k for k, i in enumerate(inner)}
    people = [[[number[i] for i in b] for b in x if b[0] not in fixed] for x in elites or [first]]
    own = [sizes[i] for i in inner]
    best = _evolve(own, capacity, random.Random(seed), people, generations, population, stall, max(least - len(aside), least_bins(own, capacity)), bool(aside))
    return [list(b) for b in aside] + [[inner[k] for k in b] for b in best]


def _evolve(sizes: list[int], capacity: int, rng: random.Random, people: list[Bins], generations: int, population: int, stall: int, least: int, fine: bool) -> Bins:
    known = fitness(sizes, people[0], capacity)
    for _ in range(stall * fine):  # the best one alone, which is often enough
        child = grind(sizes, people[0], capacity, rng)
        fit = fitness(sizes, child, capacity)
        if fit >= known:
            people[0], known = child, fit
        if len(people[0]) <= least:
            return people[0]
    while len(people) < population:
        # A random part of the pieces is placed first, so that islands begin apart.
        first = [i for i in range(len(sizes)) if rng.random() < 0.3]
        bins: Bins = []
        best_fit(sizes, first, bins, [], capacity)
        chosen = set(first)
        settle(sizes, [i for i in range(len(sizes)) if i not in chosen], bins, rooms(sizes, bins, capacity), capacity, rng)
        people.append(bins)
    scored = sorted(((fitness(sizes, x, capacity), x) for x in people), key=lambda p: p[0], reverse=True)
    since = 0
    for _ in range(generations):
        if -scored[0][0][0] <= least or since >= stall:
            break
        (_, one), (_, other) = rng.sample(scored, 2)
        child = cross(sizes, one, other, capacity, rng)
        if rng.random() < 0.5:
            child = (grind if fine and rng.random() < 0.5 else mutate)(sizes, child, capacity, rng)
        since += 1
        fit = fitness(sizes, child, capacity)
        if fit > scored[0][0]:
            since = 0
        if all(fit != known for known, _ in scored):  # a copy would leave the population without variety
            scored.append((fit, child))
            scored.sort(key=lambda p: p[0], reverse=True)
            scored.pop()
    return scored[0][1]


def _to_array(bins: Bins, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.int32)
    for b, items in enumerate(bins):
        out[items] = b
    return out


def _to_bins(array: np.ndarray) -> Bins:
    bins: Bins = [[] for _ in range(int(array.max(initial=-1)) + 1)]
    for i, b in enumerate(array.tolist()):
        bins[b].append(i)
    return bins


def pack_pieces(pieces: DataFrame, capacity: int = 2048, problem: int = 16_384, islands: int = 2, epochs: int = 3, generations: int = 60, population: int = 8, seed: int = 0) -> DataFrame:
    """pieces with sequence_id (long) and offset (long). Every piece lies in one sequence; offsets are gapless from 0.

    pieces has a long column length, from 1 to capacity. An empty table gives
    an empty result.
    """
    spark = pieces.sparkSession
    pieces = durable(pieces.withColumn("_row", F.monotonically_increasing_id()))
    n = pieces.count()
    problems = max(1, -(-n // problem))
    # Full pieces are sequences of their own; the others are dealt at random.
    dealt = pieces.withColumn("_problem", F.pmod(F.xxhash64(F.lit(seed), F.col("_row")), F.lit(problems)).cast("int"))
    small = dealt.filter(F.col("length") < capacity)
    packed = durable(small.groupBy("_problem").agg(F.sort_array(F.collect_list(F.struct("_row", "length"))).alias("items")))
    ring = packed.withColumn("_island", F.explode(F.array(*map(F.lit, range(islands)))))
    states = None
    width = n_partitions(spark)

    def epoch(at: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    sizes = [x["length"] for x in row["items"]]
                    least = row.get("least") or least_bins(sizes, capacity)
                    elites = [_to_bins(np.frombuffer(x, dtype=np.int32)) for x in row.get("elites") or ()]
                    bins = evolve(sizes, capacity, f"{seed}/{row['_problem']}/{row['_island']}/{at}", elites, generations, population, least=least)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["_problem"]], pa.int32()), pa.array([row["_island"]], pa.int32()), pa.array([len(bins)], pa.int32()), pa.array([least], pa.int32()), pa.array([_to_array(bins, len(sizes)).tobytes()], pa.binary())],
                        names=["_problem", "_island", "bins", "least", "solution"],
                    )

        return run

    state = "_problem int, _island int, bins int, least int, solution binary"
    ages = []
    for at in range(epochs):
        if states is None:
            begun = ring
        else:
            # Problems of which no island has reached the bound go on. An island gets its own best and that of the island before it.
            open_ = states.groupBy("_problem").agg(F.min("bins").alias("bins"), F.min("least").alias("least")).filter("bins > least").select("_problem", "least")
            if open_.isEmpty():
                break
            own = states.select("_problem", "_island", F.lit(0).alias("k"), "solution")
            moved = states.select("_problem", ((F.col("_island") + 1) % islands).alias("_island"), F.lit(1).alias("k"), "solution")
            sent = own.union(moved).groupBy("_problem", "_island").agg(F.sort_array(F.collect_list(F.struct("k", "solution"))).alias("e")).select("_problem", "_island", F.col("e.solution").alias("elites"))
            begun = ring.join(sent, ["_problem", "_island"]).join(open_, "_problem")
        states = durable(begun.repartition(width, "_problem", "_island").mapInArrow(epoch(at), state))
        ages.append(states)

    best = reduce(DataFrame.union, ages).groupBy("_problem").agg(F.min(F.struct("bins", "_island", "solution")).alias("s")).select("_problem", "s.solution")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.array([x["_row"] for x in row["items"]], dtype=np.int64)
                sizes = np.array([x["length"] for x in row["items"]], dtype=np.int64)
                of = np.frombuffer(row["solution"], dtype=np.int32)
                order = np.argsort(of, kind="stable")
                sums = np.cumsum(sizes[order]) - sizes[order]
                first = np.searchsorted(of[order], of[order])
                sequence = (np.int64(row["_problem"]) << 32) + of[order]
                yield pa.RecordBatch.from_arrays([pa.array(ids[order]), pa.array(sequence), pa.array(sums - sums[first])], names=["_at", "sequence_id", "offset"])

    placed = packed.join(best, "_problem").mapInArrow(lay, "_at bigint, sequence_id bigint, offset bigint")
    columns = [c for c in pieces.columns if c != "_row"]
    full = dealt.filter(F.col("length") >= capacity).select(*columns, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return small.join(placed, F.col("_row") == F.col("_at")).select(*columns, "sequence_id", "offset").unionByName(full)


def pack(df: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, **how: int) -> DataFrame:
    """A row for each piece of each row of df: id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    A null or empty text is one piece with the end id alone. A very long text
    is cut into full pieces, the first of which may be shorter. Repeated rows are
    packed as often as they occur. Other columns, whatever their names, are not
    read. An empty table gives an empty result.
    """
    return pack_pieces(tokenize(df, tokenizer, capacity, 0, id_col, text_col, with_ids), capacity, **how)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
