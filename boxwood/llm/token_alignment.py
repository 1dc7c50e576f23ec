"""Cross-tokenizer alignment: where two tokenizers' tokens of a text begin and end together, and which overlap.

Space+text is cut before single spaces between visible characters, around
line ends and before marks after Latin letters. No token of either kind crosses such a place
(the pattern of byte-level vocabularies begins a token there, and no piece of
the other has these characters side by side, which is checked), so both encode
a text as its chunks, and chunks repeat: each different chunk is aligned once,
with the number of its occurrences.

The alignment is relational, the chunks being its documents:

* posexplode gives a row for each token; a windowed sum of lengths gives its end;
* a full equi-join on chunk and end merges the two sides; a row that has both is a cut;
* running cut counts over the ends are group ids. In the same order, the last
  token seen of each side is the one that covers the row's place, so each row is
  one link: two tokens with bytes in common. Groups need no pair join, however
  long they are.

Corpus-wide counts of id pairs are sums over links by chunk, times occurrences.

What is known of a chunk goes back to the documents: that of the most frequent
ones (at most ``KNOWN``, of at most ``SHORT`` characters) as a broadcast table,
that of the others by a join on the chunk, of which none then holds a large
share of all rows. A document's groups are put together from its chunks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxwood.llm.common import discard, durable, quoted, table
from boxwood.llm.packing import Encoder, _byte_of

#: Chunks whose alignment is broadcast, and their length in characters.
KNOWN, SHORT = 200_000, 64
#: Id pairs whose counts are broadcast; the others are joined by a shuffle.
PAIRS = 200_000
#: Chunks that a task remembers as given back or not.
_HELD = 200_000
#: Bytes of texts that a task splits at a time; of each part it looks up every different word once.
_TEXTS = 1 << 22
_DOC = ["k1", "k2"]
_WORDS = re.compile(r"(?<=\S) (?=\S)")
#: A space beside white space, where splitting at each space would cut too often.
_ODD = re.compile(r"\s | \s|^ | $")
#: Within what lies between such spaces: before a line end, after a single one, and between a Latin letter and a mark.
_FINER = re.compile(r"(?<=\S)(?=\n)|(?<=\S\n)(?=\S)|(?<=[A-Za-zÀ-ÖØ-öø-ɏ])(?=[.,;:!?])")
#: A word without any of these is one chunk.
_CUTS = "\n.,;:!?"
#: White space, of which RE2's \s has the ASCII part only.
_WHITE = [c for c in map(chr, range(0x3001)) if c.isspace()]
#: Of each character, the last standing for all after it: whether it is white space, a Latin letter as above.
_IS_WHITE, _IS_LATIN = (np.array([bool(re.match(p, chr(i))) for i in range(0x3002)]) for p in (r"\s", "[A-Za-zÀ-ÖØ-öø-ɏ]"))
#: Fixed value: the character by which pieces write a space.
_SPACE = "▁"


def words_of(text: str) -> list[str]:
    """What lies between single spaces; of space+text, each with the space before it."""
    return _WORDS.split(text) if _ODD.search(text) else text.split(" ")


def chunks_of(word: str) -> list[str]:
    """The chunks of " " + word."""
    return _FINER.split(" " + word)


def _parts(batch: pa.RecordBatch, of: str) -> Iterator[pa.RecordBatch]:
    """Slices of batch with about _TEXTS bytes in its column ``of``, which bounds what is made of them at a time."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(of)), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // _TEXTS
    edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def _along(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), and so on for each."""
    starts, counts = starts.astype(np.int64), counts.astype(np.int64)
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of the rows of values between each two edges."""
    return np.diff(np.concatenate([np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, axis=0, dtype=np.int64)])[edges], axis=0)


def _raw(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of words, one after another, and where each word's begin and end."""
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    edges = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    return np.frombuffer(words.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]], edges - edges[0]


def _like(words: pa.Array, maybe: np.ndarray, pattern: str) -> np.ndarray:
    """Which words fit; looked for among these only."""
    at = np.flatnonzero(maybe)
    out = np.zeros(len(words), bool)
    out[at[pc.match_substring_regex(words.take(pa.array(at)), pattern).to_numpy(zero_copy_only=False)]] = True
    return out


def _with_cuts(words: pa.Array) -> np.ndarray:
    """Which words have a character of _CUTS."""
    raw, edges = _raw(words)
    out = np.zeros(len(words), bool)
    out[np.searchsorted(edges, np.flatnonzero(np.isin(np.arange(256), list(_CUTS.encode()))[raw]), side="right") - 1] = True
    return out


def _cut(spaced: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What _FINER makes of these words, each with the space before it, one after another; and how many of each."""
    raw, edges = _raw(spaced)
    chars = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    at = np.cumsum(np.concatenate([np.zeros(1, np.int64), 1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)]))
    kind = np.minimum(chars, len(_IS_WHITE) - 1)
    shown, latin, line, mark = ~_IS_WHITE[kind], _IS_LATIN[kind], chars == ord("\n"), np.isin(chars, list(map(ord, _CUTS[1:])))
    after = lambda x: np.concatenate([np.zeros(1, bool), x])[:-1]
    begins = after(shown) & line | after(after(shown) & line) & shown | after(latin) & mark  # none of them across words, as a word's first is its space
    begins[np.searchsorted(at, edges[:-1])] = True
    starts = np.append(at[:-1][begins], at[-1])
    return pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(raw)), np.diff(np.searchsorted(starts, edges))


@dataclass
class Chunks:
    """Chunks of texts: the different ones, the place among them of each that occurs, text by text, and where each text's begin and end."""

    names: pa.Array
    at: np.ndarray
    edges: np.ndarray


@dataclass(frozen=True)
class Pair:
    """Paths of a byte-level BPE file (A) and of a sentencepiece model (B); opened in the tasks. plain is as in Tokenizers, None if not yet known."""

    a: str
    b: str
    plain: bool | None = None

    def open(self) -> Tokenizers:
        return Tokenizers(self)

    def judged(self) -> Pair:
        """This pair with plain known, so that tasks that only split texts don't read B's model."""
        return replace(self, plain=self.open()._plain)


class Tokenizers:
    """Both tokenizers; files and libraries are opened when something needs them."""

    def __init__(self, pair: Pair):
        self._pair = pair
        self._judged: dict[str, bool] = {}

    @cached_property
    def _parsed(self):
        from sentencepiece import sentencepiece_model_pb2

        with open(self._pair.b, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        rules, pieces = model.normalizer_spec, [p.piece.replace(_SPACE, " ") for p in model.pieces if p.type == p.NORMAL]
        if not rules.add_dummy_prefix or not rules.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix or any(re.search(r"\S ", p) or _FINER.search(p) for p in pieces):
            raise ValueError("chunks of a text aren't encoded as in it")
        rules.add_dummy_prefix = False  # chunks have their own spaces
        return model

    @cached_property
    def _plain(self) -> bool:
        """Whether B's pieces give the text back unless it has the character that stands for a space."""
        if self._pair.plain is not None:
            return self._pair.plain
        model, rules = self._parsed, self._parsed.normalizer_spec
        return rules.name == "identity" and not rules.remove_extra_whitespaces and model.trainer_spec.byte_fallback and not any(p.type == p.USER_DEFINED for p in model.pieces)

    @cached_property
    def _b_bytes(self) -> list[bytes]:
        return [bytes([int(p.piece[3:5], 16)]) if p.type == p.BYTE else p.piece.replace(_SPACE, " ").encode() for p in self._parsed.pieces]

    @cached_property
    def _a(self) -> Callable[[str], list[int]]:
        return Encoder(self._pair.a, encode_special_tokens=True)._plain

    @cached_property
    def _b(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self._parsed.SerializeToString())

    @cached_property
    def _a_bytes(self) -> list[bytes]:
        byte_of = _byte_of()
        with open(self._pair.a, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        out = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            if all(c in byte_of for c in token):
                out[i] = bytes(byte_of[c] for c in token)
        return out

    def encode(self, chunks: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """A's and B's ids of each chunk, and whether both give it back."""
        for chunk, b in zip(chunks, self._b.encode(chunks, num_threads=1), strict=True):
            a, whole = self._a(chunk), chunk.encode()
            same = b"".join(map(self._a_bytes.__getitem__, a)) == whole and b"".join(map(self._b_bytes.__getitem__, b)) == whole
            yield np.array(a, dtype=np.int32), np.array(b, dtype=np.int32), same

    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(list(map(len, self._a_bytes)), dtype=np.int32), np.array(list(map(len, self._b_bytes)), dtype=np.int32)

    def sides(self, chunks: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
        """Of A and of B: the ids of all chunks, one after another, and where each chunk's begin and end. A chunk that isn't given back is an error."""
        out, raw = [], [c.encode() for c in chunks]
        stops, whole = np.cumsum([0, *map(len, raw)]), b"".join(raw)
        for ids, entries in ((list(map(self._a, chunks)), self._a_bytes), (self._b.encode(chunks, num_threads=1), self._b_bytes)):
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(ends[-1]))
            tokens = list(map(entries.__getitem__, flat.tolist()))
            if b"".join(tokens) != whole or (np.cumsum([0, *map(len, tokens)])[ends] != stops).any():
                bad = next(c for c, (_, _, same) in zip(chunks, self.encode(chunks), strict=True) if not same)
                raise ValueError(f"tokens of {bad!r} don't give it back")
            out.append((flat, ends))
        return tuple(out)

    def words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The different words of these texts, the place among them of each that occurs, and how many each text has.

        A text has none if it is null, empty, no UTF-8, or has the character that stands for a space.
        """
        texts = pa.array([_decoded(x) for x in texts.to_pylist()], pa.string())
        split = pc.split_pattern(texts, " ")
        lengths = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        words, at, edges = coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.cumsum([0, *lengths.tolist()])
        # White space at a word's beginning or end, or none between two spaces: not every space of such a text divides words.
        raw, stops = _raw(words)
        none, raw, white = stops[1:] == stops[:-1], np.append(raw, np.uint8(0)), "[" + "".join(_WHITE) + "]"
        begins, ends = (_like(words, ~none & np.isin(np.arange(256), [c.encode()[k] for c in _WHITE])[raw[x]], p) for x, k, p in ((stops[:-1], 0, rf"\A{white}"), (stops[1:] - 1, -1, rf"{white}\z")))
        if begins.any() or ends.any() or none.any():
            begins, ends, none = begins[at], ends[at], none[at]
            has = lengths > 0
            begins[edges[:-1][has]] = ends[edges[1:][has] - 1] = False
            odd = np.flatnonzero(_sums((begins | ends | none).astype(np.int64), edges))
            if len(odd):
                found = [words_of(texts[i].as_py()) for i in odd.tolist()]
                coded = pa.concat_arrays([words, pa.array(chain.from_iterable(found), pa.string())]).dictionary_encode()
                stops = np.cumsum([len(words), *map(len, found)])
                own = np.split(at, edges[1:-1])
                for i, a, b in zip(odd.tolist(), stops[:-1], stops[1:], strict=True):
                    own[i] = coded.indices[int(a) : int(b)].to_numpy().astype(np.int64)
                words, at, lengths = coded.dictionary, np.concatenate(own), np.array(list(map(len, own)), dtype=np.int64)
        return words, at, lengths

    def chunks(self, texts: pa.Array) -> Chunks:
        """The chunks of these texts; none of those that aren't given back by both tokenizers."""
        words, at, lengths = self.words(texts)
        cut = _with_cuts(words)
        spaced = lambda x: pc.binary_join_element_wise(pa.scalar(" "), words.filter(pa.array(x)), "")
        finer, each = _cut(spaced(cut))
        coded = pa.concat_arrays([spaced(~cut), finer]).dictionary_encode()
        counts = np.ones(len(words), np.int64)
        counts[cut] = each
        # Those that aren't cut lie before the others; they are read word by word.
        first = np.cumsum(counts) - counts
        of = np.empty(int(counts.sum()), np.int64)
        of[np.concatenate([first[~cut], _along(first[cut], each)])] = coded.indices.to_numpy()
        if not self._plain:
            bad = ~np.array(self._same(coded.dictionary.to_pylist()), dtype=bool)[of]
            bad = _sums(_sums(bad.astype(np.int64), np.cumsum([0, *counts.tolist()]))[at], np.cumsum([0, *lengths.tolist()])) > 0
            at, lengths = at[~np.repeat(bad, lengths)], np.where(bad, 0, lengths)
        each = counts[at]
        places = of[_along(first[at], each)] if len(at) else np.zeros(0, np.int64)
        return Chunks(coded.dictionary, places, np.cumsum([0, *_sums(each, np.cumsum([0, *lengths.tolist()])).tolist()]))

    def _same(self, chunks: list[str]) -> list[bool]:
        if len(self._judged) > _HELD:
            self._judged.clear()
        if new := [c for c in chunks if c not in self._judged]:
            self._judged |= {c: same for c, (_, _, same) in zip(new, self.encode(new), strict=True)}
        return [self._judged[c] for c in chunks]


def _decoded(raw: bytes | None) -> str | None:
    try:
        text = raw.decode() if raw else None
    except UnicodeDecodeError:
        return None
    return None if text is None or _SPACE in text else text


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(quoted(text_col)).cast("string")
    return df.select(F.col(quoted(id_col)).alias("id"), F.xxhash64(F.col(quoted(id_col)), text).alias("k1"), F.hash(text).alias("k2"), text.cast("binary").alias("text"))


def chunk_counts(documents: DataFrame, pair: Pair) -> DataFrame:
    """(chunk, n) over all texts that both tokenizers give back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = pair.open()
        for batch in batches:
            for part in _parts(batch, "text"):
                got = tokenizers.chunks(part.column("text"))
                n = np.bincount(got.at, minlength=len(got.names)).astype(np.int64)
                there = n > 0
                yield pa.RecordBatch.from_arrays([got.names.filter(pa.array(there)), pa.array(n[there])], names=["chunk", "n"])

    return documents.select("text").mapInArrow(count, "chunk string, n bigint").groupBy("chunk").agg(F.sum("n").alias("n"))


def encoded(chunks: DataFrame, pair: Pair) -> DataFrame:
    """(cid, chunk, n, a, a_len, b, b_len): ids and byte lengths of both sides' tokens; written."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = pair.open()
        sizes = tokenizers.lengths()
        for batch in batches:
            lists = []
            for (flat, ends), size in zip(tokenizers.sides(batch.column(0).to_pylist()), sizes, strict=True):
                lists += [pa.ListArray.from_arrays(ends, flat), pa.ListArray.from_arrays(ends, size[flat])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["chunk", "n", "a", "a_len", "b", "b_len"])

    rows = chunks.mapInArrow(encode, "chunk string, n bigint, a array<int>, a_len array<int>, b array<int>, b_len array<int>")
    return durable(rows.withColumn("cid", F.monotonically_increasing_id()))


def _joined_on_chunk(spark: SparkSession) -> SparkSession:
    """A session like this one in which an equi-join on chunk and end leaves rows that are dealt by chunk where they are."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return own


def aligned(tokens: DataFrame) -> DataFrame:
    """Of each chunk of ``tokens`` (as encoded gives it): cid, n_a, n_b, n_groups, n_links, groups, links; written.

    groups is text as in ``a1,a2|b1;a3|b2,b3``; links are (a, b) ids.
    """
    base = tokens.repartition("cid")

    def side(ids: str) -> DataFrame:
        rows = base.select("cid", F.posexplode(F.arrays_zip(ids, f"{ids}_len")).alias("pos", "token"))
        along = Window.partitionBy("cid").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.select("cid", F.col("token")[ids].alias(ids), F.sum(F.col("token")[f"{ids}_len"]).over(along).alias("end"))

    both = side("a").join(side("b"), ["cid", "end"], "full")
    back = Window.partitionBy("cid").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = F.col("a").isNotNull() & F.col("b").isNotNull()
    links = both.select("cid", "end", "a", "b", F.sum(cut.cast("int")).over(back).alias("group"), F.last("a", True).over(back).alias("la"), F.last("b", True).over(back).alias("lb"))

    def in_order(token: str) -> F.Column:
        held = F.array_sort(F.collect_list(F.when(F.col(token).isNotNull(), F.struct("end", token))))
        return F.transform(held, lambda x: x[token])

    groups = links.groupBy("cid", "group").agg(in_order("a").alias("a"), in_order("b").alias("b"), F.collect_list(F.struct(F.col("la").alias("a"), F.col("lb").alias("b"))).alias("links"))
    joined = lambda ids: F.array_join(F.col(ids).cast("array<string>"), ",")
    groups = groups.select("cid", (-F.col("group")).alias("order"), F.concat(joined("a"), F.lit("|"), joined("b")).alias("group"), F.size("a").alias("n_a"), F.size("b").alias("n_b"), "links")
    whole = groups.groupBy("cid").agg(
        F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.count("*").alias("n_groups"), F.sum(F.size("links")).alias("n_links"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("order"), F.col("group")))), lambda x: x["group"]), ";").alias("groups"),
        F.flatten(F.collect_list("links")).alias("links"),
    )
    return whole.join(base.select("cid", "chunk", "n"), "cid")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(a, b, count, best): links of each id pair in the corpus; best where no other pair of b has more."""
    counts = chunks.select("n", F.inline("links")).groupBy("a", "b").agg(F.sum("n").alias("count"))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return durable(counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best")))


def _threshold(df: DataFrame, count: str, most: int) -> float:
    """A step of the logarithm of count such that at most ``most`` rows are on or above it."""
    steps = sorted(df.groupBy(F.floor(F.log2(count) * 4).alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"])
    total, least = 0, float("inf")
    for r in steps:
        total += r["n"]
        if total > most:
            break
        least = r["step"]
    return least


def _above(count: str, step: float) -> F.Column:
    return F.floor(F.log2(count) * 4) >= F.lit(step)


def _with_counts(chunks: DataFrame) -> DataFrame:
    """chunks with n_best and count_sum, of one occurrence."""
    pairs = pair_counts(chunks)
    step = _threshold(pairs, "count", PAIRS)
    links = chunks.select("cid", F.inline("links"))
    common = links.join(F.broadcast(pairs.filter(_above("count", step))), ["a", "b"], "left")
    rare = common.filter(F.col("count").isNull()).select("cid", "a", "b").join(pairs.filter(~_above("count", step)), ["a", "b"])
    sums = common.filter(F.col("count").isNotNull()).unionByName(rare).groupBy("cid").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum"))
    out = durable(chunks.drop("links").join(sums, "cid").drop("cid"))
    discard(pairs)
    return out


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
#: What is sent of the rarer chunks of a document, besides their groups' text.
_SENT = ["pos", "n_a", "n_best", "count_sum"]


def _counts(texts: str, n_a: np.ndarray, n_best: np.ndarray, count_sum: np.ndarray) -> list[int]:
    """Sums of the numbers of chunks with these groups: a group has two lists, and one link less than tokens."""
    groups, a = texts.count("|"), int(n_a.sum())
    b = texts.count(",") + 2 * groups - a
    return [a, b, groups, a + b - groups, int(n_best.sum()), int(count_sum.sum())]


class _Known:
    """The alignment of common chunks, as arrays."""

    def __init__(self, got: pa.Table):
        self.chunks, self.groups = (pa.concat_arrays([pa.array([], pa.string()), *got.column(c).cast(pa.string()).chunks]) for c in ("chunk", "groups"))
        self.numbers = [np.append(got.column(c).to_numpy(), 0).astype(np.int64) for c in _NUMBERS]

    def places(self, chunks: pa.Array) -> np.ndarray:
        """Where these chunks stand; -1 for those that aren't known."""
        return pc.fill_null(pc.index_in(chunks, value_set=self.chunks), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def sums(self, at: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """The numbers of the chunks at these places, added up between each two edges; those that aren't known count 0."""
        return np.column_stack([_sums(x[at], edges) for x in self.numbers])


def align(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of df: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    groups is text: ids of A's and B's tokens, as in ``a1,a2|b1;a3|b2,b3``.
    n_best counts links whose pair is the most frequent of its B id, ties
    included; count_sum adds the corpus-wide counts of the links' pairs. Null
    and empty texts, and those that a tokenizer doesn't give back, have no tokens: zeros and ''.
    Repeated rows each get their row and each count in the corpus. Very long texts are
    read whole; one without such places is one chunk, aligned in one window. Other columns,
    whatever their names, are not read. An empty table gives an empty result.
    """
    spark, pair = df.sparkSession, Pair(path_a, path_b).judged()
    documents = _documents(df, id_col, text_col)
    tokens = encoded(chunk_counts(documents, pair), pair)
    own = _joined_on_chunk(spark)
    chunks = durable(aligned(own.read.schema(tokens.schema).parquet(tokens._durable_path)))
    here = spark.read.schema(chunks.schema).parquet(chunks._durable_path)
    here._durable_path = chunks._durable_path
    discard(tokens)
    info = _with_counts(here)
    discard(here)

    brief = F.length("chunk") <= SHORT
    step = _threshold(info.filter(brief), "n", KNOWN)
    common = brief & _above("n", step)
    held = spark.sparkContext.broadcast(_Known(info.filter(common).select("chunk", *_NUMBERS, "groups").toArrow()))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places of chunks that aren't among the known; of equal rows in a task, the first one's."""
        tokenizers, known, seen = pair.open(), held.value, set()
        for batch in batches:
            new = []
            for key in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True):
                new.append(key not in seen)
                seen.add(key)
            for part in _parts(batch.filter(pa.array(new, pa.bool_())), "text"):
                got = tokenizers.chunks(part.column("text"))
                rare = np.flatnonzero((known.places(got.names)[got.at] < 0) if len(got.at) else np.zeros(0, bool))
                doc = np.searchsorted(got.edges, rare, side="right") - 1
                keys = [part.column(c).take(pa.array(doc)) for c in _DOC]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(rare - got.edges[doc], pa.int32()), got.names.take(pa.array(got.at[rare]))], names=[*_DOC, "pos", "chunk"])

    # Written after the join, so that the joined tables can go before the rows move again.
    met = durable(documents.select(*_DOC, "text").mapInArrow(others, "k1 bigint, k2 int, pos int, chunk string").join(info.filter(~common).drop("n"), "chunk").drop("chunk"))
    discard(info)
    # Numbers travel as arrays of their own and groups as one text for each document, a third of what structs take; the other counts follow from these.
    rest = met.groupBy(*_DOC).agg(F.collect_set(F.struct("pos", F.col("n_a").cast("int").alias("n_a"), F.col("n_best").cast("int").alias("n_best"), F.col("count_sum").cast("long").alias("count_sum"), "groups")).alias("rest"))
    each = lambda c: F.transform("rest", lambda x: x[c])
    rare = durable(rest.select(*_DOC, *(each(c).alias(c) for c in _SENT), F.array_join(each("groups"), "\n").alias("texts")))
    discard(met)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers, known = pair.open(), held.value
        for batch in batches:
            for part in _parts(batch, "text"):
                got = tokenizers.chunks(part.column("text"))
                at = known.places(got.names)[got.at] if len(got.at) else got.at
                rare = np.flatnonzero(at < 0)
                doc = np.searchsorted(got.edges, rare, side="right") - 1
                ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(part.column("pos")), 0).to_pylist()])
                pos, *sent = (part.column(c).flatten().to_numpy() for c in _SENT)
                order = np.lexsort((pos, np.repeat(np.arange(part.num_rows), np.diff(ends))))
                if len(order) != len(rare) or (np.diff(ends) != np.bincount(doc, minlength=part.num_rows)).any() or (pos[order] != rare - got.edges[doc]).any():
                    raise ValueError("chunks of a document differ from those counted")
                numbers = known.sums(at, got.edges)
                texts = part.column("texts")
                for i in np.flatnonzero(np.diff(ends)).tolist():
                    numbers[i] += _counts(texts[i].as_py(), *(x[ends[i] : ends[i + 1]] for x in sent))
                at[rare] = len(known.groups) + order
                found = pa.concat_arrays([known.groups, pc.split_pattern(texts.cast(pa.string()), "\n").flatten()]).take(pa.array(at))
                groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(got.edges, pa.int32()), found), ";")
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(numbers[:, j]) for j in range(len(_NUMBERS))), groups], names=["id", *_NUMBERS, "groups"])

    kind = documents.schema["id"].dataType.simpleString()
    out = documents.join(rare, _DOC, "left").select("id", "text", *_SENT, "texts")
    return out.mapInArrow(assemble, f"id {kind}, {', '.join(f'{c} bigint' for c in _NUMBERS)}, groups string").withColumnRenamed("id", id_col)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))).drop("groups")
