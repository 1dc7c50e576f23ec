"""Quality rules: counts per text, and perplexity bands under an n-gram model.

The model is a modified Kneser-Ney trigram model, one for each language, over
the UTF-8 bytes as they are (``folded=False``, the queries' model) or over 64
symbols to which they are folded (letters without case, digits, kinds of
punctuation, other bytes modulo 32). Spark counts all trigrams of all texts as
sorted arrays of keys, so that work and memory go by the trigrams that occur.

Models are worked out in tasks, one for each language, whatever their number.
A model is a row of log probabilities for each context that occurs (the bytes
before a byte; other contexts share the rows of the shorter context) and the
number of each context's row: exact, and 67 MB at most if all 65,536 contexts
of two bytes occur. Models pass through the driver one after
another into a file that each executor gets once and its tasks map into memory,
so that neither the driver nor a task holds all models. The time for a text
grows with the number of languages, as the mixture asks all of them. A word (with the space after it) has the probability
that a mixture of all models gives it: half of the weight belongs to the
language of the document, the other half is shared by all languages, so that a
passage in another language isn't taken for junk. Perplexity is counted by the
word that has a letter or digit: by the symbol, runs of marks would look likely, as each foretells
the next, and by any word, so would menus, whose bars are short words.

The bands of a language come from a histogram of the logs of the nats a word
of all its documents that pass the base rules: the median, more by ``width``
or less by ``low_width`` times the distance to the quartile on that side, but ``least`` at
least, and wider by ``slack / sqrt(words)``, as short texts vary more. Documents
above the upper band (junk) or below the lower one (the same few common words
again and again) are rejected.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxwood.llm.common import durable, quoted, table

SYMBOLS, ORDER = 64, 3
KEYS = SYMBOLS**ORDER
#: Bits of a folded symbol, and of a byte.
FOLDED, WHOLE = 6, 8
#: Keys that a task gathers before it sums them, and distinct ones that it holds at a time.
_GATHERED, _COUNTED = 1 << 21, 1 << 22
#: Width of the histogram's bins, and the range that they cover (logs of nats a word; beyond it, the outermost bins).
BIN, LOWEST, HIGHEST = 0.001, -2.0, 18.0

_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_NOT_CHARS = _SPACE + bytes(range(0x80, 0xC0))
_MARKS = b"#*$%&|<>"
#: What words without letters or digits are made of.
_PUNCTUATION = bytes(b for b in range(128) if not chr(b).isalnum() and b not in _SPACE)


def _fold() -> np.ndarray:
    fold = np.full(256, 31, dtype=np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 0x80:
            fold[b] = 32 + b % 32
        elif c.isalpha():
            fold[b] = 1 + ord(c.lower()) - ord("a")
        elif bytes([b]) in [bytes([x]) for x in _SPACE]:
            fold[b] = 27
        elif c.isdigit():
            fold[b] = 28
        elif c in ".,;:!?":
            fold[b] = 29
        elif c in "'\"()[]{}-_/":
            fold[b] = 30
    return fold


#: 0: the edge of a text; 1-26 letters, 27 white space, 28 digits, 29-31 punctuation, 32-63 bytes of other letters.
FOLD = _fold()


def _bytes() -> np.ndarray:
    whole = np.arange(256, dtype=np.uint8)
    whole[[0, 0xFF]] = 0xFF, 0
    return whole


#: Bytes as they are, but 0 is the edge of a text, as 0xFF is no byte of UTF-8.
BYTES = _bytes()
_SYMBOL_OF = {FOLDED: FOLD, WHOLE: BYTES}


def _spaces(bits: int) -> np.ndarray:
    spaces = np.zeros(1 << bits, dtype=bool)
    spaces[_SYMBOL_OF[bits][list(_SPACE)]] = True
    return spaces


_IS_SPACE = {bits: _spaces(bits) for bits in _SYMBOL_OF}


def base_counts(data: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a UTF-8 text."""
    words = data.split()
    seen: set[bytes] = set()
    dup = 0
    for line in data.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.translate(None, _SPACE):
            seen.add(line)
    return len(words), len(data.translate(None, _NOT_CHARS)), len(data) - len(data.translate(None, _MARKS)), dup, repeat_words(words)


def letter_words(data: bytes) -> int:
    """Words with a letter (any byte that isn't ASCII counts as one) or a digit."""
    return len(data.translate(None, _PUNCTUATION).split())


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    ids = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in windows), dtype=np.int64, count=len(windows))
    often = np.bincount(at)[at] > 1
    inside = np.zeros(len(words), dtype=bool)
    for k in range(3):
        inside[k : k + len(windows)] |= often
    return int(inside.sum())


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    """The base rules of the query contract."""
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def keys_of(texts: list[bytes], bits: int = FOLDED) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the trigrams of all texts, one after another, and how many each text has: one more than its bytes."""
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    raw = np.frombuffer(b"".join([b"\0\0" + t + b"\0" for t in texts]), dtype=np.uint8)
    symbols = _SYMBOL_OF[bits][raw].astype(np.int32)
    starts = np.cumsum(lengths + 2) - (lengths + 2)
    for edge in (starts, starts + 1, starts + lengths + 1):
        symbols[edge] = 0
    keys = (symbols[:-2] << 2 * bits) | (symbols[1:-1] << bits) | symbols[2:]
    keep = np.ones(len(raw), dtype=bool)
    keep[starts + lengths] = keep[starts + lengths + 1] = False  # windows that reach into the next text
    return keys[keep[:-2]] if len(raw) > 2 else keys, lengths


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)


def count_trigrams(docs: DataFrame, bits: int = FOLDED) -> DataFrame:
    """lang, key, n: the trigrams of all texts, counted in the tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {}
        gathered: dict[str | None, list[np.ndarray]] = {}
        waiting = 0

        def settle() -> None:
            for lang, keys in gathered.items():
                new = np.unique(np.concatenate(keys), return_counts=True)
                counts[lang] = [_summed([*counts[lang], new])] if lang in counts else [new]
            gathered.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, ((keys, n),) in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int32)), pa.array(n.astype(np.int64))], names=["lang", "key", "n"])
            counts.clear()

        for batch in batches:
            for part in _slices(batch):
                langs, texts = part.column("lang").to_pylist(), part.column("data").to_pylist()
                own: dict[str | None, list[bytes]] = {}
                for lang, t in zip(langs, texts, strict=True):
                    own.setdefault(lang, []).append(t or b"")
                for lang, some in own.items():
                    keys, _ = keys_of(some, bits)
                    gathered.setdefault(lang, []).append(keys)
                    waiting += len(keys)
                if waiting > _GATHERED:
                    settle()
                    waiting = 0
                    if sum(len(x[0][0]) for x in counts.values()) > _COUNTED:
                        yield from flush()
        settle()
        yield from flush()

    return docs.select("lang", "data").mapInArrow(count, "lang string, key int, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that work arrays stay small next to long texts."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


class Model:
    """Modified Kneser-Ney: keys, sorted, of the trigrams seen with their log probabilities, and the same for bigrams that back off."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bits: int = FOLDED):
        self.bits, symbols = bits, 1 << bits
        order = np.argsort(keys)
        self.keys = keys[order].astype(np.int64)
        c3 = counts[order].astype(np.float64)
        context, last2 = self.keys >> bits, self.keys & (symbols**2 - 1)
        self.d3 = _discounts(c3)
        # Lower orders count the distinct symbols before an n-gram.
        c2 = np.bincount(last2, minlength=symbols**2).astype(np.float64)
        c1 = np.bincount(np.flatnonzero(c2) & (symbols - 1), minlength=symbols).astype(np.float64)
        self.d2, self.d1 = _discounts(c2), _discounts(c1)
        total = max(1.0, c1.sum())
        p1 = np.maximum(c1 - _off(c1, self.d1), 0) / total
        p1 += (1 - p1.sum()) / symbols
        c2m = c2.reshape(symbols, symbols)
        row = c2m.sum(1, keepdims=True)
        off2 = _off(c2m, self.d2)
        p2 = np.where(row > 0, (np.maximum(c2m - off2, 0) + off2.sum(1, keepdims=True) * p1) / np.maximum(row, 1), p1)
        sums = np.bincount(context, weights=c3, minlength=symbols**2)
        off3 = _off(c3, self.d3)
        left = np.bincount(context, weights=off3, minlength=symbols**2)
        back = np.where(sums > 0, left / np.maximum(sums, 1), 1.0)
        p = (np.maximum(c3 - off3, 0)) / sums[context] + back[context] * p2.reshape(-1)[last2]
        self.logs = np.log(p).astype(np.float32)
        self.pairs = np.arange(symbols**2, dtype=np.int64)
        self.pair_logs = np.log(p2.reshape(-1))
        self.back_logs = np.log(np.maximum(back, 1e-12))

    def log_probs(self, keys: np.ndarray) -> np.ndarray:
        """Natural logs for distinct keys, by binary search in the sorted arrays."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        out = self.back_logs[keys >> self.bits] + self.pair_logs[keys & (len(self.pair_logs) - 1)]
        if len(self.keys):
            hit = self.keys[at] == keys
            out[hit] = self.logs[at[hit]]
        return out

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """The number of each context's row, and rows with the natural log of each symbol: first those of the contexts of one symbol, which all contexts that don't occur share."""
        symbols = 1 << self.bits
        seen = np.unique(self.keys >> self.bits)
        number = np.arange(symbols**2, dtype=np.int32) & (symbols - 1)
        number[seen] = symbols + np.arange(len(seen))
        logs = np.empty((symbols + len(seen), symbols), dtype=np.float32)
        logs[:symbols] = self.pair_logs.reshape(symbols, symbols)
        for at in range(0, len(seen), 1024):
            some = seen[at : at + 1024]
            logs[symbols + at : symbols + at + len(some)] = self.log_probs(((some << self.bits)[:, None] + np.arange(symbols)).reshape(-1)).reshape(-1, symbols)
        return number, logs


def _off(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(c <= 0, 0.0, np.where(c < 1.5, d[0], np.where(c < 2.5, d[1], d[2])))


def _discounts(c: np.ndarray) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts, from how many counts are 1 to 4; 0.5, 1, 1.5 where one of these is missing."""
    n1, n2, n3, n4 = (float(np.sum(c == k)) for k in (1, 2, 3, 4))
    if min(n1, n2, n3, n4) == 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def fit(docs: DataFrame, bits: int = FOLDED) -> tuple[list[tuple[str, int]], str]:
    """The languages, each with its number of rows, and the name of the file (for SparkFiles) with the rows of the model of each."""

    def build(table: pa.Table) -> pa.Table:
        number, logs = Model(table.column("key").to_numpy(), table.column("n").to_numpy(), bits).rows()
        data = number.astype("<i4").tobytes() + logs.astype("<f4").tobytes()
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()], pa.string()), "n": pa.array([len(logs)], pa.int64()), "data": pa.array([data], pa.binary())})

    models = count_trigrams(docs, bits).groupBy("lang").applyInArrow(build, "lang string, n bigint, data binary")
    langs, path = [], os.path.join(tempfile.mkdtemp(prefix="boxwood-models-"), f"{uuid.uuid4().hex}.f4")
    with open(path, "wb") as f:
        for row in durable(models).orderBy("lang").toLocalIterator():
            langs.append((row["lang"], row["n"]))
            f.write(row["data"])
    docs.sparkSession.sparkContext.addFile(path)
    return langs, os.path.basename(path)


def mapped(path: str, langs: list[tuple[str, int]], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The models of a file of fit, mapped into memory: the number of each context's row, and the rows one after another."""
    out, at = [], 0
    for _, n in langs:
        contexts, logs = 1 << 2 * bits, n << bits
        number = np.memmap(path, dtype="<i4", mode="r", offset=at, shape=contexts)
        out.append((np.asarray(number), np.asarray(np.memmap(path, dtype="<f4", mode="r", offset=at + 4 * contexts, shape=logs))))
        at += 4 * (contexts + logs)
    return out


def word_starts(keys: np.ndarray, lengths: np.ndarray, bits: int = FOLDED) -> tuple[np.ndarray, np.ndarray]:
    """Where words (each with the space after it) begin among the keys of all texts, and how many of them each text has."""
    begins = np.zeros(len(keys) + 1, dtype=bool)
    begins[1:] = _IS_SPACE[bits][keys & ((1 << bits) - 1)]  # the last symbol of a text is its edge, so none reaches into the next
    text_at = np.cumsum(lengths) - lengths
    begins[text_at] = True
    starts = np.flatnonzero(begins[:-1])
    return starts, np.diff(np.append(np.searchsorted(starts, text_at), len(starts)))


def nats(texts: list[bytes], own: np.ndarray, models: list[tuple[np.ndarray, np.ndarray]], bits: int) -> np.ndarray:
    """Minus the log probability of each text; own: the number of its language; models: of each language, as mapped gives them."""
    keys, lengths = keys_of(texts, bits)
    starts, words = word_starts(keys, lengths, bits)
    language = np.repeat(own, words)
    rest = 0.5 / len(models)
    total = np.full(len(starts), -np.inf)
    contexts, last = keys >> bits, keys & ((1 << bits) - 1)
    for k, (number, logs) in enumerate(models):
        row = logs[(number[contexts] << bits) | last]
        total = np.logaddexp(total, np.add.reduceat(row, starts, dtype=np.float64) + np.where(language == k, np.log(0.5 + rest), np.log(rest)))
    return -np.add.reduceat(total, np.cumsum(words) - words)


def score(docs: DataFrame, models: tuple[list[tuple[str, int]], str], id_col: str, also: tuple[str, ...] = (), bits: int = FOLDED) -> DataFrame:
    """id, the columns also, lang, the base counts, base_failed and log_perplexity (nats a word), for every row."""
    langs, name = models

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {lang: k for k, (lang, _) in enumerate(langs)}
        of_all = mapped(SparkFiles.get(name), langs, bits)
        for batch in batches:
            for part in _slices(batch):
                texts = [t or b"" for t in part.column("data").to_pylist()]
                own = np.array([number[lang] for lang in part.column("lang").to_pylist()], dtype=np.int64)
                counts = [base_counts(t) for t in texts]
                loss = nats(texts, own, of_all, bits) / np.maximum(1, [letter_words(t) for t in texts])
                columns = [part.column(c) for c in (id_col, *also)] + [part.column("lang")]
                columns += [pa.array([c[k] for c in counts], pa.int64()) for k in range(5)]
                columns += [pa.array([base_failed(c[0], c[4]) for c in counts], pa.bool_()), pa.array(loss)]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, *also, "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_perplexity"])

    fields = [T.StructField("lang", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), T.StructField("base_failed", T.BooleanType()), T.StructField("log_perplexity", T.DoubleType())]
    kept = docs.select(*(quoted(c) for c in (id_col, *also)), "lang", "data")
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields[: 1 + len(also)], *fields]))


def bands(scored: DataFrame, width: float, low_width: float, least: float) -> list[tuple[str, float, float]]:
    """(lang, lower, upper) of the log of log_perplexity, from histograms, which come to the driver one after another."""
    n_bins = round((HIGHEST - LOWEST) / BIN)
    at = F.floor((F.log("log_perplexity") - LOWEST) / BIN)
    rows = scored.filter(~F.col("base_failed")).groupBy("lang", F.least(F.lit(n_bins - 1), F.greatest(F.lit(0), at)).cast("int").alias("bin")).count().orderBy("lang", "bin")
    out = []
    for lang, own in groupby(rows.toLocalIterator(), key=lambda r: r["lang"]):
        n = np.zeros(n_bins)
        for r in own:
            n[r["bin"]] += r["count"]
        low, mid, high = (LOWEST + BIN * (np.searchsorted(np.cumsum(n), q * n.sum()) + 0.5) for q in (0.25, 0.5, 0.75))
        out.append((lang, float(mid - max(least, low_width * (mid - low))), float(mid + max(least, width * (high - mid)))))
    return out


def assess(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", also: tuple[str, ...] = (), width: float = 8.0, low_width: float = 4.0, least: float = 0.1, slack: float = 1.5, folded: bool = True) -> DataFrame:
    """A row for each row of df: id, also, the base counts, base_failed, log_perplexity (nats a word), kept.

    A null text counts as an empty one (n_words 0, so base_failed); a null
    language is a language of its own, apart from that of an empty name. A very
    long text is counted and scored whole. folded: whether the model is over 64
    folded symbols or over all bytes. Repeated rows stay and count as often
    as they occur. Columns may have any names; those that are neither given nor
    in also are not read. An empty table gives an empty result.
    """
    docs = df.select(quoted(id_col), *map(quoted, also), F.col(quoted(text_col)).cast("binary").alias("data"), F.col(quoted(lang_col)).cast("string").alias("lang"))
    bits = FOLDED if folded else WHOLE
    scored = durable(score(docs, fit(docs, bits), id_col, also, bits))
    limits = df.sparkSession.createDataFrame(bands(scored, width, low_width, least), "_of string, _low double, _high double")
    level, room = F.log("log_perplexity"), slack / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    inside = level.between(F.col("_low") - room, F.col("_high") + room)
    judged = scored.join(F.broadcast(limits), F.col("lang").eqNullSafe(F.col("_of")), "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))
    return judged.select(*map(quoted, scored.columns), "kept")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents"), folded=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")
