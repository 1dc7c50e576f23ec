"""Alignment against whole-text encodings by the tokenizers' own libraries."""

import hashlib
import json
import random
from collections import Counter

import duckdb
import pytest

from boxwood.llm import token_alignment as T

files = pytest.importorskip("public_tokenizers")
PATHS = files.path("byte_bpe_50k.json"), files.path("piece_bpe_32k.model")


def brute(texts):
    """A row for each text: counts and the groups' text."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(PATHS[0])
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    entry = {i: w for w, i in json.load(open(PATHS[0], encoding="utf-8"))["model"]["vocab"].items()}
    piece = lambda i: bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode()
    found, count = [], Counter()
    for text in texts:
        if not text:
            found.append(None)
            continue
        whole = (" " + text).encode()
        sides = [(i, bytes(byte_of[c] for c in entry[i])) for i in a_side.encode(" " + text, add_special_tokens=False).ids], [(i, piece(i)) for i in b_side.encode(text)]
        if any(b"".join(x for _, x in s) != whole for s in sides):
            found.append(None)
            continue
        spans = []
        for side in sides:
            at, own = 0, []
            for i, x in side:
                own.append((at, at + len(x), i))
                at += len(x)
            spans.append(own)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        group_of = lambda e: sum(c < e for c in cuts)  # noqa: E731, B023
        groups = [([], []) for _ in cuts]
        if len(whole) < 4000:
            for k in (0, 1):
                for _, e, i in spans[k]:
                    groups[group_of(e)][k].append(i)
            links = [(a, b) for s, e, a in spans[0] for s2, e2, b in spans[1] if s < e2 and s2 < e]
        else:
            own, place = set(cuts), [0, 0]
            for k in (0, 1):
                g = 0
                for _, e, i in spans[k]:
                    groups[g][k].append(i)
                    g += e in own
            links, j = [], 0
            for s, e, a in spans[0]:
                while spans[1][j][1] <= s:
                    j += 1
                k = j
                while k < len(spans[1]) and spans[1][k][0] < e:
                    links.append((a, spans[1][k][2]))
                    k += 1
            del place
        count.update(links)
        found.append((len(spans[0]), len(spans[1]), groups, links))
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    join = lambda ids: ",".join(map(str, ids))
    return [(0, 0, 0, 0, 0, 0, "") if x is None else (x[0], x[1], len(x[2]), len(x[3]), sum(count[p] == most[p[1]] for p in x[3]), sum(count[p] for p in x[3]), ";".join(f"{join(a)}|{join(b)}" for a, b in x[2])) for x in found]


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id bigint, text string, chunk string, `k.1` int")
    return sorted((str(r["doc_id"]), *(r[c] for c in T._NUMBERS), r["groups"]) for r in T.align(df, *PATHS).collect())


def odd_texts():
    rng = random.Random(8)
    alphabet = [" ", " ", " ", "  ", "\n", "\t", " ", "　", " ", "'s", "'", "▁", "é", "é", "日本", "😀", "👩‍👩‍👧", "12", "345", "the", "Xy", "-", "<s>", "</s>", "<unk>", "<|endoftext|>", "<0x0A>", "\x00", "\x85", "\x1f", "ſ", "...", "==", "a.b", "x,", "ß!", "½.", "\n", "\n\n", "end.\nNext"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(250)]
    plain = [x.replace("▁", "") for x in texts]
    return texts + plain + ["", " ", "  ", " a", "a ", "\n a", "a \n b", "plain words in a row", "the the the the"]


def test_odd_texts(spark):
    rows = list(enumerate(odd_texts()))
    rows += [(7, "again the same"), (7, "again the same"), (7, "not the same"), (None, "again the same"), (None, None), (900, None), (901, "x" * 3000), (902, "ab" * 40_000 + " end")]
    want = sorted((str(i), *w) for (i, _), w in zip(rows, brute([t for _, t in rows])))
    got = run(spark, rows)
    assert got == want
    assert any(r[1] == 0 for r in got) and any(r[3] < min(r[1], r[2]) for r in got)


def test_without_broadcast(spark, monkeypatch):
    """Chunks and pairs that aren't broadcast are joined by a shuffle, with the same rows."""
    monkeypatch.setattr(T, "KNOWN", 3)
    monkeypatch.setattr(T, "PAIRS", 3)
    rng = random.Random(9)
    rows = [(k % 20, " ".join(rng.choice(["the", "of", "quite", "Unwahrscheinlichkeit", "naïve", "x" * 90]) for _ in range(30))) for k in range(25)]
    assert run(spark, rows) == sorted((str(i), *w) for (i, _), w in zip(rows, brute([t for _, t in rows])))


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(1, None), (2, "")]) == [("1", 0, 0, 0, 0, 0, 0, ""), ("2", 0, 0, 0, 0, 0, 0, "")]


def test_chunks_give_text_back():
    for text in odd_texts():
        assert "".join(c for w in T.words_of(text) for c in T.chunks_of(w)) == " " + text


def test_parts_of_a_batch(monkeypatch):
    """A batch is split part by part, which bounds what a task holds; each different word of a part is looked up once, with the chunks of a plain reading."""
    import pyarrow as pa

    texts = [t.encode() for t in odd_texts()] + [None, b"a \xff b", b"\xed\xa0\x80", *[b"many words. again, many words"] * 50]
    batch, tokenizers = pa.record_batch([pa.array(texts, pa.binary())], names=["text"]), T.Pair(*PATHS).open()
    for size in (1, 100, 1 << 22):
        monkeypatch.setattr(T, "_TEXTS", size)
        found, parts = [], list(T._parts(batch, "text"))
        assert all(p.num_rows == 1 or sum(len(x or b"") for x in p.column(0).to_pylist()[1:]) <= size for p in parts)
        for part in parts:
            got = tokenizers.chunks(part.column("text"))
            names = got.names.to_pylist()
            assert len(set(names)) == len(names)
            found += [[names[k] for k in got.at[a:b]] for a, b in zip(got.edges, got.edges[1:])]
        text_of = lambda raw: (raw or b"").decode(errors="replace")
        assert found == [[c for w in T.words_of(text_of(x)) for c in T.chunks_of(w)] if x and not set("▁\ufffd") & set(text_of(x)) else [] for x in texts]
    with pytest.raises(ValueError, match="don't give it back"):
        tokenizers._b_bytes = [b"?"] * len(tokenizers._b_bytes)
        tokenizers.sides([" a", " b"])


def test_registered(spark):
    from boxwood.llm.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    sha = lambda groups: hashlib.sha256(groups.encode()).hexdigest() if groups else ""
    want = sorted((i, *w[:6], sha(w[6])) for (i, _), w in zip(rows, brute([t for _, t in rows])))
    got = sorted((r["doc_id"], *(r[c] for c in T._NUMBERS), r["groups_sha256"]) for r in QUERIES["op13_token_alignment"](spark, sf).collect())
    assert got == want


def test_split_cost():
    """Splitting texts with many different words takes few times what Arrow takes to tell the words apart, and none of it reads the model; chunks are those of a plain reading."""
    import time

    import pyarrow as pa
    import pyarrow.compute as pc

    rng = random.Random(10)
    stems = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=rng.randint(2, 9))) for _ in range(90_000)]
    words = [w + rng.choice(["", "", "", ".", ",", ".\nThe", "!?", ".b", "1."]) for w in stems]
    texts = pa.array([" ".join(rng.choices(words, k=500)).encode() for _ in range(800)], pa.binary())
    tokenizers = T.Pair(PATHS[0], "/no/such/file", plain=True).open()

    def least(f):
        took = []
        for _ in range(3):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    assert least(lambda: tokenizers.chunks(texts)) < 5 * least(lambda: pc.split_pattern(texts.cast(pa.string()), " ").flatten().dictionary_encode())
    got = tokenizers.chunks(texts)
    names = got.names.to_pylist()
    assert [[names[k] for k in got.at[a:b]] for a, b in zip(got.edges, got.edges[1:])] == [[c for w in T.words_of(x.decode()) for c in T.chunks_of(w)] for x in texts.to_pylist()]
