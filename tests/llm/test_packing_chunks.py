"""Whole batches of texts have the ids that each text has by itself."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from boxwood.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", "\t", " ", "　", "\x1c", "\x85", "a", "é", "漢", "'s", "don't", "1", "!", "😀", "<|endoftext|>", "​", "ß", " \n", "x "]


def test_batches_against_the_library():
    rng = random.Random(3)
    texts = ["", " ", "a ", " a", "a  b", *("".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(4000))]
    ids, counts = P.Encoder(PATH).many(texts)
    library = Tokenizer.from_file(PATH)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_a_chunk_is_looked_up_once_a_batch(monkeypatch):
    encoder, asked = P.Encoder(PATH), []
    apart = encoder._apart
    monkeypatch.setattr(encoder, "_apart", lambda chunks, sizes: asked.append(list(chunks)) or apart(chunks, sizes))
    ids, _ = encoder.many(["a quetzal and a quetzal"] * 50 + ["the quetzal"])
    assert sum(x.count("quetzal") for x in asked) == 1 and len(asked) == 1
    assert len(ids) == 50 * len(encoder.ids("a quetzal and a quetzal")) + len(encoder.ids("the quetzal"))


def test_texts_of_a_batch_in_parts(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, None if i % 17 == 0 else "".join(rng.choices(PARTS, k=rng.randint(0, 40)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    want = P.tokenize(df, PATH, 16).collect()
    assert len({r["doc_id"] for r in want}) == 300 and max(r["length"] for r in want) == 16
    encoder = P.Encoder(PATH)
    assert sum(r["length"] for r in want) == sum(len(encoder.ids(t or "")) + 1 for _, t in rows)
