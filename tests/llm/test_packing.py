"""Packing: the genetic algorithm where best fit isn't optimal, and the pieces of the query against brute force."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxwood.llm import packing as P


def islands(sizes, capacity, epochs=3):
    best = [None, None]
    for epoch in range(epochs):
        best = [P.evolve(sizes, capacity, f"0/{k}/{epoch}", [best[k], best[1 - k]] if epoch else [], 60, 8) for k in range(2)]
    return min(map(len, best))


@pytest.mark.parametrize("low, high, margin", [(500, 900, 0.06), (400, 750, 0.03)])
def test_islands_beat_best_fit(low, high, margin):
    rng = random.Random(1)
    sizes = [rng.randint(low, high) for _ in range(1000)]
    alone = []
    P.best_fit(sizes, list(range(len(sizes))), alone, [], 2048)
    assert islands(sizes, 2048) <= (1 - margin) * len(alone)


def test_least_bins_is_a_bound():
    rng = random.Random(3)
    for _ in range(60):
        sizes = [rng.randint(1, 12) for _ in range(6)]
        fewest = min(len(set(c)) for c in itertools.product(range(6), repeat=6) if all(sum(x for x, b in zip(sizes, c) if b == k) <= 12 for k in set(c)))
        assert P.least_bins(sizes, 12) <= fewest
    assert P.least_bins([7, 7, 7], 12) == 3 and P.least_bins([5, 5, 5], 12) == 2 and P.least_bins([], 12) == 0


def test_pieces_against_brute_force(spark):
    """start, length and ids_crc32 of each piece, from the tokenizer as loaded; each sequence gapless and within the capacity; as many as the lengths allow."""
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(-1, None), (-2, ""), (-2, ""), (-3, "word " * 9000), (-4, "x <|endoftext|> y")]
    got = P.pack(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("length", F.lit("clash")), path).collect()
    want = []
    for i, text in rows:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        if len(ids) <= 2048:
            cuts = [0, len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert [a for a, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) <= 2048
    assert len(places) == P.least_bins([w[3] for w in want], 2048)
