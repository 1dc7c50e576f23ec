"""How much work packing takes: bins that are full stay, solved problems rest, and chunks of a batch leave nothing behind."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from boxwood.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


def whole(sizes, bins, capacity):
    return sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= capacity for b in bins)


@pytest.mark.parametrize("seed", [1, 2])
def test_the_bound_is_reached_where_best_fit_fills_most_bins(seed, monkeypatch):
    rng = random.Random(seed)
    sizes = [rng.randint(30, 1500) for _ in range(3000)]
    first, least = [], P.least_bins(sizes, 2048)
    P.best_fit(sizes, list(range(len(sizes))), first, [], 2048)
    aside = P.set_aside(sizes, first, 2048)
    assert len(first) == least + 1 and len(aside) > len(first) / 4
    asked, fitness = [], P.fitness
    monkeypatch.setattr(P, "fitness", lambda s, *rest: asked.append(len(s)) or fitness(s, *rest))
    bins = P.evolve(sizes, 2048, "0/0/0", [], 60, 8)
    assert len(bins) == least and whole(sizes, bins, 2048)
    assert max(asked) == len(sizes) - sum(map(len, aside))


def test_islands_go_on_from_each_others_bins():
    rng = random.Random(5)
    sizes = [rng.randint(30, 1500) for _ in range(1500)]
    least = P.least_bins(sizes, 2048)
    first = []
    P.best_fit(sizes, list(range(len(sizes))), first, [], 2048)
    as_sent = [P._to_bins(P._to_array(first, len(sizes)))] * 2
    assert P.set_aside(sizes, first, 2048)
    for bound in (least, least - 1):  # one that can't be reached, too: nothing may be lost on the way
        bins = P.evolve(sizes, 2048, "0/0/1", as_sent, 5, 3, stall=3, least=bound)
        assert whole(sizes, bins, 2048) and least <= len(bins) <= len(first)


def test_solved_problems_rest(spark, monkeypatch):
    written, durable = [], P.durable
    monkeypatch.setattr(P, "durable", lambda df: written.append(df.columns) or durable(df))
    pieces = spark.createDataFrame([(i, 512) for i in range(400)], "i int, length bigint")
    got = P.pack_pieces(pieces, 2048, problem=100).collect()
    assert len({r["i"] for r in got}) == 400 and len({r["sequence_id"] for r in got}) <= 100 + 4
    assert sum("_island" in c for c in written) == 1


def test_unsolved_problems_go_on(spark, monkeypatch):
    written, durable = [], P.durable
    monkeypatch.setattr(P, "durable", lambda df: written.append(df.columns) or durable(df))
    rng = random.Random(1)
    sizes = [rng.randint(500, 900) for _ in range(600)]
    got = P.pack_pieces(spark.createDataFrame(list(enumerate(sizes)), "i int, length bigint"), 2048, problem=300, epochs=2, generations=5).collect()
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["i"]))
    assert sorted(i for b in bins.values() for *_, i in b) == list(range(600))
    assert all([a for a, *_ in sorted(b)] == [0, *np.cumsum([n for _, n, _ in sorted(b)])[:-1]] and sum(n for _, n, _ in b) <= 2048 for b in bins.values())
    assert sum("_island" in c for c in written) == 2


def test_chunks_of_a_batch_are_not_kept():
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("aé漢1.,\n'", k=rng.randint(1, 6)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) + rng.choice(["", "", " ", "\n ", "  "]) for _ in range(800)]
    encoder = P.Encoder(PATH)
    ids, counts = encoder.many(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [x.ids for x in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    plain = P.Encoder(PATH)
    plain.many(["one two three"] * 3 + ["four five"])
    assert not plain._known
