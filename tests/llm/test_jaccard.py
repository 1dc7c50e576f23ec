"""The Jaccard join against brute force, at thresholds low and high, with small groups so that many are met."""

import random

import pytest
from pyspark.sql import functions as F

from boxwood.llm import jaccard_join as J


def brute(rows, width, num, den):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], len(sets[i]), least[find(i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize("num", [30, 50, 60])
def test_small_sets(spark, monkeypatch, num):
    """Sets of 1 to 12 words, where the number of shared ones that a link needs is least."""
    monkeypatch.setattr(J, "GROUP", 8)
    rng = random.Random(num)
    rows = [(i, " ".join(rng.sample([f"w{k}" for k in range(60)], rng.randint(1, 12)))) for i in range(250)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(tuple(r) for r in J.link_classes(df, width=1, num=num, den=100).collect()) == brute(rows, 1, num, 100)


@pytest.mark.parametrize("num", [40, 85])
def test_near_but_unlinked(spark, monkeypatch, num):
    """A large family of texts around the threshold, and pairs of others, over several groups and parts."""
    monkeypatch.setattr(J, "GROUP", 16)
    monkeypatch.setattr(J, "VISITS", 32)
    rng = random.Random(num)
    core = [f"c{k}" for k in range(60)]
    rows = []
    for i in range(150):
        own = list(core)
        for _ in range(rng.randint(0, 30)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(400)}"
        rows.append((i, " ".join(own)))
    for i in range(40):
        own = [f"v{rng.randrange(300)}" for _ in range(rng.randint(3, 40))]
        rows.append((1000 + 2 * i, " ".join(own)))
        own[rng.randrange(len(own))] = "x"
        rows.append((1001 + 2 * i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(tuple(r) for r in J.link_classes(df, width=2, num=num, den=100).collect()) == brute(rows, 2, num, 100)


def test_odd_names_and_rows(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", None), (None, "a b c d e f", "y"), (2, None, "z"), (3, "", "z"), (4, "A B C D E F", "z")]
    df = spark.createDataFrame(rows, "`a.b` bigint, `x``y` string, node string")
    got = J.link_classes(df, id_col="a.b", text_col="x`y")
    assert got.columns == ["a.b", "n_shingles", "component_id"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, 2, 1), (1, 2, 1), (None, 2, 1), (2, 0, 2), (3, 0, 3), (4, 2, 1)]))
    assert J.link_classes(df.filter(F.lit(False)), id_col="a.b", text_col="x`y").count() == 0
