"""Phrase and proximity matches against a scan of every window over every document."""

import hashlib
import random
import re

from boxwood.llm import decontamination as D

TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, width=10, slop=2):
    tokens = [words(t) for _, t in docs]
    often = {}
    for own in tokens:
        for w in own:
            often[w] = often.get(w, 0) + 1
    windows = []
    for item, text in items:
        own = words(text)
        for s in range(max(len(own) - width, 0) + 1 if own else 0):
            windows.append((str(item) if item is not None else "null", own[s : s + width]))
    out = []
    for (i, _), own in zip(docs, tokens):
        hit, exact, near = set(), set(), set()
        for item, window in windows:
            first = min(range(len(window)), key=lambda k: (often.get(window[k], 0), k))
            for p, w in enumerate(own):
                if w != window[first]:
                    continue
                zero = p - first
                if own[max(zero, 0) : zero + len(window)] == window:
                    exact.add(item)
                    hit |= set(range(zero, zero + len(window)))
                if all(x in own[max(zero + k - slop, 0) : max(zero + k + slop + 1, 0)] for k, x in enumerate(window)):
                    near.add(item)
        out.append((str(i), len(own), len(hit), sorted(exact), sorted(near)))
    return sorted(out)


def run(spark, docs, items, **how):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id bigint, text string, `k.1` int, word string")
    b = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id bigint, text string, term int, pos string")
    return sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], list(r["items"]), list(r["near_items"])) for r in D.decontaminate(d, b, **how).collect())


def test_random_texts(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(40)] + ["the"] * 20 + ["Ñandú", "é"]
    item = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, item(rng.choice([1, 2, 5, 9, 10, 11, 14, 30]))) for k in range(25)] + [(40, None), (41, " .,- "), (None, item(12)), (3, item(13)), (42, "the the the the the the the the the the the")]
    docs = []
    for k in range(60):
        own = item(rng.randint(0, 60)).split()
        for _ in range(rng.randint(0, 2)):
            planted = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(len(planted) - 10, 0))
            planted = planted[a : a + rng.randint(9, 14)]
            if rng.random() < 0.4 and len(planted) > 4:  # a word more, or two in another order: near, not the same
                planted.insert(rng.randrange(len(planted)), "extra")
            at = rng.randint(0, len(own))
            own[at:at] = planted
        docs.append((k, rng.choice([" ", ", ", "\n", ".\t"]).join(own).upper() if k % 3 == 0 else "-".join(own)))
    docs += [(100, None), (101, ""), (102, "!?"), (5, docs[7][1]), (5, docs[7][1]), (None, docs[8][1]), (None, docs[9][1]), (103, "the " * 500)]
    want = brute(docs, items)
    assert run(spark, docs, items) == want
    assert any(set(r[4]) - set(r[3]) for r in want) and any(r[2] for r in want)


def test_joined_by_shuffle(spark, monkeypatch):
    """The way beyond the broadcast bound gives the same rows."""
    monkeypatch.setattr(D, "BROADCAST_ROWS", -1)
    rng = random.Random(4)
    items = [(k, " ".join(f"w{rng.randint(0, 30)}" for _ in range(12))) for k in range(6)] + [(9, "alone")]
    docs = [(k, " ".join(f"w{rng.randint(0, 30)}" for _ in range(10)) + " " + items[k % 7][1]) for k in range(20)]
    assert run(spark, docs, items) == brute(docs, items)


def test_edges(spark):
    docs = [(1, "a b c"), (2, None)]
    assert run(spark, docs, []) == [("1", 3, 0, [], []), ("2", 0, 0, [], [])] == run(spark, docs, [(1, None), (2, "")])
    assert run(spark, [], [(1, "a b")]) == []
    passage = " ".join(f"p{k}" for k in range(30))
    long = "z " * 200_000 + passage + " z" * 100_000
    copies = [(None, long[-220_000:])] * 3 + [(k, passage) for k in range(200)]
    got = run(spark, [(1, long), *copies], [(7, passage), (8, passage)])
    assert ("1", 300_030, 30, ["7", "8"], ["7", "8"]) in got and sum(r[2] == 30 for r in got) == 204 and len(got) == 204


def test_digest(spark):
    """Ids are sorted as strings."""
    text = "one two three four five six seven eight nine ten"
    got = run(spark, [(1, text)], [(2, text), (10, text)])
    assert got[0][3] == ["10", "2"] and hashlib.sha256(b"10,2").hexdigest()
