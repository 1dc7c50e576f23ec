"""The queries' quality model over whole bytes: no two symbols share a key."""

import collections
import inspect
import math
import random

from boxwood.llm import quality_rules as Q
from test_pipeline import DOCS, brute_model

WORDS = 60


def corpus():
    """Per text, words over one of two alphabets that folding to 64 symbols can't tell apart: bytes that are equal modulo 32, marks, and cases."""
    rng = random.Random(11)
    kinds = ["абвгдежз", "#*$%&|<>", "ABCDEFGH"], ["ѐёђѓєѕіїј", "=+~^@`\\#", "abcdefgh"]
    rows = []
    for i in range(60):
        kind = kinds[i % 2]
        text = " ".join("".join(rng.choices(kind[k % 3], k=rng.randint(2, 6))) + rng.choice(["", "x"]) for k in range(WORDS))
        rows.append((i, text if i % 7 else text + "\tend\n", "xx" if i % 3 else None, "a", None))
    return rows


def test_perplexity_against_brute_force_over_bytes(spark, monkeypatch):
    rows = corpus()
    got = {r["doc_id"]: r for r in Q.assess(spark.createDataFrame(rows, DOCS), folded=False).collect()}
    monkeypatch.setattr(Q, "FOLD", Q.BYTES)
    monkeypatch.setattr(Q, "SYMBOLS", 256)
    texts = collections.defaultdict(list)
    for _, text, lang, *_ in rows:
        texts[lang].append(text.encode())
    models = {x: brute_model(t) for x, t in texts.items()}
    for i in (0, 1, 2, 7, 58):
        _, text, lang, *_ = rows[i]
        s, words = [0, 0, *text.encode(), 0], [[]]
        for key in zip(s, s[1:], s[2:]):
            words[-1].append(key)
            if key[2] in b" \t\n":
                words.append([])
        weight = lambda x: 0.5 * (x == lang) + 0.5 / len(models)  # noqa: E731, B023
        want = -sum(math.log(sum(weight(x) * math.exp(sum(m(*k) for k in w)) for x, m in models.items())) for w in words) / Q.letter_words(text.encode())
        assert abs(got[i]["log_perplexity"] - want) < 1e-4 * want, i


def test_bytes_that_fold_alike_have_their_own_keys():
    for one, other in (("###", "&&&"), ("aBc", "abc"), ("а", "Ѱ"), ("1", "2")):
        a, b = (Q.keys_of([x.encode()], Q.WHOLE)[0].tolist() for x in (one, other))
        assert a != b and len(a) == len(one.encode()) + 1
    keys, lengths = Q.keys_of([bytes([b]) for b in range(255)], Q.WHOLE)
    assert len(set(keys.reshape(-1, 2)[:, 0].tolist())) == 255 and lengths.tolist() == [2] * 255


def spied(monkeypatch, module):
    """What the module's calls of assess give for folded."""
    asked, judge = [], Q.assess

    def spy(*args, **given):
        asked.append(given.get("folded", inspect.signature(judge).parameters["folded"].default))
        return judge(*args, **given)

    monkeypatch.setattr(module, "assess", spy)
    return asked


def test_the_query_uses_whole_bytes(spark, monkeypatch):
    df = spark.createDataFrame(corpus(), DOCS)
    monkeypatch.setattr(Q, "table", lambda *_: df)
    asked = spied(monkeypatch, Q)
    Q.op2_quality_rules(spark, "")
    assert asked == [False]
