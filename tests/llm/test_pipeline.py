"""The pipeline's stages against brute force on small tables, and their edge cases."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from boxwood.llm import quality_rules as Q
from boxwood.llm import secret_scans as S
from test_llm import brute_classes

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    """Prose of two languages, near and exact copies, texts with a foreign passage, symbol junk, secrets, short texts and nulls."""
    rng = random.Random(7)
    kinds = {"en": "etaoinshrd", "fr": "lmpquvwxyz"}
    words = {k: ["".join(rng.choices(v, k=rng.randint(2, 8))) for _ in range(400)] for k, v in kinds.items()}
    prose = lambda lang, n: " ".join(rng.choices(words[lang], k=n))
    rows = []

    def add(text, lang="en", source="a"):
        rows.append((len(rows), text, lang, source, None if text is None else len(text)))

    for i in range(150):
        add(prose("en" if i % 3 else "fr", rng.randint(250, 400)), "en" if i % 3 else "fr", rng.choice("abc"))
    for i in range(8):
        own = rows[i][1].split()
        own[rng.randrange(len(own))] = "altered"
        add(" ".join(own), rows[i][2], "b")
    add(rows[9][1], rows[9][2], "c")
    mixed = len(rows)
    for _ in range(4):
        add(prose("fr", 150) + " " + prose("en", 100), "fr")
    junk = len(rows)
    for _ in range(4):
        add(" ".join(w + rng.choice(["###", "%%%", "&&&"]) for w in prose("en", 300).split()))
    add(prose("en", 80) + " api_key = 'Zk83hfLq02ndYw7' " + prose("en", 30))
    odd = [(None, prose("en", 70), "en", "a", None), (900, None, "en", "a", None), (901, "", None, None, 0), (902, prose("en", 90), None, None, 1), rows[3], (903, prose("fr", 9000), "fr", "c", 2)]
    return rows + odd, range(mixed, junk), range(junk, junk + 4)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus()[0], DOCS).cache()


def brute_model(texts):
    """Modified Kneser-Ney by its formulas, from dictionaries."""
    three = collections.Counter()
    for t in texts:
        s = [0, 0, *(int(Q.FOLD[b]) for b in t), 0]
        three.update(zip(s, s[1:], s[2:]))
    two = collections.Counter((b, c) for _, b, c in three)
    one = collections.Counter(c for _, c in two)

    def discounts(counts):
        n = [sum(x == k for x in counts.values()) for k in range(5)]
        if not all(n[1:]):
            return [0, 0.5, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        return [0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) for k in (1, 2, 3))]

    d3, d2, d1 = discounts(three), discounts(two), discounts(one)
    off = lambda d, c: d[min(c, 3)]
    after2, after3 = collections.defaultdict(list), collections.defaultdict(list)
    for (b, _), n in two.items():
        after2[b].append(n)
    for (a, b, _), n in three.items():
        after3[a, b].append(n)
    spread1 = sum(off(d1, n) for n in one.values()) / Q.SYMBOLS

    def p1(c):
        return (one[c] - off(d1, one[c]) + spread1) / sum(one.values())

    def p2(b, c):
        if b not in after2:
            return p1(c)
        return (two[b, c] - off(d2, two[b, c]) + sum(off(d2, n) for n in after2[b]) * p1(c)) / sum(after2[b])

    def p3(a, b, c):
        if (a, b) not in after3:
            return p2(b, c)
        n = three[a, b, c]
        return (n - off(d3, n) + sum(off(d3, m) for m in after3[a, b]) * p2(b, c)) / sum(after3[a, b])

    known = {}

    def of(*key):
        if key not in known:
            known[key] = math.log(p3(*key))
        return known[key]

    return of


def brute_nats(text, lang, models):
    s = [0, 0, *(int(Q.FOLD[b]) for b in text), 0]
    words = [[]]
    for key in zip(s, s[1:], s[2:]):
        words[-1].append(key)
        if key[2] == 27:
            words.append([])
    weight = lambda x: 0.5 * (x == lang) + 0.5 / len(models)
    return -sum(math.log(sum(weight(x) * math.exp(sum(m(*key) for key in w)) for x, m in models.items())) for w in words)


def test_quality_against_brute_force(docs):
    rows, mixed, junk = corpus()
    texts = collections.defaultdict(list)
    for _, text, lang, *_ in rows:
        texts[lang or ""].append((text or "").encode())
    models = {x: brute_model(t) for x, t in texts.items()}
    got = {r["doc_id"]: r for r in Q.assess(docs).collect()}
    for i in (0, 1, mixed[0], junk[0], 902):
        text, lang = next((r[1], r[2] or "") for r in rows if r[0] == i)
        want = brute_nats(text.encode(), lang, models) / len(WORD.findall(text))
        assert abs(got[i]["log_perplexity"] - want) < 1e-4 * want
    levels = collections.defaultdict(list)
    all_rows = Q.assess(docs).collect()
    for r in all_rows:
        if not r["base_failed"]:
            levels[r["lang"]].append(math.log(r["log_perplexity"]))
    for r in all_rows:
        own = sorted(levels[r["lang"]])
        low, mid, high = (own[max(0, math.ceil(q * len(own)) - 1)] for q in (0.25, 0.5, 0.75))
        room = 1.5 / math.sqrt(max(1, r["n_words"]))
        level = math.log(max(r["log_perplexity"], 1e-9))
        inside = [mid - max(0.1, 4 * (mid - low)) - room - level, level - mid - max(0.1, 8 * (high - mid)) - room]
        if min(map(abs, inside)) > 0.02:  # the histogram's bins are 0.001 wide
            assert r["kept"] == (not r["base_failed"] and max(inside) < 0)


def test_quality_stage_keeps_clean_texts(spark, docs):
    rows, mixed, junk = corpus()
    out = P.quality(spark, docs, "")
    assert out.columns == docs.columns
    ids = collections.Counter(r["doc_id"] for r in out.collect())
    assert not any(i in ids for i in junk) and all(ids[i] == 1 for i in mixed)
    assert 900 not in ids and 901 not in ids and ids[3] == 2
    long_enough = [r for r in rows if r[1] and len(WORD.findall(r[1])) >= 50 and r[0] not in junk]
    assert sum(ids.values()) == len(long_enough)


def test_near_duplicates_stage(spark, docs):
    rows, *_ = corpus()
    out = P.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    want = {str(i) for i, n, least in brute_classes(rows, 5, 80, 100) if i != "None" and (n == 0 or int(i) == least)}
    got = [str(r["doc_id"]) for r in out.collect()]
    assert sorted(got) == sorted([*want, "None"])


def test_near_duplicates_by_row(spark):
    """Rows of one id with different texts stay; of exact copies without id one stays."""
    rng = random.Random(5)
    text = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(40)) for _ in range(4)]
    rows = [(i, t, "en", "a", len(t)) for i, t in [(1, text[0]), (1, text[1]), (1, text[1]), (None, text[2]), (None, text[2]), (None, text[3]), (2, text[0])]]
    got = P.near_duplicates(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted([("1", text[0]), ("1", text[1]), ("None", text[2]), ("None", text[3])])


def test_secrets_stage(spark, docs):
    rows, *_ = corpus()
    out = P.secrets(spark, docs, "")
    assert out.columns == docs.columns and out.count() == len(rows)
    before = {r[0]: r[1] for r in rows}
    for r in out.collect():
        text = before[r["doc_id"]]
        assert (r["text"] is None) == (text is None)
        if text is not None:
            assert S.base_spans(r["text"]) == [] and r["n_chars"] == len(r["text"])
            assert r["text"] == text or S.all_spans(text)[1]
    assert not out.filter(F.col("text").contains("Zk83hfLq02ndYw7")).count()


def test_mixing_stage(spark, docs):
    rows, *_ = corpus()
    out = P.mixing(spark, docs, "")
    assert out.columns == docs.columns
    given, taken = collections.Counter(rows), collections.Counter(map(tuple, out.collect()))
    size = lambda r: len(WORD.findall(r[1] or ""))
    assert all(n <= 3 * given[r] for r, n in taken.items())
    by_source, mixed = collections.Counter(), collections.Counter()
    for r, n in given.items():
        by_source[r[3]] += n * size(r)
    for r, n in taken.items():
        mixed[r[3]] += n * size(r)
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    from boxwood.llm.mixing import targets

    for name, target in zip(names, targets([(s, by_source[s]) for s in names]), strict=True):
        assert abs(mixed[name] - target) <= 0.05 * target + 60


def test_whole_run(spark, docs, tmp_path):
    pytest.importorskip("public_tokenizers")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = P.run(spark, str(tmp_path)).collect()
    staged = docs
    for _, stage in P.STAGES[:-1]:
        staged = spark.createDataFrame(stage(spark, staged, "").collect(), DOCS)
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in staged.select("doc_id").collect()}
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    again = P.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_stages_on_empty_and_clashing_tables(spark):
    extra = "_row string, data string, n_words string, kept string, component_id string, redacted string, _size string, _source string"
    none = spark.createDataFrame([], f"{DOCS}, {extra}")
    rows = [r + ("x",) * 8 for r in corpus()[0][:60]]
    some = spark.createDataFrame(rows, f"{DOCS}, {extra}")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, none, "").count() == 0
        out = stage(spark, some, "")
        assert out.columns == some.columns and out.count() > 0
        assert {r["_row"] for r in out.collect()} == {r["_size"] for r in out.collect()} == {"x"}
    pytest.importorskip("public_tokenizers")
    assert P.packing(spark, none, "").count() == 0 and P.packing(spark, some, "").select("doc_id").distinct().count() == 60


def test_bands_reject_menus_and_monotonous_texts(spark):
    """Above the upper band: short words between bars. Below the lower one: the commonest words in ever new orders."""
    rows, *_ = corpus()
    rng = random.Random(11)
    common = [w for w, _ in collections.Counter(w for r in rows if r[1] and r[2] == "en" for w in r[1].split() if len(w) == 2).most_common(12)]
    prose = [r[1].split() for r in rows if r[1] and r[2] == "en"][:6]
    menus = [(2000 + i, " | ".join(w[:220]), "en", "a", 1) for i, w in enumerate(prose)]
    dull = [(3000 + i, " ".join(rng.choices(common, k=220)), "en", "a", 1) for i in range(3)]
    named = [(4000, prose[0][0] + " " + " ".join(prose[1]), "", "a", 1)]
    got = {r["doc_id"]: r for r in Q.assess(spark.createDataFrame(rows + menus + dull + named, DOCS)).collect()}
    assert not any(got[i]["kept"] for i, *_ in menus + dull)
    assert not all(got[i]["base_failed"] for i, *_ in menus) and not any(got[i]["base_failed"] for i, *_ in dull)
    assert {got[i]["lang"] for i in (4000, 902)} == {"", None}
    kept = [r for r in rows if r[0] is not None and r[0] < 150]
    assert all(got[r[0]]["kept"] for r in kept)


def test_stages_with_any_column_name(spark):
    names = ["a b", "x-y", "a.b", "x`y", "c,d", "e:f"]
    rows = [r + ("v",) * len(names) for r in corpus()[0][:40]]
    some = spark.createDataFrame(rows, [*(f.name for f in spark.createDataFrame([], DOCS).schema), *names])
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, some, "")
        assert out.columns == some.columns
        got = out.collect()
        assert got and all(tuple(r)[-len(names) :] == ("v",) * len(names) for r in got)


def test_secret_stage_base_spans_against_brute_force(spark):
    """Random strings of the pieces that the patterns are made of, scanned by the registered columns and by the contract's words."""
    rng = random.Random(2)
    bits = ["password", "Secret", "api_key", "apikey", "TOKEN", "passwd", '"', "'", " ", "  ", ":", "=", "\n", "abcdef", "Zk83hf", "AKIA", "ABCDEFGHIJKLMNOP", "0a1b2c3d4e5f", "é", "ſ", "/+_.=-", "x", "AKIAAKIA"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 40))) for _ in range(400)]
    patterns = {
        "assign": (r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?[ ]*[:=][ ]*["']?(?P<v>[A-Za-z0-9+/_.=-]+)""", 6),
        "access": (r"(?P<v>AKIA[A-Z0-9]+)", 20),
        "hex": (r"(?P<v>[0-9a-f]+)", 24),
    }
    for text in texts:
        want = sorted((m.start(), m.end(), k) for k, (p, n) in patterns.items() for m in re.finditer(p, text) if len(m["v"]) >= n)
        assert sorted(S.base_spans(text)) == want
        base, every = S.all_spans(text)
        assert sorted(base) == want and set(want) <= set(every)
