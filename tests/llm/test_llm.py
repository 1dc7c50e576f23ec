"""Operators against brute force, round trips and held-out accuracy, and their edge cases."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxwood.llm import chat_formatting as C
from boxwood.llm import html_extraction as H
from boxwood.llm import jaccard_join as J
from boxwood.llm import lm_scoring as L
from boxwood.llm import mixing as X
from boxwood.llm import packing as P
from boxwood.llm import quality_rules as Q
from boxwood.llm import secret_scans as S
from boxwood.llm import topk_search as K
from boxwood.llm import url_filters as U

DOCS = "doc_id bigint, text string, lang string, source string, n_words string"


def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and a column whose name clashes."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(60, 200))), rng.choice(["en", "fr"]), rng.choice(["a", "b", "c"]), "x") for i in range(40)]
    rows += [(40, None, "en", "a", None), (41, "", None, "b", "x"), (42, " \n\t ", "en", None, "x"), (43, " ".join(words * 100), "en", "a", "x"), rows[0], rows[0], (None, rows[1][1], "en", "c", "x"), (44, rows[2][1] + " more", "fr", "b", "x"), (45, "two words", "en", "a", "x")]
    return spark.createDataFrame(rows, DOCS), rows


def none_of(spark):
    return spark.createDataFrame([], DOCS)


def test_topk(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 4], 0) for i in range(120)]
    rows += [(200, None, 0), (201, [1.0, None, 0.0, 1.0], 0), (202, [float("nan")] * 4, 0), (203, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int")
    got = [tuple(r) for r in K.top_k(df, F.col("vec_id") % 40 == 0, block=2).collect()]
    whole = {i: [math.floor(1024 * x) for x in v] for i, v, _ in rows[:120]}
    want = []
    for q in (0, 40, 80):
        best = sorted(((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q))[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(got) == want  # 200 and 203 ask too, but one is null and the other has no partner
    assert K.top_k(df.limit(0), F.lit(True)).count() == 0


def test_quality_base(spark):
    df, rows = odd_docs(spark)
    out = Q.assess(df).collect()
    assert len(out) == len(rows) and Q.assess(none_of(spark)).count() == 0
    for r in out:
        assert not (r["base_failed"] and r["kept"])
    text = "a b c\na b c\nq\n\nq #$ é"
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    assert Q.base_counts(text.encode()) == (len(words), sum(map(len, words)), 2, 1, len(often))


def test_quality_many_languages(spark):
    """Each language has a model and a band of its own, however many there are."""
    rng = random.Random(8)
    rows = []
    for k in range(70):
        letters = [chr(ord("a") + (k * 5 + 3 * i) % 26) for i in range(6)]
        rows += [(2 * k + i, " ".join("".join(rng.choices(letters, k=4)) for _ in range(60)), f"l{k:02}", "a", None) for i in range(2)]
    got = {r["doc_id"]: r for r in Q.assess(spark.createDataFrame(rows, DOCS)).collect()}
    assert [got[i]["lang"] for i in range(len(rows))] == [r[2] for r in rows]
    logs = [Q.Model(*np.unique(Q.keys_of([r[1].encode() for r in rows[2 * k : 2 * k + 2]])[0], return_counts=True)).log_probs(np.arange(Q.KEYS)) for k in range(70)]
    for i in (0, 77, 139):
        keys, lengths = Q.keys_of([rows[i][1].encode()])
        words = np.array([np.add.reduceat(x[keys], Q.word_starts(keys, lengths)[0]) for x in logs])
        weights = np.full((70, 1), 0.5 / 70) + 0.5 * (np.arange(70)[:, None] == i // 2)
        want = -np.log((weights * np.exp(words)).sum(0)).sum() / 60
        assert abs(got[i]["log_perplexity"] - want) < 1e-4 * want and got[i]["kept"]


def test_model_is_a_distribution():
    keys, _ = Q.keys_of([b"the cat sat on the mat", b"a hat on the cat"])
    found = np.unique(keys, return_counts=True)
    model = Q.Model(*found)
    for context in (0, int(keys[5]) >> 6, 4095):
        assert abs(np.exp(model.log_probs(np.arange(64) + (context << 6))).sum() - 1) < 1e-4


def test_secrets(spark):
    text = 'k="9fQ2xT7LpZ0a"\nDB_PASSWORD = k\npassword=abcdef1\nAKIA' + "A" * 16 + " " + "0a" * 12 + " token: it"
    base, every = S.all_spans(text)
    assert [k for *_, k in base] == ["assign", "access", "hex"] and [k for *_, k in every][0] == "value"
    assert S.all_spans("ſecret=abcdefgh")[0] == [] and S.all_spans("a plain text, token: the next = one")[1] == []
    assert "9fQ2" not in S.redact(text) and "password=[secret]" in S.redact(text)
    doubled = "a = 'Zk83hfLq02ndYw7'\n" + "a = a + a\n" * 2000
    assert len(S.all_spans(doubled + "db_auth = a")[1]) == 1 and S.all_spans(doubled)[1] == []
    assert len(S.all_spans("client_auth = 'x9fQ2xT7LpZ0a'\n" * 5000)[1]) == 5000
    df, rows = odd_docs(spark)
    assert S.scan_secrets(df).count() == len(rows) and S.scan_secrets(none_of(spark)).count() == 0


def test_secrets_declarations():
    """Types before the sign, chained names, and literals on the line after."""
    literal = "Zk83hfLq02ndYw7"
    forms = [
        'const dbPwd: string = "{}"', 'auth_key: str = "{}"', 'val apiSecret: String = "{}"', 'db_pwd: Optional[str] = "{}"', 'let db_pwd: Map<string, string> = "{}";',
        'static DB_PWD: const char = "{}"', 'dbPwd = x = "{}"', 'dbPwd=x="{}"', 'x = dbPwd = "{}"', 'x = y\ndbPwd = z = "{}"', 'dbPwd =\n    "{}"', 'dbPwd = (\n\n  "{}"\n)', 'db_auth:\n  {}', "const dbPwd: string =\n  '{}'", 'db_auth <- "{}"', 'db_auth = """{}"""', "db_auth = '''\n{}\n'''", "db_pwd: |\n  {}", "db_pwd: >-\n  {}", 'db_auth = HELD\nx = 1\nHELD = "{}"',
    ]
    for form in forms:
        text = form.replace("{}", literal)
        assert literal not in S.redact(text), form
    halves = S.redact('db_auth = "9fQ2" + "xT7LpZ0a"')
    assert "9fQ2" not in halves and "xT7LpZ0a" not in halves
    assert len(S.all_spans("a = b\nb = a\n" * 5000 + "db_auth = b\nb = 'Zk83hfLq02ndYw7'")[1]) >= 1
    for text in ["a <- 3", "x | y: |", 'k = """ open']:
        assert S.redact(text) == text
    for text in ["DB_PWD=\nHOST=Zk83hfLq02ndYw7", "auth:\n  host: Zk83hfLq02ndYw7", "a: b, c = 'Zk83hfLq02ndYw7'", "a plain text, token: the next = one"]:
        assert S.redact(text) == text
    for text in ["auth:\n  pwd: Zk83hfLq02ndYw7", "db_pwd: Zk83hfLq02ndYw7 user = 'bob'", "db_pwd=Zk83hfLq02ndYw7="]:
        assert literal not in S.redact(text), text
    assert len(S.all_spans("a:\n" * 20000 + "db_auth = 'Zk83hfLq02ndYw7'")[1]) == 1
    assert len(S.all_spans("a = " * 5000 + "db_auth = 'Zk83hfLq02ndYw7'")[1]) == 1


def brute_classes(rows, width, num, den):
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(rows)))
    find = lambda i: i if parent[i] == i else find(parent[i])
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((str(r[0]), len(sets[i]), least.get(find(i))) for i, r in enumerate(rows))


def test_jaccard(spark):
    df, rows = odd_docs(spark)
    rng = random.Random(3)
    core = rows[5][1].split()
    for i in range(40):  # near copies with up to 12 changes, around the threshold
        own = list(core)
        for _ in range(rng.randint(0, 12)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(999)}"
        rows.append((100 + i, " ".join(own), "en", "a", "x"))
    df = spark.createDataFrame(rows, DOCS)
    got = sorted((str(r[0]), r[1], r[2]) for r in J.link_classes(df, width=4, num=85, den=100).collect())
    assert got == brute_classes(rows, 4, 85, 100)
    assert J.link_classes(none_of(spark)).count() == 0


def test_bloom_hash_is_sparks(spark):
    values = [0, 1, -1, 2**62, -(2**63), 12345678901]
    rows = spark.createDataFrame([(v,) for v in values], "node bigint").select("node", F.xxhash64("node", F.lit(2)).alias("h")).collect()
    for r in rows:
        h = J._hash_long(2, J._hash_long(r["node"], 42), 4)
        assert (h - (1 << 64) if h >> 63 else h) == r["h"]


def test_html():
    page = "<title>no</title><ul><li>a<li>b<ol><li>c</ol></ul><p>x<p hidden>y</p><script>z</script><table><tr><td>1<td>22<tr><td>333<td>4</table>t &amp; u<br>v"
    assert H.render(H.parse(page)) == "- a\n- b\n  1. c\n\nx\n\n1   | 22\n333 | 4\n\nt & u\nv"
    assert H.render(H.parse("<div>" * 5000 + "deep")) == "deep" and H.render(H.parse("")) == ""
    assert H.render(H.parse("a < b <3 <unclosed")) .startswith("a < b <3")


def test_chat(spark):
    own = "</s>[INST] ok [/INST]\\ <a> "
    turns = [("system", "be [x]"), ("user", own), ("assistant", own), ("odd] role", ""), ("assistant", "")]
    out = C.format_turns(turns)
    assert C.parse_inst(out["formatted"]) == turns and not out["rewrites_history"]
    assert [C.unescape(out["formatted"][a:b]) for a, b in out["loss"]] == [own, ""]
    rewriting = lambda t: "".join(f"{'LAST ' if i == len(t) - 1 else ''}{r}:{x};" for i, (r, x) in enumerate(t))
    out = C.format_turns([("user", "hi"), ("assistant", "yes"), ("user", "bye")], rewriting)
    assert out["rewrites_history"] and [out["formatted"][a:b] for a, b in out["loss"]] == ["yes"]
    df = spark.createDataFrame([(1, 1, "assistant", None), (1, 0, "user", "q"), (None, 0, None, "n"), (1, 1, "assistant", None)], "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in C.format_conversations(df).collect()}
    assert got[1]["n_turns"] == 3 and got[None]["n_turns"] == 1 and C.format_conversations(df.limit(0)).count() == 0


def test_lm(spark):
    df, rows = odd_docs(spark)
    got = L.score_texts(df).collect()
    count = collections.Counter()
    for i, text, *_ in rows:
        if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1:
            count.update([*(text or "").encode().lower().split(), None])
    n, v = sum(count.values()), len(count)
    assert len(got) == len(rows) and {r["train_tokens"] for r in got} == {n}
    by = collections.defaultdict(list)
    for i, text, *_ in rows:
        by[i].append([*(text or "").encode().lower().split(), None])
    for r in got:
        tokens = by[r["doc_id"]][0]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        assert r["n_tokens"] == len(tokens) and abs(r["base_score"] - base) < 1e-6 * abs(base) and r["score"] < 0
    assert L.score_texts(none_of(spark)).count() == 0


def lm_rows(train, held):
    """Ids chosen so that the first texts are learnt from and the others held out."""
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    ids = {k: iter([i for i in range(5000) if (fold(i) == 1) == k]) for k in (True, False)}
    return [(next(ids[False]), t) for t in train], [(next(ids[True]), t) for t in held]


def test_lm_context_is_the_word(spark):
    """Words that end alike predict what follows each of them."""
    train, held = lm_rows(["xxab red", "yyab blue"] * 40, ["xxab red", "xxab blue", "yyab red", "yyab blue"])
    got = {r["doc_id"]: r["score"] for r in L.score_texts(spark.createDataFrame(train + held, "doc_id bigint, text string")).collect()}
    a, b, c, d = (got[i] for i, _ in held)
    assert a > b + 1 and d > c + 1


def test_lm_closed_form(spark):
    """Where each pair and each word occurs once, no draw is left to chance."""
    train, held = lm_rows(["a b c d e"], ["a b", "b a new"])
    got = {r["doc_id"]: r["score"] for r in L.score_texts(spark.createDataFrame(train + held, "doc_id bigint, text string")).collect()}
    discount, known = 0.95, 6
    parent = lambda c: (c - discount * c + (1 + discount * known) / (known + 1)) / (1 + known)
    p = lambda c, c_word, context: (c - discount * c + (1 + discount * context) * parent(c_word)) / (1 + context)
    want = [(p(1, 1, 1), p(1, 1, 1), p(0, 1, 1)), (p(0, 1, 1), p(0, 1, 1), p(0, 0, 1), p(0, 1, 0))]
    for (i, _), probabilities in zip(held, want, strict=True):
        assert abs(got[i] - sum(map(math.log10, probabilities))) < 1e-4


def test_stirling_draws():
    """Means of exact draws are those of seating customers in turn with the same weights (no discount: independent seats)."""
    rng = np.random.default_rng(1)
    t = L.draw_tables(np.full(4000, 30), np.full(4000, 2.0), 0.0, rng)
    assert abs(t.mean() - sum(2 / (2 + i) for i in range(30))) < 0.15
    assert abs(np.exp(L.log_stirling(0.5)[3, 1:4]) - [0.75, 1.5, 1.0]).max() < 1e-9


def test_mixing(spark):
    assert X.targets([("a", 100), ("b", 100), ("c", 10)], (1, 2, 3)) == [60.0, 120.0, 30.0]
    quotas = X.split_quotas([7, 0, 12], 5, 1)
    assert [sum(q[i] for q in quotas) for i in range(3)] == [7, 0, 12] and max(map(sum, quotas)) - min(map(sum, quotas)) <= 2
    df, rows = odd_docs(spark)
    plan = X.mix_plan(df).collect()
    assert len(plan) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in plan)
    again = sorted(map(str, X.mix_plan(df).collect()))
    assert sorted(map(str, plan)) == again
    assert X.mix(df).columns == df.columns and X.mix(df).count() == sum(len(r["copies"]) for r in plan)
    assert X.mix_plan(none_of(spark)).count() == 0 and X.mix(none_of(spark)).count() == 0


def test_packing(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    encoder = P.Encoder(path)
    for text in ["", " ", "a  b", "a \n b", " a", "x\n y\t z", "it's 's", "<|endoftext|> é 漢字", "a   ", "\u00a0 b"]:
        assert encoder.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert P.pieces_of(5, 2) == [(0, 1), (1, 2), (3, 2)] and P.pieces_of(4, 2) == [(0, 2), (2, 2)] and P.pieces_of(1, 2) == [(0, 1)]
    df, rows = odd_docs(spark)
    got = P.pack(df, path, capacity=256, problem=20, islands=3).collect()
    ends = collections.defaultdict(list)
    for r in got:
        ends[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in ends.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(len(plain.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert sum(r["length"] for r in got) == total and P.pack(none_of(spark), path).count() == 0


def test_packing_added_tokens(spark):
    """Ids of the tokenizer as loaded, which maps added tokens inside a text."""
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = ["x <|endoftext|> y", "<|endoftext|>", "<|endoftext|><|endoftext|> a  b", "é<|endoftext|>\n", "<|endoftext", "a b"]
    encoder = P.Encoder(path)
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [encoder.ids(t).tolist() for t in texts] == want
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in P.tokenize(df, path, with_ids=True).collect()}
    for i, ids in enumerate(want):
        raw = np.array([*ids, 0], dtype="<u4").tobytes()
        assert bytes(got[i]["ids"]) == raw and got[i]["ids_crc32"] == zlib.crc32(raw) and got[i]["length"] == len(ids) + 1


def test_cross_keeps_pieces():
    rng = random.Random(2)
    sizes = [rng.randint(1, 60) for _ in range(80)]
    one, other = ([], [])
    P.best_fit(sizes, list(range(80)), one, [], 100)
    other = P.evolve(sizes, 100, "s", [], 3, 4)
    for bins in (P.cross(sizes, one, other, 100, rng), P.mutate(sizes, one, 100, rng)):
        assert sorted(i for b in bins for i in b) == list(range(80)) and min(P.rooms(sizes, bins, 100)) >= 0


def test_urls(spark):
    rows = [("http://a.example.com/en/74?x", "allow"), ("https://EXAMPLE.com/en/8", "block"), ("http://x.net/de/", "block"), ("http://x.net/de", "allow"), ("http://example.net/de/8", "block"), ("nourl", "allow"), (None, "allow"), ("http://notexample.com.org/es/#a", "block"), ("x://?q", "allow")]
    df = spark.createDataFrame([(i, u, "h") for i, (u, _) in enumerate(rows)], "page_id bigint, url string, host string")
    got = {r["page_id"]: r["verdict"] for r in U.judge_urls(df).collect()}
    assert got == {i: v for i, (_, v) in enumerate(rows)}
    assert U.Trie([("block", "com/a"), ("allow", "com/a")]).find("x.com", "/ab")[0] == "block"
