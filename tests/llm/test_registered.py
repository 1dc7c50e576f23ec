"""The registered queries over whole tables: against their SQL, or against plain Python written from the contract."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import pytest

from boxwood.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def run(spark, name, sf=SF):
    return [r.asDict() for r in QUERIES[name](spark, sf).collect()]


def held(table, columns, sf=SF):
    return duckdb.sql(f"SELECT {columns} FROM '{sf}/{table}.parquet'").fetchall()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def only(rows, *columns):
    return sorted(tuple(r[c] for c in columns) for r in rows)


def as_text(rows):
    return sorted(str(tuple(r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF).select(*want.columns).collect()
    assert as_text(got) == as_text(want.fetchall())


def test_quality(spark):
    got = run(spark, "op2_quality_rules")
    want = []
    for i, text in held("documents", "doc_id, text"):
        words = WORD.findall(text or "")
        lines, seen = [x for x in (text or "").split("\n") if WORD.search(x)], set()
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        times = collections.Counter(windows)
        again = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(3)}
        repeated = 0
        for x in lines:
            repeated += x in seen
            seen.add(x)
        symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
        want.append((i, len(words), sum(map(len, words)), symbols, repeated, len(again), len(words) < 50 or 100 * len(again) > 50 * len(words)))
    assert only(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want)
    assert not any(r["kept"] and r["base_failed"] for r in got) and any(r["kept"] for r in got)


def test_secrets(spark):
    sf = "/root/testdata/sf0.01"  # the smaller table has no secrets
    got = run(spark, "op3_secret_scans", sf)
    letters = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_")
    kinds = [("assign", rf"""(?:{letters}?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?(?P<v>[A-Za-z0-9+/_.=-]+)""", 6), ("access", r"(?P<v>AKIA[A-Z0-9]+)", 20), ("hex", r"(?P<v>[0-9a-f]+)", 24)]
    want, spans = [], {}
    for i, text in held("documents", "doc_id, text", sf):
        found = [(m.start(), k, kind, m.end()) for k, (kind, p, least) in enumerate(kinds) for m in re.finditer(p, text or "") if len(m["v"]) >= least]
        own = spans[i] = [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]
        want.append((i, *(sum(x[2] == kind for x in found) for kind, *_ in kinds), sha(",".join(own))))
    assert only(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(want)
    assert sum(map(len, spans.values())) > 0
    for r in got:
        assert [x for x in r["spans"].split(",") if x and not x.startswith("value:")] == spans[r["doc_id"]]


def test_pages(spark):
    got = run(spark, "op5_html_extraction")
    assert sorted(r["page_id"] for r in got) == sorted(i for (i,) in held("pages", "page_id"))


def test_chat(spark):
    got = run(spark, "op6_chat_formatting")
    turns = collections.defaultdict(list)
    own = "</s>[INST] ok [/INST]"
    for i, turn, role, text in [*held("conversations", "conv_id, turn, role, text"), (-7, 0, "user", own), (-7, 1, "assistant", own)]:
        turns[i].append((turn, role, text or ""))
    want = []
    for i, rows in turns.items():
        rows.sort(key=lambda r: r[0])
        loss = "".join(t for _, role, t in rows if role == "assistant")
        want.append((i, len(rows), sha("".join(f"{role}\n{t}\n" for _, role, t in rows)), len(loss), sha(loss)))
    assert only(got, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == sorted(want)
    assert all(r["formatted_chars"] > r["loss_chars"] for r in got)


def test_lm(spark):
    got = {r["doc_id"]: r for r in run(spark, "op7_lm_scoring")}
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = {i: [*WORD.findall((text or "").translate(lower)), None] for i, text in held("documents", "doc_id, text")}
    out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    count = collections.Counter(w for i, tokens in docs.items() if not out[i] for w in tokens)
    n, v = sum(count.values()), len(count)
    assert got.keys() == docs.keys()
    gain = 0.0
    for i, tokens in docs.items():
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(tokens), sum(count[w] > 0 for w in tokens), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-6)
        gain += (r["score"] - r["base_score"]) * out[i]
    assert gain > 0  # held-out texts are likelier than under the counts alone


def test_mixing(spark):
    got = {r["doc_id"]: r for r in run(spark, "op8_mixing")}
    docs = held("documents", "doc_id, source, text")
    sizes, words = collections.Counter(), {}
    for i, source, text in docs:
        words[i] = len(WORD.findall(text or ""))
        sizes[source] += words[i]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    goal, free, rest = {}, set(names), float(sum(sizes.values()))
    while over := [s for s in free if rest * weight[s] / sum(weight[x] for x in free) > 3 * sizes[s]]:
        goal |= {s: 3.0 * sizes[s] for s in over}
        free -= set(over)
        rest = sum(sizes.values()) - sum(goal.values())
    goal |= {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
    taken, longest = collections.Counter(), collections.Counter()
    for i, source, _ in docs:
        r = got[i]
        assert (r["size"], r["source_size"]) == (words[i], sizes[source]) and r["target"] == pytest.approx(goal[source])
        assert 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[source] += r["taken"]
        longest[source] = max(longest[source], words[i])
    for s in names:  # documents are taken whole, so a target can be missed by a share of one
        assert abs(taken[s] - goal[s]) <= max(0.02 * goal[s], longest[s] / 2)


def test_packing(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    got = run(spark, "op9_best_fit_packing")
    ids = {i: [*plain.encode(text or "", add_special_tokens=False).ids, 0] for i, text in held("documents", "doc_id, text")}
    pieces, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == ids.keys()
    for i, own in pieces.items():
        at = 0
        for k, (piece, start, length, crc) in enumerate(sorted(own)):
            assert (piece, start) == (k, at) and 0 < length <= 2048 and (k == 0 or length == 2048)
            at += length
            assert crc == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[i][start:at]))
        assert at == len(ids[i]) and len(own) == -(-at // 2048)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) >= -(-sum(map(len, ids.values())) // 2048)
