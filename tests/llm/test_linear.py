"""Work that grows with the input, whatever its shape, and the rarer cases of the page, chat, URL and search operators."""

import math

from pyspark.sql import functions as F

from boxwood.llm import chat_formatting as C
from boxwood.llm import html_extraction as H
from boxwood.llm import topk_search as K
from boxwood.llm import url_filters as U


def text_of(page):
    return H.render(H.parse(page))


def test_pages_deep_and_stray():
    assert text_of("<div>" * 100_000 + "deep" + "</x>" * 100_000) == "deep"
    assert text_of("<p><button>" + "<div>" * 50_000 + "x") == "x"
    assert text_of("<ul><li>a<ul>" + "<li>b" * 3 + "</ul><li>c") == "- a\n  - b\n  - b\n  - b\n- c"
    assert text_of("a<p>b<p>c</p></p>d") == "a\n\nb\n\nc\n\nd"
    assert text_of("<table><tr><td>a</b></p>b</table>") == "a b"


def test_pages_lose_no_text():
    assert text_of("<table><tr><td>|<td>||<tr><td>a<td>b</table>") == "| | ||\na | b"
    assert text_of("x<pre>\n  a\n b  </pre>y") == "x\n\n  a\n b  \n\ny"
    assert text_of("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>") == "yes"
    assert text_of("<svg><title>no</title><text>label</text></svg> <math><mi>m</mi></math>") == "label m"
    assert text_of("<select><option>a<option selected>b<option>c</select>") == "b" == text_of("<select><option>b<option>c</select>")
    assert text_of("<select multiple><option>a<option>b</select>") == "a\nb"
    assert text_of("<table><tr><td colspan=2>ab<td>c<tr><td>1<td>2<td>3</table>") == "ab    | c\n1 | 2 | 3"
    assert text_of("<table><tr><td rowspan=2>r<td>a<tr><td>b</table>") == "r | a\n  | b"
    assert text_of("<table><tr><td colspan=999999999>a<td>b</table>").count("|") == 1


def test_extract_rows(spark):
    rows = [(1, "<p>a", "x"), (1, "<p>a", "x"), (None, None, None), (3, "", "y"), (4, "<i>" * 3000 + "d", "z")]
    df = spark.createDataFrame(rows, "page_id bigint, html string, `te.xt` string")
    got = sorted(map(str, map(tuple, H.extract_html(df).collect())))
    assert got == sorted(map(str, [(1, "a"), (1, "a"), (None, ""), (3, ""), (4, "d")]))
    assert H.extract_html(df.limit(0)).count() == 0


def test_long_conversations():
    """Spans by stretches are those by whole prefixes, for templates that append, number the turns, look back, or rewrite."""
    turns = [(["user", "assistant", "tool"][k % 3], f"t{k}" * (k % 4)) for k in range(150)]
    appends = C.inst_template
    numbered = lambda t: "".join(f"{i}:{x};" for i, (_, x) in enumerate(t))
    looks_back = lambda t: "".join(("again " if i and t[i - 1][0] == r else "") + f"<{r}>{x}" for i, (r, x) in enumerate(t))
    first = lambda t: "".join(f"{t[0][1]}/{x}|" for _, x in t)
    for template in (appends, numbered, looks_back):
        out, spans, bodies, rewrites = C.locate(turns, template)
        assert not rewrites and out == template(turns)
        before = template([])
        for k, (a, b) in enumerate(spans):
            after = template(turns[: k + 1])
            assert (a, b) == (len(before), len(after))
            before = after
    assert C.locate([("u", f"x{k}") for k in range(150)], first)[0] == first([("u", f"x{k}") for k in range(150)])
    counted = lambda t: f"{len(t)}!" + "".join(x for _, x in t)
    assert C.locate(turns, counted)[3]
    assert len(C.locate([("user", "x")] * 20_000, appends)[1]) == 20_000


def test_many_entries_of_one_host(spark):
    trie = U.Trie([("block", f"x.com/a{k}") for k in range(100_000)] + [("allow", "x.com/a77")])
    assert trie.find("x.com", "/a99999x") == ("block", "x.com/a99999") and trie.find("y.x.com", "/a77") == ("block", "x.com/a77")
    rows = [(1, "http://a.com/en/1"), (1, "http://a.com/en/1"), (None, None), (2, "http://a.com/" + "x/" * 100_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string")
    assert sorted((str(r["page_id"]), r["verdict"]) for r in U.judge_urls(df).collect()) == [("1", "block"), ("1", "block"), ("2", "allow"), ("None", "allow")]
    assert U.judge_urls(df.limit(0)).count() == 0


def test_topk_extremes(spark):
    """Repeated and null ids, ties, and scores that no long holds."""
    rows = [(0, [1e9, 1e9]), (0, [1.0, 0.0]), (1, [1e9, 1e9]), (2, [-1e9, -1e9]), (3, [1e9, 1e9]), (4, [1e300, 1e300]), (None, [1.0, 1.0]), (5, [0.0, 0.0]), (5, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [tuple(r) for r in K.top_k(df, F.col("vec_id") == 1, k=20).orderBy("rank").collect()]
    whole = lambda v: [int(min(max(math.floor(min(max(1024 * x, -1e300), 1e300)), -1e300), 1e300)) for x in v]
    clip = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    asks = whole([1e9, 1e9])
    want = sorted((-clip(sum(a * b for a, b in zip(asks, whole(v)))), i) for i, v in rows if i is not None and i != 1)
    assert got == [(1, k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert [tuple(r) for r in K.top_k(df, F.col("vec_id") == 1, k=2).orderBy("rank").collect()] == got[:2]
    assert [r["score"] for r in K.top_k(df, F.col("vec_id") == 0, k=1).collect()] == [clip(1024 * int(1e300))]  # the smaller vector of id 0 asks
