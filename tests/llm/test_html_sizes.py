"""A table's lines don't depend on how many others it has."""

import pytest

from boxwood.llm import html_extraction as H


def shown(page: str) -> str:
    return H.render(H.parse(page))


HEAD = "<tr><td>" + "w" * 30 + "<td>name<td>" + "v" * 35 + "<td>n"


@pytest.mark.parametrize("row", ["<tr><td>b<td>c<td>d<td>e", "<tr><td>b<br>bb<td><td>d<td>e<br>ee", "<tr><td colspan=2>b<td>d", "<tr><td>b<td rowspan=2>c<td>d<td>e<tr><td>f<td>g<td>h"])
def test_rows_look_alike_in_small_and_large_tables(row):
    few, many = (shown("<table>" + HEAD + row * n + "</table>").split("\n") for n in (50, 4000))
    each = (len(few) - 1) // 50
    assert many[: len(few)] == few and many[1:] == few[1 : 1 + each] * 4000
    assert few[1].index("d") == few[0].index("v" * 35) or "g" in row


def test_a_line_has_bounded_padding():
    """Columns beyond PAD_LINE aren't padded to; no text is lost."""
    page = "<table><tr>" + ("<td>" + "w" * 60) * 9 + "".join("<tr>" + "<td>" * k + "x" for k in range(1, 10)) * 300 + "</table>"
    text = shown(page)
    assert text.count("x") == 2700 and text.count("w") == 540
    assert max(line.count(" ") for line in text.split("\n")[1:]) <= H.PAD_LINE + 3 * 9


def test_long_texts_leave_a_task_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(H, "_HELD", 3)
    rows = [(i, x) for i, x in enumerate(["<p>abcdef", None, "a", "", "<p>b<p>c", "d"])]
    got = {r["page_id"]: r["text"] for r in H.extract_html(spark.createDataFrame(rows, "page_id bigint, html string").coalesce(1)).collect()}
    assert got == {0: "abcdef", 1: "", 2: "a", 3: "", 4: "b\n\nc", 5: "d"}
