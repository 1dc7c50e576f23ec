"""Layout inside cells, bounded padding, and all registered pages against a plain reading of their markup."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import duckdb
import pytest

from boxwood.llm import html_extraction as H

SF = "/root/testdata/sf0.001"

#: What the pages of the test tables use.
SKIPPED = {"title", "style", "script", "head"}
APART = {"p", "h1", "h2", "h3", "ul"}
LINES = {"html", "body", "nav", "div", "article", "footer", "li", "section", "main", "header"}


def shown(page: str) -> str:
    return H.render(H.parse(page))


def test_cells_keep_lines_lists_and_tables():
    page = "<table><tr><td><h1>Title</h1><p>one<p>two<ul><li>c<li>d</ul><td>right<br>side</tr><tr><td><table><tr><td>1<td>2<tr><td>33<td>4</table><td>x</table>after"
    assert shown(page) == "Title  | right\n       | side\none\n\ntwo\n\n- c\n- d\n1  | 2 | x\n33 | 4\n\nafter"
    assert shown("<table><tr><td>layout<p>a<p>b</td></tr><tr><td><ul><li>x</ul></table>") == "layout\n\na\n\nb\n- x"


def test_spans():
    page = "<table><tr><td rowspan=2>A<td>b<td>c<tr><td>dddd<td>e<tr><td colspan=2>wide cell here<td>z<tr><td>1<td><td>3</table>"
    assert shown(page) == "A | b          | c\n  | dddd       | e\nwide cell here | z\n1 |            | 3"


def test_labels_of_buttons():
    assert shown("<input type=submit value='Send it'><input type=text value=no><input value=no><input type=reset value=x hidden>") == "Send it"


@pytest.mark.parametrize(
    "page",
    [
        "<table><tr><td>" + "x" * 60_000 + "<td>a" + "<tr><td>b<td>c" * 10_000 + "</table>",
        "<table><tr>" + "<td colspan=1000 rowspan=9>x" * 7_000 + "</table>",
        "<table>" + "<tr><td colspan=1000 rowspan=9>x<td>y" * 6_000 + "</table>",
        "<table><tr>" + "<td>x" * 20_000 + "<td>" + "a<br>" * 20_000 + "</table>",
        "<table>" + "<tr><td rowspan=1000>x" * 10_000 + "</table>",
        "<table><tr>" + "".join(f"<td rowspan={65534 - i % 2}>" for i in range(4000)) + "<tr><td>x" * 12_000 + "</table>",
        "<table><tr><td>x<td>y<br>z" * 8_000,
    ],
)
def test_text_is_bounded_by_the_page(page):
    assert len(shown(page)) < 4 * len(page)


class Plain(HTMLParser):
    """Text with marks: 1 a line's end, 2 a paragraph's, 3 a br."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.out, self.skip, self.p = [], 0, False
        self.feed(page)
        self.close()

    def mark(self, tag: str) -> None:
        if self.p and tag in APART | LINES:  # any block ends a paragraph
            self.out.append("\x02")
            self.p = False
        self.out.append("\x02" if tag in APART else "\x01" if tag in LINES else "")

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        self.mark(tag)
        self.p |= tag == "p"
        if tag == "br":
            self.out.append("\x03")
        if tag == "li":
            self.out.append("\x04")

    def handle_endtag(self, tag):
        self.skip -= tag in SKIPPED
        self.mark(tag)

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)

    def text(self) -> str:
        text = re.sub(r"[ \t\n\r\f]+", " ", "".join(self.out))

        def breaks(m: re.Match) -> str:
            lines = 0
            for c in m[0]:
                lines = {"\x01": max(lines, 1), "\x02": max(lines, 2), "\x03": min(2, lines + 1)}.get(c, lines)
            return "\n" * lines

        return re.sub(r"[\x01-\x03 ]*[\x01-\x03][\x01-\x03 ]*", breaks, text).strip("\n ").replace("\x04", "- ")


def test_registered_pages_by_a_plain_reading(spark):
    got = {r["page_id"]: r["text"] for r in H.op5_html_extraction(spark, SF).collect()}
    pages = duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall()
    assert len(got) == len(pages)
    for i, page in pages:
        assert got[i] == Plain(page or "").text(), i
