"""Page texts: layout, implied tags, visibility, damaged pages."""

import re
from html.parser import HTMLParser

import pytest

from talentgrid.llm.html import extract, page_text

CASES = {
    "<p>a<p>b": "a\n\nb",
    "<ul><li>one<li>two<ol start=3><li>x<li>y</ol></ul>z": "- one\n- two\n  3. x\n  4. y\n\nz",
    "a<br>b<div>c</div>d": "a\nb\nc\nd",
    "<table><tr><th>Name<th>N<tr><td>Alice<td>1<tr><td colspan=2>both of them</table>": "Name   N\nAlice  1\nboth of them",
    "<pre>\n a\n   b</pre>": " a\n   b",
    "<p>x<script>var a='</p>'</script><style>p{}</style><!-- c -->y": "xy",
    "<p hidden>no<p style='display: none'>no<p style=\"visibility:hidden\">no<p>yes": "yes",
    "<head><title>t</title></head>body": "body",
    "<title>t</title>body<noscript>no</noscript><template>no</template>": "body",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\nd\nu\ne",
    "1 &lt; 2 &amp; 3 < 4": "1 < 2 & 3 < 4",
    "<details><summary>s</summary>no</details><details open><summary>s</summary>yes</details>": "s\ns\nyes",
    "<p>a <b>b</b>\n c": "a b c",
    "<a title='x>y'>link</a>": "link",
    "text <x": "text",
    "<select><option>a<option>b</select>": "a",
    "<select><option>a<optgroup><option selected>b</select>": "b",
    "<select multiple><option>a<option>b</select>": "a\nb",
    "": "", "<": "<", "</p>": "", "<!-- never closed": "",
}


@pytest.mark.parametrize("page,text", list(CASES.items()))
def test_cases(page, text):
    assert page_text(page) == text


QUOTES = {
    '<p class="x"">First</p><p class="y"">Second</p>': "First\n\nSecond",
    "<p title=it's>Hello visible text, don't lose</p>": "Hello visible text, don't lose",
    "<p a\"b>one</p><p 'c>two</p>": "one\n\ntwo",
    '<p x="1"y=\'>\'>one<p x = ">" hidden>no<p x=a"b hidden>no<p x=>two': "one\n\ntwo",
    '<p>one<a href="x>two</a> three': "onetwo three",
    "<a href=/a/b/>one</a><br/><img alt='>'/>two": "one\ntwo",
}


@pytest.mark.parametrize("page,text", list(QUOTES.items()))
def test_quotes_in_tags(page, text):
    assert page_text(page) == text


SPANS = {
    "<table><tr><td rowspan=2>ab<td>c<tr><td>d<tr><td>e<td>f</table>": "ab  c\n    d\ne   f",
    "<table><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>": "a  b  c\nd     e\nf     g",
    "<table><tr><td rowspan=3 colspan=2>a<td>bb<tr><td>c<tr><td>d</table>": "a   bb\n    c\n    d",
    "<table><thead><tr><th rowspan=9>a<th>b<tbody><tr><td>c<td>d</table>": "a  b\nc  d",
    "<table><tr><td rowspan=2>a<td rowspan=1>b<td rowspan=2>c<tr><td>d</table>": "a  b  c\n   d",
}
VISIBILITY = {
    '<div style="visibility:hidden">no<p style="visibility: visible">yes</p>no</div>': "yes",
    '<p style="visibility:hidden">no<b style="visibility:visible">yes<i>too</i><i style="visibility:hidden">no</i></b>': "yestoo",
    '<p style="display:none">no<b style="visibility:visible">no</b></p>yes': "yes",
    '<p style="backface-visibility:hidden">yes': "yes",
    '<ul style="visibility:collapse"><li>no<li style="visibility:visible">yes</ul>': "- yes",
    '<table><tr style="visibility:collapse"><td style="visibility:visible">no<tr><td>yes</table>': "yes",
    '<table><tr style="visibility:hidden"><td>no<td style="visibility:visible">yes<tr><td>a<td>b</table>': "   yes\na  b",
}


@pytest.mark.parametrize("page,text", [*SPANS.items(), *VISIBILITY.items()])
def test_row_spans_and_visibility(page, text):
    assert page_text(page) == text


def test_row_spans_take_bounded_room():
    page = "<table><tr>" + f"<td rowspan=65534>{'y' * 50}" * 1200 + "<tr><td>x" * 20_000
    text = page_text(page)
    assert text.count("x") == 20_000 and len(text) < 1 << 26


def test_many_quotes_take_linear_time():
    assert page_text('<a x="' * 50_001) == "" and page_text("<a x='\"" * 50_001 + ">") == ""
    assert page_text('<p x="y"">a</p>' * 20_000).count("a") == 20_000
    assert page_text("<a " + "b   " * 50_000 + "=" * 50_000) == ""


def test_deep_and_damaged_pages_take_linear_time():
    assert page_text("<div>" * 100_000 + "x") == "x"
    assert page_text("<ul><li>" * 20_000 + "x").strip().endswith("x")
    assert page_text("<table><tr><td>" * 5_000 + "x").strip().endswith("x")
    assert page_text('<a "' * 50_000) == "" and page_text("<b>" * 50_000 + "</i>" * 50_000 + "y") == "y"


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.hidden, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("head", "script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("head", "script", "style")

    def handle_data(self, data):
        if not self.hidden:
            self.words += data.split()


def test_words_of_all_pages(spark, small):
    """The words in order, marks of lists apart, are those that a plain parser sees."""
    from talentgrid.llm.queries import QUERIES

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in QUERIES["op1_html_text"](spark, small).collect()}
    assert set(got) == set(pages)
    for i, page in pages.items():
        plain = Plain()
        plain.feed(page)
        text = re.sub(r"(?m)^ *- ", "", got[i])
        assert "".join(text.split()) == "".join(plain.words)


def test_odd_rows(spark, none):
    df = spark.createDataFrame([(1, None, "t"), (None, "", "t"), (2, "<p>x", "t"), (2, "<p>x", "t")], "page_id long, html string, text string")
    assert sorted((r.id or 0, r.text) for r in extract(df).collect()) == [(0, ""), (1, ""), (2, "x"), (2, "x")]
    assert extract(none, "id", "text").collect() == []
