"""Markdown blocks, HTML elements and the sections and tables made of them, against hand-made cases."""

import pytest

from lodestone.operators import cleaning, markup

MARKDOWN = [
    ("# A\ntext", [(1, "A"), (0, "text")]),
    ("text\n# A", [(0, "text"), (1, "A")]),
    ("```\n# no\n```\nx", [(0, "x")]),
    ("```\n# never closed\n## at all", []),
    ("~~~ info\n# x\n~~\n~~~~\ny", [(0, "y")]),
    ("``` a`b\n# x", [(0, "``` a`b"), (1, "x")]),
    ("````\n```\n# x\n````\n# y", [(1, "y")]),
    ("Title\n===\nb\n---\n", [(1, "Title"), (2, "b")]),
    ("Foo\nbar\n===", [(1, "Foo\nbar")]),
    ("---\na", [(0, "a")]),
    ("a\n***\nb\n- - -\nc", [(0, "a"), (0, "b"), (0, "c")]),
    ("   ## three\n    ## code\n", [(2, "three")]),
    ("para\n    ## goes on", [(0, "para\n    ## goes on")]),
    ("#no\n#\n## x ##\n### c\n####### d", [(0, "#no"), (1, ""), (2, "x"), (3, "c"), (0, "####### d")]),
    ("# a#\n# b #c\n#\tt", [(1, "a#"), (1, "b #c"), (1, "t")]),
    ("> # q\n> a\nlazy\n\nafter", [(1, "q"), (0, "a\nlazy"), (0, "after")]),
    ("> ```\n> # x\nout\n# h", [(0, "out"), (1, "h")]),
    ("> a\n===", [(0, "a\n===")]),
    ("- # item\n  more\n\n  para\nend", [(1, "item"), (0, "more"), (0, "para\nend")]),
    ("1. a\n2. b\n\n   # h\n", [(0, "a"), (0, "b"), (1, "h")]),
    ("- a\n\n\n- b\n\ttab\n\n# z", [(0, "a"), (0, "b\n  tab"), (1, "z")]),
    ("- a\n  - b\n    # deep\n\nc", [(0, "a"), (0, "b"), (1, "deep"), (0, "c")]),
    ("- x\n---\ny", [(0, "x"), (0, "y")]),
    ("- x\n  ---\ny", [(2, "x"), (0, "y")]),
    ("text\n2. not item\n1. item", [(0, "text\n2. not item"), (0, "item")]),
    ("text\n-\n", [(2, "text")]),
    ("> - a\n>   # h\n> b", [(0, "a"), (1, "h"), (0, "b")]),
    ("<div>\n# x\n\n# y", [(1, "y")]),
    ("<!-- a\n# x\n\n# y -->\n# z", [(1, "z")]),
    ("<b>inline</b> text\n<b>\n# h", [(0, "<b>inline</b> text\n<b>"), (1, "h")]),
    ("<script>\n# x\n\n</script>\n# y", [(1, "y")]),
    ("[a]: /u 'x'\n[b]: <v>\ntext [a]", [(0, "text [a]")]),
    ("[a]: /u\n===", [(0, "===")]),
    ("a\r\nb\rc", [(0, "a\nb\nc")]),
    ("a\n\n\n    code\n\nb", [(0, "a"), (0, "b")]),
    ("", []),
    (" \n\t\n", []),
]


@pytest.mark.parametrize("text, want", MARKDOWN)
def test_markdown_blocks(text, want):
    assert markup.markdown_blocks(text) == want


def test_heading_sections(spark):
    texts = [(1, "intro\n\n# One\nbody `x`\n```\n# code\n```\n### deep\nmore\n## \nuntitled\n# Empty\n## Last\n\n\n* a\n* b"), (2, None), (3, ""), (4, "```\n# only code"), (5, "Café\n===\nCafé \x07"), (None, "# n\nx"), (1, "repeated id")]
    docs = spark.createDataFrame(texts[:6], "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, cleaning.heading_sections(docs).collect()), key=str)
    assert got == sorted([(1, 0, None, "intro"), (1, 1, "One", "body `x`\ndeep\nmore"), (1, 2, None, "untitled"), (1, 4, "Last", "a\nb"), (5, 1, "Café", "Café"), (None, 1, "n", "x")], key=str)
    assert cleaning.heading_sections(docs.limit(0)).count() == 0


def grid(html):
    """{table: {(row, column): text}}"""
    out = {}
    for _, _, table, row, column, text in (r for r in markup.html_rows(html) if r[2] is not None):
        assert (row, column) not in out.setdefault(table, {})
        out[table][row, column] = text
    return out


def test_html_elements():
    rows = markup.html_rows("<head><title>t</title></head><body>a<b>c</b><h1>H &amp; <i>x</i></h1><p>p<br>q<p>r &lt;s<script>var x='<p>';</script><h3>three</h3>z")
    assert [(r[0], r[1], r[5]) for r in rows] == [("text", 0, "ac"), ("heading", 1, "H & x"), ("text", 0, "p"), ("text", 0, "q"), ("text", 0, "r <s"), ("heading", 3, "three"), ("text", 0, "z")]
    assert grid("<table><tr><th rowspan=2>A<th colspan=2>B<tr><td>c<td><p>d</p><p>e</p><tr><td colspan='x'>f</table>") == {0: {(0, 0): "A", (0, 1): "B", (0, 2): "B", (1, 0): "A", (1, 1): "c", (1, 2): "d e", (2, 0): "f"}}
    assert grid("<table><td>a<td rowspan=3 colspan=2>b<tr><td>c<td>d<tr><td>e</table>") == {0: {(0, 0): "a", (0, 1): "b", (0, 2): "b", (1, 0): "c", (1, 1): "b", (1, 2): "b", (1, 3): "d", (2, 0): "e", (2, 1): "b", (2, 2): "b"}}
    assert grid("<table><tr><td>a<table><tr><td>in</table>b</table>")[1] == {(0, 0): "in"}
    for broken in ("", "<", "</td></table>", "<table>", "<table><tr>x", "a" * 100_000, "<p" * 1000):
        markup.html_rows(broken)


def test_html_sections_and_tables(spark):
    html = "<h1>A</h1><p>x</p><table><tr><th>k</th><th colspan=2>v</th></tr><tr><td>1<td>2<td>3</table><h2>B</h2>y<h3>c</h3><h2>none</h2>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    elements = markup.html_elements(pages).cache()
    assert sorted(map(tuple, cleaning.html_sections(elements).collect())) == [(1, 1, "A", "x\nk\nv\n1\n2\n3"), (1, 2, "B", "y\nc")]
    tables = cleaning.table_rows_markdown(markup.html_tables(elements).withColumnRenamed("page_id", "table_id"))
    assert [r.text for r in tables.collect()] == ["| k | v |\n| --- | --- |\n| 1 | 2 | 3 |"]


def test_references_without_a_semicolon():
    html = "<h1>a&amp;b&amp</h1><p>&&copy;&copy &notit;&#x27;&#65;&#65 &amp;lt; &lt"
    assert [r[5] for r in markup.html_rows(html, ended=True)] == ["a&b&amp", "&©&copy &notit;'A&#65 &lt; &lt"]
    assert [r[5] for r in markup.html_rows(html)] == ["a&b&", "&©© ¬it;'AA &lt; <"]


def test_html_sections_of_a_cut_title(spark, tmp_path):
    from lodestone.queries import QUERIES

    spark.createDataFrame([(1, "u", "<html><head><title>x&amp</title></head><body><article><h1>x&amp;&amp</h1><p>y</p></article></body></html>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert [(r.title, r.content) for r in QUERIES["html_sections"](spark, str(tmp_path)).collect()] == [("x&&amp", "y")]
