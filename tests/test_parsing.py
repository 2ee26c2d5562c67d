import json

from sparrowdex.operators import parsing as P
from sparrowdex.sources import files as S

GUIDE = """---
title: "The guide"
---
import X from 'y'

Lead text.


Still lead.

# First

<!-- a comment -->
<Tabs>
Body of first.
</Tabs>

```sh
# not a heading
import kept
```

## Empty

### Deep

deep text

Setext title
============

after setext

## Under setext ##
***
last
"""


def parsed(spark, *rows):
    docs, sections = P.markdown(spark.createDataFrame([(p, r, None) for p, r in rows], "source_path string, raw string, modified timestamp"))
    return {r.source_path: r for r in docs.collect()}, sorted(sections.collect(), key=lambda r: (r.document_id, r.section_order))


def test_markdown_sections(spark):
    docs, sections = parsed(spark, ("docs/guide.md", GUIDE))
    assert docs["docs/guide.md"].title == "The guide"
    assert [(r.section_order, r.heading_level, r.heading_path, r.content) for r in sections] == [
        (0, 0, ["The guide"], "Lead text.\n\nStill lead."),
        (1, 1, ["First"], "Body of first.\n\n```sh\n# not a heading\nimport kept\n```"),
        (3, 3, ["First", "Empty", "Deep"], "deep text"),
        (4, 1, ["Setext title"], "after setext"),
        (5, 2, ["Setext title", "Under setext"], "last"),
    ]


def test_markdown_without_headings_or_content(spark):
    docs, sections = parsed(spark, ("a/plain.md", "just text\n"), ("a/empty.mdx", ""), ("a/open.md", "---\ntitle: x\nno end"), ("b/two.md", "# Two\n\ntext"))
    assert {p: d.title for p, d in docs.items()} == {"a/plain.md": "plain", "a/empty.mdx": "empty", "a/open.md": "open", "b/two.md": "Two"}
    got = {r.document_id: r for r in sections}
    assert set(got) == {docs[p].id for p in ("a/plain.md", "a/open.md", "b/two.md")}
    plain = got[docs["a/plain.md"].id]
    assert (plain.heading_level, plain.heading_path, plain.section_title, plain.content) == (0, [], None, "just text")


def test_ids_are_stable_and_fit_together(spark):
    docs, a = parsed(spark, ("docs/guide.md", GUIDE))
    _, b = parsed(spark, ("docs/guide.md", GUIDE), ("other.md", "# x\n\ny"))
    assert {r.id for r in a} <= {r.id for r in b}
    assert {r.document_id for r in a} == {docs["docs/guide.md"].id}


WIKI = """{{Infobox|a={{nested|x}}}}
Lead with '''bold''' and [[Page|a link]] and [https://e.org text] [https://e.org].
[[File:x.png|thumb]]
{| class="t"
|-
! Head
| a=1 | cell one
| cell two
|}
== Part ==
text<ref name="a">gone</ref> <br/>here


== Empty ==
=== Sub ===
sub text
"""


def test_wikitext(spark):
    pages = spark.createDataFrame([("My Page", WIKI, None), ("Old", "#redirect [[My Page]]", None), ("Bare", "{{only|template}}", None)], "title string, wikitext string, scraped timestamp")
    docs, sections = P.wikitext(pages, "https://wiki.example.org")
    (d,) = docs.collect()
    assert (d.source_path, d.source_url, d.title, d.source_name) == ("user_docs/my-page.wiki", "https://wiki.example.org/My_Page", "My Page", "user_docs")
    got = sorted(sections.collect(), key=lambda r: r.section_order)
    assert [(r.section_order, r.heading_level, r.heading_path) for r in got] == [(0, 0, ["My Page"]), (1, 2, ["My Page", "Part"]), (2, 3, ["My Page", "Empty", "Sub"])]
    assert got[0].content.startswith("Lead with bold and a link and text .")
    assert "cell one" in got[0].content
    assert "Infobox" not in got[0].content
    assert got[1].content == "text here"


def node(kind, *content, **attrs):
    return {"type": kind, "content": list(content), "attrs": attrs}


def text(t, *marks):
    return {"type": "text", "text": t, "marks": list(marks)}


TREE = node(
    "doc", node("paragraph", text("intro "), text("code", {"type": "code"}), text("site", {"type": "link", "attrs": {"href": "https://e.org"}})), node("heading", text("Usage"), level=2),
    node("bulletList", node("listItem", node("paragraph", text("one"))), node("listItem"), node("listItem", node("paragraph", text("two")))), node("orderedList", node("listItem", node("paragraph", text("first")))),
    node("table", node("tableRow", node("tableCell", node("paragraph", text("a"))), node("tableCell", node("paragraph", text("b"))))), node("heading", text("Deep"), level=3), node("blockquote", node("paragraph", text("quoted"))), node("codeBlock", text("x = 1")),
    node("tokensManagement", tokens=[{"path": "color.red"}, {}]), node("shortcut-tiles", shortcutTiles=[{"title": "T", "link": "L"}]), node("image", altText="alt"), node("horizontalRule"), node("wrapper", node("paragraph", text("in")), node("paragraph", text("out"))),
)


def test_tree_blocks():
    assert P.tree_blocks(json.dumps(TREE)) == [
        (None, "intro `code`site (https://e.org)"), (2, "Usage"), (None, "- one\n- two"), (None, "1. first"), (None, "a | b"), (3, "Deep"), (None, "> quoted"), (None, "```\nx = 1\n```"), (None, "Tokens: color.red"), (None, "T - L"), (None, "Image: alt"), (None, "in\n\nout"),
    ]
    assert P.tree_blocks(None) == P.tree_blocks(" ") == P.tree_blocks('{"type": "other"}') == []


def test_design_pages(spark):
    tab = lambda name, order, t: {"uid": name, "name": name, "order": order, "contentNode": node("doc", node("paragraph", text(t)))}
    tabs = {"type": "tabs", "tabs": {"z": tab("Overview", 1, "over"), "a": tab("Code", 2, "code"), "m": {"uid": "l", "name": "Last", "contentNode": node("doc", node("paragraph", text("last")))}}}
    payload = {"pages": [{"id": 1, "name": "Button", "introduction_node": json.dumps(node("doc", node("paragraph", text("hello")))), "content_node": json.dumps(tabs)}, {"id": 2, "name": "___x", "content_node": "{}"}, {"id": 3, "name": "Hidden", "content_node": "{}"}, {"id": 4, "name": "None"}, {"id": 5, "name": "Plain", "content_node": json.dumps(TREE)}]}
    nav = {"categories": [{"name": "Parts", "navigation_id": "n", "pages": [{"id": 1, "uid": "u1", "name": "Button"}, {"id": 3, "uid": "u3", "name": "Hidden", "visibility": "hidden"}, {"id": 5, "uid": "u5", "name": "Plain"}]}]}
    shell = f"<script>window.NAV = {json.dumps(nav)};</script>"
    from pyspark.sql import functions as F

    index = S.page_index(spark.createDataFrame([(shell,)], "html string").select(S.window_json(F.col("html"), "NAV").alias("json")))
    pages = S.included_pages(S.landed_pages(spark.createDataFrame([(json.dumps(payload),)], "json string")), index)
    docs, sections = P.design_pages(pages.withColumn("scraped", F.lit(None).cast("timestamp")), "https://d.example/", "share")
    assert {r.source_path: r.source_url for r in docs.collect()} == {"design_system/parts/button-u1.site": "https://d.example/share/p/u1", "design_system/parts/plain-u5.site": "https://d.example/share/p/u5"}
    by = {}
    for r in sorted(sections.collect(), key=lambda r: r.section_order):
        by.setdefault(r.heading_path[0], []).append((r.section_order, r.section_title, r.heading_level, r.heading_path[1:], r.content.split("\n")[0]))
    assert by["Button"] == [(0, "Button", 0, [], "hello"), (1, "Button", 0, [], "over"), (2, "Code", 0, ["Code"], "code"), (3, "Last", 0, ["Last"], "last")]
    assert [x[:4] for x in by["Plain"]] == [(0, "Plain", 0, []), (1, "Usage", 2, ["Usage"]), (2, "Deep", 3, ["Usage", "Deep"])]


def test_html(spark):
    page = "<html><head><title>A &amp; B</title></head><body><nav>menu</nav><p>lead<br>on<h1>One</h1><p>p1</p><p>p2<h3>Three</h3>x<script>var a='</p>';</script><h2>Two</h2><ul><li>i</li></ul><footer>f</footer></body></html>"
    docs, sections = P.html(spark.createDataFrame([("http://e.org/a/b?c=1", page, None), ("http://e.org/none", "<p></p>", None)], "url string, html string, scraped timestamp"))
    (d,) = docs.collect()
    assert (d.title, d.source_path) == ("A & B", "site/e-org-a-b-c-1.html")
    assert [(r.section_order, r.heading_level, r.heading_path, r.content) for r in sorted(sections.collect(), key=lambda r: r.section_order)] == [
        (0, 0, ["A & B"], "lead on"), (1, 1, ["A & B", "One"], "p1\n\np2"), (2, 3, ["A & B", "One", "Three"], "x"), (3, 2, ["A & B", "One", "Two"], "i"),
    ]


def test_missing_payloads_are_errors(spark):
    import pytest
    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("<html></html>", "{}")], "html string, json string")
    for c in (S.window_json(F.col("html"), "X"), S.meta_content(F.col("html"), "y")):
        with pytest.raises(PySparkException):
            df.select(c).collect()
    with pytest.raises(PySparkException):
        S.landed_pages(df).collect()
    good = spark.createDataFrame([('<meta name="csrf" content="abc">',)], "html string")
    assert good.select(S.meta_content(F.col("html"), "csrf")).head()[0] == "abc"


def test_markdown_tree(spark, tmp_path):
    for p in ("a.md", "sub dir/b.MDX", "sub/c.markdown", ".git/d.md", "sub/.hidden/e.md", "f.txt", ".dot.md", "_files/g.md", "sub/_files/deep/_more/h.md", ".git/_x/i.md"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(f"# {p}\n\ntext\n")
    (tmp_path / "sub" / "_ünder.md").write_text("# sub/_ünder.md\n\ntext\n")
    rows = S.markdown_tree(spark, str(tmp_path)).collect()
    assert {r.source_path: r.raw for r in rows} == {p: f"# {p}\n\ntext\n" for p in ("a.md", "sub dir/b.MDX", "sub/c.markdown", ".dot.md", "sub/_ünder.md", "_files/g.md", "sub/_files/deep/_more/h.md")}
    assert all(r.modified is not None for r in rows)


def test_markdown_that_is_not_utf8_is_an_error(spark, tmp_path):
    import pytest
    from pyspark.errors import PySparkException

    (tmp_path / "a.md").write_bytes(b"# caf\xe9\n")
    with pytest.raises(PySparkException):
        S.markdown_tree(spark, str(tmp_path)).collect()


def test_eval_cases_and_artifacts(spark, tmp_path):
    import pytest

    (tmp_path / "a.yaml").write_text("cases:\n- id: q1\n  query: how\n  preferred_source_names: [x]\n- id: q2\n  query: why\n  top_k: 3\n")
    (tmp_path / "b.json").write_text(json.dumps([{"id": "q3", "query": "z"}]))
    (tmp_path / "bad.json").write_text('{"other": 1}')
    rows = {r.id: r for f in ("a.yaml", "b.json") for r in S.eval_cases(spark, str(tmp_path / f)).collect()}
    assert (rows["q1"].preferred_source_names, rows["q1"].top_k, rows["q1"].acceptable_source_names) == (["x"], 5, [])
    assert rows["q2"].top_k == 3
    with pytest.raises(ValueError, match="list of cases"):
        S.eval_cases(spark, str(tmp_path / "bad.json"))
    (tmp_path / "r.json").write_text(json.dumps({"eval": {"outcomes": [{"case_id": "q1", "grade": "MISS"}]}}))
    (tmp_path / "s.json").write_text(json.dumps({"outcomes": [{"case_id": "q2", "grade": "MISS"}]}))
    assert [S.report_artifact(spark, str(tmp_path / f)).head().case_id for f in ("r.json", "s.json")] == ["q1", "q2"]
