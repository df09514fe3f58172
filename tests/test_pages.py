"""HTML rules on small hand-made pages."""

from pyspark.sql import functions as F

from docflow.operators import pages

PAGE = """<html lang="fr"><head><title> A &amp; B </title><meta property="og:description" content=" d ">
<script type="application/ld+json">[{"@type":"Organization","name":"no"},{"@type":["x","Article"],"name":"LD  title","author":[{"name":""},"Ann"],"datePublished":"2024-05-17"}]</script>
<link rel="alternate canonical" href="https://x.fr/c"></head><body><nav><p>navigation text outside</p></nav>
<div class="big content wide"><h1>Head line</h1><p>One paragraph<p>Two <b>bold</b> <a href="../y">link</a> words
<ul><li>first item</li><li>cookie</li></ul><table><tr><th>k</th><td>v</td></tr><tr><td></td></tr></table></div>
<!-- <p>hidden comment</p> --><p>outside again</p></body></html>"""


def parsed(spark, html, nested=False):
    rows = spark.createDataFrame([(1, "https://www.x.fr/a/b", html)], "page_id int, url string, html string")
    return pages.parse_pages(rows, nested_paragraphs=nested)


def test_blocks_follow_the_main_container(spark):
    got = pages.page_blocks(parsed(spark, PAGE)).orderBy("block_no").collect()
    assert [(r.tag, r.text) for r in got] == [
        ("h1", "Head line"), ("p", "One paragraph"), ("p", "Two bold link words"), ("li", "- first item"), ("table", "k | v"),
    ]
    assert {r.selector for r in got} == {".content"}
    assert [(l.href, l.anchor) for l in got[2].links] == [("https://www.x.fr/y", "link")]


def test_nested_paragraphs_repeat_inner_text(spark):
    html = "<article><p>One paragraph<p>Two words here</p><p>Three words here</p></article>"
    flat = pages.page_blocks(parsed(spark, html)).orderBy("block_no").collect()
    assert [r.text for r in flat] == ["One paragraph", "Two words here", "Three words here"]
    nested = pages.page_blocks(parsed(spark, html, nested=True)).orderBy("block_no").collect()
    assert [r.text for r in nested] == ["One paragraph Two words here Three words here", "Two words here", "Three words here"]


def test_metadata_prefers_json_ld(spark):
    m = pages.page_metadata(parsed(spark, PAGE)).first()
    assert (m.title, m.description, m.author, m.published) == ("LD  title", "d", "Ann", "2024-05-17T00:00:00")
    assert (m.canonical, m.lang, m.site_name, m.source_domain) == ("https://x.fr/c", "fr", "www.x.fr", "www.x.fr")


def test_title_cascade(spark):
    assert parsed(spark, PAGE).select(pages.page_title().alias("t")).first().t == "A & B"
    assert parsed(spark, "<p>x</p>").select(pages.page_title().alias("t")).first().t == "Titre non disponible"
    saved = pages.stored_title(F.lit(""), F.lit(None).cast("string"), F.lit("https://x.fr/mon-titre"))
    assert parsed(spark, "<p>x</p>").select(saved.alias("t")).first().t == "Mon titre"


def test_sections_stop_at_the_end_of_their_parent(spark):
    html = "<main><h1>T</h1><section><h2>A</h2><p>a1</p><ul><li>a2</li></ul></section><h2>B</h2><span>no</span><p>b</p></main>"
    got = [(r.name, r.text) for r in pages.section_blocks(parsed(spark, html)).orderBy("section_no").collect()]
    assert got == [("Titre", "T"), ("A", "a1\na2"), ("B", "b")]


def test_empty_and_broken_pages(spark):
    for html in ("", None, "just text", "<p", "</p></div>"):
        assert parsed(spark, html).count() == 1
        pages.page_blocks(parsed(spark, html)).collect()


def test_large_pages_take_linear_time(spark):
    import time

    n = 12_500
    shapes = {
        "blocks": "<main>" + "<p>une phrase <a href='/x'>lien</a></p>" * n + "</main>",
        "table": "<main><table>" + "<tr><td>cle</td><td>valeur</td></tr>" * n + "</table></main>",
        "headings": "<main>" + "<h2>titre du bloc</h2><p>texte du bloc</p>" * n + "</main>",
        "deep": "<main>" + "<div><section>" * n + "<p>texte du fond</p>",
        "strays": "<main>" + "</p></b><div>mot</div></i>" * n + "</main>",
    }
    start = time.time()
    for name, html in shapes.items():
        page = parsed(spark, html)
        blocks, sections = pages.page_blocks(page).collect(), pages.section_blocks(page).collect()
        want = {"blocks": (n, 0), "table": (1, 0), "headings": (2 * n, n), "deep": (1, 0), "strays": (0, 0)}[name]
        assert (len(blocks), len(sections)) == want, name
    assert time.time() - start < 120


def test_sections_end_at_true_siblings_alone(spark):
    html = "<main><h2>A</h2><p>a1</p><div><p>in a box</p><h2>B</h2><p>b1</p></div></main>"
    got = [(r.name, r.text) for r in pages.section_blocks(parsed(spark, html)).orderBy("section_no").collect()]
    assert got == [("A", "a1\nin a box B b1"), ("B", "b1")]


def test_parsed_pages_leave_a_batch_in_bounded_slices(spark, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(pages, "SLICE_ITEMS", 8)
    html = [f"<main><h1>t{n}</h1>" + "<p>x</p>" * (n % 5) + "</main>" for n in range(50)] + [None, ""]
    made = list(pages._outlines(False)(iter([pd.Series(html)])))
    sizes = [[len(e) + len(t) for e, t in zip(m["elements"], m["texts"])] for m in made]
    assert len(made) > 10 and sum(map(len, made)) == len(html)
    assert all(sum(s[:-1]) < 8 for s in sizes)
    rows = spark.createDataFrame(list(enumerate(html)), "page_id int, html string").coalesce(1)
    got = {r.page_id: r.n for r in pages.parse_pages(rows).selectExpr("page_id", "size(dom.elements) AS n").collect()}
    assert got == {n: 2 + n % 5 for n in range(50)} | {50: 0, 51: 0}
