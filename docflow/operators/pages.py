"""Stored web pages to titles, metadata, blocks, tables and links.

HTML is the one input that needs a per-row parser. ``parse_pages`` runs a small one inside Arrow
batches and returns a flat element list; every rule after that is a Column expression on the same
row, so structuring a page never shuffles.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions import urls as ux
from docflow.functions.text import first_nonblank, is_irrelevant_text, norm_edges, norm_for_eq, parse_any_date
from docflow.functions.wordlists import MAIN_SELECTORS
from docflow.runtime import explode_rows

ELEMENTS = "array<struct<pos:int,last:int,up:int,stop:int,tag:string,attrs:map<string,string>,first_text:int,n_texts:int>>"
BLOCK_TAGS = ("h1", "h2", "h3", "h4", "p", "blockquote", "li")
_SECTION_TAGS = ("h2", "h3")
NO_TITLE = "Titre non disponible"
#: Elements and texts that a task holds as Python objects at most, but for a single page that has more.
SLICE_ITEMS = 20_000

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HIDDEN = frozenset(("script", "style", "template"))
_ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main "
    "nav ol p pre section table ul".split()
)


class _Outline(HTMLParser):
    """Element list in document order.

    Each element knows its parent ``up`` (-1 at the top), its last descendant, so that its content is the range from
    ``pos + 1`` to ``last``, and its text span; a section heading knows the next one among its siblings, ``stop``.
    """

    def __init__(self, nested_paragraphs: bool):
        super().__init__(convert_charrefs=True)
        self.nested = nested_paragraphs
        self.elements: list[dict] = []
        self.texts: list[str] = []
        self.open: list[int] = []
        self.n_open: Counter[str] = Counter()
        self.heading_of: dict[int, int] = {}
        self.buffer: list[str] = []

    def _flush(self):
        raw = "".join(self.buffer)
        self.buffer.clear()
        holder = self.elements[self.open[-1]] if self.open else None
        if holder and holder["tag"] in _HIDDEN:
            holder["attrs"].setdefault("#data", raw)
        elif raw.strip():
            self.texts.append(" ".join(raw.split()))

    def _close_from(self, depth: int):
        for i in self.open[depth:]:
            self.elements[i]["last"] = len(self.elements) - 1
            self.elements[i]["n_texts"] = len(self.texts) - self.elements[i]["first_text"] + 1
            self.n_open[self.elements[i]["tag"]] -= 1
        del self.open[depth:]

    def _close_nearest(self, tag: str):
        if not self.n_open[tag]:
            return  # nothing to look for; else what the search passes is closed, so all searches together are linear
        for depth in range(len(self.open) - 1, -1, -1):
            if self.elements[self.open[depth]]["tag"] == tag:
                return self._close_from(depth)

    def handle_starttag(self, tag, attrs):
        self._flush()
        if tag in _ENDS_PARAGRAPH and not self.nested:
            self._close_nearest("p")
        at, up = len(self.elements), self.open[-1] if self.open else -1
        self.elements.append(
            {
                "pos": at, "last": at, "up": up, "stop": None, "tag": tag, "attrs": {k: v or "" for k, v in attrs},
                "first_text": len(self.texts) + 1, "n_texts": 0,
            }
        )
        if tag in _SECTION_TAGS:
            if up in self.heading_of:
                self.elements[self.heading_of[up]]["stop"] = at
            self.heading_of[up] = at
        if tag not in _VOID:
            self.open.append(at)
            self.n_open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        self._close_nearest(tag)

    def handle_data(self, data):
        self.buffer.append(data)

    def handle_comment(self, data):
        self._flush()

    def close(self):
        super().close()
        self._flush()
        self._close_from(0)


def _outlines(nested_paragraphs: bool):
    """Parsed pages in slices of bounded size, whatever the size of a batch of pages."""

    def outline(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, items = [], 0
            for source in batch:
                parser = _Outline(nested_paragraphs)
                parser.feed(source or "")
                parser.close()
                rows.append((parser.elements, parser.texts))
                items += len(parser.elements) + len(parser.texts)
                if items >= SLICE_ITEMS:
                    yield pd.DataFrame(rows, columns=["elements", "texts"])
                    rows, items = [], 0
            yield pd.DataFrame(rows, columns=["elements", "texts"])

    return outline


def parse_pages(pages: DataFrame, html: str = "html", nested_paragraphs: bool = False) -> DataFrame:
    """Replace the HTML column by ``dom struct<elements, texts>``.

    ``nested_paragraphs=False`` ends an open ``<p>`` at the next block element, as browsers do, so
    no text appears twice. ``True`` keeps unclosed paragraphs open and repeats inner text.
    """
    parse = F.pandas_udf(_outlines(nested_paragraphs), f"struct<elements:{ELEMENTS},texts:array<string>>")
    rest = [c for c in pages.columns if c != html]
    return pages.select(*rest, parse(F.col(html)).alias("dom"))


# ------------------------------------------------------------------ column rules on ``dom``

_ELS = "dom.elements"


def _text_of(el: Column) -> Column:
    return F.array_join(F.slice(F.col("dom.texts"), el["first_text"], el["n_texts"]), " ")


def _first(predicate) -> Column:
    return F.get(F.filter(F.col(_ELS), predicate), F.lit(0))


def _attr(el: Column, name: str) -> Column:
    return F.try_element_at(el["attrs"], F.lit(name))


def _meta(kind: str, value: str) -> Column:
    """``content`` of the first ``<meta kind="value">``, blank as null."""
    found = _first(lambda e: (e["tag"] == "meta") & (_attr(e, kind) == value))
    return F.nullif(norm_edges(_attr(found, "content")), F.lit(""))


def _matches(el: Column, selector: str) -> Column:
    if selector.startswith("#"):
        return _attr(el, "id") == selector[1:]
    if selector.startswith("."):
        classes = F.split(F.coalesce(_attr(el, "class"), F.lit("")), r"\s+")
        return F.array_contains(classes, selector[1:])
    if selector.startswith("["):
        key, value = selector[1:-1].split("=")
        return _attr(el, key) == value
    return el["tag"] == selector


def main_root() -> Column:
    """``struct<selector, pos, last>`` of the first matching container, else body, else the page."""

    def pick(name: str, predicate) -> Column:
        found = _first(predicate)
        hit = F.struct(F.lit(name).alias("selector"), found["pos"].alias("pos"), found["last"].alias("last"))
        return F.when(found.isNotNull(), hit)

    whole = F.struct(
        F.lit("document").alias("selector"), F.lit(-1).alias("pos"), F.size(_ELS).alias("last")
    )
    def by_selector(selector: str) -> Column:
        return pick(selector, lambda e: _matches(e, selector))

    ranked = [by_selector(s) for s in MAIN_SELECTORS]
    return F.coalesce(*ranked, pick("body", lambda e: e["tag"] == "body"), whole)


def with_root(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("root", main_root())


def _inside(el: Column, outer: Column) -> Column:
    return (el["pos"] > outer["pos"]) & (el["pos"] <= outer["last"])


def _content(el: Column) -> Column:
    """The elements below one, a range of the list."""
    return F.slice(F.col(_ELS), el["pos"] + 2, el["last"] - el["pos"])


def page_title() -> Column:
    """og:title, twitter:title, ``<title>``, then the first h1."""
    head = _first(lambda e: e["tag"] == "title")
    h1 = _first(lambda e: e["tag"] == "h1")
    return first_nonblank(
        _meta("property", "og:title"), _meta("name", "twitter:title"), _text_of(head), _text_of(h1),
        default=NO_TITLE,
    )


def stored_title(title: Column, metadata_title: Column, url: Column) -> Column:
    """Title kept with a saved page: given, metadata, twitter:title, URL slug, ``Sans titre``."""
    real = F.nullif(norm_edges(title), F.lit("Sans titre"))
    return first_nonblank(
        real, metadata_title, _meta("name", "twitter:title"), ux.slug_title(url), default="Sans titre"
    )


def _links_in(el: Column, base: Column) -> Column:
    """Every link below an element with its absolute target and anchor text."""
    anchors = F.filter(_content(el), lambda a: (a["tag"] == "a") & _attr(a, "href").isNotNull())
    return F.transform(
        anchors,
        lambda a: F.struct(ux.url_join(base, _attr(a, "href")).alias("href"), _text_of(a).alias("anchor")),
    )


def table_text(el: Column) -> Column:
    """Cells joined by `` | ``, one line per row that holds any text."""
    rows = F.filter(_content(el), lambda r: r["tag"] == "tr")

    def line(row: Column) -> Column:
        cells = F.filter(_content(row), lambda c: c["tag"].isin("td", "th"))
        return F.transform(cells, _text_of)

    filled = F.filter(F.transform(rows, line), lambda cells: F.exists(cells, lambda c: c != ""))
    return F.array_join(F.transform(filled, lambda cells: F.array_join(cells, " | ")), "\n")


def with_sections(parsed: DataFrame, url: str = "url") -> DataFrame:
    """Add ``selector`` and ``sections array<struct<tag, text, links>>`` of the main container.

    Links stay attached to their block, so removing noise can never misalign them. Tables follow
    the text blocks. Everything happens inside the page's own row.
    """
    base, root = F.col(url), F.col("root")

    def block(el: Column) -> Column:
        text = _text_of(el)
        text = F.when((el["tag"] == "li") & (text != ""), F.concat(F.lit("- "), text)).otherwise(text)
        return F.struct(el["tag"].alias("tag"), text.alias("text"), _links_in(el, base).alias("links"))

    def table(el: Column) -> Column:
        return F.struct(F.lit("table").alias("tag"), table_text(el).alias("text"), _links_in(el, base).alias("links"))

    blocks = F.transform(F.filter(F.col(_ELS), lambda e: e["tag"].isin(*BLOCK_TAGS) & _inside(e, root)), block)
    blocks = F.filter(blocks, lambda b: ~is_irrelevant_text(b["text"]))
    tables = F.transform(F.filter(F.col(_ELS), lambda e: (e["tag"] == "table") & _inside(e, root)), table)
    tables = F.filter(tables, lambda b: F.trim(b["text"]) != "")
    rooted = with_root(parsed)
    return rooted.select(
        *parsed.columns, F.col("root.selector").alias("selector"), F.concat(blocks, tables).alias("sections")
    )


def page_blocks(parsed: DataFrame, url: str = "url") -> DataFrame:
    """One row per block: the page's columns, ``selector, block_no, tag, text, links``."""
    keep = [c for c in parsed.columns if c != "dom"]
    return (
        explode_rows(with_sections(parsed, url), [*keep, "selector"], "sections", "block_no", "block")
        .select(*keep, "selector", "block_no", "block.tag", "block.text", "block.links")
    )


def page_records(parsed: DataFrame, url: str = "url") -> DataFrame:
    """Saved form of a page: title, ordered sections and same-site links in one row; no shuffle."""
    keep = [c for c in parsed.columns if c != "dom"]
    return with_sections(parsed, url).select(
        *keep,
        stored_title(page_title(), F.lit(None).cast("string"), F.col(url)).alias("title"),
        "sections",
        _followable(F.col(url)).alias("outlinks"),
        ux.page_file_name(url).alias("page_key"),
    )


def page_is_useful(parsed: DataFrame) -> DataFrame:
    """``n_blocks`` of at least eight characters, and the keep flag."""
    root = F.col("root")

    def good(e: Column) -> Column:
        text = _text_of(e)
        return e["tag"].isin(*BLOCK_TAGS) & _inside(e, root) & (F.length(text) >= 8) & ~is_irrelevant_text(text)

    counted = with_root(parsed).withColumn("n_blocks", F.size(F.filter(F.col(_ELS), good)))
    return counted.withColumn("useful", F.col("n_blocks") > 0).drop("root")


_LD_TYPES = ("article", "newsarticle", "blogposting", "webpage")


def jsonld_fields() -> Column:
    """``struct<title, author, published, modified>`` from the page's JSON-LD scripts.

    Objects are taken in document order; the first non-blank value of a field wins.
    """
    scripts = F.filter(
        F.col(_ELS), lambda e: (e["tag"] == "script") & (_attr(e, "type") == "application/ld+json")
    )

    def objects(el: Column) -> Column:
        doc = F.try_parse_json(_attr(el, "#data"))
        many = F.try_variant_get(doc, "$", "array<variant>")
        return F.coalesce(many, F.array(doc))

    wanted = F.filter(
        F.flatten(F.transform(scripts, objects)),
        lambda o: F.exists(
            F.coalesce(
                F.try_variant_get(o, "$['@type']", "array<string>"),
                F.array(F.try_variant_get(o, "$['@type']", "string")),
            ),
            lambda t: F.lower(t).isin(*_LD_TYPES),
        ),
    )

    def text(o: Column, path: str) -> Column:
        return F.nullif(norm_edges(F.try_variant_get(o, path, "string")), F.lit(""))

    def author(o: Column) -> Column:
        several = F.try_variant_get(o, "$.author", "array<variant>")

        def name(a: Column) -> Column:
            bare = F.when(F.schema_of_variant(a) == "STRING", F.try_variant_get(a, "$", "string"))
            return F.coalesce(F.try_variant_get(a, "$.name", "string"), bare)

        names = F.transform(several, name)
        plain = F.when(F.schema_of_variant(o).contains("author: STRING"), text(o, "$.author"))
        first_listed = F.get(F.filter(names, lambda n: n.isNotNull() & (n != "")), F.lit(0))
        return F.coalesce(text(o, "$.author.name"), F.nullif(norm_edges(first_listed), F.lit("")), plain)

    def first_of(pick) -> Column:
        return F.get(F.filter(F.transform(wanted, pick), lambda v: v.isNotNull()), F.lit(0))

    return F.struct(
        first_of(lambda o: F.coalesce(text(o, "$.headline"), text(o, "$.name"))).alias("title"),
        first_of(author).alias("author"),
        parse_any_date(first_of(lambda o: text(o, "$.datePublished"))).alias("published"),
        parse_any_date(first_of(lambda o: text(o, "$.dateModified"))).alias("modified"),
    )


def page_metadata(parsed: DataFrame, url: str = "url") -> DataFrame:
    """Ten metadata columns; each is a cascade JSON-LD, OpenGraph, meta tags, page tags."""
    h1 = _first(lambda e: e["tag"] == "h1")
    head = _first(lambda e: e["tag"] == "title")
    html = _first(lambda e: e["tag"] == "html")
    canonical = _first(lambda e: (e["tag"] == "link") & F.array_contains(F.split(_attr(e, "rel"), " "), "canonical"))
    author = F.coalesce(
        _meta("name", "author"), _meta("property", "article:author"),
        _meta("name", "dc.creator"), _meta("name", "dcterms.creator"),
    )
    published = F.coalesce(
        _meta("property", "article:published_time"), _meta("itemprop", "datePublished"),
        _meta("name", "date"), _meta("name", "dcterms.created"),
    )
    modified = F.coalesce(
        _meta("property", "article:modified_time"), _meta("itemprop", "dateModified"),
        _meta("name", "last-modified"), _meta("name", "dcterms.modified"),
    )
    host = ux.netloc(url)
    keep = [c for c in parsed.columns if c != "dom"]
    return parsed.withColumn("ld", jsonld_fields()).select(
        *keep,
        first_nonblank("ld.title", _meta("property", "og:title"), _text_of(h1), _text_of(head)).alias("title"),
        F.coalesce(_meta("property", "og:description"), _meta("name", "description")).alias("description"),
        F.coalesce(F.col("ld.author"), author).alias("author"),
        F.coalesce(F.col("ld.published"), parse_any_date(published)).alias("published"),
        F.coalesce(F.col("ld.modified"), parse_any_date(modified)).alias("modified"),
        first_nonblank(_attr(canonical, "href"), _meta("property", "og:url")).alias("canonical"),
        first_nonblank(_attr(html, "lang")).alias("lang"),
        first_nonblank(_meta("property", "og:site_name"), host).alias("site_name"),
        F.col(url).alias("source_url"),
        host.alias("source_domain"),
    )


def _followable(url: Column) -> Column:
    hrefs = F.transform(
        F.filter(F.col(_ELS), lambda e: (e["tag"] == "a") & _attr(e, "href").isNotNull()),
        lambda e: ux.url_resolve(_attr(e, "href"), url),
    )
    return F.filter(F.array_distinct(hrefs), lambda h: ux.same_site(url, h) & ~ux.url_blocked(h))


def outlinks(parsed: DataFrame, page_id: str = "page_id", url: str = "url", place: str | None = None) -> DataFrame:
    """Distinct same-site links of a page that a crawl may follow. De-duplicated inside the row.

    ``place`` names a column for a link's position in its page.
    """
    links = explode_rows(parsed, [page_id, url], _followable(F.col(url)), "n", "target")
    return links.withColumnRenamed("n", place) if place else links.drop("n")


def section_blocks(parsed: DataFrame) -> DataFrame:
    """Heading-driven sections: each h2/h3 owns the sibling content up to the next heading.

    The page's h1 comes first as ``Titre``; labels of linked PDF files come last as ``Documents``.
    """
    body = F.coalesce(
        _first(lambda e: e["tag"] == "main"),
        _first(lambda e: e["tag"] == "html"),
    )
    els = F.filter(F.col(_ELS), lambda e: _inside(e, F.col("scope")))
    content = ("p", "ul", "ol", "table", "blockquote", "div")

    def own_text(h: Column) -> Column:
        """Siblings up to the next heading among them, or to the end of their parent."""
        parent_end = F.coalesce(F.get(F.col(_ELS), h["up"])["last"], F.size(_ELS))
        stop = F.coalesce(h["stop"], parent_end + 1)
        after = F.slice(F.col(_ELS), h["last"] + 2, F.greatest(stop - h["last"] - 1, F.lit(0)))
        siblings = F.filter(after, lambda e: e["tag"].isin(*content) & (e["up"] == h["up"]))
        return F.array_join(F.filter(F.transform(siblings, _text_of), lambda t: t != ""), "\n")

    h1 = F.filter(els, lambda e: e["tag"] == "h1")
    head = F.transform(F.slice(h1, 1, 1), lambda e: F.struct(F.lit("Titre").alias("name"), _text_of(e).alias("text")))
    parts = F.transform(
        F.col("headings"), lambda h: F.struct(_text_of(h).alias("name"), own_text(h).alias("text"))
    )
    pdfs = F.filter(els, lambda e: (e["tag"] == "a") & _attr(e, "href").endswith(".pdf"))
    labels = F.transform(pdfs, lambda e: F.coalesce(F.nullif(_text_of(e), F.lit("")), F.trim(_attr(e, "href"))))
    docs = F.array(F.struct(F.lit("Documents").alias("name"), F.array_join(F.filter(labels, lambda t: t != ""), "\n").alias("text")))
    keep = [c for c in parsed.columns if c != "dom"]
    scoped = parsed.withColumn("scope", body).withColumn("headings", F.filter(els, lambda e: e["tag"].isin(*_SECTION_TAGS)))
    sections = F.filter(F.concat(head, parts, docs), lambda s: (s["name"] != "") & (s["text"] != ""))
    return explode_rows(scoped, keep, sections, "section_no", "s").select(*keep, "section_no", "s.name", "s.text")


def is_exam_page(url: Column | str) -> Column:
    """Pages whose layout is heading-driven: exam sheets of the laboratory catalogue."""
    return (ux.url_domain(url) == "lab-cerba.com") & ux.path(url).rlike(r"^/(fr|en)/examen/")


def chunks_web(blocks: DataFrame, title: Column, url: Column, file: Column, keep: tuple[Column, ...] = ()) -> DataFrame:
    """One chunk per non-blank block, with normalised title, source and original section position.

    Ids come from the full URL, as pages that differ in the query share a file name.
    """
    located = ux.url_abs_normalize(url, F.lit(None).cast("string"), file)
    text = norm_edges(F.col("text"))
    return (
        blocks.withColumn("loc", located)
        .where(text != "")
        .select(
            F.sha2(F.concat_ws("|", url, file, F.col("block_no").cast("string")), 256).alias("chunk_id"),
            F.lit("web").alias("source_type"),
            text.alias("text"),
            norm_for_eq(first_nonblank(title, default="Sans titre")).alias("title"),
            F.lit("page_web").alias("doc_type"),
            first_nonblank("loc.url", default="Source inconnue").alias("source"),
            F.col("block_no").alias("section_index"),
            F.nullif(F.col("loc.url"), F.lit("")).alias("url"),
            F.nullif(F.col("loc.domain"), F.lit("")).alias("domain"),
            file.alias("source_path"),
            *keep,
        )
    )
