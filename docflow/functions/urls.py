"""URL scalars as Column expressions. Components follow the generic grammar of RFC 3986."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docflow.functions.text import _col, let, norm_edges
from docflow.functions.wordlists import BINARY_EXTENSIONS, PDF_HOSTS

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?$"


def scheme(u: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(u), _PARTS, 1))


def netloc(u: Column | str) -> Column:
    return F.regexp_extract(_col(u), _PARTS, 2)


def path(u: Column | str) -> Column:
    return F.regexp_extract(_col(u), _PARTS, 3)


def query(u: Column | str) -> Column:
    return F.regexp_extract(_col(u), _PARTS, 4)


def defrag(u: Column | str) -> Column:
    return F.regexp_replace(_col(u), r"#[\s\S]*$", "")


def url_domain(u: Column | str) -> Column:
    """Lower-case host without a leading ``www.``."""
    return F.regexp_replace(F.lower(netloc(u)), r"^www\.", "")


def url_dedupe_key(u: Column | str) -> Column:
    return F.lower(F.regexp_replace(norm_edges(F.coalesce(_col(u), F.lit(""))), r"/+$", ""))


def is_http(u: Column | str) -> Column:
    return F.coalesce(_col(u).rlike(r"(?i)^https?://"), F.lit(False))


def _fold_dots(segments: Column) -> Column:
    """Apply ``.`` and ``..`` path segments left to right."""
    empty = F.array().cast("array<string>")
    return F.aggregate(
        segments,
        empty,
        lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(s == ".", done)
        .otherwise(F.concat(done, F.array(s))),
    )


def _parts(u: Column) -> Column:
    return F.struct(
        scheme(u).alias("scheme"), netloc(u).alias("netloc"), path(u).alias("path"), query(u).alias("query")
    )


def _question(q: Column) -> Column:
    return F.when(q == "", "").otherwise(F.concat(F.lit("?"), q))


def _merge_paths(base_path: Column, rel_path: Column) -> Column:
    """Relative path against the directory of the base path; empty inner segments vanish."""

    def drop_file(dirs: Column) -> Column:
        named = F.element_at(dirs, -1) != ""
        return F.when(named, F.slice(dirs, 1, F.size(dirs) - 1)).otherwise(dirs)

    def tidy(joined: Column) -> Column:
        inner = F.filter(F.slice(joined, 2, F.greatest(F.size(joined) - 2, F.lit(0))), lambda s: s != "")
        ends = F.concat(F.slice(joined, 1, 1), inner, F.slice(joined, -1, 1))
        return F.when(F.size(joined) < 2, joined).otherwise(ends)

    relative = let(F.concat(let(F.split(base_path, "/"), drop_file), F.split(rel_path, "/")), tidy)
    segments = F.when(rel_path.startswith("/"), F.split(rel_path, "/")).otherwise(relative)

    def finish(seg: Column) -> Column:
        closing = F.when(F.element_at(seg, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(
            F.array().cast("array<string>")
        )
        return F.array_join(F.concat(_fold_dots(seg), closing), "/")

    rooted = let(segments, finish)
    return let(rooted, lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)))


def url_join(base: Column | str, href: Column | str) -> Column:
    """Resolve a reference against a base URL the way browsers and ``urllib`` do."""
    base, href = _col(base), _col(href)

    def resolve(b: Column) -> Column:
        own = scheme(href)
        foreign = (own != "") & ((own != b["scheme"]) | (netloc(href) != ""))
        site = F.concat(b["scheme"], F.lit("://"), b["netloc"])

        def against(r: Column) -> Column:
            tail = F.concat(_question(r["query"]), F.regexp_extract(href, r"(#[\s\S]+)$", 1))
            same_query = F.when(r["query"] == "", b["query"]).otherwise(r["query"])
            same_page = F.concat(
                site, b["path"], _question(same_query), F.regexp_extract(href, r"(#[\s\S]+)$", 1)
            )
            return (
                F.when(r["netloc"] != "", F.concat(b["scheme"], F.lit(":"), href))
                .when(r["path"] == "", same_page)
                .otherwise(F.concat(site, _merge_paths(b["path"], r["path"]), tail))
            )

        rel = F.when(own != "", F.regexp_replace(href, r"^[^:]*:", "")).otherwise(href)
        return F.when(href == "", base).when(foreign, href).otherwise(let(_parts(rel), against))

    return let(_parts(base), resolve)


def url_resolve(href: Column | str, base: Column | str) -> Column:
    """Absolute URL without its fragment."""
    return defrag(url_join(base, href))


def url_blocked(href: Column | str) -> Column:
    """Links a crawl ignores: empty, non-web schemes, fragments and binary files."""
    href = F.coalesce(_col(href), F.lit(""))
    files = rf"(?i)\.({'|'.join(BINARY_EXTENSIONS)})(\?|$)"
    return (href == "") | href.rlike(r"^(mailto:|tel:|javascript:|#)") | href.rlike(files)


def same_site(a: Column | str, b: Column | str, exact: bool = False) -> Column:
    """Host equality without ``www.``; ``exact`` compares the raw host and lets host-less links pass."""
    if exact:
        return (netloc(a) == "") | (netloc(a) == netloc(b))
    return url_domain(a) == url_domain(b)


def is_pdf_url(u: Column | str) -> Column:
    return F.lower(F.split_part(_col(u), F.lit("?"), F.lit(1))).endswith(".pdf")


def pdf_allowed(u: Column | str, hosts: tuple[str, ...] = PDF_HOSTS) -> Column:
    return is_pdf_url(u) & url_domain(u).isin(*hosts)


def slug_title(u: Column | str, strip_number: bool = True) -> Column:
    """Readable title from the last path segment.

    ``strip_number`` drops a numeric suffix and skips navigation segments (the page-saving rule);
    without it only dashes are replaced (the context-label rule). Blank when there is none.
    """
    if strip_number:
        last = F.element_at(F.split(F.regexp_replace(path(u), r"/+$", ""), "/"), -1)
        seg = F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last)
        seg = F.trim(F.regexp_replace(F.regexp_replace(seg, r"-[0-9]+$", ""), r"[-_]+", " "))
        seg = F.when(F.lower(seg).isin("", "examen", "fr", "en"), "").otherwise(seg)
    else:
        seg = F.trim(F.translate(F.element_at(F.split(F.btrim(path(u), F.lit("/")), "/"), -1), "-", " "))
    return F.concat(F.upper(F.substring(seg, 1, 1)), F.substring(seg, 2, 1 << 30))


def url_to_filename(u: Column | str) -> Column:
    base = F.btrim(F.concat(netloc(u), path(u)), F.lit("/"))
    base = F.translate(F.regexp_replace(base, r"(?U)[^\w\-/.]+", "_"), "/", "_")
    return F.concat(F.when(base == "", "index").otherwise(base), F.lit(".json"))


def page_file_name(u: Column | str) -> Column:
    """Host plus path with underscores; two URLs that differ only in the query share it."""
    p = F.translate(F.regexp_replace(path(u), r"/+$", ""), "/", "_")
    return F.concat(netloc(u), F.when(p == "", "index").otherwise(p), F.lit(".json"))


def domain_from_filename(f: Column | str) -> Column:
    head = F.split_part(_col(f), F.lit("_"), F.lit(1))
    return F.when(head.contains("."), head)


def url_abs_normalize(raw: Column | str, base: Column | str, file: Column | str) -> Column:
    """``struct<url, domain>``: absolute, joined to the site base, or built from the file name."""
    raw = norm_edges(_col(raw))
    raw = F.when(raw.startswith("//"), F.concat(F.lit("https:"), raw)).otherwise(raw)
    base = norm_edges(F.coalesce(_col(base), F.lit("")))
    slim = F.regexp_replace(raw, r"^/+", "")
    from_base = url_join(F.concat(F.regexp_replace(base, r"/+$", ""), F.lit("/")), slim)
    host = domain_from_filename(file)
    from_file = F.concat(F.lit("https://"), host, F.lit("/"), slim)
    full = F.when(is_http(raw), raw).when(is_http(base), from_base).otherwise(from_file)
    full = F.when(raw != "", F.regexp_replace(defrag(full), r"/$", ""))
    return let(full, lambda u: F.struct(u.alias("url"), netloc(u).alias("domain")))
