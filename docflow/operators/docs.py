"""Guideline documents and plain texts to sections, sheets, packed passages and chunks.

Each document is one row, so all splitting happens inside the row with array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions.text import _col, first_nonblank, let, norm_edges
from docflow.runtime import explode_rows

# --- fixed value: heading that starts a guideline sheet ---
SHEET_HEADING = r"Fiche(?:\s+(?:Recommandation|arbre\s+décisionnel))?\s+0*\d{1,3}"
_SHEET = f"(?iuU){SHEET_HEADING}"


def _nonblank(parts: Column) -> Column:
    return F.filter(F.transform(parts, norm_edges), lambda p: p != "")


def heading_sections(df: DataFrame, lines: Column, is_heading) -> DataFrame:
    """``section_no, name, text``: every heading line owns the lines up to the next heading."""

    def cut(arr: Column) -> Column:
        numbered = F.transform(arr, lambda l, i: F.struct(l.alias("l"), i.alias("i")))
        heads = F.filter(numbered, lambda n: is_heading(n["l"]))

        def sections(hs: Column) -> Column:
            def section(h: Column, k: Column) -> Column:
                stop = F.coalesce(F.get(hs, k + 1)["i"], F.size(arr))
                body = F.slice(arr, h["i"] + 2, stop - h["i"] - 1)
                return F.struct(
                    h["l"].alias("name"),
                    F.array_join(F.filter(body, lambda b: F.trim(b) != ""), "\n").alias("text"),
                )

            return F.transform(hs, section)

        return let(heads, sections)

    keep = df.columns
    full = F.filter(let(lines, cut), lambda s: (s["name"] != "") & (s["text"] != ""))
    return explode_rows(df, keep, full, "section_no", "s").select(*keep, "section_no", "s.name", "s.text")


def pdf_text_sections(df: DataFrame, text: Column | str, split_over: int = 2000) -> DataFrame:
    """Blank-line blocks of extracted PDF text; over-long blocks are cut into sentences."""
    blocks = _nonblank(F.split(F.translate(_col(text), "\r", "\n"), "\n\n"))

    def words(b: Column) -> Column:
        return F.size(F.filter(F.split(b, r"(?U)\s+"), lambda w: w != ""))

    title = F.get(F.filter(F.slice(F.col("blocks"), 1, 5), lambda b: words(b).between(3, 20)), F.lit(0))

    def pieces(b: Column) -> Column:
        flat = norm_edges(F.translate(F.replace(b, F.lit("-\n"), F.lit("")), "\n", " "))
        return let(flat, lambda t: F.when(F.length(t) > split_over, _nonblank(F.split(t, r"\. "))).otherwise(F.array(t)))

    sections = F.filter(F.flatten(F.transform(F.col("blocks"), pieces)), lambda p: p != "")
    keep = df.columns
    head = [
        F.coalesce(title, F.lit("Titre non disponible")).alias("title"),
        F.sha2(_col(text), 256).alias("sha256"),
        F.octet_length(_col(text)).alias("n_bytes"),
    ]
    return explode_rows(df.withColumn("blocks", blocks), [*keep, *head], sections, "section_no", "text_part")


def split_fiches(df: DataFrame, text: Column | str, file: Column | str) -> DataFrame:
    """One row per guideline sheet; text before the first heading belongs to no sheet."""
    parts = F.split(_col(text), f"(?iuU)(?={SHEET_HEADING})")
    sheets = F.filter(parts, lambda p: p.rlike(f"^{_SHEET}"))
    number = F.regexp_extract("body", r"(?iuU)^Fiche(?:\s+(?:Recommandation|arbre\s+décisionnel))?\s+0*(\d{1,3})", 1)
    fiche_id = F.lpad(number, 3, "0")
    heading = F.regexp_extract("body", rf"{_SHEET}\s*[-:]?\s*(.+)", 1)
    keep = df.columns
    return (
        explode_rows(df, [*keep, _col(file).alias("source_doc")], sheets, "idx", "raw")
        .withColumn("body", norm_edges("raw"))
        .select(
            *keep, "source_doc", "idx",
            fiche_id.alias("fiche_id"),
            first_nonblank(heading, F.concat(F.lit("Fiche "), fiche_id)).alias("titre"),
            F.lit("recommendation_structured").alias("type_document"),
            F.col("body").alias("texte_complet"),
        )
    )


def paragraphs(text: Column | str) -> Column:
    return _nonblank(F.split(_col(text), "\n"))


def pack_1k(parts: Column, limit: int = 1000, compat: bool = False) -> Column:
    """Greedy packing of paragraphs into passages of at most ``limit`` characters.

    ``compat=True`` keeps the empty leading passage that appears when the first paragraph alone
    reaches the limit.
    """
    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"), F.lit(False).alias("open")
    )

    def step(s: Column, p: Column) -> Column:
        full = F.length(s["buf"]) + F.length(p) + 1 > limit
        closed = F.concat(s["done"], F.array(s["buf"]))
        done = F.when(full & (s["open"] | F.lit(compat)), closed).otherwise(s["done"])
        buf = F.when(full | (s["buf"] == ""), p).otherwise(F.concat(s["buf"], F.lit("\n"), p))
        return F.struct(done.alias("done"), buf.alias("buf"), F.lit(True).alias("open"))

    def finish(s: Column) -> Column:
        return F.when(s["buf"] != "", F.concat(s["done"], F.array(s["buf"]))).otherwise(s["done"])

    return F.aggregate(parts, start, step, finish)


def chunks_docx(fiches: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One chunk per sheet with text; ids are content-derived, so a rebuild gives the same ids."""
    text = norm_edges("texte_complet")
    title = first_nonblank("titre", default="Titre inconnu")
    source = first_nonblank("source_doc", default="source_docx_inconnue")
    return fiches.where(text != "").select(
        F.sha2(F.concat_ws("|", source, F.col("idx").cast("string")), 256).alias("chunk_id"),
        F.lit("docx").alias("source_type"),
        text.alias("text"),
        title.alias("title"),
        first_nonblank("type_document", default="document").alias("doc_type"),
        source.alias("source"),
        F.md5(F.concat(source, F.lit("|"), title)).alias("fiche_id"),
        F.lit(0).alias("section_index"),
        *keep,
    )


def sanitize_meta(meta: Column) -> Column:
    """Drop null and blank entries of a string map, trim the rest."""
    return F.map_filter(F.transform_values(meta, lambda k, v: norm_edges(v)), lambda k, v: v.isNotNull() & (v != ""))


def content_dedupe(df: DataFrame, content: Column | str, order: str) -> DataFrame:
    """First row of every distinct content plus its number of copies.

    Pre-aggregates on each partition before the shuffle, so a hot group of copies costs one
    partial row per task.
    """
    rows = df.withColumn("sha256", F.sha2(_col(content), 256))
    rest = [c for c in df.columns if c != order]
    best = F.min_by(F.struct(*rest), F.col(order)).alias("r") if rest else F.lit(0).alias("r")
    kept = rows.groupBy("sha256").agg(F.min(order).alias(order), best, F.count("*").alias("n_copies"))
    return kept.select(order, *[f"r.{c}" for c in rest], "sha256", "n_copies")
