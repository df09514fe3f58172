"""Index statistics and audits: single-pass aggregations with map-side combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions import urls as ux
from docflow.functions.text import first_nonblank


def _have(df: DataFrame, *names: str) -> list[Column]:
    found = [F.col(n) for n in names if n in df.columns]
    return found or [F.lit(None).cast("string")]


def _http(x: Column) -> Column:
    return F.when(F.lower(F.trim(x)).startswith("http"), F.trim(x))


def index_stats(chunks: DataFrame, approx: bool = False) -> DataFrame:
    """Per collection: chunks, distinct web pages, web domains, source files and sheets."""
    url = F.coalesce(_http(first_nonblank(*_have(chunks, "url", "source_url"))), _http(*_have(chunks, "source")))
    links = [_http(c) for c in _have(chunks, "url", "source_url", "source")]
    domain = first_nonblank(*_have(chunks, "domain"), ux.netloc(F.coalesce(*links)))
    files = [F.when(_http(c).isNull(), c) for c in _have(chunks, "source_group", "source_doc", "source")]
    fiche = first_nonblank(*_have(chunks, "fiche_id", "source_path", "source_basename"))
    distinct = F.approx_count_distinct if approx else F.countDistinct
    web, docx = F.col("source_type") == "web", F.col("source_type") == "docx"
    return chunks.groupBy("source_type").agg(
        F.count("*").alias("n_chunks"),
        distinct(F.when(web, url)).alias("n_pages"),
        distinct(F.when(web, domain)).alias("n_domains"),
        distinct(F.when(docx, first_nonblank(*files))).alias("n_files"),
        distinct(F.when(docx, fiche)).alias("n_fiches"),
    )


def key_presence(df: DataFrame, keys: list[str], order: str, first: int | None = None) -> DataFrame:
    """``key, n_present`` over the whole table, or over the ``first`` rows in id order."""
    rows = df if first is None else df.orderBy(order).limit(first)

    def blank(k: str) -> Column:
        return F.coalesce(F.trim(F.col(k).cast("string")), F.lit("")) == ""

    empty = F.lit(True)
    for k in keys:
        empty = empty & blank(k)
    wide = rows.agg(*[F.count_if(~blank(k)).alias(k) for k in keys], F.count_if(empty).alias("__empty__"))
    return wide.unpivot([], [*keys, "__empty__"], "key", "n_present")


def section_audit(docs: DataFrame, doc_id: str, sections: Column, n_examples: int = 5) -> DataFrame:
    """One row: documents in total, with text, only blank sections, none; filled sections; examples."""
    filled = F.size(F.filter(sections, lambda s: F.trim(s) != ""))
    rows = docs.select(doc_id, F.size(sections).alias("n"), filled.alias("n_filled"))
    totals = rows.agg(
        F.count("*").alias("n_docs"),
        F.count_if(F.col("n_filled") > 0).alias("with_sections"),
        F.count_if((F.col("n") > 0) & (F.col("n_filled") == 0)).alias("only_empty"),
        F.count_if(F.col("n") <= 0).alias("without_sections"),
        F.sum("n_filled").alias("n_filled_sections"),
    )
    top = rows.where(F.col("n_filled") > 0).orderBy(doc_id).limit(n_examples)
    shown = top.agg(F.array_join(F.array_sort(F.collect_list(doc_id)), ",").alias("examples"))
    return totals.crossJoin(shown)
