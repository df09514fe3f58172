"""Care recommendations and personal plans for a whole table of person records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.operators import privacy, records, render
from docflow.operators import retrieval as rt
from docflow.runtime import grows, materialize


@dataclass(frozen=True)
class SafeRecords:
    """Pseudonymised texts and what is needed to restore answers."""

    texts: DataFrame  # doc_id, text
    mapping: DataFrame  # doc_id, mapping map<alias, original>
    rejects: DataFrame  # doc_id, reason of the records that could not be read


def safe_records(source: DataFrame, doc_id: str, json: str, salt: str, as_of_year: int,
                 pools: privacy.Pools = privacy.Pools()) -> SafeRecords:
    """Clean, pseudonymise, mask free text, render.

    The leaf table, the replacements and the masked leaves each feed several branches, so they are
    written once. Every record is in ``texts`` or in ``rejects``.
    """
    rejects = records.record_rejects(source, doc_id, json)
    leaves = materialize(records.clean_leaves(records.json_leaves(source, doc_id, json)), "leaves")
    changes = materialize(privacy.replacements(leaves, doc_id, salt, as_of_year, pools), "replacements")
    replaced = privacy.apply_replacements(leaves, changes, doc_id).unionByName(privacy.missing_defaults(leaves, doc_id))
    masked = materialize(privacy.mask_leaves(replaced, privacy.name_rules(changes, doc_id), doc_id), "masked")
    pairs = changes.where("mapped").select(doc_id, "alias", "original", F.lit(True).alias("field"))
    seen = privacy.seen_aliases(masked, doc_id).withColumn("field", F.lit(False))
    mapping = privacy.mapping_by_doc(pairs.unionByName(seen), doc_id)
    return SafeRecords(render.record_text(masked, doc_id), mapping, rejects)


def retrieve_context(chunks: DataFrame, queries: DataFrame, k_docx: int = rt.DOCX_K, k_web: int = rt.WEB_K,
                     gate: tuple[float, float, float] = (rt.MIN_SIMILARITY, rt.MIN_NOVELTY, rt.MAX_NOVELTY)) -> DataFrame:
    """``query_id, context`` for ``queries(query_id, vector)`` over
    ``chunks(chunk_id, source_type, vector, text, title, source)``."""
    found = rt.search_two_collections(chunks.select("chunk_id", "source_type", "vector"), queries, k_docx, k_web)
    hits = materialize(found.join(grows(chunks.select("chunk_id", "text", "title", "source")), "chunk_id"), "hits")
    web = grows(hits.where(F.col("source_type") == "web")).join(rt.novelty_of_hits(hits), ["query_id", "rank"])
    return rt.format_context(queries, rt.docx_blocks(hits), rt.web_blocks(rt.gate_web(web, k_web, *gate)), k_web)


def prompts(safe: SafeRecords, doc_id: str, requests: DataFrame, contexts: DataFrame | None, template: str, system: str) -> DataFrame:
    """Prompts of ``requests(query_id, user_input)``; without contexts this is the personal plan."""
    texts = safe.texts.select(F.col(doc_id).alias("query_id"), F.col("text").alias("record"))
    rows = requests.join(grows(texts), "query_id")
    empty = requests.select("query_id", F.lit("").alias("context"))
    return rt.prompt_table(rows, empty if contexts is None else contexts, template, system)


def restore_answers(answers: DataFrame, safe: SafeRecords, doc_id: str) -> DataFrame:
    """Complete answers ``query_id, answer, context`` with their sources and put the real names back."""
    full = answers.withColumn("answer", rt.sources_footer(F.col("answer"), F.col("context")))
    mapped = full.join(grows(safe.mapping.withColumnRenamed(doc_id, "query_id")), "query_id", "left")
    real = F.when(F.col("mapping").isNull(), F.col("answer")).otherwise(privacy.deanonymize(F.col("answer"), F.col("mapping")))
    return mapped.withColumn("answer", real).drop("mapping")
