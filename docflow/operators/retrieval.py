"""Passage retrieval for whole tables of queries: exact top-k, novelty gate, context formatting."""

from __future__ import annotations

import re
from dataclasses import dataclass

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions import urls as ux
from docflow.functions.text import cap_text, let, norm_edges, norm_space, shorten_ellipsis, strip_accents
from docflow.functions.wordlists import STOP_WORDS
from docflow.runtime import grows

DOCX_K, WEB_K, OVERFETCH = 5, 3, 3
MIN_SIMILARITY, MIN_NOVELTY, MAX_NOVELTY = 0.60, 0.30, 0.75


@dataclass(frozen=True)
class Caps:
    """Cuts of passages, of the joined reference text and of the vocabulary; None takes everything."""

    passage_chars: int | None = None
    reference_chars: int | None = None
    terms: int | None = None


WHOLE = Caps()
#: Fixed values of the cutting form.
COMPAT_CAPS = Caps(800, 12000, 12000)
NO_WEB = "Aucun lien web pertinent pour cette recherche."
_EPS = 1e-8
_CELLS = 4_000_000  # largest score matrix a task holds at once


class IndexNotReady(ValueError):
    """The stored vectors cannot serve the request."""


# ------------------------------------------------------------------ exact top-k

def _score(q: np.ndarray, v: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Distance and cosine similarity matrices (queries by rows)."""
    dots = q @ v.T
    qn, vn = np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)
    sims = dots / np.outer(qn + _EPS, vn + _EPS)
    if metric == "cosine":
        return 1.0 - sims, sims
    return np.maximum((qn**2)[:, None] + (vn**2)[None, :] - 2 * dots, 0.0), sims


def _best(ids, dist, sims, k: int):
    """Positions of the k smallest distances; equal distances are ordered by id."""
    if len(dist) > k:
        near = np.flatnonzero(dist <= np.partition(dist, k - 1)[k - 1])
    else:
        near = np.arange(len(dist))
    near = near[np.lexsort((ids[near], dist[near]))][:k]
    return ids[near], dist[near], sims[near]


class _TopK:
    """Running best rows per (query, group); memory is queries x groups x k."""

    def __init__(self, ks: dict[str, int], metric: str):
        self.ks, self.metric, self.best = ks, metric, {}

    def add(self, qids, q, ids, groups, v):
        for group in np.unique(groups):
            k = self.ks.get(group, 0)
            if k <= 0:
                continue
            at = np.flatnonzero(groups == group)
            step = max(1, _CELLS // len(at))
            for start in range(0, len(qids), step):
                dist, sims = _score(q[start : start + step], v[at], self.metric)
                for qid, d, s in zip(qids[start : start + step], dist, sims):
                    parts = (ids[at], d, s)
                    old = self.best.get((qid, group))
                    if old is not None:
                        parts = tuple(np.concatenate(p) for p in zip(old, parts))
                    self.best[(qid, group)] = _best(*parts, k)

    def frame(self) -> pd.DataFrame:
        rows = [
            (qid, group, i, float(d), float(s))
            for (qid, group), (ids, dist, sims) in self.best.items()
            for i, d, s in zip(ids, dist, sims)
        ]
        return pd.DataFrame(rows, columns=["query_id", "source_type", "chunk_id", "distance", "similarity"])


def _stack(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def search(
    corpus: DataFrame, queries: DataFrame, ks: dict[str, int], metric: str = "l2",
    broadcast_bytes: int = 64 << 20, block_bytes: int = 64 << 20,
) -> DataFrame:
    """Exact nearest chunks of every query in each collection.

    ``corpus(chunk_id, source_type, vector)``, ``queries(query_id, vector)``; ``ks`` gives the number
    of results per collection (0 skips it). Result: ``query_id, source_type, rank, chunk_id,
    distance, similarity``.

    A query table of checked size is shipped to every task and the corpus is never shuffled. A larger
    one meets the inverted lists that its bounds reach; by cosine, whose bounds don't hold for lists, it is cut
    into blocks that meet the corpus blocks pairwise. Each task returns only its own best k rows.
    """
    kept = corpus.where(F.col("source_type").isin(*[g for g, k in ks.items() if k > 0]))
    schema = (
        f"query_id {dict(queries.dtypes)['query_id']}, source_type string, "
        f"chunk_id {dict(corpus.dtypes)['chunk_id']}, distance double, similarity double"
    )
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    row_bytes = 8 * (size["dim"] or 1)
    if size["n"] * row_bytes <= broadcast_bytes:
        partial = _search_broadcast(kept, queries, ks, metric, schema)
    elif metric == "l2":
        from docflow.operators import lists  # which builds on this module

        return lists.search_lists(lists.build_index(kept), queries, ks)
    else:
        partial = _search_blocks(kept, queries, ks, metric, schema, max(1, block_bytes // row_bytes))
    best = Window.partitionBy("query_id", "source_type").orderBy("distance", "chunk_id")
    limit = F.create_map(*[x for g, k in ks.items() for x in (F.lit(g), F.lit(k))])
    ranked = partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max(ks.values()))
    return ranked.where(F.col("rank") <= limit[F.col("source_type")]).select(
        "query_id", "source_type", "rank", "chunk_id", "distance", "similarity"
    )


def _search_broadcast(corpus, queries, ks, metric, schema):
    local = queries.select("query_id", "vector").toPandas()
    if local.empty:
        return corpus.sparkSession.createDataFrame([], schema)
    shared = corpus.sparkSession.sparkContext.broadcast((local["query_id"].tolist(), _stack(local["vector"])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, q = shared.value
        top = _TopK(ks, metric)
        for b in batches:
            if len(b):
                top.add(qids, q, b["chunk_id"].to_numpy(), b["source_type"].to_numpy(dtype=str), _stack(b["vector"]))
        yield top.frame()

    return corpus.select("chunk_id", "source_type", "vector").mapInPandas(run, schema)


def _search_blocks(corpus, queries, ks, metric, schema, block_rows):
    n_query = -(-queries.count() // block_rows)
    n_corpus = max(1, -(-corpus.count() // block_rows))

    def spread(df, key, own, n_own, other, n_other):
        return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n_own))).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)).cast("array<bigint>"))
        )

    left = spread(queries.select("query_id", "vector"), "query_id", "qb", n_query, "cb", n_corpus)
    right = spread(corpus.select("chunk_id", "source_type", "vector"), "chunk_id", "cb", n_corpus, "qb", n_query)

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        top = _TopK(ks, metric)
        if len(q) and len(c):
            top.add(
                q["query_id"].tolist(), _stack(q["vector"]),
                c["chunk_id"].to_numpy(), c["source_type"].to_numpy(dtype=str), _stack(c["vector"]),
            )
        return top.frame()

    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(run, schema)


def search_two_collections(corpus: DataFrame, queries: DataFrame, k_docx: int = DOCX_K, k_web: int = WEB_K,
                           metric: str = "l2", overfetch: int = OVERFETCH) -> DataFrame:
    """Guideline passages plus ``overfetch`` times ``k_web`` web passages; ``k_web=0`` skips the web.

    A query whose gate runs out of candidates is told by ``short_of_web``.
    """
    return search(corpus, queries, {"docx": k_docx, "web": overfetch * k_web}, metric)


def short_of_web(hits: DataFrame, gated: DataFrame, k_web: int = WEB_K, overfetch: int = OVERFETCH) -> DataFrame:
    """``query_id, n_web``: queries that used up their over-fetched passages before ``k_web`` passed the gate."""
    fetched = hits.where(F.col("source_type") == "web").groupBy("query_id").agg(F.count("*").alias("fetched"))
    passed = gated.groupBy("query_id").agg(F.count("*").alias("n_web"))
    rows = fetched.where(F.col("fetched") >= overfetch * k_web).join(passed, "query_id", "left")
    return rows.select("query_id", F.coalesce("n_web", F.lit(0)).alias("n_web")).where(F.col("n_web") < k_web)


def cosine(a: Column, b: Column) -> Column:
    """Cosine with a small epsilon on both norms, computed in the JVM."""
    zero = F.lit(0.0)

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), zero, lambda s, t: s + t)

    return dot(a, b) / ((F.sqrt(dot(a, a)) + _EPS) * (F.sqrt(dot(b, b)) + _EPS))


def index_profile(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("source_type").agg(
        F.count("*").alias("n_chunks"),
        F.min(F.size("vector")).alias("min_dim"),
        F.max(F.size("vector")).alias("max_dim"),
    )


def check_index(corpus: DataFrame, collections: tuple[str, ...], dim: int) -> None:
    """Raise a clear error when a collection is missing or its vectors have another dimension."""
    found = {r["source_type"]: r for r in index_profile(corpus.where(F.col("source_type").isin(*collections))).collect()}
    for name in collections:
        row = found.get(name)
        if row is None:
            raise IndexNotReady(f"collection {name!r} is not available: run the indexing plan first")
        if (row["min_dim"], row["max_dim"]) != (dim, dim):
            raise IndexNotReady(
                f"collection {name!r} holds vectors of {row['min_dim']} to {row['max_dim']} dimensions, expected {dim}"
            )


# ------------------------------------------------------------------ novelty

def _terms(text: Column) -> Column:
    """Unigrams and bigrams after lower-casing, accent removal and stop-word removal."""
    plain = strip_accents(F.lower(text), "NFKD")
    words = F.filter(
        F.regexp_extract_all(plain, F.lit(r"(?U)(\b\w[\w’']+\b)"), 1), lambda w: ~w.isin(*STOP_WORDS)
    )

    def with_pairs(ws: Column) -> Column:
        n = F.greatest(F.size(ws) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(ws, 1, n), F.slice(ws, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.concat(ws, pairs)

    return let(words, with_pairs)


def tfidf_novelty(passages: DataFrame, max_terms: int | None = None) -> DataFrame:
    """``query_id, doc_no, novelty`` = 1 - cosine(reference, passage) in a per-query TF-IDF space.

    ``passages(query_id, doc_no, text)``: number 0 is the reference text, others are candidates. A
    query's corpus is its top hits, so the texts are hashed by query once and every later aggregation,
    ranking and norm runs inside that partitioning without another shuffle. All terms count unless
    ``max_terms`` keeps the most frequent ones (``COMPAT_CAPS`` has the values that cut).
    """
    by_query = Window.partitionBy("query_id")
    by_term = Window.partitionBy("query_id", "term")
    docs = passages.select("query_id", "doc_no", "text").repartition("query_id")
    docs = docs.withColumn("n_docs", F.count("*").over(by_query))
    counts = (
        docs.select("query_id", "doc_no", "n_docs", F.explode_outer(_terms(F.col("text"))).alias("term"))
        .groupBy("query_id", "n_docs", "doc_no", "term")
        .agg(F.count("term").alias("tf"))
    )
    weighed = (
        counts.withColumn("df", F.count("*").over(by_term))
        .withColumn("total", F.sum("tf").over(by_term))
        .withColumn("ref_tf", F.max(F.when(F.col("doc_no") == 0, F.col("tf"))).over(by_term))
    )
    idf = F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1
    used = F.col("term").isNotNull()
    if max_terms is not None:
        place = F.dense_rank().over(by_query.orderBy(F.desc("total"), F.asc_nulls_last("term")))
        weighed = weighed.withColumn("place", place)
        used = used & (F.col("place") <= max_terms)
    w = F.when(used, F.col("tf") * idf).otherwise(0.0)
    ref = F.when(used, F.coalesce("ref_tf", F.lit(0)) * idf).otherwise(0.0)
    sums = weighed.groupBy("query_id", "doc_no").agg(F.sqrt(F.sum(w * w)).alias("norm"), F.sum(w * ref).alias("dot"))
    ref_norm = F.max(F.when(F.col("doc_no") == 0, F.col("norm"))).over(by_query)
    cos = F.try_divide(F.col("dot"), F.col("norm") * ref_norm)
    return sums.withColumn("cos", cos).where(F.col("doc_no") > 0).select(
        "query_id", "doc_no", (1 - F.coalesce("cos", F.lit(0.0))).alias("novelty")
    )


def _cut(text: Column, chars: int | None) -> Column:
    return norm_space(text) if chars is None else cap_text(text, chars)


def novelty_of_hits(hits: DataFrame, caps: Caps = WHOLE) -> DataFrame:
    """Novelty of each web hit against the joined guideline hits of its query."""
    text = norm_edges(F.coalesce("text", F.lit("")))
    # the reference holds at most the guideline top-k of one query
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"])
    reference = (
        hits.where(F.col("source_type") == "docx")
        .groupBy("query_id")
        .agg(_cut(F.array_join(in_order, " "), caps.reference_chars).alias("text"))
        .select("query_id", F.lit(0).alias("doc_no"), "text")
    )
    web = hits.where((F.col("source_type") == "web") & (text != "")).select(
        "query_id", F.col("rank").alias("doc_no"), _cut(text, caps.passage_chars).alias("text")
    )
    return tfidf_novelty(reference.unionByName(web), caps.terms).withColumnRenamed("doc_no", "rank")


def gate_web(web: DataFrame, web_limit: int = WEB_K, min_similarity: float = MIN_SIMILARITY,
             min_novelty: float = MIN_NOVELTY, max_novelty: float = MAX_NOVELTY) -> DataFrame:
    """Similar and moderately novel hits, best one per URL, first ``web_limit`` per query as ``n``."""
    fit = web.where(
        (F.col("similarity") >= min_similarity) & F.col("novelty").between(min_novelty, max_novelty)
    ).withColumn("url_key", ux.url_dedupe_key("source"))
    best = [F.desc("similarity"), "rank"]
    same_url = F.row_number().over(Window.partitionBy("query_id", "url_key").orderBy(*best))
    once = fit.withColumn("u", same_url).where((F.col("u") == 1) | (F.col("url_key") == ""))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*best))
    return once.withColumn("n", place).where(F.col("n") <= web_limit).drop("u", "url_key")


# ------------------------------------------------------------------ context

def _excerpt(text: Column, chars: int | None) -> Column:
    return text if chars is None else shorten_ellipsis(text, chars)


def docx_blocks(hits: DataFrame, caps: Caps = WHOLE) -> DataFrame:
    """Formatted guideline passages; blank passages take no number."""
    text = _cut(norm_edges(F.coalesce("text", F.lit(""))), caps.passage_chars)
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Titre inconnu"))
    if "fiche_numero" in hits.columns:
        numbered = F.concat(F.lit("Fiche "), F.col("fiche_numero").cast("string"), F.lit(" — "), title)
        bare = F.col("fiche_numero").isNull() | F.lower(title).startswith("fiche")
        title = F.when(bare, title).otherwise(numbered)
    filled = hits.where((F.col("source_type") == "docx") & (text != ""))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    source = F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("Source inconnue"))
    block = F.concat(
        F.lit("[DOCX"), n.cast("string"), F.lit("] "), title, F.lit("\nsource: "), source,
        F.lit("\nextrait: "), _excerpt(text, caps.passage_chars),
    )
    return filled.select("query_id", F.lit(0).alias("part"), n.alias("n"), block.alias("block"))


def web_blocks(gated: DataFrame, caps: Caps = WHOLE) -> DataFrame:
    text = _cut(norm_edges("text"), caps.passage_chars)
    source = F.coalesce(F.trim("source"), F.lit(""))
    slug = F.nullif(ux.slug_title(source, strip_number=False), F.lit(""))
    host = F.nullif(ux.url_domain(source), F.lit(""))
    title = F.coalesce(
        F.nullif(F.trim("title"), F.lit("")), slug,
        F.concat(F.lit("[Titre indisponible] — "), host), F.lit("[Titre indisponible]"),
    )
    block = F.concat(
        F.lit("[WEB"), F.col("n").cast("string"), F.lit("] "), title,
        F.lit("\nsite: "), F.coalesce(host, F.lit("source_web_inconnue")),
        F.lit("\nurl: "), F.coalesce(F.nullif(source, F.lit("")), F.lit("[URL indisponible]")),
        F.lit("\nextrait: "), _excerpt(text, caps.passage_chars),
    )
    return gated.select("query_id", F.lit(1).alias("part"), "n", block.alias("block"))


def format_context(queries: DataFrame, docx: DataFrame, web: DataFrame, web_limit: int = WEB_K,
                   separator: str = "\n\n") -> DataFrame:
    """One context text per query: guideline blocks, then web blocks or the no-web notice."""
    blocks = docx.unionByName(web)
    # at most k_docx + web_limit blocks per query
    joined = blocks.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("part", "n", "block"))).alias("b"), F.max("part").alias("last_part")
    )
    notice = F.lit(f"[WEB_PERTINENCE] {NO_WEB}")
    text = F.array_join(F.transform("b", lambda x: x["block"]), separator)
    full = F.when(
        (F.coalesce("last_part", F.lit(0)) == 0) & F.lit(web_limit > 0),
        F.concat_ws(separator, F.nullif(text, F.lit("")), notice),
    ).otherwise(F.coalesce(text, F.lit("")))
    return queries.select("query_id").join(grows(joined), "query_id", "left").select("query_id", full.alias("context"))


# ------------------------------------------------------------------ prompts and answers

def prompt_table(requests: DataFrame, contexts: DataFrame, template: str, system: str) -> DataFrame:
    """Ready-to-send prompts. ``template`` uses ``{user_input}``, ``{record}`` and ``{context}``."""
    # the template is cut at its slots once, so text that looks like a slot is never filled
    parts = re.split(r"\{(user_input|record|context)\}", template)
    user = F.concat(*[F.coalesce(F.col(p), F.lit("")) if n % 2 else F.lit(p) for n, p in enumerate(parts)])
    joined = requests.join(grows(contexts), "query_id", "left")
    return joined.select(
        "query_id",
        F.sha2(F.concat_ws("|", F.col("query_id").cast("string"), F.lit(system), user), 256).alias("prompt_id"),
        F.lit(system).alias("system"),
        user.alias("user"),
        F.lit(2).alias("n_messages"),
        (F.length(user) + len(system)).alias("n_chars"),
    )


def attach_answers(prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers come from outside as ``(prompt_id, answer)``; missing ones are flagged."""
    return prompts.join(answers, "prompt_id", "left").withColumn("answered", F.col("answer").isNotNull())


def sources_footer(answer: Column, context: Column) -> Column:
    """Complete an answer: no-web sentence when web extracts went uncited, list of guideline titles."""
    has_web = context.rlike(r"(?m)^\[WEB\d+\]")
    cites_url = answer.rlike(r"https?://")
    lists_docx = answer.rlike(r"Fiche\s+\d+\s+—")
    note = F.when(has_web & ~cites_url & ~answer.contains(NO_WEB), F.lit("\n\n" + NO_WEB)).otherwise("")
    titles = F.regexp_extract_all(context, F.lit(r"(?m)^\[DOCX\d+\]\s+(.*)\nsource:"), 1)
    listed = F.array_join(F.transform(titles, lambda t: F.concat(F.lit("- "), t)), "\n")
    footer = F.when(
        ~lists_docx & (F.size(titles) > 0), F.concat(F.lit("\n\nSources utilisées :\n"), listed)
    ).otherwise("")
    return F.concat(answer, note, footer)
