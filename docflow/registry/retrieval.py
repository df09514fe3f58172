"""Search, novelty, gating, context and prompts.

The query vectors are the mean vectors of every document source, so the whole embedding table is read
on both sides.
"""

from pyspark.sql import functions as F

from docflow.functions.wordlists import STOP_WORDS
from docflow.operators import lists
from docflow.operators import retrieval as rt
from docflow.runtime import materialize
from docflow.registry.base import query, s_domain, s_list, s_space, table

# Test vectors are nearly orthogonal; these gate values keep part of the candidates.
MIN_SIM, MIN_NOV, MAX_NOV = 0.12, 0.30, 0.999


def corpus(spark, sf):
    kind = F.when(F.col("label") % 2 == 0, "docx").otherwise("web")
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), kind.alias("source_type"), F.col("embedding").alias("vector"))


def source_queries(spark, sf):
    """Mean vector per document source from exact integer sums (order-independent)."""
    e = table(spark, sf, "embeddings").join(
        table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "source"), "vec_id"
    )
    cells = e.select("source", F.posexplode("embedding").alias("p", "x"))
    sums = cells.groupBy("source", "p").agg(
        F.sum(F.floor(F.col("x").cast("double") * 1e6)).alias("s"), F.count("*").alias("n")
    )
    # one cell per vector dimension
    cell = F.struct("p", (F.col("s").cast("double") / F.col("n") / 1e6).alias("x"))
    return sums.groupBy(F.col("source").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["x"]).alias("vector")
    )


QUERIES_SQL = """SELECT query_id, list(x ORDER BY p) AS qv FROM (SELECT source AS query_id, p, sum(s)::DOUBLE / count(*) / 1e6 AS x
  FROM (SELECT source, unnest(range(len(embedding))) AS p, floor(unnest(embedding)::DOUBLE * 1e6)::BIGINT AS s
        FROM embeddings JOIN documents ON doc_id = vec_id) GROUP BY source, p) GROUP BY query_id"""
CORPUS_SQL = "SELECT vec_id AS chunk_id, CASE WHEN label % 2 = 0 THEN 'docx' ELSE 'web' END AS source_type, embedding::DOUBLE[] AS v FROM embeddings"
S_COS = "list_dot_product(qv, v) / ((sqrt(list_dot_product(qv, qv)) + 1e-8) * (sqrt(list_dot_product(v, v)) + 1e-8))"
S_L2 = "(list_dot_product(qv, qv) + list_dot_product(v, v) - 2 * list_dot_product(qv, v))"


def _s_search(limit, dist=S_L2, by=True):
    part = "query_id, source_type" if by else "query_id"
    return f"""SELECT * FROM (SELECT query_id, source_type, chunk_id, {dist} AS distance, {S_COS} AS similarity,
      row_number() OVER (PARTITION BY {part} ORDER BY {dist}, chunk_id) AS rank FROM ({QUERIES_SQL}) CROSS JOIN ({CORPUS_SQL})) WHERE {limit}"""


def _round(df):
    return df.withColumn("distance", F.round("distance", 6)).withColumn("similarity", F.round("similarity", 6))


def _s_round(sql):
    return f"SELECT query_id, source_type, rank, chunk_id, round(distance, 6) AS distance, round(similarity, 6) AS similarity FROM ({sql})"


@query("knn_topk", _s_round(_s_search("rank <= 10")))
def knn_topk(spark, sf):
    return _round(rt.search(corpus(spark, sf), source_queries(spark, sf), {"docx": 10, "web": 10}))


@query("knn_topk_cosine", _s_round(_s_search("rank <= 10", f"(1 - {S_COS})")))
def knn_topk_cosine(spark, sf):
    return _round(rt.search(corpus(spark, sf), source_queries(spark, sf), {"docx": 10, "web": 10}, metric="cosine"))


@query("knn_topk_blocks", _s_round(_s_search("rank <= 10")))
def knn_topk_blocks(spark, sf):
    """The route for query tables too large to ship to every task."""
    return _round(
        rt.search(corpus(spark, sf), source_queries(spark, sf), {"docx": 10, "web": 10}, broadcast_bytes=0, block_bytes=100_000)
    )


@query("knn_topk_lists", _s_round(_s_search("rank <= 10")))
def knn_topk_lists(spark, sf):
    """The same over inverted lists, whose bounds leave out lists that can't hold a better chunk."""
    index = lists.build_index(corpus(spark, sf), lists=16)
    return _round(lists.search_lists(index, source_queries(spark, sf), {"docx": 10, "web": 10}))


TWO_SQL = _s_search("rank <= CASE source_type WHEN 'docx' THEN 5 ELSE 9 END")


@query("two_collection_search", _s_round(TWO_SQL))
def two_collection_search(spark, sf):
    return _round(rt.search_two_collections(corpus(spark, sf), source_queries(spark, sf)))


@query(
    "query_cosine",
    f"""SELECT d.doc_id, q.query_id, round({S_COS}, 6) AS similarity FROM documents d JOIN ({QUERIES_SQL}) q ON q.query_id = d.source
       JOIN ({CORPUS_SQL}) e ON e.chunk_id = d.doc_id""",
)
def query_cosine(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("query_id"))
    q = source_queries(spark, sf).withColumnRenamed("vector", "qv")
    e = corpus(spark, sf).select(F.col("chunk_id").alias("doc_id"), "vector")
    return d.join(q, "query_id").join(e, "doc_id").select(
        "doc_id", "query_id", F.round(rt.cosine(F.col("qv"), F.col("vector")), 6).alias("similarity")
    )


def _meta(spark, sf):
    d = table(spark, sf, "documents")
    site = F.concat(F.lit("https://www."), F.col("lang"), F.lit(".example.org/"), F.col("source"), F.lit("/"))
    title = F.when(F.col("lang") != "de", F.concat(F.lit("Note "), F.col("doc_id").cast("string")))
    return d.select(F.col("doc_id").alias("chunk_id"), "text", title.alias("title"), site.alias("url"), "source")


def hits(spark, sf):
    """Top passages with text; texts are joined after the top-k, so only hits move."""
    found = rt.search_two_collections(corpus(spark, sf), source_queries(spark, sf))
    source = F.when(F.col("source_type") == "web", F.col("url")).otherwise(F.concat("source", F.lit(".docx")))
    return found.join(_meta(spark, sf), "chunk_id").withColumn("source", source).drop("url")


HITS_SQL = f"""SELECT h.*, text, CASE WHEN lang <> 'de' THEN 'Note ' || doc_id END AS title,
  CASE WHEN source_type = 'web' THEN 'https://www.' || lang || '.example.org/' || source || '/' ELSE source || '.docx' END AS source
  FROM ({TWO_SQL}) h JOIN documents d ON d.doc_id = h.chunk_id"""


def _s_novelty(passages):
    return f"""WITH passages AS ({passages}),
    sizes AS (SELECT query_id, count(*) AS n FROM passages GROUP BY query_id),
    words AS (SELECT query_id, doc_no, list_filter(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_’'']*[\\p{{L}}\\p{{N}}_]'),
        lambda w: w NOT IN ({s_list(STOP_WORDS)})) AS w FROM passages),
    terms AS (SELECT query_id, doc_no, unnest(w || list_transform(w[:-2], lambda x, i: x || ' ' || w[i + 1])) AS term FROM words),
    tf AS (SELECT query_id, doc_no, term, count(*) AS tf FROM terms GROUP BY ALL),
    dfs AS (SELECT query_id, term, count(*) AS df, row_number() OVER (PARTITION BY query_id ORDER BY sum(tf) DESC, term) AS r FROM tf GROUP BY query_id, term),
    w AS (SELECT tf.query_id, doc_no, tf.term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN dfs ON dfs.query_id = tf.query_id AND dfs.term = tf.term JOIN sizes ON sizes.query_id = tf.query_id),
    norms AS (SELECT query_id, doc_no, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
    dots AS (SELECT a.query_id, a.doc_no, sum(a.w * b.w) AS dot FROM w a JOIN w b ON a.query_id = b.query_id AND a.term = b.term AND b.doc_no = 0 GROUP BY ALL)
    SELECT p.query_id, p.doc_no, 1 - coalesce(dot / (norms.norm * z.norm), 0) AS novelty FROM passages p LEFT JOIN dots ON dots.query_id = p.query_id AND dots.doc_no = p.doc_no
    LEFT JOIN norms ON norms.query_id = p.query_id AND norms.doc_no = p.doc_no LEFT JOIN norms z ON z.query_id = p.query_id AND z.doc_no = 0 WHERE p.doc_no > 0"""


HIT_PASSAGES_SQL = f"""SELECT query_id, 0 AS doc_no, {s_space("string_agg(text, ' ' ORDER BY rank)")} AS text FROM ({HITS_SQL}) WHERE source_type = 'docx' GROUP BY query_id
  UNION ALL SELECT query_id, rank, {s_space('text')} FROM ({HITS_SQL}) WHERE source_type = 'web'"""
SCORED_SQL = f"SELECT h.*, v.novelty FROM ({HITS_SQL}) h JOIN ({_s_novelty(HIT_PASSAGES_SQL)}) v ON v.query_id = h.query_id AND v.doc_no = h.rank WHERE h.source_type = 'web'"


@query("tfidf_novelty", f"SELECT query_id, rank, chunk_id, round(novelty, 6) AS novelty FROM ({SCORED_SQL})")
def tfidf_novelty(spark, sf):
    """Novelty of every web hit against the guideline hits of its query."""
    found = hits(spark, sf)
    scored = rt.novelty_of_hits(found).join(found.where(F.col("source_type") == "web"), ["query_id", "rank"])
    return scored.select("query_id", "rank", "chunk_id", F.round("novelty", 6).alias("novelty"))


def _s_gate(lo_sim, lo, hi):
    return f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, rank) AS n FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, lower(rtrim(source, '/')) ORDER BY similarity DESC, rank) AS u FROM ({SCORED_SQL})
      WHERE similarity >= {lo_sim} AND novelty BETWEEN {lo} AND {hi}) WHERE u = 1 QUALIFY n <= 3"""


GATE_SQL = _s_gate(MIN_SIM, MIN_NOV, MAX_NOV)


def gated(spark, sf, found=None, limits=(MIN_SIM, MIN_NOV, MAX_NOV)):
    found = hits(spark, sf) if found is None else found
    web = found.where(F.col("source_type") == "web").join(rt.novelty_of_hits(found), ["query_id", "rank"])
    return rt.gate_web(web, 3, *limits)


@query(
    "gate_dedupe_topk",
    f"SELECT query_id, n, chunk_id, source, round(similarity, 6) AS similarity, round(novelty, 6) AS novelty FROM ({GATE_SQL})",
)
def gate_dedupe_topk(spark, sf):
    return gated(spark, sf).select(
        "query_id", "n", "chunk_id", "source", F.round("similarity", 6).alias("similarity"), F.round("novelty", 6).alias("novelty")
    )


def _s_context(gate):
    text = f"trim({s_space('text')})"
    return f"""WITH d AS (SELECT query_id, 0 AS part, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n, '[DOCX' || row_number() OVER (PARTITION BY query_id ORDER BY rank) || '] ' || coalesce(title, 'Titre inconnu') || chr(10) || 'source: ' || source || chr(10) || 'extrait: ' || {text} AS block
      FROM ({HITS_SQL}) WHERE source_type = 'docx'),
    g AS ({gate}),
    w AS (SELECT query_id, 1 AS part, n, '[WEB' || n || '] ' || coalesce(title, upper(split_part(source, '/', 4)[1]) || split_part(source, '/', 4)[2:]) || chr(10) || 'site: ' || {s_domain('source')} || chr(10)
      || 'url: ' || source || chr(10) || 'extrait: ' || {text} AS block FROM g)
    SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY part, n) || CASE WHEN max(part) = 0 THEN chr(10) || chr(10) || '[WEB_PERTINENCE] Aucun lien web pertinent pour cette recherche.' ELSE '' END AS context
    FROM (SELECT * FROM d UNION ALL SELECT * FROM w) GROUP BY query_id"""


CONTEXT_SQL = _s_context(GATE_SQL)


def contexts(spark, sf, limits=(MIN_SIM, MIN_NOV, MAX_NOV)):
    found = materialize(hits(spark, sf), "hits")  # read by four branches, searched once
    return rt.format_context(
        source_queries(spark, sf), rt.docx_blocks(found), rt.web_blocks(gated(spark, sf, found, limits))
    )


@query("format_context", CONTEXT_SQL)
def format_context(spark, sf):
    return contexts(spark, sf)


@query("no_web_fallback", _s_context(_s_gate(0.60, 0.30, 0.75)))
def no_web_fallback(spark, sf):
    """Default gate: no test vector is that similar, so every context ends with the notice."""
    return contexts(spark, sf, (rt.MIN_SIMILARITY, rt.MIN_NOVELTY, rt.MAX_NOVELTY))


@query(
    "index_guard",
    f"SELECT source_type, count(*) AS n_chunks, min(len(v))::INT AS min_dim, max(len(v))::INT AS max_dim FROM ({CORPUS_SQL}) GROUP BY source_type",
)
def index_guard(spark, sf):
    rows = corpus(spark, sf)
    rt.check_index(rows, ("docx", "web"), 64)
    return rt.index_profile(rows)


TEMPLATE = "Demande : {user_input}\nDossier :\n{record}\nExtraits :\n{context}"
SYSTEM = "Tu aides une équipe de soins."
S_USER = "'Demande : plan ' || source || chr(10) || 'Dossier :' || chr(10) || n || ' documents' || chr(10) || 'Extraits :' || chr(10) || context"
PROMPT_SQL = f"""SELECT query_id, sha256(query_id || '|{SYSTEM}|' || ({S_USER})) AS prompt_id, '{SYSTEM}' AS system, {S_USER} AS user, 2 AS n_messages,
  length({S_USER}) + {len(SYSTEM)} AS n_chars FROM ({CONTEXT_SQL}) c JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) s ON s.source = c.query_id"""


def prompts(spark, sf):
    requests = table(spark, sf, "documents").groupBy(F.col("source").alias("query_id")).agg(F.count("*").alias("n"))
    requests = requests.select(
        "query_id", F.concat(F.lit("plan "), F.col("query_id")).alias("user_input"),
        F.concat(F.col("n").cast("string"), F.lit(" documents")).alias("record"),
    )
    return rt.prompt_table(requests, contexts(spark, sf), TEMPLATE, SYSTEM)


@query("prompt_table", PROMPT_SQL)
def prompt_table(spark, sf):
    return prompts(spark, sf)


@query(
    "sources_footer",
    f"""SELECT conv_id, turn, text || CASE WHEN contains(context, '[WEB1]') AND NOT contains(text, 'http://') AND NOT contains(text, 'https://') THEN chr(10) || chr(10) || 'Aucun lien web pertinent pour cette recherche.' ELSE '' END
       || chr(10) || chr(10) || 'Sources utilisées :' || chr(10) || titles AS answer FROM conversations
       JOIN (SELECT query_id, context, (SELECT string_agg('- ' || coalesce(title, 'Titre inconnu'), chr(10) ORDER BY rank) FROM ({HITS_SQL}) h WHERE h.source_type = 'docx' AND h.query_id = c.query_id) AS titles FROM ({CONTEXT_SQL}) c)
       ON query_id = 'src' || (conv_id % 20) WHERE role = 'assistant'""",
)
def sources_footer(spark, sf):
    answers = table(spark, sf, "conversations").where(F.col("role") == "assistant")
    key = F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string"))
    joined = answers.withColumn("query_id", key).join(contexts(spark, sf), "query_id")
    return joined.select("conv_id", "turn", rt.sources_footer(F.col("text"), F.col("context")).alias("answer"))


@query(
    "llm_answers_import",
    """SELECT prompt_id, answer, answer IS NOT NULL AS answered FROM (SELECT conv_id || '/' || turn AS prompt_id, conv_id, turn FROM conversations WHERE role = 'user') u
       LEFT JOIN (SELECT conv_id, turn - 1 AS turn, text AS answer FROM conversations WHERE role = 'assistant') a ON a.conv_id = u.conv_id AND a.turn = u.turn""",
)
def llm_answers_import(spark, sf):
    c = table(spark, sf, "conversations")

    def key(turn):
        return F.concat(F.col("conv_id").cast("string"), F.lit("/"), turn.cast("string")).alias("prompt_id")

    asked = c.where(F.col("role") == "user").select(key(F.col("turn")))
    given = c.where(F.col("role") == "assistant").select(key(F.col("turn") - 1), F.col("text").alias("answer"))
    return rt.attach_answers(asked, given)
