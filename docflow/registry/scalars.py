"""Text, number, date and URL functions over the standard tables."""

from pyspark.sql import functions as F

from docflow.functions import text as tx
from docflow.functions import urls as ux
from docflow.functions.wordlists import PDF_HOSTS, TITLE_SMALL_WORDS
from docflow.registry.base import (
    query, s_domain, s_edges, s_irrelevant, s_list, s_part, s_space, table,
)


def _documents(spark, sf):
    return table(spark, sf, "documents", spread=True)


def _lines(df):
    return df.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


LINES_SQL = """SELECT doc_id, unnest(range(len(l)))::INT AS line_no, unnest(l) AS line
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"""


@query("norm_space", f"SELECT doc_id, {s_space('text')} AS norm FROM documents")
def norm_space(spark, sf):
    return _documents(spark, sf).select("doc_id", tx.norm_space("text").alias("norm"))


@query(
    "norm_for_eq",
    f"SELECT doc_id, replace(lower({s_space('nfc_normalize(text)')}), 'ß', 'ss') AS norm FROM documents",
)
def norm_for_eq(spark, sf):
    return _documents(spark, sf).select("doc_id", tx.norm_for_eq("text").alias("norm"))


@query("strip_accents", "SELECT doc_id, strip_accents(text) AS plain FROM documents")
def strip_accents(spark, sf):
    return _documents(spark, sf).select("doc_id", tx.strip_accents("text").alias("plain"))


S_INTENT = (
    "trim(regexp_replace(regexp_replace(strip_accents(replace(replace(replace(lower({0}),"
    " '’', ''''), '‘', ''''), '`', '''')), '[^a-z0-9'' ]', ' ', 'g'), ' +', ' ', 'g'))"
)


@query(
    "normalize_intent_text",
    f"SELECT conv_id, turn, {S_INTENT.format('text')} AS norm FROM conversations",
)
def normalize_intent_text(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", tx.normalize_intent_text("text").alias("norm")
    )


@query(
    "normalize_token",
    rf"""SELECT doc_id, trim(lower(strip_accents({s_edges('text')})), ' .,-_/\') AS token,
       trim(lower('  ' || upper(lang) || ' .-/'), ' .,-_/\') AS lang_token FROM documents""",
)
def normalize_token(spark, sf):
    return _documents(spark, sf).select(
        "doc_id",
        tx.normalize_token("text").alias("token"),
        tx.normalize_token(F.concat(F.lit("  "), F.upper("lang"), F.lit(" .-/"))).alias("lang_token"),
    )


@query(
    "norm_name_key",
    f"SELECT doc_id, replace(lower({s_space('strip_accents(text)')}), 'ß', 'ss') AS name_key FROM documents",
)
def norm_name_key(spark, sf):
    return _documents(spark, sf).select("doc_id", tx.norm_name_key("text").alias("name_key"))


def _s_shout(e):
    letters = rf"length(regexp_replace({e}, '\P{{L}}', '', 'g'))"
    upper = rf"length(regexp_replace({e}, '\P{{Lu}}', '', 'g'))"
    return f"({letters} >= 3 AND {upper} >= 0.8 * {letters})"


@query(
    "looks_shouting",
    f"""SELECT p_partkey, {_s_shout('p_type')} AS type_shouts, {_s_shout('p_name')} AS name_shouts,
       {_s_shout("p_brand || ' ' || upper(p_name)")} AS label_shouts FROM part""",
)
def looks_shouting(spark, sf):
    label = F.concat(F.col("p_brand"), F.lit(" "), F.upper("p_name"))
    return table(spark, sf, "part").select(
        "p_partkey",
        tx.looks_shouting("p_type").alias("type_shouts"),
        tx.looks_shouting("p_name").alias("name_shouts"),
        tx.looks_shouting(label).alias("label_shouts"),
    )


def _s_capital(w):
    # the first letter of a word beginning with ß becomes SS, as in Java and Python
    return f"(replace(upper({w}[1]), 'ẞ', 'SS') || lower({w}[2:]))"


def _s_title(e):
    w = "w"
    return (
        f"array_to_string(list_transform(string_split({e}, ' '), lambda w, i: CASE "
        f"WHEN regexp_full_match({w}, '[A-Z0-9]{{2,}}') THEN {w} "
        f"WHEN regexp_full_match({w}, '[dlDL][''’].+') THEN lower({w}[1]) || '’' || {_s_capital(w + '[3:]')} "
        f"WHEN lower({w}) IN ({s_list(TITLE_SMALL_WORDS)}) AND i > 1 THEN lower({w}) "
        f"ELSE {_s_capital(w)} END), ' ')"
    )


@query("smart_title_fr", f"SELECT doc_id, {_s_title(s_space('text'))} AS title FROM documents")
def smart_title_fr(spark, sf):
    return _documents(spark, sf).select(
        "doc_id", tx.smart_title_fr(tx.norm_space("text")).alias("title")
    )


@query(
    "norm_text",
    f"""SELECT doc_id, auto_text, keep_text, lower(keep_text) AS lower_text,
       replace(upper(keep_text), 'ẞ', 'SS') AS upper_text FROM (
       SELECT doc_id, {s_space('text')} AS keep_text,
       CASE WHEN {_s_shout('upper_lang')} THEN {_s_title('upper_lang')} ELSE upper_lang END AS auto_text
       FROM (SELECT doc_id, text, {s_space("'SOURCE DE ' || upper(lang) || '  ' || source")} AS upper_lang FROM documents))""",
)
def norm_text(spark, sf):
    label = F.concat(F.lit("SOURCE DE "), F.upper("lang"), F.lit("  "), F.col("source"))
    return _documents(spark, sf).select(
        "doc_id",
        tx.norm_text(label).alias("auto_text"),
        *[tx.norm_text("text", case_mode=m).alias(f"{m}_text") for m in ("keep", "lower", "upper")],
    )


@query(
    "norm_bool",
    """SELECT doc_id, CASE WHEN q = 'Vrai' OR q = 'OUI' THEN 'Oui' WHEN q = 'faux' THEN 'Non'
       WHEN q = '' THEN 'Non renseigné' ELSE q END AS answer FROM (SELECT doc_id,
       CASE WHEN quality = 1 AND toxic = 1 THEN 'OUI' WHEN quality = 1 THEN 'Vrai'
            WHEN toxic = 1 THEN '' WHEN doc_id % 2 = 0 THEN 'faux' ELSE 'peut-être' END AS q FROM labels)""",
)
def norm_bool(spark, sf):
    raw = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 1), " OUI ")
        .when(F.col("quality") == 1, "Vrai")
        .when(F.col("toxic") == 1, "")
        .when(F.col("doc_id") % 2 == 0, "faux")
        .otherwise("peut-être")
    )
    return table(spark, sf, "labels").select("doc_id", tx.norm_bool(raw).alias("answer"))


def _order_date_text():
    d = F.col("o_orderdate")
    return (
        F.when(F.col("o_orderstatus") == "F", F.date_format(d, "dd/MM/yyyy"))
        .when(F.col("o_orderpriority") == "1-URGENT", F.date_format(d, "dd/MM/yyyy HH:mm"))
        .when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("vers "), F.date_format(d, "yyyy")))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.lit(" "))
        .otherwise(F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
    )


S_ORDER_DATE_TEXT = """CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%d/%m/%Y')
  WHEN o_orderpriority = '1-URGENT' THEN strftime(o_orderdate, '%d/%m/%Y %H:%M')
  WHEN o_orderpriority = '5-LOW' THEN 'vers ' || strftime(o_orderdate, '%Y')
  WHEN o_orderpriority = '3-MEDIUM' THEN ' '
  ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END"""


@query(
    "norm_date",
    f"""SELECT o_orderkey, CASE WHEN trim(raw) = '' THEN 'Non renseigné' ELSE coalesce(strftime(coalesce(
       try_strptime(raw, '%Y-%m-%d %H:%M:%S'), try_strptime(raw, '%d/%m/%Y'),
       try_strptime(raw, '%d/%m/%Y %H:%M')), '%Y-%m-%d'), raw) END AS iso
       FROM (SELECT o_orderkey, {S_ORDER_DATE_TEXT} AS raw FROM orders)""",
)
def norm_date(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", tx.norm_date(_order_date_text()).alias("iso"))


@query(
    "norm_number",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN '≈ ' || p
       WHEN l_returnflag = 'A' THEN p ELSE CASE WHEN l_linestatus = 'O' THEN p ELSE 'Non renseigné' END END AS number
       FROM (SELECT *, l_extendedprice::DECIMAL(14,2)::VARCHAR AS p FROM lineitem)""",
)
def norm_number(spark, sf):
    price = F.col("l_extendedprice").cast("decimal(14,2)").cast("string")
    raw = (
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("≈  "), price))
        .when(F.col("l_returnflag") == "A", F.translate(price, ".", ","))
        .when(F.col("l_linestatus") == "O", price)
    )
    return table(spark, sf, "lineitem", spread=True).select(
        "l_orderkey", "l_linenumber", tx.norm_number(raw).alias("number")
    )


@query(
    "parse_any_date",
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'incident ' || user_id
       WHEN 'signup' THEN strftime(ts, '%Y-%m-%dT00:00:00') WHEN 'view' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+02:00')
       WHEN 'click' THEN strftime(ts, '%Y-%m-%dT%H:%M:00') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') END AS iso FROM events""",
)
def parse_any_date(spark, sf):
    ts, kind = F.col("ts"), F.col("event_type")
    raw = (
        F.when(kind == "error", F.concat(F.lit("incident "), F.col("user_id").cast("string")))
        .when(kind == "signup", F.date_format(ts, "d MMMM yyyy"))
        .when(kind == "view", F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0200")))
        .when(kind == "click", F.date_format(ts, "MM/dd/yyyy HH:mm"))
        .otherwise(F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("Z")))
    )
    return table(spark, sf, "events", spread=True).select("event_id", tx.parse_any_date(raw).alias("iso"))


@query(
    "first_nonblank",
    """SELECT event_id, coalesce(CASE WHEN (props->>'k')::INT < 50 THEN props->>'k' END,
       CASE WHEN event_type <> 'view' THEN event_type END, 'inconnu') AS picked FROM events""",
)
def first_nonblank(spark, sf):
    k = F.get_json_object("props", "$.k")
    small = F.when(k.cast("int") < 50, F.concat(F.lit(" "), k)).otherwise("  ")
    kind = F.when(F.col("event_type") != "view", F.col("event_type"))
    return table(spark, sf, "events").select(
        "event_id", tx.first_nonblank(small, kind, default="inconnu").alias("picked")
    )


@query(
    "join_nonblank",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 AND c_mktsegment = 'MACHINERY' THEN 'Non renseigné'
       ELSE concat_ws(', ', CASE WHEN c_acctbal >= 0 THEN c_name END,
       CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment[1] || lower(c_mktsegment[2:]) END) END AS joined FROM customer""",
)
def join_nonblank(spark, sf):
    parts = F.array(
        tx.norm_text(F.when(F.col("c_acctbal") >= 0, F.col("c_name"))),
        tx.norm_text(
            F.when(F.col("c_mktsegment") != "MACHINERY", F.lower("c_mktsegment")), case_mode="title"
        ),
    )
    return table(spark, sf, "customer").select("c_custkey", tx.join_nonblank(parts).alias("joined"))


@query("cap_text", f"SELECT doc_id, left({s_space('text')}, 800) AS capped FROM documents")
def cap_text(spark, sf):
    return _documents(spark, sf).select("doc_id", tx.cap_text("text", 800).alias("capped"))


def _s_shorten(e, n):
    head = f"left({e}, {n - 1})"
    back = f"strpos(reverse({head}), ' ')"
    cut = (
        f"CASE WHEN {back} = 0 OR length({head}) - {back} < {int(0.6 * n)} THEN {n - 1} "
        f"ELSE length({head}) - {back} END"
    )
    return f"CASE WHEN length({e}) <= {n} THEN {e} ELSE rtrim(left({e}, {cut})) || '…' END"


@query(
    "shorten_ellipsis",
    f"""SELECT doc_id, {_s_shorten('t', 800)} AS short_800, {_s_shorten('t', 40)} AS short_40
       FROM (SELECT doc_id, {s_space('text')} AS t FROM documents)""",
)
def shorten_ellipsis(spark, sf):
    return _documents(spark, sf).select(
        "doc_id",
        tx.shorten_ellipsis("text", 800).alias("short_800"),
        tx.shorten_ellipsis("text", 40).alias("short_40"),
    )


@query(
    "is_irrelevant_text",
    f"SELECT doc_id, line_no, {s_irrelevant('line')} AS noise FROM ({LINES_SQL})",
)
def is_irrelevant_text(spark, sf):
    return _lines(_documents(spark, sf)).select(
        "doc_id", "line_no", tx.is_irrelevant_text("line").alias("noise")
    )


@query(
    "validate_patient_name",
    """SELECT p_partkey, CASE WHEN strpos(trim(answer), ' ') = 0 THEN upper(trim(answer)[1]) || lower(trim(answer)[2:]) END AS name
       FROM (SELECT p_partkey, CASE WHEN p_size < 10 THEN p_name WHEN p_size < 20 THEN 'Nom patient introuvable' ELSE ' ' || p_type END AS answer FROM part)""",
)
def validate_patient_name(spark, sf):
    answer = (
        F.when(F.col("p_size") < 10, F.col("p_name"))
        .when(F.col("p_size") < 20, "Nom patient introuvable")
        .otherwise(F.concat(F.lit(" "), F.col("p_type")))
    )
    return table(spark, sf, "part").select(
        "p_partkey", tx.validate_patient_name(answer).alias("name")
    )


@query(
    "patient_key",
    """SELECT p_partkey, CASE WHEN p_size < 5 THEN 'UNKNOWN' ELSE replace(upper(p_name), ' ', '_') END AS name_key,
       CASE WHEN p_size < 25 THEN p_brand || '.v' || p_size ELSE replace(upper(p_name), ' ', '_') END AS file_key FROM part""",
)
def patient_key(spark, sf):
    name = F.when(F.col("p_size") >= 5, F.replace("p_name", F.lit(" "), F.lit(" \t")))
    path = F.when(
        F.col("p_size") < 25,
        F.concat(F.lit("/dossiers/"), F.col("p_brand"), F.lit(".v"), F.col("p_size").cast("string"), F.lit(".json")),
    )
    return table(spark, sf, "part").select(
        "p_partkey",
        tx.patient_key(name).alias("name_key"),
        tx.patient_key(F.col("p_name"), path).alias("file_key"),
    )


# ---------------------------------------------------------------- URLs

def _pages(spark, sf):
    return table(spark, sf, "pages")


def _hrefs(spark, sf):
    return _pages(spark, sf).select(
        "page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("n", "href")
    )


HREFS_SQL = """SELECT page_id, url, unnest(range(len(l)))::INT AS n, unnest(l) AS href
FROM (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages)"""


@query("url_domain", f"SELECT page_id, {s_domain('url')} AS domain FROM pages")
def url_domain(spark, sf):
    return _pages(spark, sf).select("page_id", ux.url_domain("url").alias("domain"))


@query(
    "url_abs_normalize",
    rf"""SELECT page_id, shape, rtrim_one AS url, {s_part('rtrim_one', 2)} AS domain FROM (
     SELECT page_id, shape, regexp_replace(regexp_replace(u, '#.*$', ''), '/$', '') AS rtrim_one FROM (
       SELECT page_id, 'absolute' AS shape, url AS u FROM pages
       UNION ALL SELECT page_id, 'scheme_less', 'https:' || regexp_replace(url, '^https?:', '') FROM pages
       UNION ALL SELECT page_id, 'relative', {s_part('url', 1)} || '://' || {s_part('url', 2)} || {s_part('url', 3)} FROM pages
       UNION ALL SELECT page_id, 'from_file', 'https://' || {s_part('url', 2)} || {s_part('url', 3)} FROM pages))""",
)
def url_abs_normalize(spark, sf):
    site = F.concat(ux.scheme("url"), F.lit("://"), ux.netloc("url"))

    def shape(name, raw, base=None):
        base = F.lit(None).cast("string") if base is None else base
        return F.struct(F.lit(name).alias("shape"), raw.alias("raw"), base.alias("base"))

    shapes = F.array(
        shape("absolute", F.concat(F.lit(" "), F.col("url"))),
        shape("scheme_less", F.regexp_replace("url", "^https?:", "")),
        shape("relative", ux.path("url"), F.concat(site, F.lit("/"))),
        shape("from_file", ux.path("url")),
    )
    rows = _pages(spark, sf).select("page_id", "url", F.inline(shapes))
    made = ux.url_abs_normalize("raw", "base", ux.page_file_name("url"))
    return rows.select("page_id", "shape", made.alias("m")).select("page_id", "shape", "m.url", "m.domain")


@query("url_dedupe_key", "SELECT page_id, lower(rtrim(trim(url), '/')) AS dedupe_key FROM pages")
def url_dedupe_key(spark, sf):
    return _pages(spark, sf).select("page_id", ux.url_dedupe_key("url").alias("dedupe_key"))


@query(
    "url_resolve",
    f"""SELECT page_id, n, {s_part('url', 1)} || '://' || {s_part('url', 2)} || regexp_replace(href, '#.*$', '') AS target,
     {s_part('url', 1)} || '://' || {s_part('url', 2)} || regexp_replace({s_part('url', 3)}, '[^/]*$', '') || substr(regexp_replace(href, '#.*$', ''), 2) AS sibling,
     {s_part('url', 1)} || '://' || {s_part('url', 2)} || {s_part('url', 3)} || '?p=' || n AS queried
     FROM ({HREFS_SQL})""",
)
def url_resolve(spark, sf):
    sibling = F.concat(F.lit("./x/../"), F.substring("href", 2, 1 << 30))
    queried = F.concat(F.lit("?p="), F.col("n").cast("string"), F.lit("#frag"))
    return _hrefs(spark, sf).select(
        "page_id", "n",
        ux.url_resolve("href", "url").alias("target"),
        ux.url_resolve(sibling, "url").alias("sibling"),
        ux.url_resolve(queried, "url").alias("queried"),
    )


@query(
    "url_blocked",
    f"""SELECT page_id, n, href = '' OR href[1] = '#' AS plain, TRUE AS mail, n % 2 = 0 AS file
     FROM ({HREFS_SQL})""",
)
def url_blocked(spark, sf):
    even = F.col("n") % 2 == 0
    file = F.concat(F.col("href"), F.when(even, ".PNG?size=1").otherwise(".pngx"))
    return _hrefs(spark, sf).select(
        "page_id", "n",
        ux.url_blocked("href").alias("plain"),
        ux.url_blocked(F.concat(F.lit("mailto:"), F.col("href"))).alias("mail"),
        ux.url_blocked(file).alias("file"),
    )


@query(
    "same_site",
    f"""SELECT page_id, TRUE AS loose_own, starts_with({s_part('url', 2)}, 'www.') = FALSE AS exact_bare,
     TRUE AS exact_relative, FALSE AS loose_other FROM pages""",
)
def same_site(spark, sf):
    bare = F.concat(F.lit("https://"), ux.url_domain("url"), F.lit("/x"))
    other = F.concat(F.lit("https://other."), ux.url_domain("url"))
    return _pages(spark, sf).select(
        "page_id",
        ux.same_site("url", bare).alias("loose_own"),
        ux.same_site("url", bare, exact=True).alias("exact_bare"),
        ux.same_site(F.lit("/relative"), F.col("url"), exact=True).alias("exact_relative"),
        ux.same_site("url", other).alias("loose_other"),
    )


@query(
    "pdf_allowed",
    f"""SELECT page_id, host, variant, variant <> 'html' AND host <> 'x' AS allowed FROM pages,
     (SELECT unnest([{s_list(sorted(PDF_HOSTS)[:3])}, 'x']) AS host), (SELECT unnest(['pdf', 'PDF?v', 'html']) AS variant)""",
)
def pdf_allowed(spark, sf):
    hosts = F.explode(F.array(*[F.lit(h) for h in sorted(PDF_HOSTS)[:3] + ["x"]])).alias("host")
    rows = _pages(spark, sf).select("page_id", "url", hosts)
    rows = rows.select("*", F.explode(F.array(F.lit("pdf"), F.lit("PDF?v"), F.lit("html"))).alias("variant"))
    url = F.concat(F.lit("https://www."), F.col("host"), ux.path("url"), F.lit("."), F.col("variant"))
    return rows.select("page_id", "host", "variant", ux.pdf_allowed(url).alias("allowed"))


def _s_slug(p):
    seg = rf"trim(regexp_replace(regexp_replace(url_decode(list_last(string_split(rtrim({p}, '/'), '/'))), '-[0-9]+$', ''), '[-_]+', ' ', 'g'))"
    return f"CASE WHEN lower({seg}) IN ('', 'examen', 'fr', 'en') THEN '' ELSE upper({seg}[1]) || {seg}[2:] END"


@query(
    "slug_title",
    f"""SELECT page_id, {_s_slug(s_part('url', 3))} AS title, {_s_slug(s_part('url', 3) + " || '/l%C3%A9-bilan_sanguin-12'")} AS long_title,
     'Bilan sanguin 12' AS label FROM pages""",
)
def slug_title(spark, sf):
    long = F.concat(ux.defrag(F.split_part("url", F.lit("?"), F.lit(1))), F.lit("/l%C3%A9-bilan_sanguin-12"))
    label = F.concat(ux.defrag(F.split_part("url", F.lit("?"), F.lit(1))), F.lit("/bilan-sanguin-12/"))
    return _pages(spark, sf).select(
        "page_id",
        ux.slug_title("url").alias("title"),
        ux.slug_title(long).alias("long_title"),
        ux.slug_title(label, strip_number=False).alias("label"),
    )


@query(
    "url_to_filename",
    rf"""SELECT page_id, replace(regexp_replace(trim({s_part('url', 2)} || {s_part('url', 3)}, '/'), '[^\p{{L}}\p{{N}}_\-/.]+', '_', 'g'), '/', '_') || '.json' AS file_name FROM pages""",
)
def url_to_filename(spark, sf):
    return _pages(spark, sf).select("page_id", ux.url_to_filename("url").alias("file_name"))


@query("domain_from_filename", f"SELECT page_id, {s_part('url', 2)} AS domain, NULL::VARCHAR AS plain FROM pages")
def domain_from_filename(spark, sf):
    return _pages(spark, sf).select(
        "page_id",
        ux.domain_from_filename(ux.page_file_name("url")).alias("domain"),
        ux.domain_from_filename(F.concat(F.lit("fiche_"), F.col("page_id").cast("string"))).alias("plain"),
    )
