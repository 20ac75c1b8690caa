"""All core queries by name, with the SQL that DuckDB answers alike. Every query runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexspark.functions import answers as A
from lexspark.functions import text as X
from lexspark.functions import urls as U
from lexspark.operators import answering as G
from lexspark.operators import chunking as C
from lexspark.operators import evidence as E
from lexspark.operators import history
from lexspark.operators import retrieval as R
from lexspark.operators import selection as S
from lexspark.operators import versioning as V
from lexspark.runtime import table
from lexspark.sources import html as H

QUERIES: dict = {"p6_found": history.p6_found}
SQL: dict[str, str] = {"p6_found": history.P6_SQL}
PREFIX = "afa:lsid:"


def query(sql: str | None = None):
    """Registers a function as a query under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    from lexspark.plans import text_queries  # noqa: F401 - registers its queries

    return dict(QUERIES)


def oracle_sql() -> dict:
    queries()
    return dict(SQL)


def _current(spark: SparkSession, d: str, vectors: bool = False) -> DataFrame:
    return R.current_chunks(table(spark, d, "law_chunks"), table(spark, d, "law_versions"), table(spark, d, "laws"), vectors)


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The evaluation cases as queries, each text once under its smallest id."""
    return table(spark, d, "eval_cases").where("query is not null").groupBy("query").agg(F.min("case_id").alias("query_id")).select("query_id", "query")


_INDEXES: dict[tuple, R.Index] = {}


def _index(spark: SparkSession, d: str, embed=None, postings: bool = True) -> R.Index:
    """The index of a data directory's current provisions: built by the first search of a session, read by all of them.

    Another index is built when the files of its tables change.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    state = []
    for name in ("law_chunks", "law_versions", "laws"):
        at = hadoop.Path(f"{d}/{name}.parquet")
        system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        whole, file = system.getContentSummary(at), system.getFileStatus(at)
        state.append((whole.getLength(), whole.getFileCount(), file.getModificationTime()))
    key = (spark.sparkContext.applicationId, d, embed, postings, *state)
    if key not in _INDEXES:
        _INDEXES[key] = R.build_index(_current(spark, d), embed=embed, postings=postings)
    return _INDEXES[key]


def _laws(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "laws").dropDuplicates(["law_id"]).withColumn("title", F.regexp_replace("title", r"(?U)^\s+|\s+$", ""))


def _versions(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "law_versions").select("version_id", *cols).dropDuplicates(["version_id"])


_WS = r"\s\x{3000}\x{00A0}\x{2002}\x{2009}\x{202F}"
_CUR = rf"""
v AS (SELECT DISTINCT version_id, law_id, version_no, metadata_json FROM law_versions),
nv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY law_id ORDER BY version_no DESC, version_id DESC) r FROM v) WHERE r = 1),
l AS (SELECT DISTINCT law_id, source_key, regexp_replace(title, '^[{_WS}]+|[{_WS}]+$', '', 'g') AS law_title, category, source_url FROM laws),
c AS (SELECT DISTINCT chunk_id, version_id, seq, article_label, heading, content FROM law_chunks),
cur AS (SELECT c.*, nv.law_id, nv.version_no, nv.metadata_json, l.law_title, l.category, l.source_url FROM c JOIN nv USING (version_id) JOIN l USING (law_id))
"""
_Q = "q AS (SELECT min(case_id) AS query_id, query FROM eval_cases WHERE query IS NOT NULL GROUP BY query)"


def _sq(x: str) -> str:
    return f"regexp_replace({x}, '[{_WS}]+', '', 'g')"


def _any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


# ---- projections and filters


@query(
    "SELECT law_id, version_id, CAST(version_no AS BIGINT) AS version_no, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY law_id ORDER BY version_no DESC, version_id DESC) r FROM (SELECT DISTINCT law_id, version_id, version_no, content_hash FROM law_versions)) WHERE r = 1"
)
def scan_current_versions(spark, d):
    v = V.derive_current(_versions(spark, d, "law_id", "version_no", "content_hash"))
    return v.where("is_current").select("law_id", "version_id", F.col("version_no").cast("long").alias("version_no"), "content_hash")


@query(
    f"WITH {_CUR} SELECT chunk_id, law_id, law_title, CAST(version_no AS BIGINT) AS version_no, article_label, heading, CAST(length(content) AS BIGINT) AS n_chars, source_url, CASE WHEN category = '消防署函釋' THEN 'nfa_interpretation' ELSE 'law' END AS source_type FROM cur"
)
def project_hits_case(spark, d):
    return _current(spark, d).select("chunk_id", "law_id", "law_title", F.col("version_no").cast("long").alias("version_no"), "article_label", "heading", F.length("content").cast("long").alias("n_chars"), "source_url", R.source_type(F.col("category")).alias("source_type"))


@query(f"WITH {_CUR} SELECT DISTINCT law_id, law_title FROM l WHERE contains(lower(law_title), lower('滅焰毯')) OR law_title = '屋頂溫室加壓泵組認可準則'")
def title_filter_ilike(spark, d):
    t = _laws(spark, d)
    return t.where(F.contains(F.lower("title"), F.lower(F.lit("滅焰毯"))) | (F.col("title") == "屋頂溫室加壓泵組認可準則")).select("law_id", F.col("title").alias("law_title"))


@query(f"WITH {_CUR} SELECT chunk_id, heading FROM cur WHERE contains(heading, '第二章')")
def heading_contains(spark, d):
    return _current(spark, d).where(F.contains("heading", F.lit("第二章"))).select("chunk_id", "heading")


@query(
    rf"""WITH t AS (SELECT DISTINCT version_id, raw_text FROM law_versions WHERE raw_text IS NOT NULL),
s AS (SELECT version_id, unnest(string_split_regex(regexp_replace(raw_text, '[\x{{3000}}\x{{00A0}}]', ' ', 'g'), '\r\n|[\n\r]')) AS x FROM t),
k AS (SELECT version_id, regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '^[{_WS}]+|[{_WS}]+$', '', 'g') AS x FROM s)
SELECT version_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(length(x)) AS BIGINT) AS n_chars FROM k WHERE x <> '' AND NOT regexp_matches(x, '{X.NOISE}') GROUP BY 1"""
)
def noise_line_filter(spark, d):
    ln = C.lines(_versions(spark, d, "raw_text"), "version_id", "raw_text")
    return ln.groupBy(F.col("doc").alias("version_id")).agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).cast("long").alias("n_chars"))


_NAMED = rf"regexp_matches({_sq('query')}, '第[{X.HINT_NUMERALS}0-9\-之]+條')"
_RUN = r"regexp_replace(query, '[^\x{3400}-\x{9fff}]', '', 'g')"


@query(
    f"""SELECT DISTINCT case_id,
({_any("query", X.DEFINITION_MARKERS)} OR (NOT {_any("query", X.ACTION_MARKERS)} AND ({_any("query", X.IDENTITY_MARKERS)} OR (contains(query, '的') AND length({_RUN}) BETWEEN 1 AND 30)))) AS definition,
(NOT {_NAMED} AND {_any(_sq("query"), X.BROAD_MARKERS)}) AS broad, (NOT {_NAMED} AND {_any(_sq("query"), X.EXHAUSTIVE_MARKERS)}) AS exhaustive,
{_any(_sq("query"), X.PENALTY_MARKERS)} AS penalty, (contains({_sq("query")}, '公告') AND {_any(_sq("query"), X.ANNOUNCING)}) AS announcement,
({_any(_sq("query"), X.LATEST_MARKERS)} AND {_any(_sq("query"), X.LAW_WORDS)}) AS latest
FROM eval_cases WHERE query IS NOT NULL"""
)
def intent_flags(spark, d):
    q = F.col("query")
    return table(spark, d, "eval_cases").where("query is not null").select("case_id", X.is_definition_query(q).alias("definition"), X.is_broad_query(q).alias("broad"), X.is_exhaustive_query(q).alias("exhaustive"), X.is_penalty_query(q).alias("penalty"), X.asks_announcement(q).alias("announcement"), X.asks_latest_law(q).alias("latest")).distinct()


_TIDY = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(query, '^[{_WS}]+|[{_WS}]+$', '', 'g'), '^(?:{'|'.join(X.POLITE_PREFIXES)})[ ，、:：]*', ''), '[?？!！。]+$', ''), '^[{_WS}]+|[{_WS}]+$', '', 'g')"


@query(f"SELECT DISTINCT case_id, regexp_replace({_TIDY}, '[{_WS}]+', ' ', 'g') AS normalized FROM eval_cases WHERE query IS NOT NULL")
def query_normalize(spark, d):
    return table(spark, d, "eval_cases").where("query is not null").select("case_id", X.normalize_query(F.col("query")).alias("normalized")).distinct()


# ---- joins


@query("SELECT c_mktsegment AS segment, CAST(count(*) AS BIGINT) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def star_join_3way(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    return j.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n_lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query(f"WITH {_CUR} SELECT law_id, CAST(count(*) AS BIGINT) AS n_chunks, CAST(count(DISTINCT heading) AS BIGINT) AS n_headings, CAST(max(length(content)) AS BIGINT) AS longest FROM cur GROUP BY 1")
def chunks_by_law(spark, d):
    return _current(spark, d).groupBy("law_id").agg(F.count("*").alias("n_chunks"), F.countDistinct("heading").alias("n_headings"), F.max(F.length("content")).cast("long").alias("longest"))


@query(
    f"""WITH {_CUR}, ids AS (SELECT chunk_id FROM cur WHERE contains(content, '手提滅焰器')), t AS (SELECT DISTINCT law_title FROM l WHERE contains(law_title, '加壓泵組'))
SELECT chunk_id, law_title FROM cur WHERE chunk_id IN (SELECT chunk_id FROM ids) OR law_title IN (SELECT law_title FROM t)"""
)
def semi_join_candidates(spark, d):
    c = _current(spark, d)
    ids = c.where(F.contains("content", F.lit("手提滅焰器"))).select("chunk_id")
    by_title = c.where(F.contains("law_title", F.lit("加壓泵組"))).select("chunk_id")
    return c.join(ids.union(by_title).distinct(), "chunk_id", "left_semi").select("chunk_id", "law_title")


@query("SELECT DISTINCT version_id, law_id FROM law_versions WHERE NOT EXISTS (SELECT 1 FROM law_chunks WHERE law_chunks.version_id = law_versions.version_id)")
def anti_join_unlabelled(spark, d):
    """Versions of which no chunks are kept."""
    return table(spark, d, "law_versions").select("version_id", "law_id").distinct().join(table(spark, d, "law_chunks").select("version_id"), "version_id", "left_anti")


@query(f"WITH {_CUR}, t AS (SELECT DISTINCT law_title FROM l) SELECT doc_id, law_title FROM documents, t WHERE length(law_title) >= 3 AND contains(text, law_title)")
def contains_theta_join(spark, d):
    """Titles in the texts of documents: both sides grow, so the join goes by runs of the shortest title's length, then is confirmed."""
    t = _laws(spark, d).select(F.col("title").alias("law_title")).where(F.length("title") >= 3).distinct()
    n = t.agg(F.coalesce(F.min(F.length("law_title")), F.lit(3))).first()[0]
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    runs = docs.select("doc_id", F.explode(X.grams(F.col("text"), n)).alias("run"))
    some = runs.join(t.withColumn("run", F.substring("law_title", 1, n)), "run").select("doc_id", "law_title").distinct()
    return some.join(docs, "doc_id").where(F.contains("text", F.col("law_title"))).select("doc_id", "law_title")


def _key(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '[{_WS}、，,及與和暨（）()《》「」『』]+', '', 'g'), '(?:{'|'.join(X.TITLE_SUFFIXES)})$', '')"


_TITLES = f"""
qn AS (SELECT query_id, query, {_key(f"regexp_replace({_TIDY}, '[{_WS}]+', ' ', 'g')")} AS qk FROM q),
tt AS (SELECT law_title AS title, {_key("law_title")} AS tk FROM (SELECT DISTINCT law_title FROM l)),
mt AS (SELECT query_id, title FROM qn, tt WHERE length(title) >= 3 AND (contains(query, title) OR (length(tk) >= 6 AND contains(qk, tk)))),
best AS (SELECT query_id, title FROM mt WHERE NOT EXISTS (SELECT 1 FROM mt o WHERE o.query_id = mt.query_id AND o.title <> mt.title AND contains(o.title, mt.title)))
"""


@query(f"WITH {_CUR}, q AS (SELECT min(version_id) AS query_id, query FROM (SELECT version_id, '請問' || regexp_extract(raw_text, '法規名稱：([^\\n]+)', 1) || '？' AS query FROM law_versions) GROUP BY query), {_TITLES} SELECT query_id, title FROM best")
def longest_match_titles(spark, d):
    """The laws that the names in stored texts mean, asked as questions."""
    v = _versions(spark, d, "raw_text").select("version_id", F.concat(F.lit("請問"), F.regexp_extract("raw_text", "法規名稱：([^\\n]+)", 1), F.lit("？")).alias("query"))
    return R.matched_titles(v.where("query is not null").groupBy("query").agg(F.min("version_id").alias("query_id")), _laws(spark, d).select("title"))


@query("SELECT u AS conversation_id, greatest(made, coalesce(last, made)) AS last_activity FROM (SELECT user_id AS u, min(ts) AS made, max(CASE WHEN event_type <> 'view' THEN ts END) AS last FROM events GROUP BY user_id)")
def conversation_last_activity(spark, d):
    """Users' events as messages: the first makes the conversation."""
    e = table(spark, d, "events")
    conv = e.groupBy(F.col("user_id").alias("conversation_id")).agg(F.min("ts").alias("created_at"))
    msg = e.where("event_type <> 'view'").select(F.col("user_id").alias("conversation_id"), F.col("ts").alias("created_at"))
    return V.last_activity(conv, msg).select("conversation_id", "last_activity")


@query("SELECT user_id, max(CASE WHEN event_type = 'click' THEN event_id END) AS latest_click FROM events GROUP BY 1")
def latest_user_turn(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "click", F.col("event_id"))).alias("latest_click"))


# ---- aggregations


@query(
    """WITH f AS (SELECT DISTINCT fetch_id, law_id, status_code FROM law_fetches), l AS (SELECT DISTINCT law_id, category FROM laws),
r AS (SELECT category, CASE WHEN status_code = 200 THEN 'inserted' WHEN status_code IN (403, 429) THEN 'error' WHEN status_code = 404 THEN 'reprocess_required' ELSE 'unchanged' END AS status FROM f JOIN l USING (law_id) WHERE category IS NOT NULL)
SELECT category, CAST(count(*) AS BIGINT) AS total, CAST(sum(CASE WHEN status = 'inserted' THEN 1 ELSE 0 END) AS BIGINT) AS inserted, CAST(sum(CASE WHEN status = 'unchanged' THEN 1 ELSE 0 END) AS BIGINT) AS unchanged, CAST(sum(CASE WHEN status = 'reprocess_required' THEN 1 ELSE 0 END) AS BIGINT) AS reprocess_required, CAST(sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS error
FROM r GROUP BY ROLLUP (category)"""
)
def status_rollup(spark, d):
    f = table(spark, d, "law_fetches").select("fetch_id", "law_id", "status_code").distinct()
    st = F.when(F.col("status_code") == 200, "inserted").when(F.col("status_code").isin(403, 429), "error").when(F.col("status_code") == 404, "reprocess_required").otherwise("unchanged")
    r = f.join(_laws(spark, d).select("law_id", "category"), "law_id").where("category is not null").select("category", st.alias("status"))
    return V.crawl_report(r)


@query("SELECT law_id, CAST(coalesce(m, 0) + 1 AS BIGINT) AS next_no FROM (SELECT DISTINCT law_id FROM laws) LEFT JOIN (SELECT law_id, max(version_no) m FROM law_versions GROUP BY law_id) USING (law_id)")
def next_version_no(spark, d):
    return V.next_version(table(spark, d, "law_versions").select("law_id", "version_no"), table(spark, d, "laws"))


@query(f"WITH {_CUR} SELECT law_title, min(law_id) AS first_law, CAST(count(*) AS BIGINT) AS laws FROM l GROUP BY 1 ORDER BY 1")
def distinct_titles(spark, d):
    return _laws(spark, d).groupBy(F.col("title").alias("law_title")).agg(F.min("law_id").alias("first_law"), F.count("*").alias("laws")).orderBy("law_title")


@query("SELECT law_id, arg_min(article_label, chunk_id) AS first_label, arg_max(article_label, chunk_id) AS last_label, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT chunk_id, version_id, article_label FROM law_chunks WHERE article_label IS NOT NULL) JOIN (SELECT DISTINCT version_id, law_id FROM law_versions) USING (version_id) GROUP BY 1")
def first_last_labels(spark, d):
    c = table(spark, d, "law_chunks").select("chunk_id", "version_id", "article_label").where("article_label is not null").dropDuplicates(["chunk_id"])
    j = c.join(_versions(spark, d, "law_id"), "version_id")
    return j.groupBy("law_id").agg(F.min_by("article_label", "chunk_id").alias("first_label"), F.max_by("article_label", "chunk_id").alias("last_label"), F.count("*").alias("n"))


# ---- terms, index, scores

def _tok(x: str) -> str:
    return f"unnest(regexp_extract_all(lower({x}), '[\\x{{3400}}-\\x{{9fff}}A-Za-z0-9]+'))"



@query(
    f"""WITH t AS (SELECT case_id, {_tok("query")} AS t FROM (SELECT DISTINCT case_id, query FROM eval_cases)),
g AS (SELECT case_id, t AS term FROM t WHERE NOT regexp_full_match(t, '[\\x{{3400}}-\\x{{9fff}}]+')
UNION SELECT case_id, substr(t, i, n) FROM t, (SELECT unnest([2, 3]) AS n), unnest(range(1, 400)) AS r(i) WHERE regexp_full_match(t, '[\\x{{3400}}-\\x{{9fff}}]+') AND i <= length(t) - n + 1)
SELECT case_id, CAST(count(*) AS BIGINT) AS n_terms, string_agg(term, ' ' ORDER BY term COLLATE C) AS terms FROM g GROUP BY 1"""
)
def ngram_terms(spark, d):
    q = table(spark, d, "eval_cases").select("case_id", "query").distinct()
    return q.select("case_id", F.explode(X.lexical_terms(F.col("query"))).alias("t")).groupBy("case_id").agg(F.count("*").alias("n_terms"), F.array_join(F.array_sort(F.collect_list("t")), " ").alias("terms"))


def _index_sql(src: str, doc: str, cols: list[str]) -> str:
    fields = " UNION ALL ".join(f"SELECT {doc} AS doc, {_tok(f'coalesce({c}, {chr(39)}{chr(39)})')} AS t FROM {src}" for c in cols)
    return f"""it AS ({fields}),
ix AS (SELECT doc, t AS term FROM it WHERE length(t) > 3 UNION ALL SELECT doc, substr(t, i, n) FROM (SELECT doc, t, n, unnest(range(1, length(t) - n + 2)) AS i FROM it, (SELECT unnest([1, 2, 3]) AS n)))"""


@query(f"WITH {_CUR}, {_index_sql('cur', 'chunk_id', ['law_title', 'article_label', 'heading', 'content'])} SELECT term, CAST(count(DISTINCT doc) AS BIGINT) AS df, CAST(count(*) AS BIGINT) AS cf FROM ix GROUP BY 1")
def postings_build(spark, d):
    p = R.postings(_current(spark, d), "chunk_id", list(R.INDEXED))
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("cf"))


@query(f"WITH {_CUR}, {_index_sql('cur', 'chunk_id', ['law_title', 'article_label', 'heading', 'content'])}, n AS (SELECT doc, count(*) AS dl FROM ix GROUP BY 1) SELECT CAST(count(*) AS BIGINT) AS n, round(avg(dl), 6) AS avgdl, CAST(max(dl) AS BIGINT) AS longest FROM n")
def corpus_stats(spark, d):
    n = R.doc_lengths(_current(spark, d), "chunk_id", ["law_title", "article_label", "heading", "content"])
    return n.agg(F.count("*").alias("n"), F.round(F.avg("dl"), 6).alias("avgdl"), F.max("dl").alias("longest"))


@query(f"WITH {_CUR}, {_index_sql('cur', 'chunk_id', list(R.INDEXED))}, n AS (SELECT doc, count(*) AS dl FROM ix GROUP BY 1) SELECT (SELECT count(*) FROM cur) AS n, (SELECT round(sum(dl)::DOUBLE / (SELECT count(*) FROM cur), 6) FROM n) AS avgdl, (SELECT count(DISTINCT term) FROM ix) AS terms, (SELECT count(*) FROM (SELECT DISTINCT doc, term FROM ix)) AS postings")
def index_stats(spark, d):
    """What the index holds: built by the first search of a session, and read by all."""
    i = _index(spark, d)
    one = i.table("stats").select("n", F.round("avgdl", 6).alias("avgdl")).crossJoin(i.table("terms").agg(F.count("*").alias("terms")))  # one row each
    return one.crossJoin(i.table("postings").agg(F.count("*").alias("postings")))


_BM25 = f"""
qt AS (SELECT query_id, {_tok("query")} AS t FROM qx),
qg AS (SELECT DISTINCT query_id, t AS term FROM qt UNION SELECT query_id, substr(t, i, n) FROM (SELECT query_id, t, n, unnest(range(1, length(t) - n + 2)) AS i FROM qt, (SELECT unnest([2, 3]) AS n))),
q80 AS (SELECT query_id, term FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(term) DESC, term COLLATE C) r FROM qg) WHERE r <= 80),
dl AS (SELECT doc, count(*) AS dl FROM ix GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT term, doc, count(*) AS tf FROM ix WHERE term IN (SELECT term FROM q80) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT tf.doc, tf.term, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) AS w FROM tf JOIN df USING (term) JOIN dl USING (doc), st),
sc AS (SELECT query_id, doc, round(sum(CAST(round(w * 1e9) AS BIGINT))::DOUBLE / 1e9, 6) AS score FROM w JOIN q80 USING (term) GROUP BY 1, 2),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM sc))
"""


@query(f"WITH {_CUR}, {_Q}, qx AS (SELECT * FROM q), {_index_sql('cur', 'chunk_id', list(R.INDEXED))}, {_BM25} SELECT query_id, doc, rank, score FROM top WHERE rank <= 8")
def bm25_topk(spark, d):
    return R.bm25_topk(_asked(spark, d), _index(spark, d), 8).select("query_id", "doc", "rank", "score")


@query(
    f"""WITH {_Q}, p AS (SELECT DISTINCT p_partkey, p_name, p_type FROM part),
a AS (SELECT p_partkey, '  ' || lower(p_name) || ' ' AS x, '  ' || lower(p_type) || ' ' AS y FROM p),
g AS (SELECT p_partkey, list_distinct(list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3))) AS gx, list_distinct(list_transform(range(1, length(y) - 1), lambda i: substr(y, i, 3))) AS gy FROM a)
SELECT p_partkey, round(len(list_intersect(gx, gy)) / (len(gx) + len(gy) - len(list_intersect(gx, gy)))::DOUBLE, 6) AS similarity FROM g"""
)
def trigram_similarity(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(X.trigram_similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity")).distinct()


@query(
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT query_id, doc, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS doc, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)) WHERE rank <= 5"""
)
def cosine_topk(spark, d):
    """The nearest vectors of every vector whose id is divisible by 50, among all."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))
    return R.cosine_topk(e.where("doc % 50 = 0").select(F.col("doc").alias("query_id"), "vector"), e, 5)


@query(
    f"""WITH t AS (SELECT case_id AS doc, {_sq("lower(query)")} AS t FROM (SELECT DISTINCT case_id, query FROM eval_cases)),
g AS (SELECT doc, substr(t, i, n) AS g FROM (SELECT doc, t, n, unnest(range(1, length(t) - n + 2)) AS i FROM t, (SELECT unnest([1, 2, 3]) AS n))),
h AS (SELECT doc, ('0x' || substr(md5(g), 1, 8))::BIGINT AS h FROM g),
s AS (SELECT doc, h % 64 AS bucket, sum(CASE WHEN h >= 2147483648 THEN -1 ELSE 1 END) AS s FROM h GROUP BY 1, 2 HAVING s <> 0)
SELECT doc, bucket, round(s / sqrt(sum(s * s) OVER (PARTITION BY doc)), 6) AS value FROM s"""
)
def hash_embedding_md5(spark, d):
    return R.hash_embedding_md5(table(spark, d, "eval_cases").select("case_id", "query").distinct(), "case_id", "query")


@query()
def hash_embedding_blake2b(spark, d):
    q = table(spark, d, "eval_cases").select("case_id", "query").distinct()
    return q.select("case_id", R.hash_embedding(F.col("query")).alias("vector"))


@query()
def hybrid_topk(spark, d):
    h = R.hybrid_topk(_asked(spark, d), _index(spark, d), 8)
    return h.select("query_id", "pos", "chunk_id", "law_title", "article_label", "vector_score", "lexical_score", "hybrid_score")


@query()
def hybrid_trigram_topk(spark, d):
    h = R.hybrid_topk(_asked(spark, d), _index(spark, d), 8, weight=0.72, lexical="trigram")
    return h.select("query_id", "pos", "chunk_id", "vector_score", "lexical_score", "hybrid_score")


@query()
def routed_search(spark, d):
    return R.search(_asked(spark, d), _index(spark, d), 8).select("query_id", "pos", "chunk_id", "retrieval_mode", "hybrid_score")


@query()
def retrieval_eval(spark, d):
    q = _asked(spark, d)
    cases = table(spark, d, "eval_cases").dropDuplicates(["case_id"]).select(F.col("case_id").alias("query_id"), "expected_law", "expected_article").join(q.select("query_id"), "query_id", "left_semi")
    return R.evaluate(R.search(q, _index(spark, d), 8), cases)


_LEX = f"""
lt AS (SELECT query_id, {_tok("query")} AS t FROM q),
lq AS (SELECT query_id, t AS term FROM lt WHERE NOT regexp_full_match(t, '[\\x{{3400}}-\\x{{9fff}}]+') UNION SELECT query_id, substr(t, i, n) FROM (SELECT query_id, t, n, unnest(range(1, length(t) - n + 2)) AS i FROM lt, (SELECT unnest([2, 3]) AS n)) WHERE regexp_full_match(t, '[\\x{{3400}}-\\x{{9fff}}]+')),
nq AS (SELECT query_id, count(*) AS n FROM lq GROUP BY 1),
dt AS (SELECT chunk_id, {_tok("content")} AS t FROM cur),
ld AS (SELECT chunk_id, t AS term FROM dt WHERE NOT regexp_full_match(t, '[\\x{{3400}}-\\x{{9fff}}]+') UNION SELECT chunk_id, substr(t, i, n) FROM (SELECT chunk_id, t, n, unnest(range(1, length(t) - n + 2)) AS i FROM dt, (SELECT unnest([2, 3]) AS n)) WHERE regexp_full_match(t, '[\\x{{3400}}-\\x{{9fff}}]+'))
"""


@query(
    f"""WITH {_CUR}, {_Q}, {_LEX} SELECT query_id, chunk_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, round(count(*) / any_value(n)::DOUBLE, 6) AS score FROM ld JOIN lq USING (term) JOIN nq USING (query_id) GROUP BY 1, 2)) WHERE rank <= 8"""
)
def lexical_overlap_topk(spark, d):
    """The provisions that hold the largest share of a query's terms."""
    q = _asked(spark, d).select("query_id", F.explode(X.lexical_terms(F.col("query"))).alias("term"))
    n = q.groupBy("query_id").agg(F.count("*").alias("n"))
    terms = q.select("term").distinct()
    t = _current(spark, d).select("chunk_id", F.explode(X.lexical_terms(F.col("content"))).alias("term")).join(terms, "term", "left_semi")
    s = t.join(q, "term").groupBy("query_id", "chunk_id").agg(F.count("*").alias("c")).join(n, "query_id").withColumn("score", F.round(F.col("c") / F.col("n"), 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return s.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 8").select("query_id", "chunk_id", "rank", "score")


# ---- chunking


@query(
    rf"""WITH t AS (SELECT DISTINCT version_id, raw_text FROM law_versions WHERE raw_text IS NOT NULL),
s AS (SELECT version_id, unnest(string_split_regex(regexp_replace(raw_text, '[\x{{3000}}\x{{00A0}}]', ' ', 'g'), '\r\n|[\n\r]')) AS x, unnest(range(0, len(string_split_regex(regexp_replace(raw_text, '[\x{{3000}}\x{{00A0}}]', ' ', 'g'), '\r\n|[\n\r]')))) AS i FROM t),
k AS (SELECT version_id, i, regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '^[{_WS}]+|[{_WS}]+$', '', 'g') AS x FROM s),
m AS (SELECT *, regexp_matches(x, '^第\s*[{X.NUMERALS}\d\-之]+\s*條') AND NOT regexp_matches(x, '^第\s*[{X.NUMERALS}\d]+\s*[章節]') AS art, regexp_matches(x, '^第\s*[{X.NUMERALS}\d]+\s*[章節]') AS head,
regexp_matches(x, '^第\s*[{X.NUMERALS}\d\-之]+\s*條(?:\s*之\s*[{X.NUMERALS}\d]+)?\s*第\s*[{X.NUMERALS}\d]+\s*項') AS ref FROM k WHERE x <> '' AND NOT regexp_matches(x, '{X.NOISE}')),
f AS (SELECT *, art AND (NOT ref OR i = min(CASE WHEN art THEN i END) OVER (PARTITION BY version_id)) AS starts FROM m),
g AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY version_id ORDER BY i) AS grp FROM f)
SELECT version_id, CAST(grp - 1 AS BIGINT) AS seq, max(CASE WHEN starts THEN {_sq("regexp_extract(x, '^(第\\s*[" + X.NUMERALS + "\\d\\-之]+\\s*條(?:\\s*之\\s*[" + X.NUMERALS + "\\d]+)?)', 1)")} END) AS article_label, CAST(count(*) AS BIGINT) AS n_lines FROM g WHERE grp > 0 AND NOT head GROUP BY version_id, grp"""
)
def segment_articles(spark, d):
    """The articles of all texts that have some, with the lines of each."""
    s = C.segment(_versions(spark, d, "raw_text"), "version_id", "raw_text").where(F.col("article_label").startswith("第"))
    return s.select(F.col("doc").alias("version_id"), F.col("seq").cast("long").alias("seq"), "article_label", F.size(F.split("content", "\n")).cast("long").alias("n_lines"))


@query()
def heading_path(spark, d):
    """All chunks with their headings, of all texts."""
    return C.segment(_versions(spark, d, "raw_text"), "version_id", "raw_text").select(F.col("doc").alias("version_id"), "seq", "article_label", "heading", F.length("content").alias("n_chars"))


@query(
    """WITH t AS (SELECT DISTINCT version_id, raw_text AS x FROM law_versions WHERE raw_text IS NOT NULL),
w AS (SELECT version_id, x, unnest(range(0, CAST(greatest(ceil((length(x) - 1800) / 1620.0), 0) AS BIGINT) + 1)) AS n FROM t)
SELECT version_id, n AS window_no, substr(x, n * 1620 + 1, 1800) AS piece FROM w"""
)
def char_windows(spark, d):
    return _versions(spark, d, "raw_text").where("raw_text is not null").select("version_id", F.posexplode(C.char_windows("raw_text", 1800, 180)).alias("window_no", "piece")).withColumn("window_no", F.col("window_no").cast("long"))


@query(
    """WITH t AS (SELECT DISTINCT version_id, raw_text AS x FROM law_versions WHERE raw_text <> ''),
w AS (SELECT version_id, x, unnest(CASE WHEN length(x) <= 2600 THEN [0] ELSE range(0, CAST(floor((length(x) - 1) / 2500.0) AS BIGINT) + 1) END) AS n FROM t)
SELECT version_id, n AS window_no, CASE WHEN length(x) <= 2600 THEN x ELSE substr(x, n * 2500 + 1, 2600) END AS piece FROM w"""
)
def stride_windows(spark, d):
    return _versions(spark, d, "raw_text").where("raw_text <> ''").select("version_id", F.posexplode(C.stride_windows("raw_text")).alias("window_no", "piece")).withColumn("window_no", F.col("window_no").cast("long"))


@query()
def stored_attachments(spark, d):
    """Stored texts made of the documents of each law: the first its body, the others attachments, cut again at their boundaries."""
    return C.segment_attached(table(spark, d, "documents"), "law_key", "doc_id", "text").select(F.col("doc").alias("law_key"), "seq", "article_label", "heading", F.length("content").alias("n_chars"))


_META_SQL = ", ".join(f"nullif(substr(regexp_replace(regexp_extract(raw_text, '{p}', 1), '^[{_WS}]+|[{_WS}]+$', '', 'g'), 1, 200), '') AS {k}" for k, p in C.META.items())


@query(f"WITH t AS (SELECT DISTINCT version_id, raw_text FROM law_versions WHERE raw_text IS NOT NULL) SELECT version_id, {_META_SQL} FROM t")
def text_metadata(spark, d):
    return _versions(spark, d, "raw_text").where("raw_text is not null").select("version_id", C.metadata(F.col("raw_text")).alias("m")).select("version_id", "m.*")


@query()
def semantic_hashes(spark, d):
    v = _versions(spark, d, "raw_text").where("raw_text is not null")
    docs = v.select(F.col("version_id").alias("doc"), C.title(F.col("raw_text")).alias("title"), C.metadata(F.col("raw_text")).alias("meta"))
    return C.semantic_hash(docs, C.segment(v, "version_id", "raw_text")).select(F.col("doc").alias("version_id"), "content_hash")


@query("SELECT version_id, sha256(raw_text) AS text_hash, CAST(strlen(raw_text) AS BIGINT) AS n_bytes FROM (SELECT DISTINCT version_id, raw_text FROM law_versions WHERE raw_text IS NOT NULL)")
def content_hash(spark, d):
    return _versions(spark, d, "raw_text").where("raw_text is not null").select("version_id", F.sha2("raw_text", 256).alias("text_hash"), F.octet_length("raw_text").cast("long").alias("n_bytes"))


# ---- versions

_OLD = "vv AS (SELECT DISTINCT version_id, law_id, version_no, content_hash, metadata_json FROM law_versions), old AS (SELECT * FROM vv WHERE version_no <= 2), ll AS (SELECT DISTINCT law_id, source_key FROM laws)"


@query(
    f"""WITH {_OLD}, inc AS (SELECT source_key, content_hash FROM (SELECT source_key, content_hash, row_number() OVER (PARTITION BY source_key ORDER BY version_no DESC, version_id DESC) r FROM vv JOIN ll USING (law_id)) WHERE r = 1),
cu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY law_id ORDER BY version_no DESC, version_id DESC) r FROM old) WHERE r = 1),
j AS (SELECT inc.source_key, ll.law_id, inc.content_hash, cu.content_hash AS oh, cu.version_no AS n, CASE WHEN regexp_full_match(json_extract_string(metadata_json, '$.parser_revision'), '-?[0-9]{{1,9}}') THEN CAST(json_extract_string(metadata_json, '$.parser_revision') AS INTEGER) END AS rev FROM inc JOIN ll USING (source_key) LEFT JOIN cu USING (law_id))
SELECT source_key, law_id, CASE WHEN oh IS NULL OR oh <> content_hash THEN 'inserted' WHEN coalesce(rev, 0) < 3 THEN 'reprocess_required' ELSE 'unchanged' END AS status, CAST(CASE WHEN oh IS NULL OR oh <> content_hash THEN coalesce(n, 0) + 1 ELSE n END AS BIGINT) AS version_no FROM j"""
)
def version_upsert_status(spark, d):
    """Each law's newest version as incoming, against the versions up to number 2."""
    v = table(spark, d, "law_versions").select("version_id", "law_id", "version_no", "content_hash", "metadata_json").dropDuplicates(["version_id"])
    laws = table(spark, d, "laws").select("law_id", "source_key").distinct()
    newest = V.derive_current(v).where("is_current").join(laws, "law_id").select("source_key", "content_hash")
    return V.upsert_status(newest, laws, v.where("version_no <= 2"))


@query(
    """WITH vv AS (SELECT DISTINCT version_id, law_id, version_no, metadata_json FROM law_versions), ll AS (SELECT DISTINCT law_id, category FROM laws),
cu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY law_id ORDER BY version_no DESC, version_id DESC) r FROM vv) WHERE r = 1),
j AS (SELECT law_id, version_id, version_no, CASE WHEN regexp_full_match(json_extract_string(metadata_json, '$.parser_revision'), '-?[0-9]{1,9}') THEN CAST(json_extract_string(metadata_json, '$.parser_revision') AS INTEGER) END AS stored_revision FROM cu JOIN ll USING (law_id) WHERE category IS NULL OR category <> '消防署函釋')
SELECT law_id, version_id, version_no, coalesce(stored_revision, -1) AS stored_revision FROM j WHERE coalesce(stored_revision, 0) < 3"""
)
def reprocess_dry_run(spark, d):
    r = V.reprocess(table(spark, d, "law_versions").select("version_id", "law_id", "version_no", "metadata_json"), table(spark, d, "laws"))
    return r.withColumn("stored_revision", F.coalesce("stored_revision", F.lit(-1)))


# ---- selection


def _hits(spark: SparkSession, d: str, k: int = 24) -> DataFrame:
    """BM25 hits of all queries with what selection needs."""
    index = _index(spark, d)
    top = R.bm25_topk(_asked(spark, d), index, k)
    c = index.table("docs").drop("cv", "ps")
    return top.join(c.hint("merge"), top.doc == c.chunk_id).select("query_id", F.col("rank").alias("pos"), "chunk_id", "law_id", "law_title", "version_no", "article_label", "heading", "content", "source_url", F.col("score").alias("hybrid_score"))


_HITS = f"""{_CUR}, {_Q}, qx AS (SELECT * FROM q), {_index_sql("cur", "chunk_id", list(R.INDEXED))}, {_BM25},
hits AS (SELECT query_id, rank AS pos, chunk_id, law_id, law_title, version_no, article_label, heading, content, source_url, score AS hybrid_score FROM top JOIN cur ON doc = chunk_id WHERE rank <= 24)"""
_KEYS = f"law_id, CASE WHEN {_sq('coalesce(article_label, chr(32))')} = '' THEN CAST(chunk_id AS VARCHAR) ELSE 'L' || {_sq('article_label')} END, {_sq('coalesce(heading, chr(32))')}, {_sq('content')}"
_DEDUPED = f"uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, {_KEYS} ORDER BY pos, chunk_id) r FROM hits) WHERE r = 1)"


@query(f"WITH {_HITS}, {_DEDUPED} SELECT query_id, pos, chunk_id FROM uniq")
def dedupe_evidence(spark, d):
    return S.dedupe(_hits(spark, d)).select("query_id", "pos", "chunk_id")


_DIVERSE = """o1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, law_id ORDER BY pos, chunk_id) AS ol FROM uniq),
o2 AS (SELECT *, sum(CASE WHEN ol = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY pos, chunk_id) AS lead FROM o1),
dv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN ol = 1 AND lead <= 6 THEN 0 WHEN ol <= 2 THEN 1 ELSE 2 END, pos, chunk_id) AS place FROM o2) WHERE place <= 8)"""


@query(f"WITH {_HITS}, {_DEDUPED}, {_DIVERSE} SELECT query_id, place, chunk_id, law_id FROM dv")
def diverse_topk(spark, d):
    return S.diverse_topk(_hits(spark, d), 8).select("query_id", "place", "chunk_id", "law_id")


@query(f"WITH {_HITS}, {_DEDUPED}, {_DIVERSE} SELECT query_id, place, chunk_id, coalesce(nullif(min(place) OVER (PARTITION BY query_id, law_title, version_no, source_url), place), 0) AS same_as FROM dv")
def first_seen_source(spark, d):
    return S.first_seen(S.diverse_topk(_hits(spark, d), 8)).select("query_id", "place", "chunk_id", F.coalesce("same_as", F.lit(0)).alias("same_as"))


@query(
    f"""WITH {_HITS}, m AS (SELECT *, CASE WHEN pos <= 8 THEN 0 ELSE {" + ".join(f"CAST(contains(content, '{w}') AS INTEGER)" for w in X.ANSWER_MARKERS)} END AS marks FROM hits)
SELECT query_id, chunk_id, slot FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos > 8, marks DESC, pos, chunk_id) AS slot FROM m) WHERE slot <= 12"""
)
def rerank_candidates(spark, d):
    return S.rerank_candidates(_hits(spark, d), 8, 12).select("query_id", "chunk_id", "slot")


@query(
    f"""WITH {_HITS}, {_DEDUPED}, {_DIVERSE}, fs AS (SELECT *, min(place) OVER (PARTITION BY query_id, law_title, version_no, source_url) AS f FROM dv)
SELECT query_id, string_agg('[' || place || ']' || chr(10) || CASE WHEN f < place THEN '來源：同 [' || f || ']' ELSE '法規：' || law_title || ' 版本：' || version_no || ' 來源：' || source_url END || chr(10) || concat_ws(' ', article_label, heading) || chr(10) || substr(content, 1, 5000), chr(10) || chr(10) ORDER BY place) AS context FROM fs GROUP BY 1"""
)
def evidence_context(spark, d):
    return S.evidence_context(S.diverse_topk(_hits(spark, d), 8))


@query(f"WITH {_HITS}, b AS (SELECT query_id, max(hybrid_score) AS best FROM hits WHERE pos <= 8 GROUP BY 1) SELECT q.query_id, coalesce(best < 30, TRUE) AS needs_web FROM q LEFT JOIN b USING (query_id)")
def web_gate(spark, d):
    h = _hits(spark, d, 8).withColumn("retrieval_mode", F.lit("hybrid"))
    return S.needs_web(h, _asked(spark, d), 30.0)


@query()
def ranked_hits(spark, d):
    """The evidence of all queries by the way each takes: exact articles, places for facets, or the best hits."""
    return E.ranked_hits(_asked(spark, d), _index(spark, d)).select("query_id", "place", "chunk_id", "law_id", "retrieval_mode")


@query()
def facet_coverage(spark, d):
    """Evidence with places for the laws and objects asked about, for all queries as if they asked broadly."""
    q = _asked(spark, d).withColumn("query", F.concat("query", F.lit("相關規定")))
    return E.ranked_hits(q, _index(spark, d)).select("query_id", "place", "chunk_id", "law_id")


@query(
    f"""WITH {_CUR}, q AS (SELECT law_id AS query_id, '請列出' || law_title || '第二章的所有規定' AS query FROM (SELECT law_id, law_title, row_number() OVER (PARTITION BY law_title ORDER BY law_id) r FROM l) WHERE r = 1), {_TITLES},
o AS (SELECT query_id, min(title) AS title FROM best GROUP BY 1 HAVING count(*) = 1),
k AS (SELECT *, {_sq('content')} AS x, {_sq('coalesce(article_label, chr(32))')} AS y FROM cur),
h AS (SELECT query_id, chunk_id, seq, heading, law_title FROM k JOIN o ON law_title = title WHERE contains(heading, '第二章') AND NOT coalesce((CASE WHEN y <> '' AND starts_with(x, y) THEN substr(x, length(y) + 1) ELSE x END) IN ('刪除', '（刪除）', '(刪除)'), FALSE))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY seq, chunk_id) AS place, chunk_id, count(*) OVER (PARTITION BY query_id) AS total_matches, TRUE AS complete, law_title AS scope_law_title, first_value(heading) OVER (PARTITION BY query_id ORDER BY seq, chunk_id) AS scope_heading FROM h"""
)
def exhaustive_evidence(spark, d):
    """All provisions of every law's second chapter, with their coverage."""
    one = _laws(spark, d).groupBy("title").agg(F.min("law_id").alias("query_id"))
    asked = one.select("query_id", F.concat(F.lit("請列出"), "title", F.lit("第二章的所有規定")).alias("query"), F.lit("第二章").alias("heading_term"))
    s = E.sections(asked, _index(spark, d))
    total = F.count("*").over(Window.partitionBy("query_id"))
    return s.select("query_id", "place", "chunk_id", total.alias("total_matches"), F.lit(True).alias("complete"), "scope_law_title", "scope_heading")


@query()
def answer_evidence(spark, d):
    """The evidence of all queries with what it covers."""
    return E.answer_evidence(_asked(spark, d), _index(spark, d)).select("query_id", "place", "chunk_id", "mode", "total_matches", "complete")


def _num(x: str) -> str:
    t = f"translate({x}, '零〇○一二三四五六七八九兩', '0001234567892')"
    unit = lambda u, k: f"(CASE WHEN contains({t}, '{u}') THEN coalesce(try_cast(nullif(regexp_extract({t}, '([0-9]?){u}', 1), '') AS BIGINT), 1) * {k} ELSE 0 END)"
    return f"(CASE WHEN regexp_full_match({t}, '[0-9]+') THEN CAST({t} AS BIGINT) ELSE {unit('千', 1000)} + {unit('百', 100)} + {unit('十', 10)} + coalesce(try_cast(nullif(regexp_extract({t}, '[千百十零0]([0-9])$', 1), '') AS BIGINT), 0) END)"


_LAB = f"^第([{X.HINT_NUMERALS}0-9]+)(?:(?:-|之)([{X.HINT_NUMERALS}0-9]+))?條(?:之([{X.HINT_NUMERALS}0-9]+))?$"
_CANON = (
    f"CASE WHEN regexp_matches({_sq('article_label')}, '{_LAB}') AND NOT (regexp_extract({_sq('article_label')}, '{_LAB}', 2) <> '' AND regexp_extract({_sq('article_label')}, '{_LAB}', 3) <> '') THEN '第' || {_num(f"regexp_extract({_sq('article_label')}, '{_LAB}', 1)")} || "
    f"CASE WHEN regexp_extract({_sq('article_label')}, '{_LAB}', 2) || regexp_extract({_sq('article_label')}, '{_LAB}', 3) <> '' THEN '-' || {_num(f"(regexp_extract({_sq('article_label')}, '{_LAB}', 2) || regexp_extract({_sq('article_label')}, '{_LAB}', 3))")} ELSE '' END || '條' END"
)


@query(f"SELECT DISTINCT chunk_id, article_label, {_CANON} AS canonical FROM law_chunks WHERE article_label IS NOT NULL")
def cn_numerals(spark, d):
    return table(spark, d, "law_chunks").where("article_label is not null").select("chunk_id", "article_label", X.canonical_label(F.col("article_label")).alias("canonical")).distinct()


@query(f"WITH {_CUR}, k AS (SELECT *, {_CANON} AS canonical FROM cur), s AS (SELECT law_id AS query_id, law_title AS title FROM (SELECT law_id, law_title, row_number() OVER (PARTITION BY law_title ORDER BY law_id) r FROM l) WHERE r = 1) SELECT query_id, chunk_id, article_label FROM k JOIN s ON law_title = title WHERE canonical = '第3條'")
def exact_article(spark, d):
    """第三條 of every title."""
    scope = _laws(spark, d).groupBy("title").agg(F.min("law_id").alias("query_id")).withColumn("article", X.canonical_label(F.lit("第 三 條")))
    return R.exact_article(scope, _current(spark, d)).select("query_id", "chunk_id", "article_label")


@query(f"WITH {_CUR}, s AS (SELECT law_id AS query_id, law_title AS title FROM (SELECT law_id, law_title, row_number() OVER (PARTITION BY law_title ORDER BY law_id) r FROM l) WHERE r = 1), k AS (SELECT *, {_sq('content')} AS x, {_sq('coalesce(article_label, chr(32))')} AS y FROM cur) SELECT query_id, chunk_id, CAST(seq AS BIGINT) AS seq FROM k JOIN s ON law_title = title WHERE contains(heading, '第二章') AND NOT coalesce((CASE WHEN y <> '' AND starts_with(x, y) THEN substr(x, length(y) + 1) ELSE x END) IN ('刪除', '（刪除）', '(刪除)'), FALSE)")
def exhaustive_section(spark, d):
    """All provisions of every law's second chapter that aren't deleted."""
    scope = _laws(spark, d).groupBy("title").agg(F.min("law_id").alias("query_id")).withColumn("heading_term", F.lit("第二章"))
    return R.section_search(scope, _current(spark, d)).select("query_id", "chunk_id", F.col("seq").cast("long").alias("seq"))


# ---- answers


@query(
    """WITH t AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '[0-9]{1,3}'), lambda x: CAST(x AS INTEGER))) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(n) > 0 AND len(list_filter(n, lambda x: x NOT BETWEEN 1 AND 500)) = 0 AS valid FROM t"""
)
def citation_validation(spark, d):
    """The numbers in each document as citations of 500 pieces of evidence."""
    cited = F.regexp_replace(F.regexp_replace("text", r"\[|\]", " "), "([0-9]{1,3})", "[$1]")
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.citations(cited, F.lit(500)).isNotNull().alias("valid"))


@query("SELECT doc_id, CAST(greatest(1, length(text), CAST(ceil(strlen(text) / 3.0) AS INTEGER)) AS BIGINT) AS prompt_tokens, CAST(greatest(64, least(4096, greatest(64, 16384 - greatest(1, length(text), CAST(ceil(strlen(text) / 3.0) AS INTEGER)) - 512))) AS BIGINT) AS output_tokens FROM documents WHERE text IS NOT NULL")
def token_budget(spark, d):
    n = X.token_estimate(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", n.cast("long").alias("prompt_tokens"), X.output_tokens(F.lit(4096), F.lit(16384), n).cast("long").alias("output_tokens"))


@query(f"SELECT doc_id, {_any('text', A.INSUFFICIENT)} AS lacking, regexp_replace(regexp_replace(text, '[{_WS}]+$', ''), '[*_` ]+$', '') = '' OR (NOT regexp_matches(regexp_replace(regexp_replace(text, '[{_WS}]+$', ''), '[*_` ]+$', ''), '(?:[。！？.!?\\]）)】」』]|\\[[0-9]+\\])$') AND length(regexp_replace(regexp_extract(regexp_replace(regexp_replace(text, '[{_WS}]+$', ''), '[*_` ]+$', ''), '([^\\n]*)$', 1), '^[ \\-*\\t]+|[ \\-*\\t]+$', '', 'g')) <= 8) AS broken_off FROM documents WHERE text IS NOT NULL")
def answer_checks(spark, d):
    """All documents as a model's answers: do they admit a lack, did they break off."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", A.admits_lack(F.col("text")).alias("lacking"), A.is_incomplete(F.col("text"), F.lit(True), F.lit(None).cast("string")).alias("broken_off"))


_TAIL = f"regexp_replace(regexp_replace(text, '[{_WS}]+$', ''), '[*_` ]+$', '')"


@query(
    f"""WITH t AS (SELECT doc_id, text, {_TAIL} AS x FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '\\[([0-9]{{1,9}})\\]', 1), lambda v: CAST(v AS INTEGER))) AS n FROM t),
b AS (SELECT doc_id, x = '' OR (NOT regexp_matches(x, '(?:[。！？.!?\\]）)】」』]|\\[[0-9]+\\])$') AND length(regexp_replace(regexp_extract(x, '([^\\n]*)$', 1), '^[ \\-*\\t]+|[ \\-*\\t]+$', '', 'g')) <= 8) AS broken FROM t)
SELECT doc_id, CASE WHEN len(n) = 0 OR len(list_filter(n, lambda v: v NOT BETWEEN 1 AND 8)) > 0 THEN 'llm_error' WHEN broken THEN 'incomplete' ELSE 'ok' END AS status FROM c JOIN b USING (doc_id)"""
)
def answer_status(spark, d):
    """All documents as a model's answers from eight pieces of evidence."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", G.status(F.col("text"), F.lit(True), F.lit(None).cast("string"), F.lit(8)).alias("status"))


_DATE = r"(?:發布日期|公布日期|修正日期|公告日期|發文日期)[：:]?\s*(?:中華民國|民國)?\s*(\d{2,4})\s*[年./-]\s*(\d{1,2})\s*[月./-]\s*(\d{1,2})"


@query(
    f"""WITH t AS (SELECT DISTINCT version_id, substr(raw_text, 1, 4000) AS x FROM law_versions WHERE raw_text IS NOT NULL),
p AS (SELECT version_id, regexp_extract(x, '{_DATE}', 1) AS y, regexp_extract(x, '{_DATE}', 2) AS m, regexp_extract(x, '{_DATE}', 3) AS dd FROM t)
SELECT version_id, CASE WHEN y <> '' THEN try_cast(lpad(CAST(CASE WHEN CAST(y AS INTEGER) < 1911 THEN CAST(y AS INTEGER) + 1911 ELSE CAST(y AS INTEGER) END AS VARCHAR), 4, '0') || '-' || lpad(m, 2, '0') || '-' || lpad(dd, 2, '0') AS DATE)::VARCHAR END AS source_date FROM p"""
)
def roc_date_parse(spark, d):
    return _versions(spark, d, "raw_text").where("raw_text is not null").select("version_id", X.roc_date(F.col("raw_text")).cast("string").alias("source_date"))


# ---- URLs and HTML


@query(f"SELECT DISTINCT law_id, '{PREFIX}' || upper(regexp_extract(source_url, '(?i)[?&]lsid=([^&]*)', 1)) AS identity, lower(regexp_extract(source_url, '^https?://([^/?]+)', 1)) AS host FROM laws WHERE regexp_matches(source_url, '(?i)[?&]lsid=[^&]')")
def url_identity(spark, d):
    u = F.col("source_url")
    return table(spark, d, "laws").where(U.lsid(u).isNotNull()).select("law_id", U.source_key(u, PREFIX).alias("identity"), U.host(u).alias("host")).distinct()


@query("SELECT DISTINCT page_id, url FROM fetched_pages WHERE regexp_matches(url, '^https://(?:[^/@]+[.])?(?:anhu[.]example|nanyu[.]example)/')")
def allowed_hosts(spark, d):
    return table(spark, d, "fetched_pages").where(U.allowed(F.col("url"), ("anhu.example", "nanyu.example"))).select("page_id", "url").distinct()


def _html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fetched_pages").where("status_code = 200 and content_type like 'text/html%' and text is not null").select("page_id", "url", F.col("text").alias("html")).dropDuplicates(["page_id"])


@query()
def html_to_text(spark, d):
    return _html(spark, d).select("page_id", H.page_text(F.col("html")).alias("text"))


@query()
def html_title(spark, d):
    return _html(spark, d).select("page_id", H.page_title(F.col("html")).alias("title"))


@query()
def html_links(spark, d):
    return H.links(_html(spark, d))


@query()
def parsed_pages(spark, d):
    """Pages to chunks: text, then segments."""
    t = _html(spark, d).select("page_id", H.page_text(F.col("html")).alias("text"))
    return C.segment(t, "page_id", "text").select(F.col("doc").alias("page_id"), "seq", "article_label", "heading", F.length("content").alias("n_chars"))
