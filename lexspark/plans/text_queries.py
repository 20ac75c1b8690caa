"""Queries of single functions and small operators over whole tables, with the SQL that DuckDB answers alike."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexspark.functions import answers as A
from lexspark.functions import text as X
from lexspark.functions import urls as U
from lexspark.operators import answering as G
from lexspark.operators import chunking as C
from lexspark.operators import evidence as E
from lexspark.operators import ingest as I
from lexspark.operators import retrieval as R
from lexspark.operators import scan
from lexspark.operators import selection as S
from lexspark.operators import versioning as V
from lexspark.plans.catalog import _BM25, _CANON, _CUR, _HITS, _TIDY, _TITLES, _WS, _any, _asked, _hits, _index, _index_sql, _laws, _sq, _versions, query
from lexspark.runtime import table

_CASES = "(SELECT DISTINCT case_id, query FROM eval_cases WHERE query IS NOT NULL)"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _cases(spark, d):
    return table(spark, d, "eval_cases").where("query is not null").select("case_id", "query").distinct()


# ---- counts, versions, reports


@query("SELECT doc_type, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE lang = 'zh') AS BIGINT) AS zh, CAST(count(*) FILTER (WHERE lang = 'en') AS BIGINT) AS en, CAST(count(*) FILTER (WHERE text IS NULL OR text = '') AS BIGINT) AS empty FROM documents GROUP BY 1")
def status_counts(spark, d):
    n = lambda c, name: F.count_if(c).alias(name)
    return table(spark, d, "documents").groupBy("doc_type").agg(F.count("*").alias("n"), n(F.col("lang") == "zh", "zh"), n(F.col("lang") == "en", "en"), n(F.coalesce(F.col("text"), F.lit("")) == "", "empty"))


@query(
    """WITH t AS (SELECT doc_id, law_key, sha256(text) AS h, collected_at FROM documents WHERE text IS NOT NULL AND law_key IS NOT NULL),
c AS (SELECT *, lag(h) OVER w AS p FROM t WINDOW w AS (PARTITION BY law_key ORDER BY collected_at, doc_id))
SELECT doc_id, law_key, CASE WHEN p IS NULL OR p <> h THEN 'inserted' ELSE 'unchanged' END AS status, CAST(sum(CASE WHEN p IS NULL OR p <> h THEN 1 ELSE 0 END) OVER (PARTITION BY law_key ORDER BY collected_at, doc_id) AS BIGINT) AS version_no FROM c"""
)
def content_hash_versions(spark, d):
    """Each law's documents in order of time as texts that come in: a version for every hash that differs from the one before."""
    w = Window.partitionBy("law_key").orderBy("collected_at", "doc_id")
    t = table(spark, d, "documents").where("text is not null and law_key is not null").select("doc_id", "law_key", F.sha2("text", 256).alias("h"), "collected_at")
    t = t.withColumn("new", F.coalesce(F.lag("h").over(w) != F.col("h"), F.lit(True)))
    return t.select("doc_id", "law_key", F.when(F.col("new"), "inserted").otherwise("unchanged").alias("status"), F.sum(F.col("new").cast("long")).over(w).alias("version_no"))


@query("SELECT law_id, version_id, version_no, content_hash, row_number() OVER (PARTITION BY law_id ORDER BY version_no DESC, version_id DESC) = 1 AS is_current FROM (SELECT DISTINCT law_id, version_id, version_no, content_hash FROM law_versions)")
def version_list(spark, d):
    v = _versions(spark, d, "law_id", "version_no", "content_hash", "fetched_at")
    return V.version_list(v).select("law_id", "version_id", "version_no", "content_hash", "is_current")


@query(
    """WITH g AS (SELECT DISTINCT law_id FROM laws WHERE title LIKE '%要點%'), v AS (SELECT DISTINCT version_id, law_id FROM law_versions), c AS (SELECT DISTINCT chunk_id, version_id FROM law_chunks)
SELECT (SELECT count(DISTINCT law_id) FROM laws WHERE law_id NOT IN (SELECT law_id FROM g)) AS laws, (SELECT count(*) FROM v WHERE law_id NOT IN (SELECT law_id FROM g)) AS versions,
(SELECT count(*) FROM c WHERE version_id NOT IN (SELECT version_id FROM v WHERE law_id IN (SELECT law_id FROM g))) AS chunks"""
)
def delete_cascade(spark, d):
    """What is left when all laws of a kind are deleted, with their versions and chunks."""
    laws = _laws(spark, d).select("law_id", "title")
    out = V.delete_laws(laws.where(F.contains("title", F.lit("要點"))).select("law_id"), laws, _versions(spark, d, "law_id"), table(spark, d, "law_chunks").select("chunk_id", "version_id").distinct())
    n = [x.agg(F.count("*").alias(name)) for x, name in zip(out, ("laws", "versions", "chunks"))]
    return n[0].crossJoin(n[1]).crossJoin(n[2])  # one row each


@query("SELECT DISTINCT version_id, strftime(fetched_at + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS label FROM law_versions WHERE fetched_at IS NOT NULL")
def time_labels(spark, d):
    """Stored times as shown to readers eight hours east."""
    return table(spark, d, "law_versions").where("fetched_at is not null").select("version_id", F.date_format(F.from_utc_timestamp(F.col("fetched_at").cast("timestamp"), "Asia/Taipei"), "yyyy-MM-dd HH:mm").alias("label")).distinct()


# ---- lines and segments

_LINES = rf"""t AS (SELECT DISTINCT version_id, raw_text FROM law_versions WHERE raw_text IS NOT NULL),
s AS (SELECT version_id, unnest(string_split_regex(regexp_replace(raw_text, '[\x{{3000}}\x{{00A0}}]', ' ', 'g'), '\r\n|[\n\r]')) AS x, unnest(range(0, len(string_split_regex(regexp_replace(raw_text, '[\x{{3000}}\x{{00A0}}]', ' ', 'g'), '\r\n|[\n\r]')))) AS i FROM t),
k AS (SELECT version_id, i, regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '^[{_WS}]+|[{_WS}]+$', '', 'g') AS x FROM s),
ln AS (SELECT version_id, i, x FROM k WHERE x <> '' AND NOT regexp_matches(x, '{X.NOISE}'))"""
_N = X.NUMERALS


@query(f"WITH {_LINES} SELECT version_id, CAST(row_number() OVER (PARTITION BY version_id ORDER BY i) - 1 AS BIGINT) AS pos, x AS line FROM ln")
def chunk_lines(spark, d):
    return C.lines(_versions(spark, d, "raw_text"), "version_id", "raw_text").select(F.col("doc").alias("version_id"), F.col("pos").cast("long").alias("pos"), "line")


@query(
    rf"""WITH {_LINES}, m AS (SELECT *, regexp_matches(x, '^第\s*[{_N}\d\-之]+\s*條') AND NOT regexp_matches(x, '^第\s*[{_N}\d]+\s*[章節]') AS art, regexp_matches(x, '^第\s*[{_N}\d]+\s*[章節]') AS head,
regexp_matches(x, '^第\s*[{_N}\d\-之]+\s*條(?:\s*之\s*[{_N}\d]+)?\s*第\s*[{_N}\d]+\s*項') AS ref FROM ln),
f AS (SELECT *, art AND (NOT ref OR i = min(CASE WHEN art THEN i END) OVER (PARTITION BY version_id)) AS starts,
CASE WHEN head THEN {_sq("regexp_extract(x, '^(第\\s*[" + _N + "\\d]+\\s*[章節])', 1)")} || CASE WHEN regexp_extract(x, '^第\s*[{_N}\d]+\s*[章節]\s*(.*)$', 1) <> '' THEN ' ' || regexp_extract(x, '^第\s*[{_N}\d]+\s*[章節]\s*(.*)$', 1) ELSE '' END END AS title FROM m),
g AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY version_id ORDER BY i) AS grp, last_value(title IGNORE NULLS) OVER (PARTITION BY version_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM f)
SELECT version_id, CAST(grp - 1 AS BIGINT) AS seq, max(CASE WHEN starts THEN heading END) AS heading FROM g WHERE grp > 0 AND NOT head GROUP BY version_id, grp"""
)
def article_headings(spark, d):
    """The chapter or section that each article of each text stands in."""
    s = C.segment(_versions(spark, d, "raw_text"), "version_id", "raw_text").where(F.col("article_label").startswith("第"))
    return s.select(F.col("doc").alias("version_id"), F.col("seq").cast("long").alias("seq"), "heading")


@query(
    rf"""WITH {_LINES}, m AS (SELECT *, CASE WHEN regexp_matches(x, '^[{_N}]+、') THEN 1 WHEN regexp_matches(x, '^[（(][{_N}]+[）)]') THEN 2 WHEN regexp_matches(x, '^\d+[\.、]') THEN 3 END AS level FROM ln)
SELECT version_id, CAST(count(DISTINCT level) AS BIGINT) AS levels, CAST(count(level) AS BIGINT) AS points FROM m GROUP BY 1"""
)
def point_levels(spark, d):
    """How many levels of numbered points each text has."""
    ln = C.lines(_versions(spark, d, "raw_text"), "version_id", "raw_text")
    level = F.coalesce(*(F.when(F.col("line").rlike(p), n) for n, p in enumerate(C.POINTS, 1)))
    return ln.groupBy(F.col("doc").alias("version_id")).agg(F.countDistinct(level).alias("levels"), F.count(level).alias("points"))


@query(
    rf"""WITH t AS (SELECT DISTINCT version_id, regexp_replace(regexp_replace(regexp_extract(raw_text, '法規名稱[：:]\s*([^\n]+)', 1), '[{_WS}]+', ' ', 'g'), '^[ ：:]+|[ ：:]+$', '', 'g') AS x FROM law_versions WHERE raw_text IS NOT NULL),
b AS (SELECT version_id, regexp_replace(x, '\s*[（(]\d{{2,3}}/\d{{1,2}}/\d{{1,2}}\s*(?:公發布|發布|公布|修正|訂定)[）)]\s*$', '') AS x FROM t) SELECT version_id, CASE WHEN length(x) >= 2 THEN x END AS title FROM b"""
)
def law_names(spark, d):
    return _versions(spark, d, "raw_text").where("raw_text is not null").select("version_id", C.title(F.col("raw_text")).alias("title"))


@query(rf"WITH t AS (SELECT DISTINCT chunk_id, content FROM law_chunks WHERE content IS NOT NULL) SELECT chunk_id, array_to_string(list_sort(list_distinct(regexp_extract_all(content, '所稱[{_WS}]*([\x{{3400}}-\x{{9fff}}A-Za-z0-9（）()]{{2,24}}?)[{_WS}]*(?:，|、|：|:|係指|是指)', 1))), ' ') AS terms FROM t")
def defined_terms(spark, d):
    t = table(spark, d, "law_chunks").where("content is not null").select("chunk_id", "content").distinct()
    return t.select("chunk_id", F.array_join(F.array_sort(X.defined_terms(F.col("content"))), " ").alias("terms"))


@query(f"SELECT DISTINCT law_id, {_trim('title')} AS title, ends_with({_trim('title')}, '條例') OR (ends_with({_trim('title')}, '法') AND NOT ends_with({_trim('title')}, '辦法')) AS is_primary FROM laws")
def primary_statutes(spark, d):
    return _laws(spark, d).select("law_id", "title", X.is_primary_statute(F.col("title")).alias("is_primary"))


# ---- queries


@query(
    rf"""WITH q AS {_CASES}, u AS (SELECT case_id, query FROM q UNION ALL SELECT case_id + 100000, query || '第 三 條及第12條之1' FROM q),
a AS (SELECT case_id, unnest(regexp_extract_all(query, '第[{_WS}]*[{X.HINT_NUMERALS}0-9\-之]+[{_WS}]*條(?:[{_WS}]*之[{_WS}]*[一二三四五六七八九十百千0-9]+)?')) AS article_label FROM u)
SELECT case_id, {_CANON} AS label, CAST(count(*) AS BIGINT) AS n FROM a WHERE {_CANON} IS NOT NULL GROUP BY 1, 2"""
)
def article_hints(spark, d):
    """The articles that queries name, also with two more in each."""
    q = _cases(spark, d)
    u = q.unionByName(q.select((F.col("case_id") + 100000).alias("case_id"), F.concat("query", F.lit("第 三 條及第12條之1")).alias("query")))
    return u.select("case_id", F.explode(X.article_hints(F.col("query"))).alias("label")).groupBy("case_id", "label").agg(F.count("*").alias("n"))


_INCLUDE = "query || '，是否包含滅焰毯、' || coalesce(substr(query, 3, 6), '') || '與哪些呢？'"
_FOCUS = rf"""w AS (SELECT case_id, unnest(regexp_extract_all(x, '(?:包含|包括|涵蓋|納入)[{_WS}]*([\x{{3400}}-\x{{9fff}}A-Za-z0-9（）()、與和及]{{2,30}})', 1)) AS m, x FROM u),
p AS (SELECT case_id, unnest(string_split_regex(regexp_replace(m, '(?:嗎|呢|之內|在內)$', ''), '[、與和及]')) AS y FROM w),
focus AS (SELECT DISTINCT case_id, regexp_replace(y, '^[ ，、:：?？!！。]+|[ ，、:：?？!！。]+$', '', 'g') AS t FROM p),
fo AS (SELECT case_id, t FROM focus WHERE length(t) BETWEEN 2 AND 20 AND t NOT IN ({", ".join(f"'{x}'" for x in X.NO_OBJECTS)}))"""


def _including(spark, d):
    return _cases(spark, d).select("case_id", F.concat("query", F.lit("，是否包含滅焰毯、"), F.substring("query", 3, 6), F.lit("與哪些呢？")).alias("x"))


@query(f"WITH u AS (SELECT case_id, {_INCLUDE} AS x FROM {_CASES}), {_FOCUS} SELECT case_id, t AS term FROM fo")
def focus_terms(spark, d):
    return _including(spark, d).select("case_id", F.explode(X.focus_terms(F.col("x"))).alias("term"))


@query(
    f"""WITH u AS (SELECT case_id, {_INCLUDE} AS x FROM {_CASES}), {_FOCUS},
c AS (SELECT case_id, regexp_replace(unnest(string_split_regex(x, '[?？!！;；。]+')), '^[ ，、:：]+|[ ，、:：]+$', '', 'g') AS t FROM u)
SELECT case_id, t AS facet FROM c WHERE length(t) >= 2 UNION SELECT case_id, t FROM fo"""
)
def query_facets(spark, d):
    return _including(spark, d).select("case_id", F.explode(X.facets(F.col("x"))).alias("facet"))


_EXH = "query || '所有懲處規定，不同場所遴用防火管理人'"


@query(
    f"""WITH u AS (SELECT case_id, {_EXH} AS x FROM {_CASES} UNION ALL SELECT case_id + 100000, query FROM {_CASES})
SELECT case_id, CASE WHEN NOT regexp_matches({_sq('x')}, '第[{X.HINT_NUMERALS}0-9\\-之]+條') AND {_any(_sq('x'), X.EXHAUSTIVE_MARKERS)} AND {_any(_sq('x'), X.PENALTY_MARKERS)} THEN '罰則' END AS heading,
x || CASE WHEN {_any(_sq('x'), X.PENALTY_MARKERS)} THEN ' {X.PENALTY_WORDS}' ELSE '' END || CASE WHEN contains({_sq('x')}, '防火管理人') AND {_any(_sq('x'), X.SEVERAL_PLACES)} AND {_any(_sq('x'), X.APPOINTING)} THEN ' 不同場所 兼任' ELSE '' END AS expanded FROM u"""
)
def query_expansion(spark, d):
    """Section headings and expanded words of all queries, also with a request for all penalties."""
    q = _cases(spark, d)
    u = q.select("case_id", F.concat("query", F.lit("所有懲處規定，不同場所遴用防火管理人")).alias("x")).unionByName(q.select((F.col("case_id") + 100000).alias("case_id"), F.col("query").alias("x")))
    return u.select("case_id", X.section_heading(F.col("x")).alias("heading"), X.expand_query(F.col("x")).alias("expanded"))


@query(f"WITH t AS (SELECT case_id, regexp_replace(regexp_replace(query, '[{_WS}]+', ' ', 'g'), '^ | $', '', 'g') AS x FROM {_CASES}) SELECT case_id, CASE WHEN x = '' THEN '新對話' WHEN length(x) > 38 THEN substr(x, 1, 37) || '…' ELSE x END AS title FROM t")
def conversation_titles(spark, d):
    return _cases(spark, d).select("case_id", V.conversation_title(F.col("query")).alias("title"))


@query(
    f"""WITH u AS (SELECT case_id, '　/WEB ' || query AS x FROM {_CASES} UNION ALL SELECT case_id + 100000, '/website ' || query FROM {_CASES}), t AS (SELECT case_id, {_trim('x')} AS x FROM u)
SELECT case_id, CASE WHEN regexp_matches(x, '^/[wW][eE][bB](?:[{_WS}]|$)') THEN {_trim("substr(x, 5)")} ELSE x END AS query, CASE WHEN regexp_matches(x, '^/[wW][eE][bB](?:[{_WS}]|$)') THEN 'force' ELSE 'auto' END AS mode FROM t"""
)
def web_directives(spark, d):
    """All queries with the directive before them, and with a word that only begins like it."""
    q = _cases(spark, d)
    u = q.select("case_id", F.concat(F.lit("　/WEB "), "query").alias("x")).unionByName(q.select((F.col("case_id") + 100000).alias("case_id"), F.concat(F.lit("/website "), "query").alias("x")))
    return u.select("case_id", A.web_request(F.col("x"), F.lit("auto")).alias("r")).select("case_id", "r.query", "r.mode")


# ---- hits


@query(
    f"""WITH {_HITS}, r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY length(content) DESC, chunk_id) AS rank FROM hits),
o AS (SELECT hits.query_id, hits.chunk_id, row_number() OVER (PARTITION BY hits.query_id ORDER BY CASE WHEN rank <= 3 THEN rank END NULLS LAST, pos, hits.chunk_id) AS place FROM hits JOIN r USING (query_id, chunk_id)) SELECT query_id, chunk_id, place FROM o WHERE place <= 8"""
)
def rerank_order(spark, d):
    """Hits with the three longest put first by a ranking, the rest behind in their own order."""
    h = _hits(spark, d)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.length("content")), "chunk_id")
    ranked = h.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("query_id", "chunk_id", "rank")
    return S.rerank(h, ranked, 8).select("query_id", "chunk_id", "place")


@query(
    f"""WITH {_HITS}, n AS (SELECT query_id, law_title AS t, article_label AS a FROM hits WHERE pos <= 8), e AS (SELECT DISTINCT case_id, expected_law, expected_article FROM eval_cases SEMI JOIN q ON case_id = query_id),
j AS (SELECT case_id, coalesce(contains(lower({_sq('t')}), lower({_sq('expected_law')})), FALSE) AS law, coalesce(lower({_sq('coalesce(a, chr(32))')}) = lower({_sq('expected_article')}), FALSE) AS art, {_sq("coalesce(expected_article, ' ')")} <> '' AS has FROM e LEFT JOIN n ON query_id = case_id),
p AS (SELECT case_id, max(law) AS law_hit, max(CASE WHEN has THEN law AND art END) AS article_hit FROM j GROUP BY 1)
SELECT count(*) AS cases, round(avg(CAST(law_hit AS INTEGER)), 6) AS law_hit_rate, round(avg(CAST(article_hit AS INTEGER)), 6) AS article_hit_rate FROM p"""
)
def bm25_eval(spark, d):
    """The shares of cases whose law, and law and article, are among the eight best by words."""
    cases = table(spark, d, "eval_cases").dropDuplicates(["case_id"]).select(F.col("case_id").alias("query_id"), "expected_law", "expected_article").join(_asked(spark, d).select("query_id"), "query_id", "left_semi")
    return R.evaluate(_hits(spark, d, 8), cases)


@query("SELECT DISTINCT case_id, CASE WHEN case_id = 5 THEN '5' ELSE CAST(case_id AS VARCHAR) || ' 5' END AS ids FROM eval_cases")
def ranked_ids(spark, d):
    """The ids in a model's answer with words around it, repeated ids and such that are none."""
    said = F.concat(F.lit('好的：{"ranked_chunk_ids": ['), F.col("case_id").cast("string"), F.lit(', "5", true, null, "x", 5]} 以上'))
    return table(spark, d, "eval_cases").select("case_id").distinct().select("case_id", F.array_join(S.ranked_ids(said).cast("array<string>"), " ").alias("ids"))


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND (contains(lower(text), '滅焰毯') OR contains(lower(text), 'mtb'))")
def relevant_results(spark, d):
    """All documents as web results of queries for two objects."""
    docs = table(spark, d, "documents").where("text is not null")
    found = docs.select(F.col("doc_id").alias("query_id"), F.lit("題").alias("title"), F.concat(F.lit("https://a.example/"), F.col("doc_id").cast("string")).alias("url"), F.col("text").alias("content"), F.lit(None).cast("string").alias("source_date"))
    focus = docs.select(F.col("doc_id").alias("query_id"), F.array(F.lit("滅焰毯"), F.lit("MTB")).alias("focus"))
    return S.relevant_results(found, focus).select(F.col("query_id").alias("doc_id"))


_WEB_DATE = rf"((?:法規命令發布(?:\([^)]*\))?日|發文日期|公告日期|發布日期|修正日期)[^0-9\n]{{0,24}}(?:中華民國|民國)?[{_WS}]*(\d{{2,4}})[{_WS}]*(?:年|[-/.])[{_WS}]*(\d{{1,2}})[{_WS}]*(?:月|[-/.])[{_WS}]*(\d{{1,2}}))"


@query(
    f"""WITH t AS (SELECT DISTINCT version_id, substr(raw_text, 1, 4000) AS x FROM law_versions WHERE raw_text IS NOT NULL),
p AS (SELECT version_id, regexp_extract(x, '{_WEB_DATE}', 2) AS y, regexp_extract(x, '{_WEB_DATE}', 3) AS m, regexp_extract(x, '{_WEB_DATE}', 4) AS dd, regexp_extract(x, '{_WEB_DATE}', 1) AS s FROM t)
SELECT version_id, CASE WHEN y <> '' THEN try_cast(lpad(CAST(CASE WHEN CAST(y AS INTEGER) < 1911 THEN CAST(y AS INTEGER) + 1911 ELSE CAST(y AS INTEGER) END AS VARCHAR), 4, '0') || '-' || lpad(m, 2, '0') || '-' || lpad(dd, 2, '0') AS DATE)::VARCHAR END AS source_date,
CASE WHEN y <> '' THEN regexp_extract(s, '^([^0-9\\s：:]+)', 1) END AS label FROM p"""
)
def web_source_dates(spark, d):
    v = _versions(spark, d, "raw_text").where("raw_text is not null").select("version_id", E.source_date(F.col("raw_text")).alias("s"))
    return v.select("version_id", F.col("s.date").cast("string").alias("source_date"), F.col("s.label").alias("label"))


# ---- answers


@query(
    f"""WITH m(model, c, o, f) AS (VALUES ('a', 8192, 2048, NULL), ('b', 16384, 4096, 12000), ('c', 262144, 8192, 262144)), p AS (SELECT case_id, CASE case_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'd' END AS model, query AS prompt FROM {_CASES}),
j AS (SELECT case_id, least(coalesce(c, 4096), coalesce(f, c, 4096)) AS context_tokens, coalesce(o, 2048) AS configured_output, greatest(1, length(prompt), CAST(ceil(strlen(prompt) / 3.0) AS INTEGER)) AS n FROM p LEFT JOIN m USING (model))
SELECT case_id, CAST(context_tokens AS BIGINT) AS context_tokens, CAST(configured_output AS BIGINT) AS configured_output, CAST(n AS BIGINT) AS prompt_tokens, CAST(greatest(64, least(configured_output, greatest(64, context_tokens - n - 512))) AS BIGINT) AS effective_output FROM j"""
)
def token_limits(spark, d):
    """The limits of four models, one of them unknown, for all queries as prompts."""
    m = spark.createDataFrame([("a", 8192, 2048, None), ("b", 16384, 4096, 12000), ("c", 262144, 8192, 262144)], "model string, context_tokens int, output_tokens int, found_context int")
    model = F.element_at(F.array(*map(F.lit, "abcd")), (F.col("case_id") % 4 + 1).cast("int"))
    p = _cases(spark, d).select("case_id", model.alias("model"), F.col("query").alias("prompt"))
    limits = A.token_limits(p.select("model", "prompt").distinct(), m)
    long = [F.col(c).cast("long").alias(c) for c in ("context_tokens", "configured_output", "prompt_tokens", "effective_output")]
    return p.join(limits, ["model", "prompt"]).select("case_id", *long)


@query("SELECT CAST(max(greatest(length(text), 1)) AS BIGINT) AS context_tokens FROM documents WHERE text IS NOT NULL")
def longest_context(spark, d):
    """The largest context among models that are as large as the documents are long."""
    n = table(spark, d, "documents").where("text is not null").select(F.greatest(F.length("text"), F.lit(1)).cast("long").alias("context_tokens"), F.lit(None).cast("long").alias("found_context"))
    return G.longest_context(n)


@query("SELECT DISTINCT chunk_id, CASE WHEN seq % 5 BETWEEN 1 AND 3 THEN '/app/static/local-pdfs/' || sha256(CAST(chunk_id AS VARCHAR)) || '.pdf#page=' || CAST(seq % 5 AS INTEGER) END AS link FROM law_chunks")
def pdf_links(spark, d):
    """The links of chunks as pages 0 to 4 of PDFs with three pages."""
    c = table(spark, d, "law_chunks").select("chunk_id", "seq").distinct()
    meta = F.to_json(F.struct(F.concat(F.sha2(F.col("chunk_id").cast("string"), 256), F.lit(".pdf")).alias("local_pdf_name"), F.lit(3).alias("pdf_page_count")))
    return c.select("chunk_id", A.pdf_link(meta, F.concat(F.lit("第"), (F.col("seq") % 5).cast("string"), F.lit("頁"))).alias("link"))


_EID = "'A00001,x,' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || ',' || strftime(collected_at, '%Y%m%d')"


@query(f"SELECT doc_id, {_EID} AS eid, '民國' || CAST(year(collected_at) - 1911 AS VARCHAR) || '年' || CAST(month(collected_at) AS VARCHAR) || '月' || CAST(day(collected_at) AS VARCHAR) || '日' AS issued FROM documents")
def letter_ids(spark, d):
    """The ids in the addresses of letters made of all documents, and their dates."""
    eid = F.concat(F.lit("A00001,x,"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit(","), F.date_format("collected_at", "yyyyMMdd"))
    t = table(spark, d, "documents").select("doc_id", F.concat(F.lit("https://a.example/F/letter.aspx?EID="), eid).alias("url"))
    return t.select("doc_id", A.letter_id(F.col("url"), "a.example", "/f/Letter.aspx").alias("eid")).withColumn("issued", I.letter_date(F.col("eid")))


# ---- addresses

_PART = "regexp_extract({u}, '^([a-zA-Z]+)://([^/?#]*)([^?#]*)', {i})"
_LSID = "upper(regexp_extract(url, '(?i)[?&]lsid=([^&#]*)', 1))"


@query(
    r"""WITH u AS (SELECT DISTINCT page_id, regexp_extract(url, '[?]([^#]*)', 1) AS q FROM fetched_pages), p AS (SELECT page_id, unnest(string_split(q, '&')) AS p FROM u)
SELECT page_id, lower(regexp_extract(p, '^([^=]*)', 1)) AS name, url_decode(replace(regexp_extract(p, '^[^=]*=?(.*)$', 1), '+', ' ')) AS value, CAST(count(*) AS BIGINT) AS n FROM p WHERE p <> '' GROUP BY ALL"""
)
def url_parameters(spark, d):
    u = table(spark, d, "fetched_pages").select("page_id", "url").distinct()
    return u.select("page_id", F.explode(U.parameters(F.col("url"))).alias("p")).groupBy("page_id", "p.name", "p.value").agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT page_id, CASE WHEN {_LSID} <> '' THEN {_PART.format(u='url', i=1)} || '://' || {_PART.format(u='url', i=2)} || '/print.aspx?lsid=' || {_LSID} || CASE WHEN regexp_extract(url, '(?i)[?&]ldate=([^&#]*)', 1) <> '' THEN '&ldate=' || regexp_extract(url, '(?i)[?&]ldate=([^&#]*)', 1) ELSE '' END END AS print_url FROM fetched_pages")
def print_urls(spark, d):
    return table(spark, d, "fetched_pages").select("page_id", U.print_url(F.col("url")).alias("print_url")).distinct()


@query(f"SELECT DISTINCT page_id, CASE WHEN {_LSID} <> '' THEN contains(lower({_PART.format(u='url', i=3)}), 'law') OR contains(lower({_PART.format(u='url', i=3)}), '/print') ELSE regexp_matches(lower({_PART.format(u='url', i=3)}), 'law|detail|content|show|view') END AS detail FROM fetched_pages")
def detail_urls(spark, d):
    return table(spark, d, "fetched_pages").select("page_id", U.is_detail_url(F.col("url")).alias("detail")).distinct()


# ---- hybrid search with vectors that SQL can make

_PLAIN = f"regexp_replace({_TIDY}, '[{_WS}]+', ' ', 'g')"


def _tok(x: str) -> str:
    return f"unnest(regexp_extract_all(lower({x}), '[\\x{{3400}}-\\x{{9fff}}A-Za-z0-9]+'))"


_ALL_CJK = "regexp_full_match(t, '[\\x{3400}-\\x{9fff}]+')"
_RUN = "regexp_replace(lex, '[^\\x{3400}-\\x{9fff}]', '', 'g')"
_FOCUS_OF_LEX = _FOCUS.replace("w AS (SELECT", "fw AS (SELECT").replace("FROM u)", "FROM fu)").replace("p AS (SELECT", "fp AS (SELECT").replace("FROM w)", "FROM fw)").replace("FROM p)", "FROM fp)")
_CASES_ONCE = "SELECT min(case_id) AS query_id, query FROM eval_cases WHERE query IS NOT NULL GROUP BY query"
_HYBRID = rf"""{_CUR}, q0 AS ({_CASES_ONCE}), q AS (SELECT query_id, {_PLAIN} AS query FROM q0),
lx AS (SELECT query_id, query || CASE WHEN {_any(_sq('query'), X.PENALTY_MARKERS)} THEN ' {X.PENALTY_WORDS}' ELSE '' END || CASE WHEN contains({_sq('query')}, '防火管理人') AND {_any(_sq('query'), X.SEVERAL_PLACES)} AND {_any(_sq('query'), X.APPOINTING)} THEN ' 不同場所 兼任' ELSE '' END AS lex FROM q),
qx AS (SELECT query_id, lex AS query FROM lx), {_TITLES}, {_index_sql('cur', 'chunk_id', list(R.INDEXED))}, {_BM25},
pairs AS (SELECT query_id, doc AS chunk_id FROM top WHERE rank <= 300 UNION SELECT query_id, chunk_id FROM best JOIN cur ON law_title = title),
vt AS (SELECT 'q' AS kind, query_id AS id, {_sq('lower(query)')} AS t FROM q UNION ALL SELECT 'd', chunk_id, {_sq("lower(coalesce(law_title, '') || ' ' || coalesce(heading, '') || ' ' || coalesce(article_label, '') || ' ' || content)")} FROM cur),
vg AS (SELECT kind, id, substr(t, i, n) AS g FROM (SELECT kind, id, t, n, unnest(range(1, length(t) - n + 2)) AS i FROM vt, (SELECT unnest([1, 2, 3]) AS n))),
vh AS (SELECT kind, id, ('0x' || substr(md5(g), 1, 8))::BIGINT AS h FROM vg),
vs AS (SELECT kind, id, h % 64 AS bucket, sum(CASE WHEN h >= 2147483648 THEN -1 ELSE 1 END) AS s FROM vh GROUP BY ALL HAVING s <> 0),
hv AS (SELECT kind, id, bucket, s / sqrt(sum(s * s) OVER (PARTITION BY kind, id)) AS x FROM vs),
vec AS (SELECT query_id, chunk_id, greatest(0, least(1, sum(a.x * b.x))) AS vec FROM pairs JOIN hv a ON a.kind = 'q' AND a.id = query_id JOIN hv b ON b.kind = 'd' AND b.id = chunk_id AND b.bucket = a.bucket GROUP BY 1, 2),
qt0 AS (SELECT query_id, {_tok('query')} AS t FROM qx), qg0 AS (SELECT query_id, t AS term FROM qt0 WHERE NOT {_ALL_CJK} UNION SELECT query_id, substr(t, i, n) FROM (SELECT query_id, t, n, unnest(range(1, length(t) - n + 2)) AS i FROM qt0, (SELECT unnest([2, 3]) AS n)) WHERE {_ALL_CJK}),
qn0 AS (SELECT query_id, count(*) AS n FROM qg0 GROUP BY 1),
ft AS (SELECT chunk_id, 'c' AS f, {_tok('content')} AS t FROM cur UNION ALL SELECT chunk_id, 'h', {_tok("coalesce(heading, '')")} FROM cur UNION ALL SELECT chunk_id, 't', {_tok('law_title')} FROM cur),
fg AS (SELECT chunk_id, f, t AS term FROM ft WHERE NOT {_ALL_CJK} UNION SELECT chunk_id, f, substr(t, i, n) FROM (SELECT chunk_id, f, t, n, unnest(range(1, length(t) - n + 2)) AS i FROM ft, (SELECT unnest([2, 3]) AS n)) WHERE {_ALL_CJK}),
sh AS (SELECT query_id, chunk_id, f, count(*) AS c FROM pairs JOIN fg USING (chunk_id) JOIN qg0 USING (query_id, term) GROUP BY 1, 2, 3),
words AS (SELECT query_id, chunk_id, max(CASE f WHEN 'c' THEN c / n::DOUBLE WHEN 'h' THEN c / n::DOUBLE * 0.9 ELSE c / n::DOUBLE * 0.8 END) AS s FROM sh JOIN qn0 USING (query_id) GROUP BY 1, 2),
dq AS (SELECT query_id, {_RUN} AS run, {_any('lex', X.DEFINITION_MARKERS)} AS explicit FROM lx WHERE {_any('lex', X.DEFINITION_MARKERS)} OR (NOT {_any('lex', X.ACTION_MARKERS)} AND ({_any('lex', X.IDENTITY_MARKERS)} OR (contains(lex, '的') AND length({_RUN}) BETWEEN 1 AND 30)))),
dd AS (SELECT chunk_id, unnest(regexp_extract_all(content, '所稱[{_WS}]*([\x{{3400}}-\x{{9fff}}A-Za-z0-9（）()]{{2,24}}?)[{_WS}]*(?:，|、|：|:|係指|是指)', 1)) AS term FROM cur),
dfn AS (SELECT query_id, chunk_id, max(CASE WHEN contains(run, term) THEN 1.0 WHEN explicit THEN 0.55 ELSE 0.0 END)::DOUBLE AS s FROM pairs JOIN dq USING (query_id) JOIN dd USING (chunk_id) GROUP BY 1, 2),
fu AS (SELECT query_id AS case_id, lex AS x FROM lx), {_FOCUS_OF_LEX},
foc AS (SELECT query_id, chunk_id, 1.0::DOUBLE AS s FROM pairs JOIN cur USING (chunk_id) JOIN fo ON case_id = query_id WHERE contains(lower(concat_ws(' ', law_title, article_label, heading, content)), lower(t)) GROUP BY 1, 2),
ah AS (SELECT query_id, unnest(regexp_extract_all(lex, '第[{_WS}]*[{X.HINT_NUMERALS}0-9\-之]+[{_WS}]*條(?:[{_WS}]*之[{_WS}]*[一二三四五六七八九十百千0-9]+)?')) AS article_label FROM lx),
ha AS (SELECT query_id, min({_CANON}) AS hint FROM ah GROUP BY 1 HAVING count({_CANON}) = 1), ca AS (SELECT chunk_id, {_CANON} AS canonical FROM cur),
art AS (SELECT query_id, chunk_id, 1.0::DOUBLE AS s FROM pairs JOIN ha USING (query_id) JOIN ca USING (chunk_id) WHERE hint = canonical),
sc0 AS (SELECT query_id, chunk_id, coalesce(vec, 0) AS vec, least(1, least(1, greatest(coalesce(words.s, 0), coalesce(dfn.s, 0), coalesce(art.s, 0), coalesce(foc.s, 0))) + CASE WHEN best.title IS NULL THEN 0 ELSE 0.12::DOUBLE END) AS lex, law_title, article_label
FROM pairs JOIN cur USING (chunk_id) LEFT JOIN vec USING (query_id, chunk_id) LEFT JOIN words USING (query_id, chunk_id) LEFT JOIN dfn USING (query_id, chunk_id) LEFT JOIN art USING (query_id, chunk_id) LEFT JOIN foc USING (query_id, chunk_id) LEFT JOIN best ON best.query_id = pairs.query_id AND title = law_title),
sm AS (SELECT *, CAST(round(vec * 1e6) AS BIGINT) AS vm, CAST(round(lex * 1e6) AS BIGINT) AS lm FROM sc0), hy AS (SELECT *, (vm * 300 + lm * 700 + 500) // 1000 AS hm FROM sm),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hm DESC, chunk_id) AS pos FROM hy)"""


@query(f"WITH {_HYBRID} SELECT query_id, pos, chunk_id, vm / 1e6 AS vector_score, lm / 1e6 AS lexical_score, hm / 1e6 AS hybrid_score FROM ranked WHERE pos <= 8")
def hybrid_md5_topk(spark, d):
    """The best provisions of all queries by words and MD5 vectors together."""
    h = R.hybrid_topk(_asked(spark, d), _index(spark, d, R.md5_embedding), 8, embed=R.md5_embedding)
    return h.select("query_id", "pos", "chunk_id", "vector_score", "lexical_score", "hybrid_score")


_WITH_TITLES = _HYBRID.replace(f"q0 AS ({_CASES_ONCE})", f"q0 AS ({_CASES_ONCE} UNION ALL SELECT 1000000 + min(law_id), law_title || '第三條' FROM l GROUP BY law_title)")


@query(
    f"""WITH {_WITH_TITLES}, sp AS (SELECT query_id, min(title) AS title FROM best GROUP BY 1 HAVING count(*) = 1), sc1 AS (SELECT query_id, title, hint FROM sp JOIN ha USING (query_id)),
ex AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY law_title, seq, chunk_id) AS pos, chunk_id FROM sc1 JOIN cur ON law_title = title JOIN ca USING (chunk_id) WHERE canonical = hint)
SELECT query_id, pos, chunk_id, 'exact_article' AS retrieval_mode, 1.0::DOUBLE AS hybrid_score FROM ex WHERE pos <= 8 UNION ALL SELECT query_id, pos, chunk_id, 'hybrid', hm / 1e6 FROM ranked WHERE pos <= 8 AND query_id NOT IN (SELECT query_id FROM sc1)"""
)
def routed_md5_search(spark, d):
    """All queries, and the third article of every title: exact where a query names one article of one law."""
    titles = _laws(spark, d).groupBy("title").agg((F.min("law_id") + 1000000).alias("query_id")).select("query_id", F.concat("title", F.lit("第三條")).alias("query"))
    asked = _asked(spark, d).unionByName(titles)
    return R.search(asked, _index(spark, d, postings=False), 8, hybrid=scan.hybrid_topk, embed=R.md5_embedding).select("query_id", "pos", "chunk_id", "retrieval_mode", "hybrid_score")


@query(
    f"""WITH {_HYBRID}, n AS (SELECT query_id, law_title AS t, article_label AS a FROM ranked WHERE pos <= 8), e AS (SELECT DISTINCT case_id, expected_law, expected_article FROM eval_cases SEMI JOIN q0 ON case_id = query_id),
j AS (SELECT case_id, coalesce(contains(lower({_sq('t')}), lower({_sq('expected_law')})), FALSE) AS law, coalesce(lower({_sq('coalesce(a, chr(32))')}) = lower({_sq('expected_article')}), FALSE) AS art, {_sq("coalesce(expected_article, ' ')")} <> '' AS has FROM e LEFT JOIN n ON query_id = case_id),
p AS (SELECT case_id, max(law) AS law_hit, max(CASE WHEN has THEN law AND art END) AS article_hit FROM j GROUP BY 1)
SELECT count(*) AS cases, round(avg(CAST(law_hit AS INTEGER)), 6) AS law_hit_rate, round(avg(CAST(article_hit AS INTEGER)), 6) AS article_hit_rate FROM p"""
)
def retrieval_md5_eval(spark, d):
    """The shares of cases whose law, and law and article, are among the eight best by words and vectors."""
    cases = table(spark, d, "eval_cases").dropDuplicates(["case_id"]).select(F.col("case_id").alias("query_id"), "expected_law", "expected_article").join(_asked(spark, d).select("query_id"), "query_id", "left_semi")
    return R.evaluate(R.hybrid_topk(_asked(spark, d), _index(spark, d, R.md5_embedding), 8, embed=R.md5_embedding), cases)
