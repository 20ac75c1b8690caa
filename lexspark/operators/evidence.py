"""Evidence for answers: which search each query takes, reranking behind a client, exhaustive sections with their coverage, web results.

Clients (language model, web search) are functions that are passed in; everything else is a plan over tables of queries.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexspark.functions import text as X
from lexspark.functions import urls as U
from lexspark.operators import retrieval as R
from lexspark.operators import selection as S
from lexspark.runtime import cut

HIT = ["query_id", "chunk_id", "law_id", "law_title", "version_no", "article_label", "heading", "content", "source_url", "hybrid_score", "retrieval_mode"]
#: Candidates before reranking, candidates and characters of each that the reranker sees, hits of a facet.
LIMIT, RERANK_INPUT, RERANK_CHARS, FACET_HITS = 24, 12, 160, 8


def facet_list(query: Column) -> Column:
    """What a query's evidence must hold: the objects it asks about, else its clauses after the first."""
    focus = X.focus_terms(query)
    return F.when(F.size(focus) > 0, focus).otherwise(F.slice(X.facets(query), 2, 1_000))


def needs_facets(query: Column) -> Column:
    return (F.size(X.focus_terms(query)) > 0) | (F.size(X.facets(query)) > 1) | X.is_broad_query(query)


def rerank_prompt(query: Column, passages: Column, k: int) -> Column:
    """The prompt for a reranker: the question, the candidates by id, and the form of the answer."""
    rules = f'請依下列問題，從候選條文中挑出最能直接回答的 {k} 筆，依序排列。只能使用候選的數字編號；只輸出 JSON：{{"ranked_chunk_ids":[編號,…]}}。'
    return F.concat(F.lit(rules + "\n問題："), query, F.lit("\n候選：\n"), passages)


def rerank_prompts(candidates: DataFrame, queries: DataFrame, k: int, chars: int = RERANK_CHARS) -> DataFrame:
    """``query_id, prompt``: one prompt a query over its candidates (with ``slot``), their contents on one line and cut to ``chars``."""
    line = F.concat(F.lit("["), F.col("chunk_id").cast("string"), F.lit("] "), F.concat_ws("|", "law_title", F.coalesce("article_label", "heading", F.lit("-")), F.substring(F.regexp_replace("content", r"(?U)\s+", " "), 1, chars)))
    one = candidates.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", line.alias("x")))), lambda r: r["x"]), "\n").alias("passages"))
    return one.join(queries.select("query_id", "query"), "query_id").select("query_id", rerank_prompt(F.col("query"), F.col("passages"), k).alias("prompt"))


def completions(prompts: DataFrame, complete: Callable[[str], str], id_col: str = "query_id") -> DataFrame:
    """``query_id, answer``: what a client says to each prompt; null where it fails."""

    def run(batches):
        for pdf in batches:
            out = []
            for p in pdf["prompt"]:
                try:
                    out.append(complete(p))
                except Exception:  # noqa: BLE001 - a client's failure is one query's, not the job's
                    out.append(None)
            yield pd.DataFrame({id_col: pdf[id_col], "answer": pd.Series(out, dtype=object)})

    return prompts.select(id_col, "prompt").mapInPandas(run, f"{id_col} long, answer string")


def llm_rerank(hits: DataFrame, queries: DataFrame, k: int, complete: Callable[[str], str], limit: int = RERANK_INPUT) -> DataFrame:
    """The first k hits of each query in the order that a client gives; ``place``.

    The client sees the leaders and the hits most likely to answer. Ids that are no candidate's count for nothing; where the client
    fails, or names none, the hits keep their order, and so do those of queries with at most k.
    """
    many = hits.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") > k).select("query_id")
    chosen = S.rerank_candidates(hits.join(many, "query_id", "left_semi"), k, limit)
    said = completions(rerank_prompts(chosen, queries, k), complete).where("answer is not null")
    ids = said.select("query_id", F.posexplode(S.ranked_ids(F.col("answer"))).alias("rank", "chunk_id")).join(chosen.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")
    return S.rerank(hits, ids, k)


def ranked_hits(queries: DataFrame, index: R.Index, k: int = 8, limit: int = LIMIT, complete: Callable[[str], str] | None = None, **options) -> DataFrame:
    """The evidence of each query (``query_id, query``), k hits at most, by ``place``.

    Queries that name one article of one law get exactly that. Comparisons go through the reranker where there is one, queries about
    several things get places for each, all others the best hits. A query is searched once, facets once more.
    """
    scope = cut(R.article_scope(queries, index.table("titles")))
    w = Window.partitionBy("query_id").orderBy("law_title", "seq", "chunk_id")
    exact = R.exact_article(scope, index.table("docs")).withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= k)
    q = queries.join(scope.select("query_id"), "query_id", "left_anti")
    q = q.withColumns({"compare": X.is_comparison_query(F.col("query")) if complete else F.lit(False), "wide": needs_facets(F.col("query"))})
    base = cut(R.hybrid_topk(q, index, max(k, limit), **options).select(*HIT, "pos"))  # some 24 hits a query, read by all ways below
    plain = base.join(q.where("not compare and not wide").select("query_id"), "query_id", "left_semi").withColumn("place", F.col("pos")).where(F.col("place") <= k)
    out = exact.select(*HIT, "place").unionByName(plain.select(*HIT, "place"))
    wide = q.where("wide and not compare").select("query_id", "query")
    own = base.join(wide.select("query_id"), "query_id", "left_semi")
    facets = wide.select("query_id", F.posexplode(facet_list(F.col("query"))).alias("facet_no", "facet")).withColumn("fid", F.xxhash64("query_id", "facet_no"))
    found = R.hybrid_topk(facets.select(F.col("fid").alias("query_id"), F.col("facet").alias("query")), index, min(max(k, 3), FACET_HITS), **options).select(*HIT, "pos")
    found = found.withColumnRenamed("query_id", "fid").join(facets, "fid").drop("fid")
    # A law is meant among those that the query's own hits come from.
    named = R.title_matches(wide, index.table("titles")).join(own.select("query_id", F.col("law_title").alias("title")).distinct(), ["query_id", "title"], "left_semi")
    covered = S.with_coverage(own, found, wide, R.longest_titles(named), k).withColumn("retrieval_mode", F.lit("hybrid"))
    out = out.unionByName(covered.select(*HIT, "place"))
    if complete:
        compared = q.where("compare").select("query_id", "query")
        again = llm_rerank(base.join(compared.select("query_id"), "query_id", "left_semi"), compared, k, complete)
        out = out.unionByName(again.select(*HIT, "place"))
    return out


def sections(queries: DataFrame, index: R.Index) -> DataFrame:
    """All provisions of the section that an exhaustive query of one law asks for, by ``place``, with the section's law and heading.

    The heading that is looked for is in ``heading_term``, if ``queries`` has such a column.
    """
    term = F.col("heading_term") if "heading_term" in queries.columns else X.section_heading(F.col("query"))
    asked = queries.withColumn("heading_term", term).where("heading_term is not null")
    one = R.matched_titles(asked, index.table("titles")).groupBy("query_id").agg(F.min("title").alias("title"), F.count("*").alias("n")).where("n = 1")
    hits = R.section_search(one.join(asked.select("query_id", "heading_term"), "query_id").select("query_id", "title", "heading_term"), index.table("docs"))
    order = Window.partitionBy("query_id").orderBy("seq", "chunk_id")
    first = F.first("heading").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return hits.withColumns({"place": F.row_number().over(order).cast("long"), "scope_heading": first, "scope_law_title": F.col("law_title"), "hybrid_score": F.lit(0.0)})


def answer_evidence(queries: DataFrame, index: R.Index, k: int = 8, complete: Callable[[str], str] | None = None, **options) -> DataFrame:
    """The hits of each query with what they cover: ``mode, requested_top_k, total_matches, complete, scope_law_title, scope_heading``.

    A query for all provisions of a section gets all of them, and ``complete`` is true; of the other ways it is null, as nobody knows
    what else there is. A query without hits has no row here.
    """
    full = cut(sections(queries, index).select(*HIT, "place", "scope_law_title", "scope_heading"))
    rest = queries.join(full.select("query_id").distinct(), "query_id", "left_anti")
    none = F.lit(None).cast("string")
    hits = ranked_hits(rest, index, k, complete=complete, **options).withColumns({"scope_law_title": none, "scope_heading": none})
    both = full.unionByName(hits.select(*full.columns))
    w = Window.partitionBy("query_id")
    structural, exact = (F.bool_and(F.col("retrieval_mode") == m).over(w) for m in ("structural_section", "exact_article"))
    mode = F.when(structural, "structural_section").when(exact, "exact_article").otherwise("hybrid")
    return both.withColumns({"mode": mode, "requested_top_k": F.lit(k), "total_matches": F.count("*").over(w), "complete": F.when(structural, True)})


# ---- web evidence

# The words before a source's date, and what names a year or several places.
DATE_LABELS = ("發文日期", "公告日期", "發布日期", "修正日期")
_RULE_DATE = r"法規命令發布(?:\([^)]*\))?日"


def source_date(content: Column) -> Column:
    """A struct (date, label) of the first valid date behind one of the labels in the first 4,000 characters; null if none."""
    pattern = rf"(?U)((?:{_RULE_DATE}|{'|'.join(DATE_LABELS)})[^0-9\n]{{0,24}}(?:中華民國|民國)?\s*\d{{2,4}}\s*(?:年|[-/.])\s*\d{{1,2}}\s*(?:月|[-/.])\s*\d{{1,2}})"
    found = F.regexp_extract_all(F.substring(content, 1, 4_000), F.lit(pattern), 1)

    def parse(s: Column) -> Column:
        p = [F.regexp_extract(s, r"(\d{2,4})\D+(\d{1,2})\D+(\d{1,2})$", i).cast("int") for i in (1, 2, 3)]
        year = F.when(p[0] < 1911, p[0] + 1911).otherwise(p[0])
        day = F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(p[1].cast("string"), 2, "0"), F.lpad(p[2].cast("string"), 2, "0")), "yyyy-MM-dd")
        return F.struct(day.alias("date"), F.regexp_extract(s, rf"^({_RULE_DATE}|[^0-9\s：:]+)", 1).alias("label"))

    return F.try_element_at(F.filter(F.transform(found, parse), lambda x: x["date"].isNotNull()), F.lit(1))


def announcement_topic(query: Column) -> Column:
    """What a query about an authority's announcement is about, at most 80 characters."""
    t = F.regexp_replace(F.trim(query), "^(?:請)?(?:搜尋|查詢|查找|找出|提供)", "")
    return F.substring(F.regexp_replace(F.regexp_replace(t, "(?:的)?(?:中央|地方)?主管機關公告.*$", ""), r"^[ ？?，,。]+|[ ？?，,。]+$", ""), 1, 80)


def followups(queries: DataFrame, first: DataFrame, domains: Sequence[str], latest_site: str = "", authority_site: str = "") -> DataFrame:
    """``query_id, followup``: a second, narrower search for queries whose sources change: announcements, newest versions, shared duties.

    ``first`` has the first search's results (``query_id, pos, title, url``). An announcement is searched by the title that a result
    on an allowed domain quotes (if it holds the topic), on the first such result's domain. Queries that name a year, unless they ask
    for the newest, get none.
    """
    q = queries.select("query_id", "query", announcement_topic(F.col("query")).alias("topic"), X.asks_announcement(F.col("query")).alias("announced"), X.asks_latest_law(F.col("query")).alias("newest"))
    q = q.where(~F.col("query").rlike(r"(?U)(?:民國|中華民國)?\s*\d{2,4}\s*年") | F.contains("query", F.lit("最新")))
    site = F.try_element_at(F.filter(F.array(*map(F.lit, sorted(domains, key=len, reverse=True))), lambda d: (F.col("h") == d) | F.endswith(F.col("h"), F.concat(F.lit("."), d))), F.lit(1))
    seen = first.where(U.allowed(F.col("url"), domains)).withColumn("h", U.host(F.col("url"))).withColumn("site", site)
    seen = seen.withColumn("quoted", F.regexp_extract("title", "[「『]([^」』]{4,80})[」』]", 1)).join(q.select("query_id", "topic"), "query_id")
    safe = F.col("quoted").rlike(r"(?U)^[\x{3400}-\x{9fff}A-Za-z0-9（）()、\s]+$") & ((F.length("topic") < 4) | F.contains("quoted", F.col("topic")))
    best = seen.groupBy("query_id").agg(F.min_by("site", "pos").alias("site"), F.min(F.when(safe, F.struct("pos", "quoted", "site"))).alias("named"))
    j = q.join(best, "query_id", "left")
    topic = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("named.quoted", "topic"), r"(?U)[^\x{3400}-\x{9fff}A-Za-z0-9（）()、\s]", " "), r"(?U)\s+", " "))
    office = F.when(F.contains("query", F.lit("中央主管機關")) | F.contains("query", F.lit("內政部")), "內政部").otherwise("")
    on = F.coalesce(F.concat(F.lit(" site:"), F.coalesce("named.site", "site")), F.lit(""))
    announced = F.when(F.length(topic) >= 4, F.trim(F.concat(topic, F.lit(" "), office, F.lit(" 修正 最新"), on)))
    newest = F.trim(F.concat(F.lit(f"site:{latest_site} " if latest_site else ""), "query", F.lit(" 現行 修正日期")))
    shared = F.contains("query", F.lit("防火管理人")) & F.col("query").rlike("(?:多個|不同|數個|兩個|二個|多處|兩處|二處|2處|２處)場所|跨場所")
    text = F.when(F.col("announced"), announced).when(F.col("newest"), newest).when(shared, F.lit("防火管理人 不同場所 共同遴用 一位" + (f" site:{authority_site}" if authority_site else "")))
    return j.select("query_id", text.alias("followup")).where("followup is not null")


def web_results(queries: DataFrame, first: DataFrame, focused: DataFrame, fetched: DataFrame, domains: Sequence[str], most: int = 3) -> DataFrame:
    """``query_id, place, title, url, content, source_date, source_date_label``: the web evidence of each query.

    ``first`` and ``focused`` (the second search's) have ``query_id, pos, title, url, content``; ``fetched`` has ``url, title,
    content`` of pages read. The second search's results come first; of each address the first, on allowed domains only, ``most`` a
    query; pages as read replace what the search showed. Results without any object asked about are left out. The newest come first
    where a second search was made for an announcement or a newest version.
    """
    w = Window.partitionBy("query_id").orderBy("way", "pos", "url")
    both = focused.withColumn("way", F.lit(0)).unionByName(first.withColumn("way", F.lit(1))).where(U.allowed(F.col("url"), domains))
    once = both.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "url").orderBy("way", "pos"))).where("n = 1")
    once = once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    full = lambda c: F.when(F.trim(c) != "", F.trim(c))
    pages = fetched.groupBy("url").agg(F.min_by(F.struct(full(F.col("title")).alias("title"), full(F.col("content")).alias("content")), F.struct("title", "content")).alias("page"))
    j = once.join(pages, "url", "left").join(queries.select("query_id", "query"), "query_id")
    j = j.withColumns({"title": F.coalesce("page.title", full(F.col("title")), "url"), "content": F.coalesce("page.content", full(F.col("content")), F.lit(""))})
    focus = X.focus_terms(F.col("query"))
    text = F.lower(F.concat_ws("\n", "title", "content"))
    j = j.where((F.size(focus) == 0) | F.exists(focus, lambda t: F.contains(text, F.lower(t)))).withColumn("found", source_date(F.col("content")))
    second = F.max((F.col("way") == 0).cast("int")).over(Window.partitionBy("query_id")) == 1
    dated = second & (X.asks_announcement(F.col("query")) | X.asks_latest_law(F.col("query")))
    j = j.withColumns({"source_date": F.col("found.date").cast("string"), "source_date_label": F.col("found.label"), "dated": dated})
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("dated"), F.coalesce("source_date", F.lit(""))).desc(), "place")
    return j.withColumn("place", F.row_number().over(order).cast("long")).select("query_id", "place", "title", "url", "content", "source_date", "source_date_label")


def web_context(results: DataFrame, local: DataFrame, limit: int = 5_000) -> DataFrame:
    """``query_id, context``: the web evidence, numbered on after the query's local hits (``local``: ``query_id, place``)."""
    before = local.groupBy("query_id").agg(F.count("*").alias("n"))
    dated = F.when(F.col("source_date").isNotNull(), F.concat(F.lit("來源日期（"), "source_date_label", F.lit("）："), "source_date"))
    number = F.concat(F.lit("["), (F.coalesce("n", F.lit(0)) + F.col("place")).cast("string"), F.lit("] 官方網頁補充資料"))
    block = F.concat_ws("\n", number, F.concat(F.lit("標題："), "title"), F.concat(F.lit("URL："), "url"), dated, F.substring("content", 1, limit))
    return results.join(before, "query_id", "left").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", block.alias("x")))), lambda r: r["x"]), "\n\n").alias("context"))
