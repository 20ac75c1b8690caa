"""Selection of evidence among ranked hits: dedupe, diversity, rerank candidates, coverage of facets, context and citations.

Hits have ``query_id, pos, chunk_id, law_id, law_title, version_no, article_label, heading, content, source_url, hybrid_score``;
``pos`` is the rank within the query, from 1.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexspark.functions import text as X


def evidence_key() -> list[Column]:
    label = X.squash(F.coalesce("article_label", F.lit("")))
    return [F.col("law_id"), F.when(label == "", F.col("chunk_id").cast("string")).otherwise(F.concat(F.lit("L"), label)), X.squash(F.coalesce("heading", F.lit(""))), X.squash(F.col("content"))]


def dedupe(hits: DataFrame) -> DataFrame:
    """The first hit of each law, label (or chunk, where there is none), heading and content, white space apart."""
    w = Window.partitionBy("query_id", *evidence_key()).orderBy("pos", "chunk_id")
    return hits.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def diverse_topk(hits: DataFrame, k: int) -> DataFrame:
    """k hits of each query: the first of each law in three quarters of the places, then at most two of a law, then any; ``place``."""
    w = Window.partitionBy("query_id").orderBy("pos", "chunk_id")
    one = dedupe(hits).withColumn("of_law", F.row_number().over(Window.partitionBy("query_id", "law_id").orderBy("pos", "chunk_id")))
    leader = F.sum((F.col("of_law") == 1).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    slots = min(k, max(1, (3 * k + 3) // 4))
    phase = F.when((F.col("of_law") == 1) & (leader <= slots), 0).when(F.col("of_law") <= 2, 1).otherwise(2)
    placed = one.withColumn("phase", phase).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("phase", "pos", "chunk_id")).cast("long"))
    return placed.where(F.col("place") <= k).drop("of_law", "phase")


def rerank_candidates(hits: DataFrame, k: int, limit: int) -> DataFrame:
    """The k leaders and, up to ``limit``, those of the rest that hold the most words of answering; ``slot`` is their new order."""
    lead = min(k, limit)
    marks = F.when(F.col("pos") <= lead, F.lit(None)).otherwise(X.count_markers(F.col("content"), X.ANSWER_MARKERS))
    slot = F.row_number().over(Window.partitionBy("query_id").orderBy((F.col("pos") > lead), F.desc(marks), "pos", "chunk_id")).cast("long")
    return hits.withColumn("slot", slot).where(F.col("slot") <= limit)


def rerank(hits: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """Hits in the order of a ranking (``query_id, chunk_id, rank``), the unranked ones behind in their own; the first k."""
    r = ranked.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("rank"), "pos", "chunk_id")
    return hits.join(r, ["query_id", "chunk_id"], "left").withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= k).drop("rank")


def ranked_ids(answer: Column) -> Column:
    """The distinct ids of a model's answer ``{"ranked_chunk_ids": […]}``, whatever stands around it; null if there are none."""
    obj = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    ids = F.from_json(F.get_json_object(obj, "$.ranked_chunk_ids"), "array<string>")
    got = F.array_distinct(F.filter(F.transform(ids, lambda x: x.try_cast("long")), lambda x: x.isNotNull()))
    return F.when(F.size(got) > 0, got)


def with_coverage(hits: DataFrame, facet_hits: DataFrame, queries: DataFrame, titles: DataFrame, k: int) -> DataFrame:
    """Diverse hits of each query with places kept for what it asks about.

    ``queries``: ``query_id, query``; ``titles``: the titles each means (``query_id, title``); ``facet_hits``: hits of its facets
    with ``facet`` and ``facet_no``. The best hit of a meant law and of a primary statute get a place, and for every facet that no
    hit holds the first hit of its own search; they take the place of the last hit of a law that has several. A meant law's hit
    comes first, else the first hit that holds an object asked about; the statute's comes second. At most 24 hits a query and 8 a
    facet come in, so a query's group is small.
    """
    chosen = diverse_topk(hits, k).withColumn("kind", F.lit("chosen")).withColumn("order", F.col("place"))
    direct = hits.join(titles.withColumnRenamed("title", "law_title"), ["query_id", "law_title"], "left_semi")
    first = lambda d: d.withColumn("__r", F.row_number().over(Window.partitionBy("query_id").orderBy("pos", "chunk_id"))).where("__r = 1").drop("__r")
    cols = ["query_id", "pos", "chunk_id", "law_id", "law_title", "version_no", "article_label", "heading", "content", "source_url", "hybrid_score"]
    focus = queries.select("query_id", X.focus_terms(F.col("query")).alias("focus"))

    def part(d: DataFrame, kind: str, order: Column, facet: Column) -> DataFrame:
        return d.select(*cols, F.lit(kind).alias("kind"), order.cast("long").alias("order"), facet.cast("string").alias("facet"))

    none = F.lit(None)
    rows = (
        part(chosen, "chosen", F.col("place"), none)
        .unionByName(part(first(direct), "direct", F.lit(0), none))
        .unionByName(part(first(hits.where(X.is_primary_statute(F.col("law_title")))), "statute", F.lit(0), none))
        .unionByName(part(facet_hits.where("pos <= 8"), "facet", F.col("facet_no") * 100 + F.col("pos"), F.col("facet")))
        .join(focus, "query_id", "left")
    )
    schema = "query_id long, place long, chunk_id long, law_id long, law_title string, version_no int, article_label string, heading string, content string, source_url string, hybrid_score double"

    def squash(s) -> str:
        return "".join((s or "").split())

    def arrange(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["kind", "order", "pos"], kind="stable")
        recs = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
        key = lambda h: (h["law_id"], squash(h["article_label"]) or h["chunk_id"], squash(h["heading"]), squash(h["content"]))
        shown = lambda h: "\n".join(str(h[c] or "") for c in ("law_title", "article_label", "heading", "content")).lower()
        sel = [h for h in recs if h["kind"] == "chosen"]

        def admit(h: dict, room: bool) -> None:
            if any(key(x) == key(h) for x in sel):
                return
            if not sel or (room and len(sel) < k):
                sel.append(h)
                return
            laws = [x["law_id"] for x in sel]
            repeated = [i for i, law in enumerate(laws) if laws.count(law) > 1]
            sel[repeated[-1] if repeated else len(sel) - 1] = h

        def bring(h: dict, to: int) -> None:
            at = next((i for i, x in enumerate(sel) if key(x) == key(h)), -1)
            if at > to:
                sel.insert(to, sel.pop(at))

        direct_hit = next((h for h in recs if h["kind"] == "direct"), None)
        statute = next((h for h in recs if h["kind"] == "statute"), None)
        for h in (direct_hit, statute):
            if h is not None:
                admit(h, False)
        by_facet: dict[str, list[dict]] = {}
        for h in recs:
            if h["kind"] == "facet":
                by_facet.setdefault(h["facet"], []).append(h)
        for facet, found in by_facet.items():
            if not any(facet.lower() in shown(h) for h in sel):
                fresh = next((h for h in found if not any(key(x) == key(h) for x in sel)), None)
                if fresh is not None:
                    admit(fresh, True)
        focus_words = [w.lower() for w in (recs[0]["focus"] if recs and recs[0]["focus"] is not None else [])]
        if direct_hit is not None:
            bring(direct_hit, 0)
        elif focus_words:
            named = next((h for h in sel if any(w in shown(h) for w in focus_words)), None)
            if named is not None:
                bring(named, 0)
        if statute is not None and (direct_hit is None or key(statute) != key(direct_hit)):
            bring(statute, min(1, len(sel) - 1))
        out = [{**{c: h[c] for c in cols if c != "pos"}, "place": i + 1} for i, h in enumerate(sel[:k])]
        return pd.DataFrame(out, columns=["query_id", "place", "chunk_id", "law_id", "law_title", "version_no", "article_label", "heading", "content", "source_url", "hybrid_score"])

    return rows.groupBy("query_id").applyInPandas(arrange, schema)


def first_seen(hits: DataFrame) -> DataFrame:
    """``same_as``: the place where the same title, version and URL came first, null for the first itself."""
    first = F.min("place").over(Window.partitionBy("query_id", "law_title", "version_no", "source_url"))
    return hits.withColumn("same_as", F.when(first < F.col("place"), first))


def evidence_context(hits: DataFrame, limit: int = 5_000) -> DataFrame:
    """``query_id, context``: the numbered evidence of each query; a source that came before is named by its number."""
    h = first_seen(hits)
    source = F.when(F.col("same_as").isNotNull(), F.format_string("來源：同 [%d]", "same_as")).otherwise(F.format_string("法規：%s 版本：%d 來源：%s", "law_title", "version_no", "source_url"))
    block = F.concat_ws("\n", F.format_string("[%d]", "place"), source, F.concat_ws(" ", "article_label", "heading"), F.substring("content", 1, limit))
    return h.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", block.alias("x")))), lambda r: r["x"]), "\n\n").alias("context"))


def needs_web(hits: DataFrame, queries: DataFrame, gate: float = 0.35) -> DataFrame:
    """``query_id, needs_web``: no hits, or the best score under the gate unless all are a whole section."""
    per = hits.groupBy("query_id").agg(F.max("hybrid_score").alias("best"), F.bool_and(F.col("retrieval_mode") == "structural_section").alias("structural"))
    return queries.select("query_id").join(per, "query_id", "left").select("query_id", F.when(F.col("best").isNull(), True).when(F.col("structural"), False).otherwise(F.col("best") < gate).alias("needs_web"))


def relevant_results(results: DataFrame, focus: DataFrame) -> DataFrame:
    """The web results (``query_id, title, url, content, …``) that hold one of the query's focus words, all where it has none; one a URL."""
    j = results.join(focus, "query_id", "left")
    words = F.coalesce("focus", F.array().cast("array<string>"))
    text = F.lower(F.concat_ws("\n", "title", "content"))
    keep = j.where((F.size(words) == 0) | F.exists(words, lambda w: F.contains(text, F.lower(w)))).drop("focus")
    w = Window.partitionBy("query_id", "url").orderBy(F.desc_nulls_last("source_date"), "title")
    return keep.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
