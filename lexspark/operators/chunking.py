"""Segmentation of texts into ordered, labelled chunks: windows over lines, no per-document loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexspark.functions import text as X

# How articles, references to their paragraphs, headings and points of three levels begin.
_N = X.NUMERALS
ARTICLE = rf"(?U)^(第\s*[{_N}\d\-之]+\s*條(?:\s*之\s*[{_N}\d]+)?)\s*(.*)$"
REFERENCE = rf"(?U)^第\s*[{_N}\d]+\s*項"
HEADING = rf"(?U)^(第\s*[{_N}\d]+\s*[章節])\s*(.*)$"
POINTS = (rf"(?U)^([{_N}]+、)", rf"(?U)^([（(][{_N}]+[）)])", r"(?U)^(\d+[\.、])")


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, pos, line``: the cleaned lines of every text. Null and empty texts have none; a row delivered again counts once."""
    src = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("t")).where("t is not null").dropDuplicates(["doc"])
    return src.select("doc", F.posexplode(X.clean_lines(F.col("t"))).alias("pos", "line"))


def segment(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, seq, article_label, heading, content``: the chunks of every text, in order.

    Texts with articles are cut at articles, with the last chapter or section heading; a line that only refers to an article's
    paragraph stays in its chunk. Others are cut at points of up to three levels; a point followed by a deeper one is a heading,
    and a chunk's heading is the path of those. Texts without either are one chunk. What stands before the first label belongs to
    none. The windows are per document: a document's lines are one task's, as its text is one row's.
    """
    ln = lines(docs, id_col, text_col)
    w = Window.partitionBy("doc")
    upto = w.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    after = w.orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    level = F.when(F.col("line").rlike(POINTS[0]), 1).when(F.col("line").rlike(POINTS[1]), 2).when(F.col("line").rlike(POINTS[2]), 3)
    head = F.regexp_extract("line", HEADING, 1)
    art, rest = F.regexp_extract("line", ARTICLE, 1), F.regexp_extract("line", ARTICLE, 2)
    m = ln.withColumns({"is_head": F.col("line").rlike(HEADING), "is_art": F.col("line").rlike(ARTICLE), "level": level})
    m = m.withColumn("articles", F.max("is_art").over(w))
    by_article = m.where("articles")
    first = F.min(F.when(F.col("is_art") & ~F.col("is_head"), F.col("pos"))).over(w)
    by_article = by_article.withColumn("first", first).withColumn("starts", F.col("is_art") & ~F.col("is_head") & ((F.col("pos") == F.col("first")) | ~rest.rlike(REFERENCE)))
    title = F.when(F.col("is_head"), F.concat_ws(" ", X.squash(head), F.when(F.regexp_extract("line", HEADING, 2) != "", F.regexp_extract("line", HEADING, 2))))
    by_article = by_article.withColumns({"grp": F.sum(F.col("starts").cast("int")).over(upto), "heading": F.last(title, ignorenulls=True).over(upto)}).where("grp > 0 and not is_head")
    label = X.squash(art)
    shown = F.when(F.col("starts"), F.concat_ws(" ", label, F.when(rest != "", rest))).otherwise(F.col("line"))
    one = by_article.select("doc", "grp", "pos", F.when(F.col("starts"), label).alias("label"), F.when(F.col("starts"), F.col("heading")).alias("heading"), shown.alias("line"))
    by_point = m.where("not articles").withColumns({"points": F.max(F.col("level").isNotNull()).over(w), "kinds": F.size(F.collect_set("level").over(w)), "next": F.first("level", ignorenulls=True).over(after)})
    by_point = by_point.withColumns({"is_title": F.coalesce((F.col("kinds") > 1) & (F.col("next") > F.col("level")), F.lit(False)), "grp": F.when(F.col("points"), F.sum(F.col("level").isNotNull().cast("int")).over(upto)).otherwise(F.lit(1))})
    # The heading of level k in force: the last earlier point of a level up to k, if it is a heading of level k.
    before = w.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.last(F.when(F.col("level") <= k, F.struct("level", "is_title", "line")), ignorenulls=True).over(before) for k in (1, 2)}
    by_point = by_point.withColumns({f"h{k}": c for k, c in last.items()})
    path = F.concat_ws(" / ", *(F.when((F.col("level") > k) & F.col(f"h{k}.is_title") & (F.col(f"h{k}.level") == k), F.col(f"h{k}.line")) for k in (1, 2)))
    mark = F.coalesce(*(F.when(F.col("line").rlike(p), F.regexp_extract("line", p, 1)) for p in POINTS))
    starts = F.max(F.when(F.col("level").isNotNull(), F.col("is_title")).otherwise(F.lit(False))).over(Window.partitionBy("doc", "grp"))
    by_point = by_point.withColumn("dropped", starts).where("grp > 0 and not dropped")
    two = by_point.select("doc", "grp", "pos", F.when(F.col("level").isNotNull(), mark).alias("label"), F.when(F.col("level").isNotNull() & (path != ""), path).alias("heading"), "line")
    chunks = one.unionByName(two).groupBy("doc", "grp").agg(
        F.max("label").alias("article_label"),
        F.max("heading").alias("heading"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("content"),
    )
    order = Window.partitionBy("doc").orderBy("grp")
    alone = F.count("*").over(w) == 1
    chunks = chunks.withColumns({"seq": F.row_number().over(order) - 1, "alone": alone})
    long = chunks.where("alone and length(content) > 6000").select("doc", F.posexplode(char_windows("content", 1800, 180)).alias("seq", "content"))
    kept = chunks.where("not (alone and length(content) > 6000)").select("doc", "seq", "article_label", "heading", "content")
    return kept.unionByName(long.select("doc", "seq", F.lit(None).cast("string").alias("article_label"), F.lit(None).cast("string").alias("heading"), "content"))


def char_windows(text: str | Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters, each beginning ``overlap`` before the last one's end; the last one ends with the text."""
    c = F.col(text) if isinstance(text, str) else text
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.length(c) - size) / step).cast("int"), F.lit(0)) * step, F.lit(step))
    return F.transform(starts, lambda i: F.substring(c, i + 1, F.lit(size)))


def stride_windows(text: str | Column, size: int = 2600, stride: int = 2500) -> Column:
    """A text up to ``size`` whole, a longer one as windows at every ``stride`` (the last may lie within the one before)."""
    c = F.col(text) if isinstance(text, str) else text
    starts = F.sequence(F.lit(0), F.floor((F.length(c) - 1) / stride).cast("int") * stride, F.lit(stride))
    return F.when(F.length(c) <= size, F.array(c)).otherwise(F.transform(starts, lambda i: F.substring(c, i + 1, F.lit(size))))


def stored_parts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, part, label, text``: a stored text's body (part 0) and its attachments, cut at the lines 附件：label."""
    src = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("t")).where("t is not null").dropDuplicates(["doc"])
    return _cut_parts(src)


def _cut_parts(src: DataFrame) -> DataFrame:
    cut = F.split(F.concat(F.lit("\n"), F.col("t")), r"\r?\n(?=附件：[^\r\n]+\r?\n)")
    parts = src.select("doc", F.posexplode(cut).alias("part", "p"))
    label = F.when(F.col("part") > 0, F.regexp_extract("p", r"^附件：([^\r\n]+)", 1))
    body = F.regexp_replace(F.when(F.col("part") > 0, F.regexp_replace("p", r"^附件：[^\r\n]+\r?\n", "")).otherwise(F.col("p")), r"(?U)^\s+|\s+$", "")
    return parts.select("doc", "part", F.regexp_replace(label, r"(?U)^\s+|\s+$", "").alias("label"), body.alias("text")).where("part = 0 or text <> ''")


def segment_stored(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Chunks of bodies and attachments, numbered on; an attachment's chunks are headed by it and labelled 附件n where they have no label."""
    return _segment_parts(stored_parts(docs, id_col, text_col))


def segment_attached(docs: DataFrame, group_col: str, id_col: str, text_col: str) -> DataFrame:
    """As ``segment_stored`` of each group's documents in one text: the first its body, the others attachments named by their ids.

    The documents stay rows of their own, so a large group needs no large row. Rows with a null group or an empty text are left out,
    and those with a null id unless first.
    """
    order = Window.partitionBy("group").orderBy("id", "t")
    src = docs.select(F.col(group_col).alias("group"), F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("group is not null and t <> ''")
    src = src.withColumns({"no": F.row_number().over(order), "more": F.lead(F.lit(True)).over(order)}).where("no = 1 or id is not null")
    name = F.when(F.col("no") > 1, F.concat(F.lit("附件："), F.col("id").cast("string"), F.lit("\n"))).otherwise(F.lit(""))
    end = F.when(F.col("more"), F.lit("\n\n")).otherwise(F.lit(""))  # a line 附件：label counts only where a line follows
    one = _cut_parts(src.select(F.struct("group", "no").alias("doc"), F.concat(name, "t", end).alias("t")))
    return _segment_parts(one.where("doc.no = 1 or part > 0").select(F.col("doc.group").alias("doc"), F.struct("doc.no", "part").alias("part"), "label", "text"))


def _segment_parts(parts: DataFrame) -> DataFrame:
    parts = parts.withColumn("key", F.struct("doc", "part"))
    chunks = segment(parts, "key", "text").select("doc.doc", "doc.part", "seq", "article_label", "heading", "content")
    chunks = chunks.join(parts.select("doc", "part", "label"), ["doc", "part"])
    order = Window.partitionBy("doc").orderBy("part", "seq")
    attached = F.col("label").isNotNull()
    return chunks.select(
        "doc",
        (F.row_number().over(order) - 1).alias("n"),
        F.when(attached, F.coalesce("article_label", F.concat(F.lit("附件"), (F.col("seq") + 1).cast("string")))).otherwise(F.col("article_label")).alias("article_label"),
        F.when(attached, F.concat(F.lit("附件："), "label")).otherwise(F.col("heading")).alias("heading"),
        "content",
    ).withColumnRenamed("n", "seq")


META = {
    "published_date": r"(?:發布|公布)日期[：:]?\s*([^\n]+)",
    "effective_date": r"(?:生效|施行)日期[：:]?\s*([^\n]+)",
    "amended_date": r"(?:修正|異動)日期[：:]?\s*([^\n]+)",
    "authority": r"(?:發布機關|主管機關)[：:]?\s*([^\n]+)",
    "law_status": r"(?:法規狀態|現行狀態)[：:]?\s*([^\n]+)",
}  # fixed values: the words before each field


def metadata(c: Column) -> Column:
    """The fields that a law's text states, as a struct; null where it doesn't. A date behind the name counts by its verb."""
    name = F.regexp_replace(F.regexp_extract(c, r"法規名稱[：:]\s*([^\n]+)", 1), r"(?U)\s+", " ")
    dated = r"^(.+?)\s*[（(](\d{2,3}/\d{1,2}/\d{1,2})\s*(公發布|發布|公布|修正|訂定)[）)]\s*$"
    date, verb = F.regexp_extract(name, dated, 2), F.regexp_extract(name, dated, 3)
    found = {k: F.when(F.regexp_extract(c, p, 1) != "", F.substring(F.regexp_replace(F.regexp_extract(c, p, 1), r"(?U)^\s+|\s+$", ""), 1, 200)) for k, p in META.items()}
    found["published_date"] = F.coalesce(found["published_date"], F.when(verb.isin("公發布", "發布", "公布", "訂定"), date))
    found["amended_date"] = F.coalesce(found["amended_date"], F.when(verb == "修正", date))
    return F.struct(*(v.alias(k) for k, v in found.items()))


def title(c: Column) -> Column:
    """The law's name from its line 法規名稱：, without a trailing date; null if there is none."""
    raw = F.regexp_replace(F.regexp_replace(F.regexp_extract(c, r"法規名稱[：:]\s*([^\n]+)", 1), r"(?U)\s+", " "), "^[ ：:]+|[ ：:]+$", "")
    bare = F.regexp_replace(raw, r"\s*[（(]\d{2,3}/\d{1,2}/\d{1,2}\s*(?:公發布|發布|公布|修正|訂定)[）)]\s*$", "")
    return F.when(F.length(bare) >= 2, bare)


def semantic_hash(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``doc, content_hash``: SHA-256 of title, stated fields and chunks of each document, white space apart.

    ``docs`` has ``doc, title, meta`` (as of ``metadata``), ``chunks`` as of ``segment``. The clock of a print view changes nothing.
    """
    body = chunks.groupBy("doc").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.concat_ws("\n", F.coalesce("heading", F.lit("")), F.coalesce("article_label", F.lit("")), "content").alias("x")))), lambda x: x["x"]), "\n").alias("body")
    )
    payload = F.to_json(F.struct("body", F.col("meta").alias("metadata"), "title"))
    return docs.join(body, "doc", "left").select("doc", F.sha2(X.squash(payload), 256).alias("content_hash"))
