"""Append-only versions by source identity and content hash: batch upsert, reprocessing, integrity, reports, conversations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexspark.operators import chunking as C

PARSER_REVISION = 3


def derive_current(versions: DataFrame) -> DataFrame:
    """Versions with ``is_current`` derived: the largest number of each law (of equals the largest id); ids delivered again once."""
    w = Window.partitionBy("law_id").orderBy(F.desc("version_no"), F.desc("version_id"))
    return versions.dropDuplicates(["version_id"]).withColumn("__r", F.row_number().over(w)).withColumn("is_current", F.col("__r") == 1).drop("__r")


def next_version(versions: DataFrame, laws: DataFrame) -> DataFrame:
    """``law_id, next_no``: one more than the largest number of each law, 1 where it has no version."""
    top = versions.groupBy("law_id").agg(F.max("version_no").alias("m"))
    return laws.select("law_id").distinct().join(top, "law_id", "left").select("law_id", (F.coalesce("m", F.lit(0)) + 1).cast("long").alias("next_no"))


def stored_revision(metadata: Column) -> Column:
    """The parser's revision in a metadata text; null for none, a truth value or anything that is no number."""
    raw = F.get_json_object(metadata, "$.parser_revision")
    return F.when(raw.rlike("^-?[0-9]{1,9}$"), raw.cast("int"))


def upsert_status(incoming: DataFrame, laws: DataFrame, versions: DataFrame, revision: int = PARSER_REVISION) -> DataFrame:
    """``source_key, status, version_no`` of each incoming text (``source_key, content_hash, …``; one row a key).

    inserted: no current version or another hash (also one seen before it); unchanged: the current hash; reprocess_required: the
    current hash, stored by an older parser. ``version_no`` is the number it has or gets.
    """
    law = laws.select("law_id", "source_key").dropDuplicates(["source_key"])
    v = derive_current(versions)
    cur = v.where("is_current").select("law_id", F.col("content_hash").alias("old_hash"), "version_no", stored_revision(F.col("metadata_json")).alias("rev"))
    j = incoming.join(law, "source_key", "left").join(cur, "law_id", "left")
    same = F.col("old_hash").eqNullSafe(F.col("content_hash")) & F.col("old_hash").isNotNull()
    status = F.when(~same, "inserted").when(F.coalesce(F.col("rev"), F.lit(0)) < revision, "reprocess_required").otherwise("unchanged")
    return j.select("source_key", "law_id", status.alias("status"), F.when(~same, F.coalesce("version_no", F.lit(0)) + 1).otherwise(F.col("version_no")).cast("long").alias("version_no"))


def upsert_rows(incoming: DataFrame, laws: DataFrame, versions: DataFrame, revision: int = PARSER_REVISION) -> tuple[DataFrame, DataFrame]:
    """(laws, versions) that a batch adds: new laws and those with a new title or address, and a version for every text that is new.

    New ids come from hashes of the natural keys. Of 63 bits, two keys of a billion share one with a chance of 0.05: a new law whose
    id another key has already is an error, not a merge.
    """
    st = upsert_status(incoming, laws, versions, revision)
    new_id = lambda *c: F.abs(F.xxhash64(*c))
    j = incoming.join(st, "source_key")
    known = laws.dropDuplicates(["source_key"])
    fresh = incoming.select("source_key", F.col("title").alias("new_title"), F.col("source_url").alias("new_url"))
    kept = known.join(fresh, "source_key").where(~(F.col("title").eqNullSafe(F.coalesce("new_title", "title")) & F.col("source_url").eqNullSafe(F.coalesce("new_url", "source_url"))))
    kept = kept.withColumns({"title": F.coalesce("new_title", "title"), "source_url": F.coalesce("new_url", "source_url")}).select(*laws.columns)
    added = j.where("law_id is null").select(new_id(F.col("source_key")).alias("law_id"), "source_key", "title", "source_url", F.col("fetched_at").alias("created_at"))
    taken = known.select(F.col("law_id").alias("old_id"), F.col("source_key").alias("old_key"))
    clash = (F.col("old_id") == F.col("law_id")) & (F.col("old_key") != F.col("source_key"))
    added = added.join(taken, clash, "left").withColumn("law_id", F.when(F.col("old_id").isNotNull(), F.raise_error(F.concat(F.lit("the id of "), "source_key", F.lit(" is taken")))).otherwise(F.col("law_id"))).drop("old_id", "old_key")
    rows = j.where("status = 'inserted'").select(
        new_id(F.lit("version"), F.col("source_key"), F.col("version_no"), F.col("content_hash")).alias("version_id"),
        F.coalesce("law_id", new_id(F.col("source_key"))).alias("law_id"),
        F.col("version_no").cast("int").alias("version_no"),
        "content_hash",
        "raw_text",
        "metadata_json",
        F.lit(True).alias("is_current"),
        "fetched_at",
    )
    return kept.unionByName(added, allowMissingColumns=True), rows


def apply_upsert(incoming: DataFrame, laws: DataFrame, versions: DataFrame, revision: int = PARSER_REVISION) -> tuple[DataFrame, DataFrame]:
    """(laws, versions) after a batch; history is only added to."""
    changed, rows = upsert_rows(incoming, laws, versions, revision)
    kept = laws.dropDuplicates(["source_key"]).join(changed.select("source_key"), "source_key", "left_anti").select(*laws.columns)
    return kept.unionByName(changed, allowMissingColumns=True), derive_current(versions.unionByName(rows))


def version_chunks(versions: DataFrame, embed: Callable[[Column], Column] | None = None, titles: DataFrame | None = None) -> DataFrame:
    """``chunk_id, version_id, seq, article_label, heading, content[, embedding]``: the chunks of new versions' texts, attachments too.

    ``embed`` makes the vectors, from the law's title (``titles``: ``law_id, title``), heading, label and content.
    """
    c = C.segment_stored(versions, "version_id", "raw_text")
    c = c.select(F.abs(F.xxhash64(F.lit("chunk"), "doc", "seq")).alias("chunk_id"), F.col("doc").alias("version_id"), "seq", "article_label", "heading", "content")
    if embed is None:
        return c
    title = versions.select("version_id", "law_id").join(titles.select("law_id", "title").dropDuplicates(["law_id"]), "law_id", "left").select("version_id", "title")
    text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("heading", F.lit("")), F.coalesce("article_label", F.lit("")), "content")
    return c.join(title, "version_id", "left").withColumn("embedding", embed(text)).drop("title")


def unchanged_early(incoming: DataFrame, laws: DataFrame, versions: DataFrame, revision: int = PARSER_REVISION) -> DataFrame:
    """``source_key, status, version_no`` of the incoming bodies (``source_key, body``) that stand unchanged in the current version.

    The stored text is the body, or the body and its attachments; its metadata tells of attachments. These need no attachment to be
    fetched: ``unchanged``, or ``reprocess_required`` where an older parser stored them. Others have no row.
    """
    cur = derive_current(versions).where("is_current").join(laws.select("law_id", "source_key").dropDuplicates(["source_key"]), "law_id")
    j = incoming.select("source_key", "body").join(cur.select("source_key", "raw_text", "metadata_json", "version_no"), "source_key")
    same = (F.col("raw_text") == F.col("body")) | F.startswith("raw_text", F.concat("body", F.lit("\n\n附件：")))
    j = j.where(same & F.get_json_object("metadata_json", "$.attachments").isNotNull())
    old = F.coalesce(stored_revision(F.col("metadata_json")), F.lit(0)) < revision
    return j.select("source_key", F.when(old, "reprocess_required").otherwise("unchanged").alias("status"), F.col("version_no").cast("long").alias("version_no"))


def version_list(versions: DataFrame, law_ids: DataFrame | None = None) -> DataFrame:
    """Versions of laws (``law_id``; of all without), the newest first, without their texts."""
    v = derive_current(versions)
    v = v if law_ids is None else v.join(law_ids.select("law_id").distinct(), "law_id", "left_semi")
    return v.select("law_id", "version_id", "version_no", "content_hash", "is_current", "fetched_at").orderBy("law_id", F.desc("version_no"), F.desc("version_id"))


def reprocess(versions: DataFrame, laws: DataFrame, revision: int = PARSER_REVISION, law_ids: list[int] | None = None, apart: str = "消防署函釋", apply: bool = False) -> DataFrame:
    """The current versions whose parser is older than ``revision`` (those of the category ``apart`` stay).

    A report (``law_id, version_id, version_no, stored_revision``), or with ``apply`` these versions with the new revision in
    their metadata, number kept.
    """
    cat = laws.select("law_id", "category").dropDuplicates(["law_id"])
    v = derive_current(versions).where("is_current").join(cat, "law_id").where(F.coalesce(F.col("category") != apart, F.lit(True)))
    v = v.withColumn("stored_revision", stored_revision(F.col("metadata_json"))).where(F.coalesce("stored_revision", F.lit(0)) < revision)
    if law_ids:
        v = v.where(F.col("law_id").isin(law_ids))
    if not apply:
        return v.select("law_id", "version_id", "version_no", "stored_revision")
    meta = F.coalesce(F.from_json("metadata_json", "map<string,string>"), F.create_map().cast("map<string,string>"))
    new = F.map_concat(F.map_filter(meta, lambda k, _: k != "parser_revision"), F.create_map(F.lit("parser_revision"), F.lit(str(revision))))
    return v.withColumn("metadata_json", F.to_json(new)).drop("category", "stored_revision")


def delete_laws(ids: DataFrame, laws: DataFrame, versions: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(laws, versions, chunks) without those of the ids (``law_id``): the deletion goes down the chain."""
    gone = versions.join(ids, "law_id", "left_semi").select("version_id")
    return laws.join(ids, "law_id", "left_anti"), versions.join(ids, "law_id", "left_anti"), chunks.join(gone, "version_id", "left_anti")


def crawl_report(results: DataFrame) -> DataFrame:
    """Counts by ``category`` and, in the row of category null, over all: of ``results`` (``category, status``)."""
    c = lambda s: F.sum((F.col("status") == s).cast("int")).alias(s)
    return results.rollup("category").agg(F.count("*").alias("total"), c("inserted"), c("unchanged"), c("reprocess_required"), c("error"))


def last_activity(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations with the time of their last message, or of their making; the most recent first."""
    last = messages.groupBy("conversation_id").agg(F.max("created_at").alias("m"))
    return conversations.join(last, "conversation_id", "left").withColumn("last_activity", F.coalesce("m", "created_at")).drop("m").orderBy(F.desc("last_activity"), F.desc("conversation_id"))


def conversation_title(query: Column, limit: int = 38) -> Column:
    """A query as a title: single blanks, at most ``limit`` characters, the last an ellipsis."""
    t = F.regexp_replace(F.regexp_replace(query, r"(?U)\s+", " "), "^ | $", "")
    return F.when(t == "", "新對話").when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 1), F.lit("…"))).otherwise(t)


def append_exchange(messages: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Messages with a question and an answer added for each exchange (``conversation_id, query, answer, response_json, at``)."""
    start = messages.groupBy("conversation_id").agg(F.max("message_id").alias("m"))
    e = exchanges.join(start, "conversation_id", "left")
    rows = e.select(
        "conversation_id", F.coalesce("m", F.lit(0)).alias("m"), "at",
        F.posexplode(F.array(F.struct(F.lit("user").alias("role"), F.col("query").alias("content"), F.lit(None).cast("string").alias("response_json")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"), F.col("response_json")))).alias("i", "x"),
    )
    return messages.unionByName(rows.select((F.col("m") + F.col("i") + 1).alias("message_id"), "conversation_id", "x.role", "x.content", "x.response_json", F.col("at").alias("created_at")), allowMissingColumns=True)


def preference(value: Column, default: int = 8, low: int = 1, high: int = 20) -> Column:
    """A stored preference, or the default where it is null or out of range."""
    return F.when(value.between(low, high), value).otherwise(F.lit(default))


def save_preference(stored: DataFrame, key: str, value: int, low: int = 1, high: int = 20) -> DataFrame:
    """Preferences (``key, int_value``) with one set; a value that is no whole number in range is an error."""
    if isinstance(value, bool) or not isinstance(value, int):
        raise TypeError("a preference is a whole number")
    if not low <= value <= high:
        raise ValueError(f"a preference is within {low} and {high}")
    new = stored.sparkSession.createDataFrame([(key, value)], "key string, int_value int")
    return stored.where(F.col("key") != key).select("key", "int_value").unionByName(new)


def rename_conversation(conversations: DataFrame, conversation_id: int, title: str, limit: int = 80) -> DataFrame:
    """Conversations with one title set (single blanks, cut to ``limit``); a blank title is an error."""
    if not (tidy := " ".join(title.split())[:limit]):
        raise ValueError("a title isn't blank")
    return conversations.withColumn("title", F.when(F.col("conversation_id") == conversation_id, tidy).otherwise(F.col("title")))


def delete_conversations(ids: DataFrame, conversations: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, messages) without those of the ids (``conversation_id``)."""
    return conversations.join(ids, "conversation_id", "left_anti"), messages.join(ids, "conversation_id", "left_anti")


#: The stored tables and their columns.
SCHEMAS = {
    "laws": "law_id long, source_key string, title string, category string, source_url string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "law_versions": "version_id long, law_id long, version_no int, content_hash string, raw_text string, metadata_json string, is_current boolean, fetched_at timestamp_ntz",
    "law_chunks": "chunk_id long, version_id long, seq int, article_label string, heading string, content string, embedding array<float>",
    "conversations": "conversation_id long, title string, created_at timestamp_ntz",
    "messages": "message_id long, conversation_id long, role string, content string, response_json string, created_at timestamp_ntz",
    "preferences": "key string, int_value int",
}


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """All stored tables without rows: the state to begin with."""
    return {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}
