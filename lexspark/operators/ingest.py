"""From fetched pages to stored versions: parsed laws, their attachments (one list page deep), statuses, and letters of interpretation."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexspark.functions import text as X
from lexspark.operators import chunking as C
from lexspark.operators import versioning as V
from lexspark.runtime import cut
from lexspark.sources import html as H
from lexspark.sources import readers

#: Characters that a law's text has at least.
LEAST = 20


def parsed_laws(pages: DataFrame, selector: str | None = None) -> DataFrame:
    """``page_id, title, text, meta, content_hash, n_chunks, first_label, last_label``: every page (``page_id, html[, link_title]``) read as a law.

    The title is the text's own (法規名稱：), else the page's, else the link's. Null pages give no row; one without chunks has 0.
    """
    src = pages.where("html is not null").dropDuplicates(["page_id"])
    link = F.col("link_title") if "link_title" in pages.columns else F.lit(None).cast("string")
    t = cut(src.select("page_id", H.page_text(F.col("html"), selector).alias("text"), H.page_title(F.col("html"), link).alias("page_title")))  # pages are parsed once
    docs = t.select("page_id", "text", F.coalesce(C.title(F.col("text")), "page_title").alias("title"), C.metadata(F.col("text")).alias("meta"))
    chunks = C.segment(docs, "page_id", "text")
    seen = chunks.groupBy(F.col("doc").alias("page_id")).agg(F.count("*").alias("n_chunks"), F.min_by("article_label", "seq").alias("first_label"), F.max_by("article_label", "seq").alias("last_label"))
    hashes = C.semantic_hash(docs.select(F.col("page_id").alias("doc"), "title", "meta"), chunks).withColumnRenamed("doc", "page_id")
    return docs.join(hashes, "page_id").join(seen, "page_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))


def _fetched(urls: DataFrame, get: Callable[[str], tuple[str, bytes]], read: Callable, pages: int) -> DataFrame:
    """``page_id, link, kind, text, html, reason`` of addresses fetched by a client (content type and bytes)."""

    def run(batches):
        for pdf in batches:
            rows = []
            for i, u in zip(pdf["page_id"], pdf["link"]):
                kind, text, html, why = "error", None, None, None
                try:
                    content_type, body = get(u)
                    if "pdf" in content_type.lower() or urlparse(u).path.lower().endswith(".pdf") or body.startswith(b"%PDF-"):
                        got, why = read(body, pages)
                        text = readers.joined_pages(got) if got else None
                        kind = "pdf"
                        if got is not None and len(text or "") < LEAST:
                            text, why = None, "no text to be found in it"
                    elif "html" in content_type.lower():
                        kind, html = "html", body.decode("utf-8", "replace")
                    else:
                        kind, why = "other", "no PDF"
                except readers.Blocked:
                    raise
                except Exception as e:  # noqa: BLE001 - one bad attachment must not stop the law
                    why = f"{type(e).__name__}: {e}"
                rows.append((i, u, kind, text, html, why))
            yield pd.DataFrame(rows, columns=["page_id", "link", "kind", "text", "html", "reason"])

    return cut(urls.select("page_id", "link").mapInPandas(run, "page_id long, link string, kind string, text string, html string, reason string"))


def expanded_attachments(pages: DataFrame, get: Callable[[str], tuple[str, bytes]], read: Callable = readers.pdf_pages, cap: int = 200) -> DataFrame:
    """``page_id, no, link, label, text, reason``: the attachments of pages (``page_id, url, html``) and their texts, in order.

    An attachment that is a page itself is replaced by those that it lists, one page deep; one that lists none, is no PDF, too long
    or broken has a reason and no text. An address counts once a page. A refusal by the site ends all.
    """
    first = H.attachments(pages).select("page_id", "link", "pos")
    one = _fetched(first, get, read, cap).join(first, ["page_id", "link"])
    listed = one.where("kind = 'html'")
    nested = H.attachments(listed.select(F.col("page_id"), F.col("link").alias("url"), "html"))
    nested = nested.join(first.select("page_id", "link"), ["page_id", "link"], "left_anti")
    own = listed.select("page_id", F.col("pos").alias("above")).groupBy("page_id").agg(F.min("above").alias("above"))
    two = _fetched(nested, get, read, cap).join(nested.select("page_id", "link", F.col("pos").alias("below")), ["page_id", "link"]).join(own, "page_id")
    dead = listed.join(nested.select("page_id").distinct(), "page_id", "left_anti").withColumn("reason", F.lit("no PDF"))
    none = F.lit(-1)
    cols = ["page_id", "link", "text"]
    out = one.where("kind <> 'html'").select(*cols, "reason", F.col("pos").alias("a"), none.alias("b")).unionByName(dead.select(*cols, "reason", F.col("pos").alias("a"), none.alias("b")))
    out = out.unionByName(two.select(*cols, F.when((F.col("kind") == "html") & F.col("reason").isNull(), "no PDF").otherwise(F.col("reason")).alias("reason"), F.col("above").alias("a"), F.col("below").alias("b")))
    name = F.regexp_extract(F.regexp_extract("link", r"^[^?#]*", 0), r"([^/]*)$", 1)
    order = Window.partitionBy("page_id").orderBy("a", "b", "link")
    return out.select("page_id", (F.row_number().over(order) - 1).alias("no"), "link", F.when(name != "", name).otherwise(F.col("link")).alias("label"), "text", "reason")


def with_attachments(laws: DataFrame, attached: DataFrame) -> DataFrame:
    """Parsed laws with their attachments' texts behind their own (附件：label), the hash over all, and what became of each in ``attachments``."""
    block = F.concat(F.lit("\n\n附件："), "label", F.lit("\n"), "text")
    got = attached.groupBy("page_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("no", block.alias("x"))))), lambda r: r["x"]), "").alias("tail"),
        F.struct(F.count("*").alias("discovered"), F.count("text").alias("parsed"), F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct(F.col("link").alias("url"), "reason")))).alias("skipped")).alias("attachments"),
    )
    j = laws.join(got, "page_id", "left").withColumn("tail", F.coalesce("tail", F.lit("")))
    none = F.struct(F.lit(0).cast("long").alias("discovered"), F.lit(0).cast("long").alias("parsed"), F.array().cast("array<struct<url: string, reason: string>>").alias("skipped"))
    digest = F.when(F.col("tail") == "", F.col("content_hash")).otherwise(F.sha2(F.concat("content_hash", F.lit("\n"), X.squash(F.col("tail"))), 256))
    return j.withColumns({"text": F.concat("text", "tail"), "content_hash": digest, "attachments": F.coalesce("attachments", none)}).drop("tail")


def ingest_pages(pages: DataFrame, laws: DataFrame, versions: DataFrame, get: Callable[[str], tuple[str, bytes]] | None = None, read: Callable = readers.pdf_pages, embed: Callable[[Column], Column] | None = None, revision: int = V.PARSER_REVISION) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(report, added rows by table) of fetched pages (``page_id, source_key, url, html, fetched_at``; one a key).

    The report has ``source_key, status, version_no, reason``: inserted, unchanged, reprocess_required, or error for pages with less
    than ``LEAST`` characters or without chunks. Laws whose body stands unchanged in the stored text are left before any attachment is
    fetched; without ``get`` there are no attachments.
    """
    parsed = cut(parsed_laws(pages).join(pages.select("page_id", "source_key", "url", "fetched_at"), "page_id"))
    why = F.when(F.length("text") < LEAST, "too short").when(F.col("n_chunks") == 0, "no chunks")
    bad = parsed.where(why.isNotNull()).select("source_key", F.lit("error").alias("status"), F.lit(None).cast("long").alias("version_no"), why.alias("reason"))
    good = parsed.where(why.isNull())
    early = cut(V.unchanged_early(good.select("source_key", F.col("text").alias("body")), laws, versions, revision))
    rest = good.join(early.select("source_key"), "source_key", "left_anti")
    todo = pages.join(rest.select("page_id"), "page_id", "left_semi")
    none = todo.limit(0).select("page_id", *(F.lit(None).cast(t).alias(c) for c, t in (("no", "int"), ("link", "string"), ("label", "string"), ("text", "string"), ("reason", "string"))))
    full = with_attachments(rest, expanded_attachments(todo, get, read) if get else none)
    stored = F.to_json(F.struct("meta.*", "attachments", F.lit(revision).alias("parser_revision"), F.col("url").alias("retrieved_url")))
    incoming = cut(full.select("source_key", "title", F.col("url").alias("source_url"), "content_hash", F.col("text").alias("raw_text"), stored.alias("metadata_json"), "fetched_at"))
    late = V.upsert_status(incoming, laws, versions, revision).select("source_key", "status", "version_no", F.lit(None).cast("string").alias("reason"))
    changed, added = V.upsert_rows(incoming, laws, versions, revision)
    report = bad.unionByName(early.withColumn("reason", F.lit(None).cast("string"))).unionByName(late)
    titles = changed.select("law_id", "title").unionByName(laws.select("law_id", "title").join(changed.select("law_id"), "law_id", "left_anti"))
    return report, {"laws": changed, "law_versions": added, "law_chunks": V.version_chunks(added, embed, titles)}


# ---- letters of interpretation

# The labels of a letter's sections and of what is told about it.
SECTIONS = ("要旨", "主旨", "說明", "內容", "函釋內容", "相關法條")
TOLD = ("發文機關", "發文字號", "發文日期", "發布日期", "函釋日期")


def label_line_sections(text: Column) -> Column:
    """Sections (label, value) of a text in which a label stands on a line of its own: each to the next label."""
    bare = lambda s: F.regexp_replace(s, "^[：: ]+|[：: ]+$", "")
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda s: s != "")
    start = F.struct(F.array().cast("array<struct<label: string, value: string>>").alias("done"), F.lit(None).cast("string").alias("label"), F.array().cast("array<string>").alias("held"))
    closed = lambda a: F.when(a["label"].isNotNull() & (F.size(a["held"]) > 0), F.concat(a["done"], F.array(F.struct(a["label"].alias("label"), F.array_join(a["held"], "\n").alias("value"))))).otherwise(a["done"])
    step = lambda a, s: F.when(bare(s).isin(*SECTIONS), F.struct(closed(a).alias("done"), bare(s).alias("label"), F.array().cast("array<string>").alias("held"))).otherwise(F.struct(a["done"].alias("done"), a["label"].alias("label"), F.concat(a["held"], F.array(s)).alias("held")))
    return F.aggregate(lines, start, step, closed)


def letters(pages: DataFrame, least: int = 80, house: str = "消防署函釋") -> DataFrame:
    """``page_id, eid, number, title, sections, text, meta, reason``: letters of interpretation (``page_id, eid, html``), read from their pages.

    Sections come from the two-cell rows of tables, else from lines of labels. A page that doesn't show its number, has less than
    ``least`` characters or no section of a body has a reason.
    """
    t = cut(pages.where("html is not null").select("page_id", "eid", H.labelled_rows(F.col("html")).alias("rows"), H.page_text(F.col("html")).alias("shown")))
    number = F.get(F.split("eid", ","), F.lit(2))
    of = lambda names: F.filter("rows", lambda r: r["label"].isin(*names) & (r["value"] != ""))
    told = F.map_from_entries(F.transform(F.array_distinct(F.transform(of(TOLD), lambda r: r["label"])), lambda x: F.struct(x.alias("key"), F.element_at(F.filter(of(TOLD), lambda r: r["label"] == x), -1)["value"].alias("value"))))
    t = t.withColumns({"number": number, "sections": F.when(F.size(of(SECTIONS)) > 0, of(SECTIONS)).otherwise(label_line_sections(F.col("shown"))), "meta": told})
    t = t.withColumn("text", F.array_join(F.transform("sections", lambda s: F.concat(s["label"], F.lit("："), s["value"])), "\n\n"))
    reason = F.when(~F.contains(X.squash(F.col("shown")), F.col("number")), "another number").when(F.length("text") < least, "too short").when(~F.exists("sections", lambda s: s["label"].isin(*SECTIONS[:5])), "no body")
    return t.select("page_id", "eid", "number", F.concat(F.lit(house + "（"), "number", F.lit("）")).alias("title"), "sections", "text", "meta", reason.alias("reason"))


def letter_chunks(docs: DataFrame) -> DataFrame:
    """``page_id, seq, article_label, heading, content``: a letter's sections, long ones in windows, each below what is told about it."""
    head = F.array_join(F.filter(F.transform(F.array(*map(F.lit, TOLD)), lambda k: F.concat(k, F.lit("："), F.element_at("meta", k))), lambda s: s.isNotNull()), "\n")
    s = docs.where("reason is null").select("page_id", "title", head.alias("head"), F.posexplode("sections").alias("n", "s"))
    body = s.withColumn("body", F.concat("s.label", F.lit("："), "s.value")).select("page_id", "title", "head", "n", "s.label", F.length("body").alias("size"), F.posexplode(C.stride_windows("body")).alias("k", "part"))
    order = Window.partitionBy("page_id").orderBy("n", "k")
    label = F.when(F.col("size") > 2_600, F.concat("label", F.lit(" "), (F.col("k") + 1).cast("string"))).otherwise(F.col("label"))
    return body.select("page_id", F.row_number().over(order).alias("seq"), label.alias("article_label"), F.col("title").alias("heading"), F.concat_ws("\n", F.when(F.col("head") != "", F.col("head")), "part").alias("content"))


def letter_date(eid: Column) -> Column:
    """The date in a letter's four-part id, as 民國y年m月d日; null where it is none."""
    d = F.try_to_date(F.get(F.split(eid, ","), F.lit(3)), "yyyyMMdd")
    return F.when(F.year(d) > 1911, F.format_string("民國%d年%d月%d日", F.year(d) - 1911, F.month(d), F.day(d)))


def letter_versions(docs: DataFrame, prefix: str = "fint:") -> DataFrame:
    """Letters as incoming texts for ``upsert_rows``: keyed by their id, hashed over text and what is told about them."""
    payload = F.to_json(F.struct(F.col("meta").alias("metadata"), "text"))
    return docs.where("reason is null").select(F.concat(F.lit(prefix), "eid").alias("source_key"), "title", F.sha2(payload, 256).alias("content_hash"), F.col("text").alias("raw_text"), F.to_json("meta").alias("metadata_json"))


def pdf_page_checks(pages: list[str], number: str, least: int = 20) -> tuple[list[str], str | None]:
    """(cleaned pages, why the PDF can't be taken): it must show its number, and every page must have a text."""
    clean = ["\n".join(x for x in (" ".join(line.split()) for line in p.splitlines()) if x) for p in pages]
    if number not in "".join("".join(clean).split()):
        return clean, "another number"
    empty = [i + 1 for i, p in enumerate(clean) if len(p) < least]
    return clean, f"no text on page {empty[0]}" if empty else None


def stored_name(content: bytes) -> str:
    """The name of a PDF by its content: the same bytes are the same file."""
    import hashlib

    return hashlib.sha256(content).hexdigest() + ".pdf"


def store_file(content: bytes, folder: str) -> str:
    """Copies a PDF under its content's name; a file that is there already stays. Gives the name."""
    import os
    import tempfile
    from pathlib import Path

    name = stored_name(content)
    at = Path(folder) / name
    if not at.exists():
        Path(folder).mkdir(parents=True, exist_ok=True)
        with tempfile.NamedTemporaryFile(dir=folder, delete=False) as f:
            f.write(content)
        os.replace(f.name, at)
    return name
