"""The deterministic halves of answering: directives, checks of a model's text, token limits, links to evidence and pages."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an answer says when its evidence is not enough.
INSUFFICIENT = ("目前檢索到的法規資料不足", "資料不足以確認", "無法確認", "無法從提供的資料", "資料中，並未", "資料中未", "沒有明確的定義", "需要查找", "若要回答此問題，需要")


def web_request(query: Column, mode: Column) -> Column:
    """A struct (query, mode): a leading /web is taken off and forces the web; the query is null if nothing is left."""
    t = F.regexp_replace(query, r"(?U)^\s+|\s+$", "")
    forced = t.rlike(r"(?iU)^/web(?=\s|$)")
    rest = F.regexp_replace(F.regexp_replace(t, r"(?iU)^/web(?=\s|$)", ""), r"(?U)^\s+|\s+$", "")
    text = F.when(forced, rest).otherwise(t)
    return F.struct(F.when(text != "", text).alias("query"), F.when(forced, "force").otherwise(mode).alias("mode"))


def admits_lack(answer: Column) -> Column:
    """Whether an answer says that its evidence is not enough."""
    return F.exists(F.array(*map(F.lit, INSUFFICIENT)), lambda m: F.contains(answer, m))


def is_incomplete(answer: Column, done: Column, reason: Column) -> Column:
    """Whether a model's text broke off: not done, cut by length, empty, or ending in a short line without a closing mark."""
    t = F.regexp_replace(F.regexp_replace(answer, r"(?U)\s+$", ""), r"[*_` ]+$", "")
    line = F.regexp_replace(F.try_element_at(F.split(t, "\n"), F.lit(-1)), r"^[ \-*\t]+|[ \-*\t]+$", "")
    closed = t.rlike(r"(?:[。！？.!?\]）)】」』]|\[\d+\])$")
    return ~done | F.coalesce(F.lower(reason).isin("length", "max_tokens"), F.lit(False)) | (t == "") | (~closed & (F.length(line) <= 8))


def token_limits(prompts: DataFrame, profiles: DataFrame, default: tuple[int, int] = (4096, 2048), safety: int = 512) -> DataFrame:
    """Prompts (``model, prompt``) with their models' limits: context, configured and effective output, estimated prompt tokens.

    ``profiles``: ``model, context_tokens, output_tokens, found_context`` (what the model itself says, or null), one row a model.
    """
    from lexspark.functions.text import output_tokens, token_estimate

    j = prompts.join(profiles, "model", "left")
    context = F.least(F.coalesce("context_tokens", F.lit(default[0])), F.coalesce("found_context", "context_tokens", F.lit(default[0])))
    out, n = F.coalesce("output_tokens", F.lit(default[1])), token_estimate(F.col("prompt"))
    return j.select("model", "prompt", context.alias("context_tokens"), out.alias("configured_output"), n.alias("prompt_tokens"), output_tokens(out, context, n, safety).alias("effective_output"))


def link_citations(answer: Column, cited: Column) -> Column:
    """An answer as HTML text with links on the citations [n] among ``cited``; all else is escaped."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def link(a: pd.Series, c: pd.Series) -> pd.Series:
        def one(text, ids):
            ok = set() if ids is None else {int(i) for i in ids}
            return None if text is None else re.sub(r"\[(\d+)\]", lambda m: f'<a href="#evidence-{int(m[1])}">[{int(m[1])}]</a>' if int(m[1]) in ok else m[0], html.escape(text))

        return pd.Series([one(t, i) for t, i in zip(a, c)])

    return link(answer, cited)


def pdf_link(metadata: Column, label: Column, base: str = "/app/static/local-pdfs/") -> Column:
    """The link to a page of a stored PDF named by its hash; null unless name, label 第n頁 and page count fit."""
    name, pages = F.get_json_object(metadata, "$.local_pdf_name"), F.get_json_object(metadata, "$.pdf_page_count").try_cast("int")
    page = F.regexp_extract(label, r"(?U)^第(\d+)頁(?:\s+\d+)?$", 1).try_cast("int")
    return F.when(name.rlike(r"^[0-9a-f]{64}\.pdf$") & page.between(1, pages), F.concat(F.lit(base), name, F.lit("#page="), page.cast("string")))


def letter_id(url: Column, host: str, path: str) -> Column:
    """The four-part EID of a letter's direct address on a host and path (https, one EID, parts in form); null for all else."""
    from lexspark.functions import urls as U

    ids = F.filter(U.parameters(url), lambda p: p["name"] == "eid")
    eid = F.try_element_at(F.filter(F.transform(ids, lambda p: p["value"]), lambda v: v != ""), F.lit(1))
    part = F.split(eid, ",")
    form = (F.size(part) == 4) & F.get(part, F.lit(0)).rlike(r"^[A-Z][0-9]{5}$") & F.length(F.get(part, F.lit(1))).between(1, 30) & F.get(part, F.lit(2)).rlike("^[0-9]{6,12}$") & F.get(part, F.lit(3)).rlike("^[0-9]{8}$")
    place = (F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & (U.host(url) == host) & (F.lower(F.try_parse_url(url, F.lit("PATH"))) == path.lower()) & F.try_parse_url(url, F.lit("USERINFO")).isNull() & F.try_parse_url(url, F.lit("REF")).isNull()
    return F.when((F.size(ids) == 1) & place & form, eid)


def page_lines(text: Column, noise: str = r"^列印時間：|^https?://\S+$|^\d+/\d+$") -> Column:
    """A PDF page's text without print heads, addresses and page counters, with single blanks."""
    lines = F.transform(F.split(text, r"\r\n|[\r\n]"), lambda s: F.regexp_replace(F.regexp_replace(s, r"[ \t]+", " "), r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda s: (s != "") & ~s.rlike(noise)), "\n")
