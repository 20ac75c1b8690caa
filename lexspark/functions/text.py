"""Text functions over columns: cleaning, terms, numerals, labels, intents of queries. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, patterns and formats of the domain.
POLITE_PREFIXES = ("請再次協助查詢", "請再次協助說明", "請再次查詢", "請再次說明", "請協助查詢", "請協助說明", "麻煩查詢", "麻煩說明", "想請問", "請查詢", "請說明", "請問")
DEFINITION_MARKERS = ("定義", "何謂", "所稱", "係指", "是指")
IDENTITY_MARKERS = ("是誰", "什麼是", "指誰")
ACTION_MARKERS = ("應如何", "應負", "應辦", "義務", "責任", "程序", "期限", "罰鍰", "處罰", "申請", "設置", "維護", "辦理")
COMPARISON_MARKERS = ("差異", "不同", "區別", "比較", "各自", "分別", "有何差別")
SCOPE_MARKERS = ("權限", "職權", "業務範圍", "執業範圍", "可以做", "能做", "得從事")
ANSWER_MARKERS = ("應由", "得由", "不得", "僅限", "為之", "負責", "執行", "辦理", "設計", "監造", "測試", "檢修", "職務", "業務")
BROAD_MARKERS = ("相關規定", "有哪些規定", "規定為何", "規定有哪些")
EXHAUSTIVE_MARKERS = ("所有", "全部", "全數", "完整", "逐條", "每一條")
PENALTY_MARKERS = ("懲處", "懲罰", "處罰", "裁罰", "罰則", "罰鍰", "罰金", "刑責")
PENALTY_WORDS = "罰則 處罰 裁罰 罰鍰 罰金 有期徒刑 拘役"
ANNOUNCING = ("主管機關", "內政部", "消防署")
LATEST_MARKERS, LAW_WORDS = ("最新", "現行", "最近", "修正", "修訂", "版本"), ("法", "條例", "辦法", "標準", "規則")
SEVERAL_PLACES, APPOINTING = ("多個場所", "不同場所", "兩個場所", "2個場所"), ("遴選", "遴用", "兼任", "擔任")
NO_OBJECTS = ("哪些", "什麼", "何者", "何種", "那些", "哪一些")
TITLE_SUFFIXES = ("消防安全設備相關規定", "相關規定", "自治條例", "注意事項", "作業要點", "處理原則", "管理辦法", "實施辦法", "申報辦法", "辦法", "規則", "標準", "規程", "要點")
NOISE_LINES = (
    "^內政部消防署(?:法令|法規)查詢系統$", "^消防法令查詢系統$", "^列印時間[：:]?", "^所有條文$", "^回首頁$", "^回上一頁$", "^版權所有.*內政部消防署", "^本網站為每月定期更新",
    "^法規資料更新日期[：:]?", "^如需查詢最新法規", "^部分資料內容.*司法院網站", "^建議最佳瀏覽環境", "^最後更新日期",
)
NUMERALS = "一二三四五六七八九十百千萬〇○零兩壹貳參肆伍陸柒捌玖拾佰仟"
HINT_NUMERALS = "一二三四五六七八九十百千萬〇○零兩"

NOISE = "|".join(NOISE_LINES)
TOKEN = r"[\x{3400}-\x{9fff}A-Za-z0-9]+"
_WORD = r"[\x{3400}-\x{9fff}A-Za-z0-9（）()、與和及]"


def squash(c: Column) -> Column:
    """Without any white space, in the Unicode sense."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def has_any(c: Column, words: Sequence[str]) -> Column:
    """Whether one of the words occurs in the text."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))


def count_markers(c: Column, words: Sequence[str]) -> Column:
    """How many of the words occur in the text."""
    return F.aggregate(F.array(*map(F.lit, words)), F.lit(0), lambda n, w: n + F.contains(c, w).cast("int"))


def clean_lines(c: Column) -> Column:
    """Lines with single blanks, trimmed, without empty ones and without those of the site itself (as an array)."""
    lines = F.split(F.regexp_replace(c, r"[　 ]", " "), r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]")
    tidy = F.transform(lines, lambda s: F.regexp_replace(F.regexp_replace(s, r"[ \t]+", " "), r"(?U)^\s+|\s+$", ""))
    return F.filter(tidy, lambda s: (s != "") & ~s.rlike(NOISE))


def grams(c: Column, n: int) -> Column:
    """All runs of n characters of a text, in order, with repetitions; in time linear in the text (substring by position isn't)."""
    return F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))."), 1)  # the dot steps over whole characters


def lexical_terms(c: Column) -> Column:
    """The distinct terms of a text: runs of two and three ideographs, and other tokens whole, in small letters."""
    tokens = F.regexp_extract_all(F.lower(c), F.lit(f"({TOKEN})"), 1)
    each = F.transform(tokens, lambda t: F.when(t.rlike(r"^[\x{3400}-\x{9fff}]+$"), F.concat(grams(t, 2), grams(t, 3))).otherwise(F.array(t)))
    return F.array_distinct(F.flatten(each))


def match_terms(c: Column, limit: int = 80) -> Column:
    """A query's index terms: tokens and their runs of two and three characters, the ``limit`` longest (then in order of text)."""
    tokens = F.regexp_extract_all(F.lower(c), F.lit(f"({TOKEN})"), 1)
    terms = F.array_distinct(F.concat(tokens, F.flatten(F.transform(tokens, lambda t: F.concat(grams(t, 2), grams(t, 3))))))
    keyed = F.array_sort(F.transform(terms, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.transform(F.slice(keyed, 1, limit), lambda x: x["t"])


def index_terms(c: Column) -> Column:
    """A text's index terms with repetitions: its tokens and their runs of one, two and three characters."""
    tokens = F.regexp_extract_all(F.lower(c), F.lit(f"({TOKEN})"), 1)
    return F.flatten(F.transform(tokens, lambda t: F.concat(F.when(F.length(t) > 3, F.array(t)).otherwise(F.array().cast("array<string>")), grams(t, 1), grams(t, 2), grams(t, 3))))


def numeral(c: Column) -> Column:
    """The value of a numeral in digits or ideographs, placed (一〇五) or named (一百零五); null for anything else."""
    plain = F.translate(c, "○兩０１２３４５６７８９", "〇二0123456789")
    digits = F.translate(plain, "零〇一二三四五六七八九", "00123456789")
    step = lambda a, ch: (
        F.when(ch == "萬", F.struct(((a["section"] + a["digit"]) * 10000 + a["total"]).alias("total"), F.lit(0).cast("long").alias("section"), F.lit(0).cast("long").alias("digit")))
        .when(ch.isin("千", "百", "十"), F.struct(a["total"].alias("total"), (a["section"] + F.greatest(a["digit"], F.lit(1).cast("long")) * F.when(ch == "千", 1000).when(ch == "百", 100).otherwise(10)).alias("section"), F.lit(0).cast("long").alias("digit")))
        .otherwise(F.struct(a["total"].alias("total"), a["section"].alias("section"), F.coalesce(ch.try_cast("long"), F.lit(0)).alias("digit")))
    )
    zero = F.lit(0).cast("long")
    named = F.aggregate(F.split(digits, ""), F.struct(zero.alias("total"), zero.alias("section"), zero.alias("digit")), step, lambda a: a["total"] + a["section"] + a["digit"])
    return F.when(digits.rlike("^[0-9]+$"), digits.try_cast("long")).when(digits.rlike("^[0-9十百千萬]+$"), named)


_LABEL = f"^第([{HINT_NUMERALS}0-9]+)(?:(?:-|之)([{HINT_NUMERALS}0-9]+))?條(?:之([{HINT_NUMERALS}0-9]+))?$"


def canonical_label(c: Column) -> Column:
    """An article's label in one form, 第N條 or 第N-M條; null for what is no article's label or has two sub-numbers."""
    s = squash(c)
    a, b, d = (F.regexp_extract(s, _LABEL, i) for i in (1, 2, 3))
    sub = F.when(b != "", b).otherwise(d)
    return F.when(
        s.rlike(_LABEL) & ~((b != "") & (d != "")),
        F.concat(F.lit("第"), numeral(a).cast("string"), F.when(sub != "", F.concat(F.lit("-"), numeral(sub).cast("string"))).otherwise(""), F.lit("條")),
    )


def article_hints(c: Column) -> Column:
    """The canonical labels of the articles that a query names, in order."""
    found = F.regexp_extract_all(c, F.lit(rf"(?U)(第\s*[{HINT_NUMERALS}\d\-之]+\s*條(?:\s*之\s*[一二三四五六七八九十百千\d]+)?)"), 1)
    return F.filter(F.transform(found, canonical_label), lambda x: x.isNotNull())


def article_hint(c: Column) -> Column:
    """The one article that a query names; null if it names none or several."""
    h = article_hints(c)
    return F.when(F.size(h) == 1, F.try_element_at(h, F.lit(1)))


def normalize_query(c: Column) -> Column:
    """A query without its polite opening and closing marks, with single blanks."""
    opened = F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), f"^(?:{'|'.join(POLITE_PREFIXES)})[ ，、:：]*", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(opened, "[?？!！。]+$", ""), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def focus_terms(c: Column) -> Column:
    """What a query asks to be included (是否包含…): the objects, each of 2 to 20 characters, distinct and in order."""
    found = F.regexp_extract_all(c, F.lit(rf"(?U)(?:包含|包括|涵蓋|納入)\s*({_WORD}{{2,30}})"), 1)
    parts = F.flatten(F.transform(found, lambda x: F.split(F.regexp_replace(x, "(?:嗎|呢|之內|在內)$", ""), "[、與和及]")))
    tidy = F.transform(parts, lambda x: F.regexp_replace(x, "^[ ，、:：?？!！。]+|[ ，、:：?？!！。]+$", ""))
    return F.array_distinct(F.filter(tidy, lambda x: F.length(x).between(2, 20) & ~x.isin(*NO_OBJECTS)))


def facets(c: Column) -> Column:
    """A query's clauses and the objects it asks about, distinct and in order."""
    clauses = F.filter(F.transform(F.split(c, "[?？!！;；。]+"), lambda x: F.regexp_replace(x, "^[ ，、:：]+|[ ，、:：]+$", "")), lambda x: F.length(x) >= 2)
    return F.array_distinct(F.concat(clauses, focus_terms(c)))


def _names_article(c: Column) -> Column:
    return squash(c).rlike(rf"第[{HINT_NUMERALS}0-9\-之]+條")


def is_definition_query(c: Column) -> Column:
    run = F.regexp_replace(c, r"[^\x{3400}-\x{9fff}]", "")
    return has_any(c, DEFINITION_MARKERS) | (~has_any(c, ACTION_MARKERS) & (has_any(c, IDENTITY_MARKERS) | (F.contains(c, F.lit("的")) & F.length(run).between(1, 30))))


def is_broad_query(c: Column) -> Column:
    return ~_names_article(c) & has_any(squash(c), BROAD_MARKERS)


def is_exhaustive_query(c: Column) -> Column:
    return ~_names_article(c) & has_any(squash(c), EXHAUSTIVE_MARKERS)


def is_penalty_query(c: Column) -> Column:
    return has_any(squash(c), PENALTY_MARKERS)


def asks_announcement(c: Column) -> Column:
    return F.contains(squash(c), F.lit("公告")) & has_any(squash(c), ANNOUNCING)


def asks_latest_law(c: Column) -> Column:
    return has_any(squash(c), LATEST_MARKERS) & has_any(squash(c), LAW_WORDS)


def is_comparison_query(c: Column) -> Column:
    side = r"[\x{3400}-\x{9fff}A-Za-z0-9（）()]{2,24}"
    return squash(c).rlike(rf"(?i){side}(?:與|和|及|跟|、|vs\.?){side}") & has_any(c, COMPARISON_MARKERS + SCOPE_MARKERS)


def section_heading(c: Column) -> Column:
    """The heading that an exhaustive query asks for; null if none."""
    return F.when(is_exhaustive_query(c) & is_penalty_query(c), F.lit("罰則"))


def expand_query(c: Column) -> Column:
    """The query with the bounded list of words that mean the same in the texts."""
    s = squash(c)
    several = F.contains(s, F.lit("防火管理人")) & has_any(s, SEVERAL_PLACES) & has_any(s, APPOINTING)
    return F.concat_ws(" ", c, F.when(is_penalty_query(c), F.lit(PENALTY_WORDS)), F.when(several, F.lit("不同場所 兼任")))


def title_key(c: Column) -> Column:
    """A title's or query's words without connectors and without its last kind of rule."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)[\s、，,及與和暨（）()《》「」『』]+", ""), f"(?:{'|'.join(TITLE_SUFFIXES)})$", "")


def defined_terms(c: Column) -> Column:
    """The terms that a text defines (所稱…，)."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?U)所稱\s*([\x{3400}-\x{9fff}A-Za-z0-9（）()]{2,24}?)\s*(?:，|、|：|:|係指|是指)"), 1))


def query_side(c: Column) -> Column:
    """What scoring needs of a query, once a query: its terms, objects asked for, whether and how it asks for a definition, article."""
    t = lexical_terms(c)
    return F.struct(
        F.when(F.size(t) > 0, t).otherwise(F.array(F.lower(c))).alias("terms"),
        F.transform(focus_terms(c), F.lower).alias("focus"),
        is_definition_query(c).alias("defines"),
        has_any(c, DEFINITION_MARKERS).alias("explicit"),
        F.regexp_replace(c, r"[^\x{3400}-\x{9fff}]", "").alias("run"),
        article_hint(c).alias("article"),
    )


def provision_side(title: Column, label: Column, heading: Column, content: Column) -> Column:
    """What scoring needs of a provision, once a provision: its terms by field, all its text, the terms it defines, its label."""
    terms = lambda c: lexical_terms(F.coalesce(c, F.lit("")))
    return F.struct(
        terms(content).alias("content"),
        terms(heading).alias("heading"),
        terms(title).alias("title"),
        F.lower(F.concat_ws(" ", title, label, heading, content)).alias("text"),
        defined_terms(content).alias("defined"),
        canonical_label(label).alias("article"),
    )


def definition_score(q: Column, p: Column) -> Column:
    """1 where the text defines a term of the query, 0.55 where it defines another and the query asks for a definition, else 0."""
    return (
        F.when((F.size(p["defined"]) == 0) | ~q["defines"], 0.0)
        .when(F.exists(p["defined"], lambda t: F.contains(q["run"], t)), 1.0)
        .when(q["explicit"], 0.55)
        .otherwise(0.0)
    )


def lexical_score(q: Column, p: Column) -> Column:
    """How well a provision's words answer a query, from 0 to 1, of ``query_side`` and ``provision_side``."""
    share = lambda t: F.size(F.array_intersect(q["terms"], t)) / F.size(q["terms"])
    return F.least(
        F.lit(1.0),
        F.greatest(
            share(p["content"]),
            share(p["heading"]) * 0.9,
            share(p["title"]) * 0.8,
            F.when(F.exists(q["focus"], lambda x: F.contains(p["text"], x)), 1.0).otherwise(0.0),
            definition_score(q, p),
            F.when(q["article"].isNotNull() & q["article"].eqNullSafe(p["article"]), 1.0).otherwise(0.0),
        ),
    )


def is_deleted(label: Column, content: Column) -> Column:
    """Whether a provision says only that it is deleted."""
    s, own = squash(content), squash(F.coalesce(label, F.lit("")))
    rest = F.when((own != "") & F.startswith(s, own), F.substring(s, F.length(own) + 1, F.length(s))).otherwise(s)
    return rest.isin("刪除", "（刪除）", "(刪除)")


def is_primary_statute(title: Column) -> Column:
    t = F.regexp_replace(title, r"(?U)^\s+|\s+$", "")
    return t.endswith("條例") | (t.endswith("法") & ~t.endswith("辦法"))


def trigrams(c: Column) -> Column:
    """The distinct runs of three characters of a text in small letters, with two blanks before and one behind."""
    return F.array_distinct(grams(F.concat(F.lit("  "), F.lower(F.coalesce(c, F.lit(""))), F.lit(" ")), 3))


def set_similarity(a: Column, b: Column) -> Column:
    """Shared elements by all of either, of two arrays of distinct elements."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared runs of three characters by all of either text."""
    return set_similarity(trigrams(a), trigrams(b))


def roc_date(c: Column, labels: Sequence[str] = ("發布日期", "公布日期", "修正日期", "公告日期", "發文日期")) -> Column:
    """The first valid date behind one of the labels in the first 4,000 characters; years under 1911 count from 1911. Null if none."""
    head = F.substring(c, 1, 4000)
    found = F.regexp_extract_all(head, F.lit(rf"(?U)(?:{'|'.join(labels)})[：:]?\s*(?:中華民國|民國)?\s*(\d{{2,4}}\s*[年./-]\s*\d{{1,2}}\s*[月./-]\s*\d{{1,2}})"), 1)

    def parse(s: Column) -> Column:
        p = F.split(F.regexp_replace(s, r"(?U)\s+", ""), "[年月./-]")
        y = p[0].cast("int")
        return F.try_to_date(F.concat_ws("-", F.lpad(F.when(y < 1911, y + 1911).otherwise(y).cast("string"), 4, "0"), F.lpad(p[1], 2, "0"), F.lpad(p[2], 2, "0")), "yyyy-MM-dd")

    return F.try_element_at(F.concat(F.filter(F.transform(found, parse), lambda d: d.isNotNull()), F.array(F.lit(None).cast("date"))), F.lit(1))


def token_estimate(c: Column) -> Column:
    """At least how many tokens a prompt may take: its characters, or a third of its bytes."""
    return F.greatest(F.lit(1), F.length(c), F.ceil(F.octet_length(c) / 3).cast("int"))


def output_tokens(configured: Column, context: Column, prompt: Column, safety: int = 512) -> Column:
    """The tokens that are left for an answer, at least 64."""
    return F.greatest(F.lit(64), F.least(configured, F.greatest(F.lit(64), context - prompt - safety)))


def citations(answer: Column, evidence: Column) -> Column:
    """The distinct numbers [n] that an answer cites, in order, if there are any and all are within 1..evidence; else null."""
    n = F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[([0-9]{1,9})\]"), 1), lambda x: x.cast("int")))
    return F.when((F.size(n) > 0) & F.forall(n, lambda x: x.between(1, evidence)), n)
