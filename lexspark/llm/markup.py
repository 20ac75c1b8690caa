"""Problem 5: markup residue in texts, to clean text that still tells headings, list items, code and formulas.

Method: minimum-cut labelling. Every place that may be markup (a tag, a mark at a line's start, a pair of marks, a command) is a
node; a classifier's log odds are its capacity to the source (markup) or the sink (content); edges between neighbouring places, the
stronger the nearer they stand and if they are of one dialect, make them agree. The maximum flow separates markup from content: a
lone asterisk in plain text stays text, the same one among other marks of its dialect is a list item's. Texts with places on the
markup's side are then read in the dialect with most of them; the signs of places on the content's side are out of the reader's reach.

Only texts that hold a possible mark are looked at; they never move.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML and wiki tags.
_TAGS = "a|abbr|article|aside|b|big|blockquote|body|br|center|cite|code|dd|del|div|dl|dt|em|font|footer|h[1-6]|head|header|hr|html|i|img|ins|kbd|li|main|math|meta|nav|nowiki|ol|p|pre|ref|s|samp|script|section|small|source|span|strike|strong|style|sub|sup|syntaxhighlight|table|tbody|td|tfoot|th|thead|title|tr|tt|u|ul|var"
TAG = re.compile(rf"</?(?:{_TAGS})(?:\s+[a-z:-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>=]+))*\s*/?>", re.I)
COMMENT = re.compile(r"<!--.*?-->|<!doctype[^>]*>", re.S | re.I)
ENTITY = re.compile(r"&(?:[a-z]{2,8}|#\d{1,6}|#x[0-9a-f]{1,5});", re.I)
_URL = r"https?://[^\s)\]}]+"
#: (kind, dialect, log odds of markup, pattern): what may be markup. Each match is one node, pairs of marks too.
MARKS = [
    ("tag", "html", 4.0, TAG),
    ("comment", "html", 5.0, COMMENT),
    ("entity", "html", 3.0, ENTITY),
    ("fence", "md", 3.0, re.compile(r"^(```|~~~)[^\n`]*\n.*?^\1[ \t]*$", re.S | re.M)),
    ("atx", "md", 1.0, re.compile(r"^#{1,6}[ \t]+\S.*$", re.M)),
    ("setext", "md", 2.0, re.compile(r"^(?![-=*+#>\s])[^\n]+\n(?:={3,}|-{3,})[ \t]*$", re.M)),
    ("strong", "md", 2.5, re.compile(r"(\*{2,3})(?=[^\s*])[^*\n]+?(?<=[^\s*])\1")),
    ("emphasis", "md", 1.2, re.compile(r"(?<![*\w\\])\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*(?!\*)|(?<=[\w])\*(?=[^\s*\d])[^*\n]+?(?<=[^\s*])\*(?![*\d])")),
    ("tick", "md", 2.0, re.compile(r"(?<!`)`[^`\n]+`(?!`)")),
    ("link", "md", 4.0, re.compile(rf"!?\[[^\]\n]*\]\((?:{_URL}|[/#][^)\s]*)\)")),
    ("star", "", 0.0, re.compile(r"^[ \t]*[*+-][ \t]+\S.*$", re.M)),
    ("number", "md", -0.4, re.compile(r"^[ \t]*\d{1,3}[.)][ \t]+\S.*$", re.M)),
    ("title", "wiki", 2.5, re.compile(r"^(={1,6})[^=\n]+\1[ \t]*$", re.M)),
    ("quotes", "wiki", 3.0, re.compile(r"('{2,5})(?=[^'\n])[^\n]+?\1")),
    ("wikilink", "wiki", 3.0, re.compile(r"\[\[[^\[\]\n]+\]\]")),
    ("extlink", "wiki", 4.0, re.compile(rf"(?<!\])\[{_URL}(?:[ \t]+[^\]\n]*)?\](?!\()")),
    ("template", "wiki", 3.0, re.compile(r"\{\{[^{}]+\}\}")),
    ("environment", "tex", 5.0, re.compile(r"\\(?:begin|end)\{[a-z*]+\}(?:\[[^\]]*\])?")),
    ("command", "tex", 4.0, re.compile(r"\\(?:documentclass|usepackage|(?:sub)*section|chapter|paragraph|textbf|textit|texttt|emph|underline|href|url|item|label|ref|cite|footnote|title|author|date|maketitle|hfill|vspace|hspace|noindent|par|newline|newpage|quad|qquad|centering|small|large)\b\*?(?:\{\})?")),
    ("group", "tex", 4.0, re.compile(r"\{\\(?:bf|it|em|tt|sl|sc|rm|bfseries|itshape)\b")),
    ("newline", "tex", 1.5, re.compile(r"\\\\(?![A-Za-z])")),
    ("escape", "tex", 0.5, re.compile(r"\\[%&#_$]")),
    ("display", "", 3.0, re.compile(r"\$\$[^$]+?\$\$|\\\[[^\[\]]*?\\\]", re.S)),
    ("inline", "", 3.0, re.compile(r"(?<![\w$\\])\$(?=[^\s$])[^$\n㐀-鿿]*?[\\^_={][^$\n㐀-鿿]*?\$(?![\d$])|\\\([^\n]+?\\\)")),
]
#: Every text with a match of any of MARKS has one of these too: texts without are left unread.
_MAYBE = re.compile(r"[<&`#*=$\\\[{]|''|^[ \t]*[+-][ \t]|^\s*\d{1,3}[.)][ \t]|^-{3,}|^~~~", re.M)


class Flow:
    """Maximum flow by shortest augmenting paths; the minimum cut's source side."""

    def __init__(self, n: int):
        self.adj: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.cap: list[float] = []

    def edge(self, a: int, b: int, forth: float, back: float = 0.0) -> None:
        for x, y, c in ((a, b, forth), (b, a, back)):
            self.adj[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)

    def source_side(self, s: int, t: int) -> set[int]:
        while True:
            via = {s: -1}
            queue = deque([s])
            while queue and t not in via:
                x = queue.popleft()
                for e in self.adj[x]:
                    if self.cap[e] > 1e-9 and self.to[e] not in via:
                        via[self.to[e]] = e
                        queue.append(self.to[e])
            if t not in via:
                return set(via)
            path, x = [], t
            while x != s:
                path.append(via[x])
                x = self.to[via[x] ^ 1]
            least = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= least
                self.cap[e ^ 1] += least


def candidates(text: str) -> list[tuple[int, int, str, str, float]]:
    """(start, end, kind, dialect, log odds) of every place that may be markup, in order."""
    out = []
    for kind, dialect, odds, pattern in MARKS:
        out += [(m.start(), m.end(), kind, dialect, odds) for m in pattern.finditer(text)]
    out.sort()
    # Marks at line starts say more where the lines beside them have the same; numbers, where they are in sequence.
    starts = {s: (k, text[s:e].lstrip()) for s, e, k, _, _ in out if k in ("star", "number", "atx")}
    ends = {e: (k, text[s:e].lstrip()) for s, e, k, _, _ in out if k in ("star", "number", "atx")}
    for i, (s, e, k, d, o) in enumerate(out):
        if k not in ("star", "number", "atx"):
            continue
        own = text[s:e].lstrip()
        beside = [x for x in (ends.get(s - 1), starts.get(e + 1)) if x and x[0] == k]
        if k == "number":
            n = int(re.match(r"\d+", own)[0])
            beside = [x for x in beside if abs(int(re.match(r"\d+", x[1])[0]) - n) <= 1]
        elif k == "star":
            beside = [x for x in beside if x[1][0] == own[0]]
        out[i] = (s, e, k, d, o + 0.8 * len(beside) + (0.5 if s == 0 and k == "atx" else 0))
    return out


def labelled(text: str) -> list[tuple[int, int, str, str]]:
    """The places that are markup, by the minimum cut."""
    return cut(text)[0]


def cut(text: str) -> tuple[list[tuple[int, int, str, str]], list[tuple[int, int, str, str]]]:
    """(markup, content): the places on either side of the minimum cut."""
    c = candidates(text)
    if not c:
        return [], []
    n = len(c)
    line = _lines_of(text, [x[0] for x in c])
    g = Flow(n + 2)
    for i, (_, _, _, _, odds) in enumerate(c):
        odds -= 0.2
        g.edge(n, i, max(odds, 0.0))
        g.edge(i, n + 1, max(-odds, 0.0))
    for i in range(n):
        for j in range(i + 1, min(i + 4, n)):
            same = c[i][3] == c[j][3] or "" in (c[i][3], c[j][3])
            w = (0.9 if same else 0.3) / (1 + 0.25 * (line[j] - line[i])) / (j - i)
            g.edge(i, j, w, w)
    side = g.source_side(n, n + 1)
    return [c[i][:4] for i in range(n) if i in side], [c[i][:4] for i in range(n) if i not in side]


def _signs(text: str, place: tuple[int, int, str, str]) -> set[int]:
    """Where the signs stand that would make a place markup: its first ones, and for marks in pairs its last ones."""
    s, e, kind, _ = place
    own = text[s:e]
    if kind == "setext":
        at = own.index("\n") + 1
        return set(range(s + at, e))
    if kind == "number":
        at = re.search("[.)]", own).start()
        return {s + at}
    lead = re.match(r"\s*(.)\1*", own, re.S)
    found = set(range(s + lead.start(1), s + lead.end()))
    if kind == "link" and own[0] == "!":
        found.add(s + 1)
    if kind in ("star", "atx", "tag", "comment", "entity", "link", "environment", "command", "group", "newline", "escape"):
        return found
    tail = re.search(r"(.)\1*\s*\Z", own, re.S)
    return found | set(range(s + tail.start(), s + len(own.rstrip())))


def protected(text: str, markup: list[tuple[int, int, str, str]], content: list[tuple[int, int, str, str]]) -> tuple[str, dict[int, int]]:
    """The text with the signs of all places that are content put out of reach, and the table that puts them back.

    Signs that also belong to a place that is markup stay within reach.
    """
    hold = {i for x in content for i in _signs(text, x) if text[i].isascii() and not text[i].isspace()}
    hold -= {i for x in markup for i in _signs(text, x)}
    if not hold:
        return text, {}
    base = next(b for b in range(0xF0000, 0xFFF00, 0x80) if not any(b <= ord(c) < b + 0x80 for c in set(text)))
    out = list(text)
    for i in hold:
        out[i] = chr(base + ord(out[i]))
    return "".join(out), {base + c: c for c in range(0x80)}


def _lines_of(text: str, at: list[int]) -> list[int]:
    out, n, last = [], 0, 0
    for a in at:
        n += text.count("\n", last, a)
        last = a
        out.append(n)
    return out


def dialect_of(text: str, marks: list[tuple[int, int, str, str]]) -> str:
    """The dialect with most evidence; a tag of wiki's own, or one inside wiki or Markdown text, isn't HTML's."""
    odds = {k: o for k, _, o, _ in MARKS}
    sums = {"html": 0.0, "md": 0.0, "wiki": 0.0, "tex": 0.0}
    for s, e, k, d in marks:
        if k == "tag" and re.match(r"</?(?:math|syntaxhighlight|nowiki|ref|source)\b", text[s:e], re.I):
            d = "wiki"
        if k == "emphasis" and "''" in text:
            continue
        if d:
            sums[d] += max(odds[k], 0.3)
    return max(sums, key=lambda d: (sums[d], d))


_BLANK = re.compile(r"[\s\u00a0\u3000]+")


def _html_inline(s: str) -> str:
    return html.unescape(TAG.sub("", COMMENT.sub("", s)))


def _md_inline(s: str) -> str:
    s = re.sub(rf"!?\[([^\]\n]*)\]\((?:{_URL}|[/#][^)\s]*)\)", r"\1", s)
    s = re.sub(r"(?<!`)`([^`\n]+)`(?!`)", r"\1", s)
    s = re.sub(r"(?<!\\)(\*{1,3})(?=[^\s*])([^*\n]+?)(?<=[^\s*])\1", r"\2", s)
    s = re.sub(r"~~([^~\n]+)~~", r"\1", s)
    return _html_inline(re.sub(r"\\([\\`*_{}\[\]()#+.!|$~-])", r"\1", s))


def _wiki_inline(s: str) -> str:
    s = re.sub(r"\[\[(?:Category|File|Image|分類|檔案):[^\]]*\]\]", "", s, flags=re.I)
    s = re.sub(r"\{\{[^{}|\n]+\|(?:[^{}|\n]*\|)*([^{}|\n]*)\}\}", r"\1", s)
    s = re.sub(r"\{\{[^{}\n]*\}\}", "", s)
    s = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]+)\]\]", r"\1", s)
    s = re.sub(rf"\[{_URL}(?:[ \t]+([^\]\n]*))?\]", lambda m: m[1] or "", s)
    s = re.sub(r"<ref[^>]*>.*?</ref>", "", s, flags=re.S)
    return _html_inline(re.sub(r"'{2,5}", "", s))


def _tex_inline(s: str) -> str:
    s = re.sub(r"(?<!\\)%[^\n]*", "", s) if re.search(r"(?m)^%", s) else s
    for _ in range(4):
        t = re.sub(r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1", s)
        t = re.sub(r"\{\\(?:bf|it|em|tt|sl|sc|rm|bfseries|itshape)\b\s*([^{}]*)\}", r"\1", t)
        t = re.sub(r"\\(?:label|vspace|hspace|ref|cite|usepackage|documentclass)\*?(?:\[[^\]]*\])?\{[^{}]*\}", "", t)
        t = re.sub(r"\\(?!begin|end|frac|sqrt)[A-Za-z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1", t)
        if t == s:
            break
        s = t
    s = re.sub(r"\\(?:hfill|quad|qquad|noindent|par|newline|newpage|maketitle|centering|small|large|item)\b(?:\{\})?", "", s)
    s = re.sub(r"\\\\(?:\[[^\]]*\])?", "", s)
    return re.sub(r"\\([%&#_${}~^ ,;])", r"\1", re.sub(r"(?<!\\)~", " ", s))


_INLINE = {"html": _html_inline, "md": _md_inline, "wiki": _wiki_inline, "tex": _tex_inline}


def _strip_math(s: str) -> str:
    s = s.strip()
    for a, b in (("$$", "$$"), (r"\[", r"\]"), (r"\(", r"\)"), ("$", "$")):
        if len(s) >= len(a) + len(b) and s.startswith(a) and s.endswith(b):
            return s[len(a) : -len(b)].strip()
    return s


_MATH = next(p for k, _, _, p in MARKS if k == "display"), next(p for k, _, _, p in MARKS if k == "inline")


def convert(text: str, dialect: str, also: set[str] = frozenset()) -> list[tuple[str, str]]:
    """(kind, clean text) of the text's parts in order: heading, list_item, code, formula, text (paragraphs' lines).

    ``also``: other dialects of which marks were left in the text; their inline marks are taken out too.
    """
    held: list[tuple[str, str]] = []

    def inline(s: str) -> str:
        for d in (dialect, *sorted(also - {dialect, ""})):
            s = _INLINE[d](s)
        return s

    def keep(kind: str, value: str, block: bool = True) -> str:
        held.append((kind, value))
        mark = f"\x00{len(held) - 1}\x00"
        return f"\n{mark}\n" if block else mark

    t = text.replace("\r\n", "\n").replace("\x00", "")
    if "wiki" in (dialect, *also):  # a template may go over lines
        t = re.sub(r"\{\{[^{}|]+\|(?:[^{}|]*\|)*([^{}|]*)\}\}", r"\1", t)
    if dialect == "html":
        t = re.sub(r"<(script|style)\b.*?</\1\s*>", "", COMMENT.sub("", t), flags=re.S | re.I)
        t = re.sub(r"<pre\b[^>]*>\s*(?:<code\b[^>]*>)?(.*?)(?:</code>)?\s*</pre>", lambda m: keep("code", html.unescape(TAG.sub("", m[1]))), t, flags=re.S | re.I)
        t = re.sub(r"<math\b[^>]*>(.*?)</math>", lambda m: keep("formula", html.unescape(m[1]), False), t, flags=re.S | re.I)
        for p in _MATH:
            t = p.sub(lambda m: keep("formula", _strip_math(html.unescape(m[0])), False), t)
        t = re.sub(r"<(h[1-6])\b[^>]*>(.*?)</\1\s*>", lambda m: keep("heading", inline(m[2])), t, flags=re.S | re.I)
        t = re.sub(r"<li\b[^>]*>(.*?)(?=<li\b|</li\s*>|</?[uo]l\b|\Z)", lambda m: keep("list_item", inline(m[1])), t, flags=re.S | re.I)
        t = re.sub(r"<(?:br|p|div|tr|td|table|ul|ol)\b[^>]*>|</(?:p|div|tr|td|table|ul|ol)\s*>", "\n", t, flags=re.I)
    elif dialect == "md":
        t = re.sub(r"^(```|~~~)[^\n`]*\n(.*?)^\1[ \t]*$", lambda m: keep("code", m[2]), t, flags=re.S | re.M)
        t = COMMENT.sub("", t)
        for p in _MATH:
            t = p.sub(lambda m: keep("formula", _strip_math(m[0]), False), t)
        t = re.sub(r"^#{1,6}[ \t]+(.+?)(?:[ \t]+#+)?[ \t]*$", lambda m: keep("heading", inline(m[1])), t, flags=re.M)
        t = re.sub(r"^(?![-=*+#>\s\x00])([^\n]+)\n(?:={3,}|-{3,})[ \t]*$", lambda m: keep("heading", inline(m[1])), t, flags=re.M)
        t = re.sub(r"^[ \t]*(?:[*+-]|\d{1,3}[.)])[ \t]+(.+)$", lambda m: keep("list_item", inline(m[1])), t, flags=re.M)
    elif dialect == "wiki":
        t = COMMENT.sub("", t)
        t = re.sub(r"<(syntaxhighlight|source|pre)\b[^>]*>(.*?)</\1\s*>", lambda m: keep("code", m[2]), t, flags=re.S | re.I)
        t = re.sub(r"<math\b[^>]*>(.*?)</math>", lambda m: keep("formula", m[1], False), t, flags=re.S | re.I)
        t = re.sub(r"^(={1,6})([^=\n]+)\1[ \t]*$", lambda m: keep("heading", inline(m[2])), t, flags=re.M)
        t = re.sub(r"^[*#:;]+[ \t]*(.+)$", lambda m: keep("list_item", inline(m[1])), t, flags=re.M)
    else:
        t = re.sub(r"\\begin\{(verbatim|lstlisting|minted)\*?\}(?:\[[^\]]*\])?(.*?)\\end\{\1\*?\}", lambda m: keep("code", m[2]), t, flags=re.S)
        t = re.sub(r"\\begin\{(equation|align|displaymath|gather|math)(\*?)\}(.*?)\\end\{\1\2\}", lambda m: keep("formula", m[3]), t, flags=re.S)
        for p in _MATH:
            t = p.sub(lambda m: keep("formula", _strip_math(m[0]), False), t)
        t = re.sub(r"\\(?:chapter|(?:sub)*section|(?:sub)?paragraph|title)\*?(?:\[[^\]]*\])?\{((?:[^{}]|\{[^{}]*\})*)\}", lambda m: keep("heading", inline(m[1])), t)
        t = re.sub(r"\\item\b(?:\[[^\]]*\])?[ \t]*(.*?)(?=\\item\b|\\(?:begin|end)\{|\Z)", lambda m: keep("list_item", inline(m[1])), t, flags=re.S)
        t = re.sub(r"\\(?:begin|end)\{[^}]*\}(?:\[[^\]]*\])?|\\(?:documentclass|usepackage)(?:\[[^\]]*\])?\{[^}]*\}", "\n", t)

    def full(s: str) -> str:
        return re.sub(r"\x00(\d+)\x00", lambda m: full(held[int(m[1])][1]), s)

    out = []

    def walk(kind: str, value: str) -> None:
        out.append((kind, full(value).strip("\n") if kind == "code" else full(value).strip()))
        out.extend((held[int(n)][0], full(held[int(n)][1]).strip()) for n in re.findall(r"\x00(\d+)\x00", value) if held[int(n)][0] == "formula")

    for part in t.split("\n"):
        if m := re.fullmatch(r"\s*\x00(\d+)\x00\s*", part):
            walk(*held[int(m[1])])
        elif part.strip():
            walk("text", inline(part))
    return [(k, v) for k, v in out if v]


def read(text: str) -> tuple[bool, list[tuple[str, str]]]:
    """(whether the text has markup, its parts); a text without has its lines as they are.

    The cut decides place by place: what it leaves with the content is never converted, also among markup of the same kind.
    """
    if _MAYBE.search(text):
        marks, content = cut(text)
        if marks:
            safe, back = protected(text, marks, content)
            parts = convert(safe, dialect_of(text, marks), {d for *_, d in marks})
            return True, [(k, v.translate(back)) for k, v in parts] if back else parts
    return False, [("text", s) for s in text.split("\n") if s.strip()]


def clean_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``record_id, has_markup, parts``: every text as an array of (kind, value), kinds heading, list_item, code, formula and text.

    Formulas are given in LaTeX without delimiters and also inside the text they stand in; code as it reads. Null and empty texts
    give no row; a row delivered again gives one; texts are processed whole; extra columns are ignored.
    """
    src = df.select(F.col(id_col).cast("long").alias("record_id"), F.col(text_col).alias("t")).where("record_id is not null and t is not null and t <> ''")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                got = [read(t) for t in b.column(1).to_pylist()]
                parts = pa.array([[{"kind": k, "value": v} for k, v in p] for _, p in got], kind)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h for h, _ in got]), parts], names=["record_id", "has_markup", "parts"])

    return src.mapInArrow(run, "record_id long, has_markup boolean, parts array<struct<kind: string, value: string>>").dropDuplicates(["record_id"])


def markup_pieces(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``record_id, piece, val``: a row ``markup`` for every text with markup, and its pieces without white space; distinct rows."""
    src = df.select(F.col(id_col).cast("long").alias("record_id"), F.col(text_col).alias("t")).where("record_id is not null and t is not null and t <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not _MAYBE.search(t):
                    continue
                has, parts = read(t)
                if has:
                    rows.append((i, "markup", ""))
                    rows += [(i, k, _BLANK.sub("", v)) for k, v in parts if k != "text"]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), ty) for c, ty in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))], names=["record_id", "piece", "val"])

    return src.mapInArrow(run, "record_id long, piece string, val string").distinct()


def p5_found(spark, sf_dir: str) -> DataFrame:
    """Markup and its pieces in all law texts and attachments."""
    v = markup_pieces(spark.read.parquet(f"{sf_dir}/law_versions.parquet"), "version_id", "raw_text").withColumn("tbl", F.lit("law_versions"))
    pages = spark.read.parquet(f"{sf_dir}/fetched_pages.parquet").where("status_code = 200 and not (content_type like 'text/html%' or content_type = 'text/plain')")
    p = markup_pieces(pages, "page_id", "text").withColumn("tbl", F.lit("fetched_pages"))
    return v.unionByName(p).select("tbl", "record_id", "piece", "val")
