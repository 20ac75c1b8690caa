"""Problem 4: the main body of web pages among menus, notices, sidebars and footers.

Method: a linear-chain conditional random field over the page's leaf blocks (text between block tags; lines in plain text), with
features of the ancestor tags and of the text, decoded by Viterbi. Labels: title, date and authority lines, body, site. The weights
in ``models/boilerplate.json`` were trained with ``fit`` on pages labelled by the stored texts of the laws they show (at most
``PAGES`` pages, the first by hash of their id).

Scale: pages never move; one map with the weights (a few KB) beside it.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages that the fit takes at most.
PAGES = 2_000
#: Pages read and labelled together.
BATCH = 1_000
LABELS = ("site", "title", "meta", "body")
MODEL = Path(__file__).with_name("models") / "boilerplate.json"

# Tags that end a block, and tags without text.
_BLOCK = frozenset("address article aside blockquote body br caption center dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# A tag that opens ends an open one of the second kind, up to a tag of the third.
_CLOSES = {"p": ("p", ()), "li": ("li", ("ul", "ol")), "td": ("td", ("table",)), "th": ("td", ("table",)), "tr": ("tr", ("table",)), "dd": ("dd", ("dl",)), "dt": ("dt", ("dl",))}


#: A comment, an element whose text is none of the page's, a declaration, or a tag (slash, name).
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-z][^\s/>]*)(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>", re.S | re.I)


def _html_blocks(text: str) -> list[tuple[str, tuple[str, ...]]]:
    out: list[tuple[str, tuple[str, ...]]] = []
    stack: list[str] = []
    held: list[str] = []
    path: tuple[str, ...] = ()

    def end() -> None:
        nonlocal path
        if path:
            out.extend((line.strip(), path) for line in "".join(held).split("\n") if line.strip())
        held.clear()
        path = ()

    def data(s: str) -> None:
        nonlocal path
        if not s or "head" in stack:
            return
        if not path and not s.isspace():
            path = _path(tuple(stack))
        held.append(html.unescape(s) if "&" in s else s)

    at = 0
    for m in _TOKEN.finditer(text):
        data(text[at : m.start()])
        at = m.end()
        if not m[3]:
            continue
        tag = m[3].lower()
        if tag in _BLOCK:
            end()
        if m[2]:
            if tag in stack:
                del stack[len(stack) - 1 - stack[::-1].index(tag) :]
            continue
        if tag in _VOID:
            continue
        if tag == "body":
            stack = [t for t in stack if t != "head"]
        elif tag in _CLOSES:
            kind, stop = _CLOSES[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] in stop:
                    break
                if stack[i] == kind:
                    del stack[i:]
                    break
        stack.append(tag)
    data(text[at:])
    end()
    return out


@lru_cache(maxsize=4096)
def _path(stack: tuple[str, ...]) -> tuple[str, ...]:
    return (*(f"tag={t}" for t in sorted(set(stack))), f"leaf={stack[-1] if stack else ''}")


def blocks(text: str, is_html: bool) -> list[tuple[str, tuple[str, ...]]]:
    """(text, ancestor features) of the page's leaf blocks, in order, without empty ones."""
    if not is_html:
        return [(s.strip(), ("plain",)) for s in re.split(r"[\r\n]+", text) if s.strip()]
    return _html_blocks(text)


_NUM = "[0-9０-９一二三四五六七八九十百零〇]+"
#: How a block begins: as a rule's title, date, authority or part does, as the count of printed pages, or with a list's dot.
_START = re.compile(
    f"(?P<name>法規名稱[:：])|(?P<date>(?:發布|公布|公發布|修正|訂定|發文)日期[:：]|(?:中華民國|民國)\\d+年)|(?P<office>(?:主管機關|發布機關|主管單位|主辦機關)[:：])"
    f"|(?P<article>第 *{_NUM}(?:[-－之] *{_NUM})? *條(?:之{_NUM})?)|(?P<chapter>第 *{_NUM} *[編章節款](?! *[之項]))|(?P<page>第? *\\d+ */ *\\d+ *頁?)|(?P<point>{_NUM}、)|(?P<sub>[（(]{_NUM}[）)])|(?P<dot>[·•‧*])"
)
_FLAGS = ("name", "date", "office", "article", "chapter", "page", "point", "sub", "dot", "stop", "colon", "bracket", "deleted", "comma", "kind", "bar", "ascii", "must", "open", "clock", "blank")
_BIT = {f: 1 << i for i, f in enumerate(_FLAGS)}
_END = {"。": _BIT["stop"], "；": _BIT["stop"], "：": _BIT["colon"], "）": _BIT["bracket"], ")": _BIT["bracket"]}
_KINDS = ("辦法", "準則", "要點", "規則", "規範", "須知", "程序", "原則", "基準", "條例", "法", "細則", "標準", "規程", "綱要")
_OPEN = ("準用", "並依", "附表", "附件", "依第", "第", "，", "、", "及")
_BARS, _MUST = frozenset("|｜>›»／©"), frozenset("應得者指之")
_CLOCK = re.compile(r"\d[:/x]\d")
#: Lengths at which the size of a block that is no sentence changes.
_SIZES = (6, 13, 22, 45)


def tests(s: str) -> int:
    """What is told by a block's text alone, a bit for each of ``_FLAGS``."""
    m = _START.match(s)
    f = (_BIT[m.lastgroup] if m else 0) | _END.get(s[-1], 0)
    if "，" in s:
        f |= _BIT["comma"]
    if s.endswith(("（刪除）", "(刪除)")):
        f |= _BIT["deleted"]
    if s.endswith(_KINDS):
        f |= _BIT["kind"]
    if s.endswith(_OPEN):
        f |= _BIT["open"]
    if not _MUST.isdisjoint(s):
        f |= _BIT["must"]
    if not f & _BIT["stop"] and not _BARS.isdisjoint(s):
        f |= _BIT["bar"]
    if s.isascii():
        f |= _BIT["ascii"]
    if "\u3000" in s:
        f |= _BIT["blank"]
    if _CLOCK.search(s):
        f |= _BIT["clock"]
    return f


def _has(f, *names: str):
    """Whether any of the flags is set; of a number or an array of them."""
    return f & sum(_BIT[n] for n in names) != 0


#: Features of a block with its neighbours: (name, own flags, flags before, flags after, short, again) to whether it holds.
_TOGETHER = (
    ("stop&must", lambda o, b, a, n, g: _has(o, "stop") & _has(o, "must")),
    ("stop&latin", lambda o, b, a, n, g: _has(o, "stop") & _has(o, "blank")),
    ("stop after stop", lambda o, b, a, n, g: _has(o, "stop") & _has(b, "stop")),
    ("open&comma", lambda o, b, a, n, g: _has(o, "open") & _has(o, "comma")),
    ("kind&+date", lambda o, b, a, n, g: _has(o, "kind", "name") & _has(a, "date")),
    ("+date&short", lambda o, b, a, n, g: _has(a, "date") & (n < 45)),
    ("bare", lambda o, b, a, n, g: ~_has(o, "stop", "colon", "bracket", "comma", "article", "point", "sub", "chapter", "name", "date", "office", "deleted")),
    ("after open", lambda o, b, a, n, g: _has(b, "open") & ~_has(b, "stop")),
    ("item&end", lambda o, b, a, n, g: _has(o, "article", "point", "sub") & _has(o, "stop", "colon", "deleted")),
    ("short&bare end", lambda o, b, a, n, g: (n < 13) & ~_has(o, "stop", "colon", "bracket")),
    ("again", lambda o, b, a, n, g: g),
)


def features(page: list[tuple[str, tuple[str, ...]]]) -> list[list[str]]:
    """The names of every block's features, as the fit takes them: of its ancestors, its text, both neighbours, and some together."""
    flags = [tests(s) for s, _ in page]
    often = Counter(s for s, _ in page)
    names = lambda f: [x for x, bit in _BIT.items() if f & bit]
    out = []
    for i, (s, up) in enumerate(page):
        b, a = flags[i - 1] if i else 0, flags[i + 1] if i + 1 < len(page) else 0
        f = ["1", *up, *names(flags[i]), f"size={len(_SIZES) + 1 if _has(flags[i], 'stop') else bisect(_SIZES, len(s))}", f"^{s[:2]}", f"{s[-2:]}$"]
        f += [f"-1:{x}" for x in names(b)] + [f"+1:{x}" for x in names(a)] + ["first"] * (i == 0) + ["last"] * (i + 1 == len(page))
        args = [np.array([x]) for x in (flags[i], b, a, len(s), often[s] > 1)]
        out.append(f + [name for name, holds in _TOGETHER if holds(*args)[0]])
    return out


class Crf:
    """Linear-chain CRF with emission weights by feature and label, and transitions with a start and an end."""

    def __init__(self, names: list[str], w: np.ndarray, t: np.ndarray):
        self.index = {n: i for i, n in enumerate(names)}
        self.w, self.t = w, t  # (features, labels); (labels + 1, labels + 1): the last row is the start, the last column the end

    @classmethod
    def load(cls, path: Path = MODEL) -> Crf:
        m = json.loads(path.read_text())
        return cls(list(m["weights"]), np.array(list(m["weights"].values())), np.array(m["transitions"]))

    def save(self, path: Path = MODEL) -> None:
        rows = [json.dumps(n) + ": " + json.dumps([round(float(x), 3) for x in self.w[i]]) for n, i in self.index.items()]
        path.write_text('{"weights": {\n' + ",\n".join(rows) + '},\n"transitions": ' + json.dumps(np.round(self.t, 3).tolist()) + "}\n")

    def scores(self, feats: list[list[str]]) -> np.ndarray:
        k = len(LABELS)
        return np.array([self.w[[self.index[f] for f in fs if f in self.index]].sum(axis=0) if fs else np.zeros(k) for fs in feats])

    def decode(self, feats: list[list[str]]) -> list[int]:
        """The best labels of one page, by Viterbi."""
        return _viterbi(self.scores(feats), self.t, [len(feats)])[0].tolist() if feats else []

    def _rows(self, names: list[str]) -> np.ndarray:
        """The weights of features by name; zeros for those without."""
        return np.array([self.w[self.index[n]] if n in self.index else np.zeros(len(LABELS)) for n in names])

    def emissions(self, pages: list[list[tuple[str, tuple[str, ...]]]]) -> np.ndarray:
        """The scores of all blocks of all pages, as of ``scores(features(page))`` one after the other.

        What depends on a text alone is read once for each text; the rest is sums of whole columns.
        """
        known: dict[str, int] = {}
        paths: dict[tuple[str, ...], int] = {}
        text = np.array([known.setdefault(s, len(known)) for p in pages for s, _ in p], np.int64)
        path = np.array([paths.setdefault(u, len(paths)) for p in pages for _, u in p], np.int64)
        size = np.array([len(p) for p in pages])
        page = np.repeat(np.arange(len(pages)), size)
        first = np.r_[True, page[1:] != page[:-1]]
        last = np.r_[first[1:], True]
        flags = np.fromiter((tests(s) for s in known), np.int64, len(known))
        length = np.fromiter(map(len, known), np.int64, len(known))
        bits = (flags[:, None] >> np.arange(len(_FLAGS)) & 1).astype(float)
        zero = np.zeros((1, len(LABELS)))
        ends = {n: i for i, n in enumerate(n for n in self.index if n[0] == "^" or n[-1] == "$")}
        rows = np.vstack([self._rows(list(ends)), zero])
        none = len(ends)
        begin = np.fromiter((ends.get("^" + s[:2], none) for s in known), np.int64, len(known))
        close = np.fromiter((ends.get(s[-2:] + "$", none) for s in known), np.int64, len(known))
        own = bits @ self._rows(list(_FLAGS)) + self._rows([f"size={i}" for i in range(len(_SIZES) + 2)])[np.where(_has(flags, "stop"), len(_SIZES) + 1, np.searchsorted(_SIZES, length, "right"))] + rows[begin] + rows[close]
        e = own[text] + np.array([self._rows(["1", *u]).sum(axis=0) for u in paths])[path]
        before, after = np.vstack([bits @ self._rows([f"-1:{f}" for f in _FLAGS]), zero]), np.vstack([bits @ self._rows([f"+1:{f}" for f in _FLAGS]), zero])
        prev, nxt = np.where(first, len(known), np.r_[0, text[:-1]]), np.where(last, len(known), np.r_[text[1:], 0])
        e += before[prev] + after[nxt] + first[:, None] * self._rows(["first"]) + last[:, None] * self._rows(["last"])
        _, at, many = np.unique(page * len(known) + text, return_inverse=True, return_counts=True)
        f = np.r_[flags, 0]
        for name, holds in _TOGETHER:
            e += holds(f[text], f[prev], f[nxt], length[text], many[at] > 1)[:, None] * self._rows([name])
        return e

    def label(self, pages: list[list[tuple[str, tuple[str, ...]]]]) -> list[np.ndarray]:
        """The best labels of the blocks of many pages at once."""
        size = [len(p) for p in pages]
        return _viterbi(self.emissions(pages), self.t, size) if sum(size) else [np.empty(0, int) for _ in pages]


def _viterbi(e: np.ndarray, t: np.ndarray, size: list[int]) -> list[np.ndarray]:
    """The best paths through the scores of chains that lie one after the other, all chains a step at a time, the longest first."""
    k = e.shape[1]
    size = np.array(size)
    start = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    out = [np.empty(n, int) for n in size]
    score = t[k, :k] + e[start[order]]
    back = []
    live = len(order)
    for j in range(1, size[order[0]] if live else 0):
        while live and size[order[live - 1]] <= j:
            live -= 1
        step = score[:live, :, None] + t[:k, :k]
        back.append(step.argmax(axis=1))
        score[:live] = step.max(axis=1) + e[start[order[:live]] + j]
    y = (score + t[:k, k]).argmax(axis=1)
    labels = np.zeros((len(order), len(back) + 1), np.int8)
    labels[np.arange(len(order)), size[order] - 1] = y
    for j in range(len(back), 0, -1):
        n = len(back[j - 1])
        labels[:n, j - 1] = np.where(size[order[:n]] - 1 >= j, back[j - 1][np.arange(n), labels[:n, j]], labels[:n, j - 1])
    for i, n in enumerate(order):
        out[n] = labels[i, : size[n]].astype(int)
    return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 300, rate: float = 0.15, l2: float = 0.002, least: int = 4) -> Crf:
    """Maximum likelihood by Adam over all pages at once; features seen ``least`` times at least get weights."""
    pages = [p for p in pages if p[0]]
    count = Counter(f for fs, _ in pages for b in fs for f in set(b))
    names = sorted(f for f, c in count.items() if c >= least)
    index = {n: i for i, n in enumerate(names)}
    k, n, longest = len(LABELS), len(pages), max(len(y) for _, y in pages)
    pos, feat, gold = [], [], np.full((n, longest), -1)
    mask = np.zeros((n, longest), bool)
    for i, (fs, y) in enumerate(pages):
        gold[i, : len(y)], mask[i, : len(y)] = y, True
        for j, b in enumerate(fs):
            for f in set(b):
                if f in index:
                    pos.append(i * longest + j)
                    feat.append(index[f])
    pos, feat = np.array(pos), np.array(feat)  # in the order of pos
    head = np.flatnonzero(np.r_[True, pos[1:] != pos[:-1]])
    by_feat = np.argsort(feat, kind="stable")
    head_f = np.flatnonzero(np.r_[True, np.diff(feat[by_feat]) > 0])
    w, t = np.zeros((len(names), k)), np.zeros((k + 1, k + 1))
    last = mask.sum(axis=1) - 1
    at = np.arange(n)
    gold_w, gold_t = np.zeros_like(w), np.zeros_like(t)
    one = np.zeros((n * longest, k))
    ok = mask.ravel()
    one[np.flatnonzero(ok), gold.ravel()[ok]] = 1
    np.add.at(gold_w, feat, one[pos])
    np.add.at(gold_t, (np.full(n, k), gold[:, 0]), 1)
    np.add.at(gold_t, (gold[at, last], np.full(n, k)), 1)
    for j in range(1, longest):
        m = mask[:, j]
        np.add.at(gold_t, (gold[m, j - 1], gold[m, j]), 1)
    mw, vw, mt, vt = (np.zeros_like(x) for x in (w, w, t, t))
    for r in range(1, rounds + 1):
        e = np.zeros((n * longest, k))
        e[pos[head]] = np.add.reduceat(w[feat], head)
        e = e.reshape(n, longest, k)
        a = np.zeros_like(e)
        a[:, 0] = t[k, :k] + e[:, 0]
        for j in range(1, longest):
            step = _lse(a[:, j - 1, :, None] + t[:k, :k], 1) + e[:, j]
            a[:, j] = np.where(mask[:, j, None], step, a[:, j - 1])
        z = _lse(a[:, -1] + t[:k, k], 1)
        b = np.zeros_like(e)
        b[:, -1] = t[:k, k]
        exp_t = np.zeros_like(t)
        for j in range(longest - 2, -1, -1):
            nxt = e[:, j + 1] + b[:, j + 1]
            b[:, j] = np.where(mask[:, j + 1, None], _lse(t[:k, :k] + nxt[:, None, :], 2), t[:k, k])
            m = mask[:, j + 1]
            pair = np.exp(a[m, j, :, None] + t[:k, :k] + nxt[m][:, None, :] - z[m, None, None])
            exp_t[:k, :k] += pair.sum(axis=0)
        marg = np.exp(a + b - z[:, None, None]) * mask[:, :, None]
        exp_t[k, :k] += marg[:, 0].sum(axis=0)
        exp_t[:k, k] += marg[at, last].sum(axis=0)
        exp_w = np.zeros_like(w)
        exp_w[feat[by_feat][head_f]] = np.add.reduceat(marg.reshape(-1, k)[pos[by_feat]], head_f)
        for x, g, m1, v1 in ((w, (exp_w - gold_w) / n + l2 * w / 10, mw, vw), (t, (exp_t - gold_t) / n + l2 * t / 10, mt, vt)):
            m1 *= 0.9
            m1 += 0.1 * g
            v1 *= 0.99
            v1 += 0.01 * g * g
            x -= rate * (m1 / (1 - 0.9**r)) / (np.sqrt(v1 / (1 - 0.99**r)) + 1e-8)
    return Crf(names, w, t)


_BLANK = re.compile(r"[\s 　]+")


def squeeze(s: str) -> str:
    return _BLANK.sub("", s)


# A site's notice that ends like a sentence; it only keeps such pages among the labelled ones.
_NOTICE = re.compile("cookie|瀏覽體驗|瀏覽資訊", re.I)


def label_page(page: list[tuple[str, tuple[str, ...]]], stored: list[str], also: set[str] = frozenset()) -> tuple[list[int] | None, set[str]]:
    """Labels from the law's stored texts (without white space), and the sentences that stand among the body without being stored.

    Body is what stands in one of the stored texts, or among such blocks and ends like a sentence, or (``also``) is known to stand
    there on other pages, or follows the last of them as a whole sentence that is no notice. None where no stored text holds most of
    the page's law, or its end isn't sure.
    """
    date = next((i for i, (s, _) in enumerate(page) if _has(tests(s), "date")), None)
    if not date:
        return None, set()
    plain, often = [squeeze(s) for s, _ in page], Counter(s for s, _ in page)
    joined = "\n".join(stored)
    inside = [i for i in range(date + 1, len(page)) if len(plain[i]) > 3 and plain[i] in joined and not _has(tests(page[i][0]), "office")]
    if len(inside) < 2:
        return None, set()
    end, among = inside[-1], set()
    y = [0] * len(page)
    for i in range(date + 1, end + 1):
        if plain[i] in joined:
            y[i] = 3
        elif re.search("[。：；）]$|，.*[^。]$", page[i][0]) and often[page[i][0]] == 1 and not (i < end and _has(tests(page[i + 1][0]), "page")):
            y[i] = 3
            among.add(page[i][0])
    if sum(k == 3 for k in y) < 0.7 * (end - date - 1):
        return None, set()
    while end + 1 < len(page) and (page[end + 1][0] in also or page[end + 1][0][-1] == "。" and not _NOTICE.search(page[end + 1][0])):
        end += 1
        y[end] = 3
    if end + 1 < len(page) and page[end + 1][0][-1] == "：":
        return None, among
    y[date - 1], y[date] = 1, 2
    for i in range(date + 1, min(date + 3, len(page))):
        if _has(tests(page[i][0]), "office"):
            y[i] = 2
    return y, among


def bodies(texts: list[tuple[str, bool]], model: Crf) -> list[str | None]:
    """The law's text of each page (text, whether HTML), one block a line; None where there is no law."""
    pages = [blocks(t, h) for t, h in texts]
    out: list[str | None] = []
    for page, y in zip(pages, model.label(pages)):
        found = set(y.tolist())
        out.append("\n".join(s for (s, _), k in zip(page, y) if k) if 3 in found and found & {1, 2} else None)
    return out


def body(text: str, is_html: bool, model: Crf) -> str | None:
    """The law's text of one page."""
    return bodies([(text, is_html)], model)[0]


def main_bodies(pages: DataFrame, id_col: str = "page_id", text_col: str = "text", type_col: str = "content_type", model: Crf | None = None) -> DataFrame:
    """``page_id, body``: the main body of every page that has one, as clean text.

    HTML is what has the content type ``text/html…``; all else is taken as plain text. Null and empty texts, and pages without a
    main body, give no row; a page delivered again gives one; texts are processed whole; extra columns are ignored.
    """
    model = model or Crf.load()
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(text_col).alias("t"), F.coalesce(F.col(type_col), F.lit("")).alias("c")).where("page_id is not null and t is not null and t <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                texts = [(t, c.lower().startswith("text/html")) for t, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
                got = [(i, x) for i, x in zip(b.column(0).to_pylist(), bodies(texts, model)) if x is not None]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string())], names=["page_id", "body"])

    return src.mapInArrow(run, "page_id long, body string").dropDuplicates(["page_id"])


def p4_found(spark, sf_dir: str) -> DataFrame:
    """The hash of the law's text without white space, for all pages with status 200 in HTML or plain text."""
    pages = spark.read.parquet(f"{sf_dir}/fetched_pages.parquet").where("status_code = 200 and (content_type like 'text/html%' or content_type = 'text/plain')")
    return main_bodies(pages).select("page_id", F.sha2(F.regexp_replace("body", r"[\s 　\p{Zs}\u000B\u001C-\u001F\u0085  ]+", ""), 256).alias("body_hash"))


def training_pages(spark, sf_dir: str, pages: int = PAGES) -> list[tuple[list[tuple[str, tuple[str, ...]]], list[int]]]:
    """At most ``pages`` pages, as blocks, with labels: the first by hash of the page id that one of their law's stored texts fits."""
    src = spark.read.parquet(f"{sf_dir}/fetched_pages.parquet").where("status_code = 200 and text is not null and (content_type like 'text/html%' or content_type = 'text/plain')")
    src = src.dropDuplicates(["page_id"]).withColumn("key", F.lower(F.regexp_extract("url", "(?i)lsid=([A-Z]{2}[0-9]+)", 1))).orderBy(F.xxhash64("page_id")).limit(pages)
    laws = spark.read.parquet(f"{sf_dir}/laws.parquet").select("law_id", F.lower(F.regexp_extract("source_key", "([A-Za-z]{2}[0-9]+)$", 1)).alias("key")).distinct()
    texts = spark.read.parquet(f"{sf_dir}/law_versions.parquet").join(laws, "law_id").join(src.select("key"), "key", "left_semi").select("key", "raw_text").distinct()
    stored: dict[str, list[str]] = {}
    for r in texts.toLocalIterator():
        stored.setdefault(r.key, []).append(squeeze(r.raw_text))
    read = [(blocks(r.text, r.content_type.lower().startswith("text/html")), stored.get(r.key, [])) for r in src.toLocalIterator()]
    first = Counter(x for page, texts in read for x in label_page(page, texts)[1])
    also = {x for x, n in first.items() if n > 1}
    labelled = [(page, label_page(page, texts, also)[0]) for page, texts in read]
    return [(page, y) for page, y in labelled if y]


def layout(page: list[tuple[str, tuple[str, ...]]], y: list[int]) -> tuple[str, ...]:
    """How a labelled page is laid out: the ancestors of its law's first block."""
    return page[next(i for i, k in enumerate(y) if k)][1]


def left_out(labelled: list[tuple[list[tuple[str, tuple[str, ...]]], list[int]]], folds: int = 4) -> list[tuple[int, int, float, float]]:
    """Layouts in ``folds`` parts, each judged by a model fitted on the layouts of the others only.

    For each part: its layouts and pages, and the shares of blocks and of whole pages labelled right.
    """
    kinds = {k: i % folds for i, k in enumerate(sorted({layout(*x) for x in labelled}))}
    out = []
    for fold in range(folds):
        test = [x for x in labelled if kinds[layout(*x)] == fold]
        model = fit([(features(p), y) for p, y in labelled if kinds[layout(p, y)] != fold])
        right = [(np.array(y) == g).tolist() for (_, y), g in zip(test, model.label([p for p, _ in test]))]
        out.append((sum(f == fold for f in kinds.values()), len(test), sum(map(sum, right)) / max(1, sum(map(len, right))), sum(map(all, right)) / max(1, len(right))))
    return out


if __name__ == "__main__":  # fits the model again: python -m lexspark.llm.boilerplate DATA_DIR
    import sys

    from pyspark.sql import SparkSession

    labelled = training_pages(SparkSession.builder.getOrCreate(), sys.argv[1])
    print(len(labelled), "labelled pages")
    fit([(features(p), y) for p, y in labelled]).save()
    for kinds, pages, block_share, page_share in left_out(labelled):
        print(f"{kinds} layouts left out: {pages} pages, {block_share:.4f} of blocks, {page_share:.4f} of pages right")
