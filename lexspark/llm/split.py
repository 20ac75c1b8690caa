"""Problem 1: splitting oversized texts at natural boundaries.

Method: structure-tree packing. The marks at the starts of lines make a tree (chapter, article, first-level point, point of an inner
list, sub-point; below them lines and sentences). A node that fits the limit is one piece; only one that doesn't is descended into:
its parts are packed first, and pieces beside each other are merged bottom-up as long as they fit. Pieces after the first carry the
last ``overlap`` characters of the one before. The beginnings of parts come with the pieces, from the same tree.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1_800, 180

# White space and characters that are not seen, numerals and their other forms, as the texts have them.
_BLANK = r"\s 　﻿"
_UNSEEN = r"­​-‏⁠-⁤︀-️﻿\U000e0100-\U000e01ef"
_CN = "〇零一二三四五六七八九十百千⼀⼆⼋⼗" + "六⼆⼗兩零"
_DIGIT = "0-9０-９"
_GAP = f"[{_BLANK}{_UNSEEN}]*"


def _spaced(*parts: str) -> str:
    return _GAP.join(parts)


_NUM = f"(?:[{_DIGIT}](?:{_GAP}[{_DIGIT}])*|[{_CN}](?:{_GAP}[{_CN}])*)"
_DASH = "[-－‐‑–−]"
ARTICLE = re.compile(_spaced("", "第", _NUM, f"(?:{_DASH}{_GAP}{_NUM}{_GAP})?條(?:{_GAP}之{_GAP}{_NUM}(?![{_CN}{_DIGIT}]))?"))
POINT = re.compile(_spaced("", f"(?:[{_CN}](?:{_GAP}[{_CN}])*)", "[、､]"))
SUBPOINT = re.compile(_spaced("", "[（(]", f"(?:[{_CN}](?:{_GAP}[{_CN}])*)", "[）)]"))
CHAPTER = re.compile(_spaced("", "第", f"(?:{_NUM})", "[編章節款](?!之)"))
#: What follows an article's number where the article is only referred to.
REFERRED = re.compile(f"^[{_UNSEEN}]*(?:第{_GAP}{_NUM}{_GAP}[項款目條]|[及或與至、､，,]{_GAP}第|之規定|規定|所定|所稱|所列|準用|但書|各款|前段|後段)")
POINT_REFERRED = re.compile(f"^{_GAP}(?:[{_CN}](?:{_GAP}[{_CN}])*{_GAP})(?:所列|所定|所稱|之規定|點|款|項|目|規定|及|或|至|、)")
#: A line that ends so goes on in the next one.
_OPEN_END = re.compile(f"(?:準用|適用|依|依附表|附表|附件|依第|第|及|或|與|至|、|，|,)[{_BLANK}{_UNSEEN}]*$")
_SENTENCE = re.compile(r"(?<=[。！？；!?;])")

_VALUE = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "⼀": 1, "⼆": 2, "⼋": 8, "六": 6, "兩": 2, "零": 0}


def number(text: str) -> int:
    """The value of a numeral in digits or ideographs, placed (一〇五) or named (一百零五)."""
    t = re.sub(f"[{_BLANK}{_UNSEEN}]", "", text)
    if re.fullmatch(f"[{_DIGIT}]+", t):
        return int(t)
    t = t.replace("⼗", "十")
    if not re.search("[十百千]", t):
        return int("".join(str(_VALUE[c]) for c in t)) if t else 0
    total = digit = 0
    for c in t:
        unit = {"十": 10, "百": 100, "千": 1000}.get(c)
        if unit:
            total, digit = total + (digit or 1) * unit, 0
        else:
            digit = _VALUE[c]
    return total + digit


def _lines(text: str) -> list[tuple[int, int]]:
    """(start, end) of each line, without its line break."""
    out, at = [], 0
    for m in re.finditer(r"\r\n|\n|\r| | ", text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return out


def marks(text: str) -> list[tuple[int, int, str]]:
    """(position, level, label) of every line that begins a part: 0 chapter, 1 article, 2 first-level point, 3 second-level point.

    The label is as written, without white space and unseen characters at its sides. A number that is only referred to begins
    nothing, also at the start of a line: the line before breaks off, or what follows refers (第 12 條第四項所定 …).
    """
    out = []
    before = ""
    for s, e in _lines(text):
        line = text[s:e]
        if not line.strip():
            continue
        broken = bool(_OPEN_END.search(before))
        if not broken:
            if m := ARTICLE.match(line):
                if not REFERRED.match(line[m.end() :]):
                    out.append((s, 1, m.group()))
            elif m := CHAPTER.match(line):
                out.append((s, 0, m.group()))
            elif m := POINT.match(line):
                if not POINT_REFERRED.match(line[m.end() :]):
                    out.append((s, 2, m.group()))
            elif m := SUBPOINT.match(line):
                out.append((s, 3, m.group()))
        before = line
    return [(s + len(label) - len(label.lstrip()), level, label) for s, level, label in out]


#: Levels of the tree: the text, then what its marks begin, then lines and sentences.
TEXT, CHAPTER_, ARTICLE_, POINT_, INNER, SUB, LINE, SENTENCE = range(-1, 7)


class Node:
    """A part of a text: where it begins and ends, its level, its label as written, and the parts in it."""

    __slots__ = ("end", "kids", "label", "level", "start")

    def __init__(self, start: int, end: int, level: int, label: str = ""):
        self.start, self.end, self.level, self.label = start, end, level, label
        self.kids: list[Node] = []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.kids))


def _outer(labels: list[str]) -> list[bool]:
    """Which of the points 一、 … in a row belong to the outer list: those that go on with its numbers.

    A list inside a point starts again at 1 and runs as long as its own numbers do; what follows it is looked at for the outer
    list's next number.
    """
    nums = [number(re.sub("[、､]", "", x)) for x in labels]
    out, want, i = [False] * len(nums), 1, 0
    while i < len(nums):
        if nums[i] == want:
            out[i] = True
            want += 1
            if i + 1 < len(nums) and nums[i + 1] == 1:  # an inner list begins right here
                k = 1
                while i + k < len(nums) and nums[i + k] == k:
                    k += 1
                i += k
                continue
        i += 1
    return out


def parse(text: str, is_content: bool = False) -> Node:
    """The text's structure: chapters, articles, points, points of inner lists, sub-points, one in the other.

    What stands before the first part of a node is a part without a label. A chunk's content may begin with its own label, which is
    the root's then.
    """
    root = Node(0, len(text), TEXT)
    found = marks(text)
    if is_content and found and found[0][1] == 2 and found[0][0] == len(text) - len(text.lstrip()):
        root.label = found.pop(0)[2]
    level = {0: CHAPTER_, 1: ARTICLE_, 2: POINT_, 3: SUB}
    todo = [(at, level[lv], label) for at, lv, label in found]
    lo = 0
    while lo < len(todo):  # the points of each article, or of the text before the first, are lists of their own
        hi = lo + 1
        while hi < len(todo) and todo[hi][1] > ARTICLE_:
            hi += 1
        points = [i for i in range(lo, hi) if todo[i][1] == POINT_]
        for i, outer in zip(points, _outer([todo[i][2] for i in points])):
            if not outer:
                todo[i] = (todo[i][0], INNER, todo[i][2])
        lo = hi
    open_ = [root]
    for at, lv, label in todo:
        while open_[-1].level >= lv:
            open_.pop().end = at
        node = Node(at, len(text), lv, label)
        if not open_[-1].kids and at > open_[-1].start:
            open_[-1].kids.append(Node(open_[-1].start, at, LINE - 1))
        open_[-1].kids.append(node)
        open_.append(node)
    for n in root.walk():  # a node ends where the next one beside it begins
        for x, y in zip(n.kids, n.kids[1:]):
            x.end = y.start
        if n.kids:
            n.kids[-1].end = n.end
    return root


def parts(root: Node) -> list[tuple[int, str]]:
    """Where the parts of a text begin, and their labels without white space: articles, or first-level points where there are none."""
    for level in (ARTICLE_, POINT_):
        found = [n for n in root.walk() if n.level == level]
        if found:
            return [(n.start, re.sub(r"[\s\u00a0\u3000]", "", n.label)) for n in found]
    return []


def content_parts(root: Node) -> list[tuple[int, str]]:
    """Where the first-level points of a chunk's content begin, its own label apart."""
    return [(n.start, re.sub(r"[\s\u00a0\u3000]", "", n.label)) for n in root.walk() if n.level == POINT_]


def beginnings(text: str, is_content: bool) -> list[tuple[int, str]]:
    """The parts of a text by its tree."""
    root = parse(text, is_content)
    return content_parts(root) if is_content else parts(root)


def _below(node: Node, text: str) -> list[Node]:
    """The parts of a node without marked ones: its lines, a line's sentences; none for a single sentence."""
    if node.level < LINE:
        cut = [s for s, _ in _lines(text[node.start : node.end])]
        level = LINE
    elif node.level == LINE:
        cut = [0, *(x.end() for x in _SENTENCE.finditer(text, node.start, node.end))]
        cut = [0] + [c - node.start for c in cut[1:] if node.start < c < node.end]
        level = SENTENCE
    else:
        return []
    at = [node.start + c for c in cut if c < node.end - node.start]
    return [Node(x, y, level) for x, y in zip(at, [*at[1:], node.end])]


def _hard(text: str, lo: int, hi: int, room: int) -> list[tuple[int, int]]:
    """Pieces of a part without boundaries, none through a letter and its marks unless these alone are too long."""
    out, begin, last = [], lo, lo
    for m in regex.finditer(r"\X", text, pos=lo, endpos=hi):
        if m.end() - begin > room and last > begin:
            out.append((begin, last))
            begin = last
        last = m.end()
        while last - begin > room:
            out.append((begin, begin + room))
            begin += room
    return [*out, (begin, hi)] if begin < hi else out


def pack(node: Node, text: str, room: int) -> list[tuple[int, int]]:
    """The pieces of a node, each at most ``room`` long: a node that fits is one; of one that doesn't, its parts are packed first and
    those beside each other merged as long as they fit."""
    if node.end - node.start <= room:
        return [(node.start, node.end)]
    kids, level = node.kids, node
    while not kids or len(kids) == 1:  # a node with a single part, or a part as long as itself, goes on as that part
        if kids:
            level, kids = kids[0], kids[0].kids
            continue
        kids = _below(level, text)
        if not kids:
            return _hard(text, node.start, node.end, room)
    out: list[tuple[int, int]] = []
    for kid in kids:
        for a, b in pack(kid, text, room):
            if out and b - out[-1][0] <= room:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP, root: Node | None = None) -> list[tuple[int, int]]:
    """(start, end) of the pieces: at most ``limit`` long, together the whole text, each beginning ``overlap`` before the last one's end.

    A text within the limit is one piece. A piece's own part begins at a natural boundary where the limit leaves one.
    """
    if len(text) <= limit:
        return [(0, len(text))]
    own = pack(root or parse(text), text, limit - overlap)
    return [(max(0, a - overlap) if a else 0, b) for a, b in own]


def _map(fn, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in fn(i, t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def split_texts(df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP, is_content: bool = False, texts: bool = True) -> DataFrame:
    """``item_id, piece_no, begins_at, own_from, piece, parts``: the pieces of every text longer than the limit.

    Consecutive pieces share exactly ``overlap`` characters; joined without them they give the text back. ``parts`` are the places
    (``at, label``) in the piece's own characters where articles, or where there are none first-level points, begin (of a chunk's
    ``is_content``: first-level points, not its own label). ``texts=False`` leaves out the pieces' texts. Null texts and texts within
    the limit give no rows; an id delivered again with the same text is split once; extra columns are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    src = df.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("t")).where(F.length("t") > limit)

    def one(i, t):
        root = parse(t, is_content)
        begun = content_parts(root) if is_content else parts(root)
        at = [b[0] for b in begun]
        rows = []
        for n, (a, b) in enumerate(pieces(t, limit, overlap, root)):
            own = a + (overlap if n else 0)
            here = begun[bisect_left(at, own) : bisect_left(at, b)]
            rows.append((i, n, a, own, t[a:b] if texts else None, [{"at": x, "label": y} for x, y in here]))
        return rows

    part = pa.struct([("at", pa.int32()), ("label", pa.string())])
    schema = pa.schema([("item_id", pa.int64()), ("piece_no", pa.int32()), ("begins_at", pa.int32()), ("own_from", pa.int32()), ("piece", pa.string()), ("parts", pa.list_(part))])
    out = src.mapInArrow(_map(one, schema), "item_id long, piece_no int, begins_at int, own_from int, piece string, parts array<struct<at: int, label: string>>")
    return out.dropDuplicates(["item_id", "piece_no"])


def part_beginnings(df: DataFrame, id_col: str, text_col: str, is_content: bool, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``item_id, at, label``: where the parts of every text longer than the limit begin, from its pieces."""
    split = split_texts(df, id_col, text_col, limit, overlap, is_content, texts=False)
    return split.select("item_id", F.explode("parts").alias("x")).select("item_id", "x.at", "x.label")


def p1_found(spark, sf_dir: str) -> DataFrame:
    """Beginnings of parts in all law texts and chunk contents over the limit, as their pieces hold them."""
    raw = part_beginnings(spark.read.parquet(f"{sf_dir}/law_versions.parquet"), "version_id", "raw_text", False)
    con = part_beginnings(spark.read.parquet(f"{sf_dir}/law_chunks.parquet"), "chunk_id", "content", True)
    both = raw.withColumn("field_name", F.lit("raw_text")).unionByName(con.withColumn("field_name", F.lit("content")))
    return both.select("field_name", "item_id", "label")


def p1_pieces(spark, sf_dir: str) -> DataFrame:
    """The pieces of all law texts and chunk contents over the limit."""
    raw = split_texts(spark.read.parquet(f"{sf_dir}/law_versions.parquet"), "version_id", "raw_text")
    con = split_texts(spark.read.parquet(f"{sf_dir}/law_chunks.parquet"), "chunk_id", "content", is_content=True)
    return raw.withColumn("field_name", F.lit("raw_text")).unionByName(con.withColumn("field_name", F.lit("content"))).drop("parts")
