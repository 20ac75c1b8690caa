"""Problem 8: evaluation passages that occur in a corpus.

Method: Wu-Manber multi-pattern search. Any common stretch of 2b - 1 letters holds one of the passage's blocks of b letters that
begin at a multiple of b; these blocks are the patterns. A block-shift table skips the positions where no pattern can end, a hash
of the window's suffix selects the patterns it may be, and direct comparison confirms them; the comparison goes on over the whole
diagonal, which gives every stretch. The scan runs in lanes: thousands of cursors over one long array move together, each by its
own shift.

Scale: documents never move (one map over the corpus). Up to ``PASSAGES`` passages of at most ``LETTERS`` characters together travel
with the tasks. More of them are written in blocks of that size to the shared folder, and every Python worker reads the blocks from
there and keeps them; ``BLOCKS`` of them share a pass over the corpus. The shift table grows with the number of patterns.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.fold import SEP, drop_line_numbers, fold_texts
from lexspark.runtime import shared_path

#: Passages and their characters in a block; blocks a pass over the corpus; letters a lane; letters of text folded at a time.
PASSAGES, LETTERS, BLOCKS, LANE, CHUNK = 20_000, 10_000_000, 4, 512, 2_000_000


class WuManber:
    """Patterns of one length m, with shifts by blocks of B letters."""

    def __init__(self, patterns: np.ndarray, room: int = 16):
        """``room``: slots of the shift table for each of the patterns' blocks; blocks have as many letters as that needs to be rare."""
        self.m = patterns.shape[1]
        _, n = np.unique(patterns, return_counts=True)
        spread = float(np.exp(-(n / n.sum() * np.log(n / n.sum())).sum()))  # letters, if all were equally frequent
        wanted = room * len(patterns) * self.m
        self.b = min(max(3, int(np.ceil(np.log(wanted) / np.log(max(spread, 2.0))))), (self.m + 1) // 2)
        self.bits = min(max(int(np.ceil(np.log2(wanted))), 16), 27)
        rng = np.random.default_rng(5)
        self.mul = rng.integers(1, 2**31, self.b, dtype=np.uint64) * 2 + 1
        self.wide = rng.integers(1, 2**62, self.m, dtype=np.uint64) * 2 + 1
        self.shift = np.full(1 << self.bits, self.m - self.b + 1, np.uint8)
        for end in range(self.b, self.m + 1):  # later ends have smaller shifts, which stay
            self.shift[self._block([patterns[:, end - self.b + i] for i in range(self.b)])] = self.m - end
        self.keys = (patterns.astype(np.uint64) * self.wide).sum(axis=1, dtype=np.uint64)
        self.order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[self.order]
        self.patterns = patterns

    def _block(self, letters: list[np.ndarray]) -> np.ndarray:
        h = np.zeros(letters[0].shape, np.uint64)
        for x, k in zip(letters, self.mul):
            h += x.astype(np.uint64) * k
            h ^= h >> np.uint64(29)
        h *= np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, start in text) of every occurrence."""
        starts = np.arange(0, len(text), LANE)
        cur, stop = np.maximum(starts, self.m - 1), np.minimum(starts + LANE, len(text))
        ends = []
        while True:
            live = cur < stop
            if not live.all():
                cur, stop = cur[live], stop[live]
            if not len(cur):
                break
            s = self.shift[self._block([text[cur - (self.b - 1 - i)] for i in range(self.b)])]
            if (hit := s == 0).any():
                ends.append(cur[hit])
            cur = cur + np.maximum(s, 1)
        if not ends:
            return np.empty(0, int), np.empty(0, int)
        at = np.concatenate(ends) - self.m + 1
        window = text[at[:, None] + np.arange(self.m)]
        key = (window.astype(np.uint64) * self.wide).sum(axis=1, dtype=np.uint64)
        lo, hi = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, "right")
        n = hi - lo
        which = np.repeat(np.arange(len(at)), n)
        pat = self.order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        same = (self.patterns[pat] == window[which]).all(axis=1)
        return pat[same], at[which[same]]


def held(stretches: list[tuple[int, int, int]], least: int) -> int:
    """Most letters of a passage that stretches (start in passage, start in text, length) hold in the passage's order."""
    rows = sorted(set(stretches))
    best, ends, outs = (np.zeros(len(rows), np.int64) for _ in range(3))
    for i, (p, d, n) in enumerate(rows):
        best[i] = n
        if i:
            over = np.maximum(0, np.maximum(ends[:i] - p, outs[:i] - d))
            ok = (n - over >= least) | (over == 0)
            if ok.any():
                best[i] = max(n, int((best[:i] + n - over)[ok].max()))
        ends[i], outs[i] = p + n, d + n
    return int(best.max(initial=0))


def cap_runs(text: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts whose runs of one letter are cut to ``most``, the letters of the longest passage: more of them hold no more of any passage."""
    edge = np.flatnonzero(text[1:] != text[:-1]) + 1
    start = np.r_[0, edge]
    size = np.diff(np.r_[start, len(text)])
    if size.max(initial=0) <= most:
        return text, ends
    keep = np.arange(len(text)) - np.repeat(start, size) < most
    text = text[keep]
    return text, np.flatnonzero(text == SEP)


class Matcher:
    """Passages and their patterns; ``share`` of a passage's letters, in stretches of at least 2b - 1 (+1) letters."""

    def __init__(self, items: list[tuple[int, str, str | None]], least: dict[str, int], share: float):
        self.items = []
        blocks = defaultdict(list)
        for item, passage, lang in items:
            letters, ends = fold_texts([passage or ""])
            letters = letters[:-1]
            if not len(letters):
                continue
            least_here = least["en"] if lang == "en" else least["*"]
            b = least_here // 2
            for o in range(0, len(letters) - b + 1, b):
                blocks[b].append((len(self.items), o, letters[o : o + b]))
            self.items.append((item, letters, least_here, -(-share * len(letters) // 1)))
        self.sets = [([x[0] for x in v], [x[1] for x in v], np.stack([x[2] for x in v])) for v in blocks.values()]
        self.longest = max((len(x[1]) for x in self.items), default=0)
        self.engines = None

    def find(self, texts: list[str]) -> list[tuple[int, int]]:
        """(number of the text, item id) of every text that holds enough of an item."""
        return self.find_folded(*fold_texts([drop_line_numbers(t) for t in texts]))

    def find_folded(self, text: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
        if self.engines is None:
            self.engines = [(np.array(i), np.array(o), WuManber(p)) for i, o, p in self.sets]
        if not self.items:
            return []
        text, ends = cap_runs(text, ends, max(self.longest, 2))
        places = [np.empty((0, 3), np.int64)]
        for item, off, engine in self.engines:
            pat, at = engine.search(text)
            places.append(np.column_stack([np.searchsorted(ends, at), item[pat], at - off[pat]]))
        out, stretches, last, done = [], [], None, False

        def close() -> None:
            if last is not None and not done and len(stretches) > 1 and held(stretches, self.items[last[1]][2]) >= self.items[last[1]][3]:
                out.append((last[0], self.items[last[1]][0]))

        for doc, i, start in np.unique(np.concatenate(places), axis=0).tolist():  # by document and item
            if (doc, i) != last:
                close()
                stretches, last, done = [], (doc, i), False
            if done:
                continue
            item, letters, least, need = self.items[i]
            lo, hi = max(start, int(ends[doc - 1]) + 1 if doc else 0), min(start + len(letters), int(ends[doc]))
            same = np.r_[False, text[lo:hi] == letters[lo - start : hi - start], False]
            edge = np.flatnonzero(same[1:] != same[:-1])
            for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if e - s >= least:
                    stretches.append((lo - start + s, lo + s, e - s))
                    if e - s >= need and not done:  # one stretch is enough
                        out.append((doc, item))
                        done = True
        close()
        return out


_KEPT: dict[tuple[str, int], Matcher] = {}


def _stored(path: str, block: int, least: dict[str, int], share: float) -> Matcher:
    """A block of passages from the shared folder; a worker keeps the blocks of a pass."""
    if (path, block) not in _KEPT:
        from pyarrow import dataset, fs

        while len(_KEPT) >= BLOCKS:
            del _KEPT[next(iter(_KEPT))]
        uri = re.sub("^s3a:", "s3:", re.sub("^file:/+", "file:///", path))
        system, at = fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)
        rows = dataset.dataset(f"{at}/block={block}", filesystem=system, format="parquet").to_table().select(["i", "p", "l"])
        _KEPT[path, block] = Matcher(list(zip(*(c.to_pylist() for c in rows.columns))), least, share)
    return _KEPT[path, block]


def find_leaks(
    docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage", lang_col: str = "lang", least: int = 20, least_en: int = 40, share: float = 0.4, per_block: int = PASSAGES
) -> DataFrame:
    """Every document with each item it holds: ``doc_id, item_id``, distinct.

    A document holds an item when its text has at least ``share`` of the passage's letters and digits, in the passage's order, in
    stretches of at least ``least`` (``least_en`` where the passage's language is ``en``). Width, case, punctuation, white space,
    invisible characters and sequential line numbers make no difference. Null or empty texts and passages, and passages without
    letters or digits, match nothing; repeated rows give one result; extra columns are ignored.
    """
    spark = docs.sparkSession
    keep = passages.select(F.col(item_col).cast("long").alias("i"), F.col(passage_col).alias("p"), F.col(lang_col).alias("l")).where("i is not null and p is not null").distinct()
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).where("doc_id is not null and t is not null and t <> ''")
    least_by = {"*": least, "en": least_en}
    n, letters = keep.agg(F.count("*"), F.coalesce(F.sum(F.length("p")), F.lit(0))).first()
    blocks = max(1, -(-n // per_block), -(-letters // LETTERS))
    if blocks == 1:
        matcher = Matcher([tuple(r) for r in keep.collect()], least_by, share)  # bounded by PASSAGES and LETTERS
        passes = [lambda: [matcher]]
    else:
        path = shared_path(spark, "passages")
        keep.withColumn("block", F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int")).repartition("block").write.partitionBy("block").parquet(path)
        have = sorted(r[0] for r in spark.read.parquet(path).select("block").distinct().collect())
        passes = [lambda part=have[i : i + BLOCKS]: (_stored(path, b, least_by, share) for b in part) for i in range(0, len(have), BLOCKS)]
    out = None
    for matchers in passes:

        def run(batches: Iterator[pa.RecordBatch], matchers=matchers) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
                lo = size = 0
                found = []
                for hi, t in enumerate(texts):
                    size += len(t)
                    if size > CHUNK or hi == len(texts) - 1:
                        folded = fold_texts([drop_line_numbers(x) for x in texts[lo : hi + 1]])
                        found += [(int(ids[lo + d]), item) for m in matchers() for d, item in m.find_folded(*folded)]
                        lo, size = hi + 1, 0
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["doc_id", "item_id"])

        hits = src.mapInArrow(run, "doc_id long, item_id long")
        out = hits if out is None else out.unionByName(hits)
    return out.distinct()


def p8_found(spark, sf_dir: str) -> DataFrame:
    """Documents with the passages they hold, over all documents and passages."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/eval_passages.parquet"))
