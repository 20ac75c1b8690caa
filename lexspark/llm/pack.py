"""Problem 7: filling containers of fixed capacity with documents, by tokens of a public tokenizer.

Method: linear grouping scheme. Large lengths are rounded up to the largest of their group (groups of equal cardinality); the
packing of these few sizes is a linear program over configurations, solved by column generation and rounded down, its rest packed
best-fit; the configurations' places are then given to actual documents, and small documents go best-fit into what room these leave
and into further containers.

Scale: lengths are integers up to the capacity, so all planning works on histograms (at most ``capacity`` + 1 rows) and gives rules
over ranks: the documents of a group (or of a small length) with ranks from..to go to containers base..; every row finds its
container from its rank by binary search in the rules. Ranks come from counts by partition and key, so no group, however hot, is
sorted in one task.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexspark.runtime import cut

CAPACITY, GROUPS = 2_048, 40
#: The largest length that counts as small, as a share of the capacity.
SMALL = 1 / 8


def vocabulary_file(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return str(Path(public_tokenizers.__file__).with_name(name))


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The byte-level tokenizer of a ranks file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens`` of every text that isn't null or empty, once for each id, by the tokenizer of the ranks file ``path``."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).where("doc_id is not null and t is not null and t <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return src.mapInArrow(run, "doc_id long, n_tokens long").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


def group_sizes(hist: dict[int, int], groups: int) -> list[tuple[int, int, int]]:
    """(smallest, largest, count) of at most ``groups`` groups of about equal cardinality, largest first."""
    total, out, count, top = sum(hist.values()), [], 0, None
    for s in sorted(hist, reverse=True):
        top = s if top is None else top
        count += hist[s]
        if count * groups >= total or s == min(hist):
            out.append((s, top, count))
            count, top = 0, None
    return out


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 2_000) -> tuple[list[tuple[np.ndarray, int]], float]:
    """([(places by size, containers)], bound): whole numbers that give every item a place; sizes each at most the capacity.

    Gilmore and Gomory's column generation: the revised simplex over configurations, priced by an unbounded knapsack, to the optimum
    or for ``rounds`` exchanges. No packing of these sizes needs fewer containers than ``bound`` (the optimum, or Farley's bound
    where the rounds end before it), so what the plan has more is known.
    """
    k = len(sizes)
    if not k:
        return [], 0.0
    w, d = np.array(sizes), np.array(demand, float)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    x = np.linalg.solve(basis, d)
    bound = 0.0
    for _ in range(rounds):
        y = np.linalg.solve(basis.T, np.ones(k))
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(w.min()), capacity + 1):
            fits = w <= c
            value = np.where(fits, best[np.maximum(c - w, 0)] + y, -1.0)
            g = int(value.argmax())
            if value[g] > best[c - 1] + 1e-12:
                best[c], pick[c] = value[g], g
            else:
                best[c], pick[c] = best[c - 1], -2
        bound = max(bound, float(y @ d) / max(1.0, best[capacity]))
        if best[capacity] <= 1 + 1e-7:
            break
        a, c = np.zeros(k), capacity
        while c > 0 and pick[c] != -1:
            if pick[c] == -2:
                c -= 1
            else:
                a[pick[c]] += 1
                c -= w[pick[c]]
        u = np.linalg.solve(basis, a)
        ratio = np.where(u > 1e-9, x / np.where(u > 1e-9, u, 1), np.inf)
        i = int(ratio.argmin())
        basis[:, i] = a
        x = np.maximum(np.linalg.solve(basis, d), 0)
    out = [(np.rint(basis[:, j]).astype(int), int(x[j] + 1e-6)) for j in range(k) if x[j] >= 1]
    rest = d.astype(int) - sum((a * n for a, n in out), np.zeros(k, int))
    while (rest < 0).any():  # rounding never gives more places than items
        j = next(j for j, (a, n) in enumerate(out) if n and (a[rest < 0] > 0).any())
        out[j] = (out[j][0], out[j][1] - 1)
        rest += out[j][0]
    while rest.any():  # first-fit decreasing for the few left, as many containers alike as there can be
        a, room, left = np.zeros(k, int), capacity, rest.copy()
        for g in np.argsort(-w, kind="stable"):
            n = min(int(left[g]), int(room // w[g]))
            a[g] += n
            room -= n * int(w[g])
        times = int(min(rest[g] // a[g] for g in range(k) if a[g]))
        out.append((a, times))
        rest -= a * times
    return [(a, n) for a, n in out if n], bound


def fill_small(hist: dict[int, int], rooms: dict[int, int], capacity: int) -> tuple[list[tuple], int]:
    """Best-fit of small lengths, longest first, into containers with some room and then into new ones.

    Gives rules (length, first rank, items, room class or -1 for new, first container rank, containers) and the number of new
    containers: item rank r goes to container first + (r - first rank) mod containers.
    """
    free: dict[int, list[tuple[int, int, int]]] = {r: [(r, 0, n)] for r, n in rooms.items() if r > 0 and n > 0}
    order = sorted(free)
    rules, new = [], 0

    def add(room: int, seg: tuple[int, int, int]) -> None:
        if room > 0:
            if room not in free:
                free[room] = []
                insort(order, room)
            free[room].append(seg)

    for s in sorted(hist, reverse=True):
        left, rank = hist[s], 0
        while left:
            i = bisect_left(order, s)
            if i == len(order):
                n = max(1, -(-left // (capacity // s)))
                add(capacity, (-1, new, n))
                new += n
                continue
            room = order[i]
            kind, at, n = free[room].pop()
            if not free[room]:
                del free[room]
                order.pop(i)
            each = min(room // s, left // n) if left >= n else 1
            used = n if left >= n else left
            if used < n:
                add(room, (kind, at + used, n - used))
            rules.append((s, rank, each * used, kind, at, used))
            rank += each * used
            left -= each * used
            add(room - each * s, (kind, at, used))
    return rules, new


def _ranked(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``df`` with ``rank``: a number from 0 for each row of a key. ``df`` must come from a checkpoint, its partitions are the units."""
    df = df.withColumn("pid", F.spark_partition_id())
    inside = Window.partitionBy("pid", key).orderBy(*order)
    counts = df.groupBy("pid", key).agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy(key).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition and key
    offset = counts.select("pid", key, F.coalesce(before, F.lit(0)).alias("offset"))
    return df.withColumn("r", F.row_number().over(inside) - 1).join(offset, ["pid", key]).withColumn("rank", F.col("r") + F.col("offset")).drop("r", "offset", "pid")


def _place(df: DataFrame, key: str, rules: list[tuple], schema: str, extra: list[str]) -> DataFrame:
    """Each row's place: (key, rank) in rules (key, first rank, items, kind, first container, containers)."""
    table = np.array(sorted((r[0], r[1], r[2], r[3], r[4], r[5]) for r in rules), dtype=np.int64).reshape(-1, 6)
    span = 1 << 40
    starts = table[:, 0] * span + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column(b.schema.get_field_index(key)).to_numpy().astype(np.int64)
            r = b.column(b.schema.get_field_index("rank")).to_numpy().astype(np.int64)
            i = np.searchsorted(starts, k * span + r, "right") - 1
            rule = table[i]
            place = rule[:, 4] + (r - rule[:, 1]) % rule[:, 5]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in extra), pa.array(rule[:, 3]), pa.array(place)], names=[*extra, "kind", "place"])

    return df.mapInArrow(run, schema)


def pack(sizes: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """``doc_id, piece_no, from_token, n_tokens, container_id``: every item in exactly one container of the capacity.

    Items longer than the capacity are cut: pieces of the whole capacity, then the rest; ``from_token`` is where a piece begins.
    No other item is split, no container holds more than the capacity. Null ids, null sizes and sizes below 1 are left out; a row
    delivered again counts once (of several sizes of one id the largest); an empty table gives no rows. Ties go by id.
    """
    spark = sizes.sparkSession
    one = sizes.select(F.col(id_col).cast("long").alias("doc_id"), F.col(size_col).cast("long").alias("size")).where("doc_id is not null and size >= 1").groupBy("doc_id").agg(F.max("size").alias("size"))
    piece = F.posexplode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / capacity) * capacity, F.lit(capacity).cast("long"))).alias("piece_no", "from_token")
    items = one.select("doc_id", "size", piece).select("doc_id", "piece_no", "from_token", F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("from_token")).alias("n_tokens"))
    items = cut(items)
    schema = "doc_id long, piece_no int, from_token long, n_tokens long, kind long, place long"
    cols = ["doc_id", "piece_no", "from_token", "n_tokens"]
    hist = {r.n_tokens: r.c for r in items.groupBy("n_tokens").agg(F.count("*").alias("c")).collect()}  # capacity rows at most
    small = max(1, int(capacity * SMALL))
    large = {s: c for s, c in hist.items() if s > small}
    bins = group_sizes(large, groups) if large else []
    plan, _ = configurations([top for _, top, _ in bins], [c for *_, c in bins], capacity)
    rules, at, containers = [], [0] * len(bins), 0
    for a, n in plan:
        for g, times in enumerate(a):
            for _ in range(times):
                rules.append((g, at[g], n, 0, containers, n))
                at[g] += n
        containers += n
    group_of = {s: g for g, (lo, top, _) in enumerate(bins) for s in large if lo <= s <= top}
    keys = spark.createDataFrame([(int(s), int(group_of.get(s, len(bins) + s))) for s in hist] or [(0, 0)], "n_tokens long, key long")  # capacity rows at most
    ranked = _ranked(items.join(F.broadcast(keys), "n_tokens"), "key", ["doc_id", "piece_no"])
    big = _place(ranked.where(F.col("key") < len(bins)), "key", rules, schema, cols).select(*cols, F.col("place").alias("container_id")) if bins else None
    little = ranked.where(F.col("key") >= len(bins))
    rooms: dict[int, int] = {}
    room = None
    if big is not None:
        room = cut(big.groupBy("container_id").agg((F.lit(capacity) - F.sum("n_tokens")).cast("long").alias("room")))
        rooms = {r.room: r.c for r in room.groupBy("room").agg(F.count("*").alias("c")).collect()}
    rest, new = fill_small({s: c for s, c in hist.items() if s <= small}, rooms, capacity)
    placed = _place(little.withColumn("length", F.col("n_tokens")), "length", rest, schema, cols) if rest else None
    out = big
    if placed is not None:
        fresh = placed.where("kind = -1").select(*cols, (F.col("place") + containers).alias("container_id"))
        out = fresh if out is None else out.unionByName(fresh)
        if room is not None:
            slot = _ranked(room, "room", ["container_id"]).select(F.col("room").alias("kind"), F.col("rank").alias("place"), "container_id")
            out = out.unionByName(placed.where("kind >= 0").join(slot, ["kind", "place"]).select(*cols, "container_id"))
    if out is None:
        return items.select(*cols, F.lit(0).cast("long").alias("container_id"))
    return out


def p7_containers(spark, sf_dir: str) -> DataFrame:
    """All documents in containers of 2,048 tokens."""
    return pack(token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_file()))


def check(placed: DataFrame, sizes: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """One row about an assignment of items: ``items, astray, overfull, containers, least``.

    ``astray``: items of which not every token is in exactly one place, or that are split without need; ``overfull``: containers
    beyond the capacity; ``least``: the containers that all tokens need at least.
    """
    want = sizes.select(F.col(id_col).alias("doc_id"), F.col(size_col).alias("size")).groupBy("doc_id").agg(F.max("size").alias("size"))
    ends = F.sum(F.when(F.col("from_token") % capacity != 0, 1).otherwise(0)).alias("odd")
    got = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"), F.countDistinct("from_token").alias("places"), ends)
    right = (F.col("tokens") == F.col("size")) & (F.col("n") == F.ceil(F.col("size") / capacity)) & (F.col("n") == F.col("places")) & (F.col("odd") == 0)
    items = want.join(got, "doc_id", "full").agg(F.count("size").alias("items"), F.sum(F.when(F.coalesce(right, F.lit(False)), 0).otherwise(1)).alias("astray"), F.ceil(F.sum("size") / capacity).alias("least"))
    full = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("t")).agg(F.sum((F.col("t") > capacity).cast("int")).alias("overfull"), F.count("*").alias("containers"))
    return items.crossJoin(F.broadcast(full)).select("items", "astray", "overfull", "containers", "least")  # one row each


def p7_check(spark, sf_dir: str) -> DataFrame:
    """Whether every document is in its place, no container too full, and at most 3 % of them (and one) more than all tokens need."""
    sizes = cut(token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_file()))
    c = check(pack(sizes), sizes)
    return c.select("items", "astray", "overfull", (F.col("containers") <= F.ceil(1.03 * F.col("least")) + 1).alias("well_filled"))
