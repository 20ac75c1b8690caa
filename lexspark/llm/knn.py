"""Problem 3: the k most similar vectors for every vector.

Method: block matrix join. Vectors go to the cells of a coarse partition (each to its nearest cell, and to the second nearest too
where that one is nearly as near); a cell is one block, joined with itself by int8 product tiles. The products of the int8 codes
are exact (float32, for more than 1,040 dimensions float64, holds the integers), and the quantisation errors bound the true cosine from both sides; pairs whose upper bound
reaches the k-th best lower bound survive, are computed again in float64 and merged best-first.

Scale: the partition is fitted on a bounded sample (``SAMPLE`` vectors at most, ``CELLS`` centroids at most); every vector is
indexed. A cell expected to hold more than ``BLOCK`` vectors is cut into blocks whose pairs of blocks are separate groups, so no
task gets more than two blocks. Survivors are computed again in slices that keep k a row, so memory doesn't grow with their number.
Exact copies (also multiples) beyond the k+1 smallest ids of a direction never enter a block: their neighbours are those of the last
of these, which has k copies with smaller ids itself. Near copies (multiples rounded to float32 too) differ for third vectors in the
ninth digit, so all of them are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexspark.runtime import cut

#: Bounds of the fit: sampled vectors and centroids; wanted vectors a cell; vectors a block; margin in cosine for a second cell.
SAMPLE, CELLS, CELL_ROWS, BLOCK, MARGIN = 32_768, 2_048, 800, 8_192, 0.12
TILE = 1_024
#: Pairs computed again at once; from this share of the pairs that are left, whole rows are multiplied.
SLICE, DENSE = 16_384, 1 / 16


def _matrix(col: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the usable vectors (not null, ``dim`` finite values, not all zero), and these as float32."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    lengths = np.nan_to_num(col.value_lengths().to_numpy(zero_copy_only=False).astype(float), nan=-1)
    right = np.flatnonzero(lengths == dim)
    if not len(right):
        return right, np.empty((0, dim), np.float32)
    flat = col.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float32)  # a null value becomes NaN
    x = flat.reshape(len(right), dim)
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return right[ok], x[ok]


def _scaled(x: np.ndarray) -> np.ndarray:
    """With 1 as the largest size: the same bits for all multiples of a vector."""
    y = x.astype(np.float64)
    y /= np.abs(y).max(axis=1, keepdims=True)
    return y


def _unit(x: np.ndarray) -> np.ndarray:
    y = _scaled(x)  # neither overflows nor vanishes when squared
    return y / np.sqrt(np.einsum("ij,ij->i", y, y))[:, None]


def _digests(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = _matrix(b.column(1), dim)
            h = [xxhash.xxh3_128_digest(v.tobytes()) for v in _scaled(x) + 0.0]  # -0.0 + 0.0 is 0.0
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(h, pa.binary())], names=["id", "digest"])

    return run


def fit_cells(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means over unit vectors ``x``."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        a = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        new = np.zeros_like(c)
        np.add.at(new, a, x)
        norm = np.linalg.norm(new, axis=1)
        empty = norm < 1e-6
        new[empty], norm[empty] = x[rng.choice(len(x), int(empty.sum()))], 1.0
        c = new / norm[:, None]
    return c.astype(np.float32)


def _assign(dim: int, cells: np.ndarray, splits: np.ndarray, margin: float):
    """Rows (cell, block pair, block, id, vector): a vector's cells, and in a split cell all pairs of blocks with its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            rows, x = _matrix(b.column(1), dim)
            if not len(rows):
                continue
            ids = b.column(0).take(pa.array(rows)).to_numpy()
            sim = _unit(x).astype(np.float32) @ cells.T
            best = sim.argmax(axis=1)
            at = np.arange(len(x))
            top = sim[at, best]
            sim[at, best] = -2
            second = sim.argmax(axis=1)
            near = (sim[at, second] > top - margin) & (sim[at, second] > -2)
            who = np.r_[at, at[near]]
            cell = np.r_[best, second[near]]
            # Byte planes of the floats: lossless, and the planes of sign and exponent pack well.
            z = [pack.compress(v.view(np.uint8).reshape(-1, 4).T.tobytes()) for v in x]
            s = splits[cell]
            reps = np.repeat(np.arange(len(who)), s)
            other = np.concatenate([np.arange(k) for k in s]) if (s > 1).any() else np.zeros(len(who), int)
            # Mixed bits of the id: ids with a common factor fill all blocks alike.
            mixed = (ids[who[reps]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            own = (mixed % s[reps].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cell[reps], pa.int32()),
                    pa.array(np.minimum(own, other), pa.int32()),
                    pa.array(np.maximum(own, other), pa.int32()),
                    pa.array(own, pa.int32()),
                    pa.array(ids[who[reps]], pa.int64()),
                    pa.array([z[i] for i in who[reps]], pa.binary()),
                ],
                names=["cell", "a", "b", "block", "id", "v"],
            )

    return run


def _again(ids: np.ndarray, u: np.ndarray, start: int, keep: np.ndarray, k: int, by_id: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, neighbour's row, cosine) in float64: the k best of the pairs in ``keep``, whose rows begin at ``start``."""
    n = len(keep)
    if keep.sum() < DENSE * keep.size:
        left, right = np.nonzero(keep)
        cos = np.einsum("ij,ij->i", u[left + start], u[right])
        order = np.lexsort((ids[right], -np.round(cos, 9), left))
        left, right, cos = left[order], right[order], cos[order]
        best = np.arange(len(left)) - np.searchsorted(left, np.arange(n))[left] < k
        return left[best] + start, right[best], cos[best]
    cos = u[start : start + n] @ u.T
    near = np.where(keep, np.round(cos, 9), -9)[:, by_id]
    rows, picked = np.arange(n), []
    for _ in range(min(k, near.shape[1])):
        first = near.argmax(axis=1)  # of equals the first: the smallest id
        picked.append(np.where(near[rows, first] > -8, by_id[first], -1))
        near[rows, first] = -9
    right = np.stack(picked, axis=1)
    left = np.repeat(rows, right.shape[1])[right.ravel() >= 0]
    right = right.ravel()[right.ravel() >= 0]
    return left + start, right, cos[left, right]


def block_neighbours(ids: np.ndarray, x: np.ndarray, k: int, block: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, neighbour's row, cosine): the k nearest of each row within the block; with ``block``, among rows of the other block."""
    u = _unit(x)
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    err = np.sqrt(((u - q * scale[:, None]) ** 2).sum(axis=1))
    qf = q.astype(np.float32 if x.shape[1] * 127**2 < 2**24 else np.float64)  # holds the integers of the products
    size = np.sqrt((qf.astype(np.float64) ** 2).sum(axis=1)) * scale  # length of the code's vector
    by_id = np.argsort(ids, kind="stable")
    out = []
    for i in range(0, len(ids), TILE):
        r = slice(i, min(i + TILE, len(ids)))
        dot = qf[r] @ qf.T  # exact
        dot *= scale.astype(qf.dtype)[r, None]
        dot *= scale.astype(qf.dtype)[None, :]
        n = dot.shape[0]
        if block is None:
            dot[np.arange(n), np.arange(r.start, r.stop)] = -9
        else:
            dot[block[r][:, None] == block[None, :]] = -9
        # |x.y - q.p| <= |x - q||p| + |y - p||x|, with a little for the float32 scaling
        bound = (err[r, None] * size.max() + err.max() * 1.0 + 4e-6).astype(np.float32)
        kk = min(k, dot.shape[1])
        kth = np.partition(dot, dot.shape[1] - kk, axis=1)[:, dot.shape[1] - kk][:, None]
        keep = (dot >= kth - 2 * bound) & (dot > -8)
        upto = np.cumsum(keep.sum(axis=1))
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE, side="right")))
            left, right, cos = _again(ids, u, i + at, keep[at:to], k, by_id)
            out.append((left, right, cos))
            at = to
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, int),) * 3


def _join_block(dim: int, k: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        ids, first = np.unique(t.column("id").to_numpy(), return_index=True)  # a row delivered again is the same row
        unpack = zstandard.ZstdDecompressor()
        v = t.column("v").take(pa.array(first))
        x = np.stack([np.frombuffer(unpack.decompress(z.as_py()), np.uint8).reshape(4, dim).T.copy().view(np.float32)[:, 0] for z in v])
        block = None if key[1].as_py() == key[2].as_py() else t.column("block").to_numpy()[first]
        left, right, cos = block_neighbours(ids, x, k, block)
        return pa.table({"id": ids[left], "other": ids[right], "cos": np.round(cos, 9)})

    return run


def nearest_neighbours(df: DataFrame, id_col: str = "chunk_id", vec_col: str = "embedding", k: int = 5, dim: int = 384, margin: float = MARGIN) -> DataFrame:
    """The k nearest of every usable vector by cosine: ``id, rank, other, cos``; of equals the smaller id is nearer.

    Usable is a vector that isn't null and has ``dim`` finite values that aren't all zero; other rows give and get nothing. A row
    delivered again counts once (ids are taken as they are; a null id is no row). Fewer than k others give fewer rows; an empty
    table gives none. Extra columns are ignored.
    """
    spark = df.sparkSession
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).where("id is not null and v is not null")
    digests = src.mapInArrow(_digests(dim), "id long, digest binary")
    groups = digests.groupBy("digest").agg(F.count("*").alias("c"))
    n, crowded = groups.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum((F.col("c") > k + 1).cast("int")), F.lit(0))).first()
    schema = "id long, other long, cos double"
    if not n:
        return spark.createDataFrame([], "id long, rank int, other long, cos double")
    surplus = None
    if crowded:
        # The k + 1 smallest ids stand for a vector that occurs more often; WindowGroupLimit keeps them before the shuffle.
        many = digests.join(groups.where(F.col("c") > k + 1).select("digest"), "digest", "left_semi")
        least = many.withColumn("r", F.dense_rank().over(Window.partitionBy("digest").orderBy("id"))).where(F.col("r") <= k + 1).distinct()
        last = least.groupBy("digest").agg(F.max("id").alias("last"))
        surplus = cut(many.join(last, "digest").where("id > last").select("id", "last").distinct())  # ids only; read twice below
        src = src.join(surplus.select("id"), "id", "left_anti")
    share = min(1.0, 1.3 * SAMPLE / n)
    take = src.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_000)) < int(share * 1_000_000) + 1).limit(SAMPLE)
    _, x = _matrix(take.select("v").toArrow().column(0), dim)
    u = _unit(x).astype(np.float32) if len(x) else np.eye(1, dim, dtype=np.float32)
    cells = fit_cells(u, max(1, min(CELLS, n // CELL_ROWS, len(u) // 4)))
    seen = np.bincount(np.concatenate([(u[i : i + 4096] @ cells.T).argmax(axis=1) for i in range(0, len(u), 4096)]), minlength=len(cells))
    splits = np.maximum(1, np.ceil(2 * seen / len(u) * n / BLOCK)).astype(np.int64)
    blocks = src.mapInArrow(_assign(dim, cells, splits, margin), "cell int, a int, b int, block int, id long, v binary")
    near = blocks.groupBy("cell", "a", "b").applyInArrow(_join_block(dim, k), schema)
    # At most k rows of each block and cell that the vector is in.
    best = near.groupBy("id").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("cos")).alias("far"), "other"))), 1, k).alias("near"))
    if surplus is not None:
        best = cut(best)  # else the blocks are joined twice
        best = best.unionByName(surplus.join(best.withColumnRenamed("id", "last"), "last").select("id", "near"))
    return best.select("id", F.posexplode("near").alias("rank", "p")).select("id", (F.col("rank") + 1).alias("rank"), F.col("p.other").alias("other"), (-F.col("p.far")).alias("cos"))


def p3_found(spark, sf_dir: str) -> DataFrame:
    """Pairs of chunks of which one at least is among the five nearest of the other."""
    near = nearest_neighbours(spark.read.parquet(f"{sf_dir}/law_chunks.parquet"))
    return near.select(F.least("id", "other").alias("chunk_id_1"), F.greatest("id", "other").alias("chunk_id_2")).distinct()
