import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lexspark.llm import knn


def brute(rows, k):
    ids = np.array([i for i, _ in rows])
    u = knn._unit(np.array([v for _, v in rows], dtype=np.float32))
    s = np.round(u @ u.T, 9)
    out = {}
    for i in range(len(ids)):
        order = sorted((-s[i, j], ids[j]) for j in range(len(ids)) if j != i)
        out[int(ids[i])] = [int(j) for _, j in order[:k]]
    return out


def got(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r.id, []).append(r.other)
    return out


def table(spark, rows, dim=16):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], "x", 1.0) for i, v in rows], "chunk_id long, embedding array<float>, id string, cos double")


def test_all_neighbours(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(30, 16))
    rows = [(i + 1, centers[i % 30] + 0.2 * rng.normal(size=16)) for i in range(600)]
    assert got(knn.nearest_neighbours(table(spark, rows), dim=16)) == brute(rows, 5)


def test_recall_with_many_cells(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL_ROWS", 60)
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(150, 16))
    rows = [(i, centers[i % 150] + 0.25 * rng.normal(size=16)) for i in range(1500)]
    a, b = got(knn.nearest_neighbours(table(spark, rows), dim=16, margin=0.3)), brute(rows, 5)
    assert sum(len(set(a[i]) & set(b[i])) for i in b) >= 0.9 * 5 * len(b)


def test_split_cells_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 50)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16) + 3) for i in range(300)]  # one hot cell
    assert got(knn.nearest_neighbours(table(spark, rows), dim=16)) == brute(rows, 5)


def test_copies_and_ties_go_by_id(spark):
    rng = np.random.default_rng(4)
    same = rng.normal(size=16)
    rows = [(i, same) for i in range(100, 160)] + [(i, rng.normal(size=16)) for i in range(30)]
    assert got(knn.nearest_neighbours(table(spark, rows), dim=16)) == brute(rows, 5)


def test_parallel_copies_and_ties_go_by_id(spark):
    rng = np.random.default_rng(7)
    same = rng.normal(size=16)
    rows = [(i, same) for i in range(100, 160)]
    rows += [(i, same * c) for i, c in zip(range(300, 400), rng.uniform(0.01, 50, 100))]
    rows += [(i, 3.7 * same) for i in range(1, 4)] + [(i, 4 * same.astype(np.float32)) for i in range(600, 650)] + [(i, rng.normal(size=16)) for i in range(10, 40)]
    rows += [(i, same + 1e-3 * rng.normal(size=16)) for i in range(500, 560)]
    assert got(knn.nearest_neighbours(table(spark, rows), dim=16)) == brute(rows, 5)


def test_multiples_are_copies_and_near_ones_are_not():
    rng = np.random.default_rng(8)
    v = rng.integers(-1000, 1000, 384).astype(np.float32)
    v[0] = 0
    vectors = [v * np.float32(c) for c in (1, 3, 0.375, 2.0**-100, 77)] + [-v, v + np.float32(1e-3) * (np.arange(384) == 5)]
    b = pa.record_batch([pa.array(range(7)), pa.array([x.tolist() for x in vectors], pa.list_(pa.float32()))], names=["id", "v"])
    digests = next(knn._digests(384)([b])).column(1).to_pylist()
    assert len(set(digests[:5])) == 1 and len(set(digests)) == 3


def test_near_copies_take_bounded_memory():
    rng = np.random.default_rng(9)
    x = (rng.normal(size=64) + 1e-4 * rng.normal(size=(3000, 64))).astype(np.float32)
    tracemalloc.start()
    left, right, _ = knn.block_neighbours(np.arange(3000), x, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and np.bincount(left).tolist() == [5] * 3000


@pytest.mark.parametrize("pairs, dense", [(1, 2.0), (7, 2.0), (1, 0.0), (500, 0.0), (50, 0.5)])
def test_slices_change_nothing(monkeypatch, pairs, dense):
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(size=(100, 8)), np.tile(rng.normal(size=8), (30, 1)), rng.normal(size=8) + 1e-4 * rng.normal(size=(30, 8))]).astype(np.float32)
    ids = rng.permutation(160)
    block = np.arange(160) % 2
    whole = [knn.block_neighbours(ids, x, 4), knn.block_neighbours(ids, x, 4, block)]
    monkeypatch.setattr(knn, "SLICE", pairs)
    monkeypatch.setattr(knn, "DENSE", dense)
    for a, b in zip(whole, [knn.block_neighbours(ids, x, 4), knn.block_neighbours(ids, x, 4, block)]):
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist() and np.allclose(a[2], b[2], atol=1e-12)
    have = {}
    for a, b in zip(*whole[0][:2]):
        have.setdefault(int(ids[a]), []).append(int(ids[b]))
    assert have == brute(list(zip(ids.tolist(), x)), 4)


def test_unusable_repeated_and_few(spark):
    v = list(range(1, 17))
    rows = [(1, v), (1, v), (2, v[::-1]), (3, None), (4, [0.0] * 16), (5, [1.0] * 15), (6, [float("nan")] + v[1:]), (7, [float("inf")] + v[1:])]
    assert got(knn.nearest_neighbours(table(spark, rows), dim=16)) == {1: [2], 2: [1]}
    assert knn.nearest_neighbours(table(spark, rows[3:]), dim=16).count() == 0
    assert knn.nearest_neighbours(table(spark, []), dim=16).count() == 0


def test_norm_makes_no_difference(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16) * 10.0 ** rng.integers(-15, 15)) for i in range(80)]
    assert got(knn.nearest_neighbours(table(spark, rows), dim=16)) == brute(rows, 5)


@pytest.mark.parametrize("k", [1, 3])
def test_block_bounds_keep_the_best(k):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 8)).astype(np.float32)
    left, right, _ = knn.block_neighbours(np.arange(200), x, k)
    want = brute(list(enumerate(x)), k)
    have = {}
    for a, b in zip(left, right):
        have.setdefault(int(a), []).append(int(b))
    assert have == want


def test_more_dimensions_than_float32_holds():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 1_500)).astype(np.float32)
    ids = np.arange(200) * 64
    left, right, cos = knn.block_neighbours(ids, x, 3)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -9)
    for i in range(0, 200, 20):
        mine = sorted(zip(-np.round(cos[left == i], 9), right[left == i]))[:3]
        assert [j for _, j in mine] == np.argsort(-s[i], kind="stable")[:3].tolist()
