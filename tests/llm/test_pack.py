import random

import pytest

from lexspark.llm.pack import configurations, fill_small, group_sizes, pack, token_counts, vocabulary_file


def check(spark, sizes, capacity=2048):
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long, key string, rank int") if sizes and len(sizes[0]) == 4 else spark.createDataFrame(sizes, "doc_id long, n_tokens long")
    r = pack(df, capacity).collect()
    fill = {}
    for x in r:
        fill[x.container_id] = fill.get(x.container_id, 0) + x.n_tokens
        assert x.n_tokens <= capacity
    assert all(v <= capacity for v in fill.values())
    want = {i: n for i, n, *_ in sizes if i is not None and n is not None and n >= 1}
    by = {}
    for x in r:
        by.setdefault(x.doc_id, []).append((x.piece_no, x.from_token, x.n_tokens))
    assert {i: sum(p[2] for p in v) for i, v in by.items()} == want
    for v in by.values():
        v.sort()
        assert [p[0] for p in v] == list(range(len(v))) and all(a[1] + a[2] == b[1] for a, b in zip(v, v[1:])) and all(p[2] == capacity for p in v[:-1])
    return len(fill), sum(want.values()) / capacity


@pytest.mark.parametrize("seed", range(2))
def test_all_packed_with_little_space_left(spark, seed):
    rng = random.Random(seed)
    n, least = check(spark, [(i, int(min(9000, max(1, rng.lognormvariate(6, 1.1))))) for i in range(3000)])
    assert n <= 1.03 * least + 2


def test_hot_size(spark):
    n, least = check(spark, [(i, 700) for i in range(2000)] + [(9000 + i, 640) for i in range(1000)] + [(20000 + i, 30) for i in range(500)])
    assert n <= 1.06 * least + 2


def test_edges(spark):
    check(spark, [(1, 5, "a", 1), (2, None, "a", 1), (None, 3, "a", 1), (3, 0, "a", 1), (4, 2048, "a", 1), (5, 2049, "a", 1), (1, 5, "a", 1)])
    check(spark, [(1, 1)])
    check(spark, [(1, 2000), (2, 2000)])
    assert pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_configurations_place_every_item():
    sizes, demand = [1500, 1000, 700, 400], [10, 33, 51, 70]
    plan, bound = configurations(sizes, demand, 2048)
    assert 0 < bound <= sum(n for _, n in plan) <= bound + len(sizes)
    assert [sum(int(a[g]) * n for a, n in plan) for g in range(4)] == demand
    assert all(sum(int(a[g]) * sizes[g] for g in range(4)) <= 2048 for a, _ in plan)


def test_small_go_best_fit():
    rules, new = fill_small({100: 3, 50: 1}, {120: 2, 60: 1}, 200)
    assert sum(r[2] for r in rules) == 4 and new == 1
    assert (50, 0, 1, 60, 0, 1) in rules
    assert group_sizes({10: 5, 9: 5, 1: 10}, 4) == [(10, 10, 5), (9, 9, 5), (1, 1, 10)]


def test_counts(spark):
    df = spark.createDataFrame([(1, "第一條 hello"), (1, "第一條 hello"), (2, None), (3, "")], "doc_id long, text string")
    r = token_counts(df, vocabulary_file()).collect()
    assert len(r) == 1 and r[0].n_tokens > 2
