import datetime as dt
import random

import pytest

from lexspark.operators.history import version_history

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "fetch_id long, law_id long, content_hash string, fetched_at timestamp_ntz, ingested_at timestamp_ntz, part string, kind string"


def brute(rows):
    best = {}
    for f, law, h, at, ing, *_ in rows:
        if None in (f, law, h, at) or not h.strip("　  \t\n﻿"):
            continue
        key = (law, at)
        rank = (ing or dt.datetime.min, f)
        if key not in best or rank > best[key][0]:
            best[key] = (rank, h.strip("　  \t\n﻿").lower(), f)
    out, last, no, first = [], {}, {}, {}
    for (law, at), (_, h, f) in sorted(best.items(), key=lambda x: x[0]):
        if last.get(law) != h:
            no[law] = no.get(law, 0) + 1
            if law in first:
                out[first[law]][5:] = [f, at]
            first[law] = len(out)
            out.append([law, no[law], h, at, f, 0, None])
        last[law] = h
    return sorted(map(tuple, out))


def got(spark, rows, n):
    r = version_history(spark.createDataFrame(rows, SCHEMA), partitions=n)
    assert all((x.closed_by == 0) == x.is_current for x in r.collect())
    return sorted((x.law_id, x.version_no, x.content_hash, x.valid_from, x.opened_by, x.closed_by, x.valid_to) for x in r.collect())


@pytest.mark.parametrize(("seed", "n"), [(1, 1), (2, 3), (3, 9), (4, 40)])
def test_against_brute_force(spark, seed, n):
    rng = random.Random(seed)
    rows = []
    for f in range(1, 401):
        law = 1 if rng.random() < 0.5 else rng.randrange(2, 9)  # a hot entity over many partitions
        rows.append((f, law, rng.choice(["a", "A ", "b", "　b", "c"]), T0 + dt.timedelta(hours=rng.randrange(150)), T0 + dt.timedelta(hours=rng.randrange(3)), "x", "y"))
    rows += rng.sample(rows, 40)
    assert got(spark, rows, n) == brute(rows)


def test_edges(spark):
    at = [T0 + dt.timedelta(days=i) for i in range(6)]
    rows = [(1, 7, "A", at[0], at[0], "", ""), (2, 7, " a ", at[1], at[1], "", ""), (3, 7, "b", at[2], at[2], "", ""), (4, 7, "a", at[3], at[3], "", ""), (5, 7, None, at[4], at[4], "", ""), (6, None, "z", at[4], at[4], "", ""), (7, 7, "  ", at[5], at[5], "", ""), (8, 8, "q", at[0], None, "", ""), (9, 8, "r", at[0], at[0], "", ""), (9, 8, "r", at[0], at[0], "", ""), (10, 8, "r", None, at[0], "", "")]
    assert got(spark, rows, 4) == brute(rows)
    assert got(spark, [], 4) == []
    assert got(spark, rows[4:6], 4) == []
