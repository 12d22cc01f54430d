"""Hard negatives against a full scan, over many shards, and their edge cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwise.llm import negatives

ROWS = "vec_id bigint, embedding array<float>, label int, shard string, uid int, x string"


def plain(rows, positives=5, count=10, low=30, high=90):
    """Lists of every anchor by scoring all rows."""
    usable = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v], label)
        for i, v, label, *_ in rows
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    last = lambda i: (i is None, i or 0)
    out = []
    for a, (anchor, v, label) in enumerate(usable):
        if anchor is None or anchor % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w)), last(i), i, other) for b, (i, w, other) in enumerate(usable) if b != a]
        scored.sort(key=lambda r: r[:2])
        for minus, _, i, _ in [r for r in scored if r[3] == label][:positives]:
            p = -minus
            hard = [r for r in scored if r[3] != label and low * p <= -100 * r[0] <= high * p][:count]
            out += [(anchor, i, rank, r[2], p, -r[0]) for rank, r in enumerate(hard, 1)]
    return sorted(out, key=repr)


def mined(spark, rows, **settings):
    df = spark.createDataFrame(rows, ROWS)
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, **settings).collect()), key=repr)


def clustered(n, dims, groups, seed, spread=0.1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dims))
    group = r.integers(0, groups, n)
    vectors = centres[group] + spread * r.normal(size=(n, dims))
    return [(i, [float(x) for x in np.float32(vectors[i])], int(group[i] % 3), "s", 1, "x") for i in range(n)]


@pytest.mark.parametrize("dims, shard_rows", [(8, 40), (7, 1000), (2, 100), (1, 60)])
def test_equal_to_full_scan_over_shards(spark, dims, shard_rows):
    rows = clustered(700, dims, 12, dims, 0.4)
    want = plain(rows)
    assert len(want) > 60
    assert mined(spark, rows, shard_components=shard_rows * max(2, dims)) == want


def test_ties_copies_and_a_hot_vector(spark):
    r = random.Random(3)
    few = [[r.choice((-1.0, 0.0, 0.5)) for _ in range(4)] for _ in range(9)]
    rows = [(i, few[0] if i % 3 else r.choice(few), r.randint(0, 2), "s", 1, "x") for i in range(500)]
    rows += rows[100:103] + [(None, few[0], 1, None, None, None), (None, few[1], 0, None, None, None)]
    assert mined(spark, rows, shard_components=160) == plain(rows)


def test_rows_that_take_no_part_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0, 3.0], 1, "s", 1, "x"),
        (100, [1.0], 1, "s", 1, "x"),
        (200, [], 1, "s", 1, "x"),
        (300, [-1.0, 0.0], 2, "s", 1, "x"),
        (1, [nan, 1.0], 1, "s", 1, "x"),
        (2, [inf, 1.0], 1, "s", 1, "x"),
        (3, [None, 1.0], 1, "s", 1, "x"),
        (4, None, 1, None, None, None),
        (5, [1.0, 1.0], None, None, None, None),
        (6, [0.001953125, -0.001953125], 2, "s", 1, "x"),
        (7, [0.5, 0.0], 0, "s", 1, "x"),
    ]
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, []) == [] and mined(spark, rows[4:9]) == [] and mined(spark, rows[:1]) == []


def test_scores_beyond_the_exact_range_of_doubles(spark):
    r = random.Random(5)
    rows = [(i * 50, [float(r.randint(1, 2**21)) * 2 for _ in range(3)], i % 2, "s", 1, "x") for i in range(40)]
    assert max(p[4] for p in plain(rows)) > 2**53
    assert mined(spark, rows) == plain(rows)
    with pytest.raises(Exception, match="do not fit 64 bits"):
        mined(spark, [(0, [1e30], 1, "s", 1, "x")])


def test_pairs_come_in_descending_order_and_once():
    r = np.random.default_rng(1)
    first, second = (-np.sort(-r.normal(size=n)) for n in (9, 14))
    got = list(negatives.multi_sequence(first, second))
    assert len({(i, j) for _, i, j in got}) == 9 * 14 == len(got)
    assert [s for s, _, _ in got] == sorted((s for s, _, _ in got), reverse=True)
    assert all(s == first[i] + second[j] for s, i, j in got)


def test_walk_stops_early_where_cells_are_apart(spark):
    rows = clustered(4000, 16, 60, 4, 0.02)
    df = spark.createDataFrame(rows, ROWS)
    index = negatives.build(negatives.integer_vectors(df, F.col("vec_id") % 100 == 0, 256))
    table = index.rows.orderBy("code1", "code2", "uid").toArrow()
    shard = negatives.Shard(index.codes, table.combine_chunks().to_batches())
    walked = 0
    for i in range(0, 4000, 100):
        at = int(np.flatnonzero(shard.ids == i)[0])
        best = negatives.Best(5, negatives.LEAST, negatives.MOST, negatives.LEAST)
        same = lambda x: (shard.labels[x] == shard.labels[at]) & (x != at)  # noqa: E731, B023
        walked += shard.walk(shard.vectors[at], same, [best])
    assert walked < 0.5 * 40 * 4000
