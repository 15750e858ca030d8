"""The epsilon grid order join against all pairs."""

import math
import random

import numpy as np
from llm.test_search_and_mix import vector_table

from tessera.llm.gridorder import Basis, Joiner, Sequence, near_vectors, tree_hubs
from tessera.llm.linking import component_labels, join_unique


def plain(rows, threshold):
    """Links and components of all rows, pair by pair; rows are known by position."""
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = {i: set() for i in range(len(rows))}
    for size in {len(rows[i][1]) for i in good}:
        at = [i for i in good if len(rows[i][1]) == size]
        x = np.array([rows[i][1] for i in at])
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in np.argwhere(x @ x.T >= threshold):
            if a != b:
                near[at[a]].add(at[b])
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - group:
                group.add(j)
                todo.append(j)
        seen |= group
        ids = [rows[j][0] for j in group if rows[j][0] is not None]
        for j in group:
            out[j] = (rows[j][0], len(near[j]), min(ids) if ids else None, rows[j][0] == (min(ids) if ids else None))
    return sorted(out, key=str)


def clustered(n=2500, d=12, seed=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(40)]
    rows = []
    for i in range(n):
        spread = rng.choice([0.02, 0.15, 0.3, 0.6])
        rows.append((i, [c + rng.gauss(0, spread) for c in rng.choice(centres)]))
    same = [c * 3 for c in centres[0]]
    rows += [(n + i, same) for i in range(900)]  # copies
    rows += [(2 * n + i, [c * (1 + i) + 1e-4 * rng.random() for c in centres[1]]) for i in range(900)]  # near copies of other length
    rows += [(9000, None), (9001, []), (9002, [math.nan] * d), (9003, [None] + [1.0] * (d - 1)), (9004, [math.inf] * d), (9005, [0.0] * d), (9006, [1.0] * (d + 3)),
             (9007, [1.0] * (d + 2) + [1.1]), (20, rows[20][1]), (20, rows[25][1]), (None, rows[1][1]), (None, [1e-200] * d), (-40, [x * 30 for x in rows[3][1]]), (None, None),
             (9010, [1e200] * d), (9011, [5.0]), (9012, [7.0]), (9013, [-7.0])]
    return rows


def test_all_links_and_components(spark):
    rows = clustered()
    for threshold in (0.95, 0.8):
        got = sorted(map(tuple, near_vectors(vector_table(spark, rows), threshold, block_nodes=500).collect()), key=str)
        assert got == plain(rows, threshold)
    assert near_vectors(vector_table(spark, rows).limit(0)).count() == 0
    nothing = vector_table(spark, [(1, None), (2, [0.0, 0.0])])
    assert sorted(map(tuple, near_vectors(nothing).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_provable_intervals_are_not_compared():
    rng = np.random.default_rng(2)
    far = np.concatenate([rng.normal(0, 0.01, (1000, 20)) + 5 * np.eye(20)[i] for i in range(10)])
    unit = far / np.linalg.norm(far, axis=1, keepdims=True)
    epsilon = math.sqrt(0.1)
    sequence = Sequence(unit, np.ones(len(unit), np.int64), Basis(unit), epsilon, 0)
    joiner = Joiner(len(unit), 0.95, epsilon)
    joiner.within(sequence.whole())
    assert joiner.compared < 300  # of 3,160 pairs of leaves
    assert (joiner.links == 999).all() and len(set(joiner.forest.roots(np.arange(len(unit))))) == 10


def test_trees_join_their_root():
    rng = np.random.default_rng(3)
    nodes, root = rng.permutation(9000), rng.integers(0, 5, 9000)
    hubs = tree_hubs(nodes, root)
    by_node = dict(zip(nodes.tolist(), hubs.tolist()))
    of = dict(zip(nodes.tolist(), root.tolist()))
    assert np.bincount(hubs).max() <= 66
    for n in nodes.tolist():
        while by_node[n] != n:
            assert of[by_node[n]] == of[n]
            n = by_node[n]
        assert n == min(m for m in by_node if of[m] == of[n]) if n % 500 == 0 else True


def test_components_and_joins_under_hot_keys(spark):
    star = [(i, 0) for i in range(1, 700)] + [(1000 + i, 1001 + i) for i in range(300)] + [(5, 1005), (2001, 2000), (3000, 3000)]
    got = dict(map(tuple, component_labels(spark.createDataFrame(star, "node long, hub long").repartition(4)).collect()))
    assert all(got[i] == 0 for i in (0, 1, 699, 1000, 1300)) and got[2001] == got[2000] == 2000 and got[3000] == 3000
    assert component_labels(spark.createDataFrame([], "node long, hub long")).count() == 0
    left = spark.createDataFrame([(7 if i % 3 else i, i) for i in range(900)] + [(None, -1)], "k long, v long")
    right = spark.createDataFrame([(i, f"r{i}") for i in range(0, 900, 2)] + [(7, "r7")], "k long, w string")
    for how in ("left", "inner"):
        assert sorted(map(str, join_unique(left, right, ["k"], how).collect())) == sorted(map(str, left.join(right, ["k"], how).collect()))
