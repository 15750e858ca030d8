"""Vector search and mixing against plain versions, and the registered queries against their SQL."""

import collections
import math
import random

import numpy as np
import pytest
from llm.frames import edge_docs, edge_rows
from oracle import compare, connect

from tessera.llm import queries as llm
from tessera.llm.blockmax import BlockIndex, exact_top_k, multiples
from tessera.llm.hamming import SubstringIndex, hamming_search
from tessera.llm.mixture import mix_sources, mixed_documents

SF = "/root/testdata/sf0.001"


def vector_rows(n=700, d=12):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(d)]) for i in range(n)]
    same = [1.0] * d
    rows += [(n + i, same) for i in range(150)]  # ties
    rows += [(5000, None), (5020, []), (5040, [math.nan] * d), (5060, [None] + [1.0] * (d - 1)), (5080, [math.inf] * d), (5100, [0.0] * d), (5120, [1.0] * (d + 3)),
             (20, rows[20][1]), (None, rows[1][1]), (-40, [x * 30 for x in rows[3][1]])]
    return rows


def vector_table(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", 2, 0.5) for r in rows], "vec_id long, embedding array<double>, rank int, vec string, query_id long, score double").repartition(3)


def plain_top(rows, every, k, measure, zero):
    good = [(i, v) for i, v in rows if i is not None and v and len(v) == 12 and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))]
    ids = np.array([i for i, _ in good])
    scores = measure(np.array([v for _, v in good]))
    out = []
    for q in sorted(i for i in range(len(good)) if ids[i] % every == 0):
        order = [j for j in np.lexsort((ids, -scores[q])) if ids[j] != ids[q]][:k]
        out.append((int(ids[q]), [(int(ids[j]), scores[q][j]) for j in order]))
    return out


def test_vectors_meet_those_of_their_length(spark):
    rng = random.Random(18)
    rows = vector_rows(200) + [(20_000 + i, [rng.gauss(0, 1) for _ in range(7)]) for i in range(60)] + [(30_000, [1.0, 2.0])]
    short = [(i, v) for i, v in rows if v and len(v) == 7]
    scores = {(a, b): sum(x * y for x, y in zip(u, v)) for a, u in short for b, v in short if a != b}
    got = by_query(hamming_search(vector_table(spark, rows), multiples(20), k=5))
    exact = by_query(exact_top_k(vector_table(spark, rows), multiples(20), k=5))
    assert 30_000 not in got and 30_000 not in exact  # nothing else of its length
    for q in (20_000, 20_020, 20_040):
        assert [i for i, _ in got[q]] == sorted((b for a, b in scores if a == q), key=lambda b: (-scores[q, b], b))[:5]
        assert len(exact[q]) == 5 and all(i >= 20_000 for i, _ in exact[q])
    assert all(i < 20_000 for q in got if q < 20_000 for i, _ in got[q])


def test_scores_beyond_64_bits_are_refused(spark):
    table = spark.createDataFrame([(i, [3e6] * 64 if i < 2 else [1e9] * 64) for i in range(4)], "vec_id long, embedding array<double>")
    assert by_query(exact_top_k(table.filter("vec_id < 2"), multiples(1), k=1, scale=16)) == {0: [(1, 64 * 48_000_000 ** 2)], 1: [(0, 64 * 48_000_000 ** 2)]}
    with pytest.raises(Exception, match="could exceed 64 bits"):
        exact_top_k(table, multiples(1), k=1).collect()


def by_query(frame):
    out = collections.defaultdict(list)
    for r in frame.orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_block_max_is_exact(spark):
    rows = vector_rows()
    got = by_query(exact_top_k(vector_table(spark, rows), multiples(50), k=5))
    want = plain_top(rows, 50, 5, lambda v: np.floor(v * 256).astype(np.int64) @ np.floor(v * 256).astype(np.int64).T, zero=True)
    assert got == {q: [(i, int(s)) for i, s in found] for q, found in want}
    assert exact_top_k(vector_table(spark, rows).limit(0), multiples(50)).count() == 0


def test_block_bounds_hold():
    rng = np.random.default_rng(1)
    weights = rng.integers(-300, 300, (500, 9))
    index = BlockIndex(np.arange(500), weights, 16)
    query = rng.integers(-300, 300, 9)
    assert all(index.bounds(query)[b] >= (weights[a:z] @ query).max() for b, (a, z) in enumerate(index.spans))


def test_multi_index_hashing(spark):
    rows = vector_rows()
    got = by_query(hamming_search(vector_table(spark, rows), multiples(20), k=20))
    want = plain_top(rows, 20, 20, lambda v: (v[:, None, :] * v[None, :, :]).sum(axis=2), zero=False)
    hit = total = 0
    counted = collections.Counter(q for q, _ in want)
    for q, found in want:
        assert len(got[q]) in (20, 40) or counted[q] > 1
        hit += len({i for i, _ in found} & {i for i, _ in got[q]})
        total += len(found)
        assert all(i != q for i, _ in got[q])
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
    assert hit >= 0.9 * total
    assert hamming_search(vector_table(spark, rows).limit(0), multiples(20)).count() == 0


def test_recall_on_the_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = np.array([r["embedding"] for r in table.orderBy("vec_id").collect()], np.float64)
    got = by_query(hamming_search(table, multiples(20), k=20))
    scores = vectors @ vectors.T
    np.fill_diagonal(scores, -9)
    hit = sum(len({i for i, _ in got[q]} & set(np.argsort(-scores[q])[:20].tolist())) for q in range(0, len(vectors), 20))
    assert hit >= 0.9 * 20 * len(range(0, len(vectors), 20))


def test_pigeonhole_finds_every_code():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 256, (3000, 8), dtype=np.uint8)
    index = SubstringIndex(codes)
    for radius in (0, 5, 19, 24, 64):
        gaps = np.bitwise_count(codes ^ codes[7]).sum(axis=1)
        assert index.within(codes[7], radius).tolist() == np.flatnonzero(gaps <= radius).tolist()


def plain_targets(sizes, weights, most):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, capped = {}, set()
    total = sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: most * sizes[s] for s in capped} | {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mix_reaches_targets(spark):
    rng = random.Random(6)
    rows = edge_rows() + [(1000 + i, "w " * rng.randrange(0, 40), None, rng.choice(["hot"] * 5 + ["a", "b", "e", "f", "g", None])) for i in range(900)]
    got = mix_sources(edge_docs(spark, rows)).collect()
    again = mix_sources(edge_docs(spark, rows).repartition(7)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    sizes, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
    want = plain_targets(dict(sizes), (5, 2, 1), 3)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-9)
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in sizes)
    docs = edge_docs(spark, rows)
    repeated = mixed_documents(docs)
    assert repeated.columns == docs.columns
    want = collections.Counter()
    for r in got:
        want[r["doc_id"], r["source"], r["size"]] += r["copies"]
    held = collections.Counter((r["doc_id"], r["source"], len((r["text"] or "").encode().split())) for r in repeated.collect())
    assert held == +want
    assert mix_sources(edge_docs(spark).limit(0)).count() == 0


def test_mix_of_ids_shared_by_sources(spark):
    """Each source takes what its plan says, though ids are shared between sources or null."""
    rng = random.Random(12)
    sizes = {"a": 300, "b": 200, "c": 400}
    rows = [(i if i % 4 else None, " ".join(f"{s}{rng.randrange(900)}" for _ in range(rng.randrange(5, 25))), "xx", s) for s, n in sizes.items() for i in range(n)]
    words = collections.Counter()
    for r in rows:
        words[r[3]] += len(r[1].split())
    want = plain_targets(dict(words), (5, 2, 1), 3)
    taken = collections.Counter()
    for r in mixed_documents(edge_docs(spark, rows)).collect():
        taken[r["source"]] += len(r["text"].split())
    assert all(abs(taken[s] - want[s]) <= 13 for s in sizes)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(llm.QUERIES[name](spark, SF), con, llm.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(llm.QUERIES) - set(llm.ORACLES)))
def test_has_rows(spark, name):
    assert llm.QUERIES[name](spark, SF).count() > 0


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.QUERIES) == list(range(1, 14))
