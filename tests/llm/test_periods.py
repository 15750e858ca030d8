"""Periodic runs against a version that tries every period at every place."""

import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.frames import edge_docs, edge_rows

from tessera.llm import queries as llm
from tessera.llm.periods import ladder, periodic_runs, repeating, run_digests, runs_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=6, exponent=4):
    """Maximal stretches of every period, without those that have a smaller one."""
    found, n = [], len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j + q - i
            if length >= max(least, exponent * q) and not any(all(words[x] == words[x + d] for x in range(start, start + length - d)) for d in range(1, q)):
                found.append((start, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words) if n < 5000 else None
    return words, runs


def plain_digest(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def listed(texts, least=6, exponent=4):
    codes = np.array([c for t in texts for c in t], np.int64)
    bounds = np.cumsum([0, *map(len, texts)])
    start, length, period = runs_of(codes, bounds, least, exponent)
    row = np.searchsorted(bounds, start, side="right") - 1
    return [[(int(s - bounds[r]), int(n), int(q)) for s, n, q, x in zip(start, length, period, row) if x == r] for r in range(len(texts))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=4), st.integers(3, 5), st.integers(1, 14))
def test_all_runs_of_short_alphabets(texts, exponent, least):
    assert listed(texts, least, exponent) == [plain_runs(t, least, exponent) for t in texts]


def test_planted_runs_of_many_periods():
    rng = random.Random(3)
    texts = []
    for q in [*range(1, 30), 57, 58, 100, 174, 175]:
        root = [rng.randrange(50) for _ in range(q)]
        turns = rng.choice([4, 4, 5, 9])
        body = list(itertools.islice(itertools.cycle(root), max(6, turns * q) + rng.randrange(q)))
        texts.append([rng.randrange(50) for _ in range(9)] + body + [rng.randrange(50) for _ in range(9)])
    nested = ([1] * 7 + [2]) * 5  # runs inside the period of a run
    texts += [nested, [5] * 3000, [1, 2] * 2 + [1], []]
    assert listed(texts) == [plain_runs(t) for t in texts]


def test_seeds_fit_every_lag():
    for least, exponent in itertools.product(range(1, 40), range(3, 7)):
        served = 0
        for k, first, last in ladder(least, exponent, 3000):
            assert first == served + 1 and last <= k
            assert all(max(least, exponent * q) - q >= k for q in range(first, last + 1))
            served = last
        assert max(least, exponent * (served + 1)) > 3000


def test_edges(spark):
    rows = edge_rows() + [(18, ("x y z " * 30).strip(), "xx", "a"), (19, " a  a\ta\na\x0ba a\x0c", "xx", "a")]
    got = sorted(map(str, (tuple(r) for r in run_digests(periodic_runs(edge_docs(spark, rows))).collect())))
    want = []
    for doc_id, text, *_ in rows:
        words = WORD.findall(text or "")
        runs = plain_runs(words) if len(words) < 5000 else []
        want.append(str((doc_id, *plain_digest(words, runs))))
    assert got == sorted(want)
    assert periodic_runs(edge_docs(spark).limit(0)).count() == 0


def test_repeating(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 50}" for j in range(i % 90)), "xx", "a") for i in range(300)] + [(7000 + i, t, "xx", "a") for i, t in enumerate([None, "", " "] * 20)]
    got = {r["doc_id"]: WORD.findall(r["text"] or "") for r in repeating(edge_docs(spark, rows)).collect()}
    changed = 0
    for doc_id, text, *_ in rows:
        words, _ = plain_row(doc_id, text)
        assert got[doc_id] == words
        changed += words != WORD.findall(text or "")
    assert changed > 15


def test_registered_query(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in llm.QUERIES["op13_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    periodic = 0
    for d in docs:
        words, runs = plain_row(d["doc_id"], d["text"])
        if runs is None:
            continue
        assert got[d["doc_id"]] == plain_digest(words, runs)
        periodic += bool(runs)
    assert periodic
