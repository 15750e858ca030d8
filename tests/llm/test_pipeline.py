"""The pipeline's stages against plain versions of what they decide."""

import collections
import zlib

import numpy as np
from llm.frames import edge_docs, edge_rows
from llm.test_text import plain_groups, repeated_ids
from llm.test_tokens import BYTE, library
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tessera.llm.pseudonyms import replace

COLUMNS = "doc_id text lang source n_chars".split()


def test_stages_are_named_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "private", "mix", "pack"]


def test_stages_on_edges(spark):
    docs = edge_docs(spark).select(*COLUMNS)
    rows = edge_rows()
    kept = pipeline.language(spark, docs, "")
    assert kept.columns == COLUMNS
    lettered = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert collections.Counter((r["doc_id"], r["text"]) for r in kept.collect()) == collections.Counter((r[0], r[1]) for r in lettered)
    assert all(r["lang"] for r in kept.collect())

    single = pipeline.deduplicate(spark, kept, "").collect()
    groups, members = plain_groups([(i, r[1]) for i, r in enumerate(lettered)]), collections.defaultdict(list)
    for i, r in enumerate(lettered):
        members[groups[i]].append((r[0] is not None, r[0] or 0, r[1]))
    first = [min(m) for m in members.values()]
    assert collections.Counter((r["doc_id"], r["text"]) for r in single) == collections.Counter((i if known else None, t) for known, i, t in first)

    clean = pipeline.private(spark, docs, "").collect()
    want = collections.Counter((r[0], replace(r[1], pipeline.DEMO_KEY)[0] if r[1] else r[1]) for r in rows)
    assert collections.Counter((r["doc_id"], r["text"]) for r in clean) == want
    assert all(r["n_chars"] == len(r["text"]) for r in clean if r["text"] is not None)

    mixed = pipeline.mix(spark, docs, "")
    assert mixed.columns == COLUMNS
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_different_texts_of_null_and_repeated_ids_stay(spark):
    """One row of each group of texts; the ids decide only which row that is."""
    rows = repeated_ids()
    groups = plain_groups([(i, r[1]) for i, r in enumerate(rows)])
    want = {}
    for i, r in enumerate(rows):
        want.setdefault(groups[i], []).append((r[0] is not None, r[0] or 0, r[1]))
    got = collections.Counter((r["doc_id"], r["text"]) for r in pipeline.deduplicate(spark, edge_docs(spark, rows).select(*COLUMNS), "").collect())
    assert got == collections.Counter((rank[1] if rank[0] else None, rank[2]) for rank in map(min, want.values()))
    assert [i for i, _ in got].count(None) == 3 and [i for i, _ in got].count(31) == 2


def test_no_language_can_be_learned(spark):
    docs = edge_docs(spark).select(*COLUMNS).withColumn("lang", F.lit(None).cast("string"))
    kept = pipeline.language(spark, docs, "").collect()
    assert collections.Counter(r["text"] for r in kept) == collections.Counter(r[1] for r in edge_rows() if any(c.isalpha() for c in r[1] or ""))
    assert all(r["lang"] is None for r in kept)


def test_columns_of_any_name_pass_unchanged(spark):
    names = "score lang_pred private row text_ _id _key doc key label copies hash source_size _source n first".split()
    docs = edge_docs(spark).select(*COLUMNS).select("*", *[F.lit(f"own {n}").alias(n) for n in names], F.lit(1).alias("a.b"))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        held = out.select(*names).distinct().collect()
        assert [tuple(r) for r in held] == [tuple(f"own {n}" for n in names)], name
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.drop("n_chars"), "").count() > 0, name


def test_run_packs_what_the_stages_keep(spark, monkeypatch):
    """Row by row: the packed pieces of run() against the library on the mixed documents."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
    texts = docs.collect()
    want = collections.Counter()
    for r, ids in zip(texts, library(BYTE, [r["text"] for r in texts])):
        ids = ids + [0]
        for at in range(0, len(ids), 1024):
            want[r["doc_id"], at, min(1024, len(ids) - at), len(ids), zlib.crc32(np.array(ids[at:at + 1024], "<u4").tobytes())] += 1
    got = pipeline.run(spark, sf)
    assert collections.Counter((r["doc_id"], r["start"], r["length"], r["doc_tokens"], r["ids_crc32"]) for r in got.collect()) == want
    totals = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert totals.filter("n <> end or n > 1024").isEmpty()

