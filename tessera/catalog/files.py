"""Queries over files that Spark writes from the tables: catalogues, partitioned sinks, streams, missing columns."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.catalog.fixtures import FEATURES, KEYS, PANELS, RANGES, lab, sql, table
from tessera.catalog.records import _scratch
from tessera.operators.concepts import entity_rows
from tessera.plans.records import fit_scorer
from tessera.sources import sinks, tables
from tessera.streaming.score import score_files

_FILES = """
    SELECT doc_id, source, concat(source, '/', cast(doc_id AS varchar), '.png') AS name, octet_length(encode(text)) AS length
    FROM documents WHERE doc_id % 5 < 3 AND source IS NOT NULL"""


@query("image_catalogue", f"""
    SELECT name, length, source AS class_name, cast(dense_rank() OVER (ORDER BY source) - 1 AS int) AS label,
           row_number() OVER (ORDER BY source, name) - 1 AS image_id FROM ({_FILES})""")
def image_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Files under one folder per class, catalogued from their metadata."""
    found = tables.image_catalogue(spark, _written(spark, sf))
    return found.select(_name("path").alias("name"), "length", "class_name", "label", "image_id")


@query("patch_class_join", f"""
    WITH files AS (SELECT *, cast(dense_rank() OVER (ORDER BY source) - 1 AS int) AS label, row_number() OVER (ORDER BY source, name) - 1 AS image_id FROM ({_FILES}))
    SELECT e.vec_id, f.image_id, f.label, f.source AS class_name FROM embeddings e JOIN files f ON e.vec_id // 3 = f.image_id""")
def patch_class_join(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of vectors (three an image) get the class of their image from the catalogue."""
    images = tables.image_catalogue(spark, _written(spark, sf)).select("image_id", "label", "class_name")
    rows = table(spark, sf, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 3).alias("image_id"))
    return entity_rows(rows, images, "image_id").select("vec_id", "image_id", "label", "class_name")


def _written(spark: SparkSession, sf: str) -> str:
    """A folder with one file for each of three fifths of the documents, in a folder of its source; other files lie beside them.

    Every task writes the texts of its rows as files of the shared file system.
    """
    root = _scratch(spark)
    docs = table(spark, sf, "documents").filter("source is not null")
    end = F.when(F.col("doc_id") % 5 < 3, ".png").otherwise(".txt")
    rows = docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), end).alias("name"), F.encode("text", "UTF-8").alias("content"))
    sinks.write_files(rows, root, "name", "content")
    return root


def _name(path: str):
    return F.regexp_extract(path, r"/([^/]+/[^/]+)$", 1)


@query("partition_overwrite", """
    SELECT vec_id, label, round(cast(embedding[1] AS double) * CASE WHEN label = 3 THEN 2 ELSE 1 END, 6) AS first FROM embeddings WHERE label IN (3, 4)""")
def partition_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    """Features by class; one class is written again, which replaces its partition only, and two classes are read back."""
    path = _scratch(spark)
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("first"))
    sinks.replace_partitions(rows, path, ["label"])
    sinks.replace_partitions(rows.filter("label = 3").withColumn("first", F.col("first") * 2), path, ["label"])
    return spark.read.parquet(path).filter(F.col("label").isin(3, 4)).select("vec_id", "label", F.round("first", 6).alias("first"))


@query("assignment_sink", sql("""
    SELECT panel, cluster_id, count(*) AS n FROM (
        SELECT 'panel_a' AS panel, panel_a AS cluster_id FROM clustered UNION ALL SELECT 'panel_b', panel_b FROM clustered) GROUP BY 1, 2""", "clustered"))
def assignment_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Assignments written by panel and read back panel by panel."""
    from tessera.catalog.fixtures import clustered

    path = _scratch(spark)
    rows = clustered(spark, sf).unpivot(["record_id"], list(PANELS), "panel", "cluster_id")
    sinks.write_table(rows, path, ["panel"])
    held = spark.read.parquet(path)
    return held.groupBy("panel", "cluster_id").agg(F.count(F.lit(1)).alias("n"))


@query("score_stream", sql("SELECT record_id, cycle_year, true AS same FROM lab WHERE cycle_year >= '1996'", "lab"))
def score_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Records arrive as files in two runs of the stream; the sink holds each once, with the scores of the batch path."""
    root = _scratch(spark)
    records = lab(spark, sf).select(*KEYS, *FEATURES).persist(StorageLevel.MEMORY_AND_DISK)
    scorer = fit_scorer(records, PANELS, RANGES, 2, min_ratio=0.5, n_init=1)
    late = records.filter("cycle_year >= '1996'")
    for part in (F.col("cycle_year") < "1999", F.col("cycle_year") >= "1999"):
        late.filter(part).write.mode("append").parquet(f"{root}/in")
        score_files(spark, f"{root}/in", records.schema, scorer, f"{root}/out", f"{root}/state").awaitTermination()
    streamed = spark.read.parquet(f"{root}/out").select(*KEYS, F.col("scores").alias("streamed"))
    near = F.forall(F.zip_with("scores", "streamed", lambda a, b: F.abs(a - b) < 1e-9), lambda x: x)
    return streamed.join(scorer.apply(late).select(*KEYS, "scores"), KEYS).select(*KEYS, near.alias("same"))


@query("missing_columns", sql("""
    SELECT column_name FROM (SELECT unnest(['n_orders', 'avg_total', 'avg_tax', 'source', 'text']) AS column_name)
    WHERE column_name NOT IN (SELECT unnest(['doc_id', 'text', 'lang', 'source', 'n_chars']))"""))
def missing_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Expected columns that the document table lacks."""
    return tables.missing_columns(table(spark, sf, "documents"), ["n_orders", "avg_total", "avg_tax", "source", "text"])


@query("scoring_gaps", """
    SELECT column_name, n_missing FROM (
        SELECT 'quality' AS column_name, count(*) FILTER (quality IS NULL) AS n_missing FROM documents LEFT JOIN labels USING (doc_id)
        UNION ALL SELECT 'toxic', count(*) FILTER (toxic IS NULL) FROM documents LEFT JOIN labels USING (doc_id)
        UNION ALL SELECT 'gone', count(*) FROM documents)""")
def scoring_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Missing values of each expected column; a column that is absent misses in every row."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return tables.missing_values(rows, ["quality", "toxic", "gone"])
