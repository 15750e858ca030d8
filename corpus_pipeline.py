"""Pipeline from raw documents to packed sequences: identify, deduplicate, pseudonymise, mix, pack.

Each stage takes ``(spark, docs, sf_dir)`` and returns documents (the last one packed pieces); each is
written as Parquet and read again as the input of the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import stored
from tessera.llm.dartminhash import text_groups
from tessera.llm.langid import held_out, learn_profiles, predict_languages
from tessera.llm.linking import join_unique
from tessera.llm.mixture import mixed_documents
from tessera.llm.packing import pack_documents
from tessera.llm.pseudonyms import pseudonymise
from tessera.llm.queries import DEMO_KEY, tokenizer_file
from tessera.llm.substrings import NULL_ID

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def aside(docs: DataFrame, *more: Column) -> DataFrame:
    """``text`` and all other columns as one struct ``row``, so that no name of theirs meets one of an operator; and further columns."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.col("text"), *more)


def back(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``docs`` again, those named in ``new`` with new values."""
    values = {c: F.col("text") if c == "text" else F.col("row").getField(c) for c in docs.columns} | new
    return rows.select(*[values[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, ``lang`` as predicted; texts that are null, empty or without a letter go.

    Profiles are learned from labelled documents that are not held out. Without any, nothing can be predicted: ``lang`` stays
    as it is and documents with a letter stay. Rows are judged one by one, with or without an id; an empty table gives no rows.
    """
    taught = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("lang", "text")
    profiles = learn_profiles(taught)
    if not profiles:
        return back(aside(docs).filter(F.col("text").rlike(r"\p{L}")), docs)
    named = predict_languages(aside(docs), profiles).filter(F.col("lang_pred") != "und")
    return back(named, docs, lang=F.col("lang_pred"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near duplicates, that of the smallest id (null is the smallest).

    Texts are compared, whatever their ids: different texts that share an id, or have none, stay. Of rows equal in id and text one stays.
    Texts without words (null, empty) are like no other. An empty table gives no rows.
    """
    keyed = aside(docs, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64("text").alias("key"))
    groups = text_groups(docs)
    first = groups.groupBy("label").agg(F.min(F.struct("doc", "key")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    others = join_unique(groups, first, ["label"], "inner").filter(F.struct("doc", "key") != F.col("first")).select("doc", "key")
    kept = keyed.join(others, ["doc", "key"], "left_anti")
    copies = kept.groupBy("doc", "key").count().filter("count > 1").select("doc", "key")
    single = kept.join(copies, ["doc", "key"], "left_anti")
    order = W.partitionBy("doc", "key").orderBy(F.xxhash64("row", "text"))
    repeated = kept.join(copies, ["doc", "key"], "left_semi").withColumn("n", F.row_number().over(order)).filter("n = 1")
    return back(single, docs).unionByName(back(repeated, docs))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal data; ``n_chars``, where there is such a column, counts the new text.

    Null and empty texts stay as they are. Rows are taken one by one; an empty table gives no rows.
    """
    return back(pseudonymise(aside(docs), DEMO_KEY), docs, **({"n_chars": F.length("text")} if "n_chars" in docs.columns else {}))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources by name weigh 5, 2, 1 in turn, none is taken more than three times.

    A null source is one source, the last. Null and empty texts count no words. Rows equal in source, id and text are taken alike; an empty
    table gives no rows.
    """
    return mixed_documents(docs, weights=(5.0, 2.0, 1.0), share=1.0, max_repeat=3)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1,024 tokens.

    A null or empty text is its end id alone. Rows are packed one by one, repeated or not; an empty table gives no rows.
    """
    packed = pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), end_id=0, size=1024, payload={"ids_crc32": F.crc32("ids")})
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("language", language), ("near_duplicates", deduplicate), ("private", private), ("mix", mix), ("pack", pack)]

#: Language profiles, signatures and tokenizers are beyond SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
