"""Score a stream of record files with a fitted scorer."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessera.plans.records import RecordScorer


def score_files(spark: SparkSession, source: str, schema: StructType, scorer: RecordScorer,
                sink: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Read new files of ``source``, score them and append the result to ``sink``.

    Scoring keeps no state, so each file is processed once and no watermark is needed.
    """
    records = spark.readStream.schema(schema).format(fmt).load(source)
    return (scorer.apply(records).writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint).option("path", sink)
            .trigger(availableNow=True).start())
