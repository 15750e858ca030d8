"""Session settings, checkpointing and the size check that guards broadcasts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a local master keeps intermediate data in its warehouse; a
    cluster has to name the folder, since no other is known to be shared.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if re.match(r"local(\[|$)", spark.sparkContext.master):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder of the session."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def small_side(df: DataFrame, max_rows: int = 20_000, max_bytes: int = 64 << 20) -> DataFrame:
    """Broadcast ``df`` if it is measured to be small, else leave the join to Spark.

    The frame is evaluated once, at most ``max_rows + 1`` rows of it. Within the
    bound the rows become a local relation with a broadcast hint; beyond it the
    original frame comes back without a hint, so the join shuffles (and adaptive
    execution splits skewed keys).
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows or rows.nbytes > max_bytes:
        return df
    if rows.num_rows == 0:
        return F.broadcast(df.sparkSession.createDataFrame([], df.schema))
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
