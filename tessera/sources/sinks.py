"""Writers: every stage goes to a new path, results are upserted by key."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame


def upsert(existing: DataFrame, new: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Existing rows with those of the same key replaced by the new ones."""
    keys = [key] if isinstance(key, str) else list(key)
    kept = existing.join(new.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet sink for vectors, assignments and scores."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Parquet sink by partition: partitions that ``df`` holds rows of are replaced, all others stay.

    Rows are dealt to partitions first, so that a partition is a few files and not one for each task.
    """
    df.repartition(*partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def write_files(df: DataFrame, root: str, name: str, content: str) -> int:
    """Each row as a file ``root/<name>``, written by the task that holds it; returns the number of files.

    A file appears under its name once it is whole, so a task that runs again replaces what it wrote. ``root`` lies on a file system
    that all executors reach; a null content is an empty file.
    """
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = root if "://" in root else "file://" + root.removeprefix("file:")
        system, base = pafs.FileSystem.from_uri(place)
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folder = f"{base}/{file}".rsplit("/", 1)[0]
                system.create_dir(folder, recursive=True)
                part = f"{folder}/.{file.rsplit('/', 1)[-1]}-{os.getpid()}"
                with system.open_output_stream(part) as out:
                    out.write(data or b"")
                system.move(part, f"{base}/{file}")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    from pyspark.sql import functions as F

    return df.select(name, content).mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
