"""Token files of independent zstandard frames with a trailing seek table.

A file holds one frame per document (its ids, little-endian unsigned 32 bits), then a skippable frame
with the document ids, then a skippable frame with the seek table: for every frame before it the
compressed size, the size and the low 32 bits of the xxh64 of the content. A
reader takes the tables from the end of the file and decompresses the frames it
wants, checking each.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import scratch_path, slices, stored
from tessera.llm.tokens import Encoder

# Fixed values of the seekable zstandard format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_FOOTER, WITH_CHECKSUM = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
ENTRY = np.dtype([("compressed", "<u4"), ("size", "<u4"), ("checksum", "<u4")])
NULL_ID = -(1 << 63)


def file_system(path: str):
    """Arrow file system and path of a folder that a URI or an absolute path names."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


class FrameWriter:
    """Appends documents to an open binary stream; ``close`` adds the tables."""

    def __init__(self, stream, level: int = 3):
        import zstandard

        self.stream, self.compressor = stream, zstandard.ZstdCompressor(level=level)
        self.ids: list[int] = []
        self.entries: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, content: bytes) -> None:
        frame = self.compressor.compress(content)
        self.stream.write(frame)
        self.ids.append(NULL_ID if doc_id is None else doc_id)
        self.entries.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def close(self) -> None:
        index = np.array(self.ids, "<i8").tobytes()
        self.stream.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = np.array([*self.entries, (8 + len(index), 0, 0)], ENTRY)
        footer = struct.pack("<IBI", len(table), WITH_CHECKSUM, SEEK_FOOTER)
        self.stream.write(struct.pack("<II", SKIPPABLE_SEEK, table.nbytes + len(footer)) + table.tobytes() + footer)


class FrameReader:
    """Random access to the documents of a seekable file-like object."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2)
        file.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEK_FOOTER:
            raise ValueError("no seek table")
        file.seek(size - 9 - count * ENTRY.itemsize)
        entries = np.frombuffer(file.read(count * ENTRY.itemsize), ENTRY)
        self.entries = entries[:-1]
        starts = np.cumsum(entries["compressed"], dtype=np.int64) - entries["compressed"]
        self.starts = starts[:-1]
        file.seek(int(starts[-1]) + 8)
        self.ids = np.frombuffer(file.read(8 * len(self.entries)), "<i8")

    def document(self, i: int) -> bytes:
        """Content of the ``i``-th document; only its frame is read."""
        import zstandard

        entry = self.entries[i]
        self.file.seek(int(self.starts[i]))
        frame = self.file.read(int(entry["compressed"]))
        content = zstandard.ZstdDecompressor().decompress(frame, max_output_size=max(1, int(entry["size"])))
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != entry["checksum"]:
            raise ValueError(f"checksum of frame {i} differs")
        return content


def write_frames(docs: DataFrame, path: str, end_id: int, files: int | None = None, folder: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode and write all documents in ascending order of id; one row per file comes back.

    ``path`` names the tokenizer file; ``end_id`` follows every document. The manifest has ``part, path, docs, tokens, start``: files in
    order, and the number of ids in the files before. Files of failed attempts have other names and stay
    out of it. Ids are integers or null (first); rows of one id follow each other, each with a
    frame of its own. A null or empty text has the end id alone. An empty table makes no file.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "frames")
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        writer, encoder, tokens = None, Encoder.of(path), 0
        system, base = file_system(folder)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.zst"
        for batch in batches:
            for piece in slices(batch, "text"):
                if writer is None:
                    system.create_dir(base, recursive=True)
                    writer = FrameWriter(system.open_output_stream(f"{base}/{name}", compression=None))
                ids, offsets = encoder.encode(piece["text"], end_id)
                data = memoryview(ids.tobytes())
                for doc_id, begin, end in zip(piece["doc_id"].to_pylist(), (offsets[:-1] * 4).tolist(), (offsets[1:] * 4).tolist()):
                    writer.add(doc_id, bytes(data[begin:end]))
                tokens += len(ids)
        if writer is not None:
            writer.close()
            writer.stream.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{folder}/{name}"], "docs": [len(writer.ids)], "tokens": [tokens]})

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    ordered = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    manifest = stored(ordered.mapInArrow(write, "part int, path string, docs long, tokens long"), "frames-manifest")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_frames(manifest: DataFrame, wanted: Iterable[int] | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of the documents in the files of ``manifest``, or of the ``wanted`` ids only.

    ``start`` counts the ids of all documents before, ``ids`` is binary. Frames that are not
    asked for are neither read nor decompressed.
    """
    asked = None if wanted is None else np.array(sorted(wanted), np.int64)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist()):
                system, name = file_system(path)
                with system.open_input_file(name) as file:
                    reader = FrameReader(file)
                    lengths = reader.entries["size"].astype(np.int64) // 4
                    starts = start + np.cumsum(lengths) - lengths
                    rows = np.arange(len(reader.ids)) if asked is None else np.flatnonzero(np.isin(reader.ids, asked))
                    while len(rows):
                        some = rows[:max(1, int(np.searchsorted(np.cumsum(lengths[rows]), 1 << 20)))]
                        rows = rows[len(some):]
                        contents = [reader.document(i) for i in some]
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array(reader.ids[some], mask=reader.ids[some] == NULL_ID), "start": starts[some],
                            "n_tokens": lengths[some], "ids": pa.array(contents, pa.binary())})

    n = max(1, manifest.count())
    return (manifest.repartitionByRange(n, "part").select("path", "start")
            .mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary"))
