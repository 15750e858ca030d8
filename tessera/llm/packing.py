"""Packing by shortest-pack-first over the length histogram.

Documents are cut into pieces of at most one sequence; all but the last piece of a
document fill a sequence. Lengths are placed longest first, each into the packs that are shortest
so far; packs of equal content are one pattern with a count, so the work depends
on the histogram alone. The pieces of each length are numbered, and a piece finds its
sequence and offset from its number: pattern, copy and place follow by arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import slices, stored
from tessera.llm.tokens import Encoder, binary

PIECE = "piece_id long, task int, nth long, doc_id {kind}, start long, length int, doc_tokens long, ids binary"
SLOT = "length int, first long, past long, repeats int, sequence long, offsets array<int>"


def pack_histogram(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns ``(count, lengths)`` that hold every piece of ``histogram`` (length to count) in packs of ``size``."""
    packs: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(size + 1)]  # by tokens held
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        held = 1
        while left:
            while held <= size - length and not packs[held]:
                held += 1
            if held > size - length:
                packs[length].append((left, (length,)))
                break
            count, content = packs[held].pop()
            taken = min(count, left)
            if taken < count:
                packs[held].append((count - taken, content))
            packs[held + length].append((taken, (*content, length)))
            left -= taken
    return [pack for group in packs for pack in group]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, list[int]]]:
    """For each pattern and length in it: the numbers of the pieces that go there, and where.

    Pieces ``first`` to ``past - 1`` of the length take, in turn, the ``repeats`` places at ``offsets`` of
    sequence ``sequence``, then those of the next copy.
    """
    out, numbered, sequence = [], {}, 0
    for count, lengths in patterns:
        places: dict[int, list[int]] = {}
        at = 0
        for length in lengths:
            places.setdefault(length, []).append(at)
            at += length
        for length, offsets in places.items():
            first = numbered.get(length, 0)
            numbered[length] = first + count * len(offsets)
            out.append((length, first, numbered[length], len(offsets), sequence, offsets))
        sequence += count
    return out


def cut_documents(docs: DataFrame, path: str, end_id: int, size: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encoded pieces of all documents as a stored table.

    ``task`` and ``nth`` number the pieces of a length within a task, ``ids`` are little-endian unsigned 32-bit integers.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = Encoder.of(path), TaskContext.get().partitionId()
        met, made = np.zeros(size + 1, np.int64), task << 33
        for batch in batches:
            for part in slices(batch, "text"):
                ids, offsets = encoder.encode(part["text"], end_id)
                tokens = np.diff(offsets)
                pieces = -(-tokens // size)
                owner = np.repeat(np.arange(len(tokens)), pieces)
                start = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * size
                length = np.minimum(size, tokens[owner] - start)
                order = np.argsort(length, kind="stable")
                heads = np.flatnonzero(np.r_[True, np.diff(length[order]) > 0])
                runs = np.diff(np.append(heads, len(order)))
                nth = np.empty(len(order), np.int64)
                nth[order] = np.arange(len(order)) - np.repeat(heads, runs) + met[length[order]]
                met[length[order][heads]] += runs
                bounds = np.append(offsets[owner] + start, offsets[-1])
                yield from pa.table({
                    "piece_id": made + np.arange(len(owner)), "task": np.full(len(owner), task, np.int32), "nth": nth,
                    "doc_id": part["doc_id"].take(pa.array(owner)), "start": start, "length": length.astype(np.int32),
                    "doc_tokens": tokens[owner], "ids": binary(ids, bounds)}).to_batches()
                made += len(owner)

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return stored(rows.mapInArrow(run, PIECE.format(kind=rows.schema["doc_id"].dataType.simpleString())), "pieces")


def pack_documents(docs: DataFrame, path: str, end_id: int, size: int = 1024, payload: dict[str, Column] | None = None,
                   id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces with their place: ``doc_id, start, length, doc_tokens, sequence_id, offset`` and the payload.

    ``payload`` names expressions over ``ids`` that travel with the pieces (the ids themselves
    if not given); ``path`` names the tokenizer file, and ``end_id`` follows every document. Offsets
    within a sequence have no gaps. A null or empty text is a piece of the end id alone. Rows
    that share an id are documents of their own. An empty table gives no rows. The slot
    table, which is broadcast, has at most a few rows for each length, whatever the number of documents.
    """
    pieces = cut_documents(docs, path, end_id, size, id_column, text_column)
    carried = [c.alias(name) for name, c in (payload or {"ids": F.col("ids")}).items()]
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = docs.sparkSession.createDataFrame(slots(pack_histogram(histogram, size)), SLOT)
    earlier = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    offsets = by_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = (pieces.select("length", "task", "nth", "doc_id", "start", "doc_tokens", *carried).join(offsets, ["length", "task"])
                .withColumn("number", F.col("before") + F.col("nth")))
    place = F.broadcast(places.withColumnRenamed("length", "_length"))
    found = numbered.join(place, (F.col("length") == F.col("_length")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("past")))
    turn = F.col("number") - F.col("first")
    return found.select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "doc_tokens",
        (F.col("sequence") + F.floor(turn / F.col("repeats"))).cast("long").alias("sequence_id"),
        F.get("offsets", (turn % F.col("repeats")).cast("int")).cast("long").alias("offset"),
        *[F.col(c) for c in (payload or {"ids": None})])
