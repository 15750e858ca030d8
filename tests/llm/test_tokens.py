"""Token counts, token files and packing against the tokenizer library on whole texts."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm.frames import edge_docs, edge_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.frames import FrameReader, file_system, read_frames, write_frames
from tessera.llm.packing import pack_documents, pack_histogram, slots
from tessera.llm.queries import split_pattern, tokenizer_file
from tessera.llm.tokencount import Merger, count_tokens
from tessera.llm.tokens import Chunks, Encoder

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
PARTS = [" ", "  ", "\n", "\t", " ", "\x1c", "a", "é", "É", "'s", "'", "'ll", "1", "23", "½", ",", ".", "!", "<|endoftext|>", "<|startoftext|>", "<|", "|>",
         "é", "日本", "…", "×", "ß", "_", "%%%", "-", "Ω", "Σ", "ﬁ", "\u0085", "\r\n", "aaaaaaa", "😀", "<", "|", "endoftext"]


def library(name, texts):
    return [e.ids for e in Tokenizer.from_file(tokenizer_file(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def awkward(n=3000):
    rng = random.Random(3)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)] + [None, "", "a" * 5000, "ab" * 3000, " " * 999]


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_chunks_encode_like_whole_texts(name):
    texts = awkward()
    ids, offsets = Encoder(tokenizer_file(name)).encode(pa.chunked_array([pa.array(texts, pa.string())]), 7)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [want + [7] for want in library(name, texts)]


def test_merging_counts_like_the_library():
    texts = awkward()
    chunks = Chunks(pa.chunked_array([pa.array(texts, pa.string())]))
    merger = Merger(tokenizer_file(BYTE), split_pattern())
    assert chunks.sums(merger.count_chunks(chunks.distinct)).tolist() == [len(t) for t in library(BYTE, texts)]


def test_count_tokens_edges(spark):
    docs = edge_docs(spark)
    got = collections.Counter(map(tuple, count_tokens(docs, tokenizer_file(BYTE), split_pattern()).collect()))
    rows = edge_rows()
    want = collections.Counter((d, len((t or "").encode()), len(ids), len(ids) > 512) for (d, t, *_), ids in zip(rows, library(BYTE, [r[1] for r in rows])))
    assert got == want
    assert count_tokens(docs.limit(0), tokenizer_file(BYTE), split_pattern()).count() == 0


def test_frames_round_trip(spark):
    docs, rows = edge_docs(spark), edge_rows()
    manifest = write_frames(docs, tokenizer_file(WORD), end_id=1, files=4)
    got = read_frames(manifest).orderBy("start").collect()
    want = collections.defaultdict(list)
    for (d, *_), ids in zip(rows, library(WORD, [r[1] for r in rows])):
        want[d].append(ids + [1])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    at = 0
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert (r["start"], r["n_tokens"]) == (at, len(ids))
        want[r["doc_id"]].remove(ids)
        at += len(ids)
    some = read_frames(manifest, wanted=[8, 16]).collect()
    assert {r["doc_id"]: (r["start"], bytes(r["ids"])) for r in some} == {r["doc_id"]: (r["start"], bytes(r["ids"])) for r in got if r["doc_id"] in (8, 16)}
    assert read_frames(write_frames(docs.limit(0), tokenizer_file(WORD), end_id=1, files=2)).count() == 0


def test_frames_are_independent_and_checked(spark, tmp_path):
    write_frames(edge_docs(spark), tokenizer_file(WORD), end_id=1, files=1, folder=str(tmp_path)).collect()
    path = next(tmp_path.glob("*.zst"))
    with path.open("rb") as file:
        reader = FrameReader(file)
        one = reader.document(3)
    content = bytearray(path.read_bytes())
    content[int(reader.starts[0]) + int(reader.entries[0]["compressed"]) - 1] ^= 1  # damage the first frame only
    path.write_bytes(content)
    system, name = file_system(str(path))
    with system.open_input_file(name) as file:
        reader = FrameReader(file)
        assert reader.document(3) == one
        with pytest.raises(Exception):
            reader.document(0)
    import zstandard
    assert zstandard.ZstdDecompressor().decompress(path.read_bytes()[int(reader.starts[3]):int(reader.starts[4])], max_output_size=1 << 20) == one


def packed_right(rows, documents, size):
    """Pieces cover every document once; sequences have no gaps; returns padding over tokens."""
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for doc, texts in documents.items():
        starts = collections.Counter(r["start"] for r in pieces[doc])
        for ids in texts:
            for at in range(0, len(ids), size):
                part = np.array(ids[at:at + size], "<u4").tobytes()
                found = next(r for r in pieces[doc] if r["start"] == at and r["doc_tokens"] == len(ids) and r["crc"] == zlib.crc32(part))
                assert found["length"] == len(part) // 4
                pieces[doc].remove(found)
                starts[at] -= 1
        assert not pieces[doc] and not any(starts.values())
    held = collections.defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    padding = 0
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
        padding += size - at if at & (at - 1) else 0
    assert sorted(held) == list(range(len(held)))
    return padding / sum(r["length"] for r in rows)


def test_packing_edges(spark):
    docs, rows = edge_docs(spark), edge_rows()
    documents = collections.defaultdict(list)
    for (d, *_), ids in zip(rows, library(BYTE, [r[1] for r in rows])):
        documents[d].append(ids + [0])
    packed = pack_documents(docs, tokenizer_file(BYTE), end_id=0, size=256, payload={"crc": F.crc32("ids")})
    packed_right(packed.collect(), documents, 256)
    with_ids = pack_documents(docs, tokenizer_file(BYTE), end_id=0, size=256)
    assert sum(len(r["ids"]) // 4 for r in with_ids.collect()) == sum(len(t) for ts in documents.values() for t in ts)
    assert pack_documents(docs.limit(0), tokenizer_file(BYTE), end_id=0).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_histogram_patterns_hold_every_piece(seed):
    rng = random.Random(seed)
    histogram = {length: rng.randrange(1, 500) for length in rng.sample(range(1, 129), 60)}
    patterns = pack_histogram(histogram, 128)
    held = collections.Counter()
    for count, lengths in patterns:
        assert sum(lengths) <= 128
        for length in lengths:
            held[length] += count
    assert held == collections.Counter(histogram)
    taken = collections.defaultdict(int)
    for length, first, past, repeats, _, offsets in slots(patterns):
        assert first == taken[length] and (past - first) % repeats == 0 and len(offsets) == repeats
        taken[length] = past
    assert dict(taken) == histogram
