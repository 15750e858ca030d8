"""Cross-tokenizer alignment against the libraries on whole texts."""

import collections
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from llm.frames import edge_docs, edge_rows
from tokenizers import Tokenizer

from tessera.llm import queries as llm
from tessera.llm.alignment import Aligner, align_tokens, linked_pairs, token_groups

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(sorted(set(range(256)) - set(shown)))}

    def groups(text):
        if not text:
            return []
        a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        sides = []
        for ids, spell in ((a_ids, lambda i: bytes(byte_of[c] for c in a.id_to_token(i))),
                           (b_ids, lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())):
            pieces = [spell(i) for i in ids]
            if b"".join(pieces) != (" " + text).encode():
                return []
            ends, at = [], 0
            for p in pieces:
                at += len(p)
                ends.append(at)
            sides.append((ids, ends))
        out, i, j = [], 0, 0
        for end in sorted(set(sides[0][1]) & set(sides[1][1])):
            i2, j2 = sides[0][1].index(end, i) + 1, sides[1][1].index(end, j) + 1
            out.append((sides[0][0][i:i2], sides[1][0][j:j2]))
            i, j = i2, j2
        return out

    return groups


def written(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


def plain_rows(rows, groups):
    """All rows of ``align_tokens`` and the counts of pairs."""
    found = [(doc_id, groups(text)) for doc_id, text in rows]
    counts = collections.Counter()
    for _, gs in found:
        counts.update({(x, y) for a, b in gs for x in a for y in b})
    best = collections.Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, gs in found:
        links = [counts[x, y] == best[x] for a, b in gs for x in a for y in b]
        total = sum(counts[x, y] for a, b in gs for x in a for y in b)
        out.append((doc_id, sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), len(links), sum(links), total,
                    hashlib.sha256(written(gs).encode()).hexdigest() if gs else ""))
    return sorted(out, key=str), counts


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["▁x", "a ▁ b", "a  b   c ", "  lead", "trail  ", "  b", "a   b", "é é", "x\x00y", "日本語 テキスト 日本", "tab\tand\r\nline\n\n end", "<s> </s> <unk> <0x41> <|endoftext|>",
       "don't we'll I'M", "ﬁ ① ½", "👩‍👩‍👧 🇫🇷", "a　 b", "Ünïcödé l’été", " ", "\n", "1234567890 " * 30, "a.b,c;d (e) [f] {g}"]


def test_windows_equal_whole_texts(plain):
    import pyarrow as pa

    rng = random.Random(9)
    alphabet = ["a", "the", " ", "  ", "\n", "é", "日", "'s", "!", " ", "ing", "X", "7", "👍", "\t"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(600)] + [None, ""]
    aligner = Aligner(A_PATH, B_PATH)
    for _ in range(2):  # the second time from what is remembered
        found = aligner.align(pa.chunked_array([pa.array(texts, pa.string())]))
        assert [t.decode() for t in found.texts()] == [written(plain(t)) for t in texts]
        assert found.sums("groups").tolist() == [len(plain(t)) for t in texts]
    assert aligner.align(pa.chunked_array([pa.array([None], pa.string())])).n_a.tolist() == [0]


def test_edges(spark, plain):
    rows = [(r[0], r[1]) for r in edge_rows() if len(r[1] or "") < 100_000] + [(100 + i, t) for i, t in enumerate(ODD)]
    docs = edge_docs(spark, [(*r, "xx", "a") for r in rows])
    want, counts = plain_rows(rows, plain)
    assert sorted((tuple(r) for r in align_tokens(docs, A_PATH, B_PATH).select(*COLUMNS).collect()), key=str) == want
    assert {(r["a_id"], r["b_id"]): r["count"] for r in linked_pairs(docs, A_PATH, B_PATH).collect()} == counts
    assert sorted((r["doc_id"] is None, r["doc_id"], r["groups"]) for r in token_groups(docs.filter("doc_id > 99"), A_PATH, B_PATH).collect()) == [
        (False, 100 + i, written(plain(t))) for i, t in enumerate(ODD)]
    assert align_tokens(edge_docs(spark).limit(0), A_PATH, B_PATH).count() == 0


def test_registered_query(spark, plain):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want, _ = plain_rows([tuple(d) for d in docs], plain)
    got = llm.QUERIES["op11_token_alignment"](spark, sf)
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
