"""Rank-order profiles against a plain out-of-place version, in several scripts."""

import collections
import random

import pyarrow as pa
import pytest
from llm.frames import edge_docs, edge_rows

from tessera.llm import langid
from tessera.llm.langid import Grams, Matcher, gram_code, identify_languages, learn_profiles

SPEECH = {"aa": "ka lo mi tu ra".split(), "ru": "при вет как де ла ни".split(), "zh": [chr(0x4E00 + 7 * i) for i in range(900)],
          "fr": "qu’ l'é É Ça ŒUV eau ment ïe".split(), "tr": "İs tan bul ĞI ış".split()}


def plain_grams(text, longest):
    """N-grams by the rule as stated: characters lower-cased one by one, ``_`` for what is no letter."""
    shown = [""] + [c.lower()[0] if c.isalpha() and c.lower()[0].isalpha() else "_" for c in text or ""]
    shown = ["_", *shown[1:], "_"]
    counts = collections.Counter()
    for n in range(1, longest + 1):
        for i in range(len(shown) - n + 1):
            gram = "".join(shown[i:i + n])
            if (gram[1] if n == 3 else gram.strip("_")) not in ("", "_"):
                counts[gram] += 1
    return counts


def ranked(counts, size):
    return [g for g, _ in sorted(counts.items(), key=lambda c: (-c[1], gram_code(c[0])))[:size]]


def plain_match(text, profiles, size, longest):
    own = ranked(plain_grams(text, longest), size)
    if not own or not profiles:
        return "und", 0.0
    best = None
    for lang in sorted(profiles):
        place = {g: i for i, g in enumerate(profiles[lang])}
        total = sum(abs(place[g] - i) if g in place else size for i, g in enumerate(own))
        if best is None or total < best[0]:
            best = (total, lang)
    return best[1], 1.0 - best[0] / (len(own) * size)


def speech_rows(n=250):
    rng = random.Random(14)
    return [(i, " ".join("".join(rng.choices(SPEECH[lang], k=3)) for _ in range(rng.randrange(1, 60))) + rng.choice(["", "!", " 12", " A", "\n"]), lang, "s")
            for i, lang in enumerate(rng.choices(list(SPEECH), k=n))]


@pytest.mark.parametrize("direct, known", [(128, 400_000), (8, 400_000), (128, 50)])
def test_grams_of_any_alphabet(monkeypatch, direct, known):
    monkeypatch.setattr(langid, "DIRECT", direct)
    texts = [r[1] for r in speech_rows(60)] + [None, "", "x", " ", "áb", "ßẞ", "日本", "1a2", "İİ", "\x00a"]
    grams = Grams(3)
    for at in range(0, len(texts), 20):
        part = texts[at:at + 20]
        number, owner = grams.of_texts(pa.chunked_array([pa.array(part, pa.string())]))
        got = collections.defaultdict(collections.Counter)
        for code, i in zip(grams.codes[number].tolist(), owner.tolist()):
            got[i][code] += 1
        for i, text in enumerate(part):
            assert got[i] == collections.Counter({gram_code(g): n for g, n in plain_grams(text, 3).items()})


@pytest.mark.parametrize("size, longest, cells", [(400, 3, 1 << 22), (30, 3, 1000), (20, 2, 1 << 22), (7, 1, 50)])
def test_distances_equal_the_plain_ones(spark, monkeypatch, size, longest, cells):
    monkeypatch.setattr(langid, "CELLS", cells)
    rows = speech_rows()
    counts = collections.defaultdict(collections.Counter)
    for _, text, lang, _ in rows[:150]:
        counts[lang].update(plain_grams(text, longest))
    plain = {lang: ranked(c, size) for lang, c in counts.items()}
    learned = learn_profiles(edge_docs(spark, rows[:150]).select("lang", "text"), size, longest)
    assert learned == {lang: [gram_code(g) for g in p] for lang, p in plain.items()}
    texts = [r[1] for r in rows] + [r[1] for r in edge_rows() if len(r[1] or "") < 50_000]
    lang, score = Matcher(learned, size, longest).match(pa.chunked_array([pa.array(texts, pa.string())]))
    for i, text in enumerate(texts):
        want = plain_match(text, plain, size, longest)
        assert ((sorted(plain) + ["und"])[lang[i]], score[i]) == (want[0], pytest.approx(want[1]))


def test_registered_parameters_equal_the_plain_version(spark):
    """The query's own parameters on the smallest tables, learning included."""
    import zlib

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    out = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows}
    counts = collections.defaultdict(collections.Counter)
    for r in rows:
        if r["lang"] is not None and not out[r["doc_id"]]:
            counts[r["lang"]].update(plain_grams(r["text"], 3))
    profiles = {lang: ranked(c, 400) for lang, c in counts.items()}
    got = {r["doc_id"]: r for r in identify_languages(docs).collect()}
    tested = [r for r in rows if out[r["doc_id"]]]
    for r in rows:
        lang, score = plain_match(r["text"], profiles, 400, 3)
        g = got[r["doc_id"]]
        assert (g["held_out"], g["lang_pred"], g["score"]) == (out[r["doc_id"]], lang, pytest.approx(score))
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in tested if r["lang"]) >= 0.9 * sum(r["lang"] is not None for r in tested)
