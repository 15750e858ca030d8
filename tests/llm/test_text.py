"""Repeated windows, near duplicates, languages and pseudonyms against plain versions."""

import collections
import random

import numpy as np
import pytest
from llm.frames import edge_docs, edge_rows, words

from tessera.llm import substrings
from tessera.llm.common import mix
from tessera.llm.dartminhash import Cells, Shingles, near_duplicates, signatures
from tessera.llm.langid import identify_languages
from tessera.llm.pseudonyms import luhn_digit, pseudonym, pseudonymise, replace


def text_order(spark, rows):
    """Order of rows as the operator defines it: id (null first), then the hash of the text."""
    frame = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows)], "i long, text string")
    hashed = {r["i"]: r["h"] for r in frame.selectExpr("i", "xxhash64(text) h").collect()}
    return sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, hashed[i]))


def plain_removal(spark, rows, window):
    seen, out = {}, collections.Counter()
    for i in text_order(spark, rows):
        doc, text = rows[i][0], rows[i][1] or ""
        held = [w.decode() for w in text.encode().split()]
        gone = set()
        for s in range(len(held) - window + 1):
            key = tuple(held[s:s + window])
            if seen.setdefault(key, (doc, text, s)) != (doc, text, s):
                gone.update(range(s, s + window))
        out[doc, len(held), len(gone), " ".join(w for j, w in enumerate(held) if j not in gone)] += 1
    return out


@pytest.mark.parametrize("many", [64, 1])
def test_repeated_windows(spark, monkeypatch, many):
    monkeypatch.setattr(substrings, "MANY", many)
    rng = random.Random(11)
    line = words(rng, 13, 3000)  # a frequent line in ever new surroundings
    rows = edge_rows() + [(100 + i, f"{words(rng, 15, 3000)} {line} {words(rng, rng.randrange(3, 30), 3000)} {line}", "xx", "a") for i in range(60)]
    rows += [(300 + i, "no no yes " * rng.randrange(5, 30), "xx", "a") for i in range(10)]
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in substrings.remove_repeats(edge_docs(spark, rows)).collect())
    assert got == plain_removal(spark, rows, 20)
    assert any(r[2] for r in got)


def test_repeated_windows_of_another_length(spark):
    rows = edge_rows()
    result = substrings.remove_repeats(edge_docs(spark), window=8).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in result) == plain_removal(spark, rows, 8)
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in result)
    assert substrings.remove_repeats(edge_docs(spark).limit(0)).count() == 0


def test_texts_of_one_id_whose_short_hashes_collide(spark):
    """Two texts of id 5 with the same 32-bit hash: what repeats in one of them is not taken from the other."""
    texts = [r["t"] for r in spark.range(200_000).selectExpr("concat_ws(' ', transform(sequence(1, 31), i -> concat('w', id, 'x', i))) t", "hash(concat_ws(' ', transform(sequence(1, 31), i -> concat('w', id, 'x', i)))) h")
             .selectExpr("*", "count(*) over (partition by h) n").filter("n > 1").orderBy("h").limit(2).collect()]
    rows = [(5, texts[0], "xx", "a"), (5, texts[1], "xx", "a"), (1, texts[0], "xx", "a")]
    got = {(r["doc_id"], r["text"]): r["n_removed"] for r in substrings.remove_repeats(edge_docs(spark, rows)).collect()}
    assert got == {(5, ""): 31, (5, texts[1]): 0, (1, texts[0]): 0}


def weighted(text, size=5):
    held = (text or "").encode().split()
    if len(held) < size:
        return collections.Counter([tuple(held)] if held else [])
    return collections.Counter(tuple(held[i:i + size]) for i in range(len(held) - size + 1))


def plain_groups(rows, threshold=0.8):
    sets = [(r[0], weighted(r[1])) for r in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, left) in enumerate(sets):
        for b, right in sets[:i]:
            shared = sum((left & right).values())
            if shared and shared >= threshold * (sum(left.values()) + sum(right.values()) - shared):
                low, high = sorted((find(a), find(b)), key=lambda d: (d is not None, d or 0))
                parent[high] = low
    return {d: find(d) for d in parent}


def test_near_duplicates(spark):
    rng = random.Random(2)
    rows = edge_rows()
    origin = words(rng, 300, 5000).split()
    for i in range(80):  # a large group whose members differ from one another more than from the origin
        changed = list(origin)
        for at in rng.sample(range(300), rng.randrange(0, 9)):
            changed[at] = f"new{i}x{at}"
        rows.append((200 + i, " ".join(changed), "xx", "a"))
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(edge_docs(spark, rows)).collect()}
    assert got == plain_groups(rows)
    assert near_duplicates(edge_docs(spark).limit(0)).count() == 0


def repeated_ids():
    """Rows with null and repeated ids: near copies of one of several texts, different texts, equal rows, texts whose union is like another's."""
    rng = random.Random(21)
    a, b, c, d, e, f, half, rest = (words(rng, 60, 5000).split() for _ in range(8))

    def near(text):
        return text[:30] + ["changed"] + text[31:]

    texts = [(None, a), (None, b), (None, c), (1, near(a)), (20, d), (20, e), (21, near(e)), (5, d), (30, f), (30, f), (31, half), (31, rest), (32, half + rest), (33, near(f)), (40, near(near(d)))]
    return [(i, " ".join(t), "xx", "a") for i, t in texts]


def test_near_duplicates_of_null_and_repeated_ids(spark):
    rows = repeated_ids()
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(edge_docs(spark, rows)).collect()}
    assert got == plain_groups(rows)
    assert got[1] is None and got[20] == got[21] == got[40] == 5 and got[32] == 32 and got[31] == 31


def test_signatures_estimate_weighted_similarity():
    import pyarrow as pa

    from tessera.llm.common import Words
    rng = random.Random(9)
    base = words(rng, 400, 3000).split()
    texts = [" ".join(base), " ".join(base[:300] + words(rng, 100, 3000).split()), " ".join(base + base[:200]), "one two", "three"]
    made = signatures(Shingles(Words(pa.chunked_array([pa.array(texts)])), 5), 1024)
    for i in range(1, 5):
        a, b = weighted(texts[0]), weighted(texts[i])
        shared = sum((a & b).values())
        assert abs((made[0] == made[i]).mean() - shared / (sum(a.values()) + sum(b.values()) - shared)) < 0.06
    assert (made > 0).all()


def test_signatures_of_real_weights():
    """Agreement of coordinates estimates weighted Jaccard similarity for weights of any size; equal inputs agree whatever else is drawn with them."""
    import types

    rng = np.random.default_rng(8)
    rows = [{e: w for e, w in zip(range(60), np.exp(rng.normal(0, 2, 60)))}]
    rows += [{e: w * f for e, w in rows[0].items()} for f in (0.5, 1.7)]
    rows += [{e + (30 if e > 40 else 0): w * rng.uniform(0.6, 1.5) for e, w in rows[0].items()}, {5: 1e-3}, {5: 2e-3, 6: 3e4}, {7: 40.0, 8: 0.02}]
    names = mix(np.arange(200, dtype=np.uint64), np.full(200, 77, np.uint64))

    def made(chosen, unit):
        flat = [(names[e], w) for r in chosen for e, w in sorted(r.items())]
        held = types.SimpleNamespace(element=np.array([f[0] for f in flat], np.uint64), weight=np.array([f[1] for f in flat]), bounds=np.cumsum([0, *map(len, chosen)]))
        return signatures(held, 1024, unit)

    for unit in (1.0, 0.01):
        got = made(rows, unit)
        for i in range(len(rows)):
            for j in range(i):
                low = sum(min(w, rows[j].get(e, 0.0)) for e, w in rows[i].items())
                assert abs((got[i] == got[j]).mean() - low / (sum(rows[i].values()) + sum(rows[j].values()) - low)) < 0.06
        assert (made(rows[3:4], unit)[0] == got[3]).all()


def test_heavy_shingles_cost_few_cells():
    cells = Cells(np.arange(3, dtype=np.uint64), np.array([1.0, 1e6, 0.25]), 1.0)
    assert np.bincount(cells.at).tolist() == [1, 21, 1] and cells.whole.tolist() == [True] + [True] * 20 + [False, False]
    exact = Cells(np.zeros(40, np.uint64), 2.0 ** np.arange(40), 1.0)
    assert np.bincount(exact.at).tolist() == [max(1, i + 1) for i in range(40)] and exact.whole.all()


def test_language_identification(spark):
    rng = random.Random(4)
    speech = {"aa": "ka lo mi tu ra".split(), "bb": "sch ein der ung ich".split(), "cc": "que les eau ment ée".split()}
    rows = [(i, " ".join("".join(rng.choices(speech[lang], k=3)) for _ in range(rng.randrange(3, 80))), lang, "s")
            for i, lang in enumerate(rng.choices(list(speech), k=400))]
    rows += [(1000, None, "aa", "s"), (1001, "", "bb", "s"), (1002, "12 ... !?", "cc", "s"), (None, "kalomi turaka", None, "s"), (0, rows[0][1], rows[0][2], "s")]
    got = identify_languages(edge_docs(spark, rows), size=200).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    import zlib
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 4 == 2) for r in got)
    tested = [(r[2], by_id[r[0]]["lang_pred"]) for r in rows[:400] if by_id[r[0]]["held_out"]]
    assert len(tested) > 50 and sum(a == b for a, b in tested) >= 0.97 * len(tested)
    assert all((by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert by_id[None]["lang_pred"] == "aa" and all(0 <= r["score"] <= 1 for r in got)
    unlabelled = edge_docs(spark, [(r[0], r[1], None, r[3]) for r in rows[:5]])
    assert {r["lang_pred"] for r in identify_languages(unlabelled).collect()} == {"und"}
    assert identify_languages(unlabelled.limit(0)).count() == 0


KEY = b"test key"
VALUES = [("card", "4111 1111 1111 1111"), ("card", "4111111111111111"), ("iban", "DE89 3704 0044 0532 0130 00"), ("ssn", "078-05-1120"), ("ssn", "899-99-9999"),
          ("ip", "10.0.255.1"), ("date", "1999-12-31"), ("date", "03.04.2021"), ("date", "12/25/2020"), ("phone", "+1 (212) 555-0199"), ("phone", "+491701234567"),
          ("email", "ann.o_7@mail.example.com"), ("secret", "0123456789abcdef0123456789abcdef")]


@pytest.mark.parametrize("kind,value", VALUES)
def test_pseudonyms_keep_format_and_invert(kind, value):
    new = pseudonym(kind, value, KEY)
    assert new != value and pseudonym(kind, new, KEY, True) == value
    if kind != "ip":
        assert [(c.isdigit(), c.isalpha()) for c in new if kind != "secret"] == [(c.isdigit(), c.isalpha()) for c in value if kind != "secret"]
    assert new != pseudonym(kind, value, b"another key")
    found = replace(f"x {'token = ' if kind == 'secret' else ''}{value} y", KEY)[1]
    assert [f[0] for f in found] == [kind]


SENTENCES = [("iban", "BE68 5390 0754 7034", "pay {} EUR now"), ("iban", "BE68539007547034", "{} BIC GKCC"), ("iban", "ES91 2100 0418 4502 0005 1332", "IBAN {} BIC"),
             ("iban", "ES91 2100 0418 4502 0005 1332", "to {} BANK AG"), ("iban", "AT61 1904 3002 3457 3201", "konto {} 100 EUR"), ("iban", "NO93 8601 1117 947", "on {} OK"),
             ("date", "2021-03-04", "at {}T10:00:00Z."), ("phone", "+33 1 23 45 67 89", "tel. {}, merci"), ("phone", "+49 170 1234567", "ruf {} an"),
             ("phone", "+49 30 123456", "Tel: {}."), ("phone", "212 555 0199", "call {} today"), ("phone", "+44 (0)20 7946 0958", "call {} today"),
             ("phone", "+1 212 555 0199", "{} 4111"), ("phone", "+33 12 34 56 78 9", "au {}!")]


@pytest.mark.parametrize("kind,value,sentence", SENTENCES)
def test_values_inside_sentences(kind, value, sentence):
    text = sentence.format(value)
    new, found = replace(text, KEY)
    at = text.index(value)
    assert found == [(kind, at, at + len(value))]
    assert new == sentence.format(pseudonym(kind, value, KEY)) and replace(new, KEY, True)[0] == text


def test_phone_leaves_the_values_that_follow():
    text = "+33 1 23 45 67 89 4111 1111 1111 1111, +33 1 23 45 67 89 2024-05-01, +33 1 23 45 67 89 10.0.255.1"
    new, found = replace(text, KEY)
    assert [f[0] for f in found] == ["phone", "card", "phone", "date", "phone", "ip"] and replace(new, KEY, True)[0] == text
    assert len({text[a:b] for kind, a, b in found if kind == "phone"}) == 1
    assert replace("2021-03-04Total 2021-03-04Tx", KEY)[1] == []


def test_permutation_has_no_collisions():
    from tessera.llm.pseudonyms import permute, permute_number
    assert len({permute(f"{i:03d}", "0123456789", KEY, "t") for i in range(1000)}) == 1000
    assert sorted(permute_number(i, 777, KEY, "t") for i in range(777)) == list(range(777))


def test_equal_values_stay_linked_and_others_stay(spark):
    rows = [(1, "pay 4111 1111 1111 1111 now", "x", "s"), (2, "card:4111111111111111.", "x", "s"), (3, "4111111111111112 and 300.1.1.1 and 99.99.2020 v1.2.3", "x", "s"),
            (4, None, "x", "s"), (5, "", "x", "s"), (6, "A 4111111111111111", "x", "s"), (7, "w " * 50_000 + "a@b.example", "x", "s"), (7, "x@y@z.org,a@b.c@d.e", None, None)]
    got = collections.defaultdict(list)
    for r in pseudonymise(edge_docs(spark, rows), KEY).collect():
        got[r["doc_id"]].append(r)
    new = pseudonym("card", "4111111111111111", KEY)
    assert luhn_digit(new[:-1]) == new[-1]
    assert got[2][0]["text"] == f"card:{new}." and got[1][0]["text"].replace(" ", "") == f"pay{new}now" and got[6][0]["text"] == f"A {new}"
    assert got[3][0]["text"] == rows[2][1] and got[3][0]["private"] == []
    assert got[4][0]["text"] is None and got[5][0]["text"] == "" and got[1][0]["label"] == "la"
    assert {len(r["private"]) for r in got[7]} == {1, 2}
    assert pseudonymise(edge_docs(spark).limit(0), KEY).count() == 0
