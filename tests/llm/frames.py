"""Small hand-made tables with every awkward case, shared by the operator tests."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, hash string, start string, spans string, "
          "private string, score string, row int, bucket string, label string, rank int, copies string")


def words(rng, n, vocabulary=400):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(vocabulary)}" for _ in range(n))


def edge_rows():
    """(doc_id, text, lang, source) with nulls, empty and very long texts, copies, near copies, repeated rows and ids."""
    rng = random.Random(5)
    base = words(rng, 120).split()
    near = base[:60] + ["changed"] + base[61:]
    passage = words(rng, 45)
    rows = [
        (1, " ".join(base), "xx", "b"), (2, " ".join(near), "xx", "b"), (3, " ".join(base), "yy", "a"),
        (4, None, "xx", "a"), (5, "", "yy", None), (6, " \t\n ", "yy", "a"), (7, "... 12 !!", None, "c"),
        (8, f"{words(rng, 30)} {passage} {words(rng, 30)}", "xx", "c"), (9, f"{words(rng, 10)} {passage}", "yy", "c"),
        (10, words(rng, 30_000), "xx", "a"), (11, "one two", "yy", "b"), (12, "one two", "yy", "b"),
        (13, words(rng, 50), "xx", "b"), (13, words(rng, 50), "xx", "b"),
        (14, words(rng, 25), "yy", "a"), (14, words(rng, 25), "yy", "a"),
        (None, words(rng, 40), None, "a"), (15, "l'été <|endoftext|> d'Éa 日本語   x́ don't", "xx", "a"),
        (16, "a" * 20_000, "xx", "c"), (17, ("again and again " * 40).strip(), "xx", "c"), (-3, words(rng, 22) + "\x1c" + words(rng, 22), "yy", "a")]
    rows[15] = rows[14]  # a row that is repeated in full
    return rows


def edge_docs(spark, rows=None):
    """The rows with further columns whose names operators use inside."""
    held = edge_rows() if rows is None else rows
    return spark.createDataFrame([(*r, len(r[1] or ""), -1, "h", "s", "sp", "p", "sc", 1, "bu", "la", 2, "co") for r in held], SCHEMA).repartition(3)
