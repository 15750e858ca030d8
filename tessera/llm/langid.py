"""Language identification by rank-order profiles.

A profile is the list of the most frequent letter n-grams, by rank. A document goes to the
language whose profile is nearest by out-of-place distance: each n-gram of the
document counts how far its rank lies from its rank in the language, or the length of the
profile where the language lacks it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import byte_buffer, kept_by_worker, slices

#: Bits of a code point, and what stands for any character that is no letter.
BITS, OUTSIDE = 21, 1
#: Letters with a place in the direct table, n-grams a worker numbers before it starts anew, cells of a count matrix.
DIRECT, KNOWN_GRAMS, CELLS = 128, 400_000, 1 << 22
#: Bytes of text that are looked at together; an n-gram takes a few dozen bytes for each of them.
PART_BYTES = 1 << 20


def _lower(point: int) -> int:
    """Lower case of a character, alone; its first character where there are several."""
    return ord(chr(point).lower()[0])


def gram_code(gram: str) -> int:
    """Number of an n-gram of 1 to 3 characters, ``_`` for what is no letter."""
    code = 0
    for c in gram:
        code = code << BITS | (OUTSIDE if c == "_" else ord(c))
    return code


class Grams:
    """Letter n-grams (1 to ``longest``) of the texts a worker has met, as numbers.

    Characters are lower-cased one by one; whatever is no letter is one mark, at the ends of a text too. An n-gram holds
    a letter, a 3-gram has one in the middle. Its code is the code points side by side. Letters get small
    numbers as they are met; n-grams of the first ``DIRECT`` letters are looked up in a table, those with other
    letters (of large alphabets) by sorting their codes.
    """

    def __init__(self, longest: int):
        if not 1 <= longest <= 3:
            raise ValueError("n-grams have 1 to 3 characters")
        self.longest = longest
        self.lower = np.zeros(0x110000, np.int32)  # 0: not met yet; OUTSIDE: no letter
        self._forget()

    @classmethod
    def of(cls, longest: int) -> Grams:
        grams = kept_by_worker(("grams", longest), lambda: cls(longest))
        if len(grams.codes) > KNOWN_GRAMS:
            grams._forget()
        return grams

    def _forget(self) -> None:
        self.codes = np.zeros(0, np.int64)
        self.small = np.zeros(0x110000, np.int16)  # 0: none; letters from 2 on
        self.small[OUTSIDE] = 1
        self.letters = 2
        self.direct = np.full(DIRECT ** 3, -1, np.int32)
        self.others: dict[int, int] = {}

    def _points(self, column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """Lower-cased letters of all texts, a mark before and after each, and where each text begins (rows + 1)."""
        data, offsets = byte_buffer(column)
        try:
            points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
            before = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=before[1:])
            bounds = before[offsets]
        except UnicodeDecodeError:
            texts = [data[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(offsets.tolist(), offsets[1:].tolist())]
            points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        new = np.flatnonzero(np.bincount(points[self.lower[points] == 0])) if len(points) else []
        for point in new:
            low = _lower(int(point))
            self.lower[point] = low if chr(low).isalpha() and chr(int(point)).isalpha() else OUTSIDE
        return np.insert(self.lower[points], bounds, OUTSIDE), bounds + np.arange(len(bounds))

    def of_texts(self, column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """Number of every n-gram of the texts, end to end, and the text that holds it."""
        points, bounds = self._points(column)
        new = np.flatnonzero(np.bincount(points[self.small[points] == 0]))
        take = new[:max(0, DIRECT - self.letters)]
        self.small[take] = np.arange(self.letters, self.letters + len(take))
        self.letters += len(take)
        small, letter = self.small[points].astype(np.int32), points != OUTSIDE
        owner = np.repeat(np.arange(len(bounds)), np.diff(np.append(bounds, len(points))))
        numbers, owners = [], []
        for n in range(1, self.longest + 1):
            size = max(0, len(points) - n + 1)
            if n == 1:
                held = np.flatnonzero(letter)
            elif n == 2:
                held = np.flatnonzero(letter[:-1] | letter[1:])
            else:
                held = np.flatnonzero(letter[1:-1])
            held = held[held < size]
            index = small[held]
            rare = index == 0
            for i in range(1, n):
                step = small[held + i]
                rare |= step == 0
                index = index * DIRECT + step
            number = np.empty(len(held), np.int32)
            near = np.flatnonzero(~rare) if rare.any() else slice(None)
            number[near] = self._direct(index[near], n)
            if rare.any():
                at = held[rare]
                code = points[at].astype(np.int64)
                for i in range(1, n):
                    code = code << BITS | points[at + i]
                number[rare] = self._sorted(code)
            numbers.append(number)
            owners.append(owner[held])  # the mark before a text belongs to it
        return np.concatenate(numbers), np.concatenate(owners)

    def _direct(self, index: np.ndarray, n: int) -> np.ndarray:
        """Numbers of n-grams of letters with small numbers; an index of fewer letters has zeros in front."""
        found = self.direct[index]
        new = np.flatnonzero(np.bincount(index[found < 0])) if (found < 0).any() else np.zeros(0, np.int64)
        if len(new):
            point = np.zeros(DIRECT, np.int64)
            held = np.flatnonzero(self.small)
            point[self.small[held]] = held
            code = np.zeros(len(new), np.int64)
            for i in reversed(range(n)):
                code = code << BITS | point[new // DIRECT ** i % DIRECT]
            self.direct[new] = self._number(code)
            found = self.direct[index]
        return found

    def _sorted(self, code: np.ndarray) -> np.ndarray:
        distinct, back = np.unique(code, return_inverse=True)
        known = np.array([self.others.get(c, -1) for c in distinct.tolist()], np.int64)
        new = known < 0
        known[new] = self._number(distinct[new])
        self.others.update(zip(distinct[new].tolist(), known[new].tolist()))
        return known[back]

    def _number(self, code: np.ndarray) -> np.ndarray:
        first = len(self.codes)
        self.codes = np.concatenate([self.codes, code])
        return np.arange(first, len(self.codes))


def gram_counts(docs: DataFrame, longest: int) -> DataFrame:
    """``lang, gram, n`` over the whole texts of ``docs`` (``lang, text``); n-grams by their code."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        codes = np.zeros(0, np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, total in sums.items():
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(used), "gram": codes[used], "n": total[used]})
            sums.clear()

        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                grams = Grams.of(longest)
                if len(grams.codes) < len(codes):  # numbers begin anew
                    yield from flush()
                number, owner = grams.of_texts(part["text"])
                codes, width = grams.codes, len(grams.codes)
                langs = part["lang"].combine_chunks().dictionary_encode()
                langs = langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs
                code = langs.indices.to_numpy()[owner]
                for i, lang in enumerate(langs.dictionary.to_pylist()):
                    total = np.bincount(number[code == i], minlength=width)
                    old = sums.get(lang, np.zeros(0, np.int64))
                    total[:len(old)] += old
                    sums[lang] = total
        yield from flush()

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn_profiles(docs: DataFrame, size: int = 400, longest: int = 3) -> dict[str, list[int]]:
    """The codes of the ``size`` most frequent n-grams of each language by falling count; ``docs`` has ``lang`` (not null) and ``text``."""
    by_count = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = gram_counts(docs, longest).withColumn("rank", F.row_number().over(by_count)).filter(F.col("rank") <= size)
    profiles: dict[str, list[int]] = {}
    for r in sorted(top.select("lang", "rank", "gram").collect(), key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


class Matcher:
    """Out-of-place distances of the texts of a slice to all profiles."""

    def __init__(self, profiles: dict[str, list[int]], size: int, longest: int):
        self.langs, self.size, self.longest = sorted(profiles), size, longest
        self.profiles = profiles

    def _ranks(self, codes: np.ndarray) -> np.ndarray:
        """Rank of each n-gram (codes ascending) in each profile, ``size`` where it is absent."""
        table = np.full((len(self.langs), len(codes)), self.size, np.int64)
        for row, lang in zip(table, self.langs):
            profile = np.array(self.profiles[lang], np.int64)
            at = np.minimum(np.searchsorted(codes, profile), max(0, len(codes) - 1))
            here = codes[at] == profile if len(codes) else np.zeros(len(profile), bool)
            row[at[here]] = np.flatnonzero(here)
        return table

    def match(self, texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """Position of the nearest language (-1: no letter) and score of each text.

        The score is 1 for equal ranks throughout and 0 if no n-gram occurs in the profile. N-grams of equal count
        rank by code.
        """
        number, owner = (grams := Grams.of(self.longest)).of_texts(texts)
        rows, width = len(texts), max(1, len(grams.codes))
        order = np.argsort(grams.codes)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ranks = self._ranks(grams.codes[order])
        lang, score = np.full(rows, -1), np.zeros(rows)
        key = owner * width + place[number]
        step = max(1, CELLS // width)
        by_step = np.argsort(owner // step, kind="stable") if rows > step else np.arange(len(owner))
        bounds = np.searchsorted((owner // step)[by_step], np.arange(-(-rows // step) + 1)) if rows else []
        for n, (i, j) in enumerate(zip(bounds, bounds[1:])):
            first = n * step
            times = np.bincount(key[by_step[i:j]] - first * width) if j > i else np.zeros(0, np.int64)
            cell = np.flatnonzero(times)
            if len(cell) == 0:
                continue
            doc, times = cell // width, times[cell]
            ranked = np.argsort((doc << 40) - times, kind="stable")  # cells come by document and code
            doc, gram = doc[ranked], (cell % width)[ranked]
            heads = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            rank = np.arange(len(doc)) - np.repeat(heads, np.diff(np.append(heads, len(doc))))
            top = rank < self.size
            doc, gram, rank = doc[top], gram[top], rank[top]
            heads = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            known = ranks[:, gram]
            total = np.add.reduceat(np.where(known < self.size, np.abs(known - rank), self.size), heads, axis=1)
            lang[first + doc[heads]] = total.argmin(axis=0)
            score[first + doc[heads]] = 1.0 - total.min(axis=0) / (np.diff(np.append(heads, len(doc))) * self.size)
        return lang, score


def held_out(id_column: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 on division by 4."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % 4 == 2


def predict_languages(docs: DataFrame, profiles: dict[str, list[int]], size: int = 400, longest: int = 3, text_column: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) added; nothing but the text is looked at, and nothing is shuffled.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if no language was learned.
    Of equally near languages the first by name is taken. Texts are never cut, however long. Columns of these two names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*kept, F.col(text_column).alias("_text"))
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(profiles, size, longest)
        names = np.array([*matcher.langs, "und"], object)
        for batch in batches:
            for part in slices(batch, "_text", PART_BYTES):
                lang, score = matcher.match(part["_text"]) if matcher.langs else (np.full(part.num_rows, -1), np.zeros(part.num_rows))
                columns = [part[c] for c in kept]
                yield from pa.table([*columns, pa.array(names[lang], pa.string()), pa.array(score)], names=[*kept, "lang_pred", "score"]).to_batches()

    return rows.mapInArrow(run, schema)


def identify_languages(docs: DataFrame, size: int = 400, longest: int = 3, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: profiles learned from the labelled documents that are not held out, applied to all.

    Documents without a label teach nothing. A null id is not held out. Rows are taken one by one, an
    empty table gives no rows. The profiles, ``size`` n-grams for each language label, are
    the only thing that reaches the driver.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang"))
    taught = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    profiles = learn_profiles(taught, size, longest)
    shown = rows.select("doc_id", held_out().alias("held_out"), "text")
    return predict_languages(shown, profiles, size, longest).select("doc_id", "held_out", "lang_pred", "score")
