"""Language identification by rank-order profiles (Cavnar and Trenkle's out-of-place distance).

A profile is the list of the most frequent letter n-grams of padded words, most frequent first, ties by the
n-gram itself. A document takes the language whose profile is nearest to its own, ties by the language's name.
The score is 1 - distance / greatest possible distance.

Rows: null texts, and texts without a letter, are "und" with score 0, as are all if nothing was learned.
Repeated rows are judged each; other columns are carried along untouched, but ones with the names of the two new columns are
replaced. A text of any length is judged as a whole, in memory in proportion to it; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_bucket, map_by_place, ship, slices, table, tidy

SIZES = (1, 2, 3)
PROFILE = 300
#: Distinct words that a worker gathers before it passes their n-grams on.
MOST_WORDS = 200_000
#: Languages times n-grams that the driver gathers and broadcasts.
MOST_PROFILE_ROWS = 1_000_000
_LETTERS = re.compile(r"[^\W\d_]+")


def letter_words(text: str | None) -> list[str]:
    """Lower-case runs of letters."""
    if not text:
        return []
    found = _LETTERS.findall(text.lower())
    return [w for w in (w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in found) if w]


def grams_of(word: str) -> list[str]:
    padded = f"_{word}_"
    return [g for n in SIZES for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if g != "_"]


def code_of(gram: str) -> int:
    """A number for an n-gram; numbers order as the n-grams do."""
    return sum(ord(c) << 21 * (2 - i) for i, c in enumerate(gram))


def gram_counts(words: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words' n-grams, in order, and how often each occurs."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    chars = np.frombuffer(f"_{'__'.join(words)}_".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(chars))
    one, two, three = np.flatnonzero(chars != ord("_")), np.flatnonzero(left >= 2), np.flatnonzero(left >= 3)
    codes = np.concatenate([chars[one] << 42, chars[two] << 42 | chars[two + 1] << 21, chars[three] << 42 | chars[three + 1] << 21 | chars[three + 2]])
    times = np.concatenate([times[one], times[two], times[three]])
    order = np.argsort(codes)
    codes = codes[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(times[order], first)


def ranked(codes: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """Codes of the most frequent n-grams, most frequent first, ties in the order of the n-grams."""
    if len(codes) > most:
        some = counts >= np.partition(counts, len(counts) - most)[len(counts) - most]
        codes, counts = codes[some], counts[some]
    return codes[np.argsort(-counts, kind="stable")][:most]


def learn(docs: DataFrame, most: int = PROFILE) -> dict[str, list[int]]:
    """Profiles (codes of n-grams) by language from the rows whose text and lang aren't null."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def out() -> pa.RecordBatch:
            langs, codes, counts = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lang, words in held.items():
                own, n = gram_counts(words)
                langs += [lang] * len(own)
                codes.append(own)
                counts.append(n)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(codes)), pa.array(np.concatenate(counts))], names=["lang", "gram", "n"])

        for batch in batches:
            for piece in slices(batch, "text"):
                for text, lang in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    held[lang].update(letter_words(text))
                if sum(map(len, held.values())) > MOST_WORDS:
                    yield out()
        yield out()

    counted = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang").mapInArrow(tidy(run), "lang string, gram bigint, n bigint")
    summed = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.col("gram"))
    best = summed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    profiles: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for row in best.limit(MOST_PROFILE_ROWS + 1).collect():
        profiles[row.lang].append((row.place, row.gram))
    if sum(map(len, profiles.values())) > MOST_PROFILE_ROWS:
        raise ValueError(f"the profiles have more than {MOST_PROFILE_ROWS} rows")
    return {lang: [gram for _, gram in sorted(rows)] for lang, rows in sorted(profiles.items())}


class Judge:
    def __init__(self, profiles: dict[str, list[int]], most: int = PROFILE):
        self.most, self.langs = most, sorted(profiles)
        self.codes = np.array(sorted({g for profile in profiles.values() for g in profile}), np.int64)
        # each profile's place of each of these n-grams, -1 for one that it lacks; the last column is for all others
        self.ranks = np.full((len(profiles), len(self.codes) + 1), -1, np.int64)
        for row, lang in enumerate(self.langs):
            self.ranks[row, np.searchsorted(self.codes, profiles[lang])] = np.arange(len(profiles[lang]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = letter_words(text)
        if not words or not self.langs:
            return "und", 0.0
        own = ranked(*gram_counts(Counter(words)), self.most)
        at = np.searchsorted(self.codes, own)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != own] = len(self.codes)
        places = self.ranks[:, at]
        far = np.where(places < 0, self.most, np.abs(places - np.arange(len(own)))).sum(axis=1)
        best = int(np.argmin(far))
        return self.langs[best], 1 - float(far[best]) / (self.most * len(own))


def identify(docs: DataFrame, profiles: dict[str, list[int]], pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its score; lang is no input."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(profiles)
    kept = [name for name in docs.columns if name not in (pred, score)]
    docs = docs.select(*(F.col(f"`{name}`") for name in kept))
    schema, at = T.StructType([*docs.schema.fields]).add(pred, "string").add(score, "double"), kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for batch in batches:
            for piece in slices(batch, at):
                said = [judge(t) for t in piece.column(at).to_pylist()]
                columns = [*piece.columns, pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    return map_by_place(docs, tidy(run), schema)


#: The remainder of crc32(doc_id) modulo FOLDS that nothing is learned from.
FOLDS, HELD_OUT = 4, 2


def profiles_of(docs: DataFrame) -> dict[str, list[int]]:
    return learn(docs.where(id_bucket("doc_id", FOLDS) != HELD_OUT))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = identify(docs.select("doc_id", "text"), profiles_of(docs.select("doc_id", "text", "lang")))
    return judged.select("doc_id", (id_bucket("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
