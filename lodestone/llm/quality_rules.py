"""Quality rules: gradient-boosted trees over document statistics, scored from flat numpy node arrays.

The trees learn from a bounded sample of labelled rows (MOST_LABELLED, those whose hashed id is smallest). They
may only fall with the share of symbols, of repeated lines and of repeated words.

Rows: null texts have no words, fail the base rule and aren't kept. Repeated rows are judged each; other columns
are not read; without labels of both kinds the base rule alone decides.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbm
from .common import ship, slices, table

#: Labelled rows that the trees learn from at most.
MOST_LABELLED = 20_000
#: Probability of good quality from which a document is kept.
KEEP_FROM = 0.5
LEAST_WORDS, MOST_REPEATED_PERCENT, SPAN = 10, 20, 5
_SYMBOLS = b"#*$%&|<>"
_UPPER, _DIGITS = bytes(range(65, 91)), b"0123456789"
_ASCII_LETTERS = bytes([*range(65, 91), *range(97, 123)])
_ENDS, _MARKS = b".!?", b"!?|@/\\^~={}[]"
_CONTINUED = bytes(range(0x80, 0xC0))
_HIGH = bytes(range(0xC0, 0x100))

FEATURES = (
    "log_words", "word_length", "symbol_share", "repeat_line_share", "repeat_word_share", "upper_share", "digit_share",
    "mark_share", "letter_share", "distinct_words", "line_words", "ends_per_word", "long_words", "top_word_share",
)
MONOTONE = {FEATURES.index("symbol_share"): -1, FEATURES.index("repeat_line_share"): -1, FEATURES.index("repeat_word_share"): -1}


def repeated_words(words: list[bytes]) -> int:
    """Words inside five-word windows that occur twice or more."""
    if len(words) < SPAN:
        return 0
    windows = list(zip(*(words[i:] for i in range(SPAN)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    first: dict[tuple, int] = {}
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    marked = set()
    for at, window in enumerate(windows):
        other = first.setdefault(window, at)
        if other != at:
            for start in (other, at):
                if start not in marked:
                    marked.add(start)
                    covered[start] += 1
                    covered[min(start + SPAN, len(words))] -= 1
    return int((np.cumsum(covered[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """Base counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the trees' features."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    count = lambda drop: len(raw) - len(raw.translate(None, drop))
    symbols, continued = count(_SYMBOLS), count(_CONTINUED)
    chars = sum(map(len, words)) - continued
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    counts = defaultdict(int)
    for word in words:
        counts[word] += 1
    some, letters = max(chars, 1), count(_ASCII_LETTERS)
    features = [
        float(np.log1p(n)), chars / max(n, 1), symbols / some, dup_lines / max(len(lines), 1), repeats / max(n, 1), count(_UPPER) / max(letters, 1),
        count(_DIGITS) / some, count(_MARKS) / some, (letters + count(_HIGH)) / some, len(counts) / max(n, 1), float(np.log1p(n / max(len(lines), 1))),
        count(_ENDS) / max(n, 1), sum(len(w) > 20 for w in counts) / max(len(counts), 1), max(counts.values(), default=0) / max(n, 1),
    ]
    return [n, chars, symbols, dup_lines, repeats], features


def labelled_features(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a bounded sample: the labelled rows whose hashed ids are smallest. Of rows that share an id
    one is learned from, of labels that share one the lower counts."""
    ship(docs.sparkSession)
    sample = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("labelled_id"), F.col("quality").cast("int").alias("quality"))
    sample = sample.orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(most).groupBy("labelled_id").agg(F.min("quality").alias("quality"))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("labelled_id")).select("text", "labelled_id", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                values = [statistics(t)[1] for t in piece.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.float64())), *piece.columns[1:]], names=["features", "labelled_id", "quality"])

    found = rows.mapInArrow(run, "features array<double>, labelled_id bigint, quality int").groupBy("labelled_id", "quality").agg(F.min("features").alias("features"))
    found = found.orderBy("labelled_id").collect()
    return np.array([r.features for r in found]).reshape(-1, len(FEATURES)), np.array([float(r.quality) for r in found])


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> gbm.Trees | None:
    rows, quality = labelled_features(docs, labels, most)
    if not len(quality) or quality.min() == quality.max():
        return None
    return gbm.fit(rows, quality, monotone=MONOTONE)


def judge(docs: DataFrame, model: gbm.Trees | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, kept and quality (the trees' probability; null without trees)."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            for piece in slices(batch, "text"):
                both = [statistics(t) for t in piece.column(1).to_pylist()]
                counts = np.array([b[0] for b in both], dtype=np.int64).reshape(-1, 5)
                failed = (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED_PERCENT * counts[:, 0])
                p = trees.probability(np.array([b[1] for b in both])) if trees else np.full(len(both), np.nan)
                kept = ~failed & (p >= keep_from if trees else True)
                quality = pa.array(p, mask=np.isnan(p))
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(counts[:, i]) for i in range(5)), pa.array(failed), pa.array(kept), quality], names=names)

    kinds = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, quality double"
    return docs.select("doc_id", "text").mapInArrow(run, kinds)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))
