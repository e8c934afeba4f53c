"""Quality classifier by co-training.

Two naive-Bayes classifiers look at a document: one at its text (hashed words and word shapes), one at its
metadata (source, lang, length class). They start from a bounded sample of labelled rows. In each round both judge
every other document, and a document on which one is confident becomes a pseudo-labelled row of the other. The counts
that a classifier consists of are sums over documents, so rounds run over the whole corpus without moving a text:
features are written once, as numbers, to the folder of spark.checkpoint.dir and read again in each round.
Each view's margin is calibrated on labelled rows by classifiers that did not learn from them, and a logistic curve
over both views' log odds combines them.

A view's margin is a signed power mean of its features' log odds, so a few strong features outweigh many weak ones in
texts of all lengths alike. Two targets are learned: good quality and toxic content. A document is kept if it is more
likely good, and not more likely toxic, than the thresholds that set the labelled rows best apart.

Rows: null texts count as empty, null metadata as a value of its own. Repeated rows are judged each; of rows that
share a labelled id one is learned from, of labels that share one the lower quality and the higher toxicity. Other
columns are not read; without labels of both kinds a target's probability is that of its labels (0.5 without any).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbm, words
from .common import ship, slices, table, written

TARGETS = ("quality", "toxic")
TEXT_SIZE, META_SIZE = 1 << 18, 1 << 10
#: Documents that a feature must have to count, and how many halve its weight.
LEAST, HALF = 2, 5
#: Order of the power mean.
POWER = 4
#: Labelled rows that are learned from at most, rounds, and the probabilities from which a view is confident.
MOST_LABELLED, ROUNDS, SURE = 20_000, 2, 0.95
#: Parts of the labelled rows, each of which is judged by what the others teach.
FOLDS = 4
#: Words whose feature numbers a worker remembers.
MOST_KNOWN = 300_000
_TRIM = b".,;:!?\"'()[]"
_LETTERS = bytes.maketrans(bytes([*range(65, 91), *range(97, 123), *range(48, 58)]), b"A" * 26 + b"a" * 26 + b"9" * 10)
_RUNS = re.compile(rb"(.)\1+", re.S)


class Known(dict):
    """Feature numbers of words; remembers those of the first words that it is asked for."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        shape = _RUNS.sub(rb"\1", word.translate(_LETTERS))
        trimmed = word.strip(_TRIM).lower()
        ids = zlib.crc32(b"w" + trimmed) % TEXT_SIZE, zlib.crc32(b"s" + shape[-6:]) % TEXT_SIZE
        if len(self) < MOST_KNOWN:
            self[word] = ids
        return ids


def text_features(texts: pa.Array, known: Known) -> pa.ListArray:
    """Distinct feature numbers of each text's words, in order."""
    raw, offsets = words.bytes_of(texts)
    starts, ends = words.edges(raw, offsets)
    _, first, place = np.unique(words.hashes(raw, starts, ends), return_index=True, return_inverse=True)
    found = [known[raw[a:b]] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    ids = np.array(found, np.int64).reshape(-1, 2)[place]
    row = np.searchsorted(offsets, starts, side="right") - 1
    # the last text that starts at a place is the one that the word is in
    lines = [[line for line in raw[a:b].split(b"\n") if line.strip()] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    repeated = [min(8, 10 * (len(x) - len(set(x))) // max(1, len(x))) for x in lines]
    own = np.array([zlib.crc32(b"d%d" % n) % TEXT_SIZE for n in repeated], np.int64)
    keys = np.sort(np.concatenate([(row << 32) + ids[:, 0], (row << 32) + ids[:, 1], (np.arange(len(own)) << 32) + own]))
    keys = keys[np.flatnonzero(np.diff(keys, prepend=-1))]
    sizes = np.bincount(keys >> 32, minlength=len(own))
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array((keys & 0xFFFFFFFF).astype(np.int32)))


def meta_features(source: str | None, lang: str | None, chars: int | None) -> list[int]:
    values = (f"s{source}", f"l{lang}", f"n{int(np.log2(chars + 1)) if chars is not None and chars >= 0 else None}")
    return [zlib.crc32(v.encode("utf-8", "surrogatepass")) % META_SIZE for v in values]


def features(docs: DataFrame) -> DataFrame:
    """doc_id with the feature numbers of both views, text and meta."""
    ship(docs.sparkSession)
    kinds = {"doc_id": "bigint", "text": "string", "source": "string", "lang": "string", "n_chars": "bigint"}
    docs = docs.select(*((F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for batch in batches:
            for piece in slices(batch, "text"):
                meta = [meta_features(*row) for row in zip(*(piece.column(c).to_pylist() for c in ("source", "lang", "n_chars")), strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(0), text_features(piece.column(1), known), pa.array(meta, pa.list_(pa.int32()))], names=["doc_id", "text", "meta"])

    return docs.mapInArrow(run, "doc_id bigint, text array<int>, meta array<int>")


class Lists:
    """Lists of feature numbers as one array; no list is empty."""

    def __init__(self, column: pa.ListArray):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        offsets = np.asarray(column.offsets, np.int64)
        self.flat = np.asarray(column.values)[offsets[0] : offsets[-1]]
        self.starts, self.sizes = offsets[:-1] - offsets[0], np.diff(offsets)

    def counts(self, rows: np.ndarray, size: int) -> np.ndarray:
        """Lists with each feature among these rows (a mask), and their number as the last entry."""
        return np.append(np.bincount(self.flat[np.repeat(rows, self.sizes)], minlength=size), rows.sum())


class View:
    """Documents per class that have a feature, and the log odds that follow. Counts: (targets, classes, size + 1);
    the last number is that of all documents."""

    def __init__(self, counts: np.ndarray):
        documents = counts[:, :, -1:]
        share = (counts[:, :, :-1] + 0.5) / (documents + 1)
        odds = np.log(share[:, 1]) - np.log(share[:, 0])
        # a feature of few documents says little
        seen = counts[:, :, :-1].sum(axis=1)
        odds *= np.where(seen < LEAST, 0, seen / (seen + HALF))
        self.weight = (np.sign(odds) * np.abs(odds) ** POWER).astype(np.float32)

    def margins(self, lists: Lists) -> np.ndarray:
        """(rows, targets)."""
        if not len(lists.starts):
            return np.zeros((0, len(TARGETS)))
        sums = np.stack([np.add.reduceat(weight[lists.flat].astype(float), lists.starts) for weight in self.weight], axis=1)
        sums /= np.sqrt(lists.sizes)[:, None]
        return np.sign(sums) * np.abs(sums) ** (1 / POWER)


class Labelled:
    """The labelled rows that are learned from, on the driver: at most as many as the sample."""

    def __init__(self, rows: pa.Table):
        self.lists = [Lists(rows.column(c)) for c in ("text", "meta")]
        self.ids = np.asarray(rows.column("labelled_id"), np.int64)
        self.fold = np.array([zlib.crc32(str(i).encode()) % FOLDS for i in self.ids], np.int64)
        # -1 for a label that is neither 0 nor 1
        self.said = np.stack([np.asarray(rows.column(t).fill_null(-1), np.int64) for t in TARGETS]) if len(rows) else np.zeros((2, 0), np.int64)

    def counts(self, rows: np.ndarray) -> list[np.ndarray]:
        """Of both views, over these rows (a mask)."""
        sizes = (TEXT_SIZE, META_SIZE)
        return [np.array([[lists.counts(rows & (said == kind), size) for kind in (0, 1)] for said in self.said], float) for lists, size in zip(self.lists, sizes, strict=True)]

    def learned(self, taught: list[np.ndarray]) -> tuple[tuple[View, View], np.ndarray]:
        """The views that follow from all rows and pseudo-labels, and the margins of each row (views, rows, targets) by
        views that follow from the other folds and pseudo-labels."""
        every = np.ones(len(self.ids), bool)
        whole = self.counts(every)
        margins = np.zeros((2, len(self.ids), len(TARGETS)))
        for fold in range(FOLDS):
            rows = self.fold == fold
            if rows.any():
                own = self.counts(rows)
                for view in (0, 1):
                    rest = whole[view] - own[view]
                    margins[view, rows] = View(rest + _weighted(rest, taught[view])).margins(self.lists[view])[rows]
        return tuple(View(own + _weighted(own, more)) for own, more in zip(whole, taught, strict=True)), margins

    def scales(self, margins: np.ndarray) -> np.ndarray:
        """(views, targets, slope and intercept)."""
        out = np.zeros((2, len(TARGETS), 2))
        for target, said in enumerate(self.said):
            some = said >= 0
            for view in (0, 1):
                out[view, target] = gbm.calibrate(margins[view, some, target], said[some])
                if some.any() and (said[some] == said[some][0]).all():
                    # labels of one kind: their share is all that is known
                    out[view, target] = 0, np.log((said[some].sum() + 1) / ((1 - said[some]).sum() + 1))
        return out

    def mixture(self, odds: np.ndarray) -> np.ndarray:
        """(targets, a weight for each view and an intercept) that combine the views' log odds."""
        out = np.zeros((len(TARGETS), 3))
        for target, said in enumerate(self.said):
            some = said >= 0
            out[target] = gbm.logistic(odds[:, some, target].T, said[some])
            if some.any() and (said[some] == said[some][0]).all():
                # both views give the labels' share
                out[target] = 0.5, 0.5, 0
        return out

    def limits(self, p: np.ndarray) -> list[float]:
        """Per target the threshold with the fewest errors on the labelled rows."""
        out = []
        for target, said in enumerate(self.said):
            some = said >= 0
            label = said[some].astype(float)
            if not some.any() or label.min() == label.max():
                out.append(0.5)
                continue
            order = np.argsort(p[some, target], kind="stable")
            ranked, label = p[some, target][order], label[order]
            missed, alarms = np.cumsum(label), (1 - label).sum() - np.cumsum(1 - label)
            best = int(np.argmin(missed + alarms))
            out.append(float((ranked[best] + ranked[min(best + 1, len(ranked) - 1)]) / 2))
        return out


def _weighted(own: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Pseudo-labels of a class count no more than the labelled rows of it do."""
    return more * np.minimum(1, own[:, :, -1:] / np.maximum(more[:, :, -1:], 1))


_COUNTS = "view int, target int, class int, feature int, n bigint"


def _rows(counts: list[np.ndarray]) -> pa.RecordBatch:
    parts = []
    for view, own in enumerate(counts):
        target, kind, feature = np.nonzero(own)
        parts.append(np.stack([np.full(len(target), view), target, kind, feature, own[target, kind, feature]]))
    whole = np.concatenate(parts, axis=1).astype(np.int64)
    return pa.RecordBatch.from_arrays([*(pa.array(whole[i], pa.int32()) for i in range(4)), pa.array(whole[4])], names=["view", "target", "class", "feature", "n"])


def _none() -> list[np.ndarray]:
    return [np.zeros((len(TARGETS), 2, size + 1)) for size in (TEXT_SIZE, META_SIZE)]


def _sum(rows: DataFrame) -> list[np.ndarray]:
    """Feature counts of both views; the driver gets as many rows as the views have features, times four."""
    out = _none()
    found = rows.groupBy("view", "target", "class", "feature").agg(F.sum("n").alias("n")).toArrow()
    view, target, kind, feature, n = (np.asarray(found.column(c)) for c in ("view", "target", "class", "feature", "n"))
    for number, counts in enumerate(out):
        own = view == number
        counts[target[own], kind[own], feature[own]] = n[own]
    return out


def _odds(margins: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """Calibrated log odds of each view (views, rows, targets)."""
    return np.clip(scales[:, None, :, 0] * margins + scales[:, None, :, 1], -30, 30)


def _chance(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _combined(margins: np.ndarray, scales: np.ndarray, mixture: np.ndarray) -> np.ndarray:
    """Probability per target from the calibrated log odds of both views."""
    odds = _odds(margins, scales)
    return _chance(mixture[:, 0] * odds[0] + mixture[:, 1] * odds[1] + mixture[:, 2])


def _both(views: tuple[View, View], batch: pa.RecordBatch) -> tuple[list[Lists], np.ndarray]:
    lists = [Lists(batch.column(1)), Lists(batch.column(2))]
    return lists, np.stack([view.margins(own) for view, own in zip(views, lists, strict=True)])


def train(featured: DataFrame, labels: DataFrame, rounds: int = ROUNDS, most: int = MOST_LABELLED) -> dict:
    """featured: what features() gives, best as written() leaves it, as each round reads it."""
    spark = featured.sparkSession
    ship(spark)
    said = [F.col(t).cast("int") for t in TARGETS]
    said = [F.when(c.isin(0, 1), c) for c in said]
    some = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("labelled_id"), *(c.alias(t) for c, t in zip(said, TARGETS, strict=True)))
    some = some.orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(most).groupBy("labelled_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    own = featured.join(F.broadcast(some), F.col("doc_id") == F.col("labelled_id"))
    own = own.groupBy("labelled_id", *TARGETS).agg(F.min(F.struct("text", "meta")).alias("row"))
    labelled = Labelled(own.select("labelled_id", *TARGETS, "row.text", "row.meta").orderBy("labelled_id").toArrow())
    taught, held = _none(), np.sort(labelled.ids)
    history = []
    for number in range(rounds + 1):
        views, margins = labelled.learned(taught)
        scales = labelled.scales(margins)
        mixture = labelled.mixture(_odds(margins, scales))
        p = _combined(margins, scales, mixture)
        history.append({"margins": margins, "p": p, "taught": [t[:, :, -1].copy() for t in taught]})
        if number == rounds:
            break
        shared = spark.sparkContext.broadcast((views, scales, held))

        def teach(batches, shared=shared):
            views, scales, held = shared.value
            out = _none()
            for batch in batches:
                for start in range(0, batch.num_rows, 2_000):
                    piece = batch.slice(start, 2_000)
                    ids = np.asarray(piece.column(0).fill_null(-1), np.int64)
                    new = ~np.isin(ids, held) | np.asarray(piece.column(0).is_null())
                    lists, margins = _both(views, piece)
                    p = _chance(_odds(margins, scales))
                    # each view's confident label goes to the other
                    for view in (0, 1):
                        for target in range(len(TARGETS)):
                            for kind in (0, 1):
                                sure = p[view, :, target] if kind else 1 - p[view, :, target]
                                out[1 - view][target, kind] += lists[1 - view].counts(new & (sure >= SURE), (TEXT_SIZE, META_SIZE)[1 - view])
            yield _rows(out)

        taught = _sum(featured.mapInArrow(teach, _COUNTS))
    return {"views": views, "scales": scales, "mixture": mixture, "limits": labelled.limits(p), "history": history, "said": labelled.said}


def judge(featured: DataFrame, model: dict) -> DataFrame:
    """Per row: doc_id, p_quality, p_toxic, the views' own probabilities of quality, and kept."""
    spark = featured.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast({k: model[k] for k in ("views", "scales", "mixture", "limits")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views, scales, mixture, limits = (shared.value[k] for k in ("views", "scales", "mixture", "limits"))
        for batch in batches:
            for start in range(0, batch.num_rows, 2_000):
                piece = batch.slice(start, 2_000)
                _, margins = _both(views, piece)
                p = _combined(margins, scales, mixture)
                single = _chance(_odds(margins, scales))[:, :, 0]
                kept = (p[:, 0] > limits[0]) & (p[:, 1] <= limits[1])
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(x) for x in (p[:, 0], p[:, 1], *single, kept))], names=["doc_id", "p_quality", "p_toxic", "p_text", "p_meta", "kept"])

    return featured.mapInArrow(run, "doc_id bigint, p_quality double, p_toxic double, p_text double, p_meta double, kept boolean")


def op3_cotraining(spark, sf_dir: str) -> DataFrame:
    featured = written(features(table(spark, sf_dir, "documents")))
    return judge(featured, train(featured, table(spark, sf_dir, "labels")))
