"""Toxicity by compression distance: windows of a text are compressed with a zstandard dictionary of ordinary text and
with one that toxic text is added to, and the lengths are compared.

Windows are runs of words of about WINDOW bytes, A-Z lower-cased. Both compressors share a dictionary trained on windows
of ordinary text; the toxic one also has a dictionary trained on toxic pieces, so what is ordinary costs the same in both
and a window's gain is what the toxic pieces save. Labels are of whole texts, so the pieces are found first:
dictionaries of one half of the toxic texts propose the words that save bytes in windows of the other half, and words that
do so in a much larger share of toxic than of ordinary texts are kept. The gains of a text's best windows and the number of its
windows become a score by a logistic curve that is fitted on whole texts which no dictionary was trained on, and moved so that 0.5 is
where F1 is highest on them.

All that is learned comes from a bounded sample: labelled rows whose hashed ids are smallest, MOST_TOXIC and MOST_ORDINARY
of them, at most WINDOWS_EACH windows of each, spread evenly over the whole text, for the dictionaries. Scores take all
windows of a text.

Rows: null and empty texts have no windows. They, like all texts without a gain, get the curve's value, but no more than the
toxic share of the labels. Words longer than a window are
cut into several, so texts of any length and without spaces are scored as a whole. Repeated rows are scored each; other
columns are not read; an empty table gives an empty result. Without labels of both kinds every score is the toxic share of
the labels seen (0 without any). Of labels that share an id the higher counts, of rows that share one the least text is learned from.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import gbm
from .common import id_bucket, ship, slices, table

#: Bytes of a window, of the dictionary of ordinary text, of those that propose pieces and of that of toxic pieces.
WINDOW, ORDINARY, BROAD, TOXIC = 64, 49_152, 32_768, 2_048
LEVEL = 10
#: Labelled texts of each kind that are learned from at most, and windows of each.
MOST_TOXIC, MOST_ORDINARY, WINDOWS_EACH = 2_000, 4_000, 200
#: Rounds of proposals; best windows of a text that are looked into; bytes from which a saving counts.
ROUNDS, BEST, SAVED = 3, 12, 2
#: A piece must save bytes in this share of toxic texts, and in so many times the share of ordinary ones.
LEAST_SHARE, LEAST_RATIO = 0.01, 8
#: Of so many labelled texts one goes to the curve and not to the dictionaries.
CALIBRATE = 4


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """Runs of words, about size bytes each, with a space on either side."""
    if not text:
        return []
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if max(map(len, words), default=0) > size:
        words = [word[i : i + size] for word in words for i in range(0, len(word), size)]
    if not words:
        return []
    place = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) // size
    edges = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(words)]
    return [b" %b " % b" ".join(words[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary of at most size bytes, trained on samples; their text itself where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Lengths:
    """Compressed lengths of windows under a dictionary."""

    def __init__(self, raw: bytes):
        self.raw = raw
        words = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=LEVEL)
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def __call__(self, some: list[bytes]) -> np.ndarray:
        return np.fromiter((len(self.compress(w)) for w in some), np.int64, len(some))


def savers(window: bytes, gain: int, plain: Lengths, toxic: Lengths) -> set[bytes]:
    """Words without which the window's gain falls by SAVED bytes or more."""
    words, out = window.split(), set()
    for i, word in enumerate(words):
        rest = [b" %b " % b" ".join(words[:i] + words[i + 1 :])]
        if gain - int(plain(rest)[0] - toxic(rest)[0]) >= SAVED:
            out.add(word)
    return out


def toxic_pieces(toxic: list[list[bytes]], ordinary: list[list[bytes]], base: bytes, seed: int = 1) -> dict[bytes, int]:
    """Pieces kept and in how many toxic texts they save bytes. toxic, ordinary: the windows of each text."""
    rng = np.random.default_rng(seed)
    plain = Lengths(base)
    kinds = [(texts, [plain(t) for t in texts], defaultdict(set)) for texts in (toxic, ordinary)]
    kept: dict[bytes, int] = {}
    for _ in range(ROUNDS):
        for half in (0, 1):
            known = [w for t in toxic[1 - half :: 2] for w in t]
            drawn = [known[i] for i in rng.permutation(len(known))[: 20 * BROAD // WINDOW]]
            proposer = Lengths(trained([*drawn, *[b" %b " % b" ".join(sorted(kept))] * 20], BROAD) + base)
            for texts, lengths, found in kinds:
                for i in range(half, len(texts), 2):
                    gains = lengths[i] - proposer(texts[i])
                    for j in np.argsort(-gains, kind="stable")[:BEST]:
                        if gains[j] < SAVED:
                            break
                        for word in savers(texts[i][j], int(gains[j]), plain, proposer):
                            found[word].add(i)
        said, other = kinds[0][2], kinds[1][2]
        share = {word: len(texts) / len(toxic) for word, texts in said.items()}
        kept = {w: len(said[w]) for w, s in share.items() if len(said[w]) > 1 and s >= LEAST_SHARE and s >= LEAST_RATIO * (len(other[w]) + 1) / (len(ordinary) + 1)}
    return kept


class Model:
    """The dictionaries and the curve; share stands in where nothing could be learned."""

    def __init__(self, share: float, base: bytes = b"", added: bytes = b"", curve: np.ndarray | None = None):
        self.share, self.base, self.added, self.curve = share, base, added, curve

    def compressors(self) -> tuple[Lengths, Lengths] | None:
        return (Lengths(self.base), Lengths(self.added + self.base)) if self.added else None

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.full(len(rows), self.share)
        p = 1 / (1 + np.exp(-np.clip(rows @ self.curve[:-1] + self.curve[-1], -30, 30)))
        return np.where(rows[:, 0] > 0, p, np.minimum(p, self.share))


def gains(text: str | None, compressors: tuple[Lengths, Lengths] | None) -> list[float]:
    """The largest and second largest gain of a window, and the logarithm of the number of windows."""
    cut = windows(text)
    if not cut or compressors is None:
        return [0.0, 0.0, float(np.log1p(len(cut)))]
    plain, toxic = compressors
    found = np.maximum(plain(cut) - toxic(cut), 0)
    best = np.sort(found)[-2:]
    return [float(best[-1]), float(best[-2]) if len(best) > 1 else 0.0, float(np.log1p(len(cut)))]


def measured(docs: DataFrame, model: Model, *more: str) -> DataFrame:
    """doc_id, further columns, and gains (a list of numbers) for each row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text", *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = shared.value.compressors()
        for batch in batches:
            for piece in slices(batch, 1):
                values = pa.array([gains(t, compressors) for t in piece.column(1).to_pylist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([piece.column(0), *piece.columns[2:], values], names=["doc_id", *more, "gains"])

    kinds = rows.drop("text").schema.add("gains", T.ArrayType(T.DoubleType()))
    return rows.mapInArrow(run, kinds)


def labelled(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_ordinary: int = MOST_ORDINARY) -> DataFrame:
    """doc_id, text and toxic of the sample that is learned from."""
    said = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("said_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    kinds = [said.where(F.col("toxic") == kind).orderBy(F.xxhash64("said_id"), "said_id").limit(most) for kind, most in ((1, most_toxic), (0, most_ordinary))]
    rows = docs.select("doc_id", "text").join(F.broadcast(kinds[0].unionAll(kinds[1])), F.col("doc_id") == F.col("said_id"))
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_ordinary: int = MOST_ORDINARY) -> Model:
    """Learns from all rows of docs that have a label."""
    ship(docs.sparkSession)
    sample = labelled(docs, labels, most_toxic, most_ordinary).select("*", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(CALIBRATE)) == 0).alias("later"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1):
                found = [windows(t) for t in piece.column(1).to_pylist()]
                spread = [[w[i] for i in np.unique(np.linspace(0, len(w) - 1, WINDOWS_EACH).astype(int))] if len(w) > WINDOWS_EACH else w for w in found]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(spread, pa.list_(pa.binary())), piece.column(2)], names=["doc_id", "windows", "toxic"])

    seen = sample.where("NOT later").select("doc_id", "text", "toxic").mapInArrow(cut, "doc_id bigint, windows array<binary>, toxic int").orderBy("doc_id").toArrow()
    kind = np.asarray(seen.column("toxic"), np.int64)
    texts = seen.column("windows").to_pylist()
    toxic, ordinary = ([texts[i] for i in np.flatnonzero(kind == k) if texts[i]] for k in (1, 0))
    model = Model(float(kind.mean()) if len(kind) else 0.0)
    if not toxic or not ordinary:
        return model
    flat = [w for t in ordinary for w in t]
    flat = [flat[i] for i in np.random.default_rng(0).permutation(len(flat))[:40_000]]
    model.base = trained(flat, ORDINARY)
    kept = toxic_pieces(toxic, ordinary, model.base)
    if not kept:
        return model
    pieces = [w for w, n in sorted(kept.items()) for _ in range(n)]
    pieces = [pieces[i] for i in np.random.default_rng(2).permutation(len(pieces))]
    model.added = trained([b" %b " % b" ".join(pieces[i : i + 8]) for i in range(0, len(pieces), 8)], TOXIC)
    held = measured(sample.where("later"), model, "toxic").orderBy("doc_id").collect()
    said = np.array([float(r.toxic) for r in held])
    if len(said) and 0 < said.mean() < 1:
        model.curve = gbm.logistic(np.array([r.gains for r in held]), said)
        # the share that takes toxic and other texts apart best becomes 0.5
        best = cut_for(model.scores(np.array([r.gains for r in held])), said)
        model.curve[-1] -= np.log(best / (1 - best))
    return model


def cut_for(p: np.ndarray, said: np.ndarray, low: float = 0.05, high: float = 0.95) -> float:
    """The probability, between low and high, from which texts are taken for toxic so that F1 is highest; half-way to the next lower one."""
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(said[order])
    cuts = (p + np.append(p[1:], 0)) / 2
    f1 = np.where(np.append(p[1:] != p[:-1], True) & (cuts >= low) & (cuts <= high), 2 * hits / (np.arange(1, len(p) + 1) + said.sum()), 0)
    return float(cuts[f1.argmax()]) if f1.any() else 0.5


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from a score of 0.5 on) for each row of docs."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            p = model.scores(np.array(batch.column(1).to_pylist(), float).reshape(-1, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return measured(docs, model).mapInArrow(run, "doc_id bigint, score double, predicted int")


def op11_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs.where(id_bucket("doc_id", 5) != 0), labels.where(id_bucket("doc_id", 5) != 0))
    return score(docs, model).select("doc_id", (id_bucket("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
