"""Vectors: F13 and X9. The rows nearest to each of a set of queries, by cosine: against all rows, or by an inverted file.

Only vectors of the same length have a cosine. Null, empty and zero vectors, and ones with a null, a NaN or an infinite element, are near to none;
rows and queries with a null id are left out. Ids may be any bigint; rows that repeat an id count each, and of queries that repeat
one the vector that is least in order is asked. Equal cosines (rounded to four places) are ordered by the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query, table
from ..shared import written
from ..ship import ship

#: Neighbours of each query; queries that are broadcast at once; rows that a worker holds against them at once.
NEIGHBOURS, BLOCK, PIECE = 10, 10_000, 256
#: A cosine counts in steps of a 10,000th.
STEPS = 10_000
#: Lists of the inverted file; rows that their centres are learned from at most, and rounds.
LISTS, SAMPLE, ROUNDS = 64, 20_000, 10
#: The recall that probing aims at, and rows of the sample that it is measured with.
RECALL, TRIED = 0.95, 500
_FOUND = "query_id bigint, vec_id bigint, c double"


def units(column: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vector the places that have one, and their unit vectors."""
    offsets, flat = np.asarray(column.offsets, np.int64), column.values
    values = np.asarray(flat.cast(pa.float64()).fill_null(float("nan")), np.float64)
    sizes = np.diff(offsets)
    if column.null_count:
        sizes[np.asarray(column.is_null())] = 0
    out = {}
    for size in np.unique(sizes[sizes > 0]).tolist():
        places = np.flatnonzero(sizes == size)
        rows = values[offsets[places][:, None] + np.arange(size)]
        norm = np.sqrt((rows * rows).sum(axis=1))
        good = np.isfinite(norm) & (norm > 0)
        out[size] = places[good], rows[good] / norm[good][:, None]
    return out


class Best:
    """The nearest rows so far of some queries."""

    def __init__(self, queries: int, most: int):
        self.ids, self.steps = np.zeros((queries, most), np.int64), np.full((queries, most), -2 * STEPS)

    def add(self, of: np.ndarray, cosines: np.ndarray, ids: np.ndarray) -> None:
        """Cosines of the queries `of` to rows with these ids."""
        most = self.ids.shape[1]
        steps = np.rint(cosines * STEPS).astype(np.int64)
        some = np.flatnonzero(steps.max(axis=1) >= self.steps[of].min(axis=1))
        of, steps = of[some], steps[some]
        known, place = np.unique(np.concatenate([self.ids[of].ravel(), ids]), return_inverse=True)
        old, new = place[: of.size * most].reshape(-1, most), place[of.size * most :]
        # least first: steps from the top, then the place of the id in order
        keys = np.concatenate([(STEPS - self.steps[of]) * len(known) + old, (STEPS - steps) * len(known) + new], axis=1)
        keys = np.partition(keys, most - 1, axis=1)[:, :most]
        self.ids[of], self.steps[of] = known[keys % len(known)], STEPS - keys // len(known)


class Asked:
    """A block of queries, by length of vector, with the lists that each probes (all without any)."""

    def __init__(self, part: pa.Table, probes: np.ndarray | None = None):
        column = part.column(1).combine_chunks() if part.num_rows else pa.array([], pa.list_(pa.float64()))
        ids = np.asarray(part.column(0), np.int64)
        self.by = {size: (ids[places], values, None if probes is None else probes[places]) for size, (places, values) in units(column).items()}


def _best(asked: Asked, batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The best rows of a task for each query. Batches have an id, a vector and, where queries probe lists, a list."""
    best = {size: Best(len(ids), most) for size, (ids, _, _) in asked.by.items()}
    for batch in batches:
        for start in range(0, batch.num_rows if best else 0, PIECE):
            piece = batch.slice(start, PIECE)
            names = np.asarray(piece.column(0), np.int64)
            lists = np.asarray(piece.column(2), np.int64) if piece.num_columns > 2 else np.zeros(len(names), np.int64)
            for size, (places, values) in units(piece.column(1)).items():
                if size in best and len(places):
                    _, queries, probes = asked.by[size]
                    for number in np.unique(lists[places]):
                        own = lists[places] == number
                        of = np.arange(len(queries)) if probes is None else np.flatnonzero(probes[:, number])
                        if len(of):
                            best[size].add(of, queries[of] @ values[own].T, names[places[own]])
    for size, (ids, _, _) in asked.by.items():
        row, place = np.nonzero(best[size].steps >= -STEPS)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[row], best[size].ids[row, place], best[size].steps[row, place] / STEPS)], names=["query_id", "vec_id", "c"])


def _blocks(asked: DataFrame, block: int) -> Iterator[pa.Table]:
    """The queries, fetched a bounded block after another."""
    asked = asked.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    count = max(1, -(-asked.count() // block))
    for number in range(count):
        yield asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(count)) == number).toArrow()


def _top(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("c"), "vec_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def _against(rows: DataFrame, asked: Asked, most: int) -> DataFrame:
    """The best rows for a block of queries; a task keeps the best of its rows for each, so only these are shuffled."""
    shared = rows.sparkSession.sparkContext.broadcast(asked)
    return _top(rows.mapInArrow(lambda batches: _best(shared.value, batches, most), _FOUND), most)


def nearest(rows: DataFrame, asked: DataFrame, most: int = NEIGHBOURS, block: int = BLOCK) -> DataFrame:
    """query_id, vec_id and c (rounded to four places) of the rows with the largest cosines to each row of asked. Both have
    vec_id and embedding. All rows are held against one block of queries after another."""
    ship(rows.sparkSession)
    rows = rows.where("vec_id IS NOT NULL").select("vec_id", "embedding")
    found = [_against(rows, Asked(part), most) for part in _blocks(asked, block)]
    # of several blocks each is done before the next is fetched
    return found[0] if len(found) == 1 else reduce(DataFrame.unionAll, map(written, found))


class Index:
    """An inverted file: rows (vec_id, embedding, list) in the shared folder, ordered by list, the lists' centres, and the largest
    angle between a row of a list and its centre. Vectors of other lengths than the centres' are in a list of their own."""

    def __init__(self, rows: DataFrame, lists: int = LISTS, sample: int = SAMPLE, rounds: int = ROUNDS):
        spark = rows.sparkSession
        ship(spark)
        rows = rows.where("vec_id IS NOT NULL").select("vec_id", "embedding")
        values = sampled(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow())
        self.centres = centres_of(values, lists, rounds)
        self.probes = probes_for(values, self.centres)
        shared = spark.sparkContext.broadcast(self.centres)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = shared.value
            for batch in batches:
                number, angle = np.full(batch.num_rows, len(centres)), np.zeros(batch.num_rows)
                places, values = units(batch.column(1)).get(centres.shape[1], (np.zeros(0, int), None))
                if len(places):
                    cosines = values @ centres.T
                    number[places] = cosines.argmax(axis=1)
                    angle[places] = np.arccos(np.clip(cosines.max(axis=1), -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number), pa.array(angle)], names=["vec_id", "embedding", "list", "angle"])

        dealt = rows.mapInArrow(run, rows.schema.simpleString()[7:-1].replace("vec_id:", "vec_id ").replace("embedding:", "embedding ") + ", list bigint, angle double")
        # by list and id, so that a list with many rows is spread over several parts
        self.rows = written(dealt.repartitionByRange("list", "vec_id").sortWithinPartitions("list", "vec_id"))
        self.widest = np.zeros(len(self.centres) + 1)
        for row in self.rows.groupBy("list").agg(F.max("angle").alias("angle")).collect():
            self.widest[row.list] = row.angle

    def angles(self, part: pa.Table) -> np.ndarray:
        """The least angle that each query can have to a row of each list."""
        out = np.zeros((part.num_rows, len(self.centres) + 1))
        places, values = units(part.column(1).combine_chunks()).get(self.centres.shape[1], (np.zeros(0, int), None)) if part.num_rows else (np.zeros(0, int), None)
        if len(places):
            own = np.arccos(np.clip(values @ self.centres.T, -1, 1))
            out[places, :-1] = own - self.widest[:-1]
            out[places, -1] = np.inf
        return out

    def nearest(self, asked: DataFrame, most: int = NEIGHBOURS, probes: int | None = None, exact: bool = True, block: int = BLOCK) -> DataFrame:
        """As nearest(). Each query probes the lists whose centres are nearest, as many as the sample needs for RECALL unless given. If exact, it then probes the others that can hold a row
        as near as the last of those found, by the angle between the query and the centre and the list's widest angle; so
        no row is missed. Otherwise rows of lists that weren't probed are."""
        rows, found = self.rows.select("vec_id", "embedding", "list"), []
        for part in _blocks(asked, block):
            angles = self.angles(part)
            near = angles + self.widest
            first = np.zeros(angles.shape, bool)
            np.put_along_axis(first, np.argsort(near, axis=1)[:, : probes or self.probes], True, axis=1)
            # a query of another length probes the list of such vectors
            first[:, -1] = np.isfinite(angles[:, -1])
            best = _against(rows, Asked(part, first), most)
            if exact:
                best = written(best)
                last = {r.query_id: r.c for r in best.groupBy("query_id").agg(F.count("c").alias("n"), F.min("c").alias("c")).where(F.col("n") == most).collect()}
                floor = np.array([last.get(i, -2.0) for i in part.column(0).to_pylist()])
                # half a step, as cosines are rounded, and what arithmetic may be off
                open_ = np.where(angles <= 0, 1, np.cos(np.clip(angles, 0, np.pi))) >= floor[:, None] - 0.6 / STEPS
                then = open_ & ~first & np.isfinite(angles)
                if then.any():
                    wanted = np.flatnonzero(then.any(axis=0)).tolist()
                    best = _top(best.unionAll(_against(rows.where(F.col("list").isin(wanted)), Asked(part, then), most)), most)
            found.append(best)
        return found[0] if len(found) == 1 else reduce(DataFrame.unionAll, map(written, found))


def sampled(sample: pa.Table) -> np.ndarray:
    """Unit vectors of the sample, of their most frequent length."""
    by = units(sample.column(0).combine_chunks()) if sample.num_rows else {}
    return max(by.values(), key=lambda x: len(x[0]))[1] if by else np.zeros((0, 1))


def centres_of(values: np.ndarray, lists: int, rounds: int) -> np.ndarray:
    """Centres of lists, by rounds of k-means on unit vectors."""
    if not len(values):
        return np.zeros((1, values.shape[1]))
    centres = values[np.random.default_rng(1).permutation(len(values))[:lists]]
    for _ in range(rounds):
        number = (values @ centres.T).argmax(axis=1)
        sums = np.zeros(centres.shape)
        np.add.at(sums, number, values)
        norm = np.sqrt((sums * sums).sum(axis=1))
        # a centre without rows stays where it was
        centres = np.where(norm[:, None] > 0, sums / np.where(norm > 0, norm, 1)[:, None], centres)
    return centres


def probes_for(values: np.ndarray, centres: np.ndarray, most: int = NEIGHBOURS) -> int:
    """How many lists must be probed so that, of the nearest in the sample of some of its rows, RECALL are found."""
    some = np.random.default_rng(2).permutation(len(values))[:TRIED]
    near = np.argpartition(-(values[some] @ values.T), min(most, len(values)) - 1, axis=1)[:, :most] if len(some) else np.zeros((0, 1), int)
    place = np.argsort(np.argsort(-(values[some] @ centres.T), axis=1), axis=1)
    needed = np.take_along_axis(place, (values @ centres.T).argmax(axis=1)[near], axis=1) + 1 if len(some) else np.ones(1)
    return int(np.quantile(needed, RECALL, method="higher"))


_COSINE = "round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2])) / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x))) / sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x))), 4)"
_NEAREST = f"SELECT query_id, vec_id, c FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS place FROM (SELECT b.vec_id AS query_id, a.vec_id, {_COSINE} + 0.0 AS c FROM embeddings a JOIN embeddings b ON b.vec_id % 50 = 0)) WHERE place <= 10"


@query("f13_cosine", _NEAREST)
def cosine(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 50 = 0"))


@query("x9_vector_index", _NEAREST)
def vector_index(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return Index(rows).nearest(rows.where("vec_id % 50 = 0"))
