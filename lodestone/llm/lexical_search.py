"""Ranked lexical search by Block-Max WAND over an inverted index that Spark builds and keeps in the shared folder.

The index is cut into shards of documents (about SHARD_BYTES of text). In a shard documents are numbered from the shortest to the
longest, so that neighbours have similar impacts. A term's postings are cut into blocks of BLOCK, each stored as bytes of variable
length; a block's head has its first and last document, its largest impact and where its bytes start.

A query meets all heads of its terms in a shard first. The heads' borders cut the shard's documents into ranges in which no list's
block changes; the sum of the maxima of the blocks that cover a range bounds the score of all its documents. Ranges are pivots
while their bound reaches the threshold, the score of the last of the best documents so far; the list pointers move over the heads
of all other blocks without reading their bytes. Pivots are taken from the highest bound down, so the threshold rises early, and only
their blocks are decompressed and summed up. As a range is left out only if its bound is below the threshold, results are exact.

Rows: null texts and texts without a term match nothing and don't count as documents. Rows that share an id are documents of
their own; a null id is last among equal scores. Items that share an id are one item with the terms of all its different texts.
Other columns are not read; empty tables give an empty result. Texts of any length are read as a whole, part by part.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, slices, table, tidy, written
from .words import bytes_of, text_parts

MOST = 20
#: Postings of a block; bytes of text of a shard; bytes of items that are asked at once.
BLOCK, SHARD_BYTES, ASKED_BYTES = 128, 32_000_000, 4_000_000
#: Documents in the first ranges that a query reads in a shard; each further step reads twice as many.
FIRST = 64
_OTHER = np.ones(256, bool)
_OTHER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def terms(raw: bytes, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of texts one after another, and the number of each one's text."""
    data = _LOWER[np.frombuffer(raw, np.uint8)]
    word = ~_OTHER[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = word[inner]
    starts = np.flatnonzero(first)
    sizes = np.add.reduceat(word, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    places = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(data[word].tobytes())])
    return found, np.searchsorted(offsets, starts, "right") - 1


def parts(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Terms and text numbers of the whole texts, of very long ones part by part."""
    for raw, offsets in text_parts(*bytes_of(texts), _GAP):
        yield terms(raw, offsets)


def coded(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Numbers in bytes of seven bits, the last of each with the high bit set, and where each number starts."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        more = values >> np.uint64(bits) > 0
        if not more.any():
            break
        sizes += more
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(starts[-1]), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        some = np.flatnonzero(sizes > k)
        out[starts[some] + k] = (values[some] >> np.uint64(7 * k)).astype(np.uint8) & 127
    out[starts[1:] - 1] |= 128
    return out.tobytes(), starts


def decoded(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.int64)
    data = np.frombuffer(raw, np.uint8)
    last = np.flatnonzero(data >= 128)
    starts = np.concatenate([[0], last[:-1] + 1])
    within = np.arange(len(data)) - np.repeat(starts, last - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * within, starts)


def measures(sizes: np.ndarray, documents: int, total: int) -> np.ndarray:
    """A document's m, which grows with its number of terms."""
    if 25 * int(sizes.max(initial=0)) * documents < 1 << 63:
        return 75 + 25 * sizes * documents // total
    return np.array([75 + 25 * n * documents // total for n in sizes.tolist()], np.int64)


def impacts(times: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * times // (1000 * times + 12 * m)


def counted(docs: DataFrame) -> tuple[int, int]:
    """How many documents have a term, and how many terms they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = total = 0
        for batch in batches:
            for piece in slices(batch, 0):
                some = np.zeros(piece.num_rows, np.int64)
                for _, text in parts(piece.column(0)):
                    some += np.bincount(text, minlength=len(some))
                documents, total = documents + int((some > 0).sum()), total + int(some.sum())
        yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([total])], names=["documents", "total"])

    row = docs.select("text").mapInArrow(run, "documents bigint, total bigint").agg(F.sum("documents"), F.sum("total")).first()
    return int(row[0] or 0), int(row[1] or 0)


def index(docs: DataFrame, documents: int, total: int, shard_bytes: int = SHARD_BYTES, block: int = BLOCK) -> DataFrame:
    """shard, term, df (in the shard), heads and postings. The row without a term has the ids and measures of the shard's documents."""
    names = ["shard", "term", "df", "heads", "postings"]

    def built(shard: int, words: list[pa.Array], of: list[np.ndarray], ids: list, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        m = measures(sizes, documents, total)
        order = np.argsort(m, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        said = pa.array([ids[i] for i in order], pa.int64())
        none = np.asarray(said.is_null()).astype(np.uint8)
        top = [pa.array([shard]), pa.array([None], pa.string()), pa.array([len(ids)]), pa.array([np.asarray(said.fill_null(0)).tobytes()]), pa.array([m[order].tobytes() + none.tobytes()])]
        yield pa.RecordBatch.from_arrays(top, names=names)
        code = pa.chunked_array(words).combine_chunks().dictionary_encode()
        keys, times = np.unique(np.asarray(code.indices, np.int64) * len(ids) + place[np.concatenate(of)], return_counts=True)
        term, doc = np.divmod(keys, len(ids))
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        df = np.diff(np.append(first, len(term)))
        within = np.arange(len(term)) - np.repeat(first, df)
        cut = np.flatnonzero(within % block == 0)
        steps = np.diff(doc, prepend=0)
        steps[cut] = 0
        raw, starts = coded(np.stack([steps, times], axis=1).ravel())
        at = starts[:-1:2]
        own = np.repeat(at[first], df)
        heads = np.stack([doc[cut], doc[np.append(cut[1:], len(doc)) - 1], np.maximum.reduceat(impacts(times, m[order][doc]), cut), (at - own)[cut]], axis=1).astype("<i4")
        head_at = np.append(np.searchsorted(cut, first), len(cut)) * 16
        body_at = np.append(at[first], len(raw))
        columns = [pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(x.astype(np.int32).tobytes()), pa.py_buffer(y)]) for x, y in ((head_at, heads.tobytes()), (body_at, raw))]
        whole = pa.RecordBatch.from_arrays([pa.array(np.full(len(first), shard)), code.dictionary.take(pa.array(term[first])).cast(pa.string()), pa.array(df), *columns], names=names)
        for start in range(0, whole.num_rows, 10_000):
            yield whole.slice(start, 10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = TaskContext.get().partitionId() << 32, ([], [], [], [])
        size = 0
        for batch in batches:
            for piece in slices(batch, 1):
                some, rows = np.zeros(piece.num_rows, np.int64), []
                for words, text in parts(piece.column(1)):
                    some += np.bincount(text, minlength=len(some))
                    rows.append((words, text))
                    size += words.nbytes
                filled = np.flatnonzero(some)
                number = np.zeros(len(some), np.int64)
                number[filled] = np.arange(len(filled)) + len(held[2])
                for words, text in rows:
                    held[0].append(words)
                    held[1].append(number[text])
                held[2].extend(piece.column(0).take(pa.array(filled)).to_pylist())
                held[3].append(some[filled])
                if size >= shard_bytes:
                    yield from built(shard, held[0], held[1], held[2], np.concatenate(held[3]))
                    shard, held, size = shard + 1, ([], [], [], []), 0
        if held[2]:
            yield from built(shard, held[0], held[1], held[2], np.concatenate(held[3]))

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(tidy(run), "shard bigint, term string, df bigint, heads binary, postings binary")


class Postings:
    """A term's list in a shard; blocks are decompressed when they are first read."""

    def __init__(self, heads: bytes, raw: bytes, df: int, m: np.ndarray, block: int):
        self.firsts, self.lasts, self.most, self.at = np.frombuffer(heads, "<i4").reshape(-1, 4).T.astype(np.int64)
        self.raw, self.m, self.read = raw, m, np.zeros(len(self.at), bool)
        self.ends = np.append(self.at[1:], len(raw))
        self.sizes = np.full(len(self.at), block)
        self.sizes[-1] = df - block * (len(self.at) - 1)
        self.starts = np.arange(len(self.at)) * block
        self.docs, self.impacts = np.zeros(df, np.int64), np.zeros(df, np.int64)

    def blocks(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of some blocks."""
        new = some[~self.read[some]]
        if len(new):
            values = decoded(b"".join([self.raw[self.at[b] : self.ends[b]] for b in new])).reshape(-1, 2)
            sizes = self.sizes[new]
            begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            docs = np.cumsum(values[:, 0])
            docs += np.repeat(self.firsts[new] - docs[begins], sizes)
            into = np.repeat(self.starts[new] - begins, sizes) + np.arange(len(docs))
            self.docs[into], self.impacts[into] = docs, impacts(values[:, 1], self.m[docs])
            self.read[new] = True
        if len(some) == len(self.at):
            return self.docs, self.impacts
        sizes = self.sizes[some]
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(some) else np.zeros(0, np.int64)
        where = np.repeat(self.starts[some] - begins, sizes) + np.arange(int(sizes.sum()))
        return self.docs[where], self.impacts[where]


def best(lists: list[tuple[Postings, int]], ids: np.ndarray, most: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the best documents of a shard. lists: postings and weights; ids: what decides between equal
    scores; sums: zeros, one for each document, left as zeros."""
    found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not lists:
        return found, scores
    firsts, lasts, bounds = (np.concatenate(x) for x in zip(*((p.firsts, p.lasts + 1, p.most * w) for p, w in lists), strict=True))
    edges = np.unique(np.concatenate([firsts, lasts]))
    change = np.zeros(len(edges), np.int64)
    np.add.at(change, np.searchsorted(edges, firsts), bounds)
    np.subtract.at(change, np.searchsorted(edges, lasts), bounds)
    bound = np.cumsum(change)[:-1]
    order = np.argsort(-bound, kind="stable")
    held = np.cumsum(np.diff(edges)[order])
    done, want, threshold = 0, FIRST, 1
    while done < len(order) and bound[order[done]] >= threshold:
        stop = max(done + 1, int(np.searchsorted(held, (held[done - 1] if done else 0) + want)))
        pivots = order[done:stop]
        pivots = np.sort(pivots[bound[pivots] >= threshold])
        inside = np.zeros(len(sums) + 1, np.int64)
        inside[edges[pivots]] += 1
        inside[edges[pivots + 1]] -= 1
        inside = np.cumsum(inside[:-1]) > 0
        for postings, weight in lists:
            block = np.searchsorted(postings.lasts, edges[pivots])
            block = block[block < len(postings.lasts)]
            some = np.unique(block[postings.firsts[block] <= edges[pivots[: len(block)]]])
            docs, impact = postings.blocks(some)
            here = inside[docs]
            sums[docs[here]] += weight * impact[here]
        new = np.flatnonzero(inside)
        new = new[sums[new] > 0]
        found, scores = np.concatenate([found, new]), np.concatenate([scores, sums[new]])
        sums[new] = 0
        top = np.lexsort((ids[found], -scores))[:most]
        found, scores = found[top], scores[top]
        if len(found) == most:
            threshold = int(scores[-1])
        done, want = stop, 2 * want
    return found, scores


def asked(items: DataFrame, most_bytes: int) -> Iterator[list[tuple[int, Counter]]]:
    """The terms of the items with how often each occurs, in lists of items of a bounded size."""
    rows = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("bigint"), "text").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-int(total) // most_bytes))
    for number in range(count):
        own = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == number).collect()
        of: dict[int, Counter] = {}
        for row in own:
            words = terms(*bytes_of(pa.array([row.text], pa.string())))[0].to_pylist()
            of.setdefault(row.item_id, Counter()).update(words)
        if some := [(item, words) for item, words in sorted(of.items()) if words]:
            yield some


def answers(shared: Broadcast, most: int, block: int):
    """For applyInArrow: the best documents of a shard for each item. shared: the items with their terms' weights."""

    def answer(shard: pa.Table) -> pa.Table:
        lists, top = {}, None
        term, df, heads, raw = (shard.column(c).to_pylist() for c in ("term", "df", "heads", "postings"))
        top = term.index(None)
        count = df[top]
        m, none = np.frombuffer(raw[top][: 8 * count], np.int64), np.frombuffer(raw[top][8 * count :], np.uint8)
        ids = np.frombuffer(heads[top], np.int64)
        ties = np.where(none, np.iinfo(np.int64).max, ids)
        for i in range(len(term)):
            if i != top:
                lists[term[i]] = Postings(heads[i], raw[i], df[i], m, block)
        out, sums = [], np.zeros(count, np.int64)
        for item, words in shared.value:
            place, score = best([(lists[word], w) for word, w in words if word in lists], ties, most, sums)
            out.append((np.full(len(place), item), place, score))
        item, place, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table([pa.array(item, pa.int64()), pa.array(ids[place], mask=none[place].astype(bool)), pa.array(score, pa.int64())], names=["item_id", "doc_id", "score"])

    return answer


def search(docs: DataFrame, items: DataFrame, most: int = MOST, shard_bytes: int = SHARD_BYTES, block: int = BLOCK, asked_bytes: int = ASKED_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the documents that match each item best. docs has doc_id and text, items item_id and text.
    Items are asked in blocks of a bounded size, each against all shards."""
    spark = docs.sparkSession
    ship(spark)
    documents, total = counted(docs)
    schema, found = "item_id bigint, doc_id bigint, score bigint", []
    built = written(index(docs, documents, total, shard_bytes, block)) if documents else None
    for some in asked(items, asked_bytes) if documents else ():
        known = sorted({word for _, words in some for word in words})
        wanted = F.broadcast(spark.createDataFrame([(word,) for word in known], "term string"))
        df = dict(tuple(r) for r in built.join(wanted, "term").groupBy("term").agg(F.sum("df")).collect())
        weight = {word: math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for word, n in df.items()}
        queries = [(item, [(word, weight[word] * times) for word, times in words.items() if weight.get(word)]) for item, words in some]
        shared = spark.sparkContext.broadcast(queries)

        rows = built.join(wanted, "term").unionByName(built.where("term IS NULL")).select("shard", "term", "df", "heads", "postings")
        found.append(rows.groupBy("shard").applyInArrow(answers(shared, most, block), schema))
    rows = reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], schema)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS place, doc_id, {_TERMS} AS words FROM documents),
sizes AS (SELECT place, doc_id, len(words) AS n, words FROM docs WHERE len(words) > 0),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM sizes),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
postings AS (SELECT place, term, count(*) AS tf FROM (SELECT place, unnest(words) AS term FROM sizes) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM postings GROUP BY 1), corpus),
parts AS (
  SELECT place, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))) AS part
  FROM postings JOIN sizes USING (place) JOIN weights USING (term), corpus),
scores AS (SELECT item_id, place, sum(times * part)::BIGINT AS score FROM asked JOIN parts USING (term) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores JOIN sizes USING (place) WHERE score > 0)
WHERE rank <= {MOST}
"""
