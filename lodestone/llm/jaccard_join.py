"""N-gram Jaccard join by MinHash banding.

1. One pass over the texts gives each a content key and its band hashes; equal word sequences become one text.
2. Texts meet on band hashes. Each bucket has a hub, its smallest id, and every other text of the bucket is
   held against the hub on full shingle sets: what it has that the hub lacks, and what it lacks of the hub.
3. From these two differences the similarity of any two texts of a hub follows exactly, without their texts: each
   pair of texts of a hub is judged, and counted under the smallest hub that both have. The texts of a large hub are
   dealt to blocks, and each pair of blocks is a group of its own, so pairs are never rows: a group gives the number
   of links of each text and as many links as connect it.
4. Classes are the connected components of the links.

Bands and rows come from the wanted recall of a pair at the threshold (plan()).

Shingles are five consecutive words of lower-cased ASCII letters, digits and non-ASCII characters; a text of fewer words is one
shingle. Rows: texts without words (null and empty ones too) are in no link and each form a class of their own.
Repeated rows are copies of each other. Rows with a null id have a null class. Where an id has several texts, each of
them is a document of its own; the class of one is still the smallest id of its texts' rows. Other columns, of whatever
name, are not read by classes() and carried along by one_of_each().
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship, slices, table, tidy, written
from .decontaminate import words_of

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.99999
MOST_HASHES = 256
#: Ids (8 bytes each) that may be broadcast to pick rows from the documents; beyond it both sides are shuffled.
MOST_BROADCAST_IDS = 400_000
#: Texts of a block of a hub, and shingles of their differences.
BLOCK_TEXTS, BLOCK_SHINGLES = 2_000, 1_000_000


@lru_cache(maxsize=8)
def plan(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows a band: the most rows for which a pair at the threshold meets with the wanted recall."""
    best = None
    for rows in range(1, 33):
        meets = threshold**rows
        bands = 1 if meets >= recall else int(np.ceil(np.log(1 - recall) / np.log(1 - meets)))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError(f"no banding with {most} hashes reaches a recall of {recall} at {threshold}")
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Signer:
    """Content keys and band hashes of many texts at once."""

    def __init__(self, bands: int, rows: int):
        random = np.random.default_rng(11)
        self.bands, self.rows = bands, rows
        self.factors = random.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.adds = random.integers(0, 2**32, bands * rows, dtype=np.uint32)

    def __call__(self, texts: list[str | None]) -> tuple[list[bytes | None], np.ndarray]:
        import xxhash

        split = [words_of(t) for t in texts]
        keys = [key_of(words) for words in split]
        some = [i for i, words in enumerate(split) if words]
        out = np.zeros((len(texts), self.bands), np.int64)
        if not some:
            return keys, out
        codes: dict[bytes, int] = {}
        code = codes.setdefault
        flat = np.fromiter((code(w, len(codes)) for i in some for w in split[i]), np.int64)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, codes), np.uint64, len(codes))[flat]
        sizes = np.fromiter((len(split[i]) for i in some), np.int64, len(some))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        # a shingle starts at each word that has enough words after it, or at a short text's first
        last = np.repeat(ends, sizes)
        at = np.arange(len(flat))
        whole = at + SHINGLE <= last
        whole[starts] = True
        first = np.flatnonzero(whole)
        value = np.zeros(len(first), np.uint64)
        for k in range(SHINGLE):
            there = first + k < last[first]
            word = np.where(there, hashes[np.minimum(first + k, len(flat) - 1)], np.uint64(0))
            value = value * np.uint64(0x9E3779B97F4A7C15) + word
        small = (_mix(value) >> np.uint64(32)).astype(np.uint32)
        counts = np.maximum(sizes - SHINGLE + 1, 1)
        begins = np.cumsum(counts) - counts
        band = np.zeros(len(some), np.uint64)
        for h in range(self.bands * self.rows):
            band = band * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(small * self.factors[h] + self.adds[h], begins)
            if (h + 1) % self.rows == 0:
                out[some, h // self.rows] = _mix(band + np.uint64(h)).view(np.int64)
                band = np.zeros(len(some), np.uint64)
        return keys, out


def key_of(words: list[bytes]) -> bytes | None:
    import xxhash

    return xxhash.xxh3_128_digest(b" ".join(words)) if words else None


def sign(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, key (null without words) and bands of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for batch in batches:
            for piece in slices(batch, "text"):
                keys, hashes = signer(piece.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * bands, pa.array(hashes.ravel()))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(keys, pa.binary()), lists], names=["doc_id", "key", "bands"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id bigint, key binary, bands array<bigint>")


def shingles(text: str | None) -> set[tuple[bytes, ...]]:
    words = words_of(text)
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def _hashes(part: set[tuple[bytes, ...]]) -> list[int]:
    import xxhash

    return [xxhash.xxh3_64_intdigest(b" ".join(s)) - 2**63 for s in part]


def differences(pairs: DataFrame, docs: DataFrame, most_broadcast: int = MOST_BROADCAST_IDS) -> DataFrame:
    """For pairs (a, b) with b as the hub: the number of shingles of each (n, hub_n), hashes of those that the hub lacks
    (alone), and the places of those that a lacks in the order of the hub's (missing)."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("wanted_id")).distinct()
    if wanted.limit(most_broadcast + 1).count() <= most_broadcast:
        wanted = F.broadcast(wanted)
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("wanted_id"), "left_semi").dropDuplicates(["doc_id"])
    left, right = (texts.select(F.col("doc_id").alias(f"{x}_id"), F.col("text").alias(f"{x}_text")) for x in ("a", "b"))
    both = pairs.hint("merge").join(left.hint("merge"), F.col("a") == F.col("a_id")).select("a", "b", "a_text")
    both = both.hint("merge").join(right.hint("merge"), F.col("b") == F.col("b_id")).select("a", "b", "a_text", "b_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hub, places = None, set(), {}
        for batch in batches:
            rows = []
            for a_text, b, b_text in zip(batch.column(2), batch.column(1).to_pylist(), batch.column(3), strict=True):
                if b != held:
                    held, hub = b, shingles(b_text.as_py())
                    places = {s: i for i, s in enumerate(sorted(hub))}
                own = shingles(a_text.as_py())
                rows.append((len(own), len(hub), _hashes(own - hub), [places[s] for s in hub - own]))
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), *columns], names=["hub", "node", "n", "hub_n", "alone", "missing"])

    return both.mapInArrow(tidy(run), "hub bigint, node bigint, n int, hub_n int, alone array<bigint>, missing array<int>")


class _Shared:
    """How many values each list shares with one of them."""

    def __init__(self, lists: list[np.ndarray]):
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.rows, self.empty = len(lists), not sizes.any()
        if self.empty:
            return
        _, self.codes, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.owners = np.repeat(np.arange(len(lists)), sizes)[np.argsort(self.codes, kind="stable")]
        self.ends = np.cumsum(counts)
        self.counts = counts

    def __call__(self, row: int) -> np.ndarray:
        if self.empty or self.starts[row] == self.starts[row + 1]:
            return np.zeros(self.rows, np.int64)
        own = self.codes[self.starts[row] : self.starts[row + 1]]
        own = own[self.counts[own] > 1]
        if not len(own):
            return np.zeros(self.rows, np.int64)
        sizes = self.counts[own]
        at = np.repeat(self.ends[own] - np.cumsum(sizes), sizes) + np.arange(sizes.sum())
        return np.bincount(self.owners[at], minlength=self.rows)


def _linked(hub_n: int, two: bool, nodes: np.ndarray, side: np.ndarray, n: np.ndarray, alone: list, missing: list, lower: list, threshold: float):
    """Of one group: the nodes with their number of links, and links that connect all that its links connect."""
    count, size = len(nodes), np.fromiter(map(len, missing), np.int64, len(missing))
    more, less, known = _Shared(alone), _Shared(missing), _Shared(lower)
    degree, label, edges = np.zeros(count, np.int64), np.arange(count), []
    for row in range(count):
        met = hub_n - size[row] - size + less(row) + more(row)
        near = met / np.maximum(1, n[row] + n - met) >= threshold
        near &= side > side[row] if two else np.arange(count) > row
        if not near.any():
            continue
        # a pair that a smaller hub has too is counted there
        fresh = near & (known(row) == 0)
        degree[row] += fresh.sum()
        degree += fresh
        found = np.flatnonzero(near)
        names, first = np.unique(label[found], return_index=True)
        first = found[first[names != label[row]]]
        if len(first):
            edges += [(nodes[row], nodes[other]) for other in first]
            label[np.isin(label, label[first])] = label[row]
    return degree, edges


def links_of(held: DataFrame, threshold: float) -> DataFrame:
    """From differences of texts and hubs: node with links, the number of its links as far as one group counts them,
    and node with other, a link."""
    own = held.groupBy("hub").agg(F.first("hub_n").alias("n"), F.count(F.lit(1)).alias("texts"), F.sum(F.size("alone") + F.size("missing")).alias("shingles"))
    own = cut(own.withColumns({"blocks": F.greatest(F.ceil((F.col("texts") + 1) / BLOCK_TEXTS), F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.lit(1)).cast("int")}))
    itself = own.select("hub", F.col("hub").alias("node"), "n", F.col("n").alias("hub_n"), F.array().cast("array<bigint>").alias("alone"), F.array().cast("array<int>").alias("missing"))
    rows = held.unionByName(itself)
    hubs = rows.select("hub", "node").groupBy("node").agg(F.collect_set("hub").alias("hubs"))
    rows = rows.join(hubs, "node").join(own.select("hub", "blocks"), "hub").withColumns({"lower": F.expr("filter(hubs, h -> h < hub)"), "block": F.expr("cast(pmod(xxhash64(node), blocks) as int)")})
    rows = rows.withColumns({"other": F.explode(F.expr("sequence(0, blocks - 1)"))})
    rows = rows.select("hub", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "node", "n", "hub_n", "alone", "missing", "lower")
    rows = rows.repartition("hub", "one", "two").sortWithinPartitions("hub", "one", "two")

    def judged(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        whole = pa.Table.from_batches(parts)
        of = lambda name: whole[name].combine_chunks()
        numbers = {name: of(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("one", "two", "block", "node", "n", "hub_n")}

        def lists(name: str) -> list[np.ndarray]:
            column = of(name)
            at = column.offsets.to_numpy()
            return np.split(column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at[1:-1] - at[0])

        degree, edges = _linked(int(numbers["hub_n"][0]), bool(numbers["one"][0] != numbers["two"][0]), numbers["node"], numbers["block"], numbers["n"], lists("alone"), lists("missing"), lists("lower"), threshold)
        if not edges:
            return None
        some = np.flatnonzero(degree)
        ends = np.array(edges, np.int64).reshape(-1, 2)
        node = pa.array(np.concatenate([numbers["node"][some], ends[:, 0]]))
        other = pa.array([None] * len(some) + ends[:, 1].tolist(), pa.int64())
        return pa.RecordBatch.from_arrays([node, other, pa.array(np.concatenate([degree[some], np.zeros(len(ends), np.int64)]))], names=["node", "other", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = None, []
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if start == end:
                    continue
                key = tuple(keys[start])
                if key != last and parts:
                    out = judged(parts)
                    if out is not None:
                        yield out
                    parts = []
                last = key
                parts.append(batch.slice(start, end - start))
        if parts:
            out = judged(parts)
            if out is not None:
                yield out

    return rows.mapInArrow(tidy(run), "node bigint, other bigint, links bigint")


def components(links: DataFrame) -> DataFrame:
    """node and its component (the smallest node of it), for the nodes of links (a, b)."""
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("component", "near").alias("lower"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("lower"), F.col("component").alias("next"))
        after = cut(lower.join(jump, "lower").select("node", F.least("lower", "next").alias("component"), "was"))
        if not after.where(F.col("component") != F.col("was")).limit(1).count():
            return after.drop("was")
        labels = after.drop("was")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and key (as sign() gives it) of the rows with an id and words."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([key_of(words_of(t)) for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), keys], names=["doc_id", "text", "key"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id bigint, text string, key binary").where("doc_id is not null and key is not null")


def _alike(texts: DataFrame, docs: DataFrame, threshold: float, most_broadcast: int) -> DataFrame:
    """key, class_id, n_links and copies of each text: key, node, bands and copies. node is the id of a row of docs that
    has the text, and of no row with another one."""
    rows = texts.select("node", F.explode("bands").alias("band"))
    hubs = rows.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("size")).where(F.col("size") > 1).drop("size")
    met = cut(rows.join(hubs, "band"))
    pairs = cut(met.where(F.col("node") != F.col("hub")).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    found = cut(links_of(cut(differences(pairs, docs, most_broadcast)), threshold))
    groups = components(found.where(F.col("other").isNotNull()).select(F.col("node").alias("a"), F.col("other").alias("b")).distinct())
    degree = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    known = texts.select("key", "node", "copies").join(groups, "node", "left").join(degree, "node", "left")
    return known.select("key", "node", F.coalesce("component", "node").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "copies")


def _judged(docs: DataFrame, threshold: float, recall: float, most_broadcast: int) -> tuple[DataFrame, bool]:
    """Per row: doc_id, key, class_id, n_links, n_copies and whether the row's text is the one of its class that stays;
    and whether an id has several texts."""
    signed = cut(sign(docs, *plan(threshold, recall)))
    good = F.col("key").isNotNull() & F.col("doc_id").isNotNull()
    texts = signed.where(good).groupBy("key").agg(F.min(F.struct("doc_id", "bands")).alias("first"), F.count(F.lit(1)).alias("copies"))
    texts = cut(texts.select("key", F.col("first.doc_id").alias("node"), F.col("first.bands").alias("bands"), "copies"))
    mixed = bool(signed.where(good).select("doc_id", "key").distinct().groupBy("doc_id").count().where("count > 1").limit(1).count())
    if mixed:
        # numbers of the texts instead of ids
        numbered = written(_keyed(docs).groupBy("key").agg(F.min("text").alias("text")).withColumn("number", F.monotonically_increasing_id()))
        own = texts.join(numbered.select("key", "number"), "key").select("key", F.col("number").alias("node"), "bands", "copies")
        known = cut(_alike(cut(own), numbered.select(F.col("number").alias("doc_id"), "text"), threshold, most_broadcast))
        first = texts.select("key", F.col("node").alias("first_id"))
        known = cut(known.join(first, "key").withColumnRenamed("class_id", "component"))
        best = known.groupBy("component").agg(F.min(F.struct("first_id", "key")).alias("best"))
        known = known.join(best, "component").select("key", "first_id", F.col("best.first_id").alias("class_id"), "n_links", "copies", (F.col("best.key") == F.col("key")).alias("stays"))
    else:
        known = _alike(texts, docs, threshold, most_broadcast).select("key", F.col("node").alias("first_id"), "class_id", "n_links", "copies", (F.col("node") == F.col("class_id")).alias("stays"))
    held = signed.select("doc_id", "key").where(good).join(known.hint("merge"), "key")
    stays = F.col("stays") & (F.col("doc_id") == F.col("first_id"))
    zero, alone = F.lit(0).cast("bigint"), signed.where(~good)
    rows = held.select("doc_id", "key", "class_id", "n_links", (F.col("copies") - 1).alias("n_copies"), stays.alias("stays"))
    return rows.unionByName(alone.select("doc_id", "key", F.col("doc_id").alias("class_id"), zero.alias("n_links"), zero.alias("n_copies"), F.lit(True).alias("stays"))), mixed


def classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, most_broadcast: int = MOST_BROADCAST_IDS) -> DataFrame:
    """Per row: doc_id, class_id (smallest id of the class), n_links (other texts, different in words,
    that are as similar as the threshold) and n_copies (other rows with the same words)."""
    return _judged(docs, threshold, recall, most_broadcast)[0].drop("key", "stays")


def _small(ids: DataFrame, most: int) -> DataFrame:
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, most_broadcast: int = MOST_BROADCAST_IDS) -> DataFrame:
    """One row of docs for each class, of its smallest id, and all rows without id or words."""
    judged, mixed = _judged(docs, threshold, recall, most_broadcast)
    judged = cut(judged.select("doc_id", "key", "stays").where(F.col("doc_id").isNotNull()))
    names = docs.columns
    # the row goes along as one column, so no name of it meets one that is added
    whole = docs.select(F.struct(*(F.col(f"`{name}`") for name in names)).alias("row"))
    back = [F.col(f"row.`{name}`").alias(name) for name in names]
    again = judged.where("key is not null").groupBy(F.col("doc_id").alias("gone_id")).count().where("count > 1").select("gone_id")
    repeated = bool(again.limit(1).count())
    gone = judged.where(~F.col("stays")).select(F.col("doc_id").alias("gone_id"))
    gone = cut((gone.unionByName(again) if repeated else gone).distinct())
    kept = whole.join(_small(gone, most_broadcast), F.col("row.doc_id") == F.col("gone_id"), "left_anti")
    if not repeated:
        return kept.select(*back)
    # of ids with several rows, one row of each text that stays, and the rows without words
    some = whole.join(_small(cut(again), most_broadcast), F.col("row.doc_id") == F.col("gone_id"), "left_semi")
    ship(docs.sparkSession)

    @F.pandas_udf("binary")
    def key(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: key_of(words_of(t)))

    some = some.withColumn("own_key", key("row.text"))
    staying = judged.where("stays and key is not null").select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key")).distinct()
    chosen = some.join(staying, (F.col("row.doc_id") == F.col("kept_id")) & (F.col("own_key") == F.col("kept_key"))).dropDuplicates(["kept_id", "kept_key"])
    return kept.select("row").unionByName(chosen.select("row")).unionByName(some.where("own_key is null").select("row")).select(*back)


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
