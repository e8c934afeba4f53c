"""Collocations from vertical positional inverted lists.

The corpus is cut into blocks of about BLOCK_WORDS words, and each block keeps, for every phrase in it, the sorted list of the
positions where it starts. A phrase grows by one word where its list meets, one position on, the list of a phrase of the same length that
has the added word: the lists of a block are merge-joined, so a longer phrase's list is made of shorter ones' and its length is the exact
count. Only keys and counts leave a block, dealt to parts by a hash of the key. A part sums the counts of all blocks, gives numbers to
phrases that occur often enough in the whole corpus, and tells each block which of its lists they are; the block grows only those.
Phrases are compared as words, or as pairs of such numbers, never by hashes.

All is per language; a null language is "und". Pieces end at [.,;:!?\\x0A-\\x0D] and at the end of a text, and no phrase crosses
them; a gap in the positions keeps them apart.

Rows: null and empty texts have no words. Repeated rows count each; other columns are not read; an empty table gives an empty result.
A text of any length may spread over several blocks: a block also holds the few words after its own, and only counts its own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_folder, remove, ship, slices, table, tidy, written
from .words import bytes_of, hashes, mix, text_parts

LONGEST, LEAST, MOST = 5, 100, 2_000
#: Words of a block; bytes of text whose keys a part holds, about.
BLOCK_WORDS, PART_BYTES = 2_000_000, 3_000_000
#: Parts in which a language's phrases are ranked before its best ones meet.
SALTS = 64
UNKNOWN = "und"
_END = re.compile(rb"[.,;:!?\x0A-\x0D]")
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_OUTSIDE = _ENDS.copy()
_OUTSIDE[[0x20, 0x09]] = True
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def tokens(raw: bytes, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of texts one after another, the number of each one's text, and whether a piece starts with it."""
    data = _LOWER[np.frombuffer(raw, np.uint8)]
    word = ~_OUTSIDE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], word[:-1]]) if len(word) else word
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    sizes = np.add.reduceat(word, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    text = np.searchsorted(offsets, starts, "right") - 1
    ended = np.concatenate([[0], np.cumsum(_ENDS[data])])[starts]
    first = np.ones(len(starts), bool)
    first[1:] = (ended[1:] != ended[:-1]) | (text[1:] != text[:-1])
    places = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(data[word].tobytes())])
    return words, text, first


def pack(values: np.ndarray) -> bytes:
    """Numbers in few bytes, if neighbours are near each other."""
    steps = np.diff(values.astype(np.int64), prepend=0).astype("<i8")
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view("<i8").ravel())


class Lists:
    """The lists of a block: for each key, which are in order of their part and then as given, the sorted positions."""

    def __init__(self, keys: np.ndarray, part_of: np.ndarray, places: np.ndarray, own: int):
        """keys: a number for each position; part_of: the part of each number."""
        order = np.lexsort((places, keys, part_of[keys]))
        keys, places = keys[order], places[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.keys, self.places, self.sizes = keys[first], places, np.diff(np.append(first, len(keys)))
        self.n = np.add.reduceat((places < own).astype(np.int64), first)
        self.parts, begins = np.unique(part_of[self.keys], return_index=True)
        self.ends = np.append(begins[1:], len(self.keys))

    def state(self, block: int, own: int) -> list[pa.Array]:
        values = [pack(x) for x in (self.places, self.sizes, self.parts, self.ends)]
        return [pa.array([block]), pa.array([own]), *(pa.array([v], pa.binary()) for v in values)]

    def cut(self, values: np.ndarray) -> pa.Array:
        """Values of the keys, packed part by part."""
        return pa.array([pack(values[a:b]) for a, b in zip(np.append(0, self.ends[:-1]), self.ends, strict=True)], pa.binary())


_STATE = "block bigint, own bigint, places binary, sizes binary, parts binary, ends binary"
_ROWS = f"{_STATE}, part bigint, langs array<string>, lang binary, words binary, ends_at binary, first binary, rest binary, n binary"
_MERGED = "block bigint, part bigint, at binary, ids binary, found array<struct<id: bigint, first: bigint, rest: bigint, lang: string, word: string, a: bigint>>, total array<struct<lang: string, n: bigint>>"
_SCHEMA = pa.schema([(name, pa.list_(pa.string()) if name == "langs" else pa.int64() if kind == "bigint" else pa.binary()) for name, kind in (x.split() for x in _ROWS.split(", "))])
_FOUND = pa.struct([("id", pa.int64()), ("first", pa.int64()), ("rest", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("a", pa.int64())])
_TOTAL = pa.struct([("lang", pa.string()), ("n", pa.int64())])


def _rows(lists: Lists, block: int, own: int, keys: dict[str, pa.Array]) -> pa.Table:
    """A row with the block's lists and, for each part, a row with its keys and their counts. A row has lists or a part."""
    count = len(lists.parts)
    state = dict(zip(("block", "own", "places", "sizes", "parts", "ends"), lists.state(block, own), strict=True))
    keys = keys | {"block": pa.array(np.full(count, block)), "part": pa.array(lists.parts), "n": lists.cut(lists.n)}
    return pa.concat_tables([pa.table([x.get(f.name, pa.nulls(n, f.type)).cast(f.type) for f in _SCHEMA], schema=_SCHEMA) for x, n in ((state, 1), (keys, count))])


def blocks(docs: DataFrame, parts: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The lists of single words of each block, and the words with their counts by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, size = TaskContext.get().partitionId() << 32, [], 0

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made, held, size
            words, langs, first = pa.chunked_array([h[0] for h in held]).combine_chunks(), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            held, size = [], 0
            start = 0
            while start < len(words):
                own = len(words) - start
                if not last and own < block_words:
                    held, size = [(words.slice(start), langs[start:], first[start:])], own
                    return
                if own > 1.5 * block_words:
                    own = block_words
                stop = min(len(words), start + own + LONGEST - 1)
                places = np.arange(stop - start) + np.cumsum(first[start:stop])
                limit = int(places[own - 1]) + 1
                coded = words.slice(start, stop - start).dictionary_encode()
                names, lang = np.unique(langs[start:stop], return_inverse=True)
                distinct, key = np.unique(lang * len(coded.dictionary) + np.asarray(coded.indices, np.int64), return_inverse=True)
                lang, word = np.divmod(distinct, len(coded.dictionary))
                raw, offsets = bytes_of(coded.dictionary)
                named = np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in names.tolist()], np.uint64)
                part = (mix(hashes(raw, offsets[:-1], offsets[1:])[word] + named[lang]) % np.uint64(parts)).astype(np.int64)
                lists = Lists(key, part, places, limit)
                raw, offsets = bytes_of(coded.dictionary.take(pa.array(word[lists.keys])))
                said = [zstandard.ZstdCompressor(level=1).compress(raw[offsets[i] : offsets[j]]) for i, j in zip(np.append(0, lists.ends[:-1]), lists.ends, strict=True)]
                keys = {"langs": pa.array([names.tolist()] * len(said), pa.list_(pa.string())), "lang": lists.cut(lang[lists.keys]), "words": pa.array(said, pa.binary()), "ends_at": lists.cut(np.diff(offsets))}
                yield from _rows(lists, made, limit, keys).to_batches()
                made, start = made + 1, start + own

        for batch in batches:
            for piece in slices(batch, 1):
                langs = np.array([UNKNOWN if x is None else x for x in piece.column(0).to_pylist()], dtype=object)
                for raw, offsets in text_parts(*bytes_of(piece.column(1)), _END):
                    words, text, first = tokens(raw, offsets)
                    if len(words):
                        held.append((words, langs[text].astype(str), first))
                        size += len(words)
                    if size > 1.5 * block_words:
                        yield from out(False)
        if held:
            yield from out(True)

    return docs.select(F.col("lang").cast("string"), "text").mapInArrow(tidy(run), _ROWS)


def merger(least: int, parts: int):
    """For applyInArrow on the rows of a part, from all blocks: keys that occur often enough get numbers, and each block is told which of
    its keys they are. A block's row has the places of such keys in its part and their numbers, the last row what was found."""

    def merged(rows: pa.Table) -> pa.Table:
        part, n = rows.column("part")[0].as_py(), [unpack(x) for x in rows.column("n").to_pylist()]
        sizes, n = np.array([len(x) for x in n]), np.concatenate(n)
        total = pa.array([[]], pa.list_(_TOTAL))
        if rows.column("first").null_count:
            names = [name for own, codes in zip(rows.column("langs").to_pylist(), rows.column("lang").to_pylist(), strict=True) for name in np.array(own, dtype=object)[unpack(codes)]]
            raw = b"".join(zstandard.ZstdDecompressor().decompress(x) if x else b"" for x in rows.column("words").to_pylist())
            edges = np.concatenate([[0], np.cumsum(np.concatenate([unpack(x) for x in rows.column("ends_at").to_pylist()]))]).astype(np.int64)
            lang = pa.array(names, pa.string()).dictionary_encode()
            word = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(raw)]).dictionary_encode()
            key = np.asarray(lang.indices, np.int64) * len(word.dictionary) + np.asarray(word.indices, np.int64)
            distinct, of = np.unique(key, return_inverse=True)
            sums = np.zeros(len(lang.dictionary), np.int64)
            np.add.at(sums, np.asarray(lang.indices), n)
            total = pa.ListArray.from_arrays([0, len(sums)], pa.StructArray.from_arrays([lang.dictionary, pa.array(sums)], fields=list(_TOTAL)))
        else:
            first, rest = (np.concatenate([unpack(x) for x in rows.column(c).to_pylist()]) for c in ("first", "rest"))
            order = np.lexsort((rest, first))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(first[order]) != 0) | (np.diff(rest[order]) != 0)
            of = np.empty(len(order), np.int64)
            of[order] = np.cumsum(new) - 1
            distinct = order[new]
        a = np.zeros(len(distinct), np.int64)
        np.add.at(a, of, n)
        often = np.flatnonzero(a >= least)
        number = np.full(len(a), -1)
        number[often] = np.arange(len(often)) * parts + part
        if rows.column("first").null_count:
            own = [pa.array(number[often]), pa.nulls(len(often), pa.int64()), pa.nulls(len(often), pa.int64()), lang.dictionary.take(pa.array(distinct[often] // len(word.dictionary))), word.dictionary.take(pa.array(distinct[often] % len(word.dictionary))).cast(pa.string())]
        else:
            own = [pa.array(number[often]), pa.array(first[distinct[often]]), pa.array(rest[distinct[often]]), pa.nulls(len(often), pa.string()), pa.nulls(len(often), pa.string())]
        found = pa.ListArray.from_arrays([0, len(often)], pa.StructArray.from_arrays([*own, pa.array(a[often])], fields=list(_FOUND)))
        ids, at = [], []
        for end, size in zip(np.cumsum(sizes), sizes, strict=True):
            told = number[of[end - size : end]]
            at.append(pack(np.flatnonzero(told >= 0)))
            ids.append(pack(told[told >= 0]))
        count = len(ids)
        columns = [
            pa.concat_arrays([rows.column("block").combine_chunks(), pa.nulls(1, pa.int64())]), pa.array(np.full(count + 1, part)), pa.array([*at, None], pa.binary()), pa.array([*ids, None], pa.binary()),
            pa.concat_arrays([pa.nulls(count, found.type), found]), pa.concat_arrays([pa.nulls(count, total.type), total]),
        ]
        return pa.table(columns, names=["block", "part", "at", "ids", "found", "total"])

    return merged


def grower(parts: int):
    """For applyInArrow on a block's lists and what it was told: the lists of phrases that are one word longer."""

    def grown(key, state: pa.Table, told: pa.Table) -> pa.Table:
        none = _SCHEMA.empty_table()
        if not state.num_rows or not told.num_rows:
            return none
        own = state.column("own")[0].as_py()
        places, sizes, numbers, ends = (unpack(state.column(c)[0].as_py()) for c in ("places", "sizes", "parts", "ends"))
        id_of = np.full(len(sizes), -1)
        begins = np.append(0, ends[:-1])
        for part, at, ids in zip(*(told.column(c).to_pylist() for c in ("part", "at", "ids")), strict=True):
            id_of[begins[np.searchsorted(numbers, part)] + unpack(at)] = unpack(ids)
        of = np.repeat(id_of, sizes)
        places, of = places[of >= 0], of[of >= 0]
        if not len(of):
            return none
        known, of = np.unique(of, return_inverse=True)
        # the lists are merged by position: a phrase grows where one starts a position later
        at = np.full(int(places.max()) + 2, -1)
        at[places] = of
        met = at[places + 1]
        pair, places = of[met >= 0] * len(known) + met[met >= 0], places[met >= 0]
        if not len(pair):
            return none
        distinct, pair = np.unique(pair, return_inverse=True)
        first, rest = known[distinct // len(known)], known[distinct % len(known)]
        part = (mix(mix(first.astype(np.uint64)) + rest.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        lists = Lists(pair, part, places, own)
        return _rows(lists, key[0].as_py(), own, {"first": lists.cut(first[lists.keys]), "rest": lists.cut(rest[lists.keys])})

    return grown


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST, longest: int = LONGEST, block_words: int = BLOCK_WORDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: the first phrases of each language. docs has text and lang."""
    ship(docs.sparkSession)
    parts = max(8, int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // part_bytes)
    folder = new_folder(docs.sparkSession)
    rows, found = written(blocks(docs, parts, block_words), folder), []
    for words in range(1, longest + 1):
        asked = rows.where("part IS NOT NULL").drop("own", "places", "sizes", "parts", "ends")
        merged = written(asked.groupBy("part").applyInArrow(merger(least, parts), _MERGED))
        new = merged.where("block IS NULL").select(F.explode("found").alias("x")).select("x.*")
        if words == 1:
            total = merged.where("block IS NULL").select(F.explode("total").alias("x")).groupBy("x.lang").agg(F.sum("x.n").alias("n"))
            no_counts = F.array().cast("array<bigint>")
            longer = new.join(total, "lang").select("id", "lang", "n", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", no_counts.alias("starts"), no_counts.alias("rests"))
        else:
            left = often.select(F.col("id").alias("first"), "lang", "n", "phrase", F.array_append("starts", F.col("a")).alias("starts"))
            right = often.select(F.col("id").alias("rest"), "last", F.array_append("rests", F.col("a")).alias("rests"))
            longer = new.select("id", "first", "rest", "a").join(left, "first").join(right, "rest").withColumn("phrase", F.concat_ws(" ", "phrase", "last"))
        longer = written(longer)
        if words > 2:
            found.append(_kept(often, longer, words - 1))
        often = longer
        if words < longest:
            told = merged.where("block IS NOT NULL").select(F.col("block").alias("within"), "part", "at", "ids")
            state = rows.where("part IS NULL").select("block", "own", "places", "sizes", "parts", "ends")
            last, folder = folder, new_folder(docs.sparkSession)
            rows = written(state.groupBy("block").cogroup(told.groupBy("within")).applyInArrow(grower(parts), _ROWS), folder)
            # all that is read from now on is in later tables
            remove(last)
    found.append(_kept(often, None, longest))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*by)
    rows = rows.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= most)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("bigint")).where(F.col("rank") <= most)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _kept(often: DataFrame, longer: DataFrame | None, words: int) -> DataFrame:
    """Scores of phrases of so many words, without those whose every occurrence is inside a longer one. A phrase's count is no
    higher than that of any phrase inside it, so it's enough to look at phrases of one word more."""
    if longer is not None:
        inside = longer.select(F.explode(F.array("first", "rest")).alias("id"), "a").groupBy("id").agg(F.max("a").alias("around"))
        often = often.join(inside, "id", "left").where(F.col("around").isNull() | (F.col("around") < F.col("a")))
    whole = lambda c: f"cast({c} AS decimal(19, 0))"  # noqa: E731  exact: at most 38 digits, an error beyond
    cuts = []
    for k in range(1, words):
        left, right = f"starts[{k - 1}]", f"rests[{words - k - 1}]"
        score = f"(cast(1000 AS decimal(4, 0)) * {whole('a')} * {whole('n')}) div ({whole(left)} * {whole(right)})"
        cuts.append(f"named_struct('score', {score}, 'k', {k}, 'l', {left}, 'r', {right})")
    return often.withColumn("cut", F.expr(f"array_min(array({', '.join(cuts)}))")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k, phrase, count(*) AS a FROM (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
    FROM words, (VALUES (1), (2), (3), (4), (5)) t(k))
  GROUP BY ALL),
total AS (SELECT lang, sum(a)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY 1),
often AS (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE a >= {LEAST}),
cuts AS (
  SELECT o.lang, o.k, o.phrase, o.a, t.c, l.a AS l, r.a AS r, n, (1000::HUGEINT * o.a * n) // (l.a::HUGEINT * r.a) AS score
  FROM often o, (VALUES (1), (2), (3), (4)) t(c), often l, often r, total
  WHERE t.c < o.k AND total.lang = o.lang AND l.lang = o.lang AND r.lang = o.lang
    AND l.phrase = array_to_string(o.w[1 : t.c], ' ') AND r.phrase = array_to_string(o.w[t.c + 1 :], ' ')),
least AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS pick FROM cuts),
inside AS (
  SELECT DISTINCT o.lang, array_to_string(o.w[i : i + m - 1], ' ') AS phrase, o.a
  FROM often o, (VALUES (2), (3), (4)) s(m), (VALUES (1), (2), (3), (4)) t(i) WHERE m < o.k AND i + m - 1 <= o.k),
around AS (SELECT lang, phrase, max(a) AS most FROM inside GROUP BY 1, 2)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT p.lang, row_number() OVER (PARTITION BY p.lang ORDER BY p.score DESC, p.a DESC, p.phrase) AS rank, p.phrase, p.a, p.l, p.r, p.n, p.score::BIGINT AS score
  FROM least p LEFT JOIN around i ON i.lang = p.lang AND i.phrase = p.phrase
  WHERE p.pick = 1 AND (i.most IS NULL OR 100 * i.most < 100 * p.a))
WHERE rank <= {MOST}
"""
