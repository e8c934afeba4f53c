"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned by token windows and verified.

Windows of items are known by 64-bit hashes, sorted in one array with the item and the place of each window's words;
a bit table in front passes few other windows of documents on. A window of a document with an item's hash is a hit only
if the words are the same. Items of up to MOST_BROADCAST_BYTES of text are broadcast; a larger table is cut into blocks
of that size, which are written to the folder of spark.checkpoint.dir one after another and memory-mapped by the
workers, which hold documents against one block after another.

Rows: null or empty texts have no words and no hits; test items that are null or empty have no window; item ids
that repeat count once. Repeated rows are judged each, other columns of whatever name are carried along untouched by
clean() and not read by report(), and an empty table of documents or of items gives an empty result or one without hits.
"""

from __future__ import annotations

import atexit
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import elias_fano
from .common import checkpoint_root, map_by_place, mapped, remove, ship, slices, table, tidy, uri, write
from .words import bytes_of, edges, hashes, mix

WINDOW = 10
#: Bytes of item text in one broadcast set, and in a block of a larger table.
MOST_BROADCAST_BYTES = 16_000_000
#: Keeps a-z, 0-9 and all bytes from 0x80, lowers A-Z, turns the rest into spaces.
_WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the table in front of the sorted hashes, for each of them.
FRONT_BITS = 16


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


class Words:
    """The words of many texts: where they are, and their hashes. ends: the place after each text's last word."""

    def __init__(self, texts: pa.Array):
        raw, offsets = bytes_of(texts)
        self.raw = raw.translate(_WORD_BYTES)
        self.starts, self.stops = edges(self.raw, offsets)
        self.ends = np.searchsorted(self.starts, offsets[1:], side="left")
        self.hashes = hashes(self.raw, self.starts, self.stops)
        self.offsets = offsets

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of all windows of n words inside a text."""
        count = len(self.hashes) - n + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        value = np.zeros(count, np.uint64)
        for k in range(n):
            value = value * _FACTOR + self.hashes[k : k + count]
        sizes = np.diff(self.ends, prepend=0)
        left = np.repeat(self.ends, sizes)[:count] - np.arange(count)
        at = np.flatnonzero(left >= n)
        return at, mix(value[at])

    def text(self, at: int, n: int) -> bytes:
        """The words of a window with one space between."""
        cut = self.raw[self.starts[at] : self.stops[at + n - 1]]
        return b" ".join(cut.split()) if b"  " in cut else cut


def windows_of(items: list[tuple[object, str | None]]) -> dict[str, np.ndarray]:
    """The set of the items' windows as named arrays: lengths, and for each length n the sorted hashes (hash_n), the item
    (item_n) and the place (at_n) of each in the items' words, with the front table (front_n)."""
    names = sorted({str(item_id) for item_id, text in items if words_of(text)})
    number = {name: i for i, name in enumerate(names)}
    items = [(number[str(item_id)], text) for item_id, text in items if words_of(text)]
    words = Words(pa.array([text for _, text in items], pa.large_string()))
    sizes = np.diff(words.ends, prepend=0)
    owner = np.repeat(np.array([i for i, _ in items], np.int64), sizes)
    raw_names = [name.encode() for name in names]
    out = {
        "raw": np.frombuffer(words.raw, np.uint8), "starts": words.starts, "stops": words.stops,
        "names": np.frombuffer(b"".join(raw_names), np.uint8), "name_ends": np.cumsum([0, *map(len, raw_names)]),
    }
    lengths = sorted(set(np.minimum(sizes, WINDOW).tolist()))
    for n in lengths:
        at, value = words.windows(n)
        if n < WINDOW:
            # items of just so many words
            whole = np.flatnonzero(sizes == n)
            some = np.isin(at, (words.ends - sizes)[whole])
            at, value = at[some], value[some]
        order = np.lexsort((owner[at], value))
        at, value = at[order], value[order]
        bits = max(10, int(len(value) * FRONT_BITS - 1).bit_length())
        front = np.zeros(1 << bits, bool)
        front[(value & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
        out |= {f"hash_{n}": value, f"item_{n}": owner[at], f"at_{n}": at, f"front_{n}": np.packbits(front, bitorder="little")}
    return out | {"lengths": np.array(lengths, np.int64)}


class Set:
    """A set of windows that documents are held against."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays, self.raw = arrays, arrays["raw"]
        ends = arrays["name_ends"].tolist()
        names = arrays["names"].tobytes()
        self.names = [names[a:b].decode() for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _text(self, at: int, n: int) -> bytes:
        cut = self.raw[self.arrays["starts"][at] : self.arrays["stops"][at + n - 1]].tobytes()
        return b" ".join(cut.split()) if b"  " in cut else cut

    def hits(self, words: Words) -> Iterator[tuple[int, int, set[str]]]:
        """Place and length of each window that occurs, with the items that have it."""
        for n in self.arrays["lengths"].tolist():
            at, value = words.windows(n)
            front, known = self.arrays[f"front_{n}"], self.arrays[f"hash_{n}"]
            low = (value & np.uint64(8 * len(front) - 1)).astype(np.int64)
            some = np.flatnonzero(front[low >> 3] >> (low & 7).astype(np.uint8) & 1)
            at, value = at[some], value[some]
            first, last = np.searchsorted(known, value, side="left"), np.searchsorted(known, value, side="right")
            some = np.flatnonzero(first < last)
            for i, a, b in zip(at[some].tolist(), first[some].tolist(), last[some].tolist(), strict=True):
                own = words.text(i, n)
                items = {int(self.arrays[f"item_{n}"][e]) for e in range(a, b) if self._text(int(self.arrays[f"at_{n}"][e]), n) == own}
                if items:
                    yield i, n, {self.names[x] for x in items}


class Findings:
    """Of many texts: their numbers of words, merged word spans that occurring windows cover, and their items."""

    def __init__(self, texts: pa.Array, sets: list[Set]):
        self.words = Words(texts)
        found: dict[int, list[tuple[int, int]]] = {}
        self.items: dict[int, set[str]] = {}
        self.begins = self.words.ends - np.diff(self.words.ends, prepend=0)
        for windows in sets:
            for at, n, items in windows.hits(self.words):
                row = int(np.searchsorted(self.words.ends, at, side="right"))
                found.setdefault(row, []).append((at, at + n))
                self.items.setdefault(row, set()).update(items)
        self.spans = {row: merge(spans) for row, spans in found.items()}
        self.n_words = np.diff(self.words.ends, prepend=0)
        self.n_hit = np.zeros(len(texts), np.int64)
        for row, spans in self.spans.items():
            self.n_hit[row] = sum(b - a for a, b in spans)

    def cut(self, row: int, text: str) -> str:
        """The text without the bytes of each span of words; one space stands in for each span."""
        raw, base = text.encode("utf-8", "surrogatepass"), int(self.words.offsets[row])
        out, last = [], 0
        for start, end in self.spans[row]:
            out += [raw[last : int(self.words.starts[start]) - base], b" "]
            last = int(self.words.stops[end - 1]) - base
        return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _sets(bench: DataFrame, most: int):
    """What gives a worker its sets of windows: a broadcast, or files of the shared folder."""
    spark = bench.sparkSession
    items = bench.select("item_id", "text").where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // most))
    if blocks == 1:
        shared = spark.sparkContext.broadcast(windows_of([tuple(row) for row in items.collect()]))
        return lambda: [Set(shared.value)]
    folder = uri(f"{checkpoint_root(spark).rstrip('/')}/windows-{uuid.uuid4().hex}")
    atexit.register(remove, folder)
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        write(folder, str(block), elias_fano.dump(windows_of([tuple(row) for row in part.collect()])))
    return lambda: [Set(mapped(folder, str(block))) for block in range(blocks)]


def report(docs: DataFrame, bench: DataFrame, most: int = MOST_BROADCAST_BYTES) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    ship(docs.sparkSession)
    sets = _sets(bench, most)
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    none = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sets()
        for batch in batches:
            for piece in slices(batch, "text"):
                found = Findings(piece.column(1), own)
                items = [found.items.get(row, ()) for row in range(piece.num_rows)]
                digests = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() if x else none for x in items]
                columns = [found.n_words, found.n_hit, np.fromiter(map(len, items), np.int64, len(items)), digests, found.n_hit > 0]
                yield pa.RecordBatch.from_arrays([piece.column(0), *map(pa.array, columns)], names=names)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")


def clean(docs: DataFrame, bench: DataFrame, most_hit: float = 0.5, most: int = MOST_BROADCAST_BYTES) -> DataFrame:
    """docs without their contaminated words: documents hit in more than most_hit of their words go, in others
    the text from a hit span's first word to its last is cut out. Columns stay as they are."""
    ship(docs.sparkSession)
    sets, at = _sets(bench, most), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sets()
        for batch in batches:
            for piece in slices(batch, at):
                found = Findings(piece.column(at), own)
                if found.spans:
                    texts = piece.column(at).to_pylist()
                    for row in found.spans:
                        texts[row] = found.cut(row, texts[row])
                    columns = [pa.array(texts, c.type) if i == at else c for i, c in enumerate(piece.columns)]
                    piece = pa.RecordBatch.from_arrays(columns, schema=piece.schema)
                    piece = piece.filter(pa.array(found.n_hit <= most_hit * found.n_words))
                yield piece

    return map_by_place(docs, tidy(run), docs.schema)


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def brute(docs: list[tuple[int, str | None]], bench: list[tuple[int, str | None]]) -> list[tuple]:
    """The same answer by comparing every window with every position."""
    out = []
    for doc_id, text in docs:
        words, hit, ids = words_of(text), set(), set()
        for item_id, item in bench:
            other = words_of(item)
            n = min(WINDOW, len(other))
            for i in range(len(other) - n + 1 if n else 0):
                for j in range(len(words) - n + 1):
                    if words[j : j + n] == other[i : i + n]:
                        hit |= set(range(j, j + n))
                        ids.add(str(item_id))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(ids), digest, bool(hit)))
    return out
