"""Language-model scoring with an Elias-Fano n-gram trie of three levels.

A word is known by a 62-bit hash and numbered by its frequency. Level 1 holds every training token with its exact
count. Levels 2 and 3 hold all n-grams inside a text, however rare. They are dealt over parts by their first two
words, so a part has whole subtrees: words, for each a monotone pointer to the words after it, for each of those a
monotone pointer to the words after both. The successors of a context have a stretch of one monotone sequence, as long
as they are many, and are searched relative to the context's pointer. A successor has its discounted probability, and
a context what the discount leaves to shorter ones, in an 8-bit step of the logarithm. Probabilities interpolate:
p(w|c) = seen(c, w) + left(c) * p(w|shorter c), down to (count + 1) / (N + V + 1), which counts words that were never
seen as one. The first token of a text has no context.

One pass counts words, a second one counts trigrams, whose sums are the bigrams' counts. A word before many others is
spread over as many parts as its count asks for; a pair of words stays in one part, with a row for each word after it from each
block of text, so a very frequent pair makes a large part. Each part is
built by one task from sorted rows, written to the folder of spark.checkpoint.dir and memory-mapped by the workers; a
lost task writes the same file again. The driver removes the files when it ends, unless train() was given a folder.

Rows: null and empty texts have one token, the end. Rows with a null id count as the id "". Repeated rows are
counted and scored each; other columns are not read; without training rows every token is unknown.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import elias_fano
from .common import ASCII_LOWER, checkpoint_root, id_bucket, mapped, remove, ship, slices, table, uri, write
from .elias_fano import EliasFano
from .words import bytes_of, edges, hashes, mix

FOLDS, HELD_OUT = 7, 2
DISCOUNT = 0.75
#: Text bytes that a worker scores at once, those whose tokens are cut at once, and tokens that it counts at once.
CHUNK, BLOCK, MOST_ROWS = 3_000_000, 200_000, (1 << 21) - 4
#: Training tokens of a part of levels 2 and 3; the number of parts follows from it.
PART_TOKENS = 4_000_000
#: A word is spread over one part more for each such share of a part's tokens that it has.
SPREAD = 1 / 8
#: A logarithm takes 256 steps of this size.
STEP = 0.04
WORD_BITS = 62
#: Word numbers are below this; train() fails beyond it.
MOST_WORDS = 1 << 31
MOST_WORD_PARTS = 4_096
#: Up to so many successors are compared one after another.
FEW = 3


def _mix(x: np.ndarray) -> np.ndarray:
    """A 62-bit hash of 64-bit numbers."""
    return (mix(x) >> np.uint64(2)).astype(np.int64)


END = int(_mix(np.array([1], np.uint64))[0])


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each text's end included, and the place after each text's last token."""
    raw, offsets = bytes_of(texts)
    found, ends, before, start = [], [], 0, 0
    while start < len(texts):
        stop = min(len(texts), max(start + 1, int(np.searchsorted(offsets, offsets[start] + BLOCK))))
        own, own_ends = _tokens(raw[offsets[start] : offsets[stop]].translate(ASCII_LOWER), offsets[start : stop + 1] - offsets[start])
        found.append(own)
        ends.append(own_ends + before)
        before += len(own)
        start = stop
    return (np.concatenate(found), np.concatenate(ends)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _tokens(raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lower-cased texts one after another."""
    starts, ends = edges(raw, offsets)
    words_before = np.searchsorted(starts, offsets[1:], side="left")
    return np.insert((hashes(raw, starts, ends) >> np.uint64(2)).astype(np.int64), words_before, END), words_before + np.arange(1, len(offsets))


def _spans(texts: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    return tokens(texts.column(column))


def coded(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, in order, and the place among them of each value."""
    order = np.argsort(flat)
    ranked = flat[order]
    new = np.ones(len(flat), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    places = np.empty(len(flat), np.int64)
    places[order] = np.cumsum(new) - 1
    return ranked[new], places


def runs(ranked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct value of a sorted array starts, and how often it occurs."""
    if not len(ranked):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    return first, np.diff(np.append(first, len(ranked)))


class Gathered:
    """Words with counts, summed up as far as MOST_ROWS allows."""

    def __init__(self) -> None:
        self.parts, self.rows = [], 0

    def add(self, words: np.ndarray) -> bool:
        """Whether there is as much as a worker should hold."""
        words = np.sort(words)
        first, n = runs(words)
        self.parts.append((words[first], n))
        self.rows += len(first)
        if self.rows > MOST_ROWS:
            self._sum()
        return self.rows > MOST_ROWS // 2 and len(self.parts) == 1

    def _sum(self) -> None:
        words, n = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        order = np.argsort(words)
        first, _ = runs(words[order])
        self.parts, self.rows = [(words[order][first], np.add.reduceat(n[order], first) if len(n) else n)], len(first)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self._sum()
        (out,) = self.parts
        self.parts, self.rows = [], 0
        return out


# parcels: the rows of a part as compressed bytes, four planes for each column


def packed(**columns: np.ndarray) -> bytes:
    import zstandard

    arrays = {}
    for name, values in columns.items():
        most = int(values.max(initial=0))
        wide = 8 if most >= 2**32 else 4 if most >= 2**8 else 1
        arrays[name] = np.ascontiguousarray(np.ascontiguousarray(values.astype(f"<u{wide}")).view(np.uint8).reshape(-1, wide).T).ravel()
        arrays[f"{name}.wide"] = np.array([wide], np.uint8)
    return zstandard.compress(elias_fano.dump(arrays), 1)


def unpacked(raw: bytes) -> dict[str, np.ndarray]:
    import zstandard

    arrays, out = elias_fano.parse(zstandard.decompress(raw)), {}
    for name in [n for n in arrays if not n.endswith(".wide")]:
        wide = int(arrays[f"{name}.wide"][0])
        out[name] = np.ascontiguousarray(arrays[name].reshape(wide, -1).T).view(f"<u{wide}").ravel()
    return out


_PARCELS = "part int, rows binary"


def _parcels(parts: np.ndarray, make) -> pa.RecordBatch:
    """A row for each part: its number and what make() packs of its rows (from, to). parts is sorted."""
    first, size = runs(parts)
    blobs = [make(int(a), int(a + n)) for a, n in zip(first, size, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(parts[first], pa.int32()), pa.array(blobs, pa.binary())], names=["part", "rows"])


def _dealt(parcels: DataFrame, parts: int) -> DataFrame:
    """A task for each part."""
    return parcels.repartitionById(parts, "part").sortWithinPartitions("part")


def _each_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict[str, np.ndarray]]]]:
    """All parcels of each part."""
    held: list[dict[str, np.ndarray]] = []
    last = None
    for batch in batches:
        for part, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if held and part != last:
                yield last, held
                held = []
            last = part
            held.append(unpacked(raw.as_buffer()))
    if held:
        yield last, held


def _exact(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts in a byte each, those of 255 and more beside."""
    large = np.flatnonzero(counts >= 255)
    return {"count": np.minimum(counts, 255).astype(np.uint8), "large_at": large, "large": counts[large]}


def _count(arrays: dict[str, np.ndarray], index: np.ndarray) -> np.ndarray:
    out = arrays["count"][index].astype(np.int64)
    large = np.flatnonzero(out == 255)
    out[large] = arrays["large"][np.searchsorted(arrays["large_at"], index[large])]
    return out


def quantise(probability: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(probability, 1e-30)) / STEP), 0, 255).astype(np.uint8)


_STEPS = 10.0 ** (-STEP * np.arange(256))


# levels


def _by_part(parts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    kind = np.uint16 if int(parts.max(initial=0)) < 2**16 else np.int64
    order = np.argsort(parts.astype(kind), kind="stable")
    first, size = runs(parts[order])
    for a, n in zip(first, size, strict=True):
        yield int(parts[order[a]]), order[a : a + n]


class Words:
    """Level 1: hashes with numbers, counts by number, and what a word leaves to shorter contexts. Word number n is
    row n // parts of part n % parts; rows go by falling count."""

    def __init__(self, folder: str, parts: int):
        self.folder, self.parts, self.open, self.left_of = folder, parts, {}, {}

    @staticmethod
    def pack(words: np.ndarray, counts: np.ndarray) -> bytes:
        order = np.argsort(-counts, kind="stable")
        row = np.empty(len(words), np.uint32)
        row[order] = np.arange(len(words), dtype=np.uint32)
        return elias_fano.dump(elias_fano.build(words, 1 << WORD_BITS, "find") | _exact(counts[order]) | {"row": row})

    def _part(self, part: int):
        if part not in self.open:
            arrays = mapped(f"{self.folder}/words", str(part))
            self.open[part] = (EliasFano(arrays), arrays) if arrays else None
        return self.open[part]

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The number of each hash; -1 for an unknown one."""
        out = np.full(len(words), -1, np.int64)
        for part, rows in _by_part(words % self.parts):
            if self._part(part):
                sequence, arrays = self._part(part)
                index = sequence.find(words[rows])
                rows, index = rows[index >= 0], index[index >= 0]
                out[rows] = arrays["row"][index].astype(np.int64) * self.parts + part
        return out

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), np.int64)
        some = np.flatnonzero(numbers >= 0)
        for part, rows in _by_part(numbers[some] % self.parts):
            out[some[rows]] = _count(self._part(part)[1], numbers[some[rows]] // self.parts)
        return out

    def left(self, numbers: np.ndarray) -> np.ndarray:
        """What a context leaves to shorter ones; 1 for a word that isn't there."""
        out = np.ones(len(numbers))
        some = np.flatnonzero(numbers >= 0)
        for part, rows in _by_part(numbers[some] % self.parts):
            if part not in self.left_of:
                self.left_of[part] = mapped(f"{self.folder}/left", str(part))
            if self.left_of[part]:
                out[some[rows]] = _STEPS[self.left_of[part]["left"][numbers[some[rows]] // self.parts]]
        return out


class Shape:
    """The numbers that a trie's files are laid out by.

    Word number n is a context of part n % parts; each of the frequent words, which has more than a share SPREAD of a
    part's tokens, is one of as many parts as it has shares. A part's contexts are all frequent words and then its own.
    """

    def __init__(self, word_parts: int, parts: int, total: int, distinct: int, most: int, frequent: list[tuple[int, int]]):
        self.word_parts, self.parts, self.total, self.distinct = word_parts, parts, total, distinct
        self.numbers = max(1, most * word_parts)
        #: Bits of a word's code: its number, mixed so that codes are spread evenly.
        self.bits = max(1, int(self.numbers - 1).bit_length())
        self.mask = (1 << self.bits) - 1
        frequent = sorted(frequent)
        self.frequent = np.array([n for n, _ in frequent], np.int64)
        self.shares = np.array([min(parts, max(1, -(-count // self.quantum(total, parts)))) for _, count in frequent], np.int64)

    @staticmethod
    def quantum(total: int, parts: int) -> int:
        return max(1, int(total / parts * SPREAD))

    def code(self, numbers: np.ndarray) -> np.ndarray:
        return numbers * 0x9E3779B1 & self.mask

    def place(self, numbers: np.ndarray) -> np.ndarray:
        """Place among the frequent words, -1 for others."""
        if not len(self.frequent):
            return np.full(len(numbers), -1, np.int64)
        at = np.minimum(np.searchsorted(self.frequent, numbers), len(self.frequent) - 1)
        return np.where(self.frequent[at] == numbers, at, -1)

    def dealt(self, number: np.ndarray, place: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The part of each pair of words; place is the first one's among the frequent words."""
        part = number % self.parts
        some = np.flatnonzero(place >= 0)
        share = _mix(after[some].astype(np.uint64) + np.uint64(1 << 40)) % self.shares[place[some]]
        part[some] = (number[some] + share) % self.parts
        return part

    def contexts(self, part: int) -> int:
        return len(self.frequent) + (self.numbers - part + self.parts - 1) // self.parts

    def context(self, number: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.where(place >= 0, place, len(self.frequent) + number // self.parts)

    def number(self, context: np.ndarray, part: int) -> np.ndarray:
        many = len(self.frequent)
        own = (context - many) * self.parts + part
        return np.where(context >= many, own, np.append(self.frequent, 0)[np.minimum(context, many)])

    def stretch(self, codes: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A successor's value in the monotone sequence: a context has as much of it as it has successors. The factor
        is odd, so the low bits alone tell the successors of a context apart."""
        return (first << self.bits) + codes * (size - 1 | 1)


class Part:
    """Levels 2 and 3 of the pairs of a part."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.second, self.third = (EliasFano(arrays, p) for p in ("s_", "t_"))
        self.to_second, self.to_third = (EliasFano(arrays, p) for p in ("p_", "q_"))
        self.seen2, self.left3, self.seen3 = (arrays[k] for k in ("seen2", "left3", "seen3"))

    @staticmethod
    def pack(shape: Shape, part: int, words: Words, pairs: np.ndarray, after: np.ndarray, n: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """From sorted rows of a pair (context << 32 | code), the code after it (-1 for none) and a count: the part, its
        words' numbers, and how many different words follow each of them in it."""
        at, _ = runs(pairs)
        own = pairs[at]
        count = np.add.reduceat(n, at) if len(at) else n
        first, followers = runs(own >> 32)
        context = own[first] >> 32
        numbers = shape.number(context, part)
        seen2 = (count - DISCOUNT) / np.repeat(words.counts(numbers), followers)
        more = after >= 0
        kinds = np.add.reduceat(more.astype(np.int64), at) if len(at) else count
        start = np.cumsum(kinds) - kinds
        pointers = np.zeros(shape.contexts(part) + 1, np.int64)
        pointers[context + 1] = followers
        stretch = lambda codes, a, size: shape.stretch(codes, np.repeat(a, size), np.repeat(size, size))
        sequences = {
            "p_": (np.cumsum(pointers), len(own) + 1, "get"),
            "s_": (stretch(own & 0xFFFFFFFF, first, followers), (len(own) << shape.bits) + 1, "find"),
            "q_": (np.append(start, kinds.sum()), int(kinds.sum()) + 1, "get"),
            "t_": (stretch(after[more], start, kinds), (int(kinds.sum()) << shape.bits) + 1, "find"),
        }
        out = {}
        for prefix, (values, universe, wants) in sequences.items():
            out |= {prefix + k: v for k, v in elias_fano.build(values, universe, wants).items()}
        seen3 = (n[more] - DISCOUNT) / np.repeat(count, kinds)
        out |= {"seen2": quantise(seen2), "left3": quantise(np.maximum(DISCOUNT * kinds / count, 1e-9)), "seen3": quantise(seen3)}
        return elias_fano.dump(out), numbers, followers

    @staticmethod
    def among(sequence: EliasFano, shape: Shape, first: np.ndarray, size: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The index of each code among the successors from first on; -1 where it isn't there."""
        out = np.full(len(first), -1, np.int64)
        if not sequence.n:
            return out
        low = codes * (size - 1 | 1) & shape.mask
        todo = np.flatnonzero((size > 0) & (size <= FEW))
        for k in range(FEW):
            index = first[todo] + k
            hit = sequence.is_low(index, low[todo])
            out[todo[hit]] = index[hit]
            todo = todo[(size[todo] > k + 1) & (out[todo] < 0)]
        many = np.flatnonzero(size > FEW)
        out[many] = sequence.find(shape.stretch(codes[many], first[many], size[many]))
        return out


class Model:
    """The trie as a worker sees it: a folder and a few numbers."""

    def __init__(self, folder: str, shape: Shape):
        self.folder, self.shape, self.total = folder, shape, shape.total

    def opened(self) -> Model:
        self.words, self.parts = Words(self.folder, self.shape.word_parts), {}
        return self

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("folder", "shape", "total")}

    def remove(self) -> None:
        """Delete the trie's files."""
        remove(self.folder)

    def _part(self, part: int) -> Part | None:
        if part not in self.parts:
            arrays = mapped(f"{self.folder}/grams", str(part))
            self.parts[part] = Part(arrays) if arrays else None
        return self.parts[part]

    def _stretches(self, numbers: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the successors of each word that is not frequent start in its part, and how many they are."""
        first, size = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        some = np.flatnonzero((numbers >= 0) & (place < 0))
        for part, rows in _by_part(numbers[some] % self.shape.parts):
            if own := self._part(part):
                rows = some[rows]
                first[rows], size[rows] = own.to_second.span(self.shape.context(numbers[rows], place[rows]))
        return first, size

    def scores(self, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: tokens known, base score and score."""
        shape = self.shape
        names, word = coded(flat)
        numbers = self.words.numbers(names)
        counts, left, frequent = self.words.counts(numbers), self.words.left(numbers), shape.place(numbers)
        chance = (counts + 1) / (shape.total + shape.distinct + 1)
        starts = np.concatenate([[0], ends[:-1]])
        base = np.add.reduceat(np.log10(chance)[word], starts)
        p = chance[word]
        is_known = (counts > 0)[word]
        known = np.add.reduceat(is_known.astype(np.int64), starts)
        inside = np.ones(len(flat), bool)
        inside[starts] = False
        p[1:] *= np.where(inside[1:], left[word[:-1]], 1.0)
        # pairs of known words, by their second place
        at = np.flatnonzero(inside[1:] & is_known[1:] & is_known[:-1]) + 1
        before = word[at - 1]
        number, code = numbers[word[at]], shape.code(numbers)[word]
        first, size = (x[before] for x in self._stretches(numbers, frequent))
        often = frequent[before]
        seen2, left3, seen3 = np.zeros(len(flat)), np.ones(len(flat) + 1), np.zeros(len(flat) + 1)
        # whether the next token is of the same text and known
        goes_on = np.append(inside[1:] & is_known[1:], False)
        for part, rows in _by_part(shape.dealt(numbers[before], often, number)):
            own = self._part(part)
            if own is None:
                continue
            many = rows[often[rows] >= 0]
            first[many], size[many] = own.to_second.span(often[many])
            pair = own.among(own.second, shape, first[rows], size[rows], code[at[rows]])
            found = pair >= 0
            rows, pair = at[rows[found]], pair[found]
            seen2[rows] = _STEPS[own.seen2[pair]]
            left3[rows + 1] = _STEPS[own.left3[pair]]
            on = goes_on[rows]
            rows, pair = rows[on] + 1, pair[on]
            third = own.among(own.third, shape, *own.to_third.span(pair), code[rows])
            found = third >= 0
            seen3[rows[found]] = _STEPS[own.seen3[third[found]]]
        left3[:-1][starts] = 1
        p += seen2
        p *= left3[:-1]
        p += seen3[:-1]
        return known, base, np.add.reduceat(np.log10(p), starts)


def _word_parts(spark: SparkSession) -> int:
    return min(MOST_WORD_PARTS, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _trigrams(word: np.ndarray, inside: np.ndarray, most: int) -> np.ndarray:
    """Of words below 2 ** 21: each of the first pairs inside a text with the word after it (0 for none, else one more)
    in one number, sorted. inside: whether a token goes on a text."""
    rows = min(most, len(word) - 1)
    after = np.zeros(rows, np.int64)
    there = min(rows, len(word) - 2)
    after[:there] = np.where(inside[2 : there + 2], word[2 : there + 2] + 1, 0)
    key = (word[:rows] << 42) + (word[1 : rows + 1] << 21) + after
    return np.sort(key[inside[1 : rows + 1]])


def _packed_rows(shape: Shape, numbers: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    """The parcels of sorted trigrams; numbers are those of their words."""
    first, n = runs(key)
    key = key[first]
    pair_at, kinds = runs(key >> 21)
    after = np.concatenate([[0], numbers + 1])[key & (1 << 21) - 1]
    pair = key[pair_at] >> 21
    one, two = numbers[pair >> 21], numbers[pair & (1 << 21) - 1]
    part = shape.dealt(one, shape.place(numbers)[pair >> 21], two)
    order = np.argsort(part.astype(np.uint16) if shape.parts < 2**16 else part, kind="stable")
    one, two, kinds, part = one[order], two[order], kinds[order], part[order]
    ends = np.cumsum(kinds)
    rows = np.repeat(pair_at[order] - (ends - kinds), kinds) + np.arange(len(key))
    after, n = after[rows], n[rows]

    def make(a: int, b: int) -> bytes:
        x, y = ends[a] - kinds[a], ends[b - 1]
        return packed(first=np.diff(one[a:b], prepend=0), second=two[a:b], kinds=kinds[a:b], after=after[x:y], n=n[x:y])

    return _parcels(part, make)


def train(docs: DataFrame, folder: str | None = None) -> Model:
    """Build the trie from all rows of docs, in a folder of its own below the shared one if none is named."""
    spark = docs.sparkSession
    ship(spark)
    word_parts, kept = _word_parts(spark), folder is not None
    folder = uri(folder if kept else f"{checkpoint_root(spark).rstrip('/')}/ngram-{uuid.uuid4().hex}")
    if not kept:
        atexit.register(remove, folder)
    texts = docs.select("text")

    def words(batches):
        held = Gathered()

        def out():
            word, n = held.take()
            order = np.argsort(word % word_parts, kind="stable")
            word, n = word[order], n[order]
            return _parcels(word % word_parts, lambda a, b: packed(word=word[a:b], n=n[a:b]))

        for batch in batches:
            for piece in slices(batch, "text", CHUNK):
                if held.add(_spans(piece, 0)[0]):
                    yield out()
        if held.parts:
            yield out()

    def build_words(batches):
        for part, parcels in _each_part(batches):
            word = np.concatenate([x["word"] for x in parcels]).astype(np.int64)
            n = np.concatenate([x["n"] for x in parcels]).astype(np.int64)
            order = np.argsort(word)
            first, _ = runs(word[order])
            n = np.add.reduceat(n[order], first)
            write(f"{folder}/words", str(part), Words.pack(word[order][first], n))
            yield pa.RecordBatch.from_arrays([pa.array([int(n.sum())]), pa.array([len(n)])], names=["total", "kinds"])

    built = _dealt(texts.mapInArrow(words, _PARCELS), word_parts).mapInArrow(build_words, "total bigint, kinds bigint")
    zero = F.lit(0).cast("bigint")
    total, kinds, most = built.agg(*(F.coalesce(x, zero) for x in (F.sum("total"), F.sum("kinds"), F.max("kinds")))).first()
    if most * word_parts >= MOST_WORDS:
        raise ValueError(f"word numbers reach {most * word_parts}; the limit is {MOST_WORDS}")
    parts = max(8, -(-int(total) // PART_TOKENS))
    quantum = Shape.quantum(int(total), parts)

    def frequent(batches):
        level = Words(folder, word_parts)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                if level._part(part):
                    counts = level.counts(np.arange(len(level._part(part)[1]["row"])) * word_parts + part)
                    rows = np.flatnonzero(counts > quantum)
                    yield pa.RecordBatch.from_arrays([pa.array(rows * word_parts + part), pa.array(counts[rows])], names=["number", "count"])

    # at most parts / SPREAD rows
    found = spark.range(0, word_parts, 1, word_parts).mapInArrow(frequent, "number bigint, count bigint").collect()
    shape = Shape(word_parts, parts, int(total), int(kinds), int(most), [tuple(row) for row in found])

    def grams(batches):
        level = Words(folder, word_parts)

        def out(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            flat = np.concatenate([f for f, _ in held])
            inside = np.ones(len(flat), bool)
            at = 0
            for own, ends in held:
                inside[at] = False
                inside[at + ends[:-1]] = False
                at += len(own)
            held.clear()
            for start in range(0, len(flat) - 1, MOST_ROWS):
                names, word = coded(flat[start : start + MOST_ROWS + 2])
                numbers = level.numbers(names)
                order = np.argsort(numbers)
                numbers, back = numbers[order], np.empty(len(order), np.int64)
                back[order] = np.arange(len(order))
                key = _trigrams(back[word], inside[start : start + MOST_ROWS + 2], MOST_ROWS)
                if len(key):
                    yield _packed_rows(shape, numbers, key)

        held, size = [], 0
        for batch in batches:
            for piece in slices(batch, "text", CHUNK):
                flat, ends = _spans(piece, 0)
                if held and size + len(flat) > MOST_ROWS:
                    yield from out(held)
                    size = 0
                held.append((flat, ends))
                size += len(flat)
        if held:
            yield from out(held)

    def build_grams(batches):
        level = Words(folder, word_parts)
        for part, parcels in _each_part(batches):
            pairs, after, n = [], [], []
            for x in parcels:
                first = np.cumsum(x["first"].astype(np.int64))
                pairs.append(np.repeat(shape.context(first, shape.place(first)) << 32 | shape.code(x["second"].astype(np.int64)), x["kinds"]))
                number = x["after"].astype(np.int64) - 1
                after.append(np.where(number >= 0, shape.code(number), -1))
                n.append(x["n"].astype(np.int64))
            parcels.clear()
            pairs, after, n = map(np.concatenate, (pairs, after, n))
            distinct, place = coded(pairs)
            key = place << 32 | (after + 1)
            del pairs, after, place
            order = np.argsort(key)
            key = key[order]
            first, _ = runs(key)
            n = np.add.reduceat(n[order], first)
            key = key[first]
            del order, first
            raw, numbers, followers = Part.pack(shape, part, level, distinct[key >> 32], (key & 0xFFFFFFFF) - 1, n)
            write(f"{folder}/grams", str(part), raw)
            order = np.argsort(numbers % word_parts, kind="stable")
            numbers, followers = numbers[order], followers[order]
            yield _parcels(numbers % word_parts, lambda a, b, w=numbers, f=followers: packed(row=w[a:b] // word_parts, kinds=f[a:b]))

    def build_left(batches):
        level = Words(folder, word_parts)
        for part, parcels in _each_part(batches):
            rows = len(level._part(part)[1]["row"])
            kinds = np.zeros(rows, np.int64)
            for x in parcels:
                np.add.at(kinds, x["row"].astype(np.int64), x["kinds"].astype(np.int64))
            counts = level.counts(np.arange(rows) * word_parts + part)
            write(f"{folder}/left", str(part), elias_fano.dump({"left": quantise(np.maximum(DISCOUNT * kinds / counts, 1e-9))}))
            yield pa.RecordBatch.from_arrays([pa.array([rows])], names=["rows"])

    built = _dealt(texts.mapInArrow(grams, _PARCELS), parts).mapInArrow(build_grams, _PARCELS)
    _dealt(built, word_parts).mapInArrow(build_left, "rows bigint").agg(F.sum("rows")).first()
    return Model(folder, shape)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score and score."""
    ship(docs.sparkSession)
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.opened()
        for batch in batches:
            for piece in slices(batch, "text", CHUNK):
                flat, ends = _spans(piece, 1)
                known, base, full = own.scores(flat, ends)
                sizes = np.diff(np.concatenate([[0], ends]))
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(x) for x in (sizes, known, np.full(len(sizes), own.total), base, full))], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(id_bucket("doc_id", FOLDS) != HELD_OUT))
    return score(docs, model).select("doc_id", (id_bucket("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
