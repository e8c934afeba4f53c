"""Token counts with overlap resynchronisation for huge documents.

A huge text is encoded in overlapping chunks. Encoders of this kind first split a text into pieces by a pattern
that reads left to right and looks one character ahead, and then work inside each piece. So if two chunks both
start a piece at the same character, with that character well before the left chunk's end, all that follows is
the same in both: the splice is proven there. Where no such character exists in the overlap, it is widened.
Special strings are found first and the pattern reads what lies between them, as the library does; a special string
that a chunk's edge cuts is no piece of both chunks, so no splice lies in it.

Rows: null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted each; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship, slices, table

#: Characters of a chunk, of the overlap, and of the left chunk's end that no splice may touch.
CHUNK, OVERLAP, MARGIN = 65_536, 1_024, 32
#: Texts from this length are encoded in chunks.
HUGE = 65_536
LIMIT = 512
#: The ranks encoder serves texts of these characters only, where the libraries split alike, and pieces up to this length.
_PLAIN = re.compile(r"[\x00-ɏ‐-‧]*")
_LONG_PIECE = re.compile(r"[^\W\d_]{400}|\d{400}|\s{400}|[^\w\s]{400}|\S{400}")


@lru_cache(maxsize=4)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def ranks_encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _pattern(pattern: str):
    import regex

    return regex.compile(pattern)


class Counter:
    """Counts tokens of whole texts as the tokenizer file gives them.

    ranks: the same vocabulary as a rank file and its pattern; it serves texts on which both encoders agree.
    """

    def __init__(self, path: str, ranks: tuple[str, str] | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, huge: int = HUGE):
        self.encoder = library(path)
        self.ranks = ranks_encoder(*ranks) if ranks else None
        self.specials = [t.content for t in self.encoder.get_added_tokens_decoder().values()]
        # of two special strings that start at the same place, the longer one
        either = "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))
        self.special = re.compile(either) if self.specials else None
        self.special_kept = re.compile(f"({either})")
        self.pattern = _pattern(ranks[1]) if ranks else None
        self.chunk, self.overlap, self.huge = chunk, overlap, huge
        self.margin = MARGIN + 2 * max([0, *map(len, self.specials)])

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.ranks and _PLAIN.fullmatch(text) and not _LONG_PIECE.search(text):
            return self._by_ranks(text) if len(text) < self.huge else self._spliced(text, self._pieces_by_ranks)
        return self._whole(text) if len(text) < self.huge else self._spliced(text, self._pieces)

    def _whole(self, text: str) -> int:
        return len(self.encoder.encode(text, add_special_tokens=False))

    def _by_ranks(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(len(self.ranks.encode_ordinary(part)) for part in parts if part)

    def _pieces(self, text: str) -> tuple[list[int], list[int]]:
        """Characters at which pieces start, and the number of tokens before each of them."""
        coded = self.encoder.encode(text, add_special_tokens=False)
        starts, before, last = [], [], object()
        for at, (word, (start, _)) in enumerate(zip(coded.word_ids, coded.offsets, strict=True)):
            if word is None or word != last:
                starts.append(start)
                before.append(at)
            last = word
        return starts, before

    def _pieces_by_ranks(self, text: str) -> tuple[list[int], list[int]]:
        starts, before, at, count = [], [], 0, 0
        for part in self.special_kept.split(text) if self.special else [text]:
            if part in self.specials:
                starts.append(at)
                before.append(count)
                at, count = at + len(part), count + 1
                continue
            for piece in self.pattern.findall(part):
                starts.append(at)
                before.append(count)
                at, count = at + len(piece), count + len(self.ranks.encode_ordinary(piece))
        return starts, before

    def _spliced(self, text: str, pieces) -> int:
        total, start, skipped = 0, 0, 0
        left = None
        while True:
            end = start + self.chunk
            overlap = self.overlap
            if left is None:
                left = pieces(text[start : end + overlap])
            if end + overlap >= len(text):
                return total + self._all(text[start:]) - skipped
            while True:
                right = pieces(text[end : end + self.chunk + self.overlap])
                splice = self._common(start, end, min(len(text), end + overlap), left, right)
                if splice or end + overlap >= len(text):
                    break
                overlap *= 2
                left = pieces(text[start : end + overlap])
            if not splice:
                return total + self._all(text[start:]) - skipped
            before_left, before_right = splice
            total += before_left - skipped
            start, skipped, left = end, before_right, right

    def _all(self, text: str) -> int:
        return self._by_ranks(text) if self.ranks and _PLAIN.fullmatch(text) and not _LONG_PIECE.search(text) else self._whole(text)

    def _common(self, start: int, end: int, stop: int, left, right) -> tuple[int, int] | None:
        """Tokens before the first proven common start of a piece, in the left and in the right chunk."""
        there = {end + at: n for at, n in zip(*right, strict=True) if at}
        for at, n in zip(*left, strict=True):
            if start + at in there and start + at < stop - self.margin:
                return n, there[start + at]
        return None


def count_tokens(docs: DataFrame, path: str, ranks: tuple[str, str] | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for each row of docs. path: a tokenizer file on every executor."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, ranks)
        for batch in batches:
            for piece in slices(batch, "text"):
                texts = piece.column(1).to_pylist()
                counts = [counter.count(t) for t in texts]
                sizes = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
                over = [n > limit for n in counts]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(over)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ranks)
