"""Words of many texts at once, as places and 64-bit hashes in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of a word that are hashed eight at a time; longer ones go through xxhash.
LONG_WORD = 64
_ODD = np.random.default_rng(5).integers(0, 2**63, LONG_WORD // 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Masks of the first n bytes of a 64-bit number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def bytes_of(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """The UTF-8 of all texts one after another, and where each starts (one more entry for the end). Null is empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    kind = np.int32 if pa.types.is_string(texts.type) else np.int64
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    cut = b"" if raw is None else raw.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes()
    return cut, offsets - offsets[0]


def edges(raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words [^\\x20\\x09-\\x0D]+ of texts one after another start and end."""
    data = np.frombuffer(raw, np.uint8)
    space = data == 32
    space |= data - np.uint8(9) < 5
    before, after = np.ones(len(raw) + 1, bool), np.ones(len(raw) + 1, bool)
    before[1:], after[:-1] = space, space
    before[offsets] = after[offsets] = True
    word = ~space
    return np.flatnonzero(word & before[:-1]), np.flatnonzero(word & after[1:]) + 1


def hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words at these places."""
    sizes = ends - starts
    data = np.frombuffer(raw + bytes(8), np.uint8)
    eights = np.ndarray((len(data) - 7,), np.dtype("<u8"), data, 0, (1,))
    out = (eights[starts] & _FIRST[np.minimum(sizes, 8)]) * _ODD[0] + sizes.astype(np.uint64)
    more = np.flatnonzero(sizes > 8)
    for k in range(1, LONG_WORD // 8):
        if not len(more):
            break
        out[more] = (out[more] ^ out[more] >> np.uint64(29)) * _ODD[k] + (eights[starts[more] + 8 * k] & _FIRST[np.minimum(sizes[more] - 8 * k, 8)])
        more = more[sizes[more] > 8 * (k + 1)]
    out = mix(out)
    if len(more):
        import xxhash

        out[more] = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts[more], ends[more], strict=True)]
    return out


#: Bytes from which a text is read part by part.
LONG_TEXT = 8_000_000


def text_parts(raw: bytes, offsets: np.ndarray, gap: re.Pattern[bytes], most: int = LONG_TEXT) -> Iterator[tuple[bytes, np.ndarray]]:
    """Texts one after another as they come, or, where they are longer than most bytes, part by part: a part ends after a
    match of gap, so nothing that gap keeps apart is cut. Offsets always have an entry for each text."""
    start = 0
    while len(raw) - start > most:
        found = gap.search(raw, start + most)
        if not found:
            break
        yield raw[start : found.end()], np.clip(offsets - start, 0, found.end() - start)
        start = found.end()
    yield (raw[start:] if start else raw), np.clip(offsets - start, 0, len(raw) - start)
