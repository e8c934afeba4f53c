"""Elias-Fano sequences in numpy: monotone integers in about 2 + log2(universe / n) bits each.

The low bits of each value are kept in planes of 16, 8 or 4 bits, the lowest first; the high bits are a unary bit
vector, in which a zero closes each bucket of equal high bits. Selection of a zero or a one starts from a sample of every 16th and looks at one 64-bit window; a
block of 16 that is longer than a window has its places written out, so that no block costs more than another. All
queries take arrays.
"""

from __future__ import annotations

import json
import mmap

import numpy as np

_EVERY = 16
#: Bits of a window that are there whatever bit of a byte it starts at.
_WINDOW = 57
#: _AFTER[byte * 8 + r]: place after the r-th one (from 0) of a byte.
_AFTER = np.zeros(256 * 8, np.uint64)
for _byte in range(256):
    for _r, _place in enumerate(i for i in range(8) if _byte >> i & 1):
        _AFTER[_byte * 8 + _r] = _place + 1
_U = np.uint64
_EACH, _TOPS = _U(0x0101010101010101), _U(0x8080808080808080)
_PAIRS, _FOURS, _HALVES = _U(0x5555555555555555), _U(0x3333333333333333), _U(0x0F0F0F0F0F0F0F0F)


def _directory(places: np.ndarray, last: int) -> dict[str, np.ndarray]:
    """Of sorted bit places: where each block of 16 starts (after the last bit of the block before), or -1 - row of
    the table of long blocks, which has the start and the place after each bit."""
    count = len(places)
    starts = np.concatenate([[0], places[_EVERY - 1 :: _EVERY] + 1])
    ends = np.append(places[_EVERY - 1 :: _EVERY], places[-1] if count else -1)[: len(starts)]
    long = np.flatnonzero(ends - starts >= _WINDOW)
    kind = np.int32 if last < 2**31 else np.int64
    table = np.zeros((len(long), _EVERY + 1), kind)
    table[:, 0] = starts[long]
    for i in range(_EVERY):
        table[:, i + 1] = places[np.minimum(long * _EVERY + i, count - 1)] + 1
    starts[long] = -1 - np.arange(len(long))
    return {"at": starts.astype(kind), "long": table.ravel()}


def _planes(width: int) -> list[tuple[int, int]]:
    """Shift and bits of the planes of so many low bits."""
    out = [(shift, 16) for shift in range(0, width - 15, 16)]
    rest = width % 16
    return out + ([(width - rest, 4 if rest <= 4 else 8 if rest <= 8 else 16)] if rest else [])


def build(values: np.ndarray, universe: int, wants: str = "get find") -> dict[str, np.ndarray]:
    """Arrays of a sequence of sorted values below universe; wants names the queries that it is to answer."""
    values = np.asarray(values, np.int64)
    n = len(values)
    width = min(56, max(0, int(universe // max(n, 1)).bit_length() - 1))
    high = values >> width
    buckets = (int(universe) >> width) + 1
    bits = np.zeros(n + buckets, np.uint8)
    ones = high + np.arange(n)
    bits[ones] = 1
    pad = np.zeros(8, np.uint8)
    out = {"head": np.array([n, width, buckets], np.int64), "high": np.concatenate([np.packbits(bits, bitorder="little"), pad])}
    for shift, kind in _planes(width):
        plane = (values >> shift).astype(np.uint8 if kind == 4 else f"<u{kind // 8}")
        if kind == 4:
            plane = np.append(plane & 15, np.zeros(n % 2, np.uint8))
            plane = plane[::2] | plane[1::2] << 4
        elif shift + kind > width:
            plane &= (1 << width - shift) - 1
        out[f"low_{shift}"] = plane
    if width % 4 and _planes(width)[-1][1] == 4:
        out[f"low_{_planes(width)[-1][0]}"] &= ((1 << width % 4) - 1) * 17
    if "find" in wants:
        out |= {f"zero_{k}": v for k, v in _directory(np.flatnonzero(bits == 0), len(bits)).items()}
    if "get" in wants:
        out |= {f"one_{k}": v for k, v in _directory(ones, len(bits)).items()}
    return out


def _windows(raw: np.ndarray) -> np.ndarray:
    """The 64-bit number that starts at each byte."""
    return np.ndarray((max(len(raw) - 7, 0),), np.dtype("<u8"), raw, 0, (1,))


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray], prefix: str = ""):
        self.n, self.width, self.buckets = (int(x) for x in arrays[f"{prefix}head"])
        self._high = _windows(arrays[f"{prefix}high"])
        self._lows = [(shift, kind, arrays[f"{prefix}low_{shift}"]) for shift, kind in _planes(self.width)]
        self._blocks = {name: (arrays[f"{prefix}{name}_at"], arrays[f"{prefix}{name}_long"].reshape(-1, _EVERY + 1)) for name in ("zero", "one") if f"{prefix}{name}_at" in arrays}

    def _after(self, rank: np.ndarray, name: str) -> np.ndarray:
        """Places after the rank-th bits of a kind (rank from 1); 0 for rank 0."""
        starts, table = self._blocks[name]
        rank = rank.astype(np.int64, copy=False)
        place, left = starts[rank >> 4].astype(np.int64), rank & (_EVERY - 1)
        long = np.flatnonzero(place < 0) if len(table) else ()
        if len(long):
            there = table[-1 - place[long], left[long]]
            place[long] = 0
        window = self._high[place >> 3] >> (place & 7).astype(np.uint64)
        if name == "zero":
            window = ~window
        wanted = left.astype(np.uint64)
        sums = window - ((window >> _U(1)) & _PAIRS)
        sums = (sums & _FOURS) + ((sums >> _U(2)) & _FOURS)
        sums = ((sums + (sums >> _U(4))) & _HALVES) * _EACH
        # the first byte up to whose end there are as many bits as are wanted
        byte = np.bitwise_count(~((sums | _TOPS) - wanted * _EACH) & _TOPS).astype(np.uint64) << _U(3)
        byte = np.minimum(byte, _U(56))
        before = (sums << _U(8)) >> byte & _U(255)
        inside = _AFTER[((window >> byte & _U(255)) << _U(3)) + np.where(left > 0, wanted - before - _U(1), _U(0)) & _U(2047)]
        out = place + np.where(left > 0, byte + inside, _U(0)).astype(np.int64)
        if len(long):
            out[long] = there
        return out

    @staticmethod
    def _plane(plane: np.ndarray, kind: int, index: np.ndarray) -> np.ndarray:
        return plane.take(index >> 1) >> ((index & 1) << 2).astype(np.uint8) & np.uint8(15) if kind == 4 else plane.take(index)

    def low(self, index: np.ndarray) -> np.ndarray:
        """The low bits of the value at each index."""
        out = np.zeros(len(index), np.int64)
        for shift, kind, plane in self._lows:
            out |= self._plane(plane, kind, index).astype(np.int64) << shift
        return out

    def is_low(self, index: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The places at which the low bits of the value at an index are those that are given."""
        at = None
        for shift, kind, plane in self._lows:
            some, wanted = (index, low) if at is None else (index[at], low[at])
            same = np.flatnonzero(self._plane(plane, kind, some) == (wanted >> shift & (1 << kind) - 1).astype(plane.dtype))
            at = same if at is None else at[same]
        return np.arange(len(index)) if at is None else at

    def get(self, index: np.ndarray) -> np.ndarray:
        index = np.asarray(index, np.int64)
        return (self._after(index + 1, "one") - 1 - index) << self.width | self.low(index)

    def span(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value at each index and how far it is to the next one."""
        place = self._after(index + 1, "one")
        first = (place - 1 - index) << self.width | self.low(index)
        run = self._high[place >> 3] >> (place & 7).astype(np.uint64)
        # zeros up to the next one
        gap = np.bitwise_count(~run & (run - _U(1))).astype(np.int64)
        size = (gap << self.width) + self.low(index + 1) - self.low(index) if self.width else gap
        far = np.flatnonzero(gap >= _WINDOW)
        if len(far):
            size[far] = self.get(index[far] + 1) - first[far]
        return first, size

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value by a successor search in its bucket; -1 where it isn't in the sequence."""
        values = np.asarray(values, np.int64)
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        some = (values >= 0) & (values >> self.width < self.buckets)
        if not some.all():
            out[some] = self.find(values[some])
            return out
        high, low = values >> self.width, values & ((1 << self.width) - 1)
        place = self._after(high, "zero")
        index = place - high
        # the bits from a bucket's start on, of which the ones up to the first zero are its values
        run = self._high[place >> 3] >> (place & 7).astype(np.uint64)
        todo, step = None, 0
        while len(run):
            live = np.flatnonzero(run & _U(1))
            if todo is not None or len(live) < len(run):
                todo = live if todo is None else todo[live]
                run, index, low, place = run[live], index[live], low[live], place[live]
            hit = self.is_low(index, low)
            out[hit if todo is None else todo[hit]] = index[hit]
            on = np.ones(len(run), bool)
            on[hit] = False
            on = np.flatnonzero(on)
            todo = on if todo is None else todo[on]
            run, index, low, place = run[on] >> _U(1), index[on] + 1, low[on], place[on]
            step += 1
            if step % (_WINDOW - 1) == 0 and len(run):
                run = self._high[place + step >> 3] >> (place + step & 7).astype(np.uint64)
        return out


def dump(arrays: dict[str, np.ndarray]) -> bytes:
    """One byte string of named arrays."""
    head, at, parts = {}, 0, []
    for name, array in arrays.items():
        raw = np.ascontiguousarray(array).tobytes()
        head[name] = (array.dtype.str, len(array), at)
        pad = -len(raw) % 8
        parts.append(raw + b"\0" * pad)
        at += len(raw) + pad
    said = json.dumps(head).encode()
    said += b" " * (-len(said) % 8)
    return len(said).to_bytes(8, "little") + said + b"".join(parts)


def parse(raw) -> dict[str, np.ndarray]:
    """The named arrays of a byte string or mapping."""
    size = int.from_bytes(raw[:8], "little")
    head = json.loads(bytes(raw[8 : 8 + size]))
    return {name: np.frombuffer(raw, np.dtype(kind), count, 8 + size + at) for name, (kind, count, at) in head.items()}


def load(path: str) -> dict[str, np.ndarray]:
    """The named arrays of a file, memory-mapped."""
    with open(path, "rb") as file:
        return parse(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))
