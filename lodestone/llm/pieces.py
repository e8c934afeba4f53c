"""SentencePiece encoding and decoding: an Aho-Corasick automaton over pieces drives a single-pass Viterbi.

The automaton works on UTF-8 bytes. At every byte the output links lead through all pieces that end there, longest
first, and each relaxes the best score of a split that ends there; a byte piece may always be taken instead, at a
cost beyond any piece's. Of equal splits the longest last piece wins. U+2581 of the text itself becomes byte
pieces, so decoding gives back every text.

The supplied model file holds merge ranks as scores, and no piece has a space mark after another character. So a
text splits before every space mark that follows another character, and the splits' best paths together are the
text's best path. New splits of many rows go through the automaton side by side; known ones are kept in a bounded
table.

Rows: null texts have null ids, empty texts none. Repeated rows are encoded each; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship, slices, table, tidy

SPACE = "▁"
#: What a byte piece costs, beside any piece's score; and the splits in a worker's table.
BYTE_SCORE, MOST_SPLITS = -1e6, 200_000
#: Bytes of a split that goes through the automaton beside others, and the number of these at once.
SHORT, BESIDE = 48, 20_000
_MARK = SPACE.encode()
#: Stands in for U+2581 of a text; no UTF-8 text has this byte.
_OWN_MARK = 0xFF
_SPLITS = re.compile(" *[^ ]+| +")


class Pieces:
    """pieces: (piece, score, id) of the ordinary pieces; bytes_at: the ids of the 256 byte pieces."""

    def __init__(self, pieces: list[tuple[str, float, int]], bytes_at: list[int]):
        self.bytes_at, self.byte_ids = bytes_at, np.array(bytes_at, np.int32)
        text_of = {at: bytes([b]) for b, at in enumerate(bytes_at)}
        text_of.update((at, piece.replace(SPACE, " ").encode()) for piece, _, at in pieces)
        self.text = np.frombuffer(b"".join(text_of.values()), np.uint8)
        self.text_size, self.text_start = np.zeros(max(text_of) + 1, np.int64), np.zeros(max(text_of) + 1, np.int64)
        sizes = np.fromiter(map(len, text_of.values()), np.int64, len(text_of))
        self.text_size[list(text_of)], self.text_start[list(text_of)] = sizes, np.cumsum(sizes) - sizes
        self.local = all(SPACE not in p.lstrip(SPACE) for p, _, _ in pieces)
        self.known: dict[str, bytes] = {}
        self._build([(p.encode(), score, at) for p, score, at in pieces if p])

    def _build(self, pieces: list[tuple[bytes, float, int]]) -> None:
        """next: a row of 256 successors per state; size, score, piece: of the longest piece that ends in a state;
        link: the next state with a piece along the failure links, 0 if none."""
        children: list[dict[int, int]] = [{}]
        ends: dict[int, tuple[int, float, int]] = {}
        for raw, score, at in pieces:
            state = 0
            for byte in raw:
                if byte not in children[state]:
                    children[state][byte] = len(children)
                    children.append({})
                state = children[state][byte]
            if state not in ends or (score, -at) > (ends[state][1], -ends[state][2]):
                ends[state] = (len(raw), score, at)
        count = len(children)
        self.next = np.zeros((count, 256), dtype=np.uint16 if count <= 1 << 16 else np.int32)
        self.link = np.zeros(count, dtype=np.int32)
        self.size, self.score, self.piece = np.zeros(count, np.int32), np.zeros(count), np.full(count, -1, np.int32)
        for state, (size, score, at) in ends.items():
            self.size[state], self.score[state], self.piece[state] = size, score, at
        self.ends = ends
        failure = [0] * count
        queue = [0]
        for state in queue:
            if state:
                self.next[state] = self.next[failure[state]]
            for byte, child in children[state].items():
                back = int(self.next[failure[state], byte]) if state else 0
                failure[child] = back
                self.link[child] = back if back in ends else self.link[back]
                self.next[state, byte] = child
                queue.append(child)
        self.first = np.where(self.piece >= 0, np.arange(count, dtype=np.int32), self.link).astype(np.int32)

    def many(self, raws: list[bytes]) -> list[bytes]:
        """Best splits of byte strings, all in one pass over their positions; ids as bytes of int32."""
        count, longest = len(raws), max(map(len, raws), default=0)
        sizes = np.fromiter(map(len, raws), np.int64, count)
        grid = np.zeros((count, longest), np.uint8)
        grid[np.arange(longest) < sizes[:, None]] = np.frombuffer(b"".join(raws), np.uint8)
        best = np.full((longest + 1, count), -np.inf)
        length, piece = np.ones((longest + 1, count), np.int32), np.full((longest + 1, count), -1, np.int32)
        best[0] = 0
        order = np.argsort(-sizes, kind="stable")
        grid, sizes = grid[order], sizes[order]
        state = np.zeros(count, np.int32)
        for t in range(longest):
            live = int(np.searchsorted(-sizes, -t, side="left"))
            state[:live] = self.next[state[:live], grid[:live, t]]
            own, own_length, own_piece = best[t + 1], length[t + 1], piece[t + 1]
            who, at = np.arange(live), self.first[state[:live]]
            while True:
                some = at > 0
                if not some.all():
                    who, at = who[some], at[some]
                if not len(who):
                    break
                n = self.size[at]
                other = best[t + 1 - n, who] + self.score[at]
                better = other > own[who]
                to = who[better]
                own[to], own_length[to], own_piece[to] = other[better], n[better], self.piece[at[better]]
                at = self.link[at]
            other = best[t, :live] + BYTE_SCORE
            to = np.flatnonzero(other > own[:live])
            own[to], own_length[to], own_piece[to] = other[to], 1, -1
        out = [b""] * count
        end, who, steps = sizes.copy(), np.arange(count), []
        while len(who := who[end[who] > 0]):
            at = end[who]
            steps.append((who, piece[at, who], grid[who, at - 1]))
            end[who] = at - length[at, who]
        if steps:
            rows, ids, raw = (np.concatenate([s[i] for s in steps])[::-1] for i in range(3))
            ids = np.where(ids >= 0, ids, np.where(raw == _OWN_MARK, -1, self.byte_ids[raw])).astype(np.int32)
            sort = np.argsort(rows, kind="stable")
            cuts, odd = np.searchsorted(rows[sort], np.arange(count + 1)) * 4, set(rows[ids < 0].tolist())
            flat = ids[sort].tobytes()
            for row, to in enumerate(order.tolist()):
                part = flat[cuts[row] : cuts[row + 1]]
                out[to] = self._marked(part) if row in odd else part
        return out

    def _marked(self, ids: bytes) -> bytes:
        """The three byte pieces of U+2581 in place of each -1."""
        own = [self.bytes_at[b] for b in _MARK]
        return np.array([x for at in np.frombuffer(ids, np.int32).tolist() for x in ([at] if at >= 0 else own)], np.int32).tobytes()

    def one(self, raw: bytes) -> bytes:
        """Best split of a long byte string."""
        count = len(raw)
        best, length, piece = [0.0] + [-np.inf] * count, [1] * (count + 1), [-1] * (count + 1)
        state, step, first, link = 0, self.next, self.first, self.link
        ends = self.ends
        for t, byte in enumerate(raw):
            state = int(step[state, byte])
            top, n_top, at_top = best[t] + BYTE_SCORE, 1, -1
            at = int(first[state])
            found = -np.inf
            while at:
                n, score, ident = ends[at]
                other = best[t + 1 - n] + score
                if other > found:
                    found = other
                    if other >= top:
                        top, n_top, at_top = other, n, ident
                at = int(link[at])
            best[t + 1], length[t + 1], piece[t + 1] = top, n_top, at_top
        out, end = [], count
        while end:
            out.append(piece[end] if piece[end] >= 0 else -1 if raw[end - 1] == _OWN_MARK else self.bytes_at[raw[end - 1]])
            end -= length[end]
        ids = np.array(out[::-1], np.int32).tobytes()
        return self._marked(ids) if -1 in out else ids

    @staticmethod
    def _raw(part: str) -> bytes:
        raw = part.encode("utf-8", "surrogatepass")
        return (raw.replace(_MARK, bytes([_OWN_MARK])) if SPACE in part else raw).replace(b" ", _MARK)

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids start (one more entry for the end)."""
        parts = [(_SPLITS.findall(t) if self.local else [t]) if t else [] for t in texts]
        known = self.known
        fresh = list({p for text in parts for p in text}.difference(known))
        fresh.sort(key=len)
        long = []
        for start in range(0, len(fresh), BESIDE):
            some, raws = [], []
            for part in fresh[start : start + BESIDE]:
                raw = self._raw(part)
                if len(raw) > SHORT:
                    known[part] = self.one(raw)
                    long.append(part)
                else:
                    some.append(part)
                    raws.append(raw)
            known.update(zip(some, self.many(raws), strict=True))
        coded = [b"".join([known[p] for p in text]) for text in parts]
        for part in long if len(known) <= MOST_SPLITS else fresh:
            del known[part]
        starts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)) // 4, out=starts[1:])
        return np.frombuffer(b"".join(coded), np.int32), starts

    def encode(self, text: str | None) -> list[int] | None:
        return None if text is None else self.encode_all([text])[0].tolist()

    def decode_all(self, ids: np.ndarray) -> bytes:
        """The UTF-8 text of ids."""
        sizes = self.text_size[ids]
        before = np.cumsum(sizes) - sizes
        return self.text[np.repeat(self.text_start[ids] - before, sizes) + np.arange(int(sizes.sum()))].tobytes()

    def decode(self, ids: list[int] | None) -> str | None:
        return None if ids is None else self.decode_all(np.asarray(ids, np.int64)).decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    """The pieces of a model file, without control and unknown pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary, bytes_at = [], [0] * 256
    for at in range(model.vocab_size()):
        if model.is_byte(at):
            bytes_at[int(model.id_to_piece(at)[3:5], 16)] = at
        elif not (model.is_control(at) or model.is_unknown(at) or model.is_unused(at)):
            ordinary.append((model.id_to_piece(at), max(model.get_score(at), BYTE_SCORE / 4), at))
    return Pieces(ordinary, bytes_at)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, ids and round_trip (whether the ids decode to the text) of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column(1).to_pylist()
                ids, starts = pieces.encode_all(texts)
                raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
                if pieces.decode_all(ids) == b"".join(raws):
                    same = [True] * len(texts)
                else:
                    same = [pieces.decode_all(ids[starts[i] : starts[i + 1]]) == raw for i, raw in enumerate(raws)]
                offsets = pa.array(starts.astype(np.int32), mask=np.array([t is None for t in texts] + [False]))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(starts)), lists, pa.array(same)], names=["doc_id", "n_pieces", "ids", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id bigint, n_pieces bigint, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of ids."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in batches:
            texts = [pieces.decode(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id bigint, text string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), model_path())
