"""run() of the pipeline against a plain version of its stages."""

import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lodestone.llm import pieces
from lodestone.llm.decontaminate import WINDOW, words_of
from lodestone.llm.pieces import SPACE
from tests.llm.test_operators import base_spans

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def vocabulary():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    scores, byte_ids = {}, {}
    for at in range(model.vocab_size()):
        piece = model.id_to_piece(at)
        if model.is_byte(at):
            byte_ids[int(piece[3:5], 16)] = at
        elif not (model.is_control(at) or model.is_unknown(at) or model.is_unused(at)):
            scores[piece] = max(model.get_score(at), pieces.BYTE_SCORE / 4), at
    return scores, byte_ids


def best_ids(text, vocabulary):
    """The best path over pieces and byte pieces; of equal ones the longest last piece."""
    scores, byte_ids = vocabulary
    known = {piece.encode(): found for piece, found in scores.items()}
    longest = max(map(len, known))
    # a space is the space mark; U+2581 of the text itself is three byte pieces, which no piece may span
    flat, own = [], []
    for char in text:
        raw = (SPACE if char == " " else char).encode()
        flat += raw
        own += [char == SPACE] * len(raw)
    best, back = [0.0] + [-np.inf] * len(flat), [None] * (len(flat) + 1)
    for end in range(1, len(flat) + 1):
        options = [(best[end - 1] + pieces.BYTE_SCORE, 0, byte_ids[flat[end - 1]])]
        for size in range(1, min(longest, end) + 1):
            piece = bytes(flat[end - size : end])
            if piece in known and not any(own[end - size : end]):
                options.append((best[end - size] + known[piece][0], size, known[piece][1]))
        best[end], *back[end] = max(options, key=lambda o: o[:2])
    out, end = [], len(flat)
    while end:
        size, ident = back[end]
        out.append(ident)
        end -= max(1, size)
    return out[::-1]


def test_best_path_on_the_real_vocabulary(vocabulary):
    rng = np.random.default_rng(9)
    chars = list("aeinrst  .,ABCäöüß日本🎉▁\n\t019") + ["the", "ing", "tion", " of", "  "]
    model = pieces.load(pieces.model_path())
    for _ in range(60):
        text = "".join(rng.choice(chars, rng.integers(1, 60)))
        assert model.encode(text) == best_ids(text, vocabulary)
        assert model.decode(model.encode(text)) == text


def plain(rows, bench, vocabulary):
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else None)
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    stay = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is None:
            stay["null", i] = i
        elif group[i] not in stay or doc_id < rows[stay[group[i]]][0]:
            stay[group[i]] = i
    out = []
    for i in stay.values():
        doc_id, text = rows[i]
        spots = [m.span() for m in re.finditer(r"[a-zA-Z0-9\x80-\U0010ffff]+", text)]
        words, hit = words_of(text), set()
        assert len(spots) == len(words)
        for _, item in bench:
            other = words_of(item)
            n = min(WINDOW, len(other))
            for a in range(len(other) - n + 1 if n else 0):
                for j in range(len(words) - n + 1):
                    if words[j : j + n] == other[a : a + n]:
                        hit |= set(range(j, j + n))
        if len(hit) > 0.5 * len(words):
            continue
        cut, last, j = "", 0, 0
        while j < len(words):
            if j in hit:
                end = j
                while end in hit:
                    end += 1
                cut += text[last : spots[j][0]] + " "
                last = spots[end - 1][1]
                j = end
            else:
                j += 1
        text = cut + text[last:]
        done, last = "", 0
        for start, end, kind in sorted((int(s.split(":")[1]), int(s.split(":")[2]), s.split(":")[0]) for s in base_spans(text)):
            if end > last:
                done += text[last : max(start, last)] + f"[{kind.upper()}]"
                last = end
        text = done + text[last:]
        out.append((doc_id, best_ids(text, vocabulary)))
    return out


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rng = np.random.default_rng(10)
    bench = [(1, "how many words does it take to make a window of ten words in a row"), (2, "too short"), (3, None), (2, "zzz")]
    words = "alpha beta gamma delta the and of to in is it was for on are with as his they be at one have this".split()
    say = lambda n: " ".join(rng.choice(words, n))
    base = [say(int(n)) for n in rng.integers(8, 90, 25)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base[:12]):
        w = t.split()
        w[len(w) // 2] = "edited"
        rows += [(100 + i, " ".join(w)), (200 + i, t.upper()), (300 + i, t + "."), (400 + i, t + " " + say(30))]
    rows += [(500, None), (501, ""), (502, "12 34 !!"), (503, bench[0][1]), (504, say(40) + ", " + bench[0][1].upper() + "! " + say(9)), (505, "it is too short and so on"), (506, "zzz")]
    rows += [(507, "write to a.b@c.de or call +1 (743) 555-3824 now"), (508, "from 10.0.0.1, card 4111 1111 1111 1111 and ▁ mark  日本"), (3, base[3]), (7, say(20)), (None, base[4]), (600, "one two"), (601, "one two")]
    docs = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "lang": ["en" if i % 3 else "fr" for i in range(len(rows))], "source": ["s"] * len(rows), "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64())})
    pq.write_table(docs, folder / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([b[0] for b in bench], pa.int64()), "text": [b[1] for b in bench]}), folder / "benchmark.parquet")
    return str(folder), rows, bench


def test_run(spark, tables, vocabulary):
    folder, rows, bench = tables
    found = [(r.doc_id, list(r.ids)) for r in corpus_pipeline.run(spark, folder).collect()]
    want = plain(rows, bench, vocabulary)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert 25 < len(want) < 60 and sorted(found, key=key) == sorted(want, key=key)


def test_stages_with_extra_columns_and_empty_tables(spark, tables):
    folder, rows, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = ["lang_pred", "score", "__text", "row", "gone_id", "__decon_spans", "key", "a.b", "_lang"]
    more = docs.select("*", *(docs["text"].alias(name) for name in names))
    for own in (more, more.limit(0)):
        table = own
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, table, folder)
            assert after.columns == table.columns, name
            before = {r["key"] for r in table.collect()}
            kept = after.collect()
            assert all(r[c] == r["key"] for r in kept for c in names) and {r["key"] for r in kept} <= before
            table = corpus_pipeline.written(after)
        assert (corpus_pipeline.STAGES[-1][1](spark, table, folder).count() > 0) == (own is more)
