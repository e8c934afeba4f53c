"""Ranked search against scoring every document, with small shards and blocks, and blocks that are never read."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import lexical_search, words


def terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, most=20):
    own = [(i, terms(t)) for i, t in docs if terms(t)]
    n, total = len(own), sum(len(w) for _, w in own)
    df = Counter(w for _, ws in own for w in set(ws))
    asked = {}
    for item, text in sorted(set((i, t) for i, t in items if i is not None and t is not None)):
        asked.setdefault(item, []).extend(terms(text))
    out = []
    for item, ws in asked.items():
        scored = []
        for doc, of in own:
            tf, m = Counter(of), 100 - 25 + (25 * len(of) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * tf[w]) // (1000 * tf[w] + 12 * m)) for w in ws if w in tf)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:most], 1)]
    return out


def drawn(seed, rows):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Über", "x-y", "a_b", "ÉTÉ", "z" * 70]
    text = lambda most: " ".join(vocabulary[min(int(rng.expovariate(0.08)), len(vocabulary) - 1)] for _ in range(rng.randint(1, most)))
    docs = [(i, rng.choice([text(20), text(200)])) for i in range(rows)]
    docs += [(None, text(30)), (1, text(30)), (2, None), (3, ""), (4, "!? ."), (5, docs[0][1]), (6, docs[0][1])]
    items = [(i, text(40)) for i in range(12)] + [(3, text(5)), (20, None), (21, "--"), (22, "absent"), (None, "w1"), (23, "w1 w1 w1"), (23, "w1 w1 w1")]
    return docs, items


@pytest.mark.parametrize("seed, most, shard, block, asked", [(1, 20, 32_000_000, 128, 4_000_000), (2, 5, 2_000, 4, 4_000_000), (3, 20, 20_000, 16, 300), (4, 1, 500, 2, 4_000_000)])
def test_against_every_document(spark, seed, most, shard, block, asked):
    docs, items = drawn(seed, 150)
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", lexical_search.F.lit("x")).withColumn("term", lexical_search.F.lit(1)).repartition(2)
    asking = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", lexical_search.F.lit(1))
    found = lexical_search.search(frame, asking, most, shard, block, asked)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    rows, want = sorted(map(tuple, found.collect()), key=repr), sorted(brute(docs, items, most), key=repr)
    # which of two rows with the same id and score comes first doesn't show
    assert rows == want


def test_empty_tables_and_a_long_text(spark):
    docs, items = spark.createDataFrame([(1, "a b"), (2, "w " * 100_000 + "rare")], "doc_id long, text string"), spark.createDataFrame([(1, "rare a")], "item_id long, text string")
    assert [tuple(r) for r in lexical_search.search(docs, items).collect()] == brute([(1, "a b"), (2, "w " * 100_000 + "rare")], [(1, "rare a")])
    nothing = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    for few, some in ((docs.limit(0), items), (docs, items.limit(0)), (nothing, items)):
        assert lexical_search.search(few, some).count() == 0


def test_blocks_below_the_threshold_are_not_read():
    rng = np.random.default_rng(4)
    count, block = 20_000, 64
    m, lists = np.full(count, 100), []
    for share in (0.5, 0.3, 0.02):
        docs = np.flatnonzero(rng.random(count) < share)
        times = np.where(docs < 500, 9, 1)
        cut = np.arange(0, len(docs), block)
        steps = np.diff(docs, prepend=0)
        steps[cut] = 0
        raw, starts = lexical_search.coded(np.stack([steps, times], axis=1).ravel())
        most = np.maximum.reduceat(lexical_search.impacts(times, m[docs]), cut)
        heads = np.stack([docs[cut], docs[np.append(cut[1:], len(docs)) - 1], most, starts[:-1:2][cut]], axis=1).astype("<i4")
        lists.append((lexical_search.Postings(heads.tobytes(), raw, len(docs), m, block), 1000, docs, times))
    sums = np.zeros(count, np.int64)
    place, score = lexical_search.best([x[:2] for x in lists], np.arange(count), 20, sums)
    whole = np.zeros(count, np.int64)
    for _, weight, docs, times in lists:
        whole[docs] += weight * lexical_search.impacts(times, m[docs])
    top = np.lexsort((np.arange(count), -whole))[:20]
    assert (place == top).all() and (score == whole[top]).all() and not sums.any()
    read = sum(x[0].read.sum() for x in lists) / sum(len(x[0].read) for x in lists)
    assert read < 0.2, read


def test_coded_numbers():
    rng = np.random.default_rng(2)
    values = np.concatenate([[0, 1, 127, 128, 16_383, 16_384, 2**40], rng.integers(0, 2**30, 1000)])
    raw, starts = lexical_search.coded(values)
    assert (lexical_search.decoded(raw) == values).all() and len(starts) == len(values) + 1 and lexical_search.decoded(b"").size == 0


def test_parts_of_long_texts(monkeypatch):
    texts = pa.array(["ab cd", None, "", "efg hi" * 40, "x" * 300, "y z"])
    raw, offsets = words.bytes_of(texts)
    got = [(w, int(t)) for part in words.text_parts(raw, offsets, lexical_search._GAP, 50) for found, text in [lexical_search.terms(*part)] for w, t in zip(found.to_pylist(), text, strict=True)]
    assert got == [(w, i) for i, t in enumerate(texts.to_pylist()) for w in terms(t)]


def test_measures_beyond_64_bits():
    assert lexical_search.measures(np.array([10**9, 5]), 10**12, 10**14).tolist() == [75 + 25 * 10**9 * 10**12 // 10**14, 75 + 25 * 5 * 10**12 // 10**14]


def test_oracle(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    rows = con.execute(lexical_search.ORACLE)
    names, rows = [c[0] for c in rows.description], rows.fetchall()
    found = lexical_search.op13_lexical_search(spark, folder)
    assert names == found.columns and sorted(rows) == sorted(tuple(r) for r in found.collect())
