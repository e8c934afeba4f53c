"""Collocations against a loop over all phrases, with blocks of few words, and the SQL's answer on the smallest tables."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from lodestone.llm import collocations


def brute(docs, least, most=2000, longest=5):
    counts, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    often = {x: a for x, a in counts.items() if a >= least}
    dropped = {(lang, w[i : i + m]) for (lang, w), a in often.items() for m in range(2, len(w)) for i in range(len(w) - m + 1) if 100 * a >= 100 * often[lang, w[i : i + m]]}
    rows = []
    for (lang, w), a in often.items():
        if len(w) > 1 and (lang, w) not in dropped:
            cut = min((1000 * a * total[lang] // (often[lang, w[:k]] * often[lang, w[k:]]), k) for k in range(1, len(w)))
            rows.append((lang, " ".join(w), a, often[lang, w[: cut[1]]], often[lang, w[cut[1] :]], total[lang], cut[0]))
    out = []
    for lang in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i, *r[1:]) for i, r in enumerate(own[:most], 1)]
    return sorted(out)


def drawn(seed, rows):
    rng = random.Random(seed)
    words = ["a", "b", "of", "The", "THE", "é", "naïve", "x" * 40, "#1"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "! ", "\r\n", "\x0b"]
    text = lambda: "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 60)))
    return [(rng.choice(["en", "fr", None]), rng.choice([text(), "a b of the end a b of the end", None, "", " .,", "a a a a a a a"])) for _ in range(rows)]


@pytest.mark.parametrize("seed, least, most, block", [(1, 2, 2000, 2_000_000), (2, 3, 7, 30), (3, 2, 2000, 9), (4, 5, 2000, 100)])
def test_against_a_loop(spark, seed, least, most, block):
    docs = drawn(seed, 60)
    frame = spark.createDataFrame(docs, "lang string, text string").withColumn("n", collocations.F.lit(1)).withColumn("block", collocations.F.lit("x")).repartition(3)
    found = collocations.collocations(frame, least, most, block_words=block, part_bytes=200 * seed)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == brute(docs, least, most)


def test_one_long_text_and_none(spark):
    rng = random.Random(6)
    long = " ".join(rng.choice(["u", "v", "w", "uv", "vw"]) for _ in range(30_000))
    docs = [("en", long), ("en", long), ("de", "y" * 200_000)]
    found = collocations.collocations(spark.createDataFrame(docs, "lang string, text string"), 900, block_words=4_000)
    assert sorted(tuple(r) for r in found.collect()) == brute(docs, 900)
    nothing = spark.createDataFrame([(None, None), ("en", "a b")], "lang string, text string")
    assert collocations.collocations(nothing).count() == collocations.collocations(nothing.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    often = spark.createDataFrame([(1, "en", "a b", 10**13, 5 * 10**13, [10**13 + 7], [3 * 10**13])], "id long, lang string, phrase string, a long, n long, starts array<long>, rests array<long>")
    row = collocations._kept(often, None, 2).first()
    assert row.score == 1000 * 10**13 * 5 * 10**13 // ((10**13 + 7) * 3 * 10**13)


def test_packed_lists():
    rng = np.random.default_rng(1)
    for size in (0, 1, 5, 10_000):
        places = rng.integers(0, 2**62, size)
        assert (collocations.unpack(collocations.pack(places)) == places).all()


def test_oracle(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    rows = con.execute(collocations.ORACLE)
    names, rows = [c[0] for c in rows.description], rows.fetchall()
    found = collocations.op12_collocations(spark, folder)
    assert names == found.columns and sorted(rows) == sorted(tuple(r) for r in found.collect())
