"""Toxicity by compression distance: windows, gains, held-out quality, edge cases."""

import random

import numpy as np
import zstandard

from lodestone.llm import toxicity

SYLLABLES = ["ba", "do", "ke", "li", "mu", "ra", "so", "ti", "vu", "ne", "pa", "gor"]
BAD = ["grimfoul", "wretchum", "zoddler", "pukewit"]


def prose(rng, words, bad=0.0):
    return " ".join(rng.choice(BAD) if rng.random() < bad else "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(words))


def fixture(n=240):
    rng = random.Random(5)
    toxic = [i % 3 == 0 for i in range(n)]
    return [(i, prose(rng, rng.randint(20, 150), 0.08 if toxic[i] else 0.0), int(toxic[i])) for i in range(n)]


def test_windows_hold_every_word():
    for text in (None, "", " \n", "A b", "ÄÖ x\ty " * 50, "y" * 1000, "one " + "z" * 130 + " two"):
        cut = toxicity.windows(text)
        assert "".join((text or "").split()).encode().lower() == b"".join(b"".join(cut).split())
        assert all(len(w) <= 2 * toxicity.WINDOW + 4 and w[:1] == w[-1:] == b" " for w in cut)


def test_gains_against_plain_compression():
    rng = random.Random(3)
    base, added = prose(rng, 500).encode(), b" grimfoul wretchum zoddler pukewit "
    model = toxicity.Model(0.5, base, added)
    text = prose(rng, 120, 0.1)
    lengths = []
    for raw in (base, added + base):
        words = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        tool = zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=words, write_content_size=False, write_dict_id=False)
        lengths.append([len(tool.compress(w)) for w in toxicity.windows(text)])
    best = sorted(max(a - b, 0) for a, b in zip(*lengths, strict=True))
    assert toxicity.gains(text, model.compressors()) == [best[-1], best[-2], float(np.log1p(len(best)))] and best[-1] >= 4
    assert toxicity.gains("", model.compressors()) == toxicity.gains(None, None) == [0.0, 0.0, 0.0]


def test_learns_pieces_and_scores_others(spark):
    rows = fixture()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:180]], "doc_id long, toxic int")
    model = toxicity.train(docs.where("doc_id < 180"), labels)
    assert all(word.encode() in model.added for word in BAD)
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())
    right = [found[i].predicted == y for i, _, y in rows[180:]]
    assert sum(right) >= 0.9 * len(right)
    bounded = toxicity.labelled(docs, labels, 7, 11).collect()
    assert sorted(r.toxic for r in bounded) == [0] * 11 + [1] * 7


def test_odd_rows(spark):
    rows = fixture()
    long = prose(random.Random(8), 60_000)
    mixed = prose(random.Random(9), 200, 0.1)
    odd = [(1000, None), (1001, ""), (1002, " \n"), (1003, "x" * 300_000), (1004, long), (1005, mixed), (None, "a b"), (1004, long), (1005, mixed)]
    docs = spark.createDataFrame([*((i, t) for i, t, _ in rows), *odd], "doc_id long, text string").withColumn("score", toxicity.F.lit("own"))
    labels = spark.createDataFrame([*((i, y) for i, _, y in rows), (0, 0), (1, None), (2, 7), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    found = toxicity.score(docs.where("doc_id >= 1000 OR doc_id IS NULL"), model)
    assert found.columns == ["doc_id", "score", "predicted"] and found.count() == len(odd)
    by = {r.doc_id: r.score for r in found.collect()}
    assert by[1000] == by[1001] == by[1002] < 0.5 and by[1003] < 0.5 and by[1004] < 0.5 < by[1005]
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    for rows, share in (([], 0.0), ([(1, 1)], 1.0), ([(1, 0)], 0.0)):
        model = toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert [r.score for r in toxicity.score(docs, model).collect()] == [share, share]


def test_held_out_documents(spark):
    """On rows whose labels were not learned from: toxic ones above others."""
    folder = "/root/testdata/sf0.01"
    found = toxicity.op11_toxicity(spark, folder)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = found.where("held_out").join(labels, "doc_id").collect()
    toxic, other = ([r.score for r in held if r.toxic == kind] for kind in (1, 0))
    above = np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in other])
    assert found.count() == 1000 and above > 0.8 and np.mean([s < 0.5 for s in other]) > 0.95


def test_the_cut_with_the_highest_f1():
    rng = np.random.default_rng(6)
    for _ in range(50):
        p, said = np.round(rng.random(40), 1), (rng.random(40) < 0.3).astype(float)
        if 0 < said.sum() < 40:
            f1 = lambda cut: 2 * said[p >= cut].sum() / ((p >= cut).sum() + said.sum())  # noqa: B023, E731
            cut = toxicity.cut_for(p, said)
            assert f1(cut) == max(f1(c) for c in np.arange(0.05, 0.96, 0.1))
