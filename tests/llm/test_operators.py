"""The operators against brute force on small fixtures: nulls, empty and long texts, repeated rows, clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import cotraining, decontaminate, elias_fano, gbm, jaccard_join, language_id, ngram_lm, pieces, pii, quality_rules, token_counts, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
TEXTS = [
    None, "", " \n\t", "One two three.", "a.b@c.de and x@y, 1.2.3.4 999.1.1.1 +1 (743) 555-3824", "4111 1111 1111 1111 9807915762804490 joe (at) mail (dot) com",
    "Grüße aus Köln 🎉 ▁mark  double  space\r\n日本語", LONG, "x" * 5000, "same words here again and again " * 30, "tab\tsep <|endoftext|> end", "é" * 300 + " 12345",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "fr", None if i == 3 else f"s{i % 3}", len(t) if t else None) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4]], DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def base_spans(text):
    out = []
    patterns = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    for kind, pattern in patterns:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum((int(c) * 2 - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii(spark, docs):
    for row in pii.find(docs).collect():
        want = base_spans(TEXTS[row.doc_id])
        assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(row.spans.split(",")) | {""}
    clash = docs.withColumnRenamed("source", "spans")
    out = pii.redact(clash)
    redacted = {r.doc_id: r for r in out.collect()}
    assert out.columns == clash.columns
    assert redacted[4].text == "[EMAIL] and x@y, [IP] 999.1.1.1 [PHONE]" and redacted[0].text is None and redacted[7].text == LONG
    assert "[EMAIL]" in redacted[5].text


def test_pii_of_many_numbers(spark):
    texts = [" ".join(str(100_000 + i) for i in range(5000)), " and ".join(f"1.2.{i % 256}.{i // 256}" for i in range(5000)), " x ".join(f"+1 555 {i:07d}" for i in range(5000))]
    found = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [found[i] for i in (1, 2)] == [",".join(base_spans(t)) for t in texts[1:]]
    assert pii.find(empty(spark)).count() == pii.redact(empty(spark)).count() == 0


def test_pii_inside_longer_runs(spark):
    card = "5105 1051 0510 5100"
    texts = [f"order 12 {card}", f"{card} 7 and", f"page 3  {card} 44 or", f"1 2 3 {card} 4 5 6", "3 tel 555 123 4567", card, "call 555 123 4567 555 765 4321"]
    found = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i in (0, 1, 2, 3, 5):
        at = texts[i].index(card)
        assert found[i] == f"card:{at}:{at + len(card)}"
    assert found[4] == "phone:6:18"
    # the second phone has no word before it; the whole run covers it
    assert found[6] == "phone:5:17,phone:5:30"


def test_pii_added_spans_of_drawn_texts(spark):
    """Recall and precision of the spans beyond the base rules, on examples that the trees did not learn from."""
    rng = random.Random(99)
    drawn = [draw(rng) for draw in (pii._draw_numbers, pii._draw_email, pii._draw_secret) for _ in range(400)]
    texts = [f"{left}{x}{right}" for _, x, left, right in drawn]
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    wanted = met = taken = right = 0
    for i, (kind, x, left, _) in enumerate(drawn):
        base = set(base_spans(texts[i]))
        whole = f"{kind}:{len(left)}:{len(left) + len(x)}"
        added = {s for s in [*found[i].spans.split(","), *found[i].secrets.split(",")] if s} - base
        if kind and whole not in base:
            wanted += 1
            met += whole in added
        taken += len(added)
        # a base span of a part may stand beside the whole one
        right += whole in added
    assert wanted > 300 and met > 0.7 * wanted and right > 0.93 * taken, (wanted, met, taken, right)


def test_pii_secrets_and_clashing_names(spark):
    hexes = hashlib.sha1(b"x").hexdigest()
    texts = [f'my token = "{hexes}" is', f"commit {hexes} was", "a-long-name-of-a-page-2024 stands here", f"mail a@b.de, api_key: sk-{hexes[:30]}.", None, "", "4111 1111 1111 1111 = password", f"{hexes} " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    assert found[0].secrets == f"secret:12:{12 + len(hexes)}" and found[0].n_spans == 1 and found[0].spans == ""
    assert [found[i].secrets for i in (1, 2, 4, 5, 6)] == [""] * 5
    assert found[3].secrets == "secret:22:55" and found[3].spans == "email:5:11" and found[6].spans == "card:0:19"
    names = ["__text", "__email", "__base", "__spans", "__cuts", "row", "a.b", "q"]
    clash = docs.select("doc_id", *(pii.F.col("text").alias(name) for name in names), "text")
    out = pii.redact(clash)
    assert out.columns == clash.columns
    for row in out.collect():
        assert all(row[name] == texts[row.doc_id] for name in names)
    redacted = {r.doc_id: r.text for r in out.select("doc_id", "text").collect()}
    assert redacted[0] == 'my token = "[SECRET]" is' and redacted[1] == texts[1] and redacted[3] == "mail [EMAIL], api_key: [SECRET]." and redacted[4] is None


def test_quality_rules(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 12)], "doc_id long, quality int, toxic int")
    out = quality_rules.judge(docs, quality_rules.train(docs, labels)).collect()
    assert len(out) == len(TEXTS) + 1
    for row in out:
        words = re.findall(r"[^\x20\x09-\x0D]+", TEXTS[row.doc_id] or "")
        seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        hit = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        assert (row.n_words, row.word_chars, row.n_repeat_words) == (len(words), sum(map(len, words)), len(hit))
        lines = (TEXTS[row.doc_id] or "").split("\n")
        repeated = sum(re.search(r"[^\x20\x09-\x0D]", x) is not None and x in lines[:i] for i, x in enumerate(lines))
        assert (row.n_symbols, row.n_dup_lines) == (len(re.findall(r"[#*$%&|<>]", TEXTS[row.doc_id] or "")), repeated)
        assert row.base_failed == (len(words) < 10 or 100 * len(hit) > 20 * len(words)) and not (row.base_failed and row.kept)
    assert quality_rules.judge(empty(spark), None).count() == 0


def test_quality_rules_of_lines_and_symbols(spark):
    rng = np.random.default_rng(13)
    parts = ["one two", "one two ", "#", "a*b$c%", "", " ", "\t", "&|<>", "é¢", "\x0b", "x\ry", "same line of some words here"]
    texts = ["\n".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(200)]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3])], "doc_id long, text string").withColumn("kept", pii.F.lit("x"))
    found = quality_rules.judge(docs, None).collect()
    assert len(found) == 201
    for row in found:
        text = texts[row.doc_id]
        words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), text.split("\n")
        repeated = sum(re.search(r"[^\x20\x09-\x0D]", x) is not None and x in lines[:i] for i, x in enumerate(lines))
        seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        hit = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(hit))
        assert row.kept == (not row.base_failed)


def test_quality_rules_learn_from_one_row_an_id(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "d e f g"), (2, "#### ####"), (None, "x"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (None, 1), (4, 1), (2, 5)], "doc_id long, quality int")
    rows, quality = quality_rules.labelled_features(docs, labels)
    assert len(rows) == 3 and quality.tolist() == [0, 0, 1]


def test_held_out_quality_and_language(spark):
    """What was learned from a part of the rows, judged by the others."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    half = pii.F.crc32(labels.doc_id.cast("string").cast("binary")) % 2
    said = {r.doc_id: r.quality for r in labels.where(half == 1).collect()}
    rows = [r for r in quality_rules.judge(docs, quality_rules.train(docs, labels.where(half == 0))).collect() if r.doc_id in said]
    assert len(rows) > 100 and sum(r.kept == bool(said[r.doc_id]) for r in rows) > 0.9 * len(rows)
    langs = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = [r for r in language_id.op7_language_id(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert len(rows) > 200 and sum(r.lang_pred == langs[r.doc_id] for r in rows) > 0.98 * len(rows)


def test_trees_keep_their_direction():
    rng = np.random.default_rng(1)
    rows = rng.random((500, 3))
    trees = gbm.fit(rows, rows[:, 0] + 0.3 * rng.random(500) < 0.6, monotone={0: -1})
    for other in rows[:20]:
        line = np.repeat(other[None], 50, axis=0)
        line[:, 0] = np.linspace(0, 1, 50)
        assert (np.diff(trees.margin(line)) <= 1e-9).all()


def test_text_features():
    texts = [*TEXTS[:7], None, "", *TEXTS[8:], "Same same SAME\nline one\nline one\n\n", " "]
    for cut in (0, 3):
        array = cotraining.pa.array([*["x y"] * cut, *texts])[cut:]
        for text, found in zip(texts, cotraining.text_features(array, cotraining.Known()).to_pylist(), strict=True):
            want = {f for word in (text or "").encode().split() for f in cotraining.Known()[word]}
            lines = [line for line in (text or "").encode().split(b"\n") if line.strip()]
            want.add(zlib.crc32(b"d%d" % min(8, 10 * (len(lines) - len(set(lines))) // max(1, len(lines)))) % cotraining.TEXT_SIZE)
            assert found == sorted(want)


def plain_margins(lists, counts, rows):
    """Margins of rows by counts of (class: (documents, Counter)), one document after another."""
    out = []
    for row in rows:
        total = 0.0
        for f in lists[row]:
            n = [counts[k][1][f] for k in (0, 1)]
            odds = math.log((n[1] + 0.5) / (counts[1][0] + 1)) - math.log((n[0] + 0.5) / (counts[0][0] + 1))
            odds *= sum(n) / (sum(n) + cotraining.HALF) if sum(n) >= cotraining.LEAST else 0
            total += math.copysign(abs(odds) ** cotraining.POWER, odds)
        total /= math.sqrt(len(lists[row]))
        out.append(math.copysign(abs(total) ** (1 / cotraining.POWER), total))
    return np.array(out)


def test_cotraining_against_a_plain_version(spark):
    rng = np.random.default_rng(12)
    rows, said = [], []
    for i in range(260):
        good = i % 2
        text = " ".join(rng.choice(["fine", "well", "done"] if good else ["spam", "cheap", "pill"]) if rng.random() < 0.3 else f"w{rng.integers(40)}" for _ in range(rng.integers(5, 30)))
        rows.append((i, text, "en", ("a" if good else "b") if rng.random() < 0.95 else "c", 100))
        if i < 90:
            said.append((i, good, int(rng.random() < 0.2)))
    docs = spark.createDataFrame(rows, DOCS)
    featured = cotraining.features(docs)
    model = cotraining.train(featured, spark.createDataFrame(said, "doc_id long, quality int, toxic int"))
    lists = [{r.doc_id: r[c] for r in featured.collect()} for c in ("text", "meta")]
    label = {i: q for i, q, _ in said}
    fold = lambda i: zlib.crc32(str(i).encode()) % cotraining.FOLDS

    def counts(view, ids):
        out = {}
        for kind in (0, 1):
            own = [i for i in ids if label[i] == kind]
            out[kind] = len(own), Counter(f for i in own for f in lists[view][i])
        return out

    def add(own, more):
        out = {}
        for kind in (0, 1):
            weight = min(1, own[kind][0] / max(1, more[kind][0]))
            joined = Counter(own[kind][1])
            for f, n in more[kind][1].items():
                joined[f] += n * weight
            out[kind] = own[kind][0] + more[kind][0] * weight, joined
        return out

    taught = [{k: (0, Counter()) for k in (0, 1)} for _ in range(2)]
    for number in range(cotraining.ROUNDS + 1):
        margins = np.zeros((2, 90))
        scales, views = [], []
        for view in (0, 1):
            for f in range(cotraining.FOLDS):
                own = [i for i in range(90) if fold(i) == f]
                margins[view, own] = plain_margins(lists[view], add(counts(view, [i for i in range(90) if fold(i) != f]), taught[view]), own)
            scales.append(gbm.calibrate(margins[view], np.array([label[i] for i in range(90)])))
            views.append(add(counts(view, range(90)), taught[view]))
        assert model["history"][number]["margins"][:, :, 0] == pytest.approx(margins, abs=1e-4)
        new = []
        for view in (0, 1):
            p = 1 / (1 + np.exp(-(scales[view][0] * plain_margins(lists[view], views[view], range(90, 260)) + scales[view][1])))
            for kind in (0, 1):
                own = [i for i in range(90, 260) if (p[i - 90] if kind else 1 - p[i - 90]) >= cotraining.SURE]
                new.append((1 - view, kind, len(own), Counter(f for i in own for f in lists[1 - view][i])))
        for view, kind, n, found in new:
            taught[view][kind] = n, found
    assert sum(t[k][0] for t in taught for k in (0, 1)) > 100
    right = sum((r.p_quality > 0.5) == r.doc_id % 2 for r in cotraining.judge(featured, model).where("doc_id >= 90").collect())
    assert right >= 165


def test_cotraining(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, int(i == 5)) for i in range(1, 12)] + [(1, 0, None), (None, 1, 1), (4, 7, -1)], "doc_id long, quality int, toxic int")
    nulls = docs.selectExpr("doc_id", "text", "text p_quality").unionByName(spark.createDataFrame([(None, None, "x")], "doc_id long, text string, p_quality string"))
    for own in (docs, nulls):
        featured = cotraining.features(own)
        out = cotraining.judge(featured, cotraining.train(featured, labels)).collect()
        assert len(out) == own.count() and all(0 <= p <= 1 for r in out for p in r[1:5])
        assert len({tuple(r) for r in out if r.doc_id == 4}) == 1
    for some in (labels.limit(0), labels.where("quality = 1")):
        for own in (docs, empty(spark)):
            featured = cotraining.features(own)
            model = cotraining.train(featured, some)
            assert cotraining.judge(featured, model).count() == own.count()


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, universe in ((0, 10), (1, 10), (1000, 1 << 62), (5000, 6000)):
        values = np.unique(rng.integers(0, universe, n))
        sequence = elias_fano.EliasFano(elias_fano.build(values, universe))
        asked = rng.integers(0, universe, 500)
        assert (sequence.get(np.arange(len(values))) == values).all()
        assert (sequence.find(values) == np.arange(len(values))).all()
        assert ((sequence.find(asked) >= 0) == np.isin(asked, values)).all()


def test_lm_scoring(spark, docs):
    train = docs.where("doc_id <> 6")
    model = ngram_lm.train(train)
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) + ["\n"]
    counts = Counter(w for row in train.collect() for w in tokens(row.text))
    total, kinds = sum(counts.values()), len(counts)
    for row in ngram_lm.score(docs, model).collect():
        words = tokens(TEXTS[row.doc_id])
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), total)
        assert row.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in words))
    scores = {r.doc_id: (r.base_score, r.score) for r in ngram_lm.score(docs, model).collect()}
    assert scores[9][1] > scores[9][0] and scores[7][1] > scores[7][0]
    assert ngram_lm.train(empty(spark)).total == 0


def test_lm_scoring_keeps_rare_ngrams(spark):
    texts = [LONG, "once upon a time there was a fox", None, "time upon a once fox a was there"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = ngram_lm.train(docs.where("doc_id < 3"))
    grams = [Counter(), Counter(), Counter()]
    split = [(t or "").split() + ["\n"] for t in texts]
    for words in split[:3]:
        for n in range(3):
            grams[n].update(tuple(words[i - n : i + 1]) for i in range(n, len(words)))
    total, kinds = sum(grams[0].values()), len(grams[0])
    follow = [{}, {}]
    for n in (1, 2):
        for g, c in grams[n].items():
            follow[n - 1][g[:-1]] = follow[n - 1].get(g[:-1], 0) + c - 0.75

    def chance(words, i):
        p = (grams[0][(words[i],)] + 1) / (total + kinds + 1)
        for n in (1, 2):
            before = tuple(words[i - n : i])
            if i >= n and grams[n - 1][before]:
                seen = grams[n][(*before, words[i])]
                p = p * max(1 - follow[n - 1].get(before, 0) / grams[n - 1][before], 1e-9) + (max(seen - 0.75, 0) / grams[n - 1][before])
        return p

    scores = {r.doc_id: r for r in ngram_lm.score(docs, model).collect()}
    for i, words in enumerate(split):
        # probabilities are kept in steps of 10 ** 0.04
        assert scores[i].score == pytest.approx(sum(math.log10(chance(words, at)) for at in range(len(words))), abs=0.04 * len(words))
    assert scores[0].score > scores[0].base_score and scores[1].score > scores[1].base_score and scores[1].score > scores[3].score


def test_lm_tokens():
    texts = ["", None, "a b", " lead and  trail ", "x" * 63 + " " + "y" * 64 + " " + "z" * 65, "X" * 1000, "tab\tand\x0bvt\x0c ff\r\n", "é ü\xa0nbsp", "a", "b"]
    for array in (ngram_lm.pa.array(texts), ngram_lm.pa.array(["cut", *texts])[1:]):
        flat, ends = ngram_lm.tokens(array)
        want = [w for t in texts for w in [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), "END"]]
        known = dict(zip(want, flat.tolist(), strict=True))
        assert len(set(known.values())) == len(known) and flat.tolist() == [known[w] for w in want]
        assert ends.tolist() == [i + 1 for i, w in enumerate(want) if w == "END"]


def test_lm_of_many_parts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{int(x)}" for x in np.minimum(rng.zipf(1.3, 300), 500)) for _ in range(40)]
    docs = spark.createDataFrame([*enumerate(texts), (99, texts[0])], "doc_id long, text string").repartition(3)
    whole = {r.doc_id: r.score for r in ngram_lm.score(docs, ngram_lm.train(docs)).collect()}
    # rows of one text in several blocks, words that are dealt over many parts
    monkeypatch.setattr(ngram_lm, "PART_TOKENS", 300)
    monkeypatch.setattr(ngram_lm, "MOST_ROWS", 70)
    model = ngram_lm.train(docs)
    assert model.shape.parts > 30 and len(model.shape.frequent) > 3 and model.shape.shares.max() > 3
    assert {r.doc_id: r.score for r in ngram_lm.score(docs, model).collect()} == pytest.approx(whole)
    model.remove()


def test_decontamination(spark, docs):
    bench = [(1, "one TWO three"), (2, None), (3, ""), (4, " ".join(LONG.split()[500:530])), (4, " ".join(LONG.split()[500:530])), (5, "no such words in any document at all, never, not one")]
    items = spark.createDataFrame(bench, "item_id long, text string")
    want = decontaminate.brute([(i, t if i != 7 else " ".join(LONG.split()[:1500])) for i, t in enumerate(TEXTS)], bench)
    short = docs.selectExpr("doc_id", f"if(doc_id = 7, '{' '.join(LONG.split()[:1500])}', text) text")
    assert {tuple(r) for r in decontaminate.report(short, items).collect()} == set(want)
    cleaned = {r.doc_id: r.text for r in decontaminate.clean(docs, items).collect()}
    assert 3 not in cleaned and "w500x4 w501x5" not in cleaned[7] and cleaned[0] is None
    assert decontaminate.report(docs, items.limit(0)).where("contaminated").count() == 0


def test_decontamination_in_blocks(spark):
    rng = np.random.default_rng(8)
    word = lambda: f"w{int(min(rng.zipf(1.5), 30))}"
    bench = [(i % 40, " ".join(word() for _ in range(rng.integers(1, 16)))) for i in range(60)]
    texts = [None, "", *(rng.choice([" ", ", ", "\n"]).join(word() for _ in range(rng.integers(1, 60))) for _ in range(120)), *(f"x, {t}! y" for _, t in bench[:9])]
    items = spark.createDataFrame(bench, "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = set(decontaminate.brute(list(enumerate(texts)), bench))
    assert sum(r[-1] for r in want) > 20
    for most in (16_000_000, 700):
        assert {tuple(r) for r in decontaminate.report(docs, items, most).collect()} == want
    clash = docs.selectExpr("text __decon_words", "doc_id", "text", "doc_id __decon_spans", "text n_hit")
    out = decontaminate.clean(clash, items, most=700)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.columns == clash.columns and len(rows) == out.count()
    for doc_id, n_words, n_hit, *_ in want:
        assert (doc_id in rows) == (n_hit <= 0.5 * n_words)
        if doc_id in rows:
            assert rows[doc_id].n_hit == texts[doc_id] and rows[doc_id]["__decon_spans"] == doc_id
            assert len(decontaminate.words_of(rows[doc_id].text)) == n_words - n_hit


def test_token_counts(docs):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = token_counts.library(path)
    counter = token_counts.Counter(path, (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), chunk=700, overlap=60, huge=900)
    plain = token_counts.Counter(path, chunk=700, overlap=60, huge=900)
    for text in [*TEXTS, LONG[:9000].replace("x3", "<|endoftext|>"), ("日本 " * 20 + "\n  ") * 60, "a" * 3000 + " b"]:
        want = len(encoder.encode(text, add_special_tokens=False)) if text else 0
        assert counter.count(text) == want and plain.count(text) == want


def test_token_counts_with_special_strings(spark, monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    ranks = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    end = "<|endoftext|>"
    texts = [
        None, "", f"some words here {end} more. " * 3000, f"some words here!{end} more. " * 3000, f"word{end}word" * 5000, end * 6000, f"\n\n {end}\n" * 5000,
        "x" * 65_530 + end + " after the edge", "ab " * 21_842 + f" {end}!!", "<|endof" * 12_000, f"日本 {end}語 " * 6000, f"12{end}345 !?{end}?! " * 4000,
    ]
    encoder = token_counts.library(path)
    want = [len(encoder.encode(t, add_special_tokens=False)) if t else 0 for t in texts]
    docs = spark.createDataFrame([*enumerate(texts), (2, texts[2])], "doc_id long, text string").withColumn("n_tokens", pii.F.lit("x"))
    out = token_counts.count_tokens(docs, path, ranks).collect()
    assert len(out) == len(texts) + 1
    for row in out:
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len((texts[row.doc_id] or "").encode()), want[row.doc_id], want[row.doc_id] > 512)
    assert token_counts.count_tokens(empty(spark), path, ranks).count() == 0
    rng = np.random.default_rng(6)
    parts = [" ", "a", "word", "!", "<|", "|>", end, "\n", "12", "é", "'s", "  "]
    for chunk in (40, 90):
        counter = token_counts.Counter(path, ranks, chunk=chunk, overlap=20, huge=50)
        plain = token_counts.Counter(path, chunk=chunk, overlap=20, huge=50)
        for _ in range(150):
            text = "".join(rng.choice(parts, 120))
            n = len(encoder.encode(text, add_special_tokens=False))
            assert counter.count(text) == n and plain.count(text) == n


def test_language_id(spark, docs):
    profiles = language_id.learn(docs)
    grams = Counter(g for t in TEXTS[1::2] for w in language_id.letter_words(t) for g in language_id.grams_of(w))
    assert profiles["en"] == [language_id.code_of(g) for g in sorted(grams, key=lambda g: (-grams[g], g))[:300]]
    out = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, profiles).collect()}
    assert out[0] == out[1] == out[2] == ("und", 0.0) and all(0 <= s <= 1 for _, s in out.values())
    assert language_id.learn(empty(spark)) == {} and language_id.identify(docs, {}).where("lang_pred <> 'und'").count() == 0


def test_pieces(docs):
    encoded = pieces.encode(docs, pieces.model_path())
    assert encoded.where("not round_trip").count() == 0
    decoded = {r.doc_id: r.text for r in pieces.decode(encoded, pieces.model_path()).collect()}
    assert all(decoded[i] == t for i, t in enumerate(TEXTS))
    model = pieces.Pieces([("a", -1.0, 300), ("ab", -1.5, 301), ("b", -1.0, 302), ("abc", -9.0, 303), ("c", -1.0, 304)], list(range(256)))
    assert model.encode("abcab") == [301, 304, 301]
    assert model.many([b"abcab"])[0] == model.one(b"abcab")


def test_jaccard_join(spark):
    words = [f"w{i}" for i in range(60)]
    edited = lambda *at: " ".join(f"e{i}_{at[0]}" if i in at else w for i, w in enumerate(words))
    texts = [None, "", *[edited(i) for i in range(12)], *[edited(i, i + 20) for i in range(12)], edited(5), "two words", "two words", LONG, LONG + " more"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(5, texts[5])], "doc_id long, text string")
    sets = [jaccard_join.shingles(t) for t in texts]
    parent = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((parent[a], parent[b]))
                parent = [low if p == high else p for p in parent]
    for most in (400_000, 0):
        out = jaccard_join.classes(docs, most_broadcast=most).collect()
        assert len(out) == len(texts) + 1 and all(r.class_id == parent[r.doc_id] for r in out)
    kept = jaccard_join.one_of_each(docs.withColumn("bands", docs.text))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(parent))
    assert jaccard_join.classes(docs.limit(0)).count() == 0


def test_one_of_each_with_repeated_ids(spark):
    words = [f"w{i}" for i in range(60)]
    text = lambda *at: " ".join("e" if i in at else w for i, w in enumerate(words))
    rows = [(1, text()), (1, "another text entirely"), (2, text(3)), (2, text(3)), (2, None), (2, None), (3, "another text entirely"), (4, ""), (None, text()), (5, text(50)), (0, "short one"), (0, "short two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clash = docs.selectExpr("text gone_id", "doc_id", "text `row`", "text", "text kept_key", "1 as stays")
    want = sorted([(1, text()), (1, "another text entirely"), (2, None), (2, None), (4, ""), (None, text()), (0, "short one"), (0, "short two")], key=repr)
    for most in (400_000, 0):
        out = jaccard_join.one_of_each(clash, most_broadcast=most)
        assert out.columns == clash.columns and sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == want
        assert all(r.gone_id == r.text == r.row == r.kept_key for r in out.collect())
    found = [tuple(r) for r in jaccard_join.classes(docs).collect()]
    assert sorted(r[:2] for r in found if r[0] is not None) == [(0, 0), (0, 0), (1, 1), (1, 1), (2, 1), (2, 1), (2, 2), (2, 2), (3, 1), (4, 4), (5, 1)]
    assert {r[2] for r in found if r[0] == 5} == {1} and {r[3] for r in found if r[0] == 3} == {1}


def test_jaccard_join_counts_all_links(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(60):
        own = list(words)
        for at in rng.integers(0, 80, rng.integers(0, 4)):
            own[at] = f"e{at}_{rng.integers(0, 3)}"
        texts.append(" ".join(own[rng.integers(0, 3) :] if i % 2 else own))
    texts = sorted(set(texts), key=lambda t: hashlib.sha256(t.encode()).digest()) + ["other words entirely"]
    sets = [jaccard_join.shingles(t) for t in texts]
    want = [sum(a != b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 for b in range(len(texts))) for a in range(len(texts))]
    docs = spark.createDataFrame([*enumerate(texts), (1000, texts[0]), (0, texts[0])], "doc_id long, text string")
    for block in (2000, 7):
        monkeypatch.setattr(jaccard_join, "BLOCK_TEXTS", block)
        out = jaccard_join.classes(docs).collect()
        assert len(out) == len(texts) + 2
        assert all(r.n_links == want[r.doc_id % 1000] for r in out)


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://A.example.NET/en/1", "https://x.net", "https://x.net/", "http://example.com/de/?q", "http://y.org/fr/a#b", "http://m.z.org/en/1/?utm_source=f", "http://z.org/en/1", "http://z.org/en/2"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([("https://www.z.org/en/1#t",), (None,)], "url string")
    out = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, listed).collect()}
    assert out[3] == ("example.net/en/", "allow") and out[4] == (None, "allow") and out[5] == ("net/", "block") and out[6] == ("example.com/de/", "block") and out[7] == ("org/fr/", "allow")
    assert out[8] == out[9] == (None, "block") and out[10] == out[0] == out[2] == (None, "allow")
    assert url_filter.judge(pages, listed.limit(0)).where("on_list").count() == 0


def test_language_against_a_plain_version(spark):
    rng = np.random.default_rng(14)
    letters = {"xx": "aabbbcde", "yy": "bcdeeeaa", "zz": "zzyyx"}
    say = lambda lang, n: " ".join("".join(rng.choice(list(letters[lang]), rng.integers(1, 6))) for _ in range(n))
    rows = [(i, say(lang, int(rng.integers(1, 40))), lang) for i, lang in enumerate(sorted(letters) * 15)]
    rows += [(100, None, "xx"), (101, "12 !", "yy"), (102, "aa", None), (103, rows[0][1], "xx"), (None, rows[1][1], "yy"), (104, "q", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", pii.F.lit("x"))
    profiles = language_id.learn(docs)
    grams = lambda text: Counter(g for w in re.findall(r"[^\W\d_]+", (text or "").lower()) for g in language_id.grams_of(w))
    ranked = lambda counts: [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][:300]
    plain = {lang: ranked(sum((grams(t) for _, t, x in rows if x == lang), Counter())) for lang in letters}
    assert profiles == {lang: [language_id.code_of(g) for g in own] for lang, own in plain.items()}
    for row in language_id.identify(docs, profiles).collect():
        own = ranked(grams(row.text))
        if not own:
            assert (row.lang_pred, row.score) == ("und", 0.0)
            continue
        far = {lang: sum(abs(p.index(g) - i) if g in p else 300 for i, g in enumerate(own)) for lang, p in plain.items()}
        best = min(far, key=lambda x: (far[x], x))
        assert (row.lang_pred, row.score) == (best, pytest.approx(1 - far[best] / (300 * len(own))))
    # equal profiles: the first name wins
    same = language_id.identify(docs.where("doc_id = 0"), {"b": profiles["xx"], "a": profiles["xx"]}).first()
    assert same.lang_pred == "a"
    assert language_id.identify(empty(spark), profiles).count() == 0


def test_empty_tables(spark):
    none = empty(spark)
    assert pieces.encode(none, pieces.model_path()).count() == 0 and pieces.decode(pieces.encode(none, pieces.model_path()), pieces.model_path()).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, verdict string")
    listed = spark.createDataFrame([("http://a.org/x",), ("http://a.org/x",)], "url string")
    assert url_filter.judge(pages, listed).count() == url_filter.judge(pages, listed.limit(0)).count() == 0
    assert decontaminate.report(none, none.selectExpr("doc_id item_id", "text")).count() == 0
    model = ngram_lm.train(none)
    assert ngram_lm.score(none, model).count() == 0
    row = ngram_lm.score(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string"), model).collect()[0]
    assert (row.n_tokens, row.n_known, row.train_tokens, row.score) == (3, 0, 0, row.base_score)
    assert quality_rules.judge(none, quality_rules.train(none, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0


def test_url_list_with_clashing_names(spark):
    names = ["listed_key", "bloom_at", "bloom_block", "bloom_0", "possible", "key", "row", "on_list", "a.b"]
    urls = spark.createDataFrame([("u1",), ("u1",), ("u2",), (None,), ("",)], "url string").select("url", *(url_filter.F.lit(name).alias(name) for name in names))
    listed = spark.createDataFrame([("u1",), ("",), (None,)], "u string")
    found = url_filter.on_list(urls, "url", listed, "u")
    assert found.columns == ["url", *(n for n in names if n != "on_list"), "on_list"]
    rows = sorted(((r.url, r.on_list) for r in found.collect()), key=repr)
    assert rows == sorted([("u1", True), ("u1", True), ("u2", False), (None, False), ("", True)], key=repr)
    assert all(r[name] == name for r in found.collect() for name in names if name != "on_list")
