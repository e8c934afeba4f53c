"""X1, X3, X5, X7 and X8 against plain versions: nulls, empties, repeats, long values, hot keys, clashing names."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.corpus import conversations, exact_copies, html_text, licences, repeated_lines

# X1


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("r"), "h": F.lit(1), "n_copies": F.lit(None).cast("int")}).repartition(3)


@pytest.mark.parametrize("hashed", [F.xxhash64, lambda c: F.length(c) % 2, lambda c: F.lit(7)])
def test_exact_copies(spark, hashed):
    rng = random.Random(1)
    rows = [(rng.randint(0, 40), rng.choice(["a", "A", "a ", "", "bb", "é", "é", "x" * 300_000])) for _ in range(80)]
    rows += [(None, "only null"), (None, "a"), (3, None), (3, None), (None, None), (5, "a"), (5, "a")]
    want = Counter()
    for text in {t for _, t in rows if t is not None}:
        ids = [i for i, t in rows if t == text]
        want[min((i for i in ids if i is not None), default=None), len(ids)] += 1
    want.update((i, 1) for i, t in rows if t is None)
    docs = documents(spark, rows)
    assert Counter(tuple(r) for r in exact_copies.kept(docs, hashed).collect()) == want
    whole = exact_copies.without_copies(docs)
    assert whole.columns == docs.columns and Counter(r.doc_id for r in whole.collect()) == Counter(i for (i, _), n in want.items() for _ in range(n))
    assert exact_copies.kept(docs.limit(0)).count() == exact_copies.without_copies(docs.limit(0)).count() == 0


def test_copies_meet_only_after_each_task_has_counted_them(spark):
    plan = exact_copies.kept(documents(spark, [(1, "a")]))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Aggregate") >= 2


# X3


def plain_lines(rows, most):
    seen = Counter(line for _, t in rows if t is not None for line in set(t.split("\n")) if line.strip(" \t\r"))
    out = []
    for i, t in rows:
        lines = [] if t is None else t.split("\n")
        left = [x for x in lines if seen[x] <= most]
        out.append((i, None if t is None else "\n".join(left), len(lines), len(lines) - len(left)))
    return out


@pytest.mark.parametrize("salted", [False, True])
def test_repeated_lines(spark, monkeypatch, salted):
    rng = random.Random(2)
    common = ["shared line", "other one", " ", "", "\t", "tail\r", "rare"]
    text = lambda: "\n".join(rng.choice([*common, f"own {rng.randint(0, 99)}"]) for _ in range(rng.randint(0, 9)))
    rows = [(i, text()) for i in range(60)] + [(1, None), (None, "shared line"), (2, ""), (2, ""), (3, "shared line\nshared line"), (4, "\n".join(f"w{i}" for i in range(50_000)) + "\nshared line\nend")]
    frame = documents(spark, rows)
    if salted:
        monkeypatch.setattr(repeated_lines._met, "__defaults__", (0,))
    found = repeated_lines.without_repeated_lines(frame, 5)
    order = lambda x: sorted(x, key=repr)
    assert order(tuple(r) for r in found.collect()) == order(plain_lines(rows, 5))
    assert repeated_lines.without_repeated_lines(documents(spark, rows).limit(0)).count() == 0


def test_lines_whose_hashes_clash_are_compared(spark, monkeypatch):
    rows = [(i, f"line {i % 7}\nall") for i in range(40)]
    monkeypatch.setattr(repeated_lines.F, "xxhash64", lambda *c: F.length(F.col(c[0]) if isinstance(c[0], str) else c[0]).cast("long"))
    found = repeated_lines.without_repeated_lines(documents(spark, rows), 10)
    assert sorted(tuple(r) for r in found.collect()) == sorted(plain_lines(rows, 10))


def test_a_hot_line_is_spread(spark):
    """The rows of one line are dealt to many keys."""
    rows = spark.range(4_000).selectExpr("id AS row", "0 AS place", "'hot' AS line", "id AS h")
    few = spark.createDataFrame([("hot",)], "line string")
    for bound in (0, repeated_lines.MOST_BYTES):
        met = repeated_lines._met(rows, few, "line", bound)
        assert met.count() == 4_000 and met.columns == ["line", "row", "place", "h"]
        assert ("SortMergeJoin" in met._jdf.queryExecution().executedPlan().toString()) == (bound == 0)
    salts = rows.select(F.pmod(F.xxhash64("row", "place"), F.lit(repeated_lines.SALTS)).alias("s")).groupBy("s").count()
    assert salts.count() == repeated_lines.SALTS and salts.agg(F.max("count")).first()[0] < 4_000 / 20


# X7


@pytest.mark.parametrize(
    "page, title, text",
    [
        ("<p>one</p><p>two", None, "one\ntwo"),
        ("<script>var t='</p><p>no';</script>a<b>b</b>c", None, "abc"),
        ("<SCRIPT type='a>b'>x</scripty></SCRIPT >after", None, "after"),
        ("<p title='a > b' alt=\"<p>\">in</p>", None, "in"),
        ("<a href=x>y>link</a>", None, "y>link"),
        ("<a href = '>' b>link</a >", None, "link"),
        ("a<!-- <p>x</p> -- > --><!-->b<!--->c<!----!>d", None, "abcd"),
        ("a<!-- never closed <p>b", None, "a"),
        ("<title>A &amp;\n B</title><title>no</title>x", "A & B", "x"),
        ("<textarea><p>&lt;</textarea>y", None, "<p><y"),
        ("1 < 2 & 3 > 2 &lt;b&gt; &#65;&#x42;&eacute;&nbsp;z &unknown; &copy", None, "1 < 2 & 3 > 2 <b> ABé z &unknown; ©"),
        ("</>a</ b>c<?php echo ?>d<!DOCTYPE html>e</", None, "acde</"),
        ("<div>a<div>b</div>c</div>  d\n\n e<br>f<br/>g", None, "a\nb\nc\nd e\nf\ng"),
        ("<pre>a  b\n c</pre>x\ny", None, "a b\nc\nx y"),
        ("<table><tr><td>1<td>2<tr><th>3</table>", None, "1 2\n3"),
        ("<style>p{}</style", None, ""),
        ("text<p", None, "text"),
        ("text<", None, "text<"),
        ("<é>é", None, "<é>é"),
        ("", None, ""),
        (None, None, None),
    ],
)
def test_pages(page, title, text):
    assert html_text.text_of(page) == (title, text)


def plain_tokens(page):
    """Text outside tags, one character after another, for pages of simple parts."""
    out, state, quote = [], "text", ""
    for i, c in enumerate(page):
        if state == "text" and c == "<" and page[i + 1 : i + 2].isalpha() | (page[i + 1 : i + 2] == "/"):
            state = "tag"
        elif state == "tag" and c == "=":
            state = "value"
        elif state == "value" and c in "\"'":
            state, quote = "quoted", c
        elif state == "quoted" and c == quote:
            state = "tag"
        elif state in ("tag", "value") and c == ">":
            state = "text"
        elif state == "text":
            out.append(c)
    return "".join(out)


def test_drawn_pages_against_a_plain_reader():
    rng = random.Random(3)
    parts = ["<i>", "</i>", "<i a='>'>", '<i b="</i><">', "<i c=d>", "word", " > ", "'", '"', "="]
    for _ in range(500):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))
        assert "".join(v for k, v in html_text.tokens(page) if k == "text") == plain_tokens(page)


def test_pages_in_spark(spark):
    long = "<p>x &amp; y</p>\n" * 100_000
    pages = spark.createDataFrame([(1, long), (2, "<" * 200_000), (3, None), (3, ""), (None, "<title>t"), (4, "<!--" * 50_000)], "page_id long, html string").withColumn("text", F.lit("own"))
    found = {(r.page_id, r.n_lines, r.title) for r in html_text.page_texts(pages).collect()}
    assert found == {(1, 100_000, None), (2, 1, None), (3, 0, None), (None, 0, "t"), (4, 0, None)}
    assert html_text.page_texts(pages.limit(0)).count() == 0


def test_url_parts(spark):
    urls = ["HTTPS://user:p@Host.Example:8080/a/b?x=1?y#f#g", "//host/p", "mailto:a@b.c", "", None, "http://[::1]:80", "/just/path", "http://a:b:c/", "x\ny", "http://h#a\nb"]
    found = {r.url: tuple(r)[1:-1] for r in html_text.url_parts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).join(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), "page_id").collect()}
    assert found[urls[0]] == ("https", "host.example", "8080", "/a/b", "x=1?y", "f#g")
    assert found[urls[1]] == ("", "host", "", "/p", "", "") and found[urls[2]] == ("mailto", "", "", "a@b.c", "", "") and found[""] == ("",) * 6 and found[None] == (None,) * 6
    assert found[urls[5]] == ("http", "[::1]", "80", "", "", "") and found[urls[6]][3] == "/just/path" and found[urls[7]][1] == "" and found[urls[9]][5] == "a\nb"


# X8


def plain_conversations(rows, part):
    single = {}
    for conv, turn, role, text in rows:
        if conv is not None and turn is not None:
            single.setdefault(conv, {}).setdefault(turn, []).append((role is not None, role or "", text is not None, text or ""))
    out = []
    for conv, turns in single.items():
        last, from_role, by = None, None, {}
        for turn in sorted(turns):
            _, role, _, text = min(turns[turn])
            role = role or "?"
            good = (from_role is None and role in ("system", "user")) or (from_role in ("system", "assistant") and role == "user") or (from_role == "user" and role == "assistant")
            own = by.setdefault(turn // part, [turn, turn, 0, 0, 0, 0, []])
            own[1], own[2], own[3], own[4], own[5] = turn, own[2] + 1, own[3] + len(turns[turn]) - 1, own[4] + (0 if last is None else turn - last - 1), own[5] + (not good)
            own[6].append(f"{role}: {text}")
            last, from_role = turn, role
        out += [(conv, p, *x[:6], "\n".join(x[6])) for p, x in by.items()]
    return sorted(out)


@pytest.mark.parametrize("part", [1_000, 3, 1])
def test_conversations(spark, part):
    rng = random.Random(part)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([*range(-3, 12), None]), rng.choice(["system", "user", "assistant", "tool", None]), rng.choice(["a", "b\nc", "", None])) for _ in range(90)]
    rows += [(7, i, ["system", "user", "assistant"][0 if i == 0 else 2 - i % 2], f"t{i}") for i in range(7)] + [(8, None, "user", "lost")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("own")).repartition(3)
    found = sorted(tuple(r) for r in conversations.parts(turns, part).collect())
    assert found == plain_conversations(rows, part)
    sums = {r.conv_id: r for r in conversations.summary(turns, part).collect()}
    assert sums[7].sound and (sums[7].n_turns, sums[7].n_role_breaks) == (7, 0) and not sums[8].sound and (sums[8].n_turns, sums[8].n_unplaced) == (0, 1)
    for conv in (1, 2, 3):
        own = [x for x in found if x[0] == conv]
        assert tuple(sums[conv])[1:5] == tuple(sum(x[i] for x in own) for i in (4, 5, 6, 7))
        assert sums[conv].n_unplaced == sum(r[0] == conv and r[1] is None for r in rows)
    assert conversations.parts(turns.limit(0)).count() == conversations.summary(turns.limit(0)).count() == 0


def test_a_long_conversation_is_in_parts(spark):
    turns = spark.range(100_000).selectExpr("1 AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "'text' AS text")
    found = conversations.parts(turns).agg(F.count("*"), F.max("n_turns"), F.sum("n_role_breaks"), F.sum("n_missing")).first()
    assert tuple(found) == (100, 1_000, 0, 0) and conversations.summary(turns).first().sound


# X5


def plain_notices(rows, phrases):
    out = []
    for i, text in rows:
        for family, own in phrases.items():
            words = "|".join("[^0-9A-Za-z]+".join(re.findall("[0-9A-Za-z]+", p)) for p in own)
            out += [(i, family, m.start(), m.end()) for m in re.finditer(words, text or "", re.IGNORECASE | re.ASCII)] if own else []
    return sorted(out, key=repr)


def test_licence_notices(spark):
    lines = ["Licensed under the Apache License, Version 2.0.", "RELEASED\nunder the  MIT-License", "gnu general public license", "All rights reserved", "Licensed under CC BY-NC 4.0.", "the license of no one", "é🎉 grüße", "a" * 50_000]
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(lines) for _ in range(rng.randint(0, 6)))) for i in range(60)] + [(3, None), (None, lines[0]), (4, ""), (5, f"{lines[0]} " * 2_000)]
    found = sorted((tuple(r) for r in licences.notices(documents(spark, rows)).collect()), key=repr)
    assert found == plain_notices(rows, licences.PHRASES) and len({f for _, f, _, _ in found}) == 5
    own = {"mine": ("my licence", "my"), "none": ()}
    said = spark.createDataFrame([(1, "My licence, my own")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in licences.notices(said, own).orderBy("start").collect()] == [("mine", 0, 10), ("mine", 12, 14)]
    assert licences.notices(said, {}).count() == licences.notices(said.limit(0)).count() == 0


def test_planted_licence_lines(spark):
    """Every line of the tables that says it is a licence is found under its family, and no text without one has a notice."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    planted = {"apache": "Licensed under the Apache License, Version 2.0.", "mit": "Released under the MIT License.", "gpl": "This work is licensed under the GNU General Public License, version 3.", "cc": "Licensed under CC BY-NC 4.0.", "proprietary": "All rights reserved."}
    want = {(r.doc_id, family) for family, line in planted.items() for r in docs.where(F.contains("text", F.lit(line))).select("doc_id").collect()}
    found = {(r.doc_id, r.family) for r in licences.notices(docs).collect()}
    assert want and len(found & want) == len(want) and not found - want, (len(want), len(found), sorted(found - want)[:5])


def test_references_without_a_semicolon_stay_in_the_query(spark):
    page = "<title>a&amp;&amp</title><p>&lt;&copy &amp;lt; &#65;&#66 &eacute; &ampx; &no;</p>"
    assert html_text.text_of(page) == ("a&&", "<© &lt; AB é &x; &no;")
    pages = spark.createDataFrame([(1, page)], "page_id long, html string")
    (row,) = html_text.page_texts(pages, html_text.closed_references).collect()
    assert (row.title, row.text) == ("a&&amp", "<&copy &lt; A&#66 é &ampx; &no;")
