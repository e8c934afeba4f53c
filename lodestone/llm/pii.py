"""Personal data by candidate gradient boosting. Spark SQL expressions only where rows are handled.

Fixed base rules find emails, IP addresses, cards and phones; their spans always stay. Generators of high recall
propose further spans, which may overlap: every number-like run whole, each of its parts between spaces and each
sequence of such parts of up to MOST_DIGITS digits, spelled-out or bracketed emails, and long runs of letters and
digits, which may be secrets such as access tokens. Boosted trees, trained here on
drawn examples and written out as CASE expressions, judge a proposal by its format and the text beside it; it is taken
from a threshold that is calibrated for PRECISION. Of overlapping proposals of a run, the likelier is
taken; a run that is taken as a whole stays beside a likelier part, so that nothing of it goes free.

Offsets are code points, ends exclusive. Rows: null and empty texts have no spans. Repeated rows are judged each;
other columns of whatever name are carried along by redact() and not read by find(); an empty table gives an empty
result. Secrets have a column of their own beside the spans of the four kinds.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbm

KINDS = ("email", "ip", "card", "phone")
#: The kinds that redact() puts marks for.
MARKS = (*KINDS, "secret")
#: Share of right ones among the drawn examples that a threshold lets through.
PRECISION = 0.995
#: A card has the most digits of all kinds.
MOST_DIGITS = 19

#: Base patterns. Runs are possessive and start at their first character, which changes no match but keeps the
#: search linear in the text.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_IP = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"
_DIGITS = r"regexp_replace(x, '[^0-9]', '')"
VALID = {
    "email": "true",
    "ip": f"x rlike r'{_IP}'",
    "card": f"length({_DIGITS}) between 16 and 19 and luhn_check({_DIGITS})",
    "phone": f"length({_DIGITS}) between 8 and 15",
}

#: Generators.
NUMBERS = r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9])++"
SPELLED = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:\x20?[\[({](?:at|AT|@)[\])}]\x20?|\x20(?:at|AT)\x20|\x20@\x20?|@\x20)"
    r"[A-Za-z0-9-]++(?:(?:\x20?[\[({](?:dot|DOT|\.)[\])}]\x20?|\x20(?:dot|DOT)\x20|\.)[A-Za-z0-9-]++)++"
)

#: Features: SQL over x (the proposal), l (up to 24 characters before it, lower case) and r (the next character).
_near = lambda words: f"cast(l rlike r'(?:^|[^a-z])(?:{words})[^a-z0-9]*$' as int)"
_drop = lambda chars: f"(length(x) - length(translate(x, '{chars}', '')))"
NUMBER_FEATURES = {
    "digits": f"length({_DIGITS})",
    "plus": "cast(startswith(x, '+') as int)",
    "dots": _drop("."),
    "dashes": _drop("-"),
    "spaces": _drop(" "),
    "parens": _drop("()"),
    "groups": "size(regexp_extract_all(x, '[0-9]+', 0))",
    "first": "length(regexp_extract(x, '[0-9]+', 0))",
    "last": "length(regexp_extract(x, '[0-9]+$', 0))",
    "luhn": f"cast(luhn_check({_DIGITS}) as int)",
    "address": f"cast(x rlike r'{_IP}' as int)",
    "near_card": _near("card|visa|mastercard|amex|credit|debit|carte|karte|kreditkarte|tarjeta|cc"),
    "near_phone": _near("tel|phone|telephone|call|mobile|cell|fax|whatsapp|telefon|tel[eé]fono|t[eé]l[eé]phone|handy"),
    "near_ip": _near("ip|ipv4|host|server|address|addr|adresse|login from"),
    "near_other": _near("version|v|order|invoice|isbn|ref|no|nr|id|section|date|serial|part|sku|chapter|page|rev"),
    "letter_before": "cast(l rlike r'[\\p{L}0-9_]$' as int)",
    "letter_after": "cast(r rlike r'[\\p{L}0-9_]' as int)",
}
EMAIL_FEATURES = {
    "bracket_at": r"cast(x rlike r'[\[({](?:at|AT|@)[\])}]' as int)",
    "word_at": r"cast(x rlike r'\x20(?:at|AT)\x20' as int)",
    "spaced_at": r"cast(x rlike r'\x20@|@\x20' as int)",
    "bracket_dot": r"cast(x rlike r'[\[({](?:dot|DOT|\.)[\])}]' as int)",
    "word_dot": r"cast(x rlike r'\x20(?:dot|DOT)\x20' as int)",
    "top": "length(regexp_extract(x, '[A-Za-z0-9-]+$', 0))",
    "local_marked": r"cast(regexp_extract(x, r'^[A-Za-z0-9._%+-]+', 0) rlike '[0-9._+-]' as int)",
    "known_top": "cast(lower(regexp_extract(x, '[A-Za-z0-9-]+$', 0)) in ('com','org','net','edu','gov','de','fr','es','it','uk','eu','io','info') as int)",
    "near_mail": _near("mail|e-mail|email|contact|write|reach|courriel|correo|kontakt|address"),
}
#: Runs that may be secrets; one without a digit is a word.
SECRETS = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{16,}+"
SECRET_FEATURES = {
    "long": "length(x)",
    "digits": f"length({_DIGITS})",
    "upper": "length(regexp_replace(x, '[^A-Z]', ''))",
    "lower": "length(regexp_replace(x, '[^a-z]', ''))",
    "distinct": "size(array_distinct(split(x, '')))",
    "hexadecimal": "cast(x rlike '^(?:[0-9a-f]+|[0-9A-F]+)$' as int)",
    "joints": "length(regexp_replace(x, '[A-Za-z0-9]', ''))",
    "longest": "array_max(transform(split(x, '[^A-Za-z0-9]'), p -> length(p)))",
    "changes": "regexp_count(x, '[A-Za-z][0-9]|[0-9][A-Za-z]')",
    "prefix": "cast(x rlike '^(?:sk|pk|rk|ghp|gho|ghs|glpat|xox[abp]|AKIA|ASIA|AIza|eyJ)' as int)",
    "near_secret": _near("token|secret|key|apikey|api_key|password|passwd|pwd|auth|bearer|credential|credentials|access_key|secret_key|access_token"),
    "near_sum": _near("commit|sha|sha1|sha256|md5|checksum|hash|digest|uuid|etag|build|revision|id|version"),
    "assigned": "cast(l rlike '[:=] ?[\"\\'`]?$' as int)",
    "quoted": "cast(l rlike '[\"\\'`]$' and r rlike '[\"\\'`]' as int)",
}
FEATURES = {"email": EMAIL_FEATURES, "secret": SECRET_FEATURES}


def _features(kind: str) -> dict[str, str]:
    return FEATURES.get(kind, NUMBER_FEATURES)


def _draw_secret(rng: random.Random) -> tuple[str, str, str, str]:
    of = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    mixed = lower + lower.upper() + digits
    plain = rng.choice(["and ", "the ", "(", "see ", "de ", "", "/"])
    quote = rng.choice(["\"", "'", "", "`"])
    if rng.random() < 0.45:
        name = rng.choice(["token", "secret", "api_key", "key", "password", "access_token", "auth", "SECRET_KEY"])
        before = f"{name}{rng.choice([' = ', '=', ': ', ':', ' '])}{quote}"
        body = rng.choice(
            [
                lambda: of(digits + "abcdef", rng.choice([24, 32, 40, 48, 64])),
                lambda: of(mixed, rng.randrange(18, 60)),
                lambda: of(mixed + "+/", rng.randrange(24, 60)) + rng.choice(["", "=", "=="]),
                lambda: rng.choice(["sk-", "ghp_", "pk_", "glpat-", "AKIA", "AIza", "xoxb-"]) + of(mixed, rng.randrange(16, 40)),
            ]
        )()
        if body[:2] in ("sk", "gh", "pk", "gl", "AK", "AI", "xo") and rng.random() < 0.5:
            before, quote = plain, ""
        return "secret", body, before, quote or rng.choice([" ", ".", "\n", ""])
    body = rng.choice(
        [
            lambda: "-".join(of(lower, rng.randrange(2, 9)) for _ in range(rng.randrange(3, 7))) + f"-{rng.randrange(2030)}",
            lambda: "_".join(of(lower, rng.randrange(2, 9)) for _ in range(rng.randrange(3, 6))) + str(rng.randrange(99)),
            lambda: "/".join(of(lower, rng.randrange(2, 9)) for _ in range(rng.randrange(3, 6))) + f"/{rng.randrange(9999)}",
            lambda: "-".join(of(digits, 4) for _ in range(4)),
            lambda: of(digits, rng.randrange(16, 30)),
            lambda: of(lower, rng.randrange(14, 30)) + str(rng.randrange(99)),
            lambda: of(digits + "abcdef", 40),
            lambda: "-".join(of(digits + "abcdef", n) for n in (8, 4, 4, 4, 12)),
            lambda: "=" * rng.randrange(12, 40) + str(rng.randrange(99)) + "=" * rng.randrange(4, 20),
            lambda: "-" * rng.randrange(16, 40) + str(rng.randrange(99)),
        ]
    )()
    sums = rng.choice(["commit ", "sha1: ", "md5 = ", "checksum: ", "uuid ", "id=", "build ", "etag: \""])
    return "", body, sums if rng.random() < 0.6 or len(body) == 40 and "-" not in body else plain, rng.choice([" ", ".", "\n", "", "\""])


def _draw_numbers(rng: random.Random) -> tuple[str, str, str, str]:
    """A kind ("" for none), a number, the text before and the character after."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def luhn(n: int) -> str:
        body = digits(n - 1)
        total = sum(int(c) if i % 2 else (int(c) * 2 - 9 * (int(c) > 4)) for i, c in enumerate(reversed(body)))
        return body + str(-total % 10)

    plain = rng.choice(["the end of ", "and there is ", "une fois ", "der wert ", "", "(", "que ", ": "])
    after = rng.choice([" ", ".", ",", ")", "", "\n"])
    kind = rng.choice(["card", "phone", "ip", "", "", ""])
    if kind == "card":
        near = rng.random() < 0.4
        size = rng.choice([13, 14, 15, 16, 16, 16, 16, 19])
        number = luhn(size)
        shape = rng.random()
        if shape < 0.35:
            number = rng.choice(" -.").join(number[i : i + 4] for i in range(0, len(number), 4))
        return kind, number, rng.choice(["card number ", "visa: ", "credit card ", "cc "]) if near or size != 16 else plain, after
    if kind == "phone":
        near = rng.random() < 0.5
        local = rng.choice(["({}) {}-{}", "{}-{}-{}", "{} {} {}", "{}.{}.{}"]).format(digits(3), digits(3), digits(4))
        number = f"+{digits(rng.choice([1, 2]))}{rng.choice(' -')}{local}" if rng.random() < 0.5 else local
        sure = number[0] in "+("
        return kind, number, rng.choice(["tel ", "phone: ", "call ", "mobile "]) if near or not sure else plain, after
    if kind == "ip":
        number = ".".join(str(rng.randrange(256)) for _ in range(4))
        return kind, number, rng.choice(["ip ", "host ", "server "]) if rng.random() < 0.4 else plain, after
    other = rng.choice(["order ", "invoice no. ", "isbn ", "version ", "serial ", "section ", "date "])
    number = rng.choice(
        [
            lambda: digits(rng.randrange(2, 13)),
            lambda: digits(rng.randrange(13, 25)),
            lambda: f"{rng.randrange(1900, 2100)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}",
            lambda: f"{digits(2)}.{digits(2)}.{digits(4)}",
            lambda: ".".join(str(rng.randrange(30)) for _ in range(rng.choice([2, 3, 5, 6]))),
            lambda: ".".join(str(rng.randrange(256, 2000)) for _ in range(4)),
            lambda: " ".join(digits(rng.randrange(1, 7)) for _ in range(rng.randrange(2, 9))),
            lambda: "-".join(digits(rng.randrange(1, 6)) for _ in range(rng.randrange(2, 6))),
            lambda: f"{digits(3)}-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}",
            lambda: f"{digits(3)}-{digits(3)}-{digits(4)}",
        ]
    )()
    return "", number, rng.choice([other, plain]), rng.choice([after, "a", "x"])


def _draw_email(rng: random.Random) -> tuple[str, str, str, str]:
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuvw") for _ in range(rng.randrange(2, 9)))
    if rng.random() < 0.5:
        at = rng.choice([" (at) ", "(at)", " [at] ", "[at]", " at ", " @ ", "{at}"])
        dot = rng.choice([" (dot) ", "[dot]", " dot ", "."] if at != " at " else [" dot "])
        local = word() + rng.choice(["", ".", "_"]) + rng.choice([word(), str(rng.randrange(100))])
        top = rng.choice(["com", "org", "net", "de", "fr", "es", "io"])
        return "email", f"{local}{at}{word()}{dot}{top}", rng.choice(["mail ", "contact: ", "and ", "", "the "]), " "
    text = rng.choice([f"{word()} at {word()}.{word()}", f"{word()} at {word()}.{rng.randrange(99)}", f"{word()} @ {rng.randrange(9)}.{rng.randrange(99)}", f"{word()} at {word()}.{word().title()}"])
    return "", text, rng.choice(["we met ", "and ", "", "the "]), " "


def trained(kind: str, spark) -> tuple[gbm.Trees, float, float, float]:
    """Trees of a kind with their calibration (slope, intercept) and threshold; features come from the same SQL
    expressions that are used on documents."""
    return _trained(kind, _examples(spark, kind if kind in FEATURES else "number"))


_EXAMPLES: dict[str, tuple] = {}


def _examples(spark, what: str) -> tuple:
    if what not in _EXAMPLES:
        rng = random.Random(17)
        drawn = [{"email": _draw_email, "secret": _draw_secret}.get(what, _draw_numbers)(rng) for _ in range(3000)]
        features = _features(what)
        rows = ", ".join(f"({i}, {_quote(x)}, {_quote(left)}, {_quote(right)})" for i, (_, x, left, right) in enumerate(drawn))
        found = spark.sql(f"select i, {', '.join(f'{sql} as {name}' for name, sql in features.items())} from values {rows} as drawn(i, x, l, r)").collect()
        found.sort(key=lambda row: row.i)
        _EXAMPLES[what] = tuple(d[0] for d in drawn), tuple(tuple(row)[1:] for row in found)
    return _EXAMPLES[what]


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


@lru_cache(maxsize=8)
def _trained(kind: str, examples: tuple) -> tuple[gbm.Trees, float, float, float]:
    labels = np.array([k == kind for k in examples[0]], float)
    rows = np.array(examples[1], float)
    half = len(rows) // 2
    trees = gbm.fit(rows[:half], labels[:half], trees=25, depth=3, rate=0.3, bins=24)
    slope, intercept = gbm.calibrate(trees.margin(rows[half:]), labels[half:])
    p = 1 / (1 + np.exp(-(slope * trees.margin(rows[half:]) + intercept)))
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(labels[half:][order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(right >= PRECISION)
    return trees, slope, intercept, max(0.5, float(p[order][good[-1]])) if len(good) else 1.1


def margin_sql(trees: gbm.Trees, names: list[str], row: str) -> str:
    """The trees' sum as nested CASE expressions over the fields of a struct."""
    inner = trees.feature.shape[1]

    def node(feature, threshold, value, n: int) -> str:
        if n >= inner:
            return f"{value[n - inner]:.9g}D"
        low, high = node(feature, threshold, value, 2 * n + 1), node(feature, threshold, value, 2 * n + 2)
        if low == high or not np.isfinite(threshold[n]):
            return low
        return f"if({row}.{names[feature[n]]} <= {threshold[n]:.9g}D, {low}, {high})"

    return " + ".join([f"{trees.base:.9g}D", *(node(f, t, v, 0) for f, t, v in zip(trees.feature, trees.threshold, trees.value, strict=True))])


def _prefix(sizes: str, block: int = 128) -> str:
    """SQL: the sum of the numbers before each; in blocks, so that no long array is built step by step."""
    add = "(a, y) -> named_struct('o', array_append(a.o, a.t), 't', a.t + y)"
    empty = "named_struct('o', cast(array() as array<int>), 't', {})"
    return (
        f"if(size({sizes}) = 0, cast(array() as array<int>), element_at(transform(array(transform(sequence(0, (size({sizes}) - 1) div {block}), b -> slice({sizes}, cast(b * {block} + 1 as int), {block}))), "
        f"bs -> element_at(transform(array(aggregate(transform(bs, z -> aggregate(z, 0, (a, y) -> a + y)), {empty.format('0')}, {add}).o), "
        f"os -> flatten(transform(bs, (z, i) -> aggregate(z, {empty.format('element_at(os, i + 1)')}, {add}).o))), 1)), 1))"
    )


def _let(name: str, value: str, body: str) -> str:
    """SQL: body with name for value. Columns don't do for this: the optimiser moves the expression of a column that
    is read once to where it is read, which may be a lambda that runs for every match."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _matches(frame: DataFrame, name: str, pattern: str) -> DataFrame:
    """Adds name: an array of (x, l, r, s), a match with the text before it, the next character and its start."""
    text = "__text"
    each = (
        "transform(f.x, (x, i) -> named_struct('x', x, 'l', lower(right(element_at(f.g, i + 1), 24)), 'r', left(element_at(f.g, i + 2), 1), "
        "'s', element_at(o, i + 1) + length(element_at(f.g, i + 1))))"
    )
    starts = _let("o", _let("n", "transform(f.x, (x, i) -> length(x) + length(element_at(f.g, i + 1)))", _prefix("n")), each)
    cut = f"named_struct('x', x, 'g', if(size(x) = 0, array({text}), split({text}, r'{pattern}', -1)))"
    return frame.withColumns({name: F.expr(_let("x", f"regexp_extract_all({text}, r'{pattern}', 0)", _let("f", cut, starts)))})


def _span(kind: str, start: str, end: str) -> str:
    return f"named_struct('k', {MARKS.index(kind)}, 's', {start}, 'e', {end})"


_NONE = "cast(array() as array<struct<k:int,s:int,e:int>>)"


def spans(docs: DataFrame) -> DataFrame:
    """docs, a frame without columns that start with "__", with __base, __spans and __secrets: arrays of (k, s, e) sorted
    by kind and start."""
    spark = docs.sparkSession
    frame = docs.withColumns({"__text": F.coalesce("text", F.lit(""))})
    for kind, pattern in BASE.items():
        frame = _matches(frame, f"__{kind}", pattern)
        frame = frame.withColumns({f"__{kind}": F.expr(f"transform(filter(__{kind}, m -> {VALID[kind].replace('(x,', '(m.x,').replace('x rlike', 'm.x rlike')}), m -> {_span(kind, 'm.s', 'm.s + length(m.x)')})")})
    frame = frame.withColumns({"__base": F.expr("array_sort(concat(" + ", ".join(f"__{kind}" for kind in KINDS) + "))")}).drop(*(f"__{kind}" for kind in KINDS))

    def margin(kind: str, row: str) -> str:
        return margin_sql(trained(kind, spark)[0], list(_features(kind)), row)

    def least(kind: str) -> str:
        _, slope, intercept, threshold = trained(kind, spark)
        at = np.log(threshold / (1 - threshold)) if threshold < 1 else np.inf
        return f"{(at - intercept) / slope if slope > 0 and np.isfinite(at) else 1e9:.9g}D"

    def judged(kind: str, row: str) -> str:
        return f"({margin(kind, row)} >= {least(kind)})"

    def likely(kind: str, value: str) -> str:
        """The calibrated logarithm of the odds, which kinds have in common."""
        _, slope, intercept, _ = trained(kind, spark)
        return f"({slope:.9g}D * {value} + {intercept:.9g}D)"

    frame = _matches(frame, "__numbers", NUMBERS)
    # a run whole, and what lies between two of its spaces
    before = "lower(right(concat(if(i <= 24, m.l, ''), array_join(slice(w, greatest(i - 24, 0) + 1, least(i, 24)), ' '), if(i > 0, ' ', '')), 24))"
    part = f"named_struct('x', array_join(slice(w, i + 1, j - i + 1), ' '), 'l', {before}, 'r', if(j = size(w) - 1, m.r, ' '), 's', m.s + element_at(o, i + 1))"
    # a space may be followed by another, so there may be an empty part for each digit
    ends = f"sequence(i, least(i + {2 * MOST_DIGITS}, size(w) - 1))"
    fits = (
        f"w[i] <> '' and w[j] <> '' and (i = j or d[j] + n[j] - d[i] <= {MOST_DIGITS}) "
        "and o[j] + length(w[j]) - o[i] > 6 and not (i = 0 and j = size(w) - 1)"
    )
    parts = f"flatten(transform(sequence(0, size(w) - 1), i -> transform(filter({ends}, j -> {fits}), j -> {part})))"
    digits = _let("n", "transform(w, x -> length(translate(x, ' +().-', '')))", _let("d", _prefix("n"), parts))
    starts = _let("o", _let("n", "transform(w, x -> length(x) + 1)", _prefix("n")), digits)
    none = "cast(array() as array<struct<x:string,l:string,r:string,s:int>>)"
    parts = f"transform(__numbers, m -> concat(array(m), if(contains(m.x, ' '), {_let('w', "split(m.x, ' ')", starts)}, {none})))"
    # base spans in blocks by start, so that a proposal is held against few of them
    known = "exists(z, b -> b.s < q.s + length(q.x) and b.e > q.s and exists(b.v, v -> v.s < q.s + length(q.x) and v.e > q.s))"
    block = "named_struct('v', v, 's', v[0].s, 'e', array_max(transform(v, y -> y.e)))"
    blocks = (
        "if(size(a) = 0, cast(array() as array<struct<v:array<struct<s:int,e:int>>,s:int,e:int>>), "
        f"transform(transform(sequence(0, (size(a) - 1) div 128), j -> slice(a, cast(j * 128 + 1 as int), 128)), v -> {block}))"
    )
    beside = lambda body: _let("a", "array_sort(transform(__base, v -> named_struct('s', v.s, 'e', v.e)))", _let("z", blocks, body))
    frame = frame.withColumns({"__numbers": F.expr(parts)})
    numbers = ("card", "phone", "ip")
    margins = "named_struct(" + ", ".join(f"'{kind}', {margin(kind, 'g')}" for kind in numbers) + ")"
    chosen = "case " + " ".join(f"when t.{kind} >= {least(kind)} then named_struct('p', -{likely(kind, f't.{kind}')}, 'n', -length(q.x), 'k', {KINDS.index(kind)}, 's', q.s, 'e', q.s + length(q.x), 'whole', length(q.x) = length(c[0].x))" for kind in numbers) + " end"
    features = _bound("named_struct(" + ", ".join(f"'{name}', {sql}" for name, sql in NUMBER_FEATURES.items()) + ")", "q")
    one = f"if({known}, null, {_let('g', features, _let('t', margins, chosen))})"
    frame = frame.withColumns({"__numbers": F.expr(beside(f"transform(__numbers, c -> array_sort(filter(transform(c, q -> {one}), v -> v is not null)))"))})
    # the likelier and then the longer first; what overlaps one that is taken is not, but for the whole run
    taken = "aggregate(c, cast(array() as array<struct<p:double,n:int,k:int,s:int,e:int,whole:boolean>>), (a, v) -> if(not v.whole and exists(a, y -> y.s < v.e and y.e > v.s), a, array_append(a, v)))"
    frame = frame.withColumns({"__numbers": F.expr(f"transform(flatten(transform(__numbers, c -> if(size(c) < 2, c, {taken}))), v -> named_struct('k', v.k, 's', v.s, 'e', v.e))")})
    for kind, name, pattern in (("email", "__spelled", SPELLED), ("secret", "__secrets", SECRETS)):
        frame = _matches(frame, name, pattern)
        fields = ", ".join(f"'{feature}', {sql}" for feature, sql in _features(kind).items())
        right = f"element_at(transform(array({_bound(f'named_struct({fields})', 'q')}), g -> {judged(kind, 'g')}), 1)"
        frame = frame.withColumns({name: F.expr(beside(f"transform(filter({name}, q -> not {known} and {right}), q -> {_span(kind, 'q.s', 'q.s + length(q.x)')})"))})
    return frame.withColumns({"__spans": F.expr("array_sort(concat(__base, __numbers, __spelled))")}).drop("__numbers", "__spelled", "__text")


def _bound(sql: str, row: str) -> str:
    """Feature SQL with x, l and r read from a struct."""
    import re

    out, quoted = [], False
    for part in re.split(r"(r?'(?:[^'\\]|\\.)*')", sql):
        out.append(part if part.startswith(("'", "r'")) else re.sub(r"(?<![\w.])(x|l|r)(?![\w(])", rf"{row}.\1", part))
    return "".join(out)


def _listed(column: str) -> str:
    names = "element_at(array(" + ", ".join(f"'{k}'" for k in MARKS) + "), v.k + 1)"
    return f"array_join(transform({column}, v -> concat({names}, ':', v.s, ':', v.e)), ',')"


def find(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the number of base spans of each kind, the digest of base spans, all spans of these kinds, the
    spans of secrets, and the number of all."""
    found = spans(docs.select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(__base, v -> v.k = {k})) as bigint)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    digest, listed = F.expr(f"sha2(cast({_listed('__base')} as binary), 256)"), F.expr(_listed("__spans"))
    return found.select(
        "doc_id", *counts, digest.alias("base_sha256"), listed.alias("spans"), F.expr(_listed("__secrets")).alias("secrets"),
        F.expr("cast(size(__spans) + size(__secrets) as bigint)").alias("n_spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with [KIND] in place of each span of the text; columns stay as they are, null texts stay null."""
    names = docs.columns
    # the row goes along as one column, so no name of it meets one of the columns that are added
    whole = docs.select(F.col("text"), F.struct(*(F.col(f"`{name}`") for name in names)).alias("row"))
    found = spans(whole).withColumns(
        {
            # one after another by start; of overlapping spans, what reaches further goes on as a span of its own
            "__cuts": F.expr(
                f"aggregate(array_sort(transform(concat(__spans, __secrets), v -> named_struct('s', v.s, 'e', v.e, 'k', v.k))), named_struct('o', cast(array() as array<struct<s:int,e:int,k:int>>), 'e', 0), "
                "(a, v) -> if(v.e <= a.e, a, named_struct('o', array_append(a.o, named_struct('s', greatest(v.s, a.e), 'e', v.e, 'k', v.k)), 'e', v.e))).o"
            )
        }
    )
    marks = "element_at(array(" + ", ".join(f"'[{k.upper()}]'" for k in MARKS) + "), v.k + 1)"
    pieces = f"transform(__cuts, (v, i) -> concat(substring(text, if(i = 0, 0, __cuts[i - 1].e) + 1, v.s - if(i = 0, 0, __cuts[i - 1].e)), {marks}))"
    text = F.expr(f"if(size(__cuts) = 0, text, concat(array_join({pieces}, ''), substring(text, element_at(__cuts, -1).e + 1)))")
    return found.select(*(text.alias(name) if name == "text" else F.col(f"row.`{name}`").alias(name) for name in names))


def op1_pii(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
