"""Personal data by weak supervision (DataFrame and SQL functions only).

Candidates come from patterns: the four base kinds, and further kinds that are only sometimes
personal. Four labelers vote on each candidate (for, against or nothing): its format, a gazetteer,
the words before it, and its borders. Expectation-maximisation over the counts of vote patterns
estimates how often each labeler is right; with the resulting soft labels a naive Bayes classifier
over features of the span (kind, length, context, borders) is trained. Both need only the counts of
the cells of votes and features, a table that its alphabet bounds, collected by one job. Base spans
always stay; the classifier decides which further candidates, apart from base spans, are added.

Patterns are those of the contract in forms that need no backtracking into runs (possessive, with a
guard against starting inside a run), so long runs take linear time. Matches are found by marking:
each is wrapped in control characters (those of the text are replaced first, by one that no pattern
contains), and positions are running lengths of the pieces, in code points.

Defined cases: null and empty texts have no spans; null ids stay null; repeated rows are judged
alike; an empty table gives an empty result; without candidates nothing is trained; other columns
pass through ``redact`` and are otherwise ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "localphone", "ssn", "hiddenmail")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?i)\b(?:token|secret|password|passwd|pwd|api_?key)\s*+[=:]\s*+\x22?[A-Z0-9_./+-]{16,}+",
    "localphone": r"(?<![0-9+().-])(?<!\+[0-9]\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "hiddenmail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,64}+(?:\x20?[\[(](?:dot|DOT)[\])]\x20?[A-Za-z0-9-]{1,64}+|\.[A-Za-z0-9-]{1,64}+)++",
}
#: What a text must contain before its pattern is tried.
NEEDS = {"email": "@", "phone": "+"}
CONTEXT_FOR = r"(?i)(e-?mail|contact|write|phone|call|tel|fax|mobile|card|visa|credit|address|host|login|ssn|social|token|secret|password)"
CONTEXT_AGAINST = r"(?i)(version|release|section|chapter|page|isbn|order|invoice|sample|example:)"
GAZETTEER = {
    "email": (r"(?i)\.(com|org|net|edu|gov|info|de|fr|es|it|uk|eu|io|us|ca)$", r"(?i)(^|[@.])(localhost|invalid|test)$"),
    "ip": (r"^(?!0|127\.|255\.)", r"^(0\.|127\.|255\.255)"),
    "card": (r"^(4|5[1-5]|34|37|6011|65|35|2[2-7])", r"^0"),
    "phone": (r"^\+(1|7|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])", r"^\+0"),
    "secret": (r"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]", r"(?i)(example|placeholder|xxxx|0000)"),
    "localphone": (r"^\(?[2-9]", r"^\(?[01]"),
    "ssn": (r"^(?!000|666|9)", r"^(000|666|9)"),
    "hiddenmail": (r"(?i)(com|org|net|edu)$", r"(?i)(invalid|test)$"),
}
ROUNDS = 12
#: Chances of each vote for what is personal data (1) and what is not (0), before the first round.
_START = {1: {"+": 0.6, "-": 0.1, "0": 0.3}, 0: {"+": 0.2, "-": 0.4, "0": 0.4}}
_ROW = "struct<s:int,e:int,m:string,l:string,r:string>"
_CANDIDATE = "struct<k:int,s:int,e:int,cell:string>"
#: Rows that a fold gathers at a time, and code points of the pieces that texts are cut from.
CHUNK, PIECE = 128, 1024


def _valid(kind: str):
    """Whether a base match (x.m) passes its check, as SQL."""
    digits = "regexp_replace(x.m, '[^0-9]', '')"
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return rf"x.m rlike r'^{part}(?:\.{part}){{3}}$'"
    if kind == "card":
        d = f"cast(substring({digits}, length({digits}) - i, 1) as int)"
        luhn = f"aggregate(sequence(0, length({digits}) - 1), 0, (t, i) -> t + if(i % 2 = 0, {d}, if({d} > 4, 2 * {d} - 9, 2 * {d}))) % 10 = 0"
        return f"length({digits}) between 12 and 19 and if(length({digits}) between 12 and 19, {luhn}, false)"
    if kind == "phone":
        return f"length({digits}) between 9 and 15"
    return "true"


def _bind(value: str, name: str, body: str) -> str:
    """SQL: body, in which name stands for value, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _scan(items: str, zero: str, state: str, step: str, row: str, finish: str = "flatten(b.out)") -> str:
    """SQL: a running fold of items; step maps (a.st, x) to a struct of the next st and the rows `out` that x gives.

    Rows are gathered by chunks, so that the cost of appending stays near linear in very long arrays.
    """
    inner = f"struct<st:{state},out:array<{row}>>"
    outer = f"struct<st:{state},out:array<array<{row}>>>"
    one = _bind(step, "n", f"cast(named_struct('st', n.st, 'out', concat(a.out, n.out)) as {inner})")
    chunk = f"aggregate(slice({items}, c, {CHUNK}), cast(named_struct('st', b.st, 'out', array()) as {inner}), (a, x) -> {one})"
    whole = _bind(chunk, "r", f"cast(named_struct('st', r.st, 'out', concat(b.out, array(r.out))) as {outer})")
    at = f"if(size({items}) > 0, sequence(1, greatest(size({items}), 1), {CHUNK}), cast(array() as array<int>))"
    return f"aggregate({at}, cast(named_struct('st', {zero}, 'out', array()) as {outer}), (b, c) -> {whole}, b -> {finish})"


def _matches(kind: str) -> str:
    """SQL: array of the matches of a kind in the column `clean`, with positions and neighbourhood."""
    marked = f"regexp_replace(clean, r'{PATTERNS[kind]}', '\\u0001$0\\u0002')"
    if kind in NEEDS:
        marked = f"if(contains(clean, '{NEEDS[kind]}'), {marked}, '')"
    m = "substring_index(x, '\\u0002', 1)"
    rest = "substring(x, length(m) + 2)"
    row = "named_struct('s', a.st.pos, 'e', a.st.pos + length(m), 'm', m, 'l', substring(a.st.prev, -24, 24), 'r', substring(rest, 1, 1))"
    step = _bind(m, "m", _bind(rest, "rest", f"named_struct('st', named_struct('pos', a.st.pos + length(x) - 1, 'prev', rest), 'out', array({row}))"))
    scan = _scan("later", "named_struct('pos', length(p[0]), 'prev', p[0])", "struct<pos:int,prev:string>", step, _ROW)
    return _bind(f"split({marked}, '\\u0001')", "p", _bind("slice(p, 2, size(p))", "later", scan))


def _apart(base: str, more: str) -> str:
    """SQL: the rows of more that overlap none of base.

    Base by start and the others by end, in one order: a row overlaps if a base span that starts
    before its end reaches beyond its start.
    """
    first = f"transform({base}, x -> named_struct('at', x.s, 'rank', 1, 'row', x))"
    second = f"transform({more}, x -> named_struct('at', x.e, 'rank', 0, 'row', x))"
    step = "named_struct('st', if(x.rank = 1, greatest(a.st, x.row.e), a.st), 'out', if(x.rank = 0 and a.st <= x.row.s, array(x.row), array()))"
    return _bind(f"array_sort(concat({first}, {second}))", "items", _scan("items", "0", "int", step, _CANDIDATE))


def _cell(kind: str, found: str) -> str:
    """SQL: candidates of a kind as (k, s, e, cell); cell holds votes and features, one character each."""
    good, bad = GAZETTEER[kind]
    ok = _valid(kind)
    form = "'+'" if kind in BASE else "'0'"
    words = f"if(x.l rlike r'{CONTEXT_AGAINST}', '-', if(x.l rlike r'{CONTEXT_FOR}', '+', '0'))"
    listed = f"if(x.m rlike r'{bad}', '-', if(x.m rlike r'{good}', '+', '0'))"
    border = r"if(x.l rlike r'[\p{L}\p{N}]$' or x.r rlike r'^[\p{L}\p{N}]', '-', '+')"
    size = "cast(least(9, floor(length(x.m) / 4)) as string)"
    digits = "cast(least(9, floor(10 * length(regexp_replace(x.m, '[^0-9]', '')) / length(x.m))) as string)"
    code = KINDS.index(kind)
    return f"transform(filter({found}, x -> {ok}), x -> named_struct('k', {code}, 's', x.s, 'e', x.e, 'cell', concat('{code}', {form}, {listed}, {words}, {border}, {size}, {digits})))"


def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and `found`: all base spans, and the further candidates that overlap none of them."""
    clean = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "\x01\x02", "\x03\x03")
    rows = docs.select(*keep, clean.alias("clean"))
    base = F.expr("concat(" + ", ".join(_cell(k, _matches(k)) for k in BASE) + ")")
    more = F.expr("concat(" + ", ".join(_cell(k, _matches(k)) for k in KINDS[len(BASE) :]) + ")")
    rows = rows.select(*keep, base.alias("base"), more.alias("more"))
    return rows.select(*keep, F.expr(f"concat(base, {_apart('base', 'more')})").alias("found"))


def _posterior(votes: str, prior: float, p: dict) -> float:
    """P(y = 1), given the votes of the four labelers."""
    odds = math.log(prior / (1 - prior)) + sum(math.log(p[i, v, 1] / p[i, v, 0]) for i, v in enumerate(votes))
    return 1 / (1 + math.exp(-odds))


def reliabilities(patterns: dict[str, int], rounds: int = ROUNDS) -> tuple[float, dict]:
    """Prior of y = 1, and P(vote | y) of each labeler, by EM over the counts of the vote patterns."""
    prior, p = 0.5, {(i, v, y): _START[y][v] for i in range(4) for v in "+-0" for y in (0, 1)}
    n = sum(patterns.values())
    for _ in range(rounds if n else 0):
        soft = {x: k * _posterior(x, prior, p) for x, k in patterns.items()}
        mass = {1: soft, 0: {x: k - soft[x] for x, k in patterns.items()}}
        prior = (sum(soft.values()) + 1) / (n + 2)
        p = {(i, v, y): (sum(m for x, m in mass[y].items() if x[i] == v) + 1) / (sum(mass[y].values()) + 3) for i, v, y in p}
    return prior, p


#: Positions in a cell of the features: kind, context, borders, length, share of digits.
FEATURES = (0, 3, 4, 5, 6)


def classify(cells: dict[str, int]) -> list[str]:
    """The cells that a naive Bayes classifier, trained on the soft labels of EM, takes for personal data."""
    cells = dict(sorted(cells.items()))  # sums are the same for any order of the rows
    patterns: dict[str, int] = {}
    for c, k in cells.items():
        patterns[c[1:5]] = patterns.get(c[1:5], 0) + k
    prior, p = reliabilities(patterns)
    label = {x: _posterior(x, prior, p) for x in patterns}
    n, yes = sum(cells.values()), sum(k * label[c[1:5]] for c, k in cells.items())
    weight: dict[tuple[int, str], float] = {}
    for at in FEATURES:
        held: dict[str, list[float]] = {}
        for c, k in cells.items():
            one = held.setdefault(c[at], [0.0, 0])
            one[0] += k * label[c[1:5]]
            one[1] += k
        for f, (y, k) in held.items():
            weight[at, f] = math.log((y + 1) / (yes + len(held))) - math.log((k - y + 1) / (n - yes + len(held)))
    bias = math.log((yes + 1) / (n - yes + 1))
    return [c for c in cells if bias + sum(weight[at, c[at]] for at in FEATURES) >= 0]


def accepted(found: DataFrame) -> list[str]:
    """The cells whose candidates are taken for personal data. Their number is bounded by the alphabet of
    cells (8 kinds, 3 * 3 * 2 votes, 10 lengths, 10 shares of digits), so one small job counts them."""
    counts = found.select(F.explode("found.cell").alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    return classify({r["cell"]: r["n"] for r in counts.collect()})


def spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and `spans`: (s, k, e) of the spans decided on, by start and then kind."""
    found = materialize(candidates(docs, keep), "pii-found")
    good = [c for c in accepted(found) if int(c[0]) >= len(BASE)]
    taken = F.filter("found", lambda x: (x["k"] < len(BASE)) | x["cell"].isin(good) if good else x["k"] < len(BASE))
    ordered = F.array_sort(F.transform(taken, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    return found.select(*keep, ordered.alias("spans"))


def _written(array):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(array, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))))


def report(docs: DataFrame) -> DataFrame:
    out = spans(docs.select("doc_id", "text"), ["doc_id"])

    def count(code):
        return F.size(F.filter("spans", lambda x: x["k"] == code)).cast("bigint")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(BASE)]
    base = F.filter("spans", lambda x: x["k"] < len(BASE))
    return out.select("doc_id", *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns, each span in the text replaced by its kind in angle brackets."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), "text")  # so that no column clashes with those made here
    out = spans(packed, ["row"]).withColumn("text", F.col("row.text"))
    marks = "array(" + ", ".join(f"'<{k}>'" for k in KINDS) + ")"

    def between(lo: str, hi: str) -> str:
        return f"substring(array_join(slice(pieces, {lo} div {PIECE} + 1, {hi} div {PIECE} - {lo} div {PIECE} + 1), ''), {lo} % {PIECE} + 1, {hi} - {lo})"

    # text between spans; of overlapping spans the first is named and the union goes
    step = f"named_struct('st', greatest(a.st, x.e), 'out', if(x.s < a.st, cast(array() as array<string>), array({between('a.st', 'x.s')}, element_at({marks}, x.k + 1))))"
    tail = f"concat(array_join(flatten(b.out), ''), {between('b.st', 'size')})"
    fold = _bind(f"regexp_extract_all(text, '(?s).{{1,{PIECE}}}', 0)", "pieces", _bind("length(text)", "size", _scan("spans", "0", "int", step, "string", tail)))
    fold = F.expr(fold)
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(fold)
    return out.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
