"""Registered queries of code elements and perturbations, and the SQL that must give the same rows.

They run on all of ``pages.html`` and ``documents.text`` and on the inline samples below, which hold
the edge cases and which the SQL repeats as VALUES.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import elements, fill, perturb, registry
from .catalog import _LM, LCS, model, query, samples, table

CODE = [
    (1, '"""Top doc."""\nimport os\n\n# a note\nclass Foo(Base):\n    def run(self, x):\n        y = x + 1  # inline\n        return "text"\n'),
    (2, "def outer(\n    a,\n    b=2,\n):\n    z: int = a\n    w = q = 3\n    s = 'one' + \"two\"\n    return z\n"),
    (3, "class A:\n    pass\nclass B(A):\n    '''inner\n    lines'''\n    k = ''\n#\nn = n = 4\n"),
    (4, ""),
    (5, "def (\nclass\n"),
    (6, "x = 1\nif x == 2:\n    print('deux', \"zwei\")\n"),
    (7, "class K:\n    def Run(self, VALUE):\n        return VALUE\n\n    def if_(self):\n        pass\n"),
    (8, "X = 1\nY = 2\r\nZ = X\n"),
]
_CODE_SQL = "code(code_id, code) AS (VALUES " + ", ".join("({}, '{}')".format(i, c.replace("'", "''")) for i, c in CODE) + ")"
_PAGES = f"{_CODE_SQL}, src AS (SELECT 's' || code_id AS blob_id, code AS text FROM code UNION ALL SELECT 'p' || page_id, html FROM pages)"
_SOURCES = f"{_PAGES[:-1]} UNION ALL SELECT 'd' || doc_id, text FROM documents)"
_ID = "[a-zA-Z_][a-zA-Z0-9_]*"
_SP = r"[\t-\r \x{85}\p{Z}]"  # white space of Java's Unicode classes
_RE2 = {
    "docstrings": "\"\"\"[\\s\\S]*?\"\"\"|''''''[\\s\\S]*?''''''", "comments": f"{_SP}*#.*", "function_names": f"def{_SP}+{_ID}{_SP}*\\([\\s\\S]*?\\)", "class_names": f"class{_SP}+{_ID}{_SP}*(?:\\([\\s\\S]*?\\))?",
    "variable_names": f"{_ID}(?:{_SP}*:{_SP}*[^=]*?)?{_SP}*=", "strings": "\".+?\"|''.+?''",
}


def code(s) -> DataFrame:
    return s.createDataFrame(CODE, "code_id bigint, text string").withColumn("blob_id", F.col("code_id").cast("string"))


def page_code(s, d) -> DataFrame:
    """blob_id, text of the inline samples and of all pages."""
    pages = table(s, d, "pages").select(F.concat(F.lit("p"), "page_id").alias("blob_id"), F.col("html").alias("text"))
    return code(s).select(F.concat(F.lit("s"), "blob_id").alias("blob_id"), "text").unionByName(pages)


def all_code(s, d) -> DataFrame:
    """page_code and all documents."""
    return page_code(s, d).unionByName(table(s, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("blob_id"), "text"))


# --- elements


def _found(level: str, source: str = "src") -> str:
    """SQL: blob_id, level, ord, value, start, end, quote_char of the elements of a level; matches are wrapped in
    two control characters, and places are the lengths of what precedes them."""
    if level in ("docstrings", "strings"):
        q = 3 if level == "docstrings" else 1
        value, skip, quote = f"substr(m, {q + 1}, length(m) - {2 * q})", str(q), f"substr(m, 1, {q})"
    elif level == "comments":
        value, quote = f"regexp_extract(m, '^{_SP}*#(.*)', 1)", "NULL"
        skip = f"length(m) - length({value})"
    elif level == "variable_names":
        value, skip, quote = f"regexp_extract(m, '^{_ID}')", "0", "NULL"
    else:
        word = "def" if level == "function_names" else "class"
        value, skip, quote = f"regexp_extract(m, '^{word}{_SP}+({_ID})', 1)", f"length(regexp_extract(m, '^{word}{_SP}+'))", "NULL"
    marked = f"string_split(regexp_replace(text, '{_RE2[level]}', chr(1) || '\\0' || chr(2), 'g'), chr(1))"
    pieces = f"SELECT blob_id, p, unnest(generate_series(1, len(p) - 1)) AS i FROM (SELECT blob_id, {marked} AS p FROM {source})"
    places = f"SELECT blob_id, i, CAST(list_sum([length(x) for x in p[1:i]]) AS BIGINT) - i + 1 AS here, string_split(p[i + 1], chr(2))[1] AS m FROM ({pieces})"
    return f"""SELECT blob_id, '{level}' AS level, CAST(ord AS INTEGER) AS ord, value, CAST(start AS INTEGER) AS start, CAST(start + length(value) AS INTEGER) AS "end", quote_char
FROM (SELECT blob_id, i - 1 AS ord, {value} AS value, here + {skip} AS start, CAST({quote} AS VARCHAR) AS quote_char FROM ({places}))"""


def _extract(level: str, rows_of):
    def run(s, d):
        rows = rows_of(s, d)
        found = rows.select("blob_id", "text", F.posexplode(elements.elements_of(level, F.col("text"))).alias("ord", "e"))
        same = F.substring(F.col("text"), F.col("e.start") + 1, F.col("e.end") - F.col("e.start")) == F.col("e.value")
        return found.select("blob_id", "ord", "e.*", same.alias("exact"))

    return run


for _name, _level in (("ext_comments", "comments"), ("ext_functions", "function_names"), ("ext_classes", "class_names"), ("ext_variables", "variable_names"), ("ext_docstrings", "docstrings"), ("ext_strings", "strings")):
    query(_name, f"WITH {_SOURCES} SELECT * EXCLUDE (level), TRUE AS exact FROM ({_found(_level)})")(_extract(_level, all_code))
for _name, _level in (("ext_variables_pages", "variable_names"), ("ext_strings_pages", "strings")):
    query(_name, f"WITH {_PAGES} SELECT * EXCLUDE (level), TRUE AS exact FROM ({_found(_level)})")(_extract(_level, page_code))


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^{_SP}+|{_SP}+$', '', 'g')"


_ELEMENTS = "el AS (" + " UNION ALL ".join(_found(x) for x in elements.LEVELS) + ")"
_CHOSEN = f"""{_ELEMENTS}, ca AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY blob_id, level ORDER BY md5('42|cap|' || blob_id || '|' || level || '|' || ord), ord) AS r FROM el) WHERE r <= 20),
ch AS (SELECT ca.*, src.text, greatest(0, start - 3000) AS low FROM ca JOIN src USING (blob_id) WHERE length({_strip("value")}) >= 2),
pr AS (SELECT *, CASE WHEN low = 0 THEN '<file_sep>' ELSE '' END || '<fim_prefix>' || prefix || '<fim_suffix>' || suffix || '<fim_middle>' AS prompt FROM (SELECT *, substr(text, low + 1, start - low) AS prefix, substr(text, "end" + 1, 3000) AS suffix FROM ch))"""
query("cap_elements", f"WITH {_SOURCES}, {_CHOSEN} SELECT blob_id, ord, value FROM ca WHERE level = 'variable_names'")(lambda s, d: elements.cap(all_code(s, d), "variable_names").select("blob_id", "ord", "value"))
query("pred_short_element", f"WITH {_SOURCES}, {_ELEMENTS} SELECT blob_id, level, ord FROM el WHERE length({_strip('value')}) >= 2")(lambda s, d: elements.extract(all_code(s, d)).filter(elements.long_enough()).select("blob_id", "level", "ord"))
query("fim_prompt", f"WITH {_SOURCES}, {_CHOSEN} SELECT blob_id, level, ord, prompt FROM pr")(lambda s, d: elements.infills(all_code(s, d)).select("blob_id", "level", "ord", "prompt"))


@query("win_char_context", "WITH hit AS (SELECT doc_id, text, strpos(text, 'the') - 1 AS a FROM documents WHERE strpos(text, 'the') > 0), cx AS (SELECT doc_id, a, substr(text, greatest(0, a - 3000) + 1, a - greatest(0, a - 3000)) AS prefix, substr(text, a + 4, 3000) AS suffix FROM hit) SELECT CAST(doc_id AS VARCHAR) AS blob_id, prefix, suffix, CASE WHEN a <= 3000 THEN '<file_sep>' ELSE '' END || '<fim_prefix>' || prefix || '<fim_suffix>' || suffix || '<fim_middle>' AS prompt FROM cx")
def _context(s, d):
    at = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("blob_id"), "text", (F.locate("the", "text") - 1).alias("start")).filter("start >= 0").withColumn("end", F.col("start") + 3)
    return elements.prompts(at).select("blob_id", "prefix", "suffix", "prompt")


_OUTPUTS_SQL = "o AS (SELECT doc_id, ['class_names', 'function_names', 'variable_names', 'comments', 'strings', 'docstrings'][doc_id % 6 + 1] AS level, CASE WHEN doc_id % 6 > 3 THEN CASE WHEN doc_id % 5 < 3 THEN chr(34) ELSE chr(39) END END AS quote_char, CASE WHEN doc_id % 7 > 0 THEN 'p<fim_middle>' ELSE '' END || CASE doc_id % 4 WHEN 0 THEN replace(text, ' ', ' (') WHEN 1 THEN replace(text, 'e', chr(34)) WHEN 2 THEN replace(text, 'n', '=') ELSE text || '<file_sep>x' END AS o FROM documents)"


def outputs(s, d) -> DataFrame:
    """doc_id, level, quote_char, o: documents as the outputs of infills of all levels, with stop strings put in."""
    i, text = F.col("doc_id"), F.col("text")
    levels = F.array(*[F.lit(x) for x in ("class_names", "function_names", "variable_names", "comments", "strings", "docstrings")])
    put = lambda a, b: F.replace(text, F.lit(a), F.lit(b))
    body = F.when(i % 4 == 0, put(" ", " (")).when(i % 4 == 1, put("e", '"')).when(i % 4 == 2, put("n", "=")).otherwise(F.concat(text, F.lit("<file_sep>x")))
    quote = F.when(i % 6 > 3, F.when(i % 5 < 3, '"').otherwise("'"))
    return table(s, d, "documents").select("doc_id", F.get(levels, (i % 6).cast("int")).alias("level"), quote.alias("quote_char"), F.concat(F.when(i % 7 > 0, "p<fim_middle>").otherwise(""), body).alias("o"))


_ENDS_SQL = "CASE level WHEN 'class_names' THEN [':', '('] WHEN 'function_names' THEN ['('] WHEN 'variable_names' THEN ['='] WHEN 'comments' THEN [chr(10)] ELSE [quote_char] END"
_CUT_SQL = _strip("substr(body, 1, coalesce(list_min([strpos(body, e) for e in ends if strpos(body, e) > 0]) - 1, length(body)))")
query("infill_truncate", f"WITH {_OUTPUTS_SQL}, b AS (SELECT doc_id, CASE WHEN strpos(o, '<fim_middle>') > 0 THEN substr(o, strpos(o, '<fim_middle>') + 12) ELSE o END AS body, list_concat({_ENDS_SQL}, ['<|endoftext|>', '<file_sep>']) AS ends FROM o) SELECT doc_id, {_CUT_SQL} AS cut FROM b")(
    lambda s, d: outputs(s, d).select("doc_id", elements.cut_infill(F.col("o"), elements.stops()).alias("cut"))
)
query("stop_strings", f"WITH {_OUTPUTS_SQL} SELECT doc_id, level, array_to_string({_ENDS_SQL}, '|') AS stops FROM o")(lambda s, d: outputs(s, d).select("doc_id", "level", F.array_join(elements.stops(), "|").alias("stops")))
query("too_long_guard", r"SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^ \t-\r]+')), 0) + 50 > 16000 AS too_long FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", elements.too_long(F.col("text")).alias("too_long"))
)
# a text against itself: in capitals, without its last letters, moved on, too long to ask for, or not generated at all
_HIT_SQL = "h AS (SELECT doc_id, level, substr(text, 1, 30) AS value, CASE doc_id % 5 WHEN 0 THEN ' ' || upper(substr(text, 1, 30)) WHEN 1 THEN substr(text, 1, 26) WHEN 2 THEN substr(text, 7, 30) WHEN 3 THEN 'too_many_tokens' END AS found FROM o JOIN documents USING (doc_id))"
_NAMES = "('class_names', 'function_names', 'variable_names')"


def _infilled(s, d, exact: bool) -> DataFrame:
    i, text = F.col("doc_id"), F.col("text")
    found = F.when(i % 5 == 0, F.concat(F.lit(" "), F.upper(F.substring(text, 1, 30)))).when(i % 5 == 1, F.substring(text, 1, 26)).when(i % 5 == 2, F.substring(text, 7, 30)).when(i % 5 == 3, elements.TOO_LONG)
    rows = outputs(s, d).select("doc_id", "level").join(table(s, d, "documents"), "doc_id").select("doc_id", "level", F.substring(text, 1, 30).alias("value"), found.alias("found"))
    return rows.filter(F.col("level").isin(*elements.EXACT) == exact).select("doc_id", "level", elements.hit(F.col("level"), F.col("value"), F.col("found")).alias("hit"))


query("hit_exact", f"WITH {_OUTPUTS_SQL}, {_HIT_SQL} SELECT doc_id, level, CASE WHEN found IS NULL OR found = 'too_many_tokens' THEN 0 ELSE (upper({_strip('value')}) = upper({_strip('found')}))::INT END AS hit FROM h WHERE level IN {_NAMES}")(lambda s, d: _infilled(s, d, True))
query("hit_fuzzy", f"WITH {_OUTPUTS_SQL}, {_HIT_SQL}, x AS (SELECT doc_id, level, found, {_strip('value')} AS a, {_strip('found')} AS b FROM h WHERE level NOT IN {_NAMES}) SELECT doc_id, level, CASE WHEN found IS NULL OR found = 'too_many_tokens' THEN 0 WHEN a = '' AND b = '' THEN 1 WHEN a = '' OR b = '' THEN 0 ELSE (round(200.0::DOUBLE * {LCS.format('a', 'b')} / (length(a) + length(b))) >= 80)::INT END AS hit FROM x")(lambda s, d: _infilled(s, d, False))
query("agg_hit_ratio", "SELECT CAST(user_id AS VARCHAR) AS blob_id, coalesce(avg(CASE WHEN event_id % 2 = 0 THEN (event_id % 3 = 0)::INT END), 0.0) AS strings_hits, count(CASE WHEN event_id % 2 = 0 THEN 1 END)::DOUBLE AS strings_total, coalesce(avg(CASE WHEN event_id % 2 = 1 THEN (event_id % 3 = 0)::INT END), 0.0) AS comments_hits, count(CASE WHEN event_id % 2 = 1 THEN 1 END)::DOUBLE AS comments_total FROM events GROUP BY user_id")(
    lambda s, d: (lambda e: elements.features(e.select("blob_id").distinct(), e).select("blob_id", "strings_hits", "strings_total", "comments_hits", "comments_total"))(
        table(s, d, "events").select(F.col("user_id").cast("string").alias("blob_id"), F.when(F.col("event_id") % 2 == 0, "strings").otherwise("comments").alias("level"), (F.col("event_id") % 3 == 0).cast("int").alias("hit"))
    )
)
def _lattice_sql() -> str:
    """SQL: fb (a, b, output), the best paths between the distinct ends of gp (a, b)."""
    parts = [
        f"co AS (SELECT prev, token, CAST(round(-{fill.COST} * ln((c2 + 0.1::DOUBLE) / (c1 + 0.1::DOUBLE * v))) AS BIGINT) AS cost FROM c2 JOIN c1 USING (prev), v)",
        "f0 AS (SELECT DISTINCT a, a AS token, 0::BIGINT AS cost, CAST([] AS VARCHAR[]) AS path FROM gp WHERE a IS NOT NULL AND b IS NOT NULL)",
    ]
    for n in range(1, fill.LENGTH + 1):
        grown = f"SELECT f.a, co.token, min({{'cost': f.cost + co.cost, 'path': list_append(f.path, co.token)}}) AS x FROM f{n - 1} f JOIN co ON co.prev = f.token GROUP BY ALL"
        parts.append(f"f{n} AS (SELECT a, token, x.cost AS cost, x.path AS path FROM ({grown}))")
    closed = " UNION ALL ".join(f"SELECT a, b, {{'mean': min(x).total / {n + 1}::DOUBLE, 'n': {n}, 'path': min(x).path}} AS y FROM (SELECT e.a, e.b, {{'total': f.cost + co.cost, 'path': f.path}} AS x FROM (SELECT DISTINCT a, b FROM gp) e JOIN f{n} f ON f.a = e.a JOIN co ON co.prev = f.token AND co.token = e.b) GROUP BY ALL" for n in range(1, fill.LENGTH + 1))
    return ", ".join([*parts, f"fb AS (SELECT a, b, array_to_string(min(y).path, ' ') AS output FROM ({closed}) GROUP BY ALL)"])


_NUCLEUS = f"""nw AS (SELECT prev, token, CAST(floor({fill.WEIGHT}::DOUBLE * pow(c2::DOUBLE / max(c2) OVER (PARTITION BY prev), {1 / fill.TEMPERATURE}::DOUBLE)) AS BIGINT) AS w FROM c2),
nh AS (SELECT *, sum(w) OVER (PARTITION BY prev ORDER BY w DESC, token ROWS UNBOUNDED PRECEDING) AS hi, sum(w) OVER (PARTITION BY prev) AS total FROM nw WHERE w > 0),
nk AS (SELECT prev, token, hi - w AS lo, hi, max(hi) OVER (PARTITION BY prev) AS mass FROM nh WHERE hi - w < {fill.TOP_P}::DOUBLE * total)"""
_INFILLED = f"""{_LM}, src AS (SELECT blob_id, text FROM samples), {_CHOSEN},
gp AS (SELECT *, regexp_extract_all(prefix, '[^ \\t-\\r]+')[-1] AS a, regexp_extract_all(suffix, '[^ \\t-\\r]+')[1] AS b FROM pr), {_lattice_sql()}, {_NUCLEUS},
gx AS (SELECT gp.*, fb.output AS filled FROM gp LEFT JOIN fb USING (a, b)),
wk(blob_id, level, ord, step, here, out) AS (SELECT blob_id, level, ord, 0, a, '' FROM gx WHERE filled IS NULL UNION ALL
  SELECT * FROM (SELECT w.blob_id, w.level, w.ord, w.step + 1, nk.token, w.out || CASE WHEN w.step > 0 THEN ' ' ELSE '' END || nk.token FROM
    (SELECT *, CAST('0x' || substr(md5('42|infill|' || blob_id || '|' || level || '|' || ord || '|' || step), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u FROM wk WHERE step < {elements.NEW_TOKENS}) w
    JOIN nk ON nk.prev = w.here AND nk.lo <= floor(w.u * nk.mass) AND floor(w.u * nk.mass) < nk.hi)),
sm AS (SELECT blob_id, level, ord, arg_max(out, step) AS drawn FROM wk GROUP BY ALL),
op AS (SELECT gx.*, prompt || coalesce(filled, drawn, '') AS o, coalesce(len(regexp_extract_all(prompt, '[^ \\t-\\r]+')), 0) + 50 > 16000 AS long FROM gx LEFT JOIN sm USING (blob_id, level, ord))"""
_TRAWIC = f"""{_INFILLED},
bd AS (SELECT *, substr(o, strpos(o, '<fim_middle>') + 12) AS body, list_concat(CASE level WHEN 'class_names' THEN [':', '('] WHEN 'function_names' THEN ['('] WHEN 'variable_names' THEN ['='] WHEN 'comments' THEN [chr(10)] ELSE [quote_char] END, ['<|endoftext|>', '<file_sep>']) AS ends FROM op),
ct AS (SELECT *, {_strip("substr(body, 1, coalesce(list_min([strpos(body, e) for e in ends if strpos(body, e) > 0]) - 1, length(body)))")} AS cut, {_strip("value")} AS want FROM bd),
hi AS (SELECT blob_id, level, CASE WHEN long THEN 0 WHEN level IN ('class_names', 'function_names', 'variable_names') THEN (upper(want) = upper(cut))::INT
  WHEN want = '' AND cut = '' THEN 1 WHEN round(200.0::DOUBLE * least(length(want), length(cut)) / (length(want) + length(cut))) < 80 THEN 0
  ELSE (round(200.0::DOUBLE * {LCS.format("want", "cut")} / (length(want) + length(cut))) >= 80)::INT END AS hit FROM ct)"""
query("trawic_features", f"WITH RECURSIVE {_TRAWIC} SELECT blob_id, " + ", ".join(f"coalesce(avg(hit) FILTER (level = '{x}'), 0.0::DOUBLE) AS {x}_hits, count(hit) FILTER (level = '{x}')::DOUBLE AS {x}_total" for x in elements.FEATURE_ORDER) + " FROM samples LEFT JOIN hi USING (blob_id) GROUP BY blob_id")(
    lambda s, d: elements.features(samples(s, d), elements.infill_hits(model(s, d), samples(s, d).select("blob_id", "text")))
)
query("infill_generate", f"WITH RECURSIVE {_INFILLED} SELECT blob_id, level, ord, substr(o, length(prompt) + 1) AS output FROM op")(lambda s, d: model(s, d).infill(elements.infills(samples(s, d).select("blob_id", "text")), elements.NEW_TOKENS).select("blob_id", "level", "ord", "output"))
query("attack_trawic")(lambda s, d: registry.run_attack("trawic", samples(s, d), model=model(s, d)))

# --- perturbations


def _draw(purpose: str, n: str | int) -> str:
    return f"(CAST('0x' || substr(md5('42|{purpose}|' || blob_id), 1, 8) AS BIGINT) % greatest({n}, 1))"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _one_of(options, purpose: str) -> str:
    return "[" + ", ".join(map(_quoted, options)) + f"][{_draw(purpose, len(options))} + 1]"


def _constant_sql(purpose: str) -> str:
    pairs = " || ".join(f"substr({_quoted(perturb.CHARACTERS)}, CAST(CAST('0x' || substr(md5('42|{purpose}-word|' || blob_id), {2 * i + 1}, 2) AS BIGINT) % {len(perturb.CHARACTERS)} + 1 AS INTEGER), 1)" for i in range(perturb.CONSTANT_LENGTH))
    return f"CASE WHEN {_draw(purpose + '-kind', 2)} = 1 THEN chr(39) || {pairs} || chr(39) ELSE CAST({_draw(purpose, perturb.NUMBERS)} AS VARCHAR) END"


def _number_sql(purpose: str) -> str:
    return f"CAST(1000 + {_draw(purpose, 9000)} AS VARCHAR)"


def _insert_sql(at: str, *new: str) -> str:
    return f"array_to_string(list_concat(list_concat(l[1:{at}], [{', '.join(new)}]), l[{at} + 1:]), chr(10))"


def _range_sql(purpose: str) -> str:
    x, y = _draw(purpose + "x", perturb.NUMBERS), _draw(purpose + "y", perturb.NUMBERS)
    return f"'for _ in range(' || greatest({x}, {y}) || ', ' || least({x}, {y}) || '):'"


_WORDS_OF = "regexp_extract_all({}, '[\\p{{L}}\\p{{N}}_]+')"
_KEPT = ", ".join(map(_quoted, perturb.RESERVED))
_BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
_PERTURBED = f"""{_PAGES}, sl AS (SELECT blob_id, text, string_split_regex(text, '{_BREAKS}') AS l0 FROM src),
cl AS (SELECT blob_id, text, CASE WHEN l0[-1] = '' THEN l0[1:len(l0) - 1] ELSE l0 END AS l,
  list_sort(list_distinct([x for x in {_WORDS_OF.format("text")} if regexp_matches(x, '^[_a-z][_a-zA-Z0-9]*$') AND x NOT IN ({_KEPT})])) AS vars,
  [regexp_extract(x, '[_a-zA-Z][_a-zA-Z0-9]*$') for x in regexp_extract_all(text, '(?m)^{_SP}*def{_SP}+[_a-zA-Z][_a-zA-Z0-9]*') if regexp_extract(x, '[_a-zA-Z][_a-zA-Z0-9]*$') NOT IN ({_KEPT}) AND NOT regexp_matches(x, '\\n[A-Z][_a-zA-Z0-9]*$')] AS meth FROM sl),
ln AS (SELECT *, len(l) AS n, vars[{_draw("p3", "len(vars)")} + 1] AS v3, vars[{_draw("p5", "len(vars)")} + 1] AS v5, coalesce(vars[{_draw("p8", "len(vars)")} + 1], {_quoted(perturb.VARIABLE)}) AS v8, meth[{_draw("p6", "len(meth)")} + 1] AS m6, coalesce(meth[{_draw("p7", "len(meth)")} + 1], {_quoted(perturb.METHOD)}) AS m7,
  [{_strip("x")} for x in l if {_strip("x")} <> '' AND NOT ends_with({_strip("x")}, ':')] AS usable FROM cl)"""


def _line_of(name: str) -> str:
    return f"list_position([list_contains({_WORDS_OF.format('x')}, {name}) for x in l], TRUE)"


def _renamed(name: str, new: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN text ELSE array_to_string([CASE WHEN x = {name} THEN {new} ELSE x END for x in regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+')], '') END"


def _printed(name: str, message: str) -> str:
    at = f"coalesce({_line_of(name)}, 0)"
    indent = f"CASE WHEN {at} = 0 THEN '' ELSE regexp_extract(l[{at}], '^{_SP}*') END"
    return _insert_sql(f"least(greatest({at}, 1), n)", f"{indent} || {message}")


_VALUE3 = f"coalesce(v3, {_constant_sql('p3k')})"
_NEW3 = f"'unused_' || {_number_sql('p3n')} || ' = ' || {_VALUE3}"
_ENTER, _SHOW = [_quoted(x) for x in perturb.ENTERING], [_quoted(x) for x in perturb.SHOWING]
_PERTURB_SQL = {
    "false_if_fixed": _insert_sql(_draw("p1", "n + 1"), _one_of(perturb.CONDITIONS, "p1c"), _one_of(perturb.BODIES, "p1b")),
    "false_if_random": _insert_sql(_draw("p2", "n + 1"), _one_of(perturb.CONDITIONS, "p2c"), f"'    ' || coalesce(usable[{_draw('p2b', 'len(usable)')} + 1], 'pass')"),
    "unused_var_existing": f"CASE WHEN {_line_of(_VALUE3)} > 0 THEN {_insert_sql(f'({_line_of(_VALUE3)} - 1)', _NEW3)} ELSE array_to_string(list_concat(list_concat(l, [{_NEW3}]), l), chr(10)) END",
    "unused_var_random": _insert_sql(_draw("p4", "n + 1"), f"'unused_' || {_number_sql('p4n')} || ' = ' || {_constant_sql('p4k')}"),
    "rename_var": _renamed("v5", f"'var_' || {_number_sql('p5n')}"),
    "rename_method": _renamed("m6", f"'method_' || {_number_sql('p6n')}"),
    "print_enter": _printed("m7", f"{_ENTER[0]} || m7 || {_ENTER[1]}"),
    "print_variable": f"CASE WHEN n = 0 THEN text ELSE {_printed('v8', f'{_SHOW[0]} || v8 || {_SHOW[1]} || v8 || {_SHOW[2]}')} END",
    "false_loop_for": _insert_sql(_draw("p9", "n + 1"), _range_sql("p9"), _one_of(perturb.LOOP_BODIES, "p9b")),
    "false_loop_while": _insert_sql(_draw("p10", "n + 1"), _one_of(perturb.LOOPS, "p10c"), _one_of(perturb.LOOP_BODIES, "p10b")),
    "unused_var_loop": _insert_sql(_draw("p11", "n + 1"), _range_sql("p11"), f"'unused_' || {_number_sql('p11n')} || ' = ' || {_constant_sql('p11k')}"),
}
for _k, _f in perturb.VARIANTS.items():
    query(_k, f"WITH {_PERTURBED} SELECT blob_id, {_PERTURB_SQL[_k]} AS code FROM ln")(lambda s, d, f=_f: page_code(s, d).select("blob_id", f(F.col("text")).alias("code")))
query("regex_findall", f"WITH {_PERTURBED} SELECT blob_id, array_to_string(vars, ' ') AS variables, array_to_string(meth, ' ') AS methods FROM ln")(
    lambda s, d: page_code(s, d).select("blob_id", F.array_join(perturb.variables(F.col("text")), " ").alias("variables"), F.array_join(perturb.methods(F.col("text")), " ").alias("methods"))
)
query("regex_sub_word", f"WITH d AS (SELECT doc_id, text, 'the' AS w FROM documents) SELECT doc_id, sha1({_renamed('w', _quoted('var_1'))}) AS h FROM d")(lambda s, d: table(s, d, "documents").select("doc_id", F.sha1(tx.rename_word("text", F.lit("the"), F.lit("var_1"))).alias("h")))
