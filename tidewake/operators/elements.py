"""Code elements by pattern, infill prompts, hits, and the twelve hit features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folds import bind, scan
from ..functions.text import PY, fuzz_at_most, fuzz_ratio, order_key, py_strip, py_upper_eq
from ..sources.scratch import written

# Names, patterns, thresholds and limits that results depend on.
IDENT = "[a-zA-Z_][a-zA-Z0-9_]*"
LEVELS = {
    "docstrings": r"""(\"\"\"|''')([\s\S]*?)\1""",
    "comments": r"\s*#(.*)",
    "function_names": rf"def\s+({IDENT})\s*\(([\s\S]*?)\)",
    "class_names": rf"class\s+({IDENT})\s*(?:\(([\s\S]*?)\))?",
    "variable_names": rf"({IDENT})(?:\s*:\s*[^=]*?)?\s*=",
    "strings": r"""([\"'])(.+?)\1""",
}
#: What a text with an element of a level holds; of any other text the pattern is not asked, whose search is long where an end is missing.
MARKS = {"docstrings": ('"""', "'''"), "comments": ("#",), "function_names": ("def",), "class_names": ("class",), "variable_names": ("=",), "strings": ('"', "'")}
FEATURE_ORDER = ("class_names", "function_names", "variable_names", "strings", "comments", "docstrings")
EXACT = ("class_names", "function_names", "variable_names")
HIT = 80
CAP = 20
CONTEXT = 3000
NEW_TOKENS, MODEL_TOKENS = 50, 16000
TOO_LONG = "too_many_tokens"
STOPS = {"class_names": (":", "("), "function_names": ("(",), "variable_names": ("=",), "comments": ("\n",), "strings": (), "docstrings": ()}


def _inner(level: str, m: Column) -> tuple[Column, Column, Column]:
    """Value of a match, its distance from the match's start, and its quote mark."""
    none = F.lit(None).cast("string")
    if level in ("docstrings", "strings"):
        q = 3 if level == "docstrings" else 1
        return F.substring(m, F.lit(q + 1), F.length(m) - 2 * q), F.lit(q), F.substring(m, 1, q)
    if level == "comments":
        value = F.regexp_extract(m, rf"{PY}^\s*#(.*)", 1)
        return value, F.length(m) - F.length(value), none
    if level == "variable_names":
        return F.regexp_extract(m, f"^({IDENT})", 1), F.lit(0), none
    word = "def" if level == "function_names" else "class"
    head = F.regexp_extract(m, rf"{PY}^({word}\s+)", 1)
    return F.regexp_extract(m, rf"{PY}^{word}\s+({IDENT})", 1), F.length(head), none


_KIND = "struct<value:string,start:int,end:int,quote_char:string>"


def _element(level: str, m: Column, at: Column) -> Column:
    value, skip, quote = _inner(level, m)
    return F.struct(value.alias("value"), (at + skip).cast("int").alias("start"), (at + skip + F.length(value)).cast("int").alias("end"), quote.alias("quote_char"))


def elements_of(level: str, code: Column) -> Column:
    """Array of (value, start, end, quote_char) in order; offsets in code points, half-open.

    Matches are wrapped in two control characters, and offsets are running lengths of the pieces
    between them. Texts that hold these characters have their matches located one after the other.
    """
    pattern, none = PY + LEVELS[level], F.array().cast(f"array<{_KIND}>")

    def wrapped(x: Column) -> Column:
        parts = F.split(F.regexp_replace(x, pattern, "\x01$0\x02"), "\x01")

        def step(at: Column, piece: Column) -> Column:
            m = F.substring_index(piece, "\x02", 1)
            return F.struct((at + F.length(piece) - 1).cast("int").alias("st"), F.array(_element(level, m, at)).alias("out"))

        return bind(parts, lambda p: scan(F.slice(p, F.lit(2), F.size(p)), F.length(F.get(p, F.lit(0))), step, "int", _KIND))

    def located(x: Column) -> Column:
        def step(at: Column, m: Column) -> Column:
            here = F.call_function("locate", m, x, at + 1) - 1
            return F.struct((here + F.length(m)).cast("int").alias("st"), F.array(_element(level, m, here)).alias("out"))

        return scan(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), F.lit(0), step, "int", _KIND)

    may = reduce(Column.__or__, [F.contains(code, F.lit(m)) for m in MARKS[level]])
    return F.coalesce(F.when(~may, none).when(code.rlike("[\x01\x02]"), located(code)).otherwise(wrapped(code)), none)


def extract(df: DataFrame, code: str = "text", keys: tuple = ("blob_id",)) -> DataFrame:
    """Long form: keys, level, ord, value, start, end, quote_char."""
    levels = F.array(*[F.struct(F.lit(x).alias("level"), elements_of(x, F.col(code)).alias("e")) for x in LEVELS])
    rows = df.select(*keys, F.explode(levels).alias("l"))
    return rows.select(*keys, F.col("l.level").alias("level"), F.posexplode("l.e").alias("ord", "e")).select(*keys, "level", "ord", "e.*")


def elements_map(code: str | Column) -> Column:
    """MAP<level, elements> with all six levels, as one column."""
    c = F.col(code) if isinstance(code, str) else code
    return F.create_map(*[x for level in LEVELS for x in (F.lit(level), elements_of(level, c))])


def capped(level: str, found: Column, n: int = CAP, seed: int = 42) -> Column:
    """Array of (ord, e): at most n elements of a level, drawn without replacement within the row of ``blob_id``."""
    keyed = F.transform(found, lambda e, i: F.struct(order_key(seed, "cap", F.col("blob_id"), F.lit(level), i).alias("k"), i.alias("ord"), e.alias("e")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda x: F.struct(x["ord"].alias("ord"), x["e"].alias("e")))


def cap(df: DataFrame, level: str, n: int = CAP, seed: int = 42, code: str = "text") -> DataFrame:
    """blob_id, ord, value, start, end, quote_char of at most n elements of a level of each text."""
    rows = df.select("blob_id", F.explode(capped(level, elements_of(level, F.col(code)), n, seed)).alias("x"))
    return rows.select("blob_id", "x.ord", "x.e.*")


def long_enough(value: str | Column = "value", shortest: int = 2) -> Column:
    return F.coalesce(F.length(py_strip(value)) >= shortest, F.lit(False))


def _around(code: Column, start: Column, end: Column, path: str = "") -> dict[str, Column]:
    """Prefix, suffix and the fill-in-the-middle prompt around a range of a text."""
    low = F.greatest(F.lit(0), start - CONTEXT)
    prefix, suffix = F.substring(code, low + 1, start - low), F.substring(code, end + 1, F.lit(CONTEXT))
    head = F.when(low == 0, F.lit("<file_sep><fim_prefix>" + (path + "\n" if path else ""))).otherwise(F.lit("<fim_prefix>"))
    return {"prefix": prefix, "suffix": suffix, "prompt": F.concat(head, prefix, F.lit("<fim_suffix>"), suffix, F.lit("<fim_middle>"))}


def prompts(rows: DataFrame, code: str = "text", path: str = "") -> DataFrame:
    """rows (with their text, start and end) with prefix, suffix and prompt in place of the text."""
    return rows.withColumns(_around(F.col(code), F.col("start"), F.col("end"), path)).drop(code)


def infills(docs: DataFrame, seed: int = 42, shortest: int = 2) -> DataFrame:
    """blob_id, level, ord, value, quote_char, prefix, suffix, prompt of the elements to be restored: of each level
    at most CAP, of those the long enough ones. All is cut in the row that has the text, so no text moves."""
    text = F.col("text")

    def of(level: str) -> Column:
        chosen = F.filter(capped(level, elements_of(level, text), CAP, seed), lambda x: long_enough(x["e"]["value"], shortest))
        return F.transform(chosen, lambda x: F.struct(F.lit(level).alias("level"), x["ord"].alias("ord"), x["e"]["value"].alias("value"), x["e"]["quote_char"].alias("quote_char"), *[c.alias(k) for k, c in _around(text, x["e"]["start"], x["e"]["end"]).items()]))

    return docs.select("blob_id", F.explode(F.concat(*[of(level) for level in LEVELS])).alias("x")).select("blob_id", "x.*")


def stops(level: str = "level", quote: str = "quote_char") -> Column:
    """The strings at which an infill ends."""
    out = F.array(F.col(quote))
    for k, v in STOPS.items():
        if v:
            out = F.when(F.col(level) == k, F.array(*[F.lit(x) for x in v])).otherwise(out)
    return out


def cut_infill(output: Column, ends: Column) -> Column:
    """What follows the first <fim_middle>, up to the earliest stop string or end mark, stripped."""
    at = F.locate("<fim_middle>", output)
    body = F.when(at > 0, F.substring(output, at + len("<fim_middle>"), F.length(output))).otherwise(output)
    marks = F.concat(ends, F.array(F.lit("<|endoftext|>"), F.lit("<file_sep>")))
    places = F.filter(F.transform(marks, lambda m: F.call_function("locate", m, body)), lambda i: i > 0)
    return py_strip(F.substring(body, F.lit(1), F.coalesce(F.array_min(places) - 1, F.length(body))))


def hit(level: Column, value: Column, found: Column) -> Column:
    """1 where an infill restores the element: equal ignoring case for names, at least HIT alike for texts.

    Only texts whose lengths allow such a likeness are compared.
    """
    may = fuzz_at_most(value, found) >= HIT
    alike = fuzz_ratio(F.when(may & ~level.isin(*EXACT), value), F.when(may & ~level.isin(*EXACT), found)) >= HIT
    same = F.when(level.isin(*EXACT), py_upper_eq(py_strip(value), py_strip(found))).otherwise(alike)
    return F.coalesce(F.when(found == TOO_LONG, F.lit(False)).otherwise(same), F.lit(False)).cast("int")


def features(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """blob_id and twelve columns: hit ratio and number processed of each level, zeros without elements."""
    by = hits.groupBy("blob_id").pivot("level", list(FEATURE_ORDER)).agg(F.avg("hit").alias("hits"), F.count("hit").alias("total"))
    out = docs.select("blob_id").join(by, "blob_id", "left")
    cols = []
    for level in FEATURE_ORDER:
        cols += [F.coalesce(F.col(f"{level}_hits"), F.lit(0.0)).alias(f"{level}_hits"), F.coalesce(F.col(f"{level}_total"), F.lit(0)).cast("double").alias(f"{level}_total")]
    return out.select("blob_id", *cols)


def too_long(prompt: str | Column = "prompt") -> Column:
    """Whether a prompt and its infill exceed what the model reads; a null prompt does not."""
    return F.coalesce(F.regexp_count(prompt, F.lit(r"[^ \t-\r]+")), F.lit(0)) + NEW_TOKENS > MODEL_TOKENS


def infill_hits(model, docs: DataFrame, seed: int = 42, max_new: int = NEW_TOKENS) -> DataFrame:
    """blob_id, level, ord, hit of the elements to be restored, as the model fills them in."""
    out = model.infill(infills(docs, seed), max_new)
    found = F.when(too_long(), F.lit(TOO_LONG)).otherwise(cut_infill(F.concat("prompt", "output"), stops()))
    # written, so that what the hit reads several times is cut once
    out = written(out.select("blob_id", "level", "ord", "value", found.alias("found")), "infill-found")
    return out.select("blob_id", "level", "ord", hit(F.col("level"), F.col("value"), F.col("found")).alias("hit"))
