"""Eleven source perturbations as column functions, and the prefix split.

Every draw is an md5 key over (seed, kind, blob_id), so variants do not depend on partitioning.
Results are lines joined by newlines; renames keep the text otherwise as it is. A null text gives
null; a text without lines is treated as an empty list of lines.

``variants`` makes all eleven of a text at once, in Arrow batches: ``_Code`` cuts the text into lines, words and names once.
"""

from __future__ import annotations

import hashlib
import re
import string
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.folds import bind
from ..functions.text import WORD, draw_below, draw_uniform, order_key, py_splitlines, py_strip, rename_word

SEED = 42
# Fragments that the variants insert, reserved words, default names and ranges of numbers.
CONDITIONS = ('if "key" != "key":', "if False:")
BODIES = ("    void_array = [''] * 50", "    void_array[10] = 'A'")
LOOPS = ("while False:", 'while "key" != "key":')
LOOP_BODIES = ('    print("Debug: Entering loop")', "    pass")
ENTERING = ('print("Debug: Entering method ', '()")')
SHOWING = ('print("Debug: Variable ', ' = ", ', ")")
RESERVED = (
    "False None True and as assert async await break class continue def del elif else except finally for from global "
    "if import in is lambda nonlocal not or pass raise return try while with yield"
).split()
METHOD, VARIABLE = "foo", "x"
CHARACTERS = string.ascii_letters + string.digits + string.punctuation
CONSTANT_LENGTH = 12
NUMBERS = 10_000


def _pick(options: Column, purpose: str, seed: int) -> Column:
    """One of an array by draw; null for none."""
    return F.get(options, draw_below(F.size(options), seed, purpose, "blob_id"))


def _choose(options: tuple, purpose: str, seed: int) -> Column:
    return _pick(F.array(*[F.lit(o) for o in options]), purpose, seed)


def _number(purpose: str, seed: int) -> Column:
    return (F.lit(1000) + draw_below(F.lit(9000), seed, purpose, "blob_id")).cast("string")


def _is_word(purpose: str, seed: int) -> Column:
    return draw_below(F.lit(2), seed, purpose + "-kind", "blob_id") == 1


def _constant(purpose: str, seed: int) -> Column:
    """A number below NUMBERS or a quoted string of random characters, half each."""
    key = order_key(seed, purpose + "-word", "blob_id")
    pair = lambda i: F.conv(F.substring(key, 2 * i + 1, 2), 16, 10).cast("int")
    word = F.concat(F.lit("'"), *[F.substring(F.lit(CHARACTERS), pair(i) % len(CHARACTERS) + 1, F.lit(1)) for i in range(CONSTANT_LENGTH)], F.lit("'"))
    return F.when(_is_word(purpose, seed), word).otherwise(draw_below(F.lit(NUMBERS), seed, purpose, "blob_id").cast("string"))


def _insert(lines: Column, at: Column, new: Column) -> Column:
    """Lines joined, with an array of new lines before line ``at``."""
    return bind(lines, lambda x: bind(at, lambda i: F.array_join(F.concat(F.slice(x, F.lit(1), i), new, F.slice(x, i + 1, F.size(x) + 1)), "\n")))


def _anywhere(lines: Column, purpose: str, seed: int) -> Column:
    return draw_below(F.size(lines) + 1, seed, purpose, "blob_id")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"{WORD}+"), F.lit(0))


def variables(code: Column) -> Column:
    """Sorted distinct identifiers that are not reserved and start in lower case or with an underscore."""
    return F.array_sort(F.array_distinct(F.filter(_words(code), lambda t: t.rlike("^[_a-z][_a-zA-Z0-9]*$") & ~t.isin(*RESERVED))))


def methods(code: Column) -> Column:
    """Names after a def at the start of a line, in order; not reserved, nor in upper case at the start of a line of their own."""
    reserved = "|".join(RESERVED)
    return F.regexp_extract_all(code, F.lit(rf"(?dUm)^\s*def\s+((?!(?:{reserved})\b)(?!^[A-Z])[_a-zA-Z][_a-zA-Z0-9]*)"), F.lit(1))


def _first_line(lines: Column, name: Column) -> Column:
    """Index of the first line that has the name as a whole word, or null. The name is drawn once, not for every line."""
    return bind(name, lambda n: F.get(F.filter(F.transform(lines, lambda x, i: F.when(F.array_contains(_words(x), n), i)), lambda i: i.isNotNull()), F.lit(0)))


def false_if_fixed(code: Column, seed: int = SEED) -> Column:
    lines = py_splitlines(code)
    return _insert(lines, _anywhere(lines, "p1", seed), F.array(_choose(CONDITIONS, "p1c", seed), _choose(BODIES, "p1b", seed)))


def false_if_random(code: Column, seed: int = SEED) -> Column:
    lines = py_splitlines(code)
    usable = F.filter(F.transform(lines, py_strip), lambda x: (F.length(x) > 0) & ~F.endswith(x, F.lit(":")))
    body = F.concat(F.lit("    "), F.coalesce(_pick(usable, "p2b", seed), F.lit("pass")))
    return _insert(lines, _anywhere(lines, "p2", seed), F.array(_choose(CONDITIONS, "p2c", seed), body))


def unused_var_existing(code: Column, seed: int = SEED) -> Column:
    """Assign an existing variable (else a constant) before the first line that has it as a word.

    Without such a line the lines come twice, around the assignment. No line is taken to hold a drawn
    string constant.
    """
    lines = py_splitlines(code)
    known = _pick(variables(code), "p3", seed)
    value = F.coalesce(known, _constant("p3k", seed))
    new = F.array(F.concat(F.lit("unused_"), _number("p3n", seed), F.lit(" = "), value))
    found = _first_line(lines, value)
    twice = F.array_join(F.concat(lines, new, lines), "\n")
    return F.when(found.isNull(), twice).otherwise(_insert(lines, F.coalesce(found, F.lit(0)), new))


def unused_var_random(code: Column, seed: int = SEED) -> Column:
    lines = py_splitlines(code)
    return _insert(lines, _anywhere(lines, "p4", seed), F.array(F.concat(F.lit("unused_"), _number("p4n", seed), F.lit(" = "), _constant("p4k", seed))))


def rename_var(code: Column, seed: int = SEED) -> Column:
    return rename_word(code, _pick(variables(code), "p5", seed), F.concat(F.lit("var_"), _number("p5n", seed)))


def rename_method(code: Column, seed: int = SEED) -> Column:
    return rename_word(code, _pick(methods(code), "p6", seed), F.concat(F.lit("method_"), _number("p6n", seed)))


def _print_after(lines: Column, name: Column, message: Column) -> Column:
    """The message, indented as the first line with the name, after that line; else after the first line."""
    found = _first_line(lines, name)
    indent = F.when(found.isNull(), F.lit("")).otherwise(F.regexp_extract(F.get(lines, found), r"(?dU)^(\s*)", 1))
    return _insert(lines, F.least(F.coalesce(found, F.lit(0)) + 1, F.size(lines)), F.array(F.concat(indent, message)))


def print_enter(code: Column, seed: int = SEED) -> Column:
    name = F.coalesce(_pick(methods(code), "p7", seed), F.lit(METHOD))
    return _print_after(py_splitlines(code), name, F.concat(F.lit(ENTERING[0]), name, F.lit(ENTERING[1])))


def print_variable(code: Column, seed: int = SEED) -> Column:
    lines = py_splitlines(code)
    name = F.coalesce(_pick(variables(code), "p8", seed), F.lit(VARIABLE))
    message = F.concat(F.lit(SHOWING[0]), name, F.lit(SHOWING[1]), name, F.lit(SHOWING[2]))
    return F.when(F.size(lines) == 0, code).otherwise(_print_after(lines, name, message))


def _empty_range(purpose: str, seed: int) -> Column:
    """A for loop from the larger of two drawn numbers to the smaller."""
    x, y = (draw_below(F.lit(NUMBERS), seed, purpose + end, "blob_id") for end in ("x", "y"))
    return F.concat(F.lit("for _ in range("), F.greatest(x, y).cast("string"), F.lit(", "), F.least(x, y).cast("string"), F.lit("):"))


def false_loop_for(code: Column, seed: int = SEED) -> Column:
    lines = py_splitlines(code)
    return _insert(lines, _anywhere(lines, "p9", seed), F.array(_empty_range("p9", seed), _choose(LOOP_BODIES, "p9b", seed)))


def false_loop_while(code: Column, seed: int = SEED) -> Column:
    lines = py_splitlines(code)
    return _insert(lines, _anywhere(lines, "p10", seed), F.array(_choose(LOOPS, "p10c", seed), _choose(LOOP_BODIES, "p10b", seed)))


def unused_var_loop(code: Column, seed: int = SEED) -> Column:
    """An empty loop whose body, a constant's assignment, is not indented."""
    lines = py_splitlines(code)
    body = F.concat(F.lit("unused_"), _number("p11n", seed), F.lit(" = "), _constant("p11k", seed))
    return _insert(lines, _anywhere(lines, "p11", seed), F.array(_empty_range("p11", seed), body))


#: In the order of variants 1 .. 11.
VARIANTS = {
    "false_if_fixed": false_if_fixed, "false_if_random": false_if_random, "unused_var_existing": unused_var_existing,
    "unused_var_random": unused_var_random, "rename_var": rename_var, "rename_method": rename_method, "print_enter": print_enter,
    "print_variable": print_variable, "false_loop_for": false_loop_for, "false_loop_while": false_loop_while, "unused_var_loop": unused_var_loop,
}


def prefix_split(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs with prefix and gt: the text cut at int(len * U(0.4, 0.6))."""
    at = F.floor(F.length("text") * (F.lit(0.4) + F.lit(0.2) * draw_uniform(seed, "prefix", "blob_id"))).cast("int")
    return docs.withColumn("prefix", F.substring(F.col("text"), F.lit(1), at)).withColumn("gt", F.substring(F.col("text"), at + 1, F.length("text")))


#: White space as Java's Unicode classes have it; Python's has U+001C to U+001F as well.
_SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_WORDS, _NAME, _INDENT, _TOKENS = re.compile(r"\w+"), re.compile("[_a-z][_a-zA-Z0-9]*"), re.compile(f"{_SPACE}*"), re.compile(r"[^ \t-\r]+")
_METHODS = re.compile(rf"(?m)^{_SPACE}*def{_SPACE}+((?!(?:{'|'.join(RESERVED)})\b)(?!^[A-Z])[_a-zA-Z][_a-zA-Z0-9]*)")
#: Bytes of a batch of variants, about.
BATCH = 4 << 20


class _Code:
    """The eleven variants of one text, equal to the columns above."""

    def __init__(self, text: str, blob: str | None, seed: int) -> None:
        self.text, self.blob, self.seed, self.lines = text, blob or "", seed, text.splitlines()

    @cached_property
    def variables(self) -> list[str]:
        return sorted(w for w in set(_WORDS.findall(self.text)) if _NAME.fullmatch(w) and w not in RESERVED)

    @cached_property
    def methods(self) -> list[str]:
        return _METHODS.findall(self.text)

    def _key(self, purpose: str) -> str:
        return hashlib.md5(f"{self.seed}|{purpose}|{self.blob}".encode()).hexdigest()

    def _draw(self, n: int, purpose: str) -> int:
        return int(self._key(purpose)[:8], 16) % max(n, 1)

    def _pick(self, options, purpose: str) -> str | None:
        return options[self._draw(len(options), purpose)] if options else None

    def _number(self, purpose: str) -> str:
        return str(1000 + self._draw(9000, purpose))

    def _constant(self, purpose: str) -> str:
        if self._draw(2, purpose + "-kind") != 1:
            return str(self._draw(NUMBERS, purpose))
        key = self._key(purpose + "-word")
        return "'" + "".join(CHARACTERS[int(key[2 * i : 2 * i + 2], 16) % len(CHARACTERS)] for i in range(CONSTANT_LENGTH)) + "'"

    def _insert(self, at: int, *new: str) -> str:
        return "\n".join([*self.lines[:at], *new, *self.lines[at:]])

    def _anywhere(self, purpose: str, *new: str) -> str:
        return self._insert(self._draw(len(self.lines) + 1, purpose), *new)

    def _first_line(self, name: str) -> int | None:
        return next((i for i, x in enumerate(self.lines) if name in x and name in _WORDS.findall(x)), None)

    def _renamed(self, name: str | None, new: str) -> str:
        return self.text if name is None else re.sub(rf"(?<!\w){name}(?!\w)", new, self.text)

    def _print_after(self, name: str, message: str) -> str:
        found = self._first_line(name)
        indent = "" if found is None else _INDENT.match(self.lines[found]).group()
        return self._insert(min((found or 0) + 1, len(self.lines)), indent + message)

    def _range(self, purpose: str) -> str:
        x, y = (self._draw(NUMBERS, purpose + end) for end in ("x", "y"))
        return f"for _ in range({max(x, y)}, {min(x, y)}):"

    def all(self) -> list[str]:
        """The text, and the variants in the order of ``VARIANTS``."""
        usable = [x for x in (x.strip() for x in self.lines) if x and not x.endswith(":")]
        value = self._pick(self.variables, "p3") or self._constant("p3k")
        found, new = self._first_line(value), f"unused_{self._number('p3n')} = {value}"
        existing = "\n".join([*self.lines, new, *self.lines]) if found is None else self._insert(found, new)
        method, variable = self._pick(self.methods, "p7") or METHOD, self._pick(self.variables, "p8") or VARIABLE
        return [
            self.text,
            self._anywhere("p1", self._pick(CONDITIONS, "p1c"), self._pick(BODIES, "p1b")),
            self._anywhere("p2", self._pick(CONDITIONS, "p2c"), "    " + (self._pick(usable, "p2b") or "pass")),
            existing,
            self._anywhere("p4", f"unused_{self._number('p4n')} = {self._constant('p4k')}"),
            self._renamed(self._pick(self.variables, "p5"), f"var_{self._number('p5n')}"),
            self._renamed(self._pick(self.methods, "p6"), f"method_{self._number('p6n')}"),
            self._print_after(method, ENTERING[0] + method + ENTERING[1]),
            self._print_after(variable, SHOWING[0] + variable + SHOWING[1] + variable + SHOWING[2]) if self.lines else self.text,
            self._anywhere("p9", self._range("p9"), self._pick(LOOP_BODIES, "p9b")),
            self._anywhere("p10", self._pick(LOOPS, "p10c"), self._pick(LOOP_BODIES, "p10b")),
            self._anywhere("p11", self._range("p11"), f"unused_{self._number('p11n')} = {self._constant('p11k')}"),
        ]


def variants(docs: DataFrame, text: str = "prefix", seed: int = SEED, last: int | None = None) -> DataFrame:
    """docs exploded to variant 0 (the text) and 1 .. 11, as columns variant and code; last: of the code its last so many tokens, joined by blanks."""
    names = docs.columns
    kind = T.StructType([*docs.schema, T.StructField("variant", T.IntegerType()), T.StructField("code", T.StringType())])

    def make(batches):
        for batch in batches:
            held, codes, size = [], [], 0
            blobs, texts = (batch.column(names.index(c)) for c in ("blob_id", text))
            for i in range(batch.num_rows):
                code, blob = texts[i].as_py(), blobs[i].as_py()
                made = [None] * (len(VARIANTS) + 1) if code is None else _Code(code, None if blob is None else str(blob), seed).all()
                if last and code is not None:
                    made = [" ".join(_TOKENS.findall(x)[-last:]) for x in made]
                held.append(i)
                codes += made
                size += (len(VARIANTS) + 1) * len(code or "")
                if size >= BATCH or i == batch.num_rows - 1:
                    rows, n = batch.take(pa.array(held).take(pa.array([j for j in range(len(held)) for _ in range(len(VARIANTS) + 1)]))), len(VARIANTS) + 1
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(list(range(n)) * len(held), pa.int32()), pa.array(codes, pa.string())], names=[*names, "variant", "code"])
                    held, codes, size = [], [], 0

    return docs.mapInArrow(make, kind)
