"""Column functions with the semantics of Python strings, and seeded draws that any engine repeats."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Flags under which Java's regular expressions read text as Python's do: only \n ends a line, classes are Unicode.
PY = "(?dU)"
#: A character of a word, as Python's re has it.
WORD = r"[\p{L}\p{N}_]"
_SPACE = r"[\s\x1c-\x1f]"
_BREAK = r"\r\n|[\n\x0B\f\r\x1C-\x1E\u0085\u2028\u2029]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(x) -> Column:
    """Text without surrounding Unicode white space."""
    return F.regexp_replace(_c(x), rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def nonblank(x) -> Column:
    """Whether a text has anything but white space; null does not."""
    return F.coalesce(F.length(py_strip(x)) > 0, F.lit(False))


def py_upper_eq(a, b) -> Column:
    return F.upper(_c(a)) == F.upper(_c(b))


def py_splitlines(x) -> Column:
    """Lines without their ends; a final line end opens no line."""
    lines = F.split(_c(x), _BREAK, -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def py_slice(x, start, end) -> Column:
    """x[start:end] in code points, for 0 <= start <= end."""
    return F.substring(_c(x), _c(start) + F.lit(1), _c(end) - _c(start))


def find_from(x, part, start) -> Column:
    """First place of part at or after start, or -1."""
    return F.locate(part, x, start + 1) - 1 if isinstance(start, int) else F.call_function("locate", _c(part), _c(x), _c(start) + 1) - 1


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence; a whole number holds a row of the dynamic programme in its bits."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        met = row & places.get(ch, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def lcs_length(a, b) -> Column:
    """Length of the longest common subsequence of two texts, in Arrow batches; null for null."""

    @F.pandas_udf("int")
    def length(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else _common(p, q) for p, q in zip(x, y, strict=True)], dtype="Int32")

    return length(_c(a), _c(b))


def fuzz_ratio(a, b) -> Column:
    """round(100 * 2 LCS / (len a + len b)) of the stripped texts; two empty texts are alike."""
    x, y = py_strip(a), py_strip(b)
    total = F.length(x) + F.length(y)
    return F.when(total == 0, F.lit(100)).otherwise(F.round(F.try_divide(F.lit(200.0) * lcs_length(x, y), total)).cast("int"))


def fuzz_at_most(a, b) -> Column:
    """What fuzz_ratio cannot exceed, by the lengths alone."""
    x, y = F.length(py_strip(a)), F.length(py_strip(b))
    return F.when(x + y == 0, F.lit(100)).otherwise(F.round(F.try_divide(F.lit(200.0) * F.least(x, y), x + y)).cast("int"))


def cosine(a, b) -> Column:
    """Cosine of two arrays of doubles; 0 where a norm is 0."""
    dot = F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(_c(v), lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    return F.when((norm(a) == 0) | (norm(b) == 0), F.lit(0.0)).otherwise(dot / (norm(a) * norm(b)))


def rename_word(code, name, new) -> Column:
    """Every whole word ``name`` in ``code`` replaced."""
    return F.when(_c(name).isNull(), _c(code)).otherwise(F.call_function("regexp_replace", _c(code), F.concat(F.lit(f"(?<!{WORD})"), _c(name), F.lit(f"(?!{WORD})")), _c(new)))


def order_key(seed: int, purpose: str, *cols) -> Column:
    """A hexadecimal key whose order is a seeded permutation: md5(seed|purpose|columns)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *[F.coalesce(_c(c).cast("string"), F.lit("")) for c in cols]))


def draw_int(seed: int, purpose: str, *cols) -> Column:
    """A draw of 32 bits, as a long."""
    return F.conv(F.substring(order_key(seed, purpose, *cols), 1, 8), 16, 10).cast("bigint")


def draw_uniform(seed: int, purpose: str, *cols) -> Column:
    return draw_int(seed, purpose, *cols).cast("double") / F.lit(4294967296.0)


def draw_below(n, seed: int, purpose: str, *cols) -> Column:
    """A draw from 0 .. n - 1; 0 for n < 1."""
    return F.pmod(draw_int(seed, purpose, *cols), F.greatest(_c(n).cast("bigint"), F.lit(1))).cast("int")
