"""Running folds over arrays within a row, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows that a fold gathers at a time.
CHUNK = 128


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(items: Column, zero: Column, step: Callable[[Column, Column], Column], state: str, row: str, chunk: int = CHUNK) -> Column:
    """All rows that a running fold of items gives; step maps (state, item) to a struct of the next ``st`` and the rows ``out``.

    Rows are gathered by chunks, so that the cost of appending stays near linear in very long arrays.
    """
    inner, outer = f"struct<st:{state},out:array<{row}>>", f"struct<st:{state},out:array<array<{row}>>>"
    none = lambda kind: F.array().cast(kind).alias("out")

    def whole(held: Column) -> Column:
        def gather(b: Column, at: Column) -> Column:
            one = lambda a, x: bind(step(a["st"], x), lambda n: F.struct(n["st"].alias("st"), F.concat(a["out"], n["out"]).alias("out")).cast(inner))
            part = F.aggregate(F.slice(held, at, chunk), F.struct(b["st"].alias("st"), none(f"array<{row}>")).cast(inner), one)
            return bind(part, lambda r: F.struct(r["st"].alias("st"), F.concat(b["out"], F.array(r["out"])).alias("out")).cast(outer))

        starts = F.when(F.size(held) > 0, F.sequence(F.lit(1), F.greatest(F.size(held), F.lit(1)), F.lit(chunk))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(starts, F.struct(zero.alias("st"), none(f"array<array<{row}>>")).cast(outer), gather, lambda b: F.flatten(b["out"]))

    return bind(items, whole)
