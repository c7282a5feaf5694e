"""Filling gaps with a bigram model: the best path between what precedes and what follows, else a sampled continuation.

Two-sided: a lattice from the last token of the prefix to the first token of the suffix, of 1 to
``LENGTH`` tokens between them, searched by dynamic programming over all distinct ends at a time. Of
each length the path of the highest probability counts, and of the lengths the one of the highest mean
log-probability a step (ties: the shorter path, then the smaller tokens). All paths count: the search goes on from
the side that has fewer different ends, and keeps the best path of each length between each of these and every token.

Sampled: where no path connects the ends, tokens are drawn one after the other from the nucleus of the
tempered successors (``nucleus``), by draws that any engine repeats. The support is what followed a token in
training. Costs and weights are whole numbers, so that sums and ties do not depend on their order.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import discard, measured, written

# How infills are sampled.
TEMPERATURE, TOP_P = 0.2, 0.95
LENGTH = 6
#: Whole units of a weight (the likeliest successor's), and of a cost of 1.
WEIGHT, COST = 1 << 40, 1_000_000
#: Bytes up to which a table of successors is sent to all tasks.
BYTES = 32 << 20
#: Of the tokens, so many are common at most.
COMMON = 200_000


def _bytes(*tokens: str) -> Column:
    return F.sum(sum((F.octet_length(t) for t in tokens), F.lit(64)))


def _sent(table: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """A written table (or ``shown``, made of it) with a hint to broadcast it, where its measured bytes allow."""
    out = table if shown is None else shown
    return F.broadcast(out) if (measured(table)["bytes"] or 0) <= BYTES else out


def nucleus(pairs: DataFrame, temperature: float = TEMPERATURE, top_p: float = TOP_P) -> DataFrame:
    """prev, token, lo, hi, mass: the successors that are drawn after each token, as ranges of 0 .. mass - 1.

    A successor weighs its share of the likeliest one's count to the power 1 / temperature. The nucleus
    is the fewest heaviest successors (ties: the smaller token) that hold ``top_p`` of the weight.
    """
    peak = pairs.groupBy("prev").agg(F.max("c2").alias("peak"))
    weight = F.floor(F.lit(float(WEIGHT)) * F.pow(F.col("c2").cast("double") / F.col("peak"), F.lit(1.0 / temperature)))
    rows = pairs.join(peak, "prev").select("prev", "token", weight.alias("w")).filter("w > 0")
    by = Window.partitionBy("prev")
    rows = rows.withColumn("hi", F.sum("w").over(by.orderBy(F.desc("w"), "token").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("w").over(by))
    kept = rows.filter(F.col("hi") - F.col("w") < F.lit(float(top_p)) * F.col("all"))
    return kept.select("prev", "token", (F.col("hi") - F.col("w")).alias("lo"), "hi", F.max("hi").over(by).alias("mass"))


def _packed(table: DataFrame) -> DataFrame:
    """prev, hi, tokens: the successors of each token in the order of their ranges."""
    held = table.groupBy("prev").agg(F.sort_array(F.collect_list(F.struct("hi", "token"))).alias("s"))
    return held.select("prev", F.col("s.hi").alias("hi"), F.col("s.token").alias("tokens"))


def _near(table: DataFrame, rows: DataFrame, at: str) -> DataFrame:
    """The rows of a large table whose ``prev`` is in the column ``at`` of rows, by a scan where these are few: the table is not shuffled."""
    wanted = written(rows.select(F.col(at).alias("prev")).filter("prev is not null").distinct(), "fill-wanted", bytes=_bytes("prev"))
    return table.join(_sent(wanted), "prev", "left_semi")


def _common(table: DataFrame) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]:
    """The successors of the tokens that follow most tokens, of at most BYTES: those tokens, where each one's begin, and the ends of their ranges, with the tokens drawn."""
    if (measured(table)["bytes"] or 0) > BYTES:
        often = table.groupBy(F.col("token").alias("prev")).agg(F.count("*").alias("often")).orderBy(F.desc("often"), "prev").limit(COMMON)
        sizes = table.join(F.broadcast(often), "prev").groupBy("prev", "often").agg(_bytes("prev", "token").alias("bytes"))
        fits = sizes.withColumn("all", F.sum("bytes").over(Window.orderBy(F.desc("often"), "prev"))).filter(F.col("all") <= BYTES)  # at most COMMON rows
        table = table.join(F.broadcast(fits.select("prev")), "prev", "left_semi")
    held = _packed(table).toArrow()  # at most BYTES
    hi, tokens = (held.column(c).combine_chunks() for c in ("hi", "tokens"))
    flat = lambda x: x.flatten() if len(held) else pa.array([], x.type.value_type)
    return held.column("prev").combine_chunks(), np.append(0, np.cumsum(hi.value_lengths().to_numpy())).astype(np.int64), flat(hi).to_numpy(), flat(tokens)


def sampled(starts: DataFrame, table: DataFrame, max_new: int, seed: int, keys: tuple, joined=None) -> DataFrame:
    """_row, output: up to max_new draws from ``nucleus`` that follow the token ``_here`` of starts (_row, keys, _here).

    Draw k of a row reads md5(seed|infill|keys|k). A row whose last token has no successor ends. Rows are drawn where
    they are, from the broadcast successors of the commonest tokens; one that comes to another token waits until the successors
    of all tokens that are waited for have been looked up.
    """
    whole = (measured(table)["bytes"] or 0) <= BYTES
    if not hasattr(table, "_fill_common"):  # once a table: an attack fills the gaps of two parts
        table._fill_common = starts.sparkSession.sparkContext.broadcast(_common(table))
    sent = table._fill_common
    kind = pa.schema([("_row", pa.int64()), ("_key", pa.string()), ("_here", pa.string()), ("_out", pa.list_(pa.string())), ("_waits", pa.bool_())])

    def draw(batches):
        known, first, ends, tokens = sent.value
        place = dict(zip(known.to_pylist(), range(len(known)), strict=True))
        for batch in batches:
            rows = []
            for row, key, here, out, hi, given in zip(*(batch.column(c).to_pylist() for c in ("_row", "_key", "_here", "_out", "hi", "tokens")), strict=True):
                out, waits = out or [], False
                while here is not None and len(out) < max_new:
                    if hi is None and here not in place:
                        waits = not whole
                        break
                    at = place.get(here)
                    own, names = (hi, given) if hi is not None else (ends[first[at] : first[at + 1]], tokens)
                    u = int(hashlib.md5(f"{key}|{len(out)}".encode()).hexdigest()[:8], 16) / 4294967296.0
                    i = int(np.searchsorted(own, math.floor(u * float(own[-1])), side="right"))
                    here = names[i] if hi is not None else names[int(first[at]) + i].as_py()
                    out, hi = [*out, here], None
                rows.append((row, key, here, out, waits))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(kind), kind, strict=True)], schema=kind)

    key = F.concat_ws("|", F.lit(str(seed)), F.lit("infill"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys])
    none = [F.lit(None).cast(t).alias(c) for c, t in (("hi", "array<bigint>"), ("tokens", "array<string>"))]
    rows = starts.select(F.col("_row").cast("bigint").alias("_row"), key.alias("_key"), "_here", F.array().cast("array<string>").alias("_out"), *none)
    done = []
    while True:
        step = rows.mapInArrow(draw, "_row bigint, _key string, _here string, _out array<string>, _waits boolean")
        step = written(step, "fill-draws", waits=F.count_if("_waits"))
        done.append(step.filter("not _waits").select("_row", "_out"))
        if not measured(step)["waits"]:
            break
        open_ = step.filter("_waits").select("_row", "_key", "_here", "_out")
        found = written(_packed(_near(table, open_, "_here")).withColumnRenamed("prev", "_here"), "fill-found", bytes=F.sum(F.size("hi") * 64 + F.octet_length(F.array_join("tokens", " "))))
        met = open_.join(_sent(found), "_here", "left")
        rows = met.select("_row", "_key", F.when(F.col("hi").isNotNull(), F.col("_here")).alias("_here"), "_out", "hi", "tokens")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("_row", (joined(F.col("_out")) if joined else F.array_join("_out", " ")).alias("output"))


def costs(bigrams: DataFrame) -> DataFrame:
    """prev, token, cost of the pairs of a bigram model (prev, token, seen)."""
    return bigrams.select("prev", "token", F.round(F.col("seen") * -COST).cast("bigint").alias("cost"))


def lattice(ends: DataFrame, bigrams: DataFrame, length: int = LENGTH) -> DataFrame:
    """a, b, path: the tokens that best lead from a to b, for the distinct ends (a, b) that any path connects.

    A front has a row for each end of the side that has fewer, and each token: (end, at, so_far, path), the best path
    of n tokens that begins (or ends) at that token. A step of a front reads all pairs of the model once for each end.
    """
    steps = costs(bigrams)
    pairs = written(ends.select("a", "b").distinct(), "fill-ends")
    leave = written(_near(steps, pairs, "a"), "fill-leave")
    known = written(steps.select(F.col("token").alias("prev")).distinct(), "fill-known")
    known = _near(known, pairs, "b").select(F.col("prev").alias("b"))
    open_ = written(pairs.join(leave.select(F.col("prev").alias("a")).distinct(), "a", "left_semi").join(known, "b", "left_semi"), "fill-open", bytes=_bytes("a", "b"))
    n_a, n_b = open_.agg(F.count_distinct("a"), F.count_distinct("b")).first()
    arrive = written(_near(steps.select(F.col("token").alias("prev"), F.col("prev").alias("at"), "cost"), open_, "b"), "fill-arrive")
    arrive = arrive.select(F.col("prev").alias("b"), "at", "cost")
    leave = leave.select(F.col("prev").alias("a"), F.col("token").alias("at"), "cost")
    back = n_b <= n_a
    own, other, first, last = ("b", "a", arrive, leave) if back else ("a", "b", leave, arrive)
    hop = steps.select(F.col("token").alias("at"), F.col("prev").alias("to"), "cost") if back else steps.select(F.col("prev").alias("at"), F.col("token").alias("to"), "cost")
    size = F.sum(F.octet_length(own) + F.octet_length("at") + F.octet_length(F.array_join("path", " ")) + 64)
    front = first.join(_sent(open_, open_.select(own).distinct()), own, "left_semi").select(own, "at", F.col("cost").alias("so_far"), F.array("at").alias("path"))
    met, held = [], []
    for n in range(1, length + 1):
        now = written(front, "fill-front", bytes=size)
        held.append(now)
        if not measured(now)["rows"]:
            break
        closed = _sent(open_).join(last, other).join(now, [own, "at"])
        total = F.col("so_far") + F.col("cost")
        met.append(closed.groupBy("a", "b").agg(F.min(F.struct(total.alias("total"), "path")).alias("x")).select("a", "b", F.struct((F.col("x.total") / F.lit(n + 1)).alias("mean"), F.lit(n).alias("n"), F.col("x.path").alias("path")).alias("y")))
        path = F.concat(F.array("to"), "path") if back else F.concat("path", F.array("to"))
        front = hop.join(_sent(now), "at").groupBy(own, "to").agg(F.min(F.struct(total.alias("so_far"), path.alias("path"))).alias("x")).select(own, F.col("to").alias("at"), "x.so_far", "x.path")
    if not met:
        return pairs.select("a", "b", F.array("a").alias("path")).filter("false")
    found = met[0]
    for more in met[1:]:
        found = found.unionByName(more)
    out = written(found.groupBy("a", "b").agg(F.min("y").alias("y")).select("a", "b", "y.path"), "fill-paths", bytes=F.sum(F.octet_length("a") + F.octet_length("b") + F.octet_length(F.array_join("path", " ")) + 64))
    discard(*held)
    return out


def fill(prompts: DataFrame, bigrams: DataFrame, table: DataFrame, tokens, max_new: int, seed: int, length: int = LENGTH, joined=None) -> DataFrame:
    """prompts (prefix, suffix) with ``output``; draws are keyed by those of blob_id, level and ord that prompts have.

    table: what ``nucleus`` made. tokens, joined: the column functions that cut a text into tokens and join them.
    """
    keys = tuple(c for c in ("blob_id", "level", "ord") if c in prompts.columns)
    rows = written(prompts.withColumn("_row", F.monotonically_increasing_id()), "fill-prompts")
    before, after = tokens(F.col("prefix")), tokens(F.col("suffix"))
    gaps = written(rows.select("_row", *keys, F.get(before, F.size(before) - 1).alias("a"), F.get(after, F.lit(0)).alias("b")), "fill-gaps")
    paths = lattice(gaps.filter("a is not null and b is not null"), bigrams, length)
    paths = _sent(paths) if measured(paths) else paths
    met = written(gaps.join(paths, ["a", "b"], "left").select("_row", *keys, F.col("a").alias("_here"), F.when(F.col("path").isNotNull(), joined(F.col("path")) if joined else F.array_join("path", " ")).alias("output")), "fill-met")
    drawn = sampled(met.filter("output is null"), table, max_new, seed, keys, joined)
    outputs = written(met.filter("output is not null").select("_row", "output").unionByName(drawn), "fill-outputs")
    return rows.join(outputs, "_row").select(*prompts.columns, "output")
