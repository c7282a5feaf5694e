"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Texts are lower-cased (A-Z) and cut into words; a window is ``size`` consecutive words of a
benchmark item, or the whole of an item with fewer. Training token windows are hashed and probed
in the set; every hit is verified against the window's own words. Windows travel in blocks of at
most about ``block`` windows and 64 MB: each block is one more pass over the documents, written before the next one
starts, so a benchmark of any size is matched exactly with bounded broadcasts, one at a time, and no
document is shuffled.

Defined cases: a null or empty text has no words and no hits; an item without words has no windows;
an item with a null id marks words but is not listed; repeated items and documents count as they are
(each document row is judged by itself); an empty benchmark marks nothing; other columns pass
through, and the operator's own columns take names that clash with none of them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels
from .common import discard, fresh, groups_by_size, materialize, measured, utf8

WINDOW = 10
#: Windows, and bytes of windows with their items, of a block; items in one row of a window.
BLOCK, BYTES, ITEMS = 500_000, 64 << 20, 10_000
_CHUNK = 2 << 20


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(n_words, hash, words, item_id) of each distinct window of each item."""

    def cut(batches):
        for batch in batches:
            out = defaultdict(list)
            for text, item in zip(utf8(batch.column("text")), batch.column("item_id").to_pylist(), strict=True):
                low, s, e, h = kernels.words(np.frombuffer(text, dtype=np.uint8))
                raw, n = low.tobytes(), min(size, len(h))
                if not n:
                    continue
                for i, x in enumerate(kernels.rolling(h, n).tolist()):
                    key = b" ".join(raw[a:b] for a, b in zip(s[i : i + n], e[i : i + n], strict=True))
                    for k, v in (("n_words", n), ("hash", x - (1 << 64) if x >> 63 else x), ("words", key), ("item_id", item)):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(
                {k: pa.array(out[k], t) for k, t in (("n_words", pa.int32()), ("hash", pa.int64()), ("words", pa.binary()), ("item_id", pa.string()))}
            )

    schema = "n_words int, hash bigint, words binary, item_id string"
    ids = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return ids.mapInArrow(cut, schema).distinct()


class WindowSet:
    """One block of windows, as it is broadcast."""

    def __init__(self, rows) -> None:
        self.items: dict[bytes, tuple] = {}
        hashes = defaultdict(set)
        for r in rows:
            key = bytes(r["words"])
            self.items[key] = (*self.items.get(key, ()), *r["items"])
            hashes[r["n_words"]].add(r["hash"])
        self.by_size = {n: kernels.HashSet(np.array(sorted(h), dtype=np.int64).view(np.uint64)) for n, h in hashes.items()}

    def scan(self, text: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set, tuple]]:
        """Of each text: number of words, hit word ranges, items, (word starts, word ends)."""
        data = np.frombuffer(b"\0".join(text), dtype=np.uint8)
        low, starts, ends, hashes = kernels.words(data)
        bounds = np.cumsum([0] + [len(t) + 1 for t in text])
        first = np.searchsorted(starts, bounds)
        found: list[tuple[list, set]] = [([], set()) for _ in text]
        for n, known in self.by_size.items():
            at = known.hits(kernels.rolling(hashes, n))
            if not len(at):
                continue
            doc = np.searchsorted(bounds, starts[at], side="right") - 1
            for i, d in zip(at.tolist(), doc.tolist(), strict=True):
                if i + n > first[d + 1]:
                    continue  # runs into the next text
                key = b" ".join(low[a:b].tobytes() for a, b in zip(starts[i : i + n].tolist(), ends[i : i + n].tolist(), strict=True))
                if (items := self.items.get(key)) is not None:
                    spans, seen = found[d]
                    j = i - int(first[d])
                    if spans and spans[-1][0] <= j <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(spans[-1][1], j + n))
                    else:
                        spans.append((j, j + n))
                    seen.update(x for x in items if x is not None)
        out = []
        for d, (spans, seen) in enumerate(found):
            a, b = first[d], first[d + 1]
            out.append((int(b - a), spans, seen, (starts[a:b] - bounds[d], ends[a:b] - bounds[d]) if spans else ()))
        return out


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, size: int, block: int) -> tuple[int, Iterator[list]]:
    """The number of blocks (at least one) and the blocks, lists of windows bounded by rows and by bytes, each collected when it is asked for.

    The items of a window are gathered in as many rows as it takes to have about ``ITEMS`` in one, so a line that very
    many items share stays in no task, and in no block, as a whole.
    """
    found = materialize(windows(benchmark, size), "decon-cut")
    most = found.groupBy("n_words", "hash", "words").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    share = F.pmod(F.xxhash64("item_id"), F.lit(max(1, -(-most // ITEMS)))).alias("share")
    grouped = found.groupBy("n_words", "hash", "words", share).agg(F.collect_set("item_id").alias("items"))
    weight = F.sum(F.octet_length("words") + F.octet_length(F.array_join("items", ",")) + 64)
    grouped = materialize(grouped, "decon-windows", bytes=weight)
    discard(found)
    parts = max(1, -(-measured(grouped)["rows"] // block), -(-(measured(grouped)["bytes"] or 0) // BYTES))
    return parts, ((grouped if parts == 1 else grouped.filter(F.pmod(F.xxhash64("words", "share"), F.lit(parts)) == k)).collect() for k in range(parts))


def mark(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block: int = BLOCK, cut: bool = False, keep_text: bool = True) -> tuple[DataFrame, dict[str, str]]:
    """docs with its marks; returns the frame and the names given to n_words, n_hit, items and spans.

    spans are byte ranges of the hit runs of words in the UTF-8 text. cut=True also removes those
    bytes from the text of the last column set. keep_text=False drops the text after the last block.
    """
    names = dict(zip(("n_words", "n_hit", "items", "words_hit", "spans"), fresh(docs, "n_words", "n_hit", "items", "words_hit", "spans"), strict=True))
    span = T.ArrayType(T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())]))
    kinds = {"n_words": T.LongType(), "n_hit": T.LongType(), "items": T.ArrayType(T.StringType()), "words_hit": span, "spans": span}
    arrow_span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    arrow_kinds = {"n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string()), "words_hit": arrow_span, "spans": arrow_span}
    base, out = docs.columns, docs
    parts, blocks = _blocks(benchmark, size, block)
    for step, rows in enumerate(blocks):
        last, first = step == parts - 1, step == 0
        known = out.sparkSession.sparkContext.broadcast(WindowSet(rows))
        keep = [c for c in base if keep_text or not last or c != "text"]
        schema = T.StructType([*(f for f in out.schema.fields if f.name in keep), *(T.StructField(names[k], t) for k, t in kinds.items())])

        def pass_over(batches, known=known, keep=keep, last=last, first=first):
            for batch in batches:
                for lo, hi in groups_by_size(texts := utf8(batch.column("text")), _CHUNK):
                    part, made = batch.slice(lo, hi - lo), defaultdict(list)
                    before = None if first else [part.column(names[k]).to_pylist() for k in ("items", "words_hit", "spans")]
                    new_text = list(texts[lo:hi])
                    for i, (n, spans, seen, at) in enumerate(known.value.scan(texts[lo:hi])):
                        runs = [(int(at[0][a]), int(at[1][b - 1])) for a, b in spans] if spans else []
                        if before:
                            seen |= set(before[0][i])
                            spans = [*spans, *((x["s"], x["e"]) for x in before[1][i])]
                            runs = [*runs, *((x["s"], x["e"]) for x in before[2][i])]
                        spans, runs = union(spans), union(runs)
                        if cut and last and runs:
                            raw, pos, left = texts[lo + i], 0, []
                            for a, b in runs:
                                left.append(raw[pos:a])
                                pos = b
                            new_text[i] = b"".join([*left, raw[pos:]])
                        for k, v in (("n_words", n), ("n_hit", sum(b - a for a, b in spans)), ("items", sorted(seen)), ("words_hit", [{"s": a, "e": b} for a, b in spans]), ("spans", [{"s": a, "e": b} for a, b in runs])):
                            made[k].append(v)
                    columns = [part.column(c) for c in keep]
                    if cut and last and "text" in keep:
                        was = part.column("text")
                        columns[keep.index("text")] = pa.array([b.decode() if v else None for v, b in zip(was.is_valid().to_pylist(), new_text, strict=True)], was.type)
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.array(made[k], t) for k, t in arrow_kinds.items())], names=[*keep, *names.values()])

        before, out = out, out.mapInArrow(pass_over, schema)
        if not last:
            out = materialize(out, "decon-pass")  # so that a task holds one block at a time
            known.destroy()
            if not first:
                discard(before)
    return out, names


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    out, at = mark(docs.select("doc_id", "text"), benchmark, size, keep_text=False)
    return out.select(
        "doc_id",
        F.col(at["n_words"]).alias("n_words"),
        F.col(at["n_hit"]).alias("n_hit"),
        F.size(at["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", at["items"]), 256).alias("items_sha256"),
        (F.col(at["n_hit"]) > 0).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents in which no window occurs."""
    out, at = mark(docs, benchmark, size)
    return out.filter(F.col(at["n_hit"]) == 0).select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """All documents, without the runs of words that windows cover."""
    out, _ = mark(docs, benchmark, size, cut=True)
    return out.select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT rid, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT rid, item_id, dw.n, i FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT rid, n, i FROM hit)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""
