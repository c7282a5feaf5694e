"""Suffix-array dedup of long exact repeats with a logarithmic index family.

A byte goes if a ``length``-byte string that covers it also starts anywhere else in the corpus.

Index. Suffixes are sampled at content-defined anchors: the anchor of a window of ``length`` bytes is
the (leftmost) smallest hash of its ``GRAM``-byte strings, so equal windows have equal anchors, and the
anchors' strings find every match of ``length`` bytes or more. In place of the suffixes themselves a
level of the family holds the 64-bit hash of each anchor's string, sorted, with its count: sorted byte
suffixes of 200 bytes would be two and a half times the corpus (the README has the figures). Documents
arrive in batches: a batch's level is merge-scanned (a sort-merge join) against each existing one, which
gives the anchors that repeat, and is then put in as the smallest; a level merges with one that has no
more than twice its entries, so levels grow geometrically. ``save`` and ``load`` keep a family.

Resolution. The run of windows that share an anchor is a segment. Repeated anchors whose whole
segment repeats are done: all their bytes go. Where segments of one anchor differ (the borders of a
match), their windows are compared one by one through a 128-bit digest; a segment that repeats as a
whole takes part in that through one representative. So copies are never expanded into pairs. A segment
or block goes if its anchor's hash and the 64-bit digest of all its bytes are both another's.

Rows are named by a hash of id and text, so identical rows share decisions; a second hash shows whether
two different rows share a name, and then other names are given. Defined cases: null texts are empty;
texts under ``length`` bytes keep everything; matches never cross documents; identical rows are copies
of each other like any others; ids may be null, repeat and be of any type; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import file_system
from . import kernels
from .common import broadcast_if_small, discard, groups_by_size, materialize, measured, utf8

LENGTH = 200
GRAM = 48
BLOCK = 16
BATCHES = 4
_CHUNK = 1 << 17  # bytes hashed at a time
_ROWS = 1 << 16  # rows handed on at a time
_CODE = 64  # codes of blocks: segment * _CODE + block
_POSITION = np.uint64((1 << 22) - 1)


def _prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = kernels.powers(len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(kernels._MIX[data] * up[: len(data)], out=total[1:])
    return total, down


def _strings(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n-byte string."""
    total, down = _prefix(data)
    return kernels.finish((total[n:] - total[:-n]) * down[: len(data) - n + 1])


def _anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor position of each window start, and the hash of each GRAM-byte string."""
    hashes = _strings(data, GRAM)
    low = (hashes & ~_POSITION) | np.arange(len(hashes), dtype=np.uint64)
    width, have = length - GRAM + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    rest = width - have
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    return (low & _POSITION).astype(np.int64), hashes


def segments(texts: list[bytes], length: int = LENGTH):
    """For each text: arrays (first start, last start, key, anchor) of the runs of windows that share an anchor."""
    none = np.zeros(0, dtype=np.int64)
    out: list = [(none, none, none.view(np.uint64), none)] * len(texts)

    def runs(data, starts):
        """Of the windows at starts (ascending): (first, last, anchor, key) of each run."""
        where, hashes = _anchors(data, length)
        at = where[starts]
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(starts) != 1)]))
        last = np.concatenate([cut[1:], [len(starts)]]) - 1
        return starts[cut], starts[last], at[cut], hashes[at[cut]]

    for lo, hi in groups_by_size(texts, _CHUNK):
        if hi == lo + 1 and len(texts[lo]) > 2 * _CHUNK:  # one very long text, by pieces
            data, parts = np.frombuffer(texts[lo], dtype=np.uint8), []
            for at in range(0, len(data) - length + 1, _CHUNK):
                piece = data[at : at + _CHUNK + length - 1]
                f, e, p, k = runs(piece, np.arange(len(piece) - length + 1))
                f, e, p = f + at, e + at, p + at
                if parts and parts[-1][2][-1] == p[0]:
                    parts[-1][1][-1] = e[0]
                    f, e, p, k = f[1:], e[1:], p[1:], k[1:]
                if len(f):
                    parts.append((f, e, p, k))
            f, e, p, k = (np.concatenate(x) for x in zip(*parts, strict=True))
            out[lo] = (f, e, k, p)
            continue
        data = np.frombuffer(b"\0".join(texts[lo:hi]), dtype=np.uint8)
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts[lo:hi]])
        starts = [np.arange(a, b - length) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True) if b - a > length]
        if not starts:
            continue
        f, e, p, k = runs(data, np.concatenate(starts))
        doc = np.searchsorted(bounds, f, side="right") - 1
        cut = np.searchsorted(doc, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            a, b = cut[i], cut[i + 1]
            out[lo + i] = (f[a:b] - bounds[i], e[a:b] - bounds[i], k[a:b], p[a:b] - bounds[i])
    return out


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, text and rid, a name that only rows of equal id and text share."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.col("text").isNull().alias("missing"))
    for salt in range(8):
        named = rows.withColumn("rid", F.xxhash64(F.lit(salt), "doc_id", "text", "missing"))
        other = F.xxhash64("text", "doc_id", "missing", F.lit(salt))
        if not named.groupBy("rid").agg((F.min(other) != F.max(other)).alias("clash")).filter("clash").limit(1).count():
            return named.drop("missing")
    raise RuntimeError("rows cannot be named apart")  # eight independent clashes


def entries(named: DataFrame) -> DataFrame:
    """(key, whole, rid, seg): the sparse suffixes of each row; whole: digest of the segment's bytes."""

    def scan(batches):
        for batch in batches:
            texts, rid = utf8(batch.column("text")), batch.column("rid").to_numpy()
            for lo, hi in groups_by_size(texts, 8 * _CHUNK):
                found = segments(texts[lo:hi])
                sizes = [len(f) for f, _, _, _ in found]
                whole = np.array([xxhash.xxh3_64_intdigest(t[a : b + LENGTH]) for t, (f, e, _, _) in zip(texts[lo:hi], found, strict=True) for a, b in zip(f.tolist(), e.tolist(), strict=True)], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([k for _, _, k, _ in found]).view(np.int64)), pa.array(whole.view(np.int64)), pa.array(np.repeat(rid[lo:hi], sizes)), pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]))],
                    names=["key", "whole", "rid", "seg"],
                )

    return named.select("text", "rid").mapInArrow(scan, "key bigint, whole bigint, rid bigint, seg int")


class LogIndex:
    """A logarithmic family of levels of (key, n), each sorted by key, the largest first."""

    def __init__(self) -> None:
        self.levels: list[DataFrame] = []
        self.matches: list[DataFrame] = []
        self.old: list[DataFrame] = []

    def _merge(self) -> None:
        while len(self.levels) > 1 and measured(self.levels[-2])["rows"] <= 2 * measured(self.levels[-1])["rows"]:
            b, a = self.levels.pop(), self.levels.pop()
            merged = a.unionByName(b).groupBy("key").agg(F.sum("n").alias("n"))
            self.levels.append(materialize(merged.sortWithinPartitions("key"), "level"))
            self.old += [a, b]  # earlier matches still read them

    def add(self, suffixes: DataFrame) -> None:
        """Merge-scan a batch of entries against all levels, keep the keys that repeat, and put it in as a level."""
        self._merge()
        level = materialize(suffixes.groupBy("key").agg(F.count("*").alias("n")).sortWithinPartitions("key"), "level")
        self.matches.append(level.filter("n > 1").select("key"))
        self.matches += [level.join(old.hint("merge"), "key", "left_semi").select("key") for old in self.levels]
        self.levels.append(level)

    def repeated(self) -> DataFrame:
        """The keys that occur more than once among all that was added, and not only among what was loaded."""
        out = self.matches[0]
        for m in self.matches[1:]:
            out = out.unionByName(m)
        return out.distinct()

    def save(self, folder: str) -> None:
        for i, level in enumerate(self.levels):
            level.write.mode("overwrite").parquet(f"{folder}/level-{i:02d}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> LogIndex:
        """The family that ``save`` wrote, to be extended by further batches."""
        out, i = cls(), 0
        fs, _ = file_system(spark, folder)
        while fs.exists(file_system(spark, f"{folder}/level-{i:02d}")[1]):
            out.levels.append(materialize(spark.read.parquet(f"{folder}/level-{i:02d}"), "level"))
            i += 1
        return out

    def discard(self) -> None:
        """Delete the levels of a family that is no longer read."""
        discard(*self.levels, *self.old)


def classify(rows: DataFrame, outer: str, whole: str, ids: list[str], tag: str) -> DataFrame:
    """ids, goes, asks of rows that share ``outer`` with another: goes, if another row is the same as a whole; asks,
    if a row of another kind shares outer, and this one is the only, or the first, of its kind."""
    kinds = materialize(rows.groupBy(outer, whole).agg(F.count("*").alias("n"), F.min(F.struct(*ids)).alias("one")), f"{tag}-kinds")
    mixed = materialize(kinds.groupBy(outer).agg(F.count("*").alias("kinds")).filter("kinds > 1"), f"{tag}-mixed")  # so that the join can split a hot key
    kinds = kinds.join(mixed, outer, "left").select(outer, whole, "n", "one", F.col("kinds").isNotNull().alias("mixed"))
    kinds = materialize(kinds.filter("n > 1 or mixed"), f"{tag}-shared")
    judged = rows.join(kinds, [outer, whole])
    judged = judged.select(*ids, (F.col("n") > 1).alias("goes"), (F.col("mixed") & ((F.col("n") == 1) | (F.struct(*ids) == F.col("one")))).alias("asks"))
    return materialize(judged.filter("goes or asks").distinct(), f"{tag}-judged")


def _ask(named: DataFrame, asking: DataFrame, code, rows_of, schema: str, tag: str) -> DataFrame:
    """What rows_of makes of each (text, segments, codes asked) of the rows that ask."""
    asked = materialize(asking.groupBy("rid").agg(F.collect_list(code).alias("codes")), f"{tag}-asking", bytes=F.sum(8 * F.size("codes") + 40))
    names, kinds = [x.split()[0] for x in schema.split(", ")], [pa.binary() if x.endswith("binary") else pa.int64() for x in schema.split(", ")]

    def batch_of(out):
        columns = list(zip(*out, strict=True)) if out else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def expand(batches):
        for batch in batches:
            texts, rid, codes = utf8(batch.column("text")), batch.column("rid").to_pylist(), batch.column("codes").to_pylist()
            for lo, hi in groups_by_size(texts, _CHUNK):
                out = []
                for i, found in zip(range(lo, hi), segments(texts[lo:hi]), strict=True):
                    for row in rows_of(rid[i], texts[i], [x.tolist() for x in found], codes[i]):
                        out.append(row)
                        if len(out) == _ROWS:
                            yield batch_of(out)
                            out = []
                yield batch_of(out)

    rows = named.select("rid", "text").join(broadcast_if_small(asked, 200_000), "rid").select("rid", "text", "codes")
    return materialize(rows.mapInArrow(expand, schema), tag)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _offsets(found, code: int) -> tuple[int, int, int, int]:
    """Anchor, block, and smallest and largest distance of the block's windows before the anchor."""
    seg, block = divmod(code, _CODE)
    first, last, _, anchor = (x[seg] for x in found)
    return anchor, block, max(anchor - last, BLOCK * block), min(anchor - first, BLOCK * block + BLOCK - 1)


def _blocks(rid: int, text: bytes, found, segs: list[int]):
    """Rows (core, whole, rid, code) of the blocks of windows of the segments asked for.

    Blocks are of windows BLOCK * j to BLOCK * j + BLOCK - 1 bytes before the anchor. core digests the
    bytes that all windows of such a block share; whole those of the block's part within the segment.
    """
    one = xxhash.xxh3_64_intdigest
    for seg in segs:
        first, last, anchor = found[0][seg], found[1][seg], found[3][seg]
        for j in range((anchor - last) // BLOCK, (anchor - first) // BLOCK + 1):
            p, _, near, far = _offsets(found, seg * _CODE + j)
            core = p - BLOCK * j
            yield _signed(one(text[core : core + LENGTH - BLOCK + 1], j)), _signed(one(text[p - far : p - near + LENGTH], j)), rid, seg * _CODE + j


def _windows(rid: int, text: bytes, found, codes: list[int]):
    """Rows (h, rid, start) of the windows of the blocks asked for."""
    one = xxhash.xxh3_128_digest
    for code in codes:
        p, _, near, far = _offsets(found, code)
        for start in range(p - far, p - near + 1):
            yield one(text[start : start + LENGTH]), rid, start


def marks(docs: DataFrame, batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """The named rows, and (rid, segs, codes, starts): segments, blocks and single windows that go."""
    named = _named(docs)
    every = materialize(entries(named).withColumn("batch", F.pmod("rid", F.lit(batches)).cast("int")), "entries")
    index = LogIndex()
    for b in range(batches):
        index.add(every.filter(F.col("batch") == b))
    keys = materialize(index.repeated(), "repeated")
    again = materialize(every.drop("batch").join(broadcast_if_small(keys), "key", "left_semi"), "again")
    index.discard()
    discard(every, keys)
    by_segment = classify(again, "key", "whole", ["rid", "seg"], "segments")
    discard(again)
    blocks = _ask(named, by_segment.filter("asks"), "seg", _blocks, "core bigint, whole bigint, rid bigint, code bigint", "blocks")
    by_block = classify(blocks, "core", "whole", ["rid", "code"], "blocks")
    discard(blocks)
    spread = _ask(named, by_block.filter("asks"), "code", _windows, "h binary, rid bigint, start bigint", "windows")
    shared = materialize(spread.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "shared")
    starts = spread.join(broadcast_if_small(shared), "h", "left_semi").select("rid", "start").distinct()
    none = F.lit(None).cast("bigint")
    both = by_segment.filter("goes").select("rid", F.col("seg").cast("bigint").alias("seg"), none.alias("code"), none.alias("start"))
    both = both.unionByName(by_block.filter("goes").select("rid", none.alias("seg"), "code", none.alias("start")))
    both = both.unionByName(starts.select("rid", none.alias("seg"), none.alias("code"), "start"))
    out = materialize(both.groupBy("rid").agg(*[F.collect_list(c).alias(f"{c}s") for c in ("seg", "code", "start")]), "marks")
    discard(spread, shared, by_segment, by_block)
    return named, out


def covered(found, segs: list[int], codes: list[int], starts: list[int]) -> list[tuple[int, int]]:
    """The maximal removed byte runs of one text."""
    found = [x.tolist() for x in found]
    gone = [(found[0][s], found[1][s] + LENGTH) for s in segs]
    for code in codes:
        p, _, near, far = _offsets(found, code)
        gone.append((p - far, p - near + LENGTH))
    out: list[tuple[int, int]] = []
    for a, b in sorted([*gone, *((s, s + LENGTH) for s in starts)]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, kept (the remaining bytes) and spans (removed byte runs) of each row."""
    named, found = marks(docs, batches)

    def cut(rows):
        kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        for batch in rows:
            texts = utf8(batch.column("text"))
            segs, codes, starts = (batch.column(c).to_pylist() for c in ("segs", "codes", "starts"))
            for lo, hi in groups_by_size(texts, _CHUNK):
                kept, spans = [], []
                for i, x in zip(range(lo, hi), segments(texts[lo:hi]), strict=True):
                    gone, at, left = covered(x, segs[i], codes[i], starts[i]), 0, []
                    for a, b in gone:
                        left.append(texts[i][at:a])
                        at = b
                    kept.append(b"".join([*left, texts[i][at:]]))
                    spans.append([{"s": a, "e": b} for a, b in gone])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array([len(t) for t in texts[lo:hi]], pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)], names=["doc_id", "n_bytes", "kept", "spans"])

    rest = T._parse_datatype_string("n_bytes bigint, kept binary, spans array<struct<s: bigint, e: bigint>>")
    schema = T.StructType([named.schema["doc_id"], *rest.fields])
    rids = broadcast_if_small(found.select("rid"))
    touched = named.join(rids, "rid", "left_semi").join(found, "rid").select("doc_id", "text", "segs", "codes", "starts").mapInArrow(cut, schema)
    whole = named.join(rids, "rid", "left_anti").select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.encode("text", "utf-8").alias("kept"), F.expr("cast(array() as array<struct<s: bigint, e: bigint>>)").alias("spans"))
    return touched.unionByName(whole)


def report(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    out = remove_repeats(docs, batches)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
