"""SimHash near-dedup at a similarity: components of texts whose five-word shingle sets have a Jaccard similarity of 0.8 or more.

The links come first from Golay-code fuzzy hashing, as in ``simhash``, of 64-bit fingerprints of the sets, and are
confirmed on the sets. Fingerprints within two bits miss many pairs of that similarity (the README has
figures), so an exact join on the sets then adds the links that are still missing.

Words are runs of bytes other than blanks (as in ``simhash``), A-Z lower-cased; a text of fewer than
five words has one shingle of all its words, a text without words none. Texts of equal sets are one
node from the start. 64-bit hashes stand for shingles and sets.

Two sets of similarity 4/5 share one of the first ``n - ceil(4n/5) + 1`` shingles of each in any
common order (prefix filter), so every linked pair meets in the bucket of a shingle. The order puts
shingles that a sample of the rows finds common last: the sample decides how large buckets get, not
what they find. Within a bucket, sizes and the parity bitmaps of both sets (the bits in which they
differ are at most the shingles in which they differ) exclude pairs that cannot be linked, first by
short bitmaps, then by bitmaps as long as the sets; the others are confirmed on the sets themselves,
read again from the texts.

Pairs are confirmed in three passes. The first takes one possible partner of each member of the buckets of
one key in FIRST, among those that fuzzy hashing has not joined to it; the second does so in all
buckets. They join most of a large group by a linear number of pairs. The third takes all possible pairs
between the components so far, so nothing is left out. Buckets over ``LIMIT`` members are dealt
as blocks of pairs of parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, broadcast_if_small, discard, fresh, groups_by_size, materialize, measured, settle, utf8
from .components import components
from .kernels import rolling, words
from .simhash import links

WIDTH = 5
LIMIT = 2048
BITS = 512
SAMPLE, LEAST = 64, 3
_CHUNK = 1 << 20
_ROWS, _TOGETHER = 256, 1 << 16
#: Of the keys, one in so many is used by the first pass of the exact join.
FIRST = 8
_NOT_BLANK = np.ones(256, dtype=bool)
_NOT_BLANK[[9, 10, 11, 12, 13, 32]] = False


def shingles(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted hashes of each text's shingles, without repeats."""
    out = []
    for lo, hi in groups_by_size(texts, _CHUNK):
        _, starts, _, hashes = words(np.frombuffer(b"\n".join(texts[lo:hi]), dtype=np.uint8), _NOT_BLANK)
        ends = np.cumsum([len(t) + 1 for t in texts[lo:hi]])
        cuts = [0, *np.searchsorted(starts, ends).tolist()]
        out += [np.unique(rolling(hashes[a:b], min(WIDTH, b - a))) if b > a else hashes[:0] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets, sorted and not empty, have a similarity of 4/5 or more."""
    return 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y))


def fingerprint(x: np.ndarray) -> int:
    """64 bits, each set if it is in over half of a set's shingles; 0 for none."""
    if not len(x):
        return 0
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(x), 65536):
        total += np.unpackbits(x[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(total * 2 > len(x), bitorder="little").view(np.int64)[0])


def parity(x: np.ndarray, bits: int) -> bytes:
    """A bitmap: which of the values that x takes modulo bits (a power of two) it takes an odd number of times."""
    return np.packbits((np.bincount((x >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Shingles in which two sets differ at least, by their bitmaps; the longer one is folded."""
    a, b = (np.frombuffer(z, dtype=np.uint64) for z in (x, y))
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _lists(parts: list[np.ndarray]) -> pa.Array:
    values = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(values))


def _slices(batches):
    """The batches in slices of few rows, whose texts and sets take little memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def row_name() -> Column:
    """A name of the row by its id and text."""
    text = F.col("text").cast("string")
    return F.xxhash64(F.col("doc_id"), F.coalesce(text, F.lit("")), text.isNull())


def named(docs: DataFrame) -> DataFrame:
    """doc_id, text and rid, the name of the row."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), row_name().alias("rid"))


def common(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (sorted) that are common in a sample of the rows, and their counts."""

    def scan(batches):
        for batch in _slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*shingles(utf8(batch.column("text"))), np.zeros(0, np.uint64)]).view(np.int64))], names=["s"])

    sample = rows.filter(F.pmod("rid", F.lit(SAMPLE)) == 0)
    least = max(LEAST, sample.count() // 2000)
    found = sample.select("text").mapInArrow(scan, "s bigint").groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") >= least).toArrow()
    s, n = found.column("s").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def sets(rows: DataFrame) -> DataFrame:
    """doc_id, rid, node (digest of the set), n (its size), fp, prefix, bits, wide of each row."""
    often, count = common(rows)

    def prefix(x: np.ndarray) -> np.ndarray:
        most = len(x) - (4 * len(x) + 4) // 5 + 1
        if len(often):
            at = np.minimum(np.searchsorted(often, x), len(often) - 1)
            x = x[np.argsort(np.where(often[at] == x, count[at], 0), kind="stable")]
        return x[:most]

    def scan(batches):
        for batch in _slices(batches):
            found = shingles(utf8(batch.column("text")))
            node = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in found], dtype=np.uint64).view(np.int64)
            bits = [parity(x, BITS) for x in found]
            wide = [parity(x, max(BITS, 1 << (2 * len(x)).bit_length())) for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("rid"), pa.array(node), pa.array([len(x) for x in found], pa.int32()), pa.array([fingerprint(x) for x in found], pa.int64()), _lists([prefix(x) if len(x) else x for x in found]), pa.array(bits, pa.binary()), pa.array(wide, pa.binary())],
                names=["doc_id", "rid", "node", "n", "fp", "prefix", "bits", "wide"],
            )

    rest = T._parse_datatype_string("rid bigint, node bigint, n int, fp bigint, prefix array<bigint>, bits binary, wide binary")
    return rows.mapInArrow(scan, T.StructType([rows.schema["doc_id"], *rest.fields]))


def possible(bucket: np.ndarray, node: np.ndarray, n: np.ndarray, bits: np.ndarray, label: np.ndarray, part: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within buckets, of different labels, that sizes and bitmaps allow; if not every, at most one for each member.

    Where members of a bucket are of two parts, only pairs between the parts are meant. All members are
    compared with the next in their bucket (by size) at once, then with the next but one, and so on.
    """
    order = np.lexsort((node, n, bucket))
    bucket, node, n, bits, label, part = (x[order] for x in (bucket, node, n, bits, label, part))
    first = np.flatnonzero(np.concatenate([[True], np.diff(bucket) != 0]))
    sizes = np.diff(np.append(first, len(bucket)))
    end = np.repeat(first + sizes, sizes)
    two = np.repeat(np.minimum.reduceat(part, first) != np.maximum.reduceat(part, first), sizes)
    live, step, left, right = np.arange(len(bucket)), 1, [], []
    while len(live):
        other = live + step
        inside = other < end[live]
        inside[inside] = 5 * n[live[inside]] >= 4 * n[other[inside]]  # beyond, members are larger still
        live, other = live[inside], other[inside]
        ask = (label[live] != label[other]) & (~two[live] | (part[live] != part[other]))
        i, j = live[ask], other[ask]
        near = 9 * np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) <= n[i] + n[j]
        left.append(node[i[near]])
        right.append(node[j[near]])
        if not every:
            done = np.zeros(len(bucket), dtype=bool)
            done[i[near]] = True
            live = live[~done[live]]
        step += 1
    pairs = np.stack([np.concatenate([*left, node[:0]]), np.concatenate([*right, node[:0]])], axis=1)
    pairs = np.unique(np.sort(pairs, axis=1), axis=0)
    return pairs[:, 1], pairs[:, 0]


def _pairs(entries: DataFrame, large: DataFrame, about: DataFrame, every: bool) -> DataFrame:
    """Distinct (a, b) of entries (key, node, label) that may be linked; large: key, c, the parts of the large buckets; about: node, n, bits, broadcast where nodes are few."""
    dealt = entries.join(broadcast_if_small(large), "key", "left").withColumn("c", F.coalesce("c", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node", "key"), F.col("c")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("c") - 1)) if every else F.col("part")
    dealt = dealt.withColumn("other", other).select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("bucket"), "node", "label", "part")
    dealt = dealt.join(about, "node").select("bucket", "node", "n", "bits", "label", "part")

    def scan(batches):
        held: list[tuple[np.ndarray, ...]] = []

        def settle(to: int | None):
            """Pairs of the held rows up to a row, which stay held from there on."""
            nonlocal held
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            if to is None:  # the last bucket may go on
                to = int(np.searchsorted(cols[0], cols[0][-1]))
            held = [tuple(c[to:] for c in cols)] if to < len(cols[0]) else []
            a, b = possible(*(c[:to] for c in cols), every) if to else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), dtype=np.uint64).reshape(-1, BITS // 64)
                key, node, n, label, part = (batch.column(c).to_numpy() for c in ("bucket", "node", "n", "label", "part"))
                held.append((key, node, n.astype(np.int64), bits, label, part))
                if sum(len(h[0]) for h in held) >= _TOGETHER:
                    yield settle(None)
        if held:
            yield settle(sum(len(h[0]) for h in held))

    met = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(scan, "a bigint, b bigint")
    return met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _narrowed(pairs: DataFrame, single: DataFrame) -> DataFrame:
    """The pairs (a, b) that the wide bitmaps allow."""

    def scan(batches):
        for batch in batches:
            x, y, m = (batch.column(c).to_pylist() for c in ("x", "y", "m"))
            keep = pa.array([9 * apart(p, q) <= k for p, q, k in zip(x, y, m, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    wide = single.select("node", "n", "wide")
    met = pairs.join(wide.select(F.col("node").alias("a"), F.col("n").alias("p"), F.col("wide").alias("x")), "a")
    met = met.join(wide.select(F.col("node").alias("b"), F.col("n").alias("q"), F.col("wide").alias("y")), "b")
    return materialize(met.select("a", "b", "x", "y", (F.col("p") + F.col("q")).alias("m")).mapInArrow(scan, "a bigint, b bigint"), "near-narrowed")


def _confirmed(pairs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are linked, confirmed on the texts; nodes: node, rid of one row of each."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    named_by = materialize(nodes.join(wanted, "node"), "near-named")
    texts = materialize(rows.select("rid", "text").join(broadcast_if_small(named_by), "rid").select("node", "text").dropDuplicates(["node"]), "near-texts")

    def confirm(batches):
        for batch in _slices(batches):
            x, y = (shingles(utf8(batch.column(c))) for c in ("x", "y"))
            keep = pa.array([linked(p, q) for p, q in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    met = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return met.select("a", "b", "x", "y").mapInArrow(confirm, "a bigint, b bigint")


def _hashed(single: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that fuzzy hashing of their fingerprints brings together, a linear number."""
    least = materialize(single.filter("n > 0").groupBy("fp").agg(F.min("node").alias("least")), "near-fps")
    equal = single.filter("n > 0").select("fp", "node").distinct().join(broadcast_if_small(least), "fp").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    close = links(least.select("fp", F.col("least").alias("node"))).select("a", "b")
    return materialize(equal.unionByName(close).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near-hashed")


def similar(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, rid, root of each row; rows of one component have the same root."""
    rows = named(docs)
    found = materialize(sets(rows), "near-rows")
    names = found.groupBy("node", "rid").agg(F.count("*").alias("c"))
    nodes = materialize(names.groupBy("node").agg(F.min("rid").alias("rid"), F.count("*").alias("names"), F.min_by("c", "rid").alias("c")), "near-nodes", names=F.max("names"), copies=F.max("c"))
    single = found
    if (measured(nodes)["names"] or 0) > 1:  # of rows of one set, one stands for all
        first = nodes.filter("names > 1").select("node", F.col("rid").alias("first"))
        others = found.select("node", "rid").distinct().join(broadcast_if_small(first), "node").filter("rid <> first").select("rid")
        single = single.join(broadcast_if_small(materialize(others, "near-others")), "rid", "left_anti")
    if (measured(nodes)["copies"] or 0) > 1:  # of equal rows, one
        again = broadcast_if_small(nodes.filter("c > 1").select("rid"))
        single = single.join(again, "rid", "left_anti").unionByName(single.join(again, "rid", "left_semi").dropDuplicates(["node"]))
    about = single.select("node", "n", "bits")
    about = F.broadcast(about) if measured(nodes)["rows"] <= BROADCAST_ROWS // 2 else about
    nodes = nodes.select("node", "rid")
    tried = hashed = _hashed(single)
    entries = single.select("node", F.explode("prefix").alias("key"))
    shared = materialize(entries.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "near-shared")  # a node has a key once
    entries = materialize(entries.join(broadcast_if_small(shared).select("key"), "key", "left_semi"), "near-entries")
    large = materialize(shared.filter(F.col("c") > limit).select("key", F.ceil(F.col("c") / limit).cast("int").alias("c")), "near-large")
    roots = None
    for share, every in ((FIRST, False), (1, False), (1, True)):
        if roots is None:
            now = entries.filter(F.pmod(F.xxhash64("key"), F.lit(share)) == 0).withColumn("label", F.col("node"))
        else:
            labelled = entries.join(broadcast_if_small(roots), "node", "left").select("key", "node", F.coalesce("root", "node").alias("label"))
            labelled = materialize(labelled, "near-labels")
            mixed = materialize(labelled.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m")).filter("l < m").select("key"), "near-mixed")
            now = labelled.join(broadcast_if_small(mixed), "key", "left_semi")
        pairs = _pairs(now, large, about, every).join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs if roots is not None else pairs.unionByName(hashed), "near-pairs")
        tried = pairs if roots is None else tried.unionByName(pairs)
        if roots is None or measured(pairs)["rows"]:
            more = materialize(_confirmed(_narrowed(pairs, single), rows, nodes), "near-edges")
            known = more if roots is None else more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
            roots = materialize(components(known), "near-roots")
        settle(docs.sparkSession)
    discard(entries, large, shared)
    return found.select("doc_id", "rid", "node").join(broadcast_if_small(roots), "node", "left").select("doc_id", "rid", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without all but one row of each component of ``similar``: that of its smallest id stays.

    Rows without an id, which no decision can name, stay; of rows equal in id and text the smallest, as JSON, stays.
    """
    rows = materialize(similar(docs).filter("doc_id is not null"), "near-named")
    least = rows.groupBy("root").agg(F.min(F.struct("doc_id", "rid")).alias("least"))
    names = rows.groupBy("doc_id", "rid", "root").agg(F.count("*").alias("n"))
    found = names.join(least, "root").select("rid", "n", (F.col("least.rid") != F.col("rid")).alias("drop"))
    found = materialize(found.filter("drop or n > 1"), "near-found", repeats=F.count_if(~F.col("drop")))
    (rid,) = fresh(docs, "rid")
    kept = docs.withColumn(rid, row_name())
    kept = kept.join(broadcast_if_small(found.filter("drop").select(F.col("rid").alias(rid))), rid, "left_anti")
    if not measured(found)["repeats"]:
        return kept.select(*docs.columns)
    again = found.filter("not drop").select(F.col("rid").alias(rid))
    again = broadcast_if_small(again)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = kept.join(again, rid, "left_semi").groupBy(rid).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return kept.join(again, rid, "left_anti").select(*docs.columns).union(once.select("row.*"))
