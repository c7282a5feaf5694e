"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints: 64 bits over 3-word shingles (words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z
lower-cased, repeats included), a bit being set if it is in over half of the shingles' XXH64
(seed 42). A 64-bit fingerprint falls into segments of 22, 21 and 21 bits. If two fingerprints
differ in 2 bits or fewer, at least one segment is equal and the next one differs in 2 bits or
fewer. A segment, padded to 23 bits, is decoded by the perfect binary Golay code: the codeword
indices of the segment and of all words one bit away are its fuzzy keys (1 or 6 of them), and two
segments within 2 bits share one, that of a word between them. So the key (segment number, equal
segment, fuzzy key of the next) brings every linked pair together; exact distances confirm.

Equal fingerprints are one node from the start. Within a bucket the verified links are reduced to a
spanning star, so the number of edges stays linear in the bucket. Buckets of over ``limit``
fingerprints do not meet in one task: their members are re-keyed by the 65 words within one bit of
the fingerprint, where two fingerprints within 2 bits share a word, all sharers are within 2 bits of
each other, and a word has at most 65 of them.

Nodes are fingerprints, so rows of one id with other texts do not join what their texts do not.

Defined cases: null and empty texts have no words and fingerprint zero, which links like any other;
fewer than three words form one shingle; rows with a null doc_id are fingerprinted and link, and a
component without any id has component_id null; repeated rows stay repeated, and a repeated id is one
of each component that its rows are in; ids are of any type that can be ordered and keep it.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, materialize, utf8
from .components import components

SEGMENTS = ((0, 22), (22, 21), (43, 21))
LIMIT = 2048
#: Generator polynomial of the (23, 12) Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
_CHUNK = 65536


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - 2)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(2, len(words) - 1) :] - 1).tolist()
    one = xxhash.xxh64_intdigest
    hashes = np.array([one(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64)
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        part = hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of each row."""

    def scan(batches):
        for batch in batches:
            out = np.array([fingerprint(t) for t in utf8(batch.column("text"))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], names=["doc_id", "fp"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(scan, schema)


@functools.cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the 23-bit words' halves packed together, and the coset leader of each remainder."""
    v = np.arange(1 << 23, dtype=np.uint32)
    r = v.copy()
    for bit in range(22, 10, -1):
        r ^= np.where(r >> np.uint32(bit) & np.uint32(1), np.uint32(GENERATOR << (bit - 11)), np.uint32(0))
    weight = np.bitwise_count(v)
    light = v[weight <= 3]
    leader = np.zeros(1 << 11, dtype=np.uint32)
    leader[r[light]] = light
    return r.astype(np.uint16), leader


def fuzzy_keys(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs: codeword indices of each 23-bit segment and of its 23 one-bit neighbours, without repeats."""
    remainder, leader = _golay()
    flips = np.concatenate([[0], 1 << np.arange(23)]).astype(np.uint32)
    near = segment.astype(np.uint32)[:, None] ^ flips
    keys = np.sort((near ^ leader[remainder[near]]) >> np.uint32(11), axis=1)
    new = np.ones(keys.shape, dtype=bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return np.nonzero(new)[0], keys[new]


def bucket_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket key) pairs of fingerprints given as uint64."""
    parts = [(fp >> np.uint64(at)) & np.uint64((1 << n) - 1) for at, n in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        row, fuzzy = fuzzy_keys(parts[(i + 1) % 3])
        rows.append(row)
        keys.append((np.uint64(i) << np.uint64(40)) | (parts[i][row] << np.uint64(12)) | fuzzy.astype(np.uint64))
    return np.concatenate(rows), np.concatenate(keys).view(np.int64)


def stars(fp: np.ndarray, node: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """(node, smallest node) edges that connect the fingerprints linked within one bucket."""
    label = node.copy()
    while True:
        new = label.copy()
        for at in range(0, len(fp), 256):
            close = np.bitwise_count(fp[at : at + 256, None] ^ fp[None, :]) <= bits
            new[at : at + 256] = np.where(close, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (new == label).all():
            break
        label = new
    return [(a, b) for a, b in zip(node.tolist(), label.tolist(), strict=True) if a != b]


def _keyed(nodes: DataFrame) -> DataFrame:
    def expand(batches):
        for batch in batches:
            fp, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "node"))
            for at in range(0, len(fp), 8192):
                row, key = bucket_keys(fp[at : at + 8192].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[at + row]), pa.array(node[at + row])], names=["key", "fp", "node"])

    return nodes.mapInArrow(expand, "key bigint, fp bigint, node bigint")


def links(nodes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Edges (a, b) that connect nodes (distinct fp, node) whose fingerprints differ in 2 bits or fewer."""
    keyed = _keyed(nodes)
    shared = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "sim-shared")
    met = keyed.join(broadcast_if_small(shared), "key")

    def verify(batches):
        held: list[tuple[np.ndarray, ...]] = []

        def settle(rows, final):
            key, fp, node = (np.concatenate(x) for x in zip(*rows, strict=True))
            cut = np.flatnonzero(np.diff(key)) + 1
            ends = [*cut.tolist(), *([len(key)] if final else [])]
            out, at = [], 0
            for to in ends:
                out += stars(fp[at:to], node[at:to], 2)
                at = to
            a, b = zip(*set(out), strict=True) if out else ((), ())
            batch = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            return batch, [] if final else [(key[at:], fp[at:], node[at:])]

        for batch in batches:
            held.append((batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64), batch.column("node").to_numpy()))
            done, held = settle(held, False)
            yield done
        if held:
            yield settle(held, True)[0]

    normal = met.filter(F.col("n") <= limit).select("key", "fp", "node").repartition("key").sortWithinPartitions("key").mapInArrow(verify, "a bigint, b bigint")
    large = met.filter(F.col("n") > limit).select("fp", "node").distinct()
    balls = large.select("node", F.explode(F.expr("transform(sequence(0, 64), i -> if(i = 64, fp, fp ^ shiftleft(1L, i)))")).alias("ball"))
    sharers = balls.groupBy("ball").agg(F.collect_set("node").alias("all")).filter(F.size("all") > 1)
    rest = sharers.select(F.explode("all").alias("a"), F.array_min("all").alias("b")).filter("a <> b").distinct()
    return normal.unionByName(rest)


def near_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, fp, component_id of each row."""
    fps = materialize(fingerprints(docs), "sim-fp")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "sim-nodes")
    roots = components(links(nodes.select("fp", F.col("fp").alias("node")), limit)).withColumnRenamed("node", "fp")
    linked = materialize(nodes.join(broadcast_if_small(roots), "fp"), "sim-linked")
    named = materialize(linked.groupBy("root").agg(F.min("least").alias("component_id")), "sim-components")
    named = materialize(linked.join(broadcast_if_small(named), "root").select("fp", "component_id", F.lit(True).alias("linked")), "sim-named")
    ids = nodes.join(broadcast_if_small(named), "fp", "left").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    return fps.join(materialize(ids, "sim-roots"), "fp")


def report(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
