"""Exact top-k inner-product search by no-random-access aggregation.

Components become floor(256 x). Per shard of candidates each dimension is one sorted list, read from
the end that favours the query's sign. Reading goes on in growing depths; what has been read of a
candidate gives a lower bound (unread components at the list's worst end) and an upper bound (unread
components at the list's current position). When few candidates can still reach the k-th best lower
bound, reading stops and the survivors' scores are resolved; ties survive, so the result is exact.
The bounds of TOGETHER queries are advanced at a time as matrix products, each depth adding what is
newly read; the k-th best so far carries over from shard to shard within a task. Queries travel in
blocks of bounded size, of which the driver and a task hold one at a time.

Defined cases: vectors that are null, or hold null or non-finite components, and rows with a null id
take no part; vectors of different lengths are compared as if padded by zeros; every row is a row of its
own: a query is no candidate of itself, but rows that repeat its id, or its id and vector, are, and
each of several query rows of one id has its ranks; with fewer than k candidates all are returned;
scores beyond the range of long saturate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

BLOCK = 4096
SHARD = 2048
#: Queries whose bounds are advanced at a time: with SHARD candidates, matrices of 8 MB.
TOGETHER = 512
_EXACT = 2.0**52


def quantize(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, vec (array of floor(scale * x)) and row, a number of its own, of the rows that take part; to be written before it is read twice."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(~bad)
    return kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale).cast("double")).alias("vec"), F.monotonically_increasing_id().alias("row"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width))
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    for n in np.unique(np.diff(offsets)):
        rows = np.flatnonzero(np.diff(offsets) == n)
        out[rows, :n] = values[offsets[rows][:, None] + np.arange(n)]
    return out


def nra(x: np.ndarray, rows: np.ndarray, q: np.ndarray, q_rows: np.ndarray, k: int, floor: np.ndarray, few: float = 0.02):
    """The k best of this shard for each query, as (query index, candidate index, score), and how deep the lists were read.

    x: candidates (ids ascending); rows, q_rows: the numbers of the rows, as a query is no candidate of its own; floor: scores below which a query's candidates cannot qualify. What is
    read of the lists at a depth is added to what was read before.
    """
    m, width = x.shape
    own = rows[:, None] == q_rows[None, :]
    order = np.argsort(-x, axis=0, kind="stable")
    ranked = np.take_along_axis(x, order, 0)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(m)[:, None], 0)
    up, down = np.maximum(q, 0).T, np.minimum(q, 0).T  # lists read from the top, and from the bottom
    top, bottom = ranked[0][:, None] * down, ranked[-1][:, None] * up  # the worst that an unread component can add
    seen, before, depth = np.zeros((m, len(q))), 0, min(m, max(k, m // 16))
    while True:
        high, low = rank < depth, rank >= m - depth
        seen += (x * (high & (rank >= before))) @ up
        seen += (x * (low & (rank < m - before))) @ down
        high, low = (~high).astype(float), (~low).astype(float)
        if m > k:
            least = seen + high @ bottom + low @ top
            least[own] = -np.inf
            floor = np.maximum(floor, np.partition(least, m - k, axis=0)[m - k])
            del least
        most = seen + high @ (ranked[depth - 1][:, None] * up) + low @ (ranked[m - depth][:, None] * down)
        open_ = (most >= floor) & ~own
        if depth == m or open_.mean() <= few:
            break
        before, depth = depth, min(m, 2 * depth)
    at, who = np.nonzero(open_)
    scores = np.concatenate([np.einsum("ij,ij->i", x[at[i : i + 65536]], q[who[i : i + 65536]]) for i in range(0, len(at), 65536)] or [np.zeros(0)])
    best = np.lexsort((at, -scores, who))
    who, at, scores = who[best], at[best], scores[best]
    place = np.arange(len(who)) - np.searchsorted(who, who)
    return who[place < k], at[place < k], scores[place < k], depth


def _exact(x: np.ndarray, rows: np.ndarray, q: np.ndarray, q_rows: np.ndarray, k: int):
    """For components so large that doubles would round: whole-number scores, saturated to long."""
    out: list[tuple[int, int, int]] = []
    whole = [[int(v) for v in r] for r in x]
    for j, query in enumerate(q):
        w = [int(v) for v in query]
        scored = sorted(((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(r, w, strict=True)))), i) for i, r in enumerate(whole) if rows[i] != q_rows[j]))[:k]
        out += [(j, i, -s) for s, i in scored]
    who, at, s = zip(*out, strict=True) if out else ((), (), ())
    return np.array(who, dtype=np.int64), np.array(at, dtype=np.int64), np.array(s, dtype=object)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of vectors for each row of queries (both from quantize)."""
    spark = vectors.sparkSession
    found = None
    total = queries.count()
    parts = max(1, -(-total // block))
    for p in range(parts):
        mine = queries if parts == 1 else queries.filter(F.pmod(F.xxhash64("row"), F.lit(parts)) == p)
        held = sorted((r["vec_id"], r["row"], list(r["vec"])) for r in mine.collect())
        sent = spark.sparkContext.broadcast((np.array([h[0] for h in held], dtype=np.int64), np.array([h[1] for h in held], dtype=np.int64), [h[2] for h in held]))

        def scan(batches, sent=sent):
            q_ids, q_rows, lists = sent.value
            if not len(q_ids):
                return
            best: list[list[tuple]] = [[] for _ in q_ids]
            floor = np.full(len(q_ids), -np.inf)

            def settle(ids, numbers, vecs):
                width = max([1, *map(len, lists), *np.diff(vecs.offsets.to_numpy()).tolist()])
                order = np.lexsort((numbers, ids))
                x, q = _matrix(vecs, width)[order], np.zeros((len(lists), width))
                for i, v in enumerate(lists):
                    q[i, : len(v)] = v
                ids, numbers = ids[order], numbers[order]
                sure = width * max(1.0, np.abs(x).max(initial=0)) * max(1.0, np.abs(q).max(initial=0)) < _EXACT
                for lo in range(0, len(q), TOGETHER):
                    mine = slice(lo, lo + TOGETHER)
                    found = nra(x, numbers, q[mine], q_rows[mine], k, floor[mine])[:3] if sure else _exact(x, numbers, q[mine], q_rows[mine], k)
                    for who, at, score in zip(*found, strict=True):
                        best[lo + who].append((-int(score), int(ids[at])))
                for i, b in enumerate(best):
                    if len(b) > k:
                        best[i] = b = sorted(b)[:k]
                    if len(b) == k:
                        floor[i] = max(floor[i], -max(b)[0])

            ids, numbers, vecs, held_rows = [], [], [], 0
            for batch in batches:
                for at in range(0, batch.num_rows, shard):
                    part = batch.slice(at, shard)
                    ids.append(part.column("vec_id").to_numpy(zero_copy_only=False))
                    numbers.append(part.column("row").to_numpy(zero_copy_only=False))
                    vecs.append(pa.array(part.column("vec").to_pylist(), pa.list_(pa.float64())))
                    held_rows += part.num_rows
                    if held_rows >= shard:
                        settle(np.concatenate(ids), np.concatenate(numbers), pa.concat_arrays(vecs))
                        ids, numbers, vecs, held_rows = [], [], [], 0
            if held_rows:
                settle(np.concatenate(ids), np.concatenate(numbers), pa.concat_arrays(vecs))
            rows = [(i, int(q_ids[i]), v, -s) for i, b in enumerate(best) for s, v in sorted(b)[:k]]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["q", "query_id", "vec_id", "score"])

        by = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        part = vectors.mapInArrow(scan, "q int, query_id bigint, vec_id bigint, score bigint").withColumn("rank", F.row_number().over(by))
        part = part.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if parts > 1:
            part = materialize(part, "topk-block")
            sent.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """Each row whose vec_id is divisible by ``every`` against all other rows."""
    vectors = materialize(quantize(embeddings), "topk-vectors")
    return search(vectors, vectors.filter(F.pmod("vec_id", F.lit(every)) == 0), k)


ORACLE = """
WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS n, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, q.n, c.vec_id, CAST(list_sum([q.e[i] * c.e[i] for i in range(1, len(q.e) + 1)]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
