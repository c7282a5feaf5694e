"""Logistic regression over sparse rows by L-BFGS, in one barrier stage.

Each task keeps its part of the rows in files of its own machine and adds up their gradient, chunk by chunk; a
step is one sum over the tasks, not a job. The first task chooses the coefficients and hands them to the others.
The driver gets the result; vectors of the vocabulary's length are all that travels.
"""

from __future__ import annotations

import pickle
import secrets
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .together import adding

#: Steps whose differences L-BFGS keeps; weights that a gradient reads at a time.
MEMORY, CHUNK = 10, 1_000_000


def sparse_rows(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """label, idx, w of docs (blob_id, label), from weights (blob_id, idx, w); a text without terms has empty arrays."""
    held = weights.groupBy("blob_id").agg(F.collect_list(F.struct("idx", "w")).alias("terms"))
    return docs.select("blob_id", "label").join(held, "blob_id", "left").select(F.col("label").cast("double").alias("label"), F.col("terms.idx").alias("idx"), F.col("terms.w").alias("w"))


def packed(labels: np.ndarray, row: np.ndarray, idx: np.ndarray, tf: np.ndarray) -> tuple[list, bytes]:
    """labels and sizes of rows, and their idx and tf (in the order of rows and of idx) in few bytes."""
    sizes = np.bincount(row, minlength=len(labels))
    first = np.append(True, np.diff(row) != 0)[: len(row)]
    step = np.where(first, idx, np.diff(idx, prepend=0))
    least = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))
    data = pickle.dumps((least(step), least(tf)))
    return [labels, sizes], pa.compress(data, "zstd", asbytes=True) + len(data).to_bytes(8, "little")


def unpacked(data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, idx, tf of what packed has made."""
    step, tf = pickle.loads(pa.decompress(data[:-8], int.from_bytes(data[-8:], "little"), "zstd"))
    row, sums = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(step.astype(np.int64))
    first = np.cumsum(sizes) - sizes
    before = np.where(first > 0, sums[np.minimum(first, len(sums)) - 1], 0) if len(sums) else np.zeros(len(sizes), np.int64)
    return row, sums - before[row], tf


class _Blocks:
    """A task's rows in packed blocks (labels, sizes, data), the data in a file of a folder; weigh: the weights of (row, idx, tf, rows)."""

    def __init__(self, batches: Iterator[pa.RecordBatch], folder: str, weigh: Callable) -> None:
        self.path, self.weigh, self.blocks = Path(folder, "blocks"), weigh, []
        with open(self.path, "wb") as f:
            for batch in batches:
                for labels, sizes, data in zip(*(batch.column(c) for c in ("labels", "sizes", "data")), strict=True):
                    self.blocks.append((labels.values.to_numpy(), sizes.values.to_numpy().astype(np.int64), f.write(data.as_buffer())))

    def loss_and_gradient(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        loss, grad = 0.0, np.zeros(len(theta))
        with open(self.path, "rb") as f:
            for label, sizes, n in self.blocks:
                row, idx, tf = unpacked(f.read(n), sizes)
                w = self.weigh(row, idx, tf, len(label))
                z = np.bincount(row, weights=w * theta[idx], minlength=len(label)) + theta[-1]
                loss += float(np.logaddexp(0, z).sum() - (label * z).sum())
                rest = 1 / (1 + np.exp(-z)) - label
                grad[:-1] += np.bincount(idx, weights=w * rest[row], minlength=len(theta) - 1)
                grad[-1] += rest.sum()
        return loss, grad


class _Part:
    """A task's rows (label, idx, w): the weights in two files of a folder, the rest in memory."""

    def __init__(self, batches: Iterator[pa.RecordBatch], folder: str) -> None:
        labels, sizes = [], []
        idx, w = Path(folder, "idx"), Path(folder, "w")
        with open(idx, "wb") as f, open(w, "wb") as g:
            for batch in batches:
                labels.append(batch.column("label").to_numpy(zero_copy_only=False))
                lists, values = batch.column("idx"), batch.column("w")
                sizes.append(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                f.write(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32).tobytes())
                g.write(values.flatten().to_numpy(zero_copy_only=False).astype(float).tobytes())
        self.label = np.concatenate([np.zeros(0), *labels])
        self.ends = np.append(0, np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes])))
        n = int(self.ends[-1])
        self.idx = np.memmap(idx, np.int32, "r", shape=(n,)) if n else np.zeros(0, np.int32)
        self.w = np.memmap(w, float, "r", shape=(n,)) if n else np.zeros(0)

    def loss_and_gradient(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        """The sum of the losses at theta (coefficients, then the intercept), and its gradient."""
        loss, grad, low = 0.0, np.zeros(len(theta)), 0
        while low < len(self.label):
            high = max(low + 1, min(int(np.searchsorted(self.ends, self.ends[low] + CHUNK, side="right")) - 1, low + CHUNK))
            a, b, label = int(self.ends[low]), int(self.ends[high]), self.label[low:high]
            idx, w, row = self.idx[a:b], self.w[a:b], np.repeat(np.arange(high - low), np.diff(self.ends[low : high + 1]))
            z = np.bincount(row, weights=w * theta[idx], minlength=high - low) + theta[-1]
            loss += float(np.logaddexp(0, z).sum() - (label * z).sum())
            rest = 1 / (1 + np.exp(-z)) - label
            grad[:-1] += np.bincount(idx, weights=w * rest[row], minlength=len(theta) - 1)
            grad[-1] += rest.sum()
            low = high
        return loss, grad


def fit(rows: DataFrame, size: int, l2: float = 1.0, tolerance: float = 1e-4, steps: int = 200, workers: int | None = None, weigh: Callable | None = None) -> np.ndarray:
    """Coefficients and, last, the intercept: the least of the sum of the losses + l2 / 2 |coefficients| ^ 2, to a
    gradient of at most ``tolerance``. rows (label, idx, w) are read once, by ``workers`` tasks that run at the same
    time (by default half of the cores). With weigh, rows (labels, sizes, data) are blocks of rows that packed has made, and weigh gives
    their weights: a task keeps and reads them packed."""
    workers, key = workers or max(1, rows.sparkSession.sparkContext.defaultParallelism // 2), secrets.token_bytes(16)
    weight = np.append(np.full(size, l2), 0.0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = BarrierTaskContext.get()
        with tempfile.TemporaryDirectory(prefix="logistic-") as folder:
            part, first = _Blocks(batches, folder, weigh) if weigh else _Part(batches, folder), task.partitionId() == 0
            with adding(task, key) as together:

                def at(x: np.ndarray | None) -> tuple[float, np.ndarray] | None:
                    """Loss and gradient over all tasks at the first task's x; None when it has ended."""
                    go, theta = together([np.array([float(x is not None)]), np.zeros(size + 1) if x is None else x])
                    if not go[0]:
                        return None
                    own, grad = part.loss_and_gradient(theta)
                    loss, grad = together([np.array([own]), grad])
                    return float(loss[0]) + float(weight @ (theta * theta)) / 2, grad + weight * theta

                if first:
                    found = least(at, size, tolerance, steps)
                    at(None)
                    yield pa.RecordBatch.from_pydict({"theta": pa.array(found)})
                else:
                    while at(None):
                        pass

    theta = rows.select(*(("labels", "sizes", "data") if weigh else ("label", "idx", "w"))).repartition(workers).mapInArrow(work, "theta double", barrier=True).toArrow()
    return theta.column("theta").to_numpy()


def least(at: Callable[[np.ndarray], tuple[float, np.ndarray]], size: int, tolerance: float, steps: int) -> np.ndarray:
    """Where a function, which at gives with its gradient, of size + 1 variables is least, by L-BFGS from zero."""
    x = np.zeros(size + 1)
    value, grad = at(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(grad).max() <= tolerance:
            break
        way, kept = -grad, []
        for s, y in reversed(moves):
            a = (s @ way) / (s @ y)
            kept.append(a)
            way = way - a * y
        if moves:
            s, y = moves[-1]
            way = way * ((s @ y) / (y @ y))
        for (s, y), a in zip(moves, reversed(kept), strict=True):
            way = way + s * (a - (y @ way) / (s @ y))
        slope, step = float(grad @ way), 1.0 if moves else min(1.0, 1 / np.abs(grad).sum())
        while True:
            new = x + step * way
            new_value, new_grad = at(new)
            if new_value <= value + 1e-4 * step * slope or step < 1e-12:
                break
            step /= 2
        s, y = new - x, new_grad - grad
        if s @ y > 1e-12:
            moves = [*moves[-(MEMORY - 1) :], (s, y)]
        if new_value >= value and step < 1e-12:
            break
        x, value, grad = new, new_value, new_grad
    return x
