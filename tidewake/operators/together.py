"""Sums over the tasks of a barrier stage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from multiprocessing.connection import Client, Listener

import numpy as np
from pyspark import BarrierTaskContext


@contextmanager
def adding(task: BarrierTaskContext, key: bytes) -> Iterator[Callable[[list[np.ndarray]], list[np.ndarray]]]:
    """A function that adds up a list of arrays over the tasks of a barrier stage, for all of them.

    Parts go to the first task over its own connections, which the stage agrees on once; sums
    are in the order of the tasks. If a task is lost, the others' connections end, and Spark starts the stage anew.
    """
    rank, hosts = task.partitionId(), [x.address.rpartition(":")[0] for x in task.getTaskInfos()]
    server = Listener(("0.0.0.0", 0), backlog=len(hosts), authkey=key) if rank == 0 else None
    port = int(task.allGather(str(server.address[1]) if server else "")[0])
    if server:
        met = [server.accept() for _ in hosts[1:]]
        links = [c for _, c in sorted(((int(c.recv_bytes()), c) for c in met), key=lambda x: x[0])]
    else:
        links = [Client((hosts[0], port), authkey=key)]
        links[0].send_bytes(str(rank).encode())

    def together(parts: list[np.ndarray]) -> list[np.ndarray]:
        total = np.concatenate([p.ravel() for p in parts]).astype(float)
        if server:
            for link in links:
                total = total + np.frombuffer(link.recv_bytes())
        else:
            links[0].send_bytes(total.tobytes())
            total = np.frombuffer(links[0].recv_bytes())
        for link in links if server else ():
            link.send_bytes(total.tobytes())
        return [z.reshape(p.shape) for z, p in zip(np.split(total, np.cumsum([p.size for p in parts])[:-1]), parts, strict=True)]

    try:
        yield together
    finally:
        for x in [*links, *([server] if server else [])]:
            x.close()
