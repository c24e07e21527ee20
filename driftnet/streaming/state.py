"""Stateful stream operators: the bounded frontier and piece assembly."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftnet.operators.nodes import Frontier

QUEUE_SCHEMA = "family int, shard int, version long, position int, address string, seq long"
RECORD_SCHEMA = "key string, data binary, pieces int"


def frontier_queues(pushes: DataFrame, capacity: int) -> DataFrame:
    """The queue of each shard after each micro-batch, with a version that grows.
    The state of a shard is at most ``capacity`` addresses. Order within a batch
    is that of seq; pushes has family, shard, address, seq."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, version = state.get if state.exists else ("[]", 0)
        queue = Frontier(capacity)
        for address, seq in json.loads(held):
            queue.push(address, seq)
        rows = pd.concat(list(batches)).sort_values(["seq", "address"])
        for address, seq in zip(rows["address"], rows["seq"]):
            queue.push(address, int(seq))
        state.update((json.dumps(list(queue.held.items())), version + 1))
        out = [(key[0], key[1], version + 1, i, a, s) for i, (a, s) in enumerate(queue.held.items())]
        yield pd.DataFrame(out, columns=["family", "shard", "version", "position", "address", "seq"])

    live = pushes.where(F.col("address").isNotNull()).select(F.col("family").cast("int"), F.col("shard").cast("int"), "address", "seq")
    return live.groupBy("family", "shard").applyInPandasWithState(step, QUEUE_SCHEMA, "held string, version long", "update", GroupStateTimeout.NoTimeout)


def assembled_pieces(pieces: DataFrame, timeout_ms: int | None) -> DataFrame:
    """Each key whose pieces 0..total-1 are all there, once: later copies of a
    piece replace earlier ones until then. A key that is not complete within
    ``timeout_ms`` of its last piece is given up. pieces has key, piece, total, data.
    A replay that ends with its source takes no timeout (None): with one, a query
    goes on for as long as a timeout may fire."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        got = {int(k): v for k, v in json.loads(state.get[0]).items()} if state.exists else {}
        total = None
        for pdf in batches:
            for piece, n, data in zip(pdf["piece"], pdf["total"], pdf["data"]):
                got[int(piece)], total = bytes(data).hex(), int(n)
        if total is not None and all(i in got for i in range(total)):
            state.remove()
            data = b"".join(bytes.fromhex(got[i]) for i in sorted(got))
            yield pd.DataFrame([(key[0], data, len(got))], columns=["key", "data", "pieces"])
        else:
            state.update((json.dumps(got),))
            if timeout_ms is not None:
                state.setTimeoutDuration(timeout_ms)

    timeout = GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return pieces.groupBy("key").applyInPandasWithState(step, RECORD_SCHEMA, "got string", "append", timeout)
