"""Change logs of items: compaction of a queue, the net state, and both as a stream.

Events are rows (seq, type, id_a, id_b, op) with op ADD, UPDATE or REMOVE. In a queue, a new event meets the queued ones of
its key: it replaces one of its own operation, an ADD and a REMOVE cancel each other, and a REMOVE drops an UPDATE."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["type", "id_a", "id_b"]
ADD, UPDATE, REMOVE = "ADD", "UPDATE", "REMOVE"


def enqueue(queue: list[tuple[int, str]], seq: int, op: str) -> list[tuple[int, str]]:
    """A key's queue (at most a few events) after one more event."""
    out, put = [], True
    for at, old in queue:
        if old == op:
            continue
        if {old, op} == {ADD, REMOVE}:
            put = False
        elif op == REMOVE and old == UPDATE:
            continue
        else:
            out.append((at, old))
    return [*out, (seq, op)] if put else out


def compact(log: DataFrame) -> DataFrame:
    """The queue that is left of a whole log, without walking it.

    ADD and REMOVE of a key move between three states (one of them queued, or neither), one step each, and stay at the ends. So
    the last of two equal ones in a row (or the first of all) settles the state, and from there on they alternate: if the
    very last is the same operation it is queued, otherwise nothing is. An UPDATE is queued if it comes behind the last
    REMOVE; of several the last."""
    order = Window.partitionBy(*KEY).orderBy("seq")
    moves = log.filter(F.col("op") != UPDATE).select(*KEY, "seq", "op", F.lag("op").over(order).alias("before"))
    settles = F.col("before").isNull() | (F.col("before") == F.col("op"))
    ends = moves.groupBy(*KEY).agg(F.max(F.struct("seq", "op")).alias("last"), F.max(F.when(settles, F.struct("seq", "op"))).alias("settled"))
    queued = ends.filter(F.col("last.op") == F.col("settled.op")).select(*KEY, "last.seq", "last.op")
    of = lambda op: F.max(F.when(F.col("op") == op, F.col("seq")))
    late = log.groupBy(*KEY).agg(of(UPDATE).alias("seq"), of(REMOVE).alias("gone")).filter("seq is not null and (gone is null or seq > gone)")
    return queued.unionByName(late.select(*KEY, "seq", F.lit(UPDATE).alias("op")))


def net_state(log: DataFrame) -> DataFrame:
    """What exists after the log: keys whose last event is no REMOVE, with that event (a grouped maximum)."""
    last = log.groupBy(*KEY).agg(F.max(F.struct("seq", "op")).alias("e"))
    return last.select(*KEY, "e.*").filter(F.col("op") != REMOVE)


def compact_stream(log: DataFrame) -> DataFrame:
    """As a stream, with a key's queue as its state: after each micro-batch, the queues of the keys that it touched, so
    that a sink that keeps the last row of a key holds what compact() gives for all so far."""

    def step(key, batches, state):
        queue = [tuple(x) for x in zip(*state.get, strict=True)] if state.exists else []
        rows = pd.concat(list(batches)).sort_values("seq")
        for seq, op in zip(rows["seq"].tolist(), rows["op"].tolist(), strict=True):
            queue = enqueue(queue, seq, op)
        state.update(([s for s, _ in queue], [o for _, o in queue]))
        yield pd.DataFrame({**{k: [v] for k, v in zip(KEY, key, strict=True)}, "seqs": [[s for s, _ in queue]], "ops": [[o for _, o in queue]]})

    return log.groupBy(*KEY).applyInPandasWithState(step, "type string, id_a string, id_b string, seqs array<long>, ops array<string>", "seqs array<long>, ops array<string>", "update", "NoTimeout")


def apply_events(state: DataFrame, log: DataFrame) -> DataFrame:
    """A replica's (type, id_a, id_b, seq) after more events, leniently: adding what is there or removing what is not is fine."""
    before = state.select(*KEY, "seq", F.lit(ADD).alias("op"))
    return net_state(before.unionByName(log.select(*KEY, "seq", "op"))).drop("op")
