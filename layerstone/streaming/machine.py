"""User-defined state machines over update streams, in batch and as a stream.

A machine is a function step(state, update) -> (state, emitted) on plain dicts; state starts as None,
emitted is a list of dicts. Updates of one machine are taken in (registered_ns, tie-breaker) order:
over the whole input in batch, within a micro-batch in a stream (across micro-batches, order is
arrival order). Both give a row an emitted update and a row a machine's state, told apart by kind.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

Step = Callable[[dict | None, dict], tuple[dict, list[dict]]]
STATE, EMITTED = "state", "emitted"
OUT = "machine long, kind string, registered_ns long, body string"
COLUMNS = ["machine", "kind", "registered_ns", "body"]
ERROR = 5
#: Updates, and bytes of them, that a stream's worker holds while it packs them by machine.
HELD_ROWS, HELD_BYTES = 100_000, 16 << 20


def counting(state: dict | None, update: dict) -> tuple[dict, list[dict]]:
    """The sample machine: how many steps, the last type and when it came; it emits an alert at every error."""
    steps = (state or {"steps": 0})["steps"] + 1
    emitted = [{"alert": "error", "step": steps}] if update["type"] == ERROR else []
    return {"steps": steps, "last_type": update["type"], "last_ns": update["registered_ns"]}, emitted


def _dump(value: dict | None) -> str:
    return json.dumps(value, sort_keys=True)


def run(updates: DataFrame, step: Step, tie: str = "event_id") -> DataFrame:
    """machine, kind, registered_ns, body (JSON): every emitted update, and each machine's state after all updates.

    Sorted partitions are folded row by row, so a machine with very many updates needs no more memory
    than one with few.
    """

    def fold_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, state, at, begun = None, None, None, False
        for part in parts:
            done = []
            for update in part.to_dict("records"):
                if not begun or update["machine"] != machine:
                    if begun:
                        done.append((machine, STATE, at, _dump(state)))
                    machine, state, begun = update["machine"], None, True
                state, emitted = step(state, update)
                at = update["registered_ns"]
                done += [(machine, EMITTED, at, _dump(e)) for e in emitted]
            yield pd.DataFrame(done, columns=COLUMNS)
        if begun:
            yield pd.DataFrame([(machine, STATE, at, _dump(state))], columns=COLUMNS)

    return updates.repartition("machine").sortWithinPartitions("machine", "registered_ns", tie).mapInPandas(fold_rows, OUT)


def fold(updates: DataFrame, step: Step, tie: str = "event_id") -> DataFrame:
    """machine, state (JSON) after all updates."""
    return run(updates, step, tie).filter(F.col("kind") == STATE).select("machine", F.col("body").alias("state"))


def emitted(updates: DataFrame, step: Step, tie: str = "event_id") -> DataFrame:
    """machine, registered_ns, emitted (JSON): what the steps emitted, and at which update."""
    return run(updates, step, tie).filter(F.col("kind") == EMITTED).select("machine", "registered_ns", F.col("body").alias("emitted"))


def fold_counting(updates: DataFrame, tie: str = "event_id") -> DataFrame:
    """The sample machine's end states without leaving the JVM: machine, steps, last_type, last_ns. Time and tie are one number, so all is aggregated by hash."""
    whole = "decimal(38,0)"
    at = F.col("registered_ns").cast("decimal(19,0)") * F.lit(str(1 << 63)).cast("decimal(19,0)") + F.col(tie).cast("decimal(19,0)")
    return updates.groupBy("machine").agg(F.count("*").alias("steps"), F.max_by("type", at.cast(whole)).alias("last_type"), F.max("registered_ns").alias("last_ns"))


def _packed(updates: DataFrame) -> DataFrame:
    """machine, updates: the updates of one machine that lie together, as one binary value. Spark hands a stateful processor rows one by one, at a cost that is many times a step's."""

    def groups(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).sort_by("machine")
        rows = zip(table.column("machine").to_pylist(), zip(*(c.to_pylist() for c in table.columns)))
        keys, packs = [], []
        for key, group in groupby(rows, key=lambda row: row[0]):
            keys.append(key)
            packs.append(pickle.dumps([row for _, row in group], pickle.HIGHEST_PROTOCOL))
        return pa.RecordBatch.from_arrays([pa.array(keys, table.schema.field("machine").type), pa.array(packs, pa.binary())], names=["machine", "updates"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0
        for part in parts:
            held.append(part)
            rows, size = rows + part.num_rows, size + part.nbytes
            if rows >= HELD_ROWS or size >= HELD_BYTES:
                yield groups(held)
                held, rows, size = [], 0, 0
        if rows:
            yield groups(held)

    return updates.repartition("machine").mapInArrow(run, f"machine {updates.schema['machine'].dataType.simpleString()}, updates binary")


class Machine(StatefulProcessor):
    """Runs step over each machine's updates; emits what the steps emit and its state after every micro-batch. A restart restores it."""

    def __init__(self, step: Step, names: list[str], tie: str):
        self.step, self.names = step, names
        self.order = [names.index(c) for c in ("registered_ns", tie)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state, at = json.loads(self.state.get()[0]) if self.state.exists() else None, None
        updates = [update for row in rows for update in pickle.loads(row["updates"])]
        updates.sort(key=lambda u: [(u[i] is None, 0 if u[i] is None else u[i]) for i in self.order])  # nulls last
        for update in (dict(zip(self.names, u)) for u in updates):
            state, sent = self.step(state, update)
            at = update["registered_ns"]
            for e in sent:
                yield Row(machine=key[0], kind=EMITTED, registered_ns=at, body=_dump(e))
        held = _dump(state)
        self.state.update((held,))
        yield Row(machine=key[0], kind=STATE, registered_ns=at, body=held)

    def close(self) -> None:
        pass


def run_stream(updates: DataFrame, step: Step, tie: str = "event_id") -> DataFrame:
    """The stream of emitted updates and states (machine, kind, registered_ns, body) of a stream of updates."""
    return _packed(updates).groupBy("machine").transformWithState(Machine(step, updates.columns, tie), OUT, "Update", "none")


def snapshot(spark: SparkSession, checkpoint: str) -> DataFrame:
    """machine, state (JSON) as a stopped or running stream's checkpoint holds them."""
    held = spark.read.format("statestore").option("stateVarName", "state").load(checkpoint)
    return held.select(F.col("key.machine").alias("machine"), F.col("value.state").alias("state"))
