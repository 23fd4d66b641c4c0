"""Task states with legal transitions, retries and timeouts, as a stateful stream and as a batch.

A task is pending, running, success or failed. An event that the state doesn't allow changes nothing and is counted. A running task that
has no event for longer than ``limit`` has failed by then. Events of a task are taken in the order of time and id.

The batch folds a task's events in pieces of ``PIECE``: a piece is worked out for each state that it can begin in, so pieces need no order
among themselves and a task with very many events isn't gathered as one.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: (state, event): next state. "" is a task that isn't there yet.
STEPS = {("", "create"): "pending", ("pending", "start"): "running", ("running", "succeed"): "success", ("running", "fail"): "failed", ("failed", "retry"): "pending"}
STATES = ("", "pending", "running", "success", "failed")
PIECE = 1000


def _step(a: Column, e: Column) -> Column:
    late = e["late"] & (a["status"] == "running")
    state = F.when(late, "failed").otherwise(a["status"])
    then = F.try_element_at(F.create_map(*(F.lit(x) for (s, v), n in STEPS.items() for x in (f"{s}|{v}", n))), F.concat(state, F.lit("|"), e["event"]))
    return F.struct(
        F.coalesce(then, state).alias("status"), (a["retries"] + F.when(then.isNotNull() & (e["event"] == "retry"), 1).otherwise(0)).alias("retries"),
        (a["illegal"] + F.when(then.isNull(), 1).otherwise(0)).alias("illegal"), (a["timeouts"] + F.when(late, 1).otherwise(0)).alias("timeouts"),
    )


def _begin(status: Column) -> Column:
    zero = F.lit(0)
    return F.struct(status.alias("status"), zero.alias("retries"), zero.alias("illegal"), zero.alias("timeouts"))


def latest(events: DataFrame, limit: float, task: str = "task", ts: str = "ts", id: str = "event_id", event: str = "event") -> DataFrame:
    """(task, status, retries, illegal, timeouts, events, updated_at) of each task."""
    order = Window.partitionBy(task).orderBy(ts, id)
    seen = events.where(F.col(task).isNotNull()).select(task, ts, id, F.coalesce(event, F.lit("?")).alias("event"), F.row_number().over(order).alias("n"), F.lag(ts).over(order).alias("before"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    late = F.coalesce(micros(ts) - micros("before") > F.lit(int(limit * 1e6)), F.lit(False))
    seen = seen.select(task, ts, "n", F.floor((F.col("n") - 1) / PIECE).alias("piece"), F.struct("n", "event", late.alias("late")).alias("e"))
    pieces = seen.groupBy(task, "piece").agg(F.sort_array(F.collect_list("e")).alias("es"), F.count("*").alias("events"), F.max(ts).alias("updated_at"))
    ends = F.create_map(*(x for s in STATES for x in (F.lit(s), F.aggregate("es", _begin(F.lit(s)), _step))))
    pieces = pieces.select(task, "piece", "events", "updated_at", ends.alias("ends"))
    every = pieces.groupBy(task).agg(F.sort_array(F.collect_list(F.struct("piece", F.map_entries("ends").alias("ends")))).alias("ps"), F.sum("events").alias("events"), F.max("updated_at").alias("updated_at"))

    def join(a: Column, p: Column) -> Column:
        b = F.filter(p["ends"], lambda x: x["key"] == a["status"])[0]["value"]
        return F.struct(b["status"].alias("status"), *((a[c] + b[c]).alias(c) for c in ("retries", "illegal", "timeouts")))

    out = every.withColumn("s", F.aggregate("ps", _begin(F.lit("")), join))
    return out.select(task, "s.status", *(F.col(f"s.{c}").cast("long").alias(c) for c in ("retries", "illegal", "timeouts")), "events", "updated_at")


class Tasks(StatefulProcessor):
    """Keeps a task's state; gives out its row after each batch with events of it, and when its time has run out."""

    def __init__(self, limit: float):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("task", "status string, retries long, illegal long, timeouts long, events long, at timestamp")

    def _row(self, key, values) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *values)], columns=["task", "status", "retries", "illegal", "timeouts", "events", "updated_at"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, retries, illegal, timeouts, events, at = self.state.get() if self.state.exists() else ("", 0, 0, 0, 0, None)
        for _, r in pd.concat(list(rows)).sort_values(["ts", "event_id"]).iterrows():
            if status == "running" and at is not None and r["ts"] - pd.Timestamp(at) > pd.Timedelta(seconds=self.limit):
                status, timeouts = "failed", timeouts + 1
            then = STEPS.get((status, r["event"]))
            illegal += then is None
            retries += then is not None and r["event"] == "retry"
            status, at, events = then or status, r["ts"], events + 1
        at = pd.Timestamp(at).to_pydatetime()
        self.state.update((status, int(retries), int(illegal), int(timeouts), int(events), at))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if status == "running":
            stamp = at.replace(tzinfo=dt.timezone.utc) if at.tzinfo is None else at
            self.handle.registerTimer(int(stamp.timestamp() * 1000 + self.limit * 1000) + 1)
        yield self._row(key, (status, retries, illegal, timeouts, events, at))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, retries, illegal, timeouts, events, at = self.state.get()
        if status == "running":
            self.state.update(("failed", retries, illegal, timeouts + 1, events, at))
            yield self._row(key, ("failed", retries, illegal, timeouts + 1, events, at))

    def close(self) -> None:
        pass


def stream(events: DataFrame, limit: float, late: str = "0 seconds") -> DataFrame:
    """The rows of ``latest`` as they change. events: task, ts, event_id, event. Needs the RocksDB state store."""
    seen = events.where("task is not null").withColumn("event", F.coalesce("event", F.lit("?"))).withWatermark("ts", late)
    kind = dict(events.dtypes)["task"]
    schema = f"task {kind}, status string, retries long, illegal long, timeouts long, events long, updated_at timestamp"
    return seen.groupBy("task").transformWithStateInPandas(Tasks(limit), schema, "Update", "EventTime")
