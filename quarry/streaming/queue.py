"""A message queue's state machine: batch forms as joins and aggregates, the live form as a
stateful stream.

Messages: id, queue, status (CREATED, STARTED, SUCCESS, FAILURE, RETRY, BLOCKED, CONTINUE),
failures, enqueued_time, start_time, blocked_by (array of ids)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONSUMABLE, COMPLETE = ["CREATED", "RETRY", "CONTINUE"], ["SUCCESS", "FAILURE"]
MOST_FAILURES, PAGE, LEASE = 3, 11, 60


def is_consumable(status: Column) -> Column:
    return status.isin(CONSUMABLE)


def is_complete(status: Column) -> Column:
    return status.isin(COMPLETE)


def enqueue(messages: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """new (queue, name) as CREATED messages with the queues' next ids, in order of name."""
    from pyspark.sql import Window

    last = messages.groupBy("queue").agg(F.max("id").alias("last"))
    number = F.row_number().over(Window.partitionBy("queue").orderBy("name"))
    return new.join(last, "queue", "left").select((F.coalesce("last", F.lit(0)) + number).alias("id"), "queue", "name", F.lit("CREATED").alias("status"), F.lit(now).cast("long").alias("enqueued_time"))


def low_water(messages: DataFrame) -> DataFrame:
    """(queue, low): the first id that isn't complete, or one after the last."""
    open_ = F.min(F.when(~is_complete(F.col("status")), F.col("id")))
    return messages.groupBy("queue").agg(F.coalesce(open_, F.max("id") + 1).alias("low"))


def consume(messages: DataFrame, limit: int = PAGE) -> DataFrame:
    """The first consumable messages by id."""
    return messages.where(is_consumable(F.col("status"))).orderBy("id").limit(limit)


def page(messages: DataFrame, window: int, back: int = 20, size: int = 25) -> DataFrame:
    """Messages from the window on, and `back` before, newest first, open and complete ones told
    apart."""
    seen = messages.where(F.col("id") >= window - back).orderBy("id").limit(size)
    return seen.withColumn("open", ~is_complete(F.col("status"))).orderBy(F.desc("id"))


def sweep(messages: DataFrame, now: int, lease: int = LEASE) -> DataFrame:
    """One expiry sweep: (id, status, failures). A started message whose lease has run out fails
    once more and is tried again, or has failed for good at three; a blocked one goes on when all
    blockers are complete, and fails if one is unknown."""
    blockers = messages.where("status = 'BLOCKED'").select("id", F.explode("blocked_by").alias("blocker"))
    states = messages.select(F.col("id").alias("blocker"), F.col("status").alias("blocker_status"))
    judged = blockers.join(states, "blocker", "left").groupBy("id").agg(F.bool_or(F.col("blocker_status").isNull()).alias("unknown"), F.bool_and(F.coalesce(is_complete(F.col("blocker_status")), F.lit(False))).alias("ready"))
    late = (F.col("status") == "STARTED") & (F.col("start_time") + lease < now)
    fails = F.col("failures") + late.cast("int")
    status = F.when(late & (fails >= MOST_FAILURES), "FAILURE").when(late, "RETRY").when(F.col("unknown"), "FAILURE").when(F.col("ready"), "CONTINUE").otherwise(F.col("status"))
    return messages.join(judged, "id", "left").select("id", status.alias("status"), fails.alias("failures"))


#: What an action makes of a status.
STEPS = {("CREATED", "start"): "STARTED", ("RETRY", "start"): "STARTED", ("CONTINUE", "start"): "STARTED", ("STARTED", "succeed"): "SUCCESS", ("STARTED", "fail"): "FAILURE", ("STARTED", "block"): "BLOCKED", ("BLOCKED", "continue"): "CONTINUE", ("STARTED", "retry"): "RETRY"}


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
    status, failures = state.get if state.exists else ("CREATED", 0)
    if state.hasTimedOut:
        failures += 1
        status = "FAILURE" if failures >= MOST_FAILURES else "RETRY"
    else:
        for pdf in batches:
            for action in pdf.sort_values(["at"])["action"]:
                after = STEPS.get((status, action))
                if after:
                    failures += after == "RETRY"
                    status = "FAILURE" if after == "RETRY" and failures >= MOST_FAILURES else after
    state.update((status, failures))
    if status == "STARTED":
        state.setTimeoutDuration(LEASE * 1000)
    yield pd.DataFrame({"id": [key[0]], "status": [status], "failures": [failures]})


def message_states(actions: DataFrame) -> DataFrame:
    """The live form: a stream of (id, action, at) to each message's (id, status, failures). The
    lease is a processing-time timer in the state store; blockers, which are other messages, are
    judged by `sweep` in foreachBatch."""
    return actions.groupBy("id").applyInPandasWithState(_step, "id long, status string, failures int", "status string, failures int", "update", "ProcessingTimeTimeout")


def deliver(stream: DataFrame, path: str, checkpoint: str, seconds: int = 5, once: bool = False) -> Any:
    """Writes consumable messages on as they come, at most each `seconds`; once: what is there."""
    out = stream.where(is_consumable(F.col("status"))).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=f"{seconds} seconds")).start()
