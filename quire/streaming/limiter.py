"""Requests a client in the last hour: at most ten that were let in; denied ones don't count."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3600.0


def admit(times: list[float], recent: list[float], most: int, span: float) -> tuple[list[bool], list[float]]:
    out = []
    for t in times:
        recent = [x for x in recent if t - x < span]
        out.append(len(recent) < most)
        if out[-1]:
            recent.append(t)
    return out, recent


def limited(events: DataFrame, *, client: str = "user_id", ts: str = "ts", order: str = "event_id", most: int = 10, span: float = HOUR) -> DataFrame:
    """Batch form: (client, order, ts, allowed). What was denied before decides, so a client's events are folded in order.

    A pause of ``span`` ends all that is remembered, so a client's events are cut at pauses first, and
    each piece is folded by itself: a row is as long as the longest stretch without one.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    by = Window.partitionBy(client).orderBy(at, order)
    pause = F.coalesce((at - F.lag(at).over(by) >= span).cast("int"), F.lit(0))
    pieces = events.withColumn("_pause", pause).withColumn("_piece", F.sum("_pause").over(by))
    rows = pieces.groupBy(client, "_piece").agg(F.array_sort(F.collect_list(F.struct(at.alias("t"), F.col(order).alias("o"), F.col(ts).alias("ts")))).alias("all"))

    def run(batches):
        for b in batches:
            b["allowed"] = [admit([x["t"] for x in every], [], most, span)[0] for every in b["all"]]
            yield b[[client, "allowed"]].assign(all=b["all"])[[client, "all", "allowed"]]

    kind = rows.schema["all"].dataType.simpleString()
    done = rows.drop("_piece").mapInPandas(run, f"{client} {rows.schema[client].dataType.simpleString()}, all {kind}, allowed array<boolean>")
    return done.select(client, F.explode(F.arrays_zip("all", "allowed")).alias("x")).select(client, F.col("x.all.o").alias(order), F.col("x.all.ts").alias(ts), F.col("x.allowed").alias("allowed"))


def requests_last_hour(events: DataFrame, *, client: str = "user_id", ts: str = "ts") -> DataFrame:
    """wn_rate_window: all requests of the last hour, by a range window, itself included."""
    seconds = F.unix_micros(F.col(ts).cast("timestamp"))
    by = Window.partitionBy(client).orderBy(seconds).rangeBetween(-3_599_999_999, 0)
    return events.withColumn("last_hour", F.count("*").over(by))


def limit_stream(events: DataFrame, *, client: str = "user_id", ts: str = "ts", order: str = "event_id", most: int = 10, span: float = HOUR) -> DataFrame:
    """Streaming form: (client, order, ts, allowed). The times of the last hour are each client's state.

    Events are judged by their own times; state ends by the clock, once a client was silent for ``span``,
    so that a replay of old events never forgets too early.
    """
    kind, number = (events.schema[c].dataType.simpleString() for c in (client, order))

    def run(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        frames = [b for b in batches]
        every = pd.concat(frames).sort_values([ts, order])
        allowed, recent = admit([t.timestamp() for t in every[ts]], recent, most, span)
        state.update((recent,))
        state.setTimeoutDuration(int(span * 1000))
        yield every.assign(allowed=allowed)[[client, order, ts, "allowed"]]

    return events.select(client, order, ts).groupBy(client).applyInPandasWithState(run, f"{client} {kind}, {order} {number}, {ts} timestamp, allowed boolean", "recent array<double>", "append", "ProcessingTimeTimeout")
