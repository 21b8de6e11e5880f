"""GPS fixes: smoothing and status, as a batch fold and as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..constants import GOOD_ACCURACY_M, HEADING_SMOOTHING, POOR_ACCURACY_M, POSITION_SMOOTHING
from ..functions import classify


def _toward(now: float | None, target: float | None, share: float) -> float | None:
    return None if now is None or target is None else now + (target - now) * share


def _turned(now: float | None, target: float | None) -> float | None:
    if now is None or target is None:
        return None
    d = target - now
    d = d - 360 if d > 180 else d + 360 if d < -180 else d
    return (now + d * HEADING_SMOOTHING) % 360


def smoothed(fixes: DataFrame, ticks_per_fix: int = 1) -> DataFrame:
    """vehicle, lat, lon, heading after all fixes, in order of ts and event_id.

    The first fix sets the state; every fix is a target that the state then
    approaches ``ticks_per_fix`` times.  A null value stays null from there on;
    fixes without a vehicle are one vehicle.  One pass over sorted partitions,
    which Spark can spill: a vehicle's history is never held as a whole.
    """
    out_type = f"vehicle {fixes.schema['vehicle'].dataType.simpleString()}, lat double, lon double, heading double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vehicle, now = None, None
        for batch in batches:
            columns, done = [c.to_pylist() for c in batch.columns], []
            for who, *fix in zip(*columns, strict=True):
                if now is None or who != vehicle:
                    if now is not None:
                        done.append((vehicle, *now))
                    vehicle, now = who, fix
                for _ in range(ticks_per_fix):
                    now = (_toward(now[0], fix[0], POSITION_SMOOTHING), _toward(now[1], fix[1], POSITION_SMOOTHING), _turned(now[2], fix[2]))
            schema = batch.schema
            yield _rows(done, schema)
        if now is not None:
            yield _rows([(vehicle, *now)], schema)

    ordered = fixes.repartition("vehicle").sortWithinPartitions("vehicle", "ts", "event_id")
    return ordered.select("vehicle", *(F.col(c).cast("double").alias(c) for c in ("lat", "lon", "heading"))).mapInArrow(run, out_type)


def _rows(rows: list[tuple[Any, ...]], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)


def status_changes(fixes: DataFrame) -> DataFrame:
    """vehicle, ts, event_id, status where the status is not what it was; 0 before the first fix."""
    w = Window.partitionBy("vehicle").orderBy("ts", "event_id")
    out = fixes.withColumn("status", classify.gps_status(F.col("accuracy_m")))
    return out.withColumn("_was", F.lag("status", 1, 0).over(w)).filter("status <> _was").select("vehicle", "ts", "event_id", "status")


def last_location(updates: DataFrame, locations: DataFrame, bound: str = "5 seconds") -> DataFrame:
    """vehicle, event_id, heading of heading-only updates, with at, lat, lon of the vehicle's last location
    if it is younger than ``bound``; updates without one go.

    One ordered pass over both: the last location so far is carried along each vehicle's rows, so no pairs are made.
    """
    place = F.struct(F.col("ts").alias("at"), "lat", "lon")
    rows = locations.select("vehicle", "ts", F.lit(0).alias("_k"), F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("double").alias("heading"), place.alias("_p"))
    asked = updates.select("vehicle", "ts", F.lit(1).alias("_k"), "event_id", "heading", F.lit(None).cast(rows.schema["_p"].dataType).alias("_p"))
    w = Window.partitionBy("vehicle").orderBy("ts", "_k").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.unionByName(asked).withColumn("_p", F.last("_p", ignorenulls=True).over(w)).filter("_k = 1")
    return met.filter(F.col("_p.at") > F.col("ts") - F.expr(f"interval {bound}")).select("vehicle", "event_id", "heading", "_p.at", "_p.lat", "_p.lon")


def clean_motion(speed_ms: Column, heading: Column) -> tuple[Column, Column]:
    """km/h and degrees; negative ones are unknown and count as 0."""
    return F.greatest(speed_ms, F.lit(0.0)) * 3.6, F.greatest(heading, F.lit(0.0))


OUTPUT = "vehicle long, ts timestamp, event_id long, lat double, lon double, heading double, status int, changed boolean"
STATE = "lat double, lon double, heading double, status int"


def _status(accuracy: float) -> int:
    return 0 if accuracy < 0 else 2 if accuracy <= GOOD_ACCURACY_M else 1 if accuracy <= POOR_ACCURACY_M else 0


def _advance(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A row a fix: the smoothed state after it, its status and whether that has changed."""
    if state.hasTimedOut:
        state.remove()
        return
    fixes = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    now = state.get if state.exists else None
    out = []
    for f in fixes.itertuples():
        lat, lon, heading, was = now if now else (f.lat, f.lon, f.heading, 0)
        d = f.heading - heading
        d = d - 360 if d > 180 else d + 360 if d < -180 else d
        status = _status(f.accuracy_m)
        now = (lat + (f.lat - lat) * POSITION_SMOOTHING, lon + (f.lon - lon) * POSITION_SMOOTHING, (heading + d * HEADING_SMOOTHING) % 360, status)
        out.append((key[0], f.ts, f.event_id, *now, status != was))
    state.update(now)
    yield pd.DataFrame(out, columns=["vehicle", "ts", "event_id", "lat", "lon", "heading", "status", "changed"])


def letting_go(idle_ms: int):
    """``_advance`` for states that end after ``idle_ms`` without a fix."""

    def advance(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if not state.hasTimedOut:
            state.setTimeoutDuration(idle_ms)
        yield from _advance(key, frames, state)

    return advance


def gps_stream(fixes: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """The stateful stream over fixes (vehicle, ts, event_id, lat, lon, heading, accuracy_m), one tick a fix.

    A vehicle that sends nothing for ``idle_ms`` of processing time is let go, and
    its next fix is a first one; without ``idle_ms`` the state of every vehicle
    stays.  With ``idle_ms`` the stream never runs out of batches, so it takes a
    trigger by time, not availableNow.  Fixes are put in order within a micro-batch.
    """
    if idle_ms is None:
        return fixes.groupBy("vehicle").applyInPandasWithState(_advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
    return fixes.groupBy("vehicle").applyInPandasWithState(letting_go(idle_ms), OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
