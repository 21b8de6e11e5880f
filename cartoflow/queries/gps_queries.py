"""GPS smoothing and status, in batch and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import shared_folder
from ..sources import fixtures as X
from ..streaming import gps
from .duck import pmod, with_views

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _fold(field: str) -> str:
    return f"list_reduce(list({field} order by ts, event_id), lambda s, x: s + (x - s) * 0.15::double)"


_DIFF = "case when x - s > 180 then x - s - 360 when x - s < -180 then x - s + 360 else x - s end"
_HEADING = f"list_reduce(list(heading order by ts, event_id), lambda s, x: {pmod(f's + ({_DIFF}) * 0.2::double', '360.0::double')})"


@query("gps_smoothed", with_views("gps", f"select vehicle, round({_fold('lat')}, 6) as lat, round({_fold('lon')}, 6) as lon, round({_HEADING}, 6) as heading from gps group by vehicle"))
def _smoothed(spark: SparkSession, d: str) -> DataFrame:
    return gps.smoothed(X.gps_events(spark, d)).select("vehicle", *(F.round(c, 6).alias(c) for c in ("lat", "lon", "heading")))


_CHANGES = "select vehicle, event_id, status from (select *, lag(status, 1, 0) over (partition by vehicle order by ts, event_id) as was from (select *, case when accuracy_m < 0 then 0 when accuracy_m <= 20 then 2 when accuracy_m <= 100 then 1 else 0 end as status from gps)) where status <> was"


@query("gps_status_changes", with_views("gps", _CHANGES))
def _changes(spark: SparkSession, d: str) -> DataFrame:
    return gps.status_changes(X.gps_events(spark, d)).select("vehicle", "event_id", "status")


@query("gps_stream_status_changes", with_views("gps", _CHANGES))
def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The stateful stream over the events table, run until it has read all of it."""
    folder = f"{shared_folder(spark).rstrip('/')}/cartoflow/gps-{uuid.uuid4().hex}"
    source = f"{d}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(source).schema).option("pathGlobFilter", "*.parquet")
    # a table may be one file or a folder of files; a stream reads folders
    stream = events.load(source) if _is_folder(spark, source) else events.option("pathGlobFilter", "events.parquet").load(d)
    fixes = X.gps_columns(stream)
    done = gps.gps_stream(fixes).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema(gps.OUTPUT).parquet(f"{folder}/out").filter("changed").select("vehicle", "event_id", "status")


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


@query("gps_heading_only", with_views("gps", "select a.vehicle as vehicle, a.event_id as event_id, max(b.ts) as at from gps a join gps b on a.vehicle = b.vehicle and b.ts <= a.ts and b.ts > a.ts - interval 6 hours and b.event_id % 2 = 0 where a.event_id % 2 = 1 group by all"))
def _heading(spark: SparkSession, d: str) -> DataFrame:
    e = X.gps_events(spark, d)
    odd, even = e.filter("event_id % 2 = 1"), e.filter("event_id % 2 = 0")
    return gps.last_location(odd, even, "6 hours").select("vehicle", "event_id", F.col("at").cast("timestamp_ntz").alias("at"))
