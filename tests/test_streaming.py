"""GPS state: one ordered pass in batch, and vehicles that a stream lets go."""

import pandas as pd
import pytest

from cartoflow.streaming import gps

FIXES = "vehicle long, ts timestamp_ntz, event_id long, lat double, lon double, heading double, accuracy_m double"


def fix(vehicle, second, event, lat, lon, heading, accuracy=5.0):
    import datetime

    return (vehicle, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=second), event, lat, lon, heading, accuracy)


@pytest.mark.parametrize("ticks", [1, 3])
def test_smoothing_follows_each_vehicle(spark, ticks):
    rows = [fix(v, s, 100 * v + s, 47.0 + v + s % 7 / 10, 8.0 + s % 5 / 10, (s * 97.0 + v) % 360) for v in range(6) for s in range(40 if v else 1)]
    rows += [fix(None, 1, 1, 1.0, 2.0, 3.0), fix(9, 1, 1, 1.0, None, 3.0), fix(9, 2, 2, 2.0, 5.0, 359.0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.vehicle: (r.lat, r.lon, r.heading) for r in gps.smoothed(spark.createDataFrame(rows[::-1], FIXES), ticks).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == {None, 9, *range(6)} and got[None] == (1.0, 2.0, 3.0) and got[9][1] is None
    for v in range(6):
        own = sorted((r for r in rows if r[0] == v), key=lambda r: r[1])
        lat, lon, heading = own[0][3:6]
        for r in own:
            for _ in range(ticks):
                lat, lon = lat + (r[3] - lat) * 0.15, lon + (r[4] - lon) * 0.15
                turn = (r[5] - heading + 540) % 360 - 180
                heading = (heading + (180 if turn == -180 and r[5] > heading else turn) * 0.2) % 360
        assert got[v] == pytest.approx((lat, lon, heading))
    assert gps.smoothed(spark.createDataFrame([], FIXES)).count() == 0


class State:
    """What a group's state does for one vehicle."""

    exists, hasTimedOut, get, timeout = False, False, None, None

    def update(self, now):
        self.exists, self.get = True, now

    def remove(self):
        self.exists, self.get = False, None

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_idle_vehicles_are_let_go():
    """After the time is over the next fix is a first one, so it is where it says."""
    frame = lambda *rows: pd.DataFrame(rows, columns=[c.split()[0] for c in FIXES.split(", ")])
    state, advance = State(), gps.letting_go(1000)
    first, second = (next(advance((1,), iter([frame(fix(1, s, s, lat, 1.0, 0.0))]), state)) for s, lat in ((0, 10.0), (1, 20.0)))
    assert (first.lat[0], second.lat[0], state.timeout) == (10.0, 11.5, 1000)
    state.hasTimedOut, state.timeout = True, None
    assert list(advance((1,), iter([]), state)) == [] and not state.exists and state.timeout is None
    state.hasTimedOut = False
    assert next(advance((1,), iter([frame(fix(1, 9, 9, 20.0, 1.0, 0.0))]), state)).lat[0] == 20.0
