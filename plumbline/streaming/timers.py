"""Timers on streams: a position reported again and again, and receivers that fall silent.

State is one small row a device.  Time is event time by default: a timer is due
once the watermark passes it, so a run over the same input gives the same rows,
also after a restart from its checkpoint.  With ``clock="processing"`` the machine's
clock fires timers instead, also while no data comes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Seconds to the first report and between reports, and of silence until a receiver goes.
FIRST_REPORT, REPORT_EVERY, SILENCE = 1.0, 10.0, 12.0


def _kind(clock: str):
    from pyspark.sql.streaming.state import GroupStateTimeout

    if clock not in ("event", "processing"):
        raise ValueError("clock is event or processing")
    return GroupStateTimeout.EventTimeTimeout if clock == "event" else GroupStateTimeout.ProcessingTimeTimeout


def _wake(state, clock: str, due: float) -> None:
    """Asks to be called once time has passed ``due`` (seconds)."""
    if clock == "event":
        state.setTimeoutTimestamp(max(math.ceil(due * 1000), state.getCurrentWatermarkMs() + 1))
    else:
        state.setTimeoutDuration(max(1, math.ceil(due * 1000) - state.getCurrentProcessingTimeMs()))


def _seconds(ts: pd.Series) -> list[float]:
    return (ts.astype("datetime64[us]").astype("int64") / 1e6).tolist()


def position_reports(positions: DataFrame, every: float = REPORT_EVERY, first: float = FIRST_REPORT, late: str = "2 seconds", clock: str = "event") -> DataFrame:
    """Stream of positions(device, ts, sentence) to (device, due, sentence): the latest sentence as of each report.

    The first report is due ``first`` seconds after a device's first position, and
    then one every ``every`` seconds for as long as the stream runs, whether or
    not newer positions came.  A null sentence is no position.  Of two positions
    at one time the greater text counts as the later.
    """
    rows = positions.where("device is not null and ts is not null and sentence is not null").select("device", "ts", "sentence")

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        sentence, at, due = state.get if state.exists else (None, None, None)
        out = []
        if state.hasTimedOut:
            now = (state.getCurrentWatermarkMs() if clock == "event" else state.getCurrentProcessingTimeMs()) / 1000
            came: list[tuple[float, str]] = []
        else:
            x = pd.concat(list(batches))
            came = sorted(zip(_seconds(x["ts"]), x["sentence"], strict=True))
            now = -math.inf if clock == "event" else state.getCurrentProcessingTimeMs() / 1000
            if due is None:
                due = (came[0][0] if clock == "event" else now) + first
        if clock == "event":
            for t, s in came:
                while due < t and sentence is not None:
                    out.append((due, sentence))
                    due += every
                if at is None or t >= at:
                    sentence, at = s, t
        elif came:
            at, sentence = max(came + ([(at, sentence)] if at is not None else []))
        while due <= now:
            out.append((due, sentence))
            due += every
        state.update((sentence, at, due))
        _wake(state, clock, due)
        yield pd.DataFrame({"device": key[0], "due": pd.to_datetime([round(d * 1e6) for d, _ in out], unit="us"), "sentence": [s for _, s in out]})

    made = rows.withWatermark("ts", late) if clock == "event" else rows
    return made.groupBy("device").applyInPandasWithState(run, "device string, due timestamp, sentence string", "sentence string, at double, due double", "append", _kind(clock))


def presence(sightings: DataFrame, silence: float = SILENCE, late: str = "2 seconds", clock: str = "event") -> DataFrame:
    """Stream of sightings(device, ts, name, serial, signal) to (device, seen, name, serial, signal, gone).

    A row for each device with news, merged: a name or a serial flag once seen
    stays, the signal is the latest.  ``silence`` seconds after the last sighting
    one row says that it is gone, and its state goes; when it comes back it begins
    anew.  A sighting that comes that much later than the last one finds the
    device gone first.
    """
    rows = sightings.where("device is not null and ts is not null").select("device", "ts", "name", "serial", "signal")

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else None
        out, news = [], False
        if state.hasTimedOut:
            out.append((*now, True))
            state.remove()
        else:
            x = pd.concat(list(batches)).sort_values(["ts", "signal"], kind="stable")
            for t, name, serial, signal in zip(_seconds(x["ts"]), x["name"], x["serial"], x["signal"], strict=True):
                if now and t - now[0] > silence:
                    out += [(*now, False)] * news + [(*now, True)]
                    now = None
                seen, had, flag, level = now or (t, None, False, None)
                newest, news = t >= seen, True
                now = (max(t, seen), (name if newest or not had else had) or had if isinstance(name, str) and name else had, bool(flag) or serial is True or serial == 1, float(signal) if newest and not pd.isna(signal) else level)
            out.append((*now, False))
            state.update(now)
            _wake(state, clock, now[0] + silence if clock == "event" else state.getCurrentProcessingTimeMs() / 1000 + silence)
        columns = list(zip(*out, strict=True))
        yield pd.DataFrame({"device": key[0], "seen": pd.to_datetime([round(t * 1e6) for t in columns[0]], unit="us"), "name": pd.Series(columns[1], dtype="object"), "serial": columns[2], "signal": pd.array(columns[3], "Float64"), "gone": columns[4]})

    made = rows.withWatermark("ts", late) if clock == "event" else rows
    schema = "device string, seen timestamp, name string, serial boolean, signal double, gone boolean"
    return made.groupBy("device").applyInPandasWithState(run, schema, "seen double, name string, serial boolean, signal double", "append", _kind(clock))
