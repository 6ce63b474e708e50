"""Keyframe gating: keep a frame that has moved far enough from the last one kept."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def baseline(depth: float, overlap: float) -> float:
    """How far to move between frames of sixty degrees for an overlap, two centimetres at least."""
    return max(0.02, 2 * depth * math.tan(math.radians(30)) * (1 - overlap))


def keep_moved(frames: DataFrame, distance: float, degrees: float | None = None) -> DataFrame:
    """Batch form over frames(capture, t, x, y, z[, qx, qy, qz, qw]): each is compared with the last kept one.

    A capture is sequential, so it is one group: some tens of thousands of poses.
    """
    turn = degrees is not None

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["t", "x"], kind="stable")
        p = x[["x", "y", "z"]].to_numpy(float)
        q = x[["qx", "qy", "qz", "qw"]].to_numpy(float) if turn else None
        keep, last = np.zeros(len(x), bool), None
        for i in range(len(x)):
            far = last is None or np.linalg.norm(p[i] - p[last]) >= distance
            if not far and turn:
                far = 2 * math.degrees(math.acos(min(1.0, abs(float(q[i] @ q[last]))))) >= degrees
            if far:
                keep[i], last = True, i
        return x[keep]

    return frames.groupBy("capture").applyInPandas(run, frames.schema)


def keep_moved_stream(frames: DataFrame, distance: float) -> DataFrame:
    """Streaming form: the last kept position is the state of each capture."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = np.array(state.get) if state.exists else None
        x = pd.concat(list(batches)).sort_values("t", kind="stable")
        keep = []
        for p in x[["x", "y", "z"]].to_numpy(float):
            keep.append(last is None or float(np.linalg.norm(p - last)) >= distance)
            if keep[-1]:
                last = p
        state.update(tuple(map(float, last)))
        yield x[np.array(keep)]

    return frames.groupBy("capture").applyInPandasWithState(run, frames.schema, "x double, y double, z double", "append", GroupStateTimeout.NoTimeout)
