"""Where models and receivers stand: offsets between frames and a receiver's arm."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vectors as V


def to_source_world(p: Column, applied: Column) -> Column:
    """A point of an exported model in the world it was cut from."""
    return V.add(p, applied)


def turn_up(p: Column) -> Column:
    """z up to y up: (x, z, -y)."""
    return V.vec(p["x"], p["z"], -p["y"])


def unturn_up(p: Column) -> Column:
    return V.vec(p["x"], -p["z"], p["y"])


def model_frame(p: Column, set_offset: Column, bundle_offset: Column, y_up: Column) -> Column:
    """A control point in the frame of a model: by way of the source world, then turned if the model is y up."""
    moved = V.sub(V.add(p, set_offset), bundle_offset)
    return V.vec(*(F.when(y_up, a).otherwise(b) for a, b in zip(V.parts(turn_up(moved)), V.parts(moved), strict=True)))


def world_from_model(p: Column, turn: Column, move: Column, model_offset: Column, points_offset: Column, y_up: Column) -> Column:
    """A model's point in the capture's frame: unturned, into the points' frame, and through the inverse of the rigid solution (turn, move)."""
    un = unturn_up(p)
    straight = V.vec(*(F.when(y_up, a).otherwise(b) for a, b in zip(V.parts(un), V.parts(p), strict=True)))
    shifted = V.add(straight, V.sub(model_offset, points_offset))
    return V.rotate(V.quat_conjugate(turn), V.sub(shifted, move))


def lever_arm(arm: Column, body_to_world: Column) -> Column:
    """What takes an antenna's position to the body's: the arm in the world, the other way."""
    return V.negate(V.rotate(body_to_world, arm))
