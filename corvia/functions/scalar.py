"""Column functions: geometry, margins and scores of single rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[float, float, float]

SELF_RETURN_M = 2.5


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def finite(*cols: Column) -> Column:
    """True if every column is a number that is neither NaN nor infinite; null counts as not finite."""
    out = F.lit(True)
    for c in cols:
        d = c.cast("double")
        out = out & F.coalesce(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), F.lit(False))
    return out


def unit(v: Vec) -> Vec:
    n = math.sqrt(sum(a * a for a in v))
    if not n:
        raise ValueError("a direction of length 0")
    return tuple(a / n for a in v)


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def frame_basis(forward: Vec, up: Vec) -> tuple[Vec, Vec, Vec]:
    """Right-handed orthonormal axes (forward, lateral, up) from two hints."""
    f = unit(forward)
    lateral = unit(cross(up, f))
    return f, lateral, cross(f, lateral)


#: Axes of a sensor that looks along -y with z up.
SENSOR_AXES = frame_basis((0.0, -1.0, 0.0), (0.0, 0.0, 1.0))


def dot(x: Column, y: Column, z: Column, axis: Vec) -> Column:
    return x * F.lit(float(axis[0])) + y * F.lit(float(axis[1])) + z * F.lit(float(axis[2]))


def project(x: Column, y: Column, z: Column, origin: Vec = (0.0, 0.0, 0.0), axes=SENSOR_AXES) -> tuple[Column, Column, Column]:
    """(forward, lateral, up) of a point: (p - origin) @ axes."""
    dx, dy, dz = x - F.lit(float(origin[0])), y - F.lit(float(origin[1])), z - F.lit(float(origin[2]))
    return tuple(dot(dx, dy, dz, a) for a in axes)


def arc_distance(x: Column, y: Column, offset: Column, yaw: Column, curvature: Column) -> Column:
    """Signed distance to the arc that leaves (0, offset) at angle yaw with a
    curvature that may be 0; stable near 0."""
    dy = y - offset
    u = x * F.cos(yaw) + dy * F.sin(yaw)
    v = dy * F.cos(yaw) - x * F.sin(yaw)
    root = F.sqrt((1 - curvature * v) * (1 - curvature * v) + curvature * u * curvature * u)
    return (2 * v - curvature * (u * u + v * v)) / (1 + root)


def margin_width(distance: Column, full: float = 0.30, begin: float = 30.0, end: float = 50.0) -> Column:
    """Outer margin: 0 up to `begin` metres, growing to `full` at `end`."""
    return clip((distance - begin) / (end - begin), 0.0, 1.0) * full


def lateral_uncertainty(station: Column, rails_end: Column, curvature: Column) -> Column:
    """Of the route's centre beyond the visible rails; null without rails."""
    beyond = F.greatest(station - rails_end, F.lit(0.0))
    turning = F.least(F.abs(curvature) / 4e-4, F.lit(1.0))
    return 0.07 + turning * 0.034 * beyond + (1 - turning) * 0.0006 * beyond * beyond


def evidence_confidence(excess: Column, clearance: Column, unique: Column, layers: Column, support: Column, rise: float = 0.10) -> Column:
    """Weighted evidence that a raised group is real, 0 to 1."""
    parts = (
        (0.30, clip((excess - rise) / (2 * rise), 0, 1)),
        (0.15, clip(clearance / rise + 0.5, 0, 1)),
        (0.25, clip((unique - 3) / 8.0, 0, 1)),
        (0.18, clip((layers - 1) / 2.0, 0, 1)),
        (0.12, F.least(F.lit(1.0), support / 12.0)),
    )
    total = sum((F.lit(w) * c for w, c in parts[1:]), F.lit(parts[0][0]) * parts[0][1])
    return total * F.least(F.lit(1.0), (unique - 1) / 4.0)


def height_layer(height: Column, first: float = 0.2, step: float = 0.8) -> Column:
    """0 up to 0.8 m, then one layer for each 0.8 m; below `first`: null."""
    return F.when(height >= first, F.floor(height / step).cast("int"))


def bend(station: Column, amplitude: Column, onset: Column, extent: float, shape: float = 1.0) -> Column:
    """Lateral offset of a bend that is straight up to its onset and reaches
    `amplitude` at the extent with a cubic-quadratic blend."""
    t = F.greatest(station - onset, F.lit(0.0)) / F.greatest(F.lit(extent) - onset, F.lit(1e-9))
    return amplitude * (F.lit(shape) * t * t + F.lit(1 - shape) * t * t * t)


def path_point(s: Column, offset: Column, yaw: Column, curvature: Column) -> tuple[Column, Column]:
    """(x, y) after arc length s, by chord and turning angle."""
    half = curvature * s / 2
    chord = F.when(F.abs(half) < 1e-9, s).otherwise(s * F.sin(half) / half)
    return chord * F.cos(yaw + half), offset + chord * F.sin(yaw + half)


def travel_motion(distance: Column, curvature: Column, chord: float = 10.5) -> dict[str, Column]:
    """Motion after `distance` along a constant curvature of a sensor at the front
    of a vehicle whose two ends, `chord` apart, stay on the route: a rotation about
    the arc's centre by the angle distance * curvature."""
    turn = curvature * distance
    lean = F.sqrt(F.greatest(1 - (curvature * chord / 2) * (curvature * chord / 2), F.lit(0.0)))
    small = F.abs(turn) < 1e-9
    along = F.when(small, distance).otherwise(distance * F.sin(turn) / turn)
    aside = F.when(small, distance * turn / 2).otherwise(distance * (1 - F.cos(turn)) / turn)
    return {
        "yaw_rad": turn,
        "forward_m": lean * along - F.lit(chord / 2) * (1 - F.cos(turn)),
        "lateral_m": lean * aside + F.lit(chord / 2) * F.sin(turn),
    }


def strict_number(c: Column) -> Column:
    """NaN and infinities as null, as JSON has none."""
    return F.when(finite(c), c)


def stamp_parts(timestamp_ns: Column) -> tuple[Column, Column]:
    """(seconds, nanoseconds) with 0 <= nanoseconds < 10**9."""
    ns = F.pmod(timestamp_ns, F.lit(10**9))
    return ((timestamp_ns - ns) / F.lit(10**9)).cast("long"), ns.cast("long")
