"""Routes as curves: membership of points, rails, and their continuation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .solvers import clamped_knots, find_peaks, ransac_plane, robust_fit, spline_basis, spline_value

HALF_WIDTH, ABOVE, BELOW, TOLERANCE = 1.05, 3.0, 0.7, 1e-8
#: Axes of the mount: forward -y, lateral x, up z, as columns.
MOUNT = np.array([[0.0, 1.0, 0.0], [-1.0, 0.0, 0.0], [0.0, 0.0, 1.0]])


class Curve:
    """A cubic spline as piecewise polynomials, quick to evaluate."""

    def __init__(self, knots, coefficients, degree: int = 3):
        t = np.asarray(knots, float)
        self.breaks = np.unique(t)
        left = self.breaks[:-1]
        fact = (1.0, 1.0, 2.0, 6.0)
        self.poly = np.stack([spline_value(t, coefficients, degree, left, d) / fact[d] for d in range(min(degree, 3) + 1)])

    def __call__(self, s: np.ndarray, derivative: int = 0) -> np.ndarray:
        k = np.clip(np.searchsorted(self.breaks, s, side="right") - 1, 0, self.poly.shape[1] - 1)
        u = s - self.breaks[k]
        p = self.poly[:, k]
        n = len(p)
        out = np.zeros_like(u)
        for d in range(n - 1, derivative - 1, -1):
            factor = np.prod([d - i for i in range(derivative)]) if derivative else 1.0
            out = out * u + p[d] * factor
        return out


@dataclass(frozen=True)
class Geometry:
    """One frame's route: origin, axes (columns forward, lateral, up) and splines
    of the centre's lateral offset and height over the station."""

    origin: np.ndarray
    basis: np.ndarray
    knots: np.ndarray
    lateral: np.ndarray
    height: np.ndarray
    extent: float
    half_width: float = HALF_WIDTH
    gauge_height: float = ABOVE
    rails_end: float | None = None
    rails_curvature: float = 0.0

    def local(self, xyz: np.ndarray) -> np.ndarray:
        return (xyz - self.origin) @ self.basis

    def curves(self) -> tuple[Curve, Curve]:
        return Curve(self.knots, self.lateral), Curve(self.knots, self.height)


def members(xyz: np.ndarray, g: Geometry, half: float = HALF_WIDTH, above: float = ABOVE, below: float = BELOW) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, their (station, normal, height)) of the returns inside the
    corridor. Each return is projected perpendicularly onto the centre line by
    Newton steps inside a shrinking bracket, all returns at once."""
    keep = np.isfinite(xyz).all(axis=1) & (xyz != 0).any(axis=1)
    ids = np.flatnonzero(keep)
    p = g.local(xyz[ids])
    lat, hgt = g.curves()
    x, y, z = p[:, 0], p[:, 1], p[:, 2]
    lo, hi = np.maximum(0.0, x - half - TOLERANCE), np.minimum(g.extent, x + half + TOLERANCE)
    ok = lo <= hi
    ids, x, y, z, lo, hi = ids[ok], x[ok], y[ok], z[ok], lo[ok], hi[ok]

    def f(s):
        return (s - x) + (lat(s) - y) * lat(s, 1)

    ok = (f(lo) <= TOLERANCE) & (f(hi) >= -TOLERANCE)
    ids, x, y, z, lo, hi = ids[ok], x[ok], y[ok], z[ok], lo[ok], hi[ok]
    s = np.clip(x, lo, hi)
    for _ in range(48):
        v = f(s)
        lo, hi = np.where(v < 0, s, lo), np.where(v > 0, s, hi)
        slope = 1 + lat(s, 1) ** 2 + (lat(s) - y) * lat(s, 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            new = s - v / slope
        new = np.where((new > lo) & (new < hi) & np.isfinite(new), new, (lo + hi) / 2)
        new = np.where(v == 0, s, new)
        if np.abs(new - s).max(initial=0.0) < 1e-10:
            s = new
            break
        s = new
    d = lat(s, 1)
    normal = ((y - lat(s)) - (x - s) * d) / np.sqrt(1 + d * d)
    up = z - hgt(s)
    ok = (np.abs(normal) <= half + TOLERANCE) & (up >= -below - TOLERANCE) & (up <= above + TOLERANCE)
    return ids[ok], np.column_stack((s, normal, up))[ok]


def path_lengths(g: Geometry, stations: np.ndarray, step: float = 0.25) -> np.ndarray:
    """Arc length along the centre line up to each station."""
    s = np.arange(0.0, g.extent + step, step)
    lat, hgt = g.curves()
    speed = np.sqrt(1 + lat(s, 1) ** 2 + hgt(s, 1) ** 2)
    run = np.concatenate(([0.0], np.cumsum((speed[1:] + speed[:-1]) / 2 * step)))
    return np.interp(stations, s, run)


def straight_geometry(extent: float = 60.0, origin=(0.0, 0.0, 0.0), basis: np.ndarray = MOUNT, lateral: float = 0.0, height: float = 0.0, curvature: float = 0.0, **more) -> Geometry:
    """A line or, with a curvature, its parabola as one spline."""
    knots = clamped_knots(extent)
    greville = np.array([knots[k + 1 : k + 4].mean() for k in range(len(knots) - 4)])
    fit = np.linalg.lstsq(spline_basis(knots, 3, greville), lateral + curvature * greville**2 / 2, rcond=None)[0]
    return Geometry(np.asarray(origin, float), np.asarray(basis, float), knots, fit, np.full(len(greville), float(height)), float(extent), **more)


# ---- rails -----------------------------------------------------------------------

GAUGE = 1.52
STATIONS = (4.5, 7.5, 10.5, 13.5, 16.5)
BIN = 0.035


@dataclass(frozen=True)
class RailPose:
    origin: np.ndarray
    basis: np.ndarray
    gauge: float
    heads: np.ndarray  # (station, left, right, height)
    reason: str = ""


def level_floor(xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(origin, axes) of the floor ahead; tried over corridors of several widths."""
    p = xyz[np.isfinite(xyz).all(axis=1)] @ MOUNT
    p = p[(p[:, 0] >= 1) & (p[:, 0] <= 20) & (np.abs(p[:, 1]) <= 4) & (p[:, 2] >= -5) & (p[:, 2] <= 2)]
    for width in (2.0, 1.4, 2.6):
        q = p[np.abs(p[:, 1]) <= width]
        if len(q) < 60:
            continue
        got = ransac_plane(q[:: max(1, len(q) // 4000)])
        if got is None:
            continue
        a, b, c = got[0]
        up = np.array([-a, -b, 1.0]) / np.sqrt(1 + a * a + b * b)
        fwd = np.array([1.0, 0.0, a])
        fwd /= np.linalg.norm(fwd)
        side = np.cross(up, fwd)
        return MOUNT @ np.array([0.0, 0.0, c]), MOUNT @ np.column_stack((fwd, side, up))
    return None


def section_peaks(local: np.ndarray, station: float, centre: float = 0.0, heading: float = 0.0, half: float = 1.5, reach: float = 2.5) -> np.ndarray:
    """(offset, height) of what stands out of the local floor like a rail head."""
    q = local[np.abs(local[:, 0] - station) <= half]
    d = q[:, 1] - centre - heading * (q[:, 0] - station)
    near = np.abs(d) <= reach
    d, h = d[near], q[near, 2]
    n = int(2 * reach / BIN)
    b = np.clip(((d + reach) / BIN).astype(int), 0, n - 1)
    top, low = np.full(n, np.nan), np.full(n, np.nan)
    order = np.argsort(b, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(b[order])) + 1) if len(order) else []:
        if len(own) >= 3:
            top[b[own[0]]], low[b[own[0]]] = np.quantile(h[own], (0.8, 0.25))
    if np.isfinite(top).sum() < 8:
        return np.zeros((0, 2))
    floor = np.array([np.nanmedian(low[max(0, k - 12) : k + 13]) if np.isfinite(low[max(0, k - 12) : k + 13]).any() else np.nan for k in range(n)])
    v = np.nan_to_num(top - floor, nan=0.0)
    peaks = find_peaks(v, 0.055, 0.04, 6)
    return np.column_stack(((peaks + 0.5) * BIN - reach + centre, top[peaks])) if len(peaks) else np.zeros((0, 2))


def rail_pose(xyz: np.ndarray) -> RailPose | str:
    """Pose of the rails near the sensor, or why there is none."""
    floor = level_floor(xyz)
    if floor is None:
        return "floor_not_found"
    origin, axes = floor
    local = (xyz[np.isfinite(xyz).all(axis=1)] - origin) @ axes
    local = local[(local[:, 0] >= 2) & (local[:, 0] <= 19) & (np.abs(local[:, 1]) < 3.5) & (np.abs(local[:, 2]) < 1)]
    sections = []
    for s in STATIONS:
        p = section_peaks(local, s)
        pairs = [(abs((a[0] + b[0]) / 2), a, b) for i, a in enumerate(p) for b in p[i + 1 :] if 1.2 <= b[0] - a[0] <= 1.85 and abs((a[0] + b[0]) / 2) <= 0.8]
        if pairs:
            _, a, b = min(pairs, key=lambda x: x[0])
            sections.append((s, a[0], b[0], (a[1] + b[1]) / 2))
    if len(sections) < 3:
        return "too_few_sections"
    heads = np.array(sections)
    width = heads[:, 2] - heads[:, 1]
    gauge = float(np.median(width))
    heads = heads[np.abs(width - gauge) <= 0.14]
    if len(heads) < 3 or np.ptp(heads[:, 0]) < 5.9:
        return "gauge_not_consistent"
    centre = (heads[:, 1] + heads[:, 2]) / 2
    m = np.column_stack((heads[:, 0], np.ones(len(heads))))
    line, level = robust_fit(m, centre, 0.05), robust_fit(m, heads[:, 3], 0.05)
    if abs(np.degrees(np.arctan(line[0]))) > 18:
        return "direction_too_steep"
    if np.abs(m @ line - centre).max() > 0.12 or np.abs(m @ level - heads[:, 3]).max() > 0.08:
        return "sections_not_on_a_line"
    fwd = np.array([1.0, line[0], level[0]])
    fwd /= np.linalg.norm(fwd)
    side = np.cross([0.0, 0.0, 1.0], fwd)
    side /= np.linalg.norm(side)
    basis = axes @ np.column_stack((fwd, side, np.cross(fwd, side)))
    return RailPose(origin + axes @ np.array([0.0, line[1], level[1]]), basis, gauge, heads)


def continue_rails(xyz: np.ndarray, pose: RailPose, until: float = 80.0, step: float = 3.0) -> np.ndarray:
    """(station, centre, height) of sections farther on: predicted from the last
    centres, looked for, and given up after three misses."""
    local = (xyz[np.isfinite(xyz).all(axis=1)] - pose.origin) @ pose.basis
    local = local[(local[:, 0] >= 2) & (local[:, 0] <= until + 6) & (np.abs(local[:, 1]) < 12) & (np.abs(local[:, 2]) < 0.8)]
    found = [(s, c, h) for s in STATIONS for c, h in [_section(local, s, 0.0, 0.0, pose.gauge)] if c is not None]
    misses, s = 0, max(19.5, (found[-1][0] if found else 16.5) + step)
    while s <= until and misses < 3:
        last = np.array(found[-6:]) if found else np.array([[0.0, 0.0, 0.0]])
        fit = np.polyfit(last[:, 0], last[:, 1], 2 if len(last) >= 5 else min(1, len(last) - 1))
        centre, heading = float(np.polyval(fit, s)), float(np.polyval(np.polyder(fit), s)) if len(fit) > 1 else 0.0
        if abs(heading) > 0.6 or abs(centre) > 10:
            break
        c, h = _section(local, s, centre, heading, pose.gauge, min(6.0, 3 + 0.12 * (s - 18)) / 2)
        if c is None:
            misses += 1
        else:
            misses = 0
            found.append((s, c, h))
        s += step
    return np.array(found) if found else np.zeros((0, 3))


def _section(local, s, centre, heading, gauge, half=1.5):
    p = section_peaks(local, s, centre, heading, half)
    pairs = [(abs((a[0] + b[0]) / 2 - centre) + 2 * abs(b[0] - a[0] - gauge), (a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for i, a in enumerate(p) for b in p[i + 1 :] if abs(b[0] - a[0] - gauge) <= 0.10 and abs((a[0] + b[0]) / 2 - centre) < 0.4]
    if not pairs:
        return None, None
    _, c, h = min(pairs)
    return c, h


def fit_arc(sections: np.ndarray) -> tuple[np.ndarray, bool]:
    """(offset, heading, curvature) of a line or, where it explains much more, an arc."""
    s, c = sections[:, 0], sections[:, 1]
    line = np.polyfit(s, c, 1)
    rms_line = float(np.sqrt(np.mean((np.polyval(line, s) - c) ** 2)))
    if len(s) >= 10 and np.ptp(s) >= 15:
        arc = np.polyfit(s, c, 2)
        rms_arc = float(np.sqrt(np.mean((np.polyval(arc, s) - c) ** 2)))
        sagitta = abs(arc[0]) * np.ptp(s) ** 2 / 4
        if rms_arc < 0.7 * rms_line and rms_line - rms_arc > 0.012 and sagitta > 0.045:
            return np.array([arc[2], arc[1], 2 * arc[0]]), True
    return np.array([line[1], line[0], 0.0]), False


def estimate_route(xyz: np.ndarray) -> tuple[Geometry | None, str]:
    """A frame's raw route from its rails: (geometry, reason if there is none)."""
    pose = rail_pose(xyz)
    if isinstance(pose, str):
        return None, pose
    sections = continue_rails(xyz, pose)
    if len(sections) < 3:
        return None, "too_few_sections"
    (offset, heading, curvature), _ = fit_arc(sections)
    p = (xyz[np.isfinite(xyz).all(axis=1)] - pose.origin) @ pose.basis
    extent = float(min(150.0, max(p[:, 0].max(), 20.0)))
    knots = clamped_knots(extent)
    greville = np.array([knots[k + 1 : k + 4].mean() for k in range(len(knots) - 4)])
    target = offset + heading * greville + curvature * greville**2 / 2
    lateral = np.linalg.lstsq(spline_basis(knots, 3, greville), target, rcond=None)[0]
    grade = np.polyfit(sections[:, 0], sections[:, 2], 1)
    height = np.linalg.lstsq(spline_basis(knots, 3, greville), np.polyval(grade, greville), rcond=None)[0]
    return Geometry(pose.origin, pose.basis, knots, lateral, height, extent, rails_end=float(sections[-1, 0]), rails_curvature=float(curvature)), ""
