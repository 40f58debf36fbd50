"""Keyed state machines of a recording: motion, route filter, tracker, gauge.

Each is a plain Python object that takes one frame at a time, can be reset, and
can be stored as JSON, so the same code serves the ordered batch pass and the
streaming processor. State is counted in frames, not seconds.
"""

from __future__ import annotations

import json
from collections import deque
from dataclasses import asdict, dataclass, field, replace

import numpy as np

from ..functions.route import Geometry
from ..functions.solvers import clamped_knots, solve_qp, spline_basis, spline_value

# ---- motion --------------------------------------------------------------------

VOXEL, SAMPLE = 0.1, 4000


def clip(v, low, high):
    return min(max(v, low), high)


def near_field(xyz: np.ndarray) -> np.ndarray:
    x, y, z = xyz.T
    return xyz[(-y >= 3) & (-y <= 40) & (np.abs(x) <= 6) & (z > -4) & (z < 5)]


def voxel_codes(p: np.ndarray) -> np.ndarray:
    v = np.floor(p / VOXEL).astype(np.int64) + 2048
    return (v[:, 0] << 24) | (v[:, 1] << 12) | v[:, 2]


def look(xyz: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """(sample, occupied voxels in order) of a frame's near field; no sample of a thin one."""
    near = near_field(xyz[np.isfinite(xyz).all(axis=1)])
    stride = max(1, len(near) // SAMPLE) | 1
    return (near[::stride], np.unique(voxel_codes(near))) if len(near) >= 200 else (None, np.zeros(0, np.int64))


def within(codes: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which codes are among `ordered`, some in ascending order."""
    return ordered[np.minimum(np.searchsorted(ordered, codes), len(ordered) - 1)] == codes


def arc_motion(travel: float, curvature: float, chord: float = 10.5) -> tuple[float, float, float]:
    """(yaw, forward, lateral) after `travel`; see functions.scalar.travel_motion."""
    turn = curvature * travel
    lean = np.sqrt(max(0.0, 1 - (curvature * chord / 2) ** 2))
    along = travel if abs(turn) < 1e-9 else travel * np.sin(turn) / turn
    aside = travel * turn / 2 if abs(turn) < 1e-9 else travel * (1 - np.cos(turn)) / turn
    return turn, lean * along - chord / 2 * (1 - np.cos(turn)), lean * aside + chord / 2 * np.sin(turn)


def carried(p: np.ndarray, motion: tuple[float, float, float]) -> np.ndarray:
    """Points of the previous frame in the current sensor's frame (forward -y)."""
    yaw, f, l = motion
    fwd, lat = -p[:, 1] - f, p[:, 0] - l
    c, s = np.cos(yaw), np.sin(yaw)
    return np.column_stack((lat * c - fwd * s, -(fwd * c + lat * s), p[:, 2]))


@dataclass
class EgoMotion:
    """Travel for each frame from how well the previous near field lands on this one."""

    sample: np.ndarray | None = None
    travel: float = 0.0
    locked: bool = False
    coast: int = 0
    recent: deque = field(default_factory=lambda: deque(maxlen=3))

    def reset(self) -> None:
        self.__init__()

    def update(self, xyz: np.ndarray, curvature: float = 0.0) -> dict:
        return self.advance(*look(xyz), curvature)

    def advance(self, sample: np.ndarray | None, occupied: np.ndarray, curvature: float = 0.0) -> dict:
        """update() with what look() says of the frame."""
        before, measured = self.sample, False
        self.sample = sample
        if before is None or self.sample is None:
            self.coast += 1
            if self.coast > 30:
                self.locked = False
            return self._row(curvature, False, self.travel if self.locked else 0.0)
        steps = np.arange(-0.3, 4.5 + 1e-9, 0.05) if not self.locked else self.travel + np.arange(-0.45, 0.45 + 1e-9, 0.05)
        score = np.array([within(voxel_codes(carried(before, arc_motion(t, curvature))), occupied).mean() for t in steps])
        raw = score
        if self.locked:
            raw = score - np.linspace(score[0], score[-1], len(score))
        k = int(np.argmax(raw))
        if 0 < k < len(steps) - 1:
            a, b, c = raw[k - 1 : k + 2]
            bend = a - 2 * b + c
            best = steps[k] + (0.05 * 0.5 * (a - c) / bend if bend < 0 else 0.0)
            measured = True
        else:
            best = steps[k]
        if self.locked and measured:
            self.travel += 0.5 * clip(best - self.travel, -0.15, 0.15)
            self._relock(before, occupied, curvature)
        elif not self.locked and measured:
            self.travel, self.locked = float(best), bool(best < 0.6)
        self.coast = 0 if measured else self.coast + 1
        if self.coast > 30:
            self.locked = False
        return self._row(curvature, measured, self.travel)

    def _relock(self, before, occupied, curvature) -> None:
        """A standing pattern (the vehicle's own structure) can hold the lock at 0:
        what doesn't fit it tells whether the sensor moves after all."""
        if self.travel >= 0.6:
            self.recent.clear()
            return
        off = before[~within(voxel_codes(before), occupied)]
        if len(off) < 300:
            self.recent.clear()
            return
        steps = np.arange(0.6, 4.5, 0.05)
        score = [within(voxel_codes(carried(off, arc_motion(t, curvature))), occupied).mean() for t in steps]
        self.recent.append(float(steps[int(np.argmax(score))]))
        m = float(np.median(self.recent))
        if len(self.recent) == 3 and max(abs(v - m) for v in self.recent) <= 0.2 and max(score) > 0.2:
            self.travel = m
            self.recent.clear()

    def _row(self, curvature, measured, travel) -> dict:
        yaw, f, l = arc_motion(travel, curvature)
        return {"travel_m": float(travel), "yaw_rad": float(yaw), "forward_m": float(f), "lateral_m": float(l), "measured": measured, "locked": self.locked}


# ---- route filter ------------------------------------------------------------------


@dataclass(frozen=True)
class FilterConfig:
    history: int = 10
    knot_step: float = 12.0
    smoothness: float = 12.0
    observed_weight: float = 5.0
    forecast_weight: float = 1.0
    half_width: float = 1.15
    gauge_height: float = 2.4

    def __post_init__(self):
        if self.history < 1 or min(self.knot_step, self.smoothness, self.observed_weight, self.forecast_weight) <= 0:
            raise ValueError("history and weights must be positive")


class RouteFilter:
    """Causal median of motion-compensated routes, fitted by a penalised spline
    whose change from frame to frame is limited."""

    def __init__(self, config: FilterConfig | None = None):
        self.config = config or FilterConfig()
        self.reset()

    def reset(self) -> None:
        self.items: list[tuple[int, np.ndarray, float]] = []  # (age, (station, offset) rows, own reach)
        self.previous: tuple[float, np.ndarray, np.ndarray] | None = None
        self.reach: float | None = None

    def update(self, raw: Geometry | None, motion: tuple[float, float, float]) -> Geometry | None:
        yaw, f, l = motion
        c, s = np.cos(yaw), np.sin(yaw)
        moved = []
        for age, line, reach in self.items:
            if age + 1 < self.config.history:
                q = line - (f, l)
                moved.append((age + 1, np.column_stack((q[:, 0] * c + q[:, 1] * s, q[:, 1] * c - q[:, 0] * s)), reach - f))
        self.items = moved
        if raw is None:
            return None
        grid = np.arange(0.0, raw.extent + 0.5, 1.0)
        lat, hgt = raw.curves()
        own_reach = raw.rails_end if raw.rails_end is not None else raw.extent
        self.items.append((0, np.column_stack((grid, lat(grid))), own_reach))
        longest = max(r for _, _, r in self.items)
        self.reach = longest if self.reach is None else clip(longest, self.reach - 1.0, self.reach + max(3.0, f + 0.5))
        rows, seen = [], []
        for _, line, reach in self.items:
            order = np.argsort(line[:, 0], kind="stable")
            v = np.interp(grid, line[order, 0], line[order, 1], left=np.nan, right=np.nan)
            rows.append(v)
            seen.append(np.where(grid <= reach, v, np.nan))
        with np.errstate(all="ignore"):
            observed, forecast = _nanmedian(np.array(seen)), _nanmedian(np.array(rows))
        target = np.where(np.isfinite(observed), observed, forecast)
        ok = np.isfinite(target)
        if ok.sum() < 4:
            self.previous = None
            return raw
        knots = clamped_knots(raw.extent, self.config.knot_step)
        b = spline_basis(knots, 3, grid[ok])
        w = np.where(np.isfinite(observed[ok]), self.config.observed_weight, self.config.forecast_weight)
        third = spline_basis(knots, 3, (np.unique(knots)[1:] + np.unique(knots)[:-1]) / 2, 3)
        hess = (b * w[:, None]).T @ b + self.config.smoothness * third.T @ third + 1e-9 * np.eye(b.shape[1])
        coef = np.linalg.solve(hess, b.T @ (w * target[ok]))
        if self.previous is not None:
            coef = self._limited(hess, coef, knots, raw.extent, motion)
        self.previous = (raw.extent, knots, coef)
        return replace(raw, knots=knots, lateral=coef, height=_refit(raw, knots), half_width=self.config.half_width, gauge_height=self.config.gauge_height)

    def _limited(self, hess, coef, knots, extent, motion):
        """The nearest curve whose offset, slope and bend change little from the
        previous one as it stands now."""
        old_extent, old_knots, old = self.previous
        yaw, f, l = motion
        s = np.arange(0.0, min(extent, old_extent - max(f, 0.0)), 4.0)
        if len(s) < 2:
            return coef
        back = spline_value(old_knots, old, 3, s + f) - l - np.tan(yaw) * s
        slope = spline_value(old_knots, old, 3, s + f, 1) - np.tan(yaw)
        bend = spline_value(old_knots, old, 3, s + f, 2)
        g, h = [], []
        for order, ref, lim in ((0, back, 0.06 + 0.0012 * s), (1, slope, np.full(len(s), 0.002)), (2, bend, np.full(len(s), 0.0001))):
            m = spline_basis(knots, 3, s, order)
            g += [m, -m]
            h += [ref - lim, -(ref + lim)]
        got = solve_qp(hess, -hess @ coef, np.vstack(g), np.concatenate(h))
        if got is not None:
            return got
        # no curve meets all limits: go as far towards the new one as offsets allow
        m = spline_basis(knots, 3, s)
        diff = np.abs(m @ coef - back)
        share = float(np.min(np.minimum(1.0, (0.06 + 0.0012 * s) / np.maximum(diff, 1e-9))))
        start = np.linalg.lstsq(np.vstack((m, 1e-4 * np.eye(m.shape[1]))), np.concatenate((back, 1e-4 * coef)), rcond=None)[0]
        return start + share * (coef - start)


def _nanmedian(a: np.ndarray) -> np.ndarray:
    out = np.full(a.shape[1], np.nan)
    some = np.isfinite(a).any(axis=0)
    out[some] = np.nanmedian(a[:, some], axis=0)
    return out


def _refit(raw: Geometry, knots: np.ndarray) -> np.ndarray:
    s = np.arange(0.0, raw.extent, 1.0)
    return np.linalg.lstsq(spline_basis(knots, 3, s), raw.curves()[1](s), rcond=None)[0]


# ---- tracker ------------------------------------------------------------------------


@dataclass
class Track:
    id: int
    station: float
    offset: float
    range_m: float
    kind: str
    evidence: float
    object_hits: int
    hits: int = 1
    unseen: int = 0
    confirmed: bool = False
    speed: float = 0.0
    low: list = field(default_factory=list)
    high: list = field(default_factory=list)
    group_id: int | None = None


def gain_of(kind: str, confidence: float, reasons: list[str]) -> float:
    if kind in ("object", "transient"):
        return clip((confidence - 0.2) / 0.5, 0.2, 1.0)
    if kind == "unplaced":
        return 0.35
    return -0.6 if "outside" in reasons else 0.0


def greedy_match(costs: list[tuple[float, int, int]]) -> dict[int, int]:
    """Cheapest first; each track and observation once. (cost, track, observation)"""
    tracks, seen, out = set(), set(), {}
    for _, t, o in sorted(costs):
        if t not in tracks and o not in seen:
            tracks.add(t)
            seen.add(o)
            out[t] = o
    return out


class Tracker:
    CAP, CONFIRM, RELEASE = 4.0, 1.8, 0.6

    def __init__(self):
        self.tracks: list[Track] = []
        self.next_id = 1

    def reset(self) -> None:
        self.tracks = []  # ids go on: none is given twice

    def update(self, seen: list[dict], travel: float, geometry_extent: float | None, half_width: float = 1.15) -> list[Track]:
        """seen: group_id, kind, station, offset, range_m, confidence, reasons, low, high."""
        costs = []
        for t, tr in enumerate(self.tracks):
            tr.station += -travel + tr.speed
            tr.range_m = max(tr.range_m - travel + tr.speed, 0.0)
            along, side = 1 + 0.03 * tr.range_m, 0.7 + 0.01 * tr.range_m
            for o, ob in enumerate(seen):
                ds, dd = ob["station"] - tr.station, abs(ob["offset"] - tr.offset)
                toward = along + (2.5 if tr.hits <= 2 and ds < 0 else 0.0)
                if abs(ds) <= toward and dd <= side:
                    costs.append((abs(ds) / along + dd / side, t, o))
        match = greedy_match(costs)
        for t, tr in enumerate(self.tracks):
            if t in match:
                ob = seen[match[t]]
                if ob["range_m"] >= 3.5:
                    tr.speed = clip(0.95 * tr.speed + 0.15 * clip(ob["station"] - tr.station, -1, 1), -3, 3)
                    tr.station, tr.offset = ob["station"], ob["offset"]
                tr.range_m, tr.kind, tr.group_id, tr.low, tr.high = ob["range_m"], ob["kind"], ob["group_id"], ob["low"], ob["high"]
                g = gain_of(ob["kind"], ob["confidence"], ob["reasons"])
                tr.evidence += g - (0.25 if not tr.confirmed and g <= 0 else 0.0)
                tr.hits += 1
                tr.object_hits += ob["kind"] in ("object", "transient")
                tr.unseen = 0
            else:
                tr.group_id = None
                tr.unseen += 1
                tr.evidence -= self._miss(tr, geometry_extent, half_width) + (0.25 if not tr.confirmed else 0.0)
            tr.evidence = min(tr.evidence, self.CAP)
            if tr.evidence >= self.CONFIRM and tr.object_hits >= 2:
                tr.confirmed = True
            elif tr.evidence < self.RELEASE:
                tr.confirmed = False
        self.tracks = [t for t in self.tracks if t.station >= 1.0 and t.evidence >= -1.0 and (t.confirmed or t.unseen <= 3)]
        for o, ob in enumerate(seen):
            if o not in match.values():
                g = gain_of(ob["kind"], ob["confidence"], ob["reasons"])
                if g > 0:
                    self.tracks.append(Track(self.next_id, ob["station"], ob["offset"], ob["range_m"], ob["kind"], g, int(ob["kind"] in ("object", "transient")), low=ob["low"], high=ob["high"], group_id=ob["group_id"]))
                    self.next_id += 1
        self._merge()
        return self.tracks

    def _miss(self, tr: Track, extent: float | None, half_width: float) -> float:
        if extent is None or tr.station > extent - 2 or abs(tr.offset) > half_width + 0.5 or tr.range_m < 3.0:
            return 0.0
        if any(o is not tr and o.confirmed and o.range_m <= tr.range_m - 1 and abs(o.offset - tr.offset) < 1.5 for o in self.tracks):
            return 0.0  # behind something nearer
        return 0.1 if tr.range_m < 5 else 0.6 if tr.range_m < 40 else 0.35 if tr.range_m < 80 else 0.15

    def _merge(self) -> None:
        hosts: list[Track] = []
        for tr in sorted(self.tracks, key=lambda t: t.id):
            host = next((h for h in hosts if abs(h.station - tr.station) <= 1 + 0.03 * h.range_m and abs(h.offset - tr.offset) <= 0.7 + 0.01 * h.range_m and (h.group_id is None or tr.group_id is None)), None)
            if host is None:
                hosts.append(tr)
                continue
            host.evidence, host.object_hits, host.hits = max(host.evidence, tr.evidence), max(host.object_hits, tr.object_hits), max(host.hits, tr.hits)
            host.confirmed = host.confirmed or tr.confirmed
            if host.group_id is None and tr.group_id is not None:
                host.group_id, host.station, host.offset, host.range_m, host.unseen, host.low, host.high = tr.group_id, tr.station, tr.offset, tr.range_m, tr.unseen, tr.low, tr.high
        self.tracks = hosts


# ---- gauge ----------------------------------------------------------------------------


@dataclass(frozen=True)
class GaugeConfig:
    half_width: float = 1.15
    height: float = 2.4
    inner: float = 0.10
    outer: float = 0.30
    ramp_begin: float = 30.0
    ramp_end: float = 50.0
    minimum: int = 3
    entry: int = 5
    edge_exit: int = 3
    outside_exit: int = 5
    expire: int = 8
    expire_blocked: int = 20
    vetoes: tuple[str, ...] = ("clipped", "edged")

    def __post_init__(self):
        values = (self.half_width, self.height, self.inner, self.outer)
        if not all(np.isfinite(values)) or self.half_width <= 0 or self.height <= 0 or min(self.inner, self.outer) < 0 or self.ramp_end <= self.ramp_begin or self.minimum < 1:
            raise ValueError("margins must be finite and the ramp rise")

    def outer_at(self, distance: float) -> float:
        return self.outer * clip((distance - self.ramp_begin) / (self.ramp_end - self.ramp_begin), 0, 1)


def classify(local: np.ndarray, config: GaugeConfig, outer: float) -> str:
    """inside, borderline or outside, by distinct returns (station, offset, height)."""
    p = np.unique(np.asarray(local, float).reshape(-1, 3), axis=0)
    gap = np.maximum(np.abs(p[:, 1]) - config.half_width, p[:, 2] - config.height)[p[:, 2] >= 0]
    if (gap < -config.inner - 1e-8).sum() >= config.minimum:
        return "inside"
    return "borderline" if (gap <= outer + 1e-8).any() else "outside"


def decisive(local: np.ndarray, config: GaugeConfig) -> np.ndarray:
    """The returns that classify() decides by, whatever its outer margin: of distinct
    ones at or above the rails, as many as it counts that are deepest inside."""
    p = np.unique(np.asarray(local, float).reshape(-1, 3), axis=0)
    p = p[p[:, 2] >= 0]
    gap = np.maximum(np.abs(p[:, 1]) - config.half_width, p[:, 2] - config.height)
    return p[np.argsort(gap, kind="stable")[: config.minimum]]


@dataclass
class Assessment:
    seen: deque = field(default_factory=lambda: deque(maxlen=3))
    deep: deque = field(default_factory=lambda: deque(maxlen=5))
    exists: bool = False
    blocked: bool = False
    ever_blocked: bool = False
    edge: int = 0
    outside: int = 0
    missing: int = 0
    outer: float = 0.0

    def observe(self, relation: str | None, confirmed: bool, config: GaugeConfig) -> None:
        """relation: None if the track wasn't observed in this frame."""
        hit = relation is not None
        self.seen.append(hit)
        self.missing = 0 if hit else self.missing + 1
        self.exists = self.exists or sum(self.seen) >= 2 or confirmed
        if hit:
            self.deep.append(relation == "inside")
            self.edge = self.edge + 1 if relation == "borderline" else 0
            self.outside = self.outside + 1 if relation == "outside" else 0
            if self.exists and relation == "inside" and len(self.deep) == config.entry and all(self.deep):
                self.blocked = self.ever_blocked = True
            if self.edge >= config.edge_exit or self.outside >= config.outside_exit:
                self.blocked = False

    def retired(self, config: GaugeConfig) -> str | None:
        if self.missing >= (config.expire_blocked if self.ever_blocked else config.expire):
            return "prediction_expired"
        if self.outside >= config.outside_exit:
            return "observed_outside_corridor"
        return None

    def decision(self) -> str:
        return "BLOCKED" if self.blocked else "CAUTION" if self.exists or self.outside < 5 else "CLEAR"


class Gauge:
    def __init__(self, config: GaugeConfig | None = None):
        self.config = config or GaugeConfig()
        self.reset()

    def reset(self) -> None:
        self.state: dict[int, Assessment] = {}
        self.blocking: list[int] = []

    def process(self, tracks: list[Track], points: dict[int, np.ndarray], reasons: dict[int, list[str]], route_ok: bool) -> dict:
        """points: local returns of the groups seen now; one row for the frame."""
        sources = {t.id: t for t in tracks if t.object_hits > 0 or t.confirmed}
        self.state = {i: s for i, s in self.state.items() if i in sources}
        rows, lost = [], []
        for i, t in sources.items():
            s = self.state.setdefault(i, Assessment())
            s.outer = max(s.outer, self.config.outer_at(t.range_m))
            seen = t.group_id is not None and t.group_id in points
            relation = classify(points[t.group_id], self.config, s.outer) if seen else None
            good = seen and t.kind in ("object", "transient") and not set(reasons.get(t.group_id, [])) & set(self.config.vetoes)
            s.observe("borderline" if relation == "inside" and not good else relation, t.confirmed, self.config)
            why = s.retired(self.config)
            if why:
                lost.append((i, why))
                continue
            d = s.decision()
            if d == "BLOCKED" and s.missing > 5:
                d = "CAUTION"
            if d == "CLEAR" and not seen:
                d = "CAUTION"
            rows.append({"id": i, "decision": d, "relation": relation or "predicted", "range_m": t.range_m, "exists": s.exists, "confirmed": t.confirmed, "seen": seen, "kind": t.kind, "station_m": t.station, "offset_m": t.offset, "evidence": t.evidence, "speed_m_per_frame": t.speed, "low": None if t.low is None else [float(v) for v in t.low], "high": None if t.high is None else [float(v) for v in t.high]})
        blocking = sorted(r["id"] for r in rows if r["decision"] == "BLOCKED")
        caution = sorted(r["id"] for r in rows if r["decision"] == "CAUTION")
        status = "BLOCKED" if blocking else "CAUTION" if caution or not route_ok else "CLEAR"
        near = [r for r in rows if r["decision"] == "BLOCKED"] or [r for r in rows if r["decision"] == "CAUTION" and r["exists"]]
        best = min(near, key=lambda r: (r["range_m"], r["id"]), default=None)
        new, gone = set(blocking) - set(self.blocking), set(self.blocking) - set(blocking)
        event = "confirmed" if new else "released" if gone else None
        self.blocking = blocking
        return {
            "status": status,
            "path_clear": {"BLOCKED": False, "CLEAR": True}.get(status),
            "distance_m": best["range_m"] if best else None,
            "confidence": clip(best["evidence"] / 4, 0, 1) if best else None,
            "blocking_ids": blocking,
            "caution_ids": caution,
            "event": event,
            "tracks": rows,
            "lost": [i for i, _ in lost],
        }


# ---- a recording -----------------------------------------------------------------------


class Recording:
    """Everything a recording remembers between frames."""

    def __init__(self, max_gap_s: float = 0.25, gauge: GaugeConfig | None = None):
        self.max_gap_ns = int(round(max_gap_s * 1e9))
        self.tracker, self.gauge, self.last = Tracker(), Gauge(gauge), None

    def guard(self, frame_id: str, timestamp_ns: int) -> str | None:
        reason = None
        if self.last is not None:
            if frame_id != self.last[0]:
                reason = "frame_id_changed"
            elif timestamp_ns < self.last[1]:
                reason = "timestamp_moved_backwards"
            elif self.max_gap_ns and timestamp_ns - self.last[1] > self.max_gap_ns:
                reason = "timestamp_gap"
        self.last = (frame_id, timestamp_ns)
        if reason:
            self.reset()
        return reason

    def reset(self) -> None:
        self.tracker.reset()
        self.gauge.reset()

    def frame(self, frame_id: str, timestamp_ns: int, seen: list[dict], travel: float, extent: float | None) -> dict:
        """seen: observations with `points`, local returns as (n, 3). A failing frame
        clears the state and is reported as CAUTION."""
        reason = self.guard(frame_id, timestamp_ns)
        try:
            tracks = self.tracker.update(seen, travel, extent)
            out = self.gauge.process(tracks, {o["group_id"]: np.asarray(o["points"], float) for o in seen}, {o["group_id"]: o["reasons"] for o in seen}, extent is not None)
            self.tracker.tracks = [t for t in self.tracker.tracks if t.id not in set(out["lost"])]
            return out | {"reset_reason": reason, "processing_ok": True, "error": None}
        except Exception as e:  # noqa: BLE001  reported in the row
            self.reset()
            return {"status": "CAUTION", "path_clear": None, "distance_m": None, "confidence": None, "blocking_ids": [], "caution_ids": [], "event": None, "tracks": [], "lost": [], "reset_reason": reason, "processing_ok": False, "error": str(e)}

    def dump(self) -> str:
        g = {str(i): asdict(s) | {"seen": list(s.seen), "deep": list(s.deep)} for i, s in self.gauge.state.items()}
        return json.dumps({"last": self.last, "next_id": self.tracker.next_id, "tracks": [asdict(t) for t in self.tracker.tracks], "gauge": g, "blocking": self.gauge.blocking})

    @classmethod
    def load(cls, text: str | None, **options) -> Recording:
        out = cls(**options)
        if text:
            d = json.loads(text)
            out.last = tuple(d["last"]) if d["last"] else None
            out.tracker.next_id = d["next_id"]
            out.tracker.tracks = [Track(**t) for t in d["tracks"]]
            out.gauge.state = {int(i): Assessment(**(s | {"seen": deque(s["seen"], 3), "deep": deque(s["deep"], 5)})) for i, s in d["gauge"].items()}
            out.gauge.blocking = d["blocking"]
        return out
