"""Route filters that know more of the route's shape: one curvature sign, recovery
from a wrong shape, and an early sight of the next bend."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, replace

import numpy as np

from ..functions.bends import fit_convex
from ..functions.route import Geometry
from .state import FilterConfig, RouteFilter


@dataclass(frozen=True)
class OneSidedConfig:
    window: int = 10
    deadband: float = 5e-5
    decisive: int = 3
    share: float = 0.7


class OneSidedRouteFilter(RouteFilter):
    """The smoothed route bends one way only: the way on which the last measured
    curvatures agree; straight until they do, and sticky after."""

    def __init__(self, config: FilterConfig | None = None, shape: OneSidedConfig | None = None):
        self.shape = shape or OneSidedConfig()
        super().__init__(config)

    def reset(self) -> None:
        super().reset()
        self.direction = 0
        self.votes: deque = deque(maxlen=self.shape.window)

    def choose(self, raw: Geometry | None) -> int:
        k = raw.rails_curvature if raw is not None else None
        self.votes.append(0 if k is None or abs(k) <= self.shape.deadband else int(np.sign(k)))
        left, right = self.votes.count(1), self.votes.count(-1)
        if left + right >= self.shape.decisive:
            if left >= self.shape.share * (left + right):
                self.direction = 1
            elif right >= self.shape.share * (left + right):
                self.direction = -1
        return self.direction

    def update(self, raw, motion):
        self.choose(raw)
        out = super().update(raw, motion)
        return out if out is None else self.one_sided(out)

    def one_sided(self, g: Geometry) -> Geometry:
        s = np.arange(0.0, g.extent, 1.0)
        y = g.curves()[0](s)
        slope = float(g.curves()[0](np.zeros(1), 1)[0])
        if not self.direction:
            fit = np.polyfit(s, y, 1, w=1 / (1 + s / 20))
            target = np.polyval(fit, s)
            coef = fit_convex(g.knots, s, target, np.ones(len(s)), float(fit[1]), float(fit[0]), 1)
        else:
            coef = fit_convex(g.knots, s, y, 1 / (1 + s / 20), float(y[0]), slope, self.direction)
        return replace(g, lateral=coef)


@dataclass(frozen=True)
class RecoveryConfig:
    stations: tuple[float, ...] = (5.0, 10.0, 15.0, 20.0, 25.0, 30.0, 35.0, 40.0)
    support: int = 7
    residual_in: float = 0.35
    residual_out: float = 0.12
    frames_in: int = 5
    frames_out: int = 10


class RecoveryRouteFilter(OneSidedRouteFilter):
    """Notices that the published shape contradicts what is measured frame after
    frame, and then follows the measurements until both agree again."""

    def __init__(self, config: FilterConfig | None = None, recovery: RecoveryConfig | None = None):
        self.recovery = recovery or RecoveryConfig()
        super().__init__(config)

    def reset(self) -> None:
        super().reset()
        self.recovering, self.bad, self.good = False, 0, 0

    def observed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(stations, medians, deviations) on which the history agrees."""
        s = np.array(self.recovery.stations)
        rows = []
        for _, line, reach in self.items:
            order = np.argsort(line[:, 0], kind="stable")
            v = np.interp(s, line[order, 0], line[order, 1], left=np.nan, right=np.nan)
            rows.append(np.where(s <= reach, v, np.nan))
        a = np.array(rows).reshape(-1, len(s))
        keep = np.isfinite(a).sum(axis=0) >= self.recovery.support
        if keep.sum() < 4 or np.ptp(s[keep]) < 15:
            return s[:0], s[:0], s[:0]
        m = np.nanmedian(a[:, keep], axis=0)
        mad = np.nanmedian(np.abs(a[:, keep] - m), axis=0)
        ok = mad <= 0.15 + 0.003 * s[keep]
        return s[keep][ok], m[ok], mad[ok]

    def update(self, raw, motion):
        out = super().update(raw, motion)
        if out is None:
            return None
        s, m, mad = self.observed()
        if len(s) < 4:
            self.bad = self.good = 0
            return out
        residual = float(np.percentile(np.maximum(np.abs(out.curves()[0](s) - m) - 3 * mad, 0), 75))
        self.bad = self.bad + 1 if residual > self.recovery.residual_in else 0
        self.good = self.good + 1 if residual < self.recovery.residual_out else 0
        if not self.recovering and self.bad >= self.recovery.frames_in:
            self.recovering, self.good, self.previous = True, 0, None
        elif self.recovering and self.good >= self.recovery.frames_out and self.may_leave():
            self.recovering, self.bad = False, 0
        return out

    def may_leave(self) -> bool:
        return True

    def one_sided(self, g: Geometry) -> Geometry:
        if self.recovering:
            s, m, _ = self.observed()
            if len(s) >= 4:
                bend = 2 * np.polyfit(s, m, 2)[0]
                if abs(bend) > 2e-4:
                    self.direction = int(np.sign(bend))
        return super().one_sided(g)


@dataclass(frozen=True)
class EarlyDirectionConfig:
    stations: tuple[float, ...] = (150.0, 120.0, 90.0)
    histories: int = 7
    least: float = 0.4
    frames: int = 3
    lifetime: int = 10


class EarlyDirectionRouteFilter(RecoveryRouteFilter):
    """Takes a bend's direction from far stations on which most of the history
    agrees, before the rails show it."""

    def __init__(self, config: FilterConfig | None = None, recovery: RecoveryConfig | None = None, early: EarlyDirectionConfig | None = None):
        self.early = early or EarlyDirectionConfig()
        super().__init__(config, recovery)

    def reset(self) -> None:
        super().reset()
        self.seen, self.streak, self.age = 0, 0, 0

    def preview(self) -> int:
        for station in self.early.stations:
            away = []
            for _, line, _ in self.items:
                if line[:, 0].max() >= station:
                    near = line[line[:, 0] <= 20]
                    if len(near) >= 2:
                        fit = np.polyfit(near[:, 0], near[:, 1], 1)
                        order = np.argsort(line[:, 0], kind="stable")
                        away.append(float(np.interp(station, line[order, 0], line[order, 1]) - np.polyval(fit, station)))
            if len(away) >= self.early.histories:
                for sign in (1, -1):
                    if np.quantile(sign * np.array(away), 0.2) > self.early.least:
                        return sign
        return 0

    def choose(self, raw):
        direction = super().choose(raw)
        now = self.preview()
        self.streak = self.streak + 1 if now and now == self.seen else int(bool(now))
        if now:
            self.seen, self.age = now, 0
        else:
            self.age += 1
            if self.age > self.early.lifetime:
                self.seen = 0
        if not direction and self.seen and self.streak >= self.early.frames:
            self.direction = self.seen
        return self.direction

    def may_leave(self) -> bool:
        return not self.seen or self.seen == self.direction
