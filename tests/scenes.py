"""Synthetic track scenes: floor, two rail heads, walls and a box. No randomness."""

import numpy as np


def track(until=60.0, step=0.1, curvature=0.0, shift=0.0, sensor_height=1.8):
    """Sensor coordinates (forward -y, up +z) of a track seen from its middle."""
    s = np.arange(2.0, until, step)
    d = np.arange(-3.0, 3.001, 0.05)
    ss, dd = np.meshgrid(s, d, indexing="ij")
    h = 0.01 * np.sin(7 * ss + 13 * dd)
    rail = (np.abs(np.abs(dd) - 0.76) <= 0.036)
    h = np.where(rail, 0.18 + 0.002 * np.sin(5 * ss), h)
    pts = [np.column_stack((ss.ravel(), dd.ravel(), h.ravel()))]
    for side in (-3.0, 3.0):
        w, z = np.meshgrid(s[::2], np.arange(0.2, 3.0, 0.2), indexing="ij")
        pts.append(np.column_stack((w.ravel(), np.full(w.size, side), z.ravel())))
    p = np.concatenate(pts)
    return to_sensor(p, curvature, shift, sensor_height)


def to_sensor(p, curvature=0.0, shift=0.0, sensor_height=1.8):
    s = p[:, 0] - shift
    return np.column_stack((p[:, 1] + curvature * s * s / 2, -s, p[:, 2] - sensor_height))


def box(at=20.0, size=(0.6, 0.6, 0.8), step=0.05, offset=0.0, curvature=0.0, shift=0.0, sensor_height=1.8):
    l, w, h = size
    d, z = np.meshgrid(np.arange(-w / 2, w / 2 + 1e-9, step), np.arange(0.05, h + 1e-9, step), indexing="ij")
    face = np.column_stack((np.full(d.size, at), d.ravel() + offset, z.ravel()))
    s, d = np.meshgrid(np.arange(at, at + l, step), np.arange(-w / 2, w / 2 + 1e-9, step), indexing="ij")
    top = np.column_stack((s.ravel(), d.ravel() + offset, np.full(s.size, h)))
    return to_sensor(np.concatenate((face, top)), curvature, shift, sensor_height)
