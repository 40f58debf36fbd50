import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvia.functions import bends, detection, route, solvers, walls
from corvia.streaming import filters, state
from tests import scenes


def test_components_against_search():
    rng = np.random.default_rng(0)
    for n in (1, 5, 60):
        a, b = rng.integers(0, n, n // 2), rng.integers(0, n, n // 2)
        got = solvers.components(n, a, b)
        group = {k: {k} for k in range(n)}
        for i, j in zip(a, b):
            u = group[i] | group[j]
            for k in u:
                group[k] = u
        assert got.tolist() == [min(group[k]) for k in range(n)]


def test_band_pairs_against_all_pairs():
    rng = np.random.default_rng(1)
    s, d, h = rng.uniform(0, 20, (3, 80))
    d, h = d / 10, h / 10
    lat, ver = rng.uniform(0.2, 0.5, (2, 80))
    i, j = solvers.band_pairs(s, d, h, lat, ver)
    want = {frozenset(p) for p in itertools.combinations(range(80), 2) if abs(s[p[0]] - s[p[1]]) <= 1.2 and abs(d[p[0]] - d[p[1]]) <= max(lat[list(p)]) and abs(h[p[0]] - h[p[1]]) <= max(ver[list(p)])}
    assert {frozenset(p) for p in zip(i.tolist(), j.tolist())} == want


@pytest.mark.parametrize("span", [0.5, 6.0, 40.0])
def test_band_roots_against_pairs(span, monkeypatch):
    monkeypatch.setattr(solvers, "PAIRS", 1000)
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 900):
        s, d, h = rng.uniform(0, 20, n), rng.uniform(-span, span, n).round(2), rng.uniform(-span, span, n).round(2)
        far = rng.uniform(0, 120, n)
        lat, ver = np.maximum(0.25, 0.006 * far), np.maximum(0.2, 0.006 * far)
        assert solvers.band_roots(s, d, h, lat, ver).tolist() == solvers.components(n, *solvers.band_pairs(s, d, h, lat, ver)).tolist()


def test_a_dense_frame_is_grouped_in_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(5)
    n = 40000  # 13 million pairs in reach along the track
    s, d, h = rng.uniform(0, 80, n), rng.uniform(-2, 2, n), rng.uniform(-1, 2, n)
    d[d > 0] += 1  # two sides apart
    tracemalloc.start()
    got = solvers.group_labels(s, d, h, np.full(n, 10.0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(got[d > 0])) < 50 and not set(got[d > 0]) & set(got[d <= 0])
    assert peak < 200e6


def test_robust_fit_ignores_outliers():
    x = np.linspace(0, 10, 50)
    y = 2 * x + 1
    y[::10] += 30
    a = np.column_stack((x, np.ones(50)))
    assert np.allclose(solvers.robust_fit(a, y, 0.01), [2, 1], atol=0.01)


def test_plane_by_ransac():
    rng = np.random.default_rng(2)
    p = rng.uniform(-5, 5, (400, 3))
    p[:300, 2] = 0.05 * p[:300, 0] - 0.02 * p[:300, 1] - 1.5
    c, inside = solvers.ransac_plane(p)
    assert np.allclose(c, [0.05, -0.02, -1.5], atol=0.01) and inside[:300].all()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_nnls_and_qp_meet_their_conditions(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(8, 4)), rng.normal(size=8)
    x = solvers.nnls(a, b)
    grad = a.T @ (a @ x - b)
    assert (x >= 0).all() and (grad >= -1e-6).all() and np.abs(grad * x).max() < 1e-6
    h = a.T @ a + 0.1 * np.eye(4)
    g, lim = rng.normal(size=(5, 4)), -np.abs(rng.normal(size=5))
    q = solvers.solve_qp(h, -a.T @ b, g, lim)
    assert q is not None and (g @ q - lim >= -1e-6).all()
    for _ in range(30):  # no feasible neighbour is better
        y = q + 1e-3 * rng.normal(size=4)
        if (g @ y >= lim).all():
            assert y @ h @ y / 2 - b @ a @ y >= q @ h @ q / 2 - b @ a @ q - 1e-8


def test_peaks():
    v = np.array([0, 1, 0, 3, 3, 0, 0.5, 0.4, 2, 0], float)
    assert solvers.find_peaks(v, 0.4, 0.2, 1).tolist() == [1, 3, 8]
    assert solvers.find_peaks(v, 1.5, 0.2, 1).tolist() == [3, 8] and solvers.find_peaks(v, 0.4, 0.2, 6).tolist() == [3]


def test_spline_reproduces_cubics_and_derivatives():
    t = solvers.clamped_knots(60.0)
    x = np.linspace(0, 60, 200)
    y = 1 + 0.1 * x - 0.02 * x**2 + 0.0003 * x**3
    c = np.linalg.lstsq(solvers.spline_basis(t, 3, x), y, rcond=None)[0]
    assert np.allclose(solvers.spline_value(t, c, 3, x), y)
    assert np.allclose(solvers.spline_value(t, c, 3, x, 1), 0.1 - 0.04 * x + 0.0009 * x**2)
    curve = route.Curve(t, c)
    assert np.allclose(curve(x), y) and np.allclose(curve(x, 2), -0.04 + 0.0018 * x)


def test_levenberg_stays_in_bounds():
    x, cost = solvers.levenberg(lambda v: np.array([v[0] - 3, 10 * (v[1] - v[0] ** 2)]), np.zeros(2), np.array([-5, -5]), np.array([2, 5]))
    assert np.allclose(x, [2, 4], atol=1e-3) and cost == pytest.approx(1, abs=1e-4)


def test_nearest_rank_and_fill():
    v = np.array([5.0, 1, 2, 3, 4])
    assert detection.ranked_by_group(v, np.zeros(5, int), 2, 95, 4)[0] == 5 and np.isnan(detection.ranked_by_group(v, np.zeros(5, int), 2, 95, 6)).all()
    assert detection.fill(np.array([np.nan, 1, np.nan, 3, np.nan])).tolist() == [1, 1, 2, 3, 3] and not detection.fill(np.full(3, np.nan)).any()


# ---- walls and bends --------------------------------------------------------------


@pytest.fixture(scope="module")
def tunnel():
    s = np.arange(1.0, 100.0, 0.25)
    rows = [np.column_stack((s, np.full(len(s), side) + 0.001 * s * s / 2, np.full(len(s), z))) for side in (-3.1, 3.1) for z in np.arange(0.25, 3, 0.2)]
    return np.concatenate(rows)


def test_walls_are_followed_and_the_arc_fits(tunnel):
    rows = walls.wall_rows(tunnel, 100.0)
    assert {-1, 1} == set(rows[:, 2]) and (rows[:, 2] < 0).sum() >= 8
    assert np.abs(np.abs(rows[:, 1] - 0.0005 * rows[:, 0] ** 2) - 3.1).max() < 0.5
    s = np.arange(4.0, 30.0, 2)
    sections = np.column_stack((s, 0.0005 * s * s, np.zeros(len(s))))
    arc = walls.fit_arc_with_walls(sections, walls.continuous(rows), 100.0)
    assert arc["curvature"] == pytest.approx(0.001, rel=0.2) and arc["walls_used"]
    bands = np.column_stack((s, 0.0005 * s * s - 3, 0.0005 * s * s + 3))
    kept = walls.refine_arc(arc, sections, bands)
    assert kept["status"] == "kept"
    assert walls.validate_arc(kept, sections, bands, rows)[0] == "NO_DETECTED_CONTRADICTION"
    assert "incompatible_with_rail_supports" in walls.validate_arc(kept | {"offset": 1.0}, sections, bands, rows)[1]


def test_straight_stays_straight():
    s = np.arange(4.0, 40.0, 2)
    arc = walls.fit_arc_with_walls(np.column_stack((s, 0.005 * np.sin(s))), np.zeros((0, 5)), 60.0)
    assert arc["curvature"] == 0.0


def test_an_arc_off_the_edges_is_moved():
    s = np.arange(4.0, 60.0, 4)
    path = {"offset": 0.0, "yaw": 0.0, "curvature": 0.0}
    bands = np.column_stack((s, np.full(len(s), -3.0) + 0.0008 * s * s, np.full(len(s), 3.0) + 0.0008 * s * s))
    got = walls.refine_arc(path, np.column_stack((s[:3], np.zeros(3))), bands)
    assert got["status"] == "refined" and got["curvature"] > 0 and got["violation"] < 1e-2


def test_far_rails_agree():
    s = np.arange(20.0, 60.0, 3)
    c = np.column_stack((s, 0.0002 * (s - 18) ** 2))
    noise = np.array([[25.0, 2.0], [40.0, -1.5]])
    got = walls.centre_consensus(np.concatenate((c, noise)), 18.0, 0.0)
    assert len(got) == len(c)


def test_bend_in_bounds_and_verdict():
    s = np.arange(4.0, 100.0, 8)
    turn = bends.bend_value(s, 6.0, 40.0, 100.0)
    b = np.column_stack((s, turn - 2.5, turn + 2.5))
    fixed, bad = bends.repaired_bounds(b)
    assert not bad.any()
    grid = np.arange(0.0, 100.0, 1.0)
    fit = bends.fit_horizontal(fixed, grid, s[:4], np.zeros(4), 0.0, 0.0, 100.0, 1)
    assert fit["cost"] < 0.5 and fit["amplitude"] > 2
    knots = solvers.clamped_knots(100.0)
    y = bends.bend_value(grid, fit["amplitude"], fit["onset"], 100.0, fit["shape"])
    coef = bends.fit_convex(knots, grid, y, np.ones(len(grid)), 0.0, 0.0, 1)
    g = route.straight_geometry(100.0)
    g = route.Geometry(g.origin, g.basis, knots, coef, np.zeros(len(coef)), 100.0)
    assert (g.curves()[0](np.unique(knots), 2) > -1e-4).all()
    assert bends.route_excess(g, fixed) < 0.3
    straight = route.straight_geometry(100.0)
    status, why = bends.route_verdict(straight, fixed, bad, np.zeros((0, 2)), np.array([[0.5, -10.0, 1.0]]))
    assert status == "REJECTED" and "leaves_observed_bounds" in why and "occupied_inside" in why


def test_posts_in_a_row():
    s = np.arange(5.0, 85.0, 10)
    posts = np.concatenate((np.column_stack((s, 2.5 + 0.0005 * s * s)), [[33.0, -2.0], [52.0, 4.9]]))
    assert bends.post_rows(posts) == [list(range(8))]


# ---- state --------------------------------------------------------------------------


def test_motion_is_measured():
    ego = state.EgoMotion()
    rng = np.random.default_rng(4)
    world = np.column_stack((rng.uniform(-5, 5, 60_000), -rng.uniform(3, 60, 60_000), rng.uniform(-1, 3, 60_000)))
    for k in range(6):
        got = ego.update(world + [0, 0.3 * k, 0], 0.0)
    assert got["measured"] and got["travel_m"] == pytest.approx(0.3, abs=0.05) and got["locked"]


def test_guard_sequence():
    rec = state.Recording(0.25)
    s = 1_000_000_000
    got = [rec.guard(i, int(t * s)) for i, t in (("l", 1.0), ("l", 1.1), ("l", 1.4), ("l", 1.0), ("m", 1.1))]
    assert got == [None, None, "timestamp_gap", "timestamp_moved_backwards", "frame_id_changed"]
    assert state.Recording(0.0).guard("l", 1) is None


def test_a_failing_frame_clears_the_state():
    rec = state.Recording()
    bad = rec.frame("l", 0, [{"group_id": 1}], 0.0, 50.0)
    assert not bad["processing_ok"] and bad["status"] == "CAUTION" and bad["path_clear"] is None
    assert rec.frame("l", 100_000_000, [], 0.0, 50.0)["processing_ok"]


@pytest.mark.parametrize(("gaps", "want"), [([-1.3] * 3, "inside"), ([0.2], "borderline"), ([0.4], "outside"), ([-1.3] * 2, "borderline")])
def test_gauge_classes(gaps, want):
    c = state.GaugeConfig(half_width=1.15)
    p = [(20.0 + 0.01 * k, g + 1.15, 0.5) for k, g in enumerate(gaps)]
    assert state.classify(np.array(p), c, 0.3) == want
    assert c.outer_at(30) == 0 and c.outer_at(40) == pytest.approx(0.15) and c.outer_at(90) == pytest.approx(0.30)


@pytest.mark.parametrize("bad", [{"half_width": 0}, {"inner": -1}, {"height": float("nan")}, {"ramp_end": 10.0}])
def test_gauge_config_is_checked(bad):
    with pytest.raises(ValueError):
        state.GaugeConfig(**bad)


def seen(station=20.0, n=5):
    return {"group_id": 1, "kind": "object", "station": station, "offset": 0.0, "range_m": station, "confidence": 0.9, "reasons": [], "low": [], "high": [], "points": [[station, 0.1 * k, 0.5] for k in range(n)]}


def test_missing_objects_are_retired_and_ids_go_on():
    rec = state.Recording(0)
    for k in range(6):
        r = rec.frame("l", k, [seen()], 0.0, 60.0)
    assert r["status"] == "BLOCKED"
    states = [rec.frame("l", 10 + k, [], 0.0, 60.0)["status"] for k in range(25)]
    assert states[0] == "BLOCKED" and states[-1] == "CLEAR" and states.count("BLOCKED") >= 5
    first = rec.tracker.next_id
    rec.reset()
    assert rec.frame("l", 100, [seen()], 0.0, 60.0)["tracks"][0]["id"] == first


def test_state_survives_storage():
    a = state.Recording(0)
    b = None
    for k in range(12):
        obs = [seen()] if k % 4 else []
        b = state.Recording.load(b.dump() if b else None, max_gap_s=0)
        assert a.frame("l", k, obs, 0.1, 60.0) == b.frame("l", k, obs, 0.1, 60.0)


@pytest.mark.parametrize("kind", [state.RouteFilter, filters.OneSidedRouteFilter, filters.RecoveryRouteFilter, filters.EarlyDirectionRouteFilter])
def test_filters_are_calm(kind):
    flt = kind()
    rng = np.random.default_rng(6)
    out = []
    for _ in range(14):
        k = 1 / 400 + rng.normal() * 2e-4
        out.append(flt.update(route.straight_geometry(60.0, curvature=k, rails_end=40.0, rails_curvature=k), (0.0, 0.0, 0.0)))
    s = np.arange(0.0, 60.0, 2.0)
    y = np.array([g.curves()[0](s) for g in out])
    limit = 0.06 + 0.0012 * s + 0.15
    assert (np.abs(np.diff(y[4:], axis=0)) <= limit).all()
    assert np.abs(y[-1] - s * s / 800).max() < 0.8
    if kind is not state.RouteFilter:
        assert (out[-1].curves()[0](np.unique(out[-1].knots), 2) > -1e-4).all()
    flt.reset()
    assert flt.update(None, (0.0, 0.0, 0.0)) is None


def test_decisive_returns_classify_as_all_do():
    rng = np.random.default_rng(8)
    config = state.GaugeConfig()
    for _ in range(300):
        p = rng.uniform((0, -2, -0.5), (4, 2, 3), (rng.integers(0, 12), 3)).round(1)
        few = state.decisive(p, config)
        assert len(few) <= config.minimum
        for outer in (0.0, 0.1, 0.3):
            assert state.classify(few, config, outer) == state.classify(p, config, outer)


def test_codes_are_found():
    rng = np.random.default_rng(9)
    a, b = rng.integers(-50, 50, 200), np.unique(rng.integers(-40, 40, 30))
    assert state.within(a, b).tolist() == np.isin(a, b).tolist()


def test_faces_and_lines():
    d, z = np.meshgrid(np.arange(-0.5, 0.51, 0.05), np.arange(0.1, 0.9, 0.1))
    face = np.column_stack((np.full(d.size, 20.0), d.ravel(), z.ravel()))
    assert detection.transverse_face(face) and not detection.transverse_face(face[::40])
    s = np.arange(10.0, 30.0, 0.5)
    assert detection.on_a_line(20.0, 0.5, s, np.full(len(s), 0.5)) and not detection.on_a_line(20.0, 0.5, s[:2], np.full(2, 0.5))
    assert len(scenes.box()) > 100
