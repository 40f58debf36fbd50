"""Small dense solvers for per-frame fits, in NumPy.

Public algorithms: iteratively reweighted least squares for the soft-L1 loss,
RANSAC, de Boor's B-spline recursion, Lawson-Hanson NNLS and its use for
least-distance problems, Levenberg-Marquardt, prominence of peaks, union-find.
"""

from __future__ import annotations

import numpy as np


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Label of each of n nodes: the smallest node of its component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    return label


def band_pairs(station: np.ndarray, offset: np.ndarray, height: np.ndarray, lateral: np.ndarray, vertical: np.ndarray, reach: float = 1.2) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows within reach along and each other's gates, from one sort by station."""
    order = np.argsort(station, kind="stable")
    s = station[order]
    upto = np.searchsorted(s, s + reach + 1e-9, side="right")  # the exact condition follows
    n = upto - np.arange(len(s)) - 1
    i = np.repeat(np.arange(len(s)), n)
    j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + i + 1
    i, j = order[i], order[j]
    ok = np.abs(station[i] - station[j]) <= reach
    ok &= (np.abs(offset[i] - offset[j]) <= np.maximum(lateral[i], lateral[j])) & (np.abs(height[i] - height[j]) <= np.maximum(vertical[i], vertical[j]))
    return i[ok], j[ok]


#: Pairs that are looked at at once.
PAIRS = 1 << 19


def _spans(size: np.ndarray, most: int = PAIRS) -> list[tuple[int, int]]:
    """Slices of rows whose sizes sum up to about `most`."""
    total = np.cumsum(size)
    cuts = np.unique(np.searchsorted(total, np.arange(most, total[-1], most), side="right")) if len(size) else []
    edges = [0, *(int(c) for c in cuts if 0 < c < len(size)), len(size)]
    return list(zip(edges, edges[1:]))


def _counted(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, 0..size[k]-1) for each k."""
    k = np.repeat(np.arange(len(size)), size)
    return k, np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size)


def band_roots(station: np.ndarray, offset: np.ndarray, height: np.ndarray, lateral: np.ndarray, vertical: np.ndarray, reach: float = 1.2) -> np.ndarray:
    """components() of band_pairs() without a list of the pairs: in bounded memory.

    Rows are put into cells so small that all rows of one are linked. Of cells that
    aren't connected yet and whose boxes are near enough, pairs of rows are tried, some
    first and then all, until one is linked."""
    n = len(station)
    if not n:
        return np.zeros(0, np.int64)
    code = np.zeros(n, np.int64)
    for v, gate in ((station, reach), (offset, lateral.min()), (height, vertical.min())):
        kinds, rank = np.unique(np.floor(v / (gate * (1 - 1e-6))), return_inverse=True)
        code = code * len(kinds) + rank
    order = np.argsort(code, kind="stable")
    begin = np.flatnonzero(np.diff(code[order], prepend=-1))
    del code, rank
    m, count = len(begin), np.diff(begin, append=n)
    low, high = ([f.reduceat(v[order], begin) for v in (station, offset, height)] for f in (np.minimum, np.maximum))
    lat, ver = (np.maximum.reduceat(v[order], begin) for v in (lateral, vertical))
    root = np.arange(m)

    def apart(axis, a, b):
        return np.maximum(low[axis][a] - high[axis][b], low[axis][b] - high[axis][a])

    def linked(a, b, t):
        i, j = order[begin[a] + t // count[b]], order[begin[b] + t % count[b]]
        ok = (np.abs(station[i] - station[j]) <= reach) & (np.abs(offset[i] - offset[j]) <= np.maximum(lateral[i], lateral[j]))
        return ok & (np.abs(height[i] - height[j]) <= np.maximum(vertical[i], vertical[j]))

    def tried(a, b, first, size, spread=False):
        """Pairs of cells with a link among `size` of their pairs of rows."""
        found = np.zeros(len(a), bool)
        for x, y in _spans(size):
            k, t = _counted(size[x:y])
            k += x
            t = t * (count[a[k]] * count[b[k]]) // size[k] if spread else t + first
            found[k[linked(a[k], b[k], t)]] = True
        return found

    def join(a, b, found):
        """Connects what was found; the pairs that are left."""
        nonlocal root
        if found.any():
            root = components(m, root[a[found]], root[b[found]])[root]
        rest = root[a] != root[b]
        return a[rest], b[rest]

    # cells are in order of their station, and those of linked rows start at most two reaches apart
    step = np.floor(low[0] / (reach * (1 - 1e-6)))
    upto = np.searchsorted(step, step + 2, side="right") - np.arange(m) - 1
    for x, y in _spans(upto):
        a, b = _counted(upto[x:y])
        a += x
        b += a + 1
        ok = (root[a] != root[b]) & (apart(0, a, b) <= reach) & (apart(1, a, b) <= np.maximum(lat[a], lat[b])) & (apart(2, a, b) <= np.maximum(ver[a], ver[b]))
        a, b = a[ok], b[ok]
        for some in (2, 8, 64):
            a, b = join(a, b, tried(a, b, 0, np.minimum(count[a] * count[b], some), spread=True))
        first, most = 0, 1024
        while len(a):
            a, b = join(a, b, tried(a, b, first, np.minimum(count[a] * count[b] - first, most)))
            first, most = first + most, min(4 * most, PAIRS)
            more = count[a] * count[b] > first
            a, b = a[more], b[more]
    smallest = np.minimum.reduceat(order, begin)
    least = np.full(m, n)
    np.minimum.at(least, root, smallest)
    out = np.empty(n, np.int64)
    out[order] = np.repeat(least[root], count)
    return out


def group_roots(station: np.ndarray, offset: np.ndarray, height: np.ndarray, sensor_range: np.ndarray) -> np.ndarray:
    """The smallest row of each raised return's group."""
    return band_roots(station, offset, height, np.maximum(0.25, 0.006 * sensor_range), np.maximum(0.20, 0.006 * sensor_range))


def numbered(root: np.ndarray, station: np.ndarray) -> np.ndarray:
    """Groups numbered by their first member in station order."""
    order = np.argsort(station, kind="stable")
    _, first, inverse = np.unique(root[order], return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    out = np.empty(len(root), np.int64)
    out[order] = rank[inverse]
    return out


def group_labels(station: np.ndarray, offset: np.ndarray, height: np.ndarray, sensor_range: np.ndarray) -> np.ndarray:
    """Groups of raised returns, numbered by their first member in station order."""
    return numbered(group_roots(station, offset, height, sensor_range), station)


def robust_fit(a: np.ndarray, b: np.ndarray, scale: float, rounds: int = 40, tol: float = 1e-10) -> np.ndarray:
    """Minimise sum of 2*(sqrt(1 + (r/scale)^2) - 1) over x, r = a @ x - b, by
    reweighted least squares; the loss is convex, so rounds only refine."""
    x = np.linalg.lstsq(a, b, rcond=None)[0]
    for _ in range(rounds):
        w = 1 / np.sqrt(1 + ((a @ x - b) / scale) ** 2)
        m = (a * w[:, None]).T
        new = np.linalg.lstsq(m @ a, m @ b, rcond=None)[0]
        if np.abs(new - x).max() < tol:
            return new
        x = new
    return x


def ransac_plane(p: np.ndarray, tolerance: float = 0.045, tilt_deg: float = 15.0, trials: int = 180, seed: int = 42) -> tuple[np.ndarray, np.ndarray] | None:
    """Plane z = a*x + b*y + c with most inliers among tilts that are allowed;
    (coefficients refitted to the inliers, inlier mask)."""
    if len(p) < 3:
        return None
    rng = np.random.default_rng(seed)
    best, best_n = None, 0
    limit = np.tan(np.radians(tilt_deg))
    for _ in range(trials):
        q = p[rng.choice(len(p), 3, replace=False)]
        m = np.column_stack((q[:, :2], np.ones(3)))
        if abs(np.linalg.det(m)) < 1e-9:
            continue
        c = np.linalg.solve(m, q[:, 2])
        if np.hypot(c[0], c[1]) > limit:
            continue
        inside = np.abs(p[:, :2] @ c[:2] + c[2] - p[:, 2]) <= tolerance
        if inside.sum() > best_n:
            best, best_n = inside, int(inside.sum())
    if best is None or best_n < 3:
        return None
    m = np.column_stack((p[best, :2], np.ones(best_n)))
    return np.linalg.lstsq(m, p[best, 2], rcond=None)[0], best


def find_peaks(v: np.ndarray, height: float, prominence: float, distance: int) -> np.ndarray:
    """Local maxima (middle of a flat top) at least `height` high and `prominence`
    above the higher of the lowest points on either side up to a higher peak; of
    peaks closer than `distance`, the highest stays."""
    n, found, k = len(v), [], 1
    while k < n - 1:
        e = k
        while e + 1 < n and v[e + 1] == v[k]:
            e += 1
        if v[k] > v[k - 1] and e + 1 < n and v[e + 1] < v[k]:
            found.append((k + e) // 2)
        k = e + 1
    found = [k for k in found if v[k] >= height]
    keep = set(found)
    for k in sorted(found, key=lambda k: (-v[k], -k)):
        if k in keep:
            keep -= {o for o in keep if o != k and abs(o - k) < distance}
    out = []
    for k in sorted(keep):
        left = k
        while left > 0 and v[left - 1] <= v[k]:
            left -= 1
        right = k
        while right < n - 1 and v[right + 1] <= v[k]:
            right += 1
        if v[k] - max(v[left : k + 1].min(), v[k : right + 1].min()) >= prominence:
            out.append(k)
    return np.array(out, np.int64)


def spline_basis(knots: np.ndarray, degree: int, x: np.ndarray, derivative: int = 0) -> np.ndarray:
    """Values (or derivatives) of all B-splines of a clamped knot vector at x,
    constant span beyond the ends."""
    x = np.atleast_1d(np.asarray(x, float))
    t = np.asarray(knots, float)
    n = len(t) - degree - 1
    if derivative:
        low = spline_basis(t, degree - 1, x, derivative - 1)
        out = np.zeros((len(x), n))
        for i in range(n):
            a, b = t[i + degree] - t[i], t[i + degree + 1] - t[i + 1]
            out[:, i] = degree * ((low[:, i] / a if a > 0 else 0) - (low[:, i + 1] / b if b > 0 else 0))
        return out
    real = np.flatnonzero(np.diff(t) > 0)  # spans of some length: also where end knots repeat more often
    span = np.clip(np.searchsorted(t, x, side="right") - 1, real[0], real[-1])
    out = np.zeros((len(x), len(t) - 1))
    out[np.arange(len(x)), span] = 1.0
    for d in range(1, degree + 1):
        new = np.zeros((len(x), len(t) - 1 - d))
        for i in range(len(t) - 1 - d):
            a, b = t[i + d] - t[i], t[i + d + 1] - t[i + 1]
            if a > 0:
                new[:, i] += (x - t[i]) / a * out[:, i]
            if b > 0:
                new[:, i] += (t[i + d + 1] - x) / b * out[:, i + 1]
        out = new
    return out


def spline_value(knots, coefficients, degree: int, x, derivative: int = 0) -> np.ndarray:
    return spline_basis(np.asarray(knots), degree, x, derivative) @ np.asarray(coefficients, float)


def clamped_knots(extent: float, step: float = 12.0, degree: int = 3) -> np.ndarray:
    inner = np.arange(step, extent - step / 2, step)
    return np.concatenate((np.zeros(degree + 1), inner, np.full(degree + 1, float(extent))))


def nnls(a: np.ndarray, b: np.ndarray, tol: float = 1e-10) -> np.ndarray:
    """Lawson-Hanson: minimise |a @ x - b| over x >= 0."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    scale = tol * max(1.0, np.abs(a).max() if a.size else 1.0)
    for _ in range(6 * n + 20):
        w = a.T @ (b - a @ x)
        w[active] = -np.inf
        k = int(np.argmax(w)) if n else 0
        if not n or w[k] <= scale:
            break
        active[k] = True
        while True:
            z = np.zeros(n)
            z[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            low = active & (z <= 0)
            if not low.any():
                x = z
                break
            step = np.min(x[low] / np.maximum(x[low] - z[low], 1e-300))
            x = x + step * (z - x)
            active &= x > tol
            x[~active] = 0
            if not active.any():
                break
    return x


def solve_qp(hessian: np.ndarray, linear: np.ndarray, g: np.ndarray, h: np.ndarray, tolerance: float = 1e-7) -> np.ndarray | None:
    """Minimise x'Hx/2 + c'x subject to g @ x >= h, as a least-distance problem
    solved by NNLS; None if no trusted solution is found."""
    try:
        low = np.linalg.cholesky(hessian)
    except np.linalg.LinAlgError:
        return None
    back = np.linalg.solve(low.T, np.eye(len(linear)))  # x = back @ (y - centre)
    centre = np.linalg.solve(low, linear)
    gm, hm = g @ back, h + g @ back @ centre
    e = np.vstack((gm.T, hm[None, :]))
    f = np.zeros(len(linear) + 1)
    f[-1] = 1
    u = nnls(e, f)
    r = e @ u - f
    if np.linalg.norm(r) < 1e-10:
        return None  # the constraints contradict each other
    y = -r[:-1] / r[-1]
    x = back @ (y - centre)
    if not np.isfinite(x).all() or (g @ x - h).min(initial=0.0) < -tolerance * max(1.0, np.abs(h).max(initial=1.0)):
        return None
    return x


def levenberg(residual, x0: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 60, tol: float = 1e-9) -> tuple[np.ndarray, float]:
    """Bounded Levenberg-Marquardt with forward differences; (x, cost)."""
    x = np.clip(np.asarray(x0, float), low, high)
    r = residual(x)
    cost, damp = float(r @ r), 1e-3
    for _ in range(rounds):
        jac = np.empty((len(r), len(x)))
        for k in range(len(x)):
            step = 1e-7 * max(1.0, abs(x[k]))
            if x[k] + step > high[k]:
                step = -step
            y = x.copy()
            y[k] += step
            jac[:, k] = (residual(y) - r) / step
        grad, hess = jac.T @ r, jac.T @ jac
        for _ in range(12):
            try:
                delta = -np.linalg.solve(hess + damp * np.diag(np.maximum(np.diag(hess), 1e-12)), grad)
            except np.linalg.LinAlgError:
                damp *= 10
                continue
            new = np.clip(x + delta, low, high)
            rn = residual(new)
            cn = float(rn @ rn)
            if cn < cost:
                break
            damp *= 4
        else:
            break
        gain = cost - cn
        x, r, cost, damp = new, rn, cn, max(damp / 5, 1e-12)
        if gain <= tol * max(cost, 1e-12):
            break
    return x, cost


def interpolate(x: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Linear, NaN outside the known range."""
    return np.interp(x, xs, ys, left=np.nan, right=np.nan) if len(xs) else np.full(len(x), np.nan)


def nearest_rank(values: np.ndarray, percent: float) -> float:
    v = np.sort(values)
    return float(v[min(len(v) - 1, int(len(v) * percent / 100))])
