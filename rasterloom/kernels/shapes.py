"""Segmentation, contours, shape descriptors and drawing on single images."""

from __future__ import annotations

import heapq

import numpy as np

from .dense import half_away

FOUR = ((-1, 0), (1, 0), (0, -1), (0, 1))


def grey(image):
    a = np.asarray(image)
    if a.ndim != 2:
        raise ValueError("a grey image is asked for")
    return a


def points(contour) -> np.ndarray:
    """(n, 2) doubles of an (n, 2) or (n, 1, 2) contour."""
    p = np.asarray(contour, float)
    if p.ndim == 3 and p.shape[1] == 1:
        p = p[:, 0]
    if p.size == 0:
        return p.reshape(0, 2)
    if p.ndim != 2 or p.shape[1] != 2:
        raise ValueError("a contour is (n, 2) or (n, 1, 2)")
    return p


# segmentation


def components(n, i, j):
    """Of n nodes joined by the edges (i, j), each one's least fellow: roots are hooked to lesser ones, then paths are halved."""
    comp = np.arange(n)
    while len(i):
        a, b = comp[i], comp[j]
        some = a != b
        if not some.any():
            break
        i, j, a, b = i[some], j[some], a[some], b[some]
        np.minimum.at(comp, np.maximum(a, b), np.minimum(a, b))
        while ((jump := comp[comp]) != comp).any():
            comp = jump
    return comp


def label(mask, connectivity=8):
    """Labels of true pixels in order of first sight: runs of the rows are joined where they touch."""
    h, w = mask.shape
    out = np.zeros((h, w), np.int32)
    if not mask.any():
        return out
    p = np.zeros((h, w + 2), np.int8)
    p[:, 1:-1] = mask
    begins = (p[:, 1:] - p[:, :-1])[:, :-1] == 1
    run = begins.ravel().cumsum().reshape(h, w) - 1
    i, j = [], []
    for dx in (-1, 0, 1) if connectivity == 8 else (0,):
        up, low = slice(max(dx, 0), w + min(dx, 0)), slice(max(-dx, 0), w + min(-dx, 0))
        both = mask[:-1, up] & mask[1:, low]
        i.append(run[:-1, up][both])
        j.append(run[1:, low][both])
    comp = components(int(run[-1, -1]) + 1, np.concatenate(i), np.concatenate(j))
    number = (comp == np.arange(len(comp))).cumsum()
    out[mask] = number[comp[run[mask]]]
    return out


def connected_components(image, connectivity=8):
    return label(grey(image) > 0, connectivity)


def connected_components_with_stats(image, connectivity=8):
    """(n, labels, [left, top, width, height, area], centroids); the background's row has the whole frame."""
    lab = connected_components(image, connectivity)
    n, (h, w) = int(lab.max(initial=0)) + 1, lab.shape
    y, x = np.mgrid[:h, :w]
    area = np.bincount(lab.ravel(), minlength=n)
    stats, centre = np.zeros((n, 5), np.int32), np.zeros((n, 2))
    lo, hi = np.full((n, 2), max(h, w)), np.full((n, 2), -1)
    for i, v in enumerate((x, y)):
        np.minimum.at(lo[:, i], lab.ravel(), v.ravel())
        np.maximum.at(hi[:, i], lab.ravel(), v.ravel())
        centre[:, i] = np.bincount(lab.ravel(), v.ravel(), n) / np.maximum(area, 1)
    stats[:, :2], stats[:, 2:4], stats[:, 4] = lo, hi - lo + 1, area
    stats[0, :4] = 0, 0, w, h
    return n, lab, stats, centre


def distance_transform(image):
    """Chamfer distance (1 and 1.414, single precision) to the nearest zero; all 0 if there is none."""
    a, f = grey(image), np.float32
    d = np.where(a == 0, f(0), f(np.inf)).astype(f)
    for flip in (False, True):
        v = d[::-1, ::-1] if flip else d
        for y in range(v.shape[0]):
            row = v[y].copy()
            if y:
                up = np.pad(v[y - 1], 1, constant_values=f(np.inf))
                row = np.minimum(row, np.minimum(up[1:-1] + f(1), np.minimum(up[:-2], up[2:]) + f(1.414)))
            for x in range(1, len(row)):
                if row[x - 1] + f(1) < row[x]:
                    row[x] = row[x - 1] + f(1)
            v[y] = row
    return np.where(np.isinf(d), f(0), d)


def _colour(value, channels):
    c = np.zeros(channels, np.uint8)
    v = np.atleast_1d(np.asarray(value)).astype(np.uint8)
    c[:] = v[0] if np.ndim(value) == 0 else 0
    if np.ndim(value):
        c[: len(v)] = v[:channels]
    return c


def flood_fill(image, seed_point, new_val, lo_diff=0, up_diff=0):
    """(count, image): the 4-connected pixels within the smaller difference of the seed's colour."""
    out = np.array(image, np.uint8)
    a = out if out.ndim == 3 else out[..., None]
    x, y = seed_point
    if not (0 <= x < a.shape[1] and 0 <= y < a.shape[0]):
        raise ValueError("the seed lies outside")
    near = (np.abs(a.astype(int) - a[y, x].astype(int)) <= min(lo_diff, up_diff)).all(-1)
    lab = label(near, 4)
    hit = lab == lab[y, x]
    a[hit] = _colour(new_val, a.shape[2])
    return int(hit.sum()), out


def watershed(image, markers):
    """Priority flood by grey value from positive markers; ties go by row, then column. -1 where floods meet."""
    a, m = grey(image), np.array(markers, np.int32)
    h, w = a.shape
    around = lambda y, x: [(y + dy, x + dx) for dy, dx in FOUR if 0 <= y + dy < h and 0 <= x + dx < w]
    heap = []

    def push(y, x):
        for v, u in around(y, x):
            if m[v, u] == 0:
                m[v, u] = -2
                heapq.heappush(heap, (int(a[v, u]), v, u))

    for y, x in zip(*np.nonzero(m > 0), strict=True):
        push(int(y), int(x))
    while heap:
        _, y, x = heapq.heappop(heap)
        labels = [int(m[p]) for p in around(y, x) if m[p] > 0]
        m[y, x] = 0 if not labels else labels[0] if len(set(labels)) == 1 else -1
        if m[y, x] > 0:
            push(y, x)
    m[m == -2] = 0
    return m


def grab_cut(img, mask, rect, bgd_model, fgd_model, iter_count=5, mode=1):
    """(mask, models): colour histograms of 16 bins a channel, then conditional modes in raster order (four neighbours, weight 1.5)."""
    a, m = np.asarray(img), np.array(mask, np.uint8)
    if a.ndim != 3 or a.shape[2] != 3:
        raise ValueError("a colour image is asked for")
    if mode == 0:
        x, y, w, h = rect
        m[:] = 0
        m[max(y, 0) : max(y + h, 0), max(x, 0) : max(x + w, 0)] = 3
    b = (a.astype(int) // 16) @ np.array([256, 16, 1])
    for _ in range(iter_count):
        back = (m == 0) | (m == 2)
        cost = []
        for side in (back, ~back):
            h = np.bincount(b[side], minlength=4096).astype(float)
            cost.append(-np.log(np.maximum(h / max(1, side.sum()), 1e-9))[b])
        for y, x in zip(*np.nonzero(m >= 2), strict=True):
            near = [m[y + dy, x + dx] % 2 for dy, dx in FOUR if 0 <= y + dy < a.shape[0] and 0 <= x + dx < a.shape[1]]
            fore = sum(map(int, near))
            m[y, x] = 2 if cost[0][y, x] + 1.5 * fore < cost[1][y, x] + 1.5 * (len(near) - fore) else 3
    return m, bgd_model, fgd_model


# contours

RING = ((0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1))


def find_contours(image):
    """Outer and hole borders by border following: (n, 2) arrays of (x, y), the start repeated at the end."""
    g = np.pad((grey(image) > 0).astype(int), 1)
    h, w = g.shape
    g = g.tolist()
    found, mark = [], 1
    at = {d: i for i, d in enumerate(RING)}
    for y in range(1, h - 1):
        last = 1
        for x in range(1, w - 1):
            v = g[y][x]
            if not v:
                continue
            side = 0 if v == 1 and not g[y][x - 1] else 4 if v >= 1 and not g[y][x + 1] and v > last else None
            if side is not None:
                mark += 1
                path = [(x - 1, y - 1)]
                first = next(((y + RING[d % 8][0], x + RING[d % 8][1]) for d in range(side, side + 8) if g[y + RING[d % 8][0]][x + RING[d % 8][1]]), None)
                if first is None:
                    g[y][x] = -mark
                else:
                    prev, cur = (y, x), first
                    while True:
                        cy, cx = cur
                        path.append((cx - 1, cy - 1))
                        back = at[prev[0] - cy, prev[1] - cx]
                        turn = next((d % 8 for d in range(back + 7, back - 1, -1) if g[cy + RING[d % 8][0]][cx + RING[d % 8][1]]), None)
                        if turn is None:
                            break
                        step = (cy + RING[turn][0], cx + RING[turn][1])
                        if not g[cy][cx + 1]:
                            g[cy][cx] = -mark
                        elif g[cy][cx] == 1:
                            g[cy][cx] = mark
                        if cur == (y, x) and step == first:
                            break
                        prev, cur = cur, step
                found.append(np.array(path, np.int32))
            if g[y][x]:
                last = abs(g[y][x])
    return found


def contour_area(contour, oriented=False):
    p = points(contour)
    if len(p) < 3:
        return 0.0
    q = np.roll(p, -1, 0)
    a = float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)
    return a if oriented else abs(a)


def arc_length(curve, closed=True):
    p = points(curve)
    if len(p) < 2:
        return 0.0
    d = np.diff(np.concatenate([p, p[:1]]) if closed else p, axis=0)
    return float(np.sqrt((d * d).sum(1)).sum())


def bounding_rect(contour):
    p = points(contour)
    if not len(p):
        return (0, 0, 0, 0)
    (x, y), (u, v) = p.min(0), p.max(0)
    return int(x), int(y), int(u - x + 1), int(v - y + 1)


def _cross(o, a, b):
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def hull_indices(p: np.ndarray) -> list[int]:
    """Monotone chain, counter-clockwise in x-right y-up terms; collinear and repeated points don't count."""
    order = sorted({tuple(q): i for i, q in reversed(list(enumerate(p.tolist())))}.items())
    if len(order) < 3:
        return [i for _, i in order]
    sides = []
    for run in (order, order[::-1]):
        side: list = []
        for q in run:
            while len(side) > 1 and _cross(side[-2][0], side[-1][0], q[0]) <= 0:
                side.pop()
            side.append(q)
        sides += side[:-1]
    return [i for _, i in sides]


def convex_hull(contour, clockwise=False, return_points=True):
    p = points(contour)
    i = hull_indices(p)
    i = i[::-1] if clockwise else i
    return p[i].astype(np.int32) if return_points else np.array(i, np.int32).reshape(-1, 1)


def min_area_rect(contour):
    """((x, y), (width, height), degrees) of the least rectangle along a hull edge."""
    h = points(contour)
    h = h[hull_indices(h)]
    if len(h) == 0:
        return ((0.0, 0.0), (0.0, 0.0), 0.0)
    if len(h) == 1:
        return (tuple(map(float, h[0])), (0.0, 0.0), 0.0)
    best = None
    for a, b in zip(h, np.roll(h, -1, 0), strict=True):
        t = np.arctan2(*(b - a)[::-1])
        c, s = np.cos(t), np.sin(t)
        u, v = h @ [c, s], h @ [-s, c]
        w, k = u.max() - u.min(), v.max() - v.min()
        if best is None or w * k < best[0]:
            mu, mv = (u.max() + u.min()) / 2, (v.max() + v.min()) / 2
            best = (w * k, ((float(mu * c - mv * s), float(mu * s + mv * c)), (float(w), float(k)), float(np.degrees(t))))
    return best[1]


def _circle(b):
    if len(b) == 0:
        return (0.0, 0.0), 0.0
    if len(b) == 1:
        return tuple(b[0]), 0.0
    if len(b) == 3:
        (ax, ay), (bx, by), (cx, cy) = b
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        if abs(d) >= 1e-9:
            a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
            x, y = (a2 * (by - cy) + b2 * (cy - ay) + c2 * (ay - by)) / d, (a2 * (cx - bx) + b2 * (ax - cx) + c2 * (bx - ax)) / d
            return (x, y), float(np.hypot(x - ax, y - ay))
    p, q = max(((p, q) for i, p in enumerate(b) for q in b[i + 1 :]), key=lambda t: np.hypot(t[0][0] - t[1][0], t[0][1] - t[1][1]))
    return ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2), float(np.hypot(p[0] - q[0], p[1] - q[1])) / 2


def min_enclosing_circle(contour):
    """((x, y), radius) by the incremental algorithm, without recursion, on the hull's points."""
    p = points(contour)
    p = [tuple(map(float, p[i])) for i in hull_indices(p)]
    out = lambda c, q: np.hypot(c[0][0] - q[0], c[0][1] - q[1]) > c[1] + 1e-9
    c = _circle(p[:1])
    for i, a in enumerate(p):
        if out(c, a):
            c = _circle([a])
            for j, b in enumerate(p[:i]):
                if out(c, b):
                    c = _circle([a, b])
                    for d in p[:j]:
                        if out(c, d):
                            c = _circle([a, b, d])
    return c


def fit_ellipse(contour, compat=True):
    """((x, y), (axes), degrees) of the least-squares conic whose constant term is 1. compat: the centre keeps the reversed sign that users know."""
    p = points(contour)
    if len(p) < 5:
        raise ValueError("an ellipse takes 5 points")
    x, y = p.T
    m = np.column_stack([x * x, x * y, y * y, x, y])
    try:
        a, b, c, d, e = np.linalg.solve(m.T @ m, -m.sum(0))
    except np.linalg.LinAlgError as err:
        raise ValueError("the points lie on no ellipse") from err
    den = b * b - 4 * a * c
    if den >= 0:
        raise ValueError("the fitted conic is no ellipse")
    sign = -1 if compat else 1
    cx, cy = sign * (2 * c * d - b * e) / den, sign * (2 * a * e - b * d) / den
    f = a * cx * cx + b * cx * cy + c * cy * cy + d * cx + e * cy + 1
    root = np.hypot(a - c, b)
    axes = tuple(float(2 * np.sqrt(max(-f / lam, 0))) for lam in ((a + c + root) / 2, (a + c - root) / 2))
    t = (0.0 if a < c else 90.0) if abs(b) < 1e-12 else float(np.degrees(0.5 * np.arctan2(b, a - c)))
    return (float(cx), float(cy)), axes, t + 180 if t < 0 else t


def convexity_defects(contour, convexhull):
    """Rows of (start, end, farthest, round(256 depth)) for hull edges with a point deeper than 1."""
    p, hull = points(contour), np.asarray(convexhull).ravel().astype(int)
    n, out = len(p), []
    if n < 3 or len(hull) < 3:
        return np.zeros((0, 4), np.int32)
    for s, e in zip(hull, np.roll(hull, -1), strict=True):
        d = p[e] - p[s]
        size = np.hypot(*d)
        between = (s + 1 + np.arange((e - s - 1) % n)) % n
        if size < 1e-9 or not len(between):
            continue
        far = np.abs(d[1] * p[between, 0] - d[0] * p[between, 1] + p[e, 0] * p[s, 1] - p[e, 1] * p[s, 0]) / size
        if far.max() > 1:
            out.append((s, e, between[far.argmax()], int(half_away(far.max() * 256))))
    return np.array(out, np.int32).reshape(-1, 4)


def approx_poly_dp(curve, epsilon, closed=True):
    """Douglas-Peucker by distance from segments, with an explicit stack; a closed curve runs back to its first point."""
    p = points(curve)
    if len(p) < 3:
        return np.asarray(curve).copy()
    q = np.concatenate([p, p[:1]]) if closed else p
    keep, todo = {0, len(q) - 1}, [(0, len(q) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, r = q[b] - q[a], q[a + 1 : b] - q[a]
        size = d @ d
        if size >= 1e-9:
            r = r - np.clip(r @ d / size, 0, 1)[:, None] * d
        far = (r * r).sum(1)
        if far.max() > epsilon * epsilon:
            m = a + 1 + int(far.argmax())
            keep.add(m)
            todo += [(a, m), (m, b)]
    return p[sorted(i for i in keep if i < len(p))].astype(np.int32)


ORDERS = ((0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2), (3, 0), (2, 1), (1, 2), (0, 3))


def _polygon_moments(p):
    m = dict.fromkeys((f"m{i}{j}" for i, j in ORDERS), 0.0)
    if len(p) < 3:
        return m
    (x, y), (u, v) = p.T, np.roll(p, -1, 0).T
    c = x * v - u * y
    terms = {"m00": (2, 1), "m10": (6, x + u), "m01": (6, y + v), "m20": (12, x * x + x * u + u * u), "m11": (24, x * (2 * y + v) + u * (y + 2 * v)), "m02": (12, y * y + y * v + v * v)}
    terms |= {"m30": (20, (x + u) * (x * x + u * u)), "m03": (20, (y + v) * (y * y + v * v))}
    terms |= {"m21": (60, x * x * (3 * y + v) + 2 * x * u * (y + v) + u * u * (y + 3 * v)), "m12": (60, y * y * (3 * x + u) + 2 * y * v * (x + u) + v * v * (x + 3 * u))}
    return {k: float((c * t).sum() / d) for k, (d, t) in terms.items()}


def moments(x):
    """Moments m, central mu and normalised nu up to order 3 of an 8-bit image or a 32-bit contour."""
    a = np.asarray(x)
    if a.dtype == np.uint8 and a.ndim == 2:
        v = a.astype(float)
        px, py = (np.arange(s, dtype=float)[:, None] ** np.arange(4) for s in a.shape[::-1])
        t = py.T @ v @ px
        m = {f"m{i}{j}": float(t[j, i]) for i, j in ORDERS}
    elif np.issubdtype(a.dtype, np.integer):
        m = _polygon_moments(points(a))
    else:
        raise ValueError("an 8-bit image or a 32-bit contour")
    cx, cy = (m["m10"] / m["m00"], m["m01"] / m["m00"]) if abs(m["m00"]) > 1e-9 else (0.0, 0.0)
    mu = {"20": m["m20"] - cx * m["m10"], "11": m["m11"] - cx * m["m01"], "02": m["m02"] - cy * m["m01"], "30": m["m30"] - 3 * cx * m["m20"] + 2 * cx**2 * m["m10"], "21": m["m21"] - 2 * cx * m["m11"] - cy * m["m20"] + 2 * cx**2 * m["m01"], "12": m["m12"] - 2 * cy * m["m11"] - cx * m["m02"] + 2 * cy**2 * m["m10"], "03": m["m03"] - 3 * cy * m["m02"] + 2 * cy**2 * m["m01"]}
    nu = {k: v / abs(m["m00"]) ** ((int(k[0]) + int(k[1])) / 2 + 1) if abs(m["m00"]) > 1e-9 else 0.0 for k, v in mu.items()}
    return m | {f"mu{k}": v for k, v in mu.items()} | {f"nu{k}": v for k, v in nu.items()}


def hu_moments(moments_dict):
    a, b, c, d, e, f, g = (moments_dict.get(f"nu{k}", 0.0) for k in ("20", "11", "02", "30", "21", "12", "03"))
    p, q, r, s = d + f, e + g, d - 3 * f, 3 * e - g
    return [a + c, (a - c) ** 2 + 4 * b * b, r * r + s * s, p * p + q * q, r * p * (p * p - 3 * q * q) + s * q * (3 * p * p - q * q), (a - c) * (p * p - q * q) + 4 * b * p * q, s * p * (p * p - 3 * q * q) - r * q * (3 * p * p - q * q)]


def match_shapes(contour1, contour2, method=1):
    """Difference of the contours' Hu moments on a signed log scale: 1 of inverses, 2 plain, 3 the largest relative one. A vanishing moment counts as 0."""
    a, b = (np.array(hu_moments(moments(np.asarray(c, np.int32)))) for c in (contour1, contour2))
    x, y = (np.where(np.abs(v) < 1e-20, 0, np.sign(v) * np.log10(np.maximum(np.abs(v), 1e-300))) for v in (a, b))
    if method == 1:
        ok = (np.abs(x) > 1e-9) & (np.abs(y) > 1e-9)
        return float(np.abs(1 / x[ok] - 1 / y[ok]).sum())
    if method == 2:
        return float(np.abs(x - y).sum())
    if method == 3:
        ok = np.abs(x) > 1e-9
        return float((np.abs(x - y)[ok] / np.abs(x[ok])).max(initial=0))
    raise ValueError("method 1, 2 or 3")


def is_contour_convex(contour):
    p = points(contour)
    if len(p) < 3:
        return True
    d = np.roll(p, -1, 0) - p
    e = np.roll(d, -1, 0)
    c = d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0]
    return not ((c > 0).any() and (c < 0).any())


def point_polygon_test(contour, pt, measure_dist):
    """0 on the border; else the sign of being inside, or the signed distance."""
    p, t = points(contour), np.asarray(pt, float)
    if not len(p):
        return -1.0
    q = np.roll(p, -1, 0)
    d = q - p
    size = (d * d).sum(1)
    k = np.clip(np.where(size > 0, ((t - p) * d).sum(1) / np.where(size > 0, size, 1), 0), 0, 1)
    near = (((p + k[:, None] * d) - t) ** 2).sum(1).min()
    if near < 1e-9:
        return 0.0
    up = (p[:, 1] > t[1]) != (q[:, 1] > t[1])
    dy = np.where(d[:, 1] == 0, 1, d[:, 1])
    inside = (up & (t[0] < d[:, 0] * (t[1] - p[:, 1]) / dy + p[:, 0])).sum() % 2 == 1
    sign = 1.0 if inside else -1.0
    return float(sign * np.sqrt(near)) if measure_dist else sign


# drawing


class Canvas:
    """A copy of an image that is drawn on."""

    def __init__(self, img, colour):
        self.out = np.array(img, np.uint8)
        if self.out.ndim not in (2, 3):
            raise ValueError("an image has 2 or 3 axes")
        self.a = self.out if self.out.ndim == 3 else self.out[..., None]
        self.h, self.w, c = self.a.shape
        self.colour = _colour(colour, c)

    def box(self, x, y, u, v):
        """Fills the pixels from (x, y) to before (u, v), as far as they are inside."""
        if u > 0 and v > 0:
            self.a[max(y, 0) : v, max(x, 0) : u] = self.colour

    def dot(self, x, y, thickness):
        r = max(thickness, 1) // 2
        self.box(x - r, y - r, x + r + 1, y + r + 1)

    def line(self, p, q, thickness=1):
        (x, y), (u, v) = (tuple(map(int, t)) for t in (p, q))
        dx, dy = abs(u - x), abs(v - y)
        sx, sy, err = 1 if x < u else -1, 1 if y < v else -1, dx - dy
        while True:
            self.dot(x, y, thickness)
            if (x, y) == (u, v):
                return
            twice = 2 * err
            if twice > -dy:
                err, x = err - dy, x + sx
            if twice < dx:
                err, y = err + dx, y + sy

    def dots(self, x, y):
        """Single pixels, as far as they are inside."""
        ok = (x >= 0) & (x < self.w) & (y >= 0) & (y < self.h)
        self.a[y[ok], x[ok]] = self.colour

    def lines(self, p, q):
        """Lines of one pixel from (n, 2) points to others, all at once, as `line` draws each."""
        (x, y), (u, v) = np.array(p, int).reshape(-1, 2).T, np.array(q, int).reshape(-1, 2).T
        dx, dy, sx, sy = np.abs(u - x), np.abs(v - y), np.where(x < u, 1, -1), np.where(y < v, 1, -1)
        err = dx - dy
        while len(x):
            self.dots(x, y)
            more = (x != u) | (y != v)
            if not more.all():
                x, y, u, v, dx, dy, sx, sy, err = (t[more] for t in (x, y, u, v, dx, dy, sx, sy, err))
            right, down = 2 * err > -dy, 2 * err < dx
            x, y, err = x + sx * right, y + sy * down, err - dy * right + dx * down

    def path(self, p, closed, thickness):
        for a, b in zip(p, np.roll(p, -1, 0) if closed else p[1:], strict=False):
            self.line(a, b, thickness)

    def fill(self, p):
        """Even-odd by scan lines, edges rounded."""
        p = np.asarray(p)
        if len(p) < 3:
            return
        q = np.roll(p, 1, 0)
        for y in range(max(0, min(self.h - 1, p[:, 1].min())), min(self.h - 1, max(0, p[:, 1].max())) + 1):
            cut = ((p[:, 1] < y) & (q[:, 1] >= y)) | ((q[:, 1] < y) & (p[:, 1] >= y))
            a, b = p[cut].astype(float), q[cut].astype(float)
            xs = np.sort(half_away(a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])).astype(int))
            for s, e in zip(xs[::2], xs[1::2], strict=False):
                self.a[y, np.clip(s, 0, self.w - 1) : np.clip(e, 0, self.w - 1) + 1] = self.colour


def line(img, pt1, pt2, color, thickness=1):
    c = Canvas(img, color)
    c.line(pt1, pt2, thickness)
    return c.out


def rectangle(img, pt1, pt2, color, thickness=1):
    c = Canvas(img, color)
    (x, y), (u, v) = pt1, pt2
    if thickness < 0:
        c.box(min(x, u), min(y, v), max(x, u) + 1, max(y, v) + 1)
    else:
        c.path(np.array([(x, y), (u, y), (u, v), (x, v)]), True, thickness)
    return c.out


def circle(img, center, radius, color, thickness=1):
    c, (x, y) = Canvas(img, color), center
    _circle_on(c, x, y, radius, thickness)
    return c.out


def _circle_on(c, x, y, radius, thickness):
    if thickness < 0:
        for row in range(max(0, y - radius), min(c.h - 1, y + radius) + 1):
            d = int(half_away(np.sqrt(float(radius * radius - (row - y) ** 2))))
            c.box(x - d, row, x + d + 1, row + 1)
        return
    a, b, d = 0, radius, 3 - 2 * radius
    while True:
        for u, v in ((a, b), (-a, b), (a, -b), (-a, -b), (b, a), (-b, a), (b, -a), (-b, -a)):
            c.dot(x + u, y + v, thickness)
        if b < a:
            return
        a += 1
        b, d = (b - 1, d + 4 * (a - b + 1) + 10) if d > 0 else (b, d + 4 * a + 6)


def ring_of(radius):
    """Offsets (x, y) of a circle of one pixel."""
    at, a, b, d = set(), 0, radius, 3 - 2 * radius
    while True:
        at |= {(a, b), (-a, b), (a, -b), (-a, -b), (b, a), (-b, a), (b, -a), (-b, -a)}
        if b < a:
            return np.array(sorted(at)).T
        a += 1
        b, d = (b - 1, d + 4 * (a - b + 1) + 10) if d > 0 else (b, d + 4 * a + 6)


def ellipse(img, center, axes, angle, start_angle, end_angle, color, thickness=1):
    c, span = Canvas(img, color), end_angle - start_angle
    while span < 0:
        span += 360
    n = max(4, int(half_away(abs(span))))
    t, r = np.radians(start_angle + np.arange(n + 1) / n * span), np.radians(angle)
    x, y = axes[0] * np.cos(t), axes[1] * np.sin(t)
    p = half_away(np.column_stack([center[0] + x * np.cos(r) - y * np.sin(r), center[1] + x * np.sin(r) + y * np.cos(r)])).astype(int)
    if thickness < 0:
        c.fill(np.concatenate([p, [center]]) if span < 360 else p)
    else:
        c.path(p, span >= 360, thickness)
    return c.out


def polylines(img, pts, is_closed, color, thickness=1):
    c = Canvas(img, color)
    for p in pts:
        p = points(p).astype(int)
        if len(p) > 1:
            c.path(p, is_closed, thickness)
    return c.out


def fill_poly(img, pts, color):
    c = Canvas(img, color)
    for p in pts:
        c.fill(points(p).astype(int))
    return c.out


def arrowed_line(img, pt1, pt2, color, thickness=1, tip_length=0.1):
    c, (a, b) = Canvas(img, color), (np.array(p, float) for p in (pt1, pt2))
    c.line(pt1, pt2, thickness)
    d = b - a
    size, t = np.hypot(*d) * tip_length, np.arctan2(d[1], d[0])
    for s in (-1, 1):
        u = t + np.pi + s * np.radians(35)
        c.line(pt2, half_away(b + size * np.array([np.cos(u), np.sin(u)])).astype(int), thickness)
    return c.out


def draw_contours(img, contours, contour_idx, color, thickness=1):
    c = Canvas(img, color)
    for p in contours if contour_idx < 0 else contours[contour_idx : contour_idx + 1]:
        p = points(p).astype(int)
        c.fill(p) if thickness < 0 else c.path(p, True, thickness)
    return c.out


#: Five-by-seven glyphs by columns (bit 0 on top) for the printable ASCII characters, this library's own.
GLYPHS = "0000000000 00005F0000 0007000700 147F147F14 242A7F2A12 2313086462 3649552250 0005030000 001C224100 0041221C00 14083E0814 08083E0808 0050300000 0808080808 0060600000 2010080402 3E5149453E 00427F4000 4261514946 2141454B31 1814127F10 2745454539 3C4A494930 0171090503 3649494936 064949291E 0036360000 0056360000 0814224100 1414141414 0041221408 0201510906 324979413E 7E1111117E 7F49494936 3E41414122 7F4141221C 7F49494941 7F09090901 3E4149497A 7F0808087F 00417F4100 2040413F01 7F08142241 7F40404040 7F020C027F 7F0408107F 3E4141413E 7F09090906 3E4151215E 7F09192946 4649494931 01017F0101 3F4040403F 1F2040201F 3F4038403F 6314081463 0708700807 6151494543 007F414100 0204081020 0041417F00 0402010204 4040404040 0001020400 2054545478 7F48444438 3844444420 384444487F 3854545418 087E090102 0C5252523E 7F08040478 00447D4000 2040443D00 7F10284400 00417F4000 7C04180478 7C08040478 3844444438 7C14141408 081414187C 7C08040408 4854545420 043F444020 3C4040207C 1C2040201C 3C4030403C 4428102844 0C5050503C 4464544C44 0008364100 00007F0000 0041360800 1008081008".split()


def put_text(img, text, org, font_scale, color, thickness=1):
    """Text in an 8x8 cell font with its lower left corner at org; characters outside printable ASCII are blank."""
    c, scale = Canvas(img, color), max(font_scale, 0.1)
    at = [int(half_away(i * scale)) for i in range(9)]
    x, top, grow = org[0], org[1] - at[8], max(thickness - 1, 0)
    for ch in text:
        if 32 <= ord(ch) < 127:
            for col, bits in enumerate(bytes.fromhex(GLYPHS[ord(ch) - 32])):
                for row in range(7):
                    if bits >> row & 1:
                        c.box(x + at[col + 1] - grow, top + at[row] - grow, x + at[col + 2], top + at[row + 1])
        x += at[8]
    return c.out


def breadth_first(mask, y, x):
    """Pixels (x, y) of the 4-connected region in breadth-first order."""
    w = mask.shape[1] + 2
    free = bytearray(np.pad(np.asarray(mask, bool), 1).astype(np.uint8).tobytes())
    todo = [(y + 1) * w + x + 1]
    free[todo[0]] = 0
    for p in todo:  # grows while it is gone through
        for q in (p - w, p + w, p - 1, p + 1):
            if free[q]:
                free[q] = 0
                todo.append(q)
    return [(p % w - 1, p // w - 1) for p in todo]
