"""Line segments and corner refinement on single grey images."""

from __future__ import annotations

import numpy as np

from .dense import half_away, hough_votes
from .shapes import grey


def corner_sub_pix(image, corners, win_size=5, max_iter=30, epsilon=0.001):
    """Gradient-weighted least squares about each corner, by central differences, until it moves less than epsilon."""
    a = grey(image).astype(float)
    gx, gy = np.zeros_like(a), np.zeros_like(a)
    gx[1:-1, 1:-1], gy[1:-1, 1:-1] = (a[1:-1, 2:] - a[1:-1, :-2]) / 2, (a[2:, 1:-1] - a[:-2, 1:-1]) / 2
    r, (h, w), out = np.arange(-(win_size // 2), win_size // 2 + 1), a.shape, []
    for x, y in corners:
        for _ in range(max_iter):
            u, v = np.meshgrid(np.clip(int(x) + r, 1, w - 2), np.clip(int(y) + r, 1, h - 2))
            i, j = gx[v, u], gy[v, u]
            m = np.array([[(i * i).sum(), (i * j).sum()], [(i * j).sum(), (j * j).sum()]])
            det = m[0, 0] * m[1, 1] - m[0, 1] ** 2
            if abs(det) < 1e-10:
                break
            b = np.array([(i * i * u + i * j * v).sum(), (i * j * u + j * j * v).sum()])
            nx, ny = (m[1, 1] * b[0] - m[0, 1] * b[1]) / det, (m[0, 0] * b[1] - m[0, 1] * b[0]) / det
            step, x, y = np.hypot(nx - x, ny - y), nx, ny
            if step < epsilon:
                break
        out.append((float(x), float(y)))
    return out


def hough_lines_p(image, rho=1.0, theta_deg=1.0, threshold=50, min_line_length=30.0, max_line_gap=10.0):
    """Segments along every line of enough votes, in order of the accumulator; pixels of an accepted segment are spent."""
    a = grey(image) > 0
    h, w = a.shape
    step = np.radians(theta_deg)
    thetas = np.arange(int(np.ceil(np.pi / step))) * step
    votes, top = hough_votes(a, thetas, rho)
    free, out = a.copy(), []
    rs, ts = np.nonzero(votes >= threshold)
    flat = np.abs(np.sin(thetas)) > np.abs(np.cos(thetas))
    # Spent pixels only shorten the segments of a line: one that has none long enough now has none later, so lines are sieved many at once.
    for i in range(0, len(rs), some := max(1, (1 << 16) // max(h, w))):
        r, t = rs[i : i + some], ts[i : i + some]
        hopeful = np.zeros(len(r), bool)
        for along in (True, False):
            if len(k := np.flatnonzero(flat[t] == along)):
                hopeful[k[_segments(free, thetas[t[k]], (r[k] - top) * rho, along, min_line_length, max_line_gap)[0]]] = True
        for k in np.flatnonzero(hopeful):
            _, x, y, parts = _segments(free, thetas[t[k : k + 1]], (r[k : k + 1] - top) * rho, flat[t[k]], min_line_length, max_line_gap)
            for first, last in parts:
                out.append((int(x[first]), int(y[first]), int(x[last]), int(y[last])))
                free[y[first : last + 1], x[first : last + 1]] = False
    return out


def _on_line(free, theta, d, along):
    """(line, x, y) of the free pixels on each line, in order. along: lines with a y for every x."""
    h, w = free.shape
    c, s = np.cos(theta)[:, None], np.sin(theta)[:, None]
    u = np.arange(w if along else h)
    v = half_away((d[:, None] - u * (c if along else s)) / (s if along else c)).astype(int)
    line, i = np.nonzero((v >= 0) & (v < (h if along else w)))
    u, v = u[i], v[line, i]
    x, y = (u, v) if along else (v, u)
    ok = free[y, x]
    return line[ok], x[ok], y[ok]


def _segments(free, theta, d, along, least, gap):
    """(lines, x, y, parts): of the pixels on the lines, the first and last places of each part without a gap that is long enough, and whose line it is."""
    line, x, y = _on_line(free, theta, d, along)
    if not len(line):
        return line, x, y, []
    cut = (line[1:] != line[:-1]) | (np.hypot(x[1:] - x[:-1], y[1:] - y[:-1]) > gap)
    first, last = np.flatnonzero(np.concatenate([[True], cut])), np.flatnonzero(np.concatenate([cut, [True]]))
    long = (np.hypot(x[first] - x[last], y[first] - y[last]) >= least) & (np.bincount(line, minlength=len(theta))[line[first]] > 1)
    return line[first[long]], x, y, list(zip(first[long].tolist(), last[long].tolist(), strict=True))


def line_segment_detector(image, scale=0.8, sigma_scale=0.6, ang_th=22.5, density_th=0.7, n_bins=1024):
    """(x1, y1, x2, y2, width) of regions of like gradient direction, grown from the strongest pixels; only ang_th matters."""
    a = grey(image).astype(float)
    h, w = a.shape
    gx, gy = np.zeros_like(a), np.zeros_like(a)
    gx[1:-1, 1:-1], gy[1:-1, 1:-1] = a[1:-1, 2:] - a[1:-1, :-2], a[2:, 1:-1] - a[:-2, 1:-1]
    mag, ang = np.hypot(gx, gy), np.arctan2(gy, gx)
    order, out = np.argsort(-mag.ravel(), kind="stable"), []
    limit, turn = float(np.radians(ang_th)), 2 * np.pi
    # A frame that is never free stands for the border; only pixels beside a region are looked at.
    wide = w + 2
    free, ang = bytearray(np.pad(mag >= 2, 1).astype(np.uint8).tobytes()), np.pad(ang, 1).ravel().tolist()
    for i in order[: int((mag > 5).sum())].tolist():
        seed = (i // w + 1) * wide + i % w + 1
        if not free[seed]:
            continue
        own, todo, region = ang[seed], [seed], []
        while todo:
            q = todo.pop()
            if free[q]:
                near = abs(ang[q] - own)
                if near <= limit or turn - near <= limit:
                    free[q] = 0
                    region.append(q)
                    todo += (q - wide, q + wide, q - 1, q + 1)
        if len(region) < 5:
            continue
        y, x = np.divmod(np.array(region), wide)
        if np.hypot(x.max() - x.min(), y.max() - y.min()) < 4.999:  # no longer than its box's diagonal
            continue
        p = np.column_stack([x - 1, y - 1]).astype(float)
        m = p.mean(0)
        d = p - m
        t = 0.5 * np.arctan2(2 * (d[:, 0] * d[:, 1]).sum(), (d[:, 0] ** 2).sum() - (d[:, 1] ** 2).sum())
        along, across = d @ [np.cos(t), np.sin(t)], np.abs(d @ [-np.sin(t), np.cos(t)])
        if along.max() - along.min() >= 5:
            q = [m + e * np.array([np.cos(t), np.sin(t)]) for e in (along.min(), along.max())]
            out.append((*map(float, q[0]), *map(float, q[1]), float(2 * across.mean())))
    return out
