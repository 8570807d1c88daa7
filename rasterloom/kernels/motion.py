"""Motion kernels: optical flow, background models, trackers, the Kalman filter."""

from __future__ import annotations

import numpy as np

from . import dense


def _smooth(a, size):
    k = np.full((1, size), 1.0 / size)
    return dense.correlate(dense.correlate(a[None, ..., None], k), k.T)[0, ..., 0]


def _at(a, x, y):
    h, w = a.shape[:2]
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.minimum(x.astype(int), max(w - 2, 0)), np.minimum(y.astype(int), max(h - 2, 0))
    fx, fy = x - x0, y - y0
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    if a.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    return (1 - fx) * (1 - fy) * a[y0, x0] + fx * (1 - fy) * a[y0, x1] + (1 - fx) * fy * a[y1, x0] + fx * fy * a[y1, x1]


def _grey(a):
    a = np.asarray(a)
    return (dense.rgb_to_gray(a).reshape(a.shape[:2]) if a.ndim == 3 and a.shape[2] == 3 else a.reshape(a.shape[:2])).astype(float)


def buildOpticalFlowPyramid(img, win_size, max_level, with_derivatives=True, pyr_border=None, deriv_border=None, try_reuse_input_image=True):
    """(levels, images): each level halves the last, while it is larger than the window; derivatives follow their image."""
    out, level, top = [], np.asarray(img, np.uint8), 0
    for i in range(max_level + 1):
        if i:
            small = dense.pyr_down(level)
            if small.shape[1] <= win_size[0] or small.shape[0] <= win_size[1]:
                break
            level, top = small, i
        out.append(level)
        if with_derivatives:
            g = _grey(level)[None, ..., None]
            out.append(np.concatenate([dense.correlate(g, np.outer([3, 10, 3], [-1, 0, 1])), dense.correlate(g, np.outer([-1, 0, 1], [3, 10, 3]))], -1)[0].astype(np.int16))
    return top, out


def calc_optical_flow_pyr_lk(prev_img, next_img, prev_pts, next_pts=None, win_size=(21, 21), max_level=3, criteria=None, flags=0, min_eig_threshold=1e-4):
    """(points, status, error): iterative Lucas-Kanade in windows, from coarse to fine; all points at once."""
    _, rounds, eps = criteria or (3, 30, 0.01)
    a, b = [_grey(prev_img)], [_grey(next_img)]
    for _ in range(max_level):
        if min(a[-1].shape) < 2 * max(win_size):
            break
        a.append(dense.correlate(a[-1][None, ..., None], dense.BINOMIAL / 256)[0, ::2, ::2, 0])
        b.append(dense.correlate(b[-1][None, ..., None], dense.BINOMIAL / 256)[0, ::2, ::2, 0])
    p = np.asarray(prev_pts, float).reshape(-1, 2)
    d = (np.asarray(next_pts, float).reshape(-1, 2) - p if next_pts is not None and flags & 4 else np.zeros_like(p)) / 2 ** len(a)
    wy, wx = np.mgrid[: win_size[1], : win_size[0]]
    wx, wy = wx.ravel() - win_size[0] // 2, wy.ravel() - win_size[1] // 2
    ok, err = np.ones(len(p), bool), np.zeros(len(p))
    for level in range(len(a) - 1, -1, -1):
        d = d * 2
        q = p / 2**level
        x, y = q[:, :1] + wx, q[:, 1:] + wy
        v, gx, gy = _at(a[level], x, y), (_at(a[level], x + 1, y) - _at(a[level], x - 1, y)) / 2, (_at(a[level], x, y + 1) - _at(a[level], x, y - 1)) / 2
        xx, yy, xy = (gx * gx).sum(1), (gy * gy).sum(1), (gx * gy).sum(1)
        det, low = xx * yy - xy * xy, ((xx + yy) - np.sqrt((xx - yy) ** 2 + 4 * xy * xy)) / (2 * len(wx))
        good = (low >= min_eig_threshold) & (det > 1e-12)
        safe = np.where(good, det, 1)
        for _ in range(rounds):
            e = _at(b[level], x + d[:, :1], y + d[:, 1:]) - v
            bx, by = (e * gx).sum(1), (e * gy).sum(1)
            step = np.column_stack([xy * by - yy * bx, xy * bx - xx * by]) / safe[:, None] * good[:, None]
            d = d + step
            if (np.hypot(*step.T) < eps).all():
                break
        if level == 0:
            ok, err = good, np.abs(_at(b[0], x + d[:, :1], y + d[:, 1:]) - v).mean(1)
    n = p + d
    ok = ok & (n[:, 0] >= 0) & (n[:, 1] >= 0) & (n[:, 0] < a[0].shape[1]) & (n[:, 1] < a[0].shape[0])
    return n.astype(np.float32)[:, None], ok.astype(np.uint8)[:, None], err.astype(np.float32)[:, None]


def _expansion(a, n, sigma):
    """Local quadratics by weighted least squares: coefficients of x, y, x2, y2, xy."""
    r = n // 2
    t = np.arange(-r, r + 1.0)
    g = np.exp(-(t * t) / (2 * sigma * sigma))
    y, x = np.meshgrid(t, t, indexing="ij")
    basis, w = np.stack([np.ones_like(x), x, y, x * x, y * y, x * y]), np.outer(g, g)
    inv = np.linalg.inv(np.einsum("iyx,jyx,yx->ij", basis, basis, w))
    proj = np.stack([dense.correlate(a[None, ..., None], b * w)[0, ..., 0] for b in basis])
    return np.einsum("ij,jyx->iyx", inv, proj)[1:]


def calc_optical_flow_farneback(prev, next, flow, pyr_scale, levels, winsize, iterations, poly_n, poly_sigma, flags=0):
    """Dense flow from displacements between local quadratics, averaged in windows, from coarse to fine."""
    a, b = _grey(prev), _grey(next)
    out = None
    for level in range(max(1, levels) - 1, -1, -1):
        s = pyr_scale**level
        h, w = max(int(dense.half_away(a.shape[0] * s)), 1), max(int(dense.half_away(a.shape[1] * s)), 1)
        if level and min(h, w) < 2 * poly_n:
            continue
        y, x = np.mgrid[:h, :w]
        sx, sy = (x + 0.5) * a.shape[1] / w - 0.5, (y + 0.5) * a.shape[0] / h - 0.5
        u, v = (_at(_smooth(m, max(1, int(1 / s))) if level else m, sx, sy) for m in (a, b))
        if out is None:
            out = np.zeros((h, w, 2)) if flow is None else _at(np.asarray(flow, float), sx, sy) * s
        else:
            k = np.array([w / out.shape[1], h / out.shape[0]])
            out = _at(out, (x + 0.5) / k[0] - 0.5, (y + 0.5) / k[1] - 0.5) * k
        p, q = _expansion(u, poly_n, poly_sigma), _expansion(v, poly_n, poly_sigma)
        for _ in range(iterations):
            m = np.moveaxis(_at(np.moveaxis(q, 0, -1), x + out[..., 0], y + out[..., 1]), -1, 0)
            xx, yy, xy = (p[2] + m[2]) / 2, (p[3] + m[3]) / 2, (p[4] + m[4]) / 4
            bx, by = (p[0] - m[0]) / 2 + xx * out[..., 0] + xy * out[..., 1], (p[1] - m[1]) / 2 + xy * out[..., 0] + yy * out[..., 1]
            g = [_smooth(t, winsize) for t in (xx * xx + xy * xy, xy * (xx + yy), yy * yy + xy * xy, xx * bx + xy * by, xy * bx + yy * by)]
            det = g[0] * g[2] - g[1] ** 2
            ok = np.abs(det) > 1e-9
            det = np.where(ok, det, 1)
            out = np.stack([np.where(ok, (g[2] * g[3] - g[1] * g[4]) / det, out[..., 0]), np.where(ok, (g[0] * g[4] - g[1] * g[3]) / det, out[..., 1])], -1)
    return out.astype(np.float32)


class SparsePyrLKOpticalFlow:
    def __init__(self, win_size=(21, 21), max_level=3, criteria=None, flags=0, min_eig_threshold=1e-4):
        self.options = {"win_size": win_size, "max_level": max_level, "criteria": criteria, "flags": flags, "min_eig_threshold": min_eig_threshold}

    def calc(self, prev_img, next_img, prev_pts, next_pts=None):
        return calc_optical_flow_pyr_lk(prev_img, next_img, prev_pts, next_pts, **self.options)


def SparsePyrLKOpticalFlow_create(win_size=(21, 21), max_level=3, criteria=None, flags=0, min_eig_threshold=1e-4):
    return SparsePyrLKOpticalFlow(win_size, max_level, criteria, flags, min_eig_threshold)


class DISOpticalFlow:
    """Dense inverse search: patches on a grid, coarse to fine, their flows averaged by residual where they overlap."""

    def __init__(self, preset=1):
        self.patch, self.stride, self.rounds = 8, {0: 6, 1: 4, 2: 3}.get(preset, 4), {0: 12, 1: 16, 2: 25}.get(preset, 16)

    def calc(self, I0, I1, flow=None):
        a, b = _grey(I0), _grey(I1)
        y, x = (np.unique(np.append(np.arange(0, max(s - self.patch, 0) + 1, self.stride), max(s - self.patch, 0))) for s in a.shape)
        at = np.array([(u + self.patch / 2 - 0.5, v + self.patch / 2 - 0.5) for v in y for u in x])
        p, ok, err = calc_optical_flow_pyr_lk(a, b, at, None, (self.patch, self.patch), 3, (3, self.rounds, 0.01))
        d, weight = p[:, 0] - at, ok[:, 0] / np.maximum(err[:, 0], 1.0)
        total, norm = np.zeros((*a.shape, 2)), np.full(a.shape, 1e-9)
        for (u, v), f, wt in zip(at, d, weight, strict=True):
            s = (slice(int(v - self.patch / 2 + 1), int(v + self.patch / 2 + 1)), slice(int(u - self.patch / 2 + 1), int(u + self.patch / 2 + 1)))
            total[s] += f * wt
            norm[s] += wt
        return (total / norm[..., None]).astype(np.float32)


def DISOpticalFlow_create(preset=1):
    return DISOpticalFlow(preset)


class BackgroundMixtures:
    """Adaptive Gaussian mixtures per pixel (Zivkovic); 255 foreground, 127 shadow, 0 background. The state pickles."""

    def __init__(self, history=500, var_threshold=16.0, detect_shadows=True, modes=5):
        self.history, self.gate, self.shadows, self.modes, self.seen, self.state = history, var_threshold, detect_shadows, modes, 0, None

    def apply(self, image, learning_rate=-1.0):
        x = np.asarray(image, float)
        x = x[..., None] if x.ndim == 2 else x
        if self.state is None:
            self.state = (np.zeros((self.modes, *x.shape[:2])), np.zeros((self.modes, *x.shape)), np.full((self.modes, *x.shape[:2]), 15.0))
        w, mean, var = self.state
        self.seen += 1
        rate = learning_rate if learning_rate >= 0 else 1 / min(self.seen, self.history)
        d = ((x - mean) ** 2).sum(-1)
        order = w.cumsum(0) - w
        fits = (w > 0) & (d < self.gate * var)
        background = (fits & (order < 0.9)).any(0)
        own = np.where(fits.any(0), fits.argmax(0), -1)
        shadow = np.zeros_like(background)
        if self.shadows:
            top = mean[0]
            k = (x * top).sum(-1) / np.maximum((top * top).sum(-1), 1e-9)
            shadow = ~background & (w[0] > 0) & (k >= 0.5) & (k <= 1) & (((x - k[..., None] * top) ** 2).sum(-1) < self.gate * var[0] * np.maximum(k, 1e-9) ** 2)
        hit = np.arange(self.modes)[:, None, None] == own
        w = np.maximum((1 - rate) * w + rate * hit - rate * 0.05, 0)
        step = np.where(hit, rate / np.maximum(w, rate), 0)
        mean = mean + step[..., None] * (x - mean)
        var = np.clip(var + step * (d - var), 4.0, 75.0)
        least = w.argmin(0)
        new = (np.arange(self.modes)[:, None, None] == least) & (own < 0)
        w, mean, var = np.where(new, max(rate, 1e-6), w), np.where(new[..., None], x, mean), np.where(new, 15.0, var)
        sort = np.argsort(-w, 0, kind="stable")
        w, var = (np.take_along_axis(v, sort, 0) for v in (w, var))
        mean = np.take_along_axis(mean, sort[..., None], 0)
        self.state = (w / np.maximum(w.sum(0), 1e-12), mean, var)
        return np.where(background, 0, np.where(shadow, 127, 255)).astype(np.uint8)


class BackgroundNeighbours:
    """Nearest-neighbour background: a ring of samples per pixel; background if two lie within the distance."""

    def __init__(self, history=500, dist2_threshold=400.0, detect_shadows=True, samples=7):
        self.every, self.gate, self.shadows, self.seen, self.ring, self.samples = max(1, history // 100), dist2_threshold, detect_shadows, 0, None, samples

    def apply(self, image, learning_rate=-1.0):
        x = np.asarray(image, float)
        x = x[..., None] if x.ndim == 2 else x
        if self.ring is None:
            self.ring = np.full((self.samples, *x.shape), np.inf)
        with np.errstate(invalid="ignore"):
            near = ((x - self.ring) ** 2).sum(-1) < self.gate
            dark = np.zeros(x.shape[:2], bool)
            if self.shadows:
                k = x.sum(-1) / np.maximum(self.ring.sum(-1), 1e-9)
                dark = ((k >= 0.5) & (k < 1) & (((x - k[..., None] * np.where(np.isfinite(self.ring), self.ring, 0)) ** 2).sum(-1) < self.gate)).sum(0) >= 2
        background = near.sum(0) >= 2
        if self.seen % self.every == 0 or self.seen < self.samples:
            self.ring[(self.seen // self.every if self.seen >= self.samples else self.seen) % self.samples] = x
        self.seen += 1
        return np.where(background, 0, np.where(dark, 127, 255)).astype(np.uint8)


def createBackgroundSubtractorKNN(history=500, dist2_threshold=400.0, detect_shadows=True):
    return BackgroundNeighbours(history, dist2_threshold, detect_shadows)


def meanShift(prob_image, window, criteria=None):
    """(rounds, window): the window moves to its centroid until it stays."""
    a = np.asarray(prob_image, float)
    x, y, w, h = window
    _, most, eps = criteria or (3, 10, 1.0)
    n = 0
    for n in range(1, most + 1):
        part = a[max(y, 0) : max(y + h, 0), max(x, 0) : max(x + w, 0)]
        if part.sum() <= 0:
            break
        v, u = np.mgrid[: part.shape[0], : part.shape[1]]
        nx = int(np.clip(dense.half_away(max(x, 0) + (u * part).sum() / part.sum() - (w - 1) / 2), 0, max(a.shape[1] - w, 0)))
        ny = int(np.clip(dense.half_away(max(y, 0) + (v * part).sum() / part.sum() - (h - 1) / 2), 0, max(a.shape[0] - h, 0)))
        step, (x, y) = np.hypot(nx - x, ny - y), (nx, ny)
        if step < eps:
            break
    return n, (int(x), int(y), int(w), int(h))


def CamShift(prob_image, window, criteria=None):
    """(rotated rectangle, window): mean shift, then size and angle from the second moments around it."""
    a = np.asarray(prob_image, float)
    _, (x, y, w, h) = meanShift(a, window, criteria)
    top, left = max(y - 10, 0), max(x - 10, 0)
    part = a[top : y + h + 10, left : x + w + 10]
    s = part.sum()
    if s <= 0:
        return ((x + w / 2, y + h / 2), (0.0, 0.0), 0.0), (x, y, w, h)
    v, u = np.mgrid[: part.shape[0], : part.shape[1]]
    cx, cy = (u * part).sum() / s, (v * part).sum() / s
    xx, yy, xy = (((u - cx) ** 2) * part).sum() / s, (((v - cy) ** 2) * part).sum() / s, ((u - cx) * (v - cy) * part).sum() / s
    t, root = 0.5 * np.arctan2(2 * xy, xx - yy), np.hypot(2 * xy, xx - yy)
    long, short = (4 * np.sqrt(max((xx + yy + r) / 2, 0)) for r in (root, -root))
    bw, bh = (int(np.ceil(np.hypot(long * f(t), short * g(t)))) for f, g in ((np.cos, np.sin), (np.sin, np.cos)))
    box = (int(max(left + cx - bw / 2, 0)), int(max(top + cy - bh / 2, 0)), max(bw, 1), max(bh, 1))
    return ((float(left + cx), float(top + cy)), (float(short), float(long)), float(np.degrees(t) % 180)), box


class KalmanFilter:
    """Linear predict and correct steps; matrices are public and may be set."""

    def __init__(self, dynam_params, measure_params, control_params=0, kf_type=None):
        n, m = dynam_params, measure_params
        self.statePre, self.statePost = np.zeros(n), np.zeros(n)
        self.transitionMatrix, self.controlMatrix = np.eye(n), np.zeros((n, control_params))
        self.measurementMatrix, self.processNoiseCov, self.measurementNoiseCov = np.eye(m, n), np.eye(n), np.eye(m)
        self.errorCovPre, self.errorCovPost, self.gain = np.zeros((n, n)), np.zeros((n, n)), np.zeros((n, m))

    def predict(self, control=None):
        self.statePre = self.transitionMatrix @ self.statePost
        if control is not None and self.controlMatrix.shape[1]:
            self.statePre = self.statePre + self.controlMatrix @ np.ravel(control)
        self.errorCovPre = self.transitionMatrix @ self.errorCovPost @ self.transitionMatrix.T + self.processNoiseCov
        self.statePost, self.errorCovPost = self.statePre.copy(), self.errorCovPre.copy()
        return self.statePre

    def correct(self, measurement):
        h = self.measurementMatrix
        self.gain = np.linalg.solve(h @ self.errorCovPre @ h.T + self.measurementNoiseCov, h @ self.errorCovPre).T
        self.statePost = self.statePre + self.gain @ (np.ravel(measurement) - h @ self.statePre)
        self.errorCovPost = self.errorCovPre - self.gain @ h @ self.errorCovPre
        return self.statePost
