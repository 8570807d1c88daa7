"""Computational photography, calibration and 3-D, from the published methods, on single images."""

from __future__ import annotations

import numpy as np

from . import dense
from .dense import half_away, round8, trunc8
from .features import _congruential, project


def _stack(a):
    a = np.asarray(a)
    return a[..., None] if a.ndim == 2 else a


def _like(out, a):
    return out[..., 0] if np.ndim(a) == 2 else out


# inpainting and denoising


def inpaint(src, inpaint_mask, inpaint_radius, flags=1):
    """flags 1: weighted means of known neighbours, from the border inward (Telea); 0: smoothing along isophotes (Navier-Stokes)."""
    a, hole = _stack(src).astype(float), np.asarray(inpaint_mask) > 0
    h, w = hole.shape
    r = max(1, int(np.ceil(inpaint_radius)))
    steps = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if 0 < dy * dy + dx * dx <= max(1.0, inpaint_radius) ** 2]
    known, out = ~hole, np.where(hole[..., None], 0, a)
    while not known.all() and known.any():
        p, k = np.pad(out, ((r, r), (r, r), (0, 0))), np.pad(known, r)
        near = np.zeros_like(known)
        for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1)):
            near |= k[r + dy : r + dy + h, r + dx : r + dx + w]
        front = near & ~known
        total, norm = np.zeros_like(out), np.zeros((h, w))
        for dy, dx in steps:
            wt = k[r + dy : r + dy + h, r + dx : r + dx + w] / float(dy * dy + dx * dx)
            total += p[r + dy : r + dy + h, r + dx : r + dx + w] * wt[..., None]
            norm += wt
        out[front] = total[front] / np.maximum(norm[front], 1e-12)[:, None]
        known = known | front
    if flags == 0:
        for _ in range(50):
            p = np.pad(out, ((1, 1), (1, 1), (0, 0)), mode="edge")
            out = np.where(hole[..., None], (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]) / 4, out)
    return _like(round8(out), src)


def _means(a, h, template, search):
    """Non-local means of a stack: every shift's squared patch difference comes from one box sum."""
    t, s = template // 2, search // 2
    high, wide = a.shape[1:3]
    p = np.pad(a, ((0, 0), (s, s), (s, s), (0, 0)), mode="reflect" if min(high, wide) > s else "edge")
    total, norm = np.zeros_like(a), np.zeros(a.shape[:3])
    y, x = (np.clip(np.arange(-t, n + t), 0, n - 1) for n in (high, wide))
    for dy in range(-s, s + 1):
        for dx in range(-s, s + 1):
            b = p[:, s + dy : s + dy + high, s + dx : s + dx + wide]
            d = np.zeros((len(a), high + 2 * t + 1, wide + 2 * t + 1))
            np.cumsum(((a - b) ** 2).mean(3)[:, y][:, :, x], axis=1, out=d[:, 1:, 1:])
            np.cumsum(d[:, 1:, 1:], axis=2, out=d[:, 1:, 1:])
            d = (d[:, template:, template:] - d[:, :-template, template:] - d[:, template:, :-template] + d[:, :-template, :-template]) / template**2
            w = np.exp(-np.maximum(d, 0) / (h * h))
            total += b * w[..., None]
            norm += w
    return total / norm[..., None]


@dense.stacked
def fastNlMeansDenoising(src, h=3.0, template_window_size=7, search_window_size=21):
    return round8(_means(src.astype(float), h, template_window_size, search_window_size))


def _to_rgb(lab):
    f = np.empty_like(lab)
    f[..., 1] = (lab[..., 0] + 16) / 116
    f[..., 0], f[..., 2] = f[..., 1] + lab[..., 1] / 500, f[..., 1] - lab[..., 2] / 200
    xyz = np.where(f > 0.206893, f**3, (f - 16 / 116) / 7.787037) * dense.WHITE
    c = xyz @ np.linalg.inv(dense.XYZ).T
    return round8(255 * np.where(c <= 0.0031308, 12.92 * c, 1.055 * np.maximum(c, 0) ** (1 / 2.4) - 0.055))


@dense.stacked
def fastNlMeansDenoisingColored(src, h=3.0, h_color=3.0, template_window_size=7, search_window_size=21):
    """Lightness and colour apart, in Lab."""
    lab = dense.rgb_to_lab.stack(src).astype(float)
    scale = 100 / 255
    light = _means(lab[..., :1], h * scale, template_window_size, search_window_size)
    return _to_rgb(np.concatenate([light, _means(lab[..., 1:], h_color, template_window_size, search_window_size)], -1))


# gradient-domain editing


def _poisson(border, gx, gy, mask, rounds=2000):
    """Values inside the mask whose gradients are given, border values elsewhere: successive over-relaxation in two colours."""
    h, w = mask.shape
    m = mask.copy()
    m[[0, -1]] = m[:, [0, -1]] = False
    out = border.astype(float).copy()
    div = np.zeros_like(out)
    div[:, 1:] += gx[:, 1:] - gx[:, :-1]
    div[1:] += gy[1:] - gy[:-1]
    y, x = np.mgrid[:h, :w]
    sides = [m & ((y + x) % 2 == c) for c in (0, 1)]
    for _ in range(rounds):
        most = 0.0
        for s in sides:
            p = np.pad(out, ((1, 1), (1, 1), (0, 0)), mode="edge")
            goal = (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - div) / 4
            step = np.where(s[..., None], 1.8 * (goal - out), 0)
            out += step
            most = max(most, float(np.abs(step).max(initial=0)))
        if most < 1e-3:
            break
    return out


def _gradients(a):
    gx, gy = np.zeros_like(a), np.zeros_like(a)
    gx[:, :-1], gy[:-1] = a[:, 1:] - a[:, :-1], a[1:] - a[:-1]
    return gx, gy


def seamlessClone(src, dst, mask, p, flags=1):
    """Poisson blend of the masked source with its mask's middle at p. flags 1 source gradients, 2 the stronger ones, 3 grey source."""
    s, d, m = _stack(src).astype(float), _stack(dst).astype(float), np.asarray(mask)
    m = (m if m.ndim == 2 else m[..., 0]) > 0
    if not m.any():
        return np.array(dst, np.uint8)
    if flags == 3:
        s = np.repeat(s.mean(2, keepdims=True), s.shape[2], 2)
    ys, xs = np.nonzero(m)
    top, left = p[1] - (ys.min() + ys.max()) // 2, p[0] - (xs.min() + xs.max()) // 2
    full, put = np.zeros_like(d), np.zeros(d.shape[:2], bool)
    y, x = np.mgrid[: m.shape[0], : m.shape[1]]
    ok = (y + top >= 0) & (y + top < d.shape[0]) & (x + left >= 0) & (x + left < d.shape[1])
    full[y[ok] + top, x[ok] + left] = s[ok]
    put[y[ok] + top, x[ok] + left] = m[ok]
    gx, gy = _gradients(full)
    if flags == 2:
        hx, hy = _gradients(d)
        weak = np.hypot(gx, gy) < np.hypot(hx, hy)
        gx, gy = np.where(weak, hx, gx), np.where(weak, hy, gy)
    return _like(round8(_poisson(d, gx, gy, put)), dst)


def _edited(src, mask, change):
    a, m = _stack(src).astype(float), np.asarray(mask)
    m = (m if m.ndim == 2 else m[..., 0]) > 0
    gx, gy = change(*_gradients(a), a)
    inside = m[..., None]
    ox, oy = _gradients(a)
    return _like(round8(_poisson(a, np.where(inside, gx, ox), np.where(inside, gy, oy), m)), src)


def colorChange(src, mask, red_mul=1.0, green_mul=1.0, blue_mul=1.0):
    k = np.array([red_mul, green_mul, blue_mul])
    return _edited(src, mask, lambda gx, gy, a: (gx * k[: a.shape[2]], gy * k[: a.shape[2]]))


def illuminationChange(src, mask, alpha=0.2, beta=0.4):
    def change(gx, gy, a):
        n = np.maximum(np.hypot(gx, gy), 1e-6)
        k = (alpha * n.mean()) ** beta * n**-beta
        return gx * k, gy * k

    return _edited(src, mask, change)


def textureFlattening(src, mask, low_threshold=30.0, high_threshold=45.0, kernel_size=3):
    a = _stack(src)
    g = dense.rgb_to_gray(a) if a.shape[2] == 3 else a[..., 0]
    edge = dense.canny_l2(np.asarray(g).reshape(a.shape[:2]), low_threshold, high_threshold, kernel_size) > 0
    return _edited(src, mask, lambda gx, gy, _: (gx * edge[..., None], gy * edge[..., None]))


def decolor(src):
    """(grey, boosted colour): the linear mix, on a grid of weights, that keeps most colour contrast between neighbours."""
    a = np.asarray(src).astype(float) / 255
    d = np.concatenate([(a[:, 1:] - a[:, :-1]).reshape(-1, 3), (a[1:] - a[:-1]).reshape(-1, 3)])
    goal = np.sqrt((d * d).sum(1))
    best = max(((r, g, 10 - r - g) for r in range(11) for g in range(11 - r)), key=lambda w: -float(((np.abs(d @ (np.array(w) / 10)) - goal) ** 2).sum()))
    grey = round8(a @ (np.array(best) / 10) * 255)
    lab = dense.rgb_to_lab(np.asarray(src, np.uint8)).astype(float)
    lab[..., 0] = grey / 255 * 100
    return grey, _to_rgb(lab)


# high dynamic range


class Tonemap:
    def __init__(self, gamma=1.0):
        self.gamma = gamma

    def process(self, src):
        a = np.asarray(src, float)
        span = a.max() - a.min()
        return (((a - a.min()) / span if span > 0 else np.zeros_like(a)) ** (1 / self.gamma)).astype(np.float32)


def createTonemap(gamma=1.0):
    return Tonemap(gamma)


def _down(a):
    return dense.correlate(a[None], dense.BINOMIAL / 256)[0][::2, ::2]


def _up(a, shape):
    out = np.zeros((*shape, a.shape[2]))
    out[::2, ::2] = a[: (shape[0] + 1) // 2, : (shape[1] + 1) // 2]
    return dense.correlate(out[None], dense.BINOMIAL / 64)[0]


class MergeMertens:
    """Exposure fusion: weights by contrast, saturation and exposure, blended in Laplacian pyramids."""

    def __init__(self, contrast_weight=1.0, saturation_weight=1.0, exposure_weight=0.0):
        self.powers = contrast_weight, saturation_weight, exposure_weight

    def process(self, images):
        stack = [_stack(i).astype(float) / 255 for i in images]
        weights = []
        for a in stack:
            c = np.abs(dense.correlate(a.mean(2)[None, ..., None], dense.laplacian_kernel(1))[0, ..., 0])
            e = np.exp(-((a - 0.5) ** 2) / 0.08).prod(2)
            weights.append(np.prod([v**p for v, p in zip((c, a.std(2), e), self.powers, strict=True) if p], 0) + 1e-12 if any(self.powers) else np.ones(a.shape[:2]))
        total = sum(weights)
        depth, out = max(1, int(np.log2(max(2, min(stack[0].shape[:2])))) - 1), None
        for a, w in zip(stack, weights, strict=True):
            w, parts = (w / total)[..., None], []
            for _ in range(depth):
                low = _down(a)
                parts.append((a - _up(low, a.shape[:2])) * w)
                a, w = low, _down(w)
            parts.append(a * w)
            out = parts if out is None else [x + y for x, y in zip(out, parts, strict=True)]
        a = out.pop()
        while out:
            a = out[-1] + _up(a, out.pop().shape[:2])
        return a.astype(np.float32)


def createMergeMertens(contrast_weight=1.0, saturation_weight=1.0, exposure_weight=0.0):
    return MergeMertens(contrast_weight, saturation_weight, exposure_weight)


def _hat():
    z = np.arange(256.0)
    return np.where(z <= 127, z + 1, 256 - z)


class CalibrateDebevec:
    """The log response curve from pixels of several exposures, least squares with a smoothness term."""

    def __init__(self, samples=70, lambda_val=10.0, random=False):
        self.samples, self.smooth, self.random = samples, lambda_val, random

    def process(self, images, times):
        stack = np.stack([_stack(i) for i in images])
        n = stack[0, ..., 0].size
        pick = np.random.default_rng(0).permutation(n)[: self.samples] if self.random else np.unique(np.linspace(0, n - 1, self.samples).astype(int))
        w, curves = _hat(), []
        for c in range(stack.shape[3]):
            z = stack[..., c].reshape(len(stack), -1)[:, pick]
            rows = z.size + 255
            m, b, k = np.zeros((rows, 256 + len(pick))), np.zeros(rows), 0
            for j, t in enumerate(np.log(np.asarray(times, float))):
                at = k + np.arange(len(pick))
                m[at, z[j]], m[at, 256 + np.arange(len(pick))], b[at] = w[z[j]], -w[z[j]], w[z[j]] * t
                k += len(pick)
            m[k, 128], k = 1, k + 1
            i = np.arange(1, 255)
            for d, v in ((-1, 1), (0, -2), (1, 1)):
                m[k + i - 1, i + d] = self.smooth * w[i] * v
            curves.append(np.linalg.lstsq(m, b, rcond=None)[0][:256])
        return np.exp(np.stack(curves, -1)).astype(np.float32)[:, None]


def createCalibrateDebevec(samples=70, lambda_val=10.0, random=False):
    return CalibrateDebevec(samples, lambda_val, random)


class MergeDebevec:
    """Radiance as the weighted mean of log response less log time."""

    def process(self, images, times, response=None):
        stack, w = [_stack(i) for i in images], _hat()
        curve = np.log(np.maximum(np.asarray(response, float).reshape(256, -1) if response is not None else np.arange(256.0)[:, None] + 1, 1e-12))
        total, norm = 0, 0
        for a, t in zip(stack, times, strict=True):
            g = np.stack([curve[a[..., c], min(c, curve.shape[1] - 1)] for c in range(a.shape[2])], -1)
            total, norm = total + w[a] * (g - np.log(t)), norm + w[a]
        return np.exp(total / norm).astype(np.float32)


def createMergeDebevec():
    return MergeDebevec()


# edge-preserving filters: the domain transform


def _domain(a, sigma_s, sigma_r, guide=None, rounds=3):
    out, g = a.astype(float), (a if guide is None else guide).astype(float)
    steps = [1 + sigma_s / sigma_r * np.abs(np.diff(g, axis=ax)).sum(2) for ax in (1, 0)]
    for i in range(rounds):
        sigma = sigma_s * np.sqrt(3) * 2 ** (rounds - i - 1) / np.sqrt(4**rounds - 1)
        for ax in (1, 0):
            v = out if ax else out.transpose(1, 0, 2).copy()
            k = (np.exp(-np.sqrt(2) / sigma) ** (steps[0] if ax else steps[1].T))[..., None]
            for x in range(1, v.shape[1]):
                v[:, x] += k[:, x - 1] * (v[:, x - 1] - v[:, x])
            for x in range(v.shape[1] - 2, -1, -1):
                v[:, x] += k[:, x] * (v[:, x + 1] - v[:, x])
            out = v if ax else v.transpose(1, 0, 2).copy()
    return out


def edgePreservingFilter(src, flags=1, sigma_s=60.0, sigma_r=0.4):
    """Recursive domain transform; flags 2 uses two more rounds."""
    a = _stack(src) / 255
    return _like(round8(_domain(a, sigma_s, sigma_r, rounds=5 if flags == 2 else 3) * 255), src)


def detailEnhance(src, sigma_s=10.0, sigma_r=0.15):
    a = _stack(src) / 255
    base = _domain(a, sigma_s, sigma_r)
    return _like(round8((base + 3 * (a - base)) * 255), src)


def pencilSketch(src, sigma_s=60.0, sigma_r=0.07, shade_factor=0.02):
    a = _stack(src) / 255
    smooth = _domain(a, sigma_s, sigma_r)
    g = smooth.mean(2)
    gx, gy = _gradients(g[..., None])
    grey = np.clip(1 - np.hypot(gx, gy)[..., 0] / max(shade_factor * 10, 1e-6), 0, 1)
    return round8(grey * 255), round8(smooth * grey[..., None] * 255)


def stylization(src, sigma_s=60.0, sigma_r=0.07):
    a = _stack(src) / 255
    smooth = _domain(a, sigma_s, sigma_r)
    gx, gy = _gradients(smooth.mean(2, keepdims=True))
    return _like(round8(smooth * (1 - np.clip(np.hypot(gx, gy), 0, 1)) * 255), src)


# calibration and 3-D


def _lens(p, k, dist):
    """Pixels of normalised coordinates under radial (k1, k2, k3) and tangential (p1, p2) distortion."""
    d = np.zeros(5)
    d[: min(5, np.size(dist))] = np.ravel(dist)[:5] if dist is not None and np.size(dist) else 0
    x, y = p.T
    r = x * x + y * y
    f = 1 + d[0] * r + d[1] * r**2 + d[4] * r**3
    u, v = x * f + 2 * d[2] * x * y + d[3] * (r + 2 * x * x), y * f + d[2] * (r + 2 * y * y) + 2 * d[3] * x * y
    return np.column_stack([u * k[0, 0] + k[0, 2], v * k[1, 1] + k[1, 2]])


def rodrigues(r):
    r = np.asarray(r, float).ravel()
    t = np.linalg.norm(r)
    if t < 1e-12:
        return np.eye(3)
    x, y, z = r / t
    c = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(t) * c + (1 - np.cos(t)) * c @ c


def axis_angle(m):
    t = np.arccos(np.clip((np.trace(m) - 1) / 2, -1, 1))
    v = np.array([m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1]])
    if t < 1e-9:
        return v / 2
    if np.pi - t < 1e-6:
        w, q = np.linalg.eigh((m + m.T) / 2)
        return t * q[:, -1]
    return t * v / (2 * np.sin(t))


def _least_squares(f, x, rounds=60):
    """Levenberg-Marquardt with numeric derivatives."""
    lam, r = 1e-3, f(x)
    for _ in range(rounds):
        step = 1e-6 * np.maximum(1, np.abs(x))
        j = np.column_stack([(f(x + np.eye(len(x))[i] * step[i]) - r) / step[i] for i in range(len(x))])
        a, g = j.T @ j, j.T @ r
        moved = False
        for _ in range(8):
            try:
                d = np.linalg.solve(a + lam * np.diag(np.diag(a) + 1e-12), -g)
            except np.linalg.LinAlgError:
                lam *= 10
                continue
            s = f(x + d)
            if np.isfinite(s).all() and s @ s < r @ r:
                moved, gain = True, r @ r - s @ s
                x, r, lam = x + d, s, lam / 5
                break
            lam *= 5
        if not moved or gain < 1e-14 * (1 + r @ r):
            break
    return x, r


def _plane_homography(src, dst):
    from .features import homography

    return homography(np.asarray(src, float), np.asarray(dst, float))


def _pose_of(h, k):
    m = np.linalg.inv(k) @ h
    s = 2 / (np.linalg.norm(m[:, 0]) + np.linalg.norm(m[:, 1]))
    m = m * (s if m[2, 2] > 0 else -s)
    u, _, v = np.linalg.svd(np.column_stack([m[:, 0], m[:, 1], np.cross(m[:, 0], m[:, 1])]))
    return u @ np.diag([1, 1, np.linalg.det(u @ v)]) @ v, m[:, 2]


def _see(obj, r, t, k, dist):
    p = obj @ rodrigues(r).T + t
    return _lens(p[:, :2] / p[:, 2:], k, dist)


def calibrateCamera(object_points, image_points, image_size, camera_matrix=None, dist_coeffs=None, flags=0, criteria=None):
    """(error, K, distortion, rotations, translations): closed form from plane homographies, then joint refinement."""
    obj, img = ([np.asarray(p, float).reshape(len(p), -1) for p in v] for v in (object_points, image_points))
    hs = [_plane_homography(o[:, :2], i) for o, i in zip(obj, img, strict=True)]
    if camera_matrix is not None:
        k = np.array(camera_matrix, float)
    else:
        # Focal lengths from the orthogonality of the homographies' columns, the middle of the image given.
        c = np.array([[1, 0, (image_size[0] - 1) / 2], [0, 1, (image_size[1] - 1) / 2], [0, 0, 1]])
        rows, goal = [], []
        for h in hs:
            h = np.linalg.inv(c) @ h
            a, b = h[:, 0], h[:, 1]
            rows += [[a[0] * b[0], a[1] * b[1]], [a[0] ** 2 - b[0] ** 2, a[1] ** 2 - b[1] ** 2]]
            goal += [-a[2] * b[2], -(a[2] ** 2) + b[2] ** 2]
        f = np.sqrt(1 / np.maximum(np.abs(np.linalg.lstsq(np.array(rows), np.array(goal), rcond=None)[0]), 1e-12))
        k = np.array([[f[0], 0, c[0, 2]], [0, f[1], c[1, 2]], [0, 0, 1]])
    d = np.zeros(5)
    if dist_coeffs is not None:
        d[: min(5, np.size(dist_coeffs))] = np.ravel(dist_coeffs)[:5]
    poses = [_pose_of(h, k) for h in hs]
    x = np.concatenate([[k[0, 0], k[1, 1], k[0, 2], k[1, 2]], d, *[np.concatenate([axis_angle(r), t]) for r, t in poses]])

    def error(x):
        k = np.array([[x[0], 0, x[2]], [0, x[1], x[3]], [0, 0, 1]])
        return np.concatenate([(_see(o, x[9 + 6 * i : 12 + 6 * i], x[12 + 6 * i : 15 + 6 * i], k, x[4:9]) - p).ravel() for i, (o, p) in enumerate(zip(obj, img, strict=True))])

    x, r = _least_squares(error, x)
    each = x[9:].reshape(-1, 6)
    return float(np.sqrt(2 * (r @ r) / len(r))), np.array([[x[0], 0, x[2]], [0, x[1], x[3]], [0, 0, 1]]), x[4:9], list(each[:, :3]), list(each[:, 3:])


def findChessboardCorners(image, pattern_size, flags=0):
    """(found, corners): saddle points of the image's second derivatives, ordered into the grid by the homography of the outer four."""
    a = np.asarray(image)
    a = (dense.rgb_to_gray(a)[..., 0] if a.ndim == 3 and a.shape[2] == 3 else a.reshape(a.shape[:2])).astype(float)
    n = pattern_size[0] * pattern_size[1]
    s = dense.correlate(a[None, ..., None], dense.gaussian_kernel(9, 1.5))
    xx, yy, xy = (dense.correlate(s, dense.sobel_kernel(*d, 3))[0, ..., 0] for d in ((2, 0), (0, 2), (1, 1)))
    r = xy * xy - xx * yy
    p = np.pad(r, 4, constant_values=-np.inf)
    top = np.max([p[4 + dy : 4 + dy + a.shape[0], 4 + dx : 4 + dx + a.shape[1]] for dy in range(-4, 5) for dx in range(-4, 5)], 0)
    r = np.where((r == top) & (r > 0.1 * r.max()), r, 0)
    r[:3] = r[-3:] = r[:, :3] = r[:, -3:] = 0
    best = np.argsort(-r.ravel(), kind="stable")[:n]
    if (r.ravel()[best] <= 0).any() or len(best) < n:
        return False, None
    q = np.column_stack(np.unravel_index(best, r.shape))[:, ::-1].astype(float)
    quad = q[[(q @ v).argmin() for v in ([1, 1], [-1, 1], [-1, -1], [1, -1])]]
    w, h = pattern_size
    grid = np.array([(x, y) for y in range(h) for x in range(w)], float)
    m = _plane_homography(np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float), quad)
    d = ((project(m, grid)[:, None] - q) ** 2).sum(-1)
    pick = d.argmin(1)
    if len(set(pick.tolist())) < n:
        return False, None
    return True, q[pick].astype(np.float32)[:, None]


def undistort(src, camera_matrix, dist_coeffs, new_camera_matrix=None):
    a, k = np.asarray(src), np.asarray(camera_matrix, float)
    new = k if new_camera_matrix is None else np.asarray(new_camera_matrix, float)
    y, x = np.mgrid[: a.shape[0], : a.shape[1]]
    p = np.column_stack([(x.ravel() - new[0, 2]) / new[0, 0], (y.ravel() - new[1, 2]) / new[1, 1]])
    m = _lens(p, k, dist_coeffs).reshape(*a.shape[:2], 2)
    return dense.apply_remap(a, m[..., 0], m[..., 1])


def solvePnP(object_points, image_points, camera_matrix, dist_coeffs=None, use_extrinsic_guess=False, flags=0):
    """(found, rotation, translation): a linear start, then refinement of the reprojection error."""
    o, p, k = np.asarray(object_points, float).reshape(-1, 3), np.asarray(image_points, float).reshape(-1, 2), np.asarray(camera_matrix, float)
    if np.abs(o[:, 2] - o[0, 2]).max() < 1e-9:
        r, t = _pose_of(_plane_homography(o[:, :2], p), k)
        t = t - r[:, 2] * o[0, 2]
    else:
        if len(o) < 6:
            return False, None, None
        q = np.column_stack([p, np.ones(len(p))]) @ np.linalg.inv(k).T
        x, z = np.column_stack([o, np.ones(len(o))]), np.zeros((len(o), 4))
        m = np.linalg.svd(np.concatenate([np.column_stack([x, z, -q[:, :1] * x]), np.column_stack([z, x, -q[:, 1:2] * x])]))[2][-1].reshape(3, 4)
        m *= np.sign((x @ m[2]).mean()) / np.linalg.norm(m[2, :3])
        u, _, v = np.linalg.svd(m[:, :3])
        r, t = u @ np.diag([1, 1, np.linalg.det(u @ v)]) @ v, m[:, 3]
    x, _ = _least_squares(lambda x: (_see(o, x[:3], x[3:], k, dist_coeffs) - p).ravel(), np.concatenate([axis_angle(r), t]))
    return True, x[:3], x[3:]


def stereoCalibrate(object_points, image_points1, image_points2, camera_matrix1, dist_coeffs1, camera_matrix2, dist_coeffs2, image_size, flags=0, criteria=None):
    """(error, K1, d1, K2, d2, R, T, E, F) from the views' poses in both cameras."""
    obj = [np.asarray(o, float).reshape(-1, 3) for o in object_points]
    sides = [[solvePnP(o, p, k, d)[1:] for o, p in zip(obj, img, strict=True)] for img, k, d in ((image_points1, camera_matrix1, dist_coeffs1), (image_points2, camera_matrix2, dist_coeffs2))]
    rel = [(rodrigues(r2) @ rodrigues(r1).T, r1, t1, r2, t2) for (r1, t1), (r2, t2) in zip(*sides, strict=True)]
    start = np.concatenate([np.median([axis_angle(m) for m, *_ in rel], 0), np.median([t2 - m @ t1 for m, _, t1, _, t2 in rel], 0), *[np.concatenate([r1, t1]) for _, r1, t1, _, _ in rel]])

    def error(x):
        m, out = rodrigues(x[:3]), []
        for i, o in enumerate(obj):
            r, t = x[6 + 6 * i : 9 + 6 * i], x[9 + 6 * i : 12 + 6 * i]
            out.append(_see(o, r, t, np.asarray(camera_matrix1, float), dist_coeffs1) - np.reshape(image_points1[i], (-1, 2)))
            out.append(_see(o, axis_angle(m @ rodrigues(r)), m @ t + x[3:6], np.asarray(camera_matrix2, float), dist_coeffs2) - np.reshape(image_points2[i], (-1, 2)))
        return np.concatenate(out).ravel()

    x, r = _least_squares(error, start)
    m, t = rodrigues(x[:3]), x[3:6]
    e = np.array([[0, -t[2], t[1]], [t[2], 0, -t[0]], [-t[1], t[0], 0]]) @ m
    f = np.linalg.inv(camera_matrix2).T @ e @ np.linalg.inv(camera_matrix1)
    return float(np.sqrt(2 * (r @ r) / len(r))), camera_matrix1, dist_coeffs1, camera_matrix2, dist_coeffs2, m, t, e, f / f[2, 2] if abs(f[2, 2]) > 1e-12 else f


def stereoRectify(camera_matrix1, dist_coeffs1, camera_matrix2, dist_coeffs2, image_size, r, t, flags=1, alpha=-1.0, new_image_size=None):
    """(R1, R2, P1, P2, Q, roi1, roi2): both cameras turn half way and then to the baseline."""
    k1, k2, t = np.asarray(camera_matrix1, float), np.asarray(camera_matrix2, float), np.ravel(np.asarray(t, float))
    half = rodrigues(-0.5 * axis_angle(np.asarray(r, float)))
    u = half @ t
    axis = int(np.abs(u[:2]).argmax())
    goal = np.zeros(3)
    goal[axis] = 1 if u[axis] > 0 else -1
    w = np.cross(u, goal)
    n = np.linalg.norm(w)
    turn = rodrigues(w / n * np.arccos(np.clip(np.abs(u[axis]) / np.linalg.norm(u), -1, 1))) if n > 1e-12 else np.eye(3)
    r1, r2 = turn @ half.T, turn @ half
    f, (w_, h_) = min(k1[1, 1], k2[1, 1]), image_size
    c = ((w_ - 1) / 2, (h_ - 1) / 2)
    p1 = np.array([[f, 0, c[0], 0], [0, f, c[1], 0], [0, 0, 1, 0]])
    p2 = p1.copy()
    shift = (r2 @ t)[axis]
    p2[axis, 3] = shift * f
    q = np.array([[1, 0, 0, -c[0]], [0, 1, 0, -c[1]], [0, 0, 0, f], [0, 0, -1 / shift, 0]])
    roi = (0, 0, int(w_), int(h_))
    return r1, r2, p1, p2, q, roi, roi


def reprojectImageTo3D(disparity, q, handle_missing_values=False, ddepth=-1):
    d = np.asarray(disparity, float)
    y, x = np.mgrid[: d.shape[0], : d.shape[1]]
    v = np.stack([x, y, d, np.ones_like(d)], -1) @ np.asarray(q, float).T
    with np.errstate(divide="ignore", invalid="ignore"):
        out = v[..., :3] / v[..., 3:]
    if handle_missing_values:
        out[d == d.min()] = (0, 0, 10000)
    return out.astype(np.float32)


def _eight(a, b):
    from .features import _normaliser

    t, u = _normaliser(a), _normaliser(b)
    p, q = (np.column_stack([x, np.ones(len(x))]) @ m.T for x, m in ((a, t), (b, u)))
    f = np.linalg.svd((q[:, :, None] * p[:, None, :]).reshape(len(p), 9))[2][-1].reshape(3, 3)
    w, s, v = np.linalg.svd(f)
    return u.T @ (w @ np.diag([s[0], s[1], 0]) @ v) @ t


def _epipolar(f, a, b):
    p, q = (np.column_stack([x, np.ones(len(x))]) for x in (a, b))
    l2, l1 = p @ f.T, q @ f
    d = np.abs((q * l2).sum(1))
    return np.maximum(d / np.maximum(np.hypot(*l2[:, :2].T), 1e-12), d / np.maximum(np.hypot(*l1[:, :2].T), 1e-12))


def findFundamentalMat(points1, points2, method=8, ransac_reproj_threshold=3.0, confidence=0.99, max_iters=2000):
    """(F, mask) by the normalised eight-point method; method 8 draws seeded samples and refits on the largest consensus."""
    a, b = (np.asarray(p, float).reshape(-1, 2) for p in (points1, points2))
    if len(a) < 8:
        return None, None
    best = np.ones(len(a), bool)
    if method == 8:
        g, best = _congruential(7), np.zeros(len(a), bool)
        for _ in range(max_iters if len(a) > 8 else 1):
            pick: set[int] = set()
            while len(pick) < 8:
                pick.add((next(g) >> 16) % len(a))
            near = _epipolar(_eight(a[list(pick)], b[list(pick)]), a, b) < ransac_reproj_threshold
            if near.sum() > best.sum():
                best = near
                if (1 - best.mean() ** 8) < 1 and best.all():
                    break
        if best.sum() < 8:
            best = np.ones(len(a), bool)
    f = _eight(a[best], b[best])
    return f / f[2, 2] if abs(f[2, 2]) > 1e-12 else f, best.astype(np.uint8)[:, None]


def findEssentialMat(points1, points2, camera_matrix=None, method=8, prob=0.999, threshold=1.0):
    k = np.eye(3) if camera_matrix is None else np.asarray(camera_matrix, float)
    f, mask = findFundamentalMat(points1, points2, method, threshold, prob)
    if f is None:
        return None, None
    u, s, v = np.linalg.svd(k.T @ f @ k)
    return u @ np.diag([1, 1, 0]) @ v, mask


def decomposeHomographyMat(h, k):
    """(n, rotations, translations, normals) by the singular value method; each solution twice, with signs turned."""
    k = np.asarray(k, float)
    m = np.linalg.inv(k) @ np.asarray(h, float) @ k
    m = m / np.linalg.svd(m)[1][1]
    m = m * np.sign(np.linalg.det(m))
    s, v = np.linalg.eigh(m.T @ m)
    s, v = s[::-1], v[:, ::-1]
    if s[0] - s[2] < 1e-9:
        return 1, [m], [np.zeros(3)], [np.zeros(3)]
    v = v * np.sign(np.linalg.det(v))
    up, down, out = np.sqrt(max(1 - s[2], 0)), np.sqrt(max(s[0] - 1, 0)), []
    for sign in (1, -1):
        u = (up * v[:, 0] + sign * down * v[:, 2]) / np.sqrt(s[0] - s[2])
        a = np.column_stack([v[:, 1], u, np.cross(v[:, 1], u)])
        b = np.column_stack([m @ v[:, 1], m @ u, np.cross(m @ v[:, 1], m @ u)])
        r, n = b @ a.T, np.cross(v[:, 1], u)
        t = (m - r) @ n
        out += [(r, t, n), (r, -t, -n)]
    return len(out), *(list(x) for x in zip(*out, strict=True))


def triangulatePoints(proj_matrix1, proj_matrix2, proj_points1, proj_points2):
    """(4, n) homogeneous points by the linear method."""
    p, q = np.asarray(proj_matrix1, float), np.asarray(proj_matrix2, float)
    a, b = (np.asarray(x, float).reshape(2, -1) for x in (proj_points1, proj_points2))
    m = np.stack([a[0][:, None] * p[2] - p[0], a[1][:, None] * p[2] - p[1], b[0][:, None] * q[2] - q[0], b[1][:, None] * q[2] - q[1]], 1)
    return np.linalg.svd(m)[2][:, -1].T


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "np", "dense", "half_away", "round8", "trunc8", "project")]
