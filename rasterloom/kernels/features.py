"""Keypoints, descriptors, matching and homographies on single images."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np

from . import dense, shapes
from .dense import half_away
from .shapes import Canvas, grey


@dataclass(frozen=True)
class KeyPoint:
    x: float
    y: float
    size: float = 0.0
    angle: float = -1.0
    response: float = 0.0
    octave: int = 0
    class_id: int = -1

    @property
    def pt(self) -> tuple[float, float]:
        return self.x, self.y


@dataclass(frozen=True)
class DMatch:
    query_idx: int
    train_idx: int
    distance: float
    img_idx: int = 0


#: The ring of 16 pixels about a candidate as (dy, dx), clockwise from the top.
CIRCLE = ((-3, 0), (-3, 1), (-2, 2), (-1, 3), (0, 3), (1, 3), (2, 2), (3, 1), (3, 0), (3, -1), (2, -2), (1, -3), (0, -3), (-1, -3), (-2, -2), (-3, -1))


def _nine_runs():
    """For each set of 16 places on a ring, as bits: those that are in a run of nine or more, 0 without one."""
    m, out = np.arange(1 << 16), np.zeros(1 << 16, int)
    for s in range(16):
        run = (0x1FF << s | 0x1FF >> 16 - s) & 0xFFFF
        out |= np.where(m & run == run, run, 0)
    return out.astype(np.uint16)


NINE = _nine_runs()


def fast_detect(image, threshold=10, nonmax_suppression=True):
    """FAST-9: a run of nine ring pixels brighter or darker by the threshold; the score sums the best run's excess."""
    a = grey(image).astype(np.int32)
    h, w = a.shape
    if h < 7 or w < 7:
        return []
    centre = a[3 : h - 3, 3 : w - 3]
    bits, compass = [np.zeros(centre.shape, np.uint16) for _ in "+-"], [np.zeros(centre.shape, np.uint8) for _ in "+-"]
    for i, (dy, dx) in enumerate(CIRCLE):
        d = a[3 + dy : h - 3 + dy, 3 + dx : w - 3 + dx] - centre
        for side, over in enumerate((d > threshold, d < -threshold)):
            bits[side] |= np.multiply(over, np.uint16(1 << i), dtype=np.uint16)
            if i % 4 == 0:
                compass[side] += over
    hopeful = (compass[0] >= 2) | (compass[1] >= 2)
    score, corner, flat = np.zeros((h, w), np.float32), np.zeros((h, w), bool), a.ravel()
    around = np.array([dy * w + dx for dy, dx in CIRCLE])[:, None]
    for sign, side in ((1, bits[0]), (-1, bits[1])):
        run = NINE[side] * hopeful
        ys, xs = np.nonzero(run)
        at, run = (ys + 3) * w + xs + 3, run[ys, xs]
        excess = sign * (flat[at + around] - flat[at]) - threshold
        best = (excess * (run >> np.arange(16, dtype=np.uint16)[:, None] & 1)).sum(0)
        best = np.where(run == 0xFFFF, 2 * best, best)  # a full ring is gone round twice
        corner.ravel()[at] = True
        score.ravel()[at] = np.maximum(score.ravel()[at], best)
    if nonmax_suppression:
        p = np.pad(score, 1)
        p = np.maximum(np.maximum(p[:-2], p[1:-1]), p[2:])
        corner &= score >= np.maximum(np.maximum(p[:, :-2], p[:, 1:-1]), p[:, 2:])
    ys, xs = np.nonzero(corner)
    return [KeyPoint(x, y, 7.0, -1.0, s) for x, y, s in zip(xs.astype(float).tolist(), ys.astype(float).tolist(), score[ys, xs].astype(float).tolist(), strict=True)]


def _by_response(points):
    return sorted(points, key=lambda p: -p.response)


def good_features_to_track(image, max_corners=1000, quality_level=0.01, min_distance=10.0, block_size=3, use_harris_detector=False, k=0.04):
    """Local maxima of the corner response over a share of the best, best first, each far enough from those before."""
    a = grey(image)
    xx, yy, xy = dense.structure_tensor(a[None, :, :, None], block_size)
    r = (xx * yy - xy * xy - np.float32(k) * (xx + yy) ** 2 if use_harris_detector else dense._eigen(xx, yy, xy)[1])[0]
    h, w = r.shape
    p = np.pad(r, 1, constant_values=-np.inf)
    p = np.maximum(np.maximum(p[:-2], p[1:-1]), p[2:])
    top = np.maximum(np.maximum(p[:, :-2], p[:, 1:-1]), p[:, 2:])
    ok = (r > np.float32(quality_level) * max(np.float32(0), r.max())) & (r >= top)
    ok[[0, -1]] = ok[:, [0, -1]] = False
    ys, xs = np.nonzero(ok)
    order = np.argsort(-r[ys, xs], kind="stable")
    # Pixels that are too near to a kept one, by the disc about it.
    reach = max(0, int(np.ceil(min_distance)))
    dy, dx = np.mgrid[-reach : reach + 1, -reach : reach + 1]
    disc, near = dy * dy + dx * dx < min_distance**2, np.zeros((h + 2 * reach, w + 2 * reach), bool)
    out = []
    for x, y, v in zip(xs[order].tolist(), ys[order].tolist(), r[ys, xs][order].astype(float).tolist(), strict=True):
        if not near[y + reach, x + reach]:
            near[y : y + 2 * reach + 1, x : x + 2 * reach + 1] |= disc
            out.append(KeyPoint(float(x), float(y), float(block_size), -1.0, v))
            if len(out) >= max_corners:
                break
    return out


def _congruential(seed):
    while True:
        seed = (seed * 1103515245 + 12345) & 0xFFFFFFFF
        yield seed


@lru_cache(1)
def brief_pairs():
    g = _congruential(0x12345678)
    return np.array([(next(g) // 65536) % 31 - 15 for _ in range(1024)]).reshape(256, 2, 2)


def _centroid_angles(a, x, y):
    """Directions of the centroids of the discs about the points (x, y)."""
    dy, dx = np.mgrid[-15:16, -15:16]
    inside = dx * dx + dy * dy <= 225
    dy, dx = dy[inside], dx[inside]
    v = a[y[:, None] + dy, x[:, None] + dx].astype(float)  # whole numbers: their sums are exact in any order
    return np.arctan2(v @ dy.astype(float), v @ dx.astype(float))


#: Keypoints that are described at once.
SOME = 64


def _described(found, describe, max_features, width, kind=np.uint8):
    """The first so many keypoints that describe() keeps, in order, and their rows. describe(points) gives the angles in degrees, the rows, and which to keep."""
    points, rows = [], [np.zeros((0, width), kind)]
    for i in range(0, len(found), SOME):
        part = found[i : i + SOME]
        angles, values, keep = describe(part)
        which = np.flatnonzero(keep)[: max_features - len(points)]
        points += [replace(p, angle=t) for p, t in zip([part[k] for k in which], angles[which].tolist(), strict=True)]
        rows.append(values[which])
        if len(points) >= max_features:
            break
    return points, np.concatenate(rows).astype(kind)


def _bits(flags):
    return np.packbits(flags, axis=-1, bitorder="little")


def orb_detect_and_compute(image, max_features=500, threshold=20, border=16):
    """FAST corners with a centroid angle and 256 rotated comparisons; a corner whose own rotated offsets leave the image is left out."""
    a, pairs = grey(image), brief_pairs()
    h, w = a.shape
    found = [p for p in _by_response(fast_detect(a, threshold)) if border <= p.x < w - border and border <= p.y < h - border]
    if border < 15 and any(not (15 <= p.x < w - 15 and 15 <= p.y < h - 15) for p in found):
        raise ValueError("a corner's disc leaves the image")

    def describe(part):
        x, y = (np.array(v, int) for v in zip(*((p.x, p.y) for p in part), strict=True))
        t = _centroid_angles(a, x, y)
        c, s = np.cos(t)[:, None, None], np.sin(t)[:, None, None]
        u, v = (half_away(pairs[..., 0] * i + pairs[..., 1] * j).astype(int) for i, j in ((c, -s), (s, c)))
        u, v = u + x[:, None, None], v + y[:, None, None]
        ok = (v.min((1, 2)) >= 0) & (u.min((1, 2)) >= 0) & (v.max((1, 2)) < h) & (u.max((1, 2)) < w)
        values = a[np.clip(v, 0, h - 1), np.clip(u, 0, w - 1)]
        return np.degrees(t), _bits(values[..., 0] < values[..., 1]), ok

    return _described(found, describe, max_features, 32)


def _octaves(a, detect, sizes):
    h, w = a.shape
    found = []
    for o, size in enumerate(sizes):
        f = 1 << o
        if o and min(h, w) <= 15 * f:
            continue
        small = a[::f, ::f][: h // f, : w // f]
        found += [(KeyPoint(p.x * f, p.y * f, size, p.angle, p.response, o, p.class_id), 1 / f) for p in detect(small)]
    return sorted(found, key=lambda t: -t[0].response)


def _far_in(p, scale, shape, border=16):
    x, y = (int(math.copysign(math.floor(abs(v * scale) + 0.5), v)) for v in p.pt)
    return border <= x < int(shape[1] * scale) - border and border <= y < int(shape[0] * scale) - border


def sift_detect_and_compute(image, max_features=500):
    """Corners of three octaves with a dominant orientation (36 bins) and 4x4x8 gradient histograms, clipped at 0.2."""
    a = grey(image)
    v = a.astype(float)
    h, w = a.shape
    gx, gy = np.zeros_like(v), np.zeros_like(v)
    gx[:, 1:-1], gy[1:-1] = v[:, 2:] - v[:, :-2], v[2:] - v[:-2]
    mag, ang = np.hypot(gx, gy), np.arctan2(gy, gx)
    points, rows = [], []
    for p, scale in _octaves(a, lambda i: good_features_to_track(i, max_features), (1.6, 3.2, 6.4)):
        if not _far_in(p, scale, a.shape):
            continue
        dy, dx = np.mgrid[-8:9, -8:9]
        x, y = (int(p.x) + dx * int(1 / scale)).astype(int), (int(p.y) + dy * int(1 / scale)).astype(int)
        ok = (x > 0) & (x < w - 1) & (y > 0) & (y < h - 1)
        bins = half_away(np.degrees(ang[y[ok], x[ok]] % (2 * np.pi)) / 10).astype(int) % 36
        hist = np.bincount(bins, mag[y[ok], x[ok]] * np.exp(-(dx * dx + dy * dy)[ok] / 32), 36)
        turn = np.radians(int(hist.argmax()) * 10.0)
        dy, dx = np.mgrid[-8:8, -8:8]
        rx, ry = dx * np.cos(turn) - dy * np.sin(turn), dx * np.sin(turn) + dy * np.cos(turn)
        x, y = half_away(p.x + rx / scale).astype(int), half_away(p.y + ry / scale).astype(int)
        sx, sy = np.floor((rx + 8) / 4).astype(int), np.floor((ry + 8) / 4).astype(int)
        ok = (x > 0) & (x < w - 1) & (y > 0) & (y < h - 1) & (sx >= 0) & (sx < 4) & (sy >= 0) & (sy < 4)
        t = ang[y[ok], x[ok]] - turn
        bins = half_away(np.degrees(np.where(t < 0, t + 2 * np.pi, t)) / 45).astype(int) % 8
        d = np.bincount((sy * 4 + sx)[ok] * 8 + bins, mag[y[ok], x[ok]] * np.exp(-(dx * dx + dy * dy)[ok] / 128), 128).astype(np.float32)
        if np.linalg.norm(d) > 1e-6:
            d = np.minimum(d / np.linalg.norm(d), np.float32(0.2))
            d /= max(np.linalg.norm(d), 1e-6)
        points.append(replace(p, angle=float(np.degrees(turn))))
        rows.append(d)
        if len(points) >= max_features:
            break
    return points, np.array(rows, np.float32).reshape(-1, 128)


@lru_cache(1)
def brisk_pattern():
    rings = [(0.0, 1), (1.5, 4), (3.5, 10), (6.5, 18), (10.5, 28)]
    return np.array([(r * np.cos(2 * np.pi * i / n), r * np.sin(2 * np.pi * i / n)) for r, n in rings for i in range(n)])


def brisk_pairs(pattern):
    return _brisk_pairs(tuple(map(tuple, pattern.tolist())))


@lru_cache(1)
def _brisk_pairs(points):
    pattern = np.array(points)
    i, j = np.triu_indices(len(pattern), 1)
    d = np.hypot(*(pattern[i] - pattern[j]).T)
    short = list(zip(i[d < 3.5].tolist(), j[d < 3.5].tolist(), strict=True))[:512]
    g = _congruential(0x87654321)
    while len(short) < 512:
        a, b = next(g) % len(pattern), next(g) % len(pattern)
        if a != b:
            short.append((a, b))
    return np.array(short), np.column_stack([i, j])[d > 6.0]


def _bilinear(a, x, y):
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = x - x0, y - y0
    x1, y1 = np.minimum(x0 + 1, a.shape[1] - 1), np.minimum(y0 + 1, a.shape[0] - 1)
    x0, y0 = np.maximum(x0, 0), np.maximum(y0, 0)
    return (1 - fx) * (1 - fy) * a[y0, x0] + fx * (1 - fy) * a[y0, x1] + (1 - fx) * fy * a[y1, x0] + fx * fy * a[y1, x1]


def brisk_detect_and_compute(image, max_features=500, threshold=20):
    """FAST corners of three octaves; long pairs of the sampling pattern give the angle, 512 short pairs the bits."""
    a = grey(image)
    v, pattern = a.astype(float), brisk_pattern()
    short, long = brisk_pairs(pattern)
    way = pattern[long[:, 1]] - pattern[long[:, 0]]
    way /= np.hypot(*way.T)[:, None]
    px, py = pattern.T
    found = [(p, scale) for p, scale in _octaves(a, lambda i: fast_detect(i, threshold), (1.0, 2.0, 4.0)) if _far_in(p, scale, a.shape)]
    scales = {p: scale for p, scale in found}

    def describe(part):
        x, y, scale = np.array([(p.x, p.y, scales[p]) for p in part]).T[..., None]
        s = _bilinear(v, x + px / scale, y + py / scale)
        t = np.arctan2(*(way * (s[:, long[:, 1]] - s[:, long[:, 0]])[..., None]).sum(1).T[::-1])
        c, e = np.cos(t)[:, None], np.sin(t)[:, None]
        s = _bilinear(v, x + (px * c - py * e) / scale, y + (px * e + py * c) / scale)
        return np.degrees(t), _bits(s[:, short[:, 0]] < s[:, short[:, 1]]), np.ones(len(part), bool)

    return _described([p for p, _ in found], describe, max_features, 64)


def smooth_bilateral(a, space, colour):
    """Bilateral filter over three sigmas, taps outside the image left out. Weights come from tables by difference, strips of rows keep what is held small."""
    r, out = int(np.ceil(3 * space)), np.zeros(a.shape, np.uint8)
    # 0 to 510 are differences from -255 on; what lies outside the image counts as 767 and weighs 0.
    table = np.zeros(1024)
    table[:511] = np.exp(-(np.arange(-255.0, 256.0) ** 2) / (2 * colour**2))
    taps = [(dy, dx, np.exp(-(dx * dx + dy * dy) / (2 * space**2)) * table) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]
    whole = np.pad(a.astype(np.int64) + 255, r, constant_values=767 + 255)
    for y in range(0, len(a), 64):
        v = a[y : y + 64].astype(np.int64)
        strip = whole[y : y + len(v) + 2 * r]
        value = np.where(strip > 510, 0, strip - 255).astype(float)
        total, norm, at, wt = np.zeros(v.shape), np.zeros(v.shape), np.empty_like(v), np.empty(v.shape)
        for dy, dx, weights in taps:
            here = slice(r + dy, r + dy + v.shape[0]), slice(r + dx, r + dx + v.shape[1])
            weights.take(np.subtract(strip[here], v, out=at), out=wt, mode="clip")
            norm += wt
            total += np.multiply(value[here], wt, out=wt)
        out[y : y + 64] = dense.round8(total / norm)
    return out


#: The cells of 2x2 and 3x3 (n, step, size), and which of each are compared.
CELLS = tuple((n, step, size, np.triu_indices(n * n, 1)) for n, step, size in ((2, 8, 8), (3, 5, 6)))


def akaze_detect_and_compute(image, max_features=500):
    """Corners of three smoothing levels; 126 comparisons of cell means (2x2 and 3x3) of value and gradient."""
    a = grey(image)
    levels = [a, smooth_bilateral(a, 1.5, 20.0)]
    levels.append(smooth_bilateral(levels[1], 3.0, 40.0))
    found = _by_response([replace(p, octave=o, size=float(1 << o)) for o, level in enumerate(levels) for p in good_features_to_track(level, max_features)])
    found = [p for p in found if _far_in(p, 1.0, a.shape)]
    h, w = a.shape
    flat, stack = np.concatenate(levels), np.stack(levels).astype(float)
    dy, dx = np.mgrid[-8.0:8, -8.0:8]

    def describe(part):
        px, py, o = (np.array(v) for v in zip(*((p.x, p.y, p.octave) for p in part), strict=True))
        t = _centroid_angles(flat, px.astype(int), py.astype(int) + o * h)
        c, s, o = np.cos(t)[:, None, None], np.sin(t)[:, None, None], o[:, None, None]
        x, y = (half_away(p[:, None, None] + dx * i + dy * j).astype(int) for p, i, j in ((px, c, -s), (py, s, c)))
        ok = (x > 0) & (x < w - 1) & (y > 0) & (y < h - 1)
        x, y = np.where(ok, x, 1), np.where(ok, y, 1)
        patch = np.stack([stack[o, y, x], stack[o, y, x + 1] - stack[o, y, x - 1], stack[o, y + 1, x] - stack[o, y - 1, x]], 1) * ok[:, None]
        flags = []
        for n, step, size, (i, j) in CELLS:
            cells = np.stack([patch[..., p * step : p * step + size, q * step : q * step + size].mean((-2, -1)) for p in range(n) for q in range(n)], 1)
            flags.append((cells[:, i] < cells[:, j]).reshape(len(part), -1))
        return np.degrees(t), _bits(np.concatenate([*flags, np.zeros((len(part), 2), bool)], 1)), np.ones(len(part), bool)

    return _described(found, describe, max_features, 16)


def _regions(lab, sizes, least, most):
    """(label, flat places in raster order) of regions of least to most pixels. One sort of the labels finds all."""
    order, end = np.argsort(lab.ravel(), kind="stable"), np.cumsum(sizes)
    for k in np.flatnonzero((sizes >= least) & (sizes <= most)):
        if k:
            yield int(k), order[end[k] - sizes[k] : end[k]]


def mser_detect(image, delta=5, min_area=60, max_area=14400, max_variation=0.25):
    """Regions at or below a threshold whose area hardly changes between the thresholds beside it; ties take the least label."""
    a = grey(image)
    levels = [shapes.label(a <= t, 4) for t in range(delta, 256 - delta, delta)]
    sizes = [np.bincount(lab.ravel()) for lab in levels]
    h, w = a.shape
    out = []
    for i in range(1, len(levels) - 1):
        for _, at in _regions(levels[i], sizes[i], min_area, max_area):
            area, near = len(at), []
            for j in (i - 1, i + 1):
                c, n = np.unique(levels[j].ravel()[at], return_counts=True)
                c, n = c[c > 0], n[c > 0]
                near.append(int(sizes[j][c[n.argmax()]]) if len(c) else None)
            if None not in near and (near[1] - near[0]) / area <= max_variation:
                y, x = np.divmod(at, w)
                top, left = y.min(), x.min()
                mask = np.zeros((y.max() - top + 1, x.max() - left + 1), bool)
                mask[y - top, x - left] = True
                out.append([(u + int(left), v + int(top)) for u, v in shapes.breadth_first(mask, 0, int(x[0] - left))])
    return out


def simple_blob_detect(image, min_threshold=50.0, max_threshold=220.0, threshold_step=10.0, min_dist_between_blobs=10.0, min_repeatability=2, filter_by_color=True, blob_color=0, filter_by_area=True, min_area=25.0, max_area=5000.0, filter_by_circularity=False, min_circularity=0.8, max_circularity=3.4e38, filter_by_inertia=False, min_inertia_ratio=0.1, max_inertia_ratio=3.4e38, filter_by_convexity=False, min_convexity=0.95, max_convexity=3.4e38):
    """Dark regions over a sweep of thresholds, filtered by shape, grouped by distance to the first of a group."""
    a = grey(image)
    groups: list[list[tuple[float, float, float]]] = []
    cells: dict[tuple[int, int], list[int]] = {}  # groups by the place of their first, in cells as wide as the least distance
    for t in np.arange(min_threshold, max_threshold + 1e-9, threshold_step):
        lab = shapes.label(a <= int(t), 4)
        for _, at in _regions(lab, np.bincount(lab.ravel()), min_area if filter_by_area else 1, max_area if filter_by_area else a.size):
            y, x = np.divmod(at, a.shape[1])
            area, cx, cy = float(len(x)), x.mean(), y.mean()
            if filter_by_color and (a[int(half_away(cy)), int(half_away(cx))] > 128) == (blob_color == 0) and blob_color in (0, 255):
                continue
            if filter_by_circularity:
                p = np.zeros((y.max() - y.min() + 3, x.max() - x.min() + 3), bool)
                p[y - y.min() + 1, x - x.min() + 1] = True
                edge = p[1:-1, 1:-1] & ~(p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:])
                if not min_circularity <= 4 * np.pi * area / max(edge.sum(), 1) ** 2 <= max_circularity:
                    continue
            if filter_by_inertia:
                lam = np.linalg.eigvalsh(np.cov(np.stack([x, y]).astype(float), bias=True)) if area > 1 else np.ones(2)
                if not min_inertia_ratio <= (lam[0] / lam[1] if lam[1] > 1e-9 else 1.0) <= max_inertia_ratio:
                    continue
            if filter_by_convexity:
                hull = shapes.convex_hull(np.column_stack([x, y]))
                if not min_convexity <= area / max(shapes.contour_area(hull), 1e-9) <= max_convexity:
                    continue
            blob = (cx, cy, 2 * np.sqrt(area / np.pi))
            u, v = (int(k // max(min_dist_between_blobs, 1e-9)) for k in (cx, cy))
            some = sorted(g for i in (u - 1, u, u + 1) for j in (v - 1, v, v + 1) for g in cells.get((i, j), ()))
            for g in some:
                if np.hypot(groups[g][0][0] - cx, groups[g][0][1] - cy) < min_dist_between_blobs:
                    groups[g].append(blob)
                    break
            else:
                cells.setdefault((u, v), []).append(len(groups))
                groups.append([blob])
    return [KeyPoint(*map(float, np.mean(g, 0)), -1.0, float(len(g))) for g in groups if len(g) >= min_repeatability]


def _distances(q, t, norm_type):
    q, t = np.asarray(q), np.asarray(t)
    if q.dtype == np.uint8:
        return np.bitwise_count(q[:, None] ^ t[None]).sum(-1).astype(np.float32)
    d = q[:, None].astype(np.float32) - t[None].astype(np.float32)
    return np.abs(d).sum(-1) if norm_type == "L1" else np.sqrt((d * d).sum(-1))


def bf_match(query_descriptors, train_descriptors, cross_check=False, norm_type="L2"):
    """The nearest train row of each query (the first of equals): Hamming for bytes, else L2 or L1."""
    if not len(query_descriptors) or not len(train_descriptors):
        return []
    d = _distances(query_descriptors, train_descriptors, norm_type)
    best, back = d.argmin(1), d.argmin(0)
    return [DMatch(i, int(j), float(d[i, j])) for i, j in enumerate(best) if not cross_check or back[j] == i]


def knn_match(query_descriptors, train_descriptors, k, norm_type="L2"):
    if not len(query_descriptors) or not len(train_descriptors):
        return [[] for _ in range(len(query_descriptors))]
    d = _distances(query_descriptors, train_descriptors, norm_type)
    return [[DMatch(i, int(j), float(row[j])) for j in np.argsort(row, kind="stable")[:k]] for i, row in enumerate(d)]


def flann_match(query_descriptors, train_descriptors):
    """Exact nearest neighbours, as a k-d tree with full back-tracking finds them."""
    return bf_match(query_descriptors, train_descriptors)


def _three(image):
    a = np.asarray(image, np.uint8)
    return np.repeat(a[..., None], 3, 2) if a.ndim == 2 else a[..., :3].copy()


def _rings(c, points, radius):
    """Circles of one pixel about (n, 2) points, in the canvas's colour."""
    dx, dy = shapes.ring_of(radius)
    x, y = np.asarray(points, int).reshape(-1, 2).T
    c.dots((x[:, None] + dx).ravel(), (y[:, None] + dy).ravel())


def drawKeypoints(image, keypoints, color=None, flags=0):
    """Circles of radius 3; with flag 4 of the keypoint's size, and a radius at its angle."""
    c = Canvas(_three(image), 0)
    at = half_away(np.array([p.pt for p in keypoints], float).reshape(-1, 2)).astype(int)
    x, y = np.array([p.pt for p in keypoints], float).reshape(-1, 2).T
    hues = np.stack([(x * u + y * v).astype(int) % 256 for u, v in ((456.123, 789.789), (789.123, 123.789), (123.456, 456.789))], 1)
    if color is not None:
        hues[:] = color
    if not flags & 4:
        # The last circle at a pixel is what is seen there.
        dx, dy = shapes.ring_of(3)
        u, v = at[:, :1] + dx, at[:, 1:] + dy
        ok, last = (u >= 0) & (u < c.w) & (v >= 0) & (v < c.h), np.full((c.h, c.w), -1)
        np.maximum.at(last, (v[ok], u[ok]), np.nonzero(ok)[0])
        c.a[last >= 0] = hues[last[last >= 0]]
        return c.out
    for p, (x, y), hue in zip(keypoints, at.tolist(), hues, strict=True):
        c.colour[:] = hue
        r = max(int(half_away(p.size / 2)), 1)
        shapes._circle_on(c, x, y, r, 1)
        if p.angle >= 0:
            t = np.radians(p.angle)
            c.line((x, y), half_away(np.array([x + r * np.cos(t), y + r * np.sin(t)])).astype(int))
    return c.out


def drawMatches(img1, keypoints1, img2, keypoints2, matches, match_color=None, single_point_color=None):
    """Both images side by side, circles at keypoints, lines between matched ones."""
    a, b = _three(img1), _three(img2)
    out = np.zeros((max(len(a), len(b)), a.shape[1] + b.shape[1], 3), np.uint8)
    out[: len(a), : a.shape[1]], out[: len(b), a.shape[1] :] = a, b
    c = Canvas(out, 0)
    sides = [half_away(np.array([p.pt for p in points], float).reshape(-1, 2)).astype(int) + [dx, 0] for points, dx in ((keypoints1, 0), (keypoints2, a.shape[1]))]
    used = [np.array([getattr(m, n) for m in matches], int) for n in ("query_idx", "train_idx")]
    p, q = (side[i] for side, i in zip(sides, used, strict=True))
    c.colour[:] = match_color if match_color is not None else (0, 255, 0)
    c.lines(p, q)
    _rings(c, np.concatenate([p, q]), 3)
    c.colour[:] = single_point_color if single_point_color is not None else (255, 0, 0)
    for side, i in zip(sides, used, strict=True):
        _rings(c, np.delete(side, i, 0), 3)
    return c.out


def _normaliser(p):
    m = p.mean(0)
    d = np.hypot(*(p - m).T).mean()
    s = np.sqrt(2) / d if d > 1e-9 else 1.0
    return np.array([[s, 0, -s * m[0]], [0, s, -s * m[1]], [0, 0, 1]])


def homography(src, dst):
    """Normalised direct linear transform."""
    t, u = _normaliser(src), _normaliser(dst)
    a, b = (np.column_stack([p, np.ones(len(p))]) @ m.T for p, m in ((src, t), (dst, u)))
    z = np.zeros_like(a)
    rows = np.concatenate([np.column_stack([-a, z, b[:, :1] * a]), np.column_stack([z, -a, b[:, 1:2] * a])])
    h = np.linalg.inv(u) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ t
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else h


def project(h, p):
    q = np.column_stack([p, np.ones(len(p))]) @ h.T
    with np.errstate(divide="ignore", invalid="ignore"):
        return q[:, :2] / q[:, 2:]


def findHomography(src_points, dst_points, method=0, ransac_reproj_threshold=3.0):
    """(H, mask); method 8 draws 2000 seeded samples of four, keeps the largest consensus and refits."""
    a, b = (np.asarray(p, float).reshape(-1, 2) for p in (src_points, dst_points))
    if len(a) < 4 or len(a) != len(b):
        raise ValueError("four pairs of points at least")
    if method != 8:
        return homography(a, b), np.ones(len(a), np.uint8)
    best, g = np.zeros(len(a), bool), _congruential(42)
    for _ in range(2000):
        pick: list[int] = []
        while len(pick) < 4:
            i = (next(g) >> 16) % len(a)
            if i not in pick:
                pick.append(i)
        try:
            h = homography(a[pick], b[pick])
        except np.linalg.LinAlgError:
            continue
        near = np.nan_to_num(np.hypot(*(project(h, a) - b).T), nan=np.inf) < ransac_reproj_threshold
        if near.sum() > best.sum():
            best = near
            if best.all():
                break
    return homography(a[best], b[best]) if best.sum() >= 4 else homography(a, b), best.astype(np.uint8)
