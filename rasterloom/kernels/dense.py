"""Dense image kernels on stacks of equal-shaped images.

A kernel sees images as (n, height, width, channels) and works on all n at once; called with one (height, width) or
(height, width, channels) array it adds and removes the missing axes. Results clamp to 0..255 where an 8-bit image
comes out; most truncate, a few round half away from zero, as each docstring says.
"""

from __future__ import annotations

from functools import wraps

import numpy as np


def stacked(f):
    """Lets a stack kernel take and return single images."""

    @wraps(f)
    def call(image, *args, **kw):
        a = np.asarray(image)
        if a.ndim not in (2, 3, 4):
            raise ValueError("an image has 2 or 3 axes")
        out = f(a[None, :, :, None] if a.ndim == 2 else a[None] if a.ndim == 3 else a, *args, **kw)

        def strip(x):
            if not isinstance(x, np.ndarray) or a.ndim == 4:
                return x
            x = x[0]
            return x[..., 0] if a.ndim == 2 and x.ndim == 3 and x.shape[-1] == 1 else x

        return tuple(map(strip, out)) if isinstance(out, tuple) else strip(out)

    call.stack = f
    return call


def trunc8(x):
    return np.clip(x, 0, 255).astype(np.uint8)


def half_away(x):
    return np.copysign(np.floor(np.abs(x) + 0.5), x)


def round8(x):
    return np.clip(half_away(x), 0, 255).astype(np.uint8)


BORDER = {"BORDER_REFLECT": "reflect", "BORDER_REPLICATE": "replicate", "BORDER_WRAP": "wrap", "BORDER_CONSTANT": "constant"}


def border_index(i: np.ndarray, n: int, mode: str) -> np.ndarray:
    """Indices inside 0..n-1 for any integers; -1 where the constant applies. Unknown modes mirror without the edge."""
    mode = BORDER.get(mode, mode)
    if mode == "replicate":
        return np.clip(i, 0, n - 1)
    if mode == "wrap":
        return i % n
    if mode == "constant":
        return np.where((i < 0) | (i >= n), -1, i)
    lo, hi = (-i - 1, 2 * n - i - 1) if mode == "reflect" else (-i, 2 * n - i - 2)
    return np.where(i < 0, np.minimum(lo, n - 1), np.where(i >= n, np.maximum(hi, 0), i))


def padded(a: np.ndarray, up: int, down: int, left: int, right: int, mode: str, value: float = 0) -> np.ndarray:
    """A stack grown by border pixels."""
    y, x = (border_index(np.arange(-p, n + q), n, mode) for p, q, n in ((up, down, a.shape[1]), (left, right, a.shape[2])))
    out = a[:, np.maximum(y, 0)][:, :, np.maximum(x, 0)]
    if (y < 0).any() or (x < 0).any():
        out = np.where(((y < 0)[:, None] | (x < 0))[None, :, :, None], np.asarray(value, a.dtype), out)
    return out


def correlate(a: np.ndarray, kernel: np.ndarray, mode: str = "replicate", value: float = 0) -> np.ndarray:
    """Correlation in double precision, tap by tap in raster order; an even kernel's anchor is at half its size."""
    kh, kw = kernel.shape
    p = padded(a, kh // 2, kh - 1 - kh // 2, kw // 2, kw - 1 - kw // 2, mode, value).astype(np.float64)
    out = np.zeros(a.shape)
    for dy in range(kh):
        for dx in range(kw):
            if kernel[dy, dx] != 0:
                out += p[:, dy : dy + a.shape[1], dx : dx + a.shape[2]] * kernel[dy, dx]
    return out


# point transforms and thresholds


@stacked
def apply_negative(a):
    return (255 - a).astype(np.uint8)


@stacked
def apply_log(a):
    return trunc8(255.0 / np.log(256.0) * np.log(1.0 + a))


@stacked
def apply_gamma(a, gamma):
    return trunc8((a / 255.0) ** gamma * 255.0)


@stacked
def rgb_to_gray(a):
    f = a.astype(np.float32)
    return trunc8(f[..., :1] * np.float32(0.299) + f[..., 1:2] * np.float32(0.587) + f[..., 2:3] * np.float32(0.114))


@stacked
def apply_threshold(a, threshold_value):
    return np.where(a > threshold_value, 255, 0).astype(np.uint8)


@stacked
def apply_threshold_binary_inv(a, threshold_value):
    return np.where(a > threshold_value, 0, 255).astype(np.uint8)


@stacked
def apply_threshold_trunc(a, threshold_value):
    return np.minimum(a, threshold_value).astype(np.uint8)


@stacked
def apply_threshold_tozero(a, threshold_value):
    return np.where(a > threshold_value, a, 0).astype(np.uint8)


@stacked
def apply_threshold_tozero_inv(a, threshold_value):
    return np.where(a > threshold_value, 0, a).astype(np.uint8)


MODES = {"binary": apply_threshold, "binary_inv": apply_threshold_binary_inv, "trunc": apply_threshold_trunc, "tozero": apply_threshold_tozero, "tozero_inv": apply_threshold_tozero_inv}


def histogram256(a: np.ndarray) -> np.ndarray:
    """(n, 256) counts over each image's values."""
    n = len(a)
    return np.bincount((np.arange(n)[:, None] * 256 + a.reshape(n, -1)).ravel(), minlength=n * 256).reshape(n, 256)


def otsu(hist: np.ndarray) -> np.ndarray:
    """The first value of largest between-class variance; 0 for a constant image."""
    t = np.arange(256.0)
    w = hist.cumsum(1).astype(float)
    s, total, all_ = (hist * t).cumsum(1), hist.sum(1, keepdims=True).astype(float), (hist * t).sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        v = w * (total - w) * (s / w - (all_ - s) / (total - w)) ** 2
    v = np.where((w > 0) & (w < total), v, 0)
    return np.where(v.max(1) > 0, v.argmax(1), 0)


def triangle(hist: np.ndarray) -> int:
    """The bin farthest from the chord between the peak and the longer tail, plus one if that tail is the left one."""
    peak, some = int(hist.argmax()), np.flatnonzero(hist)
    if not len(some):
        return 0
    a, b, left = (peak, int(some[-1]), False) if peak - some[0] < some[-1] - peak else (int(some[0]), peak, True)
    if a == b:
        return peak
    dx, dy = float(b - a), float(hist[b]) - float(hist[a])
    i = np.arange(a, b + 1, dtype=float)
    far = np.abs((dy * i - dx * hist[a : b + 1] + float(b) * hist[a] - float(hist[b]) * a) / np.hypot(dx, dy))
    return (a + int(far.argmax()) if far.max() > 0 else a) + left


@stacked
def apply_threshold_triangle(a):
    t = np.array([triangle(h) for h in histogram256(a)]) & 255
    return t, np.where(a > t[:, None, None, None], 255, 0).astype(np.uint8)


@stacked
def apply_otsu_threshold(a):
    t = otsu(histogram256(a))
    return t, np.where(a > t[:, None, None, None], 255, 0).astype(np.uint8)


@stacked
def apply_otsu_with_mode(a, mode="binary"):
    if mode not in MODES:
        raise ValueError(f"unknown threshold mode {mode}")
    t = otsu(histogram256(a))
    return t, MODES[mode].stack(a, t[:, None, None, None])


@stacked
def rgb_to_cmy(a):
    return (1 - a.astype(np.float32) / np.float32(255)).astype(np.float32)


def apply_frequency_filter(f_shifted, d0, filter_type):
    """Mask of a centred spectrum: ILPF, IHPF, GLPF or GHPF; any other name passes all."""
    f = np.asarray(f_shifted)
    y, x = np.ogrid[: f.shape[0], : f.shape[1]]
    d = np.sqrt((y - f.shape[0] // 2) ** 2.0 + (x - f.shape[1] // 2) ** 2.0)
    low = np.exp(-(d**2) / (2 * d0 * d0))
    mask = {"ILPF": d <= d0, "IHPF": d > d0, "GLPF": low, "GHPF": 1 - low}.get(filter_type, np.ones_like(d))
    return f * mask.reshape(mask.shape + (1,) * (f.ndim - 2))


@stacked
def adaptive_threshold(a, max_value, adaptive_method, threshold_type, block_size, c):
    if block_size < 3 or block_size % 2 == 0:
        raise ValueError("block_size is odd and at least 3")
    if adaptive_method == 0:
        local = correlate(a, np.ones((block_size, block_size))) / (block_size * block_size)
    else:
        local = correlate(a, gaussian_kernel(block_size, 0.3 * (block_size / 2 - 1) + 0.8))
    high = int(round8(np.float64(max_value)))
    over = a > local - c
    return np.where(over == (threshold_type == 0), high, 0).astype(np.uint8)


# colour spaces


def _rgb(a):
    if a.shape[-1] != 3:
        raise ValueError("a colour image has 3 channels")
    return (a[..., i].astype(np.float64) for i in range(3))


@stacked
def rgb_to_hsv(a):
    """Rounded: hue halved to 0..180."""
    r, g, b = (x / 255 for x in _rgb(a))
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    h, d = _hue(r, g, b, top, low)
    s = np.where(top < 1e-10, 0, d / np.where(top < 1e-10, 1, top))
    return np.stack([round8(h / 2), round8(s * 255), round8(top * 255)], -1)


def _hue(r, g, b, top, low):
    d = top - low
    flat = d < 1e-10
    e = np.where(flat, 1, d)
    h = np.where(top == r, 60 * np.mod((g - b) / e, 6), np.where(top == g, 60 * ((b - r) / e + 2), 60 * ((r - g) / e + 4)))
    h = np.where(h < 0, h + 360, h)
    return np.where(flat, 0, h), np.where(flat, 0, d)


@stacked
def rgb_to_hls(a):
    r, g, b = (x / 255 for x in _rgb(a))
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    h, d = _hue(r, g, b, top, low)
    light = (top + low) / 2
    room = 1 - np.abs(2 * light - 1)
    s = np.where(d > 0, np.minimum(d / np.where(room < 1e-10, 1, room), 1), 0)
    return np.stack([round8(h / 2), round8(light * 255), round8(s * 255)], -1)


def _linear(a, rows):
    r, g, b = _rgb(a)
    return np.stack([round8(r * w[0] + g * w[1] + b * w[2] + w[3]) for w in rows], -1)


@stacked
def rgb_to_ycrcb(a):
    return _linear(a, ((0.299, 0.587, 0.114, 0), (0.5, -0.419, -0.081, 128), (-0.169, -0.331, 0.5, 128)))


@stacked
def rgb_to_yuv(a):
    return _linear(a, ((0.299, 0.587, 0.114, 0), (-0.14713, -0.28886, 0.436, 128), (0.615, -0.51499, -0.10001, 128)))


XYZ = np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]])
WHITE = np.array([0.95047, 1.0, 1.08883])


def _xyz(a):
    c = np.stack(list(_rgb(a)), -1) / 255
    c = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    return c @ XYZ.T


@stacked
def rgb_to_xyz(a):
    return _xyz(a).astype(np.float32)


@stacked
def rgb_to_lab(a):
    f = _xyz(a) / WHITE
    f = np.where(f > 0.008856, np.cbrt(f), 7.787037 * f + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1).astype(np.float32)


@stacked
def rgb_to_luv(a):
    t = _xyz(a)
    light = np.where(t[..., 1] > 0.008856, 116 * np.cbrt(t[..., 1]) - 16, 903.3 * t[..., 1])
    part = lambda v: v[..., 0] + 15 * v[..., 1] + 3 * v[..., 2]
    d, dn = part(t), part(WHITE)
    ok = d >= 1e-10
    u, v = (np.where(ok, k * t[..., i] / np.where(ok, d, 1), 0) for k, i in ((4, 0), (9, 1)))
    return np.stack([light, 13 * light * (u - 4 * WHITE[0] / dn), 13 * light * (v - 9 * WHITE[1] / dn)], -1).astype(np.float32)


@stacked
def bgr_to_rgb(a):
    return a[..., ::-1].copy() if a.shape[-1] == 3 else a.copy()


@stacked
def gray_to_rgb(a):
    return np.repeat(a[..., :1], 3, -1)


#: OpenCV's codes: (swap red and blue first, conversion)
CODES = {4: (True, None), 6: (True, rgb_to_gray), 7: (False, rgb_to_gray), 8: (False, gray_to_rgb), 32: (True, rgb_to_xyz), 33: (False, rgb_to_xyz), 36: (True, rgb_to_ycrcb), 37: (False, rgb_to_ycrcb), 40: (True, rgb_to_hsv), 41: (False, rgb_to_hsv), 44: (True, rgb_to_lab), 45: (False, rgb_to_lab), 50: (True, rgb_to_luv), 51: (False, rgb_to_luv), 52: (True, rgb_to_hls), 53: (False, rgb_to_hls), 82: (True, rgb_to_yuv), 83: (False, rgb_to_yuv), 128: (False, rgb_to_cmy)}


@stacked
def cvtColor(a, code):
    if code not in CODES:
        raise ValueError(f"unsupported colour code {code}")
    swap, f = CODES[code]
    a = a[..., ::-1] if swap else a
    return f.stack(a) if f else a.copy()


# arithmetic


def _pair(a, b):
    a, b = np.asarray(a), np.asarray(b)
    if a.shape != b.shape:
        raise ValueError("images have one shape")
    return a, b


def add_images(img1, img2):
    a, b = _pair(img1, img2)
    return np.minimum(a.astype(int) + b, 255).astype(np.uint8)


def sub_images(img1, img2):
    a, b = _pair(img1, img2)
    return np.maximum(a.astype(int) - b, 0).astype(np.uint8)


def add_weighted(img1, alpha, img2, beta, gamma):
    a, b = _pair(img1, img2)
    return trunc8(a * float(alpha) + b * float(beta) + gamma)


def bitwise_and(img1, img2):
    return np.bitwise_and(*_pair(img1, img2))


def bitwise_or(img1, img2):
    return np.bitwise_or(*_pair(img1, img2))


def bitwise_xor(img1, img2):
    return np.bitwise_xor(*_pair(img1, img2))


def bitwise_not(img):
    return (255 - np.asarray(img)).astype(np.uint8)


def _doubles(a, b):
    return _pair(np.asarray(a, float), np.asarray(b, float))


def apply_multiply(src1, src2, scale=1.0):
    a, b = _doubles(src1, src2)
    return a * b * scale


def apply_divide(src1, src2, scale=1.0):
    a, b = _doubles(src1, src2)
    small = np.abs(b) < 1e-9
    return np.where(small, 0, a / np.where(small, 1, b) * scale)


def absdiff(src1, src2):
    a, b = _pair(src1, src2)
    return np.abs(a.astype(int) - b).astype(np.uint8)


def apply_min(src1, src2):
    return np.fmin(*_doubles(src1, src2))


def apply_max(src1, src2):
    return np.fmax(*_doubles(src1, src2))


def _quiet(f):
    def call(src, *args):
        with np.errstate(all="ignore"):
            return f(np.asarray(src, float), *args)

    return call


apply_pow = _quiet(np.power)
apply_sqrt = _quiet(np.sqrt)
apply_exp = _quiet(np.exp)
apply_log_op = _quiet(np.log)


def apply_normalize(src, alpha=0.0, beta=255.0, norm_type=32):
    """32: to the range of alpha and beta; 4: to L2 norm alpha; any other: to L1 norm alpha."""
    a = np.asarray(src, float)
    if norm_type == 32:
        lo, hi, low, high = a.min(), a.max(), min(alpha, beta), max(alpha, beta)
        return np.full_like(a, low) if hi - lo < 1e-12 else (a - lo) / (hi - lo) * (high - low) + low
    norm = np.sqrt((a * a).sum()) if norm_type == 4 else np.abs(a).sum()
    return a / norm * alpha if norm > 0 else np.zeros_like(a)


def convert_scale_abs(src, alpha=1.0, beta=0.0):
    return round8(np.abs(np.asarray(src, float) * alpha + beta))


def in_range(src, lowerb, upperb):
    a = np.asarray(src).astype(float)
    a = a[..., None] if a.ndim == 2 else a
    k = a.shape[-1] if np.ndim(src) == 3 else 1
    return np.where(((a >= np.array(lowerb[:k])) & (a <= np.array(upperb[:k]))).all(-1), 255, 0).astype(np.uint8)


def apply_lut(src, lut):
    lut = np.asarray(lut, np.uint8)
    if lut.ndim != 1 or len(lut) < 256:
        raise ValueError("a table has one axis and 256 entries")
    return lut[np.asarray(src)]


def split_channels(image):
    a = np.asarray(image)
    return [a.copy()] if a.ndim == 2 else [a[..., i].copy() for i in range(a.shape[-1])]


def merge_channels(channels):
    if not channels or any(np.shape(c) != np.shape(channels[0]) for c in channels):
        raise ValueError("channels have one shape")
    return np.stack(channels, -1).astype(np.uint8)


def mix_channels(src, dst, from_to):
    """Planes of src to planes of dst by (from, to) pairs; dst gives shapes alone, other planes become 0."""
    planes = [p for s in src for p in split_channels(s)]
    out = [np.zeros_like(np.asarray(d)) for d in dst]
    views = [o if o.ndim == 2 else o[..., i] for o in out for i in range(1 if o.ndim == 2 else o.shape[-1])]
    for a, b in zip(from_to[::2], from_to[1::2], strict=True):
        views[b][...] = planes[a]
    return out


def count_non_zero(src):
    return int((np.asarray(src) != 0).sum())


def mean_std_dev(src):
    a = np.asarray(src, float)
    a = a.reshape(-1, 1 if a.ndim == 2 else a.shape[-1])
    mean = a.mean(0)
    return mean.tolist(), np.sqrt(np.maximum((a * a).mean(0) - mean**2, 0)).tolist()


def min_max_loc(src):
    a = np.asarray(src)
    if a.ndim != 2:
        raise ValueError("a grey image is asked for")
    (ly, lx), (hy, hx) = (np.unravel_index(i, a.shape) for i in (a.argmin(), a.argmax()))
    return float(a.min()), float(a.max()), (int(lx), int(ly)), (int(hx), int(hy))


def calculate_phase(x, y, angle_in_degrees=False):
    x, y = _doubles(x, y)
    t = np.arctan2(y, x)
    t = np.where(t < 0, t + 2 * np.pi, t)
    return np.degrees(t) if angle_in_degrees else t


def calculate_magnitude(x, y):
    x, y = _doubles(x, y)
    return np.sqrt(x * x + y * y)


def cart_to_polar(x, y, angle_in_degrees=False):
    return calculate_magnitude(x, y), calculate_phase(x, y, angle_in_degrees)


def polar_to_cart(magnitude, angle, angle_in_degrees=False):
    m, t = _doubles(magnitude, angle)
    t = np.radians(t) if angle_in_degrees else t
    return m * np.cos(t), m * np.sin(t)


# histograms


def _equalise_table(hist):
    """Rounded CDF table in single precision; a constant channel stays as it is."""
    cum = hist.cumsum(-1)
    least = np.take_along_axis(cum, (hist > 0).argmax(-1)[..., None], -1)
    n = cum[..., -1:]
    f = np.float32
    table = round8((cum - least).astype(f) / np.maximum(n - least, 1).astype(f) * f(255))
    return np.where(n == least, np.arange(256, dtype=np.uint8), table)


@stacked
def hist_equalize_rgb(a):
    planes = [a[..., i : i + 1] for i in range(a.shape[-1])]
    return np.concatenate([np.take_along_axis(_equalise_table(histogram256(p)), p.reshape(len(p), -1).astype(int), 1).reshape(p.shape) for p in planes], -1)


@stacked
def hist_equalize_gray(a):
    g = (a.astype(int).sum(-1, keepdims=True) // 3).astype(np.uint8)
    return hist_equalize_rgb.stack(g)


def _match_table(hist, target):
    t = np.asarray(target, np.float64).ravel()
    t = np.where(np.isfinite(t) & (t > 0), t, 0)
    goal = (t / t.sum() if t.sum() > 0 else t).cumsum().astype(np.float32)
    goal[-1] = 1
    source = (hist.cumsum(-1) / np.maximum(hist.sum(-1, keepdims=True), 1)).astype(np.float32)
    return np.minimum(np.searchsorted(np.maximum.accumulate(goal), source, "left"), 255).astype(np.uint8)


@stacked
def hist_spec_rgb(a, target_hist):
    planes = [a[..., i : i + 1] for i in range(a.shape[-1])]
    return np.concatenate([np.take_along_axis(_match_table(histogram256(p), target_hist), p.reshape(len(p), -1).astype(int), 1).reshape(p.shape) for p in planes], -1)


@stacked
def hist_spec_gray(a, target_hist):
    g = a.astype(int)
    g = ((77 * g[..., :1] + 150 * g[..., 1:2] + 29 * g[..., 2:3]) // 256).astype(np.uint8)
    return hist_spec_rgb.stack(g, target_hist)


def calc_hist(image, channel_idx, hist_size, ranges):
    a = np.asarray(image)
    v = (a if a.ndim == 2 else a[..., channel_idx]).ravel().astype(np.float32)
    low, high = map(np.float32, ranges)
    v = v[(v >= low) & (v < high)]
    b = np.minimum(((v - low) / (high - low) * np.float32(hist_size)).astype(int), hist_size - 1)
    return np.bincount(b, minlength=hist_size).astype(np.float32)[:, None]


def compare_hist(h1, h2, method):
    """0 correlation, 1 chi-square, 2 intersection, 3 Bhattacharyya distance."""
    a, b = (np.asarray(h, np.float64).ravel() for h in (h1, h2))
    if method == 0:
        x, y = a - a.mean(), b - b.mean()
        d = np.sqrt((x * x).sum() * (y * y).sum())
        return float((x * y).sum() / d) if d > 1e-9 else 0.0
    if method == 1:
        ok = a > 1e-9
        return float(((a - b)[ok] ** 2 / a[ok]).sum())
    if method == 2:
        return float(np.minimum(a, b).sum())
    if method == 3:
        d = np.sqrt(a.sum() * b.sum())
        return float(np.sqrt(max(0.0, 1 - np.sqrt(a * b).sum() / d))) if d > 1e-9 else 1.0
    raise ValueError(f"unknown method {method}")


def match_template(image, templ, method=0):
    """0 squared difference, 2 correlation, 4 correlation of deviations; odd methods are normalised."""
    a, t = np.asarray(image, np.float64), np.asarray(templ, np.float64)
    if method not in range(6) or t.shape[0] > a.shape[0] or t.shape[1] > a.shape[1]:
        raise ValueError("method 0 to 5, and a template no larger than the image")
    w = np.lib.stride_tricks.sliding_window_view(a, t.shape)
    if method > 3:
        w, t = w - w.mean((-1, -2), keepdims=True), t - t.mean()
    cross, energy, own = (w * t).sum((-1, -2)), (w * w).sum((-1, -2)), (t * t).sum()
    out = energy - 2 * cross + own if method < 2 else cross
    if method % 2:
        d = np.sqrt(energy * own)
        out = np.where(d > 0, out / np.where(d > 0, d, 1), 1.0 if method == 1 else 0.0)
    return out.astype(np.float32)


def calc_back_project(image, channel_idx, hist, ranges, scale=1.0):
    a, h = np.asarray(image), np.asarray(hist, np.float32).ravel()
    v = (a if a.ndim == 2 else a[..., channel_idx]).astype(np.float32)
    low, high = map(np.float32, ranges)
    b = np.clip(((v - low) / (high - low) * np.float32(len(h))).astype(int), 0, len(h) - 1)
    return np.where((v >= low) & (v < high), round8(h[b] * np.float32(scale)), 0).astype(np.uint8)


def emd_1d(h1, h2):
    a, b = (np.asarray(h, np.float64).ravel() for h in (h1, h2))
    if a.sum() <= 0 or b.sum() <= 0 or len(a) != len(b):
        raise ValueError("histograms of one length and positive sum")
    return float(np.abs((a / a.sum()).cumsum() - (b / b.sum()).cumsum()).sum())


# filters


def _taps(a, k, mode, value):
    p = padded(a, k // 2, k - 1 - k // 2, k // 2, k - 1 - k // 2, mode, value)
    return np.stack([p[:, dy : dy + a.shape[1], dx : dx + a.shape[2]] for dy in range(k) for dx in range(k)])


@stacked
def apply_median_blur(a, ksize, border_type="reflect", border_value=0):
    """The upper median."""
    return np.sort(_taps(a, ksize, border_type, border_value), 0)[ksize * ksize // 2]


@stacked
def median_filter(a, border_type="reflect", border_value=0):
    return apply_median_blur.stack(a, 3, border_type, border_value)


@stacked
def laplacian_filter(a, border_type="reflect", border_value=0):
    k = -np.ones((3, 3))
    k[1, 1] = 8
    return trunc8(correlate(a, k, border_type, border_value))


BINOMIAL = np.outer([1.0, 4, 6, 4, 1], [1.0, 4, 6, 4, 1])


@stacked
def pyr_down(a):
    return trunc8(correlate(a, BINOMIAL / 256)[:, ::2, ::2])


@stacked
def pyr_up(a):
    """Zeros between the pixels, then the binomial; source coordinates clamp to the edge."""
    n, h, w, c = a.shape
    src = lambda size: np.clip(np.arange(-2, 2 * size + 2) // 2, 0, size - 1)
    p = a[:, src(h)][:, :, src(w)].astype(float)
    even = lambda size: np.arange(-2, 2 * size + 2) % 2 == 0
    p *= (even(h)[:, None] & even(w))[None, :, :, None]
    return trunc8(sum(p[:, y : y + 2 * h, x : x + 2 * w] * BINOMIAL[y, x] / 64 for y in range(5) for x in range(5)))


@stacked
def apply_filter2d(a, kernel, border_type="reflect", border_value=0):
    return trunc8(correlate(a, np.asarray(kernel, float), border_type, border_value))


@stacked
def apply_blur(a, ksize_w, ksize_h, border_type="reflect", border_value=0):
    return apply_filter2d.stack(a, np.full((ksize_h, ksize_w), 1 / (ksize_w * ksize_h)), border_type, border_value)


def gaussian_kernel(ksize, sigma):
    d = np.arange(ksize) - float(ksize // 2)
    k = np.exp(-(d[:, None] ** 2 + d**2) / (2 * sigma * sigma))
    return k / k.sum()


@stacked
def apply_gaussian_blur(a, ksize, sigma, border_type="reflect", border_value=0):
    return apply_filter2d.stack(a, gaussian_kernel(ksize, sigma), border_type, border_value)


@stacked
def gaussian_blur_border(a, ksize, sigma, border_type=0, border_value=0):
    """Rounded; numeric borders 0 reflect101, 1 reflect, 2 replicate, 3 wrap, 4 constant."""
    mode = {0: "reflect_101", 1: "reflect", 3: "wrap", 4: "constant"}.get(border_type, "replicate")
    return round8(correlate(a, gaussian_kernel(ksize, sigma), mode, border_value))


@stacked
def apply_bilateral_filter(a, diameter, sigma_color, sigma_space, border_type="reflect", border_value=0):
    t = _taps(a, diameter, border_type, border_value).astype(float)
    d = np.arange(diameter) - diameter // 2
    space = np.exp(-(d[:, None] ** 2 + d**2) / (2 * sigma_space**2)).ravel()
    w = space[:, None, None, None, None] * np.exp(-((t - a) ** 2) / (2 * sigma_color**2))
    return round8((w * t).sum(0) / w.sum(0))


SMOOTH = {1: [1], 3: [1, 2, 1], 5: [1, 4, 6, 4, 1], 7: [1, 6, 15, 20, 15, 6, 1]}
FIRST = {3: [-1, 0, 1], 5: [-1, -2, 0, 2, 1], 7: [-1, -4, -5, 0, 5, 4, 1]}
SECOND = {3: [1, -2, 1], 5: [1, 0, -2, 0, 1], 7: [1, 2, -1, -4, -1, 2, 1]}


def sobel_kernel(dx, dy, ksize):
    if ksize == 1:
        if (dx, dy) == (1, 0):
            return np.array([[-1.0, 0, 1]])
        if (dx, dy) == (0, 1):
            return np.array([[-1.0], [0], [1]])
        # Larger derivatives of size 1 keep the first entry of the size-3 rows alone.
        s, f, g = 1.0, -1.0, 1.0
        return np.array([[{(1, 1): f * f, (2, 0): s * g, (0, 2): g * s}.get((dx, dy), 0.0)]])
    s, f, g = (np.array(t[ksize], float) for t in (SMOOTH, FIRST, SECOND))
    return {(1, 0): np.outer(s, f), (0, 1): np.outer(f, s), (1, 1): np.outer(f, f), (2, 0): np.outer(s, g), (0, 2): np.outer(g, s)}.get((dx, dy), np.zeros((ksize, ksize)))


@stacked
def apply_sobel(a, dx, dy, ksize):
    if ksize not in SMOOTH or (dx, dy) == (0, 0):
        raise ValueError("ksize 1, 3, 5 or 7, and a derivative")
    return correlate(a, sobel_kernel(dx, dy, ksize)).astype(np.float32)


@stacked
def apply_scharr(a, dx, dy):
    if (dx, dy) not in ((1, 0), (0, 1)):
        raise ValueError("exactly one derivative")
    k = np.outer([3.0, 10, 3], [-1.0, 0, 1])
    return correlate(a, k if dx else k.T).astype(np.float32)


def laplacian_kernel(ksize):
    if ksize == 1:
        return np.array([[0.0, 1, 0], [1, -4, 1], [0, 1, 0]])
    if ksize == 5:
        edge, mid = [-1.0, -3, -4, -3, -1], [-3.0, 0, 6, 0, -3]
        return np.array([edge, mid, [-4.0, 6, 20, 6, -4], mid, edge])
    k = -np.ones((ksize, ksize))
    k[ksize // 2, ksize // 2] = ksize * ksize - 1
    return k


@stacked
def apply_laplacian(a, ksize):
    if ksize not in SMOOTH:
        raise ValueError("ksize 1, 3, 5 or 7")
    return correlate(a, laplacian_kernel(ksize)).astype(np.float32)


# morphology: taps outside the image don't count


def _morph(a, kernel, least):
    k = np.asarray(kernel) > 0
    kh, kw = k.shape
    fill = 255 if least else 0
    p = padded(a, kh // 2, kh - 1 - kh // 2, kw // 2, kw - 1 - kw // 2, "constant", fill)
    out = np.full(a.shape, fill, np.uint8)
    for dy, dx in zip(*np.nonzero(k), strict=True):
        (np.minimum if least else np.maximum)(out, p[:, dy : dy + a.shape[1], dx : dx + a.shape[2]], out=out)
    return out


@stacked
def apply_erosion(a, kernel):
    return _morph(a, kernel, True)


@stacked
def apply_dilation(a, kernel):
    return _morph(a, kernel, False)


@stacked
def opening(a, kernel):
    return _morph(_morph(a, kernel, True), kernel, False)


@stacked
def apply_closing(a, kernel):
    return _morph(_morph(a, kernel, False), kernel, True)


def _less(a, b):
    return np.maximum(a.astype(int) - b, 0).astype(np.uint8)


@stacked
def morphological_gradient(a, kernel):
    return _less(_morph(a, kernel, False), _morph(a, kernel, True))


@stacked
def top_hat(a, kernel):
    return _less(a, opening.stack(a, kernel))


@stacked
def black_hat(a, kernel):
    return _less(apply_closing.stack(a, kernel), a)


@stacked
def morphology_ex(a, op, kernel, iterations=1):
    """0 erode, 1 dilate, 2 open, 3 close, 4 gradient, 5 top hat, 6 black hat; open and close repeat the pair."""
    steps = {0: apply_erosion, 1: apply_dilation, 2: opening, 3: apply_closing, 5: opening, 6: apply_closing}
    if op == 4:
        return morphological_gradient.stack(a, kernel)
    if op not in steps:
        raise ValueError("op 0 to 6")
    out = a
    for _ in range(iterations):
        out = steps[op].stack(out, kernel)
    return _less(a, out) if op == 5 else _less(out, a) if op == 6 else out.copy()


def get_structuring_element(shape, ksize_w, ksize_h, anchor_x=-1, anchor_y=-1):
    out = np.zeros((ksize_h, ksize_w), np.uint8)
    if shape == 0:
        out[:] = 1
    elif shape == 1:
        out[anchor_y if anchor_y >= 0 else ksize_h // 2] = 1
        out[:, anchor_x if anchor_x >= 0 else ksize_w // 2] = 1
    elif shape == 2:
        cy, cx = (ksize_h - 1) / 2, (ksize_w - 1) / 2
        y, x = np.ogrid[:ksize_h, :ksize_w]
        out[((x - cx) / max(cx, 0.5)) ** 2 + ((y - cy) / max(cy, 0.5)) ** 2 <= 1] = 1
    else:
        raise ValueError("shape 0, 1 or 2")
    return out


# geometry


@stacked
def apply_flip(a, flip_code):
    return (a[:, ::-1] if flip_code == 0 else a[:, :, ::-1] if flip_code > 0 else a[:, ::-1, ::-1]).copy()


@stacked
def apply_transpose(a):
    return a.transpose(0, 2, 1, 3).copy()


def nearest(a, sx, sy):
    """Pixels at rounded coordinates (out_h, out_w); 0 outside."""
    x, y = half_away(sx), half_away(sy)
    ok = np.isfinite(x) & np.isfinite(y) & (x >= 0) & (x < a.shape[2]) & (y >= 0) & (y < a.shape[1])
    out = a[:, np.where(ok, y, 0).astype(int), np.where(ok, x, 0).astype(int)]
    return np.where(ok[None, ..., None], out, 0).astype(a.dtype)


def _grid(h, w):
    y, x = np.mgrid[:h, :w]
    return x.astype(float), y.astype(float)


@stacked
def apply_translate(a, tx, ty):
    x, y = _grid(*a.shape[1:3])
    return nearest(a, x - tx, y - ty)


@stacked
def apply_rotate(a, angle, center=None, compat=True):
    """Radians about the centre (half the size). compat: the second row keeps the reference's sign, a reflection."""
    x, y = _grid(*a.shape[1:3])
    cx, cy = center if center is not None else (a.shape[2] // 2, a.shape[1] // 2)
    dx, dy, s, c = x - cx, y - cy, np.sin(angle), np.cos(angle)
    return nearest(a, dx * c + dy * s + cx, (dx * s - dy * c if compat else dy * c - dx * s) + cy)


@stacked
def apply_warp(a, inv_matrix, out_w, out_h):
    m = np.asarray(inv_matrix, float)
    x, y = _grid(out_h, out_w)
    d = m[2, 0] * x + m[2, 1] * y + m[2, 2]
    ok = np.abs(d) >= 1e-6
    e = np.where(ok, d, 1)
    sx, sy = ((m[i, 0] * x + m[i, 1] * y + m[i, 2]) / e for i in (0, 1))
    return nearest(a, np.where(ok, sx, -9), np.where(ok, sy, -9))


def invert_affine_transform(M):
    m = np.asarray(M, float)
    if abs(np.linalg.det(m[:, :2])) < 1e-9:
        raise ValueError("the matrix is singular")
    back = np.linalg.inv(m[:, :2])
    return np.column_stack([back, -back @ m[:, 2]])


@stacked
def apply_warp_affine(a, M, out_w, out_h, flags=0):
    m = np.asarray(M, float) if flags & 16 else invert_affine_transform(M)
    x, y = _grid(out_h, out_w)
    return nearest(a, *(r[0] * x + r[1] * y + r[2] for r in m))


def get_rotation_matrix_2d(center, angle, scale):
    c, s = np.cos(np.radians(angle)) * scale, np.sin(np.radians(angle)) * scale
    x, y = center
    return np.array([[c, s, (1 - c) * x - s * y], [-s, c, s * x + (1 - c) * y]])


def get_affine_transform(src, dst):
    a = np.column_stack([np.asarray(src, float), np.ones(3)])
    if abs(np.linalg.det(a)) < 1e-9:
        raise ValueError("the points are collinear")
    return np.linalg.solve(a, np.asarray(dst, float)).T


def get_perspective_transform(src, dst):
    rows, goal = [], []
    for (x, y), (u, v) in zip(np.asarray(src, float), np.asarray(dst, float), strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        goal += [u, v]
    return np.append(np.linalg.solve(np.array(rows), np.array(goal)), 1).reshape(3, 3)


def _cubic(t):
    t, a = np.abs(t), -0.75
    return np.where(t <= 1, (a + 2) * t**3 - (a + 3) * t**2 + 1, np.where(t < 2, a * t**3 - 5 * a * t**2 + 8 * a * t - 4 * a, 0))


def _lanczos(t):
    return np.where(np.abs(t) < 4, np.sinc(t) * np.sinc(t / 4), 0)


def sample(a, sx, sy, interpolation):
    """Values at (out_h, out_w) coordinates, taps clamped to the image: 0 nearest, 1 bilinear, 2 bicubic, 4 Lanczos. Rounded."""
    h, w = a.shape[1:3]
    if interpolation == 0:
        return a[:, np.clip(half_away(sy), 0, h - 1).astype(int), np.clip(half_away(sx), 0, w - 1).astype(int)]
    kinds = {1: (0, 1, lambda t: np.maximum(1 - np.abs(t), 0)), 2: (-1, 2, _cubic), 4: (-3, 4, _lanczos)}
    if interpolation not in kinds:
        raise ValueError("interpolation 0, 1, 2 or 4")
    lo, hi, weight = kinds[interpolation]
    x0, y0 = np.floor(sx), np.floor(sy)
    total, norm = np.zeros((len(a), *sx.shape, a.shape[3])), np.zeros(sx.shape)
    for dy in range(lo, hi + 1):
        wy, y = weight(sy - y0 - dy), np.clip(y0 + dy, 0, h - 1).astype(int)
        for dx in range(lo, hi + 1):
            wt = weight(sx - x0 - dx) * wy
            total += a[:, y, np.clip(x0 + dx, 0, w - 1).astype(int)] * wt[None, ..., None]
            norm += wt
    return round8(total / norm[None, ..., None] if interpolation == 4 else total)


@stacked
def apply_resize(a, new_w, new_h, interpolation=1):
    x, y = _grid(new_h, new_w)
    return sample(a, (x + 0.5) * (a.shape[2] / new_w) - 0.5, (y + 0.5) * (a.shape[1] / new_h) - 0.5, interpolation)


def _inside(a, sx, sy, interpolation):
    ok = (sx >= 0) & (sx < a.shape[2]) & (sy >= 0) & (sy < a.shape[1])
    return np.where(ok[None, ..., None], sample(a, np.where(ok, sx, 0), np.where(ok, sy, 0), interpolation), 0).astype(np.uint8)


@stacked
def apply_remap(a, map1, map2, interpolation=1):
    return _inside(a, np.asarray(map1, float), np.asarray(map2, float), interpolation)


def _polar(a, center, radius, out_w, out_h, interpolation):
    out_w, out_h = out_w or a.shape[2], out_h or a.shape[1]
    x, y = _grid(out_h, out_w)
    t, r = x * (2 * np.pi / out_w), radius(y, out_h)
    return _inside(a, center[0] + r * np.cos(t), center[1] + r * np.sin(t), interpolation)


@stacked
def apply_linear_polar(a, center, max_radius, out_w=None, out_h=None, interpolation=1):
    """Rows are radii, columns angles."""
    return _polar(a, center, lambda y, h: y * max_radius / h, out_w, out_h, interpolation)


@stacked
def apply_log_polar(a, center, scale=1.0, out_w=None, out_h=None, interpolation=1):
    return _polar(a, center, lambda y, h: np.exp(np.minimum(y / scale, 700)), out_w, out_h, interpolation)


# structure tensor, corners, edges, lines


def structure_tensor(a, window):
    """Sums of gradient products over the window, single precision; a frame of half a window stays 0."""
    f = a[..., 0].astype(np.float32)
    gx, gy = np.zeros_like(f), np.zeros_like(f)
    if min(f.shape[1:]) > 2:
        c = lambda dy, dx: f[:, 1 + dy : f.shape[1] - 1 + dy, 1 + dx : f.shape[2] - 1 + dx]
        gx[:, 1:-1, 1:-1] = -c(-1, -1) + c(-1, 1) - 2 * c(0, -1) + 2 * c(0, 1) - c(1, -1) + c(1, 1)
        gy[:, 1:-1, 1:-1] = -c(-1, -1) - 2 * c(-1, 0) - c(-1, 1) + c(1, -1) + 2 * c(1, 0) + c(1, 1)
    pad, out = window // 2, []
    h, w = f.shape[1] - 2 * pad, f.shape[2] - 2 * pad
    for v in (gx * gx, gy * gy, gx * gy):
        s = np.zeros_like(v)
        if h > 0 and w > 0:
            v = np.pad(v, ((0, 0), (0, 1), (0, 1)))
            t = np.zeros((len(v), h, w), np.float32)
            for dy in range(window):
                for dx in range(window):
                    t += v[:, dy : dy + h, dx : dx + w]
            s[:, pad : pad + h, pad : pad + w] = t
        out.append(s)
    return out


@stacked
def harris_corner(a, window_size, k):
    xx, yy, xy = structure_tensor(a, window_size)
    return (xx * yy - xy * xy - np.float32(int(k)) * ((xx + yy) * (xx + yy)))[..., None]


def _eigen(xx, yy, xy):
    t = xx + yy
    gap = np.sqrt(np.maximum(t * t / np.float32(4) - (xx * yy - xy * xy), 0))
    return t / 2 + gap, t / 2 - gap


@stacked
def shi_tomasi_corners(a, window_size):
    return _eigen(*structure_tensor(a, window_size))[1][..., None]


@stacked
def corner_eigen_vals_and_vecs(a, block_size=3, aperture_size=3):
    xx, yy, xy = structure_tensor(a, block_size)
    l1, l2 = _eigen(xx, yy, xy)
    some, out = np.abs(xy) > 1e-10, [l1, l2]
    for i, lam in enumerate((l1, l2)):
        x, n = lam - yy, None
        n = np.maximum(np.sqrt(x * x + xy * xy), 1e-10)
        out += [np.where(some, x / n, np.float32(1 - i)), np.where(some, xy / n, np.float32(i))]
    return np.stack(out, -1).astype(np.float32)


@stacked
def pre_corner_detect(a):
    f = a[..., 0].astype(np.float32)
    out = np.zeros_like(f)
    if min(f.shape[1:]) > 4:
        c = lambda dy, dx: f[:, 2 + dy : f.shape[1] - 2 + dy, 2 + dx : f.shape[2] - 2 + dx]
        dx, dy = (c(0, 1) - c(0, -1)) / 2, (c(1, 0) - c(-1, 0)) / 2
        dxx, dyy = c(0, 1) - 2 * c(0, 0) + c(0, -1), c(1, 0) - 2 * c(0, 0) + c(-1, 0)
        dxy = (c(1, 1) - c(1, -1) - c(-1, 1) + c(-1, -1)) / 4
        out[:, 2:-2, 2:-2] = dx * dx * dyy + dy * dy * dxx - 2 * dx * dy * dxy
    return out[..., None]


@stacked
def integral(a):
    out = np.zeros((len(a), a.shape[1] + 1, a.shape[2] + 1, a.shape[3]))
    out[:, 1:, 1:] = a.astype(float).cumsum(1).cumsum(2)
    return out


@stacked
def sqr_box_filter(a, ksize=3, normalize=True):
    """By an integral image, exact for integers."""
    p = padded(a, ksize // 2, ksize - 1 - ksize // 2, ksize // 2, ksize - 1 - ksize // 2, "replicate").astype(float) ** 2
    s = integral.stack(p)
    out = s[:, ksize:, ksize:] - s[:, :-ksize, ksize:] - s[:, ksize:, :-ksize] + s[:, :-ksize, :-ksize]
    return out / (ksize * ksize) if normalize else out


@stacked
def sep_filter_2d(a, kernel_x, kernel_y):
    kx, ky = (np.asarray(k, float).ravel() for k in (kernel_x, kernel_y))
    return trunc8(correlate(correlate(a, kx[None]), ky[:, None]))


def get_gabor_kernel(ksize, sigma, theta, lambd, gamma, psi=0.0):
    d = np.arange(ksize) - (ksize - 1) / 2
    x = d * np.cos(theta) + d[:, None] * np.sin(theta)
    y = -d * np.sin(theta) + d[:, None] * np.cos(theta)
    return np.exp(-(x * x + gamma * gamma * y * y) / (2 * sigma * sigma)) * np.cos(2 * np.pi * x / lambd + psi)


def _edges(blurred, low, high, l2):
    """Gradient, thinning in four sectors, two thresholds and hysteresis by 8 neighbours; a frame of one pixel stays clear."""
    h, w = blurred.shape[1:]
    inner = np.zeros((h, w), bool)
    inner[1:-1, 1:-1] = True
    gx, gy = (correlate(blurred[..., None], sobel_kernel(i, 1 - i, 3))[..., 0] for i in (1, 0))
    mag = np.where(inner, np.sqrt(gx * gx + gy * gy) if l2 else np.abs(gx) + np.abs(gy), 0)
    t = np.degrees(np.arctan2(gy, gx))
    t = np.where(t < 0, t + 180, t)
    flat, up, tall = (t < 22.5) | (t >= 157.5), (t >= 22.5) & (t < 67.5), (t >= 67.5) & (t < 112.5)
    p = np.pad(mag, ((0, 0), (1, 1), (1, 1)))
    at = lambda dy, dx: p[:, 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    side = lambda s: np.where(flat, at(0, s), np.where(up, at(s, -s), np.where(tall, at(s, 0), at(-s, -s))))
    thin = np.where(inner & (mag >= side(1)) & (mag >= side(-1)), mag, 0)
    strong, weak = inner & (thin >= high), inner & (thin >= low)
    # Hysteresis: the regions of either that have a strong pixel. The clear frames keep images apart.
    from .shapes import label

    either = (strong | weak).reshape(-1, w)
    regions = label(either, 8)
    has = np.zeros(int(regions.max(initial=0)) + 1, bool)
    has[regions[strong.reshape(-1, w)]] = True
    has[0] = False
    return has[regions].reshape(strong.shape)


CANNY = np.array([[2.0, 4, 5, 4, 2], [4, 9, 12, 9, 4], [5, 12, 15, 12, 5], [4, 9, 12, 9, 4], [2, 4, 5, 4, 2]]) / 159


def _blurred(a, kernel):
    out = np.zeros(a.shape)
    if min(a.shape[1:3]) > 4:
        out[:, 2:-2, 2:-2] = correlate(a, kernel)[:, 2:-2, 2:-2]
    return out


def apply_canny(image, low_thresh, high_thresh):
    """On doubles; the result is (height, width, channels) of 1.0 and 0.0, also for a grey image."""
    a = np.asarray(image, float)
    a = a[None, :, :, None] if a.ndim == 2 else a[None] if a.ndim == 3 else a
    b = _blurred(a, CANNY)
    out = np.stack([_edges(b[..., c], low_thresh, high_thresh, True) for c in range(a.shape[3])], -1).astype(float)
    return out if np.ndim(image) == 4 else out[0]


apply_canny.stack = apply_canny


@stacked
def canny_l2(a, low_thresh, high_thresh, aperture_size=3, l2_gradient=False):
    d = np.arange(-2, 3)
    k = np.exp(-(d[:, None] ** 2 + d**2) / (2 * 1.4**2))
    return (_edges(_blurred(a[..., :1], k / k.sum())[..., 0], low_thresh, high_thresh, l2_gradient) * 255).astype(np.uint8)[..., None]


#: Votes that are counted at once.
SOME = 1 << 19


def hough_votes(image, thetas, rho=1.0):
    a = np.asarray(image)
    top = int(np.ceil(np.hypot(*a.shape)))
    ys, xs = np.nonzero(a > 0)
    c, s, n = np.cos(thetas), np.sin(thetas), len(thetas)
    votes = np.zeros((2 * top + 1) * n, int)
    for i in range(0, len(ys), some := max(1, SOME // max(n, 1))):
        y, x = ys[i : i + some, None], xs[i : i + some, None]
        r = half_away((x * c + y * s) / rho).astype(int) + top
        votes += np.bincount((r * n + np.arange(n))[(r >= 0) & (r <= 2 * top)], minlength=len(votes))
    return votes.reshape(-1, n), top


def hough_lines(image, threshold, theta_res):
    thetas = np.radians(np.arange(0, 180, theta_res, dtype=float))
    votes, top = hough_votes(image, thetas)
    return [(float(r - top), float(thetas[t])) for r, t in zip(*np.nonzero(votes >= threshold), strict=True)]


def hough_circles(image, radius, threshold):
    a = np.asarray(image)
    t = np.radians(np.arange(360.0))
    dx, dy = (half_away(radius * f(t)).astype(int) for f in (np.cos, np.sin))
    ys, xs = np.nonzero(a > 0)
    h, w = a.shape
    # Angles that round to one offset vote together.
    (dy, dx), times = np.unique(np.stack([dy, dx]), axis=1, return_counts=True)
    votes = np.zeros(h * w, int)
    for i in range(0, len(ys), some := SOME // 360):
        cy, cx = ys[i : i + some, None] + dy, xs[i : i + some, None] + dx
        ok = (cx >= 0) & (cx < w) & (cy >= 0) & (cy < h)
        votes += np.bincount((cy * w + cx)[ok], np.broadcast_to(times, cy.shape)[ok], h * w).astype(int)
    votes = votes.reshape(h, w)
    return [(int(x), int(y), int(radius)) for y, x in zip(*np.nonzero(votes >= threshold), strict=True)]
