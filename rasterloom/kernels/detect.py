"""Detection kernels: cascades, gradient histograms, QR finder patterns, rectangle grouping, box suppression, blobs, networks."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import numpy as np

from . import dense, shapes
from .dense import half_away


#: Pairs of rectangles that are compared at once.
PAIRS = 1 << 18


def _overlap_groups(rects, eps):
    """Classes of rectangles whose sides differ by less than eps of their mean size, by their least member.

    In order of their tops, a rectangle meets those before its reach ends; pairs are taken in parts, so memory doesn't grow with them.
    """
    r = np.asarray(rects, float).reshape(-1, 4)
    r, which, at = np.unique(r, axis=0, return_index=True, return_inverse=True)  # equal ones are one
    order = np.argsort(r[:, 1], kind="stable")
    s = r[order]
    reach = eps * (s[:, 2] + s[:, 3]) / 2
    end = np.searchsorted(s[:, 1], s[:, 1] + np.maximum(reach, 0) + 1e-6, "right")
    n = len(s)
    comp, lo = np.arange(n), 0
    while lo < n:
        # As many rectangles as have few pairs; one with many alone, in parts of its own.
        size = np.maximum(end[lo:] - np.arange(lo, n) - 1, 0).cumsum()
        hi = lo + max(1, int(np.searchsorted(size, PAIRS, "right")))
        count = np.maximum(end[lo:hi] - np.arange(lo, hi) - 1, 0)
        for part in range(0, int(count.sum()), PAIRS):
            k = np.arange(part, min(part + PAIRS, int(count.sum())))
            i = np.searchsorted(count.cumsum(), k, "right")
            j = k - (count.cumsum() - count)[i] + i + lo + 1
            i = i + lo
            delta = eps * (np.minimum(s[i, 2], s[j, 2]) + np.minimum(s[i, 3], s[j, 3])) / 2
            near = np.abs(s[i, 0] - s[j, 0]) <= delta
            i, j, delta = i[near], j[near], delta[near]
            for v in (s[:, 1], s[:, 0] + s[:, 2], s[:, 1] + s[:, 3]):
                near = np.abs(v[i] - v[j]) <= delta
                i, j, delta = i[near], j[near], delta[near]
            comp = shapes.components(n, comp[i], comp[j])[comp]
        lo = hi
    first = np.full(n, len(at))
    np.minimum.at(first, comp, which[order])
    back = np.empty(n, int)
    back[order] = first[comp]
    return back[at.ravel()]


def groupRectangles(rect_list, group_threshold, eps=0.2):
    """(rectangles, weights): the mean of each class with more members than the threshold."""
    r = np.asarray(rect_list, float).reshape(-1, 4)
    if group_threshold <= 0 or not len(r):
        return r.astype(int), np.ones(len(r), int)
    comp = _overlap_groups(r, eps)
    order, size = np.argsort(comp, kind="stable"), np.unique(comp, return_counts=True)[1]
    end = size.cumsum()
    kept = np.flatnonzero(size > group_threshold)
    return np.array([half_away(r[order[end[c] - size[c] : end[c]]].mean(0)) for c in kept]).reshape(-1, 4).astype(int), size[kept].astype(int)


def NMSBoxes(bboxes, scores, score_threshold, nms_threshold, eta=1.0, top_k=0):
    """Indices kept, best first: each box overlaps those before it by at most the threshold, which eta may lower."""
    b, s = np.asarray(bboxes, float).reshape(-1, 4), np.asarray(scores, float)
    order = np.argsort(-s, kind="stable")
    order = order[s[order] > score_threshold]
    order = order[:top_k] if top_k > 0 else order
    kept: list[int] = []
    limit, area = nms_threshold, b[:, 2] * b[:, 3]
    for i in order:
        k = b[kept]
        w = np.minimum(b[i, 0] + b[i, 2], k[:, 0] + k[:, 2]) - np.maximum(b[i, 0], k[:, 0])
        h = np.minimum(b[i, 1] + b[i, 3], k[:, 1] + k[:, 3]) - np.maximum(b[i, 1], k[:, 1])
        inter = np.maximum(w, 0) * np.maximum(h, 0)
        union = area[i] + area[kept] - inter
        if (np.where(union > 0, inter / np.where(union > 0, union, 1), 0) <= limit).all():
            kept.append(int(i))
            if eta < 1 and limit > 0.5:
                limit *= eta
    return np.array(kept, np.int32)


class HOGDescriptor:
    """Histograms of oriented gradients: cell votes shared between bins, blocks normalised with clipping."""

    def __init__(self, win_size=(64, 128), block_size=(16, 16), block_stride=(8, 8), cell_size=(8, 8), nbins=9, deriv_aperture=1, win_sigma=4.0, histogram_norm_type=0, l2_hys_threshold=0.2, gamma_correction=True, nlevels=64, signed_gradient=False):
        self.win, self.block, self.stride, self.cell, self.bins = win_size, block_size, block_stride, cell_size, nbins
        self.clip, self.gamma, self.signed = l2_hys_threshold, gamma_correction, signed_gradient

    def getDescriptorSize(self):
        per = (self.block[0] // self.cell[0]) * (self.block[1] // self.cell[1]) * self.bins
        return per * ((self.win[0] - self.block[0]) // self.stride[0] + 1) * ((self.win[1] - self.block[1]) // self.stride[1] + 1)

    def compute(self, img, win_stride=None):
        a = np.asarray(img, float)
        a = a[..., None] if a.ndim == 2 else a
        if a.shape[1] < self.win[0] or a.shape[0] < self.win[1]:
            raise ValueError("the image is smaller than the window")
        v = np.sqrt(a) if self.gamma else a
        gx, gy = (dense.correlate(v[None], k)[0] for k in (np.array([[-1.0, 0, 1]]), np.array([[-1.0], [0], [1]])))
        best = np.hypot(gx, gy).argmax(2)[..., None]
        gx, gy = (np.take_along_axis(g, best, 2)[..., 0] for g in (gx, gy))
        span = 360 if self.signed else 180
        t = np.degrees(np.arctan2(gy, gx)) % span / span * self.bins - 0.5
        low, mag = np.floor(t).astype(int), np.hypot(gx, gy)
        share = t - low
        out, step = [], win_stride or self.win
        cw, ch = self.cell
        for top in range(0, a.shape[0] - self.win[1] + 1, step[1]):
            for left in range(0, a.shape[1] - self.win[0] + 1, step[0]):
                for by in range(top, top + self.win[1] - self.block[1] + 1, self.stride[1]):
                    for bx in range(left, left + self.win[0] - self.block[0] + 1, self.stride[0]):
                        h = []
                        for cy in range(by, by + self.block[1], ch):
                            for cx in range(bx, bx + self.block[0], cw):
                                s = (slice(cy, cy + ch), slice(cx, cx + cw))
                                h.append(np.bincount(low[s].ravel() % self.bins, (mag * (1 - share))[s].ravel(), self.bins) + np.bincount((low[s].ravel() + 1) % self.bins, (mag * share)[s].ravel(), self.bins))
                        h = np.concatenate(h)
                        h = np.minimum(h / np.sqrt((h * h).sum() + 1e-6), self.clip)
                        out.append(h / np.sqrt((h * h).sum() + 1e-6))
        return np.concatenate(out).astype(np.float32)


class CascadeClassifier:
    """A cascade of boosted stumps or trees on Haar features of the integral image, from the public XML format."""

    def __init__(self, xml_path=None):
        self.size, self.stages, self.features = (24, 24), [], []
        if xml_path:
            self.load(xml_path)

    def empty(self):
        return not self.stages

    def load(self, xml_path):
        root = ET.parse(xml_path).getroot()
        c = root.find("cascade") if root.find("cascade") is not None else root[0]
        self.size = int(c.findtext("width")), int(c.findtext("height"))
        numbers = lambda e: [float(t) for t in e.split()]
        self.features = [[numbers(r.text) for r in f.find("rects")] for f in c.find("features")]
        self.stages = []
        for s in c.find("stages"):
            weak = [(np.array(numbers(w.findtext("internalNodes"))).reshape(-1, 4), numbers(w.findtext("leafValues"))) for w in s.find("weakClassifiers")]
            self.stages.append((float(s.findtext("stageThreshold")), weak))
        return True

    def _windows(self, a, step):
        """Positions of windows that all stages accept; every window is scored at once."""
        w, h = self.size
        s, q = dense.integral(a), dense.integral(np.zeros_like(a))
        q[1:, 1:] = (a.astype(float) ** 2).cumsum(0).cumsum(1)
        ys, xs = (v.ravel() for v in np.mgrid[0 : a.shape[0] - h + 1 : step, 0 : a.shape[1] - w + 1 : step])
        box = lambda t, x, y, u, v: t[y + v, x + u] - t[y, x + u] - t[y + v, x] + t[y, x]
        area = (w - 2) * (h - 2)
        mean = box(s, xs + 1, ys + 1, w - 2, h - 2)
        norm = np.sqrt(np.maximum(area * box(q, xs + 1, ys + 1, w - 2, h - 2) - mean**2, 1))
        for limit, weak in self.stages:
            total = np.zeros(len(xs))
            for nodes, leaves in weak:
                at, value = np.zeros(len(xs), int), np.full(len(xs), np.nan)
                while np.isnan(value).any():
                    for i in np.unique(at[np.isnan(value)]):
                        left, right, f, t = nodes[i]
                        go = np.isnan(value) & (at == i)
                        v = sum(r[4] * box(s, xs[go] + int(r[0]), ys[go] + int(r[1]), int(r[2]), int(r[3])) for r in self.features[int(f)])
                        nxt = np.where(v < t * norm[go], left, right).astype(int)
                        at[go] = np.maximum(nxt, 0)
                        value[go] = np.where(nxt <= 0, np.array(leaves)[-np.minimum(nxt, 0)], np.nan)
                total += value
            ok = total >= limit
            xs, ys, norm = xs[ok], ys[ok], norm[ok]
            if not len(xs):
                break
        return xs, ys

    def detectMultiScale(self, image, scaleFactor=1.1, minNeighbors=3, minSize=(0, 0), maxSize=None):
        a = np.asarray(image)
        a = dense.rgb_to_gray(a).reshape(a.shape[:2]) if a.ndim == 3 and a.shape[2] == 3 else a.reshape(a.shape[:2])
        found, f = [], 1.0
        while not self.empty():
            w, h = int(half_away(self.size[0] * f)), int(half_away(self.size[1] * f))
            if w > a.shape[1] or h > a.shape[0] or (maxSize and (w > maxSize[0] or h > maxSize[1])):
                break
            if w >= minSize[0] and h >= minSize[1]:
                small = dense.apply_resize(a, int(a.shape[1] / f), int(a.shape[0] / f))
                if small.shape[0] >= self.size[1] and small.shape[1] >= self.size[0]:
                    x, y = self._windows(small, 1 if f > 2 else 2)
                    found.append(np.column_stack([half_away(x * f), half_away(y * f), np.full(len(x), w), np.full(len(x), h)]))
            f *= scaleFactor
        return groupRectangles(np.concatenate(found) if found else [], minNeighbors)[0]


class QRCodeDetector:
    """Finds a code by its three finder patterns (runs of 1:1:3:1:1 both ways) and gives its four corners. Payloads aren't decoded."""

    def _finders(self, a):
        t = dense.apply_otsu_threshold(a)[0]
        dark = a <= t
        hits = []
        for y, row in enumerate(dark):
            e = np.flatnonzero(np.diff(np.concatenate([[-1], row.astype(int), [-1]])))
            n = np.diff(e)
            for i in range(len(n) - 4):
                unit = n[i : i + 5].sum() / 7
                if row[e[i]] and unit >= 1 and (np.abs(n[i : i + 5] - unit * np.array([1, 1, 3, 1, 1])) <= unit * np.array([0.7, 0.7, 1.5, 0.7, 0.7])).all():
                    x = int((e[i + 2] + e[i + 3]) / 2)
                    if self._column(dark[:, x], y, unit):
                        hits.append((x, y, unit))
        groups: list[list] = []
        for x, y, u in hits:
            for g in groups:
                gx, gy, gu = np.mean(g, 0)
                if np.hypot(gx - x, gy - y) < 4 * gu:
                    g.append((x, y, u))
                    break
            else:
                groups.append([(x, y, u)])
        return sorted((tuple(np.mean(g, 0)) for g in groups if len(g) > 1), key=lambda g: -g[2])[:3]

    def _column(self, col, y, unit):
        e = np.flatnonzero(np.diff(np.concatenate([[-1], col.astype(int), [-1]])))
        i = np.searchsorted(e, y, "right") - 1
        n = np.diff(e)
        if i < 2 or i + 3 > len(n) or not col[y]:
            return False
        n = n[i - 2 : i + 3]
        return bool((np.abs(n - unit * np.array([1, 1, 3, 1, 1])) <= unit * np.array([1, 1, 2, 1, 1])).all())

    def detect(self, img):
        a = np.asarray(img)
        a = dense.rgb_to_gray(a).reshape(a.shape[:2]) if a.ndim == 3 and a.shape[2] == 3 else a.reshape(a.shape[:2])
        f = self._finders(a)
        if len(f) < 3:
            return False, None
        p, unit = np.array(f)[:, :2], np.mean([u for *_, u in f])
        d = ((p[:, None] - p[None]) ** 2).sum(-1)
        c = int(d.sum(1).argmin())
        o = p[c]
        u, v = (p[i] - o for i in range(3) if i != c)
        if u[0] * v[1] - u[1] * v[0] < 0:
            u, v = v, u
        eu, ev = u / np.linalg.norm(u) * 3.5 * unit, v / np.linalg.norm(v) * 3.5 * unit
        return True, np.array([o - eu - ev, o + u + eu - ev, o + u + v + eu + ev, o + v - eu + ev], np.float32)[None]


def blobFromImage(image, scalefactor=1.0, size=(0, 0), mean=(0.0, 0.0, 0.0), swap_rb=False, crop=False, ddepth=5):
    """(1, channels, height, width): resized (cropped from the middle if asked), mean taken off, scaled."""
    a = np.asarray(image)
    a = a[..., None] if a.ndim == 2 else a
    w, h = size
    if w and h and (a.shape[1], a.shape[0]) != (w, h):
        if crop:
            f = max(w / a.shape[1], h / a.shape[0])
            a = dense.apply_resize(a, int(half_away(a.shape[1] * f)), int(half_away(a.shape[0] * f)))
            y, x = (a.shape[0] - h) // 2, (a.shape[1] - w) // 2
            a = a[y : y + h, x : x + w]
        else:
            a = dense.apply_resize(a, w, h)
    a = a[..., ::-1] if swap_rb and a.shape[2] >= 3 else a
    out = (a.astype(np.float32) - np.array(mean, np.float32)[: a.shape[2]]) * np.float32(scalefactor)
    return out.transpose(2, 0, 1)[None].astype(np.uint8 if ddepth == 0 else np.float32)


class Net:
    """A network run by ONNX Runtime; made from a file's path or its bytes, so that bytes can be broadcast."""

    def __init__(self, model):
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1  # tasks share an executor's cores
        self.session = onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"])
        self.inputs: dict[str, np.ndarray] = {}

    def setInput(self, blob, name=""):
        self.inputs[name or self.session.get_inputs()[0].name] = np.asarray(blob)

    def forward(self, output_name=None):
        return self.session.run([output_name] if output_name else None, self.inputs)[0]


def readNetFromONNX(onnx_file):
    return Net(onnx_file)


def readNet(model, config=None, framework=None):
    """By framework, else by the file's ending; ONNX runs here, other formats are converted to ONNX beforehand."""
    if (framework or str(model).rpartition(".")[2]).lower() != "onnx":
        raise ValueError("only ONNX models run here; convert the model first")
    return Net(model)


def readNetFromTensorflow(model, config=None):
    """A TensorFlow graph that was exported to ONNX; the graph format itself has no runtime here."""
    return readNet(model, config)


__all__ = ["CascadeClassifier", "HOGDescriptor", "NMSBoxes", "Net", "QRCodeDetector", "blobFromImage", "groupRectangles", "readNet", "readNetFromONNX", "readNetFromTensorflow", "shapes"]
