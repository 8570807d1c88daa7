"""What a task holds and does grows no faster than its images; results are those of plain loops."""

import os
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql.functions import spark_partition_id

from rasterloom import scenes
from rasterloom.kernels import dense, detect, features, lines, photo, shapes
from rasterloom.operators import images, px
from rasterloom.operators.groups import by_key
from rasterloom.sources import codecs, spark_images


def _rows(spark, n, h=64, w=64):
    return spark.range(n).coalesce(1).selectExpr("id img_id", f"{h} height", f"{w} width", "1 channels", f"unhex(repeat('07', {h * w})) data")


def test_kernels_get_few_images_at_once(spark):
    def f(a):
        return a

    f.stack = lambda a: [np.full((1, 1), len(a))] * len(a)
    got = [r.v[0] for r in images.run(_rows(spark, 500), f).collect()]
    assert len(got) == 500 and max(got) * 64 * 64 <= images.BLOCK
    large = images.run(_rows(spark, 2, 1024, 1024), f).collect()
    assert [r.v[0] for r in large] == [1, 1]  # one image that is larger than a block


def test_rows_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(images, "_cast", lambda batches, schema: (images.pa.RecordBatch.from_pydict({"img_id": images.pa.array([b.num_rows], images.pa.int64()), "idx": images.pa.array([0], images.pa.int32()), "x": images.pa.array([0.0])}) for b in batches))
    sizes = [r.img_id for r in images.rows(_rows(spark, 40), lambda a: [(float(v),) for v in a.ravel()], "x double", ["x"]).collect()]
    assert sum(sizes) == 40 * 64 * 64 and max(sizes) <= images.ROWS


def _text(h, seed=0):
    """A page of h lines whose characters look like text: few strong edges, many weak ones."""
    return np.random.default_rng(seed).choice(np.frombuffer(b" <>/=\"aeiounrstldmp0123.\0", np.uint8), (h, 64))


def _took(f):
    t = time.process_time()
    out = f()
    return out, time.process_time() - t


def _spans(limit):
    """Seconds, for a machine that is as slow as this one is just now: limit for one that counts to 50,000 in a millisecond."""
    return limit * max(1.0, 1e3 * min(_took(lambda: sum(range(50_000)))[1] for _ in range(5)))


def plain_bilateral(a, space, colour):
    r, v = int(np.ceil(3 * space)), a.astype(float)
    p = np.pad(v, r, constant_values=np.nan)
    total, norm = np.zeros_like(v), np.zeros_like(v)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            t = p[r + dy : r + dy + v.shape[0], r + dx : r + dx + v.shape[1]]
            wt = np.nan_to_num(np.exp(-(dx * dx + dy * dy) / (2 * space**2)) * np.exp(-((t - v) ** 2) / (2 * colour**2)))
            total, norm = total + np.nan_to_num(t) * wt, norm + wt
    return dense.round8(total / norm)


def test_bilateral_smoothing_takes_its_weights_from_tables():
    a = _text(150)
    new, took = _took(lambda: features.smooth_bilateral(a, 1.5, 20.0))
    old, plain = _took(lambda: plain_bilateral(a, 1.5, 20.0))
    assert (new == old).all() and took < plain / 1.5


def test_segments_are_grown_from_their_pixels_alone():
    a = _text(800)
    got, took = _took(lambda: lines.line_segment_detector(a))
    assert got and took < _spans(2)
    ramp = np.add.outer(np.arange(20) * 6, np.zeros(64)).astype(np.uint8)
    x1, y1, x2, y2, _ = lines.line_segment_detector(ramp)[0]
    assert sorted((x1, x2)) == pytest.approx([1, 62], abs=1.5) and y1 == pytest.approx(y2, abs=1e-6)


def test_rectangles_are_grouped_without_a_square_of_them():
    r = np.array([(x, y, 8, 8) for y in range(0, 300, 2) for x in range(0, 56, 2)])
    tracemalloc.start()
    groups = detect._overlap_groups(r, 0.2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6 and (groups == np.arange(len(r))).all()  # two apart, 1.6 are near


@pytest.mark.parametrize("eps", [0.05, 0.2, 0.9])
def test_rectangle_groups_are_those_of_all_pairs(eps, monkeypatch):
    rng = np.random.default_rng(1)
    for n in (1, 2, 40, 90):
        r = np.column_stack([rng.integers(-9, 50, n), rng.integers(0, 50, n), rng.integers(1, 25, n), rng.integers(1, 25, n)]).astype(float)
        delta = eps * (np.minimum.outer(r[:, 2], r[:, 2]) + np.minimum.outer(r[:, 3], r[:, 3])) / 2
        near = np.all([np.abs(np.subtract.outer(v, v)) <= delta for v in (r[:, 0], r[:, 1], r[:, 0] + r[:, 2], r[:, 1] + r[:, 3])], 0)
        want = np.arange(n)
        for _ in range(n):
            want = np.where(near, want[None], n).min(1)
        for most in (3, 1 << 18):
            monkeypatch.setattr(detect, "PAIRS", most)
            assert (detect._overlap_groups(r, eps) == want).all()


def test_scenes_are_solved_once(spark):
    drawn = scenes.solved(lambda a, b, c: np.random.default_rng().random((1, 1)), 9)
    tables = "/root/testdata/sf0.1"
    got = drawn(spark, tables).join(scenes.scenes(spark, tables), "img_id")
    n, kinds, values = got.selectExpr("count(*)", "count(distinct a, b, c)", "count(distinct v)").first()
    assert n == 1000 and values == kinds < n


def test_small_rows_are_worked_on_by_many_tasks(spark):
    df = spark.range(1000).selectExpr("id k", "0 i", "id v")
    parts = by_key(df, "k", "i", ["v"], lambda p: [(os.getpid(),)], "pid bigint", ["pid"]).select(spark_partition_id()).distinct().count()
    assert parts >= 4


def test_matches_and_keypoints_are_drawn_all_at_once():
    a, b = _text(60), _text(40, 1)
    p, q = features.fast_detect(a), features.fast_detect(b)
    matches = [features.DMatch(i, j, 0.0) for i, j in zip(range(0, len(p), 2), range(len(q) - 1, 0, -3), strict=False)]
    c = shapes.Canvas(np.zeros((60, 128, 3), np.uint8), (0, 255, 0))
    c.out[:, :64], c.out[:40, 64:] = a[..., None], b[..., None]
    for m in matches:
        s, t = p[m.query_idx], q[m.train_idx]
        c.line((s.x, s.y), (t.x + 64, t.y))
        for x, y in ((s.x, s.y), (t.x + 64, t.y)):
            shapes._circle_on(c, int(x), int(y), 3, 1)
    c.colour[:] = (255, 0, 0)
    for points, used, dx in ((p, {m.query_idx for m in matches}, 0), (q, {m.train_idx for m in matches}, 64)):
        for i, s in enumerate(points):
            if i not in used:
                shapes._circle_on(c, int(s.x) + dx, int(s.y), 3, 1)
    assert (features.drawMatches(a, p, b, q, matches) == c.out).all()
    p = features.fast_detect(a := _text(400), 5)
    c = shapes.Canvas(np.repeat(a[..., None], 3, 2), 0)

    def plain():
        for s in p:
            c.colour[:] = [int(s.x * u + s.y * v) % 256 for u, v in ((456.123, 789.789), (789.123, 123.789), (123.456, 456.789))]
            shapes._circle_on(c, int(s.x), int(s.y), 3, 1)

    (got, took), (_, slow) = _took(lambda: features.drawKeypoints(a, p)), _took(plain)
    assert (got == c.out).all() and took < slow / 3
    took = _took(lambda: features.drawMatches(a, p, a, p, [features.DMatch(i, i, 0.0) for i in range(len(p))]))[1]
    assert took < slow


BLOCKS = np.kron(np.random.default_rng(2).integers(0, 256, (800, 9)), np.ones((6, 7))).astype(np.uint8)


def test_blobs_are_found_in_one_sort():
    blobs, took = _took(lambda: features.simple_blob_detect(BLOCKS, threshold_step=40.0))
    assert blobs and took < _spans(0.8)


def test_regions_are_found_in_one_sort():
    regions, took = _took(lambda: features.mser_detect(BLOCKS, 32, 30))
    assert regions and took < _spans(0.8)
    for r in regions[:5]:
        assert len(set(r)) == len(r) and all(any(abs(x - u) + abs(y - v) == 1 for u, v in r[:i]) for i, (x, y) in enumerate(r) if i)


def plain_label(mask, moves):
    out, n = np.zeros(mask.shape, int), 0
    for y, x in np.argwhere(mask):
        if not out[y, x]:
            n, todo = n + 1, [(y, x)]
            while todo:
                v, u = todo.pop()
                if 0 <= v < mask.shape[0] and 0 <= u < mask.shape[1] and mask[v, u] and not out[v, u]:
                    out[v, u] = n
                    todo += [(v + dy, u + dx) for dy, dx in moves]
    return out


def test_labels_are_those_of_a_plain_fill():
    rng = np.random.default_rng(3)
    eight = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    for shape in ((1, 1), (1, 9), (9, 1), (30, 20)):
        for share in (0.2, 0.5, 0.8):
            m = rng.random(shape) < share
            assert (shapes.label(m, 4) == plain_label(m, shapes.FOUR)).all() and (shapes.label(m, 8) == plain_label(m, eight)).all()
    snake = np.zeros((600, 64), bool)
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    (lab, took) = _took(lambda: shapes.label(snake, 4))
    assert lab.max() == 1 and took < _spans(0.008)


def plain_fast(image, threshold):
    a, out = image.astype(int), {}
    for y in range(3, a.shape[0] - 3):
        for x in range(3, a.shape[1] - 3):
            for s in (1, -1):
                d = [s * (int(a[y + dy, x + dx]) - int(a[y, x])) - threshold for dy, dx in features.CIRCLE] * 2
                run = total = 0
                for e in d:
                    run, total = (run + 1, total + e) if e > 0 else (0, 0)
                    if run >= 9:
                        out[x, y] = max(out.get((x, y), 0), total)
    return out


def test_corners_are_those_of_a_plain_loop():
    a = np.kron(np.random.default_rng(4).integers(0, 256, (9, 8)), np.ones((5, 6))).astype(np.uint8)
    a[20:23, 20:23], a[30, 30] = 255, 0
    assert {(p.x, p.y): p.response for p in features.fast_detect(a, 20, False)} == plain_fast(a, 20)
    assert _took(lambda: features.fast_detect(_text(1500)))[1] < _spans(0.04)


def test_keypoints_are_described_many_at_once(monkeypatch):
    a, calls = _text(400), []
    kept = features._bits
    monkeypatch.setattr(features, "_bits", lambda flags: calls.append(1) or kept(flags))
    for f in (features.orb_detect_and_compute, features.brisk_detect_and_compute, features.akaze_detect_and_compute):
        calls.clear()
        points, rows = f(a)
        assert len(points) == len(rows) > 200 and len(calls) < len(points) / 10


def test_good_features_are_far_from_each_other():
    a = _text(2000)
    (points, took) = _took(lambda: features.good_features_to_track(a, 10**6, min_distance=3.0))
    p = np.array([q.pt for q in points])
    assert len(p) > 1000 and took < _spans(0.25)
    assert all((((p[:i] - p[i]) ** 2).sum(1) >= 9).all() for i in range(1, 200))


def plain_segments(image, threshold, least, gap):
    a = image > 0
    thetas = np.radians(np.arange(180.0))
    votes, top = dense.hough_votes(a, thetas)
    spent, out = np.zeros_like(a), []
    for r, t in zip(*np.nonzero(votes >= threshold), strict=True):
        c, s, d = np.cos(thetas[t]), np.sin(thetas[t]), float(r - top)
        u = np.arange(a.shape[1] if abs(s) > abs(c) else a.shape[0])
        v = dense.half_away((d - u * (c if abs(s) > abs(c) else s)) / (s if abs(s) > abs(c) else c)).astype(int)
        x, y = (u, v) if abs(s) > abs(c) else (v, u)
        p = np.array([(i, j) for i, j in zip(x, y, strict=True) if 0 <= i < a.shape[1] and 0 <= j < a.shape[0] and a[j, i] and not spent[j, i]]).reshape(-1, 2)
        for part in np.split(p, np.flatnonzero(np.hypot(*np.diff(p, axis=0).T) > gap) + 1) if len(p) > 1 else []:
            if np.hypot(*(part[0] - part[-1])) >= least:
                out.append((*map(int, part[0]), *map(int, part[-1])))
                spent[part[:, 1], part[:, 0]] = True
    return out


def test_hough_segments_are_those_of_a_plain_loop():
    a = (np.random.default_rng(6).random((60, 40)) < 0.15).astype(np.uint8) * 255
    got = lines.hough_lines_p(a, threshold=8, min_line_length=10.0, max_line_gap=4.0)
    assert got == plain_segments(a, 8, 10.0, 4.0) and got
    assert _took(lambda: lines.hough_lines_p(np.tile(a, (10, 1)), threshold=8, min_line_length=10.0, max_line_gap=4.0))[1] < _spans(1)


def test_votes_are_counted_in_parts():
    a = np.full((400, 64), 255, np.uint8)
    tracemalloc.start()
    votes, top = dense.hough_votes(a, np.radians(np.arange(180.0)))
    circles = dense.hough_circles(a, 5, 360)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert votes[:, 0].sum() == a.size and (votes[top : top + 64, 0] == 400).all() and peak < 60e6
    assert {(x, y) for x, y, _ in circles} == {(x, y) for x in range(5, 59) for y in range(5, 395)}


def test_denoising_takes_stacks():
    a = np.random.default_rng(7).integers(0, 256, (6, 8, 8, 3)).astype(np.uint8)
    grey, colour = photo.fastNlMeansDenoising.stack(a[..., :1], 10.0, 3, 9), photo.fastNlMeansDenoisingColored.stack(a, 10.0, 10.0, 3, 9)
    for i in range(6):
        assert (photo.fastNlMeansDenoising(a[i, ..., 0], 10.0, 3, 9) == grey[i, ..., 0]).all() and (photo.fastNlMeansDenoisingColored(a[i], 10.0, 10.0, 3, 9) == colour[i]).all()


def test_nearest_rows_are_looked_for_by_products():
    rng = np.random.default_rng(8)
    for scale, shift in ((1, 0), (0.1, 0), (1, 1e8), (1e200, 0)):
        q, t = (rng.integers(0, 3, (n, 4)) * scale + shift for n in (20, 90))
        d = np.sqrt(sum((a[:, None] - b) ** 2 for a, b in zip(q.T, t.T, strict=True)))
        for k in (1, 3):
            at, to = px._candidates(q, t, k, "L2")
            e = px._exact(q[at], t[to], "L2")
            for i in range(20):
                best = np.lexsort((to[at == i], e[at == i]))[:k]
                assert (to[at == i][best] == np.lexsort((np.arange(90), d[i]))[:k]).all() and (e[at == i][best] == np.sort(d[i])[:k]).all()
    assert len(px._candidates(rng.normal(size=(50, 16)), rng.normal(size=(2000, 16)), 3, "L2")[0]) < 200


def test_small_image_files_share_a_task(spark, tmp_path):
    for i in range(600):
        (tmp_path / f"{i}.png").write_bytes(codecs.encode_png(np.full((2, 3), i % 256, np.uint8)))
    got = spark_images.read(spark, str(tmp_path), -1)
    assert got.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and sorted(r.data[0] for r in got.collect()) == sorted(i % 256 for i in range(600))
