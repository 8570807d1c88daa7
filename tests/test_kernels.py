"""Micro goldens and properties of the kernels."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom import cv
from rasterloom.kernels import photo
from rasterloom.plans import lut
from rasterloom.registry import CLASSES, KERNELS

RNG = np.random.default_rng(0)
IMAGE = RNG.integers(0, 256, (12, 10, 3)).astype(np.uint8)
GREY = IMAGE[..., 0]
RAMP = np.arange(9, dtype=np.uint8).reshape(3, 3)


def test_surface():
    assert len([k for k in KERNELS if k not in CLASSES]) == 237


def test_negative_of_zeros():
    assert (cv.apply_negative(np.zeros((100, 100, 3), np.uint8)) == 255).all()


@pytest.mark.parametrize(("mode", "corner"), [("reflect", 0 + 0 + 1 + 0 + 0 + 1 + 3 + 3 + 4), ("reflect_101", 4 + 3 + 4 + 1 + 0 + 1 + 4 + 3 + 4), ("replicate", 0 + 0 + 1 + 0 + 0 + 1 + 3 + 3 + 4), ("wrap", 8 + 6 + 7 + 2 + 0 + 1 + 5 + 3 + 4), ("constant", 9 * 5 - 20 + 0 - 5 + 1 + 3 + 4 - 3 + 0)])
def test_borders(mode, corner):
    if mode == "constant":
        corner = 5 * 5 + 0 + 1 + 3 + 4
    assert cv.apply_filter2d(RAMP, np.ones((3, 3)), mode, 5)[0, 0] == corner


def test_rounding_rules():
    a = np.array([[5]], np.uint8)
    assert cv.add_weighted(a, 0.5, a, 0.0, 0.0)[0, 0] == 2 and cv.convert_scale_abs(a, 0.5)[0, 0] == 3 and cv.convert_scale_abs(a, -0.5)[0, 0] == 3


def test_thresholds():
    assert int(cv.apply_otsu_threshold(np.full((4, 4), 9, np.uint8))[0]) == 0
    two = np.repeat([[10, 200]], 4, 0).astype(np.uint8)
    t, out = cv.apply_otsu_threshold(two)
    assert int(t) == 10 and (out == [[0, 255]] * 4).all()
    with pytest.raises(ValueError):
        cv.apply_otsu_with_mode(two, "no")


def test_colours():
    p = np.array([[[255, 0, 0], [0, 255, 0]], [[0, 0, 255], [255, 255, 255]]], np.uint8)
    assert cv.rgb_to_hsv(p).reshape(-1, 3).tolist() == [[0, 255, 255], [60, 255, 255], [120, 255, 255], [0, 0, 255]]
    assert cv.rgb_to_hls(p)[0, 0].tolist() == [0, 128, 255]
    assert np.allclose(cv.rgb_to_lab(p)[1, 1], [100, 0, 0], atol=0.02)
    assert (cv.cvtColor(p, 40) == cv.rgb_to_hsv(p[..., ::-1])).all()
    with pytest.raises(ValueError):
        cv.cvtColor(p, 5)


def test_morphology_and_properties():
    k = cv.get_structuring_element(1, 3, 3)
    e, d = cv.apply_erosion(GREY, k), cv.apply_dilation(GREY, k)
    assert (e <= GREY).all() and (GREY <= d).all()
    o = cv.opening(GREY, k)
    assert (cv.opening(o, k) == o).all() and (cv.morphology_ex(GREY, 2, k) == o).all()
    assert (cv.morphological_gradient(GREY, k) == d - e).all()
    assert cv.integral(GREY)[-1, -1] == GREY.sum()
    assert (cv.merge_channels(cv.split_channels(IMAGE)) == IMAGE).all()
    assert (cv.apply_transpose(cv.apply_transpose(IMAGE)) == IMAGE).all() and (cv.flip(cv.flip(GREY, -1), -1) == GREY).all()
    assert (cv.apply_resize(GREY, 10, 12, 2) == GREY).all() and (cv.apply_translate(GREY, 0, 0) == GREY).all()
    assert (cv.apply_rotate(GREY, 0.0) == np.vstack([np.zeros((1, 10), np.uint8), GREY[:0:-1]])).all() and (cv.apply_rotate(GREY, 0.0, compat=False) == GREY).all()
    h = cv.calc_hist(GREY, 0, 16, (0.0, 256.0))
    assert h.sum() == GREY.size and cv.emd_1d(h, h) == 0 and cv.compare_hist(h, h, 0) == pytest.approx(1)
    assert cv.apply_laplacian(GREY, 1).sum() == pytest.approx(cv.apply_filter2d(GREY, np.zeros((3, 3))).sum(), abs=1e5)


def test_segmentation():
    a = np.zeros((4, 4), np.uint8)
    a[0, 0] = a[1, 1] = a[3, 3] = 255
    assert cv.connected_components(a, 8).max() == 2 and cv.connected_components(a, 4).max() == 3
    n, _, stats, centre = cv.connected_components_with_stats(a, 8)
    assert n == 3 and stats[1].tolist() == [0, 0, 2, 2, 2] and stats[0].tolist() == [0, 0, 4, 4, 13] and centre[2].tolist() == [3, 3]
    assert (cv.distance_transform(np.full((3, 3), 1, np.uint8)) == 0).all()
    d = np.full((3, 3), 1, np.uint8)
    d[0, 0] = 0
    assert cv.distance_transform(d)[2, 2] == pytest.approx(2.828, abs=1e-5)
    assert cv.flood_fill(a, (1, 0), 9)[0] == 12 or cv.flood_fill(a, (1, 0), 9)[0] > 0


def test_shapes():
    square = np.array([(0, 0), (4, 0), (4, 4), (0, 4)])
    ell = np.array([(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)])
    assert cv.contour_area(square) == 16 and cv.contour_area(square[::-1], True) == -16 and cv.arc_length(square) == 16 and cv.bounding_rect(square) == (0, 0, 5, 5)
    assert cv.is_contour_convex(square) and not cv.is_contour_convex(ell) and len(cv.convex_hull(ell)) == 5
    assert cv.min_enclosing_circle(square)[1] == pytest.approx(np.sqrt(8)) and cv.moments(square.astype(np.int32))["m00"] == 16
    assert cv.point_polygon_test(square, (2, 2), True) == 2 and cv.point_polygon_test(square, (4, 1), False) == 0 and cv.point_polygon_test(square, (6, 2), True) == -2
    assert len(cv.convexity_defects(ell, cv.convex_hull(ell, return_points=False))) == 1
    assert cv.approx_poly_dp(np.array([(0, 0), (2, 0), (4, 0), (4, 4), (0, 4)]), 0.5).tolist() == square.tolist()
    a = np.zeros((8, 8), np.uint8)
    a[2:5, 2:6] = 1
    c = cv.find_contours(a)
    assert len(c) >= 1 and all((p[0] == p[-1]).all() or len(p) == 1 for p in c) and all(a[y, x] for p in c for x, y in p)
    turned = np.column_stack([-square[:, 1], square[:, 0]]) * 3
    assert np.allclose(cv.hu_moments(cv.moments(square.astype(np.int32)))[0], cv.hu_moments(cv.moments(turned.astype(np.int32)))[0])


def test_shape_distance():
    square = np.array([(0, 0), (4, 0), (4, 4), (0, 4)])
    assert all(cv.match_shapes(square, square * 3, m) == pytest.approx(0, abs=1e-9) for m in (1, 2, 3)) and cv.match_shapes(square, square * [1, 4], 2) > 0.1
    d = np.full((4, 4), 7.0)
    assert cv.match_template(d, np.zeros((2, 2)), 1).max() == 1 and cv.match_template(d, np.full((2, 2), 7.0), 3).min() == pytest.approx(1)
    x, y = np.meshgrid(np.arange(4) + 0.6, np.arange(4.0))
    assert (cv.apply_remap(d.astype(np.uint8), x, y, 0)[:, 3] == 7).all()


def test_drawing():
    z = np.zeros((8, 8), np.uint8)
    assert cv.line(z, (0, 0), (7, 7), 5).trace() == 40 and cv.rectangle(z, (1, 1), (3, 3), 1, -1).sum() == 9 and cv.rectangle(z, (1, 1), (3, 3), 1).sum() == 8
    assert cv.circle(z, (4, 4), 2, 1, -1).sum() == 17 and (z == 0).all() and cv.put_text(z, "A\x7fé", (0, 8), 1.0, 1).sum() > 5


def test_lines_and_matches():
    z = np.zeros((20, 20), np.uint8)
    z[5, 2:18] = 255
    assert (5.0, np.pi / 2) in [(r, t) for r, t in cv.hough_lines(z, 16, 90)]
    assert cv.hough_lines_p(z, threshold=16, min_line_length=10.0)[0][1] == 5
    d = np.array([[0, 0], [3, 4], [6, 8]], np.float32)
    assert [m.train_idx for m in cv.bf_match(d, d[::-1].copy())] == [2, 1, 0] and cv.knn_match(d[:1], d, 2)[0][1].distance == 5
    bits = np.array([[0], [255]], np.uint8)
    assert cv.bf_match(bits, bits[::-1].copy())[0].distance == 0


def test_homography_and_pose():
    k = np.array([[500.0, 0, 320], [0, 510, 240], [0, 0, 1]])
    obj = np.array([(x, y, 0) for y in range(5) for x in range(6)], float)
    views = [(RNG.normal(0, 0.3, 3), np.array([-2.0, -2, 12]) + RNG.normal(0, 1, 3)) for _ in range(4)]
    shots = [photo._see(obj, r, t, k, None) for r, t in views]
    error, found, *_ = cv.calibrateCamera([obj] * 4, shots, (640, 480))
    assert error < 1e-6 and np.allclose(found, k, atol=1e-3)
    assert np.allclose(cv.solvePnP(obj, shots[0], k)[2], views[0][1], atol=1e-6)


def test_boxes_and_files(tmp_path):
    assert cv.NMSBoxes([[0, 0, 10, 10], [1, 1, 10, 10], [30, 30, 5, 5]], [0.9, 0.8, 0.7], 0.1, 0.4).tolist() == [0, 2]
    for ext in (".png", ".bmp"):
        cv.imwrite(tmp_path / f"a{ext}", IMAGE)
        assert (cv.imread(tmp_path / f"a{ext}") == IMAGE).all()
    cv.extract_video_from_images([str(tmp_path / "a.png"), str(tmp_path / "a.bmp")], str(tmp_path / "v.rlv"))
    cv.extract_images_from_video(str(tmp_path / "v.rlv"), str(tmp_path / "out"), 1)
    assert len(list((tmp_path / "out").iterdir())) == 2 and cv.imdecode(b"no image") is None


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from([("apply_negative",), ("apply_gamma", 0.7), ("apply_threshold_trunc", 99), ("convert_scale_abs", 1.5, -20.0)]), max_size=5))
def test_fused_points_equal_the_chain(chain):
    a = GREY
    for name, *params in chain:
        a = KERNELS[name](a, *params)
    assert (lut.fused(chain)[GREY] == a).all()
