"""Queries of the operators that work on point sets and parameters: a scene per supplier, solved by the kernel, checked by the SQL of what was put in.

A scene's parameters (a, b, c) come from the table. Points are made from them by a known matrix, pose or camera, and
the kernel has to find it again; so SQL that states the scene checks the whole solver. Results are (img_id, y, x, v).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import dense, detect, features, photo
from .operators.groups import by_key

Matrix = list[list[str]]
SCENE = "scene AS (SELECT s_suppkey img_id, CAST(s_suppkey % 17 AS DOUBLE) a, CAST(s_suppkey % 13 AS DOUBLE) b, CAST(CAST(floor(abs(s_acctbal)) AS BIGINT) % 7 AS DOUBLE) c FROM supplier)"


def scenes(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/supplier.parquet")
    return t.select(F.col("s_suppkey").cast("bigint").alias("img_id"), (F.col("s_suppkey") % 17).alias("a"), (F.col("s_suppkey") % 13).alias("b"), (F.floor(F.abs("s_acctbal")) % 7).alias("c"))


def each_once(spark: SparkSession, d: str, f: Callable[[np.ndarray], list[tuple]], schema: str, names: list[str]) -> DataFrame:
    """f of every supplier's scene. A scene is all that f sees, so suppliers that share one share its answer: f runs once for each that differs."""
    t = scenes(spark, d).withColumn("scene", (F.col("a") * 13 + F.col("b")) * 7 + F.col("c"))
    found = by_key(t.select("scene", "a", "b", "c").distinct(), "scene", "a", ["a", "b", "c"], f, schema, names)
    return t.select("img_id", "scene").join(found, "scene").select("img_id", *names)


def solved(f: Callable[[float, float, float], np.ndarray], digits: int) -> Callable[[SparkSession, str], DataFrame]:
    def cells(p: np.ndarray) -> list[tuple]:
        return [(int(y), int(x), round(float(v), digits) + 0.0) for a, b, c in p for (y, x), v in np.ndenumerate(np.atleast_2d(np.asarray(f(float(a), float(b), float(c)), float)))]

    return lambda s, d: each_once(s, d, cells, "y int, x int, v double", ["y", "x", "v"])


def stated(matrix: Matrix, digits: int) -> str:
    """SQL of a matrix whose cells are expressions of a, b and c."""
    cells = " UNION ALL ".join(f"SELECT img_id, {y} y, {x} x, round({e}, {digits}) + 0e0 v FROM scene" for y, row in enumerate(matrix) for x, e in enumerate(row))
    return f"WITH {SCENE} {cells}"


def _product(p: Matrix, q: Matrix) -> Matrix:
    return [["(" + " + ".join(f"{x} * {y}" for x, y in zip(row, column, strict=True) if "0e0" not in (x, y)) + ")" if any("0e0" not in (x, y) for x, y in zip(row, column, strict=True)) else "0e0" for column in zip(*q, strict=True)] for row in p]


def _rotation(angle: str) -> Matrix:
    return [[f"cos({angle})", f"(-sin({angle}))", "0e0"], [f"sin({angle})", f"cos({angle})", "0e0"], ["0e0", "0e0", "1e0"]]


def _cross(t: list[str]) -> Matrix:
    x, y, z = t
    return [["0e0", f"(-({z}))", f"({y})"], [f"({z})", "0e0", f"(-({x}))"], [f"(-({y}))", f"({x})", "0e0"]]


def _unit(m: Matrix) -> Matrix:
    """Absolute values, scaled to norm 1: what is left of a matrix that is known up to scale and sign."""
    norm = "sqrt(" + " + ".join(f"({e}) * ({e})" for row in m for e in row if e != "0e0") + ")"
    return [[f"abs({e}) / {norm}" for e in row] for row in m]


def _level(m: np.ndarray) -> np.ndarray:
    return np.abs(m) / np.linalg.norm(m)


SQUARE = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float)
GRID = np.array([(x, y) for x in range(4) for y in range(4)], float)
SOLID = np.array([(x, y, (x * y) % 3) for x in range(4) for y in range(4)], float)
FLAT = SOLID * [1, 1, 0]
K = np.array([[50.0, 0, 32], [0, 50, 32], [0, 0, 1]])
K_BACK: Matrix = [["0.02e0", "0e0", "(-0.64e0)"], ["0e0", "0.02e0", "(-0.64e0)"], ["0e0", "0e0", "1e0"]]
VIEWS = [(np.array([0.3, -0.2, 0.1]), np.array([-1.5, -1.5, 9.0])), (np.array([-0.2, 0.3, 0.0]), np.array([-1.0, -2, 8])), (np.array([0.1, 0.2, -0.3]), np.array([-2.0, -1, 10]))]

AFFINE: Matrix = [["(1 + a / 10)", "(b / 20)", "c"], ["(c / 10)", "1e0", "a"]]
HOMOGRAPHY: Matrix = [["(1 + a / 10)", "(b / 20)", "c"], ["(c / 10)", "(1 + b / 10)", "a"], ["0.01e0", "0.02e0", "1e0"]]
BASE = ["(1 + a / 10)", "(b / 10)", "((c + 1) / 10)"]
TURN = "((b - 6) / 40)"


def _affine(a: float, b: float, c: float) -> np.ndarray:
    return np.array([[1 + a / 10, b / 20, c], [c / 10, 1, a]])


def _homography(a: float, b: float, c: float) -> np.ndarray:
    return np.array([[1 + a / 10, b / 20, c], [c / 10, 1 + b / 10, a], [0.01, 0.02, 1]])


def _mapped(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = np.column_stack([p, np.ones(len(p))]) @ h.T
    return q[:, :2] / q[:, 2:]


def _two(a: float, b: float, c: float) -> tuple[np.ndarray, np.ndarray]:
    """The solid as two cameras see it: from the front, and from a turned and moved place."""
    place = np.array([-1.5, -1.5, 9.0])
    return photo._see(SOLID, np.zeros(3), place, K, None), photo._see(SOLID + place, np.array([0, 0, (b - 6) / 40]), np.array([1 + a / 10, b / 10, (c + 1) / 10]), K, None)


def _decomposed(a: float, b: float, c: float) -> list[float]:
    """The number of solutions, and how far the nearest one is from the turn and the move that were put in."""
    r, t = photo.rodrigues(np.array([0, 0, (b - 6) / 40])), np.array([1 + a / 10, b / 10, (c + 1) / 10]) / 5
    n, rs, ts, _ = photo.decomposeHomographyMat(K @ (r + np.outer(t, [0, 0, 1.0])) @ np.linalg.inv(K), K)
    return [n, min(np.abs(x - r).max() + np.abs(y - t).max() for x, y in zip(rs, ts, strict=True))]


def _stereo(a: float, b: float, c: float) -> np.ndarray:
    one, two = _two(a, b, c)
    found = photo.stereoCalibrate([SOLID], [one], [two], K, None, K, None, (64, 64))
    return np.column_stack([found[5], found[6]])


def _camera(a: float, b: float, c: float) -> np.ndarray:
    k = np.array([[50 + a, 0, 31.5 + b / 20], [0, 48 + a, 31.5 + c / 10], [0, 0, 1]])
    return photo.calibrateCamera([FLAT] * 3, [photo._see(FLAT, r, t, k, None) for r, t in VIEWS], (64, 64))[1]


def _points(a: float, b: float, c: float) -> np.ndarray:
    one, two = _two(a, b, c)
    turn = photo.rodrigues(np.array([0, 0, (b - 6) / 40]))
    x = photo.triangulatePoints(K @ np.eye(3, 4), K @ np.column_stack([turn, [1 + a / 10, b / 10, (c + 1) / 10]]), one.T, two.T)
    return x[:3] / x[3]


_E = _product(_cross(BASE), _rotation(TURN))
_F = _product(_product([list(r) for r in zip(*K_BACK, strict=True)], _E), K_BACK)
_ANGLE, _SCALE = "radians(15 * c)", "(1 + b / 10)"
_COS, _SIN = f"({_SCALE} * cos({_ANGLE}))", f"({_SCALE} * sin({_ANGLE}))"
_DET = "((1 + a / 10) - b / 20 * c / 10)"
_GX, _GY = "(({x}) * cos(a / 5) + ({y}) * sin(a / 5))", "(-({x}) * sin(a / 5) + ({y}) * cos(a / 5))"
_GABOR: Matrix = [[f"exp(-({_GX} * {_GX} + 0.64e0 * {_GY} * {_GY}) / 4.5e0) * cos(2 * pi() * {_GX} / (3 + b / 10))".format(x=x, y=y) for x in range(-2, 3)] for y in range(-2, 3)]
_ELEMENT: Matrix = [[f"(CASE c % 3 WHEN 0 THEN 1 WHEN 1 THEN {int(x == 3 or y == 2)} ELSE {int(4 * (x - 3) ** 2 + 9 * (y - 2) ** 2 <= 36)} END)" for x in range(7)] for y in range(5)]

#: name: the solver, what SQL states, decimal places
SCENES: dict[str, tuple[Callable, Matrix, int]] = {
    "get_structuring_element": (lambda a, b, c: dense.get_structuring_element(int(c) % 3, 7, 5), _ELEMENT, 0),
    "get_gabor_kernel": (lambda a, b, c: dense.get_gabor_kernel(5, 1.5, a / 5, 3 + b / 10, 0.8), _GABOR, 5),
    "get_rotation_matrix_2d": (lambda a, b, c: dense.get_rotation_matrix_2d((a, b), 15 * c, 1 + b / 10), [[_COS, _SIN, f"((1 - {_COS}) * a - {_SIN} * b)"], [f"(-{_SIN})", _COS, f"({_SIN} * a + (1 - {_COS}) * b)"]], 5),
    "get_affine_transform": (lambda a, b, c: dense.get_affine_transform(SQUARE[:3], np.column_stack([SQUARE[:3], np.ones(3)]) @ _affine(a, b, c).T), AFFINE, 5),
    "invert_affine_transform": (lambda a, b, c: dense.invert_affine_transform(_affine(a, b, c)), [[f"1 / {_DET}", f"-b / 20 / {_DET}", f"(b / 20 * a - c) / {_DET}"], [f"-c / 10 / {_DET}", f"(1 + a / 10) / {_DET}", f"(c / 10 * c - (1 + a / 10) * a) / {_DET}"]], 9),
    "get_perspective_transform": (lambda a, b, c: dense.get_perspective_transform(SQUARE, _mapped(_homography(a, b, c), SQUARE)), HOMOGRAPHY, 5),
    "findHomography": (lambda a, b, c: (h := features.findHomography(GRID, _mapped(_homography(a, b, c), GRID))[0]) / h[2, 2], HOMOGRAPHY, 4),
    "calibrateCamera": (_camera, [["50 + a", "0e0", "31.5e0 + b / 20"], ["0e0", "48 + a", "31.5e0 + c / 10"], ["0e0", "0e0", "1e0"]], 3),
    "solvePnP": (lambda a, b, c: np.stack(photo.solvePnP(SOLID, photo._see(SOLID, np.array([0.1, 0.2, (b - 6) / 20]), np.array([(a - 8) / 10, -1, 9 + c / 10]), K, None), K, None)[1:]), [["0.1e0", "0.2e0", "(b - 6) / 20"], ["(a - 8) / 10", "-1e0", "9 + c / 10"]], 4),
    "stereoCalibrate": (_stereo, [[*row, t] for row, t in zip(_rotation(TURN), BASE, strict=True)], 4),
    "stereoRectify": (lambda a, b, c: photo.stereoRectify(K, None, K, None, (64, 64), np.eye(3), [1 + a / 10, 0, 0])[4], [["1e0", "0e0", "0e0", "-31.5e0"], ["0e0", "1e0", "0e0", "-31.5e0"], ["0e0", "0e0", "0e0", "50e0"], ["0e0", "0e0", "-1 / (1 + a / 10)", "0e0"]], 5),
    "findEssentialMat": (lambda a, b, c: _level(photo.findEssentialMat(*_two(a, b, c), K)[0]), _unit(_E), 4),
    "findFundamentalMat": (lambda a, b, c: _level(photo.findFundamentalMat(*_two(a, b, c))[0]), _unit(_F), 4),
    "decomposeHomographyMat": (_decomposed, [["4e0", "0e0"]], 4),
    "triangulatePoints": (_points, [[f"{float(v)}" for v in row] for row in (SOLID + [-1.5, -1.5, 9.0]).T], 4),
}

QUERIES = {name: (solved(f, digits), stated(matrix, digits)) for name, (f, matrix, digits) in SCENES.items()}


def _board(a: float, b: float, c: float) -> tuple[np.ndarray, np.ndarray]:
    """A board of 4 x 5 squares, and its 12 inner corners."""
    q, x, y = int(7 + a % 4), int(4 + b % 6), int(4 + c)
    image = np.full((64, 64), 220, np.uint8)
    for i, j in np.ndindex(4, 5):
        if (i + j) % 2 == 0:
            image[y + i * q : y + i * q + q, x + j * q : x + j * q + q] = 30
    return image, np.array([(x + q * (j + 1), y + q * (i + 1)) for i in range(3) for j in range(4)], float)


def _code(a: float, b: float, c: float) -> tuple[np.ndarray, np.ndarray]:
    """The three finder patterns of a code of 21 modules, and its corners."""
    u, x, y = int(2 + a % 2), int(3 + b % 10), int(3 + c)
    image = np.full((80, 80), 255, np.uint8)
    for p, q in ((x, y), (x + 14 * u, y), (x, y + 14 * u)):
        for at, size, v in ((0, 7, 0), (1, 5, 255), (2, 3, 0)):
            image[q + at * u : q + (at + size) * u, p + at * u : p + (at + size) * u] = v
    return image, np.array([(x, y), (x + 21 * u, y), (x + 21 * u, y + 21 * u), (x, y + 21 * u)], float)


def located(scene: Callable, find: Callable[[np.ndarray], tuple[bool, np.ndarray | None]], points: int) -> tuple[Callable, str]:
    """Which of a scene's points are found within a pixel, in order; SQL states that all are."""

    def rows(p: np.ndarray) -> list[tuple]:
        out = []
        for a, b, c in p:
            image, want = scene(float(a), float(b), float(c))
            found, at = find(image)
            out += [(i, bool(found) and bool(np.abs(np.reshape(at, (-1, 2))[i] - want[i]).max() <= 1)) for i in range(points)]
        return out

    return lambda s, d: each_once(s, d, rows, "point int, found boolean", ["point", "found"]), f"WITH {SCENE} SELECT img_id, CAST(i AS INT) point, TRUE found FROM scene CROSS JOIN range({points}) r(i)"


QUERIES["findChessboardCorners"] = located(_board, lambda image: photo.findChessboardCorners(image, (4, 3)), 12)
QUERIES["QRCodeDetector"] = located(_code, lambda image: detect.QRCodeDetector().detect(image), 4)
