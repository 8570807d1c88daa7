"""One query per operator on the derived fixtures, with SQL that says the same where SQL can.

Pixel results are given as checksums per image: count, sum, and a sum weighted by place, of integer values (floats
count thousandths).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from . import media
from .kernels import dense, detect, features, shapes
from .operators import images as im
from .operators import px as rel
from .operators.groups import by_key
from .registry import ALIASES, KERNELS, MODULE_OF

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[f"{MODULE_OF.get(name, 'engine')}__{name}"] = query
    if sql:
        ORACLES[f"{MODULE_OF.get(name, 'engine')}__{name}"] = sql


def check(px: DataFrame, digits: int = 0) -> DataFrame:
    v = F.floor(F.col("v").cast("double") * 10.0**digits + 0.5).cast("bigint") if digits else F.col("v").cast("bigint")
    w = v * (F.col("y") * 97 + F.col("x") * 7 + F.col("c") + 1)
    return px.groupBy("img_id").agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(w).alias("w"))


def checked(body: str, digits: int = 0, more: str = "", recursive: bool = False) -> str:
    v = f"CAST(floor(CAST(v AS DOUBLE) * {10**digits} + 0.5) AS BIGINT)" if digits else "CAST(v AS BIGINT)"
    return fx.with_fixtures(f"SELECT img_id, CAST(count(*) AS BIGINT) n, CAST(sum({v}) AS BIGINT) s, CAST(sum({v} * (y * 97 + x * 7 + c + 1)) AS BIGINT) w FROM ({body}) GROUP BY img_id", more, recursive)


def lit(x: float) -> str:
    t = repr(float(x))
    return t if "e" in t else t + "e0"


T8 = "CAST(floor(greatest(0, least(255, {}))) AS INT)"
R8 = "CAST(greatest(0, least(255, round({}))) AS INT)"
TABLE = [(i * 7 + 13) % 256 for i in range(256)]

# points

for name, params, sql, digits in (
    ("apply_negative", (), "255 - v", 0),
    ("bitwise_not", (), "255 - v", 0),
    ("apply_log", (), T8.format(f"{lit(255 / math.log(256))} * ln(1e0 + v)"), 0),
    ("apply_gamma", (0.5,), T8.format("pow(v / 255e0, 0.5e0) * 255e0"), 0),
    ("apply_threshold", (127,), "CASE WHEN v > 127 THEN 255 ELSE 0 END", 0),
    ("apply_threshold_binary_inv", (127,), "CASE WHEN v > 127 THEN 0 ELSE 255 END", 0),
    ("apply_threshold_trunc", (127,), "least(v, 127)", 0),
    ("apply_threshold_tozero", (127,), "CASE WHEN v > 127 THEN v ELSE 0 END", 0),
    ("apply_threshold_tozero_inv", (127,), "CASE WHEN v > 127 THEN 0 ELSE v END", 0),
    ("rgb_to_cmy", (), "1 - v / 255e0", 3),
    ("apply_pow", (1.5,), "pow(CAST(v AS DOUBLE), 1.5e0)", 3),
    ("apply_sqrt", (), "sqrt(CAST(v AS DOUBLE))", 3),
    ("apply_log_op", (), "CASE WHEN v = 0 THEN -1e3 ELSE ln(CAST(v AS DOUBLE)) END", 3),
    ("convert_scale_abs", (1.3, -150.0), R8.format("abs(v * 1.3e0 + -150e0)"), 0),
    ("apply_lut", (TABLE,), "(v * 7 + 13) % 256", 0),
):
    # ln of 0 is minus infinity, which counts as -1000 in a checksum.
    finite = (lambda px: px.withColumn("v", F.when(F.col("v") == float("-inf"), -1000.0).otherwise(F.col("v")))) if name == "apply_log_op" else (lambda px: px)
    add(name, lambda s, d, name=name, params=params, digits=digits, finite=finite: check(finite(rel.apply_point(fx.img8(s, d), name, *params)), digits), checked(f"SELECT img_id, y, x, c, {sql} v FROM img8", digits))
add("apply_exp", lambda s, d: check(rel.apply_point(fx.img8(s, d).withColumn("v", F.col("v") / 64.0), "apply_exp"), 3), checked("SELECT img_id, y, x, c, exp(v / 64e0) v FROM img8", 3))

# pairs

for name, params, sql, digits in (
    ("add_images", (), "least(a + b, 255)", 0),
    ("sub_images", (), "greatest(a - b, 0)", 0),
    ("add_weighted", (0.5, 0.25, 3), T8.format("a * 0.5e0 + b * 0.25e0 + 3"), 0),
    ("bitwise_and", (), "a & b", 0),
    ("bitwise_or", (), "a | b", 0),
    ("bitwise_xor", (), "xor(a, b)", 0),
    ("absdiff", (), "abs(a - b)", 0),
    ("apply_multiply", (0.5,), "a * b * 0.5e0", 3),
    ("apply_divide", (2.0,), "CASE WHEN b = 0 THEN 0 ELSE CAST(a AS DOUBLE) / b * 2e0 END", 3),
    ("apply_min", (), "least(a, b)", 0),
    ("apply_max", (), "greatest(a, b)", 0),
    ("calculate_phase", (), "atan2(CAST(b AS DOUBLE), a)", 3),
    ("calculate_magnitude", (), "sqrt(CAST(a * a + b * b AS DOUBLE))", 3),
):
    add(name, lambda s, d, name=name, params=params, digits=digits: check(rel.apply_pair(fx.pair8(s, d), name, *params), digits), checked(f"SELECT img_id, y, x, c, {sql} v FROM pair8", digits))

TWO_SQL = {
    "cart_to_polar": ("sqrt(CAST(a * a + b * b AS DOUBLE))", "atan2(CAST(b AS DOUBLE), a)"),
    "polar_to_cart": ("a * cos(radians(CAST(b AS DOUBLE)))", "a * sin(radians(CAST(b AS DOUBLE)))"),
}
for name, both in TWO_SQL.items():
    body = " UNION ALL ".join(f"SELECT img_id, y, x, {i} c, {e} v FROM pair8" for i, e in enumerate(both))
    add(name, lambda s, d, name=name: check(rel.apply_two(fx.pair8(s, d), name), 3), checked(body, 3))

# colours

R, G, B = "(r / 255e0)", "(g / 255e0)", "(b / 255e0)"
MAX, MIN = f"greatest({R}, {G}, {B})", f"least({R}, {G}, {B})"
D = f"({MAX} - {MIN})"
SAFE = f"(CASE WHEN {D} < 1e-10 THEN 1e0 ELSE {D} END)"
MOD6 = f"((({G} - {B}) / {SAFE}) - 6e0 * floor((({G} - {B}) / {SAFE}) / 6e0))"
HUE = f"(CASE WHEN {D} < 1e-10 THEN 0e0 WHEN {MAX} = {R} THEN 60e0 * {MOD6} WHEN {MAX} = {G} THEN 60e0 * (({B} - {R}) / {SAFE} + 2e0) ELSE 60e0 * (({R} - {G}) / {SAFE} + 4e0) END)"
LIGHT = f"(({MAX} + {MIN}) / 2e0)"
ROOM = f"(1e0 - abs(2e0 * {LIGHT} - 1e0))"
LIN = {n: f"(CASE WHEN {n} / 255e0 <= 0.04045e0 THEN {n} / 255e0 / 12.92e0 ELSE pow(({n} / 255e0 + 0.055e0) / 1.055e0, 2.4e0) END)" for n in "rgb"}
XYZ = [" + ".join(f"{LIN[n]} * {lit(w)}" for n, w in zip("rgb", row, strict=True)) for row in rel.XYZ]
LABF = [f"(CASE WHEN ({x}) / {lit(w)} > 0.008856e0 THEN cbrt(({x}) / {lit(w)}) ELSE 7.787037e0 * (({x}) / {lit(w)}) + 16e0 / 116e0 END)" for x, w in zip(XYZ, (0.95047, 1.0, 1.08883), strict=True)]
L_ = f"(CASE WHEN ({XYZ[1]}) > 0.008856e0 THEN 116e0 * cbrt({XYZ[1]}) - 16e0 ELSE 903.3e0 * ({XYZ[1]}) END)"
DEN = f"(({XYZ[0]}) + 15e0 * ({XYZ[1]}) + 3e0 * ({XYZ[2]}))"
DN = 0.95047 + 15 + 3 * 1.08883
UV = [f"(CASE WHEN {DEN} < 1e-10 THEN 0e0 ELSE {k} * ({t}) / {DEN} END)" for k, t in (("4e0", XYZ[0]), ("9e0", XYZ[1]))]
LINEAR = lambda rows: [R8.format(f"r * {lit(a)} + g * {lit(b)} + b * {lit(c)} + {lit(o)}") for a, b, c, o in rows]
HSV = [R8.format(f"{HUE} / 2e0"), R8.format(f"(CASE WHEN {MAX} < 1e-10 OR {D} < 1e-10 THEN 0e0 ELSE {D} / {MAX} END) * 255e0"), R8.format(f"{MAX} * 255e0")]


def _channels(*e: str) -> str:
    return " UNION ALL ".join(f"SELECT img_id, y, x, {i} c, {t} v FROM rgb" for i, t in enumerate(e))


def _images(s: SparkSession, d: str) -> DataFrame:
    return fx.rgb_images(s, d)


for name, f, channels, digits in (
    ("rgb_to_gray", rel.rgb_to_gray, [T8.format("CAST(r AS FLOAT) * CAST(0.299 AS FLOAT) + CAST(g AS FLOAT) * CAST(0.587 AS FLOAT) + CAST(b AS FLOAT) * CAST(0.114 AS FLOAT)")], 0),
    ("rgb_to_hsv", rel.rgb_to_hsv, HSV, 0),
    ("rgb_to_hls", rel.rgb_to_hls, [R8.format(f"{HUE} / 2e0"), R8.format(f"{LIGHT} * 255e0"), R8.format(f"(CASE WHEN {D} < 1e-10 THEN 0e0 ELSE least({D} / (CASE WHEN {ROOM} < 1e-10 THEN 1e0 ELSE {ROOM} END), 1e0) END) * 255e0")], 0),
    ("rgb_to_ycrcb", lambda p: rel.linear(p, rel.YCRCB), LINEAR(rel.YCRCB), 0),
    ("rgb_to_yuv", lambda p: rel.linear(p, rel.YUV), LINEAR(rel.YUV), 0),
    ("rgb_to_xyz", rel.rgb_to_xyz, XYZ, 3),
    ("rgb_to_lab", rel.rgb_to_lab, [f"116e0 * {LABF[1]} - 16e0", f"500e0 * ({LABF[0]} - {LABF[1]})", f"200e0 * ({LABF[1]} - {LABF[2]})"], 3),
    ("rgb_to_luv", rel.rgb_to_luv, [L_, f"13e0 * {L_} * ({UV[0]} - {lit(4 * 0.95047 / DN)})", f"13e0 * {L_} * ({UV[1]} - {lit(9 / DN)})"], 3),
):
    add(name, lambda s, d, f=f, digits=digits: check(f(fx.rgb(s, d)), digits), checked(_channels(*channels), digits))
add("cvtColor", lambda s, d: check(im.to_px(im.run(_images(s, d), dense.cvtColor, 41))), checked(_channels(*HSV)))
add("bgr_to_rgb", lambda s, d: check(fx.rgb8(s, d).withColumn("c", 2 - F.col("c"))), checked("SELECT img_id, y, x, 2 - c c, v FROM rgb8"))
add("gray_to_rgb", lambda s, d: check(fx.img8(s, d).withColumn("c", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))), checked("SELECT img_id, y, x, k.c, v FROM img8 CROSS JOIN (VALUES (0), (1), (2)) k(c)"))
add("in_range", lambda s, d: check(rel.in_range(fx.rgb8(s, d), [100, 110, 90], [150, 160, 170])), checked("SELECT img_id, y, x, 0 c, CASE WHEN r BETWEEN 100 AND 150 AND g BETWEEN 110 AND 160 AND b BETWEEN 90 AND 170 THEN 255 ELSE 0 END v FROM rgb"))
add(
    "split_channels",
    lambda s, d: check(rel.split(fx.rgb8(s, d)).select((F.col("img_id") * 3 + F.col("plane")).alias("img_id"), "y", "x", "c", "v")),
    checked("SELECT img_id * 3 + c img_id, y, x, 0 c, v FROM rgb8"),
)
add(
    "merge_channels",
    lambda s, d: check(rel.merge(*[fx.img8(s, d).where(f"img_id % 3 = {k}").withColumn("img_id", F.expr("img_id div 3")) for k in (2, 0, 1)])),
    checked("SELECT img_id // 3 img_id, y, x, CASE img_id % 3 WHEN 2 THEN 0 WHEN 0 THEN 1 ELSE 2 END c, v FROM img8"),
)
add("mix_channels", lambda s, d: check(fx.rgb8(s, d).withColumn("v", F.when(F.col("c") == 1, 0).otherwise(F.col("v"))).withColumn("c", (2 - F.col("c")))), checked("SELECT img_id, y, x, 2 - c c, CASE WHEN c = 1 THEN 0 ELSE v END v FROM rgb8"))

# reductions and histograms

add("count_non_zero", lambda s, d: fx.img8(s, d).groupBy("img_id").agg(F.count_if(F.col("v") > 127).alias("n")), fx.with_fixtures("SELECT img_id, CAST(count(*) FILTER (WHERE v > 127) AS BIGINT) n FROM img8 GROUP BY 1"))
add("mean_std_dev", lambda s, d: fx.rgb8(s, d).groupBy("img_id", "c").agg(F.round(F.avg("v"), 4).alias("mean"), F.round(F.stddev_pop("v"), 4).alias("std")), fx.with_fixtures("SELECT img_id, c, round(avg(v), 4) mean, round(stddev_pop(v), 4) std FROM rgb8 GROUP BY 1, 2"))
add("min_max_loc", lambda s, d: rel.min_max_loc(fx.img8(s, d)), fx.with_fixtures("SELECT img_id, min(v) min_v, max(v) max_v, arg_min(x, (v, y, x)) min_x, arg_min(y, (v, y, x)) min_y, arg_min(x, (-v, y, x)) max_x, arg_min(y, (-v, y, x)) max_y FROM img8 GROUP BY 1"))
add("apply_normalize", lambda s, d: check(rel.normalise(fx.img8(s, d)), 3), checked("SELECT img_id, y, x, c, CASE WHEN hi = lo THEN 0 ELSE (CAST(v AS DOUBLE) - lo) / (hi - lo) * 255e0 END v FROM (SELECT *, min(v) OVER (PARTITION BY img_id) lo, max(v) OVER (PARTITION BY img_id) hi FROM img8)", 3))
OTSU = """h AS (SELECT img_id, v, count(*) n FROM img8 GROUP BY 1, 2),
o AS (SELECT *, sum(n) OVER w b, sum(n * v) OVER w s, sum(n) OVER (PARTITION BY img_id) nt, sum(n * v) OVER (PARTITION BY img_id) st FROM h WINDOW w AS (PARTITION BY img_id ORDER BY v ROWS UNBOUNDED PRECEDING)),
q AS (SELECT img_id, v, CASE WHEN nt > b THEN CAST(b AS DOUBLE) * CAST(nt - b AS DOUBLE) * (CAST(s AS DOUBLE) / CAST(b AS DOUBLE) - CAST(st - s AS DOUBLE) / CAST(nt - b AS DOUBLE)) * (CAST(s AS DOUBLE) / CAST(b AS DOUBLE) - CAST(st - s AS DOUBLE) / CAST(nt - b AS DOUBLE)) ELSE 0 END var FROM o),
t AS (SELECT img_id, CASE WHEN max(var) > 0 THEN arg_min(v, (-var, v)) ELSE 0 END t FROM q GROUP BY 1)"""
add("apply_otsu_threshold", lambda s, d: check(im.to_px(im.run(fx.images8(s, d), dense.apply_otsu_threshold))), checked("SELECT img8.img_id, y, x, c, CASE WHEN v > t THEN 255 ELSE 0 END v FROM img8 JOIN t USING (img_id)", more=OTSU))
add("apply_otsu_with_mode", lambda s, d: check(rel.apply_otsu(fx.img8(s, d), "apply_threshold_tozero")), checked("SELECT img8.img_id, y, x, c, CASE WHEN v > t THEN v ELSE 0 END v FROM img8 JOIN t USING (img_id)", more=OTSU))
EQ = "e AS (SELECT img_id, c, v, CASE WHEN tot = least_ THEN v ELSE CAST(round(CAST((CAST(cum - least_ AS FLOAT) / CAST(tot - least_ AS FLOAT) * CAST(255 AS FLOAT)) AS DOUBLE)) AS INT) END o FROM (SELECT *, min(cum) OVER (PARTITION BY img_id, c) least_, max(cum) OVER (PARTITION BY img_id, c) tot FROM (SELECT img_id, c, v, CAST(sum(count(*)) OVER (PARTITION BY img_id, c ORDER BY v) AS BIGINT) cum FROM {} GROUP BY 1, 2, 3)))"
add("hist_equalize_rgb", lambda s, d: check(im.to_px(im.run(_images(s, d), dense.hist_equalize_rgb))), checked("SELECT img_id, y, x, c, o v FROM rgb8 JOIN e USING (img_id, c, v)", more=EQ.format("rgb8")))
add("hist_equalize_gray", lambda s, d: check(im.to_px(im.run(_images(s, d), dense.hist_equalize_gray))), checked("SELECT img_id, y, x, c, o v FROM grey JOIN e USING (img_id, c, v)", more="grey AS (SELECT img_id, y, x, 0 c, (r + g + b) // 3 v FROM rgb), " + EQ.format("grey")))
add("calc_hist", lambda s, d: fx.img8(s, d).groupBy("img_id", F.expr("cast(v div 16 as int)").alias("bin")).agg(F.count("*").alias("n")), fx.with_fixtures("SELECT img_id, CAST(v // 16 AS INT) bin, count(*) n FROM img8 GROUP BY 1, 2"))
HP = "hp AS (SELECT img_id, bin, sum(a) a, sum(b) b FROM (SELECT img_id, a // 16 bin, 1 a, 0 b FROM pair8 UNION ALL SELECT img_id, b // 16, 0, 1 FROM pair8) GROUP BY 1, 2)"


def _hists(s: SparkSession, d: str) -> DataFrame:
    p = fx.pair8(s, d)
    one = lambda n: p.select("img_id", F.expr(f"{n} div 16").alias("bin"), *[F.lit(int(n == m)).alias(m) for m in "ab"])
    return one("a").union(one("b")).groupBy("img_id", "bin").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _emd(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("img_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    h = _hists(s, d).withColumn("g", F.abs(F.sum("a").over(w) - F.sum("b").over(w)))
    gap = F.coalesce(F.lead("bin").over(Window.partitionBy("img_id").orderBy("bin")) - F.col("bin"), F.lit(1))
    return h.withColumn("gap", gap).groupBy("img_id").agg(F.sum(F.col("g") * F.col("gap")).alias("emd64"))


#: Of 16 bins that hold 64 pixels: correlation, chi-square, intersection, Bhattacharyya distance, as sums over the bins.
COMPARE = {
    "correlation": "CASE WHEN sqrt((sum(a * a) - 256) * (sum(b * b) - 256)) > 1e-9 THEN (sum(a * b) - 256) / sqrt((sum(a * a) - 256) * (sum(b * b) - 256)) ELSE 0 END",
    "chi_square": "sum(CASE WHEN a > 0 THEN (a - b) * (a - b) / CASE WHEN a > 0 THEN a ELSE 1 END ELSE 0 END)",
    "common": "sum(least(a, b))",
    "bhattacharyya": "sqrt(greatest(0, 1 - sum(sqrt(a * b)) / 64))",
}


def _compared(s: SparkSession, d: str) -> DataFrame:
    """The stack kernel's four methods over histograms of image pairs, both side by side in one row."""
    h = _hists(s, d)
    filled = s.range(16).select(F.col("id").alias("bin"))
    every = h.select("img_id").distinct().join(F.broadcast(filled)).join(h, ["img_id", "bin"], "left").fillna(0)  # 16 rows are broadcast
    names = list(COMPARE)
    f = lambda p: [tuple(round(dense.compare_hist(p[:, 0], p[:, 1], m), 5) + 0.0 for m in range(4))]
    return by_key(every, "img_id", "bin", ["a", "b"], f, ", ".join(f"{n} double" for n in names), names)


add("compare_hist", _compared, fx.with_fixtures("SELECT img_id, " + ", ".join(f"round(CAST({e} AS DOUBLE), 5) + 0e0 {n}" for n, e in COMPARE.items()) + " FROM (SELECT img_id, CAST(a AS DOUBLE) a, CAST(b AS DOUBLE) b FROM hp) GROUP BY 1", HP))
add("emd_1d", _emd, fx.with_fixtures("SELECT img_id, CAST(sum(g * gap) AS BIGINT) emd64 FROM (SELECT img_id, abs(sum(a) OVER w - sum(b) OVER w) g, coalesce(lead(bin) OVER w - bin, 1) gap FROM hp WINDOW w AS (PARTITION BY img_id ORDER BY bin)) GROUP BY 1", HP))
add("calc_back_project", lambda s, d: check(im.to_px(im.run(fx.images8(s, d), dense.calc_back_project, 0, np.arange(16.0) * 9, (0.0, 256.0), 1.5))), checked(f"SELECT img_id, y, x, c, {R8.format('(v // 16) * 9 * 1.5e0')} v FROM img8"))

# neighbourhoods, by stack kernels


def _where(i: str, mode: str, n: int = 8) -> str:
    inner = {"reflect": (f"least(-({i}) - 1, {n - 1})", f"greatest({2 * n - 1} - ({i}), 0)"), "reflect_101": (f"least(-({i}), {n - 1})", f"greatest({2 * n - 2} - ({i}), 0)"), "replicate": ("0", str(n - 1)), "ignore": ("-1", "-1")}[mode]
    return f"CASE WHEN {i} < 0 THEN {inner[0]} WHEN {i} > {n - 1} THEN {inner[1]} ELSE {i} END"


def _taps(k: np.ndarray) -> str:
    h, w = k.shape
    return "(VALUES " + ", ".join(f"({y * w + x}, {y - h // 2}, {x - w // 2}, {lit(k[y, x])})" for y in range(h) for x in range(w) if k[y, x] != 0) + ") t(k, dy, dx, w)"


def window_sql(k: np.ndarray, mode: str, value: str, source: str = "img8") -> str:
    """`value` aggregates q.v and t.w over the taps, in raster order by t.k."""
    return f"SELECT p.img_id, p.y, p.x, p.c, {value} v FROM {source} p CROSS JOIN {_taps(k)} JOIN {source} q ON q.img_id = p.img_id AND q.c = p.c AND q.y = {_where('p.y + t.dy', mode)} AND q.x = {_where('p.x + t.dx', mode)} GROUP BY 1, 2, 3, 4, p.v"


SUM = "list_sum(list(q.v * t.w ORDER BY t.k))"
K1 = np.array([[0.0, 1, 2], [1, 3, -1], [0, -1, 1]]) / 8
CROSS, FULL = dense.get_structuring_element(1, 3, 3).astype(float), np.ones((3, 3))
FLAT8 = -FULL.copy()
FLAT8[1, 1] = 8


def kernel(name: str, *params, sql: str | None = None, digits: int = 0) -> None:
    add(name, lambda s, d: check(im.to_px(im.run(fx.images8(s, d), KERNELS[name], *params)), digits), checked(sql, digits) if sql else None)


kernel("apply_filter2d", K1, sql=window_sql(K1, "reflect", T8.format(SUM)))
kernel("apply_blur", 3, 3, sql=window_sql(FULL / 9, "reflect", T8.format(SUM)))
kernel("apply_gaussian_blur", 3, 1.0, sql=window_sql(dense.gaussian_kernel(3, 1.0), "reflect", T8.format(SUM)))
kernel("gaussian_blur_border", 3, 1.0, 0, sql=window_sql(dense.gaussian_kernel(3, 1.0), "reflect_101", R8.format(SUM)))
kernel("apply_median_blur", 3, sql=window_sql(FULL, "reflect", "list_sort(list(q.v))[5]"))
kernel("median_filter", sql=window_sql(FULL, "reflect", "list_sort(list(q.v))[5]"))
kernel("laplacian_filter", sql=window_sql(FLAT8, "reflect", T8.format(SUM)))
SPACE = dense.gaussian_kernel(3, 2.0)
BIL = f"list_sum(list({{}} t.w * exp(-((q.v - p.v) * (q.v - p.v)) / {lit(2 * 20.0**2)}) ORDER BY t.k))"
kernel("apply_bilateral_filter", 3, 20.0, 2.0, sql=window_sql(SPACE, "reflect", R8.format(f"{BIL.format('q.v *')} / {BIL.format('')}")))
kernel("apply_sobel", 1, 0, 3, sql=window_sql(dense.sobel_kernel(1, 0, 3), "replicate", SUM))
kernel("apply_scharr", 0, 1, sql=window_sql(np.outer([-1.0, 0, 1], [3.0, 10, 3]), "replicate", SUM))
kernel("apply_laplacian", 5, sql=window_sql(dense.laplacian_kernel(5), "replicate", SUM))
kernel("pyr_down", sql=f"SELECT img_id, y // 2 y, x // 2 x, c, {T8.format('v')} v FROM ({window_sql(dense.BINOMIAL / 256, 'replicate', SUM)}) WHERE y % 2 = 0 AND x % 2 = 0")
UP = " UNION ALL ".join(f"SELECT {y} dy, {x} dx, {lit(dense.BINOMIAL[y, x] / 64)} w" for y in range(5) for x in range(5))
EVEN = lambda n: f"CAST(least(greatest((o.{n} + t.d{n} - 2) // 2, 0), 7) AS INT)"
kernel(
    "pyr_up",
    sql=f"""SELECT i.img_id, o.y, o.x, 0 c, {T8.format("sum(q.v * t.w)")} v FROM (SELECT DISTINCT img_id FROM img8) i CROSS JOIN (SELECT a.y, b.x FROM range(16) a(y) CROSS JOIN range(16) b(x)) o
    CROSS JOIN ({UP}) t JOIN img8 q ON q.img_id = i.img_id AND q.y = {EVEN("y")} AND q.x = {EVEN("x")} WHERE (o.y + t.dy) % 2 = 0 AND (o.x + t.dx) % 2 = 0 GROUP BY 1, 2, 3""",
)
kernel("adaptive_threshold", 255.0, 0, 0, 3, 2.0, sql=window_sql(FULL, "replicate", "CASE WHEN p.v > sum(q.v) / 9e0 - 2e0 THEN 255 ELSE 0 END"))
kernel("sqr_box_filter", 3, True, sql=window_sql(FULL, "replicate", "sum(q.v * q.v) / 9e0"), digits=3)
kernel("sep_filter_2d", np.array([0.25, 0.5, 0.25]), np.array([0.25, 0.5, 0.25]), sql=window_sql(np.outer([1.0, 2, 1], [1.0, 2, 1]) / 16, "replicate", T8.format(SUM)))
ERODE, DILATE = window_sql(CROSS, "ignore", "min(q.v)"), window_sql(CROSS, "ignore", "max(q.v)")
OPEN, CLOSE = f"SELECT * FROM ({window_sql(CROSS, 'ignore', 'max(q.v)', 'e')})", f"SELECT * FROM ({window_sql(CROSS, 'ignore', 'min(q.v)', 'e')})"
add("apply_erosion", lambda s, d: check(im.to_px(im.run(fx.images8(s, d), dense.apply_erosion, CROSS))), checked(ERODE))
add("apply_dilation", lambda s, d: check(im.to_px(im.run(fx.images8(s, d), dense.apply_dilation, CROSS))), checked(DILATE))
for name, first, body in (("opening", ERODE, OPEN), ("apply_closing", DILATE, CLOSE)):
    add(name, lambda s, d, name=name: check(im.to_px(im.run(fx.images8(s, d), KERNELS[name], CROSS))), checked(body, more=f"e AS ({first})"))
add("morphological_gradient", lambda s, d: check(im.to_px(im.run(fx.images8(s, d), dense.morphological_gradient, CROSS))), checked(window_sql(CROSS, "ignore", "max(q.v) - min(q.v)")))
add("top_hat", lambda s, d: check(im.to_px(im.run(fx.images8(s, d), dense.top_hat, CROSS))), checked(f"SELECT p.img_id, p.y, p.x, p.c, greatest(p.v - o.v, 0) v FROM img8 p JOIN ({OPEN}) o USING (img_id, y, x, c)", more=f"e AS ({ERODE})"))
add("black_hat", lambda s, d: check(im.to_px(im.run(fx.images8(s, d), dense.black_hat, CROSS))), checked(f"SELECT p.img_id, p.y, p.x, p.c, greatest(o.v - p.v, 0) v FROM img8 p JOIN ({CLOSE}) o USING (img_id, y, x, c)", more=f"e AS ({DILATE})"))
add("morphology_ex", lambda s, d: check(im.to_px(im.run(fx.images8(s, d), dense.morphology_ex, 2, CROSS))), checked(OPEN, more=f"e AS ({ERODE})"))
kernel("match_template", np.array([[100.0, 120], [130, 140]]), 0, sql="SELECT p.img_id, p.y, p.x, p.c, sum((q.v - t.w) * (q.v - t.w)) v FROM img8 p CROSS JOIN (VALUES (0, 0, 100), (0, 1, 120), (1, 0, 130), (1, 1, 140)) t(dy, dx, w) JOIN img8 q ON q.img_id = p.img_id AND q.y = p.y + dy AND q.x = p.x + dx WHERE p.y < 7 AND p.x < 7 GROUP BY 1, 2, 3, 4")
add("integral", lambda s, d: check(im.to_px(im.run(fx.images8(s, d), dense.integral)).where("y > 0 and x > 0").select("img_id", "y", "x", "c", "v")), checked("SELECT p.img_id, p.y + 1 y, p.x + 1 x, p.c, sum(q.v) v FROM img8 p JOIN img8 q ON q.img_id = p.img_id AND q.y <= p.y AND q.x <= p.x GROUP BY 1, 2, 3, 4"))
add("hough_lines", lambda s, d: rel.hough(fx.img8(s, d).withColumn("v", F.when(F.col("v") > 150, 255).otherwise(0)), 15).where("votes >= 4"), fx.with_fixtures("SELECT img_id, CAST(round(x * cos(radians(CAST(theta AS DOUBLE))) + y * sin(radians(CAST(theta AS DOUBLE)))) AS INT) rho, CAST(theta AS INT) theta, count(*) votes FROM img8 CROSS JOIN range(0, 180, 15) t(theta) WHERE v > 150 GROUP BY 1, 2, 3 HAVING count(*) >= 4"))

# geometry

add("apply_flip", lambda s, d: check(rel.flip(fx.img8(s, d), -1, (8, 8))), checked("SELECT img_id, 7 - y y, 7 - x x, c, v FROM img8"))
add("apply_transpose", lambda s, d: check(rel.transpose(fx.img8(s, d))), checked("SELECT img_id, x y, y x, c, v FROM img8"))


def gather_sql(sx: str, sy: str) -> str:
    return f"SELECT p.img_id, p.y, p.x, p.c, coalesce(q.v, 0) v FROM img8 p LEFT JOIN img8 q ON q.img_id = p.img_id AND q.x = CAST(round({sx}) AS INT) AND q.y = CAST(round({sy}) AS INT)"


kernel("apply_translate", 2, -1, sql=gather_sql("p.x - 2e0", "p.y + 1e0"))
C, S_ = math.cos(0.5), math.sin(0.5)
kernel("apply_rotate", 0.5, sql=gather_sql(f"(p.x - 4e0) * {lit(C)} + (p.y - 4e0) * {lit(S_)} + 4e0", f"(p.x - 4e0) * {lit(S_)} - (p.y - 4e0) * {lit(C)} + 4e0"))
kernel("apply_warp", np.array([[0.9, 0.1, 0.3], [-0.2, 1.1, 0.2], [0.0, 0.01, 1.0]]), 8, 8, sql=gather_sql("(0.9e0 * p.x + 0.1e0 * p.y + 0.3e0) / (0.01e0 * p.y + 1e0)", "(-0.2e0 * p.x + 1.1e0 * p.y + 0.2e0) / (0.01e0 * p.y + 1e0)"))
kernel("apply_warp_affine", np.array([[0.9, 0.1, 0.3], [-0.2, 1.1, 0.2]]), 8, 8, 16, sql=gather_sql("0.9e0 * p.x + 0.1e0 * p.y + 0.3e0", "-0.2e0 * p.x + 1.1e0 * p.y + 0.2e0"))
kernel("apply_resize", 4, 4, 0, sql="SELECT p.img_id, p.y, p.x, p.c, q.v FROM img8 p JOIN img8 q ON q.img_id = p.img_id AND q.x = CAST(round((p.x + 0.5e0) * 2 - 0.5e0) AS INT) AND q.y = CAST(round((p.y + 0.5e0) * 2 - 0.5e0) AS INT) WHERE p.x < 4 AND p.y < 4")
GX, GY = np.meshgrid(np.arange(8.0)[::-1], np.arange(8.0))
kernel("apply_remap", GX, GY, 0, sql="SELECT img_id, y, 7 - x x, c, v FROM img8")


def bilinear_sql(sx: str, sy: str) -> str:
    """Four taps clamped to the image, 0 where the place is outside."""
    at = f"SELECT img_id, y, x, c, sx >= 0 AND sx < 8 AND sy >= 0 AND sy < 8 ok, CASE WHEN sx >= 0 AND sx < 8 AND sy >= 0 AND sy < 8 THEN sx ELSE 0 END sx, CASE WHEN sx >= 0 AND sx < 8 AND sy >= 0 AND sy < 8 THEN sy ELSE 0 END sy FROM (SELECT img_id, y, x, c, {sx} sx, {sy} sy FROM img8)"
    weight = lambda n: f"greatest(1 - abs(p.s{n} - floor(p.s{n}) - t.d{n}), 0)"
    total = R8.format(f"list_sum(list(q.v * ({weight('x')} * {weight('y')}) ORDER BY t.k))")
    return f"SELECT p.img_id, p.y, p.x, p.c, CASE WHEN p.ok THEN {total} ELSE 0 END v FROM ({at}) p CROSS JOIN (VALUES (0, 0, 0), (1, 0, 1), (2, 1, 0), (3, 1, 1)) t(k, dy, dx) JOIN img8 q ON q.img_id = p.img_id AND q.y = CAST(least(floor(p.sy) + t.dy, 7) AS INT) AND q.x = CAST(least(floor(p.sx) + t.dx, 7) AS INT) GROUP BY p.img_id, p.y, p.x, p.c, p.ok"


TURN = lit(2 * math.pi / 8)
kernel("apply_linear_polar", (4.0, 4.0), 4.0, sql=bilinear_sql(f"4 + (y * 4e0 / 8) * cos(x * {TURN})", f"4 + (y * 4e0 / 8) * sin(x * {TURN})"))
kernel("apply_log_polar", (4.0, 4.0), 4.0, sql=bilinear_sql(f"4 + exp(y / 4e0) * cos(x * {TURN})", f"4 + exp(y / 4e0) * sin(x * {TURN})"))

# contours of points in time

for name, columns, sql in (
    ("contour_area", ["area2", "oriented2"], "CASE WHEN n < 3 THEN 0 ELSE abs(t) END area2, CASE WHEN n < 3 THEN 0 ELSE t END oriented2"),
    ("arc_length", ["closed", "open"], "closed, open"),
    ("bounding_rect", ["x", "y", "w", "h"], "x, y, w, h"),
):
    body = "SELECT contour_id, count(*) n, CAST(sum(CAST(x AS BIGINT) * y2 - CAST(x2 AS BIGINT) * y) AS BIGINT) t, round(sum(sqrt(CAST((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y) AS DOUBLE))), 4) closed, round(sum(CASE WHEN last THEN 0 ELSE sqrt(CAST((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y) AS DOUBLE)) END), 4) open, min(x) x0, min(y) y0, max(x) - min(x) + 1 w, max(y) - min(y) + 1 h FROM (SELECT *, coalesce(lead(x) OVER o, first(x) OVER a) x2, coalesce(lead(y) OVER o, first(y) OVER a) y2, lead(x) OVER o IS NULL last FROM pts WINDOW o AS (PARTITION BY contour_id ORDER BY i), a AS (PARTITION BY contour_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY 1"
    add(name, lambda s, d, name=name, columns=columns: rel.contour_measures(fx.pts(s, d)).select("contour_id", *[F.round(c, 4).alias(c) if name == "arc_length" else F.col(c) for c in columns]), fx.with_fixtures(f"SELECT contour_id, {sql.replace('x, y,', 'x0 x, y0 y,') if name == 'bounding_rect' else sql} FROM ({body})"))
add("moments", lambda s, d: rel.moments(fx.img8(s, d)), fx.with_fixtures("SELECT img_id, " + ", ".join(f"CAST(sum(CAST(v AS BIGINT){' * x' * i}{' * y' * j}) AS BIGINT) m{i}{j}" for i, j in shapes.ORDERS) + " FROM img8 GROUP BY 1"))


RING = "ring AS (SELECT contour_id, i, x, y, coalesce(lead(x) OVER o, first(x) OVER a) x2, coalesce(lead(y) OVER o, first(y) OVER a) y2, count(*) OVER a n FROM pts WINDOW o AS (PARTITION BY contour_id ORDER BY i), a AS (PARTITION BY contour_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"


def contours(name: str, f: Callable, schema: str, names: list[str], sql: str | None = None) -> None:
    """A kernel per contour."""
    add(name, lambda s, d: by_key(fx.pts(s, d), "contour_id", "i", ["x", "y"], lambda p: f(p.astype(np.int32)), schema, names), sql and fx.with_fixtures(sql, RING))


CONVEX = """SELECT contour_id, coalesce(NOT (bool_or(t > 0) AND bool_or(t < 0)) OR min(n) < 3, TRUE) convex FROM (
    SELECT contour_id, n, dx * coalesce(lead(dy) OVER o, first(dy) OVER a) - dy * coalesce(lead(dx) OVER o, first(dx) OVER a) t
    FROM (SELECT contour_id, i, n, x2 - x dx, y2 - y dy FROM ring)
    WINDOW o AS (PARTITION BY contour_id ORDER BY i), a AS (PARTITION BY contour_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY 1"""
INSIDE = """SELECT contour_id, round(CASE WHEN near < 1e-9 THEN 0 WHEN odd % 2 = 1 THEN sqrt(near) ELSE -sqrt(near) END, 6) + 0e0 d FROM (
    SELECT contour_id, min(pow(x + k * (x2 - x) - 200, 2) + pow(y + k * (y2 - y) - 50, 2)) near,
    count(*) FILTER (WHERE (y > 50) <> (y2 > 50) AND 200 < (x2 - x) * (50 - y) / CASE WHEN y2 = y THEN 1e0 ELSE CAST(y2 - y AS DOUBLE) END + x) odd
    FROM (SELECT *, CASE WHEN x2 = x AND y2 = y THEN 0e0 ELSE greatest(0e0, least(1e0, CAST((200 - x) * (x2 - x) + (50 - y) * (y2 - y) AS DOUBLE) / ((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)))) END k FROM ring) GROUP BY 1)"""


def _try(f: Callable) -> Callable:
    """No row where the kernel finds no answer."""

    def call(p):
        try:
            return [f(p)]
        except ValueError:
            return []

    return call


contours("convex_hull", lambda p: [(i, int(x), int(y)) for i, (x, y) in enumerate(shapes.convex_hull(p))], "i int, x int, y int", ["i", "x", "y"])
contours("min_area_rect", lambda p: [(*r[0], *r[1], r[2]) for r in [shapes.min_area_rect(p)]], "x double, y double, w double, h double, angle double", ["x", "y", "w", "h", "angle"])
contours("min_enclosing_circle", lambda p: [(*c[0], c[1]) for c in [shapes.min_enclosing_circle(p)]], "x double, y double, r double", ["x", "y", "r"])
contours("fit_ellipse", _try(lambda p: (*(e := shapes.fit_ellipse(p))[0], *e[1], e[2])), "x double, y double, a double, b double, angle double", ["x", "y", "a", "b", "angle"])
contours("convexity_defects", lambda p: [tuple(map(int, r)) for r in shapes.convexity_defects(p, shapes.convex_hull(p, return_points=False))], "start int, `end` int, far int, depth int", ["start", "end", "far", "depth"])
contours("approx_poly_dp", lambda p: [(i, int(x), int(y)) for i, (x, y) in enumerate(shapes.approx_poly_dp(p, 5.0))], "i int, x int, y int", ["i", "x", "y"])
contours("hu_moments", lambda p: [(i, float(h)) for i, h in enumerate(shapes.hu_moments(shapes.moments(p)))], "i int, h double", ["i", "h"])
contours("match_shapes", lambda p: [(shapes.match_shapes(p, p[::-1] * 2, m),) for m in (1, 2, 3)], "d double", ["d"])
contours("is_contour_convex", lambda p: [(shapes.is_contour_convex(p),)], "convex boolean", ["convex"], CONVEX)
contours("point_polygon_test", lambda p: [(round(shapes.point_polygon_test(p, (200, 50), True), 6) + 0.0,)], "d double", ["d"], INSIDE)

# segmentation

BIN = lambda s, d: im.from_px(rel.apply_point(fx.img8(s, d), "apply_threshold", 127))
REACH = "reach AS (SELECT img_id, y, x, y * 8 + x l FROM bin8 WHERE v = 255 UNION SELECT b.img_id, b.y, b.x, r.l FROM reach r JOIN bin8 b ON b.img_id = r.img_id AND b.v = 255 AND abs(b.y - r.y) <= 1 AND abs(b.x - r.x) <= 1)"
LABELS = "lab AS (SELECT img_id, y, x, dense_rank() OVER (PARTITION BY img_id ORDER BY l) l FROM (SELECT img_id, y, x, min(l) l FROM reach GROUP BY 1, 2, 3))"
add("connected_components", lambda s, d: check(im.to_px(im.run(BIN(s, d), shapes.connected_components))), checked("SELECT b.img_id, b.y, b.x, b.c, coalesce(l, 0) v FROM bin8 b LEFT JOIN lab USING (img_id, y, x)", more=f"{REACH}, {LABELS}", recursive=True))


def _stats(s: SparkSession, d: str) -> DataFrame:
    lab = im.to_px(im.run(BIN(s, d), shapes.connected_components)).where("v > 0")
    return lab.groupBy("img_id", F.col("v").cast("int").alias("label")).agg(F.min("x").alias("left"), F.min("y").alias("top"), (F.max("x") - F.min("x") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"), F.count("*").alias("area"))


add("connected_components_with_stats", _stats, fx.with_fixtures('SELECT img_id, CAST(l AS INT) "label", min(x) "left", min(y) "top", max(x) - min(x) + 1 width, max(y) - min(y) + 1 height, count(*) area FROM lab GROUP BY 1, 2', f"{REACH}, {LABELS}", True))
add("distance_transform", lambda s, d: check(im.to_px(im.run(BIN(s, d), shapes.distance_transform)), 3), checked("SELECT p.img_id, p.y, p.x, p.c, coalesce(min(greatest(abs(p.y - q.y), abs(p.x - q.x)) - least(abs(p.y - q.y), abs(p.x - q.x)) + 1.414e0 * least(abs(p.y - q.y), abs(p.x - q.x))), 0) v FROM bin8 p LEFT JOIN bin8 q ON q.img_id = p.img_id AND q.v = 0 GROUP BY 1, 2, 3, 4", 3))
add("flood_fill", lambda s, d: check(im.to_px(im.run(fx.images8(s, d), shapes.flood_fill, (0, 0), 255, 20, 30))), checked("SELECT p.img_id, p.y, p.x, p.c, CASE WHEN f.img_id IS NULL THEN p.v ELSE 255 END v FROM img8 p LEFT JOIN fill f ON f.img_id = p.img_id AND f.y = p.y AND f.x = p.x", more="fill AS (SELECT img_id, y, x, v s FROM img8 WHERE y = 0 AND x = 0 UNION SELECT p.img_id, p.y, p.x, f.s FROM fill f JOIN img8 p ON p.img_id = f.img_id AND abs(p.y - f.y) + abs(p.x - f.x) = 1 AND abs(p.v - f.s) <= 20)", recursive=True))

# descriptors

side = lambda s, d, q: fx.table(s, d, "embeddings").where(F.col("vec_id") % 10 == 0 if q else F.col("vec_id") % 10 != 0).select(F.col("vec_id").alias("idx"), F.col("embedding").alias("d"))
NEAR = "near AS (SELECT q.vec_id query_idx, t.vec_id train_idx, sqrt(list_sum(list_transform(list_zip(q.embedding, t.embedding), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2])))) distance FROM embeddings q JOIN embeddings t ON q.vec_id % 10 = 0 AND t.vec_id % 10 <> 0), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_idx ORDER BY distance, train_idx) AS INT) rank, row_number() OVER (PARTITION BY train_idx ORDER BY distance, query_idx) back FROM near)"
add("knn_match", lambda s, d: rel.match(side(s, d, True), side(s, d, False), 3).withColumn("distance", F.round("distance", 5)), fx.with_fixtures("SELECT query_idx, rank, train_idx, round(distance, 5) distance FROM ranked WHERE rank <= 3", NEAR))
add("bf_match", lambda s, d: rel.mutual(side(s, d, True), side(s, d, False)).withColumn("distance", F.round("distance", 5)), fx.with_fixtures("SELECT query_idx, train_idx, round(distance, 5) distance FROM ranked WHERE rank = 1 AND back = 1", NEAR))
add("flann_match", lambda s, d: rel.match(side(s, d, True), side(s, d, False)).drop("rank").withColumn("distance", F.round("distance", 5)), fx.with_fixtures("SELECT query_idx, train_idx, round(distance, 5) distance FROM ranked WHERE rank = 1", NEAR))

# the rest runs its kernel on page images or on parameters, without SQL to compare with

POINTS = "x double, y double, size double, response double"


def keypoints(name: str, f: Callable) -> None:
    add(name, lambda s, d: im.rows(fx.page_images(s, d), lambda a: [(p.x, p.y, p.size, p.response) for p in f(a)], POINTS, ["x", "y", "size", "response"]))


keypoints("fast_detect", features.fast_detect)
keypoints("good_features_to_track", lambda a: features.good_features_to_track(a, 100))


def described(name: str, f: Callable) -> None:
    """Keypoints with the sum of their descriptor, in thousandths."""
    found = lambda a: [(p.x, p.y, p.size, p.response, int(np.floor(np.asarray(v, float) * 1000 + 0.5).sum())) for p, v in zip(*f(a), strict=True)]
    add(name, lambda s, d: im.rows(fx.page_images(s, d), found, POINTS + ", descriptor bigint", ["x", "y", "size", "response", "descriptor"]))


for name in ("orb_detect_and_compute", "sift_detect_and_compute", "brisk_detect_and_compute", "akaze_detect_and_compute"):
    described(name, KERNELS[name])
keypoints("simple_blob_detect", lambda a: features.simple_blob_detect(a, threshold_step=40.0))


def listed(name: str, f: Callable, schema: str, names: list[str], source: Callable = fx.page_images) -> None:
    add(name, lambda s, d: im.rows(source(s, d), f, schema, names))


def image(name: str, f: Callable, digits: int = 0, source: Callable = fx.page_images, sql: str | None = None, more: str = "") -> None:
    """f gives an image; checksums of it."""
    add(name, lambda s, d: check(im.to_px(im.run(source(s, d), f)), digits), sql and checked(sql, digits, more))


#: Sobel gradients inside the frame, and the sums of their products over 3x3 windows; whole numbers, exact in single precision.
TENSOR = """grad AS (SELECT p.img_id, p.y, p.x, sum(q.v * t.a) gx, sum(q.v * t.b) gy FROM img8 p
    CROSS JOIN (VALUES (-1, -1, -1, -1), (-1, 0, 0, -2), (-1, 1, 1, -1), (0, -1, -2, 0), (0, 1, 2, 0), (1, -1, -1, 1), (1, 0, 0, 2), (1, 1, 1, 1)) t(dy, dx, a, b)
    JOIN img8 q ON q.img_id = p.img_id AND q.y = p.y + t.dy AND q.x = p.x + t.dx WHERE p.y BETWEEN 1 AND 6 AND p.x BETWEEN 1 AND 6 GROUP BY 1, 2, 3),
tensor AS (SELECT p.img_id, p.y, p.x, CAST(CASE WHEN p.y BETWEEN 1 AND 6 AND p.x BETWEEN 1 AND 6 THEN coalesce(sum(gx * gx), 0) ELSE 0 END AS FLOAT) xx, CAST(CASE WHEN p.y BETWEEN 1 AND 6 AND p.x BETWEEN 1 AND 6 THEN coalesce(sum(gy * gy), 0) ELSE 0 END AS FLOAT) yy,
    CAST(CASE WHEN p.y BETWEEN 1 AND 6 AND p.x BETWEEN 1 AND 6 THEN coalesce(sum(gx * gy), 0) ELSE 0 END AS FLOAT) xy FROM img8 p LEFT JOIN grad g ON g.img_id = p.img_id AND abs(g.y - p.y) <= 1 AND abs(g.x - p.x) <= 1 GROUP BY p.img_id, p.y, p.x)"""
LEAST = "t / CAST(2 AS FLOAT) - CAST(sqrt(CAST(greatest(t * t / CAST(4 AS FLOAT) - (xx * yy - xy * xy), CAST(0 AS FLOAT)) AS DOUBLE)) AS FLOAT)"
DERIVED = """(SELECT p.img_id, p.y, p.x, {} FROM img8 p JOIN img8 q ON q.img_id = p.img_id AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 WHERE p.y BETWEEN 2 AND 5 AND p.x BETWEEN 2 AND 5 GROUP BY 1, 2, 3)""".format(
    ", ".join(f"CAST(sum(CASE {' '.join(f'WHEN q.y - p.y = {dy} AND q.x - p.x = {dx} THEN {w} * q.v' for dy, dx, w in taps)} ELSE 0 END) AS FLOAT) / CAST({by} AS FLOAT) {n}" for n, by, taps in (("dx", 2, ((0, 1, 1), (0, -1, -1))), ("dy", 2, ((1, 0, 1), (-1, 0, -1))), ("dxx", 1, ((0, 1, 1), (0, 0, -2), (0, -1, 1))), ("dyy", 1, ((1, 0, 1), (0, 0, -2), (-1, 0, 1))), ("dxy", 4, ((1, 1, 1), (1, -1, -1), (-1, 1, -1), (-1, -1, 1)))))
)
UNDISTORTED = lambda n, m: f"(({n} - 4) / 8e0) * (1 + 0.1e0 * ((({n} - 4) / 8e0) * (({n} - 4) / 8e0) + (({m} - 4) / 8e0) * (({m} - 4) / 8e0))) * 8e0 + 4e0"
THREE_D = " UNION ALL ".join(f"SELECT img_id, y, x, {i} c, CAST(({e}) / (0.5e0 * v + 1) AS FLOAT) v FROM img8" for i, e in enumerate(("x - 4", "y - 4", "8")))
TRIANGLE = """SELECT img_id, t FROM (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY far DESC, bin) k FROM (
    SELECT img_id, bin, CASE WHEN lo = hi THEN peak ELSE bin END + CASE WHEN isleft AND lo < hi THEN 1 ELSE 0 END t, CASE WHEN lo = hi THEN 0 ELSE abs((hb - ha) * bin - (hi - lo) * n + hi * ha - hb * lo) END far FROM (
    SELECT e.*, h.bin, h.n, a.n ha, b.n hb FROM ends e JOIN every h ON h.img_id = e.img_id AND h.bin BETWEEN e.lo AND e.hi JOIN every a ON a.img_id = e.img_id AND a.bin = e.lo JOIN every b ON b.img_id = e.img_id AND b.bin = e.hi))) WHERE k = 1"""
TRIANGLE_ENDS = """every AS (SELECT i.img_id, CAST(r.bin AS INT) bin, coalesce(h.n, 0) n FROM (SELECT DISTINCT img_id FROM img8) i CROSS JOIN range(256) r(bin) LEFT JOIN (SELECT img_id, v, count(*) n FROM img8 GROUP BY 1, 2) h ON h.img_id = i.img_id AND h.v = r.bin),
ends AS (SELECT img_id, peak, CASE WHEN peak - lo < hi - peak THEN peak ELSE lo END lo, CASE WHEN peak - lo < hi - peak THEN hi ELSE peak END hi, NOT (peak - lo < hi - peak) isleft FROM (
    SELECT img_id, arg_min(bin, (-n, bin)) peak, min(bin) FILTER (WHERE n > 0) lo, max(bin) FILTER (WHERE n > 0) hi FROM every GROUP BY 1))"""


EDGES = lambda a: dense.canny_l2(a, 40.0, 120.0)
RGB8 = _images
MASK = np.pad(np.ones((4, 4), np.uint8) * 255, 2)
LINES = "x1 double, y1 double, x2 double, y2 double"
listed("mser_detect", lambda a: [(len(r), r[0][0], r[0][1]) for r in features.mser_detect(a, 32, 30)], "area int, x int, y int", ["area", "x", "y"])
listed("find_contours", lambda a: [(len(p), shapes.contour_area(p)) for p in shapes.find_contours(a > 110)], "points int, area double", ["points", "area"])
listed("hough_circles", lambda a: dense.hough_circles(EDGES(a), 5, 60), "x int, y int, r int", ["x", "y", "r"])
listed("hough_lines_p", lambda a: KERNELS["hough_lines_p"](EDGES(a), threshold=20, min_line_length=10.0), LINES, ["x1", "y1", "x2", "y2"])
listed("line_segment_detector", lambda a: [t[:4] for t in KERNELS["line_segment_detector"](a)], LINES, ["x1", "y1", "x2", "y2"])
listed("corner_sub_pix", lambda a: KERNELS["corner_sub_pix"](a, [(10.0, 3.0), (30.0, 5.0)]), "x double, y double", ["x", "y"])
listed("imencode", lambda a: [(KERNELS["imencode"](".png", a)[1].tobytes(),)], "data binary", ["data"], fx.images8)
listed("imdecode", lambda a: [(int((KERNELS["imdecode"](KERNELS["imencode"](".png", a)[1], 0) == a).sum()),)], "same int", ["same"], fx.images8)
listed("drawMatches", lambda a: [(int(features.drawMatches(a, p := features.fast_detect(a), a, p, [features.DMatch(i, i, 0.0) for i in range(len(p))]).sum()),)], "total bigint", ["total"])
listed("CascadeClassifier", media.faces, "x int, y int, w int, h int", ["x", "y", "w", "h"])
listed("HOGDescriptor", lambda a: [(float(detect.HOGDescriptor((8, 8), (8, 8), (4, 4), (4, 4)).compute(a).sum()),)], "total double", ["total"], fx.images8)
add("apply_threshold_triangle", lambda s, d: im.rows(fx.images8(s, d), lambda a: [(int(dense.apply_threshold_triangle(a)[0]),)], "t int", ["t"]).drop("idx"), fx.with_fixtures(TRIANGLE, TRIANGLE_ENDS))
#: A flat goal: of 64 pixels, the share up to v in 256 equal steps.
for name, source in (("hist_spec_rgb", "rgb8"), ("hist_spec_gray", "grey")):
    image(name, lambda a, f=KERNELS[name]: f(a, np.ones(256, np.float32)), 0, RGB8, f"SELECT img_id, y, x, c, CAST(4 * count(*) OVER (PARTITION BY img_id, c ORDER BY v RANGE UNBOUNDED PRECEDING) - 1 AS INT) v FROM {source}", "grey AS (SELECT img_id, y, x, 0 c, (77 * r + 150 * g + 29 * b) // 256 v FROM rgb)")
add("fastNlMeansDenoisingColored", lambda s, d: check(im.to_px(im.run(RGB8(s, d), KERNELS["fastNlMeansDenoisingColored"], 10.0, 10.0, 3, 9))))
for name, args in (("colorChange", (MASK, 1.5, 0.5, 1.0)), ("illuminationChange", (MASK,)), ("textureFlattening", (MASK,)), ("decolor", ()), ("edgePreservingFilter", ()), ("detailEnhance", ()), ("pencilSketch", ()), ("stylization", ())):
    image(name, lambda a, f=KERNELS[name], args=args: f(a, *args), source=RGB8)
image("seamlessClone", lambda a: KERNELS["seamlessClone"](a, a[::-1].copy(), MASK, (4, 4)), source=RGB8)
image("grab_cut", lambda a: KERNELS["grab_cut"](a, np.zeros((8, 8), np.uint8), (2, 2, 4, 4), None, None, 2, 0)[0], source=RGB8)
image("createTonemap", lambda a: KERNELS["createTonemap"](2.2).process(a), 3, RGB8)
image("createMergeMertens", lambda a: KERNELS["createMergeMertens"]().process([a, a // 2]), 3, RGB8)
image("createMergeDebevec", lambda a: np.log(KERNELS["createMergeDebevec"]().process([a, a // 2], [1.0, 0.5])), 3, RGB8)
image("createCalibrateDebevec", lambda a: np.log(np.maximum(KERNELS["createCalibrateDebevec"](20).process([a, a // 2], [1.0, 0.5]), 1e-9)), 3, RGB8)
image("blobFromImage", lambda a: KERNELS["blobFromImage"](a, 1 / 255, (4, 4))[0].transpose(1, 2, 0), 3, RGB8)
image("inpaint", lambda a: KERNELS["inpaint"](a, MASK, 3.0), source=fx.images8)
kernel("fastNlMeansDenoising", 10.0, 3, 9)
image("undistort", lambda a: KERNELS["undistort"](a, np.array([[8.0, 0, 4], [0, 8, 4], [0, 0, 1]]), [0.1, 0, 0, 0]), source=fx.images8, sql=bilinear_sql(UNDISTORTED("x", "y"), UNDISTORTED("y", "x")))
image("reprojectImageTo3D", lambda a: KERNELS["reprojectImageTo3D"](a, np.array([[1.0, 0, 0, -4], [0, 1, 0, -4], [0, 0, 0, 8], [0, 0, 0.5, 1]])), 3, fx.images8, THREE_D)
image("watershed", lambda a: KERNELS["watershed"](a, np.pad([[1]], ((0, 7), (0, 7))) + np.pad([[2]], ((7, 0), (7, 0)))), source=fx.images8)
image("apply_canny", lambda a: dense.apply_canny(a.astype(float), 20.0, 60.0))
image("canny_l2", EDGES)
image("harris_corner", lambda a: dense.harris_corner(a, 3, 0), source=fx.images8, sql="SELECT img_id, y, x, 0 c, xx * yy - xy * xy v FROM tensor", more=TENSOR)
image("shi_tomasi_corners", lambda a: dense.shi_tomasi_corners(a, 3), source=fx.images8, sql=f"SELECT img_id, y, x, 0 c, trunc(CAST({LEAST} AS DOUBLE)) v FROM (SELECT *, xx + yy t FROM tensor)", more=TENSOR)
image("corner_eigen_vals_and_vecs", lambda a: dense.corner_eigen_vals_and_vecs(a), source=fx.images8)
image("pre_corner_detect", lambda a: dense.pre_corner_detect(a), source=fx.images8, sql=f"SELECT p.img_id, p.y, p.x, 0 c, coalesce(trunc(CAST(dx * dx * dyy + dy * dy * dxx - CAST(2 AS FLOAT) * dx * dy * dxy AS DOUBLE)), 0) v FROM img8 p LEFT JOIN {DERIVED} g USING (img_id, y, x)")
image("apply_frequency_filter", lambda a: np.abs(dense.apply_frequency_filter(np.fft.fftshift(np.fft.fft2(a)), 3.0, "GLPF")), source=fx.images8)
image("drawKeypoints", lambda a: features.drawKeypoints(a, features.fast_detect(a)))
DRAW = {"line": ((1, 1), (6, 4), 255), "rectangle": ((1, 1), (6, 5), 255), "circle": ((4, 4), 3, 255), "ellipse": ((4, 4), (3, 2), 30.0, 0.0, 360.0, 255), "polylines": ([[(1, 1), (6, 2), (3, 6)]], True, 255), "fill_poly": ([[(1, 1), (6, 2), (3, 6)]], 255), "arrowed_line": ((1, 1), (6, 5), 255), "put_text": ("A", (0, 8), 1.0, 255), "draw_contours": ([np.array([(1, 1), (6, 1), (6, 6), (1, 6)])], -1, 255, 1)}
for name, args in DRAW.items():
    image(name, lambda a, f=KERNELS[name], args=args: f(a, *args), source=fx.images8)
#: A filled rectangle is a predicate, so SQL can check this one.
add("rectangle", lambda s, d: check(im.to_px(im.run(fx.images8(s, d), shapes.rectangle, (1, 2), (5, 6), 255, -1))), checked("SELECT img_id, y, x, c, CASE WHEN x BETWEEN 1 AND 5 AND y BETWEEN 2 AND 6 THEN 255 ELSE v END v FROM img8"))


from . import scenes  # noqa: E402

for name, (query, sql) in scenes.QUERIES.items():
    add(name, query, sql)


def _grouped(name: str, f: Callable, schema: str, columns: list[str]) -> None:
    """A kernel over the boxes of an image: rows of box_id, x, y, w, h, score."""
    add(name, lambda s, d: by_key(fx.boxes(s, d), "img_id", "box_id", ["box_id", "x", "y", "w", "h", "score"], f, schema, columns))


_grouped("NMSBoxes", lambda p: [(int(p[i, 0]),) for i in detect.NMSBoxes(p[:, 1:5], p[:, 5], 100, 0.3)], "box_id bigint", ["box_id"])
_grouped("groupRectangles", lambda p: [(*map(int, r), int(n)) for r, n in zip(*detect.groupRectangles(p[:, 1:5], 1, 0.9), strict=True)], "x int, y int, w int, h int, n int", ["x", "y", "w", "h", "n"])


WEIGHED = " , ".join(f"CAST(sum(v * ((y * 8 + x) % {m} - {o})) + {b} AS BIGINT) AS {n}_score" for n, m, o, b in (("first", 7, 3, 5), ("second", 5, 2, -3)))
for name in ("readNet", "readNetFromONNX", "readNetFromTensorflow"):
    add(name, lambda s, d, name=name: media.scored(s, d, name), fx.with_fixtures(f"SELECT img_id, {WEIGHED} FROM img8 GROUP BY 1"))


# frames and streams

from .streaming import frames as st  # noqa: E402
from .streaming import windows as sw  # noqa: E402

for name, f in st.PAIRS.items():
    add(name, lambda s, d, f=f: st.frame_pairs(st.frames(fx.images8(s, d)), f))
add("background_subtract_mog2", lambda s, d: st.batch_background(st.frames(fx.images8(s, d)), "mog2"))
add("createBackgroundSubtractorKNN", lambda s, d: st.batch_background(st.frames(fx.images8(s, d)), "knn"))
add("KalmanFilter", lambda s, d: st.kalman(fx.pts(s, d)))
add("meanShift", lambda s, d: im.rows(fx.images8(s, d), lambda a: [KERNELS["meanShift"](a, (2, 2, 4, 4))[1]], "x int, y int, w int, h int", ["x", "y", "w", "h"]))
add("CamShift", lambda s, d: im.rows(fx.images8(s, d), lambda a: [KERNELS["CamShift"](a, (2, 2, 4, 4))[1]], "x int, y int, w int, h int", ["x", "y", "w", "h"]))
add("buildOpticalFlowPyramid", lambda s, d: im.rows(fx.page_images(s, d), lambda a: [(p.shape[0], p.shape[1]) for p in KERNELS["buildOpticalFlowPyramid"](a, (8, 8), 3, False)[1]], "h int, w int", ["h", "w"]))
FRAMES = "SELECT img_id % 5 stream_id, img_id // 5 frame_idx, CAST(sum(v) AS BIGINT) total, CAST(sum(v * (y * 8 + x + 1)) AS BIGINT) spread FROM img8 {} GROUP BY 1, 2"
for name, f, some in (("video_capture", media.captured, ""), ("extract_images_from_video", media.extracted, "WHERE (img_id // 5) % 3 = 0"), ("extract_video_from_images", media.assembled, "")):
    add(name, lambda s, d, f=f: media.watched(s, d, f), fx.with_fixtures(FRAMES.format(some)))
for name, ext in (("imread", ".bmp"), ("imwrite", ".png")):
    add(name, lambda s, d, ext=ext: check(im.to_px(im.run(media.through_files(s, d, ext), np.asarray))), checked("SELECT * FROM img8"))
add("tumbling_windows", lambda s, d: sw.tumbling(sw.batch(s, d)), "SELECT time_bucket(INTERVAL 1 HOUR, ts) window_start, event_type, count(*) n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) total FROM events GROUP BY 1, 2")
add("tumbling_windows_streamed", lambda s, d: sw.streamed(s, d, sw.tumbling), "SELECT time_bucket(INTERVAL 1 HOUR, ts) window_start, event_type, count(*) n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) total FROM events GROUP BY 1, 2")
add("running_state_streamed", lambda s, d: sw.streamed_state(s, d), "SELECT user_id, count(*) n, max(ts) last_ts FROM events GROUP BY 1")

for alias, name in ALIASES.items():
    key, base = f"{MODULE_OF[alias]}__{alias}", f"{MODULE_OF[name]}__{name}"
    QUERIES[key] = QUERIES[base]
    if base in ORACLES:
        ORACLES[key] = ORACLES[base]
